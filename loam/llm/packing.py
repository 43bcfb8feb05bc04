"""Packing token sequences of documents into training sequences: shortest pack first over the histogram of lengths."""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field
from functools import lru_cache

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loam.llm.common import partitions, ship, staged, text_of

SIZE, END = 2048, 1
#: Chunks that a worker remembers, and their characters, at most; characters of a text's part, bytes of ids and characters of texts that are worked off together.
REMEMBER, REMEMBER_CHARS, PART, FLUSH, GROUP = 900_000, 32, 1 << 20, 1 << 22, 1 << 23
#: Characters that are their own normal form and are lower-cased one by one: spaces, line feeds, printable ones below U+0180 but one. How
#: the tokenizer splits text into words (fixed value), with its classes of letters and numbers spelled out for those characters.
SIMPLE = re.compile("[ \n!-~\u00A1-\u012F\u0131-\u017F]*")
LETTERS, NUMBERS = "a-zA-Z\u00AA\u00B5\u00BA\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u017F", "0-9\u00B2\u00B3\u00B9\u00BC-\u00BE"
WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^ \n{LETTERS}{NUMBERS}]+")


class Encoder(dict):
    """chunk -> its ids, four little-endian bytes each. The tokenizer lower-cases a text, splits it into words, drops white space and
    encodes each word by itself; so the ids of chunks between spaces or line feeds, one after the other, are the text's. A text of
    SIMPLE characters is lower-cased here, and its chunks are split into words as the tokenizer does it; a word that was met before
    isn't encoded again. Chunks of other texts are left to the tokenizer whole."""

    def __init__(self, blob: bytes):
        import numpy as np
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_buffer(blob)
        self.tokenizer.encode_special_tokens = True  # names of special tokens in a text are ordinary text
        self.last = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)  # ids that end a word
        self.last[[i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if t.endswith("</w>")]] = True
        self.blobs = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        # Whether the model's ids of a word of ASCII characters are the tokenizer's: nothing but lower-casing and splitting comes before it.
        self.model, probes = self.tokenizer.model, ["a", "is", "packing", "qzxjk", "7", "(", *map("".join, zip("!#%&*+,-./:;<=>?@", "~}|{`_^$~}|{`_^$~"))]
        self.direct = all(self.of_model(w) == self.ids(w) for w in probes)
        self.passing: dict[str, bytes] = {}

    def of_model(self, word: str) -> bytes:
        return b"".join([self.blobs[t.id] for t in self.model.tokenize(word)])

    def ids(self, text: str) -> bytes:
        import numpy as np

        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def __missing__(self, chunk: str) -> bytes:
        return self.passing[chunk]

    def keep(self, found: dict[str, bytes]) -> None:
        """Remembers short chunks while there is room; the others pass with the batch."""
        if len(self) + len(found) <= REMEMBER:
            self.update((c, x) for c, x in found.items() if len(c) <= REMEMBER_CHARS)
        self.passing.update((c, x) for c, x in found.items() if c not in self)

    def meet(self, words: list[str]) -> None:
        """Ids of new words: those of ASCII characters by the model, since the tokenizer's alignments cost more than the merges; the others
        all in one call, told apart by the ids that end words."""
        import numpy as np

        if self.direct:
            self.keep({w: self.of_model(w) for w in words if w.isascii()})
            words = [w for w in words if not w.isascii()]
        if not words:
            return
        ids = np.array(self.tokenizer.encode(" ".join(words), add_special_tokens=False).ids, dtype="<u4")
        ends = (np.flatnonzero(self.last[ids]) + 1).tolist()
        if len(ends) == len(words):
            blob = ids.tobytes()
            self.keep({w: blob[4 * a : 4 * b] for w, a, b in zip(words, [0, *ends[:-1]], ends, strict=True)})
        else:  # a vocabulary that doesn't mark the ends of words
            self.keep({w: self.ids(w) for w in words})

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text. Chunks are told apart and ids laid out by columns; what Python does one by one are the different chunks."""
        import gc

        on = gc.isenabled()
        gc.disable()  # many objects, no cycles
        try:
            return self._encode(texts)
        finally:
            if on:
                gc.enable()

    def _encode(self, texts: list[str]) -> list[bytes]:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        self.passing = {}
        simple = [SIMPLE.fullmatch(t) is not None for t in texts]
        lists = pc.split_pattern(pa.array([(t.lower() if s else t).replace("\n", " ") for t, s in zip(texts, simple, strict=True)], pa.large_string()), " ")
        bounds = np.asarray(lists.offsets).astype(np.int64)
        coded = lists.values.dictionary_encode()
        chunks, at = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        found = list(map(self.get, chunks))
        new = [i for i, x in enumerate(found) if x is None]
        whole = np.zeros(len(chunks), dtype=bool)  # those that some text of other characters has
        if not all(simple):
            whole[at[np.repeat(~np.array(simple), np.diff(bounds))]] = True
        words, parts, others = set(), {}, []
        for c, w in zip([chunks[i] for i in new], whole[new].tolist(), strict=True):
            if w:
                others.append(c)
            elif c.isalpha():
                words.add(c)
            else:
                parts[c] = [c[:-1], c[-1]] if c[:-1].isalpha() else WORDS.findall(c)
        self.meet(list(words.union(*parts.values()).difference(self)))
        self.keep({c: b"".join([self[w] for w in ws]) for c, ws in parts.items() if ws != [c]})
        self.keep({c: self.ids(c) for c in others if c not in self and c not in self.passing})
        for i in new:
            found[i] = self[chunks[i]]
        ids = np.frombuffer(b"".join(found), dtype="<u4")
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
        begins, n = (np.cumsum(sizes) - sizes)[at], sizes[at]
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = ids[np.repeat(begins - ends[:-1], n) + np.arange(ends[-1])]
        edges = ends[bounds].tolist()
        return [ids[a:b].tobytes() for a, b in zip(edges, edges[1:])]


@lru_cache(maxsize=1)
def encoder(blob: bytes) -> Encoder:
    return Encoder(blob)


def parts_of(text: str, most: int) -> list[str]:
    """A text in parts of about `most` characters, cut at spaces or line feeds."""
    out, at = [], 0
    while len(text) - at > most:
        cuts = [i for i in (text.find(" ", at + most), text.find("\n", at + most)) if i >= 0]
        if not cuts:
            break
        out.append(text[at : min(cuts)])
        at = min(cuts) + 1
    return [*out, text[at:]]


def groups(batches):
    """Ids and texts of successive rows, of about GROUP characters together."""
    docs, texts, held = [], [], 0
    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            batch = whole.slice(at, 256)
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                docs.append(doc)
                texts.append(text)
                held += len(text)
                if held > GROUP:
                    yield docs, texts
                    docs, texts, held = [], [], 0
    if docs:
        yield docs, texts


def tokenised(docs: DataFrame, tokenizer_path: str, size: int = SIZE, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, length, doc_tokens, ids (four little-endian bytes each): each document's ids and then the end's, cut every `size` ids.

    Null texts are empty: the end alone. The tokenizer's file is read on the driver and sent; its size does not depend on the documents.
    Long texts are encoded part by part, and nothing is shuffled."""
    ship(docs.sparkSession)
    with open(tokenizer_path, "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        import os

        import pyarrow as pa

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tok, tail = encoder(sent.value), end.to_bytes(4, "little")
        kinds = {"doc_id": pa.int64(), "start": pa.int64(), "length": pa.int64(), "doc_tokens": pa.int64(), "ids": pa.binary()}

        def flush():
            return pa.RecordBatch.from_pydict({k: pa.array([r[i] for r in out], t) for i, (k, t) in enumerate(kinds.items())})

        out, held = [], 0
        for docs, texts in groups(batches):
            short = [t for t in texts if len(t) <= PART]
            encoded = iter(tok.encode(short) if short else [])
            for doc, text in zip(docs, texts, strict=True):
                ids = (next(encoded) if len(text) <= PART else b"".join(tok.encode([p])[0] for p in parts_of(text, PART))) + tail
                for a in range(0, len(ids), 4 * size):
                    piece = ids[a : a + 4 * size]
                    out.append((doc, a // 4, len(piece) // 4, len(ids) // 4, piece))
                    held += len(piece) + 64
                    if held > FLUSH:
                        yield flush()
                        out, held = [], 0
        yield flush()

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, start long, length long, doc_tokens long, ids binary")


@dataclass
class Plan:
    """slots: (length, rank, n, sequence, offset): the pieces of a length from that rank on, one in each of n successive sequences.
    donors: (sequence, n, fill, place): sequences that are taken apart, whose tokens lie one after the other from that place on.
    gaps: (place, width, n, sequence, fill): what the tokens from that place on fill, n gaps of a width in successive sequences."""

    slots: list[tuple[int, int, int, int, int]] = field(default_factory=list)
    donors: list[tuple[int, int, int, int]] = field(default_factory=list)
    gaps: list[tuple[int, int, int, int, int]] = field(default_factory=list)
    sequences: int = 0


def plan(histogram: dict[int, int], size: int = SIZE) -> Plan:
    """Shortest pack first: lengths, longest first, each go to the packs with the most room; where it fits into none, new packs open
    with as many of it as they hold. Packs with equal contents are one pattern with a count, so the work depends on the number of
    lengths, not of pieces: every length opens two patterns and splits one at most.

    Then the emptiest packs are taken apart and their tokens, cut freely, fill the gaps of the others. What is left over, less than
    a sequence, goes to sequences of powers of two. So nothing needs padding.
    """
    p, packs, low = Plan(), [[] for _ in range(size + 1)], size
    for length in sorted((x for x, n in histogram.items() if n), reverse=True):
        rank, left = 0, histogram[length]
        while left:
            while low < size and not packs[low]:
                low += 1
            if low + length <= size and packs[low]:
                first, count = packs[low].pop()
                n = min(left, count)
                if n < count:
                    packs[low].append((first + n, count - n))
                p.slots.append((length, rank, n, first, low))
                packs[low + length].append((first, n))
                rank, left = rank + n, left - n
                continue
            each = min(left, size // length)
            n = left // each
            for i in range(each):
                p.slots.append((length, rank + i * n, n, p.sequences, i * length))
            packs[each * length].append((p.sequences, n))
            low = min(low, each * length)
            rank, left, p.sequences = rank + each * n, left - each * n, p.sequences + n
    open_ = [(fill, first, n) for fill in range(1, size) for first, n in sorted(packs[fill])]
    wanted, place, kept = -(-sum((size - fill) * n for fill, _, n in open_) // size), 0, []
    for fill, first, n in open_:
        take = min(n, wanted)
        if take:
            p.donors.append((first, take, fill, place))
            place, wanted = place + take * fill, wanted - take
        if take < n:
            kept.append((fill, first + take, n - take))
    given, place = place, 0
    for fill, first, n in kept:
        p.gaps.append((place, size - fill, n, first, fill))
        place += n * (size - fill)
    over = given - place
    for bit in range(size.bit_length(), -1, -1):
        if over >> bit & 1:
            p.gaps.append((place, 1 << bit, 1, p.sequences, 0))
            place, p.sequences = place + (1 << bit), p.sequences + 1
    return p


def cut(p: Plan, places: list[int], at: int, length: int) -> list[tuple[int, int, int, int]]:
    """The tokens from place `at` on: (start among them, length, sequence, offset) of each cut. places: where the gaps begin."""
    out, start = [], 0
    while start < length:
        first, width, _, sequence, fill = p.gaps[bisect_right(places, at + start) - 1]
        nth, off = divmod(at + start - first, width)
        n = min(length - start, width - off)
        out.append((start, n, sequence + nth, fill + off))
        start += n
    return out


def ranked(pieces: DataFrame) -> DataFrame:
    """pieces (piece, length) with rank: from 0, among those of its length. Numbered part by part, so that a length that many pieces
    have is no task's own; piece numbers say what part a row was written in."""
    rows = pieces.withColumn("part", F.shiftright("piece", 33))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = staged(rows.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")).select("length", "part", before.alias("before")), "pack-starts")
    within = F.row_number().over(Window.partitionBy("length", "part").orderBy("piece")) - 1
    return rows.withColumn("within", within).join(starts.hint("merge"), ["length", "part"]).select("piece", "length", (F.col("before") + F.col("within")).alias("rank"))


def pack(blocks: DataFrame, size: int = SIZE) -> DataFrame:
    """Packs blocks (doc_id, start, length up to size, doc_tokens, ids; see tokenised) into sequences of `size` ids.

    A row a piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids. Each id of a document is in one piece; a sequence's pieces follow each
    other without gaps from offset 0. All sequences are full but for a few whose lengths are powers of two. Blocks of full size
    are sequences already and are not moved. The driver sees the histogram (size numbers) and the plan made of it; its patterns, at most
    three a length, are broadcast, and its slots are joined with the pieces by length and rank. An empty table gives no rows.
    """
    spark = blocks.sparkSession
    ship(spark)
    blocks = staged(blocks.withColumn("piece", F.monotonically_increasing_id()), "pack-blocks")
    rest = blocks.where(F.col("length") < size)
    histogram = {r["length"]: r["n"] for r in rest.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a length
    p = plan(histogram, size)
    full = blocks.where(F.col("length") == size).select("doc_id", "start", "length", "doc_tokens", (F.col("piece") + p.sequences).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), "ids")
    if not p.slots:
        return full
    import pyarrow as pa

    slots = spark.createDataFrame(pa.table([pa.array(c, pa.int64()) for c in zip(*p.slots, strict=True)], names=["length", "rank", "n", "sequence_id", "offset"]))
    slots = slots.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(4096).cast("long")))).repartition(2 * partitions(spark), "length", "rank", "part")
    slots = slots.withColumn("i", F.explode(F.sequence(F.col("part"), F.least(F.col("part") + 4095, F.col("n") - 1)))).select("length", (F.col("rank") + F.col("i")).alias("rank"), (F.col("sequence_id") + F.col("i")).alias("sequence_id"), "offset")
    put = ranked(rest.select("piece", "length")).join(slots.hint("merge"), ["length", "rank"]).select("piece", "length", "sequence_id", "offset")
    sent = spark.sparkContext.broadcast(p)

    def freely(batches):
        import numpy as np

        p = sent.value
        places = [g[0] for g in p.gaps]
        donors = np.array(sorted(p.donors), dtype=np.int64).reshape(-1, 4)
        for batch in batches:
            length, sequence, offset = (np.asarray(batch.column(c)) for c in ("length", "sequence_id", "offset"))
            of = np.searchsorted(donors[:, 0], sequence, side="right") - 1
            given = np.zeros(len(length), dtype=bool)
            if len(donors):
                given = (of >= 0) & (sequence < donors[of, 0] + donors[of, 1])
            whole = np.flatnonzero(~given)
            rows, cuts = [whole], [np.stack([np.zeros(len(whole), dtype=np.int64), length[whole], sequence[whole], offset[whole]])]
            for i in np.flatnonzero(given):
                first, _, fill, place = donors[of[i]]
                c = cut(p, places, int(place + (sequence[i] - first) * fill + offset[i]), int(length[i]))
                rows.append(np.full(len(c), i))
                cuts.append(np.array(c, dtype=np.int64).T)
            rows, cuts = np.concatenate(rows), np.concatenate(cuts, axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("piece").take(pa.array(rows)), *[pa.array(c, pa.int64()) for c in cuts]], names=["piece", "cut", "length", "sequence_id", "offset"])

    cuts = put.mapInArrow(freely, "piece long, cut long, length long, sequence_id long, offset long")
    both = cuts.join(rest.drop("length").hint("merge"), "piece")
    return full.unionByName(both.select("doc_id", (F.col("start") + F.col("cut")).alias("start"), "length", "doc_tokens", "sequence_id", "offset", F.expr("substring(ids, cast(4 * cut + 1 as int), cast(4 * length as int))").alias("ids")))


def assembled(pieces: DataFrame) -> DataFrame:
    """sequence_id, n_tokens, ids: each sequence whole, in order; a sequence's size bounds its group."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    rows = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), parts.alias("parts"))
    return rows.select("sequence_id", "n_tokens", F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
