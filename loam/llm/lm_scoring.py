"""Language-model scores: the marginal likelihood of texts over all segmentations into subword pieces."""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm.common import id_bucket, partitions, release, ship, staged, text_of, unstage

#: Bytes of text in a block; the stop's weight among further pieces, as a share of theirs.
BLOCK, STOP = 8 << 20, 0.3
#: Rounds of re-estimation of the pieces' weights; what the vocabulary's own weights count beside the training words, in pieces.
ROUNDS, PRIOR = 2, 50.0
MARK = "▁"
#: Longest words that are worked off many at a time; bits of the table of pieces; the rolling hash's base.
VECTOR, TABLE, BASE, ALL = 40, 18, 0x100000001B3, (1 << 64) - 1
NEVER = float("-inf")


def read_pieces(path: str) -> dict[str, float]:
    """Pieces and scores of a vocabulary file of the sentencepiece library: those that have the word mark nowhere but at
    their start, and the 256 byte pieces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    out = {}
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) and MARK not in piece[1:]:
            out[piece] = sp.get_score(i)
    return out


def is_byte(piece: str) -> bool:
    return len(piece) == 6 and piece.startswith("<0x")


def byte_pieces(char: str) -> list[str]:
    return [f"<0x{b:02X}>" for b in char.encode("utf-8", "surrogateescape")]


def piece_weights(pieces: dict[str, float]) -> np.ndarray:
    """What the vocabulary's scores make a piece weigh, in the order of the names: exp(score) for log probabilities. Scores of a
    vocabulary of merges are 0, -1, -2, ..., minus the rank; a piece of rank r then weighs 1 / (r + 10), as words by rank do."""
    names = sorted(pieces)
    scores = np.array([pieces[p] for p in names])
    if len(scores) and scores.max() <= 0 and (scores == np.rint(scores)).all():
        return 1 / (10 - scores)
    return np.exp(scores)


def log_sum(x: list[float]) -> float:
    m = max(x, default=NEVER)
    return m if m == NEVER else m + math.log(sum([math.exp(y - m) for y in x]))


class Pieces:
    """The pieces of a vocabulary, and where they are found by the rolling hash of their characters."""

    def __init__(self, names: Iterable[str]):
        self.names = sorted(names)
        self.place = {p: i for i, p in enumerate(self.names)}
        self.marked = np.array([p.startswith(MARK) for p in self.names])
        self.longest = max((len(p) for p in self.names if not is_byte(p)), default=1)
        self.key_of = np.zeros(len(self.names), dtype=np.uint64)
        self.table = np.full((2, 1 << TABLE), -1, dtype=np.int32)
        self.spill = []
        for i, p in enumerate(self.names):
            if not is_byte(p):
                h = 0
                for c in p:
                    h = (h * BASE + ord(c)) & ALL
                self.key_of[i] = h
        slots = [self._slot(self.key_of, t) for t in (0, 1)]
        for i, p in enumerate(self.names):
            if not is_byte(p):
                t = next((t for t in (0, 1) if self.table[t, slots[t][i]] < 0), None)
                if t is None:
                    self.spill.append(i)
                else:
                    self.table[t, slots[t][i]] = i

    @staticmethod
    def _slot(h: np.ndarray, t: int) -> np.ndarray:
        return ((h * np.uint64((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)[t])) >> np.uint64(64 - TABLE)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Places of the pieces with these hashes; -1 if none."""
        at = self.table[0][self._slot(h, 0)]
        out = np.where(self.key_of[at] == h, at, -1).astype(np.int64)
        rest = np.flatnonzero((out < 0) & (at >= 0))
        if len(rest):
            own = h[rest]
            at = self.table[1][self._slot(own, 1)]
            out[rest] = np.where((at >= 0) & (self.key_of[at] == own), at, -1)
            for i in self.spill:
                out[rest[own == self.key_of[i]]] = i
        return np.where(out >= 0, out, -1)


class Speller:
    """p(word): the sum over all segmentations of the marked word into a first piece, which has the mark, further
    pieces, which don't, and a stop. Probabilities of first pieces sum to 1, as do those of further pieces with the
    stop. A character that is no piece is spelt by its bytes.

    weight: of each piece; stop: of the stop. Words of up to VECTOR characters, all of which are pieces, are worked off many at
    a time: substrings are found by rolling hashes in a table, and the recursions run over all words of a length at once.
    """

    def __init__(self, pieces: Pieces, weight: np.ndarray, stop: float):
        self.pieces, self.place, self.longest, self.find = pieces, pieces.place, pieces.longest, pieces.find
        marked = pieces.marked
        later = weight[~marked].sum() + stop
        self.score = np.where(marked, np.log(weight / weight[marked].sum()), np.log(weight / later))
        self.stop = math.log(stop / later)

    # Words one at a time.

    def arcs(self, text: str) -> list[tuple[int, int, list[int], float]]:
        """Begin, end, pieces and log probability of all arcs of a marked word, by begin and end."""
        n, out = len(text), []
        for b in range(n):
            single = False
            for e in range(b + 1, min(n, b + self.longest) + 1):
                if (i := self.place.get(text[b:e])) is not None and (b == 0 or text[b] != MARK) and not is_byte(text[b:e]):
                    single = single or e == b + 1
                    out.append((b, e, [i], float(self.score[i])))
            if not single:
                spelt = [self.place[x] for x in byte_pieces(text[b])]
                out.append((b, b + 1, spelt, float(self.score[spelt].sum())))
        return out

    def log_prob(self, word: str) -> float:
        """Forward recursion in log space."""
        text = MARK + word
        into: list[list[float]] = [[] for _ in range(len(text) + 1)]
        into[0].append(0.0)
        at, last = 0.0, 0
        for b, e, _, s in self.arcs(text):
            if b != last:
                at, last = log_sum(into[b]), b
            into[e].append(at + s)
        return log_sum(into[-1]) + self.stop

    # Many words at once.

    def _batches(self, words: list[str]):
        """Runs of words of one length, as (their places in words, characters); and the places of all other words."""
        lengths = np.array([len(w) for w in words])
        rest = [np.flatnonzero((lengths > VECTOR) | (lengths == 0))]
        for n in np.unique(lengths[(lengths <= VECTOR) & (lengths > 0)]):
            own = np.flatnonzero(lengths == n)
            for i in range(0, len(own), 8192):
                some = own[i : i + 8192]
                chars = np.frombuffer("".join([words[j] for j in some]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(len(some), n)
                known = (self.find(chars.astype(np.uint64).ravel()).reshape(chars.shape) >= 0).all(axis=1) & (chars != ord(MARK)).all(axis=1)
                rest.append(some[~known])
                if known.any():
                    yield some[known], np.concatenate([np.full((int(known.sum()), 1), ord(MARK), dtype=np.uint32), chars[known]], axis=1).T.astype(np.uint64)
        yield np.concatenate(rest), None

    def _found(self, chars: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
        """Places of the pieces by begin and end."""
        n, m = chars.shape
        found: dict[tuple[int, int], np.ndarray] = {}
        for b in range(n):
            h = np.zeros(m, dtype=np.uint64)
            for e in range(b + 1, min(n, b + self.longest) + 1):
                h = h * np.uint64(BASE) + chars[e - 1]
                at = self.find(h)
                if (at >= 0).any():
                    found[b, e] = at
        return found

    def _forward(self, chars: np.ndarray, found: dict[tuple[int, int], np.ndarray] | None = None) -> np.ndarray:
        """Log probability of all ways to each place of the marked words in the columns, without the stop."""
        n, m = chars.shape
        found = self._found(chars) if found is None else found
        score = np.append(self.score, NEVER)
        ahead = np.full((n + 1, m), NEVER)
        ahead[0] = 0
        for e in range(1, n + 1):
            ahead[e] = column_log_sum([ahead[b] + score[at] for (b, x), at in found.items() if x == e])
        return ahead

    def uses(self, words: list[str]) -> np.ndarray:
        """How often each piece is expected in these words, a stop in each: forward and backward recursion."""
        out = np.zeros(len(self.score) + 1)
        score = np.append(self.score, NEVER)
        for own, chars in self._batches(words):
            if chars is None:
                for i in own:
                    self._uses_of(MARK + words[i], out)
                continue
            n, m = chars.shape
            found = self._found(chars)
            ahead, behind = self._forward(chars, found), np.full((n + 1, m), NEVER)
            behind[n] = 0
            for b in range(n - 1, -1, -1):
                behind[b] = column_log_sum([score[at] + behind[e] for (x, e), at in found.items() if x == b] or [behind[b]])
            for (b, e), at in found.items():
                out += np.bincount(at % len(out), np.exp(ahead[b] + score[at] + behind[e] - ahead[n]), len(out))
        return out[:-1]

    def _uses_of(self, text: str, out: np.ndarray) -> None:
        arcs = self.arcs(text)
        into: list[list[float]] = [[] for _ in range(len(text) + 1)]
        into[0].append(0.0)
        ahead, behind = [NEVER] * (len(text) + 1), [NEVER] * (len(text) + 1)
        last = -1
        for b, e, _, s in arcs:
            if b != last:
                ahead[b], last = log_sum(into[b]), b
            into[e].append(ahead[b] + s)
        total = log_sum(into[-1])
        onward: list[list[float]] = [[] for _ in text] + [[0.0]]
        last = len(text)
        behind[last] = 0.0
        for b, e, at, s in reversed(arcs):
            if behind[e] == NEVER:
                behind[e] = log_sum(onward[e])
            onward[b].append(s + behind[e])
            for i in at:
                out[i] += math.exp(ahead[b] + s + behind[e] - total)

    def log_probs(self, words: list[str]) -> np.ndarray:
        out = np.empty(len(words))
        for own, chars in self._batches(words):
            if chars is None:
                for i in own:
                    out[i] = self.log_prob(words[i])
            else:
                out[own] = self._forward(chars)[-1] + self.stop
        return out


def column_log_sum(rows: list[np.ndarray]) -> np.ndarray:
    x = np.array(rows)
    m = x.max(axis=0)
    safe = np.where(np.isfinite(m), m, 0.0)
    with np.errstate(divide="ignore"):
        return safe + np.log(np.exp(x - safe).sum(axis=0))


def gathered(batches, rows: int = 100_000):
    """Arrow batches put together to about so many rows: words of one length are then enough for a vector."""
    import pyarrow as pa

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def decoded(word: bytes) -> str:
    return word.decode("utf-8", "surrogateescape")


def packed_terms(places: np.ndarray, counts: np.ndarray) -> bytes:
    """A document's words as gaps between rising places, and counts, each in as few bytes as all of them need."""
    gaps = np.diff(places, prepend=0)
    wide, large = int(gaps.max(initial=0) >= 1 << 16), int(counts.max(initial=0) >= 1 << 8)
    return bytes([2 * wide + large]) + gaps.astype("<u4" if wide else "<u2").tobytes() + counts.astype("<u4" if large else "u1").tobytes()


def terms_of(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Places and counts."""
    gap, count = np.dtype("<u4" if data[0] & 2 else "<u2"), np.dtype("<u4" if data[0] & 1 else "u1")
    n = (len(data) - 1) // (gap.itemsize + count.itemsize)
    return np.cumsum(np.frombuffer(data, gap, n, 1).astype(np.int64)), np.frombuffer(data, count, n, 1 + n * gap.itemsize).astype(np.int64)


def blocks_of(docs: DataFrame, folds: int, held: int, id_col: str, text_col: str) -> DataFrame:
    """A row for each run of documents of about BLOCK bytes: block, its different words and how often they are in its training documents, and its
    documents as places in that list with counts."""
    fold = F.coalesce(id_bucket(id_col, folds) == held, F.lit(False))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_of(text_col).alias("text"), fold.alias("held_out"))
    schema = "block string, words array<binary>, times array<long>, docs array<struct<doc_id:long,held_out:boolean,terms:binary>>"

    def run(batches):
        import uuid

        import pyarrow as pa

        doc = pa.struct([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("terms", pa.binary())])
        fields = pa.schema([("block", pa.string()), ("words", pa.list_(pa.binary())), ("times", pa.list_(pa.int64())), ("docs", pa.list_(doc))])
        index: dict[bytes, int] = {}
        held_rows, size, times = [], 0, np.zeros(1 << 16, dtype=np.int64)

        def block():
            return pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), pa.array([list(index)], pa.list_(pa.binary())), pa.array([times[: len(index)].tolist()], pa.list_(pa.int64())), pa.array([held_rows], pa.list_(doc))], schema=fields)

        for whole in batches:
            for i in range(0, whole.num_rows, 256):
                batch = whole.slice(i, 256)
                for doc_id, text, out in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "held_out")), strict=True):
                    data = text.encode()
                    place = [index.setdefault(w, len(index)) for w in data.lower().split()]
                    places, counts = np.unique(np.array(place, dtype=np.int32), return_counts=True)
                    if len(index) > len(times):
                        times = np.concatenate([times, np.zeros(len(index), dtype=np.int64)])
                    if not out:
                        times[places] += counts
                    held_rows.append({"doc_id": doc_id, "held_out": out, "terms": packed_terms(places, counts)})
                    size += len(data) + 64
                    if size >= BLOCK:
                        yield block()
                        index, held_rows, size = {}, [], 0
                        times = np.zeros(1 << 16, dtype=np.int64)
        if held_rows:
            yield block()

    return rows.mapInArrow(run, schema)


def fitted(counts: DataFrame, model, weight: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """The pieces' weights and the stop's, re-estimated by expectation maximisation from the different training words, each counted once, as
    the words that training hasn't seen are more like its rare ones. The vocabulary's weights start it, and count as PRIOR pieces
    after that, so that no piece is impossible. One number a piece goes to the driver."""
    marked = model.value.marked
    prior = np.where(marked, weight / max(weight[marked].sum(), 1e-300), weight / weight[~marked].sum() / (1 + STOP)) * PRIOR
    stop, words = STOP / (1 + STOP) * PRIOR, counts.where("c > 0").select("word")
    n, now = words.count(), (weight, STOP * weight[~marked].sum())
    for _ in range(rounds if n else 0):
        was = now

        def uses(batches, was=was):
            import pyarrow as pa

            s, out = Speller(model.value, *was), None
            for batch in gathered(batches):
                own = s.uses([decoded(w) for w in batch.column("word").to_pylist()])
                out = own if out is None else out + own
            if out is not None:
                some = np.flatnonzero(out)
                yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(out[some])], names=["piece", "n"])

        new = prior.copy()
        for r in words.mapInArrow(uses, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect():
            new[r["piece"]] += r["n"]
        now = new, n + stop
    return now


def score(docs: DataFrame, pieces_path: str, folds: int = 5, held: int = 1, id_col: str = "doc_id", text_col: str = "text", learned: bool = False) -> DataFrame:
    """log10 probability of every text: the sum over all segmentations of its words into pieces of an existing vocabulary.

    Tokens are the words of the A-Z lower-cased text and one end. Each token is the end with the probability that the texts
    whose fold isn't held out give it, (ends + 0.5) / (N + 1); otherwise it is a word, whose probability is that of all paths through
    the lattice of its pieces, by forward recursion in log space. The pieces' weights are the vocabulary's own scores (see
    piece_weights) and nothing else. Every string has a path, as characters that are no piece are spelt by bytes, and the probabilities
    of all tokens sum to 1.

    learned: the pieces' weights are re-estimated from the training words (see fitted), and each word of the training texts is one more arc
    over its whole lattice, with its share of the training words less a discount; what all discounts come to is the weight of
    the paths through pieces. The probabilities of all tokens still sum to 1.

    A row for each row of docs: doc_id, held_out, n_tokens, n_known (tokens seen in training), train_tokens, base_score
    (add-half unigrams of the words of all training texts), score. Null texts count as empty: one token, the end. Null ids are in no held-out
    fold. Without any training text all tokens are unknown, and the end has probability 1/2. Empty table: no rows.

    Words are counted block by block: each run of documents lists its different words once, these lists are summed by word, each
    different word is scored once, and the scores go back to the blocks. No list holds the words of all documents.
    """
    spark = docs.sparkSession
    ship(spark)
    blocks = staged(blocks_of(docs, folds, held, id_col, text_col), "blocks")
    listed = blocks.select("block", F.posexplode(F.arrays_zip("words", "times")).alias("place", "x")).select("block", "place", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
    counts = staged(listed.groupBy("word").agg(F.sum("times").alias("c")).repartition(2 * partitions(spark), "word"), "word-counts")
    release(spark)
    ends = blocks.select(F.explode("docs").alias("d")).agg(F.count(F.when(~F.col("d.held_out"), 1)).alias("n")).first()["n"]
    of = lambda i: F.count(F.when(F.col("c") == i, 1)).alias(f"n{i}")
    found = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.when(F.col("c") > 0, 1)).alias("v"), of(1), of(2)).first()
    total, types = found["n"] + ends, found["v"] + (ends > 0)
    end = (ends + 0.5) / (total + 1)

    vocabulary = read_pieces(pieces_path)
    model = spark.sparkContext.broadcast(Pieces(vocabulary))  # as long as the vocabulary file
    weight = piece_weights(vocabulary)
    stop = STOP * weight[~model.value.marked].sum()
    n_words = found["n"]
    off = found["n1"] / (found["n1"] + 2 * found["n2"]) if found["n1"] and found["n2"] else 0.5
    spelt = math.log(off * found["v"] / n_words) if learned and n_words else 0.0
    if learned:
        weight, stop = fitted(counts, model, weight)

    def spell(batches):
        import pyarrow as pa

        s = Speller(model.value, weight, stop)
        for batch in gathered(batches):
            p = s.log_probs([decoded(w) for w in batch.column("word").to_pylist()]) + spelt
            if learned and n_words:
                c = batch.column("c").to_numpy()
                with np.errstate(divide="ignore"):
                    p = np.logaddexp(p, np.log(np.maximum(c - off, 0) / n_words))
            p += math.log1p(-end)
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("c"), pa.array(p / math.log(10))], names=["word", "c", "p"])

    scored = staged(counts.mapInArrow(spell, "word binary, c long, p double"), "word-scores")
    unstage(counts)
    release(spark)
    back = listed.select("block", "place", "word").join(scored.hint("merge"), "word").groupBy("block").agg(F.collect_list(F.struct("place", "c", "p")).alias("words"))
    both = blocks.select("block", "docs").join(back.hint("merge"), "block", "left").select("docs", "words")
    base_of = lambda c: np.log10((c + 0.5) / (total + 0.5 * (types + 1)))
    end_score = math.log10(end)

    def sums(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                lists, rows = batch.column("words")[i], batch.column("docs")[i].as_py()
                if lists.is_valid:
                    place, c, p = (lists.values.field(k).to_numpy() for k in ("place", "c", "p"))
                    order = np.argsort(place)
                    c, p = c[order], p[order]
                else:
                    c, p = np.empty(0, np.int64), np.empty(0)
                base = base_of(c)
                out = {k: [] for k in ("doc_id", "held_out", "n_tokens", "n_known", "base_score", "score")}
                for d in rows:
                    at, n = terms_of(d["terms"])
                    out["doc_id"].append(d["doc_id"])
                    out["held_out"].append(d["held_out"])
                    out["n_tokens"].append(int(n.sum()) + 1)
                    out["n_known"].append(int(n[c[at] > 0].sum()) + (ends > 0))
                    out["base_score"].append(float(base[at] @ n + base_of(ends)))
                    out["score"].append(float(p[at] @ n + end_score))
                kinds = {"doc_id": pa.int64(), "held_out": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64()}
                yield pa.RecordBatch.from_pydict({k: pa.array(v, kinds.get(k, pa.float64())) for k, v in out.items()})

    out = both.mapInArrow(sums, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
