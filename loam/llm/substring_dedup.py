"""Substring dedup by paragraph MinHash banding, verified over whole passages."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loam.llm.common import identity, release, same, ship, staged, text_of, unstage
from loam.llm.grouping import components
from loam.llm.ngram_join import encoded, in_arrow, signed
from loam.llm.shingles import rolled, slices, words

#: Words of a paragraph, of a shingle that similarity is counted in, of a seed (a shingle that a paragraph's MinHash is taken of).
PARAGRAPH, SHINGLE, SEED = 24, 5, 12
PERCENT = 80


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """Least of each n neighbours, by doubling."""
    out, have = x, 1
    while 2 * have <= n:
        out = np.minimum(out[: len(out) - have], out[have:])
        have *= 2
    if have < n:
        out = np.minimum(out[: len(x) - n + 1], out[n - have : n - have + len(x) - n + 1])
    return out


def seeds(texts: list[bytes], words_in: int = PARAGRAPH):
    """Per text: first words of its seeds, their hashes, hashes of all its words, and its words' first bytes and ends.

    Prose often comes without blank lines, and passages are pasted into lines; so every run of words_in words is a paragraph. Its
    MinHash is the least hash of its SEED-word shingles; a text's seeds are the shingles that are a paragraph's least. Two
    texts that share words_in words in a row share a seed within them. Texts shorter than a paragraph have none.
    """
    n = words_in - SEED + 1
    for a, b in slices(texts):
        h, starts, ends, place = words(texts[a:b])
        grams = rolled(h, SEED)
        for lo, hi in zip(place[:-1].tolist(), place[1:].tolist(), strict=True):
            at = np.empty(0, np.int64)
            if hi - lo >= words_in:
                own, edge = grams[lo : hi - SEED + 1], np.zeros(n - 1, np.uint64)
                at = np.flatnonzero(own == ~sliding_min(~np.concatenate([edge, sliding_min(own, n), edge]), n))
            yield at, grams[lo + at], h[lo:hi], starts[lo:hi], ends[lo:hi]


def heads(docs: DataFrame, words_in: int) -> DataFrame:
    """doc_id, text_key, seeds of each document, without repeats."""

    def run(batches):
        import pyarrow as pa

        for batch in in_arrow(batches):
            lists = [signed(np.unique(x)) for _, x, *_ in seeds(encoded(batch), words_in)]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
            values = pa.array(np.concatenate(lists) if lists else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.ListArray.from_arrays(pa.array(ends), values)], names=["doc_id", "text_key", "seeds"])

    return docs.mapInArrow(run, "doc_id long, text_key long, seeds array<long>")


def banded(docs: DataFrame, offsets: list[int], width: int, words_in: int) -> DataFrame:
    """The bands of documents (doc_id, text_key, text, and seeds that others have too or places): hashes of the runs of width
    words that begin at these offsets from a shared seed, or from a place. doc_id, text_key, band, word."""
    by_place = "places" in docs.columns

    def run(batches):
        import pyarrow as pa

        for batch in in_arrow(batches, 128):
            row, bands, at = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            asked = batch.column("places" if by_place else "seeds")
            for i, (places, own, h, *_) in enumerate(seeds(encoded(batch), words_in)):
                want = np.sort(asked[i].values.to_numpy())
                if by_place:
                    places = want
                else:
                    own = signed(own)
                    places = places[want[np.minimum(np.searchsorted(want, own), len(want) - 1)] == own]
                first = np.unique(places[:, None] + np.array(offsets))
                first = first[(first >= 0) & (first <= len(h) - width)]
                row.append(np.full(len(first), i))
                bands.append(signed(rolled(h, width)[first]))
                at.append(first)
            row, bands, at = (np.concatenate(x) for x in (row, bands, at))
            row = pa.array(row)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(row), batch.column("text_key").take(row), pa.array(bands), pa.array(at, pa.int32())], names=["doc_id", "text_key", "band", "word"])

    return docs.mapInArrow(run, "doc_id long, text_key long, band long, word int")


def _next(u: list[int], v: list[int], i: int, j: int, most: int) -> tuple[int, int] | None:
    """How far behind i in u and j in v the nearest equal values are (least sum, then least in u), each less than most."""
    if most > 3 and i + 3 < len(u) and j + 3 < len(v):  # a replaced, added or lost word
        a, b, c, d, e, f = u[i], v[j], u[i + 1], v[j + 1], u[i + 2], v[j + 2]
        if a == d:
            return 0, 1
        if c == b:
            return 1, 0
        if a == f:
            return 0, 2
        if c == d:
            return 1, 1
        if e == b:
            return 2, 0
    size, whole = 16, min(most, max(len(u) - i, len(v) - j))
    while True:
        first: dict[int, int] = {}
        for n, b in enumerate(v[j : j + min(size, most)]):
            first.setdefault(b, n)
        best, far = None, 2 * size
        for n, a in enumerate(u[i : i + min(size, most)]):
            if n >= far:
                break
            if (m := first.get(a)) is not None and n + m < far:
                best, far = (n, m), n + m
        if best is not None or size >= whole:
            return best
        size *= 8


def equal_run(x: list[int], y: list[int], i: int, j: int) -> int:
    """How many words from i in x and j in y on are equal."""
    n, t, step = min(len(x) - i, len(y) - j), 0, 8
    while step and t < n:
        if x[i + t : i + t + step] == y[j + t : j + t + step]:
            t, step = t + step, 2 * step
        else:
            step //= 2
    return min(t, n)


def chain(x: list[int], y: list[int], gx: list[int], gy: list[int], i: int, j: int, limit: int, known: dict) -> np.ndarray:
    """Runs of equal words (place in x, in y, length) from words i and j on: the first begins there, each further one at the next
    shingle in common, as long as no more than limit words are skipped. known: what follows the ends of runs, for further calls."""
    t, skipped = equal_run(x, y, i, j), 0
    out = [(i, j, t)]
    while True:
        i, j = i + t, j + t
        if (i, j) not in known:
            near = _next(gx, gy, i, j, limit + 1)
            known[i, j] = near and (*near, equal_run(x, y, i + near[0], j + near[1]))
        if (step := known[i, j]) is None or (skipped := skipped + max(step[:2])) > limit:
            return np.array(out, dtype=np.int64)
        i, j, t = i + step[0], j + step[1], step[2]
        out.append((i, j, t))


def passages(x: np.ndarray, y: np.ndarray, pairs: list[tuple[int, int]], percent: int, words_in: int, k: int):
    """Spans (first word and end in x, in y) of at least words_in words, and the pairs that are in none.

    x and y: hashes of words; pairs: places in x and y where equal runs of words begin. From each, equal runs are chained in both
    directions across edits, and the longest joined span counts whose k-word shingles are similar by percent: aligned ones,
    100 * common >= percent * (all of x's span + all of y's span - common). Places of one run of equal words have one chain.
    """
    forth = [a.tolist() for a in (x, y, rolled(x, k), rolled(y, k))]
    back = [a[::-1] for a in forth]
    limit = min(len(x), len(y)) * (100 - percent) // percent + k
    spans, alone, tried, after, before = [], [], {}, {}, {}
    for i, j in sorted(pairs):
        if any(a <= i and i + SEED <= b for a, b, _, _ in spans):
            continue
        if i < tried.get(i - j, 0):
            alone.append((i, j))
            continue
        right = chain(*forth, i, j, limit, after)
        left = chain(*back, len(x) - i, len(y) - j, limit, before)
        a, a2 = len(x) - left[:, 0] - left[:, 2], len(y) - left[:, 1] - left[:, 2]
        b, b2 = right[:, 0] + right[:, 2], right[:, 1] + right[:, 2]
        # The runs at the start are one; any other has its own shingles.
        more_l, more_r = (np.cumsum(np.where(np.arange(len(c)) > 0, c[:, 2] - k + 1, 0)) for c in (left, right))
        common = left[0, 2] + right[0, 2] - k + 1 + more_l[:, None] + more_r
        in_x, in_y = b - a[:, None], b2 - a2[:, None]
        ok = (100 * common >= percent * (in_x + in_y - 2 * (k - 1) - common)) & (np.minimum(in_x, in_y) >= words_in)
        if ok.any():
            m, n = np.unravel_index(np.argmax(np.where(ok, common, -1)), ok.shape)
            spans.append((int(a[m]), int(b[n]), int(a2[m]), int(b2[n])))
        else:
            alone.append((i, j))
            tried[i - j] = i + int(right[0, 2])
    return spans, alone


def verified(pairs: DataFrame, percent: int, words_in: int, k: int) -> DataFrame:
    """pairs: document d (doc_id, text_key, text), f (the same), places (word, f_word, band). A row for each span that d shares with f:
    both names, word, upto, start, end in each; and one for each place in none: both names, band."""
    sides = ["word", "upto", "start", "end"]
    cols = ["d_doc", "d_key", "f_doc", "f_key"]
    schema = ", ".join([f"{c} long" for c in cols] + [f"{p}_{c} int" for p in "df" for c in sides] + ["band long"])

    def run(batches):
        import pyarrow as pa

        kinds = pa.schema([(c, pa.int64()) for c in cols] + [(f"{p}_{c}", pa.int32()) for p in "df" for c in sides] + [("band", pa.int64())])
        for batch in in_arrow(batches, 64):
            row, out = [], []
            split = []
            for name in ("d_text", "f_text"):
                split.append([v for texts in [encoded(batch, name)] for a, b in slices(texts) for v in _split(texts[a:b])])
            for i, (places, (x, *xs), (y, *ys)) in enumerate(zip(batch.column("places"), *split, strict=True)):
                at = places.values
                band = dict(zip(zip(*(at.field(c).to_pylist() for c in ("word", "f_word")), strict=True), at.field("band").to_pylist(), strict=True))
                spans, alone = passages(x, y, list(band), percent, words_in, k)
                for a, b, a2, b2 in spans:
                    row.append(i)
                    out.append((a, b, int(xs[0][a]), int(xs[1][b - 1]), a2, b2, int(ys[0][a2]), int(ys[1][b2 - 1]), None))
                for place in alone:
                    row.append(i)
                    out.append((None,) * 8 + (band[place],))
            row = pa.array(row, pa.int64())
            values = list(zip(*out, strict=True)) or [()] * 9
            yield pa.RecordBatch.from_arrays([batch.column(c).take(row) for c in cols] + [pa.array(v, f.type) for v, f in zip(values, list(kinds)[4:], strict=True)], schema=kinds)

    return pairs.mapInArrow(run, schema)


def _split(texts: list[bytes]):
    h, starts, ends, place = words(texts)
    for lo, hi in zip(place[:-1].tolist(), place[1:].tolist(), strict=True):
        yield h[lo:hi], starts[lo:hi], ends[lo:hi]


def repeated_passages(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", words_in: int = PARAGRAPH, k: int = SHINGLE) -> DataFrame:
    """Passages that another document has too, alike or nearly.

    Every run of words_in words is a paragraph, its MinHash a seed (see seeds). Seeds that several documents have get two bands, the 18
    words that begin or end six words outside of them; two documents with the same words_in words around a seed share one. Each document is
    held against the first one (smallest id) that has the band: from there equal words are extended to both sides, across edits, to the
    longest joined span whose k-word shingles have a Jaccard similarity of percent / 100, counted by aligned places. Where that
    makes no passage of words_in words, the documents of the band meet again by all their runs of words_in words in it. So any two documents
    that share words_in words in a row are found, and so is a passage that is similar by percent, if at 0.8 its edits are replaced words (at most
    one in 45, which leaves such a run); one of 24 or 25 words of which the second or last but one is replaced, or of 44 to 48 with a word
    inserted in the middle, may be left with runs of 22 and be missed. A passage begins and ends with equal words; what has fewer than
    words_in from the first to the last of them, such as 24 words of which the last is replaced, is none.

    In a span that is shared with an earlier document all words are to go, so that by induction the first occurrence stays. Spans with the same
    decision that overlap or touch are one; spans that stay are listed unless they lie within one that goes. Linked spans are clusters by
    connected components: a span that goes is linked with the one it was first held against.

    A row for each span: doc_id, start, end (bytes of the UTF-8 text), n_words (at least words_in), removed, cluster (id of the first document
    of its cluster, its own for a span that stays), text_key. Documents without repeats have no
    row. Null, empty and shorter texts have none either. Rows that repeat id and text are one document; rows with a null id
    come last in the choice of what stays, and so does, among rows that share an id, the larger text_key. Empty table: no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    text = text_of(text_col)
    rows = docs.select(*identity(id_col, text), text.alias("text"))
    known = staged(heads(rows, words_in).where(F.size("seeds") > 0), "heads")
    flat = known.select("doc_id", "text_key", F.explode("seeds").alias("seed"))
    whose = F.xxhash64("doc_id", "text_key")
    shared = staged(flat.groupBy("seed").agg(F.min(whose).alias("a"), F.max(whose).alias("b")).where("a <> b").select("seed"), "shared-seeds")
    hits = flat.join(shared.hint("merge"), "seed").groupBy("doc_id", "text_key").agg(F.collect_set("seed").alias("seeds")).select(F.col("doc_id").alias("k_doc"), F.col("text_key").alias("k_text"), "seeds")
    hits = staged(hits, "hits")
    unstage(known, shared)
    release(spark)

    def of_texts(keyed: DataFrame, *cols: str) -> DataFrame:
        return rows.join(keyed.hint("merge"), rows["doc_id"].eqNullSafe(keyed["k_doc"]) & (rows["text_key"] == keyed["k_text"])).select("doc_id", "text_key", "text", *cols)

    def matched(found: DataFrame) -> DataFrame:
        """Each document of a band against its first one."""
        # Written first, so that both sides of the join come from exchanges: only then does Spark split a hot band.
        first = found.groupBy("band").agg(F.min(F.struct(_rank().alias("r"), "word")).alias("f"), F.max(_rank()).alias("last")).where("f.r <> last").select("band", "f")
        first = staged(first, "first-of-band")
        place = F.struct("word", F.col("f.word").alias("f_word"), "band")
        pairs = found.join(first.hint("merge"), "band").where(_rank() != F.col("f.r")).groupBy("doc_id", "text_key", F.col("f.r.doc_id").alias("f_doc"), F.col("f.r.text_key").alias("f_key")).agg(F.collect_set(place).alias("places"))
        pairs = staged(pairs.withColumnsRenamed({"doc_id": "k_doc", "text_key": "k_text"}), "pairs")
        unstage(first)
        release(spark)
        one = of_texts(pairs, "f_doc", "f_key", "places").select(F.col("doc_id").alias("d_doc"), F.col("text_key").alias("d_key"), F.col("text").alias("d_text"), F.col("f_doc").alias("k_doc"), F.col("f_key").alias("k_text"), "places")
        both = of_texts(one, "d_doc", "d_key", "d_text", "places").withColumnsRenamed({"doc_id": "f_doc", "text_key": "f_key", "text": "f_text"})
        out = staged(verified(both, percent, words_in, k), "matches")
        unstage(pairs)
        release(spark)
        return out

    side = (words_in - SEED) // 2
    width = words_in - side
    found = staged(banded(of_texts(hits, "seeds"), [-side, 0], width, words_in), "bands")
    unstage(hits)
    release(spark)
    matches = matched(found)
    again = staged(matches.where("band is not null").select("band").distinct(), "bands-again")
    places = found.join(again.hint("merge"), "band", "left_semi").groupBy(F.col("doc_id").alias("k_doc"), F.col("text_key").alias("k_text")).agg(F.collect_set(F.col("word").cast("long")).alias("places"))
    wide = staged(banded(of_texts(staged(places, "places"), "places"), list(range(-side, 1)), words_in, words_in), "wide-bands")
    unstage(found)
    matches = matches.unionByName(matched(wide)).where("band is null").withColumns({"d": F.xxhash64("d_doc", "d_key"), "f": F.xxhash64("f_doc", "f_key")})

    def ends(p: str, *cols) -> DataFrame:
        return matches.select(F.col(p).alias("doc"), F.col(f"{p}_doc").alias("doc_id"), F.col(f"{p}_key").alias("text_key"), *[F.col(f"{p}_{c}").alias(c) for c in ("word", "upto", "start", "end")], *cols).distinct()

    def joined(spans: DataFrame) -> DataFrame:
        """spans with run: the same for those of a document that overlap or touch."""
        doc = Window.partitionBy("doc").orderBy("word", "upto")
        reached = F.max("upto").over(doc.rowsBetween(Window.unboundedPreceding, -1))
        return spans.withColumn("new", F.when(reached >= F.col("word"), 0).otherwise(1)).withColumn("run", F.sum("new").over(doc)).drop("new")

    goes, stays = ends("d").withColumn("removed", F.lit(True)), ends("f").withColumn("removed", F.lit(False))
    nodes = joined(goes.drop("removed").unionByName(stays.drop("removed")).distinct())
    nodes = staged(nodes.withColumn("node", F.xxhash64("doc", "run")).drop("run"), "nodes")
    spot = ["doc", "word", "upto"]
    from_first = matches.select(F.col("d").alias("doc"), F.col("d_word").alias("word"), F.col("d_upto").alias("upto"), F.struct(F.col("d_word"), F.col("f_doc").isNull(), F.col("f_doc"), F.col("f_key"), F.col("f"), F.col("f_word"), F.col("f_upto")).alias("x"))
    parent = from_first.join(nodes.select(*spot, "node").hint("merge"), spot).groupBy("node").agg(F.min("x").alias("x")).select(F.col("node").alias("u"), F.col("x.f").alias("doc"), F.col("x.f_word").alias("word"), F.col("x.f_upto").alias("upto"))
    links = staged(parent.join(nodes.select(*spot, F.col("node").alias("v")).hint("merge"), spot).select("u", "v"), "links")
    labels = staged(components(links), "labels")
    firsts = staged(nodes.join(labels.hint("merge"), "node").groupBy("component").agg(F.min(_rank()).alias("first")), "firsts")
    cluster = labels.join(firsts.hint("merge"), "component").select("node", F.col("first.doc_id").alias("cluster"))

    def merged(spans: DataFrame) -> DataFrame:
        return joined(spans).groupBy("doc", "doc_id", "text_key", "removed", "run").agg(F.min("word").alias("word"), F.max("upto").alias("upto"), F.min("start").alias("start"), F.max("end").alias("end"))

    starts = nodes.groupBy("doc", "word").agg(F.min("node").alias("node")).join(cluster.hint("merge"), "node").select("doc", "word", "cluster")
    gone = merged(goes).join(starts.hint("merge"), ["doc", "word"])
    runs = gone.unionByName(merged(stays).withColumn("cluster", F.col("doc_id")))
    runs = runs.groupBy("doc", "doc_id", "text_key").agg(F.collect_list(F.struct("removed", "word", "upto", "start", "end", "cluster")).alias("all"))
    listed = F.filter("all", lambda x: x["removed"] | ~F.exists("all", lambda y: y["removed"] & (y["word"] <= x["word"]) & (y["upto"] >= x["upto"])))
    out = runs.select("doc_id", "text_key", F.explode(listed).alias("x"))
    return out.select("doc_id", "x.start", "x.end", (F.col("x.upto") - F.col("x.word")).cast("long").alias("n_words"), "x.removed", "x.cluster", "text_key")


def _rank():
    """A document's place in the choice of what stays."""
    return F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("text_key"))


def cut_passages(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the spans that repeated_passages removes; other columns, and null texts, as they were."""
    found = repeated_passages(docs, percent, id_col, text_col).where("removed")
    gone = staged(found.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("gone")), "spans")
    keys = identity(id_col, text_of(text_col))
    row = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), *keys)
    both = row.join(gone.hint("merge"), same(row, gone, "doc_id", "text_key"), "left")
    data = F.encode(F.col("row").getField(text_col), "UTF-8")
    pieces = F.transform(F.sequence(F.lit(0), F.size("gone")), lambda i: F.substring(data, F.when(i == 0, 1).otherwise(F.get("gone", i - 1)["end"] + 1), F.coalesce(F.get("gone", i)["start"], F.octet_length(data)) - F.when(i == 0, 0).otherwise(F.get("gone", i - 1)["end"])))
    text = F.when(F.col("gone").isNull(), F.col("row").getField(text_col)).otherwise(F.decode(F.aggregate(pieces, F.encode(F.lit(""), "UTF-8"), lambda a, x: F.concat(a, x)), "UTF-8"))
    return both.select(*[(text if c == text_col else F.col("row").getField(c)).alias(c) for c in docs.columns])
