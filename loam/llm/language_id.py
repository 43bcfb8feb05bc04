"""Language identification by a bidirectional gated recurrent network over bytes."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm.common import id_bucket, ship, text_of

UNKNOWN = "und"
#: Units of each direction; bytes of a window; the byte value that fills windows.
UNITS, SPAN, FILL = 12, 128, 256
#: The training sample: windows of each language at most (on average), windows of one document at most.
SAMPLE, PER_DOC = 3000, 24
STEPS, BATCH, RATE = 400, 192, 0.03
LETTER = regex.compile(r"\p{L}")
LETTERS = re.compile(r"[^\W\d_]+")
#: Bytes of letters that evidence tells apart; positions of clean text that each text starts with; weight of shorter contexts.
CLASSES, GIVEN, BACKOFF = 63, 8, 4.0


@dataclass
class Evidence:
    """For each language, what a letter is worth after the two before it: the logarithm of its probability there over that of the
    letter alone. usual: its median in windows of the language. bound: halfway between that and the median of windows whose words were shuffled."""

    classes: np.ndarray
    worth: dict[str, np.ndarray]
    usual: dict[str, float]
    bound: dict[str, float]

    def codes(self, text: str) -> np.ndarray:
        """The classes of the bytes of a text's letters, in lower case; what lies between words is one space."""
        return self.classes[np.frombuffer(f" {' '.join(LETTERS.findall(text.lower()))} ".encode(), dtype=np.uint8)]

    def of(self, text: str, lang: str) -> float:
        """The mean over a text's letters of what they are worth. Few letters prove little: GIVEN usual ones are counted in."""
        k, c, table = int(self.classes.max()) + 1, self.codes(text), self.worth[lang]
        total = GIVEN * self.usual.get(lang, 0.0)
        for a in range(0, len(c) - 2, 1 << 20):
            part = c[a : a + (1 << 20) + 2]
            total += float(table[part[:-2] * k * k + part[1:-1] * k + part[2:]].sum(dtype=np.float64))
        return total / (GIVEN + max(0, len(c) - 2))


def weigh(windows: list[tuple[str, int, str]], seed: int = 7) -> Evidence:
    """Evidence from windows (language, number of the document, text): counts from the documents of even number, bounds from the
    others and from their shuffled words (from all, where a language has documents of one kind only). The sample bounds the work."""
    r = np.random.default_rng(seed)
    seen = np.zeros(256, dtype=np.int64)
    out = Evidence(np.arange(256), {}, {}, {})
    for _, _, text in windows:
        seen += np.bincount(out.codes(text), minlength=256)
    top = [b for b in np.argsort(-seen, kind="stable")[:CLASSES] if seen[b]]
    out.classes = np.zeros(256, dtype=np.int64)
    out.classes[top] = np.arange(1, len(top) + 1)
    k = len(top) + 1
    by_lang: dict[str, tuple[list[str], list[str]]] = {}
    for lang, doc, text in windows:
        by_lang.setdefault(lang, ([], []))[doc % 2].append(text)
    for lang, (even, odd) in by_lang.items():
        n3 = np.zeros(k**3)
        for text in even or odd:
            c = out.codes(text)
            n3 += np.bincount(c[:-2] * k * k + c[1:-1] * k + c[2:], minlength=k**3) if len(c) > 2 else 0
        n3 = n3.reshape(k, k, k)
        n2 = n3.sum(axis=0)
        n1 = n2.sum(axis=0)
        alone = (n1 + 0.5) / (n1.sum() + 0.5 * k)
        after_one = (n2 + BACKOFF * alone) / (n2.sum(axis=1, keepdims=True) + BACKOFF)
        after_two = (n3 + BACKOFF * after_one) / (n3.sum(axis=2, keepdims=True) + BACKOFF)
        out.worth[lang] = (np.log(after_two) - np.log(alone)).astype(np.float32).reshape(-1)
    for lang, (even, odd) in by_lang.items():
        clean = [t for t in odd or even if LETTERS.search(t)]
        shuffled = [LETTERS.sub(lambda m: "".join(r.permutation(list(m[0].lower()))), t) for t in clean]
        good = float(np.median([out.of(t, lang) for t in clean])) if clean else 0.0
        bad = float(np.median([max(out.of(t, x) for x in out.worth) for t in shuffled])) if clean else 0.0
        out.usual[lang], out.bound[lang] = good, (good + bad) / 2
    return out


@dataclass
class Model:
    """Per direction: inputs (3 units x 257 byte values), recurrent (3 units x units) and its bias; read-out of both.
    Rows of a matrix go update, reset, candidate. Input rows and biases of update and reset hold half of the usual value's
    argument, as sigmoid(x) = (1 + tanh(x / 2)) / 2. letters: those of the training sample, in lower case; evidence: learned from
    the same sample, see keep_identified."""

    langs: list[str]
    weights: dict[str, np.ndarray]
    letters: frozenset[str] = frozenset()
    evidence: Evidence | None = None


def fresh(n_langs: int, units: int, seed: int) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    w = {}
    for d in "fb":
        w[f"x{d}"] = r.normal(0, 0.3, (3 * units, 257)).astype(np.float32)
        w[f"u{d}"] = r.normal(0, 0.5 / np.sqrt(units), (3 * units, units)).astype(np.float32)
        w[f"c{d}"] = np.zeros((3 * units, 1), np.float32)
        w[f"v{d}"] = r.normal(0, 0.3, (n_langs, units)).astype(np.float32)
    w["o"] = np.zeros((n_langs, 1), np.float32)
    return w


def step(w, d: str, codes: np.ndarray, h: np.ndarray):
    """One position for all windows: gates, candidate and new state. Where the window is filled the state stays."""
    n = h.shape[0]
    a = np.take(w[f"x{d}"], codes, axis=1)
    u = w[f"u{d}"] @ h
    u += w[f"c{d}"]
    g = a[: 2 * n]
    g += u[: 2 * n]
    np.tanh(g, out=g)
    g += 1
    g *= 0.5
    c = g[n:] * u[2 * n :]
    c += a[2 * n :]
    np.tanh(c, out=c)
    new = h - c
    new *= g[:n]
    new += c
    return g, u[2 * n :], c, new


def softmax(x: np.ndarray) -> np.ndarray:
    x -= x.max(axis=0)
    np.exp(x, out=x)
    x /= x.sum(axis=0)
    return x


def positions(w: dict[str, np.ndarray], codes: np.ndarray):
    """Probabilities (languages x windows) of every position, last first; codes: positions x windows."""
    span, n = codes.shape
    units = w["uf"].shape[1]
    h, ahead = np.zeros((units, n), np.float32), np.empty((span, units, n), np.float32)
    for t in range(span):
        h = step(w, "f", codes[t], h)[3]
        ahead[t] = h
    h = np.zeros((units, n), np.float32)
    for t in range(span - 1, -1, -1):
        h = step(w, "b", codes[t], h)[3]
        yield t, softmax(w["vf"] @ ahead[t] + w["vb"] @ h + w["o"])


def gradients(w: dict[str, np.ndarray], codes: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross-entropy over all positions that hold bytes, and its gradient by backpropagation through time."""
    span, n = codes.shape
    units = w["uf"].shape[1]
    valid = (codes != FILL).astype(np.float32)
    g = {k: np.zeros_like(v) for k, v in w.items()}
    kept, states = {}, {}
    for d, order in (("f", range(span)), ("b", range(span - 1, -1, -1))):
        h = np.zeros((units, n), np.float32)
        for t in order:
            gate, un, c, new = step(w, d, codes[t], h)
            kept[d, t] = (h, gate, un, c)
            states[d, t] = h = np.where(valid[t] > 0, new, h)
    total, loss, into = max(1.0, float(valid.sum())), 0.0, {}
    for t in range(span):
        p = softmax(w["vf"] @ states["f", t] + w["vb"] @ states["b", t] + w["o"])
        loss -= float((np.log(p[labels, np.arange(n)] + 1e-9) * valid[t]).sum()) / total
        p[labels, np.arange(n)] -= 1
        p *= valid[t] / total
        g["o"] += p.sum(axis=1, keepdims=True)
        for d in "fb":
            g[f"v{d}"] += p @ states[d, t].T
            into[d, t] = w[f"v{d}"].T @ p
    for d, order in (("f", range(span - 1, -1, -1)), ("b", range(span))):
        back = np.zeros((units, n), np.float32)
        inputs = np.zeros((span, 3 * units, n), np.float32)
        for t in order:
            h, gate, un, c = kept[d, t]
            all_in = back + into[d, t]
            dh = all_in * valid[t]
            z, r = gate[:units], gate[units:]
            dc = dh * (1 - z) * (1 - c * c)
            # sigmoid's argument was doubled away: d tanh(x) form
            dz = dh * (h - c) * 2 * z * (1 - z)
            dr = dc * un * 2 * r * (1 - r)
            du = np.concatenate([dz, dr, dc * r])
            inputs[t] = np.concatenate([dz, dr, dc])
            g[f"u{d}"] += du @ h.T
            g[f"c{d}"] += du.sum(axis=1, keepdims=True)
            back = w[f"u{d}"].T @ du + dh * z + all_in * (1 - valid[t])
        flat = inputs.transpose(1, 0, 2).reshape(3 * units, -1)
        for row, out in zip(flat, g[f"x{d}"], strict=True):
            out += np.bincount(codes.reshape(-1), weights=row, minlength=257)
    return loss, g


def train(texts: list[bytes], labels: list[str], units: int = UNITS, steps: int = STEPS, batch: int = BATCH, rate: float = RATE, seed: int = 7) -> Model:
    """Adam over batches with as many windows of each language on average. The same sample gives the same model."""
    langs = sorted(set(labels))
    w = fresh(len(langs), units, seed)
    codes = windows_of(texts, SPAN)[0]
    y = np.array([langs.index(x) for x in labels])
    r = np.random.default_rng(seed)
    chance = 1 / np.bincount(y, minlength=len(langs))[y]
    chance /= chance.sum()
    m, v = {k: np.zeros_like(x) for k, x in w.items()}, {k: np.zeros_like(x) for k, x in w.items()}
    for i in range(1, steps + 1):
        pick = r.choice(len(y), batch, p=chance)
        _, g = gradients(w, codes[:, pick], y[pick])
        now = rate * min(1.0, 2 * (1 - i / (steps + 1)))
        norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
        for k in w:
            x = g[k] * min(1.0, 1 / (norm + 1e-9))
            m[k] = 0.9 * m[k] + 0.1 * x
            v[k] = 0.99 * v[k] + 0.01 * x * x
            w[k] -= (now * (m[k] / (1 - 0.9**i)) / (np.sqrt(v[k] / (1 - 0.99**i)) + 1e-8)).astype(np.float32)
    for d in "fb":  # a filled position: the update gate keeps the state
        w[f"x{d}"][:units, FILL] = 30
    return Model(langs, w)


def windows_of(texts: list[bytes], span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all texts in windows (positions x windows, FILL after a text's end), each window's text and bytes."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    counts = -(-sizes // span)
    owner = np.repeat(np.arange(len(texts)), counts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    filled = np.minimum(span, sizes[owner] - nth * span)
    out = np.full((len(owner), span), FILL, dtype=np.int64)
    out[np.arange(span) < filled[:, None]] = np.frombuffer(b"".join(texts), dtype=np.uint8)
    return np.ascontiguousarray(out.T), owner, filled


def document_probabilities(model: Model, texts: list[bytes], most: int = 4096) -> np.ndarray:
    """Mean over all positions of each text of the positions' probabilities (texts x languages). Windows are worked off
    at most so many at a time, also those of one very long text."""
    span_sums = np.zeros((len(texts), len(model.langs)))
    start = 0
    while start < len(texts):
        stop, held = start, 0
        while stop < len(texts) and (held == 0 or held + -(-len(texts[stop]) // SPAN) <= most):
            held += -(-len(texts[stop]) // SPAN)
            stop += 1
        codes, owner, filled = windows_of(texts[start:stop], SPAN)
        for a in range(0, len(owner), most):
            part, fill = codes[:, a : a + most], filled[a : a + most]
            acc = np.zeros((len(model.langs), part.shape[1]))
            for t, p in positions(model.weights, part):
                acc += p * (fill > t)
            for j in range(len(model.langs)):
                span_sums[start:stop, j] += np.bincount(owner[a : a + most], weights=acc[j], minlength=stop - start)
        start = stop
    sizes = np.array([max(1, len(t)) for t in texts])
    return span_sums / sizes[:, None]


def label_positions(model: Model, text: str) -> list[str]:
    """The label of every byte of a text."""
    codes, _, filled = windows_of([text.encode()], SPAN)
    best = np.zeros(codes.shape, dtype=np.int64)
    for t, p in positions(model.weights, codes):
        best[t] = p.argmax(axis=0)
    return [model.langs[best[t, i]] for i in range(codes.shape[1]) for t in range(filled[i])]


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, folds: int = 4, held: int = 2) -> Model | None:
    """A model of the languages of the rows whose fold isn't held out; None if no such row has text and language.

    It learns from a sample of bounded size: about `sample` windows of SPAN bytes for each language, at hashed places in
    hashed documents (up to PER_DOC windows of one where documents are few). Which documents depends on hashes of
    their ids alone, so reruns agree.
    """
    fold = F.coalesce(id_bucket(id_col, folds), F.lit(-1))
    lang = F.col(f"`{lang_col}`").cast("string")
    rows = docs.select(F.xxhash64(F.col(f"`{id_col}`")).alias("h"), text_of(text_col).alias("text"), lang.alias("lang"), fold.alias("fold")).where(f"fold <> {held} and lang is not null").where(F.length("text") > 0)
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a language
    if not counts:
        return None
    each = {k: max(1, min(PER_DOC, -(-sample // n))) for k, n in counts.items()}
    share = {k: min(1.0, sample / (n * each[k])) for k, n in counts.items()}
    as_map = lambda x: F.create_map(*[F.lit(y) for kv in x.items() for y in kv])
    wanted = F.pmod(F.col("h"), F.lit(1 << 20)) < F.element_at(as_map(share), F.col("lang")) * (1 << 20)
    nth = F.explode(F.sequence(F.lit(1), F.element_at(as_map(each), F.col("lang"))))
    at = F.pmod(F.xxhash64("h", "nth"), F.greatest(F.lit(1), F.length("text") - SPAN + 1)) + 1
    picked = rows.where(wanted).withColumn("nth", nth).select("lang", "h", "nth", F.substring(F.col("text"), at, F.lit(SPAN)).alias("part"))
    got = sorted((r["lang"], r["h"], r["nth"], r["part"]) for r in picked.collect())
    model = train([x[3].encode()[:SPAN] for x in got], [x[0] for x in got])
    model.letters = frozenset(c for x in got for c in x[3].lower() if LETTER.match(c))
    model.evidence = weigh([(x[0], x[1], x[3]) for x in got])
    return model


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", keys: bool = False) -> DataFrame:
    """doc_id, lang_pred, score of each row: the language with the largest mean probability over all bytes of the
    whole text, and that mean. und and 0 if the text is null or has no letter, or there is no model. keys: also
    text_key (see common.identity). Rows are worked off where they are; nothing is shuffled."""
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        model = sent.value
        for whole in batches:
            for batch in (whole.slice(i, 1024) for i in range(0, whole.num_rows, 1024)):
                texts = batch.column("text").to_pylist()
                langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
                some = [i for i, t in enumerate(texts) if model and LETTER.search(t)]
                if some:
                    p = document_probabilities(model, [texts[i].encode() for i in some])
                    for i, j, s in zip(some, p.argmax(axis=1), p.max(axis=1), strict=True):
                        langs[i], scores[i] = model.langs[j], float(min(1.0, s))
                cols = {"doc_id": batch.column("doc_id"), "lang_pred": pa.array(langs, pa.string()), "score": pa.array(scores, pa.float64())}
                if keys:
                    cols["text_key"] = batch.column("text_key")
                yield pa.RecordBatch.from_pydict(cols)

    text = text_of(text_col)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"), *([F.xxhash64(text).alias("text_key")] if keys else []))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double" + ", text_key long" * keys)


def known_letters(model: Model, text: str) -> float:
    """The share of a text's letters that the training sample has."""
    all_, known = 0, 0
    for c, n in Counter(text.lower()).items():
        if LETTER.match(c):
            all_, known = all_ + n, known + n * (c in model.letters)
    return known / max(1, all_)


def keep_identified(docs: DataFrame, model: Model | None, least: float | None = None, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs without the rows that are in none of the model's languages: null texts and texts without a letter; those half of whose letters the
    training sample never had (other scripts); and those whose letters, on average over the whole text, are worth no more than
    `least` in the language that the net finds (other languages and junk). Left out, `least` is the language's own bound, which
    the training sample sets, halfway between its clean windows and the same ones with shuffled words; so it does not hang on how sure the net,
    which knows its languages alone, happens to be. Prose with some foreign lines, names or junk stays, and so do texts of a few letters.

    Columns stay as they were, but a null language is filled in with the predicted one, if docs have that column. Without a model only
    rows without letters go."""
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(model)
    at = docs.columns.index(lang_col) if dict(docs.dtypes).get(lang_col) == "string" else None

    def run(batches):
        import pyarrow as pa

        model = sent.value
        for whole in batches:
            for batch in (whole.slice(i, 1024) for i in range(0, whole.num_rows, 1024)):
                texts = batch.column(text_col).to_pylist()
                some = [i for i, t in enumerate(texts) if t and LETTER.search(t)]
                good, langs = np.zeros(len(texts), dtype=bool), [None] * len(texts)
                if some and model:
                    p = document_probabilities(model, [texts[i].encode() for i in some])
                    for i, j in zip(some, p.argmax(axis=1), strict=True):
                        langs[i] = model.langs[j]
                        bound = model.evidence.bound[langs[i]] if least is None else least
                        good[i] = known_letters(model, texts[i]) > 0.5 and model.evidence.of(texts[i], langs[i]) > bound
                elif some:
                    good[some] = True
                if at is not None:
                    had = batch.column(at)
                    batch = batch.set_column(at, batch.schema.field(at), pa.array([x if x is not None else y for x, y in zip(had.to_pylist(), langs, strict=True)], had.type))
                yield batch.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
