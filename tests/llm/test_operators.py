"""Each operator beside a plain version over small tables with nulls, ties, repeats and very long texts."""

from __future__ import annotations

import base64
import hashlib
import io
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from loam.llm import bpe, exact_dedup, language_id, line_dedup, lm_scoring, mixing, ngram_join, substring_dedup, topk_search, warc
from loam.llm.common import staged
from loam.llm.grouping import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACE = " \t\n\x0b\x0c\r"


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def sha(t):
    return hashlib.sha256(t if isinstance(t, bytes) else t.encode()).hexdigest()


def got(df, *cols):
    return Counter(tuple(r[c] for c in cols) for r in df.collect())


# --- 1 mixing ---


def plain_targets(sizes, weights, share, repeats):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), set(order), {}
    while open_:
        total = sum(w[s] for s in open_)
        full = {s for s in open_ if left * w[s] / total > repeats * sizes[s]}
        for s in full or open_:
            out[s] = repeats * sizes[s] if full else left * w[s] / total
        if not full:
            break
        left -= sum(out[s] for s in full)
        open_ -= full
    return out


def test_mixing(edge_docs, edge_rows, no_docs):
    rows = mixing.mix(edge_docs).collect()
    assert len(rows) == len(edge_rows)
    size = Counter()
    for _, t, _, s in edge_rows:
        size[s] += len(WORD.findall(t or ""))
    want = plain_targets(dict(size), (3, 1, 2), 1.5, 2)
    taken, largest = Counter(), max(len(WORD.findall(t or "")) for _, t, _, _ in edge_rows)
    for r in rows:
        assert r["source_size"] == size[r["source"]]
        assert math.isclose(r["target"], want[r["source"]], abs_tol=1e-6)
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 2 * largest for s in want)
    assert sum(taken.values()) <= 1.5 * sum(size.values()) < sum(taken.values()) + largest
    again = mixing.mix(edge_docs)
    assert got(again, "doc_id", "size", "source", "taken") == Counter((r["doc_id"], r["size"], r["source"], r["taken"]) for r in rows)
    assert mixing.mix(no_docs).count() == 0 and mixing.mixed(no_docs).count() == 0
    drawn = mixing.mixed(edge_docs)
    assert drawn.columns == edge_docs.columns
    assert drawn.count() == sum(r["copies"] for r in rows)


def test_mixing_hot_source(spark):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 7), "hot" if i % 3 else f"s{i % 5}") for i in range(3000)], "doc_id long, text string, source string")
    out = mixing.mix(docs).groupBy("source").agg({"taken": "sum", "target": "max"}).collect()
    assert all(abs(r["sum(taken)"] - r["max(target)"]) <= 10 for r in out)


# --- 2 n-gram join ---


def shingles(t, k):
    w = WORD.findall(lower(t or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def plain_components(rows, k, percent):
    sets = [shingles(t, k) for _, t, *_ in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                up[root(i)] = root(j)
    least = {}
    for i, (d, *_) in enumerate(rows):
        r = root(i)
        least[r] = d if least.get(r) is None else least[r] if d is None else min(d, least[r])
    return [(d, len(sets[i]), least[root(i)] if sets[i] else d) for i, (d, *_) in enumerate(rows)]


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80)])
def test_ngram_join(edge_docs, edge_rows, no_docs, k, percent):
    found = ngram_join.n_gram_join(edge_docs, k, percent)
    assert got(found, "doc_id", "n_shingles", "component_id") == Counter(plain_components(edge_rows, k, percent))
    assert ngram_join.n_gram_join(no_docs, k, percent).count() == 0


def test_ngram_join_of_a_large_group(spark, monkeypatch):
    """Near copies of near copies, in groups of several blocks, and a passage that all documents share."""
    monkeypatch.setattr("loam.llm.grouping.SMALL", 8)
    monkeypatch.setattr("loam.llm.grouping.LARGE", 8)
    r = random.Random(3)
    base, shared = [f"w{r.randrange(500)}" for _ in range(90)], "all of these documents hold this one passage here".split()
    rows = []
    for i in range(120):
        w = list(base)
        for _ in range(r.randrange(5)):
            w[r.randrange(len(w))] = f"x{r.randrange(50)}"
        rows.append((i, " ".join(w if i % 3 else [f"y{r.randrange(10**6)}" for _ in range(r.randrange(5, 90))] + shared), None, None))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert got(ngram_join.n_gram_join(docs), "doc_id", "n_shingles", "component_id") == Counter(plain_components(rows, 4, 85))


def test_one_of_each(edge_docs, edge_rows):
    kept = ngram_join.one_of_each(edge_docs, 4, 85)
    assert kept.columns == edge_docs.columns
    want = Counter()
    for (d, n, c), row in zip(plain_components(edge_rows, 4, 85), edge_rows, strict=True):
        if n == 0 or c == d:
            want[row[:2]] = want[row[:2]] + 1 if n == 0 else 1
    assert got(kept, "doc_id", "text") == want


def test_components(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(r.randrange(5000, 5400), r.randrange(5000, 5400)) for _ in range(250)] + [(-5, 7)]
    up = {}
    for a, b in edges:
        up.setdefault(a, a), up.setdefault(b, b)

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    want = {i: root(i) for i in up if any(i in e and e[0] != e[1] for e in edges)}
    out = components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {x["node"]: x["component"] for x in out} == want and len(out) == len(want)


# --- 3 language ID ---


def test_gradients_by_differences():
    import numpy as np

    r = np.random.default_rng(0)
    w = {k: v.astype(np.float64) for k, v in language_id.fresh(3, 4, 1).items()}
    codes = r.integers(97, 105, (9, 5))
    codes[6:, 1] = codes[4:, 3] = language_id.FILL
    y = np.array([0, 1, 2, 1, 0])
    _, g = language_id.gradients(w, codes, y)
    for k in w:
        for _ in range(4):
            i = tuple(int(r.integers(0, s)) for s in w[k].shape)
            if k[0] == "x":
                i = (i[0], int(codes[0, 0]))
            old, e = w[k][i], 1e-5
            w[k][i] = old + e
            a = language_id.gradients(w, codes, y)[0]
            w[k][i] = old - e
            b = language_id.gradients(w, codes, y)[0]
            w[k][i] = old
            assert abs((a - b) / (2 * e) - g[k][i]) < 1e-5, k


def plain_language(model, data: bytes):
    """Probabilities of each byte's languages, by the gates' formulas, in float64."""
    import numpy as np

    w = {k: v.astype(np.float64) for k, v in model.weights.items()}
    n, out = w["uf"].shape[1], []
    for at in range(0, len(data), language_id.SPAN):
        part, states = data[at : at + language_id.SPAN], {}
        for d, order in (("f", range(len(part))), ("b", range(len(part) - 1, -1, -1))):
            h = np.zeros(n)
            for t in order:
                x, u = w[f"x{d}"][:, part[t]], w[f"u{d}"] @ h + w[f"c{d}"][:, 0]
                z, r = (1 / (1 + np.exp(-2 * (x[i : i + n] + u[i : i + n]))) for i in (0, n))
                h = z * h + (1 - z) * np.tanh(x[2 * n :] + r * u[2 * n :])
                states[d, t] = h
        for t in range(len(part)):
            y = w["vf"] @ states["f", t] + w["vb"] @ states["b", t] + w["o"][:, 0]
            out.append(np.exp(y - y.max()) / np.exp(y - y.max()).sum())
    return np.array(out)


def planted_languages(spark, rows):
    """Three clean documents, one without a language, and what is in none of the languages of the rows."""
    r = random.Random(1)
    finnish = "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä. "
    russian = "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью. "
    junk = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") if r.random() > 0.15 else " " for _ in range(600))
    texts = [(1, rows[0]["text"], None), (2, rows[1]["text"], "x"), (3, rows[2]["text"], rows[2]["lang"]), (4, finnish * 3, None), (5, russian * 3, None), (6, "人人生而自由，在尊严和权利上一律平等。" * 4, None), (7, junk, None), (8, "12 34 $$$", None), (9, None, None), (10, "", None)]
    return spark.createDataFrame([(d, t, x, "s") for d, t, x in texts], "doc_id long, text string, lang string, source string")


FOREIGN = {
    "fi": "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.",
    "pl": "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa.",
}


def junk_texts(r, clean, n):
    """n texts of each kind: random letters, letters as often as in clean text, words of clean text with their letters shuffled, and
    sentences of two other languages, their words in random order."""
    letters = [c for t in clean[:200] for c in t.lower() if c.isalpha()]
    of = lambda pick, k: "".join(pick() if r.random() > 0.15 else " " for _ in range(k))
    out = {"random": [], "unigram": [], "shuffled": [], **{k: [] for k in FOREIGN}}
    for _ in range(n):
        size = r.randint(80, 800)
        out["random"].append(of(lambda: r.choice("abcdefghijklmnopqrstuvwxyz"), size))
        out["unigram"].append(of(lambda: r.choice(letters), size))
        words = [w for w in r.choice(clean).split() if w.isalpha()]
        while sum(map(len, words)) < 80:
            words += [w for w in r.choice(clean).split() if w.isalpha()]
        out["shuffled"].append(" ".join("".join(r.sample(w, len(w))) for w in words))
        for k, t in FOREIGN.items():
            words = t.split()
            out[k].append(" ".join(r.choice(words) for _ in range(size // 6)))
    return out


def test_rejection(spark):
    """Junk of three kinds and two other languages go, clean rows stay: under nets of five seeds, each with a training sample of its own."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.where("text is not null").collect()
    for seed in range(5):
        r = random.Random(seed)
        learn = [x for x in rows if x["lang"] and zlib.crc32(str(x["doc_id"]).encode()) % 4 != 2]
        windows = []
        for lang in sorted({x["lang"] for x in learn}):
            own = [x for x in learn if x["lang"] == lang]
            for _ in range(1500):
                x = r.choice(own)
                at = r.randrange(max(1, len(x["text"]) - language_id.SPAN + 1))
                windows.append((lang, x["doc_id"], x["text"][at : at + language_id.SPAN]))
        model = language_id.train([w[2].encode()[: language_id.SPAN] for w in windows], [w[0] for w in windows], steps=60, seed=seed)
        model.letters = frozenset(c for w in windows for c in w[2].lower() if c.isalpha())
        model.evidence = language_id.weigh(windows, seed)
        junk = junk_texts(r, [x["text"] for x in learn], 60)
        texts = [(i, t) for i, t in enumerate(t for ts in junk.values() for t in ts)] + [(1_000_000 + i, x["text"]) for i, x in enumerate(rows)]
        kept = {x["doc_id"] for x in language_id.keep_identified(spark.createDataFrame(texts, "doc_id long, text string"), model).collect()}
        clean = [i for i, t in texts if i >= 1_000_000 and re.search(r"[^\W\d_]", t)]
        caught = [sum(i not in kept for i in range(60 * j, 60 * j + 60)) / 60 for j in range(len(junk))]
        print(seed, dict(zip(junk, caught)), sum(i in kept for i in clean) / len(clean))
        assert min(caught) >= 0.95, (seed, dict(zip(junk, caught)))
        assert sum(i in kept for i in clean) >= 0.999 * len(clean), seed


def test_language_id(spark, edge_docs, edge_rows, no_docs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fit(docs)
    out = {r["doc_id"]: r for r in language_id.predict(docs, model).collect()}
    rows = docs.collect()
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert len(held) > 200
    assert sum(out[r["doc_id"]]["lang_pred"] == r["lang"] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in out.values())
    # A text longer than a batch of windows gets the mean over all its positions.
    long = "\n".join(r["text"] for r in rows[:250])
    one = language_id.document_probabilities(model, [long.encode(), b"x", b""], most=64)
    assert abs(one[:2].sum(axis=1) - 1).max() < 1e-4
    assert abs(language_id.document_probabilities(model, [long.encode()])[0] - one[0]).max() < 1e-5
    assert len(language_id.label_positions(model, "les éaux")) == 9
    edge = language_id.predict(edge_docs, model).collect()
    blank = Counter((d, "und", 0.0) for d, t, *_ in edge_rows if not re.search(r"[^\W\d_]", t or ""))
    assert Counter((r["doc_id"], r["lang_pred"], r["score"]) for r in edge if r["lang_pred"] == "und") == blank and len(edge) == len(edge_rows)
    kept = language_id.keep_identified(edge_docs, model, least=-math.inf)
    assert kept.columns == edge_docs.columns and kept.count() == len(edge_rows) - sum(blank.values())
    # Everything against a plain forward pass, position by position.
    for d, t, *_ in edge_rows:
        if t and len(t) < 2000 and re.search(r"[^\W\d_]", t):
            want = plain_language(model, t.encode())
            assert abs(language_id.document_probabilities(model, [t.encode()])[0] - want.mean(axis=0)).max() < 1e-4
            best = want.argmax(axis=1)
            labels = language_id.label_positions(model, t)
            assert all(labels[i] == model.langs[best[i]] or want[i].max() - sorted(want[i])[-2] < 1e-4 for i in range(len(best))) and len(labels) == len(best)
    scores = Counter((d, round(float(plain_language(model, t.encode()).mean(axis=0).max()), 3)) for d, t, *_ in edge_rows if t and len(t) < 2000 and re.search(r"[^\W\d_]", t))
    near = Counter((r["doc_id"], round(r["score"], 3)) for r in edge)
    assert sum((scores - near).values()) <= 2  # rounding at an edge
    # Other languages, scripts and junk go; a null language is filled in.
    kept = {r["doc_id"]: r["lang"] for r in language_id.keep_identified(planted_languages(spark, rows), model).collect()}
    assert set(kept) == {1, 2, 3} and kept[1] == rows[0]["lang"] and kept[2] == "x" and kept[3] == rows[2]["lang"]
    assert language_id.keep_identified(no_docs, model).count() == 0 and language_id.keep_identified(no_docs, None).count() == 0
    assert language_id.predict(edge_docs, model, keys=True).count() == len(edge_rows)
    assert language_id.fit(no_docs) is None
    assert {r["lang_pred"] for r in language_id.predict(edge_docs, None).collect()} == {"und"}
    assert language_id.predict(no_docs, model).count() == 0


# --- 4 line dedup ---


def plain_lines(rows, least):
    key = lambda x: lower(x.strip(SPACE))
    df = Counter(k for _, t, *_ in rows for k in {key(x) for x in (t or "").split("\n")})
    out = Counter()
    for d, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not key(x) or df[key(x)] < least]
        out[d, len(lines), len(lines) - len(kept), "\n".join(kept)] += 1
    return out


@pytest.mark.parametrize("least", [2, 10])
def test_line_dedup(edge_docs, edge_rows, no_docs, least):
    assert got(line_dedup.drop_common_lines(edge_docs, least), "doc_id", "n_lines", "n_dropped", "kept_text") == plain_lines(edge_rows, least)
    assert line_dedup.drop_common_lines(no_docs, least).count() == 0


def test_line_runs_settle_and_compact(spark):
    runs = line_dedup.LineRuns(spark, min_docs=3)
    for batch in ([1, 2, 2], [2, 3], [1, 3, 4], [1, 2, 3, 4], [9, 4]):
        runs.add(spark.createDataFrame([(x, 0) for x in batch], "h1 long, h2 long"))
    assert [x is not None for x in runs.levels] == [True, False, True]
    # Merges read the runs as they are: neither dealt nor sorted again.
    spark.conf.set(line_dedup.ORDERED, "true")
    plan = runs.levels[0].join(runs.levels[2].hint("merge"), line_dedup.KEY, "full_outer")._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset(line_dedup.ORDERED)
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan
    assert {r["h1"] for r in runs.frequent().collect()} == {1, 2, 3, 4}
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("loam_")]


@pytest.mark.parametrize("most", [0, 1000])
def test_documents_of_many_common_lines(edge_docs, edge_rows, monkeypatch, most):
    monkeypatch.setattr(line_dedup, "MANY", 0)
    monkeypatch.setattr(line_dedup, "SENT", most)
    assert got(line_dedup.drop_common_lines(edge_docs, 2), "doc_id", "n_lines", "n_dropped", "kept_text") == plain_lines(edge_rows, 2)


# --- 5 WARC ---


@pytest.fixture(scope="module")
def pages(spark):
    big, r = "<p>" + "é" * 200, random.Random(4)
    rows = [(1, "http://a/\r\nb", big), (2, "u", big), (3, None, big), (3, "v", big), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (7, "u", ""), (None, "u", big), (None, "u", "x" * 100), (8, "u", "x" * 100), (9, "u", "y" * 99), (10, "u", "y" * 99), (11, "u", "".join(r.choice("ab\r\n WARC/1.1") for _ in range(3_000_00)))]
    return spark.createDataFrame([(*x, "clash") for x in rows], "page_id long, url string, html string, revisit string"), rows


def test_warc_round_trip(spark, pages):
    df, rows = pages
    first = defaultdict(list)
    for i, _, h in rows:
        first[h or ""].append(i)
    want = Counter()
    for i, _, h in rows:
        h = h or ""
        low = min((x for x in first[h] if x is not None), default=None)
        again = len(h.encode()) >= 100 and i != low
        want[i, len(h.encode()), sha(h), "revisit" if again else "response", low if again else None] += 1
    assert got(warc.round_trip(df), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == want
    assert warc.round_trip(df.limit(0)).count() == 0
    texts = got(warc.read_archives(warc.write_pages(df), with_payload=True).where("record_type = 'response'"), "page_id", "payload")
    assert all(bytes(p).decode() in [h or "" for i, _, h in rows if i == k] for k, p in texts)


def test_warc_salvage():
    r = random.Random(2)
    def build(i, plain):
        x = warc.record("response", str(i), "u", b"%d " % i * r.randrange(1, 5000), payload_digest="-", payload_bytes=0, page_id=i)
        return zlib.decompress(x, 31) if plain else x

    for trial in range(30):
        parts = [build(i, trial % 3 == 0 or (trial % 3 == 1 and i % 2)) for i in range(12)]
        at, bad = [sum(map(len, parts[:i])) for i in range(13)], set()
        data = bytearray(b"".join(parts))
        for i in r.sample(range(12), 3):
            place = r.randrange(at[i], at[i + 1])
            n = r.randrange(1, 30)
            for p in range(place, min(at[i + 1], place + n)):
                data[p] ^= 0x55
            bad.add(i)
        found = list(warc.salvage(io.BytesIO(bytes(data)), len(data)))
        good = {int(x.headers["x-page-id"]) for x in found if isinstance(x, warc.Record) and "x-page-id" in x.headers}
        assert good >= set(range(12)) - bad
        pos = 0
        for x in found:  # records and gaps cover every byte once
            assert x.offset == pos
            pos = x.end
        assert pos == len(data)
        assert any(isinstance(x, warc.Gap) and x.reason for x in found) or good == set(range(12))
    whole = build(1, False)
    cut = list(warc.salvage(io.BytesIO(whole[:-9]), len(whole) - 9))
    assert [type(x) for x in cut] == [warc.Gap]
    assert list(warc.salvage(io.BytesIO(b""), 0)) == []


def test_warc_long_urls(spark):
    """Header blocks of any length: of a page, of the first page of a group of copies, and in a plain archive."""
    long, html = "http://a/" + "x" * 100_000, "<p>" + "y" * 200
    rows = [(1, long, html), (2, "u", html), (3, "v", html), (4, long, "alone"), (5, "\x01" * 40_000, "z" * 150)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = got(warc.round_trip(df), "page_id", "record_type", "refers_to")
    assert found == Counter([(1, "response", None), (2, "revisit", 1), (3, "revisit", 1), (4, "response", None), (5, "response", None)])
    plain = b"".join(zlib.decompress(warc.record("response", str(i), u, b"p", payload_digest="-", payload_bytes=1, page_id=i), 31) for i, u in enumerate([long, "u", 30 * long]))
    for data in (plain, b"WARC/" * 50 + plain, plain[:50] + plain):
        records = [x for x in warc.salvage(io.BytesIO(data), len(data)) if isinstance(x, warc.Record)]
        assert [x.headers["x-page-id"] for x in records] == ["0", "1", "2"]
        assert [len(x.headers["warc-target-uri"]) for x in records] == [len(long), 1, 30 * len(long)]


# --- 6 BPE ---


@pytest.fixture(scope="module")
def ranks():
    import public_tokenizers as p
    import tiktoken

    path = p.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        own = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return path, p.PATTERN, tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=own, special_tokens={})


def test_bpe(edge_docs, edge_rows, no_docs, ranks):
    path, pattern, e = ranks
    out = bpe.encode(edge_docs, path, pattern)
    want = Counter()
    for d, t, *_ in edge_rows:
        ids = e.encode_ordinary(t or "")
        want[d, len(ids), sha(" ".join(map(str, ids))), sha(t or "")] += 1
    assert got(out, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want
    back = bpe.decode(out, path, pattern).collect()
    assert Counter((r["doc_id"], bytes(r["decoded"]).decode()) for r in back) == Counter((d, t or "") for d, t, *_ in edge_rows)
    assert bpe.encode(no_docs, path, pattern).count() == 0


def test_bpe_words(ranks):
    path, pattern, e = ranks
    tok, r = bpe.tokenizer(*bpe.sent(path), pattern), random.Random(8)
    for _ in range(4000):
        t = "".join(r.choice("aábc é'st 12²  \n\t\x1c\x85　漢字🎉$%-_½ßthing") for _ in range(r.randrange(40)))
        assert tok.encode(t) == e.encode_ordinary(t)
        assert tok.decode(tok.encode(t)).decode() == t
    keys = [b"%d" % i for i in range(1000)]
    h = bpe.PerfectHash(keys)
    assert [h.get(k) for k in keys] == list(range(1000)) and h.get(b"x") == -1 and len(h.slots) == 1000
    assert bpe.PerfectHash([]).get(b"x") == -1


# --- 7 exact dedup ---


def test_exact_dedup(edge_docs, edge_rows, no_docs):
    groups = defaultdict(list)
    for d, t, *_ in edge_rows:
        groups[lower(t or "")].append(d)
    out = exact_dedup.exact_duplicates(edge_docs)
    best = {t: max((x for x in g if x is not None), default=None) for t, g in groups.items()}
    want = Counter((d, best[lower(t or "")], len(groups[lower(t or "")]), sha(lower(t or ""))) for d, t, *_ in edge_rows)
    assert got(out, "doc_id", "keep_id", "group_size", "text_sha256") == want
    kept = out.where("kept").collect()
    assert Counter((r["doc_id"], r["text_sha256"]) for r in kept) == Counter((best[t], sha(t)) for t in groups)
    assert exact_dedup.exact_duplicates(no_docs).count() == 0
    left = exact_dedup.drop_duplicates(edge_docs)
    assert left.columns == edge_docs.columns
    assert Counter(lower(r["text"] or "") for r in left.collect()) == Counter(list(groups))


# --- 8 language model ---


@pytest.fixture(scope="module")
def pieces():
    import public_tokenizers as p

    return p.path("piece_bpe_32k.model")


def test_lm_scores(edge_docs, edge_rows, no_docs, pieces):
    out = lm_scoring.score(edge_docs, pieces).collect()
    count, ends = Counter(), 0
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 5 == 1
    for d, t, *_ in edge_rows:
        if not held(d):
            count.update(WORD.findall(lower(t or "")))
            ends += 1
    n, v = sum(count.values()) + ends, len(count) + 1
    want = Counter()
    for d, t, *_ in edge_rows:
        w = WORD.findall(lower(t or ""))
        base = sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w) + math.log10((ends + 0.5) / (n + 0.5 * (v + 1)))
        want[d, held(d), len(w) + 1, sum(count[x] > 0 for x in w) + 1, n, round(base, 6)] += 1
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in out) == want
    # The score against a plain run of the same model.
    names = lm_scoring.read_pieces(pieces)
    weight = {x: 1 / (10 - w) for x, w in names.items()}
    first, later = sum(w for x, w in weight.items() if x[0] == lm_scoring.MARK), 1.3 * sum(w for x, w in weight.items() if x[0] != lm_scoring.MARK)

    def plain_word(x):
        """The sum over all ways to cut the marked word, begin by begin, in plain probabilities scaled by character."""
        t = lm_scoring.MARK + x
        ways, scale = [1.0] + [0.0] * len(t), 0.0
        for e in range(1, len(t) + 1):
            for b in range(max(0, e - 24), e):
                piece = t[b:e]
                if piece in weight and not lm_scoring.is_byte(piece) and (b == 0 or piece[0] != lm_scoring.MARK):
                    ways[e] += ways[b] * weight[piece] / (later if b else first)
                elif e == b + 1:
                    ways[e] += ways[b] * math.prod(weight[f"<0x{c:02X}>"] / later for c in piece.encode())
            top = max(ways[max(0, e - 23) : e + 1])
            if 0 < top < 1e-100:
                ways, scale = [w / top for w in ways], scale + math.log10(top)
        return math.log10(ways[-1]) + scale + math.log10(0.3 / 1.3)

    assert max(len(x) for x in weight) <= 24
    end = (ends + 0.5) / (n + 1)
    p = {x: plain_word(x) + math.log10(1 - end) for _, t, *_ in edge_rows for x in WORD.findall(lower(t or ""))}
    end = math.log10(end)
    plain = Counter((d, round(sum(p[x] for x in WORD.findall(lower(t or ""))) + end, 4)) for d, t, *_ in edge_rows)
    assert Counter((r["doc_id"], round(r["score"], 4)) for r in out) == plain
    assert lm_scoring.score(no_docs, pieces).count() == 0


def test_packed_terms():
    import numpy as np

    for places, counts in (([], []), ([0], [1]), ([0, 5, 70_000, 70_001], [1, 255, 256, 70_000]), ([3, 9], [2, 2]), ([65_535, 131_071], [1, 1])):
        a, n = lm_scoring.terms_of(lm_scoring.packed_terms(np.array(places, dtype=np.int32), np.array(counts, dtype=np.int64)))
        assert a.tolist() == places and n.tolist() == counts


def test_lattice_sums_all_segmentations():
    """Against the sum over all ways to cut a word; and all words of a tiny alphabet have probability 1 together."""
    from itertools import product

    m = lm_scoring.MARK
    weight = {m: 2.0, m + "a": 1.0, m + "ab": 3.0, "a": 1.0, "b": 2.0, "ab": 1.5, "ba": 0.5, **{f"<0x{i:02X}>": 0.01 for i in range(256)}}
    import numpy as np

    known = lm_scoring.Pieces(weight)
    s = lm_scoring.Speller(known, np.array([weight[p] for p in known.names]), 9.0)
    first, later = sum(w for p, w in weight.items() if p[0] == m), sum(w for p, w in weight.items() if p[0] != m) + 9.0

    def cuts(t):
        if not t:
            yield []
        for i in range(1, len(t) + 1):
            for rest in cuts(t[i:]):
                yield [t[:i], *rest]

    words = ["".join(w) for n in range(1, 8) for w in product("ab", repeat=n)]
    for w in words:
        total = sum(math.prod((weight[x] / (later if i else first)) for i, x in enumerate(c)) for c in cuts(m + w) if all(x in weight for x in c) and c[0][0] == m)
        assert math.isclose(math.exp(s.log_prob(w)), total * 9.0 / later, rel_tol=1e-9)
    assert abs(s.log_probs(words) - [s.log_prob(w) for w in words]).max() < 1e-9
    assert 0.7 < sum(math.exp(s.log_prob(w)) for w in words) + math.exp(s.log_prob("")) <= 1  # longer words and bytes have the rest


# --- 9 top-k ---


def plain_top(rows, k, every):
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = Counter()
    for q in {i for i, _ in ok if i % every == 0}:
        scores = {(sum(a * b for a, b in zip(v, w)), i) for j, v in ok if j == q for i, w in ok if i != q}
        for rank, (s, i) in enumerate(sorted(scores, key=lambda x: (-x[0], x[1]))[:k], 1):
            out[q, rank, i, s] += 1
    return out


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "BUCKET", 32)
    monkeypatch.setattr(topk_search, "BLOCK", 4)
    r = random.Random(9)
    rows = [(i, [r.gauss(0, 1) * (5 if i % 9 == 0 else 1) for _ in range(8)]) for i in range(600)]
    rows += [(600 + i, rows[3][1]) for i in range(150)] + [(7, rows[7][1]), (800, None), (850, [1.0, None]), (900, [float("nan")]), (None, [1.0]), (950, []), (1000, [float("inf")] * 8), (1050, [1.0, 2.0]), (1051, [0.0] * 8), (1100, [3e7] * 8), (1150, [-3e7] * 8)]
    df = spark.createDataFrame([(*x, "clash", 1) for x in rows], "vec_id long, embedding array<double>, tier string, cell int")
    assert got(topk_search.top_k(df, 5, 50), "query_id", "rank", "vec_id", "score") == plain_top(rows, 5, 50)
    few = spark.createDataFrame(rows[:4], "vec_id long, embedding array<double>")
    assert got(topk_search.top_k(few, 5, 2), "query_id", "rank", "vec_id", "score") == plain_top(rows[:4], 5, 2)
    assert topk_search.top_k(df.limit(0)).count() == 0


def test_top_k_counts_repeated_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [3.0, 0.0]), (1, [3.0, 0.0]), (2, [2.0, 0.0]), (2, [2.5, 0.0]), (3, [1.0, 0.0]), (4, [0.5, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = Counter([(0, 1, 1, 196608), (0, 2, 1, 196608), (0, 3, 2, 163840), (0, 4, 2, 131072), (0, 5, 3, 65536)])
    assert got(topk_search.top_k(df, 5, 50), "query_id", "rank", "vec_id", "score") == want
    again = spark.createDataFrame([*rows, rows[0]], df.schema)  # a repeated query row adds no answers
    assert got(topk_search.top_k(again, 5, 50), "query_id", "rank", "vec_id", "score") == want


# --- 10 substring dedup ---


def test_substring_dedup(spark, edge_docs, edge_rows, no_docs):
    out = substring_dedup.repeated_passages(edge_docs).collect()
    text = defaultdict(set)
    for d, t, *_ in edge_rows:
        text[d].add(t or "")
    seen = defaultdict(set)
    for d, t, *_ in edge_rows:
        w = WORD.findall(lower(t or ""))
        for i in range(len(w) - 50):
            seen[tuple(w[i : i + 51])].add((d, t))
    must = {d for v in seen.values() if len(v) > 1 for d, _ in v}
    assert must <= {r["doc_id"] for r in out}
    gram = defaultdict(set)
    for d, t, *_ in edge_rows:
        for g in shingles(t, 5):
            gram[g].add((d, t))
    may = {d for v in gram.values() if len(v) > 1 for d, _ in v}
    assert {r["doc_id"] for r in out} <= may
    for r in out:
        assert r["n_words"] >= substring_dedup.PARAGRAPH
        assert any(len(WORD.findall(t.encode()[r["start"] : r["end"]].decode())) == r["n_words"] for t in text[r["doc_id"]] if len(t.encode()) >= r["end"])
        assert r["removed"] or r["cluster"] == r["doc_id"]
    assert substring_dedup.repeated_passages(no_docs).count() == 0


def test_passages_wherever_they_stand(spark, monkeypatch):
    """Planted passages of 51 words and more in clean documents: all are found, one occurrence stays, the clean ones have no row."""
    monkeypatch.setattr("loam.llm.grouping.SMALL", 8)
    monkeypatch.setattr("loam.llm.grouping.LARGE", 8)
    r = random.Random(11)
    prose = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    rows, planted = [], {}
    passages = [prose(r.randrange(51, 80)) for _ in range(30)]
    for i in range(300):
        a, b = prose(r.randrange(60)), prose(r.randrange(60))
        own = passages[i % 30] if i % 3 == 0 else []
        if own:
            planted.setdefault(i % 30, []).append(i)
            own = [x if r.random() > 0.01 else "edit" for x in own] if i > 150 else own
        rows.append((i, " ".join(a + own + b)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = substring_dedup.repeated_passages(docs).collect()
    found = {x["doc_id"] for x in out}
    want = {i for v in planted.values() for i in v}
    assert found <= want and len(found) >= 0.97 * len(want)
    assert all(x["removed"] == (x["doc_id"] != x["cluster"]) for x in out)
    cut = {x["doc_id"]: x["text"] for x in substring_dedup.cut_passages(docs).collect()}
    gone = {x["doc_id"] for x in out if x["removed"]}
    assert all((cut[i] == t) == (i not in gone) for i, t in rows) and len(cut) == len(rows)


def test_near_passages_are_whole(spark):
    """A passage of 51 words with its middle word changed (similarity 0.808), one of 30 and one of 100 words with two edits, each pasted into two contexts:
    every word of both occurrences is in a span. One of 40 words with two edits is not similar, and has no row."""
    r = random.Random(13)
    prose = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    rows, spans = [], {}
    for i in range(120):
        n, edits = [(51, [25]), (30, []), (100, [33, 66]), (40, [13, 26])][i % 4]
        own = prose(n)
        for d, text in ((2 * i, own), (2 * i + 1, ["edit" if w in edits else x for w, x in enumerate(own)])):
            a, b = prose(r.randrange(60)), prose(r.randrange(60))
            rows.append((d, " ".join(a + text + b)))
            if i % 4 < 3:
                spans[d] = (len(" ".join([*a, ""])), len(" ".join(a + text)), n, d % 2 == 1, d - d % 2)
    out = substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x["doc_id"]: (x["start"], x["end"], x["n_words"], x["removed"], x["cluster"]) for x in out} == spans and len(out) == len(spans)


def test_passages_behind_a_common_phrase(spark):
    """Twenty words that an earlier document has alone do not hide the thirty that two others share around them."""
    r = random.Random(14)
    prose = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    rows, want = [], set()
    for i in range(40):
        own = prose(30)
        rows += [(3 * i, " ".join(prose(20) + own[5:25] + prose(20))), (3 * i + 1, " ".join(prose(9) + own)), (3 * i + 2, " ".join(own + prose(9)))]
        want |= {(3 * i + 1, False, 30), (3 * i + 2, True, 30)}
    out = substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(x["doc_id"], x["removed"], x["n_words"]) for x in out} == want


def plain_due(x, y, k=5):
    """Whether word lists are alike by 0.8 in their shingles, counted by aligned places (replaced words only). Passages begin and end
    with equal words, and have 24 at least."""
    equal = [i for i in range(len(x)) if x[i] == y[i]]
    x, y = x[equal[0] : equal[-1] + 1], y[equal[0] : equal[-1] + 1]
    if len(x) < substring_dedup.PARAGRAPH:
        return False
    same = sum(x[i : i + k] == y[i : i + k] for i in range(len(x) - k + 1))
    return 100 * same >= 80 * (2 * (len(x) - k + 1) - same)


@pytest.mark.parametrize("whole", [False, True])
def test_recall_of_planted_passages(spark, whole):
    """Passages of 24 to 60 words, with 0 to 2 replaced words, in unrelated prose or as whole documents: of those that are due nine in ten
    are found, with spans over most of them; documents without a copy are left alone."""
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(3, 8)))
    prose = lambda n: [] if whole else [word() for _ in range(n)]
    rows, planted, each = [], [], 20
    for n in (24, 26, 30, 40, 60):
        for edits in (0, 1, 2):
            for _ in range(each):
                x = [word() for _ in range(n)]
                y = list(x)
                for i in r.sample(range(n), edits):
                    y[i] = word()
                a, b = prose(r.randint(20, 60)), prose(r.randint(20, 60))
                d = len(rows)
                rows += [(d, " ".join(a + x + prose(30))), (d + 1, " ".join(b + y + prose(30)))]
                planted.append((n, edits, plain_due(x, y), d + 1, len(b)))
    alone = [(10_000 + i, " ".join(word() for _ in range(80))) for i in range(100)]
    out = substring_dedup.repeated_passages(spark.createDataFrame(rows + alone, "doc_id long, text string")).where("removed").collect()
    found = {}
    for x in out:
        found[x["doc_id"]] = found.get(x["doc_id"], 0) + x["n_words"]
    assert all(d < 10_000 for d in found)
    for n in {n for n, *_ in planted}:
        due = [found.get(d, 0) for a, _, yes, d, _ in planted if a == n and yes]
        exact = [found.get(d, 0) for a, e, _, d, _ in planted if a == n and e == 0]
        assert all(x >= n for x in exact) and sum(x >= 0.8 * n for x in due) >= 0.9 * len(due), (n, due)
        assert max(due) <= n + 2


def test_spans_against_a_plain_version(spark):
    """Equal passages: spans, clusters and what is removed, by comparing all runs of words of all documents."""
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    prose = lambda n: [word() for _ in range(n)]
    shared = [prose(n) for n in (24, 31, 45, 70)]
    docs = {}
    for d in range(30):
        parts = prose(r.randint(5, 30))
        for p in r.sample(shared, r.randint(0, 2)):
            parts += p + prose(r.randint(6, 20))
        docs[d] = parts
    n = substring_dedup.PARAGRAPH
    seen, want = {}, set()
    for d, w in docs.items():
        runs = {i: tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
        again = [i for i, x in runs.items() if x in seen]
        for x in runs.values():
            seen.setdefault(x, d)
        start = None
        for i in again + [None]:
            if start is not None and (i is None or i != last + 1):
                want.add((d, start, last + n, True, seen[runs[start]]))
                want.add((seen[runs[start]], None, last + n - start, False, seen[runs[start]]))
                start = None
            if i is not None:
                start = i if start is None else start
                last = i
    got_rows = substring_dedup.repeated_passages(spark.createDataFrame([(d, " ".join(w)) for d, w in docs.items()], "doc_id long, text string")).collect()
    mine = set()
    for x in got_rows:
        before = len(" ".join(docs[x["doc_id"]]).encode()[: x["start"]].split())
        mine.add((x["doc_id"], before, before + x["n_words"], True, x["cluster"]) if x["removed"] else (x["doc_id"], None, x["n_words"], False, x["cluster"]))
    assert mine == want


def test_stages_on_empty_and_strange_tables(spark, edge_docs, edge_rows, no_docs):
    for f in (exact_dedup.drop_duplicates, ngram_join.one_of_each, substring_dedup.cut_passages):
        assert f(no_docs).columns == no_docs.columns and f(no_docs).count() == 0
    cut = substring_dedup.cut_passages(edge_docs)
    assert cut.columns == edge_docs.columns and cut.count() == len(edge_rows)
    assert cut.where("text is null").count() == sum(t is None for _, t, *_ in edge_rows)


def test_staged_tables_read_back(spark):
    df = spark.createDataFrame([(1, "a"), (None, None)], "a long, b string")
    assert got(staged(df, "x"), "a", "b") == got(df, "a", "b")


# --- 8 again: what is learned ---


def test_lm_learned_scores_are_near_the_base(spark):
    """On held-out documents the model isn't far below the base, which gives unknown words more than they can have together."""
    from loam.llm.queries import op8_lm_scoring

    rows = [r for r in op8_lm_scoring(spark, "/root/testdata/sf0.01").collect() if r["held_out"]]
    assert rows and all(r["score"] is not None and math.isfinite(r["score"]) for r in rows)
    assert sum(r["score"] for r in rows) > 1.2 * sum(r["base_score"] for r in rows)


def test_lm_uses_of_pieces():
    """Expected uses against all ways to cut a word, in vectors and one word at a time."""
    import numpy as np

    m = lm_scoring.MARK
    weight = {m: 2.0, m + "a": 1.0, m + "ab": 3.0, "a": 1.0, "b": 2.0, "ab": 1.5, "ba": 0.5, **{f"<0x{i:02X}>": 0.01 for i in range(256)}}
    known = lm_scoring.Pieces(weight)
    s = lm_scoring.Speller(known, np.array([weight[p] for p in known.names]), 9.0)
    p = dict(zip(known.names, np.exp(s.score)))

    def cuts(t):
        if not t:
            yield []
        for i in range(1, len(t) + 1):
            if t[:i] in p and (len(t[:i]) == 1 or t[:i] in weight):
                for rest in cuts(t[i:]):
                    yield [t[:i], *rest]

    words = ["abab", "ba", "a", "bbabaab"]
    want = Counter()
    for w in words:
        ways = [(c, math.prod(p[x] for x in c)) for c in cuts(m + w)]
        for c, q in ways:
            for x in c:
                want[x] += q / sum(q for _, q in ways)
    got_ = dict(zip(known.names, s.uses(words)))
    assert all(math.isclose(got_[x], want[x], abs_tol=1e-9) for x in known.names)
    alone = np.zeros(len(known.names) + 1)
    for w in words:
        s._uses_of(m + w, alone)
    assert np.allclose(alone[:-1], s.uses(words))
    assert math.isclose(s.uses(["é"])[known.place["<0xC3>"]], 1.0)
