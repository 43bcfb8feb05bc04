"""Spelling variants, prefix trie and packing beside plain versions, over small tables with nulls, ties, repeats and very long texts."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from loam.llm import packing, prefix_trie, spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")
UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


# --- 11 spelling variants ---


def plain_words(rows, every):
    n = Counter()
    for d, t in rows:
        for run in RUN.findall(t or ""):
            w = run.translate(UPPER)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if every and h % every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 6:
                n[w] += 1
    return {w: k for w, k in n.items() if k >= 5}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def plain_groups(n, times):
    form, count = {}, {}
    for w in n:
        near = [x for x in n if one_edit(w, x)]
        count[w] = len(near)
        best = min(near, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= times * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, n[w], count[w], form[w], n[form[w]] if form[w] else None, root))
    return out


COLS = ("word", "n", "n_near", "form", "form_n", "root")


def test_spelling_groups(spark):
    r = random.Random(3)
    base = ["".join(r.choice("abcdeé") for _ in range(r.randint(6, 11))) for _ in range(60)]
    words = Counter()
    for w in base:
        for _ in range(12):
            x = list(w)
            for _ in range(r.randint(0, 2)):
                i = r.randrange(len(x))
                x[i : i + 1] = r.choice([[], [r.choice("abcdeéÿ")], [x[i], r.choice("abc")]])
            words["".join(x)] += r.choice([1, 1, 5, 5, 25, 130])
    words["ab"] = 3
    words["a"] = 20
    words["prefixprefix" + "x" * 300] = 6
    words["prefixprefix" + "x" * 299] = 60
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    want = plain_groups(words, 5)
    for most in (spelling.BLOCK, 3):  # 3: nearly every block is subdivided
        assert {tuple(x[c] for c in COLS) for x in spelling.spelling_groups(df, 5, most).collect()} == want
    assert any(f is not None and ro != f for _, _, _, f, _, ro in want)  # chains of forms
    assert spelling.spelling_groups(df.limit(0)).count() == 0


def test_spelling_hot_block(spark):
    """Thousands of words with one beginning or end: blocks are divided, and nothing is lost or found twice."""
    letters = "abcdefghijklmnopqrst"
    words = {f"commonstart{a}{b}{c}": 1 + (i + j + k) % 9 for i, a in enumerate(letters) for j, b in enumerate(letters) for k, c in enumerate(letters[:4])}
    words |= {f"{a}{b}commonend": 2 for a in letters for b in letters}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    got = {(x["word"], x["near"]) for x in spelling.near_words(df).select("word", "near").collect()}
    want, masks = set(), defaultdict(list)
    for w in words:
        for i in range(len(w)):
            masks[w[:i], w[i + 1 :]].append(w)
    for g in masks.values():
        want |= {(a, b) for a in g for b in g if a != b}
    assert got == want == {(b, a) for a, b in got}
    assert spelling.near_words(df).count() == len(want)
    blocks = spelling.blocks(df)
    assert blocks.groupBy(*spelling.KEY).count().where("count > 96").isEmpty()


def test_vocabulary(spark, edge_docs, edge_rows, no_docs):
    for every in (None, 199, 7):
        got = {x["word"]: x["n"] for x in spelling.vocabulary(edge_docs, every=every).collect()}
        assert got == plain_words([(d, t) for d, t, *_ in edge_rows], every)
    assert got
    assert spelling.spelling_groups(spelling.vocabulary(no_docs)).count() == 0
    out = spelling.spelling_groups(spelling.vocabulary(edge_docs, every=7)).collect()
    assert {tuple(x[c] for c in COLS) for x in out} == plain_groups(plain_words([(d, t) for d, t, *_ in edge_rows], 7), 5) and len(out) == len(got)


# --- 12 prefix trie ---


def plain_trie(sequences):
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        own = (len(members[p]) - 1) * len(p[-1][1]) if p else 0
        leaves[p] = sum(leaves[x] for x in children[p]) or 1
        saved[p] = own + sum(saved[x] for x in children[p])
    sha = lambda x: hashlib.sha256(",".join(map(str, sorted(x))).encode()).hexdigest()
    return Counter((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p], sha(ends[p])) for p, m in members.items())


def plain_rebuilt(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            item = hashlib.sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).digest()
            convs[c].append(((turn is not None, turn or 0), item, (role or "", text or "")))
    own = {c: [x[2] for x in sorted(v)] for c, v in convs.items()}
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, [])[:h] + own[c][h:]
    return out


NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
SCHEMA = "conv_id long, turn int, role string, text string, depth string, item string, n string"


def nodes(df):
    return Counter(tuple(x[c] for c in NODE) for x in df.collect())


@pytest.fixture(scope="module")
def conversation_rows():
    r = random.Random(8)
    rows = []
    for c in list(range(100, 160)) + list(range(200, 230)) + list(range(301, 320)):  # 300 is missing
        for t in range(r.randint(1, 9)):
            rows.append((c, r.choice([t, t, t, None, 2]), r.choice(["user", "assistant", None]), r.choice(["hi", "", None, "漢字 🎉", "long " * 50])))
    rows += [rows[3], rows[3], (None, 1, "user", "no conversation"), (7, None, None, None), (10**12, 1, "user", "x")]
    rows += [(400, t, "user", "again") for t in range(700)] + [(401, t, "user", "again") for t in range(650)] + [(402, t, "user", "again" if t < 600 else "else") for t in range(640)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [3, 512])
def test_prefix_trie(spark, conversation_rows, block):
    df = spark.createDataFrame([(*x, "x", "x", "x") for x in conversation_rows], SCHEMA)
    want = plain_rebuilt(conversation_rows)
    assert any(not t for t in want.values())  # some have no turns left
    assert nodes(prefix_trie.trie(*prefix_trie.rebuilt(df), block=block)) == plain_trie(want)


def test_prefix_trie_of_plain_conversations(spark, conversation_rows):
    few = [x for x in conversation_rows if x[0] in (400, 401, 402, 100, 101)]
    df = spark.createDataFrame([(*x, "x", "x", "x") for x in few], SCHEMA)
    own = defaultdict(list)
    for c, turn, role, text in few:
        item = hashlib.sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).digest()
        own[c].append(((turn is not None, turn or 0), item, (role or "", text or "")))
    assert nodes(prefix_trie.trie(*prefix_trie.plain(df))) == plain_trie({c: [x[2] for x in sorted(v)] for c, v in own.items()})
    for made in (prefix_trie.plain, prefix_trie.rebuilt):
        assert prefix_trie.trie(*made(df.limit(0))).count() == 0


# --- 13 packing ---


def plain_ids(tok, text):
    return tok.encode(text or "", add_special_tokens=False).ids + [1]


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    return path, tok


def check_packed(rows, ids_of, size):
    """rows: all pieces. ids_of: the ids of each document, in any order."""
    sequences = defaultdict(list)
    for x in rows:
        sequences[x["sequence_id"]].append(x)
        assert len(x["ids"]) == 4 * x["length"] > 0
    padding = 0
    for pieces in sequences.values():
        at = 0
        for x in sorted(pieces, key=lambda x: x["offset"]):
            assert x["offset"] == at
            at += x["length"]
        assert at <= size
        padding += 0 if at & (at - 1) == 0 else size - at
    docs = defaultdict(list)
    for x in rows:
        docs[x["doc_id"]].append(x)
    got = Counter()
    for d, pieces in docs.items():  # rows that share an id: their pieces, start by start
        starts = defaultdict(list)
        for x in pieces:
            starts[x["start"]].append((bytes(x["ids"]), x["doc_tokens"]))
        if len(starts[0]) == 1:
            whole = b"".join(starts[s][0][0] for s in sorted(starts))
            assert all(s == 0 or s == sum(len(starts[t][0][0]) for t in starts if t < s) // 4 for s in starts)
            assert {n for v in starts.values() for _, n in v} == {len(whole) // 4}
            got[d, whole] += 1
        else:
            got[d, None] += len(starts[0])
    total = sum(len(x) for _, x in ids_of)
    assert sum(x["length"] for x in rows) == total
    want = Counter(d for d, _ in ids_of)
    for (d, whole), n in got.items():
        assert n == want[d]
        if whole is not None:
            assert [x for k, x in ids_of if k == d] == [[int.from_bytes(whole[i : i + 4], "little") for i in range(0, len(whole), 4)]]
    return padding / max(1, total)


@pytest.mark.parametrize("size", [2048, 64])
def test_packing(spark, edge_docs, edge_rows, no_docs, tokenizer, size):
    path, tok = tokenizer
    out = packing.pack(packing.tokenised(edge_docs, path, size=size), size)
    ids_of = [(d, plain_ids(tok, t)) for d, t, *_ in edge_rows]
    rows = out.collect()
    assert check_packed(rows, ids_of, size) == 0
    assert {len(x["ids"]) for x in packing.assembled(out).collect() if x["n_tokens"] == size} <= {4 * size}
    assert packing.pack(packing.tokenised(no_docs, path)).count() == 0


def test_tokenised_texts(spark, tokenizer):
    """Texts of every kind get the tokenizer's ids: marks, special names, other scripts, normal forms, no spaces."""
    path, tok = tokenizer
    r = random.Random(2)
    alphabet = "abzABZ019 \n\t.,'’-_*¡ÄßéÿĀŉŁİıſƀ ­\u0085̀ 漢字🎉Σσς½²ªº"
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 40))) for _ in range(1500)]
    texts += ["don't we'll THEY'RE x's 'tis <|endoftext|> <|startoftext|>", "é é", "ﬁ ① ㍿", "İstanbul", "a" * 5000, "</w> x</w>y", "1234567 3rd x2y"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = packing.tokenised(rows, path, size=1 << 20).collect()
    assert len(out) == len(texts)
    for x in out:
        want = plain_ids(tok, texts[x["doc_id"]])
        assert [int.from_bytes(x["ids"][i : i + 4], "little") for i in range(0, len(x["ids"]), 4)] == want, texts[x["doc_id"]]
    assert packing.parts_of("ab cd\nef gh", 3) == ["ab cd", "ef gh"]


def test_plan_fills_sequences():
    """Plans of many histograms: each piece has a place, full sequences but for powers of two."""
    r = random.Random(4)
    for size in (16, 64, 2048):
        for _ in range(20):
            histogram = {r.randint(1, size - 1): r.choice([1, 2, 7, 1000]) for _ in range(r.randint(1, 40))}
            p = packing.plan(histogram, size)
            placed = Counter()
            for length, _, n, *_ in p.slots:
                placed[length] += n
            assert placed == Counter(histogram)
            assert len(p.slots) <= 4 * size
            given = sum(n * fill for _, n, fill, _ in p.donors)
            filled = sum(width * n for _, width, n, *_ in p.gaps)
            assert given == filled


def test_ascii_words_are_encoded_without_alignments():
    """Texts of ASCII words need no call of the tokenizer; all ids are what it gives, across batches and with characters of all kinds."""
    import random

    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), "rb") as f:
        e = packing.Encoder(f.read())
    draw, signs = random.Random(5), [chr(i) for i in range(32, 0x180)] + ["\n", "\t", "汉", "é", "🙂"]
    texts = ["", " ", "\n\n", "İstanbul ıs", "it's I'LL 12a3 ¼", *("".join(draw.choices(signs, k=draw.randint(0, 40))) for _ in range(300))]
    want = [e.ids(t) for t in texts]
    assert e.encode(texts) == want == [x for t in texts for x in e.encode([t])] and e.encode([]) == []
    plain = ["Some plain words, (really) plain: it's 42.", "more of them\nand more"]
    want = [e.ids(t) for t in plain]
    e.tokenizer = None
    assert e.encode(plain) == want


def test_groups_of_texts_are_bounded(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(packing, "GROUP", 100)
    batches = [pa.RecordBatch.from_pydict({"doc_id": list(range(a, a + 700)), "text": ["x" * (i % 60) for i in range(a, a + 700)]}) for a in (0, 700)]
    got = list(packing.groups(iter(batches)))
    assert [d for docs, _ in got for d in docs] == list(range(1400))
    assert max(sum(map(len, texts)) for _, texts in got) <= 160 and min(sum(map(len, texts)) for _, texts in got[:-1]) > 100
