"""The pipeline's stages against plain versions, each on its own input."""

from __future__ import annotations

from collections import Counter

import pytest

import corpus_pipeline
from loam.llm.common import staged
from tests.llm.test_operators import lower, plain_components, sha


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = [docs]
    for _, f in corpus_pipeline.STAGES:
        out.append(staged(f(spark, out[-1], "/root/testdata/sf0.001"), "step"))
    return [x.collect() for x in out], [x.columns for x in out]


def test_stages(steps):
    (docs, known, single, apart, mixed, tokens), columns = steps
    assert all(c == columns[0] for c in columns[:5])
    assert {r["doc_id"] for r in known} <= {r["doc_id"] for r in docs} and len(known) >= 0.995 * len(docs)
    best = {}
    for r in known:
        best[lower(r["text"])] = max(r["doc_id"], best.get(lower(r["text"]), -1))
    assert sorted(r["doc_id"] for r in single) == sorted(best.values())
    rows = [(r["doc_id"], r["text"]) for r in single]
    assert sorted(r["doc_id"] for r in apart) == sorted(d for d, _, c in plain_components(rows, 5, 80) if c == d)
    drawn = Counter(r["doc_id"] for r in mixed)
    words = {r["doc_id"]: len(r["text"].split()) for r in apart}
    assert max(drawn.values()) <= 2 and set(drawn) <= set(words)
    assert abs(sum(words[d] * n for d, n in drawn.items()) - 1.5 * sum(words.values())) <= max(words.values())
    import public_tokenizers as p

    from loam.llm import bpe

    tok = bpe.tokenizer(*bpe.sent(p.path("byte_bpe_50k.tiktoken")), p.PATTERN)
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in tokens) == Counter((r["doc_id"], tuple(tok.encode(r["text"]))) for r in mixed)
    assert Counter((r["doc_id"], r["decoded_sha256"]) for r in tokens) == Counter((r["doc_id"], sha(r["text"])) for r in mixed)


def test_first_stage_takes_effect(spark):
    """Clean documents stay, all of them; foreign and junk rows go, and missing languages are filled in."""
    from tests.llm.test_operators import planted_languages

    clean = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = clean.collect()
    planted = planted_languages(spark, rows)
    own = planted.withColumn("doc_id", planted["doc_id"] + 1_000_000)
    docs = clean.select("doc_id", "text", "lang", "source").unionByName(own.where("lang is null or lang <> 'x'"))
    kept = {r["doc_id"]: r["lang"] for r in corpus_pipeline.identify(spark, docs, "").collect()}
    assert {d for d in kept if d >= 1_000_000} == {1_000_001, 1_000_003} and kept[1_000_001] == rows[0]["lang"]
    assert sum(d < 1_000_000 for d in kept) >= 0.999 * len(rows)


@pytest.mark.parametrize("empty", [False, True])
def test_chain_on_strange_tables(spark, edge_docs, empty):
    """All stages, one after the other, over nulls, repeats, long texts and clashing names; and over no rows."""
    docs = edge_docs.limit(0) if empty else edge_docs
    columns = docs.columns
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = staged(stage(spark, docs, ""), "strange")
        assert i == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns
    assert docs.count() == 0 if empty else docs.count() > 0


def test_run(spark, steps):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() == len(steps[0][-1])
