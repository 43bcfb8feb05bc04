"""Queries of the corpus operators over the given tables, with production parameters, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.llm import bpe, common, exact_dedup, language_id, line_dedup, lm_scoring, mixing, ngram_join, packing, prefix_trie, spelling, substring_dedup, topk_search, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("text_key", "copies")


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.n_gram_join(table(spark, sf_dir, "documents"), k=4, percent=85).drop("text_key")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = language_id.predict(docs, language_id.fit(docs, folds=4, held=2))
    return out.select("doc_id", F.coalesce(common.id_bucket("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_common_lines(table(spark, sf_dir, "documents"), min_docs=10)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents")).drop("text_key")


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return lm_scoring.score(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), folds=5, held=1, learned=True)


def op9_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(table(spark, sf_dir, "embeddings"), k=5, every=50, scale=256)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(table(spark, sf_dir, "documents")).drop("text_key")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.vocabulary(table(spark, sf_dir, "documents"), least_chars=6, least_n=5, every=199)
    return spelling.spelling_groups(words, times=5)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, convs = prefix_trie.rebuilt(table(spark, sf_dir, "conversations"))
    return prefix_trie.trie(turns, convs).drop("digest")


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = packing.pack(packing.tokenised(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


QUERIES = {f.__name__: f for f in (op1_mixing, op2_ngram_join, op3_language_id, op4_line_dedup, op5_warc, op6_bpe, op7_exact_dedup, op8_lm_scoring, op9_topk_search, op10_substring_dedup, op11_spelling, op12_prefix_trie, op13_packing)}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES = {
    "op1_mixing": r"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
    ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 15))::bigint as place
  from documents),
s0 as (select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) as rank from d group by source),
s1 as (select *, 2 * source_size as cap, [3, 1, 2][1 + ((rank - 1) % 3)] as weight from s0),
s2 as (select *, cap::double / weight as ratio, sum(source_size) over ()::double * 1.5::double as budget, sum(weight) over ()::bigint as weights from s1),
s3 as (select *, coalesce(sum(cap) over w, 0)::bigint as capped, coalesce(sum(weight) over w, 0)::bigint as past from s2
  window w as (order by ratio, rank rows between unbounded preceding and 1 preceding)),
s4 as (select *, max((budget - capped) / (weights - past)) over () as level from s3),
src as (select *, case when ratio <= level then cap::double else level * weight end as target from s4),
p as (select d.*, src.source_size, src.target, src.budget, src.weight, src.rank,
    sum(size) over (partition by src.rank order by place, doc_id nulls last, size rows between unbounded preceding and current row) as upto
  from d join src on d.source is not distinct from src.source),
c as (select doc_id, size, rank, budget, e, (upto + source_size * e)::double / weight as finish from p, (values (0), (1)) t(e) where size > 0),
r as (select *, sum(size) over (order by finish, rank rows between unbounded preceding and current row) as total from c),
cut as (select max({'a': finish, 'b': rank}) as m from r where total <= budget)
select p.doc_id, p.size, p.source, p.source_size, p.target,
  (p.size * (case when p.size > 0 and {'a': upto::double / weight, 'b': rank} <= cut.m then 1 else 0 end
    + case when p.size > 0 and {'a': (upto + source_size)::double / weight, 'b': rank} <= cut.m then 1 else 0 end))::bigint as taken
from p, cut""",
    "op2_ngram_join": f"""
with recursive d as (
  select doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') as w from documents),
s as (
  select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 4 then [w]
    else list_transform(range(1, len(w) - 2), lambda i: w[i:i+3]) end) as g from d),
n as (select d.doc_id, count(s.g) as n from d left join s on s.doc_id = d.doc_id group by d.doc_id),
h as (select doc_id, hash(g) as g from s),
i as (select a.doc_id as a, b.doc_id as b, count(*) as k from h a join h b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from i join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * k >= 85 * (na.n + nb.n - k)),
e as (select a, b from l union all select b, a from l),
r as (select doc_id, doc_id as c from d union select e.b, r.c from r join e on e.a = r.doc_id)
select n.doc_id, n.n as n_shingles, min(r.c) as component_id from n join r on r.doc_id = n.doc_id group by 1, 2""",
    "op4_line_dedup": f"""
with l as (
  select row_number() over () as r, doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos
  from documents),
k as (select *, {_LOWER.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} as key from l),
hot as (select key from k where key <> '' group by key having count(distinct r) >= 10),
m as (select r, doc_id, line, pos, key in (select key from hot) as hit from k)
select any_value(doc_id) as doc_id, count(*) as n_lines, count(*) filter (hit) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not hit), '')) as kept_sha256
from m group by r""",
    "op5_warc": """
with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, octet_length(encode(html))::bigint as payload_bytes, sha256(html) as payload_digest from p),
g as (select payload_digest, min(page_id) as first_id from d where payload_bytes >= 100 group by payload_digest)
select d.page_id, payload_bytes, d.payload_digest,
  case when first_id is not null and first_id <> page_id then 'revisit' else 'response' end as record_type,
  case when first_id is not null and first_id <> page_id then first_id end as refers_to
from d left join g on d.payload_digest = g.payload_digest""",
    "op7_exact_dedup": f"""
with d as (select doc_id, {_LOWER.format("coalesce(text, '')")} as t from documents),
g as (select t, max(doc_id) as keep_id, count(*) as group_size from d group by t)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(d.t) as text_sha256 from d join g on d.t = g.t""",
    "op9_topk_search": """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
p as (
  select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::bigint as score
  from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from p)
select query_id, rank::int as rank, vec_id, score from r where rank <= 5""",
}
