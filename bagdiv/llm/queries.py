"""The queries of this subpackage: each operator over its whole table, with the columns of its contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, embedding_near_dup, html_extract, importance, kmeans, line_dedup, lm_score, mixing, ngram_jaccard, quality_rules, token_counts, topk, toxicity
from .common import table

BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_embedding_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_near_dup.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.98)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_path(BYTE_BPE), limit=1024)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), tokenizer_path(WORD_BPE), keep=False)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), least=10, keep_text=False)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), lm_score.held_out_fold(5, 0))


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(table(spark, sf_dir, "documents"), lm_score.held_out_fold(7, 2))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.jaccard_components(table(spark, sf_dir, "documents"), percent=85, k=4)


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=5, least_words=20, seed=42)


def op12_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), k=5, every=50)


def op13_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans.clusters(table(spark, sf_dir, "embeddings"), k=40, rounds=5, seed=2, dim=64)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (op1_embedding_near_dup, op2_token_counts, op3_quality_rules, op4_bpe, op5_line_dedup, op6_toxicity, op7_lm_score, op8_ngram_jaccard, op9_html_extract, op10_mixing, op11_importance, op12_top_k, op13_kmeans, pipeline)
    return {f.__name__: f for f in named}


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_COMPONENTS = """
reach as (select id, id as other from ids union select r.id, l.b from reach r join (select a, b from links union select b, a from links) l on r.other = l.a),
components as (select id, min(other) as component_id from reach group by id)
"""

OP1 = f"""
with recursive vectors as (select vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings
  where label is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
unit as (select *, sqrt(list_dot_product(e, e)) as norm from vectors where list_dot_product(e, e) > 0),
links as (select x.vec_id as a, y.vec_id as b from unit x join unit y on x.label = y.label and x.vec_id < y.vec_id and len(x.e) = len(y.e)
  where list_dot_product(x.e, y.e) / (x.norm * y.norm) >= 0.98),
ids as (select vec_id as id from embeddings), {_COMPONENTS},
counts as (select id, count(*) as n from (select a as id from links union all select b from links) group by id)
select c.id as vec_id, coalesce(n, 0)::bigint as n_links, component_id, c.id = component_id as kept from components c left join counts on c.id = counts.id
"""

OP5 = f"""
with lines as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as i from documents),
keyed as (select *, {_LOWER.format(r"regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')")} as key from lines),
shared as (select key, min(doc_id) as owner from keyed where length(key) >= 10 group by key having count(distinct doc_id) > 1),
judged as (select k.*, s.key is null or s.owner = k.doc_id as stays from keyed k left join shared s on k.key = s.key)
select doc_id, count(*)::bigint as n_lines, (count(*) filter (not stays))::bigint as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (stays), '')) as kept_sha256 from judged group by doc_id
"""

OP8 = rf"""
with recursive worded as (select doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') as w from documents),
grams as (select doc_id, unnest(list_distinct(case when len(w) = 0 then []::varchar[] when len(w) < 4 then [array_to_string(w, ' ')]
  else list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) end)) as gram from worded),
sizes as (select doc_id, count(*) as n from grams group by doc_id),
both_ as (select x.doc_id as a, y.doc_id as b, count(*) as n from grams x join grams y on x.gram = y.gram and x.doc_id < y.doc_id group by all),
links as (select a, b from both_ join sizes s on s.doc_id = a join sizes t on t.doc_id = b where 100 * both_.n >= 85 * (s.n + t.n - both_.n)),
ids as (select doc_id as id from documents), {_COMPONENTS}
select c.id as doc_id, coalesce(n, 0)::bigint as n_shingles, component_id from components c left join sizes on c.id = sizes.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_embedding_near_dup": OP1, "op5_line_dedup": OP5, "op8_ngram_jaccard": OP8, "op10_mixing": mixing.ORACLE.replace("{documents}", "documents"), "op11_importance": importance.oracle(), "op12_top_k": topk.ORACLE, "op13_kmeans": kmeans.oracle()}
