"""The subpackage's queries: opN_<name> -> (callable, DuckDB SQL or None)."""
from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillpoint.llm import fingerprints, jaccard_join, language_id, mixing, packing, quality_model, quality_rules, ranked_search, spelling, token_counts, token_files, url_filter, vector_links

#: (verdict, host + path) of the url rules of the query.
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
SEQUENCE = 2048


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_files.write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return token_files.read_token_digests(spark, path)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=512)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.train_language_model(docs, ~language_id.held_out())
    return language_id.identify_languages(docs, model).select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_model.train_quality_model(docs, table(spark, sf_dir, "labels"), lambda: ~quality_model.held_out())
    return quality_model.score_quality(docs, model).select("doc_id", quality_model.held_out().alias("held_out"), "score", "predicted")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link_documents(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, placed = packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0, size=SEQUENCE)
    return placed


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_order(table(spark, sf_dir, "documents"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge_documents(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.col("posterior"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_links.link_vectors(table(spark, sf_dir, "embeddings"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


_RULE_ROWS = ", ".join(f"('{v}', '{s[:s.index('/')]}', '{s[s.index('/'):]}')" for v, s in URL_RULES)

OP6_SQL = f"""
with rules(verdict, host, path) as (values {_RULE_ROWS}),
rest as (
  select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as r from pages),
parts as (
  select page_id, translate(regexp_extract(r, '^[^/?#]*', 0), '{url_filter.UPPER}', '{url_filter.LOWER}') as host,
         regexp_extract(r, '^[^/?#]*([^?#]*)', 1) as path from rest),
fit as (
  select p.page_id, r.verdict, r.host || r.path as rule,
         row_number() over (partition by p.page_id order by length(r.host || r.path) desc) as nth
  from parts p join rules r on (p.host = r.host or ends_with(p.host, '.' || r.host)) and starts_with(p.path, r.path))
select p.page_id, p.host, p.path, f.rule as rule, coalesce(f.verdict, 'allow') as verdict
from parts p left join fit f on f.page_id = p.page_id and f.nth = 1
"""


OP11_SQL = f"""
with recursive sound as (
  select vec_id, label, embedding::double[] as v from embeddings
  where label is not null and embedding is not null and len(embedding) = len(list_filter(embedding, lambda x: x is not null and isfinite(x)))
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (
  select a.vec_id as a, b.vec_id as b from sound a join sound b on a.label = b.label and a.vec_id <> b.vec_id and len(a.v) = len(b.v)
  where list_cosine_similarity(a.v, b.v) >= {vector_links.THRESHOLD}),
reached(a, b) as (select vec_id, vec_id from embeddings union select r.a, l.b from reached r join links l on r.b = l.a),
component as (select a, min(b) as component_id from reached group by a),
degree as (select a, count(*) as n from links group by a)
select e.vec_id, coalesce(d.n, 0) as n_links, c.component_id, e.vec_id = c.component_id as kept
from embeddings e join component c on c.a = e.vec_id left join degree d on d.a = e.vec_id
"""

_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

OP12_SQL = f"""
with found as (
  select doc_id, unnest(regexp_extract_all(translate(text, '{url_filter.UPPER}', '{url_filter.LOWER}'), '{_TERM}')) as term from documents),
tf as (select doc_id, term, count(*) as tf from found group by doc_id, term),
sizes as (select doc_id, sum(tf) as n from tf group by doc_id),
totals as (select count(*) as n_docs, sum(n) as l from sizes),
df as (select term, count(*) as df from tf group by term),
weights as (select term, floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::bigint as w from df, totals),
asked as (
  select distinct item_id, unnest(regexp_extract_all(translate(text, '{url_filter.UPPER}', '{url_filter.LOWER}'), '{_TERM}')) as term from benchmark),
scored as (
  select a.item_id, f.doc_id, sum(w * ((1000000000 * f.tf) // (1000 * f.tf + 20 * (100 - 50 + ((50 * s.n * n_docs) // l)))))::bigint as score
  from asked a join weights using (term) join tf f using (term) join sizes s on s.doc_id = f.doc_id, totals
  group by a.item_id, f.doc_id),
placed as (
  select item_id, row_number() over (partition by item_id order by score desc, doc_id)::int as rank, doc_id, score from scored where score > 0)
select item_id, rank, doc_id, score from placed where rank <= {ranked_search.TOP}
"""


def registry() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]]:
    return {
        "op1_token_files": (op1, None), "op2_token_counts": (op2, None), "op3_language_id": (op3, None),
        "op4_quality_classifier": (op4, None), "op5_jaccard_join": (op5, None), "op6_url_filter": (op6, OP6_SQL),
        "op7_best_two_fit_packing": (op7, None), "op8_source_mixing": (op8, None), "op9_quality_rules": (op9, None),
        "op10_fingerprints": (op10, None), "op11_vector_links": (op11, OP11_SQL), "op12_ranked_search": (op12, OP12_SQL),
        "op13_spelling_variants": (op13, None),
    }
