"""The registered queries of the training-data operators, with DuckDB SQL where SQL can express the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopwise.llm import conversations, decontamination, embedding, html_text, minhash, mixing, packing, secrets, sharding, substrings, toxicity, urls, vector_codes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding.near_vectors(table(spark, sf_dir, "embeddings"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.mixed(docs, mixing.labelled_rows(docs, table(spark, sf_dir, "labels")))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), shortest=1)


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(table(spark, sf_dir, "pages"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(table(spark, sf_dir, "documents"))


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(table(spark, sf_dir, "pages"), urls.listed(spark))


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.without_repeats(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = toxicity.scored(docs, table(spark, sf_dir, "labels"))
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    return found.select("doc_id", held_out.alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.7).cast("int").alias("predicted"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.coded(table(spark, sf_dir, "embeddings"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.damaged_and_repaired(table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_embedding": op1_embedding,
    "op2_mixing": op2_mixing,
    "op3_decontamination": op3_decontamination,
    "op4_secrets": op4_secrets,
    "op5_minhash": op5_minhash,
    "op6_html": op6_html,
    "op7_sharding": op7_sharding,
    "op8_urls": op8_urls,
    "op9_substrings": op9_substrings,
    "op10_toxicity": op10_toxicity,
    "op11_vector_codes": op11_vector_codes,
    "op12_packing": op12_packing,
    "op13_conversations": op13_conversations,
}

COMPONENTS = """
reach(a, b) as (select a, b from links union select r.a, l.b from reach r join links l on l.a = r.b),
comp as (select a as id, least(a, min(b)) as component_id from reach group by a)
"""

ORACLE_1 = f"""
with recursive v as materialized (select vec_id, cast(embedding as double[]) as e from embeddings
  where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and list_sum(list_transform(embedding, lambda x: abs(x))) > 0),
links as materialized (select x.vec_id as a, y.vec_id as b from v x join v y on x.vec_id <> y.vec_id and len(x.e) = len(y.e) where list_cosine_similarity(x.e, y.e) >= 0.95),
n as (select a as id, count(*) as n from links group by a),
{COMPONENTS}
select vec_id, coalesce(n, 0) as n_links, coalesce(component_id, vec_id) as component_id, coalesce(component_id, vec_id) = vec_id as kept
from embeddings left join n on n.id = vec_id left join comp on comp.id = vec_id
"""

ORACLE_5 = rf"""
with recursive w as materialized (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as materialized (select distinct doc_id, unnest(case when len(w) >= 4 then list_transform(range(1, len(w) - 2), lambda i: array_to_string(list_slice(w, i, i + 3), ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from w),
n as materialized (select doc_id, count(*) as n from s group by doc_id),
pairs as (select x.doc_id as a, y.doc_id as b, count(*) as shared from s x join s y on x.s = y.s and x.doc_id <> y.doc_id group by 1, 2),
links as materialized (select a, b from pairs join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * shared >= 80 * (na.n + nb.n - shared)),
{COMPONENTS}
select d.doc_id, coalesce(n, 0) as n_shingles, coalesce(component_id, d.doc_id) as component_id, coalesce(component_id, d.doc_id) = d.doc_id as kept
from documents d left join n on n.doc_id = d.doc_id left join comp on comp.id = d.doc_id
"""

ORACLE_9 = r"""
with w as materialized (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
g as materialized (select doc_id, i, md5(array_to_string(list_slice(w, i, i + 49), ' ')) as g from (select doc_id, w, unnest(range(1, len(w) - 48)) as i from w where len(w) >= 50)),
f as (select g, min(doc_id) as least from g group by g),
gone as (select doc_id, unnest(range(i, i + 50)) as j from g join f using (g) where least < doc_id),
removed as (select doc_id, list(distinct j) as js from gone group by doc_id),
k as (select doc_id, w, coalesce(len(js), 0) as n_removed, js from w left join removed using (doc_id))
select doc_id, len(w) as n_words, n_removed, sha256(case when n_removed = 0 then array_to_string(w, ' ') else array_to_string(list_filter(w, lambda x, i: not list_contains(js, i)), ' ') end) as kept_sha256 from k
"""

ORACLES: dict[str, str] = {"op1_embedding": ORACLE_1, "op5_minhash": ORACLE_5, "op8_urls": urls.ORACLE, "op9_substrings": ORACLE_9, "op11_vector_codes": vector_codes.ORACLE, "op13_conversations": conversations.ORACLE}
