"""URL rules: a blocked Bloom filter of the listed canonical URLs, then an exact hash join.

A rule has a host and a path. It fits a URL if the URL's host is the rule's host or a subdomain of it and the URL's path
starts with the rule's path; the longest rule wins (host and path together; at equal length `block`, then the greater text).
A URL's candidate keys are its host's last labels, as many as some rule's host has, combined with its path cut to each length that some rule's path
has. Each key picks one 64-bit
block and sets four bits in it. The list's blocks, 16 bits a rule and MOST_BLOCKS at most (a longer list only lets more keys
through), are a small table that is broadcast at any size of the list, so keys are tested where they are made, before any
exchange. Those whose bits are all set go on to the exact join with the rules, which removes the false positives; the rules are broadcast
up to BROADCAST_RULES and shuffled with the possible hits beyond. A URL that no rule fits gets the verdict `allow`.

Hits are joined once for each distinct URL. Null URLs and those without `://` have empty host and path, fit no
rule, are allowed and take part in no join. Rules with a null part are ignored; repeated rules count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hopwise.llm.shared import checkpointed

BITS_PER_KEY, BITS_SET = 16, 4
BROADCAST_RULES, BROADCAST_HITS, MOST_BLOCKS = 100_000, 200_000, 1 << 20
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def listed(spark: SparkSession, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(rules, "verdict string, host string, path string")


def _folded(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _labels(host: str) -> Column:
    return F.length(host) - F.length(F.replace(F.col(host), F.lit("."), F.lit(""))) + 1


def host_and_path(url: Column) -> tuple[Column, Column]:
    has = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    after = F.substring_index(F.regexp_replace(url, r"(?s)^.*?://", ""), "#", 1)
    after = F.substring_index(after, "?", 1)
    host = _folded(F.substring_index(after, "/", 1))
    path = F.substring(after, F.length(F.substring_index(after, "/", 1)) + 1, F.length(after))
    return F.when(has, host).otherwise(""), F.when(has, path).otherwise("")


def _place(key: Column, blocks: int) -> tuple[Column, Column]:
    """Block number and the bits within the block."""
    h = F.xxhash64(key)
    block = F.pmod(h, F.lit(blocks)).cast("int")
    g = F.xxhash64(key, F.lit(7))
    bits = F.lit(0).cast("long")
    for i in range(BITS_SET):
        bits = bits.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(g, 12 * i).bitwiseAND(F.lit(63)).cast("int")))
    return block, bits


def judged(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict): one row per input row."""
    host, path = host_and_path(F.col(url_col).cast("string"))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rules = rules.dropna(subset=["host", "path", "verdict"]).select(_folded(F.col("host")).alias("rule_host"), F.col("path").alias("rule_path"), F.col("verdict").alias("rule_verdict")).distinct()
    rules = rules.withColumn("key", F.concat("rule_host", "rule_path"))
    about = rules.agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set(F.length("rule_path"))).alias("lengths"), F.array_sort(F.collect_set(_labels("rule_host"))).alias("labels")).first()
    lengths, labels = (F.array(*[F.lit(n) for n in about[k]]) if about[k] else F.array().cast("array<int>") for k in ("lengths", "labels"))
    blocks = min(MOST_BLOCKS, max(1, -(-about["n"] * BITS_PER_KEY // 64)))
    block, bits = _place(F.col("key"), blocks)
    bloom = rules.select(block.alias("block"), bits.alias("bits")).groupBy("block").agg(F.bit_or("bits").alias("filled"))

    keys = rows.where("host <> ''").select("host", "path", _labels("host").alias("of")).select("host", "path", F.explode(F.filter(labels, lambda n: n <= F.col("of"))).alias("last"))
    keys = keys.withColumn("suffix", F.expr("substring_index(host, '.', -last)")).select("host", "path", "suffix", F.explode(F.filter(lengths, lambda n: n <= F.length("path"))).alias("cut"))
    keys = keys.withColumn("key", F.concat("suffix", F.expr("substring(path, 1, cut)")))
    block, bits = _place(F.col("key"), blocks)
    keys = keys.withColumns({"block": block, "bits": bits})
    possible = keys.join(F.broadcast(bloom), "block").where(F.col("filled").bitwiseAND(F.col("bits")) == F.col("bits")).select("host", "path", "suffix", "cut", "key")
    rules = F.broadcast(rules) if about["n"] <= BROADCAST_RULES else rules
    possible = possible if about["n"] <= BROADCAST_RULES else possible.distinct()
    exact = possible.join(rules, (possible.suffix == rules.rule_host) & (F.expr("substring(path, 1, cut)") == rules.rule_path) & (possible.key == rules.key))
    best = F.max(F.struct(F.length("rule_host") + F.length("rule_path"), F.col("rule_verdict").alias("v"), F.concat("rule_host", "rule_path").alias("rule")))
    won = checkpointed(exact.groupBy("host", "path").agg(best.alias("best")).select("host", "path", F.col("best.rule").alias("rule"), F.col("best.v").alias("verdict")))
    won = F.broadcast(won) if won.count() <= BROADCAST_HITS else won
    none = F.lit(None).cast("string")
    out = rows.where("host <> ''").join(won, ["host", "path"], "left").select("page_id", "host", "path", "rule", "verdict")
    out = out.union(rows.where("host = ''").select("page_id", "host", "path", none.alias("rule"), none.alias("verdict")))
    return out.withColumn("verdict", F.coalesce("verdict", F.lit("allow")))


ORACLE = r"""
with r(rv, rh, rp) as (values ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
                              ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
a as (select page_id, url, case when url like '%://%' then regexp_replace(regexp_replace(url, '^.*?://', '', 's'), '[?#].*$', '', 's') else '' end as t from pages),
p as (select row_number() over () as n, page_id, translate(split_part(t, '/', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
             substr(t, length(split_part(t, '/', 1)) + 1) as path from a),
f as (select n, rv, rh || rp as rule, row_number() over (partition by n order by length(rh || rp) desc, rv desc, rh || rp desc) as k
      from p join r on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp))
select page_id, host, path, rule, coalesce(rv, 'allow') as verdict from p left join (select * from f where k = 1) using (n)
"""
