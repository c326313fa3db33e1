"""Soft-membership mixing: rates for documents whose expected domain token totals meet target weights.

1. A naive Bayes classifier over hashed words, fitted on a labelled table (at most LABELLED rows, those with the smallest hashed
   ids), gives every document a posterior over the domains. Words count by their share of the text, times SHARPNESS,
   so posteriors stay soft for long texts.
2. A document with n tokens and posterior p has expected tokens n*p in the domains. Rates r >= least, starting at 1,
   are fitted so that the sums of r*n*p meet the targets in least squares. A step of the projected gradient changes r by
   -p.v and cuts it at `least`; v is the residual scaled by the inverse Gram matrix of the documents that are not cut. Every step is one
   aggregation of one vector (totals and Gram matrix) and runs over all documents; the rates follow from the steps' vectors, so nothing else is
   kept between steps. The fit ends when totals are within CLOSE of their targets, when five steps bring nothing, or after
   STEPS steps; each row tells its domain's target and fitted total, so a target that cannot be met is seen.
3. Documents are drawn as floor(rate) copies and one more with the chance of what is left, decided by a hash of id and text.

By default the weights are the domains' own shares to the power 0.7, and the total is the smallest with which no domain must shrink;
with `least` = 1 every document is then drawn at least once.

Null and empty texts have no tokens, the prior as posterior, and rate 1. Documents may repeat ids; each row has its own
rate. Without a labelled row all documents are of one domain, `none`. Domains that are null are not labels.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.classification import NaiveBayes
from pyspark.ml.feature import ElementwiseProduct, HashingTF, Normalizer, StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopwise.llm.shared import set_apart, stored

LABELLED, HASHED_WORDS, SHARPNESS, STEPS, CLOSE = 5_000, 1 << 14, 25.0, 25, 1e-5


def _words(docs: DataFrame, text: Column) -> DataFrame:
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[\x09-\x0D]", " "))
    docs = docs.withColumn("__words", F.filter(F.split(plain, " "), lambda w: w != ""))
    return docs.withColumn("__tokens", F.size("__words"))


def _features(docs: DataFrame) -> DataFrame:
    docs = HashingTF(numFeatures=HASHED_WORDS, inputCol="__words", outputCol="__tf").transform(docs)
    docs = Normalizer(p=1.0, inputCol="__tf", outputCol="__share").transform(docs)
    return ElementwiseProduct(scalingVec=Vectors.dense([SHARPNESS] * HASHED_WORDS), inputCol="__share", outputCol="__features").transform(docs)


def posteriors(docs: DataFrame, labelled: DataFrame, text_col: str = "text") -> tuple[DataFrame, list[str]]:
    """docs with `n_tokens` and `posterior`, an array over the returned domains; labelled: (text, domain)."""
    known = stored(_words(labelled.dropna(subset=["domain"]), F.col("text").cast("string")).where("__tokens > 0").select("__words", F.col("domain").cast("string").alias("domain")))
    counted = docs.withColumn("__text", F.col(text_col).cast("string"))
    counted = _words(counted, F.col("__text")).drop("__text")
    if known.isEmpty():
        return counted.withColumns({"n_tokens": F.col("__tokens").cast("long"), "posterior": F.array(F.lit(1.0))}).drop("__words", "__tokens"), ["none"]
    index = StringIndexer(inputCol="domain", outputCol="__label", stringOrderType="alphabetAsc").fit(known)
    domains = list(index.labels)
    if len(domains) == 1:
        return counted.withColumns({"n_tokens": F.col("__tokens").cast("long"), "posterior": F.array(F.lit(1.0))}).drop("__words", "__tokens"), domains
    bayes = NaiveBayes(labelCol="__label", featuresCol="__features", probabilityCol="__p", rawPredictionCol="", predictionCol="", smoothing=0.1)
    fitted = bayes.fit(_features(index.transform(known)))
    out = fitted.transform(_features(counted)).withColumns({"n_tokens": F.col("__tokens").cast("long"), "posterior": vector_to_array("__p")})
    return out.drop("__words", "__tokens", "__tf", "__share", "__features", "__p"), domains


def _after(steps: list[list[float]], p: Column, least: float) -> Column:
    rate = F.lit(1.0)
    for v in steps:
        change = F.aggregate(F.zip_with(p, F.lit(v), lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)
        rate = F.greatest(rate - change, F.lit(float(least)))
    return rate


def fitted_rates(known: DataFrame, domains: list[str], weights: dict[str, float] | None = None, least: float = 1.0) -> tuple[Callable[[Column], Column], dict[str, tuple[float, float]]]:
    """The rate as a function of the posterior, and each domain's target and fitted token total; known: (n_tokens, posterior)."""
    k = len(domains)
    n, p = F.col("n_tokens").cast("double"), F.col("posterior")
    known = known.where("n_tokens > 0")
    if known.isEmpty():
        return lambda p: F.lit(1.0), {d: (0.0, 0.0) for d in domains}

    def totals(steps: list[list[float]]) -> tuple[np.ndarray, np.ndarray]:
        rated = known.select(n.alias("n"), p.alias("posterior"), _after(steps, p, least).alias("r"))
        free = F.when((F.col("r") > least) | F.lit(not steps), F.col("n")).otherwise(0.0)
        sums = F.transform("posterior", lambda x: F.col("r") * F.col("n") * x)
        outer = F.flatten(F.transform("posterior", lambda x: F.transform("posterior", lambda y: free * x * y)))
        row = rated.select(Summarizer.sum(array_to_vector(F.concat(sums, outer))).alias("s")).first()["s"].toArray()
        return row[:k], row[k:].reshape(k, k)

    now, gram = totals([])
    if weights is None:
        share = np.where(now > 0, now / now.sum(), 0) ** 0.7
    else:
        share = np.array([weights.get(d, 0.0) for d in domains])
    share = share / share.sum()
    with np.errstate(divide="ignore"):
        total = float(np.max(np.where(share > 0, now / share, 0))) if least >= 1 else float(now.sum())
    target = share * total
    steps: list[list[float]] = []
    best = (np.inf, 0)
    for _ in range(STEPS):
        off = float(np.abs(now - target).max() / total)
        if off < best[0]:
            best = (off, len(steps))
        if off < CLOSE or len(steps) - best[1] >= 5:
            break
        ridge = np.eye(k) * (1e-9 * max(np.trace(gram), 1.0))
        steps.append(np.linalg.solve(gram + ridge, now - target).tolist())
        now, gram = totals(steps)
    steps = steps[: best[1]]
    now, _ = totals(steps)
    return lambda p: _after(steps, p, least), {d: (float(t), float(x)) for d, t, x in zip(domains, target, now, strict=True)}


def mixed(docs: DataFrame, labelled: DataFrame, weights: dict[str, float] | None = None, least: float = 1.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, domain, posterior, rate, copies, domain_target, domain_fitted): one row per input row; the last two are tokens."""
    u = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col), F.lit(5)), F.lit(1 << 52)) / F.lit(float(1 << 52))
    known, domains = posteriors(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), u.alias("u")), labelled)
    known = stored(known.select("doc_id", "n_tokens", "posterior", "u"))
    rate, totals = fitted_rates(known, domains, weights, least)
    most = F.array_max("posterior")
    names = F.array(*[F.lit(d) for d in domains])
    out = known.withColumn("rate", F.when(F.col("n_tokens") > 0, rate(F.col("posterior"))).otherwise(F.lit(1.0)))
    copies = F.floor("rate") + (F.col("u") < F.col("rate") - F.floor("rate")).cast("long")
    at = (F.array_position("posterior", most) - 1).cast("int")
    told = [F.get(F.lit([totals[d][i] for d in domains]), at).alias(c) for i, c in enumerate(("domain_target", "domain_fitted"))]
    return out.select("doc_id", "n_tokens", F.get(names, at).alias("domain"), most.alias("posterior"), "rate", copies.alias("copies"), *told)


def labelled_rows(docs: DataFrame, labels: DataFrame, domain_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", bound: int = LABELLED) -> DataFrame:
    """(text, domain) of at most `bound` documents that the table of labels lists, by hashed id."""
    listed = labels.select(F.col(id_col).alias("doc_id")).dropna().distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(domain_col).alias("domain"))
    return rows.join(F.broadcast(listed), "doc_id").select("text", "domain")


def drawn(docs: DataFrame, labelled: DataFrame, weights: dict[str, float] | None = None, least: float = 1.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, each as often as it is drawn, with all their columns."""
    columns = docs.columns
    docs, place = set_apart(docs)
    id_col, text_col = place[id_col], place[text_col]
    known, domains = posteriors(docs, labelled, text_col)
    rate, _ = fitted_rates(stored(known.select("n_tokens", "posterior")), domains, weights, least)
    u = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col), F.lit(5)), F.lit(1 << 52)) / F.lit(float(1 << 52))

    def copies(row: Column) -> Column:
        # within a lambda the posterior is a value; as a column the optimizer would repeat the classifier at each mention
        one = F.transform(F.array(F.when(row["n"] > 0, rate(row["p"])).otherwise(F.lit(1.0))), lambda r: (F.floor(r) + (row["u"] < r - F.floor(r)).cast("long")).cast("int"))
        return F.array_repeat(F.lit(1), F.get(one, 0))

    row = F.struct(F.col("n_tokens").alias("n"), F.col("posterior").alias("p"), u.alias("u"))
    return known.withColumn("__copy", F.explode(F.flatten(F.transform(F.array(row), copies)))).select(*place.values()).toDF(*columns)
