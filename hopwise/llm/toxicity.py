"""Toxicity by a weighted lexicon, matched by an Aho-Corasick automaton after folding.

Folding lower-cases, maps look-alike letters and digits to the letters they stand for, and turns everything else into
one space. The lexicon is learned from labelled rows: patterns are beginnings of words (4 to 10 letters) and whole words that
occur more often in the words of toxic texts than in others, weighted by the logarithm of that ratio. Whole words that
begin like an entry but are no more frequent in toxic texts become exceptions, as do the fixed phrases below; at each
word the longest match counts, so an exception silences the entry inside it. A text's weights are normalised by its length
and turned into a probability by a logistic model.

The model is fitted on at most LABELLED rows and LABELLED_BYTES of whole texts, those whose hashed ids are smallest, of which each half is scored by the
lexicon of the other half; that bounds the lexicon, which has no limit of its own. Corpus texts are then all scored, whole. Ids, languages, sources and labels are no inputs of
a score. Null and empty texts have no words and get the score of such a text. Labels that are null, and rows of `labels`
without a document, are not used; a document labelled twice counts as toxic if one row says so. Without labels of both
kinds every score is 0.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hopwise.llm.shared import checkpointed, series_udf, set_apart, small_batches

LABELLED, LABELLED_BYTES, SHORTEST, LONGEST, FLUSHED = 10_000, 1 << 27, 4, 10, 150_000
# Phrases in which a word of abuse is none.
EXCEPTIONS = ["trash can", "trash bag", "trash bin", "clown fish", "circus clown", "pond scum", "soap scum", "sore loser"]
# Look-alike characters and the letters they stand for.
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x",
    "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ո": "n", "ս": "u",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "|": "l", "ı": "i", "ɑ": "a", "ɡ": "g",
}
_symbols = re.compile(r"[@$|]{2,}|(?<!\w)[@$|]+(?!\w)")


class _Fold(dict):
    def __missing__(self, code: int) -> str:
        c = chr(code)
        c = LOOKALIKES.get(c, c)
        if 0xFF01 <= code <= 0xFF5E:
            c = chr(code - 0xFEE0).lower()
        if code in (0x200B, 0x200C, 0x200D, 0xAD, 0xFEFF) or 0x300 <= code <= 0x36F:
            c = ""
        elif not c.isalpha():
            c = " "
        self[code] = c
        return c


_table = _Fold()


def folded(text: str | None) -> str:
    if not text:
        return "  "
    text = text.lower()
    if "$" in text or "@" in text or "|" in text:
        text = _symbols.sub(" ", text)
    return f" {' '.join(text.translate(_table).split())} "


def _count(batches):
    """Of labelled texts: pattern, fold, toxic, words that have it, texts that have it; the pattern '' counts all words."""
    import pyarrow as pa

    words: dict[tuple[str, int, int], int] = defaultdict(int)
    texts: Counter = Counter()

    def counted():
        keys = list(words)
        return pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([k[2] for k in keys], pa.int32()), pa.array([words[k] for k in keys], pa.int64()), pa.array([texts[k] for k in keys], pa.int64())],
            names=["pattern", "fold", "toxic", "words", "texts"],
        )

    for batch in batches:
        for text, fold, toxic in zip(*(batch.column(i) for i in range(3)), strict=True):
            fold, toxic = fold.as_py(), toxic.as_py()
            mine = Counter(folded(text.as_py()).split())
            own: Counter = Counter()
            for w, n in mine.items():
                own[f" {w} "] += n
                for k in range(SHORTEST, min(LONGEST, len(w)) + 1):
                    own[f" {w[:k]}"] += n
            own[""] = sum(mine.values())
            for p, n in own.items():
                words[p, fold, toxic] += n
            texts.update((p, fold, toxic) for p in own)
            if len(words) > FLUSHED:
                yield counted()
                words.clear()
                texts.clear()
    yield counted()


def lexicon(rows: list, total: tuple[float, float]) -> dict[str, float]:
    """Weights of patterns from (pattern, words in toxic texts, words in others, toxic texts); total: all words of each kind."""
    one, none = max(total[0], 1.0), max(total[1], 1.0)
    seen = {r[0]: r[1:] for r in rows if r[0]}
    weight = {p: math.log(((a + 0.25) / one) / ((b + 0.5) / none)) for p, (a, b, _) in seen.items()}
    out = {}
    for p, (a, _, n) in seen.items():
        longer = [q for q in ([p + " "] if p[-1] != " " else []) + [p + c for c in "abcdefghijklmnopqrstuvwxyzßàâäçèéêëíîïñóôöùúûüœæ"] if q in seen]
        if n >= 3 and weight[p] >= 1.5 and not any(seen[q][0] >= 0.9 * a for q in longer):
            out[p] = weight[p]
    for p in seen:
        if p[-1] == " " and p not in out and weight[p] < 1.0 and any(p[:k] in out for k in range(SHORTEST + 1, len(p))):
            out[p] = 0.0
    return out | {f" {x} ": 0.0 for x in EXCEPTIONS}


def automaton(weights: dict[str, float]):
    import ahocorasick

    out = ahocorasick.Automaton()
    for p, w in weights.items():
        out.add_word(p, (len(p), w))
    out.make_automaton()
    return out


def features(match, text: str) -> tuple[float, float, float]:
    """Weight per 100 words, logarithm of the weight, logarithm of the length."""
    best: dict[int, tuple[int, float]] = {}
    for end, (n, w) in match.iter(text):
        if best.get(end - n, (0, 0.0))[0] < n:
            best[end - n] = (n, w)
    total, covered = 0.0, -1
    for at in sorted(best):
        n, w = best[at]
        if at >= covered:
            total += w
        if n and w == 0.0:
            covered = max(covered, at + n - 1)
    length = text.count(" ") - 1 if len(text) > 2 else 0
    return 100 * total / (length + 30), math.log1p(total), math.log1p(max(length, 0))


def _logistic(x: np.ndarray, y: np.ndarray) -> list[float]:
    """Weights and bias by Newton's method with a small ridge."""
    x = np.column_stack([x, np.ones(len(x))])
    w, ridge = np.zeros(x.shape[1]), np.eye(x.shape[1]) * 0.05
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (p - y) + ridge @ w)
    return w.tolist()


def model(labelled: DataFrame) -> dict:
    """Lexicon and logistic weights from (doc_id, text, toxic, fold 0 or 1), at most LABELLED_BYTES of it."""
    labelled = checkpointed(labelled)
    # few rows, LABELLED of unique ids: the running sum over them may take one task
    size = Window.orderBy(F.xxhash64("doc_id"), "doc_id", "bytes").rowsBetween(Window.unboundedPreceding, 0)
    sizes = labelled.groupBy("doc_id").agg(F.sum(F.octet_length("text")).alias("bytes")).withColumn("so_far", F.sum("bytes").over(size))
    if sizes.where(F.col("so_far") > LABELLED_BYTES).isEmpty():
        sizes = None
    labelled = labelled if sizes is None else checkpointed(labelled.join(F.broadcast(sizes.where(F.col("so_far") <= LABELLED_BYTES)), "doc_id", "left_semi"))
    counts = labelled.select("text", "fold", "toxic").mapInArrow(_count, "pattern string, fold int, toxic int, words long, texts long")
    per = [F.sum(F.when((F.col("fold") == f) & (F.col("toxic") == t), F.col(v)).otherwise(0)).alias(f"{v}{f}{t}") for f in (0, 1) for t in (0, 1) for v in ("words", "texts")]
    counts = checkpointed(counts.groupBy("pattern").agg(*per))
    whole = counts.where("pattern = ''").first()
    if not whole:
        return {}
    ratio = f"((words01 + words11 + 0.25) / {max(1, whole['words01'] + whole['words11'])}) / ((words00 + words10 + 0.5) / {max(1, whole['words00'] + whole['words10'])})"
    found = counts.where("pattern <> '' and texts01 + texts11 >= 3").where(f"{ratio} >= 2.5").collect()
    begins = labelled.sparkSession.createDataFrame([(r["pattern"],) for r in found if r["pattern"][-1] != " "], "begin string")
    tops = F.explode(F.transform(F.sequence(F.lit(SHORTEST + 1), F.lit(LONGEST + 1)), lambda k: F.substring(F.col("pattern"), F.lit(1), k)))
    plain = counts.where("pattern like '% '").where(f"{ratio} < 2.5 and texts00 + texts10 >= 2").withColumn("begin", tops).join(F.broadcast(begins), "begin", "left_semi")
    found += plain.drop("begin").distinct().collect()

    def of(folds: tuple[int, ...]) -> dict[str, float]:
        take = lambda r, v, t: sum(r[f"{v}{f}{t}"] for f in folds)
        return lexicon([(r["pattern"], take(r, "words", 1), take(r, "words", 0), take(r, "texts", 1)) for r in found], (take(whole, "words", 1), take(whole, "words", 0)))

    both, crossed = of((0, 1)), [of((1,)), of((0,))]

    def run(batches):
        import pyarrow as pa

        match = [automaton(x) for x in crossed]
        for batch in batches:
            texts, folds, toxic = (batch.column(i).to_pylist() for i in range(3))
            rows = [features(match[f], folded(t)) for t, f in zip(texts, folds, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.float64()) for i in range(3)] + [pa.array(toxic, pa.int32())], names=["a", "b", "c", "y"])

    seen = np.array([tuple(r) for r in labelled.select("text", "fold", "toxic").mapInArrow(run, "a double, b double, c double, y int").collect()], float)
    if len(set(seen[:, 3])) < 2:
        return {}
    return {"lexicon": both, "weights": _logistic(seen[:, :3], seen[:, 3])}


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", bound: int = LABELLED) -> DataFrame:
    """At most `bound` labelled texts outside the held-out third, chosen by hashed id."""
    left_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    usable = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("toxic")).dropna().where(left_out != 1)
    usable = usable.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.join(F.broadcast(usable), "doc_id").select("doc_id", "text", "toxic", (left_out / 2).cast("int").alias("fold"))


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", score_col: str = "toxicity") -> DataFrame:
    """docs with a score, 0 to 1, in the column `score_col`, which replaces one of that name."""
    small_batches(docs.sparkSession)
    fitted = model(training_rows(docs, labels, id_col, text_col))
    weights = fitted.get("weights")

    def run(texts):
        import pandas as pd

        match = automaton(fitted["lexicon"]) if fitted else None
        for batch in texts:
            if not fitted:
                yield pd.Series(np.zeros(len(batch)))
                continue
            x = np.array([features(match, folded(t)) for t in batch], float).reshape(-1, 3)
            yield pd.Series(1 / (1 + np.exp(-np.clip(x @ np.array(weights[:3]) + weights[3], -30, 30))))

    return docs.withColumn(score_col, series_udf(run, "double")(F.col(text_col).cast("string")))


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.7) -> DataFrame:
    """The rows of docs that score below `least`, with all their columns."""
    columns = docs.columns
    docs, named = set_apart(docs)
    labels = labels.select(F.col(id_col).alias(named[id_col]), "toxic")
    return scored(docs, labels, named[id_col], named[text_col], "toxicity").where(F.col("toxicity") < least).drop("toxicity").toDF(*columns)
