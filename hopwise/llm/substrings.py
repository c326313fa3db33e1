"""Removal of repeated long passages through a compacted sparse de Bruijn graph of token k-mers.

The nodes are token k-mers chosen as minimizers: a k-mer (k = 20) whose hash is the least of one of the runs of 15 k-mers
that it lies in. The edges are the token sequences from one minimizer to the next, of 35 tokens at most. Every window of 50
tokens contains an edge, and equal windows contain equal edges at equal places, wherever they stand.

1. Each text yields its edges, as 64-bit hashes in order. One aggregation tells for each edge whether it occurs in two
   documents, so is repeated, and whether all its occurrences have the same edge before and after (the end of a text counts as one).
2. Two repeated edges that are each other's only neighbour lie on one nonbranching path. Every edge finds the head of its path by
   pointer doubling: a join of the pointers with themselves for each power of two of the path's length. A path cannot be a
   circle, as a text has an end. No two edges of a path point at one place before they are done, so no join has a hot key.
3. Every occurrence of one edge of a path lies in a whole occurrence of the path, so the places of the heads, joined with the
   paths' lengths, are the source coordinates of the repeated spans. They are verified on the texts: two independent hashes over all tokens
   of a span must be equal for spans to count as the same. The smallest document of a span then decides for all windows inside it.
4. Windows that contain a repeated edge but reach beyond one span are few and are compared one by one, by the same 128 bits.

Texts without a repeated edge, or without anything to cut, are not shuffled.

A window is removed if it also starts in a document with a smaller id; windows repeated only inside one document stay. Rows
that repeat an id count as one document, so they never remove from one another; each distinct text of such an id has spans
of its own, under the id and the text's hash (`part`, 0 for ids of one row). Null ids never cause a removal nor lose words. Null and empty texts have no words.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopwise.llm import hashing as H
from hopwise.llm.shared import checkpointed, discard, small_batches, stored, with_parts

WINDOW, K, RUN = 50, 20, 15
BROADCAST_IDS, BROADCAST_HEADS = 250_000, 250_000


def _sliding(x: np.ndarray, n: int, least: bool) -> np.ndarray:
    """Least or greatest of each n consecutive values."""
    pick, span = (np.minimum if least else np.maximum), 1
    while span * 2 <= n:
        x = pick(x[:-span], x[span:])
        span *= 2
    return pick(x[: len(x) - (n - span)], x[n - span :]) if span < n else x


def edges(words: H.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end (exclusive) of the edges of all texts, in words, and each edge's text."""
    none = np.zeros(0, np.int64)
    if len(words) < K + RUN:
        return none, none, none
    n = len(words) - K + 1
    at, kmers = words.windows(K)
    h = np.full(n + 2 * RUN, np.iinfo(np.uint64).max, np.uint64)
    h[RUN + at] = kmers >> H.U(1)
    inside = np.zeros(n + 2 * RUN, bool)
    inside[RUN + at] = True
    m = _sliding(h, RUN, True)
    m[~_sliding(inside, RUN, True)] = 0
    top = _sliding(m, RUN, False)
    # run g covers k-mers g..g+RUN-1, so k-mer p lies in runs p-RUN+1..p
    chosen = np.flatnonzero((top[1 : n + 1] == h[RUN : RUN + n]) & inside[RUN : RUN + n])
    doc = np.searchsorted(words.first, chosen, "right") - 1
    pair = np.flatnonzero(doc[1:] == doc[:-1])
    return chosen[pair], chosen[pair + 1] + K, doc[pair]


def _edge_rows(batches):
    """(doc_id, part, edges): each text's edges."""
    import pyarrow as pa

    for batch in batches:
        for row, words in H.chunks(batch.column(1)):
            begin, end, doc = edges(words)
            n = len(words.first) - 1
            offsets = pa.array(np.searchsorted(doc, np.arange(n + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(row, n),
                    batch.column(2).slice(row, n),
                    pa.ListArray.from_arrays(offsets, pa.array(H.signed(words.spans(begin, end)))),
                ],
                names=["doc_id", "part", "edges"],
            )


def _spans(batches):
    """Spans of paths and the windows that leave them, of texts with the coordinates of their paths: place of the head << 32 | edges."""
    import pyarrow as pa

    for batch in batches:
        marks = batch.column(2).to_pylist()
        for row, words in H.chunks(batch.column(1)):
            begin, end, doc = edges(words)
            n = len(words.first) - 1
            edge_at = np.searchsorted(doc, np.arange(n + 1))
            out = {k: [] for k in ("doc", "b", "e", "window")}
            for i in range(n):
                given = marks[row + i]
                if not given:
                    continue
                first, last = words.first[i], words.first[i + 1]
                b, e = begin[edge_at[i] : edge_at[i + 1]], end[edge_at[i] : edge_at[i + 1]]
                given = np.array(sorted(given), np.int64)
                heads, many = given >> 32, given & 0xFFFFFFFF
                sb, se = b[heads], e[heads + many - 1]
                places = np.repeat(heads - np.cumsum(many) + many, many) + np.arange(many.sum())
                # a window from s holds edge j if s <= b[j] and e[j] <= s + WINDOW
                total = last - first - WINDOW + 1
                if total <= 0:
                    continue
                hold = np.zeros(total + 1, np.int64)
                lo = np.clip(e[places] - WINDOW - first, 0, total)
                hi = np.clip(b[places] - first + 1, 0, total)
                some = lo < hi
                np.add.at(hold, lo[some], 1)
                np.add.at(hold, hi[some], -1)
                inside = np.zeros(total + 1, np.int64)
                long = se - sb >= WINDOW
                np.add.at(inside, sb[long] - first, 1)
                np.add.at(inside, se[long] - first - WINDOW + 1, -1)
                loose = np.flatnonzero((np.cumsum(hold)[:total] > 0) & (np.cumsum(inside)[:total] <= 0)) + first
                for kind, x, y in ((0, sb[long], se[long]), (1, loose, loose + WINDOW)):
                    out["doc"].append(np.full(len(x), i))
                    out["b"].append(x)
                    out["e"].append(y)
                    out["window"].append(np.full(len(x), kind))
            if not out["doc"]:
                continue
            doc, b, e, window = (np.concatenate(out[k]).astype(np.int64) for k in ("doc", "b", "e", "window"))
            h1, h2 = words.spans(b, e), words.spans(b, e, second=True)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(row, n).take(pa.array(doc)), batch.column(3).slice(row, n).take(pa.array(doc)), pa.array(H.signed(h1)), pa.array(H.signed(h2)), pa.array((b - words.first[doc]).astype(np.int32)), pa.array((e - b).astype(np.int32))],
                names=["doc_id", "part", "h1", "h2", "begin", "length"],
            )


def _digests(batches):
    """Word counts and digests of what is left."""
    import pyarrow as pa

    for batch in batches:
        removed = batch.column(2).to_pylist()
        for row, words in H.chunks(batch.column(1)):
            n = len(words.first) - 1
            many, lost, digest = np.diff(words.first), np.zeros(n, np.int64), []
            for i in range(n):
                first, last = words.first[i], words.first[i + 1]
                keep = np.arange(first, last)
                if removed[row + i]:
                    cover = np.zeros(last - first + 1, np.int64)
                    for x in removed[row + i]:
                        cover[x >> 32] += 1
                        cover[(x >> 32) + (x & 0xFFFFFFFF)] -= 1
                    keep = keep[np.cumsum(cover)[:-1] == 0]
                    lost[i] = last - first - len(keep)
                digest.append(hashlib.sha256(joined_words(words, keep)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, n), pa.array(many.astype(np.int64)), pa.array(lost), pa.array(digest)], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def joined_words(words: H.Words, keep: np.ndarray) -> bytes:
    """The words at these places, joined by one space."""
    if not len(keep):
        return b""
    length = words.stop[keep] - words.start[keep]
    total = int(length.sum()) + len(keep) - 1
    out = np.full(total, 32, np.uint8)
    to = np.concatenate(([0], np.cumsum(length + 1)[:-1]))
    shift = np.repeat(words.start[keep] - to, length)
    place = np.arange(int(length.sum())) + np.repeat(np.arange(len(keep)), length)
    out[place] = words.data[place + shift]
    return out.tobytes()


def paths(ends: DataFrame) -> DataFrame:
    """(head, n): the first edge and the number of edges of each nonbranching path; ends: (edge, before, after), null where occurrences differ, 0 at a text's end."""
    after = ends.select(F.col("edge").alias("before"), F.col("after").alias("follows"))
    linked = F.coalesce(F.col("follows") == F.col("edge"), F.lit(False))
    step = ends.join(after, "before", "left").select("edge", F.when(linked, F.col("before")).otherwise(F.col("edge")).alias("at"), linked.cast("long").alias("far"), (~linked).alias("done"))
    step = stored(step)
    done, left = [step.where("done")], step.where("not done")
    frames = [step]
    while not left.isEmpty():
        to = step.select(F.col("edge").alias("at"), F.col("at").alias("at2"), F.col("far").alias("far2"), F.col("done").alias("done2"))
        moved = stored(left.join(to, "at").select("edge", F.col("at2").alias("at"), (F.col("far") + F.col("far2")).alias("far"), F.col("done2").alias("done")))
        frames.append(moved)
        done.append(moved.where("done"))
        left = moved.where("not done")
        # a place that is done already is looked up in the round in which it was
        step = functools.reduce(DataFrame.union, [*done, left])
    out = checkpointed(functools.reduce(DataFrame.union, done).groupBy(F.col("at").alias("head")).agg((F.max("far") + 1).alias("n")))
    discard(*frames)
    return out


def of_documents(texts: DataFrame, rows: DataFrame, what: str = "left_semi") -> DataFrame:
    """The texts that have rows of their (doc_id, part), or have none; no text is shuffled unless very many have."""
    ids = checkpointed(rows.select("doc_id", "part").distinct())
    return texts.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, ["doc_id", "part"], what)


def repeated_spans(texts: DataFrame) -> DataFrame:
    """(doc_id, part, begin, length) of word spans all of whose windows also start in a document with a smaller id; texts: (doc_id, text, part)."""
    texts = texts.where("doc_id is not null and text is not null")
    texts = texts.where("part = 0").union(texts.where("part <> 0").dropDuplicates(["doc_id", "part"]))
    found = stored(texts.mapInArrow(_edge_rows, "doc_id long, part long, edges array<long>").where("size(edges) > 0"))
    each = found.select("doc_id", "part", "edges", F.posexplode("edges").alias("at", "edge"))
    # null, the end of a text, is a neighbour of its own kind
    before, after = F.coalesce(F.when(F.col("at") > 0, F.get("edges", F.col("at") - 1)), F.lit(0)), F.coalesce(F.get("edges", F.col("at") + 1), F.lit(0))
    both = [F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.min("before").alias("b0"), F.max("before").alias("b1"), F.min("after").alias("a0"), F.max("after").alias("a1")]
    ends = each.select("doc_id", "edge", before.alias("before"), after.alias("after")).groupBy("edge").agg(*both).where("least < most")
    ends = stored(ends.select("edge", F.when(F.col("b0") == F.col("b1"), F.col("b0")).alias("before"), F.when(F.col("a0") == F.col("a1"), F.col("a0")).alias("after")))
    heads = paths(ends)
    heads = F.broadcast(heads) if heads.count() <= BROADCAST_HEADS else heads
    marked = each.select("doc_id", "part", "at", "edge").join(heads, F.col("edge") == F.col("head"))
    marked = stored(marked.groupBy("doc_id", "part").agg(F.collect_list(F.shiftleft(F.col("at").cast("long"), 32) + F.col("n")).alias("marks")))
    spans = of_documents(texts, marked).join(marked, ["doc_id", "part"]).select("doc_id", "text", "marks", "part")
    spans = stored(spans.mapInArrow(_spans, "doc_id long, part long, h1 long, h2 long, begin int, length int"))
    discard(found, ends, marked)
    least = checkpointed(spans.groupBy("h1", "h2", "length").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("h1", "h2", "length", "least"))
    out = checkpointed(spans.join(least, ["h1", "h2", "length"]).where("least < doc_id").select("doc_id", "part", "begin", "length"))
    discard(spans)
    return out


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256): one row per input row."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    texts = with_parts(texts)[0].withColumnRenamed("__part", "part")
    cut = repeated_spans(texts).groupBy("doc_id", "part").agg(F.collect_list(F.shiftleft(F.col("begin").cast("long"), 32) + F.col("length")).alias("cut"))
    cut = checkpointed(cut)
    whole = of_documents(texts, cut, "left_anti").withColumn("cut", F.lit(None).cast("array<long>"))
    both = whole.unionByName(of_documents(texts, cut).join(cut, ["doc_id", "part"]))
    return both.select("doc_id", "text", "cut").mapInArrow(_digests, "doc_id long, n_words long, n_removed long, kept_sha256 string")
