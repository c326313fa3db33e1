"""Near-duplicate documents by MinHash: banded candidates, sequential Bayesian verification, exact check.

1. Words become shingles of `width` words; a text's set of 64-bit shingle hashes gives its size, a fingerprint of two sums and
   `rows * bands` minimum hashes. Texts with equal fingerprints form a class and only its smallest id goes on.
2. In each bucket of each band all members are compared with the bucket's smallest id. That links large groups of near
   copies without listing their pairs.
3. Buckets whose members still lie in several components get the rest. Up to 32 members, the pairs of different components
   are listed. Larger buckets are cut into blocks of about 512 members and every two blocks are a tile. A first pass sends
   signatures to the tiles and gets back the rows that have a likely partner there; a second sends the sets of those rows
   alone, verifies what is likely, the likeliest first, and returns only links that join two components. After that every
   candidate pair has been compared or lies in one component, so no bucket needs a cap.
4. A comparison looks at the signatures a batch at a time and stops as soon as the chance that the similarity reaches the
   threshold (uniform prior, so a Beta posterior) falls below `miss`; the survivors are compared on their full sets, which
   are made again from the texts of the survivors only: the others are left out before anything is shuffled.

With 26 bands of 5 rows a pair of similarity 0.8 is no candidate with a chance of 3e-5.

Null or empty texts, and texts without words, have an empty set and no links. A text shorter than `width` words is one
shingle. Rows that repeat a doc_id count as that document, each distinct text of it is compared, and all are one component;
a null doc_id is returned with a null component and kept. Only the id and text columns are read, others are ignored here and
kept by `drop_near_duplicates`.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopwise.llm import hashing as H
from hopwise.llm.shared import bit_set, checkpointed, connected_components, discard, set_apart, small_batches, stored, with_parts

BANDS, ROWS, BATCH = 26, 5, 26
PAIRED, BLOCK_ROWS, BLOCK_SHINGLES = 32, 512, 1 << 20
BROADCAST_IDS, MOST_BITS, HIGH = 500_000, 29, 1 << 62
SEEDS = np.random.default_rng(41).integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
FEATURES = "doc_id long, n_shingles long, f1 long, f2 long, signature binary, bands array<long>"


def shingle_sets(words: H.Words, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    out = []
    many = np.diff(words.first)
    at, hashes = words.windows(width)
    edge = np.searchsorted(at, words.first)
    for i, n in enumerate(many):
        if n >= width:
            out.append(np.unique(hashes[edge[i] : edge[i + 1]]))
        elif n:
            out.append(words.spans(words.first[i : i + 1], words.first[i + 1 : i + 2]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _features(width: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for row, words in H.chunks(texts, fold=True):
                sets = shingle_sets(words, width)
                size = np.array([len(s) for s in sets])
                full = np.flatnonzero(size)
                sig = np.zeros((len(sets), BANDS * ROWS), np.uint32)
                f1, f2 = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
                if len(full):
                    x = np.concatenate(sets)
                    at = np.concatenate(([0], np.cumsum(size[full])))[:-1]
                    for k, seed in enumerate(SEEDS):
                        sig[full, k] = np.minimum.reduceat(((x * seed) >> np.uint64(32)).astype(np.uint32), at)
                    f1[full] = np.add.reduceat(H.mix(x ^ np.uint64(0x1234567)), at)
                    f2[full] = np.add.reduceat(H.mix(x ^ np.uint64(0x89ABCDE)), at)
                grouped = sig.reshape(len(sets), BANDS, ROWS).astype(np.uint64)
                key = np.zeros((len(sets), BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
                for r in range(ROWS):
                    key = H.paired(key, grouped[:, :, r])
                offsets = pa.array(np.concatenate(([0], np.cumsum(np.where(size > 0, BANDS, 0)))).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(row, len(sets)),
                        pa.array(size.astype(np.int64)),
                        pa.array(H.signed(f1)),
                        pa.array(H.signed(f2)),
                        pa.array([s.tobytes() for s in sig], pa.binary()),
                        pa.ListArray.from_arrays(offsets, pa.array(H.signed(key[full].ravel()))),
                    ],
                    names=["doc_id", "n_shingles", "f1", "f2", "signature", "bands"],
                )

    return run


def _sets(width: int, bits=None):
    """Sets of texts; with bits, of those alone whose place (third column) is set."""

    def run(batches):
        import pyarrow as pa

        filled = None if bits is None else np.frombuffer(bits.value, np.uint8)
        for batch in batches:
            if filled is not None:
                at = batch.column(2).to_numpy()
                batch = batch.filter(pa.array((filled[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1))
            for row, words in H.chunks(batch.column(1), fold=True):
                sets = shingle_sets(words, width)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(sets)), pa.array([s.tobytes() for s in sets], pa.binary())], names=["doc_id", "shingles"])

    return run


def least_matches(n: int, threshold: float, miss: float) -> int:
    """The fewest equal values among n with which P(similarity >= threshold) is still at least `miss` (Beta(m + 1, n - m + 1))."""
    for m in range(n + 1):
        # P(Beta(m+1, n-m+1) >= t) = P(Binomial(n+1, t) <= m)
        if sum(math.comb(n + 1, i) * threshold**i * (1 - threshold) ** (n + 1 - i) for i in range(m + 1)) >= miss:
            return m
    return n


def _likely(threshold: float, miss: float):
    total = BANDS * ROWS
    steps = [(n, least_matches(n, threshold, miss)) for n in range(BATCH, total + 1, BATCH)]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            left, right = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32).reshape(-1, total) for i in (2, 3))
            alive, same, seen = np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int32), 0
            for n, least in steps:
                same[alive] += (left[alive, seen:n] == right[alive, seen:n]).sum(axis=1, dtype=np.int32)
                alive, seen = alive[same[alive] >= least], n
            yield pa.RecordBatch.from_arrays([batch.column(i).take(pa.array(alive)) for i in (0, 1)], names=["a", "b"])

    return run


def _exact(percent: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            good = []
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                s, t = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                if 100 * min(len(s), len(t)) < percent * max(len(s), len(t)):
                    continue
                both = len(np.intersect1d(s, t, assume_unique=True))
                if 100 * both >= percent * (len(s) + len(t) - both):
                    good.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(i).take(pa.array(good, pa.int64())) for i in (0, 1)], names=["a", "b"])

    return run


def _pairs(table, percent: int, miss: float):
    """The likely pairs of a tile's rows, of different components and in the first band they share: (equal values, row, row) each."""
    total = BANDS * ROWS
    steps = [(n, least_matches(n, percent / 100, miss)) for n in range(BATCH, total + 1, BATCH)]
    doc, component, block, band = (table.column(c).to_numpy() for c in ("doc_id", "component", "block", "band"))
    sig = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint32).reshape(-1, total)
    i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
    left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
    found = [np.zeros((3, 0), np.int64)]
    for r in range(0, len(left), 32):
        part = left[r : r + 32]
        same = (sig[part, None, :BATCH] == sig[None, right, :BATCH]).sum(axis=2, dtype=np.int32)
        x, y = np.nonzero((same >= steps[0][1]) & (component[part, None] != component[None, right]))
        count, x, y = same[x, y], part[x], right[y]
        for (seen, _), (n, least) in zip(steps, steps[1:], strict=False):
            count = count + (sig[x, seen:n] == sig[y, seen:n]).sum(axis=1, dtype=np.int32)
            keep = count >= least
            count, x, y = count[keep], x[keep], y[keep]
        once = (sig[x] == sig[y]).reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1) == band[0]
        once &= (doc[x] < doc[y]) | (i != j)
        found.append(np.stack([count[once], x[once], y[once]]))
    return doc, component, np.concatenate(found, axis=1)


def _likely_rows(percent: int, miss: float):
    """The rows of a tile that have a likely partner in it."""

    def run(table):
        _, _, pairs = _pairs(table, percent, miss)
        return table.take(np.unique(pairs[1:])).select(["bucket", "band", "doc_id", "component", "block", "i", "j", "signature"])

    return run


def _tiles(percent: int, miss: float):
    def run(table):
        import pyarrow as pa

        doc, component, pairs = _pairs(table, percent, miss)
        sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
        root: dict[int, int] = {}

        def top(c):
            while c in root:
                c = root[c]
            return c

        links = []
        for _, x, y in pairs[:, np.argsort(-pairs[0], kind="stable")].T.tolist():
            p, q = top(component[x]), top(component[y])
            if p == q:
                continue
            s, t = sets[x], sets[y]
            both = int((t[np.minimum(np.searchsorted(t, s), len(t) - 1)] == s).sum())
            if 100 * both >= percent * (len(s) + len(t) - both):
                root[max(p, q)] = min(p, q)
                links.append((doc[x], doc[y]))
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return run


def _components(texts: DataFrame, width: int, percent: int, miss: float, more: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(features, components) of (doc_id, text), whose rows of one id have one text; more: further links (a, b)."""
    spark = texts.sparkSession
    features = stored(texts.mapInArrow(_features(width), FEATURES))
    named = features.where("doc_id is not null and n_shingles > 0")

    copies = checkpointed(named.groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("other")).where("rep <> other").select("f1", "f2", "rep"))
    links = checkpointed(named.select("f1", "f2", "doc_id").join(copies, ["f1", "f2"]).select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).where("a <> b"))
    single = named.select("doc_id", "bands").join(links.select(F.col("b").alias("doc_id")), "doc_id", "left_anti")

    banded = single.select("doc_id", F.posexplode("bands").alias("band", "bucket"))
    buckets = checkpointed(banded.groupBy("bucket").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")).where("rep <> last").select("bucket", "rep"))
    members = checkpointed(banded.join(buckets, "bucket").select("bucket", "band", "rep", "doc_id"))

    def sets_of(ids: DataFrame) -> DataFrame:
        ids = checkpointed(ids.select("doc_id").distinct())
        n, made = ids.count(), "doc_id long, shingles binary"
        if n <= BROADCAST_IDS:
            return stored(texts.join(F.broadcast(ids), "doc_id", "left_semi").mapInArrow(_sets(width), made).dropDuplicates(["doc_id"]))
        size = 1 << min(MOST_BITS, (16 * n).bit_length())
        place = F.xxhash64("doc_id").bitwiseAND(F.lit(size - 1)).alias("place")
        bits = spark.sparkContext.broadcast(bit_set(ids.select(place), size))
        return stored(texts.where("doc_id is not null").select("doc_id", "text", place).mapInArrow(_sets(width, bits), made).join(ids, "doc_id").dropDuplicates(["doc_id"]))

    def signatures_of(ids: DataFrame) -> DataFrame:
        ids = checkpointed(ids.select("doc_id").distinct())
        ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
        return stored(named.select("doc_id", "signature", "n_shingles").join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id"]))

    def verified(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) that reach the similarity."""
        pairs = checkpointed(pairs)
        sig = signatures_of(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")))
        left, right = (sig.select(F.col("doc_id").alias(c), F.col("signature").alias(f"sig_{c}")) for c in "ab")
        likely = checkpointed(pairs.join(left, "a").join(right, "b").select("a", "b", "sig_a", "sig_b").mapInArrow(_likely(percent / 100, miss), "a long, b long"))
        sets = sets_of(likely.select(F.explode(F.array("a", "b")).alias("doc_id")))
        left, right = (sets.select(F.col("doc_id").alias(c), F.col("shingles").alias(f"set_{c}")) for c in "ab")
        out = checkpointed(likely.join(left, "a").join(right, "b").select("a", "b", "set_a", "set_b").mapInArrow(_exact(percent), "a long, b long"))
        discard(sig, sets)
        return out

    near = verified(members.select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).where("a <> b").distinct())
    found = connected_components(near)

    placed = members.join(found, members.doc_id == found.node, "left").select("bucket", "band", "rep", "doc_id", F.coalesce("component_id", "doc_id").alias("component"))
    sizes = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("component").alias("c0"), F.max("component").alias("c1"))
    mixed = checkpointed(sizes.where("c0 <> c1 and n > 2").select("bucket", "n"))
    rest = checkpointed(placed.join(mixed, "bucket").where("doc_id <> rep").drop("rep"))
    few = rest.where(F.col("n") <= PAIRED)
    other = few.select("bucket", F.col("doc_id").alias("y"), F.col("component").alias("cy"))
    pairs = few.join(other, "bucket").where("doc_id < y and component <> cy").select(F.col("doc_id").alias("a"), F.col("y").alias("b")).distinct()
    near = near.union(verified(pairs))

    many = rest.where(F.col("n") > PAIRED)
    if not many.isEmpty():
        known = signatures_of(many)
        blocks = many.join(known.select("doc_id", "n_shingles"), "doc_id").groupBy("bucket")
        blocks = checkpointed(blocks.agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks")))
        block = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
        tiles = many.join(blocks, "bucket").withColumn("block", block).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
        tiles = tiles.select("bucket", "band", "doc_id", "component", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
        made = "bucket long, band int, doc_id long, component long, block int, i int, j int, signature binary"
        likely = stored(tiles.join(known.drop("n_shingles"), "doc_id").groupBy("bucket", "i", "j").applyInArrow(_likely_rows(percent, miss), made))
        sets = sets_of(likely)
        near = near.union(checkpointed(likely.join(sets, "doc_id").groupBy("bucket", "i", "j").applyInArrow(_tiles(percent, miss), "a long, b long")))
        discard(known, likely, sets)

    links = links.union(near) if more is None else links.union(near).union(more)
    return features, connected_components(links)


def with_nodes(docs: DataFrame, id_col: str, text_col: str, nulls: bool = False) -> tuple[DataFrame, bool]:
    """docs with `__node`, and whether some are no ids: the id where one row has it, else a number above all ids for each distinct text of it; nulls: of null ids too."""
    docs, some = with_parts(docs, id_col, text_col, nulls)
    high = F.xxhash64(F.col(id_col), F.col(text_col)).bitwiseAND(F.lit(HIGH - 1)).bitwiseOR(F.lit(HIGH))
    return docs.withColumn("__node", F.when(F.col("__part") != 0, high).otherwise(F.col(id_col).cast("long"))).drop("__part"), some


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, percent: int = 80, miss: float = 1e-6) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): one row per input row."""
    small_batches(docs.sparkSession)
    rows, some = with_nodes(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), "doc_id", "text")
    again = checkpointed(rows.where("__node <> doc_id").select(F.col("doc_id").alias("a"), F.col("__node").alias("b")).distinct()) if some else None
    features, components = _components(rows.select(F.col("__node").alias("doc_id"), "text"), width, percent, miss, again)
    out = features.select("doc_id", F.col("doc_id").alias("at"), "n_shingles")
    if again is not None:
        out = out.join(again, F.col("at") == F.col("b"), "left").select(F.coalesce("a", "doc_id").alias("doc_id"), "at", "n_shingles")
    out = out.join(components, F.col("at") == F.col("node"), "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, miss: float = 1e-6) -> DataFrame:
    """One row of each component, that of the smallest id, with all its columns, and all rows without words.

    Rows of a repeated or null id are documents of their own here, one for each distinct text, after all others in order.
    """
    small_batches(docs.sparkSession)
    columns = docs.columns
    docs, named = set_apart(docs)
    id_col, text_col = named[id_col], named[text_col]
    rows, some = with_nodes(docs, id_col, text_col, nulls=True)
    _, components = _components(rows.select(F.col("__node").alias("doc_id"), F.col(text_col).cast("string").alias("text")), width, percent, miss)
    lost = checkpointed(components.where("node <> component_id").select(F.col("node").alias("__lost")))
    lost = F.broadcast(lost) if lost.count() <= BROADCAST_IDS else lost
    left = rows.join(lost, F.col("__node") == F.col("__lost"), "left_anti")
    if some:
        again = (F.col("__node") >= HIGH) & F.coalesce(F.col(text_col).cast("string").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
        left = left.where(~again).union(left.where(again).dropDuplicates(["__node"]))
    return left.drop("__node").toDF(*columns)
