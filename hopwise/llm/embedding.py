"""Near-duplicate vectors by tiled products of Int8 codes with an error bound for every vector.

Each vector is divided by its largest component, then by its length (so neither very small nor very large ones are lost), and the
unit vector x is coded once as s*q with q in -127..127 and the measured error e = |x - s*q|. Vectors fall into cells by the
nearest of at most CELLS pivots (the vectors whose ids have the smallest hashes), and cells into blocks by a hash of the id, so a
hot cell has many blocks. Two blocks make a tile, one group of at most two blocks of rows. A vector goes to the blocks of a cell only
if its angle to the cell's pivot is at most the largest angle of a vector of the cell plus that of the threshold: beyond it, by the
triangle inequality, there is no link. So no link is lost and tiles of distant cells are never made. For two vectors `x.y` differs from
`s_x*s_y*(q_x.q_y)` by at most `e_x + (1 + e_x)*e_y`. Products of codes are exact in float32 (dimension up
to 1040, float64 beyond). A pair whose upper bound stays below the threshold is dropped and one whose lower bound reaches it
is a link. Tiles get codes only. What lies between is left to a second pass, in which a tile gets the full vectors of the rows
that have such a pair in it, and computes those pairs in double precision.

A tile returns a row for each vector that has links: how many, and the smallest id of its component in the tile. So large
groups of near copies cost no list of pairs. Equal vectors are one class with a weight, for the same reason. Where vectors are not
clustered no cell can be left out, and work grows with the square of the rows: the exact answer over all rows, not an index.

Vectors that are null, empty or zero, or hold nulls or values that are not finite, link with nothing; vectors of different
length neither. A null id has no links and a null component. Rows that repeat an id are vectors of their own with one name.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hopwise.llm.shared import checkpointed, connected_components, discard, stored

BLOCK_BYTES, BLOCK_ROWS, LEAST_BLOCKS, CELLS = 1 << 24, 16384, 8, 256
SLACK, ANGLE_SLACK = 1e-9, 1e-6
PLACED = "vec_id long, v binary, weight long, code binary, scale double, error double, width int, block int, others array<int>"


def units(x: np.ndarray) -> np.ndarray:
    """Rows of finite values, none of them zero, at length 1."""
    x = x / np.abs(x).max(axis=1)[:, None]
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def coded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, scales and errors of unit vectors."""
    scale = np.abs(x).max(axis=1) / 127
    q = np.rint(x / scale[:, None])
    return q, scale, np.sqrt(((x - scale[:, None] * q) ** 2).sum(axis=1)) + SLACK


def _plain(single: bool):
    """(vec_id, v, code, scale, error) of vectors: their values and codes as bytes, nulls for those that link with nothing."""
    kind = np.float32 if single else np.float64

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            lists = batch.column(1).cast(pa.large_list(pa.float32() if single else pa.float64()))
            values = lists.values
            flat = np.asarray(values.fill_null(float("nan")).to_numpy(zero_copy_only=False), kind)
            at = lists.offsets.to_numpy()
            good = np.asarray(lists.is_valid())
            out: list[tuple] = []
            for i in range(len(lists)):
                v = flat[at[i] : at[i + 1]] if good[i] else flat[:0]
                if not (len(v) and v.any() and np.isfinite(v).all()):
                    out.append((None, None, None, None))
                    continue
                q, scale, error = coded(units(v[None].astype(np.float64)))
                out.append(((v + kind(0)).tobytes(), q.astype(np.int8).tobytes(), float(scale[0]), float(error[0])))
            columns = [pa.array([r[k] for r in out], t) for k, t in enumerate((pa.binary(), pa.binary(), pa.float64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["vec_id", "v", "code", "scale", "error"])

    return run


def _angled(batch, pivots: dict[int, np.ndarray], kind):
    """(width, rows, angles to the pivots of that width) of a batch of vectors; without pivots one angle, 0."""
    import pyarrow as pa

    values = batch.column("v")
    width = batch.column("width").to_numpy()
    for w in np.unique(width).tolist():
        at = np.flatnonzero(width == w)
        for r in range(0, len(at), 256):
            rows = pa.array(at[r : r + 256])
            if w not in pivots:
                yield w, rows, np.zeros((len(rows), 1))
                continue
            x = units(np.frombuffer(b"".join(values.take(rows).to_pylist()), kind).reshape(len(rows), -1).astype(np.float64))
            yield w, rows, np.arccos(np.clip(x @ pivots[w].T, -1, 1))


def _cells(pivots, kind):
    """(width, cell, n, angle): per batch how many vectors fall into each cell, and the largest angle to its pivot."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for w, _, angles in _angled(batch, pivots, kind):
                cell, near = angles.argmin(axis=1), angles.min(axis=1)
                for c in np.unique(cell):
                    yield pa.RecordBatch.from_arrays([pa.array([w], pa.int32()), pa.array([c], pa.int32()), pa.array([(cell == c).sum()], pa.int64()), pa.array([near[cell == c].max()])], names=["width", "cell", "n", "angle"])

    return run


def _placed(pivots, cells: dict[int, tuple[np.ndarray, np.ndarray]], blocks: int, reach: float, kind):
    """Vectors with their block and the blocks that may hold a partner; cells: number of blocks and largest angle of each cell, by width."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for w, rows, angles in _angled(batch, pivots, kind):
                many, far = cells.get(w, (np.array([blocks]), np.zeros(1)))
                cell, part = angles.argmin(axis=1), batch.take(rows)
                block = (np.cumsum(many) - many)[cell] + part.column("hash").to_numpy() % many[cell]
                row, others = np.nonzero(np.repeat(angles <= far + reach, many, axis=1))
                offsets = np.searchsorted(row, np.arange(len(rows) + 1))
                kept = [part.column(c) for c in ("vec_id", "v", "weight", "code", "scale", "error", "width")]
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(others.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*kept, pa.array(block.astype(np.int32)), lists], names=PLACED.replace(",", "").split()[::2])

    return run


def joined(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Union of the pairs (i, j) into a forest whose labels are roots; smaller roots win."""
    while True:
        a, b = label[i], label[j]
        differ = a != b
        if not differ.any():
            return label
        i, j, a, b = i[differ], j[differ], a[differ], b[differ]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (up := label[label]).tobytes() != label.tobytes():
            label = up


def tile_links(ids: np.ndarray, block: np.ndarray, weight: np.ndarray, q: np.ndarray, scale: np.ndarray, error: np.ndarray, threshold: float, same: bool, x: np.ndarray | None = None):
    """Links between the rows of two blocks, or within the one block if `same`: (ids, labels, counts, ids of unsure pairs).

    Without x the sure links, with unit vectors x those of the unsure pairs.
    """
    order = np.lexsort((ids, block))
    ids, block, weight, q, scale, error = ids[order], block[order], weight[order].astype(float), q[order], scale[order], error[order]
    x = x if x is None else x[order]
    q = q.astype(np.float32 if q.shape[1] <= 1040 else np.float64)
    m = int((block == block[0]).sum())
    if not same and m == len(ids):  # the other block has no rows here
        return ids[:0], ids[:0], np.zeros(0, np.int64), ids[:0]
    right = np.arange(len(ids)) if same else np.arange(m, len(ids))
    rank = np.argsort(np.argsort(ids, kind="stable"), kind="stable")
    by_rank = np.argsort(rank)
    label, count, open_ = np.arange(len(ids)), np.zeros(len(ids)), np.zeros(len(ids), bool)
    qr, sr, er = q[right], scale[right], error[right]
    rows = max(1, (1 << 22) // max(1, len(right)))
    for r in range(0, m, rows):
        here = np.arange(r, min(m, r + rows))
        near = threshold - error[here] - (1 + error[here]) * er.max() - SLACK
        near = np.where(near > 0, near / (scale[here] * sr.max()), near / (scale[here] * sr.min()))
        products = q[here] @ qr.T
        i, j = np.nonzero(products >= near[:, None])
        if same:
            later = right[j] > here[i]
            i, j = i[later], j[later]
        about = products[i, j].astype(float) * scale[here][i] * sr[j]
        bound = error[here][i] + (1 + error[here][i]) * er[j] + SLACK
        i, j, about, bound = (a[about + bound >= threshold] for a in (i, j, about, bound))
        link = about - bound >= threshold
        if x is None:
            open_[here[i[~link]]] = open_[right[j[~link]]] = True
        else:
            unsure = np.flatnonzero(~link)
            link[:] = False
            for u in range(0, len(unsure), 1 << 16):
                part = unsure[u : u + (1 << 16)]
                link[part] = np.einsum("ij,ij->i", x[here[i[part]]], x[right[j[part]]]) >= threshold
        a, b = here[i[link]], right[j[link]]
        count += np.bincount(a, weight[b], len(ids)) + np.bincount(b, weight[a], len(ids))
        label = by_label(label, rank, by_rank, a, b)
    has = np.flatnonzero(count)
    return ids[has], ids[label[has]], count[has].astype(np.int64), ids[open_]


def by_label(label: np.ndarray, rank: np.ndarray, by_rank: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """`joined` with ids' order for the order of roots."""
    return by_rank[joined(rank[label][by_rank], rank[a], rank[b])[rank]]


def _tiles(threshold: float, kind=None):
    """(a, b, n, i, j, width): of codes the sure links, and vectors a of unsure pairs with a null n; with the kind of full values the links of unsure pairs."""

    def run(table):
        import pyarrow as pa

        q = np.frombuffer(b"".join(table.column("code").to_pylist()), np.int8).reshape(table.num_rows, -1)
        x = None if kind is None else units(np.frombuffer(b"".join(table.column("v").to_pylist()), kind).reshape(table.num_rows, -1).astype(np.float64))
        same = table.column("i")[0] == table.column("j")[0]
        a, b, n, unsure = tile_links(*(table.column(c).to_numpy() for c in ("vec_id", "block", "weight")), q, *(table.column(c).to_numpy() for c in ("scale", "error")), threshold, same, x)
        key = [pa.array(np.full(len(a) + len(unsure), table.column(c)[0].as_py(), np.int32)) for c in ("i", "j", "width")]
        none = pa.nulls(len(unsure), pa.int64())
        return pa.table([pa.array(np.concatenate((a, unsure))), *(pa.concat_arrays([pa.array(c), none]) for c in (b, n)), *key], names=["a", "b", "n", "i", "j", "width"])

    return run


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row per input row. The threshold must be positive."""
    kind = vectors.schema[vector_col].dataType
    single = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    given = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<float>" if single else "array<double>").alias("embedding"))
    rows = stored(given.mapInArrow(_plain(single), "vec_id long, v binary, code binary, scale double, error double"))
    classes = rows.where("vec_id is not null and v is not null").groupBy("v").agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("weight"), *[F.first(c).alias(c) for c in ("code", "scale", "error")])
    classes = stored(classes)
    total = classes.agg(F.count(F.lit(1)).alias("n"), F.max(F.octet_length("code")).alias("width")).first()
    per_block = max(256, min(BLOCK_ROWS, BLOCK_BYTES // max(1, total["width"] or 1)))
    blocks = max(LEAST_BLOCKS, -(-total["n"] // per_block))
    number = np.float32 if single else np.float64
    known = classes.withColumns({"width": F.octet_length("code"), "hash": F.xxhash64("vec_id").bitwiseAND(F.lit(0x7FFFFFFF))})
    pivots: dict[int, list] = {}
    for r in known.select("v", "width", F.xxhash64("vec_id").alias("at"), "vec_id").orderBy("at", "vec_id").limit(min(CELLS, blocks)).collect():
        pivots.setdefault(r["width"], []).append(np.frombuffer(r["v"], number).astype(np.float64))
    pivots = {w: units(np.stack(x)) for w, x in pivots.items()}
    sizes = known.select("v", "width").mapInArrow(_cells(pivots, number), "width int, cell int, n long, angle double").where(F.col("width").isin(list(pivots)))
    cells = {w: (np.zeros(len(x), np.int64), np.full(len(x), -np.inf)) for w, x in pivots.items()}
    for r in sizes.groupBy("width", "cell").agg(F.sum("n").alias("n"), F.max("angle").alias("angle")).collect():
        many, far = cells[r["width"]]
        many[r["cell"]], far[r["cell"]] = -(-r["n"] // per_block), r["angle"]
    reach = float(np.arccos(min(1.0, threshold))) + ANGLE_SLACK
    placed = stored(known.mapInArrow(_placed(pivots, cells, blocks, reach, number), PLACED))
    tiles = placed.select("vec_id", "weight", "code", "scale", "error", "block", "width", F.explode("others").alias("other"))
    tiles = tiles.select("vec_id", "weight", "code", "scale", "error", "block", "width", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    made = "a long, b long, n long, i int, j int, width int"
    found = stored(tiles.groupBy("width", "i", "j").applyInArrow(_tiles(threshold), made))
    unsure = found.where("n is null").select(F.col("a").alias("vec_id"), "i", "j", "width").join(placed.drop("width", "others"), "vec_id")
    sure = checkpointed(unsure.groupBy("width", "i", "j").applyInArrow(_tiles(threshold, number), made))
    links = found.where("n is not null").select("a", "b", "n").union(sure.select("a", "b", "n"))

    counts = checkpointed(links.groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n")))
    components = connected_components(links.select("a", "b"))
    discard(found, placed)
    copies = checkpointed(classes.where("weight > 1").select("v", F.col("vec_id").alias("class"), "weight"))
    discard(classes)
    out = rows.join(copies, "v", "left").withColumn("class", F.when(F.col("vec_id").isNotNull(), F.coalesce("class", "vec_id")))
    out = out.select("vec_id", "class", "weight")
    out = out.join(counts, F.col("class") == F.col("rep"), "left").join(components, F.col("class") == F.col("node"), "left")
    links = F.when(F.col("vec_id").isNull(), F.lit(0)).otherwise(F.coalesce("n", F.lit(0)) + F.coalesce("weight", F.lit(1)) - 1)
    out = out.select("vec_id", links.cast("long").alias("n_links"), F.coalesce("component_id", "class").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
