"""Product codes of vectors: four integer codebooks, searched by partial distances.

Each component x becomes the integer floor(SCALE * x), and a vector is cut into PARTS equal consecutive parts. The codebook of a part position
begins as that part of the ENTRIES vectors with the smallest ids. A round assigns every part to the nearest entry of its
codebook (squared Euclidean distance, the lower index at a tie) and puts the floor of the mean of its parts in the place of each entry; an
entry without parts stays. After the last round all parts are assigned once more.

The nearest entry is found by partial distances: dimensions are taken in descending order of the codebook's variance, and a mask drops
an entry for a vector as soon as its accumulated integer distance exceeds, strictly, the best complete distance that is known
for that vector. So ties survive, and the result is that of a search over all entries.

A round sends the codebooks (ENTRIES * width integers, whatever the number of vectors) to the tasks and gets one row of
sums for each entry and task, which are added up before they reach the driver. No vector is shuffled.

Vectors that are null or empty, or hold nulls or values that are not finite, are left out, and so are those whose length is not
that of the vector with the smallest id. A length that is no multiple of PARTS is filled up with zeros. Integers beyond
LARGEST on either side are cut to it, so that distances of up to 64 dimensions fit into a long whatever the values. Null ids come after all
others; vectors that repeat an id are vectors of their own, in the order of their bytes where order matters. An empty table gives no row. Null labels are one label.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hopwise.llm.shared import discard, stored

ENTRIES, PARTS, ROUNDS, SCALE, LARGEST = 256, 4, 4, 1024, 1 << 27
ROWS, DENSE = 256, 0.1
BROADCAST_LABEL_BYTES = 16 << 20


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of the nearest entry of a codebook (entries by dimensions) for each row of x, both integers."""
    order = np.argsort(-book.astype(float).var(axis=0), kind="stable")
    widest = int(np.abs(x).max(initial=0)) + int(np.abs(book).max(initial=0))
    kind = np.float64 if widest * widest * max(1, book.shape[1]) < 1 << 52 else np.int64  # doubles hold such integers exactly
    book = book[:, order].astype(kind)
    index, best = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    for r in range(0, len(x), ROWS):
        index[r : r + ROWS], best[r : r + ROWS] = _searched(x[r : r + ROWS, order].astype(kind), book)
    return index, best


def _searched(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`nearest` with the dimensions in the order of search: the first half at once, then quarters while most entries are left, then one by one."""
    n, dims, at, step = len(x), x.shape[1], 0, -(-x.shape[1] // 2)
    total = np.zeros((n, len(book)), x.dtype)
    best = np.full(n, np.inf if x.dtype == np.float64 else np.iinfo(x.dtype).max, x.dtype)
    alive = np.ones(total.shape, bool)
    while at < dims:
        a, b = x[:, at : at + step], book[:, at : at + step]
        total += a @ (-2 * b.T)
        total += (a * a).sum(axis=1)[:, None]
        total += (b * b).sum(axis=1)
        at, step = at + step, max(1, dims // 4)
        guess = total.argmin(axis=1)
        best = np.minimum(best, ((x - book[guess]) ** 2).sum(axis=1))
        alive = total <= best[:, None]
        if np.count_nonzero(alive) <= DENSE * alive.size:
            break
    flat = np.flatnonzero(alive)
    row, entry = np.divmod(flat, len(book))
    part = total.ravel()[flat]
    for j in range(at, dims):
        part += (x[row, j] - book[entry, j]) ** 2
        left = np.flatnonzero(part <= best[row])
        row, entry, part = row[left], entry[left], part[left]
    first = np.searchsorted(row, np.arange(n))
    least = np.minimum.reduceat(part, first)
    hits = np.flatnonzero(part == least[row])
    return entry[hits[np.searchsorted(row[hits], np.arange(n))]], least


def whole_numbers(batches):
    """(..., v): the integers of each vector as bytes, null for vectors that are left out; other columns as they are."""
    import pyarrow as pa

    for batch in batches:
        lists = batch.column(batch.num_columns - 1).cast(pa.large_list(pa.float64()))
        values = np.asarray(lists.values.fill_null(float("nan")).to_numpy(zero_copy_only=False))
        bounds = lists.offsets.to_numpy()
        odd = np.concatenate(([0], np.cumsum(~np.isfinite(values))))
        good = np.asarray(lists.is_valid()) & (np.diff(bounds) > 0) & (odd[bounds[1:]] == odd[bounds[:-1]])
        with np.errstate(over="ignore", invalid="ignore"):
            whole = np.nan_to_num(np.clip(np.floor(values * SCALE), -LARGEST, LARGEST)).astype("<i4")
        made = [whole[a:b].tobytes() if g else None for a, b, g in zip(bounds[:-1].tolist(), bounds[1:].tolist(), good.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(made, pa.binary())], names=[*batch.schema.names[:-1], "v"])


def parts(values: list[bytes], width: int) -> np.ndarray:
    """Integers of some vectors by vector, part and place; the last part filled up with zeros."""
    x = np.frombuffer(b"".join(values), "<i4").reshape(len(values), width)
    x = np.pad(x, ((0, 0), (0, -width % PARTS)))
    return x.reshape(len(values), PARTS, -1).astype(np.int64)


def _sums(books: np.ndarray, width: int):
    """(part, entry, n, sums): what a task adds up for the entries that its vectors are nearest to."""

    def run(batches):
        import pyarrow as pa

        count, total = np.zeros(books.shape[:2], np.int64), np.zeros(books.shape, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = parts(batch.column("v").to_pylist(), width)
            for p in range(PARTS):
                at, _ = nearest(x[:, p], books[p])
                order = np.argsort(at, kind="stable")
                used, begin = np.unique(at[order], return_index=True)
                count[p, used] += np.diff(np.append(begin, len(at)))
                total[p, used] += np.add.reduceat(x[order, p], begin, axis=0)
        p, e = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(count[p, e]), pa.array(list(total[p, e]), pa.list_(pa.int64()))], names=["part", "entry", "n", "sums"])

    return run


def _codes(books: np.ndarray, width: int):
    """(..., code, error) in the place of the last column, v."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            code, error = np.zeros((batch.num_rows, PARTS), np.uint8), np.zeros(batch.num_rows, np.int64)
            if batch.num_rows:
                x = parts(batch.column("v").to_pylist(), width)
                for p in range(PARTS):
                    code[:, p], far = nearest(x[:, p], books[p])
                    error += far
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([c.tobytes().hex() for c in code], pa.string()), pa.array(error)], names=[*batch.schema.names[:-1], "code", "error"])

    return run


def trained(vectors: DataFrame, width: int, books: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """The codebooks (part, entry, place) after some rounds over the vectors `v`."""
    books = books.copy()
    for _ in range(rounds):
        found = vectors.select("v").mapInArrow(_sums(books, width), "part int, entry int, n long, sums array<long>")
        each = [F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(books.shape[2])]
        for r in found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *each).collect():
            books[r["part"], r["entry"]] = [r[f"s{i}"] // r["n"] for i in range(books.shape[2])]
    return books


def digest(books: np.ndarray) -> str:
    """SHA-256 of all integers by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def coded(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256): one row for each vector that is not left out."""
    given = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    held = T.StructType([given.schema["vec_id"], given.schema["label"]])
    rows = stored(given.mapInArrow(whole_numbers, T.StructType([*held, T.StructField("v", T.BinaryType())])).where("v is not null"))
    first = rows.select("vec_id", "v").orderBy(F.col("vec_id").asc_nulls_last(), "v")
    width = next((len(r["v"]) // 4 for r in first.limit(1).collect()), PARTS)
    fits = rows.where(F.octet_length("v") == 4 * width)
    begin = [bytes(r["v"]) for r in first.where(F.octet_length("v") == 4 * width).limit(ENTRIES).collect()]
    books = trained(fits, width, parts(begin, width).transpose(1, 0, 2)) if begin else np.zeros((PARTS, 0, 0), np.int64)
    made = T.StructType([*held, T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    done = stored(fits.mapInArrow(_codes(books, width), made))
    discard(rows)
    sums = done.groupBy(F.col("label").alias("__label")).agg(F.sum("error").alias("label_error"))
    size = sums.agg(F.sum(F.coalesce(F.octet_length(F.col("__label").cast("string")), F.lit(0)) + 16)).first()[0] or 0
    sums = F.broadcast(sums) if size <= BROADCAST_LABEL_BYTES else sums
    out = done.join(sums, F.col("label").eqNullSafe(F.col("__label")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _rounds(n: int) -> str:
    dist = "cast(list_inner_product(x, x) + list_inner_product(c, c) - 2 * list_inner_product(x, c) as bigint)"
    out = []
    for i in range(n + 1):
        out.append(f"a{i} as materialized (select id, k, min({dist} * 256 + e) as m from p join b{i} using (k) group by all)")
        if i < n:
            sums = f"select k, m % 256 as e, j, cast(sum(x[j]) as bigint) as s, count(*) as n from a{i} join p using (id, k), range(1, (select max(len(x)) from p) + 1) t(j) group by all"
            out.append(f"""b{i + 1} as materialized (select k, e, coalesce(n.c, b{i}.c) as c from b{i} left join (
  select k, e, list(cast((s - ((s % n) + n) % n) // n as double) order by j) as c from ({sums}) group by k, e) n using (k, e))""")
    return ",\n".join(out)


ORACLE = f"""
with kept as materialized (select row_number() over (order by vec_id) as id, vec_id, label, list_transform(embedding, lambda x: floor(1024 * cast(x as double))) as v
  from embeddings where len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as materialized (select id, k, list_slice(v, k * (len(v) // 4) + 1, (k + 1) * (len(v) // 4)) as x from kept, range(4) t(k)),
b0 as materialized (select k, id - 1 as e, x as c from p where id <= 256),
{_rounds(ROUNDS)},
done as (select id, string_agg(lpad(lower(to_hex(m % 256)), 2, '0'), '' order by k) as code, cast(sum(m // 256) as bigint) as error from a{ROUNDS} group by id),
books as (select sha256(string_agg(cast(cast(c[j] as bigint) as varchar), ',' order by k, e, j)) as codebooks_sha256 from b{ROUNDS}, range(1, (select max(len(x)) from p) + 1) t(j))
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256 from kept join done using (id), books
"""
