"""Which vertex tables can hold an id: a range and a Bloom filter for each table, built once and stored.

A table's filter has at least BITS bits for each of its ids, a power of two, in rows of 32,768 bits that Spark's bitmap aggregates put together
where the ids are. A look-up hashes the given ids, joins the few rows of the filters that they fall into, and names the tables
where some id has all of its HASHES bits set. A table that has changed since is always named.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopwise.operators import stored

BITS, HASHES, ROW = 10, 4, 1 << 15


@dataclass(frozen=True)
class IdIndex:
    rows: tuple  # of each table, as they were
    known: tuple[tuple, ...]  # of each table: number of ids, least, greatest, bits
    filled: DataFrame  # (t, bucket, bits)

    @classmethod
    def of(cls, tables: list) -> IdIndex:
        known = []
        for t in tables:
            r = t.df.agg(F.count("id").alias("n"), F.min("id").alias("a"), F.max("id").alias("b")).first()
            known.append((r["n"], r["a"], r["b"], max(ROW, 1 << (BITS * r["n"] - 1).bit_length())))
        parts = [_places(t.df.select("id"), i, bits) for i, (t, (n, *_, bits)) in enumerate(zip(tables, known, strict=True)) if n]
        if not parts:
            raise ValueError("no vertex has an id")
        filled = parts[0]
        for p in parts[1:]:
            filled = filled.union(p)
        filled = filled.groupBy("t", "bucket").agg(F.bitmap_construct_agg(F.col("bit").cast("long")).alias("bits"))
        return cls(tuple((t.rows, t.added) for t in tables), tuple(known), stored(filled))

    def holding(self, tables: list, ids: list) -> list:
        """The tables of the list that can hold some of the ids."""
        at = {id(rows): (i, added) for i, (rows, added) in enumerate(self.rows)}
        known = {i: at.get(id(t.rows), (None, ())) for i, t in enumerate(tables)}
        changed = {i for i, t in enumerate(tables) if known[i][0] is None or t.added != known[i][1]}
        asked = []
        for i in set(known) - changed:
            n, least, most, bits = self.known[known[i][0]]
            own = [x for x in ids if n and type(x) is type(least) and least <= x <= most]
            asked += [(i, known[i][0], bits, own)] if own else []
        found = set()
        if asked:
            spark, kind = self.filled.sparkSession, tables[0].df.schema["id"].dataType.simpleString()
            places = None
            for _, k, bits, own in asked:
                p = _places(spark.createDataFrame([(x,) for x in own], f"id {kind}"), k, bits)
                places = p if places is None else places.union(p)
            byte = F.conv(F.hex(F.substring(F.col("bits"), F.floor(F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
            is_set = F.call_function("getbit", F.coalesce(byte, F.lit(0)), (F.col("bit") % 8).cast("int"))
            hits = self.filled.join(F.broadcast(places), ["t", "bucket"]).groupBy("t", "id").agg(F.sum(is_set).alias("n")).where(F.col("n") == HASHES)
            found = {r["t"] for r in hits.select("t").distinct().collect()}
        return [t for i, t in enumerate(tables) if i in changed or any(i == a and k in found for a, k, *_ in asked)]


def _places(ids: DataFrame, table: int, bits: int) -> DataFrame:
    """(t, id, bucket, bit): where an id's bits lie."""
    at = F.explode(F.array(*[F.pmod(F.xxhash64("id", F.lit(h)), F.lit(bits)) for h in range(HASHES)]))
    rows = ids.where("id is not null").select(F.lit(table).alias("t"), "id", at.alias("place"))
    return rows.select("t", "id", F.floor(F.col("place") / ROW).alias("bucket"), (F.col("place") % ROW).cast("int").alias("bit"))
