"""Repair of conversations by a min-plus scan of 4x4 matrices.

A repaired conversation has the role initials `(s?(ua)+)?`. Four states read them: nothing yet, after s, after u, after a; the first and the last
are accepted. A turn is a matrix of (cost, audit) elements from state to state: Keep costs 0, Rerole to user or assistant 1,
Delete 2, and before each of them any Inserts of an empty user or assistant turn at 5 each (the insert closure); blank and repeated turns can
only be deleted, and a truncated turn that stays costs 5 more. The product of two matrices adds costs and joins audits, and keeps the cheapest, at
a tie the ASCII-least audit. Two audits over the same turns are never one the beginning of the other (each ends with its last turn's edit), so
the product is associative and turns can be multiplied in any grouping.

Rows are dealt by ranges of (conversation, turn, MD5 of role and text, row number), so a long conversation is spread over tasks and
copies of one row are, too. A task finishes the conversations that lie wholly within it. Those at its ends, and those of more than
BLOCK_ROWS turns or BLOCK_BYTES of text, go on as blocks: a block's matrix comes from a tree of products; above blocks the
elements are (cost, rank of the audit among those from the same state), which is all that products compare, and FAN nodes
make one of the next level until one is left. On the way back each node tells its parts from which state to which they lead,
and each block writes its part of the audit and of the repaired text. SHA-256 reads a text from its beginning to its end, so
the parts of a conversation are streamed through one task, in order and never held together.

Faults, the first of which counts: blank (no character but space and \\x09-\\x0D), duplicate (a turn of the same role and text came earlier),
truncated (the last character but those is none of .!?). Null roles and texts are one space. Turns go in ascending order, nulls
first, turns of one number by the MD5 of the length of the role, a colon, role and text. A null conversation is one conversation. A role's initial is its first character; a
role without any is never kept. The rows must come in the same order when a task is repeated, as those of a table do: write others first.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hopwise.llm.shared import discard, small_batches, stored

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
BLOCK_ROWS, BLOCK_BYTES, FAN = 4096, 4 << 20, 512
SPACE = " \t\n\x0b\x0c\r"
STATES = range(4)
#: The state after reading an initial in a state.
STEPS = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
ACCEPTED = (0, 3)
Matrix = tuple[dict[int, tuple[int, str]], ...]


def times(x: Matrix, y: Matrix) -> Matrix:
    out: Matrix = ({}, {}, {}, {})
    for row, into in zip(x, out, strict=True):
        for k, (c, a) in row.items():
            for j, (d, b) in y[k].items():
                old = into.get(j)
                if old is None or c + d < old[0] or (c + d == old[0] and a + b < old[1]):
                    into[j] = (c + d, a + b)
    return out


def _closure() -> Matrix:
    one: Matrix = tuple({i: (0, "")} | {j: (INSERT, "I") for (r, k), j in STEPS.items() if k == i and r != "s"} for i in STATES)
    return times(times(one, one), one)


INSERTS = _closure()


@functools.cache
def turn(kind: str) -> Matrix:
    """Of one turn: `d` can only be deleted, else its initial (s, u, a, or o for any other), a capital for a truncated turn."""
    own: Matrix = tuple({i: (DELETE, "D")} for i in STATES)
    if kind != "d":
        more = TRUNCATED if kind.isupper() else 0
        for (role, i), j in STEPS.items():
            if role != "s":
                own[i][j] = (REROLE + more, "R")
        for (role, i), j in STEPS.items():
            if role == kind.lower():
                own[i][j] = (KEEP + more, "K")
    return times(INSERTS, own)


def product(kinds: str) -> Matrix:
    """Of some turns, by a tree of products; short stretches are remembered."""
    return _short(kinds) if len(kinds) <= 16 else times(product(kinds[: len(kinds) // 2]), product(kinds[len(kinds) // 2 :]))


@functools.lru_cache(1 << 14)
def _short(kinds: str) -> Matrix:
    return turn(kinds) if len(kinds) == 1 else times(_short(kinds[: len(kinds) // 2]), _short(kinds[len(kinds) // 2 :]))


def ended(row: dict[int, tuple[int, str]]) -> tuple[int, str, int]:
    """(cost, audit, state before the last inserts) of the cheapest way to an accepted state, given those to each state."""
    return min((c + d, a + b, i) for i, (c, a) in row.items() for j, (d, b) in INSERTS[i].items() if j in ACCEPTED)


def edited(audit: str, state: int, turns: Iterator[tuple[str, str]]) -> list[str]:
    """The repaired turns of a stretch that an audit leads through from a state."""
    out = []
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(turns)
        if edit == "D":
            continue
        if edit != "K":
            role = "assistant" if state == 2 else "user"
        state = STEPS[role[:1], state]
        out.append(f"{role}:{text}")
    return out


def fault_of(text: str) -> str:
    solid = text.rstrip(SPACE)
    return "b" if not solid else "" if solid[-1] in ".!?" else "t"


def kind_of(role: str, fault: str) -> str:
    initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
    return "d" if fault in ("b", "d") else initial.upper() if fault == "t" else initial


def crossings(initials: list[str]) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))


class Stretch:
    """Consecutive turns of one conversation in a task."""

    def __init__(self):
        self.turns, self.roles, self.texts, self.keys, self.faults = [], [], [], [], []
        self.seen: set[bytes] = set()
        self.bytes = 0

    def add(self, turn, role: str, text: str, key: bytes) -> None:
        fault = fault_of(text)
        if fault != "b":
            fault = "d" if key in self.seen else fault
            self.seen.add(key)
        for to, x in ((self.turns, turn), (self.roles, role), (self.texts, text), (self.keys, key), (self.faults, fault)):
            to.append(x)
        self.bytes += len(text) + len(role)

    def full(self, rows: int) -> bool:
        return len(self.turns) >= rows or self.bytes >= BLOCK_BYTES

    def kinds(self) -> str:
        return "".join(map(kind_of, self.roles, self.faults))

    def known(self) -> list[int | None]:
        """first turn, last turn, distinct turns, blank, duplicate, truncated, illegal."""
        numbers = [t for t in self.turns if t is not None]
        ends = [numbers[0], numbers[-1]] if numbers else [None, None]
        return [*ends, len(set(numbers)), *(self.faults.count(f) for f in "bdt"), crossings([r[:1] for r in self.roles])]

    def result(self) -> tuple:
        first, last, distinct, *counts = self.known()
        cost, audit, state = ended(product(self.kinds())[0])
        text = "\n".join(edited(audit, 0, iter(zip(self.roles, self.texts, strict=True))))
        return (0 if first is None else last - first + 1 - distinct, *counts, cost, audit, hashlib.sha256(text.encode()).hexdigest())


SHOWN = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
OPEN = "part int, block int, at int, turn long, role string, text string, key binary, fault string"


def _schema(conv: T.StructField, *parts: str) -> T.StructType:
    return T.StructType([conv, *T._parse_datatype_string(", ".join(parts))])


def _arrow(rows: list[tuple], schema: T.StructType):
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    wanted = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(wanted)], schema=wanted)


def _read(schema: T.StructType, block_rows: int):
    """From rows in order: results of the conversations that lie within the task, and the turns of those that may not."""

    def run(batches):
        from pyspark import TaskContext

        part, out = TaskContext.get().partitionId(), []
        conv, begun, first, block, here = None, False, True, 0, Stretch()

        def opened() -> None:
            nonlocal block, here
            for i, x in enumerate(zip(here.turns, here.roles, here.texts, here.keys, here.faults, strict=True)):
                out.append((conv, *[None] * 8, part, block, i, *x))
            block, here = block + 1, Stretch()

        def closed() -> None:
            nonlocal first, block, here
            if first or block:
                opened()
            else:
                out.append((conv, *here.result(), *[None] * 8))
            first, block, here = False, 0, Stretch()

        for batch in batches:
            for c, *row in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if begun and c != conv:
                    closed()
                if here.full(block_rows):
                    opened()
                conv, begun = c, True
                here.add(*row)
            if len(out) > 1000:
                yield _arrow(out, schema)
                out.clear()
        if begun:
            opened()
        if out:
            yield _arrow(out, schema)

    return run


# ---- conversations in several blocks

INFINITE = -1
NODE = "place long, costs array<long>, ranks array<int>, known array<long>, initials array<string>"


class Node:
    """The product of some blocks: costs from state to state, ranks of the audits from a state, and the parts with the state between them."""

    def __init__(self, costs: list[int], ranks: list[int], left: Node | None = None, right: Node | None = None, middle: dict | None = None):
        self.costs, self.ranks, self.left, self.right, self.middle = costs, ranks, left, right, middle or {}

    @classmethod
    def of(cls, m: Matrix) -> Node:
        costs, ranks = [INFINITE] * 16, [0] * 16
        for i in STATES:
            for rank, j in enumerate(sorted(m[i], key=lambda j: m[i][j][1])):
                costs[4 * i + j], ranks[4 * i + j] = m[i][j][0], rank
        return cls(costs, ranks)

    @classmethod
    def over(cls, nodes: list[Node]) -> Node:
        if len(nodes) == 1:
            return nodes[0]
        x, y = cls.over(nodes[: len(nodes) // 2]), cls.over(nodes[len(nodes) // 2 :])
        out = cls([INFINITE] * 16, [0] * 16, x, y)
        for i in STATES:
            for j in STATES:
                ways = [(x.costs[4 * i + k] + y.costs[4 * k + j], x.ranks[4 * i + k], k) for k in STATES if INFINITE not in (x.costs[4 * i + k], y.costs[4 * k + j])]
                if ways:
                    out.costs[4 * i + j], _, out.middle[i, j] = min(ways)
            found = [j for j in STATES if (i, j) in out.middle]
            found.sort(key=lambda j: (x.ranks[4 * i + out.middle[i, j]], y.ranks[4 * out.middle[i, j] + j]))
            for rank, j in enumerate(found):
                out.ranks[4 * i + j] = rank
        return out

    def ways(self, i: int, j: int) -> list[tuple[int, int]]:
        """From which state to which each of the nodes below leads, in order."""
        if self.left is None:
            return [(i, j)]
        k = self.middle[i, j]
        return self.left.ways(i, k) + self.right.ways(k, j)


def _block(schema: T.StructType):
    """A row for each block: its node and its turns."""

    def run(table):
        import pyarrow as pa

        table = table.sort_by("at")
        x = Stretch()
        x.turns, x.roles, x.texts, x.faults = (table.column(c).to_pylist() for c in ("turn", "role", "text", "fault"))
        node = Node.of(product(x.kinds()))
        row = (table.column(0)[0].as_py(), table.column("place")[0].as_py(), node.costs, node.ranks, x.known(), [x.roles[0][:1], x.roles[-1][:1]], x.kinds(), x.roles, x.texts)
        return pa.Table.from_batches([_arrow([row], schema)])

    return run


def _joined(known: list[list], initials: list[list[str]]) -> tuple[list, list[str]]:
    """What is known of consecutive stretches together."""
    ends = [(k[0], k[1]) for k in known if k[0] is not None]
    distinct = sum(k[2] for k in known) - sum(a[1] == b[0] for a, b in zip(ends, ends[1:], strict=False))
    counts = [sum(k[i] for k in known) for i in range(3, 7)]
    counts[3] += sum(crossings([a[1], b[0]]) for a, b in zip(initials, initials[1:], strict=False))
    return [*(([ends[0][0], ends[-1][1]]) if ends else (None, None)), distinct, *counts], [initials[0][0], initials[-1][1]]


def _up(schema: T.StructType):
    def run(table):
        import pyarrow as pa

        table = table.sort_by("place")
        costs, ranks, known, initials = (table.column(c).to_pylist() for c in ("costs", "ranks", "known", "initials"))
        node = Node.over([Node(*x) for x in zip(costs, ranks, strict=True)])
        row = (table.column(0)[0].as_py(), table.column("above")[0].as_py(), node.costs, node.ranks, *_joined(known, initials))
        return pa.Table.from_batches([_arrow([row], schema)])

    return run


def _down(schema: T.StructType):
    """Given from which state to which a node leads: the same of its parts."""

    def run(table):
        import pyarrow as pa

        table = table.sort_by("place")
        costs, ranks = (table.column(c).to_pylist() for c in ("costs", "ranks"))
        ways = Node.over([Node(*x) for x in zip(costs, ranks, strict=True)]).ways(table.column("enter")[0].as_py(), table.column("leave")[0].as_py())
        conv = table.column(0)[0].as_py()
        return pa.Table.from_batches([_arrow([(conv, p, *w) for p, w in zip(table.column("place").to_pylist(), ways, strict=True)], schema)])

    return run


def _roots(schema: T.StructType):
    """Of the one node of each conversation: its results but the audit, the states it leads between and the inserts at the end."""

    def run(batches):
        for batch in batches:
            out = []
            for conv, place, costs, ranks, known, _ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                # a rank, as text of one digit, stands for the audit
                cost, audit, state = ended({j: (costs[j], str(ranks[j])) for j in STATES if costs[j] != INFINITE})
                first, last, distinct, *counts = known
                out.append((conv, place, 0 if first is None else last - first + 1 - distinct, *counts, cost, state, audit[1:]))
            yield _arrow(out, schema)

    return run


def _pieces(schema: T.StructType):
    def run(batches):
        for batch in batches:
            for conv, place, kinds, roles, texts, enter, leave in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                audit = product(kinds)[enter][leave][1]
                yield _arrow([(conv, place, audit, edited(audit, enter, iter(zip(roles, texts, strict=True))))], schema)

    return run


def _hashed(schema: T.StructType):
    """Rows in order, (conversation, place, audit, repaired turns, inserts at the end, the state before them): (conversation, audit, digest)."""

    def run(batches):
        done, conv, digest, audit, tail, begun = [], None, None, [], None, False

        def ending() -> None:
            for line in edited(tail[0], tail[1], iter(())):
                fed(line)
            done.append((conv, "".join(audit) + tail[0], digest.hexdigest()))

        def fed(line: str) -> None:
            nonlocal begun
            digest.update((("\n" if begun else "") + line).encode())
            begun = True

        for batch in batches:
            for c, _, piece, lines, inserts, state in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if digest is None or c != conv:
                    if digest is not None:
                        ending()
                    conv, digest, audit, begun = c, hashlib.sha256(), [], False
                tail = (inserts, state)
                audit.append(piece)
                for line in lines:
                    fed(line)
        if digest is not None:
            ending()
        if done:
            yield _arrow(done, schema)

    return run


def _in_blocks(rows: DataFrame, conv: T.StructField, fan: int) -> DataFrame:
    """Results of the conversations whose turns are in several blocks."""
    same = lambda a, b: a["conv_id"].eqNullSafe(b["__conv"])
    named = lambda df: df.withColumnRenamed("conv_id", "__conv")
    span = (rows.agg(F.max("block")).first()[0] or 0) + 1
    rows = rows.withColumn("place", F.col("part").cast("long") * span + F.col("block"))
    # within a block repeats are known: a block has at most one row of a key here
    firsts = rows.where("fault <> 'b' and fault <> 'd'").groupBy("conv_id", "key").agg(F.min("place").alias("__first"), F.count(F.lit(1)).alias("__n")).where("__n > 1")
    firsts = named(firsts).withColumnRenamed("key", "__key")
    again = rows.join(firsts, same(rows, firsts) & (F.col("key") == F.col("__key")), "left")
    again = again.withColumn("fault", F.when(F.col("fault").isin("b", "d"), F.col("fault")).when(F.col("place") > F.col("__first"), "d").otherwise(F.col("fault")))
    block = _schema(conv, NODE, "kinds string, roles array<string>, texts array<string>")
    blocks = stored(again.select("conv_id", "place", "at", "turn", "role", "text", "fault").groupBy("conv_id", "place").applyInArrow(_block(block), block))

    node = _schema(conv, NODE)
    levels = [blocks.select(*node.names)]
    most = levels[0].agg(F.max("place")).first()[0]
    while most:
        above = levels[-1].withColumn("above", F.floor(F.col("place") / fan)).groupBy("conv_id", "above").applyInArrow(_up(node), node)
        levels.append(stored(above))
        most //= fan
    root = _schema(conv, "place long", ", ".join(SHOWN.split(", ")[:6]), "state int, inserts string")
    roots = stored(levels[-1].mapInArrow(_roots(root), root))
    way = _schema(conv, "place long, enter int, leave int")
    ways = roots.select("conv_id", "place", F.lit(0).alias("enter"), F.col("state").alias("leave"))
    for below in reversed(levels[:-1]):
        led = named(ways).withColumnRenamed("place", "above")
        parts = below.withColumn("above", F.floor(F.col("place") / fan)).alias("b")
        parts = parts.join(led, same(parts, led) & (parts["above"] == led["above"])).drop(led["above"]).drop("__conv")
        ways = parts.select("conv_id", "place", "above", "costs", "ranks", "enter", "leave").groupBy("conv_id", "above").applyInArrow(_down(way), way)
    ways = stored(ways)
    piece = _schema(conv, "place long, audit string, lines array<string>")
    led = named(ways).withColumnRenamed("place", "__place")
    parts = blocks.join(led, same(blocks, led) & (F.col("place") == F.col("__place"))).select("conv_id", "place", "kinds", "roles", "texts", "enter", "leave")
    parts = parts.mapInArrow(_pieces(piece), piece)
    last = named(roots.select("conv_id", "inserts", "state"))
    parts = parts.join(last, same(parts, last)).select("conv_id", "place", "audit", "lines", "inserts", "state")
    text = _schema(conv, "audit string, repaired_sha256 string")
    texts = stored(parts.repartition("conv_id").sortWithinPartitions("conv_id", "place").mapInArrow(_hashed(text), text))
    discard(ways, *levels[1:], blocks)
    texts = named(texts)
    return roots.join(texts, same(roots, texts)).select("conv_id", *[x.split()[0] for x in SHOWN.split(", ")])


def repaired(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", block_rows: int = BLOCK_ROWS, fan: int = FAN) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256): one row for each conversation."""
    small_batches(turns.sparkSession)
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (role_col, text_col))
    key = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), text.alias("text"), key.alias("key"))
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    rows = rows.repartitionByRange("conv_id", "turn", "key", "row").sortWithinPartitions("conv_id", "turn", "key").drop("row")
    conv = rows.schema["conv_id"]
    schema = _schema(conv, SHOWN, OPEN)
    read = stored(rows.mapInArrow(_read(schema, block_rows), schema))
    show = ["conv_id", *[x.split()[0] for x in SHOWN.split(", ")]]
    done, more = read.where("part is null").select(*show), read.where("part is not null").drop(*show[1:])
    return done if more.isEmpty() else done.union(stored(_in_blocks(more, conv, fan)))


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with faults: a twentieth of the rows each is dropped, emptied, loses its stops, is repeated and is given to the user."""
    fill = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    way = F.crc32(F.concat(fill("conv_id"), F.lit(":"), fill("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", fill("role").alias("role"), fill("text").alias("text"), way.alias("way")).where("way <> 0")
    text = F.when(F.col("way") == 1, "").when(F.col("way") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("way") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(F.when(F.col("way") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return rows.drop("col")


def damaged_and_repaired(turns: DataFrame) -> DataFrame:
    """`repaired` of `damaged` turns, with a row for every conversation, those too that lost all turns."""
    every = turns.select(F.col("conv_id").alias("__conv")).distinct()
    out = repaired(damaged(turns))
    numbers, words = out.columns[1:7], {"audit": "", "repaired_sha256": hashlib.sha256().hexdigest()}
    out = every.join(out, F.col("__conv").eqNullSafe(F.col("conv_id")), "left")
    return out.select(F.col("__conv").alias("conv_id"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers], *[F.coalesce(c, F.lit(x)).alias(c) for c, x in words.items()])


def _plus(way: str, cost: str, edits: str) -> str:
    return f"lpad(cast(cast(left({way}, 9) as int) + {cost} as varchar), 9, '0') || substr({way}, 10) || '{edits}'"


def _least(*ways: str) -> str:
    return f"least({', '.join(ways)})"


_INSERTED = [
    "s0", "s1", _least("s2", *[_plus(x, "5", "I") for x in ("s0", "s1", "s3")]), _least("s3", *[_plus(x, "10", "II") for x in ("s0", "s1")], _plus("s2", "5", "I")),
]


def _stay(of: list[str], role: str) -> list[str]:
    keep = [f"case when kind <> 'd' and r = '{role}' then {_plus(x, 'more', 'K')} end" for x in of]
    return keep + ([f"case when kind <> 'd' then {_plus(x, 'more + 1', 'R')} end" for x in of] if role != "s" else [])


#: A way is its cost in nine digits and its audit, so the least text is the cheapest way with the ASCII-least audit; null where there is none.
ORACLE = f"""
with recursive filled as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') as id from conversations),
dealt as (select *, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(id, ''), lambda c: cast(ascii(c) as bigint))),
  lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)), lambda x, i: case when x % 2 = 1 then xor(x // 2, 3988292384) else x // 2 end)), 4294967295) % 20 as way from filled),
hurt as (select conv_id, turn, case way when 4 then 'user' else role end as role, case way when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
  from dealt, range(2) t(copy) where way <> 0 and (copy = 0 or way = 3)),
placed as materialized (select *, row_number() over (partition by conv_id order by turn nulls first, md5(length(role) || ':' || role || text)) as n from hurt),
told as (select *, left(role, 1) as r, regexp_replace(text, '[\x20\x09-\x0D]+$', '') as solid, row_number() over (partition by conv_id, role, text order by n) as time from placed),
t as materialized (select conv_id, turn, role, text, r, n, case when solid = '' then 'b' when time > 1 then 'd' when right(solid, 1) not in ('.', '!', '?') then 't' else '' end as fault,
  case when solid = '' or time > 1 then 'd' else 'k' end as kind, case when fault = 't' then 5 else 0 end as more,
  lag(r) over (partition by conv_id order by n) || r as pair from told),
known as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'b') as blank, count(*) filter (fault = 'd') as duplicate,
  count(*) filter (fault = 't') as truncated, count(*) filter (pair not in ('su', 'ua', 'au')) as illegal, max(n) as last from t group by conv_id),
w(conv_id, n, s0, s1, s2, s3) as (select conv_id, 0::bigint, '000000000', null::varchar, null::varchar, null::varchar from known
  union all select conv_id, n, {", ".join(
    _least(_plus(f"s{j}", "2", "D"), *_stay(of, role)) for j, of, role in ((0, [], "s"), (1, ["s0"], "s"), (2, ["s0", "s1", "s3"], "u"), (3, ["s2"], "a")))}
  from (select w.conv_id, t.n, r, kind, more, {", ".join(f"{x} as s{j}" for j, x in enumerate(_INSERTED))} from w join t on t.conv_id is not distinct from w.conv_id and t.n = w.n + 1)),
best as materialized (select conv_id, {_least("s0", _INSERTED[3])} as way from w join known using (conv_id) where n = last),
edits as (select conv_id, q, substr(way, 9 + q, 1) as edit, substr(way, 10, q) as sofar from best, range(1, 1000000) x(q) where q <= length(way) - 9),
made as (select e.conv_id, q, edit, role, text, r, length(replace(sofar, 'D', '')) as place from edits e left join t on t.conv_id = e.conv_id and edit <> 'I' and t.n = length(replace(sofar, 'I', ''))),
system as (select conv_id, max(case when place = 1 and edit = 'K' and r = 's' then 1 else 0 end) as s from made group by conv_id),
lines as (select conv_id, q, case when edit = 'K' then role when (place + s) % 2 = 1 then 'user' else 'assistant' end || ':' || case when edit = 'I' then '' else text end as line from made join system using (conv_id) where edit <> 'D'),
texts as (select conv_id, string_agg(line, chr(10) order by q) as line from lines group by conv_id)
select distinct c.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
  cast(coalesce(cast(left(way, 9) as int), 0) as bigint) as cost, coalesce(substr(way, 10), '') as audit, sha256(coalesce(line, '')) as repaired_sha256
from conversations c left join known using (conv_id) left join best using (conv_id) left join texts using (conv_id)
"""
