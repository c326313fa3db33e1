import hashlib
import math
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hopwise.llm import conversations, packing, vector_codes

SF = "/root/testdata/sf0.001"


def from_sql(sql, **tables):
    c = duckdb.connect()
    for name, path in tables.items():
        c.execute(f"create view {name} as select * from '{path}'")
    found = c.execute(sql)
    return [x[0] for x in found.description], sorted(found.fetchall())


# ---- vector codes


@pytest.mark.parametrize("width", [1, 3, 16, 40])
@pytest.mark.parametrize("scale", [1, 1 << 20])
def test_nearest_is_the_full_search(width, scale):
    rng = np.random.default_rng(width)
    x, book = rng.integers(-9, 9, (700, width)) * scale, rng.integers(-9, 9, (256, width)) * scale
    index, far = vector_codes.nearest(x, book)
    full = ((x[:, None] - book[None]) ** 2).sum(axis=-1)
    assert (index == full.argmin(axis=1)).all() and (far == full.min(axis=1)).all()


def test_codes_match_sql(spark):
    found = vector_codes.coded(spark.read.parquet(f"{SF}/embeddings.parquet"))
    names, want = from_sql(vector_codes.ORACLE, embeddings=f"{SF}/embeddings.parquet")
    assert found.columns == names
    assert sorted(map(tuple, found.collect())) == want


def plain_codes(rows):
    """Codes of (id, vector, label) by a plain version; dicts by id."""
    kept = [(i, [max(-(1 << 27), min(1 << 27, math.floor(1024 * x))) for x in v], lab) for i, v, lab in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    kept = [(i, v + [0] * (-len(v) % 4), lab) for i, v, lab in kept]
    w = len(kept[0][1]) // 4
    cut = lambda v, p: v[p * w : (p + 1) * w]
    books = [[cut(v, p) for _, v, _ in kept[:256]] for p in range(4)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    best = lambda v, p: min((far(cut(v, p), c), e) for e, c in enumerate(books[p]))
    for _ in range(4):
        groups = defaultdict(list)
        for _, v, _ in kept:
            for p in range(4):
                groups[p, best(v, p)[1]].append(cut(v, p))
        for (p, e), own in groups.items():
            books[p][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    sha = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    out = [(i, [best(v, p) for p in range(4)], lab) for i, v, lab in kept]
    by_label = defaultdict(int)
    for _, b, lab in out:
        by_label[lab] += sum(d for d, _ in b)
    return sorted(((i, "".join(f"{e:02x}" for _, e in b), sum(d for d, _ in b), by_label[lab], sha) for i, b, lab in out), key=repr)


def test_codes_of_odd_vectors(spark):
    rng = random.Random(5)
    rows = [(i, [round(rng.uniform(-1, 1), 2) for _ in range(6)], rng.choice(["a", "b", None])) for i in range(290)]
    rows += [(300, None, "a"), (301, [], "a"), (302, [0.5, None] * 3, "a"), (303, [float("nan")] * 6, "a"), (304, [float("inf")] * 6, None), (305, [1.0] * 5, "a")]
    rows += [(None, [0.25] * 6, None), (7, rows[7][1], "b"), (400, [1e300, -1e300, 0.0, 1.0, 2.0, 3.0], "big")]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label string, v string, error int").repartition(3)
    found = vector_codes.coded(df)
    assert found.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, found.collect()), key=repr) == plain_codes(rows)
    assert vector_codes.coded(df.limit(0)).count() == 0
    assert vector_codes.coded(df.where("vec_id in (300, 301, 303)")).count() == 0


# ---- packing


def path():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def whole():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path())


@pytest.fixture(scope="module")
def encode():
    return packing.encoder(path())


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \t\n\r\x0b\x0c\x1c\x85 '.,!?abcABCéÉßİΣς́9"))))
def test_ids_of_words_are_those_of_the_text(encode, whole, text):
    assert np.frombuffer(encode(text), np.uint32).tolist() == whole.encode(text, add_special_tokens=False).ids


def test_ids_of_other_tokenizers(tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    other = public_tokenizers.path("byte_bpe_50k.json")
    text = "Two  words,\n and <more> of them. "
    assert np.frombuffer(packing.encoder(other)(text), np.uint32).tolist() == Tokenizer.from_file(other).encode(text, add_special_tokens=False).ids


@given(st.lists(st.integers(1, 300)), st.integers(1, 5), st.sampled_from([1, 4, 64]))
@settings(max_examples=200, deadline=None)
def test_packer_places_everything_once(lengths, most, least_cut):
    packer = packing.Packer(64, most, least_cut)
    out = [w for i, n in enumerate(lengths) for w in packer.put(i, n)]
    assert all(sum(x[2] for x in w) > 64 - least_cut for w in out)
    left = list(packer.left())
    assert len(left) <= most
    seen = sorted(x for w in out + left for x in w)
    assert all(sum(x[2] for x in w) <= 64 for w in left)
    at = defaultdict(int)
    for doc, start, n in seen:
        assert start == at[doc] and n > 0
        at[doc] += n
    assert dict(at) == dict(enumerate(lengths))


@given(st.integers(0, 700), st.lists(st.integers(1, 90)))
def test_cuts_cover_a_stream_with_sequences_without_padding(more, runs):
    total = sum(runs) + more
    runs = runs + ([more] if more else [])
    used, at = defaultdict(list), 0
    for n in runs:
        for sequence, offset, a, b in packing.cuts(at, at + n, total, 64):
            used[sequence].append((offset, b - a))
        at += n
    for spans in used.values():
        assert all(o == sum(x[1] for x in spans[:i]) for i, (o, _) in enumerate(spans))
        size = sum(x[1] for x in spans)
        assert size <= 64 and size & (size - 1) == 0


def check_packing(found, texts, whole, window):
    """texts: (id, text) rows with distinct ids."""
    ids = {k: np.array([*whole.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for k, t in texts}
    by, sequences = defaultdict(list), defaultdict(list)
    for r in found:
        by[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
        assert r["doc_tokens"] == len(ids[r["doc_id"]])
        assert r["ids_crc32"] == zlib.crc32(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes())
    assert set(by) == set(ids)
    for k, rows in by.items():
        at = 0
        for r in sorted(rows, key=lambda r: r["start"]):
            assert r["start"] == at
            at += r["length"]
        assert at == len(ids[k])
    padding = 0
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding / sum(map(len, ids.values()))


def test_packing_documents(spark, whole):
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(3)
    texts = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    found = packing.packed(docs, path())
    assert found.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert check_packing(found.collect(), texts, whole, 4096) < 0.01


def test_packing_odd_documents(spark, whole):
    texts = [(1, None), (2, ""), (3, "a " * 5000), (4, "word" * 3000), (None, "no id"), (6, "\n\n"), *((i, "some words of text " * (i % 13)) for i in range(10, 90))]
    df = spark.createDataFrame([(*t, 5, 6) for t in texts], "doc_id long, text string, length int, ids int").repartition(4)
    assert check_packing(packing.packed(df, path(), window=64, most=3, least_cut=4).collect(), texts, whole, 64) < 0.05
    again = packing.packed(df.where("doc_id < 20").union(df.where("doc_id < 20")), path(), window=64)
    assert again.agg({"length": "sum"}).first()[0] == 2 * sum(len(whole.encode(t or "", add_special_tokens=False).ids) + 1 for k, t in texts if k and k < 20)
    assert packing.packed(df.limit(0), path()).count() == 0


# ---- conversations

SPACE = " \t\n\x0b\x0c\r"


def plain_repair(rows):
    """Results of one conversation's (turn, role, text) rows in order, by a search forward over states that keeps the cheapest way to each."""
    seen, faults = set(), []
    for _, role, text in rows:
        solid = text.strip(SPACE)
        faults.append("b" if not solid else "d" if (role, text) in seen else "" if solid[-1] in ".!?" else "t")
        seen.add((role, text))
    after = {"s": {"": "s"}, "u": {"": "u", "s": "u", "a": "u"}, "a": {"u": "a"}}

    def put(ways, state, way):
        if state not in ways or way[:2] < ways[state][:2]:
            ways[state] = way

    def inserted(ways):
        for _ in range(3):
            for state, (cost, audit, lines) in list(ways.items()):
                for role in ("user", "assistant"):
                    if state in after[role[0]]:
                        put(ways, after[role[0]][state], (cost + 5, audit + "I", (*lines, role + ":")))
        return ways

    ways = {"": (0, "", ())}
    for (_, role, text), fault in zip(rows, faults, strict=True):
        new: dict = {}
        for state, (cost, audit, lines) in inserted(ways).items():
            put(new, state, (cost + 2, audit + "D", lines))
            if fault in ("b", "d"):
                continue
            more = 5 if fault == "t" else 0
            for to, edit, price in ((role, "K", 0), ("user", "R", 1), ("assistant", "R", 1)):
                if state in after.get(to[:1], {}):
                    put(new, after[to[:1]][state], (cost + more + price, audit + edit, (*lines, f"{to}:{text}")))
        ways = new
    cost, audit, lines = min(x for s, x in inserted(ways).items() if s in ("", "a"))
    turns = [t for t, _, _ in rows if t is not None]
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:], strict=False)]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, *(faults.count(f) for f in "bdt"), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def plain_damage(rows):
    by: dict = {}
    for conv, turn, role, text in rows:
        shown = [" " if x is None else x for x in (conv, turn, role, text)]
        way = zlib.crc32(f"{shown[0]}:{shown[1]}".encode()) % 20
        role, text = shown[2:]
        text = {1: "", 2: text.translate(str.maketrans("", "", ".!?"))}.get(way, text)
        by.setdefault(conv, []).extend([(turn, "user" if way == 4 else role, text)] * {0: 0, 3: 2}.get(way, 1))
    for own in by.values():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
    return {k: plain_repair(v) for k, v in by.items()}


def test_repair_matches_sql_and_brute_force(spark):
    turns = spark.read.parquet(f"{SF}/conversations.parquet")
    found = conversations.damaged_and_repaired(turns)
    names, want = from_sql(conversations.ORACLE, conversations=f"{SF}/conversations.parquet")
    assert found.columns == names
    found = sorted(map(tuple, found.collect()))
    assert found == want
    assert {r[0]: r[1:] for r in found} == plain_damage(turns.select("conv_id", "turn", "role", "text").collect())


@given(st.text("suaoSUAOd", max_size=40), st.integers(0, 40))
@settings(max_examples=200, deadline=None)
def test_products_are_associative_with_and_without_texts(kinds, at):
    at = min(at, len(kinds))
    parts = [x for x in (kinds[:at], kinds[at:]) if x]
    if len(parts) < 2:
        return
    whole = conversations.product(kinds)
    assert whole == conversations.times(*map(conversations.product, parts))
    ranked = conversations.Node.over([conversations.Node.of(conversations.product(p)) for p in parts])
    plain = conversations.Node.of(whole)
    assert (ranked.costs, ranked.ranks) == (plain.costs, plain.ranks)
    for i in range(4):
        for j, (_, audit) in whole[i].items():
            assert audit == "".join(conversations.product(p)[a][b][1] for p, (a, b) in zip(parts, ranked.ways(i, j), strict=True))


@pytest.mark.parametrize(("block_rows", "fan"), [(7, 3), (4096, 512)])
def test_repair_of_long_and_odd_conversations(spark, tmp_path, block_rows, fan, monkeypatch):
    rng = random.Random(block_rows)
    rows = [(rng.choice([1, 2, 2, 2, 2, 2, None]), rng.choice([None, *range(300)]), rng.choice(["user", "assistant", "system", None, "tool", ""]), rng.choice(["a.", "b", "c!", " ", "", None, "d?", "e. ", "f\n", "é" * 999])) for _ in range(900)]
    rows += [(5, None, "user", "same.")] * 40 + [(6, 1, None, None)]
    spark.createDataFrame([(*r, "x", 3) for r in rows], "conv_id long, turn long, role string, text string, key string, cost int").write.parquet(f"{tmp_path}/turns")
    turns = spark.read.parquet(f"{tmp_path}/turns")
    monkeypatch.setattr(conversations, "repaired", lambda df, make=conversations.repaired: make(df, block_rows=block_rows, fan=fan))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = {r[0]: tuple(r)[1:] for r in conversations.damaged_and_repaired(turns).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert found == plain_damage(rows)


def test_repair_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/none")
    assert conversations.damaged_and_repaired(spark.read.parquet(f"{tmp_path}/none")).count() == 0
