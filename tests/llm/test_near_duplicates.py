"""Near-duplicate operators, substring removal and connected components against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from hopwise.llm import embedding, minhash, shared, substrings

WORDS = r"[^\x20\x09-\x0D]+"


def classes(nodes, links):
    up = {i: i for i in nodes}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        p, q = top(a), top(b)
        if p != q:
            up[max(p, q)] = min(p, q)
    return {i: top(i) for i in nodes}


def ascii_lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def shingles(text, width):
    w = re.findall(WORDS, ascii_lower(text or ""))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def similar(sets, percent=80):
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                yield a, b


def check_minhash(spark, rows, width=4):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:] for r in minhash.near_duplicates(df, width=width).collect()}
    sets = {i: shingles(t, width) for i, t in rows}
    want = classes(sets, similar(sets))
    assert got == {i: (len(sets[i]), want[i], want[i] == i) for i in sets}
    return want


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)]
    star = [(500, 500 + i) for i in range(1, 300)]
    edges = spark.createDataFrame(chain + star, "a long, b long")
    got = {r["node"]: r["component_id"] for r in shared.connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, **{500 + i: 500 for i in range(300)}}
    assert shared.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_minhash_groups(spark, monkeypatch):
    r = random.Random(5)
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 64)
    base = [[f"v{r.randrange(9999)}" for _ in range(110)] for _ in range(3)]
    rows = []
    for i in range(240):
        w = list(r.choice(base))
        for _ in range(r.randrange(0, 13)):
            w[r.randrange(len(w))] = f"x{r.randrange(9999)}"
        rows.append((1000 - i, " ".join(w)))
    assert len(set(check_minhash(spark, rows).values())) > 3


def test_minhash_edges(spark):
    long = " ".join(f"w{i}" for i in range(30000))
    rows = [(1, None), (2, ""), (3, " \t "), (4, "one"), (5, "ONE"), (6, "a b c"), (7, "A  b\nC"), (8, "a b c d"), (9, long), (10, long + " end"), (11, "a b c d"), (12, "ÄB c d e"), (13, "äb c d e")]
    check_minhash(spark, rows)
    extra = spark.createDataFrame([(1, "x y z", "q", "r"), (None, "x y z", "q", "r"), (1, "x y z", "q", "r")], "doc_id long, text string, component_id string, kept string")
    got = minhash.near_duplicates(extra).collect()
    assert len(got) == 3 and {(r["doc_id"], r["component_id"]) for r in got} == {(1, 1), (None, None)} and all(r["kept"] for r in got)
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    kept = minhash.drop_near_duplicates(spark.createDataFrame([(1, "a b c d e f", 5), (2, "a b c d e f", 6)], "doc_id long, text string, kept int"))
    assert [tuple(r) for r in kept.collect()] == [(1, "a b c d e f", 5)]


def test_minhash_large_inputs_paths(spark, monkeypatch):
    """Bit set and shuffle joins instead of broadcasts, and buckets of unlike rows in many tiles."""
    r = random.Random(9)
    monkeypatch.setattr(minhash, "BROADCAST_IDS", 0)
    monkeypatch.setattr(minhash, "PAIRED", 4)
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 16)
    base = [[f"v{r.randrange(9999)}" for _ in range(60)] for _ in range(4)]
    rows = []
    for i in range(150):
        w = list(r.choice(base))
        for _ in range(r.randrange(0, 9)):
            w[r.randrange(len(w))] = f"x{r.randrange(9999)}"
        rows.append((i * 3, " ".join(w)))
    assert len(set(check_minhash(spark, rows).values())) > 3
    kept = minhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=4)
    sets = {i: shingles(t, 4) for i, t in rows}
    top = classes(sets, similar(sets))
    assert sorted(x["doc_id"] for x in kept.collect()) == sorted(i for i in top if top[i] == i)


def test_minhash_repeated_and_null_ids(spark):
    """Each distinct text of an id is compared; the stage keeps one row of each group, whatever its id."""
    words = lambda a, n=40: " ".join(f"{a}{i}" for i in range(n))
    rows = [(1, words("a")), (7, words("b")), (7, words("c")), (7, words("c")), (5, words("c") + " end"), (9, words("b") + " end"), (None, words("a")), (None, words("d")), (None, words("d")), (None, None), (None, ""), (8, ""), (8, "")]
    df = spark.createDataFrame([(*x, "k") for x in rows], "doc_id long, text string, kept string")
    got = sorted({(r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(df).where("doc_id is not null").collect()})
    assert got == [(1, 1, True), (5, 5, True), (7, 5, False), (8, 8, True), (9, 5, False)] and minhash.near_duplicates(df).count() == len(rows)
    left = minhash.drop_near_duplicates(df)
    assert left.columns == df.columns
    left = [(r["doc_id"], r["text"]) for r in left.collect()]
    assert sorted(left, key=str) == sorted([(1, words("a")), (5, words("c") + " end"), (9, words("b") + " end"), (None, words("d")), (None, None), (None, ""), (8, ""), (8, "")], key=str)


def test_minhash_recall_near_the_threshold(spark):
    """Pairs of similarity 0.8 to 0.83: all are linked."""
    r = random.Random(3)
    rows = []
    for i in range(250):
        w = [f"p{i}_{j}" for j in range(163)]
        other = w[: -r.randrange(13, 21)]
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(other + [f"q{j}" for j in range(len(w) - len(other))]))]
    sets = {i: shingles(t, 4) for i, t in rows}
    score = {i: len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1]) for i in range(0, 500, 2)}
    near = {i for i, x in score.items() if 0.8 <= x < 0.86}
    got = {x["doc_id"]: x["component_id"] for x in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(near) > 20 and {i for i in near if got[i + 1] == i} == near


def test_posterior_bound():
    assert minhash.least_matches(130, 0.8, 1e-6) < 104 and minhash.least_matches(130, 0.8, 0.5) > minhash.least_matches(130, 0.8, 1e-6)
    assert minhash.least_matches(26, 0.8, 0.0) == 0


def test_embedding(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(30, 16))
    vectors = [(base[i % 30] + rng.normal(size=16) * 0.12 * rng.random() * np.linalg.norm(base[i % 30])).astype(np.float32) for i in range(300)]
    vectors += [vectors[3]] * 4 + [vectors[5] * 2, np.zeros(16, np.float32)]
    rows = [(i * 7 % 1009, [float(x) for x in v]) for i, v in enumerate(vectors)]
    rows += [(2000, None), (2001, [1.0, None] + [0.0] * 14), (2002, [float("nan")] * 16), (2003, [1.0, 2.0]), (2004, [2.0, 4.0]), (2005, []), (2006, [float("inf")] + [1.0] * 15)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {r["vec_id"]: tuple(r)[1:] for r in embedding.near_vectors(df).collect()}
    unit = {i: np.array(v, float) / np.linalg.norm(np.array(v, float)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    ids = list(unit)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[:i] if len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.95]
    want = classes([i for i, _ in rows], links)
    n = {i: sum(i in x for x in links) for i, _ in rows}
    assert links and got == {i: (n[i], want[i], want[i] == i) for i, _ in rows}
    assert embedding.near_vectors(df.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, [1.0, 0.0], 1), (4, [1.0, 0.0], 2), (4, [1.0, 0.0], 3)], "vec_id long, embedding array<double>, kept int")
    assert sorted((r["vec_id"] or 0, r["n_links"]) for r in embedding.near_vectors(odd).collect()) == [(0, 0), (4, 1), (4, 1)]


def test_embedding_range_and_dimension(spark):
    """Very small and very large doubles, and dimensions beyond what float32 products hold."""
    rows = [(1, [1e-200, 2e-200]), (2, [1e200, 2e200]), (3, [2.0, 4.1]), (4, [-1e-320, 0.0]), (5, [-5e-324, 0.0]), (6, [1.7e308, 1.7e308]), (7, [1e-300, 1e-300])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    unit = {i: np.array(v) / np.abs(v).max() for i, v in rows}
    unit = {i: v / np.linalg.norm(v) for i, v in unit.items()}
    links = [(a, b) for a in unit for b in unit if b < a and unit[a] @ unit[b] >= 0.95]
    top = classes(unit, links)
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding.near_vectors(df).collect()} == {i: (sum(i in x for x in links), top[i]) for i in unit}
    rng = np.random.default_rng(7)
    base = rng.normal(size=(6, 1500))
    wide = [(i, [float(x) for x in base[i % 6] + rng.normal(size=1500) * (0.33 if i % 2 else 0.2)]) for i in range(60)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding.near_vectors(spark.createDataFrame(wide, "vec_id long, embedding array<double>")).collect()}
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in wide}
    links = [(a, b) for a in unit for b in range(a) if unit[a] @ unit[b] >= 0.95]
    top = classes(unit, links)
    assert links and got == {i: (sum(i in x for x in links), top[i]) for i in unit}


def test_embedding_empty_blocks(spark):
    """A few rows of each dimension, so most tiles have rows of one block only, or none."""
    rng = np.random.default_rng(11)
    rows = [(i, [float(v) for v in np.array(([1.0, 2.0, 3.0], [3.0, -1.0, 0.5, 2.0], [0.3, 1.0])[i % 3]) + rng.normal(size=(3, 4, 2)[i % 3]) * 0.25]) for i in range(24)]
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in rows}
    links = [(a, b) for a in unit for b in range(a) if len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.95]
    top = classes(unit, links)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert links and got == {i: (sum(i in x for x in links), top[i]) for i in unit}


def test_embedding_cells(spark, monkeypatch):
    """Clustered vectors over many cells, one of them hot: the same links as by brute force, and fewer tiles than pairs of blocks."""
    monkeypatch.setattr(embedding, "BLOCK_BYTES", 1)
    monkeypatch.setattr(embedding, "LEAST_BLOCKS", 24)
    rng = np.random.default_rng(5)
    base = rng.normal(size=(20, 12))
    rows = [(i, [float(x) for x in base[0 if i % 3 == 0 else i % 20] + rng.normal(size=12) * 0.26]) for i in range(900)]
    unit = np.array([v for _, v in rows])
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    top = classes(range(900), [(int(a), int(b)) for a, b in zip(*np.nonzero(near), strict=True)])
    sent = []
    stored = embedding.stored

    def watched(frame):
        out = stored(frame)
        if "others" in out.columns:
            sent.append(out.selectExpr("avg(size(others))").first()[0])
        return out

    monkeypatch.setattr(embedding, "stored", watched)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert near.any() and got == {i: (int(near[i].sum()), top[i]) for i in range(900)}
    assert sent and sent[0] < 20


def test_embedding_bounds():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 48))
    x /= np.linalg.norm(x, axis=1)[:, None]
    q, scale, error = embedding.coded(x)
    about = (q * scale[:, None]) @ (q * scale[:, None]).T
    assert (np.abs(about - x @ x.T) <= error[:, None] + (1 + error[:, None]) * error[None, :]).all()


def brute_substrings(rows):
    words = {i: re.findall(WORDS, t or "") for i, t in rows}
    first = {}
    for i, w in words.items():
        for j in range(len(w) - 49):
            g = tuple(w[j : j + 50])
            first[g] = min(i, first.get(g, i))
    out = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for j in range(len(w) - 49):
            if first[tuple(w[j : j + 50])] < i:
                gone[j : j + 50] = [True] * 50
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out[i] = (len(w), len(w) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


def test_paths(spark):
    """Chains of all lengths, an edge of its own, and branches."""
    rows, want, at = [], {}, 1
    for n in [1, 2, 3, 4, 7, 8, 9, 40]:
        chain = list(range(at, at + n))
        rows += [(e, 0 if i == 0 else chain[i - 1], None if i == n - 1 else chain[i + 1]) for i, e in enumerate(chain)]
        want[at] = n
        at += n
    rows += [(900, None, 901), (901, None, 902), (902, 901, 0), (903, 900, 0)]
    want |= {900: 1, 901: 2, 903: 1}
    random.Random(1).shuffle(rows)
    got = substrings.paths(spark.createDataFrame(rows, "edge long, before long, after long"))
    assert {r["head"]: r["n"] for r in got.collect()} == want
    assert substrings.paths(spark.createDataFrame([], "edge long, before long, after long")).count() == 0


@pytest.mark.parametrize("seed, bound", [(3, 500_000), (8, 0)])
def test_substrings(spark, seed, bound, monkeypatch):
    monkeypatch.setattr(substrings, "BROADCAST_IDS", bound)
    monkeypatch.setattr(substrings, "BROADCAST_HEADS", bound)
    r = random.Random(seed)
    passages = [[f"w{r.randrange(60)}" for _ in range(r.randrange(45, 300))] for _ in range(10)]
    rows = []
    for i in r.sample(range(10**6), 150):
        w = []
        for _ in range(r.randrange(0, 5)):
            p, k = r.choice(passages), r.random()
            a = r.randrange(len(p))
            w += p[a : r.randrange(a, len(p))] if k < 0.5 else p if k < 0.7 else [f"w{r.randrange(3)}" for _ in range(r.randrange(120))] if k < 0.85 else ["same"] * r.randrange(150)
        rows.append((i, " ".join(w) if r.random() < 0.95 else None))
    rows += [(-1, " ".join(f"l{i}" for i in range(30000))), (-2, ""), (10**7, " ".join(f"l{i}" for i in range(29000)))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("begin", F.lit(1))
    assert {r["doc_id"]: tuple(r)[1:] for r in substrings.without_repeats(df).collect()} == brute_substrings(rows)


def test_substrings_repeated_ids(spark):
    """Equal and different rows of one id lose what a smaller document holds, and nothing to each other."""
    r = random.Random(6)
    made = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    passage, other, own = made(200), made(120), made(90)
    rows = [
        (3, made(30) + passage + made(40)), (4, other), (9, passage + made(20)), (11, own + made(10)),
        *[(5, made(60) + passage + made(25))] * 2, (7, other + made(70) + own), (7, passage), (7, own + made(300) + passage), (7, own), (7, None), (None, passage),
    ]
    first = {}
    for i, w in rows:
        for j in range(len(w or []) - 49):
            g = tuple(w[j : j + 50])
            first[g] = min(i if i is not None else 10**9, first.get(g, 10**9))
    want = []
    for i, w in rows:
        gone = set()
        for j in range(len(w or []) - 49):
            if i is not None and first[tuple(w[j : j + 50])] < i:
                gone |= set(range(j, j + 50))
        kept = [x for k, x in enumerate(w or []) if k not in gone]
        want.append((i or 0, len(w or []), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    df = spark.createDataFrame([(i, w and " ".join(w)) for i, w in rows], "doc_id long, text string")
    assert sorted((x["doc_id"] or 0, *tuple(x)[1:]) for x in substrings.without_repeats(df).collect()) == sorted(want)
    assert sum(x[2] for x in want) > 1000


def test_substrings_edges(spark):
    text = " ".join(f"w{i}" for i in range(60))
    odd = spark.createDataFrame([(None, text), (5, text), (5, text)], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["n_words"], r["n_removed"]) for r in substrings.without_repeats(odd).collect()) == [(0, 60, 0), (5, 60, 0), (5, 60, 0)]
    assert substrings.without_repeats(odd.limit(0)).count() == 0
