"""Vector operators against brute force, with every kind of unusable row."""

import numpy as np
import pytest

from cinderframe.llm import crosspoly, pstable
from cinderframe.llm.components import components
from tests.llm import brute

SCHEMA = "vec_id long, embedding array<float>, label int, rep string, g long"


def make_vectors():
    rng = np.random.default_rng(1)
    rows, centres = [], rng.standard_normal((8, 16))
    for k in range(300):
        v = centres[k % 8] + rng.standard_normal(16) * (0.05 if k % 3 else 1.5)
        rows.append((k, v.astype(np.float32).tolist(), k % 2))
    rows += [(300 + k, rows[7][1], 1) for k in range(40)]  # exact copies
    odd = [None, [], [0.0] * 16, [1.0, None] + [0.0] * 14, [float("nan")] + [1.0] * 15, [float("inf")] * 16, [1.0, 2.0, 3.0], [2.0, 4.0, 6.0]]
    rows += [(350 + 50 * k, v, 1) for k, v in enumerate(odd)]
    rows += [(1000, rows[7][1], None)]
    return rows


ROWS = make_vectors()


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.createDataFrame([(*r, "x", 1) for r in ROWS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_near_vectors(vectors, empty):
    for block in (512, 16):
        got = {r.vec_id: r for r in pstable.near_vectors(vectors, block=block).collect()}
        links, roots = brute.close_pairs(ROWS, 0.93)
        assert {i: (r.n_links, r.component_id) for i, r in got.items()} == {i: (links[i], roots[i]) for i in links}
        assert all(r.kept == (r.component_id == i) for i, r in got.items()) and len(got) == len(ROWS)
    assert pstable.near_vectors(empty).count() == 0


def test_nearest(vectors, empty):
    good = {i: np.array(v, float) for i, v, _ in ROWS if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    want = {}
    for q, u in good.items():
        if q % 50 == 0:
            near = sorted((-(u @ v) / np.linalg.norm(u) / np.linalg.norm(v), i) for i, v in good.items() if i != q and len(v) == len(u))
            want[q] = [i for _, i in near[:5]], [-s for s, _ in near[:5]]
    got = {}
    for r in sorted(crosspoly.nearest(vectors, "vec_id % 50 = 0", effort=99, tables=1, block=16).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append(r)
    assert got.keys() == want.keys()
    for q, rows in got.items():  # every cell is visited: exact
        assert [r.rank for r in rows] == list(range(1, len(rows) + 1))
        assert np.allclose([r.score for r in rows], want[q][1], atol=1e-12)
    assert [r.vec_id for r in got[300]] == [7, 301, 302, 303, 304]  # ties to smaller ids
    assert crosspoly.nearest(empty, "vec_id % 50 = 0").count() == 0


def test_nearest_of_repeated_rows(spark):
    """Copies of a row and other vectors of an id push no other id out."""
    rng = np.random.default_rng(6)
    near = [(k, (np.eye(16)[0] + 0.01 * rng.standard_normal(16)).astype(np.float32).tolist(), 1) for k in range(12)]
    rows = [r for r in near for _ in range(6)] + [(k, [x * 0.9 + 0.01 for x in v], 1) for k, v, _ in near[:4]]
    unit = {k: [np.array(v, float) / np.linalg.norm(np.array(v, float)) for i, v, _ in rows if i == k] for k in range(12)}
    want = {q: [i for _, i in sorted((-max(np.float64(a @ b) for a in unit[q] for b in unit[i]), i) for i in unit if i != q)[:5]] for q in unit}
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)
    for block in (1024, 2):
        got = {}
        for r in sorted(crosspoly.nearest(df, "vec_id >= 0", effort=99, tables=1, block=block).collect(), key=lambda r: (r.query_id, r.rank)):
            got.setdefault(r.query_id, []).append(r.vec_id)
        assert got == want


@pytest.mark.parametrize("n", [3, 4, 6])
def test_nearest_of_few_rows(spark, n):
    """As many neighbours as there are, with default parameters: opposite and unrelated vectors too."""
    rng = np.random.default_rng(n)
    v = rng.standard_normal((n, 64))
    v[1] = -v[0]
    m = v / np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, embedding array<double>").repartition(2)
    got = {}
    for r in sorted(crosspoly.nearest(df, "vec_id != 2").collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    want = {q: sorted((k for k in range(n) if k != q), key=lambda k: -(m[q] @ m[k]))[:5] for q in range(n) if q != 2}
    assert got == {q: list(enumerate(ids, 1)) for q, ids in want.items()}


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall(spark, sf):
    df = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    rows = df.select("vec_id", "embedding").collect()
    ids, m = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    ask = np.flatnonzero(ids % 50 == 0)
    cos = m[ask] @ m.T
    cos[np.arange(len(ask)), ask] = -9
    want = {int(ids[a]): set(ids[np.argsort(-c)[:5]].tolist()) for a, c in zip(ask, cos)}
    got = crosspoly.nearest(df, "vec_id % 50 = 0").collect()
    hits = sum(r.vec_id in want[r.query_id] for r in got)
    assert hits / (5 * len(ask)) >= 0.9


def test_nearest_visits_few_cells():
    """Of 10,000 rows a query scores a fifth at most; of 10^9 under a hundredth."""
    for n, most in ((2000, 0.34), (10_000, 0.21), (10**9, 0.01)):
        assert 12 * crosspoly.probes_of(n, 128 * 128, 12, 3.2) / 128**2 <= most


def test_nearest_scores_less_than_all(spark):
    """On vectors without structure, where hashing prunes least, with default parameters."""
    m = np.array([r.embedding for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()], float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    ask, met = m[::50], 0
    probes = crosspoly.probes_of(len(m), 128 * 128, 12, 3.2)
    for t in range(12):
        a, b = crosspoly.along(m, 2 * t, 11, 64), crosspoly.along(m, 2 * t + 1, 11, 64)
        held = np.bincount(a.argmax(1) * 128 + b.argmax(1), minlength=128 * 128)
        both = (a[::50, :, None] + b[::50, None]).reshape(len(ask), -1)
        met += held[np.argpartition(-both, probes - 1, 1)[:, :probes]].sum()
    assert met < 0.45 * len(m) * len(ask)


def test_nearest_of_one_frequent_vector(spark):
    """A third of the rows are copies of one vector: they count once in each table, all ids come back in order."""
    rng = np.random.default_rng(3)
    v = rng.standard_normal((400, 64)).astype(np.float32)
    v[:150] = v[0]
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, embedding array<float>").repartition(3)
    got = {}
    for r in sorted(crosspoly.nearest(df, "vec_id % 10 = 0").collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert all(got[q] == [k for k in range(6) if k != q][:5] for q in range(0, 150, 10)) and all(len(x) == 5 for x in got.values())
    assert len(got) == 40


def test_recall_of_links(spark):
    """Planted pairs and clusters at cosines from just under to well over the threshold, in 64 dimensions, with default parameters."""
    rng = np.random.default_rng(4)
    rows = []
    for k in range(300):
        u = rng.standard_normal(64)
        u /= np.linalg.norm(u)
        rows.append(u)
        for c in rng.uniform(0.92, 0.955, 2):
            w = rng.standard_normal(64)
            w -= (w @ u) * u
            rows.append(c * u + np.sqrt(1 - c * c) * w / np.linalg.norm(w))
    m = np.array(rows)
    df = spark.createDataFrame([(k, x.tolist(), 1) for k, x in enumerate(m)], "vec_id long, embedding array<double>, label int").repartition(3)
    linked = np.triu(m @ m.T >= 0.93, 1)
    want = int(linked.sum()) * 2
    got = sum(r.n_links for r in pstable.near_vectors(df).collect())
    assert want > 500 and 0.99 * want <= got <= want
    assert (1 - pstable.meeting(0.93, 2.1) ** 16) ** pstable.tables_for(0.93, 16, 2.1, 1e-3) <= 1e-3


def test_components(spark):
    rng = np.random.default_rng(5)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 400, (250, 2))] + [(k, k + 1) for k in range(500, 620)] + [(700, k) for k in range(701, 900)] + [(3, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = brute.joined(sorted({x for p in links for x in p}), links)
    assert got == {i: r for i, r in want.items() if any(i in p and p[0] != p[1] for p in links)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
