"""Hard negatives and whitening against numpy, on vectors with every awkward case."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from inkmark.llm import negatives, queries, whitening

KIND = "vec_id long, label int, x array<bigint>, score int, cell int, rank string"
SF = "/root/testdata/sf0.001"


def cloud(n, d, seed):
    """Clusters, a crowd of equal vectors, zeros, ties, and unlike lengths of vectors."""
    r = np.random.default_rng(seed)
    x = r.integers(-40, 40, (n, d)) + 60 * r.integers(-1, 2, (5, d))[r.integers(0, 5, n)]
    x[: n // 3] = x[0] + r.integers(0, 2, (n // 3, d)) * (r.random((n // 3, 1)) < 0.2)
    x[n // 2] = 0
    x[-10:] = x[-20:-10] * 2
    return x


def frame(spark, x, labels, more=()):
    rows = [(i, int(labels[i]), [int(v) for v in x[i]], 1, 2, "a") for i in range(len(x))]
    return spark.createDataFrame([*rows, *more], KIND).repartition(3)


def brute(x, labels, step, low=50, high=95):
    """By scores of all pairs: anchor, positive, rank, negative, and the two scores."""
    out, s, ids = set(), x @ x.T, np.arange(len(x))
    for a in range(0, len(x), step):
        order = sorted(ids, key=lambda i: (-s[a, i], i))
        same = [i for i in order if labels[i] == labels[a] and i != a][:5]
        for p in same:
            fit = [i for i in order if labels[i] != labels[a] and low * s[a, p] <= 100 * s[a, i] <= high * s[a, p]]
            out |= {(a, int(p), k + 1, int(i), int(s[a, p]), int(s[a, i])) for k, i in enumerate(fit[:3])}
    return out


@pytest.mark.parametrize(("cells", "leaf", "chunk"), [(512, 96, 16_384), (20, 4, 5)])
def test_negatives_equal_all_pairs(spark, monkeypatch, cells, leaf, chunk):
    """In one block and in many; repeated rows count once, rows that lack something take no part."""
    for name, v in (("LEAST", cells), ("LEAF", leaf), ("CHUNK", chunk)):
        monkeypatch.setattr(negatives, name, v)
    x = cloud(300, 6, 1)
    labels = np.random.default_rng(2).integers(0, 3, 300)
    more = [(None, 1, [1] * 6, 0, 0, ""), (900, None, [9] * 6, 0, 0, ""), (950, 1, None, 0, 0, ""), (1000, 1, [1, None, 1, 1, 1, 1], 0, 0, "")]
    more += [(i, int(labels[i]), [int(v) for v in x[i]], 1, 2, "a") for i in (0, 7, 14)]
    found = [tuple(r) for r in negatives.mine(frame(spark, x, labels, more), F.col("vec_id") % 7 == 0).collect()]
    assert len(found) == len(set(found))
    assert set(found) == brute(x, labels, 7)


def test_negatives_of_odd_tables(spark):
    one = spark.createDataFrame([(0, 1, [3, 4], 1, 2, "a")], KIND)
    assert negatives.mine(one, F.col("vec_id") % 50 == 0).count() == 0
    assert negatives.mine(one.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert negatives.mine(one, F.lit(None).cast("boolean")).count() == 0
    zeros = spark.createDataFrame([(i, i % 2, [0, 0], 1, 2, "a") for i in range(6)], KIND)
    assert {tuple(r) for r in negatives.mine(zeros, F.col("vec_id") == 0).collect()} == {(0, p, k + 1, n, 0, 0) for p in (2, 4) for k, n in enumerate((1, 3, 5))}
    with pytest.raises(Exception, match="differ in length"):
        negatives.mine(spark.createDataFrame([(0, 1, [3, 4], 1, 2, "a"), (1, 1, [3], 1, 2, "a")], KIND), F.col("vec_id") == 0).count()
    big = 1 << 27  # products beyond what doubles hold
    x = np.array([[big, 1], [big, 3], [big - 9, 5], [big - big // 4, 1], [big - big // 4, 2]])
    labels = [1, 1, 1, 2, 2]
    assert {tuple(r) for r in negatives.mine(frame(spark, x, labels), F.col("vec_id") == 0).collect()} == brute(x, labels, 99)


def test_cover_tree(monkeypatch):
    """Nets are separated and nested, angles cover what lies below, bounds hold, and clusters make nodes that are skipped."""
    r = np.random.default_rng(4)
    x = (r.normal(0, 1, (40, 16))[r.integers(0, 40, 2000)] * 200 + r.normal(0, 4, (2000, 16))).astype(np.int64)
    longest = float(np.sqrt((x * x).sum(1).max()))
    points = negatives.augmented(x, longest)
    assert np.allclose(np.linalg.norm(points, axis=1), 1)
    chosen, gaps, whose = negatives.spread(points, 60)
    assert (np.diff(gaps) <= 1e-12).all() and (np.einsum("ij,ij->i", points, points[chosen[whose]]) >= (points @ points[chosen].T).max(1) - 1e-12).all()
    apart = np.sqrt(np.maximum(0, 2 - 2 * points[chosen] @ points[chosen].T)) + 9 * np.eye(len(chosen))
    assert all(apart[:n, :n].min() >= gaps[n - 1] - 1e-9 for n in range(2, len(chosen)))
    tree = negatives.CoverTree.of(points, 60)

    def below(node):
        return [i for c in tree.children[node] for i in below(c)] if tree.children[node] else list(tree.order[tree.begin[node] : tree.end[node]])

    assert sorted(below(0)) == list(range(len(x)))
    least, most = tree.bounds(np.column_stack([x[:9] / np.linalg.norm(x[:9], axis=1)[:, None], np.zeros(9)]), np.linalg.norm(x[:9], axis=1) * longest)
    for node in range(len(tree.centres)):
        s = x[:9] @ x[below(node)].T
        assert (s.min(1) >= least[:, node]).all() and (s.max(1) <= most[:, node]).all()
    xs, seen = x[tree.order], []

    def scores(b, e):
        seen.append(e - b)
        return xs[b:e] @ x[0], tree.order[b:e]

    got = negatives.descend(tree, least[0], most[0], [[-(2**62), 2**62]], 5, scores)[0]
    assert got == sorted(((int(s), i) for i, s in enumerate(x @ x[0])), key=lambda v: (-v[0], v[1]))[:5]
    assert sum(seen) < len(x) / 4


def white(x):
    v = np.cov(x, rowvar=False, bias=True).reshape(x.shape[1], -1)
    e, q = np.linalg.eigh(v)
    return e[::-1], q[:, ::-1], np.trace(v)


def test_jacobi_davidson_needs_many_rounds_where_the_subspace_stays_small():
    r = np.random.default_rng(8)
    x = r.standard_normal((900, 250)) * np.linspace(3, 1, 250)
    v = np.cov(x, rowvar=False, bias=True)
    widths = []
    e, q, rounds = whitening.jacobi_davidson(lambda u: (widths.append(u.shape[1]), v @ u)[1], 250, 12, block=6)
    values, vectors, _ = white(x)
    assert np.abs(e - values[:12]).max() < 1e-11 and np.abs(np.abs((q * vectors[:, :12]).sum(0)) - 1).max() < 1e-10
    assert np.linalg.norm(v @ q - q * e, axis=0).max() < 1e-11 and rounds > 5 and max(widths) < 25
    several = np.diag([5.0, 5, 5, 2, 2, 1, 0, 0])
    e, q, _ = whitening.jacobi_davidson(lambda u: several @ u, 8, 5)
    assert np.allclose(e, [5, 5, 5, 2, 2]) and np.allclose(q.T @ q, np.eye(5))


def test_minres_solves():
    r = np.random.default_rng(3)
    a = r.standard_normal((40, 40))
    a, b = a + a.T, r.standard_normal((40, 3))
    x = whitening.minres(lambda u: a @ u, b, 200, 1e-12)
    assert np.abs(a @ x - b).max() < 1e-6


def test_whitening_equals_numpy(spark):
    """More entries than components; rows without a vector, null ids, repeated rows, columns of the same names."""
    r = np.random.default_rng(5)
    x = np.floor(r.standard_normal((200, 40)) * np.linspace(30, 8, 40)).astype(int) + 1_000_000
    x = np.vstack([x, x[:3]])
    kind = "vec_id long, x array<int>, id int, component string, n int, i int"
    rows = [(int(i % 200), [int(v) for v in row], 1, "", 2, 3) for i, row in enumerate(x)]
    lost = [(500, None, 1, "", 2, 3), (501, [], 1, "", 2, 3), (502, [1, None], 1, "", 2, 3)]
    rows[5] = (None, *rows[5][1:])
    found = whitening.whiten(spark.createDataFrame(rows + lost, kind).repartition(5)).toPandas()
    assert len(found) == 203 * 32 and (found.n == 203).all() and found["id"].isna().sum() == 32 and set(found.component) == set(range(1, 33))
    e, q, trace = white(x)
    w = (x - x.mean(0)) @ q[:, :32] / np.sqrt(e[:32])
    got = found[found["id"] == 7].sort_values("component").whitened.to_numpy()
    assert np.abs(np.abs(got) - np.abs(w[7])).max() < 1e-9
    every = found.dropna(subset="id").groupby(["id", "component"]).whitened.first().unstack().to_numpy()
    sign = np.sign((every * np.delete(w[:200], 5, 0)).sum(0))
    assert np.abs(every * sign - np.delete(w[:200], 5, 0)).max() < 1e-9
    assert np.abs(found.groupby("component").explained.first().to_numpy() - e[:32] / trace).max() < 1e-13 and found.identity_error.max() < 1e-12
    assert {int(i): int(v) for i, v in found.groupby("id").deviation.first().items()} == {i: int(((203 * x[i] - x.sum(0)) ** 2).sum()) for i in range(200) if i != 5}


def test_whitening_of_odd_tables(spark):
    kind = "vec_id long, x array<bigint>"
    table = lambda *rows: spark.createDataFrame([(i, [*map(int, v)]) for i, v in enumerate(rows)], kind)
    assert whitening.whiten(table([1, 2])).count() == 0 and whitening.whiten(table([1, 2], [1, 2])).count() == 0
    assert whitening.whiten(table([1, 2]).limit(0)).count() == 0
    line = whitening.whiten(table([0, 0], [1, 1], [2, 2])).orderBy("id").collect()
    assert [r.component for r in line] == [1, 1, 1] and all(math.isclose(abs(r.whitened), abs(w), abs_tol=1e-12) for r, w in zip(line, (math.sqrt(1.5), 0, math.sqrt(1.5)), strict=True))
    with pytest.raises(Exception, match="differ in length"):
        whitening.whiten(table([1, 2], [1, 2, 3])).count()
    far = whitening.whiten(table([0], [2**33], [1])).toPandas()
    assert far.deviation.isna().sum() == 3 and (far.n == 3).all()  # beyond 64 bits


def test_whole_entries(spark):
    kind = "v array<float>"
    rows = spark.createDataFrame([([0.5, -0.001],), ([1.0, None],), (None,), ([float("nan")],), ([float("inf")],), ([],)], kind)
    assert [r.x for r in rows.select(whitening.whole("v", 64, 10).alias("x")).collect()] == [[42, 9], None, None, None, None, []]


def test_registered_queries(spark):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{SF}/embeddings.parquet')")
    found = queries.op11_negatives(spark, SF)
    expected = con.execute(queries.ORACLE_SQL["op11_negatives"])
    names = [d[0] for d in expected.description]
    assert sorted(map(tuple, found.select(*names).collect())) == sorted(expected.fetchall())
    assert dict(found.dtypes) == {"anchor_id": "bigint", "positive_id": "bigint", "rank": "int", "negative_id": "bigint", "positive_score": "bigint", "negative_score": "bigint"}
    white_ = queries.op12_whitening(spark, SF)
    assert white_.dtypes == [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double")]
    n = con.execute("select count(*) from embeddings").fetchone()[0]
    got = white_.toPandas()
    assert len(got) == 32 * n and (got.n == n).all() and got.identity_error.max() < 1e-10
    x = np.floor(64 * np.stack(con.execute("select embedding from embeddings order by vec_id").fetchnumpy()["embedding"]).astype(float)) + 1e6
    e, q, trace = white(x)
    own = np.abs((x - x.mean(0)) @ q[:, :32] / np.sqrt(e[:32]))
    assert np.abs(got.sort_values(["vec_id", "component"]).whitened.abs().to_numpy().reshape(n, 32) - own).max() < 1e-8
