"""Small cases of what only shows on larger tables."""

import numpy as np
import pandas as pd

import pytest
from pyspark.sql import functions as F

from quillon.model import from_arrays
from quillon.operators import intervals, residuals


def test_equal_intervals_stay_in_one_chain(spark):
    """SQL that sums by ROWS may count one of two equal intervals in the chain before; chains do not."""
    rows = [("1", s, e) for s, e in ((0, 4), (5, 9), (5, 9), (5, 9), (9, 12), (20, 21), (20, 21))] * 3
    df = spark.createDataFrame(rows, "chrom string, start long, end long").repartition(4)
    got = sorted(map(tuple, intervals.merge_overlapping(df, 2, tile=8).collect()))
    assert got == [("1", 0, 4, 3), ("1", 5, 12, 12), ("1", 20, 21, 6)]


def test_residuals_are_computed_once(spark):
    """The table that is clipped and scaled is read several times, but fitted once."""
    seen = spark.sparkContext.accumulator(0)

    def slow(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    rows = spark.range(600).select((F.col("id") % 20).cast("string").alias("obs_id"), F.floor(F.col("id") / 20).cast("string").alias("var_id"), F.sin("id").alias("value"))
    got = residuals.finish(rows.mapInPandas(slow, rows.schema), 0.9).toPandas()
    assert seen.value == 600
    x = np.clip(np.sin(np.arange(600)), -0.9, 0.9).reshape(30, 20)
    unit = x / np.sqrt((x**2).sum(0))
    want = unit * x.std() / unit.std()
    assert np.allclose(got["value"], [want[int(v), int(o)] for o, v in zip(got["obs_id"], got["var_id"], strict=True)])


def test_fits_of_rows_alike(spark):
    rng = np.random.default_rng(2)
    e = rng.choice([0.5, 1.0, 2.0], 3000)
    y = rng.negative_binomial(2, 2 / (2 + 3 * e)).astype(float)
    one = np.ones((len(y), 1))
    u, v, d, w, back = residuals._distinct(y, e, one)
    assert len(u) < 200 and (u[back] == y).all() and (v[back] == e).all() and w.sum() == len(y)
    assert np.allclose(residuals.fit_mean(u, v, d, 0.5, weight=w)[back], residuals.fit_mean(y, e, one, 0.5), rtol=1e-9)
    assert len(residuals._distinct(y, e, np.column_stack([one, e]))[0]) == len(y)


def test_feature_arrays(spark):
    """Every cell in its place, whatever the number of rows, and no lookup of every cell in every entry."""
    x = np.random.default_rng(3).poisson(0.4, (700, 9))
    x[:, 4] = 0
    m = from_arrays(spark, x)
    made = m.feature_major()
    assert "element_at" not in made._jdf.queryExecution().toString()
    assert all((np.array(r["x"]) == x[:, r["ord"]]).all() for r in made.collect())
    with pytest.raises(Exception, match="more than once"):
        m.feature_major(m.counts.union(m.counts)).collect()


def _old_pooled(x, pools=(21, 41, 61, 81, 101)):
    """Pools one by one and a system of dense rows."""
    total = np.maximum(x.sum(1), 1e-9)
    unit = x / total[:, None]
    mean, n = unit.mean(0), len(x)
    on, order = mean > 0, np.argsort(total, kind="stable")
    ring = np.concatenate([order[::2], order[1::2][::-1]])
    a, rhs = [], []
    for size in [p for p in pools if p <= n] or [n]:
        for s in range(n):
            who = ring[(s + np.arange(size)) % n]
            a.append(np.bincount(who, minlength=n).astype(float))
            rhs.append(np.median(unit[who].sum(0)[on] / mean[on]))
    theta = np.linalg.lstsq(np.vstack([*a, np.eye(n) * 1e-3]), np.append(rhs, np.full(n, 1e-3)), rcond=None)[0]
    return np.maximum(theta, 1e-9) * total


@pytest.mark.parametrize(("n", "stretch"), [(12, 8), (60, 16), (130, 16), (130, 256), (300, 64)])
def test_pooled_factors_equal_the_dense_system(spark, monkeypatch, n, stretch):
    from quillon.operators import pooling

    monkeypatch.setattr(pooling, "STRETCH", stretch)
    monkeypatch.setattr(pooling, "top_detected", lambda counts, var: var.select("var_id"))
    rng = np.random.default_rng(n)
    x = rng.poisson(np.outer(rng.uniform(0.5, 2, n), rng.uniform(0.02, 4, 30)))
    m = from_arrays(spark, x)
    got = {r["obs_id"]: r["raw"] for r in pooling.pooled_factors(m.counts, m.obs, m.var).collect()}
    assert np.allclose([got[str(i)] for i in range(n)], _old_pooled(x.astype(float)), rtol=1e-7)


def test_pooled_factors_of_many_observations(spark):
    """Over 5,000 observations were an error."""
    from quillon.operators import matrix

    rng = np.random.default_rng(5)
    depth = rng.uniform(0.5, 2, 5200)
    m = from_arrays(spark, rng.poisson(np.outer(depth, rng.uniform(5, 50, 20))))
    got = {r["obs_id"]: r["size_factor"] for r in matrix.size_factors(m.counts, m.obs, m.var, "pooled").collect()}
    assert len(got) == 5200 and np.corrcoef([got[str(i)] for i in range(5200)], depth)[0, 1] > 0.9


def _rows(spark, x, name="ord"):
    key = [(f"v{j}" if name == "var_id" else j) for j in range(x.shape[1])]
    return spark.createDataFrame([(k, x[:, j].tolist()) for j, k in enumerate(key)], f"{name} {'string' if name == 'var_id' else 'long'}, x array<double>").repartition(3)


def test_few_features_of_many_observations(spark, monkeypatch):
    """Components and canonical scores come from the features' products; the driver never has observations squared."""
    from quillon.operators import embedding

    monkeypatch.setattr(embedding, "MOST_OBSERVATIONS", 50)
    monkeypatch.setattr(embedding, "BLOCK", 500)
    rng = np.random.default_rng(8)
    n = 400
    x = rng.normal(0, 0.2, (n, 6)) + np.outer(np.linspace(-2, 2, n), [1, 1, 1, -1, -1, 1])
    ids = [str(i) for i in range(n)]
    scores, table = embedding.pca_parallel(_rows(spark, x), ids)
    got = {r["obs_id"]: r["vec"] for r in scores.collect()}
    mid = x - x.mean(0)
    u, s, _ = np.linalg.svd(mid, full_matrices=False)
    k = len(got["0"])
    u = u[:, :k] * np.sign(u[np.abs(u[:, :k]).argmax(0), np.arange(k)])
    assert np.allclose([got[i] for i in ids], u * s[:k], atol=1e-8) and np.allclose(table["variance"][:6], s**2 / n) and (table["variance"][6:] == 0).all()
    y = x + rng.normal(0, 0.1, x.shape)
    a, b = embedding.cca(_rows(spark, x, "var_id"), _rows(spark, y, "var_id"), ids, ids, 3)
    u, _, vt = np.linalg.svd(x @ y.T)
    flip = np.sign(u[np.abs(u[:, :3]).argmax(0), np.arange(3)])
    for side, want in ((a, u[:, :3] * flip), (b, vt.T[:, :3] * flip)):
        got = {r["obs_id"]: r["vec"] for r in side.collect()}
        assert np.allclose([got[i] for i in ids], want, atol=1e-7)
    with pytest.raises(ValueError, match="square"):
        embedding.pca_parallel(_rows(spark, rng.normal(size=(60, 60))), ids[:60])


def test_places_without_signal_and_input_are_one(spark, sf_dir):
    """The background of every observation from its places that hold something, as from every place."""
    from quillon.operators import inputs
    from quillon.plans.bindings import Tables

    t = Tables(spark, sf_dir)
    dense, few = t.cells(True), t.places()
    held = dense.where("value <> 0 or input <> 0").count()
    assert held < few.count() <= min(dense.count(), held + t.obs.count())
    assert sorted(inputs.reference_lfc(few).collect()) == sorted(inputs.reference_lfc(dense).collect())
    assert few.groupBy("obs_id").agg(F.sum(F.expr("int(value = 0 and input = 0)")).alias("n")).where("n > 1").count() == 0


@pytest.mark.parametrize("metric", ["euclidean", "cosine", "correlation"])
def test_neighbours_of_blocks_of_queries(spark, monkeypatch, metric):
    """All pairs, in blocks of queries that never gather on the driver; ties, copies and far-off means too."""
    from quillon.operators import graph

    for name, value in (("QUERY_BLOCK", 70), ("QUERY_STEP", 16), ("ROW_STEP", 50)):
        monkeypatch.setattr(graph, name, value)
    monkeypatch.setattr(type(spark.range(1)), "toPandas", lambda self: pytest.fail("rows were gathered"))
    rng = np.random.default_rng(4)
    x = np.vstack([rng.integers(0, 3, (150, 4)), rng.normal(0, 1e-4, (100, 4)) + 1000.0, np.repeat(rng.normal(size=(1, 4)), 40, 0)]).astype(float)
    x[:150] += [0, 0, 0, 0.5]
    rows = spark.createDataFrame([(i * 3, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>").repartition(5)
    k, z = 7, graph._prepare(x, metric)
    ask = rows.where("id % 2 = 0")
    for queries, same in ((None, True), (ask, False)):
        got = {}
        for r in graph.knn(rows, k, metric, queries).orderBy("src", "rank").collect():
            got.setdefault(r["src"], []).append((r["distance"], r["dst"]))
        assert len(got) == (len(x) if same else ask.count())
        for s, found in got.items():
            i = s // 3
            d = np.sqrt(((z[i] - z) ** 2).sum(1)) if metric == "euclidean" else 1 - (z[i] * z).sum(1)
            want = sorted((float(v), 3 * j) for j, v in enumerate(d) if not (same and j == i))[:k]
            assert np.allclose([v for v, _ in found], [v for v, _ in want], rtol=1e-12, atol=1e-15)
            if metric == "euclidean":
                assert found == want


def test_partitions_and_layouts_are_made_by_tasks(spark, monkeypatch):
    """The driver gathers neither the edges of a graph nor the rows of a layout."""
    from quillon.operators import embedding, graph

    edges = [(10 * c + i, 10 * c + j, 1.0) for c in range(6) for i in range(10) for j in range(10) if i != j] + [(10 * c, (10 * c + 10) % 60, 1.0) for c in range(6)]
    df = spark.createDataFrame(edges, "src long, dst long, weight double").repartition(3)
    rows = spark.createDataFrame([(i, [float(i % 7), float(i // 7)]) for i in range(60)], "id long, vec array<double>")
    monkeypatch.setattr(type(df), "toPandas", lambda self: pytest.fail("rows were gathered"))
    got = {r["id"]: r["label"] for r in graph.leiden(df, restarts=3).collect()}
    assert len(got) == 60 and len(set(got.values())) == 6 and all(got[10 * c + i] == got[10 * c] for c in range(6) for i in range(10))
    at = embedding.layout_rows(rows, df.withColumnRenamed("weight", "distance"), epochs=5).collect()
    assert sorted(r["id"] for r in at) == list(range(60))


def test_families_of_tests_go_to_as_many_tasks_as_they_call_for(spark, monkeypatch):
    """However well rows compress, a task gets about as many as it should."""
    from quillon.operators import scan

    monkeypatch.setattr(scan, "FAMILY_ROWS", 100)
    df = spark.range(6000).select((F.col("id") % 300).alias("g"), ((F.col("id") * 7919 % 997) / 997.0).alias("p"))
    got = scan.bh_fdr(df, "p", "q", ["g"])
    most = got.withColumn("t", F.spark_partition_id()).groupBy("t").count().agg(F.max("count")).first()[0]
    assert most <= 400 and got.count() == 6000
    for g, one in got.toPandas().groupby("g"):
        p = np.sort(one["p"].to_numpy())
        raw = p * len(p) / np.searchsorted(p, p, side="right")
        assert np.allclose(np.sort(one["q"]), np.minimum(1, np.minimum.accumulate(raw[::-1])[::-1]))


def test_row_order_over_centres(spark):
    """Over `meta` rows: every row has a place, and rows of one far-off group are next to each other."""
    from quillon.operators import embedding

    rng = np.random.default_rng(1)
    group = rng.integers(0, 6, 900)
    x = np.eye(6)[group] * 50 + rng.normal(0, 1, (900, 6))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>").repartition(4)
    got = {r["place"]: r["id"] for r in embedding.hierarchical_order(rows, meta=40).collect()}
    assert sorted(got) == list(range(900))
    runs = [group[got[i]] for i in range(900)]
    assert sum(a != b for a, b in zip(runs[:-1], runs[1:], strict=True)) == 5
    assert not np.array_equal(embedding._centres(rows, 40, 42, 1), embedding._centres(rows, 40, 42, 10))
