"""Hand-made cases for operators."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon import model
from quillon.model import CountMatrix, from_arrays
from quillon.functions import scalar
from quillon.operators import annotate, consensus, differential, embedding, enrich, graph, inputs, intervals, matrix, ranking, regions, residuals, scan
from quillon.sources import text


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


IV = "chrom string, start long, end long, name string"


def test_touching_nested_and_missing(spark):
    a = frame(spark, [("1", 0, 5, "a"), ("1", 5, 9, "b"), ("2", 0, 100, "c"), ("3", 1, 2, "d")], IV)
    b = frame(spark, [("1", 5, 6, "x"), ("2", 10, 20, "y"), ("2", 10, 20, "z"), ("4", 0, 9, "w")], IV)
    got = intervals.overlap_pairs(a, b, width=4).select("l_name", "r_name").collect()
    assert sorted(map(tuple, got)) == [("b", "x"), ("c", "y"), ("c", "z")]
    assert intervals.overlap_semi(a, b, 4).count() == 2
    assert sorted(map(tuple, intervals.overlap_pairs(a, b, width=4, slack=1).select("l_name", "r_name").where("l_chrom = '1'").collect())) == [("a", "x"), ("b", "x")]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 60), st.integers(1, 30)), min_size=1, max_size=12), st.integers(1, 40))
def test_bins_equal_theta(spark, rows, width):
    df = frame(spark, [(c, s, s + n, str(i)) for i, (c, s, n) in enumerate(rows)], IV)
    got = sorted(map(tuple, intervals.overlap_pairs(df, df, width).select("l_name", "r_name").collect()))
    want = sorted((str(i), str(j)) for i, (c, s, n) in enumerate(rows) for j, (k, t, m) in enumerate(rows) if c == k and s < t + m and t < s + n)
    assert got == want


def test_nearest_ties_and_limits(spark):
    q = frame(spark, [("1", 100, 110, "q"), ("1", 2000, 2001, "far"), ("9", 0, 1, "none")], IV)
    p = frame(spark, [("1", 90, 91, "b"), ("1", 90, 91, "a"), ("1", 119, 120, "c")], "chrom string, start long, end long, gene string")
    got = {r["name"]: (r["gene"], r["distance"]) for r in intervals.nearest(q, p, width=64).collect()}
    assert got == {"q": ("a", 10), "far": ("c", 1881), "none": ("None", None)}
    assert {r["gene"] for r in intervals.nearest(q, p, 10, 64).collect()} == {"None"}


def test_merge_and_coverage(spark):
    df = frame(spark, [("1", 0, 5, "a"), ("1", 5, 9, "b"), ("1", 20, 30, "c"), ("1", 22, 24, "d"), ("1", 40, 41, "e")], IV)
    for tile in (3, 16, 1000):
        assert sorted(map(tuple, intervals.merge_overlapping(df, 2, tile=tile).collect())) == [("1", 0, 9, 2), ("1", 20, 30, 2)]
    assert (("1", 22, 24, 2)) in list(map(tuple, intervals.coverage(df).collect()))


def test_domains_contain_basal(spark):
    genes = frame(spark, [("1", 100, 200, "+", "a", 0), ("1", 400, 500, "-", "b", 1), ("2", 5, 9, "+", "c", 2), ("7", 5, 9, "+", "lost", 3)], "chrom string, start long, end long, strand string, gene string, ord long")
    sizes = frame(spark, [("1", 1000), ("2", 50)], "chrom string, size long")
    got = {r["gene"]: (r["start"], r["end"]) for r in regions.regulatory_domains(genes, sizes, 50, 10, 100).collect()}
    assert got == {"a": (0, 210), "b": (390, 650), "c": (0, 50)}
    assert regions.drop_repeated(genes.union(genes.where("gene = 'a'"))).count() == 3


def test_bh_matches_definition(spark):
    p = [0.01, 0.04, 0.03, 0.04, 0.5, None]
    got = {r["i"]: r["q"] for r in scan.bh_fdr(frame(spark, list(enumerate(p)), "i int, p double"), "p", "q").collect()}
    assert got[5] is None
    assert [round(got[i], 9) for i in range(5)] == [0.05, 0.05, 0.05, 0.05, 0.5]
    within = scan.bh_fdr(frame(spark, [(i % 2, x) for i, x in enumerate(p)], "g int, p double"), "p", "q", ["g"]).collect()
    assert {round(r["q"], 9) for r in within if r["g"] == 0} == {0.03, 0.045, 0.5}


def test_matrix_from_arrays_and_factors(spark):
    x = np.array([[0, 2, 4, 8], [1, 2, 0, 4], [3, 6, 9, 12]])
    m = model.from_arrays(spark, x, input_counts=x + 1, random_counts=x, random_input=x)
    assert m.counts.count() == 10 and m.need("layers", "input").count() == 12
    with pytest.raises(KeyError):
        m.need("layers", "residuals")
    got = {r["obs_id"]: r["raw"] for r in matrix.size_factors(m.counts, m.obs, m.var, "fpkm_uq").collect()}
    assert got == pytest.approx({str(i): v for i, v in enumerate(np.percentile(x, 75, axis=1))})
    both = {r["var_id"]: (r["mean"], r["variance"]) for r in matrix.feature_moments(m.counts, m.obs.select("obs_id", F.lit(1.0).alias("size_factor")), 3).collect()}
    for j in range(4):
        assert both[str(j)] == pytest.approx((x[:, j].mean(), x[:, j].var()))
    dense = {r["var_id"]: r["x"] for r in m.feature_major().collect()}
    assert dense["2"] == [4.0, 0.0, 9.0]
    with pytest.raises(ValueError):
        matrix.size_factors(m.counts, m.obs, m.var, "nothing")
    with pytest.raises(ValueError):
        matrix.trim_low_counts(m.counts, 0)
    part = m.select(obs=m.obs.where("ord < 2"))
    assert part.obs.count() == 2 and part.counts.count() == 6


def test_reference_point(spark):
    rows = [("o", f"r{i}", c, n) for i, (c, n) in enumerate([(1, 50), (2, 50), (3, 50), (90, 10), (4, 40)])]
    got = inputs.reference_lfc(frame(spark, rows, "obs_id string, var_id string, value long, input long")).first()
    # the order is by count: leads are read after each place
    assert not got["low"] or got["lfc"] == pytest.approx(np.log(100 / 200))


def test_closed_form_poisson_and_nb_agree_without_dispersion():
    rng = np.random.default_rng(1)
    e = rng.uniform(5, 10, 400)
    member = np.arange(400) < 80
    y = rng.poisson(e * np.where(member, 1.5, 1.0)).astype(float)
    beta, p, alpha = enrich.nb_two_groups(y, e, np.ones(400), member)
    closed = np.log(y[member].sum() / e[member].sum()) - np.log(y[~member].sum() / e[~member].sum())
    assert beta == pytest.approx(closed, abs=0.02) and p < 1e-6 and alpha < 0.05


def test_nb_null_is_calm():
    rng = np.random.default_rng(2)
    ps = []
    for _ in range(40):
        e = rng.uniform(1, 5, 150)
        lam = rng.gamma(2.0, e / 2.0)
        ps.append(enrich.nb_two_groups(rng.poisson(lam).astype(float), e, np.ones(150), rng.random(150) < 0.2)[1])
    assert 0.2 < np.mean(np.array(ps) < 0.5) < 0.8 and min(ps) > 1e-4


def test_mann_whitney_and_dispatch(spark):
    groups = differential.two_groups(frame(spark, [("a", "x"), ("b", "x"), ("c", "y"), ("d", "y")], "obs_id string, label string"), "x")
    counts = frame(spark, [("c", "v", 5), ("d", "v", 7), ("a", "v", 1)], "obs_id string, var_id string, value int")
    assert differential.mann_whitney_u(counts, groups).first()["u"] == 4.0
    with pytest.raises(ValueError):
        differential.two_groups(frame(spark, [("a", "x"), ("b", "y"), ("c", "z")], "obs_id string, label string"), "x")


def test_merge_peaks_groups_close_summits(spark):
    rows = [("1", 100, 140, None, 120), ("1", 104, 146, None, 125), ("1", 600, 640, None, 620), ("1", 603, 641, None, 622), ("1", 900, 940, None, 920), ("x", 1, 9, None, 5)]
    peaks = consensus.normalise_peaks(frame(spark, rows, "chrom string, start long, end long, strand string, summit long"))
    got = sorted((r["start"], r["end"], r["n_peaks"], r["centre"]) for r in consensus.merge_peaks(peaks, frame(spark, [("1", 2000)], "chrom string, size long")).collect())
    assert got == [(100, 146, 2, 122), (600, 641, 2, 621)]
    mixed = [("1", 0, 5, s, 2) for s in "+-."]
    with pytest.raises(ValueError):
        consensus.normalise_peaks(frame(spark, mixed, "chrom string, start long, end long, strand string, summit long"))


def test_greedy_suppression(spark):
    rows = [("1", 0, 10, "+", 5, 3.0), ("1", 2, 12, "+", 7, 9.0), ("1", 11, 20, "+", 15, 1.0), ("1", 300, 310, "+", 305, 5.0)]
    got = consensus.greedy_suppression(frame(spark, rows, "chrom string, start long, end long, strand string, summit long, score double")).collect()
    assert [(r["start"], r["n"]) for r in got] == [(2, 2)]


def test_residuals_centre_and_kinds():
    rng = np.random.default_rng(3)
    mu = np.full(3000, 6.0)
    y = rng.poisson(rng.gamma(2.0, mu / 2.0)).astype(float)
    for kind in ("quantile", "rqr", "deviance", "anscombe", "pearson"):
        r = residuals.residual(y, mu, 0.5, kind)
        assert np.isfinite(r).all() and abs(r.mean()) < 0.25 and 0.8 < r.std() < 1.2
    alpha, ok = residuals.fit_alpha(y[:800], np.ones(800), np.ones((800, 1)))
    assert ok and 0.35 < alpha < 0.7
    assert residuals.fit_alpha(np.zeros(5), np.ones(5), np.ones((5, 1)))[1] is False


def test_elbow_and_text():
    curve = 100 * np.exp(-np.linspace(0, 8, 200))
    cut = ranking.elbow(curve)
    assert cut is not None and 1 < cut < 60
    assert ranking.elbow(np.ones(10)) is None


def test_scalar_functions(spark):
    df = frame(spark, [("alpha beta gamma delta epsilon", "chr1:10-20"), (None, "bad")], "t string, r string")
    got = df.select(scalar.cap_text(F.col("t"), 10).alias("c"), scalar.wrap_text(F.col("t"), 11).alias("w"), scalar.region_part(F.col("r")).alias("p")).collect()
    assert got[0]["c"] == "alpha b..." and got[1]["c"] == "N/A"
    assert got[0]["w"] == "Alpha beta<br>gamma delta<br>epsilon"
    assert (got[0]["p"]["chrom"], got[0]["p"]["start"], got[0]["p"]["end"]) == ("chr1", 10, 20)


def test_planted_clusters(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(0, 0.2, (30, 4)), rng.normal(5, 0.2, (30, 4)), rng.normal(-5, 0.2, (30, 4))])
    rows = spark.createDataFrame(pd.DataFrame({"id": np.arange(90), "vec": [v.tolist() for v in x], "label": [str(i // 30) for i in range(90)]}), "id long, vec array<double>, label string")
    edges = graph.knn(rows, 8)
    found = graph.leiden(graph.snn_weights(edges), restarts=2).toPandas().sort_values("id")
    assert graph.adjusted_mutual_information(found["label"].to_numpy(), np.arange(90) // 30) > 0.8
    vote = graph.knn_vote(edges, rows.select("id", "label"))
    assert graph.balanced_accuracy(vote, rows.select("id", "label")).first()["accuracy"] == 1.0
    order = embedding.hierarchical_order(rows, meta=100).toPandas().sort_values("place")["id"].to_numpy() // 30
    assert (np.diff(order) != 0).sum() == 2
    assert graph.adjusted_mutual_information(np.zeros(4), np.zeros(4)) == 1.0


def test_pca_keeps_the_planted_axis(spark):
    rng = np.random.default_rng(6)
    side = np.repeat([-1.0, 1.0], 10)
    feats = spark.createDataFrame(pd.DataFrame({"ord": np.arange(50), "x": [(side * rng.normal(2, 0.1) + rng.normal(0, 0.3, 20)).tolist() for _ in range(50)]}), "ord long, x array<double>")
    scores, table = embedding.pca_parallel(feats, [str(i) for i in range(20)], max_rank=5, min_comp=1)
    first = {r["obs_id"]: r["vec"][0] for r in scores.collect()}
    assert len({np.sign(first[str(i)]) for i in range(10)}) == 1 and np.sign(first["0"]) != np.sign(first["19"])
    assert table["kept"].iloc[0]


def test_text_sources(spark, tmp_path):
    (tmp_path / "a.gtf").write_text('#x\n1\tsrc\tgene\t11\t20\t.\t+\t.\tgene_id "i"; gene_name "A"; gene_type "coding";\n1\tsrc\texon\t11\t12\t.\t+\t.\tgene_name "A";\n')
    (tmp_path / "a.gmt").write_text("t1\tone\tA\tB\nt2\ttwo\tC\n")
    (tmp_path / "b.gmt").write_text("t1\tuno\tD\n")
    (tmp_path / "s.txt").write_text("1\t100\n")
    (tmp_path / "p.narrowPeak").write_text("1\t10\t30\tn\t7\t+\t1\t1\t1\t5\n")
    gene = text.gtf_genes(spark, str(tmp_path / "a.gtf"), biotype="coding").collect()
    assert [(g["start"], g["end"], g["gene"]) for g in gene] == [(10, 20, "A")]
    terms, members = text.gmt(spark, [str(tmp_path / "a.gmt"), str(tmp_path / "b.gmt")])
    assert {(r["term_id"], r["term_name"]) for r in terms.collect()} == {("t1", "uno"), ("t2", "two")}
    assert members.count() == 4
    assert text.chrom_sizes(spark, str(tmp_path / "s.txt")).first()["size"] == 100
    assert text.peaks(spark, [str(tmp_path / "p.narrowPeak")]).first()["summit"] == 15
    with pytest.raises(TypeError):
        text.peaks(spark, [], "wig")


def test_streaming_counts(spark, tmp_path):
    from quillon.streaming.counts import region_counts

    reads = frame(spark, [("2024-01-01 00:00:01", "1", 0, 5), ("2024-01-01 00:00:02", "1", 4, 9), ("2024-01-01 00:00:03", "2", 0, 5)], "t string, chrom string, start long, end long").withColumn("ts", F.to_timestamp("t")).drop("t")
    reads.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(reads.schema).parquet(str(tmp_path / "in"))
    out = region_counts(stream, frame(spark, [("1", 3, 8, "a")], IV), 4)
    query = out.writeStream.format("memory").queryName("counts_test").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert [(r["name"], r["n"]) for r in spark.sql("select name, n from counts_test").collect()] == [("a", 2)]


def test_layout_places_every_row(spark, monkeypatch):
    from quillon.plans import queries as plans

    n = 5200
    class Tables:
        pass
    t = Tables()
    t.spark, t.rows = spark, spark.range(n).select((F.col("id") * 3).alias("id"), F.array((F.col("id") % 97).cast("double"), (F.col("id") / 97).cast("double")).alias("vec"))
    monkeypatch.setattr(plans.graph, "knn", lambda rows, k: rows.select(F.col("id").alias("src"), F.pmod(F.col("id") + 3, F.lit(3 * n)).alias("dst"), F.lit(1).alias("rank"), F.lit(1.0).alias("distance")))
    got = plans.layout_2d.__wrapped__(t).toPandas() if hasattr(plans.layout_2d, "__wrapped__") else plans.layout_2d(t).toPandas()
    assert sorted(got["id"]) == list(range(0, 3 * n, 3)) and np.isfinite(got[["x", "y"]].to_numpy()).all()
    with pytest.raises(ValueError):
        embedding.layout_rows(t.rows, plans.graph.knn(t.rows, 1), most_edges=100)


def test_residual_queries_fit_the_default_sample(spark, sf_dir, monkeypatch):
    import inspect

    from quillon.plans import queries as plans

    usual, asked = inspect.signature(residuals.regularised_alpha), []

    fit = residuals.regularised_alpha

    def spy(*args, **named):
        bound = usual.bind(*args, **named)
        bound.apply_defaults()
        asked.append(bound.arguments["sample"])
        return fit(*args, **named)

    monkeypatch.setattr(residuals, "regularised_alpha", spy)
    for name in ("nb_residuals", "nb_residuals_input", "chi_square_features"):
        plans.QUERIES[name](spark, sf_dir)
    assert asked == [2000] * 3


# ---------------------------------------------------------------- annotations, factors, reads

def test_rolling_median_by_tiles(spark):
    rng = np.random.default_rng(0)
    rows = [(g, int(i), float(rng.normal())) for g, n in (("a", 700), ("b", 90), ("c", 1)) for i in rng.permutation(n)]
    df = frame(spark, rows, "g string, i int, x double").repartition(4)
    for tile in (None, 40):
        got = {(r["g"], r["i"]): r["median"] for r in ranking.rolling_median(df, "x", ["i"], ["g"], 20, tile).collect()}
        for g in "abc":
            x = np.array([v for _, v in sorted((i, v) for h, i, v in rows if h == g)])
            assert np.allclose([got[g, i] for i in range(len(x))], [np.median(x[max(0, i - 10) : i + 10]) for i in range(len(x))])
        assert len(got) == len(rows)
    same = frame(spark, [("a", 1, float(i)) for i in range(300)], "g string, i int, x double")
    assert ranking.rolling_median(same, "x", ["i"], ["g"], 20, 40).count() == 300


def test_designs_and_factors(spark):
    obs = frame(spark, [("a", 0, "x", 1.5), ("b", 1, "y", 2.0), ("c", 2, "z", 0.0)], "obs_id string, ord long, kind string, age double")
    assert [r["design"] for r in annotate.design_matrix(obs).orderBy("ord").collect()] == [[1.0]] * 3
    assert [r["design"] for r in annotate.design_matrix(obs, ["kind", "age"]).orderBy("ord").collect()] == [[1, 0, 0, 1.5], [1, 1, 0, 2], [1, 0, 1, 0]]
    with pytest.raises(KeyError):
        annotate.design_matrix(obs, ["no"])
    var, counts = frame(spark, [("v", 0)], "var_id string, ord long"), frame(spark, [("a", "v", 3)], "obs_id string, var_id string, value int")
    m = CountMatrix(obs, var, counts)
    given = frame(spark, [("a", 1.0), ("b", 2.0), ("c", 3.0)], "obs_id string, size_factor double")
    assert [r["size_factor"] for r in annotate.set_size_factors(m, given).obs.orderBy("ord").collect()] == [0.5, 1.0, 1.5]
    with pytest.raises(Exception, match="no size factor over 0 for c"):
        annotate.set_size_factors(m, given.where("obs_id <> 'c'")).obs.collect()
    factors = frame(spark, [("a", "v", 1.0), ("b", "v", 0.0), ("c", "v", 1.0)], "obs_id string, var_id string, factor double")
    with pytest.raises(Exception, match="no factor over 0 for b v"):
        annotate.set_normalisation_factors(m, factors).layers["normalization_factors"].collect()
    with pytest.raises(Exception, match="no median of ratios over 0"):
        matrix.size_factors(counts, obs, var, "deseq").collect()
    assert {r["kind"]: r["n"] for r in annotate.value_counts(annotate.recode(obs, "kind", {"x": "first"}), "kind").collect()} == {"first": 1, "y": 1, "z": 1}
    assert annotate.recode(obs, "kind", {}, "any").select("kind").distinct().collect()[0][0] == "any"


def test_signal_to_noise_needs_inputs_of_their_own(spark):
    rows = frame(spark, [("s", "Assigned", 60), ("s", "No", 40), ("i", "Assigned", 10), ("i", "No", 90), ("t", "Assigned", 5), ("t", "No", 5)], "file string, status string, n long")
    one = frame(spark, [("s", "i")], "file string, input string")
    assert text.mapping_stats(rows, one).first()["signal_noise"] == pytest.approx(6.0)
    shared = frame(spark, [("s", "i"), ("t", "i")], "file string, input string")
    assert {r["signal_noise"] for r in text.mapping_stats(rows, shared).collect()} == {None}


# ---------------------------------------------------------------- residuals

def test_fits_solve_the_score_equations():
    rng = np.random.default_rng(6)
    n = 400
    design = np.column_stack([np.ones(n), rng.integers(0, 2, n)])
    exposure = rng.uniform(0.5, 3, n)
    mean = exposure * np.exp(design @ [1.2, 0.7])
    y = rng.negative_binomial(1 / 0.4, 1 / (1 + 0.4 * mean)).astype(float)
    mu = residuals.fit_mean(y, exposure, design, 0.4)
    assert np.abs(design.T @ ((y - mu) / (1 + 0.4 * mu))).max() < 1e-6
    alpha, ok = residuals.fit_alpha(y, exposure, design)
    assert ok and alpha == pytest.approx(0.4, rel=0.3)
    beta = np.linalg.lstsq(design, np.log(mu / exposure), rcond=None)[0]
    assert beta == pytest.approx([1.2, 0.7], abs=0.2)


def _simulated(spark, n_obs=40, n_var=120, planted=8, seed=1):
    rng = np.random.default_rng(seed)
    mean = rng.uniform(5, 60, n_var)[None, :] * np.ones((n_obs, 1))
    mean[: n_obs // 2, :planted] *= 6
    counts = rng.negative_binomial(10, 1 / (1 + 0.1 * mean))
    m = from_arrays(spark, counts)
    return counts, annotate.set_size_factors(m, m.obs.select("obs_id", F.lit(1.0).alias("size_factor")))


def test_compute_residuals_finds_planted_features(spark):
    counts, m = _simulated(spark)
    done = residuals.compute_residuals(m)
    ssr = matrix.sum_of_squares(done.layers["residuals"])
    chosen = {int(r["var_id"]) for r in ranking.chi_square_features(ssr, len(counts) - 1).collect()}
    assert set(range(8)) <= chosen and len(chosen) < 20
    var = done.var.toPandas().set_index("var_id")
    assert var["mean"].loc["3"] == pytest.approx(counts[:, 3].mean()) and var["reg_alpha"].between(0.01, 10).all()
    with pytest.raises(KeyError):
        residuals.compute_residuals(CountMatrix(m.obs.drop("size_factor"), m.var, m.counts))
    with pytest.raises(ValueError):
        residuals.compute_residuals(m, np.ones((3, 1)))


def test_input_exposures_take_out_what_the_input_explains(spark):
    counts, m = _simulated(spark)
    factor = np.ones(counts.shape)
    factor[: len(counts) // 2, :8] = 6.0  # the control rises where the signal does
    rows = [(str(i), str(j), float(factor[i, j])) for i in range(factor.shape[0]) for j in range(factor.shape[1])]
    given = frame(spark, rows, "obs_id string, var_id string, factor double")
    with pytest.raises(KeyError):
        residuals.compute_residuals(CountMatrix(m.obs, m.var, m.counts, layers={"input": m.counts}))
    done = residuals.compute_residuals(annotate.set_normalisation_factors(m, given))
    ssr = {int(r["var_id"]): r["ssr"] for r in matrix.sum_of_squares(done.layers["residuals"]).collect()}
    plain = {int(r["var_id"]): r["ssr"] for r in matrix.sum_of_squares(residuals.compute_residuals(m).layers["residuals"]).collect()}
    assert np.mean([ssr[i] for i in range(8)]) < 1.5 * np.mean([ssr[i] for i in range(8, 120)])
    assert np.mean([plain[i] for i in range(8)]) > 2 * np.mean([plain[i] for i in range(8, 120)])


# ---------------------------------------------------------------- graphs

def test_leiden_communities_are_connected_and_good(spark):
    # a ring of cliques: each clique is a community
    edges = [(10 * c + i, 10 * c + j, 1.0) for c in range(12) for i in range(10) for j in range(10) if i != j]
    edges += [(10 * c, (10 * c + 10) % 120, 1.0) for c in range(12)]
    got = {r["id"]: r["label"] for r in graph.leiden(frame(spark, edges, "src long, dst long, weight double"), restarts=2).collect()}
    assert len(set(got.values())) == 12 and all(got[10 * c + i] == got[10 * c] for c in range(12) for i in range(10))
    rng = np.random.default_rng(3)
    s, d = rng.integers(0, 300, 900), rng.integers(0, 300, 900)
    s, d = s[s != d], d[s != d]
    w = np.ones(len(s))
    label = graph._communities(300, s, d, w, 1.0, np.random.default_rng(0))
    assert graph.modularity(s, d, w, label) > 0.38  # random graphs of this kind have about 0.4
    for c in np.unique(label):
        node = set(np.flatnonzero(label == c).tolist())
        reached, todo = set(), [min(node)]
        while todo:
            x = todo.pop()
            if x not in reached:
                reached.add(x)
                todo += [y for y in [*d[s == x].tolist(), *s[d == x].tolist()] if y in node]
        assert reached == node


def test_approximate_neighbours(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 4, (40, 20))
    x = centres[rng.integers(0, 40, 3000)] + rng.normal(0, 1, (3000, 20))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    exact = {(r["src"], r["dst"]) for r in graph.knn(rows, 10).collect()}
    got = graph.knn_approximate(rows, 10, leaf=256).toPandas()
    assert len(set(zip(got["src"], got["dst"])) & exact) / len(exact) >= 0.9
    assert (got.groupby("src")["rank"].max() == 10).all() and (got["src"] != got["dst"]).all()
    some = rows.where("id < 60")
    assert {(r["src"], r["dst"]) for r in graph.knn_approximate(some, 5).collect()} == {(r["src"], r["dst"]) for r in graph.knn(some, 5).collect()}
    twins = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(500)], "id long, vec array<double>")
    assert graph.knn_approximate(twins, 3, leaf=16).groupBy("src").count().where("count = 3").count() == 500


def test_cluster_rows(spark):
    rng = np.random.default_rng(8)
    truth = rng.integers(0, 3, 90)
    x = np.eye(3)[truth] * 10 + rng.normal(0, 0.3, (90, 3))
    obs = spark.createDataFrame([(f"o{i}", i) for i in range(90)], "obs_id string, ord long")
    var = spark.createDataFrame([(f"v{j}", j) for j in range(3)], "var_id string, ord long")
    layer = spark.createDataFrame([(f"o{i}", f"v{j}", float(x[i, j])) for i in range(90) for j in range(3)], "obs_id string, var_id string, value double")
    pca = spark.createDataFrame([(f"o{i}", v.tolist()) for i, v in enumerate(x)], "obs_id string, vec array<double>")
    m = CountMatrix(obs, var, layer, layers={"l": layer}, obsm={"X_pca": pca})
    for kw in ({}, {"on": "layer", "which": "l"}, {"approximate": False}):
        got = {r["obs_id"]: r["label"] for r in graph.cluster_rows(m, **kw).collect()}
        assert graph.adjusted_mutual_information(truth, np.array([got[f"o{i}"] for i in range(90)])) > 0.7
    with pytest.raises(ValueError):
        graph.cluster_rows(m, "rows")
    with pytest.raises(KeyError):
        graph.cluster_rows(m, "obsm", "no")


def test_layout_keeps_groups_together(spark):
    rng = np.random.default_rng(8)
    truth = np.repeat([0, 1, 2], 60)
    x = np.eye(3)[truth] * 12 + rng.normal(0, 1, (180, 3))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    got = embedding.layout_rows(rows, graph.knn(rows, 10)).toPandas().sort_values("id")[["x", "y"]].to_numpy()
    mid = np.stack([got[truth == c].mean(0) for c in range(3)])
    assert (np.argmin(((got[:, None] - mid[None]) ** 2).sum(2), 1) == truth).mean() > 0.95
    a, b, w = embedding.fuzzy_weights(graph.knn(rows, 10).toPandas(), 180)
    assert (a < b).all() and ((w > 0) & (w <= 1 + 1e-9)).all()


# ---------------------------------------------------------------- model, rasters, files

def test_matrix_is_written_and_read(spark, tmp_path):
    m = from_arrays(spark, np.array([[1, 0], [2, 3]]), input_counts=np.array([[1, 1], [0, 2]]))
    m.obsm["X"] = spark.createDataFrame([("0", [1.0]), ("1", [2.0])], "obs_id string, vec array<double>")
    m.write(str(tmp_path / "m"))
    back = CountMatrix.read(spark, str(tmp_path / "m"), layers=("input",), obsm=("X",))
    for a, b in ((m.obs, back.obs), (m.counts, back.counts), (m.layers["input"], back.layers["input"]), (m.obsm["X"], back.obsm["X"])):
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    with pytest.raises(KeyError):
        back.need("layers", "no")


def test_raster_of_three_axes(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(2, 9, 7))
    cells = frame(spark, [(d, i, j, float(x[d, i, j])) for d in range(2) for i in range(9) for j in range(7)], "depth int, i int, j int, value double")
    got = {(r["depth"], r["x"], r["y"]): r["value"] for r in matrix.raster(cells, 9, 7, 4, 3, by=("depth",)).collect()}
    for d in range(2):
        top, low = np.zeros((4, 3)), np.zeros((4, 3))
        for i in range(9):
            for j in range(7):
                fx, fy = 4 * i / 9, 3 * j / 7
                for a in (0, 1):
                    for b in (0, 1):
                        px, py = int(fx) + a, int(fy) + b
                        if px < 4 and py < 3:
                            w = 1 - abs(px - fx) * abs(py - fy)
                            top[px, py] += w * x[d, i, j]
                            low[px, py] += w
        assert np.allclose([[got[d, i, j] for j in range(3)] for i in range(4)], top / (1e-9 + low))


def test_other_files(spark, tmp_path):
    (tmp_path / "d.bed").write_text("1\t5\t9\tg1\n2\t0\t4\tg2\n")
    assert [tuple(r) for r in text.regulatory_bed(spark, str(tmp_path / "d.bed")).orderBy("chrom").collect()] == [("1", 5, 9, "g1"), ("2", 0, 4, "g2")]
    (tmp_path / "p.bed").write_text("1\t5\t9\tn\t3\t+\t7\n")
    r = text.peaks(spark, [str(tmp_path / "p.bed")], "bed").first()
    assert (r["start"], r["end"], r["strand"], r["summit"], r["score"]) == (5, 9, "+", 7, 3.0)
    regions = frame(spark, [("1", 5, 9, "g1", 0)], "chrom string, start long, end long, name string, ord long")
    text.write_tsv(text.bed_to_saf(regions, names=True), str(tmp_path / "saf"))
    assert [tuple(r) for r in text.saf(spark, str(tmp_path / "saf")).collect()] == [("1", 5, 9, ".", "g1")]
    track = frame(spark, [("+", "1", 10, [0.5, 1.25])], "strand string, chrom string, start long, values array<double>")
    text.density_track(track, str(tmp_path / "wig"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "wig")).collect()] == ["fixedStep chrom=1 start=11 step=5", "0.5", "1.25"]


def test_cca_finds_the_shared_axis(spark):
    rng = np.random.default_rng(4)
    axis = np.linspace(-1, 1, 30)
    x = np.outer(axis, rng.normal(size=50)) + rng.normal(0, 0.05, (30, 50))
    wide = lambda a: spark.createDataFrame([(f"v{j}", j, a[:, j].tolist()) for j in range(50)], "var_id string, ord long, x array<double>")
    ids = [f"o{i}" for i in range(30)]
    a, b = embedding.cca(wide(x), wide(x + rng.normal(0, 0.05, x.shape)), ids, ids, 2)
    for side in (a, b):
        first = np.array([r["vec"][0] for r in sorted(side.collect(), key=lambda r: int(r["obs_id"][1:]))])
        assert abs(np.corrcoef(first, axis)[0, 1]) > 0.98


def test_pooled_factors_follow_depth(spark):
    rng = np.random.default_rng(9)
    depth = rng.uniform(0.5, 2, 60)
    m = from_arrays(spark, rng.poisson(np.outer(depth, rng.uniform(5, 50, 80))))
    got = {r["obs_id"]: r["size_factor"] for r in matrix.size_factors(m.counts, m.obs, m.var, "pooled").collect()}
    assert np.corrcoef([got[str(i)] for i in range(60)], depth)[0, 1] > 0.95


def test_per_peak_widths(spark):
    rows = [("1", a, a + w, "+", a + w // 2) for a, w in ((100, 40), (104, 40), (400, 8), (401, 8), (700, 200))]
    peaks = consensus.normalise_peaks(frame(spark, rows, "chrom string, start long, end long, strand string, summit long"))
    sizes = frame(spark, [("1", 2000)], "chrom string, size long")
    got = sorted((r["start"], r["end"], r["n_peaks"]) for r in consensus.merge_peaks(peaks, sizes, per_peak=True).collect())
    assert got == [(100, 144, 2), (400, 409, 2)]
