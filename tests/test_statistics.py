import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import distributions as D
from millrace.functions import multivariate as M
from millrace.functions import regression as R
from millrace.functions import statistics as S


def frame(spark, **columns):
    return spark.createDataFrame([tuple(float(v) for v in r) for r in zip(*columns.values())], ", ".join(f"{k} double" for k in columns))


def sample(spark, values):
    return frame(spark, v=values), "v"


def test_distributions_by_known_values():
    assert D.normal_cdf(1.959963984540054) == pytest.approx(0.975) and D.normal_ppf(0.975) == pytest.approx(1.959963984540054)
    assert D.t_ppf(0.975, 10) == pytest.approx(2.2281388519649385) and D.t_sf(2.2281388519649385, 10) == pytest.approx(0.025) and D.t_cdf(0, 3) == pytest.approx(0.5)
    assert D.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05) and D.chi2_sf(18.307038053275146, 10) == pytest.approx(0.05)
    assert D.f_sf(4.964602743730711, 1, 10) == pytest.approx(0.05) and D.f_sf(3.3258, 5, 10) == pytest.approx(0.05, abs=1e-4)
    for a, b, x in ((0.5, 0.5, 0.3), (2, 5, 0.7), (30, 40, 0.4)):
        n = 200_000
        t = (np.arange(n) + 0.5) / n
        pdf = np.exp((a - 1) * np.log(t) + (b - 1) * np.log1p(-t))
        assert D.beta_inc(a, b, x) == pytest.approx(pdf[t < x].sum() / pdf.sum(), abs=2e-3)


def test_t_tests(spark):
    r = S.t_test_single(sample(spark, [5.1, 4.9, 5.6, 5.8, 6.0]), 5.0)
    t = 0.48 / math.sqrt(0.217 / 5)
    assert (r.statistic, r.df, r.p) == (pytest.approx(t), 4, pytest.approx(2 * D.t_sf(t, 4))) and r.interval[0] < 5.48 < r.interval[1]
    a, b = sample(spark, [1, 2, 3, 4, 5]), sample(spark, [2, 4, 6, 8, 10])
    r = S.t_test_two(a, b)
    assert r.statistic == pytest.approx(-1.8973665961) and r.df == pytest.approx(5.8823529412) and r.p == pytest.approx(0.10753119, abs=1e-6)
    assert S.t_test_two(a, b, equal_variance=True).df == 8
    assert S.t_test_paired(frame(spark, x=[1, 2, 3, 4], y=[2, 2, 5, 4]), "x", "y").statistic == pytest.approx(-1.5666989)
    assert S.z_test_single(a, 2.0, 1.5, "greater").p == pytest.approx(D.normal_sf(1 / (1.5 / math.sqrt(5))))
    assert S.f_test_variance(b, a).statistic == pytest.approx(4)
    assert S.f_test_regression(80, 20, 2, 10).statistic == 20 and S.f_test_nested(30, 20, 12, 10).statistic == 2.5


def test_analysis_of_variance(spark):
    df = spark.createDataFrame([(g, float(v)) for g, vs in (("a", [6, 8, 4, 5, 3, 4]), ("b", [8, 12, 9, 11, 6, 8]), ("c", [13, 9, 11, 8, 7, 12])) for v in vs], "g string, v double")
    r = S.anova_one_way(df, "v", "g")
    assert r.statistic == pytest.approx(9.2647058824) and r.p == pytest.approx(0.0023987773, rel=1e-5) and (r.df, r.df2) == (2, 15)
    v = np.array([6, 8, 4, 5, 3, 4, 8, 12, 9, 11, 6, 8, 13, 9, 11, 8, 7, 12.0])
    ranks = np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])
    h = 12 / (18 * 19) * sum(ranks[i : i + 6].sum() ** 2 / 6 for i in (0, 6, 12)) - 3 * 19
    ties = sum((v == x).sum() ** 3 - (v == x).sum() for x in set(v))
    assert S.kruskal_wallis(df, "v", "g").statistic == pytest.approx(h / (1 - ties / (18**3 - 18)))
    assert S.levene(df, "v", "g").df2 == 15 and 0 < S.bartlett(df, "v", "g").p < 1
    two = spark.createDataFrame([(i, j, float(10 * i + 3 * j + k)) for i in (0, 1) for j in (0, 1, 2) for k in (0, 1, 2, 3)], "a int, b int, v double")
    r = S.anova_two_way(two, "v", "a", "b")
    assert r["a"].statistic == pytest.approx(600 / (30 / 18)) and r["interaction"].statistic == pytest.approx(0, abs=1e-9)
    rep = spark.createDataFrame([(s, c, float(v)) for s, row in enumerate([[1, 2, 4], [2, 3, 5], [3, 5, 6], [4, 4, 7]]) for c, v in enumerate(row)], "s int, c int, v double")
    r = S.anova_repeated(rep, "v", "s", "c")
    assert (r.df, r.df2) == (2, 6) and r.p < 0.001
    assert S.friedman(rep, "v", "s", "c").statistic == pytest.approx(7.6)


def test_chi_squared(spark):
    df = spark.createDataFrame([("x", "p")] * 10 + [("x", "q")] * 20 + [("y", "p")] * 30 + [("y", "q")] * 40, "a string, b string")
    r = S.chi_square_independence(df, "a", "b")
    assert r.statistic == pytest.approx(0.7936507937) and r.df == 1
    assert S.chi_square_fit(df, "a", [0.5, 0.5]).statistic == pytest.approx(16)
    with pytest.raises(ValueError):
        S.chi_square_fit(df, "a", [0.9, 0.9])


def test_correlations(spark):
    x, y = [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12], [2, 1, 4, 3, 7, 8, 6, 5, 12, 9, 10, 11]
    df = frame(spark, x=x, y=y)
    assert S.pearson(df, "x", "y").statistic == pytest.approx(np.corrcoef(x, y)[0, 1])
    assert S.spearman(df, "x", "y").statistic == pytest.approx(np.corrcoef(x, y)[0, 1])
    k = S.kendall(df, "x", "y")
    pairs = [(x[i] - x[j]) * (y[i] - y[j]) for i in range(12) for j in range(i)]
    assert k.statistic == pytest.approx(sum(np.sign(pairs)) / 66)
    ties = frame(spark, x=[1, 1, 2, 3, 3, 4], y=[1, 2, 2, 2, 3, 1])
    s = [np.sign(a - b) * np.sign(c - d) for (a, c), (b, d) in [(p, q) for i, p in enumerate(zip([1, 1, 2, 3, 3, 4], [1, 2, 2, 2, 3, 1])) for q in list(zip([1, 1, 2, 3, 3, 4], [1, 2, 2, 2, 3, 1]))[:i]]]
    assert S.kendall(ties, "x", "y").statistic == pytest.approx(sum(s) / math.sqrt((15 - 2) * (15 - 4)))
    m, p = S.correlation_matrix(df, ["x", "y"])
    assert m[0, 1] == m[1, 0] and p[0, 0] == 0
    assert S.diag(2).tolist() == [[1, 0], [0, 1]] and S.diag([[1, 2], [3, 4]]).tolist() == [1, 4] and S.diag([1, 2]).tolist() == [[1, 0], [0, 2]]


def test_rank_tests(spark):
    r = S.wilcoxon_single(sample(spark, [1.83, 0.5, 1.62, 2.48, 1.68, 1.88, 1.55, 3.06, 1.3]), 1.0)
    assert r.detail["exact"] and r.statistic == 43 and r.p == pytest.approx(0.01171875)
    r = S.mann_whitney(sample(spark, [0.8, 0.83, 1.89, 1.04, 1.45, 1.38, 1.91, 1.64, 0.73, 1.46]), sample(spark, [1.15, 0.88, 0.9, 0.74, 1.21]), "greater")
    assert r.detail["exact"] and r.statistic == 35 and r.p == pytest.approx(0.1272, abs=1e-4)
    assert not S.mann_whitney(sample(spark, [1, 1, 2, 3]), sample(spark, [1, 2, 2, 4])).detail["exact"]


def test_moments(spark):
    x = np.array([1.0, 2, 3, 5])
    df = frame(spark, v=x)
    assert S.skewness(df, "v") == pytest.approx(0.4347, abs=1e-4) and S.skewness(df, "v", "G1") == pytest.approx(0.7528, abs=1e-4)
    assert S.kurtosis(df, "v") == pytest.approx(-1.1543, abs=1e-4) and S.kurtosis(df, "v", "G2") == pytest.approx(0.3429, abs=1e-4)


def test_linear_models(spark):
    rng = np.random.default_rng(0)
    x, z = rng.normal(1000, 3, 300), rng.normal(0, 1, 300)
    y = 3 + 2 * x - 0.5 * z + rng.normal(0, 0.3, 300)
    df = frame(spark, y=y, x=x, z=z)
    f = R.linear(df, "y", ["x", "z"])
    a = np.c_[np.ones(300), x, z]
    b, rss = np.linalg.lstsq(a, y, rcond=None)[:2]
    assert f.coefficients == pytest.approx(b, rel=1e-6) and f.measures["rss"] == pytest.approx(rss[0])
    assert f.errors == pytest.approx(np.sqrt(np.diagonal(np.linalg.inv(a.T @ a)) * rss[0] / 297), rel=1e-4)
    assert f.predict(df).agg(F.avg(F.abs(F.col("prediction") - F.col("y")))).first()[0] < 0.3
    p = R.polynomial(frame(spark, y=[1, 4, 9, 16, 25.5], x=[1, 2, 3, 4, 5]), "y", "x", 2)
    assert p.coefficients == pytest.approx(np.polyfit([1, 2, 3, 4, 5], [1, 4, 9, 16, 25.5], 2)[::-1], abs=1e-6)
    e = R.exponential(frame(spark, y=np.exp(0.3 * np.arange(6)) * 2, x=np.arange(6)), "y", "x")
    assert (e.measures["a"], e.measures["b"]) == (pytest.approx(2), pytest.approx(0.3))


@pytest.mark.parametrize("family,link", [("binomial", "logit"), ("binomial", "probit"), ("binomial", "cloglog"), ("poisson", "log"), ("gaussian", "identity")])
def test_generalised_linear_models(spark, family, link):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, 1500)
    eta = -0.4 + 0.8 * x
    mu = {"logit": 1 / (1 + np.exp(-eta)), "probit": np.array([D.normal_cdf(v) for v in eta]), "cloglog": 1 - np.exp(-np.exp(eta)), "log": np.exp(eta), "identity": eta}[link]
    y = rng.random(1500) < mu if family == "binomial" else rng.poisson(mu) if family == "poisson" else mu + rng.normal(0, 0.5, 1500)
    f = R.glm(frame(spark, y=y.astype(float), x=x), "y", ["x"], family, link)
    assert f.measures["converged"] and f.coefficients == pytest.approx([-0.4, 0.8], abs=0.15)
    # The score equations hold at the fit.
    if link in ("logit", "log", "identity"):
        eta = f.coefficients[0] + f.coefficients[1] * x
        m = {"logit": 1 / (1 + np.exp(-eta)), "log": np.exp(eta), "identity": eta}[link]
        assert abs(((y - m) * x).sum()) < 1e-3 and abs((y - m).sum()) < 1e-3
    assert f.predict(frame(spark, x=[0.0]), "class").first().prediction in (0, 1)


def test_components_and_factors(spark):
    rng = np.random.default_rng(1)
    g = rng.normal(size=(500, 2))
    data = np.c_[g[:, 0], g[:, 0] + 0.4 * rng.normal(size=500), g[:, 0] + 0.5 * rng.normal(size=500), g[:, 1], g[:, 1] + 0.4 * rng.normal(size=500), g[:, 1] + 0.5 * rng.normal(size=500)]
    cols = [f"x{i}" for i in range(6)]
    df = frame(spark, **dict(zip(cols, data.T)))
    c = M.pca(df, cols)
    assert c.values == pytest.approx(np.sort(np.linalg.eigvalsh(np.corrcoef(data.T)))[::-1]) and c.explained.sum() == pytest.approx(1)
    for extraction in ("pca", "paf", "ml"):
        for rotation in ("varimax", "promax", "oblimin", "geominT", "geominQ", "bentlerT", "bentlerQ", "simplimax", "none"):
            f = M.factor_analysis(df, cols, 2, extraction, rotation)
            assert f.communalities.max() < 1.01 and 0.5 < f.kmo < 1 and f.bartlett_p < 1e-6
            if rotation != "none":
                strong = np.abs(f.loadings).argmax(axis=1)
                assert len(set(strong[:3])) == len(set(strong[3:])) == 1 and strong[0] != strong[3]
    r = np.corrcoef(data.T)
    assert all(f.weights(r, m).shape == (6, 2) for m in ("regression", "bartlett", "anderson"))


def test_clusters(spark):
    x = np.array([[0, 0], [0, 1], [1, 0], [10, 10], [10, 11], [11, 10.0]])
    df = frame(spark, a=x[:, 0], b=x[:, 1])
    k = M.kmeans(df, ["a", "b"], 2, n_start=3)
    assert sorted(k.sizes) == [3, 3] and k.total_within == pytest.approx(8 / 3)
    assert len({r.cluster for r in M.assign(df, ["a", "b"], k).collect()}) == 2
    for method in M.LINKAGES:
        t = M.hierarchical(x, method)
        assert M.cut_tree(t, k=2) == [1, 1, 1, 2, 2, 2] and M.cut_tree(t, k=6) == [1, 2, 3, 4, 5, 6]
    assert M.hierarchical(x, "single").heights[:4] == pytest.approx([1] * 4) and M.cut_tree(M.hierarchical(x, "single"), height=2) == [1, 1, 1, 2, 2, 2]
    assert M.dbscan(np.vstack([x, [[50, 50]]]), 1.5, 3) == [1, 1, 1, 2, 2, 2, 0]
    s, mean = M.silhouette(x, [1, 1, 1, 2, 2, 2])
    assert mean > 0.9 and len(s) == 6
    assert M.rows_of(df, ["a", "b"]).shape == (6, 2)


def test_neighbours(spark):
    train = spark.createDataFrame([(i, [float(a), float(b)], lab, y) for i, (a, b, lab, y) in enumerate([(0, 0, "red", 1.0), (0, 1, "red", 2.0), (1, 0, "red", 3.0), (10, 10, "blue", 10.0), (10, 11, "blue", 11.0), (11, 10, "blue", 12.0)])], "id long, v array<double>, label string, y double")
    test = spark.createDataFrame([(100, [0.1, 0.2]), (101, [10.2, 10.1])], "id long, v array<double>")
    assert {r.id: r.predicted for r in M.knn_classify(train, test, "v", "label", 3, "id", "id").collect()} == {100: "red", 101: "blue"}
    assert {r.id: r.predicted for r in M.knn_regress(train, test, "v", "y", 3, "id", "id").collect()} == {100: 2.0, 101: 11.0}
    assert M.knn_classify(train, train, "v", "label", 3, "id", "id", "distance").count() == 6
    assert [r.neighbor_id for r in M.nearest_neighbors(train, test.filter("id = 100"), "v", 2, "id", "id").orderBy("rank").collect()] == [0, 1]


@pytest.mark.parametrize("method", ["varimax", "quartimax", "equamax", "parsimax", "promax", *M.CRITERIA])
def test_rotations_keep_what_is_common(method):
    """Rotated loadings with the factor correlations give the same common variance; orthogonal ones keep a right angle."""
    rng = np.random.default_rng(5)
    a = rng.normal(size=(9, 3))
    l, t, phi = M.rotate(a, method)  # noqa: E741
    assert l @ phi @ l.T == pytest.approx(a @ a.T) and np.diagonal(phi) == pytest.approx(np.ones(3))
    if method in M.CRITERIA:
        criterion, parameter, oblique = M.CRITERIA[method]
        assert criterion(l, parameter)[0] <= criterion(a, parameter)[0] + 1e-12
        # The gradients are those of the criterion.
        x, g = rng.normal(size=(9, 3)), None
        g = criterion(x, parameter)[1]
        for i, j in ((0, 0), (4, 2), (8, 1)):
            y, z = x.copy(), x.copy()
            y[i, j] += 1e-6
            z[i, j] -= 1e-6
            assert g[i, j] == pytest.approx((criterion(y, parameter)[0] - criterion(z, parameter)[0]) / 2e-6, rel=1e-4, abs=1e-6)
        if not oblique:
            assert t.T @ t == pytest.approx(np.eye(3), abs=1e-9)


def test_least_residuals():
    """No other uniquenesses leave less off the diagonal, and loadings that made the matrix are found again."""
    import numpy as np

    from millrace.functions import multivariate

    rng = np.random.default_rng(2)
    l = rng.uniform(0.3, 0.8, (6, 2)) * np.array([[1, 1], [1, -1], [1, 1], [1, -1], [1, 0.2], [0.5, 1]])
    made = l @ l.T / max(1.0, (l**2).sum(axis=1).max() * 1.2)
    np.fill_diagonal(made, 1)
    got, converged = multivariate._least_residuals(made, 2, 500, 1e-9)
    off = ~np.eye(6, dtype=bool)
    assert converged and np.abs((made - got @ got.T)[off]).max() < 1e-4
    noisy = np.corrcoef(rng.normal(size=(60, 2)) @ rng.normal(size=(2, 6)) + rng.normal(size=(60, 6)), rowvar=False)
    got, _ = multivariate._least_residuals(noisy, 1, 500, 1e-9)
    least = ((noisy - got @ got.T)[off] ** 2).sum()
    for _ in range(200):
        other = got + rng.normal(0, 0.02, got.shape)
        assert ((noisy - other @ other.T)[off] ** 2).sum() >= least - 1e-9


def test_discordant_pairs_in_blocks(spark):
    """Frequent values on both axes, blocks of few rows: the count is that of all pairs."""
    import random

    from millrace.functions import statistics as S

    rng = random.Random(4)
    rows = {}
    for _ in range(700):
        rows[float(rng.choice([0, 0, 0, rng.randint(-20, 20)])), float(rng.choice([5, 5, rng.randint(-30, 30)]))] = float(rng.randint(1, 4))
    points = [(*k, n) for k, n in rows.items()]
    want = sum(n * m for x, y, n in points for u, v, m in points if x < u and y > v)
    df = spark.createDataFrame(points, "x double, y double, n double")
    for size in (10, 60, 10**6):
        assert S._discordant(df, size) == want
    y = [rng.randint(0, 50) for _ in range(333)]
    import numpy as np

    assert S.inversions(np.array(y, float), np.ones(333)) == sum(y[i] > y[j] for i in range(333) for j in range(i + 1, 333))


def test_neighbours_through_cells(spark):
    """Clusters, ties, repeated vectors and many shards: the k nearest of all rows."""
    import numpy as np

    from millrace.functions import multivariate, neighbors

    rng = np.random.default_rng(5)
    centres = rng.normal(0, 10, (12, 5))
    x = np.round(centres[rng.integers(0, 12, 900)] + rng.normal(0, 0.4, (900, 5)), 1)
    x[100:160] = x[100]
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, v array<double>")
    asked = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(np.r_[x[95:110], rng.normal(0, 10, (10, 5))])], "q long, v array<double>")
    want = []
    for r in asked.collect():
        d = np.sqrt(((x - np.array(r.v)) ** 2).sum(axis=1))
        want += [(r.q, k + 1, int(i)) for k, i in enumerate(np.lexsort((np.arange(900), d))[:4])]
    for shard in (40, 20_000):
        got = neighbors.nearest(df, asked, "v", 4, "id", "q", shard)
        assert sorted((r.q, r["rank"], r.neighbor_id) for r in got.collect()) == want
    assert multivariate.nearest_neighbors(df.limit(0), asked, "v", 2, "id", "q").count() == 0
    assert multivariate.nearest_neighbors(df.limit(3), asked, "v", 5, "id", "q").count() == 75
    nodes = neighbors.cells_of(x, 20)
    cell = neighbors.place(nodes, x)
    assert len(set(cell.tolist())) == sum(len(n) == 1 for n in nodes) > 8
