"""Hand-made cases of the operators: known numbers, edges, refusals."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions.normal import phi
from tidemark.operators import bars, bet_sizing, breaks, cv, entropy, fracdiff, labeling, microstructure, models, montecarlo, parallel, portfolio, risk, stats, weights
from tidemark.operators.series import asof, by_series, require_finite, with_pos


def ticks(spark, prices, volumes=None, series="a", start="2024-01-01"):
    ts = pd.date_range(start, periods=len(prices), freq="s")
    return spark.createDataFrame([(series, t.to_pydatetime(), k, float(p), float(v)) for k, (t, p, v) in enumerate(zip(ts, prices, volumes or [1] * len(prices), strict=True))], "series_id string, ts timestamp_ntz, seq long, price double, volume double")


def values(spark, xs, name="value", series="a"):
    return spark.createDataFrame([(series, k, None if x is None else float(x)) for k, x in enumerate(xs)], f"series_id string, pos long, {name} double")


def column(df, name, order="pos"):
    return [r[name] for r in df.orderBy(order).collect()]


def test_phi(spark):
    got = spark.createDataFrame([(x,) for x in (-40.0, -8.0, -1.0, 0.0, 0.5, 3.0, 9.0)], "z double").select(phi("z").alias("p")).collect()
    assert [r["p"] for r in got] == pytest.approx([stats.phi_value(x) for x in (-40.0, -8.0, -1.0, 0.0, 0.5, 3.0, 9.0)], rel=1e-9, abs=1e-16)


def test_threshold_bars_start_from_zero(spark):
    got = bars.volume_bars(ticks(spark, [1, 2, 3, 4, 5, 6], [3, 4, 3, 9, 1, 1]), 5).orderBy("bar_id").collect()
    assert [(r["open"], r["close"], r["volume"], r["ticks"]) for r in got] == [(1, 2, 7, 2), (3, 4, 12, 2)]


def test_tick_bars_drop_an_open_bar(spark):
    assert bars.tick_bars(ticks(spark, range(1, 8)), 3).count() == 2
    with pytest.raises(ValueError):
        bars.tick_bars(ticks(spark, [1]), 0)


def test_tick_bars_bucket_by_bucket(spark):
    t = ticks(spark, range(1, 200), start="2024-01-01 23:59:00")
    assert sorted(bars.tick_bars(t, 7, bucket="minute").collect()) == sorted(bars.tick_bars(t, 7).collect())


def test_time_bars_close_on_the_right(spark):
    got = bars.time_bars(ticks(spark, [1, 2, 3], start="2024-01-01 00:00:59"), "1 minute").orderBy("bar_ts").collect()
    assert [(str(r["bar_ts"]), r["ticks"]) for r in got] == [("2024-01-01 00:01:00", 2), ("2024-01-01 00:02:00", 1)]


def test_zero_imbalance_closes_every_tick(spark):
    assert bars.imbalance_bars(ticks(spark, [1, 2, 1, 2, 1, 2]), init_T=2, b0=-1.0).count() == 6


def test_cusum_is_strict(spark):
    assert bars.cusum_filter(ticks(spark, [0, 1, 2, 3, 2, 1, 0]), 2.0).select("seq", "side").collect() == [(3, 1), (6, -1)]


def test_fold_keeps_series_apart(spark):
    both = ticks(spark, [1, 5, 9], series="a").unionByName(ticks(spark, [100, 104, 108], series="b"))
    assert bars.cusum_filter(both, 3.0).groupBy("series_id").count().orderBy("series_id").collect() == [("a", 2), ("b", 2)]


def test_empty_table(spark):
    none = ticks(spark, [1]).limit(0)
    for df in (bars.volume_bars(none, 5), bars.tick_bars(none, 5), bars.cusum_filter(none, 1.0), microstructure.vpin(none, 5, 2), bars.imbalance_bars(none)):
        assert df.count() == 0


def test_require_finite(spark):
    with pytest.raises(ValueError, match="positive"):
        require_finite(ticks(spark, [1, -1]), "price", positive=["price"])
    with pytest.raises(ValueError, match="finite"):
        require_finite(values(spark, [1, float("nan")]), "value")


@pytest.mark.parametrize(("forward", "strict", "want"), [(False, False, [None, 2, 2, 4]), (False, True, [None, None, 2, 2]), (True, False, [2, 2, 4, 4]), (True, True, [2, 4, 4, None])])
def test_asof(spark, forward, strict, want):
    right = spark.createDataFrame([("a", 2, 2), ("a", 4, 4)], "series_id string, ts long, v long")
    left = spark.createDataFrame([("a", k) for k in (1, 2, 3, 4)], "series_id string, at long")
    assert column(asof(left, right, "at", ["v"], forward=forward, strict=strict), "v", "at") == want


def test_daily_vol_is_pandas(spark):
    idx = pd.date_range("2024-01-01", periods=60, freq="6h")
    px = 100 * np.exp(np.cumsum(np.random.default_rng(0).normal(0, 0.01, 60)))
    df = spark.createDataFrame([("a", t.to_pydatetime(), float(p)) for t, p in zip(idx, px, strict=True)], "series_id string, ts timestamp_ntz, price double")
    prev = idx.searchsorted(idx - pd.Timedelta(days=1)) - 1
    ret = pd.Series([px[k] / px[j] - 1 if j >= 0 else np.nan for k, j in enumerate(prev)], index=idx)
    want = ret.dropna().ewm(span=20).std().reindex(idx)
    got = column(labeling.get_daily_vol(df, 20), "daily_vol", "ts")
    assert [x if x is not None else np.nan for x in got] == pytest.approx(want.tolist(), nan_ok=True)


def test_stop_wins_a_tie_and_open_events_stay(spark):
    close = ticks(spark, [100, 103, 100, 97, 100])
    at = [r["ts"] for r in close.orderBy("seq").collect()]
    e = spark.createDataFrame([("a", at[0], 0.02, None), ("a", at[4], 0.02, None)], "series_id string, t0 timestamp_ntz, trgt double, vertical timestamp_ntz")
    got = labeling.get_events(close, e, 1, 1).orderBy("t0").collect()
    assert [(r["barrier"], r["t1"]) for r in got] == [("pt", at[1]), ("none", None)]


def test_time_decay_reaches_one(spark):
    u = spark.createDataFrame([("a", k, 1.0) for k in range(4)], "series_id string, t0 long, uniqueness double")
    assert column(weights.time_decay(u, 0.0), "decay", "t0") == [0.25, 0.5, 0.75, 1.0]
    assert column(weights.time_decay(u, -0.5), "decay", "t0") == [0.0, 0.0, 0.5, 1.0]


def test_sequential_draws_favour_the_unlike():
    s, e = np.array([0, 0, 5]), np.array([4, 4, 6])
    got = np.concatenate([weights.draw_sequential(s, e, np.random.default_rng(k).random(2)) for k in range(200)]).reshape(-1, 2)
    again = [(a, b) for a, b in got.tolist() if a < 2]
    assert sum(b == 2 for _, b in again) / len(again) > 0.4


def test_trials_do_not_depend_on_partitions(spark):
    one = montecarlo.bootstrap_uniqueness_mc(spark, n_iter=20).orderBy("trial").collect()
    two = montecarlo.run_trials(spark, montecarlo.bootstrap_uniqueness_trial, 20, 0, 7, n_obs=10, n_bars=100, max_h=5).orderBy("trial").collect()
    assert one == two and all(0 < r["std_u"] <= 1 and 0 < r["seq_u"] <= 1 for r in one)


def test_ffd_fills_and_keeps_nulls(spark):
    got = column(fracdiff.frac_diff_ffd(values(spark, [1, None, 3, 4]), 1.0), "fd")
    assert got == [None, None, 2.0, 1.0]
    assert fracdiff.get_weights(1, 3) == [1.0, -1.0, 0.0]


def test_frac_diff_order_one(spark):
    got = column(fracdiff.frac_diff(values(spark, [1, 2, 4, 8]), 1.0), "fd")
    assert got == [None, 1.0, 2.0, 4.0]


def test_cpcv_counts(spark):
    s = spark.range(20).select(F.lit("a").alias("series_id"), F.col("id").alias("pos"), F.least(F.col("id") + 1, F.lit(19)).alias("end_pos"))
    got = cv.combinatorial_purged_cv(s, 5, 2, 0.05)
    assert got.count() == 20 * 10 and cv.n_paths(5, 2) == 4
    assert got.filter("role = 'test'").groupBy("pos").count().filter("count <> 4").count() == 0
    with pytest.raises(ValueError, match="fewer"):
        cv.combinatorial_purged_cv(s, 5, 2, 0.05, min_train_size=19)
    bad = got.alias("t").join(got.join(s, ["series_id", "pos"]).alias("r"), "split_id").filter("t.role = 'test' AND r.role = 'train' AND r.pos <= t.pos AND r.end_pos >= t.pos").count()
    assert bad == 0


def test_known_statistics():
    assert stats.min_track_record_length(2 / 252**0.5, 1 / 252**0.5) > 100
    assert stats.expected_max_sharpe(1, 1.0) == 0.0
    assert stats.expected_max_sharpe(2, 1.0) == pytest.approx(0.5197553443, abs=1e-9)
    with pytest.raises(ValueError):
        stats.min_track_record_length(0.1, 0.2)


def test_bet_sizing_numbers(spark):
    w = bet_sizing.calibrate_sigmoid_width(10, 0.95)
    assert w == pytest.approx(10.8033, abs=1e-4)
    row = spark.range(1).select(bet_sizing.target_position(w, F.lit(115.0), F.lit(100.0), 100).alias("a"), bet_sizing.limit_price(F.lit(97), F.lit(0), F.lit(115.0), w, 100).alias("b"), bet_sizing.limit_price(F.lit(5), F.lit(5), F.lit(115.0), w, 100).alias("c"), bet_sizing.discretize_signal(F.lit(0.25), 0.1).alias("d")).first()
    assert row["a"] == 97 and row["b"] == pytest.approx(112.36573855883363) and row["c"] is None and row["d"] == pytest.approx(0.2)


def test_sharpe_of_flat_returns(spark):
    df = values(spark, [0, 0, 0], "ret", "z").unionByName(values(spark, [1, 1], "ret", "c"))
    assert stats.sharpe_ratio(df).orderBy("series_id").collect() == [("c", None), ("z", 0.0)]


def test_registry_round_trip(spark):
    r = stats.TrialRegistry()
    for k in range(3):
        r.record(f"t{k}", {"window": k, "flag": True, "x": None}, np.random.default_rng(k).normal(0.001, 0.01, 16))
    again = stats.TrialRegistry.from_json(r.to_json())
    assert again.to_df(spark).collect() == r.to_df(spark).collect()
    assert 0 <= r.pbo(spark, 4).first()["pbo"] <= 1 and 0 <= r.deflated_sharpe(spark).first()["dsr"] <= 1
    with pytest.raises(ValueError):
        r.record("t0", {}, [1.0])


def test_cscv_callable_is_the_default(spark):
    x = np.random.default_rng(3).normal(0, 1, (24, 4))
    df = spark.createDataFrame([(t, k, float(v)) for t, r in enumerate(x) for k, v in enumerate(r)], "t long, trial_id int, ret double")
    plain = stats.cscv(df, 4).orderBy("split_id").collect()
    called = stats.cscv(df, 4, lambda m: m.mean(axis=0) / m.std(axis=0, ddof=1)).orderBy("split_id").collect()
    assert [(r["best_trial"], r["rank"]) for r in plain] == [(r["best_trial"], r["rank"]) for r in called]


def test_failure_probability_of_a_mixture(spark):
    r = risk.mixture_returns(spark, 0.05, -0.1, 0.05, 0.1, 0.75, 2600, 0).withColumn("series_id", F.lit("a"))
    assert risk.probability_of_failure(r, 260, 2.0).first()["p_failure"] == pytest.approx(0.4829238935, abs=1e-6)


def test_ou(spark):
    assert risk.fit_ou(values(spark, [1, 2, 0], "price"), 0.0, "price").first()["phi"] == pytest.approx(0.4)
    x = risk.ou_exits(0.5, 0.0, 1.0, 0.0, 1.0, 1.0, 10, 1000, np.random.default_rng(0).standard_normal)
    assert len(x) == 1000 and np.isfinite(x).all()


def test_hrp_and_linkage():
    corr = np.array([[1, 0.7, 0.2], [0.7, 1, -0.2], [0.2, -0.2, 1]])
    link = portfolio.linkage(np.sqrt((1 - corr) / 2))
    assert link[0, :2].tolist() == [0, 1] and sorted(portfolio.quasi_diagonalize(link)) == [0, 1, 2]
    w = portfolio.hrp(corr)
    assert w.sum() == pytest.approx(1) and (w > 0).all()
    with pytest.raises(ValueError):
        portfolio.hrp(np.array([[1, 2], [2, 1.0]]))


def test_onc_finds_blocks():
    c = np.full((6, 6), 0.05)
    c[:3, :3] = c[3:, 3:] = 0.9
    np.fill_diagonal(c, 1)
    labels, s = portfolio.onc_labels(c, 4)
    assert len(set(labels[:3])) == len(set(labels[3:])) == 1 and labels[0] != labels[3] and s > 0.5


def ols_tau(y, lag, det):
    x, d = breaks._design(y, lag, det)
    b, *_ = np.linalg.lstsq(x, d, rcond=None)
    r = d - x @ b
    return b[0] / math.sqrt(r @ r / (len(d) - x.shape[1]) * np.linalg.inv(x.T @ x)[0, 0])


@pytest.mark.parametrize(("lag", "constant"), [(0, "nc"), (1, "c"), (2, "ct"), (1, "ctt")])
def test_window_statistics_are_regressions(lag, constant):
    y = np.cumsum(np.random.default_rng(1).normal(size=60)) + 10
    for e, t in breaks.window_taus(y, np.array([30, 59]), 20, lag, constant):
        for s in (0, 5, e - 19):
            assert t[s] == pytest.approx(ols_tau(y[s : e + 1], lag, breaks.DETERMINISTIC[constant]), rel=1e-6)


def test_cusum_exog_of_ones_is_the_default(spark):
    y = np.random.default_rng(2).normal(size=30)
    df = values(spark, y).withColumn("one", F.lit(1.0))
    a, b = breaks.cusum_test(df), breaks.cusum_test(df, exog=["one"])
    assert column(a, "statistic")[1:] == pytest.approx(column(b, "statistic")[1:])


def test_smt_is_a_regression(spark):
    y = np.cumsum(np.random.default_rng(4).normal(size=25)) + 50
    got = column(breaks.smt(values(spark, y), 10), "smt")
    best = 0
    for s in range(0, 25 - 10 + 1):
        t = np.arange(s, 25)
        x = np.column_stack([np.ones(len(t)), t - t.mean(), (t - t.mean()) ** 2])
        b, *_ = np.linalg.lstsq(x, y[s:], rcond=None)
        r = y[s:] - x @ b
        best = max(best, abs(b[2]) / math.sqrt(r @ r / (len(t) - 3) * np.linalg.inv(x.T @ x)[2, 2]))
    assert got[-1] == pytest.approx(best, rel=1e-6)


def test_lempel_ziv():
    assert entropy.lz_phrases(list("abababab")) == [("a",), ("b",), ("a", "b"), ("a", "b", "a")]


def test_kontoyiannis_by_hand():
    def length(m, i, n):
        k = 0
        while k < n and i + k + 1 <= len(m) and any(m[j : j + k + 1] == m[i : i + k + 1] for j in range(i - n, i)):
            k += 1
        return k + 1

    m = "0110100110010110"
    for window in (None, 3):
        centres = range(1, len(m) // 2 + 1) if window is None else range(window, len(m) - window + 1)
        want = np.mean([math.log2((window or i) + 1) / length(m, i, window or i) for i in centres])
        assert entropy.kontoyiannis(list(m), window) == pytest.approx(want)


def test_models(spark):
    rng = np.random.default_rng(0)
    X = rng.normal(size=(120, 3))
    y = (X[:, 0] > 0).astype(int)
    data = {"X": X, "y": y, "w": None}
    s = spark.range(120).select(F.lit("a").alias("series_id"), F.col("id").alias("pos"), F.col("id").alias("end_pos"))
    splits = cv.purged_kfold(s, 4)
    drop = {r["feature"]: r["mean"] for r in models.mda(spark, models.NearestCentroid, data, splits, ["a", "b", "c"]).collect()}
    assert drop["a"] > 0.2 and max(abs(drop["b"]), abs(drop["c"])) < 0.2
    alone = {r["feature"]: r["mean"] for r in models.sfi(spark, models.NearestCentroid, data, splits, ["a", "b", "c"]).collect()}
    assert alone["a"] > 0.9 > alone["b"]
    bag = models.SequentialBootstrapBagging(n_estimators=4, oob_score=True, seed=1).fit(spark, data, np.arange(120), np.minimum(np.arange(120) + 3, 119))
    assert bag.score(X, y) > 0.9 and bag.oob_score_ > 0.8
    assert models.grid_search(spark, lambda: models.NearestCentroid(), {}, data, splits).best_params == {}


def test_chunks():
    assert parallel.lin_parts(10, 3) == [0, 4, 7, 10]
    a, b = parallel.nested_parts(100, 4), parallel.nested_parts(100, 4, True)
    assert a[0] == b[0] == 0 and a[-1] == b[-1] == 100 and [100 - x for x in a[::-1]] == b


def test_vpin_of_one_sided_flow(spark):
    got = microstructure.vpin(ticks(spark, [1, 2, 3, 4, 5, 6], [10] * 6), 20, 2, sigma=1e-9).orderBy("bucket").collect()
    assert len(got) == 3 and got[0]["vpin"] is None and got[2]["vpin"] == pytest.approx(1.0)


def test_positions_number_from_zero(spark):
    assert column(with_pos(ticks(spark, [3, 1, 2])), "pos", "seq") == [0, 1, 2]


def test_track_record_column_is_the_scalar(spark):
    rows = [(0.2, 0.1, 0.3, 4.0), (0.5, 0.0, -0.2, 3.0), (0.1, 0.1, 0.0, 3.0)]
    got = [r[0] for r in spark.createDataFrame(rows, "sr double, low double, skew double, kurt double").select(stats.track_record("sr", "low", "skew", "kurt")).collect()]
    assert got[:2] == pytest.approx([stats.min_track_record_length(*r) for r in rows[:2]]) and got[2] is None


def test_long_convolution_is_the_direct_one():
    r = np.random.default_rng(0)
    y = 100 + np.cumsum(r.normal(size=3000))
    w = np.array(fracdiff.get_weights(0.4, 3000))
    assert np.allclose(fracdiff._convolved(y, w, direct=10), np.convolve(y, w)[:3000], rtol=0, atol=1e-9)


def test_scores_of_each_number_of_clusters_and_a_given_tree(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(200, 6))
    x[:, :3] += 2 * r.normal(size=(200, 1))
    corr, cov = np.corrcoef(x.T), np.cov(x.T)
    long = lambda m: spark.createDataFrame([(0, i, j, float(m[i, j])) for i in range(6) for j in range(6)], "matrix_id int, i int, j int, v double")
    scores = {r["k"]: r["silhouette"] for r in portfolio.onc_scores(long(corr), 4).collect()}
    labels, best = portfolio.onc_labels(corr, 4)
    assert sorted(scores) == [2, 3, 4] and max(scores.values()) == pytest.approx(best) and len(set(labels.tolist())) in scores
    other = np.corrcoef(r.normal(size=(6, 50)))
    got = [r["weight"] for r in portfolio.hrp_weights(long(cov), corr=long(other)).orderBy("i").collect()]
    assert got == pytest.approx(portfolio.hrp(cov, other)) and got != pytest.approx(portfolio.hrp(cov))


def test_permutations_are_those_of_one_stream(spark):
    """mda by hand: one generator, fold by fold, repeat by repeat, feature by feature."""
    r = np.random.default_rng(1)
    X = r.normal(size=(80, 2))
    y = (X[:, 0] > 0).astype(int)
    splits = cv.purged_kfold(spark.createDataFrame([("all", k, k) for k in range(80)], "series_id string, pos long, end_pos long"), 4)
    got = {r["feature"]: r["mean"] for r in models.mda(spark, models.NearestCentroid, {"X": X, "y": y}, splits, ["a", "b"], n_repeats=2, seed=5).collect()}
    rng, drops = np.random.default_rng(5), {0: [], 1: []}
    for k in range(4):
        test = np.arange(20 * k, 20 * k + 20)
        train = np.setdiff1d(np.arange(80), test)
        m = models.NearestCentroid().fit(X[train], y[train])
        base = models.accuracy(y[test], m.predict(X[test]))
        fold = {0: [], 1: []}
        for _ in range(2):
            for f in range(2):
                Z = X[test].copy()
                Z[:, f] = Z[rng.permutation(20), f]
                fold[f].append(base - models.accuracy(y[test], m.predict(Z)))
        for f in range(2):
            drops[f].append(np.mean(fold[f]))
    assert [got["a"], got["b"]] == pytest.approx([np.mean(drops[0]), np.mean(drops[1])])


def test_log_change_of_zero_and_negative_prices(spark):
    got = column(values(spark, [1, 0, 0, math.e, None, 1, -1, 1], "price").withColumn("x", microstructure.log_change("price", by_series(values(spark, [])))), "x")
    assert got[:2] == [None, -math.inf] and math.isnan(got[2]) and got[3:6] == [math.inf, None, None] and math.isnan(got[6]) and math.isnan(got[7])
