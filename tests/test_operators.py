import datetime as dt
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from fieldcast.operators import attach, clean, convergence as C, draws as D, keys, monitor, ordering, panel as P, ranking, reports


def day(n):
    return dt.date(2023, 3, n)


def dates_frame(spark, first, last):
    bounds = spark.createDataFrame([(day(first), day(last))], "a date, b date")
    return P.calendar(bounds, F.col("a"), F.col("b"))


def test_quantiles_equal_numpy_even_with_a_hot_group(spark):
    rng = np.random.default_rng(1)
    parts = [
        ("hot", rng.standard_normal(3000).round(2)),
        ("tail", np.exp(8 * rng.standard_normal(500))),
        ("narrow", 1e6 + 1e-3 * rng.standard_normal(400)),
        ("one", np.array([4.0])),
        ("same", np.full(50, -2.5)),
        (None, np.arange(11.0)),
    ]
    rows = [(k, float(v)) for k, values in parts for v in values] + [("hot", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    rows = ranking.exact_quantiles(df, ["k"], "v", D.INTERVAL).collect()
    got = {r.k: r for r in rows}
    assert len(rows) == len(parts)
    for key, values in parts:
        want = np.quantile(values, [0.025, 0.5, 0.975])
        assert np.allclose([got[key].lwr, got[key].fit, got[key].upr], want, rtol=1e-12), key
    whole = ranking.exact_quantiles(df, [], "v", {"m": 0.5}).first()["m"]
    assert whole == np.median(np.concatenate([v for _, v in parts]))


def test_quantiles_of_special_and_crowded_values(spark):
    """Infinities and NaN by the order of doubles; a crowd beside one outlier; equal results beside other groups."""
    inf, nan = float("inf"), float("nan")
    crowd = [1e6 + i / 7919 for i in range(3000)] + [1e12, -1e12]
    rows = [("i", v) for v in (1.0, 2.0, 3.0, inf)] + [("n", v) for v in (nan, 1.0, -inf)]
    rows += [("c", v) for v in crowd] + [("z", v) for v in (0.0, -0.0, 5e-324, -5e-324)]
    df = spark.createDataFrame(rows, "k string, v double")
    cuts = {"low": 0.0, "mid": 0.5, "q": 0.25, "high": 1.0}
    got = {r.k: r for r in ranking.exact_quantiles(df, ["k"], "v", cuts).collect()}
    assert (got["i"].low, got["i"].mid, got["i"].high) == (1.0, 2.5, inf)
    assert got["n"].low == -inf and got["n"].mid == 1.0 and np.isnan(got["n"].high)
    assert [got["c"][c] for c in cuts] == [np.quantile(crowd, p) for p in cuts.values()]
    assert (got["z"].low, got["z"].mid, got["z"].high) == (-5e-324, 0.0, 5e-324)
    ranks = {(r.k, r.v): r["rank"] for r in ranking.average_ranks(df, ["k"], "v").collect() if r.v == r.v}
    assert ranks["i", inf] == 4 and ranks["z", 0.0] == 2.5
    want = pd.Series(crowd).rank()
    assert all(ranks["c", v] == w for v, w in zip(crowd, want))


def test_average_ranks_with_ties(spark):
    values = [3.0, 1.0, 3.0, -2.0, 3.0, 0.0]
    df = spark.createDataFrame([("a", v) for v in values], "k string, v double")
    got = {r.v: r["rank"] for r in ranking.average_ranks(df, ["k"], "v").collect()}
    assert got == pd.Series(values).rank().set_axis(values).to_dict()


def test_quantile_plan_reads_its_input_once(spark, sf):
    from checks import draw_checks

    df = draw_checks.draw_quantiles(spark, sf)
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    # one scan at most: the other uses read the same exchange
    assert final.count("FileScan") <= 1 and "ReusedExchange" in final
    assert "Python" not in final


def test_simulation_runs_once_and_without_python(spark, sf):
    from checks import draw_checks

    for query in (draw_checks.forecast_lambda, draw_checks.state_lambda):
        plan = query(spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Filter (" not in plan


def test_panel_is_complete_and_zero_filled(spark):
    dates = dates_frame(spark, 1, 5)
    counts = spark.createDataFrame(
        [("x", day(2), 3), ("x", day(9), 1)], "series string, date date, em bigint"
    )
    base = spark.createDataFrame(
        [("x", dt.date(2023, 2, 1), 7), ("x", day(3), 2), ("y", day(1), 1)],
        "series string, date date, n bigint",
    )
    rows = P.daily_panel(dates, counts, base, ["x", "y", "z"]).collect()
    assert len(rows) == 15
    got = {(r.series, r.date.day): (r.em, r.mif_cum) for r in rows}
    assert got["x", 2] == (3, 0) and got["x", 5] == (0, 2)
    assert got["y", 5] == (0, 1) and got["z", 5] == (0, 0)
    carried = P.daily_panel(dates, counts, base, ["x", "y", "z"], carry_in=True).collect()
    assert {(r.series, r.date.day): r.mif_cum for r in carried}["x", 5] == 9
    full = {(r.series, r.date): r for r in P.full_panel(dates, counts, base, ["x", "y"]).collect()}
    assert full["x", dt.date(2023, 2, 1)].mif_cum == 9  # appended after the calendar
    assert full["x", day(9)].em == 1 and full["x", day(9)].part == 2


def test_routing_and_reshaping(spark):
    events = spark.createDataFrame(
        [("A1", "p", day(1)), ("A1", "q", day(1)), ("A2", "p", day(1)), (None, "p", day(1))],
        "attachment string, location string, d date",
    )
    routing = spark.createDataFrame(
        [("A1", "p", "F", 1), ("A2", "p", "F", 1)],
        "attachment string, location string, family string, ord int",
    )
    counts = P.routed_daily(events, routing, "attachment", "location", "d")
    assert [tuple(r) for r in counts.collect()] == [("F", day(1), 2)]
    wide = P.pivot_counts(counts, ["F", "G"])
    assert wide.columns == ["date", "EM_F", "EM_G"]
    assert sorted((r.series, r.em) for r in P.unpivot_counts(wide).collect()) == [("F", 2), ("G", 0)]


def test_series_arrays_and_observed_cells(spark):
    rows = [("x", day(3), 5, 4), ("x", day(1), 1, 2), ("x", day(2), 0, 2), ("z", day(1), 0, 0)]
    frame = spark.createDataFrame(rows, "series string, date date, em bigint, mif_cum bigint")
    got = {r.series: r for r in P.series_arrays(P.scale_by_max(frame, "mif_cum")).collect()}
    assert got["x"].y == [1, 0, 5] and got["x"].num == [0.5, 0.5, 1.0] and got["x"].t == 3
    assert got["z"].num == [0.0] and got["z"].n_max == 0.0
    cells = spark.createDataFrame([("a", [1, None, 3]), ("b", [None, 2, None])], "k string, y array<int>")
    seen = {r.k: r for r in P.observed_cells(cells, "k", "y").collect()}
    assert seen["a"].obs_no == [1, 3] and seen["b"].len_obs == 1 and seen["b"].total_obs == 3


def test_cleaning(spark):
    df = spark.createDataFrame([(1, None, None), (2, "b", None)], "a int, b string, c string")
    assert clean.drop_empty_columns(df).columns == ["a", "b"]
    assert clean.null_report(df, ["a", "b", "c"]).first().asDict() == {"a": 0, "b": 1, "c": 2}
    assert clean.drop_empty_columns(df.limit(0)).columns == []


def test_attachment_join_keeps_unmatched_and_null_keys(spark):
    events = spark.createDataFrame([("m1", 1), ("m1", 1), ("m2", 2), (None, 3)], "m string, e int")
    parts = spark.createDataFrame([("m1", "a"), ("m1", "b"), (None, "c")], "m string, p string")
    got = attach.attach_to_events(events, parts, "m", ["p"]).collect()
    assert sorted((r.m or "-", r.e, r.p or "-") for r in got) == [
        ("-", 3, "-"), ("m1", 1, "a"), ("m1", 1, "b"), ("m2", 2, "-"),
    ]
    safe = attach.attach_to_events(events, parts, "m", ["p"], null_safe=True).collect()
    assert ("c" in {r.p for r in safe}) and len(safe) == 4


def test_code_share(spark):
    rows = [("p", "a")] * 6 + [("p", "b")] * 2 + [("p", None)] * 2 + [("q", None)] * 5
    df = spark.createDataFrame(rows, "period string, code string")
    got = {(r.period, r.code): (r.n_code, r.n_period, r.share) for r in
           reports.code_share(df, F.col("period"), "code", 3).collect()}
    assert got == {("p", "a"): (6, 10, 0.6), ("p", "other"): (4, 10, 0.4), ("q", None): (5, 5, 1.0)}


def test_top_categories_break_ties_by_name(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("c",), (None,)], "x string")
    assert [r.x for r in reports.top_categories(df, "x", 2).collect()] == ["c", "a"]
    assert reports.nth_category(df, "x", 0) is None and reports.nth_category(df, "x", 1) == "c"


def test_breaches(spark):
    actuals = spark.createDataFrame(
        [("x", day(1), 0), ("x", day(2), 5), ("x", day(3), 9), ("x", day(4), 1)],
        "series string, date date, em bigint",
    )
    limits = spark.createDataFrame(
        [("x", day(n), 1.0, 3.0, 8.0) for n in (1, 2, 3)],
        "series string, date date, lwr double, fit double, upr double",
    )
    got = monitor.breaches(actuals, limits)
    assert sorted(r.date.day for r in got.collect()) == [1, 3]


def test_split_rhat_leaves_the_middle_out(spark):
    rows = [(c, i, float((c * 7 + i * 3) % 5)) for c in (1, 2) for i in range(9)]
    df = spark.createDataFrame(rows, "chain int, iteration int, value double")
    split = C.split_chains(df)
    assert split.where("iteration = 4").count() == 0
    halves = np.array([[r[2] for r in rows if r[0] == c and lo <= r[1] < hi]
                       for c in (1, 2) for lo, hi in ((0, 4), (5, 9))])
    w, b = halves.var(axis=1, ddof=1).mean(), halves.mean(axis=1).var(ddof=1)
    want = np.sqrt((3 / 4 * w + b) / w)
    got = C.rhat_split(split.withColumn("k", F.lit(1)), ["k"]).first()["rhat"]
    assert abs(got - want) < 1e-12


def test_samples_are_exact_and_clamped(spark):
    df = spark.range(30).select(F.col("id").cast("int").alias("draw"), F.lit(1.0).alias("value"))
    a = {r.draw for r in D.sample_draws(df, 7, 1).collect()}
    assert len(a) == 7 and a == {r.draw for r in D.sample_draws(df.repartition(5), 7, 1).collect()}
    assert D.sample_draws(df, 99, 1).count() == 30


def test_coefficients_mean_row_uses_all_draws(spark):
    rows = [(d, p, "t", float(d * p)) for d in range(10) for p in (1, 2)]
    coefs = spark.createDataFrame(rows, "draw int, part int, term string, value double")
    long = D.coef_long(coefs, 3, 1)
    mean = [r for r in long.collect() if r["mean"] == "mean"]
    assert long.count() == 4 and mean[0].probability == 4.5 and mean[0]["count"] == 9.0


def halves_of(chains):
    return [c[a:b] for c in chains for n in [len(c)] for a, b in ((0, n // 2), (n - n // 2, n))]


def numpy_ess(halves):
    """Initial monotone sequence over half chains of any length, straight from its definition."""
    n = np.array([len(h) for h in halves])
    w = np.mean([h.var(ddof=1) for h in halves])
    means = np.array([h.mean() for h in halves])
    plus = w * (n.mean() - 1) / n.mean() + (means.var(ddof=1) if len(halves) > 1 else 0.0)
    if not plus > 0:
        return None
    acov = lambda h, t: ((h - h.mean())[: len(h) - t] @ (h - h.mean())[t:]) / len(h) if t < len(h) else 0.0
    rho = lambda t: 1.0 if t == 0 else 1 - (w - np.mean([acov(h, t) for h in halves])) / plus
    total, low, k = 0.0, np.inf, 0
    while rho(2 * k) + rho(2 * k + 1) > 0 and 2 * k < n.min() - 5:
        low = min(low, rho(2 * k) + rho(2 * k + 1))
        total, k = total + low, k + 1
    last = rho(2 * k) if rho(2 * k) > 0 or rho(2 * k) + rho(2 * k + 1) >= 0 else 0.0
    return n.sum() / max(-1 + 2 * total + last, 1 / np.log10(n.sum()))


def test_effective_size_equals_numpy(spark):
    rng = np.random.default_rng(4)

    def walk(n, keep):
        x = np.zeros(n)
        for i in range(1, n):
            x[i] = keep * x[i - 1] + rng.standard_normal()
        return x.round(2)

    groups = {
        "slow": [walk(301, 0.97), walk(180, 0.97), walk(299, 0.9)],
        "fast": [walk(64, 0.1), walk(33, -0.4)],
        None: [walk(90, 0.5)],
        "same": [np.full(20, 3.0), np.full(20, 3.0)],
    }
    rows = [(k, c, 5 + i, float(v)) for k, chains in groups.items() for c, x in enumerate(chains) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "k string, chain int, iteration int, value double")
    normal = NormalDist()
    for lags, block in ((127, 4096), (3, 16)):  # the small ones need several passes over blocks
        found = C.Diagnostics(df, ["k"])
        got = {r["k"]: r for r in found.named(C.ess_columns(found.sizes(lags, block)), "ess_bulk", "ess_tail", "ess_mean").collect()}
        assert set(got) == set(groups)
        for k, chains in groups.items():
            parts = halves_of(chains)
            every = np.concatenate(parts)
            low, high = np.quantile(every, [0.05, 0.95])
            if k == "same":
                assert got[k].ess_bulk is None and got[k].ess_tail is None
                continue
            rank = lambda v: (every < v).sum() + ((every == v).sum() + 1) / 2
            score = {v: normal.inv_cdf((rank(v) - 0.375) / (len(every) + 0.25)) for v in set(every)}
            bulk = numpy_ess([np.array([score[v] for v in h]) for h in parts])
            tail = min(numpy_ess([(h <= cut).astype(float) for h in parts]) for cut in (low, high))
            want = (bulk, tail, numpy_ess(parts))
            assert np.allclose(want, (got[k].ess_bulk, got[k].ess_tail, got[k].ess_mean), rtol=1e-6), k
    summed = {r["k"]: r for r in C.summary(df, ["k"]).collect()}
    every = np.concatenate(groups["slow"])
    assert abs(summed["slow"].mad - 1.4826 * np.median(np.abs(every - np.median(every)))) < 1e-9
    assert abs(summed["slow"].mcse_mean - every.std(ddof=1) / np.sqrt(numpy_ess(halves_of(groups["slow"])))) < 1e-6
    assert summed["same"].rhat is None and summed["same"].sd == 0.0
    assert C.summary(df.where("false"), ["k"]).count() == 0


def test_one_range_sort_ranks_two_counts(spark):
    rng = np.random.default_rng(2)
    values = np.append(rng.integers(-50, 50, 400) / 4.0, [np.inf, -np.inf, np.nan, 0.0])
    rows = [(k, float(v), 1 + i % 3, i % 2) for k, size in (("hot", 404), (None, 7)) for i, v in enumerate(values[-size:])]
    df = spark.createDataFrame(rows, "k string, v double, n long, m long").repartition(3)
    counts = df.groupBy(ordering.key_struct(["k"]), "v").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    got = ordering.ordered(counts, "v", ["n", "m"]).collect()
    place = lambda v: (1, 0.0) if v != v else (0, v)
    for r in got:
        mine = [x for x in rows if x[0] == r["__k"].k]
        for c, at in (("n", 2), ("m", 3)):
            assert r[f"{c}_size"] == sum(x[at] for x in mine)
            assert r[f"{c}_before"] == sum(x[at] for x in mine if place(x[1]) < place(r.v))
    assert len(got) == len({(k, place(v)) for k, v, _, _ in rows})


def test_diagnostics_read_few_tables(spark):
    df = spark.range(400).selectExpr("id % 3 AS k", "CAST(id % 4 AS INT) AS chain", "id AS iteration", "rand(1) AS value")
    for plan in (C.rhat_rank(df, ["k"]), C.summary(df, ["k"])):
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert text.count("FileScan") + text.count("Range (") <= 4


def test_a_heavy_machine_is_joined_in_pieces(spark):
    """One machine owns half of the events: without adaptive execution no task gets more than its share."""
    hot = F.when(F.col("id") % 2 == 0, F.lit("hot")).otherwise(F.concat(F.lit("m"), F.col("id") % 997))
    key = F.when(F.col("id") % 101 != 0, hot)
    events = spark.range(20_000).select(key.alias("k"), F.col("id").alias("event"))
    attachments = spark.createDataFrame(
        [("hot", "a"), ("hot", "b"), (None, "z"), *[(f"m{i}", "c") for i in range(0, 997, 2)]], "k string, name string")
    plain = events.distinct().join(attachments, "k", "left")
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1",
                "spark.sql.shuffle.partitions": "64"}
    before = {c: spark.conf.get(c) for c in settings}
    for c, v in settings.items():
        spark.conf.set(c, v)
    try:
        joined = attach.attach_to_events(events, attachments, "k", ["name"])
        rows = [tuple(r) for r in joined.select("k", "event", "name", F.spark_partition_id()).collect()]
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    order = lambda found: sorted(found, key=str)
    assert order(r[:3] for r in rows) == order(tuple(r) for r in plain.select("k", "event", "name").collect())
    of_hot = [r[3] for r in rows if r[0] == "hot"]
    assert len(of_hot) > 19_000 and max(of_hot.count(p) for p in set(of_hot)) < len(of_hot) / 8
    assert keys.heavy_keys(events.where("k <> 'hot'"), ["k"]) is None


def test_first_by_declared_order_and_maxima(spark):
    rows = [("a", None, 5, 1.0), ("a", 2, 9, None), ("a", 2, 3, 7.0), (None, 1, 1, 0.5), ("b", None, 4, None)]
    df = spark.createDataFrame(rows, "k string, ord int, then int, v double")
    got = {tuple(r) for r in clean.keep_first(df, ["k"], ["ord", "then"]).collect()}
    assert got == {("a", 2, 3, 7.0), (None, 1, 1, 0.5), ("b", None, 4, None)}
    top = {(r.k, r["name"]): r.maximum for r in clean.column_maxima(df, ["k"]).collect()}
    assert top["a", "ord"] == 2 and top["a", "then"] == 9 and top["a", "v"] == 7.0 and top["b", "v"] is None
