import datetime as dt
import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldcast import schemas as S
from fieldcast.operators import compact, monitor, simulate, states, zip_regression as Z
from fieldcast.plans import category, forecast as plan, ingest, many, regression
from fieldcast.sources.constants import constant_table
from fieldcast.streaming import monitor as stream

EVENT = {
    "機種略号": "AB", "機番": "1001", "機種ｺｰﾄﾞ": "c", "訪問区分": "v", "年月度": "202304",
    "製造年月": "202302", "納入日": "20230131", "稼動月": "3", "保守実施日": "20230302",
    "CE作業時間": "1.5", "ｺｰﾙ": "1", "EM": "1", "現象": "jam", "現象SC名称": "J01",
    "処置場所": "ADF部", "初回訪問区分": "T", "ｵﾌﾟｼｮﾝ機種略号": None, "ｵﾌﾟｼｮﾝ機番": None,
    "...17": "x", "顧客都道府県名": "p", "顧客住所": "q",
}


def text_frame(spark, rows):
    names = list(rows[0])
    return spark.createDataFrame(
        [tuple(r.get(n) for n in names) for r in rows], ", ".join(f"`{n}` string" for n in names)
    )


def sources(spark, events):
    attachments = [
        {"機種略号": "AB", "機番": "1001", "デバイスコード": "D1  "},
        {"機種略号": "AB", "機番": "1001", "デバイスコード": "D1"},
        {"機種略号": "AB", "機番": "1002", "デバイスコード": "D2\t"},
        {"機種略号": "AB", "機番": "1002", "デバイスコード": "??"},
    ]
    master = [
        {"周辺機機種略": "D1", "周辺機開発名": "COOK-D", "周辺機分類": "ADF"},
        {"周辺機機種略": "D2", "周辺機開発名": "VOLGA-H(中綴じ有)", "周辺機分類": "フィニッシャー"},
    ]
    standard = [{"本体機種略": "AB", "機番頭文字": "1", "ADF": "CATHERINE", "空": None}]
    machines = [
        {"機種略号コード": "AB", "機器番号": n, "顧客名": "c", "納品年月日": "20230131",
         "製造年月": "202302", "納入月": "202301", "リンク日": None, "最新訪問日": None}
        for n in ("1001", "1002")
    ]
    return ingest.Sources(
        *[text_frame(spark, rows) for rows in (events, attachments, machines, master, standard)]
    )


def test_ingest(spark):
    raw = [
        EVENT,
        EVENT,
        EVENT | {"機番": "1002", "EM": "0"},
        EVENT | {"機番": "1003", "稼動月": None},
        EVENT | {"機番": "1004", "保守実施日": "20239999"},
        EVENT | {"機番": "1005", "保守実施日": "20230101"},
    ]
    events, machines = ingest.build_events(sources(spark, raw))
    rows = {(r.Machine_numbers, r.Peripheral_name): r for r in events.collect()}
    assert set(rows) == {
        ("AB1001", "COOK-D"), ("AB1002", "VOLGA-H(中綴じ有)"), ("AB1002", None), ("AB1004", None), ("AB1005", None),
    }
    # a malformed date isn't a missing one: the row stays and is counted
    assert rows["AB1004", None].Maintenance_date is None
    assert ingest.unparsed(text_frame(spark, raw)).first()["保守実施日"] == 1
    first = rows["AB1001", "COOK-D"]
    assert first.Maintenance_date == dt.date(2023, 3, 2)
    assert first.Maintenance_month == dt.date(2023, 3, 1)
    # 31 Jan + 1 month overflows to 3 Mar, which is after 2 Mar
    assert first.Working_months == 0 and first.Elapsed_mf_months == 2
    assert rows["AB1005", None].Working_months == -1
    assert set(S.CLEAN_EVENTS.fieldNames()) == set(events.columns)
    only_em, _ = ingest.build_events(sources(spark, raw), mode="EM")
    assert only_em.where("EM <> 1").count() == 0 and only_em.count() == 3
    named = {(r["機種略機番"], r["周辺機名"]) for r in machines.collect()}
    assert named == {("AB1001", "CATHERINE"), ("AB1002", "VOLGA-H(中綴じ有)"), ("AB1002", None)}
    assert machines.first()["納品年月日"] == dt.date(2023, 1, 31)


def test_ingest_by_period(spark):
    events = text_frame(spark, [EVENT | {"period": "2304"}, EVENT | {"period": "2305", "稼動月": None}])
    attachments = text_frame(
        spark, [{"period": "2304", "機種略機番": "AB1001", "周辺機名": "COOK-D"}]
    )
    machines = text_frame(spark, [{"period": "2304", "納品年月日": "20230131"}])
    cleaned, parsed = ingest.build_events_by_period(events, attachments, machines)
    got = {(r.period, r.Machine_numbers, r.Model_abbreviation, r.Peripheral_name) for r in cleaned.collect()}
    assert got == {("2304", "AB1001", "AB", "COOK-D"), ("2305", "AB1001", "AB", None)}
    assert {"Prefectures", "Customer_address", "Peripheral_machine"} <= set(cleaned.columns)
    assert parsed.first()["納品年月日"] == dt.date(2023, 1, 31)


def test_period_keys_are_not_invented(spark):
    events = text_frame(spark, [
        EVENT | {"period": "2304", "機種略号": None, "機番": "123"},
        EVENT | {"period": "2304", "機種略号": "A|B"},
        EVENT | {"period": "2304", "保守実施日": "20239999"},
    ])
    attachments = text_frame(spark, [
        {"period": "2304", "機種略機番": "A|B1001", "周辺機名": "COOK-D"},
        {"period": "2305", "機種略機番": "AB1001", "周辺機名": "COOK-D"},
    ])
    cleaned, _ = ingest.build_events_by_period(events, attachments, text_frame(spark, [{"period": "2304"}]))
    got = {(r.Model_abbreviation, r.Machine_numbers, r.Peripheral_name, r.Maintenance_date is None)
           for r in cleaned.collect()}
    assert got == {
        (None, None, None, False), ("A|B", "A|B1001", "COOK-D", False), ("AB", "AB1001", None, True),
    }


def synthetic_events(spark, attachments, locations, first, days, per_day):
    rows = [
        (a, loc, first + dt.timedelta(days=d))
        for a, loc in zip(attachments, locations) for d in range(days)
        for _ in range((d * 7 + len(a)) % per_day)
    ]
    return spark.createDataFrame(
        rows, "Peripheral_name string, Treatment_location string, Maintenance_date date"
    )


def compact_draws(spark, lengths, draws=6):
    """Draws of given states: one row per draw and series with arrays of the series' length."""
    rng = np.random.default_rng(7)
    rows = [
        (1, d, d, k, *np.abs(0.2 * rng.standard_normal(6)).tolist(),
         *[(0.3 * rng.standard_normal(n)).tolist() for _ in range(4)], rng.uniform(0, 1.5, n).tolist(), [0.5] * n)
        for k, n in lengths.items() for d in range(draws)
    ]
    arrays = ", ".join(f"{c} array<double>" for c in ("mu", "b_ope", "gamma", "r", "lambda", "num"))
    scalars = ", ".join(f"{c} double" for c in compact.SCALAR_NAMES)
    return spark.createDataFrame(rows, f"chain int, iteration int, draw int, series string, {scalars}, {arrays}")


def test_compact_draws_in_long_form(spark):
    draws = compact_draws(spark, {"a": 9, "b": 12}, 3)
    assert compact.long_draws(draws, ["series"]).count() == 3 * (2 * 6 + 5 * (9 + 12))


def test_forecast_end_to_end(spark):
    first_a, first_b = dt.date(2023, 1, 1), dt.date(2023, 2, 1)
    fin = S.FINISHER_LOCATIONS[0]
    events_a = synthetic_events(
        spark, [a for a, _, _ in S.PREDECESSOR_FEEDERS + S.PREDECESSOR_FINISHERS],
        ["ADF部", "ADF部", fin, fin], first_a, 60, 4)
    events_b = synthetic_events(
        spark, ["COOK-D", "CATHERINE", "VOLGA-H(中綴じ無)", "AMUR-D HY"],
        ["ADF部", "ADF部", fin, fin], first_b, 40, 5)
    machines_a = spark.createDataFrame(
        [(str(i), "COOK-C" if i % 2 else "SINAI-H", "VOLGA-E" if i % 3 else "AMUR-C中綴じ",
          first_a + dt.timedelta(days=i % 50)) for i in range(200)], S.CLEAN_MACHINES_A)
    machines_b = spark.createDataFrame(
        [(str(i), c, n, first_b + dt.timedelta(days=i % 30)) for i in range(100)
         for c, n in (("ADF", "COOK-D"), ("ADF", "CATHERINE"), ("フィニッシャー", "VOLGA-H(中綴じ有)"),
                      ("フィニッシャー", "AMUR-D HY"), ("その他", "COOK-D"))], S.CLEAN_MACHINES_B)
    panel_a = plan.predecessor_panel(events_a, machines_a, "2023-01-01", "2023-03-01")
    panel_b = plan.successor_panel(events_b, machines_b)
    assert panel_a.count() == 4 * 60
    last = panel_b.where("date = '2023-03-12'").collect()
    assert {r.series: r.mif_cum for r in last} == {s: 100 for s in S.SUCCESSOR_SERIES}
    gains = constant_table(spark, [(s, 3.0) for s in S.SUCCESSOR_SERIES], "series string, gain double")
    inputs_a = plan.model_input(panel_a, "2023-01-01")
    draws_a = compact_draws(spark, {r.series: r.t for r in inputs_a.collect()})
    draws_b = compact_draws(spark, {s: 40 for s in S.SUCCESSOR_SERIES})
    out = plan.forecast(panel_b, S.series_map(spark), gains, "2023-02-01", (draws_a, draws_b), steps=5)
    rows = out.collect()
    future = [r for r in rows if r.is_future]
    assert len(future) == 20 and len(rows) == 4 * (40 + 5)
    assert min(r.date for r in future) == dt.date(2023, 3, 13)
    assert all(0 <= r.lwr <= r.fit <= r.upr for r in rows)


def test_first_order_horizon(spark):
    params = compact.horizon_parameters(compact_draws(spark, {"s": 40}))
    quiet = params.withColumns({c: F.lit(0.0) for c in ("s_z", "s_s", "s_r", "s_t")})
    path = simulate.explode_path(simulate.horizon(quiet, 2, F.lit(0.0), variant="ar1"))
    joined = path.where("step = 1").join(params, ["draw", "series"])
    worst = joined.select(F.max(F.abs(F.col("mu") - (F.col("intercept") + F.col("b_ar") * F.col("mu_last"))))).first()[0]
    assert worst < 1e-12


def test_category_report(spark):
    first = dt.date(2023, 1, 1)
    rows = [
        (None if i % 5 else "COOK-C", "jam" if i % 3 else "noise", first + dt.timedelta(days=i % 40))
        for i in range(400)
    ]
    events = spark.createDataFrame(rows, "Peripheral_name string, Phenomenon string, Maintenance_date date")
    machines = spark.createDataFrame(
        [(str(i // 2), first + dt.timedelta(days=(i // 2) % 30)) for i in range(120)],
        "`機種機番` string, `納品年月日` date",
    )
    bounds = [F.lit(d).cast("date") for d in ("2023-01-01", "2023-02-09")]
    panel = category.category_panel(events, machines, 1, *bounds)
    got = panel.agg(F.max("mif_cum"), F.sum("em"), F.count(F.lit(1)), F.max("series")).first()
    want = sum(1 for a, p, _ in rows if a is None and p == "jam")
    assert tuple(got) == (60, want, 40, "jam")
    given = compact_draws(spark, {"jam": 40})
    report = category.category_report(panel, given, "2023-01-01", "2023-02-09", 2.0, 3).collect()
    assert len(report) == 13 * 43 + (43 - 31)
    assert {r.component for r in report if r.date == dt.date(2023, 1, 5)} == set(states.COMPONENTS) - {
        "delta_exp"} | {"y_pred"}
    future = [r for r in report if r.is_future]
    assert len(future) == 14 * 3 and all(r.em is None for r in future)
    whole = category.category_panel(events, machines, 0, *bounds)
    assert whole.agg(F.sum("em")).first()[0] == sum(1 for a, _, _ in rows if a is None)


def test_failure_code_share(spark):
    df = spark.createDataFrame(
        [("ADF部", "COOK-C", 3, "J1")] * 12 + [("ADF部", "COOK-C", 3, "J2"), ("x", "COOK-C", 3, "J1")],
        "Treatment_location string, Peripheral_name string, Working_month int, SC_name string",
    )
    got = category.failure_code_share(df, ["ADF部"], "COOK-C").collect()
    assert {(r.Working_month, r.code, r.n_code, r.n_period) for r in got} == {
        (3, "J1", 12, 13), (3, "other", 1, 13)}


def test_many_series(spark):
    draws = compact_draws(spark, {"a": 27, "b": 27}).withColumnRenamed("series", "k")
    rows = many.many_report(draws, "k", F.lit("2021-01-01").cast("date")).collect()
    assert len(rows) == 2 * 2 * 27
    assert max(r.date for r in rows) == dt.date(2023, 3, 1)


def test_zip_recovers_coefficients_and_never_descends(spark):
    rng = np.random.default_rng(2)
    n = 6000
    x = rng.uniform(0, 10, n)
    g = rng.integers(0, 2, n)
    p = 1 / (1 + np.exp(-(0.5 + 1.0 * g)))
    y = np.where(rng.uniform(size=n) < p, rng.poisson(np.exp(0.3 + 0.12 * x)), 0)
    df = spark.createDataFrame(
        [(i, float(a), int(b), int(c), 5.0) for i, (a, b, c) in enumerate(zip(x, g, y))],
        "id int, x double, g int, y int, flat double",
    )
    model = Z.fit(df, "y", ["x", "g"], "id", replicates=3)
    history = model.log_likelihood
    assert all(b >= a for a, b in zip(history, history[1:])) and len(history) < 20
    prob, count = model.coefficients[0]
    assert abs(prob[0] - 0.5) < 0.25 and abs(prob[2] - 1.0) < 0.25
    assert abs(count[0] - 0.3) < 0.1 and abs(count[1] / model.scales["x"] - 0.12) < 0.02
    # a constant predictor is confounded with the intercept and does no harm
    assert np.isfinite(Z.fit(df, "y", ["x", "flat"], "id").coefficients[0]).all()
    report = regression.zip_report(df, "y", ["x", "g"], "id", 5, n_draws=2, n_entities=3)
    assert report["entities"].count() == 3 * 3
    assert report["coefficients"].count() == 3 * 3
    assert [r.term for r in report["summary"].orderBy("term_ord", "type").collect()][::2] == [
        "intercept", "x", "g"]


def test_zip_sums_of_a_block(monkeypatch):
    """Equal the plain formulas; replicates at the same coefficients share all but the weights."""
    rng = np.random.default_rng(4)
    n = 500
    x = np.column_stack([np.ones(n), rng.uniform(0, 1, n), rng.integers(0, 2, n)])
    y, seeds = rng.poisson(0.7, n).astype(float), rng.integers(-(2**62), 2**62, n)
    lf = np.array([np.log(float(np.prod(np.arange(1, v + 1)))) for v in y.astype(int)])
    coefs = np.array([[0.7, -0.2, 0.4], [0.1, 0.3, -0.5]])
    p, rate = 1 / (1 + np.exp(-x @ coefs[0])), np.exp(x @ coefs[1])
    miss, seen = np.exp(-rate), y > 0
    zero = 1 - p + p * miss
    value = np.where(seen, np.log(p) + y * np.log(rate) - rate - lf, np.log(zero))
    z1, z2 = -p * (1 - p) * (1 - miss) / zero, -p * rate * miss / zero
    s1, s2 = np.where(seen, 1 - p, z1), np.where(seen, y - rate, z2)
    h11 = np.where(seen, -p * (1 - p), z1 * (1 - 2 * p) - z1 * z1)
    h12 = np.where(seen, 0, -p * (1 - p) * rate * miss / zero - z1 * z2)
    h22 = np.where(seen, -rate, z2 * (1 - rate) - z2 * z2)
    calls, real = [], Z.Block.parts
    monkeypatch.setattr(Z.Block, "parts", lambda self, c: calls.append(1) or real(self, c))
    block = Z.Block(y, lf, x, seeds)
    together = block.sums(coefs, [0, 1, 2, 3])
    assert len(calls) == 1
    for r in range(4):
        w = Z.bootstrap_weights(seeds, r)
        info = [((x * (w * h)[:, None]).T @ x).ravel() for h in (h11, h12, h22)]
        want = np.concatenate([[w @ value], (w * s1) @ x, (w * s2) @ x, *info])
        assert np.allclose(together[r], want, rtol=1e-10) and np.allclose(block.sums(coefs, [r])[r], want, rtol=1e-10)


def test_bootstrap_weights_by_cells():
    """The weights are those that a search for the uniform number among the ends gives."""
    seeds = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 300_000)
    h = seeds.astype(np.uint64) + np.array([7], np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    u = ((h ^ (h >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2.0**53
    mass = np.exp(-1.0) / np.cumprod(np.maximum(np.arange(18), 1))
    assert (Z.bootstrap_weights(seeds, 7) == np.searchsorted(np.cumsum(mass), u)).all()


def test_bootstrap_weights_are_poisson():
    w = Z.bootstrap_weights(np.arange(200000, dtype=np.int64) * 7919 - 5, 3)
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.03


def feed(tmp_path, parts):
    """JSON files of (id, series, ts), read one a trigger in the order of their times."""
    folder = tmp_path / "in"
    folder.mkdir()
    for n, rows in enumerate(parts):
        file = folder / f"{n}.json"
        file.write_text("\n".join(json.dumps({"id": i, "series": s, "ts": str(t)}) for i, s, t in rows))
        os.utime(file, (1_700_000_000 + n, 1_700_000_000 + n))
    return folder, "id int, series string, ts timestamp"


@pytest.mark.parametrize("zone", ["UTC", "Asia/Tokyo"])
def test_streaming_equals_the_zero_filled_batch(spark, tmp_path, zone):
    """A feed with empty days, a series without events, duplicates, events out of order and events too late."""
    first = dt.datetime(2023, 3, 1)
    at = lambda day, hour: first + dt.timedelta(days=day, hours=hour)
    parts = [
        [(i, "xy"[i % 2], at(i // 4, 3 + i % 4 * 5)) for i in range(8)],  # days 0 and 1
        [(6, "x", at(1, 13)), (6, "x", at(1, 13)), (20, "x", at(4, 1)), (21, "y", at(2, 23))],  # 2 and 3 nearly empty
        [(22, "x", at(9, 12)), (23, "y", at(4, 0)), (24, "y", at(4, 0)), (20, "x", at(4, 1))],  # out of order, not late
        [(25, "x", at(15, 1)), (6, "y", at(9, 7))],  # key 6 on another day
        [(27, "y", at(20, 0)), (26, "y", at(2, 5))],  # day 2 was emitted before
    ]
    zone_before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        folder, schema = feed(tmp_path, parts)
        rows = [(s, (first + dt.timedelta(days=d)).date(), 1.0, 1.0, 1.0) for s in "xyz" for d in range(16)]
        limits = spark.createDataFrame(rows, stream.FORECAST)
        limits.write.parquet(str(tmp_path / "limits"))
        events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))
        expected = stream.expected_days(spark, str(tmp_path / "limits"))
        counts = stream.daily_counts(events, ["id"], "ts", "series", expected)
        pick = ["series", "date", "em"]
        for name, rows in (("all", counts), ("out", stream.breaches(counts, limits).select(*pick))):
            query = stream.start(rows, str(tmp_path / name), str(tmp_path / f"ck-{name}"))
            query.awaitTermination(300)
            assert query.exception() is None
        late = F.col("id") != 26
        batch = spark.read.schema(schema).json(str(folder)).where(late).withColumn("date", F.to_date("ts"))
        batch = batch.dropDuplicates(["id", "date"]).groupBy("series", "date").agg(F.count(F.lit(1)).alias("em"))
        filled = limits.select("series", "date").join(batch, ["series", "date"], "left").na.fill(0, ["em"])
        closed = first.date() + dt.timedelta(days=15)  # the newest event is on day 20
        take = lambda df: sorted(tuple(r) for r in df.where(F.col("date") <= closed).select(*pick).collect())
        got, want = take(spark.read.parquet(str(tmp_path / "all"))), take(filled)
        assert got == want and len(got) == 48 and sum(em == 0 for _, _, em in got) > 30
        breaches = take(spark.read.parquet(str(tmp_path / "out")))
        assert breaches == take(monitor.breaches(filled, limits)) and ("z", first.date(), 0) in breaches
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone_before)
