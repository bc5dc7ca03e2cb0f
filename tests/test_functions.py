import datetime as dt
import math
import random

import numpy as np
from pyspark.sql import functions as F

from fieldcast.functions import dates as D, noise as N, recursions as rec, text as X


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def brute_span(a, b):
    """Elements of a monthly sequence that keeps the day and lets it overflow."""
    if b < a:
        return -1
    count, k = 0, 0
    while True:
        m = a.month - 1 + k
        element = dt.date(a.year + m // 12, m % 12 + 1, 1) + dt.timedelta(days=a.day - 1)
        if (a.year + m // 12, m % 12 + 1) > (b.year, b.month):
            return count - 1
        count += element <= b
        k += 1


def test_month_span_equals_brute_force(spark):
    rng = random.Random(7)
    days = [dt.date(2019, 1, 1) + dt.timedelta(days=rng.randrange(1500)) for _ in range(4000)]
    pairs = list(zip(days[::2], days[1::2])) + [
        (dt.date(2020, 1, 31), dt.date(2020, 3, 1)),
        (dt.date(2020, 1, 31), dt.date(2020, 3, 2)),
        (dt.date(2021, 1, 31), dt.date(2021, 2, 28)),
        (dt.date(2021, 5, 31), dt.date(2021, 5, 31)),
    ]
    rows = spark.createDataFrame(pairs, "a date, b date").select(
        "a", "b", D.month_span(F.col("a"), F.col("b")).alias("n")
    )
    for r in rows.collect():
        assert r.n == brute_span(r.a, r.b), r


def test_compact_dates(spark):
    texts = [("20230315",), ("202303",), ("20231399",), ("x",), (None,)]
    got = spark.createDataFrame(texts, "c string").select(D.parse_compact_date(F.col("c"))).collect()
    assert [r[0] for r in got] == [dt.date(2023, 3, 15), dt.date(2023, 3, 1), None, None, None]


def test_text_rules(spark):
    df = spark.createDataFrame(
        [("T", "a", "1x"), ("true", None, "x1"), ("f", "b", None), (None, "c", "9")],
        "flag string, part string, serial string",
    )
    rows = df.select(
        X.to_boolean(F.col("flag")).alias("flag"),
        X.composite_key(F.lit("k"), F.col("part")).alias("key"),
        X.composite_key(F.lit("k"), F.col("part"), null_text="NA").alias("key_na"),
        X.first_digit(F.col("serial")).alias("digit"),
        X.contains_token(F.lit("AMUR-D HY"), "amur-d").alias("token"),
        X.strip_blanks(F.lit(" a\tb ")).alias("stripped"),
    ).collect()
    assert [r.flag for r in rows] == [True, True, None, None]
    assert [r.key for r in rows] == ["ka", None, "kb", "kc"]
    assert rows[1].key_na == "kNA"
    assert [r.digit for r in rows] == [1.0, None, None, 9.0]
    assert rows[0].token and rows[0].stripped == "ab"


def test_indexed_names(spark):
    names = spark.createDataFrame([("mu[3]",), ("y_pred[2,15]",), ("lp",)], "n string")
    v, i1, i2 = X.parse_indexed(F.col("n"))
    got = [tuple(r) for r in names.select(v, i1, i2).collect()]
    assert got == [("mu", 3, None), ("y_pred", 2, 15), ("lp", None, None)]
    assert one(spark, X.rounded_label(F.lit(0.125), 2)) == 0.12


def test_noise_is_reproducible_and_normal(spark):
    ids = spark.range(20000).select("id", N.normal(5, F.col("id")).alias("z"))
    moments = ids.agg(F.avg("z"), F.stddev("z")).first()
    assert abs(moments[0]) < 0.03 and abs(moments[1] - 1) < 0.03
    other = ids.repartition(7).orderBy("id").limit(50).collect()
    assert other == ids.orderBy("id").limit(50).collect()


def test_normal_quantile(spark):
    assert abs(one(spark, N.normal_quantile(F.lit(0.975))) - 1.959963985) < 1e-7
    assert abs(one(spark, N.normal_quantile(F.lit(0.001))) + 3.090232306) < 1e-7


def test_poisson_inverts_the_distribution(spark):
    for rate in (0.3, 4.0, 60.0):
        for u in (0.001, 0.37, 0.5, 0.93, 0.9999):
            cum, p, k = math.exp(-rate), math.exp(-rate), 0
            while cum < u:
                k += 1
                p *= rate / k
                cum += p
            assert one(spark, N.poisson_from_uniform(F.lit(rate), F.lit(u))) == k


def test_poisson_of_any_rate_has_its_distribution(spark):
    """Deciles of the distribution function against uniforms; nulls where there is no count."""
    rates, n = (0.1, 9.99, 10.0, 37.5, 1e3, 1e6, 1e8, 3e13), 20_000
    draws = spark.range(n).select(
        *[N.poisson(F.lit(r), 7, F.col("id")).alias(f"y{i}") for i, r in enumerate(rates)]
    ).toPandas()
    for i, rate in enumerate(rates):
        y = draws[f"y{i}"].to_numpy(float)
        assert abs(y.mean() - rate) < 4.5 * math.sqrt(rate / n)
        # the variance of a sample variance: (mu4 - var^2) / n, with mu4 = rate + 3 rate^2
        assert abs(y.var() - rate) < 4.5 * math.sqrt((rate + 2 * rate * rate) / n)
        if rate < 1e7:  # chi-square over single counts or slices of counts near the centre
            width = max(1, int(math.sqrt(rate) / 4))
            low = max(0, int(rate - 4 * math.sqrt(rate)))
            edges = np.arange(low, low + 33 * width, width)
            seen = np.histogram(y, np.append(edges, edges[-1] + width))[0][:-1]
            k = np.arange(edges[0], edges[-1])
            logs = k * math.log(rate) - rate - np.array([math.lgamma(x + 1) for x in k])
            share = np.add.reduceat(np.exp(logs), np.arange(0, len(k), width))
            use = share * n > 5
            chi = np.sum((seen[: len(share)] - n * share)[use] ** 2 / (n * share)[use])
            assert chi < use.sum() + 5 * math.sqrt(2 * use.sum()), rate
        elif rate == 1e8:
            z = np.sort((y - rate) / math.sqrt(rate))
            normal = np.array([0.5 * math.erfc(-x / math.sqrt(2)) for x in z])
            assert np.abs(normal - (np.arange(n) + 0.5) / n).max() < 2.2 / math.sqrt(n)
    edge = spark.range(1).select(
        *[N.poisson(F.lit(x), 7, F.col("id")).alias(c) for c, x in (("inf", math.inf), ("nan", math.nan), ("zero", 0.0), ("huge", 1e19))]
    ).first()
    assert edge["inf"] is None and edge["nan"] is None and edge["huge"] is None and edge["zero"] == 0


def test_log_mass_keeps_its_digits(spark):
    for count, rate in ((0, 10.0), (3, 12.0), (20, 15.0), (21, 15.0), (1000, 900.0), (10**8 + 12345, 1e8)):
        want = count * math.log(rate) - rate - math.lgamma(count + 1)
        got = one(spark, N.poisson_log_mass(F.lit(float(count)), F.lit(rate)))
        assert abs(got - want) < max(1e-9, 1e-15 * count * math.log(rate))


def test_recursions_across_blocks(spark):
    rng = np.random.default_rng(3)
    for length in (8, 31, 32, 33, 100):
        e = rng.standard_normal(length)
        column = F.array(*[F.lit(float(v)) for v in e])
        c, b, s = 0.1, 0.6, 0.5
        mu = []
        for t in range(length):
            pull = 0 if t == 0 else mu[0] if t == 1 else 2 * mu[t - 1] - mu[t - 2]
            mu.append(c + b * pull + s * e[t])
        got = one(spark, rec.level_second_order(column, F.lit(c), F.lit(b), F.lit(s)))
        assert np.allclose(got, mu)
        first = [c + b * e[0]]
        for t in range(1, length):
            first.append(c + b * first[-1] + s * e[t])
        got = one(spark, rec.level_first_order(column, F.lit(c), F.lit(b), F.lit(s)))
        assert np.allclose(got, first)
        g = list(s * e[:6])
        for t in range(length):
            g.append(-sum(g[-6:]) + s * e[t])
        got = one(spark, rec.seasonal_week(column, F.lit(s)))
        assert np.allclose(got, g)
        assert np.allclose(one(spark, rec.random_walk(column, F.lit(s))), np.cumsum(s * e))
