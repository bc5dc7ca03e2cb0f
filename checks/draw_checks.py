"""Draw summaries, recursions, simulation and densities."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import sql as Q, views as V
from checks.panel_checks import r6
from fieldcast.functions import noise as N, text as X
from fieldcast.functions.dates import parse_day
from fieldcast.operators import convergence as C, density, draws as D, reports as R, simulate, states as S
from fieldcast.operators.ranking import average_ranks


def rate_of(draw):
    return F.round(0.1 + 4999.9 * F.pmod(F.col(draw) * 37, F.lit(101)) / 100.0, 3)


def r4(name, alias=None):
    column = F.col(name) if isinstance(name, str) else name
    return (F.round(column, 4) + F.lit(0.0)).alias(alias or name)


def draws_long(spark, sf):
    named = V.draws(spark, sf).withColumn("name", X.indexed_name(F.lit("e"), F.col("i1")))
    variable, i1, i2 = X.parse_indexed(F.col("name"))
    return named.select(
        "chain", "iteration", "draw", "name", variable.alias("variable"), i1.alias("i1"),
        i2.alias("i2"), r6("value"),
    )


def draw_quantiles(spark, sf):
    cuts = D.interval_quantiles(V.draws(spark, sf), ["i1"])
    return cuts.select("i1", r6("lwr"), r6("fit"), r6("upr"))


def draw_means(spark, sf):
    return D.means(V.draws(spark, sf), ["i1"]).select("i1", r6("mean"), r6("mean_exp"))


def draw_summary(spark, sf):
    rows = C.summary(V.draws(spark, sf), ["i1"])
    exact = [r6(c) for c in ("mean", "median", "sd", "mad", "q5", "q95", "rhat")]
    return rows.select("i1", *exact, r4("ess_bulk"), r4("ess_tail"), r6("mcse_mean"))


def draw_ess(spark, sf):
    """Effective sample sizes of autocorrelated draws with ties, in chains of unequal and odd length."""
    rows = C.effective_size(V.chain_draws(spark, sf), ["i1"])
    return rows.select("i1", *[r4(c) for c in ("ess_bulk", "ess_tail", "ess_mean")], r6("rhat"), r6("mcse_mean"))


def draw_ranks(spark, sf):
    """Ranks of grouped prices: a value column with many ties."""
    rows = V.table(spark, sf, "lineitem").select("l_returnflag", "l_quantity")
    return average_ranks(rows, ["l_returnflag"], "l_quantity")


def rhat_split(spark, sf):
    split = C.split_chains(V.draws(spark, sf), ["i1"])
    return C.rhat_split(split, ["i1"]).select("i1", r6("rhat"))


def rhat_rank(spark, sf):
    return C.rhat_rank(V.draws(spark, sf), ["i1"]).select("i1", r6("rhat"))


def rhat_hist(spark, sf):
    split = C.split_chains(V.draws(spark, sf))
    return D.histogram(C.rhat_split(split, ["i1"]), "rhat", 0.01)


def sample_draws(spark, sf):
    rows = V.draws(spark, sf)
    entities = D.sample_ids(rows, "i1", 10, 123)
    sampled = D.sample_draws(rows, 100, V.SEED).join(entities, "i1", "left_semi")
    return sampled.select("draw", "i1", r6("value"))


def normal_noise(spark, sf):
    grid = V.forecast_parameters(spark, sf).select(
        "draw", "series", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("step")
    )
    z = N.normal(V.SEED, F.col("draw"), F.col("series"), F.lit("mu"), F.col("step"))
    return grid.select("draw", "series", "step", r6(z, "z"))


def timed(spark, sf):
    return V.draws(spark, sf).select("draw", F.col("i1").alias("t"), "value")


def state_rw(spark, sf):
    rows = S.walk_rows(timed(spark, sf), ["draw"], "value", F.lit(0.5))
    return rows.select("draw", "t", r6("b"))


def state_seasonal(spark, sf):
    rows = S.seasonal_rows(timed(spark, sf), ["draw"], "value", F.lit(0.5))
    return rows.select("draw", "t", r6("gamma"))


def rolling6(spark, sf):
    return S.rolling_six(timed(spark, sf), ["draw"], "value").select("draw", "t", r6("sum6"))


def _level(spark, sf, variant):
    rows = V.state_rows(spark, sf, variant)
    return rows.select("draw", "t", r6("mu"))


def state_level1(spark, sf):
    return _level(spark, sf, "ar1")


def state_level2(spark, sf):
    return _level(spark, sf, "smooth")


def drift(spark, sf):
    rows = V.state_rows(spark, sf).select("draw", "t", "mu")
    return S.drift_rows(rows, ["draw"], "mu").select("draw", "t", r6("delta_exp"))


def state_lambda(spark, sf):
    rows = V.state_rows(spark, sf)
    return rows.select("draw", "t", *[r6(c) for c in S.STATE])


def state_lambda_ar1(spark, sf):
    rows = V.state_rows(spark, sf, "ar1")
    return rows.select("draw", "t", *[r6(c) for c in S.STATE])


def _components(spark, sf):
    return S.components(V.state_rows(spark, sf), ["draw", "chain"], F.lit(V.N_MAX))


def components(spark, sf):
    return _components(spark, sf).select("draw", "t", *[r6(c) for c in S.COMPONENTS])


def base_projection(spark, sf):
    """Base of each family on the last day, then its mean daily gain."""
    last = V.panel(spark, sf).groupBy("series").agg(
        F.max("mif_cum").alias("num_last"), F.count(F.lit(1)).alias("days")
    )
    gain = F.col("num_last") / F.col("days")
    rows = last.withColumn("gain", gain)
    return simulate.project_base(rows, F.col("gain"), V.HORIZON).select("series", "step", r4("num"))


def _paths(spark, sf):
    params = simulate.spread(V.forecast_parameters(spark, sf))
    return simulate.explode_path(simulate.horizon(params, V.HORIZON, F.lit(0.1), V.SEED))


PATH = ("mu", "b_ope", "gamma", "num", "r", "lambda")


def forecast_lambda(spark, sf):
    return _paths(spark, sf).select("draw", "series", "step", *[r4(c) for c in PATH])


def transfer_forecast(spark, sf):
    params = V.forecast_parameters(spark, sf)
    half = F.floor(F.col("draw") / 2).cast("int")
    scales = params.where(F.col("draw") % 2 == 0).withColumn("draw", half)
    states = params.where(F.col("draw") % 2 == 1).withColumn("draw", half)
    joined = simulate.transfer(states, scales)
    paths = simulate.explode_path(
        simulate.horizon(simulate.spread(joined), V.HORIZON, F.lit(0.1), V.SEED)
    )
    return paths.select("draw", "series", "step", r4("lambda"))


def transfer_map(spark, sf):
    """Successor series borrow from the predecessor series that a table names, two of them from one."""
    params = V.forecast_parameters(spark, sf)
    half = F.floor(F.col("draw") / 2).cast("int")
    scales = params.where(F.col("draw") % 2 == 0).withColumn("draw", half)
    states = params.where(F.col("draw") % 2 == 1).withColumn("draw", half)
    donors = spark.createDataFrame(list(DONORS.items()), "series int, donor int")
    paths = simulate.explode_path(
        simulate.horizon(simulate.spread(simulate.transfer(states, scales, donors)), V.HORIZON, F.lit(0.1), V.SEED)
    )
    return paths.select("draw", "series", "step", r4("lambda"))


DONORS = {1: 4, 2: 4, 3: 1}


def posterior_predict(spark, sf):
    counts = simulate.predictive_counts(
        _paths(spark, sf), F.col("lambda"), V.SEED, F.col("draw"), F.col("series"), F.col("step")
    )
    return counts.select("draw", "series", "step", "y_pred")


def poisson_rates(spark, sf):
    """Counts of rates from 0.1 to 5,000, one per draw."""
    rows = V.vectors(spark, sf).select("draw", rate_of("draw").alias("rate"))
    return rows.select("draw", N.poisson(F.col("rate"), V.SEED, F.col("draw")).alias("y"))


def interval_table(spark, sf):
    rows = _paths(spark, sf).select("series", "step", F.exp("lambda").alias("rate"))
    start = F.date_add(V.last_day(spark, sf).scalar(), 1)
    table = R.interval_table(rows, "rate", start, "step")
    return table.select("series", "date", r4("lwr"), r4("fit"), r4("upr"))


def monthly_interval(spark, sf):
    rows = V.draws(spark, sf).select(
        F.concat(F.lit("chain "), F.col("chain").cast("string")).alias("series"), "i1", "value"
    )
    start = parse_day(F.lit("20210101"))
    table = R.interval_table(rows, "value", start, "i1", freq="month")
    return table.select("series", "date", r4("lwr"), r4("fit"), r4("upr"))


def component_report(spark, sf):
    start = F.lit("2001-01-01").cast("date")
    table = R.component_report(_components(spark, sf), ["chain"], start)
    return table.select("chain", "component", "date", r4("lwr"), r4("fit"), r4("upr"))


OBSERVED_UNTIL = "2001-02-10"


def component_future(spark, sf):
    """Component intervals with predicted counts, the actual counts and the future marked."""
    start, end = (F.lit(d).cast("date") for d in ("2001-01-01", OBSERVED_UNTIL))
    rows = V.state_rows(spark, sf)
    counts = simulate.predictive_counts(rows, F.col("lambda"), V.SEED, F.col("draw"), F.col("t"))
    parts = S.components(counts, ["draw", "chain", "y_pred"], F.lit(V.N_MAX))
    observed = V.table(spark, sf, "orders").groupBy(
        (F.col("o_orderkey") % 4 + 1).cast("int").alias("chain"), V.day("o_orderdate").alias("date")
    ).agg(F.count(F.lit(1)).alias("em")).where(F.col("date") <= end)
    table = R.component_report(parts, ["chain"], start, True, observed, end)
    return table.select("chain", "component", "date", r4("lwr"), r4("fit"), r4("upr"), "em", "is_future")


def series_label(spark, sf):
    means = V.forecast_parameters(spark, sf).groupBy("series").agg(F.avg("b_ar").alias("b_ar"))
    named = means.select(
        F.col("series").alias("ord"), F.concat(F.lit("S"), F.col("series").cast("string")).alias("series"), "b_ar"
    )
    return R.series_label(named)


def loglik(spark, sf):
    rows = V.state_rows(spark, sf).select("draw", "t", "lambda")
    counts = timed(spark, sf).select("draw", "t", F.floor(F.abs("value") * 200).cast("int").alias("y"))
    # both sides come from the same vector: join inside the draw
    joined = rows.join(counts, ["draw", "t"])
    return density.log_likelihood(joined, ["draw"], "y", "lambda").select("draw", r6("loglik"))


def log_prior(spark, sf):
    params = V.forecast_parameters(spark, sf)
    innovations = F.array(*[F.col(f"g{i}") for i in range(1, 7)])
    rows = params.withColumn("err", innovations)
    total = density.scalar_log_prior(5.0) + density.innovation_log_prior("err")
    return rows.withColumn("lp", total).groupBy("draw").agg(F.sum("lp").alias("log_prior")).select(
        "draw", r6("log_prior")
    )


def _scaled(spark, sf):
    rows = V.coefficients(spark, sf)
    scales = rows.select("term", "term_ord").distinct().select(
        "term", (1.0 + 0.5 * F.col("term_ord")).alias("scale_max")
    )
    return D.rescale(rows, scales)


def coef_rescale(spark, sf):
    return _scaled(spark, sf).select("draw", "part", "term", r6("value"))


def coef_long(spark, sf):
    rows = D.coef_long(_scaled(spark, sf), 50, 123)
    return rows.select("iter", "mean", "term", r6("probability"), r6("count"))


SELECTED = [f"t{i:02d}" for i in range(1, 12)]


def _summary(spark, sf):
    rows = _scaled(spark, sf)
    levels = rows.select("term", "term_ord").distinct()
    return D.coef_summary(rows, levels, 2, SELECTED)


def coef_summary(spark, sf):
    return _summary(spark, sf).select(
        "term", "term_ord", "type", r6("lwr"), r6("fit"), r6("upr"), (F.col("label") + F.lit(0.0)).alias("label")
    )


def coef_order(spark, sf):
    return D.coef_order(_summary(spark, sf)).select("term", "type", r6("fit"), "position")


def entity_q_lambda(spark, sf):
    rows = V.coefficients(spark, sf).select("draw", "part", F.col("term_ord").alias("entity"), "value")
    out = D.entity_long(rows, 100, 20, 123)
    return out.select("iter", "mean", "entity", r6("q"), r6("lambda"))


QUERIES = {
    f.__name__: f
    for f in (
        draws_long, draw_quantiles, draw_means, draw_summary, draw_ess, draw_ranks, rhat_split, rhat_rank,
        rhat_hist, sample_draws, normal_noise, state_rw, state_seasonal, rolling6, state_level1,
        state_level2, drift, state_lambda, state_lambda_ar1, components, base_projection,
        forecast_lambda, transfer_forecast, transfer_map, posterior_predict, poisson_rates, interval_table, monthly_interval,
        component_report, component_future, series_label, loglik, log_prior, coef_rescale, coef_long, coef_summary,
        coef_order, entity_q_lambda,
    )
}

DR = Q.with_(Q.DRAWS)
INTERVAL6 = ", ".join(
    f"round(quantile_cont(value, {p}), 6) + 0.0 AS {n}"
    for n, p in (("lwr", 0.025), ("fit", 0.5), ("upr", 0.975))
)
INTERVAL4 = INTERVAL6.replace(", 6)", ", 4)")

SPLIT = """sp AS (
  SELECT dr.*, CASE WHEN iteration - first < size THEN iteration - first
                    ELSE iteration - first - (len - size) END AS pos, CASE WHEN iteration - first < size THEN 1
                    WHEN iteration - first >= len - size THEN 2 END AS half
  FROM dr JOIN (SELECT chain, min(iteration) AS first, max(iteration) - min(iteration) + 1 AS len,
                  (max(iteration) - min(iteration) + 1) // 2 AS size FROM dr GROUP BY 1) c
    ON c.chain = dr.chain)"""


def rhat_cte(name: str, source: str, keys: str, value: str) -> str:
    return f"""{name} AS (
  SELECT {keys}, sqrt(((avg(n) - 1) / avg(n) * avg(v) + var_samp(m)) / avg(v)) AS rhat
  FROM (SELECT {keys}, chain, half, count(*) AS n, avg({value}) AS m, var_samp({value}) AS v
        FROM {source} WHERE half IS NOT NULL GROUP BY {keys}, chain, half) GROUP BY {keys})"""


def poisson_ctes(ids: str, keys: str, proposals: int = 20) -> tuple[str, ...]:
    """``py``: counts of the rates in ``r``, small ones by inversion, others by the first proposal taken."""
    text = f"'{V.SEED}|' || {ids} || '|y'"
    mass = f"""CASE WHEN k <= {N.EXACT_FACTORIAL} THEN k * ln(rate) - rate - lgamma(k + 1)
      ELSE k - rate - k * ln(k / rate) - 1.0 / (12 * k) + 1.0 / (360 * k * k * k) - 0.5 * ln(2 * pi() * k) END"""
    hat = f"ln(v) + ln({N.INVERSE_ALPHA[0]} + {N.INVERSE_ALPHA[1]} / (b - {N.INVERSE_ALPHA[2]})) - ln(a / (us * us) + b)"
    return (
        f"""cdf AS (
  SELECT {keys}, u, sum(exp(k * ln(rate) - rate - lgamma(k + 1)))
    OVER (PARTITION BY {keys} ORDER BY k ROWS UNBOUNDED PRECEDING) AS cum
  FROM (SELECT *, {Q.lane(text)} AS u, unnest(range(0, CAST(ceil(rate + 10 * sqrt(rate) + 20) AS BIGINT))) AS k
        FROM r WHERE rate < {N.REJECTION_FROM}))""",
        f"""wide AS (
  SELECT *, {N.WIDTH[0]} + {N.WIDTH[1]} * sqrt(rate) AS b FROM r WHERE rate >= {N.REJECTION_FROM})""",
        f"""tried AS (
  SELECT *, {N.HEIGHT[0]} + {N.HEIGHT[1]} * b AS a, {Q.lane(f"{text} || '|' || j")} - 0.5 AS un,
    {Q.lane(f"{text} || '|' || j", 1)} AS v
  FROM (SELECT *, unnest(range(0, {proposals})) AS j FROM wide))""",
        """shaped AS (SELECT *, 0.5 - abs(un) AS us FROM tried)""",
        f"""placed AS (SELECT *, floor((2.0 * a / us + b) * un + rate + {N.CENTRE}) AS k FROM shaped)""",
        f"""taken AS (
  SELECT {keys}, CAST(arg_min(k, j) AS BIGINT) AS y FROM placed
  WHERE (us >= {N.INSIDE} AND v <= {N.SQUEEZE[0]} - {N.SQUEEZE[1]} / (b - {N.SQUEEZE[2]}))
    OR (k >= 0 AND NOT (us < {N.CORNER} AND v > us) AND {hat} <= {mass})
  GROUP BY {keys})""",
        f"""py AS (
  SELECT {keys}, count(*) FILTER (WHERE cum < u) AS y FROM cdf GROUP BY {keys}
  UNION ALL SELECT * FROM taken)""",
    )


def horner(x: str, coefficients) -> str:
    text = repr(coefficients[0])
    for c in coefficients[1:]:
        text = f"({text} * {x} + ({c!r}))"
    return text


def normal_quantile(p: str) -> str:
    q2 = "((P - 0.5) * (P - 0.5))"
    low, high = "sqrt(-2.0 * ln(P))", "sqrt(-2.0 * ln(1.0 - P))"
    text = (
        f"CASE WHEN P < {N.TAIL_START} THEN {horner(low, N.TAIL_NUM)} / {horner(low, N.TAIL_DEN)}"
        f" WHEN P > {1 - N.TAIL_START} THEN -({horner(high, N.TAIL_NUM)}) / {horner(high, N.TAIL_DEN)}"
        f" ELSE (P - 0.5) * {horner(q2, N.CENTRAL_NUM)} / {horner(q2, N.CENTRAL_DEN)} END"
    )
    return text.replace("P", p)


# innovations of the reconstructed states, in long form
INNOVATIONS = """inn AS (
  SELECT CAST(vec_id AS INTEGER) AS draw, CAST(vec_id % 4 + 1 AS INTEGER) AS chain,
    CAST(t AS INTEGER) AS t, e[t] AS mu_err, e[65 - t] AS b_err,
    e[CASE WHEN t <= 48 THEN t + 16 ELSE t - 48 END] AS r_raw,
    CASE WHEN t <= 58 THEN e[CASE WHEN t <= 32 THEN t + 32 ELSE t - 32 END] END AS g_err,
    t / 64.0 AS num
  FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, unnest(range(1, 65)) AS t FROM embeddings))"""


def states_sql(ar1: bool) -> str:
    first = (
        f"{V.INTERCEPT} + {V.SLOPE} * mu_err" if ar1 else f"{V.INTERCEPT} + {V.LEVEL} * mu_err"
    )
    pull = "s.mu" if ar1 else "CASE WHEN s.t >= 2 THEN 2 * s.mu - s.m2 ELSE s.mu END"
    first_b = "b_err" if ar1 else f"{V.WALK} * b_err"
    season = "g_err" if ar1 else f"{V.SEASON} * g_err"
    return f"""head AS (
  SELECT draw, max(CASE WHEN t = 1 THEN {season} END) AS g1, max(CASE WHEN t = 2 THEN {season} END) AS g2,
    max(CASE WHEN t = 3 THEN {season} END) AS g3, max(CASE WHEN t = 4 THEN {season} END) AS g4,
    max(CASE WHEN t = 5 THEN {season} END) AS g5, max(CASE WHEN t = 6 THEN {season} END) AS g6
  FROM inn GROUP BY 1),
sea AS (
  SELECT draw, 6 AS t, g1, g2, g3, g4, g5, g6 FROM head
  UNION ALL
  SELECT s.draw, s.t + 1, s.g2, s.g3, s.g4, s.g5, s.g6,
    -(s.g1 + s.g2 + s.g3 + s.g4 + s.g5 + s.g6) + {V.SEASON} * i.g_err
  FROM sea s JOIN inn i ON i.draw = s.draw AND i.t = s.t - 5 WHERE s.t < 64),
gam AS (
  SELECT draw, t, {season} AS gamma FROM inn WHERE t <= 6
  UNION ALL SELECT draw, t, g6 FROM sea WHERE t > 6),
lev AS (
  SELECT draw, t, {first} AS mu, CAST(0 AS DOUBLE) AS m2, {first_b} AS b FROM inn WHERE t = 1
  UNION ALL
  SELECT s.draw, s.t + 1, {V.INTERCEPT} + {V.SLOPE} * ({pull}) + {V.LEVEL} * i.mu_err, s.mu,
    s.b + {V.WALK} * i.b_err
  FROM lev s JOIN inn i ON i.draw = s.draw AND i.t = s.t + 1),
st AS (
  SELECT l.draw, i.chain, l.t, l.mu, l.b AS b_ope, g.gamma, l.b * i.num AS tvc,
    {V.EFFECT} * i.r_raw AS r, l.mu + g.gamma + l.b * i.num + {V.EFFECT} * i.r_raw AS lam,
    l.mu - lag(l.mu) OVER (PARTITION BY l.draw ORDER BY l.t) AS delta
  FROM lev l JOIN inn i ON i.draw = l.draw AND i.t = l.t
  JOIN gam g ON g.draw = l.draw AND g.t = l.t)"""


SMOOTH = Q.with_(INNOVATIONS, states_sql(False), recursive=True)
AR1 = Q.with_(INNOVATIONS, states_sql(True), recursive=True)
STATE6 = ", ".join(
    f"round({'lam' if c == 'lambda' else c}, 6) + 0.0 AS \"{c}\"" for c in S.STATE
)

COMPONENT_SQL = {
    "lambda_exp": "exp(lam)",
    "mu_gamma_exp": "exp(mu + gamma)",
    "mu_r_exp": "exp(mu + r)",
    "mu_tvc_exp": "exp(mu + tvc)",
    "mu_exp": "exp(mu)",
    "gamma_exp": "exp(gamma)",
    "delta_exp": "CASE WHEN t >= 32 THEN exp(delta) END",
    "r_exp": "exp(r)",
    "tvc_exp": "exp(tvc)",
    "mu_tvc_1_exp": f"exp(mu + b_ope / {V.N_MAX})",
    "mu_tvc_1": f"mu + b_ope / {V.N_MAX}",
    "tvc_1_exp": f"exp(b_ope / {V.N_MAX})",
    "tvc_1": f"b_ope / {V.N_MAX}",
}
COMPONENT_CTE = "comp AS (\n" + "\nUNION ALL ".join(
    f"SELECT chain, t, '{n}' AS component, {e} AS value FROM st" for n, e in COMPONENT_SQL.items()
) + ")"

PATHS = Q.with_(Q.PARAMS, Q.noise("dp", V.HORIZON), Q.horizon("dp", V.HORIZON, "0.1"), recursive=True)
PAIRED = """tp AS (
  SELECT b.draw // 2 AS draw, b.series, b.intercept, b.b_ar, a.s_z, a.s_s, a.s_r, a.s_t,
    b.mu_prev, b.mu_last, b.b_last, b.g1, b.g2, b.g3, b.g4, b.g5, b.g6, b.num_last
  FROM dp b JOIN dp a ON a.draw = b.draw - 1 AND a.series = b.series WHERE b.draw % 2 = 1)"""
LAST = "(SELECT max(CAST(l_shipdate AS DATE)) FROM lineitem)"

LN_T = "(lgamma(({df} + 1) / 2) - lgamma({df} / 2) - 0.5 * ln({df} * pi()) - ln({s})" \
       " - ({df} + 1) / 2 * ln(1 + ({x} / {s}) * ({x} / {s}) / {df}))"


def ln_t(x: str, df: float, s: float = 1.0) -> str:
    return LN_T.format(x=x, df=df, s=s)


COEF = """co AS (
  SELECT draw, CAST((i1 - 1) % 2 + 1 AS INTEGER) AS part, CAST((i1 - 1) // 2 AS INTEGER) AS term_ord,
    't' || lpad(CAST((i1 - 1) // 2 AS VARCHAR), 2, '0') AS term, value AS raw,
    value / (1.0 + 0.5 * ((i1 - 1) // 2)) AS value
  FROM dr)"""


def sampled(source: str, column: str, n: int, seed: int) -> str:
    return (
        f"(SELECT {column} FROM (SELECT DISTINCT {column} FROM {source})"
        f" ORDER BY md5('{seed}|' || {column}), {column} LIMIT {n})"
    )


SUMMARY = f"""su AS (
  SELECT term, term_ord, CASE WHEN part = 1 THEN 'probability' ELSE 'count' END AS type,
    quantile_cont(value, 0.025) AS lwr, quantile_cont(value, 0.5) AS fit,
    quantile_cont(value, 0.975) AS upr
  FROM co WHERE term IN ({', '.join(f"'{t}'" for t in SELECTED)}) GROUP BY 1, 2, part)"""

#: ranks of the half chains' values and of their distances from the median, R-hat of both
RANKED = (
    SPLIT,
    "med AS (SELECT i1, quantile_cont(value, 0.5) AS med, quantile_cont(value, 0.05) AS low,"
    " quantile_cont(value, 0.95) AS high FROM sp WHERE half IS NOT NULL GROUP BY 1)",
    """fo AS (
  SELECT sp.i1, chain, half, pos, value, 'bulk' AS form, value AS x FROM sp WHERE half IS NOT NULL
  UNION ALL SELECT sp.i1, chain, half, pos, value, 'folded', abs(value - med) FROM sp
  JOIN med ON med.i1 = sp.i1 WHERE half IS NOT NULL)""",
    """rk AS (
  SELECT *, rank() OVER (PARTITION BY i1, form ORDER BY x)
    + (count(*) OVER (PARTITION BY i1, form, x) - 1) / 2.0 AS r,
    count(*) OVER (PARTITION BY i1, form) AS s FROM fo)""",
    "pr AS (SELECT *, (r - 0.375) / (s + 0.25) AS pp FROM rk)",
    f"zz AS (SELECT *, {normal_quantile('pp')} AS z FROM pr)",
    rhat_cte("rh", "zz", "i1, form", "z"),
)


def ess_ctes(source: str) -> tuple[str, ...]:
    """Effective sample sizes by all pairs of draws of a half chain, for the chains in ``source``."""
    return (
        Q.DRAWS,
        *(part.replace("FROM dr", f"FROM {source}").replace("dr.", f"{source}.") for part in RANKED),
        """xs AS (
  SELECT zz.i1, chain, half, pos, series.s, CASE series.s WHEN 'bulk' THEN z WHEN 'low' THEN CAST(value <= low AS INTEGER)
    WHEN 'high' THEN CAST(value <= high AS INTEGER) ELSE value END AS x
  FROM zz JOIN med ON med.i1 = zz.i1, (VALUES ('bulk'), ('low'), ('high'), ('mean')) AS series(s)
  WHERE form = 'bulk')""",
        """hc AS (
  SELECT i1, s, chain, half, count(*) AS n, avg(x) AS m, var_samp(x) AS v FROM xs GROUP BY 1, 2, 3, 4)""",
        """st AS (
  SELECT i1, s, avg(n) AS n, min(n) AS least, sum(n) AS total, count(*) AS halves, avg(v) AS w, var_samp(m) AS b
  FROM hc GROUP BY 1, 2)""",
        """cx AS (
  SELECT xs.i1, xs.s, xs.chain, xs.half, pos, x - m AS x, n FROM xs
  JOIN hc ON hc.i1 = xs.i1 AND hc.s = xs.s AND hc.chain = xs.chain AND hc.half = xs.half)""",
        """ac AS (
  SELECT a.i1, a.s, b.pos - a.pos AS lag, sum(a.x * b.x / a.n) AS acov FROM cx a
  JOIN cx b ON a.i1 = b.i1 AND a.s = b.s AND a.chain = b.chain AND a.half = b.half AND b.pos >= a.pos
  GROUP BY 1, 2, 3)""",
        """rho AS (
  SELECT st.*, lag, CASE WHEN lag = 0 THEN 1.0
    ELSE 1 - (w - acov / halves) / (w * (n - 1) / n + coalesce(b, 0)) END AS rho
  FROM st JOIN ac ON ac.i1 = st.i1 AND ac.s = st.s)""",
        """pairs AS (
  SELECT i1, s, least, total, lag // 2 AS k, sum(rho) AS duo, max(CASE WHEN lag % 2 = 0 THEN rho END) AS even
  FROM rho GROUP BY 1, 2, 3, 4, 5)""",
        """ends AS (SELECT *, NOT (duo > 0 AND 2 * k < least - 5) AS ends FROM pairs)""",
        """mono AS (
  SELECT *, min(duo) OVER w AS low, sum(CAST(ends AS INTEGER)) OVER w AS stops
  FROM ends WINDOW w AS (PARTITION BY i1, s ORDER BY k ROWS UNBOUNDED PRECEDING))""",
        """tau AS (
  SELECT i1, s, total, greatest(1 / log10(total), -1 + 2 * coalesce(sum(low) FILTER (stops = 0), 0)
    + max(CASE WHEN ends AND stops = 1 THEN CASE WHEN even > 0 OR duo >= 0 THEN even ELSE 0 END END)) AS tau
  FROM mono GROUP BY 1, 2, 3)""",
        """ess AS (
  SELECT i1, max(total / tau) FILTER (s = 'bulk') AS ess_bulk, min(total / tau) FILTER (s IN ('low', 'high')) AS ess_tail,
    max(total / tau) FILTER (s = 'mean') AS ess_mean FROM tau GROUP BY 1)""",
    )


SQL = {
    "draws_long": DR + """
SELECT chain, iteration, draw, 'e[' || i1 || ']' AS name, 'e' AS variable, i1,
  CAST(NULL AS INTEGER) AS i2, round(value, 6) + 0.0 AS value FROM dr""",
    "draw_quantiles": DR + f"SELECT i1, {INTERVAL6} FROM dr GROUP BY 1",
    "draw_means": DR + """
SELECT i1, round(avg(value), 6) + 0.0 AS mean, round(exp(avg(value)), 6) + 0.0 AS mean_exp
FROM dr GROUP BY 1""",
    "draw_summary": Q.with_(*ess_ctes("dr")) + """
SELECT dr.i1, round(avg(value), 6) + 0.0 AS mean, round(max(med), 6) + 0.0 AS median,
  round(stddev_samp(value), 6) + 0.0 AS sd,
  round(1.4826 * quantile_cont(abs(value - med), 0.5), 6) + 0.0 AS mad,
  round(quantile_cont(value, 0.05), 6) + 0.0 AS q5, round(quantile_cont(value, 0.95), 6) + 0.0 AS q95,
  round(max(rhat), 6) + 0.0 AS rhat, round(max(ess_bulk), 4) + 0.0 AS ess_bulk,
  round(max(ess_tail), 4) + 0.0 AS ess_tail,
  round(stddev_samp(value) / sqrt(max(ess_mean)), 6) + 0.0 AS mcse_mean
FROM dr JOIN (SELECT i1, quantile_cont(value, 0.5) AS med FROM dr GROUP BY 1) m ON m.i1 = dr.i1
JOIN ess ON ess.i1 = dr.i1 JOIN (SELECT i1, max(rhat) AS rhat FROM rh GROUP BY 1) h ON h.i1 = dr.i1
GROUP BY dr.i1""",
    "draw_ess": Q.with_(
        Q.DRAWS,
        """cd AS (
  SELECT i1, chain, iteration, draw, round(value + 0.8 * coalesce(lag(value, 1) OVER w, 0.0)
    + 0.5 * coalesce(lag(value, 2) OVER w, 0.0), 2) AS value
  FROM dr WHERE i1 <= 8 AND value IS NOT NULL AND (chain < 4 OR iteration <= 80)
  WINDOW w AS (PARTITION BY i1, chain ORDER BY iteration))""",
        *ess_ctes("cd")[1:],
    ) + """
SELECT ess.i1, round(ess_bulk, 4) + 0.0 AS ess_bulk, round(ess_tail, 4) + 0.0 AS ess_tail,
  round(ess_mean, 4) + 0.0 AS ess_mean, round(rhat, 6) + 0.0 AS rhat,
  round(sd / sqrt(ess_mean), 6) + 0.0 AS mcse_mean
FROM ess JOIN (SELECT i1, max(rhat) AS rhat FROM rh GROUP BY 1) h ON h.i1 = ess.i1
JOIN (SELECT i1, stddev_samp(value) AS sd FROM cd GROUP BY 1) d ON d.i1 = ess.i1""",
    "draw_ranks": """
SELECT l_returnflag, l_quantity, before + (n + 1) / 2.0 AS rank, CAST(size AS BIGINT) AS group_size
FROM (SELECT l_returnflag, l_quantity, count(*) AS n,
        sum(count(*)) OVER (PARTITION BY l_returnflag) AS size,
        sum(count(*)) OVER (PARTITION BY l_returnflag ORDER BY l_quantity
          ROWS UNBOUNDED PRECEDING) - count(*) AS before
      FROM lineitem GROUP BY 1, 2)""",
    "rhat_split": Q.with_(Q.DRAWS, SPLIT, rhat_cte("rh", "sp", "i1", "value"))
    + "SELECT i1, round(rhat, 6) + 0.0 AS rhat FROM rh",
    "rhat_rank": Q.with_(*ess_ctes("dr")[: 1 + len(RANKED)])
    + "SELECT i1, round(max(rhat), 6) + 0.0 AS rhat FROM rh GROUP BY 1",
    "rhat_hist": Q.with_(Q.DRAWS, SPLIT, rhat_cte("rh", "sp", "i1", "value"))
    + "SELECT CAST(floor(rhat / 0.01) AS BIGINT) AS bin, count(*) AS n FROM rh GROUP BY 1",
    "sample_draws": DR + f"""
SELECT draw, i1, round(value, 6) + 0.0 AS value FROM dr
WHERE draw IN {sampled('dr', 'draw', 100, V.SEED)} AND i1 IN {sampled('dr', 'i1', 10, 123)}""",
    "normal_noise": Q.with_(Q.PARAMS, Q.noise("dp", 3))
    + "SELECT draw, series, step, round(zmu, 6) + 0.0 AS z FROM noise",
    "state_rw": DR + """
SELECT draw, i1 AS t, round(sum(0.5 * value) OVER (PARTITION BY draw ORDER BY i1
  ROWS UNBOUNDED PRECEDING), 6) + 0.0 AS b FROM dr""",
    "state_seasonal": Q.with_(Q.DRAWS, """sea AS (
  SELECT draw, 6 AS t, 0.5 * e[1] AS g1, 0.5 * e[2] AS g2, 0.5 * e[3] AS g3, 0.5 * e[4] AS g4,
    0.5 * e[5] AS g5, 0.5 * e[6] AS g6, e
  FROM (SELECT CAST(vec_id AS INTEGER) AS draw, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
  UNION ALL
  SELECT draw, t + 1, g2, g3, g4, g5, g6, -(g1 + g2 + g3 + g4 + g5 + g6) + 0.5 * e[t - 5], e
  FROM sea WHERE t < 64)""", recursive=True) + """
SELECT draw, i1 AS t, round(0.5 * value, 6) + 0.0 AS gamma FROM dr WHERE i1 <= 6
UNION ALL SELECT draw, t, round(g6, 6) + 0.0 FROM sea WHERE t > 6""",
    "rolling6": DR + """
SELECT draw, i1 AS t, CASE WHEN i1 >= 7 THEN round(sum(value) OVER (PARTITION BY draw ORDER BY i1
  ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), 6) + 0.0 END AS sum6 FROM dr""",
    "state_level1": AR1 + "SELECT draw, t, round(mu, 6) + 0.0 AS mu FROM st",
    "state_level2": SMOOTH + "SELECT draw, t, round(mu, 6) + 0.0 AS mu FROM st",
    "drift": SMOOTH + "SELECT draw, t, round(exp(delta), 6) + 0.0 AS delta_exp FROM st WHERE t >= 32",
    "state_lambda": SMOOTH + f"SELECT draw, t, {STATE6} FROM st",
    "state_lambda_ar1": AR1 + f"SELECT draw, t, {STATE6} FROM st",
    "components": SMOOTH + "SELECT draw, t, " + ", ".join(
        f"round({e}, 6) + 0.0 AS {n}" for n, e in COMPONENT_SQL.items()
    ) + " FROM st",
    "base_projection": Q.with_(*Q.PANEL_CTES) + f"""
SELECT series, CAST(i AS INTEGER) AS step, round(m + i * m / d, 4) + 0.0 AS num
FROM (SELECT series, CAST(max(mif_cum) AS DOUBLE) AS m, count(*) AS d FROM panel GROUP BY 1),
  range(1, {V.HORIZON + 1}) AS s(i)""",
    "forecast_lambda": PATHS + """
SELECT draw, series, step, round(mu, 4) + 0.0 AS mu, round(b, 4) + 0.0 AS b_ope,
  round(g6, 4) + 0.0 AS gamma, round(num, 4) + 0.0 AS num, round(r, 4) + 0.0 AS r,
  round(lam, 4) + 0.0 AS \"lambda\" FROM path WHERE step > 0""",
    "transfer_forecast": Q.with_(
        Q.PARAMS, PAIRED, Q.noise("tp", V.HORIZON), Q.horizon("tp", V.HORIZON, "0.1"), recursive=True
    ) + "SELECT draw, series, step, round(lam, 4) + 0.0 AS \"lambda\" FROM path WHERE step > 0",
    "transfer_map": Q.with_(
        Q.PARAMS,
        "donors(series, donor) AS (VALUES " + ", ".join(f"({a}, {b})" for a, b in DONORS.items()) + ")",
        PAIRED.replace("JOIN dp a", "JOIN donors d ON d.series = b.series JOIN dp a").replace(
            "a.series = b.series", "a.series = d.donor"
        ),
        Q.noise("tp", V.HORIZON), Q.horizon("tp", V.HORIZON, "0.1"), recursive=True,
    ) + "SELECT draw, series, step, round(lam, 4) + 0.0 AS \"lambda\" FROM path WHERE step > 0",
    "posterior_predict": Q.with_(
        Q.PARAMS, Q.noise("dp", V.HORIZON), Q.horizon("dp", V.HORIZON, "0.1"),
        "r AS (SELECT draw, series, step, exp(lam) AS rate FROM path WHERE step > 0)",
        *poisson_ctes("draw || '|' || series || '|' || step", "draw, series, step"),
        recursive=True,
    ) + """SELECT draw, series, step, y AS y_pred FROM py""",
    "poisson_rates": Q.with_(
        """r AS (SELECT CAST(vec_id AS INTEGER) AS draw,
  round(0.1 + 4999.9 * (vec_id * 37 % 101) / 100.0, 3) AS rate FROM embeddings)""",
        *poisson_ctes("draw", "draw"),
    ) + """SELECT draw, y FROM py""",
    "interval_table": PATHS + f"""
SELECT series, CAST({LAST} + step AS DATE) AS date, {INTERVAL4}
FROM (SELECT series, step, exp(lam) AS value FROM path WHERE step > 0) GROUP BY series, step""",
    "monthly_interval": DR + f"""
SELECT 'chain ' || chain AS series, CAST(DATE '2021-01-01' + to_months(i1 - 1) AS DATE) AS date, {INTERVAL4}
FROM dr GROUP BY chain, i1""",
    "component_report": Q.with_(INNOVATIONS, states_sql(False), COMPONENT_CTE, recursive=True) + f"""
SELECT chain, component, CAST(DATE '2001-01-01' + (t - 1) AS DATE) AS date, {INTERVAL4}
FROM comp WHERE value IS NOT NULL GROUP BY chain, component, t""",
    "component_future": Q.with_(
        INNOVATIONS, states_sql(False), COMPONENT_CTE,
        "r AS (SELECT draw, t, exp(lam) AS rate FROM st)", *poisson_ctes("draw || '|' || t", "draw, t"),
        "every AS (SELECT * FROM comp UNION ALL SELECT st.chain, st.t, 'y_pred', y FROM py"
        " JOIN st ON st.draw = py.draw AND st.t = py.t)",
        f"""cuts AS (
  SELECT chain, component, CAST(DATE '2001-01-01' + (t - 1) AS DATE) AS date, {INTERVAL4}
  FROM every WHERE value IS NOT NULL GROUP BY chain, component, t)""",
        f"""seen AS (
  SELECT CAST(o_orderkey % 4 + 1 AS INTEGER) AS chain, CAST(o_orderdate AS DATE) AS date, count(*) AS em
  FROM orders WHERE CAST(o_orderdate AS DATE) <= DATE '{OBSERVED_UNTIL}' GROUP BY 1, 2)""",
        recursive=True,
    ) + f"""
SELECT cuts.*, em, cuts.date > DATE '{OBSERVED_UNTIL}' AS is_future
FROM cuts LEFT JOIN seen ON seen.chain = cuts.chain AND seen.date = cuts.date""",
    "series_label": Q.with_(Q.PARAMS) + """
SELECT 'S' || series AS series,
  series || '.S' || series || ' (b_ar = ' || printf('%.3f', round_even(avg(b_ar), 3)) || ')' AS label
FROM dp GROUP BY dp.series""",
    "loglik": Q.with_(INNOVATIONS, states_sql(False), recursive=True) + """
SELECT s.draw, round(sum(y * lam - exp(lam) - lgamma(y + 1)), 6) + 0.0 AS loglik
FROM st s JOIN (SELECT draw, t, CAST(floor(abs(mu_err) * 200) AS INTEGER) AS y FROM inn) c
  ON c.draw = s.draw AND c.t = s.t GROUP BY 1""",
    "log_prior": Q.with_(Q.PARAMS) + "SELECT draw, round(sum(" + " + ".join(
        [ln_t("b_ar", 3.0), ln_t("intercept", 3.0, 10.0)]
        + [ln_t(s, 5.0) for s in ("s_z", "s_s", "s_r", "s_t")]
        + [f"(-0.5 * ln(2 * pi()) - 0.5 * g{i} * g{i})" for i in range(1, 7)]
    ) + "), 6) + 0.0 AS log_prior FROM dp GROUP BY 1",
    "coef_rescale": Q.with_(Q.DRAWS, COEF)
    + "SELECT draw, part, term, round(value, 6) + 0.0 AS value FROM co",
    "coef_long": Q.with_(Q.DRAWS, COEF) + f"""
SELECT CAST(draw AS VARCHAR) AS iter, 'data' AS mean, term,
  round(max(CASE WHEN part = 1 THEN value END), 6) + 0.0 AS probability,
  round(max(CASE WHEN part = 2 THEN value END), 6) + 0.0 AS count
FROM co WHERE draw IN {sampled('co', 'draw', 50, 123)} GROUP BY draw, term
UNION ALL SELECT 'mean', 'mean', term,
  round(avg(CASE WHEN part = 1 THEN value END), 6) + 0.0,
  round(avg(CASE WHEN part = 2 THEN value END), 6) + 0.0 FROM co GROUP BY term""",
    "coef_summary": Q.with_(Q.DRAWS, COEF, SUMMARY) + """
SELECT term, term_ord, type, round(lwr, 6) + 0.0 AS lwr, round(fit, 6) + 0.0 AS fit,
  round(upr, 6) + 0.0 AS upr, round_even(fit, 2) + 0.0 AS label FROM su""",
    "coef_order": Q.with_(Q.DRAWS, COEF, SUMMARY) + """
SELECT term, type, round(fit, 6) + 0.0 AS fit,
  CAST(row_number() OVER (ORDER BY fit DESC, term) AS INTEGER) AS position
FROM su WHERE type = 'count'""",
    "entity_q_lambda": Q.with_(Q.DRAWS, COEF) + f"""
SELECT CAST(draw AS VARCHAR) AS iter, 'data' AS mean, term_ord AS entity,
  round(max(CASE WHEN part = 1 THEN raw END), 6) + 0.0 AS q,
  round(exp(max(CASE WHEN part = 2 THEN raw END)), 6) + 0.0 AS lambda
FROM co WHERE draw IN {sampled('co', 'draw', 100, 123)}
  AND term_ord IN {sampled('co', 'term_ord', 20, 123)} GROUP BY draw, term_ord
UNION ALL SELECT 'mean', 'mean', term_ord,
  round(avg(CASE WHEN part = 1 THEN raw END), 6) + 0.0,
  round(exp(avg(CASE WHEN part = 2 THEN raw END)), 6) + 0.0
FROM co WHERE term_ord IN {sampled('co', 'term_ord', 20, 123)} GROUP BY term_ord""",
}
