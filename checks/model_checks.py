"""Model reports over given draws, and the regression (no SQL equivalent)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from checks import sql as Q, views as V
from checks.draw_checks import r4, sampled
from checks.panel_checks import r6
from fieldcast.operators import draws as D, zip_regression as Z
from fieldcast.operators.stored import stored
from fieldcast.plans.many import many_report as report
from fieldcast.plans.regression import zip_report


def many_report(spark, sf):
    """Monthly intervals of rates and effects; a vector holds one draw of 32 months of each."""
    draws = V.vectors(spark, sf).select(
        F.concat(F.lit("machine "), F.col("chain").cast("string")).alias("machine_no"),
        F.slice("e", 1, 32).alias("lambda"),
        F.slice("e", 33, 32).alias("r"),
    )
    table = report(draws, "machine_no", F.lit("2021-01-01").cast("date"))
    return table.select("machine_no", "item", "date", r6("lwr"), r6("fit"), r6("upr"))


PREDICTORS = ["o_totalprice", "is_open", "priority"]


def returned_lines(spark, sf):
    """Returned lines per order with its price, status and priority."""
    returns = V.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.count_if(F.col("l_returnflag") == "R").alias("y")
    )
    return V.table(spark, sf, "orders").join(returns, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        "o_orderkey",
        F.coalesce("y", F.lit(0)).alias("y"),
        "o_totalprice",
        (F.col("o_orderstatus") == "O").cast("int").alias("is_open"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"),
    )


def zip_regression(spark, sf):
    """Intervals of the coefficients over all bootstrap replicates."""
    return zip_report(returned_lines(spark, sf), "y", PREDICTORS, "o_orderkey")["summary"]


#: given coefficients of the scaled predictors: probability, count
GIVEN = [[0.4, -0.3, 0.5, 0.2], [0.1, 0.6, -0.2, 0.05]]


def zip_score(spark, sf):
    """Log likelihood and scores of all rows at given coefficients."""
    rows = Z.score(returned_lines(spark, sf), "y", PREDICTORS, "o_orderkey", np.array(GIVEN))
    return rows.select("item", "term", r4("value"))


N_GIVEN, N_SCORED, N_SAMPLED = 40, 100, 10


def zip_entities(spark, sf):
    """Sampled orders scored by sampled draws; a vector holds the coefficients of one draw."""
    rows = returned_lines(spark, sf)
    given = V.vectors(spark, sf).where(F.col("draw").between(1, N_GIVEN)).select("draw", F.slice("e", 1, 8).alias("b")).collect()
    model = Z.ZipModel(
        [Z.INTERCEPT, *PREDICTORS], {Z.INTERCEPT: 1.0, **Z.column_scales(rows, PREDICTORS)},
        {r.draw: np.array(r.b).reshape(2, 4) for r in given},
    )
    values = stored(Z.entity_draws(rows, model, "y", PREDICTORS, "o_orderkey", N_SCORED, V.SEED), "scores")
    table = D.entity_long(values, N_SAMPLED, N_SCORED, V.SEED)
    return table.select("iter", "mean", "entity", r6("q"), r6("lambda"))


QUERIES = {f.__name__: f for f in (many_report, zip_regression, zip_score, zip_entities)}

CUTS = ", ".join(
    f"round(quantile_cont(value, {p}), 6) + 0.0 AS {n}"
    for n, p in (("lwr", 0.025), ("fit", 0.5), ("upr", 0.975))
)
LINES = """rl AS (
  SELECT o_orderkey AS id, coalesce(y, 0) AS y, 1.0 AS x0, o_totalprice / max(o_totalprice) OVER () AS x1,
    CAST(o_orderstatus = 'O' AS INTEGER) / max(CAST(o_orderstatus = 'O' AS INTEGER)) OVER () AS x2,
    CAST(o_orderpriority[1] AS INTEGER) / max(CAST(o_orderpriority[1] AS INTEGER)) OVER () AS x3
  FROM orders LEFT JOIN (SELECT l_orderkey, count(*) FILTER (l_returnflag = 'R') AS y FROM lineitem GROUP BY 1)
    ON o_orderkey = l_orderkey)"""


def dot(beta: list) -> str:
    return "(" + " + ".join(f"({b}) * x{j}" for j, b in enumerate(beta)) + ")"


def zip_score_sql() -> str:
    terms = [Z.INTERCEPT, *PREDICTORS]
    items = ["SELECT 'loglik' AS item, NULL AS term, sum(v) AS value FROM s"]
    for item, column in (("probability", "s1"), ("count", "s2")):
        items += [f"SELECT '{item}', '{t}', sum({column} * x{j}) FROM s" for j, t in enumerate(terms)]
    return Q.with_(
        LINES,
        f"m AS (SELECT *, 1 / (1 + exp(-{dot(GIVEN[0])})) AS p, exp({dot(GIVEN[1])}) AS mu FROM rl)",
        "z AS (SELECT *, 1 - p + p * exp(-mu) AS zero FROM m)",
        """s AS (
  SELECT *, CASE WHEN y > 0 THEN ln(p) + y * ln(mu) - mu - lgamma(y + 1) ELSE ln(zero) END AS v,
    CASE WHEN y > 0 THEN 1 - p ELSE -p * (1 - p) * (1 - exp(-mu)) / zero END AS s1,
    CASE WHEN y > 0 THEN y - mu ELSE -p * mu * exp(-mu) / zero END AS s2
  FROM z)""",
    ) + "SELECT item, term, round(value, 4) + 0.0 AS value FROM (" + " UNION ALL ".join(items) + ")"


SQL = {
    "zip_score": zip_score_sql(),
    "zip_entities": Q.with_(
        LINES,
        f"chosen AS (SELECT * FROM rl WHERE id IN {sampled('rl', 'id', N_SCORED, V.SEED)})",
        f"""given AS (
  SELECT CAST(vec_id AS INTEGER) AS draw, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id BETWEEN 1 AND {N_GIVEN})""",
        f"""sc AS (
  SELECT draw, id AS entity, 1 / (1 + exp(-{dot([f'e[{j + 1}]' for j in range(4)])})) AS q,
    {dot([f'e[{j + 5}]' for j in range(4)])} AS ll FROM chosen, given)""",
    ) + f"""
SELECT CAST(draw AS VARCHAR) AS iter, 'data' AS mean, entity, round(q, 6) + 0.0 AS q, round(exp(ll), 6) + 0.0 AS \"lambda\"
FROM sc WHERE draw IN {sampled('given', 'draw', N_SAMPLED, V.SEED)}
UNION ALL SELECT 'mean', 'mean', entity, round(avg(q), 6) + 0.0, round(exp(avg(ll)), 6) + 0.0 FROM sc GROUP BY entity""",
    "many_report": f"""
WITH d AS (
  SELECT 'machine ' || (vec_id % 4 + 1) AS machine_no, CAST(embedding AS DOUBLE[]) AS e, unnest(range(1, 33)) AS t
  FROM embeddings),
v AS (SELECT machine_no, 'y_probs' AS item, t, exp(e[t]) AS value FROM d
      UNION ALL SELECT machine_no, 'r_probs', t, e[t + 32] FROM d)
SELECT machine_no, item, CAST(DATE '2021-01-01' + to_months(CAST(t - 1 AS INTEGER)) AS DATE) AS date, {CUTS}
FROM v GROUP BY machine_no, item, t""",
}
