"""Panels, reshaping, reports and the batch monitor."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks import sql as Q, views as V
from fieldcast.operators import monitor as M, panel as P, reports as R
from fieldcast.operators.clean import column_maxima as maxima, keep_first
from fieldcast.operators.draws import INTERVAL
from fieldcast.operators.ranking import bounded_quantiles
from fieldcast.operators.stored import shared_folder
from fieldcast.sources import manifest, products


def r6(name, alias=None):
    column = F.col(name) if isinstance(name, str) else name
    return (F.round(column, 6) + F.lit(0.0)).alias(alias or name)


def routed_daily(spark, sf):
    return V.counts(spark, sf)


def daily_deliveries(spark, sf):
    return V.deliveries(spark, sf)


def daily_machines(spark, sf):
    return P.daily_distinct(V.machines(spark, sf), "delivery_date", "customer")


def token_base(spark, sf):
    return V.base(spark, sf)


def main_body_daily(spark, sf):
    rows = V.events(spark, sf).withColumn(
        "attachment", F.when(F.col("attachment") != "SMALL", F.col("attachment"))
    )
    whole = P.main_body_daily(rows, "attachment", "event_date")
    chosen = P.main_body_daily(rows, "attachment", "event_date", "phenomenon", "red widget")
    return whole.withColumn("scope", F.lit("all")).unionByName(
        chosen.withColumn("scope", F.lit("red widget"))
    )


def top_phenomena(spark, sf):
    return R.top_categories(V.events(spark, sf), "phenomenon", 15)


def top_days(spark, sf):
    daily = V.table(spark, sf, "lineitem").groupBy(V.day("l_shipdate").alias("date")).agg(
        F.count(F.lit(1)).alias("em")
    )
    return R.top_days(daily, 20)


def daily_panel(spark, sf):
    return V.panel(spark, sf)


def daily_panel_carry_in(spark, sf):
    return V.panel(spark, sf, carry_in=True)


def full_panel(spark, sf):
    return P.full_panel(
        V.dates(spark, sf), V.counts(spark, sf), V.base(spark, sf), V.FAMILIES
    )


def panel_window(spark, sf):
    start, end = (F.lit(d).cast("date") for d in ("1998-01-01", "1998-12-31"))
    return P.window_slice(V.panel(spark, sf), start, end)


def report_window(spark, sf):
    end = V.last_day(spark, sf).scalar()
    spine = P.spine(V.dates(spark, sf, V.HORIZON), V.FAMILIES)
    rows = spine.join(V.counts(spark, sf), ["series", "date"], "left")
    return R.report_window(rows, end, V.HORIZON)


def pivot_daily(spark, sf):
    return P.pivot_counts(V.counts(spark, sf), V.FAMILIES)


FEEDERS = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
PAIRS = {f"{f}_{s}": f"n_{f[0]}_{s.lower()}" for f in FEEDERS for s in ("F", "O", "P")}


def pivot_pair(spark, sf):
    named = V.deliveries(spark, sf).select(
        F.col("delivery_date").alias("date"), F.concat_ws("_", "feeder", "finisher").alias("pair"), "n"
    )
    wide = named.groupBy("date").pivot("pair", list(PAIRS)).agg(F.sum("n"))
    return wide.fillna(0).withColumnsRenamed(PAIRS)


def daily_long(spark, sf):
    return P.unpivot_counts(P.pivot_counts(V.counts(spark, sf), V.FAMILIES))


def family_split(spark, sf):
    rows = M.split_groups(V.panel(spark, sf), V.GROUPS)
    return rows.groupBy("grp", "date").agg(F.sum("em").alias("em"))


def series_totals(spark, sf):
    return V.counts(spark, sf).groupBy("series").agg(
        F.sum("em").alias("em"), F.min("date").alias("first"), F.max("date").alias("last")
    )


def scale_by_max(spark, sf):
    return P.scale_by_max(V.panel(spark, sf), "mif_cum").select(
        "series", "date", "n_max", r6("num")
    )


def series_arrays(spark, sf):
    arrays = P.series_arrays(P.scale_by_max(V.panel(spark, sf), "mif_cum"))
    rows = arrays.select(
        "series", "start", "t", "n_max", F.posexplode(F.arrays_zip("y", "num")).alias("i", "z")
    )
    return rows.select(
        "series", "start", "t", "n_max", (F.col("i") + 1).alias("i"),
        F.col("z.y").alias("y"), r6("z.num", "num"),
    )


def monthly_cells(spark, sf):
    """Monthly counts per code from the first to the last month with an event; months without one are null."""
    month = F.year("l_shipdate") * 12 + F.month("l_shipdate")
    lines = V.table(spark, sf, "lineitem")
    bounds = lines.agg(F.min(month).alias("first"), (F.max(month) - F.min(month) + 1).alias("length")).first()
    first, length = bounds["first"] or 0, F.lit(bounds["length"] or 0)
    monthly = V.events(spark, sf).groupBy(
        F.col("sc_name").alias("machine_no"),
        (F.year("event_date") * 12 + F.month("event_date")).alias("m"),
    ).agg(F.count(F.lit(1)).cast("int").alias("n")).withColumn("m", F.col("m") - first + 1)
    cells = monthly.groupBy("machine_no").agg(
        F.map_from_entries(F.collect_list(F.struct("m", "n"))).alias("__cells")
    )
    return cells.select(
        "machine_no",
        F.transform(
            F.sequence(F.lit(1), length), lambda i: F.try_element_at("__cells", i)
        ).alias("y"),
    )


def observed_cells(spark, sf):
    """Series 2 to 40 in name order, clipped to the ones that exist."""
    series = monthly_cells(spark, sf)
    ranked = series.select("machine_no", "y", F.regexp_extract("machine_no", r"(\d+)$", 1).cast("int").alias("no"))
    sliced = ranked.where(F.col("no").between(2, 40))
    rows = P.observed_cells(sliced, "machine_no", "y")
    return rows.select(
        "machine_no", "len_obs", "total_obs", F.array_join("obs_no", ",").alias("obs_no")
    )


def measured_future(spark, sf):
    end = V.last_day(spark, sf).scalar()
    daily = V.table(spark, sf, "lineitem").groupBy(V.day("l_shipdate").alias("date")).agg(
        F.count(F.lit(1)).alias("em")
    )
    base = P.daily_distinct(V.machines(spark, sf), "delivery_date", "customer").withColumnRenamed(
        "delivery_date", "date"
    )
    return P.measured_and_future(V.dates(spark, sf, V.HORIZON), daily, base, end)


def code_share(spark, sf):
    rows = V.events(spark, sf).where((F.col("location") == "A") & (F.col("attachment") == "ECONOMY"))
    shares = R.code_share(rows, F.year("event_date"), "sc_name", 20)
    return shares.select("period", "code", "n_code", "n_period", r6("share"))


def first_lines(spark, sf):
    """The first line of each order by its day, then by its number."""
    rows = V.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", V.day("l_shipdate").alias("day"), "l_partkey", "l_quantity"
    )
    return keep_first(rows, ["l_orderkey"], ["day", "l_linenumber", "l_partkey", "l_quantity"])


def column_maxima(spark, sf):
    return maxima(V.table(spark, sf, "lineitem"), ["l_returnflag"])


CUT, BACK = "2001-06-01", 90


def interval_breach(spark, sf):
    cut = F.lit(CUT).cast("date")
    rows = V.panel(spark, sf).select("series", "date", "em")
    history = rows.where(F.col("date").between(F.date_sub(cut, BACK), F.date_sub(cut, 1)))
    limits = bounded_quantiles(history, ["series"], "em", INTERVAL)
    judged = rows.where(F.col("date") >= cut)
    out = M.breaches(judged, limits, ["series"])
    return out.select("series", "date", "em", r6("lwr"), r6("fit"), r6("upr"))


#: days on which a forecast is made, and how many days it reaches
RUN_DAYS, REACH = ("2001-04-01", "2001-05-16", "2001-06-01"), 60


def forecast_overlay(spark, sf):
    """Daily counts against the newest of several stored forecasts made before each day."""
    path = f"{shared_folder(spark)}/forecasts-{uuid.uuid4().hex}"
    rows = V.panel(spark, sf).select("series", "date", "em")
    for i, text in enumerate((*RUN_DAYS, RUN_DAYS[0])):  # the first run is written twice
        made = F.lit(text).cast("date")
        history = rows.where(F.col("date").between(F.date_sub(made, BACK), made))
        limits = bounded_quantiles(history, ["series"], "em", INTERVAL)
        days = F.sequence(F.date_add(made, 1), F.date_add(made, REACH))
        future = limits.withColumn("date", F.explode(days)).withColumn("is_future", F.lit(True))
        products.write_forecast(future, path, f"run-{text}", made)
    manifest.write_attempt(rows.select("series", "date"), path)  # an attempt that was never committed
    out = M.overlay(rows, M.as_of(products.read_forecasts(spark, path)))
    return out.select("series", "date", "run_id", "em", r6("lwr"), r6("fit"), r6("upr"), "breach")


QUERIES = {
    f.__name__: f
    for f in (
        routed_daily, daily_deliveries, daily_machines, token_base, main_body_daily,
        top_phenomena, top_days, daily_panel, daily_panel_carry_in, full_panel, panel_window,
        report_window, pivot_daily, pivot_pair, daily_long, family_split, series_totals,
        scale_by_max, series_arrays, observed_cells, measured_future, code_share,
        interval_breach, forecast_overlay, first_lines, column_maxima,
    )
}

PANEL = Q.with_(*Q.PANEL_CTES)
ROUTED = Q.with_(Q.EV, Q.ROUTING, Q.COUNTS)
FUTURE_DATES = Q.DATES.replace("AS TIMESTAMP) FROM lineitem)", f"AS TIMESTAMP) + INTERVAL {V.HORIZON} DAY FROM lineitem)")
LAST = "(SELECT max(CAST(l_shipdate AS DATE)) FROM lineitem)"

SQL = {
    "routed_daily": ROUTED + "SELECT series, date, em FROM counts",
    "daily_deliveries": """
SELECT CAST(o_orderdate AS DATE) AS delivery_date, o_orderpriority AS feeder,
  o_orderstatus AS finisher, count(*) AS n FROM orders GROUP BY 1, 2, 3""",
    "daily_machines": """
SELECT CAST(o_orderdate AS DATE) AS delivery_date, count(DISTINCT o_custkey) AS n
FROM orders GROUP BY 1""",
    "token_base": Q.with_(Q.TOKENS, Q.BASE) + "SELECT series, date, n FROM base",
    "main_body_daily": Q.with_(Q.EV) + """
SELECT event_date AS date, count(*) AS em, 'all' AS scope FROM ev
WHERE attachment = 'SMALL' GROUP BY 1
UNION ALL SELECT event_date, count(*), 'red widget' FROM ev
WHERE attachment = 'SMALL' AND phenomenon = 'red widget' GROUP BY 1""",
    "top_phenomena": Q.with_(Q.EV) + """
SELECT phenomenon, count(*) AS n FROM ev WHERE phenomenon IS NOT NULL
GROUP BY 1 ORDER BY n DESC, phenomenon LIMIT 15""",
    "top_days": """
SELECT CAST(l_shipdate AS DATE) AS date, count(*) AS em FROM lineitem
GROUP BY 1 ORDER BY em DESC, date LIMIT 20""",
    "daily_panel": PANEL + "SELECT series, date, em, mif_cum FROM panel",
    "daily_panel_carry_in": PANEL + f"""
SELECT p.series, date, em, mif_cum + coalesce(seed, 0) AS mif_cum
FROM panel p LEFT JOIN (
  SELECT series, CAST(sum(n) AS BIGINT) AS seed FROM base
  WHERE date < DATE '{V.CALENDAR_START}' GROUP BY 1) s ON s.series = p.series""",
    "full_panel": Q.with_(*Q.PANEL_CTES[:-1], """keys AS (
  SELECT date, min(part) AS part FROM (
    SELECT date, 0 AS part FROM dates UNION ALL SELECT date, 1 FROM base
    UNION ALL SELECT date, 2 FROM counts) GROUP BY 1)""") + """
SELECT fam.series, keys.date, CAST(coalesce(em, 0) AS BIGINT) AS em,
  CAST(sum(coalesce(n, 0)) OVER (PARTITION BY fam.series ORDER BY part, keys.date
       ROWS UNBOUNDED PRECEDING) AS BIGINT) AS mif_cum, CAST(part AS INTEGER) AS part
FROM keys CROSS JOIN fam
LEFT JOIN counts ON counts.series = fam.series AND counts.date = keys.date
LEFT JOIN base ON base.series = fam.series AND base.date = keys.date""",
    "panel_window": PANEL + """
SELECT series, date, em, mif_cum, CAST(date - DATE '1998-01-01' + 1 AS INTEGER) AS t
FROM panel WHERE date BETWEEN DATE '1998-01-01' AND DATE '1998-12-31'""",
    "report_window": Q.with_(Q.EV, Q.ROUTING, Q.SERIES, Q.COUNTS, FUTURE_DATES) + f"""
SELECT fam.series, dates.date, em, dates.date > {LAST} AS is_future
FROM dates CROSS JOIN fam
LEFT JOIN counts ON counts.series = fam.series AND counts.date = dates.date
WHERE dates.date BETWEEN {LAST} - 182 AND {LAST} + {V.HORIZON}""",
    "pivot_daily": ROUTED + "SELECT date, " + ", ".join(
        f"CAST(coalesce(sum(CASE WHEN series = '{s}' THEN em END), 0) AS BIGINT) AS \"EM_{s}\""
        for s in V.FAMILIES
    ) + " FROM counts GROUP BY 1",
    "pivot_pair": "SELECT CAST(o_orderdate AS DATE) AS date, " + ", ".join(
        f"count(*) FILTER (WHERE o_orderpriority || '_' || o_orderstatus = '{pair}') AS {alias}"
        for pair, alias in PAIRS.items()
    ) + " FROM orders GROUP BY 1",
    "daily_long": Q.with_(Q.EV, Q.ROUTING, Q.SERIES, Q.COUNTS) + """
SELECT d.date, fam.series, CAST(coalesce(em, 0) AS BIGINT) AS em
FROM (SELECT DISTINCT date FROM counts) d CROSS JOIN fam
LEFT JOIN counts ON counts.series = fam.series AND counts.date = d.date""",
    "family_split": PANEL + """
SELECT CASE WHEN series LIKE 'feeder%' THEN 'feeder' ELSE 'finisher' END AS grp, date,
  CAST(sum(em) AS BIGINT) AS em FROM panel GROUP BY 1, 2""",
    "series_totals": ROUTED + """
SELECT series, CAST(sum(em) AS BIGINT) AS em, min(date) AS first, max(date) AS last
FROM counts GROUP BY 1""",
    "scale_by_max": PANEL + """
SELECT series, date, max(mif_cum) OVER (PARTITION BY series) AS n_max,
  round(CASE WHEN max(mif_cum) OVER (PARTITION BY series) > 0
    THEN CAST(mif_cum AS DOUBLE) / max(mif_cum) OVER (PARTITION BY series) ELSE 0 END, 6) + 0.0 AS num
FROM panel""",
    "series_arrays": PANEL + """
SELECT series, min(date) OVER w AS start, CAST(count(*) OVER w AS INTEGER) AS t,
  CAST(max(mif_cum) OVER w AS DOUBLE) AS n_max,
  CAST(row_number() OVER (PARTITION BY series ORDER BY date) AS INTEGER) AS i,
  CAST(em AS INTEGER) AS y,
  round(CASE WHEN max(mif_cum) OVER w > 0
    THEN CAST(mif_cum AS DOUBLE) / max(mif_cum) OVER w ELSE 0 END, 6) + 0.0 AS num
FROM panel WINDOW w AS (PARTITION BY series)""",
    "observed_cells": Q.with_(Q.EV) + f"""
SELECT machine_no, count(*) AS len_obs, CAST(sum(count(*)) OVER () AS BIGINT) AS total_obs,
  string_agg(CAST(m AS VARCHAR), ',' ORDER BY m) AS obs_no
FROM (SELECT DISTINCT sc_name AS machine_no,
        year(event_date) * 12 + month(event_date)
          - (SELECT min(year(event_date) * 12 + month(event_date)) FROM ev) + 1 AS m FROM ev)
WHERE CAST(regexp_extract(machine_no, '(\\d+)$', 1) AS INTEGER) BETWEEN 2 AND 40
GROUP BY 1""",
    "measured_future": Q.with_(FUTURE_DATES) + f"""
SELECT dates.date, CASE WHEN dates.date <= {LAST} THEN coalesce(n, 0) ELSE n END AS n,
  CASE WHEN dates.date <= {LAST} THEN coalesce(em, 0) ELSE em END AS em
FROM dates
LEFT JOIN (SELECT CAST(o_orderdate AS DATE) AS date, count(DISTINCT o_custkey) AS n
           FROM orders GROUP BY 1) b ON b.date = dates.date
LEFT JOIN (SELECT CAST(l_shipdate AS DATE) AS date, count(*) AS em
           FROM lineitem GROUP BY 1) c ON c.date = dates.date""",
    "code_share": Q.with_(Q.EV, """c AS (
  SELECT CAST(year(event_date) AS INTEGER) AS period, sc_name AS code, count(*) AS n
  FROM ev WHERE location = 'A' AND attachment = 'ECONOMY' GROUP BY 1, 2)""", """l AS (
  SELECT period, CASE WHEN n < 20 THEN 'other' ELSE code END AS code, n,
    sum(n) OVER (PARTITION BY period) AS n_period FROM c)""") + """
SELECT period, code, CAST(sum(n) AS BIGINT) AS n_code, CAST(max(n_period) AS BIGINT) AS n_period,
  round(CAST(sum(n) AS DOUBLE) / CAST(max(n_period) AS DOUBLE), 6) + 0.0 AS share
FROM l GROUP BY 1, 2""",
    "first_lines": """
SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS day, l_partkey, l_quantity FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY day, l_linenumber, l_partkey, l_quantity) = 1""",
    "column_maxima": " UNION ALL ".join(
        f"SELECT l_returnflag, '{c}' AS name, CAST(max({c}) AS DOUBLE) AS maximum FROM lineitem GROUP BY 1"
        for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                  "l_discount", "l_tax")
    ),
    "forecast_overlay": Q.with_(
        *Q.PANEL_CTES,
        "runs(made) AS (VALUES " + ", ".join(f"(DATE '{d}')" for d in RUN_DAYS) + ")",
        f"""lim AS (
  SELECT made, series, quantile_cont(em, 0.025) AS lwr, quantile_cont(em, 0.5) AS fit,
    quantile_cont(em, 0.975) AS upr FROM runs JOIN panel ON date BETWEEN made - {BACK} AND made GROUP BY 1, 2)""",
    ) + f"""
SELECT p.series, date, 'run-' || made AS run_id, em, round(lwr, 6) + 0.0 AS lwr, round(fit, 6) + 0.0 AS fit,
  round(upr, 6) + 0.0 AS upr, em < lwr OR em > upr AS breach
FROM panel p JOIN lim ON lim.series = p.series AND date > made AND date <= made + {REACH}
QUALIFY row_number() OVER (PARTITION BY p.series, date ORDER BY made DESC) = 1""",
    "interval_breach": Q.with_(*Q.PANEL_CTES, f"""lim AS (
  SELECT series, quantile_cont(em, 0.025) AS lwr, quantile_cont(em, 0.5) AS fit,
    quantile_cont(em, 0.975) AS upr FROM panel
  WHERE date BETWEEN DATE '{CUT}' - {BACK} AND DATE '{CUT}' - 1 GROUP BY 1)""") + f"""
SELECT p.series, date, em, round(lwr, 6) + 0.0 AS lwr, round(fit, 6) + 0.0 AS fit,
  round(upr, 6) + 0.0 AS upr
FROM panel p JOIN lim ON lim.series = p.series
WHERE date >= DATE '{CUT}' AND (em < lwr OR em > upr)""",
}
