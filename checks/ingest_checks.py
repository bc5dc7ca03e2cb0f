"""Scans, cleaning, parsing and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import sql as Q, views as V
from fieldcast.functions import dates as D, text as X
from fieldcast.operators import attach as A, clean as C


def scan_events(spark, sf):
    return V.table(spark, sf, "events").select(
        "event_id", "user_id", "event_type", "value", V.day("ts").alias("event_date")
    )


def clean_events(spark, sf):
    rows = C.keep_emergencies(V.dated_events(spark, sf), "is_em")
    return (
        rows.select(
            "machine_id", "attachment", "sc_name", "phenomenon", "location", "event_date",
            "due_date", "work_hours",
        )
        .withColumnsRenamed(
            {
                "machine_id": "Machine_numbers",
                "attachment": "Peripheral_name",
                "sc_name": "SC_name",
                "phenomenon": "Phenomenon",
                "location": "Treatment_location",
                "event_date": "Maintenance_date",
                "due_date": "Due_date",
                "work_hours": "CE_Working_hours",
            }
        )
        .dropna(subset=["Maintenance_date", "Due_date"])
        .distinct()
    )


def drop_empty_cols(spark, sf):
    rows = V.table(spark, sf, "orders").select(
        "o_orderkey", "o_orderstatus", F.when(F.col("o_orderkey") < 0, "x").alias("blank")
    )
    return C.drop_empty_columns(rows)


def null_report(spark, sf):
    rows = V.table(spark, sf, "lineitem").select(
        F.when(F.col("l_quantity") % 7 != 0, V.day("l_shipdate")).alias("event_date"),
        F.when(F.col("l_linenumber") % 5 != 0, F.col("l_quantity")).alias("work_hours"),
        F.col("l_orderkey").alias("machine_id"),
    )
    return C.null_report(rows, ["event_date", "work_hours", "machine_id"])


FLAG_WORDS = {"AF": "T", "AO": "True", "NF": "FALSE", "NO": "f", "RF": "x", "RO": "1"}


def bool_cast(spark, sf):
    key = F.concat("l_returnflag", "l_linestatus")
    text = F.coalesce(*[F.when(key == k, F.lit(w)) for k, w in FLAG_WORDS.items()])
    rows = V.table(spark, sf, "lineitem").select(text.alias("text"))
    return (
        rows.withColumn("flag", X.to_boolean(F.col("text")))
        .groupBy("text", "flag")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def parse_dates(spark, sf):
    ship = F.col("l_shipdate")
    rows = V.table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.when(F.col("l_linenumber") == 7, "20201399")
        .otherwise(F.date_format(ship, "yyyyMMdd")).alias("day_text"),
        F.when(F.col("l_linenumber") == 6, "2020")
        .otherwise(F.date_format(ship, "yyyyMM")).alias("month_text"),
    )
    mixed = F.when(F.col("l_linenumber") % 2 == 0, F.col("day_text")).otherwise(
        F.col("month_text")
    )
    return rows.select(
        "l_orderkey",
        "l_linenumber",
        D.parse_day(F.col("day_text")).alias("day"),
        D.parse_month(F.col("month_text")).alias("month"),
        D.parse_compact_date(mixed).alias("adaptive"),
    )


def service_age(spark, sf):
    due, done = F.col("due_date"), F.col("event_date")
    return V.dated_events(spark, sf).select(
        "machine_id",
        "due_date",
        "event_date",
        D.month_start(done).alias("maintenance_month"),
        D.month_span(due, done).alias("working_months"),
        D.month_span(F.lit("1994-12-01").cast("date"), D.month_start(due)).alias("elapsed_months"),
    )


def attach_devices(spark, sf):
    raw = V.table(spark, sf, "lineitem").select(
        F.lit("M").alias("model"),
        F.col("l_orderkey").alias("serial"),
        F.concat(F.lit(" "), F.col("l_partkey").cast("string"), F.lit(" \t")).alias("code"),
    )
    master = V.table(spark, sf, "part").select(
        F.col("p_partkey").alias("master_code"), F.col("p_type").alias("name")
    )
    return A.name_attachments(
        raw, master, "code", "master_code", ["model", "serial"], "machine_key"
    ).select("machine_key", "code", "name")


def standard_config(spark, sf):
    machines = V.table(spark, sf, "orders").select(
        F.substring("o_orderpriority", 1, 1).alias("model"),
        F.col("o_orderkey").cast("string").alias("serial"),
        F.when(F.col("o_orderstatus") == "F", "ADF").otherwise("FIN").alias("cls"),
        F.concat(F.lit("N-"), "o_orderstatus").alias("name"),
    )
    standard = V.table(spark, sf, "nation").select(
        (F.col("n_regionkey") + 1).cast("string").alias("std_model"),
        (F.col("n_nationkey") % 10).alias("digit"),
        F.when(F.col("n_nationkey") % 3 != 0, F.col("n_name")).alias("std_name"),
    )
    return A.apply_standard_configuration(
        machines, standard, "model", "serial", "cls", "name", "ADF", "std_model", "digit", "std_name"
    ).select("model", "serial", "cls", "name")


def event_attach(spark, sf):
    events = V.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("machine_id"),
        V.day("l_shipdate").alias("event_date"),
        F.col("l_returnflag").alias("location"),
    )
    attachments = V.events(spark, sf).select("machine_id", "attachment")
    return A.attach_to_events(events, attachments, "machine_id", ["attachment"])


def missing_levels(spark, sf):
    parts = V.table(spark, sf, "part").select(F.col("p_type").alias("level"))
    extra = F.explode(F.array(F.col("level"), F.concat(F.col("level"), F.lit(" HY"))))
    expected = V.events(spark, sf).select(F.col("attachment").alias("level")).distinct()
    return C.missing_levels(parts, expected.select(extra.alias("level")), ["level"])


def distinct_levels(spark, sf):
    return C.distinct_levels(V.events(spark, sf), ["attachment", "location", "sc_name"])


QUERIES = {
    f.__name__: f
    for f in (
        scan_events, clean_events, drop_empty_cols, null_report, bool_cast, parse_dates,
        service_age, attach_devices, standard_config, event_attach, missing_levels,
        distinct_levels,
    )
}

SPAN = """CASE WHEN {b} < {a} THEN -1 ELSE len(list_filter(
    generate_series(0, (year({b}) - year({a})) * 12 + month({b}) - month({a})),
    lambda k: date_trunc('month', {a}) + to_months(CAST(k AS INTEGER))
         + to_days(CAST(day({a}) AS INTEGER) - 1) <= {b})) - 1 END"""


def span(a: str, b: str) -> str:
    return SPAN.format(a=a, b=b)


SQL = {
    "scan_events": """
SELECT event_id, user_id, event_type, value, CAST(ts AS DATE) AS event_date FROM events""",
    "clean_events": Q.with_(Q.EV, Q.EVD) + """
SELECT DISTINCT machine_id AS "Machine_numbers", attachment AS "Peripheral_name",
  sc_name AS "SC_name", phenomenon AS "Phenomenon", location AS "Treatment_location",
  event_date AS "Maintenance_date", due_date AS "Due_date", work_hours AS "CE_Working_hours"
FROM evd WHERE is_em AND event_date IS NOT NULL AND due_date IS NOT NULL""",
    "drop_empty_cols": "SELECT o_orderkey, o_orderstatus FROM orders",
    "null_report": """
SELECT count(*) FILTER (WHERE l_quantity % 7 = 0 OR l_shipdate IS NULL) AS event_date,
       count(*) FILTER (WHERE l_linenumber % 5 = 0 OR l_quantity IS NULL) AS work_hours,
       count(*) FILTER (WHERE l_orderkey IS NULL) AS machine_id
FROM lineitem""",
    "bool_cast": """
SELECT text, CASE WHEN text IN ('T', 'True') THEN true WHEN text = 'FALSE' THEN false END AS flag,
       count(*) AS n
FROM (SELECT CASE l_returnflag || l_linestatus WHEN 'AF' THEN 'T' WHEN 'AO' THEN 'True'
             WHEN 'NF' THEN 'FALSE' WHEN 'NO' THEN 'f' WHEN 'RF' THEN 'x' WHEN 'RO' THEN '1' END
             AS text FROM lineitem) GROUP BY 1, 2""",
    "parse_dates": """
WITH t AS (
  SELECT l_orderkey, l_linenumber,
    CASE WHEN l_linenumber = 7 THEN '20201399' ELSE strftime(l_shipdate, '%Y%m%d') END AS d,
    CASE WHEN l_linenumber = 6 THEN '2020' ELSE strftime(l_shipdate, '%Y%m') END AS m
  FROM lineitem)
SELECT l_orderkey, l_linenumber, CAST(try_strptime(d, '%Y%m%d') AS DATE) AS day,
  CASE WHEN length(m) = 6 THEN CAST(try_strptime(m || '01', '%Y%m%d') AS DATE) END AS month,
  CASE WHEN l_linenumber % 2 = 0 THEN CAST(try_strptime(d, '%Y%m%d') AS DATE)
       WHEN length(m) = 6 THEN CAST(try_strptime(m || '01', '%Y%m%d') AS DATE) END AS adaptive
FROM t""",
    "service_age": Q.with_(Q.EV, Q.EVD) + f"""
SELECT machine_id, due_date, event_date,
  CAST(date_trunc('month', event_date) AS DATE) AS maintenance_month,
  CAST({span('due_date', 'event_date')} AS INTEGER) AS working_months,
  CAST(datediff('month', DATE '1994-12-01', due_date) AS INTEGER) AS elapsed_months
FROM evd""",
    "attach_devices": """
SELECT DISTINCT 'M' || l_orderkey AS machine_key, CAST(l_partkey AS VARCHAR) AS code,
  p_type AS name
FROM lineitem LEFT JOIN part ON l_partkey = p_partkey""",
    "standard_config": """
WITH m AS (
  SELECT substr(o_orderpriority, 1, 1) AS model, CAST(o_orderkey AS VARCHAR) AS serial,
    CASE WHEN o_orderstatus = 'F' THEN 'ADF' ELSE 'FIN' END AS cls, 'N-' || o_orderstatus AS name
  FROM orders),
s AS (
  SELECT CAST(n_regionkey + 1 AS VARCHAR) AS model, CAST(n_nationkey % 10 AS DOUBLE) AS digit,
    CASE WHEN n_nationkey % 3 <> 0 THEN n_name END AS std FROM nation)
SELECT DISTINCT m.model, serial, cls,
  CASE WHEN cls = 'ADF' AND std IS NOT NULL THEN std ELSE name END AS name
FROM m LEFT JOIN s ON m.model = s.model AND TRY_CAST(substr(serial, 1, 1) AS DOUBLE) = digit""",
    "event_attach": Q.with_(Q.EV) + """
SELECT DISTINCT l.l_orderkey AS machine_id, CAST(l.l_shipdate AS DATE) AS event_date,
  l.l_returnflag AS location, ev.attachment
FROM lineitem l LEFT JOIN ev ON ev.machine_id = l.l_orderkey""",
    "missing_levels": Q.with_(
        Q.EV,
        "e AS (SELECT DISTINCT attachment AS level FROM ev)",
        "x AS (SELECT level FROM e UNION ALL SELECT level || ' HY' FROM e)",
    ) + "SELECT level FROM x EXCEPT SELECT p_type FROM part",
    "distinct_levels": Q.with_(Q.EV) + """
SELECT DISTINCT 'attachment' AS name, attachment AS level FROM ev
UNION SELECT DISTINCT 'location', location FROM ev
UNION SELECT DISTINCT 'sc_name', sc_name FROM ev""",
}
