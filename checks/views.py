"""The domain's tables as views over the generated test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from fieldcast.operators import panel as P, states as S
from fieldcast.operators.simulate import spread
from fieldcast.sources.constants import constant_table

FAMILIES = ["feeder_1", "feeder_2", "finisher_1", "finisher_2"]
GROUPS = {"feeder": FAMILIES[:2], "finisher": FAMILIES[2:]}
ROUTES = [
    ("ECONOMY", "A", "feeder_1", 1),
    ("SMALL", "A", "feeder_2", 2),
    ("PROMO", "N", "finisher_1", 3),
    ("PROMO", "R", "finisher_1", 3),
    ("LARGE", "N", "finisher_1", 3),
    ("LARGE", "R", "finisher_1", 3),
    ("MEDIUM", "N", "finisher_2", 4),
    ("MEDIUM", "R", "finisher_2", 4),
    ("STANDARD", "N", "finisher_2", 4),
    ("STANDARD", "R", "finisher_2", 4),
]
TOKENS = {"feeder_1": "urgent", "feeder_2": "high", "finisher_1": "_o", "finisher_2": "_f"}
CALENDAR_START = "1996-01-01"
HORIZON = 30
SEED = 1234


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def day(column: str):
    return F.col(column).cast("date")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Service events with their attachment (no delivery date, one join)."""
    lines = table(spark, sf_dir, "lineitem")
    parts = table(spark, sf_dir, "part")
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("machine_id"),
        F.col("p_partkey").alias("device_code"),
        F.col("p_type").alias("attachment"),
        F.col("p_brand").alias("sc_name"),
        F.col("p_name").alias("phenomenon"),
        F.col("l_returnflag").alias("location"),
        (F.col("l_linestatus") == "O").alias("is_em"),
        day("l_shipdate").alias("event_date"),
        F.col("l_quantity").alias("work_hours"),
    )


def dated_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the delivery date of the machine."""
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("machine_id"), day("o_orderdate").alias("due_date")
    )
    return events(spark, sf_dir).join(orders, "machine_id")


def machines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("machine_id"),
        F.col("o_custkey").alias("customer"),
        day("o_orderdate").alias("delivery_date"),
        F.col("o_orderpriority").alias("feeder"),
        F.col("o_orderstatus").alias("finisher"),
    )


def routing(spark: SparkSession) -> DataFrame:
    return constant_table(
        spark, ROUTES, "attachment string, location string, family string, ord int"
    )


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.routed_daily(
        events(spark, sf_dir), routing(spark), "attachment", "location", "event_date"
    )


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.daily_deliveries(
        machines(spark, sf_dir), "delivery_date", ["feeder", "finisher"]
    )


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.token_base(
        deliveries(spark, sf_dir), "delivery_date", F.concat_ws("_", "feeder", "finisher"), TOKENS
    )


def last_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: the last event day."""
    return table(spark, sf_dir, "lineitem").agg(F.max(day("l_shipdate")).alias("end"))


def dates(spark: SparkSession, sf_dir: str, ahead: int = 0) -> DataFrame:
    return P.calendar(
        last_day(spark, sf_dir), F.lit(CALENDAR_START).cast("date"), F.date_add("end", ahead)
    )


def panel(spark: SparkSession, sf_dir: str, carry_in: bool = False) -> DataFrame:
    return P.daily_panel(
        dates(spark, sf_dir), counts(spark, sf_dir), base(spark, sf_dir), FAMILIES, carry_in
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per draw with its values as doubles."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("int").alias("draw"),
        (F.col("vec_id") % 4 + 1).cast("int").alias("chain"),
        F.floor(F.col("vec_id") / 4).cast("int").alias("iteration"),
        F.col("embedding").cast("array<double>").alias("e"),
        "label",
    )


def draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long draws of one vector variable, ``i1`` from 1."""
    return vectors(spark, sf_dir).select(
        "chain", "iteration", "draw", F.posexplode_outer("e").alias("i1", "value")
    ).withColumn("i1", F.col("i1") + 1)


def chain_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Autocorrelated draws of eight variables with ties; the last chain is shorter."""
    rows = draws(spark, sf_dir).where("i1 <= 8 AND value IS NOT NULL")
    rows = rows.where("chain < 4 OR iteration <= 80")
    chain = Window.partitionBy("i1", "chain").orderBy("iteration")
    before = [F.coalesce(F.lag("value", k).over(chain), F.lit(0.0)) for k in (1, 2)]
    value = F.round(F.col("value") + 0.8 * before[0] + 0.5 * before[1], 2)
    return rows.select("i1", "chain", "iteration", "draw", value.alias("value"))


def forecast_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen values of a vector per (draw, series)."""
    slots = vectors(spark, sf_dir).select(
        "draw",
        F.posexplode_outer(F.array(*[F.slice("e", 1 + 16 * n, 16) for n in range(4)])).alias("n", "p"),
    )

    def p(i: int):
        return F.col("p")[i]

    return slots.select(
        "draw",
        (F.col("n") + 1).alias("series"),
        p(0).alias("intercept"),
        p(1).alias("b_ar"),
        F.abs(p(2)).alias("s_z"),
        F.abs(p(3)).alias("s_s"),
        F.abs(p(4)).alias("s_r"),
        F.abs(p(5)).alias("s_t"),
        p(6).alias("mu_prev"),
        p(7).alias("mu_last"),
        p(8).alias("b_last"),
        *[p(8 + i).alias(f"g{i}") for i in range(1, 7)],
        (1.0 + F.abs(p(15))).alias("num_last"),
    )


# parameters of the reconstructed states
INTERCEPT, SLOPE, LEVEL, SEASON, EFFECT, WALK = 0.1, 0.6, 0.5, 0.4, 0.3, 0.2
N_MAX = 8.0


def state_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Innovations of one series per draw, read from its vector in four ways."""
    e = F.col("e")
    return spread(vectors(spark, sf_dir), ["draw"]).select(
        "draw",
        "chain",
        F.lit(INTERCEPT).alias("intercept"),
        F.lit(SLOPE).alias("b_ar"),
        F.lit(LEVEL).alias("s_z"),
        F.lit(SEASON).alias("s_s"),
        F.lit(EFFECT).alias("s_r"),
        F.lit(WALK).alias("s_t"),
        e.alias("mu_err"),
        F.reverse(e).alias("b_ope_err"),
        F.concat(F.slice(e, 17, 48), F.slice(e, 1, 16)).alias("r_raw"),
        F.slice(F.concat(F.slice(e, 33, 32), F.slice(e, 1, 32)), 1, 58).alias("gamma_err"),
        F.transform(e, lambda v, i: (i + 1) / 64.0).alias("num"),
    )


def state_rows(spark: SparkSession, sf_dir: str, variant: str = "smooth") -> DataFrame:
    states = S.reconstruct(state_parameters(spark, sf_dir), variant)
    return S.explode_states(states, ["draw", "chain"])


def coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coefficient draws: values alternate between the two parts of a term."""
    i = F.col("i1") - 1
    return draws(spark, sf_dir).select(
        "draw",
        (i % 2 + 1).alias("part"),
        F.floor(i / 2).cast("int").alias("term_ord"),
        F.concat(F.lit("t"), F.lpad(F.floor(i / 2).cast("string"), 2, "0")).alias("term"),
        "value",
    )
