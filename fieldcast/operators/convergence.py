"""Convergence of chains: split R-hat, rank-normalised R-hat, effective sample sizes and their errors.

Chains are cut in halves. Ranks come from one range sort of the counted values
(``ordering.ordered``) and a second one of their distances from the median, so
no group is gathered. Autocovariances are summed over blocks of a half chain:
a block meets the first draws of the next one, so all pairs of draws up to the
largest lag are seen once and a task holds a bounded stretch of one chain.
Four times as many lags follow for the groups whose sequence hasn't ended, and
only for them. Everything else works on one row per half chain or per lag.

Effective sizes follow the initial monotone sequence: sums of neighbouring
autocorrelations are taken while they are positive, each no larger than the
one before. ``ess_bulk`` is that of the normalised ranks, ``ess_tail`` the
smaller one of the indicators of the 5 % and 95 % quantiles, and
``mcse_mean`` the standard deviation over the root of the effective size of
the values themselves. Half chains may differ in length: autocovariances and
variances are averaged over half chains, the length over them too, and lags
end before the shortest one. Iterations that are missing, or draws that are
null, count as if they were at the mean. A constant has null results.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from fieldcast.functions.noise import normal_quantile
from fieldcast.operators.keys import join_null_safe
from fieldcast.operators.ordering import KEY, average_rank, key_struct, ordered, picks
from fieldcast.operators.stored import stored

#: draws of a half chain in one block, and lags of the first pass
BLOCK, LAGS = 4096, 127
#: makes the median distance from the median the standard deviation of a normal sample
MAD_SCALE = 1.4826
#: series of a draw whose autocovariances are summed
SERIES = ("bulk", "low", "high", "plain")


def with_halves(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Adds ``half`` (null for the middle iteration of an odd chain) and ``position`` inside it, from 0."""
    chain = [*(keys or []), "chain"]
    bounds = df.groupBy(*chain).agg(
        F.min("iteration").alias("__first"), F.max("iteration").alias("__last")
    )
    place = F.col("iteration") - F.col("__first")
    length = F.col("__last") - F.col("__first") + 1
    size = F.floor(length / 2)
    half = F.when(place < size, F.lit(1)).when(place >= length - size, F.lit(2))
    position = F.when(F.col("half") == 1, place).otherwise(place - (length - size))
    return (
        join_null_safe(df, bounds, chain)
        .withColumn("half", half)
        .withColumn("position", position)
        .drop("__first", "__last")
    )


def split_chains(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Adds ``half``: each chain cut in two at its middle iteration.

    With an odd number of iterations the middle one is left out, so both
    halves have the same length.  ``keys`` name what has chains of its own
    length, such as runs; without them all rows share the chains.
    """
    return with_halves(df, keys).where(F.col("half").isNotNull()).drop("position")


def _rhat(n: Column, between: Column, within: Column) -> Column:
    return F.sqrt(F.try_divide((n - 1) / n * within + between, within))


def rhat_split(split: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Potential scale reduction over the half chains; null for a constant."""
    halves = split.groupBy(*keys, "chain", "half").agg(
        F.count(value).alias("n"),
        F.avg(value).alias("m"),
        F.var_samp(value).alias("v"),
    )
    parts = halves.groupBy(*keys).agg(
        F.avg("n").alias("n"), F.var_samp("m").alias("b"), F.avg("v").alias("w")
    )
    return parts.select(*keys, _rhat(F.col("n"), F.col("b"), F.col("w")).alias("rhat"))


class Diagnostics:
    """Ranks, quantiles and half-chain moments of a draw table, stored once and shared by all statistics."""

    def __init__(self, df: DataFrame, keys: list[str], value: str = "value"):
        self.keys = keys
        x = F.col(value).cast("double")
        self.rows = with_halves(df, keys).where(x.isNotNull()).select(
            key_struct(keys), "chain", "half", "position", (x + F.lit(0.0)).alias("v")
        )
        counts = self.rows.groupBy(KEY, "v").agg(
            F.count(F.lit(1)).alias("n"), F.count("half").alias("m")
        )
        #: n counts all draws, m those of the half chains
        self.values = ordered(counts, "v", ["n", "m"])
        self.cuts = stored(
            picks(
                self.values,
                "v",
                {
                    "q5": (0.05, "n"),
                    "median": (0.5, "n"),
                    "q95": (0.95, "n"),
                    "split_q5": (0.05, "m"),
                    "split_median": (0.5, "m"),
                    "split_q95": (0.95, "m"),
                },
            ),
            "cuts",
        )
        forms = F.array(
            F.struct(F.lit("all").alias("form"), self._distance("median").alias("x"), F.col("n").alias("c")),
            F.struct(F.lit("split").alias("form"), self._distance("split_median").alias("x"), F.col("m").alias("c")),
        )
        distances = (
            self.values.join(self.cuts, KEY)
            .select(KEY, F.inline(forms))
            .where("c > 0")
            .groupBy(F.struct(F.col(KEY).alias("of"), "form").alias(KEY), "x")
            .agg(F.sum("c").alias("c"))
        )
        self.distances = ordered(distances, "x", ["c"])
        self._series: DataFrame | None = None

    @staticmethod
    def _distance(median: str) -> Column:
        return F.abs(F.col("v") - F.col(median)) + F.lit(0.0)

    def mad(self) -> DataFrame:
        """(KEY, mad): median distance of all draws from their median."""
        found = picks(self.distances.where(F.col(KEY)["form"] == "all"), "x", {"mad": (0.5, "c")})
        return found.select(F.col(KEY)["of"].alias(KEY), "mad")

    def series(self) -> DataFrame:
        """Draws of the half chains with their normalised ranks and tail indicators."""
        if self._series is None:
            normal = lambda c: normal_quantile(
                (average_rank(c) - 0.375) / (F.col(f"{c}_size") + 0.25)
            )
            folded = self.distances.where(F.col(KEY)["form"] == "split").select(
                F.col(KEY)["of"].alias(KEY), "x", normal("c").alias("folded")
            )
            scores = (
                self.values.where("m > 0")
                .join(self.cuts, KEY)
                .select(
                    KEY,
                    "v",
                    self._distance("split_median").alias("x"),
                    normal("m").alias("bulk"),
                    (F.col("v") <= F.col("split_q5")).cast("double").alias("low"),
                    (F.col("v") <= F.col("split_q95")).cast("double").alias("high"),
                )
                .join(folded, [KEY, "x"])
                .drop("x")
            )
            rows = self.rows.where(F.col("half").isNotNull()).join(scores, [KEY, "v"])
            self._series = stored(rows.withColumnRenamed("v", "plain"), "series")
        return self._series

    def moments(self) -> DataFrame:
        """One row per half chain: n, and mean (m_) and variance (v_) of each series."""
        names = (*SERIES, "folded")
        return self.series().groupBy(KEY, "chain", "half").agg(
            F.count(F.lit(1)).alias("n"),
            *[F.avg(c).alias(f"m_{c}") for c in names],
            *[F.var_samp(c).alias(f"v_{c}") for c in names],
        )

    def named(self, df: DataFrame, *columns) -> DataFrame:
        return df.select(*[F.col(KEY)[k].alias(k) for k in self.keys], *columns)

    def rhat(self, moments: DataFrame) -> DataFrame:
        """(KEY, rhat): the larger of the bulk and the folded one."""
        n, parts = F.avg("n"), []
        for c in ("bulk", "folded"):
            parts.append(_rhat(n, F.var_samp(f"m_{c}"), F.avg(f"v_{c}")))
        return moments.groupBy(KEY).agg(F.greatest(*parts).alias("rhat"))

    def lag_means(self, moments: DataFrame, series: DataFrame, lags: int, block: int) -> DataFrame:
        """(KEY, s, lag, acov): mean over half chains of the autocovariances of the series, lags 0 to ``lags``."""
        centre = moments.select(KEY, "chain", "half", "n", *[f"m_{c}" for c in SERIES])
        own = F.floor(F.col("position") / block).cast("long")
        before = F.when((own > 0) & (F.col("position") % block < lags), own - 1)
        dealt = series.join(centre, [KEY, "chain", "half"]).select(
            KEY,
            "chain",
            "half",
            "n",
            F.struct("position", *[(F.col(c) - F.col(f"m_{c}")).alias(c) for c in SERIES]).alias("point"),
            F.explode(F.array_compact(F.array(own, before))).alias("block"),
        )
        blocks = dealt.groupBy(KEY, "chain", "half", "n", "block").agg(F.collect_list("point").alias("points"))

        @F.pandas_udf("array<double>")
        def products(begin: pd.Series, position: pd.Series, a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
            out = []
            for first, at, *columns in zip(begin, position, a, b, c, d):
                at = np.asarray(at) - first
                sums = np.zeros((len(columns), lags + 1))
                for k, column in enumerate(columns):
                    x = np.zeros(block + lags)
                    x[at] = column
                    for lag in range(min(lags, int(at.max())) + 1):
                        sums[k, lag] = x[:block] @ x[lag : lag + block]
                out.append(sums.ravel())
            return pd.Series(out)

        arrays = [F.col("points")[c] for c in ("position", *SERIES)]  # a field of every element
        summed = blocks.select(
            KEY, "n", F.posexplode(products(F.col("block") * block, *arrays)).alias("at", "value")
        )
        place = F.col("at")
        m = moments.groupBy(KEY).agg(F.count(F.lit(1)).alias("halves"))
        total = summed.groupBy(KEY, F.floor(place / (lags + 1)).cast("int").alias("s"), (place % (lags + 1)).alias("lag")).agg(
            F.sum(F.col("value") / F.col("n")).alias("acov")
        )
        return total.join(m, KEY).select(KEY, "s", "lag", (F.col("acov") / F.col("halves")).alias("acov"))

    def sizes(self, lags: int = LAGS, block: int = BLOCK) -> DataFrame:
        """(KEY, s, ess) of every series; ``s`` is its place in SERIES."""
        moments = stored(self.moments(), "moments")
        spread = F.array(
            *[
                F.struct(
                    F.lit(i).alias("s"),
                    F.avg(f"v_{c}").alias("w"),
                    F.coalesce(F.var_samp(f"m_{c}"), F.lit(0.0)).alias("b"),
                )
                for i, c in enumerate(SERIES)
            ]
        )
        stats = moments.groupBy(KEY).agg(
            F.avg("n").alias("n"), F.min("n").alias("least"), F.sum("n").alias("total"), spread.alias("spread")
        )
        stats = stored(stats.select(KEY, "n", "least", "total", F.inline("spread")), "spread")
        series, done = self.series(), []
        while True:
            means = self.lag_means(moments, series, lags, max(block, lags))
            found = stored(effective_sizes(means, stats), "sizes")
            done.append(found.where("ended"))
            waiting = found.where("not ended").select(KEY).distinct()
            if waiting.isEmpty():
                break
            series, lags = self.series().join(waiting, KEY, "left_semi"), 4 * lags + 3
        # a series that ended in an earlier pass may come again with its group; it is the same
        out = done[0]
        for more in done[1:]:
            out = out.unionByName(more)
        self.half_moments = moments
        return out.groupBy(KEY, "s").agg(F.first("ess").alias("ess"))

    def converged(self) -> DataFrame:
        """(KEY, ess_bulk, ess_tail, ess_mean, rhat), a stored table."""
        sizes = ess_columns(self.sizes())
        return stored(sizes.join(self.rhat(self.half_moments), KEY), "converged")


def effective_sizes(means: DataFrame, stats: DataFrame) -> DataFrame:
    """(KEY, s, ended, ess) by the initial monotone sequence of pairs of autocorrelations."""
    plus = F.col("w") * (F.col("n") - 1) / F.col("n") + F.col("b")
    rho = F.when((F.col("lag") == 0) & (F.col("plus") > 0), F.lit(1.0)).otherwise(
        F.lit(1.0) - F.try_divide(F.col("w") - F.col("acov"), F.col("plus"))
    )
    pairs = (
        means.join(stats, [KEY, "s"])
        .withColumn("plus", plus)
        .withColumn("rho", rho)
        .groupBy(KEY, "s", F.floor(F.col("lag") / 2).alias("pair"), "least", "total")
        .agg(F.sum("rho").alias("both"), F.max(F.when(F.col("lag") % 2 == 0, F.col("rho"))).alias("even"))
    )
    upto = Window.partitionBy(KEY, "s").orderBy("pair").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    goes_on = (F.col("both") > 0) & (2 * F.col("pair") < F.col("least") - 5)
    pairs = pairs.withColumn("ends", ~F.coalesce(goes_on, F.lit(False)))
    pairs = pairs.withColumn("monotone", F.min("both").over(upto))
    pairs = pairs.withColumn("stops", F.sum(F.col("ends").cast("int")).over(upto))
    first_end = F.col("ends") & (F.col("stops") == 1)
    last = F.when((F.col("even") > 0) | (F.col("both") >= 0), F.col("even")).when(F.col("both").isNotNull(), F.lit(0.0))
    out = pairs.groupBy(KEY, "s", "total").agg(
        F.max("stops").alias("stops"),
        F.sum(F.when(F.col("stops") == 0, F.col("monotone"))).alias("sums"),
        F.max(F.when(first_end, last)).alias("last"),
    )
    tau = F.lit(-1.0) + 2 * F.coalesce("sums", F.lit(0.0)) + F.col("last")
    bounded = F.when(F.col("last").isNotNull(), F.greatest(tau, 1 / F.log10("total")))
    return out.select(KEY, "s", (F.col("stops") > 0).alias("ended"), (F.col("total") / bounded).alias("ess"))


def rhat_rank(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Rank-normalised split R-hat: the larger of the bulk and folded values."""
    found = Diagnostics(df, keys, value)
    return found.named(found.rhat(found.moments()), "rhat")


def ess_columns(sizes: DataFrame) -> DataFrame:
    """(KEY, ess_bulk, ess_tail, ess_mean)."""
    at = lambda c: F.max(F.when(F.col("s") == SERIES.index(c), F.col("ess")))
    wide = sizes.groupBy(KEY).agg(*[at(c).alias(f"ess_{c}") for c in SERIES])
    both = F.col("ess_low").isNotNull() & F.col("ess_high").isNotNull()
    tail = F.when(both, F.least("ess_low", "ess_high"))
    return wide.select(KEY, "ess_bulk", tail.alias("ess_tail"), F.col("ess_plain").alias("ess_mean"))


def effective_size(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """ess_bulk, ess_tail, ess_mean, rhat and mcse_mean per key."""
    found = Diagnostics(df, keys, value)
    spread = df.groupBy(key_struct(keys)).agg(F.stddev_samp(value).alias("sd"))
    return found.named(
        found.converged().join(spread, KEY), "ess_bulk", "ess_tail", "ess_mean", "rhat", mcse()
    )


def mcse() -> Column:
    return (F.col("sd") / F.sqrt("ess_mean")).alias("mcse_mean")


def summary(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """mean, median, sd, mad, q5, q95, rhat, ess_bulk, ess_tail and mcse_mean per key.

    ``df`` has ``chain`` and ``iteration``; keys of different runs go into ``keys``.
    """
    found = Diagnostics(df, keys, value)
    spread = df.groupBy(key_struct(keys)).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    mad = found.mad().select(KEY, (F.col("mad") * MAD_SCALE).alias("mad"))
    out = spread.join(found.cuts, KEY, "left").join(mad, KEY, "left").join(found.converged(), KEY, "left")
    return found.named(out, "mean", "median", "sd", "mad", "q5", "q95", "rhat", "ess_bulk", "ess_tail", mcse())
