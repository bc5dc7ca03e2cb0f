"""Zero-inflated Poisson regression by direct maximum likelihood.

Each iteration is a single pass over the cached design.  Likelihood, score and
observed information are sums over rows: every Arrow batch is reduced by a few
matrix products in its task, and Spark adds the partial sums as vectors, by a
tree.  The driver gets one row per replicate, independent of the number of
rows and tasks; a damped Newton step follows.  All bootstrap replicates that
haven't converged share the pass; a row's weight in a replicate is a Poisson(1) count drawn from a hash of
its id, so it is the same after any recomputation.
"""

from __future__ import annotations

import json
import sys
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from fieldcast.functions.noise import digest
from fieldcast.operators.density import log_factorial

# workers need no installed copy of this module
cloudpickle.register_pickle_by_value(sys.modules[__name__])

INTERCEPT = "intercept"


@dataclass
class ZipModel:
    """Coefficients per replicate (0 is the full sample): part 1 is the
    probability of a count process, part 2 its log rate."""

    terms: list[str]
    scales: dict[str, float]
    coefficients: dict[int, np.ndarray]
    log_likelihood: list[float] = field(default_factory=list)
    iterations: dict[int, int] = field(default_factory=dict)
    converged: dict[int, bool] = field(default_factory=dict)
    #: standard errors of the full sample, from the observed information at its maximum
    errors: np.ndarray | None = None


def column_scales(df: DataFrame, predictors: list[str]) -> dict[str, float]:
    """Maximum of each numeric predictor; 1 where it cannot scale."""
    numeric = {f.name for f in df.schema.fields if f.dataType.simpleString() in
               ("tinyint", "smallint", "int", "bigint", "float", "double")}
    found = [p for p in predictors if p in numeric]
    row = df.agg(*[F.max(p).alias(p) for p in found]).first() if found else {}
    return {
        p: float(row[p]) if p in numeric and row[p] else 1.0 for p in predictors
    }


def design(df: DataFrame, response: str, predictors: list[str], scales: dict[str, float],
           row_id: str) -> DataFrame:
    """(id, y, ln y!, x0..xk) with an intercept column and max-scaled predictors.

    Rows without a response or predictor are left out.
    """
    columns = [F.lit(1.0).alias("x0")] + [
        (F.col(p).cast("double") / scales[p]).alias(f"x{i + 1}")
        for i, p in enumerate(predictors)
    ]
    complete = df.dropna(subset=[response, *predictors])
    return complete.select(
        F.col(row_id).alias("id"),
        F.col(response).cast("double").alias("y"),
        log_factorial(F.col(response).cast("int")).alias("log_factorial"),
        *columns,
    )


#: ends of the weights 0, 1, ... on the unit interval
LEVELS = np.cumsum(np.exp(-1.0) / np.cumprod(np.maximum(np.arange(18), 1)))
#: weight of each of 2^12 cells of the unit interval; cells with an end inside have none
CELLS = np.searchsorted(LEVELS, np.arange(2**12) / 2.0**12)
CELLS = np.where(np.searchsorted(LEVELS, (np.arange(2**12) + 1) / 2.0**12) == CELLS, CELLS, -1).astype(float)


def bootstrap_weights(seeds: np.ndarray, rep: int) -> np.ndarray:
    """Poisson(1) weight of each row in a replicate, a hash of the row's seed."""
    if rep == 0:
        return np.ones(len(seeds))
    with np.errstate(over="ignore"):
        h = seeds.astype(np.uint64) + np.uint64(rep) * np.uint64(0x9E3779B97F4A7C15)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h ^= h >> np.uint64(shift)
            h *= np.uint64(factor)
        h ^= h >> np.uint64(31)
    weights = CELLS.take((h >> np.uint64(52)).view(np.int64), mode="clip")
    cut = np.flatnonzero(weights < 0)
    weights[cut] = np.searchsorted(LEVELS, (h[cut] >> np.uint64(11)).astype(float) / 2.0**53)
    return weights


class Block:
    """Some rows, those with a count above 0 first, and the products of their predictors."""

    def __init__(self, y, log_factorials, x, seeds):
        seen = y > 0
        order = np.concatenate([np.flatnonzero(seen), np.flatnonzero(~seen)])
        self.n_seen, self.k = int(seen.sum()), x.shape[1]
        self.y, self.log_factorials = y[order[: self.n_seen]], log_factorials[order[: self.n_seen]]
        self.x, self.seeds = np.ascontiguousarray(x[order].T), seeds[order]
        self.i, self.j = np.triu_indices(self.k)
        self.products = self.x[self.i] * self.x[self.j]

    def parts(self, coefs: np.ndarray) -> np.ndarray:
        """Of each row: likelihood, its slopes in both linear terms, its three curvatures in them."""
        m = self.n_seen
        out = np.empty((6, self.x.shape[1]))
        value, s1, s2, h11, h12, h22 = out
        with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
            linear, log_rate = coefs @ self.x
            p = 1.0 / (1.0 + np.exp(-linear))
            rate = np.exp(log_rate)
            q = 1.0 - p
            pq = p * q
            value[:m] = np.log(p[:m]) + self.y * log_rate[:m] - rate[:m] - self.log_factorials
            s1[:m], s2[:m] = q[:m], self.y - rate[:m]
            h11[:m], h12[:m], h22[:m] = -pq[:m], 0.0, -rate[:m]
            p, q, rate, pq = p[m:], q[m:], rate[m:], pq[m:]
            miss = np.exp(-rate)
            zero = q + p * miss
            z1, z2 = -pq * (1.0 - miss) / zero, -p * rate * miss / zero
            value[m:], s1[m:], s2[m:] = np.log(zero), z1, z2
            h11[m:] = z1 * (1.0 - 2.0 * p) - z1 * z1
            h12[m:] = q * z2 - z1 * z2
            h22[m:] = z2 * (1.0 - rate) - z2 * z2
        return out

    def sums(self, coefs: np.ndarray, reps: list[int]) -> dict[int, np.ndarray]:
        """Likelihood, score and information under the weights of each replicate, all at the same coefficients."""
        parts = self.parts(coefs)
        if len(reps) == 1:
            parts *= bootstrap_weights(self.seeds, reps[0])
            score, info = parts[1:3] @ self.x.T, parts[3:] @ self.products.T
            return {reps[0]: self.packed(np.concatenate([[parts[0].sum()], score.ravel(), info.ravel()]))}
        rows = [parts[:1], *(part * self.x for part in parts[1:3]), *(part * self.products for part in parts[3:])]
        rows = np.concatenate(rows)
        return {r: self.packed(rows @ bootstrap_weights(self.seeds, r)) for r in reps}

    def packed(self, sums: np.ndarray) -> np.ndarray:
        """The triangles of the three matrices made whole."""
        whole = np.empty((3, self.k, self.k))
        whole[:, self.i, self.j] = whole[:, self.j, self.i] = sums[1 + 2 * self.k :].reshape(3, -1)
        return np.concatenate([sums[: 1 + 2 * self.k], whole.ravel()])


SUMS = "rep int, bucket int, sums array<double>"
#: partial sums of so many groups of tasks are added before those of a replicate
BUCKETS = 32


def _added(partial: DataFrame, by: list[str]) -> DataFrame:
    """One row for each value of ``by``: streamed rows are added up, none are gathered."""

    def add(batches):
        totals: dict[tuple, np.ndarray] = {}
        for pdf in batches:
            for rep, bucket, sums in zip(pdf["rep"], pdf["bucket"], pdf["sums"]):
                key = (rep, bucket if "bucket" in by else 0)
                totals[key] = totals[key] + sums if key in totals else np.array(sums)
        rows = [(rep, bucket, t.tolist()) for (rep, bucket), t in totals.items()]
        yield pd.DataFrame(rows, columns=["rep", "bucket", "sums"])

    return partial.repartition(*by).mapInPandas(add, SUMS)


def row_sums(rows: DataFrame, coefs: dict[int, np.ndarray], k: int) -> DataFrame:
    """(rep, sums): likelihood, score and information of every replicate, one row each.

    Arrow batches are reduced where they lie; the partial sums of the tasks
    are added as vectors, in groups of tasks first.  Replicates with the same
    coefficients share all but the weights.
    """
    names = [f"x{j}" for j in range(k)]
    alike: dict[bytes, list[int]] = {}
    for r, c in coefs.items():
        alike.setdefault(c.tobytes(), []).append(r)

    def reduce(batches):
        from pyspark import TaskContext

        totals = {r: 0.0 for r in coefs}
        for pdf in batches:
            x = pdf[names].to_numpy(float)
            y, lf = pdf["y"].to_numpy(float), pdf["log_factorial"].to_numpy(float)
            seeds = pdf["seed"].to_numpy()
            block = Block(y, lf, x, seeds)
            for reps in alike.values():
                for r, sums in block.sums(coefs[reps[0]], reps).items():
                    totals[r] = totals[r] + sums
        bucket = TaskContext.get().partitionId() % BUCKETS
        found = [(r, bucket, t.tolist()) for r, t in totals.items() if not np.isscalar(t)]
        yield pd.DataFrame(found, columns=["rep", "bucket", "sums"])

    partial = rows.select("y", "log_factorial", "seed", *names).mapInPandas(reduce, SUMS)
    return _added(_added(partial, ["rep", "bucket"]), ["rep"]).select("rep", "sums")


def _pass(rows: DataFrame, coefs: dict[int, np.ndarray], k: int) -> dict[int, np.ndarray]:
    """Sums of the replicates on the driver: one row of 1 + 2k + 3k^2 numbers for each."""
    out = {r: np.zeros(1 + 2 * k + 3 * k * k) for r in coefs}
    for row in row_sums(rows, coefs, k).collect():
        out[row.rep] = np.array(row.sums)
    return out


def information(sums: np.ndarray, k: int) -> np.ndarray:
    h11, h12, h22 = sums[1 + 2 * k :].reshape(3, k, k)
    return -np.block([[h11, h12], [h12.T, h22]])


def standard_errors(sums: np.ndarray, k: int) -> np.ndarray:
    """Roots of the diagonal of the inverse information, NaN where it is not positive."""
    info = information(sums, k)
    variance = np.full(2 * k, np.nan)
    # columns are scaled, so that terms of very different size don't spoil the inverse
    size = np.sqrt(np.abs(np.diag(info)))
    if (size > 0).all():
        inverse = np.linalg.pinv(info / np.outer(size, size), hermitian=True)
        variance = np.diag(inverse) / size**2
    return np.sqrt(np.where(variance > 0, variance, np.nan)).reshape(2, k)


def score(
    df: DataFrame, response: str, predictors: list[str], row_id: str, coefficients: np.ndarray
) -> DataFrame:
    """(item, term, value) at given coefficients of the scaled predictors: the log likelihood and both scores.

    ``item`` is loglik (term null), probability or count.
    """
    scales = column_scales(df, predictors)
    rows = design(df, response, predictors, scales, row_id).withColumn("seed", F.lit(0).cast("long"))
    terms = [INTERCEPT, *predictors]
    k = len(terms)
    items = [("loglik", None), *(("probability", t) for t in terms), *(("count", t) for t in terms)]
    named = F.array(*[F.struct(F.lit(i).alias("item"), F.lit(t).cast("string").alias("term")) for i, t in items])
    sums = row_sums(rows, {0: np.asarray(coefficients, float)}, k).select(
        F.inline(F.arrays_zip(named.alias("name"), F.slice("sums", 1, 1 + 2 * k).alias("value")))
    )
    return sums.select("name.item", "name.term", "value")


def newton_step(sums: np.ndarray, k: int) -> np.ndarray:
    """Ascent step: curvature in absolute value, flat directions left alone."""
    score = sums[1 : 1 + 2 * k]
    values, vectors = np.linalg.eigh(information(sums, k))
    size = np.abs(values)
    usable = size > 1e-10 * size.max()
    inverse = np.where(usable, 1.0 / np.where(usable, size, 1.0), 0.0)
    step = vectors @ (inverse * (vectors.T @ score))
    longest = np.abs(step).max()
    return (step * min(1.0, 3.0 / longest) if longest > 0 else step).reshape(2, k)


def fit(
    df: DataFrame,
    response: str,
    predictors: list[str],
    row_id: str,
    replicates: int = 0,
    max_iter: int = 50,
    tol: float = 1e-7,
    seed: int = 123,
) -> ZipModel:
    """Fit every replicate; a step that lowers a likelihood is halved, so the
    likelihood never decreases.

    The model says for each replicate whether it converged, and after how many
    iterations.  It is an error if the full sample did not.
    """
    scales = column_scales(df, predictors)
    rows = design(df, response, predictors, scales, row_id).withColumn(
        "seed", F.xxhash64(F.lit(seed), "id")
    ).persist()
    k = len(predictors) + 1
    try:
        start = rows.agg(F.avg(F.when(F.col("y") > 0, F.col("y")))).first()[0] or 1.0
        first = np.zeros((2, k))
        first[1, 0] = np.log(start)
        coefs = {r: first.copy() for r in range(replicates + 1)}
        best = {r: (-np.inf, c) for r, c in coefs.items()}
        step = {r: np.zeros((2, k)) for r in coefs}
        done: set[int] = set()
        history: list[float] = []
        iterations = dict.fromkeys(coefs, 0)
        errors = None
        for _ in range(max_iter):
            active = [r for r in coefs if r not in done]
            sums = _pass(rows, {r: coefs[r] for r in active}, k)
            for r in active:
                iterations[r] += 1
                value = sums[r][0]
                if not value >= best[r][0]:
                    step[r] = step[r] / 2
                    coefs[r] = best[r][1] + step[r]
                    if np.abs(step[r]).max() < tol:
                        coefs[r] = best[r][1]
                        done.add(r)
                    continue
                gain = value - best[r][0]
                best[r] = (value, coefs[r])
                if r == 0:
                    history.append(value)
                    errors = standard_errors(sums[r], k)
                if gain < tol * (abs(value) + 1.0):
                    done.add(r)
                    continue
                step[r] = newton_step(sums[r], k)
                coefs[r] = best[r][1] + step[r]
            if len(done) == len(coefs):
                break
    finally:
        rows.unpersist()
    if 0 not in done:
        raise ArithmeticError(f"the full sample did not converge in {max_iter} iterations")
    return ZipModel(
        [INTERCEPT, *predictors],
        {INTERCEPT: 1.0, **scales},
        {r: c for r, (_, c) in best.items()},
        history,
        iterations,
        {r: r in done for r in coefs},
        errors,
    )


def converged_only(model: ZipModel) -> ZipModel:
    """The model without the replicates that were stopped."""
    kept = {r: c for r, c in model.coefficients.items() if model.converged[r]}
    return replace(model, coefficients=kept)


def coefficient_draws(df: DataFrame, model: ZipModel) -> DataFrame:
    """(draw, part, term, value): one draw per replicate.

    The full-sample estimate is draw 0 when no replicates were made.
    """
    reps = [r for r in model.coefficients if r > 0] or [0]
    rows = [
        (r, part + 1, term, float(model.coefficients[r][part][j]))
        for r in reps
        for part in (0, 1)
        for j, term in enumerate(model.terms)
    ]
    return df.sparkSession.createDataFrame(
        rows, "draw int, part int, term string, value double"
    )


def scale_table(df: DataFrame, model: ZipModel) -> DataFrame:
    return df.sparkSession.createDataFrame(
        list(model.scales.items()), "term string, scale_max double"
    )


def fit_table(df: DataFrame, model: ZipModel) -> DataFrame:
    """(replicate, converged, iterations); replicate 0 is the full sample."""
    rows = [(r, model.converged[r], model.iterations[r]) for r in sorted(model.coefficients)]
    return df.sparkSession.createDataFrame(rows, "replicate int, converged boolean, iterations int")


def estimate_table(df: DataFrame, model: ZipModel) -> DataFrame:
    """(type, term, estimate, std_error) of the full sample, for the predictors in their own units."""
    rows = [
        (kind, term, float(model.coefficients[0][part][j] / model.scales[term]),
         float(model.errors[part][j] / model.scales[term]))
        for part, kind in ((0, "probability"), (1, "count"))
        for j, term in enumerate(model.terms)
    ]
    return df.sparkSession.createDataFrame(rows, "type string, term string, estimate double, std_error double")


def entity_draws(
    df: DataFrame,
    model: ZipModel,
    response: str,
    predictors: list[str],
    row_id: str,
    n_entities: int | None = None,
    seed: int = 123,
) -> DataFrame:
    """(draw, part, entity, value): q and the log rate per row and replicate.

    With ``n_entities`` only so many rows are scored, the first ones by a hash
    of their id.  The coefficients are one array, and a row meets each of its
    vectors in a dot product, so neither the plan nor the number of scans
    depends on the number of replicates.
    """
    reps = [r for r in sorted(model.coefficients) if r > 0] or [0]
    rows = design(df, response, predictors, model.scales, row_id)
    if n_entities is not None:
        rows = rows.orderBy(digest(seed, F.col("id")), "id").limit(n_entities)
    vectors = [
        {"draw": r, "part": part + 1, "beta": [float(v) for v in model.coefficients[r][part]]}
        for r in reps
        for part in (0, 1)
    ]
    kind = "array<struct<draw: int, part: int, beta: array<double>>>"
    known = F.from_json(F.lit(json.dumps(vectors)), kind)  # one constant

    def scored(c: Column) -> Column:
        products = F.zip_with(c["beta"], F.col("x"), lambda a, b: a * b)
        eta = F.aggregate(products, F.lit(0.0), lambda a, b: a + b)
        value = F.when(c["part"] == 1, 1.0 / (1.0 + F.exp(-eta))).otherwise(eta)
        return F.struct(c["draw"].alias("draw"), c["part"].alias("part"), value.alias("value"))

    shaped = rows.select(F.col("id").alias("entity"), F.array(*[f"x{j}" for j in range(len(model.terms))]).alias("x"))
    return shaped.select("entity", F.inline(F.transform(known, scored)))
