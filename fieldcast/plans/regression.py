"""Zero-inflated count regression with its three published tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from fieldcast.operators import draws as D, zip_regression as Z
from fieldcast.operators.stored import stored


def zip_report(
    df: DataFrame,
    response: str,
    predictors: list[str],
    row_id: str,
    replicates: int = 200,
    n_draws: int = 100,
    n_entities: int = 100,
    digits: int = 2,
    selected: list[str] | None = None,
    rescale: bool = True,
    seed: int = 123,
) -> dict[str, DataFrame]:
    """``entities`` (q and expected count), ``coefficients`` (long draws),
    ``summary`` (interval, type, label in term order), ``estimates`` (with
    standard errors of the observed information) and ``fits`` (whether and
    after how many iterations each replicate converged).

    Only converged replicates are draws.
    """
    model = Z.fit(df, response, predictors, row_id, replicates, seed=seed)
    fits = Z.fit_table(df, model)
    model = Z.converged_only(model)
    coefs = Z.coefficient_draws(df, model)
    if rescale:
        coefs = D.rescale(coefs, Z.scale_table(df, model))
    levels = df.sparkSession.createDataFrame(
        [(t, i) for i, t in enumerate(model.terms)], "term string, term_ord int"
    )
    values = stored(Z.entity_draws(df, model, response, predictors, row_id, n_entities, seed), "scores")
    return {
        "entities": D.entity_long(values, n_draws, n_entities, seed),
        "coefficients": D.coef_long(coefs, n_draws, seed),
        "summary": D.coef_summary(coefs, levels, digits, selected),
        "estimates": Z.estimate_table(df, model),
        "fits": fits,
    }
