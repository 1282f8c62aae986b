"""Filling missing values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, functions as F

from .ordered import carry_forward, in_order
from .regression import fit_factors, with_prediction
from .sizing import ROWS_PER_TASK, attach


def impute_value(value: Column, fill: Column) -> Column:
    return F.coalesce(value, fill)


def impute_rule(value: Column, rule: Column, fill: str) -> Column:
    """``fill`` where the value is NULL and the rule holds."""
    return F.when(value.isNull() & rule, F.lit(fill)).otherwise(value)


def impute_mean(df: DataFrame, value: str, groups: Sequence[str], name: str) -> DataFrame:
    """Fill with the mean of the row's group."""
    means = df.groupBy(*groups).agg(F.avg(value).alias("_mean"))
    return attach(df, means, groups, null_safe=True).withColumn(name, F.coalesce(F.col(value), F.col("_mean"))).drop("_mean")


def impute_hotdeck(
    df: DataFrame,
    value: str,
    order: Sequence[str],
    domain: Sequence[str] = (),
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Fill with the last value in sort order and flag the filled rows in ``<value>_i``.

    ``order`` should end with a key, so that the donor is determined.
    """
    rows = in_order(df, domain, order, rows_per_task)
    flag = F.col(value).isNull()
    return carry_forward(rows, value, "_filled").withColumns({f"{value}_i": flag, value: F.col("_filled")}).drop("_filled")


def line_fit(df: DataFrame, y: str, x: str) -> DataFrame:
    """Least squares with one numeric predictor (one row); rows with a NULL are left out."""
    return df.agg(
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"),
        F.sqrt(F.try_divide(F.regr_syy(y, x) - F.regr_slope(y, x) * F.regr_sxy(y, x), F.regr_count(y, x) - 2)).alias("sigma"),
        F.regr_count(y, x).alias("n"),
    )


def impute_line(df: DataFrame, y: str, x: str, name: str) -> DataFrame:
    """Fill NULL ``y`` with the prediction from one numeric predictor, without leaving Catalyst."""
    return df.withColumn("_fit", _fit_scalar(df, y, x)).selectExpr(
        *df.columns, f"coalesce({y}, _fit.intercept + _fit.slope * {x}) AS {name}"
    )


def _fit_scalar(df: DataFrame, y: str, x: str) -> Column:
    """The fitted line as one scalar subquery, so that the data is read once for it."""
    return line_fit(df, y, x).select(F.struct("slope", "intercept", "sigma").alias("fit")).scalar()


def fit_linear(df: DataFrame, y: str, numeric: Sequence[str], categorical: Sequence[str] = ()) -> PipelineModel:
    """Least squares on numeric and categorical predictors with listwise deletion.

    The solver sums the normal equations on the executors; what reaches the
    driver is as large as the square of the number of coefficients.
    """
    complete = df.na.drop(subset=[y, *numeric, *categorical])
    stages = []
    encoded = []
    for c in categorical:
        # The first label in sort order is the reference level: it is indexed last and dropped.
        stages.append(StringIndexer(inputCol=c, outputCol=f"_{c}_i", stringOrderType="alphabetDesc"))
        stages.append(OneHotEncoder(inputCol=f"_{c}_i", outputCol=f"_{c}_v", dropLast=True))
        encoded.append(f"_{c}_v")
    stages.append(VectorAssembler(inputCols=[*numeric, *encoded], outputCol="_x", handleInvalid="skip"))
    stages.append(LinearRegression(featuresCol="_x", labelCol=y, predictionCol="_prediction", solver="normal"))
    return Pipeline(stages=stages).fit(complete)


def residual_deviation(model: PipelineModel) -> float:
    """Square root of the residual sum of squares over the residual degrees of freedom."""
    summary = model.stages[-1].summary
    freedom = summary.degreesOfFreedom
    return (summary.meanSquaredError * summary.numInstances / freedom) ** 0.5 if freedom > 0 else float("nan")


def impute_regression(
    df: DataFrame, y: str, numeric: Sequence[str], categorical: Sequence[str], name: str
) -> DataFrame:
    """Fill NULL ``y`` with the prediction.

    Rows with a NULL predictor, or with a label that no complete row has, stay NULL.
    """
    scored = with_prediction(df, fit_factors(df, y, numeric, categorical), "_prediction")
    return scored.select(*df.columns, F.coalesce(F.col(y), F.col("_prediction")).cast("double").alias(name))


def keyed_normal(key: Sequence[str], seed: int) -> Column:
    """A standard normal value that depends on the row's key and the seed alone.

    Two uniform values come from the digits of an md5 digest, and Box-Muller makes them normal.
    """
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]))

    def uniform(start: int) -> Column:
        return (F.conv(F.substring(digest, start, 12), 16, 10).cast("double") + 0.5) / float(16**12)

    return F.sqrt(-2 * F.log(uniform(1))) * F.cos(2 * F.pi() * uniform(13))


def impute_stochastic(
    df: DataFrame,
    y: str,
    numeric: Sequence[str],
    name: str,
    key: Sequence[str],
    seed: int,
    divisor: float = 20.0,
    categorical: Sequence[str] = (),
) -> DataFrame:
    """Fill with the prediction plus normal noise of residual deviation / ``divisor``.

    The noise is a function of the row's key, so partitions and reruns do not change it.
    """
    if len(numeric) == 1 and not categorical:
        fitted = df.withColumn("_fit", _fit_scalar(df, y, numeric[0]))
        value = F.col("_fit.intercept") + F.col("_fit.slope") * F.col(numeric[0])
        sigma = F.col("_fit.sigma")
    else:
        model = fit_factors(df, y, numeric, categorical)
        fitted, value, sigma = with_prediction(df, model, "_prediction"), F.col("_prediction"), F.lit(model.sigma)
    return fitted.select(*df.columns, F.coalesce(F.col(y), value + keyed_normal(key, seed) * sigma / divisor).alias(name))


def regression_summary(df: DataFrame, y: str, numeric: Sequence[str], categorical: Sequence[str] = ()) -> DataFrame:
    """(term, estimate, std_error, r2, sigma, n): least squares on numeric and categorical predictors, listwise.

    A term that depends on those before it has no estimate; see ``fit_factors``.
    """
    model = fit_factors(df, y, numeric, categorical)
    rest = (model.r2, model.sigma, model.n)
    return df.sparkSession.createDataFrame(
        [(*term, *rest) for term in model.terms], "term STRING, estimate DOUBLE, std_error DOUBLE, r2 DOUBLE, sigma DOUBLE, n BIGINT"
    )
