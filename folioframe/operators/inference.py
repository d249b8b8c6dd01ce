"""Moments, correlations and tests of return series in long form (series columns, date, value)."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioframe.functions.tails import normal_two_sided, t_two_sided


def hac_mean(series: DataFrame, by: Sequence[str], lag: int = 0, value: str = "value") -> DataFrame:
    """Mean, Newey-West standard error and t of each series: ``n, mean, se, t``.

    Bartlett weights 1 - l / (lag + 1), no small-sample factor; nulls are dropped first, and lags
    count the rows that are left. Windows over each series, so no series leaves Spark.
    """
    rows = series.where(F.col(value).isNotNull())
    whole, dated = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("date")
    rows = rows.withColumn("_mean", F.avg(value).over(whole)).withColumn("_e", F.col(value) - F.col("_mean"))
    products = {f"_g{k}": F.col("_e") * F.lag("_e", k).over(dated) for k in range(1, lag + 1)}
    rows = rows.withColumns({"_g0": F.col("_e") * F.col("_e"), **products})
    spread = F.sum("_g0")
    for k in range(1, lag + 1):
        spread = spread + F.lit(2 * (1 - k / (lag + 1))) * F.coalesce(F.sum(f"_g{k}"), F.lit(0.0))
    out = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), (F.sqrt(spread) / F.count(F.lit(1))).alias("se"))
    return out.withColumn("t", F.try_divide("mean", "se"))


def with_normal_p(tests: DataFrame) -> DataFrame:
    """Tests with ``p``, the two-sided normal p-value of ``t``."""

    @F.pandas_udf("double")
    def p_of(t):  # noqa: ANN001, ANN202
        return t.map(lambda x: None if pd.isna(x) else normal_two_sided(x))

    return tests.withColumn("p", p_of("t"))


def hac_alpha(series: DataFrame, factors: DataFrame, names: Sequence[str], by: Sequence[str], lag: int = 0, value: str = "value") -> DataFrame:
    """Mean and alpha on factors of each series, with Newey-West t and normal p: ``n, mean, t, p, alpha, alpha_t, alpha_p``.

    Series and factors are joined by date. The mean takes all n dates on which the series has a value,
    the alpha those on which the factors have theirs too. Products of the factors and the series are
    summed up to one row a series, solved there, and the influence of each date on the constant goes back
    to where its rows are; its variance is that of :func:`hac_mean`'s residuals. Too few rows for the
    factors give null.
    """
    joined = series.join(F.broadcast(factors.select("date", *names)), "date").where(F.col(value).isNotNull())
    means = with_normal_p(hac_mean(joined, by, lag, value))
    enough = lambda c: F.when(F.col("n") > 1, F.col(c)).alias(c)
    means = means.select(*by, "n", enough("mean"), enough("t"), enough("p"))
    rows = joined.dropna(subset=list(names)).withColumn("_x", F.array(F.lit(1.0), *[F.col(c).cast("double") for c in names]))
    k = len(names) + 1
    x = [F.col("_x")[i] for i in range(k)]
    sums = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_m"), F.array(*[F.sum(x[i] * x[j]) for i in range(k) for j in range(k)]).alias("_xx"),
        F.array(*[F.sum(xi * F.col(value)) for xi in x]).alias("_xy"),
    )

    @F.pandas_udf("beta array<double>, first array<double>")
    def solved(xx: pd.Series, xy: pd.Series) -> pd.DataFrame:
        inverses = [np.linalg.pinv(np.reshape(a, (k, k))) for a in xx]
        return pd.DataFrame({"beta": [inv @ np.asarray(b) for inv, b in zip(inverses, xy)], "first": [inv[0] for inv in inverses]})

    fitted = sums.where(F.col("_m") > k).withColumn("_s", solved("_xx", "_xy")).select(*by, "_s.beta", "_s.first")
    dot = lambda a: F.aggregate(F.zip_with(a, "_x", lambda p, q: p * q), F.lit(0.0), lambda total, v: total + v)
    each = rows.join(fitted, list(by)).withColumn("_u", dot("first") * (F.col(value) - dot("beta")))
    dated = Window.partitionBy(*by).orderBy("date")
    products = {f"_g{h}": F.col("_u") * F.lag("_u", h).over(dated) for h in range(1, lag + 1)}
    spread = F.sum(F.col("_u") * F.col("_u"))
    for h in range(1, lag + 1):
        spread = spread + F.lit(2 * (1 - h / (lag + 1))) * F.coalesce(F.sum(f"_g{h}"), F.lit(0.0))
    each = each.withColumns(products) if products else each
    alphas = each.groupBy(*by).agg(F.first(F.col("beta")[0]).alias("alpha"), F.sqrt(F.greatest(spread, F.lit(0.0))).alias("_se"))
    tests = with_normal_p(alphas.withColumn("t", F.try_divide("alpha", "_se"))).select(*by, "alpha", F.col("t").alias("alpha_t"), F.col("p").alias("alpha_p"))
    return means.join(tests, list(by), "left")


def moments(series: DataFrame, by: Sequence[str], value: str = "value", per_year: int = 1) -> DataFrame:
    """``n, mean, std, sharpe, low, high``: the Sharpe ratio times sqrt(per_year), a 95 % interval of the mean.

    As in the study that this follows, n counts all rows, null ones too.
    """
    out = series.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
    half = 1.96 * F.col("std") / F.sqrt("n")
    return out.withColumns(
        {"sharpe": F.try_divide("mean", "std") * float(np.sqrt(per_year)), "low": F.col("mean") - half, "high": F.col("mean") + half}
    )


def correlations(a: DataFrame, b: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    """Correlation of like-named series of two sources over the dates on which both have a value."""
    both = a.join(b.withColumnRenamed(value, "_other"), [*by, "date"]).dropna(subset=[value, "_other"])
    return both.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.corr(value, "_other").alias("corr"))


def paired_t(sources: DataFrame, pairs: Sequence[tuple[str, str]], by: Sequence[str], value: str = "value") -> DataFrame:
    """Paired t-tests between sources (column ``source``) of like-named series: ``pair, n, mean_diff, t``.

    Each pair uses the dates on which both have a value; all pairs of a series are null if one of them
    has fewer than two.
    """
    present = sources.where(F.col(value).isNotNull())
    sides = F.explode(
        F.filter(
            F.array(*[F.struct(F.lit(f"{a}-{b}").alias("pair"), F.when(F.col("source") == a, 1).when(F.col("source") == b, -1).alias("sign")) for a, b in pairs]),
            lambda x: x["sign"].isNotNull(),
        )
    )
    signed = present.select(*by, "date", value, sides.alias("_s")).select(*by, "date", "_s.*", value)
    diff = signed.groupBy(*by, "pair", "date").agg(F.sum(F.col(value) * F.col("sign")).alias("d"), F.count(F.lit(1)).alias("k"))
    names = F.explode(F.array(*[F.lit(f"{a}-{b}") for a, b in pairs]))
    every = sources.select(*by).distinct().select(*by, names.alias("pair"))
    tests = diff.where("k = 2").groupBy(*by, "pair").agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("mean_diff"), F.stddev_samp("d").alias("sd"))
    tests = every.join(tests, [*by, "pair"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    enough = F.min("n").over(Window.partitionBy(*by)) >= 2
    t = F.try_divide(F.col("mean_diff") * F.sqrt("n"), "sd")
    tests = tests.withColumn("_ok", enough)
    return tests.select(*by, "pair", "n", F.when(F.col("_ok"), F.col("mean_diff")).alias("mean_diff"), F.when(F.col("_ok"), t).alias("t"))


def with_student_p(tests: DataFrame) -> DataFrame:
    """Paired tests with ``p``, the two-sided p-value of ``t`` at n - 1 degrees of freedom."""

    @F.pandas_udf("double")
    def p_of(t, n):  # noqa: ANN001, ANN202
        return pd.Series([None if pd.isna(x) else t_two_sided(x, k - 1) for x, k in zip(t, n)], dtype="float64")

    return tests.withColumn("p", p_of("t", "n"))


def count_significant(tests: DataFrame, by: Sequence[str], level: float = 0.05) -> DataFrame:
    return tests.groupBy(*by).agg(F.count_if(F.col("p") <= level).alias("significant"))


def comparison_table(sources: DataFrame, names: Sequence[str], per_year: int = 12) -> DataFrame:
    """One row for each series that several sources (column ``source``) have, stars in its name left out.

    For each pair of ``names`` ``corr_a_b`` and ``p_a_b``, the p-value of a paired t-test, each over the
    dates on which both have a value; for each source ``mean_a`` in percent and the Sharpe ratio
    ``sharpe_a``. p-values are null if a pair of the series has fewer than two dates. Sources lie side by
    side by series and date, and one aggregate over the series gives all the numbers.
    """
    value = lambda n: F.max(F.when(F.col("source") == n, F.col("value"))).alias(n)
    wide = sources.select("source", F.replace("series", F.lit("*"), F.lit("")).alias("series"), "date", "value").groupBy("series", "date").agg(*map(value, names))
    pairs = list(itertools.combinations(names, 2))
    diff = {(a, b): F.col(a) - F.col(b) for a, b in pairs}
    table = wide.groupBy("series").agg(
        *[F.avg(n).alias(f"_mean_{n}") for n in names], *[F.stddev_samp(n).alias(f"_std_{n}") for n in names],
        *[F.corr(F.when(d.isNotNull(), F.col(a)), F.when(d.isNotNull(), F.col(b))).alias(f"corr_{a}_{b}") for (a, b), d in diff.items()],
        *[f(d).alias(f"_{name}_{a}_{b}") for (a, b), d in diff.items() for name, f in (("n", F.count), ("d", F.avg), ("sd", F.stddev_samp))],
    )

    @F.pandas_udf("double")
    def p_of(t: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(x) else t_two_sided(x, k - 1) for x, k in zip(t, n)], dtype="float64")

    whole = F.least(*[F.col(f"_n_{a}_{b}") for a, b in pairs], F.lit(2)) >= 2
    t_of = lambda a, b: F.when(whole, F.try_divide(F.col(f"_d_{a}_{b}") * F.sqrt(f"_n_{a}_{b}"), F.col(f"_sd_{a}_{b}")))
    return table.select(
        "series", *[f"corr_{a}_{b}" for a, b in pairs], *[(F.col(f"_mean_{n}") * 100).alias(f"mean_{n}") for n in names],
        *[(F.try_divide(f"_mean_{n}", f"_std_{n}") * float(np.sqrt(per_year))).alias(f"sharpe_{n}") for n in names],
        *[p_of(t_of(a, b), f"_n_{a}_{b}").alias(f"p_{a}_{b}") for a, b in pairs],
    )


def significant_pairs(table: DataFrame, level: float = 0.05) -> DataFrame:
    """One row: for each ``p_`` column of a comparison table the number of series at or below the level, as ``significant_``."""
    return table.agg(*[F.count_if(F.col(c) <= level).alias(f"significant_{c[2:]}") for c in table.columns if c.startswith("p_")])
