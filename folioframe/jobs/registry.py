"""The registered queries over the derived panels, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioframe.jobs import oracles as sql
from folioframe.jobs.grids import momentum_grid, rating_grid
from folioframe.operators import factors, inference, summary
from folioframe.operators.filters import add_filtered, expanding_bounds
from folioframe.operators.grid import long_short_grid
from folioframe.operators.quantiles import counted_percentiles
from folioframe.operators.signals import add_momentum, add_reversal, add_running_sum, add_wealth
from folioframe.operators.strategy import Strategy
from folioframe.sources import demo_panel, panel as panels
from folioframe.sources import files, store
from folioframe.spec import FilterSpec, Momentum, Reversal, SortSpec

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        QUERIES[name] = query
        if oracle:
            ORACLES[name] = oracle
        return query

    return add


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to the digits that two engines agree on."""
    return df.withColumns({c: F.round(F.col(f"`{c}`"), sql.D) + 0.0 for c, t in df.dtypes if t == "double"})


def strategy(spark: SparkSession, sf_dir: str, spec: SortSpec, kind: str = "supplier") -> Strategy:
    return Strategy(demo_panel.load(spark, sf_dir, kind), spec)


# ---------------------------------------------------------------- single sorts

ONE = sql.sort("supplier", "disc", 5)
THREE = sql.sort("supplier", "disc", 5, 3, dynamic=True)


@register("single_sort_k1", sql.long_short(ONE, 5))
def single_sort_k1(spark, sf_dir):
    return rounded(strategy(spark, sf_dir, SortSpec("disc", 5)).long_short)


@register("portfolios_k1", sql.portfolios(ONE))
def portfolios_k1(spark, sf_dir):
    return rounded(strategy(spark, sf_dir, SortSpec("disc", 5)).returns)


@register("single_sort_k3_dynamic", sql.portfolios(THREE))
def single_sort_k3_dynamic(spark, sf_dir):
    return rounded(strategy(spark, sf_dir, SortSpec("disc", 5, 3, dynamic_weights=True)).returns)


@register("legs_k3", f"""WITH {sql.sort("supplier", "disc", 5, 3)}
    SELECT date, regime, CASE WHEN ptf = 5 THEN 'long' ELSE 'short' END AS leg, {sql.r('ew', 'ew')}, {sql.r('vw', 'vw')} FROM res WHERE ptf IN (1, 5)""")
def legs_k3(spark, sf_dir):
    return rounded(strategy(spark, sf_dir, SortSpec("disc", 5, 3))._legs)


@register("part_sort_rating_nig", sql.portfolios(sql.sort("part", "disc", 4, 2, rating='"RATING_NUM" > 10 AND "RATING_NUM" <= 22')))
def part_sort_rating_nig(spark, sf_dir):
    return rounded(strategy(spark, sf_dir, SortSpec("disc", 4, 2, rating="NIG"), "part").returns)


@register("rating_sort_ig", sql.portfolios(sql.sort("supplier", '"RATING_NUM"', 3, rating='"RATING_NUM" BETWEEN 1 AND 10')))
def rating_sort_ig(spark, sf_dir):
    return rounded(strategy(spark, sf_dir, SortSpec("RATING_NUM", 3, rating="IG")).returns)


# ---------------------------------------------------------------- signals

_f = "f AS (SELECT * FROM panel)"


def _signal_sql(cte: str, kind: str = "supplier") -> str:
    return f"""WITH {demo_panel.sql(kind)}, {_f}, {cte} SELECT "ID", date, {sql.r('signal', 'signal')} FROM prep"""


@register("momentum_signal", _signal_sql(sql.momentum(6, 1)))
def momentum_signal(spark, sf_dir):
    return rounded(add_momentum(demo_panel.load(spark, sf_dir), 6, 1).select("ID", "date", "signal"))


@register("momentum_signal_part", _signal_sql(sql.momentum(6, 2), "part"))
def momentum_signal_part(spark, sf_dir):
    return rounded(add_momentum(demo_panel.load(spark, sf_dir, "part"), 6, 2).select("ID", "date", "signal"))


@register("ltr_signal", _signal_sql(sql.reversal(12, 3)))
def ltr_signal(spark, sf_dir):
    return rounded(add_reversal(demo_panel.load(spark, sf_dir), 12, 3).select("ID", "date", "signal"))


@register("momentum_sort", sql.long_short(sql.sort("supplier", "signal", 5, 3, prep=sql.momentum(3, 1)), 5))
def momentum_sort(spark, sf_dir):
    return rounded(strategy(spark, sf_dir, SortSpec(Momentum(3, 1), 5, 3)).long_short)


@register("ltr_sort", sql.long_short(sql.sort("supplier", "signal", 5, 2, prep=sql.reversal(12, 3)), 5))
def ltr_sort(spark, sf_dir):
    return rounded(strategy(spark, sf_dir, SortSpec(Reversal(12, 3), 5, 2)).long_short)


# ---------------------------------------------------------------- filters


def _filter_sort(name: str, spec: SortSpec, kind: str = "supplier") -> None:
    flt = spec.filter
    f, match = sql.filtered(flt.adj, flt.level, flt.location, flt.price_threshold)
    s = spec.signal
    prep = "prep AS (SELECT * FROM f)"
    if isinstance(s, Momentum):
        prep = sql.momentum(s.window, s.skip, "ret_adj")
    if isinstance(s, Reversal):
        prep = sql.reversal(s.window, s.skip, "ret_adj")
    ctes = sql.sort(kind, spec.signal_name, spec.nport, spec.holding, f=f, match=match, prep=prep, ep=True, dynamic=spec.dynamic_weights)
    register(name, sql.long_short(ctes, spec.nport))(lambda spark, sf_dir: rounded(strategy(spark, sf_dir, spec, kind).long_short))


_filter_sort("trim_ea_ep", SortSpec(Momentum(3, 1), 5, filter=FilterSpec("trim", 0.5)))
_filter_sort("trim_low_ea_ep", SortSpec("disc", 5, 2, filter=FilterSpec("trim", -0.3)))
_filter_sort("trim_band_ea_ep", SortSpec(Reversal(6, 2), 5, filter=FilterSpec("trim", (-0.4, 0.6))))
_filter_sort("price_ea_ep", SortSpec("disc", 5, filter=FilterSpec("price", 150)))
_filter_sort("price_low_ea_ep", SortSpec("disc", 5, 2, filter=FilterSpec("price", 20), dynamic_weights=True))
_filter_sort("price_band_ea_ep", SortSpec("disc", 4, filter=FilterSpec("price", (60, 180))), "part")
_filter_sort("bounce_ea_ep", SortSpec("disc", 5, filter=FilterSpec("bounce", 0.05)))
_filter_sort("bounce_low_ea_ep", SortSpec(Momentum(3, 1), 5, filter=FilterSpec("bounce", -0.05)))
_filter_sort("wins_both_ea_ep", SortSpec(Momentum(3, 1), 5, filter=FilterSpec("wins", 95, "both")))
_filter_sort("wins_left_ea_ep", SortSpec(Reversal(6, 2), 5, filter=FilterSpec("wins", 90, "left")))


def _wins_sql(kind: str) -> str:
    f, _ = sql.filtered("wins", 98, "both")
    return f"""WITH {demo_panel.sql(kind)}, {f}
        SELECT "ID", date, {sql.r('ret_adj', 'ret_adj')}, {sql.r('ret_adj_ep', 'ret_adj_ep')} FROM f"""


@register("wins_returns", _wins_sql("supplier"))
def wins_returns(spark, sf_dir):
    out = add_filtered(demo_panel.load(spark, sf_dir), FilterSpec("wins", 98, "both"))
    return rounded(out.select("ID", "date", "ret_adj", "ret_adj_ep"))


@register("wins_from_table", f"""WITH {demo_panel.sql("part", "other")}, {demo_panel.sql()},
    th AS (SELECT date, quantile_cont(ret, 0.02) AS lo, quantile_cont(ret, 0.98) AS hi FROM other GROUP BY date)
    SELECT "ID", date, round(CASE WHEN ret > hi THEN hi ELSE ret END, 8) + 0.0 AS ret_adj FROM panel LEFT JOIN th USING (date)""")
def wins_from_table(spark, sf_dir):
    part = demo_panel.load(spark, sf_dir, "part")
    levels = counted_percentiles(part, ["date"], "ret", {"2": 0.02, "98": 0.98})  # no task gathers a date
    table = levels.select("date", F.col("name").cast("double").alias("level"), "value")
    out = add_filtered(demo_panel.load(spark, sf_dir), FilterSpec("wins", 98, "right", thresholds=table))
    return rounded(out.select("ID", "date", "ret_adj"))


@register("expanding_percentiles", f"""WITH {demo_panel.sql("part")}, ds AS (SELECT DISTINCT date FROM panel)
    SELECT ds.date, {sql.r('quantile_cont(p.ret, 0.01)', 'lo')}, {sql.r('quantile_cont(p.ret, 0.99)', 'hi')}
    FROM ds JOIN panel p ON p.date < ds.date AND p.ret IS NOT NULL GROUP BY ds.date""")
def expanding_percentiles(spark, sf_dir):
    return rounded(expanding_bounds(demo_panel.load(spark, sf_dir, "part"), 1, 99).toDF("date", "lo", "hi"))


_out, _ = sql.filtered("trim", (-0.3, 0.4))


@register("excluded_stats", f"""WITH {demo_panel.sql("part")}, {_out},
    o AS (SELECT *, CASE WHEN "RATING_NUM" > 10 THEN 'NIG' ELSE 'IG' END AS category FROM f WHERE out),
    s AS (SELECT coalesce(category, 'ALL') AS category, count(ret) AS n, avg(ret) AS mean, stddev_samp(ret) AS std, min(ret) AS min,
          quantile_cont(ret, 0.25) AS p25, quantile_cont(ret, 0.5) AS p50, quantile_cont(ret, 0.75) AS p75, max(ret) AS max,
          avg(qty) AS avg_qty FROM o GROUP BY ROLLUP (category))
    SELECT category, n, {', '.join(sql.r(c, c) for c in ("mean", "std", "min", "p25", "p50", "p75", "max", "avg_qty"))},
           round(CAST(n AS DOUBLE) / (SELECT n FROM s WHERE category = 'ALL'), 8) + 0.0 AS share FROM s""")
def excluded_stats(spark, sf_dir):
    spec = SortSpec("disc", 4, filter=FilterSpec("trim", (-0.3, 0.4)), chars=("qty",))
    return rounded(strategy(spark, sf_dir, spec, "part").get_excluded())


# ---------------------------------------------------------------- double sorts

_UN = sql.sort("part", "disc", 3, 2, signal2="qty", n2=3)
_CO = sql.sort("part", "disc", 3, 2, signal2="lines", n2=3, how="conditional")


@register("double_uncond", sql.portfolios(_UN))
def double_uncond(spark, sf_dir):
    return rounded(strategy(spark, sf_dir, SortSpec("disc", 3, 2, "qty", 3), "part").returns)


@register("double_uncond_long_short", sql.long_short(_UN, 3, 3))
def double_uncond_long_short(spark, sf_dir):
    return rounded(strategy(spark, sf_dir, SortSpec("disc", 3, 2, "qty", 3), "part").long_short)


@register("double_cond", sql.portfolios(_CO))
def double_cond(spark, sf_dir):
    return rounded(strategy(spark, sf_dir, SortSpec("disc", 3, 2, "lines", 3, "conditional"), "part").returns)


# ---------------------------------------------------------------- turnover, weights, characteristics, banding


def _turnover(name: str, K: int, flt: FilterSpec | None = None) -> None:
    f, match = sql.filtered(flt.adj, flt.level) if flt else (_f, "true")
    ctes = sql.sort("supplier", "disc", 5, K, f=f, match=match, ep=flt is not None, dynamic=True)
    oracle = f"WITH {ctes}, {sql.turnover(K)} SELECT date, regime, CAST(ptf AS INTEGER) AS ptf, {sql.r('ew', 'ew')}, {sql.r('vw', 'vw')} FROM turn"
    spec = SortSpec("disc", 5, K, filter=flt, dynamic_weights=True, turnover=True)
    register(name, oracle)(lambda spark, sf_dir: rounded(strategy(spark, sf_dir, spec).turnover))


_turnover("turnover_k1", 1)
_turnover("turnover_k3", 3)
_turnover("turnover_trim_ea_ep", 2, FilterSpec("trim", 0.5))


@register("weights_k2", f"""WITH {sql.sort("supplier", "disc", 5, 2)}, {sql.turnover(2)}
    SELECT date, cohort, ptf, "ID", {sql.r('ew', 'ew')}, {sql.r('vw', 'vw')}, {sql.r('drift * ew', 'ew_drift')}, {sql.r('drift * vw', 'vw_drift')}
    FROM wt JOIN (SELECT date, t AS s FROM cal) USING (s)""")
def weights_k2(spark, sf_dir):
    return rounded(strategy(spark, sf_dir, SortSpec("disc", 5, 2)).get_ptf_weights())


_CH = ("qty", "lines")


@register("chars_k1", f"""WITH {sql.sort("supplier", "disc", 5, chars=_CH)}, {sql.chars(_CH, 1)}
    SELECT date, regime, CAST(ptf AS INTEGER) AS ptf, char, {sql.r('ew', 'ew')}, {sql.r('vw', 'vw')} FROM ch""")
def chars_k1(spark, sf_dir):
    return rounded(strategy(spark, sf_dir, SortSpec("disc", 5, chars=_CH)).characteristics)


@register("chars_k3_dynamic", f"""WITH {sql.sort("supplier", "disc", 5, 3, chars=_CH, dynamic=True)}, {sql.chars(_CH, 3)}
    SELECT date, regime, CAST(ptf AS INTEGER) AS ptf, char, {sql.r('ew', 'ew')}, {sql.r('vw', 'vw')} FROM ch""")
def chars_k3_dynamic(spark, sf_dir):
    return rounded(strategy(spark, sf_dir, SortSpec("disc", 5, 3, chars=_CH, dynamic_weights=True)).characteristics)


@register("mean_chars", f"""WITH {sql.sort("supplier", "disc", 5, chars=_CH)}, {sql.chars(_CH, 1)}
    SELECT regime, CAST(ptf AS INTEGER) AS ptf, char, {sql.r('avg(ew)', 'ew')}, {sql.r('avg(vw)', 'vw')} FROM ch GROUP BY ALL""")
def mean_chars(spark, sf_dir):
    return rounded(summary.mean_chars(strategy(spark, sf_dir, SortSpec("disc", 5, chars=_CH))))


def _banded(name: str, K: int, width: int, kind: str) -> None:
    ctes = sql.sort(kind, "disc", 5, K).replace(sql.returns(K), sql.banded(5, width, K) + ", " + sql.returns(K, "band"))
    register(name, sql.portfolios(ctes).replace("WITH ", "WITH RECURSIVE ", 1))(
        lambda spark, sf_dir: rounded(strategy(spark, sf_dir, SortSpec("disc", 5, K, banding=width), kind).returns)
    )


_banded("banding_b1", 1, 1, "supplier")
_banded("banding_b2_k3", 3, 2, "supplier")
_banded("banding_b1_part", 2, 1, "part")
_banded("banding_b4_fold", 1, 4, "supplier")


# ---------------------------------------------------------------- inference

_SERIES = f"""{ONE}, series AS (SELECT 'ptf_' || ptf AS series, date, ew AS value FROM res)"""


def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    returns = strategy(spark, sf_dir, SortSpec("disc", 5)).returns
    return returns.select(F.concat(F.lit("ptf_"), F.col("ptf").cast("string")).alias("series"), "date", F.col("ew").alias("value"))


@register("hac_mean", f"""WITH {_SERIES}, {sql.hac("series", 3)}
    SELECT series, n, {sql.r('mean', 'mean')}, {sql.r('se', 'se')}, {sql.r('t', 't')} FROM hac""")
def hac_mean(spark, sf_dir):
    return rounded(inference.hac_mean(_series(spark, sf_dir), ["series"], 3))


#: Equal- and value-weighted market series, the latter without its first date.
_FACTORS = """lgf AS (SELECT *, lag("VW") OVER (PARTITION BY "ID" ORDER BY date) AS lw FROM panel),
    fv AS (SELECT date, sum(ret * lw) / nullif(sum(lw), 0) AS x2 FROM lgf WHERE lw IS NOT NULL AND ret IS NOT NULL GROUP BY date),
    fac AS (SELECT date, x1, x2 FROM (SELECT date, avg(ret) AS x1 FROM panel GROUP BY date) JOIN fv USING (date))"""


def _market_factors(panel: DataFrame) -> DataFrame:
    both = {"mkt": factors.market_ew(panel), "mktv": factors.market_vw(panel)}
    return both["mkt"].withColumnRenamed("value", "mkt").join(both["mktv"].withColumnRenamed("value", "mktv"), "date")


def _alpha_sql(by: str, lag: int) -> str:
    """From ``series`` and ``fac``: the columns of ``hac_alpha``."""
    return f"""j AS (SELECT series.*, value AS y, x1, x2 FROM series JOIN fac USING (date)), {sql.hac(by, lag, "j")}, {sql.alpha(by, lag)}
    SELECT {by}, n, {sql.r('mean', 'mean')}, {sql.r('t', 't')}, {sql.r(sql.normal_p('t'), 'p')}, {sql.r('alpha', 'alpha')}, {sql.r('alpha_t', 'alpha_t')},
           {sql.r(sql.normal_p('alpha_t'), 'alpha_p')} FROM hac JOIN al USING ({by})"""


@register("hac_alpha", f"WITH {_SERIES}, {_FACTORS}, {_alpha_sql('series', 2)}")
def hac_alpha(spark, sf_dir):
    market = _market_factors(demo_panel.load(spark, sf_dir))
    return rounded(inference.hac_alpha(_series(spark, sf_dir), market, ["mkt", "mktv"], ["series"], 2))


_TRIMMED = sql.filtered("trim", 0.5)


@register("strategy_alphas", f"""WITH {sql.sort("supplier", "disc", 5, f=_TRIMMED[0], match=_TRIMMED[1], ep=True)}, {sql.ls(5)}, {_FACTORS},
    series AS (SELECT regime, 'ew' AS weighting, date, ew AS value FROM ls UNION ALL SELECT regime, 'vw', date, vw FROM ls),
    {_alpha_sql('regime, weighting', 1)}""")
def strategy_alphas(spark, sf_dir):
    """Alphas of the long-short series with and without look-ahead."""
    panel = demo_panel.load(spark, sf_dir)
    s = Strategy(panel, SortSpec("disc", 5, filter=FilterSpec("trim", 0.5)))
    return rounded(s.get_alphas(_market_factors(panel), ["mkt", "mktv"], 1))


@register("hac_mean_p_values", f"""WITH {_SERIES}, {sql.hac("series", 1)}
    SELECT series, n, {sql.r('mean', 'mean')}, {sql.r('se', 'se')}, {sql.r('t', 't')}, {sql.r(sql.normal_p('t'), 'p')} FROM hac""")
def hac_mean_p_values(spark, sf_dir):
    return rounded(inference.with_normal_p(inference.hac_mean(_series(spark, sf_dir), ["series"], 1)))


@register("strategy_summary", f"""WITH {sql.sort("supplier", "disc", 5, chars=_CH)}, {sql.turnover(1)}, {sql.ls(5)}, {sql.chars(_CH, 1)},
    every AS (SELECT 'long_short' AS series, regime, date, ew, vw FROM ls
              UNION ALL SELECT CASE WHEN ptf = 5 THEN 'long' ELSE 'short' END, regime, date, ew, vw FROM res WHERE ptf IN (1, 5)
              UNION ALL SELECT 'ptf_' || ptf, regime, date, ew, vw FROM res),
    series AS (SELECT series, regime, 'ew' AS weighting, date, ew AS value FROM every UNION ALL SELECT series, regime, 'vw', date, vw FROM every),
    {sql.hac("series, regime, weighting", 0)},
    mt AS (SELECT 'ptf_' || ptf AS series, regime, 'ew' AS weighting, avg(ew) * 100 AS turnover FROM turn GROUP BY ALL
           UNION ALL SELECT 'ptf_' || ptf, regime, 'vw', avg(vw) * 100 FROM turn GROUP BY ALL),
    mch AS (SELECT 'ptf_' || ptf AS series, regime, w.weighting, {', '.join(f"avg(CASE WHEN char = '{c}' THEN CASE w.weighting WHEN 'ew' THEN ew ELSE vw END END) AS char_{c}" for c in _CH)}
           FROM ch CROSS JOIN (VALUES ('ew'), ('vw')) w(weighting) GROUP BY ALL)
    SELECT series, regime, weighting, n, {sql.r('mean * 100', 'mean')}, {sql.r('se * 100', 'se')}, {sql.r('t', 't')}, {sql.r(sql.normal_p('t'), 'p')},
           {sql.r('turnover', 'turnover')}, {', '.join(sql.r(f'char_{c}', f'char_{c}') for c in _CH)}
    FROM hac LEFT JOIN mt USING (series, regime, weighting) LEFT JOIN mch USING (series, regime, weighting)""")
def strategy_summary(spark, sf_dir):
    return rounded(summary.summary(strategy(spark, sf_dir, SortSpec("disc", 5, turnover=True, chars=_CH))))


@register("sharpe", f"""WITH {_SERIES}, m AS (SELECT series, count(*) AS n, avg(value) AS mean, stddev_samp(value) AS std FROM series GROUP BY series)
    SELECT series, n, {sql.r('mean', 'mean')}, {sql.r('std', 'std')}, {sql.r('mean / nullif(std, 0) * sqrt(12)', 'sharpe')},
           {sql.r('mean - 1.96 * std / sqrt(n)', 'low')}, {sql.r('mean + 1.96 * std / sqrt(n)', 'high')} FROM m""")
def sharpe(spark, sf_dir):
    return rounded(inference.moments(_series(spark, sf_dir), ["series"], per_year=12))


def _sources() -> str:
    """Long-short series of three versions of the supplier panel, as SQL."""
    one = []
    for name, flt in SOURCES.items():
        f, match = sql.filtered(flt.adj, flt.level) if flt else (_f, "true")
        for n in (3, 5):
            ctes = sql.sort("supplier", "disc", n, f=f, match=match)
            one.append(f"SELECT '{name}' AS source, 'disc_{n}' AS series, date, ew AS value FROM (WITH {ctes}, {sql.ls(n)} SELECT * FROM ls)")
    return " UNION ALL ".join(one)


SOURCES = {"raw": None, "trim": FilterSpec("trim", 0.5), "price": FilterSpec("price", 150)}


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    panel = files.written(demo_panel.load(spark, sf_dir), "source-panel")  # six sorts read it
    for name, flt in SOURCES.items():
        for n in (3, 5):
            series = Strategy(panel, SortSpec("disc", n, filter=flt)).get_long_short()
            part = series.select(F.lit(name).alias("source"), F.lit(f"disc_{n}").alias("series"), "date", F.col("ew").alias("value"))
            out = part if out is None else out.unionByName(part)
    return out


@register("corr_sources", f"""WITH s AS ({_sources()})
    SELECT a.series, count(*) AS n, {sql.r('corr(a.value, b.value)', 'corr')} FROM s a JOIN s b ON a.series = b.series AND a.date = b.date
    WHERE a.source = 'raw' AND b.source = 'trim' AND a.value IS NOT NULL AND b.value IS NOT NULL GROUP BY a.series""")
def corr_sources(spark, sf_dir):
    s = sources(spark, sf_dir)
    of = lambda name: s.where(F.col("source") == name).drop("source")
    return rounded(inference.correlations(of("raw"), of("trim"), ["series"]))


PAIRS = (("raw", "trim"), ("raw", "price"), ("trim", "price"))


_PAIRED = f"""s AS ({_sources()}), pr(a, b) AS (VALUES {', '.join(str(p) for p in PAIRS)}),
    d AS (SELECT x.series, pr.a || '-' || pr.b AS pair, x.value - y.value AS d FROM pr JOIN s x ON x.source = pr.a
          JOIN s y ON y.source = pr.b AND y.series = x.series AND y.date = x.date WHERE x.value IS NOT NULL AND y.value IS NOT NULL),
    g AS (SELECT *, m * sqrt(n) / nullif(sd, 0) AS t FROM (SELECT series, pair, count(*) AS n, avg(d) AS m, stddev_samp(d) AS sd FROM d GROUP BY series, pair))"""


@register("paired_t", f"WITH {_PAIRED} SELECT series, pair, n, {sql.r('m', 'mean_diff')}, {sql.r('t', 't')} FROM g")
def paired_t(spark, sf_dir):
    return rounded(inference.paired_t(sources(spark, sf_dir), PAIRS, ["series"]))


@register("paired_t_p_values", f"""WITH {_PAIRED} SELECT series, pair, n, {sql.r('m', 'mean_diff')}, {sql.r('t', 't')},
    {sql.r(sql.student_p('t', '(n - 1)'), 'p')} FROM g""")
def paired_t_p_values(spark, sf_dir):
    return rounded(inference.with_student_p(inference.paired_t(sources(spark, sf_dir), PAIRS, ["series"])))


@register("significant_differences", f"""WITH {_PAIRED} SELECT pair, count(*) FILTER (WHERE {sql.student_p('t', '(n - 1)')} <= 0.05) AS significant
    FROM g GROUP BY pair""")
def significant_differences(spark, sf_dir):
    tests = inference.with_student_p(inference.paired_t(sources(spark, sf_dir), PAIRS, ["series"]))
    return inference.count_significant(tests, ["pair"])


def _pairs_sql() -> str:
    """The comparison table over ``s`` (source, series, date, value)."""
    names = [*SOURCES]
    wide = f"""w AS (SELECT replace(series, '*', '') AS series, date, {', '.join(f"max(CASE WHEN source = '{n}' THEN value END) AS {n}" for n in names)} FROM s GROUP BY 1, 2)"""
    of = lambda a, b: f"count({a} - {b}) AS n_{a}_{b}, avg({a} - {b}) * sqrt(count({a} - {b})) / nullif(stddev_samp({a} - {b}), 0) AS t_{a}_{b}, corr({a}, {b}) AS c_{a}_{b}"
    sums = f"g AS (SELECT series, {', '.join(f'avg({n}) AS m_{n}, stddev_samp({n}) AS s_{n}' for n in names)}, {', '.join(of(a, b) for a, b in PAIRS)} FROM w GROUP BY series)"
    p = {(a, b): sql.student_p(f"t_{a}_{b}", f"(n_{a}_{b} - 1)") for a, b in PAIRS}
    return f"""{wide}, {sums}, t AS (SELECT series, {', '.join(sql.r(f'c_{a}_{b}', f'corr_{a}_{b}') for a, b in PAIRS)},
        {', '.join(sql.r(f'm_{n} * 100', f'mean_{n}') for n in names)}, {', '.join(sql.r(f'm_{n} / nullif(s_{n}, 0) * sqrt(12)', f'sharpe_{n}') for n in names)},
        {', '.join(sql.r(x, f'p_{a}_{b}') for (a, b), x in p.items())} FROM g)
        SELECT *, {', '.join(f'count(*) FILTER (WHERE p_{a}_{b} <= 0.05) OVER () AS significant_{a}_{b}' for a, b in PAIRS)} FROM t"""


@register("comparison_table", f"WITH s AS ({_sources()}), {_pairs_sql()}")
def comparison_table(spark, sf_dir):
    """Three versions of the same strategies compared in one table, written and read back, with the counts of significant differences."""
    starred = F.when(F.col("source") == "trim", F.concat("series", F.lit("*"))).otherwise(F.col("series"))
    table = inference.comparison_table(sources(spark, sf_dir).withColumn("series", starred), [*SOURCES])
    kept = files.written(table, "comparison")
    return rounded(kept.join(F.broadcast(inference.significant_pairs(kept))))  # one row of counts


_WEALTH = f"""WITH {ONE}, {sql.ls(5)} SELECT date,
    CASE WHEN ew IS NOT NULL THEN round(product(1 + ew) OVER w, 8) + 0.0 END AS wealth,
    CASE WHEN ew IS NOT NULL THEN round(sum(ew) OVER w, 8) + 0.0 END AS total
    FROM ls WINDOW w AS (ORDER BY date ROWS UNBOUNDED PRECEDING)"""


@register("cum_wealth", _WEALTH)
def cum_wealth(spark, sf_dir):
    series = strategy(spark, sf_dir, SortSpec("disc", 5)).get_long_short().select("date", F.col("ew").alias("value"))
    return rounded(add_running_sum(add_wealth(series)).select("date", "wealth", "total"))


# ---------------------------------------------------------------- factors

_MVW = """lg AS (SELECT *, lag("VW") OVER (PARTITION BY "ID" ORDER BY date) AS lw FROM panel),
    mv AS (SELECT date, sum(ret * lw) / nullif(sum(lw), 0) AS value FROM lg WHERE lw IS NOT NULL AND ret IS NOT NULL GROUP BY date)"""


@register("market_ew", f"WITH {demo_panel.sql()} SELECT date, {sql.r('avg(ret)', 'value')} FROM panel GROUP BY date")
def market_ew(spark, sf_dir):
    return rounded(factors.market_ew(demo_panel.load(spark, sf_dir)))


@register("market_vw_lag", f"WITH {demo_panel.sql()}, {_MVW} SELECT date, {sql.r('value', 'value')} FROM mv")
def market_vw_lag(spark, sf_dir):
    return rounded(factors.market_vw(demo_panel.load(spark, sf_dir)))


@register("market_excess", f"""WITH {demo_panel.sql()}, {_MVW}, {demo_panel.sql("part", "other")},
    rf AS (SELECT date, min(disc) / 1000 AS rf FROM other GROUP BY date)
    SELECT date, {sql.r('value - rf', 'value')} FROM mv JOIN rf USING (date)""")
def market_excess(spark, sf_dir):
    riskless = demo_panel.load(spark, sf_dir, "part").groupBy("date").agg((F.min("disc") / 1000).alias("rf"))
    return rounded(factors.excess(factors.market_vw(demo_panel.load(spark, sf_dir)), riskless))


_D2 = {"qty": sql.sort("part", '"RATING_NUM"', 3, signal2="qty", n2=3), "disc": sql.sort("part", '"RATING_NUM"', 3, signal2="disc", n2=3)}


def _col_sql(ctes: str, n2: int = 3) -> str:
    return f"""(WITH {ctes}, q AS (SELECT date, (ptf - 1) // {n2} AS i, max(CASE WHEN (ptf - 1) % {n2} = {n2 - 1} THEN vw END)
        - max(CASE WHEN (ptf - 1) % {n2} = 0 THEN vw END) AS d FROM res GROUP BY 1, 2) SELECT date, avg(d) AS value FROM q GROUP BY date)"""


def _row_sql(ctes: str, n1: int = 3, n2: int = 3) -> str:
    return f"""(WITH {ctes}, q AS (SELECT date, (ptf - 1) % {n2} AS j, max(CASE WHEN (ptf - 1) // {n2} = {n1 - 1} THEN vw END)
        - max(CASE WHEN (ptf - 1) // {n2} = 0 THEN vw END) AS d FROM res GROUP BY 1, 2) SELECT date, avg(d) AS value FROM q GROUP BY date)"""


def _double(spark: SparkSession, sf_dir: str, signal2: str) -> DataFrame:
    return strategy(spark, sf_dir, SortSpec("RATING_NUM", 3, 1, signal2, 3), "part").returns


@register("char_factor", f"SELECT date, {sql.r('value', 'value')} FROM {_col_sql(_D2['qty'])}")
def char_factor(spark, sf_dir):
    return rounded(factors.column_factor(_double(spark, sf_dir, "qty"), 3))


@register("crf_factor", f"""SELECT date, {sql.r('avg(value)', 'value')} FROM (
    SELECT * FROM {_row_sql(_D2['qty'])} UNION ALL SELECT * FROM {_row_sql(_D2['disc'])}) GROUP BY date""")
def crf_factor(spark, sf_dir):
    return rounded(factors.mean_of(*[factors.row_factor(_double(spark, sf_dir, s), 3, 3) for s in ("qty", "disc")]))


@register("composite_factor", f"""WITH a AS (WITH {ONE}, {sql.ls(5)} SELECT date, vw FROM ls),
    b AS (WITH {sql.sort("supplier", "qty", 5)}, {sql.ls(5)} SELECT date, vw FROM ls)
    SELECT date, CASE WHEN count(vw) = 2 THEN round(avg(vw), 8) + 0.0 END AS value FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY date""")
def composite_factor(spark, sf_dir):
    of = lambda s: strategy(spark, sf_dir, SortSpec(s, 5)).get_long_short().select("date", F.col("vw").alias("value"))
    return rounded(factors.composite(of("disc"), of("qty")))


@register("net_of_cost", f"""WITH {sql.sort("supplier", "disc", 5, dynamic=True)}, {sql.turnover(1)}, {sql.ls(5)},
    lt AS (SELECT date, CASE WHEN count(vw) = 2 THEN avg(vw) END AS turnover FROM turn WHERE ptf IN (1, 5) GROUP BY date),
    j AS (SELECT ls.date, ls.vw AS gross, turnover FROM ls LEFT JOIN lt USING (date))
    SELECT date, {sql.r('gross', 'gross')}, {sql.r('gross - lag(turnover) OVER (ORDER BY date) * (19.0::DOUBLE / 10000) * 2', 'net')} FROM j""")
def net_of_cost(spark, sf_dir):
    s = strategy(spark, sf_dir, SortSpec("disc", 5, dynamic_weights=True, turnover=True))
    gross = s.get_long_short().select("date", F.col("vw").alias("value"))
    return rounded(factors.net_of_cost(gross, factors.leg_turnover(s.get_ptf_turnover(), 1, 5)))


def _net_sql(signal: str) -> str:
    """(date, gross, net) of the value-weighted long-short series."""
    return f"""(WITH {sql.sort("supplier", signal, 5, dynamic=True)}, {sql.turnover(1)}, {sql.ls(5)},
        lt AS (SELECT date, CASE WHEN count(vw) = 2 THEN avg(vw) END AS turnover FROM turn WHERE ptf IN (1, 5) GROUP BY date)
        SELECT ls.date, ls.vw AS gross, ls.vw - lag(turnover) OVER (ORDER BY ls.date) * (19.0::DOUBLE / 10000) * 2 AS net
        FROM ls LEFT JOIN lt ON lt.date = ls.date)"""


FACTORS = ("disc", "qty", "RATING_NUM")


@register("factor_set", f"""WITH w AS ({' UNION ALL '.join(f"SELECT '{s}' AS factor, * FROM {_net_sql(chr(34) + s + chr(34))}" for s in FACTORS)}),
    s AS (SELECT factor, 'gross' AS cost, date, gross AS value FROM w UNION ALL SELECT factor, 'net', date, net FROM w),
    m AS (WITH {demo_panel.sql()}, {_MVW} SELECT date, value AS market FROM mv),
    g AS (SELECT factor, cost, count(*) AS n, avg(value) AS mean, stddev_samp(value) AS std FROM s GROUP BY ALL),
    c AS (SELECT factor, cost, corr(value, market) AS corr FROM s JOIN m USING (date) WHERE value IS NOT NULL AND market IS NOT NULL GROUP BY ALL)
    SELECT factor, cost, n, {sql.r('mean', 'mean')}, {sql.r('std', 'std')}, {sql.r('mean / nullif(std, 0) * sqrt(12)', 'sharpe')},
           {sql.r('mean - 1.96 * std / sqrt(n)', 'low')}, {sql.r('mean + 1.96 * std / sqrt(n)', 'high')}, {sql.r('corr', 'corr')} FROM g JOIN c USING (factor, cost)""")
def factor_set(spark, sf_dir):
    """Factors before and after the cost of trading: moments, and the correlation with a factor that is known (the market)."""
    panel = files.written(demo_panel.load(spark, sf_dir), "factor-panel")
    series = None
    for name in FACTORS:
        s = Strategy(panel, SortSpec(name, 5, dynamic_weights=True, turnover=True))
        gross = s.get_long_short().select("date", F.col("vw").alias("value"))
        both = factors.net_of_cost(gross, factors.leg_turnover(s.get_ptf_turnover(), 1, 5)).unpivot("date", ["gross", "net"], "cost", "value")
        both = both.withColumn("factor", F.lit(name))
        series = both if series is None else series.unionByName(both)
    series = files.written(series, "factor-series")
    known = F.broadcast(factors.market_vw(panel).withColumnRenamed("value", "market"))
    related = series.join(known, "date").dropna().groupBy("factor", "cost").agg(F.corr("value", "market").alias("corr"))
    return rounded(inference.moments(series, ["factor", "cost"], per_year=12).join(related, ["factor", "cost"]))


CORNERS = ("qty", "disc")


def _corner_sql(signal: str) -> str:
    """Names for a banded 5 x 5 sort: its corners by column and by row, returns and turnover."""
    ctes = sql.sort("part", '"RATING_NUM"', 5, dynamic=True, signal2=signal, n2=5)
    ctes = ctes.replace(sql.returns(1), sql.banded(25, 1, 1) + ", " + sql.returns(1, "band"))
    both = "SELECT 'gross' AS what, date, ptf, vw FROM res UNION ALL SELECT 'turn', date, ptf, vw FROM turn"
    at = {"col": ("(ptf - 1) // 5", "(ptf - 1) % 5"), "row": ("(ptf - 1) % 5", "(ptf - 1) // 5")}
    side = lambda by, k: f"max(CASE WHEN {by} = {k} THEN vw END)"
    parts = [
        f"""SELECT kind, what, date, avg(CASE WHEN what = 'gross' THEN hi - lo ELSE (hi + lo) / 2 END) AS value FROM (
            SELECT '{kind}' AS kind, what, date, {other} AS o, {side(by, 4)} AS hi, {side(by, 0)} AS lo FROM b GROUP BY ALL) GROUP BY ALL"""
        for kind, (other, by) in at.items()
    ]
    return f"(WITH RECURSIVE {ctes}, {sql.turnover(1, 'band')}, b AS ({both}) {' UNION ALL '.join(parts)})"


@register("corner_factors_net", f"""WITH c AS ({' UNION ALL '.join(f"SELECT '{s}' AS signal, * FROM {_corner_sql(s)}" for s in CORNERS)}),
    f AS (SELECT signal AS factor, what, date, value FROM c WHERE kind = 'col' UNION ALL
          SELECT 'RATING_NUM', what, date, avg(value) FROM c WHERE kind = 'row' GROUP BY ALL),
    j AS (SELECT factor, date, g.value AS gross, t.value AS turnover FROM (SELECT * FROM f WHERE what = 'gross') g
          LEFT JOIN (SELECT * FROM f WHERE what = 'turn') t USING (factor, date))
    SELECT factor, date, {sql.r('gross', 'gross')},
           {sql.r('gross - lag(turnover) OVER (PARTITION BY factor ORDER BY date) * (19.0::DOUBLE / 10000) * 2', 'net')} FROM j""")
def corner_factors_net(spark, sf_dir):
    """Factors of banded 5 x 5 sorts with updated weights, before and after the cost of trading their corners."""
    panel = files.written(demo_panel.load(spark, sf_dir, "part"), "factor-panel")
    spec = lambda s: SortSpec("RATING_NUM", 5, 1, s, 5, dynamic_weights=True, banding=1, turnover=True)
    return rounded(factors.corner_factors({s: Strategy(panel, spec(s)) for s in CORNERS}, "RATING_NUM"))


# ---------------------------------------------------------------- panels, joins, grid, files


@register("sample_facts", f"""WITH {demo_panel.sql("part")} SELECT count(DISTINCT "ID") AS n_ids, min(date) AS first_date, max(date) AS last_date,
    count(DISTINCT date) AS n_dates, count(*) AS n_rows FROM panel""")
def sample_facts(spark, sf_dir):
    return panels.facts(demo_panel.load(spark, sf_dir, "part"))


@register("panel_merge", f"""WITH {demo_panel.sql()}, g AS (SELECT l_suppkey AS "ID", CAST(date_trunc('month', l_shipdate) AS DATE) AS date,
    count(*) AS returned FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2) SELECT "ID", date, {sql.r('ret', 'ret')}, returned FROM panel JOIN g USING ("ID", date)""")
def panel_merge(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_returnflag = 'R'")
    flags = lines.groupBy(F.col("l_suppkey").alias("ID"), F.trunc("l_shipdate", "month").alias("date")).agg(F.count(F.lit(1)).alias("returned"))
    return rounded(panels.merge_panels(demo_panel.load(spark, sf_dir), flags).select("ID", "date", "ret", "returned"))


@register("interval_join", f"""WITH {demo_panel.sql("part")},
    ch AS (SELECT "ID", date, "RATING_NUM", lag("RATING_NUM") OVER w AS pr FROM panel WINDOW w AS (PARTITION BY "ID" ORDER BY date)),
    hist AS (SELECT "ID", date AS valid_from, coalesce(lead(date) OVER (PARTITION BY "ID" ORDER BY date) - 1, DATE '9999-12-31') AS valid_to,
             "RATING_NUM" AS rated FROM ch WHERE pr IS NULL OR pr <> "RATING_NUM")
    SELECT p."ID", CAST(o_orderdate AS DATE) AS date, rated, count(*) AS lines_n FROM lineitem l JOIN orders o ON o_orderkey = l_orderkey
    JOIN (SELECT DISTINCT "ID" FROM panel) p ON p."ID" = l_partkey
    JOIN hist h ON h."ID" = p."ID" AND CAST(o_orderdate AS DATE) BETWEEN valid_from AND valid_to GROUP BY 1, 2, 3""")
def interval_join(spark, sf_dir):
    panel = demo_panel.load(spark, sf_dir, "part")
    by = Window.partitionBy("ID").orderBy("date")
    before = F.lag("RATING_NUM").over(by)
    changes = panel.withColumn("_new", before.isNull() | (before != F.col("RATING_NUM"))).where("_new")
    end = F.coalesce(F.date_sub(F.lead("date").over(by), 1), F.lit("9999-12-31").cast("date"))
    history = changes.select("ID", F.col("date").alias("valid_from"), end.alias("valid_to"), F.col("RATING_NUM").alias("rated"))
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", F.col("l_partkey").alias("ID"))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.to_date("o_orderdate").alias("date"))
    parts = demo_panel.parts_for(lines)  # so that no task's sort grows with the tables
    lines, orders = lines.repartition(parts, "l_orderkey"), orders.repartition(parts, "o_orderkey")
    traded = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).select("ID", "date")
    valid = panels.valid_rows(traded, history, "ID", "date", "valid_from", "valid_to", parts=parts)
    return valid.groupBy("ID", "date", "rated").agg(F.count(F.lit(1)).alias("lines_n"))


GRID = tuple(
    SortSpec(Momentum(3, 1), 5, 1, filter=f)
    for f in (
        FilterSpec("trim", 0.3), FilterSpec("trim", 0.6), FilterSpec("trim", (-0.4, 0.4)), FilterSpec("price", 20), FilterSpec("price", 150),
        FilterSpec("bounce", 0.05), FilterSpec("bounce", -0.05), FilterSpec("wins", 95, "both"), FilterSpec("wins", 90, "right"),
    )
)


def _grid_sql(specs: tuple[SortSpec, ...], kind: str = "supplier") -> str:
    parts = []
    for s in specs:
        f, match = sql.filtered(s.filter.adj, s.filter.level, s.filter.location) if s.filter else (_f, "true")
        ret = "ret_adj" if s.filter else "ret"
        prep = "prep AS (SELECT * FROM f)"
        if isinstance(s.signal, Momentum):
            prep = sql.momentum(s.signal.window, s.signal.skip, ret)
        if isinstance(s.signal, Reversal):
            prep = sql.reversal(s.signal.window, s.signal.skip, ret)
        ratings = {None: "true", "IG": '"RATING_NUM" BETWEEN 1 AND 10', "NIG": '"RATING_NUM" > 10 AND "RATING_NUM" <= 22'}
        signal = f'"{s.signal}"' if isinstance(s.signal, str) else s.signal_name
        ctes = sql.sort(
            kind, signal, s.nport, s.holding, f=f, match=match, prep=prep, ep=s.filter is not None, rating=ratings[s.rating],
            dynamic=s.dynamic_weights, signal2=s.signal2, n2=s.nport2, how=s.how,
        )
        if s.banding is not None:
            ctes = ctes.replace(sql.returns(s.holding), sql.banded(s.nport, s.banding, s.holding) + ", " + sql.returns(s.holding, "band"))
        one = sql.long_short(ctes, s.nport, s.nport2)
        parts.append(f"SELECT '{s.name}' AS spec, * FROM ({one.replace('WITH ', 'WITH RECURSIVE ', 1) if s.banding is not None else one})")
    return " UNION ALL ".join(parts)


@register("grid_long_short", _grid_sql(GRID))
def grid_long_short(spark, sf_dir):
    return rounded(long_short_grid(demo_panel.load(spark, sf_dir), GRID))


_EA = [f"max(CASE WHEN spec = '{s.name}' THEN ew END) AS \"{s.name}\"" for s in GRID]


@register("grid_wide", f"SELECT date, {', '.join(_EA)} FROM ({_grid_sql(GRID)}) WHERE regime = 'ea' GROUP BY date")
def grid_wide(spark, sf_dir):
    long = long_short_grid(demo_panel.load(spark, sf_dir), GRID).where("regime = 'ea'")
    return rounded(files.wide(long.withColumnRenamed("ew", "value"), [s.name for s in GRID]))


#: Filters by the dozen, and how long portfolios are held.
SWEEP = tuple(
    SortSpec(Momentum(3, 1), 5, K, filter=f)
    for K in (1, 3)
    for f in (
        *[FilterSpec("trim", x) for x in (0.2, 0.3, 0.4, 0.5, 0.6, -0.5, -0.4, -0.3)], *[FilterSpec("trim", (-x, x)) for x in (0.3, 0.5)],
        *[FilterSpec("price", x) for x in (150, 200, 20, 40)], *[FilterSpec("bounce", x) for x in (-0.1, -0.05, 0.05, 0.1)],
        *[FilterSpec("wins", 98, x) for x in ("left", "right")], None,
    )
)


@register("grid_sweep", _grid_sql(SWEEP))
def grid_sweep(spark, sf_dir):
    """Forty-two strategies: what is left of a momentum strategy under each cleaning."""
    return rounded(long_short_grid(demo_panel.load(spark, sf_dir), SWEEP))


RATING_GRID = rating_grid(3)


@register("grid_rating_120", _grid_sql(RATING_GRID))
def grid_rating_120(spark, sf_dir):
    """A rating sort under each of 120 cleanings."""
    return rounded(long_short_grid(demo_panel.load(spark, sf_dir), RATING_GRID))


#: A study's momentum sorts: deciles, two windows, held as long, under each of 120 cleanings.
STUDY = momentum_grid()


@register("grid_momentum_240")
def grid_momentum_240(spark, sf_dir):
    """240 momentum strategies. Their SQL sums the order lines up once a strategy: it is run on the smallest tables only."""
    return rounded(long_short_grid(demo_panel.load(spark, sf_dir), STUDY))


#: Ratings, horizons, bands and second signals.
MIXED = (
    *[SortSpec("RATING_NUM", 3, K, filter=f) for K in (1, 2) for f in (None, FilterSpec("trim", 0.5))],
    SortSpec("disc", 3, rating="IG"), SortSpec("disc", 4, 2, rating="NIG", dynamic_weights=True), SortSpec(Reversal(6, 2), 3, filter=FilterSpec("price", 150)),
    *[SortSpec("disc", 5, 1, banding=w) for w in (1, 2)], SortSpec("disc", 3, 2, "qty", 3), SortSpec("disc", 3, 1, "lines", 2, "conditional"),
)


@register("grid_mixed", _grid_sql(MIXED, "part"))
def grid_mixed(spark, sf_dir):
    return rounded(long_short_grid(demo_panel.load(spark, sf_dir, "part"), MIXED))


@register("equity_market_cap", f"""WITH {demo_panel.sql()} SELECT "ID", date,
    round(abs("PRICE") / qty * (lines * 1.3::DOUBLE * 1000.0::DOUBLE) / 1000000.0::DOUBLE, 8) + 0.0 AS me FROM panel""")
def equity_market_cap(spark, sf_dir):
    me = panels.equity_market_cap(F.col("PRICE"), F.col("qty"), F.col("lines"), F.lit(1.3))
    return rounded(demo_panel.load(spark, sf_dir).select("ID", "date", me.alias("me")))


@register("active_panel", f"""WITH {demo_panel.sql()} SELECT "ID", date, {sql.r('-qty', 'neg_qty')}, coalesce(round(ret, 8) + 0.0, 0.0) AS ret
    FROM panel WHERE lines >= 5""")
def active_panel(spark, sf_dir):
    rows = panels.fill_equity(panels.active(demo_panel.load(spark, sf_dir), "lines", 5))
    return rounded(rows.select("ID", "date", (-F.col("qty")).alias("neg_qty"), "ret"))


@register("panel_csv", f"""WITH {demo_panel.sql()} SELECT "ID", date, {sql.r('ret', 'ret')}, {sql.r('"VW"', 'VW')} FROM panel""")
def panel_csv(spark, sf_dir):
    path = files.scratch(spark, "panel-csv")
    demo_panel.load(spark, sf_dir).select("ID", "date", "ret", "VW").write.csv(path, header=True)
    return rounded(files.read_panel_csv(spark, path, "ID long, date date, ret double, VW double"))


@register("canonical_panel", f"""WITH {demo_panel.sql("part")} SELECT "ID", date, {sql.r('ret', 'ret')}, "RATING_NUM", 1.0::DOUBLE AS "VW", {sql.r('disc', 'disc')} FROM panel""")
def canonical_panel(spark, sf_dir):
    """A panel with names of its own, dates as text, NaN for nothing and no weights, made canonical and checked."""
    raw = demo_panel.load(spark, sf_dir, "part").select(
        F.col("ID").alias("cusip"), F.date_format("date", "yyyy-MM-dd").alias("month"), F.coalesce("ret", F.lit(float("nan"))).alias("bond_ret"),
        F.lit(0.0).alias("ret"), F.col("RATING_NUM").alias("rating"), "disc", "qty",
    )
    names = {"cusip": "ID", "month": "date", "bond_ret": "ret", "rating": "RATING_NUM"}
    return rounded(panels.canonical(raw, names, keep=["disc"]))


@register("factor_table_csv", f"""WITH {demo_panel.sql()}, {_MVW}, {demo_panel.sql("part", "other")},
    o AS (SELECT date, avg(ret) AS parts FROM other GROUP BY date)
    SELECT date, {sql.r('value', 'mkt')}, {sql.r('parts', 'parts')} FROM mv JOIN o USING (date)""")
def factor_table_csv(spark, sf_dir):
    """A small factor table, written as CSV, read back, and joined to another series."""
    market = factors.market_vw(demo_panel.load(spark, sf_dir)).select("date", F.col("value").alias("mkt"))
    path = files.scratch(spark, "factor-table")
    market.write.csv(path, header=True)
    known = files.read_factors(spark, path, ["mkt"])
    parts = factors.market_ew(demo_panel.load(spark, sf_dir, "part")).withColumnRenamed("value", "parts")
    return rounded(known.join(F.broadcast(parts), "date"))


@register("percentile_csv", f"""WITH {demo_panel.sql("part")}, q AS (SELECT date, quantile_cont(ret, 0.02) AS a, quantile_cont(ret, 0.98) AS b FROM panel GROUP BY date)
    SELECT date, 2.0::DOUBLE AS level, {sql.r('a', 'value')} FROM q UNION ALL SELECT date, 98.0::DOUBLE, {sql.r('b', 'value')} FROM q""")
def percentile_csv(spark, sf_dir):
    levels = demo_panel.load(spark, sf_dir, "part").groupBy("date").agg(F.percentile("ret", 0.02).alias("2"), F.percentile("ret", 0.98).alias("98"))
    path = files.scratch(spark, "percentiles-csv")
    levels.write.csv(path, header=True)
    return rounded(files.read_percentiles(spark, path, ["2", "98"]))


@register("factor_csv", f"""WITH {demo_panel.sql()}, {_MVW} SELECT last_day(date) AS date, {sql.r('value', 'mkt')},
    CASE WHEN month(date) <> 6 THEN round(value / 2, 8) + 0.0 END AS half FROM mv""")
def factor_csv(spark, sf_dir):
    """Market series written as a monthly factor file: text above, percent, a cell that is no number, a year below."""
    market = factors.market_vw(demo_panel.load(spark, sf_dir)).where("value IS NOT NULL")
    cell = lambda x: (x * 100).cast("string")
    bad = F.when(F.month("date") == 6, F.lit("n/a")).otherwise(cell(F.col("value") / 2))
    line = F.concat_ws(",", F.date_format("date", "yyyyMM"), cell(F.col("value")), bad, F.lit("0.1"))
    path = files.scratch(spark, "factors-csv")
    text = spark.createDataFrame([("Monthly factors in percent",), (",mkt,half,RF",)], "value string")
    yearly = market.groupBy(F.year("date").alias("y")).agg(F.concat_ws(",", F.first(F.year("date")).cast("string"), cell(F.sum("value"))).alias("value")).select("value")
    text.unionByName(market.select(line.alias("value"))).unionByName(yearly).write.text(path)
    return rounded(files.read_factor_csv(spark, path, ["mkt", "half", "RF"]))


@register("strategies_parquet", f"""WITH {ONE}, {sql.ls(5)} SELECT date, 'disc_5' AS spec, 'ew' AS weighting, {sql.r('ew', 'value')} FROM ls
    UNION ALL SELECT date, 'disc_5', 'vw', {sql.r('vw', 'value')} FROM ls""")
def strategies_parquet(spark, sf_dir):
    """Long-short series written in long form, one folder for each weighting, and read back."""
    series = strategy(spark, sf_dir, SortSpec("disc", 5)).get_long_short()
    both = F.explode(F.array(*[F.struct(F.lit(w).alias("weighting"), F.col(w).alias("value")) for w in ("ew", "vw")]))
    path = files.scratch(spark, "strategies")
    files.write_strategies(series.select("date", F.lit("disc_5").alias("spec"), both.alias("_x")).select("date", "spec", "_x.*"), path)
    return rounded(spark.read.parquet(path).select("date", "spec", "weighting", "value"))


@register("strategies_replaced", f"""WITH a AS (WITH {ONE}, {sql.ls(5)} SELECT * FROM ls), b AS (WITH {sql.sort("supplier", "qty", 5)}, {sql.ls(5)} SELECT * FROM ls),
    s AS (SELECT date, '{SortSpec("disc", 5).name}' AS spec, ew, vw FROM a UNION ALL SELECT date, '{SortSpec("qty", 5).name}', ew, vw FROM b)
    SELECT date, spec, 'ew' AS weighting, {sql.r('ew', 'value')} FROM s UNION ALL SELECT date, spec, 'vw', {sql.r('vw', 'value')} FROM s""")
def strategies_replaced(spark, sf_dir):
    """Two strategies written one after the other, and the first of them again: both are there, once."""
    path, specs = files.scratch(spark, "strategies"), (SortSpec("disc", 5), SortSpec("qty", 5))
    both = F.explode(F.array(*[F.struct(F.lit(w).alias("weighting"), F.col(w).alias("value")) for w in ("ew", "vw")]))
    for spec in (*specs, specs[0]):
        series = strategy(spark, sf_dir, spec).get_long_short()
        files.write_strategies(series.select("date", F.lit(spec.name).alias("spec"), both.alias("_x")).select("date", "spec", "_x.*"), path)
    return rounded(files.read_strategies(spark, path))


def _by_month(panel: DataFrame, last: int) -> tuple[DataFrame, list]:
    """The panel written, without its last dates to begin with, and those dates (a few, of one row a date)."""
    panel = files.written(panel, "panel")
    dates = [r[0] for r in panel.groupBy("date").agg(F.lit(1)).orderBy(F.desc("date")).limit(last).select("date").collect()]
    return panel, sorted(dates)


@register("panel_store", sql.long_short(sql.sort("supplier", "signal", 5, 3, prep=sql.momentum(3, 1)), 5))
def panel_store(spark, sf_dir):
    """The momentum sort over a stored panel to which months were added one by one, the last of them twice."""
    panel, months = _by_month(demo_panel.load(spark, sf_dir), 3)
    kept = store.PanelStore.create(panel.where(F.col("date") < months[0]), files.scratch(spark, "panel-store"), buckets=16)
    for month in (*months, months[-1]):
        kept.append(panel.where(F.col("date") == month))
    return rounded(Strategy(kept.panel, SortSpec(Momentum(3, 1), 5, 3)).long_short)


@register("percentiles_appended", f"""WITH {demo_panel.sql("part")}, ds AS (SELECT DISTINCT date FROM panel)
    SELECT ds.date, {sql.r('quantile_cont(p.ret, 0.01)', 'lo')}, {sql.r('quantile_cont(p.ret, 0.99)', 'hi')}
    FROM ds JOIN panel p ON p.date < ds.date AND p.ret IS NOT NULL GROUP BY ds.date""")
def percentiles_appended(spark, sf_dir):
    """Percentiles of all earlier returns from a state to which months were added one by one."""
    panel, months = _by_month(demo_panel.load(spark, sf_dir, "part"), 3)
    state = store.QuantileState.create(panel.where(F.col("date") < months[0]), files.scratch(spark, "quantiles"))
    for month in (*months, months[0]):
        state.append(panel.where(F.col("date") == month))
    return rounded(state.percentiles({"lo": 0.01, "hi": 0.99}))


@register("wins_from_state", sql.long_short(sql.sort("supplier", "signal", 5, f=sql.filtered("wins", 95, "both")[0], prep=sql.momentum(3, 1, "ret_adj"), ep=True), 5))
def wins_from_state(spark, sf_dir):
    """Winsorising without look-ahead, with bounds from the kept state instead of a pass over all returns."""
    panel = files.written(demo_panel.load(spark, sf_dir), "panel")
    state = store.QuantileState.create(panel, files.scratch(spark, "quantiles"))
    wins = FilterSpec("wins", 95, "both", thresholds=files.written(state.thresholds([5, 95]), "thresholds"))
    return rounded(Strategy(panel, SortSpec(Momentum(3, 1), 5, filter=wins)).long_short)


@register("mean_turnover", f"""WITH {sql.sort("supplier", "disc", 5, 2, dynamic=True)}, {sql.turnover(2)}
    SELECT CAST(ptf AS INTEGER) AS ptf, regime, 'ew' AS weighting, {sql.r('avg(ew) * 100', 'turnover')} FROM turn GROUP BY ALL
    UNION ALL SELECT CAST(ptf AS INTEGER), regime, 'vw', {sql.r('avg(vw) * 100', 'turnover')} FROM turn GROUP BY ALL""")
def mean_turnover(spark, sf_dir):
    return rounded(summary.mean_turnover(strategy(spark, sf_dir, SortSpec("disc", 5, 2, dynamic_weights=True, turnover=True))))


@register("mean_turnover_but_last", f"""WITH {sql.sort("supplier", "disc", 5, 2)}, {sql.turnover(2)},
    u AS (SELECT * FROM turn WHERE date < (SELECT max(date) FROM cal))
    SELECT CAST(ptf AS INTEGER) AS ptf, regime, 'ew' AS weighting, {sql.r('avg(ew) * 100', 'turnover')} FROM u GROUP BY ALL
    UNION ALL SELECT CAST(ptf AS INTEGER), regime, 'vw', {sql.r('avg(vw) * 100', 'turnover')} FROM u GROUP BY ALL""")
def mean_turnover_but_last(spark, sf_dir):
    return rounded(summary.mean_turnover(strategy(spark, sf_dir, SortSpec("disc", 5, 2, turnover=True)), last=False))


@register("common_sample", f"""WITH {demo_panel.sql()}, w AS (SELECT min(CAST(o_orderdate AS DATE)) AS a, max(CAST(o_orderdate AS DATE)) AS b FROM orders)
    SELECT date, {sql.r('avg(ret)', 'value')} FROM panel, w WHERE date BETWEEN a AND b GROUP BY date""")
def common_sample(spark, sf_dir):
    """The market over the months that orders span: shipments go on after the last order."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.to_date("o_orderdate").alias("date"))
    return rounded(factors.common_sample(factors.market_ew(demo_panel.load(spark, sf_dir)), orders))


@register("vendor_panel", f"""WITH {demo_panel.sql()} SELECT "ID" AS "ISSUE_ID", date AS "DATE", {sql.r('"PRICE" * qty / 1000', 'VW')}
    FROM panel WHERE date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'""")
def vendor_panel(spark, sf_dir):
    raw = demo_panel.load(spark, sf_dir).select(
        F.col("ID").alias("issue_id"), F.col("date").alias("date"), (-F.col("qty")).alias("amount_outstanding"), (-F.col("PRICE")).alias("price_l5m")
    )
    return rounded(panels.vendor_panel(raw, "1996-01-01", "2000-12-31").select("ISSUE_ID", "DATE", "VW"))


def _past_return(panel: DataFrame, ret: str, name: str) -> DataFrame:
    """A signal of the user's own: the last row's return with its sign turned."""
    return panel.withColumn(name, -F.lag(ret).over(Window.partitionBy("ID").orderBy("date")))


@register("custom_signal_sort", sql.long_short(sql.sort("supplier", "signal", 5, 2, prep='prep AS (SELECT *, -lag(ret) OVER (PARTITION BY "ID" ORDER BY date) AS signal FROM f)'), 5))
def custom_signal_sort(spark, sf_dir):
    return rounded(strategy(spark, sf_dir, SortSpec(_past_return, 5, 2)).long_short)


@register("factors_joined", f"""WITH a AS (WITH {demo_panel.sql()}, {_MVW} SELECT date, value FROM mv),
    b AS (WITH {demo_panel.sql("part")} SELECT date, avg(ret) AS value FROM panel GROUP BY date)
    SELECT date, {sql.r('a.value', 'mkt')}, {sql.r('b.value', 'parts')} FROM a JOIN b USING (date) WHERE a.value IS NOT NULL AND b.value IS NOT NULL""")
def factors_joined(spark, sf_dir):
    market = factors.market_vw(demo_panel.load(spark, sf_dir))
    return rounded(factors.joined({"mkt": market, "parts": factors.market_ew(demo_panel.load(spark, sf_dir, "part"))}))


@register("unique_ids", f"""WITH {demo_panel.sql("part")} SELECT "ID", count(*) AS n FROM panel WHERE "RATING_NUM" > 10 GROUP BY "ID" """)
def unique_ids(spark, sf_dir):
    """Assets that were ever rated below investment grade, after a check that (ID, date) is a key."""
    panel = panels.require_unique(demo_panel.load(spark, sf_dir, "part"))
    return panel.where(F.col("RATING_NUM") > 10).groupBy("ID").agg(F.count(F.lit(1)).alias("n"))
