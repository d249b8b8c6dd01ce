"""Small hand-made panels with known answers."""

import datetime
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioframe.functions.tails import normal_two_sided, t_two_sided
from folioframe.jobs.grids import momentum_grid, rating_grid
from folioframe.operators import blocks, grid, inference, summary
from folioframe.operators.banding import _closed, _folded
from folioframe.operators.filters import add_filtered, in_universe, passes, truths
from folioframe.operators.quantiles import counted_edges, expanding_percentiles, full_percentiles, inner_edges
from folioframe.operators.grid import long_short_grid
from folioframe.operators.signals import add_momentum, add_wealth
from folioframe.operators.strategy import Strategy
from folioframe.sources import files, panel as panels, store
from folioframe.spec import FilterSpec, Momentum, Reversal, SortSpec

DAY = [datetime.date(2020, m, 1) for m in range(1, 13)]


def make(spark, rows):
    return spark.createDataFrame(rows, "ID long, date date, ret double, RATING_NUM double, VW double, x double")


def test_ties_leave_a_bin_empty(spark):
    rows = [(i, DAY[t], 0.1 * i, 5.0, 1.0, 1.0 if i < 4 else 2.0) for i in range(1, 6) for t in range(2)]
    out = {r.ptf: r for r in Strategy(make(spark, rows), SortSpec("x", 3)).returns.collect()}
    assert sorted(out) == [1, 2] or sorted(out) == [1, 3]
    assert out[1].ew == pytest.approx(0.2)


def test_absent_later_and_null_weights(spark):
    rows = [(1, DAY[0], 0.0, 5.0, 1.0, 1.0), (2, DAY[0], 0.0, 5.0, None, 2.0), (3, DAY[0], 0.0, 5.0, 3.0, 3.0), (4, DAY[0], 0.0, 5.0, 1.0, 4.0)]
    rows += [(1, DAY[1], 0.1, 5.0, 1.0, 1.0), (2, DAY[1], 0.2, 5.0, 1.0, 2.0), (3, DAY[1], 0.3, 5.0, 1.0, 3.0)]
    static = {r.ptf: r for r in Strategy(make(spark, rows), SortSpec("x", 2)).returns.collect()}
    assert (static[1].ew, static[1].vw) == (pytest.approx(0.15), pytest.approx(0.1))
    assert (static[2].ew, static[2].vw) == (pytest.approx(0.3), pytest.approx(0.3))
    dynamic = {r.ptf: r for r in Strategy(make(spark, rows), SortSpec("x", 2, dynamic_weights=True)).returns.collect()}
    assert dynamic[1].ew == pytest.approx(0.1)


def test_all_weights_null_gives_zero(spark):
    rows = [(i, DAY[t], 0.5, 5.0, None, float(i)) for i in (1, 2) for t in (0, 1)]
    assert {r.vw for r in Strategy(make(spark, rows), SortSpec("x", 2)).returns.collect()} == {0.0}


def test_overlapping_cohorts_have_values_only_inside(spark):
    rows = [(i, DAY[t], 0.01 * i * t, 5.0, 1.0, float(i)) for i in range(1, 5) for t in range(8)]
    out = Strategy(make(spark, rows), SortSpec("x", 2, 3)).get_long_short().where("ew IS NOT NULL").collect()
    assert sorted(r.date for r in out) == DAY[3:6]


def test_full_exclusion_and_equal_regimes(spark):
    rows = [(i, DAY[t], 0.1 * i, 5.0, 1.0, float(i)) for i in range(1, 5) for t in range(4)]
    none = Strategy(make(spark, rows), SortSpec("x", 2, filter=FilterSpec("trim", -9.0)))
    both = {}
    for r in none.long_short.collect():
        both.setdefault(r.date, set()).add((r.ew, r.vw))
    assert both and all(len(v) == 1 for v in both.values())
    empty = Strategy(make(spark, rows), SortSpec("x", 2, filter=FilterSpec("trim", 0.01)))
    assert empty.long_short.count() == 0


def test_turnover_of_fixed_equal_returns_is_only_entry(spark):
    rows = [(i, DAY[t], 0.1, 5.0, 1.0, float(i)) for i in range(1, 5) for t in range(4)]
    out = Strategy(make(spark, rows), SortSpec("x", 2)).get_ptf_turnover().collect()
    by_date = {}
    for r in out:
        by_date.setdefault(r.date, []).append(r.ew)
    assert by_date[DAY[3]] == [pytest.approx(1.0)] * 2
    assert all(x is None or x < 1e-9 for d, v in by_date.items() if d != DAY[3] for x in v)


def test_weights_sum_to_one(spark):
    rows = [(i, DAY[t], 0.1 * ((i * t) % 3), 5.0, float(i), float((i * 7 + t) % 5)) for i in range(1, 9) for t in range(5)]
    sums = Strategy(make(spark, rows), SortSpec("x", 3, 2)).weights.groupBy("s", "cohort", "ptf").agg(F.sum("ew").alias("e"), F.sum("vw").alias("v"))
    assert all(r.e == pytest.approx(1) and r.v == pytest.approx(1) for r in sums.collect())


def test_banding_closed_form_is_the_fold(spark):
    rng = random.Random(3)
    rows = [(c, i, s, rng.randint(1, 5)) for c in range(2) for i in range(12) for s in range(15) if rng.random() < 0.85]
    df = spark.createDataFrame(rows, "cohort int, ID long, step int, ptf int")
    for width in (0, 1, 2, 3):
        a = sorted(tuple(r) for r in _closed(df, 5, width).select("cohort", "ID", "step", "ptf").collect())
        b = sorted(tuple(r) for r in _folded(df, 5, width).select("cohort", "ID", "step", "ptf").collect())
        assert a == b


def test_expanding_percentiles_match_numpy(spark):
    rng = np.random.default_rng(5)
    rows = [(i, DAY[t], float(np.round(rng.standard_t(3), 2)), 5.0, 1.0, 0.0) for i in range(40) for t in range(6)]
    got = {r.date: (r.a, r.b) for r in expanding_percentiles(make(spark, rows), "ret", {"a": 0.03, "b": 0.9}).collect()}
    assert set(got) == set(DAY[1:6])
    for t in range(1, 6):
        pool = [r[2] for r in rows if r[1] < DAY[t]]
        assert got[DAY[t]] == pytest.approx(tuple(np.percentile(pool, [3, 90])))


def test_counted_breakpoints_are_those_of_the_aggregate(spark):
    rng = np.random.default_rng(8)
    rows = [(i, DAY[i % 3], 0.0, 5.0, 1.0, float(np.round(rng.normal(), 1))) for i in range(700)] + [(i, DAY[5], 0.0, 5.0, 1.0, 1.0) for i in range(9)]
    df = make(spark, rows)
    for n in (2, 5, 10):
        want = {r.date: r.e for r in df.groupBy("date").agg(inner_edges("x", n).alias("e")).collect()}
        got = {r.date: r._edges for r in counted_edges(df, ["date"], "x", n).collect()}
        assert set(got) == set(want) and all(got[d] == pytest.approx(want[d], abs=1e-12) for d in want)


def test_price_threshold_is_inclusive_in_the_filter(spark):
    df = make(spark, [(1, DAY[0], 0.1, 5.0, 1.0, 0.0), (2, DAY[0], 0.1, 5.0, 1.0, 0.0)]).withColumn("PRICE", F.col("ID") * 20.0)
    out = add_filtered(df, FilterSpec("price", 25.0))
    assert {r.ID: r.ret_adj for r in out.collect()} == {1: 0.1, 2: None}


def test_momentum_needs_full_windows_and_wealth_skips_nulls(spark):
    rows = [(1, DAY[t], r, 5.0, 1.0, 0.0) for t, r in enumerate([0.1, None, 0.2, 0.1, 0.3])]
    out = [r.signal for r in add_momentum(make(spark, rows), 2, 1).orderBy("date").collect()]
    assert out[:4] == [None] * 4 and out[4] == pytest.approx(1.2 * 1.1 - 1)
    series = make(spark, rows).select("date", F.col("ret").alias("value"))
    wealth = [r.wealth for r in add_wealth(series).orderBy("date").collect()]
    assert wealth[1] is None and wealth[4] == pytest.approx(1.1 * 1.2 * 1.1 * 1.3)


def test_canonical_panel(spark):
    raw = spark.createDataFrame([("a", "2020-01-31", float("nan"), 3.0, 7.0)], "cusip string, day string, r double, rating double, ret double")
    out = panels.canonical(raw, {"cusip": "ID", "day": "date", "r": "ret", "rating": "RATING_NUM"})
    row = out.first()
    assert (row.ID, row.date, row.ret, row.VW) == ("a", datetime.date(2020, 1, 31), None, 1.0)
    with pytest.raises(ValueError, match="RATING_NUM"):
        panels.canonical(raw, {"cusip": "ID", "day": "date"})
    with pytest.raises(ValueError):
        panels.require_unique(out.union(out))


def test_specs_are_checked():
    for bad in (lambda: FilterSpec("wins", 95), lambda: FilterSpec("x", 1), lambda: FilterSpec("trim", (2, 1)), lambda: SortSpec("x", 1), lambda: SortSpec("x", 3, signal2="y")):
        with pytest.raises(ValueError):
            bad()
    assert SortSpec("x", 5, 2, rating="IG", filter=FilterSpec("wins", 98, "both")).name == "IG_x_2_n5_wins_98_both"
    apart = [SortSpec("disc", 5), SortSpec("disc", 10), SortSpec("disc", 5, dynamic_weights=True), SortSpec("disc", 5, vw_drift="vw"), SortSpec("disc", 5, signal2="x", nport2=3),
             SortSpec("disc", 5, signal2="x", nport2=4), *[SortSpec("disc", 5, filter=FilterSpec("price", 30, price_threshold=t)) for t in (25, 40)]]
    assert len({s.name for s in apart}) == len(apart)


#: Twelve returns and a factor, with figures worked out apart by sums over dates.
Y = [0.02, -0.01, 0.03, 0.01, -0.02, 0.04, 0.00, 0.01, 0.02, -0.03, 0.05, 0.01]
X = [0.01, -0.02, 0.02, 0.02, -0.01, 0.03, -0.01, 0.00, 0.01, -0.02, 0.03, 0.00]


def by_hand(y, x, lag):
    """Alpha and its Newey-West error with one factor: slope from covariances, influence of each date, weighted lags."""
    n, mx, my = len(y), sum(x) / len(y), sum(y) / len(y)
    sxx = sum((a - mx) ** 2 for a in x)
    slope = sum((a - mx) * (b - my) for a, b in zip(x, y)) / sxx
    u = [(b - my - slope * (a - mx)) * (1 / n - mx * (a - mx) / sxx) for a, b in zip(x, y)]
    var = sum(v * v for v in u) + sum(2 * (1 - k / (lag + 1)) * sum(p * q for p, q in zip(u[k:], u)) for k in range(1, lag + 1))
    return my - slope * mx, math.sqrt(var)


def test_hac_mean_of_known_figures(spark):
    series = spark.createDataFrame([("s", DAY[i], v) for i, v in enumerate(Y)] + [("s", datetime.date(2021, 1, 1), None)], "series string, date date, value double")
    got = inference.hac_mean(series, ["series"], 0).first()
    assert (got.n, got.mean, got.se) == (12, pytest.approx(0.13 / 12), pytest.approx(math.sqrt(0.0075 - 0.13**2 / 12) / 12))
    e = [v - 0.13 / 12 for v in Y]
    spread = sum(v * v for v in e) + 2 * (2 / 3 * sum(a * b for a, b in zip(e[1:], e)) + 1 / 3 * sum(a * b for a, b in zip(e[2:], e)))
    assert inference.hac_mean(series, ["series"], 2).first().se == pytest.approx(math.sqrt(spread) / 12)


def test_alphas_take_out_the_factor(spark):
    rows = [("s", DAY[i], Y[i]) for i in range(12)] + [("short", DAY[0], 1.0)]
    series = spark.createDataFrame(rows, "series string, date date, value double")
    known = spark.createDataFrame([(DAY[i], X[i] if i != 3 else None) for i in range(12)], "date date, f double")
    for lag in (0, 1):
        out = {r.series: r for r in inference.hac_alpha(series, known, ["f"], ["series"], lag).collect()}
        alpha, se = by_hand(Y[:3] + Y[4:], X[:3] + X[4:], lag)
        assert (out["s"].alpha, out["s"].alpha_t) == (pytest.approx(alpha), pytest.approx(alpha / se))
        assert (out["s"].n, out["s"].mean) == (12, pytest.approx(0.13 / 12))  # the mean takes the date without a factor, too
        assert out["s"].alpha_p == pytest.approx(math.erfc(alpha / se / math.sqrt(2)))
    assert out["short"].alpha is None and out["short"].n == 1


def test_alphas_of_a_strategy(spark):
    rows = [(i, DAY[t], 0.01 * i * ((t * 7 + i) % 5 - 1), 5.0, 1.0, float(i)) for i in range(1, 7) for t in range(10)]
    s = Strategy(make(spark, rows), SortSpec("x", 2, filter=FilterSpec("trim", 0.12)))
    out = s.get_alphas(spark.createDataFrame([(DAY[i], X[i]) for i in range(12)], "date date, f double"), ["f"], 1).collect()
    assert {(r.regime, r.weighting) for r in out} == {(a, b) for a in ("ea", "ep") for b in ("ew", "vw")}
    series = {r.date: r.ew for r in s.get_long_short().collect() if r.ew is not None}
    alpha, _ = by_hand([series[d] for d in sorted(series)], [X[DAY.index(d)] for d in sorted(series)], 1)
    assert next(r.alpha for r in out if (r.regime, r.weighting) == ("ea", "ew")) == pytest.approx(alpha)


def test_a_value_that_half_of_the_rows_share(spark):
    rng = np.random.default_rng(12)
    rows = [(i, DAY[t], 0.0 if (i + t) % 2 else float(np.round(rng.normal(), 3)), 5.0, 1.0, 0.0) for i in range(200) for t in range(5)]
    df = make(spark, rows)
    levels = {"a": 0.02, "b": 0.5, "c": 0.98}
    pool = [r[2] for r in rows]
    assert full_percentiles(df, "ret", levels) == pytest.approx(dict(zip(levels, np.percentile(pool, [2, 50, 98]))))
    got = {r.date: (r.a, r.b, r.c) for r in expanding_percentiles(df, "ret", levels).collect()}
    for t in range(1, 5):
        assert got[DAY[t]] == pytest.approx(tuple(np.percentile([r[2] for r in rows if r[1] < DAY[t]], [2, 50, 98])))
    assert full_percentiles(df.limit(0), "ret", levels) == dict.fromkeys(levels)


def test_study_grids():
    for specs, n in ((momentum_grid(), 240), (rating_grid(), 120)):
        assert len(specs) == len({s.name for s in specs}) == n
    kinds = [s.filter.adj for s in momentum_grid()]
    assert {k: kinds.count(k) for k in kinds} == {"trim": 96, "price": 60, "bounce": 60, "wins": 24}


def test_a_grid_is_its_strategies_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(grid, "CHUNK", 2)
    rng = np.random.default_rng(3)
    rows = [(i, DAY[t], float(np.round(rng.normal() / 5, 3)), float(1 + (i * 3 + t) % 22), float(1 + i % 4), float(rng.integers(0, 9))) for i in range(40) for t in range(9)]
    panel = make(spark, rows).withColumn("PRICE", F.col("x") * 30)
    specs = [
        SortSpec("x", 3), SortSpec("x", 3, 2, rating="IG", filter=FilterSpec("wins", 90, "both")), SortSpec(Momentum(2, 1), 2, filter=FilterSpec("bounce", 0.05)),
        SortSpec(Reversal(3, 1), 2, 2, dynamic_weights=True, filter=FilterSpec("trim", (-0.3, 0.3))), SortSpec("x", 3, banding=1), SortSpec("x", 2, signal2="RATING_NUM", nport2=2),
        SortSpec("x", 3, 2, banding=1, filter=FilterSpec("trim", 0.3)), SortSpec("x", 3, 2, banding=1, filter=FilterSpec("price", 150)), SortSpec("x", 2, banding=1),
        SortSpec("x", 2, 2, "RATING_NUM", 3, "conditional", filter=FilterSpec("trim", 0.3)), SortSpec("RATING_NUM", 2, 2, "x", 3, "conditional"),
        SortSpec("x", 2, signal2="VW", nport2=2, banding=1), SortSpec("RATING_NUM", 2, signal2="x", nport2=2), SortSpec("x", 4),
        SortSpec("x", 3, filter=FilterSpec("price", 150)), SortSpec("x", 3, filter=FilterSpec("bounce", -0.02)), SortSpec("x", 3, filter=FilterSpec("wins", 95, "right")),
    ]
    got = {}
    for r in long_short_grid(panel, specs).collect():
        got.setdefault(r.spec, {})[r.date, r.regime] = (r.ew, r.vw)
    near = lambda x: tuple(None if v is None else pytest.approx(v, abs=1e-12) for v in x)
    for s in specs:
        want = {(r.date, r.regime): (r.ew, r.vw) for r in Strategy(panel, s).long_short.collect()}
        assert want and got[s.name].keys() == want.keys() and all(got[s.name][k] == near(v) for k, v in want.items()), s.name
    with pytest.raises(ValueError, match="same name"):
        long_short_grid(panel, specs[:1] * 2)


def test_panel_from_a_database(spark):
    """Spark's own embedded database, read in ranges of a column."""
    url = "jdbc:derby:memory:panel;create=true"
    rows = [(i, DAY[t], 0.1 * t, 5.0, 1.0, float(i)) for i in range(6) for t in range(3)]
    make(spark, rows).write.format("jdbc").options(url=url, dbtable="bonds").save()
    query = 'SELECT "ID", "date", "ret", "RATING_NUM", "VW", "x" FROM bonds WHERE "x" > 1'
    got = files.read_panel_jdbc(spark, url, query, "ID", ("0", "6"), 3)
    assert got.rdd.getNumPartitions() == 3
    assert sorted(tuple(r) for r in panels.canonical(got, keep=["x"]).collect()) == [r for r in rows if r[0] > 1]


def test_scratch_needs_a_shared_folder_on_a_cluster():
    class Conf:
        get = staticmethod(lambda name, default: default)

    for master, ok in (("local[4]", True), ("local", True), ("local-cluster[2,1,1024]", False), ("spark://host:7077", False)):
        session = type("Session", (), {"conf": Conf, "sparkContext": type("Context", (), {"master": master})})
        if ok:
            assert "/folioframe/x-" in files.scratch(session, "x")
        else:
            with pytest.raises(ValueError, match="checkpoint"):
                files.scratch(session, "x")


def test_summary_has_p_values_and_characteristics(spark):
    rows = [(i, DAY[t], 0.01 * i * ((t * 3 + i) % 4 - 1), 5.0, 1.0, float(i)) for i in range(1, 7) for t in range(10)]
    spec = SortSpec("x", 2, filter=FilterSpec("trim", 0.12), chars=("x",), turnover=True)
    out = {(r.series, r.regime, r.weighting): r for r in summary.summary(Strategy(make(spark, rows), spec)).collect()}
    assert {k[1] for k in out} == {"ea", "ep"} and {k[0] for k in out} == {"long_short", "long", "short", "ptf_1", "ptf_2"}
    row = out["ptf_2", "ea", "ew"]
    assert row.char_x == pytest.approx(5.0) and row.turnover is not None
    assert row.p == pytest.approx(math.erfc(abs(row.t) / math.sqrt(2)))
    assert out["long_short", "ea", "ew"].char_x is None


def test_tails():
    assert normal_two_sided(1.959963985) == pytest.approx(0.05, abs=1e-9)
    assert t_two_sided(2.228138852, 10) == pytest.approx(0.05, abs=1e-8)
    assert t_two_sided(0.0, 5) == pytest.approx(1)
    assert math.isnan(t_two_sided(1.0, 0))


def test_factor_and_percentile_files(spark, tmp_path):
    (tmp_path / "f.csv").write_text("A library\n\n,MKT,SMB,RF\n202001, 1.50,-0.25,0.1\n202002, bad,0.5,0.1\nAnnual\n2020,3,4,1\n")
    rows = files.read_factor_csv(spark, str(tmp_path / "f.csv"), ["MKT", "SMB", "RF"]).orderBy("date").collect()
    assert [tuple(r) for r in rows] == [(datetime.date(2020, 1, 31), 0.015, -0.0025), (datetime.date(2020, 2, 29), None, 0.005)]
    (tmp_path / "p.csv").write_text("d,2,98\n2020-01-31,-0.1,0.2\n")
    levels = files.read_percentiles(spark, str(tmp_path / "p.csv"), ["2", "98"]).orderBy("level").collect()
    assert [tuple(r) for r in levels] == [(datetime.date(2020, 1, 31), 2.0, -0.1), (datetime.date(2020, 1, 31), 98.0, 0.2)]
    (tmp_path / "g.csv").write_text("date,mkt,smb\n2020-01-31,0.1,\n2020-02-29,0.2,0.3\n")
    rows = files.read_factors(spark, str(tmp_path / "g.csv"), ["mkt", "smb"]).orderBy("date").collect()
    assert [tuple(r) for r in rows] == [(datetime.date(2020, 1, 31), 0.1, None), (datetime.date(2020, 2, 29), 0.2, 0.3)]
    series = spark.createDataFrame([(DAY[0], "a.1", 1.0), (DAY[0], "b", 2.0), (DAY[1], "b", 3.0)], "date date, spec string, value double")
    assert [tuple(r) for r in files.wide(series, ["a.1", "b"]).orderBy("date").collect()] == [(DAY[0], 1.0, 2.0), (DAY[1], None, 3.0)]
    long = spark.createDataFrame([(DAY[0], "a", "ew", 1.0), (DAY[0], "a", "vw", 2.0)], "date date, spec string, weighting string, value double")
    files.write_strategies(long, str(tmp_path / "out"))
    files.write_strategies(long.withColumns({"spec": F.lit("7"), "value": F.lit(5.0)}), str(tmp_path / "out"))
    files.write_strategies(long.where("weighting = 'vw'").withColumn("value", F.lit(9.0)), str(tmp_path / "out"))
    got = sorted((r.spec, r.weighting, r.value) for r in files.read_strategies(spark, str(tmp_path / "out")).collect())
    assert got == [("7", "ew", 5.0), ("7", "vw", 5.0), ("a", "ew", 1.0), ("a", "vw", 9.0)]


def random_panel(spark, ids=30, dates=9, seed=5):
    rng = np.random.default_rng(seed)
    rows = [(i, DAY[t], float(np.round(rng.normal() / 5, 3)) if rng.random() < 0.9 else None, float(1 + (i * 3 + t) % 22), float(1 + i % 4), float(rng.integers(0, 9)))
            for i in range(ids) for t in range(dates) if rng.random() < 0.85]
    return make(spark, rows)


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.split("\n") if "Exchange hashpartitioning(ID" in line]


def test_windows_over_a_stored_panel_need_no_exchange(spark, tmp_path):
    panel = random_panel(spark)
    kept = store.PanelStore.create(panel.where(F.col("date") < DAY[6]), str(tmp_path / "s"), 4)
    files_before = {p: p.stat().st_mtime_ns for p in (tmp_path / "s").rglob("*.parquet")}
    for t in (6, 7, 8, 7):
        kept.append(panel.where(F.col("date") == DAY[t]))
    assert all(p.stat().st_mtime_ns == at for p, at in files_before.items())  # earlier months were left alone
    rows = lambda df: sorted(map(tuple, df.select(panel.columns).collect()), key=str)
    assert rows(kept.panel) == rows(panel) and kept.dates() == DAY[:9]
    again = store.PanelStore(spark, str(tmp_path / "s"), kept.schema, 4)
    assert rows(again.panel) == rows(panel)
    for spec in (SortSpec(Momentum(2, 1), 3, 2), SortSpec("x", 2, 2, turnover=True, filter=FilterSpec("bounce", 0.05))):
        stored, plain = Strategy(again.panel, spec), Strategy(panel, spec)
        assert not exchanges(stored.long_short) and exchanges(plain.long_short)
        assert not exchanges(stored.turnover)
        near = lambda df: {tuple(r)[:3]: pytest.approx(tuple(r)[3:], nan_ok=True) for r in df.select("date", "regime", "ptf", F.coalesce("ew", F.lit(-9.0)), F.coalesce("vw", F.lit(-9.0))).collect()}
        assert near(stored.turnover) == {k: v.expected for k, v in near(plain.turnover).items()}
    kept.close()
    again.close()


def signed_turnover(weights, K):
    """Sums over IDs of abs(weight - drifted weight before), from all weights at once."""
    signed, nulls = {}, set()
    for r in weights:
        for s, ew, vw, sign in ((r.s, r.ew, r.vw, 1), (r.s + 1, r.ew_drift, r.vw_drift, -1)):
            if s >= 1:
                old = signed.setdefault((r.regime, s, r.cohort, r.ptf), {}).setdefault(r.ID, [0.0, 0.0])
                for i, v in enumerate((ew, vw)):
                    old[i] = None if v is None or old[i] is None else old[i] + sign * v
    out = {}
    for (regime, s, _, ptf), ids in signed.items():
        for i in (0, 1):
            total = None if any(v[i] is None for v in ids.values()) else sum(abs(v[i]) for v in ids.values()) or None
            out.setdefault((regime, s, ptf), ([], []))[i].append(total)
    return {k: tuple(None if len(v) < K or None in v else sum(v) / K for v in both) for k, both in out.items()}


@pytest.mark.parametrize("K", [1, 3])
def test_turnover_is_that_of_signed_weights(spark, K):
    panel = random_panel(spark, seed=K).withColumn("VW", F.when(F.col("ID") % 7 != 3, F.col("VW")))
    s = Strategy(panel, SortSpec("x", 3, K, filter=FilterSpec("trim", 0.3)))
    t = {d: i for i, (d, _) in enumerate(s._dates)}
    got = {(r.regime, t[r.date], r.ptf): (r.ew, r.vw) for r in s.turnover.collect()}
    want = signed_turnover(s.weights.collect(), K)
    near = lambda x: tuple(None if v is None else pytest.approx(v, abs=1e-9) for v in x)
    assert {k for k in want if k in got} == {*got} and all(got[k] == near(want[k]) for k in got)


def test_percentiles_of_a_kept_state(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(DAY[t], float(np.round(rng.normal() * (1 + t), 1)) if rng.random() < 0.95 else None) for t in range(8) for _ in range(150)]
    df = spark.createDataFrame(rows, "date date, ret double")
    levels = {"a": 0.02, "b": 0.5, "c": 0.98}
    state = store.QuantileState.create(df.where(F.col("date") < DAY[3]), str(tmp_path / "q"))
    for t in (3, 4, 5, 6, 4):
        state.append(df.where(F.col("date") == DAY[t]))
    pool = lambda d: np.percentile([x for day, x in rows if day < d and x is not None], [2, 50, 98])
    got = {r.date: (r.a, r.b, r.c) for r in state.percentiles(levels).collect()}
    assert got == {DAY[t]: pytest.approx(tuple(pool(DAY[t]))) for t in range(1, 7)}
    # a date that is not in the state yet
    got = state.percentiles(levels, [DAY[7], DAY[0]])
    assert [tuple(r) for r in got.collect()] == [(DAY[7], *map(pytest.approx, pool(DAY[7])))]
    assert {(r.date, r.level): r.value for r in state.thresholds([2, 98], [DAY[5]]).collect()} == {(DAY[5], q): pytest.approx(np.percentile([x for d, x in rows if d < DAY[5] and x is not None], q)) for q in (2, 98)}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "In(range" in plan  # of the values only the ranges hit are read
    none = store.QuantileState.create(df.limit(0), str(tmp_path / "n"))
    assert none.percentiles(levels).count() == 0
    none.append(df.where(F.col("date") == DAY[0]))  # without marks all values are in one range
    assert none.percentiles(levels, [DAY[1]]).first().b == pytest.approx(pool(DAY[1])[1])


def test_valid_rows_of_a_hot_key(spark):
    """Half of all facts on one key, nulls, and first and last days."""
    day = lambda n: datetime.date(2000, 1, 1) + datetime.timedelta(n)
    rng = random.Random(7)
    facts = [(0 if i % 2 else rng.randrange(5), day(rng.randrange(4000)), i) for i in range(2000)] + [(1, None, -1), (None, day(5), -2)]
    history = [(0, day(40 * i), day(40 * i + 38), f"a{i}") for i in range(100)] + [(k, day(700 * k), None if k % 2 else day(9000), f"b{k}") for k in range(1, 5)] + [(2, None, day(100), "c"), (3, day(50), day(40), "d"), (None, day(0), day(9), "e")]
    got = panels.valid_rows(
        spark.createDataFrame(facts, "k long, on date, n long"), spark.createDataFrame(history, "k long, a date, b date, name string"), "k", "on", "a", "b", period=100
    )
    assert got.columns == ["k", "on", "n", "a", "b", "name"]
    want = sorted((n, name) for k, on, n in facts for key, a, b, name in history if k is not None and on and k == key and a and b and a <= on <= b)
    assert sorted((r.n, r.name) for r in got.collect()) == want and want
    assert panels.valid_rows(got.select("k", "on", "n").limit(0), got.select("k", "a", "b"), "k", "on", "a", "b").count() == 0


def ols_hac(y, x, lag):
    inverse = np.linalg.pinv(x.T @ x)
    beta = inverse @ (x.T @ y)
    scores = x * (y - x @ beta)[:, None]
    meat = scores.T @ scores
    for k in range(1, lag + 1):
        cross = scores[k:].T @ scores[:-k]
        meat += (1 - k / (lag + 1)) * (cross + cross.T)
    return beta[0], np.sqrt((inverse @ meat @ inverse)[0, 0])


@pytest.mark.parametrize("lag", [0, 3])
def test_alphas_are_those_of_the_regression(spark, lag):
    rng = np.random.default_rng(6)
    days = [datetime.date(2000 + i // 12, 1 + i % 12, 1) for i in range(90)]
    f = rng.normal(size=(90, 3))
    factors = spark.createDataFrame([(d, *map(float, v)) for d, v in zip(days, f)], "date date, a double, b double, c double").withColumn("c", F.when(F.col("date") != days[4], F.col("c")))
    y = {s: f @ rng.normal(size=3) + rng.normal(size=90) for s in "pqr"}
    rows = [(s, d, float(v) if i % 17 else None) for s in "pq" for i, (d, v) in enumerate(zip(days, y[s]))] + [("r", d, float(v)) for d, v in list(zip(days, y["r"]))[:4]]
    got = {r.s: r for r in inference.hac_alpha(spark.createDataFrame(rows, "s string, date date, value double"), factors, ["a", "b", "c"], ["s"], lag).collect()}
    for s in "pq":
        used = [i for i in range(90) if i % 17 and i != 4]
        alpha, se = ols_hac(y[s][used], np.hstack([np.ones((len(used), 1)), f[used]]), lag)
        assert (got[s].alpha, got[s].alpha_t, got[s].alpha_p) == pytest.approx((alpha, alpha / se, normal_two_sided(alpha / se)))
        used = [i for i in range(90) if i % 17]
        mean, se = ols_hac(y[s][used], np.ones((len(used), 1)), lag)
        assert (got[s].n, got[s].mean, got[s].t) == pytest.approx((len(used), mean, mean / se))
    assert got["r"].n == 4 and got["r"].alpha is None and got["r"].mean is not None


def test_a_summary_sorts_the_panel_once(spark):
    panel = random_panel(spark).withColumn("qty", F.col("x") + 1)
    s = Strategy(panel, SortSpec("x", 3, 2, filter=FilterSpec("trim", 0.3), chars=("qty",), turnover=True))
    kept = s.stored()
    for of in (lambda s: s.long_short, lambda s: s.turnover, lambda s: s.characteristics, lambda s: s.weights):
        rows = [sorted(([round(v, 9) if isinstance(v, float) else v for v in r] for r in of(x).collect()), key=str) for x in (s, kept)]
        assert rows[0] == rows[1] and rows[0]
    plan = summary.summary(s)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("_ret1") == 0  # what a holding period needs from later dates is looked up in the stored members' plan alone


def test_ranges_are_found_by_halving(spark):
    """A value's range is the number of marks below it, for values on a mark, beyond all and repeated ones, without a lambda for each row."""
    from folioframe.operators.quantiles import in_ranges

    ends = sorted([*np.linspace(-1, 1, 1000).tolist(), *[0.5] * 23])
    xs = [-5.0, -1.0, 0.5, 0.5000001, 1.0, 7.0, *ends[::97], float("nan")]
    marks = spark.createDataFrame([(ends,)], "_m array<double>")
    got = in_ranges(spark.createDataFrame([(x,) for x in xs], "x double"), marks)
    assert [r.range for r in got.collect()] == [1023 if x != x else int(np.searchsorted(ends, x)) for x in xs]
    assert "lambda" not in got._jdf.queryExecution().executedPlan().toString()
    empty = spark.createDataFrame([(None,)], "_m array<double>")
    assert [r.range for r in in_ranges(spark.createDataFrame([(1.0,)], "x double"), empty).collect()] == [0]


def test_grid_windows_do_not_follow_the_filters(spark):
    """Exclusions share a signal's window, the bits of the rows in it, and the look-ups of later dates."""
    rows = [(i, datetime.date(2000 + m // 12, m % 12 + 1, 1), ((i * 7 + m * 5) % 23 - 11) / 20, 5.0, 1.0 + i, 50.0 + (i * m) % 60) for i in range(12) for m in range(14)]
    panel = spark.createDataFrame(rows, "ID long, date date, ret double, RATING_NUM double, VW double, PRICE double")
    windows = lambda n: long_short_grid(panel, [SortSpec(Momentum(3, 1), 2, 2, filter=FilterSpec("trim", 0.2 + i / 100)) for i in range(n)])._jdf.queryExecution().optimizedPlan().toString().count("windowspecdefinition")
    assert windows(3) == windows(30)
    for spec in (SortSpec(Reversal(4, 2), 2, 2, filter=FilterSpec("bounce", -0.05)), SortSpec(Momentum(3, 0), 2, filter=FilterSpec("price", (55, 100)))):
        one = {(r.date, r.regime): (r.ew, r.vw) for r in Strategy(panel, spec).long_short.collect()}
        got = {(r.date, r.regime): (r.ew, r.vw) for r in long_short_grid(panel, [spec]).collect()}
        assert got.keys() == one.keys() and all(got[k] == pytest.approx(one[k], nan_ok=True) if None not in one[k] else got[k] == one[k] for k in one)


def test_filters_in_batches_are_those_in_columns(spark):
    values = [None, float("nan"), float("inf"), -float("inf"), -0.3, -0.2, -0.1, 0.0, 0.1, 0.2, 0.3, 20.0, 25.0, 150.0]
    rows = [(r, p, b) for i, r in enumerate(values) for p in values for b in (values[i], values[-1 - i], None)]
    df = spark.createDataFrame(rows, "ret double, PRICE double, bounce double")
    levels = (0.2, -0.2, 0.0, 25.0, 150.0, 20.0, (-0.2, 0.2), (20.0, 150.0))
    filters = [FilterSpec(adj, x) for adj in ("trim", "price", "bounce") for x in levels] + [FilterSpec("price", 20.0, price_threshold=20.0)]
    got = df.select(*[F.struct(passes(f).alias("a"), in_universe(f).alias("b")) for f in filters]).collect()
    column = {c: np.array([np.nan if r[i] is None else r[i] for r in rows]) for i, c in enumerate(("ret", "PRICE", "bounce"))}
    known = {c: np.array([r[i] is not None for r in rows]) for i, c in enumerate(column)}
    for j, f in enumerate(filters):
        c = {"trim": "ret", "price": "PRICE", "bounce": "bounce"}[f.adj]
        a, b = truths(f, known["ret"], np.where(known[c], column[c], 0), known[c])
        assert [(bool(x), bool(y)) for x, y in zip(a, b)] == [(r[j].a, r[j].b) for r in got], f


def odd_panel(spark):
    rng = np.random.default_rng(11)
    some = lambda x, p: None if rng.random() < p else float("nan") if rng.random() < p / 2 else x
    rows = [
        (i, DAY[m], some(float(np.round(rng.normal() / 4, 2)), 0.06), float(1 + (i * 5 + m) % 22), some(float(1 + i % 5), 0.1), some(float(rng.integers(0, 5)), 0.1), float(40 + rng.integers(0, 150)))
        for i in range(60) for m in range(12) if rng.random() > 0.05
    ]
    return spark.createDataFrame(rows, "ID long, date date, ret double, RATING_NUM double, VW double, x double, PRICE double")


def test_blocks_of_dates_are_as_a_row_for_each_spec(spark, monkeypatch):
    """Nulls, NaN, ties, gaps; a date that is too large for a block, and one that has room for a signal at a time."""
    panel, cleaned = odd_panel(spark), (None, FilterSpec("trim", 0.3), FilterSpec("bounce", (-0.05, 0.05)), FilterSpec("price", (50, 150)), FilterSpec("wins", 90, "both"), FilterSpec("wins", 95, "left"))
    specs = [SortSpec(x, 3, 2, rating=r, filter=f, dynamic_weights=d) for x in ("x", Momentum(2, 1), Reversal(3, 1)) for f in cleaned for r, d in ((None, False), ("NIG", True))]
    found = {}
    for room in (blocks.BLOCK_BYTES, 8 * 60 * 14, 0):
        monkeypatch.setattr(blocks, "BLOCK_BYTES", room)
        out = long_short_grid(panel, specs)
        assert ("Generate" in out._jdf.queryExecution().optimizedPlan().toString()) == (room == 0)
        found[room] = {(r.spec, r.date, r.regime): tuple(None if v is None else round(v, 10) + 0.0 for v in (r.ew, r.vw)) for r in out.collect()}
    whole = repr(sorted(found[0].items()))
    assert len(whole) > 10_000 and all(repr(sorted(v.items())) == whole for v in found.values())


def test_a_rating_grid_has_no_row_for_each_spec(spark):
    """Rows that are sorted do not follow the number of cleanings."""
    assert "Generate" not in long_short_grid(odd_panel(spark), rating_grid(3))._jdf.queryExecution().optimizedPlan().toString()


def test_a_momentum_grid_has_no_row_for_each_spec(spark):
    """Both windows, each dealt by ID once and by date once, and put in order by ID once, whatever the number of cleanings."""
    plan = long_short_grid(odd_panel(spark), momentum_grid((2, 3), 3))._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and plan.count("RepartitionByExpression") == 4
    assert "date#" not in "".join(re.findall(r"windowspecdefinition\([^)]*", plan))
