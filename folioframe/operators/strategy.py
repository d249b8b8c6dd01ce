"""A sort, held over overlapping cohorts: members, returns, long-short, turnover, characteristics.

The panel is dealt once by ID; signals, lags and the values at later dates all come from windows over
that dealing. What is dealt after it are a few numbers for each member, and after the first
aggregation a few rows for each date.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioframe.operators.banding import band
from folioframe.operators.filters import Bounds, add_filtered, in_rating, in_universe
from folioframe.operators.inference import hac_alpha
from folioframe.operators.quantiles import FEW_GROUPS, add_bin, counted_percentiles
from folioframe.operators.signals import add_signal
from folioframe.sources.files import written
from folioframe.spec import SortSpec


def at_offset(c: str, h: int) -> Column:
    """The ID's value exactly h periods later (by calendar position); null if it has no row there."""
    return F.first(c).over(Window.partitionBy("ID").orderBy("t").rangeBetween(h, h))


def all_or_null(agg: Column, value: str, n: int) -> Column:
    """An aggregate that is null unless n values went in."""
    return F.when(F.count(value) == n, agg)


def add_second(held: DataFrame, keys: Sequence[str], x: str, spec: SortSpec, groups: int, largest: int) -> DataFrame:
    """``held`` with ``ptf``: the first bin ``_bin`` and the bin of ``x`` among those matched at this horizon, of all or of the first bin."""
    if spec.how == "unconditional":
        held = add_bin(held, keys, x, spec.nport2, "_bin2", groups, largest)
        return held.withColumn("ptf", (F.col("_bin") - 1) * spec.nport2 + F.col("_bin2"))
    keys = [*keys, "_bin"]
    held = add_bin(held, keys, x, spec.nport2, "_bin2", groups * spec.nport, largest)
    # ties can leave the top bin empty; the offset is the highest bin there is
    top = held.groupBy(*keys).agg(F.max("_bin2").alias("_top"))
    top = F.broadcast(top) if groups * spec.nport <= FEW_GROUPS else top
    return held.join(top, keys).withColumn("ptf", (F.col("_bin") - 1) * F.col("_top") + F.col("_bin2"))


class Strategy:
    """One sort of one panel. Frames are built when asked for, and are lazy themselves.

    ``panel`` is canonical (``ID, date, ret, RATING_NUM, VW`` and what the sort names). Returns come
    out for regime ``ea`` (raw returns, no look-ahead) and, with a filter, ``ep`` (filtered returns of
    the same portfolios, which looks ahead). Winsorising finds its bounds when the first frame is asked
    for, unless ``bounds`` has them.
    """

    def __init__(self, panel: DataFrame, spec: SortSpec, bounds: Bounds | None = None) -> None:
        self.panel, self.spec, self._bounds = panel, spec, bounds
        self.regimes = ("ea", "ep") if spec.filter else ("ea",)

    # ------------------------------------------------------------------ members

    @cached_property
    def prepared(self) -> DataFrame:
        """The panel with time, filtered returns and signal."""
        s = self.spec
        panel = self.panel.join(F.broadcast(self.calendar), "date")
        if s.filter:
            panel = add_filtered(panel, s.filter, self.panel, self._bounds)
        return add_signal(panel, s, "ret_adj" if s.filter else "ret")

    @cached_property
    def _dates(self) -> list:
        """Dates in order, each with its number of rows: found once for all frames."""
        return sorted(tuple(r) for r in self.panel.where("date IS NOT NULL").groupBy("date").count().collect())

    @cached_property
    def calendar(self) -> DataFrame:
        """(date, t) as a small local table, one row for each date."""
        rows = [(d, t) for t, (d, _) in enumerate(self._dates)]
        return self.panel.sparkSession.createDataFrame(rows, "date date, t int")

    @property
    def n_dates(self) -> int:
        return len(self._dates)

    @cached_property
    def _largest(self) -> int:
        """Rows of the largest cross-section."""
        return max((n for _, n in self._dates), default=0)

    @property
    def _groups(self) -> int:
        """Dates, horizons and regimes."""
        return self.n_dates * self.spec.holding * len(self.regimes)

    @cached_property
    def eligible(self) -> DataFrame:
        """Rows that can be sorted at their date, with what the holding periods need from later dates."""
        s, K = self.spec, self.spec.holding
        later: dict[str, Column] = {}
        for h in range(1, K + 1):
            later[f"_ret{h}"] = at_offset("ret", h)
            if s.filter:
                later[f"_adj{h}"] = at_offset("ret_adj_ep", h)
            if h > 1 and (s.dynamic_weights or s.chars):
                later[f"_vw{h - 1}"] = at_offset("VW", h - 1)
            if h > 1:
                later |= {f"_{c}{h - 1}": at_offset(c, h - 1) for c in s.chars}
        panel = self.prepared.withColumns(later)
        present = F.col(s.signal_name).isNotNull()
        if s.signal2:
            present &= F.col(s.signal2).isNotNull()
        rows = panel.where(present & in_rating(s.rating) & in_universe(s.filter))
        return rows.where(F.col("t") < self.n_dates - K)

    @cached_property
    def _sorted(self) -> DataFrame:
        """A row for each member of each cohort at each horizon and regime, with its portfolio."""
        s = self.spec
        first = add_bin(self.eligible, ["t"], s.signal_name, s.nport, "_bin", self.n_dates, self._largest)
        holds = []
        for h in range(1, s.holding + 1):
            weight = F.col("VW") if h == 1 or not s.dynamic_weights else F.col(f"_vw{h - 1}")
            base = F.col("VW") if h == 1 else F.col(f"_vw{h - 1}") if s.chars else F.lit(None).cast("double")
            chars = [F.col(c if h == 1 else f"_{c}{h - 1}").alias(c) for c in s.chars]
            for regime in self.regimes:
                ret = F.col(f"_ret{h}")
                used = ret if regime == "ea" else F.col(f"_adj{h}")
                ok = used.isNotNull() & (weight.isNotNull() if s.dynamic_weights else F.lit(True))
                holds.append(
                    F.when(ok, F.struct(F.lit(h).alias("h"), F.lit(regime).alias("regime"), used.alias("r"), ret.alias("ret"),
                                        weight.alias("w"), base.alias("_base"), *chars))
                )
        second = [s.signal2] if s.signal2 else []
        held = first.select("ID", "t", "_bin", *second, F.explode(F.filter(F.array(*holds), lambda x: x.isNotNull())).alias("_x"))
        held = held.select("ID", "t", "_bin", *second, "_x.*").withColumns(
            {"tau": F.col("t") + F.col("h"), "cohort": F.col("t") % s.holding}
        )
        if s.signal2 is None:
            held = held.withColumnRenamed("_bin", "ptf")
        else:
            held = add_second(held, ["t", "h", "regime"], s.signal2, s, self._groups, self._largest)
        return held.withColumn("ptf", F.col("ptf").cast("int"))

    @cached_property
    def members(self) -> DataFrame:
        """``_sorted`` after banding, with each member's share of its portfolio."""
        s, held = self.spec, self._sorted
        if s.banding:
            turns = self.eligible.select("t").distinct()
            nth = F.row_number().over(Window.partitionBy(F.col("t") % s.holding).orderBy("t")) - 1
            held = held.join(F.broadcast(turns.withColumn("_nth", nth)), "t")
            n_r = len(self.regimes)
            step = (F.col("_nth") * s.holding + F.col("h") - 1) * n_r + F.when(F.col("regime") == "ep", 1).otherwise(0)
            held = band(held.withColumn("step", step).drop("_nth"), s.portfolios, s.banding).drop("step")
        return held

    def stored(self) -> Strategy:
        """The same strategy with its members, and their cohorts' returns, written to the shared folder now.

        All its frames are then made from these two tables: the panel is sorted once, however many are
        asked for, and a lost executor costs a part of a table.
        """
        out = Strategy(self.panel, self.spec, self._bounds)
        out.__dict__["_dates"] = self._dates
        out.__dict__["members"] = written(self.members, "members")
        out.__dict__["cohort_returns"] = written(out.cohort_returns, "cohort-returns")
        return out

    # ------------------------------------------------------------------ returns

    @cached_property
    def cohort_returns(self) -> DataFrame:
        """(regime, t, h, tau, ptf, ew, vw, n, weight): returns of each cohort's portfolios at each horizon.

        A portfolio whose members all lack weights, or weigh nothing, has a value-weighted return of 0.
        """
        return self.members.groupBy("regime", "t", "h", "tau", "ptf").agg(
            F.avg("r").alias("ew"),
            F.coalesce(F.try_divide(F.sum(F.col("r") * F.col("w")), F.sum("w")), F.lit(0.0)).alias("vw"),
            F.count(F.lit(1)).alias("n"),
            F.sum("w").alias("weight"),
        )

    def _dated(self, df: DataFrame, at: str = "tau") -> DataFrame:
        return df.join(F.broadcast(self.calendar.withColumnRenamed("t", at)), at).drop(at)

    @cached_property
    def returns(self) -> DataFrame:
        """(date, regime, ptf, ew, vw): mean over the K cohorts held at a date, null if one is missing."""
        K = self.spec.holding
        mean = self.cohort_returns.groupBy("tau", "regime", "ptf").agg(
            *[all_or_null(F.avg(c), c, K).alias(c) for c in ("ew", "vw")]
        )
        return self._dated(mean)

    @cached_property
    def _legs(self) -> DataFrame:
        """(date, regime, leg, ew, vw): long and short legs; for a double sort those of each first bin."""
        s = self.spec
        if s.signal2 is None:
            leg = F.when(F.col("ptf") == s.nport, "long").when(F.col("ptf") == 1, "short")
            return self.returns.withColumn("leg", leg).where("leg IS NOT NULL").select("date", "regime", "leg", "ew", "vw")
        i, j = F.floor((F.col("ptf") - 1) / s.nport2) + 1, (F.col("ptf") - 1) % s.nport2 + 1
        side = F.when(j == s.nport2, "long").when(j == 1, "short")
        legs = self.returns.withColumns({"side": side, "row": i.cast("int")}).where("side IS NOT NULL")
        return legs.select("date", "regime", F.concat_ws("_", "side", F.col("row").cast("string")).alias("leg"), "ew", "vw")

    def get_ptf(self, regime: str = "ea") -> DataFrame:
        return self.returns.where(F.col("regime") == regime).drop("regime")

    def get_legs(self, side: str, regime: str = "ea") -> DataFrame:
        """(date, leg, ew, vw) of the long or the short side."""
        return self._legs.where((F.col("regime") == regime) & F.col("leg").startswith(side)).drop("regime")

    def get_long_leg(self, regime: str = "ea") -> DataFrame:
        return self.get_legs("long", regime)

    def get_short_leg(self, regime: str = "ea") -> DataFrame:
        return self.get_legs("short", regime)

    @cached_property
    def long_short(self) -> DataFrame:
        """(date, regime, ew, vw): top less bottom; for a double sort the mean over the first bins.

        Null if any portfolio it needs is missing.
        """
        rows = self.spec.nport if self.spec.signal2 else 1
        sign = F.when(F.col("leg").startswith("long"), 1).otherwise(-1)
        total = lambda c: all_or_null(F.sum(F.col(c) * sign) / rows, c, 2 * rows).alias(c)
        return self._legs.groupBy("date", "regime").agg(total("ew"), total("vw"))

    def get_long_short(self, regime: str = "ea") -> DataFrame:
        return self.long_short.where(F.col("regime") == regime).drop("regime")

    def get_alphas(self, factors: DataFrame, names: Sequence[str], lag: int = 0) -> DataFrame:
        """(regime, weighting, n, mean, t, p, alpha, alpha_t, alpha_p) of the long-short series, both regimes at once.

        ``factors`` has a ``date`` and the columns ``names``. See :func:`hac_alpha`.
        """
        both = F.explode(F.array(*[F.struct(F.lit(w).alias("weighting"), F.col(w).alias("value")) for w in ("ew", "vw")]))
        series = self.long_short.select("regime", "date", both.alias("_x")).select("regime", "date", "_x.*")
        return hac_alpha(series, factors, names, ["regime", "weighting"], lag)

    # ------------------------------------------------------------------ weights and turnover

    def _with_cohort(self, members: DataFrame) -> DataFrame:
        """Members beside what :attr:`cohort_returns` has of their portfolio: a few numbers for each group."""
        few = self._groups * self.spec.portfolios <= FEW_GROUPS
        small = self.cohort_returns.select("regime", "t", "h", "ptf", *[F.col(c).alias(f"_{c}") for c in ("ew", "vw", "n", "weight")])
        return members.join(F.broadcast(small) if few else small, ["regime", "t", "h", "ptf"])

    @cached_property
    def weights(self) -> DataFrame:
        """(regime, s, cohort, ptf, ID, ew, vw, ew_drift, vw_drift): weights at s = t + h - 1 and after the
        return that follows. Both drift by the equal-weighted return unless ``vw_drift`` is ``vw``."""
        m = self._with_cohort(self.members)
        share = F.try_divide(F.col("w"), F.col("_weight"))
        by = F.col("_vw" if self.spec.vw_drift == "vw" else "_ew")
        return m.select(
            "regime", (F.col("tau") - 1).alias("s"), "cohort", "ptf", "ID",
            (1 / F.col("_n")).alias("ew"), share.alias("vw"),
            (F.try_divide(1 + F.col("ret"), 1 + F.col("_ew")) / F.col("_n")).alias("ew_drift"),
            (F.try_divide(1 + F.col("ret"), 1 + by) * share).alias("vw_drift"),
        )

    def get_ptf_weights(self, regime: str = "ea") -> DataFrame:
        return self._dated(self.weights.where(F.col("regime") == regime).drop("regime"), "s")

    @cached_property
    def turnover(self) -> DataFrame:
        """(date, regime, ptf, ew, vw): sum over IDs of abs(weight - drifted weight one period before).

        Weights of neighbouring dates are compared along each ID's rows; one that is absent counts as zero.
        A sum of zero is null; the mean over the K cohorts is null if one is.
        """
        K = self.spec.holding
        # An ID has one row of a cohort and date. Its rows are where the panel was dealt to, so nothing moves here.
        rows = Window.partitionBy("ID", "regime", "cohort").orderBy("s")
        before, after = F.lag(F.struct("s", "ptf", "ew_drift", "vw_drift")).over(rows), F.lead("s").over(rows)
        held = self.weights.withColumns({"_b": before, "_after": after}).withColumn("_b", F.when(F.col("_b.s") == F.col("s") - 1, F.col("_b")))
        stays = F.coalesce(F.col("_b.ptf") == F.col("ptf"), F.lit(False))
        moved = lambda ok, s, ptf, ew, vw: F.when(ok, F.struct(s.alias("s"), ptf.alias("ptf"), F.abs(ew).alias("ew"), F.abs(vw).alias("vw")))
        now, ptf = F.col("s"), F.col("ptf")
        entries = F.array(
            moved(stays, now, ptf, F.col("ew") - F.col("_b.ew_drift"), F.col("vw") - F.col("_b.vw_drift")),
            moved(~stays & (now >= 1), now, ptf, F.col("ew"), F.col("vw")),  # comes in
            moved(~stays & F.col("_b").isNotNull(), now, F.col("_b.ptf"), F.col("_b.ew_drift"), F.col("_b.vw_drift")),  # has left another portfolio
            moved(F.coalesce(F.col("_after") != now + 1, F.lit(True)), now + 1, ptf, F.col("ew_drift"), F.col("vw_drift")),  # is not there any more
        )
        each = held.select("regime", "cohort", F.explode(F.filter(entries, lambda x: x.isNotNull())).alias("_x")).select("regime", "cohort", "_x.*")
        whole = lambda x, agg: F.when(F.count(x) == F.count(F.lit(1)), agg)  # noqa: E731  a null weight makes the sum null
        cohorts = each.groupBy("regime", "s", "cohort", "ptf").agg(*[whole(c, F.nullif(F.sum(c), F.lit(0.0))).alias(c) for c in ("ew", "vw")])
        mean = cohorts.groupBy("regime", "s", "ptf").agg(*[all_or_null(F.avg(c), c, K).alias(c) for c in ("ew", "vw")])
        return self._dated(mean, "s")

    def get_ptf_turnover(self, regime: str = "ea") -> DataFrame:
        return self.turnover.where(F.col("regime") == regime).drop("regime")

    # ------------------------------------------------------------------ characteristics

    @cached_property
    def characteristics(self) -> DataFrame:
        """(date, regime, ptf, char, ew, vw): member means of characteristics one period before the date.

        Members need a weight there. Value weights are those of the return and are not made to sum to
        one over the values that are there.
        """
        s = self.spec
        m = self._with_cohort(self.members.where("_base IS NOT NULL")).withColumn("_share", F.try_divide(F.col("w"), F.col("_weight")))
        pairs = F.array(*[F.struct(F.lit(c).alias("char"), F.col(c).cast("double").alias("x")) for c in s.chars])
        long = m.select("regime", "h", "tau", "ptf", "_share", F.explode(pairs).alias("_c")).select("*", "_c.*")
        each = long.groupBy("regime", "h", "tau", "ptf", "char").agg(
            F.avg("x").alias("ew"), F.coalesce(F.sum(F.col("x") * F.col("_share")), F.lit(0.0)).alias("vw")
        )
        mean = each.groupBy("regime", "tau", "ptf", "char").agg(*[all_or_null(F.avg(c), c, s.holding).alias(c) for c in ("ew", "vw")])
        return self._dated(mean)

    def get_chars(self, regime: str = "ea") -> DataFrame:
        return self.characteristics.where(F.col("regime") == regime).drop("regime")

    def get_excluded(self) -> DataFrame:
        """Statistics of the rows the filter excludes: see :func:`excluded_stats`."""
        return excluded_stats(self.prepared, self.spec.chars, by_rating=self.spec.rating is None)


def excluded_stats(filtered: DataFrame, chars: tuple[str, ...] = (), by_rating: bool = True) -> DataFrame:
    """Count, share, moments and quartiles of ``ret`` over the rows marked ``out``, with means of
    characteristics; for IG, NIG (above 10) and ALL, or ALL alone.

    The groups are few and hold all rows: quartiles are found by counting, so that no task has a group.
    """
    every = [F.when(F.col("RATING_NUM") > 10, "NIG").otherwise("IG"), F.lit("ALL")] if by_rating else [F.lit("ALL")]
    rows = filtered.where("out").select("ret", *chars, F.explode(F.array(*every)).alias("category"))
    rows = written(rows, "excluded")  # read for the moments and for the quartiles
    stats = [
        F.count("ret").alias("n"), F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("std"), F.min("ret").alias("min"),
        F.max("ret").alias("max"), *[F.avg(c).alias(f"avg_{c}") for c in chars],
    ]
    table = rows.groupBy("category").agg(*stats)
    levels = {"p25": 0.25, "p50": 0.5, "p75": 0.75}
    quartiles = counted_percentiles(rows, ["category"], "ret", levels, kept=True).groupBy("category").pivot("name", [*levels]).agg(F.first("value"))
    table = table.join(F.broadcast(quartiles), "category", "left")
    total = F.max(F.when(F.col("category") == "ALL", F.col("n"))).over(Window.partitionBy(F.lit(1)))  # three rows
    return table.withColumn("share", F.try_divide(F.col("n"), total))
