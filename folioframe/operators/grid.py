"""Many strategies over one panel.

The panel is written once, the bounds of all winsorising filters are found together, and sorts that are
alike in portfolios, bands, holding period and weights share plans: the panel is dealt by ID once for a
plan, and the windows of all its signals and look-ups go over that dealing. The number of plans follows
the shapes of the sorts, not the sorts.

Sorts by one signal without bands have no rows of their own: who can be sorted under which spec is a bit,
and the rows are dealt once more, into blocks of a date, which :mod:`folioframe.operators.blocks` sorts by
each signal once for all specs that share it. The others add one copy of the eligible rows for each spec,
keyed by its number, so that second breakpoints and steps of bands are found for all specs at once.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from folioframe.operators import blocks
from folioframe.operators.banding import band
from folioframe.operators.filters import Bounds, add_bounce, add_filtered, find_bounds, full_bounds, in_rating, in_universe, truths, with_bounds
from folioframe.operators.quantiles import FEW_GROUPS, add_bin
from folioframe.operators.signals import add_signals
from folioframe.operators.strategy import add_second, all_or_null, at_offset
from folioframe.sources.files import written
from folioframe.spec import FilterSpec, Momentum, Reversal, SortSpec

#: Rows of the widened panel that a task windows over, about: each takes some hundred bytes.
TASK_ROWS = 250_000
#: Specs in one plan at most that have rows of their own: each holds a few columns of the widened panel.
CHUNK = 64


def long_short_grid(panel: DataFrame, specs: Sequence[SortSpec]) -> DataFrame:
    """(spec, date, regime, ew, vw): long-short series of all ``specs`` in long form, by :attr:`SortSpec.name`.

    Specs may differ in anything; two of the same name are refused. Without a filter a spec has regime
    ``ea`` alone. The panel is written, and bounds are found, when this is called.
    """
    if len({s.name for s in specs}) < len(specs):
        raise ValueError("two specs of a grid have the same name")
    # Where the panel comes dealt by ID, its bounce costs no dealing here.
    panel = written(add_bounce(panel) if any(s.filter and s.filter.adj == "bounce" for s in specs) else panel, "grid-panel")
    wins = [s.filter for s in specs if s.filter and s.filter.adj == "wins"]
    bounds = find_bounds(panel, wins) if wins else None
    sizes = dict(tuple(r) for r in panel.where("date IS NOT NULL").groupBy("date").count().collect())
    shapes: dict[tuple, list[SortSpec]] = {}
    for s in specs:
        shapes.setdefault((s.nport, s.nport2, s.how, s.banding, s.holding, s.dynamic_weights), []).append(s)
    parts = []
    for alike in shapes.values():
        in_blocks, alike = _fitting(alike, max(sizes.values(), default=0))
        parts += [_in_blocks(panel, some, sizes, bounds) for some in in_blocks]
        parts += [_chunk(panel, alike[i : i + CHUNK], sizes, bounds) for i in range(0, len(alike), CHUNK)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _key(f: FilterSpec | None) -> tuple | None:
    return f and (f, id(f.thresholds))


class _Masks:
    """Exclusions of a plan as bits of a few longs. In ``_k0`` and so on a bit is set if the row has a return that the filter
    leaves, in ``_u0`` and so on if the row can be sorted under it.

    An excluded return is null and any other is as it was. So the signal of past returns under a filter is
    the one without it, or null if a row in its frame is excluded, and the same two columns and a window
    over the longs serve all exclusions. Winsorised returns, and signals of the user's own, are not of this kind.
    """

    def __init__(self, specs: Sequence[SortSpec]) -> None:
        own = {_key(s.filter) for s in specs if not isinstance(s.signal, (str, Momentum, Reversal))}
        some = {_key(s.filter): s.filter for s in specs if s.filter and s.filter.adj != "wins" and _key(s.filter) not in own}
        self.filters, self.place = list(some.values()), {k: i for i, k in enumerate(some)}
        self.words = -(-len(some) // blocks.WORD)

    def has(self, s: SortSpec) -> bool:
        return _key(s.filter) in self.place

    def test(self, s: SortSpec, name: str = "_k{}") -> Column:
        word, bit = blocks.bit_of(self.place[_key(s.filter)])
        return F.col(name.format(word)).bitwiseAND(F.lit(bit).cast("long")) != 0

    def add(self, rows: DataFrame) -> DataFrame:
        """``rows`` with both kinds of longs, worked out for a batch of rows at a time: as expressions of Spark a hundred
        filters took longer than all windows together."""
        filters, words = self.filters, self.words
        watched = [c for c, adj in (("ret", "trim"), ("PRICE", "price"), ("bounce", "bounce")) if c == "ret" or any(f.adj == adj for f in filters)]
        names = [f"_{kind}{w}" for kind in "ku" for w in range(words)]

        @F.arrow_udf(", ".join(f"{n} long" for n in names))
        def bits(*columns: pa.Array) -> pa.Array:
            x = {c: blocks.numbers(v) for c, v in zip(watched, columns)}
            out = np.zeros((2 * words, len(columns[0])), np.int64)
            for i, f in enumerate(filters):
                word, bit = blocks.bit_of(i)
                left, sorted_ = truths(f, x["ret"][1], *x[{"trim": "ret", "price": "PRICE", "bounce": "bounce"}[f.adj]])
                out[word] |= np.where(left, bit, 0)
                out[words + word] |= np.where(sorted_, bit, 0)
            return pa.StructArray.from_arrays([pa.array(v) for v in out], names)

        # Not said to be deterministic: otherwise each use of a long could have all of them worked out again.
        rows = rows.withColumn("_bits", bits.asNondeterministic()(*[F.col(c).cast("double") for c in watched]))
        return rows.select("*", "_bits.*").drop("_bits")

    def framed(self, rows: DataFrame, signals: Sequence[Momentum | Reversal], over: WindowSpec) -> DataFrame:
        """``rows`` with ``_k<signal>_<word>``: the bits that all rows in a signal's frame have."""
        every, before = {}, {}
        for m, s in enumerate(signals):
            span = s.window if isinstance(s, Momentum) else max(s.window, s.skip)
            for w in range(self.words):
                every[f"_k{m}_{w}"] = F.bit_and(f"_k{w}").over(over.rowsBetween(-(span - 1), 0))
                if isinstance(s, Momentum) and s.skip:
                    before[f"_k{m}_{w}"] = F.lag(f"_k{m}_{w}", s.skip).over(over)
        rows = rows.withColumns(every) if every else rows
        return rows.withColumns(before) if before else rows


def _widened(panel: DataFrame, specs: Sequence[SortSpec], sizes: dict, bounds: Bounds | None, returns: bool = True) -> tuple:
    """The panel with ``t``, signals, masks and what the holding periods need from later dates; the calendar, the masks, each
    spec's signal as its name in the panel and as a column that is null where the filter says so, the numbers of filters, and
    the signals that frames of the masks are there for.

    ``returns`` tells that filtered returns of later dates are wanted.
    """
    one = specs[0]  # what they are alike in
    K, dynamic = one.holding, one.dynamic_weights
    dates = sorted(sizes)
    calendar = panel.sparkSession.createDataFrame(list(zip(dates, range(len(dates)))), "date date, t int")
    parts = max(int(panel.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-sum(sizes.values()) // TASK_ROWS))
    masks = _Masks(specs)
    rows = panel.join(F.broadcast(calendar), "date")
    # Masks first: what Python has worked out is dealt anew by any window.
    rows = (masks.add(rows) if masks.words else rows).repartition(parts, "ID")
    rows = with_bounds(rows, [s.filter for s in specs if s.filter], bounds)
    number: dict = {None: None}
    for s in specs:  # filtered returns, once for each filter that the masks don't have
        if _key(s.filter) not in number and not masks.has(s) and (returns or not isinstance(s.signal, str)):
            i = number[_key(s.filter)] = len(number)
            before = rows.columns
            rows = add_filtered(rows, s.filter, bounds=bounds, ready=True)
            rows = rows.select(*before, F.col("ret_adj").alias(f"_a{i}"), F.col("ret_adj_ep").alias(f"_e{i}"))
    past = lambda s: "ret" if isinstance(s.signal, str) or masks.has(s) or not s.filter else f"_a{number[_key(s.filter)]}"
    wanted: dict = {}  # signals, once for each return that they are made of
    for s in specs:
        wanted.setdefault((s.signal, past(s)), (f"_x{len(wanted)}", s))
    shared = list(dict.fromkeys(s.signal for s in specs if masks.has(s) and not isinstance(s.signal, str)))
    over = Window.partitionBy("ID").orderBy("t")  # for later dates, too: rows are put in order once
    rows = masks.framed(add_signals(rows, {name: (s, past(s)) for name, s in wanted.values()}, over), shared, over)
    named = [wanted[s.signal, past(s)][0] for s in specs]
    signal = [F.when(masks.test(s, f"_k{shared.index(s.signal)}_{{}}"), F.col(x)) if masks.has(s) and s.signal in shared else F.col(x) for s, x in zip(specs, named)]
    later = {}
    for h in range(1, K + 1):
        later[f"_ret{h}"] = at_offset("ret", h)
        later |= {f"_later{h}_{w}": F.coalesce(at_offset(f"_k{w}", h), F.lit(0).cast("long")) for w in range(masks.words)}
        later |= {f"_e{i}_{h}": at_offset(f"_e{i}", h) for i in number.values() if i and returns}
        if h > 1 and dynamic:
            later[f"_vw{h - 1}"] = at_offset("VW", h - 1)
    return rows.withColumns(later).where(F.col("t") < len(dates) - K), calendar, masks, named, signal, number, shared


def _fitting(specs: Sequence[SortSpec], largest: int) -> tuple[list[list[SortSpec]], list[SortSpec]]:
    """Specs for :func:`_in_blocks`, as many together as a block of the largest date has room for, and the others.

    Sorts with a second signal, bands or a signal of the user's own are among the others, and so are all of them if dates
    are too large for one task: their breakpoints are then found by counting.
    """
    plain = [s for s in specs if s.signal2 is None and s.banding is None and isinstance(s.signal, (str, Momentum, Reversal))]
    groups: dict[tuple, list[SortSpec]] = {}
    for s in plain:
        own = s.filter if s.filter and s.filter.adj == "wins" and not isinstance(s.signal, str) else None
        groups.setdefault((s.signal, _key(own)), []).append(s)
    found: list[list[SortSpec]] = []
    for some in groups.values():
        if found and _bytes([*found[-1], *some], largest) <= blocks.BLOCK_BYTES:
            found[-1] += some
        elif _bytes(some, largest) <= blocks.BLOCK_BYTES:
            found.append(list(some))
    taken = {s.name for some in found for s in some}
    return found, [s for s in specs if s.name not in taken]


def _bytes(specs: Sequence[SortSpec], largest: int) -> int:
    """What the rows of the largest date take as columns of :func:`_in_blocks`, at most."""
    signals = {(s.signal, _key(s.filter) if s.filter and s.filter.adj == "wins" and not isinstance(s.signal, str) else None) for s in specs}
    words, K = _Masks(specs).words, specs[0].holding
    ok = len({x if not isinstance(x, str) else None for x, key in signals if key is None}) * words
    return 8 * largest * (len(signals) + ok + 2 + K * (1 + words) + (K - 1) * specs[0].dynamic_weights)


def _in_blocks(panel: DataFrame, specs: Sequence[SortSpec], sizes: dict, bounds: Bounds | None) -> DataFrame:
    """Single sorts: who can be sorted is a bit for each filter, and a block of a date gives the returns of all specs."""
    one = specs[0]
    rows, calendar, masks, named, _, _, shared = _widened(panel, specs, sizes, bounds, returns=False)
    both = lambda m, w: F.coalesce(F.col(f"_k{m}_{w}").bitwiseAND(F.col(f"_u{w}")), F.lit(0).cast("long"))
    ok = {f"_ok{m}_{w}": both(m, w) for m in range(len(shared)) for w in range(masks.words)}
    ratings = [r for r in dict.fromkeys(s.rating for s in specs) if r]
    for i, r in enumerate(ratings):
        ok["_rated"] = F.when(in_rating(r), F.lit(1 << i)).otherwise(F.lit(0)).cast("long").bitwiseOR(ok.get("_rated", F.lit(0).cast("long")))

    def sort(j: int, s: SortSpec) -> blocks.Sort:
        rated = ratings.index(s.rating) if s.rating else None
        if not masks.has(s):
            return blocks.Sort(j, named[j], rated=rated, clip=full_bounds(s.filter, bounds) if s.filter else None)
        return blocks.Sort(j, named[j], f"_ok{shared.index(s.signal)}_{{}}" if s.signal in shared else "_u{}", rated, masks.place[_key(s.filter)])

    block = blocks.Block(one.nport, one.holding, one.dynamic_weights, masks.words, tuple(sort(j, s) for j, s in enumerate(specs)))
    rows = rows.withColumns(ok) if ok else rows
    rows = rows.select(*[c if c == "t" or c in block.longs else F.col(c).cast("double").alias(c) for c in block.columns])
    dealt = rows.repartition(max(1, len(sizes)), "t").groupBy("t")
    return _series(dealt.applyInArrow(blocks.cohorts_of(block), blocks.SCHEMA), specs, calendar)


def _chunk(panel: DataFrame, specs: Sequence[SortSpec], sizes: dict, bounds: Bounds | None) -> DataFrame:
    one = specs[0]  # what they are alike in
    n, K, dynamic = one.nport, one.holding, one.dynamic_weights
    rows, calendar, masks, _, signal, number, _ = _widened(panel, specs, sizes, bounds)
    of = lambda s: number[_key(s.filter)]
    ahead_of = lambda s, h: F.when(masks.test(s, f"_later{h}_{{}}"), F.col(f"_ret{h}")) if masks.has(s) else F.col(f"_e{of(s)}_{h}")
    entries = []
    second = lambda s: [F.col(s.signal2).cast("double").alias("y")] if s.signal2 else []
    for j, s in enumerate(specs):
        ok = F.lit(True) if s.signal2 is None else F.col(s.signal2).isNotNull()
        ok &= signal[j].isNotNull() & in_rating(s.rating) & in_universe(s.filter)
        ahead = F.array(*[ahead_of(s, h) if s.filter else F.lit(None).cast("double") for h in range(1, K + 1)])
        entries.append(F.when(ok, F.struct(F.lit(j).alias("j"), signal[j].cast("double").alias("x"), ahead.alias("ep"), *second(s))))
    kept = ["ID", "t", "VW", *[c for c in rows.columns if c.startswith(("_ret", "_vw"))]]
    long = rows.select(*kept, F.explode(F.filter(F.array(*entries), lambda x: x.isNotNull())).alias("_x")).select(*kept, "_x.*")
    groups, largest = len(sizes) * len(specs), max(sizes.values(), default=0)
    long = add_bin(long, ["j", "t"], "x", n, "_bin", groups, largest)
    holds = []
    for h in range(1, K + 1):
        w = F.col("VW") if h == 1 or not dynamic else F.col(f"_vw{h - 1}")
        for regime, used in (("ea", F.col(f"_ret{h}")), ("ep", F.element_at("ep", h))):
            ok = used.isNotNull() & (w.isNotNull() if dynamic else F.lit(True))
            holds.append(F.when(ok, F.struct(F.lit(h).alias("h"), F.lit(regime).alias("regime"), used.alias("r"), w.alias("w"))))
    if one.signal2 is None and one.banding is None:
        long = long.where(F.col("_bin").isin(1, n))  # the others are not needed
    columns = ["ID", "j", "t", "_bin", *(["y"] if one.signal2 else [])]
    held = long.select(*columns, F.explode(F.filter(F.array(*holds), lambda x: x.isNotNull())).alias("_y")).select(*columns, "_y.*")
    if one.signal2:
        held = add_second(held, ["j", "t", "h", "regime"], "y", one, 2 * K * groups, largest)
    else:
        held = held.withColumn("ptf", F.col("_bin"))
    held = held.withColumn("ptf", F.col("ptf").cast("int"))
    if one.banding is not None:
        turns = long.select("j", "t").distinct()  # a row for each date and spec
        nth = F.row_number().over(Window.partitionBy("j", F.col("t") % K).orderBy("t")) - 1
        held = held.join(F.broadcast(turns.withColumn("_nth", nth)) if groups <= FEW_GROUPS else turns.withColumn("_nth", nth), ["j", "t"])
        regimes = F.element_at(F.array(*[F.lit(2 if s.filter else 1) for s in specs]), F.col("j") + 1)
        step = (F.col("_nth") * K + F.col("h") - 1) * regimes + F.when(F.col("regime") == "ep", 1).otherwise(0)
        held = band(held.withColumns({"step": step, "cohort": F.col("t") % K}).drop("_nth"), one.portfolios, one.banding, ("j", "cohort", "ID"))
    cohort = held.groupBy("j", "regime", "ptf", "t", "h").agg(
        F.avg("r").alias("ew"), F.coalesce(F.try_divide(F.sum(F.col("r") * F.col("w")), F.sum("w")), F.lit(0.0)).alias("vw")
    )
    return _series(cohort, specs, calendar)


def _series(cohort: DataFrame, specs: Sequence[SortSpec], calendar: DataFrame) -> DataFrame:
    """Long-short series of the specs from (j, regime, ptf, t, h, ew, vw), the returns of each cohort at each horizon."""
    one = specs[0]
    n, K = one.nport, one.holding
    mean = cohort.groupBy("j", "regime", "ptf", (F.col("t") + F.col("h")).alias("t")).agg(*[all_or_null(F.avg(c), c, K).alias(c) for c in ("ew", "vw")])
    last, rows_ = (one.nport2, n) if one.signal2 else (n, 1)
    place = (F.col("ptf") - 1) % last
    sign = F.when(place == last - 1, 1).when(place == 0, -1)
    legs = mean.withColumn("sign", sign).where("sign IS NOT NULL")
    out = legs.groupBy("j", "regime", "t").agg(*[all_or_null(F.sum(F.col(c) * F.col("sign")) / rows_, c, 2 * rows_).alias(c) for c in ("ew", "vw")])
    names = F.element_at(F.array(*[F.lit(s.name) for s in specs]), F.col("j") + 1)
    return out.join(F.broadcast(calendar), "t").select(names.alias("spec"), "date", "regime", "ew", "vw")
