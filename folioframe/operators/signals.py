"""Signals from past returns, and running series: windows over an ID's rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from folioframe.spec import Momentum, Reversal, SortSpec


def by_id() -> WindowSpec:
    """An ID's rows by date."""
    return Window.partitionBy("ID").orderBy("date")


def _full(x: Column, rows: int, over: WindowSpec | None = None) -> Column:
    """Sum of the last ``rows`` rows, null unless all of them have a value."""
    frame = (over or by_id()).rowsBetween(-(rows - 1), 0)
    return F.when(F.count(x).over(frame) == rows, F.sum(x).over(frame))


def add_momentum(panel: DataFrame, window: int, skip: int = 1, ret: str = "ret", name: str = "signal") -> DataFrame:
    """exp(sum of log(1 + ret)) - 1 over the last ``window`` rows, as it was ``skip`` rows before."""
    log = F.when(F.col(ret) > -1, F.log(1 + F.col(ret)))
    out = panel.withColumn(name, F.exp(_full(log, window)) - 1)
    return out.withColumn(name, F.lag(name, skip).over(by_id())) if skip else out


def add_reversal(panel: DataFrame, window: int, skip: int, ret: str = "ret", name: str = "signal") -> DataFrame:
    """Sum over the last ``window`` rows less the sum over the last ``skip``."""
    return panel.withColumn(name, _full(F.col(ret), window) - _full(F.col(ret), skip))


def add_signal(panel: DataFrame, spec: SortSpec, ret: str = "ret") -> DataFrame:
    """The panel with the sort's signal, from return column ``ret``; a named column is as it is."""
    s = spec.signal
    if isinstance(s, str):
        return panel
    if isinstance(s, Momentum):
        return add_momentum(panel, s.window, s.skip, ret, s.name)
    if isinstance(s, Reversal):
        return add_reversal(panel, s.window, s.skip, ret, s.name)
    return s(panel, ret, spec.signal_name)


def add_signals(panel: DataFrame, wanted: dict[str, tuple[SortSpec, str]], over: WindowSpec | None = None) -> DataFrame:
    """The panel with a column for each name: the signal of a sort from a return column.

    The windows of all momentum and reversal signals go into three steps, however many there are; ``over`` can
    give an ID's rows in another order that is the one by date.
    """
    over = over or by_id()
    first, second, third = {}, {}, {}
    for name, (spec, ret) in wanted.items():
        s = spec.signal
        if isinstance(s, Momentum):
            first[f"_log_{name}"] = F.when(F.col(ret) > -1, F.log(1 + F.col(ret)))
            second[f"_raw_{name}"] = F.exp(_full(F.col(f"_log_{name}"), s.window, over)) - 1
            third[name] = F.lag(f"_raw_{name}", s.skip).over(over) if s.skip else F.col(f"_raw_{name}")
        elif isinstance(s, Reversal):
            second[name] = _full(F.col(ret), s.window, over) - _full(F.col(ret), s.skip, over)
        elif isinstance(s, str):
            third[name] = F.col(s)
        else:
            panel = s(panel, ret, name)
    for step in (first, second, third):
        panel = panel.withColumns(step) if step else panel
    return panel.drop(*first, *[c for c in second if c not in wanted])


def add_wealth(series: DataFrame, value: str = "value", name: str = "wealth", by: tuple[str, ...] = ()) -> DataFrame:
    """Running product of 1 + value: null where the value is, going on after it."""
    over = Window.partitionBy(*by).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return series.withColumn(name, F.when(F.col(value).isNotNull(), F.product(1 + F.col(value)).over(over)))


def add_running_sum(series: DataFrame, value: str = "value", name: str = "total", by: tuple[str, ...] = ()) -> DataFrame:
    over = Window.partitionBy(*by).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return series.withColumn(name, F.when(F.col(value).isNotNull(), F.sum(value).over(over)))
