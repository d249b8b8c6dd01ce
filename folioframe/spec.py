"""What to compute: filters and sorts as plain values, checked when they are made."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

ADJUSTMENTS = ("trim", "price", "bounce", "wins")
RATINGS = {"IG": (1, 10), "NIG": (11, 22)}
#: A signal: adds column ``name`` computed from return column ``ret_col``.
SignalBuilder = Callable[[DataFrame, str, str], DataFrame]


@dataclass(frozen=True)
class FilterSpec:
    """A cleaning of returns: ``adj`` at ``level`` (a number, or a pair of bounds).

    ``wins`` needs a ``location`` (left, right, both) and takes the percentile ``level``;
    ``thresholds`` can give its bounds as rows (date, level, value) instead of computing them.
    """

    adj: str
    level: float | tuple[float, float]
    location: str | None = None
    price_threshold: float = 25.0
    thresholds: DataFrame | None = field(default=None, compare=False, hash=False)

    def __post_init__(self) -> None:
        if self.adj not in ADJUSTMENTS:
            raise ValueError(f"adj is one of {ADJUSTMENTS}, not {self.adj!r}")
        if self.adj == "wins":
            if self.location not in ("left", "right", "both"):
                raise ValueError("winsorising needs a location: left, right or both")
            if isinstance(self.level, tuple) or not 50 <= self.level <= 100:
                raise ValueError("winsorising takes one percentile from 50 to 100")
        if isinstance(self.level, list):
            object.__setattr__(self, "level", tuple(self.level))
        if isinstance(self.level, tuple) and (len(self.level) != 2 or self.level[0] > self.level[1]):
            raise ValueError("a pair of levels is (low, high)")

    @property
    def suffix(self) -> str:
        level = "_".join(f"{x:g}" for x in self.level) if isinstance(self.level, tuple) else f"{self.level:g}"
        at = f"_at_{self.price_threshold:g}" if self.adj == "price" and self.price_threshold != 25 else ""
        return f"{self.adj}_{level}{at}" + (f"_{self.location}" if self.location else "")


@dataclass(frozen=True)
class Momentum:
    """Compounded return of the last ``window`` rows, ``skip`` rows back."""

    window: int
    skip: int = 1
    name: str = "signal"

    @property
    def label(self) -> str:
        return f"{self.window}_{self.skip}"


@dataclass(frozen=True)
class Reversal:
    """Sum of the last ``window`` returns less that of the last ``skip``."""

    window: int
    skip: int
    name: str = "signal"

    @property
    def label(self) -> str:
        return f"{self.window}_{self.skip}"


@dataclass(frozen=True)
class SortSpec:
    """A strategy: sort by ``signal`` into ``nport`` (and by ``signal2`` into ``nport2``), hold ``holding`` periods."""

    signal: str | Momentum | Reversal | SignalBuilder
    nport: int
    holding: int = 1
    signal2: str | None = None
    nport2: int | None = None
    how: str = "unconditional"
    rating: str | None = None
    filter: FilterSpec | None = None
    dynamic_weights: bool = False
    banding: int | None = None
    chars: tuple[str, ...] = ()
    turnover: bool = False
    vw_drift: str = "ew"

    def __post_init__(self) -> None:
        if self.nport < 2 or self.holding < 1:
            raise ValueError("a sort needs at least two portfolios and one period")
        if (self.signal2 is None) != (self.nport2 is None):
            raise ValueError("signal2 and nport2 go together")
        if self.how not in ("unconditional", "conditional"):
            raise ValueError("how is unconditional or conditional")
        if self.rating not in (None, *RATINGS):
            raise ValueError("rating is IG, NIG or None")
        if self.banding is not None and self.banding < 0:
            raise ValueError("a band is 0 or wider")
        if self.vw_drift not in ("ew", "vw"):
            raise ValueError("vw_drift is ew or vw")

    @property
    def portfolios(self) -> int:
        return self.nport * (self.nport2 or 1)

    @property
    def signal_name(self) -> str:
        return self.signal if isinstance(self.signal, str) else getattr(self.signal, "name", "signal")

    @property
    def name(self) -> str:
        """Rating, signal's settings, holding period, portfolios, filter: ``ALL_6_1_1_n10_trim_0.2``; second signal, band,
        updated weights and price threshold if they are not the default."""
        label = getattr(self.signal, "label", None) or self.signal_name
        parts = [self.rating or "ALL", label, str(self.holding)]
        if self.signal2:
            parts += [self.how, self.signal2]
        parts.append(f"n{self.nport}" + (f"x{self.nport2}" if self.nport2 else ""))
        if self.banding is not None:
            parts += ["band", str(self.banding)]
        if self.dynamic_weights:
            parts.append("dynamic")
        if self.vw_drift != "ew":
            parts.append("drift_vw")
        return "_".join(parts + ([self.filter.suffix] if self.filter else []))
