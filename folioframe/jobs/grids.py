"""Grids of cleanings, as studies of data uncertainty run them."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from folioframe.spec import FilterSpec, Momentum, SortSpec


def _steps(start: float, step: float, n: int) -> list[float]:
    return [round(start + i * step, 4) for i in range(n)]


def cleanings() -> Iterator[FilterSpec]:
    """120 filters: 48 trims, 30 price and 30 bounce exclusions, 12 winsorisings; each from above, from below and both."""
    for adj, above, below in (
        ("trim", _steps(0.2, 0.05, 16), _steps(-0.95, 0.05, 16)),
        ("price", _steps(150, 100, 10), _steps(20, -2, 10)),
        ("bounce", _steps(0.01, 0.01, 10), _steps(-0.1, 0.01, 10)),
    ):
        yield from (FilterSpec(adj, x) for x in [*above, *below])
        pairs = zip(below, above) if adj == "price" else ((-x, x) for x in above)
        yield from (FilterSpec(adj, pair) for pair in pairs)
    yield from (FilterSpec("wins", x, side) for x in _steps(98, 0.5, 4) for side in ("left", "right", "both"))


def momentum_grid(windows: Iterable[int] = (3, 6), nport: int = 10, rating: str | None = None) -> tuple[SortSpec, ...]:
    """240 strategies: momentum over as many rows as it is held, under each cleaning."""
    return tuple(SortSpec(Momentum(w, 1), nport, w, rating=rating, filter=f) for w in windows for f in cleanings())


def rating_grid(nport: int = 5, rating: str | None = None) -> tuple[SortSpec, ...]:
    """120 strategies: assets sorted by their rating, under each cleaning."""
    return tuple(SortSpec("RATING_NUM", nport, 1, rating=rating, filter=f) for f in cleanings())
