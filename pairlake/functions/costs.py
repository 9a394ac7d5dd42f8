"""What it costs to insert, remove and change a symbol."""

from __future__ import annotations

import math
from collections.abc import Callable, Hashable, Mapping, Sequence
from dataclasses import dataclass, field
from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame

Table = Mapping[tuple[Hashable | None, Hashable | None], float]


@dataclass
class Costs:
    """Costs of edits from the first sequence or tree to the second.

    ``table`` names costs of single symbols: (x, y) of changing x to y, (x, None) of
    removing x, (None, y) of inserting y. What it does not name costs ``update``,
    ``remove`` and ``insert``; equal symbols cost nothing. ``update`` may be a function of
    two symbols instead of a number; it is called once for each two kinds that
    meet. Costs are finite and not below 0.
    """

    insert: float = 1.0
    remove: float = 1.0
    update: float | Callable[[Hashable, Hashable], float] = 1.0
    table: Table = field(default_factory=dict)

    def __post_init__(self) -> None:
        numbers = [self.insert, self.remove, *self.table.values(), *([] if callable(self.update) else [self.update])]
        if any(not math.isfinite(n) or n < 0 for n in numbers):
            raise ValueError("costs are finite numbers not below 0")
        self.changes_of: dict = {}
        for (x, y), cost in self.table.items():
            if x is not None and y is not None:
                self.changes_of.setdefault(x, {})[y] = cost
        # whole multiples of one unit are added up without error
        self.scale, self.exact = 1, False
        if not callable(self.update):
            parts = [Fraction(str(float(n))).denominator for n in numbers]
            whole = math.lcm(*parts)
            self.scale, self.exact = (whole, True) if whole <= 10**6 else (1, False)

    @property
    def unit(self) -> bool:
        return not self.table and not callable(self.update) and self.insert == self.remove == self.update == 1

    def sized(self, value):
        """Costs in units of 1 / ``scale``."""
        return value if self.scale == 1 else np.rint(np.asarray(value, np.float64) * self.scale)

    def inserted(self, symbols: Sequence) -> np.ndarray:
        """Cost of each symbol's insertion, in units of 1 / ``scale``."""
        return self.sized(np.array([self.table.get((None, s), self.insert) for s in symbols], np.float64))

    def removed(self, symbols: Sequence) -> np.ndarray:
        return self.sized(np.array([self.table.get((s, None), self.remove) for s in symbols], np.float64))

    def changed(self, symbol: Hashable, kinds: Mapping[Hashable, int]) -> np.ndarray:
        """Cost of changing ``symbol`` to each of ``kinds`` (symbol -> place)."""
        if callable(self.update):
            out = np.array([float(self.update(symbol, k)) for k in kinds], np.float64)
        else:
            out = np.full(len(kinds), float(self.update))
            if symbol in kinds:
                out[kinds[symbol]] = 0.0
        for other, cost in self.changes_of.get(symbol, {}).items():
            if other in kinds:
                out[kinds[other]] = cost
        return self.sized(out)


UNIT = Costs()


def cost_table(rows: DataFrame, a: str = "a", b: str = "b", cost: str = "cost", most: int = 1_000_000) -> dict:
    """The table of ``Costs`` from rows (symbol or null, symbol or null, cost).

    It goes to every task, so it is an alphabet's table, not a corpus: more than
    ``most`` rows, a pair named twice, and rows without symbols or cost are errors.
    """
    found = rows.select(a, b, cost).limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} costs")
    table = {(x, y): c for x, y, c in found}
    if len(table) < len(found) or (None, None) in table or None in table.values():
        raise ValueError("a cost for each pair of symbols once")
    return {k: float(c) for k, c in table.items()}
