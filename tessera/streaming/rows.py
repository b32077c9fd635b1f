"""Result rows as text."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from tessera.plans.ast import shown


def text_table(names: Sequence[str], rows: Iterable[Sequence]) -> str:
    """A grid with the column names, and the number of rows."""
    cells = [[shown(v) for v in row] for row in rows]
    widths = [max([len(n), *(len(r[k]) for r in cells)]) for k, n in enumerate(names)]
    bar = "+" + "".join("-" * (w + 2) + "+" for w in widths)
    line = lambda values: "|" + "".join(f" {v:<{w}} |" for v, w in zip(values, widths, strict=True))
    return "\n".join([bar, line(names), bar, *map(line, cells), bar, f"({len(cells)} rows)"])
