"""Small-cell disclosure control over tables that are already aggregated (driver-side, a few rows each)."""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Any

MIN_CELL, FLOOR = 5, 3
INTACT, MERGED, BLANKED = "intact", "merged", "blanked"


@dataclass(frozen=True)
class Cell:
    label: str
    count: int | None
    status: str


def check_min_cell(n: int) -> int:
    if n < FLOOR:
        raise ValueError(f"the least cell must be {FLOOR} or more")
    return n


def protect_ordered(rows: list[tuple[Any, int]], min_cell: int = MIN_CELL) -> list[Cell]:
    """Small cells at the ends are merged inward; a small cell inside takes in its right neighbours.

    A table whose total is small is blanked.  Labels of merged cells are ``a-b``, or ``a+`` at the upper end.
    """
    check_min_cell(min_cell)
    rows = [(k, n) for k, n in rows if n]
    if not rows:
        return []
    if sum(n for _, n in rows) < min_cell:
        return [Cell(f"{rows[0][0]}+" if len(rows) > 1 else str(rows[0][0]), None, BLANKED)]
    groups: list[list] = []  # first, last, count
    for k, n in rows:
        if groups and groups[-1][2] < min_cell:
            groups[-1][1], groups[-1][2] = k, groups[-1][2] + n
        else:
            groups.append([k, k, n])
    if len(groups) > 1 and groups[-1][2] < min_cell:
        _, last, n = groups.pop()
        groups[-1][1], groups[-1][2] = last, groups[-1][2] + n
    out = []
    for i, (a, b, n) in enumerate(groups):
        if a == b:
            out.append(Cell(str(a), n, INTACT))
        else:
            out.append(Cell(f"{a}+" if i == len(groups) - 1 else f"{a}-{b}", n, MERGED))
    return out


def protect_unordered(rows: list[tuple[Any, int]], min_cell: int = MIN_CELL, other: str = "other") -> list[Cell]:
    """Small categories go into ``other``; if that stays small, the smallest shown category joins it, so no difference shows it."""
    check_min_cell(min_cell)
    rows = sorted(((k, n) for k, n in rows if n), key=lambda r: (-r[1], str(r[0])))
    shown, hidden = [r for r in rows if r[1] >= min_cell], [r for r in rows if r[1] < min_cell]
    while hidden and shown and sum(n for _, n in hidden) < min_cell:
        hidden.append(shown.pop())
    out = [Cell(str(k), n, INTACT) for k, n in shown]
    if hidden:
        total = sum(n for _, n in hidden)
        out.append(Cell(other, total if total >= min_cell else None, MERGED if total >= min_cell else BLANKED))
    return out


def protect_contingency(cells: dict[tuple, int], min_cell: int = MIN_CELL) -> dict[tuple, int | None]:
    """The whole table is blanked if any cell that isn't 0 is small."""
    check_min_cell(min_cell)
    small = any(0 < n < min_cell for n in cells.values())
    return {k: None if small else n for k, n in cells.items()}


def protect_count(n: int, units: int | None = None, min_cell: int = MIN_CELL) -> int | None:
    """A count is shown if it is 0, or if it and the units behind it are large enough."""
    check_min_cell(min_cell)
    return n if n == 0 or (n >= min_cell and (units is None or units >= min_cell)) else None


def derived(value: Any, sources: list[str]) -> Any:
    """What is computed from tables is shown only if all of them are intact."""
    return value if all(s == INTACT for s in sources) else None


def continuous(stats: dict[str, float], n: int, min_cell: int = MIN_CELL) -> dict[str, float | None]:
    """Mean and sd need ``min_cell`` values, quartiles four times as many; extremes are never shown."""
    check_min_cell(min_cell)
    out: dict[str, float | None] = {}
    for k, v in stats.items():
        if k in ("min", "max"):
            continue
        need = 4 * min_cell if k in ("q1", "median", "q3") else min_cell
        out[k] = v if n >= need else None
    return out


@dataclass(frozen=True)
class Release:
    """One entry of a release: its kind, its source's name, and the entries it needs intact."""

    name: str
    kind: str
    needs: tuple[str, ...] = ()


def build_release(spec: list[Release], source: dict[str, Any], min_cell: int = MIN_CELL) -> dict[str, Any]:
    """Protect each entry of the source by its kind; entries that need others are withheld unless those are intact."""
    known = {r.name for r in spec}
    for r in spec:
        if missing := [n for n in r.needs if n not in known]:
            raise ValueError(f"{r.name} needs {missing[0]}, which isn't released")
    out: dict[str, Any] = {}
    status: dict[str, str] = {}
    for r in spec:
        x = source.get(r.name)
        if x is None:
            out[r.name], status[r.name] = None, BLANKED
        elif r.kind in ("ordered", "unordered"):
            cells = (protect_ordered if r.kind == "ordered" else protect_unordered)(list(x), min_cell)
            out[r.name] = {c.label: c.count for c in cells}
            status[r.name] = INTACT if all(c.status == INTACT for c in cells) else MERGED
        elif r.kind == "contingency":
            out[r.name] = protect_contingency(x, min_cell)
            status[r.name] = BLANKED if any(v is None for v in out[r.name].values()) else INTACT
        elif r.kind == "count":
            n, units = x if isinstance(x, tuple) else (x, None)
            out[r.name] = protect_count(n, units, min_cell)
            status[r.name] = BLANKED if out[r.name] is None else INTACT
        elif r.kind == "continuous":
            out[r.name] = continuous(*x, min_cell)
            status[r.name] = BLANKED if any(v is None for v in out[r.name].values()) else INTACT
        elif r.kind == "derived":
            status[r.name] = INTACT if all(status.get(n) == INTACT for n in r.needs) else BLANKED
            out[r.name] = x if status[r.name] == INTACT else None
        else:
            raise ValueError(f"{r.name}: no kind {r.kind}")
        if r.kind != "derived" and any(status.get(n) == BLANKED for n in r.needs):
            out[r.name], status[r.name] = None, BLANKED
    return out


class Public(str):
    """Text that a safe log may show."""


def safe_message(template: str, *args: Any) -> str:
    """Arguments appear only if they are marked public; anything else is shown as its type."""
    return template % tuple(a if isinstance(a, Public) else f"<{type(a).__name__}>" for a in args)


def safe_meta(meta: dict[str, Any]) -> dict[str, Any]:
    """Paths are cut to their last part."""
    return {k: re.split(r"[\\/]", v)[-1] if isinstance(v, str) else v for k, v in meta.items()}
