"""Aggregates over the last n rows without reading a frame anew for every row.

A result over 4m rows is put together from four results over m rows, m, 2m and 3m rows apart.  Levels 1, 4, 16, ... are
built once and shared by all frames on a column; a frame of n rows then takes the few pieces that the base-4 digits of n
name; short frames (PLAIN_ROWS) stay plain ones.  A row costs a number of lags that grows with the logarithm of n, not with n, and as nothing is ever subtracted a sum or a
deviation loses no digits to what lies outside its frame.

Pieces that merge: counts and sums add, extremes compare, deviations merge (count, mean, sum of squares about the mean).
Nulls are skipped as in a plain frame.  All steps run over the window of a chunk, so `framed` gives them one exchange and sort.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

from tidebar.functions.indicators import rolling, rolling_partial

BASE = 4
#: Up to this length a plain frame is read row by row: a bounded cost, and less than that of the columns in between.
PLAIN_ROWS = 64
Builder = Callable[[WindowSpec], dict[str, Column]]


@dataclass(frozen=True)
class Slide:
    """kind (avg, sum, max, min, stddev_samp) of a column over the n rows that end `shift` rows before the current one.

    Null until the frame holds n values; with `partial` as soon as a plain frame would have a result.
    """

    kind: str
    value: str
    n: int
    shift: int = 0
    partial: bool = False

    def __post_init__(self):
        if self.kind not in PARTS:
            raise ValueError(f"unknown sliding aggregate {self.kind!r}")
        if self.n < 1 or self.shift < 0:
            raise ValueError(f"a frame of {self.n} rows, {self.shift} rows back")

    @property
    def back(self) -> int:
        """Rows before the current one that the frame reaches."""
        return self.n + self.shift - 1


#: What a kind keeps of a piece beside the count of its values.
PARTS = {"avg": ["sum"], "sum": ["sum"], "max": ["max"], "min": ["min"], "stddev_samp": ["mean", "square"]}


def _unit(part: str, value: Column) -> Column:
    if part == "count":
        return value.isNotNull().cast("int")
    if part == "square":
        return F.lit(0.0)
    return value if part in ("max", "min") else F.coalesce(value.cast("double"), F.lit(0.0))


def _added(items: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, items)


def _merge(part: str, pieces: Sequence[Callable[[str], Column]], total: Callable[[str], Column]) -> Column:
    """A part over all pieces; each piece, and what is merged already, is asked for its parts by name."""
    zero = F.lit(0.0)
    if part in ("max", "min"):
        own = [p(part) for p in pieces]
        return own[0] if len(own) == 1 else (F.greatest if part == "max" else F.least)(*own)
    if part == "count":
        return _added([F.coalesce(p("count"), F.lit(0)) for p in pieces])
    if part == "mean":
        weighted = _added([F.coalesce(p("count") * p("mean"), zero) for p in pieces])
        return F.when(total("count") > 0, weighted / total("count")).otherwise(zero)
    if part == "square":
        off = [p("mean") - total("mean") for p in pieces]
        return _added([F.coalesce(p("square") + p("count") * d * d, zero) for p, d in zip(pieces, off)])
    return _added([F.coalesce(p(part), zero) for p in pieces])


#: Parts in the order they can be merged in: each row reads only rows above it.
ORDER = [["count", "sum", "max", "min"], ["mean"], ["square"]]


def _step(wanted: Mapping[str, tuple[set[str], list[tuple[str, int]]]]) -> list[Builder]:
    """Builders for results name -> (parts, pieces as (prefix, rows back)): the lags in one window, then the merging."""
    held = {(prefix, rows, part) for parts, pieces in wanted.values() for prefix, rows in pieces if rows for part in parts}

    def lags(w: WindowSpec) -> dict[str, Column]:
        return {f"{prefix}_{part}_b{rows}": F.lag(f"{prefix}_{part}", rows).over(w) for prefix, rows, part in sorted(held)}

    def piece(prefix: str, rows: int) -> Callable[[str], Column]:
        return lambda part: F.col(f"{prefix}_{part}_b{rows}" if rows else f"{prefix}_{part}")

    def merged(group: list[str]) -> Builder:
        def build(_: WindowSpec) -> dict[str, Column]:
            out = {}
            for name, (parts, pieces) in wanted.items():
                sources = [piece(*p) for p in pieces]
                for part in group:
                    if part in parts:
                        out[f"{name}_{part}"] = _merge(part, sources, lambda p, name=name: F.col(f"{name}_{p}"))
            return out

        return build

    present = set().union(*[parts for parts, _ in wanted.values()]) if wanted else set()
    return [lags, *[merged(g) for g in ORDER if present & set(g)]]


def _plain(slides: Mapping[str, Slide]) -> Builder:
    def build(w: WindowSpec) -> dict[str, Column]:
        rule = {False: rolling, True: rolling_partial}
        return {name: rule[s.partial](s.kind, F.col(s.value), w, s.n, s.shift) for name, s in slides.items()}

    return build


def sliding(slides: Mapping[str, Slide], plain_rows: int = PLAIN_ROWS) -> list[Builder]:
    """Builders for `framed`: one column for each slide; columns in between start with two underscores and are dropped there."""
    short = {name: s for name, s in slides.items() if s.n <= plain_rows}
    slides = {name: s for name, s in slides.items() if name not in short}
    if not slides:
        return [_plain(short)]
    parts: dict[str, set[str]] = {}
    longest: dict[str, int] = {}
    for s in slides.values():
        parts.setdefault(s.value, {"count"}).update(PARTS[s.kind])
        longest[s.value] = max(longest.get(s.value, 1), s.n)
    builders: list[Builder] = [_plain(short)] if short else []
    builders += [lambda _: {f"__s1_{v}_{p}": _unit(p, F.col(v)) for v, ps in parts.items() for p in sorted(ps)}]
    size = BASE
    while any(n >= size for n in longest.values()):
        below = size // BASE
        builders += _step({f"__s{size}_{v}": (parts[v], [(f"__s{below}_{v}", k * below) for k in range(BASE)]) for v, n in longest.items() if n >= size})
        size *= BASE

    wanted, names = {}, {}
    for name, s in slides.items():
        pieces, left, back = [], s.n, s.shift
        level = BASE ** 20
        while left:
            if level <= left:
                pieces.append((f"__s{level}_{s.value}", back))
                left, back = left - level, back + level
            else:
                level //= BASE
        names[name] = f"__w{s.n}_{s.shift}_{s.value}"
        held = wanted.setdefault(names[name], ({"count"}, pieces))[0]
        held.update(PARTS[s.kind])
    builders += _step(wanted)

    def results(_: WindowSpec) -> dict[str, Column]:
        out = {}
        for name, s in slides.items():
            count, first = F.col(f"{names[name]}_count"), F.col(f"{names[name]}_{PARTS[s.kind][0]}")
            if s.kind == "avg":
                value = F.when(count > 0, first / count)
            elif s.kind == "stddev_samp":
                value = F.when(count > 1, F.sqrt(F.col(f"{names[name]}_square") / (count - 1)))
            else:
                value = F.when(count > 0, first)
            out[name] = value if s.partial else F.when(count == s.n, value)
        return out

    return [*builders, results]
