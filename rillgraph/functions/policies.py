"""Edge aggregates and edge weights, as columns and as the same rules in Python for the contraction kernel.

An edge has an affinity, a multiplicity (how many contacts it stands for) and, if its policy asks for one, a histogram of the
contacts' affinities. An aggregate merges parallel edges; a weight ranks edges for contraction, small ones first.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def bin_of(aff: Column, bins: int, low: float = 0.0, high: float = 1.0) -> Column:
    """Histogram bin of an affinity; the range's upper end belongs to the last bin."""
    width = (high - low) / bins
    return F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((aff - F.lit(low)) / F.lit(width)).cast("int")))


def hist_median(hist: Column, count: Column, low: float, width: float) -> Column:
    """Median from a histogram: linear inside the first bin by which more than half of the contacts are counted; null if empty."""
    zero = F.struct(F.lit(0).cast("long").alias("before"), F.lit(None).cast("double").alias("median"), F.lit(0).alias("i"))

    def step(acc: Column, n: Column) -> Column:
        here = (2 * (acc["before"] + n) > count) & acc["median"].isNull()
        median = F.lit(float(low)) + acc["i"] * F.lit(float(width)) + (count / 2 - acc["before"]) / F.nullif(n, F.lit(0)) * F.lit(float(width))
        return F.struct((acc["before"] + n).alias("before"), F.when(here, median).otherwise(acc["median"]).alias("median"), (acc["i"] + 1).alias("i"))

    return F.aggregate(hist, zero, step, lambda acc: acc["median"])


def py_hist_median(hist: list[int], low: float, width: float) -> float:
    count, before = sum(hist), 0
    for i, n in enumerate(hist):
        if 2 * (before + n) > count:
            return low + i * width + (count / 2 - before) / n * width
        before += n
    return math.nan


#: Merging parallel edges: name -> (affinity of the merged edge as an aggregate column, the same for two edges in Python).
MERGERS: dict[str, tuple[Callable[[], Column], Callable[[float, float, float, float], float]]] = {
    "max": (lambda: F.max("affinity"), lambda a, m, b, n: max(a, b)),
    "min": (lambda: F.min("affinity"), lambda a, m, b, n: min(a, b)),
    "avg": (lambda: F.sum(F.col("affinity") * F.col("multiplicity")) / F.sum("multiplicity"), lambda a, m, b, n: (a * m + b * n) / (m + n)),
    "hist": (lambda: F.max("affinity"), lambda a, m, b, n: max(a, b)),
}


@dataclass(frozen=True)
class Policy:
    """How edges are merged and weighed. ``weight`` gets affinity, two counts, and the histogram's median where there is one."""

    name: str
    merger: str
    weight: Callable[[Column, Column, Column, Column], Column]
    py_weight: Callable[[float, float, float, float], float]
    bins: int = 0


POLICIES = {
    p.name: p
    for p in (
        *(Policy(f"aff_only_{m}", m, lambda a, c, d, h: 1 - a, lambda a, c, d, h: 1 - a) for m in ("min", "max", "avg")),
        Policy("funky", "max", lambda a, c, d, h: F.least(c, d) * (1 - a), lambda a, c, d, h: min(c, d) * (1 - a)),
        Policy("funky_squared", "max", lambda a, c, d, h: F.least(c, d) * (1 - a) * (1 - a), lambda a, c, d, h: min(c, d) * (1 - a) * (1 - a)),
        Policy("log_count", "max", lambda a, c, d, h: (1 - a) * F.log10(1 + F.least(c, d)), lambda a, c, d, h: (1 - a) * math.log10(1 + min(c, d))),
        Policy("aff_median", "hist", lambda a, c, d, h: 1 - h, lambda a, c, d, h: 1 - h, 100),
        Policy("aff_median_log_count", "hist", lambda a, c, d, h: F.log10(1 + (1 - h) * F.greatest(c, d)), lambda a, c, d, h: math.log10(1 + (1 - h) * max(c, d)), 100),
    )
}
