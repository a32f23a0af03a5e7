"""Exact order statistics without sorting all values or gathering them.

Each round asks a mergeable sketch for values near the wanted ranks, counts
exactly how many values lie below and at them, and so narrows each rank to an
open interval between two probes, or finds it at one. Probes come from inside
their interval, so every round narrows it; a sketch that is off costs a round,
never the result. An interval of at most ``SMALL`` values is counted by value.
The driver sees probes and counts only, and at the end ``SMALL`` values.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections import defaultdict
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import shared_path

#: Values that may be counted one by one, and the sketch's accuracy.
SMALL, ACCURACY = 50_000, 2_000


def values_of(df: DataFrame, value: Column, name: str = "values") -> DataFrame:
    """The values that are not null, written once as the one column ``x``, as
    each round reads them again."""
    at = shared_path(df.sparkSession, name)
    df.select(value.cast("double").alias("x")).where("x is not null").write.parquet(at)
    return df.sparkSession.read.schema("x double").parquet(at)


def selected(values: DataFrame, ranks: list[int], n: int) -> dict[int, float]:
    """The values at the given ranks (from 0) of the ascending order of ``x``."""
    x, out = F.col("x"), {}
    todo: dict[int, tuple] = {r: (None, None, 0, n) for r in ranks}  # (low, high, values up to low, values below high)
    while todo:
        groups = defaultdict(list)
        for r, interval in todo.items():
            groups[interval].append(r)
        asked = []
        for (low, high, below, upto), own in groups.items():
            inside = F.lit(True) if low is None else x > F.lit(low)
            inside = inside if high is None else inside & (x < F.lit(high))
            if upto - below <= SMALL:
                rows = sorted((v, c) for v, c in values.where(inside).groupBy("x").count().collect())
                ends = list(accumulate((c for _, c in rows), initial=below))[1:]
                for r in own:
                    out[r] = rows[bisect_right(ends, r)][0]
                    del todo[r]
                continue
            size = upto - below
            near = {min(max((r - below + d * size * 2 / ACCURACY) / size, 0.0), 1.0) for r in own for d in (-1, 0, 1)}
            asked.append(F.percentile_approx(F.when(inside, x), F.array(*map(F.lit, sorted(near))), ACCURACY))
        if not todo:
            break
        probes = sorted({p for found in values.agg(*(a.alias(f"a{i}") for i, a in enumerate(asked))).first() for p in found or ()})
        counts = values.agg(*(c.alias(f"c{i}{k}") for i, p in enumerate(probes) for k, c in (("l", F.count_if(x < F.lit(p))), ("u", F.count_if(x <= F.lit(p)))))).first()
        known = list(zip(probes, counts[::2], counts[1::2], strict=True))
        for r, (low, high, below, upto) in list(todo.items()):
            for p, less, most in known:
                if less <= r < most:
                    out[r] = p
                    del todo[r]
                    break
                if most <= r and (low is None or p > low):
                    low, below = p, most
                elif less > r and (high is None or p < high):
                    high, upto = p, less
            else:
                todo[r] = low, high, below, upto
    return out


def quantiles(values: DataFrame, fractions: list[float], between: bool = True) -> list[float | None]:
    """The values at ``fraction * (n - 1)`` of the order: between two neighbours
    by interpolation, or else the lower one; None where there is no value."""
    n = values.count()
    if not n:
        return [None] * len(fractions)
    places = [f * (n - 1) for f in fractions]
    found = selected(values, sorted({g(p) for p in places for g in (math.floor, math.ceil)}), n)
    out = []
    for p in places:
        a, b = found[math.floor(p)], found[math.ceil(p)]
        out.append(a + (p - math.floor(p)) * (b - a) if between and a != b else a)
    return out
