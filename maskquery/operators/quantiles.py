"""Exact quantiles of a large column by histogram refinement; only bin counts and order statistics reach the driver."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

BINS = 4096
#: Rows among which values are ranked in one task, at most.
SMALL = 100_000


def exact_quantiles(df: DataFrame, col: str, probs: list[float]) -> list[float]:
    """Linearly interpolated quantiles, equal to sorting the column.

    Each wanted order statistic has a range of values that holds it. A pass counts the rows of each range in equal bins and
    narrows the range to the least and greatest value of the right bin, until a range holds one value or few rows; an outlier thus
    costs one more pass. Only the rows of these ranges are ranked.
    """
    v = df.select(F.col(col).cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    n, lo, hi = v.agg(F.count("v"), F.min("v"), F.max("v")).first()
    if not n:
        raise ValueError("no values")
    spots = [p * (n - 1) for p in probs]
    at = {r: (lo, hi, 0, n) for s in spots for r in (math.floor(s), math.ceil(s))}  # range, rows before it, rows in it
    while True:
        spans = sorted({(a, b) for a, b, _, c in at.values() if c > SMALL and (b - a) / BINS > 0})
        if not spans:
            break
        bins = [F.floor((F.col("v") - a) / ((b - a) / BINS)) for a, b in spans]
        rows = v.select("v", _span(spans).alias("s")).where("s IS NOT NULL")
        rows = rows.select("v", "s", F.least(F.coalesce(*[F.when(F.col("s") == i, x) for i, x in enumerate(bins)]), F.lit(BINS - 1)).alias("b"))
        counted: dict[int, list] = {}
        for r in rows.groupBy("s", "b").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect():  # BINS per range
            counted.setdefault(r["s"], []).append(r)
        for r, (a, b, before, _) in list(at.items()):
            if (a, b) in spans:
                for x in sorted(counted[spans.index((a, b))], key=lambda x: x["b"]):
                    if r < before + x["n"]:
                        at[r] = (x["lo"], x["hi"], before, x["n"])
                        break
                    before += x["n"]
    stat = {r: a for r, (a, b, _, _) in at.items() if a == b}
    spans = sorted({(a, b) for a, b, _, _ in at.values() if a < b})
    if spans:
        values = v.select("v", _span(spans).alias("s")).where("s IS NOT NULL").groupBy("s", "v").agg(F.count(F.lit(1)).alias("n"))
        upto = F.sum("n").over(W.partitionBy("s").orderBy("v").rowsBetween(W.unboundedPreceding, 0))
        offset = {x[:2]: x[2] for x in at.values()}
        end = F.coalesce(*[F.when(F.col("s") == i, F.lit(offset[x]).cast("long")) for i, x in enumerate(spans)]) + upto
        wanted = F.array(*[F.lit(r).cast("long") for r, x in at.items() if x[0] < x[1]])
        hits = values.select("s", "v", "n", end.alias("end")).select("v", F.explode(F.filter(wanted, lambda r: (r < F.col("end")) & (r >= F.col("end") - F.col("n")))).alias("r"))
        stat |= {r["r"]: r["v"] for r in hits.collect()}  # two rows per probability at most
    out = []
    for s in spots:
        a, b = stat[math.floor(s)], stat[math.ceil(s)]
        out.append(a + (b - a) * (s - math.floor(s)))
    return out


def _span(spans: list[tuple[float, float]]) -> Column:
    """The number of the range that holds ``v``; ranges are disjoint."""
    return F.coalesce(*[F.when(F.col("v").between(a, b), F.lit(i)) for i, (a, b) in enumerate(spans)])
