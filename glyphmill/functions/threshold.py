"""How many of the largest values matter: cuts of a descending sequence, as array expressions and as grouped plans.

The array forms take a sorted descending array<double>; the grouped forms take rows with a group, a rank from 1 and a
value, and never gather a group in one place beyond Spark's own window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
MIN_GAP, EPSILON, ELBOW, MEDIAN_FACTOR, FLAT = 1.5, 1e-10, 0.01, 2.2, 1e-12


def _d(x: float) -> Column:
    return F.lit(float(x))


def _cap(values: Column, most: int | None) -> Column:
    n = F.size(values)
    return n if most is None else F.least(F.lit(max(most, 1)), n)


def effective_count(values: Column) -> Column:
    """The number of equal values that would have the entropy of these positive ones."""
    total = F.aggregate(values, _d(0), lambda s, v: s + v)
    plain = F.aggregate(values, _d(0), lambda s, v: s - v * F.ln(v))
    return F.exp(F.ln(total) + plain / total)


def entropy_count(values: Column, most: int | None = None) -> Column:
    """The number of equal values that would have the entropy of the positive head, rounded up."""
    tail = F.array_position(F.transform(values, lambda v: (v > 0).cast("int")), 0)
    head = F.when(tail == 0, F.size(values)).otherwise(tail - 1).cast("int")
    head = F.least(head, _cap(values, most))
    effective = effective_count(F.slice(values, 1, head))
    return F.when(head <= 0, 0).otherwise(F.when(effective > 1, F.least(F.ceil(effective).cast("int"), head)).otherwise(1))


def gap_count(values: Column, gap: float = MIN_GAP, eps: float = EPSILON, most: int | None = None) -> Column:
    """Values before the steepest fall of at least the given ratio; the earliest of equals. A fall to zero or less is infinite."""
    n, cap = F.size(values), _cap(values, most)
    eps = eps if eps >= 0 else 0.0
    # places after which nothing more is looked at: the first value not above eps, or the first fall to zero
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(cap - 1, F.lit(1))), lambda i: F.struct(i.alias("i"), F.get(values, i - 1).alias("a"), F.coalesce(F.get(values, i), _d(0)).alias("b")))
    pairs = F.filter(pairs, lambda p: p["i"] < cap)
    zero = F.struct(F.lit(False).alias("over"), _d(0).alias("best"), cap.alias("at"), F.lit(1).alias("end"))

    def step(s: Column, p: Column) -> Column:
        stop = s["over"] | ~(p["a"] > eps)
        ratio = F.when(p["b"] > 0, p["a"] / F.when(p["b"] > 0, p["b"]).otherwise(_d(1))).otherwise(_d(float("inf")))
        better = ratio > s["best"]
        new = F.struct((p["b"] <= 0).alias("over"), F.when(better, ratio).otherwise(s["best"]).alias("best"), F.when(better & (ratio >= gap), p["i"]).otherwise(s["at"]).alias("at"), (p["i"] + 1).alias("end"))
        return F.when(stop, F.struct(F.lit(True).alias("over"), s["best"].alias("best"), s["at"].alias("at"), s["end"].alias("end"))).otherwise(new)

    result = F.aggregate(pairs, zero, step, lambda s: F.greatest(F.least(s["at"], s["end"]), F.lit(1)))
    return F.when(n < 2, n).otherwise(result)


def elbow_count(values: Column, significance: float = ELBOW) -> Column:
    """Values before the point that lies deepest below the line from first to last; all if none is deep enough."""
    n = F.size(values)
    first, last = F.get(values, F.lit(0)), F.get(values, n - 1)
    half = F.floor(n / 2).cast("int")
    median = F.when(n % 2 == 1, F.get(values, half)).otherwise(_d(0.5) * (F.get(values, half - 1) + F.get(values, half)))
    depth = F.transform(values, lambda v, i: F.when((i > 0) & (i < n - 1), first + (i / F.greatest(n - 1, F.lit(1))) * (last - first) - v).otherwise(_d(0)))
    best = F.array_max(depth)
    at = F.array_position(depth, best) - 1
    found = (best > 0) & (best >= significance * median)
    return F.when((n < 3) | ~((first - last) > FLAT) | ~found, n).otherwise(at).cast("int")


def median_count(values: Column, factor: float = MEDIAN_FACTOR) -> Column:
    """The values that make up half of the sum, times a factor."""
    n = F.size(values)
    total = F.aggregate(values, _d(0), lambda s, v: s + v)
    zero = F.struct(_d(0).alias("sum"), F.lit(0).alias("k"), F.lit(0).alias("at"))

    def step(s: Column, v: Column) -> Column:
        now = s["sum"] + v
        return F.struct(now.alias("sum"), (s["k"] + 1).alias("k"), F.when((s["at"] == 0) & (now >= total * 0.5), s["k"] + 1).otherwise(s["at"]).alias("at"))

    middle = F.aggregate(values, zero, step, lambda s: F.when(s["at"] == 0, n).otherwise(s["at"]))
    scaled = F.ceil(factor * middle).cast("int")
    return F.when(n == 0, 0).when(~(total > 0), n).otherwise(F.greatest(F.least(scaled, n), F.lit(1)))


def prune_count(values: Column, significance: float = ELBOW, factor: float = MEDIAN_FACTOR) -> Column:
    """The elbow if there is one, else the scaled median."""
    elbow = elbow_count(values, significance)
    return F.when(elbow < F.size(values), elbow).otherwise(median_count(values, factor))


def prune_threshold(values: Column, significance: float = ELBOW, factor: float = MEDIAN_FACTOR) -> Column:
    """The first value left out; 0 if none is."""
    return F.coalesce(F.get(values, prune_count(values, significance, factor)), _d(0))


def grouped_cuts(rows: DataFrame, group: list[str], value: str, significance: float = ELBOW, factor: float = MEDIAN_FACTOR) -> DataFrame:
    """Rows (group, k, at, need, run): the prune count k of each group, the value at which the cut falls, and how many
    of the run of equal values there are kept.

    The rows are folded into one count for each distinct value; only those counts are put in order. Within a run of
    equal values the elbow can only lie at its first place, and the sum grows evenly, so nothing is lost. Null values
    are not allowed; an empty table gives no rows.
    """
    v, c = F.col("__v"), F.col("__c")
    runs = rows.groupBy(*group, F.col(value).cast("double").alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
    every = Window.partitionBy(*group)
    down = every.orderBy(F.desc("__v"))
    x = runs.select(
        *group, "__v", "__c", (F.sum("__c").over(down) - c).alias("before"), (F.sum(v * c).over(down) - v * c).alias("cum"),
        F.sum("__c").over(every).alias("n"), F.sum(v * c).over(every).alias("total"), F.max("__v").over(every).alias("first"), F.min("__v").over(every).alias("last"),
    )
    n, before = F.col("n"), F.col("before")
    i = F.when(before > 0, before).when(c > 1, F.lit(1))
    depth = F.when(i < n - 1, F.col("first") + (i / F.greatest(n - 1, F.lit(1))) * (F.col("last") - F.col("first")) - v)
    holds = lambda k: (before <= k) & (k < before + c)
    half = F.floor(n / 2)
    middle = F.when(n % 2 == 1, F.when(holds(half), v).otherwise(0.0)).otherwise(F.when(holds(half - 1), 0.5 * v).otherwise(0.0) + F.when(holds(half), 0.5 * v).otherwise(0.0))
    need = 0.5 * F.col("total") - F.col("cum")
    reaches = F.when((v > 0) & (need <= v * c), before + F.greatest(F.ceil(need / F.when(v > 0, v)), F.lit(1)))
    agg = x.groupBy(*group).agg(
        F.first("n").alias("n"), F.first("total").alias("total"), F.first("first").alias("first"), F.first("last").alias("last"),
        F.max(F.when(depth.isNotNull(), F.struct(depth.alias("d"), (-i).alias("i")))).alias("deep"), F.sum(middle).alias("median"), F.min(reaches).alias("mm"),
    )
    deep = F.col("deep.d")
    bent = (n >= 3) & ((F.col("first") - F.col("last")) > FLAT) & (deep > 0) & (deep >= significance * F.col("median"))
    scaled = F.when(~(F.col("total") > 0), n).otherwise(F.greatest(F.least(F.ceil(factor * F.coalesce("mm", "n")), n), F.lit(1)))
    k = agg.select(*group, F.when(F.coalesce(bent, F.lit(False)), -F.col("deep.i")).otherwise(scaled).cast("long").alias("k"))
    at = x.select(*group, "__v", "__c", "before").join(k, group).where((before < F.col("k")) & (F.col("k") <= before + c))
    return at.select(*group, "k", v.alias("at"), (F.col("k") - before).alias("need"), c.alias("run"))
