"""Exact medians and percentiles, with no group's values in one task.

Spark's own functions send a map of a group's values from every task to one. Here values are counted by group and
value; up to SPLITS values of a group, chosen by hash, cut it into ranges, and only the values of the ranges in which
the asked ranks lie are sorted. Ranges are met by their bounds and counts are exact, so the choice of the values that
cut decides how even the ranges are, not the result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Values that cut a group, at most; 2 ** 8 - 1 are found in eight steps of a binary search.
SPLITS = 255
#: Groups with fewer chosen values (about a thousand different ones) are not cut.
LARGE = 250
#: Parts over which a group is dealt in joins, a power of two.
SALTS = 16

_PLACE = f"aggregate(array({', '.join(str(2**i) for i in range(7, -1, -1))}), 0, (b, h) -> if(b + h <= size(__s) and get(__s, b + h - 1) <= __v, b + h, b))"


def aggregated(rows: DataFrame, by: list[Column], names: list[str], aggregates: list[Column], wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """GROUP BY: the columns `by` under their names, aggregates, and quantiles {name: (SQL of the values, fraction)}."""
    keys = [c.alias(n) for c, n in zip(by, names, strict=True)]
    found = [quantiles(rows, by, x, {n: p for n, (y, p) in wanted.items() if x == y}) for x in dict.fromkeys(x for x, _ in wanted.values())]
    if not by:
        frames = [rows.agg(*aggregates)] if aggregates or not found else []
        return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), [*frames, *found])  # one row each
    out = rows.groupBy(*keys).agg(*aggregates) if aggregates else rows.select(*keys).distinct()
    for f in found:
        out = out.join(f, _same([F.col(f"`{n}`") for n in names], "__k"), "left").drop(*[f"__k{i}" for i in range(len(by))])
    return out


def with_quantiles(rows: DataFrame, by: list[Column], wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """The rows, each with its group's quantiles."""
    given = rows
    for x in dict.fromkeys(x for x, _ in wanted.values()):
        found = quantiles(given, by, x, {n: p for n, (y, p) in wanted.items() if x == y})
        if not by:
            rows = rows.crossJoin(F.broadcast(found))  # one row
            continue
        on = _same(by, "__k") & (_salt(F.expr(x)) == F.col("__part"))
        rows = rows.join(_dealt(found), on, "left").drop(*[f"__k{i}" for i in range(len(by))], "__part")
    return rows


def quantiles(rows: DataFrame, by: list[Column], x: str, fractions: dict[str, float]) -> DataFrame:
    """__k0, __k1, ... and each fraction's quantile, interpolated; one row for every group with a value, or one at all without `by`."""
    keys = [f"__k{i}" for i in range(len(by))]
    groups = [c.alias(k) for c, k in zip(by, keys, strict=True)]
    if not isinstance(rows.select(F.expr(x)).schema[0].dataType, (T.NumericType, T.StringType)):  # intervals
        return rows.groupBy(*groups).agg(*[F.percentile(F.expr(x), F.lit(p)).alias(n) for n, p in fractions.items()])
    values = rows.select(*groups, F.expr(x).cast("double").alias("__v")).where("__v is not null")
    # with its count in every use, the table is the same one to Spark, and is made once
    counts = values.groupBy(*keys, "__v").agg(F.count(F.lit(1)).alias("__n")).where("__n > 0").withColumn("__salt", _salt(F.col("__v")))

    def met(right: DataFrame, how: str = "inner") -> DataFrame:
        """The counts, joined with a table by group."""
        right = _dealt(right.withColumnsRenamed({k: f"__r{k}" for k in keys}))
        return counts.join(right, _same([F.col(k) for k in keys], "__r__k") & (F.col("__salt") == F.col("__part")), how)

    one = counts.groupBy(*keys, F.pmod(F.xxhash64("__v"), F.lit(SPLITS)).alias("__class")).agg(F.min_by("__v", F.xxhash64("__v")).alias("__v"))
    splits = one.groupBy(*keys).agg(F.sort_array(F.collect_list("__v")).alias("__s")).where(F.size("__s") >= LARGE)
    placed = met(splits).select(*keys, "__n", "__s", F.expr(_PLACE).alias("__b")).select(*keys, "__n", "__b", F.expr("get(__s, __b - 1)").alias("__lo"), F.expr("get(__s, __b)").alias("__hi"))
    sums = placed.groupBy(*keys, "__b").agg(F.sum("__n").alias("__n"), F.min("__lo").alias("__lo"), F.min("__hi").alias("__hi"))
    group = Window.partitionBy(*keys)
    sums = sums.withColumn("__total", F.sum("__n").over(group)).withColumn("__upto", F.sum("__n").over(group.orderBy("__b").rowsBetween(Window.unboundedPreceding, 0)))
    sums = sums.select(*keys, "__lo", "__hi", "__total", "__upto", (F.col("__upto") - F.col("__n")).alias("__from"))
    at = {n: (F.col("__total") - 1) * F.lit(float(p)) for n, p in fractions.items()}
    holds = lambda rank: (F.col("__from") <= rank) & (rank < F.col("__upto"))
    chosen = sums.where(reduce(Column.__or__, [holds(r(a)) for a in at.values() for r in (F.floor, F.ceil)])).drop("__upto")
    inside = met(chosen).where("(__lo is null or __v >= __lo) and (__hi is null or __v < __hi)").select(*keys, "__v", "__n", "__total", "__from")
    inside = inside.unionAll(met(splits, "left_anti").select(*keys, "__v", "__n", F.lit(None).cast("long"), F.lit(0).cast("long")))
    part = Window.partitionBy(*keys, "__from")
    upto = F.col("__from") + F.sum("__n").over(part.orderBy("__v").rowsBetween(Window.unboundedPreceding, 0))
    inside = inside.select(*keys, "__v", F.coalesce("__total", F.sum("__n").over(part)).alias("__total"), upto.alias("__upto"), (upto - F.col("__n")).alias("__from"))
    ends = [F.max(F.when(holds(r(a)), F.col("__v"))).alias(f"__{r.__name__}{i}") for i, a in enumerate(at.values()) for r in (F.floor, F.ceil)]
    out = inside.groupBy(*keys).agg(F.max("__total").alias("__total"), *ends)
    named = []
    for i, (n, a) in enumerate(at.items()):
        low, high = F.col(f"__floor{i}"), F.col(f"__ceil{i}")
        named.append(F.when(low == high, low).otherwise((F.ceil(a) - a) * low + (a - F.floor(a)) * high).alias(n))
    return out.select(*keys, *named)


def _same(left: list[Column], prefix: str) -> Column:
    return reduce(Column.__and__, [c.eqNullSafe(F.col(f"{prefix}{i}")) for i, c in enumerate(left)], F.lit(True))


def _salt(x: Column) -> Column:
    return F.xxhash64(x).bitwiseAND(F.lit(SALTS - 1))  # not null to Spark, so joins add no filter


def _dealt(df: DataFrame) -> DataFrame:
    """Every row once for each part, so that no group is joined in one task."""
    return df.withColumn("__part", F.expr(f"explode(sequence(0, {SALTS - 1}))"))
