"""Running values over runs of any length.

Rows are dealt into sorted ranges of (key, order), so a run that no task could hold lies in consecutive partitions.
Each partition folds its own part of a run; what the parts before it add up to is one small row for each run and
partition, and is carried in by a join. No window or array holds a whole run.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.session import saved


@dataclass(frozen=True)
class Fold:
    """A running value of a column: sum, xor, min, max or last (the last value that is not null)."""

    kind: str
    column: Column | str

    def over(self, c: Column) -> Column:
        return {"sum": F.sum, "xor": F.bit_xor, "min": F.min, "max": F.max, "last": lambda x: F.last(x, ignorenulls=True)}[self.kind](c)

    def joined(self, before: Column, now: Column) -> Column:
        if self.kind == "sum":
            return F.coalesce(before + now, now, before)
        if self.kind == "xor":
            return F.coalesce(before.bitwiseXOR(now), now, before)
        if self.kind == "last":
            return F.coalesce(now, before)
        return {"min": F.least, "max": F.greatest}[self.kind](before, now)


def ranged(df: DataFrame, keys: list[Column], partitions: int | None = None) -> DataFrame:
    """``df`` saved in sorted ranges of keys, with ``__part`` and ``__row`` (the place in the part). Rows equal in
    all keys may lie in several parts."""
    n = partitions or max(df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    tie = F.col("__tie")
    out = df.withColumn("__tie", F.monotonically_increasing_id())
    out = out.repartitionByRange(n, *keys, tie).sortWithinPartitions(*keys, tie)
    place = F.monotonically_increasing_id()
    return saved(out.withColumn("__part", F.shiftright(place, 33)).withColumn("__row", place.bitwiseAND(F.lit((1 << 33) - 1))).drop("__tie"), "ranged")


def numbered(df: DataFrame, keys: list[Column], name: str = "number", partitions: int | None = None) -> DataFrame:
    """``df`` with a gapless number from 0 in the order of keys. The driver holds one number for each partition."""
    rows = ranged(df, keys, partitions)
    counts = sorted((r[0], r[1]) for r in rows.groupBy("__part").count().collect())
    starts, at = [], 0
    for part, n in counts:
        starts.append((part, at))
        at += n
    first = df.sparkSession.createDataFrame(starts, "__part long, __first long")
    return rows.join(F.broadcast(first), "__part").withColumn(name, F.col("__first") + F.col("__row")).drop("__part", "__row", "__first")


def running(df: DataFrame, key: list[str], order: list[Column], folds: dict[str, Fold], partitions: int | None = None) -> DataFrame:
    """``df`` with each fold's running value, this row included, over the rows of one key in order.

    Null keys make a run of their own; rows that tie in the order are taken in any order; an empty table gives no rows.
    """
    rows = ranged(df.withColumns({f"__in_{n}": F.col(f.column) if isinstance(f.column, str) else f.column for n, f in folds.items()}), [*(F.col(k).asc_nulls_first() for k in key), *order], partitions)
    within = Window.partitionBy("__part", *key).orderBy("__row").rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumns({f"__own_{n}": f.over(F.col(f"__in_{n}")).over(within) for n, f in folds.items()})
    first_row = {n: F.col(f"__in_{n}") for n in folds}
    totals = rows.groupBy("__part", *key).agg(*(f.over(first_row[n]).alias(f"__sum_{n}") if f.kind != "last" else F.max_by(first_row[n], F.when(first_row[n].isNotNull(), F.col("__row"))).alias(f"__sum_{n}") for n, f in folds.items()))
    # A run has one row for each partition that it spans.
    before = Window.partitionBy(*key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select("__part", *key, *(f.over(F.col(f"__sum_{n}")).over(before).alias(f"__before_{n}") for n, f in folds.items()))
    carried = carried.where(" OR ".join(f"__before_{n} IS NOT NULL" for n in folds)).withColumnsRenamed({k: f"__key_{k}" for k in key}).withColumnRenamed("__part", "__at")
    same = (F.col("__part") == F.col("__at"))
    for k in key:
        same &= F.col(k).eqNullSafe(F.col(f"__key_{k}"))
    out = local.join(carried, same, "left")
    return out.withColumns({n: f.joined(F.col(f"__before_{n}"), F.col(f"__own_{n}")) for n, f in folds.items()}).select(*df.columns, *folds)
