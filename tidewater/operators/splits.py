"""Splits, samples and numbering that depend on keys alone, never on the order of rows.

Orders are total: ties are broken by a unique key. Where a number has to run over a whole table, it
is built from per-range counts (``numbered``), so no task holds more than its range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import hash_fraction
from ..functions.tables import written


def hash_split(df: DataFrame, key: str, salt: str = "split", train: float = 0.8, validation: float = 0.12, to: str = "split") -> DataFrame:
    """All rows of a key fall in one split; a null key counts as empty."""
    u = hash_fraction(F.coalesce(F.col(key).cast("string"), F.lit("")), salt)
    return df.withColumn(to, F.when(u < train, "train").when(u < train + validation, "validation").otherwise("test"))


def numbered(df: DataFrame, order: Sequence[str], to: str = "position") -> DataFrame:
    """A running number from 0 over a total order of the whole table, without one task for all rows.

    Rows are range-partitioned and numbered within their partition; that is written once, as the
    ranges come from a sample. The partitions' counts, one number each, are summed on the driver.
    """
    spark = df.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    placed = written(ranged.withColumns({"_part": F.spark_partition_id(), "_in": F.monotonically_increasing_id() % F.lit(1 << 33)}), "numbered")
    before, total = [], 0
    for part, count in sorted((r["_part"], r["count"]) for r in placed.groupBy("_part").count().collect()):
        before.append((part, total))
        total += count
    offsets = spark.createDataFrame(before, "_part int, _before long")
    return placed.join(F.broadcast(offsets), "_part").withColumn(to, F.col("_before") + F.col("_in")).drop("_part", "_in", "_before")


def group_numbers(df: DataFrame, groups: Sequence[str], order: Sequence[str], to: str = "number") -> DataFrame:
    """A running number from 1 in each group, over a total order; ranges of (group, order) are numbered apart, so no task holds a whole group."""
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = df.repartitionByRange(n, *groups, *order).sortWithinPartitions(*groups, *order)
    placed = written(ranged.withColumns({"_part": F.spark_partition_id(), "_in": F.monotonically_increasing_id() % F.lit(1 << 33)}), "group-numbers")
    runs = placed.groupBy("_part", *groups).agg(F.min("_in").alias("_first"), F.count("*").alias("_c"))  # a row for each group, and one more for each range
    earlier = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(F.col("_part").alias("_p"), *(F.col(g).alias(f"_g{k}") for k, g in enumerate(groups)), "_first", F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_before"))
    same = F.col("_part") == F.col("_p")
    for k, g in enumerate(groups):
        same &= placed[g].eqNullSafe(F.col(f"_g{k}"))
    return placed.join(runs, same).select(*df.columns, (F.col("_before") + F.col("_in") - F.col("_first") + 1).alias(to))


def _of_five(position: Column) -> Column:
    return F.when(position % 5 < 3, "train").when(position % 5 == 3, "validation").otherwise("test")


def round_robin(df: DataFrame, order: Sequence[str], to: str = "split") -> DataFrame:
    """Of five rows in order three go to train, one to validation, one to test."""
    return numbered(df, order).withColumn(to, _of_five(F.col("position")))


def pools(df: DataFrame, group: str, order: Sequence[str], to: str = "split") -> DataFrame:
    """Each group dealt out as by ``round_robin``; a group without validation rows lends its first train row there as well, one without test rows its last."""
    rows = group_numbers(df, [group], order, "_n")
    sizes = rows.groupBy(F.col(group).alias("_g")).agg(F.max("_n").alias("_size"))
    rows = rows.join(sizes, rows[group].eqNullSafe(sizes["_g"]))
    own, n, size = _of_five(F.col("_n") - 1), F.col("_n"), F.col("_size")
    lent = [F.when((size < 4) & (n == 1), "validation"), F.when((size < 5) & (n == F.least(size, F.lit(3))), "test")]
    return rows.select(*df.columns, F.explode(F.array_compact(F.array(own, *lent))).alias(to))


def every_nth(df: DataFrame, group: str, order: Sequence[str], step: int, cap: int, to: str = "split") -> DataFrame:
    """Every ``step``-th row of a group goes to validation, ``cap`` at most; the rest to train."""
    n = F.col("_n")
    return group_numbers(df, [group], order, "_n").withColumn(to, F.when((n % step == 0) & (F.floor(n / step) <= cap), "validation").otherwise("train")).drop("_n")


def shuffled(df: DataFrame, key: str, salt: str, to: str = "position") -> DataFrame:
    """All rows numbered in an order that the salt draws: by hash, then key."""
    return numbered(df.withColumn("_h", F.sha2(F.concat(F.lit(salt), F.col(key).cast("string")), 256)), ["_h", key], to).drop("_h")


def heldout_choice(df: DataFrame, group: str) -> DataFrame:
    """The largest group (by count, then name) that holds at most half of all rows: group, n, total."""
    counts = df.groupBy(group).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    # One row against one: the totals of the table.
    return counts.join(F.broadcast(total), F.col("n") * 2 <= F.col("total")).agg(F.max(F.struct("n", group, "total")).alias("top")).select(f"top.{group}", "top.n", "top.total").where(F.col("n").isNotNull())


def stratified_sample(df: DataFrame, strata: Sequence[str], key: str, n: int, salt: str) -> DataFrame:
    """``n`` rows of each stratum, least hash first: a sampling operator."""
    order = [F.sha2(F.concat(F.lit(salt), F.col(key).cast("string")), 256), F.col(key)]
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*strata).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def capped_sample(df: DataFrame, key: str, n: int, salt: str) -> DataFrame:
    """``n`` rows of the table, least hash first: a top-k that each task answers for its own rows."""
    return df.orderBy(F.sha2(F.concat(F.lit(salt), F.col(key).cast("string")), 256), F.col(key)).limit(n)


def prefix_sum_cut(df: DataFrame, group: str, order: Sequence[str], value: str, need: float) -> DataFrame:
    """Rows of each group in order until their sum reaches ``need``; the row that crosses stays."""
    before = F.coalesce(F.sum(value).over(Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn("before", before).where(F.col("before") < need)


def member(values: dict[str, str], key: Column, default: str) -> Column:
    """A dictionary projection as one CASE expression."""
    out = None
    for k, v in values.items():
        out = F.when(key == k, v) if out is None else out.when(key == k, v)
    return out.otherwise(default) if out is not None else F.lit(default)


def plan_grid(df: DataFrame, repeats: Column, to: str = "take") -> DataFrame:
    """Each row as often as ``repeats`` says, numbered from 0; none for 0 or null."""
    return df.withColumn(to, F.explode(F.when(repeats > 0, F.sequence(F.lit(0), repeats.cast("int") - 1)).otherwise(F.array().cast("array<int>"))))


def product(df: DataFrame, models: dict[str, int], to: str = "model", index: str = "take") -> DataFrame:
    """Each row with every model, as often as the model's share says, numbered from 0."""
    each = F.array(*(F.struct(F.lit(m).alias("m"), F.lit(k).alias("k")) for m, k in models.items()))
    rows = df.withColumn("_m", F.explode(each))
    return plan_grid(rows, F.col("_m.k"), index).withColumn(to, F.col("_m.m")).drop("_m")


def shares(n: int, weights: dict[str, float]) -> dict[str, int]:
    """``n`` dealt out in proportion to weights, rounded half to even, one at least for each."""
    total = sum(weights.values())
    return {k: max(1, round(n * w / total)) for k, w in weights.items()}


def difference(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct keys of ``df`` that ``other`` doesn't hold; nulls compare as equal."""
    return df.select(*keys).distinct().join(other.select(*(F.col(k).alias(f"_{k}") for k in keys)), [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left_anti")


def existing(df: DataFrame, path: Column, listing: DataFrame, listed: str = "path") -> DataFrame:
    """The rows whose file is in a listing."""
    return df.join(listing.select(F.col(listed).alias("_path")).distinct(), path == F.col("_path"), "left_semi")


def chosen_blocks(df: DataFrame, name: str, kind: str, only: Sequence[str] = (), positives_only: bool = False, negatives_only: bool = False, positive: str = "positive") -> DataFrame:
    """The blocks of a protocol by their kind (the two flags exclude each other) and, if any are named, by name; an unknown name alone is an error."""
    if positives_only and negatives_only:
        raise ValueError("positives_only and negatives_only exclude each other")
    out = df.where(F.col(kind) == positive) if positives_only else df.where(F.col(kind) != positive) if negatives_only else df
    if only:
        out = out.where(F.col(name).isin(*[b.strip() for b in only]))
        if out.isEmpty():
            raise ValueError(f"no block matches {sorted(only)}")
    return out


def union(parts: Sequence[DataFrame]) -> DataFrame:
    """All rows of all parts, by column name; columns that a part lacks are null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
