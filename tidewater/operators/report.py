"""Distribution reports: shares, crosstabs, distinct entities, four kinds of quantile, histograms."""

from __future__ import annotations

import functools
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import written


def share_by(df: DataFrame, key: str) -> DataFrame:
    """key, n, share of all rows; null keys are a group of their own."""
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).select(key, "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


def crosstab(df: DataFrame, row: str, rows: Sequence[str], column: str, columns: Sequence[str]) -> DataFrame:
    """Counts of every listed row and column, 0 where there is none."""
    spark = df.sparkSession
    grid = spark.createDataFrame([(r, c) for r in rows for c in columns], f"`{row}` string, `{column}` string")
    counts = df.groupBy(row, column).agg(F.count("*").alias("n"))
    return grid.join(counts, [row, column], "left").select(row, column, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def pair_counts(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.groupBy(a, b).agg(F.count("*").alias("n"))


def distinct_entities(df: DataFrame, entity: str, condition: str, tuple_of: Sequence[str]) -> DataFrame:
    """One row: distinct entities, those of rows under a condition, and distinct tuples (null as empty)."""
    together = F.struct(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in tuple_of))
    return df.agg(F.count_distinct(entity).alias("n_all"), F.count_distinct(F.when(F.expr(condition), F.col(entity))).alias("n_where"), F.count_distinct(together).alias("n_tuples"))


def ranked(df: DataFrame, group: str, value: str, weight: str | None = None) -> DataFrame:
    """Distinct non-null values by group: v, the ranks below and up to it (below, upto, from 0), and the group's size n; a row counts ``weight`` times.

    Equal values are counted first. The distinct ones are numbered over ranges of (group, value), and running
    counts are summed within a range and over the ranges before it, so no task holds a whole group.
    """
    times = F.sum(weight) if weight else F.count("*")
    counts = df.where(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(F.col(group), F.col(value).alias("v")).agg(times.alias("c"))
    spark = df.sparkSession
    ranged = counts.repartitionByRange(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), group, "v").withColumn("_part", F.spark_partition_id())
    placed = written(ranged, "ranked")
    own = placed.withColumn("_own", F.sum("c").over(Window.partitionBy("_part", group).orderBy("v")))
    parts = placed.groupBy(group, "_part").agg(F.sum("c").alias("_c"))
    earlier = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(group, "_part", F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_before"), F.sum("_c").over(Window.partitionBy(group)).alias("n"))
    at = own.join(parts, [group, "_part"])
    return at.select(group, "v", (F.col("_before") + F.col("_own") - F.col("c")).alias("below"), (F.col("_before") + F.col("_own")).alias("upto"), "n")


def _at(place: Column) -> Column:
    """The value whose ranks hold a place."""
    return F.max(F.when((F.col("below") <= place) & (place < F.col("upto")), F.col("v")))


def quantile_nearest_rank(df: DataFrame, group: str, value: str, probabilities: Sequence[float], weight: str | None = None) -> DataFrame:
    """By group: n, min, max and the value at place min(n - 1, int(p * n)) of each probability."""
    places = ranked(df, group, value, weight)
    picks = [_at(F.least(F.col("n") - 1, F.floor(F.lit(p) * F.col("n")))).alias(f"p{round(p * 100)}") for p in probabilities]
    return places.groupBy(group).agg(F.max("n").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), *picks)


def quantile_linear(df: DataFrame, group: str, value: str, probabilities: Sequence[float]) -> DataFrame:
    """By group the quantiles that lie between the values at places floor and ceiling of p * (n - 1)."""
    places = ranked(df, group, value)
    place = lambda p: F.lit(p) * (F.col("n") - 1)
    ends = [x.alias(f"_{side}{k}") for k, p in enumerate(probabilities) for side, x in (("a", _at(F.floor(place(p)))), ("b", _at(F.ceil(place(p)))))]
    got = places.groupBy(group).agg(F.max("n").alias("n"), *ends)
    out = [F.round(F.col(f"_a{k}") + (F.col(f"_b{k}") - F.col(f"_a{k}")) * (place(p) - F.floor(place(p))), 6).alias(f"p{round(p * 100)}") for k, p in enumerate(probabilities)]
    return got.select(group, *out)


def upper_median(df: DataFrame, group: str, value: str) -> DataFrame:
    """The value at place n // 2: the upper of the two middle ones."""
    places = ranked(df, group, value)
    return places.groupBy(group).agg(_at(F.floor(F.col("n") / 2)).alias("upper_median"))


def fixed_histogram(df: DataFrame, value: str, low: float, width: float, bins: int) -> DataFrame:
    """bin, n for every bin; values outside go to the first and the last."""
    spot = F.least(F.greatest(F.floor((F.col(value) - low) / width), F.lit(0)), F.lit(bins - 1)).cast("int")
    counts = df.where(F.col(value).isNotNull()).groupBy(spot.alias("bin")).agg(F.count("*").alias("n"))
    grid = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return grid.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def class_weights(df: DataFrame, key: str, boosted: str, boost: float, classes: Sequence[str]) -> DataFrame:
    """Inverse-frequency weights total / (classes * n) of the listed classes, times ``boost`` for one; a class without rows counts as one row."""
    listed = df.sparkSession.createDataFrame([(c,) for c in classes], f"`{key}` string")
    counts = listed.join(df.groupBy(key).agg(F.count("*").alias("n")), key, "left").select(key, F.greatest(F.coalesce("n", F.lit(0)), F.lit(1)).cast("long").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    weight = F.col("total") / (F.lit(len(classes)) * F.col("n")) * F.when(F.col(key) == boosted, boost).otherwise(1.0)
    return counts.join(F.broadcast(total)).select(key, "n", F.round(weight, 6).alias("weight"))


def top_values(df: DataFrame, key: str, k: int) -> DataFrame:
    """The ``k`` most frequent values, ties by value: a top-k report."""
    return df.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc(key)).limit(k)


def summary(df: DataFrame, group: str, value: str, bound: float) -> DataFrame:
    """min, mean, max, root mean square and whether any value reaches a bound, by group."""
    return df.groupBy(group).agg(F.min(value).alias("low"), F.round(F.avg(value), 6).alias("mean"), F.max(value).alias("high"), F.round(F.sqrt(F.avg(F.col(value) * F.col(value))), 6).alias("rms"), F.bool_or(F.abs(value) >= bound).alias("clipped"))


def gaps_to_target(df: DataFrame, key: str, targets: dict[str, int]) -> DataFrame:
    """key, have, want, missing = max(0, want - have) for every target."""
    want = df.sparkSession.createDataFrame(list(targets.items()), f"`{key}` string, want long")
    have = df.groupBy(key).agg(F.count("*").alias("have"))
    return want.join(have, key, "left").select(key, F.coalesce("have", F.lit(0)).alias("have"), "want", F.greatest(F.lit(0), F.col("want") - F.coalesce("have", F.lit(0))).alias("missing"))


def weighted_rank(df: DataFrame, key: str, weights: dict[str, float]) -> DataFrame:
    """key, total (the weighted sum of its criteria) and its rank, the best first; ties share a rank. For a table of candidates, not of records."""
    total = sum((F.coalesce(F.col(c), F.lit(0)) * w for c, w in weights.items()), F.lit(0.0))
    scored = df.select(key, F.round(total, 6).alias("total"))
    better = scored.select(F.col("total").alias("_t")).groupBy("_t").agg(F.count("*").alias("_n"))
    places = better.withColumn("rank", F.coalesce(F.sum("_n").over(Window.orderBy(F.desc("_t")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + 1)
    return scored.join(places, scored["total"] == places["_t"]).select(key, "total", "rank")


def single_value(df: DataFrame, column: str) -> DataFrame:
    """The one value that the column holds; the query fails where there is another number of them."""
    n = df.agg(F.count_distinct(column).alias("n"), F.min(column).alias(column))
    return n.select(F.when(F.assert_true(F.col("n") == 1, F.lit(f"{column} doesn't hold one value")).isNull(), F.col(column)).alias(column))


def sliding_counts(df: DataFrame, key: str, ts: str, length: str, slide: str) -> DataFrame:
    """key, window start, n: overlapping windows of event time; the same expression serves a stream."""
    return df.groupBy(key, F.window(ts, length, slide)).agg(F.count("*").alias("n")).select(key, F.col("window.start").alias("start"), "n")


def blocks(parts: dict[str, DataFrame]) -> DataFrame:
    """One report of many blocks: block, key (the text of all a row's columns but the last), value (the last, as text)."""
    out = None
    for name, df in parts.items():
        *keys, last = df.columns
        one = df.select(F.lit(name).alias("block"), F.concat_ws("|", *(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys)).alias("key"), F.col(last).cast("string").alias("value"))
        out = one if out is None else out.unionByName(one)
    return out


@dataclass(frozen=True)
class Roles:
    """The columns of a manifest that a report reads; ``positive`` and ``synthetic`` are booleans, ``levels`` and ``onset`` numbers."""

    cls: str
    target: str
    split: str
    positive: str
    synthetic: str
    source_type: str
    voice: str
    speaker: str
    corpus: str
    license: str
    augmentation: str
    onset: str
    content: str
    levels: Sequence[str]
    keyword: str = "keyword"
    plain: Sequence[str] = ("none", "mic_band")


def qa_report(df: DataFrame, r: Roles, splits: Sequence[str] = ("train", "validation", "test"), top: int = 10) -> DataFrame:
    """block, key, value: the whole report on a dataset, in eleven blocks, from one scan of its rows.

    Every row is counted under all of its groupings at once (what GROUPING SETS does, with one key column); the blocks
    are worked out from those counts, quantiles and leakage too. Null and empty names are no voice and no speaker.
    """
    c = F.col
    named = lambda x: F.coalesce(c(x).cast("string"), F.lit(""))
    none, no_value = F.lit("").cast("string"), F.lit(None).cast("double")
    positive, synthetic = (F.coalesce(c(x).cast("boolean"), F.lit(False)) for x in (r.positive, r.synthetic))
    group = lambda name, a=none, b=none, x=no_value, when=F.lit(True): F.when(when, F.struct(F.lit(name).alias("g"), a.alias("a"), b.alias("b"), x.alias("x")))
    number = lambda x: F.nanvl(c(x).cast("double"), no_value)
    groups = [
        group("clips"), group("class", named(r.cls)), group("target", named(r.target)), group("split", named(r.split), named(r.cls)), group("synthetic", synthetic.cast("string")),
        group("source type", named(r.source_type)), group("voice", named(r.voice), when=named(r.voice) != ""), group("speaker", named(r.speaker), when=named(r.speaker) != ""),
        group("licence", named(r.corpus), named(r.license)), group("augmentation", named(r.augmentation)), group("content", named(r.content)),
        *(group("level", F.lit(x), x=number(x), when=number(x).isNotNull()) for x in r.levels), group("onset", x=number(r.onset), when=positive & number(r.onset).isNotNull()),
    ]
    test = named(r.split) == "test"
    facts = {"positives": positive, "real_positives": positive & ~synthetic, "test": test, "test_positives": test & positive, "synthetic_test": test & synthetic, "synthetic_positives_test": test & synthetic & positive, "augmented_test": test & ~named(r.augmentation).isin("", *r.plain)}
    rows = df.select(named(r.split).alias("split"), *(x.alias(k) for k, x in facts.items()), F.explode(F.array_compact(F.array(*groups))).alias("k"))
    counts = rows.groupBy("k").agg(F.count("*").alias("n"), *(F.count_if(k).alias(k) for k in facts), F.min("split").alias("first"), F.max("split").alias("last"))
    g = written(counts.select("k.*", *(x for x in counts.columns if x != "k")), "report")
    of = lambda name: g.where(c("g") == name)
    text = lambda x: x.cast("string")
    row = lambda block, key, value: F.struct(F.lit(block).alias("block"), key.alias("key"), text(value).alias("value"))

    total = of("clips").select(c("n").alias("total"), *facts)
    crossing = g.where("g in ('content', 'voice', 'speaker')").agg(*(F.count_if((c("g") == k) & (c("first") != c("last"))).alias(k) for k in ("content", "voice", "speaker")), F.coalesce(F.sum(F.when(c("g") == "content", c("n") - 1)), F.lit(0)).alias("again"))
    people = g.where("g in ('voice', 'speaker')").agg(F.count_if(c("g") == "voice").alias("voices"), F.count_if((c("g") == "voice") & (c("positives") > 0)).alias("positive_voices"), F.count_if(c("g") == "speaker").alias("speakers"))
    keywords = of("target").agg(F.coalesce(F.sum(F.when(c("a") == r.keyword, c("n"))), F.lit(0)).alias("keywords"))
    one = F.broadcast(total.join(crossing).join(people).join(keywords))  # one row against one
    single = one.select(F.explode(F.array(
        row("summary", F.lit("clips"), c("total")), row("summary", F.lit("seconds"), c("total")),
        row("model target", F.lit("negatives for ten positives"), F.floor(10 * (c("total") - c("keywords")) / F.greatest(c("keywords"), F.lit(1)))),
        row("real and synthetic", F.lit("real positives"), c("real_positives")),
        row("diversity", F.lit("voices"), c("voices")), row("diversity", F.lit("voices of positives"), c("positive_voices")), row("diversity", F.lit("speakers"), c("speakers")),
        row("leakage", F.lit("hashes crossing splits"), c("content")), row("leakage", F.lit("duplicate clips"), c("again")), row("leakage", F.lit("voices crossing splits"), c("voice")), row("leakage", F.lit("speakers crossing splits"), c("speaker")),
        row("leakage", F.lit("synthetic in test"), c("synthetic_test")), row("leakage", F.lit("synthetic positives in test"), c("synthetic_positives_test")), row("leakage", F.lit("augmented in test"), c("augmented_test")), row("leakage", F.lit("test size"), c("test")), row("leakage", F.lit("test positives"), c("test_positives")),
    )).alias("r")).select("r.*")
    counted = lambda block, name, key: of(name).select(F.lit(block).alias("block"), key.alias("key"), text(c("n")).alias("value"))
    shares = lambda block, name: of(name).join(one).select(F.lit(block).alias("block"), F.concat("a", F.lit(" per mille")).alias("key"), text(F.floor(1000 * c("n") / c("total"))).alias("value"))
    pair = F.concat_ws("|", "a", "b")
    by_split = F.broadcast(df.sparkSession.createDataFrame([(x,) for x in splits], "a string")).join(of("split").groupBy("a").agg(F.sum("n").alias("n")), "a", "left")
    levels = quantile_nearest_rank(of("level"), "a", "x", [0.25, 0.5, 0.75], "n").select(F.lit("levels").alias("block"), "a", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), c(v).alias("v")) for k, v in (("min", "low"), ("p25", "p25"), ("med", "p50"), ("p75", "p75"), ("max", "high"))))).alias("q"), "n")
    onsets = quantile_nearest_rank(of("onset"), "g", "x", [0.5], "n").select(F.explode(F.array(*(F.struct(F.lit(k).alias("key"), F.round(c(v), 3).cast("string").alias("value")) for k, v in (("min", "low"), ("med", "p50"), ("max", "high"))))).alias("q")).select(F.lit("onset").alias("block"), "q.*")
    parts = [
        single, counted("class balance", "class", c("a")), shares("class balance", "class"), counted("model target", "target", c("a")), shares("model target", "target"),
        by_split.select(F.lit("splits").alias("block"), c("a").alias("key"), text(F.coalesce("n", F.lit(0))).alias("value")), counted("splits", "split", pair),
        counted("real and synthetic", "synthetic", F.when(c("a") == "true", "synthetic").otherwise("real")), counted("real and synthetic", "source type", F.concat(F.lit("type "), "a")),
        counted("licences", "licence", pair), of("augmentation").orderBy(F.desc("n"), "a").limit(top).select(F.lit("augmentation").alias("block"), c("a").alias("key"), text(c("n")).alias("value")),
        levels.select("block", F.concat_ws("|", "a", "q.k").alias("key"), F.round("q.v", 3).cast("string").alias("value")), onsets,
    ]
    return functools.reduce(DataFrame.unionByName, parts)


def split_check(df: DataFrame, session: str, speaker: str, real: str, content: str, split: str, held_out: str = "test") -> DataFrame:
    """check, item, splits (joined by +) of a finished dataset: every session's and real speaker's splits, sessions in several,
    held-out sessions, those that leak, and (without an item) how many contents lie in more than one split. Null and empty names count for none."""
    named = lambda x: F.coalesce(F.col(x).cast("string"), F.lit(""))
    kinds = F.array_compact(F.array(
        F.when(named(session) != "", F.struct(F.lit("session").alias("kind"), named(session).alias("item"))),
        F.when((named(speaker) != "") & F.col(real), F.struct(F.lit("real speaker").alias("kind"), named(speaker).alias("item"))),
        F.struct(F.lit("content").alias("kind"), named(content).alias("item")),
    ))
    rows = df.select(F.col(split).alias("split"), F.explode(kinds).alias("k")).groupBy("k.kind", "k.item").agg(F.array_sort(F.collect_set("split")).alias("s"))
    rows = written(rows, "spans")
    several, held = F.size("s") > 1, F.array_contains("s", held_out)
    checks = F.array_compact(F.array(
        F.when(F.col("kind") == "session", F.lit("sessions by split")), F.when((F.col("kind") == "session") & several, F.lit("sessions in several splits")),
        F.when((F.col("kind") == "session") & held, F.lit("held-out sessions")), F.when((F.col("kind") == "session") & held & several, F.lit("held-out sessions that leak")),
        F.when(F.col("kind") == "real speaker", F.lit("real speakers by split")),
    ))
    out = rows.where("kind <> 'content'").select(F.explode(checks).alias("check"), "item", F.array_join("s", "+").alias("splits"))
    return out.unionByName(rows.where("kind = 'content'").agg(F.count_if(several).cast("string").alias("splits")).select(F.lit("contents crossing splits").alias("check"), F.lit("").alias("item"), "splits"))
