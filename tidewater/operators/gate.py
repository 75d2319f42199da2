"""The leakage gate: one query per check, each (check, n_bad, severity); the verdict is their conjunction.

``manifest`` columns are named by the caller: content hash, entities, session, text, split, and the
flags synthetic, positive and augmentation. Empty strings and nulls name no entity.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The share of all rows that may be duplicates within their split, and the positives below which a test split warns.
DUPLICATE_SHARE, FEW, SCARCE = 0.02, 20, 100


def _checks(one: DataFrame, checks: Sequence[tuple[str, Column, str]]) -> DataFrame:
    """check, n_bad, severity of checks (name, n_bad, kind) over one row of counts."""
    rows = F.array(*(F.struct(F.lit(name).alias("check"), F.coalesce(n.cast("long"), F.lit(0)).alias("n_bad"), F.lit(kind).alias("kind")) for name, n, kind in checks))
    return one.select(F.explode(rows).alias("c")).select("c.check", "c.n_bad", F.when(F.col("c.n_bad") > 0, F.col("c.kind")).otherwise("ok").alias("severity"))


def spanning(df: DataFrame, keys: Sequence[str], split: str = "split", exempt: str | None = None) -> DataFrame:
    """The entities that lie in more than one split: keys, n_splits, n_rows."""
    named = df
    for k in keys:
        named = named.where(F.coalesce(F.col(k).cast("string"), F.lit("")) != "")
    if exempt:
        named = named.where(~F.col(keys[0]).startswith(exempt))
    return named.groupBy(*keys).agg(F.count_distinct(split).alias("n_splits"), F.count("*").alias("n_rows")).where("n_splits > 1")


def duplicates_within(df: DataFrame, content: str, split: str = "split") -> DataFrame:
    """By split: rows, and rows beyond the first of each content."""
    per = df.groupBy(split, content).agg(F.count("*").alias("n"))
    return per.groupBy(split).agg(F.sum("n").alias("n_rows"), F.sum(F.col("n") - 1).alias("n_dups"))


def contents(df: DataFrame, content: str, split: str = "split") -> DataFrame:
    """One row: contents in two splits, all rows, duplicates within their split, and 1 if these pass their share of all rows."""
    per = df.groupBy(content, split).agg(F.count("*").alias("n"))
    by_content = per.groupBy(content).agg(F.count("*").alias("n_splits"), F.sum("n").alias("n"), F.sum(F.col("n") - 1).alias("dups"))
    out = by_content.agg(F.count_if(F.col("n_splits") > 1).alias("n_crossing"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum("dups"), F.lit(0)).alias("n_dups"))
    return out.withColumn("too_many", (F.col("n_dups") > DUPLICATE_SHARE * F.col("n_rows")).cast("int"))


def quarantine(df: DataFrame, session: str, split: str = "split", test: str = "test") -> DataFrame:
    """One row: sessions in test and elsewhere, 1 if there are sessions but none in test, and the sessions in test."""
    named = df.where(F.coalesce(F.col(session).cast("string"), F.lit("")) != "")
    per = named.groupBy(session).agg(F.max((F.col(split) == test).cast("int")).alias("t"), F.max((F.col(split) != test).cast("int")).alias("o"))
    return per.agg(F.coalesce(F.sum(F.col("t") * F.col("o")), F.lit(0)).alias("n_mixed"), F.when((F.count("*") > 0) & (F.coalesce(F.max("t"), F.lit(0)) == 0), 1).otherwise(0).alias("none_in_test"), F.coalesce(F.sum("t"), F.lit(0)).cast("long").alias("n_in_test"))


def test_purity(df: DataFrame, synthetic: str, positive: str, augmentation: str, allowed: Sequence[str], split: str = "split", test: str = "test") -> DataFrame:
    """One row over the test split: rows, positives, synthetic positives, other synthetic rows, augmented rows."""
    t = df.where(F.col(split) == test)
    augmented = ~F.coalesce(F.col(augmentation), F.lit("")).isin(*allowed)
    return t.agg(
        F.count("*").alias("n_test"),
        F.count_if(F.col(positive)).alias("n_positive"),
        F.count_if(F.col(synthetic) & F.col(positive)).alias("n_synthetic_positive"),
        F.count_if(F.col(synthetic) & ~F.col(positive)).alias("n_synthetic_other"),
        F.count_if(augmented).alias("n_augmented"),
    )


def gate(df: DataFrame, content: str, voice: str, speaker: str, session: str, text: str, synthetic: str, positive: str, augmentation: str, allowed: Sequence[str] = ("none", "mic_band", ""), exempt: str | None = None, split: str = "split") -> DataFrame:
    """check, n_bad, severity (ok, warn, fail) of every check; each grouping of the table is computed once.

    Positives are only asked for in a test split that holds rows; below ``FEW`` there is one warning, up to ``SCARCE`` another.
    """
    n, there = F.col("n_positive"), F.col("n_test") > 0
    one = test_purity(df, synthetic, positive, augmentation, allowed, split).join(F.broadcast(quarantine(df, session, split)))  # one row and one row
    whole = [
        ("session_in_test_and_elsewhere", F.col("n_mixed"), "fail"),
        ("no_session_in_test", F.col("none_in_test"), "fail"),
        ("synthetic_positive_in_test", F.col("n_synthetic_positive"), "fail"),
        ("augmented_in_test", F.col("n_augmented"), "fail"),
        ("test_empty", ~there, "fail"),
        ("test_without_positives", there & (n == 0), "fail"),
        ("very_few_test_positives", there & (n < FEW), "warn"),
        ("few_test_positives", there & (n >= FEW) & (n < SCARCE), "warn"),
        ("one_short_test_session", (F.col("n_in_test") == 1) & (n < FEW), "warn"),
    ]
    parts = [_checks(one, whole), _checks(contents(df, content, split), [("hash_in_two_splits", F.col("n_crossing"), "fail"), ("duplicates_within_split", F.col("too_many"), "fail")])]
    for name, keys in (("voice_in_two_splits", [voice]), ("speaker_in_two_splits", [speaker]), ("voice_text_in_two_splits", [voice, text])):
        parts.append(_checks(spanning(df, keys, split, exempt).agg(F.count("*").alias("n")), [(name, F.col("n"), "fail")]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def verdict(checks: DataFrame) -> DataFrame:
    """One row: failed checks, warnings, and whether the gate passes."""
    return checks.agg(F.count_if(F.col("severity") == "fail").alias("n_fail"), F.count_if(F.col("severity") == "warn").alias("n_warn"), F.bool_and(F.col("severity") != "fail").alias("passed"))


def enforce(checks: DataFrame) -> None:
    """Raises, naming the failed checks; at most one row a check goes to the driver."""
    failed = [r["check"] for r in checks.where("severity = 'fail'").collect()]
    if failed:
        raise ValueError("leakage gate failed: " + ", ".join(sorted(failed)))


def exact_duplicates(df: DataFrame, content: str, key: str) -> DataFrame:
    """Rows beyond the first of each content: key, first_key (its least key)."""
    first = df.groupBy(content).agg(F.min(key).alias("first_key"), F.count("*").alias("n")).where("n > 1")
    return df.join(first, content).where(F.col(key) != F.col("first_key")).select(key, "first_key")
