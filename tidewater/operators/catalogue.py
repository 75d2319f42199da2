"""Rule catalogues: rules as a table that is compiled into expressions, and the controls that go beyond a row's own columns.

A rule is a name, the condition that a good row fulfils (SQL), and what becomes of a row that breaks it: ``reject``, ``flag``,
or ``as:<class>``, which gives the row another class. A condition on nulls counts as fulfilled unless it says otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tables import written

#: What becomes of a row, the strongest first.
ACTIONS = ("reject", "as", "flag")
#: Rules that a catalogue may hold, as it is compiled on the driver; and rounds in which the longest chain of copies has to end.
RULES, ROUNDS = 1000, 40


def compiled(rules: DataFrame) -> list[tuple[str, str, str]]:
    """(rule, holds, action) of a catalogue, in order of its rules' names. A name that is there twice, or an unknown action, is an error."""
    out = [(r["rule"], r["holds"], r["action"]) for r in rules.select("rule", "holds", "action").orderBy("rule").limit(RULES + 1).collect()]
    if len(out) > RULES or len({r for r, *_ in out}) < len(out):
        raise ValueError("a catalogue has so many rules, each under its own name")
    if wrong := [a for _, _, a in out if a.split(":")[0] not in ACTIONS]:
        raise ValueError(f"unknown action {wrong[0]!r}")
    return out


def checked(df: DataFrame, rules: DataFrame, cls: str) -> DataFrame:
    """``df`` with broken (names of broken rules, in order), verdict (reject, reclassified, flag or ok) and its class after the first rule that gives another; one pass, whatever the number of rules."""
    known = compiled(rules)
    broken = lambda holds: ~F.coalesce(F.expr(f"({holds})"), F.lit(True))
    of = lambda action: F.exists("_broken", lambda x: x["action"].startswith(action)) if known else F.lit(False)
    marks = F.array_compact(F.array(*(F.when(broken(h), F.struct(F.lit(r).alias("rule"), F.lit(a).alias("action"))) for r, h, a in known)))
    other = F.filter("_broken", lambda x: x["action"].startswith("as:"))
    out = df.withColumn("_broken", marks) if known else df.withColumn("_broken", F.array().cast("array<struct<rule: string, action: string>>"))
    out = out.withColumn("verdict", F.when(of("reject"), "reject").when(of("as:"), "reclassified").when(of("flag"), "flag").otherwise("ok"))
    out = out.withColumn(cls, F.coalesce(F.substring(F.get(other, F.lit(0))["action"], 4, 1 << 20), F.col(cls)))
    return out.withColumn("broken", F.transform("_broken", lambda x: x["rule"])).drop("_broken")


def origins(df: DataFrame, key: str, source: str) -> DataFrame:
    """key, origin: what a clip was made from in the end, along ``source`` (null or its own key: nothing). A source that isn't in the table is an origin. Chains are followed by doubling; one that comes back to itself is an error."""
    links = written(df.select(F.col(key).alias("k"), F.coalesce(F.col(source), F.col(key)).alias("up")).where("k is not null").distinct(), "links")
    for _ in range(ROUNDS):
        on = links.select(F.col("k").alias("_k"), F.col("up").alias("_up"))
        links = written(links.join(on, links["up"] == on["_k"], "left").select("k", F.coalesce("_up", "up").alias("next"), "up"), "links")
        if links.where("next <> up").isEmpty():
            return links.select(F.col("k").alias(key), F.col("up").alias("origin"))
        links = links.select("k", F.col("next").alias("up"))
    raise ValueError("a chain of copies comes back to itself")


def inherited(df: DataFrame, key: str, source: str, split: Column) -> DataFrame:
    """``df`` with origin and split: ``split`` is an expression of ``origin``, so copies and windows of a recording share it."""
    return df.join(origins(df, key, source), key).withColumn("split", split)


def copies_across(df: DataFrame, key: str, source: str, split: str) -> DataFrame:
    """origin, splits of recordings whose copies or windows lie in more than one split."""
    of = df.select(key, split).join(origins(df, key, source), key)
    return of.groupBy("origin").agg(F.array_sort(F.collect_set(split)).alias("splits")).where(F.size("splits") > 1)


def in_clips_and_streams(clips: DataFrame, streams: DataFrame, recording: str) -> DataFrame:
    """Recordings that clips were cut from and that a continuous stream has as well."""
    named = lambda df: df.select(recording).where(F.col(recording).isNotNull()).distinct()
    return named(clips).join(named(streams), recording, "left_semi")


def lock(df: DataFrame, columns: Sequence[str]) -> dict[str, int]:
    """What a table holds, whatever the order of its rows: their number, and the sum and the parity of their hashes."""
    h = F.xxhash64(*(F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in columns))
    row = df.agg(F.count("*").alias("n"), F.sum(F.pmod(h, F.lit(1 << 31))).alias("total"), F.bit_xor(h).alias("parity")).first()
    return {k: int(row[k] or 0) for k in ("n", "total", "parity")}


def unlocked(df: DataFrame, columns: Sequence[str], held: dict[str, int]) -> bool:
    """Whether a locked table has changed."""
    return lock(df, columns) != held


def tunable(df: DataFrame, split: str, test: str = "test") -> DataFrame:
    """``df`` for the choice of a threshold: the query fails at a row of the test split."""
    allowed = F.assert_true(F.coalesce(F.col(split), F.lit("")) != test, F.lit("a threshold isn't tuned on the test split"))
    return df.where(allowed.isNull())
