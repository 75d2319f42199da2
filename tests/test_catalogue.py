"""Rule catalogues: each mutation of a good dataset breaks exactly one rule."""

import pytest

from tidewater.operators import catalogue

RULES = [("QC-1", "samples = 16000", "reject"), ("QC-4", "level between -40 and -6", "reject"), ("QC-9", "onset >= 50", "as:partial"), ("QC-14", "duration between 300 and 1200", "flag"), ("QC-15", "voice is not null", "reject")]
SCHEMA = "clip int, source int, cls string, samples int, level double, onset int, duration int, voice string, split string, recording string"
GOOD = [(k, k - 1 if k % 3 else None, "positive", 16000, -20.0, 100, 500, f"v{k}", "train" if k < 9 else "test", f"r{k}") for k in range(12)]
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


def table(spark, **change):
    rows = [list(r) for r in GOOD]
    for c, v in change.items():
        rows[4][COLUMNS.index(c)] = v
    return spark.createDataFrame([tuple(r) for r in rows], SCHEMA)


@pytest.mark.parametrize("change, rule, verdict, cls", [
    ({}, None, "ok", "positive"), ({"samples": 15999}, "QC-1", "reject", "positive"), ({"level": -41.0}, "QC-4", "reject", "positive"), ({"onset": 10}, "QC-9", "reclassified", "partial"),
    ({"duration": 1300}, "QC-14", "flag", "positive"), ({"voice": None}, "QC-15", "reject", "positive"), ({"level": None}, None, "ok", "positive"),
])
def test_each_mutation_breaks_one_rule(spark, change, rule, verdict, cls):
    rules = spark.createDataFrame(RULES, "rule string, holds string, action string")
    got = {r["clip"]: (r["broken"], r["verdict"], r["cls"]) for r in catalogue.checked(table(spark, **change), rules, "cls").collect()}
    assert got.pop(4) == ([rule] if rule else [], verdict, cls)
    assert set(map(str, got.values())) == {str(([], "ok", "positive"))}


def test_catalogues_that_are_wrong(spark):
    for rules in ([("a", "true", "reject"), ("a", "true", "flag")], [("a", "true", "burn")]):
        with pytest.raises(ValueError):
            catalogue.compiled(spark.createDataFrame(rules, "rule string, holds string, action string"))
    none = spark.createDataFrame([], "rule string, holds string, action string")
    assert {r["verdict"] for r in catalogue.checked(table(spark), none, "cls").collect()} == {"ok"}


def test_copies_inherit_and_may_not_span(spark):
    good = table(spark)
    assert {r["clip"]: r["origin"] for r in catalogue.origins(good, "clip", "source").collect()} == {k: k - k % 3 for k in range(12)}
    assert catalogue.copies_across(good, "clip", "source", "split").isEmpty()
    assert [tuple(r) for r in catalogue.copies_across(table(spark, split="test"), "clip", "source", "split").collect()] == [(3, ["test", "train"])]
    chain = spark.range(500).selectExpr("cast(id as int) clip", "cast(if(id = 0, -7, id - 1) as int) source")
    assert {r["origin"] for r in catalogue.origins(chain, "clip", "source").collect()} == {-7}
    with pytest.raises(ValueError, match="comes back"):
        catalogue.origins(spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "clip int, source int"), "clip", "source")


def test_locked_and_reserved(spark):
    good = table(spark)
    held = catalogue.lock(good.where("split = 'test'"), COLUMNS)
    assert not catalogue.unlocked(good.where("split = 'test'").repartition(3), COLUMNS, held)
    assert catalogue.unlocked(table(spark, split="test").where("split = 'test'"), COLUMNS, held)
    assert catalogue.tunable(good.where("split = 'train'"), "split").count() == 9
    with pytest.raises(Exception, match="tuned on the test split"):
        catalogue.tunable(good, "split").collect()
    streams = spark.createDataFrame([("s1",), ("r4",), (None,)], "recording string")
    assert [r["recording"] for r in catalogue.in_clips_and_streams(good, streams, "recording").collect()] == ["r4"]
    assert catalogue.in_clips_and_streams(table(spark, recording="r40"), streams, "recording").isEmpty()
