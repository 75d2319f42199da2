"""Every registered query of the record operators on the driver tables, with DuckDB SQL for the same rows.

Roles: a document is a clip (source = voice, lang = class, SHA-256 of the text = content), an event
stream is a user's events in order, an embedding is a fingerprint, labels are truth. An event's
score is value / (value + 35); ``purchase`` is the positive class.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..functions.scalars import decibels, epoch_micros, mel
from ..functions.shipping import ship
from ..functions.tables import shared_path
from ..operators import catalogue, clip_qc, evaluation, gate, quality, report, sequence, splits

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

DAY, HOUR = 86_400.0, 3_600.0


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with t (seconds), score, truth and hit."""
    e = table(spark, sf_dir, "events")
    score = F.col("value") / (F.col("value") + 35)
    return e.select("event_id", "user_id", "event_type", "value", "props", (epoch_micros("ts") / 1e6).alias("t"), score.alias("score"), (F.col("event_type") == "purchase").alias("truth"), (score >= 0.6).alias("hit"))


_SCORED = "scored AS (SELECT event_id, user_id, event_type, value, props, epoch_us(ts) / 1e6 AS t, value / (value + 35) AS score, event_type = 'purchase' AS truth, value / (value + 35) >= 0.6 AS hit FROM events)"
_U = "CAST('0x' || substr(sha256('split' || coalesce(source, '')), 1, 12) AS BIGINT) / 281474976710656.0"
_SPLIT = f"CASE WHEN {_U} < 0.8 THEN 'train' WHEN {_U} < 0.92 THEN 'validation' ELSE 'test' END"
_UD = "CAST('0x' || substr(sha256('clip' || CAST(doc_id AS VARCHAR)), 1, 12) AS BIGINT) / 281474976710656.0"
_SPLIT_DOC = f"CASE WHEN {_UD} < 0.8 THEN 'train' WHEN {_UD} < 0.92 THEN 'validation' ELSE 'test' END"
_CLIPS = f"clips AS (SELECT doc_id, sha256(text) AS content, source, lang, 's' || (doc_id % 40) AS session, n_chars, lang = 'en' AS positive, doc_id % 7 = 0 AS synthetic, CASE WHEN doc_id % 11 = 0 THEN 'gain' ELSE 'none' END AS augmentation, {_SPLIT_DOC} AS split FROM documents)"


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a manifest, split by document so that leaks occur."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("content"), "source", "lang", F.concat(F.lit("s"), (F.col("doc_id") % 40).cast("string")).alias("session"), "n_chars", (F.col("lang") == "en").alias("positive"), (F.col("doc_id") % 7 == 0).alias("synthetic"), F.when(F.col("doc_id") % 11 == 0, "gain").otherwise("none").alias("augmentation"))
    return splits.hash_split(d, "doc_id", "clip")


# --- projections, filters, reports -------------------------------------------------------------


@query(f"SELECT {_SPLIT} || '_' || lang || '_' || lpad(CAST(doc_id AS VARCHAR), 6, '0') AS clip_id, lang AS class, CASE lang WHEN 'en' THEN 'keyword' WHEN 'de' THEN 'unknown' ELSE 'background' END AS model_target, source AS voice_id, CAST(n_chars AS INTEGER) AS duration, sha256(text) AS content FROM documents")
def manifest_typed_projection(spark, sf_dir):
    d = splits.hash_split(table(spark, sf_dir, "documents"), "source")
    target = splits.member({"en": "keyword", "de": "unknown"}, F.col("lang"), "background")
    return d.select(F.concat_ws("_", "split", "lang", F.lpad(F.col("doc_id").cast("string"), 6, "0")).alias("clip_id"), F.col("lang").alias("class"), target.alias("model_target"), F.col("source").alias("voice_id"), F.col("n_chars").cast("int").alias("duration"), F.sha2("text", 256).alias("content"))


@query("SELECT source, count(*) AS n, count(*) FILTER (WHERE toxic = 0) AS n_clean, count(*) FILTER (WHERE toxic IS NULL) AS n_unlabelled FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE lang IN ('en', 'de') AND coalesce(source, '') <> '' AND NOT starts_with(source, 'src1') GROUP BY source")
def subset_mask_counts(spark, sf_dir):
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    kept = d.where(F.col("lang").isin("en", "de") & (F.coalesce("source", F.lit("")) != "") & ~F.col("source").startswith("src1"))
    return kept.select("doc_id", "source").join(l, "doc_id", "left").groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("toxic") == 0).alias("n_clean"), F.count_if(F.col("toxic").isNull()).alias("n_unlabelled"))


@query("SELECT lang, count(*) AS n, round(count(*) / (SELECT count(*) FROM documents), 6) AS share FROM documents GROUP BY lang")
def class_balance(spark, sf_dir):
    return report.share_by(table(spark, sf_dir, "documents"), "lang")


@query(f"WITH d AS (SELECT lang, {_SPLIT} AS split FROM documents), g AS (SELECT split, lang FROM (VALUES ('train'), ('validation'), ('test')) a(split), (VALUES ('en'), ('de'), ('fr'), ('es'), ('it')) b(lang)) SELECT g.split, g.lang, count(d.lang) AS n FROM g LEFT JOIN d ON d.split = g.split AND d.lang = g.lang GROUP BY g.split, g.lang")
def split_class_crosstab(spark, sf_dir):
    return report.crosstab(splits.hash_split(table(spark, sf_dir, "documents"), "source"), "split", ["train", "validation", "test"], "lang", ["en", "de", "fr", "es", "it"])


@query("SELECT source, lang, count(*) AS n FROM documents GROUP BY source, lang")
def corpus_license_counts(spark, sf_dir):
    return report.pair_counts(table(spark, sf_dir, "documents"), "source", "lang")


@query("SELECT count(DISTINCT user_id) AS n_all, count(DISTINCT CASE WHEN value > 100 THEN user_id END) AS n_where, count(DISTINCT coalesce(CAST(user_id AS VARCHAR), '') || '|' || coalesce(event_type, '')) AS n_tuples FROM events")
def distinct_entities(spark, sf_dir):
    return report.distinct_entities(table(spark, sf_dir, "events"), "user_id", "value > 100", ["user_id", "event_type"])


@query("WITH r AS (SELECT event_type, value AS v, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) SELECT event_type, max(n) AS n, min(v) AS low, max(v) AS high, max(v) FILTER (WHERE i = least(n - 1, CAST(floor(0.05 * n) AS BIGINT))) AS p5, max(v) FILTER (WHERE i = least(n - 1, CAST(floor(0.5 * n) AS BIGINT))) AS p50, max(v) FILTER (WHERE i = least(n - 1, CAST(floor(0.95 * n) AS BIGINT))) AS p95 FROM r GROUP BY event_type")
def quantile_nearest_rank(spark, sf_dir):
    return report.quantile_nearest_rank(table(spark, sf_dir, "events"), "event_type", "value", [0.05, 0.5, 0.95])


@query("SELECT event_type, round(quantile_cont(value, 0.2), 6) AS p20, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY event_type")
def quantile_linear(spark, sf_dir):
    return report.quantile_linear(table(spark, sf_dir, "events"), "event_type", "value", [0.2, 0.5, 0.99])


@query("WITH r AS (SELECT user_id, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE value IS NOT NULL) SELECT user_id, max(v) FILTER (WHERE i = n // 2) AS upper_median FROM r GROUP BY user_id")
def upper_median(spark, sf_dir):
    return report.upper_median(table(spark, sf_dir, "events"), "user_id", "value")


@query("SELECT g.bin, count(p.b) AS n FROM (SELECT CAST(range AS INTEGER) AS bin FROM range(12)) g LEFT JOIN (SELECT CAST(least(greatest(floor((p_size - 1) / 5.0), 0), 11) AS INTEGER) AS b FROM part) p ON p.b = g.bin GROUP BY g.bin")
def fixed_bin_histogram(spark, sf_dir):
    return report.fixed_histogram(table(spark, sf_dir, "part"), "p_size", 1.0, 5.0, 12)


@query("WITH k AS (SELECT * FROM (VALUES ('click'), ('error'), ('purchase'), ('refund'), ('signup'), ('view')) t(event_type)), c AS (SELECT k.event_type, greatest(count(e.event_type), 1) AS n FROM k LEFT JOIN events e ON e.event_type = k.event_type GROUP BY k.event_type) SELECT event_type, n, round((SELECT sum(n) FROM c) / (6 * n) * CASE WHEN event_type = 'purchase' THEN 2.0 ELSE 1.0 END, 6) AS weight FROM c")
def class_weights(spark, sf_dir):
    return report.class_weights(table(spark, sf_dir, "events"), "event_type", "purchase", 2.0, ["click", "error", "purchase", "refund", "signup", "view"])


@query("SELECT props, count(*) AS n FROM events GROUP BY props ORDER BY n DESC, props LIMIT 10")
def top_reasons(spark, sf_dir):
    return report.top_values(table(spark, sf_dir, "events"), "props", 10)


@query("SELECT user_id, min(value) AS low, round(avg(value), 6) AS mean, max(value) AS high, round(sqrt(avg(value * value)), 6) AS rms, bool_or(abs(value) >= 400) AS clipped FROM events GROUP BY user_id")
def value_summary(spark, sf_dir):
    return report.summary(table(spark, sf_dir, "events"), "user_id", "value", 400.0)


@query("WITH w AS (SELECT * FROM (VALUES ('en', 700), ('de', 100), ('it', 50)) t(lang, want)), h AS (SELECT lang, count(*) AS have FROM documents GROUP BY lang) SELECT w.lang, coalesce(have, 0) AS have, CAST(want AS BIGINT) AS want, greatest(0, want - coalesce(have, 0)) AS missing FROM w LEFT JOIN h ON w.lang = h.lang")
def target_gap(spark, sf_dir):
    return report.gaps_to_target(table(spark, sf_dir, "documents"), "lang", {"en": 700, "de": 100, "it": 50})


# --- splits and samples --------------------------------------------------------------------------


@query(f"SELECT doc_id, source, {_SPLIT} AS split FROM documents")
def hash_split_assignment(spark, sf_dir):
    return splits.hash_split(table(spark, sf_dir, "documents"), "source").select("doc_id", "source", "split")


@query("WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS position FROM documents) SELECT doc_id, position, CASE WHEN position % 5 < 3 THEN 'train' WHEN position % 5 = 3 THEN 'validation' ELSE 'test' END AS split FROM r")
def round_robin_partition(spark, sf_dir):
    return splits.round_robin(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"]).select("doc_id", "position", "split")


@query("WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) SELECT doc_id, source, CASE WHEN n % 4 = 0 AND n // 4 <= 5 THEN 'validation' ELSE 'train' END AS split FROM r")
def every_nth_split(spark, sf_dir):
    return splits.every_nth(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", ["doc_id"], 4, 5)


@query("WITH c AS (SELECT event_type, count(*) AS n FROM events GROUP BY event_type), t AS (SELECT CAST(sum(n) AS BIGINT) AS total FROM c) SELECT event_type, n, total FROM c, t WHERE n * 2 <= total ORDER BY n DESC, event_type DESC LIMIT 1")
def heldout_choice(spark, sf_dir):
    return splits.heldout_choice(table(spark, sf_dir, "events"), "event_type")


@query(f"WITH d AS (SELECT doc_id, lang, {_SPLIT} AS split FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY split, lang ORDER BY doc_id) AS number FROM d) SELECT doc_id, split || '_' || lang || '_' || lpad(CAST(number AS VARCHAR), 6, '0') AS clip_id FROM r")
def clip_id_numbering(spark, sf_dir):
    d = splits.hash_split(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "source")
    return splits.group_numbers(d, ["split", "lang"], ["doc_id"]).select("doc_id", F.concat_ws("_", "split", "lang", F.lpad(F.col("number").cast("string"), 6, "0")).alias("clip_id"))


@query("WITH r AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY sha256('sample' || CAST(doc_id AS VARCHAR)), doc_id) AS n FROM documents) SELECT doc_id, lang, source FROM r WHERE n <= 2")
def stratified_sample(spark, sf_dir):
    return splits.stratified_sample(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), ["lang", "source"], "doc_id", 2, "sample")


@query("SELECT doc_id, lang FROM documents ORDER BY sha256('cap' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 25")
def capped_sample(spark, sf_dir):
    return splits.capped_sample(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", 25, "cap")


@query("WITH r AS (SELECT event_id, user_id, coalesce(sum(CAST(event_id AS HUGEINT) % 97) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM events) SELECT event_id, user_id, CAST(before AS BIGINT) AS before FROM r WHERE before < 500")
def prefix_sum_cut(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", (F.col("event_id") % 97).alias("length"))
    return splits.prefix_sum_cut(e, "user_id", ["event_id"], "length", 500).select("event_id", "user_id", "before")


# --- leakage -------------------------------------------------------------------------------------


@query(f"WITH {_CLIPS} SELECT content, count(DISTINCT split) AS n_splits, count(*) AS n_rows FROM clips GROUP BY content HAVING count(DISTINCT split) > 1")
def leak_hash_cross_split(spark, sf_dir):
    return gate.spanning(clips(spark, sf_dir), ["content"])


@query(f"WITH {_CLIPS}, p AS (SELECT split, content, count(*) AS n FROM clips GROUP BY split, content) SELECT split, CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(n - 1) AS BIGINT) AS n_dups FROM p GROUP BY split")
def leak_dups_within_split(spark, sf_dir):
    return gate.duplicates_within(clips(spark, sf_dir), "content")


@query(f"WITH {_CLIPS} SELECT source, count(DISTINCT split) AS n_splits, count(*) AS n_rows FROM clips WHERE coalesce(source, '') <> '' AND NOT starts_with(source, 'src1') GROUP BY source HAVING count(DISTINCT split) > 1")
def leak_entity_span(spark, sf_dir):
    return gate.spanning(clips(spark, sf_dir), ["source"], exempt="src1")


@query(f"WITH {_CLIPS} SELECT source, lang, count(DISTINCT split) AS n_splits, count(*) AS n_rows FROM clips WHERE coalesce(source, '') <> '' AND coalesce(lang, '') <> '' GROUP BY source, lang HAVING count(DISTINCT split) > 1")
def leak_composite_span(spark, sf_dir):
    return gate.spanning(clips(spark, sf_dir), ["source", "lang"])


@query(f"WITH {_CLIPS}, p AS (SELECT session, max(CAST(split = 'test' AS INTEGER)) AS t, max(CAST(split <> 'test' AS INTEGER)) AS o FROM clips GROUP BY session) SELECT CAST(coalesce(sum(t * o), 0) AS BIGINT) AS n_mixed, CASE WHEN count(*) > 0 AND coalesce(max(t), 0) = 0 THEN 1 ELSE 0 END AS none_in_test, CAST(coalesce(sum(t), 0) AS BIGINT) AS n_in_test FROM p")
def leak_session_quarantine(spark, sf_dir):
    return gate.quarantine(clips(spark, sf_dir), "session")


@query(f"WITH {_CLIPS} SELECT count(*) AS n_test, count(*) FILTER (WHERE positive) AS n_positive, count(*) FILTER (WHERE synthetic AND positive) AS n_synthetic_positive, count(*) FILTER (WHERE synthetic AND NOT positive) AS n_synthetic_other, count(*) FILTER (WHERE augmentation NOT IN ('none', 'mic_band', '')) AS n_augmented FROM clips WHERE split = 'test'")
def leak_test_purity(spark, sf_dir):
    return gate.test_purity(clips(spark, sf_dir), "synthetic", "positive", "augmentation", ["none", "mic_band", ""])


def _span_sql(keys: str, where: str = "true") -> str:
    return f"(SELECT count(*) FROM (SELECT {keys} FROM clips WHERE {where} GROUP BY {keys} HAVING count(DISTINCT split) > 1))"


_GATE_ROWS = f"""WITH {_CLIPS}, t AS (SELECT * FROM clips WHERE split = 'test'), p AS (SELECT session, max(CAST(split = 'test' AS INTEGER)) AS t, max(CAST(split <> 'test' AS INTEGER)) AS o FROM clips GROUP BY session),
n AS (SELECT count(*) AS n_test, count(*) FILTER (WHERE positive) AS n_pos FROM t),
checks AS (
SELECT 'hash_in_two_splits' AS "check", {_span_sql('content')} AS n_bad, 'fail' AS kind
UNION ALL SELECT 'duplicates_within_split', (SELECT CAST((SELECT sum(n - 1) FROM (SELECT count(*) AS n FROM clips GROUP BY split, content)) > 0.02 * (SELECT count(*) FROM clips) AS BIGINT)), 'fail'
UNION ALL SELECT 'voice_in_two_splits', {_span_sql('source')}, 'fail'
UNION ALL SELECT 'session_in_test_and_elsewhere', (SELECT CAST(coalesce(sum(t * o), 0) AS BIGINT) FROM p), 'fail'
UNION ALL SELECT 'no_session_in_test', (SELECT CASE WHEN count(*) > 0 AND coalesce(max(t), 0) = 0 THEN 1 ELSE 0 END FROM p), 'fail'
UNION ALL SELECT 'speaker_in_two_splits', {_span_sql('lang')}, 'fail'
UNION ALL SELECT 'voice_text_in_two_splits', {_span_sql('source, content')}, 'fail'
UNION ALL SELECT 'synthetic_positive_in_test', (SELECT count(*) FROM t WHERE synthetic AND positive), 'fail'
UNION ALL SELECT 'augmented_in_test', (SELECT count(*) FROM t WHERE augmentation NOT IN ('none', 'mic_band', '')), 'fail'
UNION ALL SELECT 'test_empty', (SELECT CAST(n_test = 0 AS BIGINT) FROM n), 'fail'
UNION ALL SELECT 'test_without_positives', (SELECT CAST(n_test > 0 AND n_pos = 0 AS BIGINT) FROM n), 'fail'
UNION ALL SELECT 'very_few_test_positives', (SELECT CAST(n_test > 0 AND n_pos < 20 AS BIGINT) FROM n), 'warn'
UNION ALL SELECT 'few_test_positives', (SELECT CAST(n_test > 0 AND n_pos BETWEEN 20 AND 99 AS BIGINT) FROM n), 'warn'
UNION ALL SELECT 'one_short_test_session', (SELECT CAST((SELECT coalesce(sum(t), 0) FROM p) = 1 AND n_pos < 20 AS BIGINT) FROM n), 'warn')
"""


def _gate(spark, sf_dir):
    return gate.gate(clips(spark, sf_dir), "content", "source", "lang", "session", "content", "synthetic", "positive", "augmentation")


@query(_GATE_ROWS + "SELECT \"check\", CAST(n_bad AS BIGINT) AS n_bad, CASE WHEN n_bad > 0 THEN kind ELSE 'ok' END AS severity FROM checks")
def leak_gate_checks(spark, sf_dir):
    return _gate(spark, sf_dir)


@query(_GATE_ROWS + "SELECT count(*) FILTER (WHERE n_bad > 0 AND kind = 'fail') AS n_fail, count(*) FILTER (WHERE n_bad > 0 AND kind = 'warn') AS n_warn, count(*) FILTER (WHERE n_bad > 0 AND kind = 'fail') = 0 AS passed FROM checks")
def leak_gate_verdict(spark, sf_dir):
    return gate.verdict(_gate(spark, sf_dir))


@query("WITH f AS (SELECT sha256(text) AS h, min(doc_id) AS first_key FROM documents GROUP BY 1) SELECT doc_id, first_key FROM documents JOIN f ON sha256(text) = h WHERE doc_id <> first_key")
def exact_duplicates(spark, sf_dir):
    return gate.exact_duplicates(clips(spark, sf_dir).select("doc_id", "content"), "content", "doc_id")


@query("WITH x AS (SELECT vec_id, unnest(generate_series(1, len(embedding))) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings), m AS (SELECT i, avg(v) AS m FROM x GROUP BY i), c AS (SELECT vec_id, list(v - m ORDER BY x.i) AS e FROM x JOIN m ON x.i = m.i GROUP BY vec_id) SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.e, b.e), 6) AS cosine FROM c a JOIN c b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.4")
def near_duplicates_cosine(spark, sf_dir):
    return quality.near_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 0.4).select("a", "b", F.round("cosine", 6).alias("cosine"))


# --- evaluation ----------------------------------------------------------------------------------

_CURVE = f"""WITH {_SCORED}, g AS (SELECT round(0.05::DOUBLE + 0.005::DOUBLE * range, 3) AS threshold FROM range(190)), s AS (SELECT threshold, count(*) FILTER (WHERE score >= threshold AND truth) AS tp, count(*) FILTER (WHERE score >= threshold AND NOT truth) AS fp, count(*) FILTER (WHERE truth) AS p, count(*) FILTER (WHERE NOT truth) AS n FROM g, scored GROUP BY threshold),
r AS (SELECT threshold, tp, fp, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS pr, CASE WHEN p > 0 THEN tp / p ELSE 'nan'::DOUBLE END AS rc, CASE WHEN n > 0 THEN fp / n ELSE 'nan'::DOUBLE END AS fa FROM s),
curve AS (SELECT threshold, tp, fp, round(pr, 6) AS "precision", round(rc, 6) AS recall, round(CASE WHEN isnan(rc) THEN 'nan'::DOUBLE WHEN pr + rc = 0 THEN 0.0 ELSE 2 * pr * rc / (pr + rc) END, 6) AS f1, round(fa, 6) AS far FROM r)
"""


@query(_CURVE + "SELECT * FROM curve")
def threshold_sweep(spark, sf_dir):
    return evaluation.sweep(scored(spark, sf_dir), "score", "truth")


@query(_CURVE + "SELECT coalesce((SELECT min(threshold) FROM curve WHERE far <= 0.01), (SELECT threshold FROM curve ORDER BY f1 DESC, threshold LIMIT 1)) AS threshold, CASE WHEN (SELECT min(threshold) FROM curve WHERE far <= 0.01) IS NOT NULL THEN 'far' ELSE 'f1' END AS rule")
def operating_point(spark, sf_dir):
    return evaluation.operating_point(evaluation.sweep(scored(spark, sf_dir), "score", "truth"))


@query(f"WITH {_SCORED} SELECT round(coalesce(least(greatest(quantile_cont(score, 0.99), 0.05), 0.99), 0.5), 6) AS threshold FROM scored WHERE NOT truth")
def quantile_threshold(spark, sf_dir):
    return evaluation.quantile_threshold(scored(spark, sf_dir), "score", "truth")


@query("WITH c AS (SELECT count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS tp, count(*) FILTER (WHERE quality = 0 AND toxic = 0) AS fp, count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS fn, count(*) FILTER (WHERE quality = 0 AND toxic = 1) AS tn FROM labels) SELECT tp, fp, fn, tn, round(tp / (tp + fp), 6) AS \"precision\", round(tp / (tp + fn), 6) AS recall, round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 6) AS f1, round(fp / (fp + tn), 6) AS far FROM c")
def binary_metrics(spark, sf_dir):
    return evaluation.binary_metrics(table(spark, sf_dir, "labels").select((F.col("quality") == 1).alias("y"), (F.col("toxic") == 0).alias("p")), "y", "p")


@query("WITH e AS (SELECT event_type AS truth, CASE WHEN value < 15 THEN 'view' WHEN value < 40 THEN 'click' ELSE 'purchase' END AS predicted FROM events), k AS (SELECT * FROM (VALUES ('view'), ('click'), ('purchase'), ('signup'), ('error')) t(c)) SELECT a.c AS truth, b.c AS predicted, count(e.truth) AS n FROM k a CROSS JOIN k b LEFT JOIN e ON e.truth = a.c AND e.predicted = b.c GROUP BY a.c, b.c")
def confusion_matrix(spark, sf_dir):
    guess = F.when(F.col("value") < 15, "view").when(F.col("value") < 40, "click").otherwise("purchase")
    return evaluation.confusion(table(spark, sf_dir, "events").select(F.col("event_type").alias("truth"), guess.alias("predicted")), "truth", "predicted", ["view", "click", "purchase", "signup", "error"])


@query(f"WITH {_SCORED}, c AS (SELECT event_type, count(*) AS n, count(*) FILTER (WHERE hit) AS k, count(DISTINCT user_id) AS n_entities FROM scored GROUP BY event_type), w AS (SELECT *, k / n AS p, 1.96 AS z FROM c) SELECT event_type, n, k, n_entities, round(p, 6) AS rate, round(greatest(0.0, (p + z * z / (2 * n)) / (1 + z * z / n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)), 6) AS low, round(least(1.0, (p + z * z / (2 * n)) / (1 + z * z / n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)), 6) AS high FROM w")
def subset_recall_wilson(spark, sf_dir):
    return evaluation.subset_recall(scored(spark, sf_dir), "event_type", "hit", "user_id")


@query(f"WITH {_SCORED}, c AS (SELECT user_id, count(*) FILTER (WHERE hit) AS k, (max(t) - min(t)) / 3600.0 AS hours FROM scored GROUP BY user_id HAVING max(t) > min(t)) SELECT user_id, k, round(hours, 6) AS hours, round(k / hours, 6) AS rate, round(CASE WHEN k > 0 THEN k * pow(1 - 1 / (9.0 * k) - 1.96 / (3 * sqrt(k)), 3) ELSE 0.0 END / hours, 6) AS low, round((k + 1) * pow(1 - 1 / (9.0 * (k + 1)) + 1.96 / (3 * sqrt(k + 1)), 3) / hours, 6) AS high FROM c")
def poisson_rate_ci(spark, sf_dir):
    per = scored(spark, sf_dir).groupBy("user_id").agg(F.count_if("hit").alias("k"), ((F.max("t") - F.min("t")) / HOUR).alias("hours")).where("hours > 0")
    return evaluation.rate_interval(per, "k", "hours").withColumn("hours", F.round("hours", 6))


@query("WITH x AS (SELECT label, unnest(generate_series(1, len(embedding))) AS dim, unnest(embedding)::DOUBLE AS v FROM embeddings), s AS (SELECT dim, avg(v) FILTER (WHERE label = 0) AS ma, avg(v) FILTER (WHERE label = 1) AS mb, var_samp(v) FILTER (WHERE label = 0) AS va, var_samp(v) FILTER (WHERE label = 1) AS vb, count(v) FILTER (WHERE label = 0) AS na, count(v) FILTER (WHERE label = 1) AS nb FROM x GROUP BY dim) SELECT CAST(dim - 1 AS INTEGER) AS dim, na, nb, round((ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)), 6) AS d FROM s")
def cohens_d_by_dim(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("dim", "x")).withColumn("x", F.col("x").cast("double"))
    return evaluation.cohens_d(e, "dim", "x", "label", 0, 1)


@query("WITH x AS (SELECT vec_id, unnest(generate_series(1, len(embedding))) AS dim, unnest(embedding)::DOUBLE AS v FROM embeddings), s AS (SELECT dim, avg(v) AS m, greatest(stddev_pop(v), 1e-6) AS s FROM x WHERE vec_id % 5 < 3 GROUP BY dim) SELECT vec_id, CAST(x.dim - 1 AS INTEGER) AS dim, round((v - m) / s, 4) AS z FROM x JOIN s ON x.dim = s.dim")
def train_znorm(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("dim", "x")).withColumn("x", F.col("x").cast("double"))
    return evaluation.znorm(e, "dim", "x", "vec_id % 5 < 3").select("vec_id", "dim", "z")


@query(f"WITH {_SCORED}, q AS (SELECT score, (least(greatest(round_even(score / 0.00390625, 0) - 128, -128.0), 127.0) + 128) * 0.00390625 AS s8 FROM scored), s AS (SELECT max(abs(score - s8)) AS d, corr(score, s8) AS c, avg(CAST((score >= 0.5) <> (s8 >= 0.5) AS INTEGER)) AS f FROM q) SELECT round(d, 6) AS max_diff, round(c, 6) AS corr, round(f, 6) AS flips, d <= 0.05 AND c >= 0.99 AND f <= 0.01 AS passed FROM s")
def score_parity(spark, sf_dir):
    s = scored(spark, sf_dir).select("score", evaluation.quantised(F.col("score"), 0.00390625, -128).alias("s8"))
    return evaluation.parity(s, "score", "s8", 0.5)


# --- series --------------------------------------------------------------------------------------

_VOTED = f"{_SCORED}, voted AS (SELECT *, sum(CAST(hit AS INTEGER)) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) >= 2 AS voted FROM scored)"
_FIRES = _VOTED + ", c AS (SELECT user_id, t, event_id FROM voted WHERE voted), fires AS (SELECT user_id, min(t) AS fire FROM c GROUP BY user_id UNION ALL SELECT f.user_id, min(c.t) AS fire FROM fires f JOIN c ON c.user_id = f.user_id AND c.t >= f.fire + 86400.0 GROUP BY f.user_id)"


def voted(spark, sf_dir):
    return sequence.vote(scored(spark, sf_dir), "user_id", ["t", "event_id"], "hit")


def fires(spark, sf_dir):
    return sequence.refractory(voted(spark, sf_dir), "user_id", "t", "event_id", DAY)


@query(f"WITH {_VOTED} SELECT event_id, user_id, voted FROM voted")
def vote_m_of_n(spark, sf_dir):
    return voted(spark, sf_dir).select("event_id", "user_id", "voted")


@query(f"WITH RECURSIVE {_FIRES} SELECT f.user_id, round(fire, 6) AS fire, min(c.event_id) AS fired_tie FROM fires f JOIN c ON c.user_id = f.user_id AND c.t = f.fire GROUP BY f.user_id, fire")
def refractory_detections(spark, sf_dir):
    return fires(spark, sf_dir).withColumn("fire", F.round("fire", 6))


@query(f"WITH RECURSIVE {_FIRES}, h AS (SELECT (max(t) - min(t)) / 3600.0 AS hours FROM scored), n AS (SELECT count(*) AS k FROM fires) SELECT k, round(hours, 6) AS hours, round(k / hours, 6) AS rate, round(CASE WHEN k > 0 THEN k * pow(1 - 1 / (9.0 * k) - 1.96 / (3 * sqrt(k)), 3) ELSE 0.0 END / hours, 6) AS low, round((k + 1) * pow(1 - 1 / (9.0 * (k + 1)) + 1.96 / (3 * sqrt(k + 1)), 3) / hours, 6) AS high FROM h, n")
def detections_per_hour(spark, sf_dir):
    hours = scored(spark, sf_dir).agg(((F.max("t") - F.min("t")) / HOUR).alias("hours"))
    k = fires(spark, sf_dir).agg(F.count("*").alias("k"))  # one row against one
    return evaluation.rate_interval(k.join(F.broadcast(hours)), "k", "hours").withColumn("hours", F.round("hours", 6))


@query(f"WITH RECURSIVE {_FIRES}, s AS (SELECT event_id, user_id, t AS onset, t + 21600.0 AS offs FROM scored WHERE event_type = 'signup'), m AS (SELECT s.event_id, s.user_id, min(f.fire) AS first_fire, min(offs) AS offs FROM s LEFT JOIN fires f ON f.user_id = s.user_id AND f.fire BETWEEN s.onset AND s.offs + 1500.0 GROUP BY s.event_id, s.user_id) SELECT event_id, user_id, first_fire IS NOT NULL AS detected, round(first_fire - offs, 6) AS latency FROM m")
def span_match_latency(spark, sf_dir):
    s = scored(spark, sf_dir).where("event_type = 'signup'").select("event_id", "user_id", F.col("t").alias("onset"), (F.col("t") + 21_600.0).alias("offs"))
    return sequence.spans_matched(s, fires(spark, sf_dir), "user_id", "onset", "offs", "fire", 1500.0).select("event_id", "user_id", "detected", "latency")


_DAYS = "d AS (SELECT DISTINCT user_id, CAST(floor(epoch_us(ts) / 86400000000) AS BIGINT) AS day FROM events)"


@query(f"WITH {_DAYS}, n AS (SELECT *, CASE WHEN day - lag(day) OVER (PARTITION BY user_id ORDER BY day) > 2 THEN 1 ELSE 0 END AS new FROM d), r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY day) AS run FROM n), g AS (SELECT user_id, run, min(day) AS start, max(day) AS stop, max(day) - min(day) + 1 AS length FROM r GROUP BY user_id, run) SELECT user_id, start, stop, length FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY length DESC, start) AS k FROM g) WHERE k = 1")
def islands_longest_run(spark, sf_dir):
    d = table(spark, sf_dir, "events").select("user_id", F.floor(epoch_micros("ts") / 86_400_000_000).cast("long").alias("day")).distinct()
    return sequence.longest_island(d, "user_id", "day", 2)


@query("WITH m AS (SELECT user_id, event_id, value < 40 AS z FROM events), i AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, z ORDER BY event_id) AS island FROM m), r AS (SELECT user_id, z, island, count(*) AS n FROM i GROUP BY user_id, z, island) SELECT user_id, coalesce(max(n) FILTER (WHERE z), 0) AS longest FROM r GROUP BY user_id")
def zero_run(spark, sf_dir):
    return sequence.longest_zero_run(table(spark, sf_dir, "events"), "user_id", ["event_id"], "value < 40")


@query("WITH l AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem), g AS (SELECT l_orderkey, greatest(l_linenumber - coalesce(lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) + 1, 1), 0) AS g FROM l) SELECT l_orderkey, count(*) FILTER (WHERE g > 0) AS gaps, CAST(sum(g) AS BIGINT) AS lost FROM g GROUP BY l_orderkey")
def sequence_gaps(spark, sf_dir):
    return sequence.sequence_gaps(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct(), "l_orderkey", "l_linenumber", 1)


@query("WITH r AS (SELECT user_id, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY value) AS a, row_number() OVER (PARTITION BY user_id ORDER BY value DESC) AS d, greatest(1, count(*) OVER (PARTITION BY user_id) // 10) AS k FROM events), m AS (SELECT user_id, avg(v) FILTER (WHERE a <= k) AS low, avg(v) FILTER (WHERE d <= k) AS high FROM r GROUP BY user_id) SELECT user_id, round(low, 6) AS low, round(high, 6) AS high, round(10 * log10(greatest(high, 1e-12) / greatest(low, 1e-12)), 6) AS snr_db FROM m")
def decile_snr(spark, sf_dir):
    return sequence.decile_levels(table(spark, sf_dir, "events"), "user_id", "value")


@query("SELECT user_id, coalesce(max(event_id) - max(event_id) FILTER (WHERE value > 100) < 500, false) AS truncated FROM events GROUP BY user_id")
def truncation_test(spark, sf_dir):
    return sequence.truncated(table(spark, sf_dir, "events"), "user_id", "event_id", "value > 100", 500)


@query(f"WITH {_SCORED}, n AS (SELECT user_id, t, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) > 28800 THEN 1 ELSE 0 END AS new FROM scored WHERE hit), r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS run FROM n), p AS (SELECT *, floor((t - min(t) OVER (PARTITION BY user_id, run)) / 86400) AS piece FROM r) SELECT user_id, round(greatest(min(t) - 600, 0), 6) AS start, round(max(t), 6) AS stop, count(*) AS n FROM p GROUP BY user_id, run, piece")
def utterance_ends(spark, sf_dir):
    u = sequence.utterances(scored(spark, sf_dir).where("hit"), "user_id", "t", 28_800.0, DAY, 600.0)
    return u.select("user_id", F.round("start", 6).alias("start"), F.round("stop", 6).alias("stop"), "n")


@query("WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) SELECT user_id, event_id, CAST(n AS INTEGER) AS n FROM r WHERE n >= 49 AND n % 10 = 0")
def cadence_sampling(spark, sf_dir):
    return sequence.cadence(table(spark, sf_dir, "events").select("user_id", "event_id"), "user_id", ["event_id"])


# --- rules, sidecars, bits -----------------------------------------------------------------------


@query("SELECT event_id, concat_ws('+', CASE WHEN value > 300 THEN 'too_loud' END, CASE WHEN value < 0.5 THEN 'too_quiet' END, CASE WHEN event_type = 'error' AND value > 100 THEN 'damaged' END) AS fails, concat_ws('+', CASE WHEN value > 200 THEN 'loud' END, CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) < 5 THEN 'low_k' END) AS warns, CASE WHEN value > 300 OR value < 0.5 OR (event_type = 'error' AND value > 100) THEN 'fail' WHEN value > 200 OR CAST(json_extract_string(props, '$.k') AS INTEGER) < 5 THEN 'warn' ELSE 'ok' END AS status FROM events")
def qc_rule_flags(spark, sf_dir):
    v, k = F.col("value"), F.get_json_object("props", "$.k").cast("int")
    flagged = quality.rule_flags(table(spark, sf_dir, "events"), {"too_loud": v > 300, "too_quiet": v < 0.5, "damaged": (F.col("event_type") == "error") & (v > 100)}, {"loud": v > 200, "low_k": k < 5})
    return flagged.select("event_id", F.concat_ws("+", "fails").alias("fails"), F.concat_ws("+", "warns").alias("warns"), "status")


_TAKES = """t AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'keyword' WHEN 1 THEN 'speech' ELSE 'ambient' END AS content, value * 9 AS span_ms, value / 5 AS snr_db,
CASE WHEN event_id % 41 <> 0 THEN value / 2 - 45 END AS peak_db, event_id % 7 = 0 AS truncated, event_id % 5 <> 0 AS fits, value / 30 AS deviation, value / 20 AS p95, CASE WHEN event_id % 11 = 0 THEN 'nan'::DOUBLE ELSE value / 9 END AS modulation, 's' || (user_id % 9) AS session FROM events),
v AS (SELECT *, CASE WHEN peak_db IS NULL THEN 'too_short_to_assess'
 WHEN content = 'ambient' THEN CASE WHEN deviation > 1.5 OR p95 > 2.7 OR (NOT isnan(modulation) AND modulation > 5) THEN 'speech_detected' ELSE 'usable' END
 WHEN content = 'speech' THEN CASE WHEN snr_db < 6 THEN 'no_speech' WHEN span_ms < 150 THEN 'barely_any' WHEN peak_db < -30 THEN 'too_quiet' ELSE 'usable' END
 WHEN span_ms BETWEEN 250 AND 880 AND fits THEN CASE WHEN peak_db < -30 THEN 'usable_but_quiet' ELSE 'usable' END
 WHEN snr_db < 6 THEN 'no_speech' WHEN truncated THEN 'cut_off' WHEN peak_db < -30 THEN 'too_quiet' WHEN span_ms < 250 THEN 'too_short' WHEN span_ms > 880 THEN 'too_long' ELSE 'does_not_fit' END AS verdict FROM t)"""


def takes(spark, sf_dir):
    """Events as measured takes."""
    v, i = F.col("value"), F.col("event_id")
    t = F.struct((v * 9).alias("span_ms"), (v / 5).alias("snr_db"), F.when(i % 41 != 0, v / 2 - 45).alias("peak_db"), (i % 7 == 0).alias("truncated"), (i % 5 != 0).alias("fits"), (v / 30).alias("deviation"), (v / 20).alias("p95"), F.when(i % 11 == 0, F.lit(float("nan"))).otherwise(v / 9).alias("modulation"))
    content = F.when(i % 3 == 0, "keyword").when(i % 3 == 1, "speech").otherwise("ambient")
    return table(spark, sf_dir, "events").select("event_id", content.alias("content"), t.alias("t"), "value", F.concat(F.lit("s"), (F.col("user_id") % 9).cast("string")).alias("session"))


@query(f"WITH {_TAKES} SELECT event_id, verdict FROM v")
def take_verdict(spark, sf_dir):
    return clip_qc.take_verdicts(takes(spark, sf_dir), "content").select("event_id", "verdict")


@query(f"WITH {_TAKES}, p AS (SELECT session, content, verdict, count(*) AS n, sum(span_ms / 9) AS s FROM v GROUP BY ALL), w AS (SELECT session, content, verdict, n, row_number() OVER (PARTITION BY session, content ORDER BY n DESC, verdict DESC) AS k FROM p WHERE NOT starts_with(verdict, 'usable')), a AS (SELECT session, content, CAST(sum(n) AS BIGINT) AS n_takes, CAST(coalesce(sum(n) FILTER (WHERE starts_with(verdict, 'usable')), 0) AS BIGINT) AS n_usable, round(coalesce(sum(s) FILTER (WHERE starts_with(verdict, 'usable')), 0.0), 6) AS usable_seconds FROM p GROUP BY session, content) SELECT a.session, a.content, n_takes, n_usable, usable_seconds, w.verdict AS top_reason, coalesce(w.n, 0) AS n_top FROM a LEFT JOIN w ON w.session = a.session AND w.content = a.content AND k = 1")
def recording_audit(spark, sf_dir):
    return clip_qc.session_tallies(clip_qc.take_verdicts(takes(spark, sf_dir), "content"), "session", "content", "verdict", "value")


@query("SELECT d.doc_id, CASE WHEN e.event_id IS NOT NULL THEN CAST(json_extract_string(e.props, '$.k') AS INTEGER) END AS k, CASE WHEN e.event_id IS NULL THEN 'missing' ELSE 'ok' END AS side_state, CASE WHEN e.event_id IS NOT NULL THEN 'k' || json_extract_string(e.props, '$.k') WHEN regexp_matches(source, '1$') THEN 'ambient' WHEN regexp_matches(source, '[2-4]$') THEN 'speech' ELSE 'keyword' END AS content FROM documents d LEFT JOIN (SELECT * FROM events WHERE event_id % 3 = 0) e ON e.event_id = d.doc_id")
def sidecar_json_join(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    side = table(spark, sf_dir, "events").where("event_id % 3 = 0").select(F.col("event_id").alias("doc_id"), "props")
    out = quality.sidecar(d, side, "doc_id", "props", "k int")
    content = quality.content_class(F.concat(F.lit("k"), F.col("side.k").cast("string")), F.col("source"), {"ambient": "1$", "speech": "[2-4]$"}, "keyword")
    return out.select("doc_id", "side.k", "side_state", content.alias("content"))


@query("SELECT l_returnflag, " + ", ".join(f"bit_or(CAST({c} AS BIGINT)) AS {c}_or, bit_and(CAST({c} AS BIGINT)) AS {c}_and, bit_xor(CAST({c} AS BIGINT)) AS {c}_xor, bool_and({c} % 2 = 1) AS {c}_all_odd, bool_or({c} % 2 = 1) AS {c}_any_odd" for c in ("l_linenumber", "l_partkey")) + " FROM lineitem GROUP BY l_returnflag")
def bit_summary(spark, sf_dir):
    return quality.bits(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linenumber", "l_partkey")


@query("SELECT event_id, round(20 * log10(greatest(value, 1e-12)), 6) AS db, round(2595 * log10(1 + value / 700), 6) AS mel, CASE WHEN event_id % 5 > 0 THEN round(100.0 * (value - event_id % 5 * 25) / (event_id % 5 * 25), 6) END AS drift FROM events")
def level_scalars(spark, sf_dir):
    v = F.col("value")
    return table(spark, sf_dir, "events").select("event_id", F.round(decibels(v), 6).alias("db"), F.round(mel(v), 6).alias("mel"), F.round(scalars.drift_percent(v, F.col("event_id") % 5 * 25), 6).alias("drift"))


# --- arrays --------------------------------------------------------------------------------------


@query("SELECT vec_id, CAST(i AS INTEGER) AS frame, round(list_sum(list_transform(embedding[i * 8 + 1 : i * 8 + 16], lambda x: x::DOUBLE * x::DOUBLE)), 6) AS energy FROM (SELECT vec_id, embedding, unnest(generate_series(0, (len(embedding) - 16) // 8)) AS i FROM embeddings)")
def frame_windows(spark, sf_dir):
    from ..functions.signal import frames

    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(frames(F.col("embedding").cast("array<double>"), 16, 8)).alias("frame", "f"))
    return e.select("vec_id", "frame", F.round(F.aggregate("f", F.lit(0.0), lambda a, x: a + x * x), 6).alias("energy"))


@query("WITH p AS (SELECT vec_id, 20 * log10(greatest(list_max(list_transform(embedding, lambda x: abs(x::DOUBLE))), 1e-12)) AS peak FROM embeddings) SELECT vec_id, round(peak, 6) AS peak_db, round(CASE WHEN peak <= -45 THEN 1.0 ELSE pow(10, (-6 - peak) / 20) END, 6) AS gain FROM p")
def level_gain(spark, sf_dir):
    peak = decibels(F.array_max(F.transform("embedding", lambda x: F.abs(x.cast("double")))))
    e = table(spark, sf_dir, "embeddings").select("vec_id", peak.alias("peak"))
    return e.select("vec_id", F.round("peak", 6).alias("peak_db"), F.round(F.when(F.col("peak") <= -45, 1.0).otherwise(F.pow(F.lit(10.0), (-6 - F.col("peak")) / 20)), 6).alias("gain"))


#: A clip of a second that repeats each vector; 64 samples divide the hop, so all its frames hold the same samples.
_MEL = """WITH w AS (SELECT range AS j, 0.5 - 0.5 * cos(2 * pi() * range / 400) AS w FROM range(400)),
x AS (SELECT vec_id, j, embedding[j % 64 + 1]::DOUBLE * w AS x FROM embeddings, w),
f AS (SELECT vec_id, k, pow(sum(x * cos(2 * pi() * k * j / 512)), 2) + pow(sum(x * sin(2 * pi() * k * j / 512)), 2) AS p FROM x, (SELECT range AS k FROM range(257)) GROUP BY vec_id, k),
e AS (SELECT range AS b, 700 * (pow(10, (2595 * log10(1 + 125 / 700) + range * (2595 * log10(1 + 7500 / 700) - 2595 * log10(1 + 125 / 700)) / 41) / 2595) - 1) AS hz FROM range(42)),
t AS (SELECT m.b - 1 AS b, k, greatest(0, least((k * 31.25 - l.hz) / (m.hz - l.hz), (h.hz - k * 31.25) / (h.hz - m.hz))) AS g FROM e l, e m, e h, (SELECT range AS k FROM range(257)) WHERE m.b = l.b + 1 AND h.b = l.b + 2),
m AS (SELECT vec_id, b, ln(greatest(sum(p * g), 1e-10)) AS m FROM f JOIN t ON t.k = f.k WHERE g > 0 GROUP BY vec_id, b)
"""


def _clips(kernel, n: int):
    import numpy as np

    return lambda x: kernel(x[:, np.arange(n) % x.shape[1]])


@query(_MEL + "SELECT vec_id, frame, CAST(c AS INTEGER) AS coefficient, round(v, 2) + 0.0 AS value FROM (SELECT vec_id, c, sum(m * sqrt(2 / 40) * CASE WHEN c = 0 THEN sqrt(0.5) ELSE 1 END * cos(pi() * c * (b + 0.5) / 40)) AS v FROM m, (SELECT range AS c FROM range(13)) GROUP BY vec_id, c), (SELECT CAST(range AS INTEGER) AS frame FROM range(49))")
def mel_dct_features(spark, sf_dir):
    """49 x 13 features of each vector repeated to a clip of one second."""
    from ..functions import signal

    ship(spark)
    rows = signal.over_clips(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", _clips(signal.features, signal.CLIP), ("frame", "coefficient"), "v")
    return rows.select("vec_id", "frame", "coefficient", F.round("v", 2).alias("value"))


@query(_MEL + "SELECT vec_id, CAST(b AS INTEGER) AS band, round(m, 4) + 0.0 AS level FROM m")
def log_mel_bands(spark, sf_dir):
    """The bands before the cosine transform, of one frame."""
    from ..functions import signal

    ship(spark)
    rows = signal.over_clips(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", _clips(lambda x: signal.log_mel(x)[:, 0], signal.FRAME), ("band",), "v")
    return rows.select("vec_id", "band", F.round("v", 4).alias("level"))


@query("WITH s AS (SELECT vec_id, k // 128 AS slice, k % 128 AS j, embedding[k % 64 + 1]::DOUBLE * (1 + k // 100) * (0.5 - 0.5 * cos(2 * pi() * (k % 128) / 127)) AS x FROM embeddings, (SELECT range AS k FROM range(1024))), f AS (SELECT vec_id, slice, h, sqrt(pow(sum(x * cos(2 * pi() * h * j / 128)), 2) + pow(sum(x * sin(2 * pi() * h * j / 128)), 2)) AS a FROM s, (SELECT range AS h FROM range(65)) GROUP BY vec_id, slice, h), g AS (SELECT vec_id, slice, b, ln(avg(a) + 1e-12) AS v FROM f, (SELECT range AS b FROM range(16)) WHERE h >= floor(b * 65 / 16) AND h < floor((b + 1) * 65 / 16) GROUP BY vec_id, slice, b) SELECT vec_id, CAST(slice * 16 + b AS INTEGER) AS place, round(v - avg(v) OVER (PARTITION BY vec_id), 4) + 0.0 AS value FROM g")
def clip_fingerprint(spark, sf_dir):
    """Fingerprints of clips of 1024 samples that repeat each vector ever louder."""
    import numpy as np

    from ..functions import signal

    ship(spark)

    def kernel(x):
        return signal.fingerprint(np.resize(x, 1024) * (1 + np.arange(1024) // 100))

    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(signal.on_clips(kernel, "array<double>")(F.col("embedding").cast("array<double>"))).alias("place", "v"))
    return rows.select("vec_id", "place", F.round("v", 4).alias("value"))


_I0 = "list_sum(list_transform(range(40), lambda k: pow({0} * {0} / 4, k) / pow(list_product(list_transform(range(1, k + 1), lambda i: i::DOUBLE)), 2)))"


@query(f"""WITH w AS (SELECT range AS k, CASE WHEN range = 0 THEN 1.0 ELSE sin(pi() * range / 3) / (pi() * range / 3) END * {_I0.format("(5 * sqrt(1 - pow(range / 30, 2)))")} / {_I0.format("5.0")} AS h FROM range(-30, 31)), t AS (SELECT k, 2 * h / sum(h) OVER () AS h FROM w),
o AS (SELECT CAST(range AS INTEGER) AS m FROM range(43)), x AS (SELECT vec_id, unnest(range(64)) AS j, unnest(embedding)::DOUBLE AS x FROM embeddings)
SELECT vec_id, m AS place, round(sum(x * h), 6) + 0.0 AS value FROM x JOIN o ON abs(3 * m - 2 * j) <= 30 JOIN t ON t.k = 3 * m - 2 * j GROUP BY vec_id, m""".replace("list_product(list_transform(range(1, k + 1), lambda i: i::DOUBLE))", "gamma(k + 1)"))
def resampled_clips(spark, sf_dir):
    """Vectors as clips at 24 kHz, brought to 16 kHz; the SQL convolves with the filter as it is defined."""
    import numpy as np

    from ..functions import signal

    ship(spark)
    rows = signal.over_clips(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", lambda x: np.stack([signal.rate_changed(c, 24_000) for c in x]), ("place",), "v")
    return rows.select("vec_id", "place", F.round("v", 6).alias("value"))


@query("SELECT vec_id, round(1 / (1 + exp(-(0.25 + list_sum(list_transform(embedding, lambda x, i: x::DOUBLE * ((i - 1) % 7 - 3) / 10))))), 6) AS score FROM embeddings")
def batch_scores(spark, sf_dir):
    """A given linear model over vectors, batch by batch."""
    import numpy as np

    def load():
        weights = (np.arange(64) % 7 - 3) / 10
        return lambda x: 1 / (1 + np.exp(-(0.25 + x @ weights)))

    out = evaluation.batch_scores(table(spark, sf_dir, "embeddings"), "embedding", load, 64)
    return out.select("vec_id", F.round("score", 6).alias("score"))


def _section_sql(sos, source: str, name: str) -> str:
    """CTEs that pass the series ``source`` (vec_id, j, x) through second-order sections, sample by sample."""
    out, previous = [], source
    for k, (b0, b1, b2, a1, a2) in enumerate(sos):
        own = f"{name}{k}"
        step = f"{b0!r}::DOUBLE * s.x + {b1!r}::DOUBLE * r.x1 + {b2!r}::DOUBLE * r.x2 - ({a1!r}::DOUBLE) * r.x - ({a2!r}::DOUBLE) * r.y1"
        out.append(f"{own}_r AS (SELECT vec_id, 0 AS j, {b0!r}::DOUBLE * x AS x, x AS x1, 0::DOUBLE AS x2, 0::DOUBLE AS y1 FROM {previous} WHERE j = 0 UNION ALL SELECT s.vec_id, s.j, {step}, s.x, r.x1, r.x FROM {own}_r r JOIN {previous} s ON s.vec_id = r.vec_id AND s.j = r.j + 1), {own} AS (SELECT vec_id, j, x FROM {own}_r)")
        previous = own
    return ", ".join(out)


def _sections(kind, order, *corners):
    from ..functions import signal

    return [tuple(map(float, s)) for s in signal.sections(kind, order, *corners)]


#: Clips of 640 samples of 16 bits: each vector ten times, the fourth time near silence, the seventh as exact zeros, a constant beneath by label.
_CLIP640 = "raw AS (SELECT vec_id, j, label, CASE WHEN j // 64 = 6 THEN 0 ELSE CAST(round_even(least(greatest(embedding[j % 64 + 1]::DOUBLE * CASE WHEN j // 64 = 3 THEN 0.001 ELSE 0.5 + label END + label * 0.01, -1.0), 32767 / 32768) * 32768, 0) AS BIGINT) END AS q FROM embeddings, (SELECT CAST(range AS INTEGER) AS j FROM range(640))), s0 AS (SELECT vec_id, j, q / 32768.0::DOUBLE AS x FROM raw)"
_DB = "20 * log10(greatest({}, 1e-12))"
_QC = f"""WITH RECURSIVE {_CLIP640}, {_section_sql(_sections('high', 4, 125.0), 's0', 'hp')},
passed AS (SELECT vec_id, avg(x) AS offs, sqrt(avg(x * x)) AS rms FROM hp1 GROUP BY vec_id),
z AS (SELECT vec_id, max(n) AS run FROM (SELECT vec_id, g, count(*) AS n FROM (SELECT vec_id, q, j - row_number() OVER (PARTITION BY vec_id, q = 0 ORDER BY j) AS g FROM raw) WHERE q = 0 GROUP BY vec_id, g) GROUP BY vec_id),
l AS (SELECT vec_id, 100.0 * avg(CAST(e < 1e-5 AS INTEGER)) AS silence FROM (SELECT vec_id, j // 320 AS f, avg(x * x) AS e FROM s0 GROUP BY vec_id, j // 320) GROUP BY vec_id),
m AS (SELECT vec_id, max(label) AS label, sqrt(avg((q / 32768.0) * (q / 32768.0))) AS rms, max(abs(q)) / 32768.0 AS peak, avg(q / 32768.0) AS offs, 100.0 * avg(CAST(abs(q) >= 32767 AS INTEGER)) AS clipped, bool_and(q % 2 = 0) AS even FROM raw GROUP BY vec_id),
k AS (SELECT m.*, coalesce(1000.0 * z.run / 16000, 0) AS zero_run, silence, passed.offs AS passed_offs FROM m LEFT JOIN z ON z.vec_id = m.vec_id JOIN l ON l.vec_id = m.vec_id JOIN passed ON passed.vec_id = m.vec_id)
SELECT vec_id, round({_DB.format('rms')}, 4) AS rms_db, round({_DB.format('peak')}, 4) AS peak_db, round(offs, 6) + 0.0 AS offset_raw, round(passed_offs, 6) + 0.0 AS offset_passed, round(clipped, 4) AS clipped_pct, round(zero_run, 4) AS zero_run_ms, round(silence, 4) AS silence_pct,
concat_ws('+', CASE WHEN clipped > 0.1 THEN 'clipping' END, CASE WHEN zero_run > 3.9 AND silence < 95 THEN 'zero_run' END, CASE WHEN abs(passed_offs) > 0.002 THEN 'offset' END, CASE WHEN even AND {_DB.format('peak')} > -60 THEN 'all_even' END, CASE WHEN abs(offs) > 0.02 THEN 'raw_offset' END, CASE WHEN abs(100.0 * (640 - (636 + label)) / (636 + label)) > 0.4 THEN 'length' END) AS fails,
concat_ws('+', CASE WHEN {_DB.format('rms')} < -40 THEN 'quiet' END, CASE WHEN {_DB.format('rms')} > -6 THEN 'hot' END) AS warns FROM k"""


@query(_QC)
def clip_qc_rules(spark, sf_dir):
    """Measures and rules of clips made of vectors; the bounds of zero runs and lengths are brought down to clips of 40 ms."""
    from ..functions import signal

    ship(spark)
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    e = e.mapInArrow(signal.clips_of_vectors, "vec_id long, label long, samples array<double>").withColumn("rate", F.lit(16_000))
    out = clip_qc.clip_rules(clip_qc.measured(e), expected=636 + F.col("label"), zero_run_ms=3.9, tolerance=0.4)
    m = lambda c, d: F.round(f"m.{c}", d)
    return out.select("vec_id", m("rms_db", 4).alias("rms_db"), m("peak_db", 4).alias("peak_db"), m("offset_raw", 6).alias("offset_raw"), m("offset", 6).alias("offset_passed"), m("clipped_pct", 4).alias("clipped_pct"), m("zero_run_ms", 4).alias("zero_run_ms"), m("silence_pct", 4).alias("silence_pct"), F.concat_ws("+", "fails").alias("fails"), F.concat_ws("+", "warns").alias("warns"))


_CHAIN = f"""WITH RECURSIVE s0 AS (SELECT vec_id, CAST(j AS INTEGER) AS j, embedding[j + 1]::DOUBLE * CASE WHEN vec_id % 4 = 3 THEN 0.0005 ELSE 1 END AS x FROM embeddings, (SELECT range AS j FROM range(64))), {_section_sql(_sections('high', 2, 70.0) + _sections('low', 2, 7600.0), 's0', 'mb')},
g AS (SELECT vec_id, j, vec_id % 5 = 0 AS test, x * CASE WHEN vec_id % 5 <> 0 AND vec_id % 3 = 0 THEN pow(10, (vec_id % 13 - 6) / 20) ELSE 1 END AS x FROM mb1),
p AS (SELECT vec_id, max(abs(x)) AS peak FROM g GROUP BY vec_id), h AS (SELECT g.vec_id, j, test, peak, CASE WHEN NOT test AND peak > 0.99 THEN x * 0.99 / peak ELSE x END AS x FROM g JOIN p ON p.vec_id = g.vec_id),
r AS (SELECT vec_id, {_DB.format('sqrt(avg(x * x))')} AS db FROM h GROUP BY vec_id)
SELECT h.vec_id, h.j AS place, round(CASE WHEN NOT test AND db < -55 AND peak > 1e-6 THEN x * pow(10, least(24, -45 - db) / 20) ELSE x END, 6) + 0.0 AS value, CASE WHEN NOT test AND h.vec_id % 3 = 0 THEN 'mic_band+gain' ELSE 'mic_band' END AS steps FROM h JOIN r ON r.vec_id = h.vec_id"""


@query(_CHAIN)
def augmentation_chain(spark, sf_dir):
    """Each vector as a clip through the chain: every fifth of the test split, every third with a gain, every fourth faint."""
    import numpy as np
    import pandas as pd

    from ..functions import signal

    ship(spark)

    @F.pandas_udf("samples array<double>, steps string")
    def run(v, key):
        out = [signal.augmented(np.asarray(x, float) * (0.0005 if k % 4 == 3 else 1), "test" if k % 5 == 0 else "train", gain_db=float(k % 13 - 6) if k % 3 == 0 else None) for x, k in zip(v, key)]
        return pd.DataFrame({"samples": [x.tolist() for x, _ in out], "steps": [s for _, s in out]})

    e = table(spark, sf_dir, "embeddings").select("vec_id", run(F.col("embedding").cast("array<double>"), F.col("vec_id")).alias("a"))
    return e.select("vec_id", "a.steps", F.posexplode("a.samples").alias("place", "v")).select("vec_id", "place", F.round("v", 6).alias("value"), "steps")


@query("WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE * 20 AS v FROM embeddings), b AS (SELECT vec_id, quantile_cont(v, 0.2) AS floor, max(v) AS high FROM x GROUP BY vec_id) SELECT x.vec_id, count(*) FILTER (WHERE v > floor + greatest(6.0, (high - floor) * 0.35)) AS n_speech, count(*) AS n FROM x JOIN b ON b.vec_id = x.vec_id GROUP BY x.vec_id")
def speech_frames(spark, sf_dir):
    """Frames of the utterance, with vectors as frame levels."""
    from ..functions import signal

    ship(spark)
    run = signal.on_clips(lambda x: int(signal.speech_frames(20 * x).sum()), "long")
    return table(spark, sf_dir, "embeddings").select("vec_id", run(F.col("embedding").cast("array<double>")).alias("n_speech"), F.size("embedding").cast("long").alias("n"))


@query("SELECT CAST(label AS VARCHAR) AS path, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS place, vec_id AS seq, CAST(len(embedding) AS INTEGER) AS n, list_sum(list_transform(embedding, lambda x: CAST(round_even(x::DOUBLE * 1000, 0) AS BIGINT)))::BIGINT AS total FROM embeddings")
def block_captures(spark, sf_dir):
    """Vectors written as captures of framed blocks, one a label, and read back by ranges of whole blocks."""
    from ..sources import blocks

    ship(spark)
    path = shared_path(spark, "captures")
    e = table(spark, sf_dir, "embeddings").select("label", "vec_id", F.transform("embedding", lambda x: F.bround(x.cast("double") * 1000).cast("short")).alias("x"))
    blocks.write_captures(e, path, "label", "vec_id", "x")
    blocks.register(spark)
    got = spark.read.format("framed_blocks").option("path", path).option("bytes_a_partition", 1 << 16).load()
    return got.select("path", "place", "seq", F.size("samples").alias("n"), F.aggregate("samples", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


# --- streams -------------------------------------------------------------------------------------


def _replayed(spark, sf_dir, make, mode: str = "append") -> DataFrame:
    """A streaming query over the events file, run over all that is there, its rows written by each batch and read back."""
    top = shared_path(spark, "streams")
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    out = make(stream)
    query = out.writeStream.outputMode(mode).option("checkpointLocation", f"{top}/state").trigger(availableNow=True).foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{top}/rows/batch={n}")).start()
    query.awaitTermination()
    return spark.read.schema(out.schema).option("recursiveFileLookup", True).parquet(f"{top}/rows")


@query(_SQL["refractory_detections"])
def stream_refractory(spark, sf_dir):
    from ..streaming import stateful

    def make(events):
        rows = events.select("event_id", "user_id", (epoch_micros("ts") / 1e6).alias("t"), (F.col("value") / (F.col("value") + 35) >= 0.6).alias("hit"))
        return stateful.trigger(rows, "user_id", "t", "event_id", "hit", DAY)

    out = _replayed(spark, sf_dir, make)
    return out.select(F.col("stream").alias("user_id"), F.round("fire", 6).alias("fire"), "fired_tie")


@query("WITH g AS (SELECT user_id, greatest(event_id - coalesce(lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) + 1, 0), 0) AS g FROM events) SELECT user_id AS stream, count(*) AS seen, count(*) FILTER (WHERE g > 0) AS gaps, CAST(sum(g) AS BIGINT) AS lost FROM g GROUP BY user_id")
def stream_sequence_loss(spark, sf_dir):
    from ..streaming import stateful

    out = _replayed(spark, sf_dir, lambda events: stateful.loss(events.select("user_id", "event_id"), "user_id", "event_id", "event_id"), "update")
    return out.groupBy("stream").agg(F.max("seen").alias("seen"), F.max("gaps").alias("gaps"), F.max("lost").alias("lost"))


@query("WITH e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, sum(CAST(event_id % 17 = 0 AS INTEGER)) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS part FROM events), g AS (SELECT user_id, coalesce(part, 0) AS part, event_id, greatest(event_id - coalesce(lag(event_id) OVER (PARTITION BY user_id, coalesce(part, 0) ORDER BY event_id) + 1, 0), 0) AS g FROM e) SELECT user_id AS stream, count(*) AS seen, count(*) FILTER (WHERE g > 0) AS gaps, CAST(sum(g) AS BIGINT) AS lost FROM g GROUP BY user_id, part HAVING max(event_id) % 17 = 0")
def stream_last_block(spark, sf_dir):
    """Streams that a flagged row ends: the accounts of those that ended."""
    from ..streaming import stateful

    def make(events):
        return stateful.loss(events.select("user_id", "event_id", (F.col("event_id") % 17 == 0).alias("last")), "user_id", "event_id", "event_id", "last")

    return _replayed(spark, sf_dir, make, "update").where("ended").select("stream", "seen", "gaps", "lost")


@query(f"WITH RECURSIVE {_FIRES}, s AS (SELECT event_id, user_id, t AS onset, t + 21600.0 AS offs FROM scored WHERE event_type = 'signup') SELECT s.event_id, s.user_id, round(fire, 6) AS fire, round(fire - offs, 6) AS latency FROM s JOIN fires f ON f.user_id = s.user_id AND f.fire BETWEEN s.onset AND s.offs + 1500.0")
def stream_latency(spark, sf_dir):
    """A stream of firings against a table of spans."""
    from ..streaming import stateful

    spans = scored(spark, sf_dir).where("event_type = 'signup'").select("event_id", "user_id", F.col("t").alias("onset"), (F.col("t") + 21_600.0).alias("offs"))

    def make(events):
        rows = events.select("event_id", "user_id", (epoch_micros("ts") / 1e6).alias("t"), (F.col("value") / (F.col("value") + 35) >= 0.6).alias("hit"))
        fired = stateful.trigger(rows, "user_id", "t", "event_id", "hit", DAY).select(F.col("stream").alias("user_id"), "fire")
        return stateful.latencies(fired, spans, "user_id", "fire", "onset", "offs", 1500.0)

    return _replayed(spark, sf_dir, make).select("event_id", "user_id", F.round("fire", 6).alias("fire"), F.round("latency", 6).alias("latency"))


# --- comparisons, plans, windows -----------------------------------------------------------------


@query(f"WITH {_SCORED} SELECT truth, score >= 0.5 AS a, value / (value + 60) >= 0.5 AS b, count(*) AS n FROM scored GROUP BY 1, 2, 3")
def model_comparison(spark, sf_dir):
    s = scored(spark, sf_dir)
    one = s.select("event_id", "truth", F.lit("first").alias("model"), "score")
    two = s.select("event_id", "truth", F.lit("second").alias("model"), (F.col("value") / (F.col("value") + 60)).alias("score"))
    return evaluation.compare_models(splits.union([one, two]), "event_id", "model", "score", "truth", ["first", "second"], 0.5)


@query(_CURVE + "SELECT threshold, round(log10(greatest(far, 1e-6)), 6) AS log_far, round(log10(greatest(1 - recall, 1e-6)), 6) AS log_frr FROM curve")
def det_curve(spark, sf_dir):
    return evaluation.det_curve(evaluation.sweep(scored(spark, sf_dir), "score", "truth"))


@query("WITH r AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS frame, value, event_id FROM events), w AS (SELECT user_id, frame, count(*) OVER f AS n, sum(value) OVER f AS total, first_value(value) OVER f AS earliest, last_value(value) OVER f AS latest FROM r WINDOW f AS (PARTITION BY user_id ORDER BY frame ROWS BETWEEN 48 PRECEDING AND CURRENT ROW)) SELECT user_id, frame, round(total, 6) AS total, earliest, latest FROM w WHERE n = 49 AND (frame + 1) % 10 = 0")
def stream_frames(spark, sf_dir):
    """A detector's windows on a stream: the last 49 frames (of one value each), after each tenth."""
    from ..streaming import stateful

    def make(events):
        return stateful.framer(events.select("user_id", "event_id", F.array("value").alias("x")), "user_id", "event_id", "x", 1, 1, ring=49, every=10)

    x = F.col("samples")
    return _replayed(spark, sf_dir, make).select(F.col("stream").alias("user_id"), "frame", F.round(F.aggregate(x, F.lit(0.0), lambda a, v: a + v), 6).alias("total"), x[0].alias("earliest"), x[48].alias("latest"))


@query(_SQL["utterance_ends"])
def stream_utterances(spark, sf_dir):
    """Utterances that silence in event time ends. Rows of no stream, a century later, let the watermark pass the last ones' silence."""
    from ..streaming import stateful

    def make(events):
        rows = events.select("user_id", (epoch_micros("ts") / 1e6).alias("t"), (F.col("value") / (F.col("value") + 35) >= 0.6).alias("hit"))
        ends = events.select(F.lit(None).cast("long").alias("user_id"), (epoch_micros("ts") / 1e6 + 3.2e9).alias("t"))
        return stateful.utterances(rows.where("hit").select("user_id", "t").unionByName(ends), "user_id", "t", 28_800.0, DAY, 600.0)

    out = _replayed(spark, sf_dir, make)
    return out.select(F.col("stream").alias("user_id"), F.round("start", 6).alias("start"), F.round("stop", 6).alias("stop"), "n")


@query(f"WITH RECURSIVE {_FIRES}, s AS (SELECT event_id, user_id, t AS onset, t + 21600.0 AS offs FROM scored WHERE event_type = 'signup'), m AS (SELECT s.event_id, s.user_id, min(f.fire) AS first_fire, min(offs) AS offs FROM s LEFT JOIN fires f ON f.user_id = s.user_id AND f.fire BETWEEN s.onset AND s.offs + 1500.0 GROUP BY s.event_id, s.user_id) SELECT user_id, count(*) AS n, count(first_fire) AS n_detected, round(median(round(first_fire - offs, 6)), 6) AS median_latency FROM m GROUP BY user_id")
def session_latency(spark, sf_dir):
    s = scored(spark, sf_dir).where("event_type = 'signup'").select("event_id", "user_id", F.col("t").alias("onset"), (F.col("t") + 21_600.0).alias("offs"))
    return evaluation.session_latency(sequence.spans_matched(s, fires(spark, sf_dir), "user_id", "onset", "offs", "fire", 1500.0), "user_id")


@query("SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS best FROM embeddings")
def argmax_class(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", evaluation.best_class(F.col("embedding")).alias("best"))


@query("SELECT p_partkey, CAST(take AS INTEGER) AS take FROM (SELECT p_partkey, unnest(generate_series(0, CAST(p_size % 4 AS INTEGER) - 1)) AS take FROM part)")
def plan_grid(spark, sf_dir):
    return splits.plan_grid(table(spark, sf_dir, "part"), F.col("p_size") % 4).select("p_partkey", "take")


@query("SELECT lang AS class, doc_id AS key, 'document' AS origin FROM documents UNION ALL SELECT event_type, event_id, 'event' FROM events UNION ALL SELECT CAST(NULL AS VARCHAR), vec_id, 'vector' FROM embeddings")
def union_of_generators(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("lang").alias("class"), F.col("doc_id").alias("key"), F.lit("document").alias("origin"))
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("class"), F.col("event_id").alias("key"), F.lit("event").alias("origin"))
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), F.lit("vector").alias("origin"))
    return splits.union([d, e, v])


@query("WITH p AS (SELECT event_type, count(*) AS n, avg(value) AS mean, max(value) AS high FROM events GROUP BY event_type), s AS (SELECT event_type, round(n * 0.01 + mean * 2.0 + high * 0.1, 6) AS total FROM p) SELECT event_type, total, CAST(rank() OVER (ORDER BY total DESC) AS BIGINT) AS rank FROM s")
def weighted_ranking(spark, sf_dir):
    p = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.max("value").alias("high"))
    return report.weighted_rank(p, "event_type", {"n": 0.01, "mean": 2.0, "high": 0.1})


@query("SELECT 'purchase' AS event_type FROM events WHERE event_type = 'purchase' GROUP BY ALL HAVING count(DISTINCT event_type) = 1")
def single_heldout(spark, sf_dir):
    return report.single_value(table(spark, sf_dir, "events").where("event_type = 'purchase'"), "event_type")


@query("WITH w AS (SELECT event_type, (CAST(floor(epoch_us(ts) / 7200000000) AS BIGINT) - k) * 7200 AS start FROM events, (SELECT unnest([0, 1, 2]) AS k)) SELECT event_type, start, count(*) AS n FROM w GROUP BY event_type, start")
def sliding_window_counts(spark, sf_dir):
    w = report.sliding_counts(table(spark, sf_dir, "events").select("event_type", "ts"), "event_type", "ts", "6 hours", "2 hours")
    return w.select("event_type", F.floor(epoch_micros("start") / 1_000_000).cast("long").alias("start"), "n")


# --- reports of evaluation --------------------------------------------------------------------------

_TIERS = {"positives - real": "truth AND NOT synthetic", "positives - synthetic": "truth AND synthetic", "views": "event_type = 'view'", "clicks": "event_type = 'click'", "errors": "event_type = 'error'", "signups": "event_type = 'signup'", "refunds": "event_type = 'refund'"}
_WILSON = "round(greatest(0.0, (p + z * z / (2 * n)) / (1 + z * z / n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)), 6) AS low, round(least(1.0, (p + z * z / (2 * n)) / (1 + z * z / n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)), 6) AS high"


@query(f"WITH {_SCORED}, s AS (SELECT *, user_id % 3 = 0 AS synthetic FROM scored), r AS (" + " UNION ALL ".join(f"SELECT '{k}' AS subset, score, user_id, props FROM s WHERE {v}" for k, v in _TIERS.items()) + f"), c AS (SELECT subset, starts_with(subset, 'positives') AS pos, count(*) AS n, count(*) FILTER (WHERE score >= 0.5) AS fired, count(DISTINCT user_id || '|' || props) AS u FROM r GROUP BY subset), w AS (SELECT *, CASE WHEN pos THEN fired ELSE n - fired END AS k, k / n AS p, 1.96 AS z FROM c) SELECT subset, n, fired, CASE WHEN pos THEN 'recall' ELSE 'correct_reject' END AS metric, k, round(p, 6) AS rate, {_WILSON}, CASE WHEN pos THEN u END AS n_utterances FROM w")
def evaluation_tiers(spark, sf_dir):
    s = scored(spark, sf_dir).withColumn("synthetic", F.col("user_id") % 3 == 0)
    return evaluation.tiers(s, {k: F.expr(v) for k, v in _TIERS.items()}, ["positives - real", "positives - synthetic"], "score", 0.5, ["user_id", "props"])


@query(f"WITH {_SCORED}, b AS (SELECT 'first' AS model, truth, score FROM scored UNION ALL SELECT 'second', truth, value / (value + 60) FROM scored), g AS (SELECT round(0.05::DOUBLE * range, 2) AS threshold FROM range(1, 20)), c AS (SELECT model, threshold, count(*) FILTER (WHERE truth AND score >= threshold) AS k, count(*) FILTER (WHERE truth) AS n, count(*) FILTER (WHERE NOT truth AND score >= threshold) AS fa, count(*) FILTER (WHERE NOT truth) AS m FROM b, g GROUP BY ALL), w AS (SELECT *, k / n AS p, 1.96 AS z FROM c) SELECT model, threshold, round(p, 6) AS recall, {_WILSON}, round(fa / m, 6) AS far FROM w")
def model_curves(spark, sf_dir):
    s = scored(spark, sf_dir)
    both = splits.union([s.select(F.lit("first").alias("model"), "truth", "score"), s.select(F.lit("second").alias("model"), "truth", (F.col("value") / (F.col("value") + 60)).alias("score"))])
    return evaluation.model_curves(both, "model", "score", "truth")


@query(f"WITH {_SCORED}, r AS (SELECT user_id, truth, rank() OVER (PARTITION BY user_id ORDER BY score) + (count(*) OVER (PARTITION BY user_id, score) - 1) / 2.0 AS r FROM scored), s AS (SELECT user_id, count(*) FILTER (WHERE truth) AS n_positive, count(*) FILTER (WHERE NOT truth) AS n_other, sum(r) FILTER (WHERE truth) AS r FROM r GROUP BY user_id) SELECT user_id, n_positive, n_other, CASE WHEN n_positive > 0 AND n_other > 0 THEN round((r - n_positive * (n_positive + 1) / 2) / (n_positive * n_other), 6) ELSE 'nan'::DOUBLE END AS auc FROM s")
def auc_by_tier(spark, sf_dir):
    return evaluation.auc(scored(spark, sf_dir), "user_id", "score", "truth")


@query("WITH x AS (SELECT vec_id, label, unnest(generate_series(1, len(embedding))) - 1 AS dim, unnest(embedding)::DOUBLE AS v FROM embeddings), n AS (SELECT dim, avg(v) AS m, greatest(stddev_pop(v), 1e-6) AS s FROM x WHERE vec_id % 5 < 3 GROUP BY dim), c AS (SELECT x.dim, avg(v) FILTER (WHERE label = 0) AS ma, avg(v) FILTER (WHERE label = 1) AS mb, var_samp(v) FILTER (WHERE label = 0) AS va, var_samp(v) FILTER (WHERE label = 1) AS vb, count(v) FILTER (WHERE label = 0) AS na, count(v) FILTER (WHERE label = 1) AS nb, avg(round((v - m) / s, 4)) FILTER (WHERE label = 0) AS za, avg(round((v - m) / s, 4)) FILTER (WHERE label = 1) AS zb FROM x JOIN n ON n.dim = x.dim GROUP BY x.dim), d AS (SELECT dim, round((ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)), 6) AS d, za, zb FROM c) SELECT round(avg(abs(d)), 6) AS mean_abs_d, (SELECT CAST(dim AS INTEGER) FROM d ORDER BY abs(d) DESC, dim LIMIT 1) AS worst_dim, round(avg(d) FILTER (WHERE dim >= 40) - avg(d) FILTER (WHERE dim < 16), 6) AS tilt, round(sqrt(avg((zb - za) * (zb - za))), 6) AS displacement FROM d")
def domain_shift(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("dim", "x")).withColumn("x", F.col("x").cast("double"))
    z = evaluation.znorm(e, "dim", "x", "vec_id % 5 < 3").groupBy("dim").agg(F.avg(F.when(F.col("label") == 0, F.col("z"))).alias("za"), F.avg(F.when(F.col("label") == 1, F.col("z"))).alias("zb"))
    return evaluation.shift_report(evaluation.cohens_d(e, "dim", "x", "label", 0, 1).join(z, "dim"), "dim", "d", "za", "zb", 16, 40)


@query(f"WITH RECURSIVE {_FIRES}, s AS (SELECT user_id, t AS onset, t + 21600.0 AS offs FROM scored WHERE event_type = 'signup') SELECT f.user_id, count(*) AS n_fires, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.user_id = f.user_id AND f.fire BETWEEN s.onset AND s.offs + 1500.0)) AS n_spurious FROM fires f GROUP BY f.user_id")
def spurious_firings(spark, sf_dir):
    s = scored(spark, sf_dir).where("event_type = 'signup'").select("user_id", F.col("t").alias("onset"), (F.col("t") + 21_600.0).alias("offs"))
    return sequence.spurious(s, fires(spark, sf_dir).select("user_id", "fire"), "user_id", "onset", "offs", "fire", 1500.0)


_QA = f"""WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, sha256(text) AS content, lang = 'en' AS positive, doc_id % 7 = 0 AS synthetic, CASE lang WHEN 'en' THEN 'keyword' WHEN 'de' THEN 'unknown' ELSE 'background' END AS target,
 'type' || CAST(doc_id % 3 AS VARCHAR) AS source_type, CASE WHEN doc_id % 7 <> 0 THEN 's' || CAST(doc_id % 40 AS VARCHAR) ELSE '' END AS speaker, 'licence' || CAST(doc_id % 4 AS VARCHAR) AS licence, CASE WHEN doc_id % 11 = 0 THEN 'gain' || CAST(doc_id % 13 AS VARCHAR) ELSE 'none' END AS augmentation,
 n_chars / 10.0 AS level, CASE WHEN doc_id % 5 > 0 THEN n_chars % 97 END AS snr, n_chars % 500 AS onset, {_SPLIT_DOC} AS split FROM documents),
t AS (SELECT count(*) AS n, count(*) FILTER (WHERE target = 'keyword') AS kw, count(*) FILTER (WHERE positive AND NOT synthetic) AS real_positives, count(*) FILTER (WHERE split = 'test') AS test, count(*) FILTER (WHERE split = 'test' AND positive) AS test_positives, count(*) FILTER (WHERE split = 'test' AND synthetic) AS synthetic_test, count(*) FILTER (WHERE split = 'test' AND synthetic AND positive) AS synthetic_positives_test, count(*) FILTER (WHERE split = 'test' AND augmentation <> 'none') AS augmented_test FROM d),
v AS (SELECT 'level' AS f, level::DOUBLE AS x FROM d UNION ALL SELECT 'snr', snr FROM d WHERE snr IS NOT NULL UNION ALL SELECT 'onset', onset FROM d WHERE positive),
l AS (SELECT f, list(x ORDER BY x) AS x, count(*) AS n FROM v GROUP BY f),
p AS (SELECT f, unnest(['min', 'p25', 'med', 'p75', 'max']) AS q, unnest([x[1], x[least(n, CAST(floor(0.25 * n) AS BIGINT) + 1)], x[least(n, CAST(floor(0.5 * n) AS BIGINT) + 1)], x[least(n, CAST(floor(0.75 * n) AS BIGINT) + 1)], x[n]]) AS x FROM l)
SELECT 'summary' AS block, unnest(['clips', 'seconds']) AS key, unnest([n, n])::VARCHAR AS value FROM t
UNION ALL SELECT 'model target', 'negatives for ten positives', (10 * (n - kw) // greatest(kw, 1))::VARCHAR FROM t
UNION ALL SELECT 'real and synthetic', 'real positives', real_positives::VARCHAR FROM t
UNION ALL SELECT 'diversity', 'voices', count(DISTINCT source)::VARCHAR FROM d WHERE source <> '' UNION ALL SELECT 'diversity', 'voices of positives', count(DISTINCT source)::VARCHAR FROM d WHERE source <> '' AND positive UNION ALL SELECT 'diversity', 'speakers', count(DISTINCT speaker)::VARCHAR FROM d WHERE speaker <> ''
UNION ALL SELECT 'leakage', 'hashes crossing splits', count(*)::VARCHAR FROM (SELECT content FROM d GROUP BY content HAVING count(DISTINCT split) > 1) UNION ALL SELECT 'leakage', 'duplicate clips', (count(*) - count(DISTINCT content))::VARCHAR FROM d
UNION ALL SELECT 'leakage', 'voices crossing splits', count(*)::VARCHAR FROM (SELECT source FROM d WHERE source <> '' GROUP BY source HAVING count(DISTINCT split) > 1) UNION ALL SELECT 'leakage', 'speakers crossing splits', count(*)::VARCHAR FROM (SELECT speaker FROM d WHERE speaker <> '' GROUP BY speaker HAVING count(DISTINCT split) > 1)
UNION ALL SELECT 'leakage', unnest(['synthetic in test', 'synthetic positives in test', 'augmented in test', 'test size', 'test positives']), unnest([synthetic_test, synthetic_positives_test, augmented_test, test, test_positives])::VARCHAR FROM t
UNION ALL SELECT 'class balance', lang, count(*)::VARCHAR FROM d GROUP BY lang UNION ALL SELECT 'class balance', lang || ' per mille', (1000 * count(*) // (SELECT n FROM t))::VARCHAR FROM d GROUP BY lang
UNION ALL SELECT 'model target', target, count(*)::VARCHAR FROM d GROUP BY target UNION ALL SELECT 'model target', target || ' per mille', (1000 * count(*) // (SELECT n FROM t))::VARCHAR FROM d GROUP BY target
UNION ALL SELECT 'splits', s, (SELECT count(*) FROM d WHERE split = s)::VARCHAR FROM (SELECT unnest(['train', 'validation', 'test']) AS s) UNION ALL SELECT 'splits', split || '|' || lang, count(*)::VARCHAR FROM d GROUP BY split, lang
UNION ALL SELECT 'real and synthetic', CASE WHEN synthetic THEN 'synthetic' ELSE 'real' END, count(*)::VARCHAR FROM d GROUP BY synthetic UNION ALL SELECT 'real and synthetic', 'type ' || source_type, count(*)::VARCHAR FROM d GROUP BY source_type
UNION ALL SELECT 'licences', source || '|' || licence, count(*)::VARCHAR FROM d GROUP BY source, licence
UNION ALL SELECT * FROM (SELECT 'augmentation', augmentation, count(*)::VARCHAR FROM d GROUP BY augmentation ORDER BY count(*) DESC, augmentation LIMIT 10)
UNION ALL SELECT 'levels', f || '|' || q, round(x, 3)::VARCHAR FROM p WHERE f <> 'onset' UNION ALL SELECT 'onset', q, round(x, 3)::VARCHAR FROM p WHERE f = 'onset' AND q IN ('min', 'med', 'max')"""


@query(_QA)
def quality_report(spark, sf_dir):
    """The report in eleven blocks: each document a clip, its length as levels and as the keyword's place."""
    d = splits.hash_split(table(spark, sf_dir, "documents"), "doc_id", "clip")
    named = lambda prefix, n: F.concat(F.lit(prefix), (F.col("doc_id") % n).cast("string"))
    d = d.select(
        "split", "lang", "source", F.sha2("text", 256).alias("content"), (F.col("lang") == "en").alias("positive"), (F.col("doc_id") % 7 == 0).alias("synthetic"), splits.member({"en": "keyword", "de": "unknown"}, F.col("lang"), "background").alias("target"),
        named("type", 3).alias("source_type"), F.when(F.col("doc_id") % 7 != 0, named("s", 40)).alias("speaker"), named("licence", 4).alias("licence"), F.when(F.col("doc_id") % 11 == 0, named("gain", 13)).otherwise("none").alias("augmentation"),
        (F.col("n_chars") / 10).alias("level"), F.when(F.col("doc_id") % 5 > 0, F.col("n_chars") % 97).alias("snr"), (F.col("n_chars") % 500).alias("onset"),
    )
    roles = report.Roles(cls="lang", target="target", split="split", positive="positive", synthetic="synthetic", source_type="source_type", voice="source", speaker="speaker", corpus="source", license="licence", augmentation="augmentation", onset="onset", content="content", levels=("level", "snr"))
    return report.qa_report(d, roles)


@query(f"""WITH RECURSIVE l AS (SELECT doc_id AS k, CASE WHEN doc_id % 6 > 0 AND doc_id % 35 > 0 THEN doc_id - 1 ELSE doc_id END AS up FROM documents), r AS (SELECT k, up FROM l UNION SELECT r.k, l.up FROM r JOIN l ON l.k = r.up),
o AS (SELECT k AS doc_id, min(up) AS origin FROM r GROUP BY k) SELECT doc_id, origin, {_SPLIT_DOC.replace("doc_id", "origin")} AS split FROM o""")
def inherited_splits(spark, sf_dir):
    """Splits along chains of copies: a document was made from the one before it, unless it is one of each sixth or each thirty-fifth."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.when((F.col("doc_id") % 6 > 0) & (F.col("doc_id") % 35 > 0), F.col("doc_id") - 1).alias("source"))
    of = catalogue.origins(d, "doc_id", "source")
    return splits.hash_split(of, "origin", "clip").select("doc_id", "origin", "split")


@query("""WITH b AS (SELECT doc_id, lang, list_filter([CASE WHEN NOT n_chars BETWEEN 30 AND 8000 THEN 'QC-1' END, CASE WHEN NOT coalesce(lang IN ('en', 'de', 'fr'), true) THEN 'QC-2' END, CASE WHEN NOT n_chars % 9 > 0 THEN 'QC-3' END, CASE WHEN NOT contains(text, 'e') THEN 'QC-4' END], lambda x: x IS NOT NULL) AS b FROM documents)
SELECT doc_id, array_to_string(b, '+') AS broken, CASE WHEN list_contains(b, 'QC-1') OR list_contains(b, 'QC-4') THEN 'reject' WHEN list_contains(b, 'QC-3') THEN 'reclassified' WHEN list_contains(b, 'QC-2') THEN 'flag' ELSE 'ok' END AS verdict, CASE WHEN list_contains(b, 'QC-3') THEN 'partial' ELSE lang END AS lang FROM b""")
def rule_catalogue(spark, sf_dir):
    """Documents by a catalogue of four rules."""
    rules = [("QC-1", "n_chars between 30 and 8000", "reject"), ("QC-2", "lang in ('en', 'de', 'fr')", "flag"), ("QC-3", "n_chars % 9 > 0", "as:partial"), ("QC-4", "contains(text, 'e')", "reject")]
    out = catalogue.checked(table(spark, sf_dir, "documents"), spark.createDataFrame(rules, "rule string, holds string, action string"), "lang")
    return out.select("doc_id", F.array_join("broken", "+").alias("broken"), "verdict", "lang")


# --- plans, sets and scalars ------------------------------------------------------------------------


@query("""WITH w AS (SELECT CASE WHEN NOT starts_with(coalesce(props, ''), '{') THEN 'no props' WHEN try_cast(json_extract_string(props, '$.k') AS INTEGER) IS NULL THEN 'no number' WHEN try_cast(json_extract_string(props, '$.k') AS INTEGER) % 10 = 3 THEN 'marked' WHEN coalesce(value, 0) < 1 THEN 'too low' ELSE '' END AS why FROM events),
n AS (SELECT count(*) AS "read", count(*) FILTER (WHERE why = '') AS kept, count(*) FILTER (WHERE why = 'no props') AS a, count(*) FILTER (WHERE why = 'no number') AS b, count(*) FILTER (WHERE why = 'marked') AS c, count(*) FILTER (WHERE why = 'too low') AS d FROM w)
SELECT unnest(['read', 'kept', 'no props', 'no number', 'marked', 'too low']) AS reason, unnest(["read", kept, a, b, c, d]) AS n FROM n""")
def decode_drops(spark, sf_dir):
    """How many events were read, kept, and dropped by which reason, counted in the pass that writes the kept ones."""
    k = F.try_to_number(F.get_json_object("props", "$.k"), F.lit("9999999"))
    reasons = {"no props": ~F.coalesce("props", F.lit("")).startswith("{"), "no number": k.isNull(), "marked": k % 10 == 3, "too low": F.coalesce("value", F.lit(0)) < 1}
    return quality.drop_counts(table(spark, sf_dir, "events"), reasons, "events")[1]


_SPLIT_CHECK = f"""WITH d AS (SELECT doc_id, source, 's' || CAST(doc_id % 40 AS VARCHAR) AS session, doc_id % 7 <> 0 AS real, sha256(text) AS content, {_SPLIT_DOC} AS split FROM documents),
s AS (SELECT session AS item, string_agg(DISTINCT split, '+' ORDER BY split) AS splits FROM d GROUP BY session), r AS (SELECT source AS item, string_agg(DISTINCT split, '+' ORDER BY split) AS splits FROM d WHERE real AND source <> '' GROUP BY source)
SELECT 'sessions by split' AS "check", item, splits FROM s UNION ALL SELECT 'sessions in several splits', item, splits FROM s WHERE contains(splits, '+') UNION ALL SELECT 'held-out sessions', item, splits FROM s WHERE contains(splits, 'test')
UNION ALL SELECT 'held-out sessions that leak', item, splits FROM s WHERE contains(splits, 'test') AND contains(splits, '+') UNION ALL SELECT 'real speakers by split', item, splits FROM r
UNION ALL SELECT 'contents crossing splits', '', CAST(count(*) AS VARCHAR) FROM (SELECT content FROM d GROUP BY content HAVING count(DISTINCT split) > 1)"""


@query(_SPLIT_CHECK)
def split_check(spark, sf_dir):
    d = clips(spark, sf_dir).withColumn("real", ~F.col("synthetic"))
    return report.split_check(d, "session", "source", "real", "content", "split")


@query("WITH r AS (SELECT s_suppkey, s_nationkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS n, count(*) OVER (PARTITION BY s_nationkey) AS size FROM supplier) SELECT s_suppkey, s_nationkey, CASE WHEN (n - 1) % 5 < 3 THEN 'train' WHEN (n - 1) % 5 = 3 THEN 'validation' ELSE 'test' END AS split FROM r UNION ALL SELECT s_suppkey, s_nationkey, 'validation' FROM r WHERE size < 4 AND n = 1 UNION ALL SELECT s_suppkey, s_nationkey, 'test' FROM r WHERE size < 5 AND n = least(size, 3)")
def pool_fallback(spark, sf_dir):
    return splits.pools(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), "s_nationkey", ["s_suppkey"])


@query("SELECT doc_id, row_number() OVER (ORDER BY sha256('shuffle' || CAST(doc_id AS VARCHAR)), doc_id) - 1 AS position FROM documents")
def seeded_shuffle(spark, sf_dir):
    return splits.shuffled(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", "shuffle").select("doc_id", "position")


@query("SELECT p_partkey, model, CAST(take AS INTEGER) AS take FROM part, (VALUES ('one', 4), ('two', 2), ('three', 1)) m(model, k), (SELECT range AS take FROM range(4)) WHERE take < k")
def plan_product(spark, sf_dir):
    return splits.product(table(spark, sf_dir, "part").select("p_partkey"), splits.shares(6, {"one": 7.0, "two": 3.0, "three": 0.2}))


@query("SELECT DISTINCT user_id FROM events WHERE event_type = 'view' EXCEPT SELECT user_id FROM events WHERE event_type = 'signup' AND value > 20")
def undeclared_ids(spark, sf_dir):
    """Users that are seen but not among those that signed up with a value over 20."""
    e = table(spark, sf_dir, "events")
    return splits.difference(e.where("event_type = 'view'"), e.where("event_type = 'signup' and value > 20"), ["user_id"])


@query("SELECT doc_id, 'clips/' || lang || '/' || doc_id || '.wav' AS path FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE 'clips/en/' || l.doc_id || '.wav' = 'clips/' || d.lang || '/' || d.doc_id || '.wav')")
def existing_files(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("clips/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".wav")).alias("path"))
    listing = table(spark, sf_dir, "labels").select(F.concat(F.lit("clips/en/"), F.col("doc_id").cast("string"), F.lit(".wav")).alias("path"))
    return splits.existing(d, F.col("path"), listing)


@query("SELECT p_partkey, p_type FROM part WHERE p_size <= 25 AND p_type IN (SELECT p_type FROM part WHERE p_partkey < 4)")
def protocol_blocks(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_type", F.when(F.col("p_size") <= 25, "positive").otherwise("negative").alias("kind"))
    names = [r["p_type"] for r in p.where("p_partkey < 4").select("p_type").distinct().collect()]  # three rows
    return splits.chosen_blocks(p, "p_type", "kind", only=names, positives_only=True).select("p_partkey", "p_type")


@query("SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g'), '\\s{2,}', ' ', 'g'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS plain, array_to_string(regexp_extract_all(text, '(?m)^([A-Z][a-z]+)', 1), '+') AS heads FROM documents")
def text_scalars(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", scalars.ascii_only(F.col("text")).alias("plain"), F.concat_ws("+", scalars.found_all(F.col("text"), "^([A-Z][a-z]+)")).alias("heads"))


def _seed_sql(key: str, size: int) -> str:
    turned = " || ".join(f"substr(h, {2 * k + 1}, 2)" for k in reversed(range(size)))
    return f"CAST(CAST('0x' || {turned} AS UBIGINT) AS VARCHAR)"


@query(f"SELECT doc_id, {_seed_sql('h', 8)} AS seed8, {_seed_sql('h', 4)} AS seed4 FROM (SELECT doc_id, sha256('20260910|' || CAST(doc_id AS VARCHAR)) AS h FROM documents)")
def hash_seeds(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", scalars.seed(F.col("doc_id"), "20260910|").cast("string").alias("seed8"), scalars.seed(F.col("doc_id"), "20260910|", 4).cast("string").alias("seed4"))


@query("SELECT p_partkey, 16000 // gcd(16000, p_size * 100 + 50) AS up, (p_size * 100 + 50) // gcd(16000, p_size * 100 + 50) AS down FROM part")
def resample_ratio(spark, sf_dir):
    rate = (F.col("p_size") * 100 + 50).cast("long")
    p = table(spark, sf_dir, "part").select("p_partkey", rate.alias("r"), scalars.gcd(F.lit(16_000), rate).alias("g"))
    return p.select("p_partkey", F.expr("16000 div g").alias("up"), F.expr("r div g").alias("down"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso, strftime(ts, '%Y%m%d_%H%M%S') AS stamp, CASE WHEN event_id % 7 > 0 THEN round(value, 1) END AS level, round(CASE WHEN event_id % 9 > 0 THEN 100.0 * (value * 1000 / (event_id % 9) - 16000) / 16000 ELSE -100.0 END, 4) AS deviation FROM events")
def record_scalars(spark, sf_dir):
    v, k = F.col("value"), F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", scalars.iso_utc(F.col("ts")).alias("iso"), scalars.stamp(F.col("ts")).alias("stamp"), scalars.blank_rounded(F.when(k % 14 == 0, F.lit(float("nan"))).when(k % 7 > 0, v)).alias("level"), F.round(scalars.deviation_percent(v * 1000, (k % 9) * 1_000_000), 4).alias("deviation"))


@query("SELECT l_orderkey, l_linenumber, l_partkey & 255 AS low, l_partkey >> 8 AS high, l_partkey & 1 <> 0 AS overrun, l_partkey & 2 <> 0 AS first, l_partkey & 4 <> 0 AS last FROM lineitem")
def bit_scalars(spark, sf_dir):
    k = F.col("l_partkey")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", k.bitwiseAND(F.lit(255)).alias("low"), F.shiftright(k, 8).alias("high"), *scalars.flags(k, overrun=1, first=2, last=4))


@query("SELECT event_id, round(700 * (pow(10, value / 2595) - 1), 6) AS hertz, round(10 * log10(value * value + 1e-12), 6) AS energy_db, round(exp(value / 500) + ln(1 + value) + sqrt(value) + abs(value - 50) + sign(value - 50) + sin(value) + cos(value), 6) AS mix FROM events")
def math_scalars(spark, sf_dir):
    v = F.col("value")
    mix = F.exp(v / 500) + F.log(1 + v) + F.sqrt(v) + F.abs(v - 50) + F.sign(v - 50) + F.sin(v) + F.cos(v)
    return table(spark, sf_dir, "events").select("event_id", F.round(scalars.hertz(v), 6).alias("hertz"), F.round(scalars.energy_decibels(v * v), 6).alias("energy_db"), F.round(mix, 6).alias("mix"))
