import math
import wave

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewater.functions import scalars, signal
from tidewater.operators import clip_qc, evaluation, gate, quality, report, sequence, splits
from tidewater.sources import blocks, clips, manifest
from tidewater.streaming import stateful

COLUMNS = "content string, voice string, speaker string, session string, text string, synthetic boolean, positive boolean, augmentation string, split string"


def clean():
    """A manifest without defects: 300 train rows, 120 test positives of one session."""
    out = [(f"h{i}", f"v{i}", f"p{i}", "", f"t{i}", True, i % 2 == 0, "gain", "train") for i in range(300)]
    return out + [(f"g{i}", f"w{i}", "heldout", "s9", f"u{i}", False, True, "none", "test") for i in range(120)]


def checks(spark, rows):
    df = spark.createDataFrame(rows, COLUMNS)
    return {r["check"]: r["severity"] for r in gate.gate(df, "content", "voice", "speaker", "session", "text", "synthetic", "positive", "augmentation", exempt="SPK_PILOT").collect() if r["severity"] != "ok"}


def change(row, **new):
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    return tuple(new.get(n, v) for n, v in zip(names, row))


MUTATIONS = {
    "hash_in_two_splits": lambda r: [*r, change(r[0], voice="x1", speaker="x1", split="validation")],
    "duplicates_within_split": lambda r: [*r, *(change(r[0], voice=f"x{i}", speaker=f"x{i}", text=f"x{i}") for i in range(9))],
    "voice_in_two_splits": lambda r: [*r, change(r[0], content="x", speaker="x", split="validation")],
    "speaker_in_two_splits": lambda r: [*r, change(r[0], content="x", voice="x", split="validation")],
    "session_in_test_and_elsewhere": lambda r: [*r, change(r[0], content="x", voice="x", speaker="x", session="s9")],
    "synthetic_positive_in_test": lambda r: [*r, change(r[-1], content="x", voice="x", text="x", synthetic=True)],
    "augmented_in_test": lambda r: [*r, change(r[-1], content="x", voice="x", text="x", augmentation="mic_band+gain")],
}


@pytest.mark.parametrize("name", sorted(MUTATIONS))
def test_one_defect_fails_one_check(spark, name):
    found = checks(spark, MUTATIONS[name](clean()))
    found.pop("voice_text_in_two_splits", None) if name == "voice_in_two_splits" else None
    assert found == {name: "fail"}


def test_a_clean_manifest_passes(spark):
    assert checks(spark, clean()) == {}


def test_exempt_prefix_and_warnings(spark):
    rows = [change(r, voice="SPK_PILOT1", speaker="SPK_PILOT1", text=f"t{i}") for i, r in enumerate(clean()[:300])]
    few = lambda n: rows + [change(r, voice="SPK_PILOT1", speaker="SPK_PILOT1") for r in clean()[300 : 300 + n]]
    assert checks(spark, few(19)) == {"very_few_test_positives": "warn", "one_short_test_session": "warn"}
    assert checks(spark, few(20)) == checks(spark, few(99)) == {"few_test_positives": "warn"}
    assert checks(spark, few(100)) == {}
    none = [change(r, positive=False) for r in few(30)]
    assert checks(spark, none) == {"test_without_positives": "fail", "very_few_test_positives": "warn", "one_short_test_session": "warn"}
    assert checks(spark, rows) == {"test_empty": "fail"}


def test_duplicates_are_held_against_all_rows(spark):
    """Four duplicates among 200 rows are no more than 2 % of them, though 8 % of their split; five are."""
    rows = [change(r, content=f"c{i}", voice=f"v{i}", speaker=f"s{i}", text=f"t{i}") for i, r in enumerate((clean()[:1] * 50) + (clean()[-1:] * 150))]
    for n, found in ((4, {}), (5, {"duplicates_within_split": "fail"})):
        assert checks(spark, [change(r, content="same") if i <= n else r for i, r in enumerate(rows)]) == found


def test_gate_raises(spark):
    df = spark.createDataFrame([("a", 1, "fail")], "check string, n_bad long, severity string")
    with pytest.raises(ValueError, match="a"):
        gate.enforce(df)


@pytest.mark.parametrize("k, n, low, high", [(0, 54, 0.0, 0.066), (11, 54, 0.118, 0.329), (349, 599, 0.543, 0.621)])
def test_wilson(spark, k, n, low, high):
    a, b = scalars.wilson(F.lit(k), F.lit(n))
    r = spark.range(1).select(F.round(a, 3), F.round(b, 3)).first()
    assert tuple(r) == (low, high)


def test_poisson(spark):
    a, b = scalars.poisson(F.lit(2))
    r = spark.range(1).select(F.round(a * 6, 2), F.round(b * 6, 2)).first()
    assert tuple(r) == (1.35, 43.33)


def test_undefined_ratios(spark):
    r = evaluation.binary_metrics(spark.createDataFrame([(False, False)], "y boolean, p boolean"), "y", "p").first()
    assert r["precision"] == 0 and math.isnan(r["recall"]) and math.isnan(r["f1"]) and r["far"] == 0


def test_sweep_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    s, y = np.round(rng.random(500), 3), rng.random(500) < 0.3
    got = evaluation.sweep(spark.createDataFrame([(float(a), bool(b)) for a, b in zip(s, y)], "s double, y boolean"), "s", "y").collect()
    assert len(got) == 190
    for r in got:
        assert (r["tp"], r["fp"]) == (int((y & (s >= r["threshold"])).sum()), int((~y & (s >= r["threshold"])).sum()))


def test_numbering_is_total(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"))
    got = [tuple(r) for r in splits.numbered(df, ["k"]).orderBy("position").collect()]
    assert got == [(i, i) for i in range(1000)]


def test_heldout_takes_the_largest_that_is_small_enough(spark):
    df = spark.createDataFrame([("a",)] * 6 + [("b",)] * 3 + [("c",)] * 2, "g string")
    assert splits.heldout_choice(df, "g").first()["g"] == "b"


def test_island_and_zero_runs(spark):
    df = spark.createDataFrame([(1, i) for i in (0, 1, 2, 10, 11, 12, 30)], "s int, i int")
    assert tuple(sequence.longest_island(df, "s", "i", 3).first()) == (1, 0, 2, 3)
    runs = spark.createDataFrame([(1, i, v) for i, v in enumerate([0, 0, 1, 0, 0, 0, 1])], "s int, i int, v int")
    assert sequence.longest_zero_run(runs, "s", ["i"], "v = 0").first()["longest"] == 3


def test_hold_depends_on_what_fired(spark):
    df = spark.createDataFrame([(1, float(t), t, True) for t in (0, 600, 1100, 1700, 2200)], "s int, t double, k long, voted boolean")
    assert [r["fire"] for r in sequence.refractory(df, "s", "t", "k", 1000).orderBy("fire").collect()] == [0, 1100, 2200]


def test_near_vectors_equal_all_pairs(spark):
    r = np.random.default_rng(5)
    centres = r.normal(size=(6, 8))
    v = np.concatenate((r.normal(size=(150, 8)), centres[r.integers(0, 6, 150)] + r.normal(size=(150, 8)) * 0.05, np.repeat(r.normal(size=(1, 8)), 100, axis=0)))
    rows = spark.createDataFrame([(i, x.tolist(), "clash") for i, x in enumerate(v)] + [(999, None, "none")], "k long, v array<double>, id string")
    unit = v - v.mean(axis=0)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    cosine = unit @ unit.T
    for threshold, block in ((0.7, 50), (0.98, 30), (0.0, 100), (0.98, 2000)):
        got = {(x["a"], x["b"]): x["cosine"] for x in quality.near_vectors(rows, "k", "v", threshold, block).collect()}
        want = {(i, j) for i in range(len(v)) for j in range(i) if cosine[i, j] >= threshold}
        assert {(b, a) for a, b in got} == want and len(want) > 4000
        assert all(abs(x - cosine[k]) < 1e-9 for k, x in got.items())
    assert quality.near_vectors(rows.limit(0), "k", "v", 0.9).count() == 0


def test_near_vectors_visit_few_pivots(spark):
    """At a high threshold a row goes to few places: here under a tenth of rows times blocks."""
    r = np.random.default_rng(6)
    v = r.normal(size=(40, 16))[r.integers(0, 40, 4000)] + r.normal(size=(4000, 16)) * 0.02
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "k long, v array<double>")
    dealt, _ = quality._dealt(rows, "k", "v", 0.99, 100)
    assert 4000 <= dealt.count() < 0.1 * 4000 * 40


@pytest.mark.parametrize("moved", [0, 10**9])
def test_near_vectors_meet_in_bounded_groups(spark, monkeypatch, moved):
    """Whether rows visit pivots or all parts meet, no group grows with the rows, and every pair is found once."""
    monkeypatch.setattr(quality, "MOVED", moved, raising=False)
    v = np.random.default_rng(7).normal(size=(3000, 8))
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "k long, v array<double>")
    dealt, _ = quality._dealt(rows, "k", "v", 0.8, 100)
    groups = dealt.groupBy(*(c for c in dealt.columns if c not in ("id", "v", "part"))).count()
    assert groups.agg(F.max("count")).first()[0] <= 400 and dealt.where("part < 0").isEmpty() == (moved > 0)
    unit = v - v.mean(axis=0)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    want = {(int(i), int(j)) for i, j in zip(*np.nonzero(np.triu(unit @ unit.T >= 0.8, 1)))}
    found = quality.near_vectors(rows, "k", "v", 0.8, 100).toArrow()
    got = list(zip(found["a"].to_pylist(), found["b"].to_pylist()))
    assert len(got) == len(want) and set(got) == want


def test_clips_come_in_small_batches(spark):
    """Neither the making of clips nor their measuring gets more at once where a table is larger."""
    v = pa.array([[0.5, -0.25, 2.0, 0.125] * 16] * 3000)
    batch = pa.RecordBatch.from_arrays([pa.array(range(3000)), pa.array([1] * 3000), v], ["vec_id", "label", "v"])
    made = list(signal.clips_of_vectors(iter([batch])))
    assert max(len(b) for b in made) <= signal.VECTORS and sum(len(b) for b in made) == 3000
    x = np.array(made[-1].column("samples")[0].as_py())
    want = np.resize(v[0].as_py(), 640) * np.repeat(np.where(np.arange(10) == 3, 0.001, 1.5), 64) + 0.01
    want[384:448] = 0
    assert (x == np.clip(want, -1.0, 32767 / 32768)).all()

    signal_rows = spark.range(6000, numPartitions=1).select(F.array_repeat(F.lit(0.25), 640).alias("samples"))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(1 << 30))
    clip_qc.measured(signal_rows.withColumn("rate", F.lit(16_000)))
    most = F.pandas_udf(lambda x: pd.Series([len(x)] * len(x)), "long", F.PandasUDFType.SCALAR)
    assert signal_rows.select(most("samples").alias("n")).agg(F.max("n")).first()[0] < 2000


def test_rules_and_quantiles(spark):
    df = spark.createDataFrame([(1, 5.0), (2, None), (3, float("nan"))], "k int, v double")
    got = {r["k"]: r["status"] for r in quality.rule_flags(df, {"big": F.col("v") > 4}, {}).collect()}
    assert got[1] == "fail" and got[2] == "ok"
    q = report.quantile_nearest_rank(df.withColumn("g", F.lit(1)), "g", "v", [0.5]).first()
    assert (q["n"], q["p50"]) == (1, 5.0)


def test_wav_round_trip(spark, tmp_path):
    x = np.sin(np.arange(1600) / 10) * 0.5
    (tmp_path / "a.wav").write_bytes(clips.write_wav(x))
    (tmp_path / "bad.wav").write_bytes(b"RIFFxxxxWAVE")
    with wave.open(str(tmp_path / "a.wav")) as w:
        assert (w.getframerate(), w.getnframes()) == (16000, 1600)
    got = {r["stem"]: r for r in clips.decoded(clips.scan(spark, str(tmp_path))).withColumn("h", clips.header_rate(F.col("content"))).collect()}
    assert got["bad"]["samples"] is None and got["a"]["rate"] == got["a"]["h"] == 16000
    assert np.abs(np.array(got["a"]["samples"]) - x).max() < 1e-4


def test_blocks_resynchronise():
    a, b, c = blocks.encode(0, [1, 2], blocks.FIRST), blocks.encode(1, [3]), blocks.encode(3, [4], blocks.LAST)
    got = list(blocks.decode(b"??" + a + b"SIH" + b + c + a))
    assert [(g[0], g[5]) for g in got] == [(0, [1, 2]), (1, [3]), (3, [4])] and got[0][6] == 2


def test_block_files_in_batch_and_stream(spark, tmp_path):
    one = blocks.encode(0, [1, 2], blocks.FIRST) + b"??" + blocks.encode(3, [3], blocks.OVERRUN) + blocks.encode(4, [4], blocks.LAST) + blocks.encode(5, [9])
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.bin").write_bytes(one)
    (tmp_path / "in" / "y.bin").write_bytes(blocks.encode(7, list(range(700))) + blocks.encode(8, [1]))
    batch = blocks.scan(spark, str(tmp_path / "in"))
    got = {r["path"][-5:]: r for r in blocks.accounts(batch).collect()}
    x = got["x.bin"]
    assert (x["blocks"], x["samples"], x["gaps"], x["lost"], x["overruns"], x["skipped"], x["resyncs"], x["ended"]) == (3, 4, 1, 2, 1, 2, 1, True)
    assert (got["y.bin"]["blocks"], got["y.bin"]["lost"], got["y.bin"]["ended"]) == (2, 0, False)
    rows = stateful.replay(blocks.stream(spark, str(tmp_path / "in")), spark, str(tmp_path / "c"), "blocks_out")
    assert sorted(map(tuple, rows.drop("samples").collect())) == sorted(map(tuple, batch.drop("samples").collect()))


def test_manifest_keeps_null_and_nan_apart(spark, tmp_path):
    (tmp_path / "m.csv").write_text("clip_id,synthetic,snr_db,measured_snr_db,keyword_onset_ms,split,class\na,true,,nan,-0.1,train,x\nb,false,oops,3.5,12,test,y\n")
    rows = {r["clip_id"]: r for r in manifest.read_csv(spark, str(tmp_path / "m.csv")).collect()}
    assert rows["a"]["snr_db"] is None and math.isnan(rows["a"]["measured_snr_db"]) and rows["a"]["onset_missing"] and rows["a"]["keyword_onset_ms"] is None
    assert rows["b"]["snr_db"] is None and rows["b"]["synthetic"] is False and rows["a"]["text"] is None


def test_content_key_ignores_order(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "a int, b string")
    b = spark.createDataFrame([(2, None), (1, "x")], "a int, b string")
    assert manifest.content_key(a, ["a", "b"], "v1") == manifest.content_key(b, ["a", "b"], "v1") != manifest.content_key(b, ["a"], "v1")
    assert manifest.content_key(a, ["b"], "v1", ["a"]) == manifest.content_key(b, ["b"], "v1", ["a"]) != manifest.content_key(a.withColumn("a", -F.col("a")), ["b"], "v1", ["a"])


def test_probe_tells_groups_apart(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=4) + (i % 2) * 3 * (i % 3 == 0)).tolist(), i % 2) for i in range(300)]
    df = spark.createDataFrame(rows, "k long, v array<double>, g int")
    far = [r["accuracy"] for r in evaluation.separability(df.where("k % 3 = 0"), "k", "v", "g", 0, 1).collect()]
    near = [r["accuracy"] for r in evaluation.separability(df.where("k % 3 > 0"), "k", "v", "g", 0, 1).collect()]
    assert len(far) == 5 and np.mean(far) > 0.95 and np.mean(near) < 0.65


def test_masks_of_features():
    x = np.arange(12.0).reshape(4, 3)
    out = signal.masked(x, (1, 2), (2, 1))
    assert (out[1:3] == x.mean()).all() and (out[:, 2] == x.mean()).all() and (out[[0, 3], :2] == x[[0, 3], :2]).all() and x[1, 0] == 3


def test_features_of_silence_and_gain():
    x = np.random.default_rng(5).normal(size=16000) * 0.1
    f = signal.features(x)
    assert f.shape == (49, 13) and f.dtype == np.float32
    assert np.abs(signal.features(x * 0.5) - signal.with_gain(f, 0.5)).max() < 1e-3
    assert np.allclose(signal.features(np.zeros(10))[:, 0], np.sqrt(40) * np.log(1e-10), rtol=1e-5)
    assert float(signal.level_gain(-50.0)) == 1.0 and math.isclose(float(signal.level_gain(-12.0)), 10 ** (6 / 20))


def test_mix_reaches_its_ratio():
    rng = np.random.default_rng(6)
    s, n = rng.normal(size=4000), rng.normal(size=1000)
    added = signal.mixed(s, n, 6.0) - s
    assert math.isclose(10 * np.log10(np.mean(s**2) / np.mean(added**2)), 6.0, abs_tol=1e-6)
    assert signal.placed(np.ones(3), -1, 4).tolist() == [1, 1, 0, 0]
    assert signal.mixed(s, np.zeros(9), 6.0) is s and signal.mixed(s, s[:0], 6.0) is s


def by_sample(x, sos):
    for b0, b1, b2, a1, a2 in sos:
        out, x1, x2, y1, y2 = np.zeros(len(x)), 0.0, 0.0, 0.0, 0.0
        for i, v in enumerate(x):
            out[i] = b0 * v + b1 * x1 + b2 * x2 - a1 * y1 - a2 * y2
            x2, x1, y2, y1 = x1, v, y1, out[i]
        x = out
    return x


def gain_at(sos, hertz):
    z = np.exp(-2j * np.pi * hertz / signal.RATE)
    return abs(np.prod([(b0 + z * (b1 + z * b2)) / (1 + z * (a1 + z * a2)) for b0, b1, b2, a1, a2 in sos]))


@pytest.mark.parametrize("kind, order, corners", [("high", 4, (125.0,)), ("band", 4, (300.0, 3400.0)), ("high", 2, (70.0,)), ("low", 2, (7600.0,))])
def test_filters_are_causal_and_fall_at_their_corners(kind, order, corners):
    sos, x = signal.sections(kind, order, *corners), np.random.default_rng(8).normal(size=1500)
    assert np.abs(signal.filtered(x, sos) - by_sample(x, sos)).max() < 1e-9
    assert all(math.isclose(gain_at(sos, c), math.sqrt(0.5), rel_tol=1e-9) for c in corners)
    assert signal.filtered(x[:0], sos).size == 0 and (signal.high_pass(x[:31]) == x[:31]).all()


def tone(hertz, n=16000, level=0.3):
    return level * np.sin(2 * np.pi * hertz * np.arange(n) / signal.RATE)


def test_band_shares_follow_tones():
    for hertz, place in ((50, 0), (1000, 1), (6000, 2)):
        got = signal.band_shares(tone(hertz) + 0.2)
        assert got[place] > 0.99 and abs(got[3] - hertz) < 20 and sum(got[:3]) < 1.01
    assert signal.band_shares(np.zeros(4000)) == signal.band_shares(tone(50, 511)) == (0.0, 0.0, 0.0, 0.0)
    a, b = signal.band_shares(tone(200)), signal.band_shares(tone(3600))
    assert max(a[:3]) < 0.01 and max(b[:3]) < 0.01  # between the bands


def test_snr_is_of_mean_energies():
    x = np.repeat([1.0, 10.0], 16000)
    x[::2] *= -1
    assert math.isclose(signal.decile_snr(x), 20.0) and math.isnan(signal.decile_snr(x[:3199])) and math.isnan(signal.decile_snr(np.zeros(4000)))


def spoken(begin=8000, end=14000, n=48000, level=0.3):
    """Room noise with a tone of the speech band between two places."""
    x = np.random.default_rng(9).normal(size=n) * 0.001
    x[begin:end] += tone(900, end - begin, level)
    return x


def test_speech_is_found_and_extracted():
    x = spoken()
    a, b = signal.speech_bounds(x)
    assert abs(a - 8000) <= 320 and abs(b - 14000) <= 480 and abs(signal.speech_span(x) - (b - a) / 16) < 1e-9
    assert len(signal.extracted(x)) == b - a + 2 * 640
    gap = spoken()
    gap[10000:11500] = gap[20000:21500]  # 94 ms do not end the run
    assert abs(signal.speech_span(gap) - signal.speech_span(x)) <= 10
    gap[10000:12500] = gap[20000:22500]  # 156 ms do
    assert signal.speech_span(gap) < 160
    assert signal.speech_bounds(x[:1000]) is None and signal.speech_span(x[:1000]) == 0.0 and signal.extracted(x[:1000]) is None
    assert signal.longest_run(np.array([1, 2, 30, 31, 32, 60])) == (30, 32) and signal.longest_run(np.array([5, 6, 40, 41])) == (5, 6)


def test_modulation_tells_syllables_from_hum():
    t = np.arange(600) / 100
    assert signal.modulation(np.sin(2 * np.pi * 4 * t)) > 20 > -20 > signal.modulation(np.sin(2 * np.pi * 30 * t))
    assert math.isnan(signal.modulation(t[:31]))
    x, n = np.random.default_rng(3).normal(size=300), 128
    w, f = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n), np.arange(65) * 100 / n
    power = np.zeros(65)
    for a in range(0, 300 - n + 1, 64):
        own = (x[a : a + n] - x[a : a + n].mean()) * w
        power += [2 * abs(sum(own * np.exp(-2j * np.pi * k * np.arange(n) / n))) ** 2 / (100 * (w**2).sum()) for k in range(65)]
    power /= 3
    want = 10 * np.log10((power[(f >= 2) & (f <= 8)].mean() + 1e-12) / (power[(f >= 20) & (f <= 45)].mean() + 1e-12))
    assert math.isclose(signal.modulation(x), want, rel_tol=1e-9)


def test_speed_trim_and_levels():
    x = tone(500, 1600)
    assert np.abs(signal.resampled(x, 800)[40:-40] - x[::2][40:-40]).max() < 0.01 and len(signal.sped(x, 1.25)) == 1280 and signal.sped(x, 1.0005) is x
    y = np.concatenate((np.zeros(3200), tone(500, 3200), np.zeros(3200)))
    assert len(signal.trimmed(y)) == 3200 + 2 * 400 and (signal.trimmed(y[:399]) == y[:399]).all()
    assert math.isclose(np.abs(signal.peak_normalised(x)).max(), 10 ** (-3 / 20)) and signal.peak_normalised(x * 0).max() == 0
    assert math.isclose(signal.rms_db(signal.gained(x, 6.0)) - signal.rms_db(x), 6.0)


def test_windows_hold_words_tone_and_parts():
    word, room = np.ones(4000), np.arange(1, 20001.0)
    for u in (0.0, 0.5, 0.999):
        at = signal.place_for(4000, u, 960)
        out = signal.placed(word, at)
        assert 960 <= at <= 16000 - 4000 - 960 and out.sum() == 4000 and len(out) == 16000
        assert set(signal.room_tone(room, (5000, 15000), u)) <= {*room[:5000], *room[15000:]}
        assert signal.room_tone(room[:300], None, u).sum() == 0 and len(signal.room_tone(room, (5000, 15000), u)) == 16000
        for entering in (True, False):
            part = signal.partial(np.arange(1, 4001.0), 0.5, entering, u)
            kept = part[part > 0]
            assert len(kept) == 2000 and kept[0] == (2001 if entering else 1) and len(part) == 16000
        assert len(signal.cropped(room, u)) == 16000 and (np.diff(signal.cropped(room, u)) == 1).all()
        assert signal.cropped(word, u).sum() == 4000
    assert signal.place_for(15900, 0.7, 960) == 50 and signal.place_for(20000, 0.5, 960) == -2000
    assert signal.placed(np.ones(3), 1, 5, np.full(4, 2.0)).tolist() == [2, 3, 3, 3, 0]


def test_augmentation_steps_and_guards():
    x, rng = spoken(), np.random.default_rng(2)
    band, steps = signal.augmented(x, "test", speed=1.05, gain_db=40.0, noise=rng.normal(size=100))
    assert steps == "mic_band" and (band == signal.microphone_band(x)).all()
    loud, steps = signal.augmented(x, "train", speed=1.05, gain_db=40.0, noise=rng.normal(size=100), snr_db=10.0)
    assert steps == "mic_band+speed1.050+gain+noise" and math.isclose(np.abs(loud).max(), 0.99) and len(loud) == round(48000 / 1.05)
    faint, steps = signal.augmented(x * 1e-3, "train")
    assert steps == "mic_band" and math.isclose(signal.rms_db(faint), min(signal.rms_db(band) - 60 + 24, -45.0), abs_tol=0.01)


def test_fingerprints_of_copies_agree():
    x = spoken()
    a, b, c = signal.fingerprint(x), signal.fingerprint(x * 0.5), signal.fingerprint(spoken(20000, 30000))
    cosine = lambda u, v: u @ v / np.linalg.norm(u) / np.linalg.norm(v)
    assert len(a) == 128 and abs(a.mean()) < 1e-9 and cosine(a, b) > 0.9999 > 0.99 > cosine(a, c)
    assert not signal.fingerprint(x[:1023]).any()


GOLDEN = {
    "silence": np.zeros(16000), "offset": np.full(16000, 3000 / 32768), "burst": np.where(abs(np.arange(16000) - 8000) < 4, 0.9, 0.0), "square": np.sign(tone(440)) * 32767 / 32768,
    "noise": np.random.default_rng(1).normal(size=16000) * 0.1, "chirp": np.sin(2 * np.pi * (100 * np.arange(16000) / 16000 + 3450 * (np.arange(16000) / 16000) ** 2)) * 0.5, **{f"tone{h}": tone(h, level=0.25) for h in (125, 1000, 4000, 7500)},
}


def test_golden_features_in_chunks_equal_batch(spark, tmp_path):
    """Every case cut into chunks of any size and framed by a stream gives the features of the whole clip; no case is silence."""
    rng, rows = np.random.default_rng(4), []
    for i, x in enumerate(GOLDEN.values()):
        cuts = np.concatenate(([0], np.sort(rng.integers(0, 16001, 9)), [16000]))
        rows += [(i, k, x[a:b].tolist()) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    spark.createDataFrame(rows, "s long, o long, x array<double>").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("s long, o long, x array<double>").parquet(str(tmp_path / "in"))
    got = {}
    for r in stateful.replay(stateful.framer(stream, "s", "o", "x"), spark, str(tmp_path / "c"), "golden_out").collect():
        got.setdefault(r["stream"], {})[r["frame"]] = r["samples"]
    quiet = signal.features(GOLDEN["silence"])
    for i, (name, x) in enumerate(GOLDEN.items()):
        want = signal.features(x)
        streamed = np.array([signal.log_mel(np.array(got[i][k]))[0] @ signal.tables()[2].T for k in range(49)])
        assert len(got[i]) == 49 and np.abs(streamed - want).max() < 1e-3
        assert name == "silence" or np.abs(want - quiet).max() > 1


def test_ring_of_frames(spark, tmp_path):
    spark.createDataFrame([(1, k, [float(4 * k + j) for j in range(4)]) for k in range(10)], "s long, o long, x array<double>").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("s long, o long, x array<double>").parquet(str(tmp_path / "in"))
    got = stateful.replay(stateful.framer(stream, "s", "o", "x", 4, 2, ring=3), spark, str(tmp_path / "c"), "ring_out").orderBy("frame").collect()
    assert [r["frame"] for r in got] == list(range(2, 19))
    assert got[0]["samples"] == [0, 1, 2, 3, 2, 3, 4, 5, 4, 5, 6, 7]


def test_framer_in_chunks_equals_batch(spark, tmp_path):
    x = np.arange(50.0)
    rows = [(1, i, x[a:b].tolist()) for i, (a, b) in enumerate([(0, 3), (3, 20), (20, 21), (21, 50)])]
    spark.createDataFrame(rows, "s long, o long, x array<double>").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("s long, o long, x array<double>").parquet(str(tmp_path / "in"))
    got = stateful.replay(stateful.framer(stream, "s", "o", "x", 8, 4), spark, str(tmp_path / "c"), "frames_out").orderBy("frame").collect()
    whole = spark.createDataFrame([(x.tolist(),)], "x array<double>").select(signal.frames(F.col("x"), 8, 4)).first()[0]
    assert [r["samples"] for r in got] == whole


def test_corrupted_clips_fail_and_silence_does_not(spark):
    from tidewater.operators import clip_qc

    rng = np.random.default_rng(7)
    good = np.round(rng.normal(size=16000) * np.repeat([200, 3000], 8000)) / 32768
    gap = good.copy()
    gap[9000:10600] = 0
    even = np.round(good * 16384) / 16384
    late = np.append(good[-640:], np.full(20, 0.95))  # a step that the filter has no time to take away
    cases = {"good": good, "clipping": np.clip(good * 40, -1, 32767 / 32768), "raw_offset": good + 0.03, "zero_run": gap, "all_even": even, "silence": np.zeros(16000), "empty": good[:0], "offset": late}
    rows = [(k, v.tolist(), 16000) for k, v in cases.items()] + [("rate", good.tolist(), 8000), ("undecoded", None, None)]
    df = clip_qc.measured(spark.createDataFrame(rows, "k string, samples array<double>, rate int"))
    got = {r["k"]: (r["status"], r["fails"]) for r in clip_qc.clip_rules(df).collect()}
    assert got["good"] == ("ok", []) and got["silence"][1] == []
    for k in set(got) - {"good", "silence"}:
        assert got[k][0] == "fail" and k in got[k][1]


def test_take_verdicts(spark):
    from tidewater.operators import clip_qc

    rows = [("keyword", 500.0, 20.0, -20.0, False, True, 0.0, 0.0, 0.0, "usable"), ("keyword", 100.0, 3.0, -20.0, True, True, 0.0, 0.0, 0.0, "no_speech"), ("keyword", 100.0, 9.0, -20.0, True, True, 0.0, 0.0, 0.0, "cut_off"), ("speech", 100.0, 9.0, -20.0, False, False, 0.0, 0.0, 0.0, "barely_any"), ("ambient", 0.0, 0.0, 0.0, False, False, 2.0, 0.0, 0.0, "speech_detected"), ("ambient", 0.0, 0.0, 0.0, False, False, 1.0, 1.0, float("nan"), "usable")]
    df = spark.createDataFrame(rows, "c string, s double, n double, p double, t boolean, f boolean, d double, q double, m double, want string")
    got = df.select("want", clip_qc.take_verdict(*(F.col(x) for x in "csnptfdqm"), level=-30.0).alias("got")).collect()
    assert all(r["want"] == r["got"] for r in got)


def test_measured_takes(spark):
    from tidewater.operators import clip_qc

    rng = np.random.default_rng(3)
    cases = {"usable": ("keyword", spoken()), "usable_but_quiet": ("keyword", spoken(level=0.02)), "no_speech": ("keyword", rng.normal(size=48000) * 0.001), "too_short": ("keyword", spoken(8000, 10000)), "too_long": ("keyword", spoken(8000, 30000)), "cut_off": ("keyword", spoken(46000, 48000)), "usable speech": ("speech", spoken(8000, 30000)), "barely_any": ("speech", spoken(8000, 9500)), "usable room": ("ambient", rng.normal(size=48000) * 0.001), "speech_detected": ("ambient", spoken()), "too_short_to_assess": ("keyword", spoken()[:3000])}
    df = spark.createDataFrame([(k, c, x.tolist(), 16000) for k, (c, x) in cases.items()], "k string, c string, samples array<double>, rate int")
    got = {r["k"]: r["verdict"] for r in clip_qc.take_verdicts(clip_qc.measured_takes(df), "c").collect()}
    assert got == {k: k.split()[0] for k in cases}


def test_file_sinks(spark, tmp_path):
    x = np.sin(np.arange(800) / 9) * 0.4
    df = spark.createDataFrame([("a/x.wav", x.tolist()), ("b/y.wav", None)], "path string, samples array<double>")
    assert [tuple(r) for r in clips.write_files(df, f"file://{tmp_path}/wavs").collect()] == [("a/x.wav", 1644)]
    back = {r["stem"]: r for r in clips.decoded(clips.scan(spark, f"{tmp_path}/wavs"), channels="raw").collect()}
    assert back.keys() == {"x"} and np.abs(np.array(back["x"]["samples"]) - np.trunc(x * 32767)).max() == 0
    assert bytes(df.where("samples is not null").select(clips.encoded(F.col("samples"))).first()[0]) == clips.write_wav(x)
    stereo = clips.write_wav(np.zeros(4))[:22] + b"\x02\x00" + clips.write_wav(np.zeros(4))[24:44] + np.array([1, 4, -3, -4], "<i2").tobytes()
    assert clips.read_wav(stereo, "whole")[1].tolist() == [2, -3] and clips.read_wav(stereo, "raw")[1].tolist() == [1, 4, -3, -4] and clips.read_wav(stereo, "first")[1].tolist() == [1 / 32768, -3 / 32768]


def test_record_sinks(spark, tmp_path):
    df = spark.createDataFrame([("t1", True, 2.5, None), ("t2", False, None, "a, \"b\"")], "clip string, accepted boolean, snr_db double, notes string")
    manifest.write_json(df, f"{tmp_path}/json")
    assert sorted(map(tuple, spark.read.schema(df.schema).json(f"{tmp_path}/json").collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    for part in (df.limit(1), df.subtract(df.limit(1))):
        manifest.append_ledger(part, f"file://{tmp_path}/ledger")
    text = [r["value"] for r in spark.read.text(f"{tmp_path}/ledger/header").collect()]
    assert len(text) == 1 and text[0].startswith("clip,utc,content") and len(text[0].split(",")) == 20
    got = manifest.read_ledger(spark, f"{tmp_path}/ledger")
    assert sorted(map(tuple, got.select(df.columns).collect())) == sorted(map(tuple, df.collect()))
    rows = spark.createDataFrame([(1, "train", "x"), (2, "test", "y")], "k int, split string, class string")
    manifest.write_parquet(rows, f"{tmp_path}/parts")
    assert spark.read.parquet(f"{tmp_path}/parts").where("split = 'test'").first()["k"] == 2
    manifest.publish_csv(rows, f"{tmp_path}/csv")
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").count() == 2
    assert manifest.cached(rows, f"{tmp_path}/cache").count() == manifest.cached(rows.limit(0), f"{tmp_path}/cache").count() == 2


def test_settings_and_reports(spark):
    assert clips.settings("A=1\n# x\nB = 'two'\nC", {"A": "9", "Z": "0"}, {"C": "3"}) == {"C": "3", "A": "9", "B": "two"}
    df = spark.createDataFrame([("rate_hz=16001.5 overruns=0 ok",)], "t string")
    assert df.select(clips.report_pairs(F.col("t"))).first()[0] == {"rate_hz": "16001.5", "overruns": "0"}


def test_blocks_of_a_protocol(spark):
    df = spark.createDataFrame([("a", "positive"), ("b", "negative"), ("c", "ambient")], "name string, kind string")
    names = lambda **k: sorted(r["name"] for r in splits.chosen_blocks(df, "name", "kind", **k).collect())
    assert names() == ["a", "b", "c"] and names(positives_only=True) == ["a"] and names(negatives_only=True) == ["b", "c"] and names(only=["b", " c "]) == ["b", "c"]
    for bad in ({"positives_only": True, "negatives_only": True}, {"only": ["x"]}):
        with pytest.raises(ValueError):
            names(**bad)


def test_numbers_and_pools_of_groups(spark):
    df = spark.createDataFrame([(g, i) for g, n in (("a", 23), (None, 4), ("b", 1), ("c", 7)) for i in range(n)], "g string, i int")
    assert all(r["number"] == r["i"] + 1 for r in splits.group_numbers(df, ["g"], ["i"]).collect())
    got = {}
    for r in splits.pools(df, "g", ["i"]).collect():
        got.setdefault(r["g"], []).append((r["split"], r["i"]))
    assert sorted(got["b"]) == [("test", 0), ("train", 0), ("validation", 0)]
    assert sorted(got[None]) == [("test", 2), ("train", 0), ("train", 1), ("train", 2), ("validation", 3)]
    assert len(got["a"]) == 23 and len(got["c"]) == 7


def test_difference_and_shares(spark):
    a, b = (spark.createDataFrame([(x,) for x in v], "k string") for v in (["x", "y", "y", None], ["x"]))
    assert {r["k"] for r in splits.difference(a, b, ["k"]).collect()} == {"y", None}
    assert splits.shares(10, {"a": 3.0, "b": 1.0, "c": 0.01}) == {"a": 7, "b": 2, "c": 1}
    assert spark.range(1).select(scalars.now_utc()).first()[0][10:11] == "T"


def test_written_tables_can_be_forgotten(spark):
    from tidewater.functions.tables import collecting, forget, written

    with collecting() as made:
        one, two = written(spark.range(3), "one"), written(spark.range(4), "two")
    forget(spark, made, but=[two.where("id > 0")])
    assert two.count() == 4 and not spark._jvm.java.io.File(made[0].removeprefix("file:").removeprefix("//")).exists()
    del one


def test_a_hold_over_ranges_of_time(spark, monkeypatch):
    """One stream that holds most rows, cut into many ranges; ties, gaps and streams without a name; against the fold row by row."""
    import random

    from tidewater.operators import sequence

    monkeypatch.setattr(sequence, "HOLDS", 3)
    r = random.Random(4)
    rows = [(s, r.choice([float(r.randint(0, 300)), r.random() * 300]), k) for k, s in enumerate([1] * 4000 + [2] * 30 + [None] * 100 + [3])]
    rows += [(4, 1e9 + k * 0.1, 9000 + k) for k in range(500)]
    for hold in (7.0, 0.3, 1000.0, 0.0):
        got = sequence.refractory(spark.createDataFrame(rows, "s long, t double, k long"), "s", "t", "k", hold, "k % 3 > 0").collect()
        want, last = [], {}
        for s, t, k in sorted((x for x in rows if x[2] % 3), key=lambda x: x[1:]):
            if s not in last or t - last[s] >= hold:
                last[s] = t
                want.append((s, t, k))
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_a_hold_on_one_hot_stream(spark):
    """Ten million candidates of one stream are many ranges' work, and what a range passes on is small."""
    import numpy as np

    from tidewater.operators import sequence

    t = np.sort(np.random.default_rng(1).random(1_000_000) * 1e6)
    upper, end = sequence._hold_function(t[t < 64 * 8.0], 8.0)
    assert len(upper) == len(end) < 0.25 * (t < 64 * 8.0).sum()
    rows = spark.range(10_000_000).selectExpr("1 as s", "(id * 7919 % 10000019) / 10.0 as t", "id as k")
    out = sequence.refractory(rows, "s", "t", "k", 8.0, "true")
    t = np.sort(np.arange(10_000_000) * 7919 % 10000019 / 10.0)
    at, want = 0, 0
    while at < len(t):
        at, want = sequence._first_after(t, t[at], 8.0, at + 1), want + 1
    assert out.count() == want > 100_000
    assert out.select(F.spark_partition_id()).distinct().count() > 1


def test_rate_change_equals_its_definition():
    r = np.random.default_rng(7)
    for rate_in, rate_out in ((24_000, 16_000), (16_000, 24_000), (22_050, 16_000), (44_100, 16_000), (8_000, 16_000), (16_000, 16_000)):
        g = np.gcd(rate_in, rate_out)
        up, down = rate_out // g, rate_in // g
        for n in (0, 1, 7, 500):
            x = r.normal(size=n)
            got = signal.rate_changed(x, rate_in, rate_out, at_once=113)
            if up == down or not n:
                assert got.tolist() == x.tolist()
                continue
            half = 10 * max(up, down)
            k = np.arange(-half, half + 1)
            h = np.sinc(k / max(up, down)) * np.kaiser(2 * half + 1, 5.0)
            h *= up / h.sum()
            stuffed = np.zeros(n * up)
            stuffed[::up] = x
            want = np.convolve(stuffed, h)[half : half + n * up : down]
            assert len(got) == len(want) == -(-n * up // down) and np.abs(got - want).max() < 1e-9


def test_rate_change_keeps_tones():
    for rate in (44_100, 22_050, 48_000):
        t = np.arange(rate) / rate
        y = signal.rate_changed(np.sin(2 * np.pi * 1000 * t), rate)
        assert len(y) == 16_000
        spectrum = np.abs(np.fft.rfft(y[2000:-2000] * np.hanning(12_000)))
        assert np.argmax(spectrum) == round(1000 * 12_000 / 16_000) and abs(np.abs(y[2000:-2000]).max() - 1) < 0.01
        if rate > 32_000:  # what the new rate can't hold goes
            assert np.abs(signal.rate_changed(np.sin(2 * np.pi * 11_000 * t), rate)[2000:-2000]).max() < 0.02


def test_kernels_over_batches_of_clips(spark):
    r = np.random.default_rng(3)
    clips = {k: r.normal(size=n).tolist() for k, n in enumerate((16_000, 400, 16_000, 0, 900))}
    rows = spark.createDataFrame([*clips.items(), (9, None)], "id long, x array<double>")
    got = {}
    for x in signal.over_clips(rows, "id", "x", signal.features, ("frame", "coefficient"), "v").collect():
        got.setdefault(x["id"], np.zeros((49, 13)))[x["frame"], x["coefficient"]] = x["v"]
    assert got.keys() == clips.keys()
    for k, x in clips.items():
        assert np.abs(got[k] - signal.features(np.array(x))).max() < 1e-5


def test_drops_are_counted_in_the_pass_that_keeps(spark):
    rows = spark.createDataFrame([(k, None if k % 7 == 0 else k) for k in range(100)], "k int, v int")
    kept, counts = quality.drop_counts(rows, {"none": F.col("v").isNull(), "odd": F.col("v") % 2 == 1})
    assert {x["reason"]: x["n"] for x in counts.collect()} == {"read": 100, "kept": kept.count(), "none": 15, "odd": 43}
    assert kept.columns == ["k", "v"]


def test_batches_of_scores(spark):
    rows = spark.createDataFrame([(k, None if k == 5 else [float(k), 1.0]) for k in range(700)], "k int, x array<double>")

    def load():
        return lambda x: x @ np.array([2.0, 1.0]) + 1000 * (len(x) > 64)

    got = {r["k"]: r["score"] for r in evaluation.batch_scores(rows, "x", load, 2, batch=64).collect()}
    assert got == {k: None if k == 5 else 2.0 * k + 1 for k in range(700)}


def test_a_report_reads_its_records_once(spark, tmp_path):
    from tidewater.operators import report

    spark.range(300).selectExpr("cast(id % 3 as string) c", "'train' s", "id % 2 = 0 p", "id % 5 = 0 y", "id % 11 as l", "cast(id as string) h", "cast(null as string) n").write.parquet(f"{tmp_path}/m")
    seen = []
    listener = report.written
    try:
        report.written = lambda df, what: seen.append(df._jdf.queryExecution().executedPlan().toString()) or listener(df, what)
        out = report.qa_report(spark.read.parquet(f"{tmp_path}/m"), report.Roles("c", "c", "s", "p", "y", "c", "n", "n", "c", "c", "c", "l", "h", ("l",)))
        got = {(r["block"], r["key"]): r["value"] for r in out.collect()}
    finally:
        report.written = listener
    assert sum(p.count(f"{tmp_path}/m") > 0 for p in seen) == 1 and seen[0].count("FileScan") == 1
    assert got["splits", "test"] == "0" and got["diversity", "voices"] == "0" and got["summary", "clips"] == "300"
    assert len({b for b, _ in got}) == 11


def _pitch(x, rate=16_000):
    x = x[2000:-2000]
    return np.argmax(np.abs(np.fft.rfft(x * np.hanning(len(x))))) * rate / len(x)


def test_stretch_keeps_pitch_and_shift_keeps_length():
    t = np.arange(32_000) / 16_000
    tone = np.sin(2 * np.pi * 440 * t)
    for factor in (0.9, 1.1, 1.25, 0.8):
        y = signal.stretched(tone, factor)
        assert len(y) == round(32_000 / factor) and abs(_pitch(y) - 440) < 2
        assert 0.85 < np.sqrt(2) * np.sqrt((y[3000:-3000] ** 2).mean()) < 1.1
    assert signal.stretched(tone, 1.0) is tone and len(signal.stretched(tone[:100], 1.1)) == 100
    for semitones in (-1.0, 1.0):
        y = signal.pitch_shifted(tone, semitones)
        assert len(y) == len(tone) and abs(_pitch(y) - 440 * 2 ** (semitones / 12)) < 2
    click = np.zeros(32_000)
    click[16_000] = 1.0
    assert abs(np.argmax(np.abs(signal.stretched(click, 0.8))) - 20_000) < 300


def test_rooms():
    r = np.random.default_rng(2)
    x, response = r.normal(size=900), np.exp(-np.arange(300) / 40.0) * r.normal(size=300)
    response[25] = 9.0
    y = signal.reverberated(x, response)
    want = np.convolve(x, response)[25 : 25 + 900]
    assert np.abs(y / np.sqrt((y * y).mean()) - want / np.sqrt((want * want).mean())).max() < 1e-9
    assert abs((y * y).mean() - (x * x).mean()) < 1e-9 and signal.reverberated(x, np.array([1.0])).tolist() == pytest.approx(x.tolist())
