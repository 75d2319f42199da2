"""Array kernels over clips: framing, spectra, features, filters, mixing. Numpy inside Arrow batches.

The constants are fixed values of the feature contract: 16 kHz, frames of 400 samples every 320,
512-point spectra, 40 triangular bands from 125 to 7500 Hz, 13 coefficients.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RATE, FRAME, HOP, POINTS, BANDS, COEFFICIENTS, CLIP = 16_000, 400, 320, 512, 40, 13, 16_000
LOW, HIGH, LOG_FLOOR = 125.0, 7500.0, 1e-10


def frames(samples: Column, length: int = FRAME, hop: int = HOP) -> Column:
    """Array of frames, as an expression; no frame if there are fewer samples than one."""
    n = F.floor((F.size(samples) - length) / hop).cast("int")
    return F.when(F.size(samples) >= length, F.transform(F.sequence(F.lit(0), n), lambda i: F.slice(samples, i * hop + 1, length))).otherwise(F.array().cast("array<array<double>>"))


def _mel(f: np.ndarray | float) -> np.ndarray | float:
    return 2595 * np.log10(1 + np.asarray(f) / 700)


@functools.lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Window, band weights (peak 1) and the orthonormal cosine basis."""
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(FRAME) / FRAME)
    edges = 700 * (10 ** (np.linspace(_mel(LOW), _mel(HIGH), BANDS + 2) / 2595) - 1)
    bins = np.arange(POINTS // 2 + 1) * RATE / POINTS
    rise = (bins[None] - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None]
    fall = (edges[2:, None] - bins[None]) / (edges[2:] - edges[1:-1])[:, None]
    bands = np.clip(np.minimum(rise, fall), 0, None)
    k, i = np.arange(COEFFICIENTS)[:, None], np.arange(BANDS)[None]
    basis = np.sqrt(2 / BANDS) * np.cos(np.pi * k * (i + 0.5) / BANDS)
    basis[0] /= np.sqrt(2)
    return window, bands, basis


def _log_mel(cut: np.ndarray) -> np.ndarray:
    window, bands, _ = tables()
    power = np.abs(np.fft.rfft(cut * window, POINTS)) ** 2
    return np.log(np.maximum(power @ bands.T, LOG_FLOOR))


def log_mel(x: np.ndarray) -> np.ndarray:
    """Frames x bands of one signal; clips x frames x bands of a matrix of clips of one length."""
    n = max(0, 1 + (x.shape[-1] - FRAME) // HOP)
    if not n or x.shape[-1] < FRAME:
        return np.zeros((*x.shape[:-1], 0, BANDS))
    return _log_mel(np.lib.stride_tricks.sliding_window_view(x, FRAME, axis=-1)[..., ::HOP, :][..., :n, :])


def features(x: np.ndarray, clip: int = CLIP) -> np.ndarray:
    """Frames x coefficients of a signal padded or cut to ``clip`` samples, or of each clip of a matrix."""
    x = x[..., :clip]
    x = np.pad(x, [(0, 0)] * (x.ndim - 1) + [(0, clip - x.shape[-1])])
    return (log_mel(x) @ tables()[2].T).astype(np.float32)


def level_gain(peak_db: np.ndarray | float, silent: float = -45.0, target: float = -6.0) -> np.ndarray:
    """1 for near-silence, else the gain that brings the peak to the target."""
    p = np.asarray(peak_db, float)
    return np.where(p <= silent, 1.0, 10 ** ((target - p) / 20))


def with_gain(coefficients: np.ndarray, gain: float) -> np.ndarray:
    """Features of the signal times a gain, without recomputing them: only the first coefficient moves."""
    out = np.array(coefficients, np.float32)
    out[:, 0] += np.float32(2 * np.sqrt(BANDS) * np.log(gain))
    return out


@functools.lru_cache(maxsize=32)
def sections(kind: str, order: int, *corners: float, rate: int = RATE) -> np.ndarray:
    """Second-order sections (b0, b1, b2, a1, a2) of a Butterworth filter: ``kind`` is high, low or band, of an even order."""
    warped = [np.tan(np.pi * c / rate) for c in corners]
    angles = np.pi * (2 * np.arange(order // 2) + 1) / (2 * order)
    out = []
    if kind in ("high", "low"):
        k = warped[0]
        for q in 1 / (2 * np.sin(angles)):
            scale = 1 / (1 + k / q + k * k)
            b = scale * (np.array([1, -2, 1]) if kind == "high" else k * k * np.array([1, 2, 1]))
            out.append((*b, 2 * (k * k - 1) * scale, (1 - k / q + k * k) * scale))
        return np.array(out)
    low, high = warped
    for pole in -np.sin(angles) + 1j * np.cos(angles):
        half = pole * (high - low) / 2
        for s in (half + np.sqrt(half * half - low * high), half - np.sqrt(half * half - low * high)):
            z = (1 + s) / (1 - s)
            out.append((*((high - low) / abs(1 - s) ** 2 * np.array([1, 0, -1])), -2 * z.real, abs(z) ** 2))
    return np.array(out)


def filtered(x: np.ndarray, sos: np.ndarray) -> np.ndarray:
    """The causal output of the sections, from rest.

    By one product of spectra: the signal is padded for the time in which the response falls below the precision of a double.
    """
    if not len(x):
        return np.zeros(0)
    radius = max(np.abs(np.roots([1, a1, a2])).max() for *_, a1, a2 in sos)
    n = 1 << int(len(x) + np.ceil(np.log(1e-18) / np.log(min(radius, 1 - 1e-6)))).bit_length()
    z = np.exp(-2j * np.pi * np.arange(n // 2 + 1) / n)
    response = np.prod([(b0 + z * (b1 + z * b2)) / (1 + z * (a1 + z * a2)) for b0, b1, b2, a1, a2 in sos], axis=0)
    return np.fft.irfft(np.fft.rfft(x, n) * response, n)[: len(x)]


def high_pass(x: np.ndarray, corner: float = 125.0, rate: int = RATE) -> np.ndarray:
    """The floor of the band filters on the signal itself, 4th order; fewer than 32 samples stay as they are."""
    return filtered(x, sections("high", 4, corner, rate=rate)) if len(x) >= 32 else np.asarray(x, float)


def speech_band(x: np.ndarray, rate: int = RATE) -> np.ndarray:
    return filtered(x, sections("band", 4, 300.0, min(3400.0, rate / 2 * 0.98), rate=rate))


def microphone_band(x: np.ndarray, low: float = 70.0, high: float = 7600.0, rate: int = RATE) -> np.ndarray:
    """The channel of the microphone: 2nd-order slopes on either side."""
    both = np.concatenate((sections("high", 2, low, rate=rate), sections("low", 2, min(high, rate / 2 * 0.98), rate=rate)))
    return filtered(x, both)


def frame_levels(x: np.ndarray, length: int = 160) -> np.ndarray:
    """Decibels of consecutive frames."""
    n = len(x) // length
    return 10 * np.log10(np.mean(np.square(x[: n * length].reshape(n, length)), axis=1) + 1e-12) if n else np.zeros(0)


def decile_snr(x: np.ndarray, length: int = 320) -> float:
    """Decibels between the mean energies of the loudest and the quietest tenth of frames; NaN for under ten frames or where either is 0."""
    n = len(x) // length
    if n < 10:
        return float("nan")
    energy = np.sort(np.square(x[: n * length].reshape(n, length), dtype=float).mean(axis=1))
    low, high = energy[: n // 10].mean(), energy[n - n // 10 :].mean()
    return float(10 * np.log10(high / low)) if low > 0 and high > 0 else float("nan")


def band_shares(x: np.ndarray, rate: int = RATE) -> tuple[float, float, float, float]:
    """Shares of energy below 100 Hz, at 300 to 3400 Hz and from 4000 Hz on, and the centroid: of the first power of two of samples, at most 65536, without their mean, under a Hann window. All 0 for under 512 samples or silence."""
    if len(x) < 512:
        return 0.0, 0.0, 0.0, 0.0
    n = 1 << (min(len(x), 65536).bit_length() - 1)
    own = x[:n] - np.mean(x[:n])
    power, f = np.abs(np.fft.rfft(own * np.hanning(n))) ** 2, np.fft.rfftfreq(n, 1 / rate)
    total = power.sum()
    if total <= 0:
        return 0.0, 0.0, 0.0, 0.0
    share = lambda where: float(power[where].sum() / total)
    return share(f < 100), share((f >= 300) & (f <= 3400)), share(f >= 4000), float((f * power).sum() / total)


def frame_energies(x: np.ndarray) -> np.ndarray:
    """Decibels of the feature frames."""
    n = 1 + max(0, len(x) - FRAME) // HOP
    x = np.pad(x, (0, max(0, FRAME - len(x))))
    cut = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP][:n]
    return 10 * np.log10(np.mean(np.square(cut), axis=1) + 1e-12)


def speech_frames(levels: np.ndarray) -> np.ndarray:
    """The frames of the utterance: above the 20th percentile by 6 dB, or by 35 % of the way to the maximum if that is more."""
    if not len(levels):
        return np.zeros(0, bool)
    floor = np.percentile(levels, 20)
    return levels > floor + max(6.0, (levels.max() - floor) * 0.35)


# --- speech in a take: frames of 10 ms of the speech band ---------------------------------------

#: The gap (frames) that doesn't end a run, the bar above the floor (dB, or share of the way to the peak).
GAP, ABOVE, WAY = 12, 8.0, 0.35


def envelope(x: np.ndarray, rate: int = RATE) -> np.ndarray:
    """Decibels of the speech band by frames of 10 ms; none for under three frames."""
    levels = frame_levels(speech_band(x, rate), max(1, int(rate * 0.010)))
    return levels if len(levels) >= 3 else np.zeros(0)


def loud_frames(levels: np.ndarray) -> np.ndarray:
    """Places of the frames over the bar, which is relative to the noise floor (the 20th percentile)."""
    if not len(levels):
        return np.zeros(0, np.int64)
    floor = np.percentile(levels, 20)
    return np.flatnonzero(levels > floor + max(ABOVE, (levels.max() - floor) * WAY))


def longest_run(places: np.ndarray) -> tuple[int, int] | None:
    """First and last place of the longest run whose steps are at most ``GAP``; the first of equals."""
    if not len(places):
        return None
    new = np.flatnonzero(np.diff(places) > GAP)
    first, last = places[np.append(0, new + 1)], places[np.append(new, len(places) - 1)]
    k = int(np.argmax(last - first))
    return int(first[k]), int(last[k])


def speech_bounds(x: np.ndarray, rate: int = RATE) -> tuple[int, int] | None:
    """Where the longest run of speech begins and ends, in samples; none in under 100 ms."""
    run = longest_run(loud_frames(envelope(x, rate))) if len(x) >= rate // 10 else None
    step = max(1, int(rate * 0.010))
    return (run[0] * step, min(len(x), (run[1] + 1) * step)) if run else None


def speech_span(x: np.ndarray, rate: int = RATE) -> float:
    """Milliseconds of the longest run of speech."""
    run = longest_run(loud_frames(envelope(x, rate))) if len(x) >= rate // 10 else None
    return (run[1] - run[0] + 1) * 10.0 if run else 0.0


def extracted(x: np.ndarray, rate: int = RATE, pad_ms: float = 40.0) -> np.ndarray | None:
    """Just the spoken word and a little around it."""
    bounds = speech_bounds(x, rate)
    pad = int(rate * pad_ms / 1000)
    return x[max(0, bounds[0] - pad) : min(len(x), bounds[1] + pad)] if bounds else None


def modulation(levels: np.ndarray, rate: float = 100.0) -> float:
    """Decibels of the envelope's mean power at 2 to 8 Hz over that at 20 to 45 Hz (averaged periodograms of 128 frames at most, Hann, half overlapping, means removed); NaN for under 32 frames."""
    if len(levels) < 32:
        return float("nan")
    n = min(128, len(levels))
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    cut = np.lib.stride_tricks.sliding_window_view(levels, n)[:: n - n // 2]
    cut = (cut - cut.mean(axis=1, keepdims=True)) * window
    power = 2 * (np.abs(np.fft.rfft(cut)) ** 2).mean(axis=0) / (rate * np.square(window).sum())
    f = np.fft.rfftfreq(n, 1 / rate)
    syllables, rest = power[(f >= 2) & (f <= 8)].mean(), power[(f >= 20) & (f <= 45)].mean()
    return float(10 * np.log10((syllables + 1e-12) / (rest + 1e-12)))


# --- making clips ---------------------------------------------------------------------------------


def rms_db(x: np.ndarray) -> float:
    return float(20 * np.log10(max(np.sqrt(np.mean(np.square(x))) if len(x) else 0.0, 1e-12)))


def gained(x: np.ndarray, db: float) -> np.ndarray:
    return x * 10 ** (db / 20)


def peak_normalised(x: np.ndarray, target_db: float = -3.0) -> np.ndarray:
    peak = np.abs(x).max(initial=0)
    return x if peak < 1e-9 else gained(x, target_db) / peak


def mixed(signal: np.ndarray, noise: np.ndarray, snr_db: float, offset: int = 0) -> np.ndarray:
    """Signal plus noise, tiled from an offset, at a signal-to-noise ratio; as it is where either is silent."""
    if not len(noise):
        return signal
    tiled = np.take(noise, np.arange(offset, offset + len(signal)), mode="wrap")
    ps, pn = np.mean(signal**2), np.mean(tiled**2)
    return signal + tiled * np.sqrt(ps / (pn * 10 ** (snr_db / 10))) if pn > 1e-12 and ps > 1e-12 else signal


def placed(x: np.ndarray, at: int, length: int = CLIP, bed: np.ndarray | None = None) -> np.ndarray:
    """``x`` in a window of ``length`` from ``at`` on, over silence or a bed that goes on beneath it."""
    out = np.zeros(length) if bed is None else np.pad(bed[:length].astype(float), (0, max(0, length - len(bed))))
    a, b = max(at, 0), min(at + len(x), length)
    if b > a:
        out[a:b] += x[a - at : b - at]
    return out


def place_for(size: int, u: float, margin: int, length: int = CLIP) -> int:
    """Where a word of ``size`` samples begins in the window, by ``u`` in [0, 1): between the margins, or in the middle where they leave no choice. A word that fills the window begins before it, anywhere."""
    if size >= length:
        return -int(u * (size - length + 1))
    low, high = margin, length - size - margin
    return low + int(u * (high - low + 1)) if high > low else max(0, (length - size) // 2)


def room_tone(x: np.ndarray, bounds: tuple[int, int] | None, u: float, length: int = CLIP) -> np.ndarray:
    """A window of a recording's own audio outside the bounds, repeated where it is short; silence under 400 samples."""
    pool = x if bounds is None else np.concatenate((x[: bounds[0]], x[bounds[1] :]))
    if len(pool) < 400:
        return np.zeros(length)
    pool = np.resize(pool, len(pool) * -(-length // len(pool)))
    start = int(u * (len(pool) - length + 1))
    return pool[start : start + length]


def partial(word: np.ndarray, coverage: float, entering: bool, u: float, length: int = CLIP) -> np.ndarray:
    """A window with only a share of a word: its end where the word has begun before the window, else its beginning near the window's end."""
    keep = max(1, int(len(word) * coverage))
    own = (word[len(word) - keep :] if entering else word[:keep])[:length]
    low = 0 if entering else max(0, length - len(own) - 2000)
    return placed(own, low + int(u * (max(low + 1, length - len(own)) - low)), length)


def cropped(x: np.ndarray, u: float, length: int = CLIP) -> np.ndarray:
    """One window of a longer recording, or a shorter one somewhere in silence."""
    start = int(u * (abs(len(x) - length) + 1))
    return x[start : start + length] if len(x) >= length else placed(x, start, length)


def masked(coefficients: np.ndarray, frames: tuple[int, int] = (0, 0), bands: tuple[int, int] = (0, 0)) -> np.ndarray:
    """Features with a run of frames and a run of bands (first, how many) set to the mean of all."""
    out = np.array(coefficients, float)
    out[frames[0] : frames[0] + frames[1]] = out[:, bands[0] : bands[0] + bands[1]] = np.mean(coefficients) if len(coefficients) else 0.0
    return out


def resampled(x: np.ndarray, n: int) -> np.ndarray:
    """``n`` samples over the same time, by the spectrum."""
    if n == len(x) or not len(x):
        return x
    kept = min(n, len(x))
    spectrum = np.zeros(n // 2 + 1, complex)
    spectrum[: kept // 2 + 1] = np.fft.rfft(x)[: kept // 2 + 1]
    if kept % 2 == 0:  # the middle frequency stands for two
        spectrum[kept // 2] *= 2 if n < len(x) else 0.5
    return np.fft.irfft(spectrum, n) * (n / len(x))


#: Fixed values of the rate change: zero crossings of the filter on either side, and the shape of its Kaiser window.
CROSSINGS, SHAPE = 10, 5.0


@functools.lru_cache(maxsize=16)
def _phases(up: int, down: int) -> tuple[np.ndarray, int]:
    """The windowed-sinc low pass by phases: row r has the taps of outputs that lie r of ``up`` steps after an input; and the taps before that input."""
    wide = max(up, down)
    half = CROSSINGS * wide
    k = np.arange(-half, half + 1)
    h = np.sinc(k / wide) * np.kaiser(2 * half + 1, SHAPE)
    h *= up / h.sum()
    before = half // up
    offset = np.arange(up)[:, None] + np.arange(-before - 1, before + 2)[None] * up  # of the output after the input that a tap weighs
    return np.where(np.abs(offset) <= half, h[np.clip(offset + half, 0, 2 * half)], 0.0), before + 1


def rate_changed(x: np.ndarray, rate_in: int, rate_out: int = RATE, at_once: int = 1 << 16) -> np.ndarray:
    """The signal at another rate: inserted zeros, one low pass and every so manieth sample, worked out only for the samples that stay. ceil(n * up / down) samples; beyond the ends is silence."""
    common = math.gcd(rate_in, rate_out)
    up, down = rate_out // common, rate_in // common
    if up == down or not len(x):
        return np.asarray(x, float)
    taps, before = _phases(up, down)
    n = -(-len(x) * up // down)
    padded = np.pad(np.asarray(x, float), (taps.shape[1], taps.shape[1]))
    out = np.empty(n)
    for a in range(0, n, at_once):
        place = np.arange(a, min(a + at_once, n)) * down
        # Tap j weighs the input j - before steps earlier than the one the output follows.
        rows = place // up + taps.shape[1] + before
        out[a : a + len(place)] = np.einsum("ij,ij->i", padded[rows[:, None] - np.arange(taps.shape[1])], taps[place % up])
    return out


def sped(x: np.ndarray, factor: float) -> np.ndarray:
    """Speed and pitch together: ``factor`` above 1 is shorter; within a thousandth of 1 nothing happens."""
    return x if abs(factor - 1) < 1e-3 else resampled(x, max(1, round(len(x) / factor)))


def stretched(x: np.ndarray, factor: float, length: int = 1024, hop: int = 256) -> np.ndarray:
    """Speed without pitch, by a phase vocoder: spectra are read at steps of ``factor`` frames, their phases run on at the pace between neighbouring frames, and frames are added up. round(n / factor) samples; within a thousandth of 1, and under a frame, nothing happens."""
    if abs(factor - 1) < 1e-3 or len(x) < length:
        return x
    n = max(1, round(len(x) / factor))
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(length) / length)
    padded = np.pad(x, (length // 2, length + hop))
    spectra = np.fft.rfft(np.lib.stride_tricks.sliding_window_view(padded, length)[::hop] * window)
    step = np.arange(0, len(spectra) - 1, factor)
    at = step.astype(int)
    part = (step - at)[:, None]
    size = (1 - part) * np.abs(spectra[at]) + part * np.abs(spectra[at + 1])
    pace = 2 * np.pi * hop * np.arange(length // 2 + 1) / length
    drift = np.angle(spectra[at + 1]) - np.angle(spectra[at]) - pace
    turn = pace + drift - 2 * np.pi * np.round(drift / (2 * np.pi))
    phase = np.angle(spectra[0]) + np.concatenate((np.zeros((1, turn.shape[1])), np.cumsum(turn[:-1], axis=0)))
    frames_out = np.fft.irfft(size * np.exp(1j * phase), length) * window
    place = (np.arange(len(at)) * hop)[:, None] + np.arange(length)
    out, weight = np.zeros(place[-1, -1] + 1), np.zeros(place[-1, -1] + 1)
    np.add.at(out, place, frames_out)
    np.add.at(weight, place, np.broadcast_to(window**2, place.shape))
    out = (out / np.maximum(weight, 1e-3))[length // 2 : length // 2 + n]
    return np.pad(out, (0, n - len(out)))


def pitch_shifted(x: np.ndarray, semitones: float) -> np.ndarray:
    """Pitch without speed: stretched, then read at another pace."""
    return resampled(stretched(x, 2 ** (-semitones / 12)), len(x))


def reverberated(x: np.ndarray, response: np.ndarray) -> np.ndarray:
    """The signal in a room, from the response's loudest sample on, at the loudness it had."""
    if not len(x) or not len(response):
        return x
    n = 1 << (len(x) + len(response) - 2).bit_length()
    first = int(np.argmax(np.abs(response)))
    y = np.fft.irfft(np.fft.rfft(x, n) * np.fft.rfft(response, n), n)[first : first + len(x)]
    power = np.sqrt((y * y).mean())
    return y * (np.sqrt((x * x).mean()) / power) if power > 0 else y


def trimmed(x: np.ndarray, below: float = -45.0, pad_ms: float = 25.0, rate: int = RATE) -> np.ndarray:
    """Without the silence at either end: frames of 10 ms over the loudest one's level plus ``below`` (or minus 60 dB), and a little around them."""
    length = max(1, int(rate * 0.010))
    if len(x) < 400 or len(x) // length < 3:
        return x
    levels = frame_levels(x, length)
    loud = np.flatnonzero(levels > levels.max() + max(below, -60.0))
    pad = int(rate * pad_ms / 1000)
    return x[max(0, loud[0] * length - pad) : min(len(x), (loud[-1] + 1) * length + pad)] if len(loud) else x


#: Fixed values of the augmentation chain: the peak that stays, the level under which a clip is lifted, to where and by how much at most.
PEAK, FAINT, LIFTED, LIFT = 0.99, -55.0, -45.0, 24.0


def augmented(x: np.ndarray, split: str, speed: float | None = None, gain_db: float | None = None, noise: np.ndarray | None = None, snr_db: float = 0.0, offset: int = 0) -> tuple[np.ndarray, str]:
    """The chain band, speed, gain, noise, peak guard, lift of a faint clip; and the names of its steps. The test split stops after the band. A step without its value is left out."""
    x, steps = microphone_band(x), ["mic_band"]
    if split == "test":
        return x, "mic_band"
    if speed is not None:
        x = sped(x, speed)
        steps.append(f"speed{speed:.3f}")
    if gain_db is not None:
        x = gained(x, gain_db)
        steps.append("gain")
    if noise is not None:
        x = mixed(x, noise, snr_db, offset)
        steps.append("noise")
    peak = np.abs(x).max(initial=0)
    if peak > PEAK:
        x = x * (PEAK / peak)
    level = rms_db(x)
    if level < FAINT and peak > 1e-6:
        x = gained(x, min(LIFT, LIFTED - level))
    return x, "+".join(steps)


def fingerprint(x: np.ndarray, rate: int = RATE, slices: int = 8, bands: int = 16) -> np.ndarray:
    """``slices`` x ``bands`` log magnitudes of the first 30 s, their mean removed; all 0 for under 1024 samples."""
    x = x[: 30 * rate]
    if len(x) < 1024:
        return np.zeros(slices * bands)
    out = []
    for part in np.array_split(x, slices):
        magnitude = np.abs(np.fft.rfft(part * np.hanning(len(part))))
        edges = np.linspace(0, len(magnitude), bands + 1).astype(int)
        out += [magnitude[a:b].mean() for a, b in zip(edges, edges[1:])]
    out = np.log(np.array(out) + 1e-12)
    return out - out.mean()


def quantised(x: np.ndarray, scale: float, zero: int) -> np.ndarray:
    return np.clip(np.round(x / scale) + zero, -128, 127).astype(np.int8)


def on_clips(kernel, returns: T.DataType | str):
    """A pandas UDF that applies a kernel of this module to a column of sample arrays; null stays null."""

    @F.pandas_udf(returns)
    def run(samples: pd.Series) -> pd.Series:
        def one(x):
            if x is None:
                return None
            y = kernel(np.asarray(x, float))
            return y.tolist() if isinstance(y, np.ndarray) else y

        return samples.map(one)

    return run


#: Values of a matrix of clips that are worked on at once; vectors that clips are made of at once.
MATRIX, VECTORS = 1 << 22, 512


def clips_of_vectors(batches: Iterator[pa.RecordBatch], size: int = 640) -> Iterator[pa.RecordBatch]:
    """vec_id, label, samples of rows vec_id, label, v: the vector again and again in ten parts, the fourth near silence, the seventh exact zeros, a constant beneath by label. So many clips at once, whatever the batch."""
    for batch in batches:
        for a in range(0, len(batch), VECTORS):
            own = batch.slice(a, VECTORS)
            keys, label = (own.column(c).cast(pa.int64()) for c in ("vec_id", "label"))
            k = label.to_numpy(zero_copy_only=False)[:, None]
            x = np.stack([np.resize(np.asarray(v, float), size) for v in own.column("v").to_numpy(zero_copy_only=False)])
            x = x * np.where(np.arange(10) == 3, 0.001, 0.5 + k).repeat(size // 10, axis=1) + k * 0.01
            x[:, 6 * (size // 10) : 7 * (size // 10)] = 0
            x = np.clip(x, -1.0, 32767 / 32768)
            samples = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, size, dtype=np.int32)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([keys, label, samples], ["vec_id", "label", "samples"])


def over_clips(df: DataFrame, key: str, samples: str, kernel: Callable[[np.ndarray], np.ndarray], names: tuple[str, ...], value: str) -> DataFrame:
    """key, ``names`` (the places in a clip's result, one a dimension), value: a kernel that takes a matrix of clips of one length and gives an array of each. Batches of clips go through it whole, by their lengths; null clips have no rows."""
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("key"), F.col(samples).cast("array<double>").alias("x")).where("x is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            listed = batch.column("x")
            flat, ends = listed.flatten().to_numpy(), np.concatenate(([0], np.cumsum(np.diff(listed.offsets.to_numpy()))))
            sizes = np.diff(ends)
            for size in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == size)
                step = max(1, MATRIX // max(size, CLIP))
                for a in range(0, len(own), step):
                    some = own[a : a + step]
                    out = kernel(flat[ends[some][:, None] + np.arange(size)])
                    places = np.indices(out.shape).reshape(out.ndim, -1)
                    yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(some[places[0]])), *(pa.array(p.astype(np.int32)) for p in places[1:]), pa.array(out.ravel().astype(float))], ["key", *names, value])

    return rows.mapInArrow(run, f"key {kind}, {', '.join(f'`{n}` int' for n in names)}, `{value}` double").withColumnRenamed("key", key)
