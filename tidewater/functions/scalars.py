"""Scalar expressions: decibels, mel scale, clamps, seconds, hash fractions, interval bounds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The floor of amplitudes and of energies before a logarithm, and the 95 % normal quantile.
AMPLITUDE_FLOOR, ENERGY_FLOOR, Z95 = 1e-12, 1e-12, 1.96


def decibels(amplitude: Column) -> Column:
    return 20 * F.log10(F.greatest(amplitude, F.lit(AMPLITUDE_FLOOR)))


def energy_decibels(energy: Column) -> Column:
    return 10 * F.log10(energy + F.lit(ENERGY_FLOOR))


def mel(hertz: Column) -> Column:
    return 2595 * F.log10(1 + hertz / 700)


def hertz(mels: Column) -> Column:
    return 700 * (F.pow(F.lit(10.0), mels / 2595) - 1)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def epoch_micros(ts: str) -> Column:
    """Microseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', `{ts}`)")


def hash_fraction(key: Column, salt: str) -> Column:
    """A number in [0, 1) from the first 48 bits of SHA-256 of salt and key; the same in any engine."""
    digest = F.sha2(F.concat(F.lit(salt), key.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def wilson(successes: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Bounds of the Wilson interval; NaN without trials."""
    p = successes / n
    centre = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    nan = F.lit(float("nan"))
    return F.when(n > 0, F.greatest(F.lit(0.0), centre - half)).otherwise(nan), F.when(n > 0, F.least(F.lit(1.0), centre + half)).otherwise(nan)


def poisson(events: Column, z: float = Z95) -> tuple[Column, Column]:
    """Bounds of an event count, by the cube approximation; 0 below for no events."""
    k = events.cast("double")
    low = F.when(k > 0, k * F.pow(1 - 1 / (9 * k) - z / (3 * F.sqrt(k)), F.lit(3.0))).otherwise(F.lit(0.0))
    high = (k + 1) * F.pow(1 - 1 / (9 * (k + 1)) + z / (3 * F.sqrt(k + 1)), F.lit(3.0))
    return low, high


def rounded(c: Column, digits: int = 6) -> Column:
    return F.round(c, digits)


def blank_rounded(c: Column, digits: int = 1) -> Column:
    """Rounded; null for null and NaN, which a record leaves empty."""
    return F.when(c.isNotNull() & ~F.isnan(c.cast("double")), F.round(c, digits))


def ascii_only(text: Column) -> Column:
    """Without characters beyond ASCII; the gaps this leaves, and all other white space of two or more, close to one space; trimmed."""
    plain = F.regexp_replace(text, r"[^\x00-\x7F]", "")
    return F.regexp_replace(F.regexp_replace(plain, r"\s{2,}", " "), r"^\s+|\s+$", "")


def found_all(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of every match of a pattern, as an array; ``^`` and ``$`` stand at lines."""
    return F.regexp_extract_all(text, F.lit(f"(?m){pattern}"), F.lit(group))


def seed(key: Column, salt: str, size: int = 8) -> Column:
    """The first ``size`` bytes of SHA-256 of salt and key as an unsigned little-endian number (as decimal: 8 bytes don't fit a long)."""
    digest = F.sha2(F.concat(F.lit(salt), key.cast("string")), 256)
    turned = F.concat(*(F.substring(digest, 2 * k + 1, 2) for k in reversed(range(size))))
    return F.conv(turned, 16, 10).cast("decimal(20,0)")


def gcd(a: Column, b: Column) -> Column:
    """The greatest common divisor of two longs, by at most 92 steps of Euclid."""
    step = lambda p, _: F.when(p["y"] == 0, p).otherwise(F.struct(p["y"].alias("x"), (p["x"] % F.when(p["y"] == 0, 1).otherwise(p["y"])).alias("y")))
    start = F.struct(F.abs(a.cast("long")).alias("x"), F.abs(b.cast("long")).alias("y"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(92)), start, step, lambda p: p["x"])


def deviation_percent(samples: Column, micros: Column, nominal: float = 16_000.0) -> Column:
    """How far a measured rate lies from the nominal one; a time of 0 measures a rate of 0."""
    rate = F.when(micros > 0, samples / (micros / 1e6)).otherwise(0.0)
    return 100.0 * (rate - nominal) / nominal


def drift_percent(n: Column, expected: Column) -> Column:
    """How far a count lies from the expected one, in percent; null where 0 or nothing is expected."""
    return F.when(expected != 0, 100.0 * (n - expected) / F.when(expected != 0, expected))


def iso_utc(ts: Column) -> Column:
    """A timestamp without zone, taken as UTC, as ISO 8601 to the second."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def stamp(ts: Column) -> Column:
    """The form that file names carry."""
    return F.date_format(ts, "yyyyMMdd_HHmmss")


def now_utc() -> Column:
    """The time the query began, as ISO 8601 UTC."""
    return iso_utc(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()))


def flags(c: Column, **bits: int) -> list[Column]:
    """A boolean column for each named bit."""
    return [(c.bitwiseAND(F.lit(b)) != 0).alias(name) for name, b in bits.items()]
