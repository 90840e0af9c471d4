"""Numeric, timestamp, label and phase columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlib.functions.text import NULL_TIMESTAMP_WORDS, NULL_WORDS, blank_to_null, slugify, strip

# Input contract and defaults.
TIMESTAMP_FLOOR = "2018-01-01 00:00:00"
BENIGN = "benign"
COLLECTOR_PHASES = ("warmup", "cold_start", "pre_fault", "post_fault")
DEFAULT_PHASE = "measure"

# Rump, Zimmermann, Boldo, Melquiond (2009): x + |x|*PHI rounds to the next double above x.
PHI = 2.0**-53 * (1.0 + 2.0**-52)


# Shape of a cell and the patterns that can fit it, in order. Ambiguous dates without seconds are month first.
FREE_FORMS = {
    r"^\d{1,2}/\d{1,2}/\d{4}": ("M/d/yyyy H:m:s", "M/d/yyyy H:m", "d/M/yyyy H:m", "M/d/yyyy h:m:s a", "M/d/yyyy h:m a", "M/d/yyyy", "d/M/yyyy"),
    r"^\d{4}/": ("yyyy/M/d H:m:s", "yyyy/M/d H:m", "yyyy/M/d"),
    r"^\d{1,2} [A-Za-z]{3} ": ("d MMM yyyy H:m:s", "d MMM yyyy H:m", "d MMM yyyy"),
    r"^[A-Za-z]{3} \d": ("MMM d, yyyy H:m:s", "MMM d, yyyy H:m", "MMM d, yyyy"),
}


def parse_timestamp(text: Column, free_forms: dict[str, tuple[str, ...]] = FREE_FORMS) -> Column:
    """``d/M/yyyy H:m:s``, then ``yyyy-M-d H:m:s``, then ISO text, then ``free_forms``; null when nothing fits.

    A pattern is tried only on cells of its shape: a cell that fails one costs an exception each.
    """
    cell = blank_to_null(text, NULL_TIMESTAMP_WORDS)

    def tried(shape: str, *patterns: str) -> Column:
        return F.when(cell.rlike(shape), F.coalesce(*[F.try_to_timestamp(cell, F.lit(p)) for p in patterns]))

    return F.coalesce(
        tried(r"^\d+/\d+/", "d/M/yyyy H:m:s"),
        tried(r"^\d+-\d+-\d+ ", "yyyy-M-d H:m:s"),
        F.try_to_timestamp(cell),
        *[tried(shape, *patterns) for shape, patterns in free_forms.items()],
    )


def is_valid_timestamp(ts: Column, floor: str = TIMESTAMP_FLOOR) -> Column:
    return ts.isNotNull() & (ts >= F.lit(floor).cast("timestamp"))


def is_missing_label(label: Column) -> Column:
    trimmed = strip(label)
    return trimmed.isNull() | trimmed.isin(*NULL_WORDS)


def normalize_label(label: Column, mapped: Column) -> Column:
    """Mapped name, else the slug of the label, else ``unknown``."""
    return F.coalesce(mapped, slugify(blank_to_null(label)))


def binary_label(label_norm: Column) -> Column:
    return (label_norm != BENIGN).cast("int")


def parse_number(trimmed: Column) -> Column:
    """Trimmed text to double; Java suffixes and hex digits (``1d``, ``0x1p3``) are not numbers."""
    return F.when(~trimmed.rlike(r"(?i)[0-9.][df]$|x"), trimmed.try_cast("double"))


def to_number(cell: Column) -> Column:
    """Text to double; text that is no number is null."""
    return parse_number(strip(cell.cast("string")))


def finite_or_null(value: Column) -> Column:
    infinite = F.abs(value) == float("inf")
    return F.when(~(F.isnan(value) | infinite), value)


def sanitize_number(cell: Column) -> Column:
    return finite_or_null(to_number(cell))


def numeric_or_null(df: DataFrame, name: str) -> Column:
    """Column as a number (NaN counts as missing); a column the frame lacks is null."""
    if name not in df.columns:
        return F.lit(None).cast("double")
    if dict(df.dtypes)[name] == "string":
        value = to_number(F.col(f"`{name}`"))
    else:
        value = F.col(f"`{name}`").cast("double")
    return F.when(~F.isnan(value), value)


def first_numeric(df: DataFrame, *names: str) -> Column:
    """First of the named columns that holds a number in this row."""
    return F.coalesce(*[numeric_or_null(df, name) for name in names])


def next_above(value: Column) -> Column:
    """The next representable double above ``value``."""
    return F.when(value == 0.0, F.lit(5e-324)).otherwise(value + F.abs(value) * F.lit(PHI))


def apply_threshold(score: Column, threshold: Column | float) -> Column:
    """1 when the score reaches the threshold, else 0; a missing score is 0."""
    threshold = F.lit(float(threshold)) if isinstance(threshold, (int, float)) else threshold
    return F.when(score >= threshold, F.lit(1)).otherwise(F.lit(0))


def collector_phase(phase: Column) -> Column:
    """Phase as stored with collected predictions: a known phase, else ``measure``."""
    low = strip(F.lower(F.coalesce(phase, F.lit(""))))
    return F.when(low.isin(*COLLECTOR_PHASES), low).otherwise(F.lit(DEFAULT_PHASE))


def metric_phase(phase: Column) -> Column:
    """Phase as compared by the metrics: missing is ``measure``, case is ignored."""
    return F.lower(F.coalesce(phase, F.lit(DEFAULT_PHASE)))


def in_phase(df: DataFrame, phase: str | None) -> Column:
    """Predicate of a phase filter; a blank phase or a frame without phases keeps every row."""
    wanted = (phase or "").strip().lower()
    if not wanted or "benchmark_phase" not in df.columns:
        return F.lit(True)
    return metric_phase(F.col("benchmark_phase")) == wanted


def trigger_interval_ms(text: Column) -> Column:
    """``"<n> <unit>"`` in milliseconds; the unit defaults to seconds, other units are null."""
    parts = F.split(strip(F.lower(F.coalesce(text, F.lit("")))), r"\s+")
    value = to_number(F.get(parts, F.lit(0)))
    unit = F.coalesce(F.get(parts, F.lit(1)), F.lit("seconds"))
    return (
        F.when(unit.startswith("millisecond") | (unit == "ms"), value)
        .when(unit.startswith("second") | (unit == "s"), value * 1000.0)
        .when(unit.startswith("minute") | (unit == "m"), value * 60000.0)
    )


def ratio_or_null(numerator: Column, denominator: Column) -> Column:
    return F.when(denominator > 0, numerator.cast("double") / denominator)


def ratio_or_zero(numerator: Column, denominator: Column) -> Column:
    return F.when(denominator > 0, numerator.cast("double") / denominator).otherwise(F.lit(0.0))


def span_seconds(first: Column, last: Column) -> Column:
    """Seconds between two instants; micros are subtracted as integers, so nothing is lost."""
    return (F.unix_micros(last) - F.unix_micros(first)) / F.lit(1e6)


def content_bucket(key: Column, buckets: int) -> Column:
    """Bucket in ``[0, buckets)`` from the first 32 bits of the MD5 of a text key; any engine can repeat it."""
    return F.pmod(F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long"), F.lit(buckets)).cast("int")


def key_text(*parts: Column) -> Column:
    """Text key from integers and strings; missing parts keep their place."""
    return F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("∅")) for p in parts])
