"""String columns: trimming, slugs, tags, short labels and fixed-decimal text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that mean "missing" in a text cell after trimming (case-sensitive).
NULL_WORDS = ("", "nan", "None", "<NA>")
NULL_TIMESTAMP_WORDS = ("", "nan", "None", "NaT")

# Raw CSV cells read as missing before any trimming.
CSV_NULL_CELLS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Code -> label, as printed in the report tables.
MODE_LABELS = {"pass_through": "Đi qua", "random_forest_full": "RF-Full"}
PROFILE_LABELS = {
    "latency_500ms_500offsets": "500 ms / 500",
    "balanced_1s_1000offsets": "1 s / 1000",
    "balanced_high_1s_2000offsets": "1 s / 2000",
    "latency_high_500ms_1000offsets": "500 ms / 1000",
    "batch_2s_2000offsets": "2 s / 2000",
}
SCENARIO_LABELS = {
    "cold_start_300rps": "Khởi động 300",
    "spark_process_crash_300rps": "Lỗi Spark 300",
    "spark_process_crash_500rps": "Lỗi Spark 500",
}
MODEL_LABELS = {
    "random_forest": "RF-Full",
    "logistic_regression": "LR-Full",
    "gradient_boosting": "GBT-Full",
}
REDUCED_FOREST_LABEL = "RF-17"
SPLIT_LABELS = {
    "calibration": "Hiệu chỉnh",
    "test_seen_temporal": "Test theo thời gian",
    "test_unseen_family": "Test họ mới",
    "test_rare_web": "Test Web hiếm",
}


# All characters that count as white space.
WHITE_SPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column) -> Column:
    """Remove leading and trailing white space of any kind."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def blank_to_null(text: Column, words: tuple[str, ...] = NULL_WORDS) -> Column:
    """Trimmed text, null when it is one of ``words``."""
    trimmed = strip(text)
    return F.when(~trimmed.isin(*words), trimmed)


def slugify(text: Column) -> Column:
    """Lower case, runs of other characters to ``_``, outer ``_`` removed, ``unknown`` when nothing is left."""
    slug = F.btrim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), F.lit("_"))
    return F.coalesce(F.nullif(slug, F.lit("")), F.lit("unknown"))


def safe_tag(text: Column) -> Column:
    """Name usable in a path: letters, digits, ``-`` and ``_`` stay, each other character becomes ``_``."""
    tag = F.btrim(F.regexp_replace(strip(text), r"[^\p{L}\p{N}_-]", "_"), F.lit("_"))
    return F.coalesce(F.nullif(tag, F.lit("")), F.lit("default"))


def safe_file_tag(text: Column) -> Column:
    """As :func:`safe_tag`, but dots stay, outer ``_`` stay and the fallback is ``unknown_run``."""
    tag = F.regexp_replace(strip(text), r"[^\p{L}\p{N}._-]", "_")
    return F.coalesce(F.nullif(tag, F.lit("")), F.lit("unknown_run"))


# Families of run tags, the modes that name a run in each, and how a chart writes them.
RUN_MODES = {
    "capacitycalibration/pass_through": "pass-through",
    "capacitycalibration/random_forest_full": "RF-Full",
    "modelfeaturetradeoff/rf_17": "RF-17",
    "modelfeaturetradeoff/rf17": "RF-17",
    "modelfeaturetradeoff/rf-17": "RF-17",
}
RUN_MODE_RATE = "_(" + "|".join(k.split("/")[1] for k in RUN_MODES) + r")_([0-9]+)rps_"
RUN_SCENARIO = r"^faultrecovery_r\d+_\d+_([a-z0-9_]+)_\d+$"


def short_run_label(run_tag: Column) -> Column:
    """Chart label of a run tag: mode and rate, else the scenario, else the tag as it is.

    A tag is read as family, mode, rate and scenario; only modes that its family knows are written.
    """
    tag = F.lower(run_tag)
    key = F.concat_ws("/", F.substring_index(tag, "_", 1), F.regexp_extract(tag, RUN_MODE_RATE, 1))
    names = F.create_map(*[F.lit(x) for pair in RUN_MODES.items() for x in pair])
    by_rate = F.concat_ws(" ", names[key], F.regexp_extract(tag, RUN_MODE_RATE, 2), F.lit("rps"))
    scenario = F.nullif(F.regexp_extract(tag, RUN_SCENARIO, 1), F.lit(""))
    return F.when(names[key].isNotNull(), by_rate).otherwise(F.coalesce(scenario, run_tag))


def _lookup(code: Column, labels: dict[str, str], otherwise: Column) -> Column:
    out = None
    for key, label in labels.items():
        out = F.when(code == key, F.lit(label)) if out is None else out.when(code == key, F.lit(label))
    return otherwise if out is None else out.otherwise(otherwise)


def title_words(code: Column) -> Column:
    """``_`` to space, upper case on every letter that does not follow a letter, lower case elsewhere."""
    text = F.replace(code, F.lit("_"), F.lit(" "))
    letters = F.split(text, "")
    return F.array_join(
        F.transform(
            letters,
            lambda ch, i: F.when((i > 0) & F.get(letters, i - 1).rlike(r"\p{L}"), F.lower(ch)).otherwise(F.upper(ch)),
        ),
        "",
    )


def mode_label(code: Column, labels: dict[str, str] = MODE_LABELS) -> Column:
    code = F.coalesce(code, F.lit(""))
    return _lookup(code, labels, title_words(code))


def profile_label(code: Column, labels: dict[str, str] = PROFILE_LABELS) -> Column:
    """First profile whose name occurs inside the code; otherwise the code without its family prefix."""
    code = F.coalesce(code, F.lit(""))
    bare = F.replace(code, F.lit("runtime_sensitivity_"), F.lit(""))
    bare = F.replace(bare, F.lit("runtime_candidate_"), F.lit(""))
    out = None
    for key, label in labels.items():
        out = F.when(code.contains(key), F.lit(label)) if out is None else out.when(code.contains(key), F.lit(label))
    return out.otherwise(bare)


def scenario_label(code: Column, labels: dict[str, str] = SCENARIO_LABELS) -> Column:
    code = F.coalesce(code, F.lit(""))
    return _lookup(code, labels, F.replace(code, F.lit("_"), F.lit(" ")))


def model_label(code: Column, reduced: Column | bool = False, labels: dict[str, str] = MODEL_LABELS) -> Column:
    code = F.coalesce(code, F.lit(""))
    reduced = F.lit(reduced) if isinstance(reduced, bool) else reduced
    return F.when(reduced & (code == "random_forest"), F.lit(REDUCED_FOREST_LABEL)).otherwise(
        _lookup(code, labels, title_words(code))
    )


def split_label(code: Column, labels: dict[str, str] = SPLIT_LABELS) -> Column:
    code = F.coalesce(code, F.lit(""))
    return _lookup(code, labels, F.replace(code, F.lit("_"), F.lit(" ")))


def run_label(columns: list[str]) -> Column:
    """Label of a summary row: the first present of mode, candidate, overload profile, scenario, run tag."""
    picks = []
    if "mode" in columns:
        picks.append(F.when(F.col("mode").isNotNull(), mode_label(F.col("mode"))))
    picks += [F.col(c) for c in ("candidate_label", "overload_profile", "scenario", "run_tag") if c in columns]
    return F.coalesce(*picks, F.lit("run"))


def format_fixed(value: Column, decimals: int = 1) -> Column:
    """Number as text with fixed decimals (exact ties go to the even digit), ``NA`` for null."""
    rounded = F.bround(value.cast("decimal(38,12)"), decimals)
    return F.coalesce(rounded.cast(f"decimal(38,{decimals})").cast("string"), F.lit("NA"))


def format_mean_std(mean: Column, std: Column, decimals: int = 1) -> Column:
    """``"m +/- s"`` of an aggregated mean and deviation, ``NA`` when there were no values."""
    text = F.concat(format_fixed(mean, decimals), F.lit(" +/- "), format_fixed(std, decimals))
    return F.when(mean.isNull(), F.lit("NA")).otherwise(text)
