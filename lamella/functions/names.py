"""Column expressions over file names: tokens, group keys, labels, natural order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The name tokens of an acquisition.
TOKENS = {"position": "_Position", "time": "_Time", "channel": "_Channel"}
FRAMES = r"_Frames_(\d+)_(\d+)"
MAX_TOKEN = 2**31 - 1


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def folder(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def _values(name: Column, pattern: str, group: int) -> Column:
    return F.array_distinct(F.regexp_extract_all(name, F.lit(pattern), group))


def token(name: Column, kind: str) -> Column:
    """``state`` (absent, valid, invalid) and ``value`` of a numeric token.

    A token with two different values, or one too large for an int, is invalid.
    """
    values = F.transform(_values(name, TOKENS[kind] + r"(\d+)", 1), lambda v: v.cast("decimal(38,0)"))
    values = F.array_distinct(values)
    value = F.try_element_at(values, F.lit(1))
    state = F.when(F.size(values) == 0, "absent").when((F.size(values) > 1) | (value > MAX_TOKEN), "invalid").otherwise("valid")
    return F.struct(state.alias("state"), F.when(state == "valid", value.cast("long")).alias("value"))


def frame_range(name: Column) -> Column:
    """``state`` and first and last plane of ``_Frames_a_b``; reversed, repeated or malformed ranges are invalid."""
    pairs = _values(name, FRAMES, 0)
    one = F.try_element_at(pairs, F.lit(1))
    a = F.regexp_extract(one, FRAMES, 1).try_cast("long")
    b = F.regexp_extract(one, FRAMES, 2).try_cast("long")
    state = (
        F.when(~F.contains(name, F.lit("_Frames")), "absent").when((F.size(pairs) != 1) | a.isNull() | b.isNull() | (a > b), "invalid").otherwise("valid")
    )
    return F.struct(state.alias("state"), F.when(state == "valid", a).alias("first"), F.when(state == "valid", b).alias("last"))


def group_key(path: Column) -> Column:
    """Name without the channel token: files of one key are the channels of one time point."""
    return F.regexp_replace(path, r"_Channel\d+", "")


def family_key(path: Column) -> Column:
    """Folder and name without time, channel and plane range."""
    return F.regexp_replace(F.regexp_replace(path, r"_(Time|Channel)\d+", ""), FRAMES, "")


def movie_name(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(name, r"_Time\d+", ""), r"\.[^.]*$", "")


def time_label(number: Column) -> Column:
    return F.format_string("Time%06d", number)


def source_key(channel: Column, side: Column) -> Column:
    """``_Channel0001-left``."""
    return F.concat(F.format_string("_Channel%04d", channel), F.lit("-"), side)


def parse_source_key(key: Column) -> Column:
    channel = F.regexp_extract(key, r"^_Channel(\d+)-(left|right|whole)$", 1).try_cast("int")
    side = F.regexp_extract(key, r"^_Channel(\d+)-(left|right|whole)$", 2)
    return F.struct(channel.alias("channel"), F.when(channel.isNotNull(), side).alias("side"), (side == "whole").alias("is_whole"))


def mirrored_folder(path: Column, root: str, target: str) -> Column:
    """The folder of a file, moved from one root below another."""
    return F.concat(F.lit(target), F.substring(folder(path), len(root) + 1, 100000))


def natural_key(text: Column) -> Column:
    """Sort key in which digit runs compare as numbers and the rest without case.

    Each digit run becomes its length without leading zeros and its digits, so that
    plain string order is natural order.
    """
    runs = F.regexp_extract_all(F.lower(text), F.lit(r"(\d+|\D+)"), 1)
    digits = lambda r: F.regexp_replace(r, r"^0+(?=\d)", "")
    coded = F.transform(runs, lambda r: F.when(r.rlike(r"^\d"), F.concat(F.lit("0"), F.lpad(F.length(digits(r)).cast("string"), 4, "0"), digits(r))).otherwise(r))
    return F.array_join(coded, "")


def digits_number(path: Column) -> Column:
    """All digits of a path as one number (the last 18 of them)."""
    return F.right(F.regexp_replace(path, r"[^0-9]", ""), F.lit(18)).try_cast("long")


def canonical_view(key: Column) -> Column:
    """View names on disk: avg is mean."""
    return F.regexp_replace(key, "^avg", "mean")


# Length units in micrometres.
UNITS = {"micron": 1.0, "microns": 1.0, "um": 1.0, "µm": 1.0, "nm": 1e-3, "mm": 1e3, "cm": 1e4}


def to_micron(value: Column, unit: Column) -> Column:
    """Length in micrometres; an unknown unit gives 0."""
    table = F.create_map(*[F.lit(x) for k, v in UNITS.items() for x in (k, v)])
    return value * F.coalesce(F.try_element_at(table, F.lower(unit)), F.lit(0.0))


def interval_seconds(text: Column) -> Column:
    """``"<n> <unit>"`` in seconds: minutes and hours are multiplied out."""
    number = F.regexp_extract(text, r"^\s*([0-9.]+)", 1).try_cast("double")
    unit = F.regexp_extract(text, r"^\s*[0-9.]+\s*([A-Za-z]*)", 1)
    return number * F.when(unit.startswith("min"), 60.0).when(unit.startswith("h"), 3600.0).when(unit == "ms", 0.001).otherwise(1.0)


def contains_any(text: Column, words: list[str], ignore_case: bool = True) -> Column:
    """An empty list accepts everything."""
    if not words:
        return F.lit(True)
    text = F.lower(text) if ignore_case else text
    return F.exists(F.array(*[F.lit(w.lower() if ignore_case else w) for w in words]), lambda w: F.contains(text, w))


def contains_all(text: Column, words: list[str], ignore_case: bool = False) -> Column:
    if not words:
        return F.lit(True)
    text = F.lower(text) if ignore_case else text
    return F.forall(F.array(*[F.lit(w.lower() if ignore_case else w) for w in words]), lambda w: F.contains(text, w))
