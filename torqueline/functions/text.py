"""Scalar rules on text, labels and timestamps."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = [
    "STYLE_SPELLINGS", "normalize_timestamp_key", "parse_timestamp", "display_timestamp",
    "map_values", "canonical_label", "clean_text", "epoch_micros",
]

# Spellings of driving-style labels and what they stand for.
STYLE_SPELLINGS = {
    "UNKNOWN_STYLE": None,
    "mild": "Moderate",
    "Moderate": "Moderate",
    "Passive": "Passive",
    "passive": "Passive",
    "IDLE": "idle",
    "Idle": "idle",
}

# Timestamp spellings seen in logs, messages and normalised keys.
TIMESTAMP_FORMATS = (
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]",
    "yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSS]",
    "yyyy-MM-dd'T'HH-mm-ss[-SSSSSS][-SSS]",
    "yyyy-MM-dd",
)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_timestamp_key(c: Column | str) -> Column:
    """File-name-safe session key: ``:``, ``.`` and ``/`` to ``-``, blank to ``T``."""
    return F.translate(_col(c), ":. /", "--T-")


def parse_timestamp(c: Column | str, *formats: str) -> Column:
    """First format that fits wins; what fits none becomes NULL."""
    c = _col(c)
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in formats or TIMESTAMP_FORMATS])


def epoch_micros(c: Column | str) -> Column:
    return F.unix_micros(_col(c).cast("timestamp"))


def display_timestamp(c: Column | str, hour_shift: int = -2) -> Column:
    """Normalised key to ``hh:mm dd/mm/yyyy``; the hour moves, the date does not."""
    c = _col(c)
    shape = r"^(\d{4})-(\d{1,2})-(\d{1,2})T(\d{1,2})-(\d{1,2})-(\d{1,2})(?:-[^T]*)?$"
    part = [F.regexp_extract(c, shape, i) for i in range(1, 6)]
    hour = F.pmod(part[3].cast("int") + F.lit(hour_shift), F.lit(24))
    shown = F.format_string(
        "%02d:%02d %02d/%02d/%s", hour, part[4].cast("int"), part[2].cast("int"), part[1].cast("int"), part[0]
    )
    return F.when(c.rlike(shape), shown).otherwise(c)


def _literal(value, kind: str | None) -> Column:
    out = F.lit(value)
    return out.cast(kind) if kind else out


def map_values(c: Column | str, mapping: Mapping, kind: str = "int") -> Column:
    """Dictionary lookup; unlisted values become NULL."""
    c = _col(c)
    out = F.lit(None).cast(kind)
    for key, value in reversed(list(mapping.items())):
        out = F.when(c == F.lit(key), _literal(value, kind)).otherwise(out)
    return out


def canonical_label(c: Column | str, mapping: Mapping = STYLE_SPELLINGS) -> Column:
    """Dictionary replace; unlisted values are kept."""
    c = _col(c)
    out = c
    for key, value in reversed(list(mapping.items())):
        out = F.when(c == F.lit(key), _literal(value, "string")).otherwise(out)
    return out


def clean_text(c: Column | str, replacements: Mapping[str, str] = {}, pattern: str | None = None,
               by: str = "") -> Column:
    """Trim, literal replacements in the order given, then one regular expression."""
    out = F.trim(_col(c))
    for old, new in replacements.items():
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.regexp_replace(out, pattern, by) if pattern else out
