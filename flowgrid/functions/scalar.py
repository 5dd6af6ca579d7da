"""Scalar expressions that the operators share. All are built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowgrid.schemas import EMPTY_MARKER, MISSING_MARKERS

_ENDS = r"^\s+|\s+$"
_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clean(x: Column | str) -> Column:
    """Trimmed of all white space, in lower case."""
    return F.lower(F.regexp_replace(_c(x), _ENDS, ""))


def text_or_empty(x: Column | str) -> Column:
    return F.coalesce(F.regexp_replace(_c(x), _ENDS, ""), F.lit(""))


def is_missing(x: Column | str) -> Column:
    """A null or a missing marker; the empty-set marker is a value."""
    return _c(x).isNull() | clean(x).isin(MISSING_MARKERS)


def is_empty_set(x: Column | str) -> Column:
    return F.coalesce(_c(x) == EMPTY_MARKER, F.lit(False))


def finite(x: Column | str) -> Column:
    """Neither null, NaN nor infinite."""
    d = _c(x).cast("double")
    return F.coalesce(~F.isnan(d) & (F.abs(d) < float("inf")), F.lit(False))


def to_number(x: Column | str) -> Column:
    """The number that the text spells, else null. Spellings of NaN, infinities, digit groups and
    type suffixes aren't numbers."""
    t = F.regexp_replace(_c(x).cast("string"), _ENDS, "")
    return F.when(t.rlike(_NUMBER), t.try_cast("double"))


def to_decimal(x: Column | str) -> Column:
    return F.regexp_replace(_c(x).cast("string"), _ENDS, "").try_cast("decimal(38,18)")


def is_sha256(x: Column | str) -> Column:
    return F.coalesce(_c(x).rlike("^[0-9a-f]{64}$"), F.lit(False))


def min_max(x: Column | str, low: Column | float, high: Column | float) -> Column:
    """Onto [-1, 1] without clipping; where the extremes are equal, 0."""
    low, high = (v if isinstance(v, Column) else F.lit(float(v)) for v in (low, high))
    return F.when(high > low, 2.0 * (_c(x) - low) / (high - low) - 1.0).otherwise(F.lit(0.0))


def clip_unit(x: Column | str) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), _c(x)))


def safe_divide(a: Column | str, b: Column | str, default: float | None = 0.0) -> Column:
    """a / b, or ``default`` where b is 0."""
    q = F.try_divide(_c(a).cast("double"), _c(b).cast("double"))
    return q if default is None else F.coalesce(q, F.lit(default))


def rounded(x: Column | str, digits: int = 6) -> Column:
    """Rounded, with one zero."""
    return F.round(_c(x).cast("double"), digits) + F.lit(0.0)


def band(x: Column | str, bands: int = 21) -> Column:
    """Which of equal bands of [-1, 1] a correlation falls into, 0 to bands - 1."""
    return F.least(F.lit(bands - 1), F.greatest(F.lit(0), F.floor((_c(x) + 1.0) * (bands / 2.0)).cast("int")))


def above(p: Column | str, threshold: float = 0.5) -> Column:
    """1 strictly above the threshold; the threshold itself is benign."""
    return (_c(p) > threshold).cast("int")


def flat_name(name: str) -> str:
    """A field's name without dots."""
    return name.replace(".", "_")


def ordered_key(seed: int | str, x: Column | str) -> Column:
    """A pseudo-random sort key that both engines agree on."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), _c(x).cast("string")), 256)


def softmax_positive(a: Column | str, b: Column | str) -> Column:
    """Probability of the second of two logits."""
    return 1.0 / (1.0 + F.exp(_c(a) - _c(b)))
