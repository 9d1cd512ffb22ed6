"""Document gates, parameter checks and quality gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T


def non_empty(c: Column | str) -> Column:
    """keep rows whose (normalised) text is not empty."""
    col = F.col(c) if isinstance(c, str) else c
    return col.isNotNull() & (F.length(col) > 0)


def length_ok(c: Column | str, min_chars: int = T.MIN_CHARS, max_chars: int = T.MAX_CHARS) -> Column:
    """``min_chars <= code points <= max_chars`` on the raw text (both inclusive)."""
    return T.char_len(c).between(min_chars, max_chars)


def drop_reason(text: Column | str, english: Column | None, min_chars: int = T.MIN_CHARS,
                max_chars: int = T.MAX_CHARS) -> Column:
    """F4 accounting: the first failing gate, cheap tests first; ``None`` english = bypass."""
    t = F.col(text) if isinstance(text, str) else text
    n = T.char_len(t)
    r = (F.when(t.isNull() | (t == ""), F.lit("empty"))
         .when(n < min_chars, F.lit("too_short"))
         .when(n > max_chars, F.lit("too_long")))
    if english is not None:
        r = r.when(~F.coalesce(english, F.lit(False)), F.lit("not_english"))
    return r.otherwise(F.lit("kept"))


def gate(docs: DataFrame, text_col: str = "text", english: Column | None = None,
         min_chars: int = T.MIN_CHARS, max_chars: int = T.MAX_CHARS) -> DataFrame:
    """keep documents passing the length gate and (optionally) the language gate."""
    return docs.where(drop_reason(text_col, english, min_chars, max_chars) == "kept")


def finite(c: Column | str) -> Column:
    """not NaN and not infinite."""
    col = F.col(c) if isinstance(c, str) else c
    return col.isNotNull() & ~F.isnan(col) & (F.abs(col) < F.lit(float("inf")))


def check_fraction(train_frac: float) -> None:
    """F5."""
    if not 0.0 < train_frac < 1.0:
        raise ValueError(f"the training share lies between 0 and 1, not at {train_frac}")


def check_context(context: int) -> None:
    if context < 1:
        raise ValueError(f"a window holds one token or more, not {context}")


def check_positive(name: str, v: int) -> None:
    if v < 1:
        raise ValueError(f"{name} must be >= 1")


def require(ok: bool, message: str) -> None:
    """fail the job when a quality gate on a metrics row is violated."""
    if not ok:
        raise RuntimeError(message)
