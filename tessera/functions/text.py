"""Text normalisers, digests and the word splitter as pure Column expressions (JVM-side).

Java's ``\\s`` is ASCII-only, so every whitespace class is spelled out by code point.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's behaviour)
# ---------------------------------------------------------------------------
# Control characters deleted by clean_line: U+0000-U+0008, U+000B, U+000C, U+000E-U+001F, U+007F-U+009F.
CONTROL_CLASS = "[\\x{0}-\\x{8}\\x{B}\\x{C}\\x{E}-\\x{1F}\\x{7F}-\\x{9F}]+"
# Whitespace left after the control pass (Unicode White_Space minus the deleted controls):
# tab, LF, CR, space, U+00A0, U+1680, U+2000-U+200A, U+2028, U+2029, U+202F, U+205F, U+3000.
CLEAN_WS_CLASS = ("[\\t\\n\\r \\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}"
                  "\\x{202F}\\x{205F}\\x{3000}]+")
# Controls that str.split() does not treat as whitespace (the control class minus
# U+000B, U+000C, U+001C-U+001F, U+0085): deleted outright by the combined normaliser.
NONWS_CONTROL_CLASS = "[\\x{0}-\\x{8}\\x{E}-\\x{1B}\\x{7F}-\\x{84}\\x{86}-\\x{9F}]+"
# Whitespace of Python's str.split(): the set above plus U+000B, U+000C, U+001C-U+001F, U+0085.
SPLIT_WS_CLASS = ("[\\t\\n\\x{B}\\x{C}\\r\\x{1C}-\\x{1F} \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}"
                  "\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+")
# A character that survives both normalisers (neither a control nor whitespace of either class).
CONTENT_CHAR = ("[^\\x{0}-\\x{20}\\x{7F}-\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}"
                "\\x{202F}\\x{205F}\\x{3000}]")
# Byte-level BPE pre-tokeniser pattern (contractions, letters, digits, other, whitespace).
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Length gate and language-probe prefix.
MIN_CHARS = 200
MAX_CHARS = 100_000
LANG_PREFIX_CHARS = 5000


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_line(c: Column | str) -> Column:
    """Delete control runs, collapse whitespace runs to one space, strip; null -> ''."""
    x = F.regexp_replace(F.coalesce(_c(c), F.lit("")), CONTROL_CLASS, "")
    return F.trim(F.regexp_replace(x, CLEAN_WS_CLASS, " "))


def normalize_doc(c: Column | str) -> Column:
    """``" ".join(text.split())`` — every str.isspace run becomes one space, ends stripped."""
    return F.trim(F.regexp_replace(F.coalesce(_c(c), F.lit("")), SPLIT_WS_CLASS, " "))


def canonical_text(c: Column | str) -> Column:
    """``clean_line(normalize_doc(c))`` — the ingest normaliser then the clean pass — in two regex
    passes: delete the controls that are not whitespace, then turn every whitespace run (including
    whitespace controls) into one space and strip. Same result: after the ingest pass the only
    whitespace left is single spaces, and deleting controls between them only merges runs."""
    x = F.regexp_replace(F.coalesce(_c(c), F.lit("")), NONWS_CONTROL_CLASS, "")
    return F.trim(F.regexp_replace(x, SPLIT_WS_CLASS, " "))


def has_content(c: Column | str) -> Column:
    """True iff ``canonical_text(c)`` (equally ``clean_line(c)``) is non-empty — one regex find on
    the raw text. Filter with this, not with the cleaned value: Catalyst pushes filters below the
    projection that computes the cleaned text and would evaluate the normaliser twice."""
    return F.coalesce(_c(c), F.lit("")).rlike(CONTENT_CHAR)


def digest(c: Column | str) -> Column:
    """SHA-1 hex of the UTF-8 bytes."""
    return F.sha1(F.encode(_c(c), "UTF-8"))


def char_len(c: Column | str) -> Column:
    """Length in code points (Python ``len``)."""
    return F.char_length(_c(c))


def lang_prefix(c: Column | str, n: int = LANG_PREFIX_CHARS) -> Column:
    """P5: first ``n`` code points."""
    return F.substring(_c(c), 1, n)


def words(c: Column | str) -> Column:
    """Split text into pre-tokens (array<string>) with the byte-level BPE pattern."""
    return F.regexp_extract_all(_c(c), F.lit("(?U)" + WORD_PATTERN), 0)


def word_count(c: Column | str) -> Column:
    """Number of whitespace-separated words (Python ``len(text.split())``)."""
    n = normalize_doc(c)
    return F.when(n == "", F.lit(0)).otherwise(F.size(F.split(n, " ")))


def tokens_from_bytes(c: Column | str) -> Column:
    """Token count of a flat int32 file of ``c`` bytes."""
    return F.floor(_c(c) / F.lit(4)).cast("bigint")
