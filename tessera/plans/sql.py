"""DuckDB spellings of our column expressions, used to write the oracle SQL of each query.

RE2 and Java both accept the ``\\x{..}`` class syntax, so the character classes are shared with
``functions.text``; only the word pattern loses its look-ahead branch, which cannot match on
cleaned text (whitespace there is single spaces between non-spaces).
"""

from __future__ import annotations

from tessera.functions import bytelevel as BL
from tessera.functions import text as T

WORD_PATTERN_RE2 = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def normalize_doc(col: str) -> str:
    return f"trim(regexp_replace(coalesce({col}, ''), {q(T.SPLIT_WS_CLASS)}, ' ', 'g'))"


def clean_line(col: str) -> str:
    x = f"regexp_replace(coalesce({col}, ''), {q(T.CONTROL_CLASS)}, '', 'g')"
    return f"trim(regexp_replace({x}, {q(T.CLEAN_WS_CLASS)}, ' ', 'g'))"


def canonical(col: str) -> str:
    return clean_line(normalize_doc(col))


def words(col: str) -> str:
    return f"regexp_extract_all({col}, {q(WORD_PATTERN_RE2)})"


def words_raw(col: str) -> str:
    """``words`` of any text: a run of white space before a word leaves its last character to it,
    so the text is cut there first (U+E000 marks the cuts)."""
    cut = f"regexp_replace({col}, '(\\s+)(\\s)(\\S)', '\\1' || chr(57344) || '\\2\\3', 'g')"
    return f"flatten(list_transform(string_split({cut}, chr(57344)), lambda part: {words('part')}))"


def byte_values(col: str) -> str:
    return f"list_transform(regexp_extract_all(hex(encode({col})), '..'), lambda h: ('0x' || h)::INTEGER)"


def byte_chars(col: str) -> str:
    """List of byte-level characters of ``col``."""
    return f"list_transform({byte_values(col)}, lambda b: chr({BL.duckdb_byte_char_list()}[b + 1]))"


def base_ids(col: str) -> str:
    return f"list_transform({byte_values(col)}, lambda b: {BL.duckdb_base_id_list()}[b + 1])"


def md5_int(expr: str) -> str:
    """First 15 hex digits of md5 as a bigint (same as Spark ``conv(substring(md5(..),1,15),16,10)``)."""
    return f"('0x' || substr(md5({expr}), 1, 15))::BIGINT"
