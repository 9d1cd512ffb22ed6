"""P7/P9 pieces: the byte-level alphabet as JVM-side string and array expressions.

Byte-level BPE maps each UTF-8 byte to one visible character: printable bytes keep their own code
point, the others get 256, 257, ... in byte order. Base ids are the 4 special tokens followed by the
256 byte characters sorted by code point. Both tables are built from that rule below.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's behaviour)
# ---------------------------------------------------------------------------
# Special tokens in id order: <s>=0, <pad>=1, </s>=2, <unk>=3.
SPECIAL_TOKENS = ["<s>", "<pad>", "</s>", "<unk>"]
EOS_TOKEN = "</s>"
# Bytes that keep their own code point: '!'..'~', U+00A1..U+00AC, U+00AE..U+00FF.
PRINTABLE_RANGES = [(33, 126), (161, 172), (174, 255)]


def _printable(b: int) -> bool:
    return any(lo <= b <= hi for lo, hi in PRINTABLE_RANGES)


def _build_tables() -> tuple[str, list[int]]:
    chars: list[str] = []
    extra = 0
    for b in range(256):
        if _printable(b):
            chars.append(chr(b))
        else:
            chars.append(chr(256 + extra))
            extra += 1
    order = sorted(range(256), key=lambda b: ord(chars[b]))
    ids = [0] * 256
    for rank, b in enumerate(order):
        ids[b] = len(SPECIAL_TOKENS) + rank
    return "".join(chars), ids


BYTE_CHARS, BASE_IDS = _build_tables()
LATIN1 = "".join(chr(i) for i in range(256))
BASE_VOCAB_SIZE = len(SPECIAL_TOKENS) + 256
EOS_ID = SPECIAL_TOKENS.index(EOS_TOKEN)


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_byte_level(c: Column | str) -> Column:
    """UTF-8 bytes of ``c`` rendered as byte-level characters (one char per byte)."""
    return F.translate(latin1_view(c), LATIN1, BYTE_CHARS)


def from_byte_level(c: Column | str) -> Column:
    """Inverse of :func:`to_byte_level`; invalid UTF-8 becomes U+FFFD."""
    latin = F.translate(_c(c), BYTE_CHARS, LATIN1)
    return F.decode(F.encode(latin, "ISO-8859-1"), "UTF-8")


def latin1_view(c: Column | str) -> Column:
    """The UTF-8 bytes of ``c`` as a string with one character (code point 0-255) per byte."""
    return F.decode(F.encode(_c(c), "UTF-8"), "ISO-8859-1")


def byte_values(c: Column | str) -> Column:
    """array<int> of the UTF-8 bytes of ``c`` (``ascii`` of each character of the Latin-1 view)."""
    return F.transform(F.split(latin1_view(c), ""), lambda ch: F.ascii(ch))


def base_ids(c: Column | str) -> Column:
    """Byte-level base token ids of ``c`` (no merges)."""
    table = F.array(*[F.lit(i) for i in BASE_IDS])
    return F.transform(byte_values(c), lambda b: F.element_at(table, b + 1))


def with_eos(ids: Column | str, eos_id: int | None = EOS_ID) -> Column:
    """P10: append the end-of-document id when one is known."""
    col = _c(ids)
    if eos_id is None:
        return col
    return F.concat(col, F.array(F.lit(eos_id).cast("int")))


def symbols(c: Column | str) -> Column:
    """Space-delimited symbol string of a byte-level word (space never occurs in the alphabet)."""
    return F.array_join(F.split(_c(c), ""), " ")


def duckdb_byte_char_list() -> str:
    """The byte -> character table as a DuckDB list literal of code points (for oracle SQL)."""
    return "[" + ",".join(str(ord(ch)) for ch in BYTE_CHARS) + "]"


def duckdb_base_id_list() -> str:
    return "[" + ",".join(str(i) for i in BASE_IDS) + "]"


def text_pieces(c: Column | str, piece_chars: int = 65536) -> Column:
    """A text cut into consecutive pieces of at most ``piece_chars`` code points (one linear regex
    pass), so byte ids are built per piece rather than per whole document."""
    return F.regexp_extract_all(_c(c), F.lit("(?s).{1,%d}" % piece_chars), 0)


#: Stands for the EOS among the bytes of a text: no UTF-8 text holds it.
EOS_BYTE = 0xFF


def byte_table(eos_id: int = EOS_ID) -> np.ndarray:
    """Base id by byte, the EOS for :data:`EOS_BYTE`."""
    return np.array([*BASE_IDS[:EOS_BYTE], eos_id], np.int32)


def raw_pieces(docs, piece_chars: int = 65536, eos_piece: int = 2 ** 31 - 1):
    """``(shard, ord, piece, bytes)`` of ``(shard, ord, text)``: the UTF-8 bytes of each text piece and
    one EOS piece per document, from one pass over the texts. :func:`byte_table` turns bytes into ids."""
    text = F.col("text")
    cut = F.when(F.octet_length(text) <= piece_chars, F.filter(F.array(text), lambda t: t != "")) \
        .otherwise(text_pieces(text, piece_chars))
    pieces = F.concat(F.transform(cut, lambda t, k: F.struct(k.alias("piece"), F.encode(t, "UTF-8").alias("bytes"))),
                      F.array(F.struct(F.lit(eos_piece).alias("piece"), F.unhex(F.lit(f"{EOS_BYTE:X}")).alias("bytes"))))
    return docs.select("shard", "ord", F.explode(pieces).alias("_p")).select("shard", "ord", "_p.piece", "_p.bytes")


def byte_pieces(docs, shard_col: str = "shard", ord_col: str = "ord", text_col: str = "text",
                piece_chars: int = 65536, eos_id: int | None = EOS_ID, eos_piece: int = 2 ** 31 - 1):
    """``(shard, ord, piece, ids)``: base ids of each text piece, plus one EOS piece per document."""
    p = docs.select(F.col(shard_col).alias("shard"), F.col(ord_col).alias("ord"),
                    F.posexplode(text_pieces(text_col, piece_chars)).alias("piece", "_t"))
    p = p.select("shard", "ord", "piece", base_ids("_t").alias("ids"))
    if eos_id is None:
        return p
    e = docs.select(F.col(shard_col).alias("shard"), F.col(ord_col).alias("ord"),
                    F.lit(eos_piece).alias("piece"), F.array(F.lit(eos_id)).alias("ids"))
    return p.unionByName(e)
