"""11. BPE encoding and decoding with a vocabulary of words (lower case, word ends).

A word is a contiguous array of parts with the rank of each boundary between two neighbours. The
least rank is searched by a scan, its boundary goes, and the ranks of the two boundaries beside it
are looked up again, until no boundary has a rank. The scan costs the square of a word's length,
so words of over ``SHORT`` bytes are merged by the same ranks from a heap.

Texts are normalised and cut as the vocabulary file says: its special tokens, wherever their
strings stand in a text, are single ids; the rest is composed (NFC), letters become lower case one by one, and words are found by the file's pattern. Words
recur, so each worker keeps a bounded dictionary of encoded words. A file with other steps is
refused. The file is read on the driver and sent to the tasks (1.7 MB).
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import sys
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import free_name, prepare

#: Longest word, in bytes, that is merged by scans.
SHORT = 256
CACHE, CACHED_LENGTH = 200_000, 32
_SHIFT = 24

# The steps and the pattern of the vocabulary files that this module reads.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
# White space of that pattern; letters, numbers and lower-case forms that came with
# later versions of Unicode than the one of Python's tables (first and last code point; the third
# number of a lower-case range is the distance to the lower-case form).
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LETTERS = [(0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65),
           (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E),
           (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0),
           (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED),
           (0x1E5F0, 0x1E5F0)]
NUMBERS = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79),
           (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]
LOWER = [(0x1C89, 0x1C89, 1), (0xA7CB, 0xA7CB, 0x264 - 0xA7CB), (0xA7CC, 0xA7CC, 1), (0xA7CE, 0xA7CE, 1),
         (0xA7D2, 0xA7D2, 1), (0xA7D4, 0xA7D4, 1), (0xA7DA, 0xA7DA, 1), (0xA7DC, 0xA7DC, 0x19B - 0xA7DC),
         (0x10D50, 0x10D65, 0x20), (0x16EA0, 0x16EB8, 0x1B)]

# Marks that the library's composition takes for ordinary characters, as it has them
# from a version of Unicode before they were given.
MARKS = [(0x7FD, 0x7FD), (0x898, 0x89F), (0x8CA, 0x8D3), (0x9FE, 0x9FE), (0xC3C, 0xC3C), (0xD3B, 0xD3C), (0xEBA,
         0xEBA), (0x1715, 0x1715), (0x1ABF, 0x1ACE), (0x1DF6, 0x1DFA), (0xA82C, 0xA82C), (0x10D24, 0x10D27),
         (0x10EAB, 0x10EAC), (0x10EFD, 0x10EFF), (0x10F46, 0x10F50), (0x10F82, 0x10F85), (0x11070, 0x11070),
         (0x1133B, 0x1133B), (0x1145E, 0x1145E), (0x11839, 0x1183A), (0x11930, 0x11930), (0x1193D, 0x1193E),
         (0x11943, 0x11943), (0x119E0, 0x119E0), (0x11A34, 0x11A34), (0x11A47, 0x11A47), (0x11A99, 0x11A99),
         (0x11D42, 0x11D42), (0x11D44, 0x11D45), (0x11D97, 0x11D97), (0x11F41, 0x11F42), (0x16FF0, 0x16FF1),
         (0x1E08F, 0x1E08F), (0x1E130, 0x1E136), (0x1E2AE, 0x1E2AE), (0x1E2EC, 0x1E2EF), (0x1E4EC, 0x1E4EF)]


def _classes() -> dict[str, str]:
    """Letters and numbers as ranges of a character class, below U+10000 (lower-case key) and above."""
    found = {"L": [], "N": []}
    for c in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(c))[0]
        if kind in found:
            runs = found[kind]
            if runs and runs[-1][1] == c - 1:
                runs[-1][1] = c
            else:
                runs.append([c, c])
    out = {}
    for kind, more in (("L", LETTERS), ("N", NUMBERS)):
        runs = [*found[kind], *more]
        out[kind] = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs)
        out[kind.lower()] = "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in runs if b < 0x10000)
    return out


def byte_alphabet() -> list[str]:
    """The visible character that stands for each byte: printable Latin-1 ones for themselves,
    the others, in order, from U+0100 on."""
    kept = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in kept else next(others)) for b in range(256)]


class Vocabulary:
    """Ids, ranks and patterns of a vocabulary file; ``encode`` and ``decode`` of one text."""

    def __init__(self, spec: bytes):
        d = json.loads(spec)
        model, pre = d["model"], d["pre_tokenizer"]["pretokenizers"]
        plain = (d["normalizer"].get("normalizers") == NORMALIZERS and d["decoder"] is None
                 and [p["type"] for p in pre] == ["Split", "ByteLevel"]
                 and pre[0]["pattern"] == {"Regex": PATTERN} and pre[0]["behavior"] == "Removed" and pre[0]["invert"]
                 and not pre[1]["add_prefix_space"] and not pre[1]["use_regex"]
                 and model["type"] == "BPE" and not model["continuing_subword_prefix"] and not model["dropout"]
                 and not model["ignore_merges"] and not model["byte_fallback"] and not model["unk_token"]
                 and not any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in d["added_tokens"]))
        if not plain:
            raise ValueError("the vocabulary file has steps that this encoder does not know")
        ids, end = model["vocab"], model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in d["added_tokens"]}
        self.tokens = {i: t for t, i in (ids | self.special).items()}
        alphabet = byte_alphabet()
        self.inner = [ids[c] for c in alphabet]
        self.last = [ids[c + end] for c in alphabet]
        self.rank: dict[int, int] = {}
        self.merged: list[int] = []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank.setdefault(ids[a] << _SHIFT | ids[b], rank)
            self.merged.append(ids[a + b])
        self.none = len(self.merged)
        kinds = _classes()
        # the second pattern is for texts without characters above U+FFFF; its classes are far smaller
        self.words, self.words_low = [
            re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{kinds[x]}]+|[{kinds[y]}]|[^{WHITE}{kinds[x]}{kinds[y]}]+")
            for x, y in (("L", "N"), ("l", "n"))]
        self.cut = re.compile("|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.lower = {c: chr(c + d) for a, b, d in LOWER for c in range(a, b + 1)} | {ord("Σ"): "σ"}
        marks = {chr(c) for a, b in MARKS for c in range(a, b + 1)}
        self.marks = re.compile(f"([{''.join(sorted(marks))}])")
        self.rare = marks | {chr(c) for c in self.lower}
        # two generations: what is used again moves to the new one, the old one goes when that is full
        self.cache: dict[str, tuple[int, str, str]] = {}
        self.older: dict[str, tuple[int, str, str]] = {}

    def merge(self, word: str) -> list[int]:
        """Ids of one word."""
        data = word.encode()
        parts = [self.inner[b] for b in data]
        parts[-1] = self.last[data[-1]]
        if len(parts) > SHORT:
            return self._merge_long(parts)
        look, none, merged = self.rank.get, self.none, self.merged
        ranks = [look(a << _SHIFT | b, none) for a, b in zip(parts, parts[1:])]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            k = ranks.index(best)  # of equal ranks the leftmost
            parts[k] = merged[best]
            del parts[k + 1], ranks[k]
            if k:
                ranks[k - 1] = look(parts[k - 1] << _SHIFT | parts[k], none)
            if k < len(ranks):
                ranks[k] = look(parts[k] << _SHIFT | parts[k + 1], none)
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        """The same merges in the same order, n log n in the length."""
        n, look, none = len(parts), self.rank.get, self.none
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if (r := look(a << _SHIFT | b, none)) < none]
        heapq.heapify(heap)
        while heap:
            rank, k = heapq.heappop(heap)
            j = after[k]
            if parts[k] < 0 or j >= n or look(parts[k] << _SHIFT | parts[j], none) != rank:
                continue
            parts[k], parts[j] = self.merged[rank], -1
            after[k] = after[j]
            if after[j] < n:
                before[after[j]] = k
            for i in (before[k], k):
                if i >= 0 and after[i] < n:
                    r = look(parts[i] << _SHIFT | parts[after[i]], none)
                    if r < none:
                        heapq.heappush(heap, (r, i))
        return [p for p in parts if p >= 0]

    def find(self, text: str) -> list[str]:
        """Words of a text without special tokens, normalised. White space is in no word, so its
        runs may stay as they are."""
        if text.isascii():
            return self.words_low.findall(text.lower())
        if self.rare.isdisjoint(text):
            text = unicodedata.normalize("NFC", text)
        else:
            text = "".join([unicodedata.normalize("NFC", part) for part in self.marks.split(text)]).translate(self.lower)
        high = len(text.encode("utf-16-le", "surrogatepass")) > 2 * len(text)
        return (self.words if high else self.words_low).findall(text.lower())

    def segments(self, text: str) -> list[tuple[str, int | None]]:
        """Parts of a text: (plain text, None) or (string, id) of a special token."""
        if self.cut is None or not self.cut.search(text):
            return [(text, None)]
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += [(text[at:m.start()], None), (m.group(), self.special[m.group()])]
            at = m.end()
        return [*out, (text[at:], None)]

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for part, special in self.segments(text):
            if special is None:
                for w in self.find(part):
                    out += self.merge(w)
            else:
                out.append(special)
        return out

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by a space, as a vocabulary without a decoder gives them; unknown ids go."""
        return " ".join([self.tokens[i] for i in ids if i in self.tokens])

    def entry(self, word: str) -> tuple[int, str, str]:
        """Number of ids, ids and tokens joined by spaces of a word; kept if it is short."""
        got = self.older.get(word)
        if got is None:
            own = self.merge(word)
            got = (len(own), " ".join([str(i) for i in own]), self.decode(own))
        if len(word) <= CACHED_LENGTH:
            if len(self.cache) >= CACHE:
                self.older, self.cache = self.cache, {}
            self.cache[word] = got
        return got

    def round_trip(self, text: str) -> tuple[int, str, str]:
        """(n_tokens, ids joined by spaces, decode(ids))."""
        got, cached, entry = [], self.cache.get, self.entry
        for part, special in self.segments(text):
            if special is None:
                got += [cached(w) or entry(w) for w in self.find(part)]
            else:
                got.append((1, str(special), part))
        if not got:
            return 0, "", ""
        n, ids, plain = zip(*got)
        return sum(n), " ".join(ids), " ".join(plain)


_LOADED: dict[bytes, Vocabulary] = {}


def vocabulary(spec: bytes) -> Vocabulary:
    """One per worker and file."""
    key = hashlib.md5(spec).digest()
    if key not in _LOADED:
        _LOADED[key] = Vocabulary(spec)
    return _LOADED[key]


def _spec(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, path: str, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """``docs`` with the ids of each whole text (null: none) in a column."""
    prepare(docs.sparkSession)
    spec = docs.sparkSession.sparkContext.broadcast(_spec(path))

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        v = vocabulary(spec.value)
        return texts.map(lambda t: v.encode(t or ""))

    return docs.withColumn(out_col, ids(F.col(text_col)))


def decode(docs: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``docs`` with the text of each row's ids (null: empty)."""
    prepare(docs.sparkSession)
    spec = docs.sparkSession.sparkContext.broadcast(_spec(path))

    @F.pandas_udf("string")
    def text(ids: pd.Series) -> pd.Series:
        v = vocabulary(spec.value)
        return ids.map(lambda i: v.decode([int(x) for x in i] if i is not None else []))

    return docs.withColumn(out_col, text(F.col(ids_col)))


def digest(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` (input columns of those
    names are replaced). Null and empty texts have no ids. Rows are encoded one by one, so
    repeated rows and null ids are as any other; an empty table gives an empty table."""
    prepare(docs.sparkSession)
    spec = docs.sparkSession.sparkContext.broadcast(_spec(path))

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def both(texts: pd.Series) -> pd.DataFrame:
        v = vocabulary(spec.value)
        rows = []
        for t in texts:
            n, ids, plain = v.round_trip(t or "")
            rows.append((n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(plain.encode()).hexdigest()))
        return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    rest = [c for c in docs.columns if c not in ("n_tokens", "ids_sha256", "decoded_sha256")]
    got = free_name("digest", rest)
    return docs.select(*rest, both(F.col(text_col)).alias(got)).select(*rest, f"{got}.*")
