"""2. SentencePiece encoding and decoding with a merge-type (BPE) vocabulary.

The encoding of a string ends in one certain token for each of its prefixes. The table of those
last tokens is filled from left to right: an automaton names the vocabulary's pieces that end at a
place, and the one that stands is the piece whose pair with the last token before it is compatible,
that is, no merge across their border would have come first. Ids are then read off backwards. The
work is linear in the text.

Pairs are tested by undoing merges in the reverse order of their scores, which needs every piece
to be made of pieces with better scores. The few pieces that are not (runs of spaces) are known
from the vocabulary; a chunk that holds one is merged pair by pair with a heap instead.

Texts are cut at spaces, which no piece spans; chunks recur, so each worker keeps a bounded
dictionary of encoded chunks. The vocabulary is read from the model file on the driver and sent
to the tasks (half a megabyte).
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections import Counter

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import free_name, prepare

SPACE = "▁"
CACHE, CACHED_LENGTH = 200_000, 32


def merge_pairs(symbols: list[str], rank: dict[str, int]) -> tuple[list[str], tuple[str, str] | None]:
    """Merge the adjacent pair of best rank, leftmost first, until none is left; also the last
    pair that was merged."""
    parts = list(symbols)
    left, right = list(range(-1, len(parts) - 1)), list(range(1, len(parts) + 1))
    heap = [(rank[a + b], k, a + b) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in rank]
    heapq.heapify(heap)
    last = None
    while heap:
        _, k, whole = heapq.heappop(heap)
        n = right[k]
        if not parts[k] or n >= len(parts) or parts[k] + parts[n] != whole:
            continue
        last = (parts[k], parts[n])
        parts[k], parts[n] = whole, ""
        right[k] = right[n]
        if right[n] < len(parts):
            left[right[n]] = k
        for i in (left[k], k):
            j = right[i] if i >= 0 else len(parts)
            if j < len(parts) and parts[i] + parts[j] in rank:
                heapq.heappush(heap, (rank[parts[i] + parts[j]], i, parts[i] + parts[j]))
    return [p for p in parts if p], last


class Vocabulary:
    """Pieces, ranks and the automaton of a model; ``encode`` and ``decode`` of one text."""

    def __init__(self, model: bytes):
        import sentencepiece

        reader = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = reader.get_piece_size()
        self.pieces = [reader.id_to_piece(i) for i in range(n)]
        self.byte = {i: int(self.pieces[i][3:5], 16) for i in range(n) if reader.is_byte(i)}
        self.byte_id = {b: i for i, b in self.byte.items()}
        self.unknown = reader.unk_id()
        self.silent = {i for i in range(n) if reader.is_control(i)}
        normal = [i for i in range(n)
                  if i not in self.byte and i not in self.silent and not reader.is_unknown(i)]
        self.ids = {self.pieces[i]: i for i in normal}
        scores = sorted({reader.get_score(i) for i in normal}, reverse=True)
        order = {s: k for k, s in enumerate(scores)}
        many = {self.pieces[i]: order[reader.get_score(i)] for i in normal if len(self.pieces[i]) > 1}
        self.merge_rank = many
        twice = {r for r, k in Counter(many.values()).items() if k > 1}
        # tables by id: rank (single characters: -1) and the two parts that a piece is merged from
        self.rank, self.parts, self.pair = [-1] * n, [None] * n, {}
        self.automaton = ahocorasick.Automaton()
        self.odd = False
        for piece, i in self.ids.items():
            if len(piece) == 1:
                self.automaton.add_word(piece, (i, 1, False))
                continue
            ends, last = merge_pairs(list(piece), many)
            if ends != [piece]:
                continue  # no text is ever encoded with it
            a, b = last
            even = many[piece] not in twice and all(many.get(p, -1) < many[piece] for p in last)
            if even and a in self.ids and b in self.ids:
                self.rank[i], self.parts[i] = many[piece], (self.ids[a], self.ids[b])
                self.pair[self.ids[a], self.ids[b]] = many[piece]
                self.automaton.add_word(piece, (i, len(piece), False))
            else:
                self.automaton.add_word(piece, (i, len(piece), True))
        self.automaton.make_automaton()
        inner = any(SPACE in p.lstrip(SPACE) for p in self.ids)
        lines = any("\n" in p for p in many)
        self.cut = None if inner else re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+" if lines else
                                                 f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")
        self.bigrams = {p[k:k + 2] for p in self.ids for k in range(len(p) - 1)}  # no piece spans any other
        self.plain = [p.replace(SPACE, " ") for p in self.pieces]
        self.special = {*self.byte, *self.silent, self.unknown}
        self.known_pairs: dict[tuple[int, int], bool] = {}
        # two generations: what is used again moves to the new one, the old one goes when that is full
        self.cache: dict[str, tuple[int, str, str]] = {}
        self.older: dict[str, tuple[int, str, str]] = {}

    def compatible(self, a: int, b: int) -> bool:
        """Can token b follow token a? Undo merges from the latest on; no pair at the border may
        have a merge that comes before the one undone last (of equal merges the left one)."""
        key = (a, b)
        if key in self.known_pairs:
            return self.known_pairs[key]
        rank, parts, pair = self.rank, self.parts, self.pair
        bound = 1 << 60
        while True:
            over = pair.get((a, b))
            if over is not None and over < bound:
                found = False
                break
            if rank[a] > rank[b]:
                bound, a = rank[a], parts[a][1]
            elif rank[b] >= 0:
                bound, b = rank[b] + 1, parts[b][0]
            else:
                found = True
                break
        if len(self.known_pairs) >= 4 * CACHE:
            self.known_pairs.clear()
        self.known_pairs[key] = found
        return found

    def _bytes(self, ch: str) -> list[int]:
        if not self.byte_id:
            return [self.unknown]
        return [self.byte_id[b] for b in ch.encode()]

    def encode_chunk(self, chunk: str) -> list[int]:
        n = len(chunk)
        last, size_of = [-1] * (n + 1), [1] * (n + 1)  # -1: a character of no piece
        known, compatible = self.known_pairs, self.compatible
        done = 0
        for end, (i, size, odd) in self.automaton.iter(chunk):  # by end, longest piece first
            if odd:
                return self._merged(chunk)
            end += 1
            if end == done:
                continue
            before = last[end - size]
            if end == size or before < 0 or (known[before, i] if (before, i) in known else compatible(before, i)):
                last[end], size_of[end], done = i, size, end
        out: list[int] = []
        end = n
        while end:
            if last[end] >= 0:
                out.append(last[end])
            else:
                out.extend(self._bytes(chunk[end - 1])[::-1])
            end -= size_of[end]
        out.reverse()
        return out

    def _merged(self, chunk: str) -> list[int]:
        out = []
        for p in merge_pairs(list(chunk), self.merge_rank)[0]:
            out.extend([self.ids[p]] if p in self.ids else self._bytes(p))
        return out

    def chunks(self, text: str) -> list[str]:
        if not text:
            return []
        spaced = SPACE + text.replace(" ", SPACE)
        return self.cut.findall(spaced) if self.cut else [spaced]

    def encode(self, text: str) -> list[int]:
        return [i for c in self.chunks(text) for i in self.encode_chunk(c)]

    def _plain(self, ids: list[int]) -> str:
        if self.special.isdisjoint(ids):
            return "".join([self.plain[i] for i in ids])
        out, held = [], bytearray()
        for i in [*ids, None]:
            if i in self.byte:
                held.append(self.byte[i])
                continue
            if held:
                out.append(_utf8(bytes(held)))
                held.clear()
            if i is not None and i not in self.silent:
                out.append(" ⁇ " if i == self.unknown else self.pieces[i].replace(SPACE, " "))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """The text of some ids; the space that encoding puts in front goes."""
        text = self._plain(ids)
        first = next((i for i in ids if i not in self.silent), None)
        return text[1:] if first is not None and self.pieces[first].startswith(SPACE) else text

    def entry(self, chunk: str) -> tuple[int, str, str]:
        """Number of ids, ids joined by commas, decoded text of a chunk; kept if it is short."""
        got = self.older.get(chunk)
        if got is None:
            bigrams = self.bigrams
            cuts = [k for k in range(1, len(chunk)) if chunk[k - 1:k + 1] not in bigrams]
            if cuts:  # no merge crosses a cut, so the parts are encoded on their own
                n, ids, plain = zip(*[self.cache.get(c) or self.entry(c) for c in
                                      (chunk[a:b] for a, b in zip([0, *cuts], [*cuts, len(chunk)]))])
                got = (sum(n), ",".join(ids), "".join(plain))
            else:
                own = self.encode_chunk(chunk)
                got = (len(own), ",".join([str(i) for i in own]), self._plain(own))
        if len(chunk) <= CACHED_LENGTH:
            if len(self.cache) >= CACHE:
                self.older, self.cache = self.cache, {}
            self.cache[chunk] = got
        return got

    def round_trip(self, text: str) -> tuple[int, str, str]:
        """(n_tokens, ids joined by commas, decode(ids))."""
        if not text:
            return 0, "", ""
        entry = self.entry
        n, ids, plain = zip(*[self.cache.get(c) or entry(c) for c in self.chunks(text)])
        return sum(n), ",".join(ids), "".join(plain)[1:]


def _utf8(data: bytes) -> str:
    """Text of bytes; each byte that belongs to no character is U+FFFD."""
    try:
        return data.decode()
    except UnicodeDecodeError:
        out, k = [], 0
        while k < len(data):
            for size in (1, 2, 3, 4):
                try:
                    out.append(data[k:k + size].decode())
                    k += size
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                k += 1
        return "".join(out)


_LOADED: dict[bytes, Vocabulary] = {}


def vocabulary(model: bytes) -> Vocabulary:
    """One per worker and model."""
    key = hashlib.md5(model).digest()
    if key not in _LOADED:
        _LOADED[key] = Vocabulary(model)
    return _LOADED[key]


def _model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, model_path: str, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """``docs`` with the ids of each whole text (null: none) in a column."""
    prepare(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(_model(model_path))

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        v = vocabulary(model.value)
        return texts.map(lambda t: v.encode(t or ""))

    return docs.withColumn(out_col, ids(F.col(text_col)))


def decode(docs: DataFrame, model_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``docs`` with the text of each row's ids (null: empty)."""
    prepare(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(_model(model_path))

    @F.pandas_udf("string")
    def text(ids: pd.Series) -> pd.Series:
        v = vocabulary(model.value)
        return ids.map(lambda i: v.decode([int(x) for x in i] if i is not None else []))

    return docs.withColumn(out_col, text(F.col(ids_col)))


def digest(docs: DataFrame, model_path: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` (input columns of those
    names are replaced). Null and empty texts have no ids. Rows are encoded one by one, so
    repeated rows and null ids are as any other; an empty table gives an empty table."""
    prepare(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(_model(model_path))

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def both(texts: pd.Series) -> pd.DataFrame:
        v = vocabulary(model.value)
        rows = []
        for t in texts:
            n, ids, plain = v.round_trip(t or "")
            rows.append((n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(plain.encode()).hexdigest()))
        return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    rest = [c for c in docs.columns if c not in ("n_tokens", "ids_sha256", "decoded_sha256")]
    made = free_name("_d", docs.columns)
    return docs.select(*rest, both(F.col(text_col)).alias(made)).select(*rest, f"{made}.*")
