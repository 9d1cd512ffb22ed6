"""13. Conversation structure repair by a parallel Viterbi search with rank convergence.

A conversation is repaired by the cheapest edits after which its role initials read
``(s?(ua)+)?``. The search has four states: nothing yet, after a system row, after a user row,
after an assistant row. What the rows from some place on cost at least, from each state, is that
place's cost vector; it follows from the vector of the next place and the row between them.

Rows are sorted once over the whole table, which cuts a long conversation over many partitions,
and every conversation is cut at fixed places into chunks, so that no chunk is longer than
``2**block_bits`` rows. All chunks start at once, from a speculative vector at their right end: as
if the conversation ended there. In a fix-up pass each chunk whose right neighbour now says
something else reruns from that vector, next to its old run, until the two vectors differ by a
constant only; what stands to the left is then as before but for that constant. Passes end when no
chunk's vector changes. Rows that are deleted whatever happens carry a vector through a chunk
unchanged, so a pass takes sixteen times as many neighbouring chunks in one go as the pass before
it: the number of passes grows with the logarithm of the longest conversation.

With the true vector at each chunk's right end, edits are read off from left to right. Each chunk
finds where it leads from each of the states; these maps are chained along the conversation, and
all chunks trace at once. At each step the letter that comes first among the cheapest edits is
taken, which gives the least sequence of letters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import ascii_trim, materialize, prepare

BLOCK_BITS = 12
#: How many times as many chunks each fix-up pass takes together as the one before it.
GROWTH_BITS = 4
RENAME, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Cost vector at the end of a conversation, by state: start, after s, after u, after a.
END = (0, 10, 5, 0)
#: Row codes: initial (s, u, a, other), must go, truncated.
INITIALS = "sua"
MUST_GO, CUT_OFF = 4, 8
_KEEP = {(0, 0): 1, (0, 1): 2, (1, 1): 2, (2, 2): 3, (3, 1): 2}
_NEXT = ((2, "u"), (2, "u"), (3, "a"), (2, "u"))  # state -> state and role that may be put there
_PAIRS = np.zeros((4, 4), bool)
_PAIRS[0, 1] = _PAIRS[1, 2] = _PAIRS[2, 1] = True


class Steps:
    """Cost vectors up to a constant, numbered; steps from one to the next are looked up."""

    def __init__(self) -> None:
        self.vectors: list[tuple[int, ...]] = []
        self.number: dict[tuple[int, ...], int] = {}
        self.step: dict[int, tuple[int, int]] = {}
        self.choice: dict[int, tuple[tuple[str, str, str | None, int], ...]] = {}

    def id(self, vector: tuple[int, ...]) -> int:
        if vector not in self.number:
            self.number[vector] = len(self.vectors)
            self.vectors.append(vector)
        return self.number[vector]

    def _costs(self, v: tuple[int, ...], code: int) -> tuple[list[int], list[int]]:
        """Costs before a row, by state: with an edit of that row, and with rows put in before it."""
        extra = TRUNCATED if code & CUT_OFF else 0
        at = []
        for q in range(4):
            best = DELETE + v[q]
            if not code & MUST_GO:
                if (q, code & 3) in _KEEP:
                    best = min(best, extra + v[_KEEP[q, code & 3]])
                best = min(best, RENAME + extra + v[_NEXT[q][0]])
            at.append(best)
        u, a = min(at[2], INSERT + at[3]), min(at[3], INSERT + at[2])
        return at, [min(at[0], INSERT + u), min(at[1], INSERT + u), u, a]

    def back(self, vid: int, code: int) -> tuple[int, int]:
        """Vector before a row and the constant taken off it, from the vector after the row."""
        key = vid << 4 | code
        if key not in self.step:
            costs = self._costs(self.vectors[vid], code)[1]
            least = min(costs)
            self.step[key] = self.id(tuple(c - least for c in costs)), least
        return self.step[key]

    def choose(self, vid: int, code: int) -> tuple[tuple[str, str, str | None, int], ...]:
        """By state before a row: roles put in, letter of the row's edit, new role, next state."""
        key = vid << 4 | code
        if key not in self.choice:
            v = self.vectors[vid]
            at, costs = self._costs(v, code)
            extra = TRUNCATED if code & CUT_OFF else 0
            out = []
            for q in range(4):
                put = ""
                while True:
                    if DELETE + v[q] == costs[q]:
                        out.append((put, "D", None, q))
                    elif INSERT + costs[_NEXT[q][0]] == costs[q]:
                        put += _NEXT[q][1]
                        q = _NEXT[q][0]
                        continue
                    elif (q, code & 3) in _KEEP and extra + v[_KEEP[q, code & 3]] == costs[q]:
                        out.append((put, "K", None, _KEEP[q, code & 3]))
                    else:
                        out.append((put, "R", _NEXT[q][1], _NEXT[q][0]))
                    break
            self.choice[key] = tuple(out)
        return self.choice[key]

    def run(self, codes: bytes, right: tuple[int, ...]) -> tuple[tuple[int, ...], int]:
        """Vector at the left end of a chunk and its cost, from the vector at the right end."""
        vid, total = self.id(right), 0
        for code in reversed(codes):
            vid, cost = self.back(vid, code)
            total += cost
        return self.vectors[vid], total

    def rerun(self, codes: bytes, right: tuple[int, ...], old_right: tuple[int, ...], old_left: tuple[int, ...],
              old_cost: int) -> tuple[tuple[int, ...], int]:
        """The same from a corrected vector: stops where it differs from the old run by a constant."""
        vid, old, change = self.id(right), self.id(old_right), 0
        for code in reversed(codes):
            if vid == old:
                return old_left, old_cost + change
            vid, cost = self.back(vid, code)
            old, old_step = self.back(old, code)
            change += cost - old_step
        return self.vectors[vid], old_cost + change

    def before_rows(self, codes: bytes, right: tuple[int, ...]) -> list[int]:
        """Number of the vector after each row."""
        vid, out = self.id(right), []
        for code in reversed(codes):
            out.append(vid)
            vid, _ = self.back(vid, code)
        out.reverse()
        return out


STEPS = Steps()


def _end(q: int) -> str:
    """Roles put in behind the last row."""
    return ("", "ua", "a", "")[q]


# ---------------------------------------------------------------------------
# rows
# ---------------------------------------------------------------------------

def key_of(conv_id: str = "conv_id") -> Column:
    """A conversation's id as text, never null."""
    return F.when(F.col(conv_id).isNull(), "n").otherwise(F.concat(F.lit("v"), F.col(conv_id).cast("string")))


def damage(conversations: DataFrame) -> DataFrame:
    """Rows of ``conversations`` (conv_id, turn, role, text) as they are after the damage that
    crc32 of ``conv_id:turn`` modulo 20 names: 0 drops a row, 1 empties its text, 2 takes the
    sentence ends out, 3 repeats it, 4 makes it the user's. Null roles and texts are one space, and
    so are null ids and turns within the hashed string."""
    blank = F.lit(" ")
    code = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"),
                            F.coalesce(F.col("turn").cast("string"), blank)).cast("binary")) % 20
    text = F.coalesce("text", blank)
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", blank).alias("role"),
                                text.alias("text"), code.alias("code")).where("code <> 0")
    return rows.select(
        "conv_id", "turn", F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.regexp_replace("text", "[.!?]", ""))
        .otherwise(F.col("text")).alias("text"),
        F.explode(F.sequence(F.lit(1), F.when(F.col("code") == 3, 2).otherwise(1))).alias("copy")).drop("copy")


def sequence(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) in order, with a place ``pos`` that grows along each
    conversation (``key``), row codes and a digest of role and text. Rows go by turn, nulls first;
    rows of one turn by role, then by that digest. Equal rows are spread by their place in the
    input, so no partition gets all of them; which is which makes no difference."""
    said = ascii_trim(F.col("text"))
    initial = F.substring("role", 1, 1)
    code = F.coalesce(*[F.when(initial == c, k) for k, c in enumerate(INITIALS)], F.lit(3))
    ended = said.endswith(".") | said.endswith("!") | said.endswith("?")
    rows = rows.select(
        key_of().alias("key"), "turn", "role", "text",
        F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))).alias("digest"),
        (code + F.when(said == "", MUST_GO).when(~ended, CUT_OFF).otherwise(0)).cast("byte").alias("code"),
        F.monotonically_increasing_id().alias("source"))
    rows = rows.orderBy("key", F.col("turn").asc_nulls_first(), "role", "digest", "source").drop("source")
    return materialize(rows.withColumn("pos", F.monotonically_increasing_id()), "conversation-rows")


_CHUNK = ("key string, first_pos long, codes binary, blank long, duplicate long, truncated long, illegal long, "
          "first_initial int, last_initial int, first_turn long, last_turn long, min_turn long, max_turn long, "
          "turns long, left_vector array<int>, cost long")


def _build(table: pa.Table) -> pa.Table:
    """Chunks of one block of consecutive places: rows, and marks of the first of equal rows."""
    mark = table["mark"].to_numpy()
    first = np.sort(table["pos"].to_numpy()[mark])
    table = table.filter(pa.array(~mark)).sort_by("pos")
    n = table.num_rows
    pos, code = table["pos"].to_numpy(), table["code"].to_numpy().astype(np.int64)
    key = table["key"].combine_chunks()
    new = np.ones(n, bool)
    new[1:] = pc.not_equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False)
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], n)

    def per_chunk(values: np.ndarray) -> list[int]:
        return np.add.reduceat(values.astype(np.int64), starts).tolist()

    initial, blank = code & 3, code & MUST_GO > 0
    again = ~np.isin(pos, first) & ~blank
    cut = (code & CUT_OFF > 0) & ~blank & ~again
    codes = (initial | np.where(blank | again, MUST_GO, 0) | np.where(cut, CUT_OFF, 0)).astype(np.uint8).tobytes()
    illegal = np.zeros(n, bool)
    illegal[1:] = ~_PAIRS[initial[:-1], initial[1:]] & ~new[1:]
    null = table["turn"].is_null().to_numpy()
    turn = table["turn"].fill_null(0).to_numpy()
    other = ~null
    other[1:] &= new[1:] | null[:-1] | (turn[1:] != turn[:-1])
    turns = table["turn"].to_pylist()
    out = {f: [] for f in ("left_vector", "cost", "min_turn")}
    for a, b in zip(starts, ends):
        left, cost = STEPS.run(codes[a:b], END)
        out["left_vector"].append(left)
        out["cost"].append(cost)
        out["min_turn"].append(next((t for t in turns[a:b] if t is not None), None))
    last = [turns[b - 1] for b in ends]  # nulls come first: the last turn is the largest
    return pa.table({
        "key": key.take(pa.array(starts)), "first_pos": pos[starts], "codes": [codes[a:b] for a, b in zip(starts, ends)],
        "blank": per_chunk(blank), "duplicate": per_chunk(again), "truncated": per_chunk(cut),
        "illegal": per_chunk(illegal), "first_initial": pa.array(initial[starts], pa.int32()),
        "last_initial": pa.array(initial[ends - 1], pa.int32()),
        "first_turn": pa.array([turns[a] for a in starts], pa.int64()), "last_turn": pa.array(last, pa.int64()),
        "min_turn": pa.array(out["min_turn"], pa.int64()), "max_turn": pa.array(last, pa.int64()), "turns": per_chunk(other),
        "left_vector": pa.array(out["left_vector"], pa.list_(pa.int32())), "cost": pa.array(out["cost"], pa.int64())})


def chunks(rows: DataFrame, block_bits: int = BLOCK_BITS) -> DataFrame:
    """Chunks of the rows of :func:`sequence`, numbered along each conversation, with the result of
    the speculative run. The first of equal rows is found by a partial aggregate; marks and rows
    meet by block of places, so a group holds at most two entries for each place of a block."""
    block = F.shiftright("pos", block_bits)
    firsts = rows.groupBy("key", "digest").agg(F.min("pos").alias("pos"))
    both = rows.select(block.alias("block"), "pos", "key", "turn", "code", F.lit(False).alias("mark")).unionByName(
        firsts.select(block.alias("block"), "pos", F.lit(True).alias("mark")), allowMissingColumns=True)
    built = both.groupBy("block").applyInArrow(_build, _CHUNK)
    along = Window.partitionBy("key").orderBy("first_pos")
    joined = F.lag("last_initial").over(along)
    legal = F.lit(False)
    for a, b in np.argwhere(_PAIRS).tolist():
        legal = legal | ((joined == a) & (F.col("first_initial") == b))
    same = F.coalesce(F.lag("last_turn").over(along) == F.col("first_turn"), F.lit(False))
    out = built.select(
        "*", F.row_number().over(along).alias("k"), F.count(F.lit(1)).over(Window.partitionBy("key")).alias("n_chunks"),
        (joined.isNotNull() & ~legal).cast("long").alias("illegal_join"), same.cast("long").alias("same_turn"))
    out = out.withColumn("illegal", F.col("illegal") + F.col("illegal_join")).withColumn("turns", F.col("turns") - F.col("same_turn"))
    end = F.array(*[F.lit(c) for c in END])
    return materialize(out.drop("illegal_join", "same_turn", "first_turn", "last_turn", "first_initial", "last_initial")
                       .withColumn("right_vector", end), "conversation-chunks")


# ---------------------------------------------------------------------------
# search
# ---------------------------------------------------------------------------

def _fix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rerun chunks from right to left; each takes the vector of its right neighbour, the first of
    a group the one that the pass before gave."""
    key = unit = right = None
    for batch in batches:
        rows = batch.to_pylist()
        for r in rows:
            if (r["key"], r["unit"]) != (key, unit):
                key, unit, right = r["key"], r["unit"], tuple(r["new_right"])
            old = tuple(r["right_vector"])
            left, cost = tuple(r["left_vector"]), r["cost"]
            if right != old:
                left, cost = STEPS.rerun(r["codes"], right, old, left, cost)
            r["right_vector"], r["left_vector"], r["cost"] = list(right), list(left), cost
            right = left
        yield pa.RecordBatch.from_pylist(rows, schema=batch.schema)


def solve(table: DataFrame) -> DataFrame:
    """The chunks with the true vectors at both ends (up to a constant) and their part of the cost.
    Conversations of one chunk are right after the speculative run; the others go through fix-up
    passes until every chunk ran from the vector that its right neighbour ends with."""
    long = table.where("n_chunks > 1").select("key", "k", "n_chunks", "codes", "left_vector", "right_vector", "cost")
    done = 0
    while True:
        told = long.select("key", (F.col("k") - 1).alias("k"), F.col("left_vector").alias("new_right"))
        unit = F.shiftright(F.col("n_chunks") - F.col("k"), min(GROWTH_BITS * done, 60)).alias("unit")
        now = long.join(told, ["key", "k"], "left").withColumn("new_right", F.coalesce("new_right", "right_vector"))
        if now.where("new_right <> right_vector").isEmpty():
            break
        now = now.select("*", unit)
        now = now.repartition("key", "unit").sortWithinPartitions("key", "unit", F.col("k").desc())
        long = materialize(now.mapInArrow(_fix, now.schema).drop("unit", "new_right"), "conversation-pass")
        done += 1
    true = long.select("key", "k", "left_vector", "right_vector", "cost")
    rest = table.drop("left_vector", "right_vector", "cost").where("n_chunks > 1").join(true, ["key", "k"])
    return table.where("n_chunks = 1").unionByName(rest)


def _exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """State at a chunk's right end by state at its left end."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            states = [0, 1, 2, 3]
            for code, vid in zip(r["codes"], STEPS.before_rows(r["codes"], tuple(r["right_vector"]))):
                chosen = STEPS.choose(vid, code)
                states = [chosen[q][3] for q in states]
            out.append({"key": r["key"], "k": r["k"], "exits": states})
        yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("key", pa.string()), ("k", pa.int32()), ("exits", pa.list_(pa.int32()))]))


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """State at each chunk's left end, along the conversations."""
    key, state = None, 0
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            if r["key"] != key:
                key, state = r["key"], 0
            out.append({"key": key, "k": r["k"], "entry": state})
            state = r["exits"][state]
        yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("key", pa.string()), ("k", pa.int32()), ("entry", pa.int32())]))


def _trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits of a chunk's rows, from the state at its left end."""
    for batch in batches:
        for r in batch.to_pylist():
            q, edits = r["entry"], []
            for code, vid in zip(r["codes"], STEPS.before_rows(r["codes"], tuple(r["right_vector"]))):
                put, letter, role, q = STEPS.choose(vid, code)[q]
                edits.append((put, letter, role))
            put, letters, roles = (list(x) for x in zip(*edits))
            after = [""] * len(edits)
            if r["last"]:
                after[-1] = _end(q)
            n = len(edits)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(r["first_pos"], r["first_pos"] + n)), pa.array(put), pa.array(letters),
                 pa.array(roles, pa.string()), pa.array(after)], names=["pos", "before", "edit", "new_role", "after"])


def trace(solved: DataFrame) -> DataFrame:
    """Edits by place: ``before`` and ``after`` (initials of the roles put in there), ``edit``
    (K, R or D) and ``new_role`` (its initial)."""
    maps = solved.where("n_chunks > 1").select("key", "k", "codes", "right_vector").mapInArrow(
        _exits, "key string, k int, exits array<int>")
    entries = maps.repartition("key").sortWithinPartitions("key", "k").mapInArrow(_chain, "key string, k int, entry int")
    begun = solved.select("key", "k", "first_pos", "codes", "right_vector", (F.col("k") == F.col("n_chunks")).alias("last"),
                          "n_chunks")
    one = begun.where("n_chunks = 1").withColumn("entry", F.lit(0))
    many = begun.where("n_chunks > 1").join(entries, ["key", "k"])
    return one.unionByName(many).select("first_pos", "codes", "right_vector", "last", "entry").mapInArrow(
        _trace, "pos long, before string, edit string, new_role string, after string")


def _roles(initials: Column) -> Column:
    return F.transform(F.filter(F.split(initials, ""), lambda c: c != ""), lambda c: F.when(c == "u", "user").otherwise("assistant"))


def _edited(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """Rows in order with their edits; the role is the new one."""
    new = F.when(F.col("new_role") == "u", "user").when(F.col("new_role") == "a", "assistant")
    return rows.select("key", "pos", "role", "text").join(edits, "pos").withColumn("role", F.coalesce(new, "role"))


def repair(conversations: DataFrame, block_bits: int = BLOCK_BITS) -> DataFrame:
    """All edits of ``conversations`` (conv_id, turn, role, text), one row each: ``key`` (see
    :func:`key_of`), ``pos`` and ``part`` (their order), ``edit`` (K keep, R new role, D delete,
    I insert), ``role`` and ``text`` of the repaired row (null if deleted).

    Null roles and texts must be made one space before (:func:`damage` does); null ids are one
    conversation, null turns come first; rows of one turn are ordered as :func:`sequence` says;
    repeated rows are duplicates. Columns other than the four are not read. An empty table gives
    no rows."""
    prepare(conversations.sparkSession)
    rows = sequence(conversations)
    done = _edited(rows, trace(solve(chunks(rows, block_bits))))

    def put(initials: str) -> Column:
        return F.transform(_roles(F.col(initials)), lambda r: F.struct(F.lit("I").alias("edit"), r.alias("role"), F.lit("").alias("text")))

    kept = F.col("edit") != "D"
    own = F.array(F.struct("edit", F.when(kept, F.col("role")).alias("role"), F.when(kept, F.col("text")).alias("text")))
    return done.select("key", "pos", F.posexplode(F.concat(put("before"), own, put("after"))).alias("part", "e")).select(
        "key", "pos", "part", "e.*")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Letters and SHA-256 of each conversation from its rows in order; one row is held."""
    key, letters, sha, held = None, [], hashlib.sha256(), b""

    def row() -> tuple[str, str, str]:
        sha.update(held[:-1])  # without the line end
        return key, "".join(letters), sha.hexdigest()

    def out(found: list[tuple[str, str, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.string()) for k in range(3)],
                                          names=["key", "audit", "repaired_sha256"])

    for batch in batches:
        found = []
        for k, a, lines in zip(*[batch.column(c).to_pylist() for c in ("key", "audit", "lines")]):
            if k != key:
                if key is not None:
                    found.append(row())
                key, letters, sha, held = k, [], hashlib.sha256(), b""
            letters.append(a)
            if lines:
                sha.update(held)
                held = lines.encode()
        if found:
            yield out(found)
    if key is not None:
        yield out([row()])


def digests(edited: DataFrame) -> DataFrame:
    """``audit`` and ``repaired_sha256`` by conversation. A digest runs through its conversation from
    first row to last, so a conversation is one task's here; it streams and holds one row and the
    letters."""
    def lines(initials: str) -> Column:
        return F.replace(F.replace(F.col(initials), F.lit("u"), F.lit("user:\n")), F.lit("a"), F.lit("assistant:\n"))

    own = F.when(F.col("edit") == "D", "").otherwise(F.concat("role", F.lit(":"), "text", F.lit("\n")))
    parts = edited.select("key", "pos", F.concat(F.translate("before", "ua", "II"), "edit", F.translate("after", "ua", "II")).alias("audit"),
                          F.concat(lines("before"), own, lines("after")).alias("lines"))
    return parts.repartition("key").sortWithinPartitions("key", "pos").mapInArrow(
        _digests, "key string, audit string, repaired_sha256 string")


def report(conversations: DataFrame, block_bits: int = BLOCK_BITS) -> DataFrame:
    """Damage ``conversations``, repair them, and give a row per id: counts of gaps, faults and
    illegal neighbours, the cost and letters of the cheapest edits, and the digest of the repaired
    rows. Ids of which no row is left have zeros and empty strings; for nulls, ties and repeated
    rows see :func:`damage` and :func:`repair`. An empty table gives no rows."""
    prepare(conversations.sparkSession)
    rows = sequence(damage(conversations))
    table = chunks(rows, block_bits)
    solved = solve(table)
    cost = F.sum("cost") + F.sum(F.when(F.col("k") == 1, F.element_at("left_vector", 1)).otherwise(0))
    counts = solved.groupBy("key").agg(
        F.coalesce(F.max("max_turn") - F.min("min_turn") + 1 - F.sum("turns"), F.lit(0)).alias("gaps"),
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")], cost.alias("cost"))
    found = digests(_edited(rows, trace(solved)))
    ids = conversations.groupBy("conv_id").agg(F.lit(1).alias("_")).select("conv_id", key_of().alias("key"))
    zeros = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return ids.join(counts, "key", "left").join(found, "key", "left").select(
        "conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
