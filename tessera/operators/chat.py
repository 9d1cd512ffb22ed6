"""Conversation tables -> prompt contexts,
request and response records.

``conversations(conv_id, turn, role, text)`` with roles system / user / assistant.
Message order inside a conversation is ``turn``. Per-conversation running sums go through the
bucketed prefix sums of ``order`` so one very long conversation is still split across tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators.order import with_ordinal, with_running_sums

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's behaviour)
# ---------------------------------------------------------------------------
SYSTEM_MARKER = "System:"
USER_MARKER = "User:"
ASSISTANT_MARKER = "Assistant:"
TURN_SEP = "\n"
SYSTEM_DEFAULT = "You are a helpful assistant."
# Request defaults of the chat-completions route.
DEFAULT_TEMPERATURE = 0.8
DEFAULT_STREAM = False
DEFAULT_MAX_TOKENS = 128

REQUEST_SCHEMA = ("model string, messages array<struct<role:string,content:string>>, "
                  "temperature double, top_p double, top_k int, stream boolean, stop array<string>, "
                  "max_completion_tokens int, seed bigint")


def _marker(role: Column) -> Column:
    return (F.when(role == "user", F.lit(USER_MARKER))
            .when(role == "assistant", F.lit(ASSISTANT_MARKER))
            .when(role == "system", F.lit(SYSTEM_MARKER)))


def _line(marker: Column, text: Column) -> Column:
    return F.concat(marker, F.lit(" "), F.coalesce(text, F.lit("")))


def _join_sorted(order: Column, line: Column) -> Column:
    """Aggregate: lines joined by the turn separator in ``order``."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), line.alias("l")))),
                                    lambda x: x["l"]), TURN_SEP)


def _context(system: Column, body: Column | None) -> Column:
    parts = [_line(F.lit(SYSTEM_MARKER), system)]
    if body is not None:
        parts.append(body)
    parts.append(F.lit(ASSISTANT_MARKER))
    return F.concat_ws(TURN_SEP, *parts)


def repl_context(conv: DataFrame, default_system: str = SYSTEM_DEFAULT) -> DataFrame:
    """P13 (REPL layout): system line (the conversation's first system message, else the
    default), every user/assistant message in turn order, trailing ``Assistant:`` cue."""
    sys_ = conv.where(F.col("role") == "system").groupBy("conv_id").agg(
        F.min_by("text", "turn").alias("system"))
    hist = conv.where(F.col("role").isin("user", "assistant")).groupBy("conv_id").agg(
        _join_sorted(F.col("turn"), _line(_marker(F.col("role")), F.col("text"))).alias("body"),
        F.count(F.lit(1)).alias("n_messages"))
    ids = conv.select("conv_id").distinct()
    j = ids.join(sys_, "conv_id", "left").join(hist, "conv_id", "left")
    return j.select("conv_id", _context(F.coalesce("system", F.lit(default_system)), F.col("body"))
                    .alias("context"), F.coalesce("n_messages", F.lit(0)).cast("bigint").alias("n_messages"))


def _ranked(conv: DataFrame) -> DataFrame:
    ua = conv.where(F.col("role").isin("user", "assistant")).select("conv_id", "turn", "role", "text")
    return with_ordinal(ua, ["turn"], "k", partition_by=["conv_id", "role"])


def paired_context(conv: DataFrame, system_pick: str = "last", keep_unpaired_user: bool = False) -> DataFrame:
    """J6 (``system_pick='last'``, unpaired tail dropped) and J7 (``'first'``, a last unpaired user
    turn kept): the i-th user message pairs with the i-th assistant message (inner equi-join)."""
    pick = F.max_by if system_pick == "last" else F.min_by
    sys_ = conv.where(F.col("role") == "system").groupBy("conv_id").agg(pick("text", "turn").alias("system"))
    r = _ranked(conv)
    u = r.where(F.col("role") == "user").select("conv_id", "k", F.col("text").alias("u"))
    a = r.where(F.col("role") == "assistant").select("conv_id", "k", F.col("text").alias("a"))
    pairs = u.join(a, ["conv_id", "k"])
    lines = F.concat(_line(F.lit(USER_MARKER), F.col("u")), F.lit(TURN_SEP), _line(F.lit(ASSISTANT_MARKER), F.col("a")))
    body = pairs.groupBy("conv_id").agg(_join_sorted(F.col("k"), lines).alias("body"))
    ids = conv.select("conv_id").distinct()
    j = ids.join(sys_, "conv_id", "left").join(body, "conv_id", "left")
    if keep_unpaired_user:
        counts = r.groupBy("conv_id").agg(
            F.count(F.when(F.col("role") == "user", F.lit(1))).alias("nu"),
            F.count(F.when(F.col("role") == "assistant", F.lit(1))).alias("na"),
            F.max_by(F.when(F.col("role") == "user", F.col("text")),
                     F.when(F.col("role") == "user", F.col("turn"))).alias("last_user"))
        j = j.join(counts, "conv_id", "left")
        tail = F.when(F.col("nu") > F.col("na"), _line(F.lit(USER_MARKER), F.col("last_user")))
        body_col = F.concat_ws(TURN_SEP, F.col("body"), tail)
        body_col = F.when(F.col("body").isNull() & tail.isNull(), F.lit(None)).otherwise(body_col)
    else:
        body_col = F.col("body")
    return j.select("conv_id", _context(F.coalesce("system", F.lit("")), body_col).alias("context"))


def truncated_context(conv: DataFrame, budget: int, default_system: str = SYSTEM_DEFAULT,
                      token_len=T.word_count) -> DataFrame:
    """Drop the oldest *message* until the context fits ``budget`` tokens; the system line
    and the trailing cue always stay. Tokens are counted per line with ``token_len`` (words by
    default), so the context length is the sum over lines; the kept messages are the longest
    suffix whose reverse running sum fits."""
    sys_ = conv.where(F.col("role") == "system").groupBy("conv_id").agg(
        F.min_by("text", "turn").alias("system"))
    ids = conv.select("conv_id").distinct()
    base = ids.join(sys_, "conv_id", "left").select(
        "conv_id", F.coalesce("system", F.lit(default_system)).alias("system"))
    fixed = base.select("conv_id", "system",
                        (token_len(_line(F.lit(SYSTEM_MARKER), F.col("system"))) +
                         token_len(F.lit(ASSISTANT_MARKER))).alias("fixed"))
    msgs = conv.where(F.col("role").isin("user", "assistant")).select(
        "conv_id", "turn", _line(_marker(F.col("role")), F.col("text")).alias("line"))
    msgs = msgs.withColumn("n_tok", token_len("line")).withColumn("neg_turn", -F.col("turn"))
    rs = with_running_sums(msgs, ["neg_turn"], {"suffix": F.col("n_tok")}, partition_by=["conv_id"])
    j = rs.join(fixed.select("conv_id", "fixed"), "conv_id").where(F.col("fixed") + F.col("suffix") <= budget)
    body = j.groupBy("conv_id").agg(_join_sorted(F.col("turn"), F.col("line")).alias("body"),
                                    F.count(F.lit(1)).cast("bigint").alias("kept_messages"))
    out = fixed.join(body, "conv_id", "left")
    ctx = _context(F.col("system"), F.col("body"))
    return out.select("conv_id", ctx.alias("context"),
                      F.coalesce("kept_messages", F.lit(0)).cast("bigint").alias("kept_messages"),
                      token_len(ctx).cast("bigint").alias("n_tokens"))


def request_records(conv: DataFrame, model: str = "tessera") -> DataFrame:
    """One chat-completions request JSON per conversation (messages in turn order)."""
    msgs = conv.groupBy("conv_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))),
                    lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))).alias("messages"))
    return msgs.select("conv_id", F.to_json(F.struct(F.lit(model).alias("model"), "messages")).alias("json"))


def parse_request(js: Column) -> Column:
    """Parsed request with defaults (temperature 0.8, stream false, stop [], 128 tokens).

    A default stands in for an absent property only: a property given as null stays null. ``valid`` is
    false without messages or when the body is no JSON object."""
    r = F.from_json(js, REQUEST_SCHEMA)
    given = F.coalesce(F.json_object_keys(js), F.array().cast("array<string>"))

    def prop(name, default):
        return F.when(F.array_contains(given, name), r[name]).otherwise(F.lit(default))

    return F.struct(
        prop("model", "").alias("model"),
        F.coalesce(r["messages"], F.array()).alias("messages"),
        prop("temperature", DEFAULT_TEMPERATURE).alias("temperature"),
        r["top_p"].alias("top_p"), r["top_k"].alias("top_k"),
        prop("stream", DEFAULT_STREAM).alias("stream"),
        F.coalesce(r["stop"], F.array().cast("array<string>")).alias("stop"),
        prop("max_completion_tokens", DEFAULT_MAX_TOKENS).alias("max_tokens"),
        r["seed"].alias("seed"),
        (F.size(F.coalesce(r["messages"], F.array())) > 0).alias("valid"))


LEGACY_SCHEMA = ("prompt string, temperature double, top_p double, top_k int, stream boolean, stop array<string>, "
                 "max_tokens int, seed bigint")


def parse_legacy(js: Column) -> Column:
    """P14, single-prompt form: ``prompt`` and ``max_tokens`` in place of messages, with its own defaults
    (empty prompt, 128 tokens). As in :func:`parse_request`, a property given as null stays null."""
    r = F.from_json(js, LEGACY_SCHEMA)
    given = F.coalesce(F.json_object_keys(js), F.array().cast("array<string>"))

    def prop(name, default):
        return F.when(F.array_contains(given, name), r[name]).otherwise(F.lit(default))

    return F.struct(
        prop("prompt", "").alias("prompt"), prop("temperature", DEFAULT_TEMPERATURE).alias("temperature"),
        r["top_p"].alias("top_p"), r["top_k"].alias("top_k"), prop("stream", DEFAULT_STREAM).alias("stream"),
        F.coalesce(r["stop"], F.array().cast("array<string>")).alias("stop"),
        prop("max_tokens", DEFAULT_MAX_TOKENS).alias("max_tokens"), r["seed"].alias("seed"))


def reject_reason(js: Column) -> Column:
    """Why a chat request body is refused, null if it is accepted. The body is read without a schema
    (``VARIANT``), so absent, null, empty and malformed stay apart. A null body counts as malformed."""
    body = F.try_parse_json(js)
    messages = F.try_variant_get(body, "$.messages", "variant")
    kind = F.schema_of_variant(messages)
    return (F.when(body.isNull(), "malformed body")
            .when(~F.startswith(F.schema_of_variant(body), F.lit("OBJECT")), "not an object")
            .when(messages.isNull() | F.is_variant_null(messages), "no messages")
            .when(~F.startswith(kind, F.lit("ARRAY")), "messages not a list")
            .when(F.try_variant_get(messages, "$[0]", "variant").isNull(), "no messages")
            .when(F.exists(F.try_variant_get(messages, "$", "array<variant>"),
                           lambda m: F.try_variant_get(m, "$.role", "string").isNull()), "message without a role"))


def rejects(requests: DataFrame, js: str = "json") -> DataFrame:
    """The rows whose body is refused, with the column ``reason``."""
    return requests.withColumn("reason", reject_reason(F.col(js))).where("reason is not null")


def single_turn_context(prompt: Column, system: Column) -> Column:
    """P13, single turn: a system line only where there is a system text, the prompt, the cue."""
    line = F.when(F.coalesce(system, F.lit("")) != "", _line(F.lit(SYSTEM_MARKER), system))
    return F.concat_ws(TURN_SEP, line, _line(F.lit(USER_MARKER), prompt), F.lit(ASSISTANT_MARKER))


def response_records(conv: DataFrame, model: str = "tessera", created: int = 0, token_len=T.word_count) -> DataFrame:
    """One chat-completion response JSON per conversation with an assistant message.

    The last assistant message is the reply; ``usage`` counts ``token_len`` over the messages before it
    and over the reply. Ids and times come from the row and the parameter, so reruns agree."""
    replies = conv.where(F.col("role") == "assistant").groupBy(F.col("conv_id").alias("_conv")).agg(
        F.max(F.struct("turn", F.coalesce("text", F.lit("")).alias("text"))).alias("_reply"))
    said = (conv.join(replies, F.col("conv_id") == F.col("_conv"), "inner")
            .groupBy("conv_id").agg(
                F.first("_reply.text").alias("_text"),
                F.coalesce(F.sum(F.when(F.col("turn") < F.col("_reply.turn"),
                                        token_len(F.coalesce("text", F.lit(""))))), F.lit(0)).cast("bigint").alias("_asked")))
    done = token_len(F.col("_text")).cast("bigint")
    choice = F.struct(F.lit(0).alias("index"),
                      F.struct(F.lit("assistant").alias("role"), F.col("_text").alias("content")).alias("message"),
                      F.col("_text").alias("text"), F.lit("stop").alias("finish_reason"))
    return said.select("conv_id", F.to_json(F.struct(
        F.concat(F.lit("chatcmpl-"), F.col("conv_id").cast("string")).alias("id"),
        F.lit("chat.completion").alias("object"), F.lit(created).cast("bigint").alias("created"), F.lit(model).alias("model"),
        F.array(choice).alias("choices"),
        F.struct(F.col("_asked").alias("prompt_tokens"), done.alias("completion_tokens"),
                 (F.col("_asked") + done).alias("total_tokens")).alias("usage"))).alias("json"))


def fit_context(ids: Column, max_ctx: int, max_new: int) -> tuple[Column, Column]:
    """Keep the last ``max_ctx-1`` ids when the prompt is too long; new-token budget."""
    n = F.size(ids)
    kept = F.when(n >= max_ctx, F.slice(ids, -(max_ctx - 1), max_ctx - 1)).otherwise(ids)
    return kept, F.least(F.lit(max_new), F.lit(max_ctx) - F.size(kept))


def stop_cut(text: Column, stops: list[str]) -> tuple[Column, Column]:
    """Cut ``text`` before the stop string whose first match completes earliest (ties: list
    order); empty stops are ignored. Returns (cut text, index of the stop used or null)."""
    cands = []
    for i, s in enumerate(stops):
        if not s:
            continue
        pos = F.locate(s, text)
        cands.append(F.when(pos > 0, F.struct((pos + len(s) - 1).alias("end"), F.lit(i).alias("i"),
                                              pos.alias("pos"))))
    if not cands:
        return text, F.lit(None).cast("int")
    best = F.array_min(F.filter(F.array(*cands), lambda x: x.isNotNull()))
    cut = F.when(best.isNull(), text).otherwise(F.substring(text, F.lit(1), best["pos"] - 1))
    return cut, best["i"]
