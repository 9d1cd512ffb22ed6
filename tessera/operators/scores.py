"""Next-token distributions stored as one ``array<float>`` of logits per row.

Everything is an array expression on the row (JVM-side, no explode, no shuffle), linear in the
vocabulary. Rule followed throughout: a lambda never refers to a row-level value computed from an
array (max, sum, threshold, another array). Catalyst inlines such values into the lambda, which
re-evaluates them per element (quadratic or worse). Row-level values enter as
``array_repeat(value, n)`` zipped with the array (``zip_with`` / ``arrays_zip``), so each is
evaluated once per row. Token id = 0-based array position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.sampling import uniform

EPS = 1e-10   # fixed: added inside the log of the entropy


def _d(logits: Column) -> Column:
    return F.transform(logits, lambda x: x.cast("double"))


def _sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda a, v: a + F.coalesce(v, F.lit(0.0)))


def _with_scalar(arr: Column, scalar: Column, fn) -> Column:
    """``[fn(a_i, s) for a_i in arr]`` with ``s`` evaluated once for the row."""
    return F.zip_with(arr, F.array_repeat(scalar, F.size(arr)), fn)


def softmax(logits: Column) -> Column:
    """Max-shifted softmax (nulls stay null and carry no mass)."""
    x = _d(logits)
    e = _with_scalar(x, F.array_max(x), lambda v, m: F.exp(v - m))
    return _with_scalar(e, _sum(e), lambda v, z: v / z)


def entropy(logits: Column) -> Column:
    """``-sum p * ln(p + 1e-10)`` in nats over the untempered softmax."""
    p = softmax(logits)
    return -F.aggregate(p, F.lit(0.0), lambda a, v: a + v * F.log(v + F.lit(EPS)))


def ranked(logits: Column) -> Column:
    """Tokens by logit desc, id asc: ``array<struct<neg, id, logit>>`` (one sort)."""
    return F.array_sort(F.transform(_d(logits), lambda v, i: F.struct(
        (-v).alias("neg"), i.alias("id"), v.alias("logit"))))


def top_k_threshold(logits: Column, k: int) -> Column:
    """The k-th largest logit (``topk`` semantics)."""
    return F.element_at(ranked(logits), F.least(F.lit(k), F.size(logits)))["logit"]


def top_k_mask(logits: Column, k: int) -> Column:
    """W10 mask: keep every token whose logit is >= the k-th largest (ties are kept)."""
    x = _d(logits)
    return _with_scalar(x, top_k_threshold(x, k), lambda v, t: v >= t)


def argmax(logits: Column) -> Column:
    """First position of the maximum (greedy pick)."""
    x = _d(logits)
    return (F.array_position(x, F.array_max(x)) - 1).cast("int")


def with_filtered_probs(df: DataFrame, logits: str, out: str, temperature: float = 1.0,
                        top_k: int | None = None, top_p: float | None = None) -> DataFrame:
    """W10 + W11 (+ temperature): probabilities after filtering, in token-id order; removed
    tokens are null.

    Nucleus: in descending probability order a token is kept while the probability mass *before*
    it is <= top_p (the first is always kept). The kept prefix length comes from one fold over the
    sorted list; membership is a comparison with the last kept ``(-p, id)`` key.
    """
    x = F.transform(_d(F.col(logits)), lambda v: v / F.lit(float(temperature)))
    if top_k is not None and top_k > 0:
        x = _with_scalar(x, top_k_threshold(x, top_k), lambda v, t: F.when(v >= t, v))
    df = df.withColumn("_x", x)
    if top_p is not None and 0.0 < top_p < 1.0:
        p = softmax(F.col("_x"))
        r = F.array_sort(F.filter(F.transform(p, lambda v, i: F.struct(
            (-v).alias("neg"), i.alias("id"), v.alias("p"))), lambda s: s["p"].isNotNull()))
        fold = F.aggregate(r, F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n")),
                           lambda acc, t: F.struct((acc["s"] + t["p"]).alias("s"),
                                                   (acc["n"] + F.when(acc["s"] <= F.lit(top_p), 1).otherwise(0))
                                                   .alias("n")))
        last = F.element_at(r, F.greatest(fold["n"], F.lit(1)))
        n = F.size("_x")
        z = F.arrays_zip(F.col("_x").alias("x"), p.alias("p"), F.array_repeat(last, n).alias("k"),
                         F.sequence(F.lit(0), n - 1).alias("i"))
        kept = F.transform(z, lambda t: F.when(
            t["x"].isNotNull() & (F.struct((-t["p"]).alias("neg"), t["i"].alias("id"))
                                  <= F.struct(t["k"]["neg"].alias("neg"), t["k"]["id"].alias("id"))), t["x"]))
        df = df.withColumn("_x", kept)
    return df.withColumn(out, softmax(F.col("_x"))).drop("_x")


def n_kept(probs: Column) -> Column:
    return F.size(F.filter(probs, lambda v: v.isNotNull()))


def draw(probs: Column, *seed_parts: Column) -> Column:
    """M6: inverse-CDF draw in token-id order: the first token whose cumulative probability
    exceeds a per-row uniform (one fold; the uniform rides in the fold's initial state).
    Rounding leftovers fall to the last kept token."""
    init = F.struct(F.lit(0.0).alias("s"), F.lit(-1).alias("pick"), F.lit(0).alias("i"),
                    F.lit(-1).alias("last"), uniform(*seed_parts).alias("u"))
    fold = F.aggregate(
        probs, init,
        lambda acc, v: F.struct(
            (acc["s"] + F.coalesce(v, F.lit(0.0))).alias("s"),
            F.when((acc["pick"] < 0) & v.isNotNull() & (acc["s"] + v > acc["u"]), acc["i"])
             .otherwise(acc["pick"]).alias("pick"),
            (acc["i"] + 1).alias("i"),
            F.when(F.coalesce(v, F.lit(0.0)) > 0, acc["i"]).otherwise(acc["last"]).alias("last"),
            acc["u"].alias("u")))
    return F.when(fold["pick"] >= 0, fold["pick"]).otherwise(fold["last"]).cast("int")


def top_list(logits: Column, k: int = 5) -> Column:
    """Top-k ``(id, p)`` by probability of the untempered softmax, id breaking ties."""
    p = softmax(logits)
    r = F.array_sort(F.transform(p, lambda v, i: F.struct((-v).alias("neg"), i.alias("id"), v.alias("p"))))
    return F.transform(F.slice(r, 1, k), lambda s: F.struct(s["id"].alias("id"), s["p"].alias("p")))


def trace(df: DataFrame, key: str, logits: str, token: Column | None = None) -> DataFrame:
    """The per-token observation record ``(key, token_id, entropy, top5)``; the token defaults
    to the greedy pick."""
    tok = token if token is not None else argmax(F.col(logits))
    return df.select(key, tok.alias("token_id"), entropy(F.col(logits)).alias("entropy"),
                     top_list(F.col(logits), 5).alias("top5"))
