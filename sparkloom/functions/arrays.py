"""Token arrays, masks, log-probabilities and vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IGNORE = -100


def tokenize(text: Column) -> Column:
    """Offline default: words, single marks and runs of white space, as the token strings."""
    return F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9_]+|[^A-Za-z0-9_ \t\r\n]|[ \t\r\n]+"), F.lit(0))


def token_ids(tokens: Column, vocabulary: int = 32_000) -> Column:
    """Ids of token strings by hash: the first seven hex digits of md5 modulo the vocabulary."""
    return F.transform(tokens, lambda t: (F.conv(F.substring(F.md5(t), 1, 7), 16, 10).cast("long") % vocabulary).cast("int"))


def label_mask(ids: Column, n_prompt: Column) -> Column:
    """Ids with the prompt's replaced by the ignored label."""
    n = F.least(n_prompt, F.size(ids))
    return F.concat(F.array_repeat(F.lit(IGNORE), n), F.slice(ids, n + 1, F.size(ids) - n))


def truncate(ids: Column, most: int | None) -> Column:
    return ids if most is None else F.slice(ids, 1, most)


def append_eos(ids: Column, eos: int) -> Column:
    last = F.try_element_at(ids, F.lit(-1))
    return F.when(F.coalesce(last == eos, F.lit(False)), ids).otherwise(F.concat(ids, F.array(F.lit(eos))))


def ceil_to(n: Column, multiple: int) -> Column:
    return (F.ceil(n / F.lit(float(multiple))) * multiple).cast("int")


def gap_to(n: Column, multiple: int) -> Column:
    """What is missing to the next multiple."""
    return F.pmod(-n, F.lit(multiple))


def pad_right(ids: Column, n: Column, value: int) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(value), F.greatest(n - F.size(ids), F.lit(0))))


def attention_mask(ids: Column, pad: int) -> Column:
    return F.transform(ids, lambda x: (x != pad).cast("int"))


def running_sum(lengths: Column) -> Column:
    """[0, l1, l1 + l2, ...]."""
    step = lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x))
    return F.aggregate(lengths, F.array(F.lit(0)), step)


def positions(lengths: Column) -> Column:
    """0.. within each segment."""
    inside = F.transform(lengths, lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")))
    return F.flatten(inside)


def block_causal(lengths: Column) -> Column:
    """For each token the (first, last) position that it may attend to: its segment's start and itself."""
    spans = F.zip_with(F.slice(running_sum(lengths), 1, F.size(lengths)), lengths, lambda s, n: F.struct(s.alias("s"), n.alias("n")))
    rows = F.transform(
        spans,
        lambda x: F.when(
            x["n"] > 0, F.transform(F.sequence(F.lit(0), x["n"] - 1), lambda i: F.struct(x["s"].alias("first"), (x["s"] + i).alias("last")))
        ).otherwise(F.array().cast("array<struct<first:int,last:int>>")),
    )
    return F.flatten(rows)


def best_logprob(logprobs: Column, ids: Column) -> Column:
    """The largest log-probability of the candidate ids in a map, null if none is in it."""
    return F.array_max(F.transform(ids, lambda i: F.try_element_at(logprobs, i)))


def top_k(logprobs: Column, k: int) -> Column:
    """A map cut to its k largest values."""
    by = F.sort_array(F.transform(F.map_entries(logprobs), lambda e: F.struct(e["value"].alias("v"), e["key"].alias("k"))), asc=False)
    return F.map_from_entries(F.transform(F.slice(by, 1, k), lambda e: F.struct(e["k"], e["v"])))


def sequence_logprob(values: Column) -> Column:
    """The sum of all values, null if one is missing."""
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def argmax(v: Column) -> Column:
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")
