"""Splits, samples, shuffles and batches that reruns repeat, as they follow md5 of the key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bucket(key: Column, n: int, seed: str = "") -> Column:
    """0..n-1 from the first eight hexadecimal digits of md5."""
    text = F.concat(F.lit(seed), key.cast("string")) if seed else key.cast("string")
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % n


def split(key: Column) -> Column:
    """train, valid or test, 7 : 1 : 2."""
    b = bucket(key, 10)
    return F.when(b < 7, "train").when(b < 8, "valid").otherwise("test")


def shuffled(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    return df.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(f"/{seed}"))), key)


def negatives(positives: DataFrame, left: str, right: str, per_positive: int = 8, seed: int = 42) -> DataFrame:
    """As many pairs as there are positives, none of them a positive, label 0; with the positives, label 1.

    Each left value draws `per_positive` right values a positive from a hashed numbering of them; while the drawn pairs
    that are no positives are too few, every left value goes on through the numbering from a place of its own, a block
    at a time. So pairs are listed only as far as they are needed, and fewer negatives are found only if fewer exist.
    """
    known = positives.select(left, right).distinct()
    n = known.count()
    rights = known.select(right).distinct().withColumn("no", F.row_number().over(Window.orderBy(F.md5(F.concat(F.col(right).cast("string"), F.lit(f"/{seed}"))), right)) - 1)
    m = rights.count()
    draws = known.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(per_positive))))
    at = bucket(F.concat_ws("/", F.col(left).cast("string"), F.col(right).cast("string"), F.col("draw").cast("string"), F.lit(str(seed))), max(m, 1))
    drawn = draws.select(left, at.alias("no")).distinct().join(rights, "no").select(left, right)
    free = drawn.join(known, [left, right], "left_anti")
    lefts = known.select(left).distinct()
    n_left = lefts.count()
    due, first, block = min(n, n_left * m - n), 0, per_positive
    while first < m and (have := free.count()) < due:
        block = max(block * 2, -(-(due - have) // n_left))
        place = F.explode(F.sequence(F.lit(first), F.lit(min(first + block, m) - 1)))
        start = bucket(F.concat_ws("/", F.col(left).cast("string"), F.lit(str(seed))), m)
        more = lefts.select(left, place.alias("place")).select(left, ((F.col("place") + start) % m).alias("no")).join(rights, "no").select(left, right)
        free = free.unionByName(more.join(known, [left, right], "left_anti")).distinct()
        first += block
    order = F.md5(F.concat_ws("/", F.col(left).cast("string"), F.col(right).cast("string"), F.lit(str(seed))))
    taken = free.orderBy(order, left, right).limit(n)
    return known.withColumn("label", F.lit(1)).unionByName(taken.withColumn("label", F.lit(0)))


def chunk_ids(df: DataFrame, order: str, size: int, by: list[str] | None = None, drop_last: bool = False) -> DataFrame:
    """`df` with place (from 0) and chunk = place / size within `by`; drop_last leaves out a part chunk."""
    w = Window.partitionBy(*(by or [])).orderBy(order)
    out = df.withColumn("place", F.row_number().over(w) - 1).withColumn("chunk", F.floor(F.col("place") / size).cast("int"))
    if not drop_last:
        return out
    full = out.withColumn("n", F.count("*").over(Window.partitionBy(*(by or []), "chunk")))
    return full.filter(F.col("n") == size).drop("n")


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows as often."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
