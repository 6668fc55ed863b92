"""Mixing sources to target weights by entropy balancing.

Every document may be taken 0, 1 or 2 times. Relative to a fair binomial base, the rates that meet each source's word
target with the least relative entropy are exponentially tilted: rate = 2 / (1 + exp(-lambda * size / scale)), with one
dual variable lambda per source. The convex dual is solved by Newton steps whose gradient and curvature are aggregated
from (source, size) counts across the cluster; sums are exact decimals, so reruns agree bit by bit. The driver holds a few
numbers a source and nothing else. Rates become copies
by systematic rounding along (size class, hash): the words that a source takes differ from its target by little more
than its longest document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.components import durable

WEIGHTS = (5, 2, 1)
UNIT = 10**9
#: Rows of one source and class of sizes that one task orders, about.
BUCKET_ROWS = 20_000


def words_in(text: Column) -> Column:
    """Number of words: runs without space, tab, line feed, vertical tab, form feed and carriage return."""
    return F.coalesce(F.size(F.filter(F.split(text, r"[ \t-\r]+"), lambda w: w != "")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) from (source, source_size): weights repeat along the sources in code point order.

    A source's target stops at `most` times its size and the rest is shared again by weight: all others get their
    weight times one level, which follows from the sources in the order of size by weight.
    """
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weighed = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int")))
    full = most * F.col("source_size")
    order = Window.orderBy(full / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = weighed.select(
        "*",
        F.row_number().over(order).alias("place"),
        F.sum("source_size").over(all_).alias("total"),
        (F.sum("weight").over(all_) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))).alias("open_weight"),
        F.coalesce(F.sum("source_size").over(before), F.lit(0)).alias("closed"),
    )
    level = (share * F.col("total") - most * F.col("closed")) / F.col("open_weight")
    # The first source that the level leaves open sets it; those before it are full.
    first = F.min(F.when(full >= F.col("weight") * level, F.struct(F.col("place"), level.alias("level")))).over(all_)
    return ranked.withColumn("found", first).select(
        "source", "source_size", F.least(full, F.coalesce(F.col("weight") * F.col("found.level"), full)).alias("target")
    )


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def balance(counts: DataFrame, scale: list[float], target: list[float], full: list[bool], most: float = 2.0, steps: int = 60, tolerance: float = 1e-7) -> list[float | None]:
    """The dual variable of each source, by Newton steps kept inside a shrinking bracket.

    `counts` is (place, size, n), where `place` is the source's place in the lists. Each step sums what the rates take and
    how it changes over all counts in the cluster; two numbers a source come back. A source whose target is its whole
    `most` times its size has no finite solution; its variable is None and every document of it is taken `most` times.
    """
    n = len(scale)
    lam, lo, hi = [0.0] * n, [-60.0] * n, [60.0] * n
    open_ = {i for i in range(n) if not full[i]}
    exact = lambda x: F.sum(F.round(x * 1_000_000).cast("decimal(38,0)")).cast("double") / 1_000_000
    numbers = lambda xs: F.split(F.lit(",".join(map(repr, xs))), ",").cast("array<double>")
    mass, size = F.col("n") * F.col("size"), F.col("size") / F.get(numbers(scale), F.col("place"))
    for _ in range(steps):
        if not open_:
            break
        p = 1 / (1 + F.exp(-F.get(numbers(lam), F.col("place")) * size))
        sums = counts.filter("size > 0").groupBy("place").agg(exact(mass * most * p).alias("taken"), exact(mass * size * most * p * (1 - p)).alias("slope")).collect()
        for r in sums:
            i = r["place"]
            over = r["taken"] - target[i]
            if i not in open_:
                continue
            if abs(over) <= tolerance * max(target[i], 1.0):
                open_.discard(i)
                continue
            lo[i], hi[i] = (lo[i], lam[i]) if over > 0 else (lam[i], hi[i])
            newton = lam[i] - over / max(r["slope"], 1e-9)
            lam[i] = newton if lo[i] < newton < hi[i] else (lo[i] + hi[i]) / 2
    return [None if full[i] else lam[i] for i in range(n)]


def _plan(base: DataFrame, weights: tuple[int, ...], share: float, most: int) -> tuple[DataFrame, DataFrame, int]:
    """Parts of each (source, size), what stands ahead of each cell of documents, and the number of buckets.

    `base` has doc_id, source and size, and is read several times. A cell is a bucket of a class of sizes of a source; it
    has about BUCKET_ROWS rows at most, whatever the share of a source.
    """
    counts = base.groupBy("source", "size").agg(F.count("*").alias("n"))
    counts = durable(counts)
    mean = F.sum(F.when(F.col("size") > 0, F.col("size").cast("decimal(38,0)") * F.col("n"))) / F.sum(F.when(F.col("size") > 0, F.col("n")))
    of_source = counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.coalesce(mean.cast("double"), F.lit(1.0)).alias("scale"))
    goals = targets(of_source.select("source", "source_size"), weights, share, float(most)).withColumnRenamed("source", "gs")
    # One row a source comes to the driver: its place in a fixed order, size and target.
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    facts = durable(of_source.join(goals.drop("source_size"), _same(F.col("source"), F.col("gs"))).drop("gs").withColumn("place", place))
    known = facts.select("place", "source_size", "scale", "target").orderBy("place").collect()
    of = facts.withColumnRenamed("source", "fs")
    sized = durable(counts.join(of, _same(F.col("source"), F.col("fs"))).drop("fs"))
    full = [r["source_size"] == 0 or r["target"] >= most * r["source_size"] * (1 - 1e-12) for r in known]
    lam = balance(sized.select("place", "size", "n"), [r["scale"] for r in known], [r["target"] for r in known], full, float(most))
    dual = F.get(F.split(F.lit(",".join("" if x is None else repr(round(x, 9)) for x in lam)), ",", -1), F.col("place"))
    dual = F.when(dual != "", dual).cast("double")
    rate = F.when(F.col("size") == 0, F.lit(1.0)).otherwise(F.coalesce(most / (1 + F.exp(-dual * F.col("size") / F.col("scale"))), F.lit(float(most))))
    # (source, size) fixes the rate; a hash deals documents over buckets.
    rated = durable(
        sized.select(
            F.col("source").alias("rs"), F.col("size").alias("rz"), "source_size", "target", F.round(rate * UNIT).cast("long").alias("parts"),
            F.when(F.col("size") == 0, F.lit(0)).otherwise(F.floor(F.log2(F.col("size").cast("double")) * 8) + 1).cast("int").alias("class"), "n",
        )
    )
    largest = rated.groupBy("rs", "class").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0
    buckets = max(64, -(-largest // BUCKET_ROWS))
    cells = _rows(base, rated, buckets).groupBy("source", "class", "bucket").agg(F.sum(F.col("parts") % UNIT).alias("cell"))
    before = Window.partitionBy("source").orderBy("class", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    ahead = cells.withColumn("ahead", F.coalesce(F.sum("cell").over(before), F.lit(0))).select(
        F.col("source").alias("cs"), F.col("class").alias("cc"), F.col("bucket").alias("cb"), "ahead"
    )
    return rated, durable(ahead), buckets


def _rows(base: DataFrame, rated: DataFrame, buckets: int) -> DataFrame:
    u = F.xxhash64("doc_id", "size")
    return base.join(rated.drop("n"), _same(F.col("source"), F.col("rs")) & (F.col("size") == F.col("rz"))).drop("rs", "rz").withColumns(
        {"u": u, "bucket": F.pmod(u, F.lit(buckets)).cast("int")}
    )


def _copies(base: DataFrame, plan: tuple[DataFrame, DataFrame, int], most: int, *ties: str) -> DataFrame:
    """`base` with copies, parts, source_size and target of each row. `ties` order rows of one id and size."""
    rated, ahead, buckets = plan
    inside = Window.partitionBy("source", "class", "bucket").orderBy("u", "doc_id", "size", *ties).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = _same(F.col("source"), F.col("cs")) & (F.col("class") == F.col("cc")) & (F.col("bucket") == F.col("cb"))
    placed = _rows(base, rated, buckets).join(ahead, at).withColumn("upto", F.col("ahead") + F.sum(F.col("parts") % UNIT).over(inside) + UNIT // 2)
    step = F.floor(F.col("upto") / UNIT) - F.floor((F.col("upto") - F.col("parts") % UNIT) / UNIT)
    return placed.withColumn("copies", F.least(F.floor(F.col("parts") / UNIT) + step, F.lit(most)).cast("long"))


def _named(docs: DataFrame, id_col: str, source_col: str, text_col: str) -> list[Column]:
    return [F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").alias("source"), words_in(F.col(f"`{text_col}`").cast("string")).alias("size")]


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    weights: tuple[int, ...] = WEIGHTS,
    share: float = 1.5,
    most: int = 2,
) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, rate, copies, taken (copies times size) and source.

    A null text has size 0 and is taken as often as its rate of 1 says (no words either way). Null sources are one
    source, the last. Repeated rows are documents of their own; rows with equal id, source and size are told apart by
    nothing, so which of them gets an extra copy is of no consequence. Empty tables give empty ones. Only id, source
    and text are read, so other columns can't clash. No row is taken more than `most` times.
    """
    base = durable(docs.select(*_named(docs, id_col, source_col, text_col)))
    return _copies(base, _plan(base, weights, share, most), most).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", (F.col("parts") / UNIT).alias("rate"), "source"
    )


def take(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2
) -> DataFrame:
    """`docs` with every row as often as `mix` takes it (0 to `most` times); columns stay as they are.

    Copies belong to rows, not to ids: rows of one id, source and size get theirs in the order of a hash of the whole
    row, so reruns agree, and the sum of `copies` is the number of rows returned. Nulls, ties and empty tables as in `mix`.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(*_named(docs, id_col, source_col, text_col), row)
    base = durable(rows.drop("row"))
    placed = _copies(rows.withColumn("tie", F.xxhash64("row")), _plan(base, weights, share, most), most, "tie")
    return placed.select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("once")).select("row.*")
