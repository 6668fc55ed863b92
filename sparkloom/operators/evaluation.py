"""From model outputs to per-item scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import answers, arrays, text


def votes(samples: DataFrame, item: str = "item_id", pred: str = "pred", keep: list[str] | None = None) -> DataFrame:
    """item, keep..., cnt_a, cnt_b, cnt_none and p = b / (a + b), null without a vote."""
    a, b = F.count_if(F.col(pred) == 0), F.count_if(F.col(pred) == 1)
    out = samples.groupBy(item, *(keep or [])).agg(a.alias("cnt_a"), b.alias("cnt_b"), F.count_if(F.col(pred).isNull()).alias("cnt_none"))
    cast = F.col("cnt_a") + F.col("cnt_b")
    return out.withColumn("p", F.when(cast > 0, F.col("cnt_b") / cast))


def vote_totals(voted: DataFrame) -> DataFrame:
    """Sums of all votes, items, and items without one."""
    return voted.agg(
        F.sum("cnt_a").alias("cnt_a"), F.sum("cnt_b").alias("cnt_b"), F.sum("cnt_none").alias("cnt_none"),
        F.count("*").alias("items"), F.count_if(F.col("p").isNull()).alias("dropped"),
    )


def parse_samples(responses: DataFrame, dialect: str = "afirst", response: str = "response") -> DataFrame:
    return responses.withColumn("pred", answers.answer(F.col(response), dialect))


def failed_parses(parsed: DataFrame, n: int = 10, cut: int = 100, order: tuple[str, ...] = ("item_id", "sample_idx"), response: str = "response") -> DataFrame:
    """The first n samples without an answer, their response clipped."""
    bad = parsed.filter(F.col("pred").isNull()).withColumn("shown", text.clip(F.col(response), cut))
    return bad.orderBy(*order).limit(n)


def next_token(outputs: DataFrame, a_ids: list[int], b_ids: list[int], logprobs: str = "logprobs", k: int = 1024) -> DataFrame:
    """`outputs` with p_b, the sigmoid of the best B over the best A log-probability; rows without a finite one go."""
    ids = lambda xs: F.array(*[F.lit(x) for x in sorted(set(xs))])
    scored = outputs.withColumn("top", arrays.top_k(F.col(logprobs), k))
    scored = scored.withColumn("lp_a", arrays.best_logprob(F.col("top"), ids(a_ids))).withColumn("lp_b", arrays.best_logprob(F.col("top"), ids(b_ids)))
    both = scored.filter(F.col("lp_a").isNotNull() & F.col("lp_b").isNotNull())
    return both.withColumn("p_b", arrays.sigmoid(F.col("lp_b") - F.col("lp_a"))).filter(arrays.finite(F.col("p_b"))).drop("top")


def option_sequences(items: DataFrame, options: DataFrame) -> DataFrame:
    """Every item with every option variant; options are a short fixed list."""
    return items.crossJoin(F.broadcast(options))


def option_scores(scored: DataFrame, item: str = "item_id", option: str = "option", value: str = "lp", keep: list[str] | None = None) -> DataFrame:
    """item, keep..., lp_a, lp_b (best variant of either), p_b; items that lack one are left out."""
    best = lambda o: F.max(F.when(F.col(option) == o, F.col(value)))
    both = scored.groupBy(item, *(keep or [])).agg(best("A").alias("lp_a"), best("B").alias("lp_b")).filter("lp_a is not null and lp_b is not null")
    return both.withColumn("p_b", arrays.sigmoid(F.col("lp_b") - F.col("lp_a")))


def first_of_each(df: DataFrame, by: list[str], order: list[str], k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("place", place).filter(F.col("place") <= k)


def variant_ranges(variants: DataFrame, parent: str = "parent_id", score: str = "p_b", label: str = "label") -> DataFrame:
    """parent, label, n_variants, p_min, p_max, p_range, and the best and worst score for the label."""
    out = variants.filter(F.col(score).isNotNull()).groupBy(parent, label).agg(
        F.count("*").alias("n_variants"), F.min(score).alias("p_min"), F.max(score).alias("p_max")
    )
    best = F.when(F.col(label) == 1, F.col("p_max")).otherwise(F.col("p_min"))
    worst = F.when(F.col(label) == 1, F.col("p_min")).otherwise(F.col("p_max"))
    return out.withColumn("p_range", F.col("p_max") - F.col("p_min")).withColumn("best", best).withColumn("worst", worst)


def range_stats(ranges: DataFrame, value: str = "p_range") -> DataFrame:
    """Mean, population deviation, median and maximum of the ranges."""
    return ranges.agg(F.count("*").alias("parents"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.median(value).alias("median"), F.max(value).alias("max"))
