"""Metrics over (label, score) tables. Scores are grouped before they are ordered, so ties never cost a row each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _by(by: list[str] | None) -> list[str]:
    return list(by or [])


def auroc(df: DataFrame, label: str = "label", score: str = "score", by: list[str] | None = None, nulls: str = "drop") -> DataFrame:
    """by..., n_pos, n_neg, auroc (mid-ranks for ties; null unless both classes occur).

    A null score is dropped, or counts as 0.5 with nulls="half".
    """
    by = _by(by)
    rows = df.withColumn(score, F.coalesce(F.col(score), F.lit(0.5))) if nulls == "half" else df.filter(F.col(score).isNotNull())
    grouped = rows.groupBy(*by, F.col(score).alias("_s")).agg(
        F.count_if(F.col(label) == 1).cast("double").alias("_p"), F.count_if(F.col(label) == 0).cast("double").alias("_n")
    )
    below = Window.partitionBy(*by).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    ranked = grouped.withColumn("_under", F.coalesce(F.sum("_n").over(below), F.lit(0.0)))
    sums = ranked.groupBy(*by).agg(
        F.sum("_p").alias("n_pos"), F.sum("_n").alias("n_neg"), F.sum(F.col("_p") * (F.col("_under") + F.col("_n") / F.lit(2.0))).alias("_won")
    )
    value = F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("_won") / (F.col("n_pos") * F.col("n_neg")))
    return sums.select(*by, F.col("n_pos").cast("long"), F.col("n_neg").cast("long"), value.alias("auroc"))


def roc_curve(df: DataFrame, label: str = "label", score: str = "score", by: list[str] | None = None) -> DataFrame:
    """by..., threshold, fpr, tpr: from (0, 0) at infinity; points on a straight line are left out."""
    by = _by(by)
    counts = df.filter(F.col(score).isNotNull()).groupBy(*by, F.col(score).alias("threshold")).agg(
        F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n")
    )
    down = Window.partitionBy(*by).orderBy(F.desc("threshold"))
    whole = Window.partitionBy(*by)
    points = counts.select(
        *by, "threshold", F.sum("p").over(down).alias("tp"), F.sum("n").over(down).alias("fp"), F.sum("p").over(whole).alias("pos"), F.sum("n").over(whole).alias("neg")
    )
    step = lambda c, f: f(c).over(down)
    turn = points.select(
        "*",
        (F.col("fp") - step("fp", F.lag)).alias("f1"), (F.col("tp") - step("tp", F.lag)).alias("t1"),
        (step("fp", F.lead) - F.col("fp")).alias("f2"), (step("tp", F.lead) - F.col("tp")).alias("t2"),
    )
    # As (fp, tp) of neighbours: a point goes if both differences are equal on both sides, as curve reducers do.
    kept = turn.filter(F.col("f1").isNull() | F.col("f2").isNull() | (F.col("f1") != F.col("f2")) | (F.col("t1") != F.col("t2")))
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    curve = kept.select(*by, "threshold", share("fp", "neg").alias("fpr"), share("tp", "pos").alias("tpr"))
    first = counts.select(*by).distinct() if by else counts.limit(1).select()
    start = first.select(*by, F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return start.unionByName(curve)


def _counts(pred: Column, label: Column) -> list[Column]:
    return [
        F.count_if((pred == 1) & (label == 1)).alias("tp"), F.count_if((pred == 0) & (label == 0)).alias("tn"),
        F.count_if((pred == 1) & (label == 0)).alias("fp"), F.count_if((pred == 0) & (label == 1)).alias("fn"),
    ]


def confusion(df: DataFrame, label: str = "label", score: str = "score", by: list[str] | None = None, threshold: float = 0.5) -> DataFrame:
    """by..., tp, tn, fp, fn, n, accuracy and f1 (0 where undefined) of score >= threshold; null scores are dropped."""
    by = _by(by)
    pred = (F.col(score) >= threshold).cast("int")
    out = df.filter(F.col(score).isNotNull()).groupBy(*by).agg(*_counts(pred, F.col(label)), F.count("*").alias("n"))
    return out.withColumn("accuracy", F.when(F.col("n") > 0, (F.col("tp") + F.col("tn")) / F.col("n"))).withColumn("f1", f1("tp", "fp", "fn"))


def f1(tp: str, fp: str, fn: str) -> Column:
    below = 2 * F.col(tp) + F.col(fp) + F.col(fn)
    return F.when(below > 0, 2 * F.col(tp) / below).otherwise(F.lit(0.0))


def f1_mappings(df: DataFrame, label: str = "label", choice: str = "choice") -> DataFrame:
    """f1 with A as 1 and with B as 1, and which is better; `choice` is 0 for A, 1 for B, null rows are dropped."""
    rows = df.filter(F.col(choice).isNotNull())
    pick = lambda a: [F.count_if((F.col(choice) == a) & (F.col(label) == 1)).alias("tp"), F.count_if((F.col(choice) == a) & (F.col(label) == 0)).alias("fp"), F.count_if((F.col(choice) != a) & (F.col(label) == 1)).alias("fn")]
    a = rows.agg(*pick(0)).select(f1("tp", "fp", "fn").alias("f1_a"))
    b = rows.agg(*pick(1)).select(f1("tp", "fp", "fn").alias("f1_b"))
    better = F.when(F.col("f1_a") > F.col("f1_b"), "A").when(F.col("f1_b") > F.col("f1_a"), "B").otherwise("same")
    return a.crossJoin(b).withColumn("better", better)  # one row by one row


def macro_average(aurocs: DataFrame, families: DataFrame, by: str = "family", value: str = "auroc") -> DataFrame:
    """(family, n_tasks, macro): the mean over tasks with a value, null for a family without one."""
    means = aurocs.filter(F.col(value).isNotNull()).groupBy(by).agg(F.count("*").alias("n_tasks"), F.avg(value).alias("macro"))
    return families.select(by).join(means, by, "left").withColumn("n_tasks", F.coalesce("n_tasks", F.lit(0)).cast("long"))


def histogram(df: DataFrame, value: str, bins: int = 40) -> DataFrame:
    """(bin, low, high, n): equal bins between the smallest and largest value, the last one closed, empty ones too."""
    ends = df.filter(F.col(value).isNotNull()).agg(F.min(value).alias("mn"), F.max(value).alias("mx")).select(
        F.when(F.col("mn") == F.col("mx"), F.col("mn") - 0.5).otherwise(F.col("mn")).alias("mn"),
        F.when(F.col("mn") == F.col("mx"), F.col("mx") + 0.5).otherwise(F.col("mx")).alias("mx"),
    )
    at = F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("mn")) / (F.col("mx") - F.col("mn")) * bins)).cast("int")
    counts = df.filter(F.col(value).isNotNull()).crossJoin(F.broadcast(ends)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    spine = ends.filter("mn is not null").select("mn", "mx", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    edge = lambda k: F.col("mn") + (F.col("mx") - F.col("mn")) * k / bins
    return spine.join(counts, "bin", "left").select(
        "bin", edge(F.col("bin")).alias("low"), edge(F.col("bin") + 1).alias("high"), F.coalesce("n", F.lit(0)).cast("long").alias("n")
    )
