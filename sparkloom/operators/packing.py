"""Collating and packing token sequences. Packs form within a shard; shards never meet, so they scale out."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import arrays


def pad_multiple(precision: str) -> int | None:
    """What widths are rounded up to: 16 for fp8, 8 for other mixed precision, nothing for "no"."""
    return {"fp8": 16, "no": None}.get(precision, 8)


def collate(rows: DataFrame, batch: str, pad: int, multiple: int | None = 16, ids: str = "input_ids", labels: str | None = "labels", most: int | None = None) -> DataFrame:
    """Rows padded right to their batch's longest, rounded up; labels get the ignored value, mask is ids != pad.

    Labels that are one number a row stay as they are with labels=None.
    """
    longest = rows.groupBy(batch).agg(F.max(F.size(ids)).alias("longest"))
    n = F.lit(most) if most else arrays.ceil_to(F.col("longest"), multiple) if multiple else F.col("longest")
    padded = rows.join(longest, batch).withColumn("width", n)
    padded = padded.withColumn(ids, arrays.pad_right(F.col(ids), F.col("width"), pad))
    if labels:
        padded = padded.withColumn(labels, arrays.pad_right(F.col(labels), F.col("width"), arrays.IGNORE))
    return padded.withColumn("attention_mask", arrays.attention_mask(F.col(ids), pad)).drop("longest")


def next_fit(lengths: Column, most: int) -> Column:
    """The pack number of each length: a new pack starts where the current one would overflow."""
    zero = F.struct(F.lit(-1).alias("pack"), F.lit(0).cast("long").alias("fill"), F.array().cast("array<int>").alias("out"))

    def step(s, n):
        fresh = (s["pack"] < 0) | (s["fill"] + n > most)
        pack = F.when(fresh, s["pack"] + 1).otherwise(s["pack"])
        fill = F.when(fresh, n).otherwise(s["fill"] + n).cast("long")
        return F.struct(pack.alias("pack"), fill.alias("fill"), F.concat(s["out"], F.array(pack)).alias("out"))

    return F.aggregate(lengths, zero, step, lambda s: s["out"])


def pack_next_fit(rows: DataFrame, shard: str, order: str, length: str, most: int) -> DataFrame:
    """shard, order, length, pack: sequences in their order, none split, none moved past another."""
    lists = rows.groupBy(shard).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(length).alias("n")))).alias("x"))
    packs = lists.select(shard, "x", next_fit(F.transform("x", lambda s: s["n"].cast("long")), most).alias("p"))
    return packs.select(shard, F.explode(F.arrays_zip("x", "p")).alias("e")).select(shard, F.col("e.x.o").alias(order), F.col("e.x.n").alias(length), F.col("e.p").alias("pack"))


def first_fit(lengths: list[int], most: int) -> list[int]:
    """The pack of each length: the first with room, found in a tree of the largest room below each node."""
    width = 1 << max(len(lengths) - 1, 0).bit_length()
    room = [most] * (2 * width)
    used, out = 0, []
    for n in lengths:
        if n > most:
            at = width + used
        else:
            at = 1
            while at < width:
                at = 2 * at + (room[2 * at] < n)
        out.append(at - width)
        used = max(used, at - width + 1)
        room[at] -= n
        while at > 1:
            at //= 2
            room[at] = max(room[2 * at], room[2 * at + 1])
    return out


def pack_first_fit(rows: DataFrame, shard: str, key: str, length: str, most: int, seed: int = 0) -> DataFrame:
    """shard, key, length, pack: in an order shuffled by hash each sequence goes to the first pack with room.

    One longer than a pack has a pack of its own. Ties of the hash go by the key.
    """

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values(["h", key])
        return rows.assign(pack=first_fit(rows[length].tolist(), most))[[shard, key, length, "pack"]]

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    hashed = rows.select(shard, key, length, F.md5(F.concat_ws("/", F.lit(str(seed)), F.col(key).cast("string"))).alias("h"))
    return hashed.groupBy(shard).applyInPandas(fit, f"{shard} {kinds[shard]}, {key} {kinds[key]}, {length} {kinds[length]}, pack int")


def varlen_carried(rows: DataFrame, shard: str, order: str, length: str, most: int, align: int = 8) -> DataFrame:
    """shard, pack and the columns of `varlen`: what a batch has no room for starts the next one, so no row is lost."""
    packs = pack_next_fit(rows, shard, order, length, most).groupBy(shard, "pack").agg(F.sort_array(F.collect_list(F.struct(order, length))).alias("x"))
    return packs.select(shard, "pack", varlen(F.transform("x", lambda s: s[length].cast("long")), most, align).alias("v")).select(shard, "pack", "v.*")


def varlen(lengths: Column, most: int, align: int = 8) -> Column:
    """(kept, seg_lens, cu_seqlens, total, max_seqlen) of one batch: sequences until the first that overflows, then a
    segment of padding up to a multiple of `align`."""
    zero = F.struct(F.lit(0).cast("long").alias("fill"), F.lit(False).alias("stop"), F.array().cast("array<bigint>").alias("out"))

    def step(s, n):
        stop = s["stop"] | ((s["fill"] > 0) & (s["fill"] + n > most))
        return F.struct(
            F.when(stop, s["fill"]).otherwise(s["fill"] + n).cast("long").alias("fill"), stop.alias("stop"),
            F.when(stop, s["out"]).otherwise(F.concat(s["out"], F.array(n.cast("long")))).alias("out"),
        )

    def done(s):
        gap = arrays.gap_to(s["fill"], align)
        segs = F.when(gap > 0, F.concat(s["out"], F.array(gap.cast("long")))).otherwise(s["out"])
        cu = F.aggregate(segs, F.array(F.lit(0).cast("long")), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
        return F.struct(
            F.size(s["out"]).alias("kept"), segs.alias("seg_lens"), cu.alias("cu_seqlens"), (s["fill"] + gap).cast("long").alias("total"), F.array_max(segs).alias("max_seqlen")
        )

    return F.aggregate(lengths, zero, step, done)
