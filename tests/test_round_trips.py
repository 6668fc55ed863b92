"""Sources against sinks, packing against plain loops, metrics of a stream against the batch."""

import json
import random

from pyspark.sql import functions as F

from sparkloom.operators import metrics, packing, records
from sparkloom.sources import readers, writers
from sparkloom.streaming import votes


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_first_fit_against_a_plain_scan():
    rng = random.Random(5)
    for most in (1, 7, 1024):
        for size in (0, 1, 2, 3, 50, 257):
            lengths = [rng.randint(0, most + most // 8) for _ in range(size)]
            free, want = [], []
            for n in lengths:
                at = next((i for i, room in enumerate(free) if room >= n), len(free))
                free[at:] = free[at:] or [most]
                free[at] -= n
                want.append(at)
            assert packing.first_fit(lengths, most) == want


def test_carried_packs_keep_every_row(spark):
    rows = spark.createDataFrame([(0, 1, 3000), (0, 2, 2000), (0, 3, 10), (1, 4, 5000), (1, 5, 6)], "shard int, id int, n int")
    got = {(r.shard, r.pack): (r.kept, r.seg_lens, r.total) for r in packing.varlen_carried(rows, "shard", "id", "n", 4096).collect()}
    assert got == {(0, 0): (1, [3000], 3000), (0, 1): (2, [2000, 10, 6], 2016), (1, 0): (1, [5000], 5000), (1, 1): (1, [6, 2], 8)}


def test_pairs_are_cut_and_padded(spark):
    pairs = spark.createDataFrame([(1, "a b", "c"), (2, None, ""), (3, "w " * 200, "x")], "idx int, sentence1 string, sentence2 string")
    got = records.pair_tokens(pairs, most=128).withColumn("batch", F.lit(0))
    assert {r.idx: len(r.input_ids) for r in got.collect()} == {1: 6, 2: 2, 3: 128}
    few = got.filter("idx < 3")
    widths = lambda p: {r.width for r in packing.collate(few, "batch", 0, packing.pad_multiple(p), labels=None).collect()}
    assert (widths("fp8"), widths("bf16"), widths("no")) == ({16}, {8}, {6})


def test_joined_columns_show_nulls(spark):
    df = spark.createDataFrame([("a", None, "x"), ("b", "c", "y")], "Reactant1 string, Reactant2 string, Product string")
    assert [r[0] for r in df.coalesce(1).select(records.joined(df, "reactant")).collect()] == ["a.nan", "b.c"]


def test_task_tables_and_their_catalogue(spark, tmp_path):
    spark.createDataFrame([("CCO", 1, "train")], "Drug string, Y int, split string").write.parquet(str(tmp_path / "Tox" / "AMES"))
    spark.createDataFrame([("PQ", "RS", 0, 7)], "Protein1 string, Protein2 string, Y int, more int").write.parquet(str(tmp_path / "PPI" / "HuRI"))
    assert rows_of(readers.catalogue(spark, str(tmp_path))) == [("PPI", "HuRI"), ("Tox", "AMES")]
    single, pair = readers.task(spark, str(tmp_path), "Tox", "AMES"), readers.task(spark, str(tmp_path), "PPI", "HuRI")
    assert (single.columns, rows_of(single)) == (["Drug", "label", "split"], [("CCO", 1, "train")])
    assert (pair.columns, rows_of(pair)) == (["Protein1", "Protein2", "label"], [("PQ", "RS", 0)])


def test_splits_go_out_and_come_back(spark, tmp_path):
    df = spark.createDataFrame([(1, "ä\n", "training"), (2, None, "training"), (3, "c", "test")], "id long, text string, split string")
    writers.by_split(df, str(tmp_path / "parts"))
    assert rows_of(spark.read.schema("id long, text string, split string").json(str(tmp_path / "parts"))) == rows_of(df)
    for name in ("training", "validation", "test"):
        lines = [json.dumps({"id": r.id, "text": r.text}) for r in df.filter(F.col("split") == name).collect()]
        (tmp_path / f"{name}.jsonl").write_text("".join(x + "\n" for x in lines) or '{"id": 9, "extra": 1}\n')
    back = readers.splits(spark, str(tmp_path))
    assert rows_of(back.filter("split <> 'validation'").select("id", "text", "split")) == rows_of(df)
    assert rows_of(back.filter("split = 'validation'").select("id", "text", "extra")) == [(9, None, 1)]


def test_tables_and_packed_rows_come_back(spark, tmp_path):
    df = spark.createDataFrame([(1, [1, 2]), (2, [])], "id long, tokens array<int>")
    writers.parquet(df, str(tmp_path / "t"))
    writers.packed(df, str(tmp_path / "p"), pack_size=1024, seed=0)
    assert rows_of(spark.read.parquet(str(tmp_path / "t"))) == rows_of(spark.read.parquet(str(tmp_path / "p" / "packed"))) == rows_of(df)
    assert [json.loads(r.value) for r in spark.read.text(str(tmp_path / "p" / "metadata")).collect()] == [{"pack_size": 1024, "seed": 0}]


def test_declared_source(spark, tmp_path):
    (tmp_path / "s.jsonl").write_text('{"q": "x", "a": "1", "ok": true}\n{"q": "y", "a": "2", "ok": false}\n')
    got = readers.sft(spark, str(tmp_path / "s.jsonl"), {"q": "prompt", "a": "response"}, where="ok")
    assert (got.columns, rows_of(got)) == (["prompt", "response"], [("x", "1")])


def test_accuracy_of_a_stream_agrees_with_the_batch(spark, tmp_path):
    rows = spark.createDataFrame([(i % 2, (i * 7 % 10) / 10, "a" if i % 3 else "b") for i in range(60)], "label int, score double, task string")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    seen = []
    votes.follow_accuracy(stream, lambda df, n: seen.append(rows_of(df)), by=["task"], checkpoint=str(tmp_path / "cp")).awaitTermination(120)
    assert len(seen) > 1 and seen[-1] == rows_of(metrics.confusion(rows, by=["task"]))
