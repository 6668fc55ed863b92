import random

import pytest
from pyspark.sql import functions as F

from sparkloom import registry
from sparkloom.operators import evaluation, metrics, packing, records, sampling, transcripts
from sparkloom.sources import readers, writers
from sparkloom.streaming import votes


def scores(spark, rows):
    return spark.createDataFrame(rows, "label int, score double")


def test_auroc(spark):
    value = lambda rows, **k: metrics.auroc(scores(spark, rows), **k).first()["auroc"]
    rows = [(0, 0.5), (1, 0.5), (0, 0.1), (1, 0.9)]
    assert value(rows) == 0.875
    assert value([(a, b * 3 + 1) for a, b in rows]) == 0.875  # monotone transforms don't matter
    assert value([(1 - a, b) for a, b in rows]) == 0.125
    assert value([(0, 0.3), (1, 0.3)]) == 0.5
    assert value([(1, 0.3)]) is None
    assert value([(0, 0.0), (1, None), (1, 1.0)]) == value([(0, 0.0), (1, None), (1, 1.0)], nulls="half") == 1.0


def test_roc_curve_area_is_the_auroc(spark):
    rng = random.Random(2)
    df = scores(spark, [(rng.randint(0, 1), rng.randint(0, 9) / 10) for _ in range(300)])
    points = sorted((r.fpr, r.tpr) for r in metrics.roc_curve(df).collect())
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(points, points[1:], strict=False))
    assert area == pytest.approx(metrics.auroc(df).first()["auroc"])
    assert points[0] == (0.0, 0.0) and points[-1] == (1.0, 1.0)


def test_votes_and_macro(spark):
    rows = [(1, 0)] * 3 + [(1, 1)] + [(1, None)] * 12 + [(2, None)]
    got = {r.item_id: tuple(r) for r in evaluation.votes(spark.createDataFrame(rows, "item_id int, pred int")).collect()}
    assert got == {1: (1, 3, 1, 12, 0.25), 2: (2, 0, 0, 1, None)}
    aurocs = spark.createDataFrame([("x", 0.5), ("x", 1.0), ("y", None)], "family string, auroc double")
    families = spark.createDataFrame([("x",), ("y",), ("z",)], "family string")
    assert {tuple(r) for r in metrics.macro_average(aurocs, families).collect()} == {("x", 0.75, 2), ("y", None, 0), ("z", None, 0)} or {
        (r.family, r.n_tasks, r.macro) for r in metrics.macro_average(aurocs, families).collect()
    } == {("x", 2, 0.75), ("y", 0, None), ("z", 0, None)}


def test_best_and_worst(spark):
    df = spark.createDataFrame([(1, 1, 0.2), (1, 1, 0.7), (2, 0, 0.2), (2, 0, 0.7)], "parent_id int, label int, p_b double")
    assert {(r.parent_id, r.best, r.worst) for r in evaluation.variant_ranges(df).collect()} == {(1, 0.7, 0.2), (2, 0.2, 0.7)}


def test_varlen(spark):
    pack = lambda *n: spark.range(1).select(packing.varlen(F.array(*[F.lit(x).cast("long") for x in n]), 4096).alias("v")).first()["v"]
    a = pack(5, 6)
    assert (a.kept, a.total, a.cu_seqlens, a.max_seqlen) == (2, 16, [0, 5, 11, 16], 6)
    assert pack(3000, 2000, 10).cu_seqlens == [0, 3000]
    assert pack(5000).kept == 1


def test_packing_keeps_every_token(spark):
    rng = random.Random(4)
    rows = spark.createDataFrame([(i % 3, i, rng.randint(1, 900)) for i in range(200)], "shard int, id int, n int")
    for out in (packing.pack_next_fit(rows, "shard", "id", "n", 1024), packing.pack_first_fit(rows, "shard", "id", "n", 1024)):
        got = out.collect()
        assert sorted((r.id, r.n) for r in got) == sorted((r.id, r.n) for r in rows.collect())
        fill = {}
        for r in got:
            fill[r.shard, r.pack] = fill.get((r.shard, r.pack), 0) + r.n
        assert max(fill.values()) <= 1024
    last = {}
    for r in sorted(packing.pack_next_fit(rows, "shard", "id", "n", 1024).collect(), key=lambda r: (r.shard, r.id)):
        assert r.pack >= last.get(r.shard, 0)
        last[r.shard] = r.pack


def test_negative_pairs(spark):
    rows = spark.createDataFrame([(i % 12, (i * 7) % 31) for i in range(60)], "a int, b int")
    got = [tuple(r) for r in sampling.negatives(rows, "a", "b").collect()]
    known = {tuple(r) for r in rows.collect()}
    no = [x[:2] for x in got if x[2] == 0]
    assert len(set(no)) == len(no) == len(known) and not set(no) & known
    assert got and sorted(got) == sorted(tuple(r) for r in sampling.negatives(rows, "a", "b").collect())
    assert sampling.same_rows(rows, sampling.shuffled(rows, "a")) and not sampling.same_rows(rows, rows.limit(3))


def test_cot_answer(spark):
    rows = [("qed.json", '{"b": "x", "a": "y"}', '{"reference": "C"}'), ("qed.json", "no", "{}"), ("add.json", '{"k": "v"}', '{"reference": "N"}')]
    df = spark.createDataFrame(rows, "f string, c string, m string")
    got = [r[0] for r in df.select(records.cot_answer(F.col("f"), F.col("c"), F.col("m"))).collect()]
    assert got == ["<think>\nb:\nx\na:\ny\n</think>\nAnswer: \n{\n    ‘Final Target Molecule’: C,\n}", None, "<think>\nk:\nv\n</think>\nAnswer: N"]


def test_templates_must_exist(spark):
    rows = spark.createDataFrame([("a",), ("b",)], "prompt_key string")
    known = spark.createDataFrame([("a", "t")], "prompt_key string, template string")
    with pytest.raises(Exception, match="no template for b"):
        records.with_templates(rows, known).collect()


def test_family_order(spark):
    got = {r.task: r.f for r in registry.tasks(spark, {"Tox21": ["NR-AR"]}, ["Tox"]).select("task", registry.family(F.col("task_group"), F.col("task")).alias("f")).collect()}
    assert got["hERG_Karim"] == got["hERG"] == "hERG" and got["Tox21_NR_AR"] == "Tox21" and got["Carcinogens_Lagunin"] is None


def test_transcripts(spark, tmp_path):
    line = "=" * 80
    text = f"Prompt 1:\nq\n\nGT lable: 1\n{line}\n\nReasoning 1:\nso\nAnswer: A\n\nGT lable 1: 1\n{line}\n\nReasoning 2:\nAnswer: B\n\nGT lable 2: 1\n{line}\n"
    (tmp_path / "a.md").write_text(text + "\n" + text.replace("Prompt 1", "Prompt 2"))
    got = transcripts.samples(readers.transcripts(spark, str(tmp_path / "*.md"))).orderBy("prompt_no", "sample_idx").collect()
    assert [(r.prompt_no, r.label, r.sample_idx, r.response) for r in got] == [(p, 1, i, x) for p in (0, 1) for i, x in ((0, "so\nAnswer: A"), (1, "Answer: B"))]


def test_sources_and_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "ä", None), (2, "b", "x")], "id int, text string, extra string")
    writers.json_lines(rows, str(tmp_path / "lines"))
    assert readers.json_lines(spark, str(tmp_path / "lines")).count() == 2
    assert all('"extra"' in x.value for x in spark.read.text(str(tmp_path / "lines")).collect())
    writers.json_array(rows, str(tmp_path / "a.json"))
    assert readers.json_arrays(spark, str(tmp_path / "a.json"), "id int, text string").count() == 2
    (tmp_path / "counts").mkdir()
    (tmp_path / "counts" / "training.jsonl").write_text("{}\n{}\n")
    assert {tuple(r) for r in readers.line_counts(spark, str(tmp_path / "counts"), ["training.jsonl", "test.jsonl"]).collect()} == {("training.jsonl", 2), ("test.jsonl", 0)}
    (tmp_path / "t.json").write_text('{"weber": "W {x}", "SARSCOV2_3CLPro_Diamond": "S"}')
    assert {r.prompt_key for r in readers.templates(spark, str(tmp_path / "t.json")).collect()} == {"weber", "SARSCOV2_3CLPro_Diamond", "SARSCoV2_3CLPro_Diamond"}
    built = []
    make = lambda: built.append(1) or rows
    assert writers.cached(spark, str(tmp_path / "c"), make).count() == writers.cached(spark, str(tmp_path / "c"), make).count() == 2 and len(built) == 1


def test_streaming_votes_agree_with_the_batch(spark, tmp_path):
    rows = spark.createDataFrame([(i % 9, i % 2, i, "Answer: (B)" if i % 3 else "Answer: (A)") for i in range(90)], "item_id int, label int, sample_idx int, response string")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    seen = []
    votes.follow_auroc(stream, lambda df, n: seen.append(df.first()["auroc"]), checkpoint=str(tmp_path / "cp")).awaitTermination(120)
    batch = evaluation.votes(evaluation.parse_samples(rows), keep=["label"])
    assert seen[-1] == metrics.auroc(batch, score="p").first()["auroc"]
