import corpus_pipeline
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    seen = [docs]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, seen[-1], SMALL).write.parquet(str(tmp_path / str(i)))
        seen.append(spark.read.parquet(str(tmp_path / str(i))))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert dict(seen[-1].dtypes) == dict(docs.dtypes), name
    ids = [{r[0] for r in x.select("doc_id").collect()} for x in seen]
    assert ids[1] == {r.doc_id for r in docs.filter(F.col("text").rlike(r"\p{L}")).collect()}
    assert ids[2] < ids[1] and ids[3] == ids[2] and ids[4] <= ids[3] and ids[5] == ids[4]
    assert seen[3].filter(F.col("text").rlike('(?i)token = "[0-9a-f]{40}"')).isEmpty()
    assert seen[5].count() == seen[4].count() and seen[5].filter("not round_trip").isEmpty()
    assert corpus_pipeline.run(spark, SMALL).select("doc_id", "digest").exceptAll(seen[5].select("doc_id", "digest")).isEmpty()
