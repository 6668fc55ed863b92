"""Every operator over the same awkward table: nulls, empty and long texts, repeated rows, clashing columns, no rows."""

import pytest
from pyspark.sql import functions as F

from sparkloom.llm import language_id, mixing, ngram_join, pages, quality, search, secrets, sentencepiece_scan, token_counts, toxicity
from sparkloom.llm.queries import tokenizer_path

LONG = " ".join(f"word{i % 700} of the thing" for i in range(20_000))
ROWS = [
    (1, "the cat sat on the mat. It was the best mat there is, said the cat to all of the other cats here in town.", "en", "a"),
    (1, "the cat sat on the mat. It was the best mat there is, said the cat to all of the other cats here in town.", "en", "a"),
    (2, "", "en", "a"),
    (3, None, None, None),
    (None, "a text without an id", "en", None),
    (4, " \n\t ", "de", "b"),
    (5, LONG, "en", "b"),
    (6, "12345 !!! ???", "fr", "b"),
    (7, "ein Haus und noch ein Haus für die Leute", "de", "c"),
]
COLUMNS = "doc_id long, text string, lang string, source string, score string, n_tokens string, component_id string, taken string, template string, rate string, term string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "x", "x", "x", "x", "x", "x", "x") for r in ROWS], COLUMNS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1), (2, 0), (5, 0), (7, 0), (None, 1), (6, None)], "doc_id long, toxic int")


def operators(spark, docs, labels):
    learn = F.lit(True)
    forest = secrets.train(secrets.labelled_findings(spark, 300))
    return {
        "ngram": lambda d: ngram_join.ngram_components(d),
        "language": lambda d: language_id.identify(d, language_id.train(d, learn)),
        "pieces": lambda d: sentencepiece_scan.encode(d, tokenizer_path()),
        "mix": lambda d: mixing.mix(d),
        "toxicity": lambda d: toxicity.score(d, toxicity.train(d, labels, learn)),
        "quality": lambda d: quality.quality(d, with_text=True),
        "pages": lambda d: pages.extract(d, id_col="doc_id", url_col="source", html_col="text"),
        "tokens": lambda d: token_counts.token_counts(d, tokenizer_path()),
        "redact": lambda d: secrets.redact(d, forest),
    }


def test_one_row_for_each_row(spark, docs, labels):
    for name, run in operators(spark, docs, labels).items():
        assert run(docs).count() == len(ROWS), name
        assert run(docs.filter(F.lit(False))).count() == 0, name


def test_all_null(spark, docs, labels):
    nothing = docs.select(*[F.lit(None).cast(t).alias(c) for c, t in docs.dtypes])
    for name, run in operators(spark, docs, labels).items():
        assert run(nothing).count() == len(ROWS), name


def test_lists_of_findings(spark, docs):
    forest = secrets.train(secrets.labelled_findings(spark, 300))
    assert secrets.scan(docs, forest).count() == 0
    assert secrets.scan(docs.filter(F.lit(False)), forest).count() == 0
    asked = spark.createDataFrame([(1, "the cat"), (2, None), (3, "nowhere"), (None, "cat")], "item_id long, text string")
    got = {(r.query_id, r.place, r.doc_id) for r in search.search(docs, asked).collect()}
    assert (1, 1, 1) in got and {q for q, _, _ in got} == {1}
    assert search.search(docs.filter(F.lit(False)), asked).count() == 0
    assert search.search(docs, asked.filter(F.lit(False))).count() == 0


def test_defined_values(spark, docs):
    by = {r.doc_id: r for r in ngram_join.ngram_components(docs).collect()}
    assert (by[2].n_shingles, by[2].component_id) == (0, 2) and by[1].n_copies == 2 and by[None].component_id is None
    assert {r.doc_id: r.lang_pred for r in language_id.identify(docs, language_id.train(docs, F.lit(True))).collect()}[6] == "und"
    mixed = {r.doc_id: r for r in mixing.mix(docs).collect()}
    assert mixed[3].size == mixed[3].taken == 0 and all(r.taken <= 2 * r.size for r in mixed.values())
    assert mixing.take(docs).columns == docs.columns
    assert {r.doc_id for r in ngram_join.one_of_each(docs).collect()} == {1, 2, 3, None, 4, 5, 6, 7}
