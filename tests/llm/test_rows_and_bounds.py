"""Rows that share an id, samples with a bound, pieces of long texts, and plain twins of models."""

import itertools

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import language_id, mixing, ngram_join, search, secrets, token_counts, toxicity

WORDS = [f"{a}{b}{c}" for a, b, c in itertools.product("bdfgklmnprst", "aeiou", "bdfgklmnprst")]


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(WORDS, n))


def test_copies_belong_to_rows(spark):
    rows = [(1, "x", "a b c", i) for i in range(40)] + [(i, None if i % 3 else "y", "w " * (i % 7), i) for i in range(50)] + [(None, "z", None, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, k int")
    taken = mixing.take(docs)
    assert taken.count() == mixing.mix(docs).agg(F.sum("copies")).first()[0] > 39
    assert taken.filter("doc_id = 1").count() > 0
    again = mixing.take(docs.repartition(7))
    assert taken.exceptAll(again).isEmpty() and again.exceptAll(taken).isEmpty()


def test_rows_of_one_id_are_scored_by_themselves(spark):
    docs = spark.createDataFrame([(1, "apple apple pear"), (1, "plum plum plum kiwi"), (2, "apple plum"), (3, "fig")], "doc_id long, text string")
    asked = spark.createDataFrame([(9, "apple plum")], "item_id long, text string")
    got = {r.doc_id: r.score for r in search.search(docs, asked).collect()}
    n, mean = 4, (3 + 4 + 2 + 1) / 4
    idf = lambda df: np.log(1 + (n - df + 0.5) / (df + 0.5))
    part = lambda tf, size: tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))
    assert got[1] == pytest.approx(max(idf(2) * part(2, 3), idf(2) * part(3, 4)), abs=1e-6) and got[2] == pytest.approx(2 * idf(2) * part(1, 2), abs=1e-6)


def test_many_rows_of_an_id_leave_room_for_others(spark):
    docs = spark.createDataFrame([(1, "apple pear")] * 30 + [(i, "apple " + "fig " * i) for i in range(2, 9)], "doc_id long, text string").coalesce(1)
    asked = spark.createDataFrame([(9, "apple")], "item_id long, text string")
    assert [r.doc_id for r in search.search(docs, asked, k=5).orderBy("place").collect()] == [1, 2, 3, 4, 5]


def test_shards_of_any_size_agree(spark, monkeypatch):
    docs = spark.createDataFrame([(i, prose(i, 60)) for i in range(300)], "doc_id long, text string").repartition(3)
    asked = docs.filter("doc_id % 20 = 0")
    rows = lambda: sorted(tuple(r) for r in search.search(docs, asked, k=6, query_id="doc_id").collect())
    want = rows()
    monkeypatch.setattr(search, "SHARD", 500)
    monkeypatch.setattr(search, "QUERY_TERMS", 200)
    assert rows() == want and len(want) == 15 * 6


def test_samples_are_bounded_by_rows(spark):
    docs = spark.createDataFrame([(1, f"the same id {i}", "en") for i in range(500)] + [(i, f"ein Haus {i}", "de") for i in range(2, 40)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(1, 1)] * 5 + [(i, 0) for i in range(2, 40)], "doc_id long, toxic int")
    assert toxicity.sample(docs, labels, F.lit(True), most=10).groupBy().pivot("label", [0, 1]).count().first() == (10, 1)
    model = language_id.train(docs, F.lit(True), per_language=5)
    assert model.families == [["de", "en"]]


@pytest.mark.parametrize("most", [3, 1_000_000])
def test_few_frequent_shingles_shape_orders_only(spark, monkeypatch, most):
    base = [prose(i, 80).split() for i in range(6)]
    rows = [(i, " ".join(base[i % 6][: 70 + i % 3] + [f"own{i}"])) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(ngram_join, "MAX_FREQUENT", most)
    keys, counts = ngram_join.frequent_shingles(docs, 5, 8, 4)
    assert len(keys) == len(counts) <= most and (most > 3) == (len(keys) > 3)
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for i, t in rows}
    home = {i: i for i in sets}

    def root(i):
        return i if home[i] == i else root(home[i])

    for a, b in itertools.combinations(sets, 2):
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            home[y] = x
    assert {r.doc_id: r.component_id for r in ngram_join.ngram_components(docs).collect()} == {i: root(i) for i in sets}


def test_rows_of_one_id_with_other_texts_are_classes_of_their_own(spark):
    a, b = prose(1, 60), prose(2, 60)
    docs = spark.createDataFrame([(5, a), (5, b), (7, a + " more"), (3, b + " else"), (9, b)], "doc_id long, text string")
    got = sorted((r.doc_id, r.component_id) for r in ngram_join.ngram_components(docs).collect())
    assert got == [(3, 3), (5, 3), (5, 5), (7, 5), (9, 3)]


def walk(node, x):
    while isinstance(node, tuple):
        node = node[2] if x[node[0]] <= node[1] else node[3]
    return node


def test_forest_against_a_plain_walk(spark):
    findings = secrets.labelled_findings(spark, 800)
    forest = secrets.train(findings)
    used = set()
    todo = list(forest)
    while todo:
        node = todo.pop()
        if isinstance(node, tuple):
            used.add(secrets.FEATURES[node[0]])
            todo += node[2:]
    assert {"doc_path", "coverage", "transitions", "n_chars", "near"} <= used
    rows = findings.select(F.explode(secrets.candidates(F.col("text"), F.col("path"))).alias("c")).select("c.f", secrets.forest_score(forest, F.col("c.f")).alias("score")).collect()
    assert len(rows) > 700
    for r in rows:
        assert r.score == pytest.approx(np.mean([walk(t, tuple(r.f)) for t in forest]))


@pytest.mark.parametrize("label", [None, 0, 1])
def test_findings_without_both_labels(spark, label):
    findings = secrets.labelled_findings(spark, 40)
    findings = findings.filter("label is null") if label is None else findings.filter(F.col("label") == label)
    docs = spark.createDataFrame([(1, 'token = "0123456789abcdef0123456789abcdef"')], "doc_id long, text string")
    assert secrets.scan(docs, secrets.train(findings), path_col=None).count() == (1 if label == 1 else 0)


def test_paths_tell_examples_from_use(spark):
    forest = secrets.train(secrets.labelled_findings(spark))
    key = 'api_key = "4f9a1c7be02d58364f9a1c7be02d58364f9a1c7b"'
    docs = spark.createDataFrame([(1, key, "src/app.py"), (2, key, "tests/fixtures/keys.json")], "doc_id long, text string, source string")
    assert {r.doc_id: r.score for r in secrets.scan(docs, forest, least=0.0).collect()}[1] > {r.doc_id: r.score for r in secrets.scan(docs, forest, least=0.0).collect()}[2]


def test_languages_count_long_texts_in_pieces():
    texts = pa.array(["für die Häuser und " * 400, "", None, "x", "été à la mer " * 300])
    whole = [x for _, x in language_id.ngram_counts(texts)]
    pieces = [x for _, x in language_id.ngram_counts(texts, piece=1000)]
    assert np.array_equal(np.concatenate(whole), np.concatenate(pieces))


def test_toxic_hits_of_long_texts(monkeypatch):
    auto = toxicity.build([("idiot", False), ("lowei", True)])
    texts = pa.array([("plain words here " * 50 + 'an idiot, "idiot" said he; idi0t loweia ') * 40, "idiot", None, "", "z" * 5000 + " idiot"])
    found = lambda: [(f, w.tolist(), h) for f, w, h in toxicity.document_hits(texts, toxicity.Matcher(auto))]
    flat = lambda groups: sorted((f + r, *rest) for f, _, h in groups for r, *rest in h)
    want = found()
    monkeypatch.setattr(toxicity, "_CHUNK", 1000)
    got = found()
    assert flat(got) == flat(want) and len(flat(want)) == 40 * 4 + 2
    assert sum((w for _, w, _ in got), []) == sum((w for _, w, _ in want), [])


def test_groups_of_any_size_count_the_same(spark, monkeypatch):
    from sparkloom.llm.queries import tokenizer_path

    docs = spark.createDataFrame([(i, prose(i % 40, 50) + "  " * (i % 5)) for i in range(400)] + [(400, " ".join(WORDS) * 30)], "doc_id long, text string").repartition(2)
    rows = lambda: sorted(tuple(r) for r in token_counts.token_counts(docs, tokenizer_path()).collect())
    want = rows()
    monkeypatch.setattr(token_counts, "GROUP_BYTES", 2000)
    monkeypatch.setattr(token_counts, "PIECE_BYTES", 700)
    assert rows() == want
