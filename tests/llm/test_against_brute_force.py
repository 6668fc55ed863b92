"""Operators held against plain versions of themselves on small fixtures and on the smallest tables."""

import itertools
import random
import re

import duckdb
import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from sparkloom.llm import components, language_id, mixing, ngram_join, pages, quality, queries, search, secrets, token_counts, toxicity

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words)} if 0 < len(words) < 5 else {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute_components(rows, percent=80):
    sets = {i: shingles(t) for i, t in rows}
    home = {i: i for i in sets}

    def root(i):
        while home[i] != i:
            i = home[i]
        return i

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            home[y] = x
    return {i: (len(sets[i]), root(i)) for i in sets}


def corpus(seed, n=160):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(4000)]
    passage = [f"p{i}" for i in range(60)]
    rows, bases = [], []
    for i in range(n):
        kind = rng.random()
        if bases and kind < 0.55:  # near copies at many distances, chains among them
            words = list(rng.choice(bases))
            for _ in range(rng.randint(0, 6)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
        elif kind < 0.8:  # a common passage with other words around it
            words = [rng.choice(vocabulary) for _ in range(rng.randint(5, 60))] + passage[: rng.choice((30, 60))]
        else:
            words = [rng.choice(vocabulary) for _ in range(rng.randint(1, 150))]
        bases.append(words)
        rows.append((i * 3 + 1, " ".join(words)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates(spark, seed):
    rows = corpus(seed)
    got = ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows)


def test_salted_tokens_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "_SALT_EVERY", 6)
    rows = corpus(3)
    got = ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows)


def test_connected_components(spark):
    rng = random.Random(7)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 460)]
    home = {}
    for a, b in edges:
        home.setdefault(a, a)
        home.setdefault(b, b)
    for _ in range(500):
        for a, b in edges:
            home[a] = home[b] = min(home[a], home[b])
    got = {r.node: r.component for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    lonely = {a for a, b in edges if a == b} - {x for a, b in edges if a != b for x in (a, b)}
    assert got == {k: v for k, v in home.items() if k not in lonely}


def test_language_on_held_out_rows(spark):
    rows = queries.op2_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) > 0.97 * len(held) and all(0 <= r.score <= 1 for r in rows)


def test_mix_meets_its_targets(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(["x"] * rng.randint(0, 120)), rng.choice(["a", "b", "c", "d", None])) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    size = {}
    for _, text, source in rows:
        size[source] = size.get(source, 0) + len(WORD.findall(text))
    names = sorted(s for s in size if s) + [None]
    weight = dict(zip(names, itertools.cycle((5, 2, 1))))
    want, open_ = {}, set(names)
    left = 1.5 * sum(size.values())
    while True:  # share, cap, share the rest again
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > 2 * size[s]}
        if not over:
            want |= {s: left * weight[s] / total for s in open_}
            break
        for s in over:
            want[s] = 2.0 * size[s]
            left -= 2 * size[s]
        open_ -= over
    taken = {}
    for r in got:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == size[r.source] and r.taken in (0, r.size, 2 * r.size)
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(abs(taken[s] - want[s]) <= 250 for s in names)  # about two of the longest documents
    again = {r.doc_id: r.taken for r in mixing.mix(docs.repartition(5)).collect()}
    assert again == {r.doc_id: r.taken for r in got}
    assert mixing.take(docs).count() == sum(r.copies for r in got)


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_against_edit_distances():
    entries = [("idiot", False), ("pathetic", False), ("scum", False), ("lowei", True)]
    matcher = toxicity.Matcher(toxicity.build(entries))
    rng = random.Random(1)
    words = ["idiot", "idoit", "idi0t", "idiots", "scum", "scun", "loweia", "lowe", "patetic", "pathetc", "pthetc", "path"]
    words += ["".join(rng.choice("idotpahecsumlw") for _ in range(rng.randint(1, 9))) for _ in range(3000)]
    text = " ".join(words)
    code = np.array([ord(c) for c in text])
    starts, ends = matcher.words(code, np.array([0, len(text)]))
    hit = set(matcher.hits(code, starts, ends)[0].tolist())
    for i, w in enumerate(words):
        want = w.startswith("lowei") or any(edit_distance(w, t) <= toxicity.edits_allowed(t) for t, stem in entries if not stem)
        assert (i in hit) == want, w


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    rows = [r for r in queries.op5_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect() if r.held_out]
    pos, neg = [r.score for r in rows if r.toxic], [r.score for r in rows if not r.toxic]
    assert sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg)) > 0.8
    assert sum(r.predicted for r in rows if not r.toxic) < 0.02 * len(neg)


def test_quotation_is_not_abuse(spark):
    model = toxicity.Model(toxicity.build([(t, False) for t in toxicity.LEXICON]), np.full((len(toxicity.LEXICON), 2), 2.0), toxicity.PRIOR)
    texts = ["you are an idiot and a moron", 'the word "idiot" was used', "you idi0t", "a fine day", ""]
    rows = {r.doc_id: r for r in toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    assert [rows[i].predicted for i in range(5)] == [1, 0, 1, 0, 0] and rows[1].n_quoted == 1 and rows[2].n_misspelled == 1


def duck(sql, folder=SMALL):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    cursor = c.execute(sql)
    names = [d[0] for d in cursor.description]
    return sorted(tuple(str(x) for _, x in sorted(zip(names, r, strict=True))) for r in cursor.fetchall())


@pytest.mark.parametrize("name", ["op1_ngram_join", "op6_quality_rules", "op7_topk_search"])
def test_sql_twins(spark, name):
    df = queries.queries()[name](spark, SMALL)
    got = sorted(tuple(str(x) for x in r) for r in df.select(*sorted(df.columns)).collect())
    assert got == duck(queries.oracle_sql()[name])


def test_quality_keeps_clean_and_drops_junk(spark):
    clean = "\n".join(f"Part{i} has its own{i} plain words{i} about thing{i}, place{i} and time{i}." for i in range(12))
    junk = "\n".join(f"Home | News | Sport | Page {i} | More" for i in range(12))
    mixed = clean + "\nAll rights reserved.\n" + "Home | News | Sport | Mail"
    got = {r.doc_id: r for r in quality.quality(spark.createDataFrame([(1, clean), (2, junk), (3, mixed)], "doc_id long, text string"), with_text=True).collect()}
    assert got[1].kept and got[1].clean_text == clean and not got[2].kept and got[3].kept and got[3].clean_text == clean


def test_search_against_all_scores(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcdefghijklmnop") * rng.randint(1, 2) for _ in range(rng.randint(0, 40))) for _ in range(700)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    asked = [(q, " ".join(rng.choice("abcdefghijklmnop") * rng.randint(1, 2) for _ in range(6))) for q in range(8)]
    got = {(r.query_id, r.place): (r.doc_id, r.score) for r in search.search(docs, spark.createDataFrame(asked, "item_id long, text string"), k=7).collect()}
    lists = [t.split() for t in texts]
    mean = sum(map(len, lists)) / len(lists)
    for q, text in asked:
        terms = set(text.split())
        idf = {t: np.log(1 + (len(lists) - d + 0.5) / (d + 0.5)) for t in terms for d in [sum(t in x for x in lists)]}
        score = lambda x: sum(idf[t] * x.count(t) * 2.2 / (x.count(t) + 1.2 * (0.25 + 0.75 * len(x) / mean)) for t in terms if t in x)
        best = sorted(((-round(score(x), 6), i) for i, x in enumerate(lists) if terms & set(x)))[:7]
        assert [got[q, p + 1] for p in range(len(best))] == [(i, pytest.approx(-s)) for s, i in best]


def test_pages(spark):
    page = lambda i, body: f'<html><head><title>t{i}</title><script>var a="</p><p>no";</script></head><body><nav><a href="/">Home</a></nav><div class="cookie-notice">We use cookies</div>{body}<footer>&copy; us</footer></body></html>'
    rows = [
        (1, "http://a.example/1", page(1, "<article><h1>Head</h1><p>One &amp; two<p>Three <b>bo</b>ld<br>x</article><div id=comments><p>first!</p></div>")),
        (2, "http://a.example/2", page(2, "<div class=main><p>A long plain paragraph about &lt;things&gt; that stays.</p><p>Same shell</p></div><form>mail</form>")),
        (3, "http://a.example/3", page(3, "<div class=main><p>Another long paragraph, not seen before at all.</p><p>Same shell</p></div>")),
        (4, "http://a.example/4", page(4, "<div class=main><p>The last of these paragraphs is here, too.</p><p>Same shell</p></div>")),
        (5, None, None), (6, "x", ""), (7, "http://b.example", "no tags <at all"),
    ]
    got = {r.page_id: r.text for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == "Head\nOne & two\nThree bold x"
    assert got[2] == "A long plain paragraph about <things> that stays."
    assert got[5] == got[6] == "" and got[7].startswith("no tags")


def test_token_counts(spark):
    lib = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path())
    texts = [None, "", " ", "   ", "a  b", "a\nb ", "▁a▁ b", "\x00z", "日本語 テキスト", "<s> </s>", "x" * 3000 + " " * 40 + "y"]
    rows = token_counts.token_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), queries.tokenizer_path(), limit=3).collect()
    for r in rows:
        text = texts[r.doc_id] or ""
        assert (r.n_bytes, r.n_tokens) == (len(text.encode()), len(lib.encode(text))) and r.over_limit == (r.n_tokens > 3)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    got = {r.doc_id: r.n_tokens for r in queries.op9_token_counts(spark, SMALL).collect()}
    assert got == {r.doc_id: len(lib.encode(r.text)) for r in docs}


def test_secrets(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    planted = {r.doc_id for r in docs.filter(F.col("text").rlike('(?i)token = "[0-9a-f]{40}"')).collect()}
    assert planted and {r.doc_id for r in queries.op10_secret_scan(spark, sf).collect()} == planted
    forest = secrets.train(secrets.labelled_findings(spark))
    scored = secrets.labelled_findings(spark, 4000).withColumn("doc_id", F.monotonically_increasing_id())
    hits = {r.doc_id for r in secrets.scan(scored, forest, path_col="path").collect()}
    rows = scored.collect()
    assert sum((r.doc_id in hits) == bool(r.label) for r in rows) > 0.95 * len(rows)
    clean = secrets.redact(docs, forest)
    assert clean.filter(F.col("text").rlike('(?i)token = "[0-9a-f]{40}"')).isEmpty() and clean.count() == docs.count()
