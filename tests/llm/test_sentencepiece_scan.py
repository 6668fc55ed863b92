import random

import pytest
import sentencepiece
from pyspark.sql import functions as F

from sparkloom.llm import sentencepiece_scan as scan
from sparkloom.llm.queries import tokenizer_path

WORDS = ["the", "international", "Straße", "日本語", "a" * 24, "-" * 26, "x", "☃", "responsibilities", "    ", "\n", "foo\nbar", "hello", "été", " "]


@pytest.fixture(scope="module")
def lib():
    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())


def by_chunks(pieces, text, chunk):
    whole = scan.MARK + text.replace(" ", scan.MARK)
    bodies = []
    for lo in range(0, len(whole), chunk):
        hi = min(lo + chunk, len(whole))
        left, right = max(0, lo - 16), min(len(whole), hi + 16)
        bodies.append((whole[left:right], lo - left, hi - left, lo == 0, hi == len(whole)))
    states = scan.boundary_states([scan.transfer(pieces, *b) for b in bodies])
    return [i for b, x, y in zip(bodies, [0, *states[:-1]], states) for i in scan.trace(pieces, *b, x, y).tolist()]


def test_chunks_cut_anywhere_give_the_librarys_ids(lib):
    pieces, rng = scan.Pieces(tokenizer_path()), random.Random(5)
    for _ in range(60):
        text = "".join(rng.choice(WORDS) + rng.choice([" ", "", "  "]) for _ in range(rng.randint(1, 14)))
        for chunk in (1, 3, 7, 40):
            assert not text or by_chunks(pieces, text, chunk) == lib.encode(text), (chunk, text)


def test_combine_is_associative():
    import numpy as np

    rng = np.random.default_rng(3)
    a, b, c = (np.where(rng.random(s) < 0.4, -np.inf, rng.integers(-9, 0, s).astype(float)) for s in ((1, 4), (4, 5), (5, 3)))
    assert (scan.combine(scan.combine(a, b), c) == scan.combine(a, scan.combine(b, c))).all()


def test_whole_table_against_the_library(spark, lib):
    rng = random.Random(9)
    long = " ".join(rng.choice(WORDS) for _ in range(2000))
    texts = [None, "", " ", "   ", "a", "a  b ", "\x00z", "▁a▁", "no-space" * 300, long, long, "x" * 2000]
    docs = spark.createDataFrame([(i if i != 4 else None, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    rows = scan.encode(docs, tokenizer_path(), chunk=500).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = (texts[r.doc_id if r.doc_id is not None else 4] or "").replace("▁", " ")
        assert r.ids == lib.encode(text), text[:40]
        assert r.n_tokens == len(r.ids) and r.round_trip and r.n_chars == len(text)
    whole = {r.doc_id: r.digest for r in scan.encode(docs, tokenizer_path(), with_ids=False).collect()}
    assert whole == {r.doc_id: r.digest for r in rows}  # however the text is cut
    back = {r.doc_id: r.out for r in scan.decode(scan.encode(docs, tokenizer_path(), chunk=500), tokenizer_path(), text_col="out").collect()}
    assert all(v == (texts[k if k is not None else 4] or "").replace("▁", " ") for k, v in back.items())
    assert scan.encode(docs.filter(F.lit(False)), tokenizer_path()).count() == 0
