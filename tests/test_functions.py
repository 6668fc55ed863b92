import pytest
from pyspark.sql import functions as F

from sparkloom.functions import answers, arrays, text

# response, tail, well formed, then the answers of the four dialects
PARSED = [
    ("Answer: (A)", "(A)", True, 0, 0, 0, 0),
    ("Answer: (B)", "(B)", True, 1, 1, 1, 1),
    ("Answer: B", "B", True, 1, 1, 1, None),
    ("Answer: A", "A", True, 0, 0, 0, None),
    ("Answer: (B) since Aromatic", "(B) since Aromatic", True, 0, 1, 1, 1),
    ("Answer: A and B", "A and B", True, 0, 1, 1, None),
    ("the answer is B", "B", True, 1, 1, 1, None),
    ("Final:\n(B)", "Final:\n(B)", False, 1, 1, 1, None),
    ("(B)", "(B)", False, None, None, 1, None),
    ("\\boxed{A}", "\\boxed{A}", False, 0, 0, 0, None),
    ("x \\text{B} y", "x \\text{B} y", False, 1, 1, 1, None),
    ("Answer: yes", "yes", True, None, None, 1, None),
    ("Answer: (A) then final ANSWER: (B)", "(B)", True, 1, 1, 1, 1),
    ("Answer is B", "Answer is B", False, None, None, 1, None),
    ("ANSWER: (B)", "ANSWER: (B)", False, None, None, 1, 1),
    ("Answer: neither", "neither", True, None, None, None, None),
    ("The answer is (A). Answer: **B**", "**B**", True, 1, 1, 1, None),
    ("Answer:", "", True, None, None, None, None),
    ("", "", False, None, None, None, None),
]


def test_answers(spark):
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(PARSED)], "i int, r string")
    t, ok = answers.tail(F.col("r"))
    got = df.select("i", t, ok, *[answers.answer(F.col("r"), d) for d in answers.DIALECTS]).orderBy("i").collect()
    for row, want in zip(got, PARSED, strict=True):
        assert tuple(row)[1:] == want[1:], want[0]


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_text(spark):
    assert one(spark, text.strip(F.lit("  a b\t\n")), text.clip(F.lit("abcdef"), 3), text.clip(F.lit("abc"), 3), text.clip(F.lit("abc"), 3, True)) == ("a b", "abc...", "abc", "abc...")
    assert one(spark, text.before(F.lit("MVP*XPP*"), "*"), text.after_last(F.lit("a/b/c"), "/")) == ("MVP", "c")
    assert one(spark, text.user_text(F.lit("i"), F.lit("")), text.user_text(F.lit("i"), F.lit("x"))) == ("i", "i\nx")
    chat = F.concat(text.message("user", F.lit("q")), text.message("assistant", F.lit("<think>\n\n</think>\n(A)")))
    source, target = text.split_reply(chat)
    assert one(spark, source, target) == ("<|im_start|>user\nq<|im_end|>\n<|im_start|>assistant", "\n<think>\n\n</think>\n(A)<|im_end|>\n")
    scaled = [text.three_digits(text.scale_1000(F.lit(y), F.lit(0.0), F.lit(1.0))) for y in (0.0, 0.0005, 0.0015, 1.0)]
    assert one(spark, *scaled) == ("000", "000", "002", "1000")
    assert one(spark, text.scale_1000(F.lit(4.0), F.lit(4.0), F.lit(4.0)), text.choice(F.lit(1))) == (0, "(B)")
    with pytest.raises(Exception, match="label is not 0 or 1"):
        one(spark, text.choice(F.lit(2)))


def test_arrays(spark):
    ids = F.array(*[F.lit(x) for x in (1, 2, 3, 4, 5)])
    assert one(spark, arrays.label_mask(ids, F.lit(3)))[0] == [-100, -100, -100, 4, 5]
    assert one(spark, arrays.append_eos(ids, 5), arrays.append_eos(ids, 9), arrays.append_eos(F.array().cast("array<int>"), 9)) == ([1, 2, 3, 4, 5], [1, 2, 3, 4, 5, 9], [9])
    assert one(spark, arrays.running_sum(ids), arrays.positions(F.array(F.lit(2), F.lit(3)))) == ([0, 1, 3, 6, 10, 15], [0, 1, 0, 1, 2])
    assert one(spark, arrays.gap_to(F.lit(11), 8), arrays.ceil_to(F.lit(17), 16), arrays.ceil_to(F.lit(32), 16)) == (5, 32, 32)
    lp = F.create_map(F.lit(1), F.lit(-1.0), F.lit(2), F.lit(-0.5), F.lit(3), F.lit(-2.0))
    two = F.array(F.lit(1), F.lit(3))
    assert one(spark, arrays.best_logprob(lp, two), arrays.best_logprob(arrays.top_k(lp, 1), two)) == (-1.0, None)
    missing = F.array(F.lit(-1.0), F.lit(None).cast("double"), F.lit(-2.0))
    assert one(spark, arrays.sequence_logprob(missing), arrays.argmax(F.array(F.lit(1.0), F.lit(5.0), F.lit(5.0)))) == (None, 1)
    assert one(spark, *[arrays.finite(F.lit(x)) for x in (1.0, float("nan"), float("inf"))], arrays.finite(F.lit(None).cast("double"))) == (True, False, False, False)
    spans = one(spark, arrays.block_causal(F.array(F.lit(2), F.lit(1))))[0]
    assert [tuple(x) for x in spans] == [(0, 0), (0, 1), (2, 2)]
