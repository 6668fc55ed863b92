"""Reasoning records and prompts over values of every JSON type."""

import json

from pyspark.sql import functions as F

from sparkloom.functions import text
from sparkloom.operators import records

COTS = [
    {"a": None, "b": True, "c": [1, "x", None, False], "d": {"k": "v", "n": {"m": [0.5]}}},
    {"s": "true", "t": "[1, 2]", "u": "line\nbreak", "v": 12, "w": -3.25},
    {"q": ["it's", 'say "hi"', "both ' and \"", "back\\slash"], "output": "C1CC1"},
    {"one key": "", "é": "ü"},
]


def test_fields_are_shown_as_literals(spark):
    rows = spark.createDataFrame([(i, json.dumps(c, ensure_ascii=i % 2 == 0)) for i, c in enumerate(COTS)], "i int, cot string")
    got = {r.i: r.shown for r in rows.select("i", text.ordered_fields(F.col("cot")).alias("shown")).collect()}
    assert got == {i: "\n".join(f"{k}:\n{v}" for k, v in c.items()) for i, c in enumerate(COTS)}


def test_every_answer_form(spark):
    meta = {"reference": "CCO", "gt": ["A", 2, None]}
    cot = {"x": 1, "output": "c1ccccc1"}
    rows = [(name, json.dumps(cot), json.dumps(meta)) for name in records.COT_ANSWERS] + [("add.json", "not json", json.dumps(meta)), ("add.json", None, None)]
    got = [r.out for r in spark.createDataFrame(rows, "file string, cot string, meta string").coalesce(1).select(records.cot_answer(F.col("file"), F.col("cot"), F.col("meta")).alias("out")).collect()]
    for (name, (title, field)), out in zip(records.COT_ANSWERS.items(), got):
        value = {"reference": "CCO", "gt": "['A', 2, None]", "output": "c1ccccc1"}[field]
        answer = f"Answer: {value}" if not title else f"Answer: \n{{\n    ‘{title}’: {value},\n}}"
        assert out == f"<think>\nx:\n1\noutput:\nc1ccccc1\n</think>\n{answer}", name
    assert got[-2:] == [None, None]


def test_pairs_in_either_quotes(spark):
    literals = ["['AB', 'CD']", '["AB", "CD"]', """["it's", 'x']""", r"['a\'b', 'c']", "[]"]
    got = [r.p for r in spark.createDataFrame([(x,) for x in literals], "x string").coalesce(1).select(text.pair(F.col("x")).alias("p")).collect()]
    assert got == [["AB", "CD"], ["AB", "CD"], ["it's", "x"], ["a'b", "c"], []]
