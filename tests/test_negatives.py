"""Negative pairs where most pairs of a left value are positives."""

from sparkloom.operators import sampling


def test_one_left_value_has_nearly_all_positives(spark):
    known = {("A", i) for i in range(990)} | {(f"b{i}", 990 + i) for i in range(5)}
    rows = sampling.negatives(spark.createDataFrame(sorted(known), "a string, b int"), "a", "b").collect()
    no = [(r.a, r.b) for r in rows if r.label == 0]
    assert len(no) == len(set(no)) == 995 and not set(no) & known


def test_as_many_as_exist(spark):
    known = {(a, b) for a in range(6) for b in range(6)} - {(1, 2), (3, 3), (5, 0)}
    rows = sampling.negatives(spark.createDataFrame(sorted(known), "a int, b int"), "a", "b", per_positive=1).collect()
    assert {(r.a, r.b) for r in rows if r.label == 0} == {(1, 2), (3, 3), (5, 0)}
