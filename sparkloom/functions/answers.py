"""Answers out of model responses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkloom.functions.text import strip

DIALECTS = ("afirst", "think", "direct", "f1")


def tail(response: Column) -> tuple[Column, Column]:
    """(text after the last marker, whether a marker was found); without one the whole response."""
    text = strip(response)
    gate_a, gate_b = text.contains("Answer:"), text.contains("answer is")
    found = F.when(gate_a, F.regexp_extract(text, r"(?sui)^.*answer:(.*)$", 1)).when(
        gate_b, F.regexp_extract(text, r"(?sui)^.*answer is(.*)$", 1)
    )
    return F.coalesce(strip(found), text), gate_a | gate_b


def _any(text: Column, *marks: str) -> Column:
    hit = F.lit(False)
    for m in marks:
        hit = hit | text.contains(m)
    return hit


def parse(text: Column, well_formed: Column, dialect: str = "afirst") -> Column:
    """0 for (A), 1 for (B), null if neither is told, under one of the dialects."""
    loose = F.when(_any(text, r"\boxed{A}", r"\text{A}", "\n(A)"), 0).when(_any(text, r"\boxed{B}", r"\text{B}", "\n(B)"), 1)
    if dialect == "afirst":
        return F.when(well_formed, F.when(text.contains("A"), 0).when(text.contains("B"), 1)).otherwise(loose)
    if dialect == "think":
        strict = F.when(_any(text, "A)", "A**", r"\boxed{A}", r"\text{A}"), 0).when(text.contains("B"), 1).when(text.contains("A"), 0)
        return F.when(well_formed, strict).otherwise(loose)
    if dialect == "direct":
        return F.when(text.contains("(A)"), 0).when(_any(text, "(B)", "Yes", "yes", "B"), 1).when(text.contains("A"), 0)
    raise ValueError(f"unknown dialect: {dialect}")


def answer(response: Column, dialect: str = "afirst") -> Column:
    """The parsed answer of a response; the f1 dialect has its own marker rule."""
    if dialect == "f1":
        text = strip(response)
        after = F.when(text.rlike(r"(?ui)answer:"), F.regexp_extract(text, r"(?sui)^.*answer:(.*)$", 1))
        return F.when(after.contains("(A)"), 0).when(after.contains("(B)"), 1)
    return parse(*tail(response), dialect)
