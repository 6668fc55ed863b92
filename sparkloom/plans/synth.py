"""Model outputs for the test tables, made from md5 of their keys, as Spark plans and as the same SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Response texts that a sample may be.
TEXTS = (
    "Answer: (A)", "Answer: (B)", "the answer is B", "Answer: A", "Final:\n(B)", "I cannot tell", "Answer: (B) since Aromatic",
    "reason \\boxed{A}", "Answer: (A) then final ANSWER: (B)", "Answer: yes", "x \\text{B} y", "Answer: neither",
)
SAMPLES = 16


def number(key):
    """The first eight hexadecimal digits of md5 as a number."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint")


def responses(labels: DataFrame, documents: DataFrame) -> DataFrame:
    """(item_id, lang, source, label, sample_idx, response), 16 a labelled document."""
    items = labels.join(documents.select("doc_id", "lang", "source"), "doc_id").select(
        F.col("doc_id").alias("item_id"), "lang", "source", F.col("quality").alias("label")
    )
    rows = items.withColumn("sample_idx", F.explode(F.sequence(F.lit(0), F.lit(SAMPLES - 1))))
    at = number(F.concat(F.col("item_id").cast("string"), F.lit("/"), F.col("sample_idx").cast("string"))) % len(TEXTS)
    return rows.withColumn("response", F.element_at(F.array(*[F.lit(t) for t in TEXTS]), (at + 1).cast("int")))


def _quoted(t: str) -> str:
    return "'" + t.replace("'", "''") + "'"


RESPONSES = f"""items AS (
  SELECT l.doc_id AS item_id, d.lang, d.source, l.quality AS label FROM labels l JOIN documents d ON d.doc_id = l.doc_id
), responses AS (
  SELECT *, [{", ".join(_quoted(t) for t in TEXTS)}][(('0x' || substr(md5(item_id || '/' || sample_idx), 1, 8))::BIGINT % {len(TEXTS)} + 1)::INT] AS response
  FROM (SELECT *, unnest(range({SAMPLES})) AS sample_idx FROM items)
)"""

TAIL = r"""tails AS (
  SELECT *, trim(response, chr(9) || chr(10) || chr(13) || ' ') AS text FROM responses
), parsed AS (
  SELECT *, (contains(text, 'Answer:') OR contains(text, 'answer is')) AS ok,
    trim(CASE WHEN contains(text, 'Answer:') THEN regexp_extract(text, '(?si)^.*answer:(.*)$', 1)
         WHEN contains(text, 'answer is') THEN regexp_extract(text, '(?si)^.*answer is(.*)$', 1) ELSE text END, chr(9) || chr(10) || chr(13) || ' ') AS tail
  FROM tails
)"""

_LOOSE = r"""CASE WHEN contains(tail, '\boxed{A}') OR contains(tail, '\text{A}') OR contains(tail, chr(10) || '(A)') THEN 0
  WHEN contains(tail, '\boxed{B}') OR contains(tail, '\text{B}') OR contains(tail, chr(10) || '(B)') THEN 1 END"""
DIALECT = {
    "afirst": f"CASE WHEN ok THEN CASE WHEN contains(tail, 'A') THEN 0 WHEN contains(tail, 'B') THEN 1 END ELSE {_LOOSE} END",
    "think": rf"CASE WHEN ok THEN CASE WHEN contains(tail, 'A)') OR contains(tail, 'A**') OR contains(tail, '\boxed{{A}}') OR contains(tail, '\text{{A}}') THEN 0 WHEN contains(tail, 'B') THEN 1 WHEN contains(tail, 'A') THEN 0 END ELSE {_LOOSE} END",
    "direct": "CASE WHEN contains(tail, '(A)') THEN 0 WHEN contains(tail, '(B)') OR contains(tail, 'Yes') OR contains(tail, 'yes') OR contains(tail, 'B') THEN 1 WHEN contains(tail, 'A') THEN 0 END",
    "f1": "CASE WHEN regexp_matches(text, '(?i)answer:') THEN CASE WHEN contains(regexp_extract(text, '(?si)^.*answer:(.*)$', 1), '(A)') THEN 0 WHEN contains(regexp_extract(text, '(?si)^.*answer:(.*)$', 1), '(B)') THEN 1 END END",
}
VOTED = f"""WITH {RESPONSES}, {TAIL}, preds AS (SELECT *, {DIALECT["afirst"]} AS pred FROM parsed), voted AS (
  SELECT item_id, lang, source, label, count(*) FILTER (WHERE pred = 0) AS cnt_a, count(*) FILTER (WHERE pred = 1) AS cnt_b,
    count(*) FILTER (WHERE pred IS NULL) AS cnt_none FROM preds GROUP BY ALL
), scored AS (
  SELECT *, CASE WHEN cnt_a + cnt_b > 0 THEN cnt_b::DOUBLE / (cnt_a + cnt_b) END AS p FROM voted
)"""


def auroc_sql(source: str, score: str, by: str = "", label: str = "label") -> str:
    """SQL of (by, n_pos, n_neg, auroc) over a relation."""
    key, part = (f"{by}, ", f"PARTITION BY {by} ") if by else ("", "")
    return f"""SELECT {key}sum(p)::BIGINT AS n_pos, sum(n)::BIGINT AS n_neg,
  CASE WHEN sum(p) > 0 AND sum(n) > 0 THEN sum(p * (under + n / 2::DOUBLE)) / (sum(p) * sum(n)) END AS auroc
FROM (SELECT {key}p, n, coalesce(sum(n) OVER ({part}ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS under
  FROM (SELECT {key}{score} AS s, (count(*) FILTER (WHERE {label} = 1))::DOUBLE AS p, (count(*) FILTER (WHERE {label} = 0))::DOUBLE AS n
    FROM {source} WHERE {score} IS NOT NULL GROUP BY {key}{score})) {"GROUP BY " + by if by else ""}"""
