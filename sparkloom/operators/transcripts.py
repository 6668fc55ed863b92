"""Transcripts of sampled reasoning: text files to one row per sample."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.text import strip


def samples(files: DataFrame, value: str = "value", file: str = "file") -> DataFrame:
    """(file, prompt_no, label, sample_idx, response) of whole transcript texts."""
    # The headings of a transcript.
    prompts = F.regexp_extract_all(F.col(value), F.lit(r"(?s)(?:^|\n)(Prompt \d+:.*?)(?=\nPrompt \d+:|$)"), F.lit(1))
    parts = files.select(file, F.posexplode(prompts).alias("prompt_no", "body"))
    label = F.regexp_extract("body", r"GT lable: (\d+)", 1).cast("int")
    blocks = F.regexp_extract_all(F.col("body"), F.lit(r"(?s)\nReasoning \d+:(.*?)\n\nGT lable \d+: "), F.lit(1))
    return parts.select(file, "prompt_no", label.alias("label"), F.posexplode(blocks).alias("sample_idx", "text")).select(
        file, "prompt_no", "label", "sample_idx", strip(F.col("text")).alias("response")
    )
