"""Instruction-tuning records: template rendering, chat rendering, reasoning answers, tokens with answer-only labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import arrays, text

# The answer's name in each reasoning file, and the field that holds it; "" is a plain answer.
COT_ANSWERS = {
    "add.json": ("", "reference"), "delete.json": ("", "reference"), "sub.json": ("", "reference"),
    "drd.json": ("Final Target Molecule", "reference"), "gsk.json": ("Final Target Molecule", "reference"), "jnk.json": ("Final Target Molecule", "reference"),
    "logp.json": ("Final Target Molecule", "reference"), "qed.json": ("Final Target Molecule", "reference"), "solubility.json": ("Final Target Molecule", "reference"),
    "fg_count.json": ("count", "gt"), "ring_count.json": ("count", "gt"), "fs_by_product.json": ("By Product", "gt"), "fs_major_product.json": ("Major Product", "gt"),
    "Murcko_scaffold.json": ("Output Scaffold", "gt"), "ring_system_scaffold.json": ("output", "output"),
}


def with_templates(rows: DataFrame, templates: DataFrame, key: str = "prompt_key", strict: bool = True) -> DataFrame:
    """Rows with the `template` of their key; strict raises for a key without one."""
    joined = rows.join(F.broadcast(templates.select(key, "template")), key, "left")
    if strict:
        missing = F.raise_error(F.concat(F.lit("no template for "), F.coalesce(F.col(key), F.lit("null"))))
        joined = joined.withColumn("template", F.coalesce(F.col("template"), missing.cast("string")))
    return joined


def alpaca(prompt: Column, label: Column) -> list[Column]:
    return [prompt.alias("instruction"), F.lit("").alias("input"), text.choice(label).alias("output")]


def gpt(prompt: Column, reply: Column, thinking: bool = False, strict: bool = False) -> list[Column]:
    """(input, output) of the rendered two-turn chat."""
    body = reply if thinking else F.concat(F.lit("<think>\n\n</think>\n"), reply)
    source, target = text.split_reply(F.concat(text.message("user", prompt), text.message("assistant", body)), strict=strict)
    return [source.alias("input"), target.alias("output")]


def cot_answer(file: Column, struct_cot: Column, meta: Column) -> Column:
    """The reasoning block and the answer in its file's form; null for bad reasoning JSON, an error for unknown files."""
    cot = text.ordered_fields(struct_cot)
    out = None
    for name, (title, field) in COT_ANSWERS.items():
        value = text.field(struct_cot if field == "output" else meta, field)
        shown = F.concat(F.lit("Answer: "), value) if not title else F.concat(F.lit(f"Answer: \n{{\n    ‘{title}’: "), value, F.lit(",\n}"))
        out = (F if out is None else out).when(file == name, text.think(cot, shown))
    return F.when(cot.isNotNull(), out.otherwise(F.raise_error(F.concat(F.lit("unknown file "), file)).cast("string")))


def tokens_and_labels(records: DataFrame, instruction: str = "instruction", extra: str = "input", output: str = "output", system: str | None = None, eos: int | None = None, most: int | None = None) -> DataFrame:
    """`records` with input_ids and labels: the prompt's ids are ignored, the reply's are kept.

    The reply is tokenized on its own, behind the prompt, as both together need not cut the same.
    """
    lead = F.lit("")
    if system:
        clean = text.strip(F.coalesce(F.col(system), F.lit("")))
        lead = F.when(clean != "", text.message("system", clean)).otherwise(F.lit(""))
    prompt = F.concat(lead, text.message("user", text.user_text(F.col(instruction), F.col(extra))), text.generation_prompt(True))
    reply = F.concat(F.col(output), F.lit(text.END + "\n"))
    out = records.withColumn("prompt_ids", arrays.token_ids(arrays.tokenize(prompt))).withColumn("reply_ids", arrays.token_ids(arrays.tokenize(reply)))
    ids = F.concat("prompt_ids", "reply_ids")
    out = out.withColumn("input_ids", arrays.append_eos(ids, eos) if eos is not None else ids)
    out = out.withColumn("labels", arrays.label_mask(F.col("input_ids"), F.size("prompt_ids")))
    return out.withColumn("input_ids", arrays.truncate(F.col("input_ids"), most)).withColumn("labels", arrays.truncate(F.col("labels"), most))


def pair_tokens(pairs: DataFrame, first: str = "sentence1", second: str = "sentence2", end: int = 2, most: int | None = None) -> DataFrame:
    """`pairs` with input_ids: both sentences, each closed by `end`, cut to `most`; the sentences themselves go."""
    ids = lambda c: F.concat(arrays.token_ids(arrays.tokenize(F.coalesce(c, F.lit("")))), F.array(F.lit(end)))
    return pairs.withColumn("input_ids", arrays.truncate(F.concat(ids(first), ids(second)), most)).drop(first, second)


def joined(df: DataFrame, prefix: str, mark: str = ".") -> Column:
    """The columns with a prefix as one text, nulls shown as nan."""
    return F.array_join(F.array(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("nan")) for c in columns_from(df, prefix)]), mark)


def pick_column(df: DataFrame, names: list[str], default=None) -> Column:
    """The first of `names` that `df` has, else the default."""
    return next((F.col(n) for n in names if n in df.columns), F.lit(default))


def columns_from(df: DataFrame, prefix: str) -> list[str]:
    return [c for c in df.columns if c.lower().startswith(prefix.lower())]
