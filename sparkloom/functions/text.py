"""String expressions for prompts and records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
# What stands in for "Answer:" when reasoning is asked for.
STEPS = 'Please think step by step and then put ONLY your final choice ((A) or (B)) after "Answer:"'
EXAMPLES = "Here are some structured reasoning examples for your reference: {}.\n Please follow the structured reasoning examples to think step by step and then put ONLY your final choice ((A) or (B)) after \"Answer:\""
STEPS_SHORT = 'Please think step by step and then put your final choice after "Answer:"'


def strip(text: Column) -> Column:
    """Without Unicode white space at both ends (trim removes spaces only)."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def put(text: Column, mark: str, value: Column | str) -> Column:
    """Every literal occurrence of `mark` replaced."""
    return F.replace(text, F.lit(mark), F.lit(value) if isinstance(value, str) else value)


def wrap(value: Column, tag: str | None) -> Column:
    return value if tag is None else F.concat(F.lit(f"<{tag}>"), value, F.lit(f"</{tag}>"))


def fill(template: Column, values: dict[str, tuple[Column, str | None]], auto_fasta: bool = False) -> Column:
    """A template with each placeholder replaced by its wrapped value."""
    for mark, (value, tag) in values.items():
        template = put(template, mark, wrap(value, "FASTA_AUTO_DETECT" if auto_fasta and tag == "FASTA" else tag))
    return template


def before(text: Column, mark: str) -> Column:
    return F.split_part(text, F.lit(mark), F.lit(1))


def after_last(text: Column, mark: str) -> Column:
    return F.substring_index(text, mark, -1)


def ask_for_steps(prompt: Column, words: str = STEPS) -> Column:
    return put(prompt, "Answer:", words)


def ask_with_examples(prompt: Column, examples: list[str]) -> Column:
    """Few-shot form of `ask_for_steps`."""
    shown = "\n".join(f"\nexample{i}:\n{x}" for i, x in enumerate(examples, 1))
    return put(prompt, "Answer:", EXAMPLES.format(shown))


def choice(label: Column) -> Column:
    """(B) for 1 and (A) for 0; any other label ends the job."""
    bad = F.raise_error(F.concat(F.lit("label is not 0 or 1: "), F.coalesce(label.cast("string"), F.lit("null"))))
    return F.when(label == 1, F.lit("(B)")).when(label == 0, F.lit("(A)")).otherwise(bad)


def user_text(instruction: Column, extra: Column) -> Column:
    return strip(F.concat(instruction, F.when(F.length(F.coalesce(extra, F.lit(""))) > 0, F.concat(F.lit("\n"), extra)).otherwise("")))


def message(role: Column | str, text: Column) -> Column:
    return F.concat(F.lit(START), F.lit(role) if isinstance(role, str) else role, F.lit("\n"), text, F.lit(END + "\n"))


def generation_prompt(thinking: bool = False) -> Column:
    return F.lit(f"{START}assistant\n" + ("" if thinking else "<think>\n\n</think>\n"))


def render_chat(messages: Column) -> Column:
    """Chat markup of an array of (turn, role, text), in the order of turns."""
    return F.array_join(F.transform(F.sort_array(messages), lambda m: message(m["role"], m["text"])), "")


def split_reply(rendered: Column, mark: str = "assistant", strict: bool = False) -> tuple[Column, Column]:
    """(input, output) of a rendered chat, cut at the first two occurrences of `mark`; strict cuts at the turn's start."""
    cut = f"{START}assistant" if strict else mark
    return F.concat(F.split_part(rendered, F.lit(cut), F.lit(1)), F.lit(cut)), F.split_part(rendered, F.lit(cut), F.lit(2))


def think(cot: Column, answer: Column) -> Column:
    return F.concat(F.lit("<think>\n"), cot, F.lit("\n</think>\n"), answer)


def clip(text: Column, n: int, always: bool = False) -> Column:
    """The first n characters, with an ellipsis if that cuts something (or always)."""
    short = F.concat(F.substring(text, 1, n), F.lit("..."))
    return short if always else F.when(F.length(text) > n, short).otherwise(text)


def quoted(value: Column) -> Column:
    """A string as a literal: in single quotes, or in double ones if it holds only single ones."""
    plain = value
    for mark, shown in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        plain = F.replace(plain, F.lit(mark), F.lit(shown))
    return F.when(F.contains(value, F.lit("'")) & ~F.contains(value, F.lit('"')), F.concat(F.lit('"'), plain, F.lit('"'))).otherwise(
        F.concat(F.lit("'"), F.replace(plain, F.lit("'"), F.lit("\\'")), F.lit("'"))
    )


def literal_text(json: Column) -> Column:
    """A JSON value as a literal: None, True, False, quoted strings, and blanks behind the commas and colons of lists and objects."""
    tokens = F.regexp_extract_all(json, F.lit(r'"(?:[^"\\]|\\.)*"|[-+.0-9eE]+|[a-z]+|[\[\]{},:]'), F.lit(0))
    # How constants and separators of JSON are shown.
    named = {"null": "None", "true": "True", "false": "False", ",": ", ", ":": ": "}

    def shown(t: Column) -> Column:
        out = F.when(t.startswith('"'), quoted(F.get(F.from_json(F.concat(F.lit("["), t, F.lit("]")), "array<string>"), 0)))
        for name, value in named.items():
            out = out.when(t == name, F.lit(value))
        return out.otherwise(t)

    return F.array_join(F.transform(tokens, shown), "")


def fields(json: Column) -> Column:
    """(key, value) of the fields of a JSON object in their order, values as text: strings as they are, all else as literals."""
    entries = F.map_entries(F.from_json(json, "map<string,variant>"))
    value = lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")).otherwise(literal_text(F.to_json(v)))
    return F.transform(entries, lambda e: F.struct(e["key"].alias("key"), F.coalesce(value(e["value"]), F.lit("None")).alias("value")))


def field(json: Column, name: str) -> Column:
    """The value of one field as text, null if there is none."""
    return F.get(F.filter(fields(json), lambda e: e["key"] == name), 0)["value"]


def ordered_fields(json: Column) -> Column:
    """The fields of a JSON object as key:\nvalue, joined by line feeds in their order; null if it isn't an object."""
    return F.array_join(F.transform(fields(json), lambda e: F.concat(e["key"], F.lit(":\n"), e["value"])), "\n")


def pair(literal: Column) -> Column:
    """The strings of a list written as text, in single or double quotes, with escaped characters."""
    items = F.regexp_extract_all(literal, F.lit(r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*\""""), F.lit(0))
    return F.transform(items, lambda x: F.regexp_replace(F.substring(x, F.lit(2), F.length(x) - 2), r"\\(.)", "$1"))


def scale_1000(y: Column, low: Column, high: Column) -> Column:
    """Min-max scaling to 0..1000, halves to even; a constant column is 0."""
    scaled = F.rint((y - low) / (high - low) * F.lit(1000.0))
    return F.when(low == high, F.lit(0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1000.0), scaled)).cast("int"))


def three_digits(n: Column) -> Column:
    return F.format_string("%03d", n)


def stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd_HHmmss")
