"""Line-first quality rules, in built-in SQL functions only.

Every line with a word is held against punctuation, navigation, symbol, shouting and boilerplate rules and against the
lines before it; failing lines go, and a document that loses too much of its text is rejected. The document-level base
counts (symbols, duplicate lines, words inside repeated 8-word windows) come from the same single pass. Nothing is
shuffled: each document is judged on its own whole text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\x0c\r"
SYMBOL_CLASS = "#*$%&|<>"
#: Phrases of lines that belong to a site or a licence rather than to a text.
BOILERPLATE = (
    "all rights reserved",
    "cookie policy",
    "privacy policy",
    "terms of service",
    "terms of use",
    "click here",
    "javascript is disabled",
    "enable javascript",
    "subscribe to our newsletter",
    "licensed under the",
    "sign in to continue",
)
#: Marks that end a sentence, and what may follow them.
ENDS = ".!?\u2026\u3002\uff01\uff1f"
CLOSERS = "\"'\u201d\u2019\u00bb)]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` over `value`, which is evaluated once however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def only(text: Column, chars: str) -> Column:
    """How many characters of a text are among `chars`; one pass over long runs of others."""
    return F.length(F.regexp_replace(text, f"[^{chars}]+", ""))


def words_of(text: Column) -> Column:
    """The words of a text: runs without space, tab, line feed, vertical tab, form feed and carriage return."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[ \t-\r]+"), lambda w: w != "")


def repeated_words(words: Column, window: int = 8) -> Column:
    """How many words lie in windows of `window` words that occur twice or more in `words`, the first one included."""

    def covered(starts: Column) -> Column:
        steps = F.transform(
            starts, lambda p, i: F.least(F.lit(window), F.coalesce(F.get(starts, i + 1), p + window) - p)
        )
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    def again(grams: Column) -> Column:
        same = F.filter(
            grams,
            lambda g, i: ((i > 0) & (F.get(grams, i - 1)["h"] == g["h"])) | F.coalesce(F.get(grams, i + 1)["h"] == g["h"], F.lit(False)),
        )
        return let(F.sort_array(F.transform(same, lambda g: g["p"])), covered)

    def placed(hashes: Column) -> Column:
        # Most texts repeat nothing: only the others are sorted.
        grams = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(let(grams, again))

    def inside(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(1), F.size(w) - (window - 1)), lambda i: F.xxhash64(F.slice(w, i, window)))
        return F.when(F.size(w) < window, F.lit(0).cast("long")).otherwise(let(hashes, placed))

    return let(words, inside)


def line_fails(line: Column, boilerplate: tuple[str, ...] = BOILERPLATE) -> Column:
    """Whether a trimmed line breaks a punctuation, navigation, symbol, shouting or boilerplate rule."""
    size = F.length(line)
    last = F.right(F.rtrim(line, F.lit(CLOSERS + SPACE)), F.lit(1))
    bars = size - F.length(F.replace(line, F.lit("|"), F.lit("")))
    phrase = F.lit(False)
    for x in boilerplate:
        phrase = phrase | F.lower(line).contains(x)
    return (
        (last == "")
        | ~F.lit(ENDS).contains(last)
        | ((bars >= 3) & (bars * 25 > size))
        | (only(line, SYMBOL_CLASS) * 12 > size)
        | (F.length(F.regexp_replace(line, r"[^\p{Lu}]+", "")) * 5 > size * 2)
        | phrase
    )


def clean_lines(lines: Column, boilerplate: tuple[str, ...] = BOILERPLATE) -> Column:
    """The lines that pass every rule, trimmed; of equal lines the first."""
    return F.filter(F.array_distinct(lines), lambda x: ~line_fails(x, boilerplate))


def quality(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_lost: float = 0.5,
    boilerplate: tuple[str, ...] = BOILERPLATE,
    with_text: bool = False,
) -> DataFrame:
    """One row per input row: id, base counts, base_failed, the characters of the trimmed lines, those of
    the lines left after cleaning, and kept.

    kept is false if base_failed (n_words < 20, or over 30% of the words in repeated 8-word windows) or if the removed
    lines hold more than `max_lost` of the lines' characters. Null and empty texts have counts of 0 and fail. With
    `with_text` the cleaned text (the passing lines, joined by line feeds) follows. Repeated rows and null ids stay.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    total = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, y: a + F.length(y))
    of_words = lambda w: F.struct(
        F.size(w).cast("long").alias("n"), F.length(F.array_join(w, "")).cast("long").alias("chars"), repeated_words(w).alias("r")
    )
    of_trimmed = lambda x, dup: let(
        clean_lines(x, boilerplate), lambda c: F.struct(dup.alias("dup"), total(x).alias("all"), total(c).alias("left"), c.alias("clean"))
    )
    of_lines = lambda x: let(
        F.transform(x, lambda y: F.btrim(y, F.lit(SPACE))), lambda y: of_trimmed(y, (F.size(x) - F.size(F.array_distinct(x))).cast("long"))
    )
    counted = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        let(words_of(text), of_words).alias("w"),
        only(text, SYMBOL_CLASS).cast("long").alias("n_symbols"),
        let(lines, of_lines).alias("l"),
    )
    out = counted.select(
        "doc_id",
        F.col("w.n").alias("n_words"),
        F.col("w.chars").alias("word_chars"),
        "n_symbols",
        F.col("l.dup").alias("n_dup_lines"),
        F.col("w.r").alias("n_repeat_words"),
        ((F.col("w.n") < 20) | (100 * F.col("w.r") > 30 * F.col("w.n"))).alias("base_failed"),
        F.col("l.all").alias("line_chars"),
        F.col("l.left").alias("kept_chars"),
        *([F.array_join("l.clean", "\n").alias("clean_text")] if with_text else []),
    )
    enough = F.col("line_chars") - F.col("kept_chars") <= F.lit(float(max_lost)) * F.col("line_chars")
    return out.withColumn("kept", ~F.col("base_failed") & enough)


ORACLE = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d
), g AS (
  SELECT rid, i, list_slice(ws, i, i + 7) AS gram
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)
), again AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS c FROM g) WHERE c > 1
), cover AS (
  SELECT rid, sum(least(8, coalesce(nxt, i + 8) - i)) AS r
  FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM again) GROUP BY rid
), ln AS (
  SELECT rid, line, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS t
  FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d)
), dups AS (
  SELECT rid, count(*) - count(DISTINCT line) AS dup, sum(length(t)) AS line_chars FROM ln WHERE t <> '' GROUP BY rid
), uq AS (
  SELECT DISTINCT rid, t FROM ln WHERE t <> ''
), fails AS (
  SELECT rid, t,
    NOT regexp_matches(t, '[.!?\x{{2026}}\x{{3002}}\x{{ff01}}\x{{ff1f}}]["''\x{{201d}}\x{{2019}}\x{{bb}})\]\x20\x09-\x0D]*$')
    OR (length(t) - length(replace(t, '|', '')) >= 3 AND (length(t) - length(replace(t, '|', ''))) * 25 > length(t))
    OR (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g'))) * 12 > length(t)
    OR length(regexp_replace(t, '[^\p{{Lu}}]+', '', 'g')) * 5 > length(t) * 2
    OR regexp_matches(lower(t), '{"|".join(BOILERPLATE)}') AS bad
  FROM uq
), lost AS (
  SELECT rid, sum(length(t)) FILTER (WHERE NOT bad) AS kept_chars FROM fails GROUP BY rid
), base AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words,
    length(array_to_string(ws, ''))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(dup, 0)::BIGINT AS n_dup_lines, coalesce(r, 0)::BIGINT AS n_repeat_words,
    coalesce(line_chars, 0)::BIGINT AS line_chars, coalesce(kept_chars, 0)::BIGINT AS kept_chars
  FROM w LEFT JOIN cover USING (rid) LEFT JOIN dups USING (rid) LEFT JOIN lost USING (rid)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed, line_chars, kept_chars,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND (line_chars - kept_chars) <= 0.5 * line_chars AS kept
FROM base
"""
