"""Language identification by hierarchical discrimination.

A text is counted into hashed byte n-grams of its letters. A multinomial model over those counts picks the language
family; inside the family, one-versus-one linear support vector machines vote for the language. The models are fitted on
the driver from a bounded sample of labelled rows (`per_language` rows of each language, taken in hash order) and are of
fixed size; prediction reads every whole text once, with no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm._text import slices
from sparkloom.llm.components import trimmed

#: Related languages; a language that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("de", "en", "nl", "da", "sv", "no", "is"),
    "romance": ("es", "fr", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "pl", "cs", "uk", "bg", "sr", "hr", "sk", "sl"),
}
DIM = 4096
ORDERS = (1, 2, 3)

_CLASS = np.zeros(256, dtype=np.int64)  # letters keep their byte, all else is one separator
_CLASS[97:123] = np.arange(97, 123)
_CLASS[65:91] = np.arange(97, 123)
_CLASS[128:] = np.arange(128, 256)


def ngram_counts(column: pa.Array, block: int = 256, piece: int = 1 << 20):
    """Yield (first row, counts) over blocks of rows; counts has a row of DIM hashed n-gram counts for each text.

    A block is counted `piece` bytes at a time, so a long text takes no more memory than a short one besides itself.
    """
    for first, last, buf, offs in slices(column):
        for a in range(0, last - first, block):
            b = min(a + block, last - first)
            cut = offs[a : b + 1] - offs[a]
            out = np.zeros((b - a) * DIM)
            for start in range(0, int(cut[-1]), piece):
                end = min(start + piece, int(cut[-1]))
                more = min(end + max(ORDERS) - 1, int(cut[-1]))
                letters = _CLASS[buf[offs[a] + start : offs[a] + more]]
                rows = np.searchsorted(cut, np.arange(start, more), "right") - 1
                for n in ORDERS:
                    m = min(end - start, len(letters) - n + 1)
                    if m <= 0:
                        continue
                    code = np.zeros(m, dtype=np.int64)
                    for j in range(n):
                        code = code * 257 + letters[j : j + m]
                    use = (rows[:m] == rows[n - 1 : n - 1 + m]) & (letters[n // 2 : n // 2 + m] > 0)
                    at = ((code[use] * 0x9E3779B1 + n * 0x85EBCA6B) >> 7) % DIM
                    out += np.bincount(rows[:m][use] * DIM + at, minlength=len(out))
            yield first + a, out.reshape(b - a, DIM)


def _unit(counts: np.ndarray) -> np.ndarray:
    x = np.sqrt(counts)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def linear_svm(x: np.ndarray, y: np.ndarray, l2: float = 1e-4, steps: int = 300) -> np.ndarray:
    """Weights (the last is the bias) of a squared-hinge linear SVM, by accelerated gradient descent; y is -1 or 1."""
    x = np.hstack([x, np.ones((len(x), 1), dtype=x.dtype)])
    w = z = np.zeros(x.shape[1], dtype=x.dtype)
    rate = 1.0 / (l2 + 4.0)
    for t in range(steps):
        gap = np.maximum(0.0, 1.0 - y * (x @ z))
        new = z - rate * (l2 * z - 2.0 * (x.T @ (y * gap)) / len(y))
        z, w = (new + (t / (t + 3.0)) * (new - w)).astype(x.dtype), new
    return w


@dataclass
class Model:
    families: list[list[str]] = field(default_factory=list)
    family_log: np.ndarray | None = None  # DIM x families
    pairs: dict[tuple[str, str], np.ndarray] = field(default_factory=dict)

    def predict(self, counts: np.ndarray) -> tuple[list[str], np.ndarray]:
        n = len(counts)
        total = np.maximum(counts.sum(1, keepdims=True), 1.0)
        logit = 40.0 * (counts @ self.family_log) / total
        logit -= logit.max(1, keepdims=True)
        p = np.exp(logit)
        p /= p.sum(1, keepdims=True)
        pick = p.argmax(1)
        lang, score, x = np.empty(n, dtype=object), np.zeros(n), _unit(counts)
        for f, langs in enumerate(self.families):
            at = np.flatnonzero(pick == f)
            if not len(at):
                continue
            votes, sure = np.zeros((len(at), len(langs))), np.ones((len(at), len(langs)))
            for i, a in enumerate(langs):
                for j in range(i + 1, len(langs)):
                    w = self.pairs[a, langs[j]]
                    q = 1.0 / (1.0 + np.exp(-np.clip(4.0 * (x[at] @ w[:-1] + w[-1]), -30, 30)))
                    votes[:, i] += (q >= 0.5) + q * 1e-3
                    votes[:, j] += (q < 0.5) + (1 - q) * 1e-3
                    sure[:, i] = np.minimum(sure[:, i], q)
                    sure[:, j] = np.minimum(sure[:, j], 1 - q)
            best = votes.argmax(1)
            lang[at] = [langs[k] for k in best]
            score[at] = p[at, f] * sure[np.arange(len(at)), best]
        return list(lang), score


def fit(labels: list[str], counts: np.ndarray) -> Model:
    """A model from rows of n-gram counts and their languages."""
    langs = sorted(set(labels))
    if not langs:
        return Model()
    of = {x: np.array([y == x for y in labels]) for x in langs}
    home = {x: f for f, members in FAMILIES.items() for x in members}
    groups: dict[str, list[str]] = {}
    for x in langs:
        groups.setdefault(home.get(x, f"only {x}"), []).append(x)
    families = [groups[k] for k in sorted(groups)]
    log = np.zeros((DIM, len(families)))
    for f, members in enumerate(families):
        mass = sum((counts[of[x]] / np.maximum(counts[of[x]].sum(1, keepdims=True), 1)).mean(0) for x in members) / len(members)
        log[:, f] = np.log(mass + 1e-6)
    pairs = {}
    for members in families:
        for i, a in enumerate(members):
            for b in members[i + 1 :]:
                both = of[a] | of[b]
                pairs[a, b] = linear_svm(_unit(counts[both]), np.where(of[a][both], 1.0, -1.0).astype(np.float32)).astype(np.float64)
    return Model(families, log, pairs)


def train(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 200) -> Model:
    """Fit on at most `per_language` rows of each language among the rows where `learn` holds and lang is known.

    The rows are the first in the order of a hash of the id, so reruns agree; of repeated rows of an id one teaches, that
    with the least hash, so the bound holds for rows. Only n-gram counts come to the driver (DIM numbers a row). Rows
    without an id, a text or a language teach nothing, and without any row nothing is learned.
    """
    known = docs.filter(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")
    )
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    chosen = known.filter("doc_id is not null").select("doc_id", "lang").distinct().withColumn("place", place).filter(F.col("place") <= per_language).drop("place")

    def count(batches):
        for batch in batches:
            for first, counts in ngram_counts(batch.column(1)):
                packed = pa.array([x.tobytes() for x in counts.astype(np.float32)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(counts)), packed], names=["lang", "counts"])

    picked = known.join(F.broadcast(chosen), ["doc_id", "lang"], "left_semi")
    picked = picked.groupBy("doc_id", "lang").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).select("lang", "text")
    found = picked.mapInArrow(count, "lang string, counts binary").toArrow().sort_by([("lang", "ascending"), ("counts", "ascending")])
    langs = found["lang"].to_pylist()
    return fit(langs, np.frombuffer(b"".join(found["counts"].to_pylist()), dtype=np.float32).reshape(len(langs), DIM))


def identify(docs: DataFrame, model: Model, text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "score", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (all) of `docs` with the predicted language and a score from 0 to 1.

    A null text and one without a letter get `und` and 0; so does every text if no language was learned. Columns that
    already have the names of the two new ones are replaced. Repeated rows stay; an empty table gives an empty one.
    """
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in (pred_col.lower(), score_col.lower())]
    has = F.coalesce(F.col(f"`{text_col}`").rlike(r"\p{L}"), F.lit(False)).alias("__has")
    text_at, has_at = len(kept), len(kept) + 1
    narrow = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text_col}`").alias("__text"), has)
    schema = ", ".join(
        [f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields[:text_at]] + [f"`{pred_col}` string", f"`{score_col}` double"]
    )

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            lang, score = ["und"] * batch.num_rows, np.zeros(batch.num_rows)
            if model.families:
                letters = batch.column(has_at).to_numpy(zero_copy_only=False)
                for first, counts in ngram_counts(batch.column(text_at)):
                    got, sure = model.predict(counts)
                    for i, x in enumerate(got):
                        if letters[first + i]:
                            lang[first + i], score[first + i] = x, sure[i]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:text_at], pa.array(lang, pa.string()), pa.array(np.clip(score, 0, 1))], names=[*kept, pred_col, score_col]
            )

    return narrow.mapInArrow(trimmed(run), schema)


def held_out(id_col: str = "doc_id", mod: int = 3, fold: int = 1) -> Column:
    """Whether crc32 of the id as text leaves the remainder `fold`; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % mod == fold, F.lit(False))
