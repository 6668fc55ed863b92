"""Toxicity by a lexicon that forgives misspelling, and by what stands around each hit.

The lexicon is a trie of whole terms and of stems. Levenshtein automata of the whole terms are intersected with the trie
and made deterministic, so one table walk per word finds terms within one edit (two for long ones); stems match as
beginnings of words. Hits inside quotation marks or beside words of reporting count as quoted, others as abuse. The
terms, the weight of each term with and without edits, and the final logistic score are learned on the driver from a
bounded sample of labelled rows: a misspelling that clean rows hold as well has no weight, and what a quotation says is
learned like the rest. The score is fitted to halves of the sample that the lexicon was not learned from. Scoring reads
every whole text once, long ones in pieces, and shuffles nothing.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.components import durable

#: Insults to start from; learning adds the terms and stems of the labelled rows.
LEXICON = ("idiot", "moron", "stupid", "scum", "trash", "loser", "worthless", "pathetic", "disgusting", "clown", "dumbass", "imbecile", "bastard", "asshole")
REPORTING = frozenset(
    "said says wrote writes quoted quote called calls term word phrase slur dit disait mot citation sagte schrieb wort zitat dijo escribió palabra cita".split()
)
OPEN, CLOSE = "\"“„«‘", "\"”“»’"
_CHUNK = 1 << 18


def _classes() -> np.ndarray:
    """For each code point whether it is part of a word: letters, marks and digits."""
    out = np.zeros(0x110000, dtype=bool)
    for c in range(0x3000):
        out[c] = unicodedata.category(chr(c))[0] in "LMN"
    out[0x3000:] = True
    out[0xFF00:0xFFFF] = False
    return out


@dataclass
class Automaton:
    letters: str
    table: np.ndarray  # state x letter class (0: any other); the last state is dead
    entry: np.ndarray  # the lexicon entry that ends in a state, or -1
    edits: np.ndarray  # with how many edits
    open: np.ndarray  # whether the word may go on (a stem matched)


def edits_allowed(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 8 else 2


def build(entries: list[tuple[str, bool]], base: frozenset[str] = frozenset(LEXICON)) -> Automaton:
    """The deterministic product of the trie of (term, is_stem) entries with their Levenshtein automata.

    Only terms of `base` have two edits; the others, of which there are many more, have one.
    """
    allowed = lambda term: min(edits_allowed(term), 2 if term in base else 1)
    children: list[dict[str, int]] = [{}]
    ends: list[int] = [-1]
    most: list[int] = [0]
    for i, (term, stem) in enumerate(entries):
        u, d = 0, 0 if stem else allowed(term)
        most[0] = max(most[0], d)
        for c in term:
            if c not in children[u]:
                children[u][c] = len(children)
                children.append({})
                ends.append(-1)
                most.append(0)
            u = children[u][c]
            most[u] = max(most[u], d)
        if ends[u] < 0 or entries[ends[u]][1]:
            ends[u] = i
    letters = "".join(sorted({c for t, _ in entries for c in t}))

    def close(states: dict[int, int]) -> frozenset:
        todo = list(states.items())
        while todo:
            u, e = todo.pop()
            for v in children[u].values():
                if e + 1 <= most[v] and states.get(v, 99) > e + 1:
                    states[v] = e + 1
                    todo.append((v, e + 1))
        return frozenset(states.items())

    def step(states: frozenset, c: str) -> frozenset:
        out: dict[int, int] = {}
        for u, e in states:
            for a, v in children[u].items():
                cost = e + (a != c)
                if cost <= most[v] and cost < out.get(v, 99):
                    out[v] = cost
            if e + 1 <= most[u] and e + 1 < out.get(u, 99):
                out[u] = e + 1
        return close(out)

    def accepts(states: frozenset) -> tuple[int, int, bool]:
        stems = [ends[u] for u, e in states if e == 0 and ends[u] >= 0 and entries[ends[u]][1]]
        whole = [(e, ends[u]) for u, e in states if ends[u] >= 0 and not entries[ends[u]][1] and e <= allowed(entries[ends[u]][0])]
        if whole and min(whole)[0] == 0:
            return min(whole)[1], 0, False
        if stems:
            return min(stems), 0, True
        return (min(whole)[1], min(whole)[0], False) if whole else (-1, 0, False)

    start = close({0: 0})
    index, order, rows, out = {start: 0}, [start], [], []
    for states in order:
        entry, e, stem = accepts(states)
        out.append((entry, e, stem))
        row = []
        for c in ["\0", *letters]:
            new = states if stem else step(states, c)
            if new and new not in index:
                index[new] = len(order)
                order.append(new)
            row.append(index[new] if new else -1)
        rows.append(row)
    table = np.array([*rows, [-1] * (len(letters) + 1)], dtype=np.int32)
    table[table < 0] = len(order)
    return Automaton(
        letters, table, np.array([x[0] for x in out] + [-1]), np.array([x[1] for x in out] + [0]), np.array([x[2] for x in out] + [False])
    )


class Matcher:
    def __init__(self, auto: Automaton):
        self.auto, self.word = auto, _classes()
        self.letter = np.zeros(0x110000, dtype=np.int32)
        for i, c in enumerate(auto.letters):
            self.letter[ord(c)] = i + 1

    def words(self, code: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        word = self.word[code]
        cut = np.zeros(len(code) + 1, dtype=bool)
        cut[offs] = True
        before, after = np.r_[False, word[:-1]], np.r_[word[1:], False]
        return np.flatnonzero(word & (~before | cut[:-1])), np.flatnonzero(word & (~after | cut[1:])) + 1

    def hits(self, code: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word, state) of each word that the automaton accepts."""
        dead, state = len(self.auto.table) - 1, np.zeros(len(starts), dtype=np.int32)
        live = np.arange(len(starts))
        n, pos = ends - starts, 0
        found_w, found_s = [], []
        while len(live):
            over = n[live] == pos
            if over.any():
                done = live[over]
                ok = self.auto.entry[state[done]] >= 0
                found_w.append(done[ok])
                found_s.append(state[done[ok]])
                live = live[~over]
            state[live] = self.auto.table[state[live], self.letter[code[starts[live] + pos]]]
            stem = self.auto.open[state[live]]
            if stem.any():
                found_w.append(live[stem])
                found_s.append(state[live[stem]])
                live = live[~stem]
            live = live[state[live] != dead]
            pos += 1
        if not found_w:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        w, s = np.concatenate(found_w), np.concatenate(found_s)
        by = np.argsort(w)
        return w[by], s[by]


def _quoted(text: str, a: int, b: int, window: int) -> bool:
    """Whether text[a:b] stands inside quotation marks on its line, or within `window` characters of reporting words."""
    left = text[max(0, a - window) : a].rpartition("\n")[2]
    right = text[b : b + window].partition("\n")[0]
    opened = max((left.rfind(c) for c in OPEN), default=-1)
    closed = any(c in right for c in CLOSE)
    if opened >= 0 and closed and sum(left.count(c) for c in '"') % 2 == (left[opened] == '"'):
        return True
    return any(w in REPORTING for w in "".join(c if c.isalpha() else " " for c in left + " " + right).split())


N_FEATURES = 7


def _pieces(text: str, matcher: Matcher):
    """(start, piece) of a text; a piece ends behind a character that is in no word, so that no word is cut."""
    at = 0
    while len(text) - at > _CHUNK:
        end = at + _CHUNK
        while end < len(text) and matcher.word[ord(text[end - 1])]:
            end += 1
        yield at, text[at:end]
        at = end
    yield at, text[at:]


def document_hits(column: pa.Array, matcher: Matcher, window: int = 60):
    """Yield (first row, words of each row, hits) over groups of whole rows; a hit is (row, entry, edits, quoted)."""
    texts = pc.utf8_lower(column.cast(pa.large_string()).fill_null("")).to_pylist()
    first = 0
    while first < len(texts):
        last, size = first, 0
        while last < len(texts) and (last == first or size + len(texts[last]) <= _CHUNK):
            size += len(texts[last])
            last += 1
        group = [(r, at, piece) for r in range(last - first) for at, piece in _pieces(texts[first + r], matcher)]
        words, hits = np.zeros(last - first, dtype=np.int64), []
        while group:  # a group is one piece of a long row, or many short rows
            part = [group.pop(0)] if len(group[0][2]) >= _CHUNK or group[0][1] else group
            group = [] if part is group else group
            offs = np.cumsum([0, *(len(x[2]) for x in part)])
            code = np.frombuffer("".join(x[2] for x in part).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
            if not len(code):
                continue
            starts, ends = matcher.words(code, offs)
            at = np.array([x[0] for x in part])
            words += np.bincount(at[np.searchsorted(offs, starts, "right") - 1], minlength=last - first)
            w, s = matcher.hits(code, starts, ends)
            for i, st, j in zip(w.tolist(), s.tolist(), (np.searchsorted(offs, starts[w], "right") - 1).tolist(), strict=True):
                r, shift, _ = part[j]
                a, b = int(starts[i] - offs[j]) + shift, int(ends[i] - offs[j]) + shift
                hits.append((r, int(matcher.auto.entry[st]), int(matcher.auto.edits[st]), _quoted(texts[first + r], a, b, window)))
        yield first, words, hits
        first = last


def document_features(column: pa.Array, matcher: Matcher, weights: np.ndarray, window: int = 60):
    """Yield (first row, features, counts): abuse, log count, best misspelling, quoted, best weight, density, one.

    `weights` has a row per entry: exact hits, hits with edits (0: the misspelling tells nothing). `counts` are the hits
    of each row that are exact, misspelled (with a weight) and quoted.
    """
    for first, words, hits in document_hits(column, matcher, window):
        out, counts = np.zeros((len(words), N_FEATURES)), np.zeros((len(words), 3), dtype=np.int64)
        out[:, 6] = 1.0
        for r, entry, edits, quoted in hits:
            x, weight = out[r], weights[entry, min(edits, 1)]
            if edits and weight <= 0:
                continue
            if quoted:
                x[3] = 1.0
                counts[r, 2] += 1
            elif edits:
                x[2] = max(x[2], weight)
                counts[r, 1] += 1
            else:
                x[0] = 1.0
                x[4] = max(x[4], weight)
                counts[r, 0] += 1
        out[:, 1] = np.log1p(counts[:, 0])
        out[:, 5] = np.minimum(counts[:, 0] * 100 / np.maximum(words, 1), 5.0)
        yield first, out, counts


@dataclass
class Model:
    auto: Automaton
    weights: np.ndarray
    coef: np.ndarray


#: Where the regression starts and is pulled to: one plain hit is abuse, a misspelling as its weight says, no hit is clean.
PRIOR = np.array([2.0, 0.5, 2.0, 0.0, 1.0, 0.1, -3.5])


def _logistic(x: np.ndarray, y: np.ndarray, l2: float = 3.0, steps: int = 60) -> np.ndarray:
    """Newton's method on the penalised log loss; a step is halved until the loss falls, as a full one can lead away from its minimum."""

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(np.logaddexp(0.0, z).sum() - y @ z + l2 / 2 * ((w - PRIOR) ** 2).sum())

    w = PRIOR.copy()
    for _ in range(steps):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + l2 * (w - PRIOR)
        hess = (x * (p * (1 - p))[:, None]).T @ x + l2 * np.eye(len(w))
        step, at, size = np.linalg.solve(hess, grad), loss(w), 1.0
        while size > 1e-9 and loss(w - size * step) > at - 1e-4 * size * (grad @ step):
            size /= 2
        if size <= 1e-9:
            break
        w = w - size * step
    return w


def sample(docs: DataFrame, labels: DataFrame, learn: Column, most: int = 4000) -> DataFrame:
    """At most `most` rows (text, label) of either label among the labelled ids where `learn` holds, in hash order.

    An id with several labels has the greatest of them. Of repeated rows of an id one teaches, that with the least hash
    of its text, so the bound holds for rows.
    """
    found = labels.filter("toxic is not null and doc_id is not null").select("doc_id", F.col("toxic").cast("int").alias("label")).filter(learn)
    found = found.groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = None
    for label in (0, 1):
        part = found.filter(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        chosen = part if chosen is None else chosen.unionByName(part)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return rows.groupBy("doc_id", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).select("text", "label")


def _terms(text: str, least: int = 3, longest: int = 9) -> set[str]:
    words = {w for w in "".join(c if c.isalnum() else " " for c in text.lower()).split() if len(w) < 40}
    return {w[:n] for w in words for n in range(least, min(len(w) - 1, longest) + 1)} | {w + "$" for w in words if len(w) > least}


def learn_lexicon(rows: DataFrame, base: tuple[str, ...] = LEXICON, support: int = 6, entries: int = 200, forms: int = 60) -> tuple[list[tuple[str, bool]], np.ndarray]:
    """The base terms, and the stems and terms that tell toxic rows from others, with log odds.

    Beginnings and whole words are counted by label over the sample; those that hardly occur without the label are taken
    greedily while they cover toxic rows that no taken entry covers. What comes to the driver is bounded by the sample
    and by the 5,000 best candidates.
    """

    def count(batches):
        toxic, other = Counter(), Counter()
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                (toxic if label else other).update(_terms(text or ""))
        terms = [t for t in toxic]
        yield pa.RecordBatch.from_arrays(
            [pa.array(terms, pa.string()), pa.array([toxic[t] for t in terms], pa.int64()), pa.array([other[t] for t in terms], pa.int64())], names=["term", "t", "o"]
        )
        terms = [t for t in other if t not in toxic]
        yield pa.RecordBatch.from_arrays(
            [pa.array(terms, pa.string()), pa.array([0] * len(terms), pa.int64()), pa.array([other[t] for t in terms], pa.int64())], names=["term", "t", "o"]
        )

    sums = rows.mapInArrow(count, "term string, t long, o long").groupBy("term").agg(F.sum("t").alias("t"), F.sum("o").alias("o"))
    best = sums.filter(f"t >= {support} and o * 8 <= t").orderBy(F.desc(F.col("t") - 4 * F.col("o")), F.desc(F.length("term")), "term").limit(5000).collect()
    stats = {r["term"]: (r["t"], r["o"]) for r in best}
    known = frozenset(stats)

    def cover(batches):
        for batch in batches:
            out = [sorted(_terms(text or "") & known) for text in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(out, pa.list_(pa.string()))], names=["label", "terms"])

    held: dict[str, set[int]] = {t: set() for t in stats}
    if stats:
        for i, r in enumerate(rows.mapInArrow(cover, "label int, terms array<string>").collect()):
            if r["label"]:
                for t in r["terms"]:
                    held[t].add(i)
    found: dict[tuple[str, bool], float] = {(t, False): 2.0 for t in base}
    left = set().union(*held.values()) if held else set()
    for _ in range(entries):
        gain = max(((len(held[t] & left) - 4 * stats[t][1], len(t), t) for t in held), default=(0, 0, ""))
        t = gain[2]
        if gain[0] < support:
            break
        left -= held.pop(t)
        a, b = stats[t]
        found[t.rstrip("$"), not t.endswith("$")] = float(np.log((a + 0.5) / (b + 0.5)))
    # Whole terms besides, so that their misspellings are found, too.
    whole = sorted((t for t in stats if t.endswith("$") and len(t) > 5), key=lambda t: (4 * stats[t][1] - stats[t][0], t))
    for t in whole[:forms]:
        found.setdefault((t.rstrip("$"), False), float(np.log((stats[t][0] + 0.5) / (stats[t][1] + 0.5))))
    return list(found), np.array(list(found.values()))


def _fitted(rows: DataFrame, base: tuple[str, ...]) -> tuple[Automaton, np.ndarray]:
    """The lexicon's automaton, and the weights (exact, with edits) of its entries.

    A hit with edits weighs what toxic rows have more of it than others, in log odds. One that is less than five times
    as frequent in toxic rows weighs nothing; one that no row has keeps the weight that the added halves give.
    """
    entries, exact = learn_lexicon(rows, base)
    auto = build(entries, frozenset(base))

    def count(batches):
        matcher = Matcher(auto)
        for batch in batches:
            for first, words, hits in document_hits(batch.column(0), matcher):
                seen = sorted({(r, e) for r, e, edits, _ in hits if edits})
                label = batch.column(1).slice(first, len(words)).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array([label[r] for r, _ in seen], pa.int32()), pa.array([e for _, e in seen], pa.int32())], names=["label", "entry"])

    totals = dict.fromkeys((0, 1), 0) | {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n = np.zeros((2, len(entries)))
    for r in rows.mapInArrow(count, "label int, entry int").groupBy("label", "entry").agg(F.count("*").alias("n")).collect():
        n[int(bool(r["label"])), r["entry"]] = r["n"]
    edited = np.log((n[1] + 0.5) / (totals[1] + 1.0)) - np.log((n[0] + 0.1) / (totals[0] + 1.0))
    return auto, np.stack([exact, np.where(edited >= np.log(5.0), np.minimum(edited, 6.0), 0.0)], axis=1)


def train(docs: DataFrame, labels: DataFrame, learn: Column, most: int = 4000, base: tuple[str, ...] = LEXICON) -> Model:
    """A model from at most `most` labelled rows of either label; without any, the base terms with their set weights."""
    rows = durable(sample(docs, labels, learn, most).withColumn("half", F.pmod(F.xxhash64("text"), F.lit(2)).cast("int")))

    def described(part: DataFrame, auto: Automaton, weights: np.ndarray) -> list:
        def describe(batches):
            matcher = Matcher(auto)
            for batch in batches:
                for first, x, _ in document_features(batch.column(0), matcher, weights):
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, N_FEATURES, dtype=np.int32)), pa.array(x.ravel()))
                    yield pa.RecordBatch.from_arrays([batch.column(1).slice(first, len(x)), lists], names=["label", "x"])

        return [(tuple(r["x"]), r["label"]) for r in part.mapInArrow(describe, "label int, x array<double>").collect()]

    # The score learns from rows that its features' lexicon has not seen.
    data = []
    for half in (0, 1):
        data += described(rows.filter(F.col("half") == half).select("text", "label"), *_fitted(rows.filter(F.col("half") != half).select("text", "label"), base))
    data.sort()
    coef = _logistic(np.array([x for x, _ in data]), np.array([float(bool(y)) for _, y in data])) if data else PRIOR
    return Model(*_fitted(rows.select("text", "label"), base), coef)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, score (0 to 1), predicted (1 from 0.5), and the hits: n_exact, n_misspelled, n_quoted.

    Null and empty texts get the score of a text without a hit. Null ids and repeated rows stay; an empty table gives an
    empty one. Only id and text are read, so other columns can't clash.
    """
    names = ["doc_id", "score", "predicted", "n_exact", "n_misspelled", "n_quoted"]

    def run(batches):
        matcher = Matcher(model.auto)
        for batch in batches:
            for first, x, counts in document_features(batch.column(1), matcher, model.weights):
                p = 1.0 / (1.0 + np.exp(-np.clip(x @ model.coef, -30, 30)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(x)), pa.array(p), pa.array((p >= 0.5).astype(np.int32)), *[pa.array(counts[:, j]) for j in range(3)]], names=names
                )

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, predicted int, n_exact long, n_misspelled long, n_quoted long")
