"""SentencePiece encoding and decoding, with a max-plus scan for giant documents.

The model is byte-pair encoding. A sequence of pieces is a text's encoding exactly if every two neighbours are: a pair
is compatible if the library encodes its joint text as that pair. So encoding is a shortest-path problem whose states
are the pieces that reach over (or end at) a position, with the piece's score for a compatible step and minus infinity
for any other. Giant documents are cut into chunks anywhere, also inside pieces. Each chunk yields the max-plus matrix
from the states at its left boundary to those at its right one; matrices combine associatively into the state at each
boundary, and every chunk is then traced back on its own. No piece crosses the place before a run of spaces, so between
the first and the last such place of a chunk all paths are one: the library encodes its distinct pre-tokens. Documents
of one chunk need no matrix and are never shuffled.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm._text import slices
from sparkloom.llm.components import trimmed
from sparkloom.llm.token_counts import _pretokens

MARK = "▁"
CHUNK = 32_768
_P = 0x9E3779B97F4A7C15
_NONE = -np.inf


class Pieces:
    """The model's pieces, the library without its leading space, and the lattice of compatible pieces."""

    def __init__(self, model_path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(model_path, "rb") as f:
            proto.ParseFromString(f.read())
        proto.normalizer_spec.add_dummy_prefix = False
        self.lib = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        self.vocab = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == 1}
        self.score = np.array([p.score for p in proto.pieces])
        self.longest = max(map(len, self.vocab))
        self._ids: dict[str, tuple | None] = {}
        self._ok: dict[tuple[str, str], bool] = {}

    def ids(self, span: str) -> tuple | None:
        """The ids of a span that is one piece, or one character without a piece (its bytes); else None."""
        if span not in self._ids:
            got = None
            if span in self.vocab or len(span) == 1:
                got = tuple(self.lib.encode(span))
                if len(span) > 1 and got != (self.vocab[span],):
                    got = None
            if len(self._ids) > 200_000:
                self._ids.clear()
            self._ids[span] = got
        return self._ids[span]

    def fits(self, a: str, b: str) -> bool:
        key = (a, b)
        if key not in self._ok:
            if len(self._ok) > 500_000:
                self._ok.clear()
            self._ok[key] = tuple(self.lib.encode(a + b)) == self.ids(a) + self.ids(b)
        return self._ok[key]

    def weight(self, span: str) -> float:
        return float(sum(self.score[i] for i in self.ids(span)))

    def states(self, body: str, p: int) -> list[tuple[int, int]]:
        """The spans over or up to position p, in order; at the end of a document only those that end there."""
        out = []
        for s in range(max(0, p - self.longest), p):
            for e in range(p, min(len(body), s + self.longest) + 1):
                if self.ids(body[s:e]) is not None:
                    out.append((s, e))
        return out

    def walk(self, body: str, starts: dict, stop: int) -> tuple[dict, dict]:
        """Best scores of the spans that reach `stop`, from start spans (s, e) (s is -1: no piece before) with scores.

        Returns {span: score} for spans with an end at or after `stop`, and each span's predecessor.
        """
        at: dict[int, dict] = {}
        back: dict = {}
        for span, score in starts.items():
            at.setdefault(span[1], {})[span] = score
        done = {x: v for e, xs in at.items() if e >= stop for x, v in xs.items()}
        p = min(at, default=stop)
        while p < stop:
            here = at.pop(p, None)
            if here:
                for e in range(p + 1, min(len(body), p + self.longest) + 1):
                    new = body[p:e]
                    if self.ids(new) is None:
                        continue
                    best, come = _NONE, None
                    for span, score in here.items():
                        if score > best and (span[0] < 0 or self.fits(body[span[0] : span[1]], new)):
                            best, come = score, span
                    if come is not None:
                        best += self.weight(new)
                        (done if e >= stop else at.setdefault(e, {}))[p, e] = best
                        back[p, e] = come
            p += 1
        return done, back

    def middle(self, text: str) -> np.ndarray:
        ids, _ = encode_rows(self, pa.array([text]), prefix=False)
        return ids


def encode_rows(pieces: Pieces, column: pa.Array, prefix: bool = True, cache: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets) of whole texts: distinct pre-tokens are encoded once and laid out by their codes."""
    texts = [x or "" for x in column.to_pylist()]
    texts = [((" " if prefix and x else "") + x.replace(MARK, " ")).encode() for x in texts]
    offs = np.cumsum([0, *map(len, texts)])
    buf = np.frombuffer(b"".join(texts), dtype=np.uint8)
    if not len(buf):
        return np.zeros(0, dtype=np.int32), np.zeros(len(texts) + 1, dtype=np.int64)
    starts, ends, rows = _pretokens(buf, offs)
    starts = np.r_[0, ends[:-1]]  # with all their spaces, as nothing is put before them here
    coded = pa.StringArray.from_buffers(
        len(starts), pa.py_buffer(np.append(starts, len(buf)).astype(np.int32)), pa.py_buffer(buf.tobytes())
    ).dictionary_encode()
    tokens = coded.dictionary.to_pylist()
    cache = {} if cache is None else cache
    new = [t for t in tokens if t not in cache]
    for a in range(0, len(new), 20_000):
        cache.update(zip(new[a : a + 20_000], pieces.lib.encode(new[a : a + 20_000], num_threads=1), strict=True))
    found = [cache[t] for t in tokens]
    if len(cache) > 300_000:
        cache.clear()
    n = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
    flat = np.fromiter((i for x in found for i in x), dtype=np.int32, count=int(n.sum()))
    head = np.cumsum(n) - n
    code = coded.indices.to_numpy()
    m = n[code]
    out = flat[np.repeat(head[code] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))]
    per_row = np.bincount(rows, weights=m, minlength=len(texts)).astype(np.int64)
    return out, np.r_[0, np.cumsum(per_row)]


def breaks(body: str, lo: int, hi: int) -> list[int]:
    """The first and the last place in lo..hi that no piece crosses: before a mark that follows another character."""
    first = next((p for p in range(max(lo, 1), hi + 1) if p < len(body) and body[p] == MARK and body[p - 1] != MARK), None)
    if first is None:
        return []
    last = next(p for p in range(hi, first - 1, -1) if p < len(body) and body[p] == MARK and body[p - 1] != MARK)
    return [first, last]


def transfer(pieces: Pieces, body: str, lo: int, hi: int, is_first: bool, is_last: bool) -> np.ndarray:
    """The max-plus matrix of body[lo:hi] from its left boundary's states to its right one's."""
    left = [(-1, lo)] if is_first else pieces.states(body, lo)
    right = [x for x in pieces.states(body, hi) if not is_last or x[1] == hi]
    out = np.full((len(left), len(right)), _NONE)
    cut = breaks(body, lo, hi)
    place = {x: j for j, x in enumerate(right)}
    tail, middle = None, 0.0
    if cut:
        middle = float(pieces.score[pieces.middle(body[cut[0] : cut[1]])].sum()) if cut[1] > cut[0] else 0.0
        if cut[1] < hi:
            tail, _ = pieces.walk(body, {(-1, cut[1]): 0.0}, hi)
    for i, span in enumerate(left):
        if not cut:
            for x, v in pieces.walk(body, {span: 0.0}, hi)[0].items():
                if x in place:
                    out[i, place[x]] = max(out[i, place[x]], v)
            continue
        if span[1] > cut[0]:
            continue
        ends, _ = pieces.walk(body, {span: 0.0}, cut[0])
        here = [v for x, v in ends.items() if x[1] == cut[0]]
        if not here:
            continue
        if tail is None:  # the last break is the right boundary: the state is any span that ends there
            reach = ends if cut[0] == hi else {x: max(here) for x in _last_span(pieces, body, cut)}
            for x, v in reach.items():
                if x in place and x[1] == hi:
                    out[i, place[x]] = v if cut[0] == hi else max(here) + middle
        else:
            for x, v in tail.items():
                if x in place:
                    out[i, place[x]] = max(here) + middle + v
    return out


def _last_span(pieces: Pieces, body: str, cut: list[int]) -> list[tuple[int, int]]:
    """The span of the last piece before the last break."""
    ids = pieces.middle(body[cut[0] : cut[1]])
    size = len(pieces.lib.id_to_piece(int(ids[-1]))) if not pieces.lib.is_byte(int(ids[-1])) else 1
    return [(cut[1] - size, cut[1])]


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product: associative, so any bracketing of chunks gives the same states."""
    if not a.shape[1]:
        return np.full((a.shape[0], b.shape[1]), _NONE)
    return (a[:, :, None] + b[None, :, :]).max(1)


def boundary_states(matrices: list[np.ndarray]) -> list[int]:
    """The state at the right boundary of each chunk on the best path: prefixes forward, then choices backward."""
    prefix = [matrices[0]]
    for m in matrices[1:]:
        prefix.append(combine(prefix[-1], m))
    state = [int(np.argmax(prefix[-1][0]))]
    for c in range(len(matrices) - 1, 0, -1):
        state.append(int(np.argmax(prefix[c - 1][0] + matrices[c][:, state[-1]])))
    return state[::-1]


def trace(pieces: Pieces, body: str, lo: int, hi: int, is_first: bool, is_last: bool, left: int, right: int) -> np.ndarray:
    """The ids of the pieces that start in body[lo:hi], given the states at both boundaries."""
    begin = (-1, lo) if is_first else pieces.states(body, lo)[left]
    goal = [x for x in pieces.states(body, hi) if not is_last or x[1] == hi][right]

    def path(starts: tuple[int, int], end: tuple[int, int], stop: int) -> list[int]:
        if starts == end:
            return []
        _, back = pieces.walk(body, {starts: 0.0}, stop)
        out: list[tuple[int, ...]] = []
        while end != starts:
            out.append(pieces.ids(body[end[0] : end[1]]))
            end = back[end]
        return [i for x in out[::-1] for i in x]

    cut = breaks(body, lo, hi)
    if not cut or cut[0] == hi:
        return np.array(path(begin, goal, hi), dtype=np.int32)
    ends, _ = pieces.walk(body, {begin: 0.0}, cut[0])
    first = max((x for x in ends if x[1] == cut[0]), key=lambda x: ends[x])
    parts = [np.array(path(begin, first, cut[0]), dtype=np.int32)]
    if cut[1] > cut[0]:
        parts.append(pieces.middle(body[cut[0] : cut[1]]))
    if cut[1] < hi:
        parts.append(np.array(path((-1, cut[1]), goal, hi), dtype=np.int32))
    return np.concatenate(parts)


def decode_ids(pieces: Pieces, ids: np.ndarray) -> str:
    """The text of whole ids: pieces joined, byte runs read as UTF-8, marks read as spaces, the leading one dropped."""
    return pieces.lib.decode(ids.tolist()) if len(ids) else ""


def _digest(ids: np.ndarray) -> tuple[int, int]:
    """A rolling hash of ids and the power to shift it by, both modulo 2**64: (a + b) is a * power(b) + b."""
    powers = np.full(len(ids) + 1, np.uint64(_P), dtype=np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    h = ((ids.astype(np.uint64) + np.uint64(1)) * powers[: len(ids)][::-1]).sum(dtype=np.uint64)
    return int(h.astype(np.int64)), int(powers[-1].astype(np.int64))


def _long(x: int) -> int:
    x %= 2**64
    return x - 2**64 if x >= 2**63 else x


def _parts(batches, rows: int = 16):
    """The batches, a few rows at a time: a row holds a chunk or a giant document, and becomes many Python objects."""
    for batch in batches:
        for first in range(0, len(batch), rows):
            yield batch.slice(first, rows)


def _lists(ids: list[np.ndarray]) -> pa.ListArray:
    """Ids as one Arrow column, without a Python object for each."""
    offs = np.cumsum([0, *map(len, ids)])
    return pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *ids]), pa.int32()))


def _bodies(text: Column, chunk: int, edge: int) -> Column:
    """(chunk_no, body, lo, hi) of every chunk of a text, with `edge` characters of the text on both sides."""
    whole = F.concat(F.lit(MARK), F.replace(text, F.lit(" "), F.lit(MARK)))
    n = F.length(whole)

    def one(i: Column) -> Column:
        lo, hi = i * chunk, F.least((i + 1) * chunk, n)
        left, right = F.greatest(lo - edge, F.lit(0)), F.least(hi + edge, n)
        return F.struct(
            i.cast("int").alias("chunk_no"), F.substring(whole, left + 1, right - left).alias("body"),
            (lo - left).cast("int").alias("lo"), (hi - left).cast("int").alias("hi"), (hi == n).alias("is_last"),
        )

    return F.transform(F.sequence(F.lit(0), F.floor((n - 1) / chunk).cast("int")), one)


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, chunk: int = CHUNK) -> DataFrame:
    """One row per input row: doc_id, n_chars, n_chunks, n_tokens, digest of the ids, round_trip and, if asked, ids.

    round_trip says whether decoding gives the text back (a literal mark is read as a space). Null and empty texts have
    no tokens. Null ids and repeated rows stay; repeated giant rows are scanned once. Only id and text are read, so
    other columns can't clash. Ids are those of the library, without begin and end.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    # A literal mark is read as a space all over.
    rows = rows.withColumn("text", F.replace("text", F.lit(MARK), F.lit(" ")))
    giant = F.length("text") >= chunk
    tail = ", ids array<int>" if with_ids else ""
    schema = f"doc_id long, n_chars long, n_chunks int, n_tokens long, digest long, round_trip boolean{tail}"
    names = ["doc_id", "n_chars", "n_chunks", "n_tokens", "digest", "round_trip", *(["ids"] if with_ids else [])]

    def small(batches):
        pieces, cache = Pieces(model_path), {}
        for batch in batches:
            for first, last, _, _ in slices(batch.column(1)):
                part = batch.column(1).slice(first, last - first)
                ids, offs = encode_rows(pieces, part, cache=cache)
                texts = part.to_pylist()
                lists = [ids[a:b] for a, b in zip(offs[:-1], offs[1:], strict=True)]
                back = pieces.lib.decode([x.tolist() for x in lists], num_threads=1)
                same = [(b[1:] if b[:1] == " " else b) == t for b, t in zip(back, texts, strict=True)]
                columns = [
                    batch.column(0).slice(first, last - first), pa.array([len(t) for t in texts], pa.int64()), pa.array([1 if t else 0 for t in texts], pa.int32()),
                    pa.array(np.diff(offs), pa.int64()), pa.array([_digest(x)[0] for x in lists], pa.int64()), pa.array(same, pa.bool_()),
                ]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(ids)))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    plain = rows.filter(~giant).mapInArrow(trimmed(small), schema)

    # Giant documents: chunks to rows, dealt by document and chunk.
    edge = 16
    key = F.struct(F.xxhash64("text").alias("h"), F.md5("text").alias("m"), F.length("text").cast("long").alias("n_chars"))
    big = rows.filter(giant).withColumn("key", key)
    cut = big.select("key", F.explode(_bodies(F.col("text"), chunk, edge)).alias("c")).select("key", "c.*")
    cut = cut.groupBy("key", "chunk_no").agg(*[F.first(c).alias(c) for c in ("body", "lo", "hi", "is_last")])

    def matrices(batches):
        pieces = Pieces(model_path)
        if pieces.longest > edge:
            raise ValueError("a piece is longer than the overlap of chunks")
        for batch in _parts(batches):
            out = []
            for r in batch.select(["chunk_no", "body", "lo", "hi", "is_last"]).to_pylist():
                m = transfer(pieces, r["body"], r["lo"], r["hi"], r["chunk_no"] == 0, r["is_last"])
                out.append((m.shape[0], m.shape[1], m.tobytes()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("chunk_no"), pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.binary())],
                names=["key", "chunk_no", "rows", "cols", "matrix"],
            )

    def states(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk_no")
        found = [np.frombuffer(m, dtype=np.float64).reshape(a, b) for m, a, b in zip(pdf["matrix"], pdf["rows"], pdf["cols"], strict=True)]
        right = boundary_states(found)
        return pd.DataFrame({"h": pdf["h"], "m": pdf["m"], "n_chars": pdf["n_chars"], "chunk_no": pdf["chunk_no"], "left": [0, *right[:-1]], "right": right})

    kind = "struct<h: long, m: string, n_chars: long>"
    steps = cut.mapInArrow(trimmed(matrices), f"key {kind}, chunk_no int, rows int, cols int, matrix binary").select("key.*", "chunk_no", "rows", "cols", "matrix")
    at = steps.groupBy("h", "m", "n_chars").applyInPandas(states, "h long, m string, n_chars long, chunk_no int, left int, right int")
    both = cut.join(at.select(F.struct("h", "m", "n_chars").alias("key"), "chunk_no", "left", "right"), ["key", "chunk_no"])

    def traced(batches):
        pieces = Pieces(model_path)
        for batch in _parts(batches):
            ids, ends = [], []
            for r in batch.select(["chunk_no", "body", "lo", "hi", "is_last", "left", "right"]).to_pylist():
                ids.append(trace(pieces, r["body"], r["lo"], r["hi"], r["chunk_no"] == 0, r["is_last"], r["left"], r["right"]))
                ends.append(_digest(ids[-1]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("chunk_no"), _lists(ids), pa.array([x[0] for x in ends], pa.int64()), pa.array([x[1] for x in ends], pa.int64())],
                names=["key", "chunk_no", "ids", "digest", "power"],
            )

    chunks = both.mapInArrow(trimmed(traced), f"key {kind}, chunk_no int, ids array<int>, digest long, power long")
    whole = chunks.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("chunk_no", "ids", "digest", "power"))).alias("c"))

    def finish(batches):
        pieces = Pieces(model_path)
        for batch in _parts(batches, 1):
            c = batch.column("c").flatten()
            d, ids = 0, c.field("ids").flatten().to_numpy()
            for digest, power in zip(c.field("digest").to_pylist(), c.field("power").to_pylist(), strict=True):
                d = _long(d * power + digest)
            text = decode_ids(pieces, ids)
            columns = [pa.array([len(c)], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([d], pa.int64()), pa.array([text[1:] if text[:1] == " " else text]), _lists([ids])]
            yield pa.RecordBatch.from_arrays([batch.column("key"), *columns], names=["key", "n_chunks", "n_tokens", "digest", "decoded", "ids"])

    done = whole.mapInArrow(trimmed(finish), f"key {kind}, n_chunks int, n_tokens long, digest long, decoded string, ids array<int>")
    done = done.select("key", "n_chunks", "n_tokens", "digest", F.md5("decoded").alias("decoded"), *(["ids"] if with_ids else []))
    large = big.select("doc_id", "key").join(done, "key").select(
        "doc_id", F.col("key.n_chars").alias("n_chars"), "n_chunks", "n_tokens", "digest", (F.col("decoded") == F.col("key.m")).alias("round_trip"),
        *(["ids"] if with_ids else []),
    )
    return plain.unionByName(large)


def decode(encoded: DataFrame, model_path: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """`encoded` with the text of its ids; a null or empty list gives an empty text. A column named `text_col` is replaced."""

    @F.pandas_udf("string")
    def text_of(column: pd.Series) -> pd.Series:
        pieces = Pieces(model_path)
        out = [decode_ids(pieces, np.asarray(x if x is not None else [], dtype=np.int32)) for x in column]
        return pd.Series([x[1:] if x[:1] == " " else x for x in out])

    return encoded.withColumn(text_col, text_of(F.col(f"`{ids_col}`")))
