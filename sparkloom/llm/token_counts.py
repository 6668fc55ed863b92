"""Token counts: pieces are counted once per distinct pre-token and joined to per-document pre-token frequencies.

No piece of the vocabulary has a space mark after another character (`check_model` makes sure of that), so no merge
crosses the place before a run of spaces: pre-tokens (a run of spaces with the word behind it) are encoded independently
and their piece counts add up.

1. Groups of documents, a bounded number of bytes each, are cut into pre-tokens. A group keeps its distinct pre-tokens, in
   the order of a hash's buckets, and for each document how often it has which of them, in packed arrays.
2. A bucket brings the pre-tokens of all groups together and gives each distinct one to the library, once in the whole job.
   There are as many buckets as input partitions and more, so a bucket is about as large as a partition's share.
3. The numbers of pieces go back to the groups in the same order, and each document sums frequency times number.

No ids of documents are kept. What moves is a group's distinct pre-tokens and a byte or two for each on the way back,
not a row per document and pre-token.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm._text import slices
from sparkloom.llm.components import durable

_MARK = "▁"
#: Bytes of a group of documents, about; a longer document is a group of its own. Longer texts are cut into pieces.
GROUP_BYTES = 8 << 20
PIECE_BYTES = 1 << 20
_SPACE_ONLY = np.zeros(256, dtype=bool)
_SPACE_ONLY[0x20] = True


def check_model(model_path: str) -> None:
    """An error if a piece has a space mark behind another character, as pre-tokens would not add up then."""
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=model_path)
    bad = [x for x in (lib.id_to_piece(i) for i in range(lib.get_piece_size())) if _MARK in x.lstrip(_MARK)]
    if bad:
        raise ValueError(f"pieces that cross the start of a word: {bad[:3]}")


def piece_counter(model_path: str):
    """A function from a list of pre-tokens (without the one space that the library puts first) to counts of pieces."""
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=model_path)

    def count(tokens: list[str]) -> list[int]:
        # A pre-token that is one space alone: the space was left out, so the library gets no text for it.
        return [len(x) if t else 1 for t, x in zip(tokens, lib.encode(tokens, num_threads=1), strict=True)]

    return count


def _pretokens(buf: np.ndarray, offs: np.ndarray, fresh: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each pre-token; the first space of one is left out, as the library adds it again.

    Without `fresh` the first row goes on from another piece, at the start of a run of spaces.
    """
    n = len(buf)
    space = _SPACE_ONLY[buf]
    first = np.zeros(n + 1, dtype=bool)
    first[offs] = True
    first[0] = fresh
    first = first[:n]
    prev_space = np.empty_like(space)
    prev_space[0], prev_space[1:] = False, space[:-1]
    starts = np.flatnonzero(first | (space & ~prev_space))
    ends = np.append(starts[1:], n)
    rows = np.searchsorted(offs, starts, "right") - 1
    # The library puts a space before a text, so a row's first pre-token keeps its own spaces.
    return starts + (space[starts] & ~first[starts]), ends, rows


def _pieces(buf: np.ndarray, offs: np.ndarray):
    """(bytes, offsets, first row, whether it is the row's start): a long text in pieces that begin at a run of spaces."""
    if len(buf) <= PIECE_BYTES or len(offs) > 2:
        yield buf, offs, True
        return
    at = 0
    while at < len(buf):
        end = at + PIECE_BYTES
        while end < len(buf):
            part = _SPACE_ONLY[buf[end - 1 : end + PIECE_BYTES]]
            cut = np.flatnonzero(part[1:] & ~part[:-1])
            if len(cut):
                end += int(cut[0])
                break
            end += len(part) - 1
        end = min(end, len(buf))
        yield buf[at:end], np.array([0, end - at]), at == 0
        at = end


def _small(x: np.ndarray) -> bytes:
    """Whole numbers in the fewest bytes that hold all of them."""
    top = int(x.max()) if len(x) else 0
    return x.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32).tobytes()


def _large(x: bytes, n: int) -> np.ndarray:
    return np.frombuffer(x, dtype={1: np.uint8, 2: np.uint16, 4: np.uint32}[len(x) // n]) if n else np.zeros(0, dtype=np.uint32)


_PACKED = pa.struct([("bucket", pa.int64()), ("n", pa.int64()), ("lens", pa.binary()), ("body", pa.binary())])


class _Group:
    """Distinct pre-tokens of some documents, and the frequencies of each document."""

    def __init__(self, buckets: int):
        self.buckets = buckets
        self.code: dict[str, int] = {}
        self.ids, self.n_bytes, self.ends, self.codes, self.freqs = [], [], [], [], []
        self.size = self.pairs = 0

    def add(self, ids: list, column: pa.Array, buf: np.ndarray, offs: np.ndarray) -> None:
        n_bytes = np.diff(offs)
        self.size += len(buf)
        blob = buf.tobytes()
        if _MARK.encode() in blob:  # the mark itself is read as a space; it changes the length of the bytes
            texts = [x.replace(_MARK, " ").encode() for x in column.fill_null("").to_pylist()]
            blob = b"".join(texts)
            buf, offs = np.frombuffer(blob, dtype=np.uint8), np.cumsum([0, *map(len, texts)])
        pairs: list[np.ndarray] = []
        for part, cuts, fresh in _pieces(buf, offs):
            if not len(part):
                continue
            starts, ends, at = _pretokens(part, cuts, fresh)
            lens = ends - starts
            head = np.cumsum(lens) - lens
            body = part[np.arange(int(lens.sum())) + np.repeat(starts - head, lens)]
            coded = pa.LargeStringArray.from_buffers(len(lens), pa.py_buffer(np.append(head, lens.sum()).astype(np.int64)), pa.py_buffer(body.tobytes())).dictionary_encode()
            mine = np.array([self.code.setdefault(t, len(self.code)) for t in coded.dictionary.to_pylist()], dtype=np.int64)
            pairs.append(at << 32 | mine[coded.indices.to_numpy()])
        key, freq = np.unique(np.concatenate(pairs), return_counts=True) if pairs else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))
        count = np.bincount(key >> 32, minlength=len(n_bytes))
        self.ids += ids
        self.n_bytes.append(n_bytes)
        self.ends.append(np.cumsum(count) + self.pairs)
        self.codes.append(key & 0xFFFFFFFF)
        self.freqs.append(freq)
        self.pairs += len(key)

    def batch(self, no: int) -> pa.RecordBatch:
        cat = lambda xs: np.concatenate(xs).astype(np.int64)
        words = [t.encode("utf-8", "surrogatepass") for t in self.code]
        at = np.fromiter((xxhash.xxh32_intdigest(w) % self.buckets for w in words), dtype=np.int64, count=len(words))
        order = np.argsort(at, kind="stable")
        rank = np.empty(len(words), dtype=np.int64)
        rank[order] = np.arange(len(words))
        cut = np.flatnonzero(np.r_[True, at[order][1:] != at[order][:-1]])[: len(words)]
        lists = [order[a:b].tolist() for a, b in zip(cut, np.r_[cut[1:], len(words)], strict=True)] if words else []
        tokens = [
            {"bucket": int(at[x[0]]), "n": len(x), "lens": _small(np.array([len(words[i]) for i in x])), "body": zlib.compress(b"".join(words[i] for i in x), 1)} for x in lists
        ]
        # Codes rise within a document, so the differences are small; a document's first one goes back to its start.
        row = np.repeat(np.arange(len(self.ids)), np.diff(cat(self.ends), prepend=0))
        codes, freqs = rank[cat(self.codes)], cat(self.freqs)
        by = np.lexsort((codes, row))
        steps, freqs = np.diff(codes[by], prepend=0).astype(np.int32), freqs[by]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([no], pa.int64()), pa.array([self.ids], pa.list_(pa.int64())), pa.array([cat(self.n_bytes).tobytes()], pa.binary()), pa.array([cat(self.ends).tobytes()], pa.binary()),
                pa.array([zlib.compress(steps.tobytes(), 1)], pa.binary()), pa.array([zlib.compress(_small(freqs), 1)], pa.binary()), pa.array([tokens], pa.list_(_PACKED)),
            ],
            names=["group", "ids", "n_bytes", "ends", "codes", "freqs", "tokens"],
        )


def token_counts(
    docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096
) -> DataFrame:
    """One row per input row: id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit).

    Null and empty texts have no bytes and no tokens. Null ids and repeated rows stay as they are. Other columns are
    not read, so their names can't clash.
    """
    check_model(model_path)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.spark_partition_id().alias("part"))

    buckets = 4 * max(docs.rdd.getNumPartitions(), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def cut(batches):
        group, no = _Group(buckets), 0
        for batch in batches:
            if batch.num_rows and not no:
                no = batch.column(2)[0].as_py() << 32
            for first, last, buf, offs in slices(batch.column(1)):
                if group.ids and group.size + len(buf) > GROUP_BYTES:
                    yield group.batch(no)
                    group, no = _Group(buckets), no + 1
                group.add(batch.column(0).slice(first, last - first).to_pylist(), batch.column(1).slice(first, last - first), buf, offs)
        if group.ids:
            yield group.batch(no)

    packed = "bucket: long, n: long, lens: binary, body: binary"
    groups = durable(rows.mapInArrow(cut, f"group long, ids array<long>, n_bytes binary, ends binary, codes binary, freqs binary, tokens array<struct<{packed}>>"))
    own = groups.select("group", F.inline("tokens")).repartition(F.col("bucket")).sortWithinPartitions("bucket")

    def encode(batches):
        """Batches of a partition hold whole buckets but for their ends, so counts are kept until the bucket changes."""
        count = piece_counter(model_path)
        now, known = None, {}
        for batch in batches:
            group, bucket, out = batch.column(0), batch.column(1).to_pylist(), []
            for b, n, lens, body in zip(bucket, *(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                if b != now:
                    now, known = b, {}
                end, body = np.cumsum(_large(lens, n).astype(np.int64)).tolist(), zlib.decompress(body)
                words = [body[x:y].decode("utf-8", "surrogatepass") for x, y in zip([0, *end[:-1]], end, strict=True)]
                fresh = [w for w in words if w not in known]
                known.update(zip(fresh, count(fresh), strict=True))
                out.append(_small(np.array([known[w] for w in words])))
            yield pa.RecordBatch.from_arrays([group, batch.column(1), batch.column(2), pa.array(out, pa.binary())], names=["group", "bucket", "n", "pieces"])

    pieces = own.mapInArrow(encode, "group long, bucket long, n long, pieces binary")
    known = pieces.groupBy("group").agg(F.sort_array(F.collect_list(F.struct("bucket", "n", "pieces"))).alias("known"))

    def add(batches):
        for batch in batches:
            for ids, n_bytes, ends, codes, freqs, known in zip(*(c for c in batch.columns), strict=True):
                end = np.frombuffer(ends.as_py(), dtype=np.int64)
                n = int(end[-1]) if len(end) else 0
                pieces = [_large(x["pieces"], x["n"]).astype(np.int64) for x in known.as_py() or ()]
                pieces = np.concatenate(pieces) if pieces else np.zeros(0, dtype=np.int64)
                code = np.cumsum(np.frombuffer(zlib.decompress(codes.as_py()), dtype=np.int32).astype(np.int64))
                sums = np.r_[0, np.cumsum(pieces[code] * _large(zlib.decompress(freqs.as_py()), n).astype(np.int64))]
                yield pa.RecordBatch.from_arrays(
                    [ids.values, pa.array(np.frombuffer(n_bytes.as_py(), dtype=np.int64)), pa.array(np.diff(sums[np.r_[0, end]]))], names=["doc_id", "n_bytes", "n_tokens"]
                )

    met = groups.drop("tokens").join(known, "group", "left").select("ids", "n_bytes", "ends", "codes", "freqs", "known")
    return met.mapInArrow(add, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
