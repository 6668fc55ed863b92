"""Near-duplicate join on word n-grams (Jaccard) with multiple-global-order filtering.

1. One pass over the texts gives each document the size and a 128-bit digest of its set of k-word shingles. Equal sets
   are one class; only classes go on. Another pass counts all shingles, so that the most frequent ones stand last in every order.
2. In each of several global token orders (rare levels first, then a different permutation per order) a set of n
   shingles puts its first n - ceil(t * n) + 1 into an index. Two sets with similarity t or more share an index token
   in every order. Index tokens travel as packed arrays, not as rows.
3. All classes of a list of sharers are held against the one that shares most; links are verified exactly and what they
   connect is contracted. Lists whose classes lie in several components go on against others of their classes, as long
   as that finds links. A class whose open lists hold fewer tokens than any partner asks for drops out.
4. For what is left, prefix filtering is applied once more, to the lists themselves: a class needs only those of its
   lists, from the smallest on, behind which fewer tokens are left than a partner must share. Pairs of different
   components that meet there and share enough tokens in every order are verified, so no component misses a link, while
   pairs inside a component are never listed.

Verified means: whole texts side by side, 100 * intersection >= 100 * t * union on their shingle sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm._text import mix, texts_to_shingles
from sparkloom.llm.components import connected, durable, tidy, trimmed

_U = np.uint64
_FLUSH = 2_000_000
#: Frequent shingles that are known to all tasks: 12 bytes each, so a broadcast of at most 12 MB at any input size. They
#: only shape the orders; with more of them than this the results stay the same.
MAX_FREQUENT = 1_000_000
_SALT_EVERY = 200_000
#: Wanted texts whose ids are sent to all tasks (8 bytes each, 8 MB at most); beyond it the ids are joined.
MAX_FEW = 1_000_000


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _packed(raw: bytes) -> bytes:
    """Compressed, behind its size."""
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(blob: bytes) -> bytes:
    return pa.decompress(blob[8:], decompressed_size=int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)


def _packed_tokens(t: np.ndarray) -> bytes:
    """Ascending 32-bit numbers as the byte planes of their differences: the high planes are nearly empty."""
    steps = np.diff(t, prepend=t[:1] * 0).astype("<u4")
    return _packed(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 4).T).tobytes())


def _unpacked_tokens(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(_unpacked(blob), dtype=np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.uint32)


def _digest(r: np.ndarray, h: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size and two sums of differently mixed shingle hashes for each row."""
    n = np.bincount(r, minlength=n_rows)
    a, b = np.zeros(n_rows, dtype=np.uint64), np.zeros(n_rows, dtype=np.uint64)
    at = np.flatnonzero(n)
    if len(at):
        head = (np.cumsum(n) - n)[at]
        a[at] = np.add.reduceat(mix(h, 11), head)
        b[at] = np.add.reduceat(mix(h, 12), head)
    size = n.astype(np.uint64)
    return n, mix(a + size, 13), mix(b ^ size, 14)


def shingle_digests(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n, h1, h2) of every row."""

    def run(batches):
        for batch in batches:
            for first, rows, r, h in texts_to_shingles(batch.column(1), k):
                n, h1, h2 = _digest(r, h, rows)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, rows), pa.array(n), _long(h1), _long(h2)], names=["doc_id", "n", "h1", "h2"])

    return docs.select("doc_id", "text").mapInArrow(trimmed(run), "doc_id long, n long, h1 long, h2 long")


def _new_classes(n: np.ndarray, h1: np.ndarray, seen: set[int]) -> np.ndarray:
    """Which rows bring a shingle set that the task hasn't had yet."""
    new = np.zeros(len(n), dtype=bool)
    for i, x in enumerate(h1.tolist()):
        if n[i] and x not in seen:
            seen.add(x)
            new[i] = True
    return new


def _short(h: np.ndarray, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """A shingle's bucket and 32 more of its bits; the rare false match only makes a candidate or moves a place."""
    return mix(h, 55) % _U(n_buckets), (h >> _U(32)).astype(np.uint32)


def frequent_shingles(docs: DataFrame, k: int, n_buckets: int, parts: int, least: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(key, count) of the shingles in most classes, at most MAX_FREQUENT: every shingle is counted, in packed arrays."""

    def pack(batches):
        seen: set[int] = set()
        pool: list[np.ndarray] = []
        held = 0

        def flush():
            b, t = _short(np.concatenate(pool), n_buckets)
            key = np.sort((b << _U(32)) | t)
            b, t = key >> _U(32), key.astype(np.uint32)
            cut = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
            blobs = [_packed_tokens(t[x:y]) for x, y in zip(cut, np.r_[cut[1:], len(b)], strict=True)]
            return pa.RecordBatch.from_arrays([_long(b[cut]), pa.array(blobs, pa.binary())], names=["bucket", "tokens"])

        for batch in batches:
            for _, rows, r, h in texts_to_shingles(batch.column(0), k):
                n, h1, _ = _digest(r, h, rows)
                pool.append(h[_new_classes(n, h1, seen)[r]])
                held += len(pool[-1])
                if held >= _FLUSH:
                    yield flush()
                    pool, held = [], 0
        if held:
            yield flush()

    def count(batches):
        for batch in batches:
            for bucket, tokens in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                t, c = np.unique(np.concatenate([_unpacked_tokens(x) for x in tokens]), return_counts=True)
                t, c = t[c >= least], c[c >= least]
                yield pa.RecordBatch.from_arrays([pa.array((bucket << 32) | t.astype(np.int64)), pa.array(c.astype(np.int64))], names=["key", "df"])

    packed = docs.select("text").mapInArrow(trimmed(pack), "bucket long, tokens binary")
    grouped = packed.repartition(parts, "bucket").groupBy("bucket").agg(F.collect_list("tokens").alias("tokens"))
    counts = durable(grouped.mapInArrow(trimmed(count), "key long, df long"))
    # Counts fall into at most 512 classes, eight a power of two; whole classes are taken from the top while they fit.
    step = F.floor(F.log2(F.col("df").cast("double")) * 8).cast("int")
    left, floor = MAX_FREQUENT, 1 << 20
    for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("m")).orderBy(F.desc("step")).collect():
        if r["m"] > left:
            break
        left, floor = left - r["m"], r["step"]
    top = counts.filter(step >= floor).toArrow()
    keys = top["key"].to_numpy().view(np.uint64)
    by = np.argsort(keys)
    return keys[by].copy(), np.minimum(top["df"].to_numpy()[by], 2**31 - 1).astype(np.int32)


def _prefix(r: np.ndarray, h: np.ndarray, n: np.ndarray, level: np.ndarray, order: int, percent: int) -> np.ndarray:
    """Which shingles are in the prefix of their row under one global order."""
    key = (level << _U(58)) | (mix(h, 101 + order) >> _U(6))
    by = np.lexsort((key, r))
    head = np.repeat(np.cumsum(n) - n, n)
    place = np.arange(len(h)) - head
    size = n[r]
    take = np.zeros(len(h), dtype=bool)
    take[by] = place < (size + (-percent * size // 100) + 1)[by]
    return take


def prefix_lists(docs: DataFrame, frequent: tuple[np.ndarray, np.ndarray], k: int, percent: int, orders: int, n_buckets: int, parts: int) -> DataFrame:
    """(ord, list_id, h1, times): the classes that share index tokens.

    Tokens with equal lists are one list, `times` their number. A salted token's lists of one class may stand alone.
    """
    tokens, counts = frequent
    shared = docs.sparkSession.sparkContext.broadcast((tokens, counts))

    def pack(batches):
        common, df = shared.value
        maybe = np.zeros(1 << 22, dtype=bool)
        maybe[(common & _U((1 << 22) - 1)).astype(np.int64)] = True  # the low bits of a key are bits of its shingle
        seen: set[int] = set()
        pool: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]] = []
        held = 0

        def flush():
            for o in range(orders):
                mine = [x for x in pool if x[3] == o]
                if not mine:
                    continue
                t, c, b = (np.concatenate([x[i] for x in mine]) for i in range(3))
                by = np.argsort((b << 32) | t.astype(np.int64))
                t, c, b = t[by], c[by], b[by]
                cut = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
                end = np.r_[cut[1:], len(b)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(b[cut] * orders + o),
                        pa.array([_packed_tokens(t[x:y]) for x, y in zip(cut, end, strict=True)], pa.binary()),
                        pa.array([c[x:y].tobytes() for x, y in zip(cut, end, strict=True)], pa.binary()),
                    ],
                    names=["bucket", "tokens", "classes"],
                )

        for batch in batches:
            for _, rows, r, h in texts_to_shingles(batch.column(0), k):
                n, h1, _ = _digest(r, h, rows)
                new = _new_classes(n, h1, seen)
                use = new[r]
                if not use.any():
                    continue
                r, h = r[use], h[use]
                n = np.where(new, n, 0)
                level, salts = np.zeros(len(h), dtype=np.uint64), np.ones(len(h), dtype=np.uint64)
                bucket, short = _short(h, n_buckets)
                if len(common):
                    at = np.flatnonzero(maybe[(short & np.uint32((1 << 22) - 1)).astype(np.int64)])
                    key = (bucket[at] << _U(32)) | short[at].astype(np.uint64)
                    pos = np.minimum(np.searchsorted(common, key), len(common) - 1)
                    hit = common[pos] == key
                    at, found = at[hit], df[pos[hit]].astype(np.int64)
                    level[at] = np.minimum(np.floor(np.log2(np.maximum(found, 1))).astype(np.int64) + 1, 63).astype(np.uint64)
                    salts[at] = (1 + found // _SALT_EVERY).astype(np.uint64)
                for o in range(orders):
                    take = _prefix(r, h, n, level, o, percent)
                    t, c, b = short[take], h1[r[take]], bucket[take]
                    # A token with very many classes is dealt over several buckets; its lists keep one id.
                    many = salts[take] > 1
                    b = np.where(many, _U(n_buckets) + mix(mix(h[take], 58) + mix(c, 56) % salts[take], 57) % _U(n_buckets), b)
                    pool.append((t, c, b.astype(np.int64), o))
                    held += len(t)
                if held >= _FLUSH:
                    yield from flush()
                    pool, held = [], 0
        if held:
            yield from flush()

    def lists(batches):
        for batch in batches:
            for bucket, tokens, classes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                o, salted = bucket % orders, bucket // orders >= n_buckets
                t = np.concatenate([_unpacked_tokens(x) for x in tokens])
                c = np.concatenate([np.frombuffer(x, dtype=np.uint64) for x in classes])
                by = np.lexsort((c, t))
                t, c = t[by], c[by]
                keep = np.r_[True, (t[1:] != t[:-1]) | (c[1:] != c[:-1])]
                t, c = t[keep], c[keep]
                cut = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
                m = np.diff(np.r_[cut, len(t)])
                # Equal lists of different tokens are one list; a salted token keeps the token's id.
                if salted:
                    ids = mix(t[cut].astype(np.uint64), 23)
                    once, times = np.arange(len(ids)), np.ones(len(ids), dtype=np.int64)
                else:
                    ids = mix(np.add.reduceat(mix(c, 21), cut) + m.astype(np.uint64), 22)
                    _, once, times = np.unique(ids, return_index=True, return_counts=True)
                    once, times = once[m[once] > 1], times[m[once] > 1]
                if not len(once):
                    continue
                pick = np.repeat(cut[once] - (np.cumsum(m[once]) - m[once]), m[once]) + np.arange(int(m[once].sum()))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(pick), o, dtype=np.int32)),
                        _long(np.repeat(ids[once], m[once])),
                        _long(c[pick]),
                        pa.array(np.repeat(times, m[once]).astype(np.int64)),
                    ],
                    names=["ord", "list_id", "h1", "times"],
                )

    packed = docs.select("text").mapInArrow(trimmed(pack), "bucket long, tokens binary, classes binary")
    grouped = packed.repartition(parts, "bucket").groupBy("bucket").agg(
        F.collect_list("tokens").alias("tokens"), F.collect_list("classes").alias("classes")
    )
    return grouped.mapInArrow(trimmed(lists), "ord int, list_id long, h1 long, times long").groupBy("ord", "list_id", "h1").agg(F.sum("times").alias("times"))


def verify(docs: DataFrame, pairs: DataFrame, k: int, percent: int, parts: int, chunk: int = 512) -> DataFrame:
    """The pairs (ha, hb) of (a, ha, b, hb) whose texts have the similarity; a and b are ids of rows with these digests.

    Each hb goes to the group of its ha, in chunks of about `chunk` texts, so no group outgrows a task. Texts move compressed.
    """
    sizes = pairs.groupBy("ha").agg(F.count("*").alias("m"))
    dealt = pairs.join(sizes, "ha").withColumn("chunk", F.pmod(F.xxhash64("hb"), F.ceil(F.col("m") / chunk).cast("long")))
    want = dealt.select("ha", "chunk", F.lit(1).alias("role"), F.col("b").alias("doc_id"), F.col("hb").alias("h")).unionByName(
        dealt.select("ha", "chunk", F.lit(0).alias("role"), F.col("a").alias("doc_id"), F.col("ha").alias("h")).distinct()
    )

    def squeeze(batches):
        for batch in batches:
            blobs = [None if x is None else _packed(x.encode()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(blobs, pa.binary())], names=["doc_id", "packed"])

    def run(batches):
        key, base = None, None
        for batch in batches:
            ha, chunk_no, role, want_h = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            out_a, out_b = [], []
            texts = [None if x is None else _unpacked(x) for x in batch.column(4).to_pylist()]
            for first, rows, r, h in texts_to_shingles(pa.array(texts, pa.large_binary()).cast(pa.large_string()), k):
                n, h1, _ = _digest(r, h, rows)
                head = np.cumsum(n) - n
                for i in range(rows):
                    j = first + i
                    if h1[i].astype(np.int64) != want_h[j] or not n[i]:
                        continue  # a repeated id with another text
                    mine = h[head[i] : head[i] + n[i]]
                    if role[j] == 0:
                        key, base = (ha[j], chunk_no[j]), mine.copy()
                    elif key == (ha[j], chunk_no[j]):
                        pos = np.minimum(np.searchsorted(base, mine), len(base) - 1)
                        both = int((base[pos] == mine).sum())
                        if 100 * both >= percent * (len(base) + len(mine) - both):
                            out_a.append(ha[j])
                            out_b.append(want_h[j])
            if out_a:
                yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["ha", "hb"])

    texts = docs.select("doc_id", "text").filter("doc_id is not null")
    # Few wanted texts are looked up in the scan; more are joined by id.
    few = pairs.count() * 2 <= MAX_FEW
    if few:
        texts = texts.join(F.broadcast(want.select("doc_id").distinct()), "doc_id", "left_semi")
    return (
        want.join(texts.mapInArrow(trimmed(squeeze), "doc_id long, packed binary"), "doc_id")
        .select("ha", "chunk", "role", "h", "packed")
        .repartition(parts, "ha", "chunk")
        .sortWithinPartitions("ha", "chunk", "role")
        .mapInArrow(trimmed(run), "ha long, hb long")
    )


def _behind(n: str, percent: int) -> str:
    """How many shingles of a set of n stand behind its prefix."""
    return f"(({n} * {percent} + 99) div 100 - 1)"


def _least(x: str, y: str, percent: int) -> str:
    """How many prefix tokens two sets of x and y shingles must share: the rest is at most what either has behind its prefix."""
    return f"((({x} + {y}) * {percent} + {99 + percent}) div {100 + percent} - greatest({_behind(x, percent)}, {_behind(y, percent)}))"


def _open_entries(members: DataFrame, home: DataFrame, percent: int, orders: int) -> DataFrame:
    """The entries of lists with several components, of classes that could still have a partner there.

    A class needs, in every order, as many tokens in such lists as the least demanding size of a partner asks for. `share`
    is the part of its shingles that lists hold, `least` that demand, `m` the size of the list. `meets` marks the entries
    of the first order through which partners must meet: each class goes through its lists from the smallest to the
    largest, and two classes that share as many tokens as they must meet before what is left of their lists holds fewer
    than that, so the largest lists drop out.
    """
    entries = members.join(home, "h1")
    of_list = entries.groupBy("ord", "list_id").agg(
        F.count("*").alias("m"), F.min("n").alias("lo"), F.max("n").alias("hi"), F.min("component").alias("c1"), F.max("component").alias("c2")
    ).filter("c1 < c2").drop("c1", "c2")
    sized = entries.join(of_list, ["ord", "list_id"]).withColumns(
        {"lo": F.expr(f"greatest(lo, (n * {percent} + 99) div 100)"), "hi": F.expr(f"least(hi, n * 100 div {percent})")}
    ).filter("lo <= hi")
    # The demand falls with the distance of the sizes, so its least value is at an end of the range.
    sized = sized.withColumn("least", F.greatest(F.lit(1), F.least(F.expr(_least("n", "lo", percent)), F.expr(_least("n", "hi", percent))))).drop("lo", "hi")
    # A class has no more entries than shingles, so one pass over its own entries asks all of it.
    own = Window.partitionBy("h1")
    upto = own.orderBy("ord", "m", "list_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    of_order = lambda fn, col, o: fn(F.when(F.col("ord") == o, F.col(col))).over(own)
    asked = sized.withColumns(
        {f"room{o}": of_order(F.sum, "times", o) - of_order(F.min, "least", o) for o in range(orders)}
        | {"share": F.sum("times").over(own) / F.col("n"), "before": F.sum("times").over(upto) - F.col("times")}
    )
    fit = asked.filter(" AND ".join(f"room{o} >= 0" for o in range(orders)))
    return durable(fit.withColumn("meets", F.expr("ord = 0 AND before <= room0")).drop("before", *[f"room{o}" for o in range(orders)]))


def _agreed(meeting: DataFrame, open_: DataFrame, percent: int, orders: int) -> DataFrame:
    """(a, ha, b, hb) once: the pairs of different components that meet and share enough prefix tokens in every order.

    Every entry brings its class's packed lists along, so a pair is counted where it meets and only those that pass move on.
    """
    packed = open_.groupBy("h1").agg(F.first("rep").alias("rep"), F.collect_list(F.struct("ord", "list_id", "times")).alias("lists"))
    full = meeting.join(packed, "h1")
    side = lambda s: full.select(
        "list_id", F.col("h1").alias(f"h{s}"), F.col("rep").alias(s), F.col("n").alias(f"n{s}"), F.col("component").alias(f"c{s}"), F.col("lists").alias(f"lists_{s}")
    )
    sizes = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent
    met = side("a").join(side("b"), "list_id").filter((F.col("ca") < F.col("cb")) & sizes).select("ha", "a", "na", "lists_a", "hb", "b", "nb", "lists_b")

    def run(batches):
        for batch in batches:
            cols = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            n = {s: cols[f"n{s}"].to_numpy() for s in "ab"}
            flat = {}
            for s in "ab":
                x = cols[f"lists_{s}"]
                e = x.flatten()
                flat[s] = np.r_[0, np.cumsum(pc.list_value_length(x).to_numpy())], e.field(0).to_numpy(), e.field(1).to_numpy(), e.field(2).to_numpy()
            behind = np.maximum(*((n[s] * percent + 99) // 100 - 1 for s in "ab"))
            least = ((n["a"] + n["b"]) * percent + 99 + percent) // (100 + percent) - behind
            keep = []
            for i in range(batch.num_rows):
                (oa, la, ta), (ob, lb, _) = ([f[x[0][i] : x[0][i + 1]] for f in x[1:]] for x in (flat["a"], flat["b"]))
                keep.append(all(int(ta[oa == o][np.isin(la[oa == o], lb[ob == o])].sum()) >= least[i] for o in range(orders)))
            yield pa.RecordBatch.from_arrays([cols[c].filter(pa.array(keep, pa.bool_())) for c in ("a", "ha", "b", "hb")], names=["a", "ha", "b", "hb"])

    return met.mapInArrow(trimmed(run), "a long, ha long, b long, hb long").distinct()


def _linked(docs: DataFrame, reps: DataFrame, lists: DataFrame, k: int, percent: int, orders: int, parts: int, max_rounds: int) -> DataFrame:
    """(h1, rep, n, component) of every class (h1, rep, n); a component is known by the least h1 in it."""
    home = reps.withColumn("component", F.col("h1"))
    members = lists.select("ord", "list_id", "times", "h1")
    del lists  # the first turn replaces them

    def contract(home: DataFrame, links: DataFrame) -> DataFrame:
        at = lambda s: home.select(F.col("h1").alias(f"h{s}"), F.col("component").alias(s))
        joined = connected(links.join(at("a"), "ha").join(at("b"), "hb").select("a", "b")).withColumnRenamed("component", "new")
        return durable(home.join(joined, home["component"] == joined["node"], "left").select("h1", "rep", "n", F.coalesce("new", "component").alias("component")))

    # All classes of a list are held against one of them, first the one that shares most of its shingles, then others.
    # Lists of one component need no more tests. When few enough meet in lists, or a turn closes few of them, all pairs
    # that meet are tested.
    enough = (F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent) & (F.col("least_times") >= F.expr(_least("na", "nb", percent)))
    before = float("inf")
    for turn in range(max_rounds + 1):
        open_ = _open_entries(members, home, percent, orders)
        del members
        tidy(docs.sparkSession)
        meeting = open_.filter("meets").select("list_id", "h1", "n", "component")
        sizes = meeting.groupBy("list_id").agg(F.count("*").alias("m")).agg(F.sum(F.col("m") * (F.col("m") - 1) / 2), F.sum("m")).first()
        if not sizes[0] or turn == max_rounds or turn and (sizes[0] <= 4 * sizes[1] or sizes[1] > 0.9 * before):
            break
        before = sizes[1]
        rank = F.struct((-F.round(F.col("share") * 8) if turn else -F.col("share")).alias("s"), F.xxhash64("h1", F.lit(turn)).alias("u"))
        one = open_.groupBy("ord", "list_id").agg(F.min_by(F.struct(F.col("rep").alias("a"), F.col("h1").alias("ha"), F.col("n").alias("na"), F.col("component").alias("ca")), rank).alias("one"))
        x = open_.select("ord", "list_id", "times", F.col("rep").alias("b"), F.col("h1").alias("hb"), F.col("n").alias("nb"), F.col("component").alias("cb"))
        met = x.join(one.select("ord", "list_id", "one.*"), ["ord", "list_id"]).filter("ca <> cb")
        met = met.groupBy("a", "ha", "na", "b", "hb", "nb").agg(*[F.sum(F.when(F.col("ord") == o, F.col("times"))).alias(f"t{o}") for o in range(orders)])
        agreed = met.withColumn("least_times", F.array_min(F.array(*[F.coalesce(f"t{o}", F.lit(0)) for o in range(orders)]))).filter("least_times > 0")
        pairs = durable(agreed.filter(enough).select("a", "ha", "b", "hb"))
        home = contract(home, verify(docs, pairs, k, percent, parts))
        members = open_.select("ord", "list_id", "times", "h1")

    # What is left: every pair of different components that every order lists.
    if sizes[0]:
        crossed = durable(_agreed(meeting, open_, percent, orders))
        home = contract(home, verify(docs, crossed, k, percent, parts))
    return home


def ngram_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    k: int = 5,
    percent: int = 80,
    orders: int = 2,
    max_rounds: int = 6,
) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (the smallest id reachable by links) and n_copies.

    n_copies counts the rows with the same shingle set. A text without words has no shingles and is linked with
    nothing; one of fewer than k words is one shingle. A row with a null id keeps its counts and gets its class's
    component, null if it is alone there. Repeated rows stay: rows of one id and text have one answer, rows of one id
    with several texts are told apart by them. Only the id and the text are read, so other columns can't clash. Ids are
    whole numbers. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = durable(shingle_digests(docs, k))
    classes = durable(
        rows.filter("n > 0").groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n_copies"))
    )
    total = classes.agg(F.sum("n")).first()[0] or 0
    n_buckets = max(parts, int(total * (100 - percent) / 100 / 400_000) + 1) * 2
    frequent = frequent_shingles(docs, k, n_buckets, parts)
    tidy(spark)
    reps = classes.filter("rep is not null").select("h1", "rep", "n")
    home = _linked(docs, reps, durable(prefix_lists(docs, frequent, k, percent, orders, n_buckets, parts)), k, percent, orders, parts, max_rounds)
    smallest = home.groupBy("component").agg(F.min("rep").alias("component_id"))
    final = classes.join(home.join(smallest, "component").select("h1", "component_id"), "h1", "left").select("n", "h1", "h2", "n_copies", "component_id")
    found = rows.filter("n > 0").join(final, ["n", "h1", "h2"]).select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id", "n_copies"
    )
    alone = rows.filter("n = 0").select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(1).cast("long").alias("n_copies")
    )
    return found.unionByName(alone)


def one_of_each(docs: DataFrame, **how) -> DataFrame:
    """The documents without those whose component has a smaller id; columns stay as they are.

    Rows with a null id all stay, and so do repeated rows of a kept id.
    """
    id_col = how.get("id_col", "doc_id")
    later = ngram_components(docs, **how).filter("doc_id <> component_id").select(F.col("doc_id").alias("__later")).distinct()
    return docs.join(later, F.col(f"`{id_col}`") == F.col("__later"), "left_anti")


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')) END) AS g
  FROM d
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), often AS (
  SELECT g FROM s GROUP BY g HAVING count(*) > 1
), t AS (
  SELECT doc_id, g FROM s JOIN often USING (g)
), p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM t x JOIN t y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2
), e AS (
  SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 80 * (na.n + nb.n - i)
), r(doc_id, c) AS (
  SELECT doc_id, doc_id FROM d
  UNION
  SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id WHERE r.c < e.b
), c AS (
  SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id
), k AS (
  SELECT doc_id, md5(string_agg(g, chr(10) ORDER BY g)) AS h FROM s GROUP BY doc_id
), kc AS (
  SELECT h, count(*) AS n_copies FROM k GROUP BY h
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, coalesce(kc.n_copies, 1)::BIGINT AS n_copies
FROM d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id) LEFT JOIN kc USING (h)
"""
