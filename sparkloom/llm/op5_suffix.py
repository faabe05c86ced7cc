"""Exact removal of repeated 200-byte strings by bucket-pointer refinement on sampled suffixes.

Every suffix starts in the bucket of its first QGRAM bytes. Buckets are refined by the bucket identifiers of later
offsets: the identifier for twice the length is made of that at the suffix and that at the offset where the first ends
(25 and 25, 50 and 50 bytes), and each round reuses the one before. Identifiers are named by hashing instead of by
rank, so a round needs no order over all texts and runs where the text is.

A sparse suffix set suffices: of any 101 successive positions the one with the smallest 100-byte identifier is an
anchor, so a 200-byte string holds the whole 100 bytes of an anchor that depends on the string alone, and two
equal strings have it at the same offset. Anchors are sorted by identifier; buckets of one anchor are settled and
dropped. A bucket that is left is refined by the identifiers of earlier and later offsets: first those that make up
the whole context that 200-byte strings through the anchor can touch (100 bytes before, 200 from it on). Anchors
that share their context with another are settled; for those on the edge of a match, each of the 101 offsets
is refined by the identifiers at it and 100 bytes later. Covered ranges of all anchors of a text are united and cut.

Bucket identifiers are 64-bit hashes of content (contexts are told apart within a bucket only, texts have 96 bits), so they need no global order;
every step is a combinable aggregation or equi-join. A bucket with over WIDE different contexts is
refined through one row per offset and string instead of within one task.

Defined cases: null and empty texts have 0 bytes and the hash of nothing; texts under 200 bytes are
kept; copies of a text (repeated rows, equal doc_ids) count as other places, so texts of 200 bytes and
more that occur twice go wholly; rows with a null doc_id are like any other; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import U, discard, mix, prefix_hash, release_memory, row_groups, stored, table, text_buffers

LENGTH, GRAM, QGRAM = 200, 100, 25
SPAN = LENGTH - GRAM + 1
#: A bucket of so many different contexts takes about 60 MB in one task.
WIDE = 16384
#: Contexts of a batch, at most 300 bytes each.
EDGES = 8192


def window_min(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` successive values."""
    size, low = 1, h
    while 2 * size <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    rest = width - size
    return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low


def refined(ids: np.ndarray, step: int) -> np.ndarray:
    """Identifiers for step more bytes: of each position's own and that of the position `step` later."""
    return mix(ids[:-step] * U(0xBF58476D1CE4E5B9) + ids[step:])


def identifiers(data: np.ndarray, length: int = GRAM) -> np.ndarray:
    """Bucket identifiers of the `length` bytes from each position on, refined from those of QGRAM bytes."""
    s, p = prefix_hash(data)
    ids, have = mix((s[QGRAM:] - s[:-QGRAM]) * p[: len(data) - QGRAM + 1]), QGRAM
    while have < length:
        ids, have = refined(ids, have), 2 * have
    return ids


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A text's anchors, each position that is smallest in a window of SPAN positions: positions, bucket identifiers, and identifiers of their contexts."""
    h = identifiers(data)
    low = window_min(h, SPAN)
    # position i is an anchor if some window that holds it has it as minimum: the largest of those minima equals its hash
    n = len(h)
    padded = np.zeros(n + SPAN - 1, np.uint64)
    padded[SPAN - 1 : SPAN - 1 + len(low)] = low
    highest = ~window_min(~padded, SPAN)
    at = np.flatnonzero(h == highest[:n])
    return at, h[at].view(np.int64), contexts(h, at).view(np.int64)


def contexts(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Identifiers of anchors' contexts, made of those at the context's begin, at the anchor, and GRAM bytes before the context's end."""
    left = np.minimum(at, LENGTH - GRAM)
    last = np.minimum(at + LENGTH - GRAM, len(h) - 1)
    out = mix(left.astype(np.uint64) * U(1024) + (last - at).astype(np.uint64))
    for where in (at - left, at, last):
        out = mix(out * U(0x94D049BB133111EB) + h[where])
    return out


def context_bytes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts of a text's anchors: bytes before each anchor (at most GRAM), lengths, and all bytes one after the other."""
    left = np.minimum(at, LENGTH - GRAM)
    size = np.minimum(at + LENGTH, len(data)) - (at - left)
    shift = at - left - (np.cumsum(size) - size)
    return left, size, data[np.arange(size.sum()) + np.repeat(shift, size)]


def text_key(text: bytes) -> tuple[int, int]:
    """64 and 32 bits; the second part leaves room for a position, so that an anchor is four longs."""
    key = xxhash.xxh3_128_intdigest(text)
    return (key & (2**64 - 1)) - 2**63, (key >> 64 & (2**32 - 1)) - 2**31


def _each(batch, column: int):
    """The texts of a batch, as arrays and bytes, in groups that bound memory."""
    data, offsets = text_buffers(batch.column(column))
    for lo, hi in row_groups(offsets):
        for r in range(lo, hi):
            part = data[offsets[r] : offsets[r + 1]]
            yield r, part


def _anchor_rows(batches, places: bool):
    """(q, c) of each anchor: bucket and context; with places also (k, place): the text's key, and the rest of the key and the position."""
    names = ["q", "c", "k", "place"] if places else ["q", "c"]
    for batch in batches:
        rows: list[list] = [[] for _ in names]
        n = 0
        for _, part in _each(batch, 0):
            if len(part) < LENGTH:
                continue
            at, h, c = anchors(part)
            rows[0].append(h)
            rows[1].append(c)
            if places:
                k, more = text_key(part.tobytes())
                rows[2].append(np.full(len(at), k, np.int64))
                rows[3].append((more << 32) + at)
            n += len(at)
            if n > 1 << 16:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in rows], names)
                rows, n = [[] for _ in names], 0
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in rows], names)


def _edge_contexts(batches):
    """Rows of (text, at[], q[], c[]) to the contexts of these anchors, in batches of bounded size."""

    def batch_of(parts):
        q, c, left, size, raw = (np.concatenate(x) for x in zip(*parts, strict=True))
        offsets = np.zeros(len(size) + 1, np.int32)
        np.cumsum(size, out=offsets[1:])
        raw = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])
        return pa.RecordBatch.from_arrays([pa.array(q), pa.array(c), pa.array(left.astype(np.int32)), raw], ["q", "c", "left", "raw"])

    release_memory()
    for batch in batches:
        first = batch.column(1).offsets.to_numpy()
        at, q, c = (batch.column(i).values.to_numpy() for i in (1, 2, 3))
        parts, n = [], 0
        for r, part in _each(batch, 0):
            for lo in range(first[r], first[r + 1], EDGES):
                some = slice(lo, min(lo + EDGES, first[r + 1]))
                parts.append((q[some], c[some], *context_bytes(part, at[some])))
                n += some.stop - lo
                if n >= EDGES:
                    yield batch_of(parts)
                    parts, n = [], 0
        if parts:
            yield batch_of(parts)


def _string_ids(q: np.ndarray, left: np.ndarray, raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each context and offset o of 0..100 bytes before the anchor: the identifier of the string that begins there, and whether the context has it whole."""
    n = len(raws)
    flat = np.zeros((n, LENGTH - GRAM + LENGTH), np.uint8)
    lens = np.fromiter(map(len, raws), np.int64, n)
    pad = (LENGTH - GRAM) - left  # the anchor always stands at column 100
    cols = np.arange(flat.shape[1])
    flat[(cols >= pad[:, None]) & (cols < (pad + lens)[:, None])] = np.frombuffer(b"".join(raws), np.uint8)
    h = identifiers(flat.reshape(-1), LENGTH)
    row = np.arange(n)[:, None] * flat.shape[1]
    o = np.arange(SPAN)
    begin = row + (LENGTH - GRAM) - o
    ids = mix(mix(h[begin] + q.view(np.uint64)[:, None]) + o.astype(np.uint64))
    whole = (o <= left[:, None]) & ((LENGTH - GRAM) - o + LENGTH <= (pad + lens)[:, None])
    return ids, whole


def _offsets(batches, finish: bool):
    """Contexts, sorted by q, to (q, c, offsets) of strings that two contexts of the bucket have; with finish false to (q, c, o, id) of all."""
    held: list[tuple] = []

    def settle(rows):
        q = np.array([x[0] for x in rows], np.int64)
        for lo in range(0, len(rows), 4096) if not finish else [0]:
            part = rows[lo : lo + 4096] if not finish else rows
            ids, whole = _string_ids(q[lo : lo + len(part)], np.array([x[2] for x in part], np.int64), [x[3] for x in part])
            r, o = np.nonzero(whole)
            if not finish:
                yield pa.RecordBatch.from_arrays([pa.array(q[lo + r]), pa.array([part[i][1] for i in r.tolist()], pa.int64()), pa.array(o.astype(np.int32)), pa.array(ids[r, o].view(np.int64))], ["q", "c", "o", "id"])
                continue
            _, inverse, count = np.unique(ids[r, o], return_inverse=True, return_counts=True)
            again = count[inverse] > 1
            r, o = r[again], o[again]
            names, first = np.unique(r, return_index=True)
            lists = np.split(o.astype(np.int32), first[1:]) if len(names) else []
            yield pa.RecordBatch.from_arrays([pa.array(q[names]), pa.array([part[i][1] for i in names.tolist()], pa.int64()), pa.array([x.tolist() for x in lists], pa.list_(pa.int32()))], ["q", "c", "offsets"])

    for batch in batches:
        held += zip(*(x.to_pylist() for x in batch.columns), strict=True)
        if finish and held:
            cut = next((i for i in range(len(held) - 1, 0, -1) if held[i][0] != held[i - 1][0]), 0)
            while cut > 0:  # buckets are complete up to here
                step = cut if cut <= 8192 else next((i for i in range(8192, cut) if held[i][0] != held[i - 1][0]), cut)
                yield from settle(held[:step])
                held, cut = held[step:], cut - step
        elif held:
            yield from settle(held)
            held = []
    if held:
        yield from settle(held)


def ranges(n: int, whole: list[int], edges: list[tuple[int, list[int]]]) -> list[tuple[int, int]]:
    """United covered byte ranges of a text of n bytes."""
    found = [(a - min(a, LENGTH - GRAM), min(n, a + LENGTH)) for a in whole]
    found = [(x, y) for x, y in found if y - x >= LENGTH]
    found += [(a - o, a - o + LENGTH) for a, os in edges for o in os]
    out: list[list[int]] = []
    for x, y in sorted(found):
        if out and x <= out[-1][1]:
            out[-1][1] = max(y, out[-1][1])
        else:
            out.append([x, y])
    return [tuple(x) for x in out]


def _cut(batches, texts: bool = False):
    for batch in batches:
        rows = []
        for r, part in _each(batch, 1):
            text = part.tobytes()
            hit = batch.column(2)[r].as_py() or []
            spans = ranges(len(text), [x["at"] for x in hit if x["offsets"] is None], [(x["at"], x["offsets"]) for x in hit if x["offsets"] is not None])
            kept, at = [], 0
            for x, y in spans:
                kept.append(text[at:x])
                at = y
            kept = b"".join([*kept, text[at:]])
            rows.append((len(text), len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept))
        cols = list(zip(*rows, strict=True)) if rows else [()] * 5
        arrays = [batch.column(0), *(pa.array(x, pa.int64()) for x in cols[:3]), pa.array(cols[3], pa.string())]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        if texts:
            arrays, names = [*arrays, pa.array(cols[4], pa.binary())], [*names, "kept"]
        yield pa.RecordBatch.from_arrays(arrays, names)


def _with_key(batches):
    for batch in batches:
        keys = np.array([text_key(part.tobytes()) for _, part in _each(batch, 1)], np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys[:, 0]), pa.array(keys[:, 1])], ["doc_id", "text", "k", "more"])


def remove_repeats(docs: DataFrame, texts: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and with texts=True the kept bytes, `kept`)."""
    docs = docs.select("doc_id", "text")
    only = docs.select("text")
    grams = only.mapInArrow(lambda it: _anchor_rows(it, False), "q long, c long").groupBy("q").agg(F.count("*").alias("n"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("n > 1")
    buckets = stored(grams.select("q", (F.col("lo") != F.col("hi")).alias("mixed")))

    anchor = only.mapInArrow(lambda it: _anchor_rows(it, True), "q long, c long, k long, place long")
    # stored before it is counted, so that the counting is dealt by place and a bucket of very many anchors can be split
    repeated = stored(anchor.join(buckets, "q"))
    hits = stored(repeated.groupBy("k", "place", "q", "c", "mixed").agg(F.count("*").alias("n")))  # copies of a text meet here
    counts = stored(hits.where("mixed").groupBy("q", "c").agg(F.sum("n").alias("n"), F.min(F.struct("k", "place")).alias("first")))
    single = counts.where("n = 1").select("q").distinct()
    edges = counts.join(single, "q", "left_semi")  # contexts of buckets that are not settled
    more, at = F.shiftright("place", 32), F.expr("place & 4294967295")
    key = ["k", "more"]
    places = edges.select("first.k", "first.place", "q", "c").groupBy("k", more.alias("more")).agg(F.collect_list(F.struct(at.alias("at"), "q", "c")).alias("a"))
    keyed = docs.mapInArrow(_with_key, "doc_id long, text string, k long, more long")
    raw = (
        keyed.join(places, key).groupBy(*key).agg(F.first("text").alias("text"), F.first("a").alias("a")).select("text", "a.at", "a.q", "a.c")
        .mapInArrow(_edge_contexts, "q long, c long, left int, raw binary")
    )
    raw = stored(raw)
    wide = stored(raw.groupBy("q").agg(F.count("*").alias("w")).where(F.col("w") > WIDE).select("q"))
    some = raw.join(wide, "q", "left_anti").repartition("q").sortWithinPartitions("q").mapInArrow(lambda it: _offsets(it, True), "q long, c long, offsets array<int>")
    if not wide.isEmpty():
        each = stored(raw.join(wide, "q", "left_semi").mapInArrow(lambda it: _offsets(it, False), "q long, c long, o int, id long"))
        again = each.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id")
        some = some.unionByName(each.join(again, "id").groupBy("q", "c").agg(F.collect_list("o").alias("offsets")))
    settled = counts.where("n > 1").select("q", "c", F.lit(None).cast("array<int>").alias("offsets"))
    of_context = settled.unionByName(some.join(counts.where("n > 1"), ["q", "c"], "left_anti"))
    whole = hits.where("not mixed").select("k", "place", F.lit(None).cast("array<int>").alias("offsets"))
    part = hits.where("mixed").join(of_context, ["q", "c"]).select("k", "place", "offsets")
    marks = stored(whole.unionByName(part).groupBy("k", more.alias("more")).agg(F.collect_list(F.struct(at.alias("at"), "offsets")).alias("marks")))
    discard(buckets, repeated, hits, counts, raw, wide)
    done = keyed.join(marks, key, "left").select("doc_id", "text", "marks")
    return done.mapInArrow(lambda it: _cut(it, texts), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * texts)


def op5_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
