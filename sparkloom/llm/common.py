"""Shared plumbing: table access, checkpoints, and numpy kernels over Arrow text buffers."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U = np.uint64
#: Text is handled in groups of whole rows of about this many bytes, which bounds a task's memory.
GROUP_BYTES = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # small Arrow batches bound the memory of Python workers, as texts may be long; a smaller setting stays
    most = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(most)) <= 2000:
        spark.conf.set(most, "2000")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder's path in the folder the cluster names in spark.checkpoint.dir.

    Only a local session without that setting (tests) gets a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = f"file://{_local_folder()}"
    return f"{named}/sparkloom-{uuid.uuid4().hex}"


@functools.cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="sparkloom-")


def stored(df: DataFrame) -> DataFrame:
    """Cut lineage: write df as a compressed table in the shared folder and read it again. What discard() leaves goes when the driver ends."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    df.write.option("compression", "zstd").parquet(folder)
    out = spark.read.schema(df.schema).parquet(folder)
    out._stored_in = folder
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    spark.sparkContext._jvm.System.gc()  # lets Spark delete shuffle files that only the cut lineage needed
    return out


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores put before it until no column of df has it."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def discard(*dfs: DataFrame) -> None:
    """Delete stored tables that nothing later reads."""
    for df in dfs:
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._stored_in)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Tables of fixed width are broadcast up to this many bytes of the hash table that the driver builds; beyond it, they are shuffled.
BROADCAST_BYTES = 16 << 20
_WIDTHS = {"binary": 24}
#: Of each row beside its columns: headers (24), the key once more (at most 32), slots in an array at most a quarter full (64).
_ROW_BYTES = 120


def bounded(df: DataFrame) -> DataFrame:
    """`df`, to be broadcast if the hash table of its counted rows is small enough; binary columns are 128-bit keys."""
    width = _ROW_BYTES + sum(_WIDTHS.get(kind, 64 if kind == "string" else 8) for _, kind in df.dtypes)
    return F.broadcast(df) if df.count() * width <= BROADCAST_BYTES else shuffled(df)


def shuffled(df: DataFrame) -> DataFrame:
    """`df`, to be shuffled in a join. Else Spark broadcasts what is small as compressed files or rows, of which the driver's hash table takes many times as much."""
    return df.hint("merge")


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Smallest node of each connected component: columns (node, label), for nodes that have an edge.

    Rounds of minimum-label hooking and pointer jumping; every step is a combinable
    aggregation or an equi-join, and each round's labels are stored.
    """
    both = stored(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).unionByName(edges.select(F.col(b).alias("u"), F.col(a).alias("v"))).where("u <> v").distinct())
    labels = stored(both.groupBy(F.col("u").alias("node")).agg(F.least(F.col("u"), F.min("v")).alias("label")))
    while True:
        few = bounded(labels)
        near = both.join(few.select(F.col("node").alias("v"), "label"), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("near"))
        near = few.join(near, "node").select("node", "label", F.least("label", "near").alias("near"))
        # hook: a node's old label learns of the smaller one
        hooks = near.where("near < label").groupBy(F.col("label").alias("node")).agg(F.min("near").alias("hook"))
        hooked = stored(near.join(shuffled(hooks), "node", "left").select("node", "label", F.least("near", F.coalesce("hook", "near")).alias("near")))
        jump = bounded(hooked.select(F.col("node").alias("near"), F.col("near").alias("up")))
        new = stored(hooked.join(jump, "near", "left").select("node", F.col("label").alias("old"), F.least("near", F.coalesce("up", "near")).alias("label")))
        discard(hooked, labels)
        labels = new.select("node", "label")
        labels._stored_in = new._stored_in
        if new.where("old <> label").isEmpty():
            discard(both)
            return labels


def release_memory() -> None:
    """Give what this worker has freed, also in earlier tasks, back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries keep what is freed
        ctypes.CDLL("libc.so.6").malloc_trim(0)


# ---------------------------------------------------------------- Arrow text


def text_buffers(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column (nulls: empty), and the n + 1 offsets of its rows."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_binary())
    if col.null_count:
        col = col.fill_null(b"")
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def row_groups(offsets: np.ndarray, most: int = GROUP_BYTES):
    """Ranges of whole rows of about `most` bytes."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi
        lo = hi


_rng = np.random.Generator(np.random.PCG64(20240229))
BYTE_CODE = _rng.integers(1, 2**63, 256, np.uint64) | U(1)
BASE = int(_rng.integers(1, 2**62, dtype=np.uint64)) * 2 + 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)
WORD_MULT = _rng.integers(1, 2**63, 8, np.uint64) | U(1)
_powers: dict[int, np.ndarray] = {}


def _powers_of(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16, 0 if have is None else 2 * len(have))
        p = np.full(size, base & (2**64 - 1), np.uint64)
        p[0] = 1
        _powers[base] = have = np.multiply.accumulate(p)
    return have[:n]


def prefix_hash(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums s and inverse powers p: the hash of data[i:j] is (s[j] - s[i]) * p[i], modulo 2**64."""
    n = len(data)
    s = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE_CODE[data] * _powers_of(BASE, n), out=s[1:])
    return s, _powers_of(BASE_INVERSE, n + 1)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(32))
    h = h * U(0xD6E8FEB86659FD93)
    h ^= h >> U(29)
    h *= U(0x9E3779B97F4A7C15)
    return h ^ (h >> U(32))


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


class Words:
    """Words of a group of texts: byte starts and ends, hashes, and the row range [first[r], first[r + 1])."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray):
        base = offsets[0]
        data = lower_ascii(data[base : offsets[-1]])
        self.data, self.offsets = data, offsets - base
        w = np.zeros(len(data) + 2, bool)
        w[1:-1] = is_word[data]
        begins, ends = w[1:] & ~w[:-1], ~w[1:] & w[:-1]  # at byte i: a word begins; a word has ended
        inner = self.offsets[1:-1]
        cut = inner[w[inner] & w[inner + 1]] if len(inner) else inner  # words never cross rows
        begins[cut] = True
        ends[cut] = True
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends)
        self.first = np.searchsorted(self.start, self.offsets)
        s, p = prefix_hash(data)
        self.hash = mix((s[self.end] - s[self.start]) * p[self.start] + (self.end - self.start).astype(np.uint64))


#: Words `[^\x20\x09-\x0D]+` and `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, by byte; bytes of 128 and more belong to words.
SPACED = np.array([not (b == 32 or 9 <= b <= 13) for b in range(256)])
LETTERS = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])


def shingle_hashes(w: Words, row: int, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of a row's word shingles; of the whole sequence if it has fewer words."""
    h = w.hash[w.first[row] : w.first[row + 1]]
    n = len(h)
    if not n:
        return h
    take = min(n, size)
    out = np.full(n - take + 1, take, np.uint64)
    for k in range(take):
        out += h[k : n - take + 1 + k] * WORD_MULT[k]
    return np.unique(mix(out))
