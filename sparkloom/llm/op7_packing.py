"""Hierarchical multi-length packing of tokenized documents.

Each task streams its documents. A document's ids (with the end id) are routed to context-size
tiers: full windows of the longest tier at once, the rest to the smallest tier that holds it. Each
tier has windows of its own size, in which pieces are laid end to end best fit first; what a window lacks is
filled with pieces of shorter tiers, the last one cut where the window ends. A window still open at the end of a pool
is cut into sequences whose lengths are powers of two, the binary digits of what it holds, so no sequence
is padded. Sequences of equal length are dealt to step groups of GROUP_TOKENS ids, so that a step's
sequences cost the same.

The pool holds POOL_TOKENS ids, a bound on a task's memory besides its longest document; no piece
is dropped. Sequence ids are task number << 33 plus a running number, so they are
unique without a shuffle, and a lost task repeats them, as its rows come from the same file ranges.

Defined cases: null and empty texts are the end id alone; very long texts become many windows;
repeated rows are packed once each; null doc_ids are kept; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import contextlib
import functools
import re
import threading
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm.common import release_memory, row_groups, table, text_buffers

TIERS = (512, 1024, 2048, 4096)
END_ID = 2
POOL_TOKENS = 1 << 20
GROUP_TOKENS = 1 << 16
VOCABULARY = "word_bpe_49k.json"
#: Words kept with their ids by a worker (about 275 MB with their pieces); beyond it, the cache starts anew with the next group of texts.
CACHE_WORDS = 1_000_000
#: Bytes of texts tokenized at once, and pieces in one call of the tokenizer, which bound a worker's memory.
TEXT_BYTES, CALL_PIECES = 4 << 20, 8192
#: Seconds that an idle worker keeps its tokenizer and cache.
KEEP_SECONDS = 1.5
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, context_size int, step_group long"


def _class(kind: str) -> str:
    return "".join(f"\\u{c:04x}" for c in range(0x250) if unicodedata.category(chr(c))[0] == kind)


#: The vocabulary's own division of lower-case words, for characters below U+0250.
PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_class('L')}]+|[{_class('N')}]|[^\\s{_class('L')}{_class('N')}]+")


class FastTokenizer:
    """The tokenizer's ids, word by word from a cache where that is sure to be the same.

    The vocabulary's words never reach across white space. Texts that hold characters for which Python's
    lower-casing, white space or composition could differ from the tokenizer's, or the mark of a special
    token, go to the tokenizer as a whole.
    """

    SAFE = re.compile("[\\t\\n\\r\\x0b\\x0c -~\\u00a1-\\u00ac\\u00ae-\\u012f\\u0131-\\u0148\\u014a-\\u017e]*")

    def __init__(self, vocabulary: str, cache_words: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        self.cache_words = cache_words
        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.words: dict[str, bytes] = {"": b""}
        self.pieces: dict[str, bytes] = {}

    def learn(self, words: list[str]) -> None:
        """Cache the ids of new words, from those of the pieces that the vocabulary never merges across.

        One call encodes many new pieces: a token belongs to the piece it begins in.
        """
        cut = [(w, PIECES.findall(w)) for w in words if w not in self.words]
        unknown = list({x for _, parts in cut for x in parts if x not in self.pieces})
        for lo in range(0, len(unknown), CALL_PIECES):
            new = unknown[lo : lo + CALL_PIECES]
            found = self.tokenizer.encode(" ".join(new), add_special_tokens=False)
            ids = np.array(found.ids, np.uint32)
            begins = np.cumsum([0] + [len(w) + 1 for w in new])
            cuts = np.searchsorted(np.array([x for x, _ in found.offsets], np.int64), begins)
            raw, at = ids.tobytes(), (4 * cuts).tolist()
            self.pieces.update(zip(new, (raw[x:y] for x, y in zip(at, at[1:], strict=False)), strict=True))
        get = self.pieces.__getitem__
        for w, parts in cut:
            self.words[w] = get(parts[0]) if len(parts) == 1 else b"".join(map(get, parts))

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        plain = [i for i, t in enumerate(texts) if "<|" not in t and self.SAFE.fullmatch(t)]
        if len(self.words) > self.cache_words:
            self.words, self.pieces = {"": b""}, {}
        out: list = [None] * len(texts)
        if plain:
            split = pc.utf8_split_whitespace(pc.utf8_lower(pa.array([texts[i] for i in plain], pa.string())))
            bounds = split.offsets.to_numpy()
            coded = split.flatten().dictionary_encode()
            words, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
            self.learn(words)
            found = [self.words[w] for w in words]
            sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
            ids, first = np.frombuffer(b"".join(found), np.uint32), np.cumsum(sizes) - sizes
            each = sizes[codes]
            ends = np.concatenate(([0], np.cumsum(each)))
            flat = ids[np.repeat(first[codes] - ends[:-1], each) + np.arange(ends[-1])]
            for i, x, y in zip(plain, ends[bounds[:-1]].tolist(), ends[bounds[1:]].tolist(), strict=True):
                out[i] = flat[x:y]
        for i, t in enumerate(texts):
            if out[i] is None:
                out[i] = np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32)
        return out


@functools.lru_cache(1)
def tokenizer_of(path: str, cache_words: int) -> FastTokenizer:
    """One for a worker process, so that later tasks find its cache."""
    return FastTokenizer(path, cache_words)


def _release() -> None:
    tokenizer_of.cache_clear()
    release_memory()


_timers: list[threading.Timer] = []


@contextlib.contextmanager
def kept_tokenizer(path: str, cache_words: int):
    """The worker's tokenizer for one task. A worker that gets no further task of the kind soon gives its memory back."""
    while _timers:
        _timers.pop().cancel()
    release_memory()  # what earlier stages' tasks left
    try:
        yield tokenizer_of(path, cache_words)
    finally:
        timer = threading.Timer(KEEP_SECONDS, _release)
        timer.daemon = True
        _timers.append(timer)
        timer.start()


def _length(piece: tuple) -> int:
    return len(piece[2])


class Packer:
    """Pieces are (doc_id, start, ids, tokens of the document); closed windows come out as rows."""

    def __init__(self, task: int, tiers=TIERS):
        self.tiers, self.longest = tiers, tiers[-1]
        self.pools: dict[int, list] = {t: [] for t in tiers}
        self.pooled = 0
        self.number = task << 33
        self.groups: dict[int, list[int]] = {}
        self.group = task << 33
        self.rows: list[tuple] = []

    def add(self, doc_id, ids: np.ndarray) -> None:
        n, at = len(ids), 0
        while n - at >= self.longest:
            self.close([(doc_id, at, ids[at : at + self.longest], n)], self.longest)
            at += self.longest
        if at < n:
            tier = next(t for t in self.tiers if n - at <= t)
            self.pools[tier].append((doc_id, at, ids[at:], n))
            self.pooled += n - at
        if self.pooled >= POOL_TOKENS:
            self.drain()

    def close(self, pieces: list[tuple], size: int) -> None:
        group = self.groups.setdefault(size, [self.group, 0])
        if group[1] % GROUP_TOKENS == 0:
            self.group += 1
            group[0] = self.group
        group[1] += size
        offset = 0
        for doc_id, start, ids, n in pieces:
            self.rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), n, self.number, offset, size, group[0]))
            offset += len(ids)
        self.number += 1

    def drain(self) -> None:
        """Pack the pool: per tier, longest first, in windows of the tier's size; gaps are filled from shorter tiers."""
        for pool in self.pools.values():
            pool.sort(key=_length)  # pop() takes the longest; the order of equals is that of arrival
        order = self.tiers[::-1]
        for tier in order:
            pool = self.pools[tier]
            while pool:
                window, room = [], tier
                # long pieces of this tier first, then the longest piece that fits from any shorter tier
                while room:
                    piece = self.fitting(order[order.index(tier) :], room)
                    if piece is None:
                        break
                    window.append(piece)
                    room -= len(piece[2])
                if room and (rest := next((t for t in order[order.index(tier) :] if self.pools[t]), None)):
                    doc_id, start, ids, n = self.pools[rest].pop(0)  # the shortest that is too long: cut
                    window.append((doc_id, start, ids[:room], n))
                    self.put((doc_id, start + room, ids[room:], n))
                    room = 0
                if room:
                    self.close_open(window)
                else:
                    self.close(window, tier)
        self.pooled = 0

    def fitting(self, tiers, room: int):
        for t in tiers:
            pool = self.pools[t]
            if pool and (at := bisect.bisect_right(pool, room, key=_length)):
                return pool.pop(at - 1)
        return None

    def put(self, piece: tuple) -> None:
        bisect.insort_left(self.pools[next(t for t in self.tiers if len(piece[2]) <= t)], piece, key=_length)

    def close_open(self, window: list[tuple]) -> None:
        """Close a window that is not full as sequences of the powers of two that make up its length."""
        total = sum(len(x[2]) for x in window)
        at = 0
        for size in [1 << b for b in range(total.bit_length() - 1, -1, -1) if total >> b & 1]:
            part, room = [], size
            while room and at < len(window):
                doc_id, start, ids, n = window[at]
                part.append((doc_id, start, ids[:room], n))
                if len(ids) > room:
                    window[at] = (doc_id, start + room, ids[room:], n)
                    room = 0
                else:
                    room -= len(ids)
                    at += 1
            self.close(part, size)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 7 + [pa.int32(), pa.int64()]
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def pack(docs: DataFrame, vocabulary: str | None = None, tiers: tuple[int, ...] = TIERS, cache_words: int = CACHE_WORDS, text_bytes: int = TEXT_BYTES) -> DataFrame:
    """One row per piece; `vocabulary` is a path each executor can open, by default the installed public file.

    A smaller cache and smaller groups of texts save memory and cost time; the rows are the same.
    """

    def run(batches):
        path = vocabulary
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(VOCABULARY)
        packer = Packer(TaskContext.get().partitionId(), tiers)
        end = np.array([END_ID], np.uint32)
        with kept_tokenizer(path, cache_words) as tokens:
            for batch in batches:
                _, offsets = text_buffers(batch.column(1))
                ids = batch.column(0).to_pylist()
                for lo, hi in row_groups(offsets, text_bytes):
                    texts = [x or "" for x in batch.column(1).slice(lo, hi - lo).to_pylist()]
                    for doc_id, found in zip(ids[lo:hi], tokens(texts), strict=True):
                        packer.add(doc_id, np.concatenate((found, end)))
                if packer.rows:
                    yield _batch(packer.rows)
                    packer.rows = []
        packer.drain()
        if packer.rows:
            yield _batch(packer.rows)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
