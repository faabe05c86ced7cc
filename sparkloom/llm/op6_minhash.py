"""MinHash near-dedup by a signature-coordinate inverted join.

A document's set is its distinct 5-word shingles (of fewer words: the whole sequence). Texts
with the same set form one class, so copies are never expanded into pairs. Every class is
posted under its (coordinate, MinHash value) pairs. Linked classes share at least MIN_MATCHES
of COORDS coordinates (at similarity 0.75 all but 4 in a million do), so they meet in one of
each other's COORDS - MIN_MATCHES + 1 rarest posts (prefix): posts of common passages drop out.
Pairs that share a post are candidates when the sizes allow the link, at least MIN_MATCHES
whole-signature coordinates collide and their odd sketches allow it; each is confirmed by exact
intersection of the full sets.

An odd sketch (Mitzenmacher, Pagh and Pham, 2014) holds the parities of a set's counts by hash bucket. Two
sketches differ in no more bits than their sets differ in shingles, so this test loses no link, while it rules
out nearly all pairs of a group of near copies that are somewhat too unlike.

1. Star round: each post's members are paired with one hub only, the member whose posts are the largest,
   which is the one nearest to the middle of a group of near copies; components are formed.
2. Rest: members of one post that are still in different components are paired, each pair in
   the first post that both have; a post's largest component is never paired with itself (skip merging).
   No post is cut, whatever its size. Pairs are confirmed in blocks of a post's members, so that a
   set is sent once for each block.

Defined cases: null, empty or blank texts have an empty set and are linked with nothing;
repeated rows and repeated doc_ids are one class if their sets agree, and each row gets its
row of the result; rows with a null doc_id take part, a component's id is its smallest
non-null doc_id; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from sparkloom.llm.common import SPACED, Words, bounded, connected, discard, fresh, mix, release_memory, row_groups, shingle_hashes, shuffled, stored, table, text_buffers

COORDS, MIN_MATCHES = 31, 12
#: Bits of an odd sketch.
PARITIES = 512
#: Shingles of one side of a block.
BLOCK = 65_536
PERCENT = 75
_MULT = np.random.Generator(np.random.PCG64(6)).integers(1, 2**63, COORDS, np.uint64) * np.uint64(2) + np.uint64(1)


def signature(h: np.ndarray) -> np.ndarray:
    """COORDS minimum hashes (int32) of a set of 64-bit hashes."""
    low = np.full(COORDS, 2**32 - 1, np.uint64)
    for lo in range(0, len(h), 1 << 13):
        low = np.minimum(low, ((mix(h[lo : lo + (1 << 13), None] * _MULT)) >> np.uint64(32)).min(axis=0))
    return low.astype(np.uint32).view(np.int32)


def odd_sketch(h: np.ndarray) -> np.ndarray:
    """Parities of a set's counts by hash bucket, packed in PARITIES / 64 longs."""
    parity = np.bincount((mix(h) >> np.uint64(55)).astype(np.int64) % PARITIES, minlength=PARITIES) & 1
    return np.packbits(parity.astype(np.uint8), bitorder="little").view(np.int64)


def _sets(batches, sets: bool):
    """Per row of (id, text): its set's key, size, and the signature and odd sketch, or the set itself."""
    release_memory()
    for batch in batches:
        data, offsets = text_buffers(batch.column(1))
        keys, sizes, lists, odd = [], [], [], []
        for lo, hi in row_groups(offsets):
            words = Words(data, offsets[lo : hi + 1], SPACED)
            for r in range(hi - lo):
                h = shingle_hashes(words, r)
                keys.append(xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None)
                sizes.append(len(h))
                lists.append(h.view(np.int64) if sets else signature(h) if len(h) else np.zeros(0, np.int32))
                if not sets:
                    odd.append(odd_sketch(h))
            if sets and sum(map(len, lists)) > 1 << 20:
                yield _batch(keys, sizes, lists, pa.int64())
                keys, sizes, lists = [], [], []
        if not sets:
            parities = _batch(keys, sizes, odd, pa.int64()).column(2)
            yield pa.RecordBatch.from_arrays([batch.column(0), *_batch(keys, sizes, lists, pa.int32()).columns, parities], ["doc_id", "key", "n", "sig", "odd"])
        elif keys:
            yield _batch(keys, sizes, lists, pa.int64())


def _batch(keys, sizes, lists, kind) -> pa.RecordBatch:
    offsets = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int32))
    values = pa.array(np.concatenate(lists) if lists else np.zeros(0), kind)
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(offsets, values)], ["key", "n", "items"])


def post_number() -> Column:
    """The (coordinate, value) pair as one long."""
    return F.shiftleft(F.col("c").cast("long"), 32) + F.col("v").cast("long")


def size_fits(a: Column, b: Column) -> Column:
    return 100 * F.least(a, b) >= PERCENT * F.greatest(a, b)


def matches(a: Column, b: Column) -> Column:
    """The number of coordinates at which two signatures collide; without lambdas, so that it is compiled."""
    return functools.reduce(Column.__add__, [(F.get(a, F.lit(i)) == F.get(b, F.lit(i))).cast("int") for i in range(COORDS)])


#: A packed signature: the low bytes of seven coordinates in each of WORDS longs, whose top byte is 0.
WORDS = -(-COORDS // 7)
_LOW, _HIGH = 0x007F7F7F7F7F7F7F, 0x0080808080808080


def packed(sig: str) -> list[Column]:
    """Columns w0 to w4 of a signature; filled up with zeros."""
    byte = lambda i: F.shiftleft(F.get(sig, F.lit(i)).bitwiseAND(255).cast("long"), 8 * (i % 7))
    return [functools.reduce(Column.bitwiseOR, [byte(i) for i in range(7 * w, min(7 * w + 7, COORDS))]).alias(f"w{w}") for w in range(WORDS)]


def packed_matches() -> Column:
    """The number of equal bytes of the packed signatures of a and b, no less than that of equal coordinates."""
    count = F.lit(COORDS - 7 * WORDS)  # what is filled up is always equal
    for w in range(WORDS):
        z = F.col(f"a.w{w}").bitwiseXOR(F.col(f"b.w{w}"))
        differs = (z.bitwiseAND(F.lit(_LOW)) + F.lit(_LOW)).bitwiseOR(z)  # the high bit of each byte that is not 0
        count = count + F.bit_count(F.bitwise_not(differs).bitwiseAND(F.lit(_HIGH)))
    return count


def parities(odd: str) -> list[Column]:
    """Columns o0 to o7 of an odd sketch."""
    return [F.get(odd, F.lit(i)).alias(f"o{i}") for i in range(PARITIES // 64)]


def sketches_allow(a: list[Column], b: list[Column], na: Column, nb: Column) -> Column:
    """Whether two odd sketches allow a link: a similarity of 3/4 means that 7 times the unshared shingles are at most na + nb."""
    differ = functools.reduce(Column.__add__, [F.bit_count(x.bitwiseXOR(y)) for x, y in zip(a, b, strict=True)])
    return 7 * differ <= na + nb


def prefix_posts(classes: DataFrame) -> DataFrame:
    """Each node's shared posts among its COORDS - MIN_MATCHES + 1 rarest: node, score, c, p.

    Posts are ordered by (size, number) for all nodes alike, and those of one node come first. The score grows with
    the sizes of all the node's posts.
    """
    post = classes.select("node", F.posexplode("sig").alias("c", "v")).select("node", "c", post_number().alias("p"))
    shared = post.groupBy("p").agg(F.count("*").alias("size")).where("size > 1")
    lists = post.join(shuffled(shared), "p").groupBy("node").agg(
        F.sort_array(F.collect_list(F.struct("size", "p", "c"))).alias("l"),  # at most COORDS each
        F.sum((16 * F.log2("size")).cast("long")).alias("score"),
    )
    quota = F.greatest(F.size("l") - (MIN_MATCHES - 1), F.lit(0))
    return lists.select("node", "score", F.explode(F.slice("l", F.lit(1), quota)).alias("x")).select("node", "score", "x.c", "x.p")


def plausible(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b, p, k) of nodes whose sizes allow a link and whose whole signatures collide often enough."""
    x = classes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa"), F.col("odd").alias("oa"))
    y = classes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb"), F.col("odd").alias("ob"))
    each = lambda x: [F.get(x, F.lit(i)) for i in range(PARITIES // 64)]
    ok = size_fits(F.col("na"), F.col("nb")) & (matches(F.col("sa"), F.col("sb")) >= MIN_MATCHES) & sketches_allow(each("oa"), each("ob"), F.col("na"), F.col("nb"))
    return pairs.join(shuffled(x), "a").join(shuffled(y), "b").where(ok).select("a", "b", "p", "k")


def _links(batches):
    """Rows sorted by block, sets (b is null) before pairs: the linked pairs."""
    release_memory()
    at, held, pending = None, {}, {}

    def linked():
        out = []
        for a, bs in pending.items():
            x = held[a]
            # copies of hashes are never in one set, so a sorted set's positions tell the members
            y = np.concatenate([held[b] for b in bs])
            pos = np.minimum(np.searchsorted(x, y), len(x) - 1)
            starts = np.cumsum([0] + [len(held[b]) for b in bs[:-1]])
            inter = np.add.reduceat((x[pos] == y).astype(np.int64), starts)
            size = np.array([len(held[b]) for b in bs], np.int64) + len(x)
            out += [(a, b) for b, ok in zip(bs, 100 * inter >= PERCENT * (size - inter)) if ok]
        pending.clear()
        return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64())], ["a", "b"])

    count = 0
    for batch in batches:
        blocks, a, b, items = batch.columns
        values, offsets = items.values.to_numpy(zero_copy_only=False), items.offsets.to_numpy()
        for i, (block, x, y) in enumerate(zip(blocks.to_pylist(), a.to_pylist(), b.to_pylist())):
            if block != at:
                if pending:
                    yield linked()
                at, held, count = block, {}, 0
            if y is None:
                held[x] = values[offsets[i] : offsets[i + 1]].view(np.uint64).copy()
            else:
                pending.setdefault(x, []).append(y)
                count += 1
                if count >= 1 << 16:
                    yield linked()
                    count = 0
    if pending:
        yield linked()


def confirmed(docs: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The links (a, b) among the stored pairs (a, b, p, k), by exact intersection.

    A pair is checked in a block of its post: each side's members are dealt over k parts of about BLOCK
    shingles, so that a set is sent once for each block and not once for each pair, and a task holds two parts.
    """
    part = lambda x: F.pmod(F.xxhash64(x), F.col("k"))
    pairs = pairs.select("a", "b", F.xxhash64("p", part("a"), part("b")).alias("block"))
    need = pairs.select("block", F.col("a").alias("node")).unionByName(pairs.select("block", F.col("b").alias("node"))).distinct()
    need = stored(need.join(bounded(classes.select("node", "key", "rep")), "node"))
    few = bounded(need.select(F.col("rep").alias("_rep")).distinct())
    texts = docs.join(few, docs["doc_id"].eqNullSafe(few["_rep"]), "left_semi").select("doc_id", "text")
    # a repeated doc_id may bring other texts along, or one twice: sets are found by key, and one of each is held
    sets = texts.mapInArrow(lambda it: _sets(it, True), "key binary, n long, items array<long>").join(bounded(need.select("key", "node", "block")), "key")
    sets = sets.select("block", F.col("node").alias("a"), F.lit(None).cast("long").alias("b"), "items")
    both = sets.unionByName(pairs.select("block", "a", "b", F.lit(None).cast("array<long>").alias("items")))
    both = both.repartition(F.col("block")).sortWithinPartitions("block", F.col("b").asc_nulls_first(), "a")
    out = stored(both.mapInArrow(_links, "a long, b long"))
    discard(need)
    return out


def components(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, key (of its set), n_shingles, label (of its component), component_id, kept. Without a set, key and label are null."""
    docs = docs.select("doc_id", "text")
    rows = stored(docs.mapInArrow(lambda it: _sets(it, False), "doc_id long, key binary, n long, sig array<int>, odd array<long>"))
    # once stored, node numbers stay
    classes = stored(
        rows.where("n > 0")
        .groupBy("key")
        .agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("odd").alias("odd"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    post = stored(prefix_posts(classes).join(bounded(classes.select("node", "n")), "node"))
    parts = F.ceil(F.sum("n") / BLOCK).alias("k")

    # star round
    hubs = post.groupBy("p").agg(F.count("*").alias("size"), F.max(F.struct("score", "node"))["node"].alias("hub"), parts).where("size > 1").drop("size")
    star = post.join(shuffled(hubs), "p").where("node <> hub").groupBy(F.col("node").alias("a"), F.col("hub").alias("b")).agg(F.min(F.struct("p", "k")).alias("m"))
    star = stored(plausible(star.select("a", "b", "m.p", "m.k"), classes))
    links = confirmed(docs, classes, star)
    first = connected(links)

    # rest: members of one post in different components
    named = post.join(bounded(first), "node", "left").select("node", "n", "c", "p", F.coalesce("label", "node").alias("comp"))
    by_comp = named.groupBy("p", "comp").agg(F.count("*").alias("size"), F.sum("n").alias("n"))
    mixed = by_comp.groupBy("p").agg(F.count("*").alias("comps"), F.max(F.struct("size", "comp"))["comp"].alias("main"), parts).where("comps > 1").drop("comps")
    active = stored(named.join(shuffled(mixed), "p"))
    posts = active.groupBy("node").agg(F.sort_array(F.collect_list("p")).alias("posts"))  # at most a prefix
    of_node = posts.join(shuffled(classes.select("node", *packed("sig"), *parities("odd"))), "node")
    member = active.join(shuffled(of_node), "node").withColumn("before", F.expr("slice(posts, 1, int(array_position(posts, p)) - 1)")).drop("posts")
    a, b = member.where("comp <> main").alias("a"), member.alias("b")
    once = ~F.arrays_overlap("a.before", "b.before")  # of the posts that both have, the first one pairs them
    other = (F.col("a.comp") != F.col("b.comp")) & ((F.col("b.comp") == F.col("b.main")) | (F.col("a.node") < F.col("b.node")))
    bits = lambda side: [F.col(f"{side}.o{i}") for i in range(PARITIES // 64)]
    alike = size_fits(F.col("a.n"), F.col("b.n")) & (packed_matches() >= MIN_MATCHES) & sketches_allow(bits("a"), bits("b"), F.col("a.n"), F.col("b.n"))
    pair = a.join(shuffled(b), (F.col("a.p") == F.col("b.p")) & other & alike & once)
    rest = stored(pair.select(F.col("a.node").alias("a"), F.col("b.node").alias("b"), F.col("a.p").alias("p"), F.col("a.k").alias("k")))
    discard(star, post, active)
    nodes = first
    if not rest.isEmpty():
        more = confirmed(docs, classes, rest)
        if not more.isEmpty():
            nodes = connected(links.unionByName(more))
    discard(rest)

    named = classes.select("key", "node", "rep").join(bounded(nodes), "node", "left").select("key", "rep", F.coalesce("label", "node").alias("label"))
    ids = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    of_key = stored(named.join(shuffled(ids), "label").select("key", "label", "component_id"))
    out = rows.where("n > 0").select("doc_id", "key", F.col("n").alias("n_shingles")).join(bounded(of_key), "key")
    empty = rows.where("n = 0").select("doc_id", "key", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("label"), F.col("doc_id").alias("component_id"))
    return out.unionByName(empty).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept."""
    return components(docs).select("doc_id", "n_shingles", "component_id", "kept")


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def with_keys(docs: DataFrame, name: str) -> DataFrame:
    """docs with the key of each row's set as column `name`."""

    def run(batches):
        for batch in batches:
            text = batch.column(batch.schema.get_field_index("text"))
            keys = [x.column(1) for x in _sets([pa.RecordBatch.from_arrays([text, text], ["doc_id", "text"])], False)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *keys], [*batch.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, BinaryType())]))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of each component stays: of the rows with its component_id, one with the smallest text. Rows without a set all stay.

    Rows are told by doc_id; where it is null or repeated, by the key of their set too. All columns are kept, whatever
    their names; an empty table gives no rows.
    """
    found = components(docs)
    key, kept_id, kept_key, label, rank, n = fresh(docs, "key", "kept_id", "kept_key", "label", "rank", "n")
    keep = found.where("kept").select(F.col("doc_id").alias(kept_id)).distinct()
    several = found.groupBy("doc_id").agg(F.count("*").alias(n)).where((F.col(n) > 1) | F.col("doc_id").isNull()).select(F.col("doc_id").alias(kept_id))
    several = stored(several)
    same = F.col("doc_id").eqNullSafe(F.col(kept_id))
    kept = docs.join(shuffled(keep), same, "left_semi")
    if several.isEmpty():
        return kept
    several = bounded(several)
    once = kept.join(several, same, "left_anti")
    keyed = with_keys(docs.join(several, same, "left_semi"), key)
    mine = found.where("kept and key is not null").select(F.col("doc_id").alias(kept_id), F.col("key").alias(kept_key), F.col("label").alias(label)).distinct()
    first = Window.partitionBy(label).orderBy("text", *[c for c in docs.columns if c not in ("doc_id", "text")])
    best = keyed.join(shuffled(mine), same & (F.col(key) == F.col(kept_key))).withColumn(rank, F.row_number().over(first)).where(F.col(rank) == 1)
    return once.unionByName(keyed.where(F.col(key).isNull()).select(docs.columns)).unionByName(best.select(docs.columns))
