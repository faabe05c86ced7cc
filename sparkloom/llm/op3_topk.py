"""Exact top-k by inner product with a pivot-distance index.

Components are floor(256 x). Adding the coordinate sqrt(M - |x|^2), M the largest squared length,
makes the largest inner product the smallest distance: |q - x|^2 = |q|^2 + M - 2 q.x, with that
coordinate 0 for queries. Each distinct vector is keyed by its nearest pivot and its distance to it; a
pivot's vectors, sorted by that distance, are cut into annuli of at most BLOCK vectors. By the
triangle inequality nothing in an annulus [lo, hi] is nearer to q than the gap between |q - pivot| and
[lo, hi].

Queries are grouped into blocks by nearest pivot. Round 1 searches each block's nearest annuli and so
bounds each query's k-th score from below; round 2 visits, for each block, the annuli whose bound
reaches the lowest of its queries' k-th scores, nearest first, and passes over those that no query
needs any more. Scores are integers, computed by float64 products where all are below 2**53, otherwise
by Python's integers.

Equal vectors are one index entry with its k + 1 smallest distinct ids and the number of rows of each (an
own id leaves k others, so no more can be among k results), and equal queries are searched once, so groups
of copies do not pile up. Bounds and best lists count distinct ids too: an id with many rows takes one place,
and ranks are given after the own id is taken out. Only counts, the pivots (at most PIVOTS, from a bounded
sample), and M reach the driver.

Defined cases: vectors that are null or hold null or non-finite components take no part, nor rows
with a null vec_id; vectors are compared with those of their own length only, a length at a time; repeated vec_ids are
rows of their own, as in the SQL (the rows of one query id share its k ranks, where each of their pairs counts; a query's own row leaves by id, so all
rows of its id do); scores beyond a long are an error; ties go to the smaller vec_id; extra columns are ignored; an empty table gives no rows.
Components and scores beyond 64 bits count as the nearest 64-bit integer.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import stored, table

TOP, QUERY_MODULUS = 5, 50
#: Pivots come from the SAMPLE vectors with the smallest hashes; every vector is indexed.
PIVOTS, SAMPLE = 64, 4096
BLOCK, QUERY_BLOCK, SEEDS = 2048, 256, 2


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products; q and x are int64 matrices."""
    top = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(q.shape[1], 1)
    if top < 2**53:
        return np.rint(q.astype(float) @ x.T.astype(float)).astype(np.int64)
    exact = np.array([[sum(int(a) * int(b) for a, b in zip(r, s, strict=True)) for s in x] for r in q], object).reshape(len(q), len(x))
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


def quantized(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v): floor(256 x) of the vectors that take part."""
    v = F.col(vec_col).cast("array<double>")
    ok = F.col(vec_col).isNotNull() & F.col(id_col).isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(ok).select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: F.floor(x * 256).cast("long")).alias("v"))


def _pivots(distinct: DataFrame, m2: float) -> np.ndarray:
    """Up to PIVOTS spread-out vectors of a bounded sample (farthest first), with the added coordinate."""
    sample = distinct.select("v").orderBy(F.xxhash64("v"), "v").limit(SAMPLE).collect()
    x = np.array([r.v for r in sample], float).reshape(len(sample), -1)
    x = np.column_stack((x, np.sqrt(np.maximum(m2 - (x**2).sum(1), 0))))
    chosen, far = [0], ((x - x[0]) ** 2).sum(1)
    while len(chosen) < min(PIVOTS, len(x)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(1))
    return x[chosen]


def _distances(x: np.ndarray, extra: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    x = np.column_stack((x.astype(float), extra))
    d = (x**2).sum(1)[:, None] + (pivots**2).sum(1)[None] - 2 * x @ pivots.T
    return np.sqrt(np.maximum(d, 0))


def slack(m2: float, dim: int) -> float:
    """By how much the difference of two computed distances may be off: all vectors lie on a sphere of radius sqrt(m2), and a sum of dim + 1 products of such is off by a few units in its last places."""
    return 2 * float(np.sqrt(4 * m2 * (dim + 8) * 2.0**-52))


def _keyed(df: DataFrame, pivots: np.ndarray, m2: float, query: bool) -> DataFrame:
    """Adds `pivot` (the nearest) and `dist`."""

    def run(batches):
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["v"].to_numpy())
                d = _distances(x, np.zeros(len(x)) if query else np.sqrt(np.maximum(m2 - (x.astype(float) ** 2).sum(1), 0)), pivots)
                yield pdf.assign(pivot=d.argmin(1).astype("int32"), dist=d.min(1))

    return df.mapInPandas(run, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema)}, pivot int, dist double")


def _blocks(df: DataFrame, size: int) -> DataFrame:
    """Blocks of at most `size` rows of one pivot, in order of distance (annuli).

    Ranks come from per-range counts, so a pivot that holds most rows is not ranked in one task.
    """
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    part = stored(df.repartitionByRange(parts, "pivot", "dist", "v").sortWithinPartitions("pivot", "dist", "v").withColumn("part", F.spark_partition_id()))

    def cut(batches):  # a range's rows are in order: number them within (pivot)
        at: dict[int, int] = {}
        for pdf in batches:
            number = pdf.groupby("pivot").cumcount().to_numpy()
            pivot = pdf["pivot"].to_numpy()
            number = number + np.array([at.get(p, 0) for p in pivot], np.int64)
            for p, n in pd.Series(pivot).value_counts().items():
                at[p] = at.get(p, 0) + n
            yield pdf.assign(block=number // size)

    return part.mapInPandas(cut, part.schema.simpleString()[7:-1] + ", block: bigint").withColumn("block", F.xxhash64("pivot", "part", "block"))


def _last_needed(s: np.ndarray, ids: list[np.ndarray], k: int) -> np.ndarray:
    """Of each row of scores the one at which k + 1 distinct ids are reached, or the least."""
    flat, of = np.concatenate(ids), np.repeat(np.arange(len(ids)), [len(x) for x in ids])
    order = np.argsort(flat, kind="stable")
    first = np.flatnonzero(np.diff(flat[order], prepend=flat[order[0]] - 1))
    if len(first) < len(flat):  # an id in several entries counts once, with its best score
        s = np.maximum.reduceat(s[:, of[order]], first, axis=1)
    take = min(k + 1, s.shape[1])
    return np.partition(s, s.shape[1] - take, axis=1)[:, s.shape[1] - take]


def _search(pairs: DataFrame, queries: DataFrame, index: DataFrame, k: int, m2: float, pivots: np.ndarray) -> DataFrame:
    """Entries that hold the best k + 1 distinct ids of every query over the (qblock, block) pairs; one query block with one data block at a time."""

    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                q, x = np.stack(r.qv).astype(np.int64), np.stack(r.xv).astype(np.int64)
                d = _distances(q, np.zeros(len(q)), pivots[[r.pivot]])[:, 0]
                gap = np.maximum(np.maximum(r.lo - d, d - r.hi) - slack(m2, q.shape[1]), 0) * (1 - 1e-9)
                bound = ((q.astype(float) ** 2).sum(1) + m2 - gap**2) / 2 * (1 + 1e-12) + 1
                need = np.flatnonzero(bound >= np.array(r.floor, float))
                if not len(need):
                    continue
                s = _products(q[need], x)
                floor = np.array(r.floor, float)[need]
                best = _last_needed(s, r.ids, k)
                i, j = np.nonzero(s >= np.maximum(best, floor)[:, None])  # ties with the last are all kept: ids decide
                if len(i):
                    yield pd.DataFrame({"qid": np.array(r.qid)[need][i], "score": s[i, j], "ids": pd.Series([r.ids[t] for t in j], dtype=object), "ns": pd.Series([r.ns[t] for t in j], dtype=object)})

    joined = pairs.join(queries, "qblock").join(index, "block").select("qid", "qv", "floor", "xv", "ids", "ns", "pivot", "lo", "hi")
    return joined.mapInPandas(run, "qid long, score long, ids array<long>, ns array<long>")


def _best(found: DataFrame, k: int) -> DataFrame:
    """Per query vector the best (score, id, n), n rows each, as far as the k + 1 distinct ids that come first; `r` numbers an id's first row.

    Of one id no more than k are kept: none can be in k results.
    """
    rows = found.select("qid", "score", F.explode(F.arrays_zip("ids", "ns")).alias("x")).select("qid", "score", F.col("x.ids").alias("id"), F.col("x.ns").alias("n"))
    same = Window.partitionBy("qid", "id").orderBy(F.desc("score"))
    rows = rows.repartition(F.col("qid")).withColumn("t", F.row_number().over(same)).where(F.col("t") <= k)
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "id", "t").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("ids", F.sum((F.col("t") == 1).cast("int")).over(w)).where(F.col("ids") <= k + 1)
    return rows.withColumn("r", F.when(F.col("t") == 1, F.col("ids"))).drop("t", "ids")


def top_k(vectors: DataFrame, k: int = TOP, modulus: int = QUERY_MODULUS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score for every query row (id divisible by modulus)."""
    rows = stored(quantized(vectors, id_col, vec_col).groupBy("v", "id").agg(F.count("*").alias("n")))
    w = Window.partitionBy("v").orderBy("id")
    few = rows.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 1)
    entries = few.groupBy("v").agg(F.sort_array(F.collect_list(F.struct("id", "n"))).alias("x"))
    entries = stored(entries.select("v", F.col("x.id").alias("ids"), F.col("x.n").alias("ns"), F.size("v").alias("dim")))
    asked = rows.where(F.col("id") % modulus == 0).select(F.col("id").alias("query_id"), "v", F.col("n").alias("m"))
    out = None
    for dim in sorted(r.dim for r in entries.select("dim").distinct().collect()):
        part = _top_k_of(entries.where(F.col("dim") == dim).drop("dim"), asked.where(F.size("v") == dim), k)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    # a pair of rows each, of which k are enough
    each = out.withColumn("_", F.explode(F.sequence(F.lit(1), F.least(F.col("m") * F.col("n"), F.lit(k)).cast("int"))))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return each.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _top_k_of(entries: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """query_id, m, vec_id, score, n: the candidates of every query, without its own id; m rows ask, n rows are found."""
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    m2 = float(entries.agg(F.max(square)).first()[0])
    pivots = _pivots(entries, m2)
    index = _blocks(_keyed(entries, pivots, m2, False), BLOCK)
    index = stored(index.groupBy("block").agg(F.first("pivot").alias("pivot"), F.min("dist").alias("lo"), F.max("dist").alias("hi"), F.collect_list(F.struct("v", "ids", "ns")).alias("x"))).select("block", "pivot", "lo", "hi", "x.v", "x.ids", "x.ns").withColumnRenamed("v", "xv")
    # a number for each vector, as a repeated id may have several; once stored, it stays
    ask = stored(asked.select("v").distinct().withColumn("qid", F.monotonically_increasing_id()))
    blocks = _blocks(_keyed(ask, pivots, m2, True), QUERY_BLOCK).withColumnRenamed("block", "qblock")
    blocks = stored(blocks.select("qblock", "pivot", "dist", "qid", "v"))

    # round 1: each query block's nearest annuli of its own pivot, or of any where that has none
    annuli = index.select("block", F.col("pivot").alias("p"), "lo", "hi")
    heads = blocks.groupBy("qblock", "pivot").agg(F.avg("dist").alias("d"), F.first("v").alias("v"))

    def all_pivots(batches):
        for pdf in batches:
            if len(pdf):
                d = _distances(np.stack(pdf["v"].to_numpy()), np.zeros(len(pdf)), pivots)
                n = d.shape[1]
                yield pd.DataFrame({"qblock": np.repeat(pdf["qblock"].to_numpy(), n), "p": np.tile(np.arange(n, dtype="int32"), len(pdf)), "d": d.reshape(-1)})

    far = heads.select("qblock", "v").mapInPandas(all_pivots, "qblock long, p int, d double")
    gap = F.greatest(F.col("lo") - F.col("d"), F.col("d") - F.col("hi"), F.lit(0.0))
    near = Window.partitionBy("qblock").orderBy("gap", "lo", "block")
    seed = far.join(annuli, "p").withColumn("gap", gap).withColumn("r", F.row_number().over(near)).where(F.col("r") <= SEEDS).select("qblock", "block")
    packed = lambda df: df.groupBy("qblock").agg(F.collect_list(F.struct("qid", "v", "floor")).alias("q")).select("qblock", F.col("q.qid").alias("qid"), F.col("q.v").alias("qv"), F.col("q.floor").alias("floor"))
    found = stored(_search(seed, packed(blocks.withColumn("floor", F.lit(float("-inf")))), index, k, m2, pivots))
    floors = _best(found, k).where(F.col("r") == k + 1).select("qid", F.col("score").cast("double").alias("floor"))
    blocks = stored(blocks.join(floors, "qid", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf")))))

    # round 2: annuli that some query of the block may need; the block's queries lie in [dmin, dmax] from each pivot
    def reach(batches):
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["v"].to_numpy())
                d = _distances(x, np.zeros(len(x)), pivots)
                n = d.shape[1]
                # nearer than this, an entry could reach the query's floor
                r = np.sqrt(np.maximum((x.astype(float) ** 2).sum(1) + m2 - 2 * pdf["floor"].to_numpy(), 0)) * (1 + 1e-9) + slack(m2, x.shape[1])
                yield pd.DataFrame({"qblock": np.repeat(pdf["qblock"].to_numpy(), n), "p": np.tile(np.arange(n, dtype="int32"), len(x)), "a": (d - r[:, None]).reshape(-1), "b": (d + r[:, None]).reshape(-1)})

    want = blocks.select("qblock", "v", "floor").mapInPandas(reach, "qblock long, p int, a double, b double").groupBy("qblock", "p").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    pairs = want.join(annuli, "p").where((F.col("hi") >= F.col("a")) & (F.col("lo") <= F.col("b"))).select("qblock", "block").join(seed, ["qblock", "block"], "left_anti")
    more = _search(pairs, packed(blocks), index, k, m2, pivots)
    best = _best(found.unionByName(more), k)
    each = asked.join(ask, "v").select("query_id", "m", "qid").join(best, "qid").where(F.col("id") != F.col("query_id"))
    return each.select("query_id", "m", F.col("id").alias("vec_id"), "score", "n")


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
      FROM e q JOIN e c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
