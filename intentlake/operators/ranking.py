"""Ranking: top-k by cosine, selectors, definitions, weighted reciprocal rank fusion, score filters."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from intentlake.functions import text, vectors
from intentlake.plans.runtime import fresh_path


@dataclass(frozen=True)
class SearchParams:
    rrf_k: float = 60.0
    min_score_ratio: float = 0.12
    def_weight: float = 1.0
    candidate_multiplier: int = 5

    def __post_init__(self) -> None:
        if self.candidate_multiplier < 1:
            raise ValueError("candidate_multiplier must be at least 1")


def selected(chunks: DataFrame, languages: list[str] | None = None, paths: list[str] | None = None) -> DataFrame:
    """Rows of one of the languages or one of the paths; all rows if none qualifies.

    Whether any does is asked once, of the two key columns only.
    """
    test = F.lit(False)
    if languages:
        test |= F.coalesce(F.col("language").isin(languages), F.lit(False))
    if paths:
        test |= F.coalesce(F.col("file_path").isin(paths), F.lit(False))
    if not languages and not paths:
        return chunks
    hit = chunks.where(test)
    return chunks if hit.select(F.lit(1)).limit(1).isEmpty() else hit


def cosine_topk(rows: DataFrame, query: list[float], k: int, keys: list[str], vector: str = "embedding") -> DataFrame:
    """The k rows most similar to one vector, with `similarity`; ties by `keys`.

    The vector is a literal, so the scan feeds a partial top-k in each task.
    A null vector or one of another width never qualifies.
    """
    q = vectors.literal(query)
    scored = rows.where(F.size(vector) == len(query)).withColumn("similarity", vectors.cosine(F.col(vector), q))
    return scored.where("similarity is not null").orderBy(F.desc("similarity"), *keys).limit(k)


#: Queries that are sent to the executors at a time: with 64 dimensions two megabytes.
QUERY_BLOCK = 4096


def _best(query: np.ndarray, key: np.ndarray, similarity: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best entries of each query number, ties by the smaller key."""
    order = np.lexsort((key, -similarity, query))
    query, key, similarity = query[order], key[order], similarity[order]
    starts = np.searchsorted(query, query)
    keep = np.arange(len(query)) - starts < k
    return query[keep], key[keep], similarity[keep]


def _partial_topk(queries, k: int, width: int):
    schema = pa.schema([("query_id", pa.int64()), ("key", pa.int64()), ("similarity", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = queries.value
        least = np.full(len(q), -np.inf)
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        for batch in (b.slice(at, 512) for b in batches for at in range(0, b.num_rows, 512)):
            keys = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            m = np.asarray(batch.column(1).flatten(), np.float64).reshape(-1, width)
            length = np.sqrt((m * m).sum(axis=1))
            s = q @ (m / np.where(length > vectors.LEAST_NORM, length, 1.0)[:, None]).T
            # after a few batches hardly anything reaches what is held already
            rows, cols = np.nonzero(s >= least[:, None])
            held = _best(np.concatenate((held[0], rows)), np.concatenate((held[1], keys[cols])), np.concatenate((held[2], s[rows, cols])), k)
            counts = np.bincount(held[0], minlength=len(q))
            full = np.flatnonzero(counts == k)
            least[full] = held[2][np.cumsum(counts)[full] - 1]
        yield pa.RecordBatch.from_arrays([pa.array(ids[held[0]]), pa.array(held[1]), pa.array(held[2])], schema=schema)

    return run


def batch_topk(rows: DataFrame, queries: DataFrame, k: int, key: str, vector: str = "embedding", query_id: str = "query_id", query_vector: str = "query") -> DataFrame:
    """(query_id, key, similarity, rank): the k most similar rows for each of many query vectors.

    The stated queries meet all rows in blocks of QUERY_BLOCK, each a matrix
    product per batch of rows; a task passes on only k rows a query. With more
    than one block each has its k best written down before the next, so neither
    the driver nor a plan ever holds more than one. Null vectors take no part;
    a query meets the rows of its own width.
    """
    spark = rows.sparkSession
    asked = queries.select(F.col(query_id).cast("bigint").alias("id"), F.col(query_vector).cast("array<double>").alias("q")).where(F.size("q") > 0)
    best = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "key")

    def ranked(ids: np.ndarray, matrix: np.ndarray) -> DataFrame:
        width = matrix.shape[1]
        length = np.sqrt((matrix * matrix).sum(axis=1))
        shared = spark.sparkContext.broadcast((ids, matrix / np.where(length > vectors.LEAST_NORM, length, 1.0)[:, None]))
        usable = rows.where((F.size(vector) == width) & F.col(key).isNotNull() & ~F.exists(vector, lambda x: x.isNull()))
        part = usable.select(F.col(key).cast("bigint"), F.col(vector).cast("array<double>")).mapInArrow(_partial_topk(shared, k, width), "query_id bigint, key bigint, similarity double")
        return part.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("bigint"))

    blocks = _blocks(asked)
    first, second = next(blocks, None), next(blocks, None)
    if first is None:
        return spark.createDataFrame([], "query_id bigint, key bigint, similarity double, rank bigint")
    if second is None:
        return ranked(*first)
    path = fresh_path(spark)
    for block in chain((first, second), blocks):
        ranked(*block).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def _blocks(queries: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of QUERY_BLOCK queries (id, q) at a time, those of one width together; one with a null in it is left out."""
    widths = sorted(r.n for r in queries.select(F.size("q").alias("n")).distinct().collect())  # one row per width
    for width in widths:
        ids, block = [], []
        for row in queries.where((F.size("q") == width) & ~F.exists("q", lambda x: x.isNull())).toLocalIterator():
            ids.append(row.id)
            block.append(row.q)
            if len(block) == QUERY_BLOCK:
                yield np.array(ids, np.int64), np.array(block, float)
                ids, block = [], []
        if block:
            yield np.array(ids, np.int64), np.array(block, float)


def weighted_rrf(signals: DataFrame, keys: list[str], k: float = 60.0) -> DataFrame:
    """Sum of weight / (k + rank) over the signals (weight, rank from 1) of each key.

    A signal of weight 0 adds nothing, not even a key. Partial sums are made
    before the one shuffle, on the keys.
    """
    return signals.where(F.col("weight") != 0).groupBy(*keys).agg(F.sum(F.col("weight") / (F.lit(float(k)) + F.col("rank"))).alias("score"))


def definition_list(pool: DataFrame, names: Column, rank: str = "rank", partition: list[str] | None = None) -> DataFrame:
    """Rows of the pool whose symbols hold one of the names, ranked anew from 1 in the pool's order."""
    hit = pool.where(F.coalesce(F.arrays_overlap("symbols", names), F.lit(False)))
    order = Window.partitionBy(*(partition or [F.lit(0)])).orderBy(rank)
    return hit.withColumn("definition_rank", F.row_number().over(order).cast("bigint"))


def low_score_filter(results: DataFrame, ratio: float, partition: list[str] | None = None) -> DataFrame:
    """Results of at least `ratio` times the best score; a single result always stays, and none does if the best is not above 0."""
    everything = Window.partitionBy(*(partition or [F.lit(0)]))
    top, count = F.max("score").over(everything), F.count(F.lit(1)).over(everything)
    return results.withColumn("_top", top).withColumn("_count", count).where((F.col("_count") <= 1) | (F.col("_top") > 0) & (F.col("score") >= F.col("_top") * ratio)).drop("_top", "_count")


def fused(pool: DataFrame, names: Column, params: SearchParams, keys: list[str], top_k: int, partition: list[str] | None = None) -> DataFrame:
    """Pool rows (with rank, symbols) by fused score: `score`, `place`, cut to `top_k`.

    Equal to weighted_rrf() over the pool's ranking (weight 1) and the ranking
    of its definitions; as both run over the same few rows, two windows over
    the pool do without a join.
    """
    by = partition or [F.lit(0)]
    defines = F.coalesce(F.arrays_overlap("symbols", names), F.lit(False)).cast("int")
    marked = pool.withColumn("_defines", defines)
    place = F.sum("_defines").over(Window.partitionBy(*by).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    k = F.lit(float(params.rrf_k))
    score = F.lit(1.0) / (k + F.col("rank")) + F.when(F.col("_defines") == 1, F.lit(float(params.def_weight)) / (k + place)).otherwise(0.0)
    final = Window.partitionBy(*by).orderBy(F.desc("score"), *keys)
    return marked.withColumn("score", score).withColumn("place", F.row_number().over(final).cast("bigint")).where(F.col("place") <= top_k).drop("_defines")


def hybrid_search(rows: DataFrame, query: list[float], query_text: str, top_k: int, params: SearchParams, keys: list[str], vector: str = "embedding", contents: DataFrame | None = None) -> DataFrame:
    """Semantic pool, fusion with definitions, cut, matching lines, ratio filter.

    rows: keys, vector, symbols, content, start_line, further columns. Where
    content and start_line lie in a table of their own (keys, content,
    start_line, further columns), they are fetched for the best rows only; of
    rows that come again, told by loaded_at, the latest. A top_k of 0 has an
    empty pool and so no results.
    """
    pool = cosine_topk(rows, query, top_k * params.candidate_multiplier, keys, vector)
    ranked = pool.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("similarity"), *keys)))
    best = fused(ranked, text.query_names(F.lit(query_text)), params, keys, top_k)
    if contents is not None:
        best = contents.join(F.broadcast(best), keys)  # at most top_k rows
        if "loaded_at" in contents.columns:
            version = Window.partitionBy(*keys).orderBy(F.desc("loaded_at"), F.xxhash64("content"))
            best = best.withColumn("_version", F.row_number().over(version)).where("_version = 1").drop("_version", "loaded_at")
    shown = best.withColumn("match_lines", F.coalesce(text.match_lines(F.col("content"), F.col("start_line"), F.lit(query_text)), F.array().cast("array<struct<line:bigint,content:string>>")))
    return low_score_filter(shown, params.min_score_ratio)
