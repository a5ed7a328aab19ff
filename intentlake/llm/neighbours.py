"""Problem 4: the k most similar vectors of every vector, by a permutation index."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from intentlake.operators.ranking import _best, batch_topk
from intentlake.plans.runtime import fresh_path, spread, store

#: Nearest pivots of a vector that make up its (cut) permutation, and the nearest of these under which it is posted.
PREFIX, POSTED = 6, 5
#: Vectors per pivot aimed at, and the bound of the pivots: the fitted sample, sent to all executors (at 64 x 4 bytes each, 64 MB at most).
PER_PIVOT, MAX_PIVOTS = 16, 1 << 18
#: Pivots of a cell, and the nearest cells whose pivots a vector is compared with.
PER_CELL, PROBES = 128, 64
#: Vectors are posted in steps of this part of 1, in two bytes a number: a cosine of posted vectors is off by about 0.00001.
STEP = 1 / 32767
#: Candidates by footrule of each vector in a posting list, reranked by cosine.
RERANK = 96
#: Postings of one pivot that one task compares, and how many at a time; longer lists are compared block by block.
BLOCK, AT_A_TIME = 8192, 1024
#: Cosine from which the index reaches its recall; a vector whose k-th neighbour by the index lies below is compared with all.
NEAR = 0.8
#: Vectors that are compared with all others at a time, sent to all executors (at 64 x 4 bytes each, 2 MB).
FAR_BLOCK = 8192

UNIT = pa.schema([("id", pa.int64()), ("class", pa.binary()), ("v", pa.list_(pa.float32()))])


def _units(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            m = np.asarray(column.flatten(), np.float64).reshape(len(column), width)
            norm = np.sqrt((m * m).sum(axis=1))
            ok = np.flatnonzero((norm > 0) & np.isfinite(norm))
            unit = (m[ok] / norm[ok, None]).astype(np.float32)
            classes = [hashlib.blake2b(row.tobytes(), digest_size=16).digest() for row in unit + np.float32(0)]
            starts = np.arange(0, unit.size + 1, width, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ok)), pa.array(classes, pa.binary()), pa.ListArray.from_arrays(pa.array(starts), pa.array(unit.ravel()))], schema=UNIT)

    return run


class Pivots:
    """The pivots in cells around every PER_CELL-th of them, so that a search compares with few of very many."""

    def __init__(self, pivots: np.ndarray) -> None:
        self.pivots = pivots
        self.centres = pivots[:: PER_CELL]
        cell = np.concatenate([np.argmax(pivots[at : at + 8192] @ self.centres.T, axis=1) for at in range(0, len(pivots), 8192)])
        self.order = np.argsort(cell, kind="stable")
        self.bounds = np.searchsorted(cell[self.order], np.arange(len(self.centres) + 1))

    def nearest(self, unit: np.ndarray, prefix: int) -> np.ndarray:
        """For each row the numbers of its nearest pivots, nearest first, among those of its PROBES nearest cells."""
        return np.concatenate([self._some(unit[at : at + 2000], prefix) for at in range(0, len(unit), 2000)]) if len(unit) else np.empty((0, prefix), np.int32)

    def _some(self, unit: np.ndarray, prefix: int) -> np.ndarray:
        if len(self.centres) <= PROBES:
            return top(unit @ self.pivots.T, np.arange(len(self.pivots), dtype=np.int32)[None, :], prefix)
        to_centres = unit @ self.centres.T
        probed = np.argpartition(-to_centres, PROBES - 1, axis=1)[:, :PROBES]
        best = np.full((len(unit), prefix), -2, np.float32)
        names = np.full((len(unit), prefix), -1, np.int32)
        rows = np.repeat(np.arange(len(unit)), PROBES)
        by_cell = np.argsort(probed.ravel(), kind="stable")
        cells, starts = np.unique(probed.ravel()[by_cell], return_index=True)
        for cell, mine in zip(cells, np.split(rows[by_cell], starts[1:]), strict=True):
            members = self.order[self.bounds[cell] : self.bounds[cell + 1]]
            if not len(members):
                continue
            s = np.hstack((best[mine], unit[mine] @ self.pivots[members].T))
            n = np.hstack((names[mine], np.broadcast_to(members.astype(np.int32), (len(mine), len(members)))))
            near = np.argpartition(-s, prefix - 1, axis=1)[:, :prefix]
            best[mine], names[mine] = np.take_along_axis(s, near, 1), np.take_along_axis(n, near, 1)
        return top(best, names, prefix)


def top(score: np.ndarray, names: np.ndarray, k: int) -> np.ndarray:
    """Names of the k greatest scores of each row, greatest first."""
    near = np.argpartition(-score, k - 1, axis=1)[:, :k]
    near = np.take_along_axis(near, np.argsort(-np.take_along_axis(score, near, 1), axis=1, kind="stable"), 1)
    return np.take_along_axis(np.broadcast_to(names, score.shape), near, 1).astype(np.int32)


def footrule(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Spearman's footrule between all cut permutations of x and y, absent pivots at the place after the last.

    sum |px - py| = L (L + 1) - 2 sum over shared pivots of min(L - px, L - py).
    """
    length = x.shape[1]
    shared = np.zeros((len(x), len(y)), np.uint8)
    for i in range(length):
        for j in range(length):
            shared += (x[:, i, None] == y[None, :, j]) * np.uint8(length - max(i, j))
    return (length * (length + 1) - 2 * shared.astype(np.int16)).astype(np.int16)


def best_in_block(x: dict, y: dict, same: bool, k: int, floor: float) -> list[tuple]:
    """(from, to, cosine) of the k best of y for each row of x, among the RERANK nearest by footrule."""
    if not len(x["id"]) or not len(y["id"]):
        return []
    distance = footrule(x["perm"], y["perm"])
    if same:
        np.fill_diagonal(distance, np.iinfo(np.int16).max)
    c = min(RERANK, len(y["id"]))
    near = np.argpartition(distance, c - 1, axis=1)[:, :c] if c < len(y["id"]) else np.broadcast_to(np.arange(c), (len(x["id"]), c))
    cosine = np.einsum("rd,rcd->rc", x["v"], y["v"][near])
    if same:
        cosine[near == np.arange(len(near))[:, None]] = -2
    take = min(k, c)
    top = np.argpartition(-cosine, take - 1, axis=1)[:, :take]
    score = np.take_along_axis(cosine, top, 1)
    rows, cols = np.nonzero(score >= max(floor, -1.5))
    return [(x["id"][rows], y["id"][np.take_along_axis(near, top, 1)[rows, cols]], score[rows, cols])]


def _poster(pivots, width: int, prefix: int, posted: int):
    schema = pa.schema([("id", pa.int64()), ("v", pa.binary()), ("perm", pa.binary()), ("pivots", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Pivots(pivots.value)
        for batch in batches:
            unit = np.asarray(batch.column(1).flatten(), np.float32).reshape(-1, width)
            perm = index.nearest(unit, prefix)
            under = np.ascontiguousarray(perm[:, :posted])
            starts = np.arange(0, under.size + 1, posted, dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r.tobytes() for r in np.round(unit / STEP).astype(np.int16)], pa.binary()), pa.array([r.tobytes() for r in perm], pa.binary()), pa.ListArray.from_arrays(pa.array(starts), pa.array(under.ravel()))],
                schema=schema,
            )

    return run


def _ranker(k: int, floor: float):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        _, i, j = key

        def sides(g: pd.DataFrame) -> list[dict]:
            ids, v, perm = g.id.to_numpy(), np.frombuffer(b"".join(g.v), np.int16).reshape(len(g), -1) * np.float32(STEP), np.frombuffer(b"".join(g.perm), np.int32).reshape(len(g), -1)
            return [{"id": ids[at : at + AT_A_TIME], "v": v[at : at + AT_A_TIME], "perm": perm[at : at + AT_A_TIME]} for at in range(0, len(g), AT_A_TIME)]

        found: list[tuple] = []
        if i == j:
            own = sides(pdf)
            for m, x in enumerate(own):
                for n, y in enumerate(own):
                    found += best_in_block(x, y, m == n, k, floor)
        else:
            for x in sides(pdf[pdf.block == i]):
                for y in sides(pdf[pdf.block == j]):
                    found += best_in_block(x, y, False, k, floor) + best_in_block(y, x, False, k, floor)
        parts = [np.concatenate(p) for p in zip(*found, strict=True)] or [np.zeros(0)] * 3
        return pd.DataFrame({"a": parts[0].astype(np.int64), "b": parts[1].astype(np.int64), "cosine": parts[2].astype(np.float64)})

    return run


def class_neighbours(classes: DataFrame, width: int, k: int, floor: float) -> DataFrame:
    """(a, b, cosine): for each distinct vector (id, v) up to k others, by the permutation index.

    Pivots are a hashed sample of the vectors themselves, so that dense regions
    get many of them and posting lists stay of a like length, about POSTED *
    PER_PIVOT, up to MAX_PIVOTS * PER_PIVOT vectors (4.2 million); beyond,
    lists grow with the vectors. The index holds every vector; only the pivots
    are a sample. A vector is sent once for each of its POSTED lists, unless
    one is longer than BLOCK.
    """
    spark = classes.sparkSession
    count = classes.count()
    wanted = max(1, min(MAX_PIVOTS, max(count // PER_PIVOT, min(count, 16))))
    # of a hashed selection about twice as large as needed the first by their hash, so that no task sorts or sends more
    chosen = F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 20)) < min(1 << 20, math.ceil((1 << 20) * 2 * wanted / max(1, count)) + 64)
    sample = classes.where(chosen).orderBy(F.xxhash64("id"), "id").limit(wanted).select("v").toArrow()
    pivots = np.asarray(sample.column(0).combine_chunks().flatten(), np.float32).reshape(-1, width)
    prefix = min(PREFIX, len(pivots))
    if not prefix:
        return spark.createDataFrame([], "a bigint, b bigint, cosine double")
    shared = spark.sparkContext.broadcast(pivots)
    posted = classes.select("id", "v").mapInArrow(_poster(shared, width, prefix, min(POSTED, prefix)), "id bigint, v binary, perm binary, pivots array<int>")
    posted = store(posted)
    lengths = posted.select(F.explode("pivots").alias("pivot")).groupBy("pivot").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).where("blocks > 1")
    lengths = F.broadcast(store(lengths))  # a list in 8192 postings at most, of at most MAX_PIVOTS
    lists = (
        posted.select("id", "v", "perm", F.explode("pivots").alias("pivot"))
        .join(lengths, "pivot", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        .withColumn("block", F.pmod(F.xxhash64("id", F.lit(3)), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("id", "v", "perm", "pivot", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    )
    found = lists.groupBy("pivot", "i", "j").applyInPandas(_ranker(k, floor), "a bigint, b bigint, cosine double")
    best = Window.partitionBy("a").orderBy(F.desc("cosine"), "b")
    merged = found.groupBy("a", "b").agg(F.max("cosine").alias("cosine"))
    return merged.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k).drop("place")


def _scanner(asked, k: int, width: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("cosine", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q, bound = asked.value
        least = bound.copy()
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        for batch in (b.slice(at, 512) for b in batches for at in range(0, b.num_rows, 512)):
            keys = batch.column(0).to_numpy()
            s = q @ np.asarray(batch.column(1).flatten(), np.float32).reshape(-1, width).T
            rows, cols = np.nonzero(s >= least[:, None])
            other = ids[rows] != keys[cols]
            rows, cols = rows[other], cols[other]
            held = _best(np.concatenate((held[0], rows)), np.concatenate((held[1], keys[cols])), np.concatenate((held[2], s[rows, cols])), k)
            counts = np.bincount(held[0], minlength=len(q))
            full = np.flatnonzero(counts == k)
            least[full] = held[2][np.cumsum(counts)[full] - 1]
        yield pa.RecordBatch.from_arrays([pa.array(ids[held[0]]), pa.array(held[1]), pa.array(held[2])], schema=schema)

    return run


def far_neighbours(classes: DataFrame, links: DataFrame, width: int, k: int) -> DataFrame:
    """(a, b, cosine): the k nearest others of each class whose k-th link lies below NEAR, by comparison with all.

    Far neighbours are close to random directions, which no permutation tells
    apart. The links of the index give each class the cosine that another must
    reach, so a task passes on hardly more than what is missing. The classes
    are asked in blocks of FAR_BLOCK; the work grows with the square of their
    number.
    """
    spark = classes.sparkSession
    ranked = links.groupBy("a").agg(F.sort_array(F.collect_list("cosine"), asc=False).alias("c"))  # a few links a class
    # a little below the k-th, whose cosine another product of the same numbers may round otherwise
    bound = ranked.select(F.col("a").alias("id"), (F.get("c", F.lit(k - 1)) - 1e-5).alias("least"))
    asked = store(classes.select("id", "v").join(bound, "id", "left").withColumn("least", F.coalesce("least", F.lit(-2.0))).where(F.col("least") < NEAR))
    blocks = math.ceil(asked.count() / FAR_BLOCK)
    path = fresh_path(spark)
    best = Window.partitionBy("a").orderBy(F.desc("cosine"), "b")
    for i in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(blocks)) == i).toArrow().combine_chunks()
        if not part.num_rows:
            continue
        q = np.asarray(part["v"].combine_chunks().flatten(), np.float32).reshape(-1, width)
        shared = spark.sparkContext.broadcast((part["id"].to_numpy(), q, part["least"].to_numpy().astype(np.float32)))
        found = spread(classes.select("id", "v")).mapInArrow(_scanner(shared, k, width), "a bigint, b bigint, cosine double")
        found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k).drop("place").write.mode("append").parquet(path)
        shared.unpersist()
    return spark.read.schema("a bigint, b bigint, cosine double").parquet(path) if blocks else spark.createDataFrame([], "a bigint, b bigint, cosine double")


def most_similar(vectors: DataFrame, id_column: str, vector_column: str, width: int = 64, k: int = 5, floor: float = -1.0, far: bool = True) -> DataFrame:
    """(id, neighbour, place, cosine): the k most similar other vectors of every usable vector.

    With a floor below NEAR, vectors that the index leaves with less than k
    neighbours of NEAR are compared with all others, unless `far` is off.

    Usable are vectors of `width` without nulls that aren't all zero; their
    length doesn't matter. Equal cosines go by the smaller id. Neighbours below
    `floor` are left out (the better ones keep their places). A row that comes
    again counts once. Equal vectors are indexed once: their first k + 1 ids
    stand for them, as no list can hold more of them, whatever their number.
    """
    usable = vectors.select(F.col(id_column).cast("bigint").alias("id"), F.col(vector_column).cast("array<float>").alias("v")).where(
        (F.size("v") == width) & F.col("id").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x))
    )
    rows = store(spread(usable).mapInArrow(_units(width), "id bigint, class binary, v array<float>"))
    classes = store(rows.groupBy("class").agg(F.min("id").alias("id"), F.any_value("v").alias("v")))
    members = store(rows.select("id", "class").distinct().join(classes.select("class", F.col("id").alias("head")), "class").select("id", "head"))
    order = Window.partitionBy("head").orderBy("id")
    first = members.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1).select("head", "id")
    links = class_neighbours(classes, width, k + 1, floor)
    if far and floor < NEAR:
        links = store(links)
        # the same pair comes from both; a product of its own may round otherwise
        links = links.unionByName(far_neighbours(classes, links, width, k).where(F.col("cosine") >= floor)).groupBy("a", "b").agg(F.max("cosine").alias("cosine"))
    links = links.unionByName(classes.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("cosine")))
    entry = F.struct((-F.col("cosine")).alias("down"), F.col("id").alias("id"))
    lists = links.join(first, F.col("b") == F.col("head")).groupBy("a").agg(F.slice(F.array_sort(F.collect_list(entry)), 1, k + 1).alias("list"))
    own = members.join(lists, F.col("head") == F.col("a")).select("id", F.slice(F.filter("list", lambda e: e["id"] != F.col("id")), 1, k).alias("list"))
    return own.select("id", F.posexplode("list").alias("p", "e")).select("id", F.col("e.id").alias("neighbour"), (F.col("p") + 1).cast("bigint").alias("place"), (-F.col("e.down")).alias("cosine"))


def measured_recall(vectors: DataFrame, id_column: str, vector_column: str, width: int = 64, k: int = 5, far: bool = False) -> DataFrame:
    """Recall of the index (with `far` of the whole operator) against brute force, per band of cosine: band, wanted, found, recall.

    Asked are the rows whose id is divisible by 100, against all rows; wanted
    are each one's k best by brute force, by the index all of most_similar().
    """
    usable = (
        vectors.select(F.col(id_column).cast("bigint").alias("id"), F.col(vector_column).cast("array<float>").alias("v"))
        .where((F.size("v") == width) & F.col("id").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x)) & F.exists("v", lambda x: x != 0))
        .groupBy("id")
        .agg(F.any_value("v").alias("v"))
    )
    asked = usable.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("query"))
    true = batch_topk(usable, asked, k + 1, "id", "v").where("key <> query_id").select(F.col("query_id").alias("id"), F.col("key").alias("neighbour"), "similarity")
    best = Window.partitionBy("id").orderBy(F.desc(F.round("similarity", 6)), "neighbour")
    true = true.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k)
    found = most_similar(vectors, id_column, vector_column, width, k, far=far).where("id % 100 = 0").select("id", "neighbour", F.lit(1).alias("hit"))
    bands = true.join(found, ["id", "neighbour"], "left").groupBy((F.floor(F.col("similarity") * 20 + 1e-9) / 20).alias("band"))
    return bands.agg(F.count("*").alias("wanted"), F.count("hit").alias("found")).withColumn("recall", F.round(F.col("found") / F.col("wanted"), 4))
