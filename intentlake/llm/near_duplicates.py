"""Problem 3: near-duplicate records by SuperMinHash, banding, verification and union-find."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from intentlake.llm.components import components
from intentlake.llm.superminhash import U, bands, mix, shingles, signatures
from intentlake.plans.runtime import spread, store

#: Slots of a band, and bands. A pair of similarity s shares a band with probability 1 - (1 - s**3)**24: 0.997 at 0.6.
ROWS, BANDS = 3, 24
#: Classes in a bucket from which they are compared by rare shingles and not pair by pair.
HOT_BUCKET = 1000
#: Of the byte-equal copies of a text the first so many, by id, stand for it: every record is paired with these of each text that is similar to its own.
REPRESENTATIVES = 100

SIGNED = pa.schema([("id", pa.int64()), ("class", pa.binary()), ("n", pa.int32()), ("shingles", pa.list_(pa.int32())), ("bands", pa.list_(pa.int64())), ("text", pa.binary())])
SIGNED_DDL = "id bigint, class binary, n int, shingles array<int>, bands array<bigint>, text binary"


def sign_batch(ids: pa.Array, texts: list[str], hashes: pa.Array, width: int, least: int) -> pa.RecordBatch:
    owner, elements = shingles(texts, width, least)
    count = len(texts)
    offsets = np.searchsorted(owner, np.arange(count + 1)).astype(np.int32)
    has = np.flatnonzero(np.diff(offsets))
    sums = np.zeros((count, 2), U)
    with np.errstate(over="ignore"):
        np.add.at(sums[:, 0], owner, mix(elements + U(1)))
        np.add.at(sums[:, 1], owner, mix(elements + U(0x5851F42D4C957F2D)))
    keys = bands(signatures(owner, elements, count, ROWS * BANDS), ROWS)[has]
    sizes = np.diff(offsets)[has].astype(np.int32)
    short = (elements >> U(32)).astype(np.uint32).view(np.int32)
    starts = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return pa.RecordBatch.from_arrays(
        [
            ids.take(pa.array(has)),
            pa.array([sums[i].tobytes() for i in has], pa.binary()),
            pa.array(sizes),
            pa.ListArray.from_arrays(pa.array(starts), pa.array(short)),
            pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS, dtype=np.int32)), pa.array(keys.ravel())),
            hashes.take(pa.array(has)),
        ],
        schema=SIGNED,
    )


def _signer(width: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                yield sign_batch(part.column(0), part.column(1).to_pylist(), part.column(2), width, least)

    return run


def signed(records: DataFrame, id_column: str, text_column: str, width: int, least: int) -> DataFrame:
    """id, class, n, shingles, bands, text of every record with at least `least` tokens, written once.

    class is a 128-bit fingerprint of the set of shingles: records of one class
    have similarity 1 and are compared with others only once. shingles are the
    set's hashes, cut to 32 bits for verification: of two sets of a hundred,
    one pair of different shingles in 400,000 sets falls together. text is a
    128-bit hash of the bytes, which tells the texts of a class apart.
    """
    rows = records.select(F.col(id_column).cast("bigint").alias("id"), F.col(text_column).alias("text")).where("id is not null and text is not null")
    rows = rows.withColumn("hash", F.unhex(F.md5(F.col("text").cast("binary"))))
    return store(spread(rows).mapInArrow(_signer(width, least), SIGNED_DDL))


def prefix_pairs(sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b, na, nb): candidates among sets (class, n, s), exactly all that can reach the threshold.

    Two sets of similarity t share one of the n - ceil(t n) + 1 rarest members
    of each (prefix filter), so what all sets have in common brings none
    together unless they consist of it.
    """
    members = sets.select("class", "n", F.explode("s").alias("g"))
    rarity = members.groupBy("g").agg(F.count("*").alias("df"))
    order = Window.partitionBy("class").orderBy("df", "g")  # a partition is one set
    kept = F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9) + 1
    prefix = members.join(rarity, "g").withColumn("r", F.row_number().over(order)).where(F.col("r") <= kept)
    return _meet(prefix.select("class", "n", F.col("g").alias("key")), threshold)


def _meet(posted: DataFrame, threshold: float) -> DataFrame:
    """Pairs of (class, n) that share a key, whose sizes allow the threshold; AQE splits a large key over tasks."""
    x = posted.select(F.col("class").alias("a"), F.col("n").alias("na"), "key")
    y = posted.select(F.col("class").alias("b"), F.col("n").alias("nb"), "key")
    fits = (F.col("a") < F.col("b")) & (F.least("na", "nb") >= threshold * F.greatest("na", "nb"))
    return x.join(y, "key").where(fits).select("a", "b", "na", "nb").distinct()


def class_pairs(rows: DataFrame, threshold: float, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """(a, b, similarity), a < b: pairs of classes at or above the threshold, verified on their sets.

    Classes are merged before banding, so a group of copies weighs no more than
    one record. The members of a bucket meet in an equi-join on the band's key
    that keeps only pairs whose sizes allow the threshold. Buckets of more than
    `hot_bucket` classes, as boilerplate makes them, take no part in it: their
    classes are compared by prefix_pairs(), which loses no pair either. Sets
    travel only for classes that are in a candidate pair.
    """
    classes = rows.groupBy("class").agg(F.any_value("n").alias("n"), F.any_value("bands").alias("bands"))
    posted = classes.select("class", "n", F.explode("bands").alias("key"))
    hot = store(posted.groupBy("key").count().where(F.col("count") > hot_bucket).select("key"))
    if hot.isEmpty():
        candidates = _meet(posted, threshold)
    else:
        boiler = posted.join(hot, "key", "left_semi").select("class").distinct()
        sets = rows.join(boiler, "class", "left_semi").groupBy("class").agg(F.any_value("n").alias("n"), F.any_value("shingles").alias("s"))
        candidates = _meet(posted.join(hot, "key", "left_anti"), threshold).unionByName(prefix_pairs(sets, threshold)).distinct()
    candidates = store(candidates)
    needed = candidates.select(F.explode(F.array("a", "b")).alias("class")).distinct()
    sets = rows.select("class", "shingles").join(needed, "class", "left_semi").groupBy("class").agg(F.any_value("shingles").alias("s"))
    both = candidates.join(sets.select(F.col("class").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("class").alias("b"), F.col("s").alias("sb")), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.select("a", "b", (shared / (F.col("na") + F.col("nb") - shared)).alias("similarity")).where(F.col("similarity") >= threshold)


def similar_pairs(records: DataFrame, id_column: str, text_column: str, threshold: float = 0.6, width: int = 3, least: int = 40, representatives: int = REPRESENTATIVES, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """(a, b), a < b: pairs of records with similarity at or above `threshold`.

    One rule at every size: a record is paired with the representatives of each
    text that is similar to its own, which is one of them; these are the first
    `representatives` byte-equal copies of the text by id. So all pairs come
    out among texts of up to so many copies, every record has its links with
    all similar texts however many share their shingles, and the pairs grow in
    proportion to the records where one text has very many copies.
    near_duplicate_groups() has one row per record instead. Null ids and texts
    and short texts take no part; a record that comes again counts once.
    """
    rows = signed(records, id_column, text_column, width, least)
    members = rows.groupBy("id", "class").agg(F.min("text").alias("text"))
    # each task passes on only the first of every text
    first = Window.partitionBy("class", "text").orderBy("id")
    standing = store(members.withColumn("n", F.row_number().over(first)).where(F.col("n") <= representatives).select("class", "id"))
    copies = store(members.select("class", "id").join(standing, ["class", "id"], "left_anti"))
    links = store(class_pairs(rows, threshold, hot_bucket).select("a", "b"))

    def meet(left: DataFrame, right: DataFrame) -> DataFrame:
        x, y = left.select(F.col("class").alias("a"), F.col("id").alias("x")), right.select(F.col("class").alias("b"), F.col("id").alias("y"))
        return links.join(x, "a").join(y, "b").select("x", "y")

    def within(left: DataFrame) -> DataFrame:
        return left.select("class", F.col("id").alias("x")).join(standing.select("class", F.col("id").alias("y")), "class").select("x", "y")

    pairs = meet(standing, standing).unionByName(within(standing).where("x < y"))
    if not copies.isEmpty():  # there are none where no text has so many
        pairs = pairs.unionByName(meet(copies, standing)).unionByName(meet(standing, copies)).unionByName(within(copies))
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def near_duplicate_groups(records: DataFrame, id_column: str, text_column: str, threshold: float = 0.6, width: int = 3, least: int = 40) -> DataFrame:
    """One row per record that takes part: id, class_id, group_id, links.

    class_id: smallest id with the same set of shingles; group_id: smallest id
    of the records connected by links at or above `threshold`; links: number of
    other classes its class is linked with. A record alone has its own id in
    both and no links. Copies are never expanded into pairs.
    """
    rows = signed(records, id_column, text_column, width, least)
    members = rows.select("id", "class").distinct()
    heads = store(members.groupBy("class").agg(F.min("id").alias("class_id")))
    links = class_pairs(rows, threshold).select("a", "b")
    named = (
        links.join(heads.select(F.col("class").alias("a"), F.col("class_id").alias("x")), "a")
        .join(heads.select(F.col("class").alias("b"), F.col("class_id").alias("y")), "b")
        .select(F.col("x").alias("a"), F.col("y").alias("b"))
    )
    named = store(named)
    groups = components(named)
    degree = named.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("links"))
    found = groups.select(F.col("node").alias("class_id"), F.col("component").alias("group_id")).join(degree, "class_id")
    return (
        members.join(heads, "class")
        .join(found, "class_id", "left")
        .select("id", "class_id", F.coalesce("group_id", "class_id").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
    )
