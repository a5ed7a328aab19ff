"""Building an index of chunks with symbols and vectors, and searching it."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from intentlake.functions import text
from intentlake.functions.packing import DEFAULT_SIZE, chunk_source
from intentlake.functions.symbols import extract_symbols
from intentlake.operators import ranking
from intentlake.plans.runtime import store
from intentlake.sources.filetree import check_root, read_tree


@dataclass(frozen=True)
class IndexParams:
    chunk_size: int = DEFAULT_SIZE
    max_file_bytes: int = 1_000_000

    def __post_init__(self) -> None:
        if self.chunk_size < 1:
            raise ValueError("chunk_size must be at least 1")


_CHUNK = pa.struct([("content", pa.string()), ("start_line", pa.int64()), ("end_line", pa.int64())])
_SYMBOL = pa.struct([("name", pa.string()), ("kind", pa.string()), ("line", pa.int64())])


def _outliner(size: int | None, schema: list[str]):
    """Chunks (unless size is None) and symbols of each file, beside its other columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = list(zip(batch.column("source").to_pylist(), batch.column("language").to_pylist(), strict=True))
            made = [] if size is None else [pa.array([[vars(c) for c in chunk_source(s, n, size)] for s, n in pairs], pa.list_(_CHUNK))]
            made.append(pa.array([[{"name": a, "kind": b, "line": c} for a, b, c in extract_symbols(s, n)] for s, n in pairs], pa.list_(_SYMBOL)))
            kept = [c for name, c in zip(batch.schema.names, batch.columns, strict=True) if name != "source"]
            yield pa.RecordBatch.from_arrays([*kept, *made], names=schema)

    return run


def outline_files(files: DataFrame, size: int | None = DEFAULT_SIZE, keys: tuple[str, ...] = ("file_path",)) -> DataFrame:
    """keys, language, chunks, symbols of each file with (keys, language, source), in one pass without a shuffle.

    Without a size only the symbols are read. A null or blank source has no
    chunks, a language without rules no symbols.
    """
    rows = files.select(*keys, F.col("language").cast("string").alias("language"), F.col("source").cast("string").alias("source"))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "source"]
    made = {"chunks": "array<struct<content:string,start_line:bigint,end_line:bigint>>", "symbols": "array<struct<name:string,kind:string,line:bigint>>"}
    if size is None:
        del made["chunks"]
    return rows.mapInArrow(_outliner(size, [*keys, "language", *made]), ", ".join([*kinds, *[f"{k} {v}" for k, v in made.items()]]))


def chunk_files(files: DataFrame, size: int = DEFAULT_SIZE, keys: tuple[str, ...] = ("file_path",)) -> DataFrame:
    """keys, chunk_no, language, content, start_line, end_line, symbols: the chunks of each file with the names defined on their lines.

    As a chunk lies beside the symbols of its file already, they are attached
    by a filter of an array and not by a join.
    """
    flat = outline_files(files, size, keys).select(*keys, "language", "symbols", F.posexplode("chunks").alias("chunk_no", "c"))
    names = F.transform(F.filter("symbols", lambda s: s["line"].between(F.col("c.start_line"), F.col("c.end_line"))), lambda s: s["name"])
    return flat.select(*keys, F.col("chunk_no").cast("bigint").alias("chunk_no"), "language", "c.content", "c.start_line", "c.end_line", names.alias("symbols"))


def symbols_of(files: DataFrame, keys: tuple[str, ...] = ("file_path",)) -> DataFrame:
    """keys, language, name, kind, line of each definition."""
    return outline_files(files, None, keys).select(*keys, "language", F.explode("symbols").alias("s")).select(*keys, "language", "s.name", "s.kind", "s.line")


def attach_symbols(chunks: DataFrame, symbols: DataFrame, keys: tuple[str, ...] = ("file_path",), chunk_key: tuple[str, ...] = ("chunk_no",)) -> DataFrame:
    """Chunks with the names of the symbols on their lines, in their order; none is an empty array.

    The general range join, for tables of chunks and symbols: an equi-join on
    the file's key with the lines as a residual test. Two chunks that share a
    line both get its symbols. A null key matches nothing.
    """
    spans = chunks.select(*keys, *chunk_key, "start_line", "end_line")
    named = symbols.select(*keys, F.col("name").alias("_name"), F.col("line").alias("_line"))
    hit = spans.join(named, list(keys)).where(F.col("_line").between(F.col("start_line"), F.col("end_line")))
    lists = hit.groupBy(*keys, *chunk_key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_line", "_name"))), lambda s: s["_name"]).alias("symbols"))
    plain = chunks.drop("symbols") if "symbols" in chunks.columns else chunks
    return plain.join(lists, [*keys, *chunk_key], "left").withColumn("symbols", F.coalesce("symbols", F.array().cast("array<string>")))


def index_stats(chunks: DataFrame) -> DataFrame:
    """One row: files with chunks, chunks, and chunks per language (nulls left out) as a map."""
    by_language = chunks.groupBy("language").agg(F.count("*").alias("n"))
    languages = by_language.where("language is not null").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("language", "n")))).alias("languages"))
    totals = chunks.agg(F.countDistinct("file_path").alias("indexed_files"), F.count("*").alias("total_chunks"))
    return totals.crossJoin(languages)  # one row each


RESULT_KEYS = ["path_key", "chunk_no"]


class Index:
    """Chunks with vectors, to be searched many times; hold it in memory or on disk with persist() or save()."""

    def __init__(self, chunks: DataFrame, encoder) -> None:
        self._chunks, self.encoder = chunks, encoder

    @classmethod
    def from_path(cls, spark: SparkSession, root: str, encoder, extensions: list[str] | None = None, ignore: list[str] | None = None, text_files: bool = False, params: IndexParams | None = None, require_git: bool = True) -> Index:
        """Index of a folder; an error if it is none, or if no file in it has a chunk."""
        params = params or IndexParams()
        root = check_root(root)
        files = read_tree(spark, root, extensions=extensions, ignore=ignore, textFiles=text_files, maxBytes=params.max_file_bytes, requireGit=require_git)
        index = cls.from_files(files, encoder, params).stored()
        if index._chunks.select("chunk_no").limit(1).isEmpty():
            raise ValueError(f"No supported files found under {root}")
        return index

    @classmethod
    def from_files(cls, files: DataFrame, encoder, params: IndexParams | None = None) -> Index:
        """Index of a table with file_path, language, source."""
        chunks = chunk_files(files, (params or IndexParams()).chunk_size)
        return cls(encoder.encode(chunks, "content").withColumn("path_key", F.split("file_path", "/")), encoder)

    def stored(self) -> Index:
        """The index with its rows written to the shared folder, so that no later use walks or chunks again."""
        return Index(store(self._chunks), self.encoder)

    def persist(self) -> Index:
        self._chunks = self._chunks.persist()
        return self

    def save(self, path: str) -> None:
        self._chunks.write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, encoder) -> Index:
        return cls(spark.read.parquet(path), encoder)

    @property
    def chunks(self) -> DataFrame:
        """All chunks in the order of the walk."""
        return self._chunks.drop("embedding").orderBy(*RESULT_KEYS).drop("path_key")

    def stats(self) -> DataFrame:
        return index_stats(self._chunks)

    def file_mapping(self) -> DataFrame:
        """Chunk numbers of each file."""
        return self._chunks.groupBy("file_path").agg(F.array_sort(F.collect_list("chunk_no")).alias("chunks"))

    def language_mapping(self) -> DataFrame:
        """Chunks per language, null left out."""
        return self._chunks.where("language is not null").groupBy("language").count()

    def search(self, query: str, top_k: int = 10, params: ranking.SearchParams | None = None, languages: list[str] | None = None, paths: list[str] | None = None) -> DataFrame:
        """chunk (a struct), score, match_lines, best first; no rows for a blank query."""
        params = params or ranking.SearchParams()
        rows = self._chunks.limit(0) if not query.strip() else ranking.selected(self._chunks, languages, paths)
        found = ranking.hybrid_search(rows, self.encoder.encode_one(query), query, top_k, params, RESULT_KEYS)
        chunk = F.struct("content", "file_path", "start_line", "end_line", "language").alias("chunk")
        return found.orderBy("place").select(chunk, "score", "match_lines", text.location(F.col("file_path"), F.col("start_line"), F.col("end_line")).alias("location"))


def result_json(results: DataFrame) -> str:
    """The results as one line of JSON, in their order; match_lines only where there are any."""
    full = F.to_json(F.struct("chunk", "score", "match_lines"), {"ignoreNullFields": "false"})
    bare = F.to_json(F.struct("chunk", "score"), {"ignoreNullFields": "false"})
    rows = results.select(F.when(F.size("match_lines") > 0, full).otherwise(bare).alias("j")).collect()  # at most top_k
    return "[" + ",".join(r.j for r in rows) + "]"
