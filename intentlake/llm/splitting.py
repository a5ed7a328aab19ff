"""Problem 1: cut items larger than a limit into overlapping pieces at natural boundaries."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_SIZE = 1500

#: A run of word characters, of white space, or one other character.
TOKEN = re.compile(r"\w+|\s+|[^\w\s]")
SENTENCE_END = frozenset(".;!?}。")
PIECES = "array<struct<start:bigint,stop:bigint,start_line:bigint,end_line:bigint>>"


def boundaries(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Ends of all tokens (prefix sums of their lengths, sorted) and how natural each is.

    3: after a blank line; 2: after a line end; 1: after the space that follows
    a sentence or statement; 0: between any two tokens.
    """
    tokens = TOKEN.findall(text)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)))
    levels = np.zeros(len(tokens), np.int8)
    before = ""
    for i, token in enumerate(tokens):
        if token.isspace():
            lines = token.count("\n")
            if lines:
                # the cut goes behind the last line end, so that the indent stays with its line
                ends[i] -= len(token) - 1 - token.rindex("\n")
                levels[i] = 3 if lines > 1 else 2
            elif before in SENTENCE_END:
                levels[i] = 1
        before = token
    return ends, levels


def cut_points(text: str, size: int, overlap: int) -> list[tuple[int, int]]:
    """Pieces [start, stop) of at most `size` characters; each starts `overlap` before the last one's end.

    Among the boundaries within the limit the most natural level that occurs in
    the last half of the piece wins, then the last of them; a token longer than
    the piece is cut hard, though never between \\r and \\n. A size below 1
    counts as 1; the overlap is held below the size so that every piece brings
    something new; a negative overlap counts as none.
    """
    size = max(1, size)
    overlap = min(max(0, overlap), size - 1)
    if len(text) <= size:
        return [(0, len(text))] if text else []
    ends, levels = boundaries(text)
    by_level = [ends[levels >= level] for level in (3, 2, 1, 0)]
    pieces, start, reached = [], 0, 0
    while True:
        limit = start + size
        if limit >= len(text):
            pieces.append((start, len(text)))
            return pieces
        stop = limit
        for level, points in enumerate(by_level):
            floor = max(reached, start + size // 2) if level < 3 else reached
            k = int(np.searchsorted(points, limit, side="right")) - 1
            if k >= 0 and points[k] > floor:
                stop = int(points[k])
                break
        else:
            if text[stop - 1] == "\r" and text[stop] == "\n" and stop - 1 > reached:
                stop -= 1
        pieces.append((start, stop))
        start, reached = stop - overlap, stop


def _pieces(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for text, size, overlap, first in parts:
        rows = []
        for t, n, o, line in zip(text, size, overlap, first, strict=True):
            breaks = np.flatnonzero(np.frombuffer(t.encode("utf-32-le"), np.uint32) == 10)
            rows.append(
                [
                    (s, e, int(line) + int(np.searchsorted(breaks, s)), int(line) + int(np.searchsorted(breaks, max(e - 1, s))))
                    for s, e in cut_points(t, int(n), int(o))
                ]
            )
        yield pd.Series(rows)


def split_oversized(chunks: DataFrame, params: DataFrame) -> DataFrame:
    """Pieces of every chunk with more characters than its repository's limit.

    chunks: chunk_id, repo, content, start_line. params: repo, chunk_size,
    overlap_chars. Result: chunk_id, piece_no (from 0), n_pieces, char_start,
    char_end, start_line, end_line, content.

    A null content is never cut, an empty one is never too large. A null repo,
    a repo without parameters and a null chunk_size mean the default size; a
    null overlap means none, a null start_line means 1. A chunk that comes
    again is cut once; of several rows of parameters for one repo the smallest
    values hold. Other columns are ignored.
    """
    limits = params.groupBy(F.col("repo").alias("_repo")).agg(F.min("chunk_size").alias("_size"), F.min("overlap_chars").alias("_overlap"))
    large = (
        chunks.select("chunk_id", "repo", "content", "start_line")
        .where(F.col("content").isNotNull())
        .join(limits, F.col("repo") == F.col("_repo"), "left")
        .select("chunk_id", "content", F.coalesce("start_line", F.lit(1)).alias("first"), F.coalesce("_size", F.lit(DEFAULT_SIZE)).alias("size"), F.coalesce("_overlap", F.lit(0)).alias("overlap"))
        .where(F.length("content") > F.greatest("size", F.lit(1)))
        .dropDuplicates(["chunk_id"])
    )
    cut = large.select("chunk_id", "content", F.pandas_udf(_pieces, PIECES)("content", "size", "overlap", "first").alias("pieces"))
    return cut.select("chunk_id", "content", F.size("pieces").alias("n_pieces"), F.posexplode("pieces").alias("piece_no", "p")).select(
        "chunk_id",
        F.col("piece_no").cast("bigint").alias("piece_no"),
        F.col("n_pieces").cast("bigint").alias("n_pieces"),
        F.col("p.start").alias("char_start"),
        F.col("p.stop").alias("char_end"),
        F.col("p.start_line").alias("start_line"),
        F.col("p.end_line").alias("end_line"),
        F.expr("substring(content, int(p.start) + 1, int(p.stop - p.start))").alias("content"),
    )
