"""Problem 6: find evaluation passages in a corpus with an FM-index per shard."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from intentlake.plans.runtime import spread

WORD = re.compile(r"[^\W_]+")
WORDS = 12
#: Words of one index; a longer shard is indexed in several parts, a longer document in one of its own.
SHARD_WORDS = 400_000
#: Every so many positions of the text the suffix array is kept.
SAMPLE = 16
#: Words of evaluation text in a slice that is sent to every executor, and in all slices together (about 200 MB).
PHRASE_WORDS, MOST_WORDS = 2_000_000, 30_000_000


def words(text: str) -> list[str]:
    """Maximal runs of letters and digits of the lower-cased text."""
    return WORD.findall(text.lower())


class WaveletMatrix:
    """Rank of any symbol at any position, by one bit vector per level."""

    def __init__(self, symbols: np.ndarray, levels: int) -> None:
        self.levels, self.zeros, self.ones = levels, [], []
        s = symbols
        for level in range(levels - 1, -1, -1):
            bit = (s >> level) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit, dtype=np.int32))).astype(np.int32))
            self.zeros.append(len(s) - int(self.ones[-1][-1]))
            s = np.concatenate((s[bit == 0], s[bit == 1]))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each `symbol` occurs before each position `at`."""
        low, high = np.zeros_like(at), at.copy()
        for k in range(self.levels):
            ones, zeros = self.ones[k], self.zeros[k]
            bit = (symbol >> (self.levels - 1 - k)) & 1
            l1, h1 = ones[low], ones[high]
            low = np.where(bit == 1, zeros + l1, low - l1)
            high = np.where(bit == 1, zeros + h1, high - h1)
        return high - low

    def access(self, at: np.ndarray) -> np.ndarray:
        symbol, i = np.zeros_like(at), at.copy()
        for k in range(self.levels):
            ones = self.ones[k]
            bit = ones[i + 1] - ones[i]
            symbol = (symbol << 1) | bit
            i = np.where(bit == 1, self.zeros[k] + ones[i], i - ones[i])
        return symbol


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of all suffixes, by prefix doubling; a shorter suffix comes first."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    width = 1
    while True:
        second = np.zeros(n, np.int64)
        second[: n - width] = rank[width:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
        rank = new
        width *= 2
        if width >= n or rank[order[-1]] == n - 1:
            return order


class FMIndex:
    """Backward search and location of phrases in one sequence of symbols above 0.

    The sequence is closed by the symbol 0, which occurs nowhere else.
    """

    def __init__(self, symbols: np.ndarray, sample: int = SAMPLE) -> None:
        text = np.concatenate((symbols, [0])).astype(np.int64)
        order = suffix_array(text)
        self.n = len(text)
        bwt = text[order - 1]
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text))))
        self.wavelet = WaveletMatrix(bwt, max(1, int(text.max()).bit_length()))
        kept = order % sample == 0
        self.kept = np.concatenate(([0], np.cumsum(kept))).astype(np.int32)
        self.positions = order[kept]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of the suffixes that begin with each row of `phrases`, all searched at once."""
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), self.n, np.int64)
        alive = np.arange(len(phrases))
        for step in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[alive, step]
            known = symbol < len(self.first) - 1
            high[alive[~known]] = low[alive[~known]]
            alive, symbol = alive[known], symbol[known]
            low[alive] = self.first[symbol] + self.wavelet.rank(symbol, low[alive])
            high[alive] = self.first[symbol] + self.wavelet.rank(symbol, high[alive])
            alive = alive[low[alive] < high[alive]]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions in the text of rows of the suffix array, by walking back to a kept position."""
        at, steps = rows.copy(), np.zeros(len(rows), np.int64)
        found = np.empty(len(rows), np.int64)
        alive = np.arange(len(rows))
        while len(alive):
            here = at[alive]
            hit = self.kept[here + 1] > self.kept[here]
            found[alive[hit]] = self.positions[self.kept[here[hit]]] + steps[alive[hit]]
            alive = alive[~hit]
            symbol = self.wavelet.access(at[alive])
            at[alive] = self.first[symbol] + self.wavelet.rank(symbol, at[alive])
            steps[alive] += 1
        return found


class Shard:
    """The FM-index of some documents' words: a symbol for each word that an evaluation text has too.

    Words of no evaluation text become the symbol 2, the end of a document the
    symbol 1; neither is part of a phrase.
    """

    def __init__(self, documents: list[tuple[int, list[str]]], symbols: dict[str, int]) -> None:
        self.documents = [d for d, _ in documents]
        parts, self.starts, at = [], [], 0
        for _, ws in documents:
            parts.append(np.fromiter((symbols.get(w, 2) for w in ws), np.int64, len(ws)))
            parts.append(np.ones(1, np.int64))
            self.starts.append(at)
            at += len(ws) + 1
        self.index = FMIndex(np.concatenate(parts))


class Phrases:
    """All runs of `n` words of some evaluation texts, as symbols of the alphabet given, which new words are added to."""

    def __init__(self, items: list[tuple[int, str]], symbols: dict[str, int], n: int = WORDS) -> None:
        by_phrase: dict[tuple[int, ...], set[int]] = {}
        for item, text in items:
            ids = [symbols.setdefault(w, len(symbols) + 3) for w in words(text)]
            for i in range(len(ids) - n + 1):
                by_phrase.setdefault(tuple(ids[i : i + n]), set()).add(item)
        self.table = np.array(sorted(by_phrase), np.int64).reshape(-1, n)
        self.items = [sorted(by_phrase[tuple(p)]) for p in self.table.tolist()]
        self.n = n

    def find(self, shard: Shard) -> Iterator[tuple[int, int, int, int]]:
        """(doc_id, item_id, first word, last word + 1), overlapping runs of an item merged."""
        low, high = shard.index.search(self.table)
        hits = np.flatnonzero(low < high)
        counts = high[hits] - low[hits]
        if not len(hits):
            return
        rows = np.repeat(low[hits], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        phrase = np.repeat(hits, counts)
        positions = shard.index.locate(rows)
        owner = np.searchsorted(shard.starts, positions, side="right") - 1
        spans: dict[tuple[int, int], list[int]] = {}
        for p, d, x in zip(phrase.tolist(), owner.tolist(), positions.tolist(), strict=True):
            for item in self.items[p]:
                spans.setdefault((d, item), []).append(x - shard.starts[d])
        for (d, item), found in spans.items():
            found.sort()
            begin = end = found[0]
            for x in found[1:] + [None]:
                if x is None or x > end + self.n:
                    yield shard.documents[d], item, begin, end + self.n
                    begin = x
                end = x


SPANS = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("first_word", pa.int64()), ("end_word", pa.int64())])


def _searcher(slices: list, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols: dict[str, int] = {}
        phrases = [p for p in (Phrases(one.value, symbols, n) for one in slices) if len(p.table)]
        shard: list[tuple[int, list[str]]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            index = Shard(shard, symbols)
            for part in phrases:
                found = list(zip(*part.find(index), strict=True))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], schema=SPANS)

        for batch in batches if phrases else ():
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ws = words(text)
                if len(ws) < n:
                    continue
                if shard and size + len(ws) > SHARD_WORDS:
                    yield from flush()
                    shard, size = [], 0
                shard.append((doc, ws))
                size += len(ws) + 1
        if shard:
            yield from flush()

    return run


def leaked_spans(documents: DataFrame, items: DataFrame, n: int = WORDS) -> DataFrame:
    """Spans of documents that an evaluation item holds too, of at least `n` words.

    documents: doc_id, text. items: item_id, text. Result: doc_id, item_id,
    first_word, end_word (word positions in the document, end exclusive);
    touching runs of the same item are merged, a span is reported for each item.

    Null and shorter texts never match. A document or an item that comes again
    gives the same rows again only if its key differs; equal rows come once.
    The evaluation texts are a fixed set of a size that is checked: more than
    MOST_WORDS words are an error. They are sent in slices of PHRASE_WORDS; a
    task builds the index of its own documents once and searches slice by
    slice, so the corpus is read once and never shuffled.
    """
    spark = documents.sparkSession
    corpus = spread(documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where(F.col("text").isNotNull()))
    # Items are read in order of their id, slice by slice, so the driver holds one slice at a time.
    slices: list = []
    part, size, total = [], 0, 0
    usable = items.select(F.col("item_id").cast("bigint"), "text").where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).distinct()
    for item, text in usable.sort("item_id", "text").toLocalIterator():
        length = len(words(text))
        if length < n:
            continue
        total += length
        if total > MOST_WORDS:
            raise ValueError(f"more than {MOST_WORDS} words of evaluation text; search for parts of it")
        if part and size + length > PHRASE_WORDS:
            slices.append(spark.sparkContext.broadcast(part))
            part, size = [], 0
        part.append((item, text))
        size += length
    slices.append(spark.sparkContext.broadcast(part))
    return corpus.mapInArrow(_searcher(slices, n), "doc_id bigint, item_id bigint, first_word bigint, end_word bigint").distinct()


def removal_spans(documents: DataFrame, items: DataFrame, n: int = WORDS) -> DataFrame:
    """Per document the word ranges to remove, merged over all items: doc_id, first_word, end_word.

    A range begins where no earlier span of the document reaches; touching ones
    are one. A window holds one document's spans.
    """
    spans = leaked_spans(documents, items, n).select("doc_id", "first_word", "end_word").distinct()
    order = Window.partitionBy("doc_id").orderBy("first_word", "end_word")
    reach = F.max("end_word").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = spans.withColumn("begins", F.coalesce(F.col("first_word") > reach, F.lit(True)).cast("int"))
    runs = begins.withColumn("run", F.sum("begins").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("doc_id", "run").agg(F.min("first_word").alias("first_word"), F.max("end_word").alias("end_word")).drop("run")
