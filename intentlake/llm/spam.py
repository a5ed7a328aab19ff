"""Problem 8: keyword-stuffed and link-list pages, by robust distances over text features per language."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from intentlake.plans.runtime import spread, store

WORD = r"[^\W\d_]\w*"
SCHEME = r"(?:[Hh][Tt][Tt][Pp][Ss]?://|[Ff][Tt][Pp]://|[Ww][Ww][Ww]\.)"
URL = rf"<?{SCHEME}[^\s<>\"')\]]+>?"
#: Scripts written without spaces between words: each of their characters counts as one.
UNSPACED = r"぀-ヿ㐀-䶿一-鿿豈-﫿"
#: What a text consists of. No alternative reads past the bracket or line that ends it, so odd markup is read in one pass.
PARTS = re.compile(
    rf"(?P<word>[{UNSPACED}]|(?![HhFfWw](?:[Tt][Tt]?[Pp]|[Ww][Ww]\.)){WORD}|(?!{SCHEME}){WORD})|(?P<number>\d[\w.,]*)"
    r"|(?P<stop>(?<![.!?…])[.!?…]++(?=[\s<]|\Z)|[。！？।؟]+)|(?P<line>\n+)"
    rf"|(?P<link>!?\[[^\[\]\n]*\]\([^()\s]*\)|{URL})"
    r"|(?P<opened><[aA]\b[^<>]*>)|(?P<closed></[aA]\s*>)|(?P<markup></?[a-zA-Z][a-zA-Z0-9]*\b[^<>]*>)"
    r"|(?P<tag>(?<![\w/&])#[^\W\d]\w*)|(?P<field>[|/,;\t•·])|(?P<operator>[={}]|(?<=\w)\()|(?P<other>[^\s\w]|_)"
)
KIND = dict(PARTS.groupindex)
ONE_CHARACTER = re.compile(f"[{UNSPACED}]")

#: What the distance is taken over. Spam has more of each feature marked 1, less of each marked -1.
FEATURES = {"pushed": 1, "links": 1, "repetition": 1, "function_words": -1, "entropy": -1, "sentence_length": -1}
#: Share of a language's distinct texts that hold a word from which it is a function word, and the texts that a language needs.
FREQUENT, LEAST_TEXTS = 0.2, 30
#: Share of a text's words that are function words of a language from which the text is of that language, else of none.
RECOGNISED = 0.15
UNKNOWN = "?"
#: Words between two occurrences up to which a word counts as repeated, and occurrences of a pair of words that make both repeated.
NEARBY, PAIRS = 24, 3
#: Share of repeated words from which a stretch consists of keywords; for scripts of single characters, which recur more, the second.
STUFFED, STUFFED_CHARACTERS = 0.5, 0.75
#: Parts between the ends of a link that still make a title, and words beside a link in a segment that do.
TITLE, BESIDE = 25, 8


def repeated(group: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Whether each word (in order, by group) occurs again within NEARBY words of its group."""
    at = np.arange(len(code))
    order = np.lexsort((at, code, group))
    same = (code[order][1:] == code[order][:-1]) & (group[order][1:] == group[order][:-1]) & (np.diff(at[order]) <= NEARBY)
    hit = np.zeros(len(code), bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    return hit


def in_pairs(group: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Whether each word (in order, by group) stands in a pair of neighbours that its group has PAIRS times."""
    hit = np.zeros(len(code), bool)
    if len(code) > 1:
        pairs = pd.DataFrame({"g": group[:-1], "a": code[:-1], "b": code[1:]})
        often = (group[1:] == group[:-1]) & (pairs.groupby(["g", "a", "b"], sort=False)["g"].transform("size").to_numpy() >= PAIRS)
        hit[:-1] |= often
        hit[1:] |= often
    return hit


class Measure:
    """Features of many texts at once, with the function words that the corpus has taught for each language."""

    def __init__(self, known: dict[str, list[str]]) -> None:
        self.languages = sorted(known)
        self.known = {language: frozenset(words) for language, words in known.items()}

    def __call__(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language of each text, and its features (a row each, in the order of FEATURES).

        A text falls into segments at line ends, markup and closing marks. A
        segment is a sentence if it has at least four words and a closing mark,
        or eight words, if two of them and a seventh of all are function words,
        and if half of them or of the others aren't repeated.
        pushed is the share of the characters (without white space) in links
        with at most a title, in tags, in lists of labels between separators,
        and in what is no sentence and repeats its words or pairs of words.
        What is none of it (headings, program text, prose of a language that
        the corpus doesn't teach) counts for the whole only.
        """
        n = len(texts)
        kinds, sizes, spoken, lengths = [], [], [], []
        link, word = KIND["link"], KIND["word"]
        for text in texts:
            found = list(PARTS.finditer(text))
            lengths.append(len(found))
            kinds += [m.lastindex for m in found]
            sizes += [m.end() - m.start() - (m[0].count(" ") if m.lastindex == link else 0) for m in found]
            spoken += [m[0] for m in found if m.lastindex == word]
        kind, size = np.array(kinds, np.int8), np.array(sizes, np.int64)
        owner = np.repeat(np.arange(n), lengths)
        size[kind == KIND["line"]] = 0
        codes, words = pd.factorize(np.array([w.lower() for w in spoken], dtype=object)) if spoken else (np.zeros(0, np.int64), np.zeros(0, object))
        codes = codes.astype(np.int64)
        of_word = owner[kind == word]

        # links written as elements, with what stands between their ends
        opened, closed = np.flatnonzero(kind == KIND["opened"]), np.flatnonzero(kind == KIND["closed"])
        far = len(kind) + TITLE + 1
        ends = np.append(closed, far)[np.searchsorted(closed, opened)]
        paired = (ends < np.append(opened[1:], far)) & (ends - opened <= TITLE) if len(opened) else np.zeros(0, bool)
        paired[paired] &= owner[opened[paired]] == owner[ends[paired]]
        marks = np.zeros(len(kind) + 1, np.int64)
        marks[opened[paired]] += 1
        marks[ends[paired] + 1] -= 1
        linked = (np.cumsum(marks[:-1]) > 0) | (kind == link)

        # segments: a part that ends one belongs to it
        breaks = (kind == KIND["line"]) | (kind == KIND["stop"]) | (~linked & np.isin(kind, (KIND["markup"], KIND["opened"], KIND["closed"])))
        first = np.ones(len(kind), bool)
        first[1:] = breaks[:-1] | (owner[1:] != owner[:-1])
        segment = np.cumsum(first) - 1
        count = int(segment[-1]) + 1 if len(kind) else 0
        text_of = owner[first]

        # the language, by function words
        totals = np.maximum(1, np.bincount(of_word, minlength=n))
        best, language = np.zeros(n), np.full(n, -1)
        functional = np.zeros((len(self.languages) + 1, len(words)), bool)
        for i, name in enumerate(self.languages):
            functional[i] = np.fromiter((w in self.known[name] for w in words), bool, len(words))
            share = np.bincount(of_word, weights=functional[i][codes], minlength=n) / totals
            better = (share > best) & (share >= RECOGNISED)
            best[better], language[better] = share[better], i
        function_word = functional[language[of_word], codes] if len(codes) else np.zeros(0, bool)

        # words of segments
        in_segment = segment[kind == word]
        free = ~linked[kind == word]
        per = lambda values: np.bincount(in_segment, weights=values, minlength=count)
        n_words, n_function = per(free), per(free & function_word)
        content = np.flatnonzero(free & ~function_word)
        again = np.zeros(len(codes), bool)
        again[content] = repeated(in_segment[content], codes[content])
        n_content, n_again = n_words - n_function, per(again)
        everything = np.flatnonzero(free)
        again_any = np.zeros(len(codes), bool)
        again_any[everything] = repeated(in_segment[everything], codes[everything])
        varied = (2 * per(again_any) <= n_words) | (n_content >= 3) & (2 * n_again < n_content)
        closed_or_long = (n_words >= 8) | (np.bincount(segment, weights=kind == KIND["stop"], minlength=count) > 0)
        sentence = (n_words >= 4) & (n_function >= 2) & (7 * n_function >= n_words) & varied & closed_or_long

        # characters of segments
        chars = np.bincount(segment, weights=size, minlength=count)
        link_chars = np.bincount(segment, weights=size * linked, minlength=count)
        links = np.bincount(segment, weights=(kind == link) | (linked & (kind == KIND["opened"])), minlength=count)
        tags = np.bincount(segment, weights=size * (kind == KIND["tag"]), minlength=count)
        n_tags = np.bincount(segment, weights=kind == KIND["tag"], minlength=count)
        fields = np.bincount(segment, weights=(kind == KIND["field"]) & ~linked, minlength=count)
        code_like = 3 * np.bincount(segment, weights=(kind == KIND["operator"]) & ~linked, minlength=count) >= n_words
        code_like &= np.bincount(segment, weights=kind == KIND["operator"], minlength=count) > 0

        # words of what is neither sentence nor program text, over the whole text
        stream = np.flatnonzero(free & ~(sentence | code_like)[in_segment])
        keyword = np.zeros(len(codes), bool)
        keyword[stream] = repeated(of_word[stream], codes[stream]) | in_pairs(of_word[stream], codes[stream])
        single = np.fromiter((len(w) == 1 and bool(ONE_CHARACTER.match(w)) for w in words), bool, len(words))
        characters = per(single[codes] if len(codes) else np.zeros(0)) > 0.5 * n_words
        stuffed = (n_words > 0) & (per(keyword) >= np.where(characters, STUFFED_CHARACTERS, STUFFED) * n_words)
        listed = (fields >= 3) & (n_words <= 2.5 * (fields + 1))
        whole = ~sentence & ~code_like & (stuffed | listed)
        whole |= ~sentence & (links > 0) & (n_words <= BESIDE * links)
        marked = links + n_tags
        pushed = np.where(whole, chars, np.where(sentence & (4 * marked <= n_words), 0, link_chars + tags))

        # features of texts
        per_text = lambda values: np.bincount(text_of, weights=values, minlength=n)
        total = np.maximum(1, per_text(chars))
        counted = pd.DataFrame({"t": of_word, "c": codes}).groupby(["t", "c"], sort=False).size()
        who, often = counted.index.get_level_values(0).to_numpy(np.int64), counted.to_numpy(float)
        distinct = np.bincount(who, minlength=n)
        p = often / totals[who]
        entropy = np.bincount(who, weights=-p * np.log(p), minlength=n) / np.log(totals + 1)
        spoken_segments = per_text(n_words > 0)
        features = np.column_stack(
            [
                per_text(pushed) / total,
                per_text(link_chars) / total,
                np.where(distinct > 0, 1 - distinct / totals, 0),
                np.bincount(of_word, weights=function_word, minlength=n) / totals,
                np.where(distinct > 0, entropy, 0),
                per_text(n_words * sentence) / np.maximum(1, spoken_segments) / 20,
            ]
        )
        return [self.languages[i] if i >= 0 else UNKNOWN for i in language], features


def distinct_texts(documents: DataFrame) -> DataFrame:
    """k1, k2 (a 128-bit key), text, label of each distinct text with any, written once; label is its least declared language.

    Copies of a text are merged by an aggregate with a partial step, so a page
    of which there are very many is measured, and counted, once.
    """
    label = F.lower(F.substring(F.trim(F.col("lang").cast("string")), 1, 2))
    rows = documents.select(*_key(), "text", F.when(label != "", label).alias("label")).where(F.col("text").rlike(r"(?U)\S"))
    return store(rows.groupBy("k1", "k2").agg(F.any_value("text").alias("text"), F.min("label").alias("label")))


def _key() -> list:
    return [F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2")]


def function_words(texts: DataFrame) -> dict[str, list[str]]:
    """Words that at least FREQUENT of a declared language's distinct texts hold, for languages of LEAST_TEXTS texts.

    A text of a hundred different words can bring at most a few hundred such
    words to a language, whatever the corpus, so that the driver gets a list
    that doesn't grow. A text whose label is wrong doesn't matter unless such
    are a fifth of the language's.
    """
    labelled = texts.where("label is not null")
    sizes = {r.label: r.n for r in labelled.groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_TEXTS).collect()}  # one row per language
    if not sizes:
        return {}
    pattern = F.lit(rf"(?U)[{UNSPACED}]|{WORD}")
    words = labelled.where(F.col("label").isin(*sizes)).select("label", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), pattern, F.lit(0)))).alias("word"))
    least = F.lit(None).cast("double")
    for label, n in sizes.items():
        least = F.when(F.col("label") == label, FREQUENT * n).otherwise(least)
    known: dict[str, list[str]] = {label: [] for label in sizes}
    for r in words.groupBy("label", "word").agg(F.count("*").alias("n")).where(F.col("n") >= least).collect():
        known[r.label].append(r.word)
    return known


SCHEMA = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("lang", pa.string()), ("x", pa.list_(pa.float64()))])


def _features(known: dict[str, list[str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = Measure(known)
        for batch in batches:
            at = 0
            sizes = np.cumsum(np.fromiter(map(len, texts := batch.column(2).to_pylist()), np.int64, batch.num_rows))
            while at < batch.num_rows:  # about half a million characters at a time
                stop = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + 500_000)))
                languages, x = measure(texts[at:stop])
                starts = pa.array(np.arange(0, x.size + 1, len(FEATURES), dtype=np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0)[at:stop], batch.column(1)[at:stop], pa.array(languages, pa.string()), pa.ListArray.from_arrays(starts, pa.array(x.ravel()))], schema=SCHEMA)
                at = stop

    return run


#: Texts by which a language's own shape is known; with less it has the shape of all languages together.
LEAST_CORE = 30


def robust_shape(rows: DataFrame, languages: list[str]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Centre and inverse scatter of each language, robust against the outliers looked for.

    Spam has more than half of its text pushed, so only the other texts are
    fitted, each distinct one once: neither spam nor copies of a page can move
    the centre, whatever their share. First medians and median absolute
    deviations, then mean and covariance of the texts that lie within a fixed
    distance of the medians in every feature (a one-step reweighting). Both are
    aggregates; the driver gets a few numbers for each of the languages. A
    language with few such texts borrows the shape of all. Texts of no known
    language are a group of their own, and borrow all but the function words,
    of which they can have none. Where no text can be fitted there are no shapes.
    """
    d = len(FEATURES)
    at = lambda c, i: F.col(c)[i]
    rows = rows.where(F.col("x")[0] <= 0.5)
    middle = rows.groupBy("lang").agg(*[F.percentile_approx(at("x", i), 0.5, 10_000).alias(f"m{i}") for i in range(d)])
    centred = rows.join(F.broadcast(middle), "lang")  # one row per language
    scale = centred.groupBy("lang").agg(*[F.percentile_approx(F.abs(at("x", i) - F.col(f"m{i}")), 0.5, 10_000).alias(f"s{i}") for i in range(d)])
    widths = [F.greatest(1.4826 * F.col(f"s{i}"), F.lit(0.02)) for i in range(d)]
    near = F.lit(True)
    for i in range(d):
        near &= F.abs(at("x", i) - F.col(f"m{i}")) <= 3.5 * widths[i]
    core = centred.join(F.broadcast(scale), "lang").where(near)
    sums = [F.sum(at("x", i)).alias(f"t{i}") for i in range(d)] + [F.sum(at("x", i) * at("x", j)).alias(f"t{i}_{j}") for i in range(d) for j in range(i, d)]
    fitted = {}
    for r in core.groupBy("lang").agg(F.count("*").alias("n"), *sums).collect():
        fitted[r.lang] = r.n, np.array([r[f"t{i}"] for i in range(d)]), np.array([[r[f"t{min(i, j)}_{max(i, j)}"] for j in range(d)] for i in range(d)])
    if not fitted:
        return {}
    together = tuple(sum(parts) for parts in zip(*fitted.values(), strict=True))
    shapes = {}
    for lang in [*languages, UNKNOWN]:
        own = fitted.get(lang)
        borrowed = not own or own[0] < LEAST_CORE
        n, first, second = together if borrowed else own
        mean = first / n
        cov = second / n - np.outer(mean, mean) + np.eye(d) * 1e-4
        inverse = np.linalg.inv(cov)
        if borrowed and lang == UNKNOWN:
            used = np.array([f != "function_words" for f in FEATURES])
            inverse = np.zeros((d, d))
            inverse[np.ix_(used, used)] = np.linalg.inv(cov[np.ix_(used, used)])
            mean = np.where(used, mean, 0.0)
        shapes[lang] = mean, inverse
    return shapes


#: Square of the distance beyond which a document is an outlier: the 0.999 quantile of chi-squared with 6 degrees of freedom.
CUTOFF = 22.46


def spam_scores(documents: DataFrame) -> DataFrame:
    """doc_id, lang, distance (squared, robust), direction, pushed, is_spam of every document with text.

    direction: the share of the distance that points where spam lies (features
    raised or lowered as FEATURES says). An outlier in that direction is spam
    if more than half of it is pushed; where no text could be fitted, that
    alone decides. lang is the language whose learned function words the text
    uses, or "?". A document that comes again has a row each time; a null
    doc_id is kept, null and blank texts give no row.
    """
    spark = documents.sparkSession
    texts = distinct_texts(documents)
    known = function_words(texts)
    measured = store(spread(texts.select("k1", "k2", "text")).mapInArrow(_features(known), "k1 bigint, k2 bigint, lang string, x array<double>"))
    shapes = robust_shape(measured, sorted(known))
    signs = np.array(list(FEATURES.values()), float)
    d = len(FEATURES)
    flat = [(k, m.tolist(), v.ravel().tolist()) for k, (m, v) in shapes.items()]
    fitted = spark.createDataFrame(flat, "lang string, mean array<double>, inverse array<double>")
    delta = [F.col("x")[i] - F.col("mean")[i] for i in range(d)]
    pulls = []
    distance = F.lit(0.0)
    for i in range(d):
        row = F.lit(0.0)
        for j in range(d):
            row += F.col("inverse")[i * d + j] * delta[j]
        distance += delta[i] * row
        pulls.append(delta[i] * float(signs[i]))
    toward = sum(F.greatest(p, F.lit(0.0)) for p in pulls)
    away = sum(F.greatest(-p, F.lit(0.0)) for p in pulls)
    scored = measured.join(F.broadcast(fitted), "lang", "left").select(  # one row per language
        "k1", "k2", "lang", F.coalesce(distance, F.lit(0.0)).alias("distance"), F.coalesce(toward / (toward + away + 1e-12), F.lit(0.0)).alias("direction"), F.col("x")[0].alias("pushed")
    )
    far = (F.col("distance") > CUTOFF) & (F.col("direction") > 0.5) if shapes else F.lit(True)
    judged = scored.withColumn("is_spam", far & (F.col("pushed") > 0.5))
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), *_key())
    return rows.join(judged, ["k1", "k2"]).select("doc_id", "lang", "distance", "direction", "pushed", "is_spam")
