"""Leakage: the FM-index against plain search, spans, and the odd rows."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from intentlake.llm import leakage
from intentlake.llm.leakage import FMIndex, Phrases, Shard, WaveletMatrix, leaked_spans, removal_spans, suffix_array, words


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 6), min_size=1, max_size=120), st.integers(1, 4))
def test_index_finds_what_is_there(text, width):
    index = FMIndex(np.array(text), sample=4)
    phrases = np.array([[1 + (i * 7 + j * 3) % 7 for j in range(width)] for i in range(20)])
    low, high = index.search(phrases)
    for p, a, b in zip(phrases.tolist(), low, high):
        places = sorted(index.locate(np.arange(a, b)).tolist()) if b > a else []
        assert places == [i for i in range(len(text) - width + 1) if text[i : i + width] == p]


def test_suffix_array_and_ranks():
    rng = np.random.default_rng(1)
    for n in (1, 2, 50, 400):
        text = np.concatenate((rng.integers(1, 3, n), [0]))
        assert suffix_array(text).tolist() == sorted(range(n + 1), key=lambda i: text[i:].tolist())
    s = rng.integers(0, 13, 300)
    w = WaveletMatrix(s, 4)
    for c in range(13):
        for at in (0, 1, 150, 300):
            assert w.rank(np.array([c]), np.array([at]))[0] == (s[:at] == c).sum()
    assert w.access(np.arange(300)).tolist() == s.tolist()


def cases():
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(300)]
    item = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, item(40)) for i in range(12)] + [(20, None), (21, "too short"), (None, item(20)), (22, "")]
    items.append((30, items[0][1]))  # issued again
    documents = []
    for d in range(60):
        text = [rng.choice(vocabulary) for _ in range(80)]
        if d % 3 == 0:
            src = items[d % 12][1].split()
            n = rng.choice([11, 12, 25])
            text[10 : 10 + n] = src[5 : 5 + n]
        documents.append((d, ", ".join(text).upper() if d % 2 else "\n".join(text)))
    documents += [(100, None), (101, ""), (102, documents[0][1]), (102, documents[0][1]), (103, items[1][1] + " " + items[2][1])]
    return documents, items


def brute(documents, items, n=12):
    found = set()
    for d, text in documents:
        ws = words(text) if text else []
        runs = {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)}
        for k, t in items:
            it = words(t) if t and k is not None else []
            if any(tuple(it[i : i + n]) in runs for i in range(len(it) - n + 1)):
                found.add((d, k))
    return found


def test_operator_equals_brute_force(spark, monkeypatch):
    documents, items = cases()
    d = spark.createDataFrame([(k, t, 1, "x") for k, t in documents], "doc_id bigint, text string, item_id int, first_word string")
    e = spark.createDataFrame([(k, t, "s") for k, t in items], "item_id bigint, text string, doc_id string")
    spans = leaked_spans(d, e).collect()
    assert len(spans) == len(set(spans))
    assert {(r.doc_id, r.item_id) for r in spans} == brute(documents, items)
    texts = dict(documents)
    item_texts = dict(items)
    for r in spans:
        run = words(texts[r.doc_id])[r.first_word : r.end_word]
        assert len(run) >= 12 and " ".join(run[:12]) in " ".join(words(item_texts[r.item_id]))
    monkeypatch.setattr(leakage, "PHRASE_WORDS", 90)
    monkeypatch.setattr(leakage, "SHARD_WORDS", 100)
    assert {(r.doc_id, r.item_id) for r in leaked_spans(d, e).collect()} == brute(documents, items)
    merged = {}
    for r in removal_spans(d, e).collect():
        merged.setdefault(r.doc_id, []).append((r.first_word, r.end_word))
    assert all(a[1] < b[0] for v in merged.values() for a, b in zip(sorted(v), sorted(v)[1:]))


def test_no_documents_and_no_items(spark):
    documents, items = cases()
    d, e = spark.createDataFrame(documents, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    assert leaked_spans(d.limit(0), e).count() == 0
    assert leaked_spans(d, e.limit(0)).count() == 0


def test_touching_runs_are_one_span():
    symbols = {}
    p = Phrases([(1, " ".join(f"a{i}" for i in range(30)))], symbols, 12)
    text = [f"a{i}" for i in range(20)] + ["x"] + [f"a{i}" for i in range(12)]
    assert list(p.find(Shard([(7, text)], symbols))) == [(7, 1, 0, 20), (7, 1, 21, 33)]


def test_too_many_evaluation_texts(spark, monkeypatch):
    monkeypatch.setattr(leakage, "MOST_WORDS", 20)
    d = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    e = spark.createDataFrame([(i, " ".join(f"w{i}_{j} x" for j in range(8))) for i in range(3)], "item_id bigint, text string")
    with pytest.raises(ValueError, match="more than 20 words"):
        leaked_spans(d, e)
