"""Ranking: fusion, ties, filters, selectors, top-k; each with its odd cases."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from intentlake.operators import ranking
from intentlake.operators.ranking import SearchParams

ROWS = "key bigint, embedding array<float>, symbols array<string>, content string, start_line bigint, language string, file_path string"


def rows(spark, data):
    return spark.createDataFrame([(k, e, s, f"line of {k}\nParser {k}", 5, "go" if k % 2 else None, f"f{k}.go") for k, e, s in data], ROWS)


def unit(*x):
    return [float(v) for v in x]


def test_fusion_worked_by_hand(spark):
    signals = spark.createDataFrame([("a", 1.0, 1), ("b", 1.0, 2), ("c", 1.0, 3), ("c", 1.0, 1), ("z", 0.0, 1)], "k string, weight double, rank int")
    got = {r.k: r.score for r in ranking.weighted_rrf(signals, ["k"]).collect()}
    assert got == pytest.approx({"a": 1 / 61, "b": 1 / 62, "c": 1 / 63 + 1 / 61})


@settings(max_examples=20, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.sampled_from([0.0, 1.0, -0.5, 2.0]), st.integers(1, 9)), max_size=20), st.sampled_from([1.0, 60.0]))
def test_fusion_against_a_model(spark, data, k):
    model = {}
    for key, weight, rank in data:
        if weight:
            model[key] = model.get(key, 0) + weight / (k + rank)
    frame = spark.createDataFrame(data, "k int, weight double, rank int")
    assert {r.k: r.score for r in ranking.weighted_rrf(frame, ["k"], k).collect()} == pytest.approx(model)


@pytest.mark.parametrize(("scores", "ratio", "kept"), [([], 0.5, []), ([-1.0], 0.5, [-1.0]), ([0.0, -1.0], 0.1, []), ([4.0, 2.0, 1.9], 0.5, [4.0, 2.0]), ([4.0, 4.0], 1.5, []), ([3.0], 9.0, [3.0])])
def test_low_scores(spark, scores, ratio, kept):
    df = spark.createDataFrame([(s,) for s in scores], "score double")
    assert sorted((r.score for r in ranking.low_score_filter(df, ratio).collect()), reverse=True) == kept


def test_cosine_topk(spark):
    data = [(3, unit(1, 0), []), (1, unit(2, 0), []), (2, unit(0, 1), []), (4, unit(0, 0), []), (5, None, []), (6, unit(1, 0, 0), [])]
    got = ranking.cosine_topk(rows(spark, data), [1.0, 0.0], 10, ["key"]).collect()
    assert [(r.key, r.similarity) for r in got] == [(1, 1.0), (3, 1.0), (2, 0.0), (4, 0.0)]
    assert ranking.cosine_topk(rows(spark, data), [1.0, 0.0], 0, ["key"]).count() == 0
    assert [r.similarity for r in ranking.cosine_topk(rows(spark, data), [0.0, 0.0], 2, ["key"]).collect()] == [0, 0]
    plan = ranking.cosine_topk(rows(spark, data), [1.0, 0.0], 3, ["key"])._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_selectors(spark):
    data = rows(spark, [(k, unit(1, 0), []) for k in range(6)])
    keys = lambda df: sorted(r.key for r in df.collect())
    assert keys(ranking.selected(data)) == list(range(6))
    assert keys(ranking.selected(data, ["go"], ["f2.go"])) == [1, 2, 3, 5]  # or, not and
    assert keys(ranking.selected(data, ["GO"], ["f*.go"])) == list(range(6))  # nothing qualifies, so all
    assert keys(ranking.selected(data, ["cobol"], ["f0.go"])) == [0]


def test_definitions_are_ranked_anew_within_the_pool(spark):
    pool = spark.createDataFrame([(1, ["x"], 4), (2, ["a", "b"], 2), (3, None, 1), (4, ["b"], 3)], "key int, symbols array<string>, rank int")
    got = ranking.definition_list(pool, F.array(F.lit("b"), F.lit("x"))).orderBy("definition_rank").collect()
    assert [(r.key, r.definition_rank) for r in got] == [(2, 1), (4, 2), (1, 3)]


def test_hybrid_search(spark):
    data = [(k, unit(1, k / 10), ["Parser"] if k in (2, 9) else []) for k in range(10)]
    search = lambda top, p=SearchParams(): ranking.hybrid_search(rows(spark, data), [1.0, 0.0], "Parser", top, p, ["key"]).orderBy("place").collect()
    best = search(3)
    assert [r.key for r in best][:2] == [2, 9] and best[2].key == 0  # pool of 15 holds both definitions
    assert best[0].score == pytest.approx(1 / 63 + 1 / 61) and best[1].score == pytest.approx(1 / 70 + 1 / 62)
    assert [tuple(m) for m in best[0].match_lines] == [(6, "Parser 2")]
    near = search(1, SearchParams(candidate_multiplier=2))
    assert [r.key for r in near] == [0]  # the definitions are outside of the pool
    assert [r.key for r in search(4, SearchParams(def_weight=0.0))] == [0, 1, 2, 3]
    assert search(0) == [] and len(search(1)) == 1
    assert [r.key for r in search(10, SearchParams(min_score_ratio=0.9))] == [2, 9]
    assert search(10, SearchParams(def_weight=-9.0, min_score_ratio=0.5))[0].key == 0
    with pytest.raises(ValueError, match="at least 1"):
        SearchParams(candidate_multiplier=0)


def test_fused_equals_the_union_of_signals(spark):
    data = [(k, ["n"] if k % 3 == 0 else [], k + 1) for k in range(12)]
    pool = spark.createDataFrame(data, "key int, symbols array<string>, rank int")
    names = F.array(F.lit("n"))
    defined = ranking.definition_list(pool, names).select("key", F.lit(1.5).alias("weight"), F.col("definition_rank").alias("rank"))
    signals = pool.select("key", F.lit(1.0).alias("weight"), F.col("rank").cast("bigint")).unionByName(defined)
    plain = {r.key: r.score for r in ranking.weighted_rrf(signals, ["key"], 10).collect()}
    assert {r.key: r.score for r in ranking.fused(pool, names, SearchParams(rrf_k=10, def_weight=1.5), ["key"], 99).collect()} == pytest.approx(plain)


def test_batch_topk_equals_single_searches(spark, monkeypatch):
    monkeypatch.setattr(ranking, "QUERY_BLOCK", 2)
    data = rows(spark, [(k, unit(k % 4 - 1, k % 3 - 1), []) for k in range(40)] + [(98, None, []), (99, unit(1, 2, 3), []), (97, [1.0, None], [])])
    queries = spark.createDataFrame([(1, unit(1, 0)), (2, unit(0, 1)), (3, unit(0, 0)), (4, None), (5, unit(1, 1))], "query_id bigint, query array<float>")
    got = {}
    for r in ranking.batch_topk(data, queries, 5, "key").orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.key, round(r.similarity, 9)))
    assert set(got) == {1, 2, 3, 5}
    for q, v in ((1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0])):
        one = [(r.key, round(r.similarity, 9)) for r in ranking.cosine_topk(data.where("key < 97"), v, 5, ["key"]).collect()]
        assert got[q] == one
    assert ranking.batch_topk(data, queries.limit(0), 5, "key").count() == 0
    assert ranking.batch_topk(data.limit(0), queries, 5, "key").count() == 0
