"""Mixing: plans, exponents, budgets and repeats."""

import math

import pytest

from intentlake.llm import mixing

DOC = "doc_id bigint, text string, source string, tokens string, block int, lang string"
TARGET = "source string, target_share double, max_repeats int, tokens int"


def data(spark):
    rows = [(i, "word, " * (5 + i % 7), " Big " if i % 2 else "BIG") for i in range(400)]
    rows += [(1000 + i, "tok en 1.5", "small") for i in range(10)] + [(2000 + i, "a b", "other") for i in range(50)]
    rows += [(3000, None, "big"), (3001, "", "big"), (3002, "x", None), (3003, "x", "unknown")]
    d = spark.createDataFrame([(*r, "c", 1, "en") for r in rows], DOC)
    t = spark.createDataFrame([("big", 0.6, 2, 1), ("small", 0.3, 3, 1), ("Other ", 0.1, 4, 1), ("empty", 0.0, 1, 1), (None, 0.5, 1, 1)], TARGET)
    return d, t


def test_tokens_and_plan(spark):
    d, t = data(spark)
    tokens = {r.doc_id: r.tokens for r in mixing.source_tokens(d, t).collect()}
    assert tokens[1000] == 5 and tokens[0] == 10 and tokens[3001] == 0 and 3002 not in tokens and 3003 not in tokens and 3000 not in tokens
    plan = {r.source: r for r in mixing.plan_frame(d, t).collect()}
    total = sum(p.tokens for p in plan.values())
    assert set(plan) == {"big", "small", "other", "empty"}
    for s, (share, most) in {"big": (0.6, 2), "small": (0.3, 3), "other": (0.1, 4)}.items():
        assert plan[s].reachable == (not most * plan[s].tokens < share * total)
        assert plan[s].passes <= most + 1e-9
        assert (plan[s].exponent == 1) == plan[s].reachable
        if not plan[s].reachable:
            assert plan[s].passes == pytest.approx(most)
    assert sum(p.weight for p in plan.values()) == pytest.approx(1)  # the short sources are used up, the rest goes to the other
    assert not plan["small"].reachable and plan["small"].passes == pytest.approx(3)
    assert plan["empty"].weight == 0 and plan["empty"].reachable


def test_draw_meets_the_budget(spark):
    d, t = data(spark)
    plan = {r.source: r for r in mixing.plan_frame(d, t).collect()}
    total = sum(p.tokens for p in plan.values())
    rows = mixing.draw(d, t).collect()
    assert len(rows) == len({r.doc_id for r in rows}) == 400 + 10 + 50 + 1
    for s, p in plan.items():
        own = [r for r in rows if r.source == s]
        if not own:
            continue
        used = sum(r.tokens * r.repeats for r in own)
        assert p.weight * total - 25 <= used <= p.weight * total + 1e-6
        assert max(r.repeats for r in own) - min(r.repeats for r in own) <= 1
    assert sorted(rows) == sorted(mixing.draw(d, t).collect())
    shares = {r.source: r for r in mixing.reached(d, t).collect()}
    assert sum(r.reached_share for r in shares.values()) == pytest.approx(1)
    assert shares["small"].most_repeats == 3


def test_limits_that_bind():
    plan = {p.source: p for p in mixing.plan_mixture({"a": 10, "b": 90, "c": 0}, {"a": (0.5, 2), "b": (0.3, 1), "c": (0.2, 3)})}
    assert (plan["a"].passes, plan["a"].reachable, plan["c"].reachable) == (pytest.approx(2), False, False)
    assert plan["b"].weight == pytest.approx(0.8) and plan["b"].reachable
    exact = mixing.plan_mixture({"a": 3, "b": 7}, {"a": (0.6, 2), "b": (0.4, 1)})
    assert all(p.reachable for p in exact)  # just within its limit
    full = mixing.plan_mixture({"a": 3, "b": 7}, {"a": (0.9, 1), "b": (0.1, 1)})
    assert sum(p.weight for p in full) == pytest.approx(1) and not full[0].reachable
    assert [p.weight for p in mixing.plan_mixture({"a": 5, "b": 5}, {"a": (0.5, 0), "b": (0.5, 0)})] == [0, 0]
    assert mixing.plan_mixture({}, {}) == [] and mixing.plan_mixture({}, {"a": (0.5, 1)})[0].weight == 0


def test_exponents():
    shares = {"a": 0.7, "b": 0.2, "c": 0.1}
    assert mixing.tempered(shares, 0) == pytest.approx({k: 1 / 3 for k in shares})
    assert mixing.tempered(shares, 1) == pytest.approx(shares)
    wanted = mixing.entropy({"a": 0.5, "b": 0.3, "c": 0.2})
    a = mixing.exponent_for_entropy(shares, wanted)
    assert mixing.entropy(mixing.tempered(shares, a)) == pytest.approx(wanted)
    assert mixing.bisect(lambda x: x <= math.pi, 0, 10) == pytest.approx(math.pi)


def test_temperature_respects_limits(spark):
    d, t = data(spark)
    rows = {r.source: r for r in mixing.temperature(d, t).collect()}
    assert sum(r.weight for r in rows.values()) == pytest.approx(1)
    limits = {"big": 2, "small": 3, "other": 4, "empty": 1}
    assert all(r.weight <= limits[s] * r.share + 1e-9 for s, r in rows.items())
    assert all(abs(r.reached_share - r.weight) < 0.02 for r in rows.values())


def test_empty_tables(spark):
    d, t = data(spark)
    assert mixing.plan_frame(d, t.limit(0)).count() == 0
    assert {r.source for r in mixing.plan_frame(d.limit(0), t).where("reachable").collect()} == {"big", "small", "other", "empty"}
    assert mixing.draw(d.limit(0), t).count() == 0
    assert mixing.temperature(d.limit(0), t).count() == 4
