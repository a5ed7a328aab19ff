"""Near-duplicates against brute force, with copies, hot buckets, nulls and empty tables."""

import itertools
import random
import re

import numpy as np

from intentlake.llm.components import components, union_find
from intentlake.llm.near_duplicates import near_duplicate_groups, similar_pairs
from intentlake.llm.superminhash import U, mix, shingles, signatures

SCHEMA = "k bigint, t string, id string, class int, key int"


def grams(text):
    w = re.findall("[a-z0-9_]+", text.lower())
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 40 else set()


def brute(rows, threshold):
    sets = {k: grams(t) for k, t in rows if k is not None and t is not None}
    found = set()
    for (a, x), (b, y) in itertools.combinations(sorted(sets.items()), 2):
        if x and y and len(x & y) >= threshold * len(x | y):
            found.add((a, b))
    return found


def corpus(seed=5):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(4000)}"
    header = [word() for _ in range(30)]
    rows = []
    for k in range(60):
        base = header + [word() for _ in range(60)]
        rows.append((k * 10, " ".join(base)))
        for j in range(1, 4):
            edited = list(base)
            for _ in range(rng.choice([1, 4, 9])):
                edited[rng.randrange(len(edited))] = word()
            rows.append((k * 10 + j, " ".join(edited)))
    rows += [(5000 + i, rows[0][1]) for i in range(6)]  # copies
    rows += [(6000, None), (None, rows[0][1]), (6001, ""), (6002, "short text"), (6003, "x " * 50), (6004, "y " * 39), (rows[3][0], rows[3][1])]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(k, t, "clash", 1, 2) for k, t in rows], SCHEMA)


def test_pairs_equal_brute_force(spark):
    rows = corpus()
    got = similar_pairs(frame(spark, rows), "k", "t").collect()
    assert len(got) == len(set(got))
    truth = brute(dict((k, t) for k, t in rows if k is not None).items(), 0.6)
    assert {(r.a, r.b) for r in got} <= truth
    assert len(got) >= 0.99 * len(truth)


def test_hot_buckets_lose_no_pair(spark):
    rows = corpus(7)
    got = {(r.a, r.b) for r in similar_pairs(frame(spark, rows), "k", "t", hot_bucket=2).collect()}
    truth = brute(dict((k, t) for k, t in rows if k is not None).items(), 0.6)
    assert got <= truth and len(got) >= 0.99 * len(truth)


def test_one_form_at_every_number_of_copies(spark):
    base, other = " ".join(f"a{i}" for i in range(60)), " ".join(f"a{i}" for i in range(55)) + " z z z z z"
    for copies in (9, 10, 11, 30):
        rows = [(i, base) for i in range(1, copies + 1)] + [(100, other)]
        got = [(r.a, r.b) for r in similar_pairs(frame(spark, rows), "k", "t", representatives=10).collect()]
        assert len(got) == len(set(got))
        assert set(got) == {(a, b) for a in range(1, 11) for b in range(a + 1, copies + 1)} | {(i, 100) for i in range(1, copies + 1)}


def test_groups_have_one_row_per_record(spark):
    rows = corpus()
    got = {r.id: r for r in near_duplicate_groups(frame(spark, rows), "k", "t").collect()}
    truth = brute(dict((k, t) for k, t in rows if k is not None).items(), 0.6)
    roots = union_find(truth)
    assert set(got) == {k for k, t in rows if k is not None and t is not None and grams(t)}
    assert all(got[k].group_id == roots.get(k, k) for k in got)
    assert {got[5000 + i].class_id for i in range(6)} == {0}


def test_no_records(spark):
    assert similar_pairs(frame(spark, []), "k", "t").count() == 0
    assert near_duplicate_groups(frame(spark, []), "k", "t").count() == 0


def test_components_of_a_long_chain(spark):
    n = 1000
    ids = list(range(n))
    random.Random(1).shuffle(ids)
    edges = [(a, b) for a, b in zip(ids, ids[1:]) if (a + b) % 97] + [(None, 3), (5, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint").repartition(7)).collect()}
    assert {k: v for k, v in got.items()} == {**{5: got[5], 3: got[3]}, **union_find([e for e in edges if e[0] is not None])}


def test_signature_agreement_estimates_similarity():
    rng = np.random.default_rng(3)
    errors = []
    for share in (0.2, 0.5, 0.8):
        common, one, two = (mix(rng.integers(0, 2**63, n).astype(U)) for n in (int(400 * share), 200 - int(200 * share), 200 - int(200 * share)))
        sets = [np.concatenate((common, one)), np.concatenate((common, two))]
        owner = np.repeat([0, 1], [len(s) for s in sets])
        s = signatures(owner, np.concatenate(sets), 2, 200)
        true = len(common) / (len(common) + len(one) + len(two))
        errors.append(abs((s[0] == s[1]).mean() - true))
    assert max(errors) < 0.1


def test_shingles_of_repeated_and_short_texts():
    owner, elements = shingles(["a " * 50, "a b", "", "Ä x " * 30], 3, 40)
    assert owner.tolist() == [0] and len(elements) == 1


def test_large_groups_of_different_texts_are_paired_in_full(spark):
    words = [f"a{i}" for i in range(60)]
    other = " ".join(words[:55]) + " z z z z z"
    # variants of one set of shingles, of which one has many copies
    rows = [(i, (" " * i + "- ").join(words)) for i in range(1, 21)] + [(100 + i, ", ".join(words)) for i in range(15)] + [(200, other)]
    got = [(r.a, r.b) for r in similar_pairs(frame(spark, rows), "k", "t", representatives=10).collect()]
    standing, copies = [*range(1, 21), *range(100, 110), 200], range(110, 115)
    assert len(got) == len(set(got))
    assert set(got) == {(a, b) for a in standing for b in standing if a < b} | {(min(a, b), max(a, b)) for a in copies for b in standing}
