import random

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from tracewright.llm import neardup as N


def jaccard(a, b):
    def runs(t):
        w = [x.lower() for x in N._WORD.findall(t or "")]
        return set(zip(w, w[1:], w[2:], strict=False))

    a, b = runs(a), runs(b)
    return len(a & b) / len(a | b) if a and b else 0.0


def corpus(seed, n=120):
    rng = random.Random(seed)
    texts = []
    for _ in range(n):
        if texts and rng.random() < 0.6:
            w = rng.choice(texts).split()
            for _ in range(rng.randrange(4)):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(("new", "Word", "x1"))
            texts.append(" ".join(w))
        else:
            texts.append(" ".join(rng.choice("abcdefghijklmnop") + str(rng.randrange(60)) for _ in range(rng.choice((1, 2, 3, 5, 20, 60)))))
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_pairs_and_groups_against_brute_force(spark, seed):
    texts = [*corpus(seed), None, "", "two words", "same same same", "SAME, same; same!"]
    rows = list(enumerate(texts))
    frame = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id bigint, text string, band string")
    want = {(i, j) for i, a in rows for j, b in rows if i < j and jaccard(a, b) >= N.THRESHOLD}
    got = [tuple(r) for r in N.similar_pairs(frame, "doc_id", "text").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    root = {i: i for i, _ in rows}

    def up(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in want:
        a, b = sorted((up(a), up(b)))
        root[b] = a
    groups = {r["doc_id"]: r["group_id"] for r in N.similar_groups(frame, "doc_id", "text").collect()}
    assert groups == {i: up(i) for pair in want for i in pair}


def test_empty(spark):
    assert N.similar_pairs(spark.createDataFrame([(1, None)], "doc_id bigint, text string"), "doc_id", "text").count() == 0


@given(st.floats(0.5, 0.95), st.integers(0, 1000))
def test_odd_sketches_estimate_high_similarities(share, seed):
    rng = np.random.default_rng(seed)
    both = rng.integers(0, 1 << 63, 400, np.uint64)
    k = int(400 * share)
    sets = [np.unique(both[:k + (400 - k) // 2]), np.unique(np.concatenate([both[:k], both[k + (400 - k) // 2:]]))]
    s = N.similarity(*sets)
    _, sketch = N.signatures(sets)
    bits = sum(int(x).bit_count() for x in sketch[0] ^ sketch[1])
    assert bits <= N.popcount_limit(s - 0.05, N.BANDS * N.ROWS, N.SKETCH_BITS, 5)


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1, 1.0) for i in range(0, 40)], "a bigint, b bigint, similarity double")
    assert {r["root"] for r in N.components(links).collect()} == {0}


def test_many_edits_of_one_text_are_linked_by_stars(spark):
    """Candidates of a large cluster grow with its rows, not with their pairs, and the groups are those of all pairs."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(2000):
        w = list(words)
        w[rng.randrange(300)] = f"e{i}"
        rows.append((i, " ".join(w)))
    rows += [(10_000 + i, " ".join(f"z{i}_{k}" for k in range(30))) for i in range(50)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    members, reps = N._classes(frame, "doc_id", "text", N.WORDS)
    shared = N.shared_bands(reps).cache()
    first = N.stars(shared)
    assert members.count() == 2050 and first.count() <= N.BANDS * 2000
    links = N._verified(first, reps, frame, "doc_id", "text", N.THRESHOLD, N.WORDS)
    assert N.across(shared, N.components(links)).count() < 2000
    groups = N.similar_groups(frame, "doc_id", "text").collect()
    assert {(r["doc_id"], r["group_id"], r["copies"]) for r in groups} == {(i, 0, 1) for i in range(2000)}


def test_merged_roots(spark):
    links = spark.createDataFrame([(1, 2), (5, 6), (8, 9)], "a bigint, b bigint")
    roots = N.components(links)
    more = spark.createDataFrame([(2, 6), (20, 21), (9, 30)], "a bigint, b bigint")
    got = {r["id"]: r["root"] for r in N.merged_roots(roots, more).collect()}
    assert got == {1: 1, 2: 1, 5: 1, 6: 1, 8: 8, 9: 8, 30: 8, 20: 20, 21: 20}
    assert N.merged_roots(roots, more.limit(0)).count() == 6
