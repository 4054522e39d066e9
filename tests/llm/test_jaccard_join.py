import random

import numpy as np
import pytest

import corpus_pipeline
from geograph.llm import jaccard_join as jj

from .brute import jaccard_components


def corpus(seed, n=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["the", "of", "The"]
    base = [[rng.choice(words) for _ in range(rng.randint(1, 60))] for _ in range(8)]
    docs = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = rng.choice(words)
        docs.append((i, rng.choice([" ", "\n", "\t "]).join(w)))
    return [*docs, (n, None), (n + 1, ""), (n + 2, " \n "), (n + 3, "one two"), (n + 4, "One  two"), (n + 5, docs[0][1]), docs[7]]


def rows_of(df):
    return sorted([(r.doc_id, r.n_shingles, r.component_id) for r in df.collect()], key=str)


@pytest.mark.parametrize(("seed", "width", "percent"), [(1, 3, 90), (2, 5, 80), (3, 2, 50)])
def test_same_as_all_pairs(spark, seed, width, percent):
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, sid int, region string")
    assert rows_of(jj.components(df, width, percent)) == jaccard_components(rows, width, percent)


def test_regions_too_large_to_hold(spark, monkeypatch):
    monkeypatch.setattr(jj, "REGION_ROWS", 2)
    rows = corpus(4)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(jj.components(df, 3, 70)) == jaccard_components(rows, 3, 70)


@pytest.mark.parametrize(("seed", "width", "percent", "few"), [(4, 3, 90, 100), (5, 3, 70, 0), (6, 2, 50, 100)])
def test_clusters_too_large_for_a_task(spark, monkeypatch, seed, width, percent, few):
    """Every cluster goes through rounds of pivots, windows and blocks in Spark; hot pivots are dealt out."""
    for name, value in (("LARGE", 2), ("BLOCK", 2), ("PIVOTS", 2), ("LEAF", 2), ("HOT", 40), ("FEW", few)):
        monkeypatch.setattr(jj, name, value)
    rows = corpus(seed, 40)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(jj.components(df, width, percent)) == jaccard_components(rows, width, percent)


def test_keep_one(spark):
    rows = [(3, "a b c d e f"), (1, "a b c d e f"), (2, "x y z u v w"), (None, "a b c d e f"), (4, None), (5, "")]
    df = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, component_id string")
    assert sorted(r.doc_id for r in jj.keep_one(df).collect()) == [1, 2, 4, 5]


def test_keep_one_judges_rows_and_not_ids(spark):
    """Repeated rows, ids with several texts and null ids, through near_duplicates and repeats."""
    text = lambda name: " ".join(f"{name}{i}" for i in range(60))
    near = text("near") + " more"
    rows = [(1, text("twice")), (1, text("twice")), (2, text("near")), (3, near), (3, text("own")), (None, near), (None, text("null")), (None, text("other")), (None, text("other")), (4, None), (4, "")]
    one = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    kept = [(1, text("twice")), (2, text("near")), (3, text("own")), (None, text("null")), (None, text("other")), (4, None), (4, "")]
    found = lambda df: sorted([(r.doc_id, r.text) for r in df.collect()], key=str)
    assert found(one) == sorted(kept, key=str)
    assert found(corpus_pipeline.repeats(spark, one, "")) == sorted(kept, key=str)


def test_empty_table(spark):
    assert jj.components(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_recursion_joins_a_region_exactly():
    rng = np.random.default_rng(5)
    centre = [rng.choice(4000, 60, replace=False) for _ in range(6)]
    sets = []
    for _ in range(400):
        s = set(centre[rng.integers(6)].tolist())
        for x in rng.choice(sorted(s), rng.integers(0, 25), replace=False):
            s.discard(int(x))
        sets.append(np.array(sorted(s | set(rng.integers(0, 4000, rng.integers(0, 12)).tolist())), np.uint64))
    for percent in (60, 80, 90):
        own = jj.Sets(sets, percent)
        forest = jj.Forest(len(sets))
        own.join(np.arange(len(sets)), forest)
        plain = jj.Forest(len(sets))
        for a in range(len(sets)):
            for b in range(a):
                both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    plain.join(a, b)
        every = np.arange(len(sets))
        assert (forest.roots(every) == plain.roots(every)).all()


def test_count_vectors_bound_the_distance():
    rng = np.random.default_rng(6)
    for n in (10, 300, 5000):
        a = np.unique(rng.integers(0, 1 << 60, n).astype(np.uint64))
        b = np.unique(np.r_[a[n // 10 :], rng.integers(0, 1 << 60, n // 20 + 1).astype(np.uint64)])
        x, y = jj.count_vector(a), jj.count_vector(b)
        size = min(len(x), len(y))
        assert np.abs(jj._folded(x, size) - jj._folded(y, size)).sum() <= len(np.setxor1d(a, b))
