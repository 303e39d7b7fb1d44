import random

import numpy as np
import pytest

from pagegauge.llm import ngram_join

from .cases import SCHEMA, awkward, frame
from .test_ngram_join import brute, shingles, varied


def counts(data):
    sets = [shingles(r[1]) for r in data]
    return sorted((str(r[0]), sum(bool(s) and k != j and 100 * len(s & t) >= 75 * len(s | t) for j, t in enumerate(sets))) for k, (r, s) in enumerate(zip(data, sets)))


def grouped():
    """Near copies, some of them linked by way of others only."""
    base = [f"b{k}" for k in range(100)]
    near = [" ".join(f"e{k}" if j == 2 * k else w for j, w in enumerate(base)) for k in range(12)]
    chain = [" ".join(f"c{k}" for k in range(2 * j, 2 * j + 40)) for j in range(30)]
    return varied(7, 150) + [(1000 + k, t, *[None] * 8) for k, t in enumerate([*near, near[0], *chain, chain[3], "", None])]


@pytest.mark.parametrize("block, shingles_of", [(1024, 1 << 20), (5, 1 << 20), (1024, 700)])
def test_links_within_components_are_counted(spark, monkeypatch, block, shingles_of):
    """Every link between different texts counts, in components of one block and of many."""
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "SHINGLES", shingles_of)
    data = grouped()
    got = ngram_join.link_counts(frame(spark, data)).collect()
    want = counts(data)
    assert sorted((str(r["doc_id"]), r["n_links"]) for r in got) == want
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got) == brute(data)
    assert max(n for _, n in want) >= 12


def test_rows_told_by_salted_joins(spark, monkeypatch):
    """With more keys than are broadcast, rows are told of them in parts; nothing else changes."""
    monkeypatch.setattr(ngram_join, "TOLD", 0)
    monkeypatch.setattr(ngram_join, "SALTS", 3)
    data = grouped() + awkward()
    got = ngram_join.link_counts(frame(spark, data)).collect()
    assert sorted((str(r["doc_id"]), r["n_links"]) for r in got) == counts(data)
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got) == brute(data)


def test_awkward_and_empty_tables(spark):
    got = ngram_join.link_counts(frame(spark)).collect()
    assert sorted((str(r["doc_id"]), r["n_links"]) for r in got) == counts(awkward())
    assert ngram_join.link_counts(spark.createDataFrame([], SCHEMA)).count() == 0


def test_overlaps(monkeypatch):
    """Tables of bits count as set operations do, but for a set with itself."""
    monkeypatch.setattr(ngram_join, "COLUMNS", 64)
    rng = random.Random(5)
    sets = [np.array(sorted(rng.sample(range(500), rng.randint(1, 300))), np.uint64) for _ in range(30)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    assert ngram_join.overlaps(sets[:11], sets[11:]).tolist() == [row[11:] for row in want[:11]]
    same = ngram_join.overlaps(sets, sets)
    np.fill_diagonal(same, 0)
    assert same.tolist() == [[0 if i == j else n for j, n in enumerate(row)] for i, row in enumerate(want)]
    assert not ngram_join.overlaps([np.array([1], np.uint64)], [np.array([2], np.uint64)]).any()
