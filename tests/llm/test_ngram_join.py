import random
import re

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from pagegauge.llm import ngram_join
from pagegauge.llm.ngram_join import Ratio, boundary
from pagegauge.llm.textcore import Shingler

from .cases import SCHEMA, awkward, frame


def shingles(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(data):
    sets = [shingles(r[1]) for r in data]
    up = list(range(len(data)))

    def root(k):
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    by = {}
    for k, s in enumerate(sets):
        for x in s:
            by.setdefault(x, []).append(k)
    for k, s in enumerate(sets):
        near = {}
        for x in s:
            for j in by[x]:
                if j < k:
                    near[j] = near.get(j, 0) + 1
        for j, c in near.items():
            if 100 * c >= 75 * (len(s) + len(sets[j]) - c):
                up[root(k)] = root(j)
    least = {}
    for k, r in enumerate(data):
        if r[0] is not None:
            least[root(k)] = min(least.get(root(k), r[0]), r[0])
    return sorted((str(r[0]), len(sets[k]), str(least.get(root(k)))) for k, r in enumerate(data))


def result(df):
    return sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in df.collect())


def varied(seed=3, n=400):
    rng = random.Random(seed)
    vocab = [f"v{k}" for k in range(300)]
    passage = [rng.choice(vocab) for _ in range(60)]
    out = []
    for k in range(n):
        kind = rng.random()
        if kind < 0.45 and out:
            words = rng.choice(out).split()
            for _ in range(rng.randint(0, 1 + len(words) // 40)):
                if words:
                    words[rng.randrange(len(words))] = rng.choice(vocab)
            if rng.random() < 0.3:
                words = words[rng.randint(0, 2) :]
        elif kind < 0.6:
            words = [rng.choice(vocab) for _ in range(rng.randint(0, 12))] + passage
        elif kind < 0.8:
            words = [rng.choice(vocab[:6]) for _ in range(rng.randint(1, 14))]
        else:
            words = [rng.choice(vocab) for _ in range(rng.randint(5, 160))]
        out.append(" ".join(words))
    return [(k, t, "en", "s", len(t), *[None] * 5) for k, t in enumerate(out)]


@pytest.mark.parametrize("seed", [3, 4])
def test_components_match_brute_force(spark, seed, monkeypatch):
    data = varied(seed) + [(5000 + (r[0] or 0) if r[0] is not None else None, *r[1:]) for r in awkward()]
    assert result(ngram_join.classes(frame(spark, data))) == brute(data)


def test_small_blocks_and_buffers(spark, monkeypatch):
    for name, value in {"BLOCK": 3, "PART": 4, "COUNTED": 3000, "HELD": 50, "BUFFER": 300, "LEAST_BITS": 64}.items():
        monkeypatch.setattr(ngram_join, name, value)
    data = varied(11, 250)
    assert result(ngram_join.classes(frame(spark, data))) == brute(data)


def test_given_documents(spark):
    data = [(r["doc_id"], r["text"], *[None] * 8) for r in pq.read_table("/root/testdata/sf0.01/documents.parquet").to_pylist()]
    assert result(ngram_join.classes(frame(spark, data))) == brute(data)


def test_star_of_edits_meets_through_its_base(spark):
    base = [f"b{k}" for k in range(100)]
    data = [(0, " ".join(base), *[None] * 8)]
    for k in range(1, 60):
        words = list(base)
        for j in (k % 20, 30 + k % 25, 60 + k % 31):
            words[j] = f"e{k}_{j}"
        data.append((k, " ".join(words), *[None] * 8))
    assert result(ngram_join.classes(frame(spark, data))) == brute(data)


def test_long_lists_go_on_over_buffers():
    import numpy as np

    old = ngram_join.BUFFER
    ngram_join.BUFFER = 7
    try:
        sig = np.sort(np.array([1] * 3 + [2] * 40 + [3] * 2 + [4] * 9 + [5] + [6] * 12, np.int64))
        node = np.arange(len(sig), dtype=np.int64)
        part = np.where(sig == 6, (node - 55) // 6, -1).astype(np.int32)  # a list in two parts
        batches = [pa.RecordBatch.from_arrays([pa.array(x[k : k + 5]) for x in (sig, part, node, np.full(len(sig), 10 << 32))], names=["sig", "part", "node", "place"]) for k in range(0, len(sig), 5)]
        pairs, wide, pivots = set(), 0, []
        for b in ngram_join._meet_pivots(Ratio())(iter(batches)):
            for r in b.to_pylist():
                if r["kind"] in (0, 2):
                    pairs.add((r["a"], r["b"]))
                elif r["kind"] == 1:
                    wide += 1
                else:
                    pivots.append((r["a"], r["b"]))
        want = {(0, 1), (0, 2), (1, 2), (43, 44), *((3, k) for k in range(4, 43)), *((45, k) for k in range(46, 54)), *((55, k) for k in range(56, 61)), *((61, k) for k in range(62, 67))}
        assert pairs == want
        assert wide == 40 + 9 + 12
        assert pivots == [(6, 55), (6, 61)]
    finally:
        ngram_join.BUFFER = old


def test_subsets_of_small_sets_meet():
    """Any two linked small sets share a signature."""
    rng, ratio, limit = random.Random(1), Ratio(), 9
    import numpy as np

    for _ in range(300):
        n = rng.randint(2, limit)
        a = set(rng.sample(range(1, 14), n))
        b = set(a)
        for _ in range(rng.randint(0, 3)):
            b ^= {rng.randint(1, 14)}
        if not b or len(b) > limit or 4 * len(a & b) < 3 * len(a | b) or a == b:
            continue
        x, y = (np.array(sorted(s), np.uint64) for s in (a, b))
        assert set(ngram_join.signatures(x, limit, ratio)[0]) & set(ngram_join.signatures(y, limit, ratio)[0])


def test_contraction_and_components(spark):
    """Least reachable nodes, of chains too, whatever the tasks they are dealt to."""
    rng = random.Random(2)
    edges = [(k, k + 1) for k in range(0, 90) if k % 30 != 29] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)]
    up = {x: x for e in edges for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((root(a), root(b)))
            up[y] = x
    rng.shuffle(edges)
    found = ngram_join.components(spark.createDataFrame(edges, "a long, b long").repartition(6)).collect()
    assert {r["node"]: r["label"] for r in found} == {x: root(x) for e in edges if e[0] != e[1] for x in e}
    assert len(found) == len({r["node"] for r in found})


def test_marks_never_rule_out_a_link():
    import numpy as np

    rng = np.random.default_rng(5)
    for _ in range(200):
        n = int(rng.integers(20, 3000))
        base = rng.integers(0, 2**63, n).astype(np.uint64)
        a, b = np.unique(base[: n - int(rng.integers(0, n // 7 + 1))]), np.unique(np.concatenate([base[int(rng.integers(0, n // 7 + 1)) :], rng.integers(0, 2**63, int(rng.integers(0, n // 6 + 1))).astype(np.uint64)]))
        apart = len(np.setxor1d(a, b))
        far = ngram_join.distances([ngram_join.mark_of(a), ngram_join.mark_of(b)], np.array([0]), np.array([1]))[0]
        assert apart * 0.5 <= far <= apart


def test_long_words_are_told_apart():
    """Two words whose polynomials modulo 2**64 are equal whatever the base."""
    word = "".join("ab"[bin(k).count("1") % 2] for k in range(4096))
    other = "".join("ba"[bin(k).count("1") % 2] for k in range(4096))
    a, b = Shingler().sets(pa.array([f"x {word}", f"x {other}"]))
    assert a[0] != b[0]
    assert list(next(Shingler().sets(pa.array([word.upper()])))) == list(next(Shingler().sets(pa.array([word]))))


def test_boundary_grows_with_list_length():
    assert boundary(1) <= boundary(20) <= boundary(2000) <= 12


def test_shingle_sets_match_words():
    texts = [r[1] for r in awkward()]
    got = [len(s) for s in Shingler().sets(pa.array(texts, pa.string()))]
    assert got == [len(shingles(t)) for t in texts]


def test_empty(spark):
    assert ngram_join.classes(spark.createDataFrame([], SCHEMA)).count() == 0
    assert ngram_join.keep_one(spark.createDataFrame([], SCHEMA)).count() == 0


def test_keep_one(spark):
    data = varied(5, 120)
    kept = sorted(r["doc_id"] for r in ngram_join.keep_one(frame(spark, data)).select("doc_id").collect())
    assert [str(k) for k in kept] == sorted({c for _, _, c in brute(data)}, key=int)


SAID = "one two three four five six seven eight nine ten"


def test_keep_one_loses_no_document(spark):
    """Ids that repeat with other texts, null ids, rows that differ in other columns only, rows without words."""
    other = "quite another text that has nothing to do with it at all"
    data = [(1, SAID), (2, SAID), (2, other), (None, SAID), (None, "alone with no id but with words enough"), (None, "alone with no id but with words enough"), (5, ""), (5, ""), (6, None), (7, other.upper())]
    got = ngram_join.keep_one(spark.createDataFrame(data, "doc_id long, text string")).collect()
    want = [(1, SAID), (2, other), (None, "alone with no id but with words enough"), (5, ""), (5, ""), (6, None)]
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))
    same = [(1, SAID, "b"), (1, SAID, "a"), (1, SAID + " ", "c"), (3, SAID, "d")]
    got = ngram_join.keep_one(spark.createDataFrame(same, "doc_id long, text string, lang string")).collect()
    assert len(got) == 1 and got[0]["doc_id"] == 1


def test_keep_one_stands_any_column_name(spark):
    names = ["key", "fate_id", "fate_key", "stays", "row", "rank", "node", "label", "a", "b", "part", "sig", "text_key", "__gone", "a.b"]
    data = [(k, SAID if k < 3 else f"{k} others", *[k] * len(names)) for k in range(5)]
    docs = spark.createDataFrame(data, "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in names))
    got = ngram_join.keep_one(docs)
    assert got.columns == docs.columns
    assert sorted(tuple(r) for r in got.collect()) == sorted(d for d in data if d[0] not in (1, 2))
