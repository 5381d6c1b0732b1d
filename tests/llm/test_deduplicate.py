"""Near-duplicate groups against all pairs with a similarity of 0.8, without any rule for candidates."""

import random

import numpy as np
import pytest
from test_contamination import shingles

from segspark.llm import similarity, simhash


def pairs_of(sets, least=0.8):
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if min(len(x), len(y)) >= least * max(len(x), len(y)) and len(x & y) >= least * len(x | y):
                yield b, a


def kept_by_all_pairs(rows):
    sets = {d: shingles(t) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs_of(sets):
        p, q = sorted((find(a), find(b)))
        root[q] = p
    return {find(d) for d in sets}


def kept(spark, rows, **more):
    return {r.doc_id for r in simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"), **more).collect()}


def families(rng, n):
    """A template of 300 words; families of two that are 0.85 alike, and about 0.66 to others."""
    base = [f"t{i}" for i in range(300)]
    out = []
    for f in range(n):
        parent = base[:]
        parent[f % 7 * 2 : f % 7 * 2 + 40] = [f"f{f}.{i}" for i in range(40)]
        twin = parent[:]
        at = rng.randrange(100, 250)
        twin[at : at + 18] = [f"g{f}.{i}" for i in range(18)]
        out += [" ".join(parent), " ".join(twin)]
    return out


@pytest.mark.parametrize("limits", [{"PAIRS": 0}, {"BLOCK": 16, "PAIRS": 1, "CENTRES": 1}])
def test_families_of_a_template(spark, monkeypatch, limits):
    """Each of many similar pairs is found, though all are candidates of one another's keys, in blocks of any size."""
    for name, value in limits.items():
        monkeypatch.setattr(similarity, name, value)
    rows = list(enumerate(families(random.Random(2), 60)))
    want = kept_by_all_pairs(rows)
    assert len(want) == 60
    assert kept(spark, rows) == want


def test_groups_of_near_copies(spark):
    """Groups whose rows are hardly linked: short texts with random words changed, about 0.8 alike or less."""
    rng, rows = random.Random(7), []
    for size in (2, 63, 65, 1200):
        base = [f"w{size}.{i}" for i in range(30)]
        for _ in range(size):
            w = base[:]
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(30)] = f"x{rng.randrange(40)}"
            rows.append((len(rows), " ".join(w)))
    assert kept(spark, rows) == kept_by_all_pairs(rows)


@pytest.mark.parametrize("roots", [[0] * 90 + [1] * 3 + [2], [0] * 30 + list(range(1, 40)), list(range(50)), [0] * 20 + [1] * 20])
def test_pairs_of_blocks(spark, monkeypatch, roots):
    """All pairs of rows of a key with different roots are candidates, whether most rows have one root or none."""
    monkeypatch.setattr(similarity, "BLOCK", 8)
    monkeypatch.setattr(similarity, "PAIRS", 1 << 20)
    rows = spark.createDataFrame([(5, i, 10 << 32) for i in range(len(roots))], "key long, node long, place long")
    known = spark.createDataFrame([(i, 1000 + r) for i, r in enumerate(roots)], "node long, root long")
    got = [(r.a, r.b) for r in similarity.candidates(similarity.rooted(rows, known), 0.8, False).collect()]
    assert set(got) == {(i, j) for j in range(len(roots)) for i in range(j) if roots[i] != roots[j]}


def test_forest_of_a_block():
    """The links of a block connect what all its similar pairs connect."""
    rng = np.random.default_rng(3)
    for n in (1, 2, 40, 300):
        sets = [np.unique(rng.integers(0, 60, rng.integers(1, 30))) for _ in range(n)]
        links = similarity.forest(np.arange(n), np.concatenate(sets).astype(np.int64), np.array([len(s) for s in sets]), 0.5)
        root = list(range(n))

        def find(i, root=root):
            while root[i] != i:
                i = root[i]
            return i

        for a, b in links.tolist():
            root[find(a)] = find(b)
        got = [find(i) for i in range(n)]
        root[:] = range(n)
        for a, b in pairs_of({i: set(s.tolist()) for i, s in enumerate(sets)}, 0.5):
            root[find(a)] = find(b)
        want = [find(i) for i in range(n)]
        assert len(links) == n - len(set(got)) and all((got[i] == got[j]) == (want[i] == want[j]) for i in range(n) for j in range(i))


def test_equal_fingerprints_of_different_texts(spark):
    """A line that is repeated often gives its fingerprint to texts that are hardly alike: all of them stay."""
    rows = [(i, " ".join(["one line of just seven plain words"] * 60 + [f"d{i}.{j}" for j in range(200)])) for i in range(10)]
    copies = [(10 + i, t.upper()) for i, t in rows[:3]]
    assert len({r.f0 for r in simhash.fingerprints(spark.createDataFrame(rows, "doc_id long, text string"), 5).collect()}) < len(rows)
    assert kept(spark, rows + copies) == kept_by_all_pairs(rows + copies) == set(range(10))


def test_all_pairs_of_similarity(spark):
    """Pairs of a similarity just over 0.8, however far their fingerprints are, and all documents of sf0.01."""
    rng, rows = random.Random(4), []
    for i in range(150):
        words = [f"p{i}.{j}" for j in range(300)]
        twin = words[:]
        at = rng.randrange(270)
        twin[at : at + 28] = [f"q{i}.{j}" for j in range(28)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(twin))]
    want = kept_by_all_pairs(rows)
    assert len(want) == 150 and kept(spark, rows) == want
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id is not null")
    assert {r.doc_id for r in simhash.deduplicate(docs).collect()} == kept_by_all_pairs([(r.doc_id, r.text) for r in docs.collect()])


def test_repeated_ids(spark):
    """No text is lost for a repeated doc_id, no copy stays, and the rows kept do not depend on the partitions."""
    t, u = (" ".join(f"{c}{i}" for i in range(20)) for c in "tu")
    rows = [(7, t, "x"), (9, t, "y"), (9, u, "z"), (9, u, "a"), (11, u, "b"), (None, t, "n"), (None, t, "n"), (12, None, "e"), (13, "", "f"), (14, "one", None), (14, "two", None), (14, "one", None)]
    want = {(7, t, "x"), (9, u, "a"), (12, None, "e"), (14, "one", None), (14, "two", None)}
    for parts in (1, 3):
        docs = spark.createDataFrame(rows, "doc_id long, text string, node string").repartition(parts)
        got = [tuple(r) for r in simhash.deduplicate(docs).collect()]
        assert sorted(map(str, got)) == sorted(map(str, [*want, (None, t, "n"), (None, t, "n")]))
    assert simhash.deduplicate(docs.limit(0)).count() == 0
    assert simhash.deduplicate(docs.select("doc_id", "text").where("doc_id < 10")).count() == 2
