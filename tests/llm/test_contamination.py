"""Containment search against SQL and brute force."""

import random

from oracle import compare

from segspark.llm import contamination
from segspark.llm.queries import SQL, op5_contamination

SF = "/root/testdata/sf0.001"


def test_query_equals_sql(spark):
    assert compare(op5_contamination(spark, SF), SQL["op5_contamination"], SF) > 0


def shingles(t, k=5):
    w = (t or "").encode().lower().split()
    return {b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)} or ({b" ".join(w)} if w else set())


def test_edges(spark):
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(400)}"
    items = [(i, " ".join(word() for _ in range(rng.randint(1, 90)))) for i in range(40)]
    items += [(40, None), (41, "  "), (42, "one"), (42, "one two THREE four five"), (None, "null id item with words here")]
    docs = [(0, None), (1, ""), (2, "one"), (3, "x one two three four five y"), (4, "null  id\nitem with words here"), (None, items[0][1])]
    for n in range(60):
        body = [word() for _ in range(rng.randint(0, 3000))]
        for _ in range(2):
            part = items[rng.randrange(40)][1].split()
            if rng.random() < 0.5 and len(part) > 30:
                part[rng.randrange(len(part))] = "edited"
            at = rng.randint(0, len(body))
            body[at:at] = part
        docs.append((n + 10, " ".join(body)))
    docs.append(docs[-1])
    want = sorted((str(d), str(i), len(s & t), len(s)) for d, x in docs for t in [shingles(x)] for i, y in items for s in [shingles(y)] if s and len(s & t) >= 0.8 * len(s))
    frames = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, item_id int"), spark.createDataFrame(items, "item_id long, text string")
    for size in (contamination.ITEM_BLOCK_BYTES, 2000):
        got = contamination.matches(*frames, block_bytes=size).collect()
        assert sorted((str(r.doc_id), str(r.item_id), r.n_shared, r.n_shingles) for r in got) == want
    assert contamination.matches(frames[0].limit(0), frames[1]).count() == contamination.matches(frames[0], frames[1].limit(0)).count() == 0


def test_short_items(spark):
    """Items of few shingles are found wherever they are: in windows of like size, not in larger ones."""
    rng = random.Random(9)
    size = lambda d: d % 3 + 1  # noqa: E731  shingles of an item
    items = [(d, " ".join(f"i{d}x{j}" for j in range(size(d) + 4))) for d in range(6000)]
    docs = [(d, " ".join([*(f"w{rng.randrange(4000)}" for _ in range(rng.randrange(60))), t, *(f"w{rng.randrange(4000)}" for _ in range(60))])) for d, t in items]
    found = contamination.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id, r.n_shared, r.n_shingles) for r in found) == [(d, d, size(d), size(d)) for d, _ in items]
