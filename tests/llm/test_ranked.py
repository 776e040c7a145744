import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tesela.llm import ranked

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return [t.translate(LOWER) for t in TERM.findall(text or "")]


def brute(docs, items, k=50):
    """Every document's score for every item."""
    counts = [(doc, Counter(terms(text))) for doc, text in docs]
    counts = [(doc, c) for doc, c in counts if c]
    many, length = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        found = []
        for doc, c in counts:
            m = 50 + (50 * sum(c.values()) * many) // length
            score = sum(math.floor(1000 * math.log((2 * many + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if c[t])
            if score > 0:
                found.append((-score, doc is None, doc))
        found.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, rank, doc, -score) for rank, (score, _, doc) in enumerate(found[:k], 1)]
    return sorted(out, key=str)


def search(spark, docs, items, k=50):
    d = spark.createDataFrame([(doc, text, 1, "x") for doc, text in docs], "doc_id long, text string, score int, item string").repartition(3)
    q = spark.createDataFrame([(item, text, 2) for item, text in items], "item_id long, text string, rank int")
    got = ranked.ranked_search(d, q, k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, got.collect()), key=str)


def some_texts(seed, n, words=60):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(words)]
    p = 1 / np.arange(1, words + 1)
    return [" ".join(rng.choice(vocabulary, size=int(rng.integers(1, 40)), p=p / p.sum())) for _ in range(n)]


def test_equals_brute_force(spark, monkeypatch):
    docs = list(enumerate(some_texts(1, 400)))
    items = list(enumerate(some_texts(2, 15)))
    assert search(spark, docs, items, 7) == brute(docs, items, 7)


def test_ties_repeats_nulls_and_odd_texts(spark):
    docs = [(i, "gato Perro gato ñandú") for i in range(9, 0, -1)] + [(None, "gato perro GATO ñandú"), (None, None), (20, None), (21, ""), (22, "... \n--"), (23, "Ñandú perro"), (3, "gato"), (3, "gato"), (24, "a1_b2 日本 x y")]
    items = [(1, "GATO!"), (1, "gato"), (None, "ñandú"), (2, None), (3, ""), (4, "nobody"), (5, "b2 日本"), (6, "x y X"), (7, "gato " * 50)]
    assert search(spark, docs, items, 5) == brute(docs, items, 5)
    assert search(spark, docs, [], 5) == [] == search(spark, [], items, 5) == search(spark, [(1, None)], items, 5)


def test_a_very_long_text_and_one_length_for_many(spark, monkeypatch):
    long = " ".join(some_texts(3, 3000))
    docs = [(0, long), (1, "x" * 300_000), (2, "w1 " * 200_000)] + [(i, f"w1 w{i % 7} w9") for i in range(3, 300)]
    items = [(1, "w1 w9 w3"), (2, "w1"), (3, "x" * 300_000)]
    assert search(spark, docs, items) == brute(docs, items)


def test_items_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ranked, "ITEM_BYTES", 100)
    docs, items = list(enumerate(some_texts(4, 80))), list(enumerate(some_texts(5, 9)))
    assert search(spark, docs, items, 3) == brute(docs, items, 3)


@pytest.mark.parametrize("size", [1, 7, 1 << 22])
def test_slices_cut_between_terms(monkeypatch, size):
    monkeypatch.setattr(ranked, "SLICE", size)
    text = "Uno, dos—TRES  ñÑ x1;y2\n" * 5 + "z" * 40
    got = [t.decode() for some in ranked.folded_terms(text.encode()) for t in some]
    assert got == terms(text)


def test_shards_that_cannot_reach_are_left_out(monkeypatch):
    """One document holds a rare term: shards are visited until it is found, and no longer."""
    opened = []

    class Counted(ranked.Shard):
        def __init__(self, row):
            opened.append(row["m"])
            super().__init__(row)

    monkeypatch.setattr(ranked, "Shard", Counted)
    one = lambda m, term, tf: ranked._shard(m, pa.array([m], pa.int64()), np.array([term], np.int32), np.array([tf], np.int32), np.zeros(1, np.int64))
    batch = pa.Table.from_batches([one(70, 0, 1), one(60, 0, 9), one(80, 0, 2), one(90, 1, 1)]).combine_chunks().to_batches()[0]
    items = ranked.Items(np.array([0]), np.array([10]), np.array([0, 1]))
    (found,) = ranked._visit(items, 1, np.zeros(1, np.int64))(iter([batch]))
    assert found.column("doc").to_pylist() == [60] and opened == [60]


def test_shards_hold_at_most_so_many(monkeypatch):
    monkeypatch.setattr(ranked, "SHARD", 3)
    rows = [pa.RecordBatch.from_arrays([pa.array([1, 2, None, 4], pa.int64()), pa.array([[0], [0, 1], [1], [0]], pa.list_(pa.int32())), pa.array([[1], [2, 1], [1], [5]], pa.list_(pa.int32())), pa.array(ms, pa.int64())], names=["doc", "terms", "tfs", "m"]) for ms in ([50, 50, 50, 50], [50, 50, 51, 52])]
    shards = [r for b in ranked._pack(iter(rows)) for r in b.to_pylist()]
    assert [(s["m"], s["docs"]) for s in shards] == [(50, [1, 2, None]), (50, [4, 1, 2]), (51, [None]), (52, [4])]
