from collections import Counter

import numpy as np
import pytest

from tesela.llm import near_dedup as nd

SCHEMA = "doc_id long, text string"


def shingles(text):
    words = "".join(c.lower() if c.isalnum() else " " for c in text or "").split()
    if not words:
        return Counter()
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def similarity(a, b):
    both = set(a) | set(b)
    return sum(1 / sum(max(a[e] / a[d], b[e] / b[d]) for e in both) for d in set(a) & set(b))


def brute_classes(rows):
    """class_id by all pairs that share a shingle."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    seen, texts = {}, {}
    for i, s in enumerate(sets):
        j = texts.setdefault(rows[i][1] or "", i)
        parent[find(i)] = find(j)
        for j in {j for d in s for j in seen.get(d, ())}:
            if find(i) != find(j) and 2 * len(s.keys() & sets[j].keys()) > max(len(s), len(sets[j])) and similarity(s, sets[j]) >= 0.8:
                parent[find(i)] = find(j)
        if texts[rows[i][1] or ""] == i:
            for d in s:
                seen.setdefault(d, []).append(i)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), k), k)
    return {k: least[find(i)] for i, (k, _) in enumerate(rows)}


def test_classes_match_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: r.class_id for r in nd.near_classes(docs).collect()}
    assert got == brute_classes(rows)


def test_exact_similarity_and_estimate():
    rng = np.random.default_rng(1)
    a = (np.arange(1, 301, dtype=np.uint64), rng.integers(1, 4, 300).astype(float))
    b = (np.arange(31, 331, dtype=np.uint64), rng.integers(1, 4, 300).astype(float))
    naive = similarity(Counter(dict(zip(a[0].tolist(), a[1], strict=True))), Counter(dict(zip(b[0].tolist(), b[1], strict=True))))
    assert nd.probability_jaccard(a, b) == pytest.approx(naive)
    assert nd.probability_jaccard(a, b, naive - 0.01) == pytest.approx(naive)
    for weights in ((1, 2), (1, 6)):
        for n in (1, 5, 40):
            x, y = (dict(zip(rng.integers(0, 60, n).tolist(), rng.integers(*weights, n).tolist(), strict=True)) for _ in range(2))
            vectors = [(np.array(sorted(c), np.uint64), np.array([c[k] for k in sorted(c)], float)) for c in (x, y)]
            assert nd.probability_jaccard(*vectors) == pytest.approx(similarity(Counter(x), Counter(y)))
    owner = np.repeat([0, 1], 300)
    sig = nd.prob_minhash(owner, np.concatenate((a[0], b[0])), np.concatenate((a[1], b[1])), 2, 2000)
    assert (sig[0] == sig[1]).mean() == pytest.approx(naive, abs=0.05)


def test_last_round_verifies_all_pairs_of_different_classes():
    import pyarrow as pa

    base = [f"w{i}" for i in range(200)]
    near, far = " ".join([*base[:199], "x"]), " ".join([*base[:100], *[f"y{i}" for i in range(100)]])
    same, other = list(range(nd.BANDS)), list(range(100, 100 + nd.BANDS))

    def member(tid, root, text, bands):
        offsets = np.array([0, len(text.encode())], np.int64)
        owner, h, weight = nd.weighted_shingles(np.frombuffer(text.encode(), np.uint8), offsets)
        sig = nd.prob_minhash(owner, h, weight.astype(float), 1, nd.REGISTERS)
        return {"tid": tid, "root": root, "sig": (sig[0] & np.uint64(0xFFFF)).astype(np.uint16).tobytes(), "bands": bands, "text": text}

    # in the first pair of blocks c joins a, after which d, of a's class, need not be compared; the second's pair is told in another band
    left = [[member(b"a", b"a", " ".join(base), same), member(b"d", b"a", near, same)], [member(b"e", b"e", near, same)]]
    right = [[member(b"b", b"b", far, other), member(b"c", b"c", near, other)], [member(b"f", b"f", near, same)]]
    batch = pa.RecordBatch.from_arrays([pa.array([3, 3]), pa.array(left), pa.array(right)], names=["at", "l", "r"])
    pairs = [(r["a"], r["b"]) for b in nd._block_links(iter([batch])) for r in b.to_pylist()]
    assert pairs == [(b"c", b"a")]


def test_edges_nulls_ties_and_clashing_columns(spark):
    long = " ".join(f"w{i}" for i in range(60))
    near = long.replace("w30", "other")
    rows = [(1, None), (2, ""), (3, long), (4, near), (5, long), (5, long), (6, "one two"), (7, "One, two!"), (8, "..."), (None, "only null"), (None, None)]
    out = nd.near_classes(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS class_id", "2 AS tid"))
    got = Counter((r.doc_id, r.class_id, r.class_size, r.kept) for r in out.collect())
    assert out.columns == ["doc_id", "text", "tid", "class_id", "class_size", "kept"]
    assert got == Counter(
        [(1, 1, 3, True), (2, 1, 3, False), (3, 3, 4, True), (4, 3, 4, False), (5, 3, 4, False), (5, 3, 4, False), (6, 6, 2, True), (7, 6, 2, False), (8, 8, 1, True), (None, None, 1, True), (None, 1, 3, False)]
    )
    assert nd.near_classes(spark.createDataFrame([], SCHEMA)).count() == 0
    kept = nd.drop_near_copies(spark.createDataFrame([(1, long), (1, long), (2, near), (None, "a b c"), (None, "d e f")], SCHEMA))
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, -1, 1]


def test_a_text_has_one_signature_in_any_company():
    rng = np.random.default_rng(7)
    texts = [" ".join(rng.choice(["red", "blue", "stone", "river", "of", "and", "seven"], int(n))).encode() for n in rng.integers(1, 400, 120)]

    def signed(some):
        offsets = np.concatenate(([0], np.cumsum([len(t) for t in some]))).astype(np.int64)
        owner, h, weight = nd.weighted_shingles(np.frombuffer(b"".join(some), np.uint8), offsets)
        return nd.prob_minhash(owner, h, weight.astype(np.float64), len(some), nd.REGISTERS)

    crowd = signed(texts)
    for i, t in enumerate(texts):
        assert (signed([t])[0] == crowd[i]).all()
        assert (signed([t, texts[0]])[0] == crowd[i]).all()
    wide, nd.WIDE = nd.WIDE, 400
    try:
        assert (signed(texts) == crowd).all()
    finally:
        nd.WIDE = wide


def test_blocks_of_a_large_bucket_meet_once(spark):
    """A bucket of several blocks: every pair of members in different classes is compared, whatever blocks they are in."""
    base = [f"w{i}" for i in range(60)]
    rows = [(k, " ".join(w if (i + k) % 60 else f"x{k}" for i, w in enumerate(base))) for k in range(40)]
    block, texts, nd.BLOCK, nd.TEXTS = nd.BLOCK, nd.TEXTS, 4, 3
    try:
        got = {r.doc_id: r.class_id for r in nd.near_classes(spark.createDataFrame(rows, SCHEMA)).collect()}
    finally:
        nd.BLOCK, nd.TEXTS = block, texts
    assert got == brute_classes(rows)
