import hashlib
import random

import numpy as np

from tesela.llm import repeats

SCHEMA = "doc_id long, text string"


def brute(rows):
    """(n_bytes, n_removed, n_spans, kept_sha256) by a table of all 200-byte strings."""
    raw = [(t or "").encode() for _, t in rows]
    seen = {}
    for d, x in enumerate(raw):
        for i in range(len(x) - 199):
            seen.setdefault(hash(x[i : i + 200]), []).append((d, i))
    gone = [np.zeros(len(x) + 2, bool) for x in raw]
    for places in seen.values():
        if len(places) > 1:
            for d, i in places:
                gone[d][i + 1 : i + 201] = True
    out = []
    for (k, _), x, g in zip(rows, raw, gone, strict=True):
        kept = bytes(b for b, r in zip(x, g[1:], strict=False) if not r)
        out.append((k, len(x), int(g.sum()), int((g[1:] & ~g[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def found(spark, rows):
    return sorted((tuple(r) for r in repeats.repeat_digests(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)


def test_documents_match_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    assert sorted((tuple(r) for r in repeats.repeat_digests(docs).collect()), key=str) == brute(rows)


def test_edges(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdefghij é") for _ in range(n))
    passage = word(500)
    rows = [(1, None), (2, ""), (3, "x" * 199), (4, "x" * 200), (5, "y" * 201), (6, "ab" * 300), (None, passage), (7, passage), (7, passage), (8, word(30) + passage[100:350] + word(10))]
    rows += [(20 + i, word(i) + passage[i : i + 195 + i] + word(9)) for i in range(12)]
    rows += [(40, passage[:250] + passage[:250]), (41, "\0" * 250 + passage[-200:]), (42, word(90_000) + passage[:220])]
    assert found(spark, rows) == brute(rows)
    assert repeats.repeat_digests(spark.createDataFrame([], SCHEMA)).count() == 0


def test_hot_anchor_goes_string_by_string(spark, monkeypatch):
    rng = random.Random(6)
    passage = "".join(rng.choice("abcdefgh") for _ in range(260))
    rows = [(i, "".join(rng.choice("abcdefgh") for _ in range(80)) + passage + "".join(rng.choice("abcdefgh") for _ in range(80))) for i in range(40)]
    monkeypatch.setattr(repeats, "MANY", 10)
    assert found(spark, rows) == brute(rows)


def test_kept_bytes_and_clashing_columns(spark):
    text = "".join(chr(97 + (i * i) % 26) for i in range(300))
    df = spark.createDataFrame([(1, text, 5), (2, text + "tail", 6), (3, "short", 7)], "doc_id long, text string, spans int").selectExpr("*", "1 AS key", "'z' AS kept")
    out = repeats.remove_repeats(df)
    assert out.columns == ["doc_id", "text", "spans", "key", "n_bytes", "n_removed", "n_spans", "kept"]
    assert {r.doc_id: (r.spans, bytes(r.kept)) for r in out.collect()} == {1: (5, b""), 2: (6, b"tail"), 3: (7, b"short")}


def test_index_against_naive_matches():
    rng = random.Random(7)
    pieces = ["".join(rng.choice("ab") for _ in range(rng.randrange(1, 40))).encode() for _ in range(30)] + [b"abab" * 5, b"abab" * 5]
    starts = np.cumsum([0, *map(len, pieces)])[:-1]
    index = repeats.RunLengthIndex(np.frombuffer(b"".join(pieces), np.uint8), starts)
    suffixes = [p[i:] for p in pieces for i in range(len(p))]

    def common(a, b):
        return next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))

    naive = [max(common(a, b) for j, b in enumerate(suffixes) if j != i) for i, a in enumerate(suffixes)]
    assert index.matching_statistics().tolist() == naive
    assert len(index.run_start) < len(suffixes)
