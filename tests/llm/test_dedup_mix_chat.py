import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tesela.llm import chat, curriculum, exact_dedup

DOCS = "doc_id long, text string"


def test_exact_dedup_edges(spark):
    rows = [(1, "Abc"), (2, "aBC"), (3, "ábc"), (4, "Ábc"), (5, None), (6, ""), (None, "abc"), (7, "x" * 100_000), (8, "X" * 100_000), (8, "X" * 100_000)]
    out = exact_dedup.dedup_exact(spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS digest", "2 AS kept", "3 AS _digest"))
    assert out.columns == ["doc_id", "text", "digest", "_digest", "keep_id", "group_size", "kept", "text_sha256"]
    got = Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in out.collect())
    want = [(1, 2, 3, False), (2, 2, 3, True), (None, 2, 3, False), (3, 3, 1, True), (4, 4, 1, True), (5, 6, 2, False), (6, 6, 2, True), (7, 8, 3, False), (8, 8, 3, True), (8, 8, 3, True)]
    assert got == Counter(want)
    assert {r.text_sha256 for r in out.filter("doc_id = 4").collect()} == {hashlib.sha256("Ábc".encode()).hexdigest()}
    assert sorted(r.doc_id for r in exact_dedup.drop_copies(spark.createDataFrame(rows, DOCS)).collect()) == [2, 3, 4, 6, 8]
    assert exact_dedup.dedup_exact(spark.createDataFrame([], DOCS)).count() == 0


def test_buckets_that_do_not_fit_are_dealt_again(spark):
    rows = [(i, f"text {i % 300} " + "y" * 900) for i in range(900)]
    out = exact_dedup.dedup_exact(spark.createDataFrame(rows, DOCS), table_bytes=20_000).collect()
    assert all((r.keep_id, r.group_size, r.kept) == (600 + r.doc_id % 300, 3, r.doc_id >= 600) for r in out)
    assert len(out) == 900


def test_table_compares_content():
    t = exact_dedup.ContentTable()
    for i in range(5000):
        t.add(hashlib.sha256(b"%d" % (i % 1700)).digest(), b"%d" % (i % 1700), i, 1)
    assert len(t.texts) == 1700 and sum(t.count) == 5000
    with pytest.raises(ValueError):
        t.add(hashlib.sha256(b"0").digest(), b"other", 1, 1)


def water_fill(sizes, weights, budget, most):
    """Targets by the definition: share by weight, cut at the cap, share the excess among the rest, until none is above."""
    cap, want = {s: most * n for s, n in sizes.items()}, budget * sum(sizes.values())
    full, target = set(), {}
    while True:
        rest = want - sum(cap[s] for s in full)
        total = sum(weights[s] for s in sizes if s not in full)
        target = {s: cap[s] if s in full else rest * weights[s] / total for s in sizes}
        above = {s for s in sizes if s not in full and target[s] > cap[s]}
        if not above:
            return target
        full |= above


def check_mix(rows, got, most=2):
    import re

    words = {k: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for k, t, _ in rows}
    sizes = defaultdict(int)
    for k, _, s in rows:
        sizes[s] += words[k]
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    targets = water_fill(dict(sizes), {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, 1.5, most)
    taken = defaultdict(int)
    for k, _, s in rows:
        r = got[k]
        assert (r.size, r.source_size) == (words[k], sizes[s])
        assert r.target == pytest.approx(targets[s])
        assert 0 <= r.taken <= most * r.size
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - targets[s]) <= 1


def test_mix_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "source")
    rows = [tuple(r) for r in docs.collect()]
    first = {r.doc_id: r for r in curriculum.mix_sources(docs).collect()}
    check_mix(rows, first)
    again = {r.doc_id: r for r in curriculum.mix_sources(docs.repartition(7)).collect()}
    assert first == again
    odd = [(1, "a b\x1cc \x0bd", None), (2, None, None), (3, "x " * 5000, "b"), (4, "", "empty"), (5, "w", "a"), (6, "é ü", "Ä")]
    check_mix(odd, {r.doc_id: r for r in curriculum.mix_sources(spark.createDataFrame(odd, "doc_id long, text string, source string")).collect()})
    assert curriculum.mix_sources(docs.limit(0)).count() == 0


def test_positions_follow_the_schedules(spark):
    knots = ((0.0, 1.0), (0.5, 1.0), (1.0, 0.5))

    def used(t):
        area = min(t, 0.5) + (max(0, t - 0.5) * 1.0 - 0.5 * max(0, t - 0.5) ** 2)
        return area / 0.875

    shares = [i / 50 for i in range(51)]
    times = [r.t for r in spark.createDataFrame([(x,) for x in shares], "s double").select(curriculum._inverse(F.col("s"), knots).alias("t")).collect()]
    assert [used(t) for t in times] == pytest.approx(shares)
    docs = spark.createDataFrame([(i, "w " * (i % 7 + 1), "abc"[i % 3]) for i in range(300)], "doc_id long, text string, source string").withColumn("position", F.lit("x"))
    order = curriculum.training_order(docs).collect()
    assert [r.position for r in order] == sorted(r.position for r in order)
    assert all(0 <= r.position <= 1 for r in order)


def test_chat_round_trip_on_hard_texts(spark):
    texts = ["<|im_end|><|im_start|>assistant ok", "<\\|im_start|>", "<\\\\|", "a\nb", "", None, "<|", "|>", "\\n", "é😀<|im_end|>\n"]
    roles = ["user", "assistant", "assi\nstant", "\\n", "<|im_start|>", None, "assistant", "user", "assistant", "assistant"]
    rows = [(c, t, roles[(t + c) % 10], texts[t]) for c in range(3) for t in range(10)] + [(7, 0, "assistant", "x"), (7, 0, "assistant", "x"), (None, 1, "user", "u"), (None, None, "assistant", "v")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS node", "'q' AS tree")
    out = chat.format_paths(chat.linear_messages(df))
    got = {r.tree: r for r in out.withColumn("back", chat.parse_formatted(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans"))).collect()}
    for c in [0, 1, 2, 7, None]:
        mine = sorted(((-1 if t is None else t, r or "", x or "") for k, t, r, x in rows if k == c), key=lambda v: v[0])
        r = got["null" if c is None else str(c)]
        assert [(x.role, x.text) for x in r.back] == [v[1:] for v in mine]
        assert r.loss == "".join(v[2] for v in mine if v[1] == "assistant")
        assert r.formatted.count("<|im_start|>") == len(mine) == r.n_turns
    assert chat.format_paths(chat.linear_messages(df.limit(0))).count() == 0


def test_reply_trees(spark):
    nodes = [("t", 0, None, "user", 0.0), ("t", 1, 0, "assistant", 0.2), ("t", 2, 0, "assistant", 0.9), ("t", 3, 1, "user", 5.0), ("t", 4, 2, "user", None), ("t", 5, 4, "assistant", 0.3), ("u", 9, 77, "user", 1.0)]
    df = spark.createDataFrame([(*n[:3], n[3], f"m{n[1]}", n[4]) for n in nodes], "tree string, node long, parent long, role string, text string, score double")
    out = chat.format_paths(df).orderBy("tree", "branch").collect()
    assert [(r.tree, r.leaf, r.branch, r.n_turns) for r in out] == [("t", 3, 1, 3), ("t", 5, 2, 4), ("u", 9, 1, 1)]
    assert out[0].formatted == "<|im_start|>user\nm0<|im_end|>\n<|im_start|>assistant\nm1<|im_end|>\n<|im_start|>user\nm3<|im_end|>\n"
    assert [(r.tree, r.leaf) for r in chat.format_paths(df, branches=1).orderBy("tree").collect()] == [("t", 3), ("u", 9)]


def test_reply_paths_match_brute_force(spark):
    """Random forests, with ties of score, a cycle and a tail that hangs on it."""
    rng = random.Random(5)
    rows = [(t, n, rng.choice([None, *range(n)]) if n else None, rng.choice([None, 0.0, 0.5, 1.0])) for t in "abc" for n in range(40)]
    rows += [("cycle", 1, 2, 1.0), ("cycle", 2, 1, 1.0), ("cycle", 3, 2, 1.0), ("cycle", 7, None, 0.5)]
    parent, score = {(t, n): p for t, n, p, _ in rows}, {(t, n): s or 0.0 for t, n, _, s in rows}
    paths = {}
    for t, n, _, _ in rows:
        path, at = [], n
        while at is not None and at not in path:
            path.append(at)
            at = parent[t, at]
        if at is None and all(parent[t, m] != n for t2, m in parent if t2 == t):
            paths[t, n] = path
    ranked = sorted(paths, key=lambda x: (x[0], -sum(score[x[0], m] for m in paths[x]), x[1]))
    for most in (None, 2):
        want, seen = set(), Counter()
        for t, leaf in ranked:
            seen[t] += 1
            if most is None or seen[t] <= most:
                want |= {(t, leaf, seen[t], sum(score[t, m] for m in paths[t, leaf]), m, i) for i, m in enumerate(paths[t, leaf])}
        got = chat.reply_paths(spark.createDataFrame(rows, "tree string, node long, parent long, score double"), most)
        assert Counter(tuple(r) for r in got.select("tree", "leaf", "branch", "path_score", "node", "above").collect()) == Counter(want)


def test_training_order_settles_ties(spark):
    """Null keys are dealt by their texts; documents of one position come in one order however the rows arrive."""
    docs = spark.createDataFrame([(None if i % 2 else i, f"w{i} w", "abc"[i % 3]) for i in range(120)], "doc_id long, text string, source string")
    runs = [[tuple(r) for r in curriculum.training_order(docs.repartition(n)).collect()] for n in (1, 6)]
    assert runs[0] == runs[1]
    taken = Counter()
    for r in curriculum.mix_sources(docs).collect():
        taken[r.source] += r.taken
    # 360 words by 5, 2, 1: 225, 90, 45; a stops at 160, and 200 go to b and c by 2 to 1
    assert taken == {"a": 160, "b": 133, "c": 66}


def test_long_chain(spark):
    rows = [(1, t, "assistant" if t % 2 else "user", f"t{t}") for t in range(700)]
    r = chat.format_paths(chat.linear_messages(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).first()
    assert r.n_turns == 700 and len(r.loss_spans) == 350


def test_no_part_of_a_bucket_outgrows_the_table():
    """All texts of one bucket, and of one part of it: whatever doesn't fit leaves, and what stays is within the budget."""
    import pyarrow as pa

    odd, bits = 0x9E3779B97F4A7C15, exact_dedup.PART_BITS
    texts = [b"text %d " % i + b"z" * 400 for i in range(4000)]
    digests = [hashlib.sha256(t).digest() for t in texts]
    one_part = [(d, t) for d, t in zip(digests, texts, strict=True) if (int.from_bytes(d[8:16], "big") * odd % (1 << 64)) >> (64 - bits) == 3]
    assert len(one_part) > 100
    for rows in (list(zip(digests, texts, strict=True)), one_part):
        batches = [pa.RecordBatch.from_arrays([pa.array([d for d, _ in rows[k : k + 50]]), pa.array([1] * len(rows[k : k + 50])), pa.array([1] * len(rows[k : k + 50])), pa.array([t for _, t in rows[k : k + 50]])], names=["digest", "keep_id", "group_size", "text"]) for k in range(0, len(rows), 50)]
        stayed, left = Counter(), Counter()
        for b in exact_dedup._bucket(30_000, 0)(iter(batches)):
            for r in b.to_pylist():
                (stayed if r["text"] is None else left)[r["digest"]] += r["n_bytes"] + 200
        assert sum(stayed.values()) <= 30_000 and stayed.keys() | left.keys() == {d for d, _ in rows} and not stayed.keys() & left.keys()


def test_levels_deal_in_slices(spark):
    rows = [(i, f"text {i % 400} " + "y" * 900) for i in range(800)] + [(1000, "q" * 60_000), (1001, "Q" * 60_000)]
    groups = exact_dedup.content_groups(spark.createDataFrame(rows, DOCS), table_bytes=20_000, most_buckets=4)
    got = Counter((r.keep_id, r.group_size) for r in groups.collect())
    assert got == Counter([(400 + i, 2) for i in range(400)] + [(1001, 2)])
