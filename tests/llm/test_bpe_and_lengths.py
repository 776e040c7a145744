import hashlib
import struct
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tesela.llm import bpe, lengths
from tesela.llm.queries import VOCABULARY

tokenizers = pytest.importorskip("tokenizers")
PEER = tokenizers.Tokenizer.from_file(VOCABULARY)
CASES = ["", " ", "a", "hello  world\n\n x", "<|endoftext|>a<|endoftext|>", "aaaaaaaaaaa" * 30, " \x85\x1c\x1d x", "naïve ½ x² ǅ 日本語 😀😀 ́", "I'm don't we'LL 's", "\t\ttabs  ", "ﷺ ١٢٣ mañana", "�\0", "=-" * 80]


def ids(text):
    raw = bpe.automaton(VOCABULARY).encode(text)
    return list(struct.unpack(f"<{len(raw) // 4}I", raw))


@pytest.mark.parametrize("text", CASES)
def test_ids_equal_the_library(text):
    assert ids(text) == PEER.encode(text, add_special_tokens=False).ids
    assert bpe.automaton(VOCABULARY).count(text) == len(ids(text))


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    want = PEER.encode(text, add_special_tokens=False).ids
    assert ids(text) == want
    assert bpe.automaton(VOCABULARY).decode(bpe.automaton(VOCABULARY).encode(text)) == PEER.decode(want, skip_special_tokens=False)


@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=25), st.text(alphabet="abc", max_size=14))
@settings(max_examples=300, deadline=None)
def test_any_merges(pairs, word):
    """Small random vocabularies against the definition: merge the pair of lowest number, leftmost first, until none is left."""
    labels, merges, seen = [b"a", b"b", b"c"], [], {b"a", b"b", b"c"}
    for a, b in pairs:
        if a < len(labels) and b < len(labels) and labels[a] + labels[b] not in seen:
            seen.add(labels[a] + labels[b])
            merges.append((a, b, len(labels)))
            labels.append(labels[a] + labels[b])
    made = bpe.BpeAutomaton(labels, merges, {}).encode_word(word.encode())
    tokens = [b"abc".index(c) for c in word.encode()]
    rank = {(a, b): (k, w) for k, (a, b, w) in enumerate(merges)}
    while found := [(rank[p][0], i) for i, p in enumerate(zip(tokens, tokens[1:], strict=False)) if p in rank]:
        _, i = min(found)
        tokens[i : i + 2] = [rank[tokens[i], tokens[i + 1]][1]]
    assert made == tokens


def test_frames(spark):
    texts = [*CASES, None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 AS _bpe", "2 AS n_tokens")
    out = {r.doc_id: r for r in bpe.encoding_digests(df, "text", VOCABULARY).collect()}
    for i, t in enumerate(texts):
        want = PEER.encode(t or "", add_special_tokens=False).ids
        assert out[i].n_tokens == len(want)
        assert out[i].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(want)}I", *want)).hexdigest()
        assert out[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    coded = bpe.decode_ids(bpe.encode_texts(df, "text", VOCABULARY), "ids", VOCABULARY)
    assert {r.doc_id: r.decoded for r in coded.collect()} == {i: t or "" for i, t in enumerate(texts)}
    assert all(r.round_trip for r in bpe.encode_checked(df, "text", VOCABULARY).collect())
    assert bpe.encoding_digests(df.limit(0), "text", VOCABULARY).count() == 0


def test_context_table(spark):
    sizes = [0, 0, 3, 5, 5, 700, 70_000, 70_001, 131_072]
    table = lengths.context_table(lengths.length_histogram(spark.createDataFrame([(x,) for x in [*sizes, None]], "n_tokens long")))
    got = {r.n_tokens: r for r in table.collect()}
    assert {k: r.n_docs for k, r in got.items()} == dict(Counter(sizes))
    for limit, r in got.items():
        within = [x for x in sizes if x <= limit]
        assert (r.docs_within, r.docs_beyond, r.tokens_within) == (len(within), len(sizes) - len(within), sum(within))
        assert r.truncated_total == sum(min(x, limit) for x in sizes)
        assert r.quantile == pytest.approx(len(within) / len(sizes))
    assert lengths.context_table(lengths.length_histogram(spark.createDataFrame([], "n_tokens long"))).count() == 0


def test_query_counts_as_the_library(spark):
    from tesela.llm.queries import op10_token_counts

    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    want = Counter(len(PEER.encode(t, add_special_tokens=False).ids) for t in docs)
    assert {r.n_tokens: r.n_docs for r in op10_token_counts(spark, "/root/testdata/sf0.001").collect()} == dict(want)


def test_decoding_ids_that_no_text_has():
    table = bpe.automaton(VOCABULARY)
    good = table.encode("abc d")
    assert table.decode(good + b"\xff\xff\xff\xff" + good) == "abc d\ufffdabc d"
    assert table.decode(good + b"\1\2") == "abc d\ufffd"
    assert table.decode(b"") == ""


def test_memory_of_words_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "WORD_BYTES", 20_000)
    memo = bpe._Memo(len)
    for i in range(5000):
        assert memo[f"w{i % 700}x"] == len(f"w{i % 700}x") and memo["often"] == 5
        assert len(memo) + len(memo._elder) < 200
    assert memo["y" * 100_000] == 100_000 and "y" * 100_000 not in memo


def test_a_very_long_word_takes_time_in_proportion():
    """A text without a space is one word; eight times the length would take 64 times as long if the rest were copied at each token."""
    import random
    import time

    rng = random.Random(1)
    short, long = ("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n)) for n in (250_000, 2_000_000))
    made = bpe.automaton(VOCABULARY)
    took = []
    for word in (short, long):
        began = time.perf_counter()
        out = made.encode_word(word.encode())
        took.append(time.perf_counter() - began)
        assert b"".join(made.labels[i] for i in out) == word.encode()
    assert took[1] < 20 * took[0]
    assert ids(short) == PEER.encode(short, add_special_tokens=False).ids
