import zlib

import numpy as np
import pyarrow as pa
import pytest

from tesela.llm import quality
from tesela.llm.common import text_bytes
from tesela.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"


def numbered(texts):
    return quality.word_numbers(*text_bytes(pa.array(texts, pa.string())))


def test_words_and_signs():
    words, owner = numbered(["Uno uno, uno!!", None, "", "  \n\t", "uno, ñ日-ñ日"])
    assert owner.tolist() == [0] * 5 + [4] * 5
    assert words[1] == words[3] == words[5] != words[0] and words[2] == words[6] != words[4] and words[7] == words[9]
    assert len(numbered([])[0]) == len(numbered([None, " "])[0]) == 0


def plain_sums(texts):
    """Neighbours by loops."""
    places, signs = quality.random_vectors()
    total = np.zeros((quality.WORDS, quality.WIDTH))
    for text in texts:
        words = numbered([text])[0]
        for i, w in enumerate(words):
            for j in range(max(0, i - quality.NEAR), min(len(words), i + quality.NEAR + 1)):
                if i != j:
                    np.add.at(total[w], places[words[j]], signs[words[j]])
    return total


def test_word_vectors_and_pools_equal_loops(spark, monkeypatch):
    texts = [f"a b{i % 5} c, d{i % 3} !! a a" for i in range(40)] + [None, "", "x", "a b"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(5)
    got = quality.word_vectors(df)
    want = plain_sums(texts)
    assert np.allclose(got, want / np.maximum(np.sqrt((want**2).sum(1, keepdims=True)), 1e-9), atol=1e-6)
    assert not quality.word_vectors(df.limit(0)).any()
    x = quality.pooled(got, *text_bytes(pa.array(texts, pa.string())))
    for row, text in zip(x, texts, strict=True):
        u = got[numbered([text])[0]]
        mean = u.mean(0) if len(u) else np.zeros(quality.WIDTH)
        pairs = (u[1:] * u[:-1]).mean(0) if len(u) > 1 else np.zeros(quality.WIDTH)
        assert np.allclose(row, np.concatenate((mean, pairs, [np.log1p(len(u))])), atol=1e-5)


def test_long_texts_come_in_slices(monkeypatch):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(quality.WORDS, quality.WIDTH)).astype(np.float32)
    texts = ["uno dos, tres " * 500, "x", "w" * 5000, None, "a b c"]
    whole = quality.pooled(vectors, *text_bytes(pa.array(texts, pa.string())))
    monkeypatch.setattr(quality, "SLICE", 300)
    cut = quality.pooled(vectors, *text_bytes(pa.array(texts, pa.string())))
    # pairs of neighbours over a cut are left out; a word longer than a slice counts as several
    assert np.allclose(whole[[1, 3, 4]], cut[[1, 3, 4]]) and np.allclose(whole[0, : quality.WIDTH], cut[0, : quality.WIDTH])
    assert cut[2, -1] > whole[2, -1]


def test_network_learns_and_is_calibrated():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(4000, 2 * quality.WIDTH + 1))
    chance = 1 / (1 + np.exp(-(3 * np.tanh(2 * x[:, 0]) + x[:, 2])))
    y = (rng.random(4000) < chance).astype(float)
    net = quality.fit_network(x[:3000], y[:3000])
    p = net.probabilities(x[3000:])
    assert ((p > 0.5) == (chance[3000:] > 0.5)).mean() > 0.8
    raw = quality.Network(net.mean, net.spread, net.weights)
    assert quality._loss(net.logits(x[3000:]), y[3000:], net.temperature) < quality._loss(raw.logits(x[3000:]), y[3000:], 1.0) + 0.01


def test_temperature_of_separable_rows_is_bounded():
    assert quality.fit_temperature(np.array([-9.0, -8, 8, 9] * 5), np.array([0.0, 0, 1, 1] * 5)) > 1


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, 1), (2, 1)], [(99, 0), (99, 1)]])
def test_labels_that_teach_nothing(spark, rows):
    docs = spark.createDataFrame([(1, "a b", 5.0), (2, None, 6.0), (None, "", 7.0), (2, "a b", 8.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame(rows, "doc_id long, quality int")
    out = quality.score_quality(docs, quality.learn_quality(docs, labels)).collect()
    share = 1.0 if len(rows) == 2 and rows[0][0] == 1 else 0.5
    assert {r["score"] for r in out} == {share} and {r["predicted"] for r in out} == {1} and len(out) == 4
    assert quality.score_quality(docs.limit(0), quality.learn_quality(docs, labels)).count() == 0


def test_only_the_text_counts(spark):
    good, bad = "the cat and the dog are in the house, and it is late. ", "BUY!! NOW!! | x | y | $$$ "
    docs = spark.createDataFrame([(i, (good if i % 3 else bad) * (1 + i % 4), i) for i in range(240)] + [(500, None, 1), (501, None, 2), (502, "", 3), (503, good, 0), (504, good, 9)], "doc_id long, text string, predicted int")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(240)], "doc_id long, quality int")
    model = quality.learn_quality(docs, labels, sample=200)
    out = {r["doc_id"]: r for r in quality.score_quality(docs.repartition(7), model).collect()}
    assert all(out[i]["predicted"] == int(i % 3 > 0) for i in range(240))
    assert out[500]["score"] == out[501]["score"] == out[502]["score"] and out[503]["score"] == out[504]["score"] == out[1 + 3 * 5]["score"]


def test_held_out_accuracy(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = QUERIES["op13_quality_classifier"](spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    held = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert sum(p == y for p, y in held) / len(held) > 0.97
    assert sum(p for p, y in held if y == 1) / sum(y for _, y in held) > 0.98
