"""Language identification by mixtures: expectation-maximisation of each document's language proportions.

A word's likelihood under a language comes from byte 3-grams (with a word mark at both ends) in a smoothed table learned from labelled
documents.  A document is a mixture of languages over its words; its proportions are fitted by EM, and the set of languages is chosen
by penalised likelihood among the nested sets of the most probable ones.  All words of a batch are computed at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesela.llm.common import mixed, release, row_ranges, stash, text_bytes, whole_row

#: Rows of the hashed n-gram table; the model is at most this many rows a language, whatever the corpus.
TABLE = 1 << 16
#: Labels that a model may hold (256 MB of TABLE); with more, learning raises an error.  Labels whose counts are held at once.
MAX_LANGUAGES, GROUP = 1024, 64
#: Bytes of text that are worked on at once; steps of EM; pseudo-count of an n-gram; the weight of the penalty on each language.
CHUNK, STEPS, SMOOTH, PENALTY = 1 << 19, 12, 0.1, 3.0

UNDETERMINED = "und"


@dataclass
class LanguageModel:
    languages: list[str]
    log_p: np.ndarray  # (TABLE, languages), float32


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n-gram row of each word byte, start of each word among these, document of each word).

    Words are runs of bytes other than ASCII non-letters, A to Z lower-cased; bytes of other scripts count as letters.
    """
    letter = np.zeros(256, bool)
    letter[ord("a") : ord("z") + 1] = letter[ord("A") : ord("Z") + 1] = letter[128:] = True
    lower = np.arange(256, dtype=np.uint8)
    lower[ord("A") : ord("Z") + 1] += 32
    inside = letter[data]
    text = np.where(inside, lower[data], 32).astype(np.uint64)
    # a word must not reach over a document's end, so a break stands where each document starts
    first = np.zeros(len(data), bool)
    first[offsets[:-1][offsets[:-1] < len(data)]] = True
    at = np.flatnonzero(inside)
    begins = np.ones(len(at), bool)
    begins[1:] = (np.diff(at) > 1) | first[at[1:]]
    ends = np.ones(len(at), bool)
    ends[:-1] = begins[1:]
    here = text[at]
    left = np.where(begins, 32, np.concatenate((here[:1], here[:-1])))
    right = np.where(ends, 32, np.concatenate((here[1:], here[:1])))
    grams = mixed((left << np.uint64(16)) | (here << np.uint64(8)) | right) & np.uint64(TABLE - 1)
    starts = np.flatnonzero(begins)
    owner = np.searchsorted(offsets, at[starts], "right") - 1
    return grams.astype(np.int64), starts, owner


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each task's n-gram counts by label, told whenever a group of labels is full: the sums over tasks add them up."""
    tables: dict[str, np.ndarray] = {}

    def told() -> Iterator[pa.RecordBatch]:
        for label, counts in tables.items():
            rows = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([label] * len(rows), pa.string()), pa.array(rows, pa.int64()), pa.array(counts[rows], pa.int64())], names=["lang", "gram", "n"])
        tables.clear()

    for batch in batches:
        labels = np.array(batch.column("lang").to_pylist(), dtype=object)
        for label in set(labels):
            if label not in tables and len(tables) == GROUP:
                yield from told()
            rows = pa.array(np.flatnonzero(labels == label))
            data, offsets = text_bytes(batch.column("text").take(rows))
            counts = tables.setdefault(label, np.zeros(TABLE, np.int64))
            for lo, hi in row_ranges(np.diff(offsets), CHUNK):
                grams, _, _ = _words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                counts += np.bincount(grams, minlength=TABLE)
        release()
    yield from told()


def is_held_out(key: Column) -> Column:
    """Whether the CRC-32 of the key as text leaves 2 modulo 4; null keys are not held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn_languages(labelled: DataFrame, text: str = "text", lang: str = "lang") -> LanguageModel:
    """Learn from every row with text and label; every label is kept.  n-gram counts are summed on the cluster; the driver gets the hashed
    table by groups of labels.  More than MAX_LANGUAGES labels with n-grams raise a ValueError."""
    rows = labelled.filter(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    counts = stash(rows.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    languages = sorted(r["lang"] for r in counts.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} labels: the model would not fit, and dropping some would give wrong languages")
    log_p = np.zeros((TABLE, len(languages)), np.float32)
    for lo in range(0, len(languages), GROUP):
        group = languages[lo : lo + GROUP]
        got = counts.filter(F.col("lang").isin(group)).toArrow()
        place = {x: i for i, x in enumerate(group)}
        columns = np.array([place[x] for x in got.column("lang").to_pylist()], np.int64)
        smooth = np.full((TABLE, len(group)), SMOOTH)
        smooth[got.column("gram").to_numpy(), columns] += got.column("n").to_numpy()
        log_p[:, lo : lo + len(group)] = np.log(smooth / smooth.sum(0, keepdims=True))
    return LanguageModel(languages, log_p)


def _mixture(likely: np.ndarray, starts: np.ndarray, sizes: np.ndarray, start_with: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """EM over the words of many documents: (proportions, log-likelihoods); languages with proportion 0 at the start stay out."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    share = start_with
    for _ in range(steps):
        r = likely * share[owner]
        r /= r.sum(1, keepdims=True)
        share = np.add.reduceat(r, starts, axis=0) / sizes[:, None].astype(np.float32)
    fit = np.log((likely * share[owner]).sum(1, dtype=np.float64))
    return share, np.add.reduceat(fit, starts)


def infer_mixtures(model: LanguageModel, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, proportions of the chosen languages) for the documents of a buffer that have words."""
    grams, starts, owner = _words(data, offsets)
    k = len(model.languages)
    if not len(starts) or not k:
        return np.zeros(0, np.int64), np.zeros((0, k), np.float32)
    # the likelihoods of the words of about CHUNK bytes and four languages at once
    score, bounds = np.zeros((len(starts), k), np.float32), np.append(starts, len(grams))
    for lo, hi in row_ranges(np.diff(bounds), 4 * CHUNK // k):
        score[lo:hi] = np.add.reduceat(model.log_p[grams[bounds[lo] : bounds[hi]]], starts[lo:hi] - bounds[lo], axis=0)
    likely = np.exp(np.maximum(score - score.max(1, keepdims=True), -60.0))  # of each word, up to a factor that all languages share
    first = np.flatnonzero(np.concatenate(([True], np.diff(owner) > 0)))
    docs, sizes = owner[first], np.diff(np.concatenate((first, [len(owner)])))
    share, fit = _mixture(likely, first, sizes, np.full((len(docs), k), 1 / k, np.float32), STEPS)
    single = np.add.reduceat(np.log(likely.astype(np.float64)), first, axis=0)
    rank = np.argsort(-share, axis=1, kind="stable")
    best = single.argmax(1)
    chosen = np.zeros_like(share)
    chosen[np.arange(len(docs)), best] = 1
    penalty = PENALTY * np.log(sizes + 1.0)
    value = single[np.arange(len(docs)), best] - penalty
    # no set of m languages fits better than all of them: only documents that gain from a second one are looked at further
    for m in range(2, k + 1):
        rows = np.flatnonzero(fit - penalty * m > value)
        if not len(rows):
            continue
        words = np.concatenate([np.arange(first[i], first[i] + sizes[i]) for i in rows])
        begin = np.zeros_like(share[rows])
        for j in range(m):
            begin[np.arange(len(rows)), rank[rows, j]] = np.maximum(share[rows, rank[rows, j]], 1e-4)
        begin /= begin.sum(1, keepdims=True)
        at = np.concatenate(([0], np.cumsum(sizes[rows])[:-1]))
        part, part_fit = _mixture(likely[words], at, sizes[rows], begin, STEPS)
        gain = part_fit - penalty[rows] * m
        better = gain > value[rows]
        chosen[rows[better]], value[rows[better]] = part[better], gain[better]
    return docs, chosen


def _predict(model: LanguageModel):
    def run(keys_and_texts: pa.Array) -> pa.Array:
        n = len(keys_and_texts)
        data, offsets = text_bytes(keys_and_texts)
        languages = [UNDETERMINED] * n
        scores, sets = np.zeros(n), [[] for _ in range(n)]
        for lo, hi in row_ranges(np.diff(offsets), 4 * CHUNK // max(4, len(model.languages))):
            docs, shares = infer_mixtures(model, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            top = shares.argmax(1) if len(docs) else []
            for d, share, t in zip(docs, shares, top, strict=True):
                languages[lo + d], scores[lo + d] = model.languages[t], min(1.0, max(0.0, float(share[t])))
                sets[lo + d] = [model.languages[j] for j in np.argsort(-share, kind="stable") if share[j] > 0]
        release()
        return pa.StructArray.from_arrays([pa.array(languages, pa.string()), pa.array(scores, pa.float64()), pa.array(sets, pa.list_(pa.string()))], ["lang_pred", "score", "lang_set"])

    return run


def identify_languages(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """docs with lang_pred string, score double (the proportion of the predicted language) and lang_set array<string> (largest first).

    Only the text counts.  Null texts and texts without any Unicode letter are `und` with score 0 and an empty set; so is every text if
    the model knows no language.  Texts in scripts that the model never met still get the likeliest of its languages.  Columns of docs
    with the names of the added ones are replaced.  Words of one text are held at once: about 60 bytes a byte of text and language.
    """
    added = ["lang_pred", "score", "lang_set"]
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by TABLE and MAX_LANGUAGES
    udf = F.arrow_udf(lambda texts: _predict(sent.value)(texts), "struct<lang_pred:string,score:double,lang_set:array<string>>")
    udf = udf.asNondeterministic()  # else a filter on its columns would run it twice
    has_letter = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    made = docs.select(whole_row(docs, added), has_letter.alias("_letter"), udf(F.when(has_letter, F.col(text)).otherwise(F.lit(""))).alias("_id"))
    return made.select(
        "_row.*",
        F.when(F.col("_letter"), F.col("_id.lang_pred")).otherwise(UNDETERMINED).alias("lang_pred"), F.col("_id.score"), F.col("_id.lang_set"),
    )
