"""Byte-level BPE as a deterministic token automaton, applied to whole texts in Arrow batches.

Compilation adds one gadget per merge.  The automaton starts with one state in which every byte loops.  Merging (u, v) into w
redirects u's arc to a copy of its target that lacks the arc v, and gives w an arc wherever u, then v, could be read.  So a token's
arc leads to the same state from everywhere, and a state is the chain of copies that made it: one removed arc a copy, with the
merge's number.  An arc w = uv exists in a state if u's arc existed there when w was made, hence a walk down the left parts of w
answers whether it exists; the answers are kept in a table of (state, token).

A word is encoded by following arcs: at each place, the tokens that begin there are found in the vocabulary's trie, and the longest whose
arc exists is taken.  Every path from the start spells the one correct tokenization of its text, so each place of a word has one path at
most: where no arc leads on, the place is given up for good and the token before it is replaced by a shorter one.  The words of a text
that were met before are looked up.  Decoding emits the arcs' labels.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesela.llm.common import release, whole_row

#: Bytes of the words that a worker keeps in each of two generations, and characters of the longest word that is kept.
WORD_BYTES, LONGEST = 40 << 20, 500
#: Answers about arcs that a worker keeps; they start anew when full.
MAX_ARCS = 150_000

#: Rows of a batch that are Python objects at once.
SLICE = 256

# The pattern that byte-level vocabularies split text by, and the code points it may be narrowed to below U+0250.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LATIN_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
LATIN_NUMBERS = "0-9²³¹¼-¾"

_SPLIT = regex.compile(PATTERN)
_SPLIT_LATIN = re.compile(rf" ?[{LATIN_LETTERS}]+| ?[{LATIN_NUMBERS}]+|'(?:[stmd]|re|ve|ll)| ?[^\s{LATIN_LETTERS}{LATIN_NUMBERS}]+|\s+(?!\S)|\s+")
_NOT_LATIN = re.compile("[^\t\n\r -~¡-ɏ]")


def split_words(text: str) -> list[str]:
    return (_SPLIT if _NOT_LATIN.search(text) else _SPLIT_LATIN).findall(text)


def byte_letters() -> dict[str, int]:
    """The printable letter by which vocabulary files write each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class BpeAutomaton:
    """labels: the bytes of each id; merges: pairs of ids with the id they make, in order; specials: strings with their own id."""

    def __init__(self, labels: list[bytes | None], merges: list[tuple[int, int, int]], specials: dict[str, int]):
        self.labels, self.specials = labels, specials
        self._specials = re.compile("|".join(re.escape(s) for s in sorted(specials, key=len, reverse=True))) if specials else None
        self._compile(merges)
        self._trie()
        self._words = _Memo(lambda word: np.array(self.encode_word(word.encode("utf-8", "replace")), "<u4").tobytes())
        self._counts = _Memo(lambda word: len(self.encode_word(word.encode("utf-8", "replace"))))

    @classmethod
    def from_json(cls, text: str) -> BpeAutomaton:
        """From the text of a tokenizers file of model BPE with a byte-level pre-tokenizer."""
        spec = json.loads(text)
        model, letters = spec["model"], byte_letters()
        vocab = model["vocab"]
        specials = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        labels: list[bytes | None] = [None] * (1 + max([*vocab.values(), *specials.values()]))
        for token, i in vocab.items():
            labels[i] = bytes(letters[c] for c in token)
        for token, i in specials.items():
            labels[i] = token.encode()
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        return cls(labels, [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], specials)

    def _compile(self, merges: list[tuple[int, int, int]]) -> None:
        n = len(self.labels)
        self._after = [0] * n  # the state to which a token's arc leads
        self._parts: list[tuple[int, int] | None] = [None] * n  # (left part, number of the merge)
        self._removed: list[dict[int, int]] = [{}]  # of each state: the arcs removed, with the merge's number
        self._arcs: dict[int, bool] = {}
        leads = [n + 1]  # arcs that lead to each state; the start has one from outside
        for time, (u, v, w) in enumerate(merges):
            if self._parts[w] is None:
                # u = v: after "uu" another u may follow, so w's arc leads to where v's arc led before this merge
                self._parts[w] = (u, time)
                leads[self._after[w]] -= 1
                self._after[w] = self._after[v]
                leads[self._after[w]] += 1
            q = self._after[u]
            if self._has_arc(q, v):
                if leads[q] > 1:
                    leads[q] -= 1
                    leads.append(1)
                    self._removed.append(dict(self._removed[q]))
                    q = self._after[u] = len(leads) - 1
                # a state that only u leads to is its own copy
                self._removed[q][v] = time
                self._arcs.pop(q << 32 | v, None)
        self._arcs.clear()  # the last word on each arc is only known now

    def _has_arc(self, state: int, token: int) -> bool:
        key = state << 32 | token
        known = self._arcs.get(key)
        if known is None:
            removed, part, known = self._removed[state], token, token not in self._removed[state]
            while known and (made := self._parts[part]) is not None:
                part, time = made
                known = removed.get(part, time + 1) > time
            if len(self._arcs) >= MAX_ARCS:
                self._arcs.clear()
            self._arcs[key] = known
        return known

    def _trie(self) -> None:
        """Nodes of the vocabulary's trie by (node, byte), and the token that ends at a node."""
        self._child: dict[int, int] = {}
        self._token: list[int] = [-1]
        self._sizes = [len(label or b"") for label in self.labels]
        special = set(self.specials.values())
        for i, label in enumerate(self.labels):
            if label and i not in special:
                node = 0
                for b in label:
                    nxt = self._child.get(node << 8 | b)
                    if nxt is None:
                        nxt = self._child[node << 8 | b] = len(self._token)
                        self._token.append(-1)
                    node = nxt
                self._token[node] = i

    def encode_word(self, word: bytes) -> list[int]:
        """The ids of one pre-split word."""
        child, token_at, sizes, after, arcs = self._child.get, self._token, self._sizes, self._after, self._arcs.get
        at, state, dead = 0, 0, set()
        out: list[int] = []
        before: list[tuple[int, int, list[int]]] = []  # of each token taken: where it begins, the state there, shorter tokens there
        found, body = None, memoryview(word)  # whose rest isn't copied at each token
        while at < len(word):
            if found is None:
                node, found = 0, []
                for byte in body[at:]:
                    node = child(node << 8 | byte)
                    if node is None:
                        break
                    if token_at[node] >= 0:
                        found.append(token_at[node])
            while found:
                token = found.pop()
                known = arcs(state << 32 | token)
                if (self._has_arc(state, token) if known is None else known) and at + sizes[token] not in dead:
                    out.append(token)
                    before.append((at, state, found))
                    at, state, found = at + sizes[token], after[token], None
                    break
            else:
                dead.add(at)
                out.pop()
                at, state, found = before.pop()
        return out

    def _pieces(self, text: str) -> Iterator[tuple[str, int]]:
        """The text between special strings, and after each such text the id of the special string (-1 at the end)."""
        start = 0
        for m in self._specials.finditer(text) if self._specials else ():
            yield text[start : m.start()], self.specials[m[0]]
            start = m.end()
        yield text[start:], -1

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        out = []
        for piece, special in self._pieces(text):
            out.append(b"".join(map(self._words.__getitem__, split_words(piece))))
            if special >= 0:
                out.append(special.to_bytes(4, "little"))
        return b"".join(out)

    def count(self, text: str) -> int:
        """How many ids a text has."""
        return sum(sum(map(self._counts.__getitem__, split_words(piece))) + (special >= 0) for piece, special in self._pieces(text))

    def decode(self, ids: bytes) -> str:
        """The text of ids written as by encode; bytes that aren't UTF-8, ids without a label and a rest of fewer than 4 bytes become U+FFFD."""
        labels, whole = self.labels, len(ids) & ~3
        try:
            parts = [labels[i] for i in memoryview(ids)[:whole].cast("I")]
        except IndexError:
            parts = [labels[i] if i < len(labels) else None for i in memoryview(ids)[:whole].cast("I")]
        if whole < len(ids):
            parts.append(None)
        try:
            return b"".join(parts).decode("utf-8", "replace")
        except TypeError:
            return b"".join([b"\xff" if x is None else x for x in parts]).decode("utf-8", "replace")


class _Memo(dict):
    """What make() gives for a word, made when first asked for.

    Two generations of bounded bytes: a full one becomes the elder, and words of the elder that are met again are kept on.
    """

    def __init__(self, make):
        self._make, self._elder, self._bytes = make, {}, 0

    def __missing__(self, word: str):
        made = self._elder.get(word)
        if made is None:
            made = self._make(word)
        if len(word) <= LONGEST:
            # what Python takes for the word, what is made of it and their place, at least
            self._bytes += 200 + 6 * len(word)
            if self._bytes > WORD_BYTES:
                self._elder, self._bytes = dict(self), 0
                self.clear()
            self[word] = made
        return made


_COMPILED: dict[str, BpeAutomaton] = {}


def automaton(vocabulary: str) -> BpeAutomaton:
    """The automaton of a vocabulary file, compiled once in each worker."""
    if vocabulary not in _COMPILED:
        with open(vocabulary, encoding="utf-8") as f:
            _COMPILED[vocabulary] = BpeAutomaton.from_json(f.read())
    return _COMPILED[vocabulary]


def _sliced(texts: pa.Array, make) -> pa.Array:
    """make() over slices of a batch, so that Python's objects for a few rows exist at a time."""
    parts = [make(texts.slice(at, SLICE).to_pylist()) for at in range(0, max(1, len(texts)), SLICE)]
    whole = pa.concat_arrays(parts) if len(parts) > 1 else parts[0]
    del parts
    release()
    return whole


def _per_text(df: DataFrame, text: str | Column, kind: str, of) -> DataFrame:
    """df with the columns of the struct `kind`, which of(automaton-independent text list) makes from each Arrow batch."""
    column = F.col(text) if isinstance(text, str) else text
    udf = F.arrow_udf(of, kind).asNondeterministic()  # else a filter on its columns would run it twice
    names = [part.split()[0] for part in kind.removeprefix("struct<").removesuffix(">").replace(":", " ").split(",")]
    made = df.select(whole_row(df, names), udf(F.coalesce(column, F.lit(""))).alias("_bpe"))
    return made.select("_row.*", *[F.col(f"_bpe.{n}") for n in names])


def encode_texts(df: DataFrame, text: str, vocabulary: str) -> DataFrame:
    """Encode whole texts: df with n_tokens long and ids binary (little-endian unsigned 32-bit integers).

    Null and empty texts have no tokens.  The vocabulary's special strings inside a text become their own id.  Columns of df with the
    names of the added ones are replaced; others pass through, whatever their names.  vocabulary: a path that workers can open.
    """

    def ids(texts: pa.Array) -> pa.Array:
        encode = automaton(vocabulary).encode

        def make(rows: list[str]) -> pa.Array:
            made = [encode(t) for t in rows]
            return pa.StructArray.from_arrays([pa.array([len(x) // 4 for x in made], pa.int64()), pa.array(made, pa.binary())], ["n_tokens", "ids"])

        return _sliced(texts, make)

    return _per_text(df, text, "struct<n_tokens:bigint,ids:binary>", ids)


def encode_checked(df: DataFrame, text: str, vocabulary: str) -> DataFrame:
    """encode_texts() with round_trip boolean: whether decoding the ids gives the text again.

    Ids are decoded in the worker that made them, so one automaton serves both ways.
    """

    def ids(texts: pa.Array) -> pa.Array:
        table = automaton(vocabulary)

        def make(rows: list[str]) -> pa.Array:
            made = [table.encode(t) for t in rows]
            same = [table.decode(x) == t for x, t in zip(made, rows, strict=True)]
            return pa.StructArray.from_arrays([pa.array([len(x) // 4 for x in made], pa.int64()), pa.array(made, pa.binary()), pa.array(same, pa.bool_())], ["n_tokens", "ids", "round_trip"])

        return _sliced(texts, make)

    return _per_text(df, text, "struct<n_tokens:bigint,ids:binary,round_trip:boolean>", ids)


def decode_ids(df: DataFrame, ids: str, vocabulary: str) -> DataFrame:
    """Decode ids written as by encode_texts: df with decoded string.  Null and empty ids give the empty text; ids outside the
    vocabulary, a rest of fewer than 4 bytes and bytes that aren't UTF-8 become U+FFFD."""

    def texts(column: pa.Array) -> pa.Array:
        decode = automaton(vocabulary).decode
        return pa.StructArray.from_arrays([pa.array([decode(x or b"") for x in column.to_pylist()], pa.string())], ["decoded"])

    return _per_text(df, F.coalesce(F.col(ids), F.lit(b"")), "struct<decoded:string>", texts)


def encoding_digests(df: DataFrame, text: str, vocabulary: str) -> DataFrame:
    """Encode whole texts, decode them again, and keep digests: df with n_tokens, ids_sha256 and decoded_sha256.

    Ids and texts of a batch stay inside the worker: only the digests go back.  Nulls and clashing names as in encode_texts.
    """

    def digests(texts: pa.Array) -> pa.Array:
        table = automaton(vocabulary)

        def make(rows: list[str]) -> pa.Array:
            n, ids_sha, text_sha = [], [], []
            for t in rows:
                ids = table.encode(t)
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(table.decode(ids).encode("utf-8")).hexdigest())
            return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["n_tokens", "ids_sha256", "decoded_sha256"])

        return _sliced(texts, make)

    return _per_text(df, text, "struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string>", digests)


def count_tokens(df: DataFrame, text: str, vocabulary: str) -> DataFrame:
    """df with n_tokens long, the encoded length of each whole text.  Nulls and clashing names as in encode_texts."""

    def counts(texts: pa.Array) -> pa.Array:
        count = automaton(vocabulary).count
        return _sliced(texts, lambda rows: pa.StructArray.from_arrays([pa.array([count(t) for t in rows], pa.int64())], ["n_tokens"]))

    return _per_text(df, text, "struct<n_tokens:bigint>", counts)
