"""Byte-level BPE by replaying merges over a corpus of words.

A batch of texts is cut into pieces by the tokenizer's pattern. Its distinct pieces are one corpus: an inverted index
leads from the rank of a pair of neighbouring tokens to the positions where it stands, merges are
replayed in the order of rank, and each merge touches its two neighbours only, whose new pairs enter the index.
The result of each piece is what tiktoken's encoder gives: the lowest rank first, the leftmost of
equal ones, and a piece that is a token itself is that token.

`encode` adds the ids to a DataFrame of texts and `decode` gives texts back from ids. Both work batch by batch on the
executors, without a shuffle; memory is bounded by a batch, its pieces and a cache of pieces.

Defined results: a null text is empty and has no ids; equal rows give equal rows; other columns are kept as they are,
but for `ids`, which is replaced. Ids not in the vocabulary raise an error.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from collections.abc import Iterable, Iterator
from heapq import heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from plumbmark.llm.arrow_words import release
from plumbmark.llm.scratch import bounded_batches
from plumbmark.session import table

#: The vocabulary that op2 uses, in the package of public tokenizers.
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Words (and as many pieces) kept from batch to batch in each of two generations; a word that falls out is replayed anew.
CACHE = 500_000
#: Texts taken at a time, in characters; a longer text is taken alone.
TEXTS = 1 << 20


class Pairs(dict):
    """The rank of the token that two tokens make together, -1 if none, by a * 2**24 + b; filled as pairs are met."""

    def __init__(self, ranks: dict[bytes, int], tokens: dict[int, bytes]):
        self.ranks, self.tokens = ranks, tokens

    def __missing__(self, key: int) -> int:
        found = self.ranks.get(self.tokens[key >> 24] + self.tokens[key & 0xFFFFFF], -1)
        if len(self) < 2_000_000:
            self[key] = found
        return found


class Generations:
    """A cache of the last keys used: two dicts, the older of which goes when the younger is full."""

    def __init__(self, most: int):
        self.most, self.young, self.old = most, {}, {}

    def missing(self, keys: set) -> list:
        """Those of keys that aren't known; the others are young after this."""
        if len(self.young) > self.most:
            self.old, self.young = self.young, {}
        absent = keys.difference(self.young)
        fresh = []
        for key in absent:
            if key in self.old:
                self.young[key] = self.old[key]
            else:
                fresh.append(key)
        return fresh


class Vocabulary:
    """Ranks of tokens, by bytes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.names = {rank: str(rank) for rank in self.tokens}
        self.single = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        self.double = np.array([[ranks.get(bytes([a, b]), -1) for b in range(256)] for a in range(256)], np.int32)
        self.double[self.single < 0] = self.double[:, self.single < 0] = -1
        self.forget()

    def forget(self) -> None:
        """Drops what was learned: a worker that waits for its next task holds the vocabulary only."""
        self.pairs = Pairs(self.ranks, self.tokens)
        self.pieces, self.words, self.heads = Generations(CACHE), Generations(CACHE), Generations(CACHE)

    @staticmethod
    def load(path: str, pattern: str) -> Vocabulary:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
        return Vocabulary(ranks, pattern)

    def replay(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """The ids of each piece. One list holds the tokens of all pieces; -1 marks where a piece ends."""
        done: list[tuple[int, ...]] = [()] * len(pieces)
        rest, spans, n = [], [], 0
        for i, piece in enumerate(pieces):
            whole = self.ranks.get(piece)
            if whole is not None:
                done[i] = (whole,)
            elif piece:
                spans.append((i, n, n + len(piece)))
                rest.append(piece)
                n += len(piece) + 1
        if not spans:
            return done
        pairs = self.pairs
        raw = np.frombuffer(b"\0".join([*rest, b""]), np.uint8)
        ends = np.array([end for _, _, end in spans])
        first, ranks = self.single[raw], np.full(n, -1, np.int32)
        ranks[:-1] = self.double[raw[:-1], raw[1:]]
        first[ends] = ranks[ends] = ranks[ends - 1] = -1
        token, made = first.tolist(), ranks.tolist()  # made: the rank of the pair that begins here
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        # rank of a pair -> positions of its left token
        at = np.flatnonzero(ranks >= 0)
        at = at[np.argsort(ranks[at], kind="stable")]
        queue, starts = (x.tolist() for x in np.unique(ranks[at], return_index=True))
        places = at.tolist()
        index = {rank: places[i:j] for rank, i, j in zip(queue, starts, [*starts[1:], len(places)], strict=False)}
        while queue:
            rank = heappop(queue)
            for at in sorted(index.pop(rank)):
                # within a word, a pair that a merge makes may rank lower than the merge: it goes first. Its turn can't
                # wait for the queue, which may hold this rank again further right in the same word.
                now, own = rank, None
                while True:
                    # else a neighbour's merge took one of the two
                    if made[at] == now:
                        after = right[at]
                        token[at], token[after], made[after] = now, -2, -1
                        behind, before = right[after], left[at]
                        right[at] = behind
                        left[behind] = at
                        made[at] = new = pairs[now << 24 | b] if (b := token[behind]) >= 0 else -1
                        if new >= 0:
                            if new < rank:
                                own = own or []
                                heappush(own, (new, at))
                            elif new in index:
                                index[new].append(at)
                            else:
                                index[new] = [at]
                                heappush(queue, new)
                        if before >= 0 and (a := token[before]) >= 0:
                            made[before] = new = pairs[a << 24 | now]
                            if new < 0:
                                pass
                            elif new < rank:
                                own = own or []
                                heappush(own, (new, before))
                            elif new in index:
                                index[new].append(before)
                            else:
                                index[new] = [before]
                                heappush(queue, new)
                    if not own:
                        break
                    now, at = heappop(own)
        for i, start, end in spans:
            done[i] = tuple([t for t in token[start:end] if t >= 0])
        return done

    def learn(self, cut: list[list[str]]) -> None:
        """Replays the distinct pieces that are new."""
        fresh = self.pieces.missing(set().union(*cut))
        self.pieces.young.update(zip(fresh, self.replay([p.encode() for p in fresh]), strict=True))

    def _add(self, cache: Generations, words: set[str], before: str) -> None:
        fresh = cache.missing(words)
        plain = [w for w in fresh if w and w == w.strip()]
        cut = [self.pattern.findall(before + w) for w in plain]
        self.learn(cut)
        known = self.pieces.young
        if len(plain) < len(fresh):
            cache.young.update(dict.fromkeys(fresh))
        cache.young.update((w, known[pieces[0]] if len(pieces) == 1 else tuple([i for p in pieces for i in known[p]])) for w, pieces in zip(plain, cut, strict=True))

    def encode(self, texts: list[str]) -> list[list[int]]:
        """The ids of each text.

        No piece reaches past a space that stands alone between other characters: it begins the next piece. So texts
        are cut at spaces into words, and a word with its space is cut by the pattern once. A text in which a word is
        empty or has white space at its edge is cut by the pattern as a whole.
        """
        cut = [text.split(" ") for text in texts]
        self._add(self.heads, {words[0] for words in cut}, "")
        self._add(self.words, set().union(*(words[1:] for words in cut)), " ")
        heads, known = self.heads.young, self.words.young
        parts = [[heads[words[0]], *map(known.__getitem__, words[1:])] for words in cut]
        odd = [k for k, found in enumerate(parts) if None in found]
        if odd:
            whole = [self.pattern.findall(texts[k]) for k in odd]
            self.learn(whole)
            for k, pieces in zip(odd, whole, strict=True):
                parts[k] = [self.pieces.young[p] for p in pieces]
        return [list(chain.from_iterable(found)) for found in parts]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_loaded: dict[tuple[str, str], Vocabulary] = {}


def vocabulary(path: str, pattern: str) -> Vocabulary:
    """Of this process; the file is opened once."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = Vocabulary.load(path, pattern)
    return _loaded[path, pattern]


def public(name: str = VOCABULARY) -> tuple[str, str]:
    """Path, on the machine that asks, and pattern of a public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def _groups(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about TEXTS characters, null ones as empty, with the place of the first. Only one run is taken out of Arrow at a time."""
    sizes = pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False)
    at, size = 0, 0
    for i, more in enumerate(sizes.tolist()):
        if i > at and size + more > TEXTS:
            yield at, [text or "" for text in texts.slice(at, i - at).to_pylist()]
            at, size = i, 0
        size += more
    if at < len(texts):
        yield at, [text or "" for text in texts.slice(at).to_pylist()]


def encode(docs: DataFrame, text: str = "text", name: str = VOCABULARY, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """docs with ids, an array of the tokens of `text`. Without a path, each executor finds the named public vocabulary."""
    bounded_batches(docs.sparkSession)
    keep = [c for c in docs.columns if c != "ids"]
    docs = docs.select(*[f"`{c}`" for c in keep])
    schema = T.StructType([*docs.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType(), False), False)])
    column = keep.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(path, pattern) if path else vocabulary(*public(name))
        gc.disable()  # nothing here refers to itself, and each collection walks the caches
        try:
            for batch in batches:
                for at, texts in _groups(batch.column(column)):
                    ids = own.encode(texts)
                    offsets = np.zeros(len(ids) + 1, np.int32)
                    np.cumsum([len(x) for x in ids], out=offsets[1:])
                    flat = np.fromiter((i for x in ids for i in x), np.int32, int(offsets[-1]))
                    part = batch.slice(at, len(texts))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(offsets, flat)], names=[*keep, "ids"])
        finally:
            own.forget()
            gc.enable()
            release()

    return docs.mapInArrow(run, schema)


def decode(rows: DataFrame, into: str = "bytes", name: str = VOCABULARY, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """rows with the bytes that their ids stand for; null ids give null."""
    keep = [c for c in rows.columns if c != into]
    rows = rows.select(*[f"`{c}`" for c in keep])
    schema = T.StructType([*rows.schema.fields, T.StructField(into, T.BinaryType(), True)])
    column = keep.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(path, pattern) if path else vocabulary(*public(name))
        for batch in batches:
            lists = batch.column(column)
            out = [None if x is None else own.decode(x) for x in (row.as_py() for row in lists)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*keep, into])

    return rows.mapInArrow(run, schema)


def digests(docs: DataFrame, name: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: each text encoded and its ids decoded where they are made, so that no ids travel."""
    bounded_batches(docs.sparkSession)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(*public(name))
        gc.disable()  # nothing here refers to itself, and each collection walks the caches
        try:
            for batch in batches:
                out: list[tuple[int, str, str]] = []
                for _, texts in _groups(batch.column(1)):
                    for ids in own.encode(texts):
                        joined = ",".join(map(own.names.__getitem__, ids)).encode()
                        out.append((len(ids), hashlib.sha256(joined).hexdigest(), hashlib.sha256(own.decode(ids)).hexdigest()))
                n, a, b = zip(*out, strict=True) if out else ((), (), ())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        finally:
            own.forget()
            gc.enable()
            release()

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def op2_bpe_merge_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


QUERIES = {"op2_bpe_merge_replay": op2_bpe_merge_replay}
ORACLES: dict[str, str] = {}
