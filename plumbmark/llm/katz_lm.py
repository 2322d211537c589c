"""Language-model scoring: a Katz backoff model, its counts and its scores computed in partitioned tables.

Every word of the training texts has its own unigrams, bigrams and trigrams; none is cut off. The model is

    p(w | u v) = d3(r) r / (c(u v) + 1)              if u v w was seen r times, d being Katz's Good-Turing discounts, by order
               = alpha(u v) p(w | v)                 otherwise, alpha(h) = (1 - sum of the seen) / (1 - sum of one order less over the seen)

and so on for p(w | v), whose seen pairs have d2, down to unigrams; alpha is 1 for a history never seen. Unigrams are discounted in the
same way; the mass left, and one count added to every denominator, is the probability of the unknown word, so each distribution adds up
to 1 over all known words and the unknown one. A text starts after a start symbol (its first word has a bigram only) and ends with an
end token.

1. Words are counted over all training texts; the counts are a written table.
2. One pass turns texts into blocks: distinct words, and every token as its place among them. The words are sent to where their
   counts are, the counts come back, and blocks with counts are a written table.
3. A block's trigrams go to the bucket of their second-last word, one cell a block and bucket: the cell's distinct words with their
   counts, three places among these for each token, and how many tokens each document has. Numbers are packed in as many bytes
   as they need, byte by byte, so a token takes about as many bytes as its text. A frequent word is split over buckets by its share
   of the tokens, so that no bucket holds a hot one whole. So the counts of a bigram and of all trigrams that end in it are in one
   bucket. Buckets are sent in `WAVES` parts, each written before the next is sent, to hold less on disk at a time.
4. A bucket's row has its counts of counts; one pass gives the parts of the histories that are split over buckets, which are summed up.
5. Every trigram's counts give its probability where it lies; sums go back by document.

No cell is sent without a token in it, so rows and bytes are at most in proportion to the tokens, however many blocks and buckets there are.

Defined results: a null or empty text is its end token alone; repeated rows train and score once each; without any training
text the unknown word has probability 1; extra columns are not read. fold says which rows do not train.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbmark.llm.arrow_words import SPACES, mix, release, slices
from plumbmark.llm.labelled import fold
from plumbmark.llm.scratch import bounded_batches, drop, folder, keep
from plumbmark.session import table

DISCOUNTED = 5
END = 0x0123456789ABCDEF
#: Numbers of what is no word: before a text's first word, a text's start, any unknown word. Words have numbers from WORD on, frequent ones the smaller.
NONE, START, UNKNOWN, WORD = 0, 1, 2, 3
#: Of a cell: its block, distinct words and their counts, three places among these of each token, documents, tokens of each, which are held out.
CELL = ("block", "words", "n", "before", "first", "second", "docs", "runs", "held")
#: Distinct trigrams that are scored at a time.
PART = 1 << 17
#: Tokens of a bucket, about; bytes of text and rows of a block; parts in which buckets are sent.
BUCKET, BLOCK_BYTES, BLOCK_ROWS, WAVES = 1_500_000, 12 << 20, 30_000, 4


def _tokens(words) -> tuple[np.ndarray, np.ndarray]:
    """(hashes with an end token after each text, bounds)."""
    ends = words.bounds[1:]
    return np.insert(words.hashes() >> np.uint64(1), ends, np.uint64(END)).astype(np.int64), words.bounds + np.arange(len(words.bounds))


def count_words(docs: DataFrame) -> DataFrame:
    """word, n of all texts of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts, held = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        parts: list[np.ndarray] = []

        def merge():
            w, c = np.unique(np.concatenate(parts), return_counts=True) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            both = np.concatenate([words, w])
            u, at = np.unique(both, return_inverse=True)
            return u, np.bincount(at, np.concatenate([counts, c]), len(u)).astype(np.int64)

        for batch in batches:
            for _, _, w in slices(batch.column(0), SPACES):
                parts.append(_tokens(w)[0])
                held += len(parts[-1])
                if held > 2_000_000:
                    words, counts = merge()
                    parts, held = [], 0
                if len(words) > 1_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(counts)], names=["word", "n"])
                    words, counts = words[:0], counts[:0]
        words, counts = merge()
        parts.clear()
        yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(counts)], names=["word", "n"])
        del words, counts
        release()

    return docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def discounts(of: dict[int, int], k: int = DISCOUNTED) -> np.ndarray:
    """d(1) .. d(k) from numbers of counts 1 .. k + 1; where Good-Turing gives none between 0 and 1, half a count is taken off."""
    n = [0, *[of.get(r, 0) for r in range(1, k + 2)]]
    out = np.array([(r - 0.5) / r for r in range(1, k + 1)])
    tail = (k + 1) * n[k + 1] / n[1] if n[1] else 1.0
    if 0 <= tail < 1:
        for r in range(1, k + 1):
            d = ((r + 1) * n[r + 1] / n[r] / r - tail) / (1 - tail) if n[r] else -1
            if 0 < d < 1:
                out[r - 1] = d
    return out


@dataclass
class Model:
    """What every task needs of the counts: a few numbers, none of them by word."""

    total: int
    types: int
    texts: int
    buckets: int
    discount: list[np.ndarray]  # by order, as far as they are known
    hot: dict[int, tuple[float, float]]  # histories split over buckets: what their seen words took, and these words' unigram mass
    unknown: float = 1.0

    def discounted(self, order: int, c: np.ndarray) -> np.ndarray:
        d = np.concatenate([[0.0], self.discount[order - 1], [1.0]])
        return d[np.minimum(c, DISCOUNTED + 1)] * c

    def unigram(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, self.discounted(1, c) / (self.total + 1), self.unknown)

    def share(self, c: np.ndarray) -> np.ndarray:
        """Over how many buckets a history of count c is split."""
        return np.maximum(1, np.ceil(c / max(self.total, 1) * self.buckets * 2)).astype(np.int64)


BLOCKS = "block binary, words binary, tokens binary, sizes binary, doc_ids array<long>, held array<boolean>"
COUNTED = "block binary, words binary, n binary, tokens binary, sizes binary, doc_ids array<long>, held array<boolean>, known array<long>, base array<double>"


def _blocks(docs: DataFrame) -> DataFrame:
    """block, words (distinct hashes, ascending), tokens (places in words), sizes, and the documents of a block."""
    schema = BLOCKS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        def flush(parts):
            words, tokens = np.unique(np.concatenate([x[0] for x in parts]), return_inverse=True)
            sizes, ids = np.concatenate([np.diff(x[1]) for x in parts]), pa.chunked_array([x[2] for x in parts]).combine_chunks()
            held = pa.array(np.concatenate([x[3] for x in parts]))
            lists = [pa.ListArray.from_arrays(pa.array([0, len(sizes)], pa.int32()), x) for x in (ids, held)]
            packed = [os.urandom(12), _pack(np.diff(words, prepend=0)), _pack(tokens), _pack(sizes)]
            return pa.RecordBatch.from_arrays([*[pa.array([x], pa.binary()) for x in packed], *lists], names=[x.split()[0] for x in schema.split(", ")])

        parts, amount, rows = [], 0, 0
        for batch in batches:
            for at, to, words in slices(batch.column(1), SPACES):
                hashes, bounds = _tokens(words)
                for a in range(0, to - at, BLOCK_ROWS):
                    b = min(to - at, a + BLOCK_ROWS)
                    if parts and (amount > BLOCK_BYTES or rows + b - a > BLOCK_ROWS):
                        yield flush(parts)
                        parts, amount, rows = [], 0, 0
                    own = batch.column(0).slice(at + a, b - a)
                    held = batch.column(2).slice(at + a, b - a).to_numpy(zero_copy_only=False).astype(bool)
                    parts.append((hashes[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a], own, held))
                    amount += int(words.offsets[b] - words.offsets[a])
                    rows += b - a
        if parts:
            yield flush(parts)
        parts.clear()
        release()

    return docs.select("doc_id", "text", "held").mapInArrow(run, schema)


def _pack(values: np.ndarray) -> bytes:
    """Whole numbers in as many bytes as the largest needs, the lowest bytes of all first, compressed."""
    bits = np.ascontiguousarray(values).astype(np.int64).view(np.uint8).reshape(-1, 8)
    width = 8
    while width > 1 and not bits[:, width - 1].any():
        width -= 1
    return len(bits).to_bytes(4, "little") + bytes([width]) + pa.compress(np.ascontiguousarray(bits[:, :width].T).tobytes(), codec="zstd", asbytes=True)


def _unpack(data: bytes) -> np.ndarray:
    n, width = int.from_bytes(data[:4], "little"), data[4]
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(pa.decompress(data[5:], n * width, codec="zstd", asbytes=True), np.uint8).reshape(width, n).T
    return out.view(np.int64).ravel()


def _hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(mix(a.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64)).view(np.int64)


def _counted(blocks: DataFrame, counts: DataFrame, buckets: int, model: Model) -> DataFrame:
    """The blocks, words being numbers now, with the training count of each, and each document's known words and base score."""

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                w = np.cumsum(_unpack(words))
                of = w % buckets
                found = [(int(b), w[of == b]) for b in np.unique(of)]
                yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in found], pa.int32()), pa.array([block] * len(found), pa.binary()), pa.array([_pack(np.diff(x, prepend=0)) for _, x in found], pa.binary())], names=["bucket", "block", "words"])

    def answered(asks: pa.Table, known: pa.Table) -> pa.Table:
        known = known.sort_by("word")
        w, n, out = known["word"].to_numpy(), known["n"].to_numpy(), {"n": [], "ids": []}
        number = np.empty(len(w), np.int64)
        number[np.lexsort((w, -n))] = WORD + np.arange(len(w)) * buckets + (known["bucket"][0].as_py() if len(w) else 0)
        for words in asks["words"].to_pylist():
            own = np.cumsum(_unpack(words))
            at = np.minimum(np.searchsorted(w, own), max(len(w) - 1, 0))
            hit = w[at] == own if len(w) else np.zeros(len(own), bool)
            for name, values, none in (("n", n, 0), ("ids", number, UNKNOWN)):
                out[name].append(_pack(np.where(hit, values[at], none) if len(w) else np.full(len(own), none)))
        return pa.table({"block": asks["block"], "words": asks["words"], **{c: pa.array(v, pa.binary()) for c, v in out.items()}})

    def gathered(block: pa.Table, parts: pa.Table) -> pa.Table:
        words, at, sizes = np.cumsum(_unpack(block["words"][0].as_py())), _unpack(block["tokens"][0].as_py()), _unpack(block["sizes"][0].as_py())
        n, ids = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        for w, c, d in zip(*(parts[c].to_pylist() for c in ("words", "n", "ids")), strict=True):
            own = np.searchsorted(words, np.cumsum(_unpack(w)))
            n[own], ids[own] = _unpack(c), _unpack(d)
        ids, first, place = np.unique(ids, return_index=True, return_inverse=True)
        n, at = n[first], place[at]
        begin = np.cumsum(sizes) - sizes  # a text has its end token at least
        known = np.add.reduceat((n > 0).astype(np.int64)[at], begin)
        base = np.add.reduceat(np.log10((n + 1) / (model.total + model.types + 1))[at], begin)
        lists = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x))
        for c, x in (("words", np.diff(ids, prepend=0)), ("tokens", at)):
            block = block.set_column(block.schema.get_field_index(c), c, pa.array([_pack(x)], pa.binary()))
        return block.append_column("n", pa.array([_pack(n)], pa.binary())).append_column("known", lists(known)).append_column("base", lists(base)).select([c.split()[0] for c in COUNTED.split(", ")])

    asks = blocks.select("block", "words").mapInArrow(asked, "bucket int, block binary, words binary")
    known = counts.withColumn("bucket", (F.col("word") % buckets).cast("int"))
    parts = asks.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(lambda a, b: answered(a, b), "block binary, words binary, n binary, ids binary")
    return blocks.groupBy("block").cogroup(parts.groupBy("block")).applyInArrow(lambda a, b: gathered(a, b), COUNTED)


def _cells(model: Model, wave: int):
    """Of each block, the trigrams of the wave's buckets: a row a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for batch in batches for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist()):
            words, at, sizes = np.cumsum(_unpack(row["words"])), _unpack(row["tokens"]).astype(np.int32) + np.int32(2), _unpack(row["sizes"])
            n = np.append([0, model.texts], _unpack(row["n"]))
            none, start, words = 0, 1, np.append([NONE, START], words)
            begin = np.cumsum(sizes) - sizes
            first, before = np.empty(len(at), np.int32), np.empty(len(at), np.int32)
            first[1:] = at[:-1]
            first[begin] = start
            before[1:] = first[:-1]
            before[begin] = none
            share = model.share(n)
            # the bucket of a word that isn't split is its own; of one that is, it goes by the word after it
            bucket = (_hash(words, np.zeros(len(words), np.int64)).view(np.uint64) % np.uint64(model.buckets)).astype(np.int32)[first]
            hot = np.flatnonzero((share > 1)[first])
            with np.errstate(over="ignore"):
                salt = mix(words[at[hot]].astype(np.uint64)) % share[first[hot]].astype(np.uint64)
            bucket[hot] = (_hash(words[first[hot]], salt).view(np.uint64) % np.uint64(model.buckets)).astype(np.int32)
            own = np.flatnonzero(bucket % WAVES == wave)
            own = own[np.argsort(bucket[own].astype(np.uint16) if model.buckets < 1 << 16 else bucket[own], kind="stable")]
            of = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
            cuts = np.flatnonzero(np.concatenate([[True], bucket[own][1:] != bucket[own][:-1], [True]])) if len(own) else np.zeros(1, np.int64)
            held, out = np.array(row["held"], bool), {c: [] for c in ("bucket", *CELL)}
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                t = own[i:j]
                used = np.zeros(len(words), bool)
                for x in (before, first, at):
                    used[x[t]] = True
                place = np.cumsum(used) - 1
                docs = of[t]
                new = np.flatnonzero(np.concatenate([[True], docs[1:] != docs[:-1]]))
                docs = docs[new]
                out["bucket"].append(int(bucket[t[0]]))
                out["block"].append(row["block"])
                for c, x in (("words", np.diff(words[used], prepend=0)), ("n", n[used]), ("before", place[before[t]]), ("first", place[first[t]]), ("second", place[at[t]]), ("docs", np.diff(docs, prepend=0)), ("runs", np.diff(np.append(new, j - i))), ("held", held[docs])):
                    out[c].append(_pack(x))
            yield pa.RecordBatch.from_arrays([pa.array(out["bucket"], pa.int32()), *[pa.array(out[c], pa.binary()) for c in CELL]], names=["bucket", *CELL])

    return run


def _ranked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, ascending, and the place of each key among them: np.unique in less memory."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = _changes(keys)
    place = np.empty(len(keys), np.int32)
    place[order] = np.cumsum(first, dtype=np.int32) - 1
    return keys[first], place


def _changes(keys: np.ndarray) -> np.ndarray:
    """Which of sorted keys differ from the one before."""
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    return first


class Bucket:
    """The trigrams of a bucket: counts of the distinct ones (by history, then word), and which of them each token is.

    What there is a value a trigram of is held in four bytes, as places among the bucket's words (word, with counts n).
    """

    def __init__(self, cells: dict[str, list[bytes]], model: Model, split_only: bool = False):
        words = [np.cumsum(_unpack(x)) for x in cells["words"]]
        w, at = _ranked(np.concatenate(words))
        n, places = np.zeros(len(w), np.int64), np.split(at, np.cumsum([len(x) for x in words])[:-1])
        for place, x in zip(places, cells["n"], strict=True):
            n[place] = _unpack(x)
        del words, at
        u, v, x = (np.concatenate([place[_unpack(c)] for place, c in zip(places, cells[name], strict=True)]) for name in ("before", "first", "second"))
        del places
        self.cells = [int(_unpack(c).sum()) for c in cells["runs"]]
        train = np.concatenate([np.repeat(_unpack(h) == 0, _unpack(r)) for h, r in zip(cells["held"], cells["runs"], strict=True)])
        if split_only:
            use = (model.share(n) > 1)[v]
            u, v, x, train = u[use], v[use], x[use], train[use]
        k = len(w)
        history = u.astype(np.int64) * k + v
        del u, v
        if k < 1 << 20:
            history *= k
            history += x
            del x
            gram, self.at = _ranked(history)
            history = gram // k
        else:
            known, place = _ranked(history)
            history = place.astype(np.int64) * k + x
            del place, x
            gram, self.at = _ranked(history)
            history = known[gram // k]
            del known
        gram %= k
        self.word, self.n, self.x = w, n, gram.astype(np.int32)
        del gram
        first = _changes(history)
        self.new, self.of_history = np.flatnonzero(first), np.cumsum(first, dtype=np.int32) - 1
        u, self.v = (history // k).astype(np.int32), (history % k).astype(np.int32)
        del history, first
        self.whole = (w != NONE)[u]  # a text's first word has no trigram
        self.names = _hash(w[u[self.new]], w[self.v[self.new]])
        del u
        self.three = np.bincount(self.at, train, len(self.x)).astype(np.int32)
        del train
        pairs, at = _ranked(self.v.astype(np.int64) * k + self.x)
        self.two_of = np.bincount(at, self.three, len(pairs)).astype(np.int32)
        self.two = self.two_of[at]
        del at
        self.three[~self.whole] = 0
        self.of, self.last = (pairs // k).astype(np.int32), (pairs % k).astype(np.int32)

    def words_seen(self, model: Model):
        """(histories of one word, took, mass) over the pairs seen."""
        first = _changes(self.of)
        at, h = np.cumsum(first, dtype=np.int32) - 1, self.word[self.of[first]]
        took = np.bincount(at, model.discounted(2, self.two_of), len(h))
        mass = np.bincount(at, np.where(self.two_of > 0, model.unigram(self.n)[self.last], 0.0), len(h))
        return h, took, mass

    def pairs_seen(self, model: Model):
        """(names of the histories of two words, n, took, mass) over the trigrams seen; of_history says where each trigram's is."""
        n = np.bincount(self.of_history, self.three, len(self.new))
        took = np.bincount(self.of_history, model.discounted(3, self.three), len(self.new))
        mass = np.bincount(self.of_history, np.where(self.three > 0, model.discounted(2, self.two) / (self.n[self.v] + 1.0), 0.0), len(self.new))
        return self.names, n, took, mass


GRAMS = "bucket int, " + ", ".join(f"{c} array<binary>" for c in CELL) + ", seen array<long>"


def _packed(model: Model):
    """A bucket's cells in a row, with the numbers of pairs and of trigrams seen 1 .. DISCOUNTED + 1 times."""

    def run(t: pa.Table) -> pa.Table:
        release()
        cells = {c: t[c].to_pylist() for c in CELL}
        b = Bucket(cells, model)
        seen = np.concatenate([np.bincount(np.minimum(x, DISCOUNTED + 2), minlength=DISCOUNTED + 3)[1 : DISCOUNTED + 2] for x in (b.two_of, b.three)])
        del b
        release()
        return pa.table({"bucket": t["bucket"].slice(0, 1), **{c: pa.array([v], pa.list_(pa.binary())) for c, v in cells.items()}, "seen": pa.array([seen.tolist()], pa.list_(pa.int64()))})

    return run


def _discounts(grams: DataFrame) -> list[np.ndarray]:
    """Of pairs and of trigrams."""
    k = DISCOUNTED + 1
    row = grams.select("seen").agg(*[F.coalesce(F.sum(F.col("seen")[i]), F.lit(0)).alias(f"s{i}") for i in range(2 * k)]).first()
    return [discounts({r: int(row[o * k + r - 1]) for r in range(1, k + 1)}) for o in (0, 1)]


def _split_histories(grams: DataFrame, model: Model) -> DataFrame:
    """bucket, pair (of two words, or one), history, n, took, mass: a bucket's part of the histories that are split over buckets."""
    names = ["bucket", "pair", "history", "n", "took", "mass"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cells in (r for batch in batches for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist()):
            b = Bucket(cells, model, split_only=True)
            h, took, mass = b.words_seen(model)
            h2, n2, took2, mass2 = b.pairs_seen(model)
            del b
            for pair, cols, use in ((False, (h, np.zeros(len(h)), took, mass), took > 0), (True, (h2, n2, took2, mass2), np.ones(len(h2), bool))):
                k = int(use.sum())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(k, cells["bucket"], np.int32)), pa.array(np.full(k, pair)), *[pa.array(x[use].astype(t)) for x, t in zip(cols, (np.int64, np.float64, np.float64, np.float64), strict=True)]], names=names)

    return grams.mapInArrow(run, "bucket int, pair boolean, history long, n double, took double, mass double")


def _log_alpha(took, n, mass):
    return np.log10(np.maximum((1 - took / (n + 1.0)) / np.maximum(1 - mass, 1e-12), 1e-300))


def _token_scores(b: Bucket, split: pa.Table, model: Model) -> np.ndarray:
    """The score of each distinct trigram, made in parts so that no more than a few values a trigram are held."""
    h, took, mass = b.words_seen(model)
    for word, known in model.hot.items():
        i = np.searchsorted(h, word)
        if i < len(h) and h[i] == word:
            took[i], mass[i] = known
    of_word = np.minimum(np.searchsorted(h, b.word), max(len(h) - 1, 0)).astype(np.int32)
    low = _log_alpha(took[of_word], b.n, mass[of_word]) if len(h) else np.zeros(len(b.word))  # of words that are histories
    last = np.log10(model.unigram(b.n))
    names, n, took, mass = b.pairs_seen(model)
    if len(split):
        order = np.argsort(names)
        own = order[np.searchsorted(names, split["history"].to_numpy(), sorter=order)]
        n[own], took[own], mass[own] = (split[c].to_numpy() for c in ("n", "took", "mass"))
    score = np.empty(len(b.x))
    for i in range(0, len(score), PART):
        p = slice(i, i + PART)
        two, three, v, at = b.two[p], b.three[p], b.v[p], b.of_history[p]
        mid = np.where(two > 0, np.log10(np.where(two > 0, model.discounted(2, two) / (b.n[v] + 1.0), 1.0)), low[v] + last[b.x[p]])
        top = np.log10(np.where(three > 0, model.discounted(3, three) / (n[at] + 1.0), 1.0))
        score[p] = np.where(three > 0, top, np.where(b.whole[p], _log_alpha(took[at], n[at], mass[at]), 0.0) + mid)
    return score


def _scores(model: Model):
    """block, docs, score: the sums of a bucket for each document of each block."""

    def of(cells: dict[str, list[bytes]], split: pa.Table) -> list[bytes]:
        b = Bucket(cells, model)
        score, lo, sums = _token_scores(b, split, model), 0, []
        for runs, size in zip(cells["runs"], b.cells, strict=True):
            runs = _unpack(runs)
            sums.append(np.add.reduceat(score[b.at[lo : lo + size]], np.cumsum(runs) - runs).tobytes())
            lo += size
        return sums

    def run(t: pa.Table, split: pa.Table) -> pa.Table:
        release()
        blocks, docs_of, sums = [], [], []
        for cells in t.select([*CELL]).to_pylist():
            blocks += cells["block"]
            docs_of += cells["docs"]
            sums += of(cells, split)
            release()
        return pa.table({"block": pa.array(blocks, pa.binary()), "docs": pa.array(docs_of, pa.binary()), "score": pa.array(sums, pa.binary())})

    return run


def _gather(docs: pa.Table, sums: pa.Table) -> pa.Table:
    """The rows of a block's documents, the sums of all buckets added."""
    lists = {c: docs[c].combine_chunks().flatten() for c in ("doc_ids", "held", "known", "base")}
    sizes = _unpack(docs["sizes"][0].as_py())
    total = np.zeros(len(sizes))
    for row in sums.to_pylist():
        total[np.cumsum(_unpack(row["docs"]))] += np.frombuffer(row["score"], np.float64)
    return pa.table({"doc_id": lists["doc_ids"], "held_out": lists["held"], "n_tokens": pa.array(sizes), "n_known": lists["known"], "base_score": lists["base"], "score": pa.array(total)})


def score(docs: DataFrame, held: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row; rows where held is true don't train."""
    spark = docs.sparkSession
    bounded_batches(spark)
    path = folder(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(held, F.lit(False)).alias("held"))
    counts = keep(count_words(rows.where("NOT held")), path, "unigrams")
    head = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.coalesce(F.max(F.when(F.col("word") == END, F.col("n"))), F.lit(0)), *[F.count_if(F.col("n") == r) for r in range(1, DISCOUNTED + 2)]).first()
    total, types, texts = int(head[0]), int(head[1]), int(head[2])
    by_count = {r: int(head[2 + r]) for r in range(1, DISCOUNTED + 2)}
    buckets = max(8, -(-total // BUCKET))
    model = Model(total, types, texts, buckets, [discounts(by_count)], {})
    low = [(r, by_count[r]) for r in range(1, DISCOUNTED + 1)]
    known = sum(n * float(model.discounted(1, np.array([r]))[0]) for r, n in low) + total - sum(n * r for r, n in low)
    model.unknown = max(1 - known / (total + 1), 1e-300)
    blocks = keep(_counted(keep(_blocks(rows), path, "blocks"), counts, buckets, model), path, "counted")
    drop(spark, path, "blocks", "unigrams")
    # a row a bucket, so that the passes over it need no further shuffle
    sent = "bucket int, " + ", ".join(f"{c} binary" for c in CELL)
    waves = [keep(blocks.mapInArrow(_cells(model, i), sent).groupBy("bucket").applyInArrow(lambda t: _packed(model)(t), GRAMS), path, f"grams-{i}") for i in range(WAVES)]
    grams = reduce(DataFrame.unionByName, waves)
    heads = keep(blocks.select("block", "doc_ids", "held", "sizes", "known", "base"), path, "heads")
    drop(spark, path, "counted")
    model.discount += _discounts(grams)
    parts = keep(_split_histories(grams, model), path, "split")
    one = parts.where("NOT pair").groupBy("history").agg(F.sum("took").alias("took"), F.sum("mass").alias("mass"))
    model.hot = {r.history: (r.took, r.mass) for r in one.collect()}  # fewer than two a bucket
    two = parts.where("pair").groupBy("history").agg(*[F.sum(c).alias(c) for c in ("n", "took", "mass")], F.collect_list("bucket").alias("buckets"))
    split = two.select(F.explode("buckets").alias("bucket"), "history", "n", "took", "mass")
    sums = None
    for i, wave in enumerate(waves):
        own = split.where(F.col("bucket") % WAVES == i)
        one = keep(wave.drop("seen").groupBy("bucket").cogroup(own.groupBy("bucket")).applyInArrow(lambda a, b: _scores(model)(a, b), "block binary, docs binary, score binary"), path, f"sums-{i}")
        sums = one if sums is None else sums.unionByName(one)
        drop(spark, path, f"grams-{i}")
    drop(spark, path, "split")
    found = heads.groupBy("block").cogroup(sums.groupBy("block")).applyInArrow(lambda a, b: _gather(a, b), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return found.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def op9_katz_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 7) == 2)


QUERIES = {"op9_katz_scoring": op9_katz_scoring}
ORACLES: dict[str, str] = {}
