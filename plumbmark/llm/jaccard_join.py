"""N-gram Jaccard join: documents whose sets of word shingles are alike, exactly, and their components.

1. A pass over the texts gives each document its set's size, a 64-bit hash of the set, its node, and a parity bitmap of its
   hashed shingles: equal sets are one node from here on, however many copies there are. The same pass counts shingles in a fixed
   number of counters.
2. Shingles are ordered by their counter, then by hash. Of two sets of similarity t, the smaller has one of its first
   n - ceil(2 t / (1 + t) n) + 1 shingles among the first m - ceil(t m) + 1 of the larger, so these alone are posted, in packed blocks by
   bucket of shingles. A shingle far more frequent than most is split over buckets by node.
3. In a bucket, the nodes of one shingle, sorted by size, form size-banded tiles: nodes may link only if their sizes allow
   the similarity. First each node is compared with the smallest one that its size allows. Then, in the lists that still
   hold nodes of several components, the pairs of different components in a tile are compared; first in one list a node, the
   longest, then in all that are still open. A tile with few pairs that may link returns them; a dense one is compared in its task, where
   what links is one component from there on, and no pair inside a component is looked at again. So tiles return rows in
   proportion to their nodes, and yet no component is missed.
4. A comparison: the number of bits in which two bitmaps differ is at most the symmetric difference, so it bounds the
   intersection from above. Only of nodes with a pair that passes are the sets made, in one more pass over the texts; they are
   intersected exactly, as sorted arrays of 64-bit hashes of the shingles.

Bitmaps have `BITS` bits a shingle, at least `LEAST_BITS`, rounded up to a power of two; of two lengths, the longer is folded,
which keeps parities.

Defined results: a null, empty or wordless text has an empty set, links with nothing and is its own component; a text of
fewer than `WORDS` words is one shingle; rows that repeat a doc_id are rows of one document more; rows without a doc_id link as
others do, and a component of such rows alone is null; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbmark.llm.arrow_words import SPACES, mix, release, slices
from plumbmark.llm.components import components
from plumbmark.llm.scratch import bounded_batches, drop, folder, keep, unused
from plumbmark.session import table

WORDS, PERCENT = 5, 75
#: Counters of shingles (a power of two), in blocks of so many.
COUNTERS, BLOCK = 1 << 18, 1 << 12
#: Bits of a bitmap for each shingle, at least: the more, the fewer pairs pass that aren't alike.
BITS, LEAST_BITS = 4, 256
#: Posted shingles of a bucket, about, and of a block that a task sends at a time.
BUCKET, FLUSH = 400_000, 2_000_000
#: Flags beside the size of a posted set: whether the shingle is among the first ones that the smaller set of a pair must have; whether it is split over buckets.
INDEXED, SPLIT, SIZE_BITS = np.uint32(1 << 31), np.uint32(1 << 30), np.uint32((1 << 30) - 1)
#: Rows that may be wanted are found by the hash of their key, in so many positions; a table of at most so many rows is broadcast.
POSITIONS = 1 << 18
#: Counters of so many tasks are added up at a time.
TASKS = 1024
#: A part of a list, about: longer lists are compared part by part, so that a tile holds two such parts at most.
TILE_SHINGLES, TILE_NODES = 2_000_000, 16_384
#: A tile with more pairs to compare for each node is compared in its task; else its pairs are joined with the sets.
DENSE = 4


def shingle_sets(words, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): the distinct hashed shingles of each text of a slice, sorted within a text."""
    h, bounds, n = words.hashes(), words.bounds, len(words.bounds) - 1
    counts = np.diff(bounds)
    with np.errstate(over="ignore"):
        rolled = np.zeros(len(h), np.uint64)
        for k in range(size):
            rolled[: len(h) - k] = rolled[: len(h) - k] * np.uint64(0x9E3779B97F4A7C15) + h[k:] if k < len(h) else rolled[: len(h) - k]
        starts = np.arange(len(h)) + size <= np.repeat(bounds[1:], counts)
        values, of = mix(rolled[starts]), words.text_of()[starts]
        short = np.flatnonzero((counts > 0) & (counts < size))
        if len(short):  # the whole sequence, and its length apart from any shingle of `size` words
            whole = []
            for i in short:
                v = np.uint64(counts[i])
                for x in h[bounds[i] : bounds[i + 1]]:
                    v = v * np.uint64(0x9E3779B97F4A7C15) + x
                whole.append(v)
            values, of = np.concatenate([values, mix(mix(np.array(whole, np.uint64)))]), np.concatenate([of, short])
    order = _by_text(of, values >> np.uint64(15), n)
    values, of = values[order], of[order]
    same = of[1:] == of[:-1]
    if (same & (values[1:] < values[:-1])).any():  # two shingles that differ in their last bits only
        order = np.lexsort((values, of))
        values, of = values[order], of[order]
    first = np.ones(len(values), bool)
    first[1:] = (values[1:] != values[:-1]) | ~same
    values, of = values[first], of[first]
    return values, np.searchsorted(of, np.arange(n + 1))


def _by_text(of: np.ndarray, key: np.ndarray, n: int) -> np.ndarray:
    """A stable order by text (0 .. n - 1), then by a key of 49 bits: one sort of both in a number."""
    if n > 1 << 15:
        return np.lexsort((key, of))
    return np.argsort(of.astype(np.uint64) << np.uint64(49) | key, kind="stable")


def _nodes(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A hash of each set: its mixed shingles added up, mixed with their number."""
    with np.errstate(over="ignore"):
        total = np.concatenate([[np.uint64(0)], np.cumsum(mix(values ^ np.uint64(0x5851F42D4C957F2D)))])
        return mix(total[bounds[1:]] - total[bounds[:-1]] + mix(np.diff(bounds).astype(np.uint64))).view(np.int64)


def _identity(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, row, node, n, bitmap of each row of docs (doc_id, row, text), and rows of block, counts: the counters of a task, whose number is in n."""
    names = ["doc_id", "row", "node", "n", "bitmap", "block", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for at, to, words in slices(batch.column(2), SPACES):
                values, bounds = shingle_sets(words, size)
                counts += np.bincount(_counter(values), minlength=COUNTERS)
                k = to - at
                maps = pa.array([_bitmap(values[i:j]) for i, j in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, k), batch.column(1).slice(at, k), pa.array(_nodes(values, bounds)), pa.array(np.diff(bounds).astype(np.int64)), maps, pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names=names)
        some = [i for i in range(COUNTERS // BLOCK) if counts[i * BLOCK : (i + 1) * BLOCK].any()]
        k, none = len(some), pa.nulls(len(some), pa.int64())
        task = pa.array(np.full(k, TaskContext.get().partitionId(), np.int64))
        yield pa.RecordBatch.from_arrays([none, none, none, task, pa.nulls(k, pa.binary()), pa.array(some, pa.int32()), pa.array([counts[i * BLOCK : (i + 1) * BLOCK].tobytes() for i in some], pa.binary())], names=names)
        release()

    return docs.mapInArrow(run, "doc_id long, row long, node long, n long, bitmap binary, block int, counts binary")


def _counter(values: np.ndarray) -> np.ndarray:
    return (values >> np.uint64(46)).astype(np.int64) & (COUNTERS - 1)


def _counters(found: DataFrame) -> np.ndarray:
    """The sum of all tasks' counters; those of `TASKS` tasks at a time, so that no task gets the counters of all."""
    blocks = found.where("block IS NOT NULL").select("block", F.floor(F.col("n") / TASKS).alias("some"), "counts")
    parts = blocks.groupBy("block", "some").applyInArrow(lambda t: _add_blocks(t), "block int, counts binary")
    total = np.zeros(COUNTERS, np.int64)
    for row in parts.groupBy("block").applyInArrow(lambda t: _add_blocks(t), "block int, counts binary").toArrow().to_pylist():
        total[row["block"] * BLOCK : (row["block"] + 1) * BLOCK] = np.frombuffer(row["counts"], np.int64)
    return total


def _add_blocks(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x, np.int64) for x in table["counts"].to_pylist())
    return pa.table({"block": pa.array([table["block"][0].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})


def _prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    return n - (n * percent + 99) // 100 + 1


def _index_length(n: np.ndarray, percent: int) -> np.ndarray:
    """Of the smaller set of a pair: two sets of at least n shingles share 2 t / (1 + t) n of them."""
    return n - (2 * n * percent + 99 + percent) // (100 + percent) + 1


def _postings(docs: DataFrame, counters: np.ndarray, buckets: int, size: int, percent: int, bucket_size: int) -> DataFrame:
    """bucket, tokens, nodes, sizes: packed blocks of the prefix shingles of all documents."""
    ranks = np.unique(counters, return_inverse=True)[1].astype(np.int32)
    # a counter far above the mean holds a hot shingle
    parts = np.maximum(1, np.ceil((counters - 2 * counters.mean()) / bucket_size)).astype(np.int32)
    sent = docs.sparkSession.sparkContext.broadcast((ranks, parts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (rank, parts), held, amount = sent.value, [], 0

        def flush() -> pa.RecordBatch:
            token, node, n = (np.concatenate(x) for x in zip(*held, strict=True))
            salt = parts[_counter(token)]
            split = salt > 1
            bucket = (token % np.uint64(buckets)).astype(np.int64)
            if split.any():
                with np.errstate(over="ignore"):
                    own = mix(node[split].view(np.uint64)) % salt[split].astype(np.uint64)
                    bucket[split] = (mix(token[split] + own) % np.uint64(buckets)).astype(np.int64)
                n = np.where(split, n | SPLIT, n)
            order = np.argsort(bucket, kind="stable")
            token, node, n, bucket = (token[order] >> np.uint64(16)).astype(np.uint32), node[order], n[order], bucket[order]
            edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
            pairs = list(zip(edges[:-1], edges[1:], strict=True))
            return pa.RecordBatch.from_arrays([pa.array(bucket[edges[:-1]].astype(np.int32)), *[pa.array([x[i:j].tobytes() for i, j in pairs], pa.binary()) for x in (token, node, n)]], names=["bucket", "tokens", "nodes", "sizes"])

        for batch in batches:
            for _, _, words in slices(batch.column(0), SPACES):
                values, bounds = shingle_sets(words, size)
                n = np.diff(bounds)
                of = np.repeat(np.arange(len(n)), n)
                # values ascend within a text, so a stable sort leaves ties of the key in their order
                order = _by_text(of, rank[_counter(values)].astype(np.uint64) << np.uint64(31) | values >> np.uint64(33), len(n))
                place = np.arange(len(values)) - np.repeat(bounds[:-1], n)
                use = place < np.repeat(_prefix_length(n, percent), n)
                size_of = n[of[use]].astype(np.uint32)
                held.append((values[order][use], _nodes(values, bounds)[of[use]], np.where(place[use] < _index_length(n, percent)[of[use]], size_of | INDEXED, size_of)))
                amount += int(use.sum())
                if amount >= FLUSH:
                    yield flush()
                    held, amount = [], 0
        if amount:
            yield flush()
        held.clear()
        release()

    return docs.select("text").mapInArrow(run, "bucket int, tokens binary, nodes binary, sizes binary")


def _read_bucket(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """token, node, size, indexed, split of a bucket, each pair of token and node once, by token, size and node."""
    token, node, n = (np.frombuffer(b"".join(table[c].to_pylist()), t) for c, t in (("tokens", np.uint32), ("nodes", np.int64), ("sizes", np.uint32)))
    order = np.lexsort((node, token.astype(np.uint64) << np.uint64(32) | (n & SIZE_BITS)))
    token, node, n = token[order], node[order], n[order]
    first = np.ones(len(token), bool)
    first[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1])
    token, node, n = token[first], node[first], n[first]
    return token, node, (n & SIZE_BITS).astype(np.int64), (n & INDEXED) > 0, (n & SPLIT) > 0


def _lists(percent: int):
    """For each bucket: links to try first (member a, the smallest node b that its size allows), and the lists of three nodes and more, as (list, a, n) rows.

    A list of two is its link; what the links of a longer list leave apart, its tiles look at again. Of a split shingle, all nodes
    are listed, by the shingle's name.
    """

    def run(table: pa.Table) -> pa.Table:
        token, node, n, indexed, split = _read_bucket(table)
        place = token.astype(np.int64) << 30
        to = np.searchsorted(place + n, place + n * 100 // percent, side="right")  # nodes of the list up to here are not too large
        reach = np.maximum.accumulate(np.where(indexed, to, 0)) if len(token) else to
        at = np.arange(len(token))
        meets = split | (indexed & (to > at + 1)) | (np.concatenate([[0], reach[:-1]]) > at if len(token) else split)
        token, node, n, split, place = (x[meets] for x in (token, node, n, split, place))
        edges = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1], [True]])) if len(token) else np.zeros(1, np.int64)
        sizes = np.diff(edges)
        least = np.searchsorted(place + n, place + (n * percent + 99) // 100)
        tries = np.flatnonzero(least < np.arange(len(token)))
        long_ = np.flatnonzero((sizes > 2) | split[edges[:-1]]) if len(sizes) else np.zeros(0, np.int64)
        with np.errstate(over="ignore"):
            total = np.concatenate([[np.uint64(0)], np.cumsum(mix(node.view(np.uint64)))])
            names = mix(total[edges[1:]] - total[edges[:-1]] + sizes.astype(np.uint64))[long_] if len(sizes) else np.zeros(0, np.uint64)
            if len(long_):
                names = np.where(split[edges[:-1][long_]], mix(mix(token[edges[:-1][long_]].astype(np.uint64))), names)
        names, once = np.unique(names, return_index=True)
        own = np.concatenate([np.zeros(0, np.int64), *[np.arange(edges[i], edges[i + 1]) for i in long_[once]]]).astype(np.int64)
        of = np.repeat(names, sizes[long_[once]]).view(np.int64)
        a, b = np.minimum(node[tries], node[least[tries]]), np.maximum(node[tries], node[least[tries]])
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, bool)
        a, b = a[new], b[new]
        k, r = len(a), len(own)
        return pa.table({"list": pa.concat_arrays([pa.nulls(k, pa.int64()), pa.array(of)]), "a": pa.array(np.concatenate([a, node[own]])), "b": pa.concat_arrays([pa.array(b), pa.nulls(r, pa.int64())]), "n": pa.concat_arrays([pa.nulls(k, pa.int64()), pa.array(n[own])])})

    return run


def _bitmap(values: np.ndarray) -> bytes:
    bits = LEAST_BITS
    while bits < BITS * len(values):
        bits *= 2
    return np.packbits(np.bincount((values >> np.uint64(7)).astype(np.int64) & (bits - 1), minlength=bits) & 1).astype(np.uint8).tobytes()


def differing_bits(a: bytes, b: bytes) -> int:
    """In how many bits two parity bitmaps differ, the longer one folded to the shorter one's length."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) < len(y):
        x, y = y, x
    if len(x) > len(y):
        x = np.bitwise_xor.reduce(x.reshape(-1, len(y)), axis=0)
    return int(np.bitwise_count(x ^ y).sum())


def may_link(n: int, m: int, bits: int, percent: int) -> bool:
    """Whether sets of n and m shingles can be alike, given in how many bits their bitmaps differ at least."""
    most = (n + m - bits) // 2
    return 100 * most >= percent * (n + m - most)


def _maybe(docs: DataFrame, keys: DataFrame, wanted: bool = True) -> DataFrame:
    """The rows of docs (with a column row) that may be among keys (row), or that are surely not; no text is shuffled."""
    place = lambda: F.pmod(F.xxhash64("row"), F.lit(POSITIONS)).cast("int")
    taken = keys.select(place().alias("_place")).distinct()
    return docs.join(F.broadcast(taken), place() == F.col("_place"), "left_semi" if wanted else "left_anti")


def _sets(docs: DataFrame, reps: DataFrame, size: int) -> DataFrame:
    """node, shingles of the nodes in reps (node, row), once each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, _, words in slices(batch.column(0), SPACES):
                values, bounds = shingle_sets(words, size)
                nodes, new = _nodes(values, bounds), []
                for i, node in enumerate(nodes.tolist()):
                    if bounds[i] < bounds[i + 1] and node not in seen:
                        seen.add(node)
                        new.append(i)
                yield pa.RecordBatch.from_arrays([pa.array(nodes[new]), pa.array([values[bounds[i] : bounds[i + 1]].tobytes() for i in new], pa.binary())], names=["node", "shingles"])

    found = _maybe(docs, reps).select("text").mapInArrow(run, "node long, shingles binary")
    return found.join(reps.select("node"), "node", "left_semi").dropDuplicates(["node"])


def _near(pairs: DataFrame, signs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose bitmaps allow them to be alike."""
    side = lambda x: signs.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("bitmap").alias(f"bitmap_{x}"))

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch.column(c).to_numpy() for c in ("n_a", "n_b"))
            x, y = ([v.as_buffer() for v in batch.column(c)] for c in ("bitmap_a", "bitmap_b"))
            sizes = np.array([[v.size for v in z] for z in (x, y)]).reshape(2, -1)
            ok = np.zeros(len(n), bool)
            for p, q in np.unique(sizes, axis=1).T:  # pairs of the same two lengths at a time
                at = np.flatnonzero((sizes[0] == p) & (sizes[1] == q))
                k = min(p, q)
                u, v = (np.bitwise_xor.reduce(np.frombuffer(b"".join(z[i] for i in at), np.uint8).reshape(len(at), -1, k), axis=1) for z in (x, y))
                ok[at] = may_link(n[at], m[at], np.bitwise_count(u ^ v).sum(axis=1, dtype=np.int64), percent)
            yield batch.select(["a", "b"]).filter(pa.array(ok))

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "bitmap_a", "bitmap_b").mapInArrow(bounded, "a long, b long")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are alike."""
    side = lambda x: sets.select(F.col("node").alias(x), F.col("shingles").alias(f"shingles_{x}"))

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("shingles_a"), batch.column("shingles_b"), strict=True):
                ok.append(_alike(*(np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y)), percent))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "shingles_a", "shingles_b").mapInArrow(alike, "a long, b long")


def _alike(u: np.ndarray, v: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(u, v, assume_unique=True))
    return 100 * both >= percent * (len(u) + len(v) - both)


def _open_pairs(table: pa.Table, percent: int):
    """comp and a generator of (i, others): pairs of rows of a tile whose components differ when asked, whose sizes allow a link and whose bitmaps do.

    A tile is a part of a list compared with itself, or two parts (i < j) compared with each other. Rows come by size; comp may change meanwhile.
    """
    n, part, comp = (table[c].to_numpy() for c in ("n", "part", "component"))
    comp, across = comp.copy(), table["i"][0].as_py() != table["j"][0].as_py()
    maps = [x.as_buffer() for x in table["bitmap"]]

    def pairs():
        folded: dict[int, np.ndarray] = {}
        for i in range(len(n)):
            to = int(np.searchsorted(n, n[i] * 100 // percent, side="right"))
            open_ = comp[i + 1 : to] != comp[i]
            if across:
                open_ &= part[i + 1 : to] != part[i]
            other = i + 1 + np.flatnonzero(open_)
            if not len(other):
                continue
            k = len(maps[i])
            if k not in folded:  # all bitmaps from here on are as long or longer: fold them once for each length
                folded = {k: np.stack([np.bitwise_xor.reduce(np.frombuffer(x, np.uint8).reshape(-1, k), axis=0) if len(x) >= k else np.zeros(k, np.uint8) for x in maps])}
            bits = np.bitwise_count(folded[k][other] ^ folded[k][i]).sum(axis=1, dtype=np.int64)
            most = (n[i] + n[other] - bits) // 2
            yield i, other[100 * most >= percent * (n[i] + n[other] - most)]

    return comp, pairs()


def _candidates(percent: int, dense: int):
    """The pairs (a, b) of a tile that may link; of a tile with more than `dense` pairs for each node, those nodes instead (b is null), with what `_tiles` reads."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("n", "ascending"), ("node", "ascending")])
        node, a, b, found, touched = table["node"].to_numpy(), [], [], 0, np.zeros(len(table), bool)
        for i, other in _open_pairs(table, percent)[1]:
            touched[other] = True
            touched[i] |= len(other) > 0
            found += len(other)
            if found <= dense * len(node):
                a.append(np.minimum(node[i], node[other]))
                b.append(np.maximum(node[i], node[other]))
        rest = ["list", "i", "j", "part", "n", "component"]
        if found > dense * len(node):
            own = table.filter(pa.array(touched))
            return pa.table({"a": own["node"], "b": pa.nulls(len(own), pa.int64()), **{c: own[c] for c in rest}})
        x, y = (np.concatenate([np.zeros(0, np.int64), *z]) for z in (a, b))
        return pa.table({"a": pa.array(x), "b": pa.array(y), **{c: pa.nulls(len(x), table.schema.field(c).type) for c in rest}})

    return run


def _tiles(percent: int):
    """Links between the components of a dense tile, as few as join what its nodes' links join: once two components are one, no pair of them is looked at."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("n", "ascending"), ("node", "ascending")])
        node, links = table["node"].to_numpy(), []
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table["shingles"]]
        comp, pairs = _open_pairs(table, percent)
        for i, other in pairs:
            for j in other:
                if comp[j] != comp[i] and _alike(sets[i], sets[j], percent):
                    links.append((min(node[i], node[j]), max(node[i], node[j])))
                    comp[comp == comp[j]] = comp[i]
        found = np.array(links, np.int64).reshape(-1, 2)
        return pa.table({"a": pa.array(found[:, 0]), "b": pa.array(found[:, 1])})

    return run


def _look_again(lists: DataFrame, signs: DataFrame, percent: int, dense: int) -> DataFrame:
    """Pairs (a, b) that may link in the lists (list, node, n, component, parts), and the rows of dense tiles (b is null)."""
    placed = lists.withColumn("part", F.pmod(F.xxhash64("node"), "parts").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    placed = placed.select("list", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "node", "n", "component")
    tiles = placed.join(signs.select("node", "bitmap"), "node")
    return tiles.groupBy("list", "i", "j").applyInArrow(lambda t: _candidates(percent, dense)(t), "a long, b long, list long, i int, j int, part int, n long, component long")


def link_rows(docs: DataFrame, size: int = WORDS, percent: int = PERCENT, bucket_size: int = BUCKET, dense: int = DENSE, part: int = TILE_NODES) -> DataFrame:
    """doc_id, row, n, component (a node; null for an empty set) of each row of docs (doc_id, row, text)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    path = folder(spark)
    first = keep(_identity(docs, size), path, "identity")
    rows = first.where("block IS NULL")
    signs = keep(rows.where("n > 0").groupBy("node").agg(F.first("n").alias("n"), F.first("bitmap").alias("bitmap"), F.min("row").alias("row")), path, "signs")
    counters = _counters(first)
    amount = int(_prefix_length(counters.sum(), percent))
    buckets = max(8, -(-amount // bucket_size))
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), buckets // 8)
    posted = _postings(docs, counters, buckets, size, percent, bucket_size).repartition(partitions, "bucket")
    tried = keep(posted.groupBy("bucket").applyInArrow(lambda t: _lists(percent)(t), "list long, a long, b long, n long"), path, "lists")
    lists = keep(tried.where("list IS NOT NULL").select("list", F.col("a").alias("node"), "n").distinct(), path, "members")
    near = keep(_near(tried.where("list IS NULL").select("a", "b").distinct(), signs, percent), path, "near-0")
    drop(spark, path, "lists")
    edges, sets, known, shape = None, None, None, "a long, b long"
    for k in range(3):
        if k:
            labelled = lists.join(comps, "node", "left").withColumn("component", F.coalesce("component", "node"))
            parts = F.greatest(F.ceil(F.sum("n") / TILE_SHINGLES), F.ceil(F.count("*") / part)).cast("int")
            open_ = labelled.groupBy("list").agg(F.min("component").alias("x"), F.max("component").alias("y"), parts.alias("parts"), F.count("*").alias("nodes")).where("x <> y").select("list", "parts", "nodes")
            todo = keep(labelled.join(open_, "list"), path, f"open-{k}")
            if todo.isEmpty():
                break
            if k == 1:  # for each node, the longest list that it is in
                todo = todo.join(todo.groupBy("node").agg(F.max(F.struct("nodes", "list"))["list"].alias("list")).select("list").distinct(), "list", "left_semi")
            near = keep(_look_again(todo.drop("nodes"), signs, percent, dense), path, f"near-{k}")
        pairs = near.where("b IS NOT NULL").select("a", "b").distinct()
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("node"))
        if k:
            wanted = wanted.unionByName(near.where("b IS NULL").select(F.col("a").alias("node")))
        wanted = wanted.distinct() if known is None else wanted.distinct().join(known, "node", "left_anti")
        reps = keep(signs.select("node", "row").join(wanted, "node", "left_semi"), path, f"reps-{k}")
        made = keep(_sets(docs, reps, size), path, f"sets-{k}")
        sets, known = (made, reps.select("node")) if sets is None else (sets.unionByName(made), known.unionByName(reps.select("node")))
        links = _linked(pairs, sets, percent)
        if k:
            whole = near.where("b IS NULL").drop("b").withColumnRenamed("a", "node").join(signs.select("node", "bitmap"), "node").join(sets, "node")
            links = links.unionByName(whole.groupBy("list", "i", "j").applyInArrow(lambda t: _tiles(percent)(t), shape))
        found = keep(links, path, f"edges-{k}")
        if not k or not found.isEmpty():
            edges = found if edges is None else edges.unionByName(found)
            comps = keep(components(edges, path, f"round-{k}"), path, f"components-{k}")
        drop(spark, path, f"near-{k}", f"open-{k}")
    drop(spark, path, "members", "signs", *[f"sets-{k}" for k in range(3)], *[f"reps-{k}" for k in range(3)])
    named = rows.join(comps, "node", "left")
    return named.select("doc_id", "row", "n", F.when(F.col("n") > 0, F.coalesce("component", "node")).alias("component"))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("doc_id").cast("long"), "text").alias("row"), "text")


def link(docs: DataFrame, size: int = WORDS, percent: int = PERCENT, **sizes: int) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of docs. sizes: bucket_size, dense and part of `link_rows`."""
    rows = link_rows(_keyed(docs), size, percent, **sizes)
    ids = rows.where("component IS NOT NULL").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return rows.join(ids, "component", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_each(docs: DataFrame) -> DataFrame:
    """The rows of docs that are first in their component, by doc_id (nulls last); of rows that repeat doc_id and text, one. All columns kept.

    Rows with an empty set link with nothing and all stay. Only texts that may go are shuffled.
    """
    keyed = _keyed(docs)
    rows = keep(link_rows(keyed), folder(docs.sparkSession), "rows").where("component IS NOT NULL")
    first = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))["row"].alias("row")).select("row", F.lit(True).alias("first"))
    # rows that go, and rows of which one stays
    doubtful = rows.groupBy("row").agg(F.count("*").alias("times")).join(first, "row", "left").where("first IS NULL OR times > 1").select("row", F.col("first").isNull().alias("goes"))
    key = unused(docs, "row")
    own = docs.withColumn(key, F.xxhash64(F.col("doc_id").cast("long"), "text"))
    named = doubtful.withColumnsRenamed({"row": "_row", "goes": "_goes"})
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(POSITIONS)).cast("int")
    taken = F.broadcast(named.select(place("_row").alias("_place")).distinct())
    goes = unused(own, "_goes")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    sure = own.join(taken, place(key) == taken["_place"], "left_anti").select(*columns)
    maybe = own.join(taken, place(key) == taken["_place"], "left_semi")
    joined = maybe.join(named.select(F.col("_row").alias(unused(own, "_row")), F.col("_goes").alias(goes)), F.col(key) == F.col(unused(own, "_row")), "left")
    stay = joined.where(F.col(goes).isNull()).select(*columns)
    once = joined.where(~F.col(goes)).dropDuplicates([key]).select(*columns)
    return sure.unionByName(stay).unionByName(once)


def op8_jaccard_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "documents"))


def brute_force(texts: dict[int, str | None], size: int = WORDS, percent: int = PERCENT) -> dict[int, tuple[int, int]]:
    """doc_id -> (n_shingles, component_id), by comparing all pairs; for tests."""
    import re

    sets = {}
    for k, text in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[k] = {tuple(islice(words, i, i + size)) for i in range(max(len(words) - size + 1, 1))} if words else set()
    parent = {k: k for k in sets}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {k: (len(sets[k]), root(k)) for k in keys}


QUERIES = {"op8_jaccard_tiles": op8_jaccard_tiles}
ORACLES: dict[str, str] = {}
