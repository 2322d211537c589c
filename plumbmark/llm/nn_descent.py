"""Approximate nearest neighbours by cosine: a neighbour graph by NN-descent, and greedy search in it.

Equal vectors are one node. Nodes lie in buckets, each a row of packed arrays: ids, unit vectors, neighbours. The graph starts
with the nearest neighbours within leaves of random projections. A round of NN-descent joins neighbours of
neighbours: every node sends its vector, rounded to 8 bits, to the nodes that it is linked with in either direction; a
node compares the vectors that came (in random parts of `MEET`, where more came) and sends to each the best others it saw; these are
merged into its list. As in the published method, two nodes whose links to the one that compares them are both old have met before
and don't meet again; and since a vector brings the least similarity of its node's list, what would not enter the list is not sent.
Messages are packed by bucket and joined with the buckets; nothing grows with the data but the number of buckets.

A search starts at the query's own node. Each step expands the best nodes of the beam that were not expanded yet: their
neighbours, in either direction, come back, and are compared with the query where they lie. Last, the cosines of what was
found are computed in double precision from the original vectors, for all that float rounding could place among the nearest.

Nothing of this is a fixed number of times: rounds go on until the lists hardly change (`CHANGED`), and a search until its
beam has no open node.

As in the published method, a node that is near to many takes part in a round with a random sample of `SAMPLE` of the links that
point to it; recall is measured against brute force in the tests (README has figures).

Defined results: vectors that are null, empty, zero or hold nulls, NaN or infinities take no part, nor do those whose length
isn't the most frequent one (ties: the longer); rows with a null vec_id are left out; a vec_id that repeats stands for
its rows one by one; equal vectors tie and go by vec_id; fewer candidates than asked for give all that are found.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbmark.llm.arrow_words import mix
from plumbmark.llm.scratch import drop, folder, keep
from plumbmark.session import table

NEIGHBOURS, SAMPLE, TELL = 32, 32, 10
#: The most vectors that are compared with each other at one node at a time.
MEET = 512
#: Rounds end when fewer than this share of the entries of all lists are new, as in the published method.
CHANGED = 0.001
TREES, LEAF = 6, 512
BUCKET = 4000
BEAM, EXPAND = 192, 48
#: Pairs of a query and a candidate that are compared at a time.
PAIRS = 1 << 16
EVERY, NEAREST = 50, 5

GRAPH = "bucket int, ids binary, vecs binary, nbrs binary, sims binary, new binary, fresh long"


def _bucket_of(ids: np.ndarray, buckets: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(ids.view(np.uint64)) % np.uint64(buckets)).astype(np.int32)


def _split(bucket: np.ndarray, arrays: list[np.ndarray], names: list[str]) -> pa.Table:
    """Rows of packed arrays, one for each bucket that occurs."""
    order = np.argsort(bucket, kind="stable")
    bucket, arrays = bucket[order], [a[order] for a in arrays]
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(bucket) else np.zeros(1, np.int64)
    pairs = list(zip(cuts[:-1], cuts[1:], strict=True))
    return pa.table({"bucket": pa.array(bucket[cuts[:-1]], pa.int32()), **{n: pa.array([a[i:j].tobytes() for i, j in pairs], pa.binary()) for n, a in zip(names, arrays, strict=True)}})


def _read(t: pa.Table, name: str, kind, width: int = 1) -> np.ndarray:
    out = np.frombuffer(b"".join(t[name].to_pylist()), kind) if len(t) else np.zeros(0, kind)
    return out.reshape(-1, width) if width > 1 else out


def _firsts(*keys: np.ndarray) -> np.ndarray:
    """Where sorted rows differ from the row before."""
    first = np.ones(len(keys[0]), bool)
    if len(first):
        first[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return first


def _merge(owner: np.ndarray, other: np.ndarray, sim: np.ndarray, known: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n, k) lists of the best distinct others of each owner (0 .. n - 1), best first, with which are not known; -1 fills up."""
    order = np.lexsort((-sim, other, owner))
    owner, other, sim, known = owner[order], other[order], sim[order], known[order]
    first = np.flatnonzero(_firsts(owner, other))
    known = np.maximum.reduceat(known, first) if len(first) else known
    owner, other, sim = owner[first], other[first], sim[first]
    order = np.lexsort((other, -sim, owner))
    owner, other, sim, known = owner[order], other[order], sim[order], known[order]
    place = np.arange(len(owner)) - np.searchsorted(owner, owner)
    ids, sims, new = np.full((n, k), -1, np.int64), np.full((n, k), -2.0, np.float32), np.zeros((n, k), np.int8)
    use = place < k
    ids[owner[use], place[use]], sims[owner[use], place[use]], new[owner[use], place[use]] = other[use], sim[use], ~known[use]
    return ids, sims, new


def usable(vectors: DataFrame, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, embedding of the rows that take part, node, the least vec_id of equal vectors."""
    e = F.col(vector).cast("array<double>")
    good = F.col(id_).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    rows = vectors.where(F.coalesce(good, F.lit(False))).select(F.col(id_).cast("long").alias("vec_id"), e.alias("embedding"))
    length = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).select("d")
    return rows.join(F.broadcast(length), F.size("embedding") == F.col("d")).drop("d")


def _unit(lists: pa.ChunkedArray, d: int) -> np.ndarray:
    x = lists.combine_chunks().flatten().to_numpy().reshape(-1, d)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def build(nodes: DataFrame, n: int, d: int, path: str, k: int = NEIGHBOURS) -> tuple[DataFrame, int]:
    """The graph of nodes (node, embedding), n of them of length d, and its number of buckets."""
    spark = nodes.sparkSession
    buckets = max(4, -(-n // BUCKET))
    bits = max(0, int(np.ceil(np.log2(max(n / LEAF, 1)))))
    planes = np.random.default_rng(11).normal(size=(TREES, max(bits, 1), d)).astype(np.float32)

    def coded(batches):
        for batch in batches:
            x = _unit(pa.chunked_array([batch.column(1)]), d) if batch.num_rows else np.zeros((0, d), np.float32)
            ids = batch.column(0).to_numpy()
            for t in range(TREES):
                code = ((x @ planes[t].T > 0) @ (1 << np.arange(planes.shape[1]))).astype(np.int64) if bits else np.zeros(len(ids), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), t, np.int32)), pa.array(code), pa.array(ids), pa.array([r.tobytes() for r in x], pa.binary())], names=["tree", "code", "node", "vec"])

    leaves = nodes.select("node", "embedding").mapInArrow(coded, "tree int, code long, node long, vec binary")
    # a leaf that got more than its share is dealt out further, by the node's hash
    sizes = leaves.groupBy("tree", "code").agg(F.ceil(F.count("*") / (4 * LEAF)).cast("long").alias("parts"))
    dealt = leaves.join(sizes, ["tree", "code"]).withColumn("part", F.pmod(F.xxhash64("node", "tree"), F.col("parts")))

    def leaf(t: pa.Table) -> pa.Table:
        ids, x = t["node"].to_numpy(), _read(t, "vec", np.float32, d).reshape(-1, d)
        m = min(k, len(ids) - 1)
        if m < 1:
            own, other, sim = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
        else:
            s = x @ x.T
            np.fill_diagonal(s, -2)
            best = np.argpartition(-s, m - 1, axis=1)[:, :m]
            own, other, sim = np.repeat(ids, m), ids[best].ravel(), np.take_along_axis(s, best, 1).ravel()
        return _split(_bucket_of(own, buckets), [own, other, sim.astype(np.float32)], ["a", "b", "sim"])

    links = "bucket int, a binary, b binary, sim binary"
    found = dealt.groupBy("tree", "code", "part").applyInArrow(lambda t: leaf(t), links)

    def packed(batches):
        for batch in batches:
            x = _unit(pa.chunked_array([batch.column(1)]), d) if batch.num_rows else np.zeros((0, d), np.float32)
            ids, m = batch.column(0).to_numpy(), batch.num_rows
            t = _split(_bucket_of(ids, buckets), [ids, x], ["ids", "vecs"])
            yield from t.append_column("nbrs", pa.nulls(len(t), pa.binary())).append_column("sims", pa.nulls(len(t), pa.binary())).append_column("new", pa.nulls(len(t), pa.binary())).append_column("fresh", pa.nulls(len(t), pa.int64())).to_batches()

    raw = nodes.select("node", "embedding").mapInArrow(packed, GRAPH)

    def gather(t: pa.Table) -> pa.Table:
        ids, x = _read(t, "ids", np.int64), _read(t, "vecs", np.float32, d).reshape(-1, d)
        order = np.argsort(ids)
        none, low, new = np.full((len(ids), k), -1, np.int64), np.full((len(ids), k), -2, np.float32), np.zeros((len(ids), k), np.int8)
        return pa.table({"bucket": pa.array([t["bucket"][0].as_py()], pa.int32()), **{c: pa.array([v.tobytes()], pa.binary()) for c, v in (("ids", ids[order]), ("vecs", x[order]), ("nbrs", none), ("sims", low), ("new", new))}, "fresh": pa.array([0], pa.int64())})

    graph = keep(raw.groupBy("bucket").applyInArrow(lambda t: gather(t), GRAPH), path, "graph-raw")

    def merged(g: pa.Table, m: pa.Table) -> pa.Table:
        ids, nbrs, sims = _read(g, "ids", np.int64), _read(g, "nbrs", np.int64), _read(g, "sims", np.float32)
        own = np.repeat(np.arange(len(ids)), k)
        ok = nbrs >= 0
        a, b, s = np.searchsorted(ids, _read(m, "a", np.int64)), _read(m, "b", np.int64), _read(m, "sim", np.float32)
        known = np.arange(int(ok.sum()) + len(a)) < ok.sum()
        nbrs, sims, new = _merge(np.concatenate([own[ok], a]), np.concatenate([nbrs[ok], b]), np.concatenate([sims[ok], s]), known, len(ids), k)
        return pa.table({"bucket": g["bucket"], "ids": g["ids"], "vecs": g["vecs"], **{c: pa.array([x.tobytes()], pa.binary()) for c, x in (("nbrs", nbrs), ("sims", sims), ("new", new))}, "fresh": pa.array([int(new.sum())], pa.int64())})

    def reversed_links(batches):
        for batch in batches:
            t = pa.Table.from_batches([batch])
            for row in range(len(t)):
                g = t.slice(row, 1)
                ids, nbrs, new = _read(g, "ids", np.int64), _read(g, "nbrs", np.int64), _read(g, "new", np.int8)
                own, ok = np.repeat(ids, k), nbrs >= 0
                yield from _split(_bucket_of(nbrs[ok], buckets), [nbrs[ok], own[ok], new[ok]], ["a", "b", "new"]).to_batches()

    def sent(g: pa.Table, m: pa.Table) -> pa.Table:
        """Each node's vector to all that it is linked with, with the least similarity of its list and whether the link is new."""
        if not len(g):
            return _split(np.zeros(0, np.int32), [np.zeros(0, np.int64)] * 2 + [np.zeros((0, d + 9), np.int8)], ["a", "b", "vec"])
        ids, x, nbrs = _read(g, "ids", np.int64), _read(g, "vecs", np.float32, d).reshape(-1, d), _read(g, "nbrs", np.int64)
        least = _read(g, "sims", np.float32).reshape(-1, k)[:, -1:]
        own, ok = np.repeat(np.arange(len(ids)), k), nbrs >= 0
        back, to, new = np.searchsorted(ids, _read(m, "a", np.int64)), _read(m, "b", np.int64), _read(m, "new", np.int8)
        # of a node that very many point to, links that were not in the sample can be old and unmet: all of its links count as new
        new = np.maximum(new, (np.bincount(back, minlength=len(ids)) > SAMPLE)[back].astype(np.int8))
        rng = np.random.default_rng([len(ids), g["fresh"][0].as_py(), len(back)])
        order = np.lexsort((rng.random(len(back)), back))
        back, to, new = back[order], to[order], new[order]
        use = np.arange(len(back)) - np.searchsorted(back, back) < SAMPLE
        a, b, new = np.concatenate([own[ok], back[use]]), np.concatenate([nbrs[ok], to[use]]), np.concatenate([_read(g, "new", np.int8)[ok], new[use]])
        order = np.lexsort((-new, b, a))
        order = order[_firsts(a[order], b[order])]
        a, b, new = a[order], b[order], new[order]
        step = np.abs(x).max(axis=1, keepdims=True) / 127
        small = np.concatenate([np.round(x / step).astype(np.int8), step.astype(np.float32).view(np.int8), least.copy().view(np.int8)], axis=1)
        return _split(_bucket_of(b, buckets), [b, ids[a], np.concatenate([small[a], new[:, None]], axis=1)], ["a", "b", "vec"])

    def met(t: pa.Table) -> pa.Table:
        """Compares the vectors that came to a node, if a link of the two is new, and tells each the best others that would enter its list."""
        a, b, raw_ = _read(t, "a", np.int64), _read(t, "b", np.int64), _read(t, "vec", np.int8, d + 9).reshape(-1, d + 9)
        # what came to a hub is compared in random parts, so that its work grows with what came and not with the square of it
        order = np.lexsort((mix(b.view(np.uint64)), a))
        a, b, raw_ = a[order], b[order], raw_[order]
        scale = np.ascontiguousarray(raw_[:, d : d + 8]).view(np.float32)
        x, least, new = raw_[:, :d].astype(np.float32) * scale[:, :1], scale[:, 1:], raw_[:, -1] > 0
        cuts = np.flatnonzero(np.append(_firsts(a), True)) if len(a) else np.zeros(1, np.int64)
        own, other, sim = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.float32)]
        starts = [s for i, j in zip(cuts[:-1], cuts[1:], strict=True) for s in range(i, j, -(-(j - i) // -(-(j - i) // MEET)))]
        for i, j in zip(starts, [*starts[1:], len(a)], strict=True):
            m, news = min(TELL, j - i - 1), np.flatnonzero(new[i:j])
            if m < 1 or not len(news):
                continue
            s = x[i:j] @ x[i:j].T
            np.fill_diagonal(s, -2)
            if len(news) < j - i:
                old = np.flatnonzero(~new[i:j])
                s[old[:, None], old] = -2
            enters = s > least[i:j]
            amount = np.count_nonzero(enters, axis=1)
            many = np.flatnonzero(amount > m)
            if len(many):
                best = np.argpartition(-s[many], m - 1, axis=1)[:, :m]
                enters[many] = False
                enters[many[:, None], best] = True
            p, q = np.nonzero(enters)
            own.append(b[i:j][p])
            other.append(b[i:j][q])
            sim.append(s[p, q])
        own, other, sim = np.concatenate(own), np.concatenate(other), np.concatenate(sim)
        key = np.lexsort((other, own))
        key = key[_firsts(own[key], other[key])]
        return _split(_bucket_of(own[key], buckets), [own[key], other[key], sim[key].astype(np.float32)], ["a", "b", "sim"])

    joined = lambda g, m, f, schema: g.groupBy("bucket").cogroup(m.groupBy("bucket")).applyInArrow(lambda x, y: f(x, y), schema)
    graph = keep(joined(graph, found, merged, GRAPH), path, "graph-0")
    i, fresh = 0, n * k
    while fresh >= CHANGED * n * k:
        i += 1
        back = graph.select("bucket", "ids", "nbrs", "new").mapInArrow(reversed_links, "bucket int, a binary, b binary, new binary")
        vectors = joined(graph, back, sent, "bucket int, a binary, b binary, vec binary")
        told = vectors.groupBy("bucket").applyInArrow(lambda t: met(t), links)
        graph = keep(joined(graph, told, merged, GRAPH), path, f"graph-{i}")
        drop(spark, path, f"graph-{i - 1}")
        fresh = graph.agg(F.sum("fresh")).first()[0]
    return graph, buckets


def search(graph: DataFrame, buckets: int, starts: DataFrame, d: int, path: str, k: int = NEIGHBOURS, beam: int = BEAM, expand: int = EXPAND, top: int | None = None) -> DataFrame:
    """query, node of what a greedy search from each start finds. starts: query (long), vec (packed unit float32), node (where it begins).

    Both directions of the links are followed. A query's state is a row; messages between queries and nodes are packed by bucket, and
    queries share as many parts. With top, only what float rounding could place among the top nearest of what was found.
    """
    spark = graph.sparkSession
    state = "part int, query long, vec binary, ids binary, sims binary, done binary, open boolean"

    def linked(batches):
        for batch in batches:
            t = pa.Table.from_batches([batch])
            for row in range(len(t)):
                g = t.slice(row, 1)
                ids, nbrs = _read(g, "ids", np.int64), _read(g, "nbrs", np.int64)
                own, ok = np.repeat(ids, k), nbrs >= 0
                a, b = np.concatenate([own[ok], nbrs[ok]]), np.concatenate([nbrs[ok], own[ok]])
                yield from _split(_bucket_of(a, buckets), [a, b], ["a", "b"]).to_batches()

    def listed(t: pa.Table) -> pa.Table:
        a, b = _read(t, "a", np.int64), _read(t, "b", np.int64)
        order = np.lexsort((b, a))
        return pa.table({"bucket": pa.array([t["bucket"][0].as_py()], pa.int32()), "a": pa.array([a[order].tobytes()], pa.binary()), "b": pa.array([b[order].tobytes()], pa.binary())})

    both = keep(graph.select("bucket", "ids", "nbrs").mapInArrow(linked, "bucket int, a binary, b binary").groupBy("bucket").applyInArrow(lambda t: listed(t), "bucket int, a binary, b binary"), path, "links")

    def begin(batches):
        for batch in batches:
            n, queries = batch.num_rows, batch.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(_bucket_of(queries, buckets)), batch.column(0), batch.column(1), pa.array([int(x).to_bytes(8, "little", signed=True) for x in batch.column(2).to_pylist()], pa.binary()), pa.array([np.float32(1).tobytes()] * n, pa.binary()), pa.array([b"\0"] * n, pa.binary()), pa.array([True] * n)], names=["part", "query", "vec", "ids", "sims", "done", "open"])

    def beams(t) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, ids, done, which are expanded next) of the beams of some rows."""
        ids, done = _read(t, "ids", np.int64), _read(t, "done", np.int8)
        of = np.repeat(np.arange(len(t)), [len(x) for x in t["done"].to_pylist()])
        open_ = done == 0
        before = np.cumsum(open_) - open_
        nth = before - before[np.searchsorted(of, of)]
        return of, ids, done, open_ & (nth < expand)

    def asked(batches):
        """The nodes that each query expands next, by bucket."""
        for batch in batches:
            t = pa.Table.from_batches([batch])
            of, ids, _, next_ = beams(t)
            if next_.any():
                yield from _split(_bucket_of(ids[next_], buckets), [t["query"].to_numpy()[of[next_]], ids[next_]], ["query", "node"]).to_batches()

    def answered(g: pa.Table, m: pa.Table) -> pa.Table:
        """The neighbours of the nodes asked for, sent on to where they lie."""
        a, b, q, v = _read(g, "a", np.int64), _read(g, "b", np.int64), _read(m, "query", np.int64), _read(m, "node", np.int64)
        lo, hi = np.searchsorted(a, v), np.searchsorted(a, v, side="right")
        size = hi - lo
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum()) if len(v) else np.zeros(0, np.int64)
        q, v = np.repeat(q, size), b[at]
        order = np.lexsort((v, q))
        order = order[_firsts(q[order], v[order])]
        return _split(_bucket_of(v[order], buckets), [q[order], v[order]], ["query", "node"])

    def pairs_of(batches):
        """Which queries have candidates in which bucket."""
        for batch in batches:
            for bucket, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                q = np.unique(np.frombuffer(packed, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(q), bucket, np.int32)), pa.array(q)], names=["bucket", "query"])

    def compared(g: pa.Table, m: pa.Table) -> pa.Table:
        """The candidates that would enter their query's beam, with their similarities."""
        q, v, found = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
        if len(g) and len(m):
            ids, x = _read(g, "ids", np.int64), _read(g, "vecs", np.float32, d).reshape(-1, d)
            asks, vecs = m.filter(pc.is_valid(m["query"])), m.filter(pc.is_valid(m["own"])).sort_by("own")
            own, y, least = vecs["own"].to_numpy(), _read(vecs, "vec", np.float32, d).reshape(-1, d), vecs["least"].to_numpy()
            q, v = _read(asks, "query", np.int64), _read(asks, "node", np.int64)
            order = np.lexsort((v, q))
            order = order[_firsts(q[order], v[order])]
            q, v = q[order], v[order]
            at, of = np.searchsorted(ids, v), np.searchsorted(own, q)
            found = np.concatenate([np.zeros(0, np.float32), *[np.einsum("ij,ij->i", x[at[i : i + PAIRS]], y[of[i : i + PAIRS]]) for i in range(0, len(q), PAIRS)]])
            enters = found >= least[of]
            q, v, found = q[enters], v[enters], found[enters]
        return _split(_bucket_of(q, buckets), [q, v, found], ["query", "ids", "sims"]).rename_columns(["part", "query", "ids", "sims"])

    def absorbed(s: pa.Table, m: pa.Table) -> pa.Table:
        if not len(s):
            return s
        s = s.sort_by("query")
        queries = s["query"].to_numpy()
        of, ids, done, next_ = beams(s)
        more = np.searchsorted(queries, _read(m, "query", np.int64))
        of, ids, sims, done = np.concatenate([of, more]), np.concatenate([ids, _read(m, "ids", np.int64)]), np.concatenate([_read(s, "sims", np.float32), _read(m, "sims", np.float32)]), np.concatenate([done | next_, np.zeros(len(more), np.int8)])
        order = np.lexsort((-done, ids, of))
        order = order[_firsts(of[order], ids[order])]
        order = order[np.lexsort((ids[order], -sims[order], of[order]))]
        order = order[np.arange(len(order)) - np.searchsorted(of[order], of[order]) < beam]
        of, ids, sims, done = of[order], ids[order], sims[order], done[order].astype(np.int8)
        cuts = np.searchsorted(of, np.arange(len(s) + 1))
        pack = lambda x: pa.array([x[i:j].tobytes() for i, j in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())
        return pa.table({"part": s["part"], "query": s["query"], "vec": s["vec"], "ids": pack(ids), "sims": pack(sims), "done": pack(done), "open": pa.array(np.bincount(of[done == 0], minlength=len(s)) > 0)})

    def least_of(batches):
        """The similarity from which a node would enter a query's beam."""
        for batch in batches:
            sims = [np.frombuffer(x, np.float32) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([float(x[-1]) if len(x) >= beam else -2.0 for x in sims], pa.float32())], names=["query", "vec", "least"])

    own = keep(starts.select("query", "vec", "node").mapInArrow(begin, state), path, "beam-0")
    i, ended = 0, []
    # searches whose beam has no open node are over, and leave
    while not own.isEmpty():
        i += 1
        ask = own.select("query", "ids", "done").mapInArrow(asked, "bucket int, query binary, node binary")
        reply = keep(both.groupBy("bucket").cogroup(ask.groupBy("bucket")).applyInArrow(lambda x, y: answered(x, y), "bucket int, query binary, node binary"), path, f"reply-{i}")
        # a query's vector goes once to each bucket that has a candidate
        wanted = reply.select("bucket", "query").mapInArrow(pairs_of, "bucket int, query long").distinct()
        vectors = wanted.join(own.select("query", "vec", "sims").mapInArrow(least_of, "query long, vec binary, least float"), "query")
        work = reply.select("bucket", "query", "node", *[F.lit(None).cast(kind).alias(c) for c, kind in (("own", "long"), ("vec", "binary"), ("least", "float"))])
        work = work.unionByName(vectors.select("bucket", *[F.lit(None).cast("binary").alias(c) for c in ("query", "node")], F.col("query").alias("own"), "vec", "least"))
        seen = graph.select("bucket", "ids", "vecs").groupBy("bucket").cogroup(work.groupBy("bucket")).applyInArrow(lambda x, y: compared(x, y), "part int, query binary, ids binary, sims binary")
        own = keep(own.groupBy("part").cogroup(seen.groupBy("part")).applyInArrow(lambda x, y: absorbed(x, y), state), path, f"beam-{i}")
        drop(spark, path, f"reply-{i}")
        ended.append(own.where("NOT open"))
        own = own.where("open")

    def unpacked(batches):
        # a float cosine of unit vectors is off by half of this at most
        slack = 2 * (2 * d + 16) * 2.0**-24
        for batch in batches:
            t = pa.Table.from_batches([batch])
            ids, sims = _read(t, "ids", np.int64), _read(t, "sims", np.float32)
            size = np.array([len(x) // 8 for x in t["ids"].to_pylist()], np.int64)
            if top is not None and len(ids):
                last = sims[np.cumsum(size) - size + np.minimum(size, top) - 1]  # the top-th of each, best first
                use = sims >= np.repeat(last - slack, size)
            else:
                use = np.ones(len(ids), bool)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(t["query"].to_numpy(), size)[use]), pa.array(ids[use])], names=["query", "node"])

    return reduce(DataFrame.unionAll, [x.select("query", "ids", "sims") for x in [*ended, own]]).mapInArrow(unpacked, "query long, node long")


def cosine(a, b):
    """In double precision, summed in the order of the components. Each vector is first divided by a power of two near its largest
    component, which changes no digit, so that very large and very small vectors neither overflow nor vanish."""
    scaled = lambda x: F.transform(x, lambda v: v / F.pow(F.lit(2.0), F.floor(F.log2(F.array_max(F.transform(x, F.abs))))))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    of = lambda x, y: dot(x, y) / (F.sqrt(dot(x, x)) * F.sqrt(dot(y, y)))
    return F.transform(F.array(F.struct(scaled(a).alias("x"), scaled(b).alias("y"))), lambda s: of(s["x"], s["y"]))[0]


def nearest(vectors: DataFrame, is_query, k: int = NEAREST) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row where is_query holds, among all other rows."""
    spark = vectors.sparkSession
    path = folder(spark)
    rows = keep(usable(vectors).withColumn("query", F.coalesce(is_query, F.lit(False))), path, "rows")
    # equal vectors share a hash; a node is one vector, named by its least vec_id
    named = rows.groupBy("embedding").agg(F.min("vec_id").alias("node"))
    nodes = keep(named, path, "nodes")
    head = nodes.agg(F.count("*"), F.max(F.size("embedding"))).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if not head[0]:
        return spark.createDataFrame([], schema)
    n, d = int(head[0]), int(head[1])
    graph, buckets = build(nodes, n, d, path)
    members = keep(rows.join(nodes, "embedding").select("vec_id", "node", "query"), path, "members")
    asked = members.where("query").select("node").distinct().join(nodes, "node")

    def as_start(batches):
        for batch in batches:
            x = _unit(pa.chunked_array([batch.column(1)]), d) if batch.num_rows else np.zeros((0, d), np.float32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x], pa.binary()), batch.column(0)], names=["query", "vec", "node"])

    starts = asked.select("node", "embedding").mapInArrow(as_start, "query long, vec binary, node long")
    found = search(graph, buckets, starts, d, path, top=k + 1)
    a, b = asked.select(F.col("node").alias("query"), F.col("embedding").alias("a")), nodes.select("node", F.col("embedding").alias("b"))
    scored = found.join(b, "node").join(a, "query").select("query", "node", cosine(F.col("a"), F.col("b")).alias("score"))
    best = scored.withColumn("nth", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "node"))).where(F.col("nth") <= k + 1).drop("nth")
    # of the rows of a node, the first k + 1 by vec_id can be among a query's k; two levels, so that a hot node is split
    some = members.withColumn("_s", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    for keys in (["node", "_s"], ["node"]):
        some = some.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("vec_id"))).where(F.col("_n") <= k + 1)
    ranked = best.join(some.select("node", "vec_id"), "node").withColumn("nth", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))).where(F.col("nth") <= k + 1)
    pairs = members.where("query").select(F.col("vec_id").alias("query_id"), F.col("node").alias("query")).join(ranked.select("query", "vec_id", "score"), "query").where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)


QUERIES = {"op4_nn_descent": op4_nn_descent}
ORACLES: dict[str, str] = {}
