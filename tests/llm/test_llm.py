"""The training-data operators on small, odd tables, against brute force."""

import base64
import functools
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbmark.llm import arrow_words, chat_format, components, feistel_pii, hash_tree, jaccard_join, katz_lm, merge_replay, nn_descent, queries, rule_quality, scratch, text_cnn, window_decontam

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, label int, n int"
LONG = "Word%d and more " * 4000 % tuple(range(4000))
ODD = [(1, None, "en", 1, 2), (2, "", "en", 1, 2), (3, " \n\t ", None, 1, 2), (4, "one", "xx", 1, 2), (4, "one", "xx", 1, 2), (None, "no id here at all, none", "en", 0, 0), (5, LONG, "en", 0, 0), (6, LONG + " tail", "en", 0, 0), (7, "ünï ﷽ 漢字 \x00 \x1c a　b 😀", "fr", 1, 1)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_all_are_registered():
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES} == set(range(1, 11))


def test_word_hashes():
    import pyarrow as pa

    texts = [None, "", "Ab ab aB", "  x\ty\n", "é É"]
    _, _, w = next(arrow_words.slices(pa.array(texts), arrow_words.SPACES))
    h = w.hashes()
    assert np.diff(w.bounds).tolist() == [0, 0, 3, 2, 2] and h[0] == h[1] == h[2] and len(set(h.tolist())) == 5


def test_sql_ones(spark):
    import duckdb

    for name, sql in queries.ORACLES.items():
        con = duckdb.connect()
        for t in ("documents", "benchmark", "conversations"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        got, want = queries.QUERIES[name](spark, SF).toPandas(), con.sql(sql).df()
        cols = sorted(want.columns)
        assert sorted(map(str, got[cols].itertuples(index=False, name=None))) == sorted(map(str, want[cols].itertuples(index=False, name=None))), name


def test_classifiers(spark, odd, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for op, label, column in ((rule_quality, "quality", "quality"), (text_cnn, "toxic", "toxicity")):
        model = op.train(docs, labels)
        for df in (odd, odd.limit(0)):
            got = op.score(df, model).select(column).collect()
            assert len(got) == df.count() and all(0 <= r[0] <= 1 for r in got)
        one = op.train(docs, labels.limit(0))
        assert {round(r[0], 6) for r in op.score(odd, one).select(column).collect()} == {0.5}
    r = queries.QUERIES["op1_rule_ensemble_quality"](spark, SF).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([(x.predicted == x.quality) for x in r]) >= 0.8


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    r = queries.QUERIES["op3_toxicity_cnn"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert r.predicted[r.toxic == 1].mean() >= 0.85 and r.predicted[r.toxic == 0].mean() <= 0.05


def test_bpe(spark, odd, docs):
    import tiktoken

    path, pattern = merge_replay.public()
    v = merge_replay.vocabulary(path, pattern)
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}, special_tokens={})
    for df in (odd, docs, odd.limit(0)):
        for r in merge_replay.decode(merge_replay.encode(df)).collect():
            assert list(r.ids) == enc.encode_ordinary(r.text or "") and bytes(r.bytes) == (r.text or "").encode()
    rng = random.Random(2)
    texts = ["".join(rng.choice("aab 's\n\té９٣😀　\r\x1cllve19") for _ in range(rng.randint(0, 60))) for _ in range(3000)] + ["ab" * 3000, " " * 500]
    assert v.encode(texts) == [enc.encode_ordinary(t) for t in texts]
    got = {r.doc_id: r for r in queries.QUERIES["op2_bpe_merge_replay"](spark, SF).collect()}
    for r in docs.collect():
        ids = enc.encode_ordinary(r.text or "")
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and got[r.doc_id].decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 16)).round(3)
    x[10:400] = x[10]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [1.0]), (2004, []), (2005, [None] * 16), (None, [1.0] * 16)]
    got = nn_descent.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).toPandas()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = 0
    for q in range(0, 1500, 50):
        s = u @ u[q]
        s[q] = -2
        kth = np.sort(s)[-5]
        own = got[got.query_id == q]
        assert own["rank"].tolist() == [1, 2, 3, 4, 5] and np.allclose(own.score, s[own.vec_id], atol=1e-9)
        hit += (s[own.vec_id] >= kth - 1e-9).sum()
    assert hit >= 0.9 * 5 * 30
    assert got[got.query_id == 50].vec_id.tolist() == [10, 11, 12, 13, 14]
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<double>")
    assert nn_descent.nearest(few, F.col("vec_id") == 0).count() == 2 and nn_descent.nearest(few.limit(0), F.lit(True)).count() == 0


def test_neighbours_until_done(spark):
    """A search goes on until its beam has no open node; rounds go on until lists hardly change."""
    n, k, path = 12, 2, scratch.folder(spark)
    x = np.stack([np.cos(np.arange(n) / 8), np.sin(np.arange(n) / 8)], axis=1).astype(np.float32)
    chain = np.array([[i - 1, i + 1 if i + 1 < n else -1] for i in range(n)])
    graph = spark.createDataFrame([(0, np.arange(n).tobytes(), x.tobytes(), chain.tobytes(), np.zeros((n, k), np.float32).tobytes())], "bucket int, ids binary, vecs binary, nbrs binary, sims binary")
    start = spark.createDataFrame([(5, x[-1].tobytes(), 0)], "query long, vec binary, node long")
    assert {r.node for r in nn_descent.search(graph, 1, start, 2, path, k=k).collect()} == set(range(n))
    x = np.random.default_rng(5).normal(size=(2500, 24))
    nodes = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "node long, embedding array<double>")
    graph, _ = nn_descent.build(nodes, len(x), 24, path)
    assert graph.agg(F.sum("fresh")).first()[0] < nn_descent.CHANGED * len(x) * nn_descent.NEIGHBOURS


def test_katz_bucket_memory():
    """A bucket is scored in well below 100 bytes a token, besides its cells."""
    import tracemalloc

    import pyarrow as pa

    rng, cells, tokens = np.random.default_rng(1), {c: [] for c in katz_lm.CELL}, 20_000
    words, counts, runs = np.sort(rng.choice(1 << 30, 50_000, replace=False)) + katz_lm.WORD, rng.integers(1, 50, 50_000), np.full(200, 100)
    for i in range(20):
        drawn = np.minimum((rng.pareto(0.7, (3, tokens)) * 30).astype(np.int64), len(words) - 1)
        used = np.unique(drawn)
        values = (np.diff(words[used], prepend=0), counts[used], *np.searchsorted(used, drawn), np.ones(200, int), runs, np.zeros(200, bool))
        for c, x in zip(katz_lm.CELL, (bytes([i]), *map(katz_lm._pack, values)), strict=True):
            cells[c].append(x)
    model = katz_lm.Model(30_000_000, 50_000, 80_000, 20, [katz_lm.discounts({r: 100 // r for r in range(1, 7)})] * 3, {}, 1e-6)
    bucket = pa.table({c: pa.array([v], pa.list_(pa.binary())) for c, v in cells.items()})
    none = pa.table({c: pa.array([], k) for c, k in (("history", pa.int64()), ("n", pa.float64()), ("took", pa.float64()), ("mass", pa.float64()))})
    tracemalloc.start()
    try:
        found = katz_lm._scores(model)(bucket, none)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(found) == 20 and peak < 90 * 20 * tokens


def test_neighbours_work(spark):
    """What is known or doesn't enter a list makes no work, and only what can be among the nearest is compared exactly."""
    own, other, sim = np.array([0, 0, 0, 1]), np.array([7, 8, 7, 9]), np.array([0.5, 0.9, 0.6, 0.1], np.float32)
    ids, sims, new = nn_descent._merge(own, other, sim, np.array([True, False, False, False]), 2, 2)
    assert ids.tolist() == [[8, 7], [9, -1]] and np.allclose(sims, [[0.9, 0.6], [0.1, -2]]) and new.tolist() == [[1, 0], [1, 0]]
    n, k, path = 12, 2, scratch.folder(spark)
    x = np.stack([np.cos(np.arange(n) / 8), np.sin(np.arange(n) / 8)], axis=1).astype(np.float32)
    chain = np.array([[i - 1, i + 1 if i + 1 < n else -1] for i in range(n)])
    graph = spark.createDataFrame([(0, np.arange(n).tobytes(), x.tobytes(), chain.tobytes(), np.zeros((n, k), np.float32).tobytes())], "bucket int, ids binary, vecs binary, nbrs binary, sims binary")
    starts = spark.createDataFrame([(5, x[-1].tobytes(), n - 1), (6, x[0].tobytes(), 0)], "query long, vec binary, node long")
    found = nn_descent.search(graph, 1, starts, 2, path, k=k, top=3).collect()
    assert {(r.query, r.node) for r in found} == {(5, n - 1), (5, n - 2), (5, n - 3), (6, 0), (6, 1), (6, 2)}


def test_decontamination(spark, odd):
    items = spark.createDataFrame([(1, "One two three four five six seven eight nine ten eleven"), (2, "short ITEM"), (2, "short item"), (3, None), (4, "!!"), (None, "null id item"), (5, "short item of")], "item_id long, text string")
    texts = odd.select("doc_id", "text").unionByName(spark.createDataFrame([(20, "x short item y short item"), (21, "one two three four five six seven eight nine ten eleven twelve"), (22, "one two three four five six seven eight nine"), (23, "short-item of")], "doc_id long, text string"))
    got = {r.doc_id: r for r in window_decontam.summary(texts, items).collect()}
    assert (got[20].n_hit, got[20].n_items) == (4, 1) and (got[21].n_hit, got[21].n_items) == (11, 1) and not got[22].contaminated and (got[23].n_hit, got[23].n_items) == (3, 2)
    assert got[1].n_words == 0 and got[23].items_sha256 == hashlib.sha256(b"2,5").hexdigest()
    assert window_decontam.summary(texts, items).count() == texts.count() and window_decontam.summary(texts.limit(0), items).count() == 0
    assert not any(r.contaminated for r in window_decontam.summary(texts, items.limit(0)).collect())
    assert {r.doc_id for r in window_decontam.clean(texts, items).collect()} == {r.doc_id for r in texts.collect()} - {20, 21, 23}
    shuffled = window_decontam.BROADCAST_WORDS
    try:
        window_decontam.BROADCAST_WORDS = 1
        assert {r.doc_id: r for r in window_decontam.summary(texts, items).collect()} == got
    finally:
        window_decontam.BROADCAST_WORDS = shuffled


def test_sharding(spark, odd):
    rows = odd.select("doc_id", "text").unionByName(spark.range(100, 4100).select(F.col("id").alias("doc_id"), F.lit("same text").alias("text")))
    got = hash_tree.assign(rows, hash_tree.Tree.of(40), hash_tree.Tree.of(41)).collect()
    assert len(got) == rows.count() and all(r.grown_shard in (r.shard, 40) for r in got) and any(r.grown_shard == 40 for r in got)
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert set(slots) == set(range(40)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(60 <= len(s) <= 145 for s in slots.values())
    light = hash_tree.assign(rows, hash_tree.Tree.of(40).with_weight(1, 2, 3, 0.0)).collect()
    before = {r.doc_id: r.shard for r in got if r.doc_id}
    # a lighter shard's rows move within or out of its subtree; no row moves between others' subtrees into a third
    assert all(r.shard != 33 for r in light) and all(before[r.doc_id] >= 20 for r in light if r.doc_id and before[r.doc_id] != r.shard)
    assert hash_tree.assign(rows.limit(0), hash_tree.Tree.of(3)).count() == 0


def test_chat(spark):
    log = spark.createDataFrame([(1, 0, "message", "a", "user", "q <| \\ <\\|"), (1, 1, "message", "b", "assistant", "one "), (1, 2, "delta", "b", None, "two"), (1, 3, "message", "c", "user", "gone"), (1, 4, "regenerate", "b", None, "x"), (1, 5, "delta", "b", None, "new<|im_end|>"), (1, 6, "message", "d", "as\n\\nsis", None), (1, 7, "edit", "a", None, "<|im_start|>edited"), (None, 0, "message", "a", None, "t")], "conv_id long, seq long, kind string, message string, role string, text string")
    final = chat_format.reconstruct(log)
    got = {r.conv_id: r for r in chat_format.parse(chat_format.render(final)).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [("user", "<|im_start|>edited"), ("assistant", "new<|im_end|>"), ("as\n\\nsis", "")]
    assert got[1].loss_text == "new<|im_end|>" and got[None].turns[0].text == "t"
    assert chat_format.render(chat_format.reconstruct(log.limit(0))).count() == 0


def test_chat_repeated_rows(spark, tmp_path):
    """Rows that repeat exactly are turns of their own, as in the query's SQL."""
    import duckdb

    rows = [(1, 0, "user", "same"), (1, 0, "user", "same"), (1, 1, "assistant", "yes <|"), (1, 1, "assistant", "yes <|"), (1, 1, "assistant", "yes <|"), (1, 2, "user", None), (1, 2, "user", None), (2, 0, "assistant", "z"), (2, 0, None, "a"), (2, 0, None, "a")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.sql(chat_format.ORACLES["op7_chat_formatting"]).df()
    got = queries.QUERIES["op7_chat_formatting"](spark, str(tmp_path)).toPandas()[list(want.columns)]
    assert got[got.conv_id == 1].n_turns.tolist() == [7]
    assert sorted(map(str, got.itertuples(index=False, name=None))) == sorted(map(str, want.itertuples(index=False, name=None)))


def test_jaccard(spark, docs, odd):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    rows = [(100 + k, " ".join(rng.choice(["x", "y", w]) if rng.random() < 0.03 else w for w in base[: 60 - k % 9])) for k in range(60)]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(d + 10000, t) for d, t in rows], "doc_id long, text string")).unionByName(spark.createDataFrame([(20001, ""), (20002, None), (20003, "a b"), (20004, "A  B"), (20005, "b a")], "doc_id long, text string"))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.link(df).collect()}
    assert got == jaccard_join.brute_force({r.doc_id: r.text for r in df.collect()})
    assert jaccard_join.link(odd).count() == len(ODD) and jaccard_join.link(odd.limit(0)).count() == 0
    assert jaccard_join.one_each(odd).columns == odd.columns


@pytest.mark.parametrize("sizes", [{"dense": 0}, {"dense": 4}, {"bucket_size": 1, "dense": 1}])
def test_jaccard_parts(spark, sizes):
    """Variants of one text, in lists longer than a tile's part, compared in the tiles' tasks or not; frequent shingles split over buckets."""
    texts = {}
    for i in range(60):
        words = [f"w{k}" for k in range(80)]
        for k in range(i % 7):
            words[(11 * i + 13 * k) % 80] = f"x{i % 9}-{k}"
        texts[i] = " ".join(words[: 80 - i % 5])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.link(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), part=4, **sizes).collect()}
    want = jaccard_join.brute_force(texts)
    assert len({c for _, c in want.values()}) > 2 and got == want


def test_jaccard_without_ids(spark):
    """A row without an id links others all the same; of each component one row stays, whatever the ids; unlinked texts of one id all stay."""
    w = [f"w{k}" for k in range(46)]
    a, n, b = " ".join(w[:40]), " ".join(w[3:43]), " ".join(w[6:46])  # a and n link, n and b do, a and b don't
    assert len({c for _, c in jaccard_join.brute_force({1: a, 3: b}).values()}) == 2
    rows = [(1, a, "x"), (None, n, "y"), (3, b, "z"), (7, "some other text of its own here", "u"), (7, "and one more that shares the id only", "v"), (7, "and one more that shares the id only", "v"), (None, "alone and without any id at all", "w"), (None, "alone and without any id at all", "w"), (8, "", "e"), (8, "", "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string")
    got = {(r.doc_id, r.component_id) for r in jaccard_join.link(df).collect()}
    assert got == {(1, 1), (None, 1), (3, 1), (7, 7), (None, None), (8, 8)}
    kept = sorted(r.row for r in jaccard_join.one_each(df).select("doc_id", "text", "row").collect())
    assert kept == sorted("xuvwee")


def test_cosine_of_any_size(spark):
    rows = [([3.0, 4.0, 0.5], [1.0, -2.0, 7.0])]
    want = np.dot(*rows[0]) / np.linalg.norm(rows[0][0]) / np.linalg.norm(rows[0][1])
    sizes = [(1.0, 1.0), (1e200, 1e200), (1e-200, 1e-200), (1e200, 1e-200), (1e300, 1.0)]
    df = spark.createDataFrame([([x * p for x in rows[0][0]], [x * q for x in rows[0][1]]) for p, q in sizes], "a array<double>, b array<double>")
    assert [r.c for r in df.select(nn_descent.cosine(F.col("a"), F.col("b")).alias("c")).collect()] == pytest.approx([want] * len(sizes), rel=1e-12)


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 99), (99, 98), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components.components(edges, scratch.folder(spark), "t").collect()}
    assert got == {**dict.fromkeys(range(41), 0), 98: 98, 99: 98, 100: 98}


def test_katz(spark, docs):
    from plumbmark.llm.labelled import fold

    got = katz_lm.score(docs, fold(F.col("doc_id"), 7) == 2).toPandas()
    text = {r.doc_id: words(r.text) + ["\0"] for r in docs.collect()}
    held = {k: zlib.crc32(str(k).encode()) % 7 == 2 for k in text}
    c = Counter(w for k in text if not held[k] for w in text[k])
    n, v = sum(c.values()), len(c)
    for r in got.itertuples():
        assert r.n_tokens == len(text[r.doc_id]) and r.n_known == sum(c[w] > 0 for w in text[r.doc_id]) and r.train_tokens == n and r.held_out == held[r.doc_id]
        assert r.base_score == pytest.approx(sum(np.log10((c[w] + 1) / (n + v + 1)) for w in text[r.doc_id]))
    own = got[got.held_out]
    assert own.score.sum() > own.base_score.sum()


def katz_by_hand(texts, held):
    """Scores of texts by id under the trigram model of those not held, with plain dictionaries."""
    text = {k: words(t) + ["\0"] for k, t in texts.items()}
    grams = [Counter(), Counter(), Counter()]
    for k, t in text.items():
        if not held[k]:
            t = ["\1", *t]
            grams[0].update(zip(t[1:]))
            grams[1].update(zip(t, t[1:]))
            grams[2].update(zip(t, t[1:], t[2:]))
    total, n_texts = sum(grams[0].values()), sum(not h for h in held.values())
    d = [katz_lm.discounts(Counter(g.values())) for g in grams]
    less = lambda o, r: (d[o][r - 1] if r <= 5 else 1.0) * r
    unknown = 1 - sum(less(0, r) for r in grams[0].values()) / (total + 1)
    size = lambda h: (n_texts if h == ("\1",) else grams[len(h) - 1][h]) if h else total
    after = [{}, {}, {}]
    for o in (1, 2):
        for g in grams[o]:
            after[o].setdefault(g[:-1], []).append(g)

    def p(g):
        o = len(g) - 1
        if grams[o][g]:
            return less(o, grams[o][g]) / (size(g[:-1]) + 1)
        if not o:
            return unknown
        seen = after[o].get(g[:-1], [])
        return (1 - sum(map(p, seen))) / (1 - sum(p(s[1:]) for s in seen)) * p(g[1:]) if seen else p(g[1:])

    p = functools.cache(p)
    return {k: sum(np.log10(p(tuple(["\1", *t][max(0, i - 1) : i + 2]))) for i in range(len(t))) for k, t in text.items()}


@pytest.mark.parametrize("bucket", [None, 1500])
def test_katz_whole(spark, docs, monkeypatch, bucket):
    """Rare words have bigrams and trigrams of their own, and histories split over buckets count as one."""
    from plumbmark.llm.labelled import fold

    if bucket:
        monkeypatch.setattr(katz_lm, "BUCKET", bucket)
    got = {r.doc_id: r.score for r in katz_lm.score(docs, fold(F.col("doc_id"), 7) == 2).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    want = katz_by_hand(texts, {k: zlib.crc32(str(k).encode()) % 7 == 2 for k in texts})
    assert got == pytest.approx(want, rel=1e-9)


def test_katz_adds_up(spark):
    """Over one-word texts, the probabilities of all known words and the unknown one after a history add up to 1."""
    train = [(i, t, False) for i, t in enumerate(["a b a c", "a b", "b b d e f", "", None, "a a a b c c"])]
    known = "a b c d e f".split()
    probe = [(100 + k, w, True) for k, w in enumerate([*known, "zzz"])]
    df = spark.createDataFrame(train + probe + [(200, "", True)], "doc_id long, text string, h boolean")
    got = {r.doc_id: r.score for r in katz_lm.score(df, F.col("h")).collect()}
    pairs = {r.doc_id: r.score for r in katz_lm.score(df.withColumn("text", F.when((F.col("doc_id") >= 100) & (F.col("doc_id") < 200), F.concat("text", F.lit(" a"))).otherwise(F.col("text"))), F.col("h")).collect()}
    assert all(np.isfinite(v) and v <= 0 for v in [*got.values(), *pairs.values()])
    # P(w END) over all w, and P(END) alone, are parts of one distribution: they stay below 1
    assert sum(10 ** got[100 + k] for k in range(7)) + 10 ** got[200] < 1
    assert katz_lm.score(df.limit(0), F.col("h")).count() == 0


def test_pii(spark, odd):
    texts = ["mail bob.x@ex-a.co.uk, +1 (377) 555-0271 (212) 555-0100 212-555-0100 4539578763621486 4539 5787 6362 1486 bad 4539578763621487", "97.51.17.173 bad 999.1.1.1 1.2.3.4.5 123-45-6789 bad 000-12-3456", "1984-02-29 bad 1985-02-29, 31/12/1999, 31.12.2001 GB82 WEST 1234 5698 7654 32 DE89370400440532013000 bad DE89370400440532013001", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"']
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    once = feistel_pii.scan(df)
    real = [p for r in once.collect() for p in r.pii if p.found != p.pseudonym]
    assert Counter(p.kind for p in real) == {"email": 1, "phone": 3, "card": 2, "ipv4": 1, "ssn": 1, "date": 3, "iban": 2, "secret": 1}
    assert all(len(p.found) == len(p.pseudonym) for p in real if p.kind not in ("email", "ipv4"))
    assert real[4].pseudonym == real[5].pseudonym.replace(" ", "")
    new = once.select("doc_id", feistel_pii.rebuilt(F.col("text"), F.col("pii")).alias("text"))
    back = feistel_pii.scan(new, back=True).withColumn("text", feistel_pii.rebuilt(F.col("text"), F.col("pii")))
    for r in back.collect():
        assert re.sub(r"\S+@\S+", "", r.text) == re.sub(r"\S+@\S+", "", texts[r.doc_id])
    assert feistel_pii.redact(odd).columns == odd.columns and feistel_pii.redact(odd.limit(0)).count() == 0
    assert sorted(map(str, feistel_pii.redact(odd).collect())) == sorted(map(str, odd.collect()))


def test_pii_key(spark):
    """Another key gives other pseudonyms; equal values under one key equal ones; a column called pii is kept."""
    df = spark.createDataFrame([(1, "call 212-555-0100 or 212-555-0100, 4539578763621486", 7)], "doc_id long, text string, pii int")
    one, two = (feistel_pii.redact(df, k).first() for k in ("key a", "key b"))
    assert one.text != two.text != df.first().text and one.pii == 7 and one.text == feistel_pii.redact(df, "key a").first().text
    assert len(set(re.findall(r"[0-9]{3}-[0-9]{3}-[0-9]{4}", one.text))) == 1


def test_roles_are_exact(spark):
    """Roles with line ends, backslashes in any number and control strings come back as they were."""
    roles = ["user", "a\nb", "a\\nb", "\\", "\\\\", "\\\n", "\\\\n", "\x00\x01", "<|im_end|>\n", "<\\|x", "", " "]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(roles)], "i int, role string")
    got = df.select("i", chat_format.unescape_role(chat_format.escape_role(F.col("role"))).alias("r"), chat_format.escape_role(F.col("role")).alias("e")).orderBy("i").collect()
    assert [r.r for r in got] == roles and not any("\n" in r.e or "<|" in r.e for r in got)


def test_toxicity_names_do_not_clash(spark, docs):
    """A column of documents called as the score is kept, whatever it holds."""
    model = text_cnn.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    own = docs.limit(20).withColumn("toxicity", F.lit(42.0)).withColumn("Toxicity_", F.lit("x"))
    got = text_cnn.reject(own, model)
    assert got.columns == own.columns and {(r.toxicity, r.Toxicity_) for r in got.collect()} == {(42.0, "x")}


def test_convolution_by_hand(spark):
    """The logits of the classifier, against a loop over words, taps and filters."""
    rng = np.random.default_rng(1)
    w = lambda *s: rng.normal(0, 1, s).astype(np.float32)
    k = text_cnn.FILTERS * len(text_cnn.WIDTHS)
    m = text_cnn.Model(w(50, text_cnn.CHANNELS), w(40, text_cnn.CHANNELS), {x: w(x, 2 * text_cnn.CHANNELS, text_cnn.FILTERS) for x in text_cnn.WIDTHS}, w(k), w(k), 0.3)
    sizes = [0, 1, 2, 7]
    word, stem, bounds = rng.integers(0, 50, 10), rng.integers(0, 40, 10), np.concatenate([[0], np.cumsum(sizes)])
    want = []
    for a, b in zip(bounds[:-1], bounds[1:]):
        e, hidden = [np.concatenate([m.word[word[i]], m.stem[stem[i]]]) for i in range(a, b)], []
        for width in text_cnn.WIDTHS:
            for f in range(text_cnn.FILTERS):
                hidden.append(max((sum(float(e[i + t] @ m.filters[width][t, :, f]) for t in range(width) if i + t < len(e)) for i in range(len(e))), default=0.0))
        want.append(np.maximum(np.array(hidden) + m.bias, 0) @ m.dense + m.offset)
    assert m.logits(word, stem, bounds, m.tables()) == pytest.approx(want, rel=1e-4)


def test_pii_luhn(spark):
    assert spark.range(1).select(feistel_pii.luhn_sum(F.lit("4539578763621486")).alias("s")).first().s % 10 == 0


def test_pipeline(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, SF)
    rows = out.collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    v = merge_replay.vocabulary(*merge_replay.public())
    assert 0 < len(rows) < len(docs) and len({r.doc_id for r in rows}) == len(rows)
    assert all(v.decode(r.ids) == r.text.encode() for r in rows)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near copies", "decontamination", "pseudonyms", "tokens"]
