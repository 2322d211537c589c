"""Operators and the pipeline's stages against plain Python, and on odd rows with clashing columns."""

import base64
import hashlib
import math
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from plumbmark.llm import feistel_pii, hash_tree, jaccard_join, merge_replay, rule_quality, text_cnn
from plumbmark.session import table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents")


def test_rules_by_hand(spark, docs):
    """The compiled score of each text, against its rules tried one by one; columns named like statistics stay as they are."""
    model = rule_quality.train(docs, table(spark, SF, "labels"))
    assert model.rules and model.linear
    want = {}
    for r in rule_quality.with_statistics(docs.select("doc_id", "text")).collect():
        x = [r[s] for s in rule_quality.STATISTICS]
        z = model.offset + sum(w for rule, w in zip(model.rules, model.weights) if all(x[j] <= v if at_most else x[j] > v for j, v, at_most in rule))
        z += sum((min(max(x[j], low), high) - low) / (high - low) * w for j, low, high, w in model.linear)
        want[r.doc_id] = 1 / (1 + math.exp(-z))
    clash = docs.select("doc_id", "text", *[F.lit(7.5).alias(s) for s in rule_quality.STATISTICS])
    got = rule_quality.score(clash, model).collect()
    assert {r.doc_id: r.quality for r in got} == pytest.approx(want, rel=1e-9)
    assert all(r[s] == 7.5 for r in got for s in rule_quality.STATISTICS)


def descend(key, tree):
    def draw(tag, weights):
        def straw(i):
            h = 42
            for part in (key.encode(), tag.encode(), i.to_bytes(4, "little")):
                h = xxhash.xxh64_intdigest(part, seed=h)
            return math.log(((h >> 12) + 0.5) / 2**52) / weights[i] if weights[i] > 0 else -math.inf

        return max(range(len(weights)), key=lambda i: (straw(i), -i))

    racks = [[sum(rack) for rack in region] for region in tree]
    g = draw("region", [sum(r) for r in racks])
    r = draw(f"rack/{g}", racks[g])
    s = draw(f"shard/{g}/{r}", tree[g][r])
    return sum(len(rack) for region in tree[:g] for rack in region) + sum(map(len, tree[g][:r])) + s


def test_tree_by_hand(docs):
    uneven = hash_tree.Tree.of(40).with_weight(0, 1, 2, 3.0).with_weight(1, 0, 0, 0.0)
    got = hash_tree.assign(docs, uneven, hash_tree.Tree.of(41)).collect()
    assert len(got) == docs.count()
    for r in got:
        assert (r.shard, r.grown_shard) == (descend(str(r.doc_id), uneven.weights), descend(str(r.doc_id), hash_tree.Tree.of(41).weights))


def feistel(left, right, a, b, kind, key):
    h = lambda i, half, below: int(hashlib.sha256("\n".join([key, kind, str(i), str(half), key]).encode()).hexdigest()[:15], 16) % below
    for i in range(feistel_pii.ROUNDS):
        left, right = (left, (right + h(i, left, b)) % b) if i % 2 else ((left + h(i, right, a)) % a, right)
    return left, right


def feistel_digits(d, kind, key):
    n, half = len(d), len(d) // 2
    left, right = feistel(int(d[:half]), int(d[half:]), 10**half, 10 ** (n - half), f"{kind}/{n}", key)
    return f"{left:0{half}d}{right:0{n - half}d}"


def test_feistel_by_hand(spark):
    key, ssn, card, ip, day = "a key", "123-45-6789", "4539578763621486", "97.51.17.173", "1984-02-29"
    d = feistel_digits(ssn.replace("-", ""), "ssn", key)
    body = feistel_digits(card[:-1], "card", key)
    check = next(c for c in "0123456789" if sum(sum(divmod(int(x) * (1 + i % 2), 10)) for i, x in enumerate(reversed(body + c))) % 10 == 0)
    a, b = feistel(97 * 256 + 51, 17 * 256 + 173, 65536, 65536, "ipv4", key)
    first = np.datetime64("1800-01-01")
    n = int((np.datetime64(day) - first).astype(int))
    q, r = feistel(n // 773, n % 773, 189, 773, "date/ymd", key)
    want = [f"{d[:3]}-{d[3:5]}-{d[5:]}", body + check, f"{a >> 8}.{a & 255}.{b >> 8}.{b & 255}", str(first + (q * 773 + r))]
    df = spark.createDataFrame([(1, f"x {ssn} y {card}, {ip} on {day}")], "doc_id long, text string")
    assert feistel_pii.redact(df, key).first().text == "x {} y {}, {} on {}".format(*want)


def item_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_stages(spark, docs):
    """Each stage on its own input: it keeps just the rows that a plain version keeps, and makes the texts and ids that it makes."""
    import tiktoken

    stages, at = dict(corpus_pipeline.STAGES), lambda df: {r.doc_id: r for r in df.collect()}
    model, before = text_cnn.train(docs, table(spark, SF, "labels")), at(docs)
    score = {r.doc_id: r.toxicity for r in text_cnn.score(docs, model).collect()}
    step = spark.createDataFrame(stages["toxicity"](spark, docs, SF).collect(), docs.schema)
    assert set(at(step)) == {k for k, r in before.items() if score[k] < model.thresholds.get(r.lang, text_cnn.CUT)} and 0 < len(at(step)) < len(before)

    before = at(step)
    step = spark.createDataFrame(stages["near copies"](spark, step, SF).collect(), docs.schema)
    groups = jaccard_join.brute_force({k: r.text for k, r in before.items()})
    assert at(step) == {k: r for k, r in before.items() if groups[k][1] in (k, None)} and 0 < len(at(step)) < len(before)

    before = at(step)
    windows = {tuple(w[i : i + 10]) for w in (item_words(r.text) for r in table(spark, SF, "benchmark").collect()) if w for i in range(max(len(w) - 9, 1))}
    lengths = {len(w) for w in windows}
    hit = lambda w: any(tuple(w[i : i + n]) in windows for n in lengths for i in range(len(w) - n + 1))
    step = spark.createDataFrame(stages["decontamination"](spark, step, SF).collect(), docs.schema)
    assert at(step) == {k: r for k, r in before.items() if not hit(item_words(r.text))} and 0 < len(at(step)) < len(before)

    before = at(step)
    step = spark.createDataFrame(stages["pseudonyms"](spark, step, SF).collect(), docs.schema)
    pii = {r.doc_id: r for r in feistel_pii.scan(spark.createDataFrame(list(before.values()), docs.schema)).collect()}
    for k, r in at(step).items():
        new = before[k].text
        parts, end = [], 0
        for p in pii[k].pii:
            start = new.index(p.found, end)
            parts += [new[end:start], p.pseudonym]
            end = start + len(p.found)
        assert r.text == "".join([*parts, new[end:]])
    assert set(at(step)) == set(before) and any(r.text != before[k].text for k, r in at(step).items())

    path, pattern = merge_replay.public()
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}, special_tokens={})
    last = stages["tokens"](spark, step, SF).collect()
    assert len(last) == step.count() and all(list(r.ids) == enc.encode_ordinary(r.text or "") for r in last)


VERY_LONG = " ".join(f"w{i % 70001}" for i in range(400_000))  # 2.6 MB
ROWS = [(1, None, "en"), (2, "", None), (3, " \n", "xx"), (4, "one", "en"), (4, "one", "en"), (None, "a row of no id at all", "en"), (5, VERY_LONG, "en"), (6, VERY_LONG + " end", "en")]
KEPT = {"near copies": 6}  # of the two long texts, which are near copies, one; of the row that repeats, one


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_odd(spark, name):
    """Nulls, empty, repeated and very long texts, names that clash, and no rows at all: clean rows stay, with their columns."""
    stage = dict(corpus_pipeline.STAGES)[name]
    names = ["toxicity", "pii", "_key", "hit", "text_hash", "node", "label", "n_words", "_place"]
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string").select("*", *[F.lit(f"own {n}").alias(n) for n in names])
    got = stage(spark, df, SF)
    assert got.columns[: len(df.columns)] == df.columns
    rows = got.collect()
    assert all(r[n] == f"own {n}" for r in rows for n in names)
    assert len(rows) == KEPT.get(name, len(ROWS))
    assert stage(spark, df.limit(0), SF).count() == 0
