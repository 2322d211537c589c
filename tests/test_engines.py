import math
import random

import pytest
from pyspark.sql import functions as F

from plumbmark import cli
from plumbmark.functions import text as X
from plumbmark.operators import audit, corpus, spatial, trust
from plumbmark.sources import drawings, parsed, vector_gen
from plumbmark.streaming import audit_stream

LICENSES = {
    "cc-by-sa-4.0": "CC-BY-SA", "CC-BY-SA-3.0": "CC-BY-SA", "cc-by-4.0": "CC-BY", "cc-by": "CC-BY", "cc-by-nc-2.0": "CC-BY-NC", "cc-by-nc-sa-4.0": "CC-BY-NC", "PD-old": "public", "pd-something-new": "public",
    "pd": "public", "publicdomain": "public", "Public-Domain": "public", "cc-zero": "public", "CC0": "public", "GFDL": None, "pdf": None, "pdf-license": None, "private": None, "CC BY-SA 4.0": None, "": None, None: None,
}


def test_license_and_text(spark):
    got = {r.raw: r.m for r in spark.createDataFrame([(k,) for k in LICENSES], "raw string").select("raw", X.map_license(F.col("raw")).alias("m")).collect()}
    assert got == LICENSES
    X.register(spark)
    assert spark.sql("SELECT map_license('cc0\\n')").first()[0] == "public"
    assert spark.sql("SELECT map_license('PD-old'), strip_tags('<b> x </b>')").first()[:] == ("public", "x")
    kinds = {"4200": "dimension_text", "12.5": "dimension_text", "거실": "room_label", "Meeting Room": "room_label", "": "other", "***": "other", "9": "other", "123456": "other", "A-1": "other", "x_y": "room_label", " 42": "dimension_text", "٤٢": "dimension_text", None: "other"}
    got = {r.t: r.k for r in spark.createDataFrame([(k,) for k in kinds], "t string").select("t", X.classify_text(F.col("t")).alias("k")).collect()}
    assert got == kinds
    names = {"File:House Plan (1893) - Foo.png": "house_plan_1893_-_foo", "***": "untitled", "a/b.c.svg": "b_c", "x" * 99: "x" * 80}
    got = {r.t: r.k for r in spark.createDataFrame([(k,) for k in names], "t string").select("t", X.safe_stem(F.col("t")).alias("k")).collect()}
    assert got == names


def _pair(a, b, p):
    def ang(s):
        return math.degrees(math.atan2(s[3] - s[1], s[2] - s[0])) % 180

    def size(s):
        return math.hypot(s[2] - s[0], s[3] - s[1])

    d = abs(ang(a) - ang(b))
    if min(d, 180 - d) > 3 or not size(a):
        return None
    mx, my = (b[0] + b[2]) / 2, (b[1] + b[3]) / 2
    gap = abs((a[3] - a[1]) * mx - (a[2] - a[0]) * my + a[2] * a[1] - a[3] * a[0]) / size(a)
    if not 3 <= gap <= 18 or not size(b):
        return None
    big, small = (b, a) if size(b) > size(a) else (a, b)
    t = sorted(((x - big[0]) * (big[2] - big[0]) + (y - big[1]) * (big[3] - big[1])) / size(big) for x, y in (small[:2], small[2:]))
    return gap if max(0.0, min(t[1], size(big)) - max(t[0], 0)) / size(small) >= 0.55 else None


def test_walls_by_brute_force(spark):
    rng = random.Random(4)
    lines = {}
    for drawing in range(3):
        for i in range(60):
            x, y, t = rng.randint(0, 200), rng.randint(0, 60), rng.choice([0, 1, 90, 91, 179]) * math.pi / 180
            n = rng.randint(0, 160)
            lines[drawing, i] = (float(x), float(y), round(x + n * math.cos(t)) * 1.0, round(y + n * math.sin(t)) * 1.0)
    df = spark.createDataFrame([(*k, *v) for k, v in lines.items()], "drawing_id int, line_idx int, x1 double, y1 double, x2 double, y2 double")
    got = {(r.drawing_id, r.line_a, r.line_b) for r in spatial.walls(df).collect()}
    want = set()
    for drawing in range(3):
        own = {i: lines[drawing, i] for i in range(60)}
        order, used = sorted(own, key=lambda i: -math.sqrt((own[i][2] - own[i][0]) ** 2 + (own[i][3] - own[i][1]) ** 2)), set()
        for a in order:
            if a in used:
                continue
            best = None
            for b in order:
                gap = None if b == a or b in used else _pair(own[a], own[b], None)
                if gap is not None and (best is None or gap < best[0] - 1e-12):
                    best = gap, b
            if best:
                used |= {a, best[1]}
                want.add((drawing, a, best[1]))
    assert got == want and want


def test_engine(spark):
    found = trust.analyse(**vector_gen.generate(spark, 5))
    docs = {r.drawing_id: r for r in found["document"].collect()}
    assert len(docs) == 5 and found["violations"].isEmpty()
    first = docs["synth_01001"]
    assert [o.object_id for o in first.objects] == [f"obj_{i + 1:04d}" for i in range(len(first.objects))]
    windows = first.aggregates.window_count
    assert windows.epistemic.tag == "⊬" and windows.epistemic.basis == windows.warning and windows.value == 2
    assert first.aggregates.wall_count.epistemic.tag == "⊨" and first.aggregates.wall_count.warning is None and found["aggregate_violations"].isEmpty()
    again = trust.from_json(trust.as_json(found["document"]).select("json"), found["document"].schema)
    assert sorted(map(str, again.collect())) == sorted(map(str, docs.values()))
    assert all(r.why.startswith("[door]") or r.why.startswith("[window]") for r in first.refusals) and first.refusals
    assert '"basis":null' in trust.as_json(found["document"]).first().json
    empty = trust.analyse(**{k: v.limit(0) for k, v in vector_gen.generate(spark, 1).items()})
    assert empty["document"].isEmpty()


def test_constraints(spark):
    df = spark.createDataFrame([("⊬", None, "g"), ("⊬", "", "g"), ("⊬", "b", None), ("⊥", "b", ""), ("⊢", None, None)], "tag string, basis string, gap string")
    assert [r.v for r in df.select(trust.mark_violations(F.struct("*")).alias("v")).collect()] == ["basis", "basis", None, "gap", None]
    with pytest.raises(Exception, match="contract violation: gap"):
        trust.strict(df.where("tag = '⊥'"), trust.mark_violations(F.struct("tag", "basis", "gap"))).collect()
    df = spark.createDataFrame([(True, None), (False, 1.5), (True, 1.0), (False, None)], "d boolean, s double")
    assert [r.v for r in df.select(trust.anchor_violation(F.col("d"), F.col("s")).alias("v")).collect()] == ["anchor", "anchor", None, None]
    assert spark.createDataFrame([('{"a":1,"z":2}',)], "j string").select(trust.unknown_fields(F.col("j"), ["a"]).alias("u")).first().u == ["z"]


def test_gate(spark):
    cases = [(0, "u", "gfdl", 200, 9000, "a"), (1, None, "cc0", 200, 9000, "a"), (2, "u", "cc0", 404, 0, "a"), (3, "u", "cc0", 200, 8191, "a"), (4, "u", "cc0", 200, 8192, "a"), (5, "u", "cc0", 200, 8192, "a"), (6, "u", "cc0", 200, 8192, "old")]
    df = spark.createDataFrame(cases, "pos int, url string, license_raw string, status int, n_bytes long, sha256 string")
    gated = corpus.first_of_hash(corpus.gate(df), spark.createDataFrame([("old",)], "sha256 string"))
    assert [r.stage for r in gated.orderBy("pos").collect()] == ["license_check", "url_check", "download", "size_check", None, "dedup", "dedup"]
    assert corpus.summary(gated.withColumn("source", F.lit("s"))).first().by_source == {"s": 1}


def test_warehouse(spark, tmp_path, capsys, monkeypatch):
    w = audit.Warehouse(spark, str(tmp_path / "w"))
    assert w.version() is None and w.init() == 1 and w.init() == 1
    run = spark.sql("SELECT 'r1' AS run_id, 'd' AS drawing_id, TIMESTAMP'2024-01-01 00:00:00' AS started_at UNION ALL SELECT 'r2', 'd', TIMESTAMP'2024-01-02 00:00:00'")
    w.begin(run)
    assert {r.exit_state for r in w.runs().collect()} == {"in_progress"}
    w.end(run.where("run_id = 'r1'").selectExpr("*", "started_at + INTERVAL '1500' SECOND AS completed_at", "'ValueError: boom' AS error_msg"))
    assert {r.run_id: (r.exit_state, r.duration_ms) for r in w.runs().collect()} == {"r1": ("FAILURE", 1500000), "r2": ("in_progress", None)}
    for seq, n in ((1, 3), (2, 5)):
        w.append("epistemic_counts", spark.createDataFrame([("r1", "s", "⊢", "type", n, seq)], "run_id string, stage string, tag string, field string, count long, seq long"))
    assert w.counts().first()["count"] == 5
    assert audit.show_run(w, "none") is None and set(audit.show_run(w, "r1")) == {"run", "events", "refusals", "fires", "counts"}
    monkeypatch.setattr(cli, "build_session", lambda *a: spark)
    assert cli.main(["--warehouse", str(tmp_path / "w"), "list-runs", "--limit", "1"]) == 0 and "r2" in capsys.readouterr().out
    assert cli.main(["--warehouse", str(tmp_path / "none"), "stats"]) == 1 and cli.main(["--warehouse", str(tmp_path / "w"), "show-run", "none"]) == 1
    w.append("schema_meta", spark.createDataFrame([("version", "999")], "key string, value string"))
    with pytest.raises(ValueError, match="downgrade"):
        w.init()


def test_stream(spark, tmp_path):
    w = audit.Warehouse(spark, str(tmp_path / "w"))
    w.init()
    w.append("stage_events", spark.sql("SELECT id AS event_seq, 'r' AS run_id, 'ocr' AS stage, 'INFO' AS level, TIMESTAMP'2024-01-01 00:00:00' + make_interval(0,0,0,0,id) AS timestamp FROM range(48)"))
    log = audit_stream.events(spark, f"{w.path}/stage_events")
    audit_stream.write(audit_stream.hourly(log).select("hour.start", "stage", "level", "cnt"), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).agg(F.sum("cnt")).first()[0] >= 40


def test_sources(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.PNG").write_bytes(b"x")
    (tmp_path / "in/b.svg").write_bytes(b"x")
    (tmp_path / "in/c.pdf").write_bytes(b"x")
    assert {r.drawing_id: r.error for r in drawings.ingest(spark, str(tmp_path / "in")).collect()} == {"a": None, "b": "unsupported: .svg", "c": None}
    ocr = spark.createDataFrame([("d", '{"res":{"rec_texts":["a","b"],"rec_scores":[0.5],"dt_polys":[[[1,2],[3,4]]]}}')], "drawing_id string, json string")
    assert [(r.text, len(r.quad), r.char_conf) for r in parsed.recognized_texts(ocr).collect()] == [("a", 2, 0.5), ("b", 0, 0.0)]
    body = '{"query":{"pages":{"1":{"title":"File:A.png","imageinfo":[{"url":"u","extmetadata":{"License":{"value":""},"LicenseShortName":{"value":"cc0"},"Artist":{"value":"<i>x</i>"}}}]},"2":{"title":"B"}}}}'
    got = parsed.media_candidates(spark.createDataFrame([(200, body), (404, body), (200, "bad")], "status int, body string")).orderBy("filename").collect()
    assert [(r.filename, r.license_raw, r.attribution) for r in got] == [("B", None, None), ("File:A.png", "cc0", "x")]


def test_matching_makes_no_pairs(spark):
    """Walls and windows equal the greedy choice among all pairs, and their plans have no join that would make these."""
    from pyspark.sql import functions as F

    rng = random.Random(8)
    rows = [(d, i, *[float(rng.randint(0, 240)) for _ in range(2)]) for d in "ab" for i in range(400)]
    rows = [(d, i, x, y, x + n * math.cos(t), y + n * math.sin(t)) for d, i, x, y in rows for n, t in [(rng.choice([0, 30, 60, 90]), rng.choice([0, 0.02, 0.8, 1.57, 3.13]))]]
    odd = [(None, 1, 0.0, 0.0, 90.0, 0.0), ("a", None, 0.0, 0.0, 90.0, 0.0), ("a", 900, None, 0.0, 90.0, 0.0), ("a", 901, float("nan"), 0.0, 90.0, 0.0), ("a", 902, float("inf"), 0.0, 90.0, 0.0), ("c", 1, 0.0, 0.0, 90.0, 0.0)]
    lines = spark.createDataFrame(rows + odd, "drawing_id string, line_idx int, x1 double, y1 double, x2 double, y2 double")
    wall = spatial.walls(lines.where("line_idx % 4 > 0"))
    want, used = [], set()
    edges = spatial.wall_edges(lines.where("line_idx % 4 > 0")).collect()
    for e in sorted(edges, key=lambda e: (e.drawing_id, -e.length_a, e.line_a, e.gap, -e.length_b, e.line_b)):
        if not {(e.drawing_id, e.line_a), (e.drawing_id, e.line_b)} & used:
            used |= {(e.drawing_id, e.line_a), (e.drawing_id, e.line_b)}
            want.append((e.drawing_id, sum(w[0] == e.drawing_id for w in want), e.line_a, e.line_b, e.gap, e.angle_gap))
    assert len(want) > 100 and sorted((r.drawing_id, r.wall_idx, r.line_a, r.line_b, r.thickness, r.angle_gap) for r in wall.collect()) == sorted(want)
    few, segs = wall.where("wall_idx < 6").cache(), lines.withColumnRenamed("line_idx", "seg_idx")
    pairs = spatial.window_edges(segs)
    on = {(r.drawing_id, r.seg_i, r.seg_j) for r in spatial.near_wall(pairs, few, "mid_x", "mid_y", F.lit(10.0)).collect()}
    want, used = [], set()
    for e in sorted(pairs.collect(), key=lambda e: (e.drawing_id, e.seg_i, e.seg_j)):
        if not {(e.drawing_id, e.seg_i), (e.drawing_id, e.seg_j)} & used:
            hit = (e.drawing_id, e.seg_i, e.seg_j) in on
            used |= {(e.drawing_id, e.seg_i), (e.drawing_id, e.seg_j)} if hit else set()
            want.append((e.drawing_id, e.seg_i, e.seg_j, e.gap, hit, e.i, e.j))
    got = spatial.windows(segs, few)
    assert {w[4] for w in want} == {True, False} and sorted((r.drawing_id, r.seg_i, r.seg_j, r.gap, r.accepted, r.i, r.j) for r in got.collect()) == sorted(want)
    assert "Join" not in wall._jdf.queryExecution().toString() + got._jdf.queryExecution().toString()


def test_unique_names_count_on_until_free(spark):
    from plumbmark.operators import corpus

    rows = spark.createDataFrame([(1, "a.png"), (2, "a.png"), (3, "a_2.png"), (4, "a.png"), (5, "b.png")], "pos int, filename string").selectExpr("pos", "filename", "'u' AS url", "'image/png' AS content_type")
    names = lambda df: [r.name for r in df.orderBy("pos").collect()]
    assert names(corpus.unique_names(rows)) == ["wm_a.png", "wm_a_2.png", "wm_a_2_2.png", "wm_a_3.png", "wm_b.png"]
    taken = spark.createDataFrame([("wm_b.png",), ("wm_a_3.png",)], "name string")
    assert names(corpus.unique_names(rows, taken=taken)) == ["wm_a.png", "wm_a_2.png", "wm_a_2_2.png", "wm_a_4.png", "wm_b_2.png"]


def test_names_that_depend_on_no_other_stay_apart(spark):
    """Only stems that can take each other's names are walked, and names are those of a walk over all."""
    from plumbmark.operators import corpus

    lone = spark.createDataFrame([(i, f"page {i}.png", "x") for i in range(300)] + [(300, "page 5.png", "x")], "pos int, filename string, body string").selectExpr("*", "'u' AS url", "'image/png' AS content_type")
    named = corpus.unique_names(lone)
    assert "InPandas" not in named._jdf.queryExecution().toString()  # no body goes to a worker, and no task gets all pages
    got = {r.pos: r.name for r in named.collect()}
    assert got[300] == "wm_page_5_2.png" and got[5] == "wm_page_5.png" and len(set(got.values())) == 301
    rng = random.Random(3)
    for case in range(6):
        files = [rng.choice(["a", "b"]) + "".join(f"_{rng.choice([1, 2, 2, 3, 4, '02', 9])}" for _ in range(rng.randint(0, 3))) for _ in range(rng.randint(1, 60))]
        old = [f"wm_{rng.choice(['a', 'a_2', 'a_3', 'b_2_2', 'c'])}.png" for _ in range(case % 3 * 2)]
        rows = spark.createDataFrame(list(enumerate(f"{f}.png" for f in files)), "pos int, filename string").selectExpr("*", "'u' AS url", "'image/png' AS content_type")
        have, want = set(old), []
        for f in files:
            n, name = 1, f"wm_{f}.png"
            while name in have:
                n, name = n + 1, f"wm_{f}_{n + 1}.png"
            have.add(name)
            want.append(name)
        taken = spark.createDataFrame([(x,) for x in old], "name string") if old else None
        assert [r.name for r in corpus.unique_names(rows, taken=taken).orderBy("pos").collect()] == want


def test_audit_emitters_write_json(spark, tmp_path):
    from pyspark.sql import functions as F

    from plumbmark.operators import audit

    w = audit.Warehouse(spark, str(tmp_path / "audit"))
    w.init()
    now = F.timestamp_seconds(F.lit(0)).alias("timestamp")
    one = spark.range(1).select(F.lit("r1").alias("run_id"), F.lit("ocr").alias("stage"), F.lit("INFO").alias("level"), F.lit("complete").alias("message"), now, F.struct(F.lit(3).alias("texts")).alias("payload"))
    w.emit(one)
    w.emit_errors(one.drop("payload", "level"))
    w.fire(spark.range(1).select(F.lit("r1").alias("run_id"), F.lit("Measurement_Policy").alias("policy_name"), now, F.struct(F.lit(2).alias("affected")).alias("detail")))
    w.refuse(spark.range(1).select(F.lit("r1").alias("run_id"), F.array(F.array(F.lit(10.0), F.lit(20.0))).alias("region"), F.lit("window").alias("attempted_type"), F.lit("no wall").alias("why"), now.alias("recorded_at")))
    assert {(r.level, r.payload_json) for r in w.read("stage_events").collect()} == {("INFO", '{"texts":3}'), ("ERROR", None)}
    assert [r.detail_json for r in w.read("policy_fires").collect()] == ['{"affected":2}']
    assert [r.region_json for r in w.read("refusals_log").collect()] == ["[[10.0,20.0]]"]
    none = audit.success_rate(w.runs()).first()
    assert (none.total, none.ok, none.rate, none.enough) == (0, 0, None, False)


def test_aggregates_are_bound_to_the_anchor(spark):
    agg = "struct<value:double,epistemic:struct<tag:string,evidence:array<struct<source:string,signal:string>>,basis:string,gap:string>,warning:string>"
    schema = f"drawing_id string, aggregates struct<wall_count:{agg},door_count:{agg},window_count:{agg},measured_wall_length_mm:{agg}>, scale_anchor struct<detected:boolean>"
    good, bare, none = (1.0, ("⊨", [], None, None), None), (1.0, ("⊬", [], "", None), "w"), (None, ("⊥", [], None, "g"), "w")
    rows = [("ok", (good, good, good, none), (False,)), ("value", (good, good, good, (12000.0, ("⊥", [], None, "g"), None)), (False,)), ("mark", (good, good, good, (None, ("⊨", [], None, None), None)), (False,)), ("basis", (bare, good, good, good), (True,))]
    got = {tuple(r) for r in trust.aggregate_violations(spark.createDataFrame(rows, schema)).collect()}
    assert got == {("value", "measured_wall_length_mm", "value without anchor"), ("mark", "measured_wall_length_mm", "mark without anchor"), ("basis", "wall_count", "basis")}


def test_audited_run(spark, tmp_path, monkeypatch):
    from plumbmark.operators import audited

    w, made = audit.Warehouse(spark, str(tmp_path / "w")), vector_gen.generate(spark, 3)
    made["texts"] = made["texts"].where("drawing_id <> 'synth_01002'")
    found = audited.run(w, made)
    run_of = {r.drawing_id: r.run_id for r in found["runs"].collect()}
    assert {(r.run_id, r.exit_state) for r in w.runs().collect()} == {(i, "SUCCESS") for i in run_of.values()}
    own = w.read("stage_events").where(F.col("run_id") == run_of["synth_01001"]).orderBy("event_seq").collect()
    assert [(e.stage, e.message) for e in own] == [(s, m) for s in audited.STAGES for m in (["starting", "scale_anchor: true", "complete"] if s == "compose" else ["starting", "complete"])]
    assert own[3].payload_json == '{"lines":10,"contours":2,"walls":5}'
    fire = w.read("policy_fires").collect()
    unknown = found["objects"].where("drawing_id = 'synth_01002'").count()
    assert [(r.run_id, r.policy_name) for r in fire] == [(run_of["synth_01002"], "Measurement_Policy")] and f'"mm_fields_refused":{unknown},' in fire[0].detail_json
    assert w.read("refusals_log").count() == found["refusals"].count() == 3
    assert w.counts().agg(F.sum("count")).first()[0] == 3 * found["objects"].count()
    monkeypatch.setattr(audited.trust, "analyse", lambda **_: (_ for _ in ()).throw(ValueError("boom")))
    with pytest.raises(ValueError, match="boom"):
        audited.run(w, made)
    assert {(r.exit_state, r.error_msg) for r in w.runs().where("exit_state <> 'SUCCESS'").collect()} == {("FAILURE", "ValueError: boom")}
    assert w.read("stage_events").where("level = 'ERROR'").count() == 3


def test_reports(spark):
    from plumbmark.operators import reports

    found = trust.analyse(**vector_gen.generate(spark, 1))
    drawn = reports.draw_commands(found["document"]).orderBy("z").collect()
    assert [r.z.layer for r in drawn] == sorted(r.z.layer for r in drawn) and drawn[0].color == [200, 0, 0] and {r["shape"] for r in drawn} == {"bbox", "polyline", "polygon"}
    grid = reports.object_grid(found["objects"]).orderBy("id").first()
    assert (grid.id, grid.type_tag, grid.measurement_mm == "—") == ("obj_0001", "🟢 ⊢ grounded", False)
    none = spark.createDataFrame([], "exit_state string")
    assert tuple(reports.overview(none, none, none).first()) == (0, 0, 0, 0, 0)
    at = spark.createDataFrame([(["a", "b"],), (["a"],), ([],), (["x", "y", "d"],)], "o array<string>").select(reports.default_index(F.col("o"), "d").alias("at"))
    assert [r.at for r in at.collect()] == [1, 0, 0, 2]


def test_crawl(spark, tmp_path):
    from plumbmark.operators import crawl

    cases = [(1, "File:A.png", "u1", "cc0"), (2, "File:A.png", "u2", "cc-by"), (3, "C.png", "u3", None), (4, "D.png", None, "cc0"), (5, "E.png", "u5", "cc0"), (6, "F.png", "u1", "cc0"), (7, "G.png", "u7", "cc0"), (8, "H.png", "u8", "cc0")]
    pick = spark.createDataFrame([(*c, None) for c in cases], "pos int, filename string, url string, license_raw string, source_page_url string")
    answers = spark.createDataFrame([("u1", 200, "image/png", bytearray(b"a" * 8192)), ("u2", 200, "image/jpeg", bytearray(b"b" * 9000)), ("u7", 200, "", bytearray(b"c")), ("u8", 200, "", bytearray(b"o" * 9000))], "url string, status int, content_type string, body binary")
    old = answers.where("url = 'u8'").select(F.sha2("body", 256).alias("sha256"))
    at = [str(tmp_path / n) for n in ("samples", "provenance", "summary")]
    refused = {r.filename: (r.stage, r.reason) for r in crawl.crawl(pick, answers, *at, history=old).collect()}
    assert refused == {
        "C.png": ("license_check", "license could not be mapped (raw: None)"), "D.png": ("url_check", "candidate has no URL"), "E.png": ("download", "HTTP 0"),
        "F.png": ("dedup", "duplicate sha256 (already in corpus)"), "G.png": ("size_check", "image too small (1 bytes < 8192)"), "H.png": ("dedup", "duplicate sha256 (already in corpus)"),
    }
    assert sorted(r.name for r in spark.read.parquet(at[0]).collect()) == ["wm_a.jpg", "wm_a.png"]
    assert {(r.license, r.original_uri) for r in drawings.provenance(spark, at[1]).collect()} == {("public", "u1"), ("CC-BY", "u2")}
    assert spark.read.json(at[2]).first().refused_by_dedup == 2


def test_primitives(spark, tmp_path):
    from plumbmark.sources import primitives

    made = vector_gen.generate(spark, 2)
    primitives.save({k: v for k, v in made.items() if k != "texts"}, str(tmp_path / "p"))
    back = primitives.load(spark, str(tmp_path / "p"))
    assert back["lines"].count() == made["lines"].count() and back["texts"].isEmpty()
    images = spark.createDataFrame([("ok", 2, 60, 3, bytearray(b"x")), ("low", 2, 49, 3, bytearray(b"x")), ("none", 0, 60, 3, None), ("bad", 2, 60, 3, bytearray(b"!"))], "drawing_id string, width int, height int, channels int, data binary")

    def make():
        def find(width, height, channels, data):
            if bytes(data) == b"!":
                raise ValueError("boom")
            return [(1.0, 2.0, 30.0), (3.0, 4.0, 40.0)]

        return find

    rows = primitives.detect(images, "circles", make, 50).collect()
    assert [(r.drawing_id, r.circle_idx, r.r) for r in rows if r.diagnostic is None] == [("ok", 0, 30.0), ("ok", 1, 40.0)]
    assert {r.drawing_id: r.diagnostic for r in rows if r.diagnostic} == {"low": "image too small (h=49<50)", "none": "empty input image", "bad": "ValueError: boom"}
    lost = drawings.ingest(spark, str(tmp_path / "nowhere")).first()
    assert lost.drawing_id == "nowhere" and lost.error.startswith("file not found")


def test_cli_runs_and_crawls(spark, tmp_path, capsys, monkeypatch):
    from plumbmark.sources import primitives

    monkeypatch.setattr(cli, "build_session", lambda *a: spark)
    primitives.save(vector_gen.generate(spark, 1), str(tmp_path / "p"))
    where = ["--warehouse", str(tmp_path / "w")]
    assert cli.main([*where, "run", str(tmp_path / "p")]) == 0 and "wall_structural" in capsys.readouterr().out
    assert cli.main([*where, "stats"]) == 0 and "policy_fires" in capsys.readouterr().out
    spark.createDataFrame([("c", i, "A.png", "u", "cc0", None) for i in (1, 2)], "category string, pos int, filename string, url string, license_raw string, source_page_url string").write.parquet(str(tmp_path / "c"))
    spark.createDataFrame([("u", 200, "image/png", bytearray(b"a" * 8192))], "url string, status int, content_type string, body binary").write.parquet(str(tmp_path / "r"))
    crawling = ["crawl", "--candidates", str(tmp_path / "c"), "--responses", str(tmp_path / "r"), "--samples-dir", str(tmp_path / "s"), "--provenance-dir", str(tmp_path / "v"), "--summary", str(tmp_path / "j"), "--categories", "c"]
    assert cli.main([*crawling, "--dry-run"]) == 0 and not (tmp_path / "s").exists() and "public" in capsys.readouterr().out
    assert cli.main(crawling) == 0 and capsys.readouterr().out.count("dedup") == 1
    assert cli.main(crawling) == 0 and capsys.readouterr().out.count("dedup") == 2
    assert drawings.provenance(spark, str(tmp_path / "v")).count() == 1
