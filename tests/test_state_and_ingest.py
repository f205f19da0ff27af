import json
import os

import pytest
from pyspark.sql import functions as F

from frameledger import session
from frameledger.functions import sampling
from frameledger.operators import prepare, state
from frameledger.plans import bundles
from frameledger.session import first_delivery, utc_month
from frameledger.sources import annotations as ann
from frameledger.sources import media
from frameledger.streaming import resume


def write_dataset(root):
    base = root / "Sport" / "Event"
    (base / "mot").mkdir(parents=True)
    doc = {"sport": "Sport", "event": "Event", "video_id": "1", "info": "1.mp4", "video_metadata": {"duration_sec": 50.0, "fps": 10, "total_frames": 500, "resolution": [1920, 1080]}, "annotations": [
        {"annotation_id": "1", "task_L1": "U", "task_L2": "Scoreboard_Single", "timestamp_frame": 10, "question": "score?", "answer": "2-1", "bounding_box": [10, 20, 200, 80]},
        {"annotation_id": "2", "task_L1": "U", "task_L2": "Continuous_Actions_Caption", "Q_window_frame": [150, 100], "A_window_frame": ["100-120", "121-150"], "answer": ["a", "b"], "question": "what?", "tracking_bboxes": "./dataset/Sport/Event/mot/1_2.txt"},
        {"annotation_id": "3", "task_L1": "U", "task_L2": "Spatial_Temporal_Grounding", "A_window_frame": [200, 220], "query": "find", "tracking_bboxes": "data/Sport/Event/mot/1_2.txt"},
        {"annotation_id": "4", "task_L1": "R", "task_L2": "Spatial_Imagination", "Q_window_frame": [100, 150], "question": "where?", "answer": "left", "upstream_annotation_id": "2"},
        {"annotation_id": "5", "task_L1": "U", "task_L2": "Commentary"},
        {"task_L1": "R", "task_L2": "Spatial_Imagination", "upstream_annotation_id": "1"},
    ]}
    (base / "1.json").write_text(json.dumps(doc))
    (base / "1.mp4").write_bytes(b"x")
    (base / "2.json").write_text("{}")  # no video beside it
    (base / "3.json").write_text("{broken")
    (base / "3.mp4").write_bytes(b"x")
    (base / "mot" / "1_2.txt").write_text("".join(f"{f},1,{f}.5,10,50,60,-1,-1,-1,-1\n\n" for f in range(100, 151, 5)) + "oops\n")


def test_ingest(spark, tmp_path):
    write_dataset(tmp_path)
    root = str(tmp_path)
    assert {r["video_key"] for r in ann.annotation_files(spark, root).collect()} == {"Sport/Event/1", "Sport/Event/3"}
    docs = ann.annotation_documents(spark, root)
    assert docs.where("broken is not null").count() == 1
    a = ann.explode_annotations(docs)
    s = a.withColumns({"q_window": ann.q_window(F.col("q_window_frame")), "a_window": F.when(F.col("task_name") == "Spatial_Temporal_Grounding", ann.grounding_window(F.col("a_window_frame")))})
    assert s.count() == 6 and ann.unsupported(s).count() == 1
    rows = {r["sample_id"]: r for r in s.collect()}
    assert tuple(rows["Sport/Event/1#2"]["q_window"]) == (100, 150) and tuple(rows["Sport/Event/1#3"]["a_window"]) == (200, 220)
    sup = ann.supported(s)
    assert {(r["sample_id"], r["rule"]) for r in ann.structure_issues(sup).collect()} == {("Sport/Event/1#<missing>", "q_window")}
    assert {(r["sample_id"], r["rule"]) for r in ann.upstream_issues(sup).collect()} == {("Sport/Event/1#<missing>", "upstream_task")}
    assert {r["pair_id"] for r in ann.chain_pairs(sup.where("annotation_id is not null")).collect()} == {"Sport/Event/1#4|Sport/Event/1#2"}
    seg = a.where("task_name = 'Continuous_Actions_Caption'").select(ann.segments(F.col("a_window_frame"), F.col("answer")).alias("s")).first()["s"]
    assert [(x["start_frame"], x["end_frame"], x["text"]) for x in seg] == [(100, 120, "a"), (121, 150, "b")]
    t = ann.tracking_rows(spark, root)
    assert t.count() == 11
    prepare.with_frames(sup, sampling.PROTOCOLS["main"]).write.partitionBy("protocol_id").parquet(str(tmp_path / "prepared"))
    framed = spark.read.parquet(str(tmp_path / "prepared"))
    two = framed.where("annotation_id = '2'").withColumns({"tracking_path": ann.resolve_path(F.col("tracking_bboxes")), "width": F.get("resolution", F.lit(0)), "height": F.get("resolution", F.lit(1)), "valid": F.lit(None).cast("struct<start:bigint,end:bigint>")})
    aligned = prepare.align_tracking(two, t.select("tracking_path", F.col("frame").alias("frame_original"), "box_left", "box_top", "box_width", "box_height", F.lit(0).alias("ord"))).orderBy("frame_sampled").collect()
    assert [r["frame_original"] for r in aligned] == list(range(100, 151, 5)) and aligned[0]["frame_sampled"] == 20
    assert tuple(two.first()["q_window_sampled"]) == (20, 30)
    assert abs(aligned[0]["bbox_mot"][0] - 100.5 * 1000 / 1920) < 1e-9


def test_templates(spark, tmp_path):
    (tmp_path / "AI_Coach.md").write_text("Coach {{ question }}")
    assert ann.template_pack(spark, str(tmp_path), {"question"}, ["AI_Coach"]) == {"AI_Coach": "Coach {{ question }}"}
    for allowed, tasks in (({"other"}, ["AI_Coach"]), ({"question"}, ["AI_Coach", "Score_Prediction"])):
        try:
            ann.template_pack(spark, str(tmp_path), allowed, tasks)
            raise AssertionError
        except ValueError:
            pass


def test_last_wins_and_pending(spark):
    art = spark.createDataFrame([("a", "x", 1), ("a", None, 3), ("a", "y", 2), ("b", None, 1), (None, "z", 1)], "sample_id string, raw_output string, line_no int")
    got = {r["sample_id"]: r["raw_output"] for r in state.last_wins(art, "sample_id", ["line_no"], "raw_output").collect()}
    assert got == {"a": "y", None: "z"}
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "sample_id string")
    p = {r["sample_id"]: r["stage"] for r in state.pending(ids("a", "b", "c", "d", "a"), ids("b", "c", "d"), ids("c", "d"), ids("d")).collect()}
    assert p == {"a": "predict", "b": "structure", "c": "evaluate"}
    assert state.last_wins(art.limit(0), "sample_id", ["line_no"], "raw_output").count() == 0


def test_resumed_stream_repeats_nothing(spark, tmp_path):
    src, done, ck = str(tmp_path / "in"), str(tmp_path / "done"), str(tmp_path / "ck")
    os.makedirs(src)
    stage = lambda df: df.select("sample_id", F.upper("raw_output").alias("out"))

    def feed(name, rows):
        with open(f"{src}/{name}.json", "w") as f:
            f.writelines(json.dumps({"sample_id": i, "raw_output": r}) + "\n" for i, r in rows)

    def go():
        resume.run_stage(resume.artifact_stream(spark, src, "sample_id string, raw_output string"), stage, done, ck).awaitTermination()
        return sorted((r["sample_id"], r["out"]) for r in spark.read.parquet(done).collect())

    feed("one", [("a", "x"), ("b", "y")])
    assert go() == [("a", "X"), ("b", "Y")]
    feed("two", [("b", "again"), ("c", "z")])
    assert go() == [("a", "X"), ("b", "Y"), ("c", "Z")]
    assert go() == [("a", "X"), ("b", "Y"), ("c", "Z")]


def test_first_delivery(spark):
    df = spark.sql("select * from values (1, 'late', timestamp'2025-03-01 00:30:00'), (1, 'first', timestamp'2025-02-28 23:30:00'), (2, 'none', cast(null as timestamp)) t(id, v, ts)")
    got = {r["id"]: (r["v"], r["m"]) for r in first_delivery(df, "id", "ts").withColumn("m", utc_month("ts")).collect()}
    assert got == {1: ("first", "2025-02"), 2: ("none", None)}


SAMPLE = "sample_id string, annotation_id string, video_key string, task_name string, timestamp_frame long, q_window struct<start:bigint,end:bigint>, a_window struct<start:bigint,end:bigint>, a_window_frame string, answer string, question string, query string, bounding_box string, tracking_bboxes string, upstream_annotation_id string, fps int, total_frames long, resolution array<int>"


def dataset(spark):
    rows = [
        ("v#1", "1", "v", "Scoreboard_Single", 10, None, None, None, '"2-1"', "score?", None, "[192, 108, 384, 216]", None, None, 10, 500, [1920, 1080]),
        ("v#2", "2", "v", "Continuous_Actions_Caption", None, (100, 150), None, '["100-120", "121-150"]', '["a", "b"]', "what?", None, None, "./data/t.txt", None, 10, 500, [1920, 1080]),
        ("v#3", "3", "v", "Spatial_Temporal_Grounding", None, None, (200, 220), "[200, 220]", None, None, "where?", None, "t.txt", None, 10, 500, [1920, 1080]),
        ("v#4", "4", "v", "Spatial_Imagination", None, (100, 150), None, None, '"left"', "path?", None, None, None, "2", 10, 500, [1920, 1080]),
        ("v#5", "5", "v", "Commentary", None, None, None, None, None, None, None, None, None, None, 10, 500, [1920, 1080]),
    ]
    track = [("t.txt", f, f, 192.0, 108.0, 19.2, 10.8) for f in range(100, 230, 5)] + [("t.txt", 100, 999, 384.0, 108.0, 19.2, 10.8)]
    return spark.createDataFrame(rows, SAMPLE), spark.createDataFrame(track, "tracking_path string, frame_original long, ord long, box_left double, box_top double, box_width double, box_height double")


def test_bundles(spark, tmp_path):
    samples, tracking = dataset(spark)
    samples = samples.withColumn("seq", F.col("annotation_id").cast("int"))
    none = ann.structure_issues(samples).limit(0)
    out = str(tmp_path / "prepared")
    done = bundles.build(spark, samples, tracking, none, ["main", "uniform8"], out, ["frames", "sampled_video"], True)
    assert [(d["protocol_id"], d["num_prepared_samples"]) for d in done] == [("main", 4), ("uniform8", 4)]
    rows = {r["sample_id"]: r for r in bundles.load(spark, out, "main").collect()}
    assert rows["v#1"]["reference_payload"]["bbox"] == [100.0, 100.0, 200.0, 200.0] and rows["v#1"]["reference_payload"]["text"] == "2-1"
    two = rows["v#2"]["reference_payload"]
    assert rows["v#2"]["sampled_frames_original"] == list(range(0, 151, 5)) and tuple(rows["v#2"]["q_window_sampled"]) == (20, 30)
    assert [tuple(s) for s in two["segments_sampled"]] == [(20, 24, "a"), (25, 30, "b")]
    assert len(two["tracking_gt_sampled"]) == 11 and two["tracking_gt_sampled"][0]["bbox_mot"] == [200.0, 100.0, 10.0, 10.0]  # the last reading of a frame
    three = rows["v#3"]["reference_payload"]
    assert all(200 <= t["frame_original"] <= 220 for t in three["tracking_gt_sampled"]) and len(three["time_window_sampled"]) == 2
    index = spark.read.json(f"{out}/main/index").collect()
    assert [r["sample_id"] for r in index] == sorted(rows)
    with pytest.raises(ValueError, match="same protocol id"):
        bundles.build(spark, samples, tracking, none, ["main", "frameledger.functions.sampling:Main"], out)
    with pytest.raises(ValueError, match="both formats"):
        bundles.build(spark, samples, tracking, none, ["main"], out, ["frames"], True)
    with pytest.raises(ValueError, match="1 issues"):
        bundles.build(spark, samples, tracking, ann.missing_file_issues(ann.supported(samples), samples, tracking.limit(0).select(F.col("tracking_path").alias("path"))).limit(1), ["main"], out)
    with pytest.raises(ValueError, match="protocol_spec"):
        bundles.load(spark, out, "frameledger.functions.sampling:Main")
    manifest = bundles._read_json(spark, f"{out}/main/build_manifest")
    for name, value in (("protocol_manifest", {}), ("coordinate_system", "pixels"), ("protocol_id", "x")):
        bundles._write_json(spark, manifest | {name: value}, f"{out}/main/build_manifest")
        with pytest.raises(ValueError, match=name):
            bundles.load(spark, out, "main")
    assert bundles.write_chain_pairs(samples, none, f"{out}/pairs") == 1
    assert spark.read.json(f"{out}/pairs").first()["pair_id"] == "v#4|v#2"
    assert manifest["data_status"]["ignored_unsupported_task_counts"] == {"Commentary": 1}


def test_load_and_file_issues(spark):
    samples, _ = dataset(spark)
    bad = samples.where("annotation_id in ('1', '2')").withColumns({"bounding_box": F.lit('["x"]'), "answer": F.lit('["a"]')})
    assert {(r["sample_id"], r["message"].split(": ")[-1]) for r in ann.load_issues(bad).collect()} == {("v#1", "no numeric bounding box"), ("v#2", "interval and text counts differ")}
    assert ann.load_issues(ann.supported(samples)).count() == 0
    files = spark.createDataFrame([("t.txt",), ("data/x.txt",)], "path string")
    raw = spark.createDataFrame([(1, "./data/t.txt"), (2, "data/x.txt"), (3, " "), (4, "./gone.txt"), (5, None)], "row_id int, raw string")
    got = {r["row_id"]: (r["path"], r["exists"]) for r in ann.first_existing(raw, "raw", files, "row_id").collect()}
    assert got == {1: ("t.txt", True), 2: ("data/x.txt", True), 3: (None, None), 4: ("gone.txt", False), 5: (None, None)}
    gone = ann.missing_file_issues(samples, samples.limit(0), files.limit(0))
    assert {r["rule"] for r in gone.collect()} == {"video", "tracking"}


def test_broken_documents_are_reported_not_dropped(spark, tmp_path):
    write_dataset(tmp_path)
    (tmp_path / "Sport" / "Event" / "2.json").write_text("{nonsense")
    (tmp_path / "Sport" / "Event" / "2.mp4").write_text("x")
    docs = ann.annotation_documents(spark, str(tmp_path))
    bad = ann.broken_documents(docs).collect()
    assert sorted(r["path"][-6:] for r in bad) == ["2.json", "3.json"] and docs.count() == 3
    assert all(r["message"].endswith(".json: failed to load annotation file") for r in bad)


def test_media_need_their_package(spark):
    samples, tracking = dataset(spark)
    rows = bundles.prepared_samples(samples, tracking, sampling.PROTOCOLS["main"])
    with pytest.raises(Exception, match="needs the package 'av'"):
        media.write_bundles(rows, "/nowhere", "/nowhere", ["frames"]).collect()
    with pytest.raises(ValueError):
        media.write_bundles(rows, "/nowhere", "/nowhere", ["gif"])


def test_fingerprint_knows_values_not_order(spark):
    df = spark.createDataFrame([(i, str(i % 7), None) for i in range(200)], "b int, a string, c string")
    one = ann.dataset_fingerprint(df).first()
    assert one["n"] == 200 and ann.dataset_fingerprint(df.select("c", "a", "b").repartition(7)).first() == one
    assert ann.dataset_fingerprint(df.where("b > 0")).first() != one


def test_compaction_keeps_the_last_of_each(spark, tmp_path):
    path = str(tmp_path / "a")
    spark.createDataFrame([("b", "x", 1), ("a", "y", 1), ("b", "z", 2), ("b", None, 3)], "k string, v string, n int").write.parquet(path)
    assert [tuple(r) for r in spark.read.parquet(state.compact(spark, path, "k", ["n"], "v")).collect()] == [("a", "y", 1), ("b", "z", 2)]


def test_session_needs_a_shared_folder():
    class Context:
        master = "spark://cluster:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError):
        session.ensure_checkpoint_dir(Session())


def test_late_counts(spark, tmp_path):
    src = tmp_path / "events"
    src.mkdir()
    (src / "a.json").write_text("".join(json.dumps({"ts": f"2025-01-01 0{h}:10:00", "k": "x"}) + "\n" for h in (1, 1, 2)))
    stream = spark.readStream.schema("ts timestamp, k string").json(str(src))
    q = resume.late_counts(stream, "ts", "k").writeStream.format("memory").queryName("late").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r["start"].hour, r["k"], r["n"]) for r in spark.table("late").collect()) == [(1, "x", 2), (2, "x", 1)]


def test_joins_with_a_small_side(spark, monkeypatch):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else "cold") for i in range(90)] + [(90, None), (91, "none")], "id int, k string")
    small = spark.createDataFrame([("hot", 1), ("cold", 2)], "k string, v int")
    want = sorted((r["id"], r["v"]) for r in rows.join(small, "k", "left").collect())
    for most in (10, 0):
        got = session.small_join(rows, small, ["k"], "id", "left", most=most).collect()
        assert sorted((r["id"], r["v"]) for r in got) == want


@pytest.mark.parametrize("most", [100, 0])
def test_deliveries(spark, most):
    df = spark.sql("select * from values (1, 'late', timestamp'2025-03-01'), (1, 'first', timestamp'2025-02-01'), (2, 'none', cast(null as timestamp)), (cast(null as int), 'a', timestamp'2025-03-01'), (cast(null as int), 'b', timestamp'2025-02-01'), (3, 'same', timestamp'2025-02-01'), (3, 'same', timestamp'2025-02-01') t(id, v, ts)")
    assert sorted((str(r["id"]), r["v"]) for r in session.deliveries(df, "id", "ts", most).collect()) == [("1", "first"), ("2", "none"), ("3", "same"), ("None", "b")]
    assert session.deliveries(df.limit(0), "id", "ts").count() == 0
