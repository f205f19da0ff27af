import json
import sys

import pytest
from pyspark.sql import functions as F

from frameledger.operators import evaluate, predict, structure
from frameledger.plans import pipeline, run_eval
from frameledger.sources import media
from pyspark.cloudpickle import register_pickle_by_value
from test_evaluation import prepared

register_pickle_by_value(sys.modules[__name__])  # the classes below go to the workers as they are

PAIR = "pair_id string, video_key string, upstream_sample_id string, downstream_sample_id string, upstream_task_name string"


def test_run_and_resume(spark, tmp_path):
    p = prepared(spark)
    pairs = spark.createDataFrame([("d|b", "v", "b", "d", "Continuous_Actions_Caption")], PAIR)
    out = str(tmp_path / "run")
    s = run_eval.run(spark, p, out, pairs=pairs)
    assert s == {"overall": 1.0, "num_tasks": 5, "blocked": 0, "pending": {}}
    n = spark.read.parquet(f"{out}/predictions").count()
    assert run_eval.run(spark, p, out, pairs=pairs) == s
    assert spark.read.parquet(f"{out}/predictions").count() == n == 5


def test_failed_rows_are_tried_again(spark, tmp_path):
    class Broken(predict.Adapter):
        def predict(self, sample):
            if sample["sample_id"] == "b":
                raise OSError("no answer")
            return {"text": "x", "bbox": [1, 2, 30, 40], "time_window_sampled": [], "tracking": [], "objects": []}

    p = prepared(spark)
    pairs = spark.createDataFrame([("d|b", "v", "b", "d", "Continuous_Actions_Caption")], PAIR)
    out = str(tmp_path / "run")
    s = run_eval.run(spark, p, out, Broken(), predict.StaticJudge(1), pairs)
    assert s["blocked"] == 1 and s["pending"] == {"predict": 2}
    assert spark.read.parquet(f"{out}/predictions").where("error is not null").count() == 1
    s = run_eval.run(spark, p, out, None, predict.StaticJudge(1), pairs)  # now with answers
    assert s["blocked"] == 0 and s["pending"] == {}


class Talker(predict.Adapter):
    """Answers by task and keeps what it was asked in its answer's text."""

    def __init__(self, broken=()):
        self.broken = broken

    def predict(self, sample):
        if sample["sample_id"] in self.broken:
            raise OSError("no answer")
        asked = " | ".join(f"{m['role']}={m['content']}" for m in sample["messages"])
        track = [{"frame_sampled": i, "bbox_mot": [1, 2, 30, 40]} for i in range(3)]
        files = sample.get("frame_files")
        return {"text": f"{asked}{files or ''}", "bbox": [1, 2, 30, 40], "objects": [], "segments": [{"start_sampled": 0, "end_sampled": 2, "text": asked}], "time_window_sampled": [0, 2], "tracking": track}


class Picky(predict.Judge):
    """Fails on some rows, and asks for its prompt."""

    def __init__(self, broken=(), malformed=()):
        self.broken, self.malformed = broken, malformed

    def respond(self, row):
        if row["sample_id"] in self.broken:
            raise OSError("judge down")
        if row["sample_id"] in self.malformed:
            return '{"correctness": "0.5"}'
        assert row["prompt"]
        return predict.StaticJudge(1).respond(row)


def test_a_failed_judge_call_is_pending_and_asked_again(spark, tmp_path):
    p, out = prepared(spark), str(tmp_path / "run")
    s = run_eval.run(spark, p, out, None, Picky(broken=("a",), malformed=("d",)))
    assert s["pending"] == {"evaluate": 2} and s["overall"] == 1.0
    errors = {r["sample_id"]: r["error"] for r in spark.read.parquet(f"{out}/decisions").where("decision is null").collect()}
    assert errors["a"].startswith("OSError") and errors["d"] == "malformed response"
    assert {r["sample_id"] for r in spark.read.parquet(f"{out}/evaluations").collect()}.isdisjoint({"a", "d"})
    n = spark.read.parquet(f"{out}/decisions").count()
    s = run_eval.run(spark, p, out, None, Picky())
    assert s["pending"] == {} and spark.read.parquet(f"{out}/decisions").count() == n + 2


def test_the_judge_sees_texts_only(spark):
    p = prepared(spark).withColumn("question_text", F.lit("Q?"))
    verdicts = structure.structure_responses(pipeline.mock_responses(p))
    got = {r["sample_id"]: r for r in pipeline.judge_requests(p, verdicts).collect()}
    tasks = {r["sample_id"]: r["task_name"] for r in p.collect()}
    assert "Spatial_Temporal_Grounding" not in {tasks[i] for i in got} and len(got) == sum(t != "Spatial_Temporal_Grounding" for t in tasks.values())
    for i, r in got.items():
        seen = set(json.loads(r["reference"])) | set(json.loads(r["prediction"]))
        assert seen == ({"reference_segments", "prediction_segments"} if "Caption" in tasks[i] else {"text"})
        assert r["question_text"] == "Q?"


def packs():
    tasks = run_eval.TASKS
    return run_eval.Packs(
        model={t[0]: "ASK {{question}} {{ sampled_index_range }}" for t in tasks},
        judge={t[0]: "JUDGE {{question_text}} {{reference_payload_json}} {{prediction_payload_json}}" for t in tasks},
        structurer={t[0]: "STRUCTURE {{raw_output}} {{required_object_labels_json}}" for t in tasks},
        oracle_structurer={t: "OSTRUCTURE {{raw_output}}" for t in run_eval.UPSTREAM_TASKS},
        oracle={v: {t: f"{v} {{{{question}}}} TRUTH {{{{oracle_tracking_json}}}}" for t in run_eval.UPSTREAM_TASKS} for v in ("language", "visual", "language_visual")},
    )


def full(spark):
    p = prepared(spark).withColumn("question_text", F.concat(F.lit("what of "), "sample_id"))
    p = p.withColumns({"sampled_frames_original": F.array(F.lit(0), F.lit(5), F.lit(10)).cast("array<bigint>"), "sampled_video_fps": F.lit(2.0), "q_window_sampled": F.expr("named_struct('start', 0L, 'end', 2L)"), "frame_files": F.array(F.lit("frames/0000.jpg"))})
    return p.withColumns({"oracle_frame_files": F.array(F.lit("oracle/0000.jpg")), "oracle_video_file": F.lit("oracle/v.mp4")})


def test_prompts_in_the_run(spark, tmp_path):
    out = str(tmp_path / "run")

    class Repeat(structure.Backend):
        def complete(self, prompt, raw_output):
            assert prompt.startswith("STRUCTURE ")
            return [raw_output]

    pairs = spark.createDataFrame([("d|b", "v", "b", "d", "Continuous_Actions_Caption")], PAIR)
    run_eval.run(spark, full(spark), out, Talker(), Picky(), pairs, packs(), Repeat())
    told = {r["sample_id"]: json.loads(r["raw_output"])["text"] for r in spark.read.parquet(f"{out}/predictions").collect()}
    assert told["a"].startswith("user=ASK what of a 0..2")
    assert told["d"].startswith("user=ASK what of b 0..2 | assistant=") and "user=ASK what of d" in told["d"]
    r = spark.read.json(f"{out}/chain_summary").first()
    assert r["num_scored_chain_samples"] == 1


def test_a_row_without_a_prompt_is_not_asked(spark, tmp_path):
    p = full(spark).withColumn("sampled_video_fps", F.when(F.col("sample_id") != "a", 2.0))
    pk = packs()
    pk.model = {t: "{{question}} {{sampled_video_fps}}" for t in pk.model}
    s = run_eval.run(spark, p, str(tmp_path / "r"), Talker(), Picky(), None, pk)
    assert s["pending"] == {"predict": 1}
    bad = spark.read.parquet(str(tmp_path / "r/predictions")).where("error is not null").collect()
    assert [(r["sample_id"], r["error"]) for r in bad] == [("a", "no prompt could be rendered")]


def test_oracle_runs_give_the_truth_and_resume(spark, tmp_path):
    p, out = full(spark), str(tmp_path / "o")
    pairs = spark.createDataFrame([("d|b", "v", "b", "d", "Continuous_Actions_Caption")], PAIR)
    got = {r["variant"]: r for r in run_eval.oracle_runs(spark, p, out, Talker(), Picky(), pairs, packs()).collect()}
    assert set(got) == {"language", "visual", "language_visual"}
    assert all(r["chain_success_wo_track"] == 1.0 and r["num_scored_chain_samples"] == 1 for r in got.values())
    for v in got:
        up = spark.read.parquet(f"{out}/{v}/upstream_predictions").collect()
        assert [r["sample_id"] for r in up] == ["d|b"]  # the two ends of the pair, nothing else
        text = json.loads(up[0]["raw_output"])["text"]
        assert f"user={v} what of b TRUTH" in text and '"bbox_mot": [' in text and ("oracle/0000.jpg" in text) == (v != "language")
        down = json.loads(spark.read.parquet(f"{out}/{v}/downstream_predictions").first()["raw_output"])["text"]
        assert f"user={v} what of b" in down and "assistant=" in down and "user=ASK what of d" in down and "TRUTH" in down.split("assistant=")[0]
    before = {f: spark.read.parquet(f"{out}/visual/{f}").count() for f in ("upstream_predictions", "downstream_decisions")}
    again = {r["variant"]: r for r in run_eval.oracle_runs(spark, p, out, Talker(broken=("d|b",)), Picky(broken=("d|b",)), pairs, packs()).collect()}
    assert again == got and before == {f: spark.read.parquet(f"{out}/visual/{f}").count() for f in before}


def test_oracle_errors_name_their_stage(spark, tmp_path):
    p, out = full(spark).withColumn("oracle_video_file", F.lit(None).cast("string")), str(tmp_path / "o")
    pairs = spark.createDataFrame([("d|b", "v", "b", "d", "Continuous_Actions_Caption")], PAIR)
    _, errors = run_eval.oracle_pairs(spark, p, out, "visual", pairs, Talker(), Picky(), packs())
    assert {(r["stage"], r["error"]) for r in errors.collect()} == {("oracle_upstream_prediction", "missing oracle video")}
    results, errors = run_eval.oracle_pairs(spark, p, out, "language", pairs, Talker(), Picky(broken=("d|b",)), packs())
    assert results.count() == 0 and {r["stage"] for r in errors.collect()} == {"oracle_upstream_evaluation"}
    results, errors = run_eval.oracle_pairs(spark, p, out, "language", pairs, Talker(), Picky(), packs())
    assert results.count() == 1 and errors.count() == 0


def test_remote_backends():
    class Client:
        def stream(self, **asked):
            assert asked["extra_body"]["enable_thinking"] is False and asked["messages"][0]["content"] == "P"
            yield [(0, '{"a"'), (1, None)]
            yield [(0, ": 1}")]

    backend = predict.ModelBackend(Client, "m")
    assert backend.texts([{"role": "user", "content": "P"}]) == ['{"a": 1}']
    assert structure.ModelStructurer(backend).complete("P", "raw") == ['{"a": 1}']
    assert predict.ModelJudge(backend).respond({"prompt": "P"}) == '{"a": 1}'


def test_judge_retries_malformed_only(spark):
    class Slow(predict.Judge):
        def __init__(self):
            self.n = 0

        def respond(self, row):
            self.n += 1
            if row["sample_id"] == "x":
                raise OSError("down")
            return "oops" if self.n % 3 else predict.StaticJudge(1).respond(row)

    df = spark.createDataFrame([("x", "main"), ("y", "main"), ("z", "main")], "sample_id string, protocol_id string").coalesce(1)
    got = {r["sample_id"]: r for r in predict.judge(df, Slow()).collect()}
    assert got["x"]["error"].startswith("OSError") and got["y"]["decision"]["final_pass"] == 1
    one = json.loads(predict.StaticJudge(1).respond({}))
    assert evaluate.decision({"correctness": 1}) is None and evaluate.decision([]) is None and evaluate.decision(one)["final_pass"] == 1
    assert evaluate.decision(one | {"correctness": "0.5"}) is None and evaluate.decision(one | {"correctness": "1.0"}) is None and evaluate.decision(one | {"confidence": " "}) is None


def test_stream_texts(spark):
    df = spark.createDataFrame([("r", 0, 2, "b"), ("r", 0, 1, "a"), ("r", 1, 1, None)], "request string, choice int, ord int, piece string")
    assert {(r["choice"], r["text"]) for r in predict.stream_texts(df).collect()} == {(0, "ab"), (1, "")}
    many = spark.range(10_000).select(F.lit("r").alias("request"), F.lit(0).alias("choice"), F.col("id").cast("int").alias("ord"), (F.col("id") % 10).cast("string").alias("piece"))
    assert predict.stream_texts(many.repartition(7)).first()["text"] == "0123456789" * 1000


def test_config_and_media(tmp_path):
    (tmp_path / "c.toml").write_text('[run_eval]\nprepared = "p"\nout = "o"\n')
    assert run_eval.RunConfig.load(str(tmp_path / "c.toml")).prepared == str(tmp_path / "p")
    (tmp_path / "d.toml").write_text('[run_eval]\nprepared = "p"\nout = "o"\nnonsense = 1\n')
    with pytest.raises(ValueError):
        run_eval.RunConfig.load(str(tmp_path / "d.toml"))
    assert media.media_formats(["frames", "frames"]) == ["frames"]
    with pytest.raises(ValueError):
        media.media_formats(["gif"])


def test_frame_names(spark):
    assert spark.range(1).select(media.frame_names(F.array(F.lit(7), F.lit(9))).alias("n")).first()["n"] == ["frames/0000.jpg", "frames/0001.jpg"]
