import json

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from frameledger.operators import evaluate, structure, summarize
from frameledger.plans import pipeline
from frameledger.schemas import DECISION, PREDICTION


def v(task, payload, labels=None, oracle=False):
    return structure.validate(task, payload, labels, oracle)


def test_text_and_box():
    assert v("AI_Coach", {"text": None})["prediction"] == {"text": "None"}
    assert v("AI_Coach", {})["errors"] == ["missing text field"]
    ok = v("Scoreboard_Single", {"text": " a ", "bbox": ["1", 2, 3000, -4]})
    assert ok["prediction"] == {"bbox": [1.0, 2.0, 3000.0, -4.0], "text": "a"}
    for box, message in (([1, 2, 3], "bbox must contain exactly 4 values"), ("x", "bbox must be a list"), ([1, 2, 3, "y"], "bbox must contain numeric values"), ([1, 2, 3, float("inf")], "bbox must contain finite numeric values")):
        assert v("Scoreboard_Single", {"text": "a", "bbox": box})["errors"] == [message]
    assert v("Commentary", {})["prediction"] is None


def test_objects():
    a, b = {"label": "A", "bbox": [1, 2, 3, 4]}, {"label": " B ", "bbox": [5, 6, 7, 8]}
    task = "Objects_Spatial_Relationships"
    assert [o["label"] for o in v(task, {"text": "t", "objects": [b, a]}, ["A", "B"])["prediction"]["objects"]] == ["A", "B"]
    one = v(task, {"text": "t", "objects": [b]}, ["A", "B"])
    assert one["prediction"]["objects"][0] == {"label": "A", "bbox": [-1.0] * 4} and len(one["warnings"]) == 1
    assert v(task, {"text": "t", "objects": [a, a]}, ["A"])["errors"] == ["duplicate object label: A"]
    assert v(task, {"text": "t", "objects": [b]}, ["A"])["errors"] == ["unexpected object label: B"]
    assert v(task, {"objects": [a]}, ["A"])["prediction"] is None


def test_segments_tracking_windows():
    task = "Continuous_Actions_Caption"
    good = {"segments": [{"start_sampled": "1", "end_sampled": 3.7, "text": " x "}], "tracking": [{"frame_sampled": True, "bbox_mot": [1, 2, 3, 4]}]}
    assert v(task, good)["prediction"] == {"segments": [{"start_sampled": 1, "end_sampled": 3, "text": "x"}], "tracking": [{"frame_sampled": 1, "bbox_mot": [1.0, 2.0, 3.0, 4.0]}]}
    assert "tracking" not in v(task, good, oracle=True)["prediction"]
    assert v(task, {"segments": [{"start_sampled": "1.5", "end_sampled": 1, "text": ""}], "tracking": []})["fatal"]
    stg = "Spatial_Temporal_Grounding"
    assert v(stg, {"time_window_sampled": [], "tracking": []})["prediction"]["time_window_sampled"] == []
    assert v(stg, {"time_window_sampled": [1], "tracking": []})["errors"]


def test_tracking_scores(spark):
    truth = spark.createDataFrame([("s", f, [0.0, 0.0, 10.0, 10.0]) for f in range(4)] + [("t", 0, [0.0, 0.0, 4.0, 4.0])], "sample_id string, frame_sampled long, bbox_mot array<double>")
    guess = spark.createDataFrame([("s", 0, 0, [0.0, 0.0, 10.0, 10.0]), ("s", 0, 1, [90.0, 0.0, 1.0, 1.0]), ("s", 1, 2, [0.0, 0.0, 10.0, 10.0]), ("s", 99, 3, [0.0, 0.0, 1.0, 1.0])], "sample_id string, frame_sampled long, ord int, bbox_mot array<double>")
    s = {r["sample_id"]: r for r in evaluate.tracking_scores(truth, guess, ["sample_id"]).collect()}
    assert (s["s"]["tracking_mean_iou"], s["s"]["tracking_pass_rate"], s["s"]["tracking_pass"]) == (0.5, 0.5, 1)
    assert s["t"]["tracking_pass"] == 0
    every = spark.createDataFrame([("s",), ("none",)], "sample_id string")
    z = {r["sample_id"]: r for r in evaluate.zero_filled(every, evaluate.tracking_scores(truth, guess, ["sample_id"]), ["sample_id"]).collect()}
    assert (z["none"]["tracking_mean_iou"], z["none"]["tracking_pass"]) == (0.0, 0)
    assert evaluate.tracking_scores(truth.limit(0), guess, ["sample_id"]).count() == 0


def test_tracking_in_the_row_is_that_of_the_join(spark):
    import random

    r = random.Random(1)
    box = lambda: [float(r.randint(0, 30)) for _ in range(4)]
    rows = [(str(i), [(f, box()) for f in range(r.randint(0, 5))] + [None], [(r.randint(0, 5), box()) for _ in range(r.randint(0, 9))]) for i in range(60)] + [("n", None, None)]
    kind = "array<struct<frame_sampled:bigint,bbox_mot:array<double>>>"
    df = spark.createDataFrame(rows, f"sample_id string, truth {kind}, guess {kind}")
    truth = df.select("sample_id", F.explode("truth").alias("t")).where("t is not null").select("sample_id", "t.*")
    guess = df.select("sample_id", F.posexplode("guess").alias("ord", "t")).select("sample_id", "ord", "t.*")
    want = {x["sample_id"]: x for x in evaluate.zero_filled(df, evaluate.tracking_scores(truth, guess, ["sample_id"]), ["sample_id"]).collect()}
    got = df.select("sample_id", evaluate.tracking_in_row(F.col("truth"), F.col("guess")).alias("s"), evaluate.duplicate_warnings(F.col("guess")).alias("w"), "guess").collect()
    for x in got:
        w = want[x["sample_id"]]
        assert x["s"]["tracking_mean_iou"] == pytest.approx(w["tracking_mean_iou"]) and x["s"]["tracking_pass_rate"] == pytest.approx(w["tracking_pass_rate"]) and x["s"]["tracking_pass"] == w["tracking_pass"]
        frames = [g["frame_sampled"] for g in x["guess"] or []]
        assert len(x["w"] or []) == len(frames) - len(set(frames))


def test_overlay():
    import numpy as np

    from frameledger.sources import media

    black = np.zeros((100, 200, 3), np.uint8)
    drawn = media.overlay(black, [[100, 300, 200, 400], [990, 990, 50, 50]])
    assert not black.any() and drawn[30, 20].tolist() == [0, 255, 0] and drawn[50, 40].tolist() == [0, 0, 0]
    assert media.pixel_corners([100, 300, 200, 400], 200, 100) == (20, 30, 60, 70)
    assert media.pixel_corners([1200, -50, 0, 0], 200, 100) == (199, 0, 199, 1)
    with pytest.raises(RuntimeError, match="av"):
        media.write_video("x.mp4", [black], 5.0)


def test_combined_chain_summary(spark):
    base = spark.createDataFrame([(3, 0.5)], "num_chain_samples int, chain_success double")
    oracle = spark.createDataFrame([("visual", 3, None)], "variant string, num_chain_samples int, chain_success double")
    assert [tuple(r) for r in summarize.combined_chain_summary(base, oracle).collect()] == [("base", 3, 0.5), ("oracle_visual", 3, None)]
    assert summarize.combined_chain_summary(base).count() == 1


def test_judge(spark):
    texts = ['{"correctness": 1, "completeness": 1, "faithfulness": "1", "final_pass": true, "confidence": "high", "brief_reason": "ok", "x": 1}', '{"correctness": 2, "completeness": 1, "faithfulness": 1, "final_pass": 1, "confidence": "high", "brief_reason": "ok"}', '{"correctness": 1}', "no", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(evaluate.parse_decision(F.col("t")).alias("d"))
    got = df.select(F.col("d").isNotNull().alias("ok"), evaluate.judge_pass(F.col("d"), F.lit("strict")).alias("s"), evaluate.judge_pass(F.col("d"), F.lit("none")).alias("n")).collect()
    assert [r["ok"] for r in got] == [True, False, False, False, False]
    assert got[0]["s"] == 1 and got[1]["s"] == 0 and got[0]["n"] is None
    assert set(df.schema["d"].dataType.fieldNames()) == {x.split()[0] for x in DECISION.split(", ")}


def test_chain_summary(spark):
    """Two pairs with hand-set passes."""
    pairs = spark.createDataFrame([("d1|u1", "v", "u1", "d1", "Continuous_Actions_Caption"), ("d2|u2", "v", "u2", "d2", "Spatial_Temporal_Grounding"), ("d3|u3", "v", "u3", "d3", "Spatial_Temporal_Grounding")], "pair_id string, video_key string, upstream_sample_id string, downstream_sample_id string, upstream_task_name string")
    rec = spark.createDataFrame([("u1", 1, None, 1), ("u2", None, 1, 0), ("d1", 0, None, None), ("d2", 1, None, None)], "sample_id string, judge_pass int, tiou_pass int, tracking_pass int")
    r = summarize.chain_summary(summarize.chain_components(pairs, rec)).first()
    assert (r["understanding_acc"], r["understanding_acc_wo_track"], r["reasoning_acc"], r["chain_success"], r["chain_success_wo_track"]) == (0.5, 1.0, 0.5, 0.0, 0.5)
    assert (r["num_chain_samples"], r["num_scored_chain_samples"], r["num_pending_chain_samples"]) == (3, 2, 1)
    assert r["full_Continuous_Actions_Caption"] == 1.0 and r["full_Spatial_Temporal_Grounding"] == 0.0


def prepared(spark):
    track = [{"frame_sampled": i, "frame_original": 5 * i, "bbox_mot": [1.0, 2.0, 30.0, 40.0]} for i in range(3)]
    base = {"text": None, "bbox": None, "objects": None, "segments_sampled": None, "time_window_sampled": None, "tracking_gt_sampled": None}
    seg = [{"start_sampled": 0, "end_sampled": 1, "text": "runs"}, {"start_sampled": 1, "end_sampled": 2, "text": "jumps"}]
    rows = [
        ("a", "Scoreboard_Single", base | {"text": "2-1", "bbox": [1.0, 2.0, 30.0, 40.0]}),
        ("b", "Continuous_Actions_Caption", base | {"segments_sampled": seg, "tracking_gt_sampled": track}),
        ("c", "Spatial_Temporal_Grounding", base | {"time_window_sampled": [0, 2], "tracking_gt_sampled": track}),
        ("d", "Spatial_Imagination", base | {"text": "to the left"}),
        ("e", "Objects_Spatial_Relationships", base | {"text": "apart", "objects": [{"label": "A", "bbox": [0.0, 0.0, 5.0, 5.0]}, {"label": "B", "bbox": [9.0, 9.0, 15.0, 15.0]}]}),
    ]
    ref = "struct<text:string,bbox:array<double>,objects:array<struct<label:string,bbox:array<double>>>,segments_sampled:array<struct<start_sampled:bigint,end_sampled:bigint,text:string>>,time_window_sampled:array<bigint>,tracking_gt_sampled:array<struct<frame_sampled:bigint,frame_original:bigint,bbox_mot:array<double>>>>"
    return spark.createDataFrame([(i, "main", t, r) for i, t, r in rows], f"sample_id string, protocol_id string, task_name string, reference_payload {ref}")


def test_echo_model_scores_one(spark):
    p = prepared(spark)
    records, summary = pipeline.run(p, pipeline.mock_responses(p))
    assert {r["sample_id"]: r["task_pass"] for r in records.collect()} == dict.fromkeys("abcde", 1)
    assert summarize.overall(summary).first()["overall"] == 1.0
    by = {r["task_name"]: r for r in summary.collect()}
    assert by["Spatial_Imagination"]["tiou_pass_rate"] is None and by["Objects_Spatial_Relationships"]["bbox_pass_rate"] == 1.0


def test_pending_samples_and_empty_targets(spark):
    p = prepared(spark)
    records, summary = pipeline.run(p, pipeline.mock_responses(p).where("sample_id <> 'a'"))
    row = summary.where("task_name = 'Scoreboard_Single'").first()
    assert (row["num_samples"], row["num_scored_samples"], row["task_accuracy"]) == (1, 0, None)
    assert pipeline.run(p.limit(0), pipeline.mock_responses(p).limit(0))[1].count() == 0


def test_backend_is_asked_again(spark):
    class Flaky(structure.Backend):
        calls = 0

        def complete(self, prompt, raw_output):
            self.calls += 1
            return ["not json"] if self.calls % 3 else [json.dumps({"text": prompt})]

    df = spark.createDataFrame([Row(sample_id="s", protocol_id="main", task_name="AI_Coach", labels=None, prompt="p", raw_output="r")], "sample_id string, protocol_id string, task_name string, labels array<string>, prompt string, raw_output string")
    got = structure.structure_with(df, Flaky()).first()
    assert json.loads(got["prediction"]) == {"text": "p"}
    got = structure.structure_with(df, structure.StaticParse()).first()
    assert got["prediction"] is None and got["errors"] == ["response is no valid JSON"]


def test_prediction_schema_reads_validated_json(spark):
    one = v("Spatial_Temporal_Grounding", {"time_window_sampled": [1, 2], "tracking": [{"frame_sampled": 1, "bbox_mot": [1, 2, 3, 4]}]})["prediction"]
    r = spark.createDataFrame([(json.dumps(one),)], "j string").select(F.from_json("j", PREDICTION).alias("p")).first()["p"]
    assert r["time_window_sampled"] == [1, 2] and r["tracking"][0]["bbox_mot"] == [1.0, 2.0, 3.0, 4.0]


@pytest.mark.parametrize("text", ["", "  "])
def test_blank_text_is_not_judged(spark, text):
    p = prepared(spark).where("sample_id = 'd'")
    resp = spark.createDataFrame([("d", "main", "Spatial_Imagination", json.dumps({"text": text}), None)], "sample_id string, protocol_id string, task_name string, response string, labels array<string>")
    assert pipeline.run(p, resp)[0].first()["task_pass"] == 0


def test_real_responses_are_scored_per_model(spark, sf):
    from frameledger.plans import reference_queries as q

    predictions = q.once(spark, sf, "structured_predictions", "model_name", "task_name").collect()
    records = q.QUERIES["evaluation_records_models"](spark, sf).collect()
    summary = q.QUERIES["evaluation_summary_models"](spark, sf).collect()
    assert len({r["record_id"] for r in records}) == len(records)
    assert {r["model_name"] for r in summary} == {r["model_name"] for r in predictions}
    assert sum(r["num_samples"] for r in summary) == len(predictions)
    assert sum(r["num_scored_samples"] for r in summary) == sum(r["task_pass"] is not None for r in records)
    assert {0, 1} <= {r["task_pass"] for r in records} and sum(r["num_pending_samples"] for r in summary) > 0


def test_captions_of_any_spelling_are_linearized(spark, tmp_path):
    from frameledger.plans import reference_queries as q

    captions = [(1, '["1-5", "6 - 9"]', '["a", "b"]'), (2, '["1-5", "soon"]', '["a", "b"]'), (3, None, '["a"]')]
    df = spark.createDataFrame([(i, "Continuous_Events_Caption", w, a, None) for i, w, a in captions], "row_id long, task_l2 string, a_window_frame string, answer string, loaded_at timestamp")
    df.write.parquet(f"{tmp_path}/annotations.parquet")
    got = {r["row_id"]: r["n_segments"] for r in q.QUERIES["segment_linearize_all"](spark, str(tmp_path)).collect()}
    assert got == {1: 2, 2: None, 3: None}


def test_text_scores(spark):
    import numpy as np

    from frameledger.operators import textscore

    assert [textscore.positive(x) for x in (5, "7", 0, -1, True, None, "x", 3.9, float("inf"))] == [5, 7, None, None, None, None, None, 3, None]
    assert textscore.length_limit(10**30, 512) == 512 and textscore.length_limit(None, 0) is None and textscore.length_limit(128, None) == 128

    def load():
        def embed(texts, limit):
            words = [t.split()[:limit] for t in texts]
            out = []
            for ws in words:
                m = np.zeros((len(ws), 64))
                for i, w in enumerate(ws):
                    m[i, sum(map(ord, w)) % 64] = 1
                out.append(m)
            return out

        return embed

    scorer = textscore.EmbeddingScorer(load, (None, 2))
    df = spark.createDataFrame([("a b c", "a b z"), ("a b", "x y"), ("a a", "a q"), ("", "a"), (None, "a"), ("a", None)], "r string, c string")
    got = [x["s"] for x in df.select(textscore.text_score(scorer)(F.col("r"), F.col("c")).alias("s")).collect()]
    assert got[0] == 1.0 and got[1] == 0.0 and got[2] == pytest.approx(2 * 0.5 / 1.5) and got[3:] == [None] * 3  # cut to two words
    scorer = textscore.EmbeddingScorer(load, (), 0.5)
    scorer.start()
    assert scorer.score(["a b", "a", " "], ["a b", "b", "a"]) == [1.0, -1.0, 0.0]
    p = prepared(spark)
    records = pipeline.evaluate_predictions(p, structure.structure_responses(pipeline.mock_responses(p)), text_score=textscore.text_score(textscore.EmbeddingScorer(load)))
    assert {x["text_f1"] for x in records.collect()} <= {1.0, None}
