"""The evaluation pipeline end to end, on DataFrames: prepared samples and responses to summaries."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameledger.functions import geometry
from frameledger.operators import evaluate, structure, summarize
from frameledger.schemas import ACTIONS, GROUNDING, PREDICTION, TASKS, THRESHOLD

_MODES = {t[0]: t[3] for t in TASKS}


def judge_mode(task: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in _MODES.items() for x in kv])[task], F.lit("none"))


def evaluate_predictions(prepared: DataFrame, verdicts: DataFrame, decision: Column | None = None, oracle: bool = False, text_score: Callable[[Column, Column], Column] = evaluate.token_f1) -> DataFrame:
    """The evaluation record of every validated sample: component metrics and passes, task_pass, warnings.

    ``prepared``: sample_id, protocol_id, task_name, reference_payload. ``verdicts``: as structure_responses
    gives them; read once, everything is scored within the row. ``decision``: a Column over ``prepared`` with the
    judge's decision (default: the static passing judge). A row that needs a judge and has no decision (the call
    failed, or stayed malformed) has no record: it is pending, not failed. A row without text to judge fails
    without being asked. ``text_score``: of (reference, candidate), see ``textscore``."""
    keys = ["sample_id", "protocol_id"]
    told = decision if decision is not None else evaluate.passed_decision()
    j = prepared.select(*keys, "task_name", F.col("reference_payload").alias("ref"), told.alias("told")).join(verdicts.where(F.col("prediction").isNotNull()).select(*keys, F.from_json("prediction", PREDICTION).alias("pred")), keys)
    task = F.col("task_name")
    mode = judge_mode(task)
    asked = evaluate.needs_judge(mode, F.col("pred"), evaluate.has_text(task, F.col("pred")))
    j = j.where(~asked | F.col("told").isNotNull())
    d = F.when(asked, F.col("told")).when(mode != "none", evaluate.failed_decision("missing structured text prediction"))
    bbox_iou = F.when(task == "Scoreboard_Single", geometry.box_iou(F.col("pred.bbox"), F.col("ref.bbox")))
    objects = F.when(task == "Objects_Spatial_Relationships", evaluate.object_scores(F.col("ref.objects"), F.col("pred.objects")))
    window, true_window = F.col("pred.time_window_sampled"), F.col("ref.time_window_sampled")
    at = lambda a, i: F.get(a, F.lit(i))
    tiou = F.when(task == GROUNDING, F.when(F.size(window) == 2, F.coalesce(geometry.temporal_iou(at(window, 0), at(window, 1), at(true_window, 0), at(true_window, 1)), F.lit(0.0))).otherwise(0.0))
    tracked = task.isin(ACTIONS, GROUNDING) & F.lit(not oracle)
    scores = F.when(tracked, evaluate.tracking_in_row(F.col("ref.tracking_gt_sampled"), F.col("pred.tracking")))
    warnings = F.when(tracked, evaluate.duplicate_warnings(F.col("pred.tracking")))
    out = j.withColumns({"judge_decision": d, "judge_pass": evaluate.judge_pass(d, mode), "bbox_iou": bbox_iou, "object_scores": objects, "tiou": tiou, "pair": evaluate.text_pair(task, F.col("ref"), F.col("pred")), "t": scores, "warnings": warnings})
    bbox_pass = F.when(F.col("bbox_iou").isNotNull(), (F.col("bbox_iou") >= THRESHOLD).cast("int"))
    object_passes = F.transform("object_scores", lambda o: o["pass"])
    all_objects = F.when(F.col("object_scores").isNotNull(), F.forall("object_scores", lambda o: o["pass"] == 1).cast("int"))
    tiou_pass = F.when(F.col("tiou").isNotNull(), (F.col("tiou") >= THRESHOLD).cast("int"))
    verdict = evaluate.task_pass(task, F.col("judge_pass"), bbox_pass, all_objects, tiou_pass, F.col("t.tracking_pass"), oracle)
    return out.select(*keys, "task_name", "judge_decision", "judge_pass", "bbox_iou", F.coalesce(object_passes, F.when(bbox_pass.isNotNull(), F.array(bbox_pass))).alias("bbox_passes"), "tiou", tiou_pass.alias("tiou_pass"), "t.tracking_mean_iou", "t.tracking_pass_rate", "t.tracking_pass", text_score(F.col("pair.reference"), F.col("pair.candidate")).alias("text_f1"), verdict.alias("task_pass"), F.coalesce("warnings", F.array().cast("array<string>")).alias("warnings"))


def judge_requests(prepared: DataFrame, verdicts: DataFrame) -> DataFrame:
    """sample_id, protocol_id, task_name, question_text, reference, prediction (JSON payloads) of the rows that go to a
    judge."""
    keys = ["sample_id", "protocol_id"]
    j = prepared.join(verdicts.where(F.col("prediction").isNotNull()).select(*keys, F.from_json("prediction", PREDICTION).alias("pred")), keys)
    task = F.col("task_name")
    j = j.where(evaluate.needs_judge(judge_mode(task), F.col("pred"), evaluate.has_text(task, F.col("pred"))))
    question = F.coalesce("question_text", F.lit("")) if "question_text" in prepared.columns else F.lit("")
    return j.select(*keys, "task_name", question.alias("question_text"), evaluate.judge_reference(task, F.col("reference_payload")).alias("reference"), evaluate.judge_prediction(task, F.col("pred")).alias("prediction"))


def mock_responses(prepared: DataFrame) -> DataFrame:
    """The reference echoed as a JSON response: the smoke-test model, without any UDF."""
    r = F.col("reference_payload")
    body = F.to_json(F.struct(r["text"].alias("text"), r["bbox"].alias("bbox"), r["objects"].alias("objects"), r["segments_sampled"].alias("segments"), r["time_window_sampled"].alias("time_window_sampled"), r["tracking_gt_sampled"].alias("tracking")))
    return prepared.select("sample_id", "protocol_id", "task_name", body.alias("response"), F.transform(r["objects"], lambda o: o["label"]).alias("labels"))


def run(prepared: DataFrame, responses: DataFrame, oracle: bool = False) -> tuple[DataFrame, DataFrame]:
    """(records, task summary) of responses to prepared samples."""
    verdicts = structure.structure_responses(responses, oracle)
    records = evaluate_predictions(prepared, verdicts, oracle=oracle)
    return records, summarize.task_summary(prepared, records, ["sample_id", "protocol_id"])
