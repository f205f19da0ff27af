"""Scoring of structured predictions against the reference, and the judge."""
from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from frameledger.functions import geometry
from frameledger.functions.text import recover_json
from frameledger.schemas import ACTIONS, CAPTIONS, GROUNDING, THRESHOLD

NO_DECISION = {"correctness": 0, "completeness": 0, "faithfulness": 0, "final_pass": 0}


def first_per_frame(predicted: DataFrame, keys: list[str]) -> DataFrame:
    """Predicted boxes with the first of several for one frame (``ord`` orders them), and how many there were."""
    return predicted.groupBy(*keys, "frame_sampled").agg(F.min_by("bbox_mot", "ord").alias("bbox_mot"), F.count(F.lit(1)).alias("n_predicted"))


def tracking_scores(truth: DataFrame, predicted: DataFrame, keys: list[str]) -> DataFrame:
    """Per sample: tracking_mean_iou, tracking_pass_rate, tracking_pass, n_frames.

    Every true frame counts; one without prediction has IoU 0; predictions elsewhere are ignored. Samples
    without true frames are not in the result (their scores are 0: see ``zero_filled``)."""
    p = first_per_frame(predicted, keys).select(*keys, "frame_sampled", F.col("bbox_mot").alias("predicted"))
    j = truth.join(p, [*keys, "frame_sampled"], "left")
    iou = geometry.box_iou(geometry.mot_to_corner(F.col("predicted")), geometry.mot_to_corner(F.col("bbox_mot")))
    g = j.withColumn("iou", iou).groupBy(*keys).agg(F.avg("iou").alias("tracking_mean_iou"), F.sum((F.col("iou") >= THRESHOLD).cast("bigint")).alias("hits"), F.count(F.lit(1)).alias("n_frames"))
    g = g.withColumn("tracking_pass_rate", F.col("hits") / F.col("n_frames"))
    return g.select(*keys, "tracking_mean_iou", "tracking_pass_rate", ((F.col("tracking_mean_iou") >= THRESHOLD) & (F.col("tracking_pass_rate") >= THRESHOLD)).cast("int").alias("tracking_pass"), "n_frames")


def tracking_in_row(truth: Column, predicted: Column) -> Column:
    """The same scores of one row from its two arrays, without a join: struct of tracking_mean_iou,
    tracking_pass_rate and tracking_pass. Null truth elements do not count; no true frame gives 0."""
    real = F.filter(F.coalesce(truth, F.array()), lambda t: t.isNotNull())

    def iou(t):
        first = F.get(F.filter(predicted, lambda p: p["frame_sampled"] == t["frame_sampled"]), F.lit(0))["bbox_mot"]
        return F.coalesce(geometry.box_iou(geometry.mot_to_corner(first), geometry.mot_to_corner(t["bbox_mot"])), F.lit(0.0))

    # all sums in one pass over the frames, so that each IoU is computed once
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("hits"))
    step = lambda a, x: F.struct((a["sum"] + x).alias("sum"), (a["hits"] + (x >= THRESHOLD).cast("int")).alias("hits"))
    total = F.aggregate(F.transform(real, iou), start, step)
    n = F.when(F.size(real) > 0, F.size(real))
    scores = F.transform(F.array(total), lambda t: F.struct(F.coalesce(t["sum"] / n, F.lit(0.0)).alias("mean"), F.coalesce(t["hits"] / n, F.lit(0.0)).alias("rate")))
    return F.transform(scores, lambda s: F.struct(s["mean"].alias("tracking_mean_iou"), s["rate"].alias("tracking_pass_rate"), ((s["mean"] >= THRESHOLD) & (s["rate"] >= THRESHOLD)).cast("int").alias("tracking_pass")))[0]


def duplicate_warnings(predicted: Column) -> Column:
    """A warning for every predicted box beyond the first of its frame, in frame order."""
    frames = F.array_sort(F.transform(predicted, lambda p: p["frame_sampled"]))
    again = F.filter(frames, lambda f, i: (i > 0) & (f == F.get(frames, i - 1)))
    return F.transform(again, lambda f: F.concat(F.lit("duplicate tracking prediction for sampled frame "), f.cast("string")))


def zero_filled(samples: DataFrame, scores: DataFrame, keys: list[str]) -> DataFrame:
    """The scores for all samples; those without true frames get 0."""
    j = samples.select(*keys).join(scores, keys, "left")
    return j.select(*keys, *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("tracking_mean_iou", "tracking_pass_rate")], F.coalesce("tracking_pass", F.lit(0)).alias("tracking_pass"))


def object_scores(truth: Column, predicted: Column) -> Column:
    """array<struct<label, iou, pass>> in the order of the true objects; of several predictions for a label
    the last counts, a missing one scores 0."""
    def one(o):
        same = F.filter(predicted, lambda p: F.trim(p["label"]) == F.trim(o["label"]))
        iou = geometry.box_iou(F.try_element_at(same, F.lit(-1))["bbox"], o["bbox"])
        return F.struct(F.trim(o["label"]).alias("label"), F.coalesce(iou, F.lit(0.0)).alias("iou"), F.coalesce((iou >= THRESHOLD).cast("int"), F.lit(0)).alias("pass"))

    return F.transform(truth, one)


def strict_pass(d: Column) -> Column:
    """All four criteria are 1."""
    ones = [F.coalesce(d[k] == 1, F.lit(False)) for k in NO_DECISION]
    return (ones[0] & ones[1] & ones[2] & ones[3]).cast("int")


def judge_pass(d: Column, mode: Column) -> Column:
    """By the task's mode: ``strict``, ``final`` (final_pass alone), null where no judge is asked."""
    return F.when(mode == "strict", strict_pass(d)).when(mode == "final", F.coalesce((d["final_pass"] == 1).cast("int"), F.lit(0)))


def failed_decision(reason: str) -> Column:
    zeros = [F.lit(0).alias(k) for k in NO_DECISION]
    return F.struct(*zeros, F.lit("low").alias("confidence"), F.lit(reason).alias("brief_reason"))


def passed_decision(reason: str = "static pass") -> Column:
    return F.struct(*[F.lit(1).alias(k) for k in NO_DECISION], F.lit("high").alias("confidence"), F.lit(reason).alias("brief_reason"))


def decision(payload) -> dict | None:
    """A judge's payload as a decision, or None if it is malformed: all six members, whole numbers of 0 or 1 (or texts
    that spell them), no blank text. Further members are allowed."""
    if not isinstance(payload, dict) or not {*NO_DECISION, "confidence", "brief_reason"} <= payload.keys():
        return None
    try:
        bits = {k: int(payload[k]) for k in NO_DECISION}
    except (TypeError, ValueError, OverflowError):
        return None
    words = {k: str(payload[k]).strip() for k in ("confidence", "brief_reason")}
    return bits | words if set(bits.values()) <= {0, 1} and all(words.values()) else None


@F.pandas_udf(StructType([StructField(k, IntegerType()) for k in NO_DECISION] + [StructField(k, StringType()) for k in ("confidence", "brief_reason")]))
def _decisions(text: pd.Series) -> pd.DataFrame:
    out = []
    for t in text:
        try:
            out.append(None if t is None else decision(recover_json(t)))
        except (ValueError, RecursionError):
            out.append(None)
    return pd.DataFrame([d or {} for d in out], columns=[*NO_DECISION, "confidence", "brief_reason"], dtype=object).where(lambda x: x.notna(), None)


def parse_decision(text: Column) -> Column:
    """A judge's response as a decision, null if it is none."""
    d = _decisions(text)
    return F.when(d["correctness"].isNotNull(), d)


def judge_reference(task: Column, reference: Column) -> Column:
    """What the judge sees of the reference, as JSON: the text, or the segments; nothing else."""
    pick = lambda n: F.transform(reference[n], lambda s: F.struct(s["start_sampled"].alias("start_sampled"), s["end_sampled"].alias("end_sampled"), s["text"].alias("text")))
    return F.when(task.isin(CAPTIONS), F.to_json(F.struct(pick("segments_sampled").alias("reference_segments")))).when(task != GROUNDING, F.to_json(F.struct(reference["text"].alias("text"))))


def judge_prediction(task: Column, prediction: Column) -> Column:
    """What the judge sees of the prediction, as JSON: boxes and tracking are scored without it."""
    return F.when(task.isin(CAPTIONS), F.to_json(F.struct(prediction["segments"].alias("prediction_segments")))).when(task != GROUNDING, F.to_json(F.struct(prediction["text"].alias("text"))))


def has_text(task: Column, prediction: Column) -> Column:
    """Whether there is something to judge: segments, or a text that is not blank."""
    return task.isin(CAPTIONS) | (F.length(F.trim(F.coalesce(prediction["text"], F.lit("")))) > 0)


def needs_judge(mode: Column, prediction: Column, has_text: Column) -> Column:
    """Only these rows go to a judge; the others fail without being asked."""
    return (mode != "none") & prediction.isNotNull() & has_text


def task_pass(task: Column, judge: Column, bbox: Column, objects_all: Column, tiou: Column, tracking: Column, oracle: bool = False) -> Column:
    """The verdict of a sample from its component passes."""
    one = lambda c: F.coalesce(c, F.lit(0)) == 1
    out = F.when(task == "Scoreboard_Single", one(bbox) & one(judge)).when(task == "Objects_Spatial_Relationships", one(objects_all) & one(judge))
    out = out.when(task == ACTIONS, one(judge) if oracle else one(judge) & one(tracking)).when(task == GROUNDING, one(tiou) if oracle else one(tiou) & one(tracking))
    return out.otherwise(one(judge)).cast("int")


def linearized(segments: Column) -> Column:
    return F.array_join(F.transform(segments, lambda s: s["text"]), " ")


def text_pair(task: Column, reference: Column, prediction: Column) -> Column:
    """struct<reference, candidate> for text scoring; null for tasks without text or without prediction."""
    caption = task.isin(CAPTIONS)
    pair = lambda a, b: F.struct(a.alias("reference"), b.alias("candidate"))
    return F.when(prediction.isNull() | (task == GROUNDING), None).when(caption, pair(linearized(reference["segments_sampled"]), linearized(prediction["segments"]))).otherwise(pair(reference["text"], prediction["text"]))


def token_f1(reference: Column, candidate: Column) -> Column:
    """A model-free text score: F1 of the distinct lower-case words. Null unless both texts have words.
    (A model-based scorer plugs in at the same place as an Arrow UDF.)"""
    words = lambda c: F.filter(F.array_distinct(F.split(F.lower(c), r"[^\p{L}\p{N}]+")), lambda w: w != "")
    a, b = words(reference), words(candidate)
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), 2.0 * both / (F.size(a) + F.size(b)))
