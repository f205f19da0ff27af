"""Prompts as Column expressions: the variables of a prepared sample, rendered by a pack of templates (one a task, or
one a variant and task)."""
from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from frameledger.functions import text
from frameledger.schemas import ACTIONS, GROUNDING, TASKS

#: The variables that the templates of each kind may use.
SAMPLE_VARIABLES = {"question", "num_sampled_frames", "sampled_index_range", "sampled_video_fps", "required_object_labels_json", "question_relevant_sampled_interval"}
ORACLE_VARIABLES = (SAMPLE_VARIABLES - {"required_object_labels_json"}) | {"oracle_tracking_json"}
STRUCTURER_VARIABLES = {"raw_output", "required_object_labels_json"}
JUDGE_VARIABLES = {"question_text", "reference_payload_json", "prediction_payload_json"}
WINDOW_TASKS = [t[0] for t in TASKS if t[1] == "window"]
OBJECTS = "Objects_Spatial_Relationships"


@F.pandas_udf(StringType())
def indented(body: pd.Series) -> pd.Series:
    """JSON texts with two blanks a level, as the templates show them."""
    return body.map(lambda v: None if v is None else json.dumps(json.loads(v), ensure_ascii=False, indent=2))


def labels(task: Column, payload: Column) -> Column:
    """The labels a prediction must name, as a JSON list: those of the reference objects, ``[]`` on other tasks."""
    return F.when(task == OBJECTS, text.labels_json(payload["objects"])).otherwise("[]")


def sample_variables() -> dict[str, Column]:
    """The variables of a row of the prepared table. A sampled video without its rate gives null, so the prompt is null
    and the row an error."""
    c, frames = F.col, F.col("sampled_frames_original")
    n = F.coalesce(F.size(frames), F.lit(0))
    rate = F.when(n <= 1, F.lit("")).otherwise(F.when(c("sampled_video_fps").isNotNull(), text.rate_text("sampled_video_fps")))
    return {
        "question": F.coalesce("question_text", F.lit("")),
        "num_sampled_frames": F.greatest(n, F.lit(0)).cast("string"),
        "sampled_index_range": F.coalesce(text.index_range(frames), F.lit("")),
        "sampled_video_fps": rate,
        "required_object_labels_json": labels(c("task_name"), c("reference_payload")),
        "question_relevant_sampled_interval": F.when(c("task_name").isin(WINDOW_TASKS), text.interval_text(c("q_window_sampled"))),
    }


def oracle_variables() -> dict[str, Column]:
    """Those of an upstream sample whose tracking is given."""
    track = F.transform("reference_payload.tracking_gt_sampled", lambda t: F.struct(t["frame_sampled"].alias("frame_sampled"), t["frame_original"].alias("frame_original"), t["bbox_mot"].alias("bbox_mot")))
    out = {k: v for k, v in sample_variables().items() if k in ORACLE_VARIABLES}
    return out | {"oracle_tracking_json": indented(F.to_json(track)), "question_relevant_sampled_interval": F.when(F.col("task_name") == ACTIONS, text.interval_text(F.col("q_window_sampled")))}


def structurer_variables() -> dict[str, Column]:
    """Of a row with raw_output, task_name and reference_payload."""
    return {"raw_output": F.col("raw_output"), "required_object_labels_json": labels(F.col("task_name"), F.col("reference_payload"))}


def judge_variables() -> dict[str, Column]:
    """Of a row of ``pipeline.judge_requests``."""
    return {"question_text": F.col("question_text"), "reference_payload_json": indented(F.col("reference")), "prediction_payload_json": indented(F.col("prediction"))}


def by_task(pack: dict[str, str], variables: dict[str, Column]) -> Column:
    """The row's template, rendered; null for a task the pack has none for."""
    out = F.lit(None).cast("string")
    for task, template in pack.items():
        out = F.when(F.col("task_name") == task, text.render(template, variables)).otherwise(out)
    return out


def by_variant(packs: dict[str, dict[str, str]], variant: str) -> Column:
    """The upstream prompt of an oracle variant: only the two upstream tasks have one, and the truth must be there."""
    if variant not in packs:
        raise ValueError(f"no templates for variant {variant}")
    pack = {t: p for t, p in packs[variant].items() if t in (ACTIONS, GROUNDING)}
    return by_task(pack, oracle_variables())
