"""From annotations to prepared samples: sampling, alignment of tracking, projection, statistics."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameledger.functions import geometry, sampling
from frameledger.schemas import ACTIONS, CAPTIONS, GROUNDING
from frameledger.sources import annotations as ann


def with_frames(samples: DataFrame, protocol: sampling.Protocol) -> DataFrame:
    """Adds sampled_frames_original, q_window_sampled, sampled_video_fps and protocol_id.

    ``samples``: task_name, timestamp_frame, q_window, a_window (structs), total_frames. A sample without
    what its task needs gets null frames."""
    c = F.col
    frames = protocol.frames(c("task_name"), c("timestamp_frame"), (c("q_window.start"), c("q_window.end")), (c("a_window.start"), c("a_window.end")), c("total_frames"))
    out = samples.where(protocol.supports(c("task_name"))).withColumn("sampled_frames_original", frames)
    f = c("sampled_frames_original")
    return out.withColumns({"q_window_sampled": sampling.project(c("q_window.start"), c("q_window.end"), f), "sampled_video_fps": sampling.sampled_fps(f), "protocol_id": F.lit(protocol.protocol_id)})


def segments_sampled(segments: Column, frames: Column) -> Column:
    """Caption segments in positions of the sampled frames; each interval is projected once."""
    done = F.transform(segments, lambda s: F.struct(sampling.project(s["start_frame"], s["end_frame"], frames).alias("i"), s["text"].alias("text")))
    return F.transform(done, lambda s: F.struct(s["i"]["start"].alias("start_sampled"), s["i"]["end"].alias("end_sampled"), s["text"].alias("text")))


def align_tracking(samples: DataFrame, tracking: DataFrame) -> DataFrame:
    """sample_id, frame_sampled, frame_original, bbox_mot (normalized): the readings on the sampled frames.

    ``samples`` (of the written prepared table): sample_id, tracking_path, sampled_frames_original, width,
    height and ``valid`` (closed interval to keep, or null). ``tracking``: tracking_path, frame_original, box sides and ``ord``; of several
    readings of a frame the last counts. An equi-join on (path, frame), so a video with a tenth of all rows
    is spread over its frames."""
    box = F.array("box_left", "box_top", "box_width", "box_height")
    last = tracking.groupBy("tracking_path", "frame_original").agg(F.max_by(box, "ord").alias("box"))
    s = samples.select("sample_id", "tracking_path", "width", "height", "valid", F.posexplode("sampled_frames_original").alias("frame_sampled", "frame_original"))
    s = s.where(F.col("valid").isNull() | F.col("frame_original").between(F.col("valid.start"), F.col("valid.end")))
    j = s.join(last, ["tracking_path", "frame_original"])
    return j.select("sample_id", F.col("frame_sampled").cast("bigint").alias("frame_sampled"), "frame_original", geometry.normalize_box(F.col("box"), F.col("width"), F.col("height")).alias("bbox_mot"))


def protocol_stats(prepared: DataFrame) -> DataFrame:
    """Per protocol and task: samples, sampled frames in all and on average (0 for none)."""
    n = F.coalesce(F.size("sampled_frames_original"), F.lit(0))
    n = F.when(n < 0, 0).otherwise(n)
    g = prepared.groupBy("protocol_id", "task_name").agg(F.count(F.lit(1)).alias("num_samples"), F.sum(n).cast("bigint").alias("total_sampled_frames"))
    return g.withColumn("avg_sampled_frames", F.col("total_sampled_frames") / F.col("num_samples"))


def union_frames(prepared: DataFrame) -> DataFrame:
    """video_key, frame_original: every frame a video's decoder has to yield, once. Rows, not one array per
    video, so that a video with a tenth of all samples stays spread."""
    return prepared.select("video_key", F.explode("sampled_frames_original").alias("frame_original")).distinct()


def own_payload() -> dict[str, Column]:
    """The parts of a reference payload that an annotation itself gives, of a row with frames (see ``with_frames``),
    resolution and the raw answer, a_window_frame and bounding_box. Parts a task does not have are null."""
    c, task = F.col, F.col("task_name")
    width, height = F.get("resolution", F.lit(0)), F.get("resolution", F.lit(1))
    corners = F.transform(F.from_json("bounding_box", "array<string>"), lambda v: v.try_cast("double"))
    objects = F.transform(ann.labelled_objects(c("bounding_box")), lambda o: F.struct(o["label"].alias("label"), geometry.normalize_box(o["bbox"], width, height).alias("bbox")))
    captions = segments_sampled(ann.segments(c("a_window_frame"), c("answer")), c("sampled_frames_original"))
    window = sampling.project(c("a_window.start"), c("a_window.end"), c("sampled_frames_original"))
    return {
        "text": F.when(~task.isin(*CAPTIONS, GROUNDING), ann.plain_text(c("answer"))),
        "bbox": F.when(task == "Scoreboard_Single", geometry.normalize_box(corners, width, height)),
        "objects": F.when(task == "Objects_Spatial_Relationships", objects),
        "segments_sampled": F.when(task.isin(CAPTIONS), captions),
        "time_window_sampled": F.when((task == GROUNDING) & window.isNotNull(), F.array(window["start"], window["end"])),
    }


def reference_payloads(samples: DataFrame, tracking: DataFrame) -> DataFrame:
    """``samples`` with ``reference_payload``: the annotation's own parts, and the readings on the sampled frames for the
    tasks that track (within the answer's window for grounding). A sample has at most as many readings as frames."""
    tracked = samples.where(F.col("task_name").isin(ACTIONS, GROUNDING) & F.col("tracking_path").isNotNull())
    width, height = F.get("resolution", F.lit(0)), F.get("resolution", F.lit(1))
    valid = F.when(F.col("task_name") == GROUNDING, F.col("a_window"))
    read = align_tracking(tracked.select("sample_id", "tracking_path", "sampled_frames_original", width.alias("width"), height.alias("height"), valid.alias("valid")), tracking)
    rows = read.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("frame_sampled", "frame_original", "bbox_mot"))).alias("__track"))
    none = F.when(F.col("task_name").isin(ACTIONS, GROUNDING), F.array().cast("array<struct<frame_sampled:bigint,frame_original:bigint,bbox_mot:array<double>>>"))
    payload = F.struct(*[v.alias(k) for k, v in own_payload().items()], F.coalesce("__track", none).alias("tracking_gt_sampled"))
    return samples.join(rows, "sample_id", "left").withColumn("reference_payload", payload).drop("__track")


def oracle_media(samples: DataFrame, variant: str) -> DataFrame:
    """Upstream samples as an oracle variant shows them: the visual ones swap in the overlay media. ``error`` says
    which is missing (null: none)."""
    if variant == "language":
        return samples.withColumn("error", F.lit(None).cast("string"))
    missing = F.when(F.coalesce(F.size("oracle_frame_files"), F.lit(0)) <= 0, "missing oracle frames").when(F.col("oracle_video_file").isNull(), "missing oracle video")
    return samples.withColumns({"error": missing, "frame_files": F.col("oracle_frame_files"), "sampled_video_file": F.col("oracle_video_file")})
