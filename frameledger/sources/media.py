"""Optional media plug-in: frames of videos, one decoding pass per video. Needs PyAV, which is imported only
when frames are asked for."""
from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameledger.schemas import COORDINATE_MAX

MEDIA_FORMATS = ("frames", "sampled_video")
#: Colour and width of an overlay's outline, size of the tag above it.
GREEN, OUTLINE, TAG = (0, 255, 0), 3, (58, 14, 16)


def need_pyav():
    try:
        import av
    except ImportError as e:
        raise RuntimeError("decoding videos needs the package 'av'") from e
    return av


def media_formats(wanted: list[str]) -> list[str]:
    """The distinct formats, in order; unknown ones are errors."""
    bad = [w for w in wanted if w not in MEDIA_FORMATS]
    if bad:
        raise ValueError(f"unknown media formats: {', '.join(bad)}")
    return list(dict.fromkeys(wanted))


def frame_names(frames):
    """0000.jpg, 0001.jpg ... for the sampled frames."""
    return F.transform(frames, lambda f, i: F.format_string("frames/%04d.jpg", i))


def decode(requests: DataFrame) -> DataFrame:
    """video_path, frame, jpeg of (video_path, frame): sorted per video, so each video is decoded once and only
    up to its last requested frame; a frame that is not there is an error."""

    def run(batches: Iterator) -> Iterator:
        av = need_pyav()
        import io

        import pandas as pd

        for pdf in batches:
            out = []
            for path, wanted in pdf.groupby("video_path")["frame"]:
                left = set(wanted)
                with av.open(path) as container:
                    for i, picture in enumerate(container.decode(video=0)):
                        if i in left:
                            body = io.BytesIO()
                            picture.to_image().save(body, format="JPEG")
                            out.append((path, i, body.getvalue()))
                            left.discard(i)
                        if not left:
                            break
                if left:
                    raise ValueError(f"{path}: no frames {sorted(left)[:5]}")
            yield pd.DataFrame(out, columns=["video_path", "frame", "jpeg"])

    return requests.select("video_path", "frame").distinct().repartition("video_path").sortWithinPartitions("video_path", "frame").mapInPandas(run, "video_path string, frame bigint, jpeg binary")


def pixel_corners(box, width: int, height: int) -> tuple[int, int, int, int]:
    """Corners of a normalized left-top-width-height box, rounded half to even and kept in the frame; at least a pixel
    wide and high where the frame allows."""
    left, top, w, h = (float(v) for v in box)
    ends = [(left, width), (top, height), (left + w, width), (top + h, height)]
    x1, y1, x2, y2 = (int(min(max(np.rint(v * d / COORDINATE_MAX), 0), d - 1)) for v, d in ends)
    return x1, y1, max(x2, min(width - 1, x1 + 1)), max(y2, min(height - 1, y1 + 1))


def overlay(picture: np.ndarray, boxes: list) -> np.ndarray:
    """A copy of a picture (height x width x 3) with the outline of every box and a tag above it."""
    out = picture.copy()
    height, width = out.shape[:2]
    for box in boxes:
        x1, y1, x2, y2 = pixel_corners(box, width, height)
        inside = np.zeros((height, width), bool)
        inside[y1 + OUTLINE : max(y1 + OUTLINE, y2 + 1 - OUTLINE), x1 + OUTLINE : max(x1 + OUTLINE, x2 + 1 - OUTLINE)] = True
        edge = np.zeros((height, width), bool)
        edge[y1 : y2 + 1, x1 : x2 + 1] = True
        out[edge & ~inside] = GREEN
        top = max(0, y1 - TAG[2])
        out[top : min(height, top + TAG[1] + 1), x1 : min(width, x1 + TAG[0] + 1)] = GREEN
    return out


def write_video(path: str, pictures: list[np.ndarray], fps: float) -> None:
    """The pictures as an H.264 video of even size at the sampled rate."""
    av = need_pyav()
    try:
        av.CodecContext.create("libx264", "w")
    except Exception as e:
        raise RuntimeError("sampled videos need the encoder libx264") from e
    height, width = (d - d % 2 for d in pictures[0].shape[:2])
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with av.open(path, "w") as container:
        stream = container.add_stream("libx264", rate=Fraction(fps).limit_denominator(100_000))
        stream.width, stream.height, stream.pix_fmt = width, height, "yuv420p"
        for picture in pictures:
            container.mux(stream.encode(av.VideoFrame.from_ndarray(np.ascontiguousarray(picture[:height, :width]), format="rgb24")))
        container.mux(stream.encode())


def write_bundles(prepared: DataFrame, video_root: str, out: str, formats: list[str], oracle: bool = False) -> DataFrame:
    """sample_id, frame_files, sampled_video_file, oracle_frame_files, oracle_video_file of every prepared sample, its media
    written below ``out/<video_key>/<annotation_id>`` (a folder all workers share). One pass over each video, which
    holds the frames its samples share; a sample without any media is an error."""
    wanted = media_formats(formats)

    def run(pdfs: Iterator) -> Iterator:
        import io

        import pandas as pd

        av = need_pyav()
        for pdf in pdfs:
            rows = []
            for key, group in pdf.groupby("video_key"):
                left = {int(f) for frames in group["sampled_frames_original"] for f in frames}
                held = {}
                with av.open(f"{video_root}/{key}.mp4") as container:
                    for i, picture in enumerate(container.decode(video=0)):
                        if i in left:
                            held[i] = picture.to_ndarray(format="rgb24")
                            left.discard(i)
                        if not left:
                            break
                if left:
                    raise ValueError(f"{key}: no frames {sorted(left)[:5]}")
                for r in group.itertuples():
                    base = Path(out) / key / str(r.annotation_id)
                    pictures = [held[int(f)] for f in r.sampled_frames_original]
                    row = {"sample_id": r.sample_id, "frame_files": [], "sampled_video_file": None, "oracle_frame_files": [], "oracle_video_file": None}

                    def save(folder: str, shown: list, base=base) -> list[str]:
                        names = []
                        for i, picture in enumerate(shown):
                            body = io.BytesIO()
                            av.VideoFrame.from_ndarray(picture, format="rgb24").to_image().save(body, format="JPEG", quality=95)
                            (base / folder).mkdir(parents=True, exist_ok=True)
                            (base / folder / f"{i:04d}.jpg").write_bytes(body.getvalue())
                            names.append(str(base / folder / f"{i:04d}.jpg"))
                        return names

                    if "frames" in wanted:
                        row["frame_files"] = save("frames", pictures)
                    if "sampled_video" in wanted and r.sampled_video_fps == r.sampled_video_fps and len(pictures) > 1:
                        row["sampled_video_file"] = str(base / "sampled_video.mp4")
                        write_video(row["sampled_video_file"], pictures, r.sampled_video_fps)
                    if oracle and r.tracking is not None and len(r.tracking):
                        at: dict[int, list] = {}
                        for t in r.tracking:
                            at.setdefault(int(t["frame_sampled"]), []).append(t["bbox_mot"])
                        drawn = [overlay(p, at.get(i, [])) for i, p in enumerate(pictures)]
                        row["oracle_frame_files"] = save("oracle_visual/frames", drawn)
                        row["oracle_video_file"] = str(base / "oracle_visual" / "sampled_video.mp4")
                        write_video(row["oracle_video_file"], drawn, r.sampled_video_fps)
                    if not row["frame_files"] and row["sampled_video_file"] is None:
                        raise ValueError(f"{r.sample_id}: no media")
                    rows.append(row)
            yield pd.DataFrame(rows, columns=["sample_id", "frame_files", "sampled_video_file", "oracle_frame_files", "oracle_video_file"])

    asked = prepared.where(F.size("sampled_frames_original") > 0).select("sample_id", "video_key", "annotation_id", "sampled_frames_original", "sampled_video_fps", F.col("reference_payload.tracking_gt_sampled").alias("tracking"))
    # the frames of a video are decoded once per partition that has some of its samples: blocks keep a hot video spread
    block = F.floor(F.get("sampled_frames_original", F.lit(0)) / 10_000)
    return asked.withColumn("block", block).repartition("video_key", "block").sortWithinPartitions("video_key").drop("block").mapInPandas(run, "sample_id string, frame_files array<string>, sampled_video_file string, oracle_frame_files array<string>, oracle_video_file string")
