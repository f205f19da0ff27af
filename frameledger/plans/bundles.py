"""Prepared data below one folder: a table of prepared samples per protocol, its index, statistics and manifest.

A table is only read back under the protocol, its definition and the coordinate system it was built with."""
from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameledger.functions import sampling
from frameledger.operators import prepare
from frameledger.schemas import COORDINATE_MAX
from frameledger.sources import annotations as ann
from frameledger.sources import media

COORDINATES = f"normalized_{COORDINATE_MAX}"
#: Issues named in an error, and kept in a manifest.
SHOWN_ISSUES, KEPT_ISSUES = 50, 100


def check(samples: DataFrame, issues: DataFrame) -> dict:
    """The state of a dataset: counts, and the first KEPT_ISSUES messages; more than none is an error."""
    unsupported = {r["task_name"]: r["count"] for r in ann.unsupported(samples).groupBy("task_name").count().collect()}  # a row a task
    n = issues.count()
    kept = [r["message"] for r in issues.select("message").orderBy("message").limit(KEPT_ISSUES).collect()] if n else []
    state = {"supported_sample_count": ann.supported(samples).count(), "ignored_unsupported_sample_count": sum(unsupported.values()), "ignored_unsupported_task_counts": unsupported, "supported_issue_count": n, "issues": kept}
    if n:
        raise ValueError(f"{n} issues:\n" + "\n".join(kept[:SHOWN_ISSUES]))
    return state


def prepared_samples(samples: DataFrame, tracking: DataFrame, protocol: sampling.Protocol) -> DataFrame:
    """The prepared table of a protocol: frames, projected windows, reference payload."""
    with_path = ann.supported(samples).withColumn("tracking_path", ann.resolve_path(F.col("tracking_bboxes")))
    rows = prepare.reference_payloads(prepare.with_frames(with_path, protocol), tracking)
    level = F.col("task_level") if "task_level" in samples.columns else F.lit(None).cast("string")
    cols = ["sample_id", "annotation_id", "video_key", "task_name", level.alias("task_level"), "protocol_id", ann.question_text(F.col("question"), F.col("query")).alias("question_text"), "sampled_frames_original", media.frame_names(F.col("sampled_frames_original")).alias("frame_files"), "timestamp_frame", "q_window", "q_window_sampled", "a_window", "sampled_video_fps", F.col("tracking_path").alias("source_tracking_path"), "upstream_annotation_id", "reference_payload", F.lit(COORDINATES).alias("coordinate_system")]
    return rows.select(*cols)


def _write_json(spark: SparkSession, value: dict, path: str) -> None:
    spark.createDataFrame([(json.dumps(value, sort_keys=True, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def _read_json(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()[0])


def build(spark: SparkSession, samples: DataFrame, tracking: DataFrame, issues: DataFrame, specs: list[str], out: str, formats: list[str] | None = None, oracle_media: bool = False) -> list[dict]:
    """Writes ``out/<protocol_id>/{samples,index,stats,build_manifest}`` for every protocol, sorted by sample_id; fails
    before anything is written if the dataset has issues or two specs share a protocol id."""
    wanted = media.media_formats(formats or ["frames"])
    if oracle_media and set(wanted) != set(media.MEDIA_FORMATS):
        raise ValueError("oracle media need both formats")
    protocols = [(s, sampling.resolve(s)) for s in specs]
    seen: dict[str, str] = {}
    for spec, p in protocols:
        if seen.setdefault(p.protocol_id, spec) != spec:
            raise ValueError(f"{seen[p.protocol_id]!r} and {spec!r} have the same protocol id {p.protocol_id!r}")
    state = check(samples, issues)
    finger = ann.dataset_fingerprint(ann.supported(samples)).first()
    done = []
    for spec, p in protocols:
        root = f"{out}/{p.protocol_id}"
        prepared_samples(samples, tracking, p).repartitionByRange("sample_id").sortWithinPartitions("sample_id").write.mode("overwrite").parquet(f"{root}/samples")
        rows = spark.read.parquet(f"{root}/samples")
        rows.select("sample_id", "task_name", "video_key", "annotation_id", F.size("sampled_frames_original").alias("frame_count")).orderBy("sample_id").write.mode("overwrite").json(f"{root}/index")
        prepare.protocol_stats(rows).orderBy("task_name").write.mode("overwrite").json(f"{root}/stats")
        n = rows.count()
        _write_json(spark, {"protocol_id": p.protocol_id, "protocol_spec": spec, "protocol_manifest": p.manifest(), "data_status": state, "fingerprint": finger["fingerprint"], "num_prepared_samples": n, "coordinate_system": COORDINATES, "media_formats": sorted(wanted), "oracle_media": oracle_media}, f"{root}/build_manifest")
        done.append({"protocol_id": p.protocol_id, "num_prepared_samples": n, "root": root})
    return done


def write_chain_pairs(samples: DataFrame, issues: DataFrame, path: str) -> int:
    """The pairs of a dataset without issues as JSON lines in the order of their ids; gives their number."""
    check(samples, issues)
    pairs = ann.chain_pairs(ann.supported(samples))
    pairs.orderBy("pair_id").write.mode("overwrite").json(path)
    return pairs.count()


def load(spark: SparkSession, root: str, spec: str) -> DataFrame:
    """The prepared table of a protocol, in the order of sample_id; a manifest that does not fit is an error."""
    p = sampling.resolve(spec)
    found = _read_json(spark, f"{root}/{p.protocol_id}/build_manifest")
    for name, want in (("protocol_id", p.protocol_id), ("protocol_spec", spec), ("protocol_manifest", json.loads(json.dumps(p.manifest()))), ("coordinate_system", COORDINATES)):
        if found.get(name) != want:
            raise ValueError(f"{root}/{p.protocol_id}: {name} is {found.get(name)!r}, not {want!r}; build the data again")
    rows = spark.read.parquet(f"{root}/{p.protocol_id}/samples")
    bad = rows.where((F.col("coordinate_system") != COORDINATES) | ((F.size("sampled_frames_original") > 1) & F.col("sampled_video_fps").isNull())).select("sample_id").first()
    if bad:
        raise ValueError(f"{bad[0]}: wrong coordinates or no sampled rate; build the data again")
    return rows
