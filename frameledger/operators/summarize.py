"""Summaries: per task, overall, and the linked two-step evaluation."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameledger.schemas import ACTIONS, UPSTREAM_TASKS


def task_summary(targets: DataFrame, records: DataFrame, keys: list[str]) -> DataFrame:
    """Per task: samples, scored, pending, accuracy and the means of the components that tasks have.

    ``records``: task_name, task_pass, judge_pass, bbox_passes array<int>, tiou_pass, tracking_mean_iou,
    tracking_pass_rate, text_f1. A component no record has stays null; a pooled rate counts each box. All sums are
    taken per task and text score first, map-side; the exact median then weighs the distinct scores, so no task
    gathers the scores of all its rows."""
    mine = [c for c in records.columns if c not in ("task_name",)]
    j = targets.select(*keys, "task_name").join(records.select(*mine), keys, "left")
    boxes = F.filter("bbox_passes", lambda x: x.isNotNull())
    means = {"task_accuracy": "task_pass", "judge_pass_rate": "judge_pass", "tiou_pass_rate": "tiou_pass", "tracking_mean_iou_mean": "tracking_mean_iou", "tracking_pass_rate_mean": "tracking_pass_rate"}
    sums = [F.count(F.lit(1)).alias("num_samples"), F.count("task_pass").alias("num_scored_samples"), F.sum(F.aggregate(boxes, F.lit(0), lambda a, x: a + x)).alias("hits"), F.sum(F.size(boxes)).alias("boxes")]
    for c in means.values():
        sums += [F.sum(c).alias(f"s_{c}"), F.count(c).alias(f"n_{c}")]
    part = j.withColumn("bbox_passes", F.coalesce("bbox_passes", F.array().cast("array<int>"))).groupBy("task_name", "text_f1").agg(*sums)
    n = F.when(F.col("text_f1").isNotNull(), F.col("num_samples"))
    share = lambda a, b: F.try_divide(F.sum(a), F.sum(b))
    g = part.groupBy("task_name").agg(
        F.sum("num_samples").alias("num_samples"),
        F.sum("num_scored_samples").alias("num_scored_samples"),
        *[share(f"s_{c}", f"n_{c}").alias(name) for name, c in means.items()],
        share(F.col("text_f1") * n, n).alias("mean_text_f1"),
        F.percentile("text_f1", 0.5, F.coalesce(n, F.lit(0))).alias("median_text_f1"),
        share("hits", "boxes").alias("bbox_pass_rate"),
    )
    return g.withColumn("num_pending_samples", F.col("num_samples") - F.col("num_scored_samples"))


def overall(summary: DataFrame) -> DataFrame:
    """The unweighted mean of the accuracies of the tasks that have one."""
    return summary.agg(F.avg("task_accuracy").alias("overall"), F.count("task_accuracy").alias("num_tasks"))


def chain_components(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """Each pair with the component passes of both its ends; ``scored`` if both are evaluated."""
    u = records.select(F.col("sample_id").alias("upstream_sample_id"), F.col("tracking_pass").alias("u_tracking"), F.col("judge_pass").alias("u_judge"), F.col("tiou_pass").alias("u_tiou"), F.lit(True).alias("u_there"))
    d = records.select(F.col("sample_id").alias("downstream_sample_id"), F.col("judge_pass").alias("d_judge"), F.lit(True).alias("d_there"))
    j = pairs.join(u, "upstream_sample_id", "left").join(d, "downstream_sample_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    seen = F.when(F.col("upstream_task_name") == ACTIONS, zero(F.col("u_judge"))).otherwise(zero(F.col("u_tiou")))
    scored = F.col("u_there").isNotNull() & F.col("d_there").isNotNull()
    return j.select("pair_id", "upstream_task_name", scored.alias("scored"), F.when(scored, seen).alias("plain"), F.when(scored, seen * zero(F.col("u_tracking"))).alias("full"), F.when(scored, zero(F.col("d_judge"))).alias("reasoning"))


def _by_task(column: str) -> list:
    return [F.avg(F.when(F.col("upstream_task_name") == t, F.col(column))).alias(f"{column}_{t}") for t in UPSTREAM_TASKS]


def chain_summary(components: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Understanding, reasoning and chain success over the scored pairs; per ``group`` (the oracle variant)."""
    done = F.col("scored").cast("bigint")
    g = components.groupBy(*(group or []))
    out = g.agg(
        F.count(F.lit(1)).alias("num_chain_samples"), F.sum(done).alias("num_scored_chain_samples"), F.sum(1 - done).alias("num_pending_chain_samples"),
        F.avg("full").alias("understanding_acc"), F.avg("plain").alias("understanding_acc_wo_track"), F.avg("reasoning").alias("reasoning_acc"),
        F.avg(F.col("full") * F.col("reasoning")).alias("chain_success"), F.avg(F.col("plain") * F.col("reasoning")).alias("chain_success_wo_track"), *_by_task("full"), *_by_task("plain"),
    )
    return out


def oracle_components(pairs: DataFrame, variants: DataFrame, results: DataFrame) -> DataFrame:
    """Pairs x variants (three rows) with the results of their reruns: ``results`` has variant, pair_id,
    up_judge, up_tiou, down_judge. No tracking is scored, the truth was given."""
    names = [r["variant"] for r in variants.select("variant").distinct().collect()]  # three
    j = pairs.withColumn("variant", F.explode(F.array(*[F.lit(v) for v in names]))).join(results, ["variant", "pair_id"], "left")
    there = F.col("has_result").isNotNull()
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    seen = F.when(F.col("upstream_task_name") == ACTIONS, zero("up_judge")).otherwise(zero("up_tiou"))
    return j.select("variant", "pair_id", "upstream_task_name", there.alias("scored"), F.when(there, seen).alias("plain"), F.lit(None).cast("int").alias("full"), F.when(there, zero("down_judge")).alias("reasoning"))


def combined_chain_summary(base: DataFrame, oracle: DataFrame | None = None) -> DataFrame:
    """The base chain summary and, below it, that of each oracle variant: ``experiment`` is ``base`` or
    ``oracle_<variant>``. Measures that a rerun does not have (tracking was given) are null."""
    out = base.withColumn("experiment", F.lit("base"))
    if oracle is not None:
        out = out.unionByName(oracle.withColumn("experiment", F.concat(F.lit("oracle_"), "variant")).drop("variant"))
    return out.select("experiment", *[c for c in out.columns if c != "experiment"])
