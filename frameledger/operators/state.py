"""Run state from append-only artifacts: reload, backfill, pending sets, chain checks, compaction."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def last_wins(artifacts: DataFrame, key: str | list[str], order: list[str], needs: str | list[str]) -> DataFrame:
    """Per key the last row in which all ``needs`` are non-null (ties in ``order`` are broken by its end).
    Reduced map-side, so a key written many times costs one row per task."""
    keys = [key] if isinstance(key, str) else key
    needs = [needs] if isinstance(needs, str) else needs
    kept = artifacts
    for n in needs:
        kept = kept.where(F.col(n).isNotNull())
    rest = [c for c in artifacts.columns if c not in keys]
    return kept.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")


def first_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r"), (F.count(F.lit(1)) - 1).alias("dropped")).select(*keys, "r.*", "dropped")


def backfill(predictions: DataFrame, structured: DataFrame, results: DataFrame) -> DataFrame:
    """sample_id, raw_output, structured_prediction: the state with precedence prediction, then structured
    record, then result; a result backfills a structured record only if it has both texts."""
    p = predictions.select("sample_id", F.col("raw_output").alias("p_raw"))
    s = structured.select("sample_id", F.col("raw_output").alias("s_raw"), F.col("structured_prediction").alias("s_pred"), F.lit(True).alias("s_there"))
    r = results.select("sample_id", F.col("raw_output").alias("r_raw"), F.col("structured_prediction").alias("r_pred"))
    j = p.join(s, "sample_id", "full").join(r, "sample_id", "full")
    both = F.col("r_raw").isNotNull() & F.col("r_pred").isNotNull()
    return j.select("sample_id", F.coalesce("p_raw", "s_raw", "r_raw").alias("raw_output"), F.when(F.col("s_there"), F.col("s_pred")).when(both, F.col("r_pred")).alias("structured_prediction"))


def pending(targets: DataFrame, predicted: DataFrame, structured: DataFrame, evaluated: DataFrame, key: str = "sample_id") -> DataFrame:
    """key, stage of every target that is not through: ``predict``, ``structure`` or ``evaluate``."""
    mark = lambda df, n: df.select(key).distinct().withColumn(n, F.lit(True))
    j = targets.select(key).distinct().join(mark(predicted, "p"), key, "left").join(mark(structured, "s"), key, "left").join(mark(evaluated, "e"), key, "left")
    stage = F.when(F.col("p").isNull(), "predict").when(F.col("s").isNull(), "structure").when(F.col("e").isNull(), "evaluate")
    return j.select(key, stage.alias("stage")).where(F.col("stage").isNotNull())


def progress(targets: DataFrame, done: dict[str, DataFrame], key: str = "sample_id") -> DataFrame:
    """stage, n: how many targets each stage has finished."""
    out = None
    for stage, df in done.items():
        n = targets.select(key).distinct().join(df.select(key), key, "left_semi").agg(F.count(F.lit(1)).alias("n")).select(F.lit(stage).alias("stage"), "n")
        out = n if out is None else out.unionByName(n)
    return out


def split_chain(samples: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Samples outside and inside the second step of a chain."""
    ends = pairs.select(F.col("downstream_sample_id").alias("sample_id"))
    return samples.join(ends, "sample_id", "left_anti"), samples.join(ends, "sample_id", "left_semi")


def chain_issues(pairs: DataFrame, prepared: DataFrame, downstream: DataFrame) -> DataFrame:
    """kind, sample_id of broken chain rules: ``duplicate_downstream``, ``uncovered`` (a second step without
    pair), ``upstream_unprepared`` and ``downstream_unprepared``."""
    dup = pairs.groupBy("downstream_sample_id").count().where("count > 1").select(F.lit("duplicate_downstream").alias("kind"), F.col("downstream_sample_id").alias("sample_id"))
    missing = downstream.select("sample_id").distinct().join(pairs.select(F.col("downstream_sample_id").alias("sample_id")), "sample_id", "left_anti").select(F.lit("uncovered").alias("kind"), "sample_id")
    out = dup.unionByName(missing)
    for end in ("upstream", "downstream"):
        ids = pairs.select(F.col(f"{end}_sample_id").alias("sample_id")).distinct()
        out = out.unionByName(ids.join(prepared.select("sample_id"), "sample_id", "left_anti").select(F.lit(f"{end}_unprepared").alias("kind"), "sample_id"))
    return out


def with_history(pairs: DataFrame, prompts: DataFrame, outputs: DataFrame) -> DataFrame:
    """pair_id, blocked, messages: the second step's messages behind the first step's prompt and answer;
    blocked (null messages) where the first step has no answer yet."""
    up = prompts.select(F.col("sample_id").alias("upstream_sample_id"), F.col("prompt").alias("up_prompt"))
    down = prompts.select(F.col("sample_id").alias("downstream_sample_id"), F.col("prompt").alias("down_prompt"))
    raw = outputs.select(F.col("sample_id").alias("upstream_sample_id"), F.col("raw_output").alias("up_raw"))
    j = pairs.join(up, "upstream_sample_id", "left").join(down, "downstream_sample_id", "left").join(raw, "upstream_sample_id", "left")
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), F.col(c).alias("content"))
    return j.select("pair_id", F.col("up_raw").isNull().alias("blocked"), F.when(F.col("up_raw").isNotNull(), F.array(turn("user", "up_prompt"), turn("assistant", "up_raw"), turn("user", "down_prompt"))).alias("messages"))


def failed_ids(errors: list[DataFrame]) -> DataFrame:
    """The distinct sample ids of several error lists."""
    out = errors[0].select("sample_id")
    for e in errors[1:]:
        out = out.unionByName(e.select("sample_id"))
    return out.distinct()


def compact(spark, path: str, key: str | list[str], order: list[str], needs: str | list[str]) -> str:
    """Writes the surviving rows of an artifact folder, sorted by key, beside it and gives the new path (Spark cannot
    overwrite what it reads): swapping it in is up to the caller, when no run is writing."""
    keys = [key] if isinstance(key, str) else key
    last_wins(spark.read.parquet(path), keys, order, needs).repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("errorifexists").parquet(f"{path}_compact")
    return f"{path}_compact"
