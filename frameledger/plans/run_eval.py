"""A resumable evaluation run over tables below one folder: predict, structure, judge, evaluate, summarize.

State is derived from what is written, never stored: every stage appends the rows it finished and skips the
ids that are there, so a run that broke off continues where it stopped."""
from __future__ import annotations

import json
import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameledger.operators import evaluate, predict, prepare, prompts, state, structure, summarize, textscore
from frameledger.plans import pipeline
from frameledger.schemas import TASKS, UPSTREAM_TASKS, VARIANTS
from frameledger.session import ship
from frameledger.sources.annotations import template_pack

KEYS = ["sample_id", "protocol_id"]


@dataclass
class RunConfig:
    """Options of a run; paths are taken relative to the file they are read from."""

    prepared: str
    out: str
    adapter: str = "mock"
    judge: str = "static-pass"
    chain_pairs: str | None = None
    invalid_json_retries: int = 2
    packs: dict = field(default_factory=dict)
    extra: dict = field(default_factory=dict)

    @classmethod
    def load(cls, path: str) -> RunConfig:
        with open(path, "rb") as f:
            section = tomllib.load(f)["run_eval"]
        unknown = set(section) - set(cls.__dataclass_fields__)
        if unknown:
            raise ValueError(f"unknown options: {', '.join(sorted(unknown))}")
        if section.get("invalid_json_retries", 0) < 0:
            raise ValueError("invalid_json_retries must not be negative")
        base = Path(path).parent
        for k in ("prepared", "out", "chain_pairs"):
            if section.get(k):
                section[k] = str((base / section[k]).resolve())
        section["packs"] = {k: str((base / v).resolve()) for k, v in section.get("packs", {}).items()}
        return cls(**section)


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except Exception as e:  # nothing is written yet
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise


def stage(spark: SparkSession, todo: DataFrame, path: str, work, needs: str) -> DataFrame:
    """Runs ``work`` on the rows of ``todo`` not finished in ``path``, appends, and gives the finished rows."""
    done = _read(spark, path)
    open_ = todo if done is None else todo.join(done.where(F.col(needs).isNotNull()).select(*KEYS), KEYS, "left_anti")
    work(open_).withColumn("run_at", F.current_timestamp()).write.mode("append").parquet(path)
    return state.last_wins(_read(spark, path), KEYS, ["run_at"], needs)


@dataclass
class Packs:
    """Templates of a run, task -> text; ``oracle``: variant -> task -> text. Where a pack is missing, the bare question
    (or the raw output, or the payloads) is handed on."""

    model: dict[str, str] | None = None
    structurer: dict[str, str] | None = None
    oracle_structurer: dict[str, str] | None = None
    judge: dict[str, str] | None = None
    oracle: dict[str, dict[str, str]] | None = None

    @classmethod
    def load(cls, spark: SparkSession, roots: dict[str, str]) -> Packs:
        """From folders of Markdown files: keys as the fields above, ``oracle`` a folder with one per variant."""
        pack = lambda key, allowed, tasks=None: template_pack(spark, roots[key], allowed, tasks) if key in roots else None
        judged = [t[0] for t in TASKS if t[3] != "none"]
        oracle = {v: template_pack(spark, f"{roots['oracle']}/{v}", prompts.ORACLE_VARIABLES, UPSTREAM_TASKS) for v in VARIANTS} if "oracle" in roots else None
        return cls(pack("model", prompts.SAMPLE_VARIABLES), pack("structurer", prompts.STRUCTURER_VARIABLES), pack("oracle_structurer", prompts.STRUCTURER_VARIABLES, UPSTREAM_TASKS), pack("judge", prompts.JUDGE_VARIABLES, judged), oracle)


def _ask(rows: DataFrame, prompt, error=None) -> DataFrame:
    """``rows`` with messages; a row without a prompt keeps an error instead (and is tried again by the next run)."""
    turn = F.array(F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content")))
    wrong = F.when(F.col("prompt").isNull(), "no prompt could be rendered")
    return rows.withColumn("prompt", prompt).withColumn("messages", turn).withColumn("prompt_error", F.coalesce(error, wrong) if error is not None else wrong)


def _answers(spark: SparkSession, rows: DataFrame, path: str, adapter: predict.Adapter | None, echo: DataFrame) -> DataFrame:
    """Answers to rows with messages (without an adapter the reference, echoed); rows with a prompt_error are not asked."""
    def work(t: DataFrame) -> DataFrame:
        ready = t.where("prompt_error is null")
        if adapter is None:
            done = ready.select(*KEYS).join(echo, KEYS).withColumn("error", F.lit(None).cast("string"))
        else:
            done = predict.predict(ready.drop("prompt_error"), adapter)
        failed = t.where("prompt_error is not null").select(*KEYS, F.lit(None).cast("string").alias("raw_output"), F.col("prompt_error").alias("error"))
        return done.unionByName(failed)

    return stage(spark, rows, path, work, "raw_output")


def _structured(spark: SparkSession, rows: DataFrame, path: str, pack: dict[str, str] | None, backend: structure.Backend | None, oracle: bool) -> DataFrame:
    """Verdicts on rows with raw_output, task_name and reference_payload: through the backend with its rendered prompt, or
    from the raw output itself."""
    named = F.transform("reference_payload.objects", lambda o: o["label"]).alias("labels")
    prompt = prompts.by_task(pack, prompts.structurer_variables()) if pack else F.col("raw_output")

    def work(t: DataFrame) -> DataFrame:
        if backend is None:
            return structure.structure_responses(t.select(*KEYS, "task_name", F.col("raw_output").alias("response"), named), oracle)
        return structure.structure_with(t.select(*KEYS, "task_name", named, prompt.alias("prompt"), "raw_output"), backend, oracle)

    return stage(spark, rows, path, work, "prediction")


def _judged(spark: SparkSession, rows: DataFrame, verdicts: DataFrame, path: str, pack: dict[str, str] | None, backend: predict.Judge) -> DataFrame:
    """Decisions on the rows that need one; a call that fails or stays malformed has an error and is asked again later."""
    asked = pipeline.judge_requests(rows, verdicts)
    asked = asked.withColumn("prompt", prompts.by_task(pack, prompts.judge_variables()) if pack else F.concat_ws("\n", "question_text", "reference", "prediction"))
    return stage(spark, asked, path, lambda t: predict.judge(t, backend), "decision")


def _evaluated(rows: DataFrame, verdicts: DataFrame, decisions: DataFrame, oracle: bool, scorer: textscore.Scorer | None = None) -> DataFrame:
    told = rows.select(*KEYS, "task_name", "reference_payload").join(decisions.select(*KEYS, "decision"), KEYS, "left")
    score = textscore.text_score(scorer) if scorer else evaluate.token_f1
    return pipeline.evaluate_predictions(told, verdicts, F.col("decision"), oracle, score)


def run(spark: SparkSession, prepared: DataFrame, out: str, adapter: predict.Adapter | None = None, judge: predict.Judge | None = None, pairs: DataFrame | None = None, packs: Packs | None = None, structurer: structure.Backend | None = None, scorer: textscore.Scorer | None = None) -> dict:
    """One pass; returns the summary and writes it to ``out/summary``. Without an adapter the reference is
    echoed. The second steps of chains wait for their first step's answer; those without one are blocked. A row
    whose judge call failed is pending: it has no record until a later run gets its decision."""
    packs = packs or Packs()
    rows = prepared if "question_text" in prepared.columns else prepared.withColumn("question_text", F.lit(""))
    prompt = prompts.by_task(packs.model, prompts.sample_variables()) if packs.model else F.coalesce("question_text", F.lit(""))
    asked = _ask(rows, prompt)
    question = asked.select(*KEYS, "task_name", "messages", "prompt", "prompt_error")
    echo = pipeline.mock_responses(rows).select(*KEYS, F.col("response").alias("raw_output"))
    first, second = (question, None) if pairs is None else state.split_chain(question, pairs)
    answers = _answers(spark, first.drop("prompt"), f"{out}/predictions", adapter, echo)
    blocked = 0
    if second is not None:
        h = state.with_history(pairs, question.select("sample_id", "prompt"), answers).join(pairs.select("pair_id", "downstream_sample_id"), "pair_id")
        blocked = h.where("blocked").count()
        told = h.where("not blocked").select(F.col("downstream_sample_id").alias("sample_id"), "messages")
        ready = second.drop("messages", "prompt").join(told, "sample_id").select(*KEYS, "task_name", "messages", "prompt_error")
        answers = _answers(spark, ready, f"{out}/predictions", adapter, echo)
    base = rows.select(*KEYS, "task_name", "question_text", "reference_payload")
    verdicts = _structured(spark, base.join(answers.select(*KEYS, "raw_output"), KEYS), f"{out}/structured", packs.structurer, structurer, False)
    decisions = _judged(spark, base, verdicts, f"{out}/decisions", packs.judge, judge or predict.StaticJudge(1))
    _evaluated(base, verdicts, decisions, False, scorer).repartitionByRange("sample_id").sortWithinPartitions("sample_id").write.mode("overwrite").parquet(f"{out}/evaluations")
    records = spark.read.parquet(f"{out}/evaluations")
    table = summarize.task_summary(rows, records, KEYS)
    table.orderBy("task_name").write.mode("overwrite").json(f"{out}/summary")
    if pairs is not None:
        summarize.chain_summary(summarize.chain_components(pairs, records)).write.mode("overwrite").json(f"{out}/chain_summary")
    total = summarize.overall(table).first()
    return {"overall": total["overall"], "num_tasks": total["num_tasks"], "blocked": blocked, "pending": {r["stage"]: r["count"] for r in state.pending(prepared, answers, verdicts, records).groupBy("stage").count().collect()}}


#: The stages of a rerun, by which its errors are told apart.
ORACLE_STAGES = ["oracle_upstream_prediction", "oracle_upstream_structuring", "oracle_upstream_evaluation", "oracle_downstream_prediction", "oracle_downstream_structuring", "oracle_downstream_evaluation"]


def oracle_pairs(spark: SparkSession, prepared: DataFrame, out: str, variant: str, pairs: DataFrame, adapter: predict.Adapter | None, judge: predict.Judge | None, packs: Packs | None = None, structurer: structure.Backend | None = None) -> tuple[DataFrame, DataFrame]:
    """One variant's rerun of the two ends of every pair: (results, errors).

    The first step is asked with the truth in its prompt (and, in the visual variants, with the overlay media in place
    of its own), its tracking is neither asked for nor scored; the second step follows in the same conversation, with its
    ordinary prompt. All stages are keyed by (pair, protocol) below ``out/<variant>``, so what is finished is not
    repeated. ``results``: variant, pair_id, up_judge, up_tiou, down_judge. ``errors``: variant, pair_id, stage, error."""
    packs = packs or Packs()
    judge = judge or predict.StaticJudge(1)
    root = f"{out}/{variant}"
    rows = prepared if "question_text" in prepared.columns else prepared.withColumn("question_text", F.lit(""))
    keyed = lambda end: pairs.select(F.col("pair_id"), F.col(f"{end}_sample_id").alias("sample_id")).join(rows, "sample_id").drop("sample_id").withColumnRenamed("pair_id", "sample_id")
    up, down = keyed("upstream"), keyed("downstream")
    shown = prepare.oracle_media(up if "oracle_frame_files" in up.columns else up.withColumns({"oracle_frame_files": F.lit(None).cast("array<string>"), "oracle_video_file": F.lit(None).cast("string")}), variant)
    prompt = prompts.by_variant(packs.oracle, variant) if packs.oracle else F.concat_ws("\n", "question_text", prompts.oracle_variables()["oracle_tracking_json"])
    need = F.when(F.col("reference_payload.tracking_gt_sampled").isNull(), "no true tracking to give")
    first = _ask(shown, prompt, F.coalesce(F.col("error"), need))
    answers = _answers(spark, first.select(*KEYS, "task_name", "messages", "prompt_error", "frame_files" if "frame_files" in first.columns else F.lit(None).alias("frame_files")), f"{root}/upstream_predictions", adapter, pipeline.mock_responses(up).select(*KEYS, F.col("response").alias("raw_output")))
    base = lambda df: df.select(*KEYS, "task_name", "question_text", "reference_payload")
    up_verdicts = _structured(spark, base(up).join(answers.select(*KEYS, "raw_output"), KEYS), f"{root}/upstream_structured", packs.oracle_structurer, structurer, True)
    up_decisions = _judged(spark, base(up), up_verdicts, f"{root}/upstream_decisions", packs.judge, judge)
    up_records = _evaluated(base(up), up_verdicts, up_decisions, True)
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), F.col(c).alias("content"))
    plain = prompts.by_task(packs.model, prompts.sample_variables()) if packs.model else F.coalesce("question_text", F.lit(""))
    second = _ask(down, plain).join(up_records.select(*KEYS), KEYS).join(first.select(*KEYS, F.col("prompt").alias("up_prompt")), KEYS).join(answers.select(*KEYS, F.col("raw_output").alias("up_raw")), KEYS)
    second = second.withColumn("messages", F.array(turn("user", "up_prompt"), turn("assistant", "up_raw"), turn("user", "prompt")))
    replies = _answers(spark, second.select(*KEYS, "task_name", "messages", "prompt_error"), f"{root}/downstream_predictions", adapter, pipeline.mock_responses(down).select(*KEYS, F.col("response").alias("raw_output")))
    down_verdicts = _structured(spark, base(down).join(replies.select(*KEYS, "raw_output"), KEYS), f"{root}/downstream_structured", packs.structurer, structurer, False)
    down_decisions = _judged(spark, base(down), down_verdicts, f"{root}/downstream_decisions", packs.judge, judge)
    down_records = _evaluated(base(down), down_verdicts, down_decisions, False)
    both = up_records.select(*KEYS, F.col("judge_pass").alias("up_judge"), F.col("tiou_pass").alias("up_tiou")).join(down_records.select(*KEYS, F.col("judge_pass").alias("down_judge")), KEYS)
    results = both.select(F.lit(variant).alias("variant"), F.col("sample_id").alias("pair_id"), "up_judge", "up_tiou", "down_judge", F.lit(True).alias("has_result"))
    folders = [("upstream_predictions", "raw_output", F.col("error")), ("upstream_structured", "prediction", F.coalesce("fatal", F.array_join("errors", "; "))), ("upstream_decisions", "decision", F.col("error")), ("downstream_predictions", "raw_output", F.col("error")), ("downstream_structured", "prediction", F.coalesce("fatal", F.array_join("errors", "; "))), ("downstream_decisions", "decision", F.col("error"))]
    errors = None
    for name, (folder, needs, says) in zip(ORACLE_STAGES, folders):
        t = _read(spark, f"{root}/{folder}")
        last = t.withColumn("ok", F.col(needs).isNotNull()).groupBy(*KEYS).agg(F.max("ok").alias("ok"), F.max_by(says, "run_at").alias("error")).where("not ok")
        part = last.select(F.lit(variant).alias("variant"), F.col("sample_id").alias("pair_id"), F.lit(name).alias("stage"), "error")
        errors = part if errors is None else errors.unionByName(part)
    return results, errors


def oracle_runs(spark: SparkSession, prepared: DataFrame, out: str, adapter: predict.Adapter | None, judge: predict.Judge | None, pairs: DataFrame, packs: Packs | None = None, structurer: structure.Backend | None = None) -> DataFrame:
    """The chain summary per variant of the reruns with the truth given; results and errors are written below ``out``.
    Finished (variant, pair)s are not repeated."""
    for v in VARIANTS:
        results, errors = oracle_pairs(spark, prepared, out, v, pairs, adapter, judge, packs, structurer)
        results.write.mode("overwrite").parquet(f"{out}/{v}/results")
        errors.write.mode("overwrite").parquet(f"{out}/{v}/errors")
    parts = spark.read.parquet(*[f"{out}/{v}/results" for v in VARIANTS])
    variants = spark.createDataFrame([(v,) for v in VARIANTS], "variant string")
    return summarize.chain_summary(summarize.oracle_components(pairs, variants, parts), ["variant"])


def main(argv: list[str] | None = None) -> int:
    """``python -m frameledger.plans.run_eval CONFIG.toml``"""
    import sys

    args = sys.argv[1:] if argv is None else argv
    config = RunConfig.load(args[0])
    spark = SparkSession.builder.getOrCreate()
    ship(spark)
    adapter = None if config.adapter == "mock" else predict.load(config.adapter, predict.Adapter)
    judge = predict.StaticJudge(int(config.judge == "static-pass")) if config.judge.startswith("static-") else predict.load(config.judge, predict.Judge)
    judge.retries = config.invalid_json_retries
    pairs = spark.read.json(config.chain_pairs) if config.chain_pairs else None
    packs = Packs.load(spark, config.packs)
    prepared = spark.read.parquet(config.prepared)
    print(json.dumps(run(spark, prepared, config.out, adapter, judge, pairs, packs)))
    if pairs is not None and packs.oracle:
        oracle_runs(spark, prepared, f"{config.out}/oracle", adapter, judge, pairs, packs).write.mode("overwrite").json(f"{config.out}/oracle_summary")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
