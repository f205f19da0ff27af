"""Annotation documents, tracking files and templates as DataFrames."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from frameledger.functions.geometry import canonical, parse_interval
from frameledger.functions.text import check_template
from frameledger.operators.parse_lines import split_lines, valid_rows
from frameledger.schemas import CAPTIONS, GROUNDING, IMAGINATION, TASK_NAMES, UPSTREAM_TASKS, VIDEO_FPS

_ANNOTATION = "annotation_id string, task_L1 string, task_L2 string, timestamp_frame bigint, Q_window_frame array<bigint>, A_window_frame string, question string, query string, answer string, bounding_box string, tracking_bboxes string, upstream_annotation_id string"
DOCUMENT = f"sport string, event string, video_id string, info string, video_metadata struct<duration_sec double, fps int, total_frames bigint, resolution array<int>>, annotations array<struct<{_ANNOTATION.replace(' string', ':string').replace(' bigint', ':bigint').replace(' array', ':array')}>>, _broken string"
PATH_PREFIX = r"^(\./data/|data/|\./dataset/|dataset/)"


def annotation_files(spark: SparkSession, root: str) -> DataFrame:
    """path, video_key of every ``*.json`` below ``root`` that has an ``.mp4`` beside it (names only, no
    content is read)."""
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    stem = lambda ext: F.regexp_replace("path", rf"\.{ext}$", "")
    docs = listing.where(F.col("path").endswith(".json")).withColumn("stem", stem("json"))
    videos = listing.where(F.col("path").endswith(".mp4")).select(stem("mp4").alias("stem"))
    base = root.rstrip("/")
    return docs.join(videos, "stem", "left_semi").select("path", F.regexp_replace(F.regexp_replace("stem", r"^file:/*", "/"), f"^{base}/", "").alias("video_key"))


def annotation_documents(spark: SparkSession, root: str) -> DataFrame:
    """One row per annotation document: video_key, the typed document, and ``broken`` if it does not parse."""
    docs = spark.read.schema(DOCUMENT).option("multiLine", True).option("columnNameOfCorruptRecord", "_broken").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(root)
    stem = lambda c: F.regexp_replace(F.regexp_replace(c, r"^file:/*", "/"), r"\.json$", "")
    keyed = docs.withColumns({"path": F.col("_metadata.file_path"), "stem": stem(F.col("_metadata.file_path"))})
    files = annotation_files(spark, root).select(stem(F.col("path")).alias("stem"), "video_key")
    # the text of a broken document; a document without any content counts as broken too
    broken = F.when(F.col("_broken").isNotNull() | (F.col("video_metadata").isNull() & F.col("annotations").isNull()), F.coalesce("_broken", F.lit("")))
    return keyed.join(files, "stem").withColumn("broken", broken).drop("stem", "_broken")


def explode_annotations(documents: DataFrame) -> DataFrame:
    """One row per annotation with its video's metadata and sample_id; order in the file is kept in ``seq``."""
    meta = F.col("video_metadata")
    flat = documents.where(F.col("broken").isNull()).select("video_key", meta["fps"].alias("fps"), meta["total_frames"].alias("total_frames"), meta["resolution"].alias("resolution"), F.posexplode("annotations").alias("seq", "a"))
    a = F.col("a")
    named = {"annotation_id": "annotation_id", "task_level": "task_L1", "task_name": "task_L2", "timestamp_frame": "timestamp_frame", "q_window_frame": "Q_window_frame", "a_window_frame": "A_window_frame", "question": "question", "query": "query", "answer": "answer", "bounding_box": "bounding_box", "tracking_bboxes": "tracking_bboxes", "upstream_annotation_id": "upstream_annotation_id"}
    out = flat.select("video_key", "seq", "fps", "total_frames", F.coalesce(F.col("resolution"), F.array(F.lit(0), F.lit(0))).alias("resolution"), *[a[s].alias(t) for t, s in named.items()])
    return out.withColumn("sample_id", F.concat("video_key", F.lit("#"), F.coalesce("annotation_id", F.lit("<missing>"))))


def tracking_rows(spark: SparkSession, root: str) -> DataFrame:
    """tracking_path (relative to ``root``) and typed rows of the header-less tracking files. Lines that do
    not parse are left out; ``split_lines`` reports them."""
    base = root.rstrip("/")
    text = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(root)
    path = F.regexp_replace(F.regexp_replace("_metadata.file_path", r"^file:/*", "/"), f"^{base}/", "")
    lines = text.select(path.alias("tracking_path"), F.col("value").alias("line"))
    return valid_rows(split_lines(lines, key="tracking_path"), key="tracking_path")


def resolve_path(raw: Column) -> Column:
    """A dataset path relative to its root: trimmed, without one leading prefix; null or blank gives null."""
    text = F.trim(raw)
    return F.when(F.length(text) > 0, F.regexp_replace(text, PATH_PREFIX, ""))


def path_candidates(raw: Column) -> Column:
    """Where a path may lie below the root, in the order they are tried: as it stands, without a known prefix, without
    leading dots and slashes."""
    text = F.trim(raw)
    bare = F.regexp_replace(text, PATH_PREFIX, "")
    return F.when(F.length(text) > 0, F.array_distinct(F.array(text, bare, F.regexp_replace(text, r"^[./]+", ""))))


def first_existing(rows: DataFrame, raw: str, files: DataFrame, key: str) -> DataFrame:
    """``rows`` with ``path`` (the first candidate that is one of ``files.path``, else the last candidate) and ``exists``;
    null for a blank path."""
    tried = rows.select(key, F.posexplode(path_candidates(F.col(raw))).alias("pos", "path"))
    known = files.select("path").distinct().withColumn("there", F.lit(True))
    best = tried.join(known, "path", "left").groupBy(key).agg(F.min(F.when(F.col("there"), F.struct("pos", "path"))).alias("hit"), F.max(F.struct("pos", "path")).alias("last"))
    chosen = best.select(key, F.coalesce("hit.path", "last.path").alias("path"), F.col("hit").isNotNull().alias("exists"))
    return rows.join(chosen, key, "left")


def load_issues(samples: DataFrame) -> DataFrame:
    """sample_id, rule, message of annotations whose answer cannot be read as their task needs it: such a sample has no
    reference payload. One row a sample."""
    task, c = F.col("task_name"), F.col
    corners = F.transform(F.from_json("bounding_box", "array<string>"), lambda v: v.try_cast("double"))
    intervals, texts = answer_intervals(c("a_window_frame")), F.from_json("answer", "array<string>")
    wrong = F.lit(None).cast("string")
    for cond, says in (
        (task.isin(CAPTIONS) & (intervals.isNull() | texts.isNull()), "no intervals or texts"),
        (task.isin(CAPTIONS) & F.exists(intervals, lambda x: x.isNull()), "an interval does not parse"),
        (task.isin(CAPTIONS) & (F.size(intervals) != F.size(texts)), "interval and text counts differ"),
        ((task == "Scoreboard_Single") & (corners.isNull() | (F.size(corners) < 1) | F.exists(corners, lambda v: v.isNull())), "no numeric bounding box"),
        ((task == "Objects_Spatial_Relationships") & labelled_objects(c("bounding_box")).isNull(), "not two labelled boxes"),
    ):
        wrong = F.coalesce(wrong, F.when(F.coalesce(cond, F.lit(False)), F.lit(says)))
    return samples.select("sample_id", F.lit("load").alias("rule"), F.concat("sample_id", F.lit(": failed to load annotation: "), wrong).alias("message")).where(F.col("message").isNotNull())


def broken_documents(documents: DataFrame) -> DataFrame:
    """path, message of the documents that do not parse."""
    return documents.where(F.col("broken").isNotNull()).select("path", F.concat("path", F.lit(": failed to load annotation file")).alias("message"))


def missing_file_issues(samples: DataFrame, videos: DataFrame, tracking: DataFrame) -> DataFrame:
    """sample_id, rule, message: samples whose video is not among ``videos.video_key``, and those of the tracking tasks
    whose tracking file is not among ``tracking.path``."""
    said = lambda t, what: F.concat(F.col("sample_id"), F.lit(t), what)
    v = samples.join(videos.select("video_key").distinct(), "video_key", "left_anti").select("sample_id", F.lit("video").alias("rule"), said(": missing video ", F.coalesce("video_key", F.lit(""))).alias("message"))
    t = samples.where(F.col("task_name").isin(*CAPTIONS, GROUNDING)).withColumn("path", resolve_path(F.col("tracking_bboxes"))).where(F.col("path").isNotNull())
    t = t.join(tracking.select("path").distinct(), "path", "left_anti").select("sample_id", F.lit("tracking").alias("rule"), said(": missing tracking file ", F.col("path")).alias("message"))
    return v.unionByName(t)


def plain_text(answer: Column) -> Column:
    """An answer's text, also where it is spelt as a JSON text."""
    return F.when(answer.rlike(r'^\s*"'), F.get_json_object(answer, "$")).otherwise(answer)


def question_text(question: Column, query: Column) -> Column:
    return F.coalesce(question, query, F.lit(""))


def q_window(frames: Column) -> Column:
    return canonical(F.get(frames, F.lit(0)), F.get(frames, F.lit(1)))


def answer_intervals(a_window: Column) -> Column:
    """The caption intervals: JSON list of "a-b" texts; an element that does not parse is null."""
    return F.transform(F.from_json(a_window, "array<string>"), parse_interval)


def grounding_window(a_window: Column) -> Column:
    ends = F.transform(F.from_json(a_window, "array<string>"), lambda v: v.try_cast("bigint"))
    return F.when(F.size(ends) == 2, canonical(F.get(ends, F.lit(0)), F.get(ends, F.lit(1))))


def segments(a_window: Column, answer: Column) -> Column:
    """Intervals and texts paired strictly: null unless there are as many of both and all intervals parse."""
    iv, texts = answer_intervals(a_window), F.from_json(answer, "array<string>")
    ok = (F.size(iv) == F.size(texts)) & ~F.exists(iv, lambda x: x.isNull())
    return F.when(ok, F.transform(F.arrays_zip(iv.alias("i"), texts.alias("t")), lambda z: F.struct(z["i"]["start"].alias("start_frame"), z["i"]["end"].alias("end_frame"), z["t"].alias("text"))))


def labelled_objects(bounding_box: Column) -> Column:
    """Exactly two boxes with non-blank labels and four numbers each, else null."""
    raw = F.from_json(bounding_box, "array<struct<label:string,box:array<string>>>")
    objs = F.transform(raw, lambda o: F.struct(F.trim(o["label"]).alias("label"), F.transform(o["box"], lambda v: v.try_cast("double")).alias("bbox")))
    good = (F.size(objs) == 2) & F.forall(objs, lambda o: (F.length(o["label"]) > 0) & (F.size(o["bbox"]) == 4) & ~F.exists(o["bbox"], lambda v: v.isNull()))
    return F.when(F.coalesce(good, F.lit(False)), objs)


def unsupported(annotations: DataFrame) -> DataFrame:
    return annotations.where(~F.coalesce(F.col("task_name").isin(TASK_NAMES), F.lit(False)))


def supported(annotations: DataFrame) -> DataFrame:
    return annotations.where(F.col("task_name").isin(TASK_NAMES))


SINGLE = ["Scoreboard_Single", "Objects_Spatial_Relationships"]


def structure_issues(samples: DataFrame) -> DataFrame:
    """sample_id, rule, message of every violated structural rule (a sample may break several)."""
    single, ground = F.col("task_name").isin(SINGLE), F.col("task_name") == GROUNDING
    rule = lambda name, cond, text: F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(name).alias("rule"), text.alias("message")))
    said = lambda t: F.concat(F.col("sample_id"), F.lit(f": {t}"))
    rules = F.array(
        rule("fps", F.col("fps").isNull() | (F.col("fps") != VIDEO_FPS), F.concat(said(f"expected fps {VIDEO_FPS}, got "), F.coalesce(F.col("fps").cast("string"), F.lit("none")))),
        rule("timestamp", single & F.col("timestamp_frame").isNull(), said("missing timestamp_frame")),
        rule("q_window", ~single & ~ground & F.col("q_window").isNull(), said("missing Q_window_frame")),
        rule("a_window", ground & F.col("a_window").isNull(), said("missing A_window_frame")),
    )
    return samples.select("sample_id", F.explode(F.array_compact(rules)).alias("r")).select("sample_id", "r.rule", "r.message")


def upstream_issues(samples: DataFrame) -> DataFrame:
    """Issues of the tasks that build on another annotation of the same file: no id, not found, wrong task.

    Of annotations that share an id the last one counts, as ``seq`` orders them."""
    last = samples.groupBy("video_key", "annotation_id").agg(F.max_by("task_name", "seq").alias("upstream_task"))
    down = samples.where(F.col("task_name") == IMAGINATION)
    j = down.join(last.withColumnRenamed("annotation_id", "upstream_annotation_id"), ["video_key", "upstream_annotation_id"], "left")
    rule = F.when(F.col("upstream_annotation_id").isNull(), "upstream_missing").when(F.col("upstream_task").isNull(), "upstream_not_found").when(~F.col("upstream_task").isin(UPSTREAM_TASKS), "upstream_task")
    text = F.when(F.col("upstream_annotation_id").isNull(), F.lit(": missing upstream_annotation_id")).when(F.col("upstream_task").isNull(), F.concat(F.lit(": upstream annotation "), "upstream_annotation_id", F.lit(" not found"))).otherwise(F.concat(F.lit(": upstream task "), "upstream_task", F.lit(" is not allowed")))
    return j.select("sample_id", rule.alias("rule"), F.concat("sample_id", text).alias("message")).where(F.col("rule").isNotNull())


def chain_pairs(samples: DataFrame) -> DataFrame:
    """(upstream, downstream) edges within a video: pair_id, video_key, both sample ids, upstream task."""
    last = samples.groupBy("video_key", "annotation_id").agg(F.max_by(F.struct("sample_id", "task_name"), "seq").alias("u"))
    down = samples.where(F.col("task_name") == IMAGINATION).select("video_key", F.col("upstream_annotation_id").alias("annotation_id"), F.col("sample_id").alias("downstream_sample_id"))
    j = down.join(last, ["video_key", "annotation_id"])
    return j.select(F.concat("downstream_sample_id", F.lit("|"), "u.sample_id").alias("pair_id"), "video_key", F.col("u.sample_id").alias("upstream_sample_id"), "downstream_sample_id", F.col("u.task_name").alias("upstream_task_name"))


def scan_report(samples: DataFrame) -> DataFrame:
    """Per task: samples, videos, and whether the task is supported."""
    return samples.groupBy("task_name").agg(F.count(F.lit(1)).alias("num_samples"), F.countDistinct("video_key").alias("num_videos"), F.coalesce(F.max(F.col("task_name").isin(TASK_NAMES)), F.lit(False)).alias("supported"))


def dataset_fingerprint(rows: DataFrame, *by: str) -> DataFrame:
    """n, fingerprint of the whole rows (per ``by``): the digests of the rows, each over its members in the order of their
    names, are summed in four parts, so the order of rows does not matter and nothing is gathered."""
    line = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in sorted(set(rows.columns) - set(by))])
    parts = [F.sum(F.conv(F.substring("__d", 8 * i + 1, 8), 16, 10).cast("bigint")).alias(f"s{i}") for i in range(4)]
    g = rows.withColumn("__d", F.md5(line)).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *parts)
    return g.select(*by, "n", F.sha2(F.concat_ws("-", "n", "s0", "s1", "s2", "s3"), 256).alias("fingerprint"))


def template_pack(spark: SparkSession, root: str, allowed: set[str], tasks: list[str] | None = None) -> dict[str, str]:
    """task -> template of the Markdown files below ``root`` (a handful of small files, read on the driver's
    behalf); missing, empty or unknown-variable templates are errors."""
    rows = spark.read.option("wholetext", True).option("pathGlobFilter", "*.md").text(root).select(F.regexp_extract("_metadata.file_path", r"([^/]+)\.md$", 1).alias("task"), "value").collect()
    pack = {r["task"]: r["value"] for r in rows}
    wanted = tasks or TASK_NAMES
    missing = sorted(set(wanted) - set(pack))
    if missing:
        raise ValueError(f"missing templates: {', '.join(missing)}")
    for t in wanted:
        check_template(pack[t], allowed)
    return {t: pack[t] for t in wanted}
