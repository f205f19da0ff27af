"""Queries of the evaluation operators over the whole tables, each with the same result in SQL."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameledger.functions import geometry, sampling, text
from frameledger.operators import evaluate, prepare, prompts, state, structure, summarize
from frameledger.plans import pipeline
from frameledger.schemas import ACTIONS, CAPTIONS, GROUNDING, IMAGINATION, TASK_NAMES, UPSTREAM_TASKS
from frameledger.session import first_delivery, spread_join, table
from frameledger.sources import annotations as ann

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _list(names: list[str]) -> str:
    return ", ".join(f"'{n}'" for n in names)


# ---- base tables: every record once -------------------------------------------------------------------

ONCE = {"annotations": ("row_id", "loaded_at"), "videos": ("video_key", "loaded_at"), "prepared_samples": ("record_id", "written_at"), "structured_predictions": ("record_id", "written_at"), "tracking_files": ("file_id", "loaded_at")}


def once(spark: SparkSession, d: str, name: str, *columns: str) -> DataFrame:
    key, arrived = ONCE[name]
    df = table(spark, d, name)
    return first_delivery(df.select(*dict.fromkeys([key, arrived, *columns])) if columns else df, key, arrived)


def _sql_once(name: str) -> str:
    key, arrived = ONCE[name]
    return f"(select * from {name} qualify row_number() over (partition by {key} order by {arrived}) = 1)"


ANN, VID, PREP, PRED = (_sql_once(n) for n in ("annotations", "videos", "prepared_samples", "structured_predictions"))


def samples(spark: SparkSession, d: str) -> DataFrame:
    """Annotations with their video's metadata, windows in order, and sample ids."""
    a = once(spark, d, "annotations").select("row_id", "video_key", F.col("annotation_id"), F.col("task_l2").alias("task_name"), "timestamp_frame", ann.q_window(F.col("q_window_frame")).alias("q_window"), F.when(F.col("task_l2") == "Spatial_Temporal_Grounding", ann.grounding_window(F.col("a_window_frame"))).alias("a_window"), "a_window_frame", "answer", "question", "query", "bounding_box", "tracking_bboxes", "upstream_annotation_id")
    v = once(spark, d, "videos", "fps", "total_frames", "resolution").drop("loaded_at")
    j = spread_join(a, v, ["video_key"], "row_id", "left").withColumn("seq", F.col("row_id"))
    return j.withColumn("sample_id", F.concat("video_key", F.lit("#"), F.coalesce("annotation_id", F.lit("<missing>"))))


SAMPLES = f"""(select a.row_id, a.video_key, a.annotation_id, a.task_l2 as task_name, a.timestamp_frame, least(a.q_window_frame[1], a.q_window_frame[2]) qs, greatest(a.q_window_frame[1], a.q_window_frame[2]) qe,
 a.q_window_frame[1] is not null and a.q_window_frame[2] is not null q_ok, a.q_window_frame, a.a_window_frame, a.answer, a.question, a.query, a.bounding_box, a.tracking_bboxes, a.upstream_annotation_id, v.fps, v.total_frames, v.resolution,
 a.video_key || '#' || coalesce(a.annotation_id, '<missing>') as sample_id,
 case when a.task_l2 = 'Spatial_Temporal_Grounding' and len(from_json(a.a_window_frame, '["VARCHAR"]')) = 2 then try_cast(from_json(a.a_window_frame, '["VARCHAR"]')[1] as bigint) end g1,
 case when a.task_l2 = 'Spatial_Temporal_Grounding' and len(from_json(a.a_window_frame, '["VARCHAR"]')) = 2 then try_cast(from_json(a.a_window_frame, '["VARCHAR"]')[2] as bigint) end g2
 from {ANN} a left join {VID} v on a.video_key = v.video_key)"""


# ---- geometry --------------------------------------------------------------------------------------------

def _lineitem_boxes(df: DataFrame) -> DataFrame:
    x, y = (F.col("l_partkey") % 500).cast("double"), (F.col("l_suppkey") % 500).cast("double")
    dx, dy = (F.col("l_orderkey") % 37 - 18).cast("double"), (F.col("l_linenumber") * 7 - 20).cast("double")
    w = (F.col("l_partkey") % 61).cast("double")
    return df.select("l_orderkey", "l_linenumber", F.array(x + dx, y + dy, x + dx + w, y + dy + 40).alias("p"), F.array(x, y, x + w, y + 40).alias("g"))


_IOU = """(select l_orderkey, l_linenumber, greatest(least(x+dx+w, x+w) - greatest(x+dx, x), 0.0) * greatest(least(y+dy+40, y+40) - greatest(y+dy, y), 0.0) i, greatest(w, 0.0)*40 a from
 (select l_orderkey, l_linenumber, (l_partkey % 500)::double x, (l_suppkey % 500)::double y, (l_orderkey % 37 - 18)::double dx, (l_linenumber*7 - 20)::double dy, (l_partkey % 61)::double w from lineitem))"""


@query(f"select l_orderkey, l_linenumber, round(case when 2*a - i <= 0 then 0.0 else i / (2*a - i) end, 9) as iou from {_IOU}")
def iou_corner(spark, d):
    return _lineitem_boxes(table(spark, d, "lineitem")).select("l_orderkey", "l_linenumber", F.round(geometry.box_iou(F.col("p"), F.col("g")), 9).alias("iou"))


@query(f"select l_orderkey, sum(case when case when 2*a - i <= 0 then 0.0 else i / (2*a - i) end >= 0.5 then 1 else 0 end)::bigint as hits, count(*)::bigint as n, round(avg(case when case when 2*a - i <= 0 then 0.0 else i / (2*a - i) end >= 0.5 then 1.0 else 0.0 end), 9) as bbox_pass_rate from {_IOU} group by 1")
def pooled_bbox_rate(spark, d):
    b = _lineitem_boxes(table(spark, d, "lineitem")).withColumn("hit", (geometry.box_iou(F.col("p"), F.col("g")) >= 0.5).cast("bigint"))
    return b.groupBy("l_orderkey").agg(F.sum("hit").alias("hits"), F.count(F.lit(1)).alias("n"), F.round(F.sum("hit") / F.count(F.lit(1)), 9).alias("bbox_pass_rate"))


@query("""select o_orderkey, round(case when (pe-ps+1)+(ge-gs+1)-i <= 0 then 0.0 else i::double/((pe-ps+1)+(ge-gs+1)-i) end, 9) as tiou from (select *, greatest(0, least(pe,ge)-greatest(ps,gs)+1) i from
 (select o_orderkey, o_orderkey%300 ps, o_orderkey%300 + o_custkey%90 - 20 pe, o_custkey%300 gs, o_custkey%300 + o_orderkey%70 ge from orders))""")
def temporal_iou(spark, d):
    o = table(spark, d, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return o.select("o_orderkey", F.round(geometry.temporal_iou(k % 300, k % 300 + c % 90 - 20, c % 300, c % 300 + k % 70), 9).alias("tiou"))


_GT = f"(select record_id, unnest(reference_payload.tracking_gt_sampled) t from {PREP} where reference_payload.tracking_gt_sampled is not null)"


def _truth(spark, d) -> DataFrame:
    p = once(spark, d, "prepared_samples", "reference_payload")
    return p.select("record_id", F.explode("reference_payload.tracking_gt_sampled").alias("t")).where(F.col("t").isNotNull()).select("record_id", "t.frame_sampled", "t.frame_original", "t.bbox_mot")


@query(f"select record_id, t.frame_sampled as frame_sampled, t.bbox_mot[1] as x1, t.bbox_mot[2] as y1, t.bbox_mot[1]+t.bbox_mot[3] as x2, t.bbox_mot[2]+t.bbox_mot[4] as y2 from {_GT} where t is not null")
def mot_to_corner(spark, d):
    c = geometry.mot_to_corner(F.col("bbox_mot"))
    return _truth(spark, d).select("record_id", "frame_sampled", *[c[i].alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))])


_PX = lambda v, n: f"greatest(0, least({n - 1}, round_even({v} * {n} / 1000, 0)::bigint))::bigint"


@query(f"select record_id, t.frame_sampled as frame_sampled, {_PX('t.bbox_mot[1]', 1920)} as px1, {_PX('t.bbox_mot[2]', 1080)} as py1, {_PX('(t.bbox_mot[1]+t.bbox_mot[3])', 1920)} as px2, {_PX('(t.bbox_mot[2]+t.bbox_mot[4])', 1080)} as py2 from {_GT} where t is not null")
def denormalize_boxes(spark, d):
    c = geometry.denormalize_to_pixels(F.col("bbox_mot"), F.lit(1920), F.lit(1080))
    return _truth(spark, d).select("record_id", "frame_sampled", *[c[i].alias(n) for i, n in enumerate(("px1", "py1", "px2", "py2"))])


_CORNERS = "list_transform(from_json(bounding_box, '[\"VARCHAR\"]'), lambda v: try_cast(v as double))"


@query(f"""select row_id, round(b[1]*1000/w,6) as n1, round(b[2]*1000/h,6) as n2, round(b[3]*1000/w,6) as n3, round(b[4]*1000/h,6) as n4 from (select row_id, {_CORNERS} b, case when resolution[1]>0 and resolution[2]>0 and len({_CORNERS}) = 4 then resolution[1] end w, case when resolution[1]>0 and resolution[2]>0 and len({_CORNERS}) = 4 then resolution[2] end h
 from {SAMPLES})""")
def normalize_boxes(spark, d):
    """Of every annotation; null where there is no box of four sides (objects, other tasks) or no frame size."""
    s = samples(spark, d)
    b = F.transform(F.from_json("bounding_box", "array<string>"), lambda v: v.try_cast("double"))
    n = geometry.normalize_box(b, F.get("resolution", F.lit(0)), F.get("resolution", F.lit(1)))
    return s.select("row_id", *[F.round(F.get(n, F.lit(i)), 6).alias(f"n{i + 1}") for i in range(4)])


# ---- intervals, sampling, projection ---------------------------------------------------------------------

@query(f"""select row_id, i::int as ord, least(a,b) as s, greatest(a,b) as e from (select row_id, i, try_cast(trim(split_part(x,'-',1)) as bigint) a, try_cast(trim(substr(x, strpos(x,'-')+1)) as bigint) b from
 (select row_id, unnest(from_json(a_window_frame,'["VARCHAR"]')) x, generate_subscripts(from_json(a_window_frame,'["VARCHAR"]'),1)-1 i from {ANN} where task_l2 in ('Continuous_Events_Caption','Continuous_Actions_Caption') and a_window_frame is not null)) where a is not null and b is not null""")
def caption_intervals(spark, d):
    a = once(spark, d, "annotations", "task_l2", "a_window_frame").where(F.col("task_l2").isin("Continuous_Events_Caption", "Continuous_Actions_Caption"))
    return a.select("row_id", F.posexplode(ann.answer_intervals(F.col("a_window_frame"))).alias("ord", "i")).where(F.col("i").isNotNull()).select("row_id", "ord", F.col("i.start").alias("s"), F.col("i.end").alias("e"))


_CLIP = lambda x: f"case when {x} is not null and total_frames is not null then least(greatest({x}, 0), total_frames - 1) end"


@query(f"select row_id, least({_CLIP('qs')}, {_CLIP('qe')}) as s, greatest({_CLIP('qs')}, {_CLIP('qe')}) as e from (select row_id, case when q_ok then qs end qs, case when q_ok then qe end qe, total_frames from {SAMPLES})")
def clipped_windows(spark, d):
    """Of every annotation; null without a window or a number of frames."""
    a, b = sampling._clipped(F.col("q_window.start"), F.col("q_window.end"), F.col("total_frames"))
    return samples(spark, d).select("row_id", a.alias("s"), b.alias("e"))


def _sql_uniform(s: str, e: str, budget: int) -> str:
    return f"case when {s} = {e} then [{s}] else list_distinct(list_transform(generate_series(0, {budget - 1}), lambda k: greatest({s}, least({e}, round_even({s} + (k::double / {budget - 1}) * ({e} - {s}), 0)::bigint)))) end"


def _uniform(spark, d, budget: int) -> DataFrame:
    s = F.col("o_orderkey") % 1000
    f = sampling.uniform(s, s + F.col("o_custkey") % 700, budget)
    return table(spark, d, "orders").select("o_orderkey", f.alias("frames"))


def _uniform_sql(budget: int) -> str:
    return f"select o_orderkey, list_sort({_sql_uniform('s', 'e', budget)}) as frames from (select o_orderkey, o_orderkey % 1000 s, o_orderkey % 1000 + o_custkey % 700 e from orders)"


@query(_uniform_sql(5))
def uniform_sampling_b5(spark, d):
    return _uniform(spark, d, 5)


@query(_uniform_sql(8))
def uniform_sampling_b8(spark, d):
    return _uniform(spark, d, 8)


@query(_uniform_sql(64))
def uniform_sampling_b64(spark, d):
    return _uniform(spark, d, 64)


_BACK = lambda e: f"list_sort(generate_series({e}, greatest(0, {e} - 319), -5))"


@query(f"select o_orderkey, {_BACK('o_orderkey % 900')} as frames from orders")
def short_window_sampling(spark, d):
    return table(spark, d, "orders").select("o_orderkey", sampling.backwards(F.col("o_orderkey") % 900).alias("frames"))


def _protocol(spark, d, name: str) -> DataFrame:
    s = prepare.with_frames(ann.supported(samples(spark, d)), sampling.PROTOCOLS[name])
    f = F.array_sort("sampled_frames_original")
    return s.select("row_id", F.size(f).alias("n"), F.get(f, F.lit(0)).alias("first_frame"), F.try_element_at(f, F.lit(-1)).alias("last_frame"), F.aggregate(f, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total")).withColumn("n", F.when(F.col("n") >= 0, F.col("n")))


def _frames_sql(margin: int, window: str, budget: int) -> str:
    """Every supported sample with its frames (f)."""
    gs, ge = f"least({_CLIP(f'least(g1,g2) - {margin}')}, {_CLIP(f'greatest(g1,g2) + {margin}')})", f"greatest({_CLIP(f'least(g1,g2) - {margin}')}, {_CLIP(f'greatest(g1,g2) + {margin}')})"
    return f"""(select *, list_sort(case when task_name in ('Scoreboard_Single','Objects_Spatial_Relationships') then case when timestamp_frame is not null then [timestamp_frame] end
 when task_name = 'Spatial_Temporal_Grounding' then case when gs is not null then {_sql_uniform('gs', 'ge', budget)} end when q_ok and ce is not null then {window} end) f from
 (select *, case when g1 is not null and g2 is not null then {gs} end gs, case when g1 is not null and g2 is not null then {ge} end ge, least({_CLIP('qs')}, {_CLIP('qe')}) cs, greatest({_CLIP('qs')}, {_CLIP('qe')}) ce from {SAMPLES} where task_name in ({_list(TASK_NAMES)})))"""


def _protocol_sql(margin: int, window: str, budget: int) -> str:
    return f"select row_id, len(f)::int as n, f[1] as first_frame, f[-1] as last_frame, list_sum(f)::bigint as total from {_frames_sql(margin, window, budget)}"


@query(_protocol_sql(50, f"case when ce - cs + 1 <= 320 then {_BACK('ce')} else {_sql_uniform('cs', 'ce', 64)} end", 64))
def protocol_main(spark, d):
    return _protocol(spark, d, "main")


@query(_protocol_sql(0, _sql_uniform("cs", "ce", 8), 8))
def protocol_uniform8(spark, d):
    return _protocol(spark, d, "uniform8")


@query(f"""select record_id, case when a is null or b is null or coalesce(n, 0) = 0 then null when hi > lo then lo else least(ps, pe) end::bigint as s, case when a is null or b is null or coalesce(n, 0) = 0 then null when hi > lo then hi - 1 else greatest(ps, pe) end::bigint as e from (select record_id, a, b, n, lo, hi, least(lo, n-1) ps, least(be, n-1) pe from
 (select record_id, a, b, len(f) n, len(list_filter(f, lambda x: x < a)) lo, len(list_filter(f, lambda x: x <= b)) hi, len(list_filter(f, lambda x: x < b)) be from (select record_id, sampled_frames_original f, q_window.start a, q_window."end" b from {PREP})))""")
def interval_projection(spark, d):
    """Of every prepared sample; null without a window or frames."""
    p = once(spark, d, "prepared_samples", "q_window", "sampled_frames_original")
    return p.select("record_id", sampling.project(F.col("q_window.start"), F.col("q_window.end"), F.col("sampled_frames_original")).alias("i")).select("record_id", F.col("i.start").alias("s"), F.col("i.end").alias("e"))


@query(f"select record_id, case when len(f) > 1 and f[1] is not null and f[-1] is not null then round((len(f)-1)*10/greatest(f[-1]-f[1],1), 9) end as fps from (select record_id, sampled_frames_original f from {PREP})")
def sampled_video_fps(spark, d):
    """Of every prepared sample; null for one frame at most, or where an end is null."""
    p = once(spark, d, "prepared_samples", "sampled_frames_original")
    return p.select("record_id", F.round(sampling.sampled_fps(F.col("sampled_frames_original")), 9).alias("fps"))


@query(f"select record_id, (generate_subscripts(sampled_frames_original,1)-1)::int as pos, unnest(sampled_frames_original) as frame from {PREP} where sampled_frames_original is not null")
def sampled_to_original(spark, d):
    p = once(spark, d, "prepared_samples", "sampled_frames_original")
    return p.select("record_id", F.explode(sampling.position_map(F.col("sampled_frames_original"))).alias("pos", "frame"))


@query(f"select distinct video_key, frame_original from (select video_key, unnest(sampled_frames_original) frame_original from {PREP})")
def union_frames(spark, d):
    return prepare.union_frames(once(spark, d, "prepared_samples", "video_key", "sampled_frames_original"))


@query(f"select protocol_id, task_name, count(*)::bigint as num_samples, sum(coalesce(len(sampled_frames_original),0))::bigint as total_sampled_frames, round(sum(coalesce(len(sampled_frames_original),0))/count(*), 9) as avg_sampled_frames from {PREP} group by all")
def protocol_stats(spark, d):
    p = prepare.protocol_stats(once(spark, d, "prepared_samples", "protocol_id", "task_name", "sampled_frames_original"))
    return p.withColumn("avg_sampled_frames", F.round("avg_sampled_frames", 9))


# ---- ingest and validation -----------------------------------------------------------------------------------

@query(f"select task_name, count(*)::bigint as num_samples, count(distinct video_key)::bigint as num_videos, coalesce(bool_or(task_name in ({_list(TASK_NAMES)})), false) as supported from {SAMPLES} group by 1")
def scan_report(spark, d):
    return ann.scan_report(samples(spark, d))


@query(f"select count(*)::bigint as num_samples, count(distinct video_key)::bigint as num_videos from {SAMPLES} where task_name in ({_list(TASK_NAMES)})")
def dataset_counts(spark, d):
    return ann.supported(samples(spark, d)).agg(F.count(F.lit(1)).alias("num_samples"), F.countDistinct("video_key").alias("num_videos"))


@query(f"select video_key, duration_sec, fps, total_frames, coalesce(resolution[1], 0) as width, coalesce(resolution[2], 0) as height from {VID}")
def video_metadata(spark, d):
    v = once(spark, d, "videos")
    side = lambda i: F.coalesce(F.get("resolution", F.lit(i)), F.lit(0))
    return v.select("video_key", "duration_sec", "fps", "total_frames", side(0).alias("width"), side(1).alias("height"))


@query(f"select row_id, coalesce(question, query, '') as question_text from {ANN}")
def question_texts(spark, d):
    return once(spark, d, "annotations", "question", "query").select("row_id", ann.question_text(F.col("question"), F.col("query")).alias("question_text"))


@query(f"select row_id, regexp_replace(trim(tracking_bboxes), '^(\\./data/|data/|\\./dataset/|dataset/)', '') as path from {ANN} where length(trim(tracking_bboxes)) > 0")
def resolved_paths(spark, d):
    return once(spark, d, "annotations", "tracking_bboxes").select("row_id", ann.resolve_path(F.col("tracking_bboxes")).alias("path")).where(F.col("path").isNotNull())


_SINGLE = "task_name in ('Scoreboard_Single','Objects_Spatial_Relationships')"
_ISSUES = f"""(select sample_id, 'fps' as rule, sample_id || ': expected fps 10, got ' || coalesce(fps::varchar, 'none') as message from S where fps is null or fps <> 10
 union all select sample_id, 'timestamp', sample_id || ': missing timestamp_frame' from S where {_SINGLE} and timestamp_frame is null
 union all select sample_id, 'q_window', sample_id || ': missing Q_window_frame' from S where not {_SINGLE} and task_name <> 'Spatial_Temporal_Grounding' and not coalesce(q_ok, false)
 union all select sample_id, 'a_window', sample_id || ': missing A_window_frame' from S where task_name = 'Spatial_Temporal_Grounding' and (g1 is null or g2 is null))"""


@query(f"with S as (select * from {SAMPLES} where task_name in ({_list(TASK_NAMES)})) select * from {_ISSUES}")
def structure_issues(spark, d):
    return ann.structure_issues(ann.supported(samples(spark, d)))


@query(f"with S as (select * from {SAMPLES} where task_name in ({_list(TASK_NAMES)})) select message from {_ISSUES} order by message limit 50")
def issue_limit(spark, d):
    return ann.structure_issues(ann.supported(samples(spark, d))).select("message").orderBy("message").limit(50)


_LAST = "(select video_key, annotation_id, arg_max(task_name, row_id) upstream_task, arg_max(sample_id, row_id) upstream_sample from S where annotation_id is not null group by all)"


@query(f"""with S as (select * from {SAMPLES} where task_name in ({_list(TASK_NAMES)})), L as {_LAST} select sample_id, case when s.upstream_annotation_id is null then 'upstream_missing' when upstream_task is null then 'upstream_not_found' else 'upstream_task' end as rule,
 sample_id || case when s.upstream_annotation_id is null then ': missing upstream_annotation_id' when upstream_task is null then ': upstream annotation ' || s.upstream_annotation_id || ' not found' else ': upstream task ' || upstream_task || ' is not allowed' end as message
 from S s left join L l on s.video_key = l.video_key and s.upstream_annotation_id = l.annotation_id where s.task_name = '{IMAGINATION}' and (upstream_task is null or upstream_task not in ({_list(UPSTREAM_TASKS)}))""")
def upstream_issues(spark, d):
    return ann.upstream_issues(ann.supported(samples(spark, d)))


_PAIRS = f"(select s.sample_id || '|' || upstream_sample as pair_id, s.video_key, upstream_sample as upstream_sample_id, s.sample_id as downstream_sample_id, upstream_task as upstream_task_name from S s join {_LAST} l on s.video_key = l.video_key and s.upstream_annotation_id = l.annotation_id where s.task_name = '{IMAGINATION}')"
_WITH_S = f"with S as (select * from {SAMPLES} where task_name in ({_list(TASK_NAMES)}))"


def _pairs(spark, d) -> DataFrame:
    return ann.chain_pairs(ann.supported(samples(spark, d)))


@query(f"{_WITH_S} select * from {_PAIRS}")
def chain_pairs(spark, d):
    return _pairs(spark, d)


_IV = """list_transform(from_json(a_window_frame,'["VARCHAR"]'), lambda x: struct_pack(a := try_cast(trim(split_part(x,'-',1)) as bigint), b := case when strpos(x,'-') > 0 then try_cast(trim(substr(x, strpos(x,'-')+1)) as bigint) end))"""
_SEG_OK = """len(iv) = len(texts) and len(list_filter(iv, lambda x: x.a is null or x.b is null)) = 0"""


@query(f"""select row_id, case when {_SEG_OK} then len(iv) end::int as n_segments, case when {_SEG_OK} then array_to_string(texts, ' ') end as linear
 from (select row_id, {_IV} iv, from_json(answer,'["VARCHAR"]') texts from {ANN} where task_l2 in ('Continuous_Events_Caption','Continuous_Actions_Caption'))""")
def segment_linearize(spark, d):
    """Of every caption row; null where an interval does not parse or the counts differ."""
    a = once(spark, d, "annotations", "task_l2", "a_window_frame", "answer").where(F.col("task_l2").isin("Continuous_Events_Caption", "Continuous_Actions_Caption"))
    s = ann.segments(F.col("a_window_frame"), F.col("answer"))
    return a.select("row_id", F.when(s.isNotNull(), F.size(s)).alias("n_segments"), evaluate.linearized(s).alias("linear"))


@query(SQL["segment_linearize"])
def segment_linearize_all(spark, d):
    return segment_linearize(spark, d)


# ---- scoring ---------------------------------------------------------------------------------------------------

def _derived_tracking(spark, d) -> DataFrame:
    t = _truth(spark, d)
    f = F.col("frame_sampled")
    moved = lambda by: F.array(F.col("bbox_mot")[0] + by, F.col("bbox_mot")[1], F.col("bbox_mot")[2], F.col("bbox_mot")[3])
    first = t.where(f % 5 != 4).select("record_id", "frame_sampled", F.lit(0).alias("ord"), moved((f % 7) * 3.0).alias("bbox_mot"))
    again = t.where(f % 3 == 0).select("record_id", "frame_sampled", F.lit(1).alias("ord"), moved(F.lit(500.0)).alias("bbox_mot"))
    return first.unionByName(again)


_TRACK = f"""with T as (select record_id, t.frame_sampled f, t.bbox_mot b from {_GT} where t is not null),
P as (select record_id, f, arg_min(dx, o) dx, arg_min(l, o) l from (select record_id, f, 0 o, (f % 7)*3.0 dx, b[1] l from T where f % 5 <> 4 union all select record_id, f, 1, 500.0, b[1] from T where f % 3 = 0) group by 1, 2),
J as (select T.record_id, T.f, P.f pf, P.l + P.dx pl, b[1] gl, b[2] t, b[3] w, b[4] h from T left join P on T.record_id = P.record_id and T.f = P.f),
K as (select *, greatest(least(pl+w, gl+w) - greatest(pl, gl), 0.0) * greatest((t+h) - t, 0.0) i, greatest((pl+w)-pl, 0.0) * greatest((t+h)-t, 0.0) + greatest((gl+w)-gl, 0.0) * greatest((t+h)-t, 0.0) a from J),
I as (select record_id, f, case when pf is null or a - i <= 0 then 0.0 else i / (a - i) end iou from K)
"""


@query(_TRACK + "select record_id, round(avg(iou), 9) as tracking_mean_iou, round(avg((iou >= 0.5)::int), 9) as tracking_pass_rate, (round(avg(iou), 12) >= 0.5 and avg((iou >= 0.5)::int) >= 0.5)::int as tracking_pass, count(*)::bigint as n_frames from I group by 1")
def tracking_eval(spark, d):
    s = evaluate.tracking_scores(_truth(spark, d), _derived_tracking(spark, d), ["record_id"])
    return s.withColumns({"tracking_mean_iou": F.round("tracking_mean_iou", 9), "tracking_pass_rate": F.round("tracking_pass_rate", 9)})


@query(f"""select record_id, k::int as ord, trim(o.label) as label, round(case when o is null or o.label is null or coalesce(len(o.bbox), 0) <> 4 or length(o.label) % 2 = 0 then 0.0 else case when 2*a - i <= 0 then 0.0 else i/(2*a - i) end end, 9) as iou from
 (select *, greatest(o.bbox[3]-o.bbox[1] - 10*k, 0.0) * greatest(o.bbox[4]-o.bbox[2], 0.0) i, greatest(o.bbox[3]-o.bbox[1],0.0)*greatest(o.bbox[4]-o.bbox[2],0.0) a from
 (select record_id, unnest(reference_payload.objects) o, generate_subscripts(reference_payload.objects,1)-1 k from {PREP} where reference_payload.objects is not null))""")
def object_labels(spark, d):
    p = once(spark, d, "prepared_samples", "reference_payload").where(F.col("reference_payload.objects").isNotNull())
    g = F.col("reference_payload.objects")
    guess = F.filter(F.transform(g, lambda o, k: F.struct(o["label"].alias("label"), F.array(F.get(o["bbox"], F.lit(0)) + 10 * k, F.get(o["bbox"], F.lit(1)), F.get(o["bbox"], F.lit(2)) + 10 * k, F.get(o["bbox"], F.lit(3))).alias("bbox"))), lambda o: F.length(o["label"]) % 2 != 0)
    s = p.select("record_id", F.posexplode(evaluate.object_scores(g, guess)).alias("ord", "s"))
    return s.select("record_id", "ord", F.col("s.label").alias("label"), F.round("s.iou", 9).alias("iou"))


_BITS = {"correctness": "o_orderkey % 5 > 0", "completeness": "o_orderkey % 7 > 0", "faithfulness": "o_custkey % 4 > 0", "final_pass": "o_custkey % 3 > 0"}


def _decision():
    return F.struct(*[F.expr(f"cast({e} as int)").alias(k) for k, e in _BITS.items()])


@query(f"select o_orderkey, ({' and '.join(_BITS.values())})::int as strict_pass, ({_BITS['final_pass']})::int as final_only from orders")
def judge_verdicts(spark, d):
    return table(spark, d, "orders").select("o_orderkey", evaluate.judge_pass(_decision(), F.lit("strict")).alias("strict_pass"), evaluate.judge_pass(_decision(), F.lit("final")).alias("final_only"))


@query("select o_orderkey, (o_orderkey % 3 in (0, 1) and o_custkey % 6 > 0)::boolean as usable from orders")
def judge_responses(spark, d):
    """Responses with a criterion of 2 or a blank reason are no decisions."""
    body = F.format_string('{"correctness": %d, "completeness": "1", "faithfulness": true, "final_pass": 1, "confidence": "high", "brief_reason": "%s", "more": [1]}', F.col("o_orderkey") % 3, F.when(F.col("o_custkey") % 6 > 0, "fine").otherwise(" "))
    return table(spark, d, "orders").select("o_orderkey", evaluate.parse_decision(body).isNotNull().alias("usable"))


# ---- summaries -------------------------------------------------------------------------------------------------

def _records(spark, d) -> DataFrame:
    """Derived records: passed if no structuring error, scored unless the record id ends in 9."""
    s = once(spark, d, "structured_predictions", "task_name", "structuring_errors", "raw_output")
    ok = (F.coalesce(F.size("structuring_errors"), F.lit(0)) <= 0).cast("int")
    r = F.col("record_id")
    return s.where(r % 10 != 9).select("record_id", "task_name", ok.alias("task_pass"), F.when(F.col("task_name") != "Spatial_Temporal_Grounding", ok).alias("judge_pass"), F.when(F.col("task_name") == "Scoreboard_Single", F.array((r % 2).cast("int"), (r % 3 == 0).cast("int"))).alias("bbox_passes"), F.when(F.col("task_name") == "Spatial_Temporal_Grounding", (r % 4 > 0).cast("int")).alias("tiou_pass"), F.when(F.col("task_name") == "Continuous_Actions_Caption", (r % 100) / 100.0).alias("tracking_mean_iou"), F.when(F.col("task_name") == "Continuous_Actions_Caption", (r % 50) / 50.0).alias("tracking_pass_rate"), F.when(F.length("raw_output") > 0, (F.length("raw_output") % 97) / 97.0).alias("text_f1"))


_REC = f"""(select record_id, task_name, ok as task_pass, case when task_name <> 'Spatial_Temporal_Grounding' then ok end judge_pass, case when task_name = 'Scoreboard_Single' then record_id % 2 + (record_id % 3 = 0)::int end hits, case when task_name = 'Spatial_Temporal_Grounding' then (record_id % 4 > 0)::int end tiou_pass,
 case when task_name = 'Continuous_Actions_Caption' then (record_id % 100)/100.0::double end tm, case when task_name = 'Continuous_Actions_Caption' then (record_id % 50)/50.0::double end tp, case when length(raw_output) > 0 then (length(raw_output) % 97)/97.0::double end f1 from (select *, (coalesce(len(structuring_errors),0) <= 0)::int ok from {PRED}) where record_id % 10 <> 9)"""
_SUMMARY = f"""(select s.task_name, count(*)::bigint num_samples, count(r.task_pass)::bigint num_scored_samples, avg(r.task_pass) task_accuracy, avg(judge_pass) judge_pass_rate, avg(tiou_pass) tiou_pass_rate, avg(tm) tracking_mean_iou_mean, avg(tp) tracking_pass_rate_mean, avg(f1) mean_text_f1, median(f1) median_text_f1, (count(*) - count(r.task_pass))::bigint num_pending_samples, sum(hits) / (2 * count(hits)) bbox_pass_rate from {PRED} s left join {_REC} r on s.record_id = r.record_id group by 1)"""
_MEANS = ["task_accuracy", "judge_pass_rate", "tiou_pass_rate", "tracking_mean_iou_mean", "tracking_pass_rate_mean", "mean_text_f1", "median_text_f1", "bbox_pass_rate"]


@query(f"select task_name, num_samples, num_scored_samples, num_pending_samples, {', '.join(f'round({m}, 9) as {m}' for m in _MEANS)} from {_SUMMARY}")
def task_summary(spark, d):
    s = summarize.task_summary(once(spark, d, "structured_predictions", "task_name"), _records(spark, d), ["record_id"])
    return s.withColumns({m: F.round(m, 9) for m in _MEANS})


@query(f"select round(avg(task_accuracy), 9) as overall, count(task_accuracy)::bigint as num_tasks from {_SUMMARY}")
def overall_macro(spark, d):
    s = summarize.task_summary(once(spark, d, "structured_predictions", "task_name"), _records(spark, d), ["record_id"])
    return summarize.overall(s).withColumn("overall", F.round("overall", 9))


def _chain_records(spark, d) -> DataFrame:
    """One derived evaluation per annotation id: passes from the row id; ids that end in 7 are pending."""
    s = ann.supported(samples(spark, d)).where(F.col("annotation_id").isNotNull()).groupBy("sample_id").agg(F.max("row_id").alias("r"))
    r = F.col("r")
    return s.where(r % 10 != 7).select("sample_id", (r % 3 > 0).cast("int").alias("judge_pass"), (r % 4 > 0).cast("int").alias("tiou_pass"), (r % 5 > 1).cast("int").alias("tracking_pass"))


_CREC = "(select sample_id, (r % 3 > 0)::int judge_pass, (r % 4 > 0)::int tiou_pass, (r % 5 > 1)::int tracking_pass from (select sample_id, max(row_id) r from S where annotation_id is not null group by 1) where r % 10 <> 7)"
_COMP = f"(select p.pair_id, upstream_task_name, u.sample_id is not null and dn.sample_id is not null scored, case when upstream_task_name = 'Continuous_Actions_Caption' then u.judge_pass else u.tiou_pass end pl, u.tracking_pass tr, dn.judge_pass re from {_PAIRS} p left join {_CREC} u on u.sample_id = upstream_sample_id left join {_CREC} dn on dn.sample_id = downstream_sample_id)"
_CMEANS = ["understanding_acc", "understanding_acc_wo_track", "reasoning_acc", "chain_success", "chain_success_wo_track", *[f"{c}_{t}" for c in ("full", "plain") for t in UPSTREAM_TASKS]]


@query(f"""{_WITH_S} select count(*)::bigint as num_chain_samples, count(*) filter (scored)::bigint as num_scored_chain_samples, count(*) filter (not scored)::bigint as num_pending_chain_samples, round(avg(pl*tr) filter (scored), 9) as understanding_acc, round(avg(pl) filter (scored), 9) as understanding_acc_wo_track, round(avg(re) filter (scored), 9) as reasoning_acc,
 round(avg(pl*tr*re) filter (scored), 9) as chain_success, round(avg(pl*re) filter (scored), 9) as chain_success_wo_track, {', '.join(f"round(avg(pl*tr) filter (scored and upstream_task_name = '{t}'), 9) as full_{t}, round(avg(pl) filter (scored and upstream_task_name = '{t}'), 9) as plain_{t}" for t in UPSTREAM_TASKS)} from {_COMP}""")
def chain_success(spark, d):
    c = summarize.chain_summary(summarize.chain_components(_pairs(spark, d), _chain_records(spark, d)))
    return c.withColumns({m: F.round(m, 9) for m in _CMEANS})


_OMEANS = ["understanding_acc_wo_track", "reasoning_acc", "chain_success_wo_track"]


@query(f"""{_WITH_S} select variant, count(*)::bigint as num_chain_samples, count(*) filter (ok)::bigint as num_scored_chain_samples, count(*) filter (not ok)::bigint as num_pending_chain_samples, round(avg(pl) filter (ok), 9) as understanding_acc_wo_track, round(avg(re) filter (ok), 9) as reasoning_acc, round(avg(pl*re) filter (ok), 9) as chain_success_wo_track from
 (select v.variant, (length(pair_id) + v.n) % 6 > 0 ok, case when upstream_task_name = 'Continuous_Actions_Caption' then (length(pair_id) % 2)::int else ((length(pair_id) + v.n) % 3 > 0)::int end pl, (length(pair_id) % 5 > 0)::int re from {_PAIRS} cross join (values ('language', 0), ('visual', 1), ('language_visual', 2)) v(variant, n)) group by 1""")
def oracle_success(spark, d):
    p = _pairs(spark, d)
    kinds = [("language", 0), ("visual", 1), ("language_visual", 2)]
    v = spark.createDataFrame(kinds, "variant string, n int")
    n = F.length("pair_id")
    each = p.withColumn("v", F.explode(F.array(*[F.struct(F.lit(k).alias("variant"), F.lit(i).alias("n")) for k, i in kinds]))).select("*", "v.*")
    res = each.where((n + F.col("n")) % 6 > 0).select("variant", "pair_id", (n % 2).alias("up_judge"), ((n + F.col("n")) % 3 > 0).cast("int").alias("up_tiou"), (n % 5 > 0).cast("int").alias("down_judge"), F.lit(True).alias("has_result")).distinct()
    c = summarize.chain_summary(summarize.oracle_components(p, v.select("variant"), res), ["variant"])
    return c.select("variant", "num_chain_samples", "num_scored_chain_samples", "num_pending_chain_samples", *[F.round(m, 9).alias(m) for m in _OMEANS])


_BOTH = ["num_chain_samples", "num_scored_chain_samples", "num_pending_chain_samples", *_OMEANS]


@query(f"select 'base' as experiment, {', '.join(_BOTH)} from ({SQL['chain_success']}) union all select 'oracle_' || variant, {', '.join(_BOTH)} from ({SQL['oracle_success']})")
def experiment_summary(spark, d):
    """The base chain summary with those of the oracle variants below it."""
    base, oracle = (QUERIES[n](spark, d) for n in ("chain_success", "oracle_success"))
    return summarize.combined_chain_summary(base.select(*_BOTH), oracle.select("variant", *_BOTH))


# ---- state and resume ------------------------------------------------------------------------------------------

@query(f"{_WITH_S} select kind, sample_id from (select 'duplicate_downstream' kind, downstream_sample_id sample_id from {_PAIRS} group by 2 having count(*) > 1 union all select distinct 'uncovered', sample_id from S where task_name = '{IMAGINATION}' and sample_id not in (select downstream_sample_id from {_PAIRS}) union all select distinct 'upstream_unprepared', upstream_sample_id from {_PAIRS} where upstream_sample_id not in (select sample_id from prepared_samples where sample_id is not null) union all select distinct 'downstream_unprepared', downstream_sample_id from {_PAIRS} where downstream_sample_id not in (select sample_id from prepared_samples where sample_id is not null))")
def chain_issues(spark, d):
    s = ann.supported(samples(spark, d))
    return state.chain_issues(ann.chain_pairs(s), table(spark, d, "prepared_samples"), s.where(F.col("task_name") == IMAGINATION))


_RAW = "(select sample_id, arg_max(raw_output, (written_at, record_id)) raw_output from structured_predictions where raw_output is not null group by 1)"
_PROMPT = f"(select sample_id, min('Task ' || task_name || ': ' || coalesce(question, query, '')) prompt from S group by 1)"


def _outputs(spark, d) -> DataFrame:
    t = table(spark, d, "structured_predictions").select("sample_id", "raw_output", "written_at", "record_id")
    return state.last_wins(t, "sample_id", ["written_at", "record_id"], "raw_output")


@query(f"{_WITH_S} select pair_id, r.raw_output is null as blocked, case when r.raw_output is not null then 'user:' || u.prompt || ';assistant:' || r.raw_output || ';user:' || dn.prompt end as chat from {_PAIRS} p left join {_PROMPT} u on u.sample_id = upstream_sample_id left join {_PROMPT} dn on dn.sample_id = downstream_sample_id left join {_RAW} r on r.sample_id = upstream_sample_id")
def chain_history(spark, d):
    s = ann.supported(samples(spark, d))
    prompt = text.render("Task {{ task }}: {{question}}", {"task": F.col("task_name"), "question": ann.question_text(F.col("question"), F.col("query"))})
    prompts = s.select("sample_id", F.concat(F.lit("Task "), "task_name", F.lit(": "), ann.question_text(F.col("question"), F.col("query"))).alias("prompt"), prompt.alias("trimmed")).groupBy("sample_id").agg(F.min("prompt").alias("prompt"))
    h = state.with_history(ann.chain_pairs(s), prompts, _outputs(spark, d))
    return h.select("pair_id", "blocked", F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), ";").alias("chat"))


@query("select sample_id, arg_max(raw_output, (written_at, record_id)) as raw_output, arg_max(record_id, (written_at, record_id)) as record_id from structured_predictions where raw_output is not null group by 1")
def last_wins_resume(spark, d):
    t = table(spark, d, "structured_predictions").select("sample_id", "raw_output", "written_at", "record_id")
    return state.last_wins(t, "sample_id", ["written_at", "record_id"], "raw_output").select("sample_id", "raw_output", "record_id")


@query("select user_id, arg_min(event_id, (ts, event_id)) as event_id, (count(*) - 1)::bigint as dropped from events group by 1")
def first_wins_collapse(spark, d):
    return state.first_wins(table(spark, d, "events").select("user_id", "ts", "event_id"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "dropped")


def _slices(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").cast("string").alias("sample_id"), F.col("event_id").alias("k"))
    raw = lambda tag: F.when(F.col("k") % 11 != 0, F.concat(F.lit(tag), "sample_id")).alias("raw_output")
    pred = lambda tag: F.when(F.col("k") % 7 != 0, F.concat(F.lit(tag), "sample_id")).alias("structured_prediction")
    return e, e.where("k % 2 = 0").select("sample_id", raw("p")), e.where("k % 3 = 0").select("sample_id", raw("s"), pred("S")), e.where("k % 5 = 0").select("sample_id", raw("r"), pred("R"))


@query("""select sample_id, coalesce(p.r, s.r, x.r) as raw_output, case when s.sample_id is not null then s.q when x.r is not null and x.q is not null then x.q end as structured_prediction from
 (select event_id::varchar sample_id, case when event_id % 11 <> 0 then 'p' || event_id end r from events where event_id % 2 = 0) p full join (select event_id::varchar sample_id, case when event_id % 11 <> 0 then 's' || event_id end r, case when event_id % 7 <> 0 then 'S' || event_id end q from events where event_id % 3 = 0) s using (sample_id)
 full join (select event_id::varchar sample_id, case when event_id % 11 <> 0 then 'r' || event_id end r, case when event_id % 7 <> 0 then 'R' || event_id end q from events where event_id % 5 = 0) x using (sample_id)""")
def backfill_merge(spark, d):
    _, p, s, r = _slices(spark, d)
    return state.backfill(p, s, r)


@query("select event_id::varchar as sample_id, case when event_id % 2 <> 0 then 'predict' when event_id % 3 <> 0 then 'structure' else 'evaluate' end as stage from events where not (event_id % 2 = 0 and event_id % 3 = 0 and event_id % 5 = 0)")
def pending_sets(spark, d):
    e, p, s, r = _slices(spark, d)
    return state.pending(e, p, s, r)


@query("select 'predicted' as stage, count(*) filter (event_id % 2 = 0)::bigint as n from events union all select 'structured', count(*) filter (event_id % 3 = 0)::bigint from events union all select 'evaluated', count(*) filter (event_id % 5 = 0)::bigint from events")
def progress(spark, d):
    e, p, s, r = _slices(spark, d)
    return state.progress(e, {"predicted": p, "structured": s, "evaluated": r})


@query("select event_id::varchar as sample_id from events where event_id % 2 = 0 or event_id % 3 = 0 or event_id % 5 = 0")
def failed_ids(spark, d):
    _, p, s, r = _slices(spark, d)
    return state.failed_ids([p, s, r])


@query(f"{_WITH_S} select case when sample_id in (select downstream_sample_id from {_PAIRS}) then 'chain' else 'normal' end as part, count(*)::bigint as n from S group by 1")
def chain_split(spark, d):
    s = ann.supported(samples(spark, d))
    normal, chain = state.split_chain(s, ann.chain_pairs(s))
    one = lambda df, n: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("part"), "n")
    return one(normal, "normal").unionByName(one(chain, "chain"))


@query("select r.sample_id, r.stage from (select sample_id, case when pred is null then 'structure' else 'done' end stage from (select sample_id, arg_max(structured_prediction, (written_at, record_id)) pred from structured_predictions where raw_output is not null group by 1)) r")
def resume_stage(spark, d):
    t = table(spark, d, "structured_predictions").where(F.col("raw_output").isNotNull()).select("sample_id", "structured_prediction", "written_at", "record_id")
    last = t.groupBy("sample_id").agg(F.max_by(F.struct("structured_prediction"), F.struct("written_at", "record_id")).alias("r"))
    nonnull = t.where(F.col("structured_prediction").isNotNull()).select("sample_id").distinct().withColumn("any", F.lit(True))
    return last.join(nonnull, "sample_id", "left").select("sample_id", F.when(F.col("any").isNull(), "structure").otherwise("done").alias("stage"))


# ---- text ------------------------------------------------------------------------------------------------------

@query("select c_custkey, 'Customer ' || c_name || ' (' || c_mktsegment || ') of ' || c_nationkey || ' {{ c_name }}' as prompt from customer")
def template_render(spark, d):
    t = "\n Customer {{c_name}} ({{ segment }}) of {{ nation }} {{ raw }}\n"
    return table(spark, d, "customer").select("c_custkey", text.render(t, {"c_name": F.col("c_name"), "segment": F.col("c_mktsegment"), "nation": F.col("c_nationkey"), "raw": F.lit("{{ c_name }}")}).alias("prompt"))


@query("select event_id, try_cast(json_extract_string(props, '$.k') as bigint) as k from events")
def props_extract(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))


_LABELS = """coalesce('[' || array_to_string(list_transform(reference_payload.objects, lambda o: coalesce('"' || trim(o.label) || '"', 'null')), ',') || ']', '[]')"""


@query(f"select record_id, {_LABELS} as labels from {PREP}")
def object_labels_json(spark, d):
    """Of every prepared sample: ``[]`` without objects; an object or label that is null stays null in its place."""
    p = once(spark, d, "prepared_samples", "reference_payload")
    return p.select("record_id", text.labels_json(F.col("reference_payload.objects")).alias("labels"))


@query(f"select record_id, case when len(sampled_frames_original) > 0 then '0..' || (len(sampled_frames_original)-1) end as frames, '[' || q_window_sampled.start || ', ' || q_window_sampled.\"end\" || ']' as question_interval from {PREP}")
def prompt_variables(spark, d):
    p = once(spark, d, "prepared_samples", "sampled_frames_original", "q_window_sampled")
    return p.select("record_id", text.index_range(F.col("sampled_frames_original")).alias("frames"), text.interval_text(F.col("q_window_sampled")).alias("question_interval"))


_PRINTED = ["annotation_id", "answer", "bounding_box", "query", "question", "row_id", "sample_id", "task_name", "timestamp_frame", "tracking_bboxes", "upstream_annotation_id"]
_DIGEST = "md5(concat_ws(chr(31), " + ", ".join(f"coalesce({c}::varchar, chr(0))" for c in _PRINTED) + "))"


@query(f"select video_key, n, sha256(concat_ws('-', n, s0, s1, s2, s3)) as fingerprint from (select video_key, count(*)::bigint n, {', '.join(f'sum((chr(48) || chr(120) || substr(d, {8 * i + 1}, 8))::bigint)::bigint s{i}' for i in range(4))} from (select video_key, {_DIGEST} d from {SAMPLES}) group by 1)")
def video_fingerprints(spark, d):
    """A digest of all rows of each video; nothing is gathered, so a video with a tenth of all rows costs no more."""
    return ann.dataset_fingerprint(samples(spark, d).select("video_key", *_PRINTED).withColumn("__v", F.col("video_key")).select(*_PRINTED, "__v"), "__v").withColumnRenamed("__v", "video_key")


# ---- prepared data and prompts ---------------------------------------------------------------------------------

_TRACKS = "(select tracking_path, frame_original, arg_max({'l': box_left, 't': box_top, 'w': box_width, 'h': box_height}, row_id) b from (select * from tracking_rows qualify row_number() over (partition by row_id order by loaded_at) = 1) group by all)"
_PLAIN = "case when regexp_matches(answer, '^\\s*\"') then answer::json ->> '$' else answer end"
_PLACE = "lambda x, y: struct_pack(lo := len(list_filter(f, lambda q: q < x)), hi := len(list_filter(f, lambda q: q <= y)), be := len(list_filter(f, lambda q: q < y)))"


def _projected(lo: str, hi: str, be: str) -> tuple[str, str]:
    """First and last position of an interval in n frames, from what lies below its ends."""
    return f"case when {hi} > {lo} then {lo} else least({lo}, {be}, n - 1) end", f"case when {hi} > {lo} then {hi} - 1 else greatest(least({lo}, n - 1), least({be}, n - 1)) end"


_ONE = _projected("len(list_filter(f, lambda q: q < least(x.a,x.b)))", "len(list_filter(f, lambda q: q <= greatest(x.a,x.b)))", "len(list_filter(f, lambda q: q < greatest(x.a,x.b)))")
_TW = _projected("len(list_filter(f, lambda q: q < least(g1,g2)))", "len(list_filter(f, lambda q: q <= greatest(g1,g2)))", "len(list_filter(f, lambda q: q < greatest(g1,g2)))")
_MAIN_FRAMES = _frames_sql(50, f"case when ce - cs + 1 <= 320 then {_BACK('ce')} else {_sql_uniform('cs', 'ce', 64)} end", 64)


@query(f"""with P as (select *, len(f) n, case when len(resolution) >= 2 and resolution[1] > 0 and resolution[2] > 0 then resolution[1]::double end w, case when len(resolution) >= 2 and resolution[1] > 0 and resolution[2] > 0 then resolution[2]::double end h,
  {_CORNERS} c, {_IV} iv, from_json(answer, '["VARCHAR"]') texts, regexp_replace(trim(tracking_bboxes), '^(\\./data/|data/|\\./dataset/|dataset/)', '') path from {_MAIN_FRAMES}),
R as (select row_id, count(*)::bigint n_track, sum(pos)::bigint track_sum, case when count(b.l + b.t + b.w + b.h + w + h) = count(*) then round(sum(b.l*1000/w + b.t*1000/h + b.w*1000/w + b.h*1000/h), 3) end box_sum from (select row_id, task_name, path, w, h, g1, g2, unnest(f) frame, generate_subscripts(f, 1) - 1 pos from P where task_name in ('{ACTIONS}', '{GROUNDING}') and length(path) > 0) u
  join {_TRACKS} t on t.tracking_path = u.path and t.frame_original = u.frame where task_name <> '{GROUNDING}' or g1 is null or g2 is null or frame between least(g1, g2) and greatest(g1, g2) group by 1)
select p.row_id, case when task_name not in ('Continuous_Actions_Caption','Continuous_Events_Caption','{GROUNDING}') then {_PLAIN} end as text,
 case when task_name = 'Scoreboard_Single' and len(c) = 4 then round(c[1]*1000/w + c[2]*1000/h + c[3]*1000/w + c[4]*1000/h, 3) end as bbox_sum,
 case when task_name in ('Continuous_Actions_Caption','Continuous_Events_Caption') and {_SEG_OK} then len(iv) end::int as n_segments,
 case when task_name in ('Continuous_Actions_Caption','Continuous_Events_Caption') and {_SEG_OK} and n > 0 then list_sum(list_transform(iv, lambda x: {_ONE[0]} + {_ONE[1]})) end::bigint as segment_sum,
 case when task_name = '{GROUNDING}' and g1 is not null and g2 is not null and n > 0 then {_TW[0]} end::bigint as window_start, case when task_name = '{GROUNDING}' and g1 is not null and g2 is not null and n > 0 then {_TW[1]} end::bigint as window_end,
 case when task_name in ('{ACTIONS}', '{GROUNDING}') then coalesce(n_track, 0) end::bigint as n_track, track_sum, box_sum from P p left join R r on p.row_id = r.row_id""")
def reference_payloads(spark, d):
    """The reference payload of every supported annotation, built from the annotation and its tracking rows, in figures."""
    s = ann.supported(samples(spark, d)).withColumn("sample_id", F.col("row_id").cast("string")).withColumn("tracking_path", ann.resolve_path(F.col("tracking_bboxes")))
    t = first_delivery(table(spark, d, "tracking_rows").select("row_id", "tracking_path", "frame_original", "box_left", "box_top", "box_width", "box_height", "loaded_at"), "row_id", "loaded_at").withColumnRenamed("row_id", "ord")
    p = F.col("reference_payload")
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    track = p["tracking_gt_sampled"]
    out = prepare.reference_payloads(prepare.with_frames(s, sampling.PROTOCOLS["main"]), t)
    return out.select("row_id", p["text"].alias("text"), F.round(total(p["bbox"]), 3).alias("bbox_sum"), F.when(p["segments_sampled"].isNotNull(), F.size(p["segments_sampled"])).alias("n_segments"),
                      F.aggregate(p["segments_sampled"], F.lit(0).cast("bigint"), lambda a, x: a + x["start_sampled"] + x["end_sampled"]).alias("segment_sum"), F.get(p["time_window_sampled"], F.lit(0)).alias("window_start"), F.get(p["time_window_sampled"], F.lit(1)).alias("window_end"),
                      F.when(track.isNotNull(), F.size(track)).cast("bigint").alias("n_track"), F.when(F.size(track) > 0, F.aggregate(track, F.lit(0).cast("bigint"), lambda a, x: a + x["frame_sampled"])).alias("track_sum"), F.when(F.size(track) > 0, F.round(F.aggregate(track, F.lit(0.0), lambda a, x: a + total(x["bbox_mot"])), 3)).alias("box_sum"))


@query(f"""with S as (select * from {SAMPLES} where task_name in ({_list(TASK_NAMES)})), I as (select sample_id, task_name, {_IV} iv, from_json(answer, '["VARCHAR"]') texts, a_window_frame, answer, bounding_box, {_CORNERS} c from S),
X as (select sample_id, case when task_name in ('Continuous_Actions_Caption','Continuous_Events_Caption') and (iv is null or texts is null) then 'no intervals or texts' when task_name in ('Continuous_Actions_Caption','Continuous_Events_Caption') and len(list_filter(iv, lambda x: x.a is null or x.b is null)) > 0 then 'an interval does not parse'
 when task_name in ('Continuous_Actions_Caption','Continuous_Events_Caption') and len(iv) <> len(texts) then 'interval and text counts differ' when task_name = 'Scoreboard_Single' and (c is null or len(c) < 1 or len(list_filter(c, lambda v: v is null)) > 0) then 'no numeric bounding box' end m from I where task_name <> 'Objects_Spatial_Relationships')
select sample_id, 'load' as rule, sample_id || ': failed to load annotation: ' || m as message from X where m is not null""")
def load_issues(spark, d):
    """Annotations whose answer cannot be read (but for object boxes, which SQL does not say briefly)."""
    return ann.load_issues(ann.supported(samples(spark, d)).where(F.col("task_name") != "Objects_Spatial_Relationships"))


_FILES = "(select distinct tracking_path from tracking_files where tracking_path is not null)"


@query(f"""with S as (select *, case when length(trim(tracking_bboxes)) > 0 then regexp_replace(trim(tracking_bboxes), '^(\\./data/|data/|\\./dataset/|dataset/)', '') end path from {SAMPLES} where task_name in ({_list(TASK_NAMES)}))
select sample_id, 'video' as rule, sample_id || ': missing video ' || coalesce(video_key, '') as message from S where video_key is null or video_key not in (select video_key from videos where video_key is not null)
union all select sample_id, 'tracking', sample_id || ': missing tracking file ' || path from S where task_name in ('Continuous_Actions_Caption','Continuous_Events_Caption','{GROUNDING}') and path is not null and path not in (select tracking_path from {_FILES})""")
def missing_file_issues(spark, d):
    s = ann.supported(samples(spark, d))
    return ann.missing_file_issues(s, table(spark, d, "videos"), table(spark, d, "tracking_files").select(F.col("tracking_path").alias("path")))


@query(f"""with A as (select row_id, trim(tracking_bboxes) t from {ANN}), C as (select row_id, t p1, regexp_replace(t, '^(\\./data/|data/|\\./dataset/|dataset/)', '') p2, regexp_replace(t, '^[./]+', '') p3 from A where length(t) > 0)
select a.row_id, case when p1 in (select tracking_path from {_FILES}) then p1 when p2 in (select tracking_path from {_FILES}) then p2 when p3 in (select tracking_path from {_FILES}) then p3 when p3 in (p1, p2) then p2 else p3 end as path,
 p1 in (select tracking_path from {_FILES}) or p2 in (select tracking_path from {_FILES}) or p3 in (select tracking_path from {_FILES}) as exists from A a left join C c on a.row_id = c.row_id""")
def first_existing_paths(spark, d):
    a = once(spark, d, "annotations", "tracking_bboxes").select("row_id", "tracking_bboxes")
    return ann.first_existing(a, "tracking_bboxes", table(spark, d, "tracking_files").select(F.col("tracking_path").alias("path")), "row_id").select("row_id", "path", "exists")


_FPS_TEXT = "rtrim(rtrim(printf('%.3f', sampled_video_fps), '0'), '.')"
_PROMPT_SQL = f"""(select *, coalesce(len(sampled_frames_original), 0) n, case when coalesce(len(sampled_frames_original), 0) <= 1 then '' else {_FPS_TEXT} end fps_text, case when task_name = 'Objects_Spatial_Relationships' then {_LABELS} else '[]' end labels,
 case when len(sampled_frames_original) > 0 then '0..' || (len(sampled_frames_original) - 1) else '' end idx, case when task_name not in ('Scoreboard_Single','Objects_Spatial_Relationships','{GROUNDING}') then '[' || q_window_sampled.start || ', ' || q_window_sampled."end" || ']' end iv from {PREP})"""


@query(f"""select record_id, regexp_replace(case when task_name in ('Scoreboard_Single','Objects_Spatial_Relationships','{GROUNDING}') then 'Look at ' || n || ' frames (' || idx || ', ' || fps_text || ' fps). ' || coalesce(question_text, '') || ' Name ' || labels
 else 'Watch ' || n || ' frames (' || idx || ', ' || fps_text || ' fps), above all ' || iv || '. ' || coalesce(question_text, '') end, '^\\s+|\\s+$', '', 'g') as prompt from {_PROMPT_SQL} where task_name in ({_list(TASK_NAMES)})""")
def rendered_prompts(spark, d):
    """Every prepared sample's prompt by its task's template; null where a variable is."""
    p = once(spark, d, "prepared_samples", "task_name", "question_text", "sampled_frames_original", "sampled_video_fps", "reference_payload", "q_window_sampled")
    head = " {{num_sampled_frames}} frames ({{sampled_index_range}}, {{ sampled_video_fps }} fps)"
    window = f"Watch{head}, above all {{{{question_relevant_sampled_interval}}}}. {{{{question}}}}"
    pack = {t: window if t in prompts.WINDOW_TASKS else f"Look at{head}. {{{{question}}}} Name {{{{required_object_labels_json}}}}" for t in TASK_NAMES}
    return p.where(F.col("task_name").isin(TASK_NAMES)).select("record_id", prompts.by_task(pack, prompts.sample_variables()).alias("prompt"))


@query(f"""select record_id, reference_payload.text as text, len(reference_payload.segments_sampled)::int as n_segments, case when task_name in ('Continuous_Actions_Caption','Continuous_Events_Caption') then 'reference_segments' when task_name <> '{GROUNDING}' then 'text' end as kind from
 (select record_id, task_name, case when task_name in ('Continuous_Actions_Caption','Continuous_Events_Caption') then {{'text': null::varchar, 'segments_sampled': reference_payload.segments_sampled}} when task_name <> '{GROUNDING}' then {{'text': reference_payload.text, 'segments_sampled': null}} end reference_payload from {PREP})""")
def judge_references(spark, d):
    """What a judge sees of every prepared sample's reference, read back from its JSON: the text or the segments, never
    boxes or tracking; nothing on the task without a judge."""
    p = once(spark, d, "prepared_samples", "task_name", "reference_payload")
    j = evaluate.judge_reference(F.col("task_name"), F.col("reference_payload"))
    return p.select("record_id", F.get_json_object(j, "$.text").alias("text"), F.size(F.from_json(F.get_json_object(j, "$.reference_segments"), "array<string>")).alias("n"), j.alias("j"), "task_name").select("record_id", "text", F.when(F.col("n") >= 0, F.col("n")).alias("n_segments"), F.when(F.col("task_name").isin(CAPTIONS), "reference_segments").when(F.col("j").isNotNull(), "text").alias("kind"))


# ---- untrusted responses: no SQL can express these --------------------------------------------------------------

def _responses(spark, d) -> DataFrame:
    s = once(spark, d, "structured_predictions", "sample_id", "protocol_id", "task_name", "model_name", "structurer_raw_response")
    p = table(spark, d, "prepared_samples").groupBy("sample_id", "protocol_id").agg(F.min_by("reference_payload.objects", "written_at").alias("objects"))
    j = s.join(p, ["sample_id", "protocol_id"], "left")
    return j.select(F.concat_ws("@", "sample_id", "model_name").alias("sample_id"), "protocol_id", "task_name", F.col("structurer_raw_response").alias("response"), F.transform("objects", lambda o: o["label"]).alias("labels"))


@query()
def extracted_json(spark, d):
    s = once(spark, d, "structured_predictions", "structurer_raw_response")
    return s.select("record_id", text.extract_json("structurer_raw_response").alias("j")).select("record_id", "j.value", "j.error")


@query()
def structured_verdicts(spark, d):
    return structure.structure_responses(_responses(spark, d))


@query()
def evaluation_records(spark, d):
    p = once(spark, d, "prepared_samples", "sample_id", "protocol_id", "task_name", "reference_payload")
    return pipeline.run(p, pipeline.mock_responses(p))[0].drop("judge_decision")


@query()
def evaluation_summary(spark, d):
    p = once(spark, d, "prepared_samples", "sample_id", "protocol_id", "task_name", "reference_payload")
    return pipeline.run(p, pipeline.mock_responses(p))[1]


def _model_run(spark, d) -> tuple[DataFrame, DataFrame]:
    """The records, and the summary per model and task, of the real responses of all models; a prediction is its own
    sample here, so that no two responses to a sample meet. Predictions without a reference stay pending."""
    s = once(spark, d, "structured_predictions", "sample_id", "protocol_id", "task_name", "model_name", "structurer_raw_response")
    p = table(spark, d, "prepared_samples").groupBy("sample_id", "protocol_id").agg(F.min_by("reference_payload", F.struct(F.col("written_at").isNull(), "written_at", "record_id")).alias("reference_payload"))
    j = s.join(p, ["sample_id", "protocol_id"], "left")
    own = [F.col("record_id").cast("string").alias("sample_id"), F.lit("").alias("protocol_id")]
    asked = j.select(*own, "task_name", F.col("structurer_raw_response").alias("response"), F.transform("reference_payload.objects", lambda o: o["label"]).alias("labels"))
    prepared = j.where(F.col("reference_payload").isNotNull()).select(*own, "task_name", "reference_payload")
    records = pipeline.evaluate_predictions(prepared, structure.structure_responses(asked))
    targets = s.select(*own, F.struct("model_name", "task_name").alias("task_name"))
    summary = summarize.task_summary(targets, records, ["sample_id", "protocol_id"])
    names = s.select("record_id", "sample_id", "protocol_id", "model_name")
    named = names.join(records.drop("protocol_id", "judge_decision").withColumn("record_id", F.col("sample_id").cast("bigint")).drop("sample_id"), "record_id")
    return named, summary.select("task_name.model_name", "task_name.task_name", *[c for c in summary.columns if c != "task_name"])


@query()
def evaluation_records_models(spark, d):
    return _model_run(spark, d)[0]


@query()
def evaluation_summary_models(spark, d):
    return _model_run(spark, d)[1]


@query(f"select record_id, coalesce({_FPS_TEXT}, '') as fps_text from {PREP}")
def sampled_rate_texts(spark, d):
    p = once(spark, d, "prepared_samples", "sampled_video_fps")
    return p.select("record_id", text.rate_text("sampled_video_fps").alias("fps_text"))
