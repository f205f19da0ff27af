"""Queries of the general data operators (problems 1, 2, 4 and 6), over whole tables."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from frameledger.operators import nested, parse_lines, references, spikes
from frameledger.session import first_delivery, shuffle_width, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return parse_lines.reject_rows(parse_lines.split_lines(table(spark, d, "tracking_lines"))).select("line_id", "reason")


def p1_rows(spark: SparkSession, d: str) -> DataFrame:
    """The valid lines as typed rows, each line once."""
    rows = parse_lines.valid_rows(parse_lines.split_lines(table(spark, d, "tracking_lines")))
    return rows.dropDuplicates(["line_id"])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return spikes.implausible_readings(table(spark, d, "tracking_rows"), table(spark, d, "annotations"))


def p2_impossible(spark: SparkSession, d: str) -> DataFrame:
    """The part of p2_found that physical limits alone decide."""
    return p2_found(spark, d).where("kind = 'impossible'")


def _bridge(spark: SparkSession, d: str) -> DataFrame:
    s = first_delivery(table(spark, d, "structured_predictions").select("record_id", "structured_prediction", "written_at"), "record_id", "written_at")
    p = first_delivery(table(spark, d, "prepared_samples").select("record_id", "reference_payload", "written_at"), "record_id", "written_at")
    return nested.shred(s, "structured_predictions", "record_id", "structured_prediction").unionByName(nested.shred(p, "prepared_samples", "record_id", "reference_payload"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.nested_objects(_bridge(spark, d))


def p4_objects(spark: SparkSession, d: str) -> DataFrame:
    return nested.object_table(_bridge(spark, d))


def p4_links(spark: SparkSession, d: str) -> DataFrame:
    """The whole bridge: each occurrence of an object, of whatever kind, and its parent, with their identities."""
    return _bridge(spark, d).drop("scalars")


_MENTION = {"frame_sampled": "bigint", "label": "string"}
_SEGMENT = {"start_sampled": "bigint", "end_sampled": "bigint", "text": "string"}
#: The flat table of each kind of object; the top level has the kind "".
KINDS: dict[str, tuple[str, dict[str, str]]] = {
    "p4_segments": ("segments", _SEGMENT),
    "p4_kind_top": ("", {"text": "string", "bbox": "array<double>", "time_window_sampled": "array<bigint>"}),
    "p4_kind_objects": ("objects", {"label": "string", "bbox": "array<double>"}),
    "p4_kind_objects_attributes": ("objects.attributes", {"name": "string", "value": "string"}),
    "p4_kind_segments_mentions": ("segments.mentions", _MENTION),
    "p4_kind_segments_sampled": ("segments_sampled", _SEGMENT),
    "p4_kind_segments_sampled_mentions": ("segments_sampled.mentions", _MENTION),
    "p4_kind_tracking": ("tracking", {"frame_sampled": "bigint", "bbox_mot": "array<double>"}),
    "p4_kind_tracking_gt_sampled": ("tracking_gt_sampled", {"frame_sampled": "bigint", "frame_original": "bigint", "bbox_mot": "array<double>"}),
    "p4_kind_notes": ("notes", {"origin": "string"}),
    "p4_kind_notes_evidence": ("notes.evidence", {"frame_sampled": "bigint"}),
    "p4_kind_notes_evidence_refs": ("notes.evidence.refs", {"label": "string"}),
}


def _kind(kind: str, columns: dict[str, str]) -> Callable[[SparkSession, str], DataFrame]:
    """Without the identities, which only ``p4_links`` shows: record and parent path are the link."""
    return lambda spark, d: nested.kind_table(_bridge(spark, d), kind, columns).drop("object_id", "parent_id")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return references.broken_references(table(spark, d, "annotations"), table(spark, d, "tracking_files"), table(spark, d, "prepared_samples"), shuffle_width(spark))


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return references.orphan_report(p6_found(spark, d))


_FIELD = r'[ \t\n\r\f]*(?:"(?:[^"]|"")*"[ \t\n\r\f]*|[^",]*)'
_P1 = rf"""
with l as (select line_id, any_value(line) line from tracking_lines group by line_id),
q as (select *, regexp_full_match(line, '{_FIELD}(?:,{_FIELD})*') quoted, list_transform(regexp_extract_all(',' || line, ',[ \t\n\r\f]*("(?:[^"]|"")*"|[^",]*)', 1),
    lambda f: trim(case when f[1] = '"' then replace(f[2:-2], '""', '"') else f end, ' ' || chr(9) || chr(10) || chr(12) || chr(13))) f
  from l where not regexp_full_match(coalesce(line, ''), '[ \t\n\r\f]*')),
r as (select *, case when not quoted then 'quoting' when len(f) <> 10 then 'column_count' when len(list_filter(f[1:2], lambda x: not regexp_full_match(x, '\+?[0-9]+(\.0*)?|-0+(\.0*)?'))) > 0
    or len(list_filter(f[3:10], lambda x: not regexp_full_match(x, '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?'))) > 0 or not regexp_matches(f[5], '^\+?[0.]*[1-9]') or not regexp_matches(f[6], '^\+?[0.]*[1-9]') then 'value' end reason from q)
"""
_OFF = lambda l, t, w, h: f"coalesce(isnan({l}), false) or coalesce(isinf({l}), false) or coalesce(isnan({t}), false) or coalesce(isinf({t}), false) or coalesce(isnan({w}), false) or coalesce(isinf({w}), false) or coalesce(isnan({h}), false) or coalesce(isinf({h}), false) or coalesce({w} <= 0, false) or coalesce({w} > 1000, false) or coalesce({h} <= 0, false) or coalesce({h} > 1000, false) or coalesce({l} >= 1000, false) or coalesce({t} >= 1000, false) or coalesce({l} + {w} <= 0, false) or coalesce({t} + {h} <= 0, false)"
_P2 = f"""
with a as (select row_id, arg_min(bounding_box, coalesce(loaded_at, timestamptz '9999-01-01')) b from annotations where trim(bounding_box) <> '' group by 1),
x as (select row_id, case when regexp_matches(b, '^\\s*\\[\\s*\\{{') then list_transform(range(json_array_length(b::json)::bigint), lambda i: json_extract(b::json, '/' || i || '/box')) else [b::json] end boxes from a where json_valid(b)),
v as (select row_id, unnest(list_transform(boxes, lambda j: case when json_type(j) = 'ARRAY' then list_transform(range(json_array_length(j)::bigint), lambda i: try_cast((j ->> ('/' || i)) as double)) end)) c from x),
w as (select row_id, c[1] l, c[2] t, c[3] - c[1] w, c[4] - c[2] h, c is null or len(c) <> 4 or len(list_filter(c, lambda q: q is null)) > 0 bad from v)
select 'tracking_rows' as source_table, row_id, 'impossible' as kind from tracking_rows where {_OFF('box_left', 'box_top', 'box_width', 'box_height')} group by row_id
union all select 'annotations', row_id, 'impossible' from w where coalesce(bad, true) or {_OFF('l', 't', 'w', 'h')} group by row_id
union all select 'annotations', row_id, 'impossible' from a where not json_valid(b)"""
_P4 = """
with recursive t(source_table, record_id, path, kind, parent_path, ordinal, v) as (
  select 'structured_predictions', record_id, '', '', null::varchar, null::int, to_json(any_value(structured_prediction)) from structured_predictions where structured_prediction is not null group by record_id
  union all select 'prepared_samples', record_id, '', '', null, null, to_json(any_value(reference_payload)) from prepared_samples where reference_payload is not null group by record_id
  union all select source_table, record_id, path || case when c.step is null or c.step[1] = '[' or path = '' then '' else '.' end || coalesce(c.step, ''),
    case when is_object then kind || case when kind = '' then '' else '.' end || c.step else kind end, case when is_object then path else parent_path end, case when c.step is null then ordinal else c.i end, c.v from (
    select source_table, record_id, path, kind, parent_path, ordinal, json_type(v) = 'OBJECT' is_object, unnest(case json_type(v)
      when 'OBJECT' then list_transform(json_keys(v), lambda k: {step: k, i: null::int, v: v -> ('/' || replace(replace(k, '~', '~0'), '/', '~1'))})
      when 'ARRAY' then list_transform(range(json_array_length(v)::bigint), lambda i: {step: '[' || i || ']', i: i::int, v: v -> ('/' || i)})
      when 'VARCHAR' then case when regexp_matches(v ->> '$', '^\\s*[\\[{"]') and json_valid(v ->> '$') then [{step: null::varchar, i: null::int, v: (v ->> '$')::json}] end end) c from t))
"""


def _kind_sql(kind: str, columns: dict[str, str]) -> str:
    """The flat table of one kind of object in SQL; a list may be spelt as a JSON text."""
    cols = []
    for c, t in columns.items():
        if t.startswith("array"):
            x = f"case when json_type(v -> '{c}') = 'VARCHAR' then case when json_valid(v ->> '{c}') then (v ->> '{c}')::json end else v -> '{c}' end"
            number = {"array<double>": "double", "array<bigint>": "bigint"}[t]
            cols.append(f"case when json_type({x}) = 'ARRAY' then list_transform(range(json_array_length({x})::bigint), lambda i: try_cast(({x} ->> ('/' || i)) as {number})) end as {c}")
        else:
            cols.append(f"v ->> '{c}' as {c}" if t == "string" else f"try_cast(v ->> '{c}' as {t}) as {c}")
    return _P4 + f"select source_table, record_id, path, parent_path, ordinal, {', '.join(cols)} from t where json_type(v) = 'OBJECT' and kind = '{kind}'"


_P6 = r"""
with a0 as (select row_id, min(loaded_at) loaded, any_value(trim(video_key, chr(9)||chr(10)||chr(13)||chr(160)||' ')) vk, any_value(trim(annotation_id, chr(9)||chr(10)||chr(13)||chr(160)||' ')) ak,
    any_value(trim(upstream_annotation_id, chr(9)||chr(10)||chr(13)||chr(160)||' ')) up, any_value(regexp_replace(trim(tracking_bboxes, chr(9)||chr(10)||chr(13)||chr(160)||' '), '^(\./data/|data/|\./dataset/|dataset/)', '')) tp from annotations group by row_id),
pa as (select trim(video_key, chr(9)||chr(10)||chr(13)||chr(160)||' ')||chr(0)||trim(annotation_id, chr(9)||chr(10)||chr(13)||chr(160)||' ') k, min(loaded_at) loaded, bool_or(deleted_at is not null) gone from annotations where trim(annotation_id) <> '' group by 1),
pt as (select regexp_replace(trim(tracking_path, chr(9)||chr(10)||chr(13)||chr(160)||' '), '^(\./data/|data/|\./dataset/|dataset/)', '') k, min(loaded_at) loaded, bool_or(deleted_at is not null) gone from tracking_files group by 1),
f0 as (select file_id, min(loaded_at) loaded, any_value(trim(video_key, chr(9)||chr(10)||chr(13)||chr(160)||' ')) vk, any_value(trim(annotation_id, chr(9)||chr(10)||chr(13)||chr(160)||' ')) ak from tracking_files group by 1),
s0 as (select record_id, min(written_at) loaded, any_value(trim(video_key, chr(9)||chr(10)||chr(13)||chr(160)||' ')) vk, any_value(trim(annotation_id, chr(9)||chr(10)||chr(13)||chr(160)||' ')) ak from prepared_samples group by 1),
r as (select 'annotations' source_table, 'upstream_annotation_id' field, row_id, loaded, vk||chr(0)||up k, 'a' dom, true strict from a0 where up <> ''
  union all select 'annotations', 'tracking_bboxes', row_id, loaded, tp, 't', true from a0 where tp <> ''
  union all select 'prepared_samples', 'annotation_id', record_id, loaded, vk||chr(0)||ak, 'a', true from s0 where ak <> ''
  union all select 'tracking_files', 'annotation_id', file_id, loaded, vk||chr(0)||ak, 'a', false from f0 where ak <> ''),
p as (select 'a' dom, * from pa union all select 't', * from pt),
x as (select r.*, case when p.k is null then 'missing' when p.gone then 'deleted' when r.strict and p.loaded > r.loaded then 'late' end kind from r left join p on p.dom = r.dom and p.k = r.k)
"""
_P6_PERIOD = "strftime(loaded at time zone 'UTC', '%Y-%m')"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p1_found": p1_found, "p1_rows": p1_rows, "p2_found": p2_found, "p2_impossible": p2_impossible, "p4_found": p4_found, "p4_objects": p4_objects, "p4_links": p4_links, **{name: _kind(*k) for name, k in KINDS.items()}, "p6_found": p6_found, "p6_report": p6_report}
SQL: dict[str, str] = {
    "p1_found": _P1 + "select line_id, reason from r where reason is not null",
    "p1_rows": _P1 + "select line_id, try_cast(regexp_replace(f[1], '\\..*$', '') as bigint) as frame, try_cast(regexp_replace(f[2], '\\..*$', '') as bigint) as track_id, " + ", ".join(f"try_cast(f[{k + 1}] as double) as {c}" for k, c in enumerate(parse_lines.TYPED) if k > 1) + " from r where reason is null",
    "p2_impossible": _P2,
    **{name: _kind_sql(*k) for name, k in KINDS.items()},
    "p4_found": _P4 + "select source_table, record_id, path from t where json_type(v) = 'OBJECT' and path <> ''",
    "p6_found": _P6 + f"select source_table, field, row_id, kind, {_P6_PERIOD} as period from x where kind is not null",
    "p6_report": _P6 + f"select source_table, field, kind, {_P6_PERIOD} as period, count(*) as n_rows from x where kind is not null group by all",
}
