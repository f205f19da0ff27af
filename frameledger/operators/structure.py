"""Validation of structured predictions: typed prediction or errors, never both, plus warnings."""
from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameledger.schemas import PAYLOAD_KIND, SENTINEL_BOX


#: What is said of a payload that does not fit its task.
SAYS = {
    "task": "unsupported task for structured validation: {}",
    "no_text": "missing text field",
    "no_bbox": "missing bbox field",
    "list": "{} must be a list",
    "four": "{} must contain exactly 4 values",
    "numeric": "{} must contain numeric values",
    "finite": "{} must contain finite numeric values",
    "object": "{} must be an object",
    "members": "{} must contain {}",
    "window": "time_window_sampled must be empty or contain exactly 2 values",
    "blank_label": "{}.label must be non-empty",
    "twice": "duplicate object label: {}",
    "unexpected": "unexpected object label: {}",
    "missing": "missing object label: {}; using sentinel bbox",
}
#: The members that the rows of each list need, and how they are listed.
NEEDS = {
    "segments": (("start_sampled", "end_sampled", "text"), "start_sampled, end_sampled, and text"),
    "tracking": (("frame_sampled", "bbox_mot"), "frame_sampled and bbox_mot"),
    "objects": (("label", "bbox"), "label and bbox"),
}


class Fatal(Exception):
    """An index that is no integer: the sample fails without another try."""


def _whole(v) -> int:
    if v is None or isinstance(v, (list, dict)):
        raise Fatal(f"no integer: {v!r}")
    try:
        return int(v)
    except (TypeError, ValueError, OverflowError) as e:
        raise Fatal(str(e)) from e


class Check:
    """One payload under validation; collects what is wrong with it."""

    def __init__(self, payload: dict, labels: list[str] | None):
        self.payload, self.labels = payload, labels
        self.errors: list[str] = []
        self.warnings: list[str] = []

    def text(self) -> str:
        if "text" in self.payload:
            return str(self.payload["text"]).strip()
        self.errors.append(SAYS["no_text"])
        return ""

    def box(self, value, where: str, errors: list[str]) -> list[float] | None:
        if not isinstance(value, list):
            errors.append(SAYS["list"].format(where))
        elif len(value) != 4:
            errors.append(SAYS["four"].format(where))
        else:
            try:
                sides = [float(x) for x in value]
            except (TypeError, ValueError):
                errors.append(SAYS["numeric"].format(where))
                return None
            if all(map(math.isfinite, sides)):
                return sides
            errors.append(SAYS["finite"].format(where))
        return None

    def rows(self, name: str):
        """(position, row) of the objects of a list member that have what they need."""
        needs, listing = NEEDS[name]
        value = self.payload.get(name)
        if not isinstance(value, list):
            self.errors.append(SAYS["list"].format(name))
            return
        for i, row in enumerate(value):
            if not isinstance(row, dict):
                self.errors.append(SAYS["object"].format(f"{name}[{i}]"))
            elif any(k not in row for k in needs):
                self.errors.append(SAYS["members"].format(f"{name}[{i}]", listing))
            else:
                yield i, row

    def segments(self) -> list[dict]:
        return [{"start_sampled": _whole(r["start_sampled"]), "end_sampled": _whole(r["end_sampled"]), "text": str(r["text"]).strip()} for _, r in self.rows("segments")]

    def tracking(self) -> list[dict]:
        out = []
        for i, r in self.rows("tracking"):
            frame = _whole(r["frame_sampled"])
            sides = self.box(r["bbox_mot"], f"tracking[{i}].bbox_mot", self.errors)
            if sides:
                out.append({"frame_sampled": frame, "bbox_mot": sides})
        return out

    def window(self) -> list[int]:
        value = self.payload.get("time_window_sampled")
        if not isinstance(value, list):
            self.errors.append(SAYS["list"].format("time_window_sampled"))
            return []
        if len(value) in (0, 2):
            return [_whole(x) for x in value]
        self.errors.append(SAYS["window"])
        return []

    def objects(self) -> list[dict]:
        wanted = []
        for i, label in enumerate(self.labels or []):
            name = (label or "").strip()
            if name:
                wanted.append(name)
            else:
                self.errors.append(SAYS["blank_label"].format(f"reference objects[{i}]"))
        if self.labels is None:
            self.errors.append(SAYS["list"].format("reference objects"))
        seen: dict[str, list[float]] = {}
        for i, r in self.rows("objects"):
            name = str(r["label"]).strip()
            if not name:
                self.errors.append(SAYS["blank_label"].format(f"objects[{i}]"))
            elif name in seen:
                self.errors.append(SAYS["twice"].format(name))
            elif name not in wanted:
                self.errors.append(SAYS["unexpected"].format(name))
            else:
                wrong: list[str] = []
                sides = self.box(r["bbox"], f"objects[{i}].bbox", wrong)
                self.errors += wrong
                if sides:
                    seen[name] = sides
        if self.errors:
            return []
        for name in wanted:
            if name not in seen:
                self.warnings.append(SAYS["missing"].format(name))
        return [{"label": n, "bbox": seen.get(n, list(SENTINEL_BOX))} for n in wanted]


#: Which parts a payload of each kind has, in the order they are checked.
PARTS = {"text": ["text"], "box": ["bbox", "text"], "objects": ["text", "objects"], "segments": ["segments"], "segments+tracking": ["segments", "tracking"], "window+tracking": ["window", "tracking"]}


def validate(task: str | None, payload, labels: list[str] | None, oracle: bool = False) -> dict:
    """prediction, errors, warnings, fatal of one recovered payload."""
    out = {"prediction": None, "errors": [], "warnings": [], "fatal": None}
    kind = PAYLOAD_KIND.get(task or "")
    if kind is None:
        return out | {"errors": [SAYS["task"].format(task)]}
    if not isinstance(payload, dict):
        return out | {"errors": ["response is no JSON object"]}
    check = Check(payload, labels)
    made: dict = {}
    try:
        for part in PARTS[kind]:
            if part == "tracking" and oracle:
                continue  # the truth was given, so it is not asked for
            if part == "text":
                made["text"] = check.text()
            elif part == "bbox":
                if "bbox" in payload:
                    made["bbox"] = check.box(payload["bbox"], "bbox", check.errors)
                else:
                    check.errors.append(SAYS["no_bbox"])
            elif part == "objects":
                made["objects"] = check.objects()
            elif part == "segments":
                made["segments"] = check.segments()
            elif part == "window":
                made["time_window_sampled"] = check.window()
            else:
                made["tracking"] = check.tracking()
    except Fatal as e:
        return out | {"fatal": str(e), "warnings": check.warnings}
    return out | {"prediction": None if check.errors else made, "errors": check.errors, "warnings": check.warnings}


_VERDICT = "sample_id string, protocol_id string, prediction string, errors array<string>, warnings array<string>, fatal string"


def structure_responses(records: DataFrame, oracle: bool = False) -> DataFrame:
    """Recovers and validates responses: sample_id, protocol_id, prediction (JSON), errors, warnings, fatal.

    ``records``: sample_id, protocol_id, task_name, response, labels. A null response gives the error
    ``no response``; nothing is dropped."""
    schema = pa.schema([("sample_id", pa.string()), ("protocol_id", pa.string()), ("prediction", pa.string()), ("errors", pa.list_(pa.string())), ("warnings", pa.list_(pa.string())), ("fatal", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from frameledger.functions.text import recover_json

        for b in batches:
            rows = []
            for r in b.to_pylist():
                if r["response"] is None:
                    v = {"prediction": None, "errors": ["no response"], "warnings": [], "fatal": None}
                else:
                    try:
                        v = validate(r["task_name"], recover_json(r["response"]), r["labels"], oracle)
                    except (ValueError, RecursionError):
                        v = {"prediction": None, "errors": ["response is no valid JSON"], "warnings": [], "fatal": None}
                p = v["prediction"]
                rows.append(v | {"sample_id": r["sample_id"], "protocol_id": r["protocol_id"], "prediction": None if p is None else json.dumps(p, ensure_ascii=False)})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return records.select("sample_id", "protocol_id", "task_name", "response", F.col("labels").cast("array<string>").alias("labels")).mapInArrow(run, _VERDICT)


class Backend:
    """Turns a rendered prompt into candidate responses; the first valid one counts. Subclasses run on the
    workers and may hold a client; malformed responses are asked for again up to ``retries`` times."""

    retries = 2

    def complete(self, prompt: str, raw_output: str) -> list[str]:
        raise NotImplementedError


class StaticParse(Backend):
    """The model's own output is the candidate."""

    retries = 0

    def complete(self, prompt, raw_output):
        return [raw_output]


class ModelStructurer(Backend):
    """A remote model asked with the rendered prompt; every choice is a candidate."""

    def __init__(self, backend, retries: int = 2):
        self.backend, self.retries = backend, retries

    def complete(self, prompt, raw_output):
        return self.backend.texts([{"role": "user", "content": prompt}])


def structure_with(records: DataFrame, backend: Backend, oracle: bool = False) -> DataFrame:
    """As ``structure_responses``, asking a backend: ``records`` has prompt and raw_output instead of response."""
    schema = "sample_id string, protocol_id string, task_name string, labels array<string>, response string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from frameledger.functions.text import recover_json

        for b in batches:
            rows = []
            for r in b.to_pylist():
                kept = None
                for _ in range(backend.retries + 1):
                    for candidate in backend.complete(r["prompt"], r["raw_output"]):
                        kept = candidate if kept is None else kept
                        try:
                            v = validate(r["task_name"], recover_json(candidate), r["labels"], oracle)
                        except (ValueError, RecursionError):
                            continue
                        kept = candidate
                        if v["prediction"] is not None or v["fatal"] is not None:
                            break
                    else:
                        continue
                    break
                rows.append({"sample_id": r["sample_id"], "protocol_id": r["protocol_id"], "task_name": r["task_name"], "labels": r["labels"], "response": kept})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("sample_id", pa.string()), ("protocol_id", pa.string()), ("task_name", pa.string()), ("labels", pa.list_(pa.string())), ("response", pa.string())]))

    asked = records.select("sample_id", "protocol_id", "task_name", F.col("labels").cast("array<string>").alias("labels"), "prompt", "raw_output").mapInArrow(run, schema)
    return structure_responses(asked, oracle)
