"""Extension points that call a model or a judge: loaded once per worker, rows in Arrow batches, failures kept
per row. Retries cover malformed answers only; a raised error marks its row and the next run tries again."""
from __future__ import annotations

import importlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameledger.functions.text import recover_json
from frameledger.operators.evaluate import NO_DECISION, decision
from frameledger.schemas import DECISION_TYPE


class Adapter:
    """A model: subclass, load in ``start`` (once per worker), answer in ``predict``."""

    name = "adapter"

    def start(self) -> None:
        pass

    def predict(self, sample: dict) -> str:
        raise NotImplementedError


class Judge:
    """A judge: returns its response text; ``retries`` further tries on malformed ones."""

    retries = 2

    def start(self) -> None:
        pass

    def respond(self, row: dict) -> str:
        raise NotImplementedError


class StaticJudge(Judge):
    def __init__(self, verdict: int = 1):
        self.verdict = verdict

    def respond(self, row):
        return json.dumps(dict.fromkeys(NO_DECISION, self.verdict) | {"confidence": "high", "brief_reason": "static"})


def load(spec: str, kind: type):
    """``module:Class`` as an instance of ``kind``."""
    module, _, name = spec.partition(":")
    found = getattr(importlib.import_module(module), name)()
    if not isinstance(found, kind):
        raise TypeError(f"{spec} is no {kind.__name__}")
    return found


def as_text(output) -> str:
    return output if isinstance(output, str) else json.dumps(output, ensure_ascii=False) if isinstance(output, (dict, list)) else str(output)


def predict(inputs: DataFrame, adapter: Adapter) -> DataFrame:
    """sample_id, protocol_id, raw_output, error: each input row (sample_id, protocol_id, messages; further columns,
    such as the media to show, reach the adapter too) answered.

    The result should be written before it is used twice: answers are paid for."""
    schema = pa.schema([("sample_id", pa.string()), ("protocol_id", pa.string()), ("raw_output", pa.string()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        adapter.start()
        for b in batches:
            rows = []
            for r in b.to_pylist():
                try:
                    rows.append({"raw_output": as_text(adapter.predict(r)), "error": None})
                except Exception as e:  # noqa: BLE001 - a row's failure is its result
                    rows.append({"raw_output": None, "error": f"{type(e).__name__}: {e}"})
                rows[-1] |= {"sample_id": r["sample_id"], "protocol_id": r["protocol_id"]}
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return inputs.mapInArrow(run, "sample_id string, protocol_id string, raw_output string, error string")


def judge(rows: DataFrame, backend: Judge) -> DataFrame:
    """sample_id, protocol_id, decision, error for the rows that need a judge (filter before: see
    ``evaluate.needs_judge``). A row whose tries are all malformed has an error and no decision."""
    bits = [(k, pa.int32()) for k in NO_DECISION] + [("confidence", pa.string()), ("brief_reason", pa.string())]
    schema = pa.schema([("sample_id", pa.string()), ("protocol_id", pa.string()), ("decision", pa.struct(bits)), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        backend.start()
        for b in batches:
            out = []
            for r in b.to_pylist():
                made, error = None, "malformed response"
                try:
                    for _ in range(backend.retries + 1):
                        try:
                            made = decision(recover_json(backend.respond(r)))
                        except (ValueError, RecursionError):
                            made = None
                        if made is not None:
                            error = None
                            break
                except Exception as e:  # noqa: BLE001 - transport errors are not tried again
                    error = f"{type(e).__name__}: {e}"
                out.append({"sample_id": r["sample_id"], "protocol_id": r["protocol_id"], "decision": made, "error": error})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return rows.mapInArrow(run, f"sample_id string, protocol_id string, decision {DECISION_TYPE}, error string")


#: Pieces of one answer that are joined at once.
PIECES = 4096


def stream_texts(chunks: DataFrame) -> DataFrame:
    """request, choice, text: streamed pieces (``ord`` orders them) joined per choice; null pieces are empty.

    Joined in two steps, PIECES at a time, so that an answer of very many pieces is spread over tasks until only its
    text is left; ``ord`` counts the pieces of a request from 0 or 1."""
    def joined(df: DataFrame, keys: list[str], order: str) -> DataFrame:
        parts = F.array_sort(F.collect_list(F.struct(order, F.coalesce("piece", F.lit("")).alias("piece"))))
        return df.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda x: x["piece"]), "").alias("piece"))

    cut = chunks.withColumn("block", F.floor(F.col("ord") / PIECES))
    return joined(joined(cut, ["request", "choice", "block"], "ord"), ["request", "choice"], "block").withColumnRenamed("piece", "text")


class ModelBackend:
    """A remote model behind an OpenAI-like client: ``client(**options)`` is made once per worker and ``stream`` gives
    the pieces of every choice. Both the structurer and the judge below use it; subclass for another API."""

    def __init__(self, client, model: str, temperature: float = 0.0, extra_body: dict | None = None):
        self.client, self.model, self.temperature = client, model, temperature
        self.extra_body = {"enable_thinking": False} | (extra_body or {})
        self.made = None

    def texts(self, messages: list[dict]) -> list[str]:
        """The whole text of each choice; blank choices are left out."""
        if self.made is None:
            self.made = self.client()
        found: dict[int, list[str]] = {}
        for chunk in self.made.stream(model=self.model, messages=messages, temperature=self.temperature, extra_body=self.extra_body):
            for index, piece in chunk:
                found.setdefault(index, []).append(piece or "")
        return [t for t in ("".join(found[i]) for i in sorted(found)) if t.strip()]


class ModelJudge(Judge):
    """The judge's prompt is asked for; the first choice is its response."""

    def __init__(self, backend: ModelBackend, retries: int = 2):
        self.backend, self.retries = backend, retries

    def respond(self, row):
        found = self.backend.texts([{"role": "user", "content": row["prompt"]}])
        return found[0] if found else ""
