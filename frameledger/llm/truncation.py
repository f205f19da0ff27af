"""Text cut off by field limits or in transfer.

Per source and field the histograms of lengths, in characters, bytes and words, are tested for spikes at their upper
end. Values of a spike's length without terminal punctuation are cut: evidence ``limit``. Values cut in transfer have
no common length, so no histogram can show them: evidence ``transfer``. They are judged by how they end - an open
bracket, quotation or code fence, or last words that the whole corpus does not end on.
"""
from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from frameledger.llm.reading import END, SPACE, STOP, Beginnings, Reader, slices, unquoted
from frameledger.session import deliveries, ensure_checkpoint_dir, small_join

#: A length is a spike from SPIKE_TIMES its neighbours' mean plus SPIKE_LEAST values on, if no more than
#: TAIL_SHARE of its own number is longer. Neighbours are the lengths up to NEAR away.
SPIKE_TIMES, SPIKE_LEAST, TAIL_SHARE, NEAR = 5.0, 5, 0.2, 15
#: A spike is a limit only if this share of its values differ: texts that recur have their length for another reason.
DISTINCT_SHARE = 0.5
#: An unpunctuated end is whole if its last words end a sentence in this share of their occurrences.
END_SHARE = 0.3
#: A last line (or value) without punctuation is whole if SHARED values at least have it (less is no evidence),
#: and if they are SHARED_PART of themselves and the longer ones that begin so: a share, whatever the number of rows.
#: Cuts fall anywhere, so few of them on one place; of whole answers that sentences also begin with there are more.
SHARED, SHARED_PART = 3, 0.01
#: Begins up to this number are shipped to the tasks.
SHIPPED_BEGINS = 200_000

#: Signs that may stand behind the last sentence.
_CLOSERS = " \t\r\n\f\v )]}\"'»”’*_`"
_TERMINAL = frozenset(".!?。！？؟।")
_STRING = re.compile(r'"(?:[^"\\]|\\.)*"', re.S)
_AFTER_NUMBER = re.compile(r"(?<=9)[.,:]$")  # of a masked text: a number may go on behind it
_MEMBER = re.compile(r'\{\s*["}]')
#: Only signs that close what was begun, also where they are spelt in JSON.
_CLOSING = r"""^(?:[\s"'»”’`)\]}>*_]|\\[n"])*$"""
#: What a text handed on may stand behind: the begin, or a sign that opens it.
_OPENING = r"""(?s)^$|^.*[\n:"'“‘«>`]\s*$"""
#: End classes: punctuated or closed, bare, open.
CLOSED, BARE, OPEN = 0, 1, 2


def terminal(s: str) -> bool:
    """Whether a text ends a sentence, closing signs aside."""
    return s.rstrip(_CLOSERS)[-1:] in _TERMINAL and s.rstrip(_CLOSERS) != ""


def _open_json(s: str) -> bool | None:
    """Whether the JSON of a text (after a possible lead-in) is still open at its end; None if it holds none."""
    if "```" in s and (s.count("```") % 2 or s.endswith(("\n`", "\n``"))):
        return True
    if s.endswith(("\n`", "\n``")):
        return True
    head = s.lstrip()[:1]
    if head in ("[", "`", '"'):
        at = min((i for i in (s.find("{"), s.find("[")) if i >= 0), default=-1)
    else:
        at = s.find("{")
        if at >= 0 and (m := _MEMBER.search(s, at)):
            at = m.start()
        elif at < 0 or s[at + 1 :].strip():
            return None
    if at < 0:
        return None
    body = _STRING.sub('""', s[at:])
    if body.count('"') % 2:
        return True
    return body.count("{") + body.count("[") > body.count("}") + body.count("]")


def end_of(text: str) -> int:
    """End class of a text."""
    s = text.rstrip()
    if not s:
        return CLOSED
    opened = _open_json(s)
    if opened:
        return OPEN
    if not any(map(str.isalnum, s)):
        return CLOSED  # no content that could be cut
    line = s[s.rfind("\n") + 1 :]
    if opened is False and (line[-1] in "}]`\"" or terminal(line)):
        return CLOSED
    if s[-1] == "…":
        return BARE
    if terminal(s):
        return CLOSED
    if line.count("[") > line.count("]") or line.count("(") > line.count(")") or line.count("{") > line.count("}"):
        return OPEN
    if line[-1] in ")]}*_" and any(x in line[:-1] for x in "[({*_"):
        return CLOSED
    return BARE


def value_table(records: DataFrame, key: str, source: str, fields: list[str], arrived: str) -> DataFrame:
    """``record_id, source, field, text, handed_on``: the non-null values of the fields, each record once."""
    return stacked(deliveries(records.select(key, source, *fields, arrived), key, arrived), key, source, fields)


def stacked(once: DataFrame, key: str, source: str, fields: list[str]) -> DataFrame:
    """The value table of records that are there once."""
    pairs = ", ".join(f"'{f}', `{f}`" for f in fields)
    values = once.select(F.col(key).alias("record_id"), F.col(source).alias("source"), F.expr(f"stack({len(fields)}, {pairs}) as (field, text)"), F.col(fields[0]).alias("__first"))
    # a field that hands on the whole first field, be it plain or as a JSON text, stops where that stops
    plain = F.rtrim("__first")
    spelt = F.replace(F.replace(plain, F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))

    def hands_on(h):
        after = F.call_function("substring_index", F.col("text"), h, F.lit(-1))
        before = F.left("text", F.length("text") - F.length(after) - F.length(h))
        return F.contains("text", h) & after.rlike(_CLOSING) & (before.rlike(_OPENING) | (F.trim(before) == h))

    handed = (F.col("field") != fields[0]) & (F.trim("__first") != "") & (hands_on(plain) | hands_on(spelt))
    values = values.withColumn("handed_on", F.coalesce(handed & ~F.col("text").rlike(r"\{\s*\""), F.lit(False)))
    return values.where(F.col("text").isNotNull()).drop("__first")


_KEYS = ["k_tail", "k_line", "k_value"]
_PROFILE = "record_id bigint, source string, field string, handed_on boolean, h_text bigint, n_chars int, n_bytes int, n_words int, ending tinyint, terminal boolean, k_tail bigint, k_line bigint, k_value bigint, line string, value string"


def _final(r: Reader) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each text the last sentence (first and last sign) and the whole (first and last sign); equal ends: none."""
    text, first, last = r.sentences()
    out = [np.zeros(r.n, np.int64) for _ in range(4)]
    out[0][text], out[1][text] = first, last  # the last of each text stays
    out[2][text[::-1]], out[3][text] = first[::-1], last
    return tuple(out)


def _tails(r: Reader) -> tuple[np.ndarray, np.ndarray]:
    """Of each text the context it ends on, and whether there is one: its last token is no stop, and no sign that only
    parts words follows."""
    out, some = np.zeros(r.n, np.uint64), np.zeros(r.n, bool)
    i = np.flatnonzero((r.next_kind() == END) & ~r.stop)
    out[r.text[i]] = r.contexts()[i]
    some[r.text[i]] = True
    return out, some


def profile(values: DataFrame) -> DataFrame:
    """Lengths and end class of every value, and the keys by which the corpus is asked about bare ends."""
    ints = [("n_chars", pa.int32()), ("n_bytes", pa.int32()), ("n_words", pa.int32()), ("ending", pa.int8()), ("terminal", pa.bool_())]
    schema = pa.schema([("record_id", pa.int64()), ("source", pa.string()), ("field", pa.string()), ("handed_on", pa.bool_()), ("h_text", pa.int64()), *ints, *[(k, pa.int64()) for k in _KEYS], ("line", pa.string()), ("value", pa.string())])

    def part(b: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        ending = np.array([end_of(t) for t in texts], np.int8)
        ends = [terminal(t) for t in texts]
        chars, size = [len(t) for t in texts], [len(t) if t.isascii() else len(t.encode("utf-8", "surrogatepass")) for t in texts]
        words = [len(t.split()) for t in texts]
        bare = np.flatnonzero(ending == BARE)
        keys = [np.zeros(len(texts), np.int64) for _ in _KEYS]
        empty = [np.ones(len(texts), bool) for _ in _KEYS]
        strings: list[list] = [[None] * len(texts), [None] * len(texts)]
        if len(bare):
            r = Reader([texts[i].rstrip() for i in bare])
            tail, some = _tails(r)
            some &= np.array([texts[i].rstrip()[-1] not in ",，;；:、" for i in bare])
            a, z, a0, z0 = _final(r)
            for j, (k, ok) in enumerate(((tail, some), (r.spans(a, z), z > a), (r.spans(a0, z0), z0 > a0))):
                keys[j][bare], empty[j][bare] = k.view(np.int64), ~ok
            for n, i in enumerate(bare):
                strings[0][i] = _AFTER_NUMBER.sub("", r.string(a[n], z[n]))
                strings[1][i] = _AFTER_NUMBER.sub("", r.string(a0[n], z0[n]))
        arrays = [b.column("record_id").cast(pa.int64()), b.column("source"), b.column("field"), b.column("handed_on"), b.column("h_text")]
        arrays += [pa.array(c, t) for c, (_, t) in zip((chars, size, words, ending, ends), ints)]
        arrays += [pa.array(k, pa.int64(), mask=e) for k, e in zip(keys, empty)] + [pa.array(s, pa.string()) for s in strings]
        return pa.RecordBatch.from_arrays(arrays, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            for i, j in slices(texts):
                yield part(b.slice(i, j - i), texts[i:j])

    return values.select("record_id", "source", "field", "handed_on", F.xxhash64("text").alias("h_text"), "text").mapInArrow(run, _PROFILE)


def corpus_ends(values: DataFrame) -> DataFrame:
    """``key, n, e`` over all values: of contexts (kind in the last bits: see ``_kinded``) the occurrences and those that
    end a sentence; of last lines the values that end on them; of whole values their number.

    Counted per slice before the shuffle, so frequent words cost one row per slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [unquoted(t).strip() for t in b.column("text").to_pylist()]
            for i, j in slices(texts):
                r = Reader(texts[i:j])
                after = r.next_kind()
                use = ~r.stop & (after != END)
                seen, at, n = np.unique(r.contexts()[use], return_inverse=True, return_counts=True)
                e = np.bincount(at, weights=(after[use] == STOP), minlength=len(seen)).astype(np.int64)
                a, z, a0, z0 = _final(r)
                lines, n1 = np.unique(r.spans(a, z), return_counts=True)
                whole, n2 = np.unique(r.spans(a0, z0), return_counts=True)
                zero = np.zeros(len(lines) + len(whole), np.int64)
                key = np.concatenate([_kinded(seen, 0), _kinded(lines, 1), _kinded(whole, 2)])
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.concatenate([n, n1, n2])), pa.array(np.concatenate([e, zero]))], names=["key", "n", "e"])

    return values.select("text").mapInArrow(run, "key bigint, n bigint, e bigint").groupBy("key").agg(F.sum("n").alias("n"), F.sum("e").alias("e"))


def _kinded(h: np.ndarray, kind: int) -> np.ndarray:
    """The hash with its kind (0 context, 1 line, 2 value) in the last two bits."""
    return ((h & ~np.uint64(3)) | np.uint64(kind)).view(np.int64)


class _Begins:
    """The asked begins of one kind by length: sorted hashes, and their places in the list."""

    def __init__(self, begins: list[str]):
        r = Reader(begins)
        start = np.append(0, r.ends[:-1] + 1) if begins else np.zeros(0, np.int64)
        size = r.ends - start
        h = Beginnings(r.c).of(start, size) if begins else np.zeros(0, np.uint64)
        self.by: list[tuple[int, np.ndarray, np.ndarray]] = []
        for n in np.unique(size[size > 0]):
            at = np.flatnonzero(size == n)
            order = at[np.argsort(h[at])]
            self.by.append((int(n), h[order], order))

    def count(self, b: Beginnings, first: np.ndarray, size: np.ndarray, into: np.ndarray) -> None:
        """Adds to each begin the stretches that are longer and begin so."""
        for n, known, place in self.by:
            more = first[size > n]
            h = b.of(more, n)
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            into += np.bincount(place[at[known[at] == h]], minlength=len(into))


def _head_sizes(r: Reader, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Signs of each stretch without the stops at its end, and without a sign behind a number, which may go on."""
    solid = np.flatnonzero((r.k != STOP) & (r.k != SPACE) & (r.k != END))
    at = np.searchsorted(solid, last)
    end = np.where(at > 0, solid[np.maximum(at, 1) - 1] + 1, 0) if len(solid) else np.zeros(len(first), np.int64)
    size = np.maximum(end - first, 0)
    mark = r.c[np.maximum(end - 1, 0)]
    size -= (size > 1) & ((mark == 44) | (mark == 58)) & (r.c[np.maximum(end - 2, 0)] == 57)
    return size


def longer(values: DataFrame, asked: DataFrame) -> DataFrame:
    """``kind, begin, longer``: of the asked begins the sentences (kind ``l``) or values (``v``) of the whole corpus
    that begin with them and go on, at whatever sign; a full stop alone does not make one longer.

    Begins up to SHIPPED_BEGINS are shipped and compared by 64-bit hashes of their signs; beyond it, distinct heads and
    two probes per begin are sorted over the cluster, and a begin's number is the difference of the running sums at
    its probes."""
    known = asked.select("kind", "begin").limit(SHIPPED_BEGINS + 1).collect()
    if len(known) <= SHIPPED_BEGINS:
        return _longer_shipped(values, [(r["kind"], r["begin"]) for r in known])

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [unquoted(t).strip() for t in b.column("text").to_pylist()]
            for i, j in slices(texts):
                r = Reader(texts[i:j])
                text, first, last = r.sentences()
                opens = np.append(True, text[1:] != text[:-1])[: len(text)]
                seen: Counter = Counter()
                for kind, at, ends in (("l", np.arange(len(first)), last), ("v", np.flatnonzero(opens), r.ends[text])):
                    size = _head_sizes(r, first[at], ends[at])
                    for s, n in zip(at, size):
                        seen[(kind + r.string(first[s], first[s] + n)).encode("utf-8", "surrogatepass")] += 1
                yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], names=["at", "n"])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, part, upto = ["part", "begin", "sum"], TaskContext.get().partitionId(), 0
        as_batch = lambda begin, n: pa.RecordBatch.from_arrays([pa.array([part] * len(n), pa.int32()), pa.array(begin, pa.binary()), pa.array(n, pa.int64())], names=names)
        for b in batches:
            out: tuple[list, list] = ([], [])
            for n, begin, sign in zip(*(b.column(c).to_pylist() for c in ("n", "begin", "sign"))):
                if begin is None:
                    upto += n
                else:
                    out[0].append(begin), out[1].append((sign, upto))
            yield pa.RecordBatch.from_arrays([*as_batch(out[0], [u for _, u in out[1]]).columns, pa.array([s for s, _ in out[1]], pa.int32())], names=[*names, "sign"])
        yield pa.RecordBatch.from_arrays([*as_batch([None], [upto]).columns, pa.array([0], pa.int32())], names=[*names, "sign"])

    table = values.select("text").mapInArrow(heads, "at binary, n bigint").groupBy("at").agg(F.sum("n").alias("n"))
    begin = asked.select(F.concat(F.encode("kind", "UTF-8"), F.encode("begin", "UTF-8")).alias("begin"))
    probe = lambda end, sign: begin.select(F.concat("begin", F.unhex(F.lit(end))).alias("at"), F.lit(0).cast("bigint").alias("n"), "begin", F.lit(sign).alias("sign"))
    rows = table.select("at", "n", F.lit(None).cast("binary").alias("begin"), F.lit(0).alias("sign")).unionByName(probe("00", -1)).unionByName(probe("FF", 1))
    # probes stand before heads that equal them; partitions keep the order of their ranges
    told = rows.repartitionByRange("at").sortWithinPartitions("at", F.col("begin").isNull()).mapInArrow(sums, "part int, begin binary, sum bigint, sign int").checkpoint()
    w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = told.where("begin is null").select("part", F.coalesce(F.sum("sum").over(w), F.lit(0)).alias("before"))  # a row per partition
    found = told.where("begin is not null").join(F.broadcast(before), "part").groupBy("begin").agg(F.sum(F.col("sign") * (F.col("sum") + F.col("before"))).alias("longer"))
    text = F.decode("begin", "UTF-8")
    return found.select(F.substring(text, 1, 1).alias("kind"), text.substr(F.lit(2), F.length(text)).alias("begin"), "longer")


def _longer_shipped(values: DataFrame, asked: list[tuple[str, str]]) -> DataFrame:
    spark = values.sparkSession
    by = {k: [b for kind, b in asked if kind == k] for k in "lv"}
    known = spark.sparkContext.broadcast(by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begins = {k: _Begins(v) for k, v in known.value.items()}
        total = {k: np.zeros(len(v), np.int64) for k, v in known.value.items()}
        for b in batches:
            texts = [unquoted(t).strip() for t in b.column("text").to_pylist()]
            for i, j in slices(texts):
                r = Reader(texts[i:j])
                text, first, last = r.sentences()
                if not len(first):
                    continue
                h = Beginnings(r.c)
                opens = np.append(True, text[1:] != text[:-1])
                begins["l"].count(h, first, _head_sizes(r, first, last), total["l"])
                begins["v"].count(h, first[opens], _head_sizes(r, first[opens], r.ends[text[opens]]), total["v"])
        for k, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(at), pa.string()), pa.array([known.value[k][i] for i in at], pa.string()), pa.array(n[at])], names=["kind", "begin", "longer"])

    counted = values.select("text").mapInArrow(run, "kind string, begin string, longer bigint") if asked else spark.createDataFrame([], "kind string, begin string, longer bigint")
    return counted.groupBy("kind", "begin").agg(F.sum("longer").alias("longer"))


def length_spikes(profiled: DataFrame) -> DataFrame:
    """``source, field, measure, length, n`` of the spikes at the upper end of the length histograms."""
    stacked = F.expr("stack(3, 'chars', n_chars, 'bytes', n_bytes, 'words', n_words) as (measure, length)")
    hist = profiled.select("source", "field", "h_text", stacked).groupBy("source", "field", "measure", "length").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("h_text").alias("texts"))
    w = Window.partitionBy("source", "field", "measure").orderBy("length")
    zero = lambda c: F.coalesce(c, F.lit(0))
    # means over all lengths nearby, also those that no value has
    left = zero(F.sum("n").over(w.rangeBetween(-NEAR, -3))) / (NEAR - 2)
    right = zero(F.sum("n").over(w.rangeBetween(3, NEAR))) / (NEAR - 2)
    above = zero(F.sum("n").over(w.rowsBetween(1, Window.unboundedFollowing)))
    t = hist.withColumns({"near": F.greatest(left, right), "above": above})
    stands_out = (F.col("n") > SPIKE_TIMES * F.col("near") + SPIKE_LEAST) & (F.col("above") <= TAIL_SHARE * F.col("n")) & (F.col("texts") >= DISTINCT_SHARE * F.col("n"))
    return t.where(stands_out).select("source", "field", "measure", "length", "n")


def judged(values: DataFrame) -> DataFrame:
    """Every value with its evidence: ``record_id, source, field, n_chars, at_limit, is_open, bare, whole_end,
    cut, evidence`` (``limit`` or ``transfer``; null for whole values).

    A value is cut if it is at a limit without terminal punctuation (structures: without being closed), if
    it ends open, or if it ends bare on words that do not end sentences and on no line that is common.
    Null values have no row; empty ones are whole. Long values are judged whole; a null source is one of its own.
    """
    ensure_checkpoint_dir(values.sparkSession)
    p = profile(values).withColumn("source_", F.coalesce("source", F.lit("\0"))).checkpoint()  # a few numbers per value, read by the histograms and the verdicts
    spikes = length_spikes(p.withColumn("source", F.col("source_"))).groupBy("source", "field").agg(F.collect_list(F.struct("measure", "length")).alias("limits"))  # a handful a source and field
    p = small_join(p, spikes.withColumnRenamed("source", "source_"), ["source_", "field"], "record_id", "left")
    within = lambda m, n: F.exists("limits", lambda x: (x["measure"] == m) & (x["length"] == F.col(n)))
    # a limit in words cuts no word, so a closing sign at one is the writer's own
    p = p.withColumn("at_limit", F.coalesce(within("chars", "n_chars") | within("bytes", "n_bytes") | (within("words", "n_words") & (F.col("ending") != CLOSED)), F.lit(False))).drop("limits", "source_")
    is_bare = F.col("ending") == BARE
    settled = F.col("at_limit") & ~F.col("terminal")  # the limit decides, however the last words read
    bare = p.where(is_bare & ~settled)
    # one pass over the corpus answers all three questions of a bare end
    kinds = ("tail", "line", "value")
    last = F.lit(~3).cast("bigint")
    asked = bare.select("record_id", "field", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"k_{k}").bitwiseAND(last).bitwiseOR(F.lit(i).cast("bigint")).alias("key")) for i, k in enumerate(kinds)])).alias("q")).select("record_id", "field", "q.*")
    told = asked.where("key is not null").join(corpus_ends(values), "key")
    told = told.groupBy("record_id", "field").agg(*[F.max(F.when(F.col("kind") == k, F.col(c))).alias(f"{k}_{c}") for k in kinds for c in ("n", "e")])
    bare = bare.join(told, ["record_id", "field"], "left").checkpoint()  # read by the questions about longer lines, and by the verdicts
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    ends = (zero("tail_e") + 0.1) / (zero("tail_n") + 1.0) >= END_SHARE
    enough = {"line": "l", "value": "v"}
    begins = [bare.where(~ends & (F.col(f"{k}_n") >= SHARED)).select(F.lit(kind).alias("kind"), F.col(k).alias("begin")) for k, kind in enough.items()]
    more = longer(values, begins[0].unionByName(begins[1]).distinct()).checkpoint()  # a row per begin, read for both kinds
    for k, kind in enough.items():
        bare = bare.join(more.where(F.col("kind") == kind).select(F.col("begin").alias(k), F.col("longer").alias(f"{k}_longer")), k, "left")
    common = lambda k: (zero(f"{k}_n") >= SHARED) & (zero(f"{k}_n") >= SHARED_PART * (zero(f"{k}_n") + zero(f"{k}_longer")))
    bare = bare.withColumn("whole_end", ends | common("line") | common("value"))
    rest = p.where(~is_bare | settled).withColumn("whole_end", F.col("ending") == CLOSED)
    cols = ["record_id", "source", "field", "handed_on", "n_chars", "at_limit", "ending", "terminal", "whole_end"]
    both = bare.select(*cols).unionByName(rest.select(*cols))
    structured = (F.col("ending") == CLOSED) & ~F.col("terminal")
    limit_cut = F.col("at_limit") & ~F.col("terminal") & ~(structured & (F.col("field") == "structurer_raw_response"))
    cut = (limit_cut | (F.col("ending") == OPEN) | ~F.col("whole_end")) & ~(F.col("handed_on") & ~F.col("at_limit"))
    evidence = F.when(cut, F.when(F.col("at_limit"), "limit").otherwise("transfer"))
    return both.select("record_id", "source", "field", "n_chars", "at_limit", (F.col("ending") == OPEN).alias("is_open"), (F.col("ending") == BARE).alias("bare"), "whole_end", cut.alias("cut"), evidence.alias("evidence"))


def truncation_rates(evidence: DataFrame) -> DataFrame:
    """Per source and field: values, cut values (by evidence) and their share."""
    count = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("bigint"))
    g = evidence.groupBy("source", "field").agg(F.count(F.lit(1)).alias("n_values"), count(F.col("cut")).alias("n_cut"), count(F.col("evidence") == "limit").alias("n_limit"), count(F.col("evidence") == "transfer").alias("n_transfer"))
    return g.withColumn("rate", F.col("n_cut") / F.col("n_values"))
