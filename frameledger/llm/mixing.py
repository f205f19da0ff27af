"""Mixing sources to target weights by Pfair scheduling of source blocks.

Each source is a line of tokens (its records in hashed order, repeated as needed), cut into blocks of BLOCK_TOKENS
tokens; records run on from one block into the next. The weights are whole numbers of blocks in a period: block j of a
source with n of a period's m blocks is released at floor(j*m/n) and due at ceil((j+1)*m/n); earliest-deadline-first
over the released blocks keeps every source within one block of its share at any point. One period is simulated; the
slots of all later blocks follow by formula, so a mixture may have any number of blocks of the same size.
"""
from __future__ import annotations

import heapq
from fractions import Fraction
from math import gcd, lcm

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from frameledger.llm.tokenize import VOCABULARY, count_tokens
from frameledger.session import ensure_checkpoint_dir

#: Tokens of a block: the grain of the mixture, of which a source strays by less than one.
BLOCK_TOKENS = 4096
#: Parts into which the records of a source are hashed for the running sums; a sum of each meets in one place.
BUCKETS = 1024
#: Longest period; weights that need a longer one are rounded to parts of it (the shares reported are the actual ones).
MOST_SLOTS = 1_000
#: Most target sources; more are refused.
MOST_TARGETS = 1_000


def pfair(blocks: dict[str, int]) -> list[tuple[str, int]]:
    """The order of all blocks: (source, block) by slot, earliest deadline first among those released."""
    m = sum(blocks.values())
    released: list[tuple[int, str, int]] = []
    waiting = [(0, s, 0) for s, n in blocks.items() if n]
    heapq.heapify(waiting)
    out = []
    for slot in range(m):
        while waiting and waiting[0][0] <= slot:
            _, s, j = heapq.heappop(waiting)
            heapq.heappush(released, (-(-(j + 1) * m // blocks[s]), s, j))
        _, s, j = heapq.heappop(released)
        out.append((s, j))
        if j + 1 < blocks[s]:
            heapq.heappush(waiting, ((j + 1) * m // blocks[s], s, j + 1))
    return out


def whole_weights(weights: dict[str, float]) -> dict[str, int]:
    """The weights as the least whole numbers of blocks a period; rounded where these would be more than MOST_SLOTS."""
    exact = {s: Fraction(w).limit_denominator(10**6) for s, w in weights.items()}
    total = sum(exact.values())
    if not total:
        return {}
    parts = {s: x / total for s, x in exact.items()}
    m = lcm(*(p.denominator for p in parts.values()))
    if m <= MOST_SLOTS:
        return {s: int(p * m) for s, p in parts.items()}
    rounded = {s: max(1, round(p * MOST_SLOTS)) for s, p in parts.items()}
    d = gcd(*rounded.values())
    return {s: n // d for s, n in rounded.items()}


def plan(targets: list[tuple[str, float, int]], totals: dict[str, int], block: int) -> tuple[dict[str, list[int]], dict[str, int], int]:
    """Of each source the slots of its blocks in one period, and its blocks in the whole mixture; and the slots of a period.

    The mixture is the longest at whose every point each source has its share, within the caps: it ends before the
    first block for which a source has no tokens left. A source without tokens is left out and the other weights
    are scaled up."""
    live = {s: (w, r * totals[s] // block) for s, w, r in targets if w and w > 0 and r and r > 0 and totals.get(s, 0) > 0}
    weights = whole_weights({s: w for s, (w, _) in live.items()})
    if not weights:
        return {}, {}, 1
    order = pfair(weights)
    slots: dict[str, list[int]] = {s: [] for s in weights}
    for slot, (s, _) in enumerate(order):
        slots[s].append(slot)
    periods = min(live[s][1] // n for s, n in weights.items())
    blocks = {s: periods * n for s, n in weights.items()}
    for s, _ in order:  # what is left does not fill another period
        if blocks[s] == live[s][1]:
            break
        blocks[s] += 1
    return slots, blocks, len(order)


def mix(docs: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY, block: int = BLOCK_TOKENS) -> DataFrame:
    """``slot, source, doc_id, use_no, start_token, n_tokens, pieces``: a row per use of a record, with its first slot
    and the part of it in each block (``pieces``: slot, at, n_tokens - ``at`` is the token of the record it begins
    with). The mixture is the pieces in the order of (slot, start_token): see ``in_order``.

    A record is used once per pass over its source, at most ``max_repeats`` times; the last use of each source may
    be cut by the end of the mixture. Nulls: texts without tokens (null, empty) add nothing and are left out, as are
    sources that are not listed. Repeated rows are records of their own. The running sums are taken per source and
    hashed bucket, so a source with a third of all records is spread over BUCKETS groups; only sums per bucket
    meet in one place. A mixture of less than a block of some source is empty.
    """
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    wanted = [(r["source"], r["weight"], r["max_repeats"]) for r in targets.select("source", "weight", "max_repeats").limit(MOST_TARGETS + 1).collect()]
    if len(wanted) > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} target sources")
    names = [s for s, _, _ in wanted if s is not None]
    listed = docs.where(F.col("source").isin(names)) if names else docs.limit(0)
    sizes = count_tokens(listed, keep=("doc_id", "source"), vocabulary=vocabulary).where("n_tokens > 0")
    sizes = sizes.withColumn("spot", F.xxhash64("doc_id")).withColumn("bucket", F.pmod("spot", F.lit(BUCKETS)).cast("int")).checkpoint()
    sums = sizes.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("tokens"))
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("before", F.coalesce(F.sum("tokens").over(ahead), F.lit(0).cast("bigint"))).select("source", "bucket", "before")
    totals = {r["source"]: r["tokens"] for r in sums.groupBy("source").agg(F.sum("tokens").alias("tokens")).collect()}
    slots, blocks, period = plan(wanted, totals, block)
    per = spark.createDataFrame([(s, n * block, totals[s], -(-n * block // totals[s]), len(slots[s]), slots[s]) for s, n in blocks.items() if n], "source string, need bigint, total bigint, passes bigint, each bigint, spots array<bigint>")
    within = Window.partitionBy("source", "bucket").orderBy("spot", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    # both sides are bounded: targets x BUCKETS rows, and one row per target
    placed = sizes.join(F.broadcast(offsets), ["source", "bucket"])
    placed = placed.withColumn("start", F.col("before") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0).cast("bigint"))).select("source", "doc_id", "n_tokens", "start")
    used = placed.join(F.broadcast(per), "source").withColumn("use", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("passes") - 1))).withColumn("start_token", F.col("start") + F.col("use") * F.col("total")).where("start_token < need")
    size = F.lit(block).cast("bigint")
    stop = F.least(F.col("start_token") + F.col("n_tokens"), F.col("need"))

    def piece(j):
        begin = F.greatest(F.col("start_token"), j * size)
        slot = F.floor(j / F.col("each")) * F.lit(period) + F.get("spots", (j % F.col("each")).cast("int"))
        return F.struct(slot.alias("slot"), (begin - F.col("start_token")).alias("at"), (F.least(stop, (j + 1) * size) - begin).alias("n_tokens"))

    out = used.withColumn("pieces", F.transform(F.sequence(F.floor(F.col("start_token") / size), F.floor((stop - 1) / size)), piece))
    return out.select(F.col("pieces")[0]["slot"].alias("slot"), "source", "doc_id", (F.col("use") + 1).cast("int").alias("use_no"), "start_token", (stop - F.col("start_token")).alias("n_tokens"), "pieces")


def in_order(mixture: DataFrame) -> DataFrame:
    """``slot, source, doc_id, use_no, at, n_tokens``: the pieces in the order they are to be read, range-partitioned
    by slot (a slot has one source and at most a block of tokens)."""
    flat = mixture.select("source", "doc_id", "use_no", "start_token", F.explode("pieces").alias("p"))
    return flat.select("p.slot", "source", "doc_id", "use_no", F.col("p.at").alias("at"), F.col("p.n_tokens").alias("n_tokens"), "start_token").orderBy("slot", "start_token").drop("start_token")


def shares(mixture: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target source: its weight, tokens, actual share, records and most uses of one record."""
    by = mixture.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("uses"), F.max("use_no").alias("most_uses"))
    by = by.withColumn("all_tokens", F.sum("tokens").over(Window.partitionBy()))  # a row per source
    t = targets.select("source", "weight", "max_repeats")
    return t.join(by, "source", "left").select("source", "weight", "max_repeats", F.coalesce("tokens", F.lit(0).cast("bigint")).alias("tokens"), F.coalesce(F.col("tokens") / F.col("all_tokens"), F.lit(0.0)).alias("share"), F.coalesce("uses", F.lit(0).cast("bigint")).alias("uses"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"))
