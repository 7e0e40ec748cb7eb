"""Mix sources to target weights along a time-varying curriculum.

Method: every source has a weight schedule over the training time 0..1, whose
integral is its target weight. Integrating it gives the source's cumulative
token demand; inverting that demand at the tokens that precede a document of
the source gives the document's training position, and range-sorting by
position yields the training order. A source is repeated pass by pass until
its demand is met, at most ``max_repeats`` times. A source is short if the tokens
placed for it stay below its demand.

Rules: sources are compared trimmed and in lower case; the total size counts
every document, those without a listed source too; a null or empty text has no
tokens and, as there is nothing to train on, no position in the order;
of several target rows of one source the weights add up and the largest
``max_repeats`` holds; a null or negative ``max_repeats`` is 0 and a null or
negative weight is 0; documents are used whole, so a source may exceed its
demand by less than one document. Extra columns are ignored; with no documents
every position table is empty and the report lists the targets with size 0.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.durable import materialize, running_total

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Targets are few by nature; more than this many are refused rather than broadcast.
MOST_TARGETS = 100_000


@lru_cache(maxsize=2)
def _encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding("mixing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _counter(path: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(path).encode_ordinary
        for batch in batches:
            tokens = [len(encode(t)) if t else 0 for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["source"], pa.array(tokens, pa.int64())], names=["doc_id", "source", "tokens"])

    return count


def token_sizes(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """``(doc_id, source, tokens)`` with normalised sources."""
    source = F.lower(F.trim(F.col("source").cast("string")))
    rows = documents.select(F.col("doc_id").cast("bigint"), source.alias("source"), F.col("text").cast("string"))
    return rows.mapInArrow(_counter(tokenizer), "doc_id bigint, source string, tokens bigint")


@dataclass
class Mixture:
    #: ``(position, source, doc_id, repeat, tokens)`` in training order
    order: DataFrame
    #: ``(source, weight, max_repeats, size, demand, reachable, short, used, actual_share)``
    report: DataFrame


def _segments(schedule: Mapping[str, Sequence[tuple[float, float]]], sources: list[str]) -> list[tuple]:
    """Linear pieces (source, t0, t1, w0, w1, cum0, cum1), scaled to the integral 1 per source."""
    out = []
    for source in sources:
        knots = sorted(schedule.get(source, [(0.0, 1.0), (1.0, 1.0)]))
        if knots[0][0] > 0:
            knots.insert(0, (0.0, knots[0][1]))
        if knots[-1][0] < 1:
            knots.append((1.0, knots[-1][1]))
        pieces = [(a, b, max(0.0, x), max(0.0, y)) for (a, x), (b, y) in zip(knots, knots[1:]) if b > a]
        area = sum((b - a) * (x + y) / 2 for a, b, x, y in pieces)
        if area <= 0:
            raise ValueError(f"the schedule of {source} is nowhere positive")
        done = 0.0
        for a, b, x, y in pieces:
            part = (b - a) * (x + y) / 2 / area
            if part > 0:
                out.append((source, a, b, x / area, y / area, done, done + part))
                done += part
        out[-1] = (*out[-1][:-1], math.inf)  # rounding must not leave the last documents without a piece
    return out


def opposing_ramps(targets: DataFrame) -> dict[str, list[tuple[float, float]]]:
    """A schedule under which every other source (by name) grows threefold over the training while the others shrink to a third."""
    rows = targets.where(F.col("source").isNotNull()).select(F.lower(F.trim("source")).alias("source")).distinct().limit(MOST_TARGETS + 1).collect()
    names = sorted(r.source for r in rows)
    return {name: [(0.0, 1.5), (1.0, 0.5)] if i % 2 else [(0.0, 0.5), (1.0, 1.5)] for i, name in enumerate(names)}


def adherence(mixture: Mixture, schedule: Mapping[str, Sequence[tuple[float, float]]], steps: int = 10) -> DataFrame:
    """``(source, step, planned, kept)``: per source and slice of the training time the share of the source's tokens that its
    schedule demands, and whether the tokens placed there keep to it but for a document at either end of the slice."""
    spark = mixture.order.sparkSession
    grown = mixture.report.where("used > 0").select("source", F.least("demand", F.col("reachable").cast("double")).alias("goal"))
    names = sorted(r.source for r in grown.select("source").collect())  # at most MOST_TARGETS
    pieces = _segments({k.strip().lower(): v for k, v in schedule.items()}, names)
    plan = []
    for source in names:
        for step in range(steps):
            share = 0.0
            for _, t0, t1, w0, w1, _, _ in (x for x in pieces if x[0] == source):
                a, b = max(t0, step / steps), min(t1, (step + 1) / steps)
                if b > a:
                    at = lambda t, t0=t0, t1=t1, w0=w0, w1=w1: w0 + (w1 - w0) * (t - t0) / (t1 - t0)
                    share += (b - a) * (at(a) + at(b)) / 2
            plan.append((source, step, share))
    planned = spark.createDataFrame(plan, "source string, step int, planned double")
    placed = mixture.order.groupBy("source", F.least(F.floor(F.col("position") * steps), F.lit(steps - 1)).cast("int").alias("step")).agg(F.sum("tokens").alias("placed"))
    longest = mixture.order.groupBy("source").agg(F.max("tokens").alias("longest"))
    off = F.abs(F.coalesce("placed", F.lit(0)) - F.col("planned") * F.col("goal"))
    full = planned.join(grown, "source").join(longest, "source").join(placed, ["source", "step"], "left")
    return full.select("source", "step", F.round("planned", 9).alias("planned"), (off <= F.col("longest") * 2 + 1).alias("kept"))


def mix(
    documents: DataFrame,
    targets: DataFrame,
    schedule: Mapping[str, Sequence[tuple[float, float]]] | None = None,
    tokenizer: str = TOKENIZER,
    seed: int = 17,
) -> Mixture:
    """Training order and reached shares; `schedule` maps a source to knots (time, relative weight)."""
    spark = documents.sparkSession
    sizes = materialize(token_sizes(documents, tokenizer))
    total = sizes.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n")).first()[0]
    plan = (
        targets.where(F.col("source").isNotNull())
        .groupBy(F.lower(F.trim("source")).alias("source"))
        .agg(
            F.sum(F.greatest(F.coalesce(F.col("weight").cast("double"), F.lit(0.0)), F.lit(0.0))).alias("weight"),
            F.max(F.greatest(F.coalesce(F.col("max_repeats").cast("int"), F.lit(0)), F.lit(0))).alias("max_repeats"),
        )
    )
    names = [r.source for r in plan.select("source").limit(MOST_TARGETS + 1).collect()]
    if len(names) > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} target sources")
    by_source = sizes.groupBy("source").agg(F.sum("tokens").alias("size"))
    plan = (
        plan.join(by_source, "source", "left")
        .withColumn("size", F.coalesce("size", F.lit(0)))
        .withColumn("demand", F.col("weight") * F.lit(float(total)))
        .withColumn("reachable", F.col("size") * F.col("max_repeats"))
    )
    plan = materialize(plan)
    normal = {k.strip().lower(): v for k, v in (schedule or {}).items()}
    segments = spark.createDataFrame(
        _segments(normal, names), "source string, t0 double, t1 double, w0 double, w1 double, cum0 double, cum1 double"
    )
    # At most MOST_TARGETS rows: one per target.
    need = F.broadcast(plan.where("size > 0 AND demand > 0").select("source", "size", "demand", "reachable", "max_repeats"))
    listed = (
        sizes.join(need, "source")
        .where("tokens > 0")
        .withColumn("_turn", F.xxhash64("doc_id", F.lit(seed)))
        .select("source", "doc_id", "tokens", "size", "demand", "reachable", "max_repeats", "_turn")
    )
    cumulated = running_total(listed, ["source"], ["_turn", "doc_id"], "tokens", "_upto")
    goal = F.least(F.col("demand"), F.col("reachable").cast("double"))
    passes = F.least(F.col("max_repeats"), F.ceil(goal / F.col("size")).cast("int"))
    copies = (
        cumulated.where(passes > 0)
        .withColumn("repeat", F.explode(F.sequence(F.lit(0), passes - 1)))
        .withColumn("_start", F.col("repeat") * F.col("size") + F.col("_upto") - F.col("tokens"))
        .where(F.col("_start") < goal)
        .withColumn("_share", F.col("_start") / goal)
    )
    # Invert the integral of a linear piece: the area left of t is w0 s + (w1 - w0) s^2 / (2 d) with s = t - t0, d = t1 - t0.
    area, d = F.col("_share") - F.col("cum0"), F.col("t1") - F.col("t0")
    slope = (F.col("w1") - F.col("w0")) / d
    root = F.sqrt(F.greatest(F.col("w0") * F.col("w0") + slope * area * 2, F.lit(0.0)))
    placed = copies.join(F.broadcast(segments), ["source"]).where("_share >= cum0 AND _share < cum1")
    order = placed.select(
        (F.col("t0") + F.when(F.col("w0") + root > 0, area * 2 / (F.col("w0") + root)).otherwise(0.0)).alias("position"),
        "source",
        "doc_id",
        "repeat",
        "tokens",
    )
    placed = materialize(order)
    order = placed.orderBy("position", "source", "doc_id", "repeat")  # a range partitioning by position, then sorted slices
    used = placed.groupBy("source").agg(F.sum("tokens").alias("used"))
    everything = used.agg(F.sum("used")).first()[0] or 0
    report = (
        plan.join(used, "source", "left")
        .withColumn("used", F.coalesce("used", F.lit(0)))
        .withColumn("short", F.col("used") < F.col("demand"))
        .withColumn("actual_share", F.col("used") / F.lit(float(everything or 1)))
        .select("source", "weight", "max_repeats", "size", "demand", "reachable", "short", "used", "actual_share")
    )
    return Mixture(order, report)
