"""Mixing sources to target weights by balanced sampling (the cube method).

Every source has a target number of words; a document of it should be taken
``target / source size`` times on average, at most ``most_times``. The whole
part of that rate is taken for sure. The fractional part is an inclusion
probability, and the vector of these is moved through the null space of the
balancing constraints (number of documents, number of words) until nearly all
are 0 or 1, so either total stays what it was. Deville and Tillé's flight
phase runs in its local form: three open units at a time, since two
constraints leave a null space of one dimension; a step closes one or more.

At scale the flight runs in levels. Units are dealt into buckets of about
``bucket_units`` (a source with a third of all rows gets a third of the
buckets); a bucket leaves at most two open units, and these make up the next
level, until a source has one bucket. That last level ends with the landing:
of the at most four ways to settle the last two units the one whose words come
nearest to the total is taken, and single units of the last level make up for
the rest. So the error of a source is mostly less than its shortest documents'
words.

Repeated rows (same doc_id, source and size) are summed up before they move:
of ``n`` such rows with fraction ``f``, ``floor(n f)`` are taken for sure and
the rest is one unit. Reruns agree: order and draws come from hashes.

Defined results: null text has size 0; a null source is a source of its own
and the last in order; a source of size 0 has target 0; an empty table gives
an empty result; extra columns are ignored. Targets are computed on the
driver from one row a source.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import random
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.shared import WORD, text_or_empty, written

#: The plan has a row a source; up to so many rows it is broadcast, beyond that it is shuffled.
MOST_BROADCAST = 100_000


def targets(sizes: Sequence[int], weights: Sequence[float], share: float = 1.5, most_times: float = 2.0) -> list[float]:
    """Each source's target: ``share`` of all sizes by weight, none above ``most_times`` its size, the excess shared anew."""
    out = [0.0] * len(sizes)
    rest, open_ = share * sum(sizes), [i for i, n in enumerate(sizes) if n > 0]
    while open_:
        unit = rest / sum(weights[i] for i in open_)
        above = [i for i in open_ if unit * weights[i] > most_times * sizes[i]]
        if not above:
            for i in open_:
                out[i] = unit * weights[i]
            break
        for i in above:
            out[i] = most_times * sizes[i]
            rest -= out[i]
        open_ = [i for i in open_ if i not in set(above)]
    return out


def flight(prob: list[float], size: list[int], draw: random.Random) -> list[float]:
    """Moves ``prob`` in place until at most two are strictly between 0 and 1."""
    tiny = 1e-9
    for i, p in enumerate(prob):
        prob[i] = 0.0 if p < tiny else 1.0 if p > 1 - tiny else p
    todo = iter([i for i, p in enumerate(prob) if 0 < p < 1])
    held: list[int] = []
    while True:
        while len(held) < 3 and (i := next(todo, None)) is not None:
            held.append(i)
        if len(held) < 3:
            return prob
        a, b, c = (size[i] for i in held)
        u = [c - b, a - c, b - a] if not a == b == c else [1, -1, 0]
        up = min((1 - prob[i]) / x if x > 0 else prob[i] / -x for i, x in zip(held, u, strict=True) if x)
        down = min(prob[i] / x if x > 0 else (1 - prob[i]) / -x for i, x in zip(held, u, strict=True) if x)
        step = up if draw.random() * (up + down) < down else -down
        for i, x in zip(held, u, strict=True):
            p = prob[i] + step * x
            prob[i] = 0.0 if p < tiny else 1.0 if p > 1 - tiny else p
        held = [i for i in held if 0 < prob[i] < 1]


def land(start: list[float], prob: list[float], size: list[int], draw: random.Random) -> list[float]:
    """Settles what a flight from ``start`` to ``prob`` left open.

    Of the few completions that with the nearest words is taken, then count,
    then by lot. What is still missing or too much is then made up for unit by
    unit: of those that were open at the start the one goes in or out that
    brings the words nearest to their total, as long as one does.
    """
    open_ = [i for i, p in enumerate(prob) if 0 < p < 1]
    words, count = sum(prob[i] * size[i] for i in open_), sum(prob[i] for i in open_)

    def off(taken: tuple[float, ...]) -> tuple[float, float, float]:
        return abs(sum(t * size[i] for t, i in zip(taken, open_, strict=True)) - words), abs(sum(taken) - count), draw.random()

    best = min(itertools.product((0.0, 1.0), repeat=len(open_)), key=off)
    for i, taken in zip(open_, best, strict=True):
        prob[i] = taken
    free = np.array([i for i, p in enumerate(start) if 0 < p < 1], np.int64)
    if len(free):
        now, sizes = np.array(prob)[free], np.array(size)[free]
        missing = words - sum(t * size[i] for t, i in zip(best, open_, strict=True))
        while True:
            left = np.abs(missing - np.where(now > 0, -sizes, sizes))
            k = int(left.argmin())
            if not left[k] < abs(missing):
                break
            missing -= -sizes[k] if now[k] else sizes[k]
            now[k] = 1 - now[k]
        for i, p in zip(free.tolist(), now.tolist(), strict=True):
            prob[i] = p
    return prob


def _level(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["draw", "doc_id", "size"], na_position="first", kind="stable").reset_index(drop=True)
    name = repr((pdf["src"].iloc[0], pdf["bucket"].iloc[0], len(pdf), int(pdf["draw"].iloc[0])))
    draw = random.Random(hashlib.sha256(name.encode()).digest())
    start, size = pdf["prob"].tolist(), pdf["size"].tolist()
    prob = flight(list(start), size, draw)
    if pdf["last"].iloc[0]:
        prob = land(start, prob, size, draw)
    return pdf.assign(prob=prob).drop(columns=["bucket", "last"])


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    share: float = 1.5,
    most_times: float = 2.0,
    bucket_units: int = 4096,
    seed: int = 0,
) -> DataFrame:
    """doc_id, source, size, source_size, target, times (how often the mix takes the row), taken (words)."""
    spark = docs.sparkSession
    sized = docs.select("doc_id", "source", F.regexp_count(text_or_empty("text"), F.lit(WORD)).cast("long").alias("size"))
    units = written(sized.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-units")
    rows = units.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("total"), F.count(F.lit(1)).alias("units"))
    found = sorted(rows.collect(), key=lambda r: (r["source"] is None, r["source"] or ""))
    goal = targets([r["total"] for r in found], [weights[i % len(weights)] for i in range(len(found))], share, most_times)
    plan = spark.createDataFrame(
        [
            (i, r["source"], r["total"], g, g / r["total"] if r["total"] else 0.0, r["units"])
            for i, (r, g) in enumerate(zip(found, goal, strict=True))
        ],
        "src int, src_name string, source_size long, target double, rate double, units long",
    )
    plan = F.broadcast(plan) if len(found) <= MOST_BROADCAST else plan
    planned = units.join(plan, units["source"].eqNullSafe(plan["src_name"])).select(
        "doc_id",
        "src",
        "size",
        "n",
        "rate",
        F.xxhash64("doc_id", "size", F.lit(seed)).alias("draw"),
    )
    fraction = (F.col("rate") - F.floor("rate")) * F.col("n")
    level = planned.withColumn("sure", F.floor(fraction)).withColumn("prob", fraction - F.floor(fraction)).drop("rate")
    schema = level.schema.simpleString()[len("struct<") : -1].replace(":", " ")
    left = {i: r["units"] for i, r in enumerate(found)}
    settled: list[DataFrame] = []
    while left:
        buckets = spark.createDataFrame(
            [(i, max(1, math.ceil(n / bucket_units))) for i, n in left.items()], "at int, buckets long"
        )
        buckets = F.broadcast(buckets) if len(left) <= MOST_BROADCAST else buckets
        dealt = (
            level.join(buckets, F.col("src") == F.col("at"))
            .withColumn("bucket", F.pmod(F.xxhash64("draw", F.lit(len(settled))), F.col("buckets")))
            .withColumn("last", F.col("buckets") == 1)
            .drop("at", "buckets")
        )
        done = written(dealt.groupBy("src", "bucket").applyInPandas(_level, schema), "mix-level")
        is_open = (F.col("prob") > 0) & (F.col("prob") < 1)
        settled.append(done.where(~is_open))
        level = done.where(is_open)
        left = {r["src"]: r["count"] for r in level.groupBy("src").count().collect()}
    if not settled:
        settled.append(level)
    whole = settled[0]
    for more in settled[1:]:
        whole = whole.unionByName(more)
    out = whole.join(plan, "src").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    times = F.floor("rate") + (F.col("copy") <= F.col("sure") + F.col("prob")).cast("long")
    return out.select(
        "doc_id",
        F.col("src_name").alias("source"),
        "size",
        "source_size",
        "target",
        times.alias("times"),
        (times * F.col("size")).alias("taken"),
    )
