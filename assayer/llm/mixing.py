"""Mixing sources to target weights by the cube method.

A source with target t and size s takes every document t / s times on average: floor(t / s) copies each, and one more
with inclusion probability frac(t / s). The flight phase moves those probabilities through the null space of two
balancing constraints, words and documents, until each is 0 or 1 but for a few units per block. Blocks of
bounded size fly first, what they leave flies again in blocks of blocks, until a source has few blocks. Each flight spares a few
units, so that the landing has some to choose among: it takes those whose words come nearest the total.
"""

from __future__ import annotations

import random
import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import n_words, written

#: Units that fly together, blocks whose leftovers fly together, and units that a flight spares (a block leaves two more at most).
BLOCK, FAN_IN, SPARE = 512, 128, 12
EPS = 1e-9


def source_targets(sized: DataFrame, weights=(5.0, 2.0, 1.0), most: float = 3.0) -> DataFrame:
    """source, source_size, source_docs, target of each source of sized (source, size).

    Weights repeat over the sources by code point, null last. Water filling: with sources by most * size / weight, the
    level is the largest share-per-weight left once the sources before are held at most * size. Windows here range
    over one row per source.
    """
    totals = sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"), F.count(F.lit(1)).alias("source_docs"))
    by_name = W.orderBy(F.col("source").isNull(), F.col("source"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    t = totals.withColumn("_w", weight).withColumn("_cap", most * F.col("source_size")).withColumn("_r", F.col("_cap") / F.col("_w"))
    order = W.orderBy("_r", F.col("source").isNull(), "source")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    onward = order.rowsBetween(0, W.unboundedFollowing)
    whole = W.partitionBy(F.lit(0))
    t = t.withColumn("_level", (F.sum("source_size").over(whole) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(onward))
    level = F.max("_level").over(whole)
    return t.select("source", "source_size", "source_docs", F.least("_cap", level * F.col("_w")).alias("target"))


def fly(sizes: list[float], p: list[float], seed: int) -> list[float]:
    """Flight phase: p moved so that sum(p) and sum(size * p) stay, and at most SPARE + 2 entries are not 0 or 1."""
    rng = random.Random(seed)
    p = list(p)
    waiting = iter([i for i, x in enumerate(p) if EPS < x < 1 - EPS][:-SPARE])
    active: list[int] = []
    while True:
        while len(active) < 3 and (nxt := next(waiting, None)) is not None:
            active.append(nxt)
        if len(active) < 3:
            break
        x, y, z = (sizes[i] for i in active)
        u = (y - z, z - x, x - y)
        if x == y == z:
            u = (1.0, -1.0, 0.0)
        up = min((1 - p[i]) / d if d > 0 else -p[i] / d for i, d in zip(active, u) if d)
        down = min(p[i] / d if d > 0 else (p[i] - 1) / d for i, d in zip(active, u) if d)
        step = up if rng.random() * (up + down) < down else -down
        for i, d in zip(active, u):
            p[i] += step * d
            if p[i] <= EPS:
                p[i] = 0.0
            elif p[i] >= 1 - EPS:
                p[i] = 1.0
        active = [i for i in active if 0 < p[i] < 1]
    return p


def land(sizes: list[float], p: list[float]) -> list[float]:
    """The few open units set to 0 or 1 so that words, then documents, are nearest their totals; all choices are tried."""
    open_ = [i for i, x in enumerate(p) if 0 < x < 1]
    words, docs = np.zeros(1), np.zeros(1)
    for i in open_:
        words = np.concatenate([words - sizes[i] * p[i], words + sizes[i] * (1 - p[i])])
        docs = np.concatenate([docs - p[i], docs + 1 - p[i]])
    best = int(np.lexsort((np.abs(docs), np.round(np.abs(words), 6)))[0])
    for k, i in enumerate(open_):
        p[i] = float(best >> k & 1)
    return p


def _flight(landing: bool):
    def run(key, table):
        table = table.take(pc.sort_indices(table, [("_tie", "ascending"), ("size", "ascending")]))
        sizes = [float(x) for x in table.column("size").to_pylist()]
        seed = zlib.crc32(repr([k.as_py() for k in key]).encode())
        p = fly(sizes, table.column("_p").to_pylist(), seed)
        p = land(sizes, p) if landing else p
        return table.set_column(table.schema.get_field_index("_p"), "_p", pa.array(p, pa.float64()))

    return run


def balanced_copies(units: DataFrame) -> DataFrame:
    """units (source, size, source_docs, _p, _tie and others) with _p moved to 0 or 1, balanced within each source."""
    schema = units.schema
    blocks = F.ceil(F.col("source_docs") / BLOCK)
    block = F.pmod(F.xxhash64("_tie", "size"), blocks)
    at = units.withColumn("_block", block)
    is_open = (F.col("_p") > 0) & (F.col("_p") < 1)
    fixed = []
    while True:
        at = written(at.groupBy("source", "_block").applyInArrow(_flight(False), at.schema), "cube")
        fixed.append(at.where(~is_open))
        at = at.where(is_open)
        # blocks of blocks, until those of a source are few enough to land together
        if (at.agg(F.max("_block")).first()[0] or 0) < FAN_IN:
            break
        at = at.withColumn("_block", F.floor(F.col("_block") / FAN_IN))
    last = at.groupBy("source").applyInArrow(_flight(True), at.schema)
    return reduce(DataFrame.unionByName, [*fixed, last]).select(*schema.names)


def mix(docs: DataFrame, weights=(5.0, 2.0, 1.0), most: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep_row: bool = False) -> DataFrame:
    """One row per input row: id, size (words), source_size, target, taken (words the mix takes, repeats counted),
    copies (times the row is taken, at most `most`), and with keep_row the whole input row as the struct _row.

    Null texts have size 0; a null source is a source of its own, last in order; repeated rows are units of their own,
    of which equal ones may get different copies; an empty table gives no rows. Sources without words get target 0.
    Draws depend on ids and sizes alone, so reruns agree.
    """
    sized = docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")] if keep_row else []))
    sized = sized if keep_row else written(sized, "sized")
    targets = source_targets(sized, weights, most)
    units = sized.join(targets.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    ratio = F.when(F.col("source_size") > 0, F.least(F.lit(float(most)), F.col("target") / F.col("source_size"))).otherwise(F.lit(0.0))
    whole = F.floor(ratio + EPS)
    units = units.withColumn("_whole", whole).withColumn("_p", F.when(ratio - whole < EPS, F.lit(0.0)).otherwise(ratio - whole)).withColumn("_tie", F.col("_id").cast("string"))
    drawn = balanced_copies(units).withColumn("copies", F.col("_whole") + F.col("_p").cast("long"))
    return drawn.select(F.col("_id").alias(id_col), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", *(["_row"] if keep_row else []))
