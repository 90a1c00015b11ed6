"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint is cut into BLOCKS blocks. Two fingerprints at most `distance` bits apart agree on at least
BLOCKS - distance of them, so each is listed once for every such choice of blocks; those that share a key are compared
in full. Copies share a fingerprint and enter once. A bucket gives only a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole_text, written
from .components import components

#: Six blocks for four bits: any close pair agrees on two, of 21 or 22 bits together.
BLOCKS = 6
SEED = 42


def shingle_hashes(text: str, shingle: int = 4) -> np.ndarray:
    """XXH64 (seed 42) of a text's word shingles, repeats included: A-Z lower-cased, words joined by a space. A shorter
    text is one shingle, one without words has none."""
    words = text.encode().lower().split()  # ASCII white space and lower case only
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())], np.uint64)


def majority(h: np.ndarray) -> int:
    """The fingerprint: the bits that are set in over half of the hashes; zero without hashes."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 15):
        bits = np.unpackbits(h[i : i + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
    return int(sum(1 << i for i in np.nonzero(2 * ones > len(h))[0].tolist())) if len(h) else 0


def fingerprint(text: str, shingle: int = 4) -> int:
    return majority(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(_id, _fp) for every row; _fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], ["_id", "_fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("_id"), whole_text(text_col).alias("_text")).mapInArrow(run, f"_id {kind}, _fp long")


def block_ranges(blocks: int) -> list[tuple[int, int]]:
    """(low bit, width) of each block."""
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _keys(distance: int, blocks: int):
    """The block keys of _fp: the number of the choice of blocks, and the bits of the chosen ones."""
    out = []
    for n, chosen in enumerate(combinations(block_ranges(blocks), blocks - distance)):
        mask = sum(((1 << width) - 1) << low for low, width in chosen)
        mask = mask - (1 << 64) if mask >= 1 << 63 else mask
        out.append(F.struct(F.lit(n).alias("n"), F.col("_fp").bitwiseAND(F.lit(mask)).alias("bits")))
    return out


def forest(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among distinct fingerprints: each wave compares the fingerprints just
    reached, in blocks, with those not yet reached."""
    left, edges = fps.copy(), []
    while len(left):
        wave, left = left[:1], left[1:]
        while len(wave) and len(left):
            hit = np.full(len(left), -1, np.int64)
            for i in range(len(wave)):
                todo = hit < 0
                near = np.bitwise_count(left[todo] ^ wave[i]) <= distance
                at = np.nonzero(todo)[0][near]
                hit[at] = i
            new = hit >= 0
            edges += zip(left[new].tolist(), wave[hit[new]].tolist())
            wave, left = left[new], left[~new]
    return edges


def _bucket_links(distance: int):
    """From rows sorted by key: links of each bucket. Pairs of small buckets are compared together; a bucket is held as
    8 bytes per distinct fingerprint."""

    def solve(keys: np.ndarray, fps: np.ndarray):
        cut = np.nonzero((keys[1:] != keys[:-1]).any(1))[0] + 1
        bounds = np.concatenate([[0], cut, [len(fps)]])
        size = np.diff(bounds)
        a, b = [], []
        small = (size > 1) & (size <= 16)
        for d in range(1, 16):
            at = bounds[:-1][small & (size > d)]
            width = size[small & (size > d)] - d
            if len(at):
                i = np.repeat(at, width) + np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
                near = np.bitwise_count((fps[i] ^ fps[i + d]).view(np.uint64)) <= distance
                a += fps[i[near]].tolist()
                b += fps[i[near] + d].tolist()
        for g in np.nonzero(size > 16)[0]:
            for x, y in forest(fps[bounds[g] : bounds[g + 1]].view(np.uint64), distance):
                a.append(x - (1 << 64) if x >= 1 << 63 else x)
                b.append(y - (1 << 64) if y >= 1 << 63 else y)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps = np.zeros((0, 2), np.int64), np.zeros(0, np.int64)
        for batch in batches:
            keys = np.concatenate([keys, np.stack([batch.column(0).to_numpy().astype(np.int64), batch.column(1).to_numpy()], 1)])
            fps = np.concatenate([fps, batch.column(2).to_numpy()])
            if len(fps) and (open_ := np.nonzero((keys != keys[-1]).any(1))[0]).size:
                end = open_[-1] + 1
                yield solve(keys[:end], fps[:end])
                keys, fps = keys[end:], fps[end:]
        if len(fps):
            yield solve(keys, fps)

    return run


def fingerprint_links(fps: DataFrame, distance: int = 4, blocks: int = BLOCKS) -> DataFrame:
    """Links (a, b) that connect all fingerprints at most distance bits apart; fps: distinct _fp."""
    listed = fps.select("_fp", F.explode(F.array(*_keys(distance, blocks))).alias("k")).select("k.n", "k.bits", "_fp")
    return listed.repartition("n", "bits").sortWithinPartitions("n", "bits").mapInArrow(_bucket_links(distance), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, distance: int = 4, blocks: int = BLOCKS) -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id (least id of the rows linked to it).

    Null and empty texts have fingerprint zero and link like any other. Repeated rows share their fingerprint and so
    their component; a component whose ids are all null has a null id; other columns don't matter.
    """
    signed = written(fingerprints(docs, id_col, text_col, shingle), "simhash")
    each = written(signed.groupBy("_fp").agg(F.min("_id").alias("_least")), "simhash")
    roots = components(fingerprint_links(each.select("_fp"), distance, blocks))
    named = each.join(roots, each["_fp"] == roots["node"], "left").select("_fp", "_least", F.coalesce("root", "_fp").alias("_root"))
    named = written(named, "simhash")
    least = named.groupBy("_root").agg(F.min("_least").alias("component_id"))
    classes = named.join(least, "_root").select("_fp", "component_id")
    hexed = F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint")
    return signed.join(classes, "_fp").select(F.col("_id").alias(id_col), hexed, "component_id")
