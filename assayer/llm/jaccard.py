"""The near-duplicate stage: SimHash links, checked by exact Jaccard similarity, and what fingerprints cannot reach.

The first candidates are the links of the SimHash operator (fingerprints of the same shingles, pigeonhole blocks). Of texts
of 0.8 similarity, fingerprints differ in ten of 64 bits on average, far more than blocks can look up, so an exact
set join gives the rest: with all shingles in one order, two sets of at least 4/5 similarity share one of the first
n - ceil(4n/5) + 1 of each, so only these are listed and no pair is missed. Shingles that are common in a bounded sample come
last in the order, which keeps the lists short; the order changes the work, never the result. Candidates that sizes,
positions and a few parities cannot rule out meet by sketches first, which grow with the sets and bound their difference
from below, so no similar pair is lost; the pairs left are held against each other whole. Each list is linked
to one of its members first, a long one to the most central members of its groups, two links a member at most; the last round
compares what is still in different components, in long lists by finer sketches within the list's task, so a large group of near
copies gives no square of pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, whole_text, written
from .components import components
from .simhash import SEED, fingerprint_links, majority, shingle_hashes

#: Rows whose shingles are counted to find common ones, and in how many of them a common one is.
SAMPLE, COMMON = 16384, 3
#: Lists of more members are long: they are linked by groups, and finer sketches are held against each other before pairs are made.
LONG = 32
#: Bits a shingle, at least, of sketches and of those for long lists.
COARSE, FINE = 2, 8
#: Components are found so often: after the SimHash links, and after each round that links lists to one member.
ROUNDS = 2


#: Columns of a set's parities.
BITS = ("_p0", "_p1", "_p2", "_p3")


def shingle_set(text: str, shingle: int = 5) -> np.ndarray:
    """Ascending distinct hashes of a text's word shingles."""
    return np.unique(shingle_hashes(text, shingle))


def parity(h: np.ndarray) -> tuple[int, ...]:
    """256 bits as four longs, each bit whether an odd number of a set's hashes fall to it: two sets differ in as many members at least as
    their bits."""
    bits = np.bincount((h >> np.uint64(56)).astype(np.int64), minlength=256) & 1
    return tuple(np.packbits(bits.astype(np.uint8)).view(np.int64).tolist())


def sketch(h: np.ndarray, per: int = COARSE) -> bytes:
    """Parities of a set by the low bits of its hashes: a power of two of bits, over per times the set's size. Two sets differ in as many
    members at least as their sketches, folded to one length, differ in bits."""
    m = 1 << max(8, (per * len(h)).bit_length())
    bits = np.bincount((h & np.uint64(m - 1)).astype(np.int64), minlength=m) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").tobytes()


def sketches_apart(x: bytes, y: bytes) -> int:
    """Bits in which two sketches differ once the longer one is folded to the length of the other."""
    x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum(dtype=np.int64))


def similar(both, a, b):
    """both / (a + b - both) >= 4/5, in integers."""
    return 9 * both >= 4 * (a + b)


def _common(rows: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles common in a sample, ascending, and their counts there."""
    total = rows.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, shingle) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64))], ["h"])

    taken = rows.where(F.pmod("_k1", F.lit(1 << 20)) < F.lit(-(-(SAMPLE << 20) // max(1, total))))
    found = written(taken.select("_text").mapInArrow(run, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= COMMON), "common").collect()
    h = np.array([r["h"] for r in found], np.int64).view(np.uint64)
    by = np.argsort(h)
    return h[by], np.array([r["n"] for r in found], np.int64)[by]


def _prefixes(shingle: int, common: np.ndarray, counts: np.ndarray):
    """Replaces the last column, the text, by the set's hash, its size, the fingerprint, parities, sketches and the first shingles in the order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, fps, marks, sketches, fine, first = [], [], [], [], [], [], []
            for text in batch.column(batch.num_columns - 1).to_pylist():
                h = shingle_hashes(text, shingle)
                fps.append(majority(h))
                h = np.unique(h)
                ids.append(xxhash.xxh64_intdigest(h.tobytes(), SEED))
                sizes.append(len(h))
                marks.append(parity(h))
                sketches.append(sketch(h))
                fine.append(sketch(h, FINE))
                p = len(h) - (4 * len(h) + 4) // 5 + 1 if len(h) else 0
                if len(common):
                    at = np.minimum(np.searchsorted(common, h), len(common) - 1)
                    h = h[np.argsort(np.where(common[at] == h, counts[at], 0), kind="stable")]
                first.append(h[:p].view(np.int64))
            arrays = [*batch.columns[:-1], pa.array(np.array(ids, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.array(np.array(fps, np.uint64).view(np.int64)), *[pa.array([m[k] for m in marks], pa.int64()) for k in range(4)], pa.array(sketches, pa.binary()), pa.array(fine, pa.binary()), pa.array(first, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names[:-1], "_s", "_n", "_fp", *BITS, "_sketch", "_fine", "_first"])

    return run


def _bucket_pairs(how: str):
    """From rows (_h, _n, _at, _s, _root, the parities and perhaps _fine) sorted by _h and _n: pairs that sizes, positions, parities and
    fine sketches allow. "star" and a number: those with one member of the bucket, in long ones those of a forest; "rest": those of
    different roots."""

    def solve(n: np.ndarray, at: np.ndarray, s: np.ndarray, root: np.ndarray, bits: np.ndarray, fine: np.ndarray | None):
        a, b = [], []
        rest = n - at - 1
        last = np.searchsorted(n, 5 * n // 4, "right")  # sizes ascend

        def fits(i: int, lo: int, hi: int):
            near = lo + np.nonzero(similar(1 + np.minimum(rest[i], rest[lo:hi]), n[i], n[lo:hi]) & (5 * np.minimum(n[i], n[lo:hi]) >= 4 * np.maximum(n[i], n[lo:hi])))[0]
            # similar sets of a and b members differ in (a + b) / 9 at most
            apart = np.bitwise_count((bits[near] ^ bits[i]).view(np.uint64)).sum(1, dtype=np.int64)
            return near[9 * apart <= n[i] + n[near]]

        def forest(order: np.ndarray):
            # who is not reached yet names the most central of those near it, which reaches all near that one; what has also come near
            # a member reached before is linked to the nearest such, so a member is in two links at most besides those of a centre
            first = np.searchsorted(n, (4 * n + 4) // 5)
            reached = np.zeros(len(n), bool)
            for i in order:
                if reached[i]:
                    continue
                near = fits(i, first[i], last[i])
                old, new = near[reached[near]], near[~reached[near]]
                links = []
                if len(old):
                    links.append((i, old[[np.bitwise_count((bits[old] ^ bits[i]).view(np.uint64)).sum(1, dtype=np.int64).argmin()]]))
                if len(new):
                    each = np.unpackbits(bits[new].view(np.uint8), axis=1)
                    centre = new[(each ^ (2 * each.sum(0, dtype=np.int64) > len(new))).sum(1).argmin()]
                    hit = fits(centre, first[centre], last[centre])
                    hit = hit[~reached[hit]]
                    links.append((centre, hit))
                    reached[hit] = reached[centre] = True
                reached[i] = True
                for x, to in links:
                    to = to[root[to] != root[x]]
                    a.append(np.full(len(to), s[x]))
                    b.append(s[to])
            return np.concatenate(a or [s[:0]]), np.concatenate(b or [s[:0]])

        if how.startswith("star"):
            # the least of the round's order: lists of much the same sets choose the same one, so that their pairs fall together
            by = (s ^ np.int64(int(how[4:]) * 0x1E3779B97F4A7C15 & (1 << 63) - 1)) * np.int64(0x2545F4914F6CDD1D)
            if len(n) > LONG:
                return forest(np.argsort(by, kind="stable"))
            i = int(np.argmin(by))
            hit = fits(i, 0, len(n))
            hit = hit[(hit != i) & (root[hit] != root[i])]
            return np.full(len(hit), s[i]), s[hit]
        for i in range(len(n) - 1):
            hit = fits(i, i + 1, last[i])
            hit = hit[root[hit] != root[i]]
            if fine is not None:
                hit = hit[[_may_be_similar(n[i], fine[i], n[j], fine[j]) for j in hit]] if len(hit) else hit
            if len(hit):
                a.append(np.full(len(hit), s[i]))
                b.append(s[hit])
        if not a:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(a), np.concatenate(b)

    def buckets(h, n, at, s, root, *more):
        bits, fine = np.stack(more[: len(BITS)], 1), more[len(BITS) :]
        bounds = np.concatenate([[0], np.nonzero(h[1:] != h[:-1])[0] + 1, [len(h)]])
        out = [solve(n[x:y], at[x:y], s[x:y], root[x:y], bits[x:y], fine[0][x:y] if fine else None) for x, y in zip(bounds, bounds[1:]) if y > x + 1]
        a, b = (np.concatenate([np.zeros(0, np.int64), *p]) for p in zip(*out)) if out else (np.zeros(0, np.int64),) * 2
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            new = [np.array(c.to_pylist(), object) if pa.types.is_binary(c.type) else c.to_numpy().astype(np.int64) for c in batch.columns]
            held = [np.concatenate(x) for x in zip(held, new)] if held else new
            open_ = np.nonzero(held[0] != held[0][-1])[0] if len(held[0]) else np.zeros(0, int)
            if open_.size:
                end = open_[-1] + 1
                yield buckets(*[x[:end] for x in held])
                held = [x[end:] for x in held]
        if held and len(held[0]):
            yield buckets(*held)

    return run


def _pairs(listed: DataFrame, how: str) -> DataFrame:
    dealt = listed.repartition("_h").sortWithinPartitions("_h", "_n", "_s").select("_h", "_n", "_at", "_s", "_root", *BITS, *[c for c in listed.columns if c == "_fine"])
    return dealt.mapInArrow(_bucket_pairs(how), "a long, b long").distinct()


def _simhash_pairs(each: DataFrame) -> DataFrame:
    """Pairs of sets of one fingerprint, each with the least of them, and of linked fingerprints, the least of either."""
    least = written(each.groupBy("_fp").agg(F.min("_s").alias("_least")), "simhash")
    links = fingerprint_links(least.select("_fp"))
    alike = each.join(least, "_fp").where("_s <> _least").select(F.col("_least").alias("a"), F.col("_s").alias("b"))
    linked = links.toDF("x", "y").join(least.toDF("x", "a"), "x").join(least.toDF("y", "b"), "y").select("a", "b")
    return alike.unionByName(linked)


def _meet(pairs: DataFrame, of: DataFrame, passes) -> DataFrame:
    """The pairs (a, b) that pass by what of, a table by _s, holds of a and then of b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [passes(*row) for row in zip(*[batch.column(i).to_pylist() for i in range(2, batch.num_columns)])]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok, pa.bool_())) for c in batch.columns[:2]], ["a", "b"])

    values = [c for c in of.columns if c != "_s"]
    side = lambda k: of.select(F.col("_s").alias(k), *[F.col(c).alias(f"{k}{c}") for c in values])
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.select("a", "b", *[f"{k}{c}" for k in "ab" for c in values]).mapInArrow(run, "a long, b long")


def _may_be_similar(n: int, x: bytes, m: int, y: bytes) -> bool:
    # similar sets of n and m members differ in (n + m) / 9 at most
    return 9 * sketches_apart(x, y) <= n + m


def _are_similar(x: bytes, y: bytes) -> bool:
    p, q = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
    return bool(similar(len(np.intersect1d(p, q, assume_unique=True)), len(p), len(q)))


def _similar_pairs(pairs: DataFrame, each: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar, written: sketches first, then the sets of the pairs left, hashed
    again from their texts."""
    left = written(_meet(pairs.distinct(), each.select("_s", "_n", "_sketch"), _may_be_similar), "pairs")
    members = left.select(F.col("a").alias("_s")).unionByName(left.select(F.col("b").alias("_s"))).distinct()
    wanted = written(each.select("_k1", "_k2", "_s").join(members, "_s"), "shingles")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_set(t, shingle).astype("<u8").tobytes() for t in batch.column(1).to_pylist()], pa.binary())], ["_s", "_set"])

    sets = texts.select("_k1", "_k2", "_text").join(wanted, ["_k1", "_k2"]).dropDuplicates(["_s"]).select("_s", "_text").mapInArrow(hashed, "_s long, _set binary")
    sets = written(sets, "shingles")
    out = written(_meet(left, sets, _are_similar), "pairs")
    discard(left, wanted, sets)
    return out


def one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """One row of each group of rows linked by shingle sets of a Jaccard similarity of 4/5 or more.

    It is the row of the least id, null ids last, then of the least text digest; rows alike in all columns count as one.
    Null texts and texts without words form one group. Shingles and sets are told apart by 64-bit hashes.
    """
    columns = docs.columns
    keys = {k: F.xxhash64(F.lit(n), F.col(id_col).isNull(), *[F.col(f"`{c}`") for c in columns]) for n, k in enumerate(("_k1", "_k2"))}
    # the row in a struct, so that no column's name can clash
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"), *[k.alias(n) for n, k in keys.items()])
    texts = docs.select(*[k.alias(n) for n, k in keys.items()], F.col(id_col).isNull().alias("_null"), F.col(id_col).alias("_id"), F.md5(whole_text(text_col)).alias("_md5"), whole_text(text_col).alias("_text"))
    kind = docs.schema[id_col].dataType.simpleString()
    marks = ("_n", "_fp", *BITS, "_sketch", "_fine")
    first = texts.select("_null", "_id", "_md5", "_k1", "_k2", "_text").mapInArrow(
        _prefixes(shingle, *_common(texts, shingle)),
        f"_null boolean, _id {kind}, _md5 string, _k1 long, _k2 long, _s long, _n int, _fp long, _p0 long, _p1 long, _p2 long, _p3 long, _sketch binary, _fine binary, _first array<bigint>",
    )
    order = ("_null", "_id", "_md5", "_k1", "_k2")
    each = written(first.groupBy("_s").agg(F.min(F.struct(*order, *marks, "_first")).alias("w")).select("_s", "w.*"), "shingles")
    # shingles of one set alone go before anything wide is joined
    of = F.count(F.lit(1)).over(W.partitionBy("_h"))
    shared = each.select("_s", F.posexplode("_first").alias("_at", "_h")).select("_h", "_s", "_at", of.alias("_of")).where("_of > 1")
    listed = written(shared.join(each.select("_s", "_n", *BITS), "_s").select("_h", (F.col("_of") > LONG).alias("_long"), "_n", "_at", "_s", *BITS), "shingles")
    near = _similar_pairs(_simhash_pairs(each), each, texts, shingle)
    for at in range(ROUNDS):
        roots = written(components(near), "shingles")
        rooted = listed.join(roots.select(F.col("node").alias("_s"), F.col("root").alias("_root")), "_s", "left").withColumn("_root", F.coalesce("_root", "_s"))
        if at < ROUNDS - 1:
            found = _similar_pairs(_pairs(rooted, f"star{at}"), each, texts, shingle)
            more = written(near.unionByName(found), "shingles")
            discard(near, roots, found)
            near = more
    long = rooted.where("_long").join(each.select("_s", "_fine"), "_s")
    rest = _similar_pairs(_pairs(rooted.where("not _long"), "rest").unionByName(_pairs(long, "rest")), each, texts, shingle)
    # the largest tables go as soon as nothing reads them
    discard(listed, roots)
    roots = written(components(near.unionByName(rest)), "shingles")
    named = each.drop("_first", "_sketch", "_fine").join(roots, each["_s"] == roots["node"], "left").withColumn("_root", F.coalesce("root", "_s"))
    kept = written(named.groupBy("_root").agg(F.min(F.struct(*order)).alias("w")).select("w._k1", "w._k2"), "shingles")
    discard(each, near, rest, roots)
    alike = F.row_number().over(W.partitionBy("_k1", "_k2").orderBy(F.lit(0)))
    return rows.join(kept, ["_k1", "_k2"]).withColumn("_r", alike).where("_r = 1").select("_row.*")
