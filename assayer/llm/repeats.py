"""Repeats of a least length over all texts: what the suffix-array and the suffix-tree operators share.

1. Every text gives anchors: of each window of `least` symbols the short gram with the least hash, the rightmost if tied.
   Equal windows pick the same gram at the same place, so suffixes meet in the group of their anchor's gram.
2. Grams of two or more places go on. The context of a place is as much as any window of its anchor reaches. Equal contexts
   are one row from here on, with map-side sums, so that thousands of copies of a passage weigh as much as one.
3. A group's suffixes share a prefix, the gram. While a group holds more than PART different contexts, the shared part grows
   (split_groups): half of the windows each, dealt by what all windows of that half have in common, down to one window.
   The number of contexts alone decides; every part then fits in memory and is solved on its own.
4. Parts are solved many at a time, as one sorted array of suffixes (solve). Repeats return to their places and texts.

Exact copies are one text throughout, known by 128 bits of SHA-256; they repeat wholly. Contexts are told apart by
128-bit BLAKE2 digests; repeats themselves are found by comparing symbols.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, text_key, whole_text, written


@dataclass(frozen=True)
class Alphabet:
    """How texts become symbols. units: a text's symbols as something to slice; values: a number for each unit, equal for
    equal ones; cut: units as bytes; coded: the symbols of many cuts as numbers, exactly, and how many each has."""

    least: int
    gram: int
    units: Callable[[bytes], object]
    values: Callable[[object], np.ndarray]
    cut: Callable[[object], bytes]
    coded: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]

    @property
    def room(self) -> int:
        """How far before its anchor a window may begin."""
        return self.least - self.gram


#: Different contexts in a part, bytes of keys sorted at once, and digests that a task remembers.
PART, PIECE, REMEMBERED = 4096, 16 << 20, 1 << 16


def gram_hashes(x: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of every run of `gram` symbols, by doubling."""
    x = (x.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    base, done, out, power, size = 0xBF58476D1CE4E5B9, 0, None, x, 1
    while True:
        if gram & size:
            n = len(x) - done - size + 1
            out = power[done : done + n] if out is None else out[:n] * np.uint64(pow(base, size, 1 << 64)) + power[done : done + n]
            done += size
        size *= 2
        if size > gram:
            break
        half = size // 2
        power = power[:-half] * np.uint64(pow(base, half, 1 << 64)) + power[half:]
    out = out ^ (out >> np.uint64(31))
    return out * np.uint64(0x94D049BB133111EB)


def anchors(x: np.ndarray, a: Alphabet) -> tuple[np.ndarray, np.ndarray]:
    """Places of the anchors of a text's symbol values, and their hashes; none in texts shorter than a window."""
    if len(x) < a.least:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = gram_hashes(x, a.gram)
    low = np.uint64(0xFFFFFFFF)
    m = (h & ~low) | (low - np.arange(len(h), dtype=np.uint64))
    size = 1
    while size <= a.room:
        step = min(size, a.room + 1 - size)
        m = np.minimum(m[: len(m) - step], m[step:])
        size += step
    at = np.unique((low - (m & low)).astype(np.int64))
    return at, h[at].view(np.int64)


def _list_anchors(a: Alphabet):
    def run(batches):
        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1)):
                at, h = anchors(a.values(a.units(text.as_py().encode())), a)
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([h], pa.list_(pa.int64())), pa.array([at.astype(np.int32)], pa.list_(pa.int32()))], ["key", "h", "pos"])

    return run


PLACES = "c binary, h long, back int, size int, key binary, pos int, context binary"


def _list_contexts(a: Alphabet):
    """A row for each wanted place; the context itself only where the task hasn't given it lately."""

    def run(batches):
        seen: set[bytes] = set()
        for batch in batches:
            for key, text, at in zip(batch.column(0), batch.column(1), batch.column(2).to_pylist()):
                units = a.units(text.as_py().encode())
                at = sorted((x["pos"], x["h"]) for x in at)
                marks, backs, sizes, shown = [], [], [], []
                for p, _ in at:
                    back = min(p, a.room)
                    part = units[p - back : p + a.least]
                    cut = a.cut(part)
                    c = blake2b(cut, digest_size=16, salt=back.to_bytes(4, "little")).digest()
                    marks.append(c)
                    backs.append(back)
                    sizes.append(len(part))
                    shown.append(None if c in seen else cut)
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen.add(c)
                pos, h = zip(*at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(marks, pa.binary()), pa.array(h, pa.int64()), pa.array(backs, pa.int32()), pa.array(sizes, pa.int32()), pa.repeat(key, len(at)), pa.array(pos, pa.int32()), pa.array(shown, pa.binary())],
                    ["c", "h", "back", "size", "key", "pos", "context"],
                )

    return run


@dataclass(frozen=True)
class Found:
    """texts: (key, rep, n) of each different text; places: (c, key, pos) of each listed anchor; contexts: (h, c, back, size,
    context, many) of each different context, many if it stands at two places or more."""

    texts: DataFrame
    places: DataFrame
    contexts: DataFrame


def list_contexts(docs: DataFrame, a: Alphabet, id_col: str, text_col: str) -> Found:
    """The contexts of all anchors whose gram occurs twice or more."""
    rows = docs.select(F.col(id_col).cast("string").alias("id"), text_key(whole_text(text_col)).alias("key"), whole_text(text_col).alias("text"))
    # one list of anchors for all copies of a text
    lists = rows.select("key", "text").mapInArrow(_list_anchors(a), "key binary, h array<long>, pos array<int>").dropDuplicates(["key"])
    listed = written(lists.select("key", F.inline(F.arrays_zip("h", "pos"))), "anchors")
    # written, so that the join below has plain exchanges on both sides and a hot hash can be split
    shared = written(listed.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"), "shared")
    wanted = listed.join(shared, "h").groupBy("key").agg(F.collect_list(F.struct("pos", "h")).alias("at"))
    texts = written(rows.groupBy("key").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")), "texts")
    asked = written(wanted.join(texts, "key").select(F.col("key").alias("k"), "rep", "at"), "asked")
    discard(listed, shared)
    chosen = rows.join(asked, (F.col("key") == F.col("k")) & F.col("id").eqNullSafe(F.col("rep"))).select("key", "text", "at")
    places = written(chosen.mapInArrow(_list_contexts(a), PLACES), "places")
    discard(asked)
    # rows repeated with one id list a place twice, so places are told apart, not counted
    spot = F.xxhash64("key", "pos")
    contexts = places.groupBy("h", "c").agg(F.first("back").alias("back"), F.first("size").alias("size"), F.max("context").alias("context"), (F.min(spot) != F.max(spot)).alias("many"))
    return Found(texts, places.select("c", "key", "pos"), written(contexts, "contexts"))


NODES = "g long, up long, c binary, back int, size int, context binary, lo int, hi int, many boolean"


def _halve(a: Alphabet):
    """From a row of a part, whose windows begin lo..hi symbols before the anchor, a row for each half of them: g tells what
    all windows of the half share, the context is what they reach. Rows too short for that have none of the windows."""

    def run(batches):
        for batch in batches:
            out = []
            for g, c, back, size, context, lo, hi, many in zip(*[x.to_pylist() for x in batch.columns]):
                units = a.units(context)
                middle = (lo + hi) // 2
                for first, last in ((lo, middle), (middle + 1, hi)):
                    core = (back - first, back - last + a.least)
                    low, high = max(0, back - last), min(size, back - first + a.least)
                    if core[0] < 0 or core[1] > size or high - low < a.least:
                        continue
                    key = xxhash.xxh64_intdigest(a.cut(units[core[0] : core[1]]), (g ^ (first << 16 | last)) & (2**63 - 1))
                    out.append((key - 2**63, g, c, back - low, high - low, a.cut(units[low:high]), first, last, many))
            columns = list(zip(*out)) or [()] * 9
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.int32(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds)], ["g", "up", "c", "back", "size", "context", "lo", "hi", "many"])

    return run


def split_groups(contexts: DataFrame, a: Alphabet) -> tuple[DataFrame, list[DataFrame]]:
    """Parts of at most PART different contexts as (g, c, back, size, context, many: whether it stands at several places), and for each round of splitting its links (g, rep,
    n, up, c, low, high): context c of part up goes on in part g as rep, as it shares the stretch low..high with
    it. A stretch of n > 1 contexts repeats, and only one of them, rep, stays.

    Each round halves the windows of the parts that are still too large, so there are log2(least) rounds at most.
    """

    def large(rows: DataFrame) -> DataFrame:
        return written(rows.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > PART).select("g"), "large")

    rows = contexts.withColumnRenamed("h", "g").select("g", "c", "back", "size", "context", F.lit(0).alias("lo"), F.lit(a.room).alias("hi"), "many")
    parts, rounds = [], []
    while not (over := large(rows)).isEmpty():
        parts.append(rows.join(over, "g", "left_anti"))
        halves = written(rows.join(over, "g").select("g", "c", "back", "size", "context", "lo", "hi", "many").mapInArrow(_halve(a), NODES), "halves")
        kinds = written(halves.groupBy("g", "back", "context").agg(F.min("c").alias("rep"), F.first("size").alias("size"), F.first("lo").alias("lo"), F.first("hi").alias("hi"), F.max("many").alias("many"), F.count(F.lit(1)).alias("n")), "kinds")
        links = halves.join(kinds.select("g", "back", "context", "rep", "n"), ["g", "back", "context"])
        rounds.append(links.select("g", "rep", "n", "up", "c", (-F.col("back")).alias("low"), (F.col("size") - F.col("back")).alias("high")))
        rows = kinds.select("g", F.col("rep").alias("c"), "back", "size", "context", "lo", "hi", (F.col("many") | (F.col("n") > 1)).alias("many"))
    return reduce(DataFrame.unionByName, [p.select("g", "c", "back", "size", "context", "many") for p in [*parts, rows]]), rounds


def lcp_intervals(lcp: list[int], code: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """Stack scan of an enhanced suffix array: (depth, first, last) of every interval of the common-prefix tree of depth >=
    least whose suffixes follow different symbols. lcp[i] is the common prefix of suffixes i and i + 1, code[i] what
    stands before suffix i; intervals whose suffixes all follow one symbol extend to the left, so they are not maximal."""
    stack: list[tuple[int, int]] = []
    for i, depth in enumerate([*lcp, 0]):
        first = i
        while stack and stack[-1][0] > depth:
            d, first = stack.pop()
            if len(set(code[first : i + 1])) > 1:
                yield d, first, i
        if depth >= least and (not stack or stack[-1][0] < depth):
            stack.append((depth, first))


@dataclass
class Suffixes:
    """Sorted suffixes of many parts: row of the context, off where the suffix begins in it, code what stands before,
    lcp with the next (0 where that is of another part or another distance from the anchor)."""

    row: np.ndarray
    off: np.ndarray
    code: np.ndarray
    lcp: np.ndarray


def _rows_of(part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.concatenate([[0], np.nonzero(np.diff(part))[0] + 1])
    return first, np.diff(np.concatenate([first, [len(part)]]))


def branch_starts(texts: np.ndarray, begin: np.ndarray, part: np.ndarray, anchor: int) -> np.ndarray:
    """(part, place) where left extension can branch: what aligned texts of a part share to the left of the anchor, over
    neighbours in the order of their reversed left parts. Left-diverse intervals start nowhere else."""
    width = texts.dtype.itemsize
    left = np.ascontiguousarray(texts[:, :anchor][:, ::-1]).view(np.uint8).reshape(len(texts), -1)
    key = np.concatenate([part.astype(">u4")[:, None].view(np.uint8), left], 1)
    order = np.argsort(key.view(f"V{key.shape[1]}").ravel(), kind="stable")
    key, room, p = key[order], (anchor - begin)[order], part[order]
    same = p[1:] == p[:-1]
    differs = key[1:, 4:] != key[:-1, 4:]
    shared = np.where(differs.any(1), differs.argmax(1), left.shape[1]) // width if left.shape[1] else np.zeros(len(p) - 1, np.int64)
    shared = np.minimum(shared, np.minimum(room[1:], room[:-1]))[same]
    # rows whose left part ends early may hide what their neighbours share, so every such end is a start as well
    return np.unique(np.concatenate([np.stack([p[1:][same], anchor - shared], 1), np.stack([part, begin], 1)]), axis=0)


def sorted_suffixes(part: np.ndarray, back: np.ndarray, contexts: list[bytes], a: Alphabet) -> Iterator[Suffixes]:
    """The suffixes of many parts (rows in their order) that start where left extension branches, in pieces of bounded size."""
    codes, length = a.coded(contexts)
    places = a.room + a.least
    begin = a.room - back
    end = begin + length
    texts = np.zeros((len(contexts), 2 * places), codes.dtype)
    at = np.cumsum(length) - length
    texts[np.repeat(np.arange(len(length)), length), np.arange(len(codes)) - np.repeat(at - begin, length)] = codes
    width = texts.dtype.itemsize
    starts = branch_starts(texts[:, :places], begin, part, a.room)
    first, count = _rows_of(part)
    number = np.searchsorted(part[first], starts[:, 0])
    flat = np.lib.stride_tricks.sliding_window_view(texts.view(np.uint8), places * width, axis=1)
    most = max(1, PIECE // (places * width + 4))
    bounds = np.nonzero(np.diff(np.cumsum(count[number]) // most, prepend=-1))[0]
    for s, e in zip(bounds, [*bounds[1:], len(starts)]):
        n = count[number[s:e]]
        pair = np.repeat(np.arange(s, e), n)
        row = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - first[number[s:e]], n)
        off = np.repeat(starts[s:e, 1], n)
        fits = (off >= begin[row]) & (off + a.least <= end[row])
        pair, row, off = pair[fits], row[fits], off[fits]
        if len(row) < 2:
            continue
        # suffixes meet at equal distance from the anchor only: otherwise one place, seen from two anchors, would match itself
        key = np.concatenate([pair.astype(">u4")[:, None].view(np.uint8), flat[row, off * width]], 1)
        order = np.argsort(key.view(f"V{key.shape[1]}").ravel(), kind="stable")
        key, pair, row, off = key[order, 4:], pair[order], row[order], off[order]
        size = end[row] - off
        differs = key[1:] != key[:-1]
        lcp = np.where(differs.any(1), differs.argmax(1), places * width) // width
        lcp = np.minimum(lcp, np.minimum(size[1:], size[:-1])) * (pair[1:] == pair[:-1])
        # a text's begin, or what lies outside the context, differs from all
        code = texts[row, np.maximum(off - 1, 0)].astype(np.int64)
        edge = off == begin[row]
        code[edge] = -1 - np.arange(len(row))[edge]
        yield Suffixes(row, off, code, lcp)


def maximal_repeats(s: Suffixes, least: int, walk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(depth, first, last) of every maximal repeat among sorted suffixes. walk goes through the tree of each stretch of
    suffixes that share `least` symbols or more; of a stretch of two, the tree is one node."""
    cut = np.nonzero(s.lcp < least)[0] + 1
    first, last = np.concatenate([[0], cut]), np.concatenate([cut, [len(s.row)]]) - 1
    diverse = (last > first) & (np.minimum.reduceat(s.code, first) != np.maximum.reduceat(s.code, first))
    first, last = first[diverse], last[diverse]
    two = last == first + 1
    out = [(s.lcp[first[two]], first[two], last[two])]
    found = [(d, f + i, f + j) for f, z in zip(first[~two].tolist(), last[~two].tolist()) for d, i, j in walk(s.lcp[f:z].tolist(), s.code[f : z + 1].tolist(), least)]
    if found:
        out.append(tuple(np.array(x) for x in zip(*found)))
    return tuple(np.concatenate(x) for x in zip(*out))


def _pieces(batches) -> Iterator[tuple[np.ndarray, list[bytes], np.ndarray, list[bytes]]]:
    """Rows (g, c, back, context), sorted by g, as pieces of whole parts of two rows or more."""
    held: list[list] = [[], [], [], []]

    def ready(rows):
        g = np.array(rows[0], np.int64)
        first, count = _rows_of(g)
        keep = np.nonzero(np.repeat(count > 1, count))[0].tolist()
        return g[keep], [rows[1][i] for i in keep], np.array([rows[2][i] for i in keep], np.int64), [rows[3][i] for i in keep]

    for batch in batches:
        for x, column in zip(held, batch.columns):
            x += column.to_pylist()
        if len(held[0]) >= 2 * PART:
            end = len(held[0]) - 1
            while end and held[0][end - 1] == held[0][-1]:
                end -= 1
            if end:
                yield ready([x[:end] for x in held])
                held = [x[end:] for x in held]
    if held[0]:
        yield ready(held)


def _solve(a: Alphabet, walk):
    """From parts the stretch of each context that repeats: low and high, in symbols from the anchor on."""

    def run(batches):
        for g, c, back, contexts in _pieces(batches):
            if not len(g):
                continue
            part = np.unique(g, return_inverse=True)[1]
            low, high = np.zeros(len(g), np.int64), np.zeros(len(g), np.int64)
            for s in sorted_suffixes(part, back, contexts, a):
                depth, first, last = maximal_repeats(s, a.least, walk)
                # every repeat holds the anchor, so those of one context are one stretch together
                for shift in (0, 1):
                    two = last - first == 1
                    r, o = s.row[first[two] + shift], s.off[first[two] + shift] - a.room
                    np.minimum.at(low, r, o)
                    np.maximum.at(high, r, o + depth[two])
                for d, i, j in zip(depth[~two].tolist(), first[~two].tolist(), last[~two].tolist()):
                    r, o = s.row[i : j + 1], s.off[i : j + 1] - a.room
                    low[r] = np.minimum(low[r], o)
                    high[r] = np.maximum(high[r], o + d)
            hit = np.nonzero(high)[0]
            yield pa.RecordBatch.from_arrays([pa.array([c[i] for i in hit.tolist()], pa.binary()), pa.array(low[hit].astype(np.int32)), pa.array(high[hit].astype(np.int32))], ["c", "low", "high"])

    return run


def _dealt(parts: DataFrame) -> DataFrame:
    return parts.select("g", "c", "back", "context").repartition("g").sortWithinPartitions("g")


def repeat_spans(docs: DataFrame, a: Alphabet, walk=lcp_intervals, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_key, _whole, _spans) of each different text that holds repeats: its digest, whether copies of it exist, and the
    spans of symbols that other places share."""
    found = list_contexts(docs, a, id_col, text_col)
    parts, rounds = split_groups(found.contexts, a)
    solved = _dealt(parts).mapInArrow(_solve(a, walk), "c binary, low int, high int")
    # the same context at two places is one repeat as long as itself
    whole = found.contexts.where(F.col("many") & (F.col("size") >= a.least)).select("c", (-F.col("back")).alias("low"), (F.col("size") - F.col("back")).alias("high"))
    shared = [links.where("n > 1").select("c", "low", "high") for links in rounds]
    stretches = reduce(DataFrame.unionByName, [solved, whole, *shared])
    # written, so that the join with the places of a hot context can be split
    stretches = written(stretches.groupBy("c").agg(F.min("low").alias("low"), F.max("high").alias("high")), "stretches")
    discard(found.contexts)
    spans = found.places.join(stretches, "c").select("key", F.struct((F.col("pos") + F.col("low")).alias("start"), (F.col("pos") + F.col("high")).alias("stop")).alias("s"))
    by_text = spans.groupBy("key").agg(F.collect_set("s").alias("_spans"))
    copies = found.texts.where("n > 1").select("key", F.lit(True).alias("_whole"))
    return copies.join(by_text, "key", "full").select(F.col("key").alias("_key"), F.coalesce("_whole", F.lit(False)).alias("_whole"), "_spans")


def _list_groups(a: Alphabet, walk):
    """From parts the maximal repeats themselves: (group, size, g, c, low) of each occurrence; group is a digest of the repeat."""

    def run(batches):
        for g, c, back, contexts in _pieces(batches):
            if not len(g):
                continue
            out = []
            units: dict[int, object] = {}
            for s in sorted_suffixes(np.unique(g, return_inverse=True)[1], back, contexts, a):
                for d, i, j in zip(*[x.tolist() for x in maximal_repeats(s, a.least, walk)]):
                    r, at = int(s.row[i]), int(s.off[i] - a.room)
                    if r not in units:
                        units[r] = a.units(contexts[r])
                    begin = at + int(back[r])
                    # other places of the repeat surely share this anchor only if a window inside the repeat has it
                    if -at not in anchors(a.values(units[r][begin : begin + d]), a)[0]:
                        continue
                    name = blake2b(a.cut(units[r][begin : begin + d]), digest_size=16).digest()
                    out += [(name, d, int(g[k]), c[k], o) for k, o in zip(s.row[i : j + 1].tolist(), (s.off[i : j + 1] - a.room).tolist())]
            columns = list(zip(*out)) or [()] * 5
            kinds = (pa.binary(), pa.int32(), pa.int64(), pa.binary(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds)], ["group", "size", "g", "c", "low"])

    return run


def _name_contexts(a: Alphabet):
    """Of rows (g, c, low, size, context) those with a window inside that has the anchor, with the digest of the context."""

    def run(batches):
        for batch in batches:
            texts = batch.column(4).to_pylist()
            has = pa.array([-low in anchors(a.values(a.units(x)), a)[0] for low, x in zip(batch.column(2).to_pylist(), texts)], pa.bool_())
            names = pa.array([blake2b(x, digest_size=16).digest() for x in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([names.filter(has), *[batch.column(i).filter(has) for i in (3, 0, 1, 2)]], ["group", "size", "g", "c", "low"])

    return run


GROUPS = "group binary, size int, g long, c binary, low int"


def repeat_groups(docs: DataFrame, a: Alphabet, walk=lcp_intervals, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(group, size, id, start): every group of places that share a repeat, with all occurrences, as its digest, its size and
    where it starts, in symbols.

    Repeats are maximal as far as the context of one anchor reaches (2 * least - gram symbols); of a longer one the
    stretches around each of its anchors are listed. A repeat counts where one of its windows has the anchor, as then all
    its places do. Copies of a text list each of its places under their own ids. Null and short texts list nothing.
    """
    found = list_contexts(docs, a, id_col, text_col)
    parts, rounds = split_groups(found.contexts, a)
    rounds = [written(links, "links") for links in rounds]
    # what stands at several places without branching is a repeat as well
    whole = parts.where(F.col("many") & (F.col("size") >= a.least)).select("g", "c", (-F.col("back")).alias("low"), "size", "context")
    listed = _dealt(parts).mapInArrow(_list_groups(a, walk), GROUPS).unionByName(whole.mapInArrow(_name_contexts(a), GROUPS))
    # the last round's parts first: each context that stands for others gives way to all of them
    for links in reversed(rounds):
        listed = written(listed, "groups")
        on = links.select("g", F.col("rep").alias("c"), "up", F.col("c").alias("of"))
        listed = listed.join(on.select("g", "c"), ["g", "c"], "left_anti").unionByName(listed.join(on, ["g", "c"]).select("group", "size", F.col("up").alias("g"), F.col("of").alias("c"), "low"))
    at = listed.select("group", "size", "c", "low").distinct().join(found.places, "c")
    at = at.select("group", "size", F.col("key").alias("k"), (F.col("pos") + F.col("low")).alias("start")).distinct()
    ids = docs.select(F.col(id_col), text_key(whole_text(text_col)).alias("k"))
    return at.join(ids, "k").select("group", "size", id_col, "start")


def merged(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def marked(docs: DataFrame, a: Alphabet, walk=lcp_intervals, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, _text, _whole, _spans) for every row of docs."""
    found = repeat_spans(docs, a, walk, id_col, text_col)
    rows = docs.select(F.col(id_col).alias("_id"), whole_text(text_col).alias("_text"))
    return rows.join(found, text_key(F.col("_text")) == F.col("_key"), "left").select("_id", "_text", "_whole", "_spans")


def removed_spans(n: int, whole, spans, least: int) -> list[tuple[int, int]]:
    if whole and n >= least:
        return [(0, n)]
    return merged((s["start"], s["stop"]) for s in spans or ())
