"""Repeated word sequences by prefix-partitioned suffix trees.

Suffixes of words are dealt by a prefix that grows until a part fits in memory (see repeats); each part becomes a
subtree, whose internal nodes of enough depth are the repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from .repeats import Alphabet, marked, removed_spans, repeat_groups

#: Words in a window, by the result contract; words in an anchor's gram.
LEAST, GRAM = 35, 6


def _values(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash per word, which chooses anchors only."""
    digest = xxhash.xxh64_intdigest
    return np.array([digest(w) for w in words], np.uint64)


def _coded(cuts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The words themselves, numbered in the order they are met: equal numbers are equal words."""
    number: dict[bytes, int] = {}
    words = [x.split() for x in cuts]
    codes = [number.setdefault(w, len(number)) for x in words for w in x]
    return np.array(codes, np.uint32), np.array([len(x) for x in words], np.int64)


def word_alphabet(least: int = LEAST, gram: int = GRAM) -> Alphabet:
    return Alphabet(least, min(gram, least), bytes.split, _values, b" ".join, _coded)


def subtree_nodes(lcp: list[int], code: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """(depth, first leaf, last leaf) of the internal nodes of depth >= least of the suffix tree over sorted suffixes, if
    their leaves follow different words: others extend to the left, so they are no maximal repeats.

    Leaves are put in from left to right. The path to the last leaf is kept; a leaf that shares `depth` words with it
    closes the deeper nodes, each of which tells its parent what stands before its leaves, and hangs below the node of
    that depth, which is made where the edge holds none. lcp[i] is what leaves i and i + 1 share.
    """
    various = None
    path: list[list] = [[0, 0, code[0]]]  # depth, first leaf, what stands before all leaves so far
    for leaf, depth in enumerate([*lcp, 0]):
        below = [depth, leaf, code[leaf]]  # the part of the path that hangs deeper than depth
        while path[-1][0] > depth:
            d, first, before = path.pop()
            before = before if before == below[2] else various
            if d >= least and before is various:
                yield d, first, leaf
            below = [depth, first, before]
        if path[-1][0] < depth:
            path.append(below)
        elif path[-1][2] != below[2]:
            path[-1][2] = various


def repeated_passages(docs: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(group, size, id, start) of every maximal repeat of `least` words or more, with all its occurrences, in words."""
    return repeat_groups(docs, word_alphabet(least), subtree_nodes, id_col, text_col)


def drop_repeated_words(docs: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_words, n_removed, kept (remaining words joined by a space), kept_sha256.

    Null texts count as empty. Repeated rows are copies of each other, so both lose everything if they have `least`
    words. Null ids stay null; other columns don't matter.
    """
    a = word_alphabet(least)

    def run(batches):
        for batch in batches:
            n, gone, kept = [], [], []
            for text, whole, found in zip(*[batch.column(i).to_pylist() for i in (1, 2, 3)]):
                words = text.encode().split()
                cut = removed_spans(len(words), whole, found, least)
                at, left = 0, []
                for s, e in cut:
                    left += words[at:s]
                    at = e
                left += words[at:]
                n.append(len(words))
                gone.append(len(words) - len(left))
                kept.append(b" ".join(left))
            sha = [hashlib.sha256(k).hexdigest() for k in kept]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array([k.decode() for k in kept], pa.string()), pa.array(sha, pa.string())], ["id", "n_words", "n_removed", "kept", "kept_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return marked(docs, a, subtree_nodes, id_col, text_col).mapInArrow(run, f"id {kind}, n_words long, n_removed long, kept string, kept_sha256 string").withColumnRenamed("id", id_col)


def substring_digests(docs: DataFrame) -> DataFrame:
    """The rows of drop_repeated_words without the words themselves; nulls, empties and repeats as there."""
    return drop_repeated_words(docs).drop("kept")
