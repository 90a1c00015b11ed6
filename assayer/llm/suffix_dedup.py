"""Repeated byte strings by common-prefix intervals of enhanced suffix arrays.

The suffixes of a part are sorted, neighbours' common prefixes are scanned with a stack, and every interval whose
suffixes follow different bytes is a maximal repeat, given with all its occurrences (repeated_strings lists them). See
repeats for how suffixes are dealt into parts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .repeats import Alphabet, marked, removed_spans, repeat_groups

#: Bytes in a window, by the result contract, and in an anchor's gram.
LEAST, GRAM = 200, 24


def _coded(cuts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(cuts), np.uint8), np.array([len(x) for x in cuts], np.int64)


def byte_alphabet(least: int = LEAST, gram: int = GRAM) -> Alphabet:
    return Alphabet(least, min(gram, least), lambda data: data, lambda data: np.frombuffer(data, np.uint8), lambda part: part, _coded)


def repeated_strings(docs: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(group, size, id, start) of every maximal repeat group of `least` bytes or more, with all its occurrences."""
    return repeat_groups(docs, byte_alphabet(least), id_col=id_col, text_col=text_col)


def drop_repeated_bytes(docs: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, n_spans, kept (the remaining bytes), kept_sha256.

    Null texts count as empty: nothing to remove. Repeated rows are copies of each other, so both lose everything if
    they have `least` bytes. Null ids stay null; other columns don't matter.
    """
    a = byte_alphabet(least)

    def run(batches):
        for batch in batches:
            n, gone, spans, kept = [], [], [], []
            for text, whole, found in zip(*[batch.column(i).to_pylist() for i in (1, 2, 3)]):
                data = text.encode()
                cut = removed_spans(len(data), whole, found, least)
                at, left = 0, []
                for s, e in cut:
                    left.append(data[at:s])
                    at = e
                left.append(data[at:])
                n.append(len(data))
                gone.append(sum(e - s for s, e in cut))
                spans.append(len(cut))
                kept.append(b"".join(left))
            sha = [hashlib.sha256(k).hexdigest() for k in kept]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, pa.int64()) for x in (n, gone, spans)], pa.array(kept, pa.binary()), pa.array(sha, pa.string())], ["id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return marked(docs, a, id_col=id_col, text_col=text_col).mapInArrow(run, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string").withColumnRenamed("id", id_col)


def suffix_digests(docs: DataFrame) -> DataFrame:
    """The rows of drop_repeated_bytes without the bytes themselves; nulls, empties and repeats as there."""
    return drop_repeated_bytes(docs).drop("kept")
