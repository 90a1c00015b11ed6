"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded, filters of WIDTH bytes run over overlapping chunks that together cover the whole text, each filter
is max-pooled per chunk, the chunks' maxima are combined (their maximum and their mean), and a logistic layer gives one
probability. Training is plain Adam on a bounded sample of labelled rows; scoring reads every byte of every text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import whole_text

#: The network: filter width, embedding size, filters, chunk length in bytes.
WIDTH, DIM, FILTERS, CHUNK = 7, 8, 24, 512
#: Bounds of the training sample: labelled rows, and bytes of their whole texts together; and chunks that are run at once.
TRAIN_ROWS, TRAIN_BYTES, BLOCK = 4000, 16 << 20, 256
#: Passes over the sample, more where it is small so that there are at least STEPS updates.
EPOCHS, STEPS, BATCH, RATE, SEED, THRESHOLD = 12, 500, 64, 5e-3, 7, 0.3


def chunks(data: bytes) -> list[bytes]:
    """Overlapping chunks covering data: neighbours share WIDTH - 1 bytes, so that no filter position is lost; short
    texts are padded with zeros to one filter width."""
    data = data if len(data) >= WIDTH else data + b"\0" * (WIDTH - len(data))
    step = CHUNK - WIDTH + 1
    return [data[i : i + CHUNK] for i in range(0, max(1, len(data) - WIDTH + 1), step)]


def start_model(seed: int = SEED) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    return {
        "E": r.normal(0, 0.5, (256, DIM)).astype(np.float32),
        "W": r.normal(0, (WIDTH * DIM) ** -0.5, (WIDTH, DIM, FILTERS)).astype(np.float32),
        "b": np.zeros(FILTERS, np.float32),
        "v": r.normal(0, 0.1, 2 * FILTERS).astype(np.float32),
        "c": np.zeros(1, np.float32),
    }


def convolve(byte_rows: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """Filter responses at every position of rows of bytes; tables[k] is what byte values add at place k."""
    n = byte_rows.shape[-1] - WIDTH + 1
    out = tables[0][byte_rows[..., :n]]
    for k in range(1, WIDTH):
        out += tables[k][byte_rows[..., k : k + n]]
    return out


def _tables(model) -> np.ndarray:
    return np.einsum("ed,kdf->kef", model["E"], model["W"]).astype(np.float32)


def _padded(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Chunks as rows of one length, and how many filter positions of each are real."""
    size = np.array([len(p) for p in parts])
    rows = np.zeros((len(parts), size.max()), np.uint8)
    for i, p in enumerate(parts):
        rows[i, : len(p)] = np.frombuffer(p, np.uint8)
    return rows, size - WIDTH + 1


def pooled(parts: list[bytes], tables: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per chunk and filter: the largest response and where it is; and the chunks' bytes."""
    rows, real = _padded(parts)
    h = convolve(rows, tables)
    h[np.arange(h.shape[1])[None, :] >= real[:, None]] = -np.inf
    at = h.argmax(1)
    return np.take_along_axis(h, at[:, None, :], 1)[:, 0], at, rows


def pooled_blocks(parts: list[bytes], tables: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """pooled, in blocks of chunks: the responses of one block at a time are held."""
    longest = max(map(len, parts))
    found = [pooled(parts[i : i + BLOCK], tables) for i in range(0, len(parts), BLOCK)]
    rows = [np.pad(r, ((0, 0), (0, longest - r.shape[1]))) for _, _, r in found]
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]), np.concatenate(rows)


def combined(top: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per document: the maximum and the mean of its chunks' activations; owner is sorted and covers 0..n-1."""
    first = np.searchsorted(owner, np.arange(n))
    return np.maximum.reduceat(top, first, axis=0), np.add.reduceat(top, first, axis=0) / np.bincount(owner, minlength=n)[:, None]


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(texts: list[bytes], y: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> dict[str, np.ndarray]:
    """Fits the network to whole texts, as chunks that cover them. Without both labels it stays at the labels' mean."""
    model = start_model(seed)
    if not len(y) or y.min() == y.max():
        model["v"][:] = 0
        model["c"][:] = 0 if not len(y) else (6.0 if y[0] else -6.0)
        return model
    r = np.random.default_rng(seed)
    moment = {k: [np.zeros_like(p), np.zeros_like(p)] for k, p in model.items()}
    t = 0
    epochs = max(epochs, -(-STEPS // -(-len(y) // BATCH)))
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs) + 1e-4
        order = r.permutation(len(y))
        for k in range(0, len(order), BATCH):
            docs = order[k : k + BATCH]
            parts = [c for d in docs for c in chunks(texts[d])]
            owner = np.repeat(np.arange(len(docs)), [len(chunks(texts[d])) for d in docs])
            top, at, rows = pooled_blocks(parts, _tables(model))
            act = np.maximum(top + model["b"], 0)
            high, mean = combined(act, owner, len(docs))
            x = np.concatenate([high, mean], 1)
            err = (sigmoid(x @ model["v"] + model["c"]) - y[docs]).astype(np.float32) / len(docs)
            g = {"v": x.T @ err + 1e-4 * model["v"], "c": np.array([err.sum()], np.float32)}
            up = err[:, None] * model["v"][None]
            is_high = act >= high[owner]
            count = np.bincount(owner, minlength=len(docs))[owner, None]
            d_act = (up[owner, :FILTERS] * is_high + up[owner, FILTERS:] / count) * (act > 0)
            g["b"] = d_act.sum(0)
            # only the bytes under each maximum get a gradient
            under = rows[np.arange(len(rows))[:, None, None], at[:, :, None] + np.arange(WIDTH)]
            seen = model["E"][under]
            g["W"] = np.einsum("cf,cfkd->kdf", d_act, seen)
            to_e = np.einsum("cf,kdf->cfkd", d_act, model["W"]).reshape(-1, DIM)
            g["E"] = np.stack([np.bincount(under.ravel(), to_e[:, j], 256) for j in range(DIM)], 1).astype(np.float32)
            t += 1
            for name, p in model.items():
                m, s = moment[name]
                m += 0.1 * (g[name] - m)
                s += 0.001 * (g[name] ** 2 - s)
                p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
    return model


def score_text(data: bytes, model, tables) -> float:
    """Probability that a text is good; its chunks go through in blocks, so memory doesn't grow with the text."""
    parts = chunks(data)
    high, total = np.zeros(FILTERS, np.float32), np.zeros(FILTERS, np.float64)
    for i in range(0, len(parts), 64):
        act = np.maximum(pooled(parts[i : i + 64], tables)[0] + model["b"], 0)
        high = np.maximum(high, act.max(0))
        total += act.sum(0)
    x = np.concatenate([high, total / len(parts)])
    return float(sigmoid(x @ model["v"] + model["c"][0]))


def is_held_out(id_col: str):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows: int, most_bytes: int = TRAIN_BYTES):
    """Whole texts and labels of labelled rows not held out, in the order of a hash of the id: at most `rows` of them and,
    after the first, as many as `most_bytes` hold, so what reaches the driver is bounded."""
    marks = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(id_col).agg(F.max(label_col).cast("int").alias("_y"))
    chosen = marks.where(~is_held_out(id_col)).orderBy(F.xxhash64(id_col), id_col).limit(rows).select(F.col(id_col).alias("_id"), "_y")
    texts = docs.select(F.col(id_col).alias("_id"), whole_text(text_col).alias("_text")).join(chosen, "_id")
    sized = texts.select("_id", "_y", F.xxhash64("_text").alias("_t"), F.octet_length("_text").alias("_n")).orderBy(F.xxhash64("_id"), "_id", "_t").limit(rows).collect()
    total, kept = 0, []
    for r in sized:
        total += r["_n"]
        if total > max(most_bytes, sized[0]["_n"]):
            break
        kept.append((r["_id"], r["_t"], len(kept)))
    if not kept:
        return [], np.zeros(0, np.float32)
    # the texts of the chosen rows; rows repeated with id and text teach once
    kind = docs.schema[id_col].dataType.simpleString()
    wanted = docs.sparkSession.createDataFrame(kept, f"_id {kind}, _t long, _at int").groupBy("_id", "_t").agg(F.min("_at").alias("_at"))
    found = texts.withColumn("_t", F.xxhash64("_text")).join(wanted, ["_id", "_t"]).groupBy("_at").agg(F.first("_text").alias("_text"), F.first("_y").alias("_y")).orderBy("_at").collect()
    return [r["_text"].encode() for r in found], np.array([r["_y"] for r in found], np.float32)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD, train_rows: int = TRAIN_ROWS, keep_row: bool = False) -> DataFrame:
    """One row per input row: id, held_out, score, predicted, and with keep_row the whole input row as the struct _row.

    Rows whose crc32(id as text) mod 5 is 0 are held out of training. Null texts count as empty and get a score like
    any; rows with a null id or without a label are scored but teach nothing; labels other than 0 and 1 are ignored,
    of several labels the greatest counts. Without usable labels of both kinds the score is their mean's side, or 0.5.
    """
    texts, y = training_sample(docs, labels, id_col, text_col, label_col, train_rows)
    model = train(texts, y)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _tables(model)
        for batch in batches:
            marks = [score_text(t.encode(), model, tables) for t in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(batch.num_columns - 1)], pa.array(marks, pa.float64())], [*batch.schema.names[:-1], "score"])

    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")] if keep_row else []
    rows = docs.select(F.col(id_col).alias("_id"), is_held_out(id_col).alias("_held"), *row, whole_text(text_col).alias("_text"))
    scored = rows.mapInArrow(run, T.StructType([*rows.schema.fields[:-1], T.StructField("score", T.DoubleType())]))
    kept = ["_row"] if keep_row else []
    return scored.select(F.col("_id").alias(id_col), F.col("_held").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *kept)
