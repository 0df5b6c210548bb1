"""Quality classifier: a byte-level convolutional network in numpy.

Each byte gives a learned embedding and flags that say which earlier bytes (2 to 28 back) equal it. Sums over cells of
8 bytes feed learned filters over chunks of 64 bytes, one every 32 bytes, so that the overlapping chunks cover the
whole document. A rectifier, the maximum over all chunks, and one output unit give the probability. Training is
minibatch Adam; the gradient reaches filters and embeddings through each maximum's chunk.

Edge cases: null and empty texts are one empty chunk. Very long texts run in segments that overlap by a chunk, so the
maximum is the same and memory bounded. Repeated rows score alike. Null labels and ids are not learned from. Without
labelled documents of both classes fit() raises ValueError and train() gives a model that scores every text with the
rate of label 1 (a half without labels). Other columns, whatever their names, pass keep() unchanged and are not read by
score(). An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom import runtime
from quadloom.llm import sampling

#: Labelled rows per class for fitting: the documented bound.
PER_CLASS = 1000
CELL, CELLS, STRIDE = 8, 8, 4
DIM, FILTERS = 8, 24
LAGS = tuple(range(2, 29))
CONTEXT = 32
SEGMENT = 1 << 17
BLOCK = 1 << 18
EPOCHS, BATCH, RATE = 10, 64, 0.01
THRESHOLD = 0.3


@dataclass(frozen=True)
class Model:
    embedding: np.ndarray  # 256 x DIM
    filters: np.ndarray  # CELLS * (DIM + lags) x FILTERS
    bias: np.ndarray
    out: np.ndarray
    out_bias: float


def _segments(data: bytes) -> list[bytes]:
    """Parts of a document, each with CONTEXT bytes before it; chunks that cross a border belong to both sides."""
    step = CELL * STRIDE
    return [b"\0" * max(0, CONTEXT - k) + data[max(0, k - CONTEXT) : k + SEGMENT + step] for k in range(0, max(1, len(data)), SEGMENT)]


def _layout(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All parts in one buffer on cell borders, and each part's first chunk and number of chunks."""
    step = CELL * STRIDE
    chunks = np.array([max(1, -(-(len(p) - CONTEXT) // step)) for p in parts])
    lengths = CONTEXT + (chunks + 1) * step
    ends = np.cumsum(lengths)
    x = np.zeros(int(ends[-1]), np.uint8)
    for p, e, n in zip(parts, ends, lengths, strict=True):
        x[e - n : e - n + len(p)] = np.frombuffer(p, np.uint8)[:n]
    return x, (ends - lengths + CONTEXT) // step, chunks


def _flags(x: np.ndarray) -> np.ndarray:
    """Per cell and lag, how many of the cell's bytes equal the byte that far back."""
    out = np.empty((len(x) // CELL, len(LAGS)), np.float32)
    eq, some = np.zeros(len(x), np.uint8), x != 0
    for j, lag in enumerate(LAGS):
        np.equal(x[lag:], x[:-lag], out=eq[lag:].view(bool))
        eq[lag:] &= some[lag:].view(np.uint8)
        out[:, j] = (eq.view(np.uint64) * np.uint64(0x0101010101010101)) >> np.uint64(56)
    return out


def _inputs(x: np.ndarray, flags: np.ndarray, embedding: np.ndarray) -> np.ndarray:
    """Per chunk, its cells' sums, over 8: chunks x CELLS * (DIM + lags). Overlapping rows of one array."""
    cells = np.concatenate([embedding[x].reshape(-1, CELL, embedding.shape[1]).sum(1), flags], 1) / np.float32(CELL)
    width = cells.shape[1]
    return np.lib.stride_tricks.as_strided(cells, ((len(cells) - CELLS) // STRIDE + 1, CELLS * width), (STRIDE * width * 4, 4), writeable=False)


def _forward(x: np.ndarray, flags: np.ndarray, first: np.ndarray, chunks: np.ndarray, m: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximum per part and filter, and the chunk it is in."""
    rows = _inputs(x, flags, m.embedding)
    act = rows @ m.filters + m.bias
    best = np.empty((len(first), act.shape[1]), np.float32)
    where = np.empty((len(first), act.shape[1]), np.int64)
    for i, (f, n) in enumerate(zip(first, chunks, strict=True)):
        k = act[f : f + n].argmax(0)
        where[i] = f + k
        best[i] = act[f + k, np.arange(act.shape[1])]
    return best, where, rows


def probabilities(texts: list[str | None], m: Model) -> np.ndarray:
    out = np.empty(len(texts))
    parts: list[bytes] = []
    owner: list[int] = []
    best = np.full((len(texts), m.filters.shape[1]), -np.inf, np.float32)

    def run():
        x, first, chunks = _layout(parts)
        got, _, _ = _forward(x, _flags(x), first, chunks, m)
        np.maximum.at(best, np.array(owner), got)
        parts.clear()
        owner.clear()

    size = 0
    for i, t in enumerate(texts):
        for p in _segments((t or "").encode()):
            parts.append(p)
            owner.append(i)
            size += len(p) + 64
            if size > BLOCK:
                run()
                size = 0
    if parts:
        run()
    z = np.maximum(best, 0) @ m.out + m.out_bias
    out[:] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    return out


def fit(good: list[str], bad: list[str], rate: float, seed: int = 5) -> Model:
    """``rate``: the share of good documents, for calibration."""
    if not good or not bad:
        raise ValueError("quality needs labelled documents of both classes")
    rng = np.random.default_rng(seed)
    texts = [(t, 1.0) for t in good] + [(t, 0.0) for t in bad]
    width = CELLS * (DIM + len(LAGS))
    p = {"embedding": rng.normal(0, 0.5, (256, DIM)), "filters": rng.normal(0, (2 / width) ** 0.5, (width, FILTERS)), "bias": np.zeros(FILTERS), "out": rng.normal(0, 0.3, FILTERS), "out_bias": np.zeros(1)}
    p = {k: v.astype(np.float32) for k, v in p.items()}
    p["embedding"][0] = 0
    m1, m2 = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    # a long document trains by its segments' common maximum, as it is scored; its bytes are laid out once
    laid = []
    for t, y in texts:
        x, first, chunks = _layout([b"\0" * CONTEXT + t.encode()])
        laid.append((x, int(chunks[0]), y))
    step = 0
    half = np.array([0.5 / len(good), 0.5 / len(bad)]) * len(texts)
    for epoch in range(EPOCHS):
        order = rng.permutation(len(laid))
        for at in range(0, len(order), BATCH):
            own = [laid[i] for i in order[at : at + BATCH]]
            x, flags = np.concatenate([o[0] for o in own]), np.concatenate([_flags(o[0]) for o in own])
            first = (np.cumsum([0, *[len(o[0]) for o in own[:-1]]]) + CONTEXT) // (CELL * STRIDE)
            y = np.array([o[2] for o in own], np.float32)
            model = Model(p["embedding"], p["filters"], p["bias"], p["out"], float(p["out_bias"][0]))
            best, where, rows = _forward(x, flags, first, np.array([o[1] for o in own]), model)
            h = np.maximum(best, 0)
            z = h @ p["out"] + p["out_bias"][0]
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * np.where(y == 1, half[0], half[1]) / len(own)
            gh = g[:, None] * p["out"] * (best > 0)
            grad = {"out": h.T @ g, "out_bias": np.array([g.sum()]), "bias": gh.sum(0), "filters": np.stack([rows[where[:, f]].T @ gh[:, f] for f in range(FILTERS)], 1)}
            ge = np.zeros_like(p["embedding"])
            weights = p["filters"].reshape(CELLS, DIM + len(LAGS), FILTERS)[:, :DIM]
            bytes_at = x[(where * CELL * STRIDE)[:, :, None] + np.arange(CELL * CELLS)]  # docs x filters x 64
            for c in range(CELLS):
                to = gh[:, :, None] * weights[c].T[None] / CELL  # docs x filters x DIM
                cell = bytes_at[:, :, c * CELL : (c + 1) * CELL]
                np.add.at(ge, cell.reshape(-1), np.repeat(to.reshape(-1, DIM), CELL, 0))
            ge[0] = 0
            grad["embedding"] = ge
            step += 1
            lr = RATE * (1 - 0.8 * epoch / EPOCHS)
            for k, v in grad.items():
                v = v + 1e-4 * p[k]
                m1[k] = 0.9 * m1[k] + 0.1 * v
                m2[k] = 0.99 * m2[k] + 0.01 * v * v
                p[k] -= (lr * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    p["embedding"][0] = 0
    return Model(p["embedding"], p["filters"], p["bias"], p["out"], float(p["out_bias"][0] + np.log(rate / (1 - rate))))


def _scored(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(probabilities(batch.columns[-1].to_pylist(), model.value), pa.float64())], [*batch.schema.names[:-1], "score"])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every row."""
    spark = docs.sparkSession
    runtime.ship(spark)
    runtime.small_batches(spark)
    sent = spark.sparkContext.broadcast(model)  # some 10,000 numbers
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(lambda it: _scored(it, sent), "doc_id bigint, score double")


def constant(rate: float) -> Model:
    """Every text's score is the rate."""
    width = CELLS * (DIM + len(LAGS))
    return Model(np.zeros((256, DIM), np.float32), np.zeros((width, FILTERS), np.float32), np.zeros(FILTERS, np.float32), np.zeros(FILTERS, np.float32), float(np.log(rate / (1 - rate))))


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Fits on a bounded sample of labelled rows, in one task; the class rate is counted over all labels. Without
    labelled documents of both classes the model is that rate for every text."""
    runtime.ship(docs.sparkSession)
    runtime.small_batches(docs.sparkSession)
    rate = sampling.rate_of(labels, "quality")

    def learn(rows: list[tuple]) -> Model:
        texts = sampling.by_class(rows)
        return fit(texts[1], texts[0], rate) if texts[0] and texts[1] else constant(rate)

    return sampling.fit_in_task(sampling.labelled_texts(docs, labels, "quality", per_class), learn)


def op2_byte_cnn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = runtime.table(spark, sf_dir, "documents"), runtime.table(spark, sf_dir, "labels")
    model = train(docs, labels.where(sampling.fold("doc_id", 5) != 0))
    return score(docs, model).select("doc_id", (sampling.fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows that score ``threshold`` or more, with all their columns."""
    spark = docs.sparkSession
    runtime.ship(spark)
    runtime.small_batches(spark)
    sent = spark.sparkContext.broadcast(model)
    free = next(n for n in (f"quality_{i}" for i in range(len(docs.columns) + 1)) if n not in docs.columns)
    both = docs.withColumn(free, F.col(text_col).cast("string"))

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = probabilities(batch.columns[-1].to_pylist(), sent.value)
            yield batch.drop_columns([free]).filter(pa.array(p >= threshold))

    return both.mapInArrow(passed, docs.schema)
