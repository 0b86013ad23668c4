"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are embedded and convolved with learned filters.  The activations are
max-pooled over overlapping chunks that cover the whole text; each chunk's pooled vector
gives a logit through one hidden layer, and the mean logit of all chunks the probability.
The network is learnt from the whole texts of a bounded sample of labelled rows: in each
round the tasks train on their rows from the same weights, and the driver averages what they
return.  The weights are then sent to the tasks, which score whole texts of any length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylens.llm.common import append_columns
from quarrylens.operators.lineage import cut

EMBED = 8
WIDTH = 8  # bytes under a filter
STEP = 2
FILTERS = 32
HIDDEN = 16
BLOCK = 128  # bytes; a chunk is CHUNK_BLOCKS of them and starts every CHUNK_HOP
CHUNK_BLOCKS = 4
CHUNK_HOP = 2
CHUNK = BLOCK * CHUNK_BLOCKS
BYTES_AT_ONCE = 1 << 18
THRESHOLD = 0.3

SAMPLE_PER_CLASS = 2_000  # labelled rows to train on, at most; whole texts
PARTS = 4  # tasks that train side by side
ROUNDS = 14  # passes over the rows, each from the average of the last
BATCH = 16  # texts
RATE = 3e-3
SEED = 7


@dataclass
class Network:
    """The weights; ``embed`` has a row per byte, the zero byte also pads."""

    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def weights(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.bias, self.hidden, self.hidden_bias, self.out, self.out_bias]


def new_network(seed: int = SEED) -> Network:
    rng = np.random.default_rng(seed)

    def normal(*shape: int, scale: float) -> np.ndarray:
        return (rng.standard_normal(shape) * scale).astype(np.float32)

    return Network(
        normal(256, EMBED, scale=0.5),
        normal(WIDTH * EMBED, FILTERS, scale=(2 / (WIDTH * EMBED)) ** 0.5),
        np.zeros(FILTERS, np.float32),
        normal(FILTERS, HIDDEN, scale=(2 / FILTERS) ** 0.5),
        np.zeros(HIDDEN, np.float32),
        normal(HIDDEN, 1, scale=(1 / HIDDEN) ** 0.5),
        np.zeros(1, np.float32),
    )


def _windows(embedded: np.ndarray) -> np.ndarray:
    """Rows of WIDTH embedded bytes, one every STEP bytes, of (..., bytes, EMBED)."""
    *lead, n, width = embedded.shape
    count = (n - WIDTH) // STEP + 1
    strides = (*embedded.strides[:-2], STEP * embedded.strides[-2], embedded.strides[-1])
    return np.lib.stride_tricks.as_strided(embedded, (*lead, count, WIDTH * width), strides)


def chunk_spans(n_bytes: int) -> list[tuple[int, int]]:
    """(first, past the last) byte of the overlapping chunks that cover a text."""
    blocks = max(1, -(-n_bytes // BLOCK))
    starts = range(0, max(1, blocks - CHUNK_BLOCKS + CHUNK_HOP), CHUNK_HOP)
    return [(s * BLOCK, min(s + CHUNK_BLOCKS, blocks) * BLOCK) for s in starts]


@dataclass
class Learner:
    """A network with the running moments of its gradients (Adam)."""

    net: Network
    moments: list[np.ndarray]
    steps: int = 0

    def arrays(self) -> list[np.ndarray]:
        return [*self.net.weights(), *self.moments]

    def learn(self, texts: list[bytes], labels: np.ndarray, weights: np.ndarray) -> None:
        """One step on the weighted logistic loss of whole texts."""
        self.steps += 1
        own = self.net.weights()
        first, second = self.moments[: len(own)], self.moments[len(own) :]
        for w, g, m, v in zip(own, _gradients(self.net, texts, labels, weights), first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            w -= RATE * (m / (1 - 0.9**self.steps)) / (np.sqrt(v / (1 - 0.999**self.steps)) + 1e-8)

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.arrays()]).astype(np.float64)

    def set(self, values: np.ndarray) -> None:
        at = 0
        for x in self.arrays():
            x[...] = values[at : at + x.size].reshape(x.shape)
            at += x.size


def new_learner(seed: int = SEED) -> Learner:
    net = new_network(seed)
    return Learner(net, [np.zeros_like(w) for _ in range(2) for w in net.weights()])


def _gradients(net: Network, texts: list[bytes], labels: np.ndarray, weights: np.ndarray) -> list[np.ndarray]:
    raw, blocks, peaks, places = _block_peaks(net, texts, places=True)
    pooled = np.maximum(peaks + net.bias, 0)
    owner, members, chunks_of = _chunks(blocks)
    over = pooled[members]  # (chunks, blocks of a chunk, filters)
    winner = over.argmax(axis=1)
    best = np.take_along_axis(over, winner[:, None, :], axis=1)[:, 0, :]
    inner = best @ net.hidden + net.hidden_bias
    shown = np.maximum(inner, 0)
    logit = (shown @ net.out)[:, 0] + net.out_bias[0]
    mean = np.bincount(owner, weights=logit) / chunks_of
    error = (1 / (1 + np.exp(-np.clip(mean, -60, 60))) - labels) * weights / len(texts)
    error = (error / chunks_of)[owner].astype(np.float32)[:, None]
    d_shown = (error @ net.out.T) * (inner > 0)
    d_best = (d_shown @ net.hidden.T) * (best > 0)
    cell = np.take_along_axis(members, winner, axis=1) * FILTERS + np.arange(FILTERS)
    d_value = np.bincount(cell.ravel(), weights=d_best.ravel(), minlength=len(peaks) * FILTERS)
    d_value = d_value.reshape(-1, FILTERS).astype(np.float32)
    d_filters, d_embed = np.zeros_like(net.filters), np.zeros_like(net.embed)
    used = np.flatnonzero(d_value.any(axis=1))
    for at in range(0, len(used), BYTES_AT_ONCE // BLOCK):
        some = used[at : at + BYTES_AT_ONCE // BLOCK]
        under = raw[(some[:, None] * BLOCK + places[some] * STEP)[:, :, None] + np.arange(WIDTH)]
        windows = net.embed[under].reshape(len(some), FILTERS, WIDTH * EMBED)
        d_filters += np.einsum("nfw,nf->wf", windows, d_value[some], optimize=True)
        d_window = (d_value[some][:, :, None] * net.filters.T[None]).reshape(-1, EMBED)
        for k in range(EMBED):
            d_embed[:, k] += np.bincount(under.ravel(), weights=d_window[:, k], minlength=256)
    return [
        d_embed,
        d_filters,
        d_value.sum(axis=0),
        best.T @ d_shown,
        d_shown.sum(axis=0),
        shown.T @ error,
        error.sum(axis=0),
    ]


def scores(net: Network, texts: list[bytes]) -> np.ndarray:
    """The probability of label 1 for each text; the texts of a call share large matrix products."""
    out = np.empty(len(texts))
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) < BYTES_AT_ONCE):
            size += len(texts[end]) + BLOCK
            end += 1
        out[at:end] = _scores(net, texts[at:end])
        at = end
    return out


def _block_peaks(net: Network, texts: list[bytes], places: bool = False) -> tuple:
    """The texts' joined bytes, blocks of each, and each block's largest activations with, if asked, their windows."""
    # Each text ends with WIDTH zero bytes at least, a whole window of them.
    blocks = np.array([-(-(len(t) + WIDTH) // BLOCK) for t in texts])
    joined = b"".join(t.ljust(n * BLOCK, b"\0") for t, n in zip(texts, blocks.tolist(), strict=True)) + bytes(WIDTH)
    raw = np.frombuffer(joined, dtype=np.uint8)
    per_block = BLOCK // STEP
    total = int(blocks.sum())
    peaks = np.empty((total, FILTERS), np.float32)
    at_peak = np.empty((total, FILTERS), np.int32) if places else None
    last_block = np.zeros(total, dtype=bool)
    last_block[np.cumsum(blocks) - 1] = True
    blocks_at_once = BYTES_AT_ONCE // BLOCK
    for low in range(0, total, blocks_at_once):
        high = min(total, low + blocks_at_once)
        windows = _windows(net.embed[raw[low * BLOCK : high * BLOCK + WIDTH]])[: (high - low) * per_block]
        active = (windows @ net.filters).reshape(high - low, per_block, FILTERS)
        # The windows that begin in a text's last zero bytes would reach into the next text.
        active[last_block[low:high], 1 - WIDTH // STEP :] = -np.inf
        if places:
            at_peak[low:high] = active.argmax(axis=1)
        peaks[low:high] = active.max(axis=1)
    return raw, blocks, peaks, at_peak


def _chunks(blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each chunk's text, its CHUNK_BLOCKS blocks (the last repeated), and the number of chunks of each text."""
    first = np.cumsum(blocks) - blocks
    chunks_of = np.maximum(1, -(-(blocks - CHUNK_BLOCKS) // CHUNK_HOP) + 1)
    owner = np.repeat(np.arange(len(blocks)), chunks_of)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(chunks_of) - chunks_of, chunks_of)
    start = first[owner] + nth * CHUNK_HOP
    last = (first + blocks - 1)[owner]
    return owner, np.minimum(start[:, None] + np.arange(CHUNK_BLOCKS), last[:, None]), chunks_of


def _scores(net: Network, texts: list[bytes]) -> np.ndarray:
    _, blocks, peaks, _ = _block_peaks(net, texts)
    pooled = np.maximum(peaks + net.bias, 0)
    owner, members, chunks_of = _chunks(blocks)
    best = pooled[members[:, 0]]
    for i in range(1, CHUNK_BLOCKS):
        best = np.maximum(best, pooled[members[:, i]])
    logit = (np.maximum(best @ net.hidden + net.hidden_bias, 0) @ net.out)[:, 0] + net.out_bias[0]
    mean = np.bincount(owner, weights=logit) / chunks_of
    return 1 / (1 + np.exp(-np.clip(mean, -60, 60)))


def _round(values: np.ndarray, steps: int, shares: tuple[float, float], seed: int):
    """A task's training on its rows, from the weights of the last round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learner, seen = new_learner(), 0
        learner.set(values)
        learner.steps = steps
        rng = np.random.default_rng(seed)
        for batch in batches:
            labels = batch.column(0).to_numpy(zero_copy_only=False).astype(np.float64)
            texts = batch.column(1).cast(pa.binary())
            order = rng.permutation(len(labels))
            for at in range(0, len(order), BATCH):
                rows = order[at : at + BATCH]
                some = labels[rows]
                weights = np.where(some == 1, 0.5 / shares[1], 0.5 / shares[0])
                learner.learn([texts[int(i)].as_py() for i in rows], some, weights)
            seen += len(labels)
        if seen:
            yield pa.RecordBatch.from_arrays(
                [pa.array([seen], pa.int64()), pa.array([learner.steps], pa.int64()), pa.array([learner.flat().tobytes()], pa.binary())],
                names=["rows", "steps", "state"],
            )

    return run


def fit(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    per_class: int = SAMPLE_PER_CLASS,
    parts: int = PARTS,
    rounds: int = ROUNDS,
) -> Network | None:
    """A network learnt from at most ``per_class`` rows of each label, those of the smallest hashes.

    The rows' whole texts are written to the checkpoint folder in ``parts`` parts and read again by
    each round; the driver gets a part's weights and their moments, some 60 kB.  Every text counts
    alike, whatever its length, and both classes weigh the same in the loss.  Without rows of both
    labels there is no network.
    """
    marks = labels.select(F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{label}`").cast("int").alias("label"))
    marks = marks.filter("_id is not null and label in (0, 1)").dropDuplicates(["_id"])
    picked = None
    for value in (0, 1):
        some = marks.filter(F.col("label") == value).orderBy(F.xxhash64("_id"), "_id").limit(per_class)
        picked = some if picked is None else picked.unionByName(some)
    own = docs.select(F.col(f"`{doc_id}`").alias("_doc"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    rows = own.join(F.broadcast(picked), F.col("_doc") == F.col("_id"))
    # Rows that repeat an id would let the sample grow, so each id gives one text.
    rows = rows.groupBy("_id", "label").agg(F.min("text").alias("text"))
    rows = cut(rows.repartition(parts, F.xxhash64("_id")).sortWithinPartitions(F.xxhash64("_id"), "_id").select("label", "text"))
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(counts) < 2:
        return None
    shares = (counts[0] / sum(counts.values()), counts[1] / sum(counts.values()))
    learner = new_learner()
    for i in range(rounds):
        run = _round(learner.flat(), learner.steps, shares, SEED + i)
        found = sorted((bytes(r["state"]), r["rows"], r["steps"]) for r in rows.mapInArrow(run, "rows long, steps long, state binary").collect())
        states = np.array([np.frombuffer(state) for state, _, _ in found])
        learner.set(np.average(states, axis=0, weights=[n for _, n, _ in found]))
        learner.steps = max(steps for _, _, steps in found)
    return learner.net


def score_texts(docs: DataFrame, net: Network | None, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``score`` and ``predicted``.

    A null text scores as an empty one.  Whole texts are scored, whatever their length.  Without
    a network every score is 0.5.  Repeated rows score equally, an empty table stays empty, and
    an input column named like a result is replaced by it.
    """
    added = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def make():
        def compute(texts: pa.Array) -> list:
            raw = [x or b"" for x in texts.cast(pa.binary()).to_pylist()]
            found = np.full(len(raw), 0.5) if net is None else scores(net, raw)
            return [pa.array(found), pa.array((found >= threshold).astype(np.int32))]

        return compute

    return append_columns(docs, [text], added, make)
