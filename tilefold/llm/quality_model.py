"""Quality classifier: random-indexing vectors, pooled per document, under a two-layer network.

Every word has two tokens: itself, and its shape (runs of lower case, upper case and digits
become one sign each, other signs stay, and a word equal to the one before it has a shape of
its own). A token's index vector is sparse and follows from its hash; its context vector is the
sum of the index vectors of its neighbours' tokens over all documents of the corpus. Tasks add
up integers in a table of fixed size, tables are added in a tree, so the sums do not depend on
the order. A document's features are the means of its tokens' unit vectors and their lengths.

The network (tanh layer, logistic output) is trained in numpy on a bounded sample of labelled
rows of folds 0 and 1; a temperature fitted on fold 3 calibrates its probabilities. Folds are
crc32(doc_id) mod 4; fold 2 is held out.

Defined results: null and empty texts have zero features and get the score of such; rows with a
null doc_id are scored and never learnt from; labels other than 0 and 1 are left out; without
labels of both classes every score is the prior (0.5 without labels); repeated rows give
repeated results; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MIX_B, Cut, as_text, cut_words, mix, segment_sums, slices

WORD_SLOTS, SHAPE_SLOTS, DIM = 1 << 14, 1 << 10, 48
SLOTS = WORD_SLOTS + SHAPE_SLOTS
#: Non-zero entries of an index vector.
NONZERO = 2
#: Slots that travel in one row when tables are added up.
BLOCK = 1 << 10
#: First level of the tree: so many partial sums of each block at most.
FAN = 32
#: Labelled rows that the network and its temperature are fitted on, at most (the smallest by a hash of doc_id).
TRAINING_ROWS, CALIBRATION_ROWS = 20_000, 10_000
HIDDEN, STEPS = 24, 400

_CLASS = np.arange(256, dtype=np.uint64)
_CLASS[ord("a") : ord("z") + 1] = ord("a")
_CLASS[0x80:] = ord("a")
_CLASS[ord("A") : ord("Z") + 1] = ord("A")
_CLASS[ord("0") : ord("9") + 1] = ord("0")


def tokens(cut: Cut) -> tuple[np.ndarray, np.ndarray]:
    """Slot of each word, and of its shape."""
    hashes = cut.hashes()
    words = (hashes % np.uint64(WORD_SLOTS)).astype(np.int64)
    kind = _CLASS[cut.data]
    starts = cut.starts[:-1]
    new = np.ones(len(kind), bool)
    new[1:] = kind[1:] != kind[:-1]
    new[starts] = True
    rank = np.cumsum(new)
    rank = rank - np.repeat(rank[starts], np.diff(cut.starts)) if len(starts) else rank
    shape = mix(cut.sums(np.where(new, mix((rank.astype(np.uint64) << np.uint64(8) | kind) * MIX_B), np.uint64(0))))
    shapes = 1 + (shape % np.uint64(SHAPE_SLOTS - 1)).astype(np.int64)
    same = np.zeros(len(hashes), bool)
    same[1:] = hashes[1:] == hashes[:-1]
    same[cut.first[:-1][cut.first[:-1] < len(hashes)]] = False
    shapes[same] = 0
    return words, WORD_SLOTS + shapes


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the non-zero entries of each slot's index vector."""
    h = mix(np.arange(SLOTS * NONZERO, dtype=np.uint64) + np.uint64(1)).reshape(SLOTS, NONZERO)
    return (h % np.uint64(DIM)).astype(np.int64), np.where(h >> np.uint64(63), -1.0, 1.0)


def add_contexts(total: np.ndarray, cut: Cut) -> None:
    """Adds the index vectors of neighbours in each text to the flat table ``total``."""
    words, shapes = tokens(cut)
    if len(words) < 2:
        return
    places, signs = index_vectors()
    left = np.arange(len(words) - 1)
    inner = np.ones(len(left), bool)
    ends = cut.first[1:-1]
    inner[ends[(ends > 0) & (ends < len(words))] - 1] = False  # the neighbours belong to two texts
    left = left[inner]
    for here, there in ((left, left + 1), (left + 1, left)):
        for centre in (words[here] * DIM, shapes[here] * DIM):
            for context in (words[there], shapes[there]):
                for j in range(NONZERO):
                    total += np.bincount(centre + places[context, j], weights=signs[context, j], minlength=SLOTS * DIM)


def context_table(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Context vectors of all slots over all documents: partial tables, then a tree of sums."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros(SLOTS * DIM)
        for batch in slices(batches, "_text"):
            add_contexts(total, cut_words(as_text(batch.column("_text"))))
        yield from blocks(total, TaskContext.get().partitionId() % FAN)

    def blocks(total: np.ndarray, branch: int) -> Iterator[pa.RecordBatch]:
        parts = total.astype("<i8").reshape(SLOTS // BLOCK, -1)
        used = np.flatnonzero(parts.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array([branch] * len(used), pa.int64()), pa.array([parts[b].tobytes() for b in used], pa.binary())], ["block", "branch", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for b, branch, sums in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                value = np.frombuffer(sums, "<i8")
                held[b, branch] = held[b, branch] + value if (b, branch) in held else value
        keys = list(held)
        yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in keys], pa.int64()) for i in (0, 1)] + [pa.array([held[k].tobytes() for k in keys], pa.binary())], ["block", "branch", "sums"])

    schema = "block long, branch long, sums binary"
    first = docs.select(docs[text_col].alias("_text")).mapInArrow(partial, schema)
    level = first.repartition("block", "branch").mapInArrow(add, schema)
    level = level.select("block", (F.col("branch") * 0).alias("branch"), "sums").repartition("block").mapInArrow(add, schema)
    total = np.zeros((SLOTS // BLOCK, BLOCK * DIM))
    for row in level.collect():  # SLOTS / BLOCK rows
        total[row.block] = np.frombuffer(row.sums, "<i8")
    return total.reshape(SLOTS, DIM)


@dataclass
class Model:
    vectors: np.ndarray  # unit context vectors
    centre: np.ndarray | None = None
    scale: np.ndarray | None = None
    layers: tuple | None = None
    temperature: float = 1.0
    prior: float = 0.0

    def features(self, texts: pa.StringArray) -> np.ndarray:
        """Mean unit vectors of words and of shapes, and the lengths of both means."""
        cut = cut_words(texts)
        words, shapes = tokens(cut)
        n, parts = np.maximum(np.diff(cut.first), 1)[:, None], []
        for slots in (words, shapes):
            out, row = np.zeros((len(texts), DIM)), 0
            while row < len(texts):  # some texts at a time, to bound the gathered rows
                last = max(row + 1, int(np.searchsorted(cut.first, cut.first[row] + 100_000, side="right")) - 1)
                first = cut.first[row : last + 1]
                out[row:last] = segment_sums(self.vectors[slots[first[0] : first[-1]]], first - first[0])
                row = last
            parts.append(out / n)
        return np.concatenate([*parts, *(np.linalg.norm(p, axis=1)[:, None] for p in parts)], axis=1)

    def logits(self, x: np.ndarray) -> np.ndarray:
        if self.layers is None:
            return np.full(len(x), self.prior)
        w1, b1, w2, b2 = self.layers
        return (np.tanh((x - self.centre) / self.scale @ w1 + b1) @ w2 + b2) / self.temperature

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -30, 30)))

    def fit(self, x: np.ndarray, y: np.ndarray) -> None:
        """Adam over the whole sample, with weight decay."""
        if not len(y) or y.min() == y.max():
            prior = (y.sum() + 0.5) / (len(y) + 1)
            self.prior = float(np.log(prior / (1 - prior)))
            return
        self.centre, self.scale = x.mean(0), x.std(0) + 1e-6
        z, rng = (x - self.centre) / self.scale, np.random.default_rng(7)
        p = [rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
        for t in range(1, STEPS + 1):
            h = np.tanh(z @ p[0] + p[1])
            d = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - y) / len(y)
            dh = np.outer(d, p[2]) * (1 - h * h)
            for i, g in enumerate((z.T @ dh + 1e-3 * p[0], dh.sum(0), h.T @ d + 1e-3 * p[2], d.sum(keepdims=True))):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                p[i] = p[i] - 0.02 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        self.layers = tuple(p)

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """The temperature of the least log loss."""
        if self.layers is None or not len(y):
            return
        raw = self.logits(x)
        grid = np.exp(np.linspace(np.log(0.2), np.log(8), 75))
        loss = [np.mean(np.logaddexp(0, -raw / t) * y + np.logaddexp(0, raw / t) * (1 - y)) for t in grid]
        self.temperature = float(grid[int(np.argmin(loss))])


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", text_col: str = "text", id_col: str = "doc_id") -> Model:
    """Vectors over all documents, then the network on a bounded sample of labelled rows."""
    table = context_table(docs, text_col)
    model = Model((table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-9)).astype(np.float32))
    fold = F.crc32(F.col("_id").cast("string").cast("binary")) % 4
    labelled = labels.select(labels[id_col].alias("_id"), labels[label_col].cast("int").alias("_y")).where("_id is not null and _y in (0, 1)").withColumn("_fold", fold)

    def sample(condition, n: int) -> DataFrame:
        return labelled.where(condition).orderBy(F.xxhash64("_id"), "_id", "_y").limit(n)

    chosen = sample(F.col("_fold") < 2, TRAINING_ROWS).unionByName(sample(F.col("_fold") == 3, CALIBRATION_ROWS))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            x = shared.value.features(as_text(batch.column("_text"))).astype("<f4")
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), batch.column("_y"), batch.column("_fold")], ["x", "y", "fold"])

    texts = docs.select(docs[id_col].alias("_id"), docs[text_col].alias("_text"))
    rows = texts.join(F.broadcast(chosen), "_id").select("_text", "_y", "_fold").mapInArrow(pool, "x binary, y int, fold long").toArrow()
    listed = sorted(zip(rows.column("x").to_pylist(), rows.column("y").to_pylist(), rows.column("fold").to_pylist(), strict=True))
    x = np.array([np.frombuffer(r[0], "<f4") for r in listed], float).reshape(len(listed), 2 * DIM + 2)
    y, part = np.array([r[1] for r in listed], float), np.array([r[2] for r in listed], int)
    model.fit(x[part < 2], y[part < 2])
    model.calibrate(x[part == 3], y[part == 3])
    return model


def score(docs: DataFrame, model: Model, keep: Sequence[str] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The ``keep`` columns of every row with its ``score``. No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            value = shared.value.probability(shared.value.features(as_text(batch.column("_text"))))
            yield pa.RecordBatch.from_arrays([batch.column("_kept"), pa.array(value)], ["_kept", "_score"])

    picked = docs.select(F.struct(*[docs[c] for c in keep]).alias("_kept"), docs[text_col].alias("_text"))
    out = picked.mapInArrow(run, f"_kept {picked.schema['_kept'].dataType.simpleString()}, _score double")
    return out.select("_kept.*", F.col("_score").alias("score"))
