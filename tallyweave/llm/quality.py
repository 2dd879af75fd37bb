"""Quality classifier: naive Bayes log-count ratios inside a support vector machine.

A text is the set of n-grams it holds: its words, and runs of one to three word shapes (case, last sign,
and whether a word repeats the one before it), hashed into ``DIMENSIONS`` features. Class counts of every
feature are summed over all labelled training documents, and their smoothed log ratio scales the indicators.
A linear hinge-loss model is fitted to the scaled vectors by dual coordinate descent, on at most
``sample_rows`` training documents chosen by a hash; a part of these is kept aside to turn margins into
probabilities.

Texts are read once: their features are stored, and training and scoring start from there. Labels, an id and a number
each, are broadcast to the features up to ``LABELS`` of them; beyond that both are shuffled by id.

Defined cases: a null text is an empty one and gets the score of a text without features; labels that are null, or that
differ for one id, are left out (equal ones count once); rows with one id are scored each by its own text; without
labels of both classes every score is the share of label 1 among the labels, or 0.5 without any; an empty table
gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.llm import textcols
from tallyweave.llm.frames import bounded, id_text, map_arrow, map_batches
from tallyweave.session import stored

BITS = 18
DIMENSIONS = 1 << BITS
#: Labels up to which they are broadcast.
LABELS = 500_000


@dataclass(frozen=True)
class Training:
    """sample_rows bounds the documents that the hinge-loss model sees; min_docs is the number of training documents
    a feature must stand in; blend is the share of the fitted weights against their mean magnitude."""

    sample_rows: int = 20_000
    min_docs: int = 5
    cost: float = 1.0
    epochs: int = 12
    blend: float = 0.25
    seed: int = 7


def shapes(found: textcols.Words, hashes: np.ndarray) -> np.ndarray:
    """A small number per word: its case, the kind of its last sign, whether it repeats the word before."""
    data = found.data
    lead = np.empty_like(data)
    lead[:1] = 0
    lead[1:] = data[:-1]
    accented = lead == 0xC3
    upper = ((data >= 65) & (data <= 90)) | (accented & (data >= 0x80) & (data <= 0x9E))
    lower = ((data >= 97) & (data <= 122)) | (accented & (data > 0x9E))

    def inside(marks: np.ndarray) -> np.ndarray:
        total = np.zeros(len(marks) + 1, dtype=np.int32)
        np.cumsum(marks, out=total[1:])
        return total[found.ends] - total[found.starts]

    n_upper, n_lower = inside(upper), inside(lower)
    starts_upper = upper[found.starts] | ((data[found.starts] == 0xC3) & upper[np.minimum(found.starts + 1, len(data) - 1)])
    case = np.select(
        [(n_upper == 0) & (n_lower == 0), n_upper == 0, (n_lower == 0) & (n_upper > 1), (n_upper == 1) & starts_upper],
        [0, 1, 2, 3],
        4,
    )
    last = data[found.ends - 1]
    kinds = np.full(256, 5, dtype=np.int64)
    kinds[65:91] = kinds[97:123] = kinds[128:] = 0
    kinds[48:58] = 1
    kinds[list(b".;:")] = 2
    kinds[list(b",)")] = 3
    kinds[list(b"!?")] = 4
    same = np.zeros(len(hashes), dtype=np.int64)
    same[1:] = (hashes[1:] == hashes[:-1]) & (found.rows[1:] == found.rows[:-1])
    return (case * 6 + kinds[last]) * 2 + same


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(feature ids of all rows, rising in a row; n + 1 bounds of the rows)."""
    found = textcols.words(column)
    n = len(column)
    if not len(found.starts):
        return np.zeros(0, dtype=np.int32), np.zeros(n + 1, dtype=np.int64)
    prefix = textcols.prefix_hash(textcols.byte_values(fold_ascii=True)[found.data])
    hashes = textcols.span_hash(prefix, found.starts, found.ends)
    shape = textcols.mix(shapes(found, hashes).astype(np.uint64) + np.uint64(1))
    keys = [(hashes, found.rows)]
    for width in (1, 2, 3):
        grams, at = textcols.windows(shape, found.rows, width, seed=width)
        keys.append((grams, found.rows[at]))
    ids = [(rows.astype(np.int64) << BITS) | (h >> np.uint64(64 - BITS)).astype(np.int64) for h, rows in keys]
    every = np.unique(np.concatenate(ids))
    return (every & (DIMENSIONS - 1)).astype(np.int32), np.searchsorted(every, np.arange(n + 1, dtype=np.int64) << BITS)


def featured(docs: DataFrame) -> DataFrame:
    """doc_id and the features of its text, as packed 32-bit numbers."""
    ids = docs.schema["doc_id"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        packed: list[bytes] = []
        for _, part in textcols.slices(batch.column(1)):
            found, bounds = features(part)
            packed += [found[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["doc_id", "features"])

    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id {ids}, features binary")


def class_counts(rows: DataFrame, min_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents of class 1, of class 0) by feature, over all rows (quality, features)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, DIMENSIONS), dtype=np.int64)
        for batch in batches:
            quality = np.asarray(batch.column(0))
            packed = batch.column(1).to_pylist()
            for label in (0, 1):
                mine = b"".join(p for p, q in zip(packed, quality) if q == label)
                total[label] += np.bincount(np.frombuffer(mine, dtype=np.int32), minlength=DIMENSIONS)
        at = np.flatnonzero(total.any(axis=0))
        if len(at):
            yield pa.RecordBatch.from_arrays(
                [pa.array(at.astype(np.int32)), pa.array(total[1][at]), pa.array(total[0][at])], names=["feature", "good", "bad"]
            )

    summed = map_batches(rows.select("quality", "features"), count, "feature int, good bigint, bad bigint")
    summed = summed.groupBy("feature").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    good, bad = np.zeros(DIMENSIONS), np.zeros(DIMENSIONS)
    found = summed.where(F.col("good") + F.col("bad") >= min_docs).toArrow()  # at most DIMENSIONS rows
    at = np.asarray(found["feature"])
    good[at], bad[at] = np.asarray(found["good"]), np.asarray(found["bad"])
    return good, bad


def log_ratios(good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    p, q = good + 1, bad + 1
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    ratio[good + bad == 0] = 0
    return ratio


def dual_descent(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, size: int, cost: float, epochs: int, seed: int) -> np.ndarray:
    """Weights (the last one the bias) of the linear model with the least hinge loss: one dual variable at a time
    is moved to its optimum within [0, cost], in a new random order each epoch."""
    weights, alpha = np.zeros(size + 1), np.zeros(len(rows))
    norms = np.array([1.0 + v @ v for _, v in rows])
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        largest = 0.0
        for i in order.permutation(len(rows)):
            at, values = rows[i]
            gradient = y[i] * (weights[at] @ values + weights[size]) - 1
            new = min(max(alpha[i] - gradient / norms[i], 0.0), cost)
            step = (new - alpha[i]) * y[i]
            if step:
                weights[at] += step * values
                weights[size] += step
                largest = max(largest, abs(step))
                alpha[i] = new
        if largest < 1e-3:
            break
    return weights


def fit_sigmoid(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """(a, b) such that 1 / (1 + exp(-(a m + b))) is the likeliest, by Newton steps on smoothed labels."""
    good, bad = labels.sum(), (1 - labels).sum()
    aim = np.where(labels == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        g = np.array([((p - aim) * margins).sum() + 1e-3 * (a - 1), (p - aim).sum()])
        w = p * (1 - p)
        h = np.array([[(w * margins * margins).sum() + 1e-3, (w * margins).sum()], [(w * margins).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = max(a - step[0], 1e-3), b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(a), float(b)


@dataclass
class Model:
    """Margin = (sum of weights of the features) / sqrt(sum of their squared ratios) + bias, then the sigmoid."""

    weights: np.ndarray
    squares: np.ndarray
    bias: float
    slope: float
    shift: float

    def score(self, packed: list[bytes]) -> np.ndarray:
        sizes = np.array([len(p) // 4 for p in packed])
        flat = np.frombuffer(b"".join(packed), dtype=np.int32)
        rows = np.repeat(np.arange(len(packed)), sizes)
        total = np.bincount(rows, self.weights[flat], minlength=len(packed))
        norm = np.sqrt(np.bincount(rows, self.squares[flat], minlength=len(packed)))
        margin = total / np.where(norm > 0, norm, 1) + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -30, 30)))


def weighed(features: pa.Array, ratio: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(features that have a ratio, their ratios at unit length) of every row, as parts of two arrays."""
    features = features.cast(pa.large_binary())
    flat = np.frombuffer(features.buffers()[2] or b"", dtype=np.int32)
    offsets = np.frombuffer(features.buffers()[1], dtype=np.int64)[features.offset : features.offset + len(features) + 1] // 4
    kept = ratio[flat] != 0
    ends = np.concatenate([[0], np.cumsum(kept)])[offsets]
    at = flat[kept]
    values = ratio[at]
    out = []
    for start, stop in zip(ends, ends[1:]):
        part = values[start:stop]
        part /= max(np.sqrt(part @ part), 1e-12)
        out.append((at[start:stop], part))
    return out


def fit(rows: DataFrame, training: Training) -> Model:
    """From (doc_id, quality, features) of all training documents."""
    counts = {r["quality"]: r["count"] for r in rows.groupBy("quality").count().collect()}
    total = sum(counts.values())
    if len(counts) < 2:
        share = min(max(counts.get(1, 0) / total if total else 0.5, 1e-6), 1 - 1e-6)
        return Model(np.zeros(DIMENSIONS, np.float32), np.zeros(DIMENSIONS, np.float32), 0.0, 1.0, float(np.log(share / (1 - share))))
    ratio = log_ratios(*class_counts(rows, training.min_docs))
    draw = F.pmod(F.xxhash64(F.lit(training.seed), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.where(draw < training.sample_rows / total).select("doc_id", "quality", "features").toArrow()
    order = np.argsort(np.asarray(sample["doc_id"].cast(pa.string()), dtype=object).astype(str), kind="stable")
    y = np.where(np.asarray(sample["quality"])[order] == 1, 1.0, -1.0)
    vectors = weighed(sample["features"].combine_chunks().take(pa.array(order)), ratio)
    del sample
    pa.default_memory_pool().release_unused()
    aside = np.arange(len(vectors)) % 5 == 0
    seen = [v for v, a in zip(vectors, aside) if not a]
    weights = dual_descent(seen, y[~aside], DIMENSIONS, training.cost, training.epochs, training.seed)
    bias = weights[DIMENSIONS]
    weights = weights[:DIMENSIONS]
    active = weights != 0
    mean = np.abs(weights[active]).mean() if active.any() else 0.0
    # The published interpolation, on the features the model has met.
    weights = np.where(active, (1 - training.blend) * mean * np.sign(weights) + training.blend * weights, 0.0)
    model = Model((weights * ratio).astype(np.float32), (ratio * ratio).astype(np.float32), float(bias), 1.0, 0.0)
    margins = np.array([(weights[at] @ v) + bias for (at, v), a in zip(vectors, aside) if a])
    labels = (y[aside] + 1) / 2
    if len(margins) and 0 < labels.sum() < len(labels):
        model.slope, model.shift = fit_sigmoid(margins, labels)
    return model


def known_labels(labels: DataFrame, name: str) -> DataFrame:
    """One row per id whose labels agree."""
    rows = labels.where(F.col(name).isin(0, 1)).groupBy("doc_id").agg(F.min(name).alias("a"), F.max(name).alias("b"))
    return rows.where("a = b").select(F.col("doc_id").alias("l_id"), F.col("a").cast("int").alias("quality"))


def classify(docs: DataFrame, labels: DataFrame, held_out: Column, training: Training = Training()) -> DataFrame:
    """doc_id, held_out and score of every document. ``held_out``: a condition on doc_id, of rows never learned from."""
    rows = stored(featured(docs), "features")
    wanted = known_labels(labels, "quality")
    train = rows.where(~held_out).join(bounded(wanted, wanted.count(), LABELS), F.col("doc_id") == F.col("l_id"))
    model = fit(train.select("doc_id", "quality", "features"), training)
    return scored(rows, model).withColumn("held_out", held_out).select("doc_id", "held_out", "score")


def scored(rows: DataFrame, model: Model) -> DataFrame:
    """doc_id and score from stored features."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(model.score(batch.column(1).to_pylist()))], names=["doc_id", "score"]
        )

    ids = rows.schema["doc_id"].dataType.simpleString()
    return map_arrow(rows.select("doc_id", "features"), run, f"doc_id {ids}, score double")


def trained(docs: DataFrame, labels: DataFrame, held_out: Column, training: Training = Training()) -> Model:
    """The model alone, from the labelled documents."""
    wanted = known_labels(labels, "quality")
    n = wanted.count()
    rows = docs.where(~held_out).select("doc_id", "text")
    if n <= LABELS:
        rows = rows.join(F.broadcast(wanted.select("l_id")), F.col("doc_id") == F.col("l_id"), "left_semi")
    train = featured(rows).join(bounded(wanted, n, LABELS), F.col("doc_id") == F.col("l_id"))
    return fit(stored(train.select("doc_id", "quality", "features"), "training"), training)


def with_score(docs: DataFrame, model: Model, name: str) -> DataFrame:
    """``docs`` with a column of scores, in one pass over the texts."""
    place, names = docs.columns.index("text"), [*docs.columns, name]

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found: list[np.ndarray] = []
        for _, part in textcols.slices(batch.column(place)):
            ids, bounds = features(part)
            found.append(model.score([ids[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(found))], names=names)

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return map_arrow(docs, run, f"{ddl}, `{name}` double")


def remainder(divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``."""
    return F.crc32(id_text("doc_id")) % divisor
