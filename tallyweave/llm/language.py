"""Language identification by a bidirectional gated recurrent network over bytes.

A text is cut into windows of ``WINDOW`` bytes. Two small gated networks read each window, one in each direction,
and their states at a byte give the probabilities of the languages there. A document's probabilities are the mean
over its bytes that may belong to letters. Training is backpropagation through time in numpy, on a bounded
number of windows per language (``Training.windows``); scoring reads every byte of every text, many windows
at a time.

Gates use piecewise linear curves, clip(x / 4 + 1/2, 0, 1) for the logistic and clip(x, -1, 1) for tanh.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; without training rows so is every
text; rows with null lang are not learned from; repeated rows are scored each; an empty table gives an empty result;
other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.llm import textcols
from tallyweave.llm.frames import map_arrow

WINDOW = 64
HIDDEN = 8
#: Fills the last window of a text.
PAD = 256
UNKNOWN = "und"
#: Bytes that may belong to a letter: those of a-z, A-Z and of all characters beyond ASCII.
LETTER = np.zeros(257, dtype=bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:256] = True


@dataclass(frozen=True)
class Training:
    """windows bounds the training windows per language."""

    windows: int = 1500
    batch: int = 128
    steps: int = 400
    rate: float = 0.01
    seed: int = 3


@dataclass
class Network:
    """Per direction: input rows of the gates (reset, update, candidate) by byte, recurrent weights, output weights."""

    langs: list[str]
    given: list[np.ndarray]  # 257 x 3H
    inner: list[np.ndarray]  # H x 3H
    outer: list[np.ndarray]  # H x L
    bias: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))

    @classmethod
    def fresh(cls, langs: list[str], seed: int) -> Network:
        draw = np.random.default_rng(seed)

        def table(n: int, m: int, scale: float) -> np.ndarray:
            return (draw.standard_normal((n, m)) * scale).astype(np.float32)

        h, n = HIDDEN, len(langs)
        return cls(
            langs,
            [table(257, 3 * h, 0.3) for _ in range(2)],
            [table(h, 3 * h, 0.5 / np.sqrt(h)) for _ in range(2)],
            [table(h, n, 1 / np.sqrt(h)) for _ in range(2)],
            np.zeros(n, dtype=np.float32),
        )

    def parameters(self) -> list[np.ndarray]:
        return [*self.given, *self.inner, *self.outer, self.bias]


def run_direction(given: np.ndarray, inner: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """States (time, windows, H) for ``codes`` (time, windows)."""
    steps, n = codes.shape
    h = HIDDEN
    states = np.empty((steps, n, h), dtype=np.float32)
    state = np.zeros((n, h), dtype=np.float32)
    gates, rest = np.empty((n, 2 * h), np.float32), np.empty((n, h), np.float32)
    to_gates, to_candidate = np.ascontiguousarray(inner[:, : 2 * h]), np.ascontiguousarray(inner[:, 2 * h :])
    # The logistic's slope and middle go into the tables once.
    table = given.copy()
    table[:, : 2 * h] = table[:, : 2 * h] * 0.25 + 0.5
    to_gates = to_gates * np.float32(0.25)
    for t in range(steps):
        x = table[codes[t]]
        np.matmul(state, to_gates, out=gates)
        gates += x[:, : 2 * h]
        np.clip(gates, 0, 1, out=gates)
        reset, update = gates[:, :h], gates[:, h:]
        reset *= state
        np.matmul(reset, to_candidate, out=rest)
        rest += x[:, 2 * h :]
        np.clip(rest, -1, 1, out=rest)
        # state + update * (candidate - state)
        rest -= state
        rest *= update
        state = np.add(state, rest, out=states[t])
    return states


def probabilities(net: Network, codes: np.ndarray) -> np.ndarray:
    """(time, windows, L)."""
    ahead = run_direction(net.given[0], net.inner[0], codes)
    back = run_direction(net.given[1], net.inner[1], codes[::-1])[::-1]
    logits = ahead @ net.outer[0]
    logits += back @ net.outer[1]
    logits += net.bias
    logits -= logits.max(axis=2, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=2, keepdims=True)
    return logits


def _forward_kept(given: np.ndarray, inner: np.ndarray, codes: np.ndarray) -> tuple:
    """As ``run_direction``, with all that the way back needs."""
    steps, n = codes.shape
    h = HIDDEN
    states = np.zeros((steps + 1, n, h), np.float32)
    raw, gates, cands = (np.empty((steps, n, k), np.float32) for k in (3 * h, 2 * h, h))
    for t in range(steps):
        s = states[t]
        raw[t] = given[codes[t]]
        raw[t, :, : 2 * h] += s @ inner[:, : 2 * h]
        gates[t] = np.clip(raw[t, :, : 2 * h] * 0.25 + 0.5, 0, 1)
        raw[t, :, 2 * h :] += (gates[t, :, :h] * s) @ inner[:, 2 * h :]
        cands[t] = np.clip(raw[t, :, 2 * h :], -1, 1)
        z = gates[t, :, h:]
        states[t + 1] = s + z * (cands[t] - s)
    return states, raw, gates, cands


def _backward(inner: np.ndarray, codes: np.ndarray, kept: tuple, d_states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of (given, inner) from those of the states."""
    states, raw, gates, cands = kept
    steps, n = codes.shape
    h = HIDDEN
    d_given, d_inner = np.zeros((257, 3 * h), np.float32), np.zeros_like(inner)
    carry = np.zeros((n, h), np.float32)
    d_raw = np.empty((steps, n, 3 * h), np.float32)
    for t in range(steps - 1, -1, -1):
        d = d_states[t] + carry
        s, r, z = states[t], gates[t, :, :h], gates[t, :, h:]
        d_z = d * (cands[t] - s)
        d_c = d * z * (np.abs(raw[t, :, 2 * h :]) < 1)
        carry = d * (1 - z)
        d_rs = d_c @ inner[:, 2 * h :].T
        d_inner[:, 2 * h :] += (r * s).T @ d_c
        carry += d_rs * r
        live = np.abs(raw[t, :, : 2 * h]) < 2
        d_g = np.concatenate([d_rs * s, d_z], axis=1) * 0.25 * live
        d_inner[:, : 2 * h] += s.T @ d_g
        carry += d_g @ inner[:, : 2 * h].T
        d_raw[t, :, : 2 * h], d_raw[t, :, 2 * h :] = d_g, d_c
    np.add.at(d_given, codes.ravel(), d_raw.reshape(-1, 3 * h))
    return d_given, d_inner


def gradients(net: Network, codes: np.ndarray, labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """(mean cross entropy over the letter positions, gradients in the order of ``parameters``)."""
    turned = codes[::-1]
    ahead = _forward_kept(net.given[0], net.inner[0], codes)
    back = _forward_kept(net.given[1], net.inner[1], turned)
    h_ahead, h_back = ahead[0][1:], back[0][1:][::-1]
    logits = h_ahead @ net.outer[0] + h_back @ net.outer[1] + net.bias
    logits -= logits.max(axis=2, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(axis=2, keepdims=True)
    weight = LETTER[codes].astype(np.float32)
    weight /= max(weight.sum(), 1)
    at = np.arange(codes.shape[1])
    loss = float(-(np.log(np.maximum(p[:, at, labels], 1e-9)) * weight).sum())
    d = p
    d[:, at, labels] -= 1
    d *= weight[:, :, None]
    n = d.shape[2]
    flat = d.reshape(-1, n)
    d_outer = [h_ahead.reshape(-1, HIDDEN).T @ flat, h_back.reshape(-1, HIDDEN).T @ flat]
    one = _backward(net.inner[0], codes, ahead, d @ net.outer[0].T)
    two = _backward(net.inner[1], turned, back, (d @ net.outer[1].T)[::-1])
    return loss, [one[0], two[0], one[1], two[1], *d_outer, flat.sum(axis=0)]


def train(langs: list[str], codes: np.ndarray, labels: np.ndarray, training: Training) -> Network:
    """Adam on random batches of windows; codes: (windows, WINDOW)."""
    net = Network.fresh(langs, training.seed)
    draw = np.random.default_rng(training.seed)
    first = [np.zeros_like(p) for p in net.parameters()]
    second = [np.zeros_like(p) for p in net.parameters()]
    for step in range(1, training.steps + 1):
        rows = draw.integers(0, len(codes), training.batch)
        _, found = gradients(net, np.ascontiguousarray(codes[rows].T), labels[rows])
        norm = np.sqrt(sum(float((g * g).sum()) for g in found))
        rate = training.rate * (1 - 0.9 * step / training.steps)
        for p, g, m, v in zip(net.parameters(), found, first, second):
            g = g * min(1.0, 1.0 / max(norm, 1e-9))
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return net


def fit(docs: DataFrame, held_out: Column, training: Training = Training()) -> Network | None:
    """Learn from a window of each of at most ``windows`` documents per language, chosen and placed by a hash."""
    rows = docs.where(~held_out & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("doc_id", "lang", "text")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row per language
    if not counts:
        return None
    langs = sorted(counts)
    share = F.create_map(*[x for lang in langs for x in (F.lit(lang), F.lit(training.windows / counts[lang]))])
    draw = F.pmod(F.xxhash64(F.lit(training.seed), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    chosen = rows.where(draw < share[F.col("lang")])
    room = F.greatest(F.char_length("text") - WINDOW, F.lit(0)) + 1
    place = F.pmod(F.xxhash64(F.lit("place"), "doc_id"), room).cast("int") + 1
    found = chosen.select("doc_id", "lang", F.substring("text", place, F.lit(WINDOW)).alias("part")).toArrow()
    order = np.argsort(np.array(found["doc_id"].cast(pa.string()).to_pylist(), dtype=object).astype(str), kind="stable")
    codes, labels = np.full((len(order), WINDOW), PAD, dtype=np.int64), np.zeros(len(order), dtype=np.int64)
    parts, names = found["part"].to_pylist(), found["lang"].to_pylist()
    for k, i in enumerate(order):
        data = parts[i].encode()[:WINDOW]
        codes[k, : len(data)] = np.frombuffer(data, dtype=np.uint8)
        labels[k] = langs.index(names[i])
    return train(langs, codes, labels, training)


#: Windows that are read together.
TOGETHER = 2048


def pooled(net: Network, column: pa.Array) -> np.ndarray:
    """Probabilities (rows, L) of a slice of texts; 0 for a row without letter bytes."""
    data, offsets = textcols.joined(column)
    sizes = np.diff(offsets)
    per_row = -(-sizes // WINDOW)
    rows = np.repeat(np.arange(len(column)), per_row)
    first = np.cumsum(per_row) - per_row
    start = offsets[:-1][rows] + (np.arange(len(rows)) - first[rows]) * WINDOW
    total, letters = np.zeros((len(column), len(net.langs))), np.zeros(len(column))
    padded = np.concatenate([data, np.zeros(WINDOW, dtype=np.uint8)])
    for k in range(0, len(rows), TOGETHER):
        mine, at = rows[k : k + TOGETHER], start[k : k + TOGETHER]
        codes = padded[at[None, :] + np.arange(WINDOW)[:, None]].astype(np.int64)
        codes[at[None, :] + np.arange(WINDOW)[:, None] >= offsets[1:][mine][None, :]] = PAD
        p = probabilities(net, codes)
        mask = LETTER[codes]
        p *= mask[:, :, None]
        by_window = p.sum(axis=0)
        for j in range(len(net.langs)):
            total[:, j] += np.bincount(mine, by_window[:, j], minlength=len(column))
        letters += np.bincount(mine, mask.sum(axis=0), minlength=len(column))
    return total / np.maximum(letters, 1)[:, None]


def identify(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, lang_pred and score of every document."""
    ids = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letter"))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        letter = np.asarray(batch.column(2))
        score = np.zeros(batch.num_rows)
        lang = np.full(batch.num_rows, UNKNOWN, dtype=object)
        if net is not None:
            p = np.concatenate([pooled(net, part) for _, part in textcols.slices(batch.column(1))])
            best = p.argmax(axis=1)
            lang = np.where(letter, np.array(net.langs, dtype=object)[best], UNKNOWN)
            score = np.where(letter, np.clip(p[np.arange(len(p)), best], 0, 1), 0.0)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(lang.tolist(), pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"]
        )

    return map_arrow(rows, run, f"doc_id {ids}, lang_pred string, score double")
