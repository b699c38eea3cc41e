"""Language of whole texts by a bidirectional gated recurrent network over bytes, trained here by backpropagation through time.

Texts are read as UTF-8 in windows of ``WINDOW`` bytes. In every window one recurrent layer reads forwards and one
backwards; a softmax over both states labels each byte. The probabilities of all letter bytes of a text (ASCII letters
and bytes of other characters) are averaged: the largest mean is the score and its language the prediction.

The network is fitted in numpy on at most ``PER_LANGUAGE`` labelled texts a language, of which an excerpt of
``EXCERPT`` characters is drawn: a documented bound that doesn't grow with the table. Prediction reads every byte.

A null text or one without a letter is ``und`` with score 0, and so is every text if nothing labelled exists. With a
single label every text with a letter gets it. Repeated rows get the same result; null ids are kept; columns besides
id, text and (in training) lang are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from setforge.operators.ordinals import free_names

WINDOW, HIDDEN = 96, 8
PER_LANGUAGE, EXCERPT = 160, 384
STEPS, BATCH, RATE, SEED = 160, 96, 0.02, 7
UNKNOWN = "und"
#: Bytes that count for the pooled probabilities.
LETTER = np.array([chr(b).isalpha() if b < 128 else True for b in range(256)])


@dataclass
class Model:
    """inputs: (2, 256, 3H), the input weights and biases of each byte; recurrent: (2, H, 3H); out: (2H, K); bias: (K,)."""

    labels: list[str]
    inputs: np.ndarray
    recurrent: np.ndarray
    out: np.ndarray
    bias: np.ndarray


def _states(m: Model, x: np.ndarray, keep: bool = False):
    """Hidden states (2, T, N, H) over windows x (T, N); the second direction is in reading order. keep: the gates too."""
    t_max, n = x.shape
    hidden = m.recurrent.shape[1]
    order = np.stack([x, x[::-1]])
    h = np.zeros((2, n, hidden), np.float32)
    states = np.empty((2, t_max, n, hidden), np.float32)
    gates = np.empty((t_max, 4, 2, n, hidden), np.float32) if keep else None
    for t in range(t_max):
        g = np.stack([m.inputs[0].take(order[0, t], axis=0), m.inputs[1].take(order[1, t], axis=0)])
        a = h @ m.recurrent
        zr = np.tanh(g[..., : 2 * hidden] + a[..., : 2 * hidden])
        zr += 1
        zr *= 0.5
        z, r = zr[..., :hidden], zr[..., hidden:]
        u = a[..., 2 * hidden :]
        c = np.tanh(g[..., 2 * hidden :] + r * u)
        if keep:
            gates[t] = z, r, u, c
        h = c + z * (h - c)
        states[:, t] = h
    return (states, gates, order) if keep else states


def _probabilities(m: Model, states: np.ndarray) -> np.ndarray:
    """(T, N, K) of each byte."""
    both = np.concatenate([states[0], states[1][::-1]], axis=-1)
    p = both @ m.out
    p += m.bias
    p -= p.max(axis=-1, keepdims=True)
    np.exp(p, out=p)
    p /= p.sum(axis=-1, keepdims=True)
    return p


def _gradients(m: Model, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    """Of the mean cross entropy of all weighted bytes, back through every time step of both directions."""
    states, gates, order = _states(m, x, keep=True)
    t_max, n = x.shape
    hidden = m.recurrent.shape[1]
    p = _probabilities(m, states)
    p[:, np.arange(n), y] -= 1
    p *= (weight / max(1.0, weight.sum()))[..., None]
    both = np.concatenate([states[0], states[1][::-1]], axis=-1)
    d_out, d_bias = np.einsum("tnh,tnk->hk", both, p), p.sum(axis=(0, 1))
    d_both = p @ m.out.T
    d_states = np.stack([d_both[..., :hidden], d_both[::-1, :, hidden:]])
    d_in, d_rec = np.zeros_like(m.inputs), np.zeros_like(m.recurrent)
    d_h = np.zeros((2, n, hidden), np.float32)
    for t in range(t_max - 1, -1, -1):
        z, r, u, c = gates[t]
        before = states[:, t - 1] if t else np.zeros_like(d_h)
        d_h = d_h + d_states[:, t]
        d_c = d_h * (1 - z) * (1 - c * c)
        d_z = d_h * (before - c) * z * (1 - z) * 2  # the gates are (tanh + 1) / 2 of their sums
        d_r = d_c * u * r * (1 - r) * 2
        d_a = np.concatenate([d_z, d_r, d_c * r], axis=-1)
        d_g = np.concatenate([d_z, d_r, d_c], axis=-1)
        d_rec += before.transpose(0, 2, 1) @ d_a
        for k in (0, 1):
            np.add.at(d_in[k], order[k, t], d_g[k])
        d_h = d_h * z + d_a @ m.recurrent.transpose(0, 2, 1)
    return [d_in, d_rec, d_out, d_bias]


def _windows(text: bytes) -> np.ndarray:
    """A text's bytes as rows of WINDOW, the last one filled up with zeros."""
    n = -(-len(text) // WINDOW)
    out = np.zeros(n * WINDOW, np.uint8)
    out[: len(text)] = np.frombuffer(text, np.uint8)
    return out.reshape(n, WINDOW)


def fit(texts: list[str], labels: list[str], hidden: int = HIDDEN, steps: int = STEPS, seed: int = SEED) -> Model | None:
    """A network for the given excerpts; classes count alike, however many excerpts they have."""
    names = sorted(set(labels))
    if not names:
        return None
    rng = np.random.default_rng(seed)
    k = len(names)
    draw = lambda *shape: rng.normal(0, 0.3, shape).astype(np.float32)
    m = Model(names, draw(2, 256, 3 * hidden), draw(2, hidden, 3 * hidden), draw(2 * hidden, k), np.zeros(k, np.float32))
    rows = [(w, names.index(y)) for text, y in zip(texts, labels) for w in _windows(text.encode())]
    if k == 1 or not rows:
        return m
    x_all = np.array([r[0] for r in rows])
    y_all = np.array([r[1] for r in rows])
    of = [np.flatnonzero(y_all == c) for c in range(k)]
    weights = [m.inputs, m.recurrent, m.out, m.bias]
    mean, square = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for step in range(1, steps + 1):
        at = np.concatenate([rng.choice(i, -(-BATCH // k)) for i in of if len(i)])
        x, y = np.ascontiguousarray(x_all[at].T), y_all[at]
        grads = _gradients(m, x, y, LETTER[x].astype(np.float32))
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
        for w, g, a, b in zip(weights, grads, mean, square):
            g = g * min(1.0, 1.0 / max(norm, 1e-9))
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            w -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-6)
    return m


def predict(m: Model, texts: list[bytes], block: int = 2048) -> np.ndarray:
    """Mean probabilities (len(texts), K) over each text's letter bytes; zeros for a text without any."""
    pooled = np.zeros((len(texts), len(m.labels)))
    counts = np.zeros(len(texts))
    parts = [_windows(t) for t in texts]
    owner = np.repeat(np.arange(len(texts)), [len(p) for p in parts])
    rows = np.concatenate(parts) if len(owner) else np.zeros((0, WINDOW), np.uint8)
    for at in range(0, len(rows), block):
        x = np.ascontiguousarray(rows[at : at + block].T)
        p = _probabilities(m, _states(m, x))
        letter = LETTER[x]
        p *= letter[..., None]
        np.add.at(pooled, owner[at : at + block], p.sum(axis=0))
        np.add.at(counts, owner[at : at + block], letter.sum(axis=0))
    return pooled / np.maximum(counts, 1)[:, None]


def sample(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> tuple[list[str], list[str]]:
    """Excerpts and labels of at most ``per_language`` different texts a language, chosen by a hash of the text.

    A first pass counts each language's different texts, as far as a sketch does; a second keeps about three times what
    is needed by the hash alone, so that the ordering sees few rows, however many rows or copies one language has.
    """
    rows = labelled.filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = {r[0]: max(1, r[1]) for r in rows.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text"))).collect()}  # a row a language
    if not counts:
        return [], []
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, min(1.0, 3 * per_language / n)).otherwise(share)
    h = F.xxhash64("text")
    at = F.pmod(F.xxhash64(F.lit(1), F.col("text")), F.greatest(F.lit(1), F.length("text") - EXCERPT)).cast("int") + 1
    few = rows.select("lang", h.alias("h"), F.substring(F.col("text"), at, F.lit(EXCERPT)).alias("part")).filter(F.pmod("h", F.lit(1 << 20)) < share * (1 << 20)).distinct()
    first = few.withColumn("k", F.row_number().over(W.partitionBy("lang").orderBy("h", "part"))).filter(F.col("k") <= per_language)
    got = sorted((r["lang"], r["h"], r["part"]) for r in first.collect())
    return [r[2] for r in got], [r[0] for r in got]


def train(labelled: DataFrame) -> Model | None:
    """A model from a table with text and lang."""
    return fit(*sample(labelled))


def identify(docs: DataFrame, model: Model | None, text_col: str = "text", keep: list[str] | None = None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns ``keep`` of ``docs`` with the prediction and its score under ``names``; give others where those clash."""
    keep = docs.columns if keep is None else keep
    own = free_names([*keep, *names], "__bytes")[0]
    kept = docs.select(*[F.col(f"`{c}`") for c in keep], F.when(F.col(text_col).rlike(r"\p{L}"), F.col(text_col).cast("binary")).alias(own))
    schema = kept.drop(own).schema.add(names[0], "string").add(names[1], "double")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model | None = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                batch = whole.slice(at, 128)
                texts = batch.column(batch.num_columns - 1).to_pylist()
                found, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
                some = [k for k, t in enumerate(texts) if t] if m else []
                if some:
                    p = predict(m, [texts[k] for k in some])
                    for k, row in zip(some, p):
                        best = int(row.argmax())
                        found[k], scores[k] = m.labels[best], float(min(1.0, row[best]))
                cols = [*batch.columns[:-1], pa.array(found, pa.string()), pa.array(scores, pa.float64())]
                yield pa.RecordBatch.from_arrays(cols, names=[*batch.schema.names[:-1], *names])

    return kept.mapInArrow(run, schema)


def fold(id_col: str = "doc_id"):
    """crc32 of the id's text, modulo 3; documents at 1 are held out."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3))


def report(docs: DataFrame) -> DataFrame:
    """Predictions for all of ``documents``, learned from those that aren't held out. A null id isn't held out."""
    held_out = F.coalesce(fold() == 1, F.lit(False))
    model = train(docs.filter(~held_out).select("text", "lang"))
    return identify(docs, model, keep=["doc_id"]).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
