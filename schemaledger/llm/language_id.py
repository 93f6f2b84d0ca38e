"""Language ID: a bidirectional gated recurrent network over bytes, in numpy.

Every byte of a text is a position. Two GRU layers read a segment of positions forwards and backwards; a linear layer
and a softmax over both states label every position, and a document's probabilities are the mean of its positions'.
Training is backpropagation through time with Adam, on the driver, over a bounded sample of labelled segments whose
size is a parameter; the model is a few kilobytes. Prediction reads whole texts, in segments, many at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

SEGMENT = 96            # positions that a pass reads without a break
STATES = 8              # states of each direction
SAMPLE_DOCS = 3_000     # labelled documents that training takes at most
SAMPLE_SEGMENTS = 6     # segments of one of them at most, evenly spread over the whole text
STEPS, BATCH, RATE = 260, 96, 0.03
_COLUMNS = 4_096        # segments of one prediction pass
UNKNOWN = "und"


def _gates(a: np.ndarray, h: np.ndarray, u: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, ...]:
    """One GRU step, feature by segment: update gate, reset gate, recurrent part, new state, state."""
    k = STATES
    rec = u @ h
    zr = np.tanh(0.5 * (a[: 2 * k] + rec[: 2 * k])) * np.float32(0.5) + np.float32(0.5)
    part = rec[2 * k:] + bias
    new = np.tanh(a[2 * k:] + zr[k:] * part)
    return zr[:k], zr[k:], part, new, new + zr[:k] * (h - new)


@dataclass
class Model:
    """``tables``: input weights of each byte, ``u``: recurrent weights, ``c``: bias of the recurrent part; one of each direction."""

    languages: list[str]
    tables: list[np.ndarray]
    u: list[np.ndarray]
    c: list[np.ndarray]
    out: np.ndarray
    bias: np.ndarray

    @staticmethod
    def fresh(languages: list[str], seed: int) -> "Model":
        rng = np.random.default_rng(seed)
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        k = STATES
        return Model(
            languages, [draw(3 * k, 256, scale=0.3) for _ in range(2)], [draw(3 * k, k, scale=k**-0.5) for _ in range(2)],
            [np.zeros((k, 1), np.float32) for _ in range(2)], draw(len(languages), 2 * k, scale=0.2), np.zeros((len(languages), 1), np.float32),
        )

    def weights(self) -> list[np.ndarray]:
        return [*self.tables, *self.u, *self.c, self.out, self.bias]

    def probabilities(self, states: np.ndarray) -> np.ndarray:
        """Softmax over the languages: states (both directions) by position."""
        score = self.out @ states + self.bias
        score = np.exp(score - score.max(0))
        return score / score.sum(0)

    def segment_sums(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Sum over the positions of each segment of the position probabilities: ``x`` and ``mask`` are position by segment."""
        t, n = x.shape
        back = np.empty((t, STATES, n), np.float32)
        h = np.zeros((STATES, n), np.float32)
        for i in range(t - 1, -1, -1):
            h = _gates(np.take(self.tables[1], x[i], axis=1), h, self.u[1], self.c[1])[-1] * mask[i]
            back[i] = h
        total, h = np.zeros((len(self.languages), n), np.float32), np.zeros((STATES, n), np.float32)
        for i in range(t):
            h = _gates(np.take(self.tables[0], x[i], axis=1), h, self.u[0], self.c[0])[-1]
            total += self.probabilities(np.concatenate((h, back[i]))) * mask[i]
        return total


def gradients(model: Model, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross-entropy of every position of full segments, and its gradients by backpropagation through time."""
    t, n = x.shape
    k = STATES
    kept = [[None] * t, [None] * t]
    states = np.zeros((2, t, k, n), np.float32)
    for d in (0, 1):
        h = np.zeros((k, n), np.float32)
        for i in range(t) if d == 0 else range(t - 1, -1, -1):
            step = _gates(np.take(model.tables[d], x[i], axis=1), h, model.u[d], model.c[d])
            kept[d][i] = (h, *step[:4])
            h = states[d, i] = step[4]
    both = np.concatenate((states[0], states[1]), axis=1)  # position, states, segment
    flat = both.transpose(1, 0, 2).reshape(2 * k, t * n)
    p = model.probabilities(flat)
    label = np.tile(y, t)
    loss = float(-np.log(np.maximum(p[label, np.arange(t * n)], 1e-9)).mean())
    p[label, np.arange(t * n)] -= 1
    p /= t * n
    grad_out, grad_bias = p @ flat.T, p.sum(1, keepdims=True)
    into = (model.out.T @ p).reshape(2, k, t, n)
    grads: list[list[np.ndarray]] = [[], [], []]
    for d in (0, 1):
        table, u, c = np.zeros_like(model.tables[d]), np.zeros_like(model.u[d]), np.zeros_like(model.c[d])
        delta_inputs = np.empty((t, 3 * k, n), np.float32)
        dh = np.zeros((k, n), np.float32)
        for i in range(t - 1, -1, -1) if d == 0 else range(t):
            h, z, r, part, new = kept[d][i]
            dh = dh + into[d, :, i]
            dnew = dh * (1 - z) * (1 - new * new)
            dz = dh * (h - new) * z * (1 - z)
            dpart = dnew * r
            dr = dnew * part * r * (1 - r)
            recurrent = np.concatenate((dz, dr, dpart))
            u += recurrent @ h.T
            c += dpart.sum(1, keepdims=True)
            delta_inputs[i] = np.concatenate((dz, dr, dnew))
            dh = dh * z + model.u[d].T @ recurrent
        flat_x, deltas = x.ravel(), delta_inputs.transpose(1, 0, 2).reshape(3 * k, t * n)
        for row in range(3 * k):
            table[row] = np.bincount(flat_x, weights=deltas[row], minlength=256)
        for held, g in zip(grads, (table, u, c)):
            held.append(g)
    return loss, [*grads[0], *grads[1], *grads[2], grad_out, grad_bias]


def train(segments: np.ndarray, labels: np.ndarray, languages: list[str], seed: int = 1) -> Model:
    """Model from full segments (segment by position, bytes); every language counts alike in the batches."""
    model, rng = Model.fresh(languages, seed), np.random.default_rng(seed)
    of = [np.flatnonzero(labels == i) for i in range(len(languages))]
    first = [np.zeros_like(w) for w in model.weights()]
    second = [np.zeros_like(w) for w in model.weights()]
    for step in range(1, STEPS + 1):
        chosen = np.concatenate([rng.choice(rows, -(-BATCH // len(of))) for rows in of])
        _, grads = gradients(model, segments[chosen].T.astype(np.intp), labels[chosen])
        size = np.sqrt(sum(float((g * g).sum()) for g in grads))
        rate = RATE * (1 - 0.9 * step / STEPS)
        for w, g, m, v in zip(model.weights(), grads, first, second):
            g = g / max(1.0, size)
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return model


def sample_segments(rows: DataFrame, text_col: str, lang_col: str, order: Column, docs: int = SAMPLE_DOCS) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """A bounded sample: about ``docs`` documents, shared evenly among the languages, least ``order`` hash first.

    A language of fewer documents gives them all. Segments are evenly spread over the whole text, at most
    ``SAMPLE_SEGMENTS`` of a document; a short text is repeated up to one segment.
    """
    labelled = rows.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.pmod(F.xxhash64(order), F.lit(1 << 30)).alias("place")
    )
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(1000).collect()}
    languages = sorted(counts)
    if not languages:
        return np.zeros((0, SEGMENT), np.uint8), np.zeros(0, np.int64), []
    share = -(-docs // len(languages))
    below = {lang: int(min(1.0, share / n) * (1 << 30)) for lang, n in counts.items()}
    limit = F.coalesce(*[F.when(F.col("lang") == lang, F.lit(b)) for lang, b in below.items()], F.lit(0))
    picked = labelled.where(F.col("place") < limit).orderBy("place", "text").limit(2 * docs + len(languages))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [(i, s) for i, text in enumerate(batch.column(1).to_pylist()) for s in spread_segments(text)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i for i, _ in parts], pa.int64())), pa.array([s for _, s in parts], pa.binary())], ["lang", "segment"])

    found = sorted((r["lang"], bytes(r["segment"])) for r in picked.select("lang", "text").mapInArrow(cut, "lang string, segment binary").collect())
    segments = np.frombuffer(b"".join(s for _, s in found), np.uint8).reshape(-1, SEGMENT)
    return segments, np.array([languages.index(lang) for lang, _ in found], np.int64), languages


def spread_segments(text: str) -> list[bytes]:
    data = text.encode("utf-8", "surrogatepass")
    if len(data) < SEGMENT:
        return [(data * (SEGMENT // len(data) + 1))[:SEGMENT]] if data else []
    most = min(SAMPLE_SEGMENTS, len(data) // SEGMENT)
    return [data[at: at + SEGMENT] for at in np.linspace(0, len(data) - SEGMENT, most).astype(int).tolist()]


def document_probabilities(model: Model, texts: list[bytes]) -> np.ndarray:
    """Pooled probabilities, document by language; texts must not be empty."""
    size = np.array([len(t) for t in texts])
    segments = -(-size // SEGMENT)
    data = np.zeros((int(segments.sum()), SEGMENT), np.uint8)
    begin = (np.cumsum(segments) - segments) * SEGMENT
    flat = data.reshape(-1)
    for at, text in zip(begin.tolist(), texts):
        flat[at: at + len(text)] = np.frombuffer(text, np.uint8)
    doc = np.repeat(np.arange(len(texts)), segments)
    filled = np.minimum(SEGMENT, (begin + size)[doc] - np.arange(len(doc)) * SEGMENT)
    sums = np.empty((len(model.languages), len(doc)), np.float64)
    for lo in range(0, len(doc), _COLUMNS):
        x = data[lo: lo + _COLUMNS].T.astype(np.intp)
        mask = (np.arange(SEGMENT)[:, None] < filled[None, lo: lo + _COLUMNS]).astype(np.float32)
        sums[:, lo: lo + _COLUMNS] = model.segment_sums(x, mask)
    total = np.add.reduceat(sums, np.cumsum(segments) - segments, axis=1)
    return (total / total.sum(0)).T


def identify(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (0 to 1) at the end; whole texts, no shuffle.

    ``lang_pred`` is a learned language; ``und`` with score 0 for a null text, a text without a letter, or if nothing was
    learned. Columns of these names are replaced, all others pass through. Equal texts get equal results.
    """
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]
    at = names.index(text_col)
    rows = docs.select(*[F.col(f"`{c}`") for c in names]).toDF(*[f"c{i}" for i in range(len(names))])
    rows = rows.withColumn("letters", F.coalesce(F.col(f"c{at}").rlike(r"\p{L}"), F.lit(False)))
    shape = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in rows.schema][:-1] + ["lang_pred string", "score double"])

    def part_of(part: pa.RecordBatch) -> pa.RecordBatch:
        letters = np.array(part.column(len(names)).to_pylist(), bool) & (model is not None)
        lang, score = [UNKNOWN] * part.num_rows, np.zeros(part.num_rows)
        held = np.flatnonzero(letters)
        if len(held):
            texts = part.column(at).take(pa.array(held)).to_pylist()
            p = document_probabilities(model, [t.encode("utf-8", "surrogatepass") for t in texts])
            score[held] = np.clip(p.max(1), 0.0, 1.0)
            for i, best in zip(held.tolist(), p.argmax(1).tolist()):
                lang[i] = model.languages[best]
        return pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(lang), pa.array(score)], [*part.schema.names[:-1], "lang_pred", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.cumsum([len(t or "") for t in batch.column(at).to_pylist()]) // (_COLUMNS * SEGMENT)
            cuts = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                if hi > lo:
                    yield part_of(batch.slice(lo, hi - lo))

    return rows.mapInArrow(run, shape).toDF(*names, "lang_pred", "score")


def learned(rows: DataFrame, text_col: str = "text", lang_col: str = "lang", order_col: str = "doc_id", docs: int = SAMPLE_DOCS) -> Model | None:
    """Model of a bounded sample of the labelled ``rows``; none without any. ``order_col`` only chooses the sample."""
    segments, labels, languages = sample_segments(rows, text_col, lang_col, F.col(order_col), docs)
    return train(segments, labels, languages) if languages else None
