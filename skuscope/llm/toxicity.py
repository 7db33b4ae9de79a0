"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are the presence of the character n-grams of the lower-cased text, hashed
to 2**BITS places. A place's log-count ratio r says how much likelier it is in
a toxic text than in a clean one; the classifier is a logistic regression over
r * presence, so places that tell nothing weigh nothing at the start.

Counts for r are taken over all labelled training rows; the regression itself
is fitted on at most `max_fit_rows` of them and `max_fit_bytes` of their places
(documented bounds: for each label half of that, the rows with the smallest md5
of the id).
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import frugal, shuffle_width, written

BITS = 20
ORDERS = (4, 5, 6)
SLICES = 256
PRIOR = 1.0


@dataclass
class ToxicityModel:
    weights: np.ndarray  # by place
    bias: float
    threshold: float = 0.7


def hashed(text: str | None, bits: int = BITS, orders=ORDERS) -> np.ndarray:
    """The hashed places of all n-grams of a whole text, repeats included; null is the empty text."""
    raw = np.frombuffer((" " + (text or "").lower() + " ").encode("utf-32-le", "surrogatepass"), "<u4")
    code, length = np.maximum(raw, 32).astype(np.uint64), 1  # control characters count as white space
    raw = code
    found = []
    for n in sorted(orders):
        if len(raw) < n:
            break
        while length < n:
            code = code[:-1] * np.uint64(0x100000001B3)
            code += raw[length:]
            length += 1
        found.append(((code ^ (code >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).view(np.int64))
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def places(text: str | None, among: np.ndarray | None = None) -> np.ndarray:
    """The distinct places of a whole text's n-grams, of those marked in `among`, sorted."""
    at = hashed(text)
    if among is not None:
        return np.unique(at[among[at]])
    if len(at) < 1500:
        return np.unique(at)
    seen = np.zeros(1 << BITS, bool)
    seen[at] = True
    return np.flatnonzero(seen)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: in how many texts of each label each place that occurs does, in slices of places; slice -1 has the texts."""
    totals = np.zeros((2, 1 << BITS), np.uint32)
    rows = np.zeros((2, 1), np.uint32)
    for batch in batches:
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            totals[label, places(text)] += 1
            rows[label] += 1
    if rows.any():
        for k, part in [(-1, rows), *enumerate(np.split(totals, SLICES, axis=1))]:
            at = np.flatnonzero(part.any(axis=0))
            if len(at):
                yield _slice(k, at, part[:, at])


def _slice(k: int, at: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array([k], pa.int32()), pa.array([at.astype("<u2").tobytes()], pa.binary()), pa.array([counts.astype("<u4").tobytes()], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["slice", "places", "counts"])


_SLICE = "slice int, places binary, counts binary"


def _unsliced(places: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(places, "<u2").astype(np.int64), np.frombuffer(counts, "<u4").reshape(2, -1)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up what came for each slice, a row at a time."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, places, counts in zip(*(batch.column(i).to_pylist() for i in range(3))):
            at, part = _unsliced(places, counts)
            sums.setdefault(k, np.zeros((2, (1 << BITS) // SLICES), np.uint32))[:, at] += part
    for k, counts in sums.items():
        at = np.flatnonzero(counts.any(axis=0))
        yield _slice(k, at, counts[:, at])


def _packed(at: np.ndarray) -> bytes:
    """Sorted places in a few bytes each."""
    return zlib.compress(np.diff(at, prepend=0).astype("<u4").tobytes(), 1)


def _unpacked(raw: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(raw), "<u4"), dtype=np.int64)


def _fit(rows: list[bytes], labels: np.ndarray, ratio: np.ndarray, epochs: int, l2: float) -> tuple[np.ndarray, float]:
    """Logistic regression by Adagrad over mini-batches of packed places; deterministic."""
    w, b = np.ones_like(ratio), math.log((labels.sum() + 1) / (len(labels) - labels.sum() + 1))
    squares, bias_square = np.full_like(ratio, 1e-6), 1e-6
    order = np.random.default_rng(7)
    steps = max(1, len(rows) // 64)
    for _ in range(max(epochs, math.ceil(800 / steps))):
        for part in np.array_split(order.permutation(len(rows)), steps):
            own = [_unpacked(rows[i]) for i in part]
            index = np.concatenate(own)
            if not len(index):
                continue
            owner = np.repeat(np.arange(len(part)), list(map(len, own)))
            z = np.bincount(owner, ratio[index] * w[index], len(part)) + b
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[part]) / len(part)
            touched, where = np.unique(index, return_inverse=True)
            gradient = np.bincount(where, error[owner] * ratio[index]) + l2 * (w[touched] - 1) / steps
            squares[touched] += gradient**2
            w[touched] -= 0.1 * gradient / np.sqrt(squares[touched])
            bias_square += error.sum() ** 2
            b -= 0.1 * error.sum() / math.sqrt(bias_square)
    return w * ratio, float(b)


def _sent(ids: DataFrame, limit: int = 2_000_000) -> DataFrame:
    """ids (a long and an int a row) for a join: broadcast up to `limit` rows, by a shuffle beyond."""
    return F.broadcast(ids) if ids.count() <= limit else ids


def train(docs: DataFrame, marks: DataFrame, *, max_fit_rows: int = 12_000, max_fit_bytes: int = 32 << 20, epochs: int = 6, l2: float = 1e-4, threshold: float = 0.7) -> ToxicityModel:
    """Trains on docs(id, text) whose id is in marks(id, label), label 0 or 1, one row an id.

    Null labels don't count; null and empty texts have no n-grams; repeated rows
    count as often as they stand there; texts of any length count once each.
    With no rows of either label every score is 0.5. What comes to the driver is bounded by
    2**BITS counts, and by max_fit_rows texts' places of at most max_fit_bytes in all:
    each label has half of both, for its first rows in the order of md5.
    """
    docs = docs.select("id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    marks = written(marks.filter("label in (0, 1) and id is not null"), "marks")
    counted = docs.join(_sent(marks), "id").select("text", "label").mapInArrow(frugal(_counts), _SLICE).repartition(shuffle_width(docs.sparkSession), "slice").mapInArrow(_summed, _SLICE).toArrow()
    wide = (1 << BITS) // SLICES
    totals, texts = np.full((2, 1 << BITS), PRIOR), np.zeros(2)
    for k, places_, counts in zip(*(c.to_pylist() for c in counted.columns)):
        at, part = _unsliced(places_, counts)
        if k < 0:
            texts = part[:, 0].astype(float)
        else:
            totals[:, k * wide + at] += part
    del counted
    if not texts.all():
        return ToxicityModel(np.zeros(1 << BITS), 0.0, threshold)
    clean, toxic = totals
    ratio = np.log(toxic / (texts[1] + 2 * PRIOR)) - np.log(clean / (texts[0] + 2 * PRIOR))
    # What chance alone explains says nothing: ratios shrink by three standard errors.
    ratio = np.sign(ratio) * np.maximum(0, np.abs(ratio) - 3 * np.sqrt(1 / toxic + 1 / clean))
    ratio[(toxic + clean) < 2 * PRIOR + 3] = 0
    del totals, clean, toxic

    informative = docs.sparkSession.sparkContext.broadcast(ratio != 0)

    def bits(batches):
        for batch in batches:
            found = [places(x, informative.value) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(map(_packed, found), pa.binary())], names=["label", "turn", "places"])

    order = F.md5(F.col("id").cast("string"))
    picked = marks.filter("label = 0").orderBy(order, "id").limit(max_fit_rows // 2).union(marks.filter("label = 1").orderBy(order, "id").limit(max_fit_rows // 2))
    sample = docs.join(F.broadcast(picked), "id").select("text", "label", order.alias("turn")).mapInArrow(bits, "label int, turn string, places binary")
    rows, label = _bounded(written(sample, "fit-sample"), max_fit_bytes)
    weights, bias = _fit(rows, label.astype(float), ratio, epochs, l2)
    fitted = np.bincount(label, minlength=2)
    bias += math.log(texts[1] / fitted[1]) - math.log(texts[0] / fitted[0])  # the labels' shares among all rows
    informative.destroy()
    return ToxicityModel(weights, bias, threshold)


def _bounded(sample: DataFrame, most: int) -> tuple[list[bytes], np.ndarray]:
    """The places and labels of sample's first rows in turn, of each label up to half of `most` bytes, one row at least."""
    sizes = sorted((r.label, r.turn, r.n) for r in sample.select("label", "turn", F.length("places").alias("n")).collect())
    last: dict[int, str] = {}
    for label in {x for x, _, _ in sizes}:
        held = 0
        for _, turn, n in (x for x in sizes if x[0] == label):
            held += n
            if held > most // 2 and label in last:
                break
            last[label] = turn
    within = [(F.col("label") == label) & (F.col("turn") <= turn) for label, turn in last.items()]
    found = sample.filter(within[0] | within[-1]).select("places", "label").toArrow()
    rows = sorted(zip(found.column("places").to_pylist(), found.column("label").to_pylist()))
    return [x for x, _ in rows], np.array([y for _, y in rows])


def score_toxicity(docs: DataFrame, model: ToxicityModel, *, text_column: str = "text") -> DataFrame:
    """Adds `score` (0 to 1) and `predicted` (1 from model.threshold on) to docs.

    Whole texts of any length are scored, null as empty; equal texts have equal
    scores; repeated rows have a row each; all columns of docs stay (columns of docs named score or predicted are
    replaced); an empty table gives an empty result. The model (a fixed 5 MB)
    is broadcast.
    """
    docs = docs.drop("score", "predicted")
    sent = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.weights != 0, model.bias))
    text_at = docs.columns.index(text_column)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, informative, bias = sent.value
        for batch in batches:
            found = []
            for text in batch.column(text_at).to_pylist():
                at = places(text, informative)
                z = weights[at].sum(dtype=np.float64) + bias
                found.append(1 / (1 + math.exp(-max(-30.0, min(30.0, float(z))))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], names=[*batch.schema.names, "score"])

    out = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(scored, out).withColumn("predicted", F.when(F.col("score") >= model.threshold, 1).otherwise(0).cast("int"))


def held_out(column="doc_id"):
    """Rows that training must not use: crc32 of the id as text, mod 3, is 1."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % 3 == 1


def train_on_labels(docs: DataFrame, labels: DataFrame, **settings) -> ToxicityModel:
    """Trains on the rows of documents whose label isn't held out; an id that has
    several labels counts as toxic if any is."""
    marks = labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("label")).filter(F.col("id").isNotNull() & ~held_out("id")).groupBy("id").agg(F.max("label").alias("label"))
    return train(docs.select(F.col("doc_id").alias("id"), "text"), marks, **settings)
