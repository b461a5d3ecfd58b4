"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words. Each passage is encoded by how classes of bytes follow each other in it
and by a few word statistics; a learned layer turns that into a representation, gated attention weighs the
passages, and the score is read from the weighted sum. All weights are learned together from document labels, so
no passage is labelled.

The model is fitted on ``SAMPLE`` labelled documents at most, those with the smallest hash of their id; that bound also bounds
what reaches the driver. Scoring covers the whole text of every document, passage by passage, in Arrow batches.

Defined cases: null and empty texts are one empty passage and get the score of that. Labels without a document, without an id
or without a value are left out; repeated labels of a document count by their mean. Without any labels of one of the two
values every score is the share of good labels (0.5 if there are none). Repeated rows and a null id are scored like others. Further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PASSAGE = 128
SAMPLE = 3000
WIDTH, GATE = 24, 12
EPOCHS, BATCH, RATE, DECAY = 30, 64, 0.01, 1e-4
CLASSES = 16
STATS = 8
INPUTS = CLASSES * CLASSES + STATS


def _byte_classes() -> np.ndarray:
    """Class of each byte: lower, upper, digit, space, line feed, marks one by one or by kind, beyond ASCII."""
    c = np.full(256, 15, np.uint8)
    c[:128] = 14
    for i, chars in enumerate(["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\r", "\n", ".", ",", "!?", "#$%&*", "|", ":;", "'\"", "()[]{}<>/\\", "-_=+@"]):
        c[[ord(x) for x in chars]] = i
    return c


BYTE_CLASS = _byte_classes()


def passages(text: str | None) -> list[bytes]:
    """Runs of ``PASSAGE`` words; the words of a passage are joined as they stood, up to white space other than line feeds."""
    words = (text or "").encode().replace(b"\n", b" \n ").split(b" ")
    words = [w for w in words if w]
    return [b" ".join(words[i:i + PASSAGE]) for i in range(0, len(words), PASSAGE)] or [b""]


def encode(text: str | None) -> np.ndarray:
    """(passages, INPUTS): what follows what, and word statistics."""
    found = passages(text)
    out = np.zeros((len(found), INPUTS), np.float32)
    for row, p in zip(out, found):
        if not p:
            continue
        c = BYTE_CLASS[np.frombuffer(p, np.uint8)].astype(np.int32)
        pairs = np.bincount(c[:-1] * CLASSES + c[1:], minlength=CLASSES * CLASSES)
        row[:CLASSES * CLASSES] = np.sqrt(pairs / max(1, len(c) - 1))
        words = p.split()
        n, distinct = len(words), len(set(words))
        again = sum(map(bytes.__eq__, words[:-1], words[1:]))
        if n:
            row[CLASSES * CLASSES:] = (1.0, distinct / n, again / n, min(2.0, len(p) / n / 8), n / PASSAGE, p.count(b"\n") / n,
                                       len(set(map(bytes.lower, words))) / n, 1.0 - distinct / n if n > 8 else 0.0)
    return out


@dataclass
class Attention:
    """Encoder, gated attention and read-out. ``constant`` replaces the score if there was nothing to learn."""

    params: dict[str, np.ndarray]
    constant: float | None = None

    def score(self, bag: np.ndarray) -> float:
        return float(self.constant) if self.constant is not None else float(_forward(self.params, bag, np.array([0]))["p"][0])


def _forward(w: dict[str, np.ndarray], x: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
    """All bags at once: ``starts`` has the first passage of each."""
    h = np.tanh(x @ w["E"] + w["e"])
    t, g = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
    a = (t * g) @ w["w"]
    bag = np.zeros(len(x), np.int64)
    bag[starts[1:]] = 1
    bag = np.cumsum(bag)
    e = np.exp(a - np.maximum.reduceat(a, starts)[bag])
    attention = e / np.add.reduceat(e, starts)[bag]
    z = np.add.reduceat(attention[:, None] * h, starts, axis=0)
    p = 1 / (1 + np.exp(-np.clip(z @ w["c"] + w["b"], -30, 30)))
    return {"h": h, "t": t, "g": g, "bag": bag, "attention": attention, "z": z, "p": p}


def _gradients(w: dict[str, np.ndarray], x: np.ndarray, starts: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    f = _forward(w, x, starts)
    h, t, g, bag, att = f["h"], f["t"], f["g"], f["bag"], f["attention"]
    d = (f["p"] - y) / len(y)
    dz = d[:, None] * w["c"]
    along = (h * dz[bag]).sum(axis=1)
    da = att * (along - np.add.reduceat(att * along, starts)[bag])
    dt, dg = da[:, None] * w["w"] * g * (1 - t * t), da[:, None] * w["w"] * t * g * (1 - g)
    dh = att[:, None] * dz[bag] + dt @ w["V"].T + dg @ w["U"].T
    dpre = dh * (1 - h * h)
    return {"c": f["z"].T @ d, "b": d.sum(), "w": (t * g).T @ da, "V": h.T @ dt, "U": h.T @ dg, "E": x.T @ dpre, "e": dpre.sum(axis=0)}


def fit(bags: list[np.ndarray], labels: np.ndarray, seed: int = 3) -> Attention:
    """Adam on the log loss, in a fixed order of batches."""
    if not len(labels) or labels.min() == labels.max():
        return Attention({}, float(labels.mean()) if len(labels) else 0.5)
    rng = np.random.default_rng(seed)
    w = {"E": rng.normal(0, INPUTS ** -0.5, (INPUTS, WIDTH)), "e": np.zeros(WIDTH), "V": rng.normal(0, 0.3, (WIDTH, GATE)),
         "U": rng.normal(0, 0.3, (WIDTH, GATE)), "w": rng.normal(0, 0.3, GATE), "c": rng.normal(0, 0.3, WIDTH), "b": np.zeros(())}
    m, v = {k: np.zeros_like(x) for k, x in w.items()}, {k: np.zeros_like(x) for k, x in w.items()}
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(bags))
        for i in range(0, len(order), BATCH):
            pick = order[i:i + BATCH]
            sizes = np.array([len(bags[j]) for j in pick])
            x = np.concatenate([bags[j] for j in pick]).astype(np.float64)
            grads = _gradients(w, x, np.concatenate([[0], np.cumsum(sizes)[:-1]]), labels[pick])
            step += 1
            for k, g in grads.items():
                g = g + DECAY * w[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                w[k] = w[k] - RATE * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)
    return Attention(w)


def remainder(doc_id: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo a number."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(modulus))


def training_bags(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
                  sample: int = SAMPLE) -> tuple[list[np.ndarray], np.ndarray]:
    """Encoded passages and labels of at most ``sample`` documents; (bytes per document, label) reach the driver."""
    chosen = (
        labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull())
        .groupBy(F.col(doc_id).alias("l_id")).agg(F.avg(label).alias("y"))
        .orderBy(F.xxhash64("l_id"), "l_id").limit(sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [pa.array([encode(t).astype(np.float16).tobytes() for t in b.column(0).to_pylist()], pa.binary()), b.column(1), b.column(2)],
                names=["bag", "y", "id"])

    rows = (docs.join(F.broadcast(chosen), F.col(doc_id) == F.col("l_id"))
            .select(text, "y", F.col("l_id").cast("string"))
            .mapInArrow(run, "bag binary, y double, id string").toArrow().sort_by([("id", "ascending"), ("bag", "ascending")]))
    bags = [np.frombuffer(x, np.float16).reshape(-1, INPUTS) for x in rows["bag"].to_pylist()]
    return bags, rows["y"].to_numpy()


def learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> Attention:
    return fit(*training_bags(docs, labels, doc_id, text, label))


def with_score(docs: DataFrame, model: Attention, text: str = "text", score: str = "score") -> DataFrame:
    """Add the score of every whole text."""
    schema = T.StructType([*docs.schema.fields, T.StructField(score, T.DoubleType())])
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = [model.score(encode(t)) for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64())], names=[*b.schema.names, score])

    return docs.mapInArrow(run, schema)


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, held_out, score, predicted. Labels of the held-out quarter of ids are not seen."""
    seen = labels.where(remainder(doc_id, 4) != 2)
    model = learn(docs, seen, doc_id, text)
    scored = with_score(docs.select(doc_id, text), model, text)
    return scored.select(doc_id, F.coalesce(remainder(doc_id, 4) == 2, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The documents whose score reaches the threshold."""
    model = learn(docs, labels.where(remainder("doc_id", 4) != 2))
    kept = with_score(docs.withColumnRenamed("score", "_score_of_docs") if "score" in docs.columns else docs, model, score="_quality")
    kept = kept.where(F.col("_quality") >= threshold).drop("_quality")
    return kept.withColumnRenamed("_score_of_docs", "score") if "_score_of_docs" in kept.columns else kept
