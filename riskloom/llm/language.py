"""Language identification by a bit-sliced Bloom filter of character n-grams.

A text is its letters, lower-cased, anything else one space. Every slot of the filter holds one bit per language;
a learned n-gram sets the bit of its language in ``HASHES`` slots, and the AND of an n-gram's slots names
all languages that contain it. The n-grams of a text are looked up, counted per language, corrected for the filter's false
positives, and the language with most of them is predicted.

All training documents are counted. A language keeps the n-grams that make up at least ``LEAST_SHARE`` of its n-grams, so it
has 1 / LEAST_SHARE of them at most however large the corpus is; that bounds what reaches the driver and what is broadcast.

Defined cases: a null text and one without letters get ``und`` with score 0. A text whose n-grams are all unknown gets the
language with most training text, score 0; without any training text every prediction is ``und``. Ties go to the first language by code
point. Rows without lang teach nothing. Repeated rows and a null id are like others: a null id is learned from. Further columns are
ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.llm.text import mixed, odd_numbers

GRAM = 4
LEAST_SHARE = 1e-5
HASHES = 3
SLOTS = 1 << 21
CHUNK = 2_000_000  # characters counted at once
UNKNOWN = "und"
NO_LETTER = re.compile(r"[\W\d_]+")


def letters(text: str | None) -> str:
    return NO_LETTER.sub(" ", f" {text.lower()} ") if text else ""


def gram_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, owner): all n-grams of prepared texts and the text each belongs to."""
    sizes = np.array([len(t) for t in texts], np.int64)
    c = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
    n = len(c) - GRAM + 1
    if n < 1:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    h = np.zeros(n, np.uint64)
    for i, k in enumerate(odd_numbers(GRAM, 17)):
        h += c[i:i + n] * k
    inside = owner[:n] == owner[GRAM - 1:]
    return mixed(h[inside]), owner[:n][inside]


def added(counts: tuple[np.ndarray, np.ndarray] | None, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h, c = np.unique(hashes, return_counts=True)
    if counts is None:
        return h, c
    both, where = np.unique(np.concatenate([counts[0], h]), return_inverse=True)
    return both, np.bincount(where, weights=np.concatenate([counts[1], c])).astype(np.int64)


def gram_counts(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, gram, n) over all rows that have both; counted within tasks before the shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[str, list[str]] = {}
        held: dict[str, int] = {}
        counts: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def count(name: str) -> None:
            counts[name] = added(counts.get(name), gram_hashes(waiting.pop(name))[0])
            held[name] = 0

        def flushed() -> Iterator[pa.RecordBatch]:
            for name in list(waiting):
                count(name)
            for name, (h, c) in counts.items():
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(h), pa.string()), pa.array(h.view(np.int64)), pa.array(c, pa.int64())],
                                                 names=["lang", "gram", "n"])
            counts.clear()

        for b in batches:
            for name, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                waiting.setdefault(name, []).append(letters(t))
                held[name] = held.get(name, 0) + len(t)
                if held[name] > CHUNK:
                    count(name)
            if sum(len(h) for h, _ in counts.values()) > 4 * CHUNK:
                yield from flushed()
        yield from flushed()

    return (docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string"), text)
            .mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))


@dataclass
class LanguageFilter:
    """``slots``: one row per slot, one bit per language, in words of 64; ``wrong``: false-positive rate of each language."""

    languages: list[str]
    slots: np.ndarray
    wrong: np.ndarray
    common: int

    def masks(self, hashes: np.ndarray) -> np.ndarray:
        """(n-grams, words): the languages that contain each n-gram."""
        out = np.full((len(hashes), self.slots.shape[1]), ~np.uint64(0))
        for k in odd_numbers(HASHES, 19):
            out &= self.slots[((hashes * k) >> np.uint64(40)).astype(np.int64) % len(self.slots)]
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        ready = [letters(t) for t in texts]
        h, owner = gram_hashes(ready)
        n = np.bincount(owner, minlength=len(texts)).astype(float)
        counts = np.zeros((len(texts), len(self.languages)))
        masks = self.masks(h)
        for i in range(len(self.languages)):
            bit = (masks[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)
            counts[:, i] = np.bincount(owner, weights=bit.astype(float), minlength=len(texts))
        fair = np.maximum(0, (counts - n[:, None] * self.wrong) / (1 - self.wrong)) if len(self.languages) else counts
        names, scores = [], []
        for i, t in enumerate(ready):
            if not self.languages or not any(map(str.isalpha, t)):
                names.append(UNKNOWN)
                scores.append(0.0)
                continue
            best = int(fair[i].argmax()) if fair[i].any() else self.common
            names.append(self.languages[best])
            scores.append(min(1.0, float(fair[i, best] / n[i])) if n[i] else 0.0)
        return names, scores


def build(counts: DataFrame, slots: int = SLOTS, least_share: float = LEAST_SHARE) -> LanguageFilter:
    """The filter of all n-grams frequent enough in their language."""
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    sizes = {r["lang"]: r["total"] for r in totals.collect()}  # one row per language
    languages = sorted(sizes)
    table = np.zeros((slots, max(1, -(-len(languages) // 64))), np.uint64)
    kept = (counts.join(F.broadcast(totals), "lang").where(F.col("n") >= F.col("total") * least_share)  # one row per language
            .select("lang", "gram").toArrow())  # 1 / least_share rows per language at most
    number = {name: i for i, name in enumerate(languages)}
    which = np.array([number[x] for x in kept["lang"].to_pylist()], np.int64)
    grams = kept["gram"].to_numpy().astype(np.int64).view(np.uint64)
    for k in odd_numbers(HASHES, 19):
        at = ((grams * k) >> np.uint64(40)).astype(np.int64) % slots
        np.bitwise_or.at(table, (at, which // 64), np.uint64(1) << (which % 64).astype(np.uint64))
    fill = np.array([((table[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(languages))])
    common = max(range(len(languages)), key=lambda i: (sizes[languages[i]], -i)) if languages else 0
    return LanguageFilter(languages, table, fill ** HASHES, common)


def remainder(doc_id: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo a number; null for a null id."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(modulus))


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Per row: id, held_out, lang_pred, score. The held-out fifth of ids is not learned from."""
    seen = docs.where(F.coalesce(remainder(doc_id, 5) != 0, F.lit(True)))
    return predict(docs, build(gram_counts(seen, text, lang).persist()), doc_id, text)


def predict(docs: DataFrame, found: LanguageFilter, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(found)
    schema = T.StructType([docs.schema[doc_id], T.StructField("held_out", T.BooleanType()),
                           T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                b = batch.slice(i, 512)
                names, scores = shared.value.predict(b.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                                                 names=schema.names)

    return docs.select(doc_id, F.coalesce(remainder(doc_id, 5) == 0, F.lit(False)).alias("held_out"), text).mapInArrow(run, schema)
