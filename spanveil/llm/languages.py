"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A letter trigram is bound by multiplying the vectors
of its letters, each permuted (rotated) by its place; a text is bundled by adding its trigrams'
vectors, and compared with a prototype per language by cosine. Runs of other characters count as one
blank, which has a vector too. Letters are folded into 63 classes (a to z their own, others by code
point), so trigrams number at most 2**18 and their vectors are made when they are met.

A prototype is the sum over its documents of their trigram shares; sums are of integers, so they do
not depend on the order of tasks. Learning gathers one vector per language and task; what reaches
the driver is one vector per language.

A null text or one without a letter is ``und`` with score 0; so is every text if nothing was
learned. Ties go to the first language in order. Repeated rows count each. Null languages are not
learned from. Columns other than those named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from spanveil.llm.words import slices

DIMENSIONS, SEED, SCALE, UNDETERMINED = 512, 20240229, 1 << 40, "und"
CHUNK, BLOCK = 1 << 19, 128


class Encoder:
    """Trigrams of texts, and their vectors."""

    def __init__(self, dimensions: int = DIMENSIONS):
        signs = np.random.default_rng(SEED).integers(0, 2, (64, dimensions), dtype=np.int8) * 2 - 1
        self.first, self.second, self.third = np.roll(signs, 2, axis=1), np.roll(signs, 1, axis=1), signs
        codes = np.arange(0x10000)
        self.letter = np.zeros(0x10000, np.uint8)
        alpha = np.fromiter((chr(c).isalpha() for c in codes), bool, len(codes))
        self.letter[alpha] = (27 + codes[alpha] * 2654435761 % 37).astype(np.uint8)
        self.letter[97:123] = np.arange(1, 27)

    def vectors(self, trigrams: np.ndarray) -> np.ndarray:
        return (self.first[trigrams >> 12] * self.second[trigrams >> 6 & 63] * self.third[trigrams & 63]).astype(np.float32)

    def trigrams(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, trigram and count, by row; rows without letters have none."""
        low = [t.lower() for t in texts]
        codes = np.frombuffer("\n".join(low).encode("utf-32-le", "surrogatepass") + b"\n\0\0\0", np.uint32)
        row = np.repeat(np.arange(len(low)), np.fromiter((len(t) + 1 for t in low), np.int64, len(low)))
        letter = self.letter[np.minimum(codes, 0xFFFF)]
        for c in np.unique(codes[codes > 0xFFFF]):
            letter[codes == c] = 27 + int(c) * 2654435761 % 37 if chr(c).isalpha() else 0
        stay = np.ones(len(codes), bool)  # one blank per run of them, and one between rows
        stay[1:] = (letter[1:] != 0) | (letter[:-1] != 0)
        letter, row = letter[stay].astype(np.int64), row[stay]
        letter, row = np.concatenate([[0], letter]), np.concatenate([row[:1], row])  # a blank opens each row
        key = (letter[:-2] << 12 | letter[1:-1] << 6 | letter[2:]) | row[1:-1] << 18
        key = key[letter[1:-1] != 0]
        key, count = np.unique(key, return_counts=True)
        return key >> 18, key & 0x3FFFF, count

    def profiles(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows that have letters, and their bundles, block by block."""
        row, trigram, count = self.trigrams(texts)
        for a in range(0, len(texts), BLOCK):
            i, j = np.searchsorted(row, [a, a + BLOCK])
            if i == j:
                continue
            rows, at = np.unique(row[i:j], return_inverse=True)
            kinds, of = np.unique(trigram[i:j], return_inverse=True)
            weights = np.zeros((len(rows), len(kinds)), np.float32)
            weights[at, of] = count[i:j]
            yield rows, weights @ self.vectors(kinds)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", CHUNK):
        for a in range(0, len(batch), 8192):
            yield batch.slice(a, 8192)


def _learn(dimensions: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, sums = Encoder(dimensions), {}
        for batch in _parts(batches):
            texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
            row, trigram, count = encoder.trigrams(texts)
            share = count / np.bincount(row, count, minlength=len(texts))[row]
            kinds, of = np.unique(trigram, return_inverse=True)
            names = sorted(set(langs))
            name = np.searchsorted(names, langs)[row] if len(row) else row
            weight = np.zeros((len(names), len(kinds)))
            np.add.at(weight, (name, of), share)
            for lang, vector in zip(names, weight @ encoder.vectors(kinds)):
                sums[lang] = sums.get(lang, 0) + vector
        for lang, vector in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * dimensions), pa.array(range(dimensions), pa.int32()),
                 pa.array(np.rint(vector * (1 << 20)).astype(np.int64))], ["lang", "i", "v"])

    return run


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """Prototypes of unit length from all rows whose text and language are given."""
    rows = docs.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).where(
        "text IS NOT NULL AND lang IS NOT NULL").mapInArrow(_learn(dimensions), "lang string, i int, v bigint")
    sums = rows.groupBy("lang", "i").agg(F.sum("v").alias("v")).groupBy("lang").agg(
        F.array_sort(F.collect_list(F.struct("i", "v"))).getField("v").alias("v")).collect()
    out = {}
    for r in sorted(sums, key=lambda r: r["lang"]):
        vector = np.array(r["v"], np.float64)
        if vector.any():
            out[r["lang"]] = (vector / np.linalg.norm(vector)).astype(np.float32)
    return out


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], text: str = "text", lang_as: str = "lang_pred",
            score_as: str = "score", dimensions: int = DIMENSIONS) -> DataFrame:
    """The rows with a language and a score from 0 to 1 (the cosine) added."""
    names = list(prototypes)
    matrix = np.stack([prototypes[n] for n in names]) if names else np.zeros((0, dimensions), np.float32)
    docs = docs.drop(lang_as, score_as)
    given = docs.withColumn("_row", F.struct(*[F.col(f"`{c}`") for c in docs.columns])).select(
        "_row", F.col(f"`{text}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(dimensions)
        for batch in _parts(batches):
            texts = ["" if t is None else t for t in batch.column("text").to_pylist()]
            lang, score = [UNDETERMINED] * len(texts), np.zeros(len(texts))
            for rows, bundles in encoder.profiles(texts) if names else ():
                size = np.linalg.norm(bundles, axis=1)
                cosine = bundles @ matrix.T / np.where(size > 0, size, 1)[:, None]
                best = cosine.argmax(axis=1)
                score[rows] = np.clip(cosine[np.arange(len(rows)), best], 0, 1)
                for r, b in zip(rows.tolist(), best.tolist()):
                    lang[r] = names[b]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_row"), pa.array(lang, pa.string()), pa.array(score)], ["_row", "lang", "score"])

    kind = given.schema["_row"].dataType.simpleString()
    out = given.mapInArrow(run, f"_row {kind}, lang string, score double")
    return out.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns],
                      F.col("lang").alias(lang_as), F.col("score").alias(score_as))
