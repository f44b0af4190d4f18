"""Language of whole texts by hierarchical discrimination.

Families come first: linear support vector machines, one for each two families, vote. Within the winning family one
machine for each two of its languages votes. A text is the frequencies of its hashed byte trigrams, after
lower-casing, around letters only; every machine is linear in them, so all margins of a batch come from
one table lookup per byte and one sum per text. The machines are fitted on the driver to a sample of at most about
PER_LANGUAGE texts of each language, chosen by a hash of the id.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratlens.llm import text

UNDETERMINED, PER_LANGUAGE, DIMENSIONS = "und", 400, 4096
# Families of common language codes. Any other code is a family by itself.
FAMILIES = {
    "Germanic": "af da de en fy is lb nb nl nn no sv yi",
    "Romance": "ca es fr gl it la oc pt ro",
    "Slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "Baltic": "lt lv",
    "Celtic": "br cy ga gd gv",
    "Uralic": "et fi hu",
    "Turkic": "az kk ky tr tt uz",
    "Indo-Aryan": "bn gu hi mr ne pa ur",
    "Semitic": "am ar he mt",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[128:] = True
_FOLD = np.where(_LETTER, np.arange(256), 32).astype(np.uint32)
_HAS_LETTER = regex.compile(r"\p{L}").search


def trigrams(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigram around each letter byte (DIMENSIONS where there is none), and each text's count of them.

    The texts must be lower case. A text's edges count as spaces.
    """
    base, end = int(offsets[0]), int(offsets[-1])
    part = data[base:end]
    codes = _FOLD[part]
    before, after = np.full(len(codes), 32, np.uint32), np.full(len(codes), 32, np.uint32)
    before[1:], after[:-1] = codes[:-1], codes[1:]
    begins = offsets[:-1] - base
    before[begins[begins < len(codes)]] = 32
    ends = offsets[1:] - base - 1
    after[ends[ends >= 0]] = 32
    mixed = (before * np.uint32(0x9E3779B1) ^ codes * np.uint32(0x85EBCA77)) + after * np.uint32(0xC2B2AE3D)
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(0x2C1B3C6D)
    letters = _LETTER[part]
    places = np.where(letters, mixed >> np.uint32(32 - 12), np.uint32(DIMENSIONS)).astype(np.intp)
    counts = np.concatenate(([0], np.cumsum(letters)))
    return places, np.diff(counts[offsets - base])


def _lower(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return text.utf8(pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), "")))


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        offsets, data = _lower(batch.column("text"))
        rows = []
        for k in range(batch.num_rows):
            places, n = trigrams(offsets[k : k + 2], data)
            counts = np.bincount(places, minlength=DIMENSIONS + 1)[:DIMENSIONS]
            rows.append((counts / max(1, n[0]) * 1000).astype(np.float16).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(rows, pa.binary())], ["lang", "x"])


def fit_machine(x: np.ndarray, y: np.ndarray, cost: float = 1.0, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Linear support vector machine by dual coordinate descent; y is 1 or -1. The classes weigh alike."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    weights, alpha = np.zeros(x.shape[1], np.float32), np.zeros(len(x))
    norms = (x * x).sum(axis=1)
    most = cost * np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum())))
    order = np.random.default_rng(0)
    for _ in range(rounds):
        moved = 0.0
        for i in order.permutation(len(x)):
            slope = y[i] * float(weights @ x[i]) - 1
            new = min(max(alpha[i] - slope / norms[i], 0.0), most[i])
            if new != alpha[i]:
                weights += np.float32((new - alpha[i]) * y[i]) * x[i]
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return weights[:-1], float(weights[-1])


class Model:
    """Machines of the family level and of each family, in one table of weights."""

    def __init__(self, x: np.ndarray, lang: list[str]):
        self.languages = sorted(set(lang))
        family = np.array([FAMILY_OF.get(code, code) for code in lang])
        lang = np.array(lang)
        mean = x.mean(axis=0) if len(x) else np.zeros(DIMENSIONS)
        scale = np.sqrt(mean) + 0.05
        x = ((x - mean) / scale).astype(np.float32) / np.sqrt(DIMENSIONS)
        self.members: dict[str, list[str]] = {f: sorted(set(lang[family == f])) for f in sorted(set(family))}
        self.machines: dict[str, list[tuple[int, int, int]]] = {}
        columns, biases = [], []
        for level, names in [("", list(self.members)), *self.members.items()]:
            labels = family if level == "" else lang
            self.machines[level] = []
            for a, b in combinations(range(len(names)), 2):
                chosen = (labels == names[a]) | (labels == names[b])
                w, bias = fit_machine(x[chosen], np.where(labels[chosen] == names[a], 1.0, -1.0))
                w = w / scale / np.sqrt(DIMENSIONS)
                self.machines[level].append((a, b, len(columns)))
                columns.append(w)
                biases.append(bias - float(w @ mean))
        # The last row is for places without a letter.
        self.weights = np.zeros((DIMENSIONS + 1, len(columns)), np.float32)
        self.weights[:DIMENSIONS] = np.array(columns, np.float32).reshape(len(columns), DIMENSIONS).T * 1000
        self.biases = np.array(biases)

    def _vote(self, level: str, names: list[str], margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The winner's index, and how sure its machines are on the mean."""
        sure = np.zeros((len(margins), len(names)))
        for a, b, k in self.machines[level]:
            p = 1 / (1 + np.exp(-np.clip(3 * margins[:, k], -50, 50)))
            sure[:, a] += p
            sure[:, b] += 1 - p
        if len(names) == 1:
            sure += 1
        winner = sure.argmax(axis=1)
        return winner, sure[np.arange(len(sure)), winner] / max(1, len(names) - 1)

    def predict(self, offsets: np.ndarray, data: np.ndarray) -> tuple[list[str | None], np.ndarray]:
        """Language and score of each lower-case text; None where nothing was learned."""
        n = len(offsets) - 1
        if not self.languages:
            return [None] * n, np.zeros(n)
        places, counts = trigrams(offsets, data)
        margins = np.zeros((n, self.weights.shape[1]))
        full = np.flatnonzero(np.diff(offsets))
        for k in range(self.weights.shape[1]):
            if len(full):
                margins[full, k] = np.add.reduceat(self.weights[:, k][places], offsets[full] - offsets[0], dtype=np.float64)
        margins = margins / np.maximum(counts, 1)[:, None] + self.biases
        families = list(self.members)
        family, sure = self._vote("", families, margins)
        out, score = [None] * n, np.zeros(n)
        for f, name in enumerate(families):
            rows = np.flatnonzero(family == f)
            winner, inner = self._vote(name, self.members[name], margins[rows])
            score[rows] = sure[rows] * inner
            for row, w in zip(rows, winner, strict=True):
                out[row] = self.members[name][w]
        return out, score


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """From rows of doc_id, text and lang. Rows with a null among the three are not used."""
    labelled = labelled.select("doc_id", "text", "lang").where("doc_id is not null and text is not null and lang is not null")
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, F.lit(per_language / n)).otherwise(share)
    sample = labelled.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1_000_000)) < share * 1_000_000)
    rows = sample.select("lang", "text").mapInArrow(_frequencies, "lang string, x binary").collect()
    rows.sort()
    x = np.array([np.frombuffer(r["x"], np.float16) for r in rows], np.float32).reshape(len(rows), DIMENSIONS)
    return Model(x / 1000, [r["lang"] for r in rows])


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score (0 to 1) for each row of docs (doc_id, text).

    A null text, or one without a letter, is und with score 0, as is every text if nothing was learned.
    Repeated rows give repeated rows; other columns are ignored; an empty table gives an empty result.
    """
    shared_model = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared_model.value
        for batch in batches:
            offsets, data = _lower(batch.column("text"))
            texts = batch.column("text")
            for i, j in text.slices(offsets):
                names, score = fitted.predict(offsets[i : j + 1], data)
                letters = [t is not None and _HAS_LETTER(t) is not None for t in texts.slice(i, j - i).to_pylist()]
                names = [name if known and name else UNDETERMINED for name, known in zip(names, letters, strict=True)]
                score = np.where([name == UNDETERMINED for name in names], 0.0, score)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"]
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        predict, "doc_id long, lang_pred string, score double"
    )


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, with all their columns, that predicted() does not call und, whatever their score."""
    shared_model = docs.sparkSession.sparkContext.broadcast(model)

    def accept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared_model.value
        for batch in batches:
            offsets, data = _lower(batch.column("text"))
            texts, found = batch.column("text"), []
            for i, j in text.slices(offsets):
                names, _ = fitted.predict(offsets[i : j + 1], data)
                known = [t is not None and _HAS_LETTER(t) is not None for t in texts.slice(i, j - i).to_pylist()]
                found.append(np.array([bool(name and letters) for name, letters in zip(names, known, strict=True)], bool))
            yield batch.filter(pa.array(np.concatenate(found) if found else np.zeros(0, bool)))

    return docs.mapInArrow(accept, docs.schema)


def identified(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """predicted() with held_out, by machines fitted to the rows of docs that are not held out."""
    model = fit(docs.where(~held_out(F.col("doc_id"))), per_language)
    return predicted(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
