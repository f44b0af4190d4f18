"""Cross-entropy difference between two matched n-gram models.

Both models are bigram models over the tokens of one public vocabulary, smoothed towards their own unigram shares
by the same weight, and counted over whole texts: the background over every document, the target over those of
a given list. Background counts are scaled to the target's total, so that the smoothing weighs alike in both.
A document's score is the mean over its tokens of target loss minus background loss: below zero it is more like the
target than like the corpus.

Bigram counts are exact: a written table with one row per pair of tokens, which grows with the corpus and never
leaves the executors. Documents are coded once and dealt into chunks of about CHUNK tokens. A chunk sends each of its
distinct pairs once, with its multiplicities; sums by pair make the table, and a join gives every chunk the counts of
its own pairs, by which its documents are scored. So the most frequent pair has one row per chunk, not one per
document. Only counts by token and by context, whose number is that of the vocabulary, are gathered.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratlens.llm import shared, text
from stratlens.llm.bpe import read_ranks

TOKENS, SMOOTHING, CHUNK = 1 << 16, 50.0, 1 << 21
# The token before a text's first one.
START = TOKENS - 1

CODED = "chunk long, doc_id long, wanted boolean, tokens binary"
ASKED = "chunk long, bigram long, target long, background long"
SCORES = "doc_id long, n_tokens long, target_loss double, background_loss double, score double"


def vocabulary() -> str:
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=1)
def _encoding(path: str) -> tiktoken.Encoding:
    ranks = read_ranks(path)
    if max(ranks.values()) >= START:
        raise ValueError(f"more than {START} tokens: {path}")
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def bigram_slots(before: np.ndarray, token: np.ndarray) -> np.ndarray:
    """A number for each pair of tokens, its own for every pair."""
    return before.astype(np.int64) * TOKENS + token.astype(np.int64)


def _code(path: str):
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, filled = TaskContext.get().partitionId() << 32, 0
        encode = _encoding(path).encode_ordinary
        for batch in batches:
            offsets, _ = text.utf8(batch.column("text"))
            for i, j in text.slices(offsets):
                part = batch.slice(i, j - i)
                coded = [np.array(encode(t or ""), "<u2").tobytes() for t in part.column("text").to_pylist()]
                columns = [pa.array(np.full(j - i, chunk)), part.column("doc_id"), part.column("wanted"), pa.array(coded, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["chunk", "doc_id", "wanted", "tokens"])
                filled += sum(map(len, coded)) // 2 + (j - i)
                if filled >= CHUNK:
                    chunk, filled = chunk + 1, 0

    return code


def _pairs(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the pairs of all texts in a row, and how many each text has."""
    counts = np.array([len(t) // 2 for t in tokens], np.int64)
    token = np.frombuffer(b"".join(tokens), "<u2")
    before = np.empty_like(token)
    before[1:] = token[:-1]
    before[(np.cumsum(counts) - counts)[counts > 0]] = START
    return bigram_slots(before, token), counts


def _ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct pairs of each chunk with their multiplicities; a chunk whose rows lie apart may send a pair twice."""
    def sums(chunk: int, parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(parts)
        pairs, counts = _pairs(rows["tokens"].to_pylist())
        coded = pa.array(pairs).dictionary_encode()
        at, own = coded.indices.to_numpy(), coded.dictionary
        wanted = np.repeat(rows["wanted"].to_numpy(), counts)
        target = np.bincount(at[wanted], minlength=len(own)).astype(np.int64)
        background = np.bincount(at, minlength=len(own)).astype(np.int64)
        for k in range(0, len(own), 100_000):
            part = own.slice(k, 100_000)
            columns = [pa.array(np.full(len(part), chunk)), part, pa.array(target[k : k + len(part)]), pa.array(background[k : k + len(part)])]
            yield pa.RecordBatch.from_arrays(columns, ["chunk", "bigram", "target", "background"])

    held, parts = None, []
    for batch in batches:
        chunks = batch.column("chunk").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(chunks)) + 1), len(chunks)]
        for i, j in zip(cuts, cuts[1:], strict=False):
            if i == j:
                continue
            if parts and chunks[i] != held:
                yield from sums(held, parts)
                parts = []
            held = chunks[i]
            parts.append(batch.slice(i, j - i))
    if parts:
        yield from sums(held, parts)


class Model:
    """Exact counts (bigram, target, background) as a written table; shares by token and sums by context as arrays.

    Row 0 of the arrays is the target's, row 1 the background's; the latter is scaled to the target's size.
    """

    def __init__(self, counts: DataFrame):
        self.counts = counts
        tokens, self.contexts = self._sums(F.col("bigram") % TOKENS), self._sums(F.shiftright("bigram", 16))
        total = tokens.sum(axis=1)
        self.scale = np.array([1.0, total[0] / total[1] if total[1] else 0.0])[:, None]
        # One more of each token: no token is impossible.
        self.share = (tokens + 1) / (total[:, None] + TOKENS)
        self.contexts *= self.scale

    def _sums(self, by: Column) -> np.ndarray:
        """Counts by the token before or the token itself: TOKENS rows at most, however large the corpus."""
        table = self.counts.groupBy(by.alias("at")).agg(F.sum("target").alias("target"), F.sum("background").alias("background")).toArrow()
        out = np.zeros((2, TOKENS))
        for k, name in enumerate(("target", "background")):
            out[k, table["at"].to_numpy()] = table[name].to_numpy()
        return out


def _losses(scale: np.ndarray, share: np.ndarray, contexts: np.ndarray, bigram: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Negative log probability of each pair's token under the target and the background."""
    before, token = bigram // TOKENS, bigram % TOKENS
    return np.log(contexts[:, before] + SMOOTHING) - np.log(counts * scale + SMOOTHING * share[:, token])


def _coded(rows: DataFrame, path: str | None) -> DataFrame:
    return shared.table(rows.mapInArrow(_code(path or vocabulary()), CODED), "coded")


def _marked(docs: DataFrame, targets: DataFrame) -> DataFrame:
    ids = targets.select(F.col("doc_id").cast("long").alias("target_id")).where("target_id is not null").distinct()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # The list of targets grows with the corpus, so the join is the same shuffle at every size.
    joined = rows.join(ids.hint("merge"), F.col("doc_id") == F.col("target_id"), "left")
    return joined.select("doc_id", "text", F.col("target_id").isNotNull().alias("wanted"))


def _asked(coded: DataFrame) -> DataFrame:
    return shared.table(coded.mapInArrow(_ask, ASKED), "asked")


def _fitted(asked: DataFrame) -> Model:
    sums = asked.groupBy("bigram").agg(F.sum("target").alias("target"), F.sum("background").alias("background"))
    return Model(shared.table(sums, "bigrams"))


def _scored(coded: DataFrame, asked: DataFrame, model: Model) -> DataFrame:
    held = coded.sparkSession.sparkContext.broadcast((model.scale, model.share, model.contexts))

    def score(docs: pa.Table, known: pa.Table) -> pa.Table:
        pairs, counts = _pairs(docs["tokens"].to_pylist())
        means = np.full((2, len(counts)), np.nan)
        if len(pairs):
            own = known["bigram"].combine_chunks()
            losses = _losses(*held.value, own.to_numpy(), np.stack([known["target"].to_numpy(), known["background"].to_numpy()]))
            each = losses[:, pc.index_in(pa.array(pairs), value_set=own).to_numpy(zero_copy_only=True)]
            some = np.flatnonzero(counts)
            means[:, some] = np.add.reduceat(each, (np.cumsum(counts) - counts)[some], axis=1) / counts[some]
        columns = [pa.array(m, mask=counts == 0) for m in (*means, means[0] - means[1])]
        return pa.table([docs["doc_id"], pa.array(counts), *columns], [c.split(" ")[0] for c in SCORES.split(", ")])

    # Neither side is broadcast at any size: the counts grow with the corpus.
    known = asked.select("chunk", "bigram").join(model.counts.hint("merge"), "bigram", "left")
    known = known.select("chunk", "bigram", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("target", "background")))
    return coded.select("chunk", "doc_id", "tokens").groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(score, SCORES)


def fit(docs: DataFrame, targets: DataFrame, path: str | None = None) -> Model:
    """Both models from docs (doc_id, text); the target's documents are those with an id in targets (doc_id)."""
    return _fitted(_asked(_coded(_marked(docs, targets), path)))


def scored(docs: DataFrame, model: Model, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss and score for each row of docs (doc_id, text).

    Losses are means in nats per token; a null or empty text has no tokens and null losses and score. Without target
    documents every text is scored against an even target. Repeated rows give repeated rows; a null doc_id
    stays null; other columns are ignored; an empty table gives an empty result.
    """
    coded = _coded(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.lit(False).alias("wanted")), path)
    return _scored(coded, _asked(coded), model)


def differences(docs: DataFrame, targets: DataFrame, path: str | None = None) -> DataFrame:
    """scored() by models that are fitted to docs and, as the target, to its documents in targets."""
    coded = _coded(_marked(docs, targets), path)
    asked = _asked(coded)
    return _scored(coded, asked, _fitted(asked))
