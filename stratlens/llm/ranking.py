"""Ranked search by Block-Max MaxScore over sharded inverted lists.

1. A first pass counts the documents with a term and all terms. Each task then cuts its documents into shards of a bounded
   number of terms and writes one inverted list per term and shard: blocks of 64 postings (gaps of document numbers and
   counts, as variable-length bytes), each with its last document and its largest score part, and the list's largest one.
2. Items are dealt in blocks of queries to every group of shards. A shard is searched in windows of documents. Lists
   are ordered by their global bounds; those whose bounds together stay below the item's tenth score so far are not
   essential: a document found in them only cannot enter the results. Essential lists add up their scores in the window; a document
   that these reach is looked up in the other lists from the largest bound down, and is rejected once its score,
   the peak of its block in the next list and the bounds of the lists behind that cannot reach the tenth score, before the block is
   decompressed.
3. Each group of shards gives its ten best documents of an item; the heaps are merged by rank.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratlens.llm import shared, text

TOP = 10
BLOCK = 64  # postings
SHARD = 2_000_000  # terms of a shard, or one longer document
QUERIES = 512  # items of a block
FIRST, WINDOW = 256, 2048  # documents of a shard's first window and of the others

# The pattern of a term, on bytes and on characters, and the score's constants.
TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
TERM_TEXT = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SCALE, FLAT, SLOPE, COUNTS, NORMS = 1_000_000_000, 25, 75, 1000, 8

_INSIDE = np.array([not re.fullmatch(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]", bytes([b])) for b in range(256)])

INDEX = (
    "shard string, term string, df long, peak long, lasts array<int>, peaks array<int>, sizes array<int>, data binary, "
    "ids array<long>, norms array<long>"
)
_INDEX_TYPES = [
    pa.string(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(),
    pa.list_(pa.int64()), pa.list_(pa.int64()),
]
FOUND = "query long, doc_id long, score long"


def part(count: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """The score of a term in a document, before its weight."""
    return SCALE * count // (COUNTS * count + NORMS * norm)


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        offsets, data = text.utf8(batch.column("text"))
        for i, j in text.slices(offsets):
            base = int(offsets[i])
            inside = _INSIDE[data[base : int(offsets[j])]]
            start = inside.copy()
            start[1:] &= ~inside[:-1]
            edges = offsets[i:j] - base
            edges = edges[edges < len(inside)]
            start[edges] |= inside[edges]
            terms = np.diff(np.concatenate(([0], np.cumsum(start)))[offsets[i : j + 1] - base])
            yield pa.RecordBatch.from_arrays([pa.array([int((terms > 0).sum())]), pa.array([int(terms.sum())])], ["n", "terms"])


def totals(docs: DataFrame) -> tuple[int, int]:
    """The number of documents with a term, and of all their terms."""
    row = docs.select("text").mapInArrow(_sizes, "n long, terms long").agg(F.sum("n"), F.sum("terms")).first()
    return row[0] or 0, row[1] or 0


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Variable-length bytes of numbers, seven bits each, the last one below 128; and where each number ends."""
    values = values.astype(np.int64)
    sizes = np.ones(len(values), np.int64)
    for k in range(1, 5):
        sizes += values >= 1 << (7 * k)
    ends = np.cumsum(sizes)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(5):
        has = sizes > k
        out[ends[has] - 1 - k] = ((values[has] >> (7 * k)) & 127) | (128 if k else 0)
    return out, ends


def unpacked(data: np.ndarray) -> np.ndarray:
    last = data < 128
    if last.all():
        return data.astype(np.int64)
    ends = np.flatnonzero(last)
    number = np.cumsum(last) - last
    place = ends[number] - np.arange(len(data))
    return np.add.reduceat((data & 127).astype(np.int64) << (7 * place), np.append(0, ends[:-1] + 1))


class Shard:
    """Documents gathered by a task, until they are written as lists."""

    def __init__(self, name: str):
        self.name, self.terms, self.ids, self.lengths = name, {}, [], []
        self.numbers: list[np.ndarray] = []

    def add(self, doc_id: int | None, words: list[bytes]) -> None:
        known = self.terms
        self.numbers.append(np.array([known.setdefault(w, len(known)) for w in words], np.int64))
        self.ids.append(doc_id)
        self.lengths.append(len(words))

    def lists(self, n: int, terms: int) -> Iterator[pa.RecordBatch]:
        """One row per term, and before them one row with an empty term that holds the documents."""
        lengths = np.array(self.lengths, np.int64)
        norms = FLAT + (SLOPE * lengths * n) // terms
        yield self._batch([("", len(lengths), 0, [], [], [], b"", self.ids, norms.tolist())])
        document = np.repeat(np.arange(len(lengths)), lengths)
        key, count = np.unique(np.concatenate(self.numbers) * len(lengths) + document, return_counts=True)
        self.numbers.clear()
        term, document = key // len(lengths), key % len(lengths)
        first = np.flatnonzero(np.append(True, term[1:] != term[:-1]))
        df = np.diff(np.append(first, len(term)))
        # Blocks never cross lists.
        place = np.arange(len(term)) - np.repeat(first, df)
        heads = np.flatnonzero(place % BLOCK == 0)
        sizes = np.diff(np.append(heads, len(term)))
        tails = heads + sizes - 1
        score = part(count, norms[document])
        peaks = np.maximum.reduceat(score, heads)
        before = np.append(-1, document[:-1])
        before[first] = -1
        slot = np.arange(len(term)) + np.repeat(heads, sizes)
        values = np.empty(2 * len(term), np.int64)
        values[slot] = document - before - 1
        values[slot + np.repeat(sizes, sizes)] = count
        data, ends = packed(values)
        data, block_ends = data.tobytes(), ends[2 * tails + 1]
        block_of = np.searchsorted(heads, first)
        bounds = np.append(block_of, len(heads))
        peak = np.maximum.reduceat(peaks, block_of)
        rows, at = [], 0
        names = list(self.terms)
        lasts, widths = document[tails].tolist(), np.diff(np.append(0, block_ends)).tolist()
        peaks = peaks.tolist()
        for k, a, b, d, p in zip(term[first].tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), df.tolist(), peak.tolist(), strict=True):
            end = int(block_ends[b - 1])
            rows.append((names[k].decode(), d, p, lasts[a:b], peaks[a:b], widths[a:b], data[at:end], None, None))
            at = end
            if len(rows) == 20_000:
                yield self._batch(rows)
                rows = []
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        columns = [[self.name] * len(rows), *zip(*rows, strict=True)]
        names = [c.strip().split(" ")[0] for c in INDEX.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _INDEX_TYPES, strict=True)], names)


def index(docs: DataFrame, n: int, terms: int) -> DataFrame:
    """Inverted lists of all terms of docs, by shard; n and terms are totals() of docs. Texts without a term are left out."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, held = TaskContext.get().partitionId(), 0, 0
        shard = Shard(f"{task}-0")
        for batch in batches:
            offsets, data = text.utf8(batch.column("text"))
            for k, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                words = TERM.findall(data[offsets[k] : offsets[k + 1]].tobytes().lower())
                if not words:
                    continue
                if held and held + len(words) > SHARD:
                    yield from shard.lists(n, terms)
                    number, held = number + 1, 0
                    shard = Shard(f"{task}-{number}")
                shard.add(doc_id, words)
                held += len(words)
        if held:
            yield from shard.lists(n, terms)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(build, INDEX)


class List:
    """One list of a shard; blocks are decompressed when asked for, once."""

    def __init__(self, row: dict, norms: np.ndarray):
        self.peak, self.norms = row["peak"], norms
        self.lasts, self.peaks = np.array(row["lasts"], np.int64), np.array(row["peaks"], np.int64)
        self.edges = np.concatenate(([0], np.cumsum(row["sizes"]))).tolist()
        self.data = np.frombuffer(row["data"], np.uint8)
        self.open: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def block(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and score parts of a block."""
        found = self.open.get(b)
        if found is None:
            values = unpacked(self.data[self.edges[b] : self.edges[b + 1]])
            half = len(values) // 2
            documents = np.cumsum(values[:half] + 1) + (self.lasts[b - 1] if b else -1)
            found = self.open[b] = documents, part(values[half:], self.norms[documents])
        return found

    def within(self, low: int, high: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Postings of documents from low up to high."""
        for b in range(*np.searchsorted(self.lasts, (low, high)).tolist()):
            yield self.block(b)
        b = int(np.searchsorted(self.lasts, high))
        if b < len(self.lasts):
            yield self.block(b)


class Best:
    """The best documents of an item so far."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def least(self) -> int:
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.append(self.scores, scores), np.append(self.ids, ids)
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[order], ids[order]


def search(lists: dict[str, List], ids: np.ndarray, query: list[tuple[str, int]], best: Best) -> None:
    """Add the documents of a shard that can be among the best of an item of (term, weight)."""
    found = [(weight * lists[term].peak, weight, lists[term]) for term, weight in query if term in lists and weight > 0]
    found.sort(key=lambda x: x[0])
    bounds = np.cumsum([bound for bound, _, _ in found])
    low = 0
    while found and low < len(ids):
        high = min(len(ids), low + (WINDOW if low else FIRST))
        least = best.least()
        essential = int(np.searchsorted(bounds, least))  # lists before it stay below together
        score = np.zeros(high - low, np.int64)
        for _, weight, postings in found[essential:]:
            for documents, parts in postings.within(low, high - 1):
                if documents[0] < low or documents[-1] >= high:
                    a, b = np.searchsorted(documents, (low, high))
                    documents, parts = documents[a:b], parts[a:b]
                score[documents - low] += weight * parts
        candidates = np.flatnonzero(score)
        for k in range(essential - 1, -1, -1):
            candidates = candidates[score[candidates] + bounds[k] >= least]
            if not len(candidates):
                break
            _, weight, postings = found[k]
            block = np.searchsorted(postings.lasts, candidates + low)
            peak = np.append(postings.peaks, 0)[block]
            rest = bounds[k - 1] if k else 0
            kept = score[candidates] + weight * peak + rest >= least
            candidates, block = candidates[kept], block[kept]
            for b in np.unique(block[block < len(postings.lasts)]).tolist():
                documents, parts = postings.block(b)
                asked = candidates[block == b] + low
                at = np.minimum(np.searchsorted(documents, asked), len(documents) - 1)
                hit = documents[at] == asked
                score[asked[hit] - low] += weight * parts[at[hit]]
        candidates = candidates[score[candidates] >= least]
        best.add(score[candidates], ids[candidates + low])
        low = high


_NO_ID = np.iinfo(np.int64).max


def _searched(top: int):
    def searched(lists: pa.Table, queries: pa.Table) -> pa.Table:
        items = [(q["query"], [(t["term"], t["weight"]) for t in q["terms"]]) for q in queries.to_pylist()]
        bests = {query: Best(top) for query, _ in items}
        shards: dict[str, list[dict]] = {}
        for row in lists.to_pylist() if items else []:
            shards.setdefault(row["shard"], []).append(row)
        for rows in shards.values():
            head = next(r for r in rows if not r["term"])
            norms = np.array(head["norms"], np.int64)
            ids = np.array([_NO_ID if i is None else i for i in head["ids"]], np.int64)
            own = {r["term"]: List(r, norms) for r in rows if r["term"]}
            for query, terms in items:
                search(own, ids, terms, bests[query])
        out = [(q, i, s) for q, b in bests.items() for i, s in zip(b.ids.tolist(), b.scores.tolist(), strict=True)]
        query, ids, scores = ([x[k] for x in out] for k in range(3))
        ids = [None if i == _NO_ID else i for i in ids]
        return pa.table({"query": pa.array(query, pa.int64()), "doc_id": pa.array(ids, pa.int64()), "score": pa.array(scores, pa.int64())})

    return searched


def ranked(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id and score of the top documents of docs (doc_id, text) for each item of items (item_id, text).

    Only scores above 0 count, highest first, equal ones by doc_id (null ids last). A null or empty text has no term. Rows of
    items with equal item_id and text are one item; an item_id with several texts has one ranking for each. Each row of docs is a
    document of its own, whether or not its id or text occurs again. Other columns are ignored; without documents or items
    the result is empty.
    """
    spark = docs.sparkSession
    n, terms = totals(docs)
    lists = shared.table(index(docs, n, max(terms, 1)), "lists")
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.regexp_extract_all(lowered, F.lit(TERM_TEXT), F.lit(0))
    asked = items.select("item_id", "text").where("text is not null").distinct().withColumn("query", F.monotonically_increasing_id())
    asked = shared.table(asked, "items")
    wanted = asked.select("query", F.explode(words).alias("term")).groupBy("query", "term").agg(F.count("*").alias("times"))
    wanted = shared.cut(wanted)
    names = shared.small(shared.cut(wanted.select("term").distinct().union(spark.createDataFrame([("",)], "term string"))))
    needed = lists.join(names, "term", "left_semi")
    df = needed.where("term <> ''").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log((F.lit(2.0) * n + 2) / (2 * F.col("df") + 1))).cast("long") * F.col("times")
    queries = wanted.join(df, "term").select("query", F.struct("term", weight.alias("weight")).alias("term"))
    # A deal of queries to blocks and of shards to groups; every block of queries meets every group once.
    groups, blocks = max(lists.where("term = ''").count(), 1), -(-asked.count() // QUERIES) or 1
    block = F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int")
    queries = queries.groupBy("query").agg(F.collect_list("term").alias("terms")).withColumn("block", block)
    queries = queries.withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    needed = needed.withColumn("grp", F.pmod(F.xxhash64("shard"), F.lit(groups)).cast("int"))
    needed = needed.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    found = needed.groupBy("grp", "block").cogroup(queries.groupBy("grp", "block")).applyInArrow(_searched(top), FOUND)
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.join(asked.select("query", "item_id"), "query").select("item_id", "rank", "doc_id", "score")
