"""Maximal periodic runs of words, by a dictionary of basic factors.

Level k of the dictionary names every stretch of 2^k words of a text, so that equal stretches of one text have equal
names; a name of level k + 1 is a pair of names of level k. A position whose stretch does not recur in its text within a
fourth of the text's length cannot lie in a run of four periods and is not named further, so of ordinary prose little is
left after a few levels.

1. At each level the next occurrence of a position's stretch, at a distance d of at most twice the stretch's length, is
   its successor. Positions whose successor has the same d again form arithmetic progressions of three, and propose the
   period d. Where a run has the smallest period q, look at the level with q <= 2^k < 2 q: occurrences closer than q
   would give the run a smaller period, and the run's first position, q and 2 q further on lie in it, so q is proposed there.
2. Each proposal (neighbouring positions are one) is extended word by word to both sides as far as words d apart agree.
3. Proposals of one run at several levels are equal then, and one is kept. The distance to the next
   occurrence is the smallest period, as a smaller one would have given a closer occurrence.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratlens.llm import text

LEAST, TIMES = 6, 4  # words of a run at least, and periods of it
_JOIN = 1 << 17

SCHEMA = (
    "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, "
    "runs array<struct<start:long,length:long,period:long>>, collapsed string"
)


class Words:
    """Places, lengths and numbers of the words of several texts; equal words have equal numbers."""

    def __init__(self, offsets: np.ndarray, data: np.ndarray):
        base = int(offsets[0])
        self.data = part = data[base : int(offsets[-1])]
        inside = ~text.SEPARATOR[part]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        edges = offsets[1:-1] - base  # a word ends with its text
        edges = edges[(edges > 0) & (edges < len(part))]
        first[edges] |= inside[edges]
        last[edges - 1] |= inside[edges - 1]
        self.starts = np.flatnonzero(first)
        self.lengths = np.flatnonzero(last) + 1 - self.starts
        self.firsts = np.searchsorted(self.starts, offsets - base)
        ends = np.concatenate(([0], np.cumsum(self.lengths)))
        packed = pa.Array.from_buffers(
            pa.large_binary(), len(self.starts), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(part[inside].tobytes())]
        )
        self.numbers = packed.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.order = np.arange(len(self.starts))

    def repeat(self, document: int, begin: int, period: int) -> None:
        """From the word begin on, the text repeats its next period words."""
        lo, hi = self.firsts[document] + begin, self.firsts[document + 1]
        self.order[lo:hi] = lo + (np.arange(hi - lo) % period)

    def joined(self, chosen: np.ndarray) -> bytes:
        """Words by place, each with a space behind."""
        lengths = self.lengths[chosen] + 1
        ends = np.cumsum(lengths)
        at = np.repeat(self.starts[chosen] - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)
        at[ends - 1] = 0  # any place; the space comes next
        out = self.data[at]
        out[ends - 1] = 0x20
        return out.tobytes()


def _proposals(words: np.ndarray, document: np.ndarray, most: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(positions, distances, size) per level; most is the largest period of each position's text."""
    n = len(words)
    size, position = 1, np.arange(n)
    key = document * (int(words.max()) + 1 if n else 1) + words
    while len(position):
        order = np.argsort(key, kind="stable")
        sorted_key, at = key[order], position[order]
        same = sorted_key[1:] == sorted_key[:-1]
        gap = np.where(same, at[1:] - at[:-1], n + 1)
        near = gap <= most[at[:-1]]
        # A successor whose own successor is as far away: three terms of a progression.
        again = np.flatnonzero(near[:-1] & (gap[:-1] == gap[1:]) & (gap[:-1] <= 2 * size))
        yield at[again], gap[again], size
        recurs = np.append(near, False)
        recurs[1:] |= near
        name = np.full(n + 1, -1, np.int64)
        name[at[recurs]] = (np.cumsum(np.append(True, ~same)) - 1)[recurs]
        position = np.sort(at[recurs])
        position = position[position + size < n]
        pair = name[position + size]
        keep = (pair >= 0) & (document[position] == document[np.minimum(position + size, n - 1)])
        position = position[keep]
        key = name[position] * (n + 1) + pair[keep]
        size *= 2


def _agree(words: np.ndarray, at: int, stop: int, distance: int) -> int:
    """The first place from at up to stop whose word differs from the one distance before (after, if negative)."""
    step, sign = 32, 1 if stop >= at else -1
    while at != stop:
        m = min(step, abs(stop - at))
        own = words[at : at + m] if sign > 0 else words[at - m + 1 : at + 1][::-1]
        low = at - distance
        other = words[low : low + m] if sign > 0 else words[low - m + 1 : low + 1][::-1]
        differs = own != other
        k = int(differs.argmax())
        if differs[k]:
            return at + sign * k
        at += sign * m
        step = min(2 * step, 1 << 16)
    return at


def find_runs(words: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """(text, start, length, period) of every run of the texts, sorted; words from firsts[k] on belong to text k."""
    counts = np.diff(firsts)
    document = np.repeat(np.arange(len(counts)), counts)
    most = np.repeat(counts // TIMES, counts)
    found: dict[tuple[int, int, int], int] = {}
    for position, gap, size in _proposals(words, document, most):
        order = np.lexsort((position, gap))
        position, gap = position[order], gap[order]
        new = np.ones(len(position), bool)
        new[1:] = (gap[1:] != gap[:-1]) | (position[1:] != position[:-1] + 1)
        seen: dict[tuple[int, int], int] = {}
        for p, d in zip(position[new].tolist(), gap[new].tolist(), strict=True):
            k = int(document[p])
            if p < seen.get((k, d), -1):
                continue  # inside the stretch that the proposal before it gave
            low, high = int(firsts[k]), int(firsts[k + 1])
            stop = _agree(words, p + d + size, high, d)
            start = _agree(words, p - 1, low - 1, -d) + 1
            seen[k, d] = stop - d
            if stop - start >= max(LEAST, TIMES * d):
                found[k, start, d] = stop - start
    rows = sorted((k, start - int(firsts[k]), d, length) for (k, start, d), length in found.items())
    return np.array(rows, np.int64).reshape(-1, 4)[:, [0, 1, 3, 2]]


def _collapsed(words: Words, document: int, runs: np.ndarray) -> Iterator[bytes]:
    """The words outside the repeats, joined by one space, in parts."""
    lo, hi = int(words.firsts[document]), int(words.firsts[document + 1])
    change = np.zeros(hi - lo + 1, np.int64)
    np.add.at(change, runs[:, 1] + runs[:, 3], 1)
    np.add.at(change, runs[:, 1] + runs[:, 2], -1)
    kept = words.order[lo:hi][np.cumsum(change)[:-1] == 0]
    for a in range(0, len(kept), _JOIN):
        part = words.joined(kept[a : a + _JOIN])
        yield part if a + _JOIN < len(kept) else part[:-1]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [part.strip().split(" ")[0] for part in SCHEMA.split(", ")]
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    types = [pa.int64()] * 6 + [pa.string()] * 2 + [pa.list_(run), pa.string()]
    for batch in batches:
        offsets, data = text.utf8(batch.column("text"))
        for i, j in text.slices(offsets):
            words = Words(offsets[i : j + 1], data)
            for k, repeat in enumerate(batch.column("repeat").slice(i, j - i).to_pylist()):
                n = int(words.firsts[k + 1] - words.firsts[k])
                if repeat is not None and n:
                    begin = repeat["at"] % n
                    words.repeat(k, begin, 1 + (n - begin) // repeat["part"])
            runs = find_runs(words.numbers[words.order], words.firsts)
            bounds = np.searchsorted(runs[:, 0], np.arange(j - i + 1))
            rows = []
            for k in range(j - i):
                own = runs[bounds[k] : bounds[k + 1]]
                listed = "".join(f"{a},{b},{c}\n" for a, b, c in own[:, 1:].tolist())
                best = (None, None, None)
                if len(own):
                    best = tuple(own[np.lexsort((own[:, 3], own[:, 1], -own[:, 2]))[0], 1:].tolist())
                parts = b"".join(_collapsed(words, k, own))
                exponent = 1000 * best[1] // best[2] if len(own) else None
                rows.append((
                    batch.column("doc_id")[i + k].as_py(), len(own), *best, exponent, hashlib.sha256(listed.encode()).hexdigest(),
                    hashlib.sha256(parts).hexdigest(), [{"start": a, "length": b, "period": c} for a, b, c in own[:, 1:].tolist()],
                    parts.decode() if len(own) else None,
                ))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names)


def periodic_runs(docs: DataFrame, repeat: F.Column | None = None) -> DataFrame:
    """One row per row of docs (doc_id, text): its runs of words, the longest one, and the text without their repeats.

    A run is a stretch of consecutive words with the smallest period q, of at least 6 words and 4 periods, that cannot be
    extended. n_runs counts them and runs lists them by start and period; start, length, period and exponent_milli
    (1000 * length / period, rounded down) are those of the longest (then the first, then the shortest period), and null
    if there is none. collapsed is the text without the words behind the first period of any run, words joined by one space; null
    if there is no run. The two digests are of the list of runs and of the collapsed text (the joined words, if there is no run).

    repeat is an optional column struct<at, part>: of a text of n words, the words from at % n on are replaced by repeats of
    the first 1 + (n - at % n) / part of them before the search; null leaves the text alone.
    A null text counts as empty and a null doc_id stays null; a repeated row gives a repeated row; other columns are
    ignored; an empty table gives an empty result.
    """
    none = F.lit(None).cast("struct<at:long,part:long>")
    repeat = none if repeat is None else repeat
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", repeat.alias("repeat"))
    return source.mapInArrow(_rows, SCHEMA)


def planted(doc_id: str = "doc_id") -> F.Column:
    """The repeat of the registered query: texts whose checksum h of doc_id ends in 0, from h / 10 on, in 3 to 10 parts."""
    h = F.crc32(F.col(doc_id).cast("long").cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")
    return F.when(h % 10 == 0, F.struct(g.alias("at"), (3 + g % 8).cast("long").alias("part")))


def digests(docs: DataFrame) -> DataFrame:
    """periodic_runs() of docs with planted() repeats, without the lists and texts."""
    return periodic_runs(docs, planted()).drop("runs", "collapsed")
