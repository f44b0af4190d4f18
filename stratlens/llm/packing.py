"""Pack documents into sequences of at most 1024 tokens by hierarchical residual best fit.

Each text becomes ids plus an end id; only longer documents are cut, so that all pieces but the first are
full. A full piece is a sequence by itself. The others are dealt to tasks of about GROUP items; each task
takes them by falling length and puts each into the fullest open bin that it fits (a bit mask of the
open spaces finds that bin in one step). Bins with at most SLACK free tokens are emitted; the others
become items of the next round, which has fewer tasks; where a round joins hardly any bins, the next one also has
larger tasks, until one task holds all that is left or tasks of MOST items gain nothing more. A
task's items are a bounded number, never a key's rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stratlens.llm import shared, text
from stratlens.llm.tokens import ODD, packed

CAPACITY, END, SLACK, GROUP, MOST = 1024, 2, 8, 5_000, 1_000_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def vocabulary() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=1)
def _encoder(path: str) -> Callable[[str], list[int]]:
    """One for all tasks of a Python worker.

    A plain text, where the pre-tokeniser's pattern leaves no doubt, goes to tiktoken with the vocabulary of the
    same file, which gives the same ids in a fourth of the time; any other text, also one with the string of an added
    token, goes to the tokenizer itself.
    """
    tokenizer = Tokenizer.from_file(path)
    special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    added = re.compile("|".join(map(re.escape, special)) or "(?!)").search
    ranks = {token_bytes(token): rank for token, rank in tokenizer.get_vocab().items() if token not in special}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> list[int]:
        return tokenizer.encode(text, add_special_tokens=False).ids if ODD(text) or added(text) else fast.encode_ordinary(text)

    return encode


def token_bytes(token: str) -> bytes:
    """The bytes that a byte-level vocabulary writes as printable characters: other bytes follow from 256 on, in order."""
    return bytes(_BYTE_OF[c] for c in token)


_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_OF = {chr(b): b for b in _PRINTABLE} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(_PRINTABLE)))}


def token_pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces of each document: place among its ids, length, CRC-32 and, on request, the ids as little-endian bytes.

    A null or empty text has the end id alone.
    """
    path = path or vocabulary()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = _encoder(path), packed([END])
        for batch in batches:
            offsets, _ = text.utf8(batch.column("text"))
            for i, j in text.slices(offsets):
                ids = batch.column("doc_id").slice(i, j - i).to_pylist()
                texts = [t or "" for t in batch.column("text").slice(i, j - i).to_pylist()]
                rows = []
                for doc_id, document in zip(ids, texts, strict=True):
                    code = packed(encode(document)) + end
                    n = len(code) // 4
                    starts = [0, *range((n - 1) % capacity + 1, n, capacity)]
                    for k, (a, b) in enumerate(zip(starts, [*starts[1:], n], strict=True)):
                        part = code[4 * a : 4 * b]
                        rows.append((doc_id, k, a, b - a, zlib.crc32(part), *([part] if with_ids else [])))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types, strict=True)], names)

    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *([pa.binary()] if with_ids else [])]
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        cut, PIECES + ", ids binary" * with_ids
    )


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each length, taken in the given order, and the fill of each bin."""
    bins, offsets, fill = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), []
    spaces: dict[int, list[int]] = {}
    mask = 0  # bit s: some open bin has s free tokens
    for k, length in enumerate(lengths.tolist()):
        fitting = mask >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            b = spaces[free].pop()
            if not spaces[free]:
                mask ^= 1 << free
        else:
            b, free = len(fill), capacity
            fill.append(0)
        bins[k], offsets[k] = b, fill[b]
        fill[b] += length
        left = free - length
        if left:
            held = spaces.setdefault(left, [])
            if not held:
                mask |= 1 << left
            held.append(b)
    return bins, offsets, np.array(fill, np.int64)


def _packer(level: int, capacity: int, order: list[str]):
    def packer(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", *order], ascending=[False] + [True] * len(order), kind="stable")
        bins, offsets, fill = best_fit(pdf["length"].to_numpy(), capacity)
        # A task's number and a place in it; the round in the highest bits.
        first = (level << 56) | (int(pdf["task"].iloc[0]) << 28)
        return pdf.drop(columns="task").assign(bin=bins + first, place=offsets, fill=fill[bins])

    return packer


def pack(items: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """items with a column length (1 to capacity), plus sequence_id and offset.

    Items of full length get a sequence each. Equal rows are separate items. No items: no rows.
    """
    names = items.columns
    full = items.where(F.col("length") == capacity).withColumns(
        {"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")}
    )
    rest = items.where(F.col("length") < capacity)
    count, level, packed_rows = rest.count(), 0, None
    loose = rest
    while count:
        tasks = max(1, -(-count // group))
        order = [c for c in loose.columns if c != "length"]
        dealt = loose.withColumn("task", F.pmod(F.xxhash64(*loose.columns), F.lit(tasks)).cast("int"))
        schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in loose.schema)}, bin long, place long, fill long"
        done = shared.table(dealt.groupBy("task").applyInPandas(_packer(level, capacity, order), schema), "packed")
        if packed_rows is None:
            packed_rows = done.select(*names, "bin", "place")
        else:
            step = done.select(F.col("item").alias("bin"), F.col("bin").alias("next"), F.col("place").alias("more"))
            packed_rows = packed_rows.join(step, "bin", "left").select(
                *names, F.coalesce("next", "bin").alias("bin"), (F.col("place") + F.coalesce("more", F.lit(0))).alias("place")
            )
        if tasks == 1:
            break
        loose = (
            done.where(F.col("fill") < capacity - SLACK).groupBy("bin").agg(F.max("fill").alias("length"))
            .select(F.col("bin").alias("item"), "length")
        )
        before, count, level = count, loose.count(), level + 1
        if count > 0.98 * before:
            if group >= MOST:
                break
            group = min(4 * group, MOST)
    if packed_rows is None:
        return full
    return full.unionByName(
        packed_rows.select(*names, F.col("bin").alias("sequence_id"), F.col("place").alias("offset"))
    )


def packed_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset for each piece of docs (doc_id, text).

    A null or empty text is one piece, its end id. Repeated rows are packed each; a null doc_id stays null.
    Other columns of docs are ignored. An empty table gives an empty result.
    """
    return pack(shared.table(token_pieces(docs, path, capacity), "pieces"), capacity)
