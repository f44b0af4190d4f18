"""Byte-level BPE encoding and decoding by recursive DuckDB queries inside each task.

A task looks up the words it has met before. Words that are new to it go, some thousands at a time, into
one recursive query: rows (word, position, token, next token) join the merge table, each word's
lowest rank is contracted at its leftmost place, and words without a mergeable pair leave with their
last tokens. For words of over LONG bytes a second form contracts, in the same step, every hit of the lowest
rank, of a run of overlapping hits every other one, so that a long run takes few steps; for words of over VERY_LONG bytes the
steps replace one table, so that memory follows the word and not the number of steps. Another query decodes the
words' ids: tokens joined to their bytes and put together in order. What a task holds is bounded by the batch and by the cache's size.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache

import duckdb
import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratlens.llm import text
from stratlens.llm.tokens import WordCache

SLICE, CHUNK = 4 << 20, 256 << 10

LONG, VERY_LONG = 64, 4096

ENCODE = """
with recursive step as (
  select s.word, s.pos, s.token, n.pos as after, n.token as next, true as active
  from start s left join start n on n.word = s.word and n.pos = s.pos + 1
  union all
  (with pairs as (
     select s.*, m.merged from step s left join merges m on m.l = s.token and m.r = s.next where s.active),
   best as (
     select word, min(merged::bigint * 1048576 + pos) as key from pairs group by word),
   hits as (
     select best.word, key % 1048576 as pos, (key // 1048576)::integer as merged, p.after as eaten, e.after, e.next
     from best left join pairs p on p.word = best.word and p.pos = key % 1048576
       left join pairs e on e.word = best.word and e.pos = p.after)
   select p.word, p.pos, case when p.pos = h.pos then h.merged else p.token end,
     case when p.pos = h.pos then h.after else p.after end,
     case when p.pos = h.pos then h.next when p.after = h.pos then h.merged else p.next end, h.pos is not null
   from pairs p join hits h on h.word = p.word where h.eaten is null or p.pos <> h.eaten)
)
select word, list(token order by pos) as ids from step where not active group by word
"""

STEP = """
with pairs as (
  select s.word, s.pos, s.token, s.after, m.merged
  from (select word, pos, token, lead(token) over (partition by word order by pos) as after from step where active) s
  left join merges m on m.l = s.token and m.r = s.after),
hits as (
  select *, coalesce(merged = min(merged) over (partition by word), false) as hit, max(merged) over (partition by word) is not null as more,
    row_number() over (partition by word order by pos) as place
  from pairs),
runs as (
  select *, place - row_number() over (partition by word, hit order by pos) as run from hits),
chosen as (
  select *, hit and row_number() over (partition by word, hit, run order by pos) % 2 = 1 as joined from runs),
marked as (
  select *, coalesce(lag(joined) over (partition by word order by pos), false) as eaten from chosen)
select word, pos, case when joined then merged else token end as token, more as active from marked where not eaten
"""

FIRST = "select word, pos, token, true as active from start"

LAST = "select word, list(token order by pos) as ids from step where not active group by word"

ENCODE_LONG = f"with recursive step as ({FIRST} union all ({STEP})) {LAST}"

DECODE = """
select c.word, string_agg(t.hex, '' order by c.pos) as hex from coded c join tokens t using (token) group by c.word
"""


def vocabulary() -> str:
    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Codec:
    """Encode and decode words with the ranks of one vocabulary file."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        self.ranks = ranks = read_ranks(path)
        # White space as Unicode defines it; the letters and numbers are the same in both notations.
        words = regex.compile(pattern.replace(r"[^\s\p", r"[^\p{White_Space}\p").replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}")).findall
        merges = [
            (ranks[token[:k]], ranks[token[k:]], rank)
            for token, rank in ranks.items() for k in range(1, len(token)) if token[:k] in ranks and token[k:] in ranks
        ]
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "256MB", "temp_directory": ""})
        l, r, merged = (pa.array(c, pa.int32()) for c in zip(*merges, strict=True))
        self._table("merges", pa.table({"l": l, "r": r, "merged": merged}))
        hexes = [token.hex() for token in ranks]
        self._table("tokens", pa.table({"token": pa.array(ranks.values(), pa.int32()), "hex": hexes}))
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.texts = WordCache(self.round_trip, 2, exact=words)

    def _table(self, name: str, rows: pa.Table) -> None:
        self.db.register("incoming", rows)
        self.db.execute(f"create or replace table {name} as select * from incoming")
        self.db.unregister("incoming")

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of each word, by the recursive queries."""
        raw, out, at = [w.encode() for w in words], [], 0
        ends = np.cumsum([len(w) for w in raw])
        while at < len(raw):  # what a query holds is bounded by CHUNK bytes of words, or one longer word
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK, "right")))
            out += self._encode_chunk(raw[at:to])
            at = to
        return out

    def _encode_chunk(self, raw: list[bytes]) -> list[bytes]:
        out = [b""] * len(raw)
        forms = ((self._recursive(ENCODE), 0, LONG), (self._recursive(ENCODE_LONG), LONG, VERY_LONG), (self._stepwise, VERY_LONG, 2**31))
        for query, above, most in forms:
            chosen = [k for k, w in enumerate(raw) if above < len(w) <= most]
            if not chosen:
                continue
            data = np.frombuffer(b"".join(raw[k] for k in chosen), np.uint8)
            lengths = np.array([len(raw[k]) for k in chosen])
            word = np.repeat(np.arange(len(chosen), dtype=np.int32), lengths)
            pos = np.arange(len(data), dtype=np.int32) - np.repeat(np.cumsum(lengths) - lengths, lengths).astype(np.int32)
            self._table("start", pa.table({"word": word, "pos": pos, "token": self.single[data]}))
            found = query()
            ids = found["ids"].combine_chunks()
            ends = (4 * ids.offsets.to_numpy()).tolist()
            data = ids.values.to_numpy().astype("<u4").tobytes()
            for k, a, b in zip(found["word"].to_pylist(), ends, ends[1:], strict=False):
                out[chosen[k]] = data[a:b]
        return out

    def _recursive(self, query: str) -> Callable[[], pa.Table]:
        return lambda: self.db.sql(query).to_arrow_table()

    def _stepwise(self) -> pa.Table:
        """The same steps with one table in place of the recursion, which would keep the rows of all steps."""
        self.db.execute(f"create or replace table step as {FIRST}")
        while self.db.sql("select 1 from step where active limit 1").fetchall():
            done = "select word, pos, token, active from step where not active"
            self.db.execute(f"create or replace table step as ({STEP}) union all ({done})")
        return self.db.sql(LAST).to_arrow_table()

    def decode_words(self, coded: list[bytes]) -> list[bytes]:
        """Bytes of each list of ids, by ordered aggregation."""
        lengths = np.array([len(c) // 4 for c in coded], np.int64)
        token = np.frombuffer(b"".join(coded), "<u4").astype(np.int32)
        word = np.repeat(np.arange(len(coded), dtype=np.int32), lengths)
        pos = np.arange(len(token), dtype=np.int32) - np.repeat(np.cumsum(lengths) - lengths, lengths).astype(np.int32)
        self._table("coded", pa.table({"word": word, "pos": pos, "token": token}))
        found = self.db.sql(DECODE).to_arrow_table()
        out = [b""] * len(coded)
        for k, digits in zip(found["word"].to_pylist(), found["hex"].to_pylist(), strict=True):
            out[k] = bytes.fromhex(digits)
        return out

    def round_trip(self, words: list[str]) -> list[tuple[bytes, bytes]]:
        """Ids of each word, and the bytes that they decode to."""
        coded = self.encode_words(words)
        return list(zip(coded, self.decode_words(coded), strict=True))


@lru_cache(maxsize=1)
def _codec(path: str, pattern: str) -> Codec:
    """One for all tasks of a Python worker: the words that it knows stay."""
    return Codec(path, pattern)


def encoded(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers) and decoded (bytes) of each text.

    A null or empty text has no ids. A repeated row gives a repeated row; other columns are ignored; an
    empty table gives an empty result.
    """
    path = path or vocabulary()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path, pattern)
        for batch in batches:
            offsets, _ = text.utf8(batch.column("text"))
            for i, j in text.slices(offsets, SLICE):
                both = codec.texts.joined([t or "" for t in batch.column("text").slice(i, j - i).to_pylist()])
                columns = [pa.array(c, pa.binary()) for c in zip(*both, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), *columns], ["doc_id", "ids", "decoded"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(encode, "doc_id long, ids binary, decoded binary")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each text; cases as in encoded()."""
    return encoded(docs, path).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )
