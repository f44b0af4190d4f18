"""Remove every byte that a repeated string of 400 bytes covers, by suffix arrays over candidate pieces.

1. Each distinct text (equal texts are one class; a class of two or more repeats as a whole) is cut by content:
   among the hashes of its 64-byte grams, the leftmost minimum of every 400-byte window is that window's
   anchor. The choice depends on the window's bytes only, so equal windows have equal anchors at equal places.
2. Only anchors that occur twice can belong to a repeated window. Around each stands a piece: the windows
   that chose it. Equal pieces are counted before they move; one of them stands for all.
3. Different pieces of one anchor are sorted together by two-stage suffix sorting: of the suffixes that start
   a window, only those smaller than their successors are compared directly; one scan over the buckets of
   first bytes puts every other suffix right after its successor; windows whose common prefix with a
   neighbour reaches 400 bytes are repeated.
4. An anchor with more than GROUP different pieces (the edge of a passage in very many documents) is never
   gathered: its windows are halved by their place around the anchor, and pieces are dealt anew by the bytes that
   all windows of a half share, until a group is small, its pieces are equal, or a half is one window.

What is compared is a text's bytes, or a code of eight bytes per word: there a repeated string of n words is one of 8 n
bytes, however long the words are and whatever white space stands between them.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratlens.llm import shared, text

LENGTH, GRAM, GROUP = 400, 64, 512
WORDS, CODE = 51, 8  # the shortest repeated string of words, and the bytes of a word's code
_BATCH = 250
_PLACE = 20
_BYTES = text.randoms(256, 21)
_STEPS = text.randoms(16, 22) | np.uint64(1)

SCAN = "doc_id long, key string, n_bytes long, size long, sha string, anchors array<long>, again array<boolean>"
PIECE = "key string, first int, anchor long, low int, high int, digest binary"
GROUPED = "grp binary, grid_low int, grid_high int, anchor long, digest binary, low int, high int, piece binary, seen binary"
RANGES = "anchor long, digest binary, ranges array<struct<low:int,high:int>>"


def gram_hashes(data: np.ndarray, size: int = GRAM) -> np.ndarray:
    """A hash of each size bytes (a power of two), by doubling."""
    h, step = _BYTES[data], 1
    while step < size:
        h = h[:-step] * _STEPS[step.bit_length()] + h[step:]
        step *= 2
    return text.mix(h)


def anchors(data: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and last window of each run of windows with one anchor, the anchor's place and its hash."""
    segment = 1 << (_PLACE - 1)
    if len(data) > 2 * segment:  # one long text: its windows in segments
        parts = []
        for start in range(0, len(data) - length + 1, segment):
            first, last, place, grams = anchors(data[start : start + segment + length - 1], length)
            parts.append((first + start, last + start, place + start, grams))
        return tuple(np.concatenate(column) for column in zip(*parts, strict=True))
    grams, width = gram_hashes(data), length - GRAM + 1
    places = np.arange(len(grams), dtype=np.uint64) & np.uint64((1 << _PLACE) - 1)
    order = (grams >> np.uint64(_PLACE) << np.uint64(_PLACE)) | places
    padded = np.concatenate((order, np.full(-len(order) % width, np.uint64(2**64 - 1)))).reshape(-1, width)
    ahead = np.minimum.accumulate(padded, axis=1).reshape(-1)
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    n = len(order) - width + 1
    least = np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])
    first = np.concatenate(([0], np.flatnonzero(least[1:] != least[:-1]) + 1))
    last = np.append(first[1:], n) - 1
    # The low bits are the place.
    place = first + ((least[first] - first.astype(np.uint64)) & np.uint64((1 << _PLACE) - 1)).astype(np.int64)
    return first, last, place, grams[place]


def suffix_order(pieces: list[bytes], counts: list[int], length: int) -> tuple[bytes, list[int], list[int]]:
    """Suffixes that start one of a piece's first windows, in the order of their first length bytes.

    Two-stage sorting. Gives the joined pieces, the sorted suffixes, and the piece's end for each byte.
    """
    data = b"".join(pieces)
    codes = np.frombuffer(data, np.uint8)
    sizes = np.array([len(p) for p in pieces])
    ends = np.cumsum(sizes)
    end_of = np.repeat(ends, sizes)
    at = np.arange(len(codes))
    # Smaller than its successor: the next different byte of the piece is larger. Up to the end: taken as smaller.
    change = np.append(codes[1:] != codes[:-1], True)
    change[ends - 1] = True
    turn = np.minimum.accumulate(np.where(change, at, len(codes))[::-1])[::-1]
    follower = codes[np.minimum(turn + 1, len(codes) - 1)]
    direct = (follower > codes) | (turn == end_of - 1)
    # Window starts, and behind the last one what its chain of larger suffixes needs.
    begins = ends - sizes
    wanted = at - np.repeat(begins, sizes) < np.repeat(np.array(counts), sizes)
    next_direct = np.minimum.accumulate(np.where(direct, at, len(codes))[::-1])[::-1]
    last_start = begins + np.array(counts) - 1
    for k in range(len(pieces)):
        wanted[last_start[k] : next_direct[last_start[k]] + 1] = True

    stop = end_of.tolist()
    chosen = np.flatnonzero(wanted & direct).tolist()
    chosen.sort(key=lambda i: data[i : min(i + length, stop[i])])
    larger = wanted & ~direct
    counts_larger = np.bincount(codes[larger], minlength=256)
    counts_direct = np.bincount(codes[wanted & direct], minlength=256)
    heads = np.cumsum(counts_larger + counts_direct) - counts_larger - counts_direct
    order = np.empty(int(wanted.sum()), np.int64)
    order[:] = -1
    slots = np.repeat(heads + counts_larger, counts_direct) + np.arange(len(chosen)) - np.repeat(
        np.cumsum(counts_direct) - counts_direct, counts_direct
    )
    order[slots] = chosen
    order, head, induced = order.tolist(), heads.tolist(), larger.tolist()
    for i in range(len(order)):
        before = order[i] - 1
        if before >= 0 and induced[before]:
            byte = data[before]
            order[head[byte]] = before
            head[byte] += 1
    return data, order, stop


def repeated(pieces: list[bytes], counts: list[int], length: int = LENGTH) -> list[np.ndarray]:
    """For each piece, which of its first windows occur twice or more among all windows of the pieces."""
    data, order, stop = suffix_order(pieces, counts, length)
    hit = np.zeros(len(data), bool)
    previous, before = None, -1
    for i in order:
        if i + length > stop[i]:
            continue
        window = data[i : i + length]
        if window == previous:
            hit[i] = hit[before] = True
        previous, before = window, i
    begins = np.cumsum([0, *map(len, pieces)])
    return [hit[b : b + c] for b, c in zip(begins, counts, strict=False)]


def _runs(hit: np.ndarray) -> tuple[list[int], list[int]]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
    return edges[::2].tolist(), (edges[1::2] - 1).tolist()


def _coded(words: bool, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What is compared of texts: their bytes as they are, or the codes of their words."""
    if not words:
        return offsets, data
    hashes, firsts = text.word_hashes(offsets, data, lower=False)
    return CODE * firsts, hashes.astype("<u8").view(np.uint8)


def _anchors_of_texts(offsets: np.ndarray, data: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """anchors() of each text, one after the other: the number for each text, then first, last, place and hash."""
    base = offsets[0]
    part = data[base : offsets[-1]]
    first = last = place = np.zeros(0, np.int64)
    grams = np.zeros(0, np.uint64)
    if len(part) >= length:
        first, last, place, grams = anchors(part, length)
    begins, ends = offsets[:-1] - base, offsets[1:] - base - length
    # Windows across two texts are not windows: clip the runs to each text.
    low = np.searchsorted(last, begins)
    high = np.where(ends >= begins, np.maximum(np.searchsorted(first, ends, "right"), low), low)
    counts = high - low
    take = np.repeat(low, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    start = np.repeat(begins, counts)
    clipped = np.maximum(first[take], start) - start, np.minimum(last[take], np.repeat(ends, counts)) - start
    return counts, *clipped, place[take] - start, grams[take].view(np.int64)


def _scan(length: int, words: bool):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = text.utf8(batch.column("text"))
            for i, j in text.slices(offsets):
                compared, codes = _coded(words, offsets[i : j + 1], data)
                counts, _, _, _, grams = _anchors_of_texts(compared, codes, length)
                once, again, n = [], [], []
                for part in np.split(grams, np.cumsum(counts)[:-1]):
                    values, times = np.unique(part, return_counts=True)
                    once.append(values)
                    again.append(times > 1)
                    n.append(len(values))
                bounds = pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32())
                lists = [pa.ListArray.from_arrays(bounds, pa.array(np.concatenate(c))) for c in (once, again)]
                sha = [hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(offsets[i:j], offsets[i + 1 : j + 1], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), batch.column("key").slice(i, j - i),
                     pa.array(np.diff(offsets[i : j + 1])), pa.array(np.diff(compared)), pa.array(sha, pa.string()), *lists],
                    ["doc_id", "key", "n_bytes", "size", "sha", "anchors", "again"],
                )

    return scan


def _emit(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def _cut_pieces(length: int, with_bytes: bool, words: bool):
    """Pieces around the anchors that a text is listed with; the bytes only on request."""
    schema = pa.schema(
        [("key", pa.string()), ("first", pa.int32()), ("anchor", pa.int64()), ("low", pa.int32()), ("high", pa.int32()),
         ("digest", pa.binary()), *([("piece", pa.binary())] if with_bytes else [])]
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = text.utf8(batch.column("text"))
            for i, j in text.slices(offsets):
                compared, codes = _coded(words, offsets[i : j + 1], data)
                counts, first, last, place, grams = _anchors_of_texts(compared, codes, length)
                at, rows, raw = 0, [], codes[compared[0] : compared[-1]].tobytes()
                for k, n in enumerate(counts.tolist()):
                    key, begin = batch["key"][i + k].as_py(), int(compared[k] - compared[0])
                    wanted = set(batch["anchors"][i + k].as_py())
                    own = zip(*(c[at : at + n].tolist() for c in (first, last, place, grams)), strict=True)
                    for a, b, p, anchor in own:
                        if anchor in wanted:
                            piece = raw[begin + a : begin + b + length]
                            digest = xxhash.xxh3_128_digest(piece, (a - p) & 0xFFFFFFFF)
                            rows.append((key, a, anchor, a - p, b - p, digest, *([piece] if with_bytes else [])))
                    at += n
                yield _emit(rows, schema)

    return cut


_GROUPED = pa.schema(
    [("grp", pa.binary()), ("grid_low", pa.int32()), ("grid_high", pa.int32()), ("anchor", pa.int64()), ("digest", pa.binary()),
     ("low", pa.int32()), ("high", pa.int32()), ("piece", pa.binary()), ("seen", pa.binary())]
)


def _halve(length: int):
    def halve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x in batch.to_pylist():
                middle = (x["grid_low"] + x["grid_high"]) // 2
                for grid_low, grid_high in ((x["grid_low"], middle), (middle + 1, x["grid_high"])):
                    low, high = max(x["low"], grid_low), min(x["high"], grid_high)
                    if low > high:
                        continue
                    piece = x["piece"][low - x["low"] : high - x["low"] + length]
                    core = piece[grid_high - low : grid_low - low + length]
                    grp = xxhash.xxh3_128_digest(core + x["grp"] + grid_low.to_bytes(4, "little", signed=True))
                    seen = xxhash.xxh3_128_digest(piece, low & 0xFFFFFFFF)
                    rows.append((grp, grid_low, grid_high, x["anchor"], x["digest"], low, high, piece, seen))
            yield _emit(rows, _GROUPED)

    return halve


def _sort_groups(length: int):
    schema = pa.schema(
        [("anchor", pa.int64()), ("digest", pa.binary()),
         ("ranges", pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32())])))]
    )

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, alike = [], []

        def close() -> None:
            """A group of one piece has no partner."""
            if len(alike) > 1:
                held.extend(alike)
            alike.clear()

        def flush() -> pa.RecordBatch:
            counts = [x["high"] - x["low"] + 1 for x in held]
            rows = []
            for x, hit in zip(held, repeated([x["piece"] for x in held], counts, length), strict=True):
                if hit.any():
                    low = x["low"]
                    rows.append((x["anchor"], x["digest"], [{"low": low + a, "high": low + b} for a, b in zip(*_runs(hit), strict=True)]))
            held.clear()
            return _emit(rows, schema)

        for batch in batches:
            for x in batch.to_pylist():
                if alike and x["grp"] != alike[0]["grp"]:
                    close()
                    if len(held) > _BATCH:
                        yield flush()
                alike.append(x)
        close()
        if held:
            yield flush()

    return sort


def _word_spans(data: bytes, spans: list[list[int]]) -> list[list[int]]:
    """Spans of whole words' codes as spans of bytes, from the first word's start to the last one's end."""
    inside = ~text.SEPARATOR[np.frombuffer(data, np.uint8)]
    edges = np.flatnonzero(np.diff(np.concatenate(([0], inside.view(np.int8), [0]))))
    starts, stops = edges[::2], edges[1::2]
    whole = [(-(-low // CODE), high // CODE) for low, high in spans]
    return [[int(starts[a]), int(stops[b - 1])] for a, b in whole if a < b]


def _outside(data: bytes, spans: list[list[int]]) -> bytes:
    parts, at = [], 0
    for low, high in spans:
        parts.append(data[at:low])
        at = high
    return b"".join([*parts, data[at:]])


def _characters(data: bytes, spans: list[list[int]]) -> list[list[int]]:
    """Spans widened to the characters that they touch."""
    out: list[list[int]] = []
    for low, high in spans:
        while low > 0 and low < len(data) and data[low] & 0xC0 == 0x80:
            low -= 1
        while high < len(data) and data[high] & 0xC0 == 0x80:
            high += 1
        if out and low < out[-1][1]:
            low = out.pop()[0]
        out.append([low, high])
    return out


def _shorten(length: int, words: bool):
    schema = pa.schema(
        [("key", pa.string()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary()), ("shorter", pa.string()),
         ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))]
    )

    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, document, found in zip(batch["key"], batch["text"], batch["found"], strict=True):
                data, spans = document.as_py().encode(), []
                for low, high in sorted((x["low"], x["high"] + length) for ranges in found.as_py() for x in ranges):
                    if spans and low <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], high)
                    else:
                        spans.append([low, high])
                spans = _word_spans(data, spans) if words else spans
                rows.append(
                    (key.as_py(), sum(b - a for a, b in spans), len(spans), _outside(data, spans),
                     _outside(data, _characters(data, spans)).decode(), [{"start": a, "stop": b} for a, b in spans])
                )
            yield _emit(rows, schema)

    return shorten


def _repeats(pieces: DataFrame, length: int, group: int) -> DataFrame:
    """anchor, digest and ranges (around the anchor) of the repeated windows of each distinct piece."""
    distinct = pieces.groupBy("anchor", "digest").agg(
        F.count("*").alias("copies"), F.first("low").alias("low"), F.first("high").alias("high"), F.first("piece").alias("piece")
    )
    distinct = shared.table(distinct, "pieces")
    whole = F.array(F.struct("low", "high"))
    found = distinct.where("copies > 1").select("anchor", "digest", whole.alias("ranges"))
    rows = distinct.select(
        F.col("anchor").cast("string").cast("binary").alias("grp"), F.lit(GRAM - length).alias("grid_low"),
        F.lit(0).alias("grid_high"), "anchor", "digest", "low", "high", "piece", F.col("digest").alias("seen"),
    )
    ready: list[DataFrame] = []
    while True:
        big = rows.groupBy("grp").agg(F.count("*").alias("size"), (F.min("seen") == F.max("seen")).alias("equal"))
        big = shared.cut(big.where(F.col("size") > group))
        if big.isEmpty():
            break
        marked = rows.join(shared.small(big), "grp")
        found = found.union(marked.where("equal").select("anchor", "digest", whole.alias("ranges")))
        ready.append(rows.join(shared.small(big.select("grp")), "grp", "left_anti"))
        rows = shared.table(marked.where("not equal").drop("size", "equal").mapInArrow(_halve(length), GROUPED), "halves")
    for more in ready:
        rows = rows.unionByName(more)
    ordered = rows.repartition("grp").sortWithinPartitions("grp")
    return found.union(ordered.mapInArrow(_sort_groups(length), RANGES))


def shortened(docs: DataFrame, length: int = LENGTH, group: int = GROUP, words: int | None = None) -> DataFrame:
    """One row per row of docs (doc_id, text): n_bytes, n_removed, n_spans, sha, kept (bytes), shorter (text) and spans.

    kept, shorter and spans are null where nothing is removed; a text that repeats as a whole keeps nothing and its
    spans are null. shorter leaves out each character that lost a byte.
    Bytes are removed if a string of length bytes that covers them starts at two places or more, in one
    document or several; a repeated row is a second place. With words, length does not count: the strings are words in a
    row, compared without the white space between them, and the bytes from the first word of a span to its last one are removed.
    Nulls count as empty, and texts shorter than
    length lose nothing. A null doc_id is allowed. Other columns are ignored; an empty table gives an empty result.
    """
    coded = words is not None
    length = CODE * words if coded else length
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    source = source.withColumn("key", F.md5(F.col("text").cast("binary")))
    scan = shared.table(source.mapInArrow(_scan(length, coded), SCAN), "anchors")
    classes = shared.cut(scan.groupBy("key").agg(F.count("*").alias("copies"), F.min("doc_id").alias("rep")))
    one = scan.join(classes.select("key", "rep"), "key").where(F.col("doc_id").eqNullSafe(F.col("rep")))
    places = one.select("key", "rep", F.inline(F.arrays_zip(F.col("anchors").alias("anchor"), F.col("again").alias("again"))))
    twice = places.groupBy("anchor").agg((F.count("*") + F.count_if("again")).alias("n")).where("n > 1").select("anchor")
    candidates = places.join(twice, "anchor").groupBy("key", "rep").agg(F.collect_list("anchor").alias("anchors"))
    texts = source.join(
        candidates.withColumnRenamed("key", "own"),
        F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("key") == F.col("own")),
    ).select("key", "text", "anchors")
    texts = shared.table(texts, "candidates")
    ranges = _repeats(texts.mapInArrow(_cut_pieces(length, True, coded), PIECE + ", piece binary"), length, group)
    pieces = texts.mapInArrow(_cut_pieces(length, False, coded), PIECE)
    # Ranges are around the anchor; first - low is the anchor's place in the text.
    at = F.col("first") - F.col("low")
    moved = F.transform("ranges", lambda r: F.struct((r["low"] + at).alias("low"), (r["high"] + at).alias("high")))
    spans = pieces.select("key", "first", "anchor", "low", "digest").join(ranges, ["anchor", "digest"]).select(
        "key", moved.alias("ranges")
    )
    found = spans.groupBy("key").agg(F.collect_list("ranges").alias("found"))
    changed = texts.select("key", "text").join(found, "key").mapInArrow(
        _shorten(length, coded), "key string, n_removed long, n_spans long, kept binary, shorter string, spans array<struct<start:long,stop:long>>"
    ).dropDuplicates(["key"])
    whole = (F.col("copies") > 1) & (F.col("size") >= length)
    gone = F.sha2(F.lit("").cast("binary"), 256)
    kept = F.when(whole, F.lit("").cast("binary")).otherwise(F.col("kept"))
    return (
        scan.select("doc_id", "key", "n_bytes", "size", "sha").join(classes.drop("rep"), "key").join(changed, "key", "left")
        .select(
            "doc_id", "key", "n_bytes",
            F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
            F.when(whole, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
            F.when(whole, gone).when(F.col("kept").isNotNull(), F.sha2("kept", 256)).otherwise(F.col("sha")).alias("sha"),
            kept.alias("kept"), F.when(whole, "").otherwise(F.col("shorter")).alias("shorter"), "spans",
        )
    )


def _with_changes(docs: DataFrame, changes: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """Rows of docs with what shortened() says of those that lose bytes (else nulls), and the names of these columns."""
    changed = changes.where("n_removed > 0").dropDuplicates(["doc_id", "key"])
    names = {c: f"{c}_{uuid.uuid4().hex}" for c in changed.columns}
    key = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(names["doc_id"])) & (key == F.col(names["key"]))
    return docs.join(changed.withColumnsRenamed(names), same, "left"), names


def digests(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and text (what is left of it) for each row of docs; cases as in shortened().

    A null text stays null.
    """
    changes = shortened(docs, length).select("doc_id", "key", "n_removed", "n_spans", "sha", "shorter")
    rows, new = _with_changes(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), changes)
    data = F.coalesce("text", F.lit("")).cast("binary")
    return rows.select(
        "doc_id", F.octet_length(data).cast("long").alias("n_bytes"), F.coalesce(new["n_removed"], F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce(new["n_spans"], F.lit(0).cast("long")).alias("n_spans"), F.coalesce(new["sha"], F.sha2(data, 256)).alias("kept_sha256"),
        F.coalesce(new["shorter"], "text").alias("text"),
    )


def without_repeats(docs: DataFrame, length: int = LENGTH, words: int | None = None) -> DataFrame:
    """The rows of docs, with all their columns; text (and n_chars, if there is one) without what shortened() removes."""
    rows, names = _with_changes(docs, shortened(docs, length, words=words).select("doc_id", "key", "n_removed", "shorter"))
    new = F.col(names["shorter"])
    columns = {"text": F.coalesce(new, F.col("text"))}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        columns["n_chars"] = F.when(new.isNull(), F.col("n_chars")).otherwise(F.length(new).cast(kind))
    return rows.select(*[columns[c].alias(c) if c in columns else F.col(f"`{c}`") for c in docs.columns])
