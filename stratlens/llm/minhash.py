"""Near-duplicate documents by b-bit MinHash.

One pass over the texts makes each document's sorted set of shingle hashes, its digest, 128 minima, the
keys of 25 bands of five minima, and a signature of the minima's two low bits, packed into two bit
planes. Documents with equal sets form a class at once (a grouping by digest). Class representatives
that share a band are candidates; equal bits of two signatures, counted by bit_count and corrected for
the chance that low bits agree by accident, estimate the similarity; what may reach the threshold
is confirmed on the full sets.

A band bucket of up to SMALL representatives is paired by a join that keeps only pairs whose estimate
passes. A larger one is dealt into blocks of about BLOCK rows, and every pair of blocks is one group:
there each pair of rows is estimated with one matrix operation, confirmed on full sets unless both
ends are already connected, and a spanning forest of the links is emitted. No bucket is cut and no
candidate dropped; an edge between already connected documents cannot change a component.

Chances of missing a pair of similarity exactly 0.85: 4e-7 by the bands, 3e-7 by the estimate; of exactly
0.80: 5e-5 and 3e-7.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratlens.llm import shared, text
from stratlens.operators.joins import salted_join

HASHES, BITS, BANDS, ROWS = 128, 2, 25, 5
SMALL, BLOCK, SALTS = 48, 128, 16
PERCENT = 85

_A = text.randoms(HASHES, 11).astype(np.uint32) | np.uint32(1)
_B = text.randoms(HASHES, 12).astype(np.uint32)
_BAND = text.randoms(BANDS * ROWS, 13) | np.uint64(1)

FEATURES = "doc_id long, text_key string, n_shingles long, digest binary, s0 long, s1 long, s2 long, s3 long, bands array<long>"


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """128 minima of 32-bit hashes for each non-empty set."""
    starts = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1])).astype(np.int64)
    x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(sets), HASHES), np.uint32)
    for k in range(HASHES):
        out[:, k] = np.minimum.reduceat(x * _A[k] + _B[k], starts)
    return out


def signatures(mins: np.ndarray) -> np.ndarray:
    """(rows, 4) integers: 128 low bits, then 128 second bits of the spread minima."""
    spread = text.mix(mins.astype(np.uint64) + np.arange(HASHES, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    planes = [np.packbits((spread >> np.uint64(bit)) & np.uint64(1) == 1, axis=1).view("<u8") for bit in range(BITS)]
    return np.hstack(planes)


def band_keys(mins: np.ndarray) -> np.ndarray:
    """(rows, 25) integers; the key also holds the band's number."""
    wide = mins[:, : BANDS * ROWS].astype(np.uint64) + np.uint64(1)
    sums = (text.mix(wide * _BAND) * _BAND[::-1]).reshape(len(mins), BANDS, ROWS).sum(axis=2, dtype=np.uint64)
    return text.mix(sums + np.arange(BANDS, dtype=np.uint64))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        offsets, data = text.utf8(batch.column("text"))
        for i, j in text.slices(offsets):
            sets = text.shingle_sets(offsets[i : j + 1], data)
            full = [k for k, s in enumerate(sets) if len(s)]
            sig, keys = np.zeros((len(sets), 4), np.uint64), np.zeros((len(sets), BANDS), np.uint64)
            if full:
                mins = minima([sets[k] for k in full])
                sig[full], keys[full] = signatures(mins), band_keys(mins)
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS), pa.array(keys.reshape(-1).view(np.int64))
            )
            planes = [pa.array(np.ascontiguousarray(sig[:, k]).view(np.int64)) for k in range(4)]
            digest = pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())
            n = pa.array([len(s) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(i, j - i), batch.column("text_key").slice(i, j - i), n, digest, *planes, lists],
                ["doc_id", "text_key", "n_shingles", "digest", "s0", "s1", "s2", "s3", "bands"],
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        offsets, data = text.utf8(batch.column("text"))
        for i, j in text.slices(offsets):
            sets = text.shingle_sets(offsets[i : j + 1], data)
            ends = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), lists], ["rep", "shingles"])


def estimate(left: str, right: str) -> Column:
    """Similarity from the share of equal two-bit minima, corrected for accidental agreement."""
    differing = [
        F.bit_count(
            F.col(f"{left}.s{k}").bitwiseXOR(F.col(f"{right}.s{k}"))
            .bitwiseOR(F.col(f"{left}.s{k + 2}").bitwiseXOR(F.col(f"{right}.s{k + 2}")))
        )
        for k in range(2)
    ]
    chance = 0.5**BITS
    return ((1 - (differing[0] + differing[1]) / HASHES) - chance) / (1 - chance)


def least_estimate(percent: int) -> float:
    """Five standard deviations of the estimate below the threshold."""
    chance = 0.5**BITS
    equal = chance + (1 - chance) * percent / 100
    return percent / 100 - 5 * math.sqrt(equal * (1 - equal) / HASHES) / (1 - chance)


def linked(common: np.ndarray | int, n: np.ndarray | int, m: np.ndarray | int, percent: int) -> np.ndarray | bool:
    return 100 * common >= percent * (n + m - common)


def _block_links(percent: int):
    least = least_estimate(percent)

    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        band = int(pdf["band"].iloc[0])
        pdf = pdf.drop_duplicates("rep").reset_index(drop=True)
        n, rep, side = pdf["n_shingles"].to_numpy(), pdf["rep"].to_numpy(), pdf["block"].to_numpy()
        sig = pdf[["s0", "s1", "s2", "s3"]].to_numpy().view(np.uint64)
        keys = np.stack(pdf["bands"].to_numpy())
        sets = pdf["shingles"].to_numpy()
        root = np.arange(len(pdf))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        chance, out = 0.5**BITS, []
        one_block = side.min() == side.max()
        rows = np.arange(len(pdf)) if one_block else np.flatnonzero(side == side.min())
        others = np.arange(len(pdf)) if one_block else np.flatnonzero(side == side.max())
        for x in rows:
            to = others[others > x] if one_block else others
            xor = sig[to] ^ sig[x]
            differing = np.bitwise_count(xor[:, :2] | xor[:, 2:]).sum(axis=1)
            alike = ((1 - differing / HASHES) - chance) / (1 - chance)
            # A pair is handled in the first band that it shares.
            new = (alike >= least) & ~(keys[to, :band] == keys[x, :band]).any(axis=1)
            new &= 100 * np.minimum(n[to], n[x]) >= percent * np.maximum(n[to], n[x])
            for y in to[new][np.argsort(-alike[new], kind="stable")]:
                if find(x) == find(y):
                    continue
                both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                if linked(both, n[x], n[y], percent):
                    root[find(y)] = find(x)
                    out.append((rep[x], rep[y]))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return links


def text_key() -> Column:
    return F.md5(F.coalesce("text", F.lit("")).cast("binary"))


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id and kept for each row of docs (doc_id, text; more columns are ignored).

    Two documents are linked if the shingles they share are at least percent of those of either one.
    Nulls and empty texts have no shingles and stay alone; fewer than five words count as one shingle;
    a repeated row falls into the class of its equals, and rows of one doc_id are kept together. A null
    doc_id is no representative: such a row is kept only if no row with an id has its set.
    An empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("text_key", text_key())
    rows = shared.table(docs.mapInArrow(_features, FEATURES), "minhash")
    full = rows.where("n_shingles > 0")
    # A class is a distinct set; its number is its id, as one doc_id may stand on several texts.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("lost"), "doc_id", "text_key")).alias("first")
    classes = full.groupBy("digest").agg(first).select("digest", F.col("first.doc_id").alias("own_id"), F.col("first.text_key").alias("own_key"))
    classes = shared.table(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    own = F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("text_key") == F.col("own_key"))
    signed = (
        full.withColumnRenamed("digest", "own").join(classes, own & (F.col("own") == F.col("digest")))
        .drop("own", "digest", "doc_id", "text_key", "own_id", "own_key").dropDuplicates(["rep"])
    )
    signed = shared.table(signed, "representatives")
    banded = signed.select("rep", F.posexplode("bands").alias("band", "key"))
    buckets = banded.groupBy("band", "key").agg(F.count("*").alias("size")).where("size > 1")
    members = shared.cut(banded.join(buckets, ["band", "key"]))

    wanted = members.select("rep").distinct()
    asked = classes.join(wanted, "rep").select("own_id", "own_key", "rep")
    sets = docs.join(asked, own).select(F.col("rep").alias("doc_id"), "text").mapInArrow(_sets, "rep long, shingles array<long>")
    sets = shared.table(sets, "sets")
    signs = signed.select("rep", "n_shingles", "s0", "s1", "s2", "s3")

    few = members.where(F.col("size") <= SMALL).join(signs, "rep")
    pairs = (
        few.alias("l").join(
            few.alias("r"),
            (F.col("l.band") == F.col("r.band")) & (F.col("l.key") == F.col("r.key")) & (F.col("l.rep") < F.col("r.rep"))
            & (100 * F.least("l.n_shingles", "r.n_shingles") >= percent * F.greatest("l.n_shingles", "r.n_shingles"))
            & (estimate("l", "r") >= least_estimate(percent)),
        ).select(F.col("l.rep").alias("a"), F.col("r.rep").alias("b")).distinct()
    )
    both = F.size(F.array_intersect("left", "right"))
    confirmed = (
        pairs.join(sets.select(F.col("rep").alias("a"), F.col("shingles").alias("left")), "a")
        .join(sets.select(F.col("rep").alias("b"), F.col("shingles").alias("right")), "b")
        .where(100 * both >= percent * (F.size("left") + F.size("right") - both)).select("a", "b")
    )

    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    many = (
        members.where(F.col("size") > SMALL)
        .join(signed, "rep").join(sets, "rep")
        .withColumn("block", F.pmod(F.xxhash64("rep", F.lit(3)), blocks).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .withColumns({"p": F.least("block", "other"), "q": F.greatest("block", "other")}).drop("size", "other")
    )
    spanning = many.groupBy("band", "key", "p", "q").applyInPandas(_block_links(percent), "a long, b long")

    # Texts of one doc_id are one document.
    several = full.groupBy("doc_id").agg((F.min("digest") != F.max("digest")).alias("differ")).where("differ and doc_id is not null")
    texts = full.select("doc_id", "digest").join(several.select("doc_id"), "doc_id", "left_semi").distinct().join(classes, "digest")
    same = texts.join(texts.groupBy("doc_id").agg(F.min("rep").alias("lead")), "doc_id").select(F.col("lead").alias("a"), F.col("rep").alias("b"))

    roots = shared.connected_components(confirmed.union(spanning).union(same))
    linked_classes = classes.select("rep", "own_id").join(roots.withColumnRenamed("id", "rep"), "rep")
    ids = linked_classes.groupBy("component").agg(F.min("own_id").alias("class_id"))
    named = salted_join(linked_classes, ids, ["component"], salts=SALTS).select("rep", "class_id")
    labelled = classes.join(named, "rep", "left").select("digest", F.coalesce("class_id", "own_id").alias("class_id"))
    out = rows.select("doc_id", "text_key", "n_shingles", "digest").join(labelled, "digest", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("class_id")).otherwise(F.col("doc_id"))
    return out.select(
        "doc_id", "text_key", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept")
    )


def deduplicated(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of docs, with all their columns, that near_duplicates() keeps; of repeated rows one stays."""
    judged = shared.cut(near_duplicates(docs, percent).where("kept").groupBy("doc_id", "text_key").agg(F.count("*").alias("n")))
    own_id, own_key = (f"{c}_{uuid.uuid4().hex}" for c in ("id", "key"))
    mine = F.col("doc_id").cast("long").eqNullSafe(F.col(own_id)) & (text_key() == F.col(own_key))
    rows = docs.join(judged.select(F.col("doc_id").alias(own_id), F.col("text_key").alias(own_key)), mine, "left_semi")
    return rows if judged.where("n > 1").isEmpty() else rows.dropDuplicates(["doc_id", "text"])
