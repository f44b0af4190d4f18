"""Near-duplicate vectors by hierarchical navigable small-world graphs.

Equal vectors of a label are one class with a count. The classes of a label are dealt by a hash to shards of about NUMBERS
vector components, which bounds a graph's memory whatever the vectors' length; every shard gets a graph, and every shard's
vectors are queried against every shard of the label, in blocks of QUERIES that go to the graph without their own
one, each two shards once. A search walks the graph with a beam and then spreads over everything it finds at or above the
threshold. The beam of a block is widened until an audit, a brute-force search for some of its queries, finds no link
that the graph missed; a beam as wide as the shard is replaced by the exhaustive search. Links are
verified by cosines in double precision. A block sends link counts and a spanning forest, never its pairs.
"""

from __future__ import annotations

import heapq
import math
import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratlens.llm import shared

THRESHOLD, NUMBERS, QUERIES, DEGREE, BUILD_BEAM, BEAM, AUDIT = 0.98, 1 << 21, 4096, 12, 48, 24, 12
INDEX = "label string, shard int, part int, data binary"  # part -1: the graph, else a block of its vectors
FOUND = "rep long, links long, other long"
ROWS = 512  # queries whose pairs are held and audited at a time


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision. The largest component is divided out first."""
    wide = vectors.astype(np.float64)
    wide = wide / np.abs(wide).max(axis=1, keepdims=True)
    return wide / np.sqrt((wide * wide).sum(axis=1, keepdims=True))


class Graph:
    """Layers of neighbour lists over unit vectors; similarity is the inner product."""

    def __init__(self, vectors: np.ndarray, seed: int = 0, degree: int = DEGREE, beam: int = BUILD_BEAM):
        self.vectors, self.degree = vectors.astype(np.float32), degree
        draws = np.random.default_rng(seed).random(len(vectors))
        self.levels = (-np.log(1 - draws) / math.log(degree)).astype(int).tolist()
        self.layers: list[dict[int, list[int]]] = []
        self.entry = -1
        for node in range(len(vectors)):
            self._insert(node, beam)

    def _insert(self, node: int, beam: int) -> None:
        level, top, query = self.levels[node], len(self.layers) - 1, self.vectors[node]
        near = [self.entry] if top >= 0 else []
        for layer in range(top, level, -1):
            near = [self._search(query, near, 1, layer)[0][1]]
        for layer in range(min(top, level), -1, -1):
            found = self._search(query, near, beam, layer)
            near = [n for _, n in found]
            links, most = self.layers[layer], self.degree * (2 if layer == 0 else 1)
            links[node] = self._diverse(found, self.degree)
            for other in links[node]:
                own = links[other]
                own.append(node)
                if len(own) > most:
                    scores = (self.vectors[own] @ self.vectors[other]).tolist()
                    links[other] = self._diverse(sorted(zip(scores, own, strict=True), reverse=True), most)
        for _ in range(top, level):
            self.layers.append({node: []})
            self.entry = node

    def _diverse(self, found: list[tuple[float, int]], most: int) -> list[int]:
        """Neighbours nearer to the node than to one another come first; the nearest others fill up."""
        nodes = [n for _, n in found]
        rows = self.vectors[nodes]
        among = rows @ rows.T
        kept: list[int] = []
        for k, (score, _) in enumerate(found):
            if len(kept) == most:
                break
            if not kept or among[k, kept].max() < score:
                kept.append(k)
        if len(kept) < most:
            taken = set(kept)
            kept += [k for k in range(len(nodes)) if k not in taken][: most - len(kept)]
        return [nodes[k] for k in kept]

    def _search(self, query: np.ndarray, entries: list[int], beam: int, layer: int, least: float = 2.0) -> list[tuple[float, int]]:
        """The beam's best, best first; what is at or above least neither ends the walk nor takes a place of the beam."""
        links, seen = self.layers[layer], set(entries)
        scores = (self.vectors[entries] @ query).tolist()
        open_, best, kept = [], [], []

        def take(score: float, node: int) -> None:
            heapq.heappush(open_, (-score, node))
            if score >= least:
                kept.append((score, node))
            else:
                heapq.heappush(best, (score, node))
                if len(best) > beam:
                    heapq.heappop(best)

        for score, node in zip(scores, entries, strict=True):
            take(score, node)
        while open_:
            score, node = heapq.heappop(open_)
            if len(best) >= beam and -score < best[0][0] and -score < least:
                break
            new = [n for n in links[node] if n not in seen]
            if not new:
                continue
            seen.update(new)
            for value, n in zip((self.vectors[new] @ query).tolist(), new, strict=True):
                if len(best) < beam or value > best[0][0] or value >= least:
                    take(value, n)
        return sorted(kept + best, reverse=True)

    def above(self, query: np.ndarray, least: float, beam: int) -> list[int]:
        """Nodes found with a similarity of at least least."""
        query, near = query.astype(np.float32), [self.entry]
        for layer in range(len(self.layers) - 1, 0, -1):
            near = [self._search(query, near, 1, layer)[0][1]]
        return [n for s, n in self._search(query, near, beam, 0, least) if s >= least]


def linked_pairs(
    queries: np.ndarray, graph: Graph, units: np.ndarray, threshold: float = THRESHOLD, beam: int = BEAM, audit: int = AUDIT
) -> tuple[np.ndarray, np.ndarray, int]:
    """Rows of queries and of the graph (its unit vectors) whose cosine reaches threshold, and the beam that passed the audit."""
    loose = threshold - 1e-4  # the walk is in single precision
    checked = np.unique(np.linspace(0, len(queries) - 1, min(audit, len(queries))).astype(int))
    truth = {int(k): set(np.flatnonzero(units @ queries[k] >= threshold).tolist()) for k in checked}
    while beam < len(units):
        missed = any(truth[k] - set(graph.above(queries[k], loose, beam)) for k in truth)
        if not missed:
            found = [graph.above(q, loose, beam) for q in queries]
            rows = np.repeat(np.arange(len(queries)), [len(f) for f in found])
            nodes = np.array([n for f in found for n in f], np.int64)
            break
        beam *= 2
    else:
        rows, nodes = np.nonzero(queries @ units.T >= loose)
    exact, step = np.zeros(len(rows), bool), max(1, NUMBERS // units.shape[1])
    for k in range(0, len(rows), step):
        some = slice(k, k + step)
        exact[some] = np.einsum("ij,ij->i", queries[rows[some]], units[nodes[some]]) >= threshold
    return rows[exact], nodes[exact], beam


def _build(queries: int):
    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rep")
        raw = np.stack([np.asarray(v, np.float64) for v in pdf["vector"]])
        units = unit(raw)
        graph = Graph(units)
        if (raw == raw.astype(np.float32)).all():
            raw = raw.astype(np.float32)
        rep, copies = pdf["rep"].to_numpy(), pdf["copies"].to_numpy()
        parts = [(-1, pickle.dumps((rep, copies, raw, graph.layers, graph.levels, graph.entry)))]
        for part, k in enumerate(range(0, len(pdf), queries)):
            block = slice(k, k + queries)
            parts.append((part, pickle.dumps((rep[block], copies[block], raw[block]))))
        out = pd.DataFrame(parts, columns=["part", "data"])
        return out.assign(label=pdf["label"].iloc[0], shard=pdf["shard"].iloc[0])[["label", "shard", "part", "data"]]

    return build


def _load(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, Graph]:
    rep, copies, raw, layers, levels, entry = pickle.loads(data)
    units = unit(raw)
    graph = Graph.__new__(Graph)
    graph.vectors, graph.degree = units.astype(np.float32), DEGREE
    graph.layers, graph.levels, graph.entry = layers, levels, entry
    return rep, copies, units, graph


def _query(threshold: float, queries: int):
    def query(pdf: pd.DataFrame) -> pd.DataFrame:
        rep, copies, raw = pickle.loads(pdf["block"].iloc[0])
        units = unit(raw)
        other_rep, other_copies, other_units, graph = _load(pdf["graph"].iloc[0])
        same, first = pdf["p"].iloc[0] == pdf["q"].iloc[0], int(pdf["part"].iloc[0]) * queries
        left, right, beam, out = np.zeros(len(units)), np.zeros(len(other_units)), BEAM, []
        root: dict[int, int] = {}

        def find(x: int) -> int:
            root.setdefault(x, x)
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for k in range(0, len(units), ROWS):
            rows, nodes, beam = linked_pairs(units[k : k + ROWS], graph, other_units, threshold, beam)
            rows += k
            if same:
                # Each unordered pair once: inside these ROWS found from either end, else from the rows that come first.
                ends = rows + first
                wanted = (nodes >= first + k) & (nodes != ends)
                low, high = np.minimum(ends, nodes)[wanted], np.maximum(ends, nodes)[wanted]
                pairs = np.unique(low * len(other_rep) + high)
                rows, nodes = pairs // len(other_rep) - first, pairs % len(other_rep)
            left += np.bincount(rows, weights=other_copies[nodes], minlength=len(units))
            right += np.bincount(nodes, weights=copies[rows], minlength=len(other_units))
            for a, b in zip(rep[rows].tolist(), other_rep[nodes].tolist(), strict=True):
                x, y = find(a), find(b)
                if x != y:
                    root[y] = x
                    out.append((a, 0, b))
        for reps, counts in ((rep, left), (other_rep, right)):
            out += [(r, int(c), None) for r, c in zip(reps.tolist(), counts.tolist(), strict=True) if c]
        return pd.DataFrame(out, columns=["rep", "links", "other"]).astype({"rep": "int64", "links": "int64", "other": "Int64"})

    return query


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, numbers: int = NUMBERS, queries: int = QUERIES) -> DataFrame:
    """vec_id, n_links, component_id and kept for each row of vectors (vec_id, embedding, label).

    Two rows are linked if their labels are equal and their cosine is at least threshold. A row links with nothing if
    its id, label or vector is null, or the vector is empty, zero, or holds a null or a number that is not finite; vectors
    of different lengths never link. Equal rows link with one another. Other columns are ignored; an empty
    table gives an empty result.
    """
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"),
        F.col("embedding").cast("array<double>").alias("vector"),
    )
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(
        finite & F.exists("vector", lambda x: x != 0), F.lit(False)
    )
    good = rows.where(usable)
    classes = good.groupBy("label", "vector").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    classes = shared.table(classes.withColumn("kind", F.concat_ws("/", F.size("vector"), "label")), "classes")
    shards = F.ceil(F.sum(F.size("vector").cast("long")) / numbers).cast("int")
    sizes = shared.cut(classes.groupBy("kind").agg(shards.alias("shards")))
    graphs = sizes.agg(F.coalesce(F.sum("shards"), F.lit(0))).first()[0]
    dealt = classes.join(shared.small(sizes), "kind").withColumn(
        "shard", F.pmod(F.xxhash64("rep", F.lit(9)), F.col("shards")).cast("int")
    )
    dealt = dealt.select(F.col("kind").alias("label"), "shard", "rep", "copies", "vector")
    # Groups are small in bytes and long in time: as many partitions as groups, which Spark does not put together.
    dealt = dealt.repartition(max(1, 2 * graphs), "label", "shard")
    index = shared.table(dealt.groupBy("label", "shard").applyInPandas(_build(queries), INDEX), "graphs")
    spots = sizes.select(F.col("kind").alias("label"), "shards", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("p"))
    spots = spots.select("label", "p", F.explode(F.sequence(F.col("p"), F.col("shards") - 1)).alias("q"))
    blocks = index.where("part >= 0").select("label", F.col("shard").alias("p"), "part", F.col("data").alias("block"))
    walks = index.where("part < 0").select("label", F.col("shard").alias("q"), F.col("data").alias("graph"))
    # One group per block and graph; a block holds no graph of its own.
    met = spots.join(blocks, ["label", "p"]).join(walks, ["label", "q"])
    met = met.repartition(max(1, 4 * graphs), "label", "p", "part", "q")
    found = met.groupBy("label", "p", "part", "q").applyInPandas(_query(threshold, queries), FOUND)
    found = shared.table(found, "links")
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    links = found.where("other is not null").select(F.col("rep").alias("a"), F.col("other").alias("b"))
    roots = shared.connected_components(links)
    known = classes.join(counts, "rep", "left").join(roots.withColumnRenamed("id", "rep"), "rep", "left").select(
        "label", "vector", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component", "rep").alias("class_component"),
    )
    # Unusable rows have no partner in the join: their label becomes null.
    keyed = rows.withColumn("label", F.when(usable, F.col("label")))
    component = F.coalesce("class_component", "vec_id")
    return keyed.join(known, ["label", "vector"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )
