"""Quality rules: statistics of whole texts and a decision list learned from labelled ones, all in Spark expressions.

Statistics are one projection over the text. The list is learned by sequential covering: a sample of labelled
rows of bounded size is summed into cells of quantile bins, and over these cells a conjunction of thresholds
grows by the condition with the best gain, is pruned on cells held back from growing, joins the list if
it is precise enough, and takes what it covers out of the cells. The list is emitted as ordered
conditional expressions; the default verdict is to keep.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratlens.llm import shared

SEPARATORS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
COUNTS = (
    "n_words", "n_distinct_words", "n_repeat_words", "word_chars", "n_symbols", "n_exclamations", "n_capitals", "n_lines", "n_dup_lines",
)
# At most about this many labelled rows are used for learning.
SAMPLE, BINS = 20_000, 16
PRECISION, LEAST_COVERED, MOST_CONDITIONS, MOST_RULES = 0.9, 20, 3, 12


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body with value evaluated once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _without(column: Column, characters: str) -> Column:
    return reduce(lambda c, x: F.replace(c, F.lit(x), F.lit("")), characters, column)


def _repeated_words(windows: Column) -> Column:
    """Words in windows that occur twice or more, from the hashes of all windows in order."""

    def covered(pairs: Column) -> Column:
        twice = F.filter(
            pairs,
            lambda x, i: ((i > 0) & (F.get(pairs, i - 1)["h"] == x["h"]))
            | ((i < F.size(pairs) - 1) & (F.get(pairs, i + 1)["h"] == x["h"])),
        )
        return _let(
            F.sort_array(F.transform(twice, lambda x: x["i"])),
            lambda at: F.aggregate(
                F.transform(at, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - x, F.lit(WINDOW)))),
                F.lit(0), lambda total, x: total + x,
            ),
        )

    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    some = F.size(F.array_distinct(windows)) < F.size(windows)
    return F.when(some, _let(pairs, covered)).otherwise(0)


def statistics(text: Column) -> Column:
    """A struct of whole-text counts. A null text counts as empty."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))

    def with_words(words: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(words) - (WINDOW - 1))
        windows = F.when(
            F.size(words) >= WINDOW, F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, F.lit(WINDOW))))
        ).otherwise(F.array().cast("array<bigint>"))
        fields = {
            "n_words": F.size(words),
            "n_distinct_words": F.size(F.array_distinct(words)),
            "n_repeat_words": _let(windows, _repeated_words),
            "word_chars": F.length(_without(text, SEPARATORS)),
            "n_symbols": F.octet_length(text) - F.octet_length(_without(text, SYMBOLS)),
            "n_exclamations": F.octet_length(text) - F.octet_length(_without(text, "!")),
            "n_capitals": F.regexp_count(text, F.lit(r"[A-ZÀ-ÖØ-Þ]")),
            "n_lines": F.size(lines),
            "n_dup_lines": _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))),
        }
        return F.struct(*[c.cast("long").alias(name) for name, c in fields.items()])

    return _let(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), ""), with_words)


def base_failed(within: str = "") -> Column:
    """By the counts in columns, or in fields of the struct that within names (with a dot at its end)."""
    words = F.col(f"{within}n_words")
    return (words < 10) | (100 * F.col(f"{within}n_repeat_words") > 20 * words)


def features(within: str = "") -> dict[str, Column]:
    """What conditions compare: shares in a thousand and means, from the counts."""
    count = {name: F.col(within + name) for name in COUNTS}
    words, chars, lines = (F.greatest(count[n], F.lit(1)) for n in ("n_words", "word_chars", "n_lines"))
    return {
        "n_words": count["n_words"].cast("double"),
        "symbols": 1000.0 * count["n_symbols"] / chars,
        "exclamations": 1000.0 * count["n_exclamations"] / words,
        "capitals": 1000.0 * count["n_capitals"] / chars,
        "repeated": 1000.0 * count["n_repeat_words"] / words,
        "distinct": 1000.0 * count["n_distinct_words"] / words,
        "dup_lines": 1000.0 * count["n_dup_lines"] / lines,
        "word_length": count["word_chars"] / words,
        "line_words": count["n_words"] / lines,
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self, within: str = "") -> Column:
        value = features(within)[self.feature]
        return value > self.threshold if self.above else value <= self.threshold


# A cell: the bin of each feature, good and bad rows to grow on, and good and bad rows to prune on.
Cell = tuple[dict[str, int], int, int, int, int]


def _fits(cell: Cell, rule: list[tuple[str, bool, int]]) -> bool:
    return all((cell[0][name] > at) == above for name, above, at in rule)


def _precision(bad: int, good: int) -> float:
    return (bad + 1) / (bad + good + 2)


def _grow(cells: list[Cell], names: list[str], bins: dict[str, int]) -> list[tuple[str, bool, int]]:
    rule: list[tuple[str, bool, int]] = []
    inside = cells
    while len(rule) < MOST_CONDITIONS:
        bad, good = sum(c[2] for c in inside), sum(c[1] for c in inside)
        if not good:
            break
        best, gain = None, 1e-9
        for name in names:
            counts = [[0, 0] for _ in range(bins[name] + 1)]
            for c in inside:
                counts[c[0][name]][0] += c[2]
                counts[c[0][name]][1] += c[1]
            below_bad = below_good = 0
            for at in range(bins[name]):
                below_bad, below_good = below_bad + counts[at][0], below_good + counts[at][1]
                for above, b, g in ((False, below_bad, below_good), (True, bad - below_bad, good - below_good)):
                    if b:
                        value = b * (math.log2(_precision(b, g)) - math.log2(_precision(bad, good)))
                        if value > gain + 1e-9:
                            best, gain = (name, above, at), value
        if best is None:
            break
        rule.append(best)
        inside = [c for c in inside if _fits(c, [best])]
    return rule


def _prune(rule: list[tuple[str, bool, int]], cells: list[Cell]) -> list[tuple[str, bool, int]]:
    """Drop conditions, last first, as long as precision on the cells held back does not fall."""

    def worth(r: list[tuple[str, bool, int]]) -> float:
        held = [c for c in cells if _fits(c, r)]
        return _precision(sum(c[4] for c in held), sum(c[3] for c in held))

    for condition in reversed(rule):
        shorter = [c for c in rule if c != condition]
        if shorter and worth(shorter) >= worth(rule):
            rule = shorter
    return rule


def _sampled(labels: DataFrame, sample: int) -> DataFrame:
    """doc_id and quality of about sample usable labels at most, chosen by a hash of doc_id."""
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    labels = labels.where("quality in (0, 1) and doc_id is not null").dropDuplicates(["doc_id"])
    share = min(1.0, sample / max(labels.count(), 1))
    return labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share * 1_000_000)


def learn(stats: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[list[Condition]]:
    """Conjunctions, in order, that reject a text. stats: doc_id and counts; labels: doc_id and quality (0 or 1).

    Rows without a label, with a null label, or that fail the base rule do not count. No usable rows: no rules.
    """
    values = features()
    rows = stats.where(~base_failed()).join(_sampled(labels, sample), "doc_id").select(
        "quality", (F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(3)) == 0).alias("held"), *[c.alias(n) for n, c in values.items()]
    )
    rows = shared.cut(rows)
    cuts = [k / BINS for k in range(BINS + 1)]
    quantiles = rows.groupBy("quality").agg(
        *[F.percentile_approx(n, F.lit(cuts), F.lit(1000)).alias(n) for n in values]
    ).collect()
    # Midway between neighbouring quantiles of either class.
    points = {n: sorted({x for q in quantiles for x in q[n]}) for n in values}
    thresholds = {n: [(a + b) / 2 for a, b in zip(p, p[1:], strict=False)] for n, p in points.items()}
    names = [n for n in values if thresholds[n]]
    if not names:
        return []
    binned = [reduce(lambda a, b: a + b, [(F.col(n) > t).cast("int") for t in thresholds[n]]).alias(n) for n in names]
    cells: list[Cell] = [
        ({n: r[n] for n in names}, r["good"], r["bad"], r["held_good"], r["held_bad"])
        for r in rows.select("quality", "held", *binned).groupBy(*names).agg(
            *[
                F.count_if((F.col("quality") == quality) & (F.col("held") == held)).alias(name)
                for name, quality, held in (("good", 1, False), ("bad", 0, False), ("held_good", 1, True), ("held_bad", 0, True))
            ]
        ).collect()
    ]
    bins, rules = {n: len(thresholds[n]) for n in names}, []
    while len(rules) < MOST_RULES:
        rule = _prune(_grow(cells, names, bins), cells)
        covered = [c for c in cells if rule and _fits(c, rule)]
        bad, good = sum(c[2] + c[4] for c in covered), sum(c[1] + c[3] for c in covered)
        if bad < LEAST_COVERED or _precision(bad, good) < PRECISION:
            break
        rules.append([Condition(name, above, float(thresholds[name][at])) for name, above, at in rule])
        cells = [c for c in cells if not _fits(c, rule)]
    return rules


def verdict(rules: list[list[Condition]], within: str = "") -> Column:
    """Keep, unless a rule of the list rejects."""
    column = F.lit(True)
    for rule in reversed(rules):
        column = F.when(reduce(lambda a, b: a & b, [c.column(within) for c in rule]), F.lit(False)).otherwise(column)
    return column


def _statistics(docs: DataFrame) -> DataFrame:
    stats = docs.select(F.col("doc_id").cast("long").alias("doc_id"), statistics(F.col("text")).alias("s")).select("doc_id", "s.*")
    return shared.table(stats, "statistics")


def accepted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs, with all their columns, that judged() keeps. The verdict reads the row itself, not its id.

    Rules need the counts of the sampled labels' texts only; every text is counted once, for its verdict.
    """
    ids = shared.small(shared.cut(_sampled(labels, sample).select(F.col("doc_id").alias("sampled_id"))), 2 * SAMPLE)
    learned = docs.select("doc_id", "text").join(ids, F.col("doc_id").cast("long") == F.col("sampled_id"), "left_semi")
    found = learn(_statistics(learned), labels, sample)
    name = f"statistics_{uuid.uuid4().hex}"
    keep = ~base_failed(f"{name}.") & verdict(found, f"{name}.")
    return docs.withColumn(name, statistics(F.col("text"))).where(keep).drop(name)


def judged(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, counts, base_failed and kept for each row of docs (doc_id, text).

    A null or empty text has zero words and fails the base rule. Repeated rows are judged alike, a null doc_id as any
    other; other columns are ignored; an empty table gives an empty result; without labels the base rule
    decides alone.
    """
    stats = _statistics(docs)
    kept = ~base_failed() & verdict(learn(stats, labels, sample))
    return stats.select("*", base_failed().alias("base_failed"), kept.alias("kept"))
