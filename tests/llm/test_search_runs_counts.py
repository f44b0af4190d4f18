"""Ranked search, periodic runs and token counts against brute force, and their defined results for odd rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stratlens.llm import periodic, ranking, transducer
from tests.llm.test_texts import ODD, empty, table

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def ranking_of(docs, items, top=10):
    """[(item_id, rank, doc_id, score)] of (doc_id, text) and (item_id, text) pairs."""
    counts = [(i, c) for i, c in ((i, Counter(terms(t))) for i, t in docs) if c]
    n, words = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(w for _, c in counts for w in c)
    out = []
    for item, text in {*items}:
        scored = []
        for i, c in counts:
            m = 100 - 75 + 75 * sum(c.values()) * n // words
            score = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 8 * m))
                for w in terms(text) if w in c
            )
            if score:
                scored.append((-score, i is None, i))
        out += [(item, k + 1, i, -s) for k, (s, _, i) in enumerate(sorted(scored)[:top])]
    return Counter(out)


def found(df):
    return Counter(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()))


@pytest.mark.parametrize(("shard", "first", "window"), [(2_000_000, 256, 2048), (5_000, 4, 16)])
def test_ranking_of_given_documents(spark, rows, monkeypatch, shard, first, window):
    """Also with many small shards and windows, where lists are skipped and blocks rejected."""
    for name, value in (("SHARD", shard), ("FIRST", first), ("WINDOW", window)):
        monkeypatch.setattr(ranking, name, value)
    docs, items = rows("documents", "doc_id, text"), rows("benchmark", "item_id, text")
    got = ranking.ranked(
        spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    )
    assert found(got) == ranking_of(docs, items)


def test_ranking_of_odd_rows(spark):
    """Equal scores, repeated rows and ids, null ids; items without text, with repeated terms, repeated, or one id with two texts."""
    docs = [*ODD, *ODD, (None, "alpha0 beta1 gamma2"), (70, "alpha0 beta1 gamma2"), (70, "Alpha0 beta1, gamma2!")]
    items = [(1, "alpha0 beta1"), (1, "alpha0 beta1"), (1, "apples"), (2, None), (3, ""), (4, "nowhere"), (5, "日本語 É apples apples one")]
    asked = spark.createDataFrame([(i, t, 7, 0.5) for i, t in items], "item_id long, text string, doc_id long, score double")
    assert found(ranking.ranked(table(spark, docs), asked)) == ranking_of(docs, items)
    assert ranking.ranked(empty(spark), asked).collect() == []
    assert ranking.ranked(table(spark, docs), asked.limit(0)).collect() == []
    assert ranking.ranked(table(spark, [(1, None), (2, "..")]), asked).collect() == []


def test_blocks_are_rejected_unopened():
    """A frequent term's blocks without a possible result stay compressed."""
    shard = ranking.Shard("0")
    for k in range(2_000):
        shard.add(k, [b"common"] * (1 + k % 3) + ([b"rare"] * 5 if k in (3, 5, 1_500) else []) + [b"filler%d" % k] * 20)
    rows = [r for batch in shard.lists(2_000, 40_000) for r in batch.to_pylist()]
    norms = np.array(rows[0]["norms"])
    lists = {r["term"]: ranking.List(r, norms) for r in rows[1:]}
    best = ranking.Best(2)
    ranking.search(lists, np.arange(2_000), [("common", 1), ("rare", 5_000)], best)
    assert set(best.ids.tolist()) < {3, 5, 1_500}
    assert len(lists["common"].open) < len(lists["common"].lasts) / 2


def test_packed_numbers():
    values = np.array([0, 1, 127, 128, 16_383, 16_384, 2**21, 2**28, 2**34])
    data, ends = ranking.packed(values)
    assert ranking.unpacked(data).tolist() == values.tolist() and ends[-1] == len(data)
    assert ranking.unpacked(data[:3]).tolist() == [0, 1, 127]


def runs(words):
    """(start, length, period) of every run, by definition."""
    n, out = len(words), []
    for d in range(1, n // 4 + 1):
        k = 0
        while k + d < n:
            stop = k
            while stop + d < n and words[stop] == words[stop + d]:
                stop += 1
            length = stop + d - k
            part = words[k : k + length]
            if length >= max(6, 4 * d) and all(part[p:] != part[: length - p] for p in range(1, d)):
                out.append((k, length, d))
            k = stop + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def run_row(doc_id, text, plant=True):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if plant and doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (k - a) % p] for k in range(a, n)]
    all_runs = runs(words)
    dropped = {k for s, length, q in all_runs for k in range(s + q, s + length)}
    best = min(all_runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    listed = "".join("%d,%d,%d\n" % r for r in all_runs)
    kept = b" ".join(w for k, w in enumerate(words) if k not in dropped)
    return (
        doc_id, len(all_runs), *best, best[0] is not None and 1000 * best[1] // best[2] or None,
        hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest(),
    )


RUN_COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_runs_of_given_documents(run, rows):
    got = {r["doc_id"]: tuple(r[c] for c in RUN_COLUMNS) for r in run("op12_periodic_runs")}
    expected = {i: run_row(i, t) for i, t in rows("documents", "doc_id, text") if len((t or "").split()) < 2_500}
    assert len(expected) > 190 and {i: got[i] for i in expected} == expected


def test_runs_of_odd_rows(spark):
    """Nulls, empty texts, long texts with one run over nearly all of them, a null and repeated ids."""
    long = [(20, "a " * 30_000 + "b"), (21, "x y z " * 4), (22, "x y z " * 3 + "x y"), (None, "q q q q q q r r r r r"), (23, "\t\n")]
    docs = [*ODD, *ODD, *long]
    got = Counter(tuple(r[c] for c in RUN_COLUMNS) for r in periodic.periodic_runs(table(spark, docs)).collect())
    expected = [run_row(i, t, plant=False) for i, t in docs if i not in (6, 7, 8, 20)]
    assert not Counter(expected) - got and sum(got.values()) == len(docs)
    assert {r[1:5] for r in got if r[0] in (6, 7, 8)} == {(1, 0, 30_000, 97)}
    assert [r[1:6] for r in got if r[0] == 20] == [(1, 0, 30_000, 1, 30_000_000)]
    collapsed = periodic.periodic_runs(table(spark, [(1, "a b c b c b c b c b c d")])).first()
    assert collapsed["collapsed"] == "a b c d" and collapsed["runs"] == [(1, 10, 2)]
    assert periodic.digests(empty(spark)).collect() == []


def test_runs_of_random_words():
    draw = random.Random(7)
    for _ in range(300):
        docs = []
        for _ in range(draw.randint(1, 4)):
            kinds = draw.choice([1, 2, 3, 8])
            words = [draw.randrange(kinds) for _ in range(draw.choice([0, 1, 5, 6, 7, 20, 60, 150]))]
            while words and draw.random() < 0.7:
                at, period = draw.randrange(len(words)), draw.randint(1, 12)
                unit = [draw.randrange(kinds) for _ in range(period)]
                for k in range(at, min(len(words), at + draw.randint(1, 60))):
                    words[k] = unit[(k - at) % period]
            docs.append(words)
        firsts = np.concatenate(([0], np.cumsum([len(d) for d in docs])))
        got = periodic.find_runs(np.array(sum(docs, []), np.int64), firsts)
        assert [[tuple(r[1:]) for r in got.tolist() if r[0] == k] for k in range(len(docs))] == [runs(d) for d in docs]


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(transducer.vocabulary())
    return lambda texts: [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


@pytest.fixture(scope="module")
def counter():
    return transducer.Counter(transducer.vocabulary())


def test_counts_of_given_documents(run, rows, library):
    docs = rows("documents", "doc_id, text")
    tokens = library([t or "" for _, t in docs])
    expected = {(i, len((t or "").encode()), n, n > 2048) for (i, t), n in zip(docs, tokens, strict=True)}
    assert {tuple(r) for r in run("op13_token_counts")} == expected


def test_counts_of_odd_rows(spark, library):
    docs = [*ODD, *ODD, (None, "a<|endoftext|>b"), (30, "<|startoftext|><|endoftext|>"), (31, "x" * 200_000), (32, "the" * 50_000)]
    tokens = library([t or "" for _, t in docs])
    expected = Counter((i, len((t or "").encode()), n, n > 2048) for (i, t), n in zip(docs, tokens, strict=True))
    assert Counter(map(tuple, transducer.counted(table(spark, docs)).collect())) == expected
    assert transducer.counted(empty(spark)).collect() == []


@pytest.mark.parametrize("letters", ["ab", "etaoinshr", "abcéèßöÜĞİΣς'!?. 09\n日本한😀👍🏽̀　ﬁ²Ⅷ", None])
def test_counts_of_random_texts(counter, library, letters):
    """None: any code points, among them some that Python's tables do not hold."""
    draw = random.Random(11)

    def sign():
        if letters:
            return draw.choice(letters)
        return chr(draw.choice([draw.randrange(0x20, 0x3000), draw.randrange(0x3000, 0xD800), draw.randrange(0xE000, 0x110000)]))

    texts = ["".join(sign() for _ in range(draw.randint(0, 200))) for _ in range(400)]
    texts += ["I'm don't 're'll'vex '' 's's 'S 'T'RE x'd'! !'s", "'", "'l", "x'", "<|endof"]
    assert counter.count(texts) == library(texts)


def test_counts_of_long_words_do_not_depend_on_chunks(counter, library, monkeypatch):
    draw = random.Random(13)
    texts = ["a" * 999, "ha" * 700, "!" * 300, "".join(draw.choice("abcdefgh") for _ in range(3_000)), "é" * 500]
    for chunk in (1, 2, 7, 64):
        monkeypatch.setattr(transducer, "CHUNK", chunk)
        assert counter.count(texts) == library(texts)


def test_compiled_table_is_bounded(library):
    """A table that is emptied between texts gives the same counts."""
    small = transducer.Counter(transducer.vocabulary())
    small.transducer.most = 100
    texts = ["some words of a text", "and others", "more of them", "", "some words"]
    assert [small.count([t])[0] for t in texts] == library(texts)
    assert small.transducer.size < 200
