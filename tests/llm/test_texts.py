"""Operators on documents against brute force, and their defined results for odd rows."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stratlens.llm import bpe, crossentropy, language, minhash, packing, rules, shared, suffixes, text
from tests.llm import brute

# Nulls, empty texts, repeated rows, ties, one long text; the extra columns clash with the operators' own.
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()
LONG = " ".join(random.Random(3).choice(WORDS) + str(k % 97) for k in range(30_000))
ODD = [
    (1, None), (2, ""), (3, " \t\n "), (4, "one two three"), (5, "ONE two\tthree"), (6, LONG), (7, LONG), (8, LONG + " more"),
    (9, "a" * 5000), (10, "日本語 ひらがな　é 😀"), (11, "Foo, bar. 12 apples!\n\n\ttab  two spaces 's it's \n"), (12, "1234 5678"),
]
COLUMNS = "doc_id long, text string, lang string, key string, n_shingles int, rep long, n_chars int, component string, size int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "k", 1, 2, 3, "c", 4) for i, t in rows], COLUMNS)


def empty(spark):
    return spark.createDataFrame([], COLUMNS)


def near(rows):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in rows}


def test_near_duplicates_of_given_documents(run, rows):
    assert near(run("op1_minhash_near_dedup")) == brute.near_duplicates(rows("documents", "doc_id, text"))


def test_near_duplicates_of_odd_rows(spark):
    assert near(minhash.near_duplicates(table(spark, ODD)).collect()) == brute.near_duplicates(ODD)
    again = minhash.near_duplicates(table(spark, [*ODD, *ODD])).collect()
    assert len(again) == 2 * len(ODD) and near(again) == brute.near_duplicates(ODD)
    assert minhash.near_duplicates(empty(spark)).collect() == []
    lost = minhash.near_duplicates(table(spark, [(None, "a b c"), (3, "a b c"), (None, "d e f")])).collect()
    assert sorted((r["component_id"] or 0, r["kept"]) for r in lost) == [(0, True), (3, False), (3, True)]


def test_one_id_on_different_texts(spark):
    """Both texts of an id find their near copies, which are one component through the id."""
    draw = random.Random(8)
    a, b, c = (" ".join(f"w{draw.randrange(10**6)}" for _ in range(200)) for _ in range(3))
    rows = [(1, a), (1, b), (2, f"{a} x y"), (3, f"{b} x y"), (4, c), (None, f"{c} x"), (0, c), (1, None), (7, "alone here")]
    found = {(r["doc_id"], r["n_shingles"]): (r["component_id"], r["kept"]) for r in minhash.near_duplicates(table(spark, rows)).collect()}
    assert found == {
        (1, 196): (1, True), (2, 198): (1, False), (3, 198): (1, False), (4, 196): (0, False), (None, 197): (0, False), (0, 196): (0, True),
        (1, 0): (1, True), (7, 1): (7, True),
    }


def test_large_group_of_near_copies(spark, monkeypatch):
    """More members than a block: variants of one text, some linked through others only."""
    draw = random.Random(5)
    base = [draw.choice(WORDS) + str(draw.randrange(50)) for _ in range(120)]
    docs = []
    for i in range(300):
        words = list(base)
        for _ in range(draw.randrange(9)):
            words[draw.randrange(120)] = f"w{draw.randrange(10**6)}"
        docs.append((i, " ".join(words)))
    monkeypatch.setattr(minhash, "SMALL", 10)
    monkeypatch.setattr(minhash, "BLOCK", 40)
    assert near(minhash.near_duplicates(table(spark, docs)).collect()) == brute.near_duplicates(docs)


def test_signatures_estimate_similarity():
    draw = np.random.default_rng(1)
    values = draw.integers(0, 2**63, 3000, dtype=np.uint64)
    for shared_part in (0, 500, 1000, 1500):
        left, right = values[:1500], values[1500 - shared_part : 3000 - shared_part]
        sig = minhash.signatures(minhash.minima([np.unique(left), np.unique(right)]))
        differing = np.bitwise_count((sig[0] ^ sig[1])[:2] | (sig[0] ^ sig[1])[2:]).sum()
        estimate = ((1 - differing / 128) - 0.25) / 0.75
        assert abs(estimate - shared_part / (3000 - shared_part)) < 0.2


def test_deduplicated_keeps_one_row_and_all_columns(spark):
    docs = table(spark, [*ODD, *ODD])
    left = minhash.deduplicated(docs)
    assert left.columns == docs.columns
    kept = [i for i, (_, _, k) in brute.near_duplicates(ODD).items() if k]
    assert sorted(r["doc_id"] for r in left.collect()) == sorted(kept)


def test_components(spark):
    draw = random.Random(2)
    links = [(draw.randrange(400), draw.randrange(400)) for _ in range(300)] + [(k, k + 1) for k in range(1000, 1100)]
    got = {r["id"]: r["component"] for r in shared.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {n for a, b in links for n in (a, b) if a != b}
    want = brute.components({n for pair in links for n in pair}, links)
    assert got == {n: want[n] for n in nodes}


def test_words_and_shingles():
    texts = [t or "" for _, t in ODD]
    import pyarrow as pa

    sets = text.shingle_sets(*text.utf8(pa.array([None, *texts])))
    assert [len(s) for s in sets] == [0, *(len(brute.shingles(t)) for t in texts)]


def counts(row):
    return tuple(row[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))


def test_statistics(run, rows):
    got = {r["doc_id"]: r for r in run("op3_quality_rules")}
    docs = rows("documents", "doc_id, text")
    assert {i: counts(r) for i, r in got.items()} == {i: brute.statistics(t) for i, t in docs}
    assert not any(r["kept"] and r["base_failed"] for r in got.values())
    quality = dict(rows("labels", "doc_id, quality"))
    judged = [(quality[i], r["kept"]) for i, r in got.items() if i in quality and not r["base_failed"]]
    assert sum(q == k for q, k in judged) >= 0.9 * len(judged)


def test_statistics_of_odd_rows(spark):
    rows = [*ODD, (13, "x y\nx y\n\nx y"), (14, "a b c d e f a b c d e " * 3), (None, "q")]
    labels = spark.createDataFrame([(1, 0), (1, None), (None, 1), (6, 1)], "doc_id long, quality int")
    got = {r["doc_id"]: counts(r) for r in rules.judged(table(spark, rows), labels).collect()}
    assert got == {i: brute.statistics(t) for i, t in rows}
    assert rules.judged(empty(spark), labels).collect() == []
    none = rules.judged(table(spark, rows), labels.where("false")).collect()
    assert all(r["kept"] != r["base_failed"] for r in none)


def test_rules_are_learned_and_ordered(spark):
    docs = spark.range(2000).select(
        F.col("id").alias("doc_id"),
        F.concat(F.repeat(F.lit("word "), 0), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(40)), lambda k: F.concat(F.lit("w"), k * 7 + F.col("id"))), " "),
                 F.when(F.col("id") % 5 == 0, F.repeat(F.lit(" $$$%%%"), 20)).otherwise("")).alias("text"),
    )
    labels = docs.select("doc_id", F.when(F.col("doc_id") % 5 == 0, 0).otherwise(1).alias("quality"))
    judged = rules.judged(docs, labels)
    assert judged.where((F.col("doc_id") % 5 == 0) == F.col("kept")).count() == 0
    assert "Python" not in judged._jdf.queryExecution().executedPlan().toString()
    columns = docs.withColumn("n_words", F.lit("clash"))
    left = rules.accepted(columns, labels)
    assert left.columns == columns.columns and left.count() == 1600


def test_language(run, rows):
    got = {r["doc_id"]: r for r in run("op5_language_id")}
    docs = rows("documents", "doc_id, lang")
    held = {i for i, _ in docs if zlib.crc32(str(i).encode()) % 4 == 2}
    assert {i for i, r in got.items() if r["held_out"]} == held
    right = [got[i]["lang_pred"] == lang for i, lang in docs if i in held]
    assert sum(right) >= 0.95 * len(right) and all(0 <= r["score"] <= 1 for r in got.values())


def test_language_of_odd_rows(spark):
    got = {r["doc_id"]: r for r in language.identified(table(spark, ODD)).collect()}
    assert {i for i, r in got.items() if r["lang_pred"] == "und"} == {1, 2, 3, 12}
    assert all(r["score"] == 0 for r in got.values() if r["lang_pred"] == "und")
    unlabelled = table(spark, ODD).withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language.identified(unlabelled).collect()} == {"und"}
    assert language.identified(empty(spark)).collect() == []
    docs = table(spark, ODD)
    left = language.accepted(docs, language.fit(docs))
    assert left.columns == docs.columns and sorted(r["doc_id"] for r in left.collect()) == [4, 5, 6, 7, 8, 9, 10, 11]


@pytest.fixture(scope="module")
def tiktoken_encoding():
    ranks = bpe.read_ranks(bpe.vocabulary())
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoded(encoding, t):
    ids = np.array(encoding.encode_ordinary(t or ""), "<u4").tobytes()
    return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()


def triple(r):
    return r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]


def test_byte_pairs(run, rows, tiktoken_encoding):
    got = {r["doc_id"]: triple(r) for r in run("op6_byte_level_bpe")}
    assert got == {i: encoded(tiktoken_encoding, t) for i, t in rows("documents", "doc_id, text")}


def test_byte_pairs_of_odd_rows(spark, tiktoken_encoding):
    odd = [*ODD, (13, "  a  b "), (14, "\x1c a\x1d\x85b"), (15, "ab" * 700 + "a" * 333), (16, "<|endoftext|> x"), (17, "don't you'll  'S")]
    got = {r["doc_id"]: triple(r) for r in bpe.digests(table(spark, odd)).collect()}
    assert got == {i: encoded(tiktoken_encoding, t) for i, t in odd}
    assert bpe.digests(empty(spark)).collect() == []


def test_recursive_forms_agree(monkeypatch):
    codec = bpe.Codec(bpe.vocabulary())
    words = ["banana", "x" * 60, "abab" * 10, "tionation", "é" * 9, "q", "日本語のテキスト"]
    short = codec.encode_words(words)
    monkeypatch.setattr(bpe, "LONG", 0)
    assert codec.encode_words(words) == short
    monkeypatch.setattr(bpe, "VERY_LONG", 0)
    assert codec.encode_words(words) == short
    assert codec.decode_words([*short, b""]) == [*(w.encode() for w in words), b""]


def test_very_long_words(tiktoken_encoding):
    draw = random.Random(8)
    words = ["".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5000)), "漢字仮名" * 1500]
    codec = bpe.Codec(bpe.vocabulary())
    for word, ids in zip(words, codec.encode_words(words), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tiktoken_encoding.encode_ordinary(word)


def packed(found, docs):
    """Check pieces against the tokenizer and sequences against their capacity; gives sequences and tokens."""
    tokenizer = Tokenizer.from_file(packing.vocabulary())
    pieces = {}
    for r in found:
        pieces.setdefault(r["doc_id"], []).append(r)
    assert pieces.keys() == {i for i, _ in docs}
    for i, t in docs:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        own, at = sorted(pieces[i], key=lambda r: r["piece"]), 0
        assert len(own) == -(-len(ids) // 1024) and [r["piece"] for r in own] == list(range(len(own)))
        for r in own:
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids) and all(r["length"] == 1024 for r in own[1:])
    return sequences(found)


def sequences(found):
    fill = {}
    for r in sorted(found, key=lambda r: (r["sequence_id"], r["offset"])):
        assert fill.get(r["sequence_id"], 0) == r["offset"]
        fill[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(fill.values(), default=0) <= 1024
    return len(fill), sum(fill.values())


def test_packing(run, rows):
    found = run("op7_best_fit_packing")
    n, tokens = packed(found, rows("documents", "doc_id, text"))
    assert n <= 1.02 * tokens / 1024 + 2


def test_packing_of_odd_rows(spark):
    packed(packing.packed_documents(table(spark, ODD)).collect(), ODD)
    assert len(packing.packed_documents(table(spark, [(1, "a"), (1, "a"), (None, None)])).collect()) == 3
    assert packing.packed_documents(empty(spark)).collect() == []


def test_packing_in_rounds(spark):
    items = spark.range(5000).select((1 + F.pmod(F.xxhash64("id"), F.lit(1024))).cast("long").alias("length"), "id")
    found = packing.pack(items, group=300).collect()
    n, tokens = sequences(found)
    assert len(found) == 5000 and n <= 1.04 * tokens / 1024


def test_added_tokens_in_texts(spark):
    """Their strings are single ids, as the tokenizer gives them by default, in plain and odd texts."""
    texts = ["x<|endoftext|>", "<|endoftext|><|endoftext|>", "é  <|endoftext|> y", "<|endoftext|", "plain"]
    found = packing.token_pieces(table(spark, list(enumerate(texts))), with_ids=True).collect()
    tokenizer = Tokenizer.from_file(packing.vocabulary())
    ids = {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 2] for i, t in enumerate(texts)}
    assert ids[0] == [87, 50256, 2]
    assert {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in found} == ids


def test_tasks_grow_where_rounds_join_hardly_any_bins(spark, monkeypatch):
    """Even lengths from about half a sequence on: few bins of a round take another one."""
    length = F.lit(342) + 2 * F.pmod(F.xxhash64("id"), F.lit(340))
    items = spark.range(6_000).select("id", length.cast("long").alias("length"))
    n, tokens = sequences(packing.pack(items, group=50).collect())
    monkeypatch.setattr(packing, "MOST", 50)
    fixed, _ = sequences(packing.pack(items, group=50).collect())
    assert tokens / 1024 < n < fixed


def repeats(rows):
    return [(r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in sorted(rows, key=lambda r: r["doc_id"])]


def hashed(docs, length):
    return [(n, removed, spans, hashlib.sha256(kept).hexdigest()) for n, removed, spans, kept in brute.repeats(docs, length)]


def test_repeats(run, rows):
    docs = sorted(rows("documents", "doc_id, text"))
    assert repeats(run("op10_suffix_array_dedup")) == hashed(docs, 400)


def test_repeats_of_odd_rows(spark):
    docs = [(i, t) for i, t in ODD if i not in (6, 7, 8)] + [(20, LONG[:3000]), (21, "zz" + LONG[500:1200]), (22, LONG[:3000])]
    docs.append((23, ("period seven " * 100)[:1000]))
    assert repeats(suffixes.digests(table(spark, docs)).collect()) == hashed(docs, 400)
    assert suffixes.digests(empty(spark)).collect() == []
    both = suffixes.digests(table(spark, [(None, "x" * 399), (None, LONG[:900]), (None, LONG[:900])])).collect()
    assert sorted(r["n_removed"] for r in both) == [0, 900, 900]


def test_hot_passage_is_halved(spark):
    """A passage in more documents than a group holds, cut at different places."""
    draw = random.Random(7)
    noise = lambda: "".join(draw.choice("abcdefgh") for _ in range(300))
    passage = "".join(draw.choice("ijklmnop") for _ in range(900))
    docs = [(i, noise() + passage[draw.randrange(3) * 40 :] + noise()) for i in range(60)]
    assert repeats(suffixes.shortened(table(spark, docs), group=8).withColumnRenamed("sha", "kept_sha256").collect()) == hashed(docs, 400)


def test_suffix_order():
    draw = random.Random(4)
    pieces = [bytes(draw.choice(b"ab") for _ in range(200)) for _ in range(4)] + [b"a" * 120, b"abab" * 40]
    counts = [len(p) - 19 for p in pieces]
    _, order, _ = suffixes.suffix_order(pieces, counts, 20)
    data, at = b"".join(pieces), 0
    want = set()
    for p, n in zip(pieces, counts, strict=True):
        want |= set(range(at, at + n))
        at += len(p)
    assert want <= set(order)
    starts = [data[i : i + 20] for i in order if i in want]
    assert starts == sorted(starts)
    hits = suffixes.repeated(pieces, counts, 20)
    times = [p[k : k + 20] for p, n in zip(pieces, counts, strict=True) for k in range(n)]
    assert [bool(h) for hit in hits for h in hit] == [times.count(x) > 1 for x in times]


def test_long_text_in_segments():
    data = np.frombuffer(("".join(chr(97 + (k * k) % 26) for k in range(3000)) * 400).encode(), np.uint8)
    first, last, place, _ = suffixes.anchors(data)
    assert first[0] == 0 and last[-1] == len(data) - 400 and (first[1:] == last[:-1] + 1).all()
    assert (place >= last).all() and (place <= first + 336).all()


def test_without_repeats_keeps_columns(spark):
    own = "".join(f"é{k}" for k in range(90))
    docs = table(spark, [(1, own + LONG[:500]), (2, LONG[:500] + "tail"), (3, None)])
    left = suffixes.without_repeats(docs)
    assert left.columns == docs.columns
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in left.collect()}
    assert got == {1: (own, len(own)), 2: ("tail", 4), 3: (None, 3)}


def test_documents_of_an_unsure_language_stay(spark, rows):
    """Some short texts have low scores; only what op5 calls und goes."""
    texts = rows("documents", "doc_id, text, lang")
    draw = random.Random(9)
    mixed = [(i, "".join(draw.choice("qxzjkwvyñßçé ") for _ in range(draw.randrange(3, 9))) + "q") for i in range(300)]
    labelled = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    model, docs = language.fit(labelled), table(spark, mixed + [(900, "a"), (901, "12"), (902, None)])
    judged = {r["doc_id"]: r for r in language.predicted(docs, model).collect()}
    assert any(r["score"] < 0.5 for r in judged.values() if r["lang_pred"] != "und")
    left = {r["doc_id"] for r in language.accepted(docs, model).collect()}
    assert left == {i for i, r in judged.items() if r["lang_pred"] != "und"}


def plain_differences(docs, targets):
    """Losses from dictionaries of counts; bigrams are told apart by their slot only."""
    encoding = crossentropy._encoding(crossentropy.vocabulary())
    coded = {i: [crossentropy.START, *encoding.encode_ordinary(t or "")] for i, t in docs}
    slot = lambda v, w: int(crossentropy.bigram_slots(np.array([v]), np.array([w]))[0])
    pairs = {i: [(slot(v, w), v, w) for v, w in zip(ids, ids[1:], strict=False)] for i, ids in coded.items()}
    models = []
    for chosen in (targets, set(coded)):
        counts = [Counter(p[k] for i in chosen for p in pairs.get(i, [])) for k in range(3)]
        models.append((counts, sum(counts[2].values())))
    scale = (1.0, models[0][1] / models[1][1])
    out = {}
    for i, own in pairs.items():
        losses = []
        for ((bigrams, contexts, tokens), total), times in zip(models, scale, strict=True):
            loss = 0.0
            for s, v, w in own:
                share = (tokens[w] + 1) / (total + crossentropy.TOKENS)
                loss -= math.log((bigrams[s] * times + 50 * share) / (contexts[v] * times + 50))
            losses.append(loss / len(own) if own else None)
        out[i] = (len(own), *losses, losses[0] - losses[1] if own else None)
    return out


def losses(rows):
    return {r["doc_id"]: (r["n_tokens"], r["target_loss"], r["background_loss"], r["score"]) for r in rows}


def same(got, want):
    assert got.keys() == want.keys()
    for i, row in got.items():
        for value, other in zip(row, want[i], strict=True):
            assert value == other or value == pytest.approx(other, rel=1e-5, abs=1e-6), i


def test_cross_entropy(run, rows):
    docs = rows("documents", "doc_id, text")
    targets = {i for i, q, t in rows("labels", "doc_id, quality, toxic") if q == 1 and t == 0}
    got = losses(run("op2_cross_entropy_difference"))
    same(got, plain_differences(docs, targets & {i for i, _ in docs}))


def test_cross_entropy_of_odd_rows(spark):
    odd = [row for row in ODD if row[0] not in (6, 7)]
    targets = spark.createDataFrame([(4,), (4,), (None,), (99,)], "doc_id long")
    same(losses(crossentropy.differences(table(spark, odd), targets).collect()), plain_differences(odd, {4}))
    none = crossentropy.differences(table(spark, odd), targets.where("false")).collect()
    assert all((r["score"] is None) == (r["n_tokens"] == 0) for r in none)
    assert crossentropy.differences(empty(spark), targets).collect() == []


def test_cross_entropy_counts_each_bigram_apart(spark, monkeypatch):
    """Against counts by pairs of tokens, where so many distinct bigrams fall together in a table of 2^20 hashed slots."""
    monkeypatch.setattr(crossentropy, "CHUNK", 1 << 16, raising=False)
    encoding = crossentropy._encoding(crossentropy.vocabulary())
    draw = random.Random(5)
    docs = [(i, "".join(f" {chr(draw.randrange(97, 123))}{draw.randrange(10**6)}" for _ in range(4000))) for i in range(120)]
    coded = {i: [crossentropy.START, *encoding.encode_ordinary(t)] for i, t in docs}
    pairs = {i: list(zip(ids, ids[1:], strict=False)) for i, ids in coded.items()}
    models = []
    for chosen in (range(0, 120, 7), coded):
        bigrams = Counter(p for i in chosen for p in pairs[i])
        models.append((bigrams, Counter(p[0] for i in chosen for p in pairs[i]), Counter(p[1] for i in chosen for p in pairs[i])))
    totals = [sum(m[0].values()) for m in models]
    targets = spark.createDataFrame([(i,) for i in range(0, 120, 7)], "doc_id long")
    got = losses(crossentropy.differences(table(spark, docs), targets).collect())
    assert len(got) == len(docs)
    for i, own in pairs.items():
        want = []
        for (bigrams, contexts, tokens), total in zip(models, totals, strict=True):
            times = totals[0] / total
            want.append(sum(
                math.log((contexts[v] * times + 50) / (bigrams[v, w] * times + 50 * (tokens[w] + 1) / (total + crossentropy.TOKENS)))
                for v, w in own
            ) / len(own))
        assert got[i] == pytest.approx((len(own), *want, want[0] - want[1]), rel=1e-5, abs=1e-6), i
