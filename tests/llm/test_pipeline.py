"""The pipeline against a plain version of its stages, on documents given here and on the given tables."""

from __future__ import annotations

import random
import zlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from stratlens.llm import packing, shared
from tests.llm import brute
from tests.llm.conftest import SF_DIR

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, size int"


def corpus():
    """Two languages with words of their own; junk, copies, near copies and a shared passage among them."""
    draw = random.Random(11)
    words = {
        "en": ["the", "thing", "which", "ought", "where", "with", "thought"],
        "fr": ["été", "où", "français", "leçon", "élève", "à", "même"],
    }
    make = lambda lang, n: " ".join(draw.choice(words[lang]) + (str(draw.randrange(1000)) if k % 3 else "") for k in range(n))
    passage, shortest, too_short = make("en", 120), make("en", 51), make("en", 50)
    rows = []
    for i in range(160):
        lang = "en" if i % 2 else "fr"
        text = make(lang, draw.randrange(30, 90))
        if i % 5 == 3:
            text = " ".join(f"{w}$$%%" for w in text.split())
        if i % 20 == 4:
            text = f"{text} {passage} {make(lang, 20)}"
        if i % 20 == 9:
            text = f"{text}\n{shortest if i % 40 == 9 else shortest.replace(' ', '  ')} {make(lang, 20)}"
        if i % 20 == 14:
            text = f"{text} {too_short}\n{make(lang, 20)}"
        rows.append((i, text, lang))
    rows += [(1000 + i, rows[i][1], rows[i][2]) for i in range(0, 40, 5)]
    rows += [(2000 + i, rows[i][1] + " end", rows[i][2]) for i in range(1, 60, 7)]
    rows += [(3000, None, "en"), (3001, "", "en"), (3002, "123 456", "fr"), (3003, "short text", "en")]
    labels = [(i, 0 if i % 5 == 3 else 1) for i in range(160)]
    return rows, labels


def expected(rows):
    """(doc_id, length, crc32) of each document's ids after the stages; junk is what was made as junk."""
    kept = [(i, t) for i, t, _ in rows if t and any(c.isalpha() for c in t)]
    kept = [(i, t) for i, t in kept if not brute.statistics(t)[5] and "$$%%" not in t]
    first = brute.near_duplicates(kept, 80)
    kept = [(i, t) for i, t in kept if first[i][2]]
    shorter = brute.word_repeats(kept)
    tokenizer = Tokenizer.from_file(packing.vocabulary())
    out = {}
    for (i, _), t in zip(kept, shorter, strict=True):
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 2], "<u4")
        out[i] = (len(ids), zlib.crc32(ids.tobytes()))
    return out


def test_against_brute_force(spark, tmp_path):
    rows, labels = corpus()
    documents = [(i, t, lang, "s", len(t or ""), 0) for i, t, lang in rows]
    spark.createDataFrame(documents, DOCUMENTS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, q, 0) for i, q in labels], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"]: (r["length"], r["ids_crc32"]) for r in found} == expected(rows)
    fill = {}
    for r in sorted(found, key=lambda r: (r["sequence_id"], r["offset"])):
        assert fill.get(r["sequence_id"], 0) == r["offset"]
        fill[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(fill.values()) <= 1024


def test_stages_return_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, rows = docs.dtypes, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = shared.table(stage(spark, docs, SF_DIR), "stage")
        assert docs.dtypes == columns, name
        rows, before = docs.count(), rows
        assert 0 < rows <= before, name


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], DOCUMENTS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_repeats_of_more_than_fifty_words(spark):
    """Short and long words, other white space, a text's end and start, a repeat inside one text, one that is the whole text."""
    draw = random.Random(6)
    words = lambda n, size=6: " ".join("".join(draw.choice("abcdéfgh") for _ in range(size)) for _ in range(n))
    rows = []
    for size in (1, 2, 6, 30):
        for n in (49, 50, 51, 52, 60, 200):
            passage = words(n, size)
            for glue in (" ", "\n", " \t "):
                rows.append((len(rows), words(30) + glue + passage.replace(" ", glue) + glue + words(30)))
            rows.append((len(rows), passage + " " + words(10)))
            rows.append((len(rows), words(10) + " " + passage))
    inside = words(70)
    rows += [(900, f"{inside} {words(5)} {inside}"), (901, ""), (902, words(51)), (903, "z " * 80), (904, " z" * 51)]
    rows.append((905, rows[-3][1]))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t), 0) for i, t in rows], DOCUMENTS)
    left = {r["doc_id"]: r["text"] for r in corpus_pipeline.remove_repeats(spark, docs, "").collect()}
    expected = {i: t for (i, _), t in zip(rows, brute.word_repeats(rows), strict=True)}
    expected[902] = expected[905] = ""
    assert left == expected
    assert sum(left[i] != t for i, t in rows) > 80


def test_near_duplicates_from_four_fifths_on(spark):
    """Copies with words added, on both sides of 0.80 and of 0.85: 100 of 100 + k shingles are shared."""
    draw = random.Random(4)
    words = lambda n: " ".join(f"w{draw.randrange(10**6)}" for _ in range(n))
    rows = []
    for k in (10, 17, 18, 20, 24, 25, 26, 30):
        for _ in range(6):
            text = words(104)
            rows += [(len(rows), text), (len(rows) + 1, f"{text} {words(k)}")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t), 0) for i, t in rows], DOCUMENTS)
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()}
    found = brute.near_duplicates(rows, 80)
    assert kept == {i for i, _ in rows if found[i][2]} and len(kept) == 6 * (6 + 2 * 2)
