"""WARC archives, page extraction and vectors."""

from __future__ import annotations

import io
import random

import numpy as np
import pytest

from stratlens.llm import hnsw, html, warc
from tests.llm import brute

PAGES = "page_id long, url string, html string, host string, payload string, record_type int"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "h", "p", 0) for i, u, h in rows], PAGES)


def record(r):
    return r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]


def test_archives_of_given_pages(run, rows):
    assert sorted(map(record, run("op4_warc_chunks"))) == sorted(brute.records(rows("pages", "page_id, html")))


def test_archives_of_odd_rows(spark):
    odd = [(1, "u", "x" * 200_000), (2, "u", "x" * 200_000), (3, None, None), (4, "http://é/ \n", "\r\n\r\n" * 300), (5, "v", "é" * 499),
           (6, "v", "é" * 499), (7, "w", "é" * 500), (8, "w", "é" * 500)]
    assert sorted(map(record, warc.round_trip(pages(spark, odd)).collect())) == sorted(brute.records([(i, h) for i, _, h in odd]))
    again = warc.round_trip(pages(spark, [odd[0], odd[1], odd[1], (None, "n", "x" * 200_000)])).collect()
    assert sorted((r["page_id"] or 0, r["record_type"], r["refers_to"]) for r in again) == [
        (0, "revisit", 2), (1, "revisit", 2), (2, "response", None), (2, "response", None)
    ]
    assert warc.round_trip(pages(spark, [])).collect() == []


def test_chunks(spark, tmp_path):
    body = "".join(chr(97 + k % 26) for k in range(150_000))
    path = f"file://{tmp_path}"
    chunks = warc.read_archives(warc.write_archives(pages(spark, [(1, "u", body), (2, "u", "")]), path), path, 4096).collect()
    own = sorted((r for r in chunks if r["page_id"] == 1), key=lambda r: r["chunk_no"])
    assert b"".join(bytes(r["chunk"]) for r in own) == body.encode()
    assert all(len(r["chunk"]) <= 4096 for r in chunks) and [r["last"] for r in own] == [False] * (len(own) - 1) + [True]
    assert [r["bytes_so_far"] for r in own] == list(np.cumsum([len(r["chunk"]) for r in own]))


def test_damaged_archive():
    out = io.BytesIO()
    row = {"page_id": 1, "url": "u", "record_type": "response", "refers_to": None, "payload_digest": "00" * 20, "payload_bytes": 5}
    warc.write_record(out, row, memoryview(b"hello"))
    assert [r[6] for r in warc.read_chunks(io.BytesIO(out.getvalue()))] == [b"hello"]
    with pytest.raises(Exception, match="ends within"):
        list(warc.read_chunks(io.BytesIO(out.getvalue()[:-30])))


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><nav>";</script></head><body class="sidebar-left">
<header>Site</header><nav><ul><li><a href=/x>Menu</a></ul></nav><div class="cookie-notice">Cookies!</div>
<article class=post><header><h1>Head &amp; line</h1></header><p>First <b>bold</b>text<br>next&nbsp;line<p>Second
  paragraph <!-- <p>no</p> --> a &lt; b<ul><li>one<li>two</ul><table><tr><td>c1<td>c2</table>
<aside>Aside</aside><form><input value=q>Form</form><div id="comments"><p>Comment</p></div><footer>By</footer></article>
<div class="ad banner">Buy</div><footer>&copy; x</footer></body></html>"""


def test_parse():
    assert html.main_text(html.parse(PAGE)) == "Head & line First boldtext next line Second paragraph a < b one two c1 c2"
    assert html.main_text(html.parse("<p>a<p>b <i>c</i>d<script>x</script>")) == "a b cd"
    assert [html.main_text(html.parse(s)) for s in ("", "plain", "<", "</p>", "<p", "<!--", "<script>x", "<div hidden>h</div>v")] == [
        "", "plain", "<", "", "<p", "", "", "v"
    ]


def test_names_inside_an_article_count_as_whole_tokens():
    page = (
        '<div class="site-menu">m</div><article><h2 id="share-prices">Prices</h2><p class="notice-period">Notice</p>'
        '<section id="related-work"><p>Work <math><mi>x</mi></math> here</p></section><div class="social-policy">Policy</div>'
        '<div class="box share">s</div><h3 class="related">Kept</h3></article>'
    )
    assert html.main_text(html.parse(page)) == "Prices Notice Work x here Policy Kept"


def test_given_pages(run, rows):
    import html as entities
    import re

    want = {}
    for i, source in rows("pages", "page_id, html"):
        body = re.search("<article>(.*?)</article>", source, re.DOTALL)[1]
        want[i] = " ".join(entities.unescape(re.sub("<[^>]*>", " ", re.sub("</?b>", "", body))).split())
    got = run("op8_html_style_tree")
    assert {r["page_id"]: r["text"] for r in got} == want and all(r["n_chars"] == len(r["text"]) for r in got)


def test_style_tree_removes_what_all_pages_share(spark):
    """No tag or class tells that the box is noise; its sameness does. The same box on few pages stays."""
    draw = random.Random(1)
    words = lambda: " ".join(f"w{draw.randrange(10**6)}" for _ in range(8))
    source, want = [], {}
    for i in range(40):
        host, body = ("big" if i < 36 else f"one{i}"), words()
        source.append((i, f"http://{host}/{i}", f"<body><div class=x7><p>Same on all pages</p></div><div class=y><p>{body}</p></div></body>"))
        want[i] = body if i < 36 else f"Same on all pages {body}"
    source += [(50, None, None), (51, "odd", ""), (52, "http://big/q", "")]
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html.extracted(pages(spark, source)).collect()}
    assert {i: t for i, (t, _) in got.items()} == want | {50: "", 51: "", 52: ""}
    assert html.extracted(pages(spark, [])).collect() == []
    twice = html.extracted(pages(spark, [source[-4], source[-4]])).collect()
    assert len(twice) == 2


def test_style_tree_keeps_copies_and_recurring_blocks(spark):
    """Copies of a page, near copies of an article, and subheadings in five wordings are text; one box in all articles is not."""
    draw = random.Random(2)
    words = lambda: " ".join(f"w{draw.randrange(10**6)}" for _ in range(8))
    source, want = [], {}

    def add(host, body, text):
        want[len(source)] = text
        source.append((len(source), f"http://{host}/{len(source)}", body))

    blocks = [words() for _ in range(10)]
    for k in range(60):
        add("copies", f"<article>{''.join(f'<p>{b}' for b in blocks)}</article>", " ".join(blocks))
        add("plain", f"<div class=x7><p>{blocks[0]}</div>", blocks[0])
        add("near", f"<p>{k}</p><main><h1>{blocks[1]}</h1><p>{blocks[2]}</main>", f"{blocks[1]} {blocks[2]}")
    for k in range(100):
        own, heading = words(), f"Heading {'abcde'[k % 5]}"
        box = "<div class=x7><p>The same in all articles</div>"
        add("headings", f"<article>{box}<h2>{heading}</h2><p>{own}</p></article>", f"{heading} {own}")
        add("bare", f"<div class=y><h2>{heading}</h2><p>{own}</p></div>", f"{heading} {own}")
        one = k % 10 < 7
        title = "Copied" if one else words()
        add("mostly", f"<i>{k}</i><article><h1>{title}</h1><p>{blocks[3] if one else own}</article>", f"{title} {blocks[3] if one else own}")
    got = {r["page_id"]: r["text"] for r in html.extracted(pages(spark, source)).collect()}
    assert got == want


def linked(rows):
    return {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in rows}


def test_given_vectors(run, rows):
    vectors = rows("embeddings", "vec_id, embedding, label")
    assert linked(run("op9_hnsw_near_dedup")) == brute.cosine_links(vectors)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 1), (4, [1.0, 0.0], 2), (5, [1.0, 0.0], None), (6, None, 1), (7, [], 1),
           (8, [0.0, 0.0], 1), (9, [nan, 1.0], 1), (10, [inf, 1.0], 1), (11, [None, 1.0], 1), (12, [1.0, 0.0, 0.0], 1), (13, [0.0, 1.0], 1),
           (14, [1e-30, 0.0], 1), (15, [1e30, 1e28], 1)]
    schema = "vec_id long, embedding array<float>, label int, vector string, rep string, shard long"
    frame = lambda rows: spark.createDataFrame([(*r, "v", "r", 0) for r in rows], schema)
    assert linked(hnsw.near_duplicates(frame(odd)).collect()) == brute.cosine_links(odd)
    assert hnsw.near_duplicates(frame([])).collect() == []
    twice = hnsw.near_duplicates(frame([odd[0], odd[0], (None, [1.0, 0.0], 1)])).collect()
    assert sorted((r["vec_id"] or 0, r["n_links"]) for r in twice) == [(0, 0), (1, 1), (1, 1)]


@pytest.mark.parametrize("block", [4096, 37])
def test_clusters_over_shards_and_blocks(spark, block):
    draw = np.random.default_rng(3)
    centres = draw.normal(size=(12, 16))
    vectors = [(int(k), [float(x) for x in (centres[k % 12] + draw.normal(scale=0.06, size=16)).astype(np.float32)], 0) for k in range(500)]
    vectors += [(1000 + k, vectors[0][1], 0) for k in range(30)]
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int")
    assert linked(hnsw.near_duplicates(frame, numbers=120 * 16, queries=block).collect()) == brute.cosine_links(vectors)


def test_recall_of_the_graph():
    """The walk alone, without the audit's widening, against brute force."""
    draw = np.random.default_rng(4)
    units = hnsw.unit(np.repeat(draw.normal(size=(150, 24)), 4, axis=0) + draw.normal(scale=0.05, size=(600, 24)))
    graph = hnsw.Graph(units)
    truth = units @ units.T >= 0.98
    found = sum(len(set(graph.above(q, 0.98, hnsw.BEAM)) & set(np.flatnonzero(truth[k]))) for k, q in enumerate(units))
    assert found >= 0.9 * truth.sum()
