"""Sharding, WARC, HTML, top-k, quotations: against plain versions, with odd rows."""

import json
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugewright.llm import html_text, quotations, sharding, top_k, warc
from gaugewright.session import new_path


def jump(key, shards):
    """The published algorithm."""
    key, b, j = key & (2**64 - 1), -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) & (2**64 - 1)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash(spark):
    keys = [0, 1, 2, 5, 10**6, 2**31, 2**40 + 7, 2**63 - 1, -1, -(2**63), *random.Random(3).sample(range(2**62), 200)]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for n in (1, 2, 24, 100):
        for r in df.select("k", sharding.jump_hash(F.col("k"), n).alias("j")).collect():
            assert (r["j"]["shard"], r["j"]["grown"]) == (jump(r["k"], n), jump(r["k"], n + 1))


def test_sharding(spark):
    rows = [(k, f"text {k}" * (k % 5)) for k in range(3000)] + [(None, "n"), (None, None), (7, "again"), (7, "again"), (4000, "é" * 100_000)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, _id int, shard int").repartition(4)
    for group in (1024, 16):
        got = sharding.assign_shards(df, group_rows=group).collect()
        assert len(got) == len(rows)
        slots = {}
        for r in got:
            slots.setdefault(r["shard"], []).append(r["slot"])
            assert r["grown_shard"] in (r["shard"], 24) and r["law"] == "key"
        assert set(slots) == set(range(24)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    one = next(r for r in got if r["doc_id"] == 4000)
    assert one["size"] == 200_008 and one["text_crc32"] == zlib.crc32(("é" * 100_000).encode())
    assert sorted((r["size"], r["text_crc32"]) for r in got if r["doc_id"] is None) == [(8, 0), (9, zlib.crc32(b"n"))]
    assert sharding.assign_shards(df.where("false")).count() == 0


def pages(spark, rows):
    return spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, bundle int").repartition(3)


def test_warc(spark):
    rows = [(1, "http://a/x y", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "u", None), (4, "u", ""), (5, "u", "big" * 400_000), (6, "u", "one\r\n\r\ntwo"), (None, "u", "<p>é</p>"), (6, "u", "one\r\n\r\ntwo")]
    path = new_path(spark, "warc-test")
    index = warc.write_archives(pages(spark, rows), path, frame_bytes=1000)
    got = warc.read_archives(index, path, with_payload=True).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["page_id"], []).append(r)
    assert (by[1][0]["record_type"], by[1][0]["refers_to"], by[1][0]["payload_bytes"]) == ("revisit", 2, 9)
    assert (by[2][0]["record_type"], bytes(by[2][0]["payload"])) == ("response", "<p>é</p>".encode())
    assert by[3][0]["refers_to"] == 4 and by[4][0]["payload_bytes"] == 0 and by[None][0]["record_type"] == "response"
    assert [r["record_type"] for r in by[6]] == ["response"] * 2
    assert all(r["payload_digest"] == warc.payload_digest((h or "").encode()) for i, _, h in rows for r in by[i])
    for r in index.collect():
        headers, block = warc.fetch(path, r["bundle"], r["frame"], r["offset"])
        assert headers["warc-record-id"] == r["record_id"] and warc.read_back(headers, block)[0] == r["page_id"]
    assert {r["record_type"] for r in warc.archive_round_trip(pages(spark, rows[:2]), spark, revisit_bytes=10).collect()} == {"response"}
    assert warc.archive_round_trip(pages(spark, rows).where("false"), spark).count() == 0


def test_bundles_are_plain_zstandard(tmp_path):
    import zstandard

    file = open(tmp_path / "b.zst", "wb")
    writer = warc.BundleWriter(file, 50)
    parts = [bytes([65 + k]) * 30 for k in range(7)]
    places = [writer.add(p) for p in parts]
    writer.close()
    raw = (tmp_path / "b.zst").read_bytes()
    assert zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read() == b"".join(parts)
    with open(tmp_path / "b.zst", "rb") as f:
        table = warc.seek_table(f, len(raw))
        assert len(table) == 7 and all(warc.read_frame(f, table[k])[o : o + 30] == p for (k, o), p in zip(places, parts, strict=True))


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><article>no</article>";</script></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href=x>Menu one, two, three.</a></li></ul></nav><!-- <p>hidden</p> -->
<div class="ad">Buy this, it is good. Really, it is very good, they say.</div><aside>Side, side, side.</aside>
<div id="main"><div class=post><h2>Title &amp; more</h2><p>First paragraph, with   some
words &eacute;&nbsp;x. And more of it, so that it is long.<p>Second, <b>bold</b> and <a href="y">linked</a>; also long enough to count.</p>
<div class="share-buttons">Share, now!</div><form><input value="q"><label>Search, please.</label></form><ul><li>point one<li>point two</ul>
<div class="cookie-notice">We use cookies, as all do.</div><section id="comments"><p>A reader comment, which is long, very long, and wordy.</p></section></div></div>
<footer>Copyright, all rights, reserved.</footer></body></html>"""


def test_html():
    assert html_text.main_text(PAGE) == "Title & more\nFirst paragraph, with some words é x. And more of it, so that it is long.\nSecond, bold and linked; also long enough to count.\npoint one\npoint two"
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<html><nav>a, b.</nav>") == ""
    assert html_text.main_text("<p>plain, text.<p>two") == "plain, text.\ntwo"
    assert html_text.main_text("<body><article><p>Hi.</p></article><footer>A much longer footer, really, than the article.</footer>") == "Hi."
    assert len(html_text.main_text("<article>" + "<div>" * 3000 + "deep, text." + "<p>x, y." * 20_000)) > 80_000
    assert html_text.main_text("<p>a < b &lt; c<br>d</p>") == "a < b < c d"


def test_html_content_in_several_containers():
    lead, long = "A lead, with a few words of its own, that counts.", "A long paragraph, full of words, and of commas; it goes on, and on."
    page = f"<body><div id=wrap><h1>T</h1><div class=lead><p>{lead}</p></div><div class=body>{f'<p>{long}</p>' * 9}</div></div></body>"
    assert html_text.main_text(page) == "\n".join(["T", lead, *[long] * 9])
    page = f"<body><div><section><p>{lead}</p></section><article>{f'<p>{long}</p>' * 9}</article></div></body>"
    assert html_text.main_text(page) == "\n".join([lead, *[long] * 9])


def test_html_scores_decide_inside_the_article():
    long = "A long paragraph, full of words, and of commas; it goes on, and on."
    box = "<div><h3>Read on</h3><ul><li><a>One</a><li><a>Two</a></ul><div><span>Send</span></div><div><label>Mail</label><b>Go</b></div></div>"
    page = f"<body><article>{{}}<div><h1>T</h1><i>By x</i></div>{f'<p>{long}</p>' * 5}<h2>S</h2><div><pre>x = 1</pre></div><p>{long}</p><ul><li>one</ul>{box}</article>"
    for before in ("", "<div><ul><li><a>Top</a><li><a>New</a></ul></div>"):
        lines = html_text.main_text(page.format(before)).split("\n")
        assert [x for x in lines if x not in ("By x", "Top", "New")] == ["T", *[long] * 5, "S", "x = 1", long, "one"]


@pytest.mark.parametrize("opened", ['div class="layout has-sidebar"', 'div class="page no-comments"', "div class='cookie-page'", "form id=aspnet", "div id=search"])
def test_html_marks_around_the_article(opened):
    long = "A long paragraph, full of words, and of commas; it goes on, and on."
    page = f"<body><{opened}><h1>T</h1>{f'<p>{long}</p>' * 5}<div class=ad>Buy this, it is good.</div></{opened.split()[0]}></body>"
    assert html_text.main_text(page) == "\n".join(["T", *[long] * 5])


def test_html_marks_are_not_topics():
    long = "A long paragraph, full of words, and of commas; it goes on, and on."
    parts = ["<section id=discussion>{}</section>", "<div class=section id=search>{}</div>", "<div id=search-algorithms>{}</div>", "<h2 id=related-work>W</h2>{}"]
    page = f"<body><article><h1>T</h1><p>{long}</p>{''.join(p.format(f'<p>{long}</p>') for p in parts)}<div id=sidebar-left>{long}</div><section id=comments>{long}</section></article></body>"
    assert html_text.main_text(page) == "\n".join(["T", *[long] * 4, "W", long])


@pytest.mark.parametrize("part", ['<div class="entry-header"><h1>T</h1></div>', "<header><h1>T</h1><nav>Up, down.</nav><p>By x, y.</p></header>"])
def test_html_headings_of_the_article(part):
    long = "A long paragraph, full of words, and of commas; it goes on, and on."
    more = f'<section class="related-work"><p>{long}</p></section><div class="search-results-study"><p>{long}</p></div><div class="post-comments"><p>{long}</p></div><div class=related-posts><p>{long}</p></div>'
    page = f"<body><header><h1>Site</h1></header><article>{part}<p>{long}</p>{more}</article></body>"
    assert html_text.main_text(page) == "\n".join(["T", *[long] * 3])


def test_html_ratios_are_as_defined():
    page = "<body><div><p>One, two. Three!</p><p>Four, five.</p></div><ul><li>Six</li></ul><div><b>Seven, eight; nine.</b></div></body>"
    elements, texts = html_text.parse(page)
    nodes = [("p", "One, two. Three!"), ("p", "Four, five."), ("li", "Six"), ("b", "Seven, eight; nine.")]
    assert [(elements[t.element].tag, t.text) for t in texts] == nodes
    ratio = {"p": (27 / 2, 5 / 2), "li": (3, 0), "b": (19, 3)}  # characters and punctuation marks a node
    smooth = [[(3 * a + b) / 4, (a + 2 * b + c) / 4, (b + 3 * c) / 4] for a, b, c in zip(*ratio.values(), strict=True)]
    fused = [(x * (y + 0.05)) ** 0.5 for x, y in zip(*smooth, strict=True)]
    limit = html_text.THRESHOLD * np.std(fused)
    want = {elements[t.element].path for t in texts if fused[list(ratio).index(elements[t.element].tag)] >= limit}
    assert html_text.content_paths(elements, texts) == want


def test_html_without_ratios_is_another_text(monkeypatch):
    long = "A long paragraph, full of words, and of commas; it goes on, and on."
    box = "<div><ul><li><a>One</a><li><a>Two</a></ul><div><span>Send</span></div></div>"
    page = f"<body><div><ul><li><a>Top</a><li><a>New</a></ul></div><main><h1>T</h1>{f'<p>{long}</p>' * 5}{box}</main></body>"
    with_ratios = html_text.main_text(page)
    assert with_ratios.startswith("\n".join(["T", *[long] * 5])) and "Send" not in with_ratios
    monkeypatch.setattr(html_text, "content_paths", lambda elements, texts: {e.path for e in elements})
    assert html_text.main_text(page) != with_ratios


@pytest.mark.parametrize("page", ["<div>x" * 100_000, '<a "' * 100_000, "<a b='" * 100_000, "</x>" * 50_000 + "<div>" * 50_000 + "</x>" * 50_000, "<div>" + "<span>" * 50_000 + "<p><li>" * 50_000, "<!--" * 100_000, "<script>" + "</script" * 100_000, '<a b=">' * 100_000, "<p>" + "&amp" * 200_000])
def test_html_takes_linear_time(page):
    import time
    import tracemalloc

    tracemalloc.start()
    start = time.process_time()
    html_text.main_text(page)
    assert time.process_time() - start < 30 and tracemalloc.get_traced_memory()[1] < 400e6
    tracemalloc.stop()


def test_html_quotes_in_tags():
    assert html_text.main_text('<p title="a > b" id=x>One, two.</p><p title="5" tall">Three, four.</p><p class="x>Five, six.') == "One, two.\nThree, four.\nFive, six."


def test_html_table(spark):
    assert html_text.extract_pages(pages(spark, [(1, "u", "<p>x")]).where("false")).count() == 0
    rows = [(1, "u", PAGE), (None, None, None), (1, "u", PAGE)]
    got = html_text.extract_pages(pages(spark, rows)).collect()
    assert len(got) == 3 and all(r["n_chars"] == len(r["text"]) for r in got)


def test_html_articles_of_a_table(spark):
    import html
    import re

    table = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r["text"] for r in html_text.extract_pages(table).collect()}
    for r in table.collect():
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        want = [" ".join(html.unescape(re.sub(r"</?b>|<br>", " ", x)).split()) for x in re.split(r"</?p>|</?h1>", inner)]
        assert got[r["page_id"]] == "\n".join(x for x in want if x)


def plain_top_k(rows, k, every, scale=64):
    whole = {}
    vectors = [(i, np.floor(scale * np.array(v, dtype=float)).astype(np.int64)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    d = max(len(v) for _, v in vectors)
    vectors = [(i, np.pad(v, (0, d - len(v)))) for i, v in vectors]
    for i, v in vectors:
        if i % every == 0:
            found = sorted(((-int(v @ w), j) for j, w in vectors if j != i))[:k]
            whole[i] = [(r + 1, j, -s) for r, (s, j) in enumerate(found)]
    return whole


@pytest.mark.parametrize("block,step", [(8192, 1024), (40, 16)])
def test_top_k(spark, monkeypatch, block, step):
    monkeypatch.setattr(top_k, "BLOCK", block)
    monkeypatch.setattr(top_k, "QUERIES", block)
    monkeypatch.setattr(top_k, "STEP", step)
    r = np.random.default_rng(8)
    rows = [(k, (r.normal(size=20) * r.exponential()).astype(np.float32).tolist()) for k in range(300)]
    rows += [(300 + k, rows[k % 3][1]) for k in range(60)]  # ties
    rows += [(400, None), (420, [None] * 20), (440, [float("nan")] * 20), (460, [float("inf")] + [0.0] * 19), (480, [0.0] * 20), (500, [1.0, 2.0]), (520, []), (None, [1.0] * 20)]
    df = spark.createDataFrame([(i, v, 1.0) for i, v in rows], "vec_id long, embedding array<float>, score double").repartition(5)
    got = {}
    for x in top_k.search_table(df, k=7, every=20).collect():
        got.setdefault(x["query_id"], []).append((x["rank"], x["vec_id"], x["score"]))
    assert {q: sorted(v) for q, v in got.items()} == plain_top_k(rows, 7, 20)


def test_top_k_of_huge_and_repeated_vectors(spark):
    df = spark.createDataFrame([(0, [1e30, 1.0]), (1, [1e30, 1.0]), (20, [1.0, 2.0])], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError, match="64 bits"):
        top_k.search_table(df)
    rows = [(0, [1.0]), (0, [2.0]), (3, [1.0]), (3, [1.0]), (4, [-1.0])]
    got = top_k.search_table(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=3).collect()
    assert sorted((r["rank"], r["vec_id"], r["score"]) for r in got) == [(1, 3, 8192), (2, 3, 8192), (3, 3, 4096)]


def test_top_k_in_rounds(spark, monkeypatch):
    for name, value in (("BLOCK", 10), ("QUERIES", 7), ("STEP", 4), ("ROUND", 2), ("GROWTH", 3)):
        monkeypatch.setattr(top_k, name, value)
    r = np.random.default_rng(4)
    rows = [(k, (r.normal(size=24) * (1 + r.exponential())).tolist()) for k in range(300)]
    got = {}
    for x in top_k.search_table(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=5).collect():
        got.setdefault(x["query_id"], []).append((x["rank"], x["vec_id"], x["score"]))
    assert {q: sorted(v) for q, v in got.items()} == plain_top_k(rows, 5, 20)


def test_top_k_of_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0]), (20, [2.0])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, top_k.search_table(df).collect())) == [(0, 1, 20, 8192), (20, 1, 0, 8192)]
    assert top_k.search_table(df.where("false")).count() == 0 and top_k.search_table(df.where("vec_id = 0")).count() == 0


TALK = [
    (1, 0, "user", "Where is it?\nI looked  everywhere."),
    (1, 1, "assistant", "On the table."),
    (1, 2, "user", "On Monday they wrote:\n> where is it?\n> i looked everywhere.\n\nStill looking."),
    (1, 3, "user", "> On the table.\nFound it!"),
    (1, 4, "assistant", "> > Where is it?\n>Still looking.\nGood."),
    (1, 5, "user", "> never said\nHm."),
    (2, 0, "user", None), (2, 1, "x", ""), (2, 1, "x", ""), (None, 0, "user", "> On the table."), (2, None, "user", "On the table."), (3, 0, None, "> self\nself"),
]


def test_quotations(spark):
    df = spark.createDataFrame([(*t, 1) for t in TALK], "conv_id long, turn long, role string, text string, path int").repartition(3)
    got = quotations.reply_order(df).cache()
    assert got.count() == len(TALK)
    rows = {(r["conv_id"], r["turn"]): r for r in got.collect()}
    assert [rows[1, k]["parent_turn"] for k in range(6)] == [None, None, 0, 1, 2, None]
    assert rows[1, 2]["text"] == "Still looking." and rows[1, 4]["text"] == "Good." and rows[1, 4]["n_quoted"] == 2
    assert [rows[1, k]["depth"] for k in range(6)] == [0, 0, 1, 1, 2, 0]
    assert sorted(range(6), key=lambda k: rows[1, k]["position"]) == [0, 2, 4, 1, 3, 5]
    assert rows[3, 0]["parent_turn"] is None and rows[3, 0]["role"] is None and rows[None, 0]["parent_turn"] is None
    assert sorted(r["position"] for r in got.where("conv_id = 2").collect()) == [0, 1, 2, 3]
    talk = {(r["conv_id"], r["part"]): r for r in quotations.conversations(got, most=2).collect()}
    assert talk[1, 0]["messages"] == 2 and talk[1, 0]["text"].startswith("<|user|>\nWhere is it?")
    assert quotations.reply_order(df.where("false")).count() == 0


def test_quotations_wrapped_anew(spark):
    long = "The shelf in the hall holds the keys, the lamp and a box of old letters from the north. Thanks."
    talk = [
        (1, 0, "Thanks."),
        (1, 1, long),
        (1, 2, "> The shelf in the hall holds the keys, the\n> lamp and a box of old\n> letters from the north.\n> Thanks.\nWhich keys do you mean, the ones\nof the cellar or those of the attic?"),
        (1, 3, ">> The shelf in the hall holds\n>> the keys, the lamp and a box\n> Which keys do you mean, the ones of the\n>\n> cellar or those\n> of the attic?\nBoth."),
        (1, 4, "> > Which keys do\n> > you mean, the ones of the cellar or\n> Both.\nGood."),
    ]
    df = spark.createDataFrame(talk, "conv_id long, turn long, text string").withColumn("role", F.lit("user"))
    got = {r["turn"]: (r["parent_turn"], r["depth"]) for r in quotations.reply_order(df).collect()}
    assert got == {0: (None, 0), 1: (None, 0), 2: (1, 1), 3: (2, 2), 4: (3, 3)}


def test_contract_columns():
    from gaugewright.llm.queries import ORACLE_SQL, QUERIES

    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 11))
    assert set(ORACLE_SQL) <= set(QUERIES)
    assert json.dumps(sorted(ORACLE_SQL))


def test_threads_against_a_walk(spark):
    rng = random.Random(7)
    trees = {1: {t: rng.choice([None, *range(max(0, t - 6), t)]) if t else None for t in range(90)}, 2: {t: t - 1 if t else None for t in range(70)}, 3: {t: 0 if t else None for t in range(60)}}
    nodes = spark.createDataFrame([(c, t, p) for c, tree in trees.items() for t, p in tree.items()], "conv_id long, turn long, parent long").repartition(5)
    got = {(r["conv_id"], r["turn"]): (r["root"], r["depth"], r["following"]) for r in quotations.reply_threads(nodes).collect()}
    for c, tree in trees.items():
        walk = []

        def enter(t, root, depth, tree=tree, walk=walk):
            walk.append((t, root, depth))
            for reply in sorted(x for x, p in tree.items() if p == t):
                enter(reply, root, depth + 1)

        for root in sorted(t for t, p in tree.items() if p is None):
            enter(root, root, 0)
        assert [(t, *got[c, t][:2]) for t in sorted(tree, key=lambda t: (got[c, t][0], -got[c, t][2]))] == walk
        assert len({(got[c, t][0], got[c, t][2]) for t in tree}) == len(tree)
