"""The three trained operators and the page extractor: held-out accuracy and edge cases."""

import zlib

import pytest
from helpers import ODD, documents
from pyspark.sql import functions as F

from relquill.llm import html_text, language_id, quality_model, toxicity
from relquill.llm._shared import crc_mod

SF = "/root/testdata/sf0.01"


def held(doc_id, n, r):
    return zlib.crc32(str(doc_id).encode()) % n == r


def labels_of(spark, column):
    return {r["doc_id"]: r[column] for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r[column] is not None}


def test_language(spark):
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    got = language_id.op8_language_id(spark, SF).collect()
    assert len(got) == len(lang) and all(r["held_out"] == held(r["doc_id"], 4, 2) and 0 <= r["score"] <= 1 for r in got)
    known = [r for r in got if r["held_out"] and lang[r["doc_id"]] is not None]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in known) / len(known) > 0.97


def test_language_spans():
    en, de = "the cat and the dog were in the house with all of them", "der Hund und die Katze waren mit allen in dem Haus gewesen"
    model = language_id.fit([("en", (en + " ") * 30), ("de", (de + " ") * 30), ("ru", "кошка и собака были дома " * 30)])
    text = f"{en}. {de}. кошка и собака"
    assert [x[2] for x in model.spans(text)] == ["en", "de", "ru"]
    assert model.spans(text)[2][:2] == (text.index("кошка"), len(text))
    assert model.predict([None, "", "12 !", "кошка"])[0] == ["und", "und", "und", "ru"]


def test_quality(spark):
    known = labels_of(spark, "quality")
    got = {r["doc_id"]: r for r in quality_model.op9_quality_model(spark, SF).collect()}
    assert all(r["held_out"] == held(i, 3, 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for i, r in got.items())
    out = [i for i in known if got[i]["held_out"]]
    assert sum(got[i]["predicted"] == known[i] for i in out) / len(out) > 0.93


def test_toxicity(spark):
    known = labels_of(spark, "toxic")
    got = {r["doc_id"]: r for r in toxicity.op2_toxicity(spark, SF).collect()}
    assert all(r["held_out"] == held(i, 5, 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for i, r in got.items())
    out = [i for i in known if got[i]["held_out"]]
    toxic, clean = [got[i]["score"] for i in out if known[i]], [got[i]["score"] for i in out if not known[i]]
    ranked = sum((a > b) + 0.5 * (a == b) for a in toxic for b in clean) / (len(toxic) * len(clean))
    assert ranked > 0.85  # six toxic documents are held out at this size


@pytest.mark.parametrize("with_labels", [True, False])
def test_edges(spark, with_labels):
    df = documents(spark, ODD + [(20 + i, f"plain words number {i}", "a") for i in range(20)])
    rows = [(i, i % 2, i % 2) for i in range(20, 40)] if with_labels else []
    labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    held_out = crc_mod(F.col("doc_id"), 5) == 0
    for out in (toxicity.toxicity(df, labels, held_out), quality_model.quality(df, labels, held_out), language_id.languages(df, held_out)):
        got = out.collect()
        assert len(got) == len(ODD) + 20 and all(r["score"] is not None and 0 <= r["score"] <= 1 for r in got)
    empty = documents(spark, [])
    for out in (toxicity.toxicity(empty, labels, held_out), quality_model.quality(empty, labels, held_out), language_id.languages(empty, held_out)):
        assert out.count() == 0


PAGE = """<html><head><title>t</title><style>p{}</style><script>var a = "<p>no</p>";</script></head><body>
<nav><ul><li><a href=/>Home</a></li><li><a href=/x>News &amp; more</a></li></ul></nav><header><h1>Site</h1></header>
<article><h1>The  title</h1><p>First &eacute;paragraph with <b>bold</b> and\n a <a href="/y">link</a> in a long enough line of text to read.</p>
<p>Second &lt;paragraph&gt; &#233;&#x1F600; of the same article, again long enough to be taken for text.</p>
<form>Subscribe now to our letter<input></form><div class="comments"><p>Reader: what a long comment this is, first of its kind!</p></div></article>
<aside>Related: nothing</aside><footer>Copyright 2024 all rights reserved by nobody</footer></body></html>"""


def test_layout_classes_do_not_hide_the_article():
    text = "a paragraph that is long enough to be taken for the text of a page, with no link in it"
    for head in ('<body class="has-sidebar no-footer">', '<body><article class="post with-comments">', '<body id="header-fixed"><main class="search-page">'):
        assert html_text.main_text(f"{head}<p>{text}</p>") == text
    assert html_text.main_text(f'<article><p>{text}</p><div class="cookie-notice"><p>{text}</p></div></article>') == text


def test_pages(spark, sf_dir):
    want = ["The title", "First éparagraph with bold and a link in a long enough line of text to read.", "Second <paragraph> é\U0001f600 of the same article, again long enough to be taken for text."]
    assert html_text.main_text(PAGE) == "\n\n".join(want)
    rows = [(1, "u", PAGE), (2, None, None), (3, "v", ""), (None, "w", "<p>unclosed"), (3, "v", ""), (5, "x", "<div>" * 20_000 + "deep"), (6, "y", "<p " + "a" * 100_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'c' AS text", "1 AS n_chars")
    got = html_text.extract(df).collect()
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    pages = html_text.op10_html_text(spark, sf_dir)
    assert pages.count() == spark.read.parquet(f"{sf_dir}/pages.parquet").count()
    assert html_text.extract(df.limit(0)).count() == 0
