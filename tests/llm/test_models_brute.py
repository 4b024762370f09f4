"""The trained operators and the page extractor against plain versions of what they compute."""

import itertools
import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pytest
from helpers import documents

from relquill.llm import _shared, html_text, language_id, quality_model, toxicity


def random_texts(n, seed):
    rng = np.random.default_rng(seed)
    words = ["go", "stop", "naïve", "stop", "ключ", "x" * 30, "a.b", "\n", "  "]
    return ["", None] + [" ".join(rng.choice(words, rng.integers(0, 25))) for _ in range(n)]


def network(seed=0):
    q, rng = quality_model, np.random.default_rng(seed)
    n = q.WIDTH * (q.DIMS + 1)
    return q.Network(
        rng.normal(0, 0.5, (256, q.DIMS)).astype(np.float32), rng.normal(0, 0.15, (n, q.FILTERS)).astype(np.float32),
        np.zeros(q.FILTERS, np.float32), rng.normal(0, 0.3, q.FILTERS).astype(np.float32), 0.1,
    )


def plain_score(net, text):
    """One text, one chunk and one filter at a time."""
    q, data = quality_model, (text or "").encode()
    if not data:
        return 1 / (1 + np.exp(-net.bias))
    level, last, run = [], None, 0
    for m in re.finditer(rb"[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", data):
        if m[0].isspace():
            level += [0.0] * len(m[0])
            continue
        run = run + 1 if m[0] == last else 0
        last = m[0]
        level += [min(run, 8) / 8] * len(m[0])
    size = -(-(len(data) + q.WIDTH + 1) // q.STRIDE) * q.STRIDE  # a chunk's width of blanks, up to the grid
    padded = data + b" " * (size - len(data) - 1) + b"\n"
    level += [0.0] * (size - len(data))
    best = np.zeros(q.FILTERS)
    for at in range(0, size - q.WIDTH + 1, q.STRIDE):
        x = np.concatenate([np.append(net.embed[padded[i]], level[i]) for i in range(at, at + q.WIDTH)]).astype(np.float64)
        best = np.maximum(best, x @ net.filters.astype(np.float64) + net.shift)
    return 1 / (1 + np.exp(-(best @ net.dense + net.bias)))


def test_quality_scores_are_each_texts_own():
    net, texts = network(), random_texts(60, 1)
    together = net.scores(texts)
    assert np.allclose(together, [plain_score(net, t) for t in texts], atol=2e-6)
    assert (together == np.concatenate([net.scores([t]) for t in texts])).all()
    assert (together == net.scores(texts[::-1])[::-1]).all()


def test_long_labelled_texts_teach(spark):
    rows = [(i, ("good prose here " if i % 2 else "zz#zz ") * 3000, "a") for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    net = quality_model.train(documents(spark, rows), labels)
    assert net.scores(["good prose here " * 20])[0] > 0.5 > net.scores(["zz#zz " * 20])[0]


def test_samples_have_no_label_limit_and_bounded_bytes(spark):
    rows = [(i, f"l{i % 300:03d}") for i in range(3000)]
    sample = _shared.sampled_ids(spark.createDataFrame(rows, "i long, l string"), "i", "l", 4)
    assert Counter(x for _, x in sample) == {f"l{j:03d}": 4 for j in range(300)}
    docs = documents(spark, [(i, "word " * (1 + i), "a") for i in range(30)])
    got = _shared.sampled_texts(docs, [(i, i % 2) for i in range(30)], "doc_id", "text", 600)
    assert {label for label, _, _ in got} == {0, 1} and sum(len(t) for _, _, t in got) <= 600
    assert all(t == "word " * (1 + i) for _, i, t in got)


def test_viterbi_is_the_best_of_all_labellings():
    rng = np.random.default_rng(4)
    sets = {"aa": "abcde", "bb": "cdefg", "cc": "efghi"}
    word = lambda chars: "".join(rng.choice(list(chars), 4))
    model = language_id.fit([(k, " ".join(word(v) for _ in range(300))) for k, v in sets.items()])
    for _ in range(20):
        text = " ".join(word(rng.choice(list(sets.values()))) for _ in range(6))
        w = language_id.words_of([text])
        score = model.word_scores(w)
        value = lambda path: sum(score[i, x] for i, x in enumerate(path)) - language_id.SWITCH * sum(a != b for a, b in zip(path, path[1:], strict=False))  # noqa: E731,B023
        best = max(value(p) for p in itertools.product(range(3), repeat=6))
        assert value(model.labels(w).tolist()) == pytest.approx(best, abs=1e-3)
    texts = ["abc cde", None, "", "hgi " * 50, "abcd efgh"]
    assert [model.predict([t])[0][0] for t in texts] == model.predict(texts)[0]


def plain_toxicity(model, text):
    """The sum over slots, their features counted one by one."""
    total, count = model.bias, Counter()
    for part in re.findall(rb"[^\x00-\x60\x7b-\x7f]+", (text or "").lower().encode()):
        stems = [n for n in toxicity.STEMS if len(part) > n]
        for key in toxicity.hashed([part])[0][: 1 + len(stems)]:
            count[int(model.slot[key])] += 1
    for slot, n in count.items():
        total += model.weight[slot, sum(n >= x for x in toxicity.LEVELS) - 1]
    return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def test_toxicity_scores_and_risk():
    rng = np.random.default_rng(2)
    texts = random_texts(60, 3)
    model = toxicity.Model(rng.integers(0, 50, 1 << toxicity.BITS).astype(np.int16), rng.normal(0, 0.5, (50, len(toxicity.LEVELS))), -0.2)
    assert np.allclose(model.scores(texts), [plain_toxicity(model, t) for t in texts])
    # positives alone have feature 0; a tenth of the unlabelled are positives too
    pos = np.concatenate([np.ones((200, 1)), rng.integers(0, 2, (200, 5))], axis=1).astype(np.int8)
    unl = rng.integers(0, 2, (1000, 6)).astype(np.int8)
    unl[:, 0] = np.arange(1000) < 100
    w, bias = toxicity.nnpu(pos, unl, 0.1)
    score = unl @ w + bias
    assert score[:100].min() > 0 > score[100:].max()


class Outline(HTMLParser):
    """Text of the article, or of the body of a page without one, by element names and the class of adverts alone."""

    DROP = frozenset("nav header footer aside form script style noscript template head title select button".split())
    BLOCK = frozenset("article p h1 h2 h3 h4 h5 h6 li ul ol div table tr td th section blockquote pre body html".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.article, self.drop, self.inside, self.parts = 0, [], [], [[], []]

    def handle_starttag(self, tag, attrs):
        if tag in self.BLOCK:
            self.parts[0].append("\0"), self.parts[1].append("\0")
        if tag == "br":
            self.handle_data(" ")
        self.article += tag == "article"
        hidden = tag in self.DROP and not (tag == "header" and self.article) or dict(attrs).get("class") == "ad"
        if hidden or self.drop and tag == self.drop[-1]:
            self.drop.append(tag)

    def handle_endtag(self, tag):
        if tag in self.BLOCK:
            self.parts[0].append("\0"), self.parts[1].append("\0")
        self.article -= tag == "article"
        if self.drop and tag == self.drop[-1]:
            self.drop.pop()

    def handle_data(self, data):
        if not self.drop:
            self.parts[1].append(data)
            if self.article > 0:
                self.parts[0].append(data)

    def text(self):
        blocks = [[" ".join(x.split()) for x in "".join(part).split("\0")] for part in self.parts]
        inside, every = (["\n\n".join(x for x in b if x)] for b in blocks)
        return inside[0] or every[0]


def test_pages_against_an_outline(spark, sf_dir):
    rows = html_text.op10_html_text(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html"), "page_id").collect()
    assert rows
    for r in rows:
        page = Outline()
        page.feed(r["html"] or "")
        page.close()
        assert r["text"] == page.text(), r["page_id"]


def test_names_of_states_do_not_hide_content():
    text = "a paragraph of ordinary words that goes on for long enough to be read as the text of a page " * 2
    body = f"<p>{text.strip()}</p><p>{text.strip()}</p>"
    for name in ("post tag-news", "content has-header", "entry share-enabled", "story no-sidebar"):
        assert html_text.main_text(f'<div class="{name}">{body}</div>').count("ordinary") == 4, name
    for name in ("sidebar", "site-footer", "entry comments", "cookie-banner", "siteFooter", "ad-slot"):
        assert html_text.main_text(f'<div class="{name}">{body}</div>') == "", name
    links = "<article><p>See:</p><ul><li><a href=a>First source</a></li><li><a href=b>Second source</a></li></ul></article>"
    assert html_text.main_text(links) == "See:\n\nFirst source\n\nSecond source"
    assert html_text.main_text("<article><p>x <math><mi>a</mi><mo>+</mo></math> y</p></article>") == "x a+ y"


def test_deep_pages_take_linear_time():
    import time

    began = time.process_time()
    for page in ("<div>w" * 16_000, "<div class=x><li class=ad>w</b></section>" * 16_000):
        html_text.main_text(page)
    assert time.process_time() - began < 5
