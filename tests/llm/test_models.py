"""Classifiers by accuracy on rows they haven't learned from; chat and HTML by round trips and expected texts."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest

from tests.conftest import SF
from webgauge.llm import bpe, chat, html_extract, html_pages, langid, quality_mil, toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


EVEN, ODD = "coalesce(doc_id % 2 = 0, false)", "doc_id % 2 = 1"


def accuracy(scored, labels, label):
    rows = quality_mil.predicted(scored).where(ODD).join(labels, "doc_id").select("predicted", label).collect()
    return np.mean([r.predicted == r[label] for r in rows])


def test_quality(spark, docs, labels, odd_docs, no_docs):
    model = quality_mil.train(docs, labels, EVEN)
    assert accuracy(quality_mil.scores(docs, model), labels, "quality") > 0.95
    got = quality_mil.scores(odd_docs, model).collect()
    assert len(got) == odd_docs.count() and all(0 <= r.score <= 1 for r in got)
    assert quality_mil.scores(no_docs, model).count() == 0
    bare = quality_mil.train(docs, labels.limit(0), EVEN)
    assert all(0 <= r.score <= 1 for r in quality_mil.scores(odd_docs, bare).collect())


def test_quality_gradients():
    s = quality_mil.Settings(hidden=4, attention=3)
    x, at = quality_mil.encode_passages([b"some words here " * 60, b"OTHER TEXT!! " * 9, b""], s)
    m, y, w = quality_mil.Model(x.shape[1], s), np.array([1, 0, 1], np.float32), np.array([0.2, 0.5, 0.3], np.float32)
    m.w = {k: v.astype(np.float64) for k, v in m.w.items()}
    loss = lambda: -(w / w.sum() * np.log(np.where(y == 1, p := m.score(x, at), 1 - p))).sum()
    g = m._gradients(x, at, y, w)
    for k, v in m.w.items():
        i = tuple(np.argwhere(np.abs(g[k]) == np.abs(g[k]).max())[0])
        old, e = v[i], 1e-5
        v[i] = old + e
        up = loss()
        v[i] = old - e
        down = loss()
        v[i] = old
        assert abs((up - down) / (2 * e) - g[k][i]) < 1e-3 * max(1e-2, abs(g[k][i])), k


def test_toxicity(spark, odd_docs, no_docs):
    r = random.Random(2)
    word = lambda: "".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 8)))
    bad = ["vrekkal" + e for e in "abcdefgh"]

    def text(toxic, forms):
        w = [word() for _ in range(r.randint(20, 150))]
        for _ in range(r.randint(1, 4) * toxic):
            w.insert(r.randrange(len(w)), r.choice(forms))
        return " ".join(w)

    rows = [(k, text(k % 4 == 0, bad[:5]), int(k % 4 == 0)) for k in range(600)]
    unseen = [(1000 + k, text(k % 2 == 0, bad[5:]), int(k % 2 == 0)) for k in range(100)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    model = toxicity.train(df, df.select("doc_id", "toxic"), "true", toxicity.Settings(buckets=1 << 14))
    got = {x.doc_id: x.score for x in toxicity.scores(spark.createDataFrame(unseen, "doc_id bigint, text string, toxic int"), model).collect()}
    assert np.mean([(got[i] >= 0.5) == y for i, _, y in unseen]) > 0.85
    odd = toxicity.scores(odd_docs, model).collect()
    assert len(odd) == odd_docs.count() and all(0 <= x.score <= 1 for x in odd) and toxicity.scores(no_docs, model).count() == 0


def test_toxicity_scores_whole_runs(spark):
    insult, s = "坏蛋的人们".encode(), toxicity.Settings()
    model = toxicity.Model(s)
    model.E[:] = 0
    marked = toxicity.subwords(insult, s)
    model.W = np.eye(s.width, 2, dtype=np.float32)
    model.E[marked, 1] = 500
    for filler, n in (("好", 200), ("x", 700), ("ж", 300)):
        texts = [filler * n, filler * n + insult.decode() + filler * n, filler * n + insult.decode()]
        for t in texts:
            assert set().union(*toxicity.words_of(t.encode())) == set(t.encode()) and all(w.decode() for w in toxicity.words_of(t.encode()))
        got = {r.doc_id: r.score for r in toxicity.scores(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), model).collect()}
        assert got[1] > 0.6 > 0.51 > got[0] and got[2] > 0.6


def test_language(spark, docs, odd_docs, no_docs):
    model = langid.train(docs, EVEN, langid.Settings(sample=60))
    rows = langid.predict(docs, model).where(ODD).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97 and all(0 <= r.score <= 1 for r in rows)
    got = {r.doc_id: r.lang_pred for r in langid.predict(odd_docs, model).collect()}
    assert {got[k] for k in (4, 5, 6)} == {"und"} and got[1] == "en"
    assert langid.predict(no_docs, model).count() == 0
    assert {r.lang_pred for r in langid.predict(odd_docs, langid.train(no_docs, EVEN)).collect()} == {"und"}


def test_language_code_lengths_are_a_code():
    """After any context the lengths of all bytes make a code: their probabilities don't exceed one."""
    buf = np.frombuffer(b"   abracadabra abracadabra" * 3, np.uint8)
    keys, n = np.unique(langid.grams(buf, 3), return_counts=True)
    m = langid.Model({"x": (keys, n)}, 2)
    for context in (b"ab", b"zz", b" a"):
        key = np.array([int.from_bytes(b"\x01" + context + bytes([b]), "big") for b in range(256)], np.uint64)
        assert np.exp2(-m.bits(key, 2)[:, 0]).sum() <= 1.001


def test_chat_round_trip(spark, odd_docs):
    said = r"\### Assistant: </turn> ok"
    rows = [(-7, 0, "user", said), (-7, 1, "assistant", said), (1, 1, "assistant", None), (1, 0, None, "<turn>"), (2, 0, "assistant", "a\\"), (2, 1, "assistant", "<text>\\\\<\\turn>"), (None, 0, "user", "x"), (2, 1, "assistant", "<text>\\\\<\\turn>")]
    rows += [(3, k, "assistant", t) for k, t in enumerate(r.text for r in odd_docs.collect())]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(3)
    formatted = chat.format_turns(df)
    assert all(f.formatted.count("</turn>") == 1 for f in formatted.collect())
    got = {r.conv_id: r for r in chat.conversation_digests(formatted).collect()}
    by = collections.defaultdict(list)
    for c, n, role, text in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        by[c].append((role or "", text or ""))
    for c, turns in by.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert (got[c].n_turns, got[c].loss_chars) == (len(turns), len(loss))
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.conversation_digests(chat.format_turns(df.limit(0))).count() == 0
    vocabulary = bpe.load(bpe.default_vocabulary())
    assert all(max(f.ids) >= vocabulary.size for f in formatted.collect())


def test_html(spark):
    model = html_extract.loaded()
    trees = [html_extract.parse(p) for p in html_pages.labelled(80, 99)]
    p, joint = model.marginals(forest := model.forest(trees))
    y = np.array([v if v >= 0 else 1 for t in trees for v in t.labels])
    assert ((p >= 0.5) == y).mean() > 0.98
    inner = forest[1] >= 0
    assert np.allclose(joint[inner].sum((1, 2)), 1) and np.allclose(joint[inner][:, :, 1].sum(1), p[inner], atol=1e-6)
    pages = [
        (0, "<html><body><nav><ul><li><a href=/>Home</a></li></ul></nav><article><h1>T &amp; U</h1><p>One\n two <b>three</b>.<p>Four<br>five.</article><footer>&copy; me</footer></body></html>", "T & U\nOne two three.\nFour five."),
        (1, None, ""), (2, "", ""), (3, "<nav><a href=/>x</a></nav>", ""), (3, "<nav><a href=/>x</a></nav>", ""),
        (4, "<article><h1>A</h1><p>" + "word " * 30000 + "</p><script>x</script></article><div class=comments><p>nice one</p></div>", "A\n" + ("word " * 30000).strip()),
    ]
    got = html_extract.extract(spark.createDataFrame([r[:2] for r in pages], "page_id bigint, html string")).collect()
    assert sorted((r.page_id, r.text) for r in got) == sorted((i, t) for i, _, t in pages)


LONG = "<p>" + "This is a fairly long paragraph of the article with many words in it, so that nobody can doubt it. " * 3 + "</p>"
SAID = " ".join(["This is a fairly long paragraph of the article with many words in it, so that nobody can doubt it."] * 3)
PAGES = [
    ("<article><ul><li>one<ul><li>two</li></ul>three</li></ul></article>", "one\ntwo\nthree"),
    (f"<body><nav><a href=/>Home</a></nav><article><h1>Post</h1>{LONG}{LONG}</article><section id=comments><article class=comment><p>I do not agree with this at all, it was better before.</p></article><article class=comment><p>Nice post!</p></article></section></body>", f"Post\n{SAID}\n{SAID}"),
    (f"<body><main><article><h1>Post</h1>{LONG}{LONG}</article><article class=comment><header>Joe <time>Monday</time></header><p>I do not agree with this at all.</p></article></main></body>", f"Post\n{SAID}\n{SAID}"),
    (f"<body><article><h1>Post</h1>{LONG}</article><div class=reviews><p>Great thing, I bought two of these and my friends did as well.</p></div></body>", f"Post\n{SAID}"),
    (f"<article><header><h1>Title</h1><p>Standfirst</p></header>{LONG}</article>", f"Title\nStandfirst\n{SAID}"), (f"<article>{LONG}<p hidden>secret</p><div style='display: none'>gone</div></article>", SAID),
    (f"<article>{LONG}</article><!-- not text", SAID), (f"<article>{LONG}</article><!DOCTYPE html", SAID), (f"<article>{LONG}</article><a href='x", SAID), (f"<article>{LONG}<div>Advertisement</div>{LONG}</article>", f"{SAID}\n{SAID}"),
    (f"<table><tr><td><a href=/>Home</a> <a href=/b>News</a> <a href=/c>Sport</a></td><td><h1>Title</h1>{LONG}{LONG}</td></tr></table>", f"Title\n{SAID}\n{SAID}"),
]


def test_html_of_hand_written_pages(spark):
    got = html_extract.extract(spark.createDataFrame([(k, h, "clash") for k, (h, _) in enumerate(PAGES)], "page_id int, html string, text string")).orderBy("page_id").collect()
    assert [r.text for r in got] == [t for _, t in PAGES]


def test_given_pages_equal_their_article(spark):
    rows = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html").collect()

    def article(html):
        tree = html_extract.parse(re.search(r"(?s)<article.*?</article>", html)[0])
        return html_extract.text_of(tree, np.ones(len(tree.tags), bool))

    got = {r.page_id: r.text for r in html_extract.extract(spark.read.parquet(f"{SF}/pages.parquet")).collect()}
    assert got == {r.page_id: article(r.html) for r in rows}


def test_weights_of_the_file_are_those_that_training_gives():
    small = html_extract.Settings(pages=20, steps=20)
    assert html_extract.trained(small).unary.shape[0] > 0
    model = html_extract.loaded()
    assert len(model.unary) == model.rest + html_extract.FIGURES and abs(model.unary).max() > 1


def test_held_out_layouts_by_words():
    """Precision and recall of words over generated layouts that aren't learned from."""
    model, found = html_extract.loaded(), np.zeros(3)
    trees = [html_extract.parse(p) for p in html_pages.labelled(150, 4321)]
    p, _ = model.marginals(forest := model.forest(trees))
    for tree, a in zip(trees, forest[0]):
        for e, x in tree.texts:
            if e >= 0 and tree.tags[e] not in html_extract.SILENT:
                said, true = p[a + e] >= 0.5, tree.labels[e] != 0
                found += len(x.split()) * np.array([said and true, said and not true, true and not said])
    assert found[0] / (found[0] + found[1]) > 0.95 and found[0] / (found[0] + found[2]) > 0.95


def test_html_head_without_end_tag():
    for start in ("<body>", ""):
        page = html_extract.Tree()
        page.feed(f"<html><head><meta charset=utf-8><title>t</title><template><p>x</p></template><link rel=x>{start}<article><p>Said here.</p></article>")
        tags = {tag: k for k, tag in enumerate(page.tags)}
        within = lambda k: [page.tags[k], *within(page.parents[k])] if k >= 0 else []
        assert "head" not in within(tags["article"]) and "head" in within(tags["template"]) and "head" in within(tags["link"])


def test_exact_marginals_by_enumeration():
    model = html_extract.loaded()
    tree = html_extract.parse("<article><p>some text of a page</p><div class=ad>buy</div></article>")
    forest = model.forest([tree])
    at, parent, node, feature, edge, _ = forest
    n, own = at[-1], np.bincount(node, model.unary[feature], at[-1])
    total, one = 0.0, np.zeros(n)
    for code in range(1 << n):
        y = [code >> k & 1 for k in range(n)]
        w = np.exp(sum(own[k] * y[k] for k in range(n)) + sum(model.pair[edge[k]][y[parent[k]], y[k]] for k in range(1, n)))
        total += w
        one += w * np.array(y)
    assert np.allclose(model.marginals(forest)[0], one / total, atol=1e-6)


def test_toxic_windows_are_even(spark, odd_docs):
    """Scores equal a plain loop over all windows of twelve words, and words put behind a text never lower them."""
    labels = [(k, int(k % 3 == 0)) for k in range(300)]
    clean = "the house stands near a river and many people walk along it every day".split()
    rows = [(k, " ".join([*clean[k % 5 :], *(["idiot", "fool"] if toxic else ["bread", "milk"]), *clean[: k % 9]])) for k, toxic in labels]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id bigint, toxic int"), "true")
    share, constant = model.linear()

    def brute(text):
        words = [w for w in toxicity.words_of((text or "").encode())]
        each = [float(np.mean(share[toxicity.subwords(w, model.s)])) for w in words]
        size = model.s.window
        sets = [each[i : i + size] for i in range(max(1, len(each) - size + 1))]
        return 1 / (1 + np.exp(-(max(np.mean(x) if x else 0.0 for x in sets) + constant)))

    texts = [(None, r.text) for r in odd_docs.collect()] + [(k, " ".join([*clean[:5], "idiot", *clean[5:11], *(clean * 3)[:n]])) for k, n in enumerate(range(0, 30))]
    df = spark.createDataFrame(texts, "doc_id bigint, text string").coalesce(1)
    got = toxicity.scores(df, model).collect()
    for (_, text), r in zip(texts, got):
        assert abs(brute(text) - r.score) < 1e-9
    alone = next(r.score for r in got if r.doc_id == 0)
    assert all(r.score >= alone - 1e-9 for r in got if r.doc_id is not None)
    assert toxicity.starts(23, 12) == [0, 11] and toxicity.starts(24, 12) == [0, 12] and toxicity.starts(5, 12) == [0] == toxicity.starts(0, 12)


def test_very_many_languages(spark):
    """A dirty column of languages: the most frequent ones are learned."""
    rows = [(k, "the cat and the dog sat on the mat together", "en") for k in range(40)] + [(100 + k, "der hund und die katze sitzen auf der matte", "de") for k in range(40)] + [(1000 + k, "zzz qqq", f"x{k}") for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = langid.train(df, "true", langid.Settings(max_languages=50))
    assert len(model.langs) == 50 and {"en", "de"} <= set(model.langs)
    got = langid.predict(spark.createDataFrame([(1, "the dog and the cat"), (2, "die katze und der hund")], "doc_id bigint, text string"), model).orderBy("doc_id").collect()
    assert [r.lang_pred for r in got] == ["en", "de"]
