from collections import Counter
import re

import numpy as np
import pytest

import corpus_pipeline
from pyspark.sql import functions as F

from tenorlab.llm import html_extraction, language_id
from tenorlab.llm.queries import ORACLES, QUERIES
from tests.duck import same_rows
from tests.llm.conftest import rows


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in language_id.identify(docs).collect()}
    held = [(got[r.doc_id].lang_pred == r.lang) for r in docs.select("doc_id", "lang").collect() if got[r.doc_id].held_out]
    assert len(held) > 250 and np.mean(held) >= 0.98
    assert all(0 <= r.score <= 1 for r in got.values())


def test_predictions_of_odd_texts(docs, none):
    got = language_id.predict(docs.drop("score"), language_id.train(docs, ~language_id.held_out()))
    assert got.count() == len(rows())
    for r in got.collect():
        has = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred in ("en", "de", "fr")) == has and (r.lang_pred == "und") == (not has) and (r.score > 0) == has
    nothing = language_id.train(none, ~language_id.held_out())
    assert {r.lang_pred for r in language_id.predict(docs, nothing).collect()} == {"und"} and language_id.identify(none).count() == 0


def test_prediction_does_not_depend_on_batches(monkeypatch):
    table = np.random.default_rng(0).normal(size=(language_id.N_FEATURES, 3)).astype(np.float32)
    model, texts = {"langs": ["a", "b", "c"], "table": table}, ["hello world", None, "x" * 5000, "", "été"] * 3
    whole = language_id.predict_texts(model, texts)
    monkeypatch.setattr(language_id, "SLICE", 3)
    cut = language_id.predict_texts(model, texts)
    assert whole[0] == cut[0] and np.allclose(whole[1], cut[1])
    logits = []
    for n in range(3):  # a feature per position and order, by hand
        logits.append(language_id._grams(["hello world"])[3][n][:11])
    z = sum(table[f].sum(0) for f in logits) / 33
    assert abs(language_id.softmax(z).max() - whole[1][0]) < 1e-5


def plain_features(text):
    """Feature numbers of all 1- to 3-grams by whole-number arithmetic on characters."""
    low, full, out = text.lower(), 1 << 64, []
    c = [ord(x) if x.isalpha() else 32 for x in low] + [32, 32]
    for i in range(len(low)):
        rolled = 0
        for n in range(3):
            rolled = (rolled + c[i + n] + 1) * 0x9E3779B97F4A7C15 % full
            rolled ^= rolled >> 29
            out.append((rolled * 0xBF58476D1CE4E5B9 % full >> 48) % language_id.N_FEATURES)
    return out


def test_training_and_prediction_match_a_dense_brute_force():
    texts = [("the cat and the dog", 0), ("der hund und die katze", 1), ("le chat et le chien", 2), ("The End, the 2 of it", 0), ("und ach so weiter", 1), ("été à la mer", 2)] * 2
    count = [Counter(plain_features(t)) for t, _ in texts]
    df = Counter(f for c in count for f in c)
    idf = {f: np.log((1 + len(texts)) / (1 + n)) + 1 for f, n in df.items()}
    x = np.zeros((len(texts), language_id.N_FEATURES))
    for i, c in enumerate(count):
        for f, n in c.items():
            x[i, f] = n / c.total() * idf[f] * language_id.SCALE
    # follow the regularised leader, all features at every step
    L = language_id
    z, n = np.zeros((L.N_FEATURES, 3)), np.zeros((L.N_FEATURES, 3))
    weights = lambda: np.where(np.abs(z) <= L.L1, 0, -(z - np.sign(z) * L.L1) / ((L.BETA + np.sqrt(n)) / L.ALPHA + L.L2))
    order = np.random.default_rng(7)
    for _ in range(L.EPOCHS):
        for k in order.permutation(len(texts)):
            w = weights()
            e = np.exp(x[k] @ w - (x[k] @ w).max())
            g = x[k][:, None] * (e / e.sum() - np.eye(3)[texts[k][1]])[None, :]
            z += g - (np.sqrt(n + g * g) - np.sqrt(n)) / L.ALPHA * w
            n += g * g
    want = weights()
    rows_ = [(y, at := np.flatnonzero(x[i]), x[i, at]) for i, (_, y) in enumerate(texts)]
    got = L.train_ftrl(rows_, 3)
    assert np.abs(got - want).max() < 1e-9 and np.count_nonzero(want)
    table = (want * np.array([idf.get(f, np.log(1 + len(texts)) + 1) for f in range(L.N_FEATURES)])[:, None] * L.SCALE).astype(np.float32)
    langs, score = L.predict_texts({"langs": ["en", "de", "fr"], "table": table}, [t for t, _ in texts])
    for (t, _), lang, p in zip(texts, langs, score, strict=True):
        f = plain_features(t)
        e = np.exp(table[f].astype(float).sum(0) / len(f))
        assert lang == ["en", "de", "fr"][int(e.argmax())] and abs(p - (e / e.sum()).max()) < 1e-6


def test_no_id_and_no_language_fills_the_sample(spark, monkeypatch):
    monkeypatch.setattr(language_id, "SAMPLE_PER_LANGUAGE", 5)
    monkeypatch.setattr(language_id, "MOST_LANGUAGES", 3)
    seen = []
    monkeypatch.setattr(language_id, "train_ftrl", lambda rows_, n: seen.append((len(rows_), n)) or np.zeros((language_id.N_FEATURES, n)))
    data = [(1, f"text {'abcdefghij'[i % 10]} of one id", "en") for i in range(300)] + [(None, f"texte {'abcdefgh'[i % 8]}", "fr") for i in range(50)]
    data += [(i, f"x {i}", f"l{i:03d}") for i in range(90)] + [(7, None, "de")]
    model = language_id.train(spark.createDataFrame(data, "doc_id long, text string, lang string"), F.lit(True))
    assert model["langs"] == ["en", "fr", "l000"] and seen[0][0] <= 15 and seen[0][1] == 3


def test_ftrl_is_sparse_and_temperature_calibrates():
    r = np.random.default_rng(1)
    data = [(k := int(r.integers(3)), np.array([k, 10 + int(r.integers(500))]), np.array([1.0, 0.05])) for _ in range(600)]
    w = language_id.train_ftrl(data, 3)
    assert all(w[k].argmax() == k for k in range(3)) and np.count_nonzero(w[10:]) < 1500 and not w[600:].any()
    y = r.integers(0, 2, 4000)
    true = np.where(y == 0, 1.0, -1.0) * np.where(r.random(4000) < 0.75, 1, -1)
    t = language_id.fit_temperature(np.stack([5 * true, -5 * true], 1), y)
    assert abs(1 / (1 + np.exp(-10 / t)) - 0.75) < 0.02


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="sidebar-page"><header>H</header>
<nav><ul><li><a href="/a">A</a><li>B</ul></nav><!-- ad 1 --><div class="ad">buy</div><article id=x><header><p>by me</p></header><h1>Head &amp; more</h1><p><b>One  two<br>three
<p>Four &quot;five&quot; &copy &am <i>si</i>x</p><div><p>In div</p> tail </div><form>f</form><aside>s</aside><ul><li>i1<li>i2</ul><section class="comments"><p>reader</p></section>
<table><tr><td>c1<td>c2</table></article><footer>F</footer></body>"""


def text_of(page):
    blocks, marked, _ = html_extraction.read_page(page)
    return [t for t, _, may in blocks if may], marked


def test_article_text():
    want = ["Head & more", "One two three", 'Four "five" © &am six', "In div", "tail", "i1", "i2", "c1", "c2"]
    assert text_of(PAGE) == (want, True)
    assert text_of(None) == ([], False) and text_of("") == ([], False) and text_of("plain &lt;b&gt;")[0] == ["plain <b>"]
    assert text_of("<main><p>m</p></main><p>out</p>") == (["m"], True)
    assert text_of("<p>a</p><p hidden>b</p><div style='display: none'>c</div><p>d")[0] == ["a", "d"]
    assert text_of("<div>" * 5000 + "deep" + "</div>" * 5000)[0] == ["deep"]
    assert text_of("<article>x<!-- never closed </article>")[0] == ["x"]


def test_attributes_are_parsed():
    assert text_of('<p>See <a href="/x?id=nav">this report</a> now</p>')[0] == ["See this report now"]
    assert text_of('<div title="The hidden valley"><p>a</p></div><div data-id="sidebar">b</div><p data-role=navigation>c</p>')[0] == ["a", "b", "c"]
    assert text_of("<div id='sidebar'>a</div><div CLASS=ad>b</div><div class='x&#32;nav'>c</div><div role = \"navigation\">d</div><p aria-hidden=true>e</p><p>f</p>")[0] == ["f"]
    assert text_of('<p>one <span class="share">share</span> two</p>')[0] == ["one two"]


def test_templates_decide_without_any_name_or_marked_part(spark):
    page = lambda i: (
        f"<body><div><p>Home</p><p>News</p></div><div><h1>Head {i}</h1><p>Text {i}</p></div><div><p>Buy now</p></div><section>All rights {i % 2}</section></body>"
    )
    data = [(i, f"https://a.example.com/{i}", page(i)) for i in range(20)] + [(50 + i, None, page(50 + i)) for i in range(9)]
    data += [(90 + i, "https://d.example.com/", "<body><div><p>Five equal rows</p></div></body>") for i in range(5)]
    frame = spark.createDataFrame(data, "page_id long, url string, html string")
    got = {r.page_id: r for r in html_extraction.extract_text(frame).collect()}
    assert all(got[i].text == f"Head {i}\nText {i}" and (got[i].n_blocks, got[i].n_template) == (6, 4) for i in range(20))
    assert got[52].text == "Home\nNews\nHead 52\nText 52\nBuy now\nAll rights 0" and got[52].n_template == 0
    assert {got[90 + i].text for i in range(5)} == {"Five equal rows"}


def test_templates_are_found_on_the_tables(spark):
    got = html_extraction.extract_text(spark.read.parquet("/root/testdata/sf0.1/pages.parquet")).selectExpr("sum(n_template) t", "sum(n_blocks) n", "count_if(n_template > 0) p").first()
    assert got.t > 2000 and got.p > 200 and got.n > got.t


def test_recurring_subtrees_of_a_host_go(spark):
    page = lambda i, own: f"<body><div><p>Welcome to the site</p></div><div><p>Text {i} {own}</p></div><div>Contact us</div></body>"
    data = [(i, f"https://a.example.com/{i}", page(i, "x" * i)) for i in range(8)] + [(100, "http://b.example.com/1", page(100, "y")), (101, None, None), (None, "https://a.example.com/n", page(8, "z"))]
    data += [(200 + i, "https://c.example.com/", f"<article><p>Same</p><p>{i}</p></article>") for i in range(9)]
    frame = spark.createDataFrame([(*d, "clash") for d in data], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in html_extraction.extract_text(frame).collect()}
    assert got[3].text == "Text 3 xxx" and got[None].text == "Text 8 z"
    assert got[100].text == "Welcome to the site\nText 100 y\nContact us" and (got[101].text, got[101].n_chars) == ("", 0)
    assert got[204].text == "Same\n4" and got[204].n_chars == 6  # what recurs in a marked main part is text
    assert len(got) == len(data) and html_extraction.extract_text(frame.limit(0)).count() == 0


def extracted(spark, data):
    return {r.page_id: r.text for r in html_extraction.extract_text(spark.createDataFrame(data, "page_id long, url string, html string")).collect()}


def test_recurring_boxes_in_marked_parts_go(spark):
    box = '<div class="box"><p>Written by our desk</p></div>'
    data = [(i, f"https://a.example.com/{i}", f"<article><h1>Head {i}</h1>{box}<p>Same</p><p>Text {i}</p></article>") for i in range(8)]
    data += [(10, "https://a.example.com/10", f"<article>{box}</article>"), (11, "https://b.example.com/1", f"<article>{box}<p>y</p></article>")]
    data += [(20 + i, f"https://c.example.com/{i}", f"<article><p>Text {i}</p>{box if i < 5 else ''}</article>") for i in range(10)]
    got = extracted(spark, data)
    assert got[3] == "Head 3\nSame\nText 3" and got[10] == "Written by our desk" and got[11] == "Written by our desk\ny"
    assert got[21] == "Text 1\nWritten by our desk"  # on half of the pages only


def test_copies_of_a_page_are_one_page(spark):
    page = lambda own: f"<body><div>Welcome</div><div><p>{own}</p></div></body>"
    data = [(i, f"https://a.example.com/{i}", page("One story" if i < 6 else f"Text {i}")) for i in range(14)]
    data += [(20 + i, f"https://b.example.com/{i}", "<body><div>Only page</div></body>") for i in range(6)]
    got = extracted(spark, data)
    assert {got[i] for i in range(6)} == {"One story"} and got[9] == "Text 9" and got[22] == "Only page"


def test_stored_blocks_are_small_and_whole():
    page = "<nav><p>Home \u00fc</p></nav><article>" + "".join(f"<div><p>Words of the block {i} &amp; more</p></div>" for i in range(60)) + "</article>"
    found, marked, (_, rests) = html_extraction.read_page(page)
    places = {s: i for i, s in enumerate(rests)}
    stored = html_extraction.packed(found, places)
    assert len(stored) < len("".join(t for t, _, _ in found)) / 2
    text, n, gone = html_extraction.without_templates(stored, marked, set(), set(), set())
    assert text == "\n".join(t for t, _, may in found if may) and (n, gone) == (61, 0)
    # a subtree in the main part and one beside it
    inner, beside = places[found[5][1][-1]], places[found[0][1][-1]]
    text, n, gone = html_extraction.without_templates(stored, marked, {beside}, set(), {inner})
    assert gone == 2 and text == "\n".join(t for i, (t, _, may) in enumerate(found) if may and i != 5)


def test_a_part_of_a_large_host_has_a_menu(spark):
    menu = "<div><p>Sports</p><p>Weather</p></div>"
    data = [(i, f"https://a.example.com/{i}", f"<body>{menu if i < 220 else ''}<p>Text {i}</p></body>") for i in range(900)]
    got = extracted(spark, data)
    assert got[7] == "Text 7" and got[800] == "Text 800"


def test_pages_of_the_tables(spark, sf):
    got = QUERIES["op9_html_extraction"](spark, sf).collect()
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in got:
        article = re.search(r"<article>(.*)</article>", pages[r.page_id], re.S)[1]
        import html

        want = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n".join(b for b in want if b) and r.n_chars == len(r.text)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, sf, name):
    same_rows(QUERIES[name](spark, sf), ORACLES[name], sf)


def test_pipeline_stages(spark, sf):
    from tests.llm.test_joins import brute_components
    from tests.llm.test_scans import plain_quality, plain_secrets

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality_rules", "jaccard_join", "secret_scan", "best_fit_packing"]
    held = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        held.append((docs := spark.createDataFrame(out.collect(), docs.schema)).collect())
    language, quality, deduped, masked = held
    assert 0 < len(quality) < len(language) and not any(plain_quality(r.text)[-1] for r in quality)
    groups = brute_components([(r.doc_id, r.text) for r in quality], corpus_pipeline.SHINGLE, corpus_pipeline.PERCENT)
    assert {r.doc_id for r in deduped} == {r.doc_id for r in quality if groups[r.doc_id][1] == r.doc_id}
    assert {r.doc_id for r in masked} == {r.doc_id for r in deduped} and all(r.n_chars == len(r.text) for r in masked)
    changed = {r.doc_id for r in masked if "[SECRET]" in r.text}
    assert changed == {r.doc_id for r in deduped if plain_secrets(r.text)}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in masked}
    ids = lambda got: sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in got)
    assert ids(corpus_pipeline.run(spark, sf).collect()) == ids(packed)


def test_pipeline_takes_an_empty_table(spark, none):
    docs = none.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        assert out.count() == 0
        docs = docs if out.columns == docs.columns else None
