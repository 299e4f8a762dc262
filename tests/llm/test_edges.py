"""Every training-data operator with nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns; held-out
quality of the fitted models; the pipeline as a whole."""

import random
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphwright.llm import cotrain, jaccard, langid, licences, media, mixing, pages, pieces, secrets, settle, textvec

SF = "/root/testdata/sf0.001"
LONG = "long words of a very long text without an end " * 8000
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
ROWS = [
    (1, "plain words of a text", "en", "s", 21), (1, "plain words of a text", "en", "s", 21), (1, "another text of the same id", "en", "s", 5), (None, "no id here", None, None, None),
    (2, None, "en", "s", 0), (3, "", "de", None, -1), (4, " \n\t ", None, "s", 4), (5, LONG, "en", "s", len(LONG)), (6, "\x00 ퟿  \U0001f600", "en", "s", 9),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, COLUMNS)


def clashing(docs, *names):
    return docs.withColumns({n: F.lit("clash") for n in names})


def test_secrets(docs, spark):
    got = secrets.find_secrets(clashing(docs, "spans", "text_a"))
    assert got.count() == len(ROWS) and set(docs.columns) < set(got.columns)
    assert secrets.find_secrets(docs.limit(0)).count() == 0
    many = spark.createDataFrame([(1, "token=abcdef1 " * 3000)], "doc_id long, text string")
    assert len(secrets.find_secrets(many).first()[secrets.SPANS]) == 3000
    assert secrets.redact_secrets(many).first().text == "[SECRET] " * 3000


def test_language(docs, spark):
    rows = [(i, f"{'the cat and the dog with that' if i % 2 else 'der hund und die katze nicht mit'} {i}", "en" if i % 2 else "de") for i in range(40)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    got = langid.identify(clashing(docs, "lang_pred", "hash"), model).collect()
    assert len(got) == len(ROWS) and {r.lang_pred for r in got if not r.text or not re.search(r"[^\W\d_]", r.text)} == {"und"}
    assert all(0 <= r.lang_score <= 1 for r in got) and got[0].hash == "clash"
    assert langid.identify(docs.limit(0), model).count() == 0
    assert langid.fit(docs.limit(0)) is None and {r.lang_pred for r in langid.identify(docs, None).collect()} == {"und"}


def test_language_sample_of_any_size(spark, monkeypatch):
    """Copies don't fill the sample, a text that is too long is learned by a passage, and the same rows give the same model however they are dealt."""
    monkeypatch.setattr(langid, "SAMPLE_DOCS", 20)
    monkeypatch.setattr(langid, "SAMPLE_CHARS", 400)
    rows = [(i, "one text of many copies", "en") for i in range(3000)] + [(9000 + i, f"other words {i} of english", "en") for i in range(50)]
    rows += [(8000, "ein sehr langer text mit vielen worten " * 100, "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = []
    monkeypatch.setattr(langid, "train", lambda texts, langs: seen.append(sorted(zip(langs, texts, strict=True))))
    langid.fit(df)
    langid.fit(df.repartition(7))
    assert seen[0] == seen[1] and sum(lang == "en" for lang, _ in seen[0]) == 10 and sum(t == rows[0][1] for _, t in seen[0]) <= 1
    assert [len(t) for lang, t in seen[0] if lang == "de"] == [400]


def test_quality(docs, spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (1, 0), (None, 1), (77, 1)], "doc_id long, quality int")
    got = cotrain.quality_scores(clashing(docs, "label", "score", "truth"), labels).collect()
    assert len(got) == len(ROWS) and all(0 <= x <= 1 for r in got for x in (r.text_score, r.meta_score, r.score))
    assert {r.score for r in cotrain.quality_scores(docs, labels.limit(0)).collect()} == {0.5}
    assert cotrain.quality_scores(docs.limit(0), labels).count() == 0


def test_quality_views_teach_each_other(spark):
    """Few labels, and metadata that tell what the words of most texts don't: the combination is better than the text alone."""
    rnd = random.Random(4)
    rows, truth = [], {}
    for i in range(1200):
        good = rnd.random() < 0.5
        truth[i] = good
        told = rnd.random() < 0.6
        words = rnd.choices("alpha beta gamma delta".split() if good else "omega sigma lambda kappa".split(), k=6) if told else []
        rows.append((i, " ".join(words + rnd.choices("some other words that say nothing".split(), k=10)), "en", ("siteA" if good else "siteB") if rnd.random() < 0.9 else "siteC", 60))
    labels = spark.createDataFrame([(i, int(truth[i])) for i in range(120)], "doc_id long, quality int")
    got = {r.doc_id: r for r in cotrain.quality_scores(spark.createDataFrame(rows, COLUMNS), labels).collect()}
    rest = range(120, 1200)
    right = lambda name: np.mean([(getattr(got[i], name) >= 0.5) == truth[i] for i in rest])
    loss = -np.mean([np.log(max(1e-9, got[i].score if truth[i] else 1 - got[i].score)) for i in rest])
    assert right("score") >= max(right("text_score"), right("meta_score")) - 0.01 and right("score") > 0.93 and loss < 0.3


def test_mixing(docs, spark):
    labels = spark.createDataFrame([(1, "a"), (5, "b"), (None, "a"), (4, None)], "doc_id long, d string")
    got = mixing.mix_rates(clashing(docs, "domain", "rate", "words"), labels, F.col("d")).collect()
    assert len(got) == len(ROWS) and all(r.rate >= 0 for r in got)
    assert {r.rate for r in got if r.n_tokens == 0} == {1.0}
    assert mixing.mix_rates(docs.limit(0), labels, F.col("d")).count() == 0
    rates = spark.createDataFrame([(1, 2.0), (5, 0.0), (2, 1.0), (3, 1.0), (4, 0.5), (6, 1.0)], "doc_id long, rate double")
    taken = [r.doc_id for r in mixing.take_at_rates(clashing(docs, "__x"), rates).collect()]
    assert taken.count(1) == 6 and 5 not in taken and taken.count(None) == 1 and taken.count(2) == 1


def test_mixing_posteriors(spark):
    """On held-out rows the log loss is far below that of the shares alone, though markers come in correlated groups."""
    rnd = random.Random(6)
    groups = {"x": "red green blue cyan pink".split(), "y": "one two three four five".split()}
    rows = []
    for i in range(900):
        d = "x" if rnd.random() < 0.8 else "y"
        rows.append((i, " ".join((groups[d] if rnd.random() < 0.9 else groups["y" if d == "x" else "x"]) + rnd.choices("some filling words".split(), k=8)), d))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] % 3], "doc_id long, d string")
    got = {r.doc_id: r.posterior for r in mixing.mix_rates(docs, labels, F.col("d")).collect()}
    held = [r for r in rows if r[0] % 3 == 0]
    loss = -np.mean([np.log(got[i][0 if d == "x" else 1]) for i, _, d in held])
    share = np.mean([d == "x" for *_, d in held])
    assert loss < 0.8 * -(share * np.log(share) + (1 - share) * np.log(1 - share))


def test_media(docs):
    got = docs.select("doc_id", "text").transform(media.store_texts).collect()
    assert len(got) == len(ROWS) and all(r.media[:4] == b"RIFF" for r in got)
    assert media.store_texts(docs.limit(0)).count() == 0
    found = media.clips(media.store_texts(clashing(docs.where("doc_id < 4"), "key", "error")), "doc_id").collect()
    assert {r.doc_id for r in found} == {1, 2, 3} and all(r.error is None for r in found)


def test_licence_scan(docs):
    got = licences.scan_licences(clashing(docs, "licences", "unmatched", "sentence")).collect()
    assert len(got) == len(ROWS) and all(r.licences == [] and r.unmatched == 0 for r in got)
    assert licences.scan_licences(docs.limit(0)).count() == 0


def test_page_rows(spark):
    rows = [(1, "http://a/1", "<p>x</p>"), (1, "http://a/1", "<p>x</p>"), (2, None, "<p>y"), (3, "not a url", ""), (4, "http://a/4", None), (5, "http://a/5", "<div><p>" + LONG + "</div>"), (6, "http://a/6", "<a \"" * 5000)]
    df = clashing(spark.createDataFrame(rows, "page_id long, url string, html string"), "main_text", "host", "token", "template")
    got = pages.extract_main_text(df).collect()
    assert len(got) == len(rows) and {r.page_id: r.main_text for r in got}[5] == LONG.strip() and got[0].host == "clash"
    assert pages.extract_main_text(df.limit(0)).count() == 0


def test_pages_with_unknown_names(spark):
    """Boilerplate under names that say nothing goes, by its vectors; what differs from page to page stays."""
    same = "<div class='zq'><p>Read all about our great offers</p></div>"
    body = "<html><body><div class='k1'><p>Welcome to this place</p></div><div class='k2'><h1>Head {0}</h1><p>Body {0} of the page.</p>%s<p>End {0}.</p></div><div class='k3'><p>Call us now</p></div></body></html>" % same
    rows = [(i, f"http://u.example/{i}", body.format(f"n{i}")) for i in range(8)]
    got = {r.page_id: r.main_text for r in pages.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Head n{i} Body n{i} of the page. End n{i}." for i in range(8)}


def test_pages_article_by_template(spark):
    """The template decides in and about article elements too: its text in an article goes, a passage that some articles share
    and articles with copies stay whole, and a teaser in an article element isn't the text."""
    long = "many more words of the text " * 4
    shared = lambda i: "<p>A passage of some.</p>" if i % 4 else ""
    inside = "<article><h1>Head {0}</h1>{1}<p>Body {0} %s</p><div class='zq'><p>Read all about our great offers</p></div><p>First seen here</p></article>" % long
    teaser = "<div class='k2'><h1>Head {0}</h1><p>Body {0} %s</p></div><article class='a/b'><p>Our offers of today</p></article>" % long
    copies = "<div class='k1'><p>Seen {0} times</p></div><article><h1>One</h1><p>Body %s</p></article>" % long
    rows = [(i, f"http://i.example/{i}", inside.format(f"n{i}", shared(i))) for i in range(8)]
    rows += [(10 + i, f"http://t.example/{i}", teaser.format(f"n{i}")) for i in range(6)]
    rows += [(20 + i, f"http://c.example/{i}", copies.format(f"n{i}")) for i in range(6)]
    got = {r.page_id: r.main_text for r in pages.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {i: got[i] for i in range(8)} == {i: f"Head n{i} {'A passage of some. ' if i % 4 else ''}Body n{i} {long.strip()}" for i in range(8)}
    assert {i: got[10 + i] for i in range(6)} == {i: f"Head n{i} Body n{i} {long.strip()}" for i in range(6)}
    assert {got[20 + i] for i in range(6)} == {f"One Body {long.strip()}"}


def test_pieces_rows(docs):
    model = pieces.PieceModel([("▁", 3, -4.0), ("a", 4, -3.0), ("ab", 6, -2.0), ("b", 5, -3.0)], "bpe", 10, 0)
    got = pieces.encode(clashing(docs.where("doc_id != 5 OR doc_id IS NULL"), "ids", "exact", "key", "unit"), model).collect()
    assert len(got) == len(ROWS) - 1 and all(r.exact for r in got if r.text is not None) and got[0].unit == "clash"


def test_held_out_language_accuracy(spark):
    """On the smallest tables: learned from documents that aren't held out, measured on those that are."""
    got = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").join(langid.op6_language(spark, SF), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r.held_out and r.lang and r.lang_pred != "und"]
    assert len(held) > 20 and np.mean([r.lang == r.lang_pred for r in held]) > 0.95


def test_pipeline(spark):
    """All stages on the smallest tables: each keeps what it should, judged on its own input."""
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    sizes = {}
    for n, (name, stage) in enumerate(c.STAGES):
        out = stage(spark, docs, SF).cache()
        rows = {r.doc_id: r for r in out.collect()}
        before = {r.doc_id: r for r in docs.collect()}
        sizes[name] = (len(before), out.count())
        if n < len(c.STAGES) - 1:
            assert out.columns == columns and set(rows) <= set(before)
        if name == "language_id":
            assert all(not re.search(r"[^\W\d_]", before[i].text or "") for i in set(before) - set(rows))
        elif name == "near_duplicates":
            texts = [r.text for r in rows.values()]
            assert len(set(texts)) == len(texts) < len(before)
        elif name == "secrets":
            assert all(not re.search("AKIA[A-Z0-9]{16,}", r.text or "") for r in rows.values())
            assert {i for i, r in rows.items() if r.text != before[i].text} == {i for i, r in rows.items() if "[SECRET]" in (r.text or "")}
        elif name == "pieces":
            assert all(r.exact for r in rows.values()) and all(len(r.ids) > 0 for i, r in rows.items() if before[i].text)
        docs = out
    assert sizes["language_id"][1] > 0.9 * sizes["language_id"][0] and sizes["secrets"][0] == sizes["secrets"][1]
    assert c.run(spark, SF).count() == sizes["pieces"][1]


WRAPPERS = [
    "page with-sidebar", "no-comments", "has-banner", "content social-studies", "form", "widget", "sidebar-left-layout", "menu-open", "search-results-page", "comments-disabled",
    "sponsored", "promo", "header-fixed", "notice", "ad-free", "nav-collapsed", "footer-visible", "share", "cookie-accepted", "modal-closed",
]


def _told(pages_: dict[int, str], spark) -> dict[int, str]:
    rows = [(i, f"http://h{i % 3}.example/{i}", page) for i, page in pages_.items()]
    return {r.page_id: r.main_text for r in pages.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_pages_by_article_template_and_wrapper(spark):
    """Pages put together from a known article, a template and a wrapper of a telling name: the article comes back, whole."""
    made, want = {}, {}
    for i, name in enumerate(WRAPPERS * 3):
        words = [f"w{i}x{j}" for j in range(40)]
        article = f"<h1>Head {i}</h1><p>{' '.join(words[:20])}</p><section class='market-share'><p>{' '.join(words[20:])}</p></section><div class='share-buttons'>Tell all</div><div id=comments>Nice {i}</div>"
        holder = ("article", "main", "div")[i // len(WRAPPERS)]
        inner = f"<{holder}>{article}</{holder}>" if holder != "div" else article.split("<div class='share-buttons'>")[0]
        made[i] = f"<html><body><nav>Home News</nav><header class=top>Site</header><div class='{name}'>{inner}</div><div class='cookie-banner'>We use cookies</div><div class='site-nav'>More news</div><footer>All rights</footer></body></html>"
        want[i] = f"Head {i} {' '.join(words)}"
    got = _told(made, spark)
    assert {i: got[i] for i in want} == want


def test_pages_in_a_form_and_asides_with_articles(spark):
    body = "<form id=aspnet><main><h1>Head {0}</h1><p>Body {0} of the text.</p><form class=search><p>Find</p></form></main></form><aside><article><p>Other {0}</p></article></aside>"
    assert _told({i: body.format(i) for i in range(6)}, spark) == {i: f"Head {i} Body {i} of the text." for i in range(6)}


def test_workers_of_near_duplicates_hold_little_memory(monkeypatch):
    """1.2 million different shingles in a task take less than 96 MB at most and 16 MB afterwards, and what the task has freed goes back to the system."""
    monkeypatch.setattr(textvec, "_powers", {})
    freed = []
    monkeypatch.setattr(settle, "free_unused", lambda: freed.append(True))
    batch = pa.record_batch({"doc_id": list(range(300)), "text": [" ".join(f"w{i}x{k}" for k in range(4000)) for i in range(300)]})
    tracemalloc.start()
    rows = sum(out.num_rows for out in settle.lean(jaccard._set_rows)(iter([batch])))
    held, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert rows == 300 and freed and peak < 96 << 20 and held < 16 << 20


def test_language_training_memory(monkeypatch):
    """The weights are changed a few rows at a time, which takes less of the driver's memory and gives the same model."""
    texts, langs = ["the cat sat on the mat", "le chat est sur le tapis", "die Katze sitzt auf der Matte", "el gato se sienta"] * 3, ["en", "fr", "de", "es"] * 3
    peaks, models = [], []
    for rows in (langid.BUCKETS, langid.UPDATED):
        monkeypatch.setattr(langid, "UPDATED", rows)
        tracemalloc.start()
        models.append(langid.train(texts, langs))
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    weights = models[0].weights.astype(float).nbytes
    assert peaks[1] < peaks[0] - 2 * weights
    assert all(np.array_equal(getattr(models[0], name), getattr(models[1], name)) for name in ("weights", "lexicon", "lexical", "moves"))
