"""N-gram join, toxicity, page text, language model against brute force and fixtures."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmark.llm import attention_lm, ngram_join, page_text, toxicity
from quillmark.llm.queries import ORACLE_SQL, QUERIES
from tests.oracle import DATA, duck_rows, spark_rows

DOCS = "doc_id long, text string, lang string, source string, n_chars long, k string, label string, score double, slot long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, None, "s", None, "k", None, None, 1) for i, t in rows], DOCS)


def shingles(text):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def brute(rows):
    texts = sorted({t or "" for _, t in rows})
    sets = [shingles(t) for t in texts]
    link = {a: {b for b in range(len(texts)) if a != b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])} for a in range(len(texts))}
    label = list(range(len(texts)))
    for _ in texts:
        label = [min([label[a], *(label[b] for b in link[a])]) for a in range(len(texts))]
    at = {t: i for i, t in enumerate(texts)}
    lead = {}
    for i, t in rows:
        if i is not None:
            lead[label[at[t or ""]]] = min(lead.get(label[at[t or ""]], i), i)
    copies = Counter(t or "" for _, t in rows)
    return sorted(((i, lead.get(label[at[t or ""]]), len(link[at[t or ""]]), copies[t or ""]) for i, t in rows), key=str)


def test_ngram_join_equals_sql(spark):
    assert spark_rows(QUERIES["op2_ngram_join"](spark, DATA)) == duck_rows(ORACLE_SQL["op2_ngram_join"])


@pytest.mark.parametrize("block", [8, 1024])
def test_ngram_join_of_a_large_group(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(40):
        words = list(base)
        words[(7 * i) % 150] = f"changed{i}"
        if i % 3 == 0:
            words = words[: 150 - i]
        rows.append((i, " ".join(words)))
    rows += [(100 + i, rows[0][1]) for i in range(5)] + [(200, None), (201, ""), (202, "one two"), (203, "One  two"), (None, "null id"), (None, "null id"), (204, "x " * 100_000), (204, "x " * 100_000)]
    found = sorted((tuple(r) for r in ngram_join.classes(docs(spark, rows)).collect()), key=str)
    assert found == brute(rows)


def test_one_of_each_class_stays(spark):
    rows = [(3, "a b c d e f"), (1, "a b c d e f"), (2, "A B C D E F"), (5, "other words stand here alone"), (7, None), (6, ""), (8, "x"), (8, "x")]
    kept = ngram_join.representatives(docs(spark, rows))
    assert kept.columns == docs(spark, rows).columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 5, 6, 8]
    assert ngram_join.representatives(docs(spark, [])).count() == 0


def test_banding_reaches_its_recall():
    bands, rows = ngram_join.banding()
    assert 1 - (1 - 0.8**rows) ** bands >= ngram_join.RECALL and bands * rows <= ngram_join.HASHES


def toxic_rows(n=900):
    rng = np.random.default_rng(4)
    plain = [f"{a}{b}" for a in "abcdefghij" for b in ("an", "er", "on", "is", "ou")]
    bad = ["vileword", "hatefulo", "nastyest"]
    rows, labels = [], []
    for i in range(n):
        words = list(rng.choice(plain, 60))
        toxic = i % 3 == 0
        if toxic:
            words[30] = bad[int(rng.integers(3))]
        words[10], words[20], words[40] = words[10] + ".", words[20] + "!", words[40] + "."
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_toxicity_is_learned_from_documents_and_placed_in_sentences(spark):
    rows, labels = toxic_rows()
    table = spark.createDataFrame([*labels, (None, 1), (5000, None), labels[0]], "doc_id long, toxic int")
    d = docs(spark, [*rows, (9000, None), (9001, ""), (None, "an er. " * 50_000)])
    model = toxicity.fit(d, table)
    found = {r.doc_id: r for r in toxicity.score(d.select("doc_id", "text", "score"), model).collect()}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    right = sum((found[i].score >= 0.3) == (i % 3 == 0) for i in held)
    assert right >= 0.97 * len(held)
    hit = next(i for i in held if i % 3 == 0)
    sentence = rows[hit][1].encode()[found[hit].worst_start : found[hit].worst_end].decode()
    assert any(w in sentence for w in ("vileword", "hatefulo", "nastyest")) and found[hit].n_offending == 1
    assert found[9000].score == found[9001].score == 0 and found[9000].worst_start == -1
    assert set(toxicity.clean(d, table).columns) == set(d.columns)


def test_pipeline_rejects_what_the_operator_calls_toxic(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "fit", lambda *_: None)
    monkeypatch.setattr(toxicity, "score", lambda d, _: d.withColumn("score", F.col("text").cast("double")))
    assert [r.text for r in toxicity.clean(docs(spark, [(1, "0.29"), (2, "0.3"), (3, "0.49"), (4, "0.5")]), None).collect()] == ["0.29"]


def test_toxicity_without_labels(spark):
    d = docs(spark, [(1, "a text")])
    assert toxicity.clean(d, spark.createDataFrame([], "doc_id long, toxic int")).count() == 1
    assert toxicity.clean(docs(spark, []), spark.createDataFrame([], "doc_id long, toxic int")).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style></head><body><nav><a href="/">Home</a></nav><div class="box7">Shared words of {host}</div>
<div class="txt"><h1>Title {n}</h1><p>First &amp; own {n}<p>Second   <b>bold</b>
line<br>{n}</div><div id="comments"><p>Nice!</p></div><footer>&copy; {host}</footer><script>if (a < b) {{ "</p>" }}</script></body></html>"""


def test_template_of_a_host_goes(spark):
    rows = [(n, f"http://a.org/{n}", PAGE.format(n=n, host="a.org")) for n in range(20)] + [(99, "http://b.org/1", PAGE.format(n=99, host="b.org")), (50, None, None), (None, "http://a.org/x", "plain text"), (51, "", "")]
    found = {r.page_id: r for r in page_text.extract(spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, text string, host long")).collect()}
    assert found[3].text == "Title 3\nFirst & own 3\nSecond bold line 3"
    assert found[99].text == "Shared words of b.org\nTitle 99\nFirst & own 99\nSecond bold line 99"
    assert found[50].text == found[51].text == "" and found[None].text == "plain text" and found[3].n_chars == len(found[3].text)


def test_template_of_one_design_of_a_large_host_goes(spark):
    page = "<body>{menu}<div><p>Own words {n}</div></body>"
    menu = "<div><p>Menu of one design</div>"
    rows = [(n, f"http://a.org/{n}", page.format(menu=menu if n < 25 else "", n=n)) for n in range(400)]
    rows += [(1000 + n, f"http://a.org/{n}", "<body><div><p>Copied page</div></body>") for n in range(25)]
    found = {r.page_id: r.text for r in page_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found[3] == "Own words 3" and found[300] == "Own words 300" and found[1003] == "Copied page"


def test_article_keeps_its_repeated_paragraphs(spark):
    page = '<body><header><p>Site</p></header><article><header><h1>T{n}</h1></header><p>Same in all</p><div class="share">Share</div><ul><li>a<li>b</ul><table><tr><td>1<td>2</table></article><aside>x</aside></body>'
    rows = [(n, "http://a.org/", page.format(n=n)) for n in range(10)]
    found = page_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).where("page_id = 4").first()
    assert found.text == "T4\nSame in all\na\nb\n1\n2"
    assert page_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def extracted(spark, rows):
    return page_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string"))


def test_an_article_keeps_what_its_ids_and_classes_call_like_a_part_of_a_site(spark):
    body = '<article><h1>T</h1><p>Intro.</p><section id="discussion"><p>A</p></section><section id="related-work"><p>B</p></section><h2 id="menu-costs">C</h2><p class="search-methods">D</p><div id="comments"><p>Nice!</div></article>'
    pages = [body, "<main><p>a</main><main><p>b</main>", "<main><p>a</main><article>b</article><article>c</article>", "<main><p>x<article>c</article></main>", '<div class="site-footer">x</div><p>y<div class="ad">z</div>']
    found = extracted(spark, [(i, f"http://h{i}.org/", p) for i, p in enumerate(pages)]).orderBy("page_id").collect()
    assert [r.text for r in found] == ["T\nIntro.\nA\nB\nC\nD", "a\nb", "a\nb\nc", "x\nc", "y"]


PARTS_OF_A_SITE = [
    '<section class="user-comments"><p>R</p></section>', '<div class="comment-list">R</div>', '<div id="disqus_thread">R</div>', '<div class="ad-slot">R</div>', '<div class="sponsored">R</div>', '<div class="promo">R</div>', '<div class="sidebar">R</div>',
    '<ul class="menu"><li>R</ul>', '<div class="cookie-notice">R</div>', '<div class="newsletter">R</div>', '<div class="share">R</div>', '<div class="CommentsSection">R</div>', '<div class="ad_unit_2">R</div>', '<p class="advertisement">R</p>',
    '<div class="social"><a href="/">R</a></div>', '<div class="related-box"><ul><li><a>R</a></ul></div>', '<div class="newsletter-signup"><input>R</div>', "<nav>R</nav>", "<aside>R</aside>", "<form>R</form>", "<footer>R</footer>",
]
PARTS_OF_AN_ARTICLE = ["market-share", "social", "public-notice", "film-comment", "ad-hoc", "share-price", "menu-costs", "cookie-recipe", "related", "body", "post-body", "content", "main-section", "commentary", "adagio", "navy"]


def test_no_part_of_a_site_stays_in_an_article(spark):
    pages = [f"<article><h1>T</h1><p>a</p>{part}<p>b</p></article>" for part in PARTS_OF_A_SITE]
    pages += [f"<body><h1>T</h1><p>a</p>{part}<p>b</p></body>" for part in PARTS_OF_A_SITE]
    found = extracted(spark, [(i, f"http://h{i}.org/", p) for i, p in enumerate(pages)]).collect()
    assert [pages[r.page_id] for r in found if r.text != "T\na\nb"] == []


def test_prose_stays_whatever_its_class_sounds_like(spark):
    pages = [page.format(c) for c in PARTS_OF_AN_ARTICLE for page in ("<body><div class='{}'><p>Prose of the page.</p></div></body>", "<article><div class='{}'>Prose of the page.</div></article>", "<body><section id='{}'>Prose of the page.</section></body>")]
    pages.append("<body>" + "".join(f'<div class="{c}">Prose of the page.</div>' for c in ("market-share", "social", "public-notice", "film-comment")) + "</body>")
    found = {r.page_id: r.text for r in extracted(spark, [(i, f"http://h{i}.org/", p) for i, p in enumerate(pages)]).collect()}
    assert [pages[i] for i, t in found.items() if t.split("\n")[0] != "Prose of the page."] == [] and found[len(pages) - 1].count("Prose") == 4


def test_a_main_part_keeps_its_own_text_beside_its_articles(spark):
    (r,) = extracted(spark, [(1, "http://a.org/", "<header>x</header><main><p>Lead</p><article>A</article><div class='sidebar'>S</div><article>B</article><p>Close</p></main><article>C</article>")]).collect()
    assert r.text == "Lead\nA\nB\nClose\nC"


def test_recurrence_alone_finds_the_template_of_hosts_that_mark_nothing(spark):
    rng = np.random.default_rng(9)
    said = lambda n: " ".join(f"w{rng.integers(0, 5000)}" for _ in range(n))
    rows, want, template = [], {}, 0
    for i in range(240):
        h = i % 6
        menu = "<ul class=q1>" + "".join(f"<li><a href=/{k}>Page {h} {k}</a>" for k in range(6)) + "</ul>"  # the same on all pages of a host
        advert = f'<div class="z{h}"><a href="/{i}">{said(6)}</a></div>'  # other words on each
        foot = f"<div class=q9>Host {h} says so.</div>"
        own = [said(int(rng.integers(3, 30))) for _ in range(int(rng.integers(1, 9)))]
        body = f"<div class=q3><h1>{own[0]}</h1>" + "".join(f"<p class=k2>{p} <a href=/x{i}>more {i}</a></p>" for p in own[1:]) + "</div>"
        rows.append((i, f"http://h{h}.org/{i}", f"<body>{menu}{body}{advert}{foot}</body>"))
        want[i] = [own[0], *(f"{p} more {i}" for p in own[1:])]
        template += 8
    found = {r.page_id: r.text.split("\n") for r in extracted(spark, rows).collect()}
    kept, own = sum(len(x) for x in found.values()), sum(map(len, want.values()))
    right = sum(len(set(found[i]) & set(want[i])) for i in want)
    assert right == own and kept - right <= 0.01 * template  # recall and precision of blocks


def test_equal_rows_and_mirrors_are_one_page(spark):
    page = "<body><div><p>Own words {}</div><p>more {}</body>"
    rows = [(n, f"http://a.org/{n}", page.format(n, n)) for n in range(2, 8)] + 4 * [(1, "http://a.org/1", page.format(1, 1))]
    rows += [(100 + n, f"http://b.org/{n}", f"<body><script>t({n})</script><div><p>Mirror</div></body>") for n in range(4)]
    found = extracted(spark, rows).collect()
    assert len(found) == len(rows) and all(r.text == (f"Own words {r.page_id}\nmore {r.page_id}" if r.page_id < 100 else "Mirror") for r in found)


def test_very_long_and_deep_pages(spark):
    rows = [(1, "http://a.org/", "<div>" * 100_000 + "deep"), (2, "http://a.org/", "<body>" + "<p>word " * 100_000), (3, "http://a.org/", "a <!" * 100_000), (4, "http://a.org/", "a<!-- x > y <p>z"), (5, "http://a.org/", "a<!-->b")]
    found = {r.page_id: r for r in extracted(spark, rows).collect()}
    assert found[1].text == "deep" and found[2].text == "\n".join(["word"] * 100_000) and found[3].n_chars == 400_000 and found[4].text == "a" and found[5].text == "ab"


class Plain(HTMLParser):
    """Text of the only article of a page, by the parser of Python's library."""

    def __init__(self):
        super().__init__()
        self.on, self.out, self.line = False, [], ""

    def handle_starttag(self, tag, attrs):
        self.on = self.on or tag == "article"
        self.line += " " if tag == "br" else ""
        if tag not in ("b", "br"):
            self.end()

    def handle_endtag(self, tag):
        if tag != "b":
            self.end()
        self.on = self.on and tag != "article"

    def handle_data(self, data):
        self.line += data if self.on else ""

    def end(self):
        if self.line.split():
            self.out.append(" ".join(self.line.split()))
        self.line = ""


def test_page_text_of_the_given_table(spark):
    rows = spark.read.parquet(f"{DATA}/pages.parquet").collect()
    found = {r.page_id: r.text for r in QUERIES["op5_page_text"](spark, DATA).collect()}
    assert len(found) == len(rows)
    for r in rows:
        plain = Plain()
        plain.feed(r.html)
        assert found[r.page_id] == "\n".join(plain.out)


def test_template_equals_a_count_by_hand(spark):
    rng = np.random.default_rng(8)
    parts = [f"<div><p>Part {k}</p></div>" for k in range(30)]
    rows, held = [], {}
    for i in range(120):
        some = [k for k in range(30) if rng.random() < (k + 1) / 60]
        held[i] = (i % 3, some)
        rows.append((i, f"http://h{i % 3}.org/{i}", "<body>" + "".join(parts[k] for k in some) + f"<p>own {i}</body>"))
    on = Counter((h, k) for h, some in held.values() for k in some)
    for r in extracted(spark, rows).collect():
        h, some = held[r.page_id]
        assert r.text == "\n".join([*(f"Part {k}" for k in some if not (on[h, k] >= 4 and on[h, k] >= 0.1 * 40)), f"own {r.page_id}"])


def test_base_score_is_the_unigram_model(spark):
    rows = [(i, f"Common word{i % 7} and word{i % 3}\tIS\nhere Ünï") for i in range(60)] + [(100, None), (101, ""), (102, "x" * 50_000 + " " + "y z " * 5000), (103, "never seen words")]
    found = {r.doc_id: r for r in attention_lm.score(docs(spark, [*rows, (None, "no id")])).collect()}
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    counts, ends = Counter(), 0
    held = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 10 == 0
    for i, t in [*rows, (None, "no id")]:
        if not held(i):
            counts.update(lower(t).split())
            ends += 1
    n, v = sum(counts.values()) + ends, len(counts) + 1
    for i, t in rows:
        words = lower(t).split()
        want = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words) + math.log10((ends + 0.1) / (n + 0.1 * (v + 1)))
        r = found[i]
        assert abs(r.base_score - want) < 1e-6 * max(1, abs(want)) and r.n_tokens == len(words) + 1 and r.train_tokens == n and r.held_out == held(i)
        assert r.n_known == sum(counts[w] > 0 for w in words) + 1 and r.score < 0
    assert None in found


def small_model(border=6):
    rng = np.random.default_rng(0)
    pairs = attention_lm.Pairs()
    pairs.follow += rng.integers(0, 3, len(pairs.follow))
    pairs.leaf += rng.integers(0, 3, len(pairs.leaf))
    model = attention_lm.Attention(pairs.tables(), rng.integers(0, 256, attention_lm.SUBWORDS + 1), border)
    model.w["u"] *= 20
    return model


def test_language_model_is_a_distribution_and_causal():
    model, rng = small_model(), np.random.default_rng(0)
    x = np.repeat(rng.integers(0, attention_lm.SUBWORDS, (1, attention_lm.WINDOW)), attention_lm.SUBWORDS, axis=0).astype(np.int32)
    y = np.full((attention_lm.SUBWORDS, attention_lm.STEP), -1, np.int32)
    y[:, 3] = np.arange(attention_lm.SUBWORDS)
    score, begins = (s.reshape(-1, attention_lm.STEP) for s in model.scores(x, y))
    chance = np.exp(score[:, 3])
    assert abs(chance.sum() - 1) < 1e-3 and abs(chance[: 6 * attention_lm.BRANCH**2].sum() - np.exp(begins[0, 3])) < 1e-3
    later = x[:1].copy()
    later[0, attention_lm.CONTEXT + 4 :] = 7
    assert np.allclose(model.scores(later, y[:1])[0], score[0])


def naive_score(model, seen, target):
    """One subword's probability, position by position and choice by choice."""
    w, out = model.w, []
    e = [w["embed"][i] + w["place"][p] for p, i in enumerate(seen)]
    q = e[-1] @ w["q"]
    weight = [math.exp(q @ (v @ w["k"]) / math.sqrt(attention_lm.SIZE)) for v in e]
    z = e[-1] + sum(a * (v @ w["v"]) for a, v in zip(weight, e, strict=True)) / sum(weight) @ w["o"]
    b = attention_lm.BRANCH
    one = np.exp(z @ w["u"][:, :b] + model.bias[0][seen[-1]])
    two = np.exp(z @ w["u"][:, b:] + model.bias[1][seen[-1] * b + target // b**2])
    out = one[target // b**2] / one.sum() * two[target // b % b] / two.sum()
    return math.log(out) + model.bias[2][model.turned[seen[-1]] * b**2 + target // b][target % b], math.log(one[: model.border].sum() / one.sum())


def test_windows_score_like_one_subword_at_a_time():
    model, rng = small_model(), np.random.default_rng(2)
    starts, others = rng.integers(1, 6 * 256, 100), rng.integers(6 * 256, 4096, 100)
    k = np.array([1, 3, 2, 1, 40, 2, 1, 5])
    words, n_words = np.array([0, 1, 2, 2, 4, 5, 6, 7, 3]), np.array([6, 0, 3])
    texts = [np.append(starts[i], others[7 * i : 7 * i + k[i] - 1]) for i in range(8)]
    flat = np.concatenate([texts[i] for i in words]).astype(np.int32)
    known, left = np.log(rng.uniform(0, 0.4, 8)), np.log(rng.uniform(0, 1, 8))
    found, n = attention_lm.mixed(model, words, n_words, k[words], flat, known, left)
    at = 0
    for d, many in enumerate(n_words):
        line = [attention_lm.START] * (attention_lm.CONTEXT + 1)
        total = 0.0
        each = []
        own = [*np.concatenate([texts[i] for i in words[at : at + many]] or [np.zeros(0, int)]).tolist(), attention_lm.END]
        for place, target in enumerate(own):  # a window begins at each STEP-th subword, with CONTEXT before it
            begin = place // attention_lm.STEP * attention_lm.STEP
            each.append(naive_score(model, (line + own)[begin : attention_lm.CONTEXT + 1 + place], target))
        place = 0
        for i in words[at : at + many]:
            rest = sum(x for x, _ in each[place + 1 : place + k[i]]) + each[place + k[i]][1]
            total += each[place][0] - each[place][1] + np.logaddexp(known[i], left[i] + rest)
            place += k[i]
        total += each[place][0] - each[place][1]
        assert abs(found[d] - total) < 1e-3 * max(1, abs(total)) and n[d] == len(own)
        at += many


def test_words_are_spelled_alike_wherever_they_stand():
    words = [b"the", "señor".encode(), "a\u00a0b".encode(), "\u00a0".encode(), b"x1y2", b"can't", "的".encode()]
    ids, n = attention_lm.spelled(words, attention_lm.TOKENIZER)
    enc = attention_lm.encoder(attention_lm.TOKENIZER)
    at = np.concatenate(([0], np.cumsum(n)))
    assert [enc.decode_bytes(ids[a:b].tolist()) for a, b in zip(at[:-1], at[1:], strict=True)] == [b" " + w for w in words]
    alone = [attention_lm.spelled([w], attention_lm.TOKENIZER)[0].tolist() for w in words if b"\xc2\xa0" not in w]
    some = [w for w in words if b"\xc2\xa0" not in w]
    assert attention_lm.spelled(some, attention_lm.TOKENIZER)[0].tolist() == [i for x in alone for i in x]


def test_gradients_are_those_of_the_score():
    rng = np.random.default_rng(1)
    model = attention_lm.Attention(attention_lm.Pairs().tables(), np.zeros(attention_lm.SUBWORDS + 1, np.int64), 6)
    model.w["u"] *= 20
    x = rng.integers(0, 50, (30, attention_lm.WINDOW)).astype(np.int32)
    y = rng.integers(-1, 50, (30, attention_lm.STEP)).astype(np.int32)
    grads = model.gradients(x, y)
    for k, i in (("q", (1, 2)), ("k", (3, 1)), ("v", (2, 2)), ("o", (0, 5)), ("u", (2, 20)), ("embed", (int(x[0, 20]), 3)), ("place", (12, 3))):
        was = model.w[k][i]
        losses = []
        for d in (2e-2, -2e-2):
            model.w[k][i] = was + d
            losses.append(-model.scores(x, y)[0].sum() / (y >= 0).sum())
        model.w[k][i] = was
        assert abs(grads[k][i] - (losses[0] - losses[1]) / 4e-2) < 0.05 * abs(grads[k][i]) + 2e-5, k


@pytest.mark.parametrize("lengths", [[0], [1, 0, 24, 25, 100], []])
def test_windows_hold_each_target_once(lengths):
    n = np.array(lengths, dtype=np.int64)
    flat = np.arange(n.sum(), dtype=np.int32) % 1000
    _, y, doc = attention_lm.windows(flat, n)
    at = 0
    for d, k in enumerate(lengths):
        found = y[doc == d].ravel()
        assert list(found[found >= 0]) == [*flat[at : at + k], attention_lm.END]
        at += k


def test_rounds_of_training_cover_every_window_of_the_training_documents():
    rng = np.random.default_rng(3)
    n = np.array([0, 5, 24, 1000, 70, 300_000, 3, 47])
    flat = rng.integers(0, 256, n.sum())
    _, want, _ = attention_lm.windows(flat, n)
    rounds = [attention_lm.stretches(flat, n, turn)[1] for turn in range(attention_lm.ROUNDS)]
    assert sorted(map(bytes, np.concatenate(rounds))) == sorted(map(bytes, want))
    assert max(map(len, rounds)) - min(map(len, rounds)) < len(n)


def test_language_model_beats_the_base_score(spark):
    found = QUERIES["op4_attention_lm"](spark, DATA.replace("0.001", "0.01")).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert found[0] > found[1]


def test_language_model_beats_its_subword_frequencies(spark):
    rows = [(i, " ".join("the cat sat on the mat and the dog ran to the red barn".split()[(i + j) % 14] for j in range(60))) for i in range(200)]
    found = attention_lm.score(docs(spark, rows)).where("held_out").agg(F.sum("score") / F.sum("n_subwords")).first()[0]
    assert found > -0.35
    assert attention_lm.score(docs(spark, [])).count() == 0
