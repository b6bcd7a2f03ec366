"""Answers of search providers, read link by link."""

from __future__ import annotations

import json

from quillmark.operators import similarity
from quillmark.sources import search


def link(url, title, rel='rel="nofollow" ', kind="class='result-link'"):
    return f'<a {rel}href="{url}" {kind}>{title}</a>\n'


def test_answers_of_each_provider(spark):
    page = link("https://duckduckgo.com/y.js?ad", "An advert") + link("http%3A%2F%2Fa.org%2Fx+y%20z", "<b>First</b>\n hit ") + link("http://a.org/x+y z", "Again") + link("http://b.org", " <i></i> ")
    page += link("http://c.org", "No class", kind='class="other"') + link("http://d.org/%zz", "D" * 200) + link("http://e.org", "No rel", rel="") + "".join(link(f"http://f.org/{i}", f"F{i}") for i in range(9))
    google = json.dumps({"items": [{"link": f"http://g.org/{i}", "title": f"G{i}", **({"snippet": "s"} if i else {})} for i in range(7)]})
    brave = json.dumps({"web": {"results": [{"url": "http://br.org", "title": None, "description": "words"}]}, "more": [1]})
    rows = [
        ("q1", "duckduckgo", 200, page), ("q2", "google", None, google), ("q3", "brave", 200, brave), ("q4", "google", 429, google), ("q5", "google", 200, "{broken"), ("q6", "brave", 200, "{}"),
        ("q7", "duckduckgo", 200, None), ("q8", "other", 200, page), ("q9", "duckduckgo", 200, ""), ("q10", None, 200, page), ("q11", "brave", 200, '{"web": null}'),
    ]
    found = {}
    for r in sorted(search.results(spark.createDataFrame(rows, "query string, provider string, status int, body string")).collect()):
        found.setdefault(r.query, []).append((r.rank, r.url, r.title, r.description))
    assert found["q1"] == [(1, "http://a.org/x+y z", "First\n hit", ""), (2, "http://d.org/%zz", "D" * 160, ""), (3, "http://f.org/0", "F0", ""), (4, "http://f.org/1", "F1", ""), (5, "http://f.org/2", "F2", "")]
    assert found["q2"] == [(i + 1, f"http://g.org/{i}", f"G{i}", "s" if i else "") for i in range(5)]
    assert found["q3"] == [(1, "http://br.org", "", "words")] and set(found) == {"q1", "q2", "q3"}


def test_matches_are_made_from_answers(spark):
    text = "orders and prices move together through every year"
    answers = spark.createDataFrame([(text, "google", 429, "{}"), (text, "duckduckgo", 200, link("http://x.org", text.title()))], "query string, provider string, status int, body string")
    segments = spark.createDataFrame([(1, 0, text)], "paper_id long, pos int, segment string")
    row = similarity.web_matches(segments, search.results(answers)).first()
    assert (row.url, row.provider, row.similarity) == ("http://x.org", "duckduckgo", 100)
