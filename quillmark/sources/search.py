"""Recorded answers of web searches, as the rows that quillmark.operators.similarity.web_matches reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions import text as T

# How the providers answer, the provider's own address, and how much of an answer counts.
GOOGLE = "items array<struct<link:string,title:string,snippet:string>>"
BRAVE = "web struct<results:array<struct<url:string,title:string,description:string>>>"
RESULT_LINK = r"(?s)<a\s+rel=\"nofollow\"\s+href=\"([^\"]+)\"\s+class='result-link'>(.*?)</a>"
OWN = "duckduckgo.com"
MOST, TITLE = 5, 160


def decoded(url: Column) -> Column:
    """Percent signs resolved, where all of them can be; a plus sign stays."""
    return F.coalesce(F.try_url_decode(F.replace(url, F.lit("+"), F.lit("%2B"))), url)


def item(url: Column, title: Column, description: Column) -> Column:
    of = lambda c: F.coalesce(c, F.lit(""))
    return F.struct(of(url).alias("url"), of(title).alias("title"), of(description).alias("description"))


def linked(html: Column, own: str = OWN) -> Column:
    """Array of (url, title, description) of a page's first MOST result links with a title, each address once, none of the provider's own."""
    both = F.arrays_zip(T.found(html, RESULT_LINK, 1).alias("u"), T.found(html, RESULT_LINK, 2).alias("t"))
    links = F.transform(both, lambda a: item(decoded(a["u"]), T.strip(F.regexp_replace(a["t"], "<[^>]+>", "")), F.lit("")))
    kept = F.filter(links, lambda a: (a["title"] != "") & ~a["url"].contains(own))

    def first(all: Column) -> Column:
        urls = F.transform(all, lambda a: a["url"])
        once = F.slice(F.array_distinct(urls), 1, MOST)
        return F.transform(once, lambda u: F.get(all, F.array_position(urls, u).cast("int") - 1))

    return F.transform(F.transform(F.array(kept), first)[0], lambda a: item(a["url"], F.substring(a["title"], 1, TITLE), a["description"]))


def results(answers: DataFrame) -> DataFrame:
    """(query, provider, rank, url, title, description) from answers (query, provider: google, brave or duckduckgo, status, body).

    Answers of status 400 and more, null bodies, broken JSON and unknown providers give no rows; a
    null status is a good one. One projection: an answer's links never leave its row.
    """
    provider, body = F.col("provider"), F.col("body")
    google = F.transform(F.from_json(body, GOOGLE)["items"], lambda i: item(i["link"], i["title"], i["snippet"]))
    brave = F.transform(F.from_json(body, BRAVE)["web"]["results"], lambda i: item(i["url"], i["title"], i["description"]))
    items = F.when(provider == "google", F.slice(google, 1, MOST)).when(provider == "brave", F.slice(brave, 1, MOST)).when(provider == "duckduckgo", linked(body))
    good = answers.where(F.coalesce(F.col("status") < 400, F.lit(True)))
    rows = good.select("query", "provider", F.posexplode(items).alias("pos", "i"))
    return rows.select("query", "provider", (F.col("pos") + 1).alias("rank"), "i.url", "i.title", "i.description")
