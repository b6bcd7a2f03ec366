"""Licence scans against a plain word search, the SQL, and texts whose licences are known."""

from __future__ import annotations

import re
import time

import duckdb
import pytest

from quillmark.llm import license_scan
from quillmark.llm.license_rules import EXACT, HINT, NAME, compiled, rules
from quillmark.llm.queries import ORACLE_SQL, QUERIES
from tests.oracle import DATA, duck_rows, ordered, plain, spark_rows

SCHEMA = "doc_id long, text string, labels string, score int, detections string"

KNOWN = {
    "Licensed under the Apache License, Version 2.0.": "apache,apache-2.0",
    "Released under the MIT License.": "mit",
    "This work is licensed under the GNU General Public License, version 3.": "gpl,gpl-3.0",
    "Licensed under CC BY-NC 4.0.": "cc-by,cc-by-nc,cc-by-nc-4.0",
    "SPDX-License-Identifier: LGPL-2.1-or-later": "lgpl-2.1",
    "SPDX-License-Identifier: ISC": "isc",
    "version 2 of the GNU Lesser General Public License": "lgpl",
    "You can use it under version 2.1 of the GNU Lesser General Public License": "lgpl-2.1",
    "Redistribution and use in source and binary forms, with or without\n * modification, are permitted": "bsd",
    "see https://creativecommons.org/licenses/by-sa/4.0/": "cc-by-sa-4.0",
    "Creative Commons Attribution-ShareAlike 3.0": "cc-by-sa-3.0",
    "Creative Commons Attribution Share-Alike": "cc-by-sa",
    "This is free and unencumbered software released into the public domain.": "unlicense",
    "All rights reserved.": "all-rights-reserved",
    "Mozilla Public License v. 2.0 or GPLv3": "gpl-3.0,mpl-2.0",
    "either version 3 of the License, or (at your option) any later version": "gpl-3.0-or-later",
    "The summit licensed a new ship; success by chance, submit license": "",
    "Er kam mit. Lizenz nein. A driving licence is no matter": "",
    "": "", "écc byé mit license": "", "MIT\u0000LICENSE": "mit", "mit1 license": "",
}


def scanned(spark, texts):
    df = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in enumerate(texts)], SCHEMA)
    return {r.doc_id: r for r in license_scan.scan(df).collect()}


def base(text):
    """The base columns, word by word."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [(i, label) for phrase, label in license_scan.PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def test_known_notices(spark):
    got = scanned(spark, KNOWN)
    for i, (text, labels) in enumerate(KNOWN.items()):
        assert got[i].labels == labels, text
        assert (got[i].score > 0) == bool(labels)


def test_base_columns_of_any_text(spark):
    notice = "MIT License CC BY apache license, gnu general public license. "
    texts = [*KNOWN, None, " ", "cc by", "cc  by cc by", "CC BY\nCC-BY", "x" * 100_000 + " apache license", notice * 20_000, "apache", "license", "Apache\tLicense Apache\tLicense", "İcc by K mit license"]
    got = scanned(spark, texts)
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(t)
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))


def test_query_equals_sql_and_words(spark):
    found = QUERIES["op11_license_scan"](spark, DATA)
    assert spark_rows(found) == duck_rows(ORACLE_SQL["op11_license_scan"])
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    for r in found.collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(texts[r.doc_id])


def test_made_texts_equal_sql(spark):
    import random

    rng = random.Random(3)
    bits = [*KNOWN, "the", "gnu", "License", "version 2", "creative commons", "licensed under the terms of the", "or", "apache software license 1.1", "spdx license identifier mit", "boost software license"]
    rows = [(i % 90, " ".join(rng.choice(bits) for _ in range(rng.randrange(12)))) for i in range(120)]
    df = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in [*rows, (None, "mit license"), (5, None)]], SCHEMA)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [*rows, (None, "mit license"), (5, None)])
    done = con.execute(ORACLE_SQL["op11_license_scan"])
    names = [d[0] for d in done.description]
    want = ordered([tuple(plain(x) for _, x in sorted(zip(names, r, strict=True))) for r in done.fetchall()])
    assert spark_rows(license_scan.scan(df).drop("detections"))[1] == want


def test_detections_say_where_and_none_lies_in_another(spark):
    (r,) = scanned(spark, ["We ship it. Licensed under the Apache License, Version 2.0, all rights reserved."]).values()
    assert [(d.start, d.end, d.label) for d in r.detections] == [(3, 8, "apache"), (6, 11, "apache-2.0"), (11, 14, "all-rights-reserved")]


def test_a_text_of_many_notices_takes_linear_time(spark):
    took = []
    for n in (4000, 16_000):
        began = time.time()
        r = scanned(spark, ["Licensed under CC BY-NC 4.0. MIT License. " * n])[0]
        took.append(time.time() - began)
        assert r.n_base == 2 * n and r.n_detections == 3 * n
    assert took[1] < 10 * took[0] + 5


def test_empty_table(spark):
    assert scanned(spark, []) == {}


def test_rules_are_sound():
    found = rules()
    assert len(found) > 300 and {r.rank for r in found} == {EXACT, NAME, HINT} and [r.number for r in found] == list(range(len(found)))
    assert set(license_scan.PHRASES.values()) <= {r.label for r in found}
    for r in found:
        pattern = r.regex.replace("[cs]", "c")
        for need in r.keyword.replace(" ", "+").split("+"):
            assert need in pattern, r  # what the gate asks for is in the pattern itself
        assert not re.search(r.regex, "")


@pytest.mark.parametrize(("words", "text", "hit"), [("a b~ c", "a c", True), ("a *2 c", "a x y c", True), ("a *2 c", "a x y z c", False), ("share ?alike", "sharealike", True), ("share ?alike", "share alike", True), ("licen[cs]e", "licenses", False), ("v?3 0~", "v3", True)])
def test_patterns_of_words(words, text, hit):
    assert bool(re.search(compiled(words), "".join(f" {w}#{i} " for i, w in enumerate(text.split())))) == hit
