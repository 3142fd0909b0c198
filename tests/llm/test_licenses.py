import random

import pytest

from weblens.llm import licenses


def prose(r, n):
    return " ".join("".join(r.choices("adehilnorst", k=r.choice([2, 4, 7]))) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="module")
def corpus(spark):
    """Prose with license lines at its end, in its middle, or before more prose on the same line."""
    r = random.Random(2)
    notices = {
        "apache": "Licensed under the Apache License, Version 2.0.",
        "mit": "Released under the MIT License.",
        "gpl": "This work is licensed under the GNU General Public License, version 3.",
        "cc-by-nc": "Licensed under CC BY-NC 4.0.",
        "": "",
    }
    rows, want = [], {}
    for i in range(200):
        family = r.choice(list(notices))
        body = [prose(r, r.choice([8, 40])) for _ in range(3)]
        body.insert(r.randrange(4), notices[family])
        rows.append((i, r.choice(["\n", " "]).join(b for b in body if b), "x", 1.0))
        want[i] = family
    extra = [
        (1000, None, "x", 1.0), (1001, "", "x", 1.0), (None, "Released under the MIT License.", "x", 1.0), (5, rows[5][1], "x", 1.0),
        (1002, "word " * 200_000 + "\nReleased under the MIT License.", "x", 1.0), (1003, "x" * 300_000, "x", 1.0),
        (1004, "Released under the MIT License.\nLicensed under the Apache License, Version 2.0.", "x", 1.0),
        (1005, "This font is licensed under the SIL Open Font License, version 1.1.", "x", 1.0),
        (1006, "He lost his driving licence after the accident.\nThe licence fee rose again.", "x", 1.0),
        (1007, "/* This program is free software: you can redistribute it and/or modify\n it under the terms of the GNU General Public License as published by\n the Free Software Foundation, either version 3 of the License, or\n (at your option) any later version. */", "x", 1.0),
        (1008, "SPDX-License-Identifier: Apache-2.0", "x", 1.0),
    ]
    return spark.createDataFrame(rows + extra, "doc_id long, text string, family string, chance double"), want, len(rows) + len(extra)


def test_families(corpus):
    docs, want, n = corpus
    got = licenses.license_scan(docs).collect()
    assert len(got) == n
    by_id = {x.doc_id: x for x in got}
    wrong = {i: (f, by_id[i].families) for i, f in want.items() if by_id[i].families != f}
    assert not wrong, wrong
    assert [x.families for x in got if x.doc_id is None] == ["mit"] and len([x for x in got if x.doc_id == 5]) == 2
    assert by_id[1001].families == "" and by_id[1001].chance is None
    assert by_id[1002].families == "mit" and by_id[1003].families == "" and by_id[1004].families == "apache,mit"
    assert by_id[1005].families == "" and by_id[1005].n_unknown == 1
    assert by_id[1006].families == "" and by_id[1006].n_licenses == 0
    assert by_id[1007].families == "gpl" and by_id[1008].families == "apache"


def test_no_rows(corpus):
    docs, _, _ = corpus
    assert licenses.license_scan(docs.limit(0)).collect() == []


def test_short_notices_are_judged(spark, corpus):
    docs, _, _ = corpus
    model = licenses.fit(docs)
    line = "CC BY-NC-SA 3.0, for noncommercial use only"
    rows = spark.createDataFrame([(1, f"Some words.\n{line}\nMore words."), (2, "Some words.\nMore words."), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.license_scan(rows, model).collect()}
    assert got[1].n_judged == 3 and got[1].n_licenses + got[1].n_unknown == 1
    assert got[2].n_judged == 2 and got[2].n_licenses == got[2].n_unknown == got[3].n_judged == 0


def test_what_is_proven_none_is_called_none(spark, corpus):
    docs, _, _ = corpus
    model = licenses.fit(docs)
    texts = [(t,) for ts in licenses.TEMPLATES.values() for t in ts] + [(t,) for t in [*licenses.OTHERS, *licenses.MENTIONS]] + [(" ".join(t.split()[:n]),) for ts in licenses.TEMPLATES.values() for t in ts for n in (1, 2, 4, 8)]
    rows = spark.createDataFrame(texts, "paragraph string").union(docs.select(licenses.F.explode(licenses.paragraphs(licenses.F.col("text")))).limit(300))
    told = licenses.judged(model.open(rows.withColumn("w", licenses.words(licenses.F.col("paragraph")))), model)
    counts = {(r.open, r.none): r["count"] for r in told.groupBy("open", (licenses.F.col("family") == "none").alias("none")).count().collect()}
    assert counts[False, True] > 0 and counts[True, False] > 0 and (False, False) not in counts
