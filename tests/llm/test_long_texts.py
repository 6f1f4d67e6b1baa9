"""One text of a kind that a recursive or quadratic expression does not survive: no crash, and linear time."""

import time

import pytest

from weftline.llm import decontaminate, license_scan, line_dedup, secret_scan

SCHEMA = "doc_id long, text string"
SECONDS = 60  # a shared machine; each took minutes or ended the process before


def _timed(df):
    began = time.time()
    rows = df.collect()
    assert time.time() - began < SECONDS
    return rows


def _one(spark, text):
    return spark.createDataFrame([(1, text)], SCHEMA).coalesce(1)


def test_op5_many_sentences(spark):
    opening = license_scan.SENTENCES[20].capitalize() + ". "
    r = _timed(license_scan.licenses(_one(spark, opening + "All rights reserved. " * 50_000)))[0]
    assert (r.n_known, r.licenses) == (50_001, "")
    closing = ". ".join(license_scan.SENTENCES[i] for i in (21, 22)) + "."
    r = _timed(license_scan.licenses(_one(spark, opening + "All rights reserved. " * 20_000 + closing)))[0]
    assert r.licenses == "BSD-2-Clause"


def test_op5_long_runs(spark):
    for text in ("." * 200_000 + "x", ("\n" + " " * 5) * 50_000 + "x", "# \n" * 50_000, "." * 100_000 + " x" + "!" * 100_000 + "\n"):
        assert _timed(license_scan.licenses(_one(spark, text)))[0].n_known == 0


def test_op5_rules_in_order(spark):
    order = lambda *ids: ". ".join(license_scan.SENTENCES[i] for i in ids) + "."
    rows = spark.createDataFrame([(1, order(20, 21, 22)), (2, order(21, 20, 22)), (3, order(20, 20, 51, 21, 51, 22)), (4, order(22, 21, 20)), (5, order(20, 22, 21, 22, 23)), (6, order(20, 21))], SCHEMA)
    assert {r.doc_id: r.licenses for r in license_scan.licenses(rows).collect()} == {1: "BSD-2-Clause", 2: "", 3: "BSD-2-Clause", 4: "", 5: "BSD-2-Clause,BSD-3-Clause", 6: ""}


def test_op6_many_matches(spark):
    text = " ".join(f"{k:040x}" for k in range(40_000))
    ratios = [0.0] * (len(secret_scan.ALPHABET) * (len(secret_scan.ALPHABET) + 1))
    r = _timed(secret_scan.secrets(_one(spark, text), ratios))[0]
    assert [(x.s, x.e) for x in r.base] == [(41 * k, 41 * k + 40) for k in range(40_000)] and r.found == r.base


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 5, 17])
def test_op6_places(spark, n):
    text = "é " + "".join(f"<{'ab' * (16 + k)}>😀" for k in range(n)) + "end"
    r = secret_scan.secrets(_one(spark, text), [0.0] * (len(secret_scan.ALPHABET) * (len(secret_scan.ALPHABET) + 1)), 9.0).collect()[0]
    assert [text[x.s : x.e] for x in r.base] == ["ab" * (16 + k) for k in range(n)]


def test_op9_many_lines(spark):
    text = "\n".join(f"line number {k} of a text with a great many long lines" for k in range(60_000))
    rows = _timed(line_dedup.dedup_lines(_one(spark, text)))
    assert (rows[0].n_lines, rows[0].n_dropped, rows[0].text) == (60_000, 0, text)


def test_op9_many_shared_lines(spark):
    text = "\n".join(f"line number {k} of a text with a great many long lines" for k in range(20_000))
    rows = spark.createDataFrame([(k, text + f"\nthe last line of text {k} is found nowhere else") for k in range(5)], SCHEMA).coalesce(1)
    got = {r.doc_id: r for r in _timed(line_dedup.dedup_lines(rows))}
    assert [(got[k].n_lines, got[k].n_dropped) for k in range(5)] == [(20_001, 20_000)] * 4 + [(20_001, 0)]
    assert got[2].text == "the last line of text 2 is found nowhere else"


def test_op10_long_lists_of_numbers(spark):
    text = ",".join(str(k) for k in range(50_000)) + " metres and more words here"
    items = spark.createDataFrame([(1, "how far is it from here to the end of 12 roads in all")], "item_id long, text string")
    assert _timed(decontaminate.leaks(_one(spark, text), items)) == []
