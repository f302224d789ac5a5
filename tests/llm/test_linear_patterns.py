"""Every pattern of the scanning operators on long texts that open matches again and again: 1 MB in seconds, or time in proportion to size."""

import time

import pytest

from millrace.llm import license_scan, pii, secret_scan, url_filter

MB = 1_000_000
fill = lambda unit: unit * (MB // len(unit) + 1)
SECRETS = ["eyJaaaaaaaa", "eyJaaaaaaaa.", "eyJ", "token ", "token=", "secret'  ", "AKIA", "AKIA ", "0123456789abcde ", "a", "a1", "." * 70 + "a", "a://", "a://b!", "a:b@", "Aa1" * 10 + " ", "Aa1+/_-", "-"]
LINKS = ["<a ", "<a", "<a href", "<a href=", "<a href = ", "<a href='" + " " * 5000, "<a href=a", "<a href=//", "<link\t", " href=//x", "<a " + " " * 5000]
PEOPLE = ["a", "a@", "@", "a.", "1.", "1", "1 ", "1-", "+1", "+1 ", "+", " at ", "[at]", "a [at] b ", "a at b dot ", ":", "a:", "1234.", "00 1", "(279) 555-", "1[.]"]


def test_secrets(spark):
    rows = spark.createDataFrame([(i, fill(u), "en", "own") for i, u in enumerate(SECRETS)], "doc_id long, text string, lang string, source string").repartition(8)
    rows.limit(1).count()
    for order, kind in enumerate(secret_scan.KINDS):
        start = time.time()
        rows.select("doc_id", secret_scan._spans(kind, order).alias("s")).selectExpr("sum(size(s))").collect()
        assert time.time() - start < 40, kind.name


def test_links(spark):
    rows = spark.createDataFrame([(f"h{i}.example.com", fill(u)) for i, u in enumerate(LINKS)], "host string, html string").repartition(8)
    start = time.time()
    url_filter.host_edges(rows).count()
    assert time.time() - start < 40


def test_links_as_before(spark):
    html = """<A class="x" HREF='https://One.example/a'>t</a><a name=q>//no</a><img src="//img.example"><iframe src=//two.example?x></iframe><form action = "  http://three.example:80/">
    <a title="a > b" href="//cut.example"><link rel=x href="/local"><area href="mailto:a@b"><a\nhref="ftp://four.example"></a>"""
    got = {r.target for r in url_filter.host_edges(spark.createDataFrame([("h", html)], "host string, html string")).collect()}
    assert got == {"one.example", "two.example", "three.example:80", "four.example"}


@pytest.mark.parametrize("unit", PEOPLE)
def test_personal_data(unit):
    took = []
    for size in (MB // 10, MB // 5 * 2):
        text, start = fill(unit)[:size], time.time()
        pii.candidates(text)
        took.append(time.time() - start)
    assert took[1] < 8 * took[0] + 1


@pytest.mark.parametrize("unit", ["SPDX-License-Identifier: ", "SPDX-License-Identifier: (", "SPDX-License-Identifier: MIT OR ", "under the mit ", "under the mit license ", "(", "cc by nc "])
def test_licenses(spark, unit):
    rows = spark.createDataFrame([(1, fill(unit))], "doc_id long, text string")
    start = time.time()
    license_scan.digest(license_scan.scan_licenses(rows)).collect()
    assert time.time() - start < 60
