"""Queries over pages on tables of a few rows, where the SQL comparison cannot tell right from short."""

import re
from pathlib import Path
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from assaykit.functions import urls as u
from assaykit.operators.catalogue import QUERIES


@pytest.fixture
def sources(spark, tmp_path):
    def write(rows):
        spark.createDataFrame(rows, "source_row bigint, bundle_id bigint, url string, source_type string").write.parquet(str(tmp_path / "sources.parquet"))
        return str(tmp_path)

    return write


@pytest.mark.parametrize("name", ["interleaved_sources", "reserved_sources"])
def test_pages_told_apart_by_query(spark, sources, name):
    d = sources([
        (1, 1, "https://a.test/listing?firm=70", "官网"),
        (2, 1, "https://a.test/listing?firm=73", "官网"),
        (3, 1, "http://www.a.test/listing/?utm_source=x&firm=70#top", "官网"),
    ])
    assert sorted(r["source_row"] for r in QUERIES[name](spark, d).collect()) == [1, 2]


def brute_key(url):
    """Host, path and query of an address, step by step; None where there is no address."""
    url = (url or "").strip()
    url = url if "://" in url else f"https://{url}"
    parsed = urlparse(urlparse(url)._replace(fragment="").geturl().rstrip("/"))
    if parsed.scheme not in ("http", "https") or not parsed.netloc:
        return None
    path = re.sub(r"/+", "/", parsed.path or "/").rstrip("/") or "/"
    path = re.sub("%[0-9a-fA-F]{2}", lambda m: m[0].upper(), path)
    names = ((f, f.split("=")[0].lower()) for f in parsed.query.split("&") if f)
    return parsed.hostname.rstrip(".").removeprefix("www."), path, "&".join(f for f, n in names if n not in u.TRACKING_FIELDS and not n.startswith(u.TRACKING_PREFIX))


ADDRESSES = [
    "https://a.test/x/y", "https://a.test//x///y/", "https://a.test/x%2fy%c3%a4", "https://a.test/x;v=1", "https://a.test/x;v=1/y;w=2", "http://WWW.a.test:8080/x?b=1&utm_source=q&a=2#f", "a.test", "", None, "ftp://a.test/x", "https://a.test/100%zz%2f", "https://a.test/?firm=70",
]


def test_provenance_keys_have_the_path(spark, sources):
    d = sources([(i, 1, a, None) for i, a in enumerate(ADDRESSES)])
    got = {r["source_row"]: (r["host"], r["path"], r["query"]) for r in QUERIES["provenance_keys"](spark, d).collect()}
    assert got == {i: k for i, a in enumerate(ADDRESSES) if (k := brute_key(a))}
    assert got[0][1] == got[1][1] == "/x/y" and got[2][1] == "/x%2Fy%C3%A4" and got[3][1] == "/x"


DATA = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not DATA.exists(), reason="test tables are not there")
def test_provenance_keys_of_whole_table(spark):
    rows = spark.read.parquet(str(DATA / "sources.parquet")).select("source_row", "url", u.provenance_key(F.col("url")).alias("k")).collect()
    got = {r["source_row"]: (r["host"], r["path"], r["query"]) for r in QUERIES["provenance_keys"](spark, str(DATA)).collect()}
    assert got == {r["source_row"]: tuple(r["k"]) for r in rows if r["k"]}
    assert got == {r["source_row"]: k for r in rows if (k := brute_key(r["url"]))}


def test_long_pages_are_read_to_their_end(spark, tmp_path):
    filler = "plain words " * 600
    text = f"Company: Acme\n\n## S1\nURL: https://a.test/one\nTitle: One\n{filler}products and furnace distributor datasheet uncommonword\n\n## S2\nURL: https://a.test/two\nTitle: Two\n{filler}\n"
    spark.createDataFrame([(1, "Acme", text)], "bundle_id bigint, company string, text string").write.parquet(str(tmp_path / "evidence_bundles.parquet"))
    got = {r["section"]: (r["relevance"], r["categories"]) for r in QUERIES["page_relevance"](spark, str(tmp_path)).collect()}
    assert got["S1"] == (got["S2"][0] + 68, "channel,process,product,technical") and got["S2"][1] == ""
    assert {r["section"]: r["rank"] for r in QUERIES["ranked_pages"](spark, str(tmp_path)).collect()} == {"S1": 1, "S2": 2}
    assert [r["relevance"] for r in QUERIES["diverse_pages"](spark, str(tmp_path)).collect()][0] == got["S1"][0]
