import pytest
from pyspark.sql import functions as F

from assaykit.functions import text as tx
from assaykit.functions import urls as u


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "v string").select(make(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    "a,b,same",
    [
        ("http://www.example.test/process/", "https://example.test/process", True),
        ("https://example.test/p?utm_source=x&gclid=1", "example.test/p", True),
        ("https://example.test/p?srsltid=1&FBCLID=2", "https://example.test/p", True),
        ("https://example.test/p?document=specification", "https://example.test/p", False),
        ("https://example.test/a%2fb", "https://example.test/a%2Fb", True),
        ("https://example.test//a///b/", "https://example.test/a/b", True),
        ("https://u:p@example.test:8443/a#x", "example.test/a", True),
        ("https://other.test/a", "https://example.test/a", False),
    ],
)
def test_provenance_key(spark, a, b, same):
    ka, kb = one(spark, a, u.provenance_key), one(spark, b, u.provenance_key)
    assert (ka == kb) is same


@pytest.mark.parametrize("v", [None, "", "  ", "ftp://x.test/a", "mailto:a@b.test"])
def test_no_address(spark, v):
    got = one(spark, v, u.normalise_url)
    assert got == "" or v == "mailto:a@b.test"


def test_parts_agree_with_expressions(spark):
    values = ["HTTP://WWW.Acme.Test:80/A//b/?x=1&utm_x=2&&y=#f", "acme.test", "", None, "https://a.test/p;v=1?q", "https://a.test./"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    for r in u.with_url_parts(df, "v").select("*", u.url_host(F.col("v")).alias("h"), u.url_path(F.col("v")).alias("p"), u.url_query_fields(F.col("v")).alias("f")).collect():
        if r["url_norm"]:
            assert (r["url_host"], r["url_path"], r["url_fields"]) == (r["h"], r["p"], r["f"])


def test_path_intent_and_hosts(spark):
    for path, n in (("/products", 3), ("/en/market-applications/", 2), ("/solutions/steel", 1), ("/history", 0), ("", 0)):
        assert one(spark, f"https://a.test{path}", u.path_intent) == n
    assert one(spark, "de.linkedin.com", lambda c: u.host_in(c, u.LOW_AUTHORITY_HOSTS)) is True
    assert one(spark, "notlinkedin.com", lambda c: u.host_in(c, u.LOW_AUTHORITY_HOSTS)) is False
    assert one(spark, "a.b.c", u.host_suffixes) == ["a.b.c", "b.c", "c"]


def test_names(spark):
    assert "Muscat Chemical" in one(spark, "Muscat Chemical Industries LLC / Muscat Chemical", tx.identity_aliases)
    assert "PSR" in one(spark, "Parkinson-Spencer Refractories Ltd（PSR）", tx.identity_aliases)
    assert one(spark, None, tx.identity_aliases) == []
    assert one(spark, "Müller & Söhne GmbH Straße", tx.company_terms) == ["muller", "sohne", "strasse"]
    seed = one(spark, 'Acme "quoted"\nsite:other.test ' + "x" * 300, tx.identity_seed_name)
    assert "\n" not in seed and '"' not in seed and "site:" not in seed and len(seed) <= 120


def test_substantive_and_redaction(spark):
    long = "This page tells about a plant in which an error was seen only once, in the middle of a long text. " * 2
    assert one(spark, long, tx.substantive) is True
    assert one(spark, "Error: " + long, tx.substantive) is False
    assert one(spark, long + " captcha", tx.substantive) is False
    assert one(spark, None, tx.substantive) is False
    assert one(spark, "api_key: abc, secret=x;y", tx.redact_secrets) == "api_key=[redacted], secret=[redacted];y"


def test_small_text_functions(spark):
    assert one(spark, "## \n# Title one\nx", lambda c: tx.extract_title(c, F.lit("u"))) == "Title one"
    assert one(spark, "x", lambda c: tx.extract_title(c, F.lit("u"))) == "u"
    assert one(spark, "  A/B: ümlaut  ", tx.safe_slug) == "A-B-ümlaut"
    assert one(spark, "///", tx.safe_slug) == "record"
    assert one(spark, "a<b>&\"'", tx.html_escape) == "a&lt;b&gt;&amp;&quot;&#x27;"
    assert one(spark, "[**Bold** text](http://x) Here!", tx.normalised_quote) == "boldtexthere"
    assert one(spark, " High", lambda c: tx.mapped_level(c, {"high": "高"}, "低")) == "高"
    assert one(spark, None, lambda c: tx.mapped_level(c, {"high": "高"}, "低")) == "低"
    assert one(spark, "T", lambda c: tx.markdown_link(c, F.lit("https://x.test"))) == "[T](https://x.test)"
    assert one(spark, "T", lambda c: tx.markdown_link(c, F.lit("ftp://x.test"))) == "T"


@pytest.mark.parametrize(
    "name,want",
    [("Muscat Chemical Industries LLC / Muscat Chemical", "Muscat Chemical"), ("Perfect Solution & Consultant Co., Ltd. / Perfect Group", "Perfect Solution & Consultant Co., Ltd."), ("Acme（AC）", "Acme"), ("甲公司 / Acme Works", "Acme Works"), (None, ""), ("A / 乙", "A")],
)
def test_search_name(spark, name, want):
    assert one(spark, name, tx.search_name) == want
