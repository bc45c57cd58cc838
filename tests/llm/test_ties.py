"""Firms tied by short forms of their names."""

from assaykit.llm import name_links as nl


def test_firm_with_two_ties_keeps_both(spark):
    rows = [(1, "Varwil Trading", "Norland"), (2, "Wilvar Trading", "Norland"), (10, "Varno Wilbek Trading", "Norland"), (20, "Other Person Trading", "Norland")]
    df = spark.createDataFrame([(i, n, c, None, None) for i, n, c in rows], "record_id bigint, name string, country string, website string, linkedin_url string")
    got = {r["record_id"]: (r["firm_id"], r["links"]) for r in nl.firms(nl.firm_keys(df)).collect()}
    assert got == {1: (1, 2), 2: (1, 2), 10: (1, 2), 20: (20, 0)}
