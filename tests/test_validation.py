from pyspark.sql import functions as F

from assaykit.operators import retrieval as rt
from assaykit.operators.validation import Rule, reanchored_sources, violations

RULES = [Rule("$.name", "text"), Rule("$.level", "one_of", ("high", "low")), Rule("$.score", "integer", low=0, high=10), Rule("$.flag", "boolean"), Rule("$.list", "list", required=False)]


def test_strict_types(spark):
    good = '{"name": "A", "level": "high", "score": 9, "flag": true, "list": []}'
    cases = {
        good: [],
        good.replace("9", "true"): ["$.score: integer"],
        good.replace("9", "9.5"): ["$.score: integer"],
        good.replace("9", "11"): ["$.score: integer"],
        good.replace("true", "1"): ["$.flag: boolean"],
        good.replace('"A"', '" "'): ["$.name: text"],
        good.replace("high", "middle"): ["$.level: one_of"],
        good.replace("[]", '"x"'): ["$.list: list"],
        '{"name": null, "level": "low", "score": 0, "flag": false}': ["$.name: text"],
        "not json": ["no JSON"],
        "": ["no JSON"],
    }
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "j string").withColumn("v", violations(F.col("j"), RULES))
    got = {r["j"]: r["v"] for r in df.collect()}
    assert got == {**cases, None: ["no JSON"]}


def test_reanchored(spark, rows):
    pack = spark.createDataFrame([(1, "S1", "a", "ua"), (1, "S2", "b", "ub"), (1, "S3", "b", "uc")], "bundle_id int, id string, key string, url string")
    cited = spark.createDataFrame([(1, 0, "S1", "zzz"), (1, 1, "X9", "b"), (1, 2, "X8", "b"), (1, 3, "X7", "foreign"), (1, 4, "X6", None)], "bundle_id int, pos int, id string, key string")
    assert rows(reanchored_sources(cited, pack)) == [(1, 0, "S1", "S1", "ua"), (1, 1, "X9", "S2", "ub")]


def test_attempts_and_budgets(spark, rows):
    df = spark.createDataFrame([("k", 2, "b", True), ("k", 1, "a", False), ("k", 3, "c", True), ("m", 1, "x", False)], "k string, priority int, text string, ok boolean")
    assert rows(rt.first_success(df, ["k"], "priority", F.col("ok")), "k", "text") == [("k", "b")]
    assert rows(rt.within_budget(df, "k", [F.asc("priority")], 2), "k", "text") == [("k", "a"), ("k", "b"), ("m", "x")]
    assert rows(rt.only_for_missing(df, df.filter("ok"), "k"), "k") == [("m",)]
    u = spark.createDataFrame([(1, "a", 0, False), (1, "b", 1, True), (1, "a", 2, True), (1, "c", 3, False)], "g int, key string, pos int, r boolean")
    assert rows(rt.reserved_union(u, "g", "key", F.col("r"), "pos", 3), "place", "key") == [(1, "b"), (2, "a"), (3, "c")]


def test_recovery(spark, rows):
    p = spark.createDataFrame([(1, ["x", "y"]), (2, ["x"]), (3, [])], "k int, gaps array<string>")
    r = spark.createDataFrame([(1, ["y"]), (2, ["x", "z"]), (4, ["q"])], "k int, gaps array<string>")
    assert rows(rt.accepted_recovery(p, r, "k"), "k", "source") == [(1, "recovered"), (2, "primary"), (3, "primary"), (4, "recovered")]
