import itertools
import random

import pytest
from pyspark.sql import functions as F

from assaykit.operators import evaluation as ev
from assaykit.operators import evidence as evi
from assaykit.operators import incremental as inc
from assaykit.operators import parsers as ps
from assaykit.operators import ranking as rk
from assaykit.operators import review as rv
from assaykit.operators.roles import select_role
from assaykit.plans.provider import ReplayProvider, rounds
from assaykit.plans.runtime import at_most, connected_components, heavy_safe_join
from assaykit.sources import records as rec
from assaykit.sources import sinks


def test_components_match_union_find(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 130)] + [(7, 7), (99, 99)]
    parent = {v: v for e in edges for v in e}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {v: root(v) for v in parent}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


@pytest.mark.parametrize("heavy", [2, 100])
@pytest.mark.parametrize("how", ["inner", "left"])
def test_heavy_safe_join(spark, rows, heavy, how):
    left = spark.createDataFrame([("a", i) for i in range(6)] + [("b", 9), ("c", 8), (None, 7)], "k string, v int")
    mapping = spark.createDataFrame([("a", 6, "x"), ("b", 1, "y")], "k string, n bigint, w string")
    assert rows(heavy_safe_join(left, mapping, ["k"], "n", heavy, how), "k", "v", "w") == rows(left.join(mapping, ["k"], how), "k", "v", "w")
    assert at_most(left, 9) and not at_most(left, 8)


PACK = "# Evidence pack\nCompany: X\n\n## S1\nURL: https://a.test/p\nTitle: T\n\nBody one\n## Not a section\n\n## S2\nURL: u2\nTitle: \n\nlast"


def test_pack_sections(spark, rows):
    df = spark.createDataFrame([(1, PACK), (2, None), (3, ""), (4, "no section")], "bundle_id bigint, text string")
    assert rows(ps.pack_sections(df), "bundle_id", "section", "url", "title") == [(1, "S1", "https://a.test/p", "T"), (1, "S2", "u2", "")]


def test_search_parsers(spark):
    text = "### 1. One\n- **URL**: https://a.test/x.\n" + "words " * 20 + "\n### 2. Two\nwww.b.test/y and https://a.test/x\n" + "words " * 20 + "\n### 3. none\n"
    df = spark.createDataFrame([(1, text)], "id int, t string")
    assert df.select(ps.search_urls(F.col("t")).alias("u")).first()["u"] == ["https://a.test/x", "https://www.b.test/y"]
    got = ps.search_sections(df, "id", "t").orderBy("pos").collect()
    assert [r["url"] for r in got] == ["https://a.test/x", "https://a.test/x"]
    q = spark.createDataFrame([(1, "## Query 1: a\nfirst\n## Query 2: b\nsecond\n")], "id int, t string")
    assert {r["slot"]: r["body"].split("\n")[1] for r in ps.query_sections(q, "id", "t", ["identity", "offering", "process"]).collect()} == {"identity": "first", "offering": "second"}


def test_markdown_table(spark, tmp_path, rows):
    (tmp_path / "t.md").write_text("| n | name | url |\n|---|---|---|\n| 1 | **A \\| B** | [x](http://x) |\n| 2 | C | |\ntext\n", encoding="utf-8")
    assert rows(rec.markdown_records(spark, str(tmp_path / "t.md"), ["n", "name", "url"])) == [(1, "A | B", "[x](http://x)"), (2, "C", "")]


def test_html(spark):
    html = "<html><head><title>Acme</title><style>x{}</style></head><body><script>bad()</script><noscript>no</noscript><h1>Head</h1><p>Some &amp; text</p><a href='/p'>Products</a><a href='https://o.test/'>Other</a></body></html>"
    df = spark.createDataFrame([(1, html, "https://www.acme.test/"), (2, None, None)], "id int, h string, b string")
    got = {r["id"]: r["p"] for r in df.select("id", ps.html_extract("h", "b").alias("p")).collect()}
    assert got[1]["title"] == "Acme" and "bad" not in got[1]["text"] and "no" not in got[1]["text"].split() and got[1]["links"][0]["heading"] == "Head"
    assert got[2]["text"] == ""
    assert [r["url"] for r in ps.site_links(df, "id", "h", "b").collect()] == ["https://www.acme.test/p"]


@pytest.mark.parametrize(
    "raw,strategy",
    [('{"a": 1}', "strict"), ('{"a": 1,}', "commas"), ('{"a": "say "hi" now", "b": 1}', "quotes"), ("{'a': 'x',}", "literal"), ('note\n```json\n{"a": 1}\n```\nend', "strict")],
)
def test_json_repair(raw, strategy):
    json_, how, error = ps.parse_object(raw)
    assert json_ and how == strategy and error is None


@pytest.mark.parametrize("raw", [None, "", "words {", '{"a":1} {"b":2}', "[1]", '```json\n{}\n```\n```json\n{}\n```', 'so: {"a": 1}'])
def test_json_refused(raw):
    assert ps.parse_object(raw)[0] is None


def brute_mmr(pages, limit, least):
    left, out, covered = list(pages), [], set()
    while left and len(out) < limit:
        def s(p):
            return p[1] + 8 * len(set(p[2]) - covered) - 20 * max((len(set(p[3]) & set(q[3])) / max(1, len(set(p[3]) | set(q[3]))) for q in out), default=0)

        best = max(left, key=s)
        if best[1] < least:
            break
        out.append(best)
        left.remove(best)
        covered |= set(best[2])
    return [p[0] for p in out]


def test_mmr_matches_brute_force(spark):
    rng = random.Random(7)
    data = {g: [(i, rng.choice([5, 25, 30, 60]), rng.sample(["a", "b", "c"], rng.randrange(3)), rng.sample("abcdefgh", rng.randrange(1, 6))) for i in range(6)] for g in range(12)}
    df = spark.createDataFrame([(g, *p) for g, ps_ in data.items() for p in ps_], "g int, pos int, relevance int, categories array<string>, tokens array<string>")
    got = {}
    for r in rk.mmr_select(df, "g").orderBy("g", "turn").collect():
        got.setdefault(r["g"], []).append(r["pos"])
    assert got == {g: w for g, p in data.items() if (w := brute_mmr(p, 3, 20))}


def test_interleave(spark):
    df = spark.createDataFrame([(1, s, p, k) for s, p, k in [(0, 0, "a"), (0, 1, "b"), (1, 0, "a"), (1, 1, "c"), (2, 0, "d")]], "g int, slot int, pos int, k string")
    got = rk.interleave(df, "g", "slot", "pos", ["k"], 10).orderBy("turn").collect()
    assert [r["k"] for r in got] == ["a", "d", "b", "c"]


def test_confusion_and_ranks(spark, rows):
    df = spark.createDataFrame([(True, 80), (True, 10), (True, None), (False, 60), (False, 5), (False, None)], "p boolean, s int")
    r = ev.confusion(df, F.col("p"), F.col("s"), F.lit(55)).first()
    assert (r["tp"], r["fp"], r["tn"], r["fn"], r["abstain_pos"], r["abstain_neg"]) == (1, 1, 1, 1, 1, 1)
    assert abs(r["recall"] - 1 / 3) < 1e-9 and r["precision"] == 0.5 and abs(r["coverage"] - 4 / 6) < 1e-9
    none = ev.confusion(df.filter("false"), F.col("p"), F.col("s"), F.lit(55)).first()
    assert none["n"] == 0 and none["precision"] == 0.0
    ties = spark.createDataFrame([("g", v) for v in (1, 2, 2, 3)], "g string, v int")
    assert rows(ev.average_ranks(ties, "v", ["g"]), "v", "avg_rank") == [(1, 1.0), (2, 2.5), (2, 2.5), (3, 4.0)]
    flat = spark.createDataFrame([("g", 1.0, 2.0), ("g", 1.0, 3.0)], "g string, m double, s double")
    q = ev.score_quality(flat, "m", "s", ["g"]).first()
    assert q["pearson"] is None and q["mae"] == 1.5


@pytest.mark.parametrize("f", [0.0, 0.5, 0.95, 1.0])
def test_index_quantile(spark, f):
    values = [random.Random(1).randrange(40) for _ in range(100)]
    df = spark.createDataFrame([("g", v) for v in values] + [("g", None)], "g string, v int")
    assert ev.index_quantile(df, "v", ["g"], f, "q").first()["q"] == sorted(values)[min(99, int(100 * f))]


def test_quotes_and_facts(spark, rows):
    sections = spark.createDataFrame([(1, "S1", "The plant **melts** [steel scrap](http://x) in two furnaces."), (1, "S2", "Nothing here.")], "bundle_id int, section string, body string")
    facts = spark.createDataFrame(
        [(1, 0, "Melts steel scrap", [("S1", "melts steel scrap in two")]), (1, 1, "Invented fact here", [("S1", "sells gold in bars daily")]), (1, 2, "short", [("S1", "melts steel scrap in two")])],
        "bundle_id int, pos int, statement string, evidence array<struct<source_id:string,quote:string>>",
    )
    assert rows(evi.verified_facts(facts, sections)) == [(1, 1, "Melts steel scrap", ["S1"])]


def test_ids(spark):
    df = spark.createDataFrame([(1, ["E1", "E2", "E1"], ["S1"])], "id int, ids array<string>, known array<string>")
    m = F.create_map(F.lit("E1"), F.lit("S1"))
    assert df.select(evi.remapped_ids(F.col("ids"), m, F.col("known")).alias("x")).first()["x"] == ["S1"]
    assert df.select(evi.remapped_ids(F.array(F.lit("Z")), m, F.col("known")).alias("x")).first()["x"] == ["S1"]
    assert evi.dangling(df, "ids", "known").first()["missing"] == ["E1", "E2"]


CASES = [
    ((True, 70, "x"), None, None, "lead"),
    ((True, 40, "x"), (True, 65, "y"), ("other", True), "other"),
    ((True, 0, "x"), (True, 60, "y"), ("other", False), "lead"),
    ((True, 60, "x"), (True, 50, "y"), ("other", True), "lead"),
    ((True, 60, "x"), (True, 60, "x"), ("other", True), "lead"),
    ((False, 60, "x"), (True, 80, "y"), ("other", True), "lead"),
    ((True, 60, "x"), (False, 80, "y"), ("other", True), "lead"),
    ((True, 60, "x"), (True, 80, "y"), None, "lead"),
    ((True, None, "x"), (True, 80, "y"), ("other", True), "lead"),
]


def test_role_graph(spark):
    lead = spark.createDataFrame([(i, *c[0]) for i, c in enumerate(CASES)], "k int, valid boolean, score int, signature string")
    other = spark.createDataFrame([(i, *c[1]) for i, c in enumerate(CASES) if c[1]], "k int, valid boolean, score int, signature string")
    verdict = spark.createDataFrame([(i, *c[2]) for i, c in enumerate(CASES) if c[2]], "k int, decision string, ok boolean")
    got = {r["k"]: r["selected_role"] for r in select_role(lead, other, verdict, "k").collect()}
    assert got == {i: c[3] for i, c in enumerate(CASES)}


def test_cache_and_resume(spark, rows):
    keyed = spark.createDataFrame([("Acme ", "acme.test", "DE", None), ("acme", "https://acme.test/", "de", None), ("acme", "https://acme.test/", "fr", None)], "n string, w string, c string, p string")
    k = [r[0] for r in keyed.select(inc.cache_key(F.col("n"), F.col("w"), F.col("c"), F.col("p"), 3)).collect()]
    assert k[0] == k[1] != k[2] and len(k[0]) == 24
    asked = spark.createDataFrame([("a",), ("b",)], "k string")
    entries = spark.sql("select * from values ('a', 1, timestamp'2024-01-01'), ('a', 2, timestamp'2024-01-03'), ('b', 3, timestamp'2023-01-01') as t(k, entry_id, created_at)")
    assert rows(inc.cache_lookup(asked, entries, "k", F.lit("2024-01-10").cast("timestamp")), "k", "entry_id", "hit") == [("a", 2, True), ("b", None, False)]
    done = spark.createDataFrame([(1, "valid"), (2, "failed")], "id int, status string")
    assert rows(inc.pending(spark.createDataFrame([(1,), (2,), (3,)], "id int"), done, "id", F.col("status") == "valid")) == [(2,), (3,)]
    assert rows(inc.upsert(done, spark.createDataFrame([(2, "valid"), (4, "new")], "id int, status string"), ["id"])) == [(1, "valid"), (2, "valid"), (4, "new")]


def test_provider_rounds(spark):
    recorded = spark.createDataFrame([("a", "lead", 1, "ok"), ("b", "lead", 1, "bad"), ("b", "lead", 2, "ok")], "key string, role string, attempt int, answer string")
    requests = spark.createDataFrame([(k, "lead", "") for k in "abc"], "key string, role string, prompt string")
    got = {r["key"]: (r["attempt"], r["accepted"]) for r in rounds(requests, ReplayProvider(recorded), lambda c: c == "ok", 2).collect()}
    assert got == {"a": (1, True), "b": (2, True), "c": (2, False)}


def test_review_and_sinks(spark, tmp_path, rows):
    df = spark.sql("select 'r1' run_id, 0 idx, 'Valid ' status, 5.0D duration_seconds, 120 score, timestamp'2024-01-01' loaded_at, timestamp'2024-01-01' finished_at union all select 'r1', 0, 'Valid ', 5.0D, 120, timestamp'2024-01-01', timestamp'2024-01-01' union all select 'r1', 1, 'deferred', 7.0D, 50, timestamp'2024-01-01', timestamp'2024-01-01'")
    once = rv.once(df)
    assert rows(rv.run_overview(once)) == [("r1", 2, 1, 1, 6.0)]
    assert rows(once.select("idx", rv.bounded_score(F.col("score")))) == [(0, None), (1, 50)]
    lines = [r[0] for r in sinks.markdown_report(spark.createDataFrame([("a|b", 1)], "n string, k int"), ["n", "k"], ["n"]).collect()]
    assert lines == ["| n | k |", "| --- | --- |", "| a\\|b | 1 |"]
    sinks.write_table(once, str(tmp_path / "t"), ["run_id"])
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    assert sinks.html_rows(spark.createDataFrame([("<a>",)], "n string"), ["n"]).first()[0] == "<tr><td>&lt;a&gt;</td></tr>"


def test_records(spark, tmp_path, rows):
    (tmp_path / "r.json").write_text('[{"name": "Acme", "website": "acme"}, {"id": "x", "name": " "}, {"id": "x", "name": "B", "website": "b.test"}]', encoding="utf-8")
    df = rec.json_records(spark, str(tmp_path / "r.json")).withColumn("record_id", F.monotonically_increasing_id())
    assert sorted(r["violation"] for r in rec.record_violations(df).collect()) == ["blank name", "repeated id", "repeated id", "website without host"]
    assert [r["id"] for r in rec.with_input_ids(df, "record_id").orderBy("record_id").collect()] == ["input-001", "x", "x"]
    for run, name in itertools.product(("run1",), ("001-a", "002-b")):
        d = tmp_path / "out" / run / "records" / name
        d.mkdir(parents=True)
        (d / "result.json").write_text('{"status": "valid"}', encoding="utf-8")
    assert rows(rec.result_tree(spark, str(tmp_path / "out"), "status string"), "run_id", "record_dir", "status") == [("run1", "001-a", "valid"), ("run1", "002-b", "valid")]


def test_stream(spark, tmp_path):
    from assaykit.streaming.runs import results_stream, windowed_overview

    df = spark.sql("select 'r1' run_id, 0 idx, 'valid' status, 5.0D duration_seconds, timestamp'2024-01-01 00:10:00' finished_at union all select 'r1', 1, 'failed', 7.0D, timestamp'2024-01-01 00:20:00' union all select 'r1', 0, 'valid', 5.0D, timestamp'2024-01-01 00:10:00'")
    df.write.parquet(str(tmp_path / "in"))
    q = windowed_overview(results_stream(spark, str(tmp_path / "in"), df.schema)).writeStream.outputMode("update").format("memory").queryName("overview").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    r = spark.table("overview").first()
    assert (r["selected"], r["valid"]) == (2, 1)
