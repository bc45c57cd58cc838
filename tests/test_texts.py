"""Text operators on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns of clashing names."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from assaykit.functions import coerce as co
from assaykit.functions import urls as u
from assaykit.operators import evaluation as ev
from assaykit.operators import parsers as ps
from assaykit.operators import ranking as rk
from assaykit.operators import rendering as rd
from assaykit.plans.runtime import connected_components, cut_lineage, heavy_safe_join, release, shared_folder
from assaykit.sources.records import json_records, with_input_ids
from assaykit.sources.sinks import write_json


def test_page_parts():
    title, texts, links = ps.page_parts("<title>A <b>b</b></title><h2>H &amp; i</h2><p>x</p><script>no</script><a href='/u'>go <i>on</i></a><a name=n>none</a><a href='v'>open")
    assert title == "A b" and texts == ["H & i", "x", "go", "on", "none", "open"]
    assert links == [{"url": "/u", "title": "go on", "heading": "H & i", "context": "H & i x"}]
    assert ps.page_parts("") == ("", [], [])
    long = ps.page_parts("<h1>" + "h" * 500 + "</h1>" + "".join(f"<p>{'t' * 90}{i}</p>" for i in range(9)) + "<a href='x'>y</a>")[2][0]
    assert len(long["heading"]) == ps.HEADING_CHARS and len(long["context"]) == ps.CONTEXT_CHARS and long["context"].endswith("t8")


def test_html_of_nulls(spark, rows):
    df = spark.createDataFrame([(1, None, None), (2, "", "https://a.test"), (3, "<a href='b'>B</a>", "https://a.test/x/")], "k int, html string, base string")
    assert rows(df.select("k", ps.html_extract("html", "base").alias("p")).select("k", F.size("p.links").alias("n"), "p.title")) == [(1, 0, ""), (2, 0, ""), (3, 1, "")]
    assert rows(ps.site_links(df, "k", "html", "base"), "k", "url") == [(3, "https://a.test/x/b")]


def brute_mmr(pages, limit, least):
    left, chosen, covered, out = sorted(pages, key=lambda p: p[0]), [], set(), []
    while left and len(chosen) < limit:
        score = lambda p: p[1] + 8 * len(set(p[2]) - covered) - 20 * max((len(set(p[3]) & c) / max(1, len(set(p[3]) | c)) for c in chosen), default=0.0)
        best = max(left, key=score)
        if best[1] < least:
            break
        out.append((best[0], len(out) + 1, best[1], round(score(best) + 1e-9, 1)))
        left.remove(best)
        chosen.append(set(best[3]))
        covered |= set(best[2])
    return out


def test_diverse_choice_is_greedy(spark):
    rng = random.Random(3)
    data = [(g, p, rng.choice([10, 20, 25, 40, 60]), rng.sample(["a", "b", "c", "d"], rng.randrange(4)), rng.sample("uvwxyz", rng.randrange(5)) or None) for g in range(40) for p in range(rng.randrange(1, 7))]
    df = spark.createDataFrame([(*r, "extra") for r in data], "g int, pos int, relevance int, categories array<string>, tokens array<string>, turn string")
    got = {}
    for r in rk.mmr_select(df, "g", 3).collect():
        got.setdefault(r["g"], []).append((r["pos"], r["turn"], r["relevance"], r["selection_score"]))
    for g, members in itertools.groupby(data, key=lambda r: r[0]):
        want = brute_mmr([(p, s, c, t or []) for _, p, s, c, t in members], 3, 20)
        have = sorted(got.get(g, []), key=lambda r: r[1])
        assert [r[:3] for r in have] == [r[:3] for r in want] and all(abs(a[3] - b[3]) < 0.11 for a, b in zip(have, want))
    assert rk.mmr_select(df.filter("false"), "g", 3).count() == 0


def test_size_summary(spark):
    data = [("a", x) for x in (5, 1, 3, 9)] + [("b", 7), ("b", None), ("c", None)] + [("d", 2)] * 50 + [("d", 8)] * 50
    got = {r["g"]: tuple(r)[1:] for r in ev.size_summary(spark.createDataFrame(data, "g string, v bigint"), "v", ["g"]).collect()}
    assert got == {"a": (4, 4.0, 9, 9), "b": (1, 7.0, 7, 7), "d": (100, 5.0, 8, 8)}


@pytest.mark.parametrize("raw,want", [(None, ""), ("", ""), (" https://a.test/x). ", "https://a.test/x"), ("a.test/b,", "https://a.test/b"), ("ftp://a.test", ""), ("...", "")])
def test_clean_search_url(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "a string").select(u.clean_search_url(F.col("a"))).first()[0] == want


def test_coercions(spark):
    df = spark.createDataFrame([(None, None, None, None, None), (" a" * 30, float("nan"), ["", None, "x" * 50, "y"], "https://a.test/" + "p" * 2000, '{"name": "n", "odd": 1}'), ("b", 1.005, [], "https://a.test\nx", "[1]")], "t string, n double, l array<string>, a string, j string")
    got = df.select(co.bounded_text(F.col("t"), 5), co.finite_number(F.col("n")), F.array_join(co.bounded_list(F.col("l"), 2, 3), "|"), co.http_url(F.col("a")), F.array_join(co.unknown_fields(F.col("j"), ["name"]), ",")).collect()
    assert [tuple(r) for r in got] == [("", None, "", "", ""), ("a a a", None, "xxx|y", "", "odd"), ("b", 1.0, "", "", "")] or [r[1] for r in got] == [None, None, 1.01]


def test_shapes_and_links(spark):
    df = spark.createDataFrame([("{\"a\": \"x\", \"b\": 2}",), ("{\"a\": \"x\"}",), ("{\"a\": 1, \"b\": \"y\"}",), ("{\"a\": \"x\", \"b\": 2, \"c\": 0}",), ("x",), (None,)], "j string")
    assert [r[0] for r in df.select(co.same_shape(F.col("j"), "a string, b bigint")).collect()] == [True, False, False, False, False, False]
    src = spark.createDataFrame([([("S1", "https://a.test/?a=1&b=2", "T|<1>"), ("S1", "https://second.test", "again"), ("S2", None, None)],), (None,)], "s array<struct<id:string,url:string,title:string>>")
    ids = F.array(F.lit("S2"), F.lit("S9"), F.lit("S1"))
    assert [tuple(r) for r in src.select(rd.evidence_links(F.col("s"), ids), rd.evidence_links(F.col("s"), ids, True)).collect()] == [("；[T|<1>](https://a.test/?a=1&b=2)", '；<a href="https://a.test/?a=1&amp;b=2">T|&lt;1&gt;</a>'), ("", "")]


def test_json_lines_and_input_ids(spark):
    df = spark.createDataFrame([(i, None if i % 3 else f"x{i}", "n") for i in range(200)] + [(999, "  ", None)], "k bigint, id string, name string")
    folder = shared_folder(spark, "t")
    write_json(df.select("id", "name"), folder)
    assert json_records(spark, folder, lines=True).count() == 201
    got = {r["k"]: r["id"] for r in with_input_ids(df, "k").collect()}
    assert got[0] == "x0" and got[1] == "input-002" and got[199] == "input-200" and got[999] == "input-201" and len(got) == 201


def test_components_raise_and_release(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(300)], "a bigint, b bigint")
    assert {r["component"] for r in connected_components(chain).collect()} == {0}
    with pytest.raises(RuntimeError):
        connected_components(chain, max_rounds=2)
    kept, gone = cut_lineage(chain), cut_lineage(chain)
    release(gone)
    release(chain)  # no checkpoint: nothing happens
    assert kept.count() == 300


def test_hot_keys_beyond_the_bound(spark, monkeypatch):
    monkeypatch.setattr("assaykit.plans.runtime.BROADCAST_ROWS", 2)
    rows = spark.createDataFrame([(i % 7, i) for i in range(700)] + [(None, -1)], "k int, v int")
    mapping = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter("k < 5")
    assert heavy_safe_join(rows, mapping, ["k"], "n", heavy=10).count() == 500
    assert heavy_safe_join(rows, mapping, ["k"], "n", heavy=10, how="left").count() == 701


from test_oracle import DATA, con, plain  # noqa: E402, F401

from assaykit.operators.oracle_texts import ORACLE  # noqa: E402


@pytest.mark.skipif(not DATA.exists(), reason="test tables are not there")
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(spark, con, name):  # noqa: F811
    from assaykit.operators.catalogue import QUERIES

    df = QUERIES[name](spark, str(DATA))
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    ran = con.execute(ORACLE[name])
    names = [d[0] for d in ran.description]
    assert sorted(names) == columns and got
    assert got == sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in ran.fetchall()), key=str)


def test_markdown_round_trip_of_large_ids(spark, rows, tmp_path):
    from assaykit.operators.texts import markdown_round_trip

    for first, kind in ((7, "int"), (60_000_000_001, "bigint")):
        d = tmp_path / kind
        spark.createDataFrame([(first, "a|b", "x\ny"), (first + 1, None, "**z**")], "record_id bigint, name string, industry string").write.parquet(f"{d}/input_records.parquet")
        got = markdown_round_trip(spark, str(d))
        assert dict(got.dtypes)["record_id"] == kind
        assert rows(got) == [(first, "a|b", "x y"), (first + 1, "", "z")]


def test_components_of_few_links_take_few_jobs(spark, rows):
    df = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101), (102, 100), (7, 7), (200, 200)], "a bigint, b bigint")
    spark.sparkContext.setJobGroup("components", "")
    found = connected_components(df)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("components"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert rows(found) == sorted([(k, 0) for k in range(61)] + [(100, 100), (101, 100), (102, 100), (200, 200)], key=str)
    assert jobs < 50, jobs
