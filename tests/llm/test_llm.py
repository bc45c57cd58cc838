import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from assaykit.llm import address_copies as ac
from assaykit.llm import canonical_values as cv
from assaykit.llm import containers as ct
from assaykit.llm import name_links as nl
from assaykit.llm import page_body as pb
from assaykit.llm import personal_data as pd8
from assaykit.llm import source_mix as sm
from assaykit.llm.mincut import cut_cost, min_cut
from assaykit.llm.residue import has_open_slot, is_bad_title, is_message
from assaykit.llm.setjoin import in_rarity_order, jaccard, may_reach, rarity, with_prefix
from assaykit.llm.textforms import osa, pair_grams


# --- problem 1 ---------------------------------------------------------------------------------------------------
def countries(spark):
    return spark.createDataFrame([(1, "DE", "Germany"), (2, "NG", "Nigeria"), (3, "PE", "Peru"), (4, "CL", "Chile"), (5, "KR", "South Korea"), (6, "CN", "China")], "country_id bigint, code string, name string")


COUNTRY_CASES = {
    "GERMANY": 1, "Gremany": 1, "Germny": 1, "(DE)": 1, "DE - Germany": 1, "Deutschland": 1, "德国": 1, "plant: Germany": 1, "Norhaven, Germany": 1, "Mirlow / DE": 1, "Peru/Chile": 0, "Nigeria or Niger": 0,
    "North Korea": 0, "Korea (Republic of)": 5, "Chile (CL)": 4, "Cihna": 6, "unknown": 0, "-": 0, "x" * 5000: 0,
}


def test_countries(spark):
    rows = [(i, v) for i, v in enumerate(COUNTRY_CASES)] + [(900, None), (901, "  "), (902, "Germany"), (903, "GERMANY")]
    df = spark.createDataFrame([(i, v, "z") for i, v in rows], "record_id bigint, country string, value string")
    names = countries(spark)
    got = {r["row_id"]: r["entry_id"] for r in cv.mapped_rows(df, cv.reference(spark, names, "country_id", ["name", "code"], "country"), "record_id", "country", names, "t", places=True).collect()}
    assert got == {**{i: COUNTRY_CASES[v] for i, v in rows[: len(COUNTRY_CASES)]}, 903: 1}


def test_products(spark):
    names = spark.createDataFrame([(1, "Andalusite Grain", "红柱石颗粒"), (2, "Zircon Sand", "锆英砂"), (3, "Zircon Flour", "锆英粉"), (4, "Ball Clay", "球土")], "product_id bigint, name string, name_zh string")
    cases = {"Grain, Andalusite": 1, "AndalusiteGrain": 1, "Andalus1te Grain": 1, "红柱石颗粒/Andalusite Grain": 1, "Andalusite Grains approx. 40 t/month": 1, "Zircon snd": 2, "Zirkonmehl": 3, "锆英砂A级": 2, "Ball bearing": 0, "consulting": 0, "Zircon Sand / Zircon Flour": 0}
    df = spark.createDataFrame(list(enumerate(cases)), "direction_id bigint, product string")
    ref = cv.reference(spark, names, "product_id", ["name", "name_zh"], "product")
    got = {r["row_id"]: r["entry_id"] for r in cv.mapped_rows(df, ref, "direction_id", "product", names, "t", heavy=1).collect()}
    assert got == dict(enumerate(cases.values()))
    assert cv.mapped_rows(df.filter("false"), ref, "direction_id", "product", names, "t").count() == 0


def test_prefix_join_loses_no_pair(spark):
    rng = random.Random(3)
    sets = [(f"w{i}", sorted(set(rng.choices("abcdefghijkl", k=rng.randrange(2, 9))))) for i in range(60)]
    df = spark.createDataFrame(sets, "k string, tokens array<string>")
    for t in (0.3, 0.5, 0.8):
        o = in_rarity_order(df, rarity(df), "k")
        p = with_prefix(o, "k", t)
        q = p.select(F.col("k").alias("y"), F.col("n").alias("m"), F.col("pos").alias("r"), "token")
        pairs = p.join(q, "token").filter("k < y").filter(may_reach(F.col("n"), F.col("pos"), F.col("m"), F.col("r"), t)).select("k", "y").distinct()
        full = pairs.join(o.select("k", F.col("tokens").alias("a")), "k").join(o.select(F.col("k").alias("y"), F.col("tokens").alias("b")), "y").filter(jaccard(F.col("a"), F.col("b")) >= t - 1e-9)
        got = {(r["k"], r["y"]) for r in full.collect()}
        want = {tuple(sorted((a, b))) for (a, x), (b, y) in itertools.combinations(sets, 2) if len(set(x) & set(y)) / len(set(x) | set(y)) >= t - 1e-9}
        assert got == want


def test_osa_and_grams():
    assert [osa("china", x) for x in ("china", "cihna", "chna", "chiina", "chona")] == [0, 1, 1, 1, 1]
    assert osa("abc", "xyzuvw") > 3 and osa("", "ab") == 2
    assert sorted(pair_grams(["ab"])) == sorted(["^a", "ab", "$b"]) and len(pair_grams(["aaa"])) == 4


# --- problems 2 and 5 ----------------------------------------------------------------------------------------------
def test_min_cut_is_least():
    rng = random.Random(5)
    for _ in range(150):
        n = rng.randrange(1, 9)
        costs = [round(rng.uniform(-2, 2), 2) for _ in range(n)]
        edges = [(i, i + 1, round(rng.uniform(0, 1.5), 2)) for i in range(n - 1)] + [(i, i + 2, 0.4) for i in range(n - 2) if rng.random() < 0.5]
        best = min(cut_cost(costs, edges, list(x)) for x in itertools.product([False, True], repeat=n))
        assert abs(cut_cost(costs, edges, min_cut(costs, edges)) - best) < 1e-6
    assert min_cut([], []) == []


PACK = """# Evidence pack
Company: Bahetrel Hakrifix Metallurgy A.S.

## S1
URL: https://b.test/
Title: T

Menu
* News
* Login
Home > Products > Dolime Clinker

# Production in Mirlow
Drying takes 33 hours, heating up another 63, and nobody disputes it.
* Olivine Sand, 4-34 mm

Related reading
Since 1981 all waste heat of the hall is… » more
© 2020 Bahetrel Hakrifix. All rights reserved.

## S2
URL: u
Title: T
Skip to content

Oops! Something went wrong.
Please try again later.

Privacy | Terms

## S3
URL: u
Title: {{ product }}
Some functions of this page need JavaScript.
The furnace controller shows error 404 when the thermocouple in zone 19 is open.
Privacy

## S4
URL: u
Title: T
Menu
Privacy | Terms"""


def test_pages(spark):
    df = spark.createDataFrame([(1, PACK), (2, None), (3, ""), (4, "head only")], "bundle_id bigint, text string")
    parts = pb.parsed(df)
    assert [(r["bundle_id"], r["section"]) for r in pb.residue_sections(parts).collect()] == [(1, "S2")]
    lines = PACK.split("\n")
    got = {lines[r["line_no"] - 1] for r in pb.furniture_lines(parts).collect()}
    assert got == {"Menu", "* News", "* Login", "Home > Products > Dolime Clinker", "Related reading", "Since 1981 all waste heat of the hall is… » more", "© 2020 Bahetrel Hakrifix. All rights reserved.", "Some functions of this page need JavaScript.", "Privacy", "Privacy | Terms"}
    assert pb.furniture_lines(pb.parsed(df.filter("false"))).count() == 0


@pytest.mark.parametrize("t", ["404 Not Found", "Oops! Something went wrong.", "You need to enable scripts to run this app.", "Lorem ipsum dolor sit amet", "This is sample text. Click to edit.", "抱歉，您访问的页面不存在。", "undefined undefined", "Fehler 503: forbidden", "Verifying that you are human."])
def test_messages(t):
    assert is_message(t)


@pytest.mark.parametrize("t", ["", "Access to the hot zone is denied while the interlock is set.", "Sample text on the drawing reads zone 47.", "Nothing was found in the moved kiln car but Hydratable Alumina.", "Home scrap makes up 46 percent of the charge."])
def test_no_messages(t):
    assert not is_message(t)


def test_slots_and_titles(spark):
    assert has_open_slot("Welcome to {{ product }}!") and has_open_slot("Contact [phone] for [company_name].") and has_open_slot("%city%")
    assert not has_open_slot("Bag labels carry the fields <grade> and <batch> in that order.") and not has_open_slot("The set {0.5, 1.0} gives sizes.")
    bad = ["Untitled Document", "404 Not Found", "{{year}} - Acme", "Home – ${Your text}", "Error 503 | Acme", "JUST A MOMENT...", "untitled-11", "[intro_text] - Acme"]
    good = [None, "", " ", "Acme listing", "Default firing curve {A-C} – Acme", "Error analysis for kiln thermocouples – Acme", "[2nd edition] Lining handbook – Acme", "Moments in steel: a history – Acme"]
    assert all(map(is_bad_title, bad)) and not any(is_bad_title(x) for x in good if x)
    df = spark.createDataFrame(list(enumerate(bad + good)), "source_row bigint, title string")
    assert sorted(r["row_id"] for r in pb.residue_titles(df, "source_row", "title").collect()) == list(range(len(bad)))


# --- problem 3 -----------------------------------------------------------------------------------------------------
def test_addresses(spark):
    same = ["https://www.Acme.test/A/b?x=1&y=2", "acme.test/a/b/?y=2&x=1&", ' "HTTP://ACME.TEST:80//a/b?utm_source=q&x=1&y=2#top" ', "<https://acme.test/a/b?x=1&y=2>;"]
    other = ["https://acme.test/a/b?x=1&y=3", "https://b.acme.test/a/b?x=1&y=2", "https://acme.test/a/c"]
    none = [None, "", " ", "n/a", "http://", "www", "-", "localhost"]
    df = spark.createDataFrame([(i, v, "c") for i, v in enumerate(same + other + none + none)], "k bigint, url string, canon string")
    h = ac.hashed_addresses(df, "k", "url", "t")
    for heavy in (1, 100):
        got = sorted((r["kept_id"], r["copy_id"]) for r in ac.address_copies(h, heavy).collect())
        assert got == [(0, 1), (0, 2), (0, 3)]
    counts = {r["kept_id"]: r["copies"] for r in ac.address_counts(h).collect()}
    assert counts == {0: 4, 4: 1, 5: 1, 6: 1}
    assert ac.address_copies(ac.hashed_addresses(df.filter("false"), "k", "url", "t")).count() == 0


def test_hash_collisions_are_parted(spark):
    df = spark.createDataFrame([(0, "a.test/1"), (1, "a.test/2"), (2, "a.test/1")], "k bigint, url string")
    h = ac.hashed_addresses(df, "k", "url", "t").withColumn("h1", F.lit(1).cast("bigint")).withColumn("h2", F.lit(2).cast("bigint"))
    assert [(r["kept_id"], r["copy_id"]) for r in ac.address_copies(h).collect()] == [(0, 2)]
    assert sorted(r["copies"] for r in ac.address_counts(h).collect()) == [1, 2]


# --- problem 4 -----------------------------------------------------------------------------------------------------
@pytest.mark.parametrize(
    "name,brand,trade",
    [("Hepadam Neruvom Minerals Sociedad Anónima", "hepadam neruvom", "minerals"), ("Neruvom Hepadam Mins S.A.", "hepadam neruvom", "minerals"), ("Co., Ltd. Zapigam + Tradirath Alloys", "tradirath zapigam", "alloys"), ("M/s Hetrival & Barala G.m.b.H.", "barala hetrival", None),
     ("(Fasekris-Fibrafart Industries s.r.o.)", "fasekris fibrafart", "industries"), ("Heruposbronofilk Cstgs A.S.（HBC）", "heruposbronofilk", "castings"), ("Hezagalk Stlwks / Hezagalk", "hezagalk", "steelworks")],
)
def test_name_parts(name, brand, trade):
    assert nl.name_parts(name) == (brand, trade)


def firm_rows(spark):
    data = [
        (1, "Hepadam Neruvom Minerals S.A.", "https://hepadam.test", None, "Romania", 1),
        (2, "Neruvom Hepadam Mins SA", None, None, None, 1),
        (3, "Hepadan Neruvom Minerals", None, None, "Romania", 1),
        (4, "HNM Minerals", "www.intl2.hepadam.test/", None, None, 1),
        (5, "Hepadam Neruvom Kilns GmbH", "https://hepadam-kilns.test", None, "Germany", 2),
        (6, "Hepadam Neruvom Kilns GmbH", None, "https://p.test/company/hepadam-kilns/", "Germany", 2),
        (7, "Zotidros Razestort Kilns", None, "https://p.test/company/hepadam-kilns", "Peru", 2),
        (8, "Sobakol Pagefort Abrasives", None, None, None, 3),
        (9, None, None, None, None, None),
        (10, "  ", None, None, None, None),
    ]
    return data, spark.createDataFrame([d[:5] + ("extra",) for d in data], "record_id bigint, name string, website string, linkedin_url string, country string, brand string")


def test_firms(spark):
    data, df = firm_rows(spark)
    want = {d[0]: min(x[0] for x in data if x[5] == d[5]) for d in data if d[5]}
    found = nl.firms(nl.firm_keys(df))
    assert {r["record_id"]: r["firm_id"] for r in found.collect()} == want
    pairs = {(r[0], r[1]) for r in nl.firm_pairs(found).collect()}
    assert pairs == {(a, b) for a, b in itertools.combinations(sorted(want), 2) if want[a] == want[b]}
    assert nl.firms(nl.firm_keys(df.filter("false"))).count() == 0


# --- problem 6 -----------------------------------------------------------------------------------------------------
def test_fill_is_best():
    rng = random.Random(2)
    for _ in range(60):
        counts = [(x, rng.randrange(1, 4)) for x in sorted({rng.randrange(1, 15) for _ in range(4)}, reverse=True)]
        cap = rng.randrange(1, 40)
        got = ct.fill(cap, counts)
        assert all(got[x] <= n for x, n in counts) and set(got) <= {x for x, _ in counts}
        best = max(s for k in itertools.product(*[range(n + 1) for _, n in counts]) if (s := sum(i * x for i, (x, _) in zip(k, counts))) <= cap)
        assert sum(k * v for k, v in got.items()) == best


def test_plan_uses_all_once():
    rng = random.Random(8)
    hist = Counter(rng.randrange(1, 101) for _ in range(3000))
    used = Counter()
    for need, times in ct.plan(100, hist):
        assert sum(x * n for x, n in need.items()) <= 100
        for x, n in need.items():
            used[x] += n * times
    assert used == hist and ct.plan(10, {}) == []


def test_containers(spark):
    rng = random.Random(9)
    sizes = [rng.choice([7, 7, 7, 40, 3, 99, 100, 101, 250]) for _ in range(400)]
    data = list(enumerate(sizes)) + [(1000, 0), (1001, None), (0, 7)]
    df = spark.createDataFrame([(k, s, 0) for k, s in data], "doc_id bigint, tokens bigint, container int")
    out = ct.containers(df, 100).collect()
    per = Counter()
    for r in out:
        per[r["container"]] += r["tokens"]
    assert max(per.values()) <= 100
    placed = Counter()
    for r in out:
        placed[r["doc_id"]] += r["tokens"]
        assert r["piece"] == 0 or sizes[r["doc_id"]] > 100
    assert placed == Counter({k: s for k, s in enumerate(sizes)}) + Counter({0: 7})
    assert len(per) <= -(-sum(per.values()) // 100) * 1.05 + 1
    assert ct.containers(df.filter("false"), 100).count() == 0


# --- problem 7 -----------------------------------------------------------------------------------------------------
def test_mix(spark):
    rng = random.Random(1)
    docs = [(i, rng.choice(["a"] * 6 + ["b"] * 2 + ["c", None, "other"]), rng.randrange(1, 50)) for i in range(4000)] + [(9000, "a", 0)]
    df = spark.createDataFrame(docs, "doc_id bigint, source string, tokens bigint")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 3), ("d", 0.0, 1)], "source string, target_share double, max_repeats int")
    mix = sm.source_mix(df, targets)
    shares = {r["source"]: (r["actual_share"], r["most_copies"]) for r in sm.mix_shares(mix, targets).collect()}
    assert all(abs(shares[s][0] - w) < 0.005 for s, w in (("a", 0.5), ("b", 0.3), ("c", 0.2)))
    assert shares["a"][1] <= 1 and shares["b"][1] <= 2 and shares["c"][1] <= 3 and shares["d"] == (0.0, 0)
    assert mix.filter("source is null or source = 'other' or tokens = 0").count() == 0
    assert sm.source_mix(df.filter("false"), targets).count() == 0
    capped = {r["source"]: r["tokens"] for r in sm.mix_shares(sm.source_mix(df, targets, total=10**7), targets).collect()}
    have = Counter()
    for _, s, n in docs:
        have[s] += n
    assert capped["a"] == have["a"] and capped["c"] == 3 * have["c"]


# --- problem 8 -----------------------------------------------------------------------------------------------------
TEXT = (
    "Reply came from brodroetti69(at)webmail.example. Dr. Mirela Didiova signed the test report. Moved to 172 Rahul Street, 13437 Puerto Lindal in spring. The Rafael process needs no binder. "
    "For the gate list: social security number 666 72 0362. (1-202-555-0174; w.hadraquist@firm.co.example) Drawing 202-317-1199 rev. C applies. Road tanker 033-03-6840 left empty. Price 12 pcs @ 4.83 each. "
    "Write to info at postfach dot test for the data sheet. 办公地点在宁窑市兴窑大道302号859室。已与扈渺野女士通话。身份证号 994343199813103767。 Im Jahr 1964 kam eine Halle. Der Sitz ist Am Pimurik 122, Kelbrück. Best regards,\nZsofia Lekoaus"
)
WANT = {
    ("email", "brodroetti69(at)webmail.example"), ("name", "Mirela Didiova"), ("address", "172 Rahul Street, 13437 Puerto Lindal"), ("id_number", "666 72 0362"), ("phone", "1-202-555-0174"), ("email", "w.hadraquist@firm.co.example"),
    ("email", "info at postfach dot test"), ("address", "宁窑市兴窑大道302号859室"), ("name", "扈渺野"), ("id_number", "994343199813103767"), ("address", "Am Pimurik 122, Kelbrück"), ("name", "Zsofia Lekoaus"),
}


def test_personal_data(spark):
    df = spark.createDataFrame([(1, TEXT), (2, None), (3, ""), (4, "nothing here"), (5, "word " * 20000 + "Tel. 020 7946 0573.")], "doc_id bigint, text string")
    spans = pd8.personal_spans(df)
    got = pd8.personal_values(spans).collect()
    assert {(r["kind"], r["found"]) for r in got if r["doc_id"] == 1} == WANT
    assert [(r["kind"], r["found"]) for r in got if r["doc_id"] == 5] == [("phone", "020 7946 0573")]
    out = {r["doc_id"]: r["text"] for r in pd8.redacted(df, spans).collect()}
    assert out[2] is None and out[3] == "" and out[4] == "nothing here"
    assert not any(f in out[1] for _, f in WANT) and "Dr. [NAME] signed the test report. Moved to [ADDRESS] in spring. The Rafael process" in out[1]
    assert pd8.personal_spans(df.filter("false")).count() == 0


def test_terms_reveal_names(spark):
    anchored = [(i, f"Mr. Halina Fano{c} called. The kiln runs. Storage is dry.") for i, c in enumerate("abcdefgh")]
    plain = [(100 + i, f"Puerto Lindal lies {i} km away. Ball Clay comes by rail. Andalusite Grain is dry.") for i in range(60)]
    df = spark.createDataFrame(anchored + plain + [(999, "Gestern kam Halina Trebond zur Schicht.")], "doc_id bigint, text string")
    got = {(r["kind"], r["found"]) for r in pd8.personal_values(pd8.personal_spans(df)).collect() if r["doc_id"] >= 100}
    assert got == {("name", "Halina Trebond")}
