"""Problem 4: rows of one firm under different spellings of its name.

Names part into brand, trade and legal form. Brands meet at equal segments, of which two slips leave one whole, and are
compared by letter q-grams (2 for short brands, 4 for long ones, both in between, so that a slip is never out of reach); each
candidate is verified by a soft weighted token similarity over brand, trade and country, in which a token weighs the logarithm of its rarity and a misspelt one
counts in part, and by the information that agrees: it must outweigh the number of rows a stranger could be among. Equal
keys under the same demand are linked as stars to the least row, never pairwise; connected components then give each row its
firm.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterable
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit.llm.setjoin import TOGETHER, jaccard, met_pairs
from assaykit.llm.textforms import fold, osa
from assaykit.plans.runtime import HEAVY, at_most, bounded_broadcast, connected_components, cut_lineage, heavy_safe_join

#: Words of legal forms and others that name no firm.
LEGAL = frozenset(
    "gmbh gesellschaft mbh mit beschrankter haftung ag aktiengesellschaft kg ltd limited pvt private co company inc incorporated corp corporation llc plc sa sociedad anonima spa societa per azioni sro spol ro srl sl bv besloten vennootschap nv ab aktiebolag as anonim sirketi oy "
    "group gruppe grupo holding the and und y et works wks ferrous messrs".split()
)
#: Lines of business as they stand in names of firms.
TRADES = tuple(
    "abrasives alloys aluminium castings cement ceramics chemicals engineering foundry furnaces glassworks industries insulation kilns limestone logistics materials metallurgy minerals nonferrous refractories steelworks technologies trading mining metals tools plastics foods textiles energy systems".split()
)
_OTHER_TRADES = {"trade": "trading", "nf": "nonferrous", "alu": "aluminium", "cmt": "cement", "industry": "industries", "foundries": "foundry", "refractory": "refractories", "technology": "technologies", "metallurgical": "metallurgy", "steel": "steelworks", "glass": "glassworks", "non": "nonferrous"}
#: Least Jaccard of the 2-grams of short brands and of the 4-grams of long ones.
T_SHORT, T_LONG = 0.4, 0.24
#: Least soft similarity, what a missing trade or country counts of its weight.
SOFT, MISSING = 0.72, 0.4
#: Information in natural units: of a letter of a brand, taken away by a slip, and by which agreement must exceed the logarithm of the number of rows.
LETTER, SLIP, MARGIN = 1.5, 4.0, 2.0
#: Longest brand with 2-grams and shortest with 4-grams; lengths between have both, as slips change the length by two at most.
SHORT, LONG = 13, 11
#: Places of a segment that two slips leave whole: ``(segment, letters that the other form has more, letters by which the segment is moved)``.
PLACES = tuple((k, more, shift) for more in range(-2, 3) for k in range(3) for shift in range(max(-k, more - 2 + k), min(k, more + 2 - k) + 1))


def _within(short: str, long: str) -> bool:
    it = iter(long)
    return all(c in it for c in short)


def _shortened(word: str) -> list[str]:
    """The word itself and without any one of its letters: two words one slip apart have one of these in common."""
    return [word, *(word[:i] + word[i + 1 :] for i in range(len(word)))]


def _listed(keys: Callable[[str], Iterable[str]]) -> dict[str, tuple[str, ...]]:
    """Trades by their keys, in the order of the list."""
    out: dict[str, list[str]] = {}
    for t in TRADES:
        for k in dict.fromkeys(keys(t)):
            out.setdefault(k, []).append(t)
    return {k: tuple(v) for k, v in out.items()}


#: Trades by what a word must share with them: their beginning, a form without one letter, their first letter.
_BY_START, _BY_SLIP, _BY_LETTER = _listed(lambda t: [t[:3]]), _listed(_shortened), _listed(lambda t: [t[0]])
_VOWELS = re.compile(r"[aeiou].*[aeiou]")


@lru_cache(maxsize=50_000)
def trade_of(word: str) -> str | None:
    """The line of business a word stands for: itself, a cut or contracted form, or one slip away; else None."""
    if word in TRADES:
        return word
    if word in _OTHER_TRADES:
        return _OTHER_TRADES[word]
    if len(word) < 2:
        return None
    for t in _BY_START.get(word[:3], ()):
        if t.startswith(word) and len(word) >= 3 or len(word) >= 5 and word[:5] == t[:5] and osa(word, t, 2) <= 2:
            return t
    if len(word) >= 5:
        near = {t for k in _shortened(word) for t in _BY_SLIP.get(k, ())}
        for t in sorted(near, key=TRADES.index):
            if osa(word, t, 1) <= 1:
                return t
    if len(word) >= 3 and not _VOWELS.search(word, 1):
        for t in _BY_LETTER.get(word[0], ()):
            if len(word) <= len(t) - 2 and word[-1] in (t[-1], t[-2], "g", "s") and _within(word, t):
                return t
    return None


@lru_cache(maxsize=200_000)
def name_parts(name: str) -> tuple[str, str | None]:
    """``(brand words parted by blanks, trade or None)``; an alias behind a slash and text in brackets are left aside."""
    text = re.sub(r"\b(?:m/s)\.?\s", " ", fold(name))
    text = re.sub(r"\((?:p|pvt|pvt\. ltd\.?|p\.)\)", " ", text)
    text = re.split(r"\s/\s|\s//\s", text)[0]
    text = re.sub(r"^\W*\((.*)\)\W*$", r"\1", text) if text.count("(") == 1 else text  # all of it in brackets
    text = re.sub(r"\([^)]*\)|\[[^\]]*\]", " ", text)
    text = re.sub(r"\b((?:[a-z]\s?\.\s?){2,})", lambda m: m[1].replace(".", "").replace(" ", "") + " ", text + " ")
    tokens = [w for w in re.split(r"[^\w]+", text) if w]
    tokens = [w for w in tokens if w not in LEGAL and len(w) > 1]
    brand, trade = [], None
    for i, w in enumerate(tokens):
        t = trade_of(w) if len(tokens) > 1 else None
        if t and (i > 0 or len(tokens) > 2):
            trade = trade or t
        else:
            brand.append(w)
    return " ".join(sorted(brand)), trade


def site_key(website: Column) -> Column:
    """Host of the site without www. and without a numbered first label (``intl2.``); NULL where there is none."""
    bare = F.lower(F.btrim(F.coalesce(website, F.lit("")), F.lit(" \t\r\n 　\"'`<>()[]{}.,;:!?…")))
    host = F.regexp_extract(F.regexp_replace(bare, r"^(?:[a-z]+:/*)?(?:[^/?#@]*@)?", ""), r"^[^/?#:\s]+", 0)
    host = F.regexp_replace(F.regexp_replace(host, r"^www\d?\.", ""), r"^[a-z]{2,8}\d{1,2}\.(?=[^.]+\.[^.]+)", "")
    return F.when(host.rlike(r"^[^.]+(\.[^.]+)+$"), host)


def profile_key(url: Column) -> Column:
    """Last segment of a profile page; NULL where there is none."""
    slug = F.lower(F.regexp_extract(F.regexp_replace(F.coalesce(url, F.lit("")), r"[\s/?#\"'>)]+$", ""), r"/(?:company|in|profile|firm)/+([^/?#\s]+)", 1))
    return F.when(slug != "", slug)


def firm_keys(rows: DataFrame, countries: DataFrame | None = None) -> DataFrame:
    """``record_id, brand, letters, trade, country, site, profile`` of rows with a non-blank name.

    ``countries(country, country_id, n)`` maps typed countries; without it they are compared as typed. ``letters`` are the
    brand's letters in order of the alphabet, the same however its words are ordered or joined.
    """

    @F.pandas_udf("struct<brand:string,trade:string>")
    def parts(names: pd.Series) -> pd.DataFrame:
        got = [name_parts(x) for x in names]
        return pd.DataFrame({"brand": [g[0] for g in got], "trade": [g[1] for g in got]}, dtype="object")

    named = rows.filter(F.col("name").rlike(r"[^\s 　​]")).select(F.col("record_id").cast("bigint").alias("record_id"), parts("name").alias("p"), "country", site_key(F.col("website")).alias("site"), profile_key(F.col("linkedin_url")).alias("profile"))
    named = named.select("record_id", "p.brand", F.regexp_replace("p.brand", " ", "").alias("joined"), "p.trade", "country", "site", "profile")
    named = named.withColumn("letters", F.array_join(F.array_sort(F.split("joined", "")), ""))
    if countries is not None:
        mapped = heavy_safe_join(named, countries, ["country"], "n", how="left")
        named = mapped.drop("country", "n").withColumnRenamed("country_id", "country")
    else:
        named = named.withColumn("country", F.lower(F.trim("country")))
    return cut_lineage(named)


def _counted(mapping: DataFrame, total: int) -> DataFrame:
    """``mapping`` written once where ``heavy_safe_join`` will look for hot keys in it, so that it is not made twice."""
    return cut_lineage(mapping) if total > HEAVY else mapping


def _stars(keys: DataFrame, total: int) -> DataFrame:
    """Edges from each row of ``keys(key, record_id, trade)`` to the least row of the same key; none for keys of several trades."""
    least = keys.groupBy("key").agg(F.min("record_id").alias("least"), F.count(F.lit(1)).alias("n"), F.min("trade").alias("low"), F.max("trade").alias("high")).filter("n > 1 and (low is null or low = high)").select("key", "least", "n")
    return heavy_safe_join(keys.select("key", "record_id"), _counted(least, total), ["key"], "n", total=total).filter("record_id <> least").select(F.col("record_id").alias("a"), F.col("least").alias("b"))


def weighted(keyed: DataFrame, total: int) -> DataFrame:
    """``keyed`` with ``w_trade`` and ``w_country``: logarithms of the rarity of a row's trade and country, 0 where there is none."""
    out = keyed
    for c in ("trade", "country"):
        df = keyed.filter(F.col(c).isNotNull()).groupBy(c).agg(F.log(F.lit(total) / F.count(F.lit(1))).alias(f"w_{c}"))
        out = out.join(bounded_broadcast(df), c, "left").withColumn(f"w_{c}", F.coalesce(f"w_{c}", F.lit(0.0)))
    return out


def _segments(form: Column, block: Column, k: Column, length: Column, shift: Column) -> tuple[Column, Column]:
    """Key of what stands in ``form`` where segment ``k`` of a form of this length would stand, moved by ``shift``; and whether it is inside."""
    third = lambda i: F.floor((length + i) / 3).cast("int")
    start = F.when(k == 0, 0).when(k == 1, third(0)).otherwise(third(0) + third(1)) + shift
    inside = (length > 0) & (start >= 0) & (start + third(k) <= F.length(form))
    return F.xxhash64(block, length, k, F.substring(form, start + 1, third(k))), inside


def _joined(c: str) -> Column:
    return F.replace(F.col(c), F.lit(" "), F.lit(""))


def _turned(c: str) -> Column:
    return F.array_join(F.reverse(F.split(F.col(c), " ")), "")


def met_brands(placed: DataFrame, total: int | None = None, together: int = TOGETHER) -> DataFrame:
    """``i, j``: brands of ``placed(w, brand, block)`` of one block that may be at most two slips apart, each pair once or more.

    A brand is written with its words run together in both orders. Of a form parted in three segments, two slips leave one
    whole, with at most as many slips before it as there are segments before it and the rest behind it: so it stands in
    the other brand at one of a few places (``PLACES``), and brands meet at equal segments only. Segments of more than
    ``together`` brands are met in parts.
    """
    zero = F.lit(0)
    own = placed.select("block", F.col("brand").alias("i"), F.explode(F.array_distinct(F.array(F.col("w"), _turned("brand")))).alias("form")).select("*", F.explode(F.array(*map(F.lit, range(3)))).alias("k"))
    own = own.select(_segments(F.col("form"), F.col("block"), F.col("k"), F.length("form"), zero)[0].alias("key"), "i")
    there = placed.select("block", "w", F.col("brand").alias("j"), F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("k", "more", "shift"), p)]) for p in PLACES])).alias("p"))
    key, inside = _segments(F.col("w"), F.col("block"), F.col("p.k"), F.length("w") - F.col("p.more"), F.col("p.shift"))
    there = there.filter(inside).select(key.alias("key"), "j")
    if total is None or total > together:
        hot = own.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > together).select("key", F.ceil(F.col("n") / together).cast("int").alias("parts"))
        if not at_most(hot, 0):
            hot = bounded_broadcast(cut_lineage(hot))
            parts = F.coalesce("parts", F.lit(1))
            own = own.join(hot, "key", "left").select(F.xxhash64("key", F.pmod(F.xxhash64("i"), parts)).alias("key"), "i")
            there = there.join(hot, "key", "left").select("key", "j", F.explode(F.sequence(zero, parts - 1)).alias("part")).select(F.xxhash64("key", F.col("part").cast("bigint")).alias("key"), "j")
    return own.join(there, "key").filter((F.col("i") < F.col("j")) & (F.abs(F.length("i") - F.length("j")) <= 3)).select("i", "j")


def similar_brands(keyed: DataFrame, total: int | None = None, together: int = TOGETHER) -> DataFrame:
    """``x, y, slips``: distinct brands at most two slips apart whose letter q-grams agree.

    Rows of equal brands are one set. Brands meet only if a trade or a country is common to rows of both, as no other pair is
    ever accepted. Pairs that met are compared: they are at most two slips apart, in either order of the words of the
    first, and reach the least Jaccard of the 2-grams of short brands or of the 4-grams of long ones. One slip in six
    letters leaves 0.4 of the 2-grams, two in sixteen leave 0.24 of the 4-grams.
    """
    brands = keyed.filter("joined <> ''").groupBy(F.col("joined").alias("w")).agg(F.min("brand").alias("brand"))
    named = [F.concat(F.lit(f"{c}:"), F.col(c).cast("string")) for c in ("trade", "country")]
    blocks = keyed.filter("joined <> ''").select(F.col("joined").alias("w"), F.explode(F.array_compact(F.array(*named))).alias("block")).distinct()
    placed = cut_lineage(blocks.join(brands, "w").select("w", "brand", F.xxhash64("block").alias("block")))
    x, y = _joined("i"), _joined("j")
    near = met_brands(placed, total, together).filter((F.levenshtein(x, y, 2) >= 0) | (F.levenshtein(_turned("i"), y, 2) >= 0)).select("i", "j").distinct()

    padded = lambda c: F.concat(F.lit("^"), F.replace(F.col(c), F.lit(" "), F.lit("^ ^")), F.lit("^"))
    two = lambda c: F.array_distinct(F.regexp_extract_all(padded(c), F.lit("(?=([^ ]{2}))")))
    # A word of less than four letters is one gram.
    four = lambda c: F.array_distinct(F.regexp_extract_all(F.concat_ws(" ", F.col(c), _joined(c), _turned(c)), F.lit("(?=((?<![^ ])[^ ]{1,3}(?![^ ])|[^ ]{4}))")))
    # The grams come out of a generator, else the filter would compute them anew for each use.
    grams = F.explode(F.array(F.struct(*[g(c).alias(f"{q}_{c}") for q, g in (("two", two), ("four", four)) for c in "ij"])))
    both = near.select("i", "j", grams.alias("g"))
    alike = lambda q, least: jaccard(F.col(f"g.{q}_i"), F.col(f"g.{q}_j")) >= least - 1e-9
    short = (F.greatest(F.length(x), F.length(y)) <= SHORT) & alike("two", T_SHORT)
    long = (F.least(F.length(x), F.length(y)) >= LONG) & alike("four", T_LONG)
    slips = F.array_min(F.filter(F.array(F.levenshtein(x, y, 2), F.levenshtein(_turned("i"), y, 2)), lambda d: d >= 0))
    return both.filter(short | long).select(x.alias("x"), y.alias("y"), slips.alias("slips"))


def firm_links(keyed: DataFrame) -> DataFrame:
    """``a, b``: links between rows of one firm.

    Stars over equal sites, profile pages, and brands with trade, country or both, as far as the information that agrees
    suffices; and for similar brands, links between one row of each (brand, trade, country) of both sides. Firms that share a brand
    but differ in trade and country stay apart: such a pair shares no key and is refused by its soft similarity.
    """
    total = max(keyed.count(), 2)
    need = F.lit(math.log(total) + MARGIN)
    rows = cut_lineage(weighted(keyed, total))
    brand = LETTER * F.length("joined")
    key = lambda name, *cs: F.concat_ws("|", F.lit(name), *[F.col(c).cast("string") for c in cs])
    known = lambda *cs: reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cs])
    keys = [
        F.when(known("site"), key("s", "site")), F.when(known("profile"), key("p", "profile")),
        F.when(known("trade") & (brand + F.col("w_trade") >= need), key("t", "letters", "trade")), F.when(known("country") & (brand + F.col("w_country") >= need), key("c", "letters", "country")),
        F.when(known("trade", "country") & (brand + F.col("w_trade") + F.col("w_country") >= need), key("b", "joined", "trade", "country")),
        # Within equal brands the least row of a (brand, trade, country) stands for its rows: tie them to it.
        F.when((F.col("joined") != "") & (brand >= need), F.concat_ws("|", F.lit("k"), "joined", F.coalesce("trade", F.lit("-")), F.coalesce(F.col("country").cast("string"), F.lit("-")))),
    ]
    # A brand that goes with one trade at most is one firm, also where trade and country are missing.
    single = F.when(brand >= need, F.struct(key("l", "letters").alias("key"), "trade"))
    each = F.concat(F.transform(F.array_compact(F.array(*keys)), lambda k: F.struct(k.alias("key"), F.lit(None).cast("string").alias("trade"))), F.array_compact(F.array(single)))
    stars = _stars(rows.select(F.explode(each).alias("k"), "record_id").select("k.key", "record_id", "k.trade"), total)
    brand_df = rows.groupBy("joined").agg(F.count(F.lit(1)).alias("brand_df"))
    kinds = rows.filter("joined <> ''").groupBy("joined", "trade", "country").agg(F.min("record_id").alias("record_id"), F.min("site").alias("site"), F.min("profile").alias("profile"), F.max("w_trade").alias("w_trade"), F.max("w_country").alias("w_country"))
    kinds = cut_lineage(kinds.join(brand_df, "joined"))
    side = lambda s: kinds.select(F.col("joined").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("trade", "country", "record_id", "site", "profile", "brand_df", "w_trade", "w_country")])
    pairs = similar_brands(rows, total=total).join(side("x"), "x").join(side("y"), "y")
    same = lambda c: F.col(f"{c}_x") == F.col(f"{c}_y")
    brand_w = F.log(F.lit(total) / F.least("brand_df_x", "brand_df_y")) + 0.1
    weight = lambda c: F.when(same(c), F.col(f"w_{c}_x")).otherwise(F.greatest(f"w_{c}_x", f"w_{c}_y"))
    credit = lambda c: F.when(same(c), 1.0).when(same(c).isNull(), MISSING).otherwise(0.0)
    letters = F.least(F.length("x"), F.length("y"))
    soft = (brand_w * (1 - F.col("slips") / F.greatest(F.length("x"), F.length("y"))) + weight("trade") * credit("trade") + weight("country") * credit("country")) / (brand_w + weight("trade") + weight("country"))
    agree = LETTER * letters - SLIP * F.col("slips") + F.when(same("trade"), weight("trade")).otherwise(0.0) + F.when(same("country"), weight("country")).otherwise(0.0)
    yes = lambda c: F.coalesce(same(c), F.lit(False))
    no = lambda c: F.coalesce(~same(c), F.lit(False))
    alike = (soft >= SOFT) & (agree >= need) & (yes("trade") | yes("country")) & ~(no("site") & no("profile"))
    fuzzy = pairs.filter(yes("site") | yes("profile") | alike).select(F.col("record_id_x").alias("a"), F.col("record_id_y").alias("b"))
    return stars.unionByName(fuzzy)


def short_forms(keyed: DataFrame, found: DataFrame, total: int | None = None) -> DataFrame:
    """``a, b``: firms tied by a shortened name of one side: one word of the brand, its blend or its initials.

    The words of a brand come from names of two words and from profile pages; where they are written as one and no
    page parts them, any cut that leaves four letters on either side may be meant. A short form counts only with the
    same trade and country (a longer one also where its country is missing), and only if all rows it may stand for
    belong to one firm.
    """
    rows = keyed.join(found, "record_id")
    words = F.split("brand", " ")
    slug = F.split("profile", "-")
    pair = F.when(F.size(words) == 2, words).when(F.size(slug) == 3, F.slice(slug, 1, 2))
    known = rows.filter("trade is not null").withColumn("w", pair)
    v, w = F.col("w")[0], F.col("w")[1]
    first = F.substring("trade", 1, 1)
    forms = F.array(v, w, F.concat(F.substring(v, 1, 3), F.substring(w, 1, 3)), F.concat(F.substring(w, 1, 3), F.substring(v, 1, 3)), F.concat(F.substring(v, 1, 1), F.substring(w, 1, 1), first), F.concat(F.substring(w, 1, 1), F.substring(v, 1, 1), first))
    j, n = F.col("joined"), F.length("joined")
    at = F.sequence(F.lit(5), n - 3)  # where a second word may begin
    cuts = F.concat(F.transform(at, lambda i: F.left(j, i - 1)), F.transform(at, lambda i: F.substring(j, i, n)), F.transform(at, lambda i: F.concat(F.left(j, F.lit(3)), F.substring(j, i, F.lit(3)))))
    every = F.when(F.col("w").isNotNull(), forms).when((F.size(words) == 1) & (n >= 10), cuts)
    stands = known.select("firm_id", "trade", "country", F.explode(every).alias("joined")).filter(F.length("joined") >= 3)
    short = rows.filter(F.size(words) == 1).select("firm_id", "joined", "trade", "country")

    def tied(left: DataFrame, keys: list[str]) -> DataFrame:
        one = stands.dropna(subset=keys).groupBy(*keys).agg(F.min("firm_id").alias("b"), F.max("firm_id").alias("top"), F.count(F.lit(1)).alias("n")).filter("b = top").select(*keys, "b", "n")
        return heavy_safe_join(left, _counted(one, total or HEAVY + 1), keys, "n", total=total).filter("firm_id <> b").select(F.col("firm_id").alias("a"), "b")

    # Without a country only a whole word counts, and it must be the only one of its trade anywhere.
    alone = short.filter((F.length("joined") >= 7) & F.col("country").isNull())
    return tied(short, ["joined", "trade", "country"]).unionByName(tied(alone, ["joined", "trade"])).distinct()


def firms(keyed: DataFrame) -> DataFrame:
    """``record_id, firm_id, links``: the firm of each row with a name (its least record_id) and the number of other rows of it."""
    total = keyed.count()
    edges = firm_links(keyed).unionByName(keyed.select(F.col("record_id").alias("a"), F.col("record_id").alias("b")))
    found = cut_lineage(connected_components(cut_lineage(edges)).select(F.col("node").alias("record_id"), F.col("component").alias("firm_id")))
    # Firms that short forms tie, also over several ties, take the least id of them all.
    ties = connected_components(cut_lineage(short_forms(keyed, found, total)))
    sizes = found.groupBy("firm_id").agg(F.count(F.lit(1)).alias("n"))
    moved = ties.filter("node <> component").select(F.col("node").alias("firm_id"), F.col("component").alias("target")).join(sizes, "firm_id")
    found = heavy_safe_join(found, moved, ["firm_id"], "n", how="left", total=total).select("record_id", F.coalesce("target", "firm_id").alias("firm_id"))
    found = cut_lineage(found)
    sizes = found.groupBy("firm_id").agg(F.count(F.lit(1)).alias("n"))
    return heavy_safe_join(found, sizes, ["firm_id"], "n", total=total).select("record_id", "firm_id", (F.col("n") - 1).alias("links"))


def firm_pairs(found: DataFrame) -> DataFrame:
    """``record_id_a, record_id_b`` of all pairs of rows of a firm, smaller id first; the result asked for is these pairs."""
    many = cut_lineage(found.filter("links > 0").select("record_id", "firm_id"))
    pairs = met_pairs(many, ["firm_id"], {"record_id": "record_id_a"}, {"record_id": "record_id_b"})
    return pairs.filter("record_id_a < record_id_b").select("record_id_a", "record_id_b")
