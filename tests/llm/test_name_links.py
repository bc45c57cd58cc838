"""Similar brands of problem 4: all pairs that brute force finds, few others compared."""

import itertools
import random

from assaykit.llm import name_links as nl
from assaykit.llm.textforms import osa


def lev(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        last = row
    return last[-1]


def grams(brand, q):
    words = brand.split(" ")
    parts = [f"^{w}^" for w in words] if q == 2 else [*words, "".join(words), "".join(reversed(words))]
    return {p[i : i + q] for p in parts for i in range(max(1, len(p) - q + 1))}


def brute(rows):
    least, blocks, out = {}, {}, set()
    for brand, trade, country in rows:
        w = brand.replace(" ", "")
        least[w] = min(brand, least.get(w, brand))
        blocks.setdefault(w, set()).update({("t", trade), ("c", country)} - {("t", None), ("c", None)})
    for i, j in itertools.permutations(least.values(), 2):
        x, y = i.replace(" ", ""), j.replace(" ", "")
        slips = min(lev(x, y), lev("".join(reversed(i.split(" "))), y))
        if not (i < j and slips <= 2 and blocks[x] & blocks[y] and abs(len(i) - len(j)) <= 3):
            continue
        share = lambda q: len(grams(i, q) & grams(j, q)) / len(grams(i, q) | grams(j, q))  # noqa: B023, E731
        if max(len(x), len(y)) <= nl.SHORT and share(2) >= nl.T_SHORT or min(len(x), len(y)) >= nl.LONG and share(4) >= nl.T_LONG:
            out.add((x, y, slips))
    return out


def slipped(r, text, n):
    t = list(text)
    for _ in range(n):
        i, c = r.randrange(len(t) + 1), r.choice("abké中")
        t[i : i + r.randrange(2)] = r.choice([[c], [], [c]])
    return " ".join(sorted("".join(t).split())) or "a"


def test_similar_brands_are_those_of_brute_force(spark):
    r = random.Random(5)
    words = ["".join(r.choice(["ko", "pi", "ta", "zor", "né", "b", "中文"]) for _ in range(n)) for n in (1, 1, 2, 3, 3, 4, 5, 6)]
    rows = [(b, r.choice(["steel", "cement", None]), r.choice(["1", "2", None])) for _ in range(220) for w in [r.sample(words, r.choice([1, 2, 2, 3]))] for b in [slipped(r, r.choice(["", " ", " "]).join(w), r.randrange(3))]]
    df = spark.createDataFrame([(b.replace(" ", ""), b, t, c) for b, t, c in rows], "joined string, brand string, trade string, country string")
    want = brute(rows)
    assert len(want) > 50
    for together in (1_000, 2):
        assert {tuple(x) for x in nl.similar_brands(df, together=together).collect()} == want


def test_brands_that_share_grams_only_do_not_meet(spark):
    r = random.Random(6)
    part = lambda: "".join(r.choice("bdfgklmnprst") + r.choice("aeiou") for _ in range(r.randrange(3, 5)))
    brands = {f"{part()}titan{part()}" for _ in range(150)}
    df = spark.createDataFrame([(b, b, 1) for b in sorted(brands)], "w string, brand string, block bigint")
    assert nl.met_brands(df).count() < len(brands) ** 2 / 20  # all pairs share two 4-grams


def test_a_word_is_compared_with_few_trades(monkeypatch):
    r, asked = random.Random(7), []
    monkeypatch.setattr(nl, "osa", lambda a, b, most=3: asked.append(a) or osa(a, b, most))
    for _ in range(300):
        nl.trade_of("".join(r.choice("bdfgklmnprst") + r.choice("aeiou") for _ in range(4)))
    assert len(asked) < 300
    assert [nl.trade_of(w) for w in ("stelworks", "metalurgy", "cemnet", "stlwks", "refrac", "ab", "x")] == ["steelworks", "metallurgy", "cement", "steelworks", "refractories", None, None]
