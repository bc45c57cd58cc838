"""Which words disclose a person or a number of one: co-occurrence of contexts and terms with protected entities, over the whole corpus.

A candidate (a run of capitalised words; a number in the form of a phone) has a left and a right context and, for names, a
first and a last term. Seeds are sure without a corpus: a title, a sign-off, a role with a colon; a dialling code. A key
discloses the entity by log2 of P(entity | key) against P(entity). Names and contexts teach each other: terms that stand
with seeds mark contexts, contexts mark further terms, and so on. What is learned is a set of keys, each of which holds at
least a fixed share of all entities, so that its size is bounded whatever the corpus is, and can go to every task.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass, field
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit.plans.runtime import cut_lineage

#: A key must hold this share of all entities (at most 1 / LEAST_RATE keys pass) and this many of them.
LEAST_RATE, LEAST_SEEN = 1e-5, 2
#: Bits by which a key must raise the probability of an entity, and the least probability by kind of key.
BITS, LEAST = 3.0, {"pair": 0.3, "left": 0.6, "right": 0.6, "first": 0.3, "last": 0.5}
#: Turns in which contexts and terms teach each other.
TURNS = 2

_TITLES = r"(?:Mrs?|Ms|Miss|Mx|Dr|Prof|Engr|Eng|Ing|Dipl\.-Ing|Herrn?|Frau|Hr|Fr|Sr|Sra|Srta|Don|Doña|Sir|Madam)"
TOKEN = re.compile(rf"\n|\b{_TITLES}\.(?=\s)|(?<![^\W\d_])[^\W\d_]\.(?=[ -])|[^\W\d_]+(?:['’-][^\W\d_]+)*|\d+(?:[.,/:-]\d+)*|[^\w\s]|_+")
#: The titles among the tokens, in lower case.
TITLES = frozenset(x for t in "mr mrs ms miss mx dr prof engr eng ing dipl.-ing herr herrn frau hr fr sr sra srta don doña sir madam".split() for x in (t, t + "."))
#: Words that end a letter or a list of receivers, or name the role of a person; what follows them is a person.
SIGN_OFF = frozenset("regards|sincerely|yours|cheers|grüßen|grüße|gruß|saludo|saludos|cordiales|atentamente|faithfully|cc".split("|"))
ROLE = re.compile(r"(?i)(?:^|\s)(?:person|owner|manager|director|buyer|contacto|gerente|inhaber(?:in)?|leiter(?:in)?|[^\W\d_]+leiter(?:in)?|geschäftsführer(?:in)?|ansprechpartner(?:in)?)$")
#: Words that run between the parts of a name.
PARTICLES = frozenset("el al ben bin ibn van von de der den di da del la le ter ten zu dos".split())
ENDS = frozenset(".!?。！？;；")
_WORD = re.compile(r"[^\W\d_]")


@dataclass
class Text:
    """Tokens of a text with their places."""

    text: str
    tokens: list[str] = field(default_factory=list)
    start: list[int] = field(default_factory=list)
    low: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        found = list(TOKEN.finditer(self.text))
        self.tokens = [m[0] for m in found]
        self.start = [m.start() for m in found]
        self.low = [x.lower() for x in self.tokens]

    def end(self, i: int) -> int:
        return self.start[i] + len(self.tokens[i])

    def ends_sentence(self, i: int) -> bool:
        """True at a full stop, and at a line break but for one behind a comma or a sign-off."""
        t = self.tokens[i]
        if t == "\n":
            return i == 0 or self.tokens[i - 1] != "," and self.low[i - 1] not in SIGN_OFF
        return t in ENDS

    def left(self, i: int) -> str:
        """The two words before token ``i`` with what stands between; ``<s>`` where the sentence begins, a title alone. Digits are masked."""
        out, words, j = [], 0, i - 1
        if j >= 0 and self.low[j] in TITLES:
            return self.low[j]
        if j >= 0 and self.tokens[j] == ")":
            return "<s>"
        while j >= 0 and words < 2 and len(out) < 5:
            if self.ends_sentence(j):
                break
            t = self.low[j]
            if t[0].isdigit():
                t, words = "0", words + 1
            elif _WORD.match(t):
                words += 1
            out.append(t)
            j -= 1
        if words < 2 and (j < 0 or self.ends_sentence(j)):
            out.append("<s>")
        return " ".join(reversed(out))

    def left_of(self, place: int) -> str:
        """``left`` of the token that starts at or after a place in the text."""
        return self.left(bisect_left(self.start, place))

    def right(self, j: int) -> str:
        """The two words from token ``j`` on, up to the end of the sentence or line."""
        out, words, n = [], 0, len(self.tokens)
        while j < n and words < 2 and len(out) < 4:
            t = self.low[j]
            if t in ENDS or t == "\n":
                out.append(".")
                break
            if t[0].isdigit():
                t, words = "0", words + 1
            elif _WORD.match(t):
                words += 1
            out.append(t)
            j += 1
        if j >= n:
            out.append(".")
        return " ".join(out)


@lru_cache(maxsize=50_000)
def term(word: str) -> str:
    return word.casefold().strip(".,'’")


def runs(t: Text) -> list[tuple[int, int]]:
    """Runs of capitalised words and particles on one line, as token ranges; titles and sentence ends part them, what touches an address is left out."""
    out, n, upto = [], len(t.tokens), 0
    tokens, start, low, text = t.tokens, t.start, t.low, t.text
    upper = [w[0].isupper() and x not in TITLES for w, x in zip(tokens, low)]
    for i, capital in enumerate(upper):
        if not capital or i < upto:
            continue
        j = i + 1
        while j < n and text[start[j] - 1] == " " and start[j] == start[j - 1] + len(tokens[j - 1]) + 1:
            if upper[j]:
                j += 1
            elif low[j] in PARTICLES and j + 1 < n and upper[j + 1] and start[j + 1] == t.end(j) + 1:
                j += 2
            else:
                break
        upto = j
        a, b = start[i], t.end(j - 1)
        after = text[b : b + 1]
        if not (a and text[a - 1] in "@._/+=-" or after and (after in "@_/=" or after in ".-" and text[b + 1 : b + 2].isalnum())):
            out.append((i, j))
    return out


def seeded(t: Text, i: int) -> bool:
    """True if what stands left of token ``i`` makes it a person without any corpus."""
    j = i - 1
    if j < 0:
        return False
    if t.low[j] in TITLES:
        return True
    if t.tokens[j] in "—–" and (j == 0 or t.ends_sentence(j - 1) or t.tokens[j - 1] == "\n"):
        return True
    if t.low[j] == "cc" or t.tokens[j] in ":." and j and t.low[j - 1] == "cc":
        return True
    if t.tokens[j] == "\n":
        while j > 0 and t.tokens[j] in ("\n", ","):
            j -= 1
        return t.low[j] in SIGN_OFF
    return t.tokens[j] == ":" and j > 0 and bool(ROLE.search(t.low[j - 1]))


def learned(stats: DataFrame, kinds: tuple[str, ...], hit: Column, least: dict[str, float] = LEAST, seen: int = LEAST_SEEN) -> DataFrame:
    """``kind, key, share, bits, n``: keys that disclose. ``stats(left, right, first, last, n, ...)``, ``hit`` says which rows count as entities."""
    both, name = F.concat_ws("|", "left", "right"), F.concat_ws(" ", "first", "last")
    key = {"pair": (both, F.col("first")), "left": (F.col("left"), F.col("first")), "right": (F.col("right"), F.col("first")), "first": (F.col("first"), F.concat(both, name)), "last": (F.col("last"), F.concat(both, name))}
    sides = F.array(*[F.struct(F.lit(k).alias("kind"), key[k][0].alias("key"), F.xxhash64(key[k][1]).alias("other")) for k in kinds])
    rows = stats.select("n", F.when(hit, F.col("n")).otherwise(0).alias("h"), F.explode(sides).alias("k"))
    # Counted by partner first: one context or one name seen often is no evidence for the other side.
    by = rows.groupBy("k.kind", "k.key", "k.other").agg(F.sum("n").alias("n"), F.sum("h").alias("h"))
    got = by.groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("h").alias("h"), F.sum((F.col("h") > 0).cast("int")).alias("partners"))
    whole = stats.agg(F.sum("n").alias("n"), F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("h")).first()
    n, h = whole["n"] or 0, whole["h"] or 0
    p = max(h / max(n, 1), 1e-12)
    share = F.col("h") / F.col("n")
    level = F.coalesce(*[F.when(F.col("kind") == k, v) for k, v in least.items()])
    enough = (F.col("h") >= F.lit(max(seen, h * LEAST_RATE))) & (F.col("partners") >= seen) & F.col("key").isNotNull() & (F.col("key") != "")
    return got.filter(enough).select("kind", "key", share.alias("share"), F.log2(share / F.lit(p)).alias("bits"), "n").filter((F.col("bits") >= F.least(F.lit(BITS), F.log2(F.lit(1 / p)) / 2)) & (F.col("share") >= level))


def _known(stats: DataFrame, keys: DataFrame, kind: str, column: Column, name: str) -> DataFrame:
    """``stats`` with ``name`` true where a key of ``kind`` was learned. At most 1 / LEAST_RATE keys of a kind exist, so they are broadcast."""
    mapping = keys.filter(F.col("kind") == kind).select(F.col("key").alias("_k"), F.lit(True).alias("_y"))
    return stats.withColumn("_k", column).join(F.broadcast(mapping), "_k", "left").withColumn(name, F.coalesce("_y", F.lit(False))).drop("_k", "_y")


def person_keys(stats: DataFrame, turns: int = TURNS) -> DataFrame:
    """Keys that disclose persons, from ``stats(left, right, first, last, sure, n)``: terms that stand with seeds, then contexts and terms in turns.

    One word alone (``first`` equals ``last``) is no person by its term: machines and towns bear first names, too.
    """
    # A sure full name tells its first term by itself; contexts need two of them.
    terms = cut_lineage(learned(stats, ("first",), F.col("sure") & (F.col("first") != F.col("last")), {"first": 0.02}, 1))
    for turn in range(turns):
        known = _known(stats, terms, "first", F.col("first"), "_f")
        keys = cut_lineage(terms.unionByName(learned(known, ("pair", "left", "right"), F.col("sure") | F.col("_f") & (F.col("first") != F.col("last"))).filter(F.regexp_replace("key", "<s>", "").rlike(r"\p{L}"))))
        if turn + 1 < turns:
            marked = _known(_known(_known(stats, keys, "pair", F.concat_ws("|", "left", "right"), "_p"), keys, "left", F.col("left"), "_l"), keys, "right", F.col("right"), "_r")
            terms = cut_lineage(learned(marked, ("first", "last"), F.col("sure") | F.col("_p") | F.col("_l") | F.col("_r")))
    return keys


def number_keys(stats: DataFrame) -> DataFrame:
    """``key``: left contexts of numbers that speak against a phone: seen often, hardly ever with a sure one. ``stats(left, sure, n)``."""
    got = stats.groupBy("left").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("sure"), F.col("n")).otherwise(0)).alias("h"))
    whole = stats.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("sure"), F.col("n")).otherwise(0)).alias("h")).first()
    n, h = whole["n"] or 0, whole["h"] or 0
    bits = F.log2((F.col("h") + 0.5) / (F.col("n") + 1) / F.lit(max((h + 0.5) / (n + 1), 1e-12)))
    return got.filter((bits <= -BITS) & (F.col("n") >= F.lit(n * LEAST_RATE))).select(F.col("left").alias("key"))
