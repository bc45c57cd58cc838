"""Problem 8: personal information inside free text.

Candidates come by form: e-mails, phones, numbers a state gives, addresses, runs of words that may name a person. What
a candidate's surroundings and its own terms disclose is estimated from co-occurrence with sure persons and sure phones
over the whole corpus (``disclosure``): one pass over the texts counts, a second one finds. Names are taken where a title or
sign-off makes them sure, where their context discloses a person, or where they begin or end with a disclosing term.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaykit.llm.disclosure import ENDS, PARTICLES, TITLES, Text, number_keys, person_keys, runs, seeded, term
from assaykit.plans.runtime import cut_lineage

#: Most words of a name, particles and initials included.
MOST_WORDS = 6

# --- e-mail -----------------------------------------------------------------------------------------------------
_LOCAL = r"[A-Za-z0-9](?:[A-Za-z0-9._%+'-]*[A-Za-z0-9_+])?"
_PARTICLE_LOCAL = r"(?:\b[A-Za-z]+[._](?i:el|ben|al|bin|abu|van|von|de|der|den|di|da|del|la|le|ter|ten|mac|st)(?: (?i:de|der|den|la|el))? )?"
_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
_AT = r"(?:\s?@\s?|\s?[(\[{<]\s?(?:at|@|ät)\s?[)\]}>]\s?| at | AT | ät )"
_DOT = r"(?:\.|\s?[(\[{]\s?(?:dot|punkt|punto|\.)\s?[)\]}]\s?| dot | DOT | punkt | punto )"
EMAIL = re.compile(rf"(?<![\w.@+-]){_PARTICLE_LOCAL}{_LOCAL}{_AT}{_LABEL}(?:{_DOT}{_LABEL})*{_DOT}[A-Za-z]{{2,}}(?![\w@])")

# --- phone ------------------------------------------------------------------------------------------------------
_PHONE_FORMS = (
    r"\+\d{1,3}[ .-]?\(0\)[ .-]?\d{1,5}(?:[ ./-]\d{2,6}){1,4}",
    r"\+\d{1,3}(?:[ .-]\(?\d{1,5}\)?){1,6}",
    r"\+\d{9,14}",
    r"[689]\d{2} \d{2} \d{2} \d{2}",
    r"00[ -]?\d{2}(?:[ -]\d{1,9}){1,5}",
    r"\(\d{3,4}\) ?\d{3}[ .-]\d{4}",
    r"\(0\d{2,4}\) ?\d{6,8}",
    r"1-\d{3}-\d{3}-\d{4}",
    r"\d{3}[.-]\d{3}[.-]\d{4}",
    r"0\d{2,4} \d{3,4} \d{3,4}",
    r"0\d{2,4}/\d{4,8}(?:-\d{1,5})?",
    r"0\d{2,3}-\d{7,8}",
    r"(?<![\d.])[689]\d{2}[ .-]?\d{3}[ .-]?\d{3}",
    r"1[03-9]\d{9}",
)
PHONE = re.compile(r"(?<![\w.,/+-])(?:" + "|".join(f if f.startswith("\\+") else rf"(?<!\d )(?:{f})" for f in _PHONE_FORMS) + r")(?![\w]|[.,/-]\d)")
#: Where a phone may stand: figures with what parts them; each match of ``PHONE`` lies within one.
_FIGURES = re.compile(r"[+(]{0,2}\d[\d ./()-]{5,}\d")


def phones(text: str) -> Iterator[re.Match]:
    """Matches of ``PHONE``, sought where figures stand only."""
    for m in _FIGURES.finditer(text):
        yield from PHONE.finditer(text, m.start(), min(len(text), m.end() + 2))


#: What may stand between a word and the number it names: no sentence end, bracket or line break.
_TO_NUMBER = r"[ \t\u00a0\u3000:：#]*$"
#: Left end of a Latin word; Han characters may stand before it.
_LATIN_START = r"(?<![A-Za-zÀ-ÖØ-öø-ɏ])"
#: Words after which a number is a number of something else. German nouns end compounds; EN and PO are labels in capitals only, abbreviations may have a full stop.
_NOT_PHONE = re.compile(
    rf"(?i)(?:{_LATIN_START}(?:drawing|plano|serial|serie|account|cuenta|invoice|factura|lot|lote|charge|batch|order|(?-i:PO)|pedido|contract|contrato|(?:bar|post|zip|stoff|waren|zoll)?code|substance|stoff|tanker|firmware|version|article|artikel|"
    r"part|item|norm|standard|(?-i:EN)|iso|din|cas|heat|number|(?:no|num|ref)\.?|reference|steuer-id|ssn|dni|nie|passport|pasaporte|reisepass|licen[cs]e|[^\W\d_]*(?:nummer|nr\.?|zeichnung|rechnung|bestellung|vertrag|ausweis|konto))|"
    rf"图纸编号|编号|发票号|合同|订单|批号|身份证号?|证件号码|护照号?|账号|型号){_TO_NUMBER}"
)
#: Words that make a number a phone although "number" follows them.
_SURE_PHONE = re.compile(
    rf"(?i){_LATIN_START}(?:(?:tele)?phone|[^\W\d_]*telefon|tel|fax|telefax|mobile|cell|contact|whatsapp|switchboard|hotline|(?:rück|not|an)?ruf|handy|mobil|mobilfunk|festnetz|durchwahl|teléfono|móvil)\.?[ -]?(?:number|nummer|nr|no|num)\.?{_TO_NUMBER}"
)

# --- numbers a state gives ----------------------------------------------------------------------------------------
_ID_LABEL = (
    r"(?:SSN|social security (?:number|no\.?)|passport(?: (?:no\.?|number))?|ID card(?: (?:no\.?|number))?|identity card(?: (?:no\.?|number))?|national (?:ID|insurance)(?: (?:no\.?|number))?|NI (?:number|no\.?)|NINO|driving licen[cs]e(?: (?:no\.?|number))?|driver'?s? licen[cs]e(?: (?:no\.?|number))?|"
    r"Personalausweis(?:nummer|-Nr\.?)?|Reisepass(?:nummer|-Nr\.?)?|Steuer-?ID(?:-Nr\.?)?|Steuernummer|Steuer-Identifikationsnummer|Sozialversicherungsnummer|SV-Nummer|Rentenversicherungsnummer|Führerschein(?:nummer)?|Ausweis(?:nummer|-Nr\.?)?|"
    r"DNI|NIE|NIF|pasaporte|número de la seguridad social|seguridad social|NUSS|permiso de conducir|carn[ée] de conducir|"
    r"身份证号码?|身份证|证件号码|护照号码?|护照|社保号码?|社会保障号码?|驾驶证号?)"
)
_ID_VALUE = r"(?:\d{17}[\dXx]|\d{3}[- ]\d{2}[- ]\d{4}|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]|[A-Z]{2}-\d{3}-\d{5}|[A-Z]\d{3}-\d{4}-\d{4}|\d{2} \d{3} \d{3} \d{3}|\d{2}\.\d{3}\.\d{3}-?[A-Z]|\d{8}-?[A-Z]|[XYZ]-?\d{7}-?[A-Z]|\d{2} ?\d{6} ?[A-Z] ?\d{3}|\d{2}[/ ]\d{8}[/ ]\d{2}|[A-Z]{1,3}\d{6,9}|[A-Z]\d{2,3}[A-Z]\d{4,5}|[A-Z][A-Z0-9]{7,9}|\d{8,12})"
ID_NUMBER = re.compile(rf"(?:\b|(?<=[^\x00-\x7f])){_ID_LABEL}\s*(?:no\.?|Nr\.?|号码?)?\s*[:：]?\s*({_ID_VALUE})(?![\w])", re.I)
ID_ALONE = re.compile(r"(?<![\w.-])\d{17}[\dXx](?![\w])")

# --- postal address -----------------------------------------------------------------------------------------------
_CAP = r"[A-ZÀ-ÖØ-Þ][\w'’À-ÿ-]*"
_TOWN = rf"{_CAP}(?: (?:am|an der|ob der|im|upon|on|de|del|la|las|los) {_CAP}| {_CAP})?"
_PLACE = rf"(?:,\s(?:\d{{4,6}}\s{_TOWN}|{_TOWN}\s\d{{4,6}}\b|{_TOWN}(?![\w'’]| {_CAP})))"
_STREETNAME = rf"(?:{_CAP}|\d+(?:st|nd|rd|th))(?: {_CAP}){{0,2}}"
_KIND = r"(?:Street|Road|Lane|Avenue|Drive|Way|Court|Square|Boulevard|Terrace|Close|Place|St\.|Rd\.|Ave\.)"
_EN = rf"(?:(?:Unit|Suite|Flat|Apt\.?) \d+[a-z]?, )?\d+[a-z]? {_STREETNAME} {_KIND}(?:, (?:Unit|Suite|Flat|Apt\.?) \d+[a-z]?)?"
_BOX = r"(?:P\.\s?O\. ?Box|PO Box|Post(?:al)? Box|Postfach|Apartado(?: de correos)?|Apdo\.?) \d[\d ]*\d|(?:P\.\s?O\. ?Box|PO Box|Postfach|Apartado(?: de correos)?|Apdo\.?) \d+"
_DE = rf"(?:(?:Am|An der|Im|In der|Auf der|Zum|Zur|Alte|Neue|Hinter der|Unter den) (?!Jahr|Quartal|Monat|Werk|Lauf|Schnitt|Mittel|Einsatz|Export){_CAP}(?: {_CAP})?|(?:{_CAP} ){{0,2}}{_CAP}(?:straße|strasse|str\.|weg|gasse|allee|platz|ring|damm|ufer|hof|steig)|{_CAP}(?:[ -]{_CAP})?[ -](?:Straße|Str\.|Weg|Gasse|Allee|Platz|Ring)) \d+ ?[a-z]?(?![\w])"
_ES = rf"(?:Calle|C/|Avda\.|Avenida|Paseo|Plaza|Camino|Carretera|Ctra\.|Ronda|Travesía) ?{_CAP}(?: (?:de|del|la|las|los|{_CAP})){{0,3}},? (?:n\.?º ?)?\d+[a-z]?(?:, \d+º ?[A-Z]?)?|Pol(?:í|i)gono(?: Industrial)? {_CAP}(?: {_CAP}){{0,2}}, (?:parcela|nave) \d+"
ADDRESS = re.compile(rf"(?<![\w])(?:{_EN}|{_BOX}|{_DE}|{_ES}){_PLACE}?")
ADDRESS_ZH = re.compile(r"(?:(?:邮编)?\d{6}\s?)?[一-鿿]{2,4}?(?:省[一-鿿]{2,4}?)?市(?:[一-鿿]{1,4}[区县])?[一-鿿]{1,6}?(?:大道|路|街|巷)\d+号(?:[一-鿿]?\d+[室楼栋单元座层]+)*|[一-鿿]{2,4}?市?(?:邮政)?信箱\d+号?(?:，?邮编\d{6})?")
_ZH_LEAD = re.compile(r"^[^市]*(?:寄|往|至|到|位于|址[:：为是]?|点[:：]?在|在|于|[:：])(?=[一-鿿]+市)")

# --- persons ------------------------------------------------------------------------------------------------------
ZH_NAMES = [re.compile(x) for x in (
    r"(?P<n>[一-鿿]{2,4})(?:先生|女士|小姐|博士|教授|总工|工程师)(?=确认|来电|签|要求|负责|通话|表示|说|[，。])",
    r"已与(?P<n>[一-鿿]{2,4}?)(?:先生|女士|小姐|博士)?(?:通话|会面|沟通|见面)",
    r"(?:联系人|负责人|厂长|经办人|签字人|法人|法定代表人|收件人)(?:为|是|[:：])\s?(?P<n>[一-鿿]{2,4}?)(?:先生|女士|博士)?(?=[。，；\s（(]|$)",
    r"股东(?:为|是|[:：])(?P<n>[一-鿿]{2,4}?)(?=[。，；、\s（(和]|$)",
    r"报告由(?P<n>[一-鿿]{2,4}?)(?:先生|女士|博士)?(?:签字|签署|审核|编写)",
    r"现场由(?P<n>[一-鿿]{2,4}?)(?:先生|女士)?(?:负责|接待|陪同)",
    r"(?:采购经理|采购员|销售经理|总经理|厂长|经理|工程师|主任)(?P<n>[一-鿿]{2,3}?)(?=要求|确认|表示|来电|签字|负责|说|认为|将)",
)]
_ZH_FRONT = re.compile(r"^(?:与|由|和|为|是|据|请|向|已与)(?=[一-鿿]{2})")
#: Words that cannot be part of a person's name, as streets, firms, trades and forms carry them.
_NO_NAME = frozenset(
    "street road lane avenue drive way court square boulevard terrace close place box unit the a an and or of for in on at to by with from is are was der die das und oder von mit für bei im am el la los las un una del y o con para por se en "
    "gmbh ag ltd limited inc llc co company corp group kg srl spa ab as oy bv industries minerals ceramics metallurgy furnaces kilns foundry castings steelworks steel refractories logistics technologies engineering trading chemicals materials cement limestone alloys insulation glassworks abrasives aluminium nonferrous "
    "process quarry mill plant kiln type saint san santa st typ tipo ofentyp for file update short site open still noted before we he she they it no three demand storage nothing according samples tests wear slag since until cold buyers stocks campaign drying maintenance deliveries commercial thermal typical order sieve inspection both its what".split()
)
_HAN = re.compile(r"[一-鿿]")


#: What a text must hold for the costlier patterns to be tried.
_AT_SIGN = re.compile(r"@|[(\[{<]\s?(?:at|ät)\s?[)\]}>]| (?:at|AT|ät) [A-Za-z0-9][\w-]*(?:\.\w|\s?[(\[{]|\s(?:dot|DOT|punkt|punto)\b)")
#: Casefolded, for the labels ignore case; one for every alternative of ``_ID_LABEL``.
_ID_WORDS = (
    "ssn", "social security", "passport", "id card", "identity card", "national i", "ni n", "nino", "driving licen", "licence", "license", "ausweis", "reisepass", "steuer", "versicherungsnummer", "sv-nummer", "führerschein",
    "dni", "nie", "nif", "pasaporte", "seguridad social", "nuss", "permiso de conducir", "carne de conducir", "carné de conducir", "身份证", "证件号码", "护照", "社保号", "社会保障号", "驾驶证",
)
_STREET_WORDS = (
    "Street", "Road", "Lane", "Avenue", "Drive", "Way", "Court", "Square", "Boulevard", "Terrace", "Close", "Place", "St.", "Rd.", "Ave.", "Box", "Postfach", "Apartado", "Apdo", "straße", "strasse", "str.", "Straße", "Str.", "weg ", "gasse ", "allee ", "platz ",
    "ring ", "damm ", "ufer ", "hof ", "steig ", "Weg ", "Gasse ", "Allee ", "Platz ", "Ring ", "Am ", "An der ", "Im ", "In der ", "Auf der ", "Zum ", "Zur ", "Alte ", "Neue ", "Hinter der ", "Unter den ", "Calle", "C/", "Avda", "Avenida", "Paseo", "Plaza",
    "Camino", "Carretera", "Ctra", "Ronda", "Travesía", "Polígono", "Poligono",
)


#: Tokens at which a context ends, or begins as at the start of a sentence.
_BREAKS = ENDS | {"\n", ")"}


def _overlaps(a: int, b: int, taken: list[tuple[int, int]]) -> bool:
    return any(a < y and x < b for x, y in taken)


def _plausible(words: list[str]) -> bool:
    """Words of a name: none of those that belong to streets, firms or running text, and one longer than an initial."""
    low = [term(x) for x in words]
    return 0 < len(low) <= MOST_WORDS and not any(x in _NO_NAME and x not in PARTICLES for x in low) and low[0] not in PARTICLES - {"el", "ben", "van", "von", "de"} and any(len(x) > 1 for x in low)


@dataclass
class Model:
    """What the corpus discloses: contexts and terms of persons, contexts of numbers that are no phones."""

    pair: frozenset[str] = frozenset()
    left: frozenset[str] = frozenset()
    right: frozenset[str] = frozenset()
    first: frozenset[str] = frozenset()
    last: frozenset[str] = frozenset()
    number: frozenset[str] = frozenset()
    triggers: frozenset[str] = field(init=False)
    after: frozenset[str] = field(init=False)

    def __post_init__(self) -> None:
        pairs = [x.split("|", 1) for x in self.pair]
        self.triggers = frozenset(x.rsplit(" ", 1)[-1] for x in [*self.left, *(p[0] for p in pairs)]) | TITLES | ENDS | {")", "—", "–", "\n"}
        self.after = frozenset(x.split(" ", 1)[0] for x in [*self.right, *(p[1] for p in pairs)])


def find_fixed(text: str, against: frozenset[str] = frozenset(), t: Text | None = None) -> list[tuple[int, int, str]]:
    """Spans found by form and label: e-mail, id_number, address, phone; earlier kinds win where spans meet.

    ``against`` holds left contexts of numbers that are no phones, as the corpus tells; a dialling code or a label outweighs it.
    """
    out: list[tuple[int, int, str]] = []
    taken: list[tuple[int, int]] = []

    def take(a: int, b: int, kind: str) -> None:
        if not _overlaps(a, b, taken):
            taken.append((a, b))
            out.append((a, b, kind))

    if _AT_SIGN.search(text):
        for m in EMAIL.finditer(text):
            take(m.start(), m.end(), "email")
    folded = text.casefold().replace("i\u0307", "i").replace("ı", "i")  # as the pattern takes dotted and dotless i for one
    if any(w in folded for w in _ID_WORDS):
        for m in ID_NUMBER.finditer(text):
            if any(c.isdigit() for c in m[1]):
                take(m.start(1), m.end(1), "id_number")
    for m in ID_ALONE.finditer(text):
        take(m.start(), m.end(), "id_number")
    if any(w in text for w in _STREET_WORDS):
        for m in ADDRESS.finditer(text):
            take(m.start(), m.end(), "address")
    if "市" in text or "信箱" in text:
        for m in ADDRESS_ZH.finditer(text):
            a = m.start()
            if lead := _ZH_LEAD.match(text[a : m.end()]):
                a += lead.end()
            take(a, m.end(), "address")
    for m in phones(text):
        if _overlaps(m.start(), m.end(), taken):
            continue
        before = text[max(0, m.start() - 30) : m.start()]
        labelled = bool(_SURE_PHONE.search(before))
        sure = labelled or m[0][0] == "+" or m[0].startswith("00")
        if _NOT_PHONE.search(before) and not labelled:
            sure = None
        if sure is None or not sure and against and (t := t or Text(text)).left_of(m.start()) in against:
            continue
        take(m.start(), m.end(), "phone")
    return out


def _inverted(t: Text, i: int, j: int) -> int | None:
    """End of a name whose surname stands first, with a comma behind it: the run ``i`` to ``j`` is the surname."""
    n = len(t.tokens)
    if j + 1 >= n or t.tokens[j] != "," or t.start[j + 1] != t.end(j) + 1 or not t.tokens[j + 1][0].isupper() or t.low[j + 1] in TITLES:
        return None
    k = j + 2
    if k < n and re.fullmatch(r"[^\W\d_]\.?", t.tokens[k]) and t.tokens[k][0].isupper() and t.start[k] == t.end(k - 1) + 1:
        k += 2 if len(t.tokens[k]) == 1 and k + 1 < n and t.tokens[k + 1] == "." else 1
    return k


def _spoken(words: list[str], inverted: bool) -> tuple[str, str]:
    """First and last term of a name; a surname that stands first counts as the last."""
    if inverted:
        k = words.index(",")
        return term(words[k + 1]), term(words[k - 1])
    w = [x for x in map(term, words) if x]
    w = [x for x in w if len(x) > 1] or w
    return w[0], w[-1]


def candidates(t: Text, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int, bool, bool]]:
    """``(from, to, inverted, whole)`` token ranges that may name a person: each run, its tails of two words and more, inverted names."""
    for i, j in runs(t):
        if _overlaps(t.start[i], t.end(j - 1), taken):
            continue
        if j == i + 1 and (t.low[i] in _NO_NAME or len(t.low[i]) < 3) and t.tokens[j : j + 1] != [","]:
            continue
        for k in range(i, j):
            if k == i or t.low[k] not in PARTICLES:
                # A tail of one word, or one that begins with an initial, is a name only right behind the word that begins a sentence.
                if k == i or k == i + 1 or j - k > 1 and len(term(t.tokens[k])) > 1:
                    turned = _inverted(t, k, j) if j - k <= 3 else None
                    if turned and _plausible([x for x in t.tokens[k:turned] if x not in ",."]) and not _overlaps(t.start[k], t.end(turned - 1), taken):
                        yield k, turned, True, True
                if (k == i or j - k > 1 and (k == i + 1 or len(term(t.tokens[k])) > 1)) and _plausible(t.tokens[k:j]):
                    yield k, j, False, k == i


def find_names(t: Text, taken: list[tuple[int, int]], model: Model) -> list[tuple[int, int]]:
    """Spans of names: sure ones, those in a context and those with a term that the model knows."""
    found: list[tuple[int, int]] = []

    def take(i: int, j: int) -> None:
        a, b = t.start[i], t.end(j - 1)
        if t.tokens[j - 1] == ".":
            pass
        elif j < len(t.tokens) and t.tokens[j] == "." and len(t.tokens[j - 1]) == 1 and t.start[j] == b:
            b += 1  # an initial at the end
        if not _overlaps(a, b, taken) and not _overlaps(a, b, found):
            found.append((a, b))

    every = []
    for i, j, inverted, whole in candidates(t, taken):
        before, after = t.low[i - 1] if i else "\n", t.low[j] if j < len(t.low) else "."
        side = before not in _BREAKS and before in model.triggers
        ahead = ("." if after in _BREAKS else after) in model.after
        left, right = (t.left(i), t.right(j)) if side or ahead else ("", "")
        known = side and left in model.left or ahead and f"{left}|{right}" in model.pair
        many = inverted or j - i > 1 and sum(1 for x in t.tokens[i:j] if x[0].isupper()) > 1
        context = known and (f"{left}|{right}" in model.pair or whole or many) or ahead and whole and right in model.right
        if context or many or whole and seeded(t, i):
            every.append((not known, not inverted, i, -j, whole, many, context))
    for _, straight, i, j, whole, many, context in sorted(every):
        first, last = _spoken(t.tokens[i:-j], not straight)
        if not straight:
            if first in model.first and (context or seeded(t, i) or last in model.last or last not in model.first):
                take(i, -j)
        elif context or whole and seeded(t, i) or many and (first in model.first or last in model.last and len(term(t.tokens[i])) == 1):
            take(i, -j)
    # Names in small letters stand in contexts only.
    n = len(t.tokens)
    for i, (word, before) in enumerate(zip(t.tokens, ["\n", *t.low])):
        if before not in model.triggers or not word[0].islower():
            continue
        left, sure = None, seeded(t, i)
        for j in range(i + 1, min(i + 5, n) + 1):
            if j > i + 1 and (t.start[j - 1] != t.end(j - 2) + 1 or not t.tokens[j - 1][0].isalpha()):
                break
            if j < n and t.low[j] not in model.after and t.low[j] not in (".", ",", "\n", "("):
                continue
            left = t.left(i) if left is None else left
            right = t.right(j)
            if (f"{left}|{right}" in model.pair or sure and right[0] in ".,(" or left in model.left and (right in model.right or right[0] in ".,(")) and _plausible(t.tokens[i:j]) and (j - i > 1 or before in TITLES):
                take(i, j)
                break
    if _HAN.search(t.text):
        for p in ZH_NAMES:
            for m in p.finditer(t.text):
                a, b = m.span("n")
                while b - a > 2 and (lead := _ZH_FRONT.match(t.text[a:b])):
                    a += lead.end()
                if not _overlaps(a, b, taken) and not _overlaps(a, b, found):
                    found.append((a, b))
    return found


_STATS_DDL = "kind string, left string, right string, first string, last string, sure boolean, n bigint"
_STATS_ARROW = pa.schema([("kind", pa.string()), ("left", pa.string()), ("right", pa.string()), ("first", pa.string()), ("last", pa.string()), ("sure", pa.bool_()), ("n", pa.int64())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, schema)], schema=schema)


def counted(docs: DataFrame, text: str = "text") -> DataFrame:
    """Contexts and terms of all candidates with counts, combined by batch: ``kind`` 'name' or 'number'."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for s in batch.column(0).to_pylist():
                if not s:
                    continue
                t = Text(s)
                for m in phones(s):
                    seen["number", t.left_of(m.start()), None, None, None, m[0][0] == "+" or m[0].startswith("00")] += 1
                for i, j, inverted, whole in candidates(t, []):
                    seen["name", t.left(i), t.right(j), *_spoken(t.tokens[i:j], inverted), whole and seeded(t, i)] += 1
            yield _batch([(*k, n) for k, n in seen.items()], _STATS_ARROW)

    return docs.select(text).mapInArrow(run, _STATS_DDL).groupBy("kind", "left", "right", "first", "last", "sure").agg(F.sum("n").alias("n"))


def learned_model(docs: DataFrame, text: str = "text") -> Model:
    """The model of a corpus. Its keys hold a fixed least share of all entities each, so the driver gets a bounded number."""
    stats = cut_lineage(counted(docs, text))
    names = person_keys(stats.filter("kind = 'name'").drop("kind"))
    got: dict[str, set[str]] = {}
    for r in names.select("kind", "key").unionByName(number_keys(stats.filter("kind = 'number'")).select(F.lit("number").alias("kind"), "key")).toLocalIterator():
        got.setdefault(r["kind"], set()).add(r["key"])
    return Model(**{k: frozenset(v) for k, v in got.items()})


_FOUND_DDL = "doc_id bigint, kind string, a int, b int, found string"
_FOUND_ARROW = pa.schema([("doc_id", pa.int64()), ("kind", pa.string()), ("a", pa.int32()), ("b", pa.int32()), ("found", pa.string())])


def personal_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, kind, a, b, found``: every span of personal information (``a`` and ``b`` count characters from 0).

    Null and empty texts have none. Kinds: email, phone, id_number, address, name. Repeats within a text are kept here.
    """
    model = learned_model(docs, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not s:
                    continue
                t = Text(s)
                fixed = find_fixed(s, model.number, t)
                taken = [(a, b) for a, b, _ in fixed]
                spans = fixed + [(a, b, "name") for a, b in find_names(t, taken, model)]
                rows.extend((doc, kind, a, b, s[a:b]) for a, b, kind in spans)
            yield _batch(rows, _FOUND_ARROW)

    return docs.select(F.col(key).cast("bigint").alias("doc_id"), text).mapInArrow(run, _FOUND_DDL)


def personal_values(spans: DataFrame) -> DataFrame:
    """``doc_id, kind, found`` without repeats."""
    return spans.select("doc_id", "kind", "found").distinct()


def redacted(docs: DataFrame, spans: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, text``: all texts with each span replaced by its kind as placeholder, e.g. ``[EMAIL]``; all else unchanged.

    Texts without spans, null and empty texts come out as they are. Spans are gathered per document only.
    """

    @F.pandas_udf("string")
    def replace(t: pd.Series, found: pd.Series) -> pd.Series:
        def one(s, spans_):
            if s is None or spans_ is None:
                return s
            out, at = [], 0
            for x in sorted(spans_, key=lambda x: (x["a"], -x["b"])):
                if x["a"] >= at:
                    out += [s[at : x["a"]], f"[{x['kind'].upper()}]"]
                    at = x["b"]
            return "".join(out) + s[at:]

        return pd.Series([one(s, f) for s, f in zip(t, found)], dtype="object")

    per = spans.groupBy("doc_id").agg(F.collect_list(F.struct("a", "b", "kind")).alias("_spans"))
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text")).join(per, "doc_id", "left")
    return rows.select("doc_id", replace("text", "_spans").alias("text"))
