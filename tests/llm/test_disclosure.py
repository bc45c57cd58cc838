"""Names that only the corpus gives away: by contexts and terms learned from co-occurrence."""

import pytest

from assaykit.llm import disclosure as dc
from assaykit.llm import personal_data as pd8

FIRST = ("Halina", "Bogdan", "Fenna", "Kofi", "Mirela")


def corpus():
    rows = [(i, f"Mr. {FIRST[i % 5]} Fano{c} called. Spoke with {FIRST[i % 5]} Trebo{c} about the lining. The kiln in Puerto Lindal runs. Storage is dry.") for i, c in enumerate("abcdefghij")]
    rows += [(100 + i, f"Kiln type {FIRST[i]} {i} burns gas.") for i in range(5)]
    rows += [(110 + i, f"Andalusite Grain is dry. Ball Clay sells in Oberwald. Home scrap makes up {i} percent. Tests went on.") for i in range(50)]
    return rows


FOUND = {
    200: ("Spoke with olga bremund about the lining.", {"olga bremund"}),  # small letters, a context of persons only
    201: ("Spoke with Ulf O'Trant about the lining.", {"Ulf O'Trant"}),  # no term of it is known
    202: ("Gestern kam Kofi Anselm zur Schicht.", {"Kofi Anselm"}),  # a known first name elsewhere
    203: ("Spoke with Anselm, Mirela about the lining.", {"Anselm, Mirela"}),
    204: ("Kiln type Mirela 77 burns gas.", set()),  # a machine of that name
    205: ("Spoke with the guard about the lining.", set()),
    206: ("Write to Kofi.Anselm@mail.test or call.", set()),
}


def test_names_no_phrase_list_holds(spark):
    df = spark.createDataFrame([*corpus(), *((k, t) for k, (t, _) in FOUND.items()), (300, None), (301, "")], "doc_id bigint, text string")
    got = {}
    for r in pd8.personal_values(pd8.personal_spans(df)).filter("doc_id >= 200 and kind = 'name'").collect():
        got.setdefault(r["doc_id"], set()).add(r["found"])
    assert got == {k: v for k, (_, v) in FOUND.items() if v}


def test_without_a_model_only_sure_names():
    t = dc.Text(FOUND[201][0] + " Dr. Anna Bo signed.")
    assert [t.text[a:b] for a, b in pd8.find_names(t, [], pd8.Model())] == ["Anna Bo"]


def test_numbers_in_contexts_without_phones(spark):
    rows = [(i, f"Ring {'+44 20 7946 0' + str(100 + i) if i % 2 else '020 7946 0' + str(100 + i)} before noon. Casting 202-317-{1000 + i} was stamped.") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {(r["kind"], r["found"]) for r in pd8.personal_values(pd8.personal_spans(df)).collect()}
    assert len(got) == 40 and all(k == "phone" and "317" not in f for k, f in got)


@pytest.mark.parametrize("text,i,left", [("Ann", 0, "<s>"), ("One. Ann", 2, "<s>"), ("Update 12: Ann", 3, "update 0 :"), ("regards,\nAnn", 3, "regards , \n <s>"), ("end\nAnn", 2, "<s>"), ("cc Dr. Ann", 2, "dr.")])
def test_left_contexts(text, i, left):
    t = dc.Text(text)
    assert t.tokens[i] == "Ann" and t.left(i).replace("<s> ", "") == left.replace(" <s>", "")
