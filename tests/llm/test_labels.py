"""Labels around numbers: which make a number a phone, an id_number or neither."""

import pytest

from assaykit.llm import personal_data as pd8


def found(text):
    return {(kind, text[a:b]) for a, b, kind in pd8.find_fixed(text)}


@pytest.mark.parametrize(
    "text,number",
    [
        ("visitó la nave con el turno. (+34 900 000 727, tardes)", "+34 900 000 727"),
        ("12 percent on the coarse screen. +91 00000 25671 is the desk.", "+91 00000 25671"),
        ("Regards,\nTomasz Stagasen\n+44 (0)20-7946-0304", "+44 (0)20-7946-0304"),
        ("The slot may stand in between.\n202.555.0112", "202.555.0112"),
        ("phone number: +1 202 555 0120", "+1 202 555 0120"),
        ("Phone no. 202-555-0119", "202-555-0119"),
        ("Telefonnummer: 030/23125-424", "030/23125-424"),
        ("Rufnummer 030/23125-424", "030/23125-424"),
        ("Tel. no. +44 20 7946 0747", "+44 20 7946 0747"),
        ("Tel.-Nr. 030/23125-424", "030/23125-424"),
    ],
)
def test_phones_kept(text, number):
    assert found(text) == {("phone", number)}


@pytest.mark.parametrize(
    "text",
    ["Drawing 202-317-1199 rev. C", "Drawing No.: 202-317-1199", "Serial # 857.489.5864", "Zeichnung 030/85229-561", "Auftragsnummer: 030/85229-561", "Bestell-Nr. 030/85229-561", "ref. 202-317-1199", "图纸编号：202-317-1199", "PO 202-317-1199", "EN 202-317-1199"],
)
def test_other_numbers_left(text):
    assert found(text) == set()


LABELS = (
    "SSN|social security number|social security no.|passport|passport no.|passport number|ID card|ID card no.|ID card number|identity card|identity card no.|identity card number|national ID|national ID no.|national insurance|national insurance number|NI number|NI no.|NINO|"
    "driving licence|driving license no.|driver's licence|drivers license number|driver license|Personalausweis|Personalausweisnummer|Personalausweis-Nr.|Reisepass|Reisepassnummer|Reisepass-Nr.|Steuer-ID|SteuerID|Steuer-ID-Nr.|Steuernummer|Steuer-Identifikationsnummer|"
    "Sozialversicherungsnummer|SV-Nummer|Rentenversicherungsnummer|Führerschein|Führerscheinnummer|Ausweis|Ausweisnummer|Ausweis-Nr.|DNI|NIE|NIF|pasaporte|número de la seguridad social|seguridad social|NUSS|permiso de conducir|carne de conducir|carné de conducir|"
    "身份证|身份证号|身份证号码|证件号码|护照|护照号|社保号|社保号码|社会保障号码|驾驶证|驾驶证号"
).split("|")


@pytest.mark.parametrize("write", [str, str.upper, str.lower, str.capitalize, str.title])
def test_each_label_leads_to_a_find(write):
    for label in LABELS:
        text = f"{write(label)}: AB1234567"
        assert pd8.ID_NUMBER.search(text), text
        assert ("id_number", "AB1234567") in found(text), text


def test_dotted_capital_i():
    assert found("NİNO: AB1234567") == {("id_number", "AB1234567")}
