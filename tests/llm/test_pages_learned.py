"""What the corpus adds to the lists: furniture without known wording by the cut, messages by mined templates."""

import random

import pytest

from assaykit.llm import page_body as pb
from assaykit.llm.line_model import LineModel, logistic
from assaykit.llm.residue import is_bad_title, is_message

GOODS = ("Quartz Meal", "Basalt Wool", "Lime Putty", "Clay Pipe", "Iron Oxide")


def pack(rng, bundle):
    """A page with a site's frame; its motto and the headings of its boxes stand in no list."""
    site = f"Site{bundle} Works"
    body = [f"{rng.choice(GOODS)} comes by lorry and stays dry under roof of hall {rng.randrange(90)}, as works manuals say." for _ in range(rng.randrange(3, 6))]
    body[1:1] = [f"Range of {site}: two kinds are held in stock at all times, both in bags.", rng.choice(GOODS)] if bundle % 3 else []
    box = ["Folks also looked at", *rng.sample(GOODS, 2), "Back to top"]
    lines = ["Home | Products | News | Contact", f"{site}: Fire is our friend", "", "## Facts in figures", *body[:4], "", *box, "", "Facts in figures" if bundle % 2 else "## Facts in figures", *body[4:], "", f"© 20{rng.randrange(10, 25)} {site}. All rights reserved.", "Privacy | Terms"]
    return f"Company: {site}\n\n## S1\nURL: https://s{bundle}.test/\nTitle: T\n" + "\n".join(lines)


def wrong(texts, models, edges=True):
    n, unseen = 0, 0
    for text in texts:
        for _, company, lines in pb.sections(text):
            rows = pb.labelled(lines, company, models) if edges else [(no, line, models.cost(line, p), models.cost(line, p) >= 0) for (no, line, _), p in zip(*pb.placed(lines, company))]
            table = False
            for _, line, _, content in rows:
                table = line.startswith("Range") or table and line in GOODS
                furniture = line in GOODS and not table or line == "Folks also looked at" or "Fire is" in line or line.startswith(("Home |", "©", "Privacy", "Back"))
                n += content == furniture
                unseen += line in GOODS
    return n, unseen


def test_the_cut_finds_what_no_list_holds(monkeypatch):
    rng = random.Random(4)
    texts = [pack(rng, i) for i in range(60)]
    model = pb.fitted(texts)[0]
    n, boxes = wrong(texts, model)
    assert boxes == 160 and n <= 8
    for name in ("SAME", "LEADS", "OTHER", "BLOCK"):
        monkeypatch.setattr(pb, name, 0.0)
    assert wrong(texts, pb.fitted(texts)[0], False)[0] > 5 * max(n, 1)


def test_models_of_nothing():
    assert logistic([], __import__("numpy").zeros(0)) == {} and pb.fitted([])[0].weights == {}
    assert pb.labelled([], "", LineModel()) == [] and [r[3] for r in pb.labelled([(1, "| a | b | c |")], "")] == [True]


UNKNOWN = [f"{a} cannot be displayed: {b} {c} {d}." for a in ("the shop", "our shop") for b in ("activate", "permit") for c in ("JavaScript", "scripting") for d in ("first", "in your browser")]


def test_messages_by_template(spark):
    rng = random.Random(6)
    good = [(i, pack(rng, i)) for i in range(60)]
    known = [f"Sorry, {a} will not work without {c} {d}." for a in ("the shop", "our shop") for c in ("JavaScript", "scripting") for d in ("in your browser", "and a reload")] + [f"Please {b} {c} first." for b in ("enable", "activate") for c in ("JavaScript", "scripts")]
    known += ["404 Not Found", "Please activate JavaScript in your browser.", "Page not found"]
    bad = [(100 + i, f"Company: X\n\n## S1\nHome | Products | News | Contact\n\n{m}\n\nPrivacy | Terms") for i, m in enumerate(known * 3 + UNKNOWN)]
    assert not any(map(is_message, UNKNOWN)) and all(map(is_message, known))
    parts = pb.parsed(spark.createDataFrame(good + bad, "bundle_id bigint, text string")).cache()
    messages = pb.message_templates(pb.section_units(parts)).cache()
    assert sorted(r["bundle_id"] for r in pb.residue_sections(parts, messages).collect()) == [100 + i for i in range(len(bad))]
    assert messages.filter("template is not null").count() > 0
    titles = spark.createDataFrame([(1, "Acme | the shop cannot be displayed: permit JavaScript first"), (2, "Acme | Clay Pipe"), (3, None), (4, "404 Not Found")], "source_row bigint, title string")
    assert not is_bad_title("the shop cannot be displayed: permit JavaScript first")
    assert sorted(r["row_id"] for r in pb.residue_titles(titles, "source_row", "title", messages).collect()) == [1, 4]
    assert sorted(r["row_id"] for r in pb.residue_titles(titles, "source_row", "title").collect()) == [4]


@pytest.mark.parametrize("line,leaf", [("Ray 12", "1|ray"), ("", "0|"), ("word " * 50, "long")])
def test_leaves(line, leaf):
    assert pb.leaf_of(line)[0] == leaf
