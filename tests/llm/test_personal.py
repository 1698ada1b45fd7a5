from collections import Counter

import pytest

from loregraph.llm import personal as P

SURNAMES = "vouslounnas klintholhoul prurklurlein wheintounvein glosvreinbros tongolchul fisgokel plenchasjon gemurveir droulzharvrer whelgrekrol zhardritoun pesgrousthan kreisplenkril".split()
WORDS = "the board shipped weekly import queue reach write to call mark all links grace periods of days are stable invoice ticket order next step is send numbers main street sentiment works on runway capital project lunch with and founders at moved home address met in new number per talked about dear best under".split()


@pytest.fixture(scope="module")
def finder():
    return P.Finder(P.SurnameModel(SURNAMES, ["glulutrex", "montrolkreisx", "seirthenwex"], Counter({w: 9 for w in WORDS})))


CASES = [
    ("Write to henry.glas@wexmail.test about it", [("email", "henry.glas@wexmail.test")]),
    ("<joe . poul (at) post.quillnet.invalid>:", [("email", "joe . poul (at) post.quillnet.invalid")]),
    ("[a.b [at] c [dot] test](mailto:a.b [at] c [dot] test)", [("email", "a.b [at] c [dot] test")] * 2),
    ("Contact=O.P@BRINDLE.EXAMPLE;tel=905-555-0124", [("email", "O.P@BRINDLE.EXAMPLE"), ("phone", "905-555-0124")]),
    ("Upgrade ranker@2.90.0 before", []),
    ("call (655) 555-0108 or +44 20 7946 0104 or 030/23125073 or 01 99 00 80 07", [("phone", "(655) 555-0108"), ("phone", "+44 20 7946 0104"), ("phone", "030/23125073"), ("phone", "01 99 00 80 07")]),
    ("Ticket 555-188-1850, Order 48-391-27-7, Invoice 2024-356-0040, 10.0.2600.12", []),
    ("HR file: SSN 959-53-9678, checked; passport no. Q98077916; DNI 96345412-M", [("national_id", "959-53-9678"), ("national_id", "Q98077916"), ("national_id", "96345412-M")]),
    ("ID on file QQ 43 34 80 D (Rose Tongolchul).", [("national_id", "QQ 43 34 80 D"), ("name", "Rose Tongolchul")]),
    ("Moved to Flat 36, 85 Quillham Avenue, Cresswater WX16 5FT; ok", [("address", "Flat 36, 85 Quillham Avenue, Cresswater WX16 5FT")]),
    ("Home address Bürgermeister-Oehlstr. 69b, D-54094 Mühlfurt.", [("address", "Bürgermeister-Oehlstr. 69b, D-54094 Mühlfurt")]),
    ("at 167 impasse Sainte-Orle, 31023 Valmonde-sur-Orle", [("address", "167 impasse Sainte-Orle, 31023 Valmonde-sur-Orle")]),
    ("Home address C/ Peña Clara 157, 4º B, 18043 Peñarroble.", [("address", "C/ Peña Clara 157, 4º B, 18043 Peñarroble")]),
    ("Home address P.O. Box 5415, Cresswater", [("address", "P.O. Box 5415, Cresswater")]),
    ("Main Street sentiment works on runway", []),
    ("Dear Deborah,", [("name", "Deborah")]),
    ("Per Prof. Prurklurlein: send", [("name", "Prurklurlein")]),
    ("Met Ms Fisgokel; F. Gemurveir, Droulzharvrer, Mark & Susannah V. Whelgrekrol met", [("name", "Fisgokel"), ("name", "F. Gemurveir"), ("name", "Droulzharvrer, Mark"), ("name", "Susannah V. Whelgrekrol")]),
    ("Mark all links. Grace periods of 4 days are stable. Glulutrex Capital works on runway.", []),
    ("Henry, Oliver Plenchasjon and MARK KREISPLENKRIL's", [("name", "Henry"), ("name", "Oliver Plenchasjon"), ("name", "MARK KREISPLENKRIL")]),
    ("Between Norbury-under-Hythe and 9f75ab UjkAlFVrydMihHIUZQXG=", []),
    # phrasings of no test table
    ("Her Ausweisnummer is L01X00T47, formerly Ausweisnummer L0123456.", [("national_id", "L0123456")]),
    ("CPF 123.456.789-09 and PESEL: 44051401359 were copied; order id 44051401359 was not", [("national_id", "123.456.789-09"), ("national_id", "44051401359")]),
    ("see tel:5551234567 or sms:+49 151 23456789 and https://bot:key@host.test/a", [("phone", "5551234567"), ("phone", "+49 151 23456789")]),
    ("Her id is 8812-4410-230; an idea 8812-4410-230 is none", [("national_id", "8812-4410-230")]),
    ("Mark every page. Grace notes and Rose gardens. Mark agreed, Grace called.", [("name", "Mark"), ("name", "Grace")]),
    ("", []),
]


@pytest.mark.parametrize("text, found", CASES)
def test_found(finder, text, found):
    assert [(k, text[a:b]) for a, b, k in finder.find(text)] == found


def test_frame(spark, finder):
    text = "x" * 200_000 + " Dear Rose Tongolchul, a@b.test"
    df = spark.createDataFrame([(1, None, text), (2, "", ""), (3, "nothing here", None), (3, "Hi Oliver,", "n")], "id long, compiled_truth string, kind string")
    got = P.find_personal(df, "id", ["compiled_truth", "kind"], finder.model, "pages").collect()
    assert sorted((r.row_id, r.field, [(x.kind, x.start_pos) for x in r.found]) for r in got) == [
        (1, "kind", [("name", 200_007), ("email", 200_024)]), (3, "compiled_truth", [("name", 4)]),
    ]
    assert all(("[NAME]" in r.redacted) for r in got)
    assert P.find_personal(df.limit(0), "id", ["kind"], finder.model, "t").count() == 0


def test_empty_training(spark):
    empty = spark.createDataFrame([], "id long, type string, title string, slug string, compiled_truth string")
    model = P.train_surnames(empty)
    assert [k for _, _, k in P.Finder(model).find("Hi Oliver, mail a@b.test")] == ["name", "email"]


def test_given_names_beyond_the_sample(finder):
    text = "Dear Frankie, Xander, Gracie, Walter and Kasia Tongolchul"
    assert [text[a:b] for a, b, _ in finder.find(text)] == ["Frankie", "Xander", "Gracie", "Walter", "Kasia Tongolchul"]


@pytest.mark.parametrize("end", ["", ";", ")", ":", "|", "\n", ",", ".", " and"])
def test_every_address_word_is_reached(finder, end):
    opt = lambda words: [w.replace("\\.?", "").replace("\\.", ".") for w in words.split("|")]
    forms = [f"14 Quillham {w}" for w in opt(P.STREET_EN)] + [f"Quillham{w} 14" for w in opt(P.STREET_DE)] + [f"Quillham{w}14" for w in opt(P.STREET_DE)]
    forms += [f"14 {w} Quillham" for w in opt(P.STREET_FR)] + [f"{w} Quillham 14" for w in opt(P.STREET_ES)] + [f"{w} 14" for w in ("P.O. Box", "PO Box", "Postfach", "Apartado", "Boîte postale", "BP")]
    for form in forms:
        text = f"at {form}{end}"
        assert [text[a:b].rstrip(".") for a, b, k in finder.find(text) if k == "address"] == [form], text


def test_surnames_outside_the_sample(spark):
    """A surname that many bodies hold and one title shows is no ordinary word, whether or not that title is in the sample; ordinary words come from all bodies."""
    rows = [(i, "note", f"n{i}", f"n/{i}", "Tongolchul shipped the weekly board") for i in range(60)] + [(i, "person", "Rose Tongolchul", None, "") for i in (100,)]
    df = spark.createDataFrame(rows, "id long, type string, title string, slug string, compiled_truth string")
    for bound in (1, 5, 20, 1000):
        model = P.train_surnames(df, bound=bound)
        assert "tongolchul" not in model.ordinary and {"shipped", "weekly", "board"} <= model.ordinary
    assert P.ordinary_from(20_000) == (3, 20) and P.ordinary_from(600_000) == (90, 600)


@pytest.mark.parametrize("gap", range(120, 230, 5))
def test_addresses_are_whole_wherever_an_earlier_anchor_stands(finder, gap):
    """A street word some way before an address does not cut it."""
    address = "Flat 36, 85 Quillham Avenue, Cresswater WX16 5FT"
    text = "the way " + "x" * gap + " to " + address + " and on"
    assert [text[a:b] for a, b, k in finder.find(text) if k == "address"] == [address]
