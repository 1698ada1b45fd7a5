import pytest

from loregraph.llm.email_text import new_text, old_lines, reduce_emails


def marked(body):
    return [k + 1 for k, x in enumerate(old_lines(body)) if x]


CASES = [
    ("Hi Ann,\n\nNew words.\n> old\n>> older\n>\nMore words.\n\nBest,\nBo\nPartner | Firm\n+1 555", [4, 5, 6, 9, 10, 11, 12]),
    ("On 2024-01-02 at 10:11, Ann Lee <a@b.test> wrote:\n> old\n\nanswer", [1, 2]),
    ("Am 3.4.2023 schrieb Ann Lee\n<ann . lee (at) b.test>:\n> alt\nAntwort", [1, 2, 3]),
    ("Text\n\n-----Ursprüngliche Nachricht-----\nVon: A\nGesendet: x\n\nalt\n", [3, 4, 5, 7]),
    ("Text\n\n________________________________\nDe : A B\nEnvoyé : 2024\nObjet : x\n\nvieux", [3, 4, 5, 6, 8]),
    ("Text\n\nBegin forwarded message:\nFrom: A\nSubject: b\n\nold", [3, 4, 5, 7]),
    ("Text\n\nSent from my phone", [3]),
    ("Text\n\n****************\nCONFIDENTIAL: this message is meant only for the addressee.\nDelete it.", [3, 4, 5]),
    ("Text\r\n\r\n-- \r\nAnn\r\n", [3, 4]),
    # a signature after a blank line, and a second block of it
    ("Text\n\nBest regards,\n\nAnna Smith\nCEO\n+44 20 7946 0104", [3, 5, 6, 7]),
    ("Text\n\n-- \n\nAnna Smith\nHead of Data", [3, 5, 6]),
    ("Text\n\nRegards\nAnna Smith\n\nExample Ltd | www.example.test\n+44 20 7946 0104\n\nP.S. The list is on page two.", [3, 4, 6, 7]),
    # thanks before a sentence
    ("Hi,\nThanks\nI will send the file tomorrow after the board has met.\nAll fine.", []),
    ("Many thanks\nAnna", [1, 2]),
    # a reply below an earlier message that says where it ends
    ("-----Original Message-----\nFrom: A\nSent: x\n\nold\n-----End of message-----\nnew below", [1, 2, 3, 5, 6]),
    # replies below an earlier message that its signature ends
    ("-----Original Message-----\nFrom: A\nSent: x\n\nCan you come?\n\nRegards,\nAnn Lee\n\nYes, I can come on Monday.\n\nBo", [1, 2, 3, 5, 7, 8]),
    # not what it looks like
    ("On Tuesday the board wrote: ship it, so I did.", []),
    ("From: line in the report is wrong, I fixed it.", []),
    ("Regards the budget: no change.\nThanks to the freeze we have 9 links left.\nBest option is still the second one.", []),
    ("The original message never reached the board.\nConfidential figures stay out of the query log.", []),
    ("", []),
    (">", [1]),
]


@pytest.mark.parametrize("body, lines", CASES)
def test_lines(body, lines):
    assert marked(body) == lines


def test_interleaved_replies_stay():
    body = "Ann Lee wrote:\n> first\n\nanswer one\n\n> second\n\n\nanswer two\n"
    assert new_text(body, old_lines(body)) == "answer one\n\nanswer two"


def test_frame(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "> all old", "x"), (4, "new " * 50_000, "x"), (4, "again", "x")]
    got = reduce_emails(spark.createDataFrame(rows, "id long, b string, new_text string"), "id", "b").collect()
    assert sorted((r.page_id, r.new_text if r.new_text is None else r.new_text[:5], r.old_lines) for r in got if r.page_id < 4) == [(1, None, []), (2, "", []), (3, "", [1])]
    assert len(got) == 5
    assert reduce_emails(spark.createDataFrame([], "id long, b string"), "id", "b").count() == 0
