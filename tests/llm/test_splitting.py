from hypothesis import given, settings
from hypothesis import strategies as st

from loregraph.llm.splitting import bisect_text, split_oversized, splits_cluster


def check(text, limit, overlap):
    pieces = bisect_text(text, limit, overlap)
    assert "".join(text[s + o : e] for s, e, o in pieces) == text
    assert all(e - s <= limit for s, e, _ in pieces)
    assert all(o <= overlap for _, _, o in pieces) and pieces[0][2] == 0
    for (_, e0, _), (s, _, o) in zip(pieces, pieces[1:]):
        assert s + o == e0
    return pieces


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .,\n\ŕ‍éя", max_size=400))
def test_no_text_is_lost(text):
    check(text, 40, 8)


def test_cuts_at_paragraphs_first():
    text = ("word " * 30 + ".\n\n") * 6
    pieces = check(text, 400, 40)
    assert all(text[:e].endswith("\n\n") for _, e, _ in pieces)
    assert all(o == 40 for _, _, o in pieces[1:])


def test_text_without_boundaries_keeps_graphemes():
    text = "é" * 500
    assert all(not splits_cluster(text, s) and not splits_cluster(text, e) for s, e, _ in check(text, 100, 20))


def test_frame(spark):
    rows = [(1, "short", 9), (2, None, 9), (3, "", 9), (4, "x" * 2048, 9), (5, "x" * 2049, 9), (5, "y z " * 600, 9), (6, "läng " * 20000, 9)]
    df = spark.createDataFrame(rows, "id long, t string, piece_no int")
    got = split_oversized(df, "page", "id", "t").toPandas()
    assert sorted(set(got.item_id)) == [5, 6]
    assert got.piece_tokens.max() <= 512 and set(got.columns) >= {"item_kind", "piece_no"}
    six = got[got.item_id == 6].sort_values("piece_no")
    assert "".join(t[o:] for t, o in zip(six.piece_text, six.overlap_chars)) == "läng " * 20000
    assert split_oversized(df.limit(0), "page", "id", "t").count() == 0


def test_boundaries_outside_the_middle():
    """One unbroken run amid words is cut at the words around it where the limit allows."""
    text = "word " * 90 + "x" * 1100 + " word" * 90
    pieces = bisect_text(text, 1200, 64)
    assert [text[s:e] for s, e, o in pieces if "x" * 1100 in text[s:e]] and len(pieces) == 3
    assert "".join(text[s + o : e] for s, e, o in pieces) == text
    # a long run that has to be torn anyway does not leave single words as pieces
    text = "word " + "x" * 4_000 + " word"
    assert min(e - s - o for s, e, o in bisect_text(text, 1200, 64)) > 100
