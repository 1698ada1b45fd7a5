import pytest

from loregraph.llm.names import GIVEN, agreement_keys, close, deletions, parse, resolve_entities, same_entity_pairs


def test_close():
    assert close("abcd", "abcd") and close("abcd", "abd") and close("abcd", "abxd") and close("abcd", "abdc") and close("abcd", "abcxd")
    assert not close("abcd", "badc") and not close("abcd", "ab") and not close("abcd", "dcba")
    assert deletions("abcd") & deletions("abdc") and deletions("abcd") & deletions("abxd")


@pytest.mark.parametrize(
    "title, slug",
    [
        ("Larry Gleironfror", "people/larry-gleironfror"), ("Gleironfror, Lawrence", "people/p-2e2ac0ea"), ("Dr. LAWRENCE GLEIRONFROR, PhD", None), ("LawrenceGleironfror [dup?]", ""),
        ("Gleironfror Lawrence – notes", "people/p-2e2ac0ea-3e"), ("Lawrence B.  Gleironfror ", "contacts/l-gleironfror-2"), ("Lawrence", "people/gleironfror-lawrence-16b4"),
    ],
)
def test_persons_parse_alike(title, slug):
    cores, gives, inits = parse("person", title, slug)
    assert cores == parse("person", "Lawrence Gleironfror", None)[0] and gives == ["lawrence"] and inits == ["l"]


def entities(spark, rows):
    df = spark.createDataFrame(rows, "id long, title string, slug string, type string, kind string")
    got: dict = {}
    for r in resolve_entities(df).collect():
        got.setdefault(r.entity_id, set()).add(r.page_id)
    return sorted(sorted(v) for v in got.values())


def test_merge_and_rematch(spark):
    p = lambda i, t, s=None, k="person": (i, t, s, k, "clash")
    rows = [
        p(1, "Lawrence Gleironfror"), p(2, "Larry Gleironfrr"), p(3, "L. Gleironfror", "people/p-2e2ac0ea"), p(4, "GLEIRONFROR, L.B."), p(5, "lgleironfror", "people/p-06bc5304"),
        p(6, "Victoria Gleironfror"),  # a relative
        p(7, "Greindinwhenx Software Ltd", "companies/greindinwhenx-software", "company"), p(8, "GREINDINWHENX SW", None, "company"), p(9, "Greindinwhenx Energy", None, "company"),  # a sister company
        p(10, "Greindinwhenx Inc", None, "company"),  # either of the two
        p(11, None), p(12, ""), p(13, "Yvonne", "people/p-862d0ccf"), p(14, "Yvonne", "people/p-862d0cce"),
        p(15, "Evi Whozgrormeis"), p(16, "Whosgrormeis, Yvonne"), p(17, "Yvonne", "people/yvonne-whosgrormeis-2"), p(18, "Whosgrormeis, Yvonne"),
        p(20, "Gleironfror Capital", None, "company"), p(21, "x " * 50_000),
    ]
    got = entities(spark, rows)
    assert [1, 2, 3, 4, 5] in got and [6] in got and [7, 8] in got and [9] in got and [10] in got
    assert [15, 16, 17, 18] in got and [20] in got and all([i] in got for i in (11, 12, 13, 14))


def test_hot_name_and_pairs(spark):
    rows = [(i, "Rose Tongolchul" if i < 300 else f"Mark Zz{'abcdefghij'[i % 10] * 3}{'klmnopqrst'[i // 10 % 10] * 3}zz{'uvwx'[i % 4] * 2}", None, "person", "") for i in range(900)]
    df = spark.createDataFrame(rows, "id long, title string, slug string, type string, kind string")
    members = resolve_entities(df)
    assert members.filter("entity_id = 0").count() == 300
    assert same_entity_pairs(members.filter("page_id < 20")).count() == 190
    assert same_entity_pairs(resolve_entities(df.limit(0))).count() == 0


def test_given_names_beyond_the_sample():
    full = "andrew benjamin charlotte dorothy emily frederick gabriel george jacob jessica jonathan joshua kenneth leonard martin patrick peter philip rebecca samuel stephen theodore timothy walter"
    assert all(w in GIVEN[w] for w in full.split())
    short = {"xander": "alexander", "frankie": "frances", "kit": "christopher", "jamie": "james", "minnie": "wilhelmina", "gracie": "grace", "doug": "douglas", "kasia": "katarzyna", "dima": "dmitri"}
    assert all(f in GIVEN[s] for s, f in short.items())
    assert parse("person", "Xander Gleironfror", None) == parse("person", "Alexander Gleironfror", None)


def test_keys_guarantee_agreement():
    words = ["meyer", "meier", "mayer", "meyr", "meyers", "myeer", "emyer", "mee", "abc", "abcd", "abd", "tongolchul"]
    for a in words:
        for b in words:
            x, y = agreement_keys(a), agreement_keys(b)
            meet = any(k in y or "0" + k[1:] in y for k in x if k[0] == "1") or any(k in x or "0" + k[1:] in x for k in y if k[0] == "1")
            assert meet == (a == b or (close(a, b) and max(len(a), len(b)) > 3)), (a, b)
    assert agreement_keys("#abcd") == {"1+#abcd"} and agreement_keys("=abc") == {"1+=abc"}


def test_owner_as_written_before_near_ones(spark):
    p = lambda i, t: (i, t, None, "person", "")
    rows = [p(1, "Jacob Tongolchul"), p(2, "J. Tongolchul"), p(3, "Joshua Tongolchal"), p(4, "Tongolchul"), p(5, "Rose Plenchasjon"), p(6, "Rebecca Plenchasjon"), p(7, "R. Plenchasjon"), p(8, "Mark Gemurveir"), p(9, "M. Gemurveer")]
    assert entities(spark, rows) == [[1, 2, 4], [3], [5], [6], [7], [8, 9]]


def test_frequent_spelling_hides_no_link(spark):
    """Two spellings one edit apart stay linked when a third, two edits from them, is the most frequent of their keys."""
    p = lambda i, t: (i, t, None, "person", "")
    pair = [p(1, "John Smithe"), p(2, "John Kmithe")]
    assert entities(spark, pair) == [[1, 2]]
    got = entities(spark, [*pair, p(3, "John Mithea"), p(4, "John Mithea"), p(5, "John Mithea")])
    assert any({1, 2} <= set(g) for g in got)


def test_other_scripts_and_initials_of_firms(spark):
    p = lambda i, t, k="person": (i, t, None, k, "")
    rows = [p(1, "Иван Петров"), p(2, "ИВАН ПЕТРОВ"), p(3, "И. Петров"), p(4, "山田 太郎"), p(5, "山田 太郎"), p(6, "山田 花子"), p(7, "IBM", "company"), p(8, "IBM", "company"), p(9, "IBN", "company"), p(10, "Ольга Петрова"), p(11, "GH", "company"), p(12, "GH", "company")]
    assert entities(spark, rows) == [[1, 2, 3], [4, 5], [6], [7, 8], [9], [10], [11], [12]]


def test_long_chains_merge_to_the_end(spark):
    """A chain of spellings, each one edit from the next, takes many merges and ends in one entity."""
    word, rows = "abcdefghijklmnopqrst", []
    for i in range(len(word) + 1):
        rows.append((i, "Rose " + word.capitalize(), None, "person", ""))
        word = word[:i] + "zyxwv"[i % 5] + word[i + 1 :]
    assert entities(spark, rows) == [list(range(21))]
