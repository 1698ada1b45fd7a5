import random

import pytest

from loregraph.llm import mojibake as M

SENTENCES = [
    "Die Rückmeldung käme früher, außerdem wäre es schön, größere Änderungen für Mühlfurt zu prüfen.",
    "Après la réunion, l’équipe a déplacé l’échéance à la fin de l’été; où sont passées les pièces évoquées ?",
    "La búsqueda funcionó también sin conexión; ¿quién decidió que tenía que terminar en otoño? Mañana más páginas.",
    "A reunião não avançou; a decisão ficará para amanhã. ATENÇÃO: NÃO é a VERSÃO ÚLTIMA, há três seções.",
    "Następne spotkanie odbędzie się później, gdyż brakuje źródeł. Zespół sprawdził błędne łącza.",
    "Команда проверила записей и исправила ссылки. Следующая встреча пройдёт позже.",
    "“It’s slow,” said the board, “but don’t touch it” — the café charges 4 € for a naïve résumé…",
]


@pytest.fixture(scope="module")
def model():
    rng = random.Random(3)
    return M.train([" ".join(rng.sample(SENTENCES, 3)) for _ in range(300)])


@pytest.mark.parametrize("chain", M.CHAINS, ids=M.NAMES)
def test_chains_round_trip(chain):
    for s in SENTENCES:
        g = M.garble(s, chain)
        if g is not None:
            assert M.invert(g, chain) is not None
            assert chain[0][0] != "utf-8" or M.invert(g, chain) == s


def test_correct_text_stays(model):
    r = M.Restorer(model)
    for s in SENTENCES:
        assert r.restore(s) == (s, [], 0)
    assert r.restore("plain ASCII")[1:] == ([], 0)


@pytest.mark.parametrize("chain", ["utf-8:cp1252", "utf-8:latin-1", "utf-8:mac_roman", "utf-8:cp437", "utf-8:cp1252>utf-8:cp1252"])
def test_garbled_in_places(model, chain):
    r = M.Restorer(model)
    c = M.CHAINS[M.NAMES.index(chain)]
    for s in SENTENCES:
        words = s.split(" ")
        k = max(range(len(words)), key=lambda i: sum(x > "\x7f" for x in words[i]))
        garbled = M.garble(words[k], c)
        if garbled:
            text = " ".join([*words[:k], garbled, *words[k + 1 :]])
            fixed, chains, lost = r.restore(text)
            assert chains and not lost and fixed == s


@pytest.mark.parametrize("chain", ["cp1252:cp850", "cp1252:mac_roman", "cp1252:cp1251"])
def test_single_byte_chains(model, chain):
    r = M.Restorer(model)
    c = M.CHAINS[M.NAMES.index(chain)]
    for s in SENTENCES[:4]:
        fixed, chains, _ = r.restore(M.garble(s, c))
        same = sum(a == b for a, b in zip(fixed.split(), s.split())) / len(s.split())
        assert chains and same > 0.9, (s, fixed, chains)


def test_frame(spark):
    rows = [(i, SENTENCES[i % 7], 1) for i in range(70)] + [(100, None, 1), (101, "", 1), (102, M.garble(SENTENCES[0], M.CHAINS[0]), 1), (103, "O� est la t�che ?", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lost int")
    got = {r.doc_id: r for r in M.restore_documents(df, "doc_id", "text").collect()}
    assert set(got) == {102, 103}
    assert got[102].restored_text == SENTENCES[0] and got[103].lost == 2
    assert M.restore_documents(df.limit(0), "doc_id", "text").count() == 0


def test_words_that_lost_bytes(model):
    """Undefined or trimmed bytes leave words that no chain inverts; they are reported, and correct words beside signs are not."""
    r = M.Restorer(model)
    assert r.restore("they donâ€t charge")[2] == 1 and r.restore("aprÃ¨s lâ€Ã©tÃ")[2] >= 1
    for w in "Ângela 4 € São Paulo… l’été… “naïve”, É… Größe±2".split():
        assert not (M._STRAY.search(w) and r.stray(w)), w
