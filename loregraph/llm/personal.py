"""Personal information in free text: anchor expansion.

An Aho-Corasick automaton finds at-signs (plain and disguised), schemes, identifier cues and street words; deterministic local parsers expand each to the left and right and
validate what they find by its form. Check digits are not asked for: a mistyped identity number is personal, too. Phone numbers without a scheme are validated digit groups. Names are built around given names, honorifics and words that a small letter model takes for surnames.
"""

from __future__ import annotations

import bisect
import re as stdre
from collections import Counter
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pandas as pd
import regex as re
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loregraph.llm.names import BRANCH, GIVEN, LEGAL, parse, plain

#: Pages whose titles of persons and firms the surname model is fitted on at most. Words are counted over all bodies.
SAMPLE_PAGES = 20_000
#: How far, in characters, the parsers look from an anchor: back for the local part of an email address (64 at most by RFC 5321, and the blanks and words of disguised dots), on for the
#: number that a cue announces, and, within the line, back and on for the elements of an address beside its street word.
EMAIL_BACK, NUMBER_ON, ADDRESS_BACK, ADDRESS_ON = 200, 45, 120, 200
PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "national_id": "[NATIONAL_ID]", "address": "[ADDRESS]", "name": "[NAME]"}

# Words that announce identity numbers, honorifics, street words, ambiguous given names.
ID_CUES = (
    "id", "ssn", "social security", "steuer-id", "steuernummer", "steueridentifikationsnummer", "sozialversicherungsnummer", "dni", "nie", "nif", "national id", "ni number", "national insurance", "nino", "passport", "reisepass",
    "passeport", "pasaporte", "passaporte", "passaporto", "paspoort", "паспорт", "paszport", "personalausweis", "ausweis", "ausweisnummer", "passnummer", "identity", "identification", "badge", "tax id", "taxpayer", "tin", "itin",
    "insee", "sécurité sociale", "numéro fiscal", "carte d'identité", "carnet de identidad", "seguridad social", "pesel", "dowód", "dowodu", "bsn", "burgerservicenummer", "cpf", "curp", "codice fiscale", "aadhaar", "personnummer",
    "снилс", "инн", "driver's license", "driver's licence", "driving licence", "driving license", "führerschein", "permis de conduire",
)
#: Schemes that announce a phone number, and those whose authority may hold an at-sign that is none of an email address.
CALL_SCHEMES, WEB_SCHEMES = ("tel:", "sms:", "callto:", "whatsapp:", "facetime:", "fax:"), ("http://", "https://", "ftp://", "sftp://", "ssh://", "git://")
AT_SIGNS = ("@", "[at]", "(at)", "{at}", "<at>", "＠")
STREET_EN = "Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Boulevard|Blvd|Terrace|Court|Ct|Close|Drive|Dr|Way|Place|Pl|Square|Sq|Crescent|Row|Hill|Parkway|Highway|Walk|Gardens|Mews|Grove"
STREET_FR = "rue|avenue|boulevard|allée|impasse|place|chemin|quai|cours|route|passage|ruelle|square|av\\.|bd"
STREET_ES = "Calle|Avenida|Avda\\.?|Plaza|Paseo|Camino|Ronda|Carrera|Rua|Praça|C/"
BOXES = "Postfach|Apartado|Boîte postale|BP"
STREET_DE = "straße|strasse|str\\.|weg|platz|allee|gasse|ring|damm|ufer"
HONORIFICS = frozenset("mr mrs ms miss mx dr prof professor sir dame herr frau mme mlle monsieur madame señor señora sr sra don doña dipl.-ing ing rev".split())
#: Words that begin the object of a verb: after a given name that is a verb, too, they show that it is none here.
OBJECT_WORDS = frozenset("the a an all each every both any some no this that these those it them him us me my our your his its their you we they i he she".split())
#: Words with which a given name makes an ordinary English compound.
COMPOUNDS = {
    "grace": "period periods note notes", "rose": "garden gardens gold bush window", "mark": "up down", "bill": "of", "art": "gallery director work history", "may": "day be", "dot": "com product matrix plot", "chip": "set card maker",
    "kit": "car bag", "penny": "stock stocks", "jack": "of plug socket", "nick": "of", "max": "value length size pool", "min": "value length size", "pen": "name drive", "dan": "grade", "ray": "tracing", "frank": "discussion exchange",
    "rich": "text media list", "sandy": "beach soil", "will": "be not have", "april": "fool fools", "june": "bug", "dolly": "zoom", "drew": "up on", "ted": "talk talks", "rob": "banks", "sue": "for", "dick": "test", "lance": "corporal",
}
NEEDS_SIGN = frozenset("al em jo pen dot chip kit hal sandy will bill pat sue rob bob jack nick penny drew dolly min lars len rich dick hank chas ted ed eve dan ben sam max art may june april rosa lex laurie kay dom theo ned mark grace rose ray frank lance".split())
#: Of these, words that are common as names even where no sign of one stands beside them.
MOSTLY_NAMES = frozenset("mark grace rose ray frank lance".split())

_DOT = r"(?:\.|\s?\[dot\]\s?|\s?\(dot\)\s?|\sdot\s)"
_LOCAL = re.compile(rf"(?i)[a-z0-9](?:[a-z0-9_%+'-]|(?:\.|\s?\[dot\]\s?|\s?\(dot\)\s?|\s\.\s)(?=[a-z0-9]))*\s?$")
_LOCAL_PLAIN = re.compile(r"(?i)[a-z0-9](?:[a-z0-9._%+'-])*$")
_DOMAIN = re.compile(rf"(?i)\s?((?:[a-z0-9](?:[a-z0-9-]*[a-z0-9])?{_DOT})+[a-z]{{2,24}})(?![a-z0-9_-]|\.\d)")

_ID = stdre.compile(
    r"(?<![\w.@/+(-])(?:[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]|\d{3}([- ])\d{2}\1\d{4}|[12] \d{2} \d{2} \d{2} \d{3} \d{3}(?: \d{2})?|[XYZ]?-?\d{7,8}-?[A-Z]|[A-Z]{1,3}\d{6,9}"
    r"|\d{3}\.\d{3}\.\d{3}-\d{2}|(?!\d{3}([-. ])\d{3}\2\d{4}(?!\d))\d{2,4}([- ])\d{2,4}(?:\3\d{2,4}){1,3}|\d{8,13})(?![\w@/-]|\.\d)"
)
_PHONE = stdre.compile(
    r"(?<![\w.@/+%=-])(?<!\d )(?:"
    r"\+\d{1,3}[ .-]?\(0\)[ .-]?\d{1,4}(?:[ ./-]?\d{2,8}){1,4}"
    r"|\+\d{1,3}(?:[ .-]?\(?\d{1,4}\)?)(?:[ ./-]?\d{2,8}){1,5}"
    r"|\(\d{2,5}\) ?\d{3,4}[- .]?\d{3,4}"
    r"|\d{3}([-. ])\d{3}\1\d{4}"
    r"|0\d(?: \d{2}){4}"
    r"|0\d{4} \d{6}"
    r"|0\d{2,4}[/-] ?\d{5,8}"
    r"|0\d{2,3} \d{3,4} \d{4}"
    r")(?: ?(?:ext|x|Ext|Durchwahl|poste)\.? ?\d{1,5})?(?![\w@/-]|\.\d)"
)
_PHONE_EQ = stdre.compile(r"(?<==)\+?\d|(?<==)\(\d")
_NUMBERED = stdre.compile(r"(?i)(?:ticket|order|invoice|build|trace|batch|commit|version|v|ref|issue|case|release|bestellung|rechnung|facture|commande|pedido|factura|#|nr|no)\.?:?\s?#?$")

_NOT_ID = stdre.compile(r"(?i)(?:ticket|order|invoice|build|trace|batch|commit|version|release|phone|tel|call|at)\.?:?\s?$")
#: Things whose ids are no person's.
_THING_BEFORE = stdre.compile(r"(?i)(?:ticket|order|invoice|build|trace|batch|commit|version|release|message|session|request|job|task|doc|document|page|chunk|user|item|product|event|device|object|record|row)[ _-]$")

_TOWN = r"\p{Lu}\p{Ll}[\p{L}’'-]*(?: \p{Lu}\p{Ll}[\p{L}’'-]*)?"
_ADDRESSES = re.compile(
    r"(?<![\p{L}\p{N}])(?:"
    rf"(?:(?:Flat|Apt\.?|Apartment|Unit|Suite)\s\d+\w?,\s)?\d{{1,5}}\p{{Ll}}?\s(?:\p{{Lu}}[\p{{L}}’'-]+\s){{1,3}}(?:{STREET_EN})(?![\p{{L}}])\.?(?:,\s(?:Suite|Apt\.?|Unit|Flat|Floor)\s\d+\w?)?(?:,\s{_TOWN}(?:\s(?:\d{{5}}|\p{{Lu}}{{1,2}}\d{{1,2}}\p{{Lu}}?\s?\d\p{{Lu}}{{2}}))?)?"
    rf"|(?i:P\.?\s?O\.?\sBox|{BOXES})\s\d+(?:,\s(?:\d{{5}}\s)?{_TOWN}(?:\s\d{{5}})?)?"
    rf"|\p{{Lu}}[\p{{L}}-]*(?:{STREET_DE})\s?\d{{1,4}}\s?[a-z]?(?![\p{{L}}\p{{N}}])(?:,\s(?:D-)?\d{{5}}\s{_TOWN})?"
    rf"|\d{{1,4}}(?:\s?(?:bis|ter))?,?\s(?:{STREET_FR})\s(?:(?:de|du|des|la|le|les|l['’]|d['’])\s?)*\p{{Lu}}[\p{{L}}’'-]*(?:[\s]\p{{Lu}}[\p{{L}}’'-]*)*(?:,\s\d{{5}}\s{_TOWN})?"
    rf"|(?:{STREET_ES})\s(?:(?:de|del|la|las|los|el|da|do|das|dos)\s)*\p{{Lu}}[\p{{L}}-]*(?:\s(?:(?:de|del|la|las|los)\s)*\p{{Lu}}[\p{{L}}-]*)*,?\s\d{{1,4}}(?:,\s\d{{1,2}}\s?[ºª°]\s?\p{{L}}?)?(?:,\s\d{{4,5}}(?:-\d{{3}})?\s{_TOWN})?"
    r")"
)
def _anchors(words: str) -> set[str]:
    """The words of a part of the address pattern, an optional last dot with and without."""
    out = set()
    for w in words.lower().split("|"):
        out |= {w[:-3], w[:-3] + "."} if w.endswith("\\.?") else {w.replace("\\.", ".")}
    return out


#: Words of ``_ADDRESSES``: endings, which a blank or a digit must follow, and words on their own, which have no letter or digit before and no letter after them.
_STREET_ENDINGS = _anchors(STREET_DE)
_STREET_WORDS = set().union(*map(_anchors, (STREET_EN, STREET_FR, STREET_ES, BOXES))) | {"box"}

_TOKEN = re.compile(r"\p{Lu}(?:\p{L}|\p{M}|(?<=\p{L})['’-](?=\p{Lu}|\p{Ll}{3}))*\.?")
_MIXED = re.compile(r"^(?!(?:Mc|Mac|De|Di|La|Le|Van|Von)\p{Lu}\p{Ll}+$).*\p{Ll}\p{Lu}|\p{Lu}{2,}\p{Ll}")
_AFTER = re.compile(r"\s?([\p{L}'’]+)")
_SIGN_BEFORE = re.compile(r"(?:[|/:;&([*>,#]|\b(?:with|via|per|by|and|und|et|y|to|from|dear|hi|hello|hey|hallo|bonjour|salut|hola|cc|so|met|reach|samples to))\s*$", re.I)
_SIGN_AFTER = re.compile(r"\s*(?:['’]s\b|[,:;)|/&*\]]|\(|$|\n|(?:and|und|et|y|called|wrote|asked|split|said)\b)")


_CUE_WORDS = frozenset(plain(w) for w in ID_CUES)


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for w in AT_SIGNS:
        a.add_word(w, ("at", w))
    for w in ID_CUES:
        a.add_word(w, ("id", w))
    for w in CALL_SCHEMES:
        a.add_word(w, ("call", w))
    for w in WEB_SCHEMES:
        a.add_word(w, ("web", w))
    for w in _STREET_ENDINGS:
        a.add_word(w, ("ending", w))
    for w in _STREET_WORDS:
        a.add_word(w, ("street", w))
    a.make_automaton()
    return a


def ordinary_from(pages: int) -> tuple[int, int]:
    """Pages, of ``pages``, from which a word counts as ordinary: if as many have it in small letters, and if not. The shares are the same whatever the number of pages."""
    return max(3, 3 * pages // SAMPLE_PAGES), max(3, pages // 1000)


class SurnameModel:
    """Logistic model over hashed letter n-grams, and the ordinary words of the bodies."""

    BITS = 16

    def __init__(self, surnames: Iterable[str], firms: Iterable[str], words: Counter[str], lower: Counter[str] | None = None, pages: int = 0, rounds: int = 8) -> None:
        """``words`` and ``lower``: the number of pages, of ``pages``, that have a word at all and in small letters. A word that is only ever written with a capital must be more
        frequent to count as ordinary, for the surnames of people who have no page are among those.
        """
        good = set(surnames)
        least, often = ordinary_from(pages)
        self.ordinary = {w for w, n in words.items() if w not in good and n >= (least if lower is None or lower[w] >= least else often)}
        bad = [*self.ordinary, *(w for w in set(firms) if w not in good)]
        data = [(self._features(w), 1.0) for w in sorted(good)] + [(self._features(w), 0.0) for w in sorted(bad)]
        self.weights = np.zeros(1 << self.BITS, np.float32)
        rng = np.random.default_rng(7)
        for r in range(rounds):
            rate = 0.5 / (1 + r)
            for k in rng.permutation(len(data)):
                f, y = data[k]
                self.weights[f] += rate * (y - 1 / (1 + np.exp(-self.weights[f].sum())))
        self.trained = bool(good)

    def _features(self, word: str) -> np.ndarray:
        w = f"^{word}$"
        return np.unique(np.array([xxhash.xxh32_intdigest(w[i : i + n]) >> (32 - self.BITS) for n in (2, 3, 4) for i in range(len(w) - n + 1)], np.int64))

    def score(self, word: str) -> float:
        """Log-odds that a word, in plain lower case, is a surname."""
        return float(self.weights[self._features(word)].sum()) if self.trained and len(word) > 3 else -9.0


class Finder:
    def __init__(self, model: SurnameModel, keep: int = 500_000) -> None:
        self.model, self.keep, self.known = model, keep, {}
        self.anchors = _automaton()

    # -- names ------------------------------------------------------------------------------------------------------------------------------------------

    def _kind(self, token: str) -> str:
        """g given name, s surname, u a word not met, h honorific, i initial, f firm word, o ordinary word."""
        got = self.known.get(token)
        if got is None:
            w = plain(token).lower()
            bare = w.rstrip(".")
            if bare in HONORIFICS:
                got = "h"
            elif len(bare) == 1:
                got = "i" if token.endswith(".") else "o"
            elif bare in GIVEN:
                got = "g"
            elif bare in BRANCH or bare in LEGAL:
                got = "f"
            elif bare in _CUE_WORDS:
                got = "o"
            else:
                parts = bare.split("-")
                bare = bare.replace("'", "").replace("’", "").replace("-", "")
                got = "o" if bare in self.model.ordinary or any(x in self.model.ordinary for x in parts) else "s" if self.model.score(bare) > 0 else "u"
            if len(self.known) > self.keep:
                self.known.clear()
            self.known[token] = got
        return got

    def _names(self, text: str, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
        toks: list[tuple[int, int, str, str]] = []
        k = 0
        for m in _TOKEN.finditer(text):
            a, b = m.span()
            while k < len(taken) and taken[k][1] <= a:
                k += 1
            if (k < len(taken) and taken[k][0] < b) or (a and (text[a - 1].isalnum() or text[a - 1] in "_@.")):
                continue
            w = m.group()
            if text[b : b + 1].isdigit() or text[b : b + 1] in ("_", "=", "+") or (a and text[a - 1] in "+=%") or _MIXED.search(w):
                continue  # inside a code
            if w.endswith("."):
                if len(w) > 2 and plain(w[:-1]).lower() not in HONORIFICS and w[:-1].lower() != "dipl":
                    w, b = w[:-1], b - 1
            if w[-2:] in ("'s", "’s"):
                w, b = w[:-2], b - 2
            toks.append((a, b, w, self._kind(w)))
        out, i, n = [], 0, len(toks)

        def gap(j: int) -> str:
            return text[toks[j - 1][1] : toks[j][0]] if 0 < j < n else "\0"

        def near(j: int) -> bool:
            return j < n and gap(j) in (" ", "  ", "\xa0")

        while i < n:
            a, b, w, kind = toks[i]
            after_title = kind == "h" and near(i + 1)
            if kind == "h":
                i += 1
                if not after_title or toks[i][3] == "h":
                    continue
                a, b, w, kind = toks[i]
                if kind in "ou" or (kind == "f" and not near(i + 1)):
                    kind = "s"
            start, j = a, i
            if kind == "g":
                while near(j + 1) and toks[j + 1][3] == "i":
                    j += 1
                if near(j + 1) and toks[j + 1][3] in "su" and not (near(j + 2) and toks[j + 2][3] == "f"):
                    j += 1
                elif j > i and near(j + 1) and toks[j + 1][3] == "o" and toks[j + 1][1] - toks[j + 1][0] > 3:
                    j += 1
                else:
                    if not after_title and not self._alone(text, a, b, w):
                        i += 1
                        continue
                    j = i
                    if near(j + 1) and toks[j + 1][3] == "i" and text[toks[j + 1][1] : toks[j + 1][1] + 1] in ("", "\n", "\r", ";", ",", " "):
                        j += 1  # a given name and the initial of a surname
            elif kind == "i":
                while near(j + 1) and toks[j + 1][3] == "i":
                    j += 1
                if near(j + 1) and toks[j + 1][3] in "su" and not (near(j + 2) and toks[j + 2][3] == "f"):
                    j += 1
                else:
                    i = j + 1
                    continue
            elif kind == "s" or (kind == "u" and b - a > 3 and j + 1 < n and gap(j + 1) == ", " and toks[j + 1][3] == "g"):
                if near(j + 1) and toks[j + 1][3] == "f":
                    i += 2  # a firm
                    continue
                if near(j + 1) and toks[j + 1][3] in "gs" and not (toks[j + 1][3] == "g" and near(j + 2) and toks[j + 2][3] == "s"):
                    j += 1
                elif j + 1 < n and gap(j + 1) == ", " and toks[j + 1][3] in "gi":
                    j2 = j + 1
                    while near(j2 + 1) and toks[j2 + 1][3] == "i":
                        j2 += 1
                    if not (near(j2 + 1) and toks[j2 + 1][3] in "su"):  # else the next name begins here
                        j = j2
            else:
                i += 1
                continue
            end = toks[j][1]
            out.append((start, end))
            i = j + 1
        return out

    def _alone(self, text: str, a: int, b: int, word: str) -> bool:
        """Whether a given name that stands alone is a name here."""
        w = plain(word).lower()
        after = _AFTER.match(text, b)
        if w in NEEDS_SIGN and after and text[b : b + 1] == " " and (after.group(1) in OBJECT_WORDS or after.group(1) in COMPOUNDS.get(w, "").split()):
            return False
        if w in NEEDS_SIGN and w not in MOSTLY_NAMES:
            return bool(_SIGN_BEFORE.search(text[max(0, a - 14) : a]) or _SIGN_AFTER.match(text, b) or not text[:a].strip() or text[a - 1] == "\n")
        return not (after and text[b : b + 1] == " " and after.group(1)[0].isupper() and self._kind(after.group(1)) == "f")

    # -- anchors ----------------------------------------------------------------------------------------------------------------------------------------

    def _email(self, text: str, a: int, b: int, plain_at: bool) -> tuple[int, int] | None:
        right = _DOMAIN.match(text, b)
        if not right:
            return None
        low = max(0, a - EMAIL_BACK)
        left = (_LOCAL_PLAIN if plain_at and text[a - 1 : a] != " " else _LOCAL).search(text[low:a])
        if not left:
            return None
        start = low + left.start()
        if start and text[start - 1].isalnum():
            return None
        return start, right.end()

    def find(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, kind) from 0, in order, without overlaps."""
        spans: list[tuple[int, int, str]] = []
        lower = text.lower()
        if len(lower) != len(text):
            lower = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
        lines, seen_line, at_end, authority, authority_from = [], -1, -1, -1, 0
        for end, (what, w) in self.anchors.iter(lower):
            a, b = end + 1 - len(w), end + 1
            if what == "at":
                if a < at_end or (a < authority and "/" not in text[authority_from:a]):
                    continue
                if got := self._email(text, a, b, len(w) == 1):
                    spans.append((*got, "email"))
                    at_end = got[1]
            elif what == "web":
                authority_from = b
                authority = b + len(_NO_BLANK.match(text, b).group())
            elif what == "call":
                m = _CALLED.match(text, b)
                if m and 7 <= sum(c.isdigit() for c in m.group()) <= 15 and not (a and text[a - 1].isalnum()):
                    spans.append((*m.span(), "phone"))
            elif what == "id":
                if (a and text[a - 1].isalnum()) or text[b : b + 1].isalpha() or _THING_BEFORE.search(text[max(0, a - 12) : a]):
                    continue  # part of another word, or the id of a thing
                if m := _ID.search(text, b, b + NUMBER_ON):
                    between = text[b : m.start()]
                    if "\n" not in between and not stdre.search(r"\d", between) and not _NOT_ID.search(text[max(0, m.start() - 12) : m.start()]):
                        spans.append((*m.span(), "national_id"))
            else:
                after = text[b : b + 1]
                if not (after.isspace() or after.isdigit()) if what == "ending" else (after.isalpha() or text[a - 1 : a].isalnum()):
                    continue  # part of another word
                line = text.rfind("\n", 0, a) + 1
                low = max(line, a - ADDRESS_BACK)
                if a > seen_line:
                    high = text.find("\n", b)
                    high = min(len(text) if high < 0 else high, b + ADDRESS_ON)
                    if lines and low <= lines[-1][1]:  # one stretch, so that no address is cut at the end of the first
                        lines[-1] = (lines[-1][0], max(high, lines[-1][1]))
                    else:
                        lines.append((low, high))
                    seen_line = a + 1
        done = -1
        for low, high in lines:
            for m in _ADDRESSES.finditer(text, max(low, 0), high):
                if m.start() > done and (m.start() == 0 or text[m.start() - 1] not in ".-/@"):
                    spans.append((*m.span(), "address"))
                    done = m.end()
        if _has_digit(text):
            for m in _PHONE.finditer(text):
                if not _NUMBERED.search(text[max(0, m.start() - 12) : m.start()]) and 7 <= sum(c.isdigit() for c in m.group()) <= 20:
                    spans.append((*m.span(), "phone"))
            for q in _PHONE_EQ.finditer(text):
                m = _PHONE_ANY.match(text, q.start())
                if m and 7 <= sum(c.isdigit() for c in m.group()) <= 20:
                    spans.append((*m.span(), "phone"))
        order = {"email": 0, "national_id": 1, "phone": 2, "address": 3}
        spans.sort(key=lambda s: (order[s[2]], s[0]))
        kept: list[tuple[int, int, str]] = []
        taken: list[tuple[int, int]] = []
        for s in spans:
            k = bisect.bisect_left(taken, (s[0], s[1]))
            if (k and taken[k - 1][1] > s[0]) or (k < len(taken) and taken[k][0] < s[1]):
                continue
            taken.insert(k, (s[0], s[1]))
            kept.append(s)
        kept += [(a, b, "name") for a, b in self._names(text, taken)]
        return sorted(kept)


_PHONE_ANY = stdre.compile(_PHONE.pattern.replace(r"(?<![\w.@/+%=-])(?<!\d )", ""))
_CALLED = stdre.compile(r"(?:\+|\()?\d(?:[ ().-]{0,2}\d)*")
_NO_BLANK = stdre.compile(r"\S*")
_has_digit = stdre.compile(r"\d{3}|\d[ .]\d").search


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for a, b, kind in spans:
        out += [text[at:a], PLACEHOLDER[kind]]
        at = b
    return "".join([*out, text[at:]])


_WORD = re.compile(r"\p{L}+")
#: Words in small letters that are no part of an address.
_SMALL = re.compile(r"(?<![\w.@+-])\p{Ll}+(?!\w|[@+-]|\.\w|\s?[(\[]at[)\]]|\s\.\s)")


def train_surnames(pages: DataFrame, *, bound: int = SAMPLE_PAGES) -> SurnameModel:
    """Fit on the titles of about ``bound`` pages, chosen by the hash of their ids, which show surnames and firms, and on the ordinary words of all bodies.

    Words are counted by the executors over all pages, and a surname of any title is no ordinary word; the driver gets the surnames and firms of the sample and the words
    that are frequent enough to be ordinary, whose number a share of all pages bounds.
    """
    n = pages.count()
    share = min(1.0, bound / max(n, 1))
    least, _ = ordinary_from(n)
    chosen = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30))
    src = pages.select(F.coalesce(chosen, F.lit(False)).alias("chosen"), "type", "title", "slug", F.col("compiled_truth").alias("body"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out: Counter[tuple[str, str]] = Counter()
            for mine, kind, title, slug, body in zip(b["chosen"], b["type"], b["title"], b["slug"], b["body"]):
                if kind in ("person", "company") and (mine or kind == "person"):
                    names = [c[1:] for c in parse(kind, title, slug)[0] if c[0] == "="]
                    out.update(("s", w) for w in names if kind == "person")
                    out.update((kind[0], w) for w in names if mine)
                out.update(("w", w) for w in {plain(w).lower() for w in _WORD.findall(body or "")})
                out.update(("l", w) for w in {plain(w) for w in _SMALL.findall(body or "")})
            yield pd.DataFrame([(k, w, c) for (k, w), c in out.items()], columns=["what", "word", "n"])

    total = [F.coalesce(F.sum(F.when(F.col("what") == k, F.col("n"))), F.lit(0)).alias(k) for k in "pcwls"]
    words = src.mapInPandas(run, "what string, word string, n long").groupBy("word").agg(*total)
    got: dict[str, Counter[str]] = {k: Counter() for k in "pcwl"}
    for r in words.filter(f"p > 0 or c > 0 or (s = 0 and w >= {least})").select("word", "p", "c", F.when(F.col("s") == 0, F.col("w")).alias("w"), "l").collect():
        for k, c in got.items():
            if r[k] and (k in "pc" or (r.w or 0) >= least):
                c[r.word] = r[k]
    return SurnameModel(got["p"], got["c"], got["w"], got["l"], n)


def find_personal(df: DataFrame, id_col: str, fields: list[str], model: SurnameModel, tbl: str) -> DataFrame:
    """One row per text with personal information: tbl, row_id, field, redacted, found (array of kind, start_pos from 1, length).

    Null and empty texts, and texts without personal information, give no row. Texts are read whole. Placeholders replace the found stretches, everything else stays as it is.
    Rows that repeat an id give repeated results; other columns of ``df`` are not looked at.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = Finder(shared.value)
        for b in batches:
            rows = []
            for field in fields:
                for i, t in zip(b["row_id"], b[field]):
                    if t and (spans := finder.find(t)):
                        rows.append((i, field, redact(t, spans), [{"kind": k, "start_pos": s + 1, "length": e - s} for s, e, k in spans]))
            yield pd.DataFrame(rows, columns=["row_id", "field", "redacted", "found"])

    src = df.select(F.col(id_col).cast("long").alias("row_id"), *fields)
    got = src.mapInPandas(run, "row_id long, field string, redacted string, found array<struct<kind string, start_pos int, length int>>")
    return got.select(F.lit(tbl).alias("tbl"), "*")
