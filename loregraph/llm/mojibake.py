"""Text garbled by a wrong character decoding: detection, the encoding chain, restoration.

A multinomial classifier over hashed byte bigrams is trained on words of the corpus itself and on the same words garbled synthetically through every
chain. It names the chain of each suspicious word; the chain is inverted and the inversion must decode strictly. Text spoilt beyond restoration
(replacement characters, words that lost bytes) is reported as lost places.
"""

from __future__ import annotations

import math
import re as stdre
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex as re
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Documents that the classifier is fitted on at most; everything else covers all rows.
SAMPLE_DOCS = 8_000
#: Words of these documents that the driver fits on at most, the most frequent first.
SAMPLE_WORDS = 200_000
BUCKETS, SMOOTHING = 1 << 15, 0.05
#: Nats by which a chain must beat the reading as correct text: for chains from UTF-8, whose strict decoding is evidence of its own, and for the others; a word whose own
#: evidence is weaker counts if the document holds a word of the same chain that reaches the limit.
MARGIN_UTF8, MARGIN_BYTE, MARGIN_WEAK = -2.0, 6.0, 1.0
#: Nats a character by which a word restored through a chain from a single-byte encoding must look more like correct text than it did.
MARGIN_CLEAN = 2.0
#: Nats by which a chain from UTF-8 must beat the reading as correct text for a word that it no longer decodes, because bytes were dropped, to count as garbled beyond restoration.
MARGIN_STRAY = 9.0
RARER = 10

# Fixed values: (encoding of the bytes, encoding they were wrongly read in), applied from left to right.
_ONE = [
    *(("utf-8", w) for w in ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1250", "iso8859-2", "cp1251", "koi8-r", "cp866", "iso8859-15")),
    *(("cp1252", w) for w in ("mac_roman", "cp437", "cp850", "cp1250", "cp1251", "koi8-r", "iso8859-2")),
    *(("mac_roman", w) for w in ("cp1252", "latin-1")),
    *(("cp850", w) for w in ("cp1252", "mac_roman")),
    *(("cp437", w) for w in ("cp1252",)),
    *(("cp1250", w) for w in ("cp1252", "mac_roman", "cp850", "cp1251", "cp852", "iso8859-2")),
    *(("iso8859-2", w) for w in ("cp1252", "cp1250", "mac_roman")),
    *(("cp1251", w) for w in ("cp1252", "latin-1", "mac_roman", "koi8-r", "cp866", "cp1250")),
    *(("koi8-r", w) for w in ("cp1251", "cp1252", "latin-1", "cp866")),
    *(("cp866", w) for w in ("cp1251", "cp1252", "koi8-r")),
]
CHAINS: list[tuple[tuple[str, str], ...]] = [(c,) for c in _ONE] + [(("utf-8", a), ("utf-8", b)) for a in ("cp1252", "latin-1", "mac_roman", "cp850", "cp437", "cp1250", "cp1251") for b in ("cp1252", "latin-1", a) if b == a or a in ("cp1252", "latin-1")]
CHAINS = list(dict.fromkeys(CHAINS))
_UTF8 = [c[0][0] == "utf-8" for c in CHAINS]
_FROM_UTF8 = np.array(_UTF8)
NAMES = [">".join(f"{r}:{w}" for r, w in c) for c in CHAINS]

_WORD = stdre.compile(r"(?<![^ \t\r\n])[!-~]*+[^\x00-\x7f][^ \t\r\n]*")
_RUN = stdre.compile(r"[^\x00-\x7f]+")
_BAD = re.compile(r"[\ufffd\p{Cn}\x80-\x9f]")
_LOST = stdre.compile("\ufffd+")
#: A letter beside a sign that is none of a word: both halves of what was one character.
_STRAY = re.compile(r"[^\x00-\x7f](?<=\p{L})[^\x00-\x7f\p{L}\p{M}\s\ufffd]")
_INVISIBLE = "\xa0\xad"


@lru_cache(maxsize=None)
def _decoding(encoding: str) -> tuple[str, ...]:
    """A character for each byte, undefined bytes read as the control of that number, as browsers and most converters do."""
    return tuple(bytes([b]).decode(encoding, "ignore") or chr(b) for b in range(256))


@lru_cache(maxsize=None)
def _encoding(encoding: str) -> dict[str, int]:
    return {c: b for b, c in reversed(list(enumerate(_decoding(encoding))))}


def garble(text: str, chain: tuple[tuple[str, str], ...]) -> str | None:
    """``text`` as it comes out of the chain; None if it can't have gone through it."""
    for right, wrong in chain:
        if right == "utf-8":
            raw = text.encode("utf-8")
        else:
            table = _encoding(right)
            if any(c not in table for c in text):
                return None
            raw = bytes(table[c] for c in text)
        table = _decoding(wrong)
        text = "".join(table[b] for b in raw)
    return text


def invert(text: str, chain: tuple[tuple[str, str], ...]) -> str | None:
    """The text that the chain garbled to ``text``; None unless every step can be undone strictly."""
    for right, wrong in reversed(chain):
        table = _encoding(wrong)
        if any(c not in table for c in text):
            return None
        raw = bytes(table[c] for c in text)
        try:
            text = raw.decode("utf-8") if right == "utf-8" else "".join(_decoding(right)[b] for b in raw)
        except UnicodeDecodeError:
            return None
    return text


def _features(word: str) -> list[int]:
    """Hashed bigrams of the bytes of a word and its edges, of those with a byte outside ASCII."""
    raw = b"\x02" + word.encode("utf-8", "surrogatepass") + b"\x03"
    return [(a * 257 + b) % BUCKETS for a, b in zip(raw, raw[1:]) if a > 127 or b > 127]


class Classifier:
    """Multinomial model of the classes: correct text, then the chains in order."""

    def __init__(self, words: Counter[str]) -> None:
        counts = np.zeros((len(CHAINS) + 1, BUCKETS))
        for word, n in words.items():
            weight = math.sqrt(n)
            for k, chain in enumerate([(), *CHAINS]):
                g = garble(word, chain)
                if g is not None and (not k or g != word):
                    for f in _features(g):
                        counts[k, f] += weight
        self.singles = {w for w in words if len(w) == 1}
        share = counts.sum(axis=1)  # a chain that few words of the corpus can go through is the less likely
        self.prior = np.log((share + 1) / (share[0] + 1))
        counts += SMOOTHING * (share[:, None] + 1) / (share[0] + 1)  # an unseen bigram is as unlikely in a small class as in a large one
        self.log = np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)

    def scores(self, word: str) -> np.ndarray:
        """Log-likelihoods by class, with the priors of the chains."""
        return self.log[:, _features(word)].sum(axis=1) + self.prior

    def clean(self, word: str) -> float:
        """Log-likelihood of the word as correct text, for each of its characters outside ASCII."""
        f = _features(word)
        return float(self.log[0, f].sum()) / sum(c > "\x7f" for c in word) if f else -6.0


def words_of(text: str) -> list[str]:
    return _WORD.findall(text)


def _candidates(word: str) -> list[tuple[int, str]]:
    out = []
    for k, chain in enumerate(CHAINS):
        r = invert(word, chain)
        if r is None or r == word or _BAD.search(r):
            continue
        if chain[0][0] != "utf-8" and any(c in _INVISIBLE and d.isalpha() for c, d in zip(word, r)):
            continue  # a hard space or soft hyphen is what it looks like
        out.append((k, r))
    return out


class Restorer:
    """Reads documents word by word; what it found out about a word is kept, for words recur."""

    def __init__(self, model: Classifier, keep: int = 200_000) -> None:
        self.model, self.keep, self.known = model, keep, {}
        self.floor = float(model.log[0].min())

    def read(self, word: str) -> list[tuple[int, str, float, float]]:
        """For each chain that may have led to the word: its number, the word restored, the nats by which it beats the reading as correct text, and its value.

        The value adds how much like correct text the restored word looks.
        """
        if word in self.known:
            return self.known[word]
        out = []
        if found := _candidates(word):
            s, as_is = self.model.scores(word), self.model.clean(word)
            for k, r in found:
                clean = self.model.clean(r)
                if _UTF8[k] or clean >= as_is + MARGIN_CLEAN:
                    out.append((k, r, gain := float(s[k + 1] - s[0]), gain + clean - self.floor))
        if len(self.known) >= self.keep:
            self.known.clear()
        self.known[word] = out
        return out

    def restore(self, text: str) -> tuple[str, list[str], int]:
        """The text with its garbled words restored, the chains found, the number of places that stay garbled.

        The chain with the highest value over the whole document goes first; words it does not explain are left to the next one.
        """
        spans = [(m.start() + a, m.start() + b, got) for m in _WORD.finditer(text) for a, b, got in self._spans(m.group())]
        fixes, used = [], []
        while spans:
            value, best = Counter(), Counter()
            strong = defaultdict(set)
            for a, b, got in spans:
                for k, _, gain, worth in got:
                    if gain >= (MARGIN_UTF8 if _UTF8[k] else MARGIN_WEAK):
                        value[k] += worth
                        if b - a == 1 and text[a:b] in self.model.singles:
                            continue  # it has no neighbours to tell by
                        best[k] = max(best[k], gain)
                        if gain >= MARGIN_BYTE / 2:
                            strong[k].add(text[a:b])
            able = [k for k in value if _UTF8[k] or best[k] >= MARGIN_BYTE or len(strong[k]) >= 3]
            if not able:
                break
            first = max(able, key=lambda k: (value[k], -k))
            used.append(NAMES[first])
            rest = []
            for a, b, got in spans:
                mine = next((r for k, r, gain, _ in got if k == first and gain >= (MARGIN_UTF8 if _UTF8[k] else MARGIN_WEAK)), None)
                if mine is None:
                    rest.append((a, b, got))
                else:
                    fixes.append((a, b, mine))
            spans = rest
        out, at = [], 0
        for a, b, r in sorted(fixes):
            out += [text[at:a], r]
            at = b
        fixed = "".join([*out, text[at:]]) if fixes else text
        strays = sum(self.stray(w) for w in words_of(fixed) if _STRAY.search(w)) if _STRAY.search(fixed) else 0
        return fixed, used, len(_LOST.findall(fixed)) + strays

    def stray(self, word: str) -> bool:
        """Whether a word is the rest of one that a chain from UTF-8 garbled and that lost bytes since: it can't be inverted, but its bigrams are the chain's."""
        s = self.model.scores(word)
        return float(s[1:][_FROM_UTF8].max() - s[0]) >= MARGIN_STRAY

    def _spans(self, word: str) -> Iterable[tuple[int, int, list]]:
        """The word as a whole; if no chain explains it, those of its runs outside ASCII that read as UTF-8: correct and garbled characters may stand in one word."""
        if got := self.read(word):
            return [(0, len(word), got)]
        runs = [m.span() for m in _RUN.finditer(word)]
        if len(runs) > 1 or (runs and runs[0] != (0, len(word))):
            return [(a, b, got) for a, b in runs if b - a > 1 and (got := [x for x in self.read(word[a:b]) if _UTF8[x[0]]])]
        return []


def fit(words: Counter[str]) -> Classifier:
    """Fit on the counted words of texts, most of which must be correct.

    Words that read as UTF-8, and words that some chain turns into a word ``RARER`` times as frequent, are no examples of correct text.
    """
    plain = {w: n for w, n in words.items() if not any((_UTF8[k] and r.isprintable()) or words[r] >= RARER * n for k, r in _candidates(w))}
    return Classifier(Counter(plain))


def train(texts: Iterable[str]) -> Classifier:
    return fit(Counter(w for t in texts if t and "\ufffd" not in t for w in words_of(t)))


def sample_words(df: DataFrame, id_col: str, text_col: str, bound: int = SAMPLE_DOCS, most: int = SAMPLE_WORDS) -> Counter[str]:
    """The words of about ``bound`` documents, chosen by the hash of their ids, counted by the executors; the driver gets the ``most`` most frequent of them."""
    share = min(1.0, bound / max(df.count(), 1))
    src = df.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).filter(F.col("t").rlike(r"[^\x00-\x7F]") & ~F.col("t").contains("\ufffd"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            c = Counter(w for t in b["t"] for w in words_of(t))
            yield pd.DataFrame({"word": list(c), "n": list(c.values())})

    chosen = src.filter(F.coalesce(F.pmod(F.xxhash64("i"), F.lit(1 << 30)), F.lit(0)) < int(share * (1 << 30)))
    counted = chosen.select("t").mapInPandas(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return Counter({r.word: r.n for r in counted.orderBy(F.desc("n"), "word").limit(most).collect()})


def restore_documents(df: DataFrame, id_col: str, text_col: str, *, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """One row per affected document: doc_id, chains (found), restored_text, lost (places that can't be restored).

    Null, empty and correct texts give no row. A document that holds a replacement character, or a garbled word that lost bytes, is affected though it can't be restored
    there; the rest of its text is. Repeated rows give repeated results; other columns of ``df`` are not looked at. An empty table gives an empty result.
    """
    spark = df.sparkSession
    model = spark.sparkContext.broadcast(fit(sample_words(df, id_col, text_col, sample_docs)))  # len(CHAINS) x BUCKETS floats, whatever the data

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Restorer(model.value)
        for b in batches:
            got = [(i, *reader.restore(t)) for i, t in zip(b["doc_id"], b["t"])]
            yield pd.DataFrame([(i, chains, fixed, lost) for i, fixed, chains, lost in got if chains or lost], columns=["doc_id", "chains", "restored_text", "lost"])

    src = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t")).filter(F.col("t").rlike(r"[^\x00-\x7F]"))
    return src.mapInPandas(run, "doc_id long, chains array<string>, restored_text string, lost int")
