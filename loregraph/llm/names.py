"""Variant spellings of persons and organisations: merge-and-rematch resolution.

Titles and slugs are parsed to profiles: the rare part of a name (surname, head word), the frequent part (given name, branch), initials. Profiles that share a
blocking key and agree are merged; a merged profile has all spellings and initials of its parts and blocks again, until nothing merges any more.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex as re
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loregraph.operators.graph import both_directions, connected_components
from loregraph.session import broadcast_if_small, checkpointed, spread

# Short and familiar forms of given names, by full form.
SHORT_FORMS = """
alexander: alex al sandy xander lex sasha alec; alexandra: alex sandra lexi sasha; andrew: andy drew; anthony: tony; benjamin: ben benny; catherine: cathy kate cat; charles: charlie chuck chas chip;
charlotte: lottie charlie; christopher: chris kit; daniel: dan danny; david: dave davy; deborah: deb debbie debby debra; dominic: dom nic dominick; dorothy: dot dolly; edward: ed eddie eddy ted ned teddy;
eleanor: nell ellie nora; elizabeth: liz beth lizzie eliza betty lisa betsy libby; emily: em emmy; frances: fran frannie francie fanny frankie; frederick: fred freddie; gabriel: gabe; george: georgie; grace: gracie;
gregory: greg gregg; henry: harry hank hal; ingrid: inga inge; isabella: bella izzy isa izzie isabel; jacob: jake; james: jim jimmy jamie; jennifer: jen jenny jenn jenna; jessica: jess jessie; john: jack johnny; jonathan: jon;
joseph: joe joey jo; joshua: josh; katherine: kate kathy kat katie kathryn kitty kay katharine; kenneth: ken; lawrence: larry laurie lars lawrie; leonard: leo len; margaret: meg peggy maggie marge margie greta madge; mark: marc marky; martin: marty;
matthew: matt; michael: mike mick mikey micky; nicholas: nick nicky nico nicolas; oliver: ollie olly noll; patricia: pat patty trish tricia patsy; patrick: pat paddy; penelope: penny nell pen; peter: pete; philip: phil; quentin: quin quint; rebecca: becky;
richard: rick dick rich; robert: rob bob bobby robbie bert; rose: rosie rosy rosa; samuel: sam; stephen: steve; susannah: sue susie suzy susanna susan sukie; theodora: dora theo thea teddy; theodore: ted theo; thomas: tom tommy; timothy: tim;
ursula: ulla uschi ursa ursel sula; victoria: vicky tori vicki vic vikki; vincent: vince vin vinnie vinny; walter: walt; wilhelmina: willa mina billie wilma minnie helma; william: will bill billy liam willy; yvonne: evi vonnie evie yvi eve; zachary: zach zack zac zak zeke;
aaron:; abigail: abby gail; adam:; adrian:; agnes:; alan: allan; albert: bertie; alfred: alfie; alice:; amanda:; angela: angie; arthur: artie; barbara: barb babs;
beatrice: bea trixie; bernard:; brenda:; brian: bryan; bridget: bridie; bruce:; caroline: carrie carolyn; cecilia: cecily; christine:; colin:; cynthia: cindy; dennis:;
diana: diane; donald:; douglas: doug; duncan:; edith:; edmund:; edwin:; ernest: ernie; esther:; eugene:; evelyn:; felix:; fiona:; geoffrey: geoff jeff jeffrey;
gerald: gerry; gertrude: trudy; gilbert: gil; gordon:; hannah:; harold:; harriet: hattie; helen: helena; herbert: herb; howard: howie; hugh:; ian:; irene:; isaac: ike;
janet:; jeremy:; judith: judy; julia: julie; karen:; kevin: kev; laura:; linda:; louis: lewis; lucy:; lydia:; malcolm:; marcus:; maurice:; maximilian:; melanie:;
miriam:; monica:; nancy:; naomi:; natalie:; nathaniel: nathan; norman:; olivia: livvy; oscar:; pamela: pam; paul:; rachel:; ralph:; raymond:; reginald: reg reggie;
roger:; roland:; rosemary:; russell: russ; ruth:; sarah: sadie; sebastian: seb; simon:; sophia: sophie; stanley: stan; stuart: stewart; sylvia:; teresa: theresa;
terence:; tobias:; valerie: val; vanessa: nessa; veronica:; wendy:; winifred:; xavier:; agnieszka: aga; birgit:; carlos:; carmen:; chantal:; dieter:; diego:;
dmitri: dmitry dima; dolores: lola; francisco: paco; francois:; gunter: guenter; heike:; heinrich: heinz; ivan:; jacques:; jorge:; juan:; jurgen: juergen;
katarzyna: kasia; klaus:; krzysztof:; malgorzata: gosia; matthias:; miguel:; mikhail: misha; olga:; pablo:; pawel:; philippe:; pierre:; piotr:; sabine:; sergei: sergey;
stefan:; svetlana:; tatiana: tanya; thierry:; tomasz:; ulrike:; vladimir: volodya; wojciech:; wolfgang:; yuri:
"""
# Branch words of firm names with their abbreviations.
BRANCHES = """
analytics: analytic analytx anlytcs; capital: cap captl cptl; consulting: consult; energy: enrgy nrg; engineering: eng engg; foods: food fds; health: healthcare hlth hlthcare; holdings: holding hldgs; industries: industry ind inds;
international: intl int'l int l; laboratories: labs lab laboratory; logistics: logis lgstcs logistic; manufacturing: mfg manuf mnfg; materials: matls mat material mtrls matl; media: med; partners: ptnrs partner prtnrs ptrs;
robotics: rob robotic rbtcs robo; services: svc svcs service; software: sw softw sftw soft; solutions: soln solns solution; systems: sys system syst; technologies: tech technology techs technol; ventures: venture vent
"""
LEGAL = "inc ltd limited llc plc gmbh ag sa bv nv co corp corporation company incorporated the and spa srl kg ohg oy ab as se sas sarl pty lp llp group kk"
TITLES = "mr mrs ms miss mx dr prof professor sir dame dipl ing herr frau mme mlle m.sc rev hon"
DEGREES = "phd mba md jd esq msc ma ba bsc cfa cpa jr sr ii iii"
LEGAL, TITLES, DEGREES = (frozenset(x.split()) for x in (LEGAL, TITLES, DEGREES))


def _table(text: str) -> dict[str, frozenset[str]]:
    out: dict[str, set[str]] = {}
    for entry in text.split(";"):
        full, _, short = entry.partition(":")
        for w in [full, *short.split()]:
            out.setdefault(w.strip(), set()).add(full.strip())
    return {k: frozenset(v) for k, v in out.items() if k}


GIVEN, BRANCH = _table(SHORT_FORMS), _table(BRANCHES)


def deletions(word: str) -> set[str]:
    """The word and all words with one character less: two words share one if they are one edit, or a swap of neighbours, apart."""
    return {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))} if len(word) > 3 else {word}


def close(a: str, b: str) -> bool:
    """At most one edit or swap of neighbours apart."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    return a[k + 1 :] == b[k + 1 :] or a[k:] == b[k + 1 :] or a[k + 1 :] == b[k:] or (a[k : k + 2] == b[k : k + 2][::-1] and len(b[k : k + 2]) == 2 and a[k + 2 :] == b[k + 2 :])


def _near(table: dict[str, frozenset[str]]) -> dict[str, set[str]]:
    near: dict[str, set[str]] = {}
    for w in table:
        if len(w) > 3:
            for d in deletions(w):
                near.setdefault(d, set()).add(w)
    return near


_NEAR = {id(t): _near(t) for t in (GIVEN, BRANCH)}


@lru_cache(maxsize=100_000)
def _lookup(word: str, branch: bool) -> frozenset[str]:
    """The full forms a word may stand for, with one typing error in longer words."""
    table = BRANCH if branch else GIVEN
    if word in table:
        return table[word]
    if len(word) < 4:
        return frozenset()
    near = _NEAR[id(table)]
    found = {w for d in deletions(word) for w in near.get(d, ()) if close(w, word)}
    return frozenset(f for w in found for f in table[w])


_MARKS = re.compile(r"(?<=\p{Latin}\p{Mn}*)\p{Mn}")


def plain(text: str) -> str:
    """Compatibility forms without the accents of Latin letters; marks of other scripts, where they make another letter, stay."""
    if text.isascii():
        return text
    return unicodedata.normalize("NFC", _MARKS.sub("", unicodedata.normalize("NFKD", text))).replace("ß", "ss").replace("ø", "o").replace("ł", "l").replace("Ł", "L").replace("Ø", "O")


_SOUNDS = [(re.compile(p), r) for p, r in (("sch", "sh"), ("zh", "j"), ("ph", "f"), ("ch", "C"), ("sh", "S"), ("c", "k"), ("ck|kk", "k"), ("q", "k"), ("z", "s"), ("w", "v"), ("ei|ai|ay|ey|ie|y", "i"), ("ou|ow|ov|oo", "u"), (r"(.)\1+", r"\1"))]


@lru_cache(maxsize=200_000)
def sound(word: str) -> str:
    """A spelling in which letters that are heard alike are written alike."""
    for p, r in _SOUNDS:
        word = p.sub(r, word)
    return word


_NOTE = re.compile(r"\[[^\]]*\]|\([^)]*\)|\s[–—-]\s.*$|[?*!]+")
_CAMEL = re.compile(r"(?<=\p{Ll})(?=\p{Lu})")
#: Firms written by their initials alone: where the slug tells no name either, three initials or more agree if they are equal; two tell too little.
_ACRONYM = re.compile(r"(\p{Lu}{2,5})(?: (?:Group|Inc|Ltd|LLC|AG|GmbH|SA|plc|Corp)\.?)?")
_HASH = re.compile(r"^[a-z]-[0-9a-f]{8}(?:-|$)")


_LETTERS = re.compile(r"[\p{L}\p{M}]+(?:'[\p{L}\p{M}]+)*")


def _tokens(text: str) -> list[str]:
    return _LETTERS.findall(text.lower())


def _initial(word: str) -> bool:
    """A single letter of a script that has capitals; a single sign of another script is a name."""
    return len(word) == 1 and word.upper() != word


def _person(tokens: list[str], surname_first: bool) -> tuple[set[str], set[str], set[str]]:
    """Surnames, given names, first initials."""
    words = [w for w in tokens if not _initial(w)]
    letters = [w for w in tokens if _initial(w)]
    known = [w for w in words if _lookup(w, False)]
    if not words:
        return set(), set(), set()
    if len(words) == 1:
        w = words[0]
        if letters:  # the initials go with a surname
            return {w}, set(), {letters[0]}
        return (set(), {w}, set()) if known else ({w}, set(), set())
    exact = [w for w in words if w in GIVEN]
    given = (exact or known or [words[-1] if surname_first else words[0]])[0]
    rest = [w for w in words if w is not given]
    return {rest[0] if surname_first else rest[-1]}, {given}, set()


def _firm(tokens: list[str]) -> tuple[set[str], set[str], set[str]]:
    """Head words, branches, no initials."""
    words = [w for w in tokens if w.replace("'", "") not in LEGAL and (not _initial(w) or w in BRANCH)]
    branch = [w for w in words if w in BRANCH] or [w for w in words if _lookup(w, True)][-1:]
    rest = [w for w in words if w not in branch]
    if not rest:
        return set(), set(), set()
    head = max(rest, key=len)
    return ({head} if len(head) > 3 or not head.isascii() else set()), {*branch[:1], *(w for w in rest if w != head and len(w) > 3)}, set()


def parse(kind: str, title: str | None, slug: str | None) -> tuple[list[str], list[str], list[str]]:
    """Rare parts (as heard, after an equals sign as written, after a number sign initials of a firm), frequent parts (full forms) and initials that title and slug show together."""
    firm = kind == "company"
    cores: set[str] = set()
    gives: set[str] = set()
    inits: set[str] = set()
    acronym = None

    def take(tokens: list[str], surname_first: bool = False) -> None:
        c, g, i = _firm(tokens) if firm else _person(tokens, surname_first)
        for w in c:
            cores.update((sound(w), "=" + w))
        for w in g:
            gives.update(_lookup(w, firm) or {w})
        inits.update(i)

    if title:
        t = _NOTE.sub(" ", plain(title)).strip(" ,;:-–—")
        if firm:
            t = re.sub(r"(?i)\b(?:s\.a\.|b\.v\.|n\.v\.)", " ", t)
            acronym = _ACRONYM.fullmatch(t)
            if not acronym:
                take([x for w in t.split() for x in ([w] if w.isupper() else _CAMEL.split(w)) for x in _tokens(x)])
        else:
            t = re.sub(r"(?i)(?:^|\s)(?:dipl\.-ing\.)", " ", t)
            head, _, tail = t.partition(",")
            degrees = _tokens(tail.replace(".", ""))
            surname_first = bool(tail.strip()) and not all(w in DEGREES for w in degrees)
            text = t if surname_first else head
            tokens = [x for w in text.split() for x in ([w] if w.isupper() else _CAMEL.split(w)) for x in _tokens(x)]
            tokens = [w for w in tokens if w not in TITLES and w not in DEGREES]
            if len(tokens) == 1 and t.isascii() and t.islower() and not _lookup(tokens[0], False) and len(tokens[0]) > 4:
                cores.update((sound(tokens[0][1:]), "=" + tokens[0][1:]))  # an account name: initial and surname
                inits.add(tokens[0][0])
            elif tokens:
                take(tokens, surname_first)
    if slug:
        s = plain(slug.rpartition("/")[2]).lower()
        if not _HASH.match(s):
            parts = s.split("-")
            while len(parts) > 1 and re.fullmatch(r"\d+|[0-9a-f]{1,4}", parts[-1]) and (len(parts) > 2 or not parts[-1].isalpha()):
                parts.pop()
            if firm:
                parts = re.sub(r"\bint l\b", "intl", " ".join(parts)).split()
                take([w for w in parts if w])
            else:
                take([w for w in parts if w.isalpha()])
    if acronym and not cores and len(acronym.group(1)) > 2:
        cores.add("#" + acronym.group(1).lower())
    inits.update(g[0] for g in gives if not firm)
    return sorted(cores), sorted(gives), sorted(inits)


_PROFILE = "kind string, cores array<string>, gives array<string>, inits array<string>"


def _profiles(df: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [parse(k, t, s) for k, t, s in zip(b["kind"], b["title"], b["slug"])]
            yield pd.DataFrame({"page_id": b["page_id"], "kind": b["kind"], "cores": [g[0] for g in got], "gives": [g[1] for g in got], "inits": [g[2] for g in got]})

    return df.mapInPandas(run, f"page_id long, {_PROFILE}")


def agreement_keys(word: str) -> set[str]:
    """Keys of a word such that two words of which one has a key with a 1 and the other the same key, with 1 or 0, are close: the word itself, its deletions
    by place (one letter differs), the word with two neighbours in order (a swap), and with 0 its deletions (one letter more than a word). Words that share a key
    with a 1 are all close to each other, so that one of them can stand for the others. A sign before the word says how it is written; initials of firms have one key.
    """
    sign, bare = (word[0], word[1:]) if word[:1] in ("=", "#") else ("", word)
    keys = {f"1+{sign}{bare}"}
    if len(bare) > 3 and sign != "#":
        for i in range(len(bare)):
            d = bare[:i] + bare[i + 1 :]
            keys |= {f"0+{sign}{d}", f"1{i}~{sign}{d}"}
        for i in range(len(bare) - 1):
            keys.add(f"1{i}^{sign}{bare[:i]}{''.join(sorted(bare[i : i + 2]))}{bare[i + 2 :]}")
    return keys


#: How an entity has a key: as a weak one, as a strong one (with a 1), as the word as written.
WEAK, STRONG, WRITTEN = 0, 1, 2


def _key_rows(p: DataFrame, tags: str) -> DataFrame:
    """(key, entity, how): the keys of every rare part of an entity together with each of its ``tags`` (an array column), as hashes of 64 bits made in Python, so that
    neither spellings nor keys go through a shuffle.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keys, entities, hows = [], [], []
            for entity, kind, cores, tags_ in zip(b["entity"], b["kind"], b["cores"], b["tags"]):
                mine: dict[str, int] = {}
                for c in cores:
                    for k in agreement_keys(c):
                        how = WRITTEN if k[:2] == "1+" and c[0] in "=#" else int(k[0])
                        mine[k[1:]] = max(how, mine.get(k[1:], 0))
                for t in tags_:
                    seed = xxhash.xxh64_intdigest(f"{kind}|{t}")
                    keys += [xxhash.xxh64_intdigest(k, seed) for k in mine]
                    entities += [entity] * len(mine)
                    hows += mine.values()
            yield pd.DataFrame({"key": np.array(keys, np.uint64).view(np.int64), "entity": np.array(entities, np.int64), "how": np.array(hows, np.int8)})

    src = p.select("entity", "kind", "cores", F.expr(tags).alias("tags")).filter("size(tags) > 0")
    return spread(src).mapInPandas(run, "key long, entity long, how byte")


def _same_key(rows: DataFrame) -> DataFrame:
    """(src, dst): every entity of a key and the first of those that have it as a strong one. Nothing is paired within a key, and every two entities that agree are linked, for
    the words of one edit, or swap, meet in a key of which one has the strong form.
    """
    first = F.min(F.when(F.col("how") > WEAK, F.col("entity"))).over(Window.partitionBy("key"))
    return rows.withColumn("dst", first).filter("dst <> entity").select(F.col("entity").alias("src"), "dst")


def _full_edges(p: DataFrame) -> DataFrame:
    """Full names: the same frequent part and a rare part one edit apart."""
    return _same_key(_key_rows(p, "transform(gives, x -> concat('g', x))"))


def _lean_edges(p: DataFrame) -> DataFrame:
    """Names without the frequent part go to the only entity that has the rare part and the initial, as written before one edit apart, or among themselves if there is none."""
    asks = checkpointed(_key_rows(p.filter("size(gives) = 0"), "if(size(inits) > 0, transform(inits, x -> concat('i', x)), array('i'))"))
    wanted = broadcast_if_small(asks.select("key").distinct(), 1_000_000)
    owners = _key_rows(p.filter("size(gives) > 0"), "array_append(transform(inits, x -> concat('i', x)), 'i')").join(wanted, "key", "left_semi")
    strong = F.when(F.col("how") > WEAK, F.col("entity"))
    one = owners.groupBy("key").agg(F.min("entity").alias("lo"), F.max("entity").alias("hi"), F.min(strong).alias("lo1"), F.max(strong).alias("hi1"))
    # only owners that agree are counted; an entity counts as having no owner only if none of its keys has one
    pick = lambda c: F.when(F.col("how") > WEAK, F.col(c)).otherwise(F.col(c + "1"))
    same = lambda c: F.when(F.col("how") == WRITTEN, F.col(c + "1"))
    owned = asks.join(one, "key", "left").groupBy("entity").agg(F.coalesce(F.min(same("lo")), F.min(pick("lo"))).alias("lo"), F.coalesce(F.max(same("hi")), F.max(pick("hi"))).alias("hi"))
    owned = checkpointed(owned)
    free = asks.join(owned.filter("lo is null").select("entity"), "entity", "left_semi")
    return owned.filter("lo = hi").select(F.col("entity").alias("src"), F.col("lo").alias("dst")).union(_same_key(free))


def _merge(p: DataFrame, comp: DataFrame) -> DataFrame:
    """Entities of a component become one, with all their spellings and initials; their number is bounded by the ways to write a name, not by the pages."""
    j = p.join(comp, p.entity == comp.node, "left").withColumn("entity", F.coalesce("component", "entity"))
    flat = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c)
    return j.groupBy("entity").agg(F.first("kind").alias("kind"), flat("cores"), flat("gives"), flat("inits"))


def resolve_entities(df: DataFrame, *, id_col: str = "id", title: str = "title", slug: str = "slug", kind: str = "type") -> DataFrame:
    """(page_id, entity_id): one row per page; pages of one entity share the smallest page id of it.

    ``kind`` tells persons from companies ("company"); entities never mix kinds, a null kind counts as one of its own. A page whose title and slug tell no surname or head word (null, empty, a
    given name or initials alone) stays by itself, unless it is written exactly like another page that tells one. Names of any script are read; equal initials of firms, three or more, are one firm.
    Equally parsed pages are one profile from the start, so that a name repeated on millions of pages costs as much as one. Names that fit several entities alike stay by themselves.
    Rounds go on until nothing merges: every round leaves fewer entities than it found. Full names are merged to the end before lean ones ask for their only owner; an owner
    that gained spellings blocks again. A repeated id gives one row for each way its rows are written. Other columns of ``df`` are not looked at.
    """
    src = df.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(kind), F.lit("")).alias("kind"), F.col(title).alias("title"), F.col(slug).alias("slug")).filter("page_id is not null")
    keys = ["kind", "cores", "gives", "inits"]
    pages = checkpointed(_profiles(src).withColumn("h1", F.xxhash64(*keys)).withColumn("h2", F.xxhash64(F.lit(7), *keys)))
    named = pages.filter(F.size("cores") > 0)
    nodes = checkpointed(named.groupBy("h1", "h2").agg(F.min("page_id").alias("entity"), *[F.first(k).alias(k) for k in keys]))
    p, merges, lean = nodes.select("entity", *keys), [], False
    while True:
        edges = both_directions(_lean_edges(p) if lean else _full_edges(p))
        if edges.limit(1).count():
            merges.append(connected_components(edges, prepared=True))
            p, lean = checkpointed(_merge(p, merges[-1])), False
        elif lean:
            break
        else:
            lean = True
    home = nodes.select("h1", "h2", "entity")
    for comp in merges:
        home = home.join(comp, home.entity == comp.node, "left").select("h1", "h2", F.coalesce("component", "entity").alias("entity"))
    return pages.select("page_id", "h1", "h2").join(home, ["h1", "h2"], "left").select("page_id", F.coalesce("entity", "page_id").alias("entity_id"))


def same_entity_pairs(members: DataFrame) -> DataFrame:
    """(page_a, page_b), page_a < page_b, of every two pages of an entity."""
    m = members.distinct()
    a, b = (m.select(F.col("page_id").alias(n), "entity_id") for n in ("page_a", "page_b"))
    return a.join(b, "entity_id").filter("page_a < page_b").select("page_a", "page_b")
