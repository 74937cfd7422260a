"""PII surrogates: every detected entity is replaced by a keyed, type-consistent stand-in.

Detection finds e-mail addresses, phone numbers, payment cards, US social security numbers, IBANs, IPv4
addresses and names of persons (a title or a known given name, then a capitalised word). A person's given name
and surname are entities of their own, and once a text has named a person, the same capitalised words are
that person wherever else they stand in it, with or without a title. An entity's canonical form (lower
case, digits only, ...) decides its surrogate, so all mentions of it in the corpus change alike whatever
their punctuation or case: "John Smith", "Mr Smith" and "Smith" keep one surname. Each mention keeps its own format.
Names without a title or a known given name anywhere in their text are not found. Words that open sentences
are no names after a title ("Dr. The report ..."), and a given name behind an article is no further mention ("the Mark").

Surrogates are drawn from a keyed digest of (type, canonical form, attempt): letters become letters of the
same script and case, digits become digits, cards keep their Luhn status and IBANs their check digits' validity,
addresses stay addresses, given names keep their gender where it is known; names are taken from a list, then
made of syllables, more of them with every few attempts, so that they never run out. A draw that equals another
entity's draw of that type, or any entity that occurs in the corpus, is repeated with the next attempt until all
are distinct; these checks are joins over the table of distinct entities, which is never gathered. From the
40th attempt on a surrogate has more letters or digits than its entity, so a type whose forms are all taken still ends.

Null and empty texts have no entity. Documents without an entity are not returned. Repeated rows are
rewritten once each; null ids are kept. Texts are searched whole, in batches of bounded size; one longer than that is a batch. An
empty table gives no rows; columns other than the id and the text are left out, so none can clash.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from heliograph.llm.bloom import maybe_in
from heliograph.llm.common import bound_batches
from heliograph.shared import cut, remove

#: Common given names by gender, and titles.
FEMALE = ["Alice", "Amelia", "Anna", "Barbara", "Camille", "Carmen", "Carol", "Charlotte", "Chloe", "Claire", "Diana", "Elena", "Elizabeth", "Emily", "Emma", "Eva", "Greta", "Hannah", "Helen", "Ingrid", "Isabel", "Jane", "Jennifer", "Julia", "Karen", "Laura", "Linda", "Lucia", "Maria", "Marie", "Mary", "Monica", "Nancy", "Olivia", "Patricia", "Paula", "Rachel", "Sarah", "Sofia", "Sophie", "Susan", "Teresa"]
MALE = ["Adam", "Alexander", "Andrew", "Anthony", "Antonio", "Carlos", "Charles", "Daniel", "David", "Diego", "Edward", "Eric", "Felix", "Francisco", "George", "Hans", "Henry", "Jack", "James", "Jean", "John", "Jonas", "Joseph", "Juan", "Karl", "Kevin", "Louis", "Luis", "Lukas", "Mark", "Martin", "Matthew", "Michael", "Miguel", "Oliver", "Paul", "Peter", "Pierre", "Richard", "Robert", "Thomas", "William"]
TITLES = {"Mr": "m", "Herr": "m", "Monsieur": "m", "Señor": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Frau": "f", "Madame": "f", "Señora": "f", "Dr": "", "Prof": ""}
#: Words that open sentences and are no names, in the corpus' languages, and articles.
ORDINARY = set("""the a an this that these those he she it we they you i his her its our their my your in on at for from with but and or if when then there here what who how why not no yes all
some as by to of is are was were be has have had do does did will would can could may must der die das ein eine einer er sie es wir ich ihr im am und aber wenn nicht auch nach bei mit von zu für
le les un une des il elle nous vous ils elles et mais si dans ce cette ces son sa ses pour avec par sur el los las una él ella nosotros y pero en es son su sus para con por que como""".split())  # fmt: skip
ARTICLES = set("the a an this that der die das den dem ein eine le la les un une el los las una".split())
GENDER = {**{n.lower(): "f" for n in FEMALE}, **{n.lower(): "m" for n in MALE}}

EMAIL = r"(?P<email>[A-Za-z0-9][A-Za-z0-9._%+\-]{0,63}@(?:[A-Za-z0-9\-]{1,63}\.){1,8}[A-Za-z]{2,24}\b)"
IBAN = r"(?P<iban>\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b)"
SSN = r"(?P<ssn>(?<![\d\-.])\d{3}-\d{2}-\d{4}(?![\d\-]))"
IP = r"(?P<ip>(?<![\d.])(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?!\.?\d))"
CARD = r"(?P<card>(?<![\w.\-])\d{4}(?:[ \-]?\d{4}){2}[ \-]?\d{1,7}(?![\w\-]))"
PHONE = r"(?P<phone>(?<![\w.])(?:\+\d{1,3}[ .\-]?)?(?:\(\d{2,4}\)[ .\-]?|\d{2,4}[ .\-])\d{3,4}[ .\-]\d{3,4}(?![\w\-])|(?<![\w.])\+\d{8,15}(?!\w)|(?<![\w.])\+\d{1,3}+(?:[ .\-]\(?\d{1,8}+\)?){1,6}+(?!\w)|(?<![\w.])0\d(?:[ .\-]\d{2}){4}(?![\w\-]))"
NUMERIC = re.compile("|".join([SSN, IP, CARD, PHONE]))
#: Digits, or a plus sign or parenthesis before them, are where a search by NUMERIC is worth its time.
NUMERIC_HINT = re.compile(r"\d[\d.()\- ]{5,}\d")
MAILS, IBANS = re.compile(EMAIL), re.compile(IBAN)
_SURE = "|".join([*FEMALE, *MALE, *(n.upper() for n in [*FEMALE, *MALE])])
#: Syllables of made names (consonant and vowel), and the endings of given names by gender.
CONSONANTS, VOWELS, ENDINGS = "bdfgklmnprstvz", "aeiou", {"f": "a", "m": "n", "": ""}
_WORD = re.compile(r"[^\W\d_]+")
#: A title and one or two capitalised words, or a given name and a capitalised word.
PERSON = re.compile(r"\b(?=[^\W\d_a-z])(?:(?P<title>" + "|".join(TITLES) + r")\.? (?P<first>[^\W\d_a-z][^\W\d_]+)(?: (?P<last>[^\W\d_a-z][^\W\d_]+))?|(?P<given>" + _SURE + r") (?P<family>[^\W\d_a-z][^\W\d_]+))")

#: Code point ranges of letters that are replaced among themselves: (first upper, first lower, count).
SCRIPTS = [(0x41, 0x61, 26), (0x391, 0x3B1, 17), (0x410, 0x430, 32), (0x531, 0x561, 38)]
#: Scripts without case: (first, count).
CASELESS = [(0x5D0, 27), (0x627, 19), (0x905, 53), (0x3041, 86), (0x30A1, 86), (0x4E00, 20_902), (0xAC00, 11_172)]


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = int(ch) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def iban_check(canon: str) -> int:
    """The check digits that make an IBAN of this country and account valid."""
    return 98 - int("".join(str(int(ch, 36)) for ch in canon[4:] + canon[:2] + "00")) % 97


def persons(text: str) -> list[tuple[int, int, str, str]]:
    """Spans of given names and surnames; every further mention of a name that the text has given to a person is one."""
    found, known = [], {}
    for m in PERSON.finditer(text):
        parts = [p for p in ("first", "last", "given", "family") if m.group(p)]
        if m.group("title"):
            if m.group("first").lower() in ORDINARY:
                continue
            if len(parts) == 2 and m.group("last").lower() in ORDINARY:
                parts = ["first"]
        elif m.group("family").lower() in ORDINARY:
            continue
        words = [m.group(p) for p in parts]
        title = TITLES.get(m.group("title") or "", "")
        gender = GENDER.get(words[0].lower(), title)
        for i, (part, word) in enumerate(zip(parts, words)):
            given = i == 0 and (len(words) == 2 or word.lower() in GENDER)
            kind, canon = ("given", f"{gender}|{word.lower()}") if given else ("family", word.lower())
            found.append((*m.span(part), kind, canon))
            known.setdefault(word.lower(), (kind, canon))
    if known:
        before = ""
        for m in _WORD.finditer(text):
            word = m.group().lower()
            if word in known and m.group()[:1].isupper() and not (known[word][0] == "given" and before in ARTICLES):
                found.append((*m.span(), *known[word]))
            before = word
    return found


def entities(text: str | None) -> list[tuple[int, int, str, str]]:
    """(start, end, type, canonical form) of the entities of the whole text, in order, without overlaps."""
    if not text:
        return []
    found: list[tuple[int, int, str, str]] = []
    if "@" in text:
        found += [(*m.span(), "email", m.group().lower()) for m in MAILS.finditer(text)]
    if NUMERIC_HINT.search(text):
        for m in NUMERIC.finditer(text):
            kind = m.lastgroup or ""
            if kind == "phone" and not 7 <= sum(map(str.isdigit, m.group())) <= 15:
                continue
            found.append((*m.span(), kind, m.group() if kind == "ip" else re.sub(r"\D", "", m.group())))
        found += [(*m.span(), "iban", m.group().replace(" ", "")) for m in IBANS.finditer(text)]
    found += persons(text)
    found.sort(key=lambda x: (x[0], -x[1]))
    kept: list[tuple[int, int, str, str]] = []
    for x in found:
        if not kept or x[0] >= kept[-1][1]:
            kept.append(x)
    return kept


class _Draw:
    """Numbers from a keyed digest."""

    def __init__(self, key: bytes, *parts: str):
        self.seed = "\x1f".join(parts).encode("utf-8", "surrogatepass")
        self.key, self.pool, self.n = key, b"", 0

    def below(self, limit: int) -> int:
        if len(self.pool) < 4:
            self.pool = hashlib.blake2b(self.seed + self.n.to_bytes(4, "little"), key=self.key).digest()
            self.n += 1
        value, self.pool = int.from_bytes(self.pool[:4], "little"), self.pool[4:]
        return value % limit

    def letter(self, ch: str) -> str:
        """A letter of the same script and case, a digit for a digit, all else unchanged."""
        if ch.isdecimal():
            return str(self.below(10)) if ch.isascii() else chr(ord(ch) - int(ch) + self.below(10))
        c = ord(ch)
        for upper, lower, n in SCRIPTS:
            if upper <= c < upper + n or lower <= c < lower + n:
                base = upper if c < upper + n and c >= upper else lower
                return chr(base + self.below(n))
        for base, n in CASELESS:
            if base <= c < base + n:
                return chr(base + self.below(n))
        if ch.isalpha():  # accented Latin and the like
            out = chr(0x61 + self.below(26))
            return out.upper() if ch.isupper() else out
        return ch


def _name(draw: _Draw, like: str, attempt: int, known: list[str], ending: str) -> str:
    """A name: of the list at first, then of syllables; letter by letter in other scripts than the Latin one."""
    if known and attempt < 3:
        return known[draw.below(len(known))].lower()
    if not like[:1].isascii():
        return "".join(map(draw.letter, like)) + "".join(draw.letter(like[0]) for _ in range(attempt // 8))
    syllables = 2 + attempt // 8
    return "".join(CONSONANTS[draw.below(len(CONSONANTS))] + VOWELS[draw.below(len(VOWELS))] for _ in range(syllables)) + (ending or CONSONANTS[draw.below(len(CONSONANTS))])


def surrogate(key: bytes, kind: str, canon: str, attempt: int) -> str:
    """The canonical form of the stand-in: as long as the entity's, except for names and late attempts."""
    draw = _Draw(key, kind, canon, str(attempt))
    more = "".join(str(draw.below(10)) for _ in range(max(0, attempt - 32) // 8))
    if kind == "email":
        local, _, domain = canon.partition("@")
        labels = domain.split(".")
        return "".join(map(draw.letter, local)) + more + "@" + ".".join(["".join(map(draw.letter, x)) for x in labels[:-1]] + labels[-1:])
    if kind == "ip":
        return ".".join(str(draw.below(254) + 1) for _ in range(4 + len(more)))
    if kind == "card":
        body = canon[:1] + "".join(str(draw.below(10)) for _ in canon[2:]) + more
        checks = [body + str(d) for d in range(10)]
        good = next(x for x in checks if luhn(x))
        return good if luhn(canon) else next(x for x in checks[draw.below(10) :] + checks if x != good)
    if kind == "phone":
        keep = len(canon) - 10 if len(canon) > 10 else 0  # the country stays
        return canon[:keep] + "".join(str(draw.below(10)) for _ in canon[keep:]) + more
    if kind == "iban":
        account = "".join(map(draw.letter, canon[4:])) + more
        right = iban_check(canon[:4] + account)
        valid = canon[2:4] == f"{iban_check(canon):02d}"
        return canon[:2] + (f"{right:02d}" if valid else f"{right % 97 + 1:02d}") + account
    if kind == "given":
        gender, _, name = canon.partition("|")
        known = FEMALE if gender == "f" else MALE if gender == "m" else []
        return f"{gender}|{_name(draw, name, attempt, known, ENDINGS[gender])}"
    if kind == "family":
        return _name(draw, canon, attempt, [], "")
    return "".join(map(draw.letter, canon)) + more


def rendered(mention: str, kind: str, new: str) -> str:
    """The surrogate in the mention's format."""
    if kind == "ip":
        return new
    if kind in ("given", "family"):
        word = new.rpartition("|")[2]
        return word.upper() if mention.isupper() and len(mention) > 1 else word[:1].upper() + word[1:]
    if kind == "email":
        return "".join(n.upper() if old.isupper() else n for n, old in zip(new, mention)) + new[len(mention) :]
    chars = iter(new)
    return "".join(next(chars, ch) if (ch.isalnum() if kind == "iban" else ch.isdigit()) else ch for ch in mention) + "".join(chars)


def mentions(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text_hash, start, stop, kind, canon) of every entity."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(None if pd.isna(i) else int(i), h, *e) for i, h, t in zip(batch["id"], batch["text_hash"], batch["text"]) if isinstance(t, str) for e in entities(t)]
            yield pd.DataFrame(rows, columns=["id", "text_hash", "start", "stop", "kind", "canon"]).astype({"id": "Int64"})

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text")).where("text is not null")
    return rows.mapInPandas(run, "id long, text_hash long, start int, stop int, kind string, canon string")


def assign(found: DataFrame, key: bytes) -> DataFrame:
    """(kind, canon, new) for each distinct entity of found(kind, canon), all new forms distinct and none in the corpus."""
    everyone = cut(found.select("kind", "canon").distinct(), "entities")

    @F.pandas_udf("string")
    def draw(kind: pd.Series, canon: pd.Series, attempt: pd.Series) -> pd.Series:
        return pd.Series([surrogate(key, k, c, a) for k, c, a in zip(kind, canon, attempt)], dtype=object)

    settled: DataFrame | None = None
    waiting, attempt = everyone, 0
    while True:
        drawn = cut(waiting.withColumn("new", draw("kind", "canon", F.lit(attempt))), "surrogates")
        taken = everyone.select("kind", F.col("canon").alias("new"))
        if settled is not None:
            taken = taken.unionByName(settled.select("kind", "new"))
        free = drawn.join(taken, ["kind", "new"], "left_anti")
        first = F.row_number().over(Window.partitionBy("kind", "new").orderBy("canon"))
        won = free.withColumn("r", first).where("r = 1").drop("r")
        settled = cut(won.select("kind", "canon", "new") if settled is None else settled.unionByName(won.select("kind", "canon", "new")), "settled", replaces=settled)
        waiting = cut(everyone.join(settled, ["kind", "canon"], "left_anti"), "waiting", replaces=waiting if attempt else None)
        remove(drawn)
        attempt += 1
        if waiting.isEmpty():
            return settled


def pseudonymise(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_entities, kinds, text) of the documents with an entity; text holds the surrogates, n_entities counts mentions."""
    found = cut(mentions(docs, id_col, text_col), "mentions")
    named = found.join(assign(found, key), ["kind", "canon"])
    spans = named.groupBy("id", "text_hash").agg(F.array_sort(F.array_distinct(F.collect_list(F.struct("start", "stop", "kind", "new")))).alias("spans"))
    texts = docs.select(F.col(id_col).cast("long").alias("d"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    # Only texts whose hash passes the Bloom filter of those with an entity are shuffled.
    maybe = maybe_in(found.select(F.col("text_hash").alias("h")).distinct())
    met = texts.where(maybe("h")).join(spans, F.col("d").eqNullSafe(F.col("id")) & (F.col("h") == F.col("text_hash"))).select("id", "text", "spans")

    @F.pandas_udf("string")
    def rewrite(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for text, parts in zip(texts, spans):
            pieces, at = [], 0
            for e in parts:
                pieces += [text[at : e["start"]], rendered(text[e["start"] : e["stop"]], e["kind"], e["new"])]
                at = e["stop"]
            out.append("".join([*pieces, text[at:]]))
        return pd.Series(out, dtype=object)

    kinds = F.array_sort(F.array_distinct(F.transform("spans", lambda e: e["kind"])))
    return met.select(F.col("id").alias(id_col), F.size("spans").cast("long").alias("n_entities"), kinds.alias("kinds"), rewrite("text", "spans").alias("text"))
