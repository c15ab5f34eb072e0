"""Personal data: detection, and keyed surrogates of the same type, script and format.

An entity is a kind and a canonical form, so that all its mentions, in all
documents, get one surrogate (coreference). Candidates come from a keyed hash of
entity and attempt. In Spark every round compares all candidates with each other,
with the surrogates given so far and with the real entities; whatever meets
another tries again, so different entities always get different surrogates and
no surrogate is a real entity of the corpus (distinctness).
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earwitness.llm.common import extend, numbered
from earwitness.session import cut_lineage

#: Attempts in the format of the entity; from then on every second attempt widens it by two characters.
NARROW = 8
#: Rounds after which an entity without a surrogate is an error. Names, mailboxes, phones and ssns widen long before;
#: addresses, cards and ibans keep their format, whose room (4e9 at least) no corpus that fits one cluster's disks fills.
MOST_ATTEMPTS = 64

# Forms of address and given names by gender, in the scripts handled.
MALE_TITLES = ("Mr", "Mister", "Sir", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "Don", "господин", "г-н", "κύριος", "Κύριος", "Господин")
FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Mademoiselle", "Señora", "Señorita", "Sra", "Doña", "госпожа", "г-жа", "κυρία", "Κυρία", "Госпожа")
OTHER_TITLES = ("Dr", "Prof", "Professor", "Docteur", "Doktor")
GIVEN = {
    ("latin", "m"): ("James", "John", "Robert", "Michael", "William", "David", "Thomas", "Daniel", "Peter", "Paul", "Hans", "Karl", "Jürgen", "Stefan", "Pierre", "Jean", "Louis", "Carlos", "José", "Miguel", "Pablo", "Luis"),
    ("latin", "f"): ("Mary", "Patricia", "Jennifer", "Linda", "Elizabeth", "Susan", "Sarah", "Karen", "Anna", "Emma", "Helga", "Ursula", "Sabine", "Claire", "Marie", "Sophie", "Camille", "Carmen", "Lucía", "Elena", "Isabel", "Rosa"),
    ("cyrillic", "m"): ("Иван", "Сергей", "Дмитрий", "Алексей", "Николай", "Пётр", "Михаил", "Андрей"),
    ("cyrillic", "f"): ("Анна", "Елена", "Ольга", "Мария", "Наталья", "Татьяна", "Ирина", "Светлана"),
    ("greek", "m"): ("Γιώργος", "Νίκος", "Δημήτρης", "Κώστας", "Γιάννης", "Πέτρος"),
    ("greek", "f"): ("Μαρία", "Ελένη", "Κατερίνα", "Σοφία", "Άννα", "Δήμητρα"),
}
LETTERS = (("aeiou", "bcdfghklmnprstvwz"), ("áéíóúàèìòùâêôäöü", "ñçßš"), ("аеиоуыэюя", "бвгдзклмнпрстфхчшж"), ("αεηιουω", "βγδζθκλμνξπρστφχψ"))
#: Endings that carry the gender of a family name.
ENDINGS = ("ская", "ский", "ова", "ева", "ина", "ов", "ев", "ин", "ska", "ski", "ová", "ου", "ος")

_GENDER_OF = {n.lower(): g for (_, g), names in GIVEN.items() for n in names}
_NAME_WORD = r"[^\W\d_a-zà-ÿа-яё][^\W\d_]+(?:[-'’][^\W\d_]+)*"
_TITLES = ("Mr", "Mister", "Sir", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "Don", "господин", "г-н", "κύριος", "Κύριος", "Господин")
FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Mademoiselle", "Señora", "Señorita", "Sra", "Doña", "госпожа", "г-жа", "κυρία", "Κυρία", "Госпожа")
OTHER_TITLES = ("Dr", "Prof", "Professor", "Docteur", "Doktor")
GIVEN = {
    ("latin", "m"): ("James", "John", "Robert", "Michael", "William", "David", "Thomas", "Daniel", "Peter", "Paul", "Hans", "Karl", "Jürgen", "Stefan", "Pierre", "Jean", "Louis", "Carlos", "José", "Miguel", "Pablo", "Luis"),
    ("latin", "f"): ("Mary", "Patricia", "Jennifer", "Linda", "Elizabeth", "Susan", "Sarah", "Karen", "Anna", "Emma", "Helga", "Ursula", "Sabine", "Claire", "Marie", "Sophie", "Camille", "Carmen", "Lucía", "Elena", "Isabel", "Rosa"),
    ("cyrillic", "m"): ("Иван", "Сергей", "Дмитрий", "Алексей", "Николай", "Пётр", "Михаил", "Андрей"),
    ("cyrillic", "f"): ("Анна", "Елена", "Ольга", "Мария", "Наталья", "Татьяна", "Ирина", "Светлана"),
    ("greek", "m"): ("Γιώργος", "Νίκος", "Δημήτρης", "Κώστας", "Γιάννης", "Πέτρος"),
    ("greek", "f"): ("Μαρία", "Ελένη", "Κατερίνα", "Σοφία", "Άννα", "Δήμητρα"),
}
LETTERS = (("aeiou", "bcdfghklmnprstvwz"), ("áéíóúàèìòùâêôäöü", "ñçßš"), ("аеиоуыэюя", "бвгдзклмнпрстфхчшж"), ("αεηιουω", "βγδζθκλμνξπρστφχψ"))
#: Endings that carry the gender of a family name.
ENDINGS = ("ская", "ский", "ова", "ева", "ина", "ов", "ев", "ин", "ska", "ski", "ová", "ου", "ος")

_GENDER_OF = {n.lower(): g for (_, g), names in GIVEN.items() for n in names}
_NAME_WORD = r"[^\W\d_a-zà-ÿа-яё][^\W\d_]+(?:[-'’](?![sS](?!\w))[^\W\d_]+)*"  # without a possessive 's
_PATTERNS = (
    ("email", re.compile(r"(?<![\w.%+-])[\w.%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")),
    ("iban", re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")),
    ("ip", re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\w)")),
    ("card", re.compile(r"(?<![\w+-])\d(?:[ -]?\d){12,18}(?![\w-])")),
    ("ssn", re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")),
    ("phone", re.compile(r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3}[ .-]?\d{3,4}(?!\w)|(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}(?!\w)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-])")),
)
_TITLES = {t.lower(): g for titles, g in ((MALE_TITLES, "m"), (FEMALE_TITLES, "f"), (OTHER_TITLES, "n")) for t in titles}
_TITLE = "|".join(sorted(map(re.escape, (*MALE_TITLES, *FEMALE_TITLES, *OTHER_TITLES)), key=len, reverse=True))
_TITLED = re.compile(rf"(?<!\w)({_TITLE})\.?[ \xa0]({_NAME_WORD}(?:[ \xa0](?!(?:{_TITLE})(?!\w)){_NAME_WORD})*)")
_NAME = re.compile(rf"(?<!\w){_NAME_WORD}")
_GIVEN = re.compile(rf"(?<!\w)({'|'.join(n for names in GIVEN.values() for n in names)})[  ]({_NAME_WORD})(?!\w)")
_KNOWN = (*MALE_TITLES, *FEMALE_TITLES, *OTHER_TITLES, *(n for names in GIVEN.values() for n in names))
#: What a text must have, for the JVM, before Python looks at it: a digit, an at sign, a title or a known name.
#: The names are tried only where one of their first letters is.
SUSPECT = f"[0-9@]|(?=[{''.join(sorted({n[0] for n in _KNOWN}))}])(?:{'|'.join(sorted(_KNOWN))})"


@dataclass(frozen=True)
class Mention:
    start: int
    end: int
    kind: str
    canonical: str


def _canonical(kind: str, surface: str) -> str:
    if kind == "phone" and surface.startswith("+"):  # the country's part stays
        country = re.match(r"\+\d{1,3}(?=\D)|\+\d", surface)[0]
        return country + re.sub(r"\D", "", surface[len(country) :])
    if kind in ("card", "phone", "ssn"):
        return re.sub(r"\D", "", surface)
    return surface.replace(" ", "").upper() if kind == "iban" else surface.lower()


def _bare_names(text: str, names: dict[str, str]) -> Iterator[tuple[int, int, str]]:
    """Start, end and kind of every capitalised occurrence of ``names`` in ``text``, parts of hyphenated words too."""
    most = max(len(re.split(r"[-'’]", n)) for n in names)
    for m in _NAME.finditer(text):
        parts = [(m.start() + p.start(), m.start() + p.end()) for p in re.finditer(r"[^-'’]+", m[0])]
        k = 0
        while k < len(parts):
            a = parts[k][0]
            last = next((n for n in range(min(len(parts), k + most) - 1, k - 1, -1) if text[a : parts[n][1]].lower() in names), None)
            if last is not None and not text[a].islower():
                yield a, parts[last][1], names[text[a : parts[last][1]].lower()]
                k = last
            k += 1


def mentions(text: str | None) -> list[Mention]:
    """Entities of a text that do not overlap, by position; of overlapping ones the kind listed first stays.

    Names found after a title or a listed given name are looked for in the whole
    text: every capitalised occurrence is a mention of the first kind found.
    """
    out: list[Mention] = []

    def add(start: int, end: int, kind: str) -> None:
        at = bisect_left(out, start, key=lambda m: m.start)
        if (at == 0 or out[at - 1].end <= start) and (at == len(out) or out[at].start >= end):
            out.insert(at, Mention(start, end, kind, _canonical(kind, text[start:end])))

    if text:
        for kind, pattern in _PATTERNS:
            for m in pattern.finditer(text):
                add(*m.span(), kind)
        for m in _TITLED.finditer(text):
            gender = _TITLES[m[1].lower()]
            parts = [(m.start(2) + p.start(), m.start(2) + p.end()) for p in re.finditer(r"[^ \xa0]+", m[2])]
            # A lower-case word ends the names; where letters have no case, the third word does.
            parts = parts[: next((k for k, (a, _) in enumerate(parts) if not (text[a].isupper() or text[a].istitle() or (k < 3 and not text[a].islower()))), len(parts))]
            for k, (a, b) in enumerate(parts):
                known = _GENDER_OF.get(text[a:b].lower())
                add(a, b, "family" if k == len(parts) - 1 and not (known and len(parts) == 1) else f"given_{known or gender}")
        for m in _GIVEN.finditer(text):
            add(*m.span(1), f"given_{_GENDER_OF[m[1].lower()]}")
            add(*m.span(2), "family")
        names: dict[str, str] = {}
        for m in out:
            if m.kind == "family" or m.kind.startswith("given_"):
                names.setdefault(m.canonical, m.kind)
        if names:
            for a, b, kind in _bare_names(text, names):
                add(a, b, kind)
    return out


class _Stream:
    """Whole numbers from a keyed hash."""

    def __init__(self, key: bytes, *parts: object) -> None:
        self.seed = hashlib.blake2b("\0".join(map(str, parts)).encode("utf-8", "surrogatepass"), key=key, digest_size=32).digest()
        self.at = 0

    def below(self, n: int) -> int:
        self.at += 1
        return int.from_bytes(hashlib.blake2b(self.at.to_bytes(8, "big"), key=self.seed, digest_size=8).digest(), "big") % n


def _like(text: str, rand: _Stream) -> str:
    """Letters for letters of their script and sort, digits for digits, all else as it is; lower case."""
    out = []
    for c in text:
        if c.isdigit() and c.isascii():
            out.append(str(rand.below(10)))
            continue
        same = next((group for pair in LETTERS for group in pair if c in group), None)
        if same is None and c.isascii() and c.isalpha():
            same = LETTERS[0][1]
        if same is None and c.isalpha():  # another script: a letter near by
            near = [chr(k) for k in range(ord(c) & ~31, (ord(c) | 31) + 1) if chr(k).isalpha() and chr(k).lower() == chr(k)]
            same = "".join(near) or c
        out.append(same[rand.below(len(same))] if same else c)
    return "".join(out)


def _wider(text: str, n: int, rand: _Stream) -> str:
    """``n`` more letters in the script of the last letter of ``text``, consonants and vowels in turn; Latin where that script is not known."""
    last = next((c for c in reversed(text) if c.isalpha()), "a")
    vowels, others = next((pair for pair in LETTERS[2:] if last in pair[0] + pair[1]), LETTERS[0])
    return "".join((others, vowels)[k % 2][rand.below(len((others, vowels)[k % 2]))] for k in range(n))


def _luhn(digits: str) -> int:
    return sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(map(int, reversed(digits)))) % 10


def script_of(word: str) -> str:
    return next((s for s, pair in (("cyrillic", LETTERS[2]), ("greek", LETTERS[3])) if any(c in pair[0] + pair[1] for c in word.lower())), "latin")


def candidate(kind: str, canonical: str, attempt: int, key: bytes) -> str:
    """The surrogate that an entity tries at an attempt, in canonical form."""
    rand = _Stream(key, kind, canonical, attempt)
    more = 2 * ((attempt - NARROW) // 2 + 1) if attempt >= NARROW else 0
    if kind == "email":
        local, _, domain = canonical.rpartition("@")
        labels = domain.split(".")
        return f"{_like(local, rand)}{_wider(local, more, rand)}@{'.'.join([*(_like(x, _Stream(key, 'domain', domain, k)) for k, x in enumerate(labels[:-1])), labels[-1]])}"
    if kind == "ip":
        return ".".join(str(1 + rand.below(254)) for _ in range(4))
    if kind == "card":
        new = canonical[0] + _like(canonical[1:-1], rand)
        last = next(d for d in range(10) if _luhn(f"{new}{d}") == 0)
        return f"{new}{last if _luhn(canonical) == 0 else (last + 1 + rand.below(9)) % 10}"
    if kind == "phone":
        keep = 0 if not canonical.startswith("+") else 2 if canonical[1] in "17" else 3
        return canonical[:keep] + _like(canonical[keep:], rand) + _like("0" * more, rand)
    if kind == "ssn":
        return f"{1 + rand.below(665):03d}{1 + rand.below(99):02d}{1 + rand.below(9999):04d}" + _like("0" * more, rand)
    if kind == "iban":
        return canonical[:2] + _like(canonical[2:].lower(), rand).upper()
    if kind.startswith("given_"):
        gender = kind[-1] if kind[-1] != "n" else "mf"[rand.below(2)]
        names = GIVEN[script_of(canonical), gender]
        if attempt < 4:
            return names[rand.below(len(names))].lower()
        base = _like(names[rand.below(len(names))].lower(), rand)
        vowels, others = LETTERS[{"latin": 0, "cyrillic": 2, "greek": 3}[script_of(canonical)]]
        return base + _wider(base, more, rand) + (vowels[0] if gender == "f" else others[rand.below(len(others))])
    ending = next((e for e in ENDINGS if canonical.endswith(e) and len(canonical) > len(e) + 1), "")
    stem = canonical[: len(canonical) - len(ending)]
    return _like(stem, rand) + _wider(stem, more, rand) + ending


def rendered(kind: str, surface: str, surrogate: str) -> str:
    """A surrogate in the format of a mention: its separators, its upper and lower case."""
    if kind in ("card", "ssn", "phone", "iban"):
        fill = iter(surrogate.lstrip("+"))
        return "".join(next(fill, "") if c.isalnum() else c for c in surface) + "".join(fill)  # a widened one is longer
    if kind == "ip":
        return surrogate
    if kind == "email":
        return "".join(s.upper() if c.isupper() else s for c, s in zip(surface, surrogate, strict=True)) if len(surface) == len(surrogate) else surrogate
    if surface.isupper() and len(surface) > 1:
        return surrogate.upper()
    return surrogate[:1].upper() + surrogate[1:] if surface[:1].isupper() else surrogate


_ENTITY = "struct<kind:string,canonical:string>"


def _detector():
    def make(batch):
        found = [mentions(t) for t in batch.column("text").to_pylist()]
        return {
            "entities": [[{"kind": k, "canonical": c} for k, c in sorted({(m.kind, m.canonical) for m in ms})] for ms in found],
            "n": [len(ms) for ms in found]}

    return make


def _generator(key: bytes, attempt: int):
    return lambda batch: {"surrogate": [candidate(k, c, attempt, key) for k, c in zip(batch.column("kind").to_pylist(), batch.column("canonical").to_pylist(), strict=True)]}


def surrogates(entities: DataFrame, key: bytes) -> DataFrame:
    """``kind``, ``canonical``, ``surrogate`` for distinct ``entities``: one to one within a kind, none a real entity.

    Of entities with the same candidate the first by canonical form has it; the
    others try again. Only counts of what is left reach the driver.
    """
    entities = cut_lineage(entities.select("kind", "canonical").distinct())
    real = entities.select("kind", F.col("canonical").alias("surrogate"), F.lit(True).alias("taken"))
    done, left = None, entities
    for attempt in range(MOST_ATTEMPTS):
        tried = cut_lineage(extend(left, partial(_generator, key, attempt), "surrogate string").select("kind", "canonical", "__out.surrogate"))
        taken = real if done is None else real.union(done.select("kind", "surrogate", F.lit(True).alias("taken")))
        first = tried.groupBy("kind", "surrogate").agg(F.min("canonical").alias("canonical"))
        won = cut_lineage(first.join(taken, ["kind", "surrogate"], "left_anti").select("kind", "canonical", "surrogate"))
        done = won if done is None else cut_lineage(done.union(won))
        left = left.join(won.select("kind", "canonical"), ["kind", "canonical"], "left_anti")
        if left.isEmpty():
            return done
        left = cut_lineage(left)
    raise ValueError(f"no distinct surrogates after {MOST_ATTEMPTS} rounds: {[tuple(r) for r in left.limit(3).collect()]}")


def replaced(text: str, given: dict[tuple[str, str], str]) -> str:
    out, at = [], 0
    for m in mentions(text):
        out += [text[at : m.start], rendered(m.kind, text[m.start : m.end], given[m.kind, m.canonical])]
        at = m.end
    return "".join([*out, text[at:]])


def _replacer():
    def make(batch):
        rows = zip(batch.column("text").to_pylist(), batch.column("given").to_pylist(), strict=True)
        return {"text": [replaced(t, {(g["kind"], g["canonical"]): g["surrogate"] for g in given}) if given else t for t, given in rows]}

    return make


def suspect(text: str = "text") -> Column:
    return F.coalesce(F.col(text).rlike(SUSPECT), F.lit(False))


def pseudonymised(docs: DataFrame, key: bytes, id_col: str = "doc_id") -> DataFrame:
    """Per row of ``docs``: id, ``text`` with surrogates, ``n_entities`` (mentions replaced).

    Texts are read whole; null and empty ones stay as they are. Rows stay rows,
    whatever their ids. Texts that have nothing to look at never leave the JVM, and
    only texts that have are written and joined with their surrogates.
    """
    docs = docs.select(id_col, "text")
    found = numbered(extend(docs.where(suspect()), _detector, f"entities array<{_ENTITY}>, n long"), "__row")
    each = found.select("__row", F.explode("__out.entities").alias("e")).select("__row", "e.kind", "e.canonical")
    given = each.join(surrogates(each, key), ["kind", "canonical"]).groupBy("__row").agg(F.collect_list(F.struct("kind", "canonical", "surrogate")).alias("given"))
    rows = found.select(id_col, "text", "__row", F.col("__out.n").alias("n")).join(given, "__row", "left")
    new = extend(rows, _replacer, "text string", [id_col, "n"]).select(id_col, F.col("__out.text").alias("text"), F.col("n").alias("n_entities"))
    return new.union(docs.where(~suspect()).select(id_col, "text", F.lit(0).cast("long")))
