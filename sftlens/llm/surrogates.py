"""Surrogates for personal data: keyed, type-consistent, and distinct for distinct entities.

An entity's canonical form (digits of a number, an address in lower case, a name) is a
number in the range of its format: one digit per digit, one letter of the same class per
letter. Keyed permutations of that range give the surrogate, so format, script and length
stay, equal entities agree in every document and every way of writing them, and no two
entities of one format can meet. The permutation is a keyed shuffle of a rotation by one,
which has no fixed point: no entity is its own surrogate. What was given out is checked over
the whole corpus all the same, and a collision changes the key.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import sys
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sftlens.llm.tables import written
from sftlens.llm.textarrays import slices

# Given names by script and gender, and forms of address by gender.
GIVEN_NAMES = {
    ("latin", "f"): (
        "Anna", "Alice", "Barbara", "Carla", "Caroline", "Claire", "Elena", "Elizabeth", "Emma", "Eva",
        "Hannah", "Ingrid", "Isabel", "Jennifer", "Julia", "Karin", "Laura", "Linda", "Lucia", "Maria",
        "Marie", "Martha", "Mary", "Monika", "Patricia", "Sarah", "Sofia", "Sophie", "Susan", "Teresa",
    ),
    ("latin", "m"): (
        "Alexander", "Antonio", "Carlos", "Charles", "Daniel", "David", "Francois", "George", "Hans", "Henry",
        "James", "Jean", "Jose", "John", "Juan", "Karl", "Luis", "Manuel", "Michael", "Miguel",
        "Paul", "Pedro", "Peter", "Pierre", "Richard", "Robert", "Stefan", "Thomas", "Werner", "William",
    ),
    ("cyrillic", "f"): ("Анна", "Елена", "Ирина", "Мария", "Наталья", "Ольга", "Светлана", "Татьяна"),
    ("cyrillic", "m"): ("Александр", "Алексей", "Андрей", "Дмитрий", "Иван", "Михаил", "Николай", "Сергей"),
}
TITLES = {
    "f": ("Mrs", "Ms", "Miss", "Frau", "Mme", "Madame", "Sra", "Señora", "Госпожа"),
    "m": ("Mr", "Herr", "Monsieur", "Sr", "Señor", "Господин"),
}
# Letters that stand for each other, so that surrogates can be read aloud.
CLASSES = (
    "0123456789",
    "aeiou",
    "bcdfghjklmnpqrstvwxyz",
    "áéíóúàèìòùâêîôûäëïöü",
    "çñß",
    "аеиоуыэюя",
    "бвгджзклмнпрстфхцчшщ",
    "αεηιουω",
    "άέήίόύώ",
    "βγδζθκλμνξπρστφχψ",
)
_CLASS = {c: (k, i) for k, members in enumerate(CLASSES) for i, c in enumerate(members)}


@cache
def _letters(script: str, category: str, page: int) -> str:
    """The other letters of a script and case on one page (256 characters) of Unicode."""
    return "".join(
        c
        for c in map(chr, range(page << 8, (page + 1) << 8))
        if c not in _CLASS
        and unicodedata.category(c) == category
        and unicodedata.name(c, "").split(" ")[0] == script
        and (category != "Ll" or len(c.upper()) == 1 and c.upper().lower() == c)
    )


@cache
def _class_of(c: str) -> tuple[str, str, int] | None:
    """The name and members of a character's class and its place there; none if it stays."""
    if c in _CLASS:
        k, i = _CLASS[c]
        return chr(65 + k), CLASSES[k], i
    if not c.isalpha():
        return None
    group = unicodedata.name(c, "").split(" ")[0], unicodedata.category(c), ord(c) >> 8
    members = _letters(*group)
    return (f"<{' '.join(map(str, group))}>", members, members.index(c)) if c in members else None


EMAIL = re.compile(r"(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}(?![\w-])")
IPV4 = re.compile(r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\d|\.\d)")
CARD = re.compile(
    r"(?<![\d.-])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}|\d{4}([ -])\d{6}\2\d{4,5})(?!\d|[.-]\d)"
)
SSN = re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])")
PHONE = re.compile(
    r"(?<![\w.+-])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})|\(\d{2,4}\)|\d{3}(?=[ .-]\d{3}[ .-]\d{4}))"
    r"(?:[ .-]?\d{2,4}){2,4}(?![\w]|[.-]\d)"
)
_COUNTRY = re.compile(r"\+(\d{1,3})(?=[ .(-])")
# Vowel signs and other marks belong to the letter before them.
_MARKS = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) in ("Mn", "Mc"))
_WORD = rf"[^\W\d_](?:[^\W\d_]|[{re.escape(_MARKS)}])*"
_TITLED = "|".join(sorted({t for names in TITLES.values() for t in names}, key=len, reverse=True))
_GIVEN = "|".join(sorted({n for names in GIVEN_NAMES.values() for n in names}, key=len, reverse=True))
NAME = re.compile(
    rf"(?<!\w)(?:(?P<title>{_TITLED})\.? (?:(?P<g1>{_GIVEN}) )?(?P<s1>{_WORD})|(?P<g2>{_GIVEN}) (?P<s2>{_WORD}))(?!\w)"
)
# Every text with an entity passes one of these cheap tests.
MAY_HOLD = r"@|[0-9][0-9 ().-]{5,}[0-9]|\.[0-9]+\.[0-9]"
MAY_NAME = rf"(?:{_TITLED}|{_GIVEN})\.? "


class Permutation:
    """Keyed permutations of ``range(size)`` without fixed points."""

    ROUNDS = 8

    def __init__(self, key: bytes, label: str, size: int):
        self.size = size
        # Two halves of a * a >= size, walked until the result is in range.
        self.side = 1
        while self.side * self.side < size:
            self.side += 1 if size < 1 << 20 else max(1, self.side)
        if size >= 1 << 20:
            low, high = self.side // 2, self.side
            while low < high:
                mid = (low + high) // 2
                low, high = (low, mid) if mid * mid >= size else (mid + 1, high)
            self.side = low
        self.key = hmac.digest(key, f"{label}/{size}".encode(), "sha256")

    def _draw(self, step: int, value: int) -> int:
        data = step.to_bytes(1, "big") + value.to_bytes((value.bit_length() + 7) // 8 or 1, "big")
        return int.from_bytes(hashlib.blake2b(data, key=self.key, digest_size=32).digest(), "big")

    def _forward(self, x: int) -> int:
        left, right = divmod(x, self.side)
        for step in range(self.ROUNDS):
            left, right = right, (left + self._draw(step, right)) % self.side
        return left * self.side + right

    def _backward(self, x: int) -> int:
        left, right = divmod(x, self.side)
        for step in reversed(range(self.ROUNDS)):
            left, right = (right - self._draw(step, left)) % self.side, left
        return left * self.side + right

    def __call__(self, x: int) -> int:
        if self.size < 2:
            return x
        y = self._forward(x)
        while y >= self.size:
            y = self._forward(y)
        y = (y + 1) % self.size
        y = self._backward(y)
        while y >= self.size:
            y = self._backward(y)
        return y


@dataclass(frozen=True)
class Entity:
    """``identity`` is equal for all ways of writing an entity; ``surrogate`` its replacement here,
    ``replaced`` the surrogate's own identity."""

    kind: str
    start: int
    end: int
    identity: str
    surrogate: str
    replaced: str


def _luhn(digits: str) -> int:
    """The digit that completes a card number."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (2 if i % 2 == 0 else 1)
        total += n - 9 if n > 9 else n
    return -total % 10


def is_card(text: str) -> bool:
    digits = [c for c in text if c.isdigit()]
    return 13 <= len(digits) <= 19 and _luhn("".join(digits[:-1])) == int(digits[-1])


def _small(c: str) -> bool:
    """Whether a letter has a capital and is not one; names in scripts without case have neither.

    Georgian has capitals that names are not written with.
    """
    return not c.isupper() and c.upper() != c and not unicodedata.name(c, "").startswith("GEORGIAN")


def _in_word(c: str) -> bool:
    return bool(c) and (c.isalnum() or c == "_" or unicodedata.category(c) in ("Mn", "Mc"))


class Surrogates:
    """Replacements under one key. The same key gives the same replacements everywhere."""

    def __init__(self, key: bytes):
        self.key = key
        self.permutations: dict[tuple[str, int], Permutation] = {}
        self.names: dict[str, tuple[str, str]] = {
            n: group for group, names in GIVEN_NAMES.items() for n in names
        }

    def _permuted(self, label: str, size: int, x: int) -> int:
        if (label, size) not in self.permutations:
            if len(self.permutations) > 10_000:
                self.permutations.clear()
            self.permutations[label, size] = Permutation(self.key, label, size)
        return self.permutations[label, size](x)

    def same_format(self, kind: str, text: str) -> str:
        """``text`` with every letter and digit replaced by one of its class, case kept."""
        low = text.lower()
        if len(low) != len(text):
            low = text
        classes = [_class_of(c) for c in low]
        spots = [(i, members, at) for i, (_, members, at) in ((i, k) for i, k in enumerate(classes) if k)]
        shape = "".join(k[0] if k else c for k, c in zip(classes, low, strict=True))
        size = value = 1
        value = 0
        for _, members, i in spots:
            value = value * len(members) + i
            size *= len(members)
        value = self._permuted(f"{kind}/{shape}", size, value)
        out = list(text)
        for at, members, _ in reversed(spots):
            value, i = divmod(value, len(members))
            new = members[i]
            upper = new.upper()
            out[at] = upper if text[at] != low[at] and len(upper) == 1 else new
        return "".join(out)

    def digits(self, kind: str, text: str, canonical: str, head: int = 0, checked: bool = False) -> tuple[str, str]:
        """``text`` with other digits in the same places, and those digits.

        The first ``head`` digits stay; the last one of a checked number completes its
        checksum.
        """
        kept, body = canonical[:head], canonical[head : len(canonical) - checked]
        # A country code may be written or left out; an issuer's digit is part of the number.
        label = f"{kind}/{kept if checked else ''}/{len(body)}"
        new = kept + str(self._permuted(label, 10 ** len(body), int(body))).zfill(len(body))
        if checked:
            new += str(_luhn(new))
        left = iter(new)
        return "".join(next(left) if c.isdigit() else c for c in text), new

    def email(self, text: str) -> tuple[str, str]:
        local, _, domain = text.rpartition("@")
        name, _, top = domain.rpartition(".")
        new = f"{self.same_format('email', local)}@{self.same_format('domain', name)}.{top}"
        return new, new.lower()

    def address(self, text: str) -> tuple[str, str]:
        value = 0
        for part in text.split("."):
            value = value * 256 + int(part)
        value = self._permuted("ipv4", 1 << 32, value)
        new = ".".join(str(value >> shift & 255) for shift in (24, 16, 8, 0))
        return new, new

    def given(self, name: str) -> str:
        """Another given name of the same script and gender."""
        group = self.names[name]
        names = GIVEN_NAMES[group]
        return names[self._permuted("/".join(group), len(names), names.index(name))]

    def entities(self, text: str, numbers: bool = True, names: bool = True) -> list[Entity]:
        """Non-overlapping entities of a text, in order; more specific kinds come first."""
        found: list[Entity] = []
        taken: list[tuple[int, int]] = []

        def add(kind: str, start: int, end: int, make: Callable[[str], tuple[str, str, str]]) -> None:
            if any(a < end and start < b for a, b in taken):
                return
            identity, surrogate, replaced = make(text[start:end])
            taken.append((start, end))
            found.append(Entity(kind, start, end, identity, surrogate, replaced))

        def plain(kind: str, checked: bool = False):
            def make(s: str) -> tuple[str, str, str]:
                canonical = "".join(c for c in s if c.isdigit())
                country = _COUNTRY.match(s)
                head = 1 if checked else len(country[1]) if country else 0
                surrogate, new = self.digits(kind, s, canonical, head, checked)
                skip = 0 if checked else head
                return canonical[skip:], surrogate, new[skip:]

            return make

        def surname(s: str) -> tuple[str, str, str]:
            new = self.same_format("surname", s)
            return s.lower(), new, new.lower()

        if numbers:
            for m in EMAIL.finditer(text):
                add("email", *m.span(), lambda s: (s.lower(), *self.email(s)))
            for m in IPV4.finditer(text):
                add("ipv4", *m.span(), lambda s: (".".join(str(int(p)) for p in s.split(".")), *self.address(s)))
            for m in CARD.finditer(text):
                if is_card(m[0]):
                    add("card", *m.span(), plain("card", checked=True))
            for m in SSN.finditer(text):
                add("ssn", *m.span(), plain("ssn"))
            for m in PHONE.finditer(text):
                if 7 <= sum(c.isdigit() for c in m[0]) <= 15:
                    add("phone", *m.span(), plain("phone"))
        if names:
            for m in NAME.finditer(text):
                # A name at the start of a sentence may be a word; a surname beside it tells.
                for part in ("g1", "g2"):
                    if m[part] and (part == "g1" or m["s2"][0].isupper()):
                        add("given", *m.span(part), lambda s: (s, self.given(s), self.given(s)))
                for part in ("s1", "s2"):
                    if m[part] in self.names:
                        add("given", *m.span(part), lambda s: (s, self.given(s), self.given(s)))
                    elif m[part] and not _small(m[part][0]):
                        add("surname", *m.span(part), surname)
            # A surname that was found is one wherever its document has it.
            forms = {f for e in found if e.kind == "surname" for s in [text[e.start : e.end]] for f in (s, s.upper(), s.title())}
            for form in sorted(forms):
                at = text.find(form)
                while at >= 0:
                    end = at + len(form)
                    if not (_in_word(text[at - 1 : at]) or _in_word(text[end : end + 1])):
                        add("surname", at, end, surname)
                    at = text.find(form, end)
        return sorted(found, key=lambda e: e.start)


ENTITY_TYPE = "array<struct<kind:string, start:int, end:int, identity:string, surrogate:string, replaced:string>>"
_ENTITY = pa.list_(
    pa.struct(
        [
            ("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()),
            ("identity", pa.string()), ("surrogate", pa.string()), ("replaced", pa.string()),
        ]
    )
)


def _replace(docs: DataFrame, key: bytes) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Surrogates(key)
        for batch, texts in slices(batches):
            column = batch.column("text")
            filled = column.fill_null("") if column.null_count else column
            numbers = pc.match_substring_regex(filled, MAY_HOLD).to_pylist()
            names = pc.match_substring_regex(filled, MAY_NAME).to_pylist()
            out, entities = column.to_pylist(), [[] for _ in range(batch.num_rows)]
            for i in range(texts.size):
                if not (numbers[i] or names[i]):
                    continue
                found = maker.entities(out[i], numbers[i], names[i])
                pieces, at = [], 0
                for e in found:
                    pieces += [out[i][at : e.start], e.surrogate]
                    at = e.end
                    # What identifies a person stays in the task: only its keyed digest leaves it.
                    digest = hmac.digest(key, f"{e.kind}:{e.identity}".encode(), "sha256").hex()
                    entities[i].append(
                        {"kind": e.kind, "start": e.start, "end": e.end, "identity": digest,
                         "surrogate": e.surrogate, "replaced": e.replaced}
                    )
                out[i] = "".join([*pieces, out[i][at:]])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(out, pa.string()), pa.array(entities, _ENTITY)],
                ["doc_id", "text", "entities"],
            )

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, f"doc_id long, text string, entities {ENTITY_TYPE}")


def collisions(found: DataFrame) -> DataFrame:
    """Surrogates that stand for more than one entity: ``kind, replaced, identities``."""
    given = found.select(F.explode("entities").alias("e")).select("e.kind", "e.replaced", "e.identity")
    return (
        given.groupBy("kind", "replaced")
        .agg(F.min("identity").alias("low"), F.max("identity").alias("high"))
        .where("low != high")
    )


def replace_entities(docs: DataFrame, key: str, attempts: int = 3) -> DataFrame:
    """``doc_id, text, entities`` of every row, with surrogates for all entities of ``text``.

    Kinds are e-mail addresses, IPv4 addresses, payment cards (checksum kept right), social
    security and phone numbers, given names and surnames after a form of address or a
    known given name, and every other mention of such a surname in its document. ``entities`` lists kind, place in the old text (code points, end
    exclusive), keyed digest of the identity, and surrogate. The result is written before it
    is returned, as it is checked for collisions over all documents; with one, the next key
    is derived. Null texts stay null, texts without entities are unchanged, repeated rows are
    treated alike; an empty table gives an empty result; other columns are ignored.
    """
    for attempt in range(attempts):
        derived = hmac.digest(key.encode(), f"surrogates/{attempt}".encode(), "sha256")
        found = written(_replace(docs, derived), "surrogates")
        if collisions(found).isEmpty():
            return found
    raise RuntimeError(f"surrogates collide under {attempts} keys")
