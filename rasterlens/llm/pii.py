"""PII: detected entities get keyed, type-consistent surrogates of the same format.

Entities (e-mail addresses, phone, card, account and social-security numbers, IP
addresses, access keys and tokens, names after a title, a known given name or words that
introduce one) are replaced by surrogates under a secret key, which the caller must give.
Numbers are written in the digits 0-9; other digits are not looked at. A surrogate is made by a keyed permutation of
the entity's own format class: letters stay letters of the same script, case and kind
(vowel or consonant), digits stay digits, separators stay where they are, card numbers
keep their check digit right, octets stay below 256, and given names become given names
of the same gender and script. As each map is a permutation, different entities never
share a surrogate, and the same entity (in any case, in any document) always gets the same.

The distinctness is checked, not only argued: ``collisions`` pre-aggregates surrogates
over the whole table and returns those of more than one entity (none is expected).

Defined cases: a null text stays null without entities; an empty text stays empty;
overlapping detections go to the earlier start, then to the earlier kind; repeated rows give
repeated results; extra columns are left out; an empty table gives an empty result.
The permutations have no fixed points: no entity is its own surrogate.
"""

from __future__ import annotations

import functools
import hashlib
import hmac
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterlens.llm.common import written

#: Least length of a secret key in bytes.
LEAST_KEY = 16

#: Given names by gender and script, each list in natural order.
GIVEN = {
    ("f", "latin"): ["Alice", "Amelia", "Anna", "Carla", "Carmen", "Claire", "Elena", "Emma", "Greta", "Hanna", "Helen", "Ingrid", "Isabel", "Julia", "Laura", "Lucy", "Maria", "Marie", "Mary", "Nora", "Olivia", "Paula", "Sarah", "Sofia"],
    ("m", "latin"): ["Adam", "Albert", "Bruno", "Carlos", "Daniel", "David", "Emil", "Felix", "George", "Hans", "Henry", "Hugo", "Jack", "James", "Jean", "John", "Juan", "Karl", "Louis", "Lucas", "Martin", "Oscar", "Paul", "Peter"],
    ("f", "cyrillic"): ["Анна", "Вера", "Дарья", "Елена", "Ирина", "Мария", "Нина", "Ольга"],
    ("m", "cyrillic"): ["Антон", "Борис", "Виктор", "Егор", "Иван", "Максим", "Олег", "Павел"],
    ("f", "greek"): ["Άννα", "Ελένη", "Ζωή", "Μαρία", "Σοφία", "Φωτεινή"],
    ("m", "greek"): ["Γιώργος", "Δημήτρης", "Κώστας", "Νίκος", "Πέτρος", "Σπύρος"],
}
#: Titles and the gender that they tell.
TITLES = {"Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Herr": "m", "Frau": "f", "Mme": "f", "Señor": "m", "Señora": "f", "Dr": "", "Prof": ""}
#: Letter classes; a letter is only replaced by one of its class.
CLASSES = ["aeiou", "bcdfghjklmnpqrstvwxyz", "àâäáãåæ", "èéêë", "ìíîï", "òóôöõø", "ùúûü", "çñß", "аеиоуыэюя", "бвгджзклмнпрстфхцчшщ", "αεηιουω", "βγδζθκλμνξπρστφχψ"]

_GIVEN_AT = {n.lower(): (g, i) for g, names in GIVEN.items() for i, n in enumerate(names)}
_CLASS_AT = {c: (k, i) for k, cls in enumerate(CLASSES) for i, c in enumerate(cls)}
_WORD = r"\p{Lu}[\p{Ll}\p{Lu}'’-]*\p{Ll}"
#: What stands before a name that no list knows.
CUES = ["my name is", "My name is", "Name", "name", "signed by", "Signed by", "ich heiße", "Ich heiße", "mein Name ist", "Mein Name ist", "je m'appelle", "Je m'appelle", "me llamo", "Me llamo", "меня зовут", "Меня зовут", "με λένε", "Με λένε"]
PATTERNS = [
    ("email", r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    ("access_key", r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b"),
    ("token", r"\b[0-9a-f]{32,64}\b"),
    ("ip", r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9.]*[0-9])"),
    ("phone", r"(?<![\w+])\+[0-9]{1,3}[ .-]?\(?[0-9]{1,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}(?!\w)|(?<!\w)\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?!\w)|(?<!\w)[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?!\w)"),
    ("iban", r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"),
    ("card", r"(?<![\w-])[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}(?![\w-])"),
    ("ssn", r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])"),
    ("name", rf"(?:{'|'.join(CUES)}):? \K{_WORD}(?: {_WORD}){{1,2}}\b|\b(?:{'|'.join(TITLES)})\.? (?:{_WORD} ){{0,2}}{_WORD}\b|\b(?:{'|'.join(n for names in GIVEN.values() for n in names)}) {_WORD}\b"),
]
_ALL = regex.compile("|".join(f"(?P<{k}>{p})" for k, p in PATTERNS))
_SIGN = re.compile("[0-9@]|AKIA|ASIA|[a-f]{32}")


@functools.cache
def _openers() -> ahocorasick.Automaton:
    """Titles and given names: a name entity starts with one of them."""
    found = ahocorasick.Automaton()
    for n in [*TITLES, *CUES, *(n for names in GIVEN.values() for n in names)]:
        found.add_word(n, n)
    found.make_automaton()
    return found


def _number(secret: bytes, *parts: str) -> int:
    return int.from_bytes(hmac.new(secret, "\x1f".join(parts).encode(), hashlib.sha256).digest()[:16])


@functools.lru_cache(256)
def _next_of(secret: bytes, tweak: str, n: int) -> tuple[int, ...]:
    """A keyed permutation of 0..n-1 in one cycle: nothing stays where it is if n > 1."""
    order = sorted(range(n), key=lambda i: _number(secret, "list", tweak, str(i)))
    out = [0] * n
    for i, j in zip(order, [*order[1:], *order[:1]], strict=True):
        out[i] = j
    return tuple(out)


def _round(secret: bytes, tweak: str, x: list[int], bases: list[int], turn: int, sign: int) -> None:
    """Add to one half (or take away) keyed digits drawn from the other half."""
    n, half = len(x), len(x) // 2
    src, dst = (range(half), range(half, n)) if turn % 2 else (range(half, n), range(half))
    told = ",".join(str(x[i]) for i in src)
    for lo in range(0, len(dst), 12):
        z = _number(secret, "feistel", tweak, str(turn), str(lo), told)
        for i in dst[lo : lo + 12]:
            x[i] = (x[i] + sign * z) % bases[i]
            z //= bases[i]


def permute(secret: bytes, tweak: str, digits: list[int], bases: list[int]) -> list[int]:
    """A keyed permutation without fixed points of the mixed-radix numbers over ``bases``.

    An alternating Feistel network, a step to the next number, and the network undone:
    each part can be undone, and no number is its own successor.
    """
    if len(digits) < 2:
        return [_next_of(secret, tweak, b)[d] for d, b in zip(digits, bases, strict=True)]
    x = list(digits)
    for turn in range(6):
        _round(secret, tweak, x, bases, turn, 1)
    for i, b in enumerate(bases):
        x[i] = (x[i] + 1) % b
        if x[i]:
            break
    for turn in reversed(range(6)):
        _round(secret, tweak, x, bases, turn, -1)
    return x


def _letters(secret: bytes, tweak: str, text: str, fixed: int = 0) -> str:
    """Permute letters within their class and digits, all else and the case as they are."""
    at, digits, bases = [], [], []
    for i, c in enumerate(text[fixed:], fixed):
        low = c.lower()
        if c.isascii() and c.isdigit():
            at.append((i, "0123456789"))
            digits.append(int(c))
            bases.append(10)
        elif low in _CLASS_AT and len(c.lower()) == 1:
            k, j = _CLASS_AT[low]
            at.append((i, CLASSES[k]))
            digits.append(j)
            bases.append(len(CLASSES[k]))
    shape = "".join("9" if b == 10 else chr(97 + b) for b in bases)
    out = list(text)
    for (i, cls), d in zip(at, permute(secret, f"{tweak}|{shape}", digits, bases), strict=True):
        new = cls[d]
        out[i] = new.upper() if text[i] != text[i].lower() and len(new.upper()) == 1 else new
    return "".join(out)


def _chars(secret: bytes, tweak: str, text: str, alphabet: str) -> str:
    at = [i for i, c in enumerate(text) if c in alphabet]
    got = permute(secret, f"{tweak}|{len(at)}", [alphabet.index(text[i]) for i in at], [len(alphabet)] * len(at))
    out = list(text)
    for i, d in zip(at, got, strict=True):
        out[i] = alphabet[d]
    return "".join(out)


def luhn(digits: str) -> int:
    """What a number lacks to a right check digit, modulo 10."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10


def _card(secret: bytes, tweak: str, text: str) -> str:
    digits = "".join(c for c in text if c.isdigit())
    off = luhn(digits)
    body = _chars(secret, f"{tweak}|{digits[0]}", digits[1:-1], "0123456789")
    head = digits[0] + body
    last = next(str(d) for d in range(10) if luhn(head + str(d)) == off)
    new = iter(head + last)
    return "".join(next(new) if c.isdigit() else c for c in text)


def _cased(like: str, text: str) -> str:
    return text.upper() if like.isupper() and len(like) > 1 else text.lower() if like.islower() else text


def _name(secret: bytes, tweak: str, text: str) -> str:
    out = []
    for part in regex.split(r"( )", text):
        known = _GIVEN_AT.get(part.lower())
        if part.rstrip(".") in TITLES or part == " ":
            out.append(part)
        elif known:
            names = GIVEN[known[0]]
            out.append(_cased(part, names[_next_of(secret, f"{tweak}|given|{known[0]}", len(names))[known[1]]]))
        else:
            out.append(_letters(secret, f"{tweak}|family", part))
    return "".join(out)


def canonical(kind: str, text: str) -> str:
    """What makes two mentions the same entity."""
    return text.lower() if kind in ("email", "name") else text


def surrogate(kind: str, text: str, secret: bytes) -> str:
    """The surrogate of an entity; a permutation within the entity's format."""
    if kind == "email":
        user, _, host = text.rpartition("@")
        labels = host.split(".")
        keep = 1 if len(labels) < 3 else 2
        return f"{_letters(secret, 'email|u', user)}@{'.'.join([_letters(secret, 'email|h', x) for x in labels[:-keep]] + labels[-keep:])}"
    if kind == "access_key":
        return text[:4] + _chars(secret, kind, text[4:], "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
    if kind == "token":
        return _chars(secret, kind, text, "0123456789abcdef")
    if kind == "ip":
        return ".".join(map(str, permute(secret, kind, [int(o) for o in text.split(".")], [256] * 4)))
    if kind == "phone":
        code = regex.match(r"\+\d{1,3}(?=\D)", text)
        head = code.end() if code else 0
        return text[:head] + _chars(secret, f"{kind}|{text[:head]}", text[head:], "0123456789")
    if kind == "card":
        return _card(secret, kind, text)
    if kind == "name":
        return _name(secret, kind, text)
    return _letters(secret, kind, text, 2 if kind == "iban" else 0)


def _named_again(text: str, found: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Bare mentions of the names that a text has in full: their parts, on their own."""
    parts = {p for a, z, k in found if k == "name" for p in text[a:z].split(" ") if len(p) > 2 and p.rstrip(".") not in TITLES}
    if not parts:
        return []
    bare = regex.compile(rf"\b(?:{'|'.join(map(regex.escape, sorted(parts, key=lambda p: (-len(p), p))))})\b")
    taken = iter([*found, (len(text) + 1, len(text) + 1, "")])
    start, end, _ = next(taken)
    more = []
    for m in bare.finditer(text):
        while end <= m.start():
            start, end, _ = next(taken)
        if m.end() <= start:
            more.append((m.start(), m.end(), "name"))
    return more


def entities(text: str | None) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` of the entities of a text, in order and apart.

    No entity spans lines, and each holds a digit, an at sign, a run of hexadecimal letters, a key's mark, a title, a given name or words that introduce one:
    only lines with one of these are searched in full.
    """
    if not text:
        return []
    found, at, named = [], 0, {}
    for end, n in _openers().iter(text):
        named[text.rfind("\n", 0, end + 1)] = n
    for line in text.split("\n"):
        if (at - 1) in named or _SIGN.search(line):
            for m in _ALL.finditer(line):
                kind = m.lastgroup
                if kind != "card" or 13 <= sum(c.isdigit() for c in m[0]) <= 19:
                    found.append((at + m.start(), at + m.end(), kind))
        at += len(line) + 1
    more = _named_again(text, found)
    return sorted(found + more) if more else found


def replaced(text: str | None, secret: bytes) -> tuple[str | None, list[tuple[int, int, str, str, str]]]:
    """The text with surrogates, and ``(start, end, kind, entity, surrogate)`` by place in the old text."""
    out, at, spans = [], 0, []
    for start, end, kind in entities(text):
        old = text[start:end]
        new = surrogate(kind, old, secret)
        out += [text[at:start], new]
        spans.append((start, end, kind, old, new))
        at = end
    return ("".join([*out, text[at:]]) if spans else text), spans


SPANS = "array<struct<start: int, end: int, kind: string, entity: string, surrogate: string>>"


def pseudonymised(docs: DataFrame, secret: bytes) -> DataFrame:
    """``doc_id, text, spans`` with every entity replaced."""
    if len(secret) < LEAST_KEY:
        raise ValueError(f"the key has fewer than {LEAST_KEY} bytes")
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("entity", pa.string()), ("surrogate", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("start", "end", "kind", "entity", "surrogate")
        for b in batches:
            got = [replaced(t, secret) for t in b.column(1).to_pylist()]
            spans = [[dict(zip(names, s, strict=True)) for s in g[1]] for g in got]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got], pa.string()), pa.array(spans, kind)], names=["doc_id", "text", "spans"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, f"doc_id long, text string, spans {SPANS}")


def collisions(done: DataFrame) -> DataFrame:
    """``kind, surrogate, n`` of surrogates that stand for more than one entity."""
    s = done.select(F.explode("spans").alias("s")).select("s.kind", F.col("s.surrogate").alias("new"), F.col("s.entity").alias("old"))
    fold = lambda c: F.when(F.col("kind").isin("email", "name"), F.lower(c)).otherwise(F.col(c))
    pairs = s.select("kind", fold("new").alias("surrogate"), fold("old").alias("entity"))
    return pairs.groupBy("kind", "surrogate").agg(F.min("entity").alias("a"), F.max("entity").alias("z")).where("a <> z")


def checked(docs: DataFrame, secret: bytes) -> DataFrame:
    """``pseudonymised``, written once, after a check that fails if two entities share a surrogate."""
    done = written(pseudonymised(docs, secret), "surrogates")
    bad = collisions(done).limit(1).collect()
    if bad:
        raise ValueError(f"surrogates of type {bad[0]['kind']} collide")
    return done
