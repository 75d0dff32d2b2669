"""Surrogates for personal data.

Entities are found by patterns and by what stands before them (a title, an
introduction such as "my name is", a label such as "Name:", a known first
name), and replaced by a keyed permutation of their own kind and format: digits
by digits, letters by letters of the same script and case, known first names by
names of the same gender. Other names in ASCII letters become syllables with
an ending for women, for men or for neither, as the title before a first name
says; those in other Latin letters do if a title or a list tells their gender,
with an accent. A first name's gender is part of what it is, so `Ms Alex` and
`Mr Alex` are two. A permutation maps different entities of one format to different surrogates, and the same entity
to the same one wherever and however it is written, on any executor, without a
table of names. Kinds with a validity rule (card check digits, dialling codes,
public addresses) walk the permutation's cycle until the rule holds as it did
before. A pass over the distinct mentions checks that no surrogate stands for
two entities, and that no entity has two surrogates; a kind for which that
fails is permuted anew.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ["email", "phone", "ip", "card", "name", "iban", "ssn"]
ROUNDS = 8
#: Characters that are permuted at a time; longer values are permuted in blocks, each by what is before it.
BLOCK = 64

#: Titles by gender, and first names by gender.
FEMALE_TITLES = "Mrs Ms Miss Frau Mme Mlle Madame Señora Señorita Sra Signora Doña"
MALE_TITLES = "Mr Herr Monsieur Señor Sr Signor Don"
OTHER_TITLES = "Dr Prof Mx"
#: Words that end a name and are none; words before a name, and labels of fields that hold one.
SUFFIXES = "Sr Jr II III IV PhD MD"
INTRODUCTIONS = "my name is|my full name is|mein name ist|ich heiße|je m'appelle|je m’appelle|mon nom est|me llamo|mi nombre es|mi chiamo|meu nome é"
LABELS = "name|full name|first name|last name|given name|surname|nombre|apellido|apellidos|nom|prénom|vorname|nachname|nome|cognome"
FEMALE = (
    "Alice Anna Barbara Carmen Caroline Charlotte Claire Clara Elena Elisabeth Emily Emma Eva Hannah Helen Ines Isabel Jane Julia "
    "Karin Laura Linda Lucia Maria Marie Martha Mary Monika Nina Olivia Paula Petra Rosa Sandra Sarah Sofia Sophie Susan Teresa Ursula"
).split()
MALE = (
    "Adam Albert Alex Andreas Antonio Carlos Charles Daniel David Diego Edward Felix Frank George Hans Henry Hugo Ivan Jack James "
    "Jan Javier John Jorge Karl Louis Luis Manuel Mark Martin Michael Otto Pablo Paul Peter Pierre Robert Stefan Thomas William"
).split()

#: Letters that are permuted among themselves. Any other letter is permuted among those of its case in its 256 code points.
_ALPHABETS = [
    "abcdefghijklmnopqrstuvwxyz",
    "абвгдежзийклмнопрстуфхцчшщъыьэюя",
    "αβγδεζηθικλμνξοπρστυφχψω",
    "0123456789",
]
_OF = {c: a for a in _ALPHABETS for c in a}
_ASCII_LOWER = _ALPHABETS[0]
#: Lower-case Latin letters up to U+017F, plain ones first.
_LATIN_LOWER = _ASCII_LOWER + "".join(c for c in map(chr, range(0xDF, 0x180)) if c.isalpha() and c == c.lower() and len(c.upper()) == 1)
_LATIN_AT = {c: i for i, c in enumerate(_LATIN_LOWER)}


@lru_cache(4096)
def _alphabet(c: str) -> str:
    """The letters that may stand for lower-case c, itself included; c alone where it is no letter."""
    if c in _OF:
        return _OF[c]
    if not c.isalpha():
        return c
    page = ord(c) & ~255
    same = [chr(x) for x in range(page, page + 256)]
    return "".join(x for x in same if x.isalpha() and x not in _OF and x == x.lower() and unicodedata.category(x) == unicodedata.category(c))


#: Syllables of surrogate names, and their endings by gender, in which no listed name ends.
_SYLLABLES = [c + v for c in "bcdfghjklmnprstvwz" for v in "aeiou"]
_ENDINGS = {"female": "lina", "male": "dus", "": "sen"}
_ACCENTED_ENDINGS = {"female": "lína", "male": "dús"}


@lru_cache(512)
def _lengths(syllables: int, letters: int) -> range:
    """Lengths of the words, in an alphabet of so many letters, that so many syllables stand for: each length has one number of syllables, and as many as there are words."""
    low = 1
    for k in range(1, syllables + 1):
        high, words = low, 0
        while (words := words + letters**high) <= len(_SYLLABLES) ** k:
            high += 1
        if k == syllables:
            return range(low, high)
        low = high
    return range(0)


@lru_cache(256)
def _syllables_for(length: int, letters: int = len(_ASCII_LOWER)) -> tuple[int, int, int]:
    """(syllables, number of the first word of that length, words in all) for words of a length."""
    k = 1
    while length not in (own := _lengths(k, letters)):
        k += 1
    return k, sum(letters**n for n in range(own.start, length)), sum(letters**n for n in own)


#: Country calling codes by length; a number that begins with none of them has its first digit for one.
_CODES = {
    1: "1 7",
    2: "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98",
    3: (
        "211 212 213 216 218 220 221 222 223 224 225 226 227 228 229 230 231 232 233 234 235 236 237 238 239 240 241 242 243 244 245 246 247 248 "
        "249 250 251 252 253 254 255 256 257 258 260 261 262 263 264 265 266 267 268 269 290 291 297 298 299 350 351 352 353 354 355 356 357 358 "
        "359 370 371 372 373 374 375 376 377 378 380 381 382 383 385 386 387 389 420 421 423 500 501 502 503 504 505 506 507 508 509 590 591 592 "
        "593 594 595 596 597 598 599 670 672 673 674 675 676 677 678 679 680 681 682 683 685 686 687 688 689 690 691 692 800 808 850 852 853 855 "
        "856 870 878 880 881 882 883 886 888 960 961 962 963 964 965 966 967 968 970 971 972 973 974 975 976 977 979 992 993 994 995 996 998"
    ),
}
CODES = {c for codes in _CODES.values() for c in codes.split()}

_TITLES = "|".join(f"{FEMALE_TITLES} {MALE_TITLES} {OTHER_TITLES}".split())
_GENDER = {t: g for g, titles in (("female", FEMALE_TITLES), ("male", MALE_TITLES)) for t in titles.split()}
_SUFFIX = frozenset(SUFFIXES.split())
#: A word of a name, of any length: possessive, so that no part of it is tried again.
_NAME = r"[^\W\d_]++"
#: Words of a name, of which those after the first begin with no lower-case letter.
_NAMES = rf"{_NAME}(?:[ '’-](?![a-zß-öø-ÿа-яёά-ώ]){_NAME}){{0,4}}"
_EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[._%+-]*+(?P<email>[A-Za-z0-9][A-Za-z0-9._%+-]*+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++)")
_PATTERN = re.compile(
    r"(?<![\w.])(?P<ip>(?:\d{1,3}\.){3}\d{1,3})(?![\w]|\.\d)"
    r"|(?<![\w:.])(?P<ip6>(?=[0-9A-Fa-f]{0,4}:[0-9A-Fa-f]{0,4}:)[0-9A-Fa-f:]{3,39})(?![\w:]|\.\d)"
    r"|(?<!\w)(?P<iban>[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?!\w)"
    r"|(?<![\w-])(?P<ssn>\d{3}-\d{2}-\d{4})(?![\w-])"
    r"|(?<![\w+])(?P<phone>\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\w)"
    r"|(?<![\w.])(?P<card>\d(?:[ -]?\d){12,18})(?!\w)"
    r"|(?<![\w.+-])(?P<local>\d{3} \d{3} \d{4}|\(?0\d{1,4}(?:\) ?|[ /-])\d{3,8}(?:[ -]\d{2,4}){0,3})(?![\w-])"
    rf"|\b(?P<title>{_TITLES})\b\.? (?P<name>{_NAMES})"
)
#: A known first name and a word that begins with a capital: a name without a title.
_GIVEN = re.compile(rf"(?<!\w)(?=[A-ZÀ-Þ])(?:{'|'.join(FEMALE + MALE)}) (?=[^\W\d_a-zß-öø-ÿ]){_NAMES}")
_INTRODUCED = re.compile(rf"(?<!\w)(?i:{INTRODUCTIONS}|(?:{LABELS})[ \t]?:)[ \t]+(?=[^\W\d_a-zß-öø-ÿ])(?P<name>{_NAMES})")
#: Parts of all introductions and labels with their colons, of which a text without any has none.
_INTRODUCING = ("name", "nom", "heiße", "appelle", "llamo", "chiamo", "apellido")
_HINT = re.compile(rf"[@\d]|[0-9A-Fa-f]:|\b(?=[A-Z])(?:{_TITLES}|{'|'.join(FEMALE + MALE)})\b")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


class Surrogates:
    """Keyed replacements; ``attempt`` of a kind changes all of its replacements."""

    def __init__(self, key: bytes, attempts: dict[str, int] | None = None):
        self.key, self.attempts = key, attempts or {}
        self.pools = {}
        for label, pool in (("female", FEMALE), ("male", MALE)):
            order = sorted(pool, key=lambda n: self._mac("name", label, n))
            self.pools |= {a.lower(): b for a, b in zip(order, order[1:] + order[:1], strict=True)}
        self.text = lru_cache(200_000)(self._text)

    def _mac(self, kind: str, *parts: object) -> int:
        data = "\x00".join(map(str, (kind, self.attempts.get(kind, 0), *parts)))
        return int.from_bytes(hmac.digest(self.key, data.encode("utf-8", "surrogatepass"), hashlib.sha256), "big")

    def _feistel(self, kind: str, label: str, x: int, n: int, rounds: list[int]) -> int:
        """A keyed permutation of 0 to n - 1, or its inverse with the rounds reversed, walking cycles into range."""
        half = (max(2, (n - 1).bit_length()) + 1) // 2
        mask = (1 << half) - 1
        back = rounds[0] > rounds[-1]
        while True:
            a, b = x >> half, x & mask
            for r in rounds:
                if back:
                    a, b = b ^ (self._mac(kind, label, n, r, a) & mask), a
                else:
                    a, b = b, a ^ (self._mac(kind, label, n, r, b) & mask)
            x = a << half | b
            if x < n:
                return x

    def permute(self, kind: str, label: str, x: int, n: int) -> int:
        """A keyed permutation of 0 to n - 1 that is one cycle: nothing stays as it is where n is over 1."""
        if n < 2:
            return x
        rounds = list(range(ROUNDS))
        at = self._feistel(kind, label, x, n, rounds)
        return self._feistel(kind, label, (at + 1) % n, n, rounds[::-1])

    def digits(self, kind: str, value: str, valid: Callable[[str], bool] = lambda s: True) -> str:
        """Other digits in place of value's, valid as they are; the cycle has value itself on it, so it ends."""
        n, was, at = 10 ** len(value), valid(value), value
        while True:
            at = str(self.permute(kind, "digits", int(at), n)).zfill(len(value))
            if valid(at) == was:
                return at

    def letters(self, kind: str, value: str) -> str:
        """Letters of the same script for lower-case letters, digits for digits; other characters stay.

        A block after the first is permuted in a way that depends on all before it, so that the whole is one permutation.
        """
        if len(value) <= BLOCK:
            return self._block(kind, value, "")
        out, before = [], hashlib.sha256()
        for k in range(0, len(value), BLOCK):
            out.append(self._block(kind, value[k : k + BLOCK], before.hexdigest() if k else ""))
            before.update(value[k : k + BLOCK].encode("utf-8", "surrogatepass"))
        return "".join(out)

    def _block(self, kind: str, value: str, before: str) -> str:
        alphabets = [_alphabet(c) for c in value]
        shape = "".join(a[0] for a in alphabets)
        n, x = 1, 0
        for c, a in zip(value, alphabets, strict=True):
            n, x = n * len(a), x * len(a) + a.index(c)
        x, out = self.permute(kind, shape + before, x, n), []
        for a in reversed(alphabets):
            x, k = divmod(x, len(a))
            out.append(a[k])
        return "".join(reversed(out))

    def syllables(self, value: str, gender: str) -> str:
        """Syllables and an ending for a lower-case word of ASCII letters, or of Latin ones with a gender: one for each word and gender."""
        plain = value.isascii()
        letters, endings = (len(_ASCII_LOWER), _ENDINGS) if plain else (len(_LATIN_LOWER), _ACCENTED_ENDINGS)
        k, first, n = _syllables_for(len(value), letters)
        x = 0
        for c in value:
            x = x * letters + _LATIN_AT[c]
        x, out = self.permute("name", f"syllables:{k}:{gender}{'' if plain else ':accented'}", first + x, n), []
        for _ in range(k):
            x, s = divmod(x, len(_SYLLABLES))
            out.append(_SYLLABLES[s])
        return "".join(out) + endings[gender]

    def _text(self, kind: str, value: str, gender: str = "") -> tuple[str, str]:
        """(entity, surrogate) for a mention: the entity is the same however it is written; a first name's gender is part of it."""
        if kind == "email":
            local, _, domain = value.lower().partition("@")
            host, _, top = domain.rpartition(".")
            entity = f"{local}@{domain}"
            new = f"{self.letters(kind, local)}@{self.letters(kind, host)}.{top}"
            return entity, _cased(value, new)
        if kind == "ip" and ":" in value:
            # The first group tells the kind of address and stays; two spellings of an address get one surrogate.
            address = ipaddress.IPv6Address(value)
            low = self.permute(kind, "ip6", int(address) & _LOW, 1 << 112)
            new = ipaddress.IPv6Address(int(address) & ~_LOW | low)
            shown = new.exploded if len(value) == 39 else new.compressed
            return address.compressed, shown.upper() if value != value.lower() else shown
        if kind == "iban":
            return self._account(value)
        if kind == "ssn":
            return value, _hyphened(self.digits(kind, value.replace("-", ""), _insured))
        if kind == "ip":
            number = sum(int(p) << (24 - 8 * i) for i, p in enumerate(value.split(".")))
            was, at = _public(number), number
            while _public(at := self.permute(kind, "ip", at, 1 << 32)) != was:
                pass
            return str(number), ".".join(str(at >> s & 255) for s in (24, 16, 8, 0))
        if kind == "phone":
            return self._spelled(kind, value, _dialled)
        if kind == "card":
            return self._spelled(kind, value, _luhn)
        low = value.lower()
        own = _gender_of(low)
        if own and gender in ("", own) and low in self.pools:
            return low, _cased(value, self.pools[low].lower())
        gender = gender or own
        if len(low) > BLOCK or not all(c in _LATIN_AT for c in low) or not (gender or low.isascii()):
            return low, _cased(value, self.letters(kind, low))
        return f"{gender}:{low}" if gender else low, _cased(value, self.syllables(low, gender))

    def _account(self, value: str) -> tuple[str, str]:
        """A bank account's country stays; its check digits are those of the new number."""
        plain = value.replace(" ", "")
        number = self.letters("iban", plain[4:].lower()).upper()
        new = iter(f"{plain[:2]}{98 - _mod97(number + plain[:2] + '00'):02d}{number}")
        return plain, "".join(c if c == " " else next(new) for c in value)

    def _spelled(self, kind: str, value: str, valid: Callable[[str], bool]) -> tuple[str, str]:
        """Digits replaced where they stand; a leading country code stays, whatever follows it."""
        every = "".join(c for c in value if c.isdigit())
        head = _code(every) if kind == "phone" and value.startswith("+") else ""
        new = iter(head + self.digits(kind, every[len(head) :], valid))
        return f"{'+' * bool(head)}{every}", "".join(next(new) if c.isdigit() else c for c in value)


def _code(digits: str) -> str:
    """The country code that an international number's digits begin with."""
    return next((digits[:n] for n in (1, 2, 3) if digits[:n] in CODES), digits[:1])


def _public(number: int) -> bool:
    first = number >> 24
    return 0 < first < 224 and first not in (10, 127) and not (first == 192 and number >> 16 & 255 == 168) and not (first == 172 and 16 <= (number >> 16 & 255) < 32)


def _dialled(digits: str) -> bool:
    """Whether ten digits have an area and an exchange code that may begin one; others always count."""
    return len(digits) != 10 or (digits[0] > "1" and digits[3] > "1")


_FEMALE_LOWER, _MALE_LOWER = ({n.lower() for n in pool} for pool in (FEMALE, MALE))
#: The bits of an IPv6 address after its first group.
_LOW = (1 << 112) - 1


def _gender_of(low: str) -> str:
    """The gender of a known first name, whatever its accents."""
    if not low.isascii():
        low = "".join(c for c in unicodedata.normalize("NFD", low) if not unicodedata.combining(c)) if len(low) <= BLOCK else low
    return "female" if low in _FEMALE_LOWER else "male" if low in _MALE_LOWER else ""


def _mod97(characters: str) -> int:
    return int("".join(str(int(c, 36)) for c in characters)) % 97


def _insured(digits: str) -> bool:
    """Whether nine digits may be a social-security number of the United States."""
    return digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000"


def _hyphened(digits: str) -> str:
    return f"{digits[:3]}-{digits[3:5]}-{digits[5:]}"


def _address6(value: str) -> bool:
    """Whether value is an IPv6 address of a host; with an abbreviation it needs three groups and a digit, as no name in code has."""
    if "::" in value and (len([g for g in value.split(":") if g]) < 3 or not any(c.isdigit() for c in value)):
        return False
    try:
        return int(ipaddress.IPv6Address(value)) > 1
    except ValueError:
        return False


def _account_end(value: str) -> int:
    """Length of the longest beginning of value, up to the end of a word, that is a bank account number; 0 if none."""
    for end in range(len(value), 14, -1):
        if not value[end : end + 1].isalnum() and value[end - 1] != " ":
            plain = value[:end].replace(" ", "")
            if 15 <= len(plain) <= 34 and _mod97(plain[4:] + plain[:4]) == 1:
                return end
    return 0


def _cased(old: str, new: str) -> str:
    if len(old) != len(new):
        return new.upper() if old.isupper() and len(old) > 1 else new.capitalize() if old[:1].isupper() else new
    return "".join(n.upper() if o.isupper() and len(n.upper()) == 1 else n for o, n in zip(old, new, strict=True))


def _accepted(m: re.Match) -> tuple[str, int, int] | None:
    """(kind, start, end) of a match that keeps to the rules of its kind."""
    kind, value = m.lastgroup, m.group(m.lastgroup)
    start, end = m.span(kind)
    if kind == "ip":
        return (kind, start, end) if all(int(p) < 256 for p in value.split(".")) else None
    if kind == "ip6":
        return ("ip", start, end) if _address6(value) else None
    if kind == "iban":
        size = _account_end(value)
        return (kind, start, start + size) if size else None
    if kind == "ssn":
        return (kind, start, end) if _insured(value.replace("-", "")) else None
    if kind == "local":
        return ("phone", start, end) if 9 <= sum(map(str.isdigit, value)) <= 12 else None
    return kind, start, end


def _matches(text: str) -> Iterator[tuple[re.Match, tuple[str, int, int]]]:
    """Matches that keep to the rules of their kinds, and their spans; what one that does not covers is looked at again."""
    at = 0
    while m := _PATTERN.search(text, at):
        one = _accepted(m)
        if one:
            yield m, one
        at = one[2] if one else m.start() + 1


def _named(text: str, start: int, end: int, gender: str) -> list[tuple[str, int, int, str]]:
    """The words of a name; the first of several, or a known one, is a first name and has the gender."""
    words = [w for w in re.compile(_NAME).finditer(text, start, end) if w.group() not in _SUFFIX]
    first = lambda i, w: i == 0 and (len(words) > 1 or _gender_of(w.group().lower()) != "")
    return [("name", *w.span(), gender if first(i, w) else "") for i, w in enumerate(words)]


def find(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, gender) of the entities of a text, in order; a name found once is found again wherever it stands.

    The first of several names after a title, or a listed one, is a first name and has the title's gender, if that has one,
    or else the one that it has by another title in the same text, if that is one only.
    """
    introduced = any(x in low for x in _INTRODUCING) if (low := text.lower()) else False
    if not introduced and not _HINT.search(text):
        return []
    spans = [("email", *m.span("email"), "") for m in _EMAIL.finditer(text)] if "@" in text else []
    if spans:
        # What is part of an address is nothing else.
        pieces, at = [], 0
        for _, a, z, _ in spans:
            pieces += [text[at:a], "\x00" * (z - a)]
            at = z
        text = "".join([*pieces, text[at:]])
    for m, one in _matches(text):
        spans += _named(text, *one[1:], _GENDER.get(m.group("title"), "")) if one[0] == "name" else [(*one, "")]
    taken = sorted((a, z) for _, a, z, _ in spans)

    def free(start: int, end: int, starts: list[int]) -> bool:
        k = bisect_right(starts, start) - 1
        return not (k >= 0 and taken[k][1] > start) and not (k + 1 < len(taken) and taken[k + 1][0] < end)

    for pattern in [_GIVEN, _INTRODUCED][: 1 + introduced]:
        starts = [a for a, _ in taken]
        more = [w for m in pattern.finditer(text) for w in _named(text, *m.span(pattern.groups), "") if free(w[1], w[2], starts)]
        spans += more
        taken = sorted([*taken, *((a, z) for _, a, z, _ in more)])
    genders = {}
    for kind, a, z, gender in spans:
        if kind == "name":
            genders.setdefault(text[a:z], set()).update({gender} - {""})
    if genders:
        of = {w: next(iter(g)) if len(g) == 1 else "" for w, g in genders.items()}
        spans = [(k, a, z, g or of[text[a:z]] if k == "name" else g) for k, a, z, g in spans]
        starts = [a for a, _ in taken]
        # Words are looked up one by one: a pattern of all names would try each at each place.
        for m in re.finditer(rf"(?<![\w]){_NAME}(?![\w])", text):
            if m.group() in of and free(m.start(), m.end(), starts):
                spans.append(("name", *m.span(), of[m.group()]))
    return sorted(spans, key=lambda s: s[1])


def replaced(text: str, surrogates: Surrogates) -> tuple[str, list[tuple[str, int, int, str]]]:
    spans, out, at = find(text), [], 0
    for kind, a, z, gender in spans:
        out += [text[at:a], surrogates.text(kind, text[a:z], gender)[1]]
        at = z
    return ("".join([*out, text[at:]]) if spans else text), spans


def mentions(docs: DataFrame, key: bytes, attempts: dict[str, int], text_col: str = "text") -> DataFrame:
    """Distinct (kind, entity, surrogate); entities and surrogates as keyed digests, not in the clear."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Surrogates(key, attempts)
        mac = lambda kind, what, x: hmac.digest(key, f"{what}\x00{kind}\x00{x}".encode("utf-8", "surrogatepass"), hashlib.sha256)
        for b in batches:
            rows = set()
            for text in b.column(0).to_pylist():
                for kind, a, z, gender in find(text):
                    entity, new = s.text(kind, text[a:z], gender)
                    # A surrogate stands for what a reader would take it for: its entity, not its spelling.
                    if kind == "ip" and ":" in new:
                        shown = ipaddress.IPv6Address(new).compressed
                    elif kind in ("email", "name", "iban"):
                        shown = new.casefold().replace(" ", "")
                    else:
                        shown = "".join(c for c in new if c.isdigit() or c == "." and kind == "ip")
                    shown = "+" * (kind == "phone" and new.startswith("+")) + shown
                    rows.add((kind, mac(kind, "entity", entity), mac(kind, "shown", shown)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.binary(), pa.binary()))], names=["kind", "entity", "shown"])

    return docs.select(F.col(text_col).alias("text")).dropna().mapInArrow(found, "kind string, entity binary, shown binary").distinct()


def settled(docs: DataFrame, key: bytes, text_col: str = "text", tries: int = 8) -> dict[str, int]:
    """Attempts of each kind under which no surrogate stands for two entities of docs, and no entity has two."""
    attempts = dict.fromkeys(KINDS, 0)
    for _ in range(tries):
        found = mentions(docs, key, attempts, text_col)
        clash = [found.groupBy("kind", c).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("kind") for c in ("shown", "entity")]
        bad = [r["kind"] for r in clash[0].union(clash[1]).distinct().collect()]  # at most one row for each kind
        if not bad:
            return attempts
        for kind in bad:
            attempts[kind] += 1
    raise ValueError(f"surrogates of {bad} still collide; choose another key")


def pseudonymise(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: (id_col, text_col, n_entities, spans).

    The text has surrogates for its e-mail addresses, telephone numbers, IP
    addresses of both versions, card numbers, bank accounts (IBAN, by its check
    digits), social-security numbers of the United States, and names after
    titles, introductions, labels and known first names, whatever their lengths;
    spans are kind:start:end in code points of the old text, joined by commas.
    Null texts stay null, with no entities; texts without entities stay as they
    are. Equal rows get equal results; an empty table gives none; other columns
    are ignored, and ids may be null. Work grows with a text's length, also
    where it is one run.
    """
    attempts = settled(docs, key, text_col)
    kind = docs.schema[id_col].dataType.simpleString()

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Surrogates(key, attempts)
        for b in batches:
            got = [(None, []) if t is None else replaced(t, s) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([t for t, _ in got], pa.string()), pa.array([len(x) for _, x in got], pa.int64()), pa.array([",".join(f"{k}:{a}:{z}" for k, a, z, _ in x) for _, x in got], pa.string())],
                names=["id", "text", "n_entities", "spans"],
            )

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(replace, f"id {kind}, text string, n_entities bigint, spans string")
    return out.select(F.col("id").alias(id_col), F.col("text").alias(text_col), "n_entities", "spans")
