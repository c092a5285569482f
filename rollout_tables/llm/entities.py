"""Detection of personal data in a text, and keyed surrogates for it.

Kinds: email (domains of any script), ipv4, ipv6 (with a digit, and not only
zeros and ones), iban (with valid check digits, grouped or not), phone (7 to 15 digits: after + or 00 in any grouping, else
in groups, with a trunk 0, or as a plain run of 10 or 11; other plain runs,
dates, spans of years and decimals are no phones), card (13 to 19 digits, plain
or in groups, that pass the Luhn check), secret (a token after a name such as
token or key, quoted or not) and name (after an honorific, which may be in
capitals where the name is, in Latin, Cyrillic or Greek script: up to four
parts, with initials, hyphens, apostrophes and particles).
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re

KINDS = ["email", "phone", "ipv4", "ipv6", "iban", "card", "secret", "name"]

# Honorifics by gender, and given and family names by script and
# gender from which surrogate names start.
HONORIFICS = {
    "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа", "Κυρία"],
    "m": ["Mr", "Sir", "Herr", "Monsieur", "Señor", "Sr", "Господин", "Κύριος"],
    "x": ["Dr", "Prof"],
}
GIVEN = {
    ("latin", "f"): ["Anna", "Clara", "Elena", "Helen", "Julia", "Laura", "Maria", "Nina", "Paula", "Rosa", "Sofia", "Vera"],
    ("latin", "m"): ["Adam", "Bruno", "Carl", "David", "Emil", "Hugo", "Jonas", "Karl", "Leon", "Martin", "Oscar", "Paul"],
    ("cyrillic", "f"): ["Анна", "Вера", "Елена", "Ирина", "Мария", "Нина", "Ольга", "Софья"],
    ("cyrillic", "m"): ["Антон", "Борис", "Иван", "Олег", "Павел", "Роман", "Сергей", "Юрий"],
    ("greek", "f"): ["Άννα", "Ελένη", "Ειρήνη", "Μαρία", "Σοφία", "Χλόη"],
    ("greek", "m"): ["Γιάννης", "Δημήτρης", "Κώστας", "Νίκος", "Πέτρος", "Στέφανος"],
}
SYLLABLES = {
    "latin": ["ba", "de", "fo", "ga", "hi", "ka", "le", "mo", "na", "pe", "ri", "so", "ta", "ve", "wi", "zu"],
    "cyrillic": ["ба", "ве", "го", "да", "жу", "ки", "ло", "ми", "на", "пе", "ро", "са", "ту", "фе", "ша", "ю"],
    "greek": ["βα", "γε", "δο", "ζη", "θα", "κι", "λο", "μα", "νε", "πο", "ρα", "σι", "τα", "φο", "χα", "ψη"],
}
ENDINGS = {"latin": "son", "cyrillic": "енко", "greek": "ίδης"}

GIVEN_ENDINGS = {"latin": {"f": "na", "m": "rn", "x": "el"}, "cyrillic": {"f": "на", "m": "рн", "x": "ель"}, "greek": {"f": "να", "m": "ρος", "x": "ελ"}}

# Particles of family names, what may follow a name and is no part
# of it, and honorifics that in capitals are mostly other abbreviations.
PARTICLES = ["al", "bin", "da", "das", "de", "del", "della", "den", "der", "di", "dos", "du", "el", "ibn", "la", "le", "ten", "ter", "van", "von", "y", "zu"]
SUFFIXES = ["Jr", "Sr", "II", "III", "IV", "MD", "PhD", "Esq"]
NOT_IN_CAPITALS = ["MS", "SR"]

_TITLES = sorted((t for ts in HONORIFICS.values() for t in ts), key=len, reverse=True)
_CAPITALS = [t.upper() for t in _TITLES if t.upper() not in NOT_IN_CAPITALS]
_CAPITAL = r"[A-ZÀ-ÖØ-ÞΆ-ΏΑ-ΫЀ-Я]"
_NAME = rf"{_CAPITAL}(?:[^\W\d_]+|['’]{_CAPITAL}[^\W\d_]+)(?:['’-]{_CAPITAL}[^\W\d_]+)*"
_INITIAL = rf"{_CAPITAL}\."
_BETWEEN = rf" (?:(?:{'|'.join(PARTICLES)}) )*"
_WHOLE = rf"(?:(?:{'|'.join(PARTICLES)}) )*(?:{_INITIAL} ?){{0,3}}{_NAME}(?:(?: {_INITIAL}){{0,2}}{_BETWEEN}(?!(?:{'|'.join(SUFFIXES)})\b){_NAME}){{0,3}}"
NUMBERS = re.compile(r"[+(0-9][0-9 .()/\-]{6,}")  # where an address, phone or card can be
_SEP = r"[ ./-]"
_GROUP = rf"(?:(?<=\))\d{{1,12}}|{_SEP}{{1,2}}\d{{1,12}}|{_SEP}{{0,2}}\(\d{{1,5}}\))"  # one way to read any run
DIGITS = re.compile(
    r"(?P<ipv4>(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d))"
    r"|(?P<card>(?<![\w.+])(?:\d{13,19}|\d{4}(?P<sep>[ -])\d{4,6}(?P=sep)\d{4,5}(?:(?P=sep)\d{1,4}){0,2})(?![\w]|[.-]\d))"
    # dates, spans of years, and numbers with thousands or decimals
    r"|(?P<other>(?<![\w.+])(?:(?:1[5-9]|20)\d\d(?P<d1>[-./ ])(?:0?[1-9]|1[0-2])(?P=d1)(?:3[01]|[12]\d|0?[1-9])|(?:3[01]|[12]\d|0?[1-9])(?P<d2>[-./ ])(?:3[01]|[12]\d|0?[1-9])(?P=d2)(?:1[5-9]|20)\d\d"
    r"|(?:1[5-9]|20)\d\d *[-/] *(?:1[5-9]|20)\d\d|\d{1,3}(?:\.\d{3})+|\d+\.\d+)(?![\w]|[./-]\d))"
    rf"|(?P<phone>(?<![\w+.])(?:(?:\+|00) ?(?:\(\d{{1,5}}\)|\d+){_GROUP}*|(?:\d{{1,3}}{_SEP})?\(\d{{2,5}}\){_GROUP}+"
    rf"|0\d{{1,5}}(?:{_SEP}\d{{2,8}})+|\d{{1,4}}(?:{_SEP}\d{{2,4}}){{1,5}}|0\d{{6,14}}|\d{{10,11}})(?![\w]))")
LAST_GROUP = re.compile(r"[ ./-]*\(?\d+\)?\Z")
EMAIL = re.compile(r"(?<![\w.+%-])[\w+%-]+(?:\.[\w+%-]+)*@(?:[^\W_]+(?:-+[^\W_]+)*\.)+(?:xn--[a-z0-9-]*[a-z0-9]|[A-Za-z]{2,}|[^\W\d_]{2,})")
IPV6 = re.compile(r"(?<![\w:.])[0-9A-Fa-f]{1,4}:(?:[0-9A-Fa-f]{0,4}:){1,6}[0-9A-Fa-f]{0,4}(?![\w:])")
COLONS = re.compile(r":[0-9A-Fa-f]{0,4}:")  # without which no ipv6 is looked for
IBAN = re.compile(r"[A-Z](?<!\w.)[A-Z]\d{2}(?:[ -]?[A-Z0-9]{4}){2,7}(?:[ -]?[A-Z0-9]{1,3})?(?!\w)")
SECRET = re.compile(r"(?i)(?<![a-z0-9])(?:token|secret|password|passwd|api[_-]?key|key)[\"']?\s*[=:]\s*(?:([\"'])(?P<quoted>[0-9a-f]{16,}|[A-Za-z0-9_\-]{24,})\1"
                    r"|(?P<bare>[0-9a-f]{16,}(?![\w(\[/+=-])|(?=[a-z_+/-]*\d)[a-z0-9_+/-]{24,}={0,2}(?![\w(\[.])))")
NAME = re.compile(rf"(?P<title>{'|'.join(_TITLES)}|(?:{'|'.join(_CAPITALS)})(?=\.? [^a-zß-öø-ÿα-ωа-я]{{2}}))\.? (?P<name>{_WHOLE})")
INTRODUCED = [t + end for t in [*_TITLES, *_CAPITALS] for end in (" ", ". ")]  # a plain search, far cheaper than NAME
PART = re.compile(rf"{_NAME}|{_INITIAL}")
WORD = re.compile(rf"(?<![^\W\d_]){_NAME}")
HYPHENED = re.compile(r"[^-]+")  # the parts of a word
WITHIN = re.compile(rf"\.?(?: |{_BETWEEN})?")  # between the parts of one name


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def script_of(word: str) -> str:
    c = ord(word[0])
    return "cyrillic" if 0x400 <= c < 0x530 else "greek" if 0x370 <= c < 0x400 else "latin"


def _gender(title: str) -> str:
    return next(g for g, titles in HONORIFICS.items() for t in titles if title in (t, t.upper()))


def _plain(word: str) -> str:
    """A word in capitals as the name is else written."""
    return word.title().replace("’", "'") if word.isupper() else word.replace("’", "'")


def iban_valid(compact: str) -> bool:
    return 15 <= len(compact) <= 34 and int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97 == 1


def _names(text: str) -> list[tuple[int, int, str, str]]:
    """Names after honorifics, and bare mentions of the same names in the text.

    The parts of a name are entities of their own: family|script|word for the
    last (each half of a double name), gender|script|word for given names and
    initial|script|letter, so the
    full name, title and family name, and bare mentions agree; particles stay.
    A title without gender takes the one that
    the text gives the full name elsewhere, else the family name."""
    if not any(t in text for t in INTRODUCED):
        return []
    titled = [m for m in NAME.finditer(text) if not (m.start() and (text[m.start() - 1].isalnum() or text[m.start() - 1] == "_"))]
    if not titled:
        return []
    parts = [list(PART.finditer(text, *m.span("name"))) for m in titled]
    known_as = [[_plain(p.group()) for p in ps] for ps in parts]
    genders: dict[str, set] = {}
    for m, words in zip(titled, known_as):
        for known in {" ".join(words), words[-1]}:
            genders.setdefault(known, set()).add(_gender(m.group("title")))
    out, bare = [], {}
    for m, ps, words in zip(titled, parts, known_as):
        gender = _gender(m.group("title"))
        if gender == "x":
            for known in (" ".join(words), words[-1]):
                met = genders[known] - {"x"}
                if len(met) == 1:
                    gender = next(iter(met))
                    break
                if met:
                    break
        for role, p, word in zip([gender] * (len(words) - 1) + ["family"], ps, words):
            if word.endswith("."):
                out.append((p.start(), p.end() - 1, "name", f"initial|{script_of(word)}|{word[0]}"))
                continue
            for piece in HYPHENED.finditer(text, *p.span()):
                written = _plain(piece.group())
                identity = f"{role}|{script_of(written)}|{written}"
                out.append((*piece.span(), "name", identity))
                bare.setdefault(written, identity)
    taken = {start for start, *_ in out}
    out += [(*p.span(), "name", bare[_plain(p.group())]) for m in WORD.finditer(text) for p in HYPHENED.finditer(text, *m.span())
            if p.start() not in taken and _plain(p.group()) in bare]
    return out


def mentions(found: list[tuple[int, int, str, str]], text: str) -> int:
    """Places of entities; the parts of a name side by side are one."""
    return len(found) - sum(a[2] == b[2] == "name" and (text[a[1]:b[0]] == "-" or not a[3].startswith("family|") and bool(WITHIN.fullmatch(text, a[1], b[0])))
                            for a, b in zip(found, found[1:]))


def detect(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, identity) without overlaps, in order. The identity is
    what all spellings of one entity share: digits of a phone or card, the
    lower-case or compressed address, the account without its grouping, and of
    a name each part by itself (``_names``)."""
    found = []
    if "@" in text:
        found += [(m.start(), m.end(), "email", m.group().lower()) for m in EMAIL.finditer(text)]
    for m in (m for n in NUMBERS.finditer(text) for m in DIGITS.finditer(text, n.start(), n.end() + 2)):
        kind = next(k for k in ("ipv4", "card", "other", "phone") if m.group(k))
        written = m.group()
        while kind == "phone" and sum(map(str.isdigit, written)) > 15 and (shorter := LAST_GROUP.sub("", written)):
            written = shorter  # numbers that stand behind it
        identity = written if kind == "ipv4" else re.sub(r"\D", "", written)
        if kind == "card" and not (13 <= len(identity) <= 19 and luhn(identity)) or kind == "phone" and not 7 <= len(identity) <= 15:
            kind = "other"
        if kind != "other":
            found.append((m.start(), m.start() + len(written), kind, identity))
    if COLONS.search(text):
        for m in IPV6.finditer(text):
            try:
                address = ipaddress.IPv6Address(m.group())
            except ValueError:
                continue
            if any(map(str.isdigit, m.group())) and int(address) > 1:
                found.append((*m.span(), "ipv6", address.compressed))
    for m in IBAN.finditer(text):
        written = m.group()
        while not iban_valid(compact := re.sub("[ -]", "", written)) and (cut := max(written.rfind(" "), written.rfind("-"))) > 0:
            written = written[:cut]  # a word that stands behind it
        if iban_valid(compact):
            found.append((m.start(), m.start() + len(written), "iban", compact))
    if "=" in text or ":" in text:
        found += [(*m.span(which), "secret", m.group(which)) for m in SECRET.finditer(text) for which in ("quoted", "bare") if m.group(which)]
    found += _names(text)
    out, end = [], 0
    for item in sorted(found, key=lambda f: (f[0], -f[1])):
        if item[0] >= end:
            out.append(item)
            end = item[1]
    return out


class _Draws:
    """Numbers below a bound from a keyed hash of an entity and an attempt."""

    def __init__(self, key: bytes, kind: str, identity: str, attempt: int):
        self.seed, self.pool, self.count = f"{kind}|{attempt}|{identity}".encode(), 0, 0
        self.key, self.left = key, 0

    def below(self, n: int) -> int:
        if self.left < 4:
            self.pool = int.from_bytes(hmac.new(self.key, b"%d|" % self.count + self.seed, hashlib.sha256).digest(), "big")
            self.count, self.left = self.count + 1, 16
        self.left -= 1
        self.pool, value = divmod(self.pool, 1 << 16)
        return value % n


def _like(text: str, draw) -> str:
    """Letters for letters (same case, hexadecimal for hexadecimal), digits for digits."""
    hexadecimal = all(c in "0123456789abcdefABCDEF" for c in text)
    out = []
    for c in text:
        if c.isdigit():
            out.append("0123456789"[draw(10)])
        elif c.isascii() and c.isalpha():
            d = ("abcdef"[draw(6)] if hexadecimal else "abcdefghijklmnopqrstuvwxyz"[draw(26)])
            out.append(d.upper() if c.isupper() else d)
        elif c.isalpha():
            d = SYLLABLES[script_of(c)][draw(16)][0]
            out.append(d.upper() if c.isupper() else d)
        else:
            out.append(c)
    return "".join(out)


def _letters(n: int, draw) -> str:
    """Letters that are hexadecimal digits too."""
    return "".join("abcdef"[draw(6)] for _ in range(n))


def surrogate(key: bytes, kind: str, identity: str, attempt: int) -> str:
    """The replacing identity of the same kind. It is a function of the key, the
    entity and the attempt, so equal entities agree wherever they occur. The
    surrogates to draw from grow with the attempt, so that a shape of which
    the corpus holds many or all still settles."""
    draw = _Draws(key, kind, identity, attempt).below
    if kind == "email":
        local, domain = identity.rsplit("@", 1)
        host, _, tail = domain.rpartition(".")
        return f"{_like(local, draw)}{_letters(attempt, draw)}@{_like(host, draw)}.{tail}"
    if kind == "ipv4":
        head, second = map(int, identity.split(".")[:2])
        if head not in (10, 127, 172, 192):
            first, second = 1 + draw(223), draw(256)
        elif attempt < 2:
            first, second = head, second if head in (172, 192) else draw(256)
        elif attempt < 8:  # all private ranges
            first, second = (10, draw(256)) if draw(16) else (172, 16 + draw(16))
        else:  # reserved, never assigned
            first, second = 240 + draw(15), draw(256)
        return ".".join(map(str, (first, second, draw(256), 1 + draw(254))))
    if kind == "ipv6":
        return ":".join(["2001", "db8", *(f"{1 + draw(0xFFFF):x}" for _ in range(6))])
    if kind == "iban":
        body = "".join("0123456789"[draw(10)] if c.isdigit() else "ABCDEFGHIJKLMNOPQRSTUVWXYZ"[draw(26)] for c in identity[4:])
        return next(made for n in range(2, 99) if iban_valid(made := f"{identity[:2]}{n:02d}{body}"))
    if kind == "card":
        body = identity[0] + "".join(str(draw(10)) for _ in identity[1:-1])
        return next(body + str(c) for c in range(10) if luhn(body + str(c)))
    if kind == "phone":
        keep = max(1, len(identity) - 10) if attempt < 4 else 1  # the country code stays
        more = min(max(0, attempt - 3), 15 - len(identity))
        return identity[:keep] + "".join(str(draw(10)) for _ in range(len(identity) - keep + more))
    if kind == "name":
        role, script, _ = identity.split("|", 2)
        if role == "initial":
            return f"{role}|{script}|{''.join(SYLLABLES[script][draw(16)][0] for _ in range(1 + attempt)).capitalize()}"
        if role in "fm" and not attempt:
            return f"{role}|{script}|{GIVEN[script, role][draw(len(GIVEN[script, role]))]}"
        made = "".join(SYLLABLES[script][draw(16)] for _ in range((4 if role == "family" else 2) + attempt)).capitalize()
        return f"{role}|{script}|{made}{ENDINGS[script] if role == 'family' else GIVEN_ENDINGS[script][role]}"
    return _like(identity, draw) + _letters(attempt, draw)


def spell(kind: str, identity: str, written: str) -> str:
    """A surrogate identity in the format of the replaced spelling."""
    if kind in ("phone", "card", "iban"):
        digits = iter(identity)
        return "".join([*(next(digits) if c.isalnum() else c for c in written), *digits])
    if kind == "name":
        made = identity.split("|", 2)[2]
        return made.upper() if len(written) > 1 and written.isupper() else made
    if kind == "ipv6" and any(c.isupper() for c in written):
        return identity.upper()
    if kind == "email" and written.isupper():
        return identity.upper()
    return identity
