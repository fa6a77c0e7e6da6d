"""Surrogates for personal data: keyed, type-consistent, distinct.

Every detected entity is mapped by a keyed permutation of the values of its own format: digits stay
digits, letters letters of their script, country codes, issuers and top-level domains stay, check
digits are made anew. A permutation maps two entities to two replacements, so distinctness needs no
redrawing, however full a format's space is, and it is one cycle, so nothing is mapped to itself.
The same entity has the same replacement in all documents; without the key nothing leads back. A
replacement may be another entity's original, as in any full space.

Persons are replaced name by name, so 'Mr John Smith', 'John Smith', 'SMITH, JOHN' and a bare 'Smith'
beside them stay one person. Known given names are permuted among those of their script and gender;
other names keep their pattern of vowels and consonants, and given names a final vowel.
"""

from __future__ import annotations

import hashlib
import math
import re
import secrets
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise

#: The setting that holds the key; without it each application draws its own.
KEY_SETTING = "spark.shopledger.pii.key"

# Titles, and given names by script and gender.
TITLES = ("Mrs", "Ms", "Miss", "Frau", "Mme", "Mlle", "Sra", "Señora", "Madame", "Mr", "Herr", "Sr", "Señor", "Monsieur", "Dr", "Prof", "Mx")
GIVEN = {
    ("latin", "f"): (
        "Aisha", "Alice", "Amina", "Ana", "Anna", "Camille", "Carmen", "Chloe", "Clara", "Elena", "Emily", "Emma", "Fatima", "Hannah", "Ingrid", "Isabel", "Jane", "Jessica",
        "Julia", "Karin", "Katarzyna", "Laura", "Lucia", "Maria", "Marie", "Mary", "Mei", "Nina", "Olivia", "Paula", "Priya", "Sarah", "Sofia", "Susan", "Teresa", "Ursula", "Yuki",
    ),
    ("latin", "m"): (
        "Ahmed", "Antonio", "Arjun", "Carlos", "Daniel", "David", "Diego", "Felix", "Francois", "Hans", "Hiroshi", "Hugo", "Ivan", "James", "Javier", "Jean", "John", "Jose", "Juan",
        "Jürgen", "Lucas", "Marco", "Martin", "Michael", "Mohammed", "Oluwaseun", "Oscar", "Paul", "Peter", "Pierre", "Rahul", "Robert", "Thomas", "Wei", "William", "Wolfgang",
    ),
    ("latin", "n"): ("Alex", "Charlie", "Jordan", "Kim", "Robin", "Sasha", "Taylor"),
    ("cyrillic", "f"): ("Анна", "Вера", "Ирина", "Мария", "Ольга", "Светлана"),
    ("cyrillic", "m"): ("Антон", "Борис", "Игорь", "Иван", "Павел", "Фёдор"),
    ("greek", "f"): ("Άννα", "Ελένη", "Μαρία", "Σοφία"),
    ("greek", "m"): ("Γιώργος", "Δημήτρης", "Νίκος", "Πέτρος"),
}
VOWELS = {"latin": "aeiou", "cyrillic": "аеёиоуыэюя", "greek": "αεηιουω"}
CONSONANTS = {"latin": "bcdfghjklmnpqrstvwxyz", "cyrillic": "бвгджзйклмнпрстфхцчшщ", "greek": "βγδζθκλμνξπρστφχψ"}
# Calling codes of one and two digits; all others have three.
CALLING_1 = ("1", "7")
CALLING_2 = (
    "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "53", "54", "55", "56", "57", "58", "60", "61", "62", "63",
    "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98",
)
#: Characters that are permuted as one number.
AT_ONCE = 64
# Words that are no part of a person's name beside others: articles and the like, bodies, places, roles.
NO_NAMES = frozenset(
    "the a an this that these those every each all some any no our my your his her their its one two many most few another such what which when where while if but and or so as at in on of for to from with by "
    "der die das ein eine dieser diese jeder alle kein unser mein im am le la les un une ce cette chaque tous notre el los las una este esta cada todos nuestro lo i we you he she it they "
    "government ministry minister council court parliament senate congress police army church company corporation committee commission agency department office bureau board party union club team staff people child children "
    "customer customers service services support sir madam friends colleagues members everyone "
    "river street road avenue lane park square university college school hospital airport station bridge island islands mountain mountains valley lake beach bay city county state states republic kingdom cathedral museum institute "
    "foundation inc ltd llc gmbh corp group bank award prize cup day week month year bible gospel hotel hall house center centre library california texas florida germany france spain england america africa europe asia "
    "software hardware engineer manager director developer analyst officer consultant architect designer administrator product project vice president data scientist research sales marketing account executive associate technical "
    "lead systems network security access excel word windows".split()
)
GREETINGS = frozenset("dear liebe lieber cher chère querido querida".split())
BEFORE_PLACES = frozenset("san santa santo são saint st sankt mount lake new port fort cape los las rio north south east west".split())
PARTICLES = ("von", "van", "der", "den", "de", "del", "della", "la", "le", "da", "dos", "di", "al", "bin", "ter", "zu")

_POOLS = {pool: tuple(sorted(n.casefold() for n in names)) for pool, names in GIVEN.items()}
_KNOWN = {n: pool for pool, names in _POOLS.items() for n in names}
_TITLE_WORDS = frozenset(TITLES)
#: Entities with digits or an at sign, the more particular first.
NUMERIC = re.compile(
    r"""(?P<email>(?<![\w.+%-])[\w.+%-]++@[\w-]+(?:\.[\w-]+)+)"""
    r"""|(?i:\b(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)\s*[=:]\s*["']?)(?P<secret>[\w+/-]{8,}={0,2})"""
    r"""|(?P<hex>(?<![0-9A-Za-z])(?=[A-Fa-f]*[0-9])[0-9A-Fa-f]{32,}+(?![0-9A-Za-z]))"""
    r"""|(?P<iban>(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?![0-9A-Za-z]))"""
    r"""|(?P<ip>(?<![\d.])(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?![\d]|\.\d))"""
    r"""|(?P<phone>(?<!\w)\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\w(])\(\d{3}\)[ ]?\d{3}[ .-]\d{4}(?!\d)|(?<![\d-])\d{3}[.-]\d{3}[.-]\d{4}(?!\d))"""
    r"""|(?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))"""
    r"""|(?P<card>(?<!\d)\d(?:[ -]?\d){12,18}(?!\d))"""
)
HINT = re.compile(r"[0-9@]")
_UPPER = r"[^\W\d_a-zß-öø-ÿа-яёα-ωά-ώ]"
#: A capitalised word, from where a word begins to where it ends: each is tried once, and nothing of it is given back.
_CAP = rf"(?<![^\W\d_])(?<![^\W\d_][-'’]){_UPPER}[^\W\d_]++(?:-[^\W\d_]++|['’]{_UPPER}[^\W\d_]++)*+"
#: Capitalised words in a row, particles between them.
CAPITALISED = re.compile(rf"{_CAP}(?:[ ](?:(?:{'|'.join(PARTICLES)})[ ]){{0,2}}{_CAP})*")
WORD = re.compile(rf"[^\W\d_]+(?:-[^\W\d_]+|['’]{_UPPER}[^\W\d_]+)*")
TITLE_BEFORE = re.compile(rf"(?:^|[^\w])(?:{'|'.join(TITLES)})\.?[ ]$")
#: What stands before or behind the full name of a person, and before a given name alone. The weak ones stand
#: before and behind bodies and places too; only both for one name make it a person's.
CUE_BEFORE = re.compile(
    r"(?:\b(?:name|author|signed|attn|contact|regards|sincerely|gezeichnet|auteur|autor|firmado)\s*[:,]\s*"
    rf"|\b(?:signed by|written by|{'|'.join(sorted(GREETINGS))})[ ]"
    r"|\b(?:my name is|i am called|ich heiße|mein name ist|je m'appelle|mon nom est|me llamo|mi nombre es|меня зовут|με λένε)[ ])$",
    re.IGNORECASE,
)
NAMED_BEFORE = re.compile(r"\b(?:my name is|i am called|ich heiße|mein name ist|je m'appelle|mon nom est|me llamo|mi nombre es|меня зовут|με λένε)[ ]$", re.IGNORECASE)
WEAK_BEFORE = re.compile(r"\b(?:(?:from|to|cc)\s*:\s*|(?:contact|wrote to|spoke with|met with|called|emailed)[ ])$", re.IGNORECASE)
ADDRESS_AFTER = re.compile(r"[ ]?<[\w.+%-]++@")
WEAK_AFTER = re.compile(r"[ ](?:wrote|said|says|called|emailed|replied|asked|told|signed|lives|was born|schrieb|sagte|rief|wohnt|a écrit|a dit|habite|escribió|dijo|vive|написал|написала|сказал|сказала)\b")
SURNAME_FIRST = re.compile(rf"({_CAP}), ({_CAP})")

Entity = tuple[int, int, str, str]


def luhn(digits: str) -> bool:
    sums = [int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))]
    return sum(sums) % 10 == 0


def iban_check(country: str, account: str) -> str:
    """The check digits of an account number."""
    number = int("".join(str(int(c, 36)) for c in (account + country + "00").lower()))
    return f"{98 - number % 97:02d}"


def _numeric(text: str) -> Iterator[Entity]:
    for m in NUMERIC.finditer(text):
        kind = m.lastgroup
        value = m[kind]
        norm = value.lower() if kind in ("email", "secret", "hex", "iban") else value
        if kind in ("phone", "card", "iban"):
            norm = re.sub(r"[ .()-]", "", norm)
        if kind == "secret" and not any(c.isdigit() for c in value):
            continue
        if kind == "card" and not luhn(norm) or kind == "iban" and iban_check(norm[:2], norm[4:]) != norm[2:4]:
            continue  # some number, but no card or account
        yield (*m.span(kind), "secret" if kind == "hex" else kind, norm)


def _plain(name: str) -> bool:
    return name.casefold() in NO_NAMES


def _full_name(m: re.Match, text: str) -> tuple[int, int, str, int] | None:
    """(start, end, form, cue) of a person in a row of capitalised words: 'gf' given and family name, 'f', 'g'.

    The cue is 0 where it is enough, 1 for a weak one before, 2 for one behind, 3 for both.
    """
    words = [w for w in WORD.finditer(m[0]) if not w[0].islower()]
    names = [w[0] for w in words]
    span = lambda i, j: (m.start() + words[i].start(), m.start() + words[j].end())
    # a second given name takes the family name behind it
    last = lambda i: i + 2 if i + 2 < len(names) and names[i + 1].casefold() in _KNOWN else i + 1
    ends = lambda j: j + 1 == len(names) or not _plain(names[j + 1])  # noqa: E731  "... Street" makes it a place
    before = text[max(0, m.start() - 24) : m.start()]
    titled = 0 if TITLE_BEFORE.search(before) else next((i + 1 for i, n in enumerate(names) if n in _TITLE_WORDS), None)
    if titled is not None and titled < len(names) and not _plain(names[titled]):
        junior = titled > 0 and names[titled - 1] == "Sr" or before.rstrip(" .").endswith("Sr")
        if len(names) - titled == 1:
            return (*span(titled, titled), "f", 0)
        if not junior or names[titled].casefold() in _KNOWN:
            return (*span(titled, last(titled)), "gf", 0)
    for i, n in enumerate(names[:-1]):
        if n.casefold() in _KNOWN and not any(map(_plain, names[i + 1 : last(i) + 1])) and ends(last(i)) and not (i and names[i - 1].casefold() in BEFORE_PLACES):
            return (*span(i, last(i)), "gf", 0)
    if len(names) == 1 and NAMED_BEFORE.search(before) and not _plain(names[0]):
        return (*span(0, 0), "g", 0)
    greeted = names[0].casefold() in GREETINGS
    if not 1 < len(names) - greeted < 4 or any(map(_plain, names)) or names[greeted].casefold() in BEFORE_PLACES:
        return None
    if greeted:
        return (*span(1, len(names) - 1), "gf", 0)
    if CUE_BEFORE.search(before) or ADDRESS_AFTER.match(text, m.end()):
        return (*span(0, len(names) - 1), "gf", 0)
    told, telling = bool(WEAK_BEFORE.search(before)), bool(WEAK_AFTER.match(text, m.end()))
    if telling:  # "Later Tunde Bakare said"
        return (*span(len(names) - 2, len(names) - 1), "gf", 3 if told and len(names) == 2 else 2)
    return (*span(0, 1), "gf", 1) if told else None


def name_parts(name: str, form: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, normal form) of the names in a person's mention; particles are left out."""
    words = [w for w in WORD.finditer(name) if not w[0].islower()]
    family = {"gf": len(words) - 1, "f": 0, "fg": 0, "g": -1}[form]
    return [(*w.span(), "family" if i == family else "given", w[0].casefold()) for i, w in enumerate(words)]


def _persons(text: str) -> Iterator[Entity]:
    """Full names and titled ones, then every other mention of a name that these hold.

    A name that only weak cues speak for needs one before it and one behind it, not by one mention alone,
    and its parts are not looked for elsewhere; nor are names that the text also writes as common words.
    """
    found: list[Entity] = []
    weak: dict[str, int] = {}
    doubted: list[tuple[int, int, str]] = []
    covered = bytearray(len(text))
    for m in SURNAME_FIRST.finditer(text):
        before = text[max(0, m.start() - 24) : m.start()]
        if m[2].casefold() in _KNOWN and not _plain(m[1]) and (m[0].isupper() or re.search(r"\bname:\s*$", before, re.IGNORECASE)):
            found.append((*m.span(), "person fg", m[0].casefold()))
            covered[m.start() : m.end()] = b"\x01" * (m.end() - m.start())
    for m in CAPITALISED.finditer(text):
        at = _full_name(m, text)
        if at and not (covered[at[0]] or covered[at[1] - 1]):
            name = text[at[0] : at[1]].casefold()
            if at[3]:
                weak[name] = weak.get(name, 0) | at[3]
                doubted.append((at[0], at[1], name))
            else:
                found.append((at[0], at[1], f"person {at[2]}", name))
    families, givens = set(), set()
    for s, e, kind, _ in found:
        for _, _, part, norm in name_parts(text[s:e], kind.split(" ")[1]):
            (families if part == "family" else givens).add(norm)
    found += [(s, e, "person gf", name) for s, e, name in doubted if weak[name] == 3]
    if not found:
        return
    for s, e, _, _ in found:
        covered[s:e] = b"\x01" * (e - s)
    yield from found
    common = {w[0] for w in WORD.finditer(text) if w[0].islower()} & (families | givens)
    for w in WORD.finditer(text):
        norm = w[0].casefold()
        if not w[0].islower() and norm not in common and not covered[w.start()] and (norm in families or norm in givens):
            yield (*w.span(), "person f" if norm in families else "person g", norm)


def entities(text: str | None) -> list[Entity]:
    """(start, end, kind, normal form) of what is found, in order and apart.

    Persons' kinds tell the order of their names. Cards need their check digit, accounts theirs.
    """
    if not text:
        return []
    found = sorted([*(_numeric(text) if HINT.search(text) else ()), *_persons(text)])
    out: list[Entity] = []
    for e in found:
        if not out or e[0] >= out[-1][1]:
            out.append(e)
    return out


def parts_of(text: str, entity: Entity) -> list[Entity]:
    """What is replaced of an entity: a person's names one by one, else the whole."""
    start, end, kind, norm = entity
    if not kind.startswith("person"):
        return [entity]
    return [(start + s, start + e, k, n) for s, e, k, n in name_parts(text[start:end], kind.split(" ")[1])]


# keyed permutations


def _mix(value: int, bits: int, key: bytes, tweak: bytes) -> int:
    data = len(key).to_bytes(4, "big") + key + len(tweak).to_bytes(4, "big") + tweak + value.to_bytes((bits + 7) // 8, "big")
    return int.from_bytes(hashlib.shake_256(data).digest((bits + 7) // 8), "big") & ((1 << bits) - 1)


def _shuffle(x: int, n: int, key: bytes, tweak: bytes, *, back: bool = False) -> int:
    """A keyed permutation of 0 .. n - 1 or its inverse: a Feistel network, walked until inside."""
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    while True:
        left, right = x >> half, x & mask
        for r in range(7, -1, -1) if back else range(8):
            if back:
                left, right = right ^ _mix(left, half, key, tweak + bytes([r])), left
            else:
                left, right = right, left ^ _mix(right, half, key, tweak + bytes([r]))
        x = left << half | right
        if x < n:
            return x


def permuted(x: int, n: int, key: bytes, tweak: str) -> int:
    """The next place on a keyed cycle through all of 0 .. n - 1: no place is its own next."""
    if n < 2:
        return x
    mark = tweak.encode("utf-8", "surrogatepass")
    return _shuffle((_shuffle(x, n, key, mark) + 1) % n, n, key, mark, back=True)


def script_of(c: str) -> str:
    return "cyrillic" if "Ѐ" <= c <= "ӿ" else "greek" if "Ͱ" <= c <= "Ͽ" else "latin"


@lru_cache(maxsize=4096)
def alphabet(c: str, *, names: bool = False, hexadecimal: bool = False) -> str:
    """The characters that a lower-case character may become: its own kind, or itself alone."""
    if c.isascii() and c.isdigit():
        return "0123456789"
    if not c.isalpha():
        return c
    if hexadecimal:
        return "abcdef"
    for script in VOWELS if names or not c.isascii() else ():
        for some in (VOWELS[script], CONSONANTS[script]):
            if c in some:
                return some
    if c.isascii():
        return "abcdefghijklmnopqrstuvwxyz"
    near = ord(c) & ~31  # letters of the same block of 32 that are written in one case like it
    some = "".join(x for x in map(chr, range(near, near + 32)) if x.isalpha() and x == x.casefold() and len(x.upper()) == 1)
    return some if c in some else c


def _patterned(norm: str, key: bytes, tweak: str, **how: bool) -> str:
    """The next of all strings of the same pattern; long ones by parts, each in the light of those before."""
    if len(norm) > AT_ONCE:
        parts, seen = [], hashlib.sha256()
        for at in range(0, len(norm), AT_ONCE):
            parts.append(_patterned(norm[at : at + AT_ONCE], key, f"{tweak} {len(norm)} {seen.hexdigest()}", **how))
            seen.update(norm[at : at + AT_ONCE].encode("utf-8", "surrogatepass"))
        return "".join(parts)
    alphabets = [alphabet(c, **how) for c in norm]
    x = 0
    for c, a in zip(norm, alphabets, strict=True):
        x = x * len(a) + a.index(c)
    x = permuted(x, math.prod(map(len, alphabets)), key, f"{tweak} {' '.join(a[0] for a in alphabets)}")
    out = []
    for a in reversed(alphabets):
        x, i = divmod(x, len(a))
        out.append(a[i])
    return "".join(reversed(out))


def _octets(norm: str, key: bytes) -> str:
    spans = [{1: (0, 10), 2: (0, 100), 3: (100, 156)}[len(o)] for o in norm.split(".")]
    x = 0
    for o, (low, n) in zip(norm.split("."), spans, strict=True):
        x = x * n + int(o) - low
    x = permuted(x, math.prod(n for _, n in spans), key, f"ip {[len(o) for o in norm.split('.')]}")
    out = []
    for o, (low, n) in zip(reversed(norm.split(".")), reversed(spans), strict=True):
        x, i = divmod(x, n)
        out.append(f"{i + low:0{len(o)}d}")
    return ".".join(reversed(out))


def _given(norm: str, key: bytes) -> str:
    pool = _KNOWN.get(norm)
    if pool:
        names = _POOLS[pool]
        return names[permuted(names.index(norm), len(names), key, f"given {pool}")]
    kept = norm[-1] if alphabet(norm[-1], names=True) in VOWELS.values() else ""
    body = norm[: len(norm) - len(kept)]
    new = _patterned(body, key, f"given {kept}", names=True)
    while new + kept in _KNOWN:  # on along the cycle, so still one to one
        new = _patterned(new, key, f"given {kept}", names=True)
    return new + kept


@lru_cache(maxsize=50_000)
def surrogate(kind: str, norm: str, key: bytes) -> str:
    """The normal form of the replacement; one to one within a kind."""
    if kind == "email":
        local, _, domain = norm.rpartition("@")
        labels = domain.split(".")
        kept = labels[-2:] if labels[-2] == "example" else labels[-1:]
        drawn = labels[: len(labels) - len(kept)]
        return _patterned(local, key, "local") + "@" + ".".join([*[_patterned(x, key, "label") for x in drawn], *kept])
    if kind == "ip":
        return _octets(norm, key)
    if kind == "phone":
        digits = norm.removeprefix("+")
        size = 0 if digits == norm else 1 if digits[:1] in CALLING_1 else 2 if digits[:2] in CALLING_2 else 3
        head = norm[: len(norm) - len(digits) + size]
        return head + _patterned(digits[size:], key, f"phone {head}")
    if kind == "card":
        new = norm[0] + _patterned(norm[1:-1], key, f"card {norm[0]}")
        return next(new + d for d in "0123456789" if luhn(new + d))
    if kind == "iban":
        account = _patterned(norm[4:], key, f"iban {norm[:2]}")
        return norm[:2] + iban_check(norm[:2], account) + account
    if kind == "given":
        return _given(norm, key)
    if kind == "family":
        return _patterned(norm, key, "family", names=True)
    return _patterned(norm, key, kind, hexadecimal=kind == "secret" and bool(re.fullmatch(r"[0-9a-f]+", norm)))


def dress(shape: str, kind: str, new: str) -> str:
    """``new`` in the separators and case of the text that it replaces."""
    if kind in ("phone", "card", "iban"):
        rest = iter(new)
        new = "".join(c if c in " .()-" else next(rest) for c in shape)
    if shape.isupper():
        return new.upper()
    if kind in ("given", "family"):
        return "-".join(x[:1].upper() + x[1:] for x in new.split("-"))
    if kind in ("email", "secret") and shape != shape.lower() and len(new) == len(shape):
        return "".join(n.upper() if s.isupper() else n for s, n in zip(shape, new, strict=True))
    return new


def rewrite(text: str | None, key: bytes) -> tuple[str | None, list[str]]:
    """(text with replacements, kinds found)."""
    found = entities(text)
    if not found:
        return text, []
    out, at = [], 0
    for start, end, kind, norm in (p for e in found for p in parts_of(text, e)):
        out += [text[at:start], dress(text[start:end], kind, surrogate(kind, norm, key))]
        at = end
    return "".join([*out, text[at:]]), [kind.split(" ")[0] for _, _, kind, _ in found]


def surrogate_key(spark: SparkSession) -> bytes:
    """The key of the setting ``KEY_SETTING``; where that is unset, one drawn for this application."""
    known = spark.conf.get(KEY_SETTING, None)
    if not known:
        known = secrets.token_hex(32)
        spark.conf.set(KEY_SETTING, known)
    return known.encode()


def replacements(docs: DataFrame, key: bytes) -> DataFrame:
    """(kind, norm, new) of each distinct entity in ``docs`` (text), persons name by name."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = sorted({p[2:] for t in batch.column(0).to_pylist() for e in entities(t) for p in parts_of(t, e)})
            columns = ([k for k, _ in rows], [n for _, n in rows], [surrogate(k, n, key) for k, n in rows])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["kind", "norm", "new"])

    return docs.select("text").filter(F.col("text").isNotNull()).mapInArrow(of, "kind string, norm string, new string").distinct()


def collisions(found: DataFrame) -> DataFrame:
    """(kind, new, n) of the replacements that more than one entity of ``replacements`` has, or that left one as it was."""
    return found.groupBy("kind", "new").agg(F.count("*").alias("n"), F.max(F.expr("norm = new").cast("int")).alias("same")).filter("n > 1 OR same = 1").select("kind", "new", "n")


def replace_pii(docs: DataFrame, key: bytes, *, counts: bool = True, check: bool = True) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced, and with n_entities and kinds if ``counts``.

    ``n_chars``, where ``docs`` has it, follows the text. A null or empty text stays; equal texts, and
    equal entities in different texts, get equal replacements; repeated rows stay repeated; a null
    doc_id changes nothing; an empty table stays empty; texts of any length are read whole. Columns
    named like the results are overwritten. ``check`` first looks for entities whose replacements
    meet and raises ValueError if there are any.
    """
    if not key:
        raise ValueError("a key is needed")
    if check:
        met = materialise(collisions(replacements(docs, key))).limit(1).count()
        if met:
            raise ValueError("two entities have one replacement")
    columns = docs.columns
    text_at = columns.index("text")
    extra = ["n_entities", "kinds"] if counts else []
    kept = [c for c in columns if c not in extra]

    def replaced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [rewrite(t, key) for t in batch.column(text_at).to_pylist()]
            made = {"text": pa.array([d[0] for d in done], pa.string())}
            if "n_chars" in columns:
                old = batch.column(columns.index("n_chars"))
                made["n_chars"] = pa.array([len(d[0]) if d[1] else o for d, o in zip(done, old.to_pylist(), strict=True)], old.type)
            made |= {"n_entities": pa.array([len(d[1]) for d in done], pa.int64()), "kinds": pa.array([",".join(sorted(set(d[1]))) for d in done], pa.string())}
            arrays = [made[c] if c in made else batch.column(columns.index(c)) for c in [*kept, *extra]]
            yield pa.RecordBatch.from_arrays(arrays, names=[*kept, *extra])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in kept] + ["n_entities long", "kinds string"][: len(extra)])
    return docs.select(*[F.col(f"`{c}`") for c in columns]).mapInArrow(replaced, schema)
