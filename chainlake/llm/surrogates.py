"""Surrogates for personal data: keyed replacements of the same type and format.

Each kind of entity is mapped by a keyed permutation of the values of its own format, without
fixed points: digits stay digits, a card keeps its check digit's standing, an address stays private or
public, a given name is replaced by one of the same gender and script, other names by letters of
their own class and script. One value has one surrogate wherever it occurs, so mentions still
corefer, and two values of a format never share one; a given or family name that stands alone follows
a full mention in the same text. `collisions` checks distinctness over the corpus, and
the key is stirred again if anything is found.
"""

from __future__ import annotations

import functools
import hashlib
import ipaddress
import re
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Given names by script and gender, and the titles that tell a gender or none.
GIVEN = {
    ("latin", "m"): "James John Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Peter Paul Hans Karl Jürgen Klaus Stefan Wolfgang Pierre Jean Jacques Michel Philippe José Juan Carlos Miguel Antonio Luis Pedro George Edward Henry Frank Andrew Mark Steven Kevin Brian Ahmed Mohammed Raj".split(),
    ("latin", "f"): "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Lisa Margaret Emily Anna Ursula Monika Petra Sabine Claudia Marie Françoise Isabelle Nathalie Sophie María Carmen Ana Isabel Dolores Pilar Lucía Jane Emma Olivia Alice Helen Laura Julia Priya Fatima Aisha Mei".split(),
    ("cyrillic", "m"): "Иван Сергей Алексей Дмитрий Николай Владимир Михаил Андрей".split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Татьяна Наталья Ирина Светлана".split(),
    ("greek", "m"): "Γιώργος Δημήτρης Κώστας Νίκος Γιάννης Παναγιώτης Βασίλης Χρήστος".split(),
    ("greek", "f"): "Μαρία Ελένη Κατερίνα Βασιλική Σοφία Αγγελική Γεωργία Δήμητρα".split(),
}
TITLES = {"m": "Mr Herr Señor Monsieur Sir".split(), "f": "Mrs Ms Miss Frau Señora Señorita Madame Mme".split(), "": "Dr Prof".split()}
#: Letters by script: vowels, then consonants (fixed values).
LETTERS = ("aeiou", "bcdfghjklmnpqrstvwxyz", "аеиоуыэюя", "бвгджзклмнпрстфхцчшщ", "αεηιουω", "βγδζθκλμνξπρστφχψ")
KINDS = ("email", "secret", "ip", "phone", "card", "iban", "ssn", "mac", "name")

_TITLE = "|".join(t for group in TITLES.values() for t in group)
_ALL = sorted({x for group in GIVEN.values() for n in group for x in (n, n.upper())}, key=lambda n: (-len(n), n))
_NAMES = "|".join(_ALL)
_FIRST = sorted({n[0] for n in _ALL})
#: The same by first letter, which most words don't begin with.
_BY_LETTER = f"(?=[{''.join(_FIRST)}])(?:" + "|".join(f"{c}(?:{'|'.join(n[1:] for n in _ALL if n[0] == c)})" for c in _FIRST) + ")"
#: What a name follows (fixed values).
_SAID = r"\b(?:[Mm]y name is|[Nn]ame:|[Ss]igned by|[Ss]incerely,|[Kk]ind regards,|[Cc]ontact:)"
#: Keys whose issuers give them a form (fixed values): a front that stays, then the key.
_ISSUED = (
    r"(?<![0-9A-Za-z_-])(?:(?:AKIA|ASIA)(?P<aws>[0-9A-Z]{16})(?![0-9A-Za-z])|gh[pousr]_(?P<git>[A-Za-z0-9]{20,255})|xox[abprs]-(?P<chat>[A-Za-z0-9-]{10,255})"
    r"|[srp]k[-_](?:live|test|proj)[-_](?P<pay>[A-Za-z0-9_-]{8,255})|eyJ(?P<jwt>[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}))"
    r"|(?<![^\W_])[Bb](?:earer|EARER)[ ]+(?P<bearer>(?=[A-Za-z.~+/_-]*\d)[\w.~+/-]{16,}=*)"
)
#: An assigned secret: within quotes all of the line up to the closing one, else up to a space, a quote, a tag or the next
#: assignment. Addresses are entities of their own; short values need a digit or a sign.
_BARE = r"""[^\s"'`]"""
_SIGNED = r"[\d@#$%^&*+=~]"
_VALUE = (
    r"""(?!["'`]?(?:[\w.%+-]{1,64}@[\w-]+\.[\w-]|(?:\d{1,3}\.){3}\d{1,3}(?![\w.])|\w+://))"""
    rf"""(?:"(?=[^"\n]{{8}}|[^"\n]{{0,6}}{_SIGNED})(?P<double>(?:\\.|[^"\\\n])+)(?=")|'(?=[^'\n]{{8}}|[^'\n]{{0,6}}{_SIGNED})(?P<single>(?:\\.|[^'\\\n])+)(?=')"""
    rf"""|["'`]?(?={_BARE}{{8}}|{_BARE}{{0,6}}{_SIGNED})(?P<value>(?:[^\s"'`,;&|<]++|(?![,;&|][\w-]+[=:]|</?[A-Za-z!])[,;&|<])+))"""
)
PATTERN = re.compile(
    r"(?P<email>(?<![\w.%+-])[\w.%+-]{1,64}@[\w-]{1,63}(?:\.[\w-]{1,63}){1,126}(?<![-_.]))"
    r"|" + _ISSUED + r"|(?P<ssn>(?<![\w-])(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}(?![\w-]))"
    r"|(?P<mac>(?<![\w:-])[0-9A-Fa-f]{2}(?P<sep>[:-])(?:[0-9A-Fa-f]{2}(?P=sep)){4}[0-9A-Fa-f]{2}(?![\w:-]))"
    r"|(?P<assigned>(?i:(?<![^\W_])(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)\b\W{0,3}[=:]\s{0,3}))" + _VALUE +
    r"|(?P<hex>(?<![0-9A-Za-z])(?:[0-9a-f]{32,}|[0-9A-F]{32,})(?![0-9A-Za-z]))"
    r"|(?P<ip>(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\w]|\.\d))"
    r"|(?P<ip6>(?<![\w:.])(?=[0-9A-Fa-f:]{0,38}\d)(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\w:]|\.\d))"
    r"|(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))"
    r"|(?P<phone>(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\w))"
    r"|(?P<abroad>(?<![\w+.,/-])(?:\+[1-9]|00[1-9]\d{0,2}[ ./-](?=\(?\d)\(?\d)(?:(?:[ ]?\(|\)[ ./-]?|[ ]?/[ ]?|[ .-])?\d){7,15}(?!\w))"
    r"|(?P<trunk>(?<![\w+.,/-])(?!\d\d[./-]\d\d[./-]\d{4})(?=\(?\d(?:\)?[ ./-]?\d){8,10}(?![ ./-]?\w))(?:\(0[1-9]\d{0,3}\)[ ./-]?|0[1-9]\d{0,3}[ ./-])\d{2,8}(?:[ ./-]\d{2,8}){0,4}(?![ ./-]?\d))"
    r"|(?P<card>(?<![\w-])\d(?:[ -]?\d){12,18}(?![\w]|-\d))"
    rf"|(?:\b(?P<title>{_TITLE})\b\.?[ ])(?P<titled>[^\W\d_][\w'’-]+(?:[ ][^\W\d_a-zà-ÿа-яα-ω][\w'’-]+)?)"
    rf"|(?:{_SAID}\s+)(?P<said>[^\W\d_a-zà-ÿа-яα-ω][\w'’-]+(?:[ ][^\W\d_a-zà-ÿа-яα-ω][\w'’-]+)?)"
    rf"|(?P<given>\b{_BY_LETTER})(?P<family>[ ][^\W\d_a-zà-ÿа-яα-ω][\w'’-]+)"
)



def _without_rare(pattern: str) -> re.Pattern[str]:
    """The pattern without issued keys, numbers with dashes, addresses of devices, and names by what they follow: most texts hold none."""
    pattern = pattern.replace("|" + _ISSUED, "", 1)
    for begin, end in (("|(?P<ssn>", "|(?P<assigned>"), (f"|(?:{_SAID}", "|(?P<given>")):
        pattern = pattern[: pattern.index(begin)] + pattern[pattern.index(end) :]
    return re.compile(pattern)


PLAIN = _without_rare(PATTERN.pattern)
#: One of these stands in every text that needs the whole pattern.
_MARKS = "AKIA|ASIA|eyJ|ghp_|gho_|ghu_|ghs_|ghr_|xox|k-live|k_live|k-test|k_test|k-proj|k_proj|earer |EARER |y name is|ame:|igned by|incerely,|ind regards,|ontact:".split("|")
_DASHED = re.compile(r"\d\d\d-\d\d-\d{4}|[0-9A-Fa-f]{2}(?P<sep>[:-])(?:[0-9A-Fa-f]{2}(?P=sep)){4}")


def _rare(text: str) -> bool:
    return any(m in text for m in _MARKS) or ((text.count("-") > 1 or text.count(":") > 4) and _DASHED.search(text) is not None)


#: Texts without any of these hold no entity. Word bounds are left out, as they differ between the two engines.
HINT = r"@|\p{Nd}|[a-f]{32}|[A-F]{32}|(?i:token|secret|passw|key|bearer|my name is|name:|signed by|sincerely,|kind regards,|contact:)|AKIA|ASIA|eyJ|gh[pousr]_|xox|[srp]k[-_]|(?:[A-Fa-f]{2}[:-]){5}|" + _TITLE + "|" + _NAMES


#: Characters that are permuted together.
BLOCK = 512


@functools.lru_cache(maxsize=4096)
def _alike(c: str, classes: tuple[str, ...]) -> str:
    """Letters or digits near `c` and of its category, none of which is in a class: the class of those outside all."""
    kind = unicodedata.category(c)
    near = [chr(x) for x in range(ord(c) & ~63, (ord(c) & ~63) + 64)] if kind in ("Ll", "Lo", "Nd") else []
    return "".join(d for d in near if unicodedata.category(d) == kind and len(d.upper()) == 1 and d.upper().lower() == d and not any(d in chars for chars in classes))


class Permuter:
    """Keyed permutations of 0 .. n-1, none of which leaves anything in place (n > 1)."""

    def __init__(self, key: bytes):
        self.key = key

    def _round(self, tweak: bytes, i: int, x: int, bits: int) -> int:
        size = (bits + 7) // 8
        out, block = b"", 0
        while len(out) < size:
            out += hashlib.blake2b(x.to_bytes(size, "big") + bytes([i, block]) + tweak, key=self.key, digest_size=min(64, size)).digest()
            block += 1
        return int.from_bytes(out[:size], "big") & ((1 << bits) - 1)

    def _feistel(self, x: int, n: int, tweak: bytes, back: bool) -> int:
        bits = max(1, ((n - 1).bit_length() + 1) // 2)
        mask = (1 << bits) - 1
        while True:
            left, right = x >> bits, x & mask
            for i in reversed(range(8)) if back else range(8):
                if back:
                    left, right = right ^ self._round(tweak, i, left, bits), left
                else:
                    left, right = right, left ^ self._round(tweak, i, right, bits)
            x = left << bits | right
            if x < n:
                return x

    def move(self, x: int, n: int, tweak: str) -> int:
        if n < 2:
            return x
        t = f"{n} {tweak}".encode()
        step = 1 + self._round(t, 99, 0, 64) % (n - 1)
        return self._feistel((self._feistel(x, n, t, False) + step) % n, n, t, True)

    def text(self, value: str, classes: tuple[str, ...], tweak: str, others: bool = True) -> str:
        """Every character that is in a class replaced by one of its class and case, all together.

        With `others`, letters and digits of other scripts are replaced by those near them. Long values go by
        blocks, each under a tweak of all before it, so that values stay one to one.
        """
        if len(value) > BLOCK:
            out, before = [], hashlib.blake2b(key=self.key, digest_size=16)
            for i in range(0, len(value), BLOCK):
                part = value[i : i + BLOCK]
                out.append(self.text(part, classes, f"{tweak} {before.hexdigest()}", others))
                before.update(part.lower().encode("utf-8", "surrogatepass"))
            return "".join(out)
        size = {c: len(chars) for chars in classes for c in chars}
        places = []
        for c in value:
            low = c.lower()
            chars = next((chars for chars in classes if low in chars), "") if low in size else _alike(low, classes) if others and len(low) == 1 else ""
            places.append((chars, chars.index(low), c != low) if low in chars and chars else None)
        n, x = 1, 0
        for p in places:
            if p:
                x, n = x * len(p[0]) + p[1], n * len(p[0])
        shape = "".join("." if p else c for p, c in zip(places, value, strict=True))
        x, out = self.move(x, n, f"{tweak} {shape}"), []
        for c, p in zip(reversed(value), reversed(places), strict=True):
            if p:
                x, at = divmod(x, len(p[0]))
                c = p[0][at].upper() if p[2] else p[0][at]
            out.append(c)
        return "".join(reversed(out))


_DIGITS = ("0123456789",)
_WORDS = ("0123456789", "abcdefghijklmnopqrstuvwxyz")
_HEX = ("0123456789abcdef",)


def luhn(digits: str) -> int:
    """The check sum's last digit: 0 for a valid number."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10


def _email(p: Permuter, value: str) -> str:
    local, _, host = value.rpartition("@")
    labels = host.split(".")
    keep = 2 if len(labels) > 1 and labels[-2].lower() == "example" else 1
    front = ".".join(labels[:-keep])
    return p.text(local, _WORDS, f"local@{host.lower()}") + "@" + ".".join(x for x in (p.text(front, _WORDS, "host") if front else "", *labels[-keep:]) if x)


def _secret(p: Permuter, value: str) -> str:
    return p.text(value, _HEX if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", value) else _WORDS, "secret")


def _ssn(p: Permuter, value: str) -> str:
    """Another number that could have been given out."""
    out = p.text(value, _DIGITS, "ssn")
    while re.match(r"000|666|9|...-00|.*-0000", out):
        out = p.text(out, _DIGITS, "ssn")
    return out


def _mac(p: Permuter, value: str) -> str:
    return p.text(value, _HEX, "mac")


def _private(x: int) -> int:
    a, b = x >> 24, x >> 16 & 255
    return 1 if a == 10 else 2 if a == 127 else 3 if a == 172 and 16 <= b < 32 else 4 if (a, b) == (192, 168) else 0


def _ip6(value: str) -> int | None:
    try:
        return int(ipaddress.IPv6Address(value))
    except ValueError:
        return None


def _ip(p: Permuter, value: str) -> str:
    """Of the newer kind, the first group (its scope) stays; all eight are written out."""
    if ":" in value:
        x = _ip6(value)
        y = x >> 112 << 112 | p.move(x & ((1 << 112) - 1), 1 << 112, f"ip {x >> 112}")
        out = ":".join(f"{y >> 16 * i & 0xFFFF:x}" for i in reversed(range(8)))
        return out.upper() if value.upper() == value and any(c.isalpha() for c in value) else out
    x = int.from_bytes(bytes(map(int, value.split("."))), "big")
    ranges = {1: (10 << 24, 24), 2: (127 << 24, 24), 3: (172 << 24 | 16 << 16, 20), 4: (192 << 24 | 168 << 16, 16)}
    kind = _private(x)
    if kind:
        base, bits = ranges[kind]
        y = base + p.move(x - base, 1 << bits, "ip")
    else:
        y = p.move(x, 1 << 32, "ip")
        while _private(y):
            y = p.move(y, 1 << 32, "ip")
    return ".".join(map(str, y.to_bytes(4, "big")))


def _phone(p: Permuter, value: str) -> str:
    """The country's code and the exchange 555, which no one has, stay."""
    head = re.match(r"(?:\+|00(?=[1-9]))\d{1,3}[ .-]?|\(?0(?=[1-9])", value)
    code, rest = (head[0], value[head.end() :]) if head else ("", value)
    digits = [i for i, c in enumerate(rest) if c.isdigit()]
    fictional = "".join(rest[i] for i in digits[3:6]) == "555"
    if fictional:
        held = set(digits[3:6])
        moved = iter(p.text("".join(rest[i] for i in digits if i not in held), _DIGITS, f"phone {code}"))
        return code + "".join(next(moved) if i in digits and i not in held else c for i, c in enumerate(rest))
    out = p.text(rest, _DIGITS, f"phone {code}")
    while "".join(out[i] for i in digits[3:6]) == "555":
        out = p.text(out, _DIGITS, f"phone {code}")
    return code + out


def _card(p: Permuter, value: str) -> str:
    """First digit, spacing and the check sum's value stay."""
    digits = "".join(c for c in value if c.isdigit())
    standing = luhn(digits)
    body = digits[0] + p.text(digits[1:-1], _DIGITS, f"card {digits[0]} {standing}")
    zero = ord(digits[-1]) - int(digits[-1])
    body += next(d for d in map(chr, range(zero, zero + 10)) if luhn(body + d) == standing)
    out = iter(body)
    return "".join(next(out) if c.isdigit() else c for c in value)


def _iban_rest(value: str) -> int:
    """The remainder by 97: 1 for a valid number."""
    return int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97


def _iban(p: Permuter, value: str) -> str:
    """The country and the spacing stay; the check digits follow from the rest."""
    plain = value.replace(" ", "")
    body = p.text(plain[4:], _WORDS, f"iban {plain[:2]}", False)
    check = 98 - _iban_rest(plain[:2] + "00" + body)
    out = iter(f"{plain[:2]}{check:02d}{body}")
    return "".join(c if c == " " else next(out) for c in value)


_WHO = {name.lower(): (group, i) for group, names in GIVEN.items() for i, name in enumerate(names)}


def _name(p: Permuter, value: str) -> str:
    out = []
    for part in value.split(" "):
        if found := _WHO.get(part.lower()):
            group, i = found
            new = GIVEN[group][p.move(i, len(GIVEN[group]), "given " + " ".join(group))]
            out.append(new.upper() if part.isupper() else new.lower() if part.islower() else new)
        else:
            new = p.text(part, LETTERS, "name")
            while new.lower() in _WHO:  # a family name doesn't turn into a given name
                new = p.text(new, LETTERS, "name")
            out.append(new)
    return " ".join(out)


MAKERS: dict[str, Callable[[Permuter, str], str]] = {"email": _email, "secret": _secret, "ip": _ip, "phone": _phone, "card": _card, "iban": _iban, "ssn": _ssn, "mac": _mac, "name": _name}


def _is_card(value: str) -> bool:
    """13 to 19 digits whose check sum is right; other long numbers are nobody's card."""
    return luhn("".join(c for c in value if c.isdigit())) == 0


def _whole_name(text: str, start: int, end: int) -> tuple[int, int]:
    """The span without a possessive ending or a mark at its end."""
    name = text[start:end]
    name = re.sub(r"['’]s$", "", name).rstrip("'’-")
    return start, start + len(name)


def _spans(text: str) -> Iterator[tuple[str, int, int]]:
    at, pattern = 0, PATTERN if _rare(text) else PLAIN
    while m := pattern.search(text, at):
        kind, at = m.lastgroup, m.end()
        if kind in ("double", "single", "value"):
            start, value = m.start(kind), m[kind] if kind != "value" else m[kind].rstrip(".,;:!?)]}>")
            if any(c.isalnum() for c in value) and (len(value) >= 8 or re.search(_SIGNED, value)):
                yield "secret", start, start + len(value)
        elif kind == "hex":
            yield "secret", *m.span()
        elif kind in ("aws", "git", "chat", "pay", "jwt", "bearer"):
            yield "secret", m.start(kind), m.start(kind) + len(m[kind].rstrip(".,-"))
        elif kind in ("titled", "said"):
            yield "name", *_whole_name(text, *m.span(kind))
        elif kind == "family":
            yield "name", *_whole_name(text, *m.span())
        elif kind in ("abroad", "trunk"):
            yield "phone", *m.span()
        elif kind == "ip6":
            if _ip6(m[0]) is not None and m[0].count(":") > 2:
                yield "ip", *m.span()
        elif kind == "iban":
            plain = m[0].replace(" ", "")
            if len(plain) <= 34 and _iban_rest(plain) == 1:
                yield kind, *m.span()
            else:
                at = m.start() + 4  # what follows may be something else
        elif kind != "card" or _is_card(m[0]):
            yield kind, *m.span()


_NAME_WORD = re.compile(r"[^\W\d_][\w'’-]+")


def entities(text: str) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of the entities of a text, from left to right, not overlapping.

    Beside what the pattern finds: the parts of each name found, wherever they stand alone.
    """
    found = list(_spans(text))
    parts = {part for kind, a, b in found if kind == "name" for part in text[a:b].split(" ")}
    alone, k = [], 0
    for m in _NAME_WORD.finditer(text) if parts else ():
        a, b = _whole_name(text, *m.span())
        if text[a:b] not in parts:
            continue
        while k < len(found) and found[k][2] <= a:
            k += 1
        if k == len(found) or b <= found[k][1]:
            alone.append(("name", a, b))
    yield from sorted(found + alone, key=lambda e: e[1]) if alone else found


def _canonical(kind: str, value: str) -> str:
    if kind == "ip":
        return str(ipaddress.IPv6Address(value)) if ":" in value else ".".join(str(int(x)) for x in value.split("."))
    if kind == "iban":
        return value.replace(" ", "")
    return value.lower() if kind in ("email", "mac") else value


def _found(batches: Iterator[pa.RecordBatch], key: bytes) -> Iterator[pa.RecordBatch]:
    permuter = Permuter(key)
    for batch in batches:
        seen = set()
        for text in batch.column(0).filter(pc.match_substring_regex(batch.column(0), HINT)):
            t = text.as_py()
            seen.update((kind, t[a:b]) for kind, a, b in entities(t))
        rows = sorted((k, v) for k, v in seen if MAKERS[k](permuter, v) != v)  # equal: no character to change
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.string()), pa.array([_canonical(k, v) for k, v in rows], pa.string()), pa.array([_canonical(k, MAKERS[k](permuter, v)) for k, v in rows], pa.string())], ["kind", "value", "surrogate"])


def surrogate_table(docs: DataFrame, key: bytes, column: str = "text") -> DataFrame:
    """(kind, value, surrogate), a row for each distinct entity of all texts that has a character to change."""
    return docs.select(column).mapInArrow(lambda batches: _found(batches, key), "kind string, value string, surrogate string").distinct()


def collisions(table: DataFrame) -> DataFrame:
    """(kind, surrogate, n) of surrogates that stand for several values, or for themselves."""
    return table.groupBy("kind", "surrogate").agg(F.count_distinct("value").alias("n"), F.max((F.col("value") == F.col("surrogate")).cast("int")).alias("kept")).where("n > 1 or kept = 1").select("kind", "surrogate", "n")


def pseudonymise(docs: DataFrame, key: bytes, id_column: str = "doc_id", column: str = "text", tries: int = 3) -> DataFrame:
    """`docs` with every entity of `column` replaced, and n_<kind> for each of KINDS (counts of mentions).

    All other columns stay as they are; a column that is named like a count is replaced by it. A
    null text stays null with counts 0; an empty one stays empty. Equal values get equal
    surrogates in every row, repeated rows and rows without id included. The corpus is scanned once for collisions before the replacement;
    any makes a new key from the old one. Values that have no character to change stay.
    """
    for attempt in range(tries):
        stirred = hashlib.blake2b(key, digest_size=32, salt=attempt.to_bytes(2, "big")).digest()
        if not collisions(surrogate_table(docs, stirred, column)).limit(1).count():
            break
    else:
        raise ValueError("no key without collisions found")

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        permuter = Permuter(stirred)
        for batch in batches:
            at = batch.schema.get_field_index(column)
            texts = batch.column(at)
            hinted = pc.fill_null(pc.match_substring_regex(texts, HINT), False)
            out, counts = [], {k: [0] * len(texts) for k in KINDS}
            for i, (text, look) in enumerate(zip(texts, hinted, strict=True)):
                t = text.as_py()
                if look.as_py():
                    parts, last = [], 0
                    for kind, a, b in entities(t):
                        parts += [t[last:a], MAKERS[kind](permuter, t[a:b])]
                        last = b
                        counts[kind][i] += 1
                    t = "".join(parts) + t[last:] if parts else t
                out.append(t)
            columns = list(batch.columns)
            columns[at] = pa.array(out, texts.type)
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array(counts[k], pa.int64()) for k in KINDS]], [*batch.schema.names, *[f"n_{k}" for k in KINDS]])

    plain = docs.drop(*[f"n_{k}" for k in KINDS])
    schema = T.StructType([*plain.schema.fields, *[T.StructField(f"n_{k}", T.LongType()) for k in KINDS]])
    return plain.mapInArrow(replace, schema)
