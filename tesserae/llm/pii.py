"""PII surrogates: keyed, type-consistent, distinct, the same for each mention.

Found are e-mail addresses, phone, card and social security numbers, IPv4
addresses, IBANs, access keys and assigned secrets, and names after a title
(initials too).  A secret runs to its closing quote or the next white space.
An entity is a kind and a canonical value (digits of a number, lower case of an
address or name), so the mentions of one entity share it whatever their format.
A card number is one that an issuer may give (first digit 2 to 6), and it and an IBAN
have the right check digits; an unquoted secret after a colon holds a digit or both cases.

A surrogate comes from a keyed Feistel permutation of the value's own format:
digits to digits, letters to letters of the same script and case (vowels to
vowels in names; in scripts without a list here to letters of one kind among the
64 code points around), with check digits made right again, the digits that tell a
card's issuer kept, social security numbers such as are given out, and given names
exchanged within the list of their gender.  A name that was found after a title is replaced
wherever the document has it in capitals, and a phone number also as plain digits.  Permutations keep different values different.
What they can't see is whether a surrogate is another entity's real value; so
the distinct entities of all documents are joined with their surrogates, and
whoever meets a real value or another surrogate tries the next permutation until
nobody does.  Only documents with such an entity are joined with the exceptions.
Listed given names are shared by many people, so one may stand for another
although somebody bears it: they are only permuted within their list, in which
each keeps its gender and different ones stay different, and no other name's
surrogate is a listed one.  The key is an argument without a default: whoever
knows it can undo the permutations.

Edge cases: a null text stays null; whole texts are searched, with work in
proportion to their length; equal texts get equal results; other columns pass
through untouched (``__odd`` and ``__md5`` are refused); repeated rows stay; an
empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import cut, slices

ROUNDS = 8
#: From this attempt on a surrogate has two symbols more, for formats that are used up.
WIDER = 16
#: Longer secrets are permuted in blocks of so many characters.
BLOCK = 256

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_NUMBER = re.compile(
    rf"(?<![\w.])(?P<ip>(?:{_OCTET}\.){{3}}{_OCTET})(?!\.?\w)"
    r"|(?<![\w-])(?P<ssn>\d{3}-\d{2}-\d{4})(?![\w-])"
    r"|(?<![\w.+-])(?P<phone>(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\) ?|\d{2,4}[ .-])\d{3,4}[ .-]\d{3,4}|\+\d{8,15}"
    r"|(?=\+(?:[ ./()-]{0,2}\d){8})\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?(?:\d{1,4}(?:[ .-]\d{2,4}){2,5}|(?:\d{1,5}[ ./-])?\d{4,10})"  # groups of two, a long last group
    r"|0\d(?:[ .-]\d{2}){4}|0\d{1,4}[ /-]\d{5,9})(?![\w-])"
    r"|(?<![\w.-])(?P<card>\d{4}(?:[ -]?\d{4}){3}(?:\d{1,3})?|3\d{3}[ -]?\d{6}[ -]?\d{4,5}|\d{13,19})(?![\w-])"
)
_IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
_ACCESS = re.compile(r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])")
_SECRET = re.compile(r"(?i)(?<![a-z])(?:password|passwd|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key)[\"']?[ \t]{0,4}[:=][ \t]{0,4}(?:\"((?:[^\"\\\n]|\\.){6,}+)\"|'((?:[^'\\\n]|\\.){6,}+)'|(?=[^\s\"']\S{5})(?=\S*[^\W_])(\S*[^\s.,;:!?)\]}>\"']))")
_LOCAL = re.compile(r"[A-Za-z0-9_%+\-](?:[A-Za-z0-9._%+\-]{0,62}[A-Za-z0-9_%+\-])?\Z")
_DOMAIN = re.compile(r"(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9-])")
_DIGIT = re.compile(r"\d")
_RUN_OF_DIGITS = re.compile(r"(?<![\w.-])\d{7,15}(?![\w-])")

#: Titles that a name follows.  Fixed values.
TITLES = (
    "Mr", "Mrs", "Ms", "Miss", "Mx", "Sir", "Madam", "Dr", "Prof", "Herr", "Herrn", "Frau", "Monsieur", "Madame", "Mme", "Mlle",
    "Señor", "Señora", "Sr", "Sra", "Don", "Doña", "Господин", "Госпожа", "Κύριος", "Κυρία",
)
#: Given names that are exchanged for each other, by script and gender.  Fixed values.
GIVEN = {
    ("latin", "f"): "anna maria sofia laura julia emma elena clara lucia marta ines nora alice sarah eva lena carmen louise camille petra".split(),
    ("latin", "m"): "john peter paul james michael thomas martin lukas jonas carlos pablo diego hugo louis pierre jean hans karl david daniel".split(),
    ("cyrillic", "f"): "анна мария елена ольга наталья ирина светлана татьяна".split(),
    ("cyrillic", "m"): "иван пётр алексей сергей дмитрий николай андрей михаил".split(),
    ("greek", "f"): "μαρία ελένη κατερίνα σοφία".split(),
    ("greek", "m"): "γιώργος νίκος κώστας δημήτρης".split(),
}
_GENDER = {n: k for k, names in GIVEN.items() for n in names}
_LETTER = r"[^\W\d_]"
_TITLE = re.compile(rf"(?<!\w)(?:{'|'.join(sorted(TITLES, key=len, reverse=True))})\.? (?={_LETTER})")
_PART = rf"(?:(?:{_LETTER}\.-?){{1,4}}|{_LETTER}['’]{_LETTER}{{2,30}}|{_LETTER}{{2,30}}(?:['’]{_LETTER}{{2,30}})?(?!\w)|{_LETTER}(?= {_LETTER}))"  # initials, O'Brien, a word
_NAME = re.compile(rf"{_PART}(?:[ -]{_PART}){{0,4}}(?!\w)")
_LETTERS = re.compile(rf"{_LETTER}+")

_VOWELS, _CONSONANTS = "aeiou", "bcdfghjklmnpqrstvwxyz"
_ACCENTED = "àáâãäåèéêëìíîïòóôõöùúûüýñç"
_CYR_VOWELS, _CYR_REST = "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщъь"
_GREEK_VOWELS, _GREEK_REST = "αεηιουωάέήίόύώ", "βγδζθκλμνξπρστφχψς"
_NAME_SETS = [_VOWELS, _CONSONANTS, _ACCENTED, _CYR_VOWELS, _CYR_REST, _GREEK_VOWELS, _GREEK_REST]
_PLAIN_SETS = ["0123456789", _VOWELS + _CONSONANTS, _ACCENTED, _CYR_VOWELS + _CYR_REST, _GREEK_VOWELS + _GREEK_REST]


def _classes(sets: list[str]) -> dict[str, tuple[str, int]]:
    both = [*sets, *[s.upper() for s in sets if not s.isdigit() and len(s.upper()) == len(s)]]
    return {c: (s, i) for s in both for i, c in enumerate(s)}


_PLAIN, _NAMES, _HEX = _classes(_PLAIN_SETS), _classes(_NAME_SETS), {c: ("0123456789abcdef", i) for i, c in enumerate("0123456789abcdef")}


@lru_cache(maxsize=65_536)
def _block(c: str) -> tuple[str, int] | None:
    """The class of a letter or digit that no list holds: its like among the 64 code points around it, else among 1024; None for others."""
    if not c.isalnum() or c in _PLAIN:
        return None
    kind = unicodedata.category(c)
    for wide in (64, 1024):
        first = ord(c) // wide * wide
        like = "".join(x for x in map(chr, range(first, first + wide)) if x not in _PLAIN and x.isalnum() and unicodedata.category(x) == kind)
        if len(like) > 1:
            return like, like.index(c)
    return None


def permute(value: str, tag: str, key: bytes, classes: dict | None = None) -> str:
    """A keyed bijection of the strings of ``value``'s format; symbols of no class stay."""
    found = [_PLAIN.get(c) or _block(c) for c in value] if classes is None else list(map(classes.get, value))
    at = [i for i, s in enumerate(found) if s]
    if not at:
        return value
    sets = [found[i] for i in at]
    shape = "".join(f"{len(s[0])}," if s else c for c, s in zip(value, found, strict=True))
    half = len(at) // 2

    def number(some):
        x, size = 0, 1
        for s, i in some:
            x, size = x * len(s) + i, size * len(s)
        return x, size

    (left, a), (right, b) = number(sets[:half]), number(sets[half:])
    for r in range(ROUNDS):
        source, size = (right, a) if r % 2 else (left, b)
        drawn = hashlib.blake2b(f"{tag}|{shape}|{r}|{source}".encode(), key=key[:64]).digest()
        wide = int.from_bytes(drawn, "big")
        while size.bit_length() > 448 and wide.bit_length() < size.bit_length() + 64:  # a long secret
            drawn = hashlib.blake2b(drawn, key=key[:64]).digest()
            wide = wide << 512 | int.from_bytes(drawn, "big")
        if r % 2:
            left = (left + wide) % a
        else:
            right = (right + wide) % b
    out = list(value)
    for part, x in ((range(half), left), (range(half, len(at)), right)):
        for k in reversed(part):
            s = sets[k][0]
            x, i = divmod(x, len(s))
            out[at[k]] = s[i]
    return "".join(out)


def _luhn(digits: str) -> int:
    """What the last digit has to be after ``digits``."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (2 if i % 2 == 0 else 1)
        total += x - 9 if x > 9 else x
    return -total % 10


def _walk(value: str, step, shape) -> str:
    """``step`` again and again until the result has the shape that ``value`` has: a permutation of the values of each shape."""
    x = step(value)
    while shape(x) != shape(value):
        x = step(x)
    return x


def _issued(number: str) -> bool:
    """Whether a social security number can have been given out."""
    return number[:3] not in ("000", "666") and number[0] != "9" and number[3:5] != "00" and number[5:] != "0000"


def _reach(address: str) -> int:
    """Public addresses, private ones and others, told apart; ``address`` as 8 hex digits."""
    a, b = int(address[:2], 16), int(address[2:4], 16)
    private = a == 10 or a == 172 and 16 <= b < 32 or a == 192 and b == 168
    return 0 if private else 1 if 1 <= a < 224 and a != 127 else 2


@lru_cache(maxsize=65_536)
def surrogate(kind: str, value: str, attempt: int = 0, *, key: bytes) -> str:
    """The surrogate of a canonical value."""
    tag = f"{kind}|{attempt}"
    wider = attempt >= WIDER
    if kind == "card":
        head = value[: 2 if value[0] == "3" else 1]  # what tells the issuer stays
        body = head + permute(value[len(head) : -1], tag + head, key)
        return f"{body}{_luhn(body)}"
    if kind == "ssn" and not wider:
        return _walk(value, lambda x: permute(x, tag, key), _issued)
    if kind == "ip":
        address = bytes(map(int, value.split("."))).hex()
        return ".".join(map(str, bytes.fromhex(_walk(address, lambda x: permute(x, tag, key, _HEX), _reach))))
    if kind == "iban":
        body = permute(value[4:], tag + value[:2], key)
        check = 98 - int("".join(str(int(c, 36)) for c in body + value[:2] + "00")) % 97
        return f"{value[:2]}{check:02d}{body}"
    if kind == "email":
        local, _, domain = value.partition("@")
        reserved = re.search(r"(?:^|\.)example\.(?:com|org|net)$", domain)
        front = domain[: reserved.start()] if reserved else domain.rpartition(".")[0]
        return f"{permute(local + 'aa' * wider, tag, key)}@{permute(front, 'domain', key)}{domain[len(front):]}"
    if kind == "access":
        return value[:4] + permute(value[4:], tag, key)
    if kind == "initial":
        sets, i = _NAMES.get(value, (value, 0))
        step = int.from_bytes(hashlib.blake2b(f"{tag}|{sets}".encode(), key=key[:64], digest_size=8).digest(), "big")
        return sets[(i + 1 + step % max(1, len(sets) - 1)) % len(sets)]
    if kind == "secret" and len(value) > BLOCK:  # in blocks, each keyed by those before it: still a permutation, in time in proportion
        classes = _HEX if re.fullmatch(r"[0-9a-f]+", value) else None
        value, new = value + "00" * wider, []
        for at in range(0, len(value), BLOCK):
            new.append(permute(value[at : at + BLOCK], tag, key, classes))
            tag = hashlib.blake2b(f"{tag}|{value[at : at + BLOCK]}".encode("utf-8", "surrogatepass"), key=key[:64]).hexdigest()
        return "".join(new)
    if kind == "secret":
        return permute(value + "00" * wider, tag, key, _HEX if re.fullmatch(r"[0-9a-f]+", value) else None)
    if kind == "given":
        group = _GENDER.get(value)
        if group:
            names = sorted(GIVEN[group], key=lambda n: hashlib.blake2b(n.encode(), key=key[:64]).digest())
            return names[(names.index(value) + 1 + attempt) % len(names)]
        end = value[-1]  # the end of a name tells its gender
        return _walk(value[:-1] + "aa" * wider, lambda x: permute(x, tag + end, key, _NAMES), lambda x: x + end in _GENDER and x != value[:-1]) + end
    if kind == "family":
        return permute(value + "aa" * wider, tag, key, _NAMES)
    if kind == "phone" and len(value) >= 8 and not wider:
        head = max(0, len(value) - 10)  # the country's code stays
        return value[:head] + _walk(value[head:], lambda x: permute(x, tag + value[:head], key), lambda x: (x[0] > "1", x[3] > "1", x[0] == "0"))
    return permute(value + "00" * wider, tag, key)


def find(text: str) -> list[tuple[int, int, str, str]]:
    """Mentions ``(start, end, kind, canonical value)`` of a whole text, in order, without overlaps."""
    found = []
    at = text.find("@")
    while at >= 0:
        local = _LOCAL.search(text[max(0, at - 64) : at])
        domain = _DOMAIN.match(text, at + 1)
        if local and domain:
            found.append((at - len(local[0]), domain.end(), "email", f"{local[0]}@{domain[0]}".lower()))
        at = text.find("@", at + 1)
    if _DIGIT.search(text):
        for m in _NUMBER.finditer(text):
            kind = m.lastgroup
            value = m[0] if kind == "ip" else re.sub(r"\D", "", m[0])
            if kind != "card" or value[0] in "23456" and _luhn(value[:-1]) == int(value[-1]):
                found.append((*m.span(), kind, value))
        for m in _IBAN.finditer(text):
            value = m[0].replace(" ", "")
            if int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1:
                found.append((*m.span(), "iban", value))
    if "AKIA" in text or "ASIA" in text:
        found += [(*m.span(), "access", m[0]) for m in _ACCESS.finditer(text)]
    if "=" in text or ":" in text:
        for m in _SECRET.finditer(text):
            k = m.lastindex
            plain = k == 3 and ":" in text[m.start() : m.start(k)]  # "secret: nothing-here" is prose
            if plain and not _DIGIT.search(m[k]) and (m[k].islower() or m[k].isupper() or m[k][1:].islower()):
                continue
            found.append((*m.span(k), "secret", m[k]))
    if any(t in text for t in TITLES):
        for title in _TITLE.finditer(text):
            m = _NAME.match(text, title.end())
            words, start = [], title.end()
            for w in m[0].split(" ") if m else ():  # a name ends before the first word in lower case, or at a title
                if not w[0].isupper() or w in TITLES:
                    break
                words.append(w)
            while words and len(words[-1]) == 1:  # no initial without a name
                words.pop()
            for i, w in enumerate(words):
                for part in _LETTERS.finditer(w):
                    a, b, low = start + part.start(), start + part.end(), part[0].lower()
                    if len(part[0]) > 1:
                        found.append((a, b, "given" if i + 1 < len(words) or low in _GENDER else "family", low))
                    elif w[part.end() : part.end() + 1] not in ("'", "’"):  # the O of O'Brien stays
                        found.append((a, b, "initial", low))
                start += len(w) + 1
    found += _again(text, found)
    found.sort(key=lambda f: (f[0], -f[1]))
    out, end = [], 0
    for f in found:
        if f[0] >= end:
            out.append(f)
            end = f[1]
    return out


def _again(text: str, found: list) -> list[tuple[int, int, str, str]]:
    """Other mentions of what was found: names without their title, phone numbers without their format."""
    more = []
    names = {value: kind for _, _, kind, value in found if kind in ("given", "family") and len(value) > 2}
    if names:
        for m in _LETTERS.finditer(text):
            low = m[0].lower()
            a, b = m.span()
            if low in names and m[0][0].isupper() and not (text[a - 1 : a].isdigit() or text[b : b + 1].isdigit() or "_" in (text[a - 1 : a], text[b : b + 1])):
                more.append((a, b, names[low], low))
    phones = {value for _, _, kind, value in found if kind == "phone"}
    if phones:
        more += [(*m.span(), "phone", m[0]) for m in _RUN_OF_DIGITS.finditer(text) if m[0] in phones]
    return more


def render(mention: str, kind: str, value: str) -> str:
    """``value`` in the format and case of ``mention``."""
    if kind in ("phone", "card", "ssn"):
        digits = iter(value)
        shown = re.sub(r"\d", lambda _: next(digits), mention)
        return shown + "".join(digits)
    if kind == "iban":
        chars = iter(value)
        return "".join(c if c == " " else next(chars) for c in mention)
    if kind in ("email", "family", "given", "initial"):
        if mention.isupper():
            return value.upper()
        if kind != "email" and mention[0].isupper():
            return value[0].upper() + value[1:]
    return value


def replace(text: str, attempts: dict | None = None, *, key: bytes) -> tuple[str, int]:
    """``text`` with surrogates, and the number of mentions."""
    found = find(text)
    if not found:
        return text, 0
    parts, at = [], 0
    for start, end, kind, value in found:
        new = surrogate(kind, value, (attempts or {}).get(f"{kind}|{value}", 0), key=key)
        parts += [text[at:start], render(text[start:end], kind, new)]
        at = end
    return "".join([*parts, text[at:]]), len(found)


def entities(docs: DataFrame, text: str = "text", of_text: bool = False) -> DataFrame:
    """Distinct ``kind, value`` of all documents; ``of_text``: of each text, with its MD5 ``h``."""

    def run(batches):
        for b in batches:
            seen = set()
            for t in b.column(0):
                t = t.as_py()
                h = hashlib.md5(t.encode("utf-8", "surrogatepass")).hexdigest() if of_text and t else ""
                seen.update((kind, value, h) for _, _, kind, value in find(t or "") if kind != "initial")  # all letters are initials
            kinds, values, hs = zip(*sorted(seen), strict=True) if seen else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(values, pa.string()), pa.array(hs, pa.string())], names=["kind", "value", "h"])

    return docs.select(text).mapInArrow(run, "kind string, value string, h string").distinct()


def exceptions(known: DataFrame, key: bytes, max_rounds: int = 40) -> DataFrame | None:
    """``kind, value, attempt`` of the entities whose first surrogate is taken, or None.

    ``known``: distinct ``kind, value``.  Listed given names take no part.
    """
    known = known.where(~((F.col("kind") == "given") & F.col("value").isin(sorted(_GENDER))))

    def run(batches):
        for b in batches:
            got = [surrogate(k, v, a, key=key) for k, v, a in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.string())], names=["kind", "value", "attempt", "new"])

    real = known.select("kind", F.col("value").alias("new"))
    state = known.select("kind", "value", F.lit(0).alias("attempt"))
    moved = False
    for _ in range(max_rounds):
        made = cut(state.mapInArrow(run, "kind string, value string, attempt int, new string"))
        taken = made.join(real, ["kind", "new"], "left_semi").select("kind", "value")
        twice = made.groupBy("kind", "new").agg(F.count("*").alias("n"), F.min("value").alias("first")).where("n > 1")
        second = made.join(twice, ["kind", "new"]).where("value <> first").select("kind", "value")
        again = cut(taken.unionByName(second).distinct().withColumn("bump", F.lit(1)))
        if again.isEmpty():
            return made.where("attempt > 0").select("kind", "value", "attempt") if moved else None
        moved = True
        state = made.select("kind", "value", "attempt").join(again, ["kind", "value"], "left").select("kind", "value", (F.col("attempt") + F.coalesce("bump", F.lit(0))).alias("attempt"))
    raise RuntimeError(f"some surrogates are still taken after {max_rounds} rounds")


def pseudonymise(docs: DataFrame, key: bytes, text: str = "text", count: str | None = None) -> DataFrame:
    """``docs`` with surrogates in ``text``; ``count`` names a new column with the number of mentions."""
    if clash := {count, "__odd", "__md5"} & set(docs.columns):
        raise ValueError(f"the input already has {sorted(clash)}")
    columns = docs.columns
    odd = exceptions(cut(entities(docs, text).select("kind", "value")), key)
    if odd is None:
        rows = docs.withColumn("__odd", F.lit(None).cast("map<string,int>"))
    else:
        of = entities(docs, text, of_text=True).join(odd, ["kind", "value"])
        by_text = of.groupBy(F.col("h").alias("__md5")).agg(F.map_from_entries(F.collect_set(F.struct(F.concat_ws("|", "kind", "value"), "attempt"))).alias("__odd"))
        rows = docs.join(by_text, F.md5(F.col(text)) == F.col("__md5"), "left").select(*[docs[c] for c in columns], "__odd")
    rest = [c for c in columns if c != text]

    def run(batches):
        for b in slices(batches):
            new, n = [], []
            for t, o in zip(b.column(len(rest)), b.column(len(rest) + 1), strict=True):
                t = t.as_py()
                r = (None, 0) if t is None else replace(t, dict(o.as_py()) if o.is_valid else None, key=key)
                new.append(r[0])
                n.append(r[1])
            made = {text: pa.array(new, pa.string())} | {c: b.column(i) for i, c in enumerate(rest)}
            yield pa.RecordBatch.from_arrays([*[made[c] for c in columns], *([pa.array(n, pa.int64())] if count else [])], names=[*columns, *([count] if count else [])])

    have = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns]
    return rows.select(*rest, text, "__odd").mapInArrow(run, ", ".join([*have, *([f"`{count}` bigint"] if count else [])]))
