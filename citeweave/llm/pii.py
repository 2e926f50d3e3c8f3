"""Format-preserving pseudonyms for personal data, by a keyed Feistel permutation.

What is found is checked (dates exist, card numbers and IBANs pass their check digits, address parts are in range) and
mapped to another value of the same format by a permutation that depends on a key and on the kind alone. So equal
values get equal pseudonyms in every document, different ones stay different, and separators are kept. Digits of any
script count; a value is read as if written in ASCII digits, and its pseudonym has the script of its first digit.
"""

from __future__ import annotations

import datetime
import hashlib
import re
import secrets
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeweave.llm.common import with_text_columns

ROUNDS = 8
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Dates outside these years are left alone; within them a pseudonym is a date in them too.
FIRST_DAY, LAST_DAY = datetime.date(1600, 1, 1).toordinal(), datetime.date(2399, 12, 31).toordinal()

# Formats that are looked for. Where two overlap, the earlier start wins, then the earlier in this list.
EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.)+[A-Za-z]{2,24}(?![A-Za-z0-9-])")
SECRET = re.compile(r"\b(?i:token|secret|password|passwd|api[_-]?key|access[_-]?key|private[_-]?key)\b\s*[:=]\s*[\"']?([A-Za-z0-9+/_.=-]{8,})")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
ADDRESS = re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])")
ISO_DATE = re.compile(r"(?<![0-9-])([0-9]{4})([-/.])([0-9]{1,2})\2([0-9]{1,2})(?![0-9-])")
DAY_FIRST = re.compile(r"(?<![0-9./-])([0-9]{1,2})([-/.])([0-9]{1,2})\2([0-9]{4})(?![0-9]|[./-][0-9])")
SOCIAL = re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
PHONE = re.compile(r"(?<![0-9+])\+?[0-9]{0,3}[ .-]?\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9+])\+[0-9]{9,15}(?![0-9])|(?<![0-9+])\+[0-9]{1,3}(?:[ .-][0-9]{2,9}){2,5}(?![0-9])")
CARD = re.compile(
    r"(?<![0-9])(?<![0-9]-)(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1(?:[0-9]{4}(?:\1[0-9]{1,3})?|[0-9]{1,4})|[0-9]{4}([ -])[0-9]{6}\2[0-9]{4,5})(?!-?[0-9])"
)


class Permutation:
    """Keyed permutations, one for each tweak, by Feistel rounds: of the numbers 0..n-1, and of strings of one format."""

    def __init__(self, key: str | bytes):
        if not key:
            raise ValueError("pseudonyms need a secret key")
        self.key = hashlib.blake2b(key.encode() if isinstance(key, str) else key, digest_size=32).digest()

    def _bytes(self, tweak: bytes, k: int, half: bytes, size: int) -> bytes:
        """`size` pseudorandom bytes of one round from the other half."""
        h = hashlib.blake2b(half, key=self.key, salt=k.to_bytes(16, "little"), person=hashlib.blake2b(tweak, digest_size=16).digest()).digest()
        return h[:size] if size <= len(h) else hashlib.shake_256(h).digest(size)

    def __call__(self, value: int, n: int, tweak: bytes, inverse: bool = False) -> int:
        """Another number below `n` for a number below `n`: one step on the cycle in which the rounds put all of them, so none stays what it is."""
        if n < 2:
            return value
        return self._feistel((self._feistel(value, n, tweak) + (-1 if inverse else 1)) % n, n, tweak, True)

    def _feistel(self, value: int, n: int, tweak: bytes, inverse: bool = False) -> int:
        """Balanced rounds, repeated until the value is in range."""
        bits = ((n - 1).bit_length() + 1) // 2
        mask, size = (1 << bits) - 1, (bits + 7) // 8
        drawn = lambda k, half: int.from_bytes(self._bytes(tweak, k, half.to_bytes(size, "little"), size), "little") & mask
        while True:
            a, b = value >> bits, value & mask
            for k in reversed(range(ROUNDS)) if inverse else range(ROUNDS):
                a, b = (b ^ drawn(k, a), a) if inverse else (b, a ^ drawn(k, b))
            value = a << bits | b
            if value < n:
                return value

    def symbols(self, text: str, tweak: bytes, alphabets: list[str], inverse: bool = False) -> str:
        """Another string whose every place holds a symbol of the same alphabet, in time linear in its length; again one step on a cycle of all of them."""
        if not text:
            return text
        sizes = np.array([len(a) for a in alphabets], np.int64)
        tweak += sizes.astype("<u2").tobytes()
        value = self._mixed(np.array([a.index(c) for c, a in zip(text, alphabets)], np.int64), sizes, tweak)
        for k in reversed(range(len(value))):  # one more, or one less, with carry
            value[k] = (value[k] + (-1 if inverse else 1)) % sizes[k]
            if value[k] != (sizes[k] - 1 if inverse else 0):
                break
        value = self._mixed(value, sizes, tweak, True)
        return "".join(a[k] for a, k in zip(alphabets, value.tolist()))

    def _mixed(self, value: np.ndarray, sizes: np.ndarray, tweak: bytes, inverse: bool = False) -> np.ndarray:
        """Rounds that add to the symbols of one half, each modulo the size of its alphabet, what is drawn from the other half."""
        halves = [slice(0, len(value) // 2), slice(len(value) // 2, None)]
        for k in reversed(range(ROUNDS)) if inverse else range(ROUNDS):
            to, source = halves[k % 2], halves[1 - k % 2]
            drawn = np.frombuffer(self._bytes(tweak, k, value[source].astype("<u2").tobytes(), 4 * len(sizes[to])), "<u4").astype(np.int64)
            value[to] = (value[to] + (-drawn if inverse else drawn)) % sizes[to]
        return value


def _alphabet(c: str) -> str | None:
    return next((a for a in (DIGITS, LOWER, UPPER) if c in a), None)


def _within(p: Permutation, text: str, tweak: bytes, alphabet: Callable[[str], str | None] = _alphabet) -> str:
    """Permutes the characters that have an alphabet and leaves the others in place."""
    at = [(k, alphabet(c)) for k, c in enumerate(text) if alphabet(c)]
    new, out = p.symbols("".join(text[k] for k, _ in at), tweak, [a for _, a in at]), list(text)
    for (k, _), c in zip(at, new):
        out[k] = c
    return "".join(out)


def _digits(text: str, new: str) -> str:
    """`text` with its digits replaced by those of `new`, in order."""
    own = iter(new)
    return "".join(next(own) if c in DIGITS else c for c in text)


def luhn_digit(digits: str) -> str:
    """The check digit that follows `digits`."""
    return str(-(sum(map(int, digits[-2::-2])) + sum(map("0516273849".index, digits[-1::-2]))) % 10)


def iban_check(country: str, account: str) -> str:
    number = "".join(str(int(c, 36)) for c in account + country + "00")
    return f"{98 - int(number) % 97:02d}"


def _email(p: Permutation, m: re.Match) -> str:
    name, _, domain = m[0].rpartition("@")
    host, dot, top = domain.rpartition(".")
    return _within(p, f"{name}@{host}", b"email") + dot + top


def _secret(p: Permutation, m: re.Match) -> str:
    value = m[1]
    hexadecimal = next((a for a in (DIGITS + "abcdef", DIGITS + "ABCDEF") if set(value) <= set(a)), None)
    new = _within(p, value, b"secret", lambda c: hexadecimal) if hexadecimal else _within(p, value, b"secret")
    return m[0][: m.start(1) - m.start()] + new


def _iban(p: Permutation, m: re.Match) -> str | None:
    flat = m[0].replace(" ", "")
    country, check, account = flat[:2], flat[2:4], flat[4:]
    if not 15 <= len(flat) <= 34 or iban_check(country, account) != check:
        return None
    new = _within(p, account, b"iban" + country.encode())
    own = iter(country + iban_check(country, new) + new)
    return "".join(c if c == " " else next(own) for c in m[0])


def _address(p: Permutation, m: re.Match) -> str | None:
    parts = [int(x) for x in m[0].split(".")]
    if max(parts) > 255:
        return None
    value = p(int.from_bytes(bytes(parts), "big"), 1 << 32, b"address")
    return ".".join(map(str, value.to_bytes(4, "big")))


def _date(p: Permutation, m: re.Match, iso: bool) -> str | None:
    a, mark, b, c = m.groups()
    swapped = False
    try:
        day = datetime.date(int(a), int(b), int(c)) if iso else datetime.date(int(c), int(b), int(a))
    except ValueError:
        if iso:
            return None
        try:  # month first
            day, swapped = datetime.date(int(c), int(a), int(b)), True
        except ValueError:
            return None
    if not FIRST_DAY <= day.toordinal() <= LAST_DAY:
        return None
    new = datetime.date.fromordinal(FIRST_DAY + p(day.toordinal() - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, b"date"))
    width = (lambda n, was: f"{n:02d}" if len(was) == 2 else str(n))
    if iso:
        return f"{new.year:04d}{mark}{width(new.month, b)}{mark}{width(new.day, c)}"
    first, second = (new.month, new.day) if swapped else (new.day, new.month)
    return f"{width(first, a)}{mark}{width(second, b)}{mark}{new.year:04d}"


def _social(p: Permutation, m: re.Match) -> str | None:
    valid = lambda x: x[:3] not in ("000", "666") and x[0] != "9" and x[3:5] != "00" and x[5:] != "0000"
    digits = "".join(m.groups())
    if not valid(digits):
        return None
    while True:  # walks on to the next valid number, which keeps it a permutation
        digits = p.symbols(digits, b"social", [DIGITS] * 9)
        if valid(digits):
            return _digits(m[0], digits)


def _phone(p: Permutation, m: re.Match) -> str:
    digits = re.sub(r"\D", "", m[0])
    keep = max(0, len(digits) - 10) or (1 if m[0].startswith("+") else 0)
    return _digits(m[0], digits[:keep] + p.symbols(digits[keep:], b"phone", [DIGITS] * (len(digits) - keep)))


def _card(p: Permutation, m: re.Match) -> str | None:
    """Four groups of four may be followed by a number that is no part of the card."""
    for end in (19, len(m[0])) if re.fullmatch(r"(?:[0-9]{4}[ -]){4}[0-9]{1,3}", m[0]) else (len(m[0]),):
        was = m[0][:end]
        digits = re.sub("[^0-9]", "", was)
        if luhn_digit(digits[:-1]) == digits[-1]:
            new = p.symbols(digits[:-1], b"card", [DIGITS] * (len(digits) - 1))
            return _digits(was, new + luhn_digit(new)) + m[0][end:]
    return None


def _each(pattern: re.Pattern, change: Callable) -> Callable:
    """(start, end, pseudonym) of every match that holds a valid value; behind any other the search goes on at its next character."""
    def find(p: Permutation, text: str) -> Iterator[tuple[int, int, str]]:
        m = pattern.search(text)
        while m:
            new = change(p, m)
            if new is not None:
                yield m.start(), m.end(), new
            m = pattern.search(text, m.end() if new is not None else m.start() + 1)

    return find


KINDS: list[tuple[str, str, Callable]] = [
    ("email", "@", _each(EMAIL, _email)),
    ("secret", "", _each(SECRET, _secret)),
    ("iban", "0", _each(IBAN, _iban)),
    ("address", "0", _each(ADDRESS, _address)),
    ("date", "0", _each(ISO_DATE, lambda p, m: _date(p, m, True))),
    ("date", "0", _each(DAY_FIRST, lambda p, m: _date(p, m, False))),
    ("social", "0", _each(SOCIAL, _social)),
    ("phone", "0", _each(PHONE, _phone)),
    ("card", "0", _each(CARD, _card)),
]
_ANY_DIGIT, _ASSIGNED, _OTHER_DIGIT = re.compile("[0-9]"), re.compile("[:=]"), re.compile(r"(?![0-9])\d")


def _scripted(new: str, was: str) -> str:
    """`new` with its digits in the script of the first digit of `was`."""
    first = next((c for c in was if c.isdecimal()), "0")
    if first in DIGITS:
        return new
    zero = ord(first) - unicodedata.decimal(first)
    return new.translate({ord(d): zero + k for k, d in enumerate(DIGITS)})


def pseudonymise(text: str | None, p: Permutation) -> tuple[str | None, list[str]]:
    """The text with every value found replaced, and the kinds of the values in order."""
    if not text:
        return text, []
    plain = text
    if not text.isascii() and _OTHER_DIGIT.search(text):
        plain = _OTHER_DIGIT.sub(lambda m: DIGITS[unicodedata.decimal(m[0])], text)
    digit, at, assigned = _ANY_DIGIT.search(plain), "@" in plain, _ASSIGNED.search(plain)
    found = []
    for rank, (kind, needs, find) in enumerate(KINDS):
        if (needs == "@" and not at) or (needs == "0" and not digit) or (not needs and not assigned):
            continue
        found += [(start, rank, stop, kind, new) for start, stop, new in find(p, plain)]
    out, kinds, end = [], [], 0
    for start, _, stop, kind, new in sorted(found):
        if start >= end:
            out += [text[end:start], new if plain is text else _scripted(new, text[start:stop])]
            kinds.append(kind)
            end = stop
    return "".join([*out, text[end:]]) if kinds else text, kinds


def session_key(spark: SparkSession) -> str:
    """The secret of the session, `spark.citeweave.pseudonymKey`; a random one, good for one run, where it is unset."""
    return spark.conf.get("spark.citeweave.pseudonymKey", None) or secrets.token_hex(32)


def with_pseudonyms(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """`docs` with `text` replaced by its pseudonymised form and a column `pii_kinds`, an array of the kinds found."""
    def make():
        p = Permutation(key)
        return lambda x: pseudonymise(x, p)

    df = with_text_columns(docs, text, make, [("_pseudonymised", "string"), ("pii_kinds", "array<string>")])
    return df.withColumn(text, F.col("_pseudonymised")).drop("_pseudonymised")


def private_data(docs: DataFrame, key: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Row per input row: doc_id, `text` with pseudonyms, n_found and the kinds found (distinct, sorted, comma-joined).

    Null stays null and empty stays empty, with nothing found; very long texts and values take time in proportion to
    their length; repeated rows are changed alike; where two formats overlap the earlier start wins; an empty table
    gives an empty table; other columns are not read. Keep `key` secret: who has it can undo the permutation.
    """
    df = with_pseudonyms(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), key)
    return df.select("doc_id", "text", F.size("pii_kinds").cast("long").alias("n_found"), F.array_join(F.array_sort(F.array_distinct("pii_kinds")), ",").alias("kinds"))
