"""PII: format-preserving pseudonyms.

Card numbers, account numbers (IBAN), social security numbers, telephone numbers,
IPv4 addresses, dates and the names in e-mail addresses are found, validated, and
replaced by a keyed permutation of their own format: a Feistel network over the
format's value space. Check digits, country codes, separators and validity stay as
they are; equal values get equal pseudonyms in every document, whatever their
separators, and no value is its own pseudonym.

The permutation is ``P^-1(P(x) + 1)`` with the walked Feistel network P: a
bijection of the format's ``N`` values without fixed points.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

ROUNDS = 8
FIRST, LAST = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()
EDGE, END = r"(?<![0-9A-Za-z])", r"(?![0-9A-Za-z])"
KINDS = ("iban", "email", "ip", "date", "ssn", "phone", "card")
FOUND = {
    "email": re.compile(r"(?<![A-Za-z0-9._%+-])([A-Za-z0-9](?:[A-Za-z0-9._%+-]{0,62}[A-Za-z0-9])?)@(?:[A-Za-z0-9-]{1,63}\.)+[A-Za-z]{2,24}(?![A-Za-z0-9-])", re.ASCII),
    "ip": re.compile(rf"(?<![0-9A-Za-z.])\d{{1,3}}(?:\.\d{{1,3}}){{3}}(?![0-9A-Za-z]|\.\d)", re.ASCII),
    "date": re.compile(rf"{EDGE}(?:(\d{{4}})([-/.])(\d\d)\2(\d\d)|(\d\d)([-/.])(\d\d)\6(\d{{4}})){END}", re.ASCII),
    "ssn": re.compile(rf"(?<![0-9A-Za-z-])(\d{{3}})-(\d\d)-(\d{{4}})(?![0-9A-Za-z]|-\d)", re.ASCII),
    "phone": re.compile(r"(?<![0-9A-Za-z+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,5}(?:[ .-]?\d{2,5}){1,4}|\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?![0-9A-Za-z])", re.ASCII),
}
#: Where a card or an account number may start, and one character of it with the separator before it.
CARD_START, CARD_NEXT = re.compile(rf"{EDGE}(?=\d(?:[ -]?\d){{12}})", re.ASCII), re.compile(r"[ -]?\d", re.ASCII)
IBAN_START, IBAN_NEXT = re.compile(rf"{EDGE}(?=[A-Z]{{2}}\d\d ?[A-Z0-9])", re.ASCII), re.compile(r" ?[A-Z0-9]", re.ASCII)
#: Characters of the account numbers of each country; other countries may have 15 to 34.
IBAN_LENGTHS = dict(
    pair.split("-")
    for pair in (
        "AD-24 AE-23 AL-28 AT-20 AZ-28 BA-20 BE-16 BG-22 BH-22 BR-29 BY-28 CH-21 CR-22 CY-28 CZ-24 DE-22 DK-18 DO-28 EE-20 EG-29 ES-24 FI-18 FO-18 "
        "FR-27 GB-22 GE-22 GI-23 GL-18 GR-27 GT-28 HR-21 HU-28 IE-22 IL-23 IQ-23 IS-26 IT-27 JO-30 KW-30 KZ-20 LB-28 LC-32 LI-21 LT-20 LU-20 LV-21 "
        "LY-25 MC-27 MD-24 ME-22 MK-19 MR-27 MT-31 MU-30 NL-18 NO-15 PK-24 PL-28 PS-29 PT-25 QA-29 RO-24 RS-22 SA-24 SC-31 SE-24 SI-19 SK-24 SM-27 "
        "ST-25 SV-28 TL-23 TN-24 TR-26 UA-29 VA-22 VG-24 XK-20"
    ).split()
)
#: Longest country calling codes first; others keep one digit.
CALLING = re.compile(r"1|7|2[07]|3[0-4]|36|39|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3}")


class Permutation:
    """Keyed permutations of ``range(n)``, one for each format."""

    def __init__(self, key: bytes) -> None:
        self.key = key

    def _step(self, form: bytes, r: int, value: int, modulus: int) -> int:
        data = b"%b|%d|%d" % (form, r, value)
        return int.from_bytes(hashlib.blake2b(data, key=self.key, digest_size=32).digest(), "big") % modulus

    def _network(self, x: int, low: int, high: int, form: bytes, back: bool) -> int:
        a, b = divmod(x, low)
        for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
            sign = -1 if back else 1
            if r % 2:
                b = (b + sign * self._step(form, r, a, low)) % low
            else:
                a = (a + sign * self._step(form, r, b, high)) % high
        return a * low + b

    def _walk(self, x: int, n: int, form: bytes, back: bool) -> int:
        low = max(2, int(n**0.5) if n < 1 << 52 else 1 << (n.bit_length() // 2))
        high = -(-n // low)
        x = self._network(x, low, high, form, back)
        while x >= n:
            x = self._network(x, low, high, form, back)
        return x

    def other(self, x: int, n: int, form: str) -> int:
        """Never ``x``, if ``n`` is over 1."""
        name = f"{form}|{n}".encode()
        return self._walk((self._walk(x, n, name, False) + 1) % n, n, name, True) if n > 1 else x


def luhn(digits: str) -> int:
    """The check digit that completes ``digits``."""
    total = sum(int(d) if i % 2 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits)))
    return -total % 10


def _mod97(account: str) -> int:
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97


def _refill(shape: str, values: str) -> str:
    """``shape`` with its letters and digits replaced in turn."""
    rest = iter(values)
    return "".join(next(rest) if c.isalnum() else c for c in shape)


def _permute_chars(chars: str, permute: Permutation, form: str) -> str:
    """Digits stay digits, and letters letters of their case: a mixed-radix number over all places."""
    sets = ["0123456789" if c.isdigit() else "ABCDEFGHIJKLMNOPQRSTUVWXYZ" if c.isupper() else "abcdefghijklmnopqrstuvwxyz" for c in chars]
    value, size = 0, 1
    for c, s in zip(chars, sets, strict=True):
        value, size = value * len(s) + s.index(c), size * len(s)
    value = permute.other(value, size, form + "".join(s[0] for s in sets))
    out = []
    for s in reversed(sets):
        value, at = divmod(value, len(s))
        out.append(s[at])
    return "".join(reversed(out))


def _ends(text: str, start: int, following: re.Pattern, most: int) -> list[int]:
    """Where the first, second, ... character of a number that starts here ends."""
    out, at = [], start
    while len(out) < most and (m := following.match(text, at)):
        at = m.end()
        out.append(at)
    return out


def _alone(text: str, end: int) -> bool:
    return not (text[end : end + 1].isascii() and text[end : end + 1].isalnum())


def cards(text: str, permute: Permutation) -> Iterator[tuple[int, int, str]]:
    """From each start, the longest of 13 to 19 digits that is valid."""
    for m in CARD_START.finditer(text):
        ends = _ends(text, m.start(), CARD_NEXT, 19)
        for end in ends[:11:-1]:
            digits = re.sub(r"\D", "", text[m.start() : end])
            if _alone(text, end) and luhn(digits[:-1]) == int(digits[-1]) and len(set(digits)) > 1:
                body = _permute_chars(digits[:-1], permute, "card")
                yield m.start(), end, _refill(text[m.start() : end], body + str(luhn(body)))
                break


def ibans(text: str, permute: Permutation) -> Iterator[tuple[int, int, str]]:
    """From each start, the number of the country's length; for countries without one, the longest that is valid."""
    for m in IBAN_START.finditer(text):
        ends = _ends(text, m.start(), IBAN_NEXT, 34)
        known = IBAN_LENGTHS.get(text[m.start() : m.start() + 2])
        for length in [int(known)] if known else range(len(ends), 14, -1):
            if length > len(ends) or not _alone(text, ends[length - 1]):
                continue
            account = text[m.start() : ends[length - 1]].replace(" ", "")
            if _mod97(account) == 1:
                body = _permute_chars(account[4:], permute, account[:2])
                check = 98 - _mod97(account[:2] + "00" + body)
                yield m.start(), ends[length - 1], _refill(text[m.start() : ends[length - 1]], f"{account[:2]}{check:02d}{body}")
                break


def ssn(m: re.Match, permute: Permutation) -> str | None:
    area, group, serial = map(int, m.groups())
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    areas = [a for a in range(1, 900) if a != 666]
    value = permute.other((areas.index(area) * 99 + group - 1) * 9999 + serial - 1, len(areas) * 99 * 9999, "ssn")
    value, serial = divmod(value, 9999)
    area, group = divmod(value, 99)
    return f"{areas[area]:03d}-{group + 1:02d}-{serial + 1:04d}"


def ip(m: re.Match, permute: Permutation) -> str | None:
    parts = [int(p) for p in m[0].split(".")]
    if max(parts) > 255 or any(len(p) > 1 and p[0] == "0" for p in m[0].split(".")):
        return None
    value = permute.other(int.from_bytes(bytes(parts), "big"), 1 << 32, "ip")
    return ".".join(map(str, value.to_bytes(4, "big")))


def date(m: re.Match, permute: Permutation) -> str | None:
    """ISO order as it is; otherwise day first, or month first where only that is a date."""
    year, month, day, sign = (m[1], m[3], m[4], m[2]) if m[1] else (m[8], m[7], m[5], m[6])
    swapped = False
    try:
        at = datetime.date(int(year), int(month), int(day))
    except ValueError:
        if m[1]:
            return None
        try:
            at, swapped = datetime.date(int(year), int(day), int(month)), True
        except ValueError:
            return None
    if not FIRST <= at.toordinal() <= LAST:
        return None
    new = datetime.date.fromordinal(FIRST + permute.other(at.toordinal() - FIRST, LAST - FIRST + 1, "date"))
    first, second = (new.month, new.day) if swapped else (new.day, new.month)
    return f"{new.year:04d}{sign}{new.month:02d}{sign}{new.day:02d}" if m[1] else f"{first:02d}{sign}{second:02d}{sign}{new.year:04d}"


def phone(m: re.Match, permute: Permutation) -> str | None:
    """The country code stays, and in North American numbers the first digit of area and exchange stays in 2 to 9."""
    digits = re.sub(r"\D", "", m[0])
    code = ""
    if m[0][0] == "+":
        code = CALLING.match(digits)[0] if CALLING.match(digits) else digits[:1]
    own = digits[len(code) :]
    if not 8 <= len(digits) <= 15 or not 6 <= len(own):
        return None
    if code in ("", "1"):
        if len(own) != 10 or own[0] in "01" or own[3] in "01":
            return None
        value = (((int(own[0]) - 2) * 100 + int(own[1:3])) * 8 + int(own[3]) - 2) * 10**6 + int(own[4:])
        value = permute.other(value, 800 * 8 * 10**6, "nanp")
        value, tail = divmod(value, 10**6)
        area, head = divmod(value, 8)
        own = f"{area + 200:03d}{head + 2}{tail:06d}"
    else:
        own = _permute_chars(own, permute, "phone" + code)
    return _refill(m[0], code + own)


def email(m: re.Match, permute: Permutation) -> str | None:
    own = re.sub(r"[^A-Za-z0-9]", "", m[1])
    return _refill(m[1], _permute_chars(own, permute, "email")) + m[0][len(m[1]) :]


RULES: dict[str, Callable[[re.Match, Permutation], str | None]] = {"email": email, "ip": ip, "date": date, "ssn": ssn, "phone": phone}
SEARCHES: dict[str, Callable[[str, Permutation], Iterator[tuple[int, int, str]]]] = {"iban": ibans, "card": cards}


def pseudonymise_text(text: str, permute: Permutation) -> tuple[str, list[tuple[int, int, str, str]]]:
    """The new text and the ``(start, end, kind, pseudonym)`` replaced; the earliest match wins, then the order of KINDS."""
    has_digit = any(d in text for d in "0123456789")
    if not has_digit and "@" not in text:
        return text, []
    hits = []
    for rank, kind in enumerate(KINDS):
        if kind == "email" and "@" not in text or kind != "email" and not has_digit:
            continue
        if kind in SEARCHES:
            hits += [(start, rank, end, kind, new) for start, end, new in SEARCHES[kind](text, permute)]
            continue
        for m in FOUND[kind].finditer(text):
            new = RULES[kind](m, permute)
            if new is not None:
                hits.append((m.start(), rank, m.end(), kind, new))
    at, parts, kept = 0, [], []
    for start, _, end, kind, new in sorted(hits):
        if start >= at:
            parts += [text[at:start], new]
            kept.append((start, end, kind, new))
            at = end
    return "".join([*parts, text[at:]]), kept


def pseudonymise(docs: DataFrame, key: bytes) -> DataFrame:
    """``docs`` with its text pseudonymised, plus ``n_found`` and ``found``: ``(start, stop, kind, pseudonym)`` by place in the old text.

    A null text stays null and an empty one empty, with nothing found. Repeated rows
    stay, with equal results; ``doc_id`` does not matter. Other columns pass
    through, but for any named like the two added ones. Texts are scanned whole, and
    a row's result depends on nothing but its text and the key.
    """
    kept = [f for f in docs.schema.fields if f.name not in ("n_found", "found")]
    names = [f.name for f in kept]
    rest = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    spans = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("kind", pa.string()), ("pseudonym", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        permute = Permutation(key)
        for batch in batches:
            done = [(None, []) if t is None else pseudonymise_text(t, permute) for t in batch.column("text").to_pylist()]
            found = [[{"start": a, "stop": b, "kind": k, "pseudonym": p} for a, b, k, p in f] for _, f in done]
            columns = [pa.array([t for t, _ in done], pa.string()) if c == "text" else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([len(f) for f in found], pa.int64()), pa.array(found, spans)], [*names, "n_found", "found"])

    return docs.select(*[f"`{c}`" for c in names]).mapInArrow(run, f"{rest}, n_found long, found array<struct<start:int,stop:int,kind:string,pseudonym:string>>")
