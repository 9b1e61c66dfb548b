"""Format-preserving pseudonyms for personal data, by a keyed Feistel network.

A found value is validated (check digits, calendar, number ranges), numbered within its format,
and the number is permuted under a secret key. Its pseudonym has the same format and passes the
same validation; separators and letter case stay where they are. The same value gets the same
pseudonym in every document, different values of a format get different ones, and no value is
its own pseudonym: the permutation is one cycle, x -> F(F^-1(x) + 1), F being the Feistel
network on the numbers of the format. Whoever has the key can restore the values.

What is found: card numbers (issuer prefix and Luhn), IBANs (mod 97), US social security
numbers, international phone numbers (a plus sign and 8 to 15 digits, in any groups with single
separators), IPv4 addresses, calendar dates in three notations, and mail addresses (the part
before the @).
"""

import datetime as dt
import hashlib
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
ERAS = ((1, 1900), (1900, 2100), (2100, 10000))  # years; a date stays within its era

# Card issuer prefixes and lengths as the networks publish them.
CARD = re.compile(r"(?:4\d{12}(?:\d{3}){0,2}|5[1-5]\d{14}|2(?:22[1-9]|2[3-9]\d|[3-6]\d\d|7[01]\d|720)\d{12}"
                  r"|3[47]\d{13}|3(?:0[0-5]|[68]\d)\d{11}|6(?:011|5\d\d|4[4-9]\d)\d{12}|62\d{14,17}|35\d{14})")  # fmt: skip

# Kinds with a layout of their own come before the looser ones, which must not reach into them.
FIRM = re.compile(
    r"(?<![0-9A-Za-z.@+-])(?:"
    r"(?P<date>[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9A-Za-z]|[./-][0-9])"
    r"|(?P<ssn>[0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9A-Za-z]|-[0-9])"
    r"|(?P<ip>[0-9]{1,3}(?:\.[0-9]{1,3}){3})(?![0-9A-Za-z]|\.[0-9])"
    r")"
)
PHONE = re.compile(
    r"\+[0-9]{1,3}[ .-]?\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9A-Za-z])|\+[0-9]{8,15}(?![0-9A-Za-z])"
)
# a plus sign and groups of digits, of which a phone number may be the first ones
PLUS = re.compile(r"(?<![0-9A-Za-z])\+[0-9]++(?:(?:[ .-]?\([0-9]{1,5}\)[ .-]?|[ .-])[0-9]++)*+")
IBAN = re.compile(
    r"(?<![0-9A-Za-z.@+-])(?P<iban>[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))"
)
RUN = re.compile(r"(?<![0-9A-Za-z.@+-])[0-9](?:[ -]?[0-9]){12,}+")  # groups of digits that may hold cards
NOT_AFTER = re.compile(r"[0-9A-Za-z]|\.[0-9]")  # what does not follow a card
MAIL = re.compile(r"(?<![A-Za-z0-9._%+-])(?P<local>[A-Za-z0-9._%+-]++)@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}(?![A-Za-z0-9-])")
FOUND = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())])
RESULT = pa.struct([("text", pa.string()), ("found", pa.list_(FOUND))])


class Permutation:
    """A keyed permutation of 0 .. size - 1 by a Feistel network and cycle walking."""

    def __init__(self, key: bytes, tweak: str, size: int):
        self.key, self.tweak, self.size = hashlib.sha256(key).digest(), tweak.encode(), size
        self.half = max(1, -(-max(1, (size - 1).bit_length()) // 2))

    def _round(self, number: int, value: int) -> int:
        message = b"%d|%s|%d|%d" % (number, self.tweak, self.size, value)
        digest = hashlib.blake2b(message, key=self.key, digest_size=max(8, -(-self.half // 8) + 8)).digest()
        return int.from_bytes(digest, "big") & ((1 << self.half) - 1)

    def _walk(self, value: int, order: range) -> int:
        mask = (1 << self.half) - 1
        while True:
            left, right = value >> self.half, value & mask
            for i in order:
                left, right = right, left ^ self._round(i, right)
            value = right << self.half | left
            if value < self.size:
                return value

    def forward(self, value: int) -> int:
        return self._walk(value, range(ROUNDS))

    def backward(self, value: int) -> int:
        return self._walk(value, range(ROUNDS - 1, -1, -1))

    def turn(self, value: int, step: int = 1) -> int:
        """The next number on the one cycle through all numbers; step -1 goes back."""
        return self.forward((self.backward(value) + step) % self.size)


def luhn(digits: str) -> bool:
    doubled = (int(d) * (2 if i % 2 else 1) for i, d in enumerate(reversed(digits)))
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def _with_check_digit(body: str) -> str:
    return next(body + d for d in "0123456789" if luhn(body + d))


def _mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def _refill(template: str, chars: str) -> str:
    """The template with its letters and digits replaced, one after the other."""
    left = iter(chars)
    return "".join(next(left) if c.isalnum() else c for c in template)


def _number(chars: str) -> tuple[int, int]:
    """(number, size) of a string among those with letters and digits in the same places."""
    value, size = 0, 1
    for c in chars:
        base, first = (10, "0") if c.isdigit() else (26, "A" if c.isupper() else "a")
        value, size = value * base + ord(c) - ord(first), size * base
    return value, size


def _chars(pattern: str, value: int) -> str:
    out = []
    for c in reversed(pattern):
        base, first = (10, "0") if c.isdigit() else (26, "A" if c.isupper() else "a")
        value, place = divmod(value, base)
        out.append(chr(ord(first) + place))
    return "".join(reversed(out))


def _shape(chars: str) -> str:
    return "".join("9" if c.isdigit() else "A" if c.isupper() else "a" for c in chars)


def _turn(key: bytes, kind: str, chars: str, valid, step: int) -> str:
    """The next string of the same shape that is valid."""
    value, size = _number(chars)
    if size < 2:
        return chars
    cycle = Permutation(key, f"{kind}:{_shape(chars)}", size)
    while True:
        value = cycle.turn(value, step)
        new = _chars(chars, value)
        if valid(new):
            return new


def _is_card(digits: str) -> bool:
    return CARD.fullmatch(digits) is not None and luhn(digits)


def _card(key, raw, step):
    digits = re.sub(r"[ -]", "", raw)
    if not _is_card(digits):
        return None
    valid = lambda body: CARD.fullmatch(_with_check_digit(digits[0] + body)) is not None
    body = _turn(key, f"card{digits[0]}", digits[1:-1], valid, step)
    return _refill(raw, _with_check_digit(digits[0] + body))


def _iban(key, raw, step):
    plain = raw.replace(" ", "")
    if not 15 <= len(plain) <= 34 or _mod97(plain) != 1:
        return None
    body = _turn(key, "iban" + plain[:2], plain[4:], lambda _: True, step)
    check = 98 - _mod97(plain[:2] + "00" + body)
    return _refill(raw, f"{plain[:2]}{check:02d}{body}")


def _ssn(key, raw, step):
    def valid(digits):
        return digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000"

    digits = raw.replace("-", "")
    return _refill(raw, _turn(key, "ssn", digits, valid, step)) if valid(digits) else None


def _ip(key, raw, step):
    octets = raw.split(".")
    if any(int(o) > 255 or o != str(int(o)) for o in octets):
        return None
    value = int.from_bytes(bytes(map(int, octets)), "big")
    return ".".join(map(str, Permutation(key, "ip", 1 << 32).turn(value, step).to_bytes(4, "big")))


def _phone(key, raw, step):
    country = re.match(r"\+[0-9]{1,3}?(?=[ .(-])|\+[0-9]", raw)[0]
    rest = raw[len(country) :]
    digits = re.sub(r"[^0-9]", "", rest)
    if not 8 <= len(digits) + len(country) - 1 <= 15 or len(digits) < 6:
        return None
    return country + _refill(rest, _turn(key, "phone" + country, digits, lambda _: True, step))


def _date(key, raw, step):
    notation = "%Y-%m-%d" if raw[4] == "-" else "%d.%m.%Y" if raw[2] == "." else "%m/%d/%Y"
    try:
        day = dt.datetime.strptime(raw, notation).date()
    except ValueError:
        return None
    first, last = next((a, b) for a, b in ERAS if a <= day.year < b)
    start = dt.date(first, 1, 1).toordinal()
    end = dt.date.max.toordinal() + 1 if last > 9999 else dt.date(last, 1, 1).toordinal()
    moved = Permutation(key, f"date{first}", end - start).turn(day.toordinal() - start, step)
    new = dt.date.fromordinal(start + moved)
    year = f"{new.year:04d}"
    return {"-": f"{year}-{new:%m-%d}", ".": f"{new:%d.%m}.{year}", "/": f"{new:%m/%d}/{year}"}[notation[2]]


def _mail(key, local, step):
    chars = "".join(c for c in local if c.isalnum())
    return _refill(local, _turn(key, "mail", chars, lambda _: True, step)) if chars else None


HANDLERS = {"card": _card, "iban": _iban, "ssn": _ssn, "ip": _ip, "phone": _phone, "date": _date}


@lru_cache(maxsize=100_000)
def _pseudonym(key: bytes, kind: str, raw: str, step: int) -> str | None:
    return (_mail if kind == "mail" else HANDLERS[kind])(key, raw, step)


def _firm(text, turned):
    for m in FIRM.finditer(text):
        if new := turned(m.lastgroup, m[0]):
            yield *m.span(), m.lastgroup, new


def _phones(text, turned):
    """The groups behind a plus sign that make up 8 to 15 digits: most of them, but rather not
    ending before a dot or hyphen, and rather with one separator. One dot alone is a decimal."""
    for run in PLUS.finditer(text):
        strict, windows, digits = PHONE.match(text, run.start()), [], 0
        for g in re.finditer("[0-9]+", run[0]):
            digits += g.end() - g.start()
            end = run.start() + g.end()
            between = re.sub("[0-9+]", "", text[run.start() : end])
            if digits > 15:
                break
            if digits >= 8 and between not in ("", ".") and not re.match(r"[0-9A-Za-z)]", text[end : end + 1]):
                cut = re.match("[.-][0-9]", text[end : end + 2]) is not None
                windows.append((cut, len(set(between)) > 1, -end))
        for end in [*([strict.end()] if strict else []), *(-w[2] for w in sorted(windows))]:
            if new := turned("phone", text[run.start() : end]):
                yield run.start(), end, "phone", new
                break


def _ibans(text, turned):
    """A match is tried up to each of its ends, longest first; a match without an IBAN is searched
    again from its next group."""
    at = 0
    while m := IBAN.search(text, at):
        start, raw = m.start("iban"), m["iban"]
        edges = [e.start() for e in re.finditer(" ", raw)]
        at = start + (edges[0] + 1 if edges else len(raw))
        for end in [len(raw), *reversed(edges)]:
            if new := turned("iban", raw[:end]):
                yield start, start + end, "iban", new
                at = start + end  # what follows in the same match is searched again
                break


def _cards(text, turned):
    """The neighbouring groups in a run of any length that make up a card: the longest first, then
    the first, none overlapping another."""
    for run in RUN.finditer(text):
        groups = [(run.start() + g.start(), run.start() + g.end()) for g in re.finditer("[0-9]+", run[0])]
        valid = []
        for i, (start, _) in enumerate(groups):
            digits = ""
            for a, end in groups[i : i + 19]:
                if len(digits) + end - a > 19:
                    break
                digits += text[a:end]
                if len(digits) >= 13 and not NOT_AFTER.match(text, end) and _is_card(digits):
                    valid.append((start, end))
        taken = set()
        for start, end in sorted(valid, key=lambda w: (w[0] - w[1], w[0])):
            if taken.isdisjoint(range(start, end)):
                taken.update(range(start, end))
                yield start, end, "card", turned("card", text[start:end])


FINDERS = (_firm, _phones, _ibans, _cards)


def _masked(text: str, hits: list) -> str:
    """The text with letters, which no number is found in, in place of what was found."""
    if not hits:
        return text
    parts, at = [], 0
    for start, _, end, *_ in sorted(hits):
        parts += [text[at:start], "x" * (end - start)]
        at = end
    return "".join([*parts, text[at:]])


def pseudonymise(text: str, key: bytes, step: int = 1) -> tuple[str, list[dict]]:
    """(new text, found): found has start, end (code points of the given text, end exclusive)
    and kind of each value; of a mail address the part before the @ is replaced. step -1
    restores what step 1 made."""
    hits = []
    if "@" in text:
        for m in MAIL.finditer(text):
            if new := _pseudonym(key, "mail", m["local"], step):
                hits.append((m.start("local"), m.end("local"), m.end(), "mail", new))
    for find in FINDERS:
        left = _masked(text, hits)
        hits += [(a, b, b, kind, new) for a, b, kind, new in find(left, lambda kind, raw: _pseudonym(key, kind, raw, step))]
    hits.sort()
    parts, at = [], 0
    for start, end, _, _, new in hits:
        parts += [text[at:start], new]
        at = end
    return "".join([*parts, text[at:]]), [{"start": a, "end": c, "kind": k} for a, _, c, k, _ in hits]


def pseudonyms(text: Column, key: bytes, step: int = 1) -> Column:
    """Struct (text, found) of a text. Texts without digit or @ never leave the JVM; their struct
    is null, as it is for null texts. found is empty where nothing was validated."""

    @F.arrow_udf("struct<text:string,found:array<struct<start:int,end:int,kind:string>>>")
    def replace(texts: pa.Array) -> pa.Array:
        news, founds = [], []
        for value in texts:
            raw = value.as_py()
            new, found = (None, None) if raw is None else pseudonymise(raw, key, step)
            news.append(new)
            founds.append(found)
        return pa.StructArray.from_arrays([pa.array(news, pa.string()), pa.array(founds, pa.list_(FOUND))], fields=list(RESULT))

    return replace(F.when(text.rlike("[0-9@]"), text))


def pseudonymise_documents(docs: DataFrame, key: bytes) -> DataFrame:
    """doc_id, text (with pseudonyms; null stays null), n_found and found of every row."""
    new = docs.select("doc_id", F.col("text").alias("raw"), pseudonyms(F.col("text"), key).alias("p"))
    found = F.coalesce("p.found", F.array().cast("array<struct<start:int,end:int,kind:string>>"))
    return new.select(
        "doc_id", F.coalesce("p.text", "raw").alias("text"), F.size(found).alias("n_found"), found.alias("found")
    )


def replace_in_documents(docs: DataFrame, key: bytes) -> DataFrame:
    """docs with pseudonyms in text and n_chars, where there is one, set to the new length.
    All rows and columns stay."""
    new = F.coalesce(pseudonyms(F.col("text"), key).getField("text"), F.col("text"))
    out = docs.withColumn("text", new)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out
