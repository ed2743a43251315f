"""Private data as format-preserving pseudonyms: keyed Feistel permutations within each value's format.

Found are e-mail addresses, payment cards (Luhn's check; 13 to 19 digits in one, or in groups of 4
with a shorter last one, 4-6-5, 4-6-4 or 4-3-3-3), IBANs (mod 97), phone numbers,
United States social security numbers (of areas and groups that are issued), IPv4 addresses, dates of two centuries
that exist, and credentials behind a name that ends in token, secret, password, passwd or key and an equals sign or
colon: at least 16 letters, digits and signs of tokens with a digit among them, of any length, or 8 characters with a
digit of a password. What doesn't validate stays. A value becomes one of the same format: digits give digits in their places, separators stay, check digits hold, a
date gives a date, letters give letters of their case and alphabet; accented Latin ones stay beside as many of ASCII. The permutation is one to one within a format and depends on the
key and the value alone, so that equal values stay linked across documents, however they are separated, and different
ones stay apart.

Numbers are split in two halves, of digits or of mixed radices whose product is the size of the domain, to which keyed
hashes of each other are added in turn. Everything is SQL expressions: a single pass without a shuffle, each text in one
task, values in arrays beside it. Whether a value is hot doesn't matter.

Defined cases: a null text stays null and has no values; an empty one stays empty; rows are independent, repeated or not;
null ids and extra columns are carried, those with a result's name under another one; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

ROUNDS = 8
#: For tests and the registered query; a deployment passes its own.
KEY = "kvlake-example-key"

_BEFORE, _AFTER = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}+@(?:[\p{L}\p{N}-]{1,63}+\.){1,8}\p{L}{2,24}"
_LABELLED = r"""["']?\s{0,2}[=:]{1,2}+>?\s{0,2}["']?"""
SECRET_LABEL = r"(?i:token|secret|password|passwd|key)" + _LABELLED
PASSWORD_LABEL = r"(?i:password|passwd)" + _LABELLED
#: A digit and 16 characters of these kinds, dots aside, which may be between others. Of a password, a digit and 8 characters
#: up to a blank, quote, comma or semicolon. Of any length: what is possessive is matched in a loop.
_KEYLIKE = "[0-9A-Za-z_+/=~-]"
SECRET = (
    rf"(?:{PASSWORD_LABEL}(?=[^\s0-9\"',;]*+[0-9])(?=[^\s\"',;]{{8}})(?:[^\s\"',;.!?)]++|[.!?)]++(?=[^\s\"',;.!?)]))++"
    rf"|{SECRET_LABEL}(?=[A-Za-z_+/=~.-]*+[0-9])(?=(?:\.*+{_KEYLIKE}){{16}}){_KEYLIKE}++(?:\.++{_KEYLIKE}++)*+)"
)
#: The longest that can be an IBAN, or a card below. Whether one is, and up to where, the check sum tells: see _checked.
IBAN = r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?" + _AFTER
#: Characters of an IBAN by country, from the registry.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_OF_ITS_COUNTRY = "^(?:" + "|".join(f"(?:{'|'.join(countries.split())})(?: ?[A-Z0-9]){{{n - 2}}}" for n, countries in IBAN_LENGTHS.items()) + ")$"
IP = r"(?<![\p{L}\p{N}.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?[\p{L}\p{N}])"
DATE = r"(?<![\p{L}\p{N}./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}-[0-9]{2}-[0-9]{4})(?:(?=T[0-9]{2}:?[0-9]{2})|(?![./-]?[\p{L}\p{N}]))"
SSN = r"(?<![\p{L}\p{N}-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{L}\p{N}]|-[0-9])"
_NANP = r"\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}"
_ABROAD = r"(?!1[ .(-])[0-9]{1,3}(?:[ .-]?(?!(?:[0-9]{1,3}\.){3}[0-9])\(?[0-9]{1,4}\)?){2,5}"
PHONE = rf"(?:(?<![\p{{L}}\p{{N}}+])\+(?:1[ .-]?{_NANP}|{_ABROAD})|(?<![\p{{L}}\p{{N}}(+-])(?:\([0-9]{{3}}\) ?|[0-9]{{3}}[ .-])[0-9]{{3}}[ .-][0-9]{{4}})(?![\p{{L}}\p{{N}}])"
CARD = r"(?:[0-9]{4}(?: [0-9]{4}){3}(?: [0-9]{1,3}(?![0-9]))?|[0-9]{4}(?:-[0-9]{4}){3}(?:-[0-9]{1,3}(?![0-9]))?|[3-6][0-9]{3}(?:(?: [0-9]{4}){2} [0-9]{1,3}|(?:-[0-9]{4}){2}-[0-9]{1,3}|(?: [0-9]{3}){3}|(?:-[0-9]{3}){3})|[0-9]{4} [0-9]{6} [0-9]{4,5}|[0-9]{4}-[0-9]{6}-[0-9]{4,5}|[0-9]{13,19})" + _AFTER
#: Numbers are looked for only where one can begin, e-mail addresses only in texts with an at sign. IBANs and cards are
#: what _checked finds in a text.
NUMBERS = "(?=[0-9+(])(?:" + "|".join(f"(?:{p})" for p in (IP, DATE, SSN, PHONE)) + ")"
#: For texts without IBANs and cards, which otherwise come before and behind the numbers.
WITHOUT_EMAIL = f"{SECRET}|{NUMBERS}"
WITH_EMAIL = f"{EMAIL}|{WITHOUT_EMAIL}"
#: Every value has one of these characters.
HINT = "[0-9@]"

#: Days from the first of 1900 to the second of January 2100, as a product for the two halves.
FIRST_DAY, DAYS = "1900-01-01", (319, 229)
#: Social security numbers: areas 001 to 899 without 666, groups 01 to 99, serials 0001 to 9999.
SSN_HALVES = (898 * 99, 9999)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _padded(x: Column, width: Column | int) -> Column:
    return F.lpad(x.cast("string"), width, "0")


def _keyed(key: str, tag: str, *parts: Column) -> Column:
    """A keyed hash as a number below 2**60."""
    text = F.concat_ws("|", F.lit(key), F.lit(tag), *(p.cast("string") for p in parts), F.lit(key))
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("bigint")


def _rounds(start: Column, step: Callable[[Column, Column], Column]) -> Column:
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def permuted_below(x: Column, halves: tuple[int, int], key: str, tag: str) -> Column:
    """A permutation of the numbers below the product of halves."""
    a, b = halves

    def step(acc: Column, i: Column) -> Column:
        even = i % 2 == 0
        low = (acc["low"] + _keyed(key, tag, i, acc["high"])) % b
        high = (acc["high"] + _keyed(key, tag, i, acc["low"])) % a
        return F.struct(F.when(even, acc["high"]).otherwise(high).alias("high"), F.when(even, low).otherwise(acc["low"]).alias("low"))

    start = F.struct(F.floor(x.cast("bigint") / b).cast("bigint").alias("high"), (x.cast("bigint") % b).alias("low"))
    end = _rounds(start, step)
    return end["high"] * b + end["low"]


def permuted_digits(x: Column, key: str, tag: str) -> Column:
    """A permutation of the strings of as many digits as x has, up to 36; a single digit stays."""
    n = F.length(x)
    left = F.floor(n / 2).cast("int")
    power = lambda d: F.rpad(F.lit("1"), d + 1, "0").cast("bigint")

    def step(acc: Column, i: Column) -> Column:
        even = i % 2 == 0
        low = (acc["low"] + _keyed(key, tag, i, n, acc["high"])) % power(n - left)
        high = (acc["high"] + _keyed(key, tag, i, n, acc["low"])) % power(left)
        return F.struct(F.when(even, acc["high"]).otherwise(high).alias("high"), F.when(even, low).otherwise(acc["low"]).alias("low"))

    start = F.struct(F.substring(x, F.lit(1), left).cast("bigint").alias("high"), F.substring(x, left + 1, n - left).cast("bigint").alias("low"))
    end = _rounds(start, step)
    return F.when(n < 2, x).otherwise(F.concat(_padded(end["high"], left), _padded(end["low"], n - left)))


#: Where accented Latin letters begin and end: they move among themselves.
_LATIN = ((0xC0, 0x24F), (0x1E00, 0x1EFF))
_ACCENTED = "[\\u00C0-\\u024F\\u1E00-\\u1EFF]"


@functools.cache
def _alphabets() -> tuple[str, str, str]:
    """Letters and numbers beyond ASCII: as SQL the runs of those of a kind (small, capital, other, digit ...), with first
    and last code point and a step of 2 where small and capital letters take turns; and as strings the letters without
    neighbours, accented Latin ones and others."""
    kinds: dict[tuple[str, int], list[int]] = {}
    for c in range(128, sys.maxunicode + 1):
        if (kind := unicodedata.category(chr(c)))[0] in "LN":
            block = next((i for i, (first, last) in enumerate(_LATIN) if first <= c <= last), -1)
            kinds.setdefault((kind, block), []).append(c)
    runs, alone = [], {True: "", False: ""}
    for (_, block), points in kinds.items():
        at = 0
        while at < len(points):
            step, end = points[at + 1] - points[at] if at + 1 < len(points) else 0, at
            while step in (1, 2) and end + 1 < len(points) and points[end + 1] - points[end] == step:
                end += 1
            if end > at:
                runs.append((points[at], points[end], step))
            else:
                alone[block >= 0] += chr(points[at])
            at = end + 1
    return f"arrays_zip({', '.join(f'array({", ".join(map(str, x))})' for x in zip(*runs, strict=True))})", alone[True], alone[False]


def _moved_beyond_ascii(c: Column, by: Column) -> Column:
    sql, *alone = _alphabets()
    at = F.ascii(c)
    run = F.filter(F.expr(sql), lambda r: at.between(r["0"], r["1"]) & ((at - r["0"]) % r["2"] == 0))
    place = lambda r: r["0"] + (F.floor((at - r["0"]) / r["2"]) + by) % (F.floor((r["1"] - r["0"]) / r["2"]) + 1) * r["2"]
    char = lambda r: F.decode(F.unhex(F.lpad(F.hex(place(r)), 8, "0")), "UTF-32")
    out = F.get(F.transform(run, char), F.lit(0))
    for letters in alone:
        i = F.instr(F.lit(letters), c)
        out = F.coalesce(out, F.when(i > 0, F.substring(F.lit(letters), ((i - 1 + by) % len(letters) + 1).cast("int"), F.lit(1))))
    return F.coalesce(out, c)


def _shifted(half: Column, other: Column, i: Column, accents_stay: Column, key: str, tag: str) -> Column:
    """half with each character moved within its kind by a keyed hash of other and its place."""

    # Of a long one a hash, made once, so that the work grows with the length alone.
    short = F.when(F.length(other) > 128, F.sha2(other, 256)).otherwise(other)

    def moved(c: Column, j: Column, other: Column, stay: Column) -> Column:
        by = _keyed(key, tag, i, j, other)
        place = lambda first, n: F.char((F.ascii(c) - first + by) % n + first)
        return F.when(c.rlike("[0-9]"), place(48, 10)).when(c.rlike("[a-z]"), place(97, 26)).when(c.rlike("[A-Z]"), place(65, 26)).when((F.ascii(c) < 128) | stay & c.rlike(_ACCENTED), c).otherwise(_moved_beyond_ascii(c, by))

    return F.when(F.length(half) == 0, half).otherwise(F.transform(F.array(F.struct(short.alias("other"), accents_stay.alias("stay"))), lambda x: F.array_join(F.transform(F.split(half, ""), lambda c, j: moved(c, j, x["other"], x["stay"])), ""))[0])


def permuted_text(x: Column, key: str, tag: str) -> Column:
    """A permutation of strings that keeps the kind of each character: digit, small or capital letter, letter of an
    alphabet, or itself. Accented Latin letters stay where no fewer letters and digits of ASCII are beside letters
    beyond it, which is the same for all strings that map to each other."""
    beyond = F.regexp_replace(x, r"[^\p{L}\p{N}]|[0-9A-Za-z]", "")
    ascii_kept = F.length(F.regexp_replace(x, "[^0-9A-Za-z]", "")) >= F.length(beyond)
    left = F.floor(F.length(x) / 2).cast("int")

    def step(acc: Column, i: Column) -> Column:
        even = i % 2 == 0
        low = _shifted(acc["low"], acc["high"], i, acc["stay"], key, tag)
        high = _shifted(acc["high"], acc["low"], i, acc["stay"], key, tag)
        return F.struct(F.when(even, acc["high"]).otherwise(high).alias("high"), F.when(even, low).otherwise(acc["low"]).alias("low"), acc["stay"].alias("stay"))

    start = F.struct(F.substring(x, F.lit(1), left).alias("high"), F.substring(x, left + 1, F.length(x) - left).alias("low"), ascii_kept.alias("stay"))
    end = _rounds(start, step)
    return F.concat(end["high"], end["low"])


def permuted_hex(x: Column, key: str, tag: str) -> Column:
    """A permutation of the strings of as many hexadecimal digits, through their bits: four at a time with a keyed sum of
    the other half. The case stays."""
    small = F.lower(x)
    left = F.floor(F.length(x) / 2).cast("int")
    digits = F.lit("0123456789abcdef")

    def moved(half: Column, other: Column, i: Column) -> Column:
        stream = F.concat(*(F.sha2(F.concat_ws("|", F.lit(key), F.lit(tag), i.cast("string"), F.lit(str(k)), other, F.lit(key)), 256) for k in range(2)))
        one = lambda c, j, stream: F.substring(digits, ((F.instr(digits, c) + F.instr(digits, F.substring(stream, (j % 128 + 1).cast("int"), F.lit(1))) - 2) % 16 + 1).cast("int"), F.lit(1))
        return F.transform(F.array(stream), lambda made: F.array_join(F.transform(F.split(half, ""), lambda c, j: one(c, j, made)), ""))[0]

    def step(acc: Column, i: Column) -> Column:
        even = i % 2 == 0
        return F.struct(
            F.when(even, acc["high"]).otherwise(moved(acc["high"], acc["low"], i)).alias("high"),
            F.when(even, moved(acc["low"], acc["high"], i)).otherwise(acc["low"]).alias("low"),
        )

    start = F.struct(F.substring(small, F.lit(1), left).alias("high"), F.substring(small, left + 1, F.length(x) - left).alias("low"))
    end = _rounds(start, step)
    out = F.concat(end["high"], end["low"])
    return F.when(x.rlike("[A-F]"), F.upper(out)).otherwise(out)


def _filled(form: Column, digits: Column) -> Column:
    """form with its digits replaced by digits, in order."""
    at = lambda c, j: F.when(
        c.rlike("[0-9]"), F.substring(digits, F.length(_digits(F.substring(form, F.lit(1), (j + 1).cast("int")))), F.lit(1))
    ).otherwise(c)
    return F.array_join(F.transform(F.split(form, ""), at), "")


def _luhn_sum(digits: Column, doubled_last: bool) -> Column:
    """Luhn's sum, where the last digit is doubled or not."""
    reverse = F.split(F.reverse(digits), "")

    def value(c: Column, j: Column) -> Column:
        d = c.cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(j % 2 == (0 if doubled_last else 1), twice).otherwise(d)

    return F.aggregate(F.transform(reverse, value), F.lit(0), lambda acc, d: acc + d)


def _card(m: Column, key: str) -> tuple[Column, Column]:
    d = _digits(m)
    body = permuted_digits(F.substring(d, F.lit(1), F.length(d) - 1), key, "card")
    check = (F.lit(10) - _luhn_sum(body, True) % 10) % 10
    valid = (_luhn_sum(d, False) % 10 == 0) & ~d.rlike("^0+$")
    return valid, _filled(m, F.concat(body, check.cast("string")))


def _mod97(rearranged: Column) -> Column:
    def step(acc: Column, c: Column) -> Column:
        digit = c.rlike("[0-9]")
        return F.when(digit, acc * 10 + c.cast("int")).otherwise(acc * 100 + F.ascii(c) - 55) % 97

    return F.aggregate(F.split(rearranged, ""), F.lit(0), step)


def _iban(m: Column, key: str) -> tuple[Column, Column]:
    plain = F.replace(m, F.lit(" "), F.lit(""))
    country, body = F.substring(plain, 1, 2), F.substring(plain, F.lit(5), F.length(plain) - 4)
    new_body = _filled(body, permuted_digits(_digits(body), key, "iban"))
    check = _padded(98 - _mod97(F.concat(new_body, country, F.lit("00"))), 2)
    valid = (_mod97(F.concat(body, F.substring(plain, 1, 4))) == 1) & (F.length(_digits(body)) >= 2)
    return valid, _filled(m, F.concat(check, _digits(new_body)))


def _checked(text: Column, begins: str, longest: str, check: Callable[[Column, str], tuple[Column, Column]], least: int, preferred: str) -> Column:
    """The values of text that satisfy a check sum, each once, longer ones before their beginnings; null if there is none.
    Candidates begin at any token and may overlap: what fails hides nothing behind it. Of each that part is taken which is
    as preferred, or else the longest that ends with a token."""
    found = F.regexp_extract_all(text, F.lit(f"(?={begins}){_BEFORE}(?=({longest}))."), F.lit(1))

    def part(m: Column) -> Column:
        last = lambda n: (n == F.length(m)) | F.substring(m, n, F.lit(2)).rlike("^[^ -][ -]$")
        ends = F.filter(F.sequence(F.length(m), F.lit(least), F.lit(-1)), last)
        parts = F.filter(F.transform(ends, lambda n: F.substring(m, F.lit(1), n)), lambda x: check(x, "")[0])
        return F.coalesce(F.get(F.filter(parts, lambda x: x.rlike(preferred)), F.lit(0)), F.get(parts, F.lit(0)))

    values = F.sort_array(F.array_distinct(F.filter(F.transform(found, part), lambda x: x.isNotNull())), asc=False)
    as_pattern = lambda x: F.when(F.size(x) > 0, F.concat(F.lit(f"(?={begins}){_BEFORE}(?:"), F.array_join(x, "|"), F.lit(f"){_AFTER}")))
    return F.when(text.rlike(begins), F.transform(F.array(values), as_pattern)[0])


def _ip(m: Column, key: str) -> tuple[Column, Column]:
    parts = F.transform(F.split(m, r"\."), lambda p: p.cast("int"))
    number = F.aggregate(parts, F.lit(0).cast("bigint"), lambda acc, p: acc * 256 + p)
    new = permuted_below(number, (65536, 65536), key, "ip")
    octet = lambda k: F.pmod(F.floor(new / (256**k)), F.lit(256)).cast("string")
    return F.forall(parts, lambda p: p < 256), F.concat_ws(".", *(octet(k) for k in (3, 2, 1, 0)))


def _date(m: Column, key: str) -> tuple[Column, Column]:
    """Year first, or day and month first: the day comes first if that is a date, as in most of the world, or the month."""
    d = _digits(m)
    part = lambda a, n: F.substring(d, a, n)
    made = lambda y, mo, da: F.try_to_date(F.concat_ws("-", y, mo, da), "yyyy-MM-dd")
    year_first = m.rlike("^[0-9]{4}[^0-9]")
    iso, day_first, month_first = made(part(1, 4), part(5, 2), part(7, 2)), made(part(5, 4), part(3, 2), part(1, 2)), made(part(5, 4), part(1, 2), part(3, 2))
    found = F.when(year_first, iso).otherwise(F.coalesce(day_first, month_first))
    number = F.date_diff(found, F.lit(FIRST_DAY).cast("date"))
    new = F.date_add(F.lit(FIRST_DAY).cast("date"), permuted_below(number, DAYS, key, "date").cast("int"))
    form = F.when(year_first, F.date_format(new, "yyyyMMdd")).when(day_first.isNotNull(), F.date_format(new, "ddMMyyyy")).otherwise(F.date_format(new, "MMddyyyy"))
    return found.isNotNull() & number.between(0, DAYS[0] * DAYS[1] - 1), _filled(m, form)


def _ssn(m: Column, key: str) -> tuple[Column, Column]:
    area, group, serial = (F.split(m, "-")[i].cast("int") for i in range(3))
    rank = F.when(area > 666, area - 2).otherwise(area - 1)
    new = permuted_below((rank * 99 + group - 1).cast("bigint") * 9999 + serial - 1, SSN_HALVES, key, "ssn")
    upper, new_serial = F.floor(new / 9999).cast("bigint"), new % 9999 + 1
    new_rank, new_group = F.floor(upper / 99).cast("bigint"), upper % 99 + 1
    new_area = F.when(new_rank >= 665, new_rank + 2).otherwise(new_rank + 1)
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    return valid, F.concat_ws("-", _padded(new_area, 3), _padded(new_group, 2), _padded(new_serial, 4))


#: Calling codes of countries, of which those of three digits are what the others leave.
_CALLING = "(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"


def _phone(m: Column, key: str) -> tuple[Column, Column]:
    country = F.regexp_extract(m, rf"^\+[0-9]{{1,3}}(?=[^0-9])|^\+{_CALLING}(?=(?:[^0-9]*[0-9]){{7}})|^\+", 0)
    rest = F.substring(m, F.length(country) + 1, F.length(m))
    d = _digits(rest)
    # Numbers abroad have groups of any size: what directly follows one may be taken as part of it, rather than leave both.
    return F.length(_digits(m)).between(8, 24) & (F.length(d) >= 7), F.concat(country, _filled(rest, permuted_digits(d, key, "phone")))


def _email(m: Column, key: str) -> tuple[Column, Column]:
    at = F.instr(m, "@")
    return m.rlike(r"^[^@]*[\p{L}\p{N}][^@]*@"), F.concat(permuted_text(F.substring(m, F.lit(1), at - 1), key, "email"), F.substring(m, at, F.length(m)))


def _secret(m: Column, key: str) -> tuple[Column, Column]:
    label = F.regexp_extract(m, "^" + SECRET_LABEL, 0)
    value = F.substring(m, F.length(label) + 1, F.length(m))
    is_hex = value.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")
    return F.lit(True), F.concat(label, F.when(is_hex, permuted_hex(value, key, "secret")).otherwise(permuted_text(value, key, "secret")))


_MAKE = {"email": _email, "iban": _iban, "ip": _ip, "date": _date, "ssn": _ssn, "phone": _phone, "card": _card, "secret": _secret}
#: How a found value shows its kind; what shows none is a credential.
_SHOWS = {
    "email": "^[^=:]*@", "ip": r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$", "date": r"^(?:[0-9]{4}[/-][0-9]{2}[/-][0-9]{2}|[0-9]{2}[/.-][0-9]{2}[/.-][0-9]{4})$",
    "ssn": r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$", "phone": r"^(?:\+[0-9() .-]+|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4})$",
    "iban": r"^[A-Z]{2}[0-9]{2}[A-Z0-9 ]{8,36}$", "card": r"^[0-9](?:[ -]?[0-9]){12,18}$",
}


def _treated(m: Column, key: str) -> Column:
    """kind (null if m doesn't validate) and pseudonym of a found value."""
    kind, new = None, None
    for name, shows in [*_SHOWS.items(), ("secret", "")]:
        valid, value = _MAKE[name](m, key)
        is_kind = m.rlike(shows)
        found, made = F.when(valid, F.lit(name)), F.when(valid, value).otherwise(m)
        kind = F.when(is_kind, found) if kind is None else kind.when(is_kind, found)
        new = F.when(is_kind, made) if new is None else new.when(is_kind, made)
    return F.struct(kind.alias("kind"), new.alias("new"))


def pseudonymised(documents: DataFrame, *, key: str = KEY, text_col: str = "text") -> DataFrame:
    """documents with pseudonyms in text_col and, behind it, n_private (values replaced) and private_kinds (of each)."""
    documents = common.spread(common.set_aside(documents, "n_private", "private_kinds"))
    text = F.col(f"`{text_col}`")
    rest = [F.col(f"`{c}`") for c in documents.columns]
    at_pattern, at_found, at_made = (common.unused(documents, c) for c in ("_pattern", "_found", "_made"))
    with_email = F.contains(text, F.lit("@"))
    at_ibans, at_cards = (common.unused(documents, c) for c in ("_ibans", "_cards"))
    ibans = _checked(text, "[A-Z]{2}[0-9]{2}[A-Z0-9 ]", IBAN, _iban, 12, _OF_ITS_COUNTRY)
    cards = _checked(text, "[0-9]{4}[0-9 -]", CARD, _card, 13, "^.*$")
    rows = documents.select(*rest, ibans.alias(at_ibans), cards.alias(at_cards))
    own = F.concat_ws("|", F.when(with_email, F.lit(EMAIL)), F.lit(SECRET), F.col(at_ibans), F.lit(NUMBERS), F.col(at_cards))
    rows = rows.select(*rest, F.when(F.coalesce(at_ibans, at_cards).isNotNull(), own).alias(at_pattern))
    pattern = F.col(at_pattern)

    def by_kind(take: Callable[[Column], Column]) -> Column:
        return F.when(pattern.isNotNull(), take(pattern)).when(with_email, take(F.lit(WITH_EMAIL))).when(text.rlike(HINT), take(F.lit(WITHOUT_EMAIL)))

    rows = rows.select(*rest, at_pattern, by_kind(lambda p: F.regexp_extract_all(text, p, F.lit(0))).alias(at_found))
    rows = rows.select(*rest, at_pattern, F.when(F.size(at_found) > 0, F.transform(at_found, lambda m: _treated(m, key))).alias(at_made))
    parts = by_kind(lambda p: F.split(text, p, -1))
    joined = F.concat(F.array_join(F.zip_with(F.slice(parts, F.lit(1), F.size(at_made)), at_made, lambda p, m: F.concat(p, m["new"])), ""), F.element_at(parts, -1))
    kinds = F.filter(F.transform(at_made, lambda m: m["kind"]), lambda k: k.isNotNull())
    new_text = F.when(F.col(at_made).isNotNull(), joined).otherwise(text)
    return rows.select(
        *(new_text.alias(c) if c == text_col else F.col(f"`{c}`") for c in documents.columns),
        F.coalesce(F.size(kinds), F.lit(0)).cast("bigint").alias("n_private"), F.coalesce(kinds, F.array().cast("array<string>")).alias("private_kinds"),
    )


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymised(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
