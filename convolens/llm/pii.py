"""PII: format-preserving Feistel pseudonyms, by column functions only.

Numbers and dates are looked for by pattern, checked (Luhn, mod 97, calendar, ranges), mapped to a pair
of residues (l, r) that counts exactly the valid values of their format, and permuted by an alternating
Feistel network: l gains a keyed hash of r, then r one of l, each modulo its own size. That is a
permutation of the valid values, so equal values get equal pseudonyms in every document, no two values
share one, and a pseudonym is valid again. What fails its check stays as it is.

kind   | valid                                   | permuted; kept
email  | letters, digits in the local part       | letters and digits; signs, the domain
iban   | mod 97                                  | digits behind the check digits; country, letters
card   | 13 to 19 digits, Luhn                   | digits between first and check digit; first digit
ssn    | 001-899 but 666, 01-99, 0001-9999       | all
ip     | four octets                             | all 32 bits
phone  | area and exchange from 200 on           | ten digits; country code
date   | 1900-01-01 to 2099-12-31                | the day; the order and width of its parts
"""

from __future__ import annotations

import hmac
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

KINDS = ("email", "iban", "card", "ssn", "ip", "phone", "date")
ROUNDS = 8

#: A local part begins at its run's first letter or digit, or where the match before it ended (with up to eight signs
#: between); other places of a run, which may be a megabyte without an at sign, aren't tried.
_FIRST = r"(?=[A-Za-z0-9])(?:(?<=\G[._%+-]{0,8})|(?<![A-Za-z0-9][._%+-]{0,8}))"
EMAIL = _FIRST + r"[A-Za-z0-9][A-Za-z0-9._%+-]*+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
CARD = r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:-[0-9]{4}){2,3}-[0-9]{1,4}|[0-9]{4}(?: [0-9]{4}){2,3} [0-9]{1,4}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
IP = r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"
PHONE = r"(?<![0-9])(?:\+?1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"
DATE = r"(?<![0-9/-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})(?![0-9/-])"
#: At one place the first that fits counts.
ANY = "|".join((EMAIL, IBAN, DATE, SSN, IP, PHONE, CARD))


def _hash(key: str, kind: str, step: Column, value: Column) -> Column:
    made = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), step.cast("string"), value.cast("string")), 256)
    return F.conv(F.substring(made, 1, 15), 16, 10).cast("long")


def feistel(key: str, kind: str, left: Column, right: Column, a: Column, b: Column) -> Column:
    """The permutation of pairs 0 <= l < a, 0 <= r < b; a struct of l and r. A null pair stays null."""

    def turn(s: Column, i: Column) -> Column:
        l, r = s["l"], s["r"]
        own = F.struct(((l + F.pmod(_hash(key, kind, i, r), a)) % a).alias("l"), r.alias("r"))
        other = F.struct(l.alias("l"), ((r + F.pmod(_hash(key, kind, i, l), b)) % b).alias("r"))
        return F.when(i % 2 == 0, own).otherwise(other)

    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def _chars(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def _padded(value: Column, width: Column) -> Column:
    return F.lpad(value.cast("string"), width, F.lit("0"))


def _ten(power: Column) -> Column:
    return F.rpad(F.lit("1"), power + 1, F.lit("0")).cast("long")


def _number(digits: Column) -> Column:
    return F.when(F.length(digits) > 0, digits).otherwise(F.lit("0")).cast("long")


def _permuted_digits(key: str, kind: str, digits: Column) -> Column:
    """Up to 36 digits, as two halves."""
    n = F.length(digits)
    half = F.floor(n / 2).cast("int")
    left, right = F.substring(digits, F.lit(1), half), F.substring(digits, half + 1, n - half)
    made = feistel(key, kind, _number(left), _number(right), _ten(half), _ten(n - half))
    return F.concat(F.when(half > 0, _padded(made["l"], half)).otherwise(F.lit("")), _padded(made["r"], n - half))


def _refilled(shape: Column, signs: Column, which: str) -> Column:
    """`shape` with its characters that match `which` replaced in order by those of `signs`."""
    start = F.struct(F.lit("").alias("s"), F.lit(1).alias("i"))

    def step(x: Column, c: Column) -> Column:
        own = F.struct(F.concat(x["s"], F.substring(signs, x["i"], F.lit(1))).alias("s"), (x["i"] + 1).alias("i"))
        return F.when(c.rlike(which), own).otherwise(F.struct(F.concat(x["s"], c).alias("s"), x["i"].alias("i")))

    return F.aggregate(_chars(shape), start, step)["s"]


def _luhn_sum(digits: Column) -> Column:
    """Of digits in front of a check digit: from the right every other digit counts twice."""

    def step(x: Column, c: Column) -> Column:
        d = c.cast("int") * F.when(x["odd"], 2).otherwise(1)
        return F.struct((x["t"] + F.when(d > 9, d - 9).otherwise(d)).alias("t"), (~x["odd"]).alias("odd"))

    return F.aggregate(_chars(F.reverse(digits)), F.struct(F.lit(0).alias("t"), F.lit(True).alias("odd")), step)["t"]


def _shorter(m: Column, make: Callable[[Column], Column]) -> Column:
    """`make` of the match, else of the match without its last group, what follows being put back; null if neither is valid."""
    lead = F.regexp_extract(m, "^(.*[A-Z0-9])[ -][A-Z0-9]+$", 1)
    return F.coalesce(make(m), F.when(F.length(lead) > 0, F.concat(make(lead), F.substring(m, F.length(lead) + 1, F.length(m)))))


def _card(key: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    n = F.length(digits)
    body, check = F.substring(digits, F.lit(1), n - 1), F.substring(digits, n, F.lit(1))
    made = F.concat(F.substring(digits, 1, 1), _permuted_digits(key, "card", F.substring(digits, F.lit(2), n - 2)))
    made = F.concat(made, F.pmod(-_luhn_sum(made), F.lit(10)).cast("string"))
    valid = n.between(13, 19) & (F.pmod(-_luhn_sum(body), F.lit(10)).cast("string") == check)
    return F.when(valid, _refilled(m, made, "[0-9]"))


def _mod97(text: Column) -> Column:
    """Of letters and digits, A being 10."""

    def step(x: Column, c: Column) -> Column:
        return F.when(c.rlike("[0-9]"), (x * 10 + c.try_cast("int")) % 97).otherwise((x * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(_chars(text), F.lit(0), step)


def _iban(key: str, m: Column) -> Column:
    plain = F.replace(m, F.lit(" "), F.lit(""))
    country, rest = F.substring(plain, 1, 2), F.substring(plain, F.lit(5), F.length(plain))
    digits = F.regexp_replace(rest, "[^0-9]", "")
    rest2 = _refilled(rest, _permuted_digits(key, "iban", digits), "[0-9]")
    check = F.lpad((98 - _mod97(F.concat(rest2, country, F.lit("00")))).cast("string"), 2, "0")
    valid = (_mod97(F.concat(rest, F.substring(plain, 1, 4))) == 1) & (F.length(digits) > 1) & F.length(plain).between(15, 34)
    return F.when(valid, _refilled(m, F.concat(country, check, rest2), "[A-Z0-9]"))


def _ssn(key: str, m: Column) -> Column:
    area, group, serial = (F.substring(m, p, n).cast("int") for p, n in ((1, 3), (5, 2), (8, 4)))
    place = area - 1 - (area > 666).cast("int")
    made = feistel(key, "ssn", place * 99 + group - 1, serial - 1, F.lit(898 * 99), F.lit(9999))
    at = F.floor(made["l"] / 99).cast("int")
    parts = (_padded(at + 1 + (at >= 665).cast("int"), F.lit(3)), _padded(made["l"] % 99 + 1, F.lit(2)), _padded(made["r"] + 1, F.lit(4)))
    return F.when(area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0), F.concat_ws("-", *parts))


def _ip(key: str, m: Column) -> Column:
    parts = F.split(m, "[.]")
    o = [parts[i].cast("int") for i in range(4)]
    made = feistel(key, "ip", o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536), F.lit(65536))
    out = [F.floor(made["l"] / 256), made["l"] % 256, F.floor(made["r"] / 256), made["r"] % 256]
    valid = (o[0] < 256) & (o[1] < 256) & (o[2] < 256) & (o[3] < 256)
    return F.when(valid, F.concat_ws(".", *(x.cast("string") for x in out)))


def _phone(key: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    code, own = F.substring(digits, F.lit(1), F.length(digits) - 10), F.right(digits, F.lit(10))
    area, exchange, line = (F.substring(own, p, n).cast("int") for p, n in ((1, 3), (4, 3), (7, 4)))
    made = feistel(key, "phone", (area - 200) * 800 + exchange - 200, line, F.lit(640_000), F.lit(10_000))
    ten = F.concat((F.floor(made["l"] / 800) + 200).cast("string"), (made["l"] % 800 + 200).cast("string"), _padded(made["r"], F.lit(4)))
    return F.when((area >= 200) & (exchange >= 200), _refilled(m, F.concat(code, ten), "[0-9]"))


def _date(key: str, m: Column) -> Column:
    iso = m.rlike("^[0-9]{4}-")
    p = F.split(m, "[-/.]")
    first, second = p[0], p[1]
    dotted = m.rlike("[.]")
    swap = ~iso & (dotted | (F.try_to_timestamp(F.concat_ws("-", p[2], _padded(first, F.lit(2)), _padded(second, F.lit(2))), F.lit("yyyy-MM-dd")).isNull()))
    month, day = F.when(swap, second).otherwise(first), F.when(swap, first).otherwise(second)
    text = F.when(iso, m).otherwise(F.concat_ws("-", F.element_at(p, -1), _padded(month, F.lit(2)), _padded(day, F.lit(2))))
    place = F.datediff(F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date"), F.lit("1900-01-01").cast("date"))
    made = feistel(key, "date", place % 17, F.floor(place / 17), F.lit(17), F.lit(4297))  # 17 * 4297 days: 200 years
    new = F.date_add(F.lit("1900-01-01").cast("date"), (made["r"] * 17 + made["l"]).cast("int"))
    short = (F.length(first) == 1) | (F.length(second) == 1)
    month2 = F.when(short, F.month(new).cast("string")).otherwise(_padded(F.month(new), F.lit(2)))
    day2 = F.when(short, F.day(new).cast("string")).otherwise(_padded(F.day(new), F.lit(2)))
    sign = F.when(dotted, ".").otherwise("/")
    shaped = F.when(swap, F.concat(day2, sign, month2, sign, F.year(new))).otherwise(F.concat(month2, sign, day2, sign, F.year(new)))
    return F.when((place >= 0) & (place < 17 * 4297), F.when(iso, F.date_format(new, "yyyy-MM-dd")).otherwise(shaped))


def _letters_value(letters: Column) -> Column:
    return F.aggregate(_chars(letters), F.lit(0).cast("long"), lambda x, c: x * 26 + F.ascii(c) - 97)


def _letters_of(value: Column, width: Column) -> Column:
    start = F.struct(F.lit("").alias("s"), value.alias("v"))

    def step(x: Column, _: Column) -> Column:
        return F.struct(F.concat(F.char((x["v"] % 26 + 97).cast("long")), x["s"]).alias("s"), F.floor(x["v"] / 26).cast("long").alias("v"))

    return F.when(width > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), width)), start, step)["s"]).otherwise(F.lit(""))


def _power26(n: Column) -> Column:
    return F.aggregate(F.array_repeat(F.lit(26).cast("long"), n), F.lit(1).cast("long"), lambda x, y: x * y)


def _permuted_letters(key: str, letters: Column) -> Column:
    """Up to 24 letters, as two halves."""
    k = F.length(letters)
    half = F.floor(k / 2).cast("int")
    left, right = F.substring(letters, F.lit(1), half), F.substring(letters, half + 1, k - half)
    made = feistel(key, "email", _letters_value(left), _letters_value(right), _power26(half), _power26(k - half))
    return F.concat(_letters_of(made["l"], half), _letters_of(made["r"], k - half))


def _rest(text: Column, size: int, make: Callable[[Column], Column]) -> Column:
    """What stands behind the first `size` characters, by blocks of that size; null if nothing does."""
    blocks = F.sequence(F.lit(1), F.floor((F.length(text) - 1) / size).cast("int"))
    return F.when(F.length(text) > size, F.array_join(F.transform(blocks, lambda i: make(F.substring(text, i * size + 1, F.lit(size)))), ""))


def _email(key: str, m: Column) -> Column:
    """Digits are the right half, letters the left one; with none or one digit half the letters each. What is longer is permuted by blocks."""
    local, domain = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
    all_letters, all_digits = F.lower(F.regexp_replace(local, "[^A-Za-z]", "")), F.regexp_replace(local, "[^0-9]", "")
    letters, digits = F.substring(all_letters, 1, 24), F.substring(all_digits, 1, 18)
    k, d = F.length(letters), F.length(digits)
    mixed = (d > 1) & k.between(1, 12)
    made = feistel(key, "email", _letters_value(letters), _number(digits), _power26(k), _ten(d))
    letters2 = F.when(mixed, _letters_of(made["l"], k)).when(k > 0, _permuted_letters(key, letters)).otherwise(F.lit(""))
    digits2 = F.when(mixed, _padded(made["r"], d)).when(d > 0, _permuted_digits(key, "email", digits)).otherwise(F.lit(""))
    letters2 = F.concat(letters2, F.coalesce(_rest(all_letters, 24, lambda x: _permuted_letters(key, x)), F.lit("")))
    digits2 = F.concat(digits2, F.coalesce(_rest(all_digits, 18, lambda x: _permuted_digits(key, "email", x)), F.lit("")))
    lower = _refilled(_refilled(local, letters2, "[A-Za-z]"), digits2, "[0-9]")
    cased = F.array_join(F.zip_with(_chars(local), _chars(lower), lambda a, b: F.when(a.rlike("[A-Z]"), F.upper(b)).otherwise(b)), "")
    return F.concat(cased, F.lit("@"), domain)


def _pseudonym(key: str, m: Column) -> Column:
    """A struct of kind and value; both null if no check holds."""
    out = None
    for kind, pattern, make in reversed(
        (("email", "@", _email), ("iban", "^[A-Z]{2}[0-9]{2}", lambda k, x: _shorter(x, lambda y: _iban(k, y))), ("date", f"^(?:{DATE})$", _date), ("ssn", f"^(?:{SSN})$", _ssn), ("ip", f"^(?:{IP})$", _ip), ("phone", f"^(?:{PHONE})$", _phone), ("card", "^[0-9]", lambda k, x: _shorter(x, lambda y: _card(k, y))))
    ):
        value = make(key, m)
        made = F.struct(F.when(value.isNotNull(), F.lit(kind)).alias("kind"), value.alias("value"))
        out = F.when(m.rlike(pattern), made) if out is None else F.when(m.rlike(pattern), made).otherwise(out)
    return out


def pseudonymize(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """`docs` with pseudonyms in its text, and a column n_<kind> (long) for each kind: how many were replaced.

    A null text stays null and counts nothing; texts without digits or an at sign aren't searched.
    Other columns are passed through; a new column whose name is taken gets a trailing underscore.
    """
    key = hmac.new(key.encode(), b"pseudonyms", "sha256").hexdigest()  # plans and logs show this, not the key
    text = F.col(text_col)
    found_col, made_col = fresh(docs, "found", "made")
    names = fresh(docs, *(f"n_{k}" for k in KINDS))
    found = F.when(text.rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(ANY), F.lit(0)))
    made = F.transform(found_col, lambda m: _pseudonym(key, m))
    parts = F.split(text, ANY, -1)
    values = F.zip_with(F.col(found_col), F.col(made_col), lambda m, p: F.coalesce(p["value"], m))
    new = F.array_join(F.zip_with(parts, values, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    counts = {n: F.coalesce(F.size(F.filter(made_col, lambda p: p["kind"] == k)), F.lit(0)).cast("long") for n, k in zip(names, KINDS)}  # noqa: B023
    marked = docs.withColumn(found_col, found).withColumn(made_col, made)
    counted = marked.withColumns({n: F.when(F.col(made_col).isNull(), F.lit(0).cast("long")).otherwise(c) for n, c in counts.items()})
    return counted.withColumn(text_col, F.when(F.size(found_col) > 0, new).otherwise(text)).drop(found_col, made_col)
