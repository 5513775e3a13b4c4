"""Format-preserving pseudonyms for personal data, in DataFrame functions alone.

Each kind of value is found by a pattern, validated, read as a number below a*b and permuted
by a keyed Feistel network on Z_a x Z_b: every round adds a keyed hash of one half to the
other, so the whole is a bijection on the valid values of that format. Equal values have
equal pseudonyms in all documents, whatever their separators, and different ones different pseudonyms. Digits stay where digits were: a date's
fields keep their widths, and a date keeps the order in which its fields are read. Dates of 1900 to 2099 stay in these years, other
dates of the years 1 to 9999 stay outside them. International numbers (+ and 8 to 15 digits) keep their country code
and are permuted with those of the same code and length; a "(0)" in one isn't dialled and stays. E-mail addresses, which are no
numbers, get a keyed hash of the address in the shape of one.

Null text stays null with zero counts; empty text and text without values is unchanged. Values that fail
validation (a card whose check digit is wrong, 31 February) are left as they are. A value that fits two kinds (a tie) is
of the one listed first. Texts of any length are rewritten whole; repeated
rows alike. Columns other than the text pass through, whatever their names. No shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import let, table

ROUNDS = 10
#: Dates of these years are permuted by themselves: 73,049 = 17 * 4297 days.
FIRST_DAY, DAYS = "1900-01-01", (17, 4297)
#: So are all others: days before FIRST_DAY, and all days of the years 1 to 9999.
BEFORE, ALL_DAYS = 693_595, 3_652_059
_DATE = r"\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4}"
#: What may stand between two digits of an international number, and what a + may precede without making it one.
_GAP = r"(?:[ .-]?\(0\)[ .-]?|[ .-]?\(|\)[ .-]?|[ ./-])?"
_NO_PHONE = rf"(?:(?:\d{{1,3}}\.){{3}}\d{{1,3}}|{_DATE}|\d{{3}}-\d{{2}}-\d{{4}}|\d{{4}}[ -]\d{{4}}[ -]\d{{4}}[ -]\d{{4}}|\d{{4}}[ -]\d{{6}}[ -]\d{{5}})(?![0-9A-Za-z]|[./-]\d)"
# Country codes of one and two digits; all others have three.
_CODES = r"^(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
# The kinds in the order in which they are tried at a place.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.)+[A-Za-z]{2,24}",
    "ip": r"(?:\d{1,3}\.){3}\d{1,3}(?![0-9A-Za-z]|\.\d)",
    "date": rf"(?:{_DATE})(?![0-9A-Za-z])",
    "ssn": r"\d{3}-\d{2}-\d{4}(?![0-9A-Za-z])",
    "phone": r"(?:\+1[ .-]?(?:\(\d{3}\) ?|\d{3}[ .-]?)\d{3}[ .-]?\d{4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|(?:1[ .-])?[2-9]\d{2}[ .-][2-9]\d{2}[ .-]\d{4})(?![0-9A-Za-z])",
    "international": rf"\+(?!{_NO_PHONE})(?:[1-9]\d{{7,14}}(?![0-9A-Za-z])|[1-9](?:{_GAP}\d){{7,14}}(?<=\d\d)(?![0-9A-Za-z]))",
    "card": r"(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4}|\d{4}([ -])\d{6}\2\d{5})(?![0-9A-Za-z])",
}
#: Text without a match of this has no value of any kind.
MAYBE = r"@|[0-9][-0-9. ()/]{5,}[0-9]"


def _any_pattern() -> str:
    """One pattern for all kinds; the card's comes last, as its back-references count groups from the start."""
    numbers = "|".join(PATTERNS[k] for k in PATTERNS if k not in ("email", "card"))
    return rf"(?<![0-9A-Za-z])(?=[(+0-9])(?:{numbers}|{PATTERNS['card']})|(?<![0-9A-Za-z._%+-]){PATTERNS['email']}"


def keyed(key: str, tweak: Column | str, *parts: Column) -> Column:
    """A keyed hash as a non-negative long of 52 bits."""
    tweak = F.lit(tweak) if isinstance(tweak, str) else tweak
    inner = F.sha2(F.concat_ws("|", F.lit(key), tweak, *(p.cast("string") for p in parts)), 256)
    return F.conv(F.substring(F.sha2(F.concat(F.lit(key), inner), 256), 1, 13), 16, 10).cast("long")


def _div(x: Column, y: Column | int) -> Column:
    """Whole-number division of longs."""
    return F.call_function("div", x, F.lit(y).cast("long") if isinstance(y, int) else y)


def feistel(x: Column, a: Column, b: Column, key: str, tweak: Column | str, rounds: int = ROUNDS) -> Column:
    """A keyed permutation of the longs from 0 to a*b - 1."""

    def step(acc: Column, i: Column) -> Column:
        even = i % 2 == 0
        left = F.when(even, (acc["l"] + keyed(key, tweak, i, acc["r"]) % a) % a).otherwise(acc["l"])
        right = F.when(even, acc["r"]).otherwise((acc["r"] + keyed(key, tweak, i, acc["l"]) % b) % b)
        return F.struct(left.alias("l"), right.alias("r"))

    start = F.struct(_div(x, b).alias("l"), (x % b).alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), start, step, lambda acc: acc["l"] * b + acc["r"])


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum modulo 10 of a string of digits that ends in its check digit."""
    return let(digits, _luhn_sum)


def _luhn_sum(digits: Column) -> Column:
    n = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1)
        return acc + d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10


def refill(m: Column, digits: Column) -> Column:
    """m with its digits replaced, in order, by the given ones."""
    return let(digits, lambda d: _refill(m, d))


def _refill(m: Column, digits: Column) -> Column:
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("i"))

    def step(acc: Column, c: Column) -> Column:
        digit = c.rlike("^[0-9]$")
        return F.struct(F.concat(acc["out"], F.when(digit, F.substring(digits, acc["i"], F.lit(1))).otherwise(c)).alias("out"), (acc["i"] + digit.cast("int")).alias("i"))

    return F.aggregate(F.split(m, ""), start, step, lambda acc: acc["out"])


def _long(text: Column) -> Column:
    return F.expr("0L") + F.coalesce(text.try_cast("long"), F.lit(0))


def _pad(x: Column, n: Column | int) -> Column:
    return F.lpad(x.cast("string"), n, "0")


def _email(m: Column, key: str) -> Column:
    return F.concat(F.lit("u"), F.substring(F.sha2(F.concat(F.lit(f"{key}|email|"), F.lower(m)), 256), 1, 12), F.lit("@"), F.substring(F.sha2(F.concat(F.lit(f"{key}|host|"), F.lower(F.substring_index(m, "@", -1))), 256), 1, 8), F.lit(".example"))


def _ip(m: Column, key: str) -> Column:
    parts = F.transform(F.split(m, r"\."), lambda p: p.cast("long"))
    x = F.aggregate(parts, F.expr("0L"), lambda acc, p: acc * 256 + p)

    def shown(y: Column) -> Column:
        return F.concat_ws(".", *((F.shiftrightunsigned(y, 8 * k) % 256).cast("string") for k in (3, 2, 1, 0)))

    return F.when(F.forall(parts, lambda p: p <= 255), let(feistel(x, F.expr("65536L"), F.expr("65536L"), key, "ip"), shown))


def _ssn(m: Column, key: str) -> Column:
    area, group, serial = (_long(F.substring(m, i, n)) for i, n in ((1, 3), (5, 2), (8, 4)))
    valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    row = area - 1 - F.when(area > 666, 1).otherwise(0)

    def shown(y: Column) -> Column:
        r = _div(y, 99 * 9999)
        return F.concat_ws("-", _pad(r + 1 + F.when(r >= 665, 1).otherwise(0), 3), _pad(_div(y, 9999) % 99 + 1, 2), _pad(y % 9999 + 1, 4))

    y = feistel((row * 99 + group - 1) * 9999 + serial - 1, F.lit(898 * 99).cast("long"), F.lit(9999).cast("long"), key, "ssn")
    return F.when(valid, let(y, shown))


def _phone(m: Column, key: str) -> Column:
    """Three classes of ten digits, each permuted by itself: area codes below 200, exchanges below 200, and the numbers that can be assigned."""
    digits = _digits(m)
    ten = F.substring(digits, F.length(digits) - 9, F.lit(10))
    half = lambda n: F.lit(n).cast("long")

    def permuted(t: Column) -> Column:
        area, exchange, line = (_long(F.substring(t, i, n)) for i, n in ((1, 3), (4, 3), (7, 4)))
        shown = lambda low: lambda y: F.concat(_pad(_div(y, (1000 - low if low else 200) * 10000) + 200, 3), _pad(_div(y, 10000) % (1000 - low if low else 200) + low, 3), _pad(y % 10000, 4))
        unused = _pad(feistel(_long(t), half(40_000), half(50_000), key, "phone-area"), 10)
        special = let(feistel(((area - 200) * 200 + exchange) * 10000 + line, half(32_000), half(50_000), key, "phone-exchange"), shown(0))
        assigned = let(feistel(((area - 200) * 800 + exchange - 200) * 10000 + line, half(80_000), half(80_000), key, "phone"), shown(200))
        return F.when(area < 200, unused).when(exchange < 200, special).otherwise(assigned)

    return refill(m, F.concat(F.substring(digits, F.lit(1), F.length(digits) - 10), let(ten, permuted)))


def _permuted_digits(digits: Column, key: str, tweak: str | Column) -> Column:
    """A string of at most 18 digits for another of the same length; each length, and each tweak, is permuted by itself."""
    n = F.length(digits)
    power = lambda k: F.rpad(F.lit("1"), (k + 1).cast("int"), "0").cast("long")
    low = F.floor(n / 2).cast("int")
    tweak = F.lit(tweak) if isinstance(tweak, str) else tweak
    return _pad(feistel(_long(digits), power(n - low), power(low), key, F.concat(tweak, n.cast("string"))), n)


def _international(m: Column, key: str) -> Column:
    """Country code kept, the rest permuted; a North American number of the usual length is the one that ``phone`` takes it for."""
    plain = F.replace(m, F.lit("(0)"), F.lit("(\x01)"))  # digits of a value, without the 0 that isn't dialled

    def new(digits: Column) -> Column:
        code = F.regexp_extract(digits, _CODES, 0)
        rest = F.substring(digits, F.length(code) + 1, F.length(digits) - F.length(code))
        other = refill(plain, F.concat(code, _permuted_digits(rest, key, F.concat(F.lit("international"), code, F.lit("/")))))
        return F.replace(F.when(digits.rlike("^1[0-9]{10}$"), _phone(plain, key)).otherwise(other), F.lit("\x01"), F.lit("0"))

    return let(_digits(plain), new)


def _card(m: Column, key: str) -> Column:
    digits = _digits(m)
    inner = F.substring(digits, F.lit(2), F.length(digits) - 2)
    body = F.concat(F.substring(digits, 1, 1), _permuted_digits(inner, key, "card"))
    checked = let(body, lambda x: F.concat(x, ((10 - luhn_sum(F.concat(x, F.lit("0")))) % 10).cast("string")))
    return F.when((luhn_sum(digits) == 0) & digits.rlike("^[1-9]"), refill(m, checked))


def _date(m: Column, key: str) -> Column:
    """ISO; with dots the day first; with slashes the month first unless only the other order is a date.

    The day's number is permuted, again and again until the new date can be written with the same
    widths of month and day and is read in the same order. Walking a permutation's cycle in this way is a
    permutation of the dates so written; the WALK steps are more than any of them is known to take.
    """
    p = F.split(m, "[./-]")
    return let(F.struct(F.when(m.rlike("^[0-9]{4}-"), "iso").when(m.contains("."), "dots").otherwise("slashes").alias("form"), p.alias("p")), lambda x: _walked(x["form"], x["p"], key))


#: Steps of a walk; each ends it with a chance of over a fifth, so that one in 10**30 dates would need more.
WALK = 300


def _walked(form: Column, p: Column, key: str) -> Column:
    at = lambda i: F.element_at(p, i).cast("int")
    day = lambda y, mo, d: F.try_to_date(F.concat_ws("-", _pad(y, 4), _pad(mo, 2), _pad(d, 2)), "yyyy-MM-dd")
    first = F.when(form == "iso", day(at(1), at(2), at(3))).when(form == "dots", day(at(3), at(2), at(1))).otherwise(day(at(3), at(1), at(2)))
    second = F.when(form == "slashes", day(at(3), at(2), at(1)))
    a, b = DAYS
    near, far = a * b, ALL_DAYS - a * b
    side = isqrt(far - 1) + 1
    start, origin = F.lit(FIRST_DAY).cast("date"), F.lit("0001-01-01").cast("date")
    after = lambda date, y: F.date_add(date, y.cast("int"))
    wide = lambda v, field: (F.length(field) == 2) | (v < 10)

    def new(read: Column) -> Column:
        swapped, real = read["swapped"], read["real"]
        day_field = F.when(form == "iso", F.element_at(p, 3)).when((form == "dots") | swapped, F.element_at(p, 1)).otherwise(F.element_at(p, 2))
        month_field = F.when((form == "iso") | (form == "dots") | swapped, F.element_at(p, 2)).otherwise(F.element_at(p, 1))

        def walk(x: Column) -> Column:
            inside = (x >= 0) & (x < near)

            def dated(y: Column) -> Column:
                return F.when(inside, after(start, y)).when(y < BEFORE, after(origin, y)).when(y < far, after(origin, y + near))

            def fits(y: Column) -> Column:
                ok = lambda date: wide(F.month(date), month_field) & wide(F.dayofmonth(date), day_field) & (~swapped | (F.dayofmonth(date) > 12))
                return F.coalesce(let(dated(y), ok), F.lit(False))

            size = lambda v, w: F.when(inside, v).otherwise(w).cast("long")
            tweak = F.when(inside, "date").otherwise("other date")

            def step(acc: Column, _: Column) -> Column:
                return F.when(acc["done"], acc).otherwise(let(feistel(acc["y"], size(a, side), size(b, side), key, tweak), lambda y: F.struct(y.alias("y"), fits(y).alias("done"))))

            y = F.when(inside, x).when(x < 0, x + BEFORE).otherwise(x + BEFORE - near)
            walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), F.struct(y.alias("y"), F.lit(False).alias("done")), step)
            return let(walked, lambda end: F.struct(dated(end["y"]).alias("date"), end["done"].alias("done")))

        def shown(end: Column) -> Column:
            date = end["date"]
            d, mo, y = _pad(F.dayofmonth(date), F.length(day_field)), _pad(F.month(date), F.length(month_field)), _pad(F.year(date), 4)
            text = F.when(form == "iso", F.concat_ws("-", y, mo, d)).when(form == "dots", F.concat_ws(".", d, mo, y)).when(swapped, F.concat_ws("/", d, mo, y)).otherwise(F.concat_ws("/", mo, d, y))
            return F.when(end["done"], text)

        return F.when(real >= origin, let(let(F.datediff(real, start).cast("long"), walk), shown))

    return let(F.struct(F.coalesce(first, second).alias("real"), (first.isNull() & second.isNotNull()).alias("swapped")), new)


_MAKERS = {"email": _email, "ip": _ip, "date": _date, "ssn": _ssn, "phone": _phone, "international": _international, "card": _card}


def _made(kind: str, m: Column) -> Callable[[Column], Column]:
    return lambda x: F.struct(F.when(x.isNotNull(), F.lit(kind)).alias("kind"), F.coalesce(x, m).alias("new"))


def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """docs with ``text`` rewritten and a column ``pii_kinds``: the kinds of the values replaced, in order of place.

    key is the secret; whoever holds it can undo the permutations.
    """
    pattern = _any_pattern()

    def replaced(m: Column) -> Column:
        out = F.struct(F.lit(None).cast("string").alias("kind"), m.alias("new"))
        for kind in reversed(_MAKERS):
            new = _MAKERS[kind](m, key)
            made = let(new, _made(kind, m))
            out = F.when(m.rlike(rf"^(?:{PATTERNS[kind]})$"), made).otherwise(out)
        return out

    t, none = F.col(f"`{text}`").cast("string"), F.array().cast("array<string>")

    def rewritten(found: Column) -> Column:
        def put(new: Column) -> Column:
            pieces = F.zip_with(F.split(t, pattern, -1), new, lambda gap, x: F.concat(gap, F.coalesce(x["new"], F.lit(""))))
            return F.struct(F.array_join(pieces, "").alias("text"), F.filter(F.transform(new, lambda x: x["kind"]), lambda k: k.isNotNull()).alias("kinds"))

        return F.when(F.size(found) > 0, let(F.transform(found, replaced), put))

    done = F.coalesce(F.when(t.rlike(MAYBE), let(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), rewritten)), F.struct(t.alias("text"), none.alias("kinds")))
    out = docs.withColumn("pii_kinds", done)
    return out.select(*(F.col("pii_kinds.text").alias(text) if c == text else F.col(f"`{c}`") for c in docs.columns if c != "pii_kinds"), F.col("pii_kinds.kinds").alias("pii_kinds"))


def op7_pseudonyms(spark, sf_dir: str, key: str = "set-your-own-key") -> DataFrame:
    docs = pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), key)
    count = lambda kind: F.size(F.filter("pii_kinds", lambda k: k == kind)).cast("long").alias(f"n_{kind}")
    return docs.select("doc_id", "text", *(count(kind) for kind in _MAKERS))
