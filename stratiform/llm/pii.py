"""Personal data to format-preserving pseudonyms, by Spark SQL functions alone.

Numbers and dates are validated and permuted within their own format by a keyed Feistel
network, so a value has one pseudonym in every document, two valid values of one format never
share one, and the result is as valid as the original was: a card number passes its check digit,
a date is a date, an address has four octets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name

ROUNDS = 8

OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: What may be personal data, in the order in which it is tried at one place of a text.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}+(?:\.[A-Za-z0-9-]{1,63}+){1,8}",
    "ip": rf"(?<![\d.])(?:{OCTET}\.){{3}}{OCTET}(?!\d|\.\d)",
    "date": r"(?<![\d./-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?!\d|[./-]\d)",
    "ssn": r"(?<![\d-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?!\d|-\d)",
    "card": r"(?<![\d.])(?:\d{13,19}|\d{4}(?: \d{4}){3}|\d{4}(?:-\d{4}){3}|\d{4} \d{6} \d{5}|\d{4}-\d{6}-\d{5})(?!\d)",
    "phone": r"(?<![\w+])(?:(?:\+?1[ .-]?)?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}|\+1\d{10}"
    r"|\+[2-9]\d{0,2}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,5}(?:[ .-]\d{2,8}){1,3})(?![\w]|-\d)",
}
ANY = "|".join(PATTERNS.values())


def keyed(secret: str, kind: str, *parts: Column) -> Column:
    """Sixty bits of a keyed digest, as a long that is not negative."""
    text = F.concat_ws("|", F.lit(secret), F.lit(kind), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")


def feistel(left: Column, right: Column, a: Column, b: Column, secret: str, kind: str):
    """A keyed permutation of the pairs 0 <= left < a, 0 <= right < b.

    Rounds in turn add a keyed digest of one half to the other, modulo its size.  Each round
    can be undone, so the whole is a permutation whatever the sizes.  A fold keeps the
    expression small: written out, every round would double it.
    """
    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))

    def turn(s: Column, i: Column) -> Column:
        on_left = F.pmod(s["l"] + F.pmod(keyed(secret, kind, i, b, s["r"]), a), a)
        on_right = F.pmod(s["r"] + F.pmod(keyed(secret, kind, i, a, s["l"]), b), b)
        return F.when(
            i % 2 == 1, F.struct(on_left.alias("l"), s["r"].alias("r"))
        ).otherwise(F.struct(s["l"].alias("l"), on_right.alias("r")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn)


def with_value(value: Column, fn) -> Column:
    """``fn`` of a column that is computed once."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def padded(number: Column, width: Column) -> Column:
    return F.lpad(number.cast("string"), width, F.lit("0"))


def power(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, F.lit("0")).cast("long")


def permuted(digits: Column, secret: str, kind: str) -> Column:
    """Digits to as many digits, up to 36 of them."""

    def halves(d: Column) -> Column:
        n = F.length(d)
        h = F.floor(n / 2).cast("int")
        left = F.substring(d, F.lit(1), h).cast("long")
        right = F.substring(d, h + 1, n - h).cast("long")
        done = feistel(left, right, power(h), power(n - h), secret, kind)
        return with_value(done, lambda s: F.concat(padded(s["l"], h), padded(s["r"], n - h)))

    return with_value(digits, halves)


def refilled(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced by ``digits``, one by one."""
    place = F.sequence(F.lit(1), F.length(shape))

    def char(i: Column) -> Column:
        c = F.substring(shape, i, F.lit(1))
        at = F.length(digits_of(F.substring(shape, F.lit(1), i)))
        return F.when(c.between("0", "9"), F.substring(digits, at, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(place, char), "")


def luhn(digits: Column) -> Column:
    """The Luhn sum modulo 10, the last digit counting once."""
    n = F.length(digits)

    def weighed(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = (n - i) % 2 == 1
        return total + F.when(twice, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), weighed) % 10


def card(match: Column, secret: str) -> Column:
    """All digits but the last are permuted; the last is the check digit again."""

    def made(d: Column) -> Column:
        n = F.length(d)

        def checked(body: Column) -> Column:
            digit = F.pmod(10 - luhn(F.concat(body, F.lit("0"))), F.lit(10))
            return F.concat(body, digit.cast("string"))

        return with_value(permuted(F.substring(d, F.lit(1), n - 1), secret, "card"), checked)

    return with_value(
        digits_of(match), lambda d: F.when(luhn(d) == 0, refilled(match, made(d)))
    )


def ssn(match: Column, secret: str) -> Column:
    """Areas 001 to 899 without 666, groups 01 to 99 and serials 0001 to 9999."""

    def made(d: Column) -> Column:
        area = F.substring(d, 1, 3).cast("long")
        index = area - 1 - (area > 666).cast("long")
        left = index * 99 + F.substring(d, 4, 2).cast("long") - 1
        right = F.substring(d, 6, 4).cast("long") - 1
        done = feistel(left, right, F.lit(898 * 99), F.lit(9999), secret, "ssn")

        def shown(s: Column) -> Column:
            place = F.floor(s["l"] / 99)
            new = place + 1 + (place >= 665).cast("long")
            return F.concat(
                padded(new, F.lit(3)), F.lit("-"), padded(s["l"] % 99 + 1, F.lit(2)), F.lit("-"),
                padded(s["r"] + 1, F.lit(4)),
            )

        return with_value(done, shown)

    return with_value(digits_of(match), made)


def ip(match: Column, secret: str) -> Column:
    def made(o: Column) -> Column:
        part = lambda i: F.element_at(o, i).cast("long")
        size = F.lit(65536)
        done = feistel(part(1) * 256 + part(2), part(3) * 256 + part(4), size, size, secret, "ip")

        def shown(s: Column) -> Column:
            low = lambda c: F.pmod(c, F.lit(256)).cast("string")
            high = lambda c: F.floor(c / 256).cast("string")
            return F.concat_ws(".", high(s["l"]), low(s["l"]), high(s["r"]), low(s["r"]))

        return with_value(done, shown)

    return with_value(F.split(match, r"\."), made)


def phone(match: Column, secret: str) -> Column:
    """The country code stays.  A number of the North American plan stays one."""

    def made(d: Column) -> Column:
        code = F.regexp_extract(match, r"^\+?(1)(?=\D|\d{10}$)|^\+(\d{1,3})(?=[ .(-])", 0)
        n_code = F.length(digits_of(code))
        own = F.substring(d, n_code + 1, F.length(d) - n_code)

        def number(x: Column) -> Column:
            national = x.rlike(r"^[2-9]\d\d[2-9]\d{6}$")
            area, office = (F.substring(x, i, 3).cast("long") - 200 for i in (1, 4))
            done = feistel(area * 800 + office, F.substring(x, 7, 4), F.lit(640000), F.lit(10000),
                           secret, "phone")
            shown = with_value(
                done,
                lambda s: F.concat(
                    (F.floor(s["l"] / 800) + 200).cast("string"),
                    (s["l"] % 800 + 200).cast("string"), padded(s["r"], F.lit(4)),
                ),
            )
            return F.when(national, shown).otherwise(permuted(x, secret, "phone"))

        return F.concat(F.substring(d, F.lit(1), n_code), with_value(own, number))

    return with_value(digits_of(match), lambda d: refilled(match, made(d)))


#: Dates from 1600 to 2399, two whole cycles of the calendar: 292194 = 378 * 773 days.
FIRST_DAY, DAYS_A, DAYS_B = "1600-01-01", 378, 773


def date(match: Column, secret: str) -> Column:
    """A real day to another one, written alike; days with slashes have the month first if it
    can be one.  NULL if the digits are no day of the years 1600 to 2399."""

    def made(f: Column) -> Column:
        part = lambda i: F.element_at(f, i)
        iso = match.rlike("^\\d{4}-")
        slash = F.contains(match, F.lit("/"))
        month_first = slash & (part(1).cast("int") <= 12)
        short = match.rlike(r"^\d[/.]|[/.]\d[/.]")
        day_of = lambda y, m, d: F.try_to_date(
            F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd"
        )
        day = (
            F.when(iso, day_of(part(1), part(2), part(3)))
            .when(month_first, day_of(part(3), part(1), part(2)))
            .otherwise(day_of(part(3), part(2), part(1)))
        )
        index = F.datediff(day, F.lit(FIRST_DAY).cast("date")).cast("long")

        def shown(new: Column) -> Column:
            return (
                F.when(iso, F.date_format(new, "yyyy-MM-dd"))
                .when(month_first & short, F.date_format(new, "M/d/yyyy"))
                .when(month_first, F.date_format(new, "MM/dd/yyyy"))
                .when(slash & short, F.date_format(new, "d/M/yyyy"))
                .when(slash, F.date_format(new, "dd/MM/yyyy"))
                .when(short, F.date_format(new, "d.M.yyyy"))
                .otherwise(F.date_format(new, "dd.MM.yyyy"))
            )

        def moved(i: Column) -> Column:
            done = feistel(
                F.floor(i / DAYS_B), F.pmod(i, F.lit(DAYS_B)), F.lit(DAYS_A), F.lit(DAYS_B),
                secret, "date",
            )
            new = with_value(
                done, lambda s: F.date_add(F.lit(FIRST_DAY).cast("date"), (s["l"] * DAYS_B + s["r"]).cast("int"))
            )
            inside = i.isNotNull() & (i >= 0) & (i < DAYS_A * DAYS_B)
            return F.when(inside, with_value(new, shown))

        return with_value(index, moved)

    return with_value(F.split(match, "[-/.]"), made)


def email(match: Column, secret: str) -> Column:
    """Not a number: a keyed name at a keyed domain that cannot exist; case does not count."""
    whole = F.lower(match)
    hex_of = lambda c, n: F.substring(F.sha2(F.concat(F.lit(f"{secret}|mail|"), c), 256), 1, n)
    domain = F.substring_index(whole, "@", -1)
    return F.concat(F.lit("u"), hex_of(whole, 12), F.lit("@d"), hex_of(domain, 8), F.lit(".invalid"))


def replaced(match: Column, secret: str) -> Column:
    """(kind, pseudonym) of what one of the patterns found; both NULL if it is not valid."""
    only = lambda kind: match.rlike(f"^(?:{PATTERNS[kind]})$")
    makers = {"email": email, "ip": ip, "date": date, "ssn": ssn, "card": card, "phone": phone}
    kind = new = None
    for name, make in makers.items():
        test = F.contains(match, F.lit("@")) if name == "email" else only(name)
        kind = F.when(test, name) if kind is None else kind.when(test, name)
        new = F.when(test, make(match, secret)) if new is None else new.when(test, make(match, secret))
    found = F.struct(kind.alias("kind"), new.alias("pseudonym"))
    return with_value(
        found,
        lambda f: F.struct(
            F.when(f["pseudonym"].isNotNull(), f["kind"]).alias("kind"),
            f["pseudonym"].alias("pseudonym"),
        ),
    )


def pseudonymise(
    docs: DataFrame, secret: str, *, text: str = "text", found_as: str = "pii"
) -> DataFrame:
    """Replace personal data in whole texts; add ``pii``, the kinds and pseudonyms in order.

    Finds e-mail addresses, IPv4 addresses, dates, social security numbers, card numbers
    (only if the check digit is right) and phone numbers.  The texts are cut at what the
    patterns find and joined again around the pseudonyms: SQL functions on each row, no
    shuffle, no Python.  Rows without a digit or an @ pass after one scan of the text.

    ``secret`` keys the permutation.  It is a literal of the plan, so keep plans and event
    logs as safe as the key.

    Defined results: a NULL text stays NULL and has NULL ``pii``; an empty text and one
    without personal data stay as they are with an empty ``pii``; rows that repeat and extra
    columns are untouched, but for a column ``found_as`` of ``docs``, which is replaced;
    numbers that fail validation and dates outside 1600 to 2399 stay; an empty table stays empty.
    """
    nothing = "array<struct<kind:string,pseudonym:string>>"
    may = F.col(text).rlike("[0-9@]")
    matches = F.regexp_extract_all(text, F.lit(ANY), F.lit(0))
    found = F.transform(
        matches,
        lambda m: with_value(
            replaced(m, secret),
            lambda r: F.struct(r["kind"].alias("kind"), F.coalesce(r["pseudonym"], m).alias("shown")),
        ),
    )
    gaps = F.split(text, ANY, -1)

    def rebuilt(all_found: Column) -> Column:
        shown = F.transform(all_found, lambda f: f["shown"])
        joined = F.array_join(
            F.zip_with(gaps, shown, lambda g, s: F.concat(g, F.coalesce(s, F.lit("")))), ""
        )
        real = F.filter(all_found, lambda f: f["kind"].isNotNull())
        kinds = F.transform(
            real, lambda f: F.struct(f["kind"].alias("kind"), f["shown"].alias("pseudonym"))
        )
        return F.struct(joined.alias("text"), kinds.alias("pii"))

    changed = F.when(may, with_value(found, rebuilt))
    none = F.when(F.col(text).isNotNull(), F.array().cast(nothing))
    keep = [c for c in docs.columns if c != found_as]
    own = free_name(keep, "__pii")
    out = docs.select(*keep, changed.alias(own))
    kept = [F.coalesce(f"{own}.text", c).alias(c) if c == text else F.col(c) for c in keep]
    return out.select(*kept, F.coalesce(f"{own}.pii", none).alias(found_as))
