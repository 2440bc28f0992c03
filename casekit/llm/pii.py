"""Format-preserving Feistel pseudonyms, with DataFrame functions only.

A text is split at everything that may be personal: the parts between are kept, each match is checked and, if it
is valid, permuted by a keyed Feistel network within its own format. A permutation has no two values with one
pseudonym, and equal values get equal pseudonyms in every document, so links survive. Nothing is shuffled.

* cards (13 to 19 digits, Luhn): all digits but the last are permuted, the last is the new check digit; a run of
  digits that is none as a whole may hold cards in their usual groups, beside other numbers;
* IBANs (mod 97): digits and letters after the check digits are permuted within their kind, then checked anew;
* US social security numbers (valid area, group and serial): permuted within the valid ones;
* telephone numbers (international, North American with separators, national with a leading 0 and spaces, or ten
  digits after a word such as `phone`): all digits after the country code or the leading 0;
* IPv4 addresses: permuted within the 32-bit numbers; IPv6 addresses (global, link-local or unique local): all but
  the first group, written in full, so that equal addresses stay equal in any spelling; MAC addresses;
* dates (real calendar days, year first, day and month by sign or name order, or with the month's name in English,
  German, French or Spanish): permuted within the 400-year calendar cycle 1800 to 2199, so equal days stay equal
  in any format;
* e-mail addresses: every letter and digit within its kind before the top-level domain;
* secrets (what is given to a key, token, secret or password: eight signs or more, and without quotes at least one
  of them a digit) and tokens known by their beginning: every letter and digit within its kind.

What looks alike but is not valid stays as it is. No pattern repeats a group without bound except possessively,
and each value is permuted in time linear in its length, so no text, however long or odd, brings a task down.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
CYCLE_START = "1800-01-01"
CYCLE_DAYS = (189, 773)  # their product is the days of 400 years
SSN_SIZES = (898, 99 * 9999)

SECRET_WORD = r"(?i:token|secret|password|passwd|api[_-]?key|access[_-]?key)"
# What may follow a card after a space without being a part of it: numbers of the other kinds.
OTHER_NUMBER = (
    r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])|[0-9]{1,4}[-/.][0-9]{1,2}[-/.][0-9]{1,4}(?![0-9])"
    r"|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9])|(?:[0-9]{1,3}\.){3}[0-9]"
)
# Usual groups of card numbers: none, four of 4 digits and perhaps a rest, or 4, 6 and 4 or 5.
CARD_GROUPS = r"^[ -]?(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}(?:[ -][0-9]{1,3})?|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5})$"
CARD_SIZES = (4, 5, 3, 1)

DIGIT_RUN = "^[0-9](?:[ -]?[0-9]){12,}+$"
SECRET_SIGNS = "[A-Za-z0-9+/_=.~-]"
# Names of the months, by language, and their English short forms.
MONTHS = (
    "January February March April May June July August September October November December",
    "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec",
    "Januar Februar März April Mai Juni Juli August September Oktober November Dezember",
    "janvier février mars avril mai juin juillet août septembre octobre novembre décembre",
    "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre",
)
MONTH_NAMES = [name for names in MONTHS for name in names.split()]
MONTH_NAME = "(?i:" + "|".join(sorted(set(MONTH_NAMES), key=lambda n: (-len(n), n))) + ")"
DAY_FIRST = rf"([0-9]{{1,2}})(st|nd|rd|th|er|\.)?( {{1,2}}(?:of |de )?)({MONTH_NAME})(\.?,? {{1,2}}(?:de |del )?)([0-9]{{4}})"
MONTH_FIRST = rf"({MONTH_NAME})(\.? {{1,2}})([0-9]{{1,2}})(st|nd|rd|th)?(,? {{1,2}})([0-9]{{4}})"
PHONE_WORD = r"(?i:tel|phone|mobile|call|fax)"


def _uncaptured(pattern: str) -> str:
    return re.sub(r"\((?!\?)", "(?:", pattern)


KINDS = {
    # The last label is judged in kind_of: a possessive repetition cannot give back what it has taken.
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++(?!@)",
    "secret": SECRET_WORD + r"[\"']?\s{0,3}[:=]\s{0,3}(?:[\"']" + SECRET_SIGNS + r"{8,}+[\"']"
              + rf"|(?={SECRET_SIGNS}{{0,200}}[0-9]){SECRET_SIGNS}{{8,}}+)",
    "token": r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[opsu]_[A-Za-z0-9]{36}|[ps]k_(?:live|test)_[A-Za-z0-9]{16,}+)(?![A-Za-z0-9])",
    "mac": r"(?<![0-9A-Za-z:-])(?:(?:[0-9A-Fa-f]{2}:){5}|(?:[0-9A-Fa-f]{2}-){5})[0-9A-Fa-f]{2}(?![0-9A-Za-z:-])",
    "ipv6": r"(?<![0-9A-Za-z:.])(?i:[23][0-9a-f]{3}|fe[89ab][0-9a-f]|f[cd][0-9a-f]{2}):(?i:[0-9a-f]{0,4}:){1,6}(?i:[0-9a-f]{0,4})(?![0-9A-Za-z:])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    "date": r"(?<![0-9./-])(?:[0-9]{4}([-/.])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([-/.])[0-9]{1,2}\2[0-9]{4})(?![0-9]|[./-][0-9])"
            + rf"|(?<![0-9A-Za-z.,/-]){_uncaptured(DAY_FIRST)}(?![0-9A-Za-z])|(?<![A-Za-z])(?=[A-Za-z]){_uncaptured(MONTH_FIRST)}(?![0-9A-Za-z])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}"
             r"|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}|0[0-9]{2,4} [0-9]{3,4} [0-9]{3,4}"
             rf"|[0-9]{{10}}(?<={PHONE_WORD}[.:]?\s{{0,3}}[0-9]{{10}}))(?![0-9A-Za-z]|[.-][0-9])",
    "card": r"(?<![0-9A-Za-z.-])[0-9](?:(?:-| (?!" + OTHER_NUMBER + r"))?[0-9]){12,60}(?![0-9A-Za-z]|[.-][0-9])",
}


def _pattern(kinds: Sequence[str]) -> str:
    """All kinds in one pattern; the groups that dates refer back to are numbered anew."""
    out, groups = [], 0
    for kind in kinds:
        part = KINDS[kind]
        if kind == "date":
            part = part.replace(r"\1", rf"\{groups + 1}").replace(r"\2", rf"\{groups + 2}")
            groups += 2
        out.append(part)
    return "|".join(out)


Key = Column | str


def _digest(key: Key, *parts: Column) -> Column:
    """64 hexadecimal digits that depend on the key and all parts."""
    own = F.lit(key) if isinstance(key, str) else key
    return F.sha2(F.concat_ws("|", own, *[p.cast("string") for p in parts]), 256)


def _round_number(key: Key, label: str, step: Column, value: Column, digits: int = 13) -> Column:
    """A keyed whole number of so many hexadecimal digits; 16 make a signed long."""
    return F.conv(F.substring(_digest(key, F.lit(label), step, value), 1, digits), 16, 10 if digits < 16 else -10).cast("long")


def permute_number(value: Column, sizes: tuple[int, int], key: Key, label: str) -> Column:
    """A keyed permutation of 0 .. sizes[0] * sizes[1] - 1: each round shifts one of two digits by a hash of the other."""
    m, n = sizes
    start = F.struct(F.floor(value / n).cast("long").alias("a"), F.pmod(value, F.lit(n)).cast("long").alias("b"))

    def step(acc: Column, k: Column) -> Column:
        even = k % 2 == 0
        a = F.when(even, F.pmod(acc["a"] + _round_number(key, label, k, acc["b"]), F.lit(m))).otherwise(acc["a"])
        b = F.when(even, acc["b"]).otherwise(F.pmod(acc["b"] + _round_number(key, label, k, acc["a"]), F.lit(n)))
        return F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))

    done = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)
    return F.aggregate(F.array(done), F.lit(0).cast("long"), lambda _, d: d["a"] * n + d["b"])


def _letters(value: Column) -> Column:
    """Its letters and digits as numbers: 0-9, then small, then capital letters by tens."""
    return F.transform(
        F.filter(F.split(value, ""), lambda c: c.rlike("[0-9A-Za-z]")), lambda c: F.ascii(c)
    )


def _draws(key: Key, seed: Column, n: Column) -> Column:
    """n keyed numbers below 2^32, eight from each digest."""
    def eight(digest: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(7)), lambda j: F.conv(F.substr(digest, 8 * j + 1, F.lit(8)), 16, 10).cast("long"))

    blocks = F.sequence(F.lit(0), F.floor((n - 1) / 8).cast("int"))
    return F.slice(F.flatten(F.transform(F.when(n > 0, blocks).otherwise(F.array().cast("array<int>")), lambda k: _let(_digest(key, seed, k), eight))), F.lit(1), n)


def _shift(codes: Column, other: Column, step: Column, key: Key, label: str) -> Column:
    """Each code moved within its kind by a number drawn from a hash of the other half and the place."""

    def moved(c: Column, drawn: Column) -> Column:
        base = F.when(c < 58, 48).when(c < 91, 65).otherwise(97)
        size = F.when(c < 58, 10).otherwise(26)
        return (base + F.pmod(c - base + drawn, size)).cast("int")

    seed = _digest(key, F.lit(label), step, F.array_join(F.transform(other, lambda c: F.char(c)), ""))
    return F.zip_with(codes, _let(seed, lambda one: _draws(key, one, F.size(codes))), moved)


def permute_letters(codes: Column, key: Key, label: str) -> Column:
    """A keyed permutation of the strings with the same kinds at the same places, by an unbalanced-safe Feistel network."""
    half = F.floor(F.size(codes) / 2).cast("int")
    start = F.struct(F.slice(codes, F.lit(1), half).alias("a"), F.slice(codes, half + 1, F.size(codes)).alias("b"))

    def step(acc: Column, k: Column) -> Column:
        even = k % 2 == 0
        a = F.when(even, _shift(acc["a"], acc["b"], k, key, label)).otherwise(acc["a"])
        b = F.when(even, acc["b"]).otherwise(_shift(acc["b"], acc["a"], k, key, label))
        return F.struct(a.alias("a"), b.alias("b"))

    done = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)
    return F.flatten(F.transform(F.array(done), lambda d: F.concat(d["a"], d["b"])))


def _refilled(value: Column, codes: Column) -> Column:
    """The value with its letters and digits replaced by these, in order; signs and spaces stay."""
    between = F.split(value, "[0-9A-Za-z]")
    filled = F.zip_with(codes, F.slice(between, F.lit(2), F.size(codes)), lambda c, rest: F.concat(F.char(c), rest))
    return F.concat(F.get(between, F.lit(0)), F.array_join(filled, ""))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn_sum(digits: Column) -> Column:
    """Luhn sum of a digit string whose last digit is not doubled."""
    codes = F.transform(F.reverse(F.split(digits, "")), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(
        2 * c.cast("int") - F.when(c.cast("int") > 4, 9).otherwise(0)
    ))
    return F.aggregate(codes, F.lit(0), lambda acc, x: acc + F.coalesce(x, F.lit(0)))


def _mod97(letters: Column) -> Column:
    """ISO 7064 remainder of a string in which letters count as two digits from 10."""
    return F.aggregate(
        F.filter(F.split(letters, ""), lambda c: c != ""), F.lit(0),
        lambda acc, c: F.when(c.rlike("[0-9]"), (acc * 10 + c.cast("int")) % 97).otherwise(
            (acc * 100 + F.ascii(c) - 55) % 97
        ).cast("int"),
    )


def _text_of(codes: Column) -> Column:
    return F.array_join(F.transform(codes, lambda c: F.char(c)), "")


def _codes_of(text: Column) -> Column:
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c))


def _let(value: Column, body) -> Column:
    """body(value) with the value worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _card(m: Column, key: Key) -> Column:
    def body(codes: Column) -> Column:
        check = F.pmod(10 - F.pmod(_luhn_sum(F.concat(_text_of(codes), F.lit("0"))), F.lit(10)), F.lit(10))
        return _refilled(m, F.concat(codes, F.array((48 + check).cast("int"))))

    codes = _letters(m)
    return _let(permute_letters(F.slice(codes, F.lit(1), F.size(codes) - 1), key, "card"), body)


def _run_of_cards(m: Column, key: Key) -> Column:
    """A run of digits with the cards in it replaced (`value`), and how many there are (`n`)."""
    groups = F.split(m, "(?=[ -])")
    start = F.struct(F.lit("").alias("value"), F.lit(0).alias("n"), F.lit(1).alias("at"), groups.alias("groups"))

    def valid(window: Column) -> Column:
        text = F.array_join(window, "")
        return text.rlike(CARD_GROUPS) & (F.pmod(_luhn_sum(_digits(text)), F.lit(10)) == 0)

    def step(acc: Column, i: Column) -> Column:
        windows = F.transform(F.array(*map(F.lit, CARD_SIZES)), lambda k: F.slice(acc["groups"], i, k))

        def taken(window: Column) -> Column:
            value = F.when(window.isNull(), F.get(acc["groups"], i - 1)).otherwise(_card(F.array_join(window, ""), key))
            return F.struct(
                F.concat(acc["value"], value).alias("value"), (acc["n"] + window.isNotNull().cast("int")).cast("int").alias("n"),
                (i + F.coalesce(F.size(window), F.lit(1))).cast("int").alias("at"), acc["groups"].alias("groups"),
            )

        return F.when(i < acc["at"], acc).otherwise(_let(F.get(F.filter(windows, valid), F.lit(0)), taken))

    return F.aggregate(F.sequence(F.lit(1), F.size(groups)), start, step, lambda acc: F.struct(acc["value"], acc["n"]))


def _iban(m: Column, key: Key) -> Column:
    packed = F.regexp_replace(m, " ", "")

    def body(codes: Column) -> Column:
        account = _text_of(codes)
        country = F.substring(packed, 1, 2)
        check = 98 - _mod97(F.concat(account, country, F.lit("00")))
        return _refilled(m, _codes_of(F.concat(country, F.lpad(check.cast("string"), 2, "0"), account)))

    return _let(permute_letters(_codes_of(F.substr(packed, F.lit(5))), key, "iban"), body)


def _ssn(m: Column, key: Key) -> Column:
    area, group, serial = (F.substring(m, a, n).cast("long") for a, n in ((1, 3), (5, 2), (8, 4)))
    index = ((area - 1 - (area > 666).cast("long")) * 99 + group - 1) * 9999 + serial - 1

    def body(x: Column) -> Column:
        head = F.floor(x / (99 * 9999)) + 1
        head = head + (head > 665).cast("long")
        parts = (head, 3), (F.pmod(F.floor(x / 9999), F.lit(99)) + 1, 2), (F.pmod(x, F.lit(9999)) + 1, 4)
        return F.concat_ws("-", *[F.lpad(p.cast("long").cast("string"), n, "0") for p, n in parts])

    return _let(permute_number(index, SSN_SIZES, key, "ssn"), body)


def _ip(m: Column, key: Key) -> Column:
    parts = [F.element_at(F.split(m, r"\."), k).cast("long") for k in (1, 2, 3, 4)]
    index = ((parts[0] * 256 + parts[1]) * 256 + parts[2]) * 256 + parts[3]
    return _let(
        permute_number(index, (65536, 65536), key, "ip"),
        lambda x: F.concat_ws(".", *[F.pmod(F.shiftright(x, s), F.lit(256)).cast("string") for s in (24, 16, 8, 0)]),
    )


def _mac(m: Column, key: Key) -> Column:
    value = F.conv(F.regexp_replace(m, "[:-]", ""), 16, 10).cast("long")
    half = 1 << 24

    def body(x: Column) -> Column:
        pairs = F.regexp_replace(F.lpad(F.hex(x), 12, "0"), "(..)(?!$)", F.concat(F.lit("$1"), F.substring(m, 3, 1)))
        return F.when(m == F.upper(m), pairs).otherwise(F.lower(pairs))

    return _let(permute_number(value, (half, half), key, "mac"), body)


def _groups(m: Column) -> Column:
    """The eight groups of an IPv6 address, or another number of them if it is none."""
    sides = [F.filter(F.split(F.substring_index(m, "::", k), ":"), lambda g: g != "") for k in (1, -1)]
    zeros = F.array_repeat(F.lit("0"), 8 - F.size(sides[0]) - F.size(sides[1]))
    packed = F.when(F.size(sides[0]) + F.size(sides[1]) < 8, F.concat(sides[0], zeros, sides[1]))
    return F.when(F.instr(m, "::") > 0, packed).otherwise(F.split(m, ":"))


def _is_ipv6(m: Column) -> Column:
    groups = _groups(m)
    return F.coalesce((F.size(groups) == 8) & F.forall(groups, lambda g: (g != "") & ~g.contains(":")), F.lit(False))


def _ipv6(m: Column, key: Key) -> Column:
    """All but the first group: the 48 and 64 bits behind it take turns in a Feistel network."""
    text = F.array_join(F.transform(_groups(m), lambda g: F.lpad(F.lower(g), 4, "0")), "")

    def body(t: Column) -> Column:
        start = F.struct(
            F.conv(F.substring(t, 5, 12), 16, -10).cast("long").alias("a"), F.conv(F.substring(t, 17, 16), 16, -10).cast("long").alias("b")
        )

        def step(acc: Column, k: Column) -> Column:
            even = k % 2 == 0
            a = F.when(even, acc["a"].bitwiseXOR(_round_number(key, "ipv6", k, acc["b"], 12))).otherwise(acc["a"])
            b = F.when(even, acc["b"]).otherwise(acc["b"].bitwiseXOR(_round_number(key, "ipv6", k, acc["a"], 16)))
            return F.struct(a.alias("a"), b.alias("b"))

        whole = F.aggregate(
            F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step,
            lambda acc: F.concat(F.lpad(F.hex(acc["a"]), 12, "0"), F.lpad(F.hex(acc["b"]), 16, "0")),
        )
        return F.concat(F.substring(t, 1, 4), F.lit(":"), F.regexp_replace(F.lower(whole), "(.{4})(?!$)", "$1:"))

    return _let(text, body)


def _date_parts(m: Column) -> tuple[Column, Column, Column, Column, Column]:
    """Year, month and day, whether the year is first, and whether the month is before the day."""
    part = [F.get(F.split(m, "[-/.]"), F.lit(k)).try_cast("int") for k in (0, 1, 2)]
    year_first = F.length(F.substring_index(F.translate(m, "/.", "--"), "-", 1)) == 4
    month_first = year_first | (F.instr(m, "/") > 0) & (part[0] <= 12) | (part[1] > 12)
    year = F.when(year_first, part[0]).otherwise(part[2])
    month = F.when(year_first, part[1]).when(month_first, part[0]).otherwise(part[1])
    day = F.when(year_first, part[2]).when(month_first, part[1]).otherwise(part[0])
    return year, month, day, year_first, month_first


def _named_parts(m: Column) -> tuple[Column, Column, Column, Column]:
    """Year, place in MONTH_NAMES, day, and whether the day is first, of a date with a month's name."""
    day_first = m.rlike("^[0-9]")

    def part(first: int, second: int) -> Column:
        return F.when(day_first, F.regexp_extract(m, DAY_FIRST, first)).otherwise(F.regexp_extract(m, MONTH_FIRST, second))

    names = F.lower(F.regexp_extract(m, MONTH_NAME, 0))
    at = F.array_position(F.array(*[F.lit(n.lower()) for n in MONTH_NAMES]), names) - 1
    return part(6, 6).try_cast("int"), at, part(1, 3).try_cast("int"), day_first


def _day_of_date(m: Column) -> Column:
    """The calendar day of a date text of either form within the cycle, else null."""
    year, at, day, _ = _named_parts(m)
    named = _calendar_day(year, (F.pmod(at, F.lit(12)) + 1).cast("int"), day)
    year, month, day, _, _ = _date_parts(m)
    return F.when(m.rlike("[A-Za-z]"), named).otherwise(_calendar_day(year, month, day))


def _named_date(m: Column, day: Column) -> Column:
    """The day in the form of a date with a month's name: same order, language, capitals and signs."""
    _, at, _, day_first = _named_parts(m)
    old = F.regexp_extract(m, MONTH_NAME, 0)
    new = F.get(F.array(*map(F.lit, MONTH_NAMES)), (at - F.pmod(at, F.lit(12)) + F.month(day) - 1).cast("int"))
    name = F.when(old == F.upper(old), F.upper(new)).when(old == F.lower(old), F.lower(new)).otherwise(F.initcap(new))
    number = F.dayofmonth(day)
    ordinal = F.when(number.between(11, 13), "th").otherwise(F.get(F.array(*map(F.lit, "th st nd rd th th th th th th".split())), number % 10))

    def ending(old_ending: Column) -> Column:
        return F.when(old_ending.isin("st", "nd", "rd", "th"), ordinal).when(old_ending == "er", F.when(number == 1, "er").otherwise("")).otherwise(old_ending)

    def part(pattern: str, k: int) -> Column:
        return F.regexp_extract(m, pattern, k)

    year, number = F.date_format(day, "yyyy"), number.cast("string")
    first = F.concat(number, ending(part(DAY_FIRST, 2)), part(DAY_FIRST, 3), name, part(DAY_FIRST, 5), year)
    second = F.concat(name, part(MONTH_FIRST, 2), number, ending(part(MONTH_FIRST, 4)), part(MONTH_FIRST, 5), year)
    return F.when(day_first, first).otherwise(second)


def _calendar_day(year: Column, month: Column, day: Column) -> Column:
    """The day if it is a real one within the cycle, else null."""
    text = F.format_string("%04d-%02d-%02d", year, month, day)
    found = F.to_date(F.when(
        year.between(1800, 2199) & month.between(1, 12) & day.between(1, 28), text
    ).when(
        year.between(1800, 2199) & month.between(1, 12) & (day > 28)
        & (day <= F.dayofmonth(F.last_day(F.to_date(F.format_string("%04d-%02d-01", year, F.greatest(F.lit(1), F.least(F.lit(12), month))))))), text
    ))
    return found


def _date(m: Column, key: Key) -> Column:
    _, _, _, year_first, month_first = _date_parts(m)
    start = F.to_date(F.lit(CYCLE_START))

    def body(x: Column) -> Column:
        day = F.date_add(start, x.cast("int"))
        sign = F.regexp_extract(m, "([-/.])", 1)
        y, mo, d = F.date_format(day, "yyyy"), F.date_format(day, "MM"), F.date_format(day, "dd")
        return F.when(m.rlike("[A-Za-z]"), _named_date(m, day)).when(year_first, F.concat(y, sign, mo, sign, d)).when(month_first, F.concat(mo, sign, d, sign, y)).otherwise(
            F.concat(d, sign, mo, sign, y)
        )

    return _let(permute_number(F.datediff(_day_of_date(m), start).cast("long"), CYCLE_DAYS, key, "date"), body)


def _split_head(m: Column, head: Column, label: str, key: Key) -> Column:
    """The value with all letters and digits after its head permuted."""
    rest = F.substr(m, F.length(head) + 1)
    return F.concat(head, _refilled(rest, permute_letters(_letters(rest), key, label)))


def kind_of(m: Column) -> Column:
    """The kind of a match, or null if what it looks like is not valid."""
    digits = _digits(m)
    packed = F.regexp_replace(m, " ", "")
    area = F.substring(m, 1, 3)
    return (
        F.when(m.contains("@"), F.when(F.substring_index(m, "@", -1).rlike(r"\.[A-Za-z]{2,}+(?![A-Za-z0-9-])"), "email"))
        .when(m.rlike("^(?:A[KS]IA|gh[opsu]_|[ps]k_)[^:=]*+$"), "token")
        .when(m.rlike("^(?:(?:[0-9A-Fa-f]{2}:){5}|(?:[0-9A-Fa-f]{2}-){5})[0-9A-Fa-f]{2}$"), "mac")
        .when(m.rlike("^[0-9A-Fa-f]{4}:[0-9A-Fa-f:]+$"), F.when(_is_ipv6(m), "ipv6"))
        .when(m.rlike("^[A-Za-z_-]+[\"']?\\s*[:=]"), "secret")
        .when(m.rlike("^[A-Z]{2}[0-9]{2}"), F.when(
            F.length(packed).between(15, 34) & (_mod97(F.concat(F.substr(packed, F.lit(5)), F.substring(packed, 1, 4))) == 1), "iban"
        ))
        .when(m.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), F.when(
            F.forall(F.split(m, r"\."), lambda p: (p.cast("int") <= 255) & ~p.rlike("^0[0-9]")), "ip"
        ))
        .when(m.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), F.when(
            ~area.isin("000", "666") & (area < "900") & (F.substring(m, 5, 2) != "00") & (F.substring(m, 8, 4) != "0000"), "ssn"
        ))
        .when(m.rlike(r"^([0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}|[0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{4})$"),
              F.when(_day_of_date(m).isNotNull(), "date"))
        .when(m.rlike(f"^(?:{_uncaptured(DAY_FIRST)}|{_uncaptured(MONTH_FIRST)})$"), F.when(_day_of_date(m).isNotNull(), "date"))
        .when(m.startswith("+"), F.when(F.length(digits).between(8, 15), "phone"))
        .when(m.rlike("^0[0-9]+ "), F.when(F.length(digits).between(10, 11), "phone"))
        .when(F.length(digits) == 10, "phone")
        .when(F.length(digits).between(13, 19), F.when(F.pmod(_luhn_sum(digits), F.lit(10)) == 0, "card"))
    )


def pseudonym(m: Column, kind: Column, key: Key) -> Column:
    """The match with its pseudonym in place; a match without a kind stays as it is."""
    after_country = F.regexp_extract(m, r"^(\+[0-9]{1,3}(?=[ .(-])|\+[0-9]{1,2}|0(?=[0-9]+ )|)", 1)
    # The address ends with the last label that could be a top-level domain; what follows it is none of it.
    address = F.regexp_extract(m, r"^(.*\.[A-Za-z]{2,}+)(?![A-Za-z0-9-])", 1)
    domain = F.regexp_extract(address, r"(\.[A-Za-z]+)$", 1)
    name = F.substr(m, F.lit(1), F.length(address) - F.length(domain))
    rest = F.substr(m, F.length(address) + 1)
    beginning = F.regexp_extract(m, "^(A[KS]IA|gh[opsu]_|[ps]k_(?:live|test)_)", 1)
    label = F.regexp_extract(m, "^([A-Za-z_-]+[\"']?\\s*[:=]\\s*)", 1)
    return (
        F.when(kind.isNull(), m)
        .when(kind == "card", _card(m, key))
        .when(kind == "iban", _iban(m, key))
        .when(kind == "ssn", _ssn(m, key))
        .when(kind == "ip", _ip(m, key))
        .when(kind == "date", _date(m, key))
        .when(kind == "phone", _split_head(m, after_country, "phone", key))
        .when(kind == "email", F.concat(_split_head(name, F.lit(""), "email", key), domain, rest))
        .when(kind == "token", _split_head(m, beginning, "token", key))
        .when(kind == "mac", _mac(m, key))
        .when(kind == "ipv6", _ipv6(m, key))
        .otherwise(_split_head(m, label, "secret", key))
    )


def pseudonymize(
    docs: DataFrame, key: str, text_column: str = "text", kinds: Sequence[str] = tuple(KINDS), counts_column: str | None = None,
    length_column: str | None = None,
) -> DataFrame:
    """The documents with pseudonyms in their texts; all other columns, whatever their names, stay as they are.

    Null and empty texts stay so. Repeated rows get equal texts. With `counts_column` a map of how many values of
    each kind were replaced is added under that name (in place of a column of that name). `length_column` is set
    to the number of characters of a text that changed. The key is a secret of the caller and in no plan. Texts of any
    length and content are taken whole.
    """
    pattern = _pattern(kinds)
    names = docs.columns
    # The key is a row of its own table, so that no plan, page or event log shows it.
    secret = docs.sparkSession.createDataFrame([(key,)], "secret string")
    key = F.col("secret")
    rows = docs.select(F.struct("*").alias("row")).join(F.broadcast(secret))
    old = F.col("row").getField(text_column)
    # Only a text with a digit, an at sign or a word before a secret can have a match: others skip the pattern.
    matches = F.when(old.rlike(f"[0-9@]|{SECRET_WORD}|A[KS]IA"), F.regexp_extract_all(old, F.lit(pattern), F.lit(0)))

    def replaced(x: Column) -> Column:
        """Kind, pseudonym and number of values of a match."""
        one = F.struct(x["kind"].alias("kind"), pseudonym(x["m"], x["kind"], key).alias("value"), F.lit(1).alias("n"))
        cards = _let(_run_of_cards(x["m"], key), lambda r: F.struct(
            F.when(r["n"] > 0, "card").alias("kind"), r["value"].alias("value"), r["n"].alias("n")
        ))
        return F.when(x["kind"].isNull() & x["m"].rlike(DIGIT_RUN), cards).otherwise(one)

    found = F.transform(matches, lambda m: _let(F.struct(m.alias("m"), kind_of(m).alias("kind")), replaced))
    packed = rows.select("row", found.alias("found"))
    between = F.split(old, pattern)
    joined = F.concat(F.element_at(between, 1), F.array_join(
        F.zip_with(F.col("found")["value"], F.slice(between, F.lit(2), F.size("found")), lambda v, rest: F.concat(v, rest)), ""
    ))
    any_kind = F.exists(F.col("found")["kind"], lambda k: k.isNotNull())
    new = F.when(any_kind, joined).otherwise(old)
    done = packed.select("row", "found", new.alias("new"))
    columns = []
    for c in names:
        column = F.col("row").getField(c)
        if c == text_column:
            column = F.col("new")
        elif c == length_column:
            column = F.when(F.col("new") != old, F.char_length("new").cast(docs.schema[c].dataType)).otherwise(column)
        if c != counts_column:
            columns.append(column.alias(c))
    if counts_column:
        known = F.coalesce("found", F.expr("CAST(array() AS array<struct<kind:string,value:string,n:int>>)"))

        def number(kind: str) -> Column:
            return F.aggregate(known, F.lit(0), lambda n, x: n + F.when(x["kind"] == kind, x["n"]).otherwise(0))

        counts = F.map_from_arrays(F.array(*map(F.lit, kinds)), F.array(*map(number, kinds)))
        columns.append(F.map_filter(counts, lambda k, n: n > 0).alias(counts_column))
    return done.select(*columns)
