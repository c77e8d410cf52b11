"""Personal numbers and dates become pseudonyms of the same format, by a keyed Feistel permutation.

Built from DataFrame functions only. Candidates are found by one pattern; a candidate is replaced only
if it is valid: card numbers by their check digit (Luhn), IBANs by theirs (modulo 97), dates of the years
1901 to 2096 by the calendar, IPv4 addresses and social security numbers by the ranges of their parts,
telephone numbers by the number of digits. Mail addresses, access keys and passwords change in their
letters and digits. A value is taken apart into symbols, each with its own radix (a digit, a letter, an
octet, a part of a day number); the symbols are dealt into two halves, and rounds add to each symbol of one
half a keyed hash of the other half, modulo its radix. Every round can be undone, so different values of a
format stay different, and equal values are equal in all documents. Check digits are computed anew, first
digits and country codes stay, so a pseudonym is valid in its turn.

Card numbers are looked for in whole runs of digits with single spaces or dashes; a run ends where a date, a
telephone number or the like begins. A run that is valid as a whole is one number; else numbers in the shapes of
``CARD_SHAPES`` are looked for at each group of digits, and what stands around them stays. An IBAN has its
country's length.

Edge cases: a null text stays null and an empty one empty; a text without candidates is unchanged;
invalid candidates stay. Numbers written with other separators are other texts of the same digits and get
the same digits. Rows are neither added nor removed; ids and other columns are not touched.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

ROUNDS = 10
CYCLE = 28  # years after which the calendar repeats, from 1901 to 2099
FIRST_YEAR, LAST_YEAR = 1901, 2096
DAYS = (21, 487)  # their product is the days of a cycle

#: Characters of an IBAN after the first four, by country.
IBAN_REST = {
    11: "NO", 12: "BE", 14: "DK FI FK FO GL NL SD", 15: "MK SI", 16: "AT BA EE KZ LT LU MN XK", 17: "CH CR HR LI LV",
    18: "BG BH DE GB GE IE ME RS VA", 19: "AE GI IL IQ OM SO TL", 20: "AD CZ DZ ES MD PK RO SA SE SK TN VG",
    21: "AO CV LY MZ PT ST", 22: "IR IS TR", 23: "BF BI CF CG CM DJ EG FR GA GR IT KM MC MG MR SM TD",
    24: "AL AZ BJ BY CI CY DO GT GW HN HU LB MA ML NE NI PL SN SV TG", 25: "BR PS QA UA", 26: "JO KW MU YE", 27: "MT SC", 28: "LC", 29: "RU",
}


def _iban_of(rest: int, countries: str) -> str:
    fours, tail = divmod(rest, 4)
    end = f" ?[A-Z0-9]{{{tail}}}" if tail else ""
    return f"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{fours}}}{end}(?![A-Za-z0-9])"


#: What a candidate looks like, by kind; the first kind that matches at a place counts.
#: Quantifiers are possessive or bounded, so that long runs cost no more than their length.
KINDS = {
    "mail": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9-])",
    "password": r"(?<![A-Za-z])password=[!-~]{6,64}(?![!-~])",
    "key": r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|[0-9a-f]{32,64})(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])(?:"
    + "|".join(_iban_of(*item) for item in IBAN_REST.items())
    + r"|[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))",
    "ymd": r"(?<![0-9])[0-9]{4}(?:-[0-9]{2}-|/[0-9]{2}/|\.[0-9]{2}\.)[0-9]{2}(?![0-9])",
    "dmy": r"(?<![0-9.])[0-9]{2}(?:-[0-9]{2}-|/[0-9]{2}/|\.[0-9]{2}\.)[0-9]{4}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    "phone": r"(?<![0-9A-Za-z])\+[0-9]{1,3}(?:[ .-]?\(?[0-9]{2,4}\)?){2,5}(?![0-9])",
    "local": r"(?<![0-9A-Za-z.])\(?[2-9][0-9]{2}\)?[ .-][2-9][0-9]{2}[ .-][0-9]{4}(?![0-9])",
}
_OTHER = "(?!" + "|".join(KINDS[k] for k in ("mail", "ymd", "dmy", "ssn", "ip", "local")) + ")"
_GROUP = "[0-9]++(?![A-Za-z])"
KINDS["card"] = (
    rf"(?<![0-9A-Za-z.])(?=[0-9](?:(?:[ -]{_OTHER})?[0-9]){{12}}){_GROUP}(?:[ -]{_OTHER}{_GROUP})*+"
)
CARD_SHAPES = ((4, 4, 4, 4, 3), (4, 4, 4, 4, 2), (4, 4, 4, 4, 1), (8, 8), (4, 4, 4, 4), (4, 6, 5), (4, 6, 4), (4, 4, 4, 1))
#: A group of digits and, by lookahead, the numbers that may begin at it: at the head of a run any grouping too.
_CARDS_AT = [r"\A[0-9](?:[ -]?[0-9]){12,18}(?![0-9])", "[0-9]{13,19}(?![0-9])"] + [
    "(?:" + "|".join(mark.join(f"[0-9]{{{n}}}" for n in shape) for mark in " -") + ")(?![0-9])" for shape in CARD_SHAPES
]
_AT_GROUP = "".join(f"(?=({one})?)" for one in _CARDS_AT) + "([0-9]++[ -]?+)"
PATTERN = "|".join(KINDS.values())


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _long(c: Column) -> Column:
    return c.cast("bigint")


def _hash(*parts: Column) -> Column:
    return _long(F.conv(F.substring(F.sha2(F.concat_ws("|", *parts).cast("binary"), 256), 1, 12), 16, 10))


def feistel(values: Column, radices: Column, key: str, tweak: Column, undo: bool = False) -> Column:
    """A keyed permutation of arrays of symbols: values[i] is in 0 .. radices[i] - 1, and so is the result."""
    half = F.floor(F.size(values) / 2).cast("int")
    left = lambda a: F.slice(a, F.lit(1), half)
    right = lambda a: F.slice(a, half + 1, F.size(a) - half)

    def add(part: Column, radix: Column, other: Column, k: Column) -> Column:
        told = F.array_join(other.cast("array<string>"), ",")
        shift = lambda i: _hash(F.lit(key), tweak, k.cast("string"), i.cast("string"), told)
        return F.transform(part, lambda x, i: F.pmod(x - shift(i) if undo else x + shift(i), F.get(radix, i)))

    def step(s: Column, k: Column) -> Column:
        odd = k % 2 == 1
        new_left = F.when(odd, add(s["l"], left(radices), s["r"], k)).otherwise(s["l"])
        new_right = F.when(odd, s["r"]).otherwise(add(s["r"], right(radices), s["l"], k))
        return F.struct(new_left.alias("l"), new_right.alias("r"))

    order = F.sequence(F.lit(ROUNDS), F.lit(1), F.lit(-1)) if undo else F.sequence(F.lit(1), F.lit(ROUNDS))
    start = F.struct(left(values).alias("l"), right(values).alias("r"))
    return F.aggregate(order, start, step, lambda s: F.concat(s["l"], s["r"]))


def _chars(s: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: s.substr(i, F.lit(1)))


def _permuted_text(s: Column, key: str, kind: str, rule: Callable[[Column, Column, Column], Column]) -> Column:
    """Permute the characters to which ``rule(character, place from 1, digits before it)`` gives a symbol
    (base code, radix); others (null) stay. The tweak is the kind and the number of symbols."""

    def digits_before(i: Column) -> Column:
        return F.length(F.regexp_replace(s.substr(F.lit(1), i - 1), "[^0-9]", ""))

    symbol = lambda i: _let(s.substr(i, F.lit(1)), lambda c: F.struct(c.alias("c"), rule(c, i, digits_before(i)).alias("rule")))
    marked = F.transform(F.sequence(F.lit(1), F.length(s)), symbol)

    def render(symbols: Column) -> Column:
        moving = F.filter(symbols, lambda x: x["rule"].isNotNull())
        values = F.transform(moving, lambda x: _long(F.ascii(x["c"])) - x["rule"]["base"])
        radices = F.transform(moving, lambda x: x["rule"]["radix"])
        tweak = F.concat(F.lit(kind), F.size(moving).cast("string"))
        new = feistel(values, radices, key, tweak)

        def put(fresh: Column) -> Column:
            rank = lambda i: F.size(F.filter(F.slice(symbols, F.lit(1), i), lambda x: x["rule"].isNotNull()))
            one = lambda x, i: F.when(x["rule"].isNull(), x["c"]).otherwise(F.char(x["rule"]["base"] + F.get(fresh, rank(i))))
            return F.array_join(F.transform(symbols, one), "")

        return _let(new, put)

    return F.when(F.length(s) > 0, _let(marked, render)).otherwise(s)


def _symbol(base: int, radix: int) -> Column:
    return F.struct(F.lit(base).cast("bigint").alias("base"), F.lit(radix).cast("bigint").alias("radix"))


def _is_digit(c: Column) -> Column:
    return c.between("0", "9")


def _alnum(c: Column, *_: Column) -> Column:
    return (
        F.when(_is_digit(c), _symbol(48, 10)).when(c.between("a", "z"), _symbol(97, 26)).when(c.between("A", "Z"), _symbol(65, 26))
    )


def _hex(c: Column, *_: Column) -> Column:
    return F.when(_is_digit(c), _symbol(48, 10)).when(c.between("a", "f"), _symbol(97, 6))


def _phone_digit(c: Column, first: Column) -> Column:
    """A digit of a telephone number; at the head of an area or exchange 2-9 and 0-1 stay apart."""
    lead = F.when(c >= "2", _symbol(50, 8)).otherwise(_symbol(48, 2))
    return F.when(_is_digit(c), F.when(first, lead).otherwise(_symbol(48, 10)))


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn_sum(digits: Column) -> Column:
    """Sum of the digits, every second from the right (not the last) doubled."""
    at = F.transform(_chars(F.reverse(digits)), lambda c, i: F.when(i % 2 == 1, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int")))
    return F.aggregate(at, F.lit(0), lambda a, x: a + x)


def _with_last_digit(s: Column, digit: Column) -> Column:
    return F.concat(s.substr(F.lit(1), F.length(s) - 1), digit.cast("string"))


def _card(s: Column, key: str) -> Column:
    def fresh(d: Column) -> Column:
        n = F.length(d)
        moved = _permuted_text(s, key, "card", lambda c, _, before: F.when(_is_digit(c) & (before > 0) & (before < n - 1), _symbol(48, 10)))
        return _let(moved, lambda m: _with_last_digit(m, F.pmod(-luhn_sum(_digits(_with_last_digit(m, F.lit(0)))), F.lit(10))))

    return _let(_digits(s), lambda d: F.when(_is_card(s), fresh(d)).otherwise(s))


def _is_card(s: Column) -> Column:
    return _let(_digits(s), lambda d: F.length(d).between(13, 19) & (luhn_sum(d) % 10 == 0) & ~d.rlike("^0*$"))


def _card_parts(run: Column) -> Column:
    """A run of digits cut so that every valid card number in it is a part of its own."""
    n = len(_CARDS_AT)
    zipped = F.arrays_zip(*[F.regexp_extract_all(run, F.lit(_AT_GROUP), F.lit(i + 1)).alias(f"c{i}") for i in range(n + 1)])

    def first_valid(x: Column) -> Column:
        options = F.array(*[x[f"c{i}"] for i in range(n)])
        return F.struct(x[f"c{n}"].alias("group"), F.get(F.filter(options, _is_card), F.lit(0)).alias("card"))

    def step(state: Column, x: Column) -> Column:
        begins = (state["skip"] <= 0) & x["card"].isNotNull()
        left = F.when(begins, F.length(x["card"])).otherwise(F.greatest(state["skip"], F.lit(0))) - F.length(x["group"])
        # the characters of the group that no number covers: all, none, or the mark behind it
        rest = F.when(left < 0, F.right(x["group"], -left)).otherwise(F.lit(""))
        new = F.filter(F.array(F.when(begins, x["card"]).otherwise(F.lit("")), rest), lambda p: p != "")
        return F.struct(left.cast("int").alias("skip"), F.concat(state["parts"], new).alias("parts"))

    def cut(groups: Column) -> Column:
        none = F.struct(F.lit(0).alias("skip"), F.array().cast("array<string>").alias("parts"))
        parts = F.aggregate(groups, none, step, lambda state: state["parts"])
        return F.when(F.exists(groups, lambda x: x["card"].isNotNull()), parts).otherwise(F.array(run))

    return F.when(_is_card(run), F.array(run)).otherwise(_let(F.transform(zipped, first_valid), cut))


def iban_remainder(s: Column) -> Column:
    """The IBAN modulo 97: its first four characters at the end, letters as 10 to 35."""
    plain = F.regexp_replace(s, " ", "")
    turned = F.concat(plain.substr(F.lit(5), F.length(plain)), plain.substr(F.lit(1), F.lit(4)))
    add = lambda a, c: F.when(_is_digit(c), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return _let(turned, lambda t: F.aggregate(_chars(t), F.lit(0), add))


def _iban(s: Column, key: str) -> Column:
    moved = _permuted_text(s, key, "iban", lambda c, i, _: F.when(i > 4, _alnum(c)))

    def checked(m: Column) -> Column:
        zero = F.concat(m.substr(F.lit(1), F.lit(2)), F.lit("00"), m.substr(F.lit(5), F.length(m)))
        check = F.lpad((98 - iban_remainder(zero)).cast("string"), 2, "0")
        return F.concat(m.substr(F.lit(1), F.lit(2)), check, m.substr(F.lit(5), F.length(m)))

    return F.when(iban_remainder(s) == 1, _let(moved, checked)).otherwise(s)


def _phone(s: Column, key: str) -> Column:
    country = F.length(F.regexp_extract(s, r"^\+[0-9]{1,3}", 0))
    plain = F.length(_digits(s))
    north = s.rlike(r"^\+1[ .-]?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}$")
    moved = _permuted_text(s, key, "phone", lambda c, i, before: F.when(i > country, _phone_digit(c, north & before.isin(1, 4))))
    return F.when(plain.between(8, 15), moved).otherwise(s)


def _local(s: Column, key: str) -> Column:
    return _permuted_text(s, key, "local", lambda c, _, before: _phone_digit(c, before.isin(0, 3)))


def _numbers(s: Column, by: str) -> Column:
    return F.split(s, by).cast("array<bigint>")


def _fixed(values: list[Column], radices: list[int], key: str, kind: str) -> Column:
    return feistel(F.array(*values), F.array(*[F.lit(r).cast("bigint") for r in radices]), key, F.lit(kind))


def _ip(s: Column, key: str) -> Column:
    def fresh(p: Column) -> Column:
        new = _fixed([F.get(p, F.lit(i)) for i in range(4)], [256] * 4, key, "ip")
        return F.when(F.array_max(p) <= 255, F.array_join(new.cast("array<string>"), ".")).otherwise(s)

    return _let(_numbers(s, "[.]"), fresh)


def _ssn(s: Column, key: str) -> Column:
    def fresh(p: Column) -> Column:
        area, group, serial = (F.get(p, F.lit(i)) for i in range(3))
        valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
        new = _fixed([area - F.when(area > 666, 2).otherwise(1), group - 1, serial - 1], [898, 99, 9999], key, "ssn")

        def render(n: Column) -> Column:
            a, g, t = (F.get(n, F.lit(i)) + 1 for i in range(3))
            return F.concat_ws("-", *[F.lpad(x.cast("string"), w, "0") for x, w in ((F.when(a > 665, a + 1).otherwise(a), 3), (g, 2), (t, 4))])

        return F.when(valid, _let(new, render)).otherwise(s)

    return _let(_numbers(s, "-"), fresh)


def _date(s: Column, key: str, year_first: bool) -> Column:
    """A date moves within its calendar cycle. With the year last, a month of over 12 means that the day is first."""
    mark = F.regexp_extract(s, "[-/.]", 0)

    def fresh(p: Column) -> Column:
        a, b, c = (F.get(p, F.lit(i)).cast("int") for i in range(3))
        # 31.12. is written with points where the day comes first, and so is what cannot be month and day
        day_first = (mark == ".") | (a > 12)
        year = a if year_first else c
        month = b if year_first else F.when(day_first, b).otherwise(a)
        day = c if year_first else F.when(day_first, a).otherwise(b)
        long_month = F.when(month == 2, F.when(year % 4 == 0, 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)
        valid = year.between(FIRST_YEAR, LAST_YEAR) & month.between(1, 12) & (day >= 1) & (day <= long_month)

        def moved(start: Column) -> Column:
            at = _long(F.date_diff(F.make_date(year, month, day), start))
            new = _fixed([F.floor(at / DAYS[1]).cast("bigint"), at % DAYS[1]], list(DAYS), key, "date")
            return _let(new, lambda n: F.date_add(start, (F.get(n, F.lit(0)) * DAYS[1] + F.get(n, F.lit(1))).cast("int")))

        def render(d: Column) -> Column:
            y, m, n = F.lpad(F.year(d).cast("string"), 4, "0"), F.lpad(F.month(d).cast("string"), 2, "0"), F.lpad(F.day(d).cast("string"), 2, "0")
            if year_first:
                return F.concat(y, mark, m, mark, n)
            return F.when(day_first, F.concat(n, mark, m, mark, y)).otherwise(F.concat(m, mark, n, mark, y))

        start = F.make_date((year - (year - FIRST_YEAR) % CYCLE).cast("int"), F.lit(1), F.lit(1))
        return F.when(valid, _let(_let(start, moved), render)).otherwise(s)

    return _let(F.split(s, "[-/.]"), fresh)


def pseudonym(s: Column, key: str) -> Column:
    """What stands for a candidate: itself if it is not valid."""
    is_kind = lambda k: s.rlike("^(?:" + KINDS[k] + ")$")
    at = F.instr(s, "@")
    return (
        F.when(is_kind("mail"), _permuted_text(s, key, "mail", lambda c, i, _: F.when(i < at, _alnum(c))))
        .when(is_kind("password"), _permuted_text(s, key, "password", lambda c, i, _: F.when(i > len("password="), _alnum(c))))
        .when(s.rlike("^AKIA[0-9A-Z]{16}$"), _permuted_text(s, key, "key", lambda c, i, _: F.when(i > 4, _alnum(c))))
        .when(s.rlike("^(?=.*[a-f])(?=.*[0-9])[0-9a-f]{32,64}$"), _permuted_text(s, key, "hex", _hex))
        .when(is_kind("iban"), _iban(s, key))
        .when(is_kind("ymd"), _date(s, key, True))
        .when(is_kind("dmy"), _date(s, key, False))
        .when(is_kind("ssn"), _ssn(s, key))
        .when(is_kind("ip"), _ip(s, key))
        .when(is_kind("phone"), _phone(s, key))
        .when(is_kind("card"), _card(s, key))
        .when(is_kind("local"), _local(s, key))
        .otherwise(s)
    )


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """``docs`` with the personal values of ``text_col`` replaced; ``count_col`` gets how many changed.

    Texts are cut at the candidates, few as they are, and put together again around their pseudonyms;
    texts without a digit or an at sign are passed through.
    """
    text = F.col(text_col)
    found = F.when(text.rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)))

    def joined(old: Column) -> Column:
        def around(new: Column) -> Column:
            pieces = F.split(text, PATTERN, -1)
            woven = F.zip_with(pieces, new, lambda p, n: F.concat(p, F.coalesce(F.array_join(n, ""), F.lit(""))))
            changed = F.size(F.filter(F.zip_with(F.flatten(old), F.flatten(new), lambda o, n: o != n), lambda differs: differs))
            return F.struct(F.array_join(woven, "").alias("text"), changed.alias("n"))

        return _let(F.transform(old, lambda parts: F.transform(parts, lambda s: pseudonym(s, key))), around)

    def parted(candidates: Column) -> Column:
        is_run = lambda s: s.rlike("^(?:" + KINDS["card"] + ")$")
        return F.transform(candidates, lambda s: F.when(is_run(s), _card_parts(s)).otherwise(F.array(s)))

    same = F.struct(text.alias("text"), F.lit(0).alias("n"))
    made = F.when(F.size(F.coalesce(found, F.array().cast("array<string>"))) > 0, _let(parted(found), joined)).otherwise(same)
    names = docs.columns
    out = docs.select(*[F.col(c) for c in names], made.alias("__made"))
    columns = [F.col("__made.text").alias(c) if c == text_col else F.col(c) for c in names]
    return out.select(*columns, *([F.col("__made.n").alias(count_col)] if count_col else []))
