"""Personal data: format-preserving Feistel pseudonyms (native).

Numbers and dates are found by pattern, validated (check digits of cards, octets of addresses, areas of
social security numbers, calendar dates), and replaced by another valid value of the same format: the
value's symbols, without spaces and punctuation, are split in two halves and each half is shifted, in ROUNDS
rounds, by keyed digests of the other one, every symbol modulo its own radix; then the layout is put back. A
single symbol goes by a keyed order of its radix. That is a permutation of the format's values, so equal values
get equal pseudonyms in all documents and layouts, different ones different ones, and who has the key can invert
it (inverse=True). Candidates that fail validation stay as they are.

  email     ASCII letters and digits before the @ (cases and punctuation stay, the domain stays)
  card      13 to 19 digits with a right check digit, also in a longer run of groups of digits (all of the run if it is
            valid, else groups in the usual shapes, else the longest); the check digit is computed anew
  phone     international numbers of 8 to 15 digits, whose country code stays, and (AAA) BBB-CCCC
  address   IPv4, octet by octet
  ssn       social security numbers of valid areas, groups and serials
  date      YYYY-MM-DD and D/M/Y or D.M.Y from 1900-01-01 on, as one of SPAN days; all are the same value. Where a
            day or month has one digit, the pseudonym isn't padded either
  iban      international bank account numbers with right check digits, which are computed anew; the country stays

Null text stays null. Identifiers aren't used, repeated rows are treated alike. Empty input gives an empty
result. Other columns aren't read by op9; pseudonymize() keeps them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, fresh

ROUNDS = 8
#: The key of the query, for reproducible results; real use gives its own.
QUERY_KEY = "op9-query-key"
#: Days from 1900-01-01 that dates are permuted in, as two symbols.
FIRST_DAY, DATE_RADICES = "1900-01-01", (250, 292)
SPAN = DATE_RADICES[0] * DATE_RADICES[1]
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]{1,64}+@[A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]++)+",
    "date": r"(?<![\d./\-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}([./])\d{1,2}\1\d{4})(?![\d/\-])",
    "ssn": r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])",
    "address": r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d)",
    "phone": r"\+\d{1,3} ?\(\d{2,4}\) ?\d{3}[ \-]?\d{4}(?!\d)|\+\d{1,3}[ \-]\d{2,4}[ \-]\d{3,4}[ \-]?\d{3,4}(?!\d)|(?<![\d)])\(\d{3}\) ?\d{3}-\d{4}(?!\d)",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Groups of digits that may hold card numbers, searched between the others; the bound is Java's stack, not a card's length.
CARD_RUN = r"(?<![\d\-])\d(?:[ \-]?\d){12,400}(?![\d\-])"
#: How card numbers are usually grouped.
CARD_SHAPE = r"^(?:\d+|\d{4}([ \-])\d{4}\1\d{4}\1\d{4}|\d{4}([ \-])\d{6}\2\d{4,5})$"
#: What every candidate holds: texts without it are not searched.
HINT = r"[0-9@]"


def _shifts(key: str, kind: Column, round_no: Column, values: Column) -> Column:
    """32 pieces of 8 hex digits that depend on the key, the round and the other half."""
    said = F.concat_ws("|", F.lit(key), kind, round_no.cast("string"), F.array_join(F.transform(values, lambda v: v.cast("string")), ","))
    return F.regexp_extract_all(F.concat(F.sha2(F.concat(said, F.lit("|0")), 512), F.sha2(F.concat(said, F.lit("|1")), 512)), F.lit("(.{8})"), 1)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed, and written into the plan, once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _single(value: Column, radix: Column, kind: Column, key: str, inverse: bool) -> Column:
    """A keyed order of the numbers below radix: the place of value in it, or the number at that place."""
    said = lambda v: F.sha2(F.concat_ws("|", F.lit(key), kind, F.lit("single"), v.cast("string")), 256)
    pairs = F.array_sort(F.transform(F.sequence(F.lit(0).cast("bigint"), radix.cast("bigint") - 1), lambda v: F.struct(said(v).alias("h"), v.alias("v"))))
    order = F.transform(pairs, lambda p: p.v)
    return F.element_at(order, value.cast("int") + 1) if inverse else F.array_position(order, value.cast("bigint")) - 1


def feistel(values: Column, radices: Column, kind: Column, key: str, rounds: int = ROUNDS, inverse: bool = False) -> Column:
    """A keyed permutation of arrays of numbers, values[i] from 0 to radices[i] - 1, or its inverse."""
    given = F.struct(values.cast("array<bigint>").alias("v"), radices.cast("array<bigint>").alias("r"))
    return _let(given, lambda x: _feistel(x.v, x.r, kind, key, rounds, inverse))


def _feistel(values: Column, radices: Column, kind: Column, key: str, rounds: int, inverse: bool) -> Column:
    m = F.floor(F.size(values) / 2).cast("int")
    half = lambda a, left: F.slice(a, 1, m) if left else F.slice(a, m + 1, F.size(a) - m)
    mods = F.struct(half(radices, True).alias("l"), half(radices, False).alias("r"))
    start = F.struct(half(values, True).alias("l"), half(values, False).alias("r"))
    sign = -1 if inverse else 1

    def shifted(own: Column, mod: Column, by: Column) -> Column:
        # the arrays end with the shorter one's length by the slice
        moved = F.zip_with(F.zip_with(own, mod, lambda v, r: F.struct(v.alias("v"), r.alias("r"))), by, lambda p, h: F.pmod(p.v + F.conv(h, 16, 10).cast("bigint") * sign, p.r))
        return F.slice(moved, 1, F.size(own))

    def step(acc: Column, i: Column) -> Column:
        even = i % 2 == 0
        other = F.when(even, acc.r).otherwise(acc.l)
        own = F.when(even, acc.l).otherwise(acc.r)
        mod = F.when(even, mods.l).otherwise(mods.r)
        new = shifted(own, mod, _shifts(key, kind, i, other))
        return F.struct(F.when(even, new).otherwise(acc.l).alias("l"), F.when(even, acc.r).otherwise(new).alias("r"))

    turns = F.sequence(F.lit(rounds - 1), F.lit(0)) if inverse else F.sequence(F.lit(0), F.lit(rounds - 1))
    many = F.aggregate(turns, start, step, lambda acc: F.concat(acc.l, acc.r))
    alone = F.array(_single(F.element_at(values, 1), F.element_at(radices, 1), kind, key, inverse))
    return F.when(F.size(values) == 1, alone).when(F.size(values) > 1, many).otherwise(values)


LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"


def characters(text: Column, kind: str, key: str, inverse: bool = False, fixed: Column | None = None) -> Column:
    """Digits and ASCII letters permuted, each within its class; the first `fixed` characters and all others stay and don't count."""
    first = F.lit(0) if fixed is None else fixed

    def symbol(c: Column, i: Column) -> Column:
        r = F.when(i < first, 0).when(c.rlike("[0-9]"), 10).when(c.rlike("[A-Za-z]"), 26).otherwise(0)
        v = F.lit(0)
        for a in (DIGITS, LOWER, UPPER):
            v = F.when(F.lit(a).contains(c), F.position(c, F.lit(a)) - 1).otherwise(v)
        return F.struct(c.alias("c"), r.alias("r"), v.alias("v"))

    def written(c: Column, v: Column) -> Column:
        at = v.cast("int") + 1
        return F.when(c.rlike("[0-9]"), v.cast("string")).when(c.rlike("[a-z]"), F.substring(F.lit(LOWER), at, F.lit(1))).otherwise(F.substring(F.lit(UPPER), at, F.lit(1)))

    def replaced(symbols: Column) -> Column:
        own = F.filter(symbols, lambda x: x.r > 0)
        new = feistel(F.transform(own, lambda x: x.v), F.transform(own, lambda x: x.r), F.lit(kind), key, inverse=inverse)

        def laid_out(values: Column) -> Column:
            # a symbol's value is found by how many permuted ones come before it
            start = F.struct(F.lit("").alias("text"), F.lit(0).alias("n"))
            step = lambda acc, x: F.when(x.r > 0, F.struct(F.concat(acc.text, written(x.c, F.element_at(values, acc.n + 1))).alias("text"), (acc.n + 1).alias("n"))).otherwise(F.struct(F.concat(acc.text, x.c).alias("text"), acc.n.alias("n")))
            return F.aggregate(symbols, start, step, lambda acc: acc.text)

        return _let(new, laid_out)

    return _let(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), symbol), replaced)


def luhn(digits: Column) -> Column:
    """The sum of Luhn's check over all digits of a string, modulo 10."""
    d = F.reverse(F.filter(F.split(F.regexp_replace(digits, "[^0-9]", ""), ""), lambda c: c != ""))
    each = F.transform(d, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10


def _card(m: Column, key: str, inverse: bool) -> Column:
    body = F.substring(m, F.lit(1), F.char_length(m) - 1)
    checked = lambda new: F.concat(new, F.pmod(10 - luhn(F.concat(new, F.lit("0"))), F.lit(10)).cast("string"))
    return F.when(luhn(m) == 0, _let(characters(body, "card", key, inverse), checked))


def _cards_of_run(run: Column, key: str, inverse: bool) -> Column:
    """(text, n): a run of groups of digits with its n card numbers replaced; they begin and end with a group and don't overlap."""

    def replaced(tokens: Column) -> Column:
        # digits and separators alternate: groups are the even tokens
        last = F.size(tokens) - 1
        joined = lambda i, j: F.array_join(F.slice(tokens, i + 1, F.greatest(F.lit(0), j - i)), "")

        def spans(i: Column) -> Column:
            ends = F.sequence(i, F.least(i + 36, last), F.lit(2))
            return F.transform(ends, lambda j: F.struct(i.alias("i"), j.alias("j"), joined(i, j + 1).alias("m")))

        digits = lambda x: F.char_length(F.regexp_replace(x.m, "[^0-9]", ""))
        valid = F.filter(F.flatten(F.transform(F.sequence(F.lit(0), last, F.lit(2)), spans)), lambda x: digits(x).between(13, 19) & (luhn(x.m) == 0))
        best = F.array_sort(F.transform(valid, lambda x: F.struct(
            ((x.i > 0) | (x.j < last)).alias("part"), (~x.m.rlike(CARD_SHAPE)).alias("odd"), (-digits(x)).alias("short"), x.i.alias("i"), x.j.alias("j"), x.m.alias("m"))))
        none = F.filter(best, lambda x: F.lit(False))
        picked = F.aggregate(best, none, lambda acc, x: F.when(F.exists(acc, lambda y: (x.i <= y.j) & (y.i <= x.j)), acc).otherwise(F.concat(acc, F.array(x))))
        ordered = F.array_sort(F.transform(picked, lambda x: F.struct(x.i.alias("i"), x.j.alias("j"), _card(x.m, key, inverse).alias("new"))))
        start = F.struct(F.lit("").alias("text"), F.lit(0).alias("at"), F.lit(0).alias("n"))
        step = lambda acc, x: F.struct(F.concat(acc.text, joined(acc["at"], x.i), x.new).alias("text"), (x.j + 1).alias("at"), (acc.n + 1).alias("n"))
        return F.aggregate(ordered, start, step, lambda acc: F.struct(F.concat(acc.text, joined(acc["at"], last + 1)).alias("text"), acc.n.alias("n")))

    return _let(F.regexp_extract_all(run, F.lit(r"\d+|[ \-]"), 0), replaced)


def _cards(gap: Column, key: str, inverse: bool = False) -> Column:
    """(text, n): a text with its n card numbers replaced."""

    def replaced(runs: Column) -> Column:
        parts = F.zip_with(F.split(gap, CARD_RUN, -1), runs, lambda g, r: F.concat(g, F.coalesce(r.text, F.lit(""))))
        return F.struct(F.array_join(parts, "").alias("text"), F.aggregate(runs, F.lit(0), lambda n, r: n + r.n).alias("n"))

    runs = F.transform(F.regexp_extract_all(gap, F.lit(CARD_RUN), 0), lambda r: _cards_of_run(r, key, inverse))
    return F.when(gap.rlike(CARD_RUN), _let(runs, replaced)).otherwise(F.struct(gap.alias("text"), F.lit(0).alias("n")))


def _email(m: Column, key: str, inverse: bool) -> Column:
    local = F.substring_index(m, "@", 1)
    valid = ~local.rlike(r"^\.|\.\.|\.$")
    return F.when(valid, F.concat(characters(local, "email", key, inverse), F.substr(m, F.char_length(local) + 1)))


def _phone(m: Column, key: str, inverse: bool) -> Column:
    code = F.regexp_extract(m, r"^\+\d{1,3}", 0)
    digits = F.char_length(F.regexp_replace(m, "[^0-9]", ""))
    valid = digits.between(8, 15) & ~code.startswith("+0")
    return F.when(valid, characters(m, "phone", key, inverse, F.char_length(code)))


def _numbers(m: Column, sep: str) -> Column:
    return F.transform(F.split(m, sep), lambda x: x.cast("bigint"))


def _address(m: Column, key: str, inverse: bool) -> Column:
    def replaced(octets: Column) -> Column:
        new = feistel(octets, F.array(*[F.lit(256)] * 4), F.lit("address"), key, inverse=inverse)
        return F.when(F.forall(octets, lambda o: o < 256), F.array_join(F.transform(new, lambda o: o.cast("string")), "."))

    return F.when(~m.rlike(r"(^|\.)0\d"), _let(_numbers(m, r"\."), replaced))


def _ssn(m: Column, key: str, inverse: bool) -> Column:
    def shown(new: Column) -> Column:
        a, group, serial = (F.element_at(new, i) + 1 for i in (1, 2, 3))
        return F.concat_ws("-", *(F.lpad(x.cast("string"), w, "0") for x, w in ((F.when(a >= 666, a + 1).otherwise(a), 3), (group, 2), (serial, 4))))

    def replaced(n: Column) -> Column:
        area, group, serial = (F.element_at(n, i) for i in (1, 2, 3))
        valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
        values = F.array(area - F.when(area > 666, 2).otherwise(1), group - 1, serial - 1)
        return F.when(valid, _let(feistel(values, F.array(F.lit(898), F.lit(99), F.lit(9999)), F.lit("ssn"), key, inverse=inverse), shown))

    return _let(_numbers(m, "-"), replaced)


def _date(m: Column, key: str, inverse: bool) -> Column:
    iso, sep, padded = m.rlike(r"^\d{4}-"), F.regexp_extract(m, r"\D", 0), m.rlike(r"^\d{2}\D\d{2}\D")
    hi, lo = DATE_RADICES

    def days_of(n: Column) -> Column:
        year, month, day = (F.when(iso, F.element_at(n, i)).otherwise(F.element_at(n, 4 - i)) for i in (1, 2, 3))
        text = F.concat_ws("-", *(F.lpad(x.cast("string"), w, "0") for x, w in ((year, 4), (month, 2), (day, 2))))
        return F.date_diff(F.try_to_date(text, "yyyy-MM-dd"), F.lit(FIRST_DAY).cast("date"))

    def shown(day: Column) -> Column:
        dd, mm = (F.when(padded, F.date_format(day, f)).otherwise(F.date_format(day, f[0])) for f in ("dd", "MM"))
        return F.when(iso, F.date_format(day, "yyyy-MM-dd")).otherwise(F.concat(dd, sep, mm, sep, F.date_format(day, "yyyy")))

    def replaced(days: Column) -> Column:
        new = feistel(F.array(F.floor(days / lo), (days % lo).cast("bigint")), F.array(F.lit(hi), F.lit(lo)), F.lit("date"), key, inverse=inverse)
        day = _let(new, lambda v: F.date_add(F.lit(FIRST_DAY).cast("date"), (F.element_at(v, 1) * lo + F.element_at(v, 2)).cast("int")))
        return F.when(days.between(0, SPAN - 1), _let(day, shown))

    return _let(_let(_numbers(m, r"\D"), days_of), replaced)


def _mod_97(text: Column) -> Column:
    """A string of digits and capital letters (A is 10) as a number, modulo 97."""
    def step(acc: Column, c: Column) -> Column:
        letter = F.position(c, F.lit(UPPER))
        return F.when(letter > 0, (acc * 100 + letter + 9) % 97).otherwise((acc * 10 + c.try_cast("int")) % 97).cast("int")

    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0), step)


def _iban(m: Column, key: str, inverse: bool) -> Column:
    plain = lambda x: F.replace(x, F.lit(" "), F.lit(""))
    turned = lambda x, check: F.concat(F.substr(plain(x), F.lit(5)), F.substring(x, 1, 2), check)
    valid = F.char_length(plain(m)).between(15, 34) & (_mod_97(turned(m, F.substring(m, 3, 2))) == 1)

    def checked(new: Column) -> Column:
        check = F.lpad((98 - _mod_97(turned(new, F.lit("00")))).cast("string"), 2, "0")
        return F.concat(F.substring(new, 1, 2), check, F.substr(new, F.lit(5)))

    return F.when(valid, _let(characters(m, "iban", key, inverse, F.lit(4)), checked))


REPLACE: dict[str, Callable[[Column, str, bool], Column]] = {
    "email": _email, "date": _date, "ssn": _ssn, "address": _address, "phone": _phone, "iban": _iban,
}


def pseudonym(match: Column, key: str, inverse: bool = False) -> Column:
    """The pseudonym of one candidate other than a card number, or null where it isn't valid; the value again if inverse."""
    out = F.lit(None).cast("string")
    for kind in reversed(REPLACE):
        out = F.when(match.rlike(f"^(?:{PATTERNS[kind]})$"), REPLACE[kind](match, key, inverse)).otherwise(out)
    return out


def pseudonymize(docs: DataFrame, key: str, text_col: str = "text", inverse: bool = False) -> DataFrame:
    """docs with the text column replaced and, last, the number of values replaced (n_private).

    With inverse=True values come back from their pseudonyms. A run of digits in which more than one choice of card
    numbers is valid may be read in another way then; every other value is found again, since formats and check digits stay.
    """
    found, gaps, count = fresh(docs, "found", "gaps", "n_private")
    text = F.col(text_col)
    hint = text.rlike(HINT)

    def other(m: Column) -> Column:
        # what looks like a value of another kind and isn't may still hold card numbers
        new = F.struct(pseudonym(m, key, inverse).alias("text"), F.lit(1).alias("n"))
        return _let(new, lambda x: F.when(x.text.isNotNull(), x).otherwise(_cards(m, key, inverse)))

    out = docs.withColumn(found, F.transform(F.when(hint, F.regexp_extract_all(text, F.lit(ANY), 0)), other))
    out = out.withColumn(gaps, F.transform(F.when(hint, F.split(text, ANY, -1)), lambda g: _cards(g, key, inverse)))
    joined = F.zip_with(F.col(gaps), F.col(found), lambda g, f: F.concat(g.text, F.coalesce(f.text, F.lit(""))))
    n = sum((F.aggregate(F.col(c), F.lit(0), lambda a, x: a + x.n) for c in (found, gaps)), F.lit(0))
    return out.select(
        *(F.coalesce(F.array_join(joined, ""), text).alias(c) if c == text_col else F.col(c) for c in docs.columns),
        F.coalesce(n, F.lit(0)).alias(count),
    )


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymize(documents(spark, sf_dir).select("doc_id", "text"), QUERY_KEY)
