"""Personal values in texts and their keyed, format-preserving pseudonyms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
WALKS = 64  # steps of a cycle walk; each lands inside the format with a chance over 0.8
FIRST_DAY, LAST_DAY = "1900-01-01", "2099-12-31"
DAYS = 73_049
DAY_HALF = 271  # 271 x 271 is the smallest square that covers the days

EMAIL = r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}"
ADDRESS = r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}"
DATE = r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}([/.])[0-9]{2}\1[0-9]{4}"
SOCIAL = r"[0-9]{3}-[0-9]{2}-[0-9]{4}"
PHONE = r"(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}"
CARD = r"[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}"
KINDS = ("email", "address", "date", "social", "phone", "card")
NUMBERS = "|".join(f"(?:{p})" for p in (ADDRESS, DATE.replace(r"\1", "[/.]").replace("([/.])", "[/.]"), SOCIAL, PHONE, CARD))
# A value starts and ends where letters and digits do; an address is no part of a longer dotted number.
CANDIDATE = rf"(?<![A-Za-z0-9._%+-])(?:{EMAIL})|(?<![A-Za-z0-9.+-])(?:{NUMBERS})(?![A-Za-z0-9]|[.-][0-9])"

DATE_FORMATS = (("yyyy-MM-dd", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), ("dd/MM/yyyy", r"^[0-9]{2}/[0-9]{2}/[0-9]{4}$"), ("dd.MM.yyyy", r"^[0-9]{2}\.[0-9]{2}\.[0-9]{4}$"))


def _bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _whole(x: Column, by: Column | int) -> Column:
    """Integer division."""
    return F.call_function("div", x, F.lit(by))


def feistel(x: Column, left: Column, right: Column, key: str, kind: str, reverse: bool = False) -> Column:
    """A keyed permutation of 0 .. left * right - 1: alternating rounds add a keyed hash of one half to the other."""

    def hashed(i: Column, half: Column, size: Column) -> Column:
        digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), half.cast("string")), 256)
        return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint"), size)

    sign = F.lit(-1 if reverse else 1)

    def step(s: Column, i: Column) -> Column:
        new_left = F.pmod(s["l"] + sign * hashed(i, s["r"], left), left)
        new_right = F.pmod(s["r"] + sign * hashed(i, s["l"], right), right)
        return F.when(i % 2 == 0, F.named_struct(F.lit("l"), new_left, F.lit("r"), s["r"])).otherwise(F.named_struct(F.lit("l"), s["l"], F.lit("r"), new_right))

    rounds = F.sequence(F.lit(ROUNDS - 1), F.lit(0)) if reverse else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    start = F.named_struct(F.lit("l"), _whole(x, right), F.lit("r"), F.pmod(x, right))
    return F.aggregate(rounds, start, step, lambda s: s["l"] * right + s["r"])


def walked(x: Column, left: Column, right: Column, key: str, kind: str, valid: Callable[[Column], Column], reverse: bool = False) -> Column:
    """The permutation repeated until the value is valid; of valid values it is a permutation again."""

    def step(s: Column, _i: Column) -> Column:
        return F.when(s["ok"], s).otherwise(
            _bound(feistel(s["v"], left, right, key, kind, reverse), lambda y: F.named_struct(F.lit("v"), y, F.lit("ok"), valid(y)))
        )

    start = F.named_struct(F.lit("v"), x, F.lit("ok"), F.lit(False))
    return F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), start, step, lambda s: s["v"])


def _power(k: Column) -> Column:
    return F.pow(F.lit(10.0), k).cast("bigint")


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def refilled(form: Column, digits: Column) -> Column:
    """``form`` with its digits replaced in order."""
    chars = F.filter(F.split(form, ""), lambda c: c != "")

    def put(c: Column, i: Column) -> Column:
        before = F.length(digits_of(F.array_join(F.slice(chars, F.lit(1), i), "")))
        return F.when(c.rlike("[0-9]"), F.substring(digits, before + 1, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(chars, put), "")


def luhn_sum(digits: Column) -> Column:
    backwards = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")
    doubled = F.transform(backwards, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((2 * c.cast("int")) % 10 + F.floor(c.cast("int") / 5).cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda a, b: a + b)


def social_valid(n: Column) -> Column:
    area, group, serial = _whole(n, 1_000_000), _whole(n, 10_000) % 100, n % 10_000
    return (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)


def day_number(text: Column) -> Column:
    """Days since the first day of the format; null for what is no date or out of range."""
    parsed = F.lit(None).cast("date")
    for form, shape in DATE_FORMATS:
        parsed = F.when(text.rlike(shape), F.to_date(F.try_to_timestamp(text, F.lit(form)))).otherwise(parsed)
    return F.when(parsed.between(F.lit(FIRST_DAY), F.lit(LAST_DAY)), F.datediff(parsed, F.lit(FIRST_DAY)).cast("bigint"))


def kind_of(match: Column) -> Column:
    """Kind of a validated value; null for a candidate that is none."""
    octets = F.split(match, r"\.")
    digits = digits_of(match)
    return (
        F.when(match.contains("@"), F.lit("email"))
        .when(match.rlike(f"^(?:{ADDRESS})$"), F.when(F.forall(octets, lambda o: o.cast("int") <= 255), F.lit("address")))
        .when(match.rlike(r"^(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[/.][0-9]{2}[/.][0-9]{4})$"), F.when(day_number(match).isNotNull(), F.lit("date")))
        .when(match.rlike(f"^(?:{SOCIAL})$"), F.when(social_valid(digits.cast("bigint")), F.lit("social")))
        .when(match.rlike(f"^(?:{CARD})$"), F.when((luhn_sum(digits) % 10 == 0) & ~digits.startswith("0"), F.lit("card")))
        .when(match.rlike(f"^(?:{PHONE})$"), F.lit("phone"))
    )


def pseudonym(match: Column, kind: Column, key: str, reverse: bool = False) -> Column:
    """The pseudonym of a value of this kind; a value without a kind stays."""
    digits = digits_of(match)
    size = F.length(digits)
    always = lambda _y: F.lit(True)
    # Cards: all but the check digit, which is computed anew.
    body, n = F.substring(digits, F.lit(1), size - 1).cast("bigint"), size - 1
    half = _whole(n, 2).cast("int")
    moved = F.lpad(walked(body, _power(half), _power(n - half), key, "card", lambda y: y >= _power(n - 1), reverse).cast("string"), n, F.lit("0"))
    card = _bound(moved, lambda b: F.concat(b, F.pmod(10 - luhn_sum(F.concat(b, F.lit("0"))) % 10, F.lit(10)).cast("string")))
    national = F.substring(digits, size - 9, F.lit(10))
    phone = F.concat(
        F.substring(digits, F.lit(1), size - 10),
        F.lpad(walked(national.cast("bigint"), F.lit(100_000), F.lit(100_000), key, "phone", always, reverse).cast("string"), 10, "0"),
    )
    social = F.lpad(walked(digits.cast("bigint"), F.lit(10_000), F.lit(100_000), key, "social", social_valid, reverse).cast("string"), 9, "0")
    number = F.aggregate(F.split(match, r"\."), F.lit(0).cast("bigint"), lambda a, o: a * 256 + o.cast("bigint"))
    octet = lambda y, by: (_whole(y, by) % 256).cast("string")
    address = _bound(
        walked(number, F.lit(65_536), F.lit(65_536), key, "address", always, reverse),
        lambda y: F.concat_ws(".", octet(y, 1 << 24), octet(y, 1 << 16), octet(y, 1 << 8), octet(y, 1)),
    )
    day = F.date_add(F.lit(FIRST_DAY).cast("date"), walked(day_number(match), F.lit(DAY_HALF), F.lit(DAY_HALF), key, "date", lambda y: y < DAYS, reverse).cast("int"))
    date = F.when(match.rlike(DATE_FORMATS[0][1]), F.date_format(day, DATE_FORMATS[0][0]))
    for form, shape in DATE_FORMATS[1:]:
        date = date.when(match.rlike(shape), F.date_format(day, form))
    email = F.concat(F.lit("user."), F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.lower(match)), 256), 1, 20), F.lit("@example.invalid"))
    return (
        F.when(kind == "email", match if reverse else email).when(kind == "address", address).when(kind == "date", date)
        .when(kind == "social", refilled(match, social)).when(kind == "phone", refilled(match, phone)).when(kind == "card", refilled(match, card))
        .otherwise(match)
    )


def private_values(text: Column) -> Column:
    """``(value, kind)`` of every validated value, in order, repeats kept."""
    return F.filter(_judged(text), lambda v: v["kind"].isNotNull())


def _judged(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(f"({CANDIDATE})")), lambda m: F.named_struct(F.lit("value"), m, F.lit("kind"), kind_of(m)))


def pseudonymized(text: Column, key: str, reverse: bool = False) -> Column:
    """The whole text with each personal value replaced; a text without any stays as it is."""
    pieces = F.transform(_judged(text), lambda v: pseudonym(v["value"], v["kind"], key, reverse))
    between = F.split(text, CANDIDATE)
    joined = F.concat(F.get(between, F.lit(0)), F.array_join(F.transform(pieces, lambda p, i: F.concat(p, F.get(between, i + 1))), ""))
    return F.when(text.rlike(CANDIDATE), joined).otherwise(text)


def pseudonymize(documents: DataFrame, key: str, *, text_col: str = "text", reverse: bool = False) -> DataFrame:
    """The documents with all their columns and pseudonyms in ``text_col``.

    Addresses, dates from 1900 to 2099, social security, phone and card numbers are
    validated and permuted under ``key`` within their format, so equal values stay
    equal across documents and ``reverse`` restores them. Emails become a keyed
    digest, which only links. Row-local; a null text stays null, an empty or clean
    text stays as it is, repeated rows get equal texts, an empty table stays empty.
    """
    return documents.withColumn(text_col, pseudonymized(F.col(text_col).cast("string"), key, reverse))


def is_kind(kind: str) -> Callable[[Column], Column]:
    return lambda v: v["kind"] == kind
