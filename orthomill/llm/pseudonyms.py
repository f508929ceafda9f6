"""Format-preserving pseudonyms by keyed Feistel networks, in DataFrame functions only.

Validated numbers and dates (card numbers with a right check digit, phone numbers, network addresses, social
security numbers, bank accounts, calendar dates), mail addresses and long hexadecimal secrets are permuted within their own format, so
equal values stay equal across notes, different values stay different, and a key holder can undo it.
"""

from __future__ import annotations

from calendar import isleap, monthrange
from collections.abc import Callable
from datetime import date
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orthomill.llm.tables import fresh, let

#: What is looked at, in order of precedence. Every alternative starts at the edge of its run, so that a
#: text is scanned in one pass however long its runs are.
MAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*\.[A-Za-z]{2,24}(?![A-Za-z0-9])"
SECRET = r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+)(?![0-9A-Za-z])"
IBAN = r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])"
DATE = r"(?<![0-9.-])(?:(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}|[0-9]{2}[./][0-9]{2}[./](?:19|20)[0-9]{2})(?![0-9-]|\.[0-9])"
ADDRESS = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])"
PHONE = r"(?<![0-9+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ .-]?[0-9]{2,4}){2,3}(?![0-9])|(?<![0-9(])\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![0-9])"
SOCIAL = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
CARD = r"(?<![0-9])[0-9]{4}(?:[ -][0-9]{4}){2}[ -][0-9]{1,7}(?![0-9])|(?<![0-9])[0-9]{13,19}(?![0-9])"
FOUND = "|".join(f"(?:{p})" for p in (MAIL, SECRET, IBAN, DATE, ADDRESS, PHONE, SOCIAL, CARD))
ROUNDS = 8
#: Dates are those of the pattern's years, 1900 to 2099.
FIRST_DAY = (date(1900, 1, 1) - date(1970, 1, 1)).days
DAYS = (date(2100, 1, 1) - date(1900, 1, 1)).days
LEAP_YEARS = sum(map(isleap, range(1900, 2100)))
#: Days from the 13th on, numbered through a leap year: where each month starts, how many there are, and the 29th of February's place.
LATE_STARTS = [0, *accumulate(monthrange(2000, m)[1] - 12 for m in range(1, 12))]
LATE_DAYS = 366 - 12 * 12
LEAP_PLACE = LATE_STARTS[1] + 29 - 13
_LOWER, _UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _is(value: Column, pattern: str) -> Column:
    return value.rlike(f"^(?:{pattern})$")


def _mix(key: str, tweak: Column, turn: Column, half: Column, below: Column) -> Column:
    """A keyed number from 0 to below - 1 (below at most 10**9), from 60 bits of a SHA-256 value."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), tweak, turn.cast("string"), half.cast("string")), 256)
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), below)


def _turns(state: Column, step: Callable[[Column, Column], Column], rounds: int, sign: int) -> Column:
    """``step(state, turn)`` for every turn, in reverse order to undo."""
    order = F.sequence(F.lit(0), F.lit(rounds - 1)) if sign > 0 else F.sequence(F.lit(rounds - 1), F.lit(0), F.lit(-1))
    return F.aggregate(order, state, step)


def _network(left: Column, right: Column, left_size: Column, right_size: Column, key: str, tweak: Column, sign: int = 1,
             rounds: int = ROUNDS) -> Column:
    """A Feistel network on numbers below two sizes: struct ``l``, ``r``; ``sign`` -1 undoes it."""
    left_size, right_size = left_size.cast("long"), right_size.cast("long")

    def step(s: Column, t: Column) -> Column:
        return F.when(t % 2 == 0, F.struct(F.pmod(s.l + sign * _mix(key, tweak, t, s.r, left_size), left_size).alias("l"), s.r.alias("r"))).otherwise(
            F.struct(s.l.alias("l"), F.pmod(s.r + sign * _mix(key, tweak, t, s.l, right_size), right_size).alias("r")))

    return _turns(F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")), step, rounds, sign)


def permute_digits(digits: Column, key: str, tweak: str, sign: int = 1) -> Column:
    """A permutation of the digit strings of a length (2 to 18 digits)."""
    def of(d: Column) -> Column:
        n, m = F.length(d), F.floor(F.length(d) / 2).cast("int")
        a, b = F.pow(F.lit(10.0), m).cast("long"), F.pow(F.lit(10.0), n - m).cast("long")
        moved = _network(F.substring(d, F.lit(1), m).cast("long"), F.substring(d, m + 1, n - m).cast("long"), a, b, key,
                         F.concat(F.lit(tweak), n.cast("string")), sign)
        return let(moved, lambda s: F.concat(F.lpad(s.l.cast("string"), m, "0"), F.lpad(s.r.cast("string"), n - m, "0")))
    return let(digits, of)


def _walk(left: Column, right: Column, left_size: int, right_size: int, valid: Callable[[Column], Column], outside: int,
          key: str, tweak: str, sign: int) -> Column:
    """A permutation of the ``valid`` pairs alone: the network is applied until its result is one of them.

    ``outside`` is how many pairs below the sizes are not valid, so no walk takes more than one turn above it.
    """
    def turn(s: Column) -> Column:
        return _network(s.l, s.r, F.lit(left_size), F.lit(right_size), key, F.lit(tweak), sign)

    first = let(F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")), turn)
    return F.aggregate(F.sequence(F.lit(1), F.lit(outside)), first, lambda s, _: F.when(valid(s), s).otherwise(turn(s)))


def permute_days(days: Column, key: str, sign: int = 1) -> Column:
    """A permutation of the day numbers from 1900-01-01 to 2099-12-31."""
    side = 271
    since = days.cast("long") - FIRST_DAY
    moved = _walk(F.floor(since / side), F.pmod(since, F.lit(side)), side - 1, side, lambda s: s.l * side + s.r < DAYS,
                  (side - 1) * side - DAYS, key, "day", sign)
    return let(moved, lambda s: s.l * side + s.r + FIRST_DAY)


def _permute_late_days(month: Column, day: Column, year: Column, key: str, sign: int) -> Column:
    """A permutation of the dates from 1900 to 2099 whose day is 13 or later: struct ``month``, ``day``, ``year``."""
    starts = F.array(*[F.lit(x) for x in LATE_STARTS])

    def leap(y: Column) -> Column:
        return (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))

    moved = _walk(F.get(starts, month - 1) + day - 13, year - 1900, LATE_DAYS, 200,
                  lambda s: (s.l != LEAP_PLACE) | leap(s.r + 1900), 200 - LEAP_YEARS, key, "late", sign)
    return let(moved, lambda s: let(F.size(F.filter(starts, lambda x: x <= s.l)), lambda m: F.struct(
        m.cast("long").alias("month"), (s.l - F.get(starts, m - 1) + 13).alias("day"), (s.r + 1900).alias("year"))))


def permute_text(text: Column, key: str, tweak: str, letters: int = 26, sign: int = 1, rounds: int = 4) -> Column:
    """A permutation of texts that keeps digits digits, lower and upper case letters such, and all else in place.

    ``letters`` is how many letters of the alphabet are used (6 for hexadecimal).
    """
    alphabets = ["0123456789", _LOWER[:letters], _UPPER[:letters]]

    def shifted(half: Column, other: Column, turn: Column) -> Column:
        stream = F.sha2(F.concat_ws("|", F.lit(key), F.lit(tweak), turn.cast("string"), F.length(half).cast("string"), other), 256)

        def one(c: Column, i: Column, stream: Column) -> Column:
            by = sign * F.conv(F.substring(stream, F.pmod(i, F.lit(31)).cast("int") * 2 + 1, F.lit(3)), 16, 10).cast("int")
            out = c
            for letters_of in alphabets:
                at = F.instr(F.lit(letters_of), c)
                out = F.when(at > 0, F.substring(F.lit(letters_of), F.pmod(at - 1 + by, F.lit(len(letters_of))) + 1, F.lit(1))).otherwise(out)
            return out
        return let(stream, lambda x: F.array_join(F.transform(F.filter(F.split(half, ""), lambda c: c != ""), lambda c, i: one(c, i, x)), ""))

    def step(s: Column, t: Column) -> Column:
        return F.when(t % 2 == 0, F.struct(shifted(s.l, s.r, t).alias("l"), s.r.alias("r"))).otherwise(
            F.struct(s.l.alias("l"), shifted(s.r, s.l, t).alias("r")))

    m = F.floor(F.length(text) / 2).cast("int")
    halves = F.struct(F.substring(text, F.lit(1), m).alias("l"), F.substring(text, m + 1, F.length(text)).alias("r"))
    return let(_turns(halves, step, rounds, sign), lambda s: F.concat(s.l, s.r))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _refill(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced, in order, by ``digits``; separators stay."""
    return let(F.filter(F.split(digits, ""), lambda c: c != ""), lambda d: F.aggregate(
        F.filter(F.split(shape, ""), lambda c: c != ""),
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda a, c: F.when(c.between("0", "9"), F.struct(F.concat(a["out"], F.get(d, a["at"])).alias("out"), (a["at"] + 1).alias("at")))
        .otherwise(F.struct(F.concat(a["out"], c).alias("out"), a["at"].alias("at"))), lambda a: a["out"]))


def check_sum(digits: Column) -> Column:
    """The check digit sum of a card number: every second digit from the right doubled, its digits added."""
    return F.aggregate(
        F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), F.struct(F.lit(0).alias("sum"), F.lit(0).alias("at")),
        lambda a, c: let(c.cast("int") * (1 + a["at"] % 2), lambda v: F.struct(
            (a["sum"] + v - F.when(v > 9, F.lit(9)).otherwise(F.lit(0))).alias("sum"), (a["at"] + 1).alias("at"))), lambda a: a["sum"])


def _card(value: Column, key: str, sign: int) -> Column:
    def of(d: Column) -> Column:
        body = permute_digits(F.substring(d, F.lit(1), F.length(d) - 1), key, "card", sign)
        full = let(body, lambda b: F.concat(b, F.pmod(10 - check_sum(F.concat(b, F.lit("0"))) % 10, F.lit(10)).cast("string")))
        return F.when(check_sum(d) % 10 == 0, _refill(value, full)).otherwise(value)
    return let(_digits(value), of)


def _phone(value: Column, key: str, sign: int) -> Column:
    """The country code, which ends at the first mark or after its one to three digits, stays."""
    country = F.regexp_extract(value, r"^\+[0-9]{1,3}(?=[^0-9])|^\+[0-9]", 0)
    rest = F.substring(value, F.length(country) + 1, F.length(value))
    return F.concat(country, _refill(rest, permute_digits(_digits(rest), key, "phone", sign)))


def _address(value: Column, key: str, sign: int) -> Column:
    def of(p: Column) -> Column:
        octet = [F.get(p, i).cast("long") for i in range(4)]
        valid = (F.greatest(*octet) < 256) & (F.length(value) == F.length(F.array_join(F.array(*[o.cast("string") for o in octet]), ".")))
        moved = _network(octet[0] * 256 + octet[1], octet[2] * 256 + octet[3], F.lit(65_536), F.lit(65_536), key, F.lit("address"), sign)
        return F.when(valid, let(moved, lambda s: F.array_join(F.array(*[
            x.cast("string") for x in (F.floor(s.l / 256), s.l % 256, F.floor(s.r / 256), s.r % 256)]), "."))).otherwise(value)
    return let(F.split(value, r"\."), of)


def _slash_date(value: Column, key: str, sign: int) -> Column:
    """Dates with slashes may be read either way, so those that fit only one way, or both, are permuted among their like."""
    def of(p: Column) -> Column:
        a, b, year = (F.get(p, i).cast("long") for i in range(3))
        month, day = F.least(a, b), F.greatest(a, b)

        def written(x: Column, y: Column, z: Column) -> Column:
            return F.concat_ws("/", F.lpad(x.cast("string"), 2, "0"), F.lpad(y.cast("string"), 2, "0"), z.cast("string"))

        both = _network((a - 1) * 12 + b - 1, year - 1900, F.lit(144), F.lit(200), key, F.lit("early"), sign)
        late = _permute_late_days(month, day, year, key, sign)
        in_calendar = day <= F.day(F.last_day(F.try_to_timestamp(written(month, F.lit(1), year), F.lit("MM/dd/yyyy")).cast("date")))
        return F.when((month < 1) | (month > 12), value).when(day < 13, let(both, lambda s: written(
            F.floor(s.l / 12) + 1, s.l % 12 + 1, s.r + 1900))).when(in_calendar, let(late, lambda s: F.when(
                a <= 12, written(s["month"], s["day"], s["year"])).otherwise(written(s["day"], s["month"], s["year"])))).otherwise(value)
    return let(F.split(value, "/"), of)


def _date(value: Column, key: str, sign: int) -> Column:
    out = value
    for pattern, form in ((r"^[0-9]{2}\.", "dd.MM.yyyy"), (r"^[0-9]{4}-", "yyyy-MM-dd")):
        day = F.try_to_date(value, form) if hasattr(F, "try_to_date") else F.try_to_timestamp(value, F.lit(form)).cast("date")
        moved = F.date_format(F.date_from_unix_date(permute_days(F.unix_date(day), key, sign).cast("int")), form)
        out = F.when(value.rlike(pattern) & day.isNotNull(), moved).otherwise(out)
    return F.when(value.contains("/"), _slash_date(value, key, sign)).otherwise(out)


def _mail(value: Column, key: str, sign: int) -> Column:
    at = F.instr(value, "@")
    return F.concat(permute_text(F.substring(value, F.lit(1), at - 1), key, "mail", 26, sign), F.substring(value, at, F.length(value)))


def _social(value: Column, key: str, sign: int) -> Column:
    """Permuted among the numbers that can be given out: area not 000, 666 or from 900, group not 00, serial not 0000."""
    valid = ~value.rlike("^(000|666|9)|-00-|-0000$")

    def of(d: Column) -> Column:
        area, group, serial = (F.substring(d, at, n).cast("long") for at, n in ((1, 3), (4, 2), (6, 4)))
        moved = _network(area - F.when(area > 666, F.lit(2)).otherwise(F.lit(1)), (group - 1) * 9999 + serial - 1,
                         F.lit(898), F.lit(99 * 9999), key, F.lit("social"), sign)
        return let(moved, lambda s: F.concat_ws(
            "-", F.lpad((s.l + F.when(s.l >= 665, F.lit(2)).otherwise(F.lit(1))).cast("string"), 3, "0"),
            F.lpad((F.floor(s.r / 9999) + 1).cast("string"), 2, "0"), F.lpad((s.r % 9999 + 1).cast("string"), 4, "0")))
    return F.when(valid, let(_digits(value), of)).otherwise(value)


def _iban(value: Column, key: str, sign: int) -> Column:
    """The country stays; the account is permuted and its two check digits are made anew."""
    def remainder(text: Column) -> Column:
        numbers = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.when(
            c.between("0", "9"), c).otherwise((F.ascii(c) - 55).cast("string")))
        return F.aggregate(numbers, F.lit(0), lambda a, n: F.pmod(a * F.when(F.length(n) == 2, 100).otherwise(10) + n.cast("int"), F.lit(97)).cast("int"))

    def of(v: Column) -> Column:
        country, check, account = F.substring(v, 1, 2), F.substring(v, 3, 2), F.substring(v, F.lit(5), F.length(v))
        moved = permute_text(account, key, "iban", 26, sign)
        again = let(moved, lambda a: F.concat(country, F.lpad((98 - remainder(F.concat(a, country, F.lit("00")))).cast("string"), 2, "0"), a))
        spaced = F.aggregate(F.filter(F.split(value, ""), lambda c: c != ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("at")), lambda s, c: F.when(
            c == " ", F.struct(F.concat(s["out"], c).alias("out"), s["at"].alias("at"))).otherwise(
            F.struct(F.concat(s["out"], F.substring(again, s["at"], F.lit(1))).alias("out"), (s["at"] + 1).alias("at"))), lambda s: s["out"])
        return F.when(remainder(F.concat(account, country, check)) == 1, spaced).otherwise(value)
    return let(F.replace(value, F.lit(" "), F.lit("")), of)


def _secret(value: Column, key: str, sign: int) -> Column:
    return F.when(value.rlike("[0-9]") & value.rlike("[A-Fa-f]"), permute_text(value, key, "secret", 6, sign)).otherwise(value)


def pseudonym(value: Column, key: str, sign: int = 1) -> Column:
    """The pseudonym of one matched value; a value that fails its kind's validation stays as it is."""
    kinds: list[tuple[str, Callable]] = [
        (MAIL, _mail), (SECRET, _secret), (IBAN, _iban), (DATE, _date), (ADDRESS, _address), (PHONE, _phone), (SOCIAL, _social), (CARD, _card)]

    def of(v: Column) -> Column:
        out = v
        for pattern, fn in reversed(kinds):
            out = F.when(_is(v, pattern), fn(v, key, sign)).otherwise(out)
        return out
    return let(value, of)


def pseudonymise(text: Column, key: str, sign: int = 1) -> Column:
    """Struct ``text`` and ``n_replaced``: the text with every found value replaced; ``sign`` -1 undoes it."""
    found = F.regexp_extract_all(text, F.lit(FOUND), F.lit(0))

    def rebuilt(f: Column) -> Column:
        new = F.transform(f, lambda v: pseudonym(v, key, sign))
        return let(new, lambda n: F.struct(
            F.array_join(F.zip_with(F.split(text, FOUND, -1), n, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "").alias("text"),
            F.size(F.filter(F.zip_with(f, n, lambda a, b: a != b), lambda x: x)).cast("long").alias("n_replaced")))

    plain = F.struct(text.alias("text"), F.lit(0).cast("long").alias("n_replaced"))
    # Only a text with a digit or an at sign can hold anything of the kind.
    return F.when(text.rlike("[0-9@]"), let(found, rebuilt)).otherwise(plain)


def pseudonymise_notes(feedback: DataFrame, key: str = "feedback-notes", sign: int = 1) -> DataFrame:
    """``feedback`` with its ``notes`` pseudonymised under ``key`` and a column ``n_replaced`` (long), one row per row.

    Needs ``notes``; all other columns pass as they are, but an own ``n_replaced`` is replaced. A null text stays null with
    ``n_replaced`` 0; empty texts stay empty. Equal values get equal pseudonyms in all rows. Numbers that fail
    their check (card digits, octets, calendar) stay. The key is the caller's secret. Texts are taken whole;
    an empty table gives an empty table. A narrow step: no shuffle.
    """
    name = fresh(feedback, "_done")
    done = feedback.withColumn(name, pseudonymise(F.col("notes").cast("string"), key, sign))
    return done.withColumns({"notes": F.col(name)["text"], "n_replaced": F.coalesce(F.col(name)["n_replaced"], F.lit(0).cast("long"))}).drop(name)
