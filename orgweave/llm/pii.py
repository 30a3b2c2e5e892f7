"""Personal data: format-preserving Feistel pseudonyms, in SQL functions alone.

One regular expression finds candidates in the whole text: e-mail addresses, IBANs, dates, social security numbers, telephone
numbers, IPv4 addresses, card and account numbers, and hexadecimal secrets. Those that are valid (a real date, octets up to 255,
the check digits of cards and IBANs, the numbering plan of telephones) are replaced by a keyed permutation within their format: the characters are symbols of small radices, and an unbalanced
Feistel network adds, position by position and modulo its radix, what SHA-256 makes of the key and the other half. So a pseudonym has the length,
the marks and the kind of characters of its value, different values have different pseudonyms, and equal values stay linked across documents.
Dates stay valid dates, in months and days of as many digits, so that every way to write one keeps its length; cards and IBANs get the right check digits;
a telephone's calling code stays. One value has one pseudonym however it is spaced or spelled; what is ambiguous is in the README.

The key in the expressions is a hash of the secret, so plans and event logs don't show the secret itself; who can read them can still undo the pseudonyms.

The text is cut at the matches, the matches are mapped with higher-order functions, and the pieces are joined again: no shuffle, no Python.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.regex import let
from .common import free_name

ROUNDS = 8
_EDGE, _END = r"(?<![0-9A-Za-z])", r"(?![0-9A-Za-z])"
EMAIL = r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@[A-Za-z0-9](?:[A-Za-z0-9\-]{0,62}+\.){1,126}[A-Za-z]{2,24}" + _END
IBAN = _EDGE + r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)" + _END
DATE = (r"(?<![0-9A-Za-z./])(?:(?:19|20)[0-9]{2}([/\-])[01]?[0-9]\1[0-3]?[0-9]|[0-3]?[0-9]([./])[0-3]?[0-9]\2(?:19|20)[0-9]{2}|[0-3][0-9]/[0-3][0-9]/[0-9]{2})"
        r"(?=T[0-9]{2}:|(?![./]?[0-9A-Za-z]))")
SSN = _EDGE + r"[0-9]{3}-[0-9]{2}-[0-9]{4}" + _END
PHONE = (r"(?:(?<![0-9A-Za-z+])\+[0-9]{1,3}[ .\-]?(?:\([0-9]{1,4}\)[ .\-]?)?[0-9]{2,4}(?:[ .\-]?[0-9]{2,4}){1,4}|(?<![0-9A-Za-z+])\([0-9]{3}\)[ .\-]?[0-9]{3}[ .\-][0-9]{4}"
         r"|(?<![0-9A-Za-z+])[0-9]{3}[ .\-][0-9]{3}[ .\-][0-9]{4})" + _END)
IPV4 = r"(?<![0-9A-Za-z.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?!\.?[0-9A-Za-z])"
CARD = _EDGE + r"[0-9](?:[ \-]?[0-9]){12,18}" + _END
SECRET = _EDGE + r"(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+)" + _END
#: In the order in which they are tried at a place.
KINDS = (("email", EMAIL), ("secret", SECRET), ("iban", IBAN), ("date", DATE), ("ssn", SSN), ("phone", PHONE), ("card", CARD), ("ipv4", IPV4))
ANY = "|".join(f"(?:{p})" for _, p in KINDS)
#: First year and number of years whose dates are permuted: with four digits, with two.
YEARS, SHORT_YEARS = (1900, 200), (2000, 100)
#: Month and day of a common year's days, by whether each has one digit or two: within such a list, every way to write a date keeps its length.
DAYS = {(short_month, short_day): [f"{m:02}-{d:02}" for m in range(1, 13) for d in range(1, (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)[m - 1] + 1)
                                   if (m < 10, d < 10) == (short_month, short_day)] for short_month in (True, False) for short_day in (True, False)}
#: Calling codes of one and two digits; all others have three.
CALLING_CODE = "^(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
#: How dates are written; of two that a text fits the first is taken.
DATE_FORMS = ("yyyy-MM-dd", "yyyy/MM/dd", "yyyy-M-d", "yyyy/M/d", "dd.MM.yyyy", "d.M.yyyy", "MM/dd/yyyy", "dd/MM/yyyy", "M/d/yyyy", "d/M/yyyy", "MM/dd/yy", "dd/MM/yy")
#: A longer text is permuted in blocks of half as many characters, so that the work grows with its length.
LONGEST = 128
#: The session's setting with the secret of the permutation.
KEY_CONF = "spark.orgweave.pii.key"


def session_key(spark: SparkSession) -> str:
    """The session's secret; where none is set, one is drawn and set, so values are linked within the session alone."""
    if spark.conf.get(KEY_CONF, None) is None:
        spark.conf.set(KEY_CONF, secrets.token_hex(16))
    return spark.conf.get(KEY_CONF)


def salted(secret: str) -> str:
    """The key of the permutations, made of the secret."""
    return hashlib.sha256(f"pseudonyms|{secret}".encode()).hexdigest()


def feistel(values: Column, radices: Column, tag: Column, key: str, inverse: bool = False) -> Column:
    """A keyed bijection of vectors ``values`` (array<int>) with 0 <= values[i] < radices[i], or its inverse.

    In odd rounds the first half is shifted by hashes of the second, in even rounds the other way round.
    """
    half = F.floor(F.size(values) / 2).cast("int")

    def shifted(vector: Column, r: Column) -> Column:
        odd = r % 2 == 1
        other = F.when(odd, F.slice(vector, half + 1, F.size(vector) - half)).otherwise(F.slice(vector, F.lit(1), half))
        seed = F.concat_ws("|", F.lit(key), tag, r.cast("string"), F.array_join(F.transform(other, lambda v: v.cast("string")), ","))

        def step(v: Column, i: Column, seed: Column) -> Column:
            moves = F.when(odd, i < half).otherwise(i >= half)
            drawn = F.conv(F.substring(F.sha2(F.concat_ws("|", seed, i.cast("string")), 256), 1, 12), 16, 10).cast("long")
            radix = F.get(radices, i)
            return F.when(moves & (radix > 1), F.pmod(v.cast("long") - drawn if inverse else v.cast("long") + drawn, radix.cast("long")).cast("int")).otherwise(v)

        return let(seed, lambda once: F.transform(vector, lambda v, i: step(v, i, once)))

    rounds = (F.lit(ROUNDS), F.lit(1), F.lit(-1)) if inverse else (F.lit(1), F.lit(ROUNDS))
    return F.aggregate(F.sequence(*rounds), values, shifted)


def permute_text(text: Column, tag: str, key: str, hexadecimal: bool = False) -> Column:
    """Letters go to letters of their case, digits to digits (hexadecimal: digits of its case); everything else stays. A long text goes by blocks."""
    half = LONGEST // 2
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.length(text) - 1) / half)), lambda i: F.substr(text, (i * half + 1).cast("int"), F.lit(half)))
    pieces = F.when(F.length(text) > LONGEST, cut).otherwise(F.array(text))
    return F.array_join(F.transform(pieces, lambda p, i: _permute(p, F.concat_ws("|", F.lit(tag), i.cast("string")), key, hexadecimal)), "")


def _permute(text: Column, tag: Column, key: str, hexadecimal: bool) -> Column:
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    lower = "0123456789abcdef" if hexadecimal else "abcdefghijklmnopqrstuvwxyz"
    upper = "0123456789ABCDEF" if hexadecimal else lower.upper()
    digits = "0123456789"

    def alphabet(c: Column) -> Column:
        if hexadecimal:
            return F.when(text.rlike("[A-F]"), F.lit(upper)).otherwise(F.lit(lower))
        return (F.when(c.rlike("^[0-9]$"), F.lit(digits)).when(c.rlike("^[a-z]$"), F.lit(lower))
                .when(c.rlike("^[A-Z]$"), F.lit(upper)).otherwise(c))

    values = F.transform(chars, lambda c: F.position(c, alphabet(c)) - 1)
    radices = F.transform(chars, lambda c: F.length(alphabet(c)))
    form = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "[0-9]", "9"), "[a-z]", "a"), "[A-Z]", "A") if not hexadecimal else F.length(text).cast("string")
    moved = feistel(values, radices, F.concat_ws("|", tag, form), key)
    return F.array_join(F.zip_with(chars, moved, lambda c, v: F.substr(alphabet(c), v + 1, F.lit(1))), "")


def _luhn(digits: Column) -> Column:
    """The check digit that the digits of a string ask for after them."""
    total = F.aggregate(
        F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), lambda c, i: F.when(
            i % 2 == 0, F.floor(c.cast("int") * 2 / 10).cast("int") + (c.cast("int") * 2) % 10).otherwise(c.cast("int"))),
        F.lit(0), lambda a, x: a + x)
    return F.pmod(F.lit(10) - total % 10, F.lit(10))


def _overlay(m: Column, digits: Column) -> Column:
    """``m`` with its digits replaced by ``digits``, one after the other."""
    chars = F.filter(F.split(m, ""), lambda c: c != "")
    start = F.struct(F.lit(0).alias("n"), F.lit("").alias("out"))

    def step(a: Column, c: Column) -> Column:
        is_digit = c.between("0", "9")
        return F.struct((a["n"] + is_digit.cast("int")).alias("n"), F.concat(a["out"], F.when(is_digit, F.substr(digits, a["n"] + 1, F.lit(1))).otherwise(c)).alias("out"))

    return F.aggregate(chars, start, step, lambda a: a["out"])


def _card(m: Column, key: str) -> Column:
    """The digits before the last are permuted, as many as there are, however they are spaced; a wrong check digit means that it is no card number."""
    digits = F.regexp_replace(m, "[ \\-]", "")
    body = F.substr(digits, F.lit(1), F.length(digits) - 1)
    valid = F.substring(digits, -1, 1).cast("int") == _luhn(body)
    return F.when(valid, let(permute_text(body, "card", key), lambda moved: _overlay(m, F.concat(moved, _luhn(moved).cast("string"))))).otherwise(m)


def _mod97(text: Column) -> Column:
    """An IBAN's text, country and check digits last, modulo 97; letters count as 10 to 35."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.position(c, F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ")) - 1)
    return F.aggregate(codes, F.lit(0), lambda a, v: F.when(v > 9, a * 100 + v).otherwise(a * 10 + v) % 97)


def _iban(m: Column, key: str) -> Column:
    """The longest run of whole groups whose check digits are right; what follows it stays."""
    groups = F.split(m, " ")
    squeezed = lambda n: F.array_join(F.slice(groups, F.lit(1), n), "")
    right = lambda s: F.length(s).between(15, 34) & (_mod97(F.concat(F.substr(s, F.lit(5), F.length(s)), F.substring(s, 1, 4))) == 1)
    n = F.get(F.filter(F.sequence(F.size(groups), F.lit(1), F.lit(-1)), lambda n: right(squeezed(n))), F.lit(0))

    def numbered(s: Column) -> Column:
        country = F.substring(s, 1, 2)
        checked = lambda moved: F.concat(country, F.lpad((F.lit(98) - _mod97(F.concat(moved, country, F.lit("00")))).cast("string"), 2, "0"), moved)
        return let(permute_text(F.substr(s, F.lit(5), F.length(s)), "iban", key), checked)

    def made(n: Column) -> Column:
        new = let(squeezed(n), numbered)
        spaced = F.when(n > 1, F.regexp_replace(new, "(.{4})(?=.)", "$1 ")).otherwise(new)
        return F.array_join(F.concat(F.array(spaced), F.slice(groups, n + 1, F.size(groups) - n)), " ")

    return let(n, lambda n: F.when(n.isNotNull(), made(n)).otherwise(m))


def _date(m: Column, key: str) -> Column:
    """The day moves among those whose month and whose day have as many digits, 29 February among leap years; a text that no form writes in this very way is no date."""
    day = lambda form: F.try_to_timestamp(m, form).cast("date")
    form = F.get(F.filter(F.array(*map(F.lit, DATE_FORMS)), lambda f: F.coalesce(F.call_function("date_format", day(f), f) == m, F.lit(False))), F.lit(0))
    number = lambda c: F.floor(c).cast("int")

    def moved(day: Column, form: Column) -> Column:
        short = form.endswith("/yy")
        first, years = (F.when(short, F.lit(a)).otherwise(F.lit(b)) for a, b in zip(SHORT_YEARS, YEARS))
        month_day, year = F.call_function("date_format", day, F.lit("MM-dd")), F.year(day) - first
        leap = month_day == "02-29"
        # 2000 to 2096 have 25 leap years, 1904 to 2096 have 49
        side, first_leap = F.when(short, F.lit(5)).otherwise(F.lit(7)), F.when(short, F.lit(2000)).otherwise(F.lit(1904))
        nth = (F.year(day) - first_leap) / 4
        days = F.lit(None).cast("array<string>")
        for (short_month, short_day), listed in DAYS.items():
            days = F.when(((F.month(day) < 10) == short_month) & ((F.dayofmonth(day) < 10) == short_day), F.array(*map(F.lit, listed))).otherwise(days)

        def permuted(days: Column) -> Column:
            values = F.when(leap, F.array(number(nth / side), number(nth) % side)).otherwise(F.array(year, (F.array_position(days, month_day) - 1).cast("int")))
            radices = F.when(leap, F.array(side, side)).otherwise(F.array(years, F.size(days)))
            got = feistel(values, radices, F.concat_ws("|", F.lit("date"), short.cast("string"), F.array_join(F.transform(radices, lambda r: r.cast("string")), ",")), key)
            date = lambda g: F.when(leap, F.concat_ws("-", ((F.get(g, F.lit(0)) * side + F.get(g, F.lit(1))) * 4 + first_leap).cast("string"), F.lit("02-29"))).otherwise(
                F.concat_ws("-", (F.get(g, F.lit(0)) + first).cast("string"), F.get(days, F.get(g, F.lit(1)))))
            return let(got, lambda g: F.call_function("date_format", date(g).cast("date"), form))

        return let(days, permuted)

    return let(form, lambda f: F.when(f.isNull(), m).otherwise(let(day(f), lambda d: moved(d, f))))


def _ssn(m: Column, key: str) -> Column:
    """Area 001-899 but 666, group 01-99, serial 0001-9999 stay in their ranges."""
    area, group, serial = (F.substring(m, at, n).cast("int") for at, n in ((1, 3), (5, 2), (8, 4)))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    got = feistel(F.array(area - F.when(area > 666, 2).otherwise(1), group - 1, serial - 1),
                  F.array(F.lit(898), F.lit(99), F.lit(9999)), F.lit("ssn"), key)
    new = F.get(got, F.lit(0))
    parts = (F.lpad((new + F.when(new >= 665, 2).otherwise(1)).cast("string"), 3, "0"),
             F.lpad((F.get(got, F.lit(1)) + 1).cast("string"), 2, "0"), F.lpad((F.get(got, F.lit(2)) + 1).cast("string"), 4, "0"))
    return F.when(valid, F.concat_ws("-", *parts)).otherwise(m)


def _digit_list(text: Column) -> Column:
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: c.cast("int"))


def _home(digits: Column, key: str) -> Column:
    """Ten digits of a national number; the area code and the exchange begin with 2 to 9 before and after."""
    least = lambda i: F.when(i.isin(0, 3), 2).otherwise(0)
    values = F.transform(_digit_list(digits), lambda v, i: v - least(i))
    got = feistel(values, F.transform(values, lambda v, i: F.lit(10) - least(i)), F.lit("national phone"), key)
    return F.array_join(F.transform(got, lambda v, i: (v + least(i)).cast("string")), "")


def _phone(m: Column, key: str) -> Column:
    """The digits behind the calling code are permuted, however they are spaced: with ``+``, seven to fifteen digits in all, whose calling code stays, as does a zero in
    brackets; without, ten with an area code and an exchange that begin with 2 to 9. Such a number has one pseudonym with +1 and without."""
    zero = F.regexp_replace(m, "\\(0\\)", "(o)")
    digits = F.regexp_replace(zero, "[^0-9]", "")
    code = F.when(m.startswith("+"), F.regexp_extract(digits, CALLING_CODE, 0)).otherwise("")

    def made(code: Column) -> Column:
        rest = F.substr(digits, F.length(code) + 1, F.length(digits))
        home = rest.rlike("^[2-9][0-9]{2}[2-9][0-9]{6}$") & code.isin("", "1")
        values = _digit_list(rest)
        abroad = F.array_join(F.transform(feistel(values, F.transform(values, lambda v: F.lit(10)), F.concat_ws("|", F.lit("phone"), code, F.size(values).cast("string")), key), lambda v: v.cast("string")), "")
        written = lambda new: F.regexp_replace(_overlay(zero, F.concat(code, new)), "\\(o\\)", "(0)")
        return F.when(home, written(_home(rest, key))).when((code != "") & F.length(digits).between(7, 15), written(abroad)).otherwise(m)

    return let(code, made)


def _email(m: Column, key: str) -> Column:
    """The local part is permuted; the domain stays, so mail of one provider stays together."""
    return F.concat(permute_text(F.substring_index(m, "@", 1), "email", key), F.lit("@"), F.substring_index(m, "@", -1))


def _ipv4(m: Column, key: str) -> Column:
    octets = F.transform(F.split(m, "[.]"), lambda x: x.cast("int"))
    return F.array_join(F.transform(feistel(octets, F.array_repeat(F.lit(256), 4), F.lit("ipv4"), key), lambda v: v.cast("string")), ".")


def _secret(m: Column, key: str) -> Column:
    return permute_text(m, "secret", key, hexadecimal=True)


_MAP: dict[str, Callable[[Column, str], Column]] = {
    "email": _email, "secret": _secret, "iban": _iban, "date": _date, "ssn": _ssn, "phone": _phone, "card": _card, "ipv4": _ipv4}


def pseudonym(value: Column, key: str) -> Column:
    """The pseudonym of one match of ``ANY``; the value itself where it is not valid."""
    out = value
    for kind, pattern in reversed(KINDS):
        out = F.when(value.rlike(f"^(?:{pattern})$"), _MAP[kind](value, key)).otherwise(out)
    return out


def pseudonymize(docs: DataFrame, key: str, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """``docs`` with the personal data of every whole text replaced; all other columns stay.

    A null text stays null; an empty text and one without personal data stay as they are; repeated rows give equal rows; an empty table
    gives no rows. ``count_col`` names a further column (replacing one of that name): the number of values replaced.
    ``key`` is the secret of the permutation.
    """
    key = salted(key)
    _found, _pseudonyms, _text = (free_name(docs, n) for n in ("found", "pseudonyms", "replaced"))
    text = F.col(f"`{text_col}`")
    may = text.rlike("[0-9@]")
    found = F.regexp_extract_all(text, F.lit(ANY), F.lit(0))
    joined = F.array_join(F.zip_with(F.split(text, ANY, -1), F.col(_pseudonyms), lambda p, m: F.concat(p, F.coalesce(m, F.lit("")))), "")
    held = docs.withColumn(_found, F.when(may, found)).withColumn(_pseudonyms, F.transform(F.col(_found), lambda m: pseudonym(m, key)))
    out = held.withColumn(_text, F.when(F.size(_found) > 0, joined).otherwise(text))
    if count_col:
        changed = F.zip_with(_found, _pseudonyms, lambda a, b: (a != b).cast("int"))
        out = out.withColumn(count_col, F.coalesce(F.aggregate(changed, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long"))
    names = [c for c in docs.columns if c != count_col] + ([count_col] if count_col else [])
    return out.select(*[F.col(_text).alias(text_col) if c == text_col else F.col(f"`{c}`") for c in names])
