"""Operator 2: format-preserving pseudonyms for personal data, by keyed Feistel networks in column expressions.

One pattern finds candidates; each is validated (card numbers by the Luhn sum, addresses by their ranges, dates by the
calendar) and then mapped by a keyed permutation of the values of its own format. Equal values get equal pseudonyms
in every document, different values different ones, and what does not validate stays as it is. No Python runs on
the executors.
"""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenora.plans.staging import fresh

KEY_SETTING = "spark.tenora.pseudonym.key"
ROUNDS = 8
_OWN_KEYS: dict[str, str] = {}

# The formats looked for.
EMAIL = r"[A-Za-z0-9](?:[A-Za-z0-9._%+-]{0,62}[A-Za-z0-9_%+-])?@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.){1,126}[A-Za-z]{2,24}"  # 127 labels at most
PHONE = r"\+\d{1,3} ?\(\d{2,4}\) ?\d{3}[ -]?\d{4}|\+\d{1,3}[ -]\d{3}[ -]\d{3}[ -]\d{4}|\(\d{3}\) ?\d{3}-\d{4}|\d{3}-\d{3}-\d{4}|\+[1-9]\d{7,14}"
#: International numbers in groups of any size, national ones with a leading zero, and dotted ones; the first are of 8 to 15 digits.
GROUPED = r"\+\d{1,3}(?:[ .-]\(?\d{1,5}\)?)?(?:[ .-]\d{2,8}){1,4}"
NATIONAL = r"\(?0\d{1,4}\)?[ -]\d{3,4}[ -]\d{3,4}|\d{3}\.\d{3}\.\d{4}"
IPV6 = r"(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}|::(?:[0-9A-Fa-f]{1,4}:){0,5}[0-9A-Fa-f]{1,4}"
CARD = r"\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}"
SSN = r"\d{3}-\d{2}-\d{4}"
IPV4 = r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}"
ISO_DATE, SLASH_DATE = r"\d{4}-\d{2}-\d{2}", r"\d{2}/\d{2}/\d{4}"
DATE = rf"{ISO_DATE}|{SLASH_DATE}"

#: Alternatives in order of precedence. No match begins or ends inside a longer run of letters or digits, but a time may follow a
#: date; a date with slashes does not begin or end at another slash.
_AFTER = r"(?![\w@-]|\.\d)"
_REST = rf"(?:{PHONE}|{GROUPED}|{NATIONAL}|{SSN}|{IPV4}|{CARD}){_AFTER}|{ISO_DATE}(?:(?=[Tt]\d{{2}}:)|{_AFTER})|(?<!/){SLASH_DATE}(?!/){_AFTER}|(?<!:)(?:{IPV6})(?![\w:]|\.\w)"
PATTERN = rf"(?<![A-Za-z0-9._%+@-])(?:{EMAIL})(?![A-Za-z0-9@-])|(?<![\w.+-])(?:{_REST})"
KINDS = ("email", "phone", "card", "ssn", "ipv4", "ipv6", "date")

FIRST_DAY, DAYS, DAYS_LEFT = "1900-01-01", 73049, 17  # 200 years of days, 17 * 4297


def session_key(spark: SparkSession) -> str:
    """The secret key of the session's setting KEY_SETTING; without one, a random key that lasts as long as the application.

    Whoever knows the key can undo the pseudonyms, so none stands in the code. With a random key, equal values are linked
    within one application and not beyond.
    """
    named = spark.conf.get(KEY_SETTING, None)
    return named or _OWN_KEYS.setdefault(spark.sparkContext.applicationId, secrets.token_hex(16))


def _feistel(left: Column, right: Column, sizes: tuple[Column, Column], tweak: Column | str, key: str, rounds: int = ROUNDS) -> tuple[Column, Column]:
    """Permute pairs (left < sizes[0], right < sizes[1]): each round adds a keyed 60-bit number, drawn from one half, to the other."""
    label = tweak if isinstance(tweak, Column) else F.lit(tweak)

    def turn(s: Column, i: Column) -> Column:
        odd = i % 2 == 1
        half = F.when(odd, s["a"]).otherwise(s["b"]).cast("string")
        draw = F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), i.cast("string"), label, half), 256), 1, 15), 16, 10).cast("long")
        return F.when(odd, F.struct(s["a"].alias("a"), F.pmod(s["b"] + draw, sizes[1].cast("long")).alias("b"))).otherwise(F.struct(F.pmod(s["a"] + draw, sizes[0].cast("long")).alias("a"), s["b"].alias("b")))

    state = F.aggregate(F.array(*[F.lit(i) for i in range(rounds)]), F.struct(left.cast("long").alias("a"), right.cast("long").alias("b")), turn)
    return state["a"], state["b"]


def permuted_digits(digits: Column, tweak: str, key: str) -> Column:
    """A keyed permutation of the digit strings of each length, up to 30 digits; one digit is shifted."""
    n = F.length(digits)
    low = F.floor(n / 2).cast("int")
    high = n - low
    a, b = F.substring(digits, F.lit(1), high), F.substring(digits, high + 1, low)
    size = lambda k: F.pow(F.lit(10), k).cast("long")
    x, y = _feistel(a.cast("long"), F.coalesce(F.nullif(b, F.lit("")).cast("long"), F.lit(0)), (size(high), size(low)), F.concat(F.lit(tweak), n.cast("string")), key)
    return F.concat(F.lpad(x.cast("string"), high, "0"), F.when(low > 0, F.lpad(y.cast("string"), low, "0")).otherwise(""))


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum: from the right, every second digit doubled, with its digits added up."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 1, (c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5)).otherwise(c.cast("int")))
    return F.aggregate(each, F.lit(0).cast("long"), lambda s, x: s + x)


def into_format(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced, in order, by ``digits``."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))
    put = lambda s, c: F.when(
        c.between("0", "9"), F.struct(F.concat(s["out"], F.substring(digits, s["at"], F.lit(1))).alias("out"), (s["at"] + 1).alias("at"))
    ).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["at"].alias("at")))
    return F.aggregate(F.split(shape, ""), start, put, lambda s: s["out"])


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, r"\D", "")


def _card(x: Column, key: str) -> Column:
    """A number with another account part: issuer digits stay, the last digit again completes the Luhn sum."""
    d = _digits(x)
    body = F.concat(F.substring(d, 1, 1), permuted_digits(F.substring(d, F.lit(2), F.length(d) - 2), "card", key))
    check = ((10 - luhn_sum(F.concat(body, F.lit("0"))) % 10) % 10).cast("string")
    return into_format(x, F.concat(body, check))


def _phone(x: Column, key: str) -> Column:
    """The country code stays, all other digits are permuted."""
    # without a separator, codes 1 and 7 have one digit and of others two are taken
    code = F.regexp_extract(x, r"^\+(?:\d{1,3}(?=[ (.-])|[17]|\d{2})", 0)
    rest = F.substring(x, F.length(code) + 1, F.length(x))
    return F.concat(code, into_format(rest, permuted_digits(_digits(rest), "phone", key)))


def _ssn(x: Column, key: str) -> Column:
    """A permutation of the valid numbers: areas 001 to 899 but 666, groups 01 to 99, serials 0001 to 9999."""
    area, group, serial = (F.substring(x, at, n).cast("long") for at, n in ((1, 3), (5, 2), (8, 4)))
    place = area - F.when(area > 666, 2).otherwise(1)
    a, b = _feistel(place, (group - 1) * 9999 + serial - 1, (F.lit(898), F.lit(99 * 9999)), "ssn", key)
    padded = lambda n, k: F.lpad(n.cast("long").cast("string"), k, "0")
    return F.concat_ws("-", padded(a + F.when(a >= 665, 2).otherwise(1), 3), padded(F.floor(b / 9999) + 1, 2), padded(b % 9999 + 1, 4))


def _ipv4(x: Column, key: str) -> Column:
    """A permutation of all 32-bit addresses, written as four numbers."""
    parts = F.split(x, r"\.")
    number = lambda i: parts[i].cast("long")
    a, b = _feistel(number(0) * 256 + number(1), number(2) * 256 + number(3), (F.lit(65536), F.lit(65536)), "ipv4", key)
    return F.concat_ws(".", *[p.cast("string") for p in (F.floor(a / 256), a % 256, F.floor(b / 256), b % 256)])


def _ipv6(x: Column, key: str) -> Column:
    """Another address with as many hexadecimal digits in each group; the second half's permutation depends on the first half."""
    d = F.regexp_replace(F.lower(x), "[^0-9a-f]", "")
    n = F.length(d)
    head = F.floor(n / 2).cast("int")

    def moved(part: Column, tweak: Column) -> Column:
        size = F.length(part)
        low = F.floor(size / 2).cast("int")
        number = lambda at, k: F.coalesce(F.conv(F.nullif(F.substring(part, at, k), F.lit("")), 16, 10).cast("long"), F.lit(0))
        wide = lambda k: F.pow(F.lit(16), k).cast("long")
        a, b = _feistel(number(F.lit(1), size - low), number(size - low + 1, low), (wide(size - low), wide(low)), tweak, key)
        text = lambda v, k: F.when(k > 0, F.lpad(F.lower(F.conv(v.cast("string"), 10, 16)), k, "0")).otherwise("")
        return F.concat(text(a, size - low), text(b, low))

    first, second = F.substring(d, F.lit(1), head), F.substring(d, head + 1, n - head)
    # halves are moved one after the other, so that a value of one digit has an empty first half
    out = F.concat(F.when(head > 0, moved(first, F.concat(F.lit("ipv6 first "), n.cast("string")))).otherwise(""), moved(second, F.concat(F.lit("ipv6 second "), n.cast("string"), F.lit(" "), first)))
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))
    put = lambda s, c: F.when(c == ":", F.struct(F.concat(s["out"], c).alias("out"), s["at"].alias("at"))).otherwise(F.struct(F.concat(s["out"], F.substring(out, s["at"], F.lit(1))).alias("out"), (s["at"] + 1).alias("at")))
    text = F.aggregate(F.split(x, ""), start, put, lambda s: s["out"])
    return F.when(x.rlike("[A-F]"), F.upper(text)).otherwise(text)


def _day(x: Column) -> Column:
    """The date, or null if there is no such day in the years that are permuted."""
    iso = F.when(x.contains("/"), F.concat_ws("-", F.substring(x, 7, 4), F.substring(x, 1, 2), F.substring(x, 4, 2))).otherwise(x)
    day = F.try_to_timestamp(iso, F.lit("yyyy-MM-dd")).cast("date")
    n = F.datediff(day, F.lit(FIRST_DAY).cast("date"))
    return F.when(n.between(0, DAYS - 1), n)


def _day_first(x: Column) -> Column:
    """Is this a date that can only be read day/month/year, in the years that are permuted?"""
    day = F.try_to_timestamp(F.concat_ws("-", F.substring(x, 7, 4), F.substring(x, 4, 2), F.substring(x, 1, 2)), F.lit("yyyy-MM-dd"))
    return x.contains("/") & (F.substring(x, 1, 2) > "12") & F.coalesce(F.year(day).between(1900, 2099), F.lit(False))


def _day_first_date(x: Column, key: str) -> Column:
    """Another such date. Days 13 to 28, 29 and 30, 31, and the 29th of February are permuted each among themselves."""
    d, m, y = (F.substring(x, at, n).cast("long") for at, n in ((1, 2), (4, 2), (7, 4)))
    long = F.array(*[F.lit(i) for i in (1, 3, 5, 7, 8, 10, 12)])
    most = F.array(*[F.lit(i) for i in (1, *range(3, 13))])
    place = lambda months: F.array_position(months, m.cast("int")) - 1
    leap = (d == 29) & (m == 2)
    pick = lambda early, february, last, others: F.when(d <= 28, early).when(leap, february).when(d == 31, last).otherwise(others)
    left = pick((y - 1900) * 12 + m - 1, (y - 1904) / 4, y - 1900, y - 1900).cast("long")
    right = pick(d - 13, F.lit(0), place(long), place(most) * 2 + d - 29).cast("long")
    sizes = pick(F.lit(2400), F.lit(49), F.lit(200), F.lit(200)), pick(F.lit(16), F.lit(1), F.lit(7), F.lit(22))
    a, b = _feistel(left, right, sizes, F.concat(F.lit("day-first"), pick(F.lit("a"), F.lit("b"), F.lit("c"), F.lit("d"))), key, 12)
    year = pick(F.floor(a / 12) + 1900, a * 4 + 1904, a + 1900, a + 1900)
    month = pick(a % 12 + 1, F.lit(2), F.get(long, b.cast("int")), F.get(most, F.floor(b / 2).cast("int")))
    day = pick(b + 13, F.lit(29), F.lit(31), b % 2 + 29)
    two = lambda n: F.lpad(n.cast("long").cast("string"), 2, "0")
    return F.concat(two(day), F.lit("/"), two(month), F.lit("/"), year.cast("long").cast("string"))


def _date(x: Column, key: str) -> Column:
    """Another day of 1900 to 2099, written as the first was (year-month-day, month/day/year or, past the 12th, day/month/year)."""
    n = _day(x)
    wide = DAYS // DAYS_LEFT
    a, b = _feistel(F.floor(n / wide), n % wide, (F.lit(DAYS_LEFT), F.lit(wide)), "date", key, 12)
    day = F.date_add(F.lit(FIRST_DAY).cast("date"), (a * wide + b).cast("int"))
    return F.when(_day_first(x), _day_first_date(x, key)).when(x.contains("/"), F.date_format(day, "MM/dd/yyyy")).otherwise(F.date_format(day, "yyyy-MM-dd"))


def _email(x: Column, key: str) -> Column:
    """An address below ``.invalid``: keyed 48-bit names stand for the user and for the domain, so equal domains stay equal.

    Names have no fixed length to permute within, hence a keyed hash here and not a permutation.
    """
    domain = F.substring_index(x, "@", -1)
    name = lambda part, label: F.substring(F.sha2(F.concat(F.lit(f"{key}|{label}|"), F.lower(part)), 256), 1, 12)
    return F.concat(F.lit("u"), name(x, "user"), F.lit("@d"), name(domain, "domain"), F.lit(".invalid"))


def kind_of(x: Column) -> Column:
    """Which of ``KINDS`` a candidate is once validated; null if it is none."""
    octets = F.forall(F.split(x, r"\."), lambda p: (p.cast("int") <= 255) & ((F.length(p) == 1) | ~p.startswith("0")))
    d = _digits(x)
    return (
        F.when(x.contains("@"), "email")
        .when(x.rlike(rf"^(?:{PHONE}|{NATIONAL})$"), "phone")
        .when(x.startswith("+"), F.when(F.length(d).between(8, 15), "phone"))
        .when(x.contains(":"), F.when(x.rlike("[0-9]"), "ipv6"))
        .when(x.rlike(rf"^{SSN}$"), F.when(~F.substring(x, 1, 3).isin("000", "666") & ~x.startswith("9") & (F.substring(x, 5, 2) != "00") & (F.substring(x, 8, 4) != "0000"), "ssn"))
        .when(x.rlike(rf"^{IPV4}$"), F.when(octets, "ipv4"))
        .when(x.rlike(rf"^(?:{DATE})$"), F.when(_day(x).isNotNull() | _day_first(x), "date"))
        .when(F.length(d).between(13, 19) & (luhn_sum(d) % 10 == 0) & (F.length(F.replace(d, F.lit("0"), F.lit(""))) > 0), "card")
    )


def pseudonym(x: Column, kind: Column, key: str) -> Column:
    """What stands for a candidate of a kind; the candidate itself if it is of none."""
    return (
        F.when(kind == "email", _email(x, key))
        .when(kind == "phone", _phone(x, key))
        .when(kind == "card", _card(x, key))
        .when(kind == "ssn", _ssn(x, key))
        .when(kind == "ipv4", _ipv4(x, key))
        .when(kind == "ipv6", _ipv6(x, key))
        .when(kind == "date", _date(x, key))
        .otherwise(x)
    )


def pseudonymise(docs: DataFrame, text_col: str = "text", key: str | None = None, found_col: str | None = None) -> DataFrame:
    """``docs`` with personal data in ``text_col`` replaced; ``found_col``, if named, lists what was found by kind.

    ``found_col`` is an array of kinds in order of place, empty where there is none. Null texts stay null, empty ones
    empty; all other columns pass unchanged and every row is kept, repeated ones too. The text is cut at the matches
    of one pattern, so the work is linear in its length. ``key`` is the session's (:func:`session_key`) unless given. An
    empty table gives an empty result.
    """
    key = key or session_key(docs.sparkSession)
    text, place = F.col(f"`{text_col}`"), fresh(docs, "hits")
    found = F.col(place)
    # a text without a digit or an at sign holds none of the formats
    out = docs.withColumn(place, F.when(text.rlike(r"[0-9@]"), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))))
    pieces = F.split(text, PATTERN, -1)
    kinds = fresh(docs, "kinds")
    out = out.withColumn(kinds, F.transform(found, kind_of))
    again = F.zip_with(pieces, F.zip_with(found, F.col(kinds), lambda h, k: pseudonym(h, k, key)), lambda gap, h: F.concat(gap, F.coalesce(h, F.lit(""))))
    out = out.withColumn(text_col, F.when(F.size(found) > 0, F.array_join(again, "")).otherwise(text))
    if found_col:
        out = out.withColumn(found_col, F.coalesce(F.filter(kinds, lambda k: k.isNotNull()), F.array().cast("array<string>")))
    return out.drop(place, kinds)


def op2_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = pseudonymise(docs, found_col="found")
    n = [F.expr(f"size(filter(found, k -> k = '{kind}'))").alias(f"n_{kind}") for kind in KINDS]
    return out.select("doc_id", "text", *n, F.size("found").alias("n_found"))
