"""Format-preserving pseudonyms for personal data, with DataFrame functions only.

Found values are checked (card numbers by their check digit, calendar dates, octets, number areas) and replaced inside
the text by a keyed permutation of their own format: a Feistel network over the digits and letters for e-mail
addresses, telephone, card and other long numbers and hexadecimal keys, and over a mixed-radix pair for IPv4 addresses, social security numbers and
dates. Separators, letter case and length stay (an octet may gain or lose a digit), so do an address's top-level domain, a
phone's country code and a card's valid check digit. Under one key equal values get equal pseudonyms in every document and different
values of a format different ones; ``decrypt=True`` gives the values back.

Each text is changed where it lies, without a shuffle. A null text stays null; texts without a finding (empty ones too) stay as they
are. Null ids pass through and repeated rows are treated each. Only the id and text columns are read by ``pseudonymise``, so others
may have any name.

Formats: ``name@host.tld`` · ``+1 (234) 567-8901`` and the same with spaces, dots or hyphens · four octets · 13 to 19 digits, also in groups
of four by spaces or hyphens · ``123-45-6789`` · dates ``1985-03-07``, ``1985/03/07``, ``07.03.1985``, ``03/07/1985`` (month first
where that is a date, else day first; of all formats, only day-first slashed dates may share a pseudonym with another value), years 1700 to 2099 (one whole cycle of the calendar) · 32 to 64 hexadecimal digits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
KEY = "tidemark-pseudonyms"

#: bounded repeats keep the search linear in texts without white space
EMAIL = r"(?<![A-Za-z0-9])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}+@(?:[A-Za-z0-9-]{1,63}+\.){1,8}[A-Za-z]{2,24}"
HEX = r"(?<![A-Za-z0-9])(?=[0-9]*[A-Fa-f])(?=[A-Fa-f]*[0-9])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![A-Za-z0-9])"
PHONE = r"(?<![\w+])\+?\d{1,3}[ .-]?\(\d{3}\)[ .-]?\d{3}[ .-]?\d{4}(?!\d)|(?<![\w+])\+\d{1,3}[ .-]\d{3}[ .-]\d{3}[ .-]\d{4}(?!\d)"
DATE = r"(?<![\d.])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4})(?!\d)"
IPV4 = r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\d|\.\d)"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
NUMBER = r"(?<!\d)(?:\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{1,7}|\d{13,19})(?!\d)"
ANY = "|".join((EMAIL, HEX, PHONE, DATE, IPV4, SSN, NUMBER))

_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"


def _keyed(key: Column | str, *parts) -> Column:
    """A number below 2^60 from the key and ``parts``."""
    key = F.lit(key) if isinstance(key, str) else key
    return F.conv(F.substring(F.sha2(F.concat_ws("|", key, *[p.cast("string") for p in parts]), 256), 1, 15), 16, 10).cast("long")


def _feistel_text(value: Column, kind: str, key: str, decrypt: bool, letters: int = 26) -> Column:
    """Permute the ASCII letters and digits of ``value`` within their classes; other characters stay.

    The characters are cut into two halves; each round shifts the characters of one half by a keyed function of the
    other half, of the round and of the place."""
    cut = F.floor(F.length(value) / 2).cast("int")

    def shifted(half: Column, other: Column, turn: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            by = _keyed(key, F.lit(kind), turn, i, other)
            by = -by if decrypt else by
            shift = F.lit(None).cast("string")
            for alphabet, size in ((_DIGITS, 10), (_LOWER[:letters], letters), (_UPPER[:letters], letters)):
                place = F.instr(F.lit(alphabet), c)
                moved = F.pmod(place - 1 + F.pmod(by, F.lit(size)), F.lit(size)).cast("int") + 1
                # the character class alone decides; keyed numbers are taken only for characters that move
                shift = F.when(place > 0, F.substring(F.lit(alphabet), moved, F.lit(1))).otherwise(F.coalesce(shift, c))
            return shift
        return F.array_join(F.transform(F.split(half, ""), one), "")

    start = F.struct(F.substring(value, F.lit(1), cut).alias("a"),
                     F.substring(value, cut + 1, F.length(value)).alias("b"))
    turns = list(range(ROUNDS))[::-1 if decrypt else 1]

    def turn(acc: Column, i: Column) -> Column:
        even = i % 2 == 0
        return F.struct(F.when(even, shifted(acc["a"], acc["b"], i)).otherwise(acc["a"]).alias("a"),
                        F.when(even, acc["b"]).otherwise(shifted(acc["b"], acc["a"], i)).alias("b"))

    return F.aggregate(F.array(*map(F.lit, turns)), start, turn, lambda acc: F.concat(acc["a"], acc["b"]))


def _feistel_pair(high: Column, m: int, low: Column, n: int, kind: str, key: str, decrypt: bool, finish) -> Column:
    """Permute the pairs (high < m, low < n): ``finish(high, low)``."""
    turns = list(range(ROUNDS))[::-1 if decrypt else 1]
    sign = -1 if decrypt else 1

    def turn(acc: Column, i: Column) -> Column:
        even = i % 2 == 0
        a = F.pmod(acc["a"] + F.pmod(F.lit(sign) * _keyed(key, F.lit(kind), i, acc["b"]), F.lit(m)), F.lit(m))
        b = F.pmod(acc["b"] + F.pmod(F.lit(sign) * _keyed(key, F.lit(kind), i, acc["a"]), F.lit(n)), F.lit(n))
        return F.struct(F.when(even, a).otherwise(acc["a"]).alias("a"), F.when(even, acc["b"]).otherwise(b).alias("b"))

    start = F.struct(high.cast("long").alias("a"), low.cast("long").alias("b"))
    return F.aggregate(F.array(*map(F.lit, turns)), start, turn, lambda acc: finish(acc["a"], acc["b"]))


def _check_sum(digits: Column) -> Column:
    """The sum of the check-digit rule over ``digits`` with the last digit in place."""
    def add(acc: Column, c: Column) -> Column:
        d = c.cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.struct((acc["s"] + F.when(acc["odd"], twice).otherwise(d)).alias("s"), (~acc["odd"]).alias("odd"))

    start = F.struct(F.lit(0).alias("s"), F.lit(False).alias("odd"))
    return F.aggregate(F.split(F.reverse(digits), ""), start, add, lambda acc: acc["s"])


def luhn_valid(digits: Column) -> Column:
    return _check_sum(digits) % 10 == 0


def _card(value: Column, key: str, decrypt: bool) -> Column:
    """A card number: all digits but the last are permuted, the last is made to fit."""
    body = _feistel_text(F.regexp_replace(value, r"\d$", ""), "card", key, decrypt)
    fit = F.pmod(F.lit(10) - _check_sum(F.concat(F.regexp_replace(body, r"\D", ""), F.lit("0"))) % 10, F.lit(10))
    return F.concat(body, fit.cast("int").cast("string"))


def _number(value: Column, key: str, decrypt: bool) -> Column:
    """A long number that is no card number: all digits but the last are permuted, and the last keeps its distance
    to the check digit, so that it doesn't become a card number."""
    digits = F.regexp_replace(value, r"\D", "")
    off = _check_sum(digits) % 10
    body = _feistel_text(F.regexp_replace(value, r"\d$", ""), "number", key, decrypt)
    fit = F.pmod(off - _check_sum(F.concat(F.regexp_replace(body, r"\D", ""), F.lit("0"))), F.lit(10))
    return F.concat(body, fit.cast("int").cast("string"))


def _phone(value: Column, key: str, decrypt: bool) -> Column:
    head = F.regexp_extract(value, r"^(.*?)\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}$", 1)
    return F.concat(head, _feistel_text(F.substring(value, F.length(head) + 1, F.length(value)), "phone", key, decrypt))


def _email(value: Column, key: str, decrypt: bool) -> Column:
    top = F.regexp_extract(value, r"\.[A-Za-z]+$", 0)
    return F.concat(_feistel_text(F.substring(value, F.lit(1), F.length(value) - F.length(top)), "email", key, decrypt), top)


def _octets(value: Column) -> Column:
    return F.transform(F.split(value, r"\."), lambda x: x.cast("long"))


def _ipv4(value: Column, key: str, decrypt: bool) -> Column:
    o = _octets(value)
    return _feistel_pair(o[0] * 256 + o[1], 65536, o[2] * 256 + o[3], 65536, "ipv4", key, decrypt, lambda a, b: F.concat_ws(
        ".", *[x.cast("string") for p in (a, b) for x in (F.floor(p / 256), p % 256)]))


def _ssn_valid(value: Column) -> Column:
    area, group, serial = (F.substring(value, p, n).cast("long") for p, n in ((1, 3), (5, 2), (8, 4)))
    return (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)


def _ssn(value: Column, key: str, decrypt: bool) -> Column:
    area, group, serial = (F.substring(value, p, n).cast("long") for p, n in ((1, 3), (5, 2), (8, 4)))
    index = area - 1 - F.when(area > 666, 1).otherwise(0)

    def finish(a, b):
        return F.format_string("%03d-%02d-%04d", a + 1 + F.when(a >= 665, 1).otherwise(0), F.floor(b / 9999) + 1, b % 9999 + 1)

    return _feistel_pair(index, 898, (group - 1) * 9999 + serial - 1, 99 * 9999, "ssn", key, decrypt, finish)


#: the calendar repeats after 146,097 days = 189 * 773
_DATE_FORMATS = ("yyyy-MM-dd", "yyyy/MM/dd", "dd.MM.yyyy", "MM/dd/yyyy", "dd/MM/yyyy")


def _day(value: Column, form: str) -> Column:
    """Days since 1700-01-01, or null if ``value`` is no date of 1700 to 2099 in this format."""
    day = F.datediff(F.try_to_timestamp(value, F.lit(form)).cast("date"), F.lit("1700-01-01").cast("date"))
    return F.when((day >= 0) & (day < 146_097), day)


def _dates(value: Column, key: str, decrypt: bool) -> Column:
    """The date's pseudonym, or null if it is none."""
    found = F.lit(None).cast("string")
    for form in reversed(_DATE_FORMATS):
        day = _day(value, form)
        new = _feistel_pair(F.floor(day / 773), 189, day % 773, 773, f"date {form}", key, decrypt, lambda a, b, form=form: F.date_format(
            F.date_add(F.lit("1700-01-01").cast("date"), (a * 773 + b).cast("int")), form))
        found = F.when(_shape(value, form) & day.isNotNull(), new).otherwise(found)
    return found


def _shape(value: Column, form: str) -> Column:
    return value.rlike({"yyyy-MM-dd": r"^\d{4}-", "yyyy/MM/dd": r"^\d{4}/", "dd.MM.yyyy": r"^\d{2}\."}.get(form, r"^\d{2}/"))


def kind_of(value: Column) -> Column:
    """What a found value is after its check; null if the check fails."""
    digits = F.regexp_replace(value, r"\D", "")
    octets = F.forall(_octets(value), lambda x: x < 256)
    is_date = F.lit(False)
    for form in _DATE_FORMATS:
        is_date = is_date | (_shape(value, form) & _day(value, form).isNotNull())
    return (F.when(value.contains("@"), "email")
            .when(value.rlike(f"^(?:{HEX})$"), "key")
            .when(value.rlike(f"^(?:{PHONE})$"), "phone")
            .when(value.rlike(f"^(?:{DATE})$"), F.when(is_date, "date"))
            .when(value.rlike(f"^(?:{IPV4})$"), F.when(octets, "ipv4"))
            .when(value.rlike(f"^(?:{SSN})$"), F.when(_ssn_valid(value), "ssn"))
            .when(luhn_valid(digits), "card").otherwise("number"))


def pseudonym(value: Column, kind: Column, key: str = KEY, decrypt: bool = False) -> Column:
    """The pseudonym of one found value; the value itself if its kind is null."""
    return (F.when(kind == "email", _email(value, key, decrypt))
            .when(kind == "key", _feistel_text(value, "key", key, decrypt, letters=6))
            .when(kind == "phone", _phone(value, key, decrypt))
            .when(kind == "date", _dates(value, key, decrypt))
            .when(kind == "ipv4", _ipv4(value, key, decrypt))
            .when(kind == "ssn", _ssn(value, key, decrypt))
            .when(kind == "card", _card(value, key, decrypt))
            .when(kind == "number", _number(value, key, decrypt))
            .otherwise(value))


def _found(text: Column) -> Column:
    """All candidates in order; none of them spans a text without a digit or an at sign."""
    return F.when(text.rlike(r"[0-9@]"), F.regexp_extract_all(text, F.lit(ANY), 0)).otherwise(F.array().cast("array<string>"))


def pseudonymise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: str = KEY,
                 decrypt: bool = False) -> DataFrame:
    """One row per document: doc_id, text (with pseudonyms), n_found (replaced values) and kinds (their kinds in order)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("values", _found(F.col("text")))
    pairs = F.transform("values", lambda v: F.struct(v.alias("value"), kind_of(v).alias("kind")))
    rows = rows.withColumn("pairs", F.when(F.size("values") > 0, pairs))
    new = F.transform("pairs", lambda p: pseudonym(p["value"], p["kind"], key, decrypt))
    between = F.split("text", ANY, -1)
    merged = F.array_join(F.transform(F.arrays_zip(between.alias("t"), new.alias("n")),
                                      lambda z: F.concat(z["t"], F.coalesce(z["n"], F.lit("")))), "")
    kinds = F.filter(F.transform("pairs", lambda p: p["kind"]), lambda k: k.isNotNull())
    kinds = F.coalesce(kinds, F.array().cast("array<string>"))
    return rows.select("doc_id", F.when(F.size("values") > 0, merged).otherwise(F.col("text")).alias("text"),
                       F.size(kinds).alias("n_found"), kinds.alias("kinds"))


def replace_personal(docs: DataFrame, key: str = KEY, text_col: str = "text", count_col: str = "n_chars") -> DataFrame:
    """``docs`` with pseudonyms in its texts and, if it has that column, the length counted anew; all columns stay."""
    whole = docs.select(F.struct(*docs.columns).alias("doc"), F.col(text_col).alias("text"))
    done = pseudonymise(whole, "doc", "text", key)
    length = F.when(F.col("n_found") > 0, F.length("text").cast("long")).otherwise(F.col(f"doc_id.{count_col}")) \
        if count_col in docs.columns else None
    new = {text_col: F.col("text"), count_col: length}
    return done.select(*[(new[c] if new.get(c) is not None else F.col("doc_id")[c]).alias(c) for c in docs.columns])
