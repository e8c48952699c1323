"""Format-preserving pseudonyms by keyed Feistel permutations, in DataFrame functions only.

Found and validated: e-mail addresses, IPv4 and IPv6 addresses, phone numbers, payment
cards (issuer range and Luhn digit), US social security numbers, IBANs (mod 97), dates
(real calendar days; with slashes the day comes first, unless only the month can),
hexadecimal secrets and common forms of access keys. Each value is permuted within the
values of its own format under a secret key: a card becomes another card with a
right check digit, a day another day, and so on. Equal values get equal pseudonyms
in every document, so they stay linked; different values never meet, and whoever
has the key can undo it (`restore`).

Numbers are split into two halves and go through eight Feistel rounds whose
function is SHA-256 of key, kind, round and the other half. Letters (A to Z
and those of Latin-1 but for a few) and digits of addresses go through the same
network with character-wise sums, each within its class. February 29th written month first moves among the leap years from 1904 to 2096,
and stays in others. Numbers that don't validate (a 16-digit number without a right check digit)
are left alone.

Defined results: a null text stays null and an empty one empty; repeated rows are
treated alike; an empty table gives no rows; other columns pass through, and
nothing is added but `changed`.
"""

from __future__ import annotations

import functools
import secrets
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROUNDS = 8
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
EMAIL = r"(?<![\p{L}0-9._%+-])[\p{L}0-9._%+-]++@[\p{L}0-9-]++(?:\.[\p{L}0-9-]++)+"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
SECRET = r"(?<![A-Za-z0-9])(?=[A-Fa-f]*[0-9])(?=[0-9]*[A-Fa-f])(?:[a-f0-9]{32,128}|[A-F0-9]{32,128})(?![A-Za-z0-9])"
TOKEN = r"(?<![A-Za-z0-9])(?:A[KS]IA[0-9A-Z]{16}|[spr]k_(?:live|test)_[A-Za-z0-9]{16,}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[0-9A-Za-z_-]{35})(?![A-Za-z0-9])"
TOKEN_START = r"^(?:A[KS]IA|[spr]k_(?:live|test)_|gh[pousr]_|xox[abprs]-|AIza)"
_HEX = "[A-Fa-f0-9]{1,4}"
IPV6 = rf"(?<![A-Za-z0-9:.])(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}:){{2,6}}(?::{_HEX}){{1,5}})(?![A-Za-z0-9:])"
IP = rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])"
CARD = r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{4}|[0-9]{4} [0-9]{4} [0-9]{4} [0-9]{4}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])"
PHONE = r"(?<![0-9+])\+[1-9][0-9]{0,2}(?:[ .-]?\(?[0-9]{2,4}\)?){2,5}(?![0-9])|(?<![0-9])\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])|(?<![0-9.-])[0-9]{3}([.-])[0-9]{3}\1[0-9]{4}(?![0-9]|[.-][0-9])|(?<![0-9+.-])0[0-9]{2,4} [0-9]{3,4} [0-9]{3,4}(?![0-9])"
SSN = r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])"
DATE = r"(?<![0-9/.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9/-]|\.[0-9])"
#: Where any of them can begin: not inside a word, unless a number begins there.
START = r"(?:(?<![A-Za-z0-9])|(?=[0-9+(])(?<![0-9]))"
ANY = f"{START}(?:{'|'.join((EMAIL, IBAN, SECRET, TOKEN, IPV6, CARD, IP, SSN, DATE, PHONE))})"


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value evaluated one time, however often it is used."""
    return F.transform(F.array(value), use)[0]


class Feistel:
    """Permutations of text values under a key; with inverse, the way back."""

    def __init__(self, key: str, inverse: bool = False):
        self.key, self.sign = key, -1 if inverse else 1
        order = range(ROUNDS, 0, -1) if inverse else range(1, ROUNDS + 1)
        self.rounds = F.array(*[F.lit(r) for r in order])

    def _f(self, kind: Column, r: Column, other: Column) -> Column:
        """60 bits of the round function."""
        return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(self.key), kind, r.cast("string"), other.cast("string")), 256), 1, 15), 16, 10).cast("long")

    def number(self, x: Column, a: Column, b: Column, kind: Column) -> Column:
        """x in 0 <= x < a * b permuted within that range."""
        return once(F.struct(x.cast("long").alias("x"), a.cast("long").alias("a"), b.cast("long").alias("b"), kind.alias("kind")), lambda v: self._number(v["x"], v["a"], v["b"], v["kind"]))

    def _number(self, x: Column, a: Column, b: Column, kind: Column) -> Column:
        start = F.struct(F.floor(x / b).cast("long").alias("l"), F.pmod(x, b).cast("long").alias("r"))

        def step(s, r):
            even = F.pmod(r, F.lit(2)) == 0
            left = F.when(even, F.pmod(s["l"] + self.sign * F.pmod(self._f(kind, r, s["r"]), a), a)).otherwise(s["l"])
            right = F.when(even, s["r"]).otherwise(F.pmod(s["r"] + self.sign * F.pmod(self._f(kind, r, s["l"]), b), b))
            return F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))

        return F.aggregate(self.rounds, start, step, lambda s: s["l"] * b + s["r"])

    def digits(self, d: Column, kind: str) -> Column:
        """A string of 2 to 18 digits permuted among the strings of its length."""
        n = F.char_length(d)
        half = F.floor(n / 2)
        ten = lambda k: F.pow(F.lit(10.0), k).cast("long")
        return F.lpad(self.number(d.cast("decimal(20,0)").cast("long"), ten(half), ten(n - half), F.concat(F.lit(kind), n.cast("string"))).cast("string"), n, F.lit("0"))

    def characters(self, s: Column, kind: str, letters: int = 26) -> Column:
        """Digits and letters of s permuted each within its class; other characters stay."""
        start = F.split(s, "")
        half = F.floor(F.char_length(s) / 2)

        def step(state, r):
            first = F.pmod(r, F.lit(2)) == 0
            other = F.array_join(F.when(first, F.slice(state, half + 1, F.size(state))).otherwise(F.slice(state, 1, half)), "")
            return once(other, lambda o: turned(state, r, first, o))

        def turned(state, r, first, other):
            def moved(c, i):
                code = F.ascii(c)
                base = F.when(code.between(48, 57), F.lit(48)).when(code.between(97, 122), F.lit(97)).when(code.between(65, 90), F.lit(65)).when(code.between(224, 246), F.lit(224)).when(code.between(192, 214), F.lit(192))
                size = F.when(code < 58, F.lit(10)).when(code < 128, F.lit(letters)).otherwise(F.lit(23))
                shift = F.pmod(self._f(F.concat_ws(":", F.lit(kind), F.size(state), i), r, other), size)
                mine = F.when(first, i < half).otherwise(i >= half)
                return F.when(mine & base.isNotNull(), F.chr(base + F.pmod(code - base + self.sign * shift, size))).otherwise(c)

            return F.transform(state, moved)

        return F.aggregate(self.rounds, start, step, lambda s: F.array_join(s, ""))


def only_digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def refilled(m: Column, digits: Column) -> Column:
    """m with its digits replaced in order."""
    return once(digits, lambda d: _refilled(m, d))


def _refilled(m: Column, digits: Column) -> Column:
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("k"))

    def step(s, c):
        is_digit = c.rlike("^[0-9]$")
        return F.struct(F.concat(s["out"], F.when(is_digit, digits.substr(s["k"], F.lit(1))).otherwise(c)).alias("out"), (s["k"] + is_digit.cast("int")).alias("k"))

    return F.aggregate(F.split(m, ""), start, step, lambda s: s["out"])


def luhn_sum(d: Column) -> Column:
    """Of a string of digits whose last digit is the check digit."""
    n = F.char_length(d)
    value = lambda c, i: F.when(F.pmod(n - i, F.lit(2)) == 0, F.pmod(c.cast("int") * 2, F.lit(10)) + F.floor(c.cast("int") / 5).cast("int")).otherwise(c.cast("int"))
    return F.aggregate(F.transform(F.split(d, ""), value), F.lit(0), lambda a, x: (a + x).cast("int"))


def mod97(s: Column) -> Column:
    """Of an IBAN's characters, letters as 10 to 35, the first four moved to the end."""
    moved = F.concat(F.substring(s, 5, 64), F.substring(s, 1, 4))
    step = lambda a, c: F.pmod(F.when(c.rlike("^[0-9]$"), a * 10 + F.ascii(c) - 48).otherwise(a * 100 + F.ascii(c) - 55), F.lit(97)).cast("int")
    return F.aggregate(F.split(moved, ""), F.lit(0), step)


_DATES = {"-": "yyyy-MM-dd", "/": "dd/MM/yyyy", ".": "dd.MM.yyyy"}


def month_first(m: Column, f: Feistel) -> Column:
    """MM/dd/yyyy, whose day is above 12: month and year move, and the day, among days that they have; a value that is no day stays."""
    month, day, year = (F.substring(m, *x).cast("long") for x in ((1, 2), (4, 2), (7, 4)))
    lack = lambda x, *without: x - sum((F.when(x > k, 1).otherwise(0) for k in without), F.lit(0))  # noqa: E731  the place of a month among those that are left
    give = lambda x, *without: F.element_at(F.array(*[F.lit(k) for k in range(1, 13) if k not in without]), (x + 1).cast("int"))
    text = lambda mm, dd, yy: F.format_string("%02d/%02d/%04d", mm.cast("long"), dd.cast("long"), yy.cast("long"))
    short = once(f.number((year * 12 + month - 1) * 16 + day - 13, F.lit(120000), F.lit(16), F.lit("day13")), lambda x: text(F.pmod(F.floor(x / 16), F.lit(12)) + 1, F.pmod(x, F.lit(16)) + 13, F.floor(x / 192)))
    middle = once(f.number((year * 11 + lack(month, 2) - 1) * 2 + day - 29, F.lit(110000), F.lit(2), F.lit("day29")), lambda x: text(give(F.pmod(F.floor(x / 2), F.lit(11)), 2), F.pmod(x, F.lit(2)) + 29, F.floor(x / 22)))
    long = once(f.number(year * 7 + lack(month, 2, 4, 6, 9, 11) - 1, F.lit(10000), F.lit(7), F.lit("day31")), lambda x: text(give(F.pmod(x, F.lit(7)), 2, 4, 6, 9, 11), F.lit(31), F.floor(x / 7)))
    leap = text(F.lit(2), F.lit(29), f.number(F.floor((year - 1904) / 4).cast("long"), F.lit(7), F.lit(7), F.lit("feb29")) * 4 + 1904)
    out = F.when(day.between(13, 28), short).when(day.between(29, 30) & (month != 2), middle).when((day == 31) & ~month.isin(2, 4, 6, 9, 11), long)
    out = out.when((day == 29) & (month == 2) & year.between(1904, 2096) & (year % 4 == 0), leap)
    return F.when(month.between(1, 12), F.coalesce(out, m)).otherwise(m)


def pseudonym(m: Column, f: Feistel) -> Column:
    """The pseudonym of a found value, or the value itself where it doesn't validate."""
    return once(only_digits(m), lambda d: _pseudonym(m, d, f))


def _pseudonym(m: Column, d: Column, f: Feistel) -> Column:
    n = F.char_length(d)
    # card: the first two digits keep the issuer's range, the last is computed
    body = F.concat(F.substring(d, 1, 2), f.digits(d.substr(F.lit(3), n - 3), "card"))
    card = once(body, lambda x: F.concat(x, F.pmod(10 - F.pmod(luhn_sum(F.concat(x, F.lit("0"))), F.lit(10)), F.lit(10)).cast("string")))
    good_card = d.rlike("^(?:4|5[1-5]|2[2-7]|3[0-9]|6)") & (F.pmod(luhn_sum(d), F.lit(10)) == 0)
    # phone: the last ten digits (all but the first of a shorter international number, all of a national one)
    keep = F.when(n > 10, n - 10).when(m.startswith("+") | m.startswith("0"), F.lit(1)).otherwise(F.lit(0))
    phone = F.concat(d.substr(F.lit(1), keep), f.digits(d.substr(keep + 1, n), "phone"))
    # social security number: area (898 values), group (99) and serial (9999)
    area = F.substring(m, 1, 3).cast("long")
    ssn = f.number(((area - F.when(area > 666, 2).otherwise(1)) * 99 + F.substring(m, 5, 2).cast("long") - 1) * 9999 + F.substring(m, 8, 4).cast("long") - 1, F.lit(898 * 99), F.lit(9999), F.lit("ssn"))
    to_area = lambda x: F.floor(x / 9999 / 99).cast("long") + 1
    ssn = once(ssn, lambda x: F.format_string("%03d-%02d-%04d", (to_area(x) + F.when(to_area(x) > 665, 1).otherwise(0)).cast("long"), F.pmod(F.floor(x / 9999), F.lit(99)).cast("long") + 1, F.pmod(x, F.lit(9999)).cast("long") + 1))
    # address: 32 bits
    octets = F.split(m, r"\.")
    whole = F.aggregate(octets, F.lit(0).cast("long"), lambda a, x: a * 256 + x.cast("long"))
    ip = f.number(whole, F.lit(65536), F.lit(65536), F.lit("ip"))
    ip = once(ip, lambda x: F.concat_ws(".", *[F.pmod(F.shiftright(x, k), F.lit(256)).cast("string") for k in (24, 16, 8, 0)]))
    # IBAN: characters within their classes, then the two check digits
    plain = F.replace(m, F.lit(" "), F.lit(""))
    account = F.concat(F.substring(plain, 1, 2), F.lit("00"), f.characters(F.substring(plain, 5, 64), "iban"))
    account = once(account, lambda x: F.concat(F.substring(x, 1, 2), F.lpad((98 - mod97(x)).cast("string"), 2, "0"), F.substring(x, 5, 64)))
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("k"))
    spaced = lambda x: lambda s, c: F.struct(F.concat(s["out"], F.when(c == " ", c).otherwise(x.substr(s["k"], F.lit(1)))).alias("out"), (s["k"] + (c != " ").cast("int")).alias("k"))
    iban = once(account, lambda x: F.aggregate(F.split(m, ""), start, spaced(x), lambda s: s["out"]))
    # date: a day among the 73,000 from the start of its block (1800-02-17, 1999-12-31, ...)
    out = F.when(m.contains("@"), F.concat(f.characters(F.regexp_extract(m, r"^(.*)(\.[^.]*)$", 1), "email"), F.regexp_extract(m, r"^(.*)(\.[^.]*)$", 2)))
    out = out.when(m.rlike("^[A-Z]{2}[0-9]{2}") & m.rlike(f"^(?:{IBAN})$"), F.when(mod97(plain) == 1, iban).otherwise(m))
    out = out.when(m.rlike(f"^(?:{SECRET})$"), f.characters(m, "secret", 6))
    start_ = F.regexp_extract(m, TOKEN_START, 0)
    out = out.when(start_ != "", F.concat(start_, f.characters(m.substr(F.char_length(start_) + 1, F.char_length(m)), "token")))
    out = out.when(m.contains(":"), F.concat(f.characters(m, "ipv6", 6)))
    out = out.when(m.rlike(f"^(?:{CARD})$"), F.when(good_card, refilled(m, card)).otherwise(m))
    out = out.when(m.rlike(f"^(?:{IP})$"), ip).when(m.rlike(f"^(?:{SSN})$"), ssn)
    for mark, form in _DATES.items():
        day = F.unix_date(F.try_to_timestamp(m, F.lit(form)).cast("date")).cast("long")

        other = month_first(m, f) if mark == "/" else m

        def moved(day):
            block = F.floor(day / 73000)
            to = f.number(F.pmod(day, F.lit(73000)), F.lit(250), F.lit(292), F.concat(F.lit("date"), block.cast("string"))) + block * 73000
            real = day.isNotNull() & day.between(-10 * 73000, 39 * 73000)
            return F.when(real, F.date_format(F.date_from_unix_date(to.cast("int")), form)).otherwise(other)

        shape = {"-": "^[0-9]{4}-[0-9]{2}-[0-9]{2}$", "/": "^[0-9]{2}/[0-9]{2}/[0-9]{4}$", ".": r"^[0-9]{2}\.[0-9]{2}\.[0-9]{4}$"}[mark]
        out = out.when(m.rlike(shape), once(day, moved))  # built here and now
    return out.otherwise(F.when(n.between(8, 15), refilled(m, phone)).otherwise(m))


def pseudonymized(documents: DataFrame, key: str, column: str = "text", inverse: bool = False) -> DataFrame:
    """documents with every found value of the column replaced, and whether that changed it."""
    f = Feistel(key, inverse)
    text = F.col(f"`{column}`")
    # most texts have nothing to replace: one scan tells
    out = documents.withColumn("_found", F.regexp_extract_all(text, F.lit(ANY), F.lit(0)))
    new = F.transform("_found", lambda m: pseudonym(m, f))
    filled = F.array_join(F.zip_with(F.split(text, ANY, -1), new, lambda gap, m: F.concat(gap, F.coalesce(m, F.lit("")))), "")
    out = out.withColumn("_new", F.when(F.size("_found") > 0, filled).otherwise(text)).drop("_found")
    return out.withColumns({"changed": ~F.col("_new").eqNullSafe(text), column: F.col("_new")}).drop("_new")


def restore(documents: DataFrame, key: str, column: str = "text") -> DataFrame:
    return pseudonymized(documents, key, column, inverse=True)


@functools.cache
def _own_key(application: str) -> str:
    return secrets.token_hex(16)


def key_of(spark: SparkSession) -> str:
    """The secret key, from the session's configuration: spark.quillon.pseudonym.key. Where none is set, a random one that holds as long as the application and is kept nowhere."""
    return spark.conf.get("spark.quillon.pseudonym.key", None) or _own_key(spark.sparkContext.applicationId)


def op1_pii_pseudonyms(spark, sf_dir: str) -> DataFrame:
    return pseudonymized(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), key_of(spark))
