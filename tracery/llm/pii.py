"""Format-preserving pseudonyms for personal data, by keyed Feistel networks in plain SQL expressions.

One pattern finds candidates; each is validated (card numbers by issuer and check digit, bank accounts by their
checksum, dates by the calendar, addresses by their octets, and so on) and permuted inside its own format: digits stay
digits in the same places, check digits are made valid again, dates stay dates of 1900 to 2099. As each network is a
permutation under a key, equal values get equal pseudonyms in all documents and different values different ones.
What doesn't validate stays as it is.

Kinds: e-mail addresses (the part before @, linked whatever its capitals), IPv4 addresses, international and North
American telephone numbers (the national digits; linked however they are spaced, with the country code or, in North
America, without), US social security numbers, card numbers, IBANs, dates of 1900 to 2099 (year first; day and month
first, of one or two digits; English month names), and secrets (access key ids, values assigned to token, password,
secret or api key). A number written without its country code elsewhere is not recognised.

Defined results: a null text stays null, an empty one empty; other columns pass through untouched, whatever their
names; repeated rows get equal results; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROUNDS = 10
#: Days from 1900-01-01 to 2099-12-31 as the product of the two halves' sizes.
_DAYS = (17, 4297)

_EMAIL = r"(?<![\w.%+-])[\w.%+-]++@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_IP = rf"(?<![\w.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\w|\.\d)"
_PHONE = r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{2,4}\)|\d{2,4})(?:[ .-]?\d{2,4}){2,4}(?!\w)"
_LOCAL_PHONE = r"(?<![\w.(-])(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[.-]\d{4}(?!\w|[.-]\d)"
_SSN = r"(?<![\w.-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?!\w|[.-]\d)"
_ISO_DATE = r"(?<![\w./-])(?:19|20)\d\d([-/])\d{1,2}\1\d{1,2}(?![\w/]|[.-]\d)"
_LATE_DATE = r"(?<![\w./-])\d{1,2}([./-])\d{1,2}\1(?:19|20)\d\d(?![\w/]|[.-]\d)"
_MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
_MONTH = f"(?:{_MONTHS}|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
_NAMED_DATE = rf"(?<![\w.,/-])(?:\d{{1,2}}[.]? {_MONTH} (?:19|20)\d\d|{_MONTH} \d{{1,2}}, (?:19|20)\d\d)(?!\w)"
#: Country codes of telephone numbers have one digit, or two, or else three.
_COUNTRY = r"^(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
_CARD = r"(?<![\w.,-])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4}|\d{4}([ -])\d{6}\2\d{5})(?!\w|[.,-]\d)"
_IBAN = r"(?<!\w)[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?!\w)"
_KEY_ID = r"(?<!\w)AKIA[A-Z0-9]{16}(?!\w)"
_SECRET = r"(?<!\w)(?i:token|password|passwd|secret|api[_-]?key) ?[=:] ?[\"']?[A-Za-z0-9_/+-]{12,}"
_KINDS = {"email": _EMAIL, "secret": _SECRET, "key": _KEY_ID, "iban": _IBAN, "ip": _IP, "ssn": _SSN, "iso_date": _ISO_DATE, "late_date": _LATE_DATE, "named_date": _NAMED_DATE, "card": _CARD, "phone": _PHONE, "local_phone": _LOCAL_PHONE}
#: A text without any of these characters holds no candidate.
_HINT = "[0-9@=:]"


def _numbered(kinds: dict[str, str]) -> str:
    """All patterns as one alternation; back references count from the first group of all."""
    out, groups = [], 0
    for p in kinds.values():
        own = p.count("([")
        for g in range(own, 0, -1):
            p = p.replace(f"\\{g}", f"\\{groups + g}")
        out.append(p)
        groups += own
    return "|".join(out)


CANDIDATES = _numbered(_KINDS)


def keyed(key: Column, kind: str, turn: Column, other: Column) -> Column:
    """The round function: 60 bits from key, kind, round and the other half."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", key, F.lit(kind), turn.cast("string"), other.cast("string")), 256), 1, 15), 16, 10).cast("bigint")


def feistel(a: Column, b: Column, size_a: Column, size_b: Column, key: Column, kind: str) -> Column:
    """Permutes pairs of whole numbers 0 <= a < size_a, 0 <= b < size_b; gives a struct of a and b."""
    start = F.struct(a.cast("bigint").alias("a"), b.cast("bigint").alias("b"))

    def turn(s: Column, i: Column) -> Column:
        first = i % 2 == 0
        return F.struct(
            F.when(first, (s["a"] + keyed(key, kind, i, s["b"]) % size_a) % size_a).otherwise(s["a"]).alias("a"),
            F.when(first, s["b"]).otherwise((s["b"] + keyed(key, kind, i, s["a"]) % size_b) % size_b).alias("b"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def permuted_digits(digits: Column, key: Column, kind: str) -> Column:
    """A string of 2 to 36 digits permuted among those of its length."""

    def halves(d: Column) -> Column:
        n, u = F.length(d), F.floor(F.length(d) / 2).cast("int")
        v = n - u
        tens = lambda k: F.rpad(F.lit("1"), k + 1, "0").cast("bigint")
        out = feistel(F.substring(d, F.lit(1), u), F.substring(d, u + 1, v), tens(u), tens(v), key, kind)
        return _let(out, lambda s: F.concat(F.lpad(s["a"].cast("string"), u, "0"), F.lpad(s["b"].cast("string"), v, "0")))

    return _let(digits, halves)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def refilled(template: Column, digits: Column) -> Column:
    """The template with its digits replaced, in order."""
    start = F.struct(F.lit("").alias("out"), digits.alias("rest"))
    step = lambda s, c: F.struct(
        F.concat(s["out"], F.when(c.rlike("^[0-9]$"), F.substring(s["rest"], 1, 1)).otherwise(c)).alias("out"),
        F.when(c.rlike("^[0-9]$"), F.substring(s["rest"], 2, 64)).otherwise(s["rest"]).alias("rest"),
    )
    return F.aggregate(F.split(template, ""), start, step, lambda s: s["out"])


def _shifted(half: Column, other: Column, key: Column, kind: str, turn: Column, hexadecimal: Column) -> Column:
    """Each character moved within its own alphabet by a byte of the round function."""

    def moved(pad: Column) -> Column:
        def one(i: Column) -> Column:
            c = F.substring(half, i, F.lit(1))
            by = F.conv(F.substring(pad, (i - 1) % 32 * 2 + 1, F.lit(2)), 16, 10).cast("int")
            code = F.ascii(c)
            ring = lambda low, size: F.char((code - low + by) % size + low)
            sixteen = F.lower(F.hex((F.conv(c, 16, 10).cast("int") + by) % 16))
            return (
                F.when(hexadecimal, sixteen)
                .when(c.between("0", "9"), ring(48, 10)).when(c.between("a", "z"), ring(97, 26)).when(c.between("A", "Z"), ring(65, 26)).otherwise(c)
            )

        return F.when(F.length(half) == 0, half).otherwise(F.array_join(F.transform(F.sequence(F.lit(1), F.length(half)), one), ""))

    return _let(F.sha2(F.concat_ws("|", key, F.lit(kind), turn.cast("string"), other), 256), moved)


def permuted_letters(value: Column, key: Column, kind: str) -> Column:
    """A string permuted among those with the same alphabets in the same places (a hexadecimal secret: among those)."""

    def run(v: Column) -> Column:
        u = F.floor(F.length(v) / 2).cast("int")
        hexadecimal = v.rlike("^[0-9a-f]{16,}$") if kind == "secret" else F.lit(False)
        start = F.struct(F.substring(v, F.lit(1), u).alias("a"), F.substring(v, u + 1, F.length(v)).alias("b"))

        def turn(s: Column, i: Column) -> Column:
            first = i % 2 == 0
            return F.struct(
                F.when(first, _shifted(s["a"], s["b"], key, kind, i, hexadecimal)).otherwise(s["a"]).alias("a"),
                F.when(first, s["b"]).otherwise(_shifted(s["b"], s["a"], key, kind, i, hexadecimal)).alias("b"),
            )

        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda s: F.concat(s["a"], s["b"]))

    return _let(value, run)


def check_digit(body: Column) -> Column:
    """The Luhn check digit of a string of digits."""
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(body)), F.lit(0),
        lambda s, i: s + _let(F.substring(body, -i, F.lit(1)).cast("int") * F.when(i % 2 == 1, 2).otherwise(1), lambda d: F.when(d > 9, d - 9).otherwise(d)),
    )
    return ((10 - total % 10) % 10).cast("string")


def _card(m: Column, key: Column) -> Column:
    def run(d: Column) -> Column:
        n = F.length(d)
        valid = d.rlike("^(4|5[1-5]|2[2-7]|3[47]|35|6(011|5|4[4-9]|2))") & (check_digit(F.substring(d, F.lit(1), n - 1)) == F.substring(d, n, F.lit(1)))
        body = F.concat(F.substring(d, F.lit(1), F.lit(6)), permuted_digits(F.substring(d, F.lit(7), n - 7), key, "card"))
        return F.when(valid, refilled(m, _let(body, lambda b: F.concat(b, check_digit(b))))).otherwise(m)

    return _let(_digits(m), run)


def _remainder97(text: Column) -> Column:
    """A string of digits and capitals (A = 10 and so on), modulo 97."""

    def step(s: Column, c: Column) -> Column:
        return F.when(c.between("0", "9"), s * 10 + F.ascii(c) - 48).otherwise(s * 100 + F.ascii(c) - 55) % 97

    return F.aggregate(F.split(text, ""), F.lit(0), step)


def _iban(m: Column, key: Column) -> Column:
    def run(v: Column) -> Column:
        land, account = F.substring(v, 1, 2), F.substring(v, 5, 40)
        valid = _remainder97(F.concat(account, F.substring(v, 1, 4))) == 1
        new = lambda a: F.concat(land, F.lpad((98 - _remainder97(F.concat(a, land, F.lit("00")))).cast("string"), 2, "0"), a)
        out = _let(permuted_letters(account, key, "iban"), new)
        spaced = F.trim(F.regexp_replace(out, "(.{4})", "$1 "))
        return F.when(~valid, m).when(m.contains(" "), spaced).otherwise(out)

    return _let(F.regexp_replace(m, " ", ""), run)


def _as_date(year: Column, month: Column, day: Column) -> Column:
    return F.try_to_date(F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd")


def permuted_date(d: Column, key: Column, shown) -> Column:
    """``shown`` of the day that takes a day's place among all days of 1900 to 2099."""
    k = F.datediff(d, F.lit("1900-01-01").cast("date"))
    out = feistel(F.floor(k / _DAYS[1]), k % _DAYS[1], F.lit(_DAYS[0]).cast("bigint"), F.lit(_DAYS[1]).cast("bigint"), key, "date")
    new = _let(out, lambda s: F.date_add(F.lit("1900-01-01").cast("date"), (s["a"] * _DAYS[1] + s["b"]).cast("int")))
    return _let(new, shown)


def _date(m: Column, key: Column) -> Column:
    parts, mark = F.split(m, "[./-]"), F.regexp_extract(m, "[./-]", 0)
    iso = m.rlike("^[0-9]{4}")
    year, one, two = F.when(iso, parts[0]).otherwise(parts[2]), F.when(iso, parts[1]).otherwise(parts[0]), F.when(iso, parts[2]).otherwise(parts[1])
    # Year last: with a point or hyphen the day is first; with a slash the month is, if that gives a date.
    day_first = ~iso & ((mark != "/") | _as_date(year, one, two).isNull())
    day = F.when(day_first, _as_date(year, two, one)).otherwise(_as_date(year, one, two))
    narrow = (F.length(one) == 1) | (F.length(two) == 1)  # as narrow as it may be, then

    def shown(x: Column) -> Column:
        y = F.date_format(x, "yyyy")
        mo, da = (F.when(narrow, F.date_format(x, p)).otherwise(F.date_format(x, p + p)) for p in ("M", "d"))
        return F.when(iso, F.concat(y, mark, mo, mark, da)).when(day_first, F.concat(da, mark, mo, mark, y)).otherwise(F.concat(mo, mark, da, mark, y))

    return _let(day, lambda d: F.when(d.isNull(), m).otherwise(permuted_date(d, key, shown)))


def _named_date(m: Column, key: Column) -> Column:
    name, day, year = F.regexp_extract(m, "[A-Za-z]+", 0), F.regexp_extract(m, r"(?<!\d)\d{1,2}(?!\d)", 0), F.substring(m, -4, 4)
    first, long = m.rlike("^[0-9]"), F.length(name) > 3
    month = (F.ceil(F.position(F.substring(name, 1, 3), F.lit("JanFebMarAprMayJunJulAugSepOctNovDec")) / 3)).cast("string")

    def shown(x: Column) -> Column:
        mo, da, y = F.when(long, F.date_format(x, "MMMM")).otherwise(F.date_format(x, "MMM")), F.date_format(x, "d"), F.date_format(x, "yyyy")
        return F.when(first, F.concat(da, F.regexp_extract(m, "^[0-9]+([.]? )", 1), mo, F.lit(" "), y)).otherwise(F.concat(mo, F.lit(" "), da, F.lit(", "), y))

    return _let(_as_date(year, month, day), lambda d: F.when(d.isNull(), m).otherwise(permuted_date(d, key, shown)))


def _ip(m: Column, key: Column) -> Column:
    def run(o: Column) -> Column:
        half = lambda i: o[i].cast("bigint") * 256 + o[i + 1].cast("bigint")
        size = F.lit(65536).cast("bigint")
        return _let(
            feistel(half(0), half(2), size, size, key, "ip"),
            lambda s: F.concat_ws(".", *(x.cast("string") for x in (F.floor(s["a"] / 256), s["a"] % 256, F.floor(s["b"] / 256), s["b"] % 256))),
        )

    return _let(F.split(m, r"\."), run)


def _ssn(m: Column, key: Column) -> Column:
    area, group, serial = (F.substring(m, *at).cast("bigint") for at in ((1, 3), (5, 2), (8, 4)))
    # 898 areas without 000, 666 and 9xx; 99 groups; 9999 serials.
    left = (area - 1 - F.when(area > 666, 1).otherwise(0)) * 99 + group - 1

    def shown(s: Column) -> Column:
        a = F.floor(s["a"] / 99) + 1
        a = a + F.when(a >= 666, 1).otherwise(0)
        parts = ((a, 3), (s["a"] % 99 + 1, 2), (s["b"] + 1, 4))
        return F.concat_ws("-", *(F.lpad(x.cast("string"), n, "0") for x, n in parts))

    return _let(feistel(left, serial - 1, F.lit(898 * 99).cast("bigint"), F.lit(9999).cast("bigint"), key, "ssn"), shown)


def _phone(m: Column, key: Column) -> Column:
    """The country code stays; the national digits are permuted among those of their number, whatever stands between."""

    def run(d: Column) -> Column:
        code = F.when(m.contains("+"), F.regexp_extract(d, _COUNTRY, 0)).otherwise("")
        return refilled(m, F.concat(code, permuted_digits(F.substring(d, F.length(code) + 1, F.length(d)), key, "phone")))

    return _let(_digits(m), run)


def _email(local: Column, key: Column) -> Column:
    """The name of an address, permuted in small letters; capitals stand where they stood."""

    def run(new: Column) -> Column:
        at = lambda text, i: F.substring(text, i, F.lit(1))
        one = lambda i: F.when(at(local, i).rlike("^[A-Z]$"), F.upper(at(new, i))).otherwise(at(new, i))
        return F.when(local.rlike("[A-Z]"), F.array_join(F.transform(F.sequence(F.lit(1), F.length(new)), one), "")).otherwise(new)

    return _let(permuted_letters(F.lower(local), key, "email"), run)


def pseudonym(m: Column, key: Column) -> Column:
    """The pseudonym of one candidate; itself if it doesn't validate."""
    whole = lambda kind: m.rlike(f"^(?:{_KINDS[kind]})$")
    local, host = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
    said = F.regexp_extract(m, "^(?:AKIA|.*?[=:] ?[\"']?)", 0)
    return (
        F.when(m.contains("@"), F.concat(_email(local, key), F.lit("@"), host))
        .when(whole("secret") | whole("key"), F.concat(said, permuted_letters(F.substring(m, F.length(said) + 1, F.length(m)), key, "secret")))
        .when(m.rlike("^[A-Z]{2}"), _iban(m, key))
        .when(whole("ip"), _ip(m, key))
        .when(whole("ssn"), _ssn(m, key))
        .when(whole("iso_date") | whole("late_date"), _date(m, key))
        .when(whole("named_date"), _named_date(m, key))
        .when(whole("card"), _card(m, key))
        .otherwise(_phone(m, key))
    )


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """The documents with personal data in the text replaced; all columns stay, in their order."""
    text, secret = docs[text_col], F.lit(key)
    found = F.regexp_extract_all(text, F.lit(CANDIDATES), F.lit(0))
    # The text around the candidates and the pseudonyms take turns.
    joined = F.array_join(F.flatten(F.zip_with(F.split(text, CANDIDATES), F.transform(found, lambda m: pseudonym(m, secret)), lambda t, p: F.array(t, F.coalesce(p, F.lit(""))))), "")
    return docs.withColumn(text_col, F.when(text.rlike(_HINT), joined).otherwise(text))


#: The key of the queries; in production it comes from a secret store.
DEMO_KEY = "corpus-key-1"


def op9_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracery.llm.tables import read

    docs = read(spark, sf_dir, "documents").select("doc_id", "text", F.col("text").alias("before"))
    return pseudonymise(docs, DEMO_KEY).select("doc_id", "text", (~F.col("text").eqNullSafe(F.col("before"))).alias("changed"))
