"""Personal data: keyed, format-preserving pseudonyms, with DataFrame functions only.

Candidates are found by one pattern, validated by kind (check digits, calendar, ranges), and replaced
in place; the text between them stays as it is. Numbers and dates go through a Feistel network over the
values of their format: the same value has the same pseudonym in every document, different values have
different ones, and the result is again valid for its kind (a step that leaves the format walks on).
Rounds and walks are folds over short arrays inside the row, so a document is one row from scan to
result and nothing is shuffled. Names of mailboxes and secrets have no fixed value set; they get keyed
tokens.

| kind | valid when | what stays |
|-|-|-|
| card | 13 to 19 digits, Luhn sum | first digit, separators; the check digit is made anew |
| phone | 10 digits in the shape of a number, whatever the area | country code, punctuation |
| ssn | area, group and serial in use | dashes |
| ip | four parts up to 255 | dots |
| date | a calendar day of 1900 to 2099, in ISO, d/m/y or d.m.y form | form |
| email | a mailbox | domain |
| secret | an access key or a password assignment | prefix |
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

KEY = "corpus-pseudonyms-1"
ROUNDS = 8
WALKS = 64

# Candidates; the order decides where two could begin at the same place.
# A mailbox is tried once a run of its characters, or where another candidate has ended; possessive and
# bounded repeats keep the time linear and the stack flat, whatever the length of the text.
_RUN_START = r"(?:(?<![A-Za-z0-9._%+-])|\G)"
_LABEL = r"[A-Za-z0-9]++(?:-++[A-Za-z0-9]++){0,31}+"
_EMAIL = _RUN_START + rf"[A-Za-z0-9._%+-]++@{_LABEL}(?:\.{_LABEL}){{1,126}}+"
_SECRET = r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}(?![0-9A-Za-z])|password=[^\x20\x09-\x0D]+)"
_ISO = r"(?<![\d.-])\d{4}-\d{2}-\d{2}(?![\d-]|\.\d)"
_DAY = r"(?<![\d./])\d{1,2}([./])\d{1,2}\1\d{4}(?![\d/]|\.\d)"
_SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
_PHONE = r"(?:\+\d{1,3}[ .-]?)\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}(?!\d)|(?<![\d+])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\d.+-])\d{3}-\d{3}-\d{4}(?![\d-])"
_IP = r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d)"
_CARD = r"(?<![\d])(?:\d{13,19}|\d{4} \d{4} \d{4} \d{1,7}|\d{4}-\d{4}-\d{4}-\d{1,7}|\d{4} \d{6} \d{5}|\d{4}-\d{6}-\d{5})(?![\d])"
CANDIDATE = "|".join([_EMAIL, _SECRET, _ISO, _DAY, _SSN, _PHONE, _IP, _CARD])
_FIRST_DAY, _DAYS = "1900-01-01", 73_049


def _whole(m: Column, pattern: str) -> Column:
    """Was the candidate found by this pattern? (Its look-around was tested in place.)"""
    bare = pattern.replace(_RUN_START, "").replace(r"(?<![\d.-])", "").replace(r"(?![\d-]|\.\d)", "").replace(r"(?<![\d./])", "").replace(r"(?![\d/]|\.\d)", "")
    for look in (r"(?<![\d-])", r"(?![\d-])", r"(?!\d)", r"(?<![\d+])", r"(?<![\d.+-])", r"(?<![\d.])", r"(?!\d|\.\d)", r"(?<![\d])", r"(?![\d])", r"(?<![A-Za-z0-9])", r"(?![0-9A-Za-z])"):
        bare = bare.replace(look, "")
    return m.rlike(f"^(?:{bare})$")


def _prf(key: str, *parts: Column) -> Column:
    """A keyed value of 0 to 2**56 - 1."""
    text = F.concat_ws("|", F.lit(key), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 14), 16, 10).cast("bigint")


def feistel(x: Column, a: Column | int, b: Column | int, key: str, tag: str) -> Column:
    """A keyed permutation of 0 .. a*b - 1: halves over Z_a and Z_b are added to in turn."""
    a, b = (c if isinstance(c, Column) else F.lit(c) for c in (a, b))
    a, b = a.cast("bigint"), b.cast("bigint")

    def step(s: Column, r: Column) -> Column:
        left = F.when(r % 2 == 0, (s["l"] + _prf(key, F.lit(tag), a, b, r, s["r"]) % a) % a).otherwise(s["l"])
        right = F.when(r % 2 == 1, (s["r"] + _prf(key, F.lit(tag), a, b, r, s["l"]) % b) % b).otherwise(s["r"])
        return F.struct(left.alias("l"), right.alias("r"))

    start = F.struct(F.floor((x - x % b) / b).cast("bigint").alias("l"), (x % b).cast("bigint").alias("r"))
    rounds = F.array(*[F.lit(i) for i in range(ROUNDS)])
    return F.aggregate(rounds, start, step, lambda s: s["l"] * b + s["r"])


def walked(x: Column, step, inside) -> Column:
    """Apply ``step`` once, and again while the result is not ``inside``: a permutation of what is inside."""

    def once(v: Column, i: Column) -> Column:
        return F.when((i > 0) & inside(v), v).otherwise(step(v))

    return F.aggregate(F.array(*[F.lit(i) for i in range(WALKS)]), x.cast("bigint"), once)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, r"\D", "")


def _pad(x: Column, n: Column) -> Column:
    return F.lpad(x.cast("string"), n, F.lit("0"))


def _refill(m: Column, digits: Column) -> Column:
    """The format of ``m`` with other digits, in order."""
    state = F.struct(F.lit("").alias("out"), F.lit(0).alias("n"))

    def put(s: Column, c: Column) -> Column:
        isdigit = c.rlike("^[0-9]$")
        return F.struct(
            F.concat(s["out"], F.when(isdigit, F.substring(digits, s["n"] + 1, F.lit(1))).otherwise(c)).alias("out"),
            (s["n"] + F.when(isdigit, 1).otherwise(0)).alias("n"),
        )

    return F.aggregate(F.split(m, "(?<=.)(?=.)"), state, put, lambda s: s["out"])


def _digit_sum(payload: Column) -> Column:
    """Luhn sum of digits to which a check digit is still to be added."""
    cells = F.split(F.reverse(payload), "(?<=.)(?=.)")
    doubled = F.transform(cells, lambda c, i: F.when(i % 2 == 0, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda n, x: n + x)


def luhn_check(payload: Column) -> Column:
    return ((10 - _digit_sum(payload) % 10) % 10).cast("string")


def _card(m: Column, key: str) -> tuple[Column, Column]:
    d = _digits(m)
    n = F.length(d)
    body = F.substring(d, F.lit(1), n - 1)
    valid = F.substring(d, n, F.lit(1)) == luhn_check(body)
    inner = n - 2  # between the first digit, which stays, and the check digit
    half = F.floor(inner / 2)
    x = F.substring(d, F.lit(2), inner).cast("bigint")
    new = F.concat(F.substring(d, 1, 1), _pad(feistel(x, F.pow(F.lit(10), half).cast("bigint"), F.pow(F.lit(10), inner - half).cast("bigint"), key, "card"), inner))
    return valid, _refill(m, F.concat(new, luhn_check(new)))


def _phone(m: Column, key: str) -> tuple[Column, Column]:
    d = _digits(m)
    n = F.length(d)
    x = F.substring(d, n - 9, F.lit(10)).cast("bigint")
    new = feistel(x, 100_000, 100_000, key, "phone")
    return F.lit(True), _refill(m, F.concat(F.substring(d, F.lit(1), n - 10), _pad(new, F.lit(10))))


def _ssn(m: Column, key: str) -> tuple[Column, Column]:
    x = _digits(m).cast("bigint")

    def inside(v: Column) -> Column:
        area = F.floor(v / 1_000_000)
        return (area > 0) & (area < 900) & (area != 666) & (F.floor(v / 10_000) % 100 > 0) & (v % 10_000 > 0)

    return inside(x), _refill(m, _pad(walked(x, lambda v: feistel(v, 10_000, 100_000, key, "ssn"), inside), F.lit(9)))


def _ip(m: Column, key: str) -> tuple[Column, Column]:
    part = F.transform(F.split(m, r"\."), lambda p: p.cast("bigint"))
    valid = F.array_max(part) <= 255
    x = F.aggregate(part, F.lit(0).cast("bigint"), lambda n, p: n * 256 + p)
    y = feistel(x, 65_536, 65_536, key, "ip")
    return valid, F.array_join(F.transform(F.array(*[F.lit(k) for k in (24, 16, 8, 0)]), lambda k: (F.floor(y / F.pow(F.lit(2), k)).cast("bigint") % 256).cast("string")), ".")


def _date(m: Column, key: str) -> tuple[Column, Column]:
    iso = m.rlike("^[0-9]{4}-")
    p = F.transform(F.split(m, "[-./]"), lambda c: c.cast("int"))
    y, mo, d = F.when(iso, p[0]).otherwise(p[2]), p[1], F.when(iso, p[2]).otherwise(p[0])
    day = F.try_to_timestamp(F.concat_ws("-", _pad(y, F.lit(4)), _pad(mo, F.lit(2)), _pad(d, F.lit(2))), F.lit("yyyy-MM-dd")).cast("date")
    first = F.lit(_FIRST_DAY).cast("date")
    x = F.datediff(day, first).cast("bigint")

    def inside(v: Column) -> Column:
        return (v >= 0) & (v < _DAYS)

    new = F.date_add(first, walked(x, lambda v: feistel(v, 271, 270, key, "date"), inside).cast("int"))
    mark = F.regexp_extract(m, "[./]", 0)
    wide = F.length(m) == 10  # 1.2.2020 stays without leading zeros
    dm = F.concat_ws("|", F.when(wide, F.date_format(new, "dd|MM")).otherwise(F.date_format(new, "d|M")), F.date_format(new, "yyyy"))
    return F.coalesce(inside(x), F.lit(False)), F.when(iso, F.date_format(new, "yyyy-MM-dd")).otherwise(F.replace(dm, F.lit("|"), mark))


def _email(m: Column, key: str) -> tuple[Column, Column]:
    token = F.substring(F.sha2(F.concat(F.lit(key + "|email|"), F.lower(m)).cast("binary"), 256), 1, 16)
    return F.lit(True), F.concat(F.lit("u"), token, F.lit("@"), F.substring_index(m, "@", -1))


def _secret(m: Column, key: str) -> tuple[Column, Column]:
    token = F.sha2(F.concat(F.lit(key + "|secret|"), m).cast("binary"), 256)
    return F.lit(True), F.when(m.startswith("AKIA"), F.concat(F.lit("AKIA"), F.upper(F.substring(token, 1, 16)))).otherwise(F.concat(F.lit("password="), F.substring(token, 1, 24)))


KINDS = {"email": (_EMAIL, _email), "secret": (_SECRET, _secret), "date": (f"{_ISO}|{_DAY}", _date), "ssn": (_SSN, _ssn), "phone": (_PHONE, _phone), "ip": (_IP, _ip), "card": (_CARD, _card)}


def replacement(m: Column, key: str = KEY) -> Column:
    """struct(kind, value) of a candidate; the kind is null, and the value the candidate, if it is not valid."""
    out = F.struct(F.lit(None).cast("string").alias("kind"), m.alias("value"))
    for kind, (pattern, make) in reversed(KINDS.items()):
        valid, value = make(m, key)
        hit = F.when(valid, F.struct(F.lit(kind).alias("kind"), value.alias("value"))).otherwise(F.struct(F.lit(None).cast("string").alias("kind"), m.alias("value")))
        out = F.when(_whole(m, pattern), hit).otherwise(out)
    return out


def pseudonymise(docs: DataFrame, key: str = KEY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, n_replaced, kinds) of every row; ``kinds`` is a comma-joined sorted list of the kinds replaced.

    A null text stays null, an empty one empty; both, and texts without candidates, have no kinds. Texts
    and mailboxes may have any length; of a host name with over 127 labels the first 127 count, and a
    label with over 32 parts between dashes (no host name has one) makes no mailbox.
    Candidates that are not valid stay as they are. Null and repeated ids pass through, an empty table
    gives no rows, other columns are not read.
    """
    base = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    # most texts have neither digit nor mailbox nor secret and are done after one cheap look
    might = F.col("text").rlike(r"\d|@|password=|AKIA")
    found = F.when(might, F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)))
    some = base.select("doc_id", "text", found.alias("found")).select("doc_id", "text", F.when(F.size("found") > 0, F.col("found")).alias("found"))
    # evaluated once per document: the filter keeps the optimizer from copying the expression
    done = some.withColumn("new", F.transform("found", lambda m: replacement(m, key)))
    between = F.split("text", CANDIDATE, -1)
    rebuilt = F.array_join(F.zip_with(between, F.col("new.value"), lambda gap, v: F.concat(gap, F.coalesce(v, F.lit("")))), "")
    kinds = F.filter("new.kind", lambda k: k.isNotNull())
    return done.select(
        "doc_id",
        F.when(F.col("found").isNull(), F.col("text")).otherwise(rebuilt).alias("text"),
        F.coalesce(F.size(kinds), F.lit(0)).cast("bigint").alias("n_replaced"),
        F.coalesce(F.array_join(F.array_sort(F.array_distinct(kinds)), ","), F.lit("")).alias("kinds"),
    )
