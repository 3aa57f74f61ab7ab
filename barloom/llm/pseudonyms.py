"""Format-preserving pseudonyms of personal data in texts, by a keyed Feistel network in SQL functions only.

A value is a list of places, each with a number of states (a digit has ten, an octet 256, a day its place in a cycle of
400 years). The list is cut in halves; in each round a keyed SHA-256 of one half shifts the places of the other,
modulo their states. That is a permutation of all values of the format, so different values stay different, equal
ones stay equal in all documents, and whoever has the key can go back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rounds of the network; even, so that both halves are shifted equally often.
ROUNDS = 8

#: How each kind is written (Java patterns). The first kind that a passage matches counts.
KINDS = {
    "email": r"(?<![\w.+-])[A-Za-z0-9][\w.+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "date": r"(?<![\d./-])(?:\d{4}-\d\d-\d\d|\d{4}/\d\d/\d\d|\d\d\.\d\d\.\d{4}|\d\d/\d\d/\d{4})(?![\d]|[./-]\d)",
    "ip": r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d)",
    "phone": r"(?<![\w+])(?:\+?1[ .-]?)?(?:\([2-9]\d\d\) ?|[2-9]\d\d[.-])[2-9]\d\d[ .-]\d{4}(?!\d)|(?<![\w+])\+[1-9]\d{7,14}(?!\d)",
    "ssn": r"(?<![\d-])\d{3}-\d\d-\d{4}(?![\d-])",
    "card": r"(?<![\d-])\d(?:[ -]?\d){12,18}(?!-?\d)",
    "hex": r"(?<![0-9A-Za-z])[0-9a-f]{32,64}(?![0-9A-Za-z])",
    "access": r"(?<![0-9A-Za-z])AKIA[0-9A-Z]{16}(?![0-9A-Za-z])",
    "password": r"(?<![0-9A-Za-z])password=[^\s\"'<>&]+",
}
_ALL = "|".join(f"(?:{p})" for p in KINDS.values())


def feistel(values: Column, states: Column, key: str, forward: bool = True) -> Column:
    """Permute a list of places (array<int>), given the states of each; ``forward=False`` goes back."""
    cut = F.ceil(F.size(values) / 2).cast("int")
    rest = F.size(values) - cut
    rounds = F.sequence(F.lit(0), F.lit(ROUNDS - 1)) if forward else F.sequence(F.lit(ROUNDS - 1), F.lit(0), F.lit(-1))

    def shifted(own: Column, other: Column, sizes: Column, i: Column) -> Column:
        def one(v: Column, j: Column) -> Column:
            text = F.concat_ws("|", F.lit(key), i.cast("string"), j.cast("string"), F.concat_ws(",", F.transform(other, lambda x: x.cast("string"))))
            amount = F.conv(F.substring(F.sha2(text, 256), 1, 12), 16, 10).cast("long")
            return F.pmod(v + amount if forward else v - amount, F.get(sizes, j)).cast("int")

        return F.transform(own, one)

    left_sizes, right_sizes = F.slice(states, F.lit(1), cut), F.slice(states, cut + 1, rest)
    start = F.struct(F.slice(values, F.lit(1), cut).alias("l"), F.slice(values, cut + 1, rest).alias("r"))
    end = F.aggregate(
        rounds,
        start,
        lambda a, i: F.when(i % 2 == 0, F.struct(shifted(a["l"], a["r"], left_sizes, i).alias("l"), a["r"].alias("r"))).otherwise(
            F.struct(a["l"].alias("l"), shifted(a["r"], a["l"], right_sizes, i).alias("r"))
        ),
    )
    return F.concat(end["l"], end["r"])


def _ints(x: Column) -> Column:
    return F.transform(x, lambda c: c.cast("int"))


def _chars(x: Column) -> Column:
    return F.filter(F.split(x, ""), lambda c: c != "")


def _repeat(n: int, times: Column) -> Column:
    return F.array_repeat(F.lit(n), times.cast("int"))


def _pour(form: Column, digits: Column) -> Column:
    """``form`` with its digits, from left to right, replaced by those of a string of as many."""
    start = F.struct(F.lit("").alias("s"), F.lit(1).alias("k"))
    return F.aggregate(
        _chars(form),
        start,
        lambda a, c: F.when(
            c.rlike("[0-9]"), F.struct(F.concat(a["s"], F.substr(digits, a["k"], F.lit(1))).alias("s"), (a["k"] + 1).alias("k"))
        ).otherwise(F.struct(F.concat(a["s"], c).alias("s"), a["k"].alias("k"))),
    )["s"]


def _luhn(digits: Column) -> Column:
    """Weighted sum of a string of digits; the rightmost weighs one."""
    backward = _ints(_chars(F.reverse(digits)))
    doubled = F.transform(backward, lambda d, i: F.when(i % 2 == 0, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d)


def _card(m: Column, key: str, forward: bool) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    body = F.substr(digits, F.lit(1), F.length(digits) - 1)
    new = F.concat_ws("", feistel(_ints(_chars(body)), _repeat(10, F.length(body)), key, forward).cast("array<string>"))
    check = F.pmod(-_luhn(F.concat(new, F.lit("0"))), F.lit(10)).cast("string")
    return F.when(_luhn(digits) % 10 == 0, _pour(m, F.concat(new, check)))


def _ip(m: Column, key: str, forward: bool) -> Column:
    octets = _ints(F.split(m, "[.]"))
    new = F.concat_ws(".", feistel(octets, _repeat(256, F.lit(4)), key, forward).cast("array<string>"))
    return F.when(F.forall(octets, lambda o: o < 256) & ~m.rlike(r"(^|[.])0\d"), new)


def _phone(m: Column, key: str, forward: bool) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    last, first = F.right(digits, F.lit(10)), F.substr(digits, F.lit(1), F.length(digits) - 10)
    values = F.array(F.substr(last, F.lit(1), F.lit(3)).cast("int") - 200, F.substr(last, F.lit(4), F.lit(3)).cast("int") - 200, F.substr(last, F.lit(7), F.lit(4)).cast("int"))
    new = feistel(values, F.array(F.lit(800), F.lit(800), F.lit(10000)), key, forward)
    american = F.concat(first, (F.get(new, F.lit(0)) + 200).cast("string"), (F.get(new, F.lit(1)) + 200).cast("string"), F.lpad(F.get(new, F.lit(2)).cast("string"), 4, "0"))
    body = F.substr(digits, F.lit(3), F.length(digits))
    other = feistel(_ints(_chars(body)), _repeat(10, F.length(body)), key, forward)
    other = F.concat(F.substr(digits, F.lit(1), F.lit(2)), F.concat_ws("", other.cast("array<string>")))
    return _pour(m, F.when(m.rlike(r"^\+[1-9]\d{7,14}$"), other).otherwise(american))


def _ssn(m: Column, key: str, forward: bool) -> Column:
    area, group, serial = (F.element_at(F.split(m, "-"), i).cast("int") for i in (1, 2, 3))
    ok = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    new = feistel(F.array(area - F.when(area > 666, 2).otherwise(1), group - 1, serial - 1), F.array(F.lit(898), F.lit(99), F.lit(9999)), key, forward)
    a = F.get(new, F.lit(0)) + 1
    a = a + F.when(a >= 666, 1).otherwise(0)
    pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
    return F.when(ok, F.concat_ws("-", pad(a, 3), pad(F.get(new, F.lit(1)) + 1, 2), pad(F.get(new, F.lit(2)) + 1, 4)))


def _date(m: Column, key: str, forward: bool) -> Column:
    iso = (
        F.when(m.rlike(r"^\d{4}"), F.regexp_replace(m, "/", "-"))
        .when(m.contains("."), F.regexp_replace(m, r"^(\d\d).(\d\d).(\d{4})$", "$3-$2-$1"))
        .otherwise(F.regexp_replace(m, r"^(\d\d).(\d\d).(\d{4})$", "$3-$1-$2"))
    )
    day = iso.try_cast("date")
    first = F.lit("1800-01-01").cast("date")
    n = F.datediff(day, first)
    # 146,097 days, 627 times 233, are a whole cycle of the calendar
    new = feistel(F.array((n / 233).cast("int"), F.pmod(n, F.lit(233))), F.array(F.lit(627), F.lit(233)), key, forward)
    out = F.date_add(first, (F.get(new, F.lit(0)) * 233 + F.get(new, F.lit(1))).cast("int"))
    written = (
        F.when(m.rlike(r"^\d{4}-"), F.date_format(out, "yyyy-MM-dd"))
        .when(m.rlike(r"^\d{4}/"), F.date_format(out, "yyyy/MM/dd"))
        .when(m.contains("."), F.date_format(out, "dd.MM.yyyy"))
        .otherwise(F.date_format(out, "MM/dd/yyyy"))
    )
    return F.when(n.between(0, 146096), written)


def _letters(text: Column, key: str, forward: bool, hexadecimal: bool = False) -> Column:
    """Digits, small and capital ASCII letters each within their kind; other characters stay where they are."""
    chars = _chars(text)
    if hexadecimal:
        place = F.transform(chars, lambda c: F.conv(c, 16, 10).cast("int"))
        new = feistel(place, _repeat(16, F.size(chars)), key, forward)
        return F.concat_ws("", F.transform(new, lambda v: F.lower(F.conv(v.cast("string"), 10, 16))))

    def base(c: Column) -> Column:
        return F.when(c.rlike("[0-9]"), 48).when(c.rlike("[a-z]"), 97).when(c.rlike("[A-Z]"), 65).otherwise(0)

    def size(c: Column) -> Column:
        return F.when(c.rlike("[0-9]"), 10).when(c.rlike("[A-Za-z]"), 26).otherwise(1)

    place = F.transform(chars, lambda c: F.when(base(c) > 0, F.ascii(c) - base(c)).otherwise(0))
    new = feistel(place, F.transform(chars, size), key, forward)
    return F.concat_ws("", F.zip_with(new, chars, lambda v, c: F.when(base(c) > 0, F.char(v + base(c))).otherwise(c)))


def pseudonym(m: Column, key: str, forward: bool = True) -> Column:
    """The pseudonym of a passage written like one of ``KINDS``; null if it is no valid value of its kind."""
    whole = {k: f"^(?:{p})$" for k, p in KINDS.items()}
    at = F.instr(m, "@")
    email = F.concat(_letters(F.substr(m, F.lit(1), at - 1), key, forward), F.substr(m, at, F.length(m)))
    access = F.concat(F.lit("AKIA"), _letters(F.substr(m, F.lit(5), F.length(m)), key, forward))
    password = F.concat(F.lit("password="), _letters(F.substr(m, F.lit(10), F.length(m)), key, forward))
    make = {
        "email": email,
        "date": _date(m, key, forward),
        "ip": _ip(m, key, forward),
        "phone": _phone(m, key, forward),
        "ssn": _ssn(m, key, forward),
        "card": _card(m, key, forward),
        "hex": _letters(m, key, forward, True),
        "access": access,
        "password": password,
    }
    out = F.when(F.lit(False), m)
    for kind in KINDS:
        out = out.when(m.rlike(whole[kind]), make[kind])
    return out


def pseudonymised(docs: DataFrame, key: str, forward: bool = True) -> DataFrame:
    """doc_id, text, n_found, n_replaced: whole texts with personal data replaced by pseudonyms of the same format.

    Replaced are dates from 1800 to 2199, IPv4 addresses, telephone and social security numbers, and card
    numbers with a right check digit (the pseudonym has one too); further the local part of e-mail addresses, hexadecimal
    tokens, access keys and passwords, their letters and digits within their kind. What looks like one of them but is not
    valid stays (it counts in n_found). Null texts stay null with counts of 0. Rows and other columns do not
    matter to each other; there is no shuffle.
    """
    found = docs.select("doc_id", "text", F.regexp_extract_all("text", F.lit(_ALL), F.lit(0)).alias("found"))
    named = found.select(
        "doc_id", "text", "found", F.transform("found", lambda m: pseudonym(m, key, forward)).alias("names")
    )
    put = F.zip_with("found", "names", lambda m, n: F.coalesce(n, m))
    between = F.split("text", _ALL, -1)
    text = F.concat_ws("", F.flatten(F.zip_with(between, put, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))))
    return named.select(
        "doc_id",
        F.when(F.size("found") > 0, text).otherwise(F.col("text")).alias("text"),
        F.coalesce(F.size("found"), F.lit(0)).alias("n_found"),
        F.coalesce(F.size(F.filter("names", lambda n: n.isNotNull())), F.lit(0)).alias("n_replaced"),
    )
