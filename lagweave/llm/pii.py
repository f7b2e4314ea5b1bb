"""Personal data: format-preserving Feistel pseudonyms (DataFrame operations only).

Numbers and dates are checked, mapped to an integer domain a x b, permuted there by a keyed
Feistel network and written back in their own format, so that equal values get equal pseudonyms
in every document and different values stay different. Letters and digits of e-mail names and
secrets are permuted by a Feistel network over strings that keeps the class of every character.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, documents, let

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
SECRET_NAME = r"(?i:password|passwd|token|secret|api_key)\s*[=:]"
SECRET = rf"\bAKIA[0-9A-Z]{{16}}\b|\b{SECRET_NAME}\s*\"?[A-Za-z0-9+/_-]{{8,}}\"?"
CARD = r"(?<![\d.])\d(?:[ -]?\d){12,18}(?![\d.]?\d)"
PHONE = r"(?:\+1[ .-]?)?(?:\(\d{3}\)[ ]?|(?<![\d.])\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
IPV4 = r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)"
ISO_DATE = r"(?<![\d-])(?:19|20)\d{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])(?![\d-])"
KINDS = {"email": EMAIL, "secret": SECRET, "ssn": SSN, "date": ISO_DATE, "card": CARD, "phone": PHONE, "ip": IPV4}
ANY = "|".join(f"(?:{p})" for p in KINDS.values())
#: Days from 1900-01-01 to 2099-12-31 that dates are permuted among, inside 271 x 271.
EPOCH, DAYS, SIDE = "1900-01-01", 73_049, 271
ROUNDS = 8
DIGITS = "0123456789"


def _random(key: str, *parts: Column) -> Column:
    """A keyed function of ``parts``, as 52 bits."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), *[p.cast("string") for p in parts]).cast("binary"), 256), 1, 13), 16, 10).cast("long")


def feistel(value: Column, a: Column | int, b: Column | int, key: str, label: str) -> Column:
    """A keyed permutation of 0 .. a*b-1: halves of sizes a and b take turns in being shifted."""
    a, b = (x if isinstance(x, Column) else F.lit(x).cast("long") for x in (a, b))

    def turn(s: Column, i: Column) -> Column:
        moved = F.pmod(s["l"] + _random(key, F.lit(label), i, s["a"], s["b"], s["r"]), s["a"])
        return F.struct(s["r"].alias("l"), moved.alias("r"), s["b"].alias("a"), s["a"].alias("b"))

    start = let(value.cast("long"), lambda v: F.struct(F.floor(v / b).alias("l"), F.pmod(v, b).alias("r"), a.alias("a"), b.alias("b")))
    steps = F.array(*[F.lit(i) for i in range(ROUNDS)])
    return let(F.aggregate(steps, start, turn), lambda s: s["l"] * b + s["r"])


def feistel_text(value: Column, key: str, label: str) -> Column:
    """A keyed permutation of the strings with the same classes (digit, a-z, A-Z, others fixed)."""

    def shift(text: Column, stream: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            by = F.conv(F.substr(stream, F.pmod(i * 2, F.lit(62)) + 1, F.lit(3)), 16, 10).cast("int")
            out = c
            for letters in (DIGITS, LOWER, UPPER):
                at = F.position(c, F.lit(letters))
                out = F.when((at > 0) & (c != ""), F.substr(F.lit(letters), F.pmod(at - 1 + by, F.lit(len(letters))) + 1, F.lit(1))).otherwise(out)
            return out

        return F.array_join(F.transform(F.split(text, ""), one), "")

    def turn(s: Column, i: Column) -> Column:
        stream = F.sha2(F.concat_ws("|", F.lit(key), F.lit(label), i.cast("string"), F.length(s["l"]).cast("string"), s["r"]).cast("binary"), 256)
        return F.struct(s["r"].alias("l"), shift(s["l"], stream).alias("r"))

    half = F.floor(F.length(value) / 2).cast("int")
    start = F.struct(F.substr(value, F.lit(1), half).alias("l"), F.substr(value, half + 1, F.length(value)).alias("r"))
    steps = F.array(*[F.lit(i) for i in range(ROUNDS)])
    return let(F.aggregate(steps, start, turn), lambda s: F.concat(s["l"], s["r"]))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _written(digits: Column, like: Column) -> Column:
    """``digits`` in the places of the digits of ``like``."""
    take = lambda i: F.length(_digits(F.substr(like, F.lit(1), i + 1)))
    return F.array_join(F.transform(F.split(like, ""), lambda c, i: F.when(c.rlike("^[0-9]$"), F.substr(digits, take(i), F.lit(1))).otherwise(c)), "")


def luhn(digits: Column) -> Column:
    """The Luhn sum modulo 10; 0 for a valid number."""
    double = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: let(F.coalesce(c.try_cast("int"), F.lit(0)), lambda d: F.when(i % 2 == 1, double(d)).otherwise(d)))
    return F.pmod(F.aggregate(each, F.lit(0), lambda a, d: a + d), F.lit(10))


def _power(n: Column) -> Column:
    return F.pow(F.lit(10.0), n.cast("double")).cast("long")


def _card(m: Column, key: str) -> Column:
    """First digit kept, the middle permuted, a check digit that makes the number valid again."""

    def renewed(d: Column) -> Column:
        middle = F.length(d) - 2
        low = F.floor(middle / 2)
        moved = feistel(F.substr(d, F.lit(2), middle).cast("long"), _power(middle - low), _power(low), key, "card")
        body = F.concat(F.substr(d, F.lit(1), F.lit(1)), F.lpad(moved.cast("string"), middle, F.lit("0")))
        return let(body, lambda x: F.concat(x, F.pmod(10 - luhn(F.concat(x, F.lit("0"))), F.lit(10)).cast("string")))

    return let(_digits(m), lambda d: F.when(luhn(d) == 0, _written(renewed(d), m)).otherwise(m))


def _phone(m: Column, key: str) -> Column:
    """The ten national digits; the first of area and exchange are kept where they are 0 or 1."""
    code = lambda d, n: F.substr(d, F.lit(n), F.lit(3)).cast("long")

    def renewed(d: Column) -> Column:
        area, exchange, line = code(d, 1), code(d, 4), F.substr(d, F.lit(7), F.lit(4)).cast("long")
        value = (area - 200) * 8_000_000 + (exchange - 200) * 10_000 + line
        good = let(feistel(value, 80_000, 80_000, key, "phone"), lambda v: F.concat((F.floor(v / 8_000_000) + 200).cast("string"), (F.floor(F.pmod(v, F.lit(8_000_000)) / 10_000) + 200).cast("string"), F.lpad(F.pmod(v, F.lit(10_000)).cast("string"), 4, "0")))
        rest = F.concat(F.substr(d, F.lit(2), F.lit(2)), F.substr(d, F.lit(5), F.lit(6))).cast("long")
        odd = let(F.lpad(feistel(rest, 10_000, 10_000, key, "odd phone").cast("string"), 8, "0"), lambda x: F.concat(F.substr(d, F.lit(1), F.lit(1)), F.substr(x, F.lit(1), F.lit(2)), F.substr(d, F.lit(4), F.lit(1)), F.substr(x, F.lit(3), F.lit(6))))
        return F.when((area >= 200) & (exchange >= 200), good).otherwise(odd)

    def whole(d: Column) -> Column:
        lead = F.length(d) - 10
        return F.concat(F.substr(d, F.lit(1), lead), renewed(F.substr(d, lead + 1, F.lit(10))))

    return let(_digits(m), lambda d: _written(whole(d), m))


def _ssn(m: Column, key: str) -> Column:
    return _written(F.lpad(feistel(_digits(m).cast("long"), 10_000, 100_000, key, "ssn").cast("string"), 9, "0"), m)


def _date(m: Column, key: str) -> Column:
    day = F.datediff(m.try_cast("date"), F.lit(EPOCH).cast("date"))

    def walk(v: Column, _: Column) -> Column:
        return F.when(v < DAYS, v).otherwise(feistel(v, SIDE, SIDE, key, "date"))

    # A walk from a day leaves the days for at most all of the numbers beyond them, so it ends on one.
    beyond = F.sequence(F.lit(1), F.lit(SIDE * SIDE - DAYS))
    first = feistel(day, SIDE, SIDE, key, "date")
    found = let(first, lambda v: F.when(v < DAYS, v).otherwise(F.aggregate(beyond, v, walk)))
    moved = F.date_add(F.lit(EPOCH).cast("date"), found.cast("int"))
    return F.when(day.between(0, DAYS - 1), F.date_format(moved, "yyyy-MM-dd")).otherwise(m)


def _ip(m: Column, key: str) -> Column:
    def renewed(o: Column) -> Column:
        octet = lambda n: o[n].cast("long")
        value = ((octet(0) * 256 + octet(1)) * 256 + octet(2)) * 256 + octet(3)
        moved = let(feistel(value, 65_536, 65_536, key, "ip"), lambda v: F.concat_ws(".", *[F.pmod(F.floor(v / 256**n), F.lit(256)).cast("string") for n in (3, 2, 1, 0)]))
        return F.when(F.forall(o, lambda x: x.cast("int") < 256), moved).otherwise(m)

    return let(F.split(m, r"\."), renewed)


def _email(m: Column, key: str) -> Column:
    return F.concat(feistel_text(F.substring_index(m, "@", 1), key, "email"), F.lit("@"), F.substring_index(m, "@", -1))


def _secret(m: Column, key: str) -> Column:
    lead = F.regexp_extract(m, r"^(AKIA|\w+\s*[=:]\s*\"?)", 1)
    return F.concat(lead, feistel_text(F.substr(m, F.length(lead) + 1, F.length(m)), key, "secret"))


MAKERS = {"email": _email, "secret": _secret, "ssn": _ssn, "date": _date, "card": _card, "phone": _phone, "ip": _ip}


def pseudonym(m: Column, key: str) -> Column:
    """The pseudonym of one matched string; what fails its check comes back as it is."""
    out = m
    for kind in reversed(KINDS):
        out = F.when(m.rlike(f"^(?:{KINDS[kind]})$"), MAKERS[kind](m, key)).otherwise(out)
    return out


def pseudonymize(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with ``text`` rewritten, and n_matched, n_changed (long).

    A null text stays null with counts of 0; an empty or clean text is returned unchanged. Equal
    values get equal pseudonyms wherever they are, in repeated rows too. A value that its check
    refuses (a card number whose Luhn sum is wrong, a day or an octet that doesn't exist) is left.
    Further columns are kept as they are, but for n_matched and n_changed, which are replaced.
    """
    quick = F.col(text).rlike(rf"[0-9@]|{SECRET_NAME}")
    spans = F.when(quick, F.regexp_extract_all(F.col(text), F.lit(ANY), F.lit(0)))
    marked = docs.withColumn("_found", F.coalesce(spans, F.array().cast("array<string>")))
    new = F.transform("_found", lambda m: pseudonym(m, key))
    marked = marked.withColumn("_new", F.when(F.size("_found") > 0, new))
    between = F.split(F.col(text), ANY, -1)
    joined = F.array_join(F.zip_with(between, F.concat("_new", F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
    changed = F.size(F.filter(F.zip_with("_found", "_new", lambda a, b: a != b), lambda x: x))
    return marked.withColumns({
        text: F.when(F.size("_found") > 0, joined).otherwise(F.col(text)),
        "n_matched": F.size("_found").cast("long"),
        "n_changed": F.when(F.size("_found") > 0, changed).otherwise(F.lit(0)).cast("long"),
    }).drop("_found", "_new")


def op2_feistel_pseudonyms(spark, sf_dir: str, key: str | None = None) -> DataFrame:
    """All documents with pseudonyms; the key is a parameter, or the session's spark.lagweave.pii.key."""
    key = key or spark.conf.get("spark.lagweave.pii.key", "no key was set")
    done = pseudonymize(documents(spark, sf_dir).select("doc_id", "text"), key=key)
    return done.select("doc_id", "text", "n_matched", "n_changed")
