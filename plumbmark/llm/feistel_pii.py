r"""PII: format-preserving Feistel pseudonyms, in Spark expressions only.

Found are emails, card numbers (13 to 19 digits, in one group or in groups of four, with a right Luhn digit), IBANs (mod
97), phone numbers (a country code with +, or an area code in brackets, or three groups 3-3-4), social security numbers
(3-2-4), IPv4 addresses (octets up to 255), dates (year-month-day, or day and month in either order with a four-digit
year; the day must exist) and secrets (32 to 128 hex digits in a row). What fails its validation stays as it is.

A value is split in two halves (L, R), numbers below a and b, and eight keyed rounds add a hash of one half to the
other: L = (L + h(R)) mod a, R = (R + h(L)) mod b. Each round can be undone, so that a round trip is exact and two values
of one format never get one pseudonym. What tells the format stays: length, separators, the country code of a phone, the
country of an IBAN, the domain kind of an email. Check digits are made anew, a date becomes a date of the same
400 years (1800 to 2199). Equal values get equal pseudonyms in all documents, as each depends on the key and the value alone.
An email's name and host become hex digits of a keyed hash of 64 bits each, under `.invalid`.

Defined results: a null text stays null, an empty one empty; doc_id isn't read; all other columns are kept.
Overlapping finds go to the leftmost, then to the first kind in the order of `KINDS`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbmark.llm.scratch import unused
from plumbmark.session import table

#: The session's setting that holds the key. Whoever has the key can undo pseudonyms, so it is to be a secret of the job; without it,
#: as in tests, a key is taken that is none.
KEY_SETTING, TEST_KEY = "spark.plumbmark.pii.key", "not a secret: set spark.plumbmark.pii.key"
ROUNDS = 8

#: Fixed patterns, in the order in which they are tried at a place.
KINDS = {
    "email": r"[A-Za-z0-9._%+\-]{1,64}@[A-Za-z0-9\-]{1,63}(?:\.[A-Za-z0-9\-]{1,63}){0,8}\.[A-Za-z]{2,24}",
    "secret": r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![0-9A-Za-z])",
    "date": r"(?<![0-9./\-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})(?![0-9]|[./\-][0-9])",
    "ipv4": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    "ssn": r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])",
    "phone": r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .\-]?(?:\([0-9]{1,4}\)[ .\-]?)?[0-9]{2,4}(?:[ .\-]?[0-9]{2,4}){1,4}|\([0-9]{3}\) ?[0-9]{3}[ .\-][0-9]{4}|[0-9]{3}[.\-][0-9]{3}[.\-][0-9]{4})(?![0-9])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "card": r"(?<![0-9A-Za-z])(?:[0-9]{4}(?<gap>[ \-])[0-9]{4}\k<gap>[0-9]{4}\k<gap>[0-9]{1,7}|[0-9]{13,19})(?![0-9A-Za-z])",
}
ANY = "|".join(KINDS.values())
#: Signs of which one at least is in every find: a text without any has none.
SIGN = r"@|[0-9]{2}|[0-9]\.|[0-9a-fA-F]{32}"
DAYS_FROM, DAYS_A, DAYS_B = "1800-01-01", 189, 773  # 189 * 773 = 146097, the days of 400 years


def session_key(spark: SparkSession) -> str:
    return spark.conf.get(KEY_SETTING, None) or TEST_KEY


def _keyed(key: str, *parts: Column) -> Column:
    """SHA-256 of the parts between two copies of the key, as hex digits."""
    return F.sha2(F.concat_ws("\n", F.lit(key), *[p.cast("string") for p in parts], F.lit(key)), 256)


def _hash(key: str, kind: Column, round_: int, half: Column, below: Column) -> Column:
    """The first 60 bits of the keyed hash, below a bound that is far smaller."""
    return F.pmod(F.conv(F.substring(_keyed(key, kind, F.lit(round_), half), 1, 15), 16, 10).cast("long"), below)


def permute(left: Column, right: Column, a: Column, b: Column, kind: Column, key: str, back: bool = False) -> tuple[Column, Column]:
    """(left, right) below (a, b), permuted; back undoes it. Halves that aren't changed in a round aren't hashed again."""
    state = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    sign = -1 if back else 1

    def even(i: int) -> Callable[[Column], Column]:
        return lambda s: F.struct(F.pmod(s["l"] + sign * _hash(key, kind, i, s["r"], a), a).alias("l"), s["r"].alias("r"))

    def odd(i: int) -> Callable[[Column], Column]:
        return lambda s: F.struct(s["l"].alias("l"), F.pmod(s["r"] + sign * _hash(key, kind, i, s["l"], b), b).alias("r"))

    for i in sorted(range(ROUNDS), reverse=back):
        state = _let(state, odd(i) if i % 2 else even(i))
    return state["l"], state["r"]


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once."""
    return F.transform(F.array(value), then)[0]


def _power(base: int, n: Column) -> Column:
    return F.element_at(F.lit([base**i for i in range(19)]), n + 1)


def permute_digits(digits: Column, kind: Column, key: str, back: bool = False) -> Column:
    """A string of 2 to 36 digits as another of its length."""

    def run(s: Column) -> Column:
        n, half = s["n"], s["half"]
        kinds = F.concat(kind, F.lit("/"), n.cast("string"))
        l, r = F.substring(s["d"], 1, half).cast("long"), F.substring(s["d"], half + 1, n).cast("long")
        left, right = permute(l, r, _power(10, half), _power(10, n - half), kinds, key, back)
        pair = F.transform(F.array(F.struct(left.alias("l"), right.alias("r"))), lambda p: F.concat(F.lpad(p["l"].cast("string"), half, "0"), F.lpad(p["r"].cast("string"), n - half, "0")))
        return pair[0]

    return F.when(F.length(digits) < 2, digits).otherwise(_let(F.struct(digits.alias("d"), F.length(digits).alias("n"), (F.length(digits) / 2).cast("int").alias("half")), run))


def _refill(shape: Column, digits: Column) -> Column:
    """The shape with its digits replaced, in order; other characters stay."""
    parts = F.split(shape, "[0-9]", -1)
    return F.array_join(F.concat(F.zip_with(F.slice(parts, 1, F.size(parts) - 1), F.split(digits, ""), lambda p, d: F.concat(p, d)), F.slice(parts, -1, 1)), "")


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a string of digits, the last one not doubled."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.element_at(F.lit([0, 2, 4, 6, 8, 1, 3, 5, 7, 9]), d.cast("int") + 1)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x)


def iban_rest(bare: Column) -> Column:
    """The number of an IBAN without spaces, mod 97."""
    turned = F.concat(F.substring(bare, 5, 40), F.substring(bare, 1, 4))
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + c.try_cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97))


def _date(x: Column, key: str, back: bool) -> Column:
    parts = F.split(x, r"[./\-]")
    year_first = F.length(parts[0]) == 4
    # day first if that is a date, else month first
    made = lambda y, m, d: F.try_to_date(F.concat_ws("-", F.lpad(y, 4, "0"), F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")
    day_first = ~year_first & (parts[1].cast("int") <= 12)
    date = F.when(year_first, made(parts[0], parts[1], parts[2])).when(day_first, made(parts[2], parts[1], parts[0])).otherwise(made(parts[2], parts[0], parts[1]))

    def run(s: Column) -> Column:
        n = F.datediff(s["date"], F.lit(DAYS_FROM).cast("date"))
        valid = s["date"].isNotNull() & (n >= 0) & (n < DAYS_A * DAYS_B)
        kind = F.concat(F.lit("date/"), F.when(s["y"], F.lit("ymd")).when(s["d"], F.lit("dmy")).otherwise(F.lit("mdy")))
        left, right = permute((n / DAYS_B).cast("long"), F.pmod(n, F.lit(DAYS_B)), F.lit(DAYS_A), F.lit(DAYS_B), kind, key, back)
        return F.when(valid, _let(F.struct(left.alias("l"), right.alias("r")), lambda p: F.date_add(F.lit(DAYS_FROM).cast("date"), (p["l"] * DAYS_B + p["r"]).cast("int"))))

    # the order of day and month that was read is part of the format: a result is written in it with two digits each
    def written(s: Column) -> Column:
        sep = F.regexp_extract(x, r"[./\-]", 0)
        y, m, d = F.date_format(s["new"], "yyyy"), F.date_format(s["new"], "MM"), F.date_format(s["new"], "dd")
        return F.when(s["new"].isNull(), x).when(s["y"], F.concat_ws("-", y, m, d)).when(s["d"], F.concat(d, sep, m, sep, y)).otherwise(F.concat(m, sep, d, sep, y))

    return _let(F.struct(run(F.struct(date.alias("date"), year_first.alias("y"), day_first.alias("d"))).alias("new"), year_first.alias("y"), day_first.alias("d")), written)


def _hex(x: Column, key: str, back: bool) -> Column:
    """A hex string as another of its length and case: blocks of twelve digits, and what is left, each with the block's number."""
    blocks = F.filter(F.split(F.regexp_replace(x, "(.{12})", "$1,"), ","), lambda b: b != "")

    def block(b: Column, i: Column) -> Column:
        n, half = F.length(b), (F.length(b) / 2).cast("int")
        to_number = lambda h: F.when(F.length(h) == 0, F.lit(0)).otherwise(F.conv(h, 16, 10).cast("long"))
        size = lambda k: F.element_at(F.lit([16**j for j in range(13)]), k + 1)
        left, right = permute(to_number(F.substring(b, 1, half)), to_number(F.substring(b, half + 1, n)), size(half), size(n - half), F.concat(F.lit("hex/"), F.length(x).cast("string"), F.lit("/"), i.cast("string")), key, back)
        as_hex = lambda v, k: F.when(k == 0, F.lit("")).otherwise(F.lpad(F.hex(v), k, "0"))
        return _let(F.struct(left.alias("l"), right.alias("r")), lambda p: F.concat(as_hex(p["l"], half), as_hex(p["r"], n - half)))

    new = F.array_join(F.transform(blocks, block), "")
    return F.when(x.rlike("[a-f]"), F.lower(new)).when(x.rlike("[A-F]"), new).otherwise(F.lower(new))


def _ipv4(x: Column, key: str, back: bool) -> Column:
    p = F.transform(F.split(x, r"\."), lambda o: o.cast("long"))
    left, right = permute(p[0] * 256 + p[1], p[2] * 256 + p[3], F.lit(65536), F.lit(65536), F.lit("ipv4"), key, back)
    written = _let(F.struct(left.alias("l"), right.alias("r")), lambda s: F.concat_ws(".", *[F.pmod(F.floor(s[h] / d), F.lit(256)).cast("string") for h in "lr" for d in (256, 1)]))
    return F.when(F.forall(F.split(x, r"\."), lambda o: o.cast("int") <= 255), written).otherwise(x)


def _card(x: Column, key: str, back: bool) -> Column:
    digits = F.regexp_replace(x, "[^0-9]", "")

    def run(d: Column) -> Column:
        body = permute_digits(F.substring(d, 1, F.length(d) - 1), F.lit("card"), key, back)
        return F.when((F.length(d) >= 13) & (F.length(d) <= 19) & (luhn_sum(d) % 10 == 0), _let(body, lambda b: _refill(x, F.concat(b, F.pmod(-luhn_sum(F.concat(b, F.lit("0"))), F.lit(10)).cast("string"))))).otherwise(x)

    return _let(digits, run)


def _iban(x: Column, key: str, back: bool) -> Column:
    bare = F.regexp_replace(x, " ", "")

    def run(b: Column) -> Column:
        account = F.substring(b, 5, 40)
        digits = F.regexp_replace(account, "[^0-9]", "")
        fresh = _refill(account, permute_digits(digits, F.concat(F.lit("iban/"), F.substring(b, 1, 2)), key, back))
        with_check = _let(F.concat(F.substring(b, 1, 2), F.lit("00"), fresh), lambda z: F.concat(F.substring(z, 1, 2), F.lpad((98 - iban_rest(z)).cast("string"), 2, "0"), F.substring(z, 5, 40)))
        spaced = F.when(F.instr(x, " ") > 0, F.trim(F.regexp_replace(with_check, "(.{4})", "$1 "))).otherwise(with_check)
        return F.when(iban_rest(b) == 1, spaced).otherwise(x)

    return _let(bare, run)


def _phone(x: Column, key: str, back: bool) -> Column:
    code = F.regexp_extract(x, r"^(\+[0-9]{1,3})(?=[^0-9])", 1)

    def run(s: Column) -> Column:
        rest = F.substring(x, F.length(s) + 1, 64)
        digits = F.regexp_replace(rest, "[^0-9]", "")
        n = F.length(digits)
        shape = F.concat(F.lit("phone/"), s, F.lit("/"), F.regexp_replace(rest, "[0-9]", "0"))
        return F.when((n >= 7) & (n <= 18), F.concat(s, _refill(rest, permute_digits(digits, shape, key, back)))).otherwise(x)

    return _let(code, run)


def _ssn(x: Column, key: str, back: bool) -> Column:
    return F.when(x.rlike("^(?:000|666|9)|-00-|-0000$"), x).otherwise(_refill(x, permute_digits(F.regexp_replace(x, "-", ""), F.lit("ssn"), key, back)))


def _email(x: Column, key: str, back: bool) -> Column:
    hidden = lambda part, tag: F.substring(_keyed(key, F.lit(tag), part), 1, 16)
    return F.concat(hidden(F.lower(x), "name"), F.lit("@"), hidden(F.lower(F.substring_index(x, "@", -1)), "host"), F.lit(".invalid"))


_WAYS = {"email": _email, "secret": _hex, "date": _date, "ipv4": _ipv4, "ssn": _ssn, "phone": _phone, "iban": _iban, "card": _card}


def kind_of(find: Column) -> Column:
    """Which pattern a find matched: the first that matches it whole."""
    out = None
    for kind, pattern in KINDS.items():
        test = find.rlike(f"^(?:{pattern})$")
        out = F.when(test, kind) if out is None else out.when(test, kind)
    return out


def pseudonym(find: Column, kind: Column, key: str, back: bool = False) -> Column:
    out = None
    for name, way in _WAYS.items():
        out = (F if out is None else out).when(kind == name, way(find, key, back))
    return out.otherwise(find)


def scan(docs: DataFrame, key: str | None = None, text: str = "text", back: bool = False) -> DataFrame:
    """docs with `pii`, an array of (kind, found, pseudonym) in order, what was not validated left out of account; by the session's key if none is given."""
    key, col = key or session_key(docs.sparkSession), F.col(text)
    finds = F.when(col.rlike(SIGN), F.regexp_extract_all(col, F.lit(ANY), 0)).otherwise(F.array().cast("array<string>"))
    marked = F.transform(finds, lambda f: _let(F.struct(f.alias("found"), kind_of(f).alias("kind")), lambda s: F.struct(s["kind"].alias("kind"), s["found"].alias("found"), pseudonym(s["found"], s["kind"], key, back).alias("pseudonym"))))
    return docs.withColumn("pii", marked)


def rebuilt(text: Column, pii: Column) -> Column:
    """The text with each find replaced. The split is by the same pattern, so parts and finds alternate."""
    parts = F.split(text, ANY, -1)
    joined = F.array_join(F.zip_with(parts, pii, lambda p, f: F.concat(p, F.coalesce(f["pseudonym"], F.lit("")))), "")
    return F.when(text.isNull() | (F.size(pii) == 0), text).otherwise(joined)


def redact(docs: DataFrame, key: str | None = None, text: str = "text") -> DataFrame:
    """docs with the finds of `text` replaced; all columns as before."""
    own = unused(docs, "_own_pii")
    found = scan(docs.withColumnsRenamed({c: own for c in docs.columns if c.lower() == "pii"}), key, text)
    columns = [found[own if c.lower() == "pii" else c].alias(c) if c != text else rebuilt(F.col(text), F.col("pii")).alias(c) for c in docs.columns]
    return found.select(*columns)


def op10_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    real = F.filter("pii", lambda p: p["found"] != p["pseudonym"])
    return found.select("doc_id", rebuilt(F.col("text"), F.col("pii")).alias("text"), F.size(real).cast("long").alias("n_pii"), real.alias("pii")).withColumn("pii", F.transform("pii", lambda p: F.struct(p["kind"], p["pseudonym"])))


QUERIES = {"op10_feistel_pseudonyms": op10_feistel_pseudonyms}
ORACLES: dict[str, str] = {}
