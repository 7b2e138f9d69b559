"""Format-preserving pseudonyms for personal data, on DataFrame functions only.

Values found by pattern are validated and then permuted within their format by
a keyed Feistel network, so equal values get equal pseudonyms in every
document and different values of one format stay different:

==========  =======================================  ==========================================
kind        validated by                             kept by the permutation
==========  =======================================  ==========================================
card        13 to 19 digits, Luhn check digit        length, grouping, a valid check digit
phone       form with ten digits after the prefix    prefix, punctuation
ssn         form, no reserved area, group or serial  punctuation
ip          four octets of at most 255               a valid address
date        a real day of 1800 to 2199               a real day of the same 400 years and format
email       form                                     positions of letters, digits, points, the last label
secret      assigned to token, secret, key ...       alphabet (lower hex, or letters and digits)
==========  =======================================  ==========================================

What fails its validation stays as it is.  Everything happens inside a row:
texts are cut at the hits, the hits are replaced, the parts are joined again,
and texts without a digit or ``@`` are passed on untouched.

Defined results: null stays null, empty stays empty; ids, repeated rows and
other columns are passed through; a table without rows gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterbook.llm.common import let

ROUNDS = 10
#: Pseudonyms are only as secret as the key: pass your own.
KEY = "change this key"

# The forms that are looked for, in order of precedence.
# A run before an @ is tried from its begin only, and what it takes is not given back.  A domain that ends in letters is taken as a
# whole, of any length; of one that does not, the last label of letters among its first 127 counts, as host names have no more.
_LOCAL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@"
_EMAIL = (
    _LOCAL + r"(?:[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+(?<=\.[A-Za-z]{2,63})|[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++){0,126}\.[A-Za-z]{2,})"
)
_SECRET = r"(?i:token|secret|api_?key|password|passwd)[\"']?\s*[=:]\s*[\"']?[A-Za-z0-9]{16,}"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_IP = rf"(?<![\w.-])(?:{_OCTET}\.){{3}}{_OCTET}(?![\w-]|\.\d)"
_DATE = r"(?<![\w./-])(?:\d{4}-\d\d-\d\d|\d{4}/\d\d/\d\d|\d\d\.\d\d\.\d{4}|\d\d/\d\d/\d{4})(?![\w/-]|\.\d)"
_SSN = r"(?<![\w-])\d{3}-\d\d-\d{4}(?![\w-])"
_PHONE = r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\w-])"
_PHONE_RUN = r"(?<![\w+])\+\d{11,13}(?!\w)"
_CARD = r"(?<![\w-])(?:\d{4}([ -])\d{4}\1\d{4}\1\d{4}|\d{4}[ -]\d{6}[ -]\d{5}|\d{13,19})(?![\w-])"

_WHOLE = {"email": _EMAIL, "secret": _SECRET, "ip": _IP, "date": _DATE, "ssn": _SSN, "card": _CARD, "phone": f"{_PHONE}|{_PHONE_RUN}"}
PATTERN = "|".join(_WHOLE.values())
#: 400 years of the calendar are 146,097 days, which is 189 times 773: a Feistel network over these two numbers needs no second try.
_DAY_SIDES = (189, 773)
_FIRST_DAY, _DAYS = "1800-01-01", 146_097
_DATE_FORMS = {r"^\d{4}-": "yyyy-MM-dd", r"^\d{4}/": "yyyy/MM/dd", r"^\d\d\.": "dd.MM.yyyy", r"^\d\d/": "MM/dd/yyyy"}
_ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_HEX = ("0123456789abcdef",)


def _rounds() -> Column:
    return F.sequence(F.lit(0), F.lit(ROUNDS - 1))


def _mac(key: str, kind: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), *[p.cast("string") for p in parts]), 256)


def _number(mac: Column) -> Column:
    """The first 60 bits of a digest."""
    return F.conv(F.substring(mac, 1, 15), 16, 10).cast("long")


def permute_digits(digits: Column, key: str, kind: str) -> Column:
    """Feistel network on a text of 2 to 36 digits; its halves are numbers of a fixed length."""

    def network(d: Column) -> Column:
        n = F.length(d)
        cut = F.floor(n / 2).cast("int")

        def step(acc: Column, i: Column) -> Column:
            size = F.length(acc.a)
            power = F.rpad(F.lit("1"), size + 1, "0").cast("long")
            moved = F.pmod(acc.a.cast("long") + F.pmod(_number(_mac(key, kind, n, i, acc.b)), power), power)
            return F.struct(acc.b.alias("a"), F.lpad(moved.cast("string"), size, "0").alias("b"))

        start = F.struct(F.substr(d, F.lit(1), cut).alias("a"), F.substr(d, cut + 1).alias("b"))
        return F.aggregate(_rounds(), start, step, lambda acc: F.concat(acc.a, acc.b))

    return let(digits, network)


def permute_characters(text: Column, key: str, kind: str, alphabets: tuple[str, ...]) -> Column:
    """Feistel network on a text: each character of an alphabet moves within it, all others stay."""

    def moved(half: Column, other: Column, i: Column) -> Column:
        # the other half is read once a round, its digest stands for it in the blocks
        numbers = F.sequence(F.lit(0), F.floor(F.length(half) / 32).cast("int"))
        blocks = let(F.sha2(other, 256), lambda digest: F.transform(numbers, lambda k: _mac(key, kind, F.length(half), i, k, digest)))

        def shifted(stream: Column) -> Column:
            def one(c: Column, at: Column) -> Column:
                # 32 numbers of a block, so a place is found at once however long the text is
                part = F.get(stream, F.floor(at / 32).cast("int"))
                by = F.conv(F.substr(part, F.pmod(at, F.lit(32)) * 2 + 1, F.lit(2)), 16, 10).cast("int")
                out = c
                for letters in alphabets:
                    place = F.instr(F.lit(letters), c)
                    out = F.when(place > 0, F.substr(F.lit(letters), F.pmod(place - 1 + by, F.lit(len(letters))) + 1, F.lit(1))).otherwise(out)
                return out

            return F.array_join(F.transform(F.split(half, ""), one), "")

        return F.when(F.length(half) > 0, let(blocks, shifted)).otherwise(half)

    def network(t: Column) -> Column:
        cut = F.floor(F.length(t) / 2).cast("int")
        start = F.struct(F.substr(t, F.lit(1), cut).alias("a"), F.substr(t, cut + 1).alias("b"))
        return F.aggregate(
            _rounds(), start, lambda acc, i: F.struct(acc.b.alias("a"), moved(acc.a, acc.b, i).alias("b")), lambda acc: F.concat(acc.a, acc.b)
        )

    return let(text, network)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, r"\D", "")


def _laid_out(form: Column, digits: Column) -> Column:
    """``digits`` in the places that digits have in ``form``."""

    def put(acc: Column, c: Column) -> Column:
        digit = c.between("0", "9")
        return F.struct(
            F.concat(acc.out, F.when(digit, F.substr(acc.rest, F.lit(1), F.lit(1))).otherwise(c)).alias("out"),
            F.when(digit, F.substr(acc.rest, F.lit(2))).otherwise(acc.rest).alias("rest"),
        )

    return F.aggregate(F.split(form, ""), F.struct(F.lit("").alias("out"), digits.alias("rest")), put, lambda acc: acc.out)


def _luhn_sum(digits: Column, doubled_from: int) -> Column:
    """Sum of digits, each second one doubled; the last digit is doubled if ``doubled_from`` is 0."""

    def place(c: Column, i: Column) -> Column:
        d = c.cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return F.when(F.pmod(i, F.lit(2)) == doubled_from, twice).otherwise(d)

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), place), F.lit(0), lambda a, x: a + x)


def _card(value: Column, key: str) -> Column:
    def permuted(d: Column) -> Column:
        body = F.substr(d, F.lit(1), F.length(d) - 1)
        new = let(
            permute_digits(body, key, "card"),
            lambda b: F.concat(b, F.pmod(10 - F.pmod(_luhn_sum(b, 0), F.lit(10)), F.lit(10)).cast("string")),
        )
        return F.when(F.pmod(_luhn_sum(d, 1), F.lit(10)) == 0, _laid_out(value, new))

    return let(_digits(value), permuted)


def _phone(value: Column, key: str) -> Column:
    """Ten digits are permuted; a country code in front stays."""
    digits = _digits(value)
    return let(digits, lambda d: _laid_out(value, F.concat(F.substr(d, F.lit(1), F.length(d) - 10), permute_digits(F.right(d, F.lit(10)), key, "phone"))))


def _ssn(value: Column, key: str) -> Column:
    real = ~value.rlike(r"^(?:000|666|9\d\d)-|-00-|-0000$")
    return F.when(real, _laid_out(value, permute_digits(_digits(value), key, "ssn")))


def _ip(value: Column, key: str) -> Column:
    def network(octets: Column) -> Column:
        def side(i: int) -> Column:
            return F.get(octets, i).cast("int") * 256 + F.get(octets, i + 1).cast("int")

        def step(acc: Column, i: Column) -> Column:
            return F.struct(acc.b.alias("a"), F.pmod(acc.a + F.pmod(_number(_mac(key, "ip", i, acc.b)), F.lit(65536)), F.lit(65536)).cast("int").alias("b"))

        def shown(acc: Column) -> Column:
            parts = [p for half in (acc.a, acc.b) for p in (F.shiftright(half, 8), half.bitwiseAND(F.lit(255)))]
            return F.concat_ws(".", *[p.cast("string") for p in parts])

        return F.aggregate(_rounds(), F.struct(side(0).alias("a"), side(2).alias("b")), step, shown)

    return let(F.split(value, r"\."), network)


def permute_day(day: Column, key: str) -> Column:
    """Feistel network over the days of 400 years, as numbers of two unequal sides."""
    left, right = _DAY_SIDES

    def step(acc: Column, i: Column) -> Column:
        even = F.pmod(i, F.lit(2)) == 0
        a = F.pmod(acc.a + _number(_mac(key, "date", i, acc.b)), F.lit(left)).cast("int")
        b = F.pmod(acc.b + _number(_mac(key, "date", i, acc.a)), F.lit(right)).cast("int")
        return F.struct(F.when(even, a).otherwise(acc.a).alias("a"), F.when(even, acc.b).otherwise(b).alias("b"))

    start = F.struct(F.floor(day / right).cast("int").alias("a"), F.pmod(day, F.lit(right)).cast("int").alias("b"))
    return F.aggregate(_rounds(), start, step, lambda acc: acc.a * right + acc.b)


def _date(value: Column, key: str) -> Column:
    first = F.lit(_FIRST_DAY).cast("date")

    def moved(form: str) -> Column:
        def shown(day: Column) -> Column:
            return F.when(day.between(0, _DAYS - 1), F.date_format(F.date_add(first, permute_day(day, key)), form))

        return let(F.datediff(F.try_to_date(value, form), first), shown)

    out = F.lit(None).cast("string")
    for start, form in _DATE_FORMS.items():
        out = F.when(value.rlike(start), moved(form)).otherwise(out)
    return out


def _email(value: Column, key: str) -> Column:
    """Everything before the last label moves."""
    return F.concat(permute_characters(F.regexp_extract(value, r"^(.*)\.", 1), key, "email", _ALPHABETS), F.regexp_extract(value, r"(\.[A-Za-z]+)$", 1))


def _secret(value: Column, key: str) -> Column:
    name, own = F.regexp_extract(value, r"^(.*?[=:]\s*[\"']?)", 1), F.regexp_extract(value, r"([A-Za-z0-9]+)$", 1)
    hexed = permute_characters(own, key, "hex", _HEX)
    return F.concat(name, F.when(own.rlike("^[0-9a-f]+$"), hexed).otherwise(permute_characters(own, key, "secret", _ALPHABETS)))


_PERMUTE = {"email": _email, "secret": _secret, "ip": _ip, "date": _date, "ssn": _ssn, "card": _card, "phone": _phone}


def pseudonym(value: Column, key: str = KEY) -> Column:
    """(kind, value) of a hit: its pseudonym, or null kind and the value itself where it fails its validation."""

    def done(kind: str) -> Column:
        def named(new: Column) -> Column:
            return F.struct(F.when(new.isNotNull(), F.lit(kind)).alias("kind"), F.coalesce(new, value).alias("value"))

        return let(_PERMUTE[kind](value, key), named)

    out = F.struct(F.lit(None).cast("string").alias("kind"), value.alias("value"))
    # a hit is a whole match of one of the forms; the look-arounds of a form hold at its edges
    for kind, form in reversed(_WHOLE.items()):
        out = F.when(value.rlike(f"^(?:{form})$"), done(kind)).otherwise(out)
    return out


def pseudonymise(docs: DataFrame, text_col: str = "text", key: str = KEY, kinds_col: str | None = None) -> DataFrame:
    """``docs`` with personal data in ``text_col`` replaced; ``kinds_col`` names a column for the kinds replaced, in text order."""
    text = F.col(f"`{text_col}`")
    plain = F.struct(text.alias("text"), F.array().cast("array<string>").alias("kinds"))

    def joined(hits: Column) -> Column:
        def weave(parts: Column) -> Column:
            woven = F.transform(parts, lambda p, i: F.concat(p, F.coalesce(F.get(hits, i).value, F.lit(""))))
            return F.struct(F.array_join(woven, "").alias("text"), F.filter(F.transform(hits, lambda h: h.kind), lambda k: k.isNotNull()).alias("kinds"))

        return let(F.split(text, PATTERN, -1), weave)

    found = let(F.transform(F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)), lambda h: pseudonym(h, key)), joined)
    done = F.when(text.rlike("[0-9@]"), found).otherwise(plain)
    out = docs.select(*[F.col(f"`{c}`") for c in docs.columns], done.alias("__done"))
    own = [F.col("__done.text").alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    return out.select(*own, *([F.col("__done.kinds").alias(kinds_col)] if kinds_col else []))
