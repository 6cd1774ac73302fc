"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

Values are found by pattern, validated (calendar, check digits, octets, areas) and
replaced by a keyed permutation of the values of their format: an alternating Feistel
network with modular addition over two parts, Z_a x Z_b, which is a permutation for any
a and b, so no value is drawn twice and the same value has the same pseudonym in every
document. Check digits are computed anew. What does not validate is left as it is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayrate.llm.words import unused

ROUNDS = 8
CHUNK = 20
FIRST_DAY, DAYS_A, DAYS_B = "1900-01-01", 144, 383  # 1900-2050 has 144 * 383 days

# One pattern per kind of value, tried in this order at each place.
PATTERNS = {
    "email": r"(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "key": r"\bA[KS]IA[A-Z0-9]{16}\b",
    "token": r"(?<=(?i:token|secret|key|password)\s{0,3}[=:]\s{0,3}[\"']?)[0-9a-fA-F]{16,128}\b",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ip": r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\w)",
    "date": r"(?<![\w./-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}([./-])\d{1,2}\1\d{4})(?![./-]?\w)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?!-?\w)",
    "phone": r"(?<![\w+])\+\d{1,3}(?:[ .-]?\(\d{1,4}\))?(?:[ .-]?\d{1,4}){2,5}(?!\w)"
    r"|(?<![\w(])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\w)|(?<![\w-])\d{3}-\d{3}-\d{4}(?!-?\w)",
    "card": r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?!\w)",
}
ASSIGNED = r"(?i:token|secret|key|password)\s{0,3}[=:]\s{0,3}[\"']?$"
# Characters of an IBAN by country (ISO 13616).
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV",
    22: "BG BH DE GB GE IE ME RS", 23: "AE GI IL", 24: "AD CZ ES MD PK RO SA SE SK TN", 25: "PT",
    26: "IS TR", 27: "FR GR IT MC SM", 28: "AL AZ CY DO GT HU LB PL", 29: "BR PS QA UA", 30: "JO KW", 31: "MT",
}
# Country codes of two digits, and the digits of a number behind the country
# code where they are fewer than in general.
TWO_DIGITS = r"^(?:20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
PHONE_DIGITS = {
    "1": (10, 10), "7": (10, 10), "20": (8, 10), "27": (9, 9), "30": (10, 10), "31": (9, 9), "32": (8, 9), "33": (9, 9),
    "34": (9, 9), "36": (8, 9), "39": (6, 11), "40": (9, 9), "41": (9, 9), "43": (6, 12), "44": (9, 10), "45": (8, 8),
    "46": (7, 9), "47": (8, 8), "48": (9, 9), "49": (6, 11), "52": (10, 10), "54": (10, 11), "55": (10, 11), "56": (9, 9),
    "57": (10, 10), "61": (9, 9), "65": (8, 8), "81": (9, 10), "82": (8, 10), "86": (10, 11), "90": (10, 10),
    "91": (10, 10), "92": (10, 10), "351": (9, 9), "353": (8, 9), "354": (7, 7), "380": (9, 9), "420": (9, 9),
    "421": (9, 9), "966": (9, 9), "971": (8, 9), "972": (8, 9),
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())


def _long(column: Column) -> Column:
    return F.coalesce(column.try_cast("bigint"), F.lit(0).cast("bigint"))


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _power(base: int, exponent: Column) -> Column:
    return F.element_at(F.array(*[F.lit(base**i).cast("bigint") for i in range(12)]), exponent + 1)


def permute_pair(a: Column, b: Column, size_a: Column, size_b: Column, tag: str, key: str) -> Column:
    """Struct (a, b) moved by a keyed permutation of Z_size_a x Z_size_b."""

    def noise(i: Column, value: Column) -> Column:
        digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(tag), size_a.cast("string"), size_b.cast("string"), i.cast("string"), value.cast("string")), 256)
        return _long(F.conv(F.substring(digest, 1, 14), 16, 10))

    def step(state: Column, i: Column) -> Column:
        x, y = state["a"], state["b"]
        return F.when(
            i % 2 == 0, F.struct(((x + noise(i, y)) % size_a).alias("a"), y.alias("b"))
        ).otherwise(F.struct(x.alias("a"), ((y + noise(i, x)) % size_b).alias("b")))

    start = F.struct(_long(a).alias("a"), _long(b).alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def permute_text(value: Column, radix: int, tag: str, key: str) -> Column:
    """Permutation of the strings of ``value``'s length over 0-9a-z below ``radix``,
    in runs of at most CHUNK characters."""

    def run(i: Column) -> Column:
        part = F.substring(value, i * CHUNK + 1, F.lit(CHUNK))
        half = F.floor(F.length(part) / 2).cast("int")
        rest = F.length(part) - half
        number = lambda text: F.conv(F.concat(F.lit("0"), text), radix, 10)
        pair = permute_pair(
            number(F.substring(part, F.lit(1), half)), number(F.substring(part, half + 1, rest)), _power(radix, half), _power(radix, rest), f"{tag}{radix}", key
        )
        shown = lambda x, n: F.lpad(F.lower(F.conv(x.cast("string"), 10, radix)), n, "0")
        return _bound(
            pair, lambda p: F.when(half == 0, shown(p["b"], rest)).otherwise(F.concat(shown(p["a"], half), shown(p["b"], rest)))
        )

    chunks = F.ceil(F.length(value) / CHUNK).cast("int")
    return F.when(F.length(value) == 0, value).otherwise(F.array_join(F.transform(F.sequence(F.lit(0), chunks - 1), run), ""))


def refill(template: Column, letters: str, values: Column) -> Column:
    """``template`` with its characters in the class ``letters`` replaced in order."""

    def place(new: Column, i: Column) -> Column:
        char = F.substring(template, i, F.lit(1))
        at = F.length(F.regexp_replace(F.substring(template, F.lit(1), i), f"[^{letters}]", ""))
        return F.when(char.rlike(f"^[{letters}]$"), F.substring(new, at, F.lit(1))).otherwise(char)

    places = F.sequence(F.lit(1), F.length(template))
    return _bound(values, lambda new: F.array_join(F.transform(places, lambda i: place(new, i)), ""))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn_sum(digits: Column) -> Column:
    """Luhn sum of a string of digits, the last one counted once."""

    def step(total: Column, i: Column) -> Column:
        digit = _long(F.substring(digits, -i, F.lit(1)))
        twice = F.when(digit > 4, 2 * digit - 9).otherwise(2 * digit)
        return total + F.when(i % 2 == 0, twice).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0).cast("bigint"), step)


def _card(value: Column, key: str) -> Column:
    digits = _digits(value)
    count = F.length(digits)
    body = F.concat(F.substring(digits, 1, 1), permute_text(F.substring(digits, F.lit(2), count - 2), 10, "card", key))
    check = lambda text: (10 - luhn_sum(F.concat(text, F.lit("0"))) % 10) % 10
    moved = _bound(body, lambda text: F.concat(text, check(text).cast("string")))
    valid = (luhn_sum(digits) % 10 == 0) & count.between(13, 19)
    return F.when(valid, refill(value, "0-9", moved))


def _mod97(text: Column) -> Column:
    def step(rest: Column, i: Column) -> Column:
        char = F.substring(text, i, F.lit(1))
        letter = rest * 100 + F.ascii(char) - 55
        return F.when(char.rlike("[A-Z]"), letter).otherwise(rest * 10 + _long(char)) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(text)), F.lit(0).cast("bigint"), step)


def _iban(value: Column, key: str) -> Column:
    plain = F.regexp_replace(value, " ", "")
    country, body = F.substring(plain, 1, 2), F.substring(plain, F.lit(5), F.length(plain) - 4)
    valid = (_mod97(F.concat(body, F.substring(plain, 1, 4))) == 1) & F.length(plain).between(15, 34)
    check = lambda text: F.lpad((98 - _mod97(F.concat(text, country, F.lit("00")))).cast("string"), 2, "0")
    moved = _bound(
        refill(body, "0-9", permute_text(_digits(body), 10, "iban", key)), lambda text: F.concat(country, check(text), text)
    )
    return F.when(valid, refill(value, "A-Z0-9", moved))


def _ip(value: Column, key: str) -> Column:
    parts = F.split(value, r"\.")
    octets = [_long(parts[i]) for i in range(4)]
    valid = octets[0].between(0, 255)
    for octet in octets[1:]:
        valid &= octet.between(0, 255)
    size = F.lit(65536).cast("bigint")
    pair = permute_pair(octets[0] * 256 + octets[1], octets[2] * 256 + octets[3], size, size, "ip", key)
    shown = lambda p: [F.floor(p["a"] / 256), p["a"] % 256, F.floor(p["b"] / 256), p["b"] % 256]
    return F.when(valid, _bound(pair, lambda p: F.concat_ws(".", *[x.cast("string") for x in shown(p)])))


def _date(value: Column, key: str) -> Column:
    """Day first where both readings are dates; the reading is kept for the result."""
    mark = F.regexp_extract(value, r"^\d{1,2}([./-])", 1)
    plain = F.when(mark == "", value).otherwise(F.regexp_replace(value, "[./]", "-"))
    patterns = ("yyyy-MM-dd", "dd-MM-yyyy", "d-M-yyyy", "MM-dd-yyyy", "M-d-yyyy")
    result = F.lit(None).cast("string")
    for pattern in reversed(patterns):
        # Only a text that prints back unchanged was in this pattern.
        day = F.to_date(F.try_to_timestamp(plain, F.lit(pattern)))
        number = F.date_diff(day, F.lit(FIRST_DAY).cast("date"))
        valid = (F.date_format(day, pattern) == plain) & number.between(0, DAYS_A * DAYS_B - 1)
        pair = permute_pair(
            F.floor(number / DAYS_B), number % DAYS_B, F.lit(DAYS_A).cast("bigint"), F.lit(DAYS_B).cast("bigint"), "date", key
        )
        moved = _bound(pair, lambda p: F.date_add(F.lit(FIRST_DAY).cast("date"), (p["a"] * DAYS_B + p["b"]).cast("int")))
        result = F.when(valid, F.date_format(moved, pattern)).otherwise(result)
    return F.when(mark == "", result).otherwise(F.replace(result, F.lit("-"), mark))


def _ssn(value: Column, key: str) -> Column:
    area, group, serial = (_long(x) for x in (F.substring(value, 1, 3), F.substring(value, 5, 2), F.substring(value, 8, 4)))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    moved = permute_pair(
        F.when(area < 666, area - 1).otherwise(area - 2), (group - 1) * 9999 + serial - 1,
        F.lit(898).cast("bigint"), F.lit(99 * 9999).cast("bigint"), "ssn", key,
    )
    new = [F.when(moved["a"] < 665, moved["a"] + 1).otherwise(moved["a"] + 2), F.floor(moved["b"] / 9999) + 1, moved["b"] % 9999 + 1]
    return F.when(valid, F.concat_ws("-", *[F.lpad(x.cast("string"), n, "0") for x, n in zip(new, (3, 2, 4))]))


def _phone(value: Column, key: str) -> Column:
    """International numbers keep their first digit, or two unless it is a 1 or 7."""
    digits = _digits(value)
    kept = F.when(~value.startswith("+"), 0).when(digits.rlike("^[17]"), 1).otherwise(2)
    moved = permute_text(F.substring(digits, kept + 1, F.length(digits) - kept), 10, "phone", key)
    return F.when(
        F.length(digits).between(8, 15), refill(value, "0-9", F.concat(F.substring(digits, F.lit(1), kept), moved))
    )


def _email(value: Column, key: str) -> Column:
    name = F.lower(F.substring_index(value, "@", 1))
    moved = permute_text(F.regexp_replace(name, "[^a-z0-9]", ""), 36, "email", key)
    return F.concat(refill(name, "a-z0-9", moved), F.lit("@"), F.substring_index(value, "@", -1))


def _key(value: Column, key: str) -> Column:
    return F.concat(F.substring(value, 1, 4), F.upper(permute_text(F.lower(F.substring(value, 5, 16)), 36, "key", key)))


def _token(value: Column, key: str) -> Column:
    """Upper-case tokens stay upper-case; mixed case becomes lower."""
    moved = permute_text(F.lower(value), 16, "token", key)
    return F.when(value.rlike("[A-F]") & ~value.rlike("[a-f]"), F.upper(moved)).otherwise(moved)


KINDS = {
    "email": _email,
    "key": _key,
    "token": _token,
    "iban": _iban,
    "ip": _ip,
    "date": _date,
    "ssn": _ssn,
    "phone": _phone,
    "card": _card,
}
# Shapes that tell the kind of a found value (the look-around of the
# search pattern is gone once the value stands alone).
SHAPES = {
    "email": "@",
    "key": "^A[KS]IA[A-Z0-9]{16}$",
    "token": "^(?=.*[a-f])[0-9a-f]{16,128}$|^[0-9]{20,128}$",
    "iban": "^[A-Z]{2}[0-9]{2}",
    "ip": r"^\d{1,3}(\.\d{1,3}){3}$",
    "date": r"^(\d{4}-\d{2}-\d{2}|\d{1,2}[./-]\d{1,2}[./-]\d{4})$",
    "ssn": r"^\d{3}-\d{2}-\d{4}$",
    "phone": r"^[+(]|^\d{3}-\d{3}-\d{4}$",
    "card": "",
}


def kind_of(value: Column) -> Column:
    found = F.lit("card")
    for kind, shape in reversed(list(SHAPES.items())[:-1]):
        found = F.when(value.rlike(shape), kind).otherwise(found)
    return found


def pseudonym(value: Column, key: str) -> Column:
    """The pseudonym of one found value; NULL if it does not validate."""
    result = F.lit(None).cast("string")
    for kind, shape in reversed(list(SHAPES.items())):
        moved = KINDS[kind](value, key)
        result = F.when(value.rlike(shape), moved).otherwise(result) if shape else moved
    return result


def _phone_fits(value: Column, digits: Column) -> Column:
    """Whether a number is as long as its country's are, so that a longer run of digit
    groups ends where the number does; 8 to 15 digits for any other."""
    code = F.substring(digits, F.lit(1), F.when(digits.rlike("^[17]"), 1).when(digits.rlike(TWO_DIGITS), 2).otherwise(3))
    bounds = F.try_element_at(F.create_map(*[x for c, b in PHONE_DIGITS.items() for x in (F.lit(c), F.array(*map(F.lit, b)))]), code)
    rest = F.length(digits) - F.length(code)
    national = F.coalesce(rest.between(bounds[0], bounds[1]), F.lit(True))
    return F.length(digits).between(8, 15) & (~value.startswith("+") | national)


def _extent(value: Column) -> Column:
    """Whether a part of a found value is an IBAN of its country's length, a phone or a card."""
    plain, digits = F.regexp_replace(value, " ", ""), _digits(value)
    lengths = F.create_map(*[F.lit(x) for n, names in IBAN_LENGTHS.items() for c in names.split() for x in (c, n)])
    body = F.concat(F.substring(plain, F.lit(5), F.length(plain) - 4), F.substring(plain, 1, 4))
    fits = F.coalesce(F.try_element_at(lengths, F.substring(plain, 1, 2)) == F.length(plain), F.length(plain).between(15, 34))
    iban = F.when(value.rlike(f"^(?:{PATTERNS['iban']})$") & fits, _mod97(body) == 1).otherwise(False)
    phone = value.rlike(f"^(?:{PATTERNS['phone']})$") & _phone_fits(value, digits)
    card = F.when(value.rlike(f"^(?:{PATTERNS['card']})$") & F.length(digits).between(13, 19), luhn_sum(digits) % 10 == 0)
    return iban | phone | card.otherwise(False)


def pieces_of(value: Column) -> Column:
    """A found value cut into pieces: itself if it is valid or holds no valid value between
    separators, else from left to right the longest valid ones and what is between."""
    char = lambda i: F.substring(value, i, F.lit(1))
    mark = lambda i: char(i).rlike("[ .()-]")
    places = F.sequence(F.lit(1), F.length(value))
    starts = F.filter(places, lambda i: ~mark(i) & ((i == 1) | mark(i - 1)))
    ends = F.reverse(F.filter(places, lambda i: ~mark(i) & ((i == F.length(value)) | mark(i + 1))))

    def step(state: Column, i: Column) -> Column:
        def take(fitting: Column) -> Column:
            end = F.get(fitting, F.lit(0))
            pair = F.array(F.substring(value, state["last"] + 1, i - 1 - state["last"]), F.substring(value, i, end - i + 1))
            return F.when(end.isNull(), state).otherwise(F.struct(end.alias("last"), F.concat(state["out"], pair).alias("out")))

        fitting = F.filter(ends, lambda e: F.when(e >= i + 7, _extent(F.substring(value, i, e - i + 1))).otherwise(False))
        return F.when(i <= state["last"], state).otherwise(_bound(fitting, take))

    start = F.struct(F.lit(0).alias("last"), F.array().cast("array<string>").alias("out"))
    inner = F.aggregate(
        starts, start, step, lambda s: F.concat(s["out"], F.array(F.substring(value, s["last"] + 1, F.length(value))))
    )
    mixed = kind_of(value).isin("iban", "card", "phone") & value.rlike("[ .-]")
    return F.when(mixed & ~_extent(value), inner).otherwise(F.array(value))


def with_pseudonyms(docs: DataFrame, text_col: str = "text", key: str = "pseudonym-key", found: str | None = None) -> DataFrame:
    """``docs`` with the personal values of ``text_col`` replaced, a text at a time.

    A number ends where its kind does (an IBAN or phone of its country's length, a card by
    its check digit), so equal numbers stay equal whatever stands behind them.

    ``found`` names an optional further column: (kind, value, pseudonym) in the order of
    the text. NULL texts stay NULL, empty ones empty; a text's length never changes but
    by a date in another width; repeated rows and clashing columns are no matter.
    """
    text = F.col(text_col)
    at_value, at_gap, at_moved = (unused(n, docs.columns) for n in ("values", "gaps", "moved"))
    values = F.when(text.rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(ANY), F.lit(0)))
    gaps = F.split(text, ANY, -1)

    def moved_one(value: Column, before: Column) -> Column:
        hidden = before.rlike(ASSIGNED) & value.rlike("^(?=.*[A-F])[0-9a-fA-F]{16,128}$")
        kind = F.when(hidden, "token").otherwise(kind_of(value))
        new = F.when(hidden, _token(value, key)).otherwise(pseudonym(value, key))
        return F.struct(kind.alias("kind"), value.alias("value"), new.alias("pseudonym"))

    def moved_pieces(value: Column, i: Column) -> Column:
        before = F.substring(F.get(at_gap, i), F.lit(-20), F.lit(20))
        return F.transform(F.when(before.rlike(ASSIGNED), F.array(value)).otherwise(pieces_of(value)), lambda v: moved_one(v, before))

    moved = F.transform(at_value, moved_pieces)
    shown = F.transform(
        at_moved, lambda m: F.array_join(F.transform(m, lambda x: F.coalesce(x["pseudonym"], x["value"])), "")
    )
    rebuilt = F.concat(F.array_join(F.zip_with(at_gap, shown, lambda g, v: F.concat(g, F.coalesce(v, F.lit("")))), ""))
    out = docs.withColumn(at_value, values).withColumn(at_gap, F.when(F.size(at_value) > 0, gaps))
    out = out.withColumn(at_moved, F.when(F.size(at_value) > 0, moved))
    names = [F.when(F.col(at_moved).isNotNull(), rebuilt).otherwise(text).alias(text_col) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    if found is not None:
        none = F.array().cast("array<struct<kind:string,value:string,pseudonym:string>>")
        names.append(F.coalesce(F.filter(F.flatten(at_moved), lambda m: m["pseudonym"].isNotNull()), none).alias(found))
    return out.select(*names)


def pseudonymise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: str = "pseudonym-key") -> DataFrame:
    """One row per document: id, text with pseudonyms, n_replaced, kinds (sorted)."""
    small = docs.select(F.col(id_col), F.col(text_col))
    return with_pseudonyms(small, text_col, key, "__found").select(
        id_col,
        text_col,
        F.size("__found").cast("long").alias("n_replaced"),
        F.array_sort(F.array_distinct(F.col("__found.kind"))).alias("kinds"),
    )
