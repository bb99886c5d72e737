"""Format-preserving Feistel pseudonyms for personal data, native column expressions only.

Validated values are permuted by a keyed Feistel network inside their own
format: a card number stays a card number with a right check digit, a date a
date, a phone number keeps its punctuation. The permutation is one-to-one and
depends on the key and the kind only, so equal values get equal pseudonyms in
every document and different values different ones.

Kinds, in the order of their patterns:
  email       the local part, letters to letters of their alphabet and digits to digits; one with letters outside ALPHABETS
              becomes a keyed token
  credential  the whole value after token, secret, password or key and = or :, quoted or up to white space,
              a mark-up bracket or the next name =
  iban        valid by modulo 97, plain or in printed groups of four: account part permuted, check digits renewed
  ip          four octets to 255: the 32-bit address
  ssn         valid area, group and serial: within the valid numbers
  date        valid ISO, day-first or else month-first date of the years 1 to 9999: within 1901 to 2096, the years before, or those after
  phone       +country, (area) or ddd-ddd-dddd forms, also with dots or spaces: the last ten digits
  card        13 to 19 digits with a right Luhn digit, but for decimals: all between the first and the last

Each network adds, in alternating rounds, a hash of one half to the other half,
modulo that half's own size; a mixed pair of moduli fits domains such as the
71,589 days of 1901 to 2096 = 147 * 487 exactly; 693,960 days before are 120 * 5783,
2,886,510 days after 330 * 8747.

Defined results: a null text stays null and counts no value; empty texts and
texts without valid values stay as they are, byte by byte; values that fail
their validation stay; texts of any length are treated whole; repeated rows
repeat their result; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basewright.llm.common import documents

#: Rounds of every network, alternating between the halves.
ROUNDS = 10
#: Key of the registered query; a deployment passes its own.
DEMO_KEY = "replace-this-key"

_START, _END = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: Printed IBANs by their country's length, so that a word after them is not taken in.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FO FI GL NL SD FK", 19: "MK SI", 20: "AT BA EE KZ LT LU XK MN", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM TL SO", 24: "AD CZ DZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_PRINTED = "|".join(
    f"(?:{names.replace(' ', '|')})" + r"\d{2}(?: [A-Z0-9]{4}){" + str(n // 4 - 1) + "}" + (f" [A-Z0-9]{{{n % 4}}}" if n % 4 else "")
    for n, names in IBAN_LENGTHS.items()
)
_NAMED = r"(?i:token|secret|password|passwd|(?:api[_-]?)?key)[\"']?\s*+[=:]\s*+"
#: A value without quotes ends with a letter, digit, _ or -, before white space, quotes, mark-up or the next name and =.
_BARE = r"(?:(?![&;,][\p{L}\p{N}_]++[=:])[^\s\"'<>])*[\p{L}\p{N}_-]"
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]+)*\.\p{L}{2,}",
    "credential": _START + _NAMED + r"(?:\"[^\"\r\n]+\"|'[^'\r\n]+'|[\"']?" + _BARE + ")",
    "iban": _START + r"(?:[A-Z]{2}\d{2}[A-Z0-9]{11,30}|" + _PRINTED + ")" + _END,
    "ip": r"(?<![\p{L}\p{N}.])" + _OCTET + (r"\." + _OCTET) * 3 + r"(?![\p{L}\p{N}]|\.\d)",
    "ssn": r"(?<![\p{L}\p{N}-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\p{L}\p{N}]|-\d)",
    "date": r"(?<![\p{L}\p{N}/.-])(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?!(?!T\d)[\p{L}\p{N}]|[/.-]\d)",
    "phone": (
        r"(?<![\p{L}\p{N}+])(?:\+\d{1,3}[ .-]?\(\d{1,4}\)[ .-]?\d{3}[ .-]?\d{4}|\+\d{8,15}|\+\d{1,3}(?:[ -]\d{2,4}){2,4}"
        r"|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}(?<p>[ .-])\d{3}\k<p>\d{4})(?![\p{L}\p{N}]|[.-]\d)"
    ),
    "card": r"(?<![\p{L}\p{N}])(?<!(?<!\d)\d{1,12}\.)(?:\d{13,19}|\d{4}(?<c>[ -])\d{4}\k<c>\d{4}\k<c>\d{1,7}|\d{4}(?<d>[ -])\d{6}\k<d>\d{5})" + _END,
}
ANY = "|".join(PATTERNS.values())
#: Lower-case alphabets (first code point, letters, distance) inside which the letters of an e-mail's local part move.
ALPHABETS = (
    (0x61, 26, 1), (0xE0, 23, 1), (0xF8, 7, 1), (0x101, 24, 2), (0x133, 3, 2), (0x13A, 8, 2), (0x14B, 23, 2), (0x17A, 3, 2),  # Latin
    (0x3B1, 17, 1), (0x3C3, 7, 1), (0x430, 32, 1), (0x450, 16, 1), (0x561, 38, 1),  # Greek, Cyrillic, Armenian
    (0x5D0, 27, 1), (0x621, 26, 1), (0x641, 10, 1), (0x905, 53, 1), (0xE01, 46, 1),  # Hebrew, Arabic, Devanagari, Thai
    (0x3041, 86, 1), (0x30A1, 90, 1), (0x4E00, 20992, 1), (0xAC00, 11172, 1),  # kana, Han, Hangul
)
FIRST_YEAR, DAYS, DAY_MODULI = 1901, 71589, (147, 487)
#: The same for the years 1 to 1900 and 2097 to 9999.
EARLY_MODULI, LATE_MODULI = (120, 5783), (330, 8747)


def _hash(key: str, *parts) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts]), 256)


def _number(digest: Column) -> Column:
    """60 bits of a hex digest."""
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def _feistel(key: str, kind: str, left: Column, right: Column, a: Column | int, b: Column | int, finish) -> Column:
    """Permute (left, right) within [0, a) x [0, b) and give finish(left, right)."""
    a, b = (x if isinstance(x, Column) else F.lit(x).cast("long") for x in (a, b))

    def turn(s, i):
        return F.struct(
            F.when(i % 2 == 0, (s["l"] + _number(_hash(key, kind, i.cast("string"), s["r"].cast("string")))) % a).otherwise(s["l"]).alias("l"),
            F.when(i % 2 == 1, (s["r"] + _number(_hash(key, kind, i.cast("string"), s["l"].cast("string")))) % b).otherwise(s["r"]).alias("r"),
        )

    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda s: finish(s["l"], s["r"]))


def _digits(key: str, kind: str, digits: Column) -> Column:
    """Permute a string of 2 to 18 digits among those of its length."""
    n = F.length(digits)
    u = F.floor(n / 2).cast("int")
    v = n - u
    power = lambda k: F.pow(F.lit(10.0), k).cast("long")
    left, right = F.substring(digits, F.lit(1), u), F.substring(digits, u + 1, v)
    tweak = F.concat(F.lit(kind), n.cast("string"))
    return _feistel(
        key, tweak, left, right, power(u), power(v),
        lambda x, y: F.concat(F.lpad(x.cast("string"), u, F.lit("0")), F.lpad(y.cast("string"), v, F.lit("0"))),
    )


def _letters(key: str, tweak: Column, value: Column, radix: Column | int) -> Column:
    """Permute a string place by place in alternating halves: digits stay digits, letters a to z letters of their case."""
    radix = radix if isinstance(radix, Column) else F.lit(radix)
    low = F.lower(value)
    u = F.floor(F.length(low) / 2).cast("int")

    def moved(half: Column, other: Column, i: Column) -> Column:
        digest = _hash(key, tweak, i.cast("string"), other)

        def one(c, k):
            step = F.conv(F.substring(digest, (k % 16) * 4 + 1, F.lit(4)), 16, 10).cast("int")
            return (
                F.when(c.between("0", "9"), F.char(F.lit(48) + (F.ascii(c) - 48 + step) % 10))
                .when(c.between("a", "z") & (F.ascii(c) - 97 < radix), F.char(F.lit(97) + (F.ascii(c) - 97 + step) % radix))
                .otherwise(c)
            )

        return F.array_join(F.transform(F.split(half, ""), one), "")

    def turn(s, i):
        return F.struct(
            F.when(i % 2 == 0, moved(s["l"], s["r"], i)).otherwise(s["l"]).alias("l"),
            F.when(i % 2 == 1, moved(s["r"], s["l"], i)).otherwise(s["r"]).alias("r"),
        )

    start = F.struct(F.substring(low, F.lit(1), u).alias("l"), F.substring(low, u + 1, F.length(low)).alias("r"))
    permuted = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda s: F.concat(s["l"], s["r"]))
    cased = F.zip_with(F.split(permuted, ""), F.split(value, ""), lambda p, c: F.when(c.between("A", "Z"), F.upper(p)).otherwise(p))
    return F.array_join(cased, "")


def _into(form: Column, digits: Column) -> Column:
    """Put digits in the places of the form's digits, from left to right."""
    between = F.split(form, r"\d", -1)
    return F.concat(F.array_join(F.zip_with(F.slice(between, 1, F.length(digits)), F.split(digits, ""), lambda a, b: F.concat(a, b)), ""), F.element_at(between, -1))


def _luhn(digits: Column, doubled: int) -> Column:
    """Luhn sum; places i from the right (the last is 1) with i % 2 == doubled count double."""

    def add(total, i):
        digit = F.substring(digits, F.length(digits) + 1 - i, F.lit(1)).cast("int")
        twice = digit * 2
        return total + F.when(i % 2 == doubled, twice - F.when(twice > 9, 9).otherwise(0)).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add)


def _mod97(text: Column) -> Column:
    def add(total, c):
        digit = c.between("0", "9")
        return F.when(digit, (total * 10 + F.ascii(c) - 48) % 97).otherwise((total * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.split(text, ""), F.lit(0), add)


def _plain(value: Column) -> Column:
    return F.regexp_replace(value, r"\D", "")


def _wide(key: str, tweak: Column, low: Column) -> Column:
    """Like ``_letters`` for lower-case text of all ALPHABETS, as an array of characters."""

    def character(code: Column) -> Column:
        return F.decode(F.unhex(F.lpad(F.hex(code), 4, "0")), "UTF-16BE")

    def moved(half: Column, other: Column, i: Column) -> Column:
        digest = _hash(key, tweak, i.cast("string"), F.array_join(other, ""))

        def one(c, k):
            step = F.conv(F.substring(digest, (k % 16) * 4 + 1, F.lit(4)), 16, 10).cast("int")
            code = F.ascii(c)
            new = F.when(c.between("0", "9"), F.char(F.lit(48) + (code - 48 + step) % 10))
            for first, size, gap in ALPHABETS:
                inside = code.between(first, first + (size - 1) * gap) & ((code - first) % gap == 0)
                new = new.when(inside, character(F.lit(first) + (F.floor((code - first) / gap) + step) % size * gap))
            return new.otherwise(c)

        return F.transform(half, one)

    u = F.floor(F.size(low) / 2).cast("int")

    def turn(s, i):
        return F.struct(
            F.when(i % 2 == 0, moved(s["l"], s["r"], i)).otherwise(s["l"]).alias("l"),
            F.when(i % 2 == 1, moved(s["r"], s["l"], i)).otherwise(s["r"]).alias("r"),
        )

    start = F.struct(F.slice(low, F.lit(1), u).alias("l"), F.slice(low, u + 1, F.size(low)).alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda s: F.concat(s["l"], s["r"]))


def _email(key: str, v: Column) -> Column:
    domain, local = F.substring_index(v, "@", -1), F.substring_index(v, "@", 1)
    tweak = F.concat(F.lit("email "), F.lower(domain))
    low = F.lower(local)
    known = r"^[0-9._%+\-" + "".join(
        f"{chr(first)}-{chr(first + size - 1)}" if gap == 1 else "".join(chr(first + gap * i) for i in range(size)) for first, size, gap in ALPHABETS
    ) + "]+$"
    wide = F.zip_with(_wide(key, tweak, F.split(low, "")), F.split(local, ""), lambda p, c: F.when(c != F.lower(c), F.upper(p)).otherwise(p))
    token = F.concat(F.lit("u"), F.substring(_hash(key, F.concat(F.lit("token "), F.lower(domain)), low), 1, 24))
    fits = low.rlike(known) & (F.length(low) == F.length(local))
    new = F.when(local.rlike(r"^[\x00-\x7F]+$"), _letters(key, tweak, local, 26)).when(fits, F.array_join(wide, "")).otherwise(token)
    return F.concat(new, F.lit("@"), domain)


def _credential(key: str, v: Column) -> Column:
    split = "^(" + _NAMED + r"[\"']?)(.*?)([\"']?)$"
    head, value, tail = (F.regexp_extract(v, split, i) for i in (1, 2, 3))
    radix = F.when(value.rlike("^[0-9a-fA-F]+$"), 6).otherwise(26)
    return F.concat(head, _letters(key, F.lit("credential"), value, radix), tail)


def _iban(key: str, shown: Column) -> Column:
    v = F.regexp_replace(shown, " ", "")
    country = F.substring(v, 1, 2)
    valid = _mod97(F.concat(F.substring(v, F.lit(5), F.length(v)), F.substring(v, 1, 4))) == 1
    account = _letters(key, F.concat(F.lit("iban "), country), F.substring(v, F.lit(5), F.length(v)), 26)
    renewed = F.transform(
        F.array(account), lambda a: F.concat(country, F.lpad((98 - _mod97(F.concat(a, country, F.lit("00")))).cast("string"), 2, "0"), a)
    )
    printed = F.regexp_replace(renewed[0], "(.{4})(?=.)", "$1 ")
    return F.when(valid, F.when(shown.contains(" "), printed).otherwise(renewed[0]))


def _ip(key: str, v: Column) -> Column:
    octet = lambda i: F.split(v, r"\.")[i].cast("int")
    shown = lambda x: F.concat(F.floor(x / 256).cast("string"), F.lit("."), (x % 256).cast("string"))
    return _feistel(key, "ip", octet(0) * 256 + octet(1), octet(2) * 256 + octet(3), 65536, 65536, lambda x, y: F.concat(shown(x), F.lit("."), shown(y)))


def _ssn(key: str, v: Column) -> Column:
    area, group, serial = F.substring(v, 1, 3).cast("int"), F.substring(v, 5, 2).cast("int"), F.substring(v, 8, 4).cast("int")
    place = area - F.when(area > 666, 2).otherwise(1)

    def shown(x, y):
        number = x + F.when(x >= 665, 2).otherwise(1)
        two = lambda n, k: F.lpad(n.cast("string"), k, "0")
        return F.concat(two(number, 3), F.lit("-"), two(F.floor(y / 9999) + 1, 2), F.lit("-"), two(y % 9999 + 1, 4))

    return _feistel(key, "ssn", place, (group - 1) * 9999 + serial - 1, 898, 99 * 9999, shown)


def _date(key: str, v: Column) -> Column:
    iso = F.substring(v, 5, 1) == "-"
    part = lambda a, n: F.substring(v, a, n).cast("int")
    year = F.when(iso, part(1, 4)).otherwise(part(7, 4))
    second = F.when(iso, part(6, 2)).otherwise(part(4, 2))
    first = F.when(iso, part(9, 2)).otherwise(part(1, 2))
    month_first = second > 12  # day-first unless that cannot be

    month, day = F.when(month_first, first).otherwise(second), F.when(month_first, second).otherwise(first)
    start = F.make_date(year, month, F.lit(1))
    early, late = year < FIRST_YEAR, year > FIRST_YEAR + 195
    by_age = lambda a, b, c: F.when(early, a).when(late, c).otherwise(b)
    first_day = by_age("0001-01-01", f"{FIRST_YEAR}-01-01", f"{FIRST_YEAR + 196}-01-01").cast("date")
    a, b = (by_age(*[F.lit(m[i]).cast("long") for m in (EARLY_MODULI, DAY_MODULI, LATE_MODULI)]) for i in (0, 1))
    known = year.between(1, 9999) & month.between(1, 12) & (~iso | ~month_first)
    valid = known & F.when(known, day.between(F.lit(1), F.dayofmonth(F.last_day(start)))).otherwise(False)
    number = F.datediff(start, first_day) + day - 1
    mark = F.substring(v, 3, 1)

    def shown(x, y):
        new = F.date_add(first_day, (x * b + y).cast("int")).cast("string")
        y4, m2, d2 = F.substring(new, 1, 4), F.substring(new, 6, 2), F.substring(new, 9, 2)
        other = F.when(month_first, F.concat(m2, mark, d2)).otherwise(F.concat(d2, mark, m2))
        return F.when(iso, F.concat(y4, F.lit("-"), m2, F.lit("-"), d2)).otherwise(F.concat(other, mark, y4))

    permuted = _feistel(key, by_age("date early", "date", "date late"), F.floor(number / b), number % b, a, b, shown)
    return F.when(valid, permuted)


def _phone(key: str, v: Column) -> Column:
    digits = _plain(v)
    n = F.length(digits)
    kept = F.greatest(n - 10, F.lit(0))
    new = F.concat(F.substring(digits, F.lit(1), kept), _digits(key, "phone", F.substring(digits, kept + 1, F.lit(10))))
    return F.when(n.between(8, 15), _into(v, new))


def _card(key: str, v: Column) -> Column:
    digits = _plain(v)
    n = F.length(digits)
    body = F.concat(F.substring(digits, 1, 1), _digits(key, "card", F.substring(digits, F.lit(2), n - 2)))
    full = F.transform(F.array(body), lambda b: F.concat(b, ((10 - _luhn(b, 1) % 10) % 10).cast("string")))[0]
    return F.when(_luhn(digits, 0) % 10 == 0, _into(v, full))


_MAKERS = {"email": _email, "credential": _credential, "iban": _iban, "ip": _ip, "ssn": _ssn, "date": _date, "phone": _phone, "card": _card}


def pseudonym(key: str, value: Column) -> Column:
    """(kind, pseudonym) of a string that ANY found; the pseudonym is null where validation fails."""
    kind = F.lit(None).cast("string")
    new = F.lit(None).cast("string")
    for name in reversed(PATTERNS):
        is_it = value.rlike(f"^(?:{PATTERNS[name]})$")
        kind = F.when(is_it, name).otherwise(kind)
        new = F.when(is_it, _MAKERS[name](key, value)).otherwise(new)
    return F.struct(kind.alias("kind"), new.alias("pseudonym"))


def pseudonymise(df: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text with pseudonyms, n_replaced, kinds (one entry a replaced value, in text order)."""
    text = F.col("text")
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    some = text.rlike("[0-9@=:]")  # every pattern has one of these; the others need no second look
    found = F.when(some, F.regexp_extract_all("text", F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    marked = rows.withColumn("values", found)
    marked = marked.withColumn("made", F.transform("values", lambda v: pseudonym(key, v)))
    shown = F.zip_with("values", "made", lambda v, m: F.coalesce(m["pseudonym"], v))
    parts = F.split("text", ANY, -1)
    # Between every two neighbouring parts stands exactly one value.
    rebuilt = F.concat(F.array_join(F.zip_with(F.slice(parts, F.lit(1), F.size("values")), shown, lambda p, s: F.concat(p, s)), ""), F.element_at(parts, -1))
    # A permutation may leave a value in its place; such a value is not counted as replaced.
    replaced = F.filter(F.zip_with("values", "made", lambda v, m: F.struct(m["kind"].alias("kind"), (m["pseudonym"] != v).alias("new"))), lambda m: m["new"])
    return marked.select(
        "doc_id",
        F.when(F.size("values") > 0, rebuilt).otherwise(text).alias("text"),
        F.coalesce(F.size(replaced), F.lit(0)).cast("long").alias("n_replaced"),
        F.coalesce(F.transform(replaced, lambda m: m["kind"]), F.array().cast("array<string>")).alias("kinds"),
    )


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(documents(spark, sf_dir), DEMO_KEY)
