"""PII surrogates: each entity gets a keyed stand-in of the same type and format, everywhere the same."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, join_hashed, key2, prefix_for, quoted, read_table

#: Titles that announce a person, by gender. Fixed values.
MALE = ("Mr", "Sir", "Herr", "Monsieur", "Señor", "Sr", "Signor", "Господин", "Κύριος")
FEMALE = ("Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Signora", "Госпожа", "Κυρία")
OPEN = ("Dr", "Prof", "Доктор")

_TITLES = r"(?:(?:" + "|".join(MALE + FEMALE + OPEN) + r")\.? )+"
_NAME = r"(?:\p{Lu}['’])?\p{Lu}[\p{L}\p{M}]+(?:[-'’]\p{Lu}[\p{L}\p{M}]+)?"
_SECRET = r"(?i:passw(?:or)?d|secret|token|api[_-]?key)[ \t]?[=:][ \t]?[\"']?"
#: Type -> pattern, in the order in which they are tried at a place in the text.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}+@[\p{L}\p{N}-]{1,63}(?:\.[\p{L}\p{N}-]{1,63}){0,8}\.\p{L}{2,24}",
    "secret": _SECRET + r"[^\s\"']{6,}",
    "access_key": r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ip": r"\b(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\b",
    "ipv6": r"(?<![\p{L}\p{N}:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){2,6}:(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,4})?)(?![\p{L}\p{N}:])",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "phone": r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}\b|\(\d{3}\) ?\d{3}[ .-]\d{4}\b|\b\d{3}[.-]\d{3}[.-]\d{4}\b",
    "card": r"\b(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5})\b",
    "name": r"\b" + _TITLES + _NAME + r"(?: " + _NAME + r")?",
}
ENTITY = "|".join(f"(?:{p})" for p in PATTERNS.values())
_TITLE = "^" + _TITLES
#: What any entity holds.
_HINT = r"[0-9@=:]|AKIA|ASIA|(?:" + "|".join(MALE + FEMALE + OPEN) + r")\.? \p{Lu}"

#: Before a word with a capital, and after any word.
_WORD_EDGES = r"(?<![\p{L}\p{M}])(?=\p{Lu})|(?<=[\p{L}\p{M}])(?![\p{L}\p{M}])"

_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
_CYRILLIC = "абвгдежзийклмнопрстуфхцчшщъыьэюя"
_GREEK = "αβγδεζηθικλμνξοπρστυφχψω"
#: Syllables and endings of invented names, by script: consonants, vowels, endings for men, for women.
_SYLLABLES = {
    "latin": ("bdfgklmnprstvz", "aeiou", ("an", "or", "us", "in"), ("a", "ina", "ella", "ia")),
    "cyrillic": ("бвгдзклмнпрст", "аеиоу", ("ан", "ор", "ин", "ей"), ("а", "ина", "ия", "ела")),
    "greek": ("βγδζκλμνπρστ", "αειου", ("ος", "ης", "ων", "ις"), ("α", "η", "ία", "ίνα")),
}


def _byte(digest: Column, i: Column | int) -> Column:
    """Byte i (around) of a hex digest of 64 bytes."""
    at = F.lit(i) if isinstance(i, int) else i
    return F.conv(F.substr(digest, at % 64 * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _pick(alphabet: str, b: Column) -> Column:
    return F.substr(F.lit(alphabet), b % len(alphabet) + 1, F.lit(1))


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, "", -1), lambda c: c != "")


def _alike(text: Column, digest: Column, letters: Column | None = None) -> Column:
    """text with each letter and digit replaced by another of its kind and script."""

    def one(c: Column, i: Column) -> Column:
        b = _byte(digest, i)
        low = F.lower(c)
        lower = (
            F.when(low.rlike("^[a-z]$"), F.when(letters, _pick("abcdef", b)).otherwise(_pick(_LOWER, b)) if letters is not None else _pick(_LOWER, b))
            .when(low.rlike(r"^\p{IsCyrillic}$"), _pick(_CYRILLIC, b)).when(low.rlike(r"^\p{IsGreek}$"), _pick(_GREEK, b)).when(low.rlike(r"^\p{L}$"), _pick(_LOWER, b))
        )
        return F.when(c.rlike("^[0-9]$"), _pick(_DIGITS, b)).when(lower.isNull(), c).when(c != low, F.upper(lower)).otherwise(lower)

    return F.array_join(F.transform(_chars(text), one), "")


def _luhn_digit(digits: Column) -> Column:
    """The digit that makes `digits` and it a valid card number."""
    total = F.aggregate(
        F.transform(F.reverse(_chars(digits)), lambda c, i: F.when(i % 2 == 1, c.cast("int")).otherwise(F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2))),
        F.lit(0), lambda s, x: s + x,
    )
    return F.pmod(-total, F.lit(10)).cast("string")


def _iban_digits(country: Column, rest: Column) -> Column:
    """The two check digits of an IBAN."""
    digit = lambda c: F.when(c.rlike("^[0-9]$"), c).otherwise((F.ascii(c) - 55).cast("string"))
    left = F.aggregate(_chars(F.array_join(F.transform(_chars(F.concat(rest, country, F.lit("00"))), digit), "")), F.lit(0), lambda s, c: (s * 10 + c.cast("int")) % 97)
    return F.lpad((98 - left).cast("string"), 2, "0")


def _invented(kind: Column, script: Column, digest: Column, extra: Column) -> Column:
    """A name of invented syllables in the script; `extra` syllables more than two."""
    made = None
    for name, (consonants, vowels, men, women) in _SYLLABLES.items():
        syllable = lambda i: F.concat(_pick(consonants, _byte(digest, i * 2)), _pick(vowels, _byte(digest, i * 2 + 1)))  # noqa: B023, E731
        stem = F.array_join(F.transform(F.sequence(F.lit(0), extra + 1), syllable), "")
        ending = lambda ends: F.element_at(F.array(*map(F.lit, ends)), _byte(digest, 60) % len(ends) + 1)
        last = F.when(kind == "given_m", F.concat(_pick(consonants, _byte(digest, 61)), ending(men))).when(kind == "given_f", F.concat(_pick(consonants, _byte(digest, 61)), ending(women))).otherwise(
            F.concat(_pick(consonants, _byte(digest, 61)), _pick(vowels, _byte(digest, 62)), _pick(consonants, _byte(digest, 63)))
        )
        one = F.initcap(F.concat(stem, last))
        made = F.when(script == name, one) if made is None else made.when(script == name, one)
    return made


def entity_type(value: Column) -> Column:
    """The type of a match of ENTITY; null for a number that only looks like a card or an account: its check digits are wrong."""
    bare = F.regexp_replace(value, "[ -]", "")
    found = None
    for kind, pattern in PATTERNS.items():
        test = value.rlike(f"^(?:{pattern})$")
        if kind == "card":
            result = F.when(_luhn_digit(F.left(bare, F.char_length(bare) - 1)) == F.right(bare, F.lit(1)), kind)
        elif kind == "iban":
            result = F.when(_iban_digits(F.left(bare, F.lit(2)), F.substr(bare, F.lit(5))) == F.substr(bare, F.lit(3), F.lit(2)), kind)
        else:
            result = F.lit(kind)
        found = F.when(test, result) if found is None else found.when(test, result)
    return found


def _plain_case(word: Column) -> Column:
    """A name in capitals as it is written otherwise: capital first letters of its parts."""
    low = F.transform(_chars(F.lower(word)), lambda c, i: F.when((i == 0) | F.get(_chars(word), i - 1).rlike("^[-'’]$"), F.upper(c)).otherwise(c))
    return F.when((word == F.upper(word)) & (F.char_length(word) > 1), F.array_join(low, "")).otherwise(word)


def _units(kind: Column, value: Column) -> Column:
    """The parts of an entity that get a stand-in each: (kind, canonical form). Forms that differ only in
    separators, or an e-mail's case, are one; a title's given name, with the gender that the title says, and surname are two."""
    unit = lambda k, c: F.struct(k.alias("kind"), c.alias("canon"))
    bare = F.regexp_replace(value, r"[^\p{L}\p{N}]", "")
    titles = F.split(F.regexp_extract(value, _TITLE, 0), r"[. ]+", -1)
    says = lambda which: F.arrays_overlap(titles, F.array(*map(F.lit, which)))
    gender = F.when(says(MALE), "given_m").when(says(FEMALE), "given_f").otherwise("given_u")
    words = F.transform(F.split(F.regexp_replace(value, _TITLE, ""), " ", -1), _plain_case)
    names = F.when(F.size(words) > 1, F.array(unit(gender, F.get(words, F.lit(0))), unit(F.lit("surname"), F.get(words, F.lit(1))))).otherwise(F.array(unit(F.lit("surname"), F.get(words, F.lit(0)))))
    low = F.lower(value)
    return (
        F.when(kind == "name", names)
        .when(kind == "email", F.array(unit(F.lit("mailbox"), low), unit(F.lit("domain"), F.substring_index(low, "@", -1))))
        .when(kind == "secret", F.array(unit(F.lit("secret"), F.regexp_replace(value, "^" + _SECRET, ""))))
        .when(kind == "ip", F.array(unit(kind, value)))
        .when(kind == "ipv6", F.array(unit(kind, low)))
        .when((kind == "phone") & value.startswith("+"), F.array(unit(F.lit("phone"), F.concat(F.lit("+"), F.regexp_extract(value, r"^\+(\d{1,3})", 1), F.lit(" "), F.substr(bare, F.char_length(F.regexp_extract(value, r"^\+(\d{1,3})", 1)) + 1)))))
        .otherwise(F.array(unit(kind, bare)))
    )


def _hmac(key: str, message: Column) -> Column:
    """HMAC-SHA-512 of the message, in hex."""
    raw = key.encode()
    raw = (hashlib.sha512(raw).digest() if len(raw) > 128 else raw).ljust(128, b"\0")
    inner = F.sha2(F.concat(F.lit(bytes(b ^ 0x36 for b in raw)), message.cast("binary")), 512)
    return F.sha2(F.concat(F.lit(bytes(b ^ 0x5C for b in raw)), F.unhex(inner)), 512)


def _stand_in(kind: Column, canon: Column, nonce: Column, key: str) -> Column:
    """The stand-in of a unit: a keyed function of kind, canonical form and nonce."""
    digest = _hmac(key, F.concat_ws("|", kind, F.char_length(canon).cast("string"), canon, nonce.cast("string")))
    script = F.when(canon.rlike(r"\p{IsCyrillic}"), "cyrillic").when(canon.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")
    local = F.substring_index(canon, "@", 1)
    tail = F.array_join(F.transform(F.sequence(F.lit(1), nonce), lambda i: _pick(_LOWER, _byte(digest, i + 20))), "")
    mailbox = F.concat(_alike(local, digest), F.when(nonce > 0, tail).otherwise(""))
    host = F.regexp_extract(canon, r"^(.*)\.[^.]+$", 1)
    octets = F.transform(F.split(canon, r"\.", -1), lambda o, i: F.when(F.char_length(o) == 1, _byte(digest, i) % 9 + 1).when(F.char_length(o) == 2, _byte(digest, i) % 90 + 10).otherwise(_byte(digest, i) % 124 + 100).cast("string"))
    wide = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (_byte(digest, i) % 254 + 1).cast("string"))
    cc = F.substring_index(canon, " ", 1)
    digits = F.when(canon.contains(" "), F.substring_index(canon, " ", -1)).otherwise(canon)
    number = F.concat(_pick("23456789", _byte(digest, 63)), _alike(F.substr(digits, F.lit(2)), digest))
    body = F.concat(F.substr(canon, F.lit(1), F.lit(1)), _alike(F.substr(canon, F.lit(2), F.char_length(canon) - 2), digest))
    account = _alike(F.substr(canon, F.lit(5)), digest)
    hexed = canon.rlike("^[0-9a-f]+$")
    # a format with hardly a form left grows by a digit or letter a round
    more = F.greatest(nonce - 3, F.lit(0))
    digits_more = F.when(more > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(more, F.lit(1))), lambda i: _pick(_DIGITS, _byte(digest, i + 30))), "")).otherwise("")
    letters_more = F.when(more > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(more, F.lit(1))), lambda i: _pick(_UPPER, _byte(digest, i + 30))), "")).otherwise("")
    number, body, account = F.concat(number, digits_more), F.concat(body, digits_more), F.concat(account, digits_more)
    return (
        F.when(kind.isin("given_m", "given_f", "given_u", "surname"), _invented(kind, script, digest, nonce))
        .when(kind == "mailbox", mailbox)
        .when(kind == "domain", F.concat(_alike(host, digest), F.when(nonce > 0, tail).otherwise(""), F.lit("."), F.substring_index(canon, ".", -1)))
        .when(kind == "ip", F.array_join(F.when(nonce < 2, octets).otherwise(wide), "."))  # short forms are few
        .when(kind == "ipv6", _alike(F.when(more > 0, F.lit(":".join(["2a00"] * 8))).otherwise(canon), digest, F.lit(True)))
        .when(kind == "secret", F.concat(_alike(canon, digest, hexed), F.when(nonce > 1, tail).otherwise("")))
        .when(kind == "phone", F.when(canon.contains(" "), F.concat(cc, F.lit(" "), number)).otherwise(number))
        .when(kind == "ssn", F.concat(_pick("12345", _byte(digest, 63)), _alike(F.substr(canon, F.lit(2)), digest), digits_more))
        .when(kind == "card", F.concat(body, _luhn_digit(body)))
        .when(kind == "iban", F.concat(F.substr(canon, F.lit(1), F.lit(2)), _iban_digits(F.substr(canon, F.lit(1), F.lit(2)), account), account))
        .when(kind == "access_key", F.concat(F.substr(canon, F.lit(1), F.lit(4)), _alike(F.substr(canon, F.lit(5)), digest), letters_more))
        .otherwise(F.concat(_alike(canon, digest, hexed), digits_more))
    )


def surrogate_table(units: DataFrame, key: str, *, max_rounds: int = 24) -> DataFrame:
    """units(kind, canon), distinct, with a stand-in each: no two of a kind get the same, and none gets a
    form that a unit of its kind (of any name, for names) really has.

    Units that clash draw again with the next nonce, until none is left: those that drew first keep what they have, then the
    least canonical form does. Only units that clash go into the next round. From some rounds on, forms grow, so that a kind with more units
    than forms of its own length has enough. Raises if clashes remain after max_rounds all the same.
    """
    drawn = lambda df: df.withColumn("stand_in", _stand_in(F.col("kind"), F.col("canon"), F.col("nonce"), key))
    real = cut(units.select(_family(F.col("kind")).alias("k"), _shown(F.col("kind"), F.col("canon")).alias("c")).distinct())
    new, table = cut(drawn(units.select("kind", "canon", F.lit(0).alias("nonce")))), None
    order = F.struct("nonce", "canon")
    for _ in range(max_rounds):
        # those that keep theirs are written once: later draws give way to them, and only what clashes is drawn and written again
        free = new.join(real, (_family(F.col("kind")) == F.col("k")) & (F.col("stand_in") == F.col("c")), "left_anti")
        if table is not None:
            free = free.join(table.select("kind", "stand_in"), ["kind", "stand_in"], "left_anti")
        winners = cut(free.groupBy("kind", "stand_in").agg(F.min(order).alias("first")).select("kind", F.col("first.canon").alias("canon"), F.col("first.nonce").alias("nonce"), "stand_in"))
        table = winners if table is None else table.unionByName(winners)
        left = cut(new.join(winners.select("kind", "canon"), ["kind", "canon"], "left_anti").select("kind", "canon", (F.col("nonce") + 1).alias("nonce")))
        if left.isEmpty():
            return table
        new = cut(drawn(left))
    raise ValueError("no distinct surrogates: too many entities of a kind for its format")


def _family(kind: Column) -> Column:
    return F.when(kind.isin("given_m", "given_f", "given_u", "surname"), "name").otherwise(kind)


def _shown(kind: Column, canon: Column) -> Column:
    """A unit's real form, as stand-ins of its kind look."""
    return F.when(kind == "mailbox", F.substring_index(canon, "@", 1)).otherwise(canon)


def _filled(value: Column, stand_in: Column) -> Column:
    """stand_in's letters and digits in the places, and with the case, of value's."""
    drawn = _chars(F.regexp_replace(stand_in, r"[^\p{L}\p{N}]", ""))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("k"))

    def step(acc: Column, c: Column) -> Column:
        d = F.get(drawn, acc["k"])
        put = F.when((c != F.lower(c)), F.upper(d)).otherwise(d)
        put = F.when(put.isNull(), c).otherwise(put)
        return F.when(c.rlike(r"^[\p{L}\p{N}]$"), F.struct(F.concat(acc["out"], put).alias("out"), (acc["k"] + 1).alias("k"))).otherwise(F.struct(F.concat(acc["out"], c).alias("out"), acc["k"].alias("k")))

    # what is longer than value goes on behind it
    return F.aggregate(_chars(value), start, step, lambda acc: F.concat(acc["out"], F.array_join(F.slice(drawn, acc["k"] + 1, F.greatest(F.size(drawn) - acc["k"], F.lit(0))), "")))


def _gendered(parts: DataFrame) -> DataFrame:
    """parts(kind, canon, n, ...) with the gender of given names whose title says none: that of the same name's other
    titles, if there are any. So "Dr John Smith" is "Mr John Smith"."""
    men, women = (F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)) for k in ("given_m", "given_f"))
    known = parts.where(F.col("kind").isin("given_m", "given_f", "given_u")).groupBy(F.col("canon").alias("given")).agg(men.alias("men"), women.alias("women")).where("men + women > 0")
    both = parts.join(known, F.col("canon") == F.col("given"), "left")
    kind = F.when((F.col("kind") == "given_u") & F.col("given").isNotNull(), F.when(F.col("men") >= F.col("women"), "given_m").otherwise("given_f")).otherwise(F.col("kind"))
    return both.withColumn("kind", kind).drop("given", "men", "women")


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with each entity of PATTERNS in `text_col` replaced by its surrogate, and n_entities (long).

    A surrogate is of the same type, script and format (separators, case, lengths; valid check digits;
    an IP address of valid octets; a name that fits its title's gender; mail domains map as one) and the
    same for the same entity in all documents. Different entities get different surrogates and none
    gets one that occurs itself (surrogate_table). The key, by HMAC, decides them all. Formats are kept but where a kind has
    about as many entities as forms of theirs: then they grow by a letter or digit, or IP addresses change their lengths.

    Names are found after one or more titles, in capitals too; then the same document's bare repeats of their parts ("Smith said", "SMITH") are replaced
    too, but not counted; a part that is a common word as well is replaced wherever it has a capital. A name that no title announces anywhere in its document isn't found, nor are postal addresses and birth
    dates. Numbers with wrong check digits are neither cards nor accounts.

    Texts are searched once. Distinct entities, not texts, go through the rounds; hot entities combine before the shuffle and can
    be split where they join. Null text stays null with 0 entities, empty text empty; equal rows get equal results; other
    columns pass through; one named n_entities is replaced.
    """
    docs = docs.select(*(quoted(c) for c in docs.columns if c != "n_entities"))
    p = prefix_for(docs)
    a, b, swaps, names = f"{p}a", f"{p}b", f"{p}swaps", f"{p}names"
    text = quoted(text_col)
    k1, k2 = key2(quoted(id_col), text)

    rows = docs.select(k1.alias("a"), k2.alias("b"), text.alias("body")).where(F.col("body").rlike(_HINT))
    rows = rows.select("a", "b", F.posexplode(F.regexp_extract_all("body", F.lit(ENTITY), F.lit(0))).alias("pos", "value"))
    h1, h2 = key2(F.col("value"))
    rows = cut(rows.select("a", "b", "pos", "value", h1.alias("h1"), h2.alias("h2")))
    values = cut(rows.groupBy("value").agg(F.count("*").alias("n")).withColumn("type", entity_type(F.col("value"))))
    values = values.withColumn("units", F.when(F.col("type").isNotNull(), _units(F.col("type"), F.col("value"))))
    parts = values.select("value", "type", "n", F.posexplode("units").alias("i", "u")).select("value", "type", "n", "i", F.col("u.kind").alias("kind"), F.col("u.canon").alias("canon"))
    parts = cut(_gendered(parts))
    table = surrogate_table(parts.select("kind", "canon").distinct(), key)

    parts = parts.join(table.select("kind", "canon", "stand_in"), ["kind", "canon"]).groupBy("value", "type").agg(F.sort_array(F.collect_list(F.struct("i", "canon", "stand_in"))).alias("u"))
    parts = parts.select("value", "type", F.col("u.stand_in").alias("s"), F.when(F.col("type") == "name", F.arrays_zip(F.col("u.canon").alias("w"), F.col("u.stand_in").alias("s"))).alias("names"))
    first, bare = F.get("s", F.lit(0)), F.regexp_replace("value", _TITLE, "")
    prefix = F.when(F.col("type") == "secret", F.regexp_extract("value", "^" + _SECRET, 0)).otherwise("")
    mail = F.array_join("s", "@")
    new = (
        F.when(F.col("type") == "name", F.concat(F.regexp_extract("value", _TITLE, 0), F.when(bare == F.upper(bare), F.upper(F.array_join("s", " "))).otherwise(F.array_join("s", " "))))
        .when((F.col("type") == "email") & (F.char_length(mail) == F.char_length("value")), _filled(F.col("value"), mail))
        .when(F.col("type") == "email", mail)
        .when(F.col("type") == "ip", first)
        .when((F.col("type") == "ipv6") & (F.char_length(first) != F.char_length("value")), first)
        .when((F.col("type") == "secret") & (F.char_length(F.concat(prefix, first)) != F.char_length("value")), F.concat(prefix, first))
        .otherwise(F.concat(prefix, _filled(F.substr("value", F.char_length(prefix) + 1), first)))
    )
    h1, h2 = key2(F.col("value"))
    swap = parts.select(h1.alias("h1"), h2.alias("h2"), new.alias("new"), "names")
    found = join_hashed(rows, swap, "h1", "h2", "left").select("a", "b", "pos", F.coalesce("new", "value").alias("new"), "names", F.col("new").isNotNull().alias("is_entity"))
    found = found.groupBy("a", "b").agg(F.sort_array(F.collect_set(F.struct("pos", "new", "is_entity"))).alias(swaps), F.sort_array(F.array_distinct(F.flatten(F.collect_set("names")))).alias(names))
    found = found.where(F.exists(swaps, lambda x: x["is_entity"])).withColumnsRenamed({"a": a, "b": b})

    out = docs.withColumns({a: k1, b: k2}).join(found, [a, b], "left")
    # of a word with two stand-ins in a document, the first
    known = F.map_from_entries(F.filter(names, lambda x, i: (i == 0) | (F.get(F.col(names), i - 1)["w"] != x["w"])))
    repeats = lambda x: F.array_join(F.transform(F.split(x, _WORD_EDGES, -1), lambda w: F.coalesce(F.try_element_at(known, w), F.when((w == F.upper(w)) & (F.char_length(w) > 1), F.upper(F.try_element_at(known, F.initcap(w)))), w)), "")
    pieces = F.split(text, ENTITY, -1)
    pieces = F.when(F.size(names) > 0, F.transform(pieces, repeats)).otherwise(pieces)
    merged = F.array_join(F.transform(pieces, lambda x, i: F.concat(x, F.coalesce(F.get(F.col(swaps), i)["new"], F.lit("")))), "")
    count = F.when(F.col(swaps).isNull(), 0).otherwise(F.size(F.filter(swaps, lambda x: x["is_entity"]))).cast("long")
    return out.select(*(F.when(F.col(swaps).isNull(), text).otherwise(merged).alias(c) if c == text_col else quoted(c) for c in docs.columns), count.alias("n_entities"))


def op3_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key is a stated one, so that the query repeats; a deployment passes its own to pseudonymise."""
    docs = read_table(spark, sf_dir, "documents")
    return pseudonymise(docs, key="a stated key").select("doc_id", "text", "n_entities")
