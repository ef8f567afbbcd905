"""Surrogates for personal data, by DataFrame expressions only.

Entities are found by one pattern over the whole text: e-mail addresses, phone numbers, IP addresses, payment card, social
security and bank account numbers, credentials behind their key, and names behind a form of address. An entity is its kind
and its canonical form (case of addresses, punctuation of numbers and the form of address do not count), so every way to
write it is one entity, over all documents. The family name of a name so found is replaced in the whole text, also where it
stands alone. Names that no form of address announces anywhere in their text are not found.

Each entity gets one surrogate made from a keyed hash: the same kind, script, length and separators; issuer digit and
valid check digit of cards, country codes, top-level domains and prefixes of credentials stay; names keep the gender of
the form of address and their script, and a family name is replaced alike with and without a first name. The table of
distinct entities is then checked: where two entities have one surrogate, or a surrogate is itself an entity of the text,
all but one of them draw again, until none is left; from the ``FREE``-th draw on a surrogate may leave the length or range
of its entity, so that one is always free. So different entities stay different. The surrogates go back to the
documents in the way each place is written (separators, upper case).

Edge cases: null text stays null, text without an entity stays as it is. Repeated rows are replaced alike. Entities occur
as often as they like; a hot one is a single row of the table. Columns other than the text are kept; a column named
``n_replaced`` is replaced. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlake.session import durable

#: Documents with entities whose replacements every task may hold (some hundred bytes each).
BROADCAST_DOCS = 200_000
#: Draws after which a surrogate may differ from its entity in length or range.
FREE = 8

# Forms of address by gender.
MALE = ("Mr", "Mister", "Herr", "Monsieur", "Señor", "Sr", "Г-н", "г-н", "Господин", "господин", "Κύριος", "κύριος")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Señorita", "Sra", "Srta", "Г-жа", "г-жа",
          "Госпожа", "госпожа", "Κυρία", "κυρία")
NEUTRAL = ("Dr", "Prof", "Professor", "Mx")

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_NAME = r"\p{Lu}\p{L}+(?:['’-]\p{L}+)*+"
# All labels of the domain; the last one starts with a letter.
_EMAIL = r"[\p{L}\p{N}][\p{L}\p{N}._%+-]*+@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)*\.\p{L}[\p{L}\p{N}-]*[\p{L}\p{N}]"
# Key names of credentials in any case, within a word, what stands between them and the value, and the value. Without quotes
# and behind a blank or a colon, only values with a digit count. Words that no colon or equals sign follows are left at once.
_KEY = r"(?i:pass(?:w(?:or)?d|phrase|code)?|pwd|token|secret|credentials?|(?:api|access|auth|private|secret|encryption|signing)[_ -]?key)"
_WORD = r"(?=[\p{L}\p{N}_-]{2,60}+(?: (?i:key))?[\"'\]]{0,2}\s{0,3}[:=])[\p{L}\p{N}_-]{0,60}?"
_IS = r"[\"'\]]{0,2}\s{0,3}[:=]{1,2}>?\s{0,3}"
_SECRET = r"(?!(?i:bearer)\s)(?=[^\s\"'`]*[\p{L}\p{N}])[^\s\"'`=:>][^\s\"'`]{4,}[^\s\"'`.,;:!?)\]}>]"
_BEARER = r"(?i:bearer)\s{1,3}"
#: What stands before the value of a credential and stays.
_BEFORE = rf"^(?:[\p{{L}}\p{{N}}_-]{{0,60}}?{_KEY}{_IS}[\"'`]?|{_BEARER})"
#: One alternative per kind; all start where no letter or digit precedes. Credentials are found with their key.
PATTERN = r"(?<![\p{L}\p{N}_])(?:" + "|".join([
    rf"{_WORD}{_KEY}(?:={_SECRET}|{_IS}(?:[\"'`]{_SECRET}|(?=[^\s\"'`]*\d){_SECRET}))",
    _BEARER + r"(?=[^\s\"'`]*\d)[\p{L}\p{N}._~+/=-]{16,}+",
    _EMAIL,
    _OCTET + r"(?:\." + _OCTET + r"){3}(?!\.?\d)",
    r"\+1[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}(?!\d)",
    r"\+[2-9]\d{0,2}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\d)",
    r"\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}(?!\d)",
    r"\d{3}([.-])\d{3}\1\d{4}(?![\p{L}\d])",
    r"\d{3}-\d{2}-\d{4}(?![\p{L}\d-])",
    r"\d{13,19}(?![\p{L}\d])",
    r"\d{4}([ -])\d{4}\2\d{4}\2\d{1,7}(?![\p{L}\d])",
    r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\d])",
    r"(?i:AKIA[0-9A-Z]{16})(?![\p{L}\d])",
    r"(?:" + "|".join(sorted({*MALE, *FEMALE, *NEUTRAL}, key=lambda w: (-len(w), w))) + r")\.? " + _NAME + r"(?: " + _NAME + r")?",
]) + r")"

_LATIN, _CYRILLIC, _GREEK = "abcdefghijklmnopqrstuvwxyz", "абвгдежзиклмнопрстуфхцчшэюя", "αβγδεζηθικλμνξοπρστυφχψω"


def _span(first: int, last: int, step: int = 1) -> str:
    return "".join(map(chr, range(first, last + 1, step)))


#: Letters of other scripts, by the name of the script: what such a letter may become.
_SCRIPTS = {
    "Han": _span(0x4E00, 0x9000, 89), "Hangul": _span(0xAC00, 0xD000, 56), "Hiragana": _span(0x304B, 0x3062),
    "Katakana": _span(0x30AB, 0x30C2), "Arabic": _span(0x0628, 0x063A), "Hebrew": _span(0x05D0, 0x05EA),
    "Devanagari": _span(0x0915, 0x0939), "Thai": _span(0x0E01, 0x0E2E), "Armenian": _span(0x0561, 0x0586),
    "Georgian": _span(0x10D0, 0x10F0), "Bengali": _span(0x0995, 0x09A8), "Tamil": _span(0x0BAE, 0x0BB5),
}
# Syllables of invented names, and their endings by role and gender.
_SYLLABLES = {
    "l": "ba be bi bo da de di do fa fe fi ga go ha he jo ka ke ki ko la le li lo ma me mi mo na ne ni no pa pe pi ra re ri "
         "ro sa se si so ta te ti to va ve vi wa we".split(),
    "c": "ба бе би бо ва ве ви га го да де ди до за зи ка ки ко ла ле ли ло ма ме ми мо на не ни но па пе по ра ре ри ро са "
         "се си со та те ти то ха хо ша".split(),
    "g": "βα βε βι γα δα δε δι δο θα θε κα κε κι κο λα λε λι λο μα με μι μο να νε νι νο πα πε πι ρα ρε ρι ρο σα σε σι τα τε "
         "τι το φα φι χα".split(),
}
_ENDINGS = {
    "l": {"m": "n", "f": "na", "n": "l", "family": "ren"},
    "c": {"m": "н", "f": "на", "n": "ль", "family": "рен"},
    "g": {"m": "ς", "f": "να", "n": "ν", "family": "ρης"},
}


def _characters(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))


def _byte(digest: Column, i: Column) -> Column:
    """The i-th byte of a hexadecimal digest, which is used again from its start after 63 bytes."""
    return F.conv(F.substr(digest, i % 63 * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _pick(alphabet: str, number: Column) -> Column:
    return F.substr(F.lit(alphabet), number % len(alphabet) + 1, F.lit(1))


def scrambled(text: Column, digest: Column) -> Column:
    """Digits become digits, letters of a script letters of it (of scripts not named here: Latin ones), the rest stays."""

    def other(c: Column, i: Column) -> Column:
        b = _byte(digest, i)
        out = (
            F.when(c.rlike("[a-z]"), _pick(_LATIN, b)).when(c.rlike(r"\p{Nd}"), (b % 10).cast("string"))
            .when(c.rlike("[A-Z]"), _pick(_LATIN.upper(), b)).when(~c.rlike(r"\p{L}"), c)
            .when(c.rlike(r"\p{IsCyrillic}"), _pick(_CYRILLIC, b)).when(c.rlike(r"\p{IsGreek}"), _pick(_GREEK, b))
        )
        for script, alphabet in _SCRIPTS.items():
            out = out.when(c.rlike(rf"\p{{Is{script}}}"), _pick(alphabet, b))
        return out.when(c.rlike(r"\p{Lu}"), _pick(_LATIN.upper(), b)).otherwise(_pick(_LATIN, b))

    return F.array_join(F.transform(_characters(text), other), "")


def _luhn(digits: Column) -> Column:
    """Sum of the Luhn formula, from the right."""
    values = F.transform(
        F.reverse(_characters(digits)),
        lambda c, i: F.when(i % 2 == 1, c.try_cast("int") * 2 - F.when(c.try_cast("int") > 4, 9).otherwise(0)).otherwise(c.try_cast("int")),
    )
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def _kind(value: Column) -> Column:
    address = F.regexp_extract(value, r"^(\S+?)\.? ", 1)
    return (
        F.when(value.rlike(f"^{_EMAIL}$"), "email")
        .when(value.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), "ip")
        .when(value.rlike(r"^(?:\+|\(\d{3}\))[\d .()-]*\d$|^\d{3}([.-])\d{3}\1\d{4}$"), "phone")
        .when(value.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(value.rlike(r"^\d{13,19}$|^\d{4}([ -])\d{4}\1\d{4}\1\d+$"), "card")
        .when(address.isin(*MALE) & value.rlike(r" \p{Lu}\p{L}"), "name:m")
        .when(address.isin(*FEMALE) & value.rlike(r" \p{Lu}\p{L}"), "name:f")
        .when(address.isin(*NEUTRAL) & value.rlike(r" \p{Lu}\p{L}"), "name:n")
        .when(value.rlike(r"^[A-Z]{2}\d{2}( ?[A-Z0-9]{4}){3,7}( ?[A-Z0-9]{1,3})?$"), "iban")
        .otherwise("secret")
    )


def _canonical(kind: Column, value: Column) -> Column:
    return (
        F.when(kind == "email", F.lower(value))
        .when(kind.isin("phone", "ssn", "card", "iban"), F.regexp_replace(value, r"[^\p{L}\d]", ""))
        .when(kind.startswith("name"), F.lower(F.regexp_replace(value, r"^\S+ ", "")))
        .otherwise(value)
    )


def _name_word(word: Column, role: Column, key: str, attempt: Column) -> Column:
    digest = F.sha2(F.concat_ws("|", F.lit(key), role, word, attempt.cast("string")), 512)
    script = F.when(word.rlike(r"\p{IsCyrillic}"), "c").when(word.rlike(r"\p{IsGreek}"), "g").otherwise("l")

    def built(name: str) -> Column:
        syllables = F.array(*map(F.lit, _SYLLABLES[name]))
        one = [F.element_at(syllables, _byte(digest, F.lit(i)) % len(_SYLLABLES[name]) + 1) for i in range(8)]
        one = [*one[:4], F.when(attempt >= FREE, F.concat(*one[4:])).otherwise("")]
        ends = _ENDINGS[name]
        end = F.when(role == "family", ends["family"]).when(role == "m", ends["m"]).when(role == "f", ends["f"]).otherwise(ends["n"])
        return F.concat(*one, end)

    return F.when(script == "c", built("c")).when(script == "g", built("g")).otherwise(built("l"))


def _surrogate(kind: Column, canon: Column, attempt: Column, key: str) -> Column:
    digest = F.sha2(F.concat_ws("|", F.lit(key), kind, canon, attempt.cast("string")), 512)
    octet = [_byte(digest, F.lit(i)) for i in range(4)]
    inner = F.concat_ws(".", octet[1], octet[2], octet[3])
    home = F.regexp_extract(canon, r"^(10|127|192\.168|172\.(?:1[6-9]|2\d|3[01]))\.", 1)
    rest = F.slice(F.array(octet[1], octet[2], octet[3]).cast("array<string>"), F.lit(1), 4 - F.size(F.split(home, r"\.")))
    ip = F.when(home != "", F.concat(home, F.lit("."), F.array_join(rest, "."))).otherwise(
        F.concat((octet[0] % 89 + 11).cast("string"), F.lit("."), inner)
    )
    country = F.when(canon.rlike("^[17]"), 1).otherwise(2)
    body = F.concat(F.substr(canon, F.lit(1), F.lit(1)), scrambled(F.substr(canon, F.lit(2), F.length(canon) - 2), digest))
    check = ((10 - _luhn(F.concat(body, F.lit("0"))) % 10) % 10).cast("string")
    last = F.when(_luhn(canon) % 10 == 0, check).otherwise((_byte(digest, F.lit(62)) % 10).cast("string"))
    words = F.split(canon, " ")
    name = F.array_join(
        F.transform(words, lambda w, i: _name_word(w, F.when(i == F.size(words) - 1, "family").otherwise(F.substr(kind, F.lit(6), F.lit(1))), key, attempt)),
        " ",
    )
    hexadecimal = F.array_join(F.transform(_characters(canon), lambda c, i: F.substr(digest, i % 127 + 1, F.lit(1))), "")
    # Where no free surrogate of the same length or range turns up, it is left: digests are long enough for all entities.
    wide = attempt >= FREE
    long_ = F.substr(digest, F.lit(1), F.lit(24))
    digits = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: (_byte(digest, i) % 10).cast("string")), "")
    return (
        F.when(wide & (kind == "email"), F.concat(long_, F.lit("@"), F.substr(digest, F.lit(25), F.lit(12)), F.regexp_extract(canon, r"(\.[^.]*)$", 1)))
        .when(wide & (kind == "ip"), F.concat_ws(":", F.lit("fd00"), *[F.substr(digest, F.lit(4 * i + 1), F.lit(4)) for i in range(7)]))
        .when(wide & kind.isin("phone", "ssn", "card", "iban"), F.concat(F.substr(canon, F.lit(1), F.lit(1)), digits))
        .when(kind == "email", F.concat(
            scrambled(F.regexp_extract(canon, r"^(.*\.)[^.]*$", 1), digest), F.regexp_extract(canon, r"([^.]*)$", 1)))
        .when(kind == "ip", ip)
        .when(kind == "phone", F.concat(F.substr(canon, F.lit(1), country), scrambled(F.substr(canon, country + 1, F.length(canon)), digest)))
        .when(kind == "card", F.concat(body, last))
        .when(kind == "iban", F.concat(F.substr(canon, F.lit(1), F.lit(2)), scrambled(F.substr(canon, F.lit(3), F.length(canon)), digest)))
        .when(kind.startswith("name"), name)
        .when((kind == "secret") & wide, F.substr(digest, F.lit(1), F.greatest(F.length(canon), F.lit(16))))
        .when((kind == "secret") & canon.rlike("^(?i)AKIA[0-9A-Z]{16}$"), F.concat(F.substr(canon, F.lit(1), F.lit(4)), scrambled(F.substr(canon, F.lit(5), F.length(canon)), digest)))
        .when((kind == "secret") & canon.rlike("^[0-9a-f]+$"), hexadecimal)
        .when((kind == "secret") & canon.rlike("^[0-9A-F]+$"), F.upper(hexadecimal))
        .otherwise(scrambled(canon, digest))
    )


def _free(kind: Column, value: Column, surrogate: Column) -> Column:
    """A surrogate of another length than its entity: names in the case of the place, the rest as it is."""
    names = F.regexp_replace(value, r"^\S+ ", "")
    shown = F.when(names.rlike(r"\p{Ll}"), F.initcap(surrogate)).otherwise(F.upper(surrogate))
    return F.when(kind.startswith("name"), F.concat(F.regexp_extract(value, r"^(\S+ )", 1), shown)).otherwise(surrogate)


def _written(kind: Column, value: Column, surrogate: Column) -> Column:
    """The surrogate as this place is written."""
    letters = _characters(value)

    def counted(c: Column, i: Column) -> Column:
        place = F.length(F.regexp_replace(F.substr(value, F.lit(1), i + 1), r"[^\p{L}\d]", ""))
        return F.when(c.rlike(r"[\p{L}\d]"), F.substr(surrogate, place, F.lit(1))).otherwise(c)

    cased = F.transform(
        _characters(surrogate),
        lambda c, i: F.when(F.substr(value, i + 1, F.lit(1)).rlike(r"\p{Lu}"), F.upper(c)).otherwise(c),
    )
    return (
        F.when(F.length(surrogate) != F.length(_canonical(kind, value)), _free(kind, value, surrogate))
        .when(kind.isin("phone", "ssn", "card", "iban"), F.array_join(F.transform(letters, counted), ""))
        .when(kind == "email", F.array_join(cased, ""))
        .when(kind.startswith("name"), _free(kind, value, surrogate))
        .otherwise(surrogate)
    )


def _bare(kind: Column, value: Column, surrogate: Column) -> Column:
    """(word, new): the family name alone, as the place writes it, and its surrogate; null for all but names."""
    word, new = F.substring_index(value, " ", -1), F.substring_index(_free(kind, value, surrogate), " ", -1)
    return F.when(kind.startswith("name") & (F.length(word) > 2), F.struct(word.alias("word"), new.alias("new")))


def entities(docs: DataFrame, text: str = "text") -> DataFrame:
    """__row, pos, before (what stays of the place), value, kind, canon of every place that holds an entity."""
    found = F.regexp_extract_all(F.col(text), F.lit(PATTERN), F.lit(0))
    rows = docs.select(row_name("doc_id", text).alias("__row"), F.posexplode(found).alias("pos", "_found"))
    before = F.regexp_extract("_found", _BEFORE, 0)
    rows = rows.select("__row", "pos", before.alias("before"), F.substr("_found", F.length(before) + 1).alias("value"))
    rows = rows.withColumn("kind", _kind(F.col("value")))
    return rows.withColumn("canon", _canonical(F.col("kind"), F.col("value")))


def row_name(doc_id: str, text: str) -> Column:
    """128 bits that stand for a row, so that none gets the surrogates of another."""
    return F.struct(F.xxhash64(doc_id, text).alias("a"), F.xxhash64(F.lit(1), doc_id, text).alias("b"))


def surrogate_table(found: DataFrame, key: str) -> DataFrame:
    """kind, canon, surrogate: one row per entity; no surrogate twice, and none that is an entity itself."""
    table = found.select("kind", "canon").distinct().withColumn("attempt", F.lit(0))
    sort = F.split("kind", ":")[0]
    while True:
        table = durable(
            table.select("kind", "canon", "attempt", _surrogate(F.col("kind"), F.col("canon"), F.col("attempt"), key).alias("surrogate"))
        )
        named = table.withColumn("sort", sort)
        # Of entities with one surrogate the earliest attempt keeps it, then the smallest form.
        keeper = named.groupBy("sort", "surrogate").agg(F.min(F.struct("attempt", "kind", "canon")).alias("first"))
        taken = named.select("sort", F.col("canon").alias("surrogate")).distinct().withColumn("taken", F.lit(True))
        judged = named.join(keeper, ["sort", "surrogate"]).join(taken, ["sort", "surrogate"], "left")
        other = (F.col("first.kind") != F.col("kind")) | (F.col("first.canon") != F.col("canon"))
        # The same words of a name under two genders are one person to a reader; they may share a surrogate.
        other = other & (F.col("first.canon") != F.col("canon"))
        again = F.col("taken").isNotNull() | other
        judged = durable(judged.select("kind", "canon", "surrogate", "attempt", again.alias("again")))
        if judged.filter("again").isEmpty():
            return judged.select("kind", "canon", "surrogate")
        table = judged.select("kind", "canon", (F.col("attempt") + F.col("again").cast("int")).alias("attempt"))


def replace(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """All columns of ``docs`` with the text replaced, and ``n_replaced``."""
    found = durable(entities(docs, text))
    table = surrogate_table(found, key)
    placed = found.join(table, ["kind", "canon"]).select(
        "__row", F.struct(
            "pos", F.concat("before", _written(F.col("kind"), F.col("value"), F.col("surrogate"))).alias("__new"),
            _bare(F.col("kind"), F.col("value"), F.col("surrogate")).alias("__bare"),
        ).alias("place")
    )
    # Repeated rows have the same places, so a set holds each once.
    perdoc = durable(placed.groupBy("__row").agg(F.array_sort(F.collect_set("place")).alias("places")).select(
        "__row", F.col("places.__new").alias("__new"),
        F.array_distinct(F.filter(F.col("places.__bare"), lambda b: b.isNotNull())).alias("__bare"),
    ))
    named = docs.drop("n_replaced").withColumn("__row", row_name("doc_id", text))
    between = F.split(F.col(text), PATTERN, -1)
    built = F.concat(
        F.element_at(between, 1),
        F.array_join(F.zip_with(F.col("__new"), F.slice(between, F.lit(2), F.size("__new")), lambda new, rest: F.concat(new, rest)), ""),
    )
    if perdoc.count() <= BROADCAST_DOCS:
        joined = named.join(F.broadcast(perdoc), "__row", "left")
    else:  # only texts with an entity are shuffled
        held = F.coalesce(F.col(text).rlike(PATTERN), F.lit(False))
        joined = named.filter(held).join(perdoc, "__row", "left").unionByName(
            named.filter(~held).withColumn("__new", F.lit(None).cast("array<string>")).withColumn(
                "__bare", F.lit(None).cast("array<struct<word:string,new:string>>")
            )
        )
    # A family name that was found behind a form of address is replaced wherever the text names it alone.
    followed = F.aggregate("__bare", built, lambda t, b: F.regexp_replace(
        t, F.concat(F.lit(r"(?<![\p{L}\p{N}_])\Q"), b["word"], F.lit(r"\E(?![\p{L}\p{N}_])")), b["new"]
    ))
    changed = F.when(F.col("__new").isNotNull(), followed).otherwise(F.col(text))
    kept = [c for c in docs.columns if c != "n_replaced"]
    return joined.select(
        *[changed.alias(c) if c == text else F.col(f"`{c}`") for c in kept],
        F.coalesce(F.size("__new"), F.lit(0)).alias("n_replaced"),
    )
