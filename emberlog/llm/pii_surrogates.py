"""Personal data replaced by surrogates, with DataFrame functions only.

Each detected entity gets a keyed replacement of its own type. Letters and digits go through a keyed Feistel cipher
over the alphabet they belong to, so script, case, length and punctuation stay, equal entities get equal surrogates
in all documents and different ones different surrogates, whatever the size of the corpus. Card numbers and IBANs keep
true check digits. Words of names keep vowels and consonants in their places and get an ending that tells their part:
a female or male given name or a family name. As no two parts share an ending, no two words share a surrogate.
An entity with letters of no known alphabet becomes a token of 96 bits of its keyed hash.

A name is found behind a title. Its words, alone or together, are then found anywhere in the same text.

`clashes` is the check over a whole corpus: distinct entities that share a surrogate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.llm.shared import fresh

KEY = "surrogates-1"

_FEMALE = r"Mrs|Ms|Miss|Frau|Madame|Mme|Mlle|Señora|Sra|г-жа|Госпожа|κα"
_MALE = r"Mr|Herr|Monsieur|Señor|Sr|г-н|Господин|κ"
_TITLES = rf"{_FEMALE}|{_MALE}|Dr|Prof"
_LETTERS = r"[\p{L}\p{M}]"
#: A word of a name; a letter behind an apostrophe ("Lee's") isn't of it.
_NAME = rf"\p{{Lu}}(?:{_LETTERS}+|(?=['’]))(?:['’-]\p{{L}}{_LETTERS}+)*"
#: The types and how they look, in the order in which they are tried at each place.
PATTERNS = {
    "email": r"(?<![\p{L}\p{M}\p{N}._%+-])[\p{L}\p{M}\p{N}._%+-]{1,64}+@(?:[\p{L}\p{M}\p{N}-]{1,63}\.){1,8}[\p{L}\p{M}]{2,24}",
    "secret": r"(?<![\p{L}\p{N}])(?:[0-9a-fA-F]{32,128}+|AKIA[0-9A-Z]{16}|ghp_[0-9A-Za-z]{36}|sk-[0-9A-Za-z]{32,64})(?![\p{L}\p{N}])",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "card": r"(?<![\p{L}\p{N}.+-])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3})(?![\p{L}\p{N}]|[.-][0-9])",
    "ssn": r"(?<![\p{L}\p{N}-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{L}\p{N}-])",
    "ip": r"(?<![\p{L}\p{N}.])(?<!(?:[Vv]ersion|[Rr]elease|[Bb]uild|[Vv]er\.) )(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?![\p{L}\p{N}]|\.[0-9])",
    "ip6": r"(?<![\p{L}\p{N}:.])(?:(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}|[0-9a-fA-F]{3,4}:(?:[0-9a-fA-F]{1,4}:){0,5}(?::[0-9a-fA-F]{1,4}){1,6})(?![\p{L}\p{N}:])",
    "phone": r"(?<![\p{L}\p{N}+])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){2,5}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}|0[0-9](?:[ .][0-9]{2}){4})(?![\p{L}\p{N}])",
    "person": rf"(?<![\p{{L}}\p{{N}}])(?:{_TITLES})\.? {_NAME}(?: {_NAME}){{0,2}}",
}
PATTERN = "|".join(PATTERNS.values())

_HEX = "0123456789abcdef"


def _range(low: int, high: int) -> str:
    """The letters from low to high; of those with case the lower ones that a single upper one belongs to."""
    own = map(chr, range(low, high + 1))
    return "".join(c for c in own if c.isalpha() and (c.upper() == c or (len(c.upper()) == 1 and c.upper().lower() == c)) and c.lower() == c)


_LATIN, _LATIN1, _CYRILLIC, _GREEK = _range(0x61, 0x7A), _range(0xE0, 0xFE), _range(0x430, 0x45F), _range(0x3B1, 0x3C9).replace("ς", "")
#: Signs are moved within their alphabet: digits, Latin, Latin with marks, Cyrillic, Greek and accented Greek, Armenian,
#: Hebrew, Arabic, Devanagari, Thai, Hiragana and Katakana. ς counts as σ.
_ALPHABETS = (
    "0123456789", _LATIN, _LATIN1, _range(0xFF, 0x17E), "ßĸ", _CYRILLIC, _GREEK, "άέήίόύώ", _range(0x561, 0x586), _range(0x5D0, 0x5EA), _range(0x621, 0x63A) + _range(0x641, 0x64A),
    _range(0x905, 0x939), _range(0xE01, 0xE30), _range(0x3041, 0x3096), _range(0x30A1, 0x30FA),
)
#: Scripts too large for a string: Han, Hangul.
_SCRIPTS = ((0x4E00, 0x9FFF), (0xAC00, 0xD7A3))


def _split(letters: str, vowels: str) -> tuple[str, str]:
    return "".join(c for c in letters if c in vowels), "".join(c for c in letters if c not in vowels)


#: The same for words of names: vowels and consonants apart.
_NAME_ALPHABETS = (*_split(_LATIN, "aeiouy"), *_split(_LATIN1, "àáâãäåæèéêëìíîïòóôõöøùúûüý"), *_split(_CYRILLIC, "аеиоуыэюяё"), *_split(_GREEK, "αεηιουω"), *_ALPHABETS[3:5], *_ALPHABETS[7:9])
#: Endings of female and male given names and of family names.
_ENDINGS = {"latin": ("lina", "rik", "son"), "cyrillic": ("лина", "рик", "сон"), "greek": ("λινα", "ρικ", "σον")}


def _array(values) -> Column:
    """A constant array of integers, in few expressions: plans hold many of them."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<int>")


def kind_of(entity: Column) -> Column:
    """The type of a match, told by its look; 'number' for one that looks like a card's and isn't."""
    return (
        F.when(F.contains(entity, F.lit("@")), "email")
        .when(entity.rlike(r"^(?:[0-9a-fA-F]{32,}|AKIA[0-9A-Z]{16}|ghp_.*|sk-.*)$"), "secret")
        .when(entity.rlike(r"^[A-Z]{2}[0-9]{2}"), "iban")
        .when(entity.rlike(r"^(?:[0-9]{1,3}(?:\.[0-9]{1,3}){3}|[0-9a-fA-F]{1,4}:[0-9a-fA-F:]*)$"), "ip")
        .when(entity.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn")
        .when(entity.rlike(r"^(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3})$"), F.when(_luhn(F.regexp_replace(entity, "[ -]", "")) == 0, "card").otherwise("number"))
        .when(entity.rlike(r"^[+(0-9]"), "phone")
        .otherwise("person")
    )


def _luhn(digits: Column) -> Column:
    """The check sum of a number, 0 if its last digit is right."""

    def weighed(c: Column, i: Column) -> Column:
        x = c.cast("int")
        return F.when(i % 2 == 1, x * 2 - F.when(x > 4, 9).otherwise(0)).otherwise(x)

    return F.aggregate(F.transform(_signs(F.reverse(digits)), weighed), F.lit(0), lambda acc, x: acc + x) % 10


def _card(entity: Column, key: str) -> Column:
    digits = F.regexp_replace(entity, "[ -]", "")
    body = permuted(F.substring(digits, F.lit(1), F.length(digits) - 1), F.lit("card"), key)
    return _dressed(entity, F.concat(body, ((10 - _luhn(F.concat(body, F.lit("0")))) % 10).cast("string")))


def _check(country: Column, rest: Column) -> Column:
    """The true check digits of an IBAN, as a number."""
    signs = F.lit("0123456789abcdefghijklmnopqrstuvwxyz")
    step = lambda acc, c: (acc * F.when(c.rlike("[0-9]"), 10).otherwise(100) + F.position(c, signs) - 1) % 97
    return 98 - F.aggregate(_signs(F.concat(rest, F.lower(country), F.lit("00"))), F.lit(0), step)


def _iban(entity: Column, key: str) -> Column:
    """Country and check digits apart. Wrong check digits stay as wrong as they were, so that nothing can meet."""
    letters, country = plain(entity), F.substring(entity, 1, 2)
    rest = F.substring(letters, F.lit(5), F.length(letters))
    new = permuted(rest, F.lit("iban"), key)
    check = F.pmod(_check(country, new) + F.substring(letters, 3, 2).cast("int") - _check(country, rest), F.lit(100))
    return F.concat(country, _dressed(F.substring(entity, F.lit(3), F.length(entity)), F.concat(F.lpad(check.cast("string"), 2, "0"), new)))


def _signs(text: Column) -> Column:
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.substring(text, i, F.lit(1))))


def _number(digest: Column, i: Column) -> Column:
    """Sixteen bits of a hexadecimal digest, other ones for each i."""
    return F.conv(F.substring(digest, (i * 4) % 60 + 1, F.lit(4)), 16, 10).cast("int")


def _lower(text: Column) -> Column:
    return F.translate(F.lower(text), "ς", "σ")


def _known(sign: Column, alphabets: tuple[str, ...]) -> Column:
    """Whether a lower-case sign has an alphabet."""
    out = F.position(sign, F.lit("".join(alphabets))) > 0
    if len(alphabets) > 1:
        code = F.ascii(sign)
        for low, high in _SCRIPTS:
            out = out | code.between(low, high)
    return out


def _shifted(text: Column, digest: Column, alphabets: tuple[str, ...]) -> Column:
    """Each letter and digit moved within its alphabet."""
    signs = F.lit("".join(alphabets))
    first = _array(sum(len(a) for a in alphabets[:k]) for k, own in enumerate(alphabets) for _ in own)
    size = _array(len(own) for own in alphabets for _ in own)

    def moved(sign: Column, i: Column) -> Column:
        p = F.position(sign, signs)
        b = F.get(first, p - 1)
        out = F.when(p > 0, F.substring(signs, b + (p - 1 - b + _number(digest, i)) % F.get(size, p - 1) + 1, F.lit(1)))
        for low, high in _SCRIPTS if len(alphabets) > 1 else ():
            code = low + (F.ascii(sign) - low + _number(digest, i)) % (high - low + 1)
            out = out.when(F.ascii(sign).between(low, high), F.decode(F.unhex(F.hex(code.cast("long"))), "UTF-16BE"))
        return out.otherwise(sign)

    return F.array_join(F.transform(_signs(text), moved), "")


def permuted(text: Column, salt: Column, key: str, alphabets: tuple[str, ...] = _ALPHABETS) -> Column:
    """A keyed bijection of texts that keeps their length and each sign's alphabet: four Feistel rounds."""
    half = F.ceil(F.length(text) / 2).cast("int")
    start = F.struct(F.substring(text, F.lit(1), half).alias("l"), F.substring(text, half + 1, F.length(text)).alias("r"))
    digest = lambda acc, k: F.sha2(F.concat_ws("|", F.lit(key), salt, k.cast("string"), acc["r"]), 256)
    step = lambda acc, k: F.struct(acc["r"].alias("l"), _shifted(acc["l"], digest(acc, k), alphabets).alias("r"))
    return F.aggregate(_array(range(4)), start, step, lambda acc: F.concat(acc["l"], acc["r"]))


def plain(entity: Column, alphabets: tuple[str, ...] = _ALPHABETS) -> Column:
    """Its letters and digits alone, in lower case: what equal entities in different formats share."""
    return F.array_join(F.filter(_signs(_lower(entity)), lambda c: _known(c, alphabets)), "")


def _strange(entity: Column, alphabets: tuple[str, ...] = _ALPHABETS) -> Column:
    """Whether it has letters, marks or digits of no alphabet, which no cipher would hide."""
    return F.exists(_signs(_lower(entity)), lambda c: c.rlike(r"[\p{L}\p{M}\p{N}]") & ~_known(c, alphabets))


def _token(entity: Column, salt: Column, key: str) -> Column:
    """24 letters from the keyed hash of an entity."""
    return F.translate(F.substring(F.sha2(F.concat_ws("|", F.lit(key), salt, _lower(entity)), 256), 1, 24), _HEX, "abcdefghiklmnopr")


def _dressed(entity: Column, letters: Column, alphabets: tuple[str, ...] = _ALPHABETS) -> Column:
    """The entity's format, filled with other letters and digits."""

    def step(acc: Column, sign: Column) -> Column:
        own = _known(_lower(sign), alphabets)
        new = F.substring(letters, acc["k"], F.lit(1))
        return F.struct(
            F.concat(acc["out"], F.when(~own, sign).when(sign == F.lower(sign), new).otherwise(F.upper(new))).alias("out"), (acc["k"] + F.when(own, 1).otherwise(0)).alias("k")
        )

    return F.aggregate(_signs(entity), F.struct(F.lit("").alias("out"), F.lit(1).alias("k")), step, lambda acc: acc["out"])


def _behind(entity: Column, stays: Column, salt: Column, key: str, alphabets: tuple[str, ...] = _ALPHABETS) -> Column:
    """Permutes what stands behind a beginning that stays."""
    rest = F.substring(entity, F.length(stays) + 1, F.length(entity))
    return F.concat(stays, _dressed(rest, permuted(plain(rest, alphabets), salt, key, alphabets), alphabets))


def _email(entity: Column, key: str) -> Column:
    """Name and host apart, so that mailboxes of a host stay together; the host gets a top level that never exists."""
    at = F.position(F.lit("@"), entity)
    name, host = F.substring(entity, F.lit(1), at - 1), F.substring(entity, at + 1, F.length(entity))
    swap = lambda x, salt: F.when(_strange(x), _token(x, salt, key)).otherwise(_dressed(x, permuted(plain(x), salt, key)))
    return F.concat(swap(name, F.concat(F.lit("name"), F.lower(host))), F.lit("@"), swap(host, F.lit("host")), F.when(host == F.upper(host), ".EXAMPLE").otherwise(".example"))


def _ip(entity: Column, key: str) -> Column:
    packed = F.array_join(F.transform(F.split(entity, r"\."), lambda x: F.lpad(F.lower(F.hex(x.cast("int"))), 2, "0")), "")
    mixed = permuted(packed, F.lit("ip"), key, (_HEX,))
    return F.array_join(F.transform(_array((1, 3, 5, 7)), lambda i: F.conv(F.substring(mixed, i, F.lit(2)), 16, 10)), ".")


def _script(word: Column) -> Column:
    return F.when(word.rlike(r"\p{IsCyrillic}"), "cyrillic").when(word.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def _titled(entity: Column) -> Column:
    return entity.rlike(rf"^(?:{_TITLES})\.? ")


def _words(entity: Column) -> Column:
    """The words of a person's name, without the title."""
    return F.split(F.regexp_replace(entity, rf"^(?:{_TITLES})\.? ", ""), " ")


def name_units(entity: Column) -> Column:
    """The words of a person's name as 'family|word', 'female|word' or 'male|word', in lower case.

    The last word is the family name. The gender is the title's; after a title of either gender, a name that ends in
    a or я or α counts as female.
    """
    words = _words(entity)
    gender = F.when(entity.rlike(rf"^(?:{_FEMALE})\b"), "female").when(entity.rlike(rf"^(?:{_MALE})\b"), "male").when(F.get(words, F.lit(0)).rlike("[aяα]$"), "female").otherwise("male")
    role = lambda i: F.when(i == F.size(words) - 1, "family").otherwise(gender)
    return F.transform(words, lambda w, i: F.concat_ws("|", role(i), _lower(w)))


def known_units(found: Column) -> Column:
    """The words of all names of a text, those of names of several words first: what later mentions refer to."""
    names = F.filter(found, _titled)
    several = F.filter(names, lambda e: F.size(_words(e)) > 1)
    return F.array_distinct(F.flatten(F.concat(F.transform(several, name_units), F.transform(names, name_units))))


def _name_word(unit: Column, key: str) -> Column:
    role, word = F.split_part(unit, F.lit("|"), F.lit(1)), F.split_part(unit, F.lit("|"), F.lit(2))
    letters = _dressed(word, permuted(plain(word, _NAME_ALPHABETS), role, key, _NAME_ALPHABETS), _NAME_ALPHABETS)
    script, ending = _script(word), None
    for name, (female, male, family) in _ENDINGS.items():
        own = F.when(role == "female", female).when(role == "male", male).otherwise(family)
        ending = F.when(script == name, own) if ending is None else ending.when(script == name, own)
    return F.initcap(F.concat(F.when(_strange(word, _NAME_ALPHABETS), _token(word, role, key)).otherwise(letters), ending))


def _person(entity: Column, key: str, units: Column) -> Column:
    """Words of a name, or of a later mention of it, by the part they have in the text's names."""
    title = F.regexp_extract(entity, rf"^(?:{_TITLES})\.? ", 0)
    name = F.substring(entity, F.length(title) + 1, F.length(entity))
    whole = _titled(entity) & (F.size(_words(entity)) > 1)
    known = lambda u: F.get(F.filter(units, lambda x: F.split_part(x, F.lit("|"), F.lit(2)) == F.split_part(u, F.lit("|"), F.lit(2))), F.lit(0))
    new = F.array_join(F.transform(name_units(entity), lambda u: _name_word(F.when(whole, u).otherwise(F.coalesce(known(u), u)), key)), " ")
    return F.concat(title, F.when((name == F.upper(name)) & (F.length(name) > 1), F.upper(new)).otherwise(new))


def surrogate(entity: Column, key: str = KEY, units: Column | None = None, kind: Column | None = None) -> Column:
    """The replacement of a detected entity. units: words of names in the same text, by `known_units`."""
    units = F.array().cast("array<string>") if units is None else units
    kind, hexadecimal = kind_of(entity) if kind is None else kind, entity.rlike("^[0-9a-fA-F]{32,}$")
    return (
        F.when(kind == "email", _email(entity, key))
        .when(((kind == "secret") & hexadecimal) | ((kind == "ip") & F.contains(entity, F.lit(":"))), _behind(entity, F.lit(""), kind, key, (_HEX,)))
        .when(kind == "iban", _iban(entity, key))
        .when(kind == "ip", _ip(entity, key))
        .when(kind == "card", _card(entity, key))
        .when(kind == "number", entity)
        .when(kind == "person", _person(entity, key, units))
        .otherwise(_behind(entity, F.regexp_extract(entity, r"^(?:AKIA|ghp_|sk-|\+[0-9]{1,3}(?=[ .(-]))", 0), kind, key))
    )


def _found(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({PATTERN})"), F.lit(1))


def detected(docs: DataFrame, text: Column, entities: str, units: str, pattern: str) -> DataFrame:
    """docs with three more columns: the matches in the text in order, words of its names, and the pattern that found them.

    Names of the text join the pattern, the longest first, so that their later mentions are found as well.
    """
    own = F.coalesce(text, F.lit(""))
    docs = docs.withColumn(entities, _found(own)).withColumn(units, known_units(F.col(entities)))
    words = F.flatten(F.transform(F.filter(entities, _titled), lambda e: F.array_append(_words(e), F.array_join(_words(e), " "))))
    longest = F.transform(F.array_sort(F.transform(F.array_distinct(words), lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), lambda x: x["w"])
    mentions = F.concat(F.lit(PATTERN + r"|(?<![\p{L}\p{N}])(?:"), F.array_join(longest, "|"), F.lit(r")(?![\p{L}\p{M}\p{N}])"))
    docs = docs.withColumn(pattern, F.when(F.size(units) > 0, mentions))
    again = F.regexp_extract_all(own, F.concat(F.lit("("), F.col(pattern), F.lit(")")), F.lit(1))
    return docs.withColumn(entities, F.when(F.col(pattern).isNull(), F.col(entities)).otherwise(again))


def replaced(docs: DataFrame, key: str = KEY, text_column: str = "text", entities: str | None = None) -> DataFrame:
    """The rows of docs with their own columns; in the text each entity is a surrogate.

    entities names a further column for the types found, in order of place. A null text stays null and an empty one
    empty; neither has entities. Whole texts are read, however long. Repeated rows stay and equal texts become equal
    texts. Other columns, whatever their names, stay as they are; an empty table stays empty. No row is shuffled and
    no other row is looked at.
    """
    own, (found, units, pattern, kinds, new) = F.col(text_column), fresh(docs, "_found", "_units", "_pattern", "_kinds", "_new")
    df = detected(docs, own, found, units, pattern).withColumn(kinds, F.transform(found, kind_of))
    df = df.withColumn(new, F.zip_with(found, kinds, lambda e, kind: surrogate(e, key, F.col(units), kind)))
    pieces = F.when(F.col(pattern).isNull(), F.split(own, PATTERN, -1)).otherwise(F.split(own, F.col(pattern), -1))
    text = F.array_join(F.zip_with(pieces, new, lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))), "")
    df = df.withColumn(text_column, F.when(F.size(found) == 0, own).otherwise(text))
    return df.select(*docs.columns, *([F.filter(kinds, lambda k: k != "number").alias(entities)] if entities else []))


def clashes(docs: DataFrame, key: str = KEY, text_column: str = "text") -> DataFrame:
    """(surrogate, n, least, most): surrogates that several distinct entities of a corpus would share; none, if all is right.

    Entities that differ in case or format alone are one. What is grouped is combined before it is shuffled.
    """
    own = F.col(text_column)
    rows = detected(docs.select(own.alias("text")).where(own.isNotNull()), F.col("text"), "found", "units", "pattern")
    each = rows.select(F.explode("found").alias("e"), "units").select("e", "units", kind_of(F.col("e")).alias("kind")).where("kind not in ('number', 'person')")
    pairs = each.select("kind", _lower(F.regexp_replace("e", r"[^\p{L}\p{M}\p{N}]", "")).alias("e"), _lower(F.regexp_replace(surrogate(F.col("e"), key, kind=F.col("kind")), r"[^\p{L}\p{M}\p{N}]", "")).alias("s"))
    words = rows.select(F.explode("units").alias("e")).select(F.lit("person").alias("kind"), "e", F.lower(_name_word(F.col("e"), key)).alias("s"))
    found = pairs.where("kind <> 'ip'").unionByName(words).groupBy("kind", "s").agg(F.min("e").alias("least"), F.max("e").alias("most"), F.count("*").alias("n"))
    return found.where("least <> most").select(F.col("s").alias("surrogate"), "n", "least", "most")


def surrogates(docs: DataFrame, key: str = KEY) -> DataFrame:
    """(doc_id, text, n_entities, entity_types): one row for each row of docs, with what `replaced` says of all cases."""
    out = replaced(docs.select("doc_id", "text"), key, entities="entity_types")
    return out.select("doc_id", "text", F.size("entity_types").cast("long").alias("n_entities"), "entity_types")
