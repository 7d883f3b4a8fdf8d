"""Personal data replaced by keyed surrogates of the same type and format, in SQL functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from harborline.session import spool

# Forms of personal data.
EMAIL = r"(?<![._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
IPV4 = rf"(?<![0-9.])(?:{OCTET}\.){{3}}{OCTET}(?![0-9]|\.[0-9])"
GROUP = "[0-9A-Fa-f]{1,4}"
# Forms with "::" by the groups before and after it; the last ones end in an IPv4 address.
_SHORT = [rf"(?:{GROUP}:){{1,7}}:", *(rf"(?:{GROUP}:){{1,{7 - k}}}(?::{GROUP}){{1,{k}}}" for k in range(1, 7)), rf":(?::{GROUP}){{1,7}}"]
_MIXED = [rf"(?:{GROUP}:){{6}}", rf"(?:{GROUP}:){{1,5}}:(?:{GROUP}:){{0,4}}", rf"::(?:{GROUP}:){{0,5}}"]
IPV6 = (
    rf"(?=[0-9A-Fa-f]{{0,4}}:)(?<!:)(?:(?:{GROUP}:){{7}}{GROUP}(?![:0-9A-Za-z])"
    rf"|(?:{'|'.join(_SHORT)})(?![:0-9A-Za-z]|\.[0-9])|(?:{'|'.join(_MIXED)})(?:{OCTET}\.){{3}}{OCTET}(?![:0-9A-Za-z]|\.[0-9]))"
)
IBAN = r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])"
SECRET = r"(?<![_-])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128}|(?:AKIA|ASIA)[0-9A-Z]{16}|(?:sk|pk|ghp|gho|xox[bp])[-_][0-9A-Za-z_-]{16,})(?![0-9A-Za-z_-])"
PHONE = (
    r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?\(?[0-9]{1,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}"
    r"|\([0-9]{3}\) ?[0-9]{3}[ .-]?[0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![0-9])"
)
SSN = r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"
CARD = r"(?<![0-9A-Za-z.-])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z-])"
TITLES = {"m": ["Mr", "Herr", "Monsieur", "Señor", "Господин", "Κύριος"], "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Señora", "Госпожа", "Κυρία"]}
GIVEN = {
    ("latin", "m"): ["James", "John", "Robert", "Michael", "William", "David", "Thomas", "Peter", "Hans", "Jürgen", "Pierre", "François", "José", "Carlos"],
    ("latin", "f"): ["Mary", "Patricia", "Jennifer", "Linda", "Elizabeth", "Susan", "Anna", "Ursula", "Sabine", "Marie", "Hélène", "María", "Carmen", "Lucía"],
    ("cyrillic", "m"): ["Иван", "Сергей", "Алексей", "Дмитрий", "Николай", "Михаил"],
    ("cyrillic", "f"): ["Анна", "Мария", "Елена", "Ольга", "Наталья", "Татьяна"],
    ("greek", "m"): ["Γιώργος", "Νίκος", "Κώστας", "Δημήτρης"],
    ("greek", "f"): ["Μαρία", "Ελένη", "Κατερίνα", "Σοφία"],
}
# Syllables of made-up names by script, and the last letters of given names by gender.
SYLLABLES = {
    "latin": ["ba", "de", "fi", "go", "hu", "ka", "le", "mi", "no", "ra", "se", "ti", "vo", "wa", "ze", "lu"],
    "cyrillic": ["ба", "де", "фи", "го", "ху", "ка", "ле", "ми", "но", "ра", "се", "ти", "во", "ва", "зе", "лу"],
    "greek": ["βα", "δε", "φι", "γο", "χυ", "κα", "λε", "μι", "νο", "ρα", "σε", "τι", "βο", "θα", "ζε", "λυ"],
}
ENDINGS = {"latin": {"m": "o", "f": "a"}, "cyrillic": {"m": "р", "f": "а"}, "greek": {"m": "ος", "f": "α"}}

#: A cheap test before the names are tried one by one.
_CAPITAL = r"(?=\p{Lu})"
_CAPITALISED = r"\p{Lu}[\p{L}'’-]+"
_TITLE = "|".join(t for names in TITLES.values() for t in names)
_GIVEN = "|".join(n for names in GIVEN.values() for n in names)
NAME = (
    rf"(?<=(?<!\p{{L}})(?:{_TITLE})\.? ){_CAPITALISED}(?: {_CAPITALISED}){{0,2}}"
    rf"|(?<!\p{{L}})(?:{_GIVEN})(?: {_CAPITALISED}){{1,2}}"
)
# Grouped by what can begin a find, so that most characters fail one short test.
PATTERN = (
    rf"(?<![0-9A-Za-z])(?:{EMAIL}|{IPV6}|{IBAN}|{SECRET})"
    rf"|(?=[0-9(+])(?:{IPV4}|{PHONE}|{SSN}|{CARD})|{_CAPITAL}(?:{NAME})"
)
#: Every find holds one of these, so other texts are left alone at once.
HINT = rf"[@0-9]|::|AKIA|ASIA|(?:sk|pk|ghp|gho|xox[bp])[-_]|[a-f]{{32}}|[A-F]{{32}}|{_CAPITAL}(?<!\p{{L}})(?:{_TITLE}|{_GIVEN})(?!\p{{L}})"
NAME_KINDS = "surname|given_m|given_f"
#: From this attempt on a surrogate gets longer, or a given name is made up.
LONGER = 2


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """An expression over a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _matches(value: Column, pattern: str) -> Column:
    return value.rlike(f"^(?:{pattern})$")


def kind_of(entity: Column) -> Column:
    """Type of a find; names are told by what is left."""
    kinds = [("email", EMAIL), ("ipv4", IPV4), ("ipv6", IPV6), ("iban", IBAN), ("secret", SECRET), ("phone", PHONE), ("ssn", SSN), ("card", CARD)]
    out = F.lit("name")
    for kind, pattern in reversed(kinds):
        out = F.when(_matches(entity, pattern), kind).otherwise(out)
    return out


def script_of(word: Column) -> Column:
    return F.when(word.rlike(r"\p{IsCyrillic}"), "cyrillic").when(word.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def _named(words: list[str]) -> str:
    return "^(?:" + "|".join(words) + ")$"


def tokens_of(entity: Column) -> Column:
    """What a find is replaced by parts of: an array of (kind, value), values in one spelling.

    Mail addresses are the address and its domain, so one domain stays one domain;
    names are single words, so a surname alone is still the same person's.
    """
    male = _named([n for (_, g), names in GIVEN.items() if g == "m" for n in names])
    female = _named([n for (_, g), names in GIVEN.items() if g == "f" for n in names])
    def token(kind: Column | str, value: Column) -> Column:
        return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), value.alias("value"))

    def name(word: Column) -> Column:
        return token(F.when(word.rlike(male), "given_m").when(word.rlike(female), "given_f").otherwise("surname"), word)

    digits = F.regexp_replace(entity, "[^0-9]", "")
    return _let(kind_of(entity), lambda kind: (
        F.when(kind == "email", F.array(token("email", F.lower(entity)), token("domain", F.lower(F.substring_index(entity, "@", -1)))))
        .when(kind.isin("phone", "card", "ssn"), F.array(token(kind, digits)))
        .when(kind == "iban", F.array(token("iban", F.regexp_replace(entity, " ", ""))))
        .when(kind == "name", F.transform(F.split(entity, " "), name))
        .otherwise(F.array(token(kind, entity)))
    ))


def _bytes(seed: Column, size: Column) -> Column:
    """At least ``size`` keyed bytes in hex."""
    blocks = F.sequence(F.lit(0), F.floor(size / 32).cast("int"))
    return F.array_join(F.transform(blocks, lambda b: F.sha2(F.concat(seed, F.lit("#"), b.cast("string")), 256)), "")


def _byte(stream: Column, place: Column) -> Column:
    return F.conv(F.substring(stream, place * 2 - 1, F.lit(2)), 16, 10).cast("int")


def _letter(base: int, byte: Column) -> Column:
    return F.char(F.lit(base) + byte % 26)


def _alike(value: Column, stream: Column, hexadecimal: Column) -> Column:
    """Digits for digits, letters for letters in their case, all else as it is."""

    def one(place: Column) -> Column:
        return _let(F.substring(value, place, F.lit(1)), lambda c: _let(_byte(stream, place), lambda byte: like(c, byte)))

    def like(c: Column, byte: Column) -> Column:
        hex_digit = F.lower(F.hex(byte % 16))
        return (
            F.when(hexadecimal & c.rlike("[0-9a-f]"), hex_digit)
            .when(hexadecimal & c.rlike("[A-F]"), F.upper(hex_digit))
            .when(c.rlike("[0-9]"), (byte % 10).cast("string"))
            .when(c.rlike("[a-z]"), _letter(97, byte))
            .when(c.rlike("[A-Z]"), _letter(65, byte))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(value))), one), "")


def _luhn(digits: Column) -> Column:
    """Luhn sum modulo ten."""

    def add(total: Column, place: Column) -> Column:
        d = F.substring(digits, place, F.lit(1)).cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return total + F.when((F.length(digits) - place) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10


def _pick(words: list[str], byte: Column) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in words]), byte % len(words) + 1)


def _made_up(stream: Column, script: Column, count: int) -> Column:
    out = F.lit(None).cast("string")
    for name, parts in SYLLABLES.items():
        word = F.concat(*[_pick(parts, _byte(stream, F.lit(k + 3))) for k in range(count)])
        out = F.when(script == name, word).otherwise(out)
    return F.initcap(out)


def _given(stream: Column, script: Column, gender: str, attempt: Column) -> Column:
    out = F.lit(None).cast("string")
    for (name, g), names in GIVEN.items():
        if g == gender:
            made = F.concat(_made_up(stream, F.lit(name), 3), F.lit(ENDINGS[name][gender]))
            out = F.when(script == name, F.when(attempt < LONGER, _pick(names, _byte(stream, F.lit(1)))).otherwise(made)).otherwise(out)
    return out


def surrogate_of(kind: Column, value: Column, attempt: Column, key: Column) -> Column:
    """The surrogate of a token, in the spelling of tokens."""
    seed = F.concat_ws("|", key, kind, value, attempt.cast("string"))

    def made(stream: Column) -> Column:
        hexadecimal = kind.isin("secret", "ipv6") & ((kind == "ipv6") | value.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"))
        alike = _alike(value, stream, hexadecimal)
        return F.when(kind.isin("email", "domain", "ipv4", "surname", "given_m", "given_f"), _token(kind, value, attempt, seed, stream, alike)).otherwise(
            _let(alike, lambda same: _token(kind, value, attempt, seed, stream, same))
        )

    return _let(_bytes(seed, F.length(value) + 8), made)


def _token(kind: Column, value: Column, attempt: Column, seed: Column, stream: Column, alike: Column) -> Column:
    more = F.when(attempt >= LONGER, F.lower(F.substring(F.sha2(seed, 256), 1, 6))).otherwise("")
    local = F.substring_index(value, "@", 1)
    octets = F.concat_ws(".", *[_byte(stream, F.lit(k)).cast("string") for k in range(1, 5)])
    # The first digit and the country code stay; a card number stays valid or invalid.
    country = F.when(value.rlike("^[17]"), 1).otherwise(2)
    card = F.concat(F.substring(value, 1, 1), F.substring(alike, F.lit(2), F.length(value) - 2))
    check = (F.lit(10) - _luhn(F.concat(card, F.lit("0")))) % 10
    # Short addresses have few surrogates of their own form.
    full = F.regexp_replace(F.substring(stream, 1, 32), "(.{4})(?=.)", "$1:")
    head = F.regexp_extract(value, "^(.*:)", 1)
    wrong = F.when(_luhn(value) == 0, 0).otherwise(1 + _byte(stream, F.length(value)) % 9)
    return (
        F.when(kind == "email", F.concat(_alike(local, stream, F.lit(False)), more))
        .when(kind == "domain", F.concat(_alike(F.regexp_extract(value, r"^(.*)\.", 1), stream, F.lit(False)), more, F.regexp_extract(value, r"(\.[^.]*)$", 1)))
        .when(kind == "ipv4", octets)
        .when((kind == "ipv6") & (attempt >= LONGER), full)
        .when((kind == "ipv6") & value.contains("."), F.concat(_alike(head, stream, F.lit(True)), octets))
        .when(kind == "phone", F.concat(F.substring(value, F.lit(1), country), F.substring(alike, country + 1, F.length(value))))
        .when(kind == "card", F.concat(card, ((check + wrong) % 10).cast("string")))
        .when(kind == "iban", F.concat(F.substring(value, 1, 2), F.substring(alike, F.lit(3), F.length(value))))
        .when(kind == "surname", F.concat(_made_up(stream, script_of(value), 4), F.when(attempt >= LONGER, _byte_word(stream, script_of(value))).otherwise("")))
        .when(kind == "given_m", _given(stream, script_of(value), "m", attempt))
        .when(kind == "given_f", _given(stream, script_of(value), "f", attempt))
        .otherwise(alike)
    )


def _byte_word(stream: Column, script: Column) -> Column:
    return F.lower(_made_up(F.substring(stream, F.lit(13), F.length(stream)), script, 3))


def replacement(entity: Column, surrogates: Column) -> Column:
    """A find rewritten with the surrogates of its tokens, in its own format and case."""

    def formatted(first: Column) -> Column:
        def digit(place: Column) -> Column:
            c = F.substring(entity, place, F.lit(1))
            before = F.length(F.regexp_replace(F.substring(entity, F.lit(1), place), "[^0-9A-Z]", ""))
            return F.when(c.rlike("[0-9A-Z]"), F.substring(first, before, F.lit(1))).otherwise(c)

        return F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(entity))), digit), "")

    def rewritten(new: Column) -> Column:
        first = F.element_at(new, 1)
        mail = F.concat(first, F.lit("@"), F.element_at(new, 2))
        return _let(kind_of(entity), lambda kind: (
            F.when(kind == "email", F.when(entity == F.upper(entity), F.upper(mail)).otherwise(mail))
            .when(kind.isin("phone", "card", "ssn", "iban"), _let(first, formatted))
            .when(kind == "name", F.array_join(new, " "))
            .otherwise(first)
        ))

    return _let(surrogates, rewritten)


def _finds(text: Column) -> Column:
    none = F.array().cast("array<string>")
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(none)


def attempts_needed(tokens: DataFrame, key: str) -> DataFrame:
    """(kind, value, attempt) of the tokens whose first surrogate will not do.

    ``tokens`` has distinct (kind, value). A surrogate will not do if another token of
    its kind has it (the smallest value keeps it), or, but for names, if it stands in
    the corpus itself. Such tokens try again until none is left.
    """
    table = spool(tokens.withColumn("attempt", F.lit(0)), "tokens")
    while True:
        surrogate = surrogate_of(F.col("kind"), F.col("value"), F.col("attempt"), F.lit(key))
        # Distinct addresses need distinct names only within one domain.
        told = F.when(F.col("kind") == "email", F.concat(surrogate, F.lit("@"), F.substring_index("value", "@", -1))).otherwise(surrogate)
        tried = table.withColumn("surrogate", told)
        owner = tried.groupBy("kind", "surrogate").agg(F.min("value").alias("owner"), F.count(F.lit(1)).alias("n")).where("n > 1")
        taken = tried.alias("a").join(owner.alias("b"), ["kind", "surrogate"]).where("value <> owner").select("kind", "value")
        real = (
            tried.where(~F.col("kind").rlike(NAME_KINDS)).alias("a")
            .join(tokens.select(F.col("kind").alias("k"), F.col("value").alias("v")), (F.col("kind") == F.col("k")) & (F.col("surrogate") == F.col("v")), "left_semi")
            .select("kind", "value")
        )
        again = spool(taken.union(real).distinct(), "token-clashes")
        if again.isEmpty():
            return table.where("attempt > 0")
        table = spool(
            table.join(again.withColumn("again", F.lit(1)), ["kind", "value"], "left").select(
                "kind", "value", (F.col("attempt") + F.coalesce("again", F.lit(0))).alias("attempt")
            ),
            "tokens",
        )


def surrogates(docs: DataFrame, key: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: id, text with surrogates, n_replaced, spans.

    ``spans`` has (kind, gap, length, new_length) of every find in order: characters
    since the find before, of the find and of its surrogate. Found are mail addresses, IP addresses, IBANs, keys and digests,
    phone, social security and card numbers, and names after a title or of a known
    given name. Equal values get equal surrogates everywhere and under one ``key``
    also in later runs; different values get different ones, and none but a name is
    a value of the corpus. Null texts stay null, texts without finds stay as they
    are. Rows with repeated or null ids are each rewritten; an empty table gives no
    rows; further columns are not looked at.
    """
    base = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    found = spool(
        base.select("id", F.explode(F.array_distinct(_finds(F.col("text")))).alias("entity"))
        .select("id", F.explode(tokens_of(F.col("entity"))).alias("t"))
        .select("id", "t.kind", "t.value"),
        "finds",
    )
    tokens = spool(found.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("rows")).select("kind", "value"), "found-tokens")
    later = spool(attempts_needed(tokens, key), "later-attempts")
    label = F.concat_ws("|", "kind", "value")
    # Documents that hold such a token, with the attempts of its tokens; few.
    changed = spool(
        found.join(later, ["kind", "value"])
        .select("id", F.struct(label.alias("k"), F.col("attempt").alias("v")).alias("e"))
        .distinct()
        .groupBy("id")
        .agg(F.map_from_entries(F.collect_list("e")).alias("attempts")),
        "changed",
    )

    def new(entity: Column) -> Column:
        def surrogate(token: Column) -> Column:
            attempt = F.coalesce(F.element_at(F.col("attempts"), F.concat_ws("|", token["kind"], token["value"])), F.lit(0))
            return surrogate_of(token["kind"], token["value"], attempt, F.lit(key))

        return replacement(entity, F.transform(tokens_of(entity), surrogate))

    finds = F.col("finds")
    rows = (
        base.join(changed, base["id"].eqNullSafe(changed["id"]), "left")
        .select(base["id"], "text", "attempts")
    )
    # Each step is a generator of one row: later steps use its result and do not repeat it.
    rows = rows.select("*", F.inline(F.array(F.struct(_finds(F.col("text")).alias("finds")))))
    gaps = F.when(F.size(finds) > 0, F.split("text", PATTERN, -1)).otherwise(F.array("text"))
    rows = rows.select("*", F.inline(F.array(F.struct(F.transform(finds, new).alias("made"), gaps.alias("gaps")))))
    pieces = F.zip_with(F.col("gaps"), F.col("made"), lambda g, m: F.concat(g, F.coalesce(m, F.lit(""))))
    spans = F.transform(
        F.arrays_zip(finds.alias("e"), F.col("made").alias("m"), F.slice("gaps", 1, F.size(finds)).alias("g")),
        lambda x: F.struct(
            kind_of(x["e"]).alias("kind"), F.length(x["g"]).alias("gap"), F.length(x["e"]).alias("length"), F.length(x["m"]).alias("new_length")
        ),
    )
    empty = F.array().cast("array<struct<kind:string,gap:int,length:int,new_length:int>>")
    return rows.select(
        F.col("id").alias(id),
        F.when(F.col("text").isNotNull(), F.array_join(pieces, "")).alias(text),
        F.size(finds).alias("n_replaced"),
        F.when(F.size(finds) > 0, spans).otherwise(empty).alias("spans"),
    )
