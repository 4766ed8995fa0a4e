"""Surrogates for personal data, in DataFrame functions only.

Entities are found by patterns.  An entity's surrogate is made from a keyed
digest (HMAC-SHA-512) of its kind, its canonical form and an attempt number:
digits become digits and letters letters of the same case, so that it keeps the
original's format; names keep script and gender.  All distinct entities of the
corpus get attempt 0 first; where a surrogate equals a real entity or that of a
smaller entity, the entity takes the next attempt, until none collides.  So
equal entities stay equal and different ones different, in every document.

A name of several words is several entities: the family name and each middle
name, whose surrogates all their bearers share, and the first and last word,
which decide the given name.  Where a text has such a name after a title, it is
replaced without one too, with all its words or with the first and one other.

Where a kind has too few surrogates of one length, they grow longer from
attempt to attempt, so there are always enough.
"""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.sources.shared import discard, keep

#: Given names that stand in for others, by script and gender.  Fixed values.
GIVEN = {
    ("latin", "f"): ["Anna", "Clara", "Elena", "Emma", "Eva", "Hannah", "Ines", "Julia", "Laura", "Lucia", "Maria", "Marta", "Nina", "Olivia", "Paula", "Sara"],
    ("latin", "m"): ["Adam", "Andre", "Carlos", "David", "Emil", "Felix", "Hugo", "Jan", "Karl", "Leon", "Lucas", "Martin", "Oscar", "Paul", "Simon", "Victor"],
    ("cyrillic", "f"): ["Анна", "Вера", "Дарья", "Елена", "Ирина", "Мария", "Ольга", "Софья"],
    ("cyrillic", "m"): ["Андрей", "Борис", "Виктор", "Иван", "Максим", "Олег", "Павел", "Сергей"],
    ("greek", "f"): ["Άννα", "Ειρήνη", "Ελένη", "Κατερίνα", "Μαρία", "Σοφία"],
    ("greek", "m"): ["Ανδρέας", "Γιώργος", "Δημήτρης", "Κώστας", "Νίκος", "Πέτρος"],
}
#: Titles that announce a name, by the gender they tell.  Fixed values.
TITLES = {"f": ["Mrs", "Ms", "Miss", "Frau", "Señora", "Madame", "Mme", "Г-жа", "Κυρία"], "m": ["Mr", "Herr", "Señor", "Monsieur", "Г-н", "Κύριος"]}
SYLLABLES = {
    "latin": ["ba", "del", "fer", "gan", "hol", "kar", "lin", "mar", "nor", "pel", "ros", "sten", "tor", "val", "win", "zel"],
    "cyrillic": ["ба", "вел", "гор", "дан", "зел", "кар", "лин", "мар", "нов", "пел", "рос", "сте", "тор", "фед", "хол", "шин"],
    "greek": ["βα", "γαν", "δελ", "ζαν", "θεο", "καλ", "λιν", "μαρ", "νικ", "παπ", "ρος", "στα", "τορ", "φιλ", "χαρ", "ψαλ"],
}
#: Characters for those of a script, of secrets in it.  Fixed values.
ALPHABETS = {
    r"[а-яё]": "абвгдежзиклмнопрстуфхцчшщэюя", r"[А-ЯЁ]": "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЩЭЮЯ", r"[α-ωά-ώ]": "αβγδεζηθικλμνξοπρστυφχψω", r"[Α-Ω]": "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ",
    r"\p{IsHan}": "一二三四五六七八九十百千万上下左右中大小月日年火水木金土", r"\p{IsHiragana}": "あいうえおかきくけこさしすせそたちつてと", r"\p{IsKatakana}": "アイウエオカキクケコサシスセソタチツテト", r"\p{IsHangul}": "가나다라마바사아자차카타파하",
    r"\p{Lu}": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", r"\p{L}": "abcdefghijklmnopqrstuvwxyz", r"\p{N}": "0123456789", r"[^\p{M}\p{Z}\p{C}._/:=@-]": "!#$%&*+?^~",
}
#: A word of a name, without the ending of a possessive.
WORD = r"\p{Lu}(?:\p{L}|['’-](?!s(?!\p{L}))\p{L})+"
#: Attempts after which kinds of fixed length grow longer, and after which a digest makes sure of it.
FIXED, LAST = 8, 30
#: Kinds and their patterns; where several fit at a place the first counts.
PATTERNS = {
    "email": r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "secret": r"AKIA[0-9A-Z]{16}(?![0-9A-Za-z])",
    "login": r"(?i:\b(?:password|passwd|pwd|secret|token|api_?key)\b\s{0,3}[=:]\s{0,3})(?:\"[^\"\s]{6,}\"|'[^'\s]{6,}'|[^\s\"',;]{6,})",
    "ip": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9])",
    "card": r"(?<![0-9A-Za-z])(?:[3-6][0-9]{3}(?:[ -]?[0-9]{4}){3})(?![0-9A-Za-z])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){3,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])",
    "phone": r"\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){2,3}(?![0-9])|(?<![0-9A-Za-z])\(?[2-9][0-9]{2}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "name": r"\b(?:" + "|".join(t for ts in TITLES.values() for t in ts) + rf")\.?[ \u00A0]{WORD}(?: {WORD}){{0,2}}",
}
LOGIN_START = r"^([A-Za-z_]+\s*[=:]\s*[\"']?)"
EVERY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Characters and titles without which no pattern fits; texts without them are not searched.
HINT = r"[0-9@]|(?i:password|passwd|pwd|secret|token|api_?key)|\b(?:" + "|".join(t for ts in TITLES.values() for t in ts) + r")\b"


#: What logged plans leave out: long runs of hexadecimal digits, as which binary values are written.
HIDDEN = "[0-9A-Fa-f]{64,}"


def kind_of(entity: Column) -> Column:
    """The first kind whose pattern fits the whole entity."""
    whole = [F.when(entity.rlike(f"^(?:{p})$"), F.lit(k)) for k, p in PATTERNS.items()]
    return F.coalesce(*whole, F.lit("login"))


def untitled(entity: Column) -> Column:
    """A name without its title."""
    return F.regexp_replace(entity, r"^\S+[ \u00A0]", "")


def names_of(entity: Column) -> Column:
    """The words of a name, in lower case."""
    return F.split(F.lower(untitled(entity)), " ")


def middle_of(entity: Column) -> Column:
    """Those but the first and the last."""
    return let(names_of(entity), lambda w: F.slice(w, F.lit(2), F.greatest(F.size(w) - 2, F.lit(0))))


def canonical(entity: Column, kind: Column) -> Column:
    """What is equal for all ways to write one entity."""
    return (
        F.when(kind.isin("card", "ssn", "phone"), F.regexp_replace(entity, "[^0-9]", ""))
        .when(kind == "iban", F.regexp_replace(entity, " ", ""))
        .when(kind == "email", F.lower(entity))
        .when(kind == "login", F.regexp_replace(F.regexp_replace(entity, LOGIN_START, ""), "[\"']$", ""))
        .when(kind == "name", let(names_of(entity), lambda w: F.when(F.size(w) > 2, F.concat(F.element_at(w, 1), F.lit(" "), F.element_at(w, -1))).otherwise(F.array_join(w, " "))))
        .otherwise(entity)
    )


def let(value: Column, body) -> Column:
    """body(value) with `value` computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


class Key:
    """The two padded keys of HMAC-SHA-512."""

    def __init__(self, spark: SparkSession, key: str) -> None:
        block = key.encode()
        block = (hashlib.sha512(block).digest() if len(block) > 128 else block).ljust(128, b"\0")
        self.inner, self.outer = (F.lit(bytes(x ^ pad for x in block)) for pad in (0x36, 0x5C))
        if not spark.conf.get("spark.sql.redaction.string.regex", None):
            spark.conf.set("spark.sql.redaction.string.regex", HIDDEN)  # plans in logs and listings don't tell the key

    def digest(self, said: Column) -> Column:
        return F.sha2(F.concat(self.outer, F.unhex(F.sha2(F.concat(self.inner, said.cast("binary")), 512))), 512)


def noise(key: Key, kind: Column, form: Column, attempt: Column) -> Column:
    """384 hex digits of keyed digests."""
    said = F.concat_ws("\x1f", kind, form, attempt.cast("string"))
    return F.concat(*[key.digest(F.concat(said, F.lit(f"\x1f{k}"))) for k in range(3)])


def number(random: Column, k: Column | int) -> Column:
    """The k-th number, 0 to 255, of noise(); they repeat after 192, each time moved on by one."""
    k = F.lit(k) if isinstance(k, int) else k
    return F.conv(F.substring(random, (k % 192 * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("int") + F.floor(k / 192).cast("int")


def characters(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def reshaped(s: Column, random: Column, kept: int = 0, others: bool = False) -> Column:
    """Digits for digits and letters for letters of the same case, after the first `kept` characters; with `others` also for those outside ASCII, of the same script, and signs for signs."""

    def drawn(options: str, i: Column) -> Column:
        return F.substring(F.lit(options), (number(random, i) % len(options) + 1).cast("int"), F.lit(1))

    def one(c: Column, i: Column) -> Column:
        found = F.when(i < kept, c).when(c.rlike("^[0-9]$"), drawn("0123456789", i)).when(c.rlike("^[a-z]$"), drawn("abcdefghijklmnopqrstuvwxyz", i)).when(c.rlike("^[A-Z]$"), drawn("ABCDEFGHIJKLMNOPQRSTUVWXYZ", i))
        for pattern, options in ALPHABETS.items() if others else ():
            found = found.when(c.rlike(f"^{pattern}$"), drawn(options, i))
        return found.otherwise(c)

    return F.array_join(F.transform(characters(s), one), "")


def longer(s: Column, random: Column, attempt: Column, options: str = "abcdefghijklmnopqrstuvwxyz0123456789") -> Column:
    """`s` and as many further characters as `attempt` says; from LAST on also a digest."""
    more = F.transform(F.sequence(F.lit(1), F.greatest(attempt, F.lit(1))), lambda k: F.substring(F.lit(options), (number(random, k + 90) % len(options) + 1).cast("int"), F.lit(1)))
    sure = F.when(attempt >= LAST, F.substring(random, F.lit(1), F.lit(40)) if len(options) > 10 else F.translate(F.substring(random, F.lit(1), F.lit(40)), "abcdef", "012345")).otherwise("")
    return F.when(attempt > 0, F.concat(s, F.array_join(more, ""), sure)).otherwise(s)


def with_check_digit(digits: Column) -> Column:
    """The digits with the last one set so that their Luhn sum ends in 0."""
    n = F.length(digits)
    doubled = F.transform(
        F.sequence(F.lit(1), n - 1),
        lambda i: F.substring(digits, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1),
    )
    total = F.aggregate(doubled, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x))
    return F.concat(F.substring(digits, F.lit(1), n - 1), ((10 - total % 10) % 10).cast("string"))


def with_iban_check(s: Column) -> Column:
    """An account number with the third and fourth character set so that it is 1 modulo 97, as ISO 13616 asks for."""

    def added(a: Column, c: Column) -> Column:
        return F.when(c.rlike("[0-9]"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)

    land, rest = F.substring(s, F.lit(1), F.lit(2)), F.substring(s, F.lit(5), F.length(s))
    left = F.aggregate(characters(F.concat(rest, land, F.lit("00"))), F.lit(0), lambda a, c: added(a, c).cast("int"))
    return F.concat(land, F.lpad((98 - left).cast("string"), 2, "0"), rest)


def pick(options: list[str], at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, options)), (at % len(options) + 1).cast("int"))


def syllables(form: Column, random: Column, n: Column, first: int) -> Column:
    """`n` syllables of the form's script."""

    def of(name: str) -> Column:
        return F.array_join(F.transform(F.sequence(F.lit(1), n), lambda k: pick(SYLLABLES[name], number(random, k + first))), "")

    script = script_of(form)
    return F.when(script == "cyrillic", of("cyrillic")).when(script == "greek", of("greek")).otherwise(of("latin"))


def script_of(form: Column) -> Column:
    return F.when(form.rlike(r"\p{IsCyrillic}"), "cyrillic").when(form.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def surrogate_given(form: Column, gender: Column, random: Column, attempt: Column) -> Column:
    """For a whole name, a given name of its script and gender, then its own family name; every third attempt is longer."""
    script = script_of(form)
    given = reduce(lambda c, x: c.when((script == x[0][0]) & (gender == x[0][1]), F.lower(pick(x[1], number(random, 0)))), GIVEN.items(), F.when(F.lit(False), F.lit("")))
    longer = F.when(attempt < 3, F.lit("")).otherwise(syllables(form, random, F.floor(F.greatest(attempt, F.lit(3)) / 3).cast("int"), 0))
    return F.concat(given, longer, F.lit(" "), family_of(form))


def family_of(form: Column) -> Column:
    return F.element_at(F.split(form, " "), -1)


def surrogate_email(key: Key, form: Column, random: Column, attempt: Column) -> Column:
    """The local part reshaped, longer from attempt to attempt, the domain another under a reserved one; addresses of one domain stay in one domain."""
    local, host = F.split_part(form, F.lit("@"), F.lit(1)), F.split_part(form, F.lit("@"), F.lit(2))
    domain = let(noise(key, F.lit("host"), host, F.lit(0)), lambda r: F.concat(reshaped(F.regexp_extract(host, r"^(.*?)[^.]*\.[^.]*$", 1), r), pick(["example.com", "example.net", "example.org"], number(r, 191))))
    return F.concat(longer(reshaped(local, random), random, attempt), F.lit("@"), domain)


def surrogate(key: Key, kind: Column | str, form: Column, gender: Column, attempt: Column) -> Column:
    """The surrogate of a canonical form, itself canonical; of one kind alone, if `kind` is its name."""

    def made(random: Column) -> Column:
        octets = [(number(random, k) % most + 1).cast("string") for k, most in enumerate((223, 254, 254, 254))]
        further = F.concat(F.lit("2001:db8:"), F.concat_ws(":", *[F.substring(random, 4 * k + 1, 4) for k in range(6)]))  # of the range for examples
        digits = lambda c: longer(c, random, attempt - FIXED, "0123456789")
        kinds = {
            "email": lambda: surrogate_email(key, form, random, attempt),
            "secret": lambda: longer(reshaped(form, random, 4), random, attempt),
            "login": lambda: longer(reshaped(form, random, others=True), random, attempt),
            "ip": lambda: F.when(attempt > FIXED, further).otherwise(F.concat_ws(".", *octets)),
            "card": lambda: digits(let(reshaped(form, random, 1), with_check_digit)),
            "ssn": lambda: digits(reshaped(form, random)),
            "phone": lambda: digits(reshaped(form, random, 1)),
            "iban": lambda: let(reshaped(form, random, 2), with_iban_check),
            "family": lambda: syllables(form, random, attempt + 3, 0),
            "name": lambda: surrogate_given(form, gender, random, attempt),
        }
        if isinstance(kind, str):
            return kinds[kind]()
        return reduce(lambda c, k: c.when(kind == k, kinds[k]()), kinds, F.when(F.lit(False), F.lit("")))

    return let(noise(key, F.lit(kind) if isinstance(kind, str) else kind, form, attempt), made)


def gender_of(entity: Column) -> Column:
    return F.when(entity.rlike("^(?:" + "|".join(TITLES["f"]) + r")\.?[ \u00A0]"), "f").otherwise("m")


def rendered(entity: Column, kind: Column, form: Column, new: Column) -> Column:
    """The surrogate written the way the entity was."""
    places = characters(entity)
    after = lambda pattern: F.transform(places, lambda c, i: F.when(c.rlike(pattern), F.substring(new, F.length(F.regexp_replace(F.substring(entity, F.lit(1), i + 1), pattern.replace("[", "[^"), "")), F.lit(1))).otherwise(c))
    cased = F.transform(F.split(new, " "), lambda w, i: F.initcap(w))
    return (
        F.when(kind.isin("card", "ssn", "phone"), F.concat(F.array_join(after("[0-9]"), ""), F.substring(new, F.length(F.regexp_replace(entity, "[^0-9]", "")) + 1, F.length(new))))
        .when(kind == "iban", F.array_join(after("[0-9A-Z]"), ""))
        .when(kind == "login", F.concat(F.regexp_extract(entity, LOGIN_START, 1), new, F.regexp_extract(entity, "([\"']?)$", 1)))
        .when(kind == "name", F.concat(F.regexp_extract(entity, r"^(\S+[ \u00A0])", 1), F.array_join(cased, " ")))
        .when(kind == "full", F.array_join(cased, " "))
        .when((kind == "email") & entity.rlike("^[^a-z]*$"), F.upper(new))
        .otherwise(new)
    )


def parsed(entity: Column) -> Column:
    """kind, form and gender of an entity; only names of several words have a gender, others are family names."""

    def by(kind: Column) -> Column:
        form = canonical(entity, kind)
        single = (kind == "name") & ~form.contains(" ")
        return F.struct(F.when(single, "family").otherwise(kind).alias("kind"), form.alias("form"), F.when((kind == "name") & ~single, gender_of(entity)).otherwise("").alias("gender"))

    return let(kind_of(entity), by)


def and_family(entity: Column) -> Column:
    """What parsed() gives, and for a name of several words its family name and middle names too."""
    family = lambda form: F.struct(F.lit("family").alias("kind"), form.alias("form"), F.lit("").alias("gender"))
    return let(parsed(entity), lambda p: F.when(p["kind"] == "name", F.concat(F.array(p, family(family_of(p["form"]))), F.transform(middle_of(entity), family))).otherwise(F.array(p)))


def collision_free(forms: DataFrame, key: Key) -> tuple[DataFrame, DataFrame]:
    """(kind, form, attempt, new) of distinct (kind, form, gender), and those rows of it that needed another attempt than 0.

    Surrogates grow longer with the attempts, so few rounds are needed and
    their number is bounded: what collides in the last of LAST rounds gets a
    whole digest in the next.
    """
    given = forms.withColumn("attempt", F.lit(0))
    now = None
    while True:
        last, now = now, keep(given.select("kind", "form", "gender", "attempt", surrogate(key, F.col("kind"), F.col("form"), F.col("gender"), F.col("attempt")).alias("new")), "surrogates")
        if last is not None:
            discard(last)
        real = forms.select("kind", F.col("form").alias("new"), F.lit(True).alias("real")).distinct()
        first = now.groupBy("kind", "new").agg(F.min(F.struct("form", "gender")).alias("first"), F.count("*").alias("n"))
        clash = first.join(real, ["kind", "new"], "left").where("n > 1 or real")
        if clash.isEmpty():
            return now, now.where("attempt > 0")
        given = now.join(clash, ["kind", "new"], "left").select(
            "kind", "form", "gender",
            (F.col("attempt") + F.when(F.col("real") | (F.struct("form", "gender") > F.col("first")), 1).otherwise(0)).alias("attempt"),
        )


def with_surrogates(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with surrogates in `text_col`; columns `pii_found` and, per kind in PATTERNS' order, `pii_kinds` are put in place of any of these names.

    `pii_found` counts the places that a pattern found; names that come back
    without a title are replaced but not counted.  Texts without entities come
    back unchanged; a null text stays null and holds none.  Repeated rows get
    the same text; no row is added or lost, and other columns, whatever their
    names, stay as they are.  Null ids have no effect.  Empty in, empty out.
    """
    secret = Key(docs.sparkSession, key)
    own = [c for c in docs.columns if c.lower() not in ("pii_found", "pii_kinds")]
    text = F.col("row")[text_col]
    none = F.array().cast("array<string>")
    entities = F.coalesce(F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(EVERY), F.lit(0))), none)
    found = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row")).select("row", entities.alias("entities"))
    each = found.select(F.explode("entities").alias("e")).distinct()
    forms = keep(each.select(F.explode(and_family(F.col("e"))).alias("p")).select("p.*").distinct(), "entities")
    _, moved = collision_free(forms, secret)
    if (n := moved.count()) == 0:
        found = found.withColumn("attempts", F.lit(None).cast("map<string,int>"))
    else:  # few entities need another attempt: their texts are told by the hashes of what they hold
        again = moved.select(F.concat_ws("\x1f", "kind", "form", "gender").alias("entity"), "attempt")
        hashed = found.withColumn("hash", F.when(F.size("entities") > 0, F.sha2(F.to_json("entities"), 256)))
        uses = hashed.where("hash is not null").select("hash", F.explode("entities").alias("e")).distinct().select("hash", F.explode(and_family(F.col("e"))).alias("p")).select("hash", F.concat_ws("\x1f", "p.kind", "p.form", "p.gender").alias("entity"))
        attempts = uses.join(again, "entity").groupBy("hash").agg(F.map_from_entries(F.collect_set(F.struct("entity", "attempt"))).alias("attempts"))
        attempts = keep(attempts, "attempts")
        small = n <= 10_000 and attempts.count() <= 20_000
        found = hashed.join(F.broadcast(attempts) if small else attempts, "hash", "left").drop("hash")

    def made(kind: Column | str, form: Column, gender: Column) -> Column:
        attempt = F.coalesce(F.element_at(F.col("attempts"), F.concat_ws("\x1f", F.lit(kind) if isinstance(kind, str) else kind, form, gender)), F.lit(0))
        return surrogate(secret, kind, form, gender, attempt)

    def family(form: Column) -> Column:
        return made("family", form, F.lit(""))

    def new_name(e: Column, p: Column) -> Column:
        """Words of a whole name: the given name of its surrogate, and those of the other words."""
        given = F.split_part(made("name", p["form"], p["gender"]), F.lit(" "), F.lit(1))
        return F.concat(F.array(given), F.transform(middle_of(e), family), F.array(family(family_of(p["form"]))))

    def replaced(e: Column) -> Column:
        def by(p: Column) -> Column:
            written = F.when(p["kind"] == "family", "name").otherwise(p["kind"])
            return let(F.when(p["kind"] == "name", F.array_join(new_name(e, p), " ")).otherwise(made(p["kind"], p["form"], p["gender"])), lambda x: rendered(e, written, p["form"], x))

        return let(parsed(e), by)

    def without_title(part: Column) -> Column:
        """A stretch between entities, in which names of several words that the text has after a title are replaced too."""
        def one(said: Column, name: Column) -> Column:
            return F.regexp_replace(said, F.concat(F.lit(r"(?<!\p{L})(?<!\p{L}['’-])"), name["old"], F.lit(r"(?!\p{L}|['’-](?!s(?!\p{L}))\p{L})")), name["new"])

        return F.aggregate("names", part, one)

    whole = F.array_distinct(F.filter("entities", lambda e: e.rlike(f"^(?:{PATTERNS['name']})$") & untitled(e).contains(" ")))
    def ways(e: Column) -> Column:
        """A name as it may come without a title: all its words, then the first and one other."""
        old = F.split(untitled(e), " ")
        two = lambda words, k: F.concat(F.element_at(words, 1), F.lit(" "), F.element_at(words, k))
        way = lambda a, b: F.struct(a.alias("old"), rendered(e, F.lit("full"), F.lit(""), b).alias("new"))
        both = lambda new: F.concat(F.array(way(F.array_join(old, " "), F.array_join(new, " "))), F.when(F.size(old) > 2, F.array(way(two(old, -1), two(new, -1)), way(two(old, 2), two(new, 2)))).otherwise(F.array()))
        return let(let(parsed(e), lambda p: new_name(e, p)), both)

    names = F.flatten(F.transform(whole, ways))
    known = found.withColumn("names", names)
    fresh = F.concat(F.transform("entities", replaced), F.array(F.lit("")))
    parts = F.split(text, EVERY, -1)
    parts = F.when(F.size("names") > 0, F.transform(parts, without_title)).otherwise(parts)
    rebuilt = F.array_join(F.zip_with(parts, fresh, lambda s, e: F.concat(s, e)), "")
    new = F.when(F.size("entities") > 0, rebuilt).otherwise(text)
    kinds = F.array_join(F.array_distinct(F.transform("entities", kind_of)), ",")
    return known.select(*[new.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in own], F.size("entities").alias("pii_found"), kinds.alias("pii_kinds"))
