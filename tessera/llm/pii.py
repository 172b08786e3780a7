"""Surrogates for personal data, with DataFrame functions alone.

Entities are found by one pattern. Each distinct entity of the corpus, in its normal form, gets a replacement from a
keyed hash: digits for digits, for each letter another one of the same script, given names from lists of the same gender, and
check digits and number ranges as the kind wants them. Candidates that two entities share, or that are entities of the
corpus themselves, are drawn again until all are distinct; then every mention is replaced in its own format, so that
equal entities stay equal and different ones different. A mail domain is an entity of its own. A name's given and family name are entities of their own, so a
person keeps the family name where the given name isn't said, and where a title isn't, in the same text.
"""

from __future__ import annotations

import hashlib
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, joined_by_weight, pinned, text_or_empty
from .spans import matched

ROUNDS = 64  # of drawing surrogates; each leaves less than about half of the entities before it

# Patterns, titles and names.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
IPV4 = r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9])"
CARD = (
    r"(?<![A-Za-z0-9])(?:(?:4[0-9]{3}|5[1-5][0-9]{2}|2(?:22[1-9]|2[3-9][0-9]|[3-6][0-9]{2}|7[01][0-9]|720)|6(?:011|5[0-9]{2}|4[4-9][0-9])|35(?:2[89]|[3-8][0-9]))"
    r"(?:[ -]?[0-9]{4}){3}|3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5})(?![A-Za-z0-9])"
)
SSN = r"(?<![A-Za-z0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9-])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
PHONE = r"(?<![A-Za-z0-9])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![A-Za-z0-9])|(?<![A-Za-z0-9])\+[0-9]{8,14}(?![A-Za-z0-9])"
HE, SHE = "Mr Sir Herr Monsieur Señor Don Господин Κύριος".split(), "Mrs Ms Miss Madam Frau Madame Mme Mlle Señora Señorita Doña Госпожа Κυρία".split()
ANY = "Dr Prof Professor Doctor".split()
TITLES = sorted(HE + SHE + ANY, key=len, reverse=True)
PART = r"\p{Lu}\p{M}*(?:\p{Ll}\p{M}*)+"
WORD = rf"(?:\p{{Lu}}['’])?{PART}(?:['’-]?{PART})*"
NAME = rf"(?<![\p{{L}}\p{{N}}])(?=[{''.join(sorted({t[0] for t in TITLES}))}])(?:{'|'.join(TITLES)})\.? {WORD}(?: {WORD})?"
PATTERNS = {"email": EMAIL, "iban": IBAN, "ip": IPV4, "ssn": SSN, "card": CARD, "phone": PHONE, "name": NAME}
PATTERN = "|".join(f"(?:{p})" for p in PATTERNS.values())
GIVEN = {
    "he": "Adam Bruno Carl David Emil Felix Georg Hugo Ivan Jakob Karl Louis Martin Noel Oscar Paul Robert Simon Thomas Victor".split(),
    "she": "Alice Berta Clara Diana Elena Flora Greta Helena Irene Julia Klara Laura Maria Nina Olga Paula Rosa Sofia Teresa Vera".split(),
    "any": "Alex Andrea Charlie Chris Dominique Elia Jamie Jean Jordan Kim Lou Luca Maxime Mika Noa Robin Sam Sascha Toni Yael".split(),
}
#: By script: a pattern of its letters, one of its vowels, and the small vowels and consonants that stand for others. Letters of all other scripts become Latin ones.
LETTERS = {
    "cyrillic": (r"\p{IsCyrillic}", "[аеёиоуыэюяіїєѐѝӑӓӗәӣӧөӯӱӳ]", "аеиоу", "бвгдзклмнпрст"),
    "greek": (r"\p{IsGreek}", "[αεηιουωάέήίόύώϊϋΐΰἀ-ὠὰ-ᾯᾰ-ᾷῂ-ῇῐ-ῗῠ-ῧῲ-ῷ]", "αεηιο", "βγδζκλμνπρστ"),
    "armenian": (r"\p{IsArmenian}", "[աեէըիոօև]", "աէըիո", "բգդզթլկհմնպսվտ"),
    "georgian": (r"\p{IsGeorgian}", "[აეიოუ]", "აეიოუ", "ბგდვზთკლმნპრსტ"),
    "latin": (r"\p{L}", "[aeiouyà-æè-ïðò-öøù-ýÿāăąēĕėęěĩīĭįıōŏőœũūŭůűųŷǎǐǒǔạ-ỹ]", "aeiou", "bcdfghklmnprstvz"),
}


def kind_of(value: Column) -> Column:
    """The first kind whose pattern is the whole value."""
    return F.coalesce(*[F.when(value.rlike(f"^(?:{p})$"), F.lit(k)) for k, p in PATTERNS.items()], F.lit("name"))


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn_sum(digits: Column, last_is_check: bool) -> Column:
    """The sum that is a multiple of ten for a valid number; without its check digit, places are one further left."""

    def step(acc: Column, c: Column) -> Column:
        d = c.cast("int")
        doubled = F.when(acc["odd"], F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)).otherwise(d)
        return F.struct((~acc["odd"]).alias("odd"), (acc["total"] + doubled).alias("total"))

    places = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")
    return F.aggregate(places, F.struct(F.lit(not last_is_check).alias("odd"), F.lit(0).alias("total")), step, lambda acc: acc["total"])


def remainder_97(code: Column) -> Column:
    """The remainder by 97 of a code of digits and capitals, a letter being a number from 10 on."""

    def step(acc: Column, c: Column) -> Column:
        letter = c.rlike("[A-Z]")
        return (acc * F.when(letter, 100).otherwise(10) + F.when(letter, F.ascii(c) - 55).otherwise(c.cast("int"))) % 97

    return F.aggregate(F.filter(F.split(code, ""), lambda c: c != ""), F.lit(0), step)


def is_entity(kind: Column, value: Column) -> Column:
    """Cards and IBANs have valid check digits; phone numbers have 7 to 15 digits."""
    digits = digits_of(value)
    whole = F.replace(value, F.lit(" "), F.lit(""))
    iban = remainder_97(F.concat(F.substring(whole, 5, 40), F.substring(whole, 1, 4))) == 1
    return F.when(kind == "card", F.length(digits).between(13, 19) & (luhn_sum(digits, True) % 10 == 0)).when(kind == "phone", F.length(digits).between(7, 15)).when(kind == "iban", iban).otherwise(True)


def normal_form(kind: Column, value: Column) -> Column:
    """What mentions of one entity have in common: digits of numbers, of phone numbers the last ten, small letters of addresses. Names have parts instead."""
    return (
        F.when(kind == "phone", F.substring(digits_of(value), -10, 10))
        .when(kind.isin("card", "ssn"), digits_of(value))
        .when(kind == "email", F.lower(value))
        .when(kind == "iban", F.replace(value, F.lit(" "), F.lit("")))
        .otherwise(value)
    )


def gender_of(value: Column) -> Column:
    title = F.regexp_extract(value, r"^([\p{L}]+)", 1)
    return F.when(title.isin(HE), "he").when(title.isin(SHE), "she").otherwise("any")


def noise(parts: list[Column]) -> Column:
    """128 hexadecimal digits from a keyed hash."""
    return F.sha2(F.concat_ws("\x1f", *parts), 512)


def number_at(hexes: Column, place: Column) -> Column:
    """A number below 256 from the hash's digits, at a place; the hash is read round."""
    return F.conv(F.substring(hexes, (place % 64 * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("int")


def pick(letters: str, number: Column) -> Column:
    return F.substring(F.lit(letters), (number % len(letters) + 1).cast("int"), F.lit(1))


def other_than(letter: Column, letters: Column, number: Column) -> Column:
    """One of the letters, but never the given one."""
    at, count = F.instr(letters, letter), F.length(letters)
    place = F.when(at > 0, (at + number % (count - 1)) % count).otherwise(number % count)
    return F.substring(letters, (place + 1).cast("int"), F.lit(1))


def like(value: Column, hexes: Column, keep: Column | int = 0) -> Column:
    """value with each letter and digit after the first keep characters replaced by another one of its own kind, script and case.

    No letter stays, of whatever script, and marks that are set on letters go with them. Digits may come out as they were.
    """

    # three steps, so that no part of the expression stands in it twice
    def with_table(c: Column, i: Column) -> Column:
        table = None
        for script, vowel, vowels, consonants in LETTERS.values():
            letters = F.when(F.lower(c).rlike(vowel), vowels).otherwise(consonants)
            table = F.when(c.rlike(script), letters) if table is None else table.when(c.rlike(script), letters)
        return F.struct(c.alias("c"), (i < keep).alias("keep"), number_at(hexes, i).alias("n"), table.alias("table"))

    def with_letter(x: Column) -> Column:
        return F.struct(x["c"].alias("c"), x["keep"].alias("keep"), x["n"].alias("n"), other_than(F.lower(x["c"]), x["table"], x["n"]).alias("letter"))

    def chosen(x: Column) -> Column:
        placed = F.when(x["c"].rlike(r"\p{Lu}|\p{Lt}"), F.upper(x["letter"])).otherwise(x["letter"])
        choice = F.when(x["keep"], x["c"]).when(x["letter"].isNotNull(), placed).when(x["c"].rlike("[0-9]"), (x["n"] % 10).cast("string"))
        return choice.when(x["c"].rlike(r"\p{M}"), "").otherwise(x["c"])

    chars = F.filter(F.split(value, ""), lambda c: c != "")
    return F.array_join(F.transform(F.transform(F.transform(chars, with_table), with_letter), chosen), "")


def longer(entity: Column, hexes: Column, attempt: Column) -> Column:
    """Syllables of the entity's script to put behind a candidate: none at first, one more with every second attempt."""
    out = None
    for script, _, vowels, consonants in LETTERS.values():
        parts = [pick(letters, number_at(hexes, F.lit(40 + 2 * k + j))) for k in range(8) for j, letters in enumerate((consonants, vowels))]
        syllables = F.substring(F.concat(*parts), F.lit(1), F.least(F.floor(attempt / 2) * 2, F.lit(16)).cast("int"))
        out = F.when(entity.rlike(script), syllables) if out is None else out.when(entity.rlike(script), syllables)
    return F.coalesce(out, F.lit(""))


def surrogate(kind: Column, entity: Column, gender: Column, key: str, attempt: Column) -> Column:
    """A candidate for an entity in its normal form. An address keeps its domain here, as domains are entities of their own."""
    hexes = noise([F.lit(key), kind, entity, attempt.cast("string")])
    more = longer(entity, hexes, attempt)
    local, domain = F.substring_index(entity, "@", 1), F.substring_index(entity, "@", -1)
    top = F.concat(F.lit("."), F.substring_index(domain, ".", -1))
    host = F.regexp_extract(domain, r"^(.*)\.[^.]*$", 1)
    email = F.concat(like(local, hexes), more, F.lit("@"), domain)
    site = F.concat(like(host, hexes), more, top)
    # the first four digits say what card it is
    body = F.substring(like(entity, hexes, 4), F.lit(1), F.length(entity) - 1)
    card = F.concat(body, ((10 - luhn_sum(body, False) % 10) % 10).cast("string"))
    octets = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (number_at(hexes, i) % 254 + 1).cast("string")), ".")
    digits = like(entity, hexes)
    # a phone number's first digit isn't 0 or 1
    phone = F.concat((number_at(hexes, F.lit(63)) % 8 + 2).cast("string"), F.substring(digits, F.lit(2), F.length(entity)))

    def below(place: int, bound: int, width: int) -> Column:
        return F.lpad((F.conv(F.substring(hexes, place, 8), 16, 10).cast("bigint") % bound + 1).cast("string"), width, "0")

    # areas are 001 to 899 without 666; groups and serial numbers aren't zero
    area = below(1, 898, 3)
    ssn = F.when(F.length(entity) == 9, F.concat(F.when(area < "666", area).otherwise(F.lpad((area.cast("int") + 1).cast("string"), 3, "0")), below(9, 99, 2), below(17, 9999, 4))).otherwise(digits)
    country, account = F.substring(entity, 1, 2), F.substring(digits, F.lit(5), F.length(entity))
    iban = F.concat(country, F.lpad((98 - remainder_97(F.concat(account, country, F.lit("00")))).cast("string"), 2, "0"), account)
    listed = reduce(lambda other, g: F.when(gender == g, F.element_at(F.array(*map(F.lit, GIVEN[g])), number_at(hexes, F.lit(0)) % len(GIVEN[g]) + 1)).otherwise(other), GIVEN, F.lit(""))
    name = F.concat(F.when((kind == "given") & ~entity.rlike(r"[^\p{IsLatin}\p{M}'’-]"), listed).otherwise(digits), more)
    return F.when(kind == "email", email).when(kind == "domain", site).when(kind == "card", card).when(kind == "ip", octets).when(kind == "phone", phone).when(kind == "ssn", ssn).when(kind == "iban", iban).when(kind.isin("given", "family"), name).otherwise(digits)


def shuffled(entity: Column, size: int, key: str) -> Column:
    """Another number of size digits for each, by a keyed one-to-one map of all numbers of that size; none is its own image."""
    # the factor has no divisor in common with ten, and an odd sum to add leaves no number in its place
    factor, plus = (int(hashlib.sha256(f"{key}:{size}:{part}".encode()).hexdigest()[:8], 16) for part in ("factor", "plus"))
    moved = (entity.cast("decimal(18,0)") * F.lit(Decimal(10 * factor + 3)) + F.lit(Decimal(2 * plus + 1))).cast("decimal(38,0)") % F.lit(Decimal(10**size))
    return F.lpad(moved.cast("decimal(18,0)").cast("string"), size, "0")


def distinct_surrogates(entities: DataFrame, key: str, rounds: int = ROUNDS) -> DataFrame:
    """(kind, entity, gender, surrogate) with no surrogate twice in a kind, and none that is an entity of that kind.

    Each round draws again for those that clash: all but the first of a shared candidate, and those that are real
    entities. Candidates of names and addresses grow with the rounds. Where the corpus has more than a quarter of all
    phone or social security numbers of a length, these are moved by a one-to-one map instead, onto each other if need
    be. So more than half of what is drawn from is free, each round leaves less than about half open, and there's an
    end; a table with about half of all IP addresses and more, for which there can't be one, is refused after some rounds.
    """
    sizes = entities.where(F.col("kind").isin("phone", "ssn")).groupBy("kind", F.length("entity").alias("size")).agg(F.countDistinct("entity").alias("n"))
    # one row for each kind and length of numbers
    crowded = [(r.kind, r.size) for r in sizes.collect() if r.size <= 15 and r.n > 10**r.size // 4]
    real = entities.select("kind", F.col("entity").alias("surrogate")).distinct()
    placed: DataFrame | None = None
    open_rows = entities.withColumn("attempt", F.lit(0))
    for kind, size in crowded:
        here = (F.col("kind") == kind) & (F.length("entity") == size)
        moved = open_rows.where(here).select("kind", "entity", "gender", shuffled(F.col("entity"), size, key).alias("surrogate"))
        placed, open_rows = moved if placed is None else placed.unionByName(moved), open_rows.where(~here)
    for _ in range(rounds):
        tried = open_rows.withColumn("surrogate", surrogate(F.col("kind"), F.col("entity"), F.col("gender"), key, F.col("attempt")))
        first = tried.groupBy("kind", "surrogate").agg(F.min("entity").alias("first"))
        taken = real.withColumn("taken", F.lit(True))
        if placed is not None:
            taken = taken.unionByName(placed.select("kind", "surrogate", F.lit(True).alias("taken"))).distinct()
        judged = pinned(tried.join(first, ["kind", "surrogate"]).join(taken, ["kind", "surrogate"], "left").withColumn("good", (F.col("entity") == F.col("first")) & F.col("taken").isNull()))
        done = judged.where("good").select("kind", "entity", "gender", "surrogate")
        placed = done if placed is None else placed.unionByName(done)
        open_rows = judged.where("NOT good").select("kind", "entity", "gender", (F.col("attempt") + 1).alias("attempt"))
        if not open_rows.take(1):
            return placed
    raise ValueError(f"SURROGATES_EXHAUSTED: {[r.kind for r in open_rows.select('kind').distinct().collect()]}")


def in_format(kind: Column, value: Column, new: Column) -> Column:
    """The surrogate written as the mention is: its separators, its title, its capitals."""

    def place(acc: Column, c: Column) -> Column:
        taken = F.substring(new, F.length(new) - acc["n"], F.lit(1))
        # a country's code, which stands before what the entity has, is kept
        signs = c.rlike("[0-9A-Z]") & (acc["n"] < F.length(new))
        return F.struct((acc["n"] + signs.cast("int")).alias("n"), F.concat(F.when(signs, taken).otherwise(c), acc["out"]).alias("out"))

    chars = F.reverse(F.filter(F.split(value, ""), lambda c: c != ""))
    spaced = F.aggregate(chars, F.struct(F.lit(0).alias("n"), F.lit("").alias("out")), place, lambda acc: acc["out"])
    all_capitals = (value == F.upper(value)) & (value != F.lower(value))
    # the letter at the place of a capital is a capital
    capitals = F.array_join(F.transform(F.filter(F.split(new, ""), lambda c: c != ""), lambda c, i: F.when(F.substring(value, i + 1, F.lit(1)).rlike("[A-Z]"), F.upper(c)).otherwise(c)), "")
    return (
        F.when(kind.isin("card", "phone", "ssn", "iban"), spaced)
        .when(kind == "name", F.concat(F.regexp_extract(value, r"^(\S+ )", 1), new))
        .when(kind == "email", F.when(all_capitals, F.upper(new)).otherwise(capitals))
        .otherwise(new)
    )


def mentions(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row for each match of the pattern in the texts, with the entities that it names; those that aren't entities have a null kind."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")).withColumn("text_key", F.xxhash64("text"))
    # all kinds but names have a digit or an @
    found = rows.withColumn("m", F.when(F.col("text").rlike("[0-9@]"), matched("text", PATTERN)).otherwise(matched("text", NAME))).where(F.size("m") > 0)
    out = found.select("doc_id", "text_key", F.posexplode("m").alias("n", "m")).select("doc_id", "text_key", "n", F.col("m.value").alias("value"))
    kind = kind_of(F.col("value"))
    out = out.withColumn("kind", kind).withColumn("kind", F.when(is_entity(F.col("kind"), F.col("value")), F.col("kind")))
    words = F.split(F.regexp_extract("value", r"^\S+ (.*)$", 1), " ")
    family = F.struct(F.lit(1).alias("part"), F.lit("family").alias("of"), F.element_at(words, -1).alias("entity"))
    given = F.struct(F.lit(0).alias("part"), F.lit("given").alias("of"), F.element_at(words, 1).alias("entity"))
    other = F.struct(F.lit(0).alias("part"), F.col("kind").alias("of"), normal_form(F.col("kind"), F.col("value")).alias("entity"))
    domain = F.struct(F.lit(1).alias("part"), F.lit("domain").alias("of"), F.lower(F.substring_index("value", "@", -1)).alias("entity"))
    of_name = F.when(F.size(words) > 1, F.array(given, family)).otherwise(F.array(family))
    parts = F.when(F.col("kind") == "name", of_name).when(F.col("kind") == "email", F.array(other, domain)).otherwise(F.array(other))
    return out.select("*", F.explode(parts).alias("p")).select("doc_id", "text_key", "n", "value", "kind", "p.*", F.when(F.col("kind") == "name", gender_of(F.col("value"))).otherwise("any").alias("gender"))


def with_surrogates(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with every entity replaced in the text, and `n_entities`; all rows and other columns are kept.

    A null text stays null and has no entities. Rows of one id with different texts are handled apart, repeated rows
    alike, null ids like others. An empty table stays empty. A column of docs named n_entities is replaced. Names are
    found by a title; in a text that has one, the same names without a title are replaced, too, but aren't counted.
    """
    id_, text_key, mentioned, names = fresh(docs, "id", "key", "new", "known")
    # one row for each text: repeated rows share their mentions
    found = pinned(mentions(docs, id_col, text_col).dropDuplicates(["doc_id", "text_key", "n", "part"]))
    hits = found.where("kind IS NOT NULL").withColumn("_entity", F.concat_ws(":", "of", "entity"))
    # a person's gender is the one that a title says, if any does
    entities = pinned(hits.groupBy(F.col("of").alias("kind"), "entity").agg(F.max(F.when(F.col("gender") != "any", F.col("gender"))).alias("gender"), F.count("*").alias("_n")))
    drawn = distinct_surrogates(entities.select("kind", "entity", F.coalesce("gender", F.lit("any")).alias("gender")), key)
    table = pinned(drawn.join(entities.select("kind", "entity", "_n"), ["kind", "entity"]).select(F.concat_ws(":", "kind", "entity").alias("_entity"), "surrogate", "_n"))
    named = joined_by_weight(hits, table, "_entity", "_n").select("doc_id", "text_key", "n", "value", "kind", "part", "entity", "surrogate")
    rows = named.unionByName(found.where("kind IS NULL").select("doc_id", "text_key", "n", "value", "kind", "part", "entity", F.lit(None).cast("string").alias("surrogate")))
    # a name's parts make one mention again
    parts = F.sort_array(F.collect_list(F.struct("part", "entity", "surrogate")))
    whole = rows.groupBy("doc_id", "text_key", "n").agg(F.first("value").alias("value"), F.first("kind").alias("kind"), parts.alias("parts"))
    joint = lambda name: F.array_join(F.transform("parts", lambda p: p[name]), " ")
    drawn_part = lambda k: F.get("parts", F.lit(k))["surrogate"]
    address = F.concat(F.substring_index(drawn_part(0), "@", 1), F.lit("@"), drawn_part(1))
    replaced = F.when(F.col("kind") == "email", address).otherwise(joint("surrogate"))
    new = F.when(F.col("kind").isNotNull(), in_format(F.col("kind"), F.col("value"), replaced)).otherwise(F.col("value"))
    last = F.element_at("parts", -1)
    known = F.when(F.col("kind") == "name", F.array(F.struct(joint("entity").alias("old"), joint("surrogate").alias("new")), F.struct(last["entity"].alias("old"), last["surrogate"].alias("new"))))
    listed = whole.select("doc_id", "text_key", F.struct("n", new.alias("new"), F.col("kind").isNotNull().alias("hit")).alias("r"), known.alias("known"))
    lists = listed.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_list("r")).alias(mentioned), F.array_distinct(F.flatten(F.collect_list("known"))).alias(names))
    lists = lists.withColumnsRenamed({"doc_id": id_, "text_key": text_key}).withColumn(names, F.array_sort(names, lambda a, b: F.length(b["old"]) - F.length(a["old"])))
    kept = [c for c in docs.columns if c != "n_entities"]
    joined = docs.select(*kept).join(lists, docs[id_col].eqNullSafe(F.col(id_)) & (F.xxhash64(text_or_empty(text_col)) == F.col(text_key)), "left")

    def without_names(piece: Column) -> Column:
        replaced = F.aggregate(names, piece, lambda acc, k: F.regexp_replace(acc, F.concat(F.lit(r"(?<![\p{L}\p{N}-])"), k["old"], F.lit(r"(?![\p{L}\p{N}-])")), k["new"]))
        return F.when(F.size(names) > 0, replaced).otherwise(piece)

    pieces = F.split(text_col, PATTERN, -1)
    rebuilt = F.array_join(F.zip_with(pieces, F.transform(mentioned, lambda r: r["new"]), lambda p, r: F.concat(without_names(p), F.coalesce(r, F.lit("")))), "")
    out = joined.withColumn(text_col, F.when(F.col(mentioned).isNull(), F.col(text_col)).otherwise(rebuilt))
    out = out.withColumn("n_entities", F.coalesce(F.size(F.filter(mentioned, lambda r: r["hit"])), F.lit(0)).cast("long"))
    return out.select(*kept, "n_entities")
