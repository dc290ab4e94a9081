r"""PII: detected entities get keyed surrogates of the same type, format, script and gender. Spark functions only.

Entities: e-mail addresses, IPv4 addresses, payment card numbers, phone numbers, US social security
numbers, IBANs, hexadecimal or prefixed secrets, MAC addresses, and persons named after a title.

A surrogate depends on a key, the type and the normalised value (digits of a number, lower case of an
address), so one entity reads the same wherever it stands, in any document and in any spelling. It
keeps the shape: digits become digits, letters letters of the same case and script, punctuation stays;
IPv4 octets stay octets of as many digits, cards keep their first digit and pass or fail the Luhn test
as before, phones keep the country code, e-mail addresses the last label of their domain. A person's
title gives the gender of the first name; the surname maps alike with or without a first name, and
later mentions by surname alone in the same document follow it. A first name and its gender are an entity of
their own, so that two persons of one surname stay two. A phone's digits are drawn once, from the number with its
country code (1 where it is written without), and poured into each spelling.

Collisions. The distinct entities of all documents are listed; where two of a type would get one
surrogate, or a surrogate is itself an entity of the documents, all but the smallest draw again with the
next attempt number; who has a surrogate keeps it and is not computed again. From attempt `WIDEN` on, which
only entities of a nearly full shape reach (as when all 6561 addresses of four single digits occur), the
shape widens with every attempt: octets of any length, a further digit, letter or syllable. So room never
ends and the rounds do. Attempts above 0 are kept as a table of exceptions and joined to the documents that
hold such entities; everything else is computed in place without a shuffle of texts.

Defined results: a null text stays null with no entities; a text without entities is returned as it is;
repeated rows and ids are rows of their own and read alike; of entities that draw the same surrogate the
smallest in order of code points keeps it; texts of any length are rewritten whole; an empty table gives no
rows. Other columns pass through, also those of the names used here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm.common import discard, materialize, own, row_key, table

KEY = "keyloom"
#: The attempt from which a shape is no longer kept.
WIDEN = 6

# Titles by gender.
TITLES = {"f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "госпожа"], "m": ["Mr", "Herr", "Monsieur", "Señor", "Sr", "господин"]}
# First names by script and gender, and syllables of surnames by script.
FIRST_NAMES = {
    ("latin", "f"): "Anna Clara Elena Emma Eva Ida Julia Laura Lena Lucia Maria Marta Nina Nora Paula Rosa Sara Silvia Sofia Vera".split(),
    ("latin", "m"): "Adam Bruno Daniel David Emil Felix Hugo Ivan Jonas Leo Lukas Marco Martin Max Oscar Paul Peter Simon Thomas Victor".split(),
    ("cyrillic", "f"): "Анна Вера Дарья Елена Ирина Мария Нина Ольга Софья Юлия".split(),
    ("cyrillic", "m"): "Антон Борис Виктор Иван Лев Максим Олег Павел Роман Юрий".split(),
}
SYLLABLES = {"latin": "ba be bo da de do fa fe ga go ka ke la le lo ma me mo na ne no pa po ra re ro sa se ta te to va vo".split(), "cyrillic": "ба бе бо ва ве во га го да де до ка ко ла ле ма ме мо на не но па по ра ре ро са та то".split()}
# Letters that stand in for letters outside a-z of the same script.
LETTERS = {"accented": "àâäçèéêëîïñóôöùûü", "greek": "αβγδεζηθικλμνξοπρστυφχψω", "cyrillic": "абвгдежзиклмнопрстуфхцчшэюя"}

# How a first name of syllables ends, by script and gender.
ENDINGS = {("latin", "f"): "na", ("latin", "m"): "n", ("cyrillic", "f"): "на", ("cyrillic", "m"): "н"}
#: Country codes at the beginning of a number.
COUNTRY = r"^(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"

OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
# What a type looks like, the first that fits a match names its type.
TYPES = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)*\.\p{L}{2,}+",
    "mac": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}(?![0-9A-Fa-f:])",
    "secret": r"(?<![\p{L}\p{N}])(?:[0-9a-f]{32,}+|(?:sk|pk|ghp|gho|AKIA|xoxb)[-_A-Za-z0-9]{16,}+)(?![\p{L}\p{N}])",
    "ip": rf"(?<![\d.])(?:{OCTET}\.){{3}}{OCTET}(?!\.?\d)",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "card": r"(?<![\d+(-])(?:\d{4}([ -])\d{4}\1\d{4}\1\d{4}|\d{13,19})(?!\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\p{L}\p{N}+])(?:\+\d{1,3}[ .-]?(?:\(\d{2,4}\)|\d{2,4})(?:[ .-]?\d{2,4}){2,4}|(?:\(\d{3}\) ?|\d{3}-)\d{3}-\d{4})(?!\d)",
    "person": r"(?<!\p{L})(?:" + "|".join(t for g in "fm" for t in TITLES[g]) + r")\.? \p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)?(?!\p{L})",
}
# What the first character of a type may be: tried before anything else, for speed only.
FIRST = {"mac": "[0-9A-Fa-f]", "secret": "[0-9a-fpgsxA]", "ip": r"\d", "iban": "[A-Z]", "card": r"\d", "ssn": r"\d", "phone": r"[\d+(]", "person": r"[\p{Lu}г]"}
#: Any entity; back references count groups over the whole pattern, and only cards have one.
ANY = "|".join(f"(?={FIRST[k]})(?:{p})" if k in FIRST else f"(?:{p})" for k, p in TYPES.items())


def may_hold(text: Column) -> Column:
    """False only where no type can match: cheaper than looking for all of them."""
    titles = "|".join(t for g in "fm" for t in TITLES[g])
    some = text.contains("@") | text.rlike(r"[0-9](?:[0-9](?:[0-9]|-)|\.[0-9]+\.[0-9])|[0-9A-Z][0-9]{2}")
    return some | text.rlike(r"\+[0-9]") | text.rlike(":[0-9A-Fa-f]{2}:") | text.rlike("[0-9a-f]{32}") | text.rlike("(?:sk|pk|ghp|gho|AKIA|xoxb)[-_A-Za-z0-9]{16}") | text.rlike(rf"(?=[\p{{Lu}}г])(?:{titles})\.? \p{{Lu}}")


def all_matches(text: Column) -> Column:
    none = F.array().cast("array<string>")
    return F.when(may_hold(text), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(none)


def lit(x: str) -> Column:
    return F.lit(x)


def type_of(value: Column) -> Column:
    out = lit("person")
    for name, pattern in reversed(list(TYPES.items())[:-1]):
        out = F.when(value.rlike(f"^(?:{pattern})$"), name).otherwise(out)
    return out


def normal(kind: Column, value: Column) -> Column:
    """What stands for an entity in any spelling; for persons the surname."""
    digits = F.regexp_replace(value, r"\D", "")
    return (
        F.when(kind.isin("card", "ssn"), digits)
        .when(kind == "phone", F.when(value.startswith("+"), digits).otherwise(F.concat(lit("1"), digits)))
        .when(kind.isin("email", "mac"), F.lower(value))
        .when(kind == "iban", F.regexp_replace(value, " ", ""))
        .when(kind == "person", F.regexp_extract(value, r"(\S+)$", 1))
        .otherwise(value)
    )


def digest(key: str, kind: Column, name: Column, attempt: Column) -> Column:
    """128 hexadecimal digits: the draws of an entity's surrogate."""
    return F.sha2(F.concat_ws("|", lit(key), kind, name, attempt.cast("string")), 512)


def draw(digits: Column, k: Column) -> Column:
    """The k-th draw, 0 to 65535."""
    return F.conv(F.substring(digits, (k * 3 % 124 + 1).cast("int"), F.lit(4)), 16, 10).cast("int")


def pick(letters: str, r: Column) -> Column:
    return F.substring(lit(letters), (r % len(letters) + 1).cast("int"), F.lit(1))


def reshaped(value: Column, digits: Column, hexadecimal: Column) -> Column:
    """Every digit and letter drawn anew within its class (hexadecimal: among hexadecimal digits); all else stays."""

    def step(s: Column, c: Column) -> Column:
        # once for each character: its draw and lower case, then the new character, then the sum
        one = F.transform(F.array(F.struct(draw(digits, s["k"]).alias("r"), F.lower(c).alias("low"))), lambda x: F.when(c == x["low"], other(c, x["low"], x["r"])).otherwise(F.upper(other(c, x["low"], x["r"]))))
        return F.transform(one, lambda n: F.struct(F.concat(s["out"], F.coalesce(n, c)).alias("out"), (s["k"] + F.when(n.isNull(), 0).otherwise(1)).alias("k")))[0]

    def other(c: Column, low: Column, r: Column) -> Column:
        new = F.when(hexadecimal, F.when(low.rlike("[0-9a-f]"), pick("0123456789abcdef", r)))
        new = new.when(low.rlike("[0-9]"), pick("0123456789", r)).when(low.rlike("[a-z]"), pick("abcdefghijklmnopqrstuvwxyz", r))
        return new.when(low.rlike(r"\p{IsGreek}"), pick(LETTERS["greek"], r)).when(low.rlike(r"\p{IsCyrillic}"), pick(LETTERS["cyrillic"], r)).when(low.rlike(r"\p{IsLatin}"), pick(LETTERS["accented"], r))

    return F.aggregate(F.split(value, ""), F.struct(lit("").alias("out"), F.lit(0).alias("k")), step, lambda s: s["out"])


def luhn(value: Column) -> Column:
    """The Luhn sum of the digits of value, modulo 10."""
    back = F.split(F.reverse(F.regexp_replace(value, r"\D", "")), "")
    each = F.transform(back, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)))
    return F.aggregate(each, F.lit(0), lambda a, b: a + b) % 10


def card(head: Column, value: Column, digits: Column) -> Column:
    """head with a last digit that makes the Luhn sum pass if that of value does, and fail if it doesn't."""
    passes = (10 - luhn(F.concat(head, lit("0")))) % 10
    return F.concat(head, ((passes + F.when(luhn(value) == 0, 0).otherwise(1 + draw(digits, F.lit(30)) % 9)) % 10).cast("string"))


def wider(attempt: Column) -> Column:
    """How far the shape has widened: 0 below WIDEN, then one more with each attempt."""
    return F.greatest(F.lit(0), attempt - (WIDEN - 1))


def syllables(script: str, digits: Column, n: int, attempt: Column) -> Column:
    table_ = F.array(*map(F.lit, SYLLABLES[script]))
    return F.initcap(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(n - 1) + wider(attempt)), lambda k: F.element_at(table_, draw(digits, k) % len(SYLLABLES[script]) + 1)), ""))


def surname(name: Column, digits: Column, attempt: Column) -> Column:
    return F.when(name.rlike(r"\p{IsCyrillic}"), syllables("cyrillic", digits, 4, attempt)).otherwise(syllables("latin", digits, 4, attempt))


def first_of(value: Column) -> Column:
    """Gender and first name of a person, as f|Anna; null where the first name is missing."""
    title, first = (F.regexp_extract(value, r"^(\S+) (?:(\S+) )?(\S+)$", i) for i in (1, 2))
    return F.when(first != "", F.concat(F.when(F.regexp_replace(title, r"\.$", "").isin(TITLES["f"]), "f|").otherwise("m|"), first))


def first_name(name: Column, digits: Column, attempt: Column) -> Column:
    """A name of the gender and script of name (as f|Anna), in the same form: first from the lists, then of syllables."""

    def of(script: str, gender: str) -> Column:
        known = FIRST_NAMES[script, gender]
        one = F.element_at(F.array(*map(F.lit, known)), draw(digits, F.lit(0)) % len(known) + 1)
        return F.when(attempt == 0, one).otherwise(F.concat(syllables(script, digits, 3, attempt), lit(ENDINGS[script, gender])))

    def either(script: str) -> Column:
        return F.when(name.startswith("f"), of(script, "f")).otherwise(of(script, "m"))

    return F.concat(F.substring(name, 1, 2), F.when(name.rlike(r"\p{IsCyrillic}"), either("cyrillic")).otherwise(either("latin")))


def person(value: Column, digits: Column, attempt: Column, key: str, again: Column) -> Column:
    """Title kept, the first name's surrogate (its attempt is `again`) and the surname's."""
    title, last = (F.regexp_extract(value, r"^(\S+) (?:(\S+) )?(\S+)$", i) for i in (1, 3))
    first = first_of(value)
    new = F.substring(first_name(first, digest(key, lit("first"), first, again), again), 3, 1000)
    return F.concat_ws(" ", title, new, surname(last, digits, attempt))


def phone(value: Column, name: Column, digits: Column, attempt: Column) -> Column:
    """The number's digits drawn anew behind the country code, poured into the spelling of value; digits beyond it stand at the end."""
    code = F.regexp_extract(name, COUNTRY, 1)
    rest = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(name) - F.length(code) + wider(attempt))), lambda k: pick("0123456789", draw(digits, k)))
    number = F.concat(code, F.array_join(rest, ""))
    number = F.when(value.startswith("+"), number).otherwise(F.substring(number, 2, 1000))
    start = F.struct(lit("").alias("out"), number.alias("left"))

    def step(s: Column, c: Column) -> Column:
        digit = c.rlike("[0-9]")
        return F.struct(F.concat(s["out"], F.when(digit, F.substring(s["left"], 1, 1)).otherwise(c)).alias("out"), F.when(digit, F.substring(s["left"], 2, 1000)).otherwise(s["left"]).alias("left"))

    return F.aggregate(F.split(value, ""), start, step, lambda s: F.concat(s["out"], s["left"]))


def more(entities: Column, **fields) -> Column:
    """An array of structs with further fields, each computed from the struct."""
    return F.transform(entities, lambda x: F.struct(*[x[f].alias(f) for f in fields["have"]], *[fn(x).alias(name) for name, fn in fields.items() if name != "have"]))


def typed(values: Column) -> Column:
    """array of values -> array of (value, kind, name)."""
    kinds = F.transform(values, lambda v: F.struct(v.alias("value"), type_of(v).alias("kind")))
    return more(kinds, have=["value", "kind"], name=lambda x: normal(x["kind"], x["value"]))


def with_firsts(entities: Column) -> Column:
    """array of (value, kind, name) and the first names among them, of kind first."""
    people = F.filter(entities, lambda x: (x["kind"] == "person") & first_of(x["value"]).isNotNull())
    return F.concat(entities, F.transform(people, lambda x: F.struct(first_of(x["value"]).alias("value"), lit("first").alias("kind"), first_of(x["value"]).alias("name"))))


def surrogates(entities: Column, key: str) -> Column:
    """array of (value, kind, name, attempt, again: the attempt of a person's first name) -> array of (type, surrogate); a step for each thing that others use twice."""

    def before(x: Column) -> Column:
        """What stays of the beginning: a secret's prefix, a card's first digit."""
        v = x["value"]
        return F.when(x["kind"] == "secret", F.regexp_extract(v, "^(sk|pk|ghp|gho|AKIA|xoxb)(?=[-_A-Za-z0-9]*[^0-9a-f])", 0)).when(x["kind"] == "iban", F.substring(v, 1, 2)).when(x["kind"] == "card", F.substring(v, 1, 1)).otherwise("")

    def after(x: Column) -> Column:
        """What is kept of the end, or made afterwards: the last label of a domain, a card's last digit."""
        return F.when(x["kind"] == "email", F.regexp_extract(x["value"], r"(\.\p{L}+)$", 1)).when(x["kind"] == "card", F.substring(x["value"], -1, 1)).otherwise("")

    def octets(x: Column) -> Column:
        any_length = x["attempt"] >= WIDEN
        one = lambda o, i: F.when(any_length, draw(x["d"], i * 2) % 256).when(F.length(o) == 3, 100 + draw(x["d"], i * 2) % 156).when(F.length(o) == 2, 10 + draw(x["d"], i * 2) % 90).otherwise(1 + draw(x["d"], i * 2) % 9)
        return F.array_join(F.transform(F.split(x["value"], r"\."), lambda o, i: one(o, i).cast("string")), ".")

    def core(x: Column) -> Column:
        body = F.substring(x["value"], F.length(x["before"]) + 1, F.length(x["value"]) - F.length(x["before"]) - F.length(x["after"]))
        hexadecimal = (x["kind"] == "mac") | ((x["kind"] == "secret") & (x["before"] == ""))
        body = F.when(x["kind"] == "mac", F.lower(body)).otherwise(body)
        digit_more = F.concat(body, F.repeat(lit("0"), wider(x["attempt"])))
        body = F.when(x["kind"].isin("ssn", "card", "iban", "secret"), digit_more).when(x["kind"] == "mac", F.concat(body, F.repeat(lit(":00"), wider(x["attempt"])))).when(x["kind"] == "email", F.concat(F.repeat(lit("a"), wider(x["attempt"])), body)).otherwise(body)
        new = F.concat(x["before"], reshaped(body, x["d"], hexadecimal))
        new = F.when((x["kind"] == "mac") & (x["value"] == F.upper(x["value"])), F.upper(new)).otherwise(new)
        return F.when(x["kind"] == "ip", octets(x)).when(x["kind"] == "person", person(x["value"], x["d"], x["attempt"], key, x["again"])).when(x["kind"] == "first", first_name(x["value"], x["d"], x["attempt"])).when(x["kind"] == "phone", phone(x["value"], x["name"], x["d"], x["attempt"])).otherwise(new)

    have = ["value", "kind", "name", "attempt", "again"]
    step = more(entities, have=have, d=lambda x: digest(key, x["kind"], x["name"], x["attempt"]))
    step = more(step, have=[*have, "d"], before=before, after=after)
    step = more(step, have=[*have, "d", "after"], core=core)
    return F.transform(step, lambda x: F.struct(x["kind"].alias("type"), F.when(x["kind"] == "card", card(x["core"], x["value"], x["d"])).when(x["kind"] == "email", F.concat(x["core"], x["after"])).otherwise(x["core"]).alias("surrogate")))


def exceptions(matches: DataFrame, key: str) -> DataFrame:
    """(kind, name, attempt) of the entities whose first draw collides; matches: value."""
    entity = matches.select("value").distinct().select(F.inline(with_firsts(typed(F.array("value"))))).groupBy("kind", "name").agg(F.min("value").alias("value"))
    real = materialize(entity.withColumn("attempt", F.lit(0)), "entities")
    open_, settled = real, []
    while True:
        one = F.array(F.struct("value", "kind", "name", "attempt", F.lit(0).alias("again")))
        drawn = open_.select("*", surrogates(one, key)[0]["surrogate"].alias("s")).withColumn("drawn", normal(F.col("kind"), F.col("s"))).drop("s")
        drawn = materialize(drawn, "drawn")
        first = drawn.groupBy("kind", "drawn").agg(F.min("name").alias("first"))
        taken = real.select("kind", F.col("name").alias("drawn"))
        for part in settled:
            taken = taken.union(part.select("kind", "drawn"))
        free = first.join(taken, ["kind", "drawn"], "left_anti").select("kind", "drawn", F.col("first").alias("name"), F.lit(True).alias("free"))
        checked = materialize(drawn.join(free, ["kind", "drawn", "name"], "left"), "checked")
        settled.append(checked.where("free").drop("free"))
        rest = checked.where("free is null").select("kind", "name", "value", (F.col("attempt") + 1).alias("attempt"))
        discard(drawn)
        if rest.isEmpty():
            break
        open_ = rest
    out = real.where("false").select("kind", "name", "attempt")
    for part in settled:
        out = out.union(part.where("attempt > 0").select("kind", "name", "attempt"))
    return out


def replace(documents: DataFrame, key: str = KEY) -> DataFrame:
    """All columns of documents, `text` rewritten, and `found`: the (type, surrogate) of each entity in order."""
    names = [f"c{i}" for i in range(len(documents.columns))]  # any column names, clashing ones too
    docs = documents.toDF(*names)
    text = F.col(names[documents.columns.index("text")])
    odd = exceptions(documents.select(F.explode(all_matches(F.col("text"))).alias("value")), key)
    docs = docs.select("*", all_matches(text).alias("m"))
    attempts = F.lit(None).cast("map<string,int>")
    if not odd.isEmpty():
        docs = docs.withColumn("h", row_key(*names))
        held = docs.where(F.size("m") > 0).select("h", F.inline(with_firsts(typed(F.col("m")))))
        held = held.join(odd, ["kind", "name"]).select("h", F.concat_ws("|", "kind", "name").alias("entity"), "attempt").distinct()
        held = materialize(held.groupBy("h").agg(F.map_from_entries(F.collect_set(F.struct("entity", "attempt"))).alias("odd")), "exceptions")
        docs = docs.join(held, "h", "left").drop("h")
        attempts = F.col("odd")

    number = lambda x: F.coalesce(F.try_element_at(attempts, F.concat_ws("|", x["kind"], x["name"])), F.lit(0))
    again = lambda x: F.coalesce(F.try_element_at(attempts, F.concat(lit("first|"), first_of(x["value"]))), F.lit(0))
    entities = more(typed(F.col("m")), have=["value", "kind", "name"], attempt=number, again=again)
    none = F.expr("cast(array() as array<struct<type:string,surrogate:string>>)")
    docs = docs.select("*", F.when(F.size("m") > 0, surrogates(entities, key)).otherwise(none).alias("found"))
    pieces = F.split(text, ANY, -1)
    rebuilt = F.concat(F.array_join(F.zip_with(F.slice(pieces, F.lit(1), F.size("m")), "found", lambda p, f: F.concat(p, f["surrogate"])), ""), F.element_at(pieces, -1))
    # surnames that stand alone later on follow the person of the document
    people = F.filter(F.arrays_zip("m", "found"), lambda x: x["found"]["type"] == "person")
    mention = F.array_distinct(F.transform(people, lambda x: F.struct(F.regexp_extract(x["m"], r"(\S+)$", 1).alias("old"), F.regexp_extract(x["found"]["surrogate"], r"(\S+)$", 1).alias("new"))))
    followed = F.aggregate(mention, rebuilt, lambda t, x: F.regexp_replace(t, F.concat(lit(r"(?<!\p{L})"), x["old"], lit(r"(?!\p{L})")), x["new"]))
    new = F.when(F.size("m") == 0, text).when(F.size(people) > 0, followed).otherwise(rebuilt)
    out = docs.select(*[new.alias(n) if c == "text" else F.col(n) for n, c in zip(names, documents.columns)], "found")
    return out.toDF(*documents.columns, "found")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = replace(own(table(spark, sf_dir, "documents"), "doc_id", "text"))
    return out.select("doc_id", "text", F.size("found").cast("long").alias("n_entities"), "found")
