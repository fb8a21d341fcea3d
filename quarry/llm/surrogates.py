"""Operator 8: surrogates for personal data, in DataFrame functions only.

Entities are found by patterns. Each distinct entity (in a normal form, so that spellings of one phone number are
one entity) gets a surrogate drawn from a keyed hash: characters keep their class, cards their check digit, e-mail
addresses their top-level domain, names their title, gender, script and number of words. Surrogates that meet another
entity's, or a real entity, are drawn again until none does, so distinct entities stay distinct and equal ones equal
across the whole corpus. Names grow by a syllable with each attempt, so theirs never run out; e-mail addresses and
secrets grow after FIXED_LENGTH attempts. Numbers keep their length: where a format holds too few values for its
entities, the run fails after MAX_ATTEMPTS and says so. A secret has a letter or digit.

Defined results: a null text stays null and an empty one empty, with no entities; repeated rows get the same text;
rows without doc_id are rewritten like others; an empty table gives an empty table; extra columns are ignored.
Texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import let, read, written

#: Titles by gender.
MALE = ("Mr", "Herr", "Señor", "Monsieur", "Господин")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Señora", "Señorita", "Madame", "Mademoiselle", "Госпожа")

_NAME = r"\p{Lu}\p{Ll}+"
# each pattern starts with a cheap look at the characters ahead, so that most places fail at once
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "key": r"(?=A[KS]IA)(?<![A-Za-z0-9])A[KS]IA[A-Z0-9]{16}(?![A-Za-z0-9])",
    "secret": r"(?<=[=: \"'])(?=[A-Za-z0-9+/_-]{8})(?=[+/_-]*[A-Za-z0-9])(?<=(?i:token|password|passwd|secret|api_key|apikey)[ ]{0,2}[=:][ ]{0,2}[\"']?)[A-Za-z0-9+/_-]{8,}",
    "ip": r"(?=[0-9]{1,3}\.)(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9])",
    "phone": r"(?=[0-9+(])(?<![0-9+])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ .-]?[0-9]{2,4}){2,4}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![0-9])",
    "ssn": r"(?=[0-9]{3}-)(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?=[0-9])(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])",
    "iban": r"(?=[A-Z]{2}[0-9])(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "person": rf"(?=[MHSFГ])(?<!\p{{L}})(?:{'|'.join(MALE + FEMALE)})\.? {_NAME}(?: {_NAME})?",
}
ENTITY = "|".join(f"(?:{p})" for p in PATTERNS.values())

#: Syllables of surrogate names by script, and their endings by gender.
SYLLABLES = {"latin": ("ba", "ren", "lo", "mi", "ta", "vel", "sor", "ki", "dan", "re", "nu", "sa", "te", "mar", "li", "on"), "cyrillic": ("ба", "рен", "ло", "ми", "та", "вел", "сор", "ки", "дан", "ре", "ну", "са", "те", "мар", "ли", "он")}
ENDINGS = {("latin", "male"): "no", ("latin", "female"): "ra", ("cyrillic", "male"): "нов", ("cyrillic", "female"): "рина"}
#: Attempts before e-mail addresses and secrets become longer, and attempts in all.
FIXED_LENGTH = 8
MAX_ATTEMPTS = 40


def _kind(e: Column) -> Column:
    """The type of an entity, tried in the patterns' order."""
    whole = lambda p: e.rlike(f"^(?:{p})$")
    out = F.lit("secret")
    for name in reversed([n for n in PATTERNS if n != "secret"]):
        p = PATTERNS[name]
        out = F.when(whole(p), F.lit(name)).otherwise(out)
    return out


def _title(e: Column) -> Column:
    return F.regexp_extract(e, r"^\p{L}+\.? ", 0)


def _normal(kind: Column, e: Column) -> Column:
    """The form in which spellings of one entity agree."""
    digits = F.regexp_replace(e, "[^0-9]", "")
    name = F.substr(e, F.length(_title(e)) + 1)
    gender = F.when(F.regexp_extract(e, r"^\p{L}+", 0).isin(*MALE), "male").otherwise("female")
    return F.when(kind == "email", F.lower(e)).when(kind.isin("phone", "ssn", "card"), digits).when(kind == "iban", F.replace(e, F.lit(" "), F.lit(""))).when(kind == "person", F.concat(gender, F.lit(":"), name)).otherwise(e)


def _luhn(digits: Column) -> Column:
    """Luhn sum modulo 10 of an array of digit numbers."""
    n = F.size(digits)
    each = F.transform(digits, lambda d, i: F.when((n - i) % 2 == 0, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d))
    return F.aggregate(each, F.lit(0), lambda s, d: s + d) % 10


def _numbers(text: Column) -> Column:
    return F.transform(F.split(text, ""), lambda c: F.ascii(c) - 48)


def _drawn(kind: Column, norm: Column, attempt: int, key: str) -> Column:
    """The surrogate of a normal form at an attempt, in the same form; names, and later e-mails and secrets, grow with the attempts."""
    seed = F.concat_ws("\n", F.lit(key), kind, norm, F.lit(str(attempt)))

    def from_stream(stream: Column) -> Column:
        value = lambda i: F.conv(F.substr(stream, (i * 2) % 256 + 1, F.lit(2)), 16, 10).cast("int")
        letters = F.when(norm.rlike("^[0-9a-fA-F]+$"), 6).otherwise(26)
        fixed = F.when(kind == "key", 4).when(kind.isin("phone", "card"), 1).when(kind == "iban", 2).otherwise(0)
        last = F.when(kind == "email", F.length(norm) - F.length(F.substring_index(norm, ".", -1))).otherwise(F.length(norm))

        def one(c: Column, i: Column) -> Column:
            return F.when((i < fixed) | (i >= last), c).when((c >= "0") & (c <= "9"), (value(i) % 10).cast("string")).when((c >= "a") & (c <= "z"), F.char(97 + value(i) % letters)).when((c >= "A") & (c <= "Z"), F.char(65 + value(i) % letters)).otherwise(c)

        more = F.concat(F.lit(""), *[F.char(97 + value(F.lit(100 + j)) % 26) for j in range(min(20, max(0, attempt - FIXED_LENGTH)))])
        plain = F.array_join(F.transform(F.split(norm, ""), one), "")
        octets = F.array_join(F.transform(F.split(norm, r"\."), lambda _, i: (value(i) % 254 + 1).cast("string")), ".")
        checked = let(_numbers(plain), lambda d: F.concat(F.substr(plain, F.lit(1), F.length(plain) - 1), ((_last(d) + 10 - _luhn(d)) % 10).cast("string")))
        card = F.when(_luhn(_numbers(norm)) == 0, checked).otherwise(plain)

        def name(script: str, gender: str) -> Column:
            parts = F.array(*map(F.lit, SYLLABLES[script]))
            syllables = lambda w: [F.get(parts, value(w * (3 + attempt) + j) % len(SYLLABLES[script])) for j in range(3 + attempt)]
            words = F.split(F.substring_index(norm, ":", -1), " ")
            made = F.transform(words, lambda _, w: F.initcap(F.concat(*syllables(w), F.lit(ENDINGS[script, gender]))))
            return F.concat(F.lit(gender + ":"), F.array_join(made, " "))

        cyrillic, male = norm.rlike(r"\p{IsCyrillic}"), norm.startswith("male:")
        person = F.when(cyrillic & male, name("cyrillic", "male")).when(cyrillic, name("cyrillic", "female")).when(male, name("latin", "male")).otherwise(name("latin", "female"))
        return F.when(kind == "person", person).when(kind == "ip", octets).when(kind == "card", card).when(kind.isin("email", "secret"), F.concat(more, plain)).otherwise(plain)

    stream = F.concat(F.sha2(F.concat(seed, F.lit("\n0")), 512), F.sha2(F.concat(seed, F.lit("\n1")), 512), F.lit("00"))
    return let(stream, from_stream)


def _last(d: Column) -> Column:
    return F.element_at(d, -1)


def _written_as(kind: Column, surface: Column, drawn: Column) -> Column:
    """The surrogate in the format of the surface: its separators, case and title."""
    step = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))
    filled = F.aggregate(
        F.split(surface, ""),
        step,
        lambda s, c: F.when((c >= "0") & (c <= "9") | c.rlike("^[A-Za-z]$"), F.struct(F.concat(s["out"], F.substr(drawn, s["at"], F.lit(1))).alias("out"), (s["at"] + 1).alias("at"))).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["at"].alias("at"))),
        lambda s: s["out"],
    )
    cased = F.array_join(F.zip_with(F.split(surface, ""), F.split(drawn, ""), lambda a, b: F.when((a >= "A") & (a <= "Z"), F.upper(b)).otherwise(b)), "")
    return F.when(kind.isin("phone", "ssn", "card", "iban"), filled).when(kind == "email", cased).when(kind == "person", F.concat(_title(surface), F.substring_index(drawn, ":", -1))).otherwise(drawn)


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(kind, norm, drawn) for the distinct (kind, norm): no two alike, none a real entity of its kind."""
    real = written(entities.select("kind", "norm").distinct(), "entities")
    attempt, todo, done = 0, real, None
    while True:
        drawn = todo.withColumn("drawn", _drawn(F.col("kind"), F.col("norm"), attempt, key))
        known = drawn if done is None else done.union(drawn)
        owner = known.groupBy("kind", "drawn").agg(F.min("norm").alias("owner"))
        taken = real.select("kind", F.col("norm").alias("drawn"), F.lit(True).alias("taken"))
        marked = written(known.join(owner, ["kind", "drawn"]).join(taken, ["kind", "drawn"], "left").select("kind", "norm", "drawn", ((F.col("norm") == F.col("owner")) & F.col("taken").isNull()).alias("good")), "drawn")
        done, todo = marked.where("good").select("kind", "norm", "drawn"), marked.where("not good").select("kind", "norm")
        attempt += 1
        if todo.isEmpty():
            return done
        if attempt == MAX_ATTEMPTS:
            raise ValueError(f"no free surrogates for {todo.count()} entities of kinds {[r.kind for r in todo.select('kind').distinct().collect()]}: their formats hold too few values")


def _parts(norm: Column) -> Column:
    """The parts of a person's normal form, each with the gender."""
    return F.transform(F.split(F.substring_index(norm, ":", -1), " "), lambda w: F.concat(F.substring_index(norm, ":", 1), F.lit(":"), w))


def _mentions(norm: Column, drawn: Column) -> Column:
    """(real, fake) of the words by which a text may mention a person again: the surname alone, and each word of the whole name."""
    real, fake = (F.split(F.substring_index(c, ":", -1), " ") for c in (norm, drawn))
    pair = lambda a, b: F.struct(a.alias("real"), b.alias("fake"))
    name = F.array_join(real, " ")
    alone = pair(_last(real), _last(fake))
    return F.when(F.size(real) == 1, F.array(alone)).otherwise(F.array(alone, pair(F.concat(F.lit("1 "), name), fake[0]), pair(F.concat(F.lit("2 "), name), _last(fake))))


def _renamed(piece: Column) -> Column:
    """The piece with the document's names replaced where they stand without a title, and the number of mentions."""

    def of(t: Column) -> Column:
        fake = lambda k: F.get(F.col("values"), F.array_position("keys", k).cast("int") - 1)
        joined = lambda i: F.concat(F.get(t, i), F.lit(" "), F.when(F.get(t, i + 1) == " ", F.get(t, i + 2)))
        surname = lambda x, i: F.coalesce(fake(F.concat(F.lit("2 "), joined(i - 2))), fake(x))
        words = F.transform(t, lambda x, i: F.when(x.rlike(r"^\p{Lu}"), F.struct(F.coalesce(fake(F.concat(F.lit("1 "), joined(i))), surname(x, i), x).alias("text"), F.when(surname(x, i).isNotNull(), 1).otherwise(0).alias("n"))).otherwise(F.struct(x.alias("text"), F.lit(0).alias("n"))))
        return let(words, lambda w: F.struct(F.array_join(F.transform(w, lambda x: x["text"]), "").alias("text"), F.aggregate(w, F.lit(0), lambda a, x: a + x["n"]).alias("n")))

    return let(F.split(piece, r"(?<=[\p{L}\p{M}])(?![\p{L}\p{M}])|(?<![\p{L}\p{M}])(?=[\p{L}\p{M}])"), of)


def pseudonymise(docs: DataFrame, key: str = "quarry") -> DataFrame:
    """Per row of docs: doc_id, n_entities, kinds (sorted, distinct) and the text with surrogates for entities."""
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("key"))
    found = F.expr(f"regexp_extract_all(text, {_literal(ENTITY)}, 0)")
    # outer: else the optimiser searches each text again to filter on the number of matches
    hits = texts.select("doc_id", "key", F.posexplode_outer(found).alias("at", "surface")).where("surface is not null").dropDuplicates(["doc_id", "key", "at"])
    hits = written(hits.withColumn("kind", _kind(F.col("surface"))).withColumn("norm", _normal(F.col("kind"), F.col("surface"))), "hits")
    # a person's name is drawn part by part, so that mentions with one surname agree
    parts = F.when(F.col("kind") == "person", _parts(F.col("norm"))).otherwise(F.array("norm"))
    hits = hits.withColumn("first", parts[0]).withColumn("second", F.get(parts, F.lit(1)))
    drawn = surrogates(hits.select("kind", F.explode(parts).alias("norm")), key)
    second = drawn.select(F.col("kind").alias("_kind"), F.col("norm").alias("second"), F.substring_index("drawn", ":", -1).alias("drawn2"))
    met = hits.join(drawn.withColumnRenamed("norm", "first"), ["kind", "first"])
    one, two = (met.where(c) for c in ("second is null", "second is not null"))
    met = one.withColumn("drawn2", F.lit(None).cast("string")).unionByName(two.join(second, (F.col("kind") == F.col("_kind")) & (two["second"] == second["second"])).drop("_kind").drop(second["second"]))
    whole = F.concat_ws(" ", "drawn", "drawn2")
    named = met.select("doc_id", "key", F.struct("at", _written_as(F.col("kind"), F.col("surface"), whole).alias("text"), "kind", F.when(F.col("kind") == "person", _mentions(F.col("norm"), whole)).otherwise(F.expr("cast(array() as array<struct<real: string, fake: string>>)")).alias("names")).alias("e"))
    # bounded by the document: its own entities, in order
    per_doc = named.groupBy("doc_id", "key").agg(F.array_sort(F.collect_list("e")).alias("es")).select(F.col("doc_id").alias("_d"), F.col("key").alias("_k"), "es")
    met = texts.join(per_doc, (F.col("key") == F.col("_k")) & F.col("doc_id").eqNullSafe(F.col("_d")), "left")
    pieces = F.split("text", ENTITY, -1)
    names = F.flatten(F.transform("es", lambda e: e["names"]))
    met = met.withColumn("keys", F.transform(names, lambda n: n["real"])).withColumn("values", F.transform(names, lambda n: n["fake"]))
    rest = F.when(F.size("keys") > 0, F.transform(pieces, _renamed)).otherwise(F.transform(pieces, lambda x: F.struct(x.alias("text"), F.lit(0).alias("n"))))
    met = met.withColumn("rest", F.when(F.col("es").isNotNull(), rest))
    woven = F.array_join(F.transform("rest", lambda x, i: F.concat(x["text"], F.coalesce(F.get(F.col("es"), i)["text"], F.lit("")))), "")
    untitled = F.aggregate("rest", F.lit(0), lambda a, x: a + x["n"])
    return met.select("doc_id", F.coalesce(F.size("es") + untitled, F.lit(0)).cast("bigint").alias("n_entities"), F.coalesce(F.array_join(F.array_sort(F.array_distinct(F.transform("es", lambda e: e["kind"]))), ","), F.lit("")).alias("kinds"), F.when(F.col("es").isNull(), F.col("text")).otherwise(woven).alias("text"))


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def op8_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(read(spark, sf_dir, "documents"))
