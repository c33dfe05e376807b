"""Surrogates for personal data and secrets, in DataFrame expressions only.

Entities are found by patterns. Each distinct entity of the corpus gets one
surrogate, drawn by a keyed digest: same kind, same format, for names the same
gender and script. Equal entities get equal surrogates wherever they occur
(coreference), different ones different surrogates, and no surrogate is itself
an entity of the corpus: what collides is drawn again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowscore.llm.scratch import stored

# Kinds and their patterns, in the order in which they are tried.
PATTERNS = {
    "email": r"\b[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}\b",
    "phone": r"\+\d{1,3}[ -]?\(?\d{2,4}\)?[ -]?\d{3}[ -]?\d{4}\b",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d.]*\d)",
    "card": r"(?<![\d-])(?:\d{16}|(?:\d{4}[ -]){3}\d{4})(?![\d-])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "access_key": r"\bAKIA[0-9A-Z]{16}\b",
    "secret": "",
    "man": r"\b(?:Mr|Herr|Señor|Monsieur|г-н)\.? (?:\p{Lu}\p{Ll}+)",
    "woman": r"\b(?:Mrs|Ms|Miss|Frau|Señora|Madame|г-жа)\.? (?:\p{Lu}\p{Ll}+)",
}
# A value after ":" without quotes needs a digit, or it is a word of prose; what is
# of another kind, as a mail address, keeps that kind.
_OTHER = "|".join(PATTERNS[k] for k in ("email", "card", "access_key"))
_ASSIGNED = rf"""["']?\s*(?:=\s*["']?|:\s*["']|:\s*(?=[A-Za-z]*[0-9]))(?!{_OTHER})"""
PATTERNS["secret"] = (
    rf"(?i:password|secret|api_key){_ASSIGNED}[0-9A-Za-z]{{8,}}|(?i:token){_ASSIGNED}[0-9A-Za-z]{{16,}}"
)
# What stands before the value of a secret is found with it and stays.
VALUE = "([0-9A-Za-z]+)$"
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
NAMES = {
    ("man", "latin"): ["Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karl", "Leon", "Martin", "Noah", "Oscar", "Paul"],
    ("woman", "latin"): ["Anna", "Berta", "Clara", "Diana", "Emma", "Flora", "Greta", "Helena", "Irene", "Julia", "Klara", "Laura", "Maria", "Nora", "Olga", "Paula"],
    ("man", "cyrillic"): ["Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Кирилл"],
    ("woman", "cyrillic"): ["Анна", "Вера", "Галина", "Дарья", "Елена", "Жанна", "Ирина", "Ксения"],
}

# Attempts that keep the length of an address.
WIDER_AFTER = 6


def kind_of(entity: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(PATTERNS.items()):
        out = F.when(entity.rlike(f"^(?:{pattern})$"), kind).otherwise(out)
    return out


def canonical(kind: Column, entity: Column) -> Column:
    """What mentions of one entity share: no case, or no separators, or no title."""
    return (
        F.when(kind == "email", F.lower(entity))
        .when(kind.isin("phone", "card", "ssn"), F.regexp_replace(entity, r"\D", ""))
        .when(kind.isin("man", "woman"), F.regexp_extract(entity, r"(\p{L}+)$", 1))
        .when(kind == "secret", F.regexp_extract(entity, VALUE, 1))
        .otherwise(entity)
    )


def _nibble(digest: Column, i: Column) -> Column:
    """An integer below 256 out of the digest's hexadecimal digits."""
    at = (i * 2) % 126 + 1
    return F.conv(F.substring(digest, at, F.lit(2)), 16, 10).cast("int")


def _spelled(digest: Column, text: Column, fixed: Column) -> Column:
    """Letters and digits replaced from position ``fixed`` on, all else kept.

    A digit gives a digit, a letter one of its case; a hexadecimal text of one
    case stays hexadecimal.
    """
    hexadecimal = text.rlike("^[0-9a-f]*[a-f][0-9a-f]*$")
    upper_hexadecimal = text.rlike("^[0-9A-F]*[A-F][0-9A-F]*$")
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"

    def letter(c: Column, i: Column) -> Column:
        n = _nibble(digest, i)
        pick = lambda alphabet, size: F.substring(F.lit(alphabet), n % size + 1, F.lit(1))
        return (
            F.when(i < fixed, c)
            .when(hexadecimal, pick("0123456789abcdef", 16))
            .when(upper_hexadecimal, pick("0123456789ABCDEF", 16))
            .when(c.rlike("[0-9]"), pick(digits, 10))
            .when(c.rlike("[a-z]"), pick(lower, 26))
            .when(c.rlike("[A-Z]"), pick(upper, 26))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.split(text, ""), letter), "")


def _luhn(digits: Column) -> Column:
    """The checksum of a card number, modulo 10."""
    def value(c: Column, i: Column) -> Column:
        d = F.coalesce(c.try_cast("int"), F.lit(0))
        twice = F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
        return F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.transform(F.split(digits, ""), value), F.lit(0), lambda a, x: a + x) % 10


def surrogate(kind: Column, entity: Column, attempt: Column, key: str) -> Column:
    """The surrogate of a canonical entity, at the given attempt."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), kind, entity, attempt.cast("string")), 512)
    n = F.length(entity)
    # The top level of a mail domain, a country code, an issuer's digit stay.
    host_end = n - F.length(F.substring_index(entity, ".", -1))
    mail = F.concat(_spelled(digest, F.substring(entity, F.lit(1), host_end), F.lit(0)), F.substring(entity, host_end + 1, n))
    # A format may have fewer values than entities: later attempts are longer, one letter each.
    more = F.substring(digest, F.lit(1), attempt - WIDER_AFTER + 1)
    mail = F.concat(F.when(attempt >= WIDER_AFTER, more).otherwise(""), mail)
    spelled_card = _spelled(digest, F.substring(entity, F.lit(1), n - 1), F.lit(1))
    check = (F.lit(20) + _luhn(entity) - _luhn(F.concat(spelled_card, F.lit("0")))) % 10
    octet = lambda i: (_nibble(digest, F.lit(i)) % 254 + 1).cast("string")
    cyrillic = entity.rlike(r"\p{IsCyrillic}")
    name = F.lit(None).cast("string")
    for (gender, script), names in NAMES.items():
        fits = (kind == gender) & (cyrillic if script == "cyrillic" else ~cyrillic)
        listed = F.array(*[F.lit(x) for x in names])
        # Every attempt has one more part, so there are names enough for any corpus.
        parts = F.transform(
            F.sequence(F.lit(0), attempt), lambda i: F.get(listed, _nibble(digest, i) % len(names))
        )
        name = F.when(fits, F.array_join(parts, "-")).otherwise(name)
    return (
        F.when(kind == "email", mail)
        .when(kind == "card", F.concat(spelled_card, check.cast("string")))
        .when(kind == "phone", _spelled(digest, entity, n - 10))
        .when(kind == "ip", F.concat_ws(".", *[octet(i) for i in range(4)]))
        .when(kind == "access_key", _spelled(digest, entity, F.lit(4)))
        .when(kind.isin("man", "woman"), name)
        .otherwise(_spelled(digest, entity, F.lit(0)))
    )


def rendered(kind: Column, mention: Column, drawn: Column) -> Column:
    """The surrogate in the format of a mention: its separators, its case, its title."""
    number = F.aggregate(
        F.split(mention, ""),
        F.struct(F.lit("").alias("out"), F.lit(1).alias("next")),
        lambda acc, c: F.when(
            c.rlike("[0-9]"),
            F.struct(
                F.concat(acc["out"], F.substring(drawn, acc["next"], F.lit(1))).alias("out"),
                (acc["next"] + 1).alias("next"),
            ),
        ).otherwise(F.struct(F.concat(acc["out"], c).alias("out"), acc["next"].alias("next"))),
        lambda acc: acc["out"],
    )
    same_case = F.transform(
        F.split(mention, ""),
        lambda c, i: F.when(c.rlike("[A-Z]"), F.upper(F.substring(drawn, i + 1, F.lit(1)))).otherwise(
            F.substring(drawn, i + 1, F.lit(1))
        ),
    )
    title = F.regexp_replace(mention, r"\p{L}+$", "")
    return (
        F.when(kind.isin("phone", "card", "ssn"), number)
        .when(kind == "email", F.concat(F.array_join(same_case, ""), F.substring(drawn, F.length(mention) + 1, F.length(drawn))))
        .when(kind.isin("man", "woman"), F.concat(title, drawn))
        .when(kind == "secret", F.concat(F.regexp_replace(mention, VALUE, ""), drawn))
        .otherwise(drawn)
    )


def draw_surrogates(entities: DataFrame, key: str) -> DataFrame:
    """``kind, entity, drawn`` for the distinct ``kind, entity``: no two alike, none real.

    The smallest entity keeps a surrogate that several draw; the others, and
    those that drew an entity of the corpus, draw again. After WIDER_AFTER rounds
    addresses get longer, so that they end where a format has too few values.
    """
    real = entities.select("kind", F.col("entity").alias("drawn"))
    pending = entities.withColumn("attempt", F.lit(0))
    done = None
    while True:
        tried = pending.withColumn("drawn", surrogate(F.col("kind"), F.col("entity"), F.col("attempt"), key))
        taken = real if done is None else real.unionByName(done.select("kind", "drawn"))
        taken = taken.distinct().withColumn("taken", F.lit(True))
        nth = F.row_number().over(Window.partitionBy("kind", "drawn").orderBy("entity"))
        tried = tried.withColumn("nth", nth).join(taken, ["kind", "drawn"], "left")
        tried = stored(tried, "surrogates")
        good = "nth = 1 AND taken IS NULL"
        found = tried.where(good).select("kind", "entity", "drawn")
        done = found if done is None else done.unionByName(found)
        pending = tried.where(f"NOT ({good})").select("kind", "entity", (F.col("attempt") + 1).alias("attempt"))
        if pending.isEmpty():
            return done


def replace_entities(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with surrogates in ``text`` and the columns ``kinds`` and ``surrogates``.

    ``kinds`` and ``surrogates`` (arrays, in the order of the text) replace
    columns of that name; others, repeated rows and null ids are passed through.
    Null text stays null and empty text empty, with empty arrays. ``key`` is
    the secret that the surrogates hang on; a second corpus with the same key
    gets the same first draws. No rows give no rows.
    """
    kept = [c for c in docs.columns if c not in ("kinds", "surrogates")]
    own = docs.select(*kept).withColumns(
        {
            "_doc": F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(2**63))),
            "_version": F.xxhash64("text"),
        }
    )
    found = F.posexplode(F.regexp_extract_all("text", F.lit(ANY), F.lit(0)))
    mentions = own.select("_doc", "_version", found.alias("n", "mention"))
    mentions = mentions.withColumn("kind", kind_of(F.col("mention")))
    mentions = mentions.withColumn("entity", canonical(F.col("kind"), F.col("mention")))
    mentions = stored(mentions.distinct(), "mentions")
    drawn = draw_surrogates(mentions.select("kind", "entity").distinct(), key)
    joined = mentions.join(drawn, ["kind", "entity"])
    shown = rendered(F.col("kind"), F.col("mention"), F.col("drawn"))
    alone = F.when(F.col("kind") == "secret", F.col("drawn")).otherwise(shown)
    found_in = joined.select(
        "_doc", "_version", F.struct("n", "kind", shown.alias("text"), alone.alias("alone")).alias("s")
    )
    per_doc = found_in.groupBy("_doc", "_version").agg(F.array_sort(F.collect_list("s")).alias("_s"))
    # Only texts that have entities are shuffled.
    rest = own.where(F.coalesce(~F.col("text").rlike(ANY), F.lit(True)))
    out = own.where(F.col("text").rlike(ANY)).join(per_doc.hint("merge"), ["_doc", "_version"], "left")
    out = out.unionByName(rest, allowMissingColumns=True)
    pieces = F.split("text", ANY, -1)
    shown = F.zip_with(pieces, "_s", lambda p, s: F.concat(p, F.coalesce(s["text"], F.lit(""))))
    text = F.when(F.col("_s").isNull(), F.col("text")).otherwise(F.array_join(shown, ""))
    columns = [text.alias("text") if c == "text" else F.col(c) for c in kept]
    none = F.expr("cast(array() as array<string>)")
    return out.select(
        *columns,
        F.coalesce(F.transform("_s", lambda s: s["kind"]), none).alias("kinds"),
        F.coalesce(F.transform("_s", lambda s: s["alone"]), none).alias("surrogates"),
    )
