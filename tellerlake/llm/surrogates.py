"""Surrogates for personal data: DataFrame and SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .decontaminate import bound
from .scratch import cut, unused

# Titles before a name, by the gender they tell.
TITLES = {"f": "Mrs|Ms|Miss|Frau|Mme|Madame|Mlle|Sra|Señora|Srta|Госпожа|Κυρία",
          "m": "Mr|Herr|Monsieur|Sr|Señor|Господин|Κύριος", "u": "Dr|Prof"}
# Without a possessive 's. Loops over groups are possessive or bounded: others recurse once a turn in Java.
_NAME = r"\p{Lu}(?=\p{L}|['’-]\p{L})\p{L}*+(?:['’-](?!s(?!\p{L}))\p{L}++)*+"
SECRET_WORDS = "(?i:password|passwd|token|secret|api_?key)"
_SIGN = "[\"']? ?[=:] ?[\"']?"  # a quote before it in JSON
_TITLE = "|".join(TITLES.values())

#: Kinds of entities in order of precedence. Keys and names are matched with the word before them.
PATTERNS = {
    "email": r"(?<![\w.+-])[\w.+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++){0,126}\.[A-Za-z]{2,}",
    "key": r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])",
    "secret": rf"(?<![A-Za-z]){SECRET_WORDS}{_SIGN}(?=[+/_-]*[A-Za-z0-9])[A-Za-z0-9+/_-]{{8,}}",
    "phone": r"(?<![\w+])\+?1[ .-]?\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}(?!\d)"
             r"|(?<![\w+(.-])\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}(?![\w-])"
             r"|(?<![\w+])\+(?!1[ .-]?\()\d{1,3}(?:[ .-]?\(?\d{2,5}\)?){2,5}(?!\d)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "ip": r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d)",
    "card": r"(?<![\w.-])(?:\d{4}[ -]){3}\d{4}(?![\w-])|(?<![\w.-])\d{13,19}(?![\w-])",
    "name": rf"(?<!\p{{L}})(?:{_TITLE})\.?[  ]{_NAME}(?:[  ]{_NAME})*+",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: What an entity has in it: literal parts, and digits in a row. Cheap tests before the patterns.
HINTS = ("@", "AKIA", *_TITLE.split("|"))
SECRET_HINTS = ("passw", "token", "secret", "api")  # in lower case
DIGITS = r"\d[ .()-]{0,2}\d[ .()-]{0,2}\d"


def _hinted(text: Column) -> Column:
    found = text.rlike(DIGITS)
    for hint in HINTS:
        found = found | text.contains(hint)
    lower = F.lower(text)
    for hint in SECRET_HINTS:
        found = found | lower.contains(hint)
    return found


# Letters that stand for one another, by script, case and sound.
POOLS = ("0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ",
         "аеиоуыэюя", "бвгджзклмнпрстфхцчшщ", "АЕИОУЭЮЯ", "БВГДЖЗКЛМНПРСТФХЦЧШЩ",
         "αεηιουω", "βγδζθκλμνξπρσςτφχψ", "ΑΕΗΙΟΥΩ", "ΒΓΔΖΘΚΛΜΝΞΠΡΣΤΦΧΨ", "áéíóúàèìòùâêîôûäëïöü", "ÁÉÍÓÚÀÈÌÒÙÄËÏÖÜ")
HEX = "0123456789abcdef"


def _kind(entity: Column) -> Column:
    """Kind of a match of :data:`ANY`: the first whose pattern is the whole of it."""
    return F.coalesce(*[F.when(entity.rlike(f"^(?:{p})$"), kind) for kind, p in PATTERNS.items()])


def _canonical(kind: Column, entity: Column) -> Column:
    """The same for all spellings of one entity: case of mail, layout of numbers."""
    return (F.when(kind == "email", F.lower(entity))
            .when(kind == "phone", F.regexp_replace(F.regexp_replace(entity, r"\D", ""), r"^1(\d{10})$", "$1"))
            .when(kind.isin("card", "ssn"), F.regexp_replace(entity, r"\D", "")).otherwise(entity))


def _chars(text: Column) -> Column:
    return F.when(F.length(text) > 0, F.split(text, "(?!^)")).otherwise(F.array().cast("array<string>"))


def _longer(key: str, kind: Column, value: Column, attempt: Column, level: Column, drawn: Column, tail: Column) -> Column:
    """``drawn`` with ``level`` syllables more, of its own script: a space that never runs out.

    Mail gets them before its name, names before the letter that stays, numbers and secrets at the end.
    """
    own = F.regexp_replace(F.lower(value), r"[^\p{L}]", "")
    digits, text = kind.isin("phone", "ssn"), kind.isin("email", "secret")
    hexadecimal = (kind == "secret") & value.rlike("^[0-9a-f]+$")

    def pool(latin: str, cyrillic: str, greek: str) -> Column:
        return (F.when(digits, F.lit(POOLS[0])).when(hexadecimal, F.lit(HEX)).when(text, F.lit(latin))
                .when(value.rlike(r"\p{IsCyrillic}"), F.lit(cyrillic)).when(value.rlike(r"\p{IsGreek}"), F.lit(greek))
                .when(value.rlike(r"\p{IsLatin}") | (own == ""), F.lit(latin)).otherwise(own))

    def letter(i: Column) -> Column:
        n = F.conv(F.substring(F.sha2(F.concat_ws(
            "|", F.lit(key), kind, value, attempt.cast("string"), F.lit("more"), i.cast("string")), 256), 1, 6), 16, 10).cast("int")
        return bound(F.when(i % 2 == 0, pool(POOLS[2], POOLS[6], POOLS[10])).otherwise(pool(POOLS[1], POOLS[5], POOLS[9])),
                     lambda p: F.substring(p, n % F.length(p) + 1, F.lit(1)))

    more = F.array_join(F.transform(F.sequence(F.lit(0), level * 2 - 1), letter), "")
    stays = F.when(kind.startswith("name"), tail).otherwise(F.lit(0))
    return F.when(kind == "email", F.concat(more, drawn)).otherwise(F.concat(
        F.substring(drawn, F.lit(1), F.length(drawn) - stays), more,
        F.substring(drawn, F.length(drawn) - stays + 1, stays)))


def _draw(key: str, kind: Column, value: Column, attempt: Column, last: Column, rounds: int) -> Column:
    """Surrogate of a canonical value: every letter and digit gives way to one of its own pool.

    The choice is read off SHA-256 of key, kind, value and attempt, four hexadecimal digits a
    character. The ``last`` characters, separators, the first digit of a card, country code, the fixed head of a key
    and the top domain of an address stay. From attempt ``rounds`` on, and at once where a value
    holds nothing that could give way, the surrogate grows longer (see :func:`_longer`). The
    forms of IP addresses, cards and keys hold 10^9 values and more and are kept.
    """
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.length(value) / 16).cast("int")), lambda b: F.sha2(
        F.concat_ws("|", F.lit(key), kind, value, attempt.cast("string"), b.cast("string")), 256))
    hexadecimal = (kind == "secret") & value.rlike("^[0-9a-f]+$")
    tail = F.when(kind == "email", F.length(F.substring_index(value, ".", -1)) + 1).otherwise(last)
    head = F.when(kind == "key", 4).when(kind == "card", 1).otherwise(0)
    us_phone = (kind == "phone") & value.rlike(r"^\d{10}$")
    size = F.length(value)

    def poured(known: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            # from the block itself: a look-up in one long string would walk over all before it
            n = F.conv(F.substring(F.get(known["blocks"], F.floor(i / 16).cast("int")), i % 16 * 4 + 1, F.lit(4)), 16, 10).cast("int")
            pick = c
            for pool in reversed(POOLS):
                pick = F.when(F.instr(F.lit(pool), c) > 0, F.substring(F.lit(pool), n % len(pool) + 1, F.lit(1))).otherwise(pick)
            # area and exchange codes of North American numbers begin with 2 to 9
            pick = F.when(known["us"] & (known["size"] - i).isin(10, 7), F.substring(F.lit("23456789"), n % 8 + 1, F.lit(1))).otherwise(pick)
            pick = F.when(known["hex"], F.substring(F.lit(HEX), n % 16 + 1, F.lit(1))).otherwise(pick)
            return F.when((i < known["head"]) | (i >= known["size"] - known["tail"]), c).otherwise(pick)
        return F.array_join(F.transform(_chars(value), one), "")

    # what all characters ask for is worked out once a value, not once a character
    drawn = bound(F.struct(blocks.alias("blocks"), size.alias("size"), tail.alias("tail"), head.alias("head"),
                           us_phone.alias("us"), hexadecimal.alias("hex")), poured)
    octets = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.when(
        i == 0, F.conv(F.substring(F.get(blocks, F.lit(0)), F.lit(1), F.lit(4)), 16, 10).cast("int") % 223 + 1).otherwise(
        F.conv(F.substring(F.get(blocks, F.lit(0)), i * 4 + 1, F.lit(4)), 16, 10).cast("int") % 254 + 1).cast("string"))
    # a card keeps what it was: passing the check digit or not
    card = bound(drawn, lambda x: F.concat(F.substring(x, F.lit(1), size - 1), ((
        F.substring(x, size, F.lit(1)).cast("int") + 10 - _luhn(x) + _luhn(value)) % 10).cast("string")))
    level = F.when(attempt >= rounds, F.floor((attempt - rounds) / 4).cast("int") + 1).when(attempt > 0, 1).otherwise(0)
    wider = bound(drawn, lambda x: F.when((attempt >= rounds) | ((attempt > 0) & (x == value)), _longer(
        key, kind, value, attempt, level, x, tail)).otherwise(x))
    return (F.when(kind == "ip", F.array_join(octets, ".")).when(kind == "card", card)
            .when(kind == "key", drawn).otherwise(wider))


def _luhn(digits: Column) -> Column:
    """Check sum of a digit string, modulo 10."""
    n = F.length(digits)
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda total, i: (total + bound(
        F.substring(digits, i, F.lit(1)).cast("int"),
        lambda d: F.when((n - i) % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2))) % 10)


def _laid_out(kind: Column, entity: Column, surrogate: Column) -> Column:
    """A canonical surrogate in the spelling of one occurrence."""
    digits = F.when((kind == "phone") & F.regexp_replace(entity, r"\D", "").rlike(r"^1\d{10}$"),
                    F.concat(F.lit("1"), surrogate)).otherwise(surrogate)
    poured = F.aggregate(_chars(entity), F.struct(F.lit("").alias("s"), F.lit(1).alias("k")), lambda a, c: F.when(
        c.rlike(r"\d"), F.struct(F.concat(a["s"], F.substring(digits, a["k"], F.lit(1))).alias("s"), (a["k"] + 1).alias("k"))
    ).otherwise(F.struct(F.concat(a["s"], c).alias("s"), a["k"].alias("k"))), lambda a: F.concat(
        a["s"], F.substring(digits, a["k"], F.length(digits))))  # a longer surrogate goes on behind
    return (F.when(kind.isin("phone", "card", "ssn"), poured)
            .when((kind == "email") & (entity == F.upper(entity)), F.upper(surrogate)).otherwise(surrogate))


def entity_map(entities: DataFrame, key: str, rounds: int = 40) -> DataFrame:
    """(kind, value, surrogate) for ``entities(kind, value)``: no two alike, none real.

    A surrogate that is a real value of its kind, or that another value drew earlier (lower
    attempt, then lower value), is drawn again with the next attempt until none is left. After
    ``rounds`` attempts a value leaves its own form for longer ones, so the loop settles however
    small a form is. An optional column ``last`` says how many last characters stay.
    """
    if "last" not in entities.columns:
        entities = entities.withColumn("last", F.when(F.col("kind").isin("name_f", "name_m"), 1).otherwise(0))
    kind, value, attempt, last = (F.col(c) for c in ("kind", "value", "attempt", "last"))
    values = cut(entities.groupBy("kind", "value").agg(F.max("last").alias("last")).withColumn("attempt", F.lit(0)), "entities")
    state = values.withColumn("surrogate", _draw(key, kind, value, attempt, last, rounds))
    while True:
        state = cut(state, "surrogates")
        real = values.select("kind", F.col("value").alias("surrogate"), F.lit(True).alias("real"))
        first = state.groupBy("kind", "surrogate").agg(F.min(F.struct("attempt", "value")).alias("first"))
        judged = state.join(first, ["kind", "surrogate"]).join(real, ["kind", "surrogate"], "left")
        clash = F.coalesce("real", F.lit(False)) | (F.struct("attempt", "value") != F.col("first"))
        judged = judged.select("kind", "value", "last", "attempt", "surrogate", clash.alias("clash"))
        if not judged.where("clash").head(1):
            return state.select("kind", "value", "surrogate")
        again = attempt + F.col("clash").cast("int")
        state = judged.select("kind", "value", "last", again.alias("attempt"), F.when(
            F.col("clash"), _draw(key, kind, value, again, last, rounds)).otherwise(F.col("surrogate")).alias("surrogate"))


def pseudonymise(docs: DataFrame, key: str = "surrogate-key-1") -> DataFrame:
    """``docs`` with the personal data in ``text`` replaced, and ``n_replaced`` (long) added.

    Mail and IP addresses, phone and card numbers, social security numbers, access keys and
    names after a title are found by pattern. Equal entities get equal surrogates throughout
    the corpus and different ones different surrogates (see :func:`entity_map`), which keep
    kind, layout, script, case and length (IP addresses: only the form; a value whose form is used
    up gets a longer one). Values without a letter or digit are no secrets. Each part of a name
    is replaced by itself, whatever title stands before it, so "Ms Ada Byron", "Dr Ada" and "Ms Byron" agree;
    the last letter of a given name stays if a title tells its gender anywhere. Where a text has a
    name after a title, all further mentions of the name's parts in it, as whole words in the same
    case, are replaced likewise and counted. Text around entities is untouched.

    Null and empty texts and texts without entities come back as they are. Ids are not used,
    so null and repeated ids are no matter; equal texts get equal results. A column called
    ``n_replaced`` is replaced, all others pass through, whatever their names. Names may have any
    number of parts and words any length.

    Only texts with entities are stored, and joined to their replacements by the text's hash.
    """
    columns = [c for c in docs.columns if c != "n_replaced"]
    # names beside those of the table
    digest, new_, names_, mention_ = (unused(columns, n) for n in ("_text", "_new", "_names", "_mention"))
    text = F.col("text").cast("string")
    has = F.coalesce(_hinted(text) & text.rlike(ANY), F.lit(False))
    clean = docs.select(*columns).where(~has).withColumn("n_replaced", F.lit(0).cast("long"))
    found = cut(docs.select(*columns).where(has).withColumn(digest, F.sha2("text", 256)), "with-entities")

    entity, word = F.col("entity"), F.col("word")
    parts = found.groupBy(F.col(digest).alias("_text")).agg(F.first("text").alias("text")).select("_text", F.posexplode(
        F.regexp_extract_all("text", F.lit(ANY), F.lit(0))).alias("at", "entity")).select(
        "_text", "at", "entity", _kind(entity).alias("kind"))
    # an entity in words: those of a name, or what stands before a secret and the secret
    cuts = F.when(F.col("kind") == "name", r"(?<=[  ])").when(
        F.col("kind") == "secret", rf"(?<={SECRET_WORDS}{_SIGN})(?![ \"'=:])(?=[A-Za-z0-9+/_-]{{8,}}$)").otherwise("$^")
    words = parts.withColumn("words", F.split(entity, cuts)).select(
        "_text", "at", F.posexplode("words").alias("word_at", "word"), "kind", F.size("words").alias("n"),
        F.coalesce(*[F.when(F.get("words", F.lit(0)).rlike(f"^(?:{t})\\W"), g) for g, t in TITLES.items()]).alias("title"))
    fixed = F.col("kind").isin("name", "secret") & (F.col("word_at") == 0) & (F.col("n") > 1)
    # a name part is one entity by its value; given names keep the letter that tells the gender
    kind = F.when(fixed, F.lit(None)).otherwise(F.col("kind"))
    given = (F.col("kind") == "name") & (F.col("word_at") < F.col("n") - 1) & F.col("title").isin("f", "m")
    words = cut(words.select("_text", "at", "word_at", "word", kind.alias("kind"), F.coalesce(
        given, F.lit(False)).cast("int").alias("last")).withColumn(
        "value", _canonical(F.col("kind"), F.rtrim(F.translate(word, " ", " ")))), "entities")
    mapping = entity_map(words.where("kind IS NOT NULL").select("kind", "value", "last"), key)
    space = F.regexp_extract(word, r"[ \u00A0]$", 0)
    mapped = words.join(mapping, ["kind", "value"], "left").select("_text", "at", "word_at", F.when(
        F.col("kind") == "name", F.struct("value", "surrogate")).alias("name"), F.when(
        F.col("kind").isNull(), word).otherwise(F.concat(
            _laid_out(F.col("kind"), word, F.col("surrogate")), F.when(F.col("kind").startswith("name"), space).otherwise(
                F.lit("")))).alias("word"))
    entire = mapped.groupBy("_text", "at").agg(F.array_join(F.transform(F.array_sort(F.collect_list(
        F.struct("word_at", "word"))), lambda w: w["word"]), "").alias("entity"), F.collect_set("name").alias("names"))
    joined = entire.groupBy("_text").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("at", "entity"))), lambda e: e["entity"]).alias("_new"),
        F.array_distinct(F.flatten(F.collect_list("names"))).alias("_names"))
    joined = joined.withColumn("_mention", F.when(F.size("_names") > 0, F.concat(  # the longest first
        F.lit(r"(?<!\p{L})(?:"), F.array_join(F.reverse(F.array_sort(F.transform(F.col("_names"), lambda n: F.struct(
            F.length(n["value"]).alias("n"), n["value"].alias("v"))))).getField("v"), "|"), F.lit(r")(?!\p{L})")))
    ).withColumn("_names", F.map_from_entries("_names")).withColumnsRenamed(
        {"_text": digest, "_new": new_, "_names": names_, "_mention": mention_})

    def mentions(piece: Column) -> Column:
        return F.when(F.col(mention_).isNull(), F.array().cast("array<string>")).otherwise(
            F.regexp_extract_all(piece, F.col(mention_), F.lit(0)))

    def renamed(piece: Column) -> Column:
        return F.when(F.col(mention_).isNull(), piece).otherwise(bound(mentions(piece), lambda found: F.array_join(F.flatten(
            F.transform(F.split(piece, F.col(mention_), -1), lambda q, i: F.array(
                q, F.coalesce(F.element_at(F.col(names_), F.get(found, i)), F.lit(""))))), "")))

    pieces = F.split("text", ANY, -1)
    woven = bound(F.col(new_), lambda new: F.array_join(F.flatten(F.transform(
        pieces, lambda piece, i: F.array(renamed(piece), F.coalesce(F.get(new, i), F.lit(""))))), ""))
    more = F.when(F.col(mention_).isNull(), 0).otherwise(
        F.aggregate(pieces, F.lit(0), lambda n, piece: n + F.size(mentions(piece))))
    new = found.join(joined, digest).select(*[woven.alias("text") if c == "text" else c for c in columns],
                                             (F.size(new_) + more).cast("long").alias("n_replaced"))
    return clean.unionByName(new)
