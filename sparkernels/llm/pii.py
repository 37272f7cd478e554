"""Personal data replaced by keyed surrogates of the same type and format; only DataFrame functions run here.

An entity is a type and a canonical value, so all its mentions get one surrogate in whatever way they are written: a
phone number is its digits with or without a country code, a name is a given name and a surname, each of which is an
entity. A canonical surrogate follows from a hash of key, type, value and attempt; a check over all entities raises the
attempt of those whose surrogate another one has or that is itself a real value, until all are distinct. What is written
is made from the canonical surrogate alone, in the mention's separators and case, so what was checked is what is written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Table, prepare, text_key

#: Attempts after which a type's space of surrogates counts as exhausted.
MOST_ATTEMPTS = 64

#: Forms of address by gender (the last ones have none), and given names by script and gender.
MALE, FEMALE = ("Mr", "Sir", "Herr", "Monsieur", "Señor", "г-н", "господин"), ("Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Señora", "г-жа", "госпожа")
NEUTRAL = ("Dr", "Prof", "Professor", "доктор", "профессор")
GIVEN = {
    ("latin", "m"): ("Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karl", "Leon", "Martin", "Oscar", "Paul", "Simon"),
    ("latin", "f"): ("Anna", "Bella", "Clara", "Diana", "Emma", "Flora", "Greta", "Helena", "Irene", "Julia", "Karin", "Laura", "Maria", "Nora", "Olga", "Sara"),
    ("cyrillic", "m"): ("Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Захар", "Илья", "Кирилл", "Лев", "Максим", "Никита", "Олег", "Павел", "Роман", "Семён"),
    ("cyrillic", "f"): ("Анна", "Белла", "Вера", "Галина", "Дарья", "Елена", "Зоя", "Ирина", "Ксения", "Лидия", "Мария", "Нина", "Ольга", "Полина", "Раиса", "Софья"),
}
#: Syllables of surrogate surnames, for each hexadecimal digit of the hash.
SYLLABLES = {
    "latin": ("ba", "de", "fi", "go", "ha", "ke", "li", "mo", "na", "pe", "ri", "so", "ta", "ve", "wi", "zu"),
    "cyrillic": ("ба", "де", "фи", "го", "ха", "ке", "ли", "мо", "на", "пе", "ри", "со", "та", "ве", "ви", "зу"),
}

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_ADDRESS = "|".join(sorted((*MALE, *FEMALE, *NEUTRAL), key=len, reverse=True))
_WORD = r"\p{Lu}[\p{L}'-]+"
#: Types and their patterns, the more specific ones first: where several match, the first takes the text.
TYPES = {
    # Only tried where a word begins, so a long word costs one look at it.
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+){0,10}\.[A-Za-z]{2,}",
    "ip": rf"(?<![0-9A-Za-z.]){_OCTET}(?:\.{_OCTET}){{3}}(?![0-9A-Za-z]|\.[0-9])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    # Ten digits in groups of three, three and four, with or without a country code; other numbers with a country code
    # in groups; numbers with a leading zero in two groups.
    "phone": r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[.-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])",
    "line": r"(?<![0-9A-Za-z+])(?:\+[1-9][0-9]{0,2}(?:[ .-]?[(]?[0-9]{2,4}[)]?){2,4}|0[0-9]{2,4}[ /][0-9]{5,8})(?![0-9A-Za-z])",
    "card": r"(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])",
    # After a form of address, or after a word that announces a name.
    "name": rf"(?<![\p{{L}}])(?:{_ADDRESS})\.?[ ](?:\p{{Lu}}\.[ ])?{_WORD}(?:[ ]{_WORD})?|(?<=[Nn]ame:[ ]|[Aa]uthor:[ ]|[Cc]ontact:[ ]|[Ss]igned:[ ]|Dear[ ]){_WORD}[ ]{_WORD}",
}
PATTERN = "|".join(TYPES.values())
#: What every match holds one of; most texts are passed over by this alone.
HINT = rf"[0-9@]|{_ADDRESS}|ame:|uthor:|ontact:|igned:|Dear"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _type(match: Column) -> Column:
    """The first type whose whole pattern a match is; a card number must pass its check digit, or it is none."""
    found = F.lit(None).cast("string")
    for kind, pattern in reversed(TYPES.items()):
        # What stands before a match is not part of it, so a name without a form of address is known by its words.
        whole = rf"^(?:{pattern})$" if kind != "name" else rf"^(?:(?:{_ADDRESS})\.?[ ](?:\p{{Lu}}\.[ ])?)?{_WORD}(?:[ ]{_WORD})?$"
        found = F.when(match.rlike(whole), kind).otherwise(found)
    return F.when((found != "card") | F.call_function("luhn_check", _digits(match)), found)


def normal(kind: Column, match: Column) -> Column:
    """What all mentions of an entity have in common; names have parts instead (`_parts`)."""
    return F.when(kind == "email", F.lower(match)).when(kind.isin("card", "line", "ssn"), _digits(match)).when(kind == "phone", F.right(_digits(match), F.lit(10))).otherwise(match)


def _parts(match: Column) -> tuple[Column, Column, Column]:
    """(gender, given name or initial or null, surname) of a name as written."""
    title = F.regexp_extract(match, rf"^({_ADDRESS})\.?[ ]", 1)
    words = F.split(F.regexp_replace(match, rf"^(?:{_ADDRESS})\.?[ ]", ""), "[ ]")
    gender = F.when(title.isin(*FEMALE), "f").when(title.isin(*MALE), "m")
    return gender, F.when(F.size(words) > 1, F.concat_ws(" ", F.slice(words, 1, F.size(words) - 1))), F.element_at(words, -1)


def _hex(code: Column, at, size: int = 2) -> Column:
    return F.conv(F.substr(code, at if isinstance(at, Column) else F.lit(at), F.lit(size)), 16, 10).cast("int")


def _stream(code: Column) -> Column:
    """28 decimal digits of a hash."""
    some = lambda at: F.right(F.lpad(F.conv(F.substring(code, at, 12), 16, 10), 15, "0"), F.lit(14))
    return F.concat(some(1), some(13))


def _pick(values: tuple[str, ...], at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), at + 1)


def _given(norm: Column, gender: Column, code: Column, attempt: Column) -> Column:
    """Given names of the gender and script, joined by hyphens: one in the first attempts, up to four in later ones."""
    count = F.least(F.lit(4), 1 + F.floor(attempt / 8).cast("int"))

    def of(script: str, sex: str) -> Column:
        return F.lower(F.array_join(F.transform(F.sequence(F.lit(1), count), lambda i: _pick(GIVEN[script, sex], _hex(code, i, 1))), "-"))

    female = F.coalesce(gender == "f", _hex(code, 9, 1) < 8)
    made = {script: F.when(female, of(script, "f")).otherwise(of(script, "m")) for script in SYLLABLES}
    return F.when(norm.rlike(r"\p{IsCyrillic}"), made["cyrillic"]).otherwise(made["latin"])


def _surname(norm: Column, code: Column, attempt: Column) -> Column:
    def of(script: str) -> Column:
        return F.array_join(F.transform(F.sequence(F.lit(2), F.lit(5) + F.least(attempt, F.lit(40))), lambda i: _pick(SYLLABLES[script], _hex(code, i, 1))), "")

    return F.when(norm.rlike(r"\p{IsCyrillic}"), of("cyrillic")).otherwise(of("latin"))


def _mail(norm: Column, code: Column, attempt: Column, key: str) -> Column:
    """A local part of the same shape, longer in later attempts, at a domain that only the real domain decides."""
    local, domain = F.substring_index(norm, "@", 1), F.substring_index(norm, "@", -1)

    def put(i: Column) -> Column:
        at, drawn = F.substr(local, i, F.lit(1)), _hex(code, 1 + 2 * F.pmod(i - 1, F.lit(31)))
        return F.when(at.rlike("[a-z]"), F.call_function("chr", 97 + drawn % 26)).when(at.rlike("[0-9]"), (drawn % 10).cast("string")).otherwise(at)

    shaped = F.array_join(F.transform(F.sequence(F.lit(1), F.length(local)), put), "")
    tail = F.when(attempt >= 4, F.concat(F.lit("-"), attempt.cast("string"))).otherwise("")
    place = _pick(("example.org", "example.com", "example.net"), _hex(F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit("domain"), domain), 256), 1) % 3)
    return F.concat(shaped, tail, F.lit("@"), place)


def surrogate(kind: Column, norm: Column, gender: Column, code: Column, attempt: Column, key: str) -> Column:
    """The canonical surrogate of an entity: of its type, and of the length of its value where it is a number."""
    stream, size = _stream(code), F.length(norm)
    ten = F.concat(F.translate(F.substring(stream, 1, 1), "01", "23"), F.substring(stream, 2, 2), F.translate(F.substring(stream, 4, 1), "01", "23"), F.substring(stream, 5, 6))
    line = F.concat(F.substring(norm, 1, 2), F.substr(stream, F.lit(1), size - 2))
    body = F.concat(F.substring(norm, 1, 1), F.substr(stream, F.lit(1), size - 2))
    check = F.filter(F.array(*[F.lit(str(d)) for d in range(10)]), lambda d: F.call_function("luhn_check", F.concat(body, d)))
    first = F.when(attempt < 8, F.lit("10")).otherwise(_hex(code, 7).cast("string"))
    address = F.concat_ws(".", first, *[_hex(code, at).cast("string") for at in (1, 3, 5)])
    made = F.when(kind == "email", _mail(norm, code, attempt, key)).when(kind == "ip", address).when(kind == "phone", ten).when(kind == "line", line)
    # Social security numbers from 900 on are never issued.
    made = made.when(kind == "ssn", F.concat(F.lit("9"), F.substring(stream, 1, 8))).when(kind == "card", F.concat(body, F.element_at(check, 1)))
    return made.when(kind == "given", _given(norm, gender, code, attempt)).when(kind == "surname", _surname(norm, code, attempt))


def _code(key: str, kind: Column, norm: Column, attempt: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", F.lit(key), kind, norm, attempt.cast("string")), 256)


def assigned(entities: DataFrame, key: str) -> DataFrame:
    """(kind, norm, made) of distinct entities (kind, norm, gender): no two of a type have one surrogate, and none is a
    real value of its type. Ties go to the smaller attempt, then to the smaller value.

    A type without a free surrogate after MOST_ATTEMPTS raises RuntimeError: nothing is written in clear or twice.
    """
    at = Table(entities.select("kind", "norm", "gender", F.lit(0).alias("attempt")), "attempts")
    real = Table(entities.select("kind", F.col("norm").alias("made")), "real")
    for _ in range(MOST_ATTEMPTS):
        # The code is a column of its own, so that it is made once for each entity.
        coded = at.df.withColumn("code", _code(key, F.col("kind"), F.col("norm"), F.col("attempt")))
        made = coded.withColumn("made", surrogate(F.col("kind"), F.col("norm"), F.col("gender"), F.col("code"), F.col("attempt"), key)).drop("code")
        first = F.row_number().over(Window.partitionBy("kind", "made").orderBy("attempt", "norm"))
        held = made.withColumn("nth", first).join(real.df.withColumn("real", F.lit(True)), ["kind", "made"], "left")
        after = Table(held.select("kind", "norm", "gender", "made", "attempt", ((F.col("nth") > 1) | F.coalesce("real", F.lit(False))).alias("again")), "attempts")
        at.release()
        if not after.df.where("again").take(1):
            real.release()
            return after.df.select("kind", "norm", "made")
        at = Table(after.df.select("kind", "norm", "gender", (F.col("attempt") + F.col("again").cast("int")).alias("attempt")), "attempts")
        after.release()
    raise RuntimeError("too few surrogates of a type for its entities")


def _cased(made: Column, written: Column) -> Column:
    """A name part in the case of the written one: capitals throughout, or at the beginning of each part."""
    title = F.array_join(F.transform(F.split(made, "-"), F.initcap), "-")
    return F.when((F.length(written) > 1) & (written == F.upper(written)), F.upper(made)).otherwise(title)


def written(kind: Column, match: Column, made: Column) -> Column:
    """A mention with the canonical surrogate in its own separators: digits from the right, what is left over stays."""
    digits, size = _digits(match), F.length(made)

    def put(i: Column) -> Column:
        at, behind = F.substr(match, i, F.lit(1)), F.length(digits) - F.length(_digits(F.substr(match, F.lit(1), i)))
        return F.when(at.rlike("[0-9]") & (behind < size), F.substr(made, size - behind, F.lit(1))).otherwise(at)

    def cased(i: Column) -> Column:
        at = F.substr(made, i, F.lit(1))
        return F.when(F.substr(match, i, F.lit(1)).rlike("[A-Z]") & (i <= F.length(F.substring_index(match, "@", 1))), F.upper(at)).otherwise(at)

    each = lambda f, of: F.array_join(F.transform(F.sequence(F.lit(1), F.length(of)), f), "")
    return F.when(kind == "ip", made).when(kind == "email", each(cased, made)).otherwise(each(put, match))


def _made_names(names: DataFrame, chosen: DataFrame) -> DataFrame:
    """(doc_id, key, n, made, swaps) of mentions of names: the name as written, and its words with theirs."""
    s = chosen.where("kind = 'surname'").select(F.col("norm").alias("s_norm"), F.col("made").alias("s_made"))
    g = chosen.where("kind = 'given'").select(F.col("norm").alias("g_norm"), F.col("made").alias("g_made"))
    _, given, surname = _parts(F.col("match"))
    each = names.select("doc_id", "key", "n", "match", given.alias("given"), surname.alias("surname"))
    both = each.join(s, F.lower("surname") == F.col("s_norm")).join(g, F.lower("given") == F.col("g_norm"), "left")
    title = F.regexp_extract("match", rf"^(?:{_ADDRESS})\.?[ ]", 0)
    first = F.when(F.col("given").isNull(), F.lit("")).otherwise(F.concat(_cased(F.col("g_made"), F.col("given")), F.lit(" ")))
    # An initial stands for whichever given name its document has with the surname: settled when the document is put together.
    initial = F.col("given").rlike(r"^\p{Lu}\.$")
    name = F.struct(title.alias("title"), F.when(initial, F.col("given")).alias("initial"), F.when(~F.coalesce(initial, F.lit(False)), first).alias("first"), _cased(F.col("s_made"), F.col("surname")).alias("last"))
    swaps = F.array_compact(F.array(F.struct(F.col("surname").alias("of"), _cased(F.col("s_made"), F.col("surname")).alias("to")), F.when(~initial & F.col("given").isNotNull(), F.struct(F.col("given").alias("of"), _cased(F.col("g_made"), F.col("given")).alias("to")))))
    return both.select("doc_id", "key", "n", F.lit(None).cast("string").alias("made"), name.alias("name"), swaps.alias("swaps"))


def _one(mention: Column, swaps: Column) -> Column:
    """A mention's text: as made, or a name, whose initial is that of the given name its document swaps, or else any."""
    name = mention["name"]
    of = F.filter(swaps, lambda s: F.substring(s["of"], 1, 1) == F.substring(name["initial"], 1, 1))
    letter = F.coalesce(F.substring(F.element_at(F.transform(of, lambda s: s["to"]), 1), 1, 1), F.substring(name["last"], 1, 1))
    first = F.coalesce(name["first"], F.concat(letter, F.lit(". ")))
    return F.coalesce(mention["made"], F.concat(name["title"], first, name["last"]))


def pseudonymised(docs: DataFrame, key: str) -> DataFrame:
    """For each row of docs (doc_id, text): doc_id, n_entities (mentions found by a pattern), text with all replaced.

    Null texts stay null and empty ones empty, with no entities; repeated rows get the same text. An entity has one
    surrogate in all documents, and two entities of a type never share one. Where a document names somebody, the given
    name and the surname are replaced wherever they stand in it as words, so a first name or surname alone stays the
    same person. key keeps surrogates from being made again by others: it is the caller's secret.
    """
    prepare(docs.sparkSession)
    rows = docs.select("doc_id", text_key().alias("key"), "text").withColumn("matches", F.when(F.col("text").rlike(HINT), F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0))))
    some = F.coalesce(F.size("matches") > 0, F.lit(False))
    # The patterns run once over the texts: later steps have the pieces and matches of those with any, and the rest as it is.
    cut = Table(rows.select("doc_id", "key", F.when(~some, F.col("text")).alias("text"), F.when(some, F.split("text", PATTERN, -1)).alias("pieces"), F.when(some, F.col("matches")).alias("matches")), "cut").df
    found = cut.where("matches is not null")
    each = found.select("doc_id", "key", F.posexplode("matches").alias("n", "match")).dropDuplicates(["doc_id", "key", "n"])
    mentions = Table(each.withColumn("kind", _type(F.col("match"))).where("kind is not null").withColumn("norm", normal(F.col("kind"), F.col("match"))), "mentions").df
    names, others = mentions.where("kind = 'name'"), mentions.where("kind <> 'name'")
    gender, given, surname = _parts(F.col("match"))
    given_ = F.when(~given.rlike(r"^\p{Lu}\.$"), F.struct(F.lit("given").alias("kind"), F.lower(given).alias("norm"), gender.alias("gender")))
    parts = names.select(F.explode(F.array_compact(F.array(F.struct(F.lit("surname").alias("kind"), F.lower(surname).alias("norm"), F.lit(None).cast("string").alias("gender")), given_))).alias("p")).select("p.*")
    entities = others.select("kind", "norm", F.lit(None).cast("string").alias("gender")).union(parts)
    chosen = assigned(entities.groupBy("kind", "norm").agg(F.min("gender").alias("gender")), key)
    plain = others.join(chosen, ["kind", "norm"]).select("doc_id", "key", "n", written(F.col("kind"), F.col("match"), F.col("made")).alias("made"))
    made_names = _made_names(names, chosen)
    types = dict(made_names.dtypes)
    plain = plain.withColumn("name", F.lit(None).cast(types["name"])).withColumn("swaps", F.array().cast(types["swaps"]))
    lists = plain.union(made_names).groupBy("doc_id", "key").agg(F.array_sort(F.collect_list(F.struct("n", "made", "name"))).alias("made"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("swaps")))).alias("swaps"))
    a, b = found.alias("a"), lists.alias("b")
    joined = a.join(b, F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.key") == F.col("b.key")), "left").select("a.doc_id", "pieces", "matches", "made", F.coalesce("swaps", F.array().cast(types["swaps"])).alias("swaps"))
    at = joined.withColumn("by_n", F.map_from_arrays(F.transform(F.coalesce("made", F.array().cast(dict(joined.dtypes)["made"])), lambda m: m["n"]), F.coalesce(F.transform("made", lambda m: _one(m, F.col("swaps"))), F.array().cast("array<string>"))))
    swapped = lambda piece: F.when(F.size("swaps") == 0, piece).otherwise(_swapped(piece, F.col("swaps")))
    text = F.array_join(F.transform("pieces", lambda p, i: F.concat(swapped(p), F.coalesce(F.element_at("by_n", i), F.coalesce(F.get("matches", i), F.lit(""))))), "")
    changed = at.select("doc_id", F.coalesce(F.size("made"), F.lit(0)).cast("long").alias("n_entities"), text.alias("text"))
    return changed.union(cut.where("matches is null").select("doc_id", F.lit(0).cast("long").alias("n_entities"), "text"))


def _swapped(piece: Column, swaps: Column) -> Column:
    """A piece of text with the words of names swapped where they stand alone."""
    to = F.map_from_entries(F.transform(F.filter(swaps, lambda s, i: (i == 0) | (s["of"] != F.get(F.transform(swaps, lambda x: x["of"]), i - 1))), lambda s: F.struct(s["of"], s["to"])))
    words = F.regexp_extract_all(piece, F.lit(r"[\p{L}'-]+|[^\p{L}'-]+"), F.lit(0))
    return F.array_join(F.transform(words, lambda w: F.coalesce(F.element_at(to, w), w)), "")
