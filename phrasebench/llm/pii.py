"""Surrogates for personal data, in DataFrame expressions only.

Entities are found by one alternation of patterns. An entity's surrogate is a keyed function of its kind and its
canonical form (case and separators removed), so it is the same wherever, and however written, the entity occurs
(coreference). It has the entity's format: digits become digits, letters become letters of the same script and
case, separators stay; card numbers stay valid, country codes and top-level domains stay; a name after a title
becomes a name of the title's gender and of the same script and number of words.

Collision check: over all distinct entities of the corpus, no two of a kind may share a surrogate and no surrogate
may be an entity that occurs. The later one (in text order) of a clash is given the next salt, until none clashes.
Rows decide by themselves with salt 0; only rows that hold a re-salted entity are joined with the salts.

Cases: a null text stays null and an empty one empty; without entities a text is unchanged; rows with equal keys
share their salts; repeated rows and an empty table need no care; further columns are carried through, but for one
named ``pii`` and those starting with ``_pii``, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phrasebench.session import cut_lineage

# Titles, given names and syllables of surrogate names.
MALE_TITLES = ["Mr.", "Mr", "Herr", "Monsieur", "M.", "Señor", "Sr.", "Don", "г-н", "господин", "κύριος"]
FEMALE_TITLES = ["Mrs.", "Mrs", "Ms.", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra.", "Doña", "г-жа", "госпожа", "κυρία"]
GIVEN = {
    ("latin", "m"): ["Adrian", "Bruno", "Conrad", "Damian", "Emil", "Fabian", "Gregor", "Hugo", "Ivo", "Julian", "Leon", "Martin", "Oscar", "Paul", "Robin", "Simon"],
    ("latin", "f"): ["Anita", "Bianca", "Clara", "Diana", "Elena", "Flora", "Greta", "Helena", "Irma", "Julia", "Laura", "Marta", "Olivia", "Paula", "Rosa", "Silvia"],
    ("cyrillic", "m"): ["Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Кирилл", "Лев", "Марк", "Олег", "Павел", "Роман", "Сергей", "Тимур", "Юрий"],
    ("cyrillic", "f"): ["Алла", "Белла", "Вера", "Галина", "Дарья", "Ева", "Инна", "Клара", "Лидия", "Мария", "Нина", "Ольга", "Полина", "Раиса", "София", "Юлия"],
    ("greek", "m"): ["Αλέξης", "Βασίλης", "Γιώργος", "Δημήτρης", "Ηλίας", "Θωμάς", "Κώστας", "Λάμπρος", "Μάριος", "Νίκος", "Πέτρος", "Σπύρος", "Στέλιος", "Τάσος", "Φώτης", "Χρήστος"],
    ("greek", "f"): ["Αθηνά", "Βασιλική", "Γεωργία", "Δέσποινα", "Ελένη", "Ζωή", "Ηλέκτρα", "Θάλεια", "Ιωάννα", "Κατερίνα", "Λίνα", "Μαρία", "Νίκη", "Ρένα", "Σοφία", "Χαρά"],
}
SYLLABLES = {
    "latin": ["ba", "ber", "co", "dan", "del", "dor", "fa", "fel", "gar", "hal", "ka", "ker", "la", "len", "lo", "mar", "mel", "mo", "na", "nor", "or", "pe", "ran", "rel", "ro", "sa", "sel", "ta", "tor", "va", "ver", "wil"],
    "cyrillic": ["ба", "бер", "ва", "вол", "га", "гор", "да", "дон", "жи", "за", "ка", "кор", "ла", "лен", "ма", "мор", "на", "нор", "па", "пет", "ра", "род", "са", "сол", "та", "тор", "фе", "хар", "ча", "ши", "ря", "юр"],
    "greek": ["βα", "βερ", "γα", "γορ", "δα", "δελ", "ζα", "θα", "κα", "κορ", "λα", "λεν", "μα", "μαρ", "να", "νορ", "ξα", "πα", "πετ", "ρα", "ρελ", "σα", "σολ", "τα", "τορ", "φα", "φερ", "χα", "χορ", "ψα", "ρο", "λι"],
}
SURNAME_END = {("latin", "m"): "", ("latin", "f"): "", ("cyrillic", "m"): "ов", ("cyrillic", "f"): "ова", ("greek", "m"): "ίδης", ("greek", "f"): "ίδου"}

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_TITLE = "(?:" + "|".join(t.replace(".", r"\.") for t in MALE_TITLES + FEMALE_TITLES) + ")"
# What counts as an entity; an earlier kind wins where two match at one place.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}_.+-])[\p{L}\p{N}_][\p{L}\p{N}_.+-]{0,63}+@[A-Za-z0-9](?:[A-Za-z0-9-]{0,62}\.)+[A-Za-z]{2,24}",
    "secret": r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+|(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36,255}+|sk-[0-9A-Za-z]{20,255}+)(?![0-9A-Za-z])",
    "ip": rf"(?<![\w.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\w|\.\d)",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?: ?[0-9A-Z]{4}){3,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|(?:\(\d{3}\) ?|\d{3}[-.])\d{3}[-.]\d{4})(?!\w)",
    "card": r"(?<![\w-])\d(?:[ -]?\d){12,18}(?![\w-])",
    "name": rf"(?<![\p{{L}}\p{{N}}]){_TITLE} \p{{Lu}}[\p{{L}}'-]+(?: \p{{Lu}}[\p{{L}}'-]+){{0,2}}",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Every entity holds one of these; texts without any are not searched further.
HINT = r"[0-9@]|[a-f]{32}|[A-F]{32}|A[KS]IA|gh[pousr]_|sk-|(?=[MHFSDгκ])" + _TITLE + r" \p{Lu}"
_GAPS = r"[^\p{L}\p{N}]"


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def kind_of(value: Column) -> Column:
    out = None
    for kind, pattern in PATTERNS.items():
        hit = value.rlike(f"^(?:{pattern})$")
        out = F.when(hit, F.lit(kind)) if out is None else out.when(hit, F.lit(kind))
    return out


def canonical(kind: Column, value: Column) -> Column:
    """What two writings of one entity have in common."""
    return (F.when(kind.isin("email", "ip", "secret", "name"), F.lower(value))
            .otherwise(F.upper(F.regexp_replace(value, _GAPS, ""))))


def _stream(key: str, label: Column, salt: Column) -> Column:
    """128 hex digits from the key, what is replaced, and the salt."""
    return F.sha2(F.concat_ws("|", F.lit(key), label, salt.cast("string")).cast("binary"), 512)


def _number(stream: Column, place: Column) -> Column:
    """0..65535 from a stream, by place; places beyond the stream wrap and are shifted."""
    at = F.pmod(place, F.lit(31)) * F.lit(4) + F.lit(1)
    return F.conv(F.substring(stream, at, F.lit(4)), 16, 10).cast("int") + F.floor(place / F.lit(31)).cast("int")


def _letters(first: int, n: int, k: Column) -> Column:
    return F.substring(F.lit("".join(chr(first + i) for i in range(n))), F.pmod(k, F.lit(n)) + F.lit(1), F.lit(1))


def _char(c: Column, k: Column, hexadecimal: Column) -> Column:
    """A character of the class of ``c``."""
    return (F.when(c.between("0", "9"), _letters(ord("0"), 10, k))
            .when(hexadecimal & c.between("a", "f"), _letters(ord("a"), 6, k))
            .when(hexadecimal & c.between("A", "F"), _letters(ord("A"), 6, k))
            .when(c.between("a", "z"), _letters(ord("a"), 26, k)).when(c.between("A", "Z"), _letters(ord("A"), 26, k))
            .when(c.between("а", "я"), _letters(ord("а"), 32, k)).when(c.between("А", "Я"), _letters(ord("А"), 32, k))
            .when(c.rlike(r"^\p{IsGreek}$") & (c == F.lower(c)), _letters(ord("α"), 17, k))
            .when(c.rlike(r"^\p{IsGreek}$"), _letters(ord("Α"), 17, k))
            .when(c.rlike(r"^\p{Lu}$"), _letters(ord("A"), 26, k)).when(c.rlike(r"^\p{L}$"), _letters(ord("a"), 26, k))
            .when(c.rlike(r"^\p{N}$"), _letters(ord("0"), 10, k)).otherwise(c))


def _shaped(value: Column, stream: Column, hexadecimal: Column | None = None) -> Column:
    """``value`` with every letter and digit replaced; places count letters and digits only."""
    hexadecimal = F.lit(False) if hexadecimal is None else hexadecimal
    places = F.sequence(F.lit(1), F.length(value))
    made = F.transform(places, lambda i: _char(
        F.substring(value, i, F.lit(1)),
        _number(stream, F.length(F.regexp_replace(F.substring(value, F.lit(1), i), _GAPS, "")) - F.lit(1)), hexadecimal))
    return F.when(F.length(value) > 0, F.array_join(made, "")).otherwise(value)


def luhn(digits: Column) -> Column:
    """Luhn sum of a string of digits, modulo ten; 0 for a valid card number."""
    def add(s: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int") * F.when(F.pmod(i, F.lit(2)) == 1, 2).otherwise(1)
        return s + F.when(d > 9, d - F.lit(9)).otherwise(d)
    return F.pmod(F.aggregate(F.sequence(F.lit(0), F.length(digits) - F.lit(1)), F.lit(0), add), F.lit(10))


def _ip(own: Column) -> Column:
    return F.concat_ws(".", *[(F.pmod(_number(own, F.lit(i)), F.lit(254)) + F.lit(1)).cast("string") for i in range(4)])


def _pick(words: Column, k: Column) -> Column:
    return F.element_at(words, F.pmod(k, F.size(words)) + F.lit(1))


def _by_script(table: dict, script: Column, male: Column) -> Column:
    """The entry of ``table`` for a script and gender."""
    out = None
    for (s, g), words in table.items():
        value = F.split(F.lit(" ".join(words)), " ") if isinstance(words, list) else F.lit(words)
        cond = (script == s) & (male if g == "m" else ~male)
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out


def _name(value: Column, own: Column, salt: Column) -> Column:
    """A name of the title's gender, of the same script and number of words; a salt adds syllables."""
    at = F.instr(value, " ")
    title, name = F.substring(value, F.lit(1), at - F.lit(1)), F.substring(value, at + F.lit(1), F.length(value))
    male, words = title.isin(*MALE_TITLES), F.size(F.split(name, " "))
    script = F.when(name.rlike(r"\p{IsCyrillic}"), "cyrillic").when(name.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")
    syllables = _by_script({(s, g): SYLLABLES[s] for s, g in GIVEN}, script, male)
    parts = F.transform(F.sequence(F.lit(0), salt + F.lit(2)), lambda i: _pick(syllables, _number(own, i + F.lit(2))))
    last = F.initcap(F.concat(F.array_join(parts, ""), _by_script(SURNAME_END, script, male)))
    given = F.transform(F.sequence(F.lit(1), words), lambda i: F.when(i == words, last).otherwise(
        _pick(_by_script(GIVEN, script, male), _number(own, i - F.lit(1)))))
    return F.concat(title, F.lit(" "), F.array_join(given, " "))


def surrogate(key: str, kind: Column, value: Column, salt: Column) -> Column:
    """The replacement of one entity."""
    own = _stream(key, F.concat(kind, F.lit("|"), canonical(kind, value)), salt)
    return _let(own, lambda o: _replacement(kind, value, salt, o))


def _replacement(kind: Column, value: Column, salt: Column, own: Column) -> Column:
    """What a kind keeps at either end, and keyed characters between."""
    head = (F.when(kind == "phone", F.regexp_extract(value, r"^(\+\d{1,3})(?=\D)", 1))
            .when(kind == "iban", F.substring(value, 1, 2)).otherwise(F.lit("")))
    tail = F.when(kind == "email", F.regexp_extract(value, r"(\.[A-Za-z]+)$", 1)).otherwise(F.lit(""))
    middle = F.substring(value, F.length(head) + F.lit(1), F.length(value) - F.length(head) - F.length(tail))
    # a very short address has few surrogates; from the fourth salt on it grows
    middle = F.when((kind == "email") & (salt > 3), F.concat(F.repeat(F.lit("x"), salt - F.lit(3)), middle)).otherwise(middle)
    hexadecimal = (kind == "secret") & value.rlike("^[0-9A-Fa-f]+$")
    made = F.concat(head, _shaped(middle, own, hexadecimal), tail)
    card = (kind == "card") & (luhn(F.regexp_replace(value, r"\D", "")) == 0)
    return (F.when(kind == "ip", _ip(own)).when(kind == "name", _name(value, own, salt))
            .when(card, _let(made, _with_check_digit)).otherwise(made))


def _with_check_digit(number: Column) -> Column:
    body = F.substring(number, F.lit(1), F.length(number) - F.lit(1))
    check = F.pmod(F.lit(10) - luhn(F.concat(F.regexp_replace(body, r"\D", ""), F.lit("0"))), F.lit(10))
    return F.concat(body, check.cast("string"))


# ---- corpus --------------------------------------------------------------------------------------

def found(text: Column) -> Column:
    """Entities of a text in order, as strings; empty for a null text."""
    hits = F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ANY), F.lit(0)))
    return F.coalesce(hits, F.array().cast("array<string>"))


def entities(docs: DataFrame, text: str) -> DataFrame:
    """Distinct (kind, canon, value): every entity of the corpus, with one writing of it."""
    hits = docs.select(F.explode(found(F.col(text))).alias("value")).withColumn("kind", kind_of(F.col("value")))
    return hits.groupBy("kind", canonical(F.col("kind"), F.col("value")).alias("canon")).agg(F.min("value").alias("value"))


def salts(docs: DataFrame, text: str, key: str) -> DataFrame | None:
    """(kind, canon, salt) of the entities whose surrogate needs one; None when no surrogate clashes.

    Works on distinct entities. Every round salts anew what clashes, so it ends when nothing does.
    """
    known = cut_lineage(entities(docs, text).withColumn("salt", F.lit(0)))
    while True:
        made = canonical(F.col("kind"), surrogate(key, F.col("kind"), F.col("value"), F.col("salt")))
        rows = cut_lineage(known.withColumn("_s", made))
        shared = rows.groupBy("kind", "_s").agg(F.min("canon").alias("_first"), F.count("*").alias("_n"))
        real = rows.select("kind", F.col("canon").alias("_s"), F.lit(True).alias("_real"))
        clashes = cut_lineage(shared.join(real, ["kind", "_s"], "left").where((F.col("_n") > 1) | F.col("_real")))
        if clashes.isEmpty():
            return known.where("salt > 0").select("kind", "canon", "salt") if not known.where("salt > 0").isEmpty() else None
        moves = F.col("_n").isNotNull() & (F.col("_real").isNotNull() | (F.col("canon") != F.col("_first")))
        known = cut_lineage(rows.join(clashes, ["kind", "_s"], "left").select(
            "kind", "canon", "value", (F.col("salt") + moves.cast("int")).alias("salt")))


def replace_entities(docs: DataFrame, row_key: str, text: str, key: str, salted: DataFrame | None) -> DataFrame:
    """``docs`` with surrogates in ``text``, and ``pii``: (kind, surrogate) of every entity in order."""
    docs = docs.drop("pii", "_pii_hits", "_pii_salts", "_pii_key")
    if salted is not None:
        hits = docs.select(F.col(row_key).alias("_pii_key"), F.explode(found(F.col(text))).alias("value"))
        hits = hits.withColumn("kind", kind_of(F.col("value")))
        hits = hits.withColumn("canon", canonical(F.col("kind"), F.col("value"))).join(salted, ["kind", "canon"])
        entry = F.struct(F.concat_ws("|", "kind", "canon").alias("k"), F.col("salt").alias("v"))
        own = hits.groupBy("_pii_key").agg(F.map_from_entries(F.collect_set(entry)).alias("_pii_salts"))
        docs = docs.join(own, F.col(row_key).eqNullSafe(F.col("_pii_key")), "left").drop("_pii_key")
    else:
        docs = docs.withColumn("_pii_salts", F.lit(None).cast("map<string,int>"))
    docs = docs.withColumn("_pii_hits", F.transform(found(F.col(text)), lambda v: F.struct(kind_of(v).alias("kind"), v.alias("value"))))

    def swap(h: Column) -> Column:
        label = F.concat_ws("|", h["kind"], canonical(h["kind"], h["value"]))
        salt = F.coalesce(F.element_at("_pii_salts", label), F.lit(0))
        return F.struct(h["kind"].alias("kind"), surrogate(key, h["kind"], h["value"], salt).alias("surrogate"))

    docs = docs.withColumn("pii", F.transform("_pii_hits", swap))
    gaps = F.split(F.col(text), F.lit(ANY), -1)
    whole = F.array_join(F.zip_with(gaps, F.col("pii"), lambda g, h: F.concat(g, F.coalesce(h["surrogate"], F.lit("")))), "")
    return docs.withColumn(text, F.when(F.size("pii") == 0, F.col(text)).otherwise(whole)).drop("_pii_hits", "_pii_salts")


def protect(docs: DataFrame, row_key: str, text: str, key: str) -> DataFrame:
    """``docs`` with every entity of ``text`` replaced; see ``replace_entities`` for the columns."""
    return replace_entities(docs, row_key, text, key, salts(docs, text, key))
