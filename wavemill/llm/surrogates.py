"""Personal data: detected entities get keyed surrogates of the same type and form. DataFrame functions only.

One pattern finds all entities of a text. An entity's identity (its type and its digits, or its lower-case form) is hashed
with a key; the digest gives the surrogate's characters, digit for digit and letter for letter, so equal entities have equal
surrogates everywhere, whatever their punctuation or case. A secret is whatever follows its label up to the delimiter, however
long, and all of its characters are drawn.

Names are found by their titles. Given names and surnames have identities of their own, so that "Anna Schmidt" and "Schmidt"
share a surname afterwards, and words of a titled name are replaced wherever else the same text has them (unless it also has
them in lower case: such a word is an ordinary one). Given names keep the gender that the title tells in that text, and names
their script. Surrogates that two identities share, or that are themselves an identity of the corpus, are drawn again; they get
longer then, so their forms don't run out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

#: Rounds after which surrogates of a fixed form get longer, and after which there can't be enough forms at all.
FIXED_ROUNDS, ROUNDS = 6, 60
LOWER = "abcdefghijklmnopqrstuvwxyz"
# Titles with the gender they tell, in four languages and Cyrillic.
TITLES = {"m": ("Mr", "Herr", "Monsieur", "M", "Señor", "Sr", "господин", "г-н"), "n": ("Dr", "Prof", "Professor", "Doktor", "доктор"), "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "госпожа", "г-жа")}
GIVEN = {
    ("m", "Latin"): ("Adrian", "Bruno", "Carl", "David", "Emil", "Felix", "Gabriel", "Hugo", "Ivan", "Julian", "Leo", "Martin", "Nils", "Oscar", "Paul", "Simon"),
    ("f", "Latin"): ("Alma", "Bianca", "Clara", "Diana", "Elena", "Flora", "Greta", "Helena", "Ines", "Julia", "Laura", "Maria", "Nora", "Olivia", "Paula", "Sara"),
    ("m", "Cyrillic"): ("Андрей", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Кирилл", "Лев", "Максим", "Никита", "Олег", "Павел", "Роман", "Семён", "Юрий"),
    ("f", "Cyrillic"): ("Анна", "Вера", "Галина", "Дарья", "Елена", "Жанна", "Зоя", "Ирина", "Ксения", "Лариса", "Марина", "Нина", "Ольга", "Полина", "София", "Юлия"),
}
SYLLABLES = {"Latin": ("ba", "be", "da", "do", "ka", "ke", "la", "lo", "ma", "mi", "na", "no", "ra", "ro", "ta", "vi"), "Cyrillic": ("ба", "ве", "да", "до", "ка", "ке", "ла", "ло", "ма", "ми", "на", "но", "ра", "ро", "та", "ви")}

_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_NAME = r"[A-ZÀ-ÖØ-ÞА-ЯЁ][a-zß-öø-ÿа-яё]+"
_EMAIL = r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,24}"
#: The type of what was found and is no entity: it stays as it is.
PLAIN = "plain"
_TITLE = "|".join(t for ts in TITLES.values() for t in ts)
_CARD = r"\d{4}(?<sa>[ -]?)\d{4}\k<sa>\d{4}\k<sa>\d{4}|3[47]\d\d(?<sb>[ -]?)\d{6}\k<sb>\d{5}"
_IP6 = r"(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}"
_IBAN = r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?"
#: Types in the order in which they are tried at a place. Secrets come first: another type could take a part of one.
PATTERNS = {
    "token": r"(?<=token = \x22)[0-9a-f]{20,}+(?=\x22)|(?<=token=)[0-9A-Za-z_-]{12,}+(?:[.~+/]++[0-9A-Za-z_-]++)*+=*+",
    "password": r"(?<=password=)[^\s\x22']{4,}+",
    "email": rf"(?<![A-Za-z0-9._%+-]){_EMAIL}",
    "key": r"\bAKIA[0-9A-Z]{16}\b",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "ip": rf"(?<![\d.vV])(?<!ersion )(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?\d)",
    "ip6": rf"(?<![0-9A-Fa-f:]){_IP6}(?![0-9A-Fa-f:])",
    "phone": r"(?<![\d+])\+\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\d(])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\d-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])",
    "card": rf"(?<![\d.-])(?:{_CARD})(?![\d-])",
    "iban": rf"\b{_IBAN}\b",
    "name": rf"(?=[A-ZÀ-ÖØ-ÞА-ЯЁ])(?<=(?<![\p{{L}}\p{{N}}])(?:{_TITLE})\.? ){_NAME}(?: {_NAME})?",
}
FOUND = "|".join(f"(?:{p})" for p in PATTERNS.values())
SECRETS = f"{PATTERNS['token']}|{PATTERNS['password']}"
TITLED = rf"(?<![\p{{L}}\p{{N}}])({_TITLE})\.? ({_NAME}(?: {_NAME})?)"
#: What every entity has one of, besides a digit or an at sign; texts without any hold none.
HINTS = ("AKIA", "token=", 'token = "', "password=", *(f"{t}{end}" for ts in TITLES.values() for t in ts for end in (" ", ". ")))


def hinted(text: Column) -> Column:
    """Whether a text may hold an entity: plain searches, which are much cheaper than the pattern."""
    out = text.rlike("[@0-9]")
    for h in HINTS:
        out = out | text.contains(h)
    return out


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _checked(digits: Column) -> Column:
    """Whether the last digit is the check digit of the others."""
    return _luhn(F.substring(digits, F.lit(1), F.length(digits) - 1)) == F.right(digits, F.lit(1))


def kind(e: Column) -> Column:
    """The type of a found entity that is no labelled secret, from its own form; a number of a card's length whose check digit is
    wrong is none."""
    out = F.when(e.rlike("@"), "email").when(e.rlike("^AKIA[0-9A-Z]{16}$"), "key").when(e.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
    out = out.when(e.rlike(rf"^(?:{_OCTET}\.){{3}}{_OCTET}$"), "ip").when(e.rlike(rf"^{_IP6}$"), "ip6").when(e.rlike(rf"^(?:{_CARD})$"), F.when(_checked(_digits(e)), "card").otherwise(PLAIN)).when(e.rlike(rf"^{_IBAN}$"), "iban")
    out = out.when(e.rlike(r"^[+(\d][\d ().-]+$") & (F.length(_digits(e)) >= 7) & e.rlike(r"[ ().+-]"), "phone")
    return out.when(e.rlike(rf"^{_NAME}(?: {_NAME})?$"), "name").otherwise("secret")


def identity(e: Column, t: Column) -> Column:
    """What makes two entities of a type the same: the last ten digits of a phone number, all digits of a card, else the
    form, in lower case for e-mail addresses and names. The digits are those that are written anew."""
    digits = _digits(e)
    lower = t.isin("email", "ip6", "surname") | t.startswith("given")
    return F.when(t == "phone", F.right(digits, F.lit(10))).when(t.isin("card", "ssn"), digits).when(t == "iban", F.replace(e, F.lit(" "))).when(lower, F.lower(e)).otherwise(e)


def _digest(key: str, t: Column, who: Column, attempt: Column) -> Column:
    return F.concat(*[F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit(part), t, who, attempt.cast("string")), 256) for part in ("a", "b")])


def _byte(h: Column, i: Column | int) -> Column:
    """The i-th (from 0, modulo the digest's 64) byte of a hex digest."""
    at = (F.lit(i) if isinstance(i, int) else i) % 64
    return F.conv(F.substring(h, at * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where the value is computed once however often it is used, in lambdas too."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _alike(s: Column, h: Column, rest: str = "") -> Column:
    """Digit for digit, hex letters for hex letters if there are no others, letter for letter; other characters stay, or
    become one of `rest`."""
    hexed = s.rlike("^[0-9a-f]*$") & s.rlike("[a-f]")
    pick = lambda i, letters: F.substring(F.lit(letters), _byte(h, i) % len(letters) + 1, F.lit(1))

    def swap(c: Column, i: Column) -> Column:
        out = F.when(c.rlike("[0-9]"), pick(i, "0123456789")).when(c.rlike("[a-z]"), pick(i, LOWER)).when(c.rlike("[A-Z]"), pick(i, LOWER.upper()))
        return out.otherwise(pick(i, rest) if rest else c)

    letters = F.split(s, "")
    return F.array_join(F.when(hexed, F.transform(letters, lambda c, i: pick(i, "0123456789abcdef"))).otherwise(F.transform(letters, swap)), "")


def _luhn(digits: Column) -> Column:
    """The check digit after all others."""
    last = F.length(digits) - 1
    total = F.aggregate(F.transform(F.split(digits, ""), lambda c, i: F.when((last - i) % 2 == 0, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int"))), F.lit(0), lambda a, x: a + x)
    return ((F.lit(10) - total % 10) % 10).cast("string")


def _syllables(h: Column, n: Column, script: str) -> Column:
    some = F.array(*map(F.lit, SYLLABLES[script]))
    return F.array_join(F.transform(F.sequence(F.lit(1), n), lambda k: F.element_at(some, _byte(h, k) % 16 + 1)), "")


def _surname(who: Column, h: Column, attempt: Column) -> Column:
    """Four syllables and one for each attempt; Cyrillic ones end as the name's gender asks."""
    latin = F.concat(_syllables(h, attempt + 4, "Latin"), F.lit("n"))
    cyrillic = F.concat(_syllables(h, attempt + 4, "Cyrillic"), F.when(who.rlike("[ая]$"), "ова").otherwise("ов"))
    return F.when(who.rlike("[а-яё]"), cyrillic).otherwise(latin)


def _given(who: Column, t: Column, h: Column, attempt: Column) -> Column:
    """A given name of the gender, after syllables from the second attempt on: the ending tells the gender."""

    def build(script: str) -> Column:
        pick = lambda names: F.element_at(F.array(*map(F.lit, names)), _byte(h, 0) % len(names) + 1)
        m, f = GIVEN["m", script], GIVEN["f", script]
        name = F.when(t == "given-m", pick(m)).when(t == "given-f", pick(f)).otherwise(pick(m + f))
        return F.lower(F.when(attempt > 0, F.concat(_syllables(h, attempt + 1, script), name)).otherwise(name))

    return F.when(who.rlike("[а-яё]"), build("Cyrillic")).otherwise(build("Latin"))


def drawn(t: Column, who: Column, key: str, attempt: Column) -> Column:
    """The surrogate identity of an identity. Digits in a fixed form get a tail after a dash when all else collided."""

    def build(h: Column) -> Column:
        local, domain = F.split_part(who, F.lit("@"), F.lit(1)), F.split_part(who, F.lit("@"), F.lit(2))
        card = F.concat(F.substring(who, 1, 2), _alike(F.substring(who, F.lit(3), F.length(who) - 3), h))
        ip = F.concat_ws(".", *[(_byte(h, k) % 223 + 1).cast("string") for k in range(4)])
        phone = F.concat((_byte(h, 40) % 8 + 2).cast("string"), _alike(F.substring(who, 2, 9), h))
        ip6 = F.array_join(F.transform(F.split(who, ""), lambda c, i: F.when(c == ":", c).otherwise(F.substring(F.lit("0123456789abcdef"), _byte(h, i) % 16 + 1, F.lit(1)))), "")
        more = F.substring(h, F.lit(65), F.greatest(attempt - 2, F.lit(0)) * 2)  # the entity's own length has had its tries
        tail = F.when(attempt > FIXED_ROUNDS, F.concat(F.lit("-"), F.substring(h, F.lit(65), (attempt - FIXED_ROUNDS) * 2))).otherwise("")
        out = F.when(t == "email", F.concat(_alike(local, h), F.lit("@"), _alike(F.split_part(domain, F.lit("."), F.lit(1)), F.reverse(h)), more, F.lit(".example.net")))
        out = out.when(t == "card", F.concat(card, _luhn(card), tail)).when(t == "ip", ip).when(t == "ip6", ip6).when(t == "phone", F.concat(phone, tail))
        out = out.when(t == "key", F.concat(F.lit("AKIA"), _alike(F.substring(who, 5, 16), h), tail)).when(t == "ssn", F.concat(_alike(who, h), tail))
        out = out.when(t == "iban", F.concat(F.substring(who, 1, 2), _alike(F.substring(who, 3, 64), h), tail))
        out = out.when(t == "surname", _surname(who, h, attempt)).when(t.startswith("given"), _given(who, t, h, attempt))
        return out.otherwise(F.concat(_alike(who, h, LOWER), more))

    return _let(_digest(key, t, who, attempt), build)


def _fill(e: Column, digits: Column) -> Column:
    """e with its last digits replaced, from the right."""
    back = F.aggregate(
        F.split(F.reverse(e), ""),
        F.struct(F.lit("").alias("s"), F.lit(1).alias("i")),
        lambda a, c: F.when(c.rlike("[0-9]") & (a["i"] <= F.length(digits)), F.struct(F.concat(a["s"], F.substring(F.reverse(digits), a["i"], F.lit(1))).alias("s"), (a["i"] + 1).alias("i"))).otherwise(F.struct(F.concat(a["s"], c).alias("s"), a["i"].alias("i"))),
        lambda a: F.reverse(a["s"]),
    )
    return back


def _spaced(e: Column, sur: Column) -> Column:
    """sur with a space wherever e has one."""
    return F.aggregate(
        F.split(e, ""),
        F.struct(F.lit("").alias("s"), F.lit(1).alias("i")),
        lambda a, c: F.when(c == " ", F.struct(F.concat(a["s"], c).alias("s"), a["i"].alias("i"))).otherwise(F.struct(F.concat(a["s"], F.substring(sur, a["i"], F.lit(1))).alias("s"), (a["i"] + 1).alias("i"))),
        lambda a: F.concat(a["s"], F.substring(sur, a["i"], F.lit(64))),
    )


def formed(e: Column, t: Column, sur: Column) -> Column:
    """The surrogate identity in the form of the entity."""
    upper = (e == F.upper(e)) & e.rlike("[A-Z]")
    tail = F.when(sur.contains("-"), F.concat(F.lit("-"), F.split_part(sur, F.lit("-"), F.lit(2)))).otherwise("")
    out = F.when(t.isin("phone", "card", "ssn"), F.concat(_fill(e, F.split_part(sur, F.lit("-"), F.lit(1))), tail)).when(t == "iban", _spaced(e, sur))
    return out.when((t == "surname") | t.startswith("given"), F.initcap(sur)).when(t.isin("email", "ip6") & upper, F.upper(sur)).otherwise(sur)


def mapping(found: DataFrame, key: str) -> DataFrame:
    """(t, who, sur) for distinct identities (t, who): within a type, no two share a sur and no sur is a who."""
    ids = staged(found.select("t", "who").distinct().withColumn("attempt", F.lit(0)))
    for _ in range(ROUNDS):
        now = ids.withColumn("sur", drawn(F.col("t"), F.col("who"), key, F.col("attempt")))
        taken = now.groupBy("t", "sur").agg(F.min("who").alias("owner"), F.count("*").alias("n"))
        real = ids.select("t", F.col("who").alias("sur"), F.lit(True).alias("real"))
        clash = taken.join(real, ["t", "sur"], "left").where("n > 1 or real").select("t", "sur", "owner", F.coalesce("real", F.lit(False)).alias("real"))
        clash = staged(clash)
        if not clash.limit(1).count():
            return now.select("t", "who", "sur")
        again = now.join(clash, ["t", "sur"], "left").withColumn("again", F.coalesce(F.col("real") | (F.col("who") != F.col("owner")), F.lit(False)))
        ids = staged(again.select("t", "who", (F.col("attempt") + F.col("again").cast("int")).alias("attempt")))
    raise ValueError("a type has about as many identities as forms: addresses of 32 bits are the only one that can")


def _named(text: Column) -> Column:
    """Words of titled names of a text: (w, role, g) with the gender of their title."""
    title, name = F.regexp_extract_all(text, F.lit(TITLED), F.lit(1)), F.regexp_extract_all(text, F.lit(TITLED), F.lit(2))
    gender = lambda t: F.when(t.isin(*TITLES["f"]), "f").when(t.isin(*TITLES["m"]), "m").otherwise("n")
    word = lambda w, role, g: F.struct(w.alias("w"), F.lit(role).alias("role"), g.alias("g"))

    def words(t: Column, n: Column) -> Column:
        parts = F.split(n, " ")
        return F.when(F.size(parts) == 2, F.array(word(parts[0], "given", gender(t)), word(parts[1], "surname", gender(t)))).otherwise(F.array(word(parts[0], "surname", gender(t))))

    return F.flatten(F.zip_with(title, name, words))


def _pattern(text: Column, named: Column) -> Column:
    """FOUND, and the words of titled names wherever they stand."""
    padded = F.concat(F.lit(" "), text, F.lit(" "))
    own = F.filter(F.array_distinct(F.transform(named, lambda x: x["w"])), lambda w: ~padded.contains(F.concat(F.lit(" "), F.lower(w), F.lit(" "))))
    more = F.concat(F.lit(FOUND + r"|(?<![\p{L}\p{N}])(?:"), F.array_join(own, "|"), F.lit(r")(?![\p{L}\p{N}])"))
    return F.when(F.size(own) > 0, more).otherwise(F.lit(FOUND))


def _typed(e: Column, named: Column) -> Column:
    """(t, w) of the parts of a found entity: one, or the two words of a name."""
    role = lambda w, r: F.filter(named, lambda x: (x["w"] == w) & (x["role"] == r))
    given = lambda w: F.concat(F.lit("given-"), F.coalesce(F.get(role(w, "given"), F.lit(0))["g"], F.lit("n")))
    part = lambda t, w: F.struct(t.alias("t"), w.alias("w"))
    words = F.split(e, " ")
    single = F.when((F.size(role(e, "given")) > 0) & (F.size(role(e, "surname")) == 0), given(e)).otherwise("surname")
    name = F.when(F.size(words) == 2, F.array(part(given(words[0]), words[0]), part(F.lit("surname"), words[1]))).otherwise(F.array(part(single, e)))
    return F.when(kind(e) == "name", name).otherwise(F.array(part(kind(e), e)))


def replaced(docs: DataFrame, key: str) -> DataFrame:
    """`docs` with entities replaced in text, and n_entities (long) and entity_types (sorted, comma-joined) added.

    Whoever has `key` can tell which surrogate an entity gets: it is a secret of the caller. Null texts stay null; texts
    without entities stay as they are. Rows with the same text get the same result. Columns of `docs` with one of the added
    names give way to them, others may have any name. n_chars, where there is one, follows the new text.
    """
    names = [c for c in docs.columns if c not in ("n_entities", "entity_types")]
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("text"))
    has = F.coalesce(hinted(F.col("text")) & F.col("text").rlike(FOUND), F.lit(False))
    some = base.where(has).select("row", "text", F.md5("text").alias("at"))
    texts = some.select("at", "text").dropDuplicates(["at"]).withColumn("named", F.when(F.col("text").rlike(TITLED), _named(F.col("text"))).otherwise(F.expr("cast(array() as array<struct<w:string,role:string,g:string>>)")))
    texts = texts.withColumn("pattern", _pattern(F.col("text"), F.col("named")))
    secrets = F.when(F.col("text").contains("password=") | F.col("text").contains("token"), F.regexp_extract_all("text", F.lit(SECRETS), F.lit(0)))
    texts = texts.select("at", "named", "pattern", secrets.alias("secrets"), F.regexp_extract_all("text", F.col("pattern"), F.lit(0)).alias("es"))
    parts = texts.select("at", "named", "pattern", "secrets", F.posexplode("es").alias("place", "e"))
    typed = F.when(F.array_contains("secrets", F.col("e")), F.array(F.struct(F.lit("secret").alias("t"), F.col("e").alias("w")))).otherwise(_typed(F.col("e"), F.col("named")))
    pattern = F.when(F.col("pattern") != FOUND, F.col("pattern"))  # most texts have the one that all know
    parts = parts.select("at", pattern.alias("pattern"), "place", F.posexplode(typed).alias("k", "x")).select("at", "pattern", "place", "k", F.col("x.t").alias("t"), F.col("x.w").alias("e"))
    parts = staged(parts.withColumn("who", identity(F.col("e"), F.col("t"))))
    sur = mapping(parts.where(F.col("t") != PLAIN), key)
    written = F.when(F.col("t") == PLAIN, F.col("e")).otherwise(formed(F.col("e"), F.col("t"), F.col("sur")))
    new = parts.join(sur, ["t", "who"], "left").select("at", "pattern", F.struct("place", "k", written.alias("s"), "t").alias("x"))
    new = new.groupBy("at").agg(F.max("pattern").alias("pattern"), F.array_sort(F.collect_list("x")).alias("new"))
    real = F.filter("new", lambda x: x["t"] != PLAIN)
    kinds = F.transform(real, lambda x: F.when((x["t"] == "surname") | x["t"].startswith("given"), "name").otherwise(x["t"]))
    # Each word of a name is preceded by what stands between it and the entity before: a space inside a name.
    new = new.withColumn("s", F.transform("new", lambda x: F.concat(F.when(x["k"] > 0, F.lit(" ")).otherwise(F.lit("\x00")), x["s"]))).withColumn("types", F.concat_ws(",", F.array_sort(F.array_distinct(kinds)))).withColumn("n", F.size(F.filter(real, lambda x: x["k"] == 0)).cast("long"))
    new = new.select("at", "pattern", "types", "n", F.slice(F.split(F.array_join("s", ""), "\x00"), 2, 1 << 30).alias("s"))
    pieces = F.split("text", F.coalesce("pattern", F.lit(FOUND)), -1)
    tail = F.concat("s", F.array(F.lit("")))
    done = some.join(new, "at").select("row", F.array_join(F.zip_with(pieces, tail, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "").alias("text"), F.col("n").alias("n_entities"), F.col("types").alias("entity_types"))
    out = done.unionByName(base.where(~has).select("row", "text", F.lit(0).cast("long").alias("n_entities"), F.lit("").alias("entity_types")))
    chars = lambda c: F.char_length("text").cast(docs.schema[c].dataType) if c == "n_chars" else F.col("row")[c]
    return out.select(*[(F.col("text") if c == "text" else chars(c)).alias(c) for c in names], "n_entities", "entity_types")
