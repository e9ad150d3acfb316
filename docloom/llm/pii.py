"""Surrogates for personal data: keyed, consistent and distinct, in DataFrame expressions only.

Entities (e-mail, phone, IP address, card number, IBAN, social security number, person) are found by one pattern. Each
distinct entity gets a surrogate from a keyed SHA-256 of its normal form, so that the
same entity has the same surrogate in every document and run, however it is written: normal forms of phone,
card and account numbers have no separators ("+" and "00" before a country code are one), others no
letter case. The surrogate is put into each occurrence's own separators and case. Digits become
digits, letters letters of the same script; country codes, top-level domains and
octet widths stay, and so do the zero or the one before an area code; a card number that passes the Luhn test still does.
A person is a title or a listed given name and the run of capitalised names and particles after it ("Dr. Wolfgang Schmidt", "John von Neumann", "MARIA GARCIA");
every name of the run is replaced. Listed given names go to another one of the same gender and script by a keyed cycle through the list, other given names
to made-up ones; family names are replaced apart from given names, vowels by vowels and consonants by consonants, so that "Ms Roth" and "Anna Roth" stay one family.
A surrogate that equals another one or any entity of the corpus is drawn again, until all are distinct. Where a
form has too few values for that (one-digit octets, names of two letters), it is widened after each
WIDEN draws: octets take any width, others one character more.

Phone numbers are found with a country code after "+", with an area code in brackets, with a leading zero
(9 to 13 digits), and without one in groups of 3-3-4 or 3-2-2-2. Local numbers without an area code and
nine digits in threes stay in the text: they can't be told from other numbers. E-mail addresses have up to 64
characters before "@" and up to ten labels after it; what is longer is no address. Of two capitalised words after a name the second
counts as a name too, so a noun that follows a German name without a comma is replaced with it. Names without a title whose
given name isn't listed stay in the text: telling them from other capitalised words needs a model of the language. Of an IPv6 address each spelling is an entity of its own.

The key is the caller's secret: an argument, or the setting spark.docloom.pii.key.

Defined cases: null texts stay null, texts without entities come back as they are, very long texts and tokens are
read whole. Rows are judged one by one, so repeated rows come back repeated; an entity's letter case carries over.
Of two entities that draw one surrogate (a tie) the smaller normal form keeps it. Empty
tables give empty results. Other columns pass through; those named like the added ones are replaced.
"""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import forget, let, quoted, without, written

KEY_SETTING = "spark.docloom.pii.key"
#: Draws of one width before a surrogate may be wider than its entity.
WIDEN = 8
ADDED = ("n_entities", "entity_types")

# Given names by gender and script.
GIVEN = {
    ("f", "latin"): "Anna Maria Laura Julia Sophie Emma Clara Lucia Elena Marta Carmen Ines Camille Chloe Manon Alice Emily Sarah Jessica Karen Linda Susan Nancy Lisa Sandra Helga Ingrid Ursula Monika Petra Mary Jennifer Elizabeth Barbara Margaret Patricia Sabine Claudia Isabel Pilar Marie Nathalie Priya Fatima Mei".split(),
    ("m", "latin"): "John Peter Paul Michael Thomas David James Robert William Richard Hans Klaus Jürgen Stefan Andreas Carlos Miguel Jose Luis Javier Pablo Pierre Jean Jacques Louis Antoine Marc Kevin Brian Steven Charles Joseph Daniel George Edward Wolfgang Matthias Francisco Antonio François Philippe Rahul Ahmed Mohammed Wei".split(),
    ("f", "cyrillic"): "Анна Мария Елена Ольга Наталья Ирина Татьяна Светлана Екатерина Юлия".split(),
    ("m", "cyrillic"): "Иван Пётр Алексей Дмитрий Сергей Андрей Николай Михаил Владимир Олег".split(),
}
TITLES = "Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|Señor|Señora|Sr|Sra"
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
NAME = r"\p{Lu}[\p{L}'’-]+"
# A name that follows another one; words in capitals alone do so only where the name before is in capitals.
NEXT = r"(?:\p{Lu}['’])?\p{Lu}\p{Ll}[\p{L}'’-]*"
LOUD = r"\p{Lu}{2}[\p{Lu}'’-]*"
PARTICLES = "von|van|de|del|della|der|den|di|da|dos|du|la|le|zu|zur|bin|al|el"
# Where a phone number without "+" may start and end: not inside longer numbers.
_START, _END = r"(?<![\w+])(?<!\d[.,/-])", r"(?!\w|[./-]\d)"
PHONES = (
    r"(?<![\w+])\+\d{1,3}[ ./-]?(?:\(\d{1,4}\)[ ./-]?)?\d{1,4}(?:[ ./-]?\d{2,4}){1,4}(?!\w)",
    rf"(?<![\w+(])\((?:0|\d{{2,5}})\)[ ./-]?\d(?:[ ./-]?\d){{5,9}}{_END}",
    rf"{_START}(?!\d\d?[./-]\d\d?[./-]\d{{4}}(?!\d))0(?=0?[1-9])\d(?:[ ./-]?\d){{7,11}}{_END}",
    rf"{_START}(?:1[ .-])?\d{{3}}[ .-]\d{{3}}[ .-]\d{{4}}{_END}",
    rf"{_START}[6-9]\d\d(?:[ .-]\d\d){{3}}{_END}",
)
_GIVEN = "|".join(n for names in GIVEN.values() for n in names)
_UPPER_GIVEN = "|".join(n.upper() for names in GIVEN.values() for n in names)
_RUN = rf"(?: (?:{PARTICLES})){{0,3}} {NEXT}(?![\p{{L}}'’-])"
HEX = "[0-9A-Fa-f]{1,4}"
PATTERNS = {
    # bounded repeats: Java matches a repeated group by recursion, and a text of endless labels would end the JVM
    "email": r"(?<![\p{L}\p{N}])[\p{L}\p{N}][\p{L}\p{N}._%+-]{0,63}@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.){1,10}[A-Za-z]{2,24}",
    "ip6": rf"(?<![\w:.])(?:(?:{HEX}:){{7}}{HEX}|(?:{HEX}:){{1,6}}(?::{HEX}){{1,6}})(?![\w:])",
    "ip": rf"(?<![\w.]){OCTET}(?:\.{OCTET}){{3}}(?![\w]|\.\d)",
    "national": r"(?<![\w.,/-])\d{3}-\d{2}-\d{4}(?![\w/-]|\.\d)",
    "phone": "|".join(PHONES),
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "card": r"(?<!\w)\d(?:[ -]?\d){12,18}(?!\w)",
    "person": rf"(?<!\p{{L}})(?=\p{{Lu}})(?:(?:{TITLES})\.? (?:(?:{PARTICLES}) ){{0,3}}(?:(?:{_GIVEN}) ){{0,3}}{NAME}(?:{_RUN}){{0,2}}|(?:(?:{_GIVEN}) ){{1,3}}(?:(?:{PARTICLES}) ){{0,3}}{NAME}(?:{_RUN}){{0,2}}|(?:(?:{_UPPER_GIVEN}) ){{1,3}}{LOUD})(?![\p{{L}}])",
}
ANY = "|".join(PATTERNS.values())
# Lengths of country calling codes by their first digits.
CALLING = r"[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3}"
VOWELS = {"latin": "aeiou", "cyrillic": "аеиоуыэюя", "greek": "αεηιουω"}


def kind_of(entity: Column) -> Column:
    found = F.lit("person")
    for name in ("card", "iban", "phone", "national", "ip", "ip6", "email"):
        found = F.when(entity.rlike(rf"\A(?:{PATTERNS[name]})\z"), name).otherwise(found)
    return found


def given_cycle(key: str) -> dict[str, str]:
    """Each given name to the next of its gender and script in a keyed order."""
    out = {}
    for names in GIVEN.values():
        order = sorted(names, key=lambda n: hmac.new(key.encode(), n.encode(), hashlib.sha256).digest())
        out |= {a: b for a, b in zip(order, order[1:] + order[:1], strict=True)}
    return out


def stream(key: str, value: Column, attempt: Column) -> Column:
    """Numbers from 0 to 255, as many as the value has characters and more."""
    message = lambda j: F.concat_ws("|", F.lit(key), value, attempt.cast("string"), j.cast("string"))
    block = lambda j: F.sha2(F.concat(F.lit(key[::-1]), F.sha2(message(j), 256)), 256)
    digest = F.array_join(F.transform(F.sequence(F.lit(0), F.floor(F.length(value) / 32).cast("int")), block), "")
    return let(digest, lambda d: F.transform(F.sequence(F.lit(0), F.length(value)), lambda i: F.conv(F.substring(d, 2 * i + 1, 2), 16, 10).cast("int")))


def masked(value: Column, numbers: Column, keep: Column, spoken: bool = False) -> Column:
    """Digits to digits and letters to letters of their script and case, where keep(place) is not set.

    spoken: vowels to vowels and consonants to consonants.
    """

    def char(c: Column, n: Column, kept: Column) -> Column:
        letters = "abcdefghijklmnopqrstuvwxyz"
        cyrillic = "абвгдежзийклмнопрстуфхцчшщыьэюя"
        greek = "αβγδεζηθικλμνξοπρστυφχψω"

        def pick(alphabet: str) -> Column:
            of = lambda letters: F.substring(F.lit(letters), n % len(letters) + 1, 1)
            vowels = next((v for v in VOWELS.values() if v[0] in alphabet), "")
            if not spoken or not vowels:
                return of(alphabet)
            return F.when(F.lower(c).rlike(f"[{vowels}äöüáàâéèêëíìîïóòôúùûåæøœё]"), of(vowels)).otherwise(of("".join(x for x in alphabet if x not in vowels)))

        return (
            F.when(kept, c)
            .when(c.rlike("[0-9]"), pick("0123456789"))
            .when(c.rlike(r"\p{IsLatin}") & (F.upper(c) == c), F.upper(pick(letters)))
            .when(c.rlike(r"\p{IsLatin}"), pick(letters))
            .when(c.rlike(r"\p{IsCyrillic}") & (F.upper(c) == c), F.upper(pick(cyrillic)))
            .when(c.rlike(r"\p{IsCyrillic}"), pick(cyrillic))
            .when(c.rlike(r"\p{IsGreek}") & (F.upper(c) == c), F.upper(pick(greek)))
            .when(c.rlike(r"\p{IsGreek}"), pick(greek))
            .when(c.rlike(r"\p{IsHan}"), F.substring(F.lit("王李张刘陈杨黄赵吴周徐孙马朱胡郭何林高罗"), n % 20 + 1, 1))
            .otherwise(c)
        )

    # both lists are worked out once, not once for each character
    every = lambda n: let(keep, lambda k: F.transform(F.split(value, ""), lambda c, i: char(c, n[i], F.array_contains(k, i))))
    return F.array_join(let(numbers, every), "")


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a digit string."""
    n = F.length(digits)
    at = lambda i: F.substring(digits, i, 1).cast("int")
    double = lambda x: F.when(x > 4, 2 * x - 9).otherwise(2 * x)
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: acc + F.when((n - i) % 2 == 1, double(at(i))).otherwise(at(i)))


def with_luhn(card: Column, original: Column) -> Column:
    """The last digit set so that the number passes the Luhn test, if the original does."""
    only = lambda c: F.regexp_replace(c, "[^0-9]", "")
    head = F.regexp_replace(card, r"\d$", "0")
    digit = (10 - luhn_sum(only(head)) % 10) % 10
    return F.when(luhn_sum(only(original)) % 10 == 0, F.concat(F.regexp_replace(card, r"\d$", ""), digit.cast("string"))).otherwise(card)


def surrogate(kind: Column, norm: Column, attempt: Column, key: str) -> Column:
    """The surrogate of an entity's normal form (see normal)."""
    none = F.array().cast("array<int>")
    more = F.floor(attempt / WIDEN).cast("int")
    wide = lambda value: F.concat(value, F.repeat(F.substring(value, -1, 1), more))
    domain = F.regexp_extract(norm, "@.*$", 0)
    plain = lambda value, keep, **how: masked(wide(value), stream(key, F.concat(kind, F.lit(":"), wide(value)), attempt), keep, **how)
    places = lambda first, last: F.sequence(first, last)
    prefix = F.length(F.regexp_extract(norm, rf"^\+(?:{CALLING})|^0|^1(?=\d{{10}}$)", 0))
    top = F.length(F.regexp_extract(domain, r"\.[a-z]+$", 0))
    # the domain by itself, so that addresses at one domain stay at one domain
    domain_out = masked(domain, stream(key, F.concat(F.lit("domain:"), domain), F.lit(0)), places(F.length(domain) - top, F.length(domain)))
    numbers = stream(key, F.concat(kind, F.lit(":"), norm), attempt)
    octet = lambda o, n: F.when(more > 0, n).when(F.length(o) == 1, n % 10).when(F.length(o) == 2, 10 + n % 90).otherwise(100 + n % 156)
    phone = plain(norm, F.when(prefix > 0, places(F.lit(0), prefix - 1)).otherwise(none))
    # no zero after the prefix: it would read as another prefix
    phone = let(phone, lambda p: F.concat(F.substr(p, F.lit(1), prefix), F.translate(F.substr(p, prefix + 1, F.lit(1)), "0", "5"), F.substr(p, prefix + 2)))
    return (
        F.when(kind == "email", F.concat(plain(F.regexp_extract(norm, "^[^@]*", 0), none), domain_out))
        .when(kind == "ip", let(numbers, lambda n: F.array_join(F.transform(F.split(norm, r"\."), lambda o, i: octet(o, n[i]).cast("string")), ".")))
        .when(kind == "ip6", let(numbers, lambda n: F.array_join(F.transform(F.split(wide_hex(norm, more), ""), lambda c, i: F.when(c == ":", c).otherwise(F.lower(F.hex(F.get(n, i) % 16)))), "")))
        .when(kind == "national", plain(norm, none))
        .when(kind == "phone", phone)
        .when(kind == "iban", plain(norm, places(F.lit(0), F.lit(1))))
        .when(kind == "card", with_luhn(plain(norm, none), norm))
        .otherwise(plain(norm, none, spoken=True))
    )


def wide_hex(address: Column, more: Column) -> Column:
    """Groups of more digits, up to four, so that there are values left."""
    return F.array_join(F.transform(F.split(address, ":"), lambda g: F.when(g == "", g).otherwise(F.rpad(g, F.least(F.lit(4), F.length(g) + more), F.lit("0")))), ":")


def formatted(value: Column, entity: Column) -> Column:
    """The letters and digits of value in the places that those of entity have, its separators kept."""
    value = F.when(entity.rlike(r"^\W*0\W*0") & value.startswith("+"), F.concat(F.lit("00"), F.substr(value, F.lit(2)))).otherwise(F.ltrim(value, F.lit("+")))
    state = lambda out, rest: F.struct(out.alias("out"), rest.alias("rest"))

    def put(acc: Column, part: Column) -> Column:
        n = F.length(part)
        own = state(F.concat(acc["out"], F.substr(acc["rest"], F.lit(1), n)), F.substr(acc["rest"], n + 1))
        return F.when(part.rlike("[0-9A-Za-z]"), own).otherwise(state(F.concat(acc["out"], part), acc["rest"]))

    parts = F.regexp_extract_all(entity, F.lit("[0-9A-Za-z]+|[^0-9A-Za-z]+"), F.lit(0))
    return F.aggregate(parts, state(F.lit(""), value), put, lambda acc: F.concat(acc["out"], acc["rest"]))


def recased(value: Column, like: Column) -> Column:
    """value in the letter case of like, character by character (the lengths are equal)."""
    a, b = F.split(value, ""), F.split(like, "")
    return F.array_join(F.zip_with(a, b, lambda x, y: F.when((F.upper(y) == y) & (F.lower(y) != y), F.upper(x)).otherwise(x)), "")


def family(entity: Column) -> Column:
    """The last name of a person."""
    return F.regexp_extract(entity, r"[\p{L}'’-]+$", 0)


def normal(kind: Column, entity: Column) -> Column:
    """One form for all ways to write an entity: the family name of a person, numbers without separators."""
    digits = F.regexp_replace(entity, "[^0-9]", "")
    phone = F.regexp_replace(F.concat(F.when(entity.startswith("+"), "+").otherwise(""), digits), "^00", "+")
    form = F.when(kind == "person", family(entity)).when(kind == "phone", phone).when(kind.isin("card", "national"), digits).when(kind == "iban", F.replace(entity, F.lit(" "), F.lit("")))
    return F.lower(form.otherwise(entity))


def identity(text: Column) -> Column:
    """128 bits that tell texts apart."""
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"))


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(kind, norm) -> the same with surrogate: distinct per kind, and none an entity itself."""
    known = written(entities.select("kind", "norm").distinct(), "entities")
    # drawing is work: entities are dealt into as many tasks as a shuffle has, not as their few bytes would fill
    tasks = int(entities.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    drawn = lambda rows: rows.repartition(tasks, "kind", "norm").withColumn("surrogate", surrogate(F.col("kind"), F.col("norm"), F.col("attempt"), key))
    table = written(drawn(known.withColumn("attempt", F.lit(0))), "surrogates")
    while True:  # each round has more values to draw from than the last but WIDEN
        first = table.groupBy("kind", "surrogate").agg(F.min("norm").alias("owner"), F.count(F.lit(1)).alias("n")).filter("n > 1")
        doubles = table.join(first, ["kind", "surrogate"]).filter("norm <> owner").select("kind", "norm")
        real = table.join(known.select("kind", F.col("norm").alias("surrogate")), ["kind", "surrogate"], "left_semi").select("kind", "norm")
        clash = written(doubles.union(real).distinct(), "clashes")
        if clash.isEmpty():
            return table.select("kind", "norm", "surrogate")
        kept = table.join(clash, ["kind", "norm"], "left_anti")
        again = drawn(table.join(clash, ["kind", "norm"], "left_semi").withColumn("attempt", F.col("attempt") + 1).drop("surrogate"))
        new = written(kept.unionByName(again), "surrogates")
        forget(table)
        forget(clash)
        table = new


def pseudonymise(documents: DataFrame, key: str | None = None) -> DataFrame:
    """The documents' columns with surrogates in text, n_entities and entity_types."""
    key = key or documents.sparkSession.conf.get(KEY_SETTING, None)
    if not key:
        raise ValueError(f"give a key or set {KEY_SETTING}")
    docs = without(documents, *ADDED)
    # a cheap test that every text with an entity passes; the others are never shuffled
    some = F.coalesce(F.col("text").rlike(r"[0-9@]") | F.col("text").rlike(PATTERNS["person"]), F.lit(False))
    found = docs.select("doc_id", identity(F.col("text")).alias("text_key"), "text").filter(some).select(
        "doc_id", "text_key", F.regexp_extract_all("text", F.lit(ANY), F.lit(0)).alias("entities")
    )
    # equal rows need one replacement list
    found = found.filter(F.size("entities") > 0).select("text_key", F.posexplode("entities").alias("at", "entity")).distinct()
    found = found.withColumn("kind", kind_of(F.col("entity")))
    # a person is as many pieces as it has words; of those only names that aren't listed are looked up
    words = F.regexp_extract_all("entity", F.lit(r"[^ ]+ ?"), F.lit(0))
    pieces = F.when(F.col("kind") == "person", words).otherwise(F.array("entity"))
    found = found.select("text_key", "at", F.col("kind").alias("of"), F.size(pieces).alias("n"), F.posexplode(pieces).alias("sub", "piece"))
    word = F.rtrim("piece")
    names = F.create_map(*[F.lit(x) for a, b in given_cycle(key).items() for x in (a.lower(), b.lower())])
    listed = names[F.lower(word)]
    fixed = word.rlike(rf"\A(?:(?:{TITLES})\.?|{PARTICLES})\z")
    is_last = F.col("sub") == F.col("n") - 1
    kind = F.when(F.col("of") != "person", F.col("of")).when(is_last, "person").when(~fixed & listed.isNull(), "given")
    capital = F.concat(F.upper(F.substring(listed, 1, 1)), F.substr(listed, F.lit(2)))
    own = F.when(fixed, word).otherwise(F.when((F.upper(word) == word) & (F.length(word) > 1), F.upper(listed)).otherwise(capital))
    found = found.withColumn("kind", kind).withColumn("own", F.concat(own, F.when(F.col("piece").endswith(" "), " ").otherwise("")))
    found = written(found.withColumn("norm", normal(F.col("kind"), word)), "found-entities")
    asked = found.filter(F.col("kind").isNotNull())
    table = surrogates(asked, key)
    number = formatted(F.col("surrogate"), F.col("piece"))
    spelled = F.concat(recased(F.col("surrogate"), word), F.when(F.col("piece").endswith(" "), " ").otherwise(""))
    value = F.when(F.col("kind").isin("phone", "card", "national"), number).when(F.col("kind") == "iban", F.upper(number)).when(F.col("kind").isin("person", "given"), spelled).otherwise(recased(F.col("surrogate"), F.col("piece")))
    put = asked.join(table, ["kind", "norm"]).select("text_key", "at", "sub", value.alias("value"), F.col("of").alias("kind"))
    plain = found.filter(F.col("kind").isNull()).select("text_key", "at", "sub", F.col("own").alias("value"), F.col("of").alias("kind"))
    lists = put.unionByName(plain).groupBy("text_key").agg(F.sort_array(F.collect_list(F.struct("at", "sub", "value", "kind"))).alias("values"))
    lists = written(lists, "replacements")
    rows = docs.filter(some).alias("d").join(lists.alias("l"), identity(F.col("d.text")) == F.col("l.text_key"), "left")
    parts = F.split(F.col("d.text"), ANY, -1)
    before = lambda v, ps: F.when(v["sub"] == 0, F.get(ps, v["at"])).otherwise(F.lit(""))
    text = let(parts, lambda ps: F.concat(F.array_join(F.transform("l.values", lambda v: F.concat(before(v, ps), v["value"])), ""), F.element_at(ps, -1)))
    none = F.array().cast("array<string>")
    replaced = rows.select(
        *[F.when(F.col("l.values").isNull(), F.col("d.text")).otherwise(text).alias("text") if c == "`text`" else F.col(f"d.{c}") for c in quoted(docs)],
        F.when(F.col("l.values").isNull(), 0).otherwise(F.size(F.filter("l.values", lambda v: v["sub"] == 0))).cast("long").alias("n_entities"),
        F.coalesce(F.array_sort(F.array_distinct(F.transform("l.values", lambda v: v["kind"]))), none).alias("entity_types"),
    )
    return replaced.unionAll(docs.filter(~some).select("*", F.lit(0).cast("long").alias("n_entities"), none.alias("entity_types")))
