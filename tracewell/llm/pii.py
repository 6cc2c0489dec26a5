"""PII: surrogate generation with DataFrame functions only.

Entities (e-mail and IPv4 addresses, phone and card numbers, US social security numbers, names
after a form of address) are found by one pattern.  Card numbers must pass the Luhn check and have
an issuer's prefix: other long numbers stay.  Each entity is reduced to a canonical form (digits
without separators, lower case), so that its spellings are one entity wherever they occur, and the
distinct entities of the whole corpus get surrogates from a keyed SHA-256:

* e-mail: letters by letters of the same script, digits by digits, and one digit more each time it is drawn
  again; one surrogate domain per domain.  A local part has 64 characters at most and a domain 127 labels, as the
  rules of addresses have it; what is beyond is plain text
* IPv4: an address of the reserved block 240/4, of 10/8 for private ones
* phone: country code and layout stay; card: issuer digit, layout and a valid check digit stay
* name: only after a form of address (a rule set: names without one are not found); a given name of the
  same gender (by the form of address) and script (from lists for Latin, Cyrillic, Greek and Armenian;
  letters of the script for others), one more syllable each time it is drawn again, and a surname that is
  the same for all who share the surname.  A name that has a gender by one form of address keeps it where
  the form has none (Ms Jane Smith is Dr Jane Smith); with both genders about, the three are three people

Domains and surnames are entities of their own, drawn first, so two of them never become one.  Surrogates that
two entities of a type share, or that occur in the corpus themselves, are drawn again with the next attempt until
none is left.  Words have more forms with each attempt.  Numbers can't: where the distinct entities of one layout
(say private IPv4 addresses) are more than a quarter of its forms, `surrogates` raises ValueError; below that, at
least every second draw succeeds.  The texts are then cut at the matches and put together again.  Equal texts share
their replacements, so a text that many rows repeat is worked out once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import dropped, saved, unused

OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: Fixed forms of address by gender.
MALE = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Signor", "господин", "г-н")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Srta", "Signora", "госпожа", "г-жа")
NEUTRAL = ("Dr", "Prof")
TITLES = "|".join(sorted([*MALE, *FEMALE, *NEUTRAL], key=lambda t: (-len(t), t)))
NAME = rf"(?<![\p{{L}}\p{{N}}-])(?:{TITLES})\.? \p{{Lu}}[\p{{L}}'’-]+(?: \p{{Lu}}[\p{{L}}'’-]+){{0,2}}"
#: Type and pattern, in the order in which they are tried at a place.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}])[\p{L}\p{N}][\p{L}\p{N}._%+-]{0,63}+@(?:[\p{L}\p{N}-]++\.){1,126}\p{L}{2,}",
    "ip": rf"(?<![0-9.])(?:{OCTET}\.){{3}}{OCTET}(?![0-9]|\.[0-9])",
    "card": r"(?<![0-9+])[2-6][0-9]{3}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-]?[0-9]{3}[ .-]?[0-9]{3,4}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|(?<![0-9-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![0-9-])",
    "name": NAME,
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: What every match has in it; quickly told, and most texts have none.
HINT = rf"[@0-9]|(?<![\p{{L}}\p{{N}}-])(?:{TITLES})\.? \p{{Lu}}"
#: Fixed given names by gender and script.
GIVEN = {
    ("f", "latin"): "Alma Berit Clara Daria Edith Flora Greta Hanna Irma Judith Klara Lydia Marta Nora Olga Petra".split(),
    ("m", "latin"): "Albin Boris Conrad Dario Edgar Felix Gustav Hugo Ivan Jonas Karl Lukas Magnus Nils Oskar Peter".split(),
    ("n", "latin"): "Alex Billie Charlie Dana Eden Finley Gale Harper Indigo Jules Kim Lee Morgan Noel Quinn Robin".split(),
    ("f", "cyrillic"): "Алина Берта Вера Галина Дарья Елена Жанна Зоя Ирина Клара Лидия Марина Нина Ольга Полина Раиса".split(),
    ("m", "cyrillic"): "Антон Борис Виктор Глеб Денис Егор Захар Иван Кирилл Леонид Максим Никита Олег Павел Роман Сергей".split(),
    ("n", "cyrillic"): "Саша Женя Валя Слава Витя Шура Паша Мишель Ким Ники Робин Тоня Лёка Вася Тася Юля".split(),
    ("f", "greek"): "Άννα Βασιλική Γεωργία Δήμητρα Ελένη Ζωή Ηλέκτρα Θάλεια Ιωάννα Καλλιόπη Λυδία Μαρία Νεφέλη Ξένια Ολυμπία Ρέα".split(),
    ("m", "greek"): "Ανδρέας Βασίλης Γιώργος Δημήτρης Ευάγγελος Ζήσης Ηλίας Θωμάς Ιάσονας Κώστας Λάμπρος Μάριος Νίκος Ορέστης Πέτρος Σπύρος".split(),
    ("n", "greek"): "Άλεξ Ρένι Σάσα Νίκι Κρις Έντεν Λίο Μισέλ Τόνι Ντάνι Βίκυ Φρόσω Τζο Σαμ Λι Κιμ".split(),
    ("f", "armenian"): "Անահիտ Արփի Գայանե Եվա Զարուհի Լիլիթ Կարինե Հասմիկ Մարիամ Նարե Նունե Շուշան Սիրան Սոնա Տաթև Օվսաննա".split(),
    ("m", "armenian"): "Արամ Արմեն Գագիկ Դավիթ Երվանդ Զավեն Կարեն Հայկ Միքայել Նարեկ Պետրոս Սարգիս Տիգրան Վահան Վարդան Րաֆֆի".split(),
    ("n", "armenian"): "Արև Արշալույս Գարուն Լույս Հույս Մասիս Նար Շող Սեր Սևան Վան Անի Արաքս Նուռ Ծով Սարի".split(),
}
#: Fixed letters and syllables that surrogates are made of.
LETTERS = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзиклмнопрстуфхцчшэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω"}
SYLLABLES = {"latin": [a + b for a in "bdfgklmnprstvz" for b in "aeiou"], "cyrillic": [a + b for a in "бвгдзклмнпрст" for b in "аеиоу"], "greek": [a + b for a in "βγδζθκλμνπρτφχ" for b in "αειου"], "armenian": [a + b for a in "բգդզլխկհմնպռստ" for b in "աեիոէ"]}


#: Private IPv4 addresses; a phone number's country code.
PRIVATE = r"^(?:10\.|192\.168\.|172\.(?:1[6-9]|2[0-9]|3[01])\.)"
PLUS = r"^(\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3}))"
#: Forms that a layout of numbers must have for each entity of it: as many may be real, and half stay free.
FORMS = 4


def _hex(*parts) -> Column:
    """128 hex digits that the key and the parts give."""
    seed = F.concat_ws("\n", *parts)
    return F.concat(F.sha2(F.concat(seed, F.lit("\n0")), 256), F.sha2(F.concat(seed, F.lit("\n1")), 256))


def _byte(h: Column, i) -> Column:
    """The i-th byte of a string of 128 hex digits (from 0; begins again after the last)."""
    at = (F.lit(i) if isinstance(i, int) else i) % 64 * 2 + 1
    return F.conv(F.substring(h, at, F.lit(2)), 16, 10).cast("int")


def _pick(choices: list[str], n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, choices)), (n % len(choices) + 1).cast("int"))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def luhn_sum(digits: Column) -> Column:
    """The sum of a number's digits, each second one from the right doubled."""

    def each(c, i):
        d = c.cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.transform(_chars(F.reverse(digits)), each), F.lit(0), lambda a, x: a + x)


def kind_of(match: Column) -> Column:
    """The type of a match; null for long numbers that are no card numbers."""
    digits = _digits(match)
    card = match.rlike(f"^(?:{PATTERNS['card']})$")
    valid = F.length(digits).between(13, 19) & (luhn_sum(digits) % 10 == 0) & digits.rlike("^(?:3[4-9]|4|5[1-5]|6|2[2-7])")
    kind = F.when(match.contains("@"), "email").when(match.rlike(f"^(?:{OCTET}\\.){{3}}{OCTET}$"), "ip")
    kind = kind.when(card, F.when(valid, "card")).when(match.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn")
    return kind.when(match.rlike("^[+(0-9]"), "phone").otherwise("name")


def canonical(kind: Column, match: Column) -> Column:
    """What all spellings of an entity have in common."""
    plain = F.regexp_replace(match, rf"^(?:{TITLES})\.? ", "")
    gender = F.when(match.rlike(rf"^(?:{'|'.join(FEMALE)})\b"), "f").when(match.rlike(rf"^(?:{'|'.join(MALE)})\b"), "m").otherwise("n")
    number = F.concat(F.when(match.startswith("+"), "+").otherwise(""), _digits(match))
    return F.when(kind.isin("card", "ssn"), _digits(match)).when(kind == "phone", number).when(kind == "name", F.concat(gender, F.lit(":"), F.lower(plain))).otherwise(F.lower(match))


def _drawn_digits(h: Column, n: Column) -> Column:
    """n decimal digits."""
    return F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: (_byte(h, i) % 10).cast("string")), "")


def _char(code: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(code.cast("long")), 8, "0")), "UTF-32")


def _neighbours(c: Column) -> Column:
    """The letters of a letter's own block of 32 code points, which are of its script."""
    return F.filter(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda k: _char(F.ascii(c) - F.ascii(c) % 32 + k)), lambda x: x.rlike(r"^[\p{L}&&[^\p{Lu}]]$"))


def _redrawn(text: Column, h: Column) -> Column:
    """Letters by letters of the same script, digits by digits; other characters stay."""

    def one(c, i):
        n = _byte(h, i)
        out = F.when(c.rlike("[0-9]"), (n % 10).cast("string")).when(~c.rlike(r"\p{L}"), c)
        for script, name in (("latin", "IsLatin"), ("cyrillic", "IsCyrillic"), ("greek", "IsGreek")):
            out = out.when(c.rlike(rf"\p{{{name}}}"), F.substring(F.lit(LETTERS[script]), n % len(LETTERS[script]) + 1, F.lit(1)))
        out = out.when(c.rlike(r"\p{IsHan}"), _char(n * 16 + _byte(h, i + 1) % 16 + 0x4E00))
        near = _neighbours(c)
        return out.when(F.size(near) > 0, F.element_at(near, (n % F.greatest(F.size(near), F.lit(1)) + 1).cast("int"))).otherwise(c)

    return F.array_join(F.transform(_chars(text), one), "")


def _script(text: Column) -> Column:
    """The script of a word, if it is one with lists."""
    script = F.lit(None).cast("string")
    for block in ("IsCyrillic", "IsGreek", "IsArmenian", "IsLatin"):
        script = F.when(script.isNull() & text.rlike(rf"\p{{{block}}}"), block[2:].lower()).otherwise(script)
    return script


def _syllables(script: str, h: Column, start: Column, n: Column) -> Column:
    """n syllables of a script, drawn from the bytes of h behind `start`; none for n = 0."""
    return F.array_join(F.transform(F.slice(F.sequence(F.lit(0), n), 2, n), lambda i: _pick(SYLLABLES[script], _byte(h, start + i - 1))), "")


def part_surrogate(key: str, kind: Column, canon: Column, attempt: Column) -> Column:
    """The surrogate of a domain or a surname, in lower case; longer by one sign or syllable each time it is drawn again."""
    h = _hex(F.lit(key), kind, canon, attempt.cast("string"))
    host = F.translate(F.substring(h, F.lit(1), 10 + attempt), "0123456789", "ghijklmnop")
    script = _script(canon)
    # Scripts without lists: letters by letters, and one more for each attempt; letters that stand alone get Latin ones at last.
    own = F.concat(_redrawn(canon, h), _redrawn(F.repeat(F.substring(canon, 1, 1), attempt), h), _syllables("latin", h, F.lit(0), F.greatest(attempt - 4, F.lit(0))))
    for name in SYLLABLES:
        own = F.when(script == name, _syllables(name, h, F.lit(0), 4 + attempt)).otherwise(own)
    return F.when(kind == "domain", F.concat(host, F.lit(".example"))).otherwise(own)


def surrogate(key: str, kind: Column, canon: Column, part: Column, attempt: Column) -> Column:
    """The surrogate of an entity, in canonical form.  part: that of its domain or surname."""
    h = _hex(F.lit(key), kind, canon, attempt.cast("string"))
    again = F.when(attempt > 0, _drawn_digits(_hex(F.lit(key), F.lit("more"), canon, attempt.cast("string")), attempt)).otherwise("")
    email = F.concat(_redrawn(F.substring_index(canon, "@", 1), h), again, F.lit("@"), part)
    ip = F.concat_ws(".", F.when(canon.rlike(PRIVATE), F.lit("10")).otherwise((240 + _byte(h, 0) % 15).cast("string")), *[_byte(h, i).cast("string") for i in (1, 2)], (1 + _byte(h, 3) % 254).cast("string"))
    body = F.concat(F.substring(canon, 1, 1), _drawn_digits(h, F.length(canon) - 2))
    check = (10 - luhn_sum(F.concat(body, F.lit("0"))) % 10) % 10
    card = F.concat(body, check.cast("string"))
    plus = F.regexp_extract(canon, PLUS, 1)
    phone = F.concat(plus, (2 + _byte(h, 60) % 8).cast("string"), _drawn_digits(h, F.length(canon) - F.length(plus) - 1))
    ssn = F.concat(F.lit("9"), _drawn_digits(h, F.lit(8)))
    gender, full = F.substring(canon, 1, 1), F.substring_index(canon, ":", -1)
    script, surname = _script(full), F.substring_index(full, " ", -1)
    first = _redrawn(F.substring_index(full, " ", 1), h)
    more = F.concat(_redrawn(F.repeat(F.substring(surname, 1, 1), attempt), h), _syllables("latin", h, F.lit(1), F.greatest(attempt - 4, F.lit(0))))
    for name in SYLLABLES:
        # As many syllables as attempts, so that any number of people can share a surname.
        more = F.when(script == name, _syllables(name, h, F.lit(1), attempt)).otherwise(more)
        for g in "fmn":
            first = F.when((script == name) & (gender == g), _pick(GIVEN[g, name], _byte(h, 0))).otherwise(first)
    more = F.when(attempt > 0, F.concat(more, F.lit(" "))).otherwise("")
    name = F.initcap(F.when(full.contains(" "), F.concat(first, F.lit(" "), more, part)).otherwise(F.concat(more, part)))
    return F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "card", card).when(kind == "phone", phone).when(kind == "ssn", ssn).otherwise(name)


def laid_out(kind: Column, match: Column, drawn: Column) -> Column:
    """A surrogate in the spelling of a match: its separators, its form of address, its capitals."""
    digits = _digits(drawn)
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    walk = F.aggregate(
        _chars(match),
        start,
        lambda s, c: F.when(c.rlike("[0-9]"), F.struct(F.concat(s["out"], F.substring(digits, s["at"] + 1, F.lit(1))).alias("out"), (s["at"] + 1).alias("at"))).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["at"].alias("at"))),
        lambda s: s["out"],
    )
    named = F.concat(F.regexp_extract(match, rf"^((?:{TITLES})\.? )", 1), drawn)
    upper = F.when((F.upper(match) == match) & (F.lower(match) != match), F.upper(drawn)).otherwise(drawn)
    return F.when(kind.isin("card", "ssn", "phone"), walk).when(kind == "name", named).when(kind == "email", upper).otherwise(drawn)


def crowded(entities: DataFrame) -> None:
    """Raise ValueError if entities (kind, canon) of one layout are too many for the forms that it has."""
    kind, canon = F.col("kind"), F.col("canon")
    plus = F.length(F.regexp_extract(canon, PLUS, 1))
    layout = F.when(kind == "ip", canon.rlike(PRIVATE).cast("string")).when(kind == "card", F.concat(F.substring(canon, 1, 1), F.length(canon).cast("string")))
    layout = layout.when(kind == "phone", F.concat(F.substring(canon, F.lit(1), plus), F.length(canon).cast("string"))).otherwise("")
    forms = F.when(kind == "ip", F.when(canon.rlike(PRIVATE), 254.0 * 2**16).otherwise(15 * 254.0 * 2**16)).when(kind == "card", F.pow(F.lit(10.0), F.length(canon) - 2))
    forms = forms.when(kind == "phone", 8 * F.pow(F.lit(10.0), F.length(canon) - plus - 1)).otherwise(1e8)
    full = entities.where(kind.isin("ip", "card", "ssn", "phone")).groupBy("kind", layout.alias("layout")).agg(F.count("*").alias("n"), F.min(forms).alias("forms")).where(FORMS * F.col("n") > F.col("forms")).take(1)
    if full:
        raise ValueError(f"{full[0]['n']} distinct entities of type {full[0]['kind']} (layout {full[0]['layout']!r}) are too many for surrogates of {full[0]['forms']:.0f} forms")


def distinct(entities: DataFrame, make) -> DataFrame:
    """kind, canon, attempt and surrogate of distinct entities (kind, canon, part), none shared, none real.

    make(kind, canon, part, attempt) draws.  Of those that share one, that of least canonical form keeps it; the others
    are drawn again.
    """
    draw = make(F.col("kind"), F.col("canon"), F.col("part"), F.col("attempt"))
    table = saved(entities.select("kind", "canon", "part", F.lit(0).alias("attempt")).withColumn("surrogate", draw), "surrogates")
    while True:
        bare = F.when(F.col("kind") == "name", F.expr("substring(canon, 3)")).otherwise(F.col("canon"))
        shown = F.when(F.col("kind") == "name", F.lower("surrogate")).otherwise(F.col("surrogate"))
        holders = table.groupBy("kind", "surrogate").agg(F.min("canon").alias("holder"), F.count("*").alias("n")).where("n > 1").select("kind", "surrogate", "holder")
        shared = table.join(holders, ["kind", "surrogate"]).where("canon <> holder").select("kind", "canon")
        real = table.select("kind", "canon", shown.alias("form")).join(table.select("kind", bare.alias("form")).distinct(), ["kind", "form"], "left_semi").select("kind", "canon")
        again = saved(shared.union(real).distinct().withColumn("again", F.lit(1)), "collisions")
        if not again.limit(1).count():
            dropped(again)
            return table.select("kind", "canon", "attempt", "surrogate")
        tried = table.join(again, ["kind", "canon"], "left").withColumn("attempt", F.col("attempt") + F.coalesce("again", F.lit(0)))
        old, table = table, saved(tried.select("kind", "canon", "part", "attempt", F.when(F.col("again") == 1, draw).otherwise(F.col("surrogate")).alias("surrogate")), "surrogates")
        dropped(old)
        dropped(again)


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """kind, canon, attempt and surrogate of distinct entities (kind, canon): first of their domains and surnames,
    then of themselves."""
    kind, canon = F.col("kind"), F.col("canon")
    crowded(entities)
    own = entities.select("kind", "canon", F.when(kind == "email", "domain").when(kind == "name", "surname").alias("part_kind"), F.when(kind == "email", F.substring_index(canon, "@", -1)).when(kind == "name", F.substring_index(F.expr("substring(canon, 3)"), " ", -1)).alias("part_canon"))
    parts = own.where("part_kind is not null").select(F.col("part_kind").alias("kind"), F.col("part_canon").alias("canon"), F.lit("").alias("part")).distinct()
    drawn = distinct(parts, lambda kind, canon, _, attempt: part_surrogate(key, kind, canon, attempt)).select(F.col("kind").alias("part_kind"), F.col("canon").alias("part_canon"), F.col("surrogate").alias("part"))
    return distinct(own.join(drawn, ["part_kind", "part_canon"], "left"), lambda *columns: surrogate(key, *columns))


def one_gender(spelled: DataFrame) -> DataFrame:
    """Spellings (match, kind, canon) in which a name without a gender has the one that it has elsewhere, if that is one."""
    bare, neutral = F.expr("substring(canon, 3)"), (F.col("kind") == "name") & F.col("canon").startswith("n:")
    told = spelled.where((F.col("kind") == "name") & ~neutral).groupBy(bare.alias("canon")).agg(F.min(F.substring("canon", 1, 1)).alias("least"), F.max(F.substring("canon", 1, 1)).alias("most"))
    told = told.where("least = most").select(F.concat(F.lit("n:"), F.col("canon")).alias("canon"), F.concat("least", F.lit(":"), F.col("canon")).alias("told"), F.lit("name").alias("kind"))
    return spelled.join(told, ["kind", "canon"], "left").select("match", "kind", F.coalesce("told", "canon").alias("canon"))


def replace(df: DataFrame, key: str, text: str = "text", count: str = "n_entities") -> DataFrame:
    """df with its texts' entities replaced, and the number of entities replaced in column `count`.

    Null texts stay null (count 0), empty ones empty; all rows and other columns stay, a column named
    `count` is replaced.
    """
    keep = [c for c in df.columns if c != count]
    rows = df.select(*keep)
    found = F.regexp_extract_all(F.col(text), F.lit(ANY), F.lit(0))
    # The text's hash, and not the row, is what matches hang on: copies share them.
    has = F.coalesce(F.col(text).rlike(HINT) & F.col(text).rlike(ANY), F.lit(False))
    hits = saved(rows.where(has).select(F.sha2(F.col(text), 256).alias("of"), found.alias("matches")).groupBy("of").agg(F.first("matches").alias("matches")), "matches")
    spots = hits.select("of", F.posexplode("matches").alias("at", "match"))
    kind = kind_of(F.col("match"))
    spelled = saved(spots.select("match").distinct().withColumn("kind", kind).where("kind is not null").withColumn("canon", canonical(F.col("kind"), F.col("match"))), "spellings")
    spelled = one_gender(spelled)
    drawn = surrogates(spelled.select("kind", "canon").distinct(), key)
    new = spelled.join(drawn, ["kind", "canon"]).select("match", laid_out(F.col("kind"), F.col("match"), F.col("surrogate")).alias("new"))
    placed = spots.join(new, "match", "left").groupBy("of").agg(F.sort_array(F.collect_list(F.struct("at", F.coalesce("new", "match").alias("new")))).alias("spots"), F.count("new").alias("count"))
    # The columns of the rows keep their names, whatever these are.
    of, to, n = (unused(rows, c) for c in ("of", "new", "n"))
    placed = saved(placed.select(F.col("of").alias(of), F.col("spots.new").alias(to), F.col("count").alias(n)), "replacements")
    changed = rows.where(has).withColumn(of, F.sha2(F.col(text), 256)).join(placed, of)
    parts = F.split(F.col(text), ANY, -1)
    joined = F.array_join(F.zip_with(parts, F.col(to), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    changed = changed.select(*[joined.alias(c) if c == text else F.col(c) for c in keep], F.col(n).alias(count))
    return rows.where(~has).withColumn(count, F.lit(0).cast("long")).unionByName(changed)
