"""Personal data replaced by keyed surrogates; DataFrame functions only.

One pattern finds e-mail addresses, phone numbers, IP addresses of both kinds, payment cards,
social security numbers, bank accounts, access keys, passwords in assignments, and persons named
after a title. It runs over each text once: the rows are written with their texts cut at the
findings, and later steps read the cuts.
Each finding has an identity, under which all its spellings are one entity:

* e-mail: lower-cased; phone, card, social security number: the digits (a phone's last ten); bank
  account: letters and digits;
* person: each name word for itself, with its part (given or family), script and, for given names,
  the title's gender, so that "Mrs Ada Lake" and "Ms. Lake" share the family name's surrogate. All
  name words after a title count, the last is the family name; initials get a letter, particles
  stay. In the same document, the family name and the full name are replaced without a title, too,
  in any case that begins with a capital;
* others: as they stand.

A surrogate is made of the keyed SHA-256 of the identity: letters become letters of the same case,
digits digits; a phone keeps its country code and leads with digits that areas have; an IP address
stays one; a card keeps its first digit and passes the Luhn test if the original does; a bank
account keeps its country and has right check digits;
names are built of syllables of their script with an ending of their gender. Spellings are kept:
the digits fill the occurrence's own punctuation and upper-case stays upper-case.

Distinctness is checked over the whole table: a candidate that equals another entity's surrogate,
or an identity that occurs in the table itself, is drawn again with the next attempt until none is
left (``ATTEMPTS`` at most, then an error). So equal entities have equal surrogates everywhere and different ones different ones.

Defined results: null texts stay null, texts without findings stay as they are. Rows are
independent; repeated rows get the same result, null keys stay. Every other column passes through,
whatever its name; the list of findings, if asked for, takes the place of a column ``pii``.

Not found: persons without a title (but for the repeats above), street addresses, dates, and
numbers without the forms named here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codexferry.llm.decontam import LOWER, UPPER
from codexferry.storage import materialize

OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
MALE, FEMALE = "Mr|Herr|Monsieur|Sr|Señor|Господин", "Mrs|Ms|Miss|Frau|Mme|Madame|Sra|Señora|Госпожа"
#: Titles without a gender.
NEUTRAL = "Dr|Prof"
TITLES = f"{MALE}|{FEMALE}|{NEUTRAL}"
#: A name word: inner capitals, hyphens and apostrophes, but no possessive ending.
NAME = r"\p{Lu}(?:[\p{L}\p{M}]|-(?=\p{L})|['’](?=\p{L})(?!s(?!\p{L})))+"
INITIAL, PARTICLE = r"\p{Lu}\.", "van|von|der|den|de|la|le|del|di|da|dos|du|zu|zur|bin|ibn|al|el|ter|ten"
NAMES = rf"(?: (?:{PARTICLE})(?= (?:(?:{PARTICLE}) )*\p{{Lu}})| (?:{NAME}|{INITIAL}))+"

#: type -> pattern, in order of preference where several begin at the same place.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}",
    "secret": r"(?<![\p{L}\d])(?i:password|passwd|pwd|api_key|secret|token)(?:[=:][^\s]{6,}|(?:: | = )(?=\S*\d)\S{6,})",
    "key": r"(?<![\p{L}\d])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|sk-[A-Za-z0-9]{20,})(?![A-Za-z0-9])",
    "iban": r"(?<![\p{L}\d])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": rf"(?<![\w.])(?:{OCTET}\.){{3}}{OCTET}(?!\.?\d)(?!\w)",
    "ip6": r"(?<![\w:])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\w:])",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]*\d)",
    "card": r"(?<![\w.-])[3-6]\d{3}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?!\w)",
    "phone": r"(?<![\w.+-])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\w)|(?<![\w.+-])\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}(?!\w)|(?<![\w.+-])0\d{2,4}[ -]\d{3,4}[ -]\d{3,4}(?!\w)",
    "person": rf"(?<![\p{{L}}\d])(?:{TITLES})\.?{NAMES}",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: What every finding holds, type by type; cheaper to look for than the pattern.
HINTS = {
    "email": "@",
    "secret": r"(?i:password|passwd|pwd|api_key|secret|token)(?:[=:]| = )",
    "key": "AKIA|gh[pousr]_|sk-",
    "ip6": "[0-9A-Fa-f]:[0-9A-Fa-f:]",
    "iban": r"\d",
    "ip": r"\d",
    "ssn": r"\d",
    "card": r"\d",
    "phone": r"\d",
    "person": rf"(?:{TITLES})\.? (?:(?:{PARTICLE}) )*\p{{Lu}}",
}
HINT = "|".join(dict.fromkeys(HINTS.values()))
#: Stands before and after a finding while a text is cut; what a text has of these two itself is written as two characters.
MARK, ESCAPE = "\uf8ff", "\uf8fe"
ESCAPES = {ESCAPE: ESCAPE + "\uf8fd", MARK: ESCAPE + "\uf8fc"}

ATTEMPTS = 40
#: A secret's name and its sign of assignment.
SECRET_LEAD = r"^[^=:]*[=:] ?"

CONSONANTS = {"latin": "bdfgklmnprstvz", "cyrillic": "бвгдзклмнпрст", "greek": "βγδκλμνπρστφ"}
VOWELS = {"latin": "aeiou", "cyrillic": "аеиоу", "greek": "αειου"}
ENDINGS = {
    "latin": {"f": "a", "m": "o", "": "er"},
    "cyrillic": {"f": "а", "m": "ор", "": "ин"},
    "greek": {"f": "α", "m": "ος", "": "ης"},
}


def digits(x: Column) -> Column:
    return F.regexp_replace(x, r"\D", "")


def kind_of(raw: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(PATTERNS.items()):
        out = F.when(F.regexp_like(raw, F.lit(f"^(?:{pattern})$")), F.lit(kind)).otherwise(out)
    return out


def _script(word: Column) -> Column:
    return F.when(word.rlike(r"^\p{IsCyrillic}"), "cyrillic").when(word.rlike(r"^\p{IsGreek}"), "greek").otherwise("latin")


def identities(raw: Column, kind: Column) -> Column:
    """The entities of a finding, as an array of (kind, identity, spelling)."""
    one = lambda k, identity, own=raw: F.struct(k.alias("kind"), identity.alias("identity"), own.alias("spelling"))
    value = F.regexp_replace(raw, SECRET_LEAD, "")
    number = digits(raw)
    title = F.regexp_extract(raw, r"^\p{L}+", 0)
    gender = F.when(title.isin(*FEMALE.split("|")), "f").when(title.isin(*NEUTRAL.split("|")), "").otherwise("m")
    names = F.slice(F.split(raw, " "), 2, 1_000_000)

    def name(word: Column, place: Column) -> Column:
        part = F.when(place < F.size(names) - 1, gender).otherwise("")
        kind = F.when(word.rlike(f"^(?:{PARTICLE})$"), "particle").when(word.rlike(f"^{INITIAL}$"), "initial")
        return one(kind.otherwise(F.concat(F.lit("name:"), _script(word), F.lit(":"), part)), F.lower(word), word)

    return (
        F.when(kind == "email", F.array(one(kind, F.translate(raw, UPPER, LOWER))))
        .when(kind == "phone", F.array(one(kind, F.expr("right(regexp_replace(raw, '\\\\D', ''), 10)"))))
        .when(kind.isin("card", "ssn"), F.array(one(kind, number)))
        .when(kind == "iban", F.array(one(kind, F.replace(raw, F.lit(" "), F.lit("")))))
        .when(kind == "ip6", F.array(one(kind, F.lower(raw))))
        .when(kind == "secret", F.array(one(kind, value, value)))
        .when(kind == "person", F.transform(names, name))
        .otherwise(F.array(one(kind, raw)))
    )


def _luhn(number: Column) -> Column:
    """The sum of the Luhn test over a string of digits, modulo 10."""
    one = lambda c, i: F.when(i % 2 == 0, c).otherwise(F.when(c > 4, 2 * c - 9).otherwise(2 * c))
    values = F.transform(F.split(F.reverse(number), ""), lambda c, i: one(c.cast("int"), i))
    return F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10


def _mod97(account: Column) -> Column:
    """The remainder that a bank account's check digits make one: letters count from 10."""
    value = lambda c: F.when(c.rlike("[A-Z]"), F.ascii(c) - 55).otherwise(c.cast("int"))
    step = lambda a, c: F.pmod(a * F.when(c.rlike("[A-Z]"), 100).otherwise(10) + value(c), F.lit(97))
    return F.aggregate(F.split(account, ""), F.lit(0), step)


def _syllables(pick, script: str, first: int, last: Column) -> Column:
    def one(i: Column) -> Column:
        return F.concat(pick(CONSONANTS[script], 2 * i), pick(VOWELS[script], 2 * i + 1))

    return F.array_join(F.transform(F.sequence(F.lit(first), last), one), "")


def candidate(secret: str, kind: Column, identity: Column, attempt: Column) -> Column:
    """A surrogate of the same type and form, from the keyed hash of identity and attempt."""
    base = F.concat_ws("\x1f", F.lit(secret), kind, identity, attempt.cast("string"))
    # A number below 2^28 for each place; places beyond 32 start a further digest.
    draw = lambda i: F.conv(F.substring(F.sha2(F.concat_ws("\x1f", base, F.floor(i / 8).cast("string")), 256), (F.pmod(i, F.lit(8)) * 7 + 1).cast("int"), F.lit(7)), 16, 10).cast("long")
    pick = lambda letters, i: F.substring(F.lit(letters), (draw(i) % len(letters) + 1).cast("int"), F.lit(1))

    def like(c: Column, i: Column) -> Column:
        return F.when(c.rlike("[0-9]"), pick("0123456789", i)).when(c.rlike("[a-z]"), pick(LOWER, i)).when(c.rlike("[A-Z]"), pick(UPPER, i)).otherwise(c)

    joined = lambda chars: F.array_join(chars, "")
    copied = lambda x: joined(F.transform(F.split(x, ""), like))
    local, domain = F.substring_index(identity, "@", 1), F.substring_index(identity, "@", -1)
    host, ending = F.regexp_replace(domain, r"\.[^.]*$", ""), F.regexp_extract(domain, r"\.[^.]*$", 0)
    # Where short forms run out, attempts beyond the third make e-mails and secrets longer.
    longer = F.array_join(F.transform(F.sequence(F.lit(3), F.greatest(attempt, F.lit(3))), lambda i: F.when(i > 3, pick(LOWER, i + 48)).otherwise("")), "")
    email = F.concat(longer, copied(F.concat(local, F.lit("@"), host)), ending)
    phone = joined(F.transform(F.split(identity, ""), lambda c, i: F.when((i == F.length(identity) - 10) | (i == F.length(identity) - 7), pick("23456789", i)).otherwise(pick("0123456789", i))))
    octet = lambda i: (draw(F.lit(i)) % 256).cast("string")
    ip = F.concat_ws(".", (draw(F.lit(3)) % 223 + 1).cast("string"), octet(0), octet(1), octet(2))
    inner = F.concat(F.substring(identity, 1, 1), F.expr("substring(identity, 2, length(identity) - 2)"))
    drawn = joined(F.transform(F.split(inner, ""), lambda c, i: F.when(i == 0, c).otherwise(pick("0123456789", i))))
    check = F.pmod(10 - _luhn(F.concat(drawn, F.lit("0"))), F.lit(10)).cast("string")
    last = F.when(_luhn(identity) == 0, check).otherwise(F.pmod(check.cast("int") + 1 + draw(F.lit(40)) % 9, F.lit(10)).cast("string"))
    key = F.concat(F.regexp_extract(identity, r"^(?:AKIA|gh[pousr]_|sk-)?", 0), copied(F.regexp_replace(identity, r"^(?:AKIA|gh[pousr]_|sk-)", "")))
    country, account = F.substring(identity, 1, 2), joined(F.transform(F.split(F.expr("substring(identity, 5)"), ""), like))
    iban = F.concat(country, F.lpad((98 - _mod97(F.concat(account, country, F.lit("00")))).cast("string"), 2, "0"), account)
    hexed = lambda c, i: F.when(c == ":", c).when(i == 0, pick("23456789abcdef", i)).otherwise(pick("0123456789abcdef", i))
    ip6 = joined(F.transform(F.split(identity, ""), hexed))

    out = F.when(kind == "email", email).when(kind == "phone", phone).when(kind == "ip", ip).when(kind == "ip6", ip6)
    out = out.when(kind == "card", F.concat(drawn, last)).when(kind == "key", key).when(kind == "iban", iban)
    for script, endings in ENDINGS.items():
        stem, more = _syllables(pick, script, 0, F.lit(2)), _syllables(pick, script, 3, 3 + attempt)
        for gender, ending in endings.items():
            # Longer names with each attempt: room does not run out.
            whole = F.concat(stem, F.when(attempt > 0, more).otherwise(""), pick(CONSONANTS[script], F.lit(6)), F.lit(ending))
            out = out.when(kind == f"name:{script}:{gender}", whole)
    # Initials are too few to be distinct.
    out = out.when(kind == "initial", F.concat(pick(UPPER, F.lit(0)), F.lit("."))).when(kind == "particle", identity)
    return out.when(kind == "secret", F.concat(copied(identity), longer)).otherwise(copied(identity))


def surrogates(entities: DataFrame, secret: str) -> DataFrame:
    """(kind, identity, surrogate) of distinct (kind, identity): no two alike, none an identity."""
    entities = materialize(entities.select("kind", "identity").distinct())
    # Name words share one space, whatever their part: "name" stands for all of them.
    space = F.regexp_replace("kind", ":.*", "")
    taken = entities.select(space.alias("space"), F.col("identity").alias("surrogate")).distinct()
    open_, done, attempt = entities, None, 0
    while True:
        drawn = open_.select("kind", "identity", candidate(secret, F.col("kind"), F.col("identity"), F.lit(attempt)).alias("surrogate"))
        drawn = drawn.withColumn("space", space)
        winner = drawn.groupBy("space", "surrogate").agg(F.min(F.struct("kind", "identity")).alias("w"))
        winner = winner.join(taken, ["space", "surrogate"], "left_anti")
        won = materialize(winner.select("w.kind", "w.identity", "surrogate", "space"))
        done = won if done is None else done.unionByName(won)
        open_ = materialize(open_.join(won, ["kind", "identity"], "left_anti"))
        if open_.isEmpty():
            return done.select("kind", "identity", "surrogate")
        taken = taken.unionByName(won.select("space", "surrogate"))
        attempt += 1
        if attempt > ATTEMPTS:
            raise RuntimeError("a type has more entities than surrogates of its form")


def rendered(kind: Column, spelling: Column, surrogate: Column) -> Column:
    """The surrogate in the occurrence's own form."""
    chars = F.reverse(F.split(spelling, ""))
    step = lambda a, c: F.when(
        c.rlike("[0-9]") & (a["k"] < F.length(surrogate)),
        F.struct(F.concat(F.substring(surrogate, (F.length(surrogate) - a["k"]).cast("int"), F.lit(1)), a["s"]).alias("s"), (a["k"] + 1).alias("k")),
    ).otherwise(F.struct(F.concat(c, a["s"]).alias("s"), a["k"].alias("k")))
    filled = F.aggregate(chars, F.struct(F.lit("").alias("s"), F.lit(0).alias("k")), step, lambda a: a["s"])
    # Letters and digits in their order; blanks stay where they are.
    spread = F.aggregate(
        F.split(spelling, ""),
        F.struct(F.lit("").alias("s"), F.lit(1).alias("k")),
        lambda a, c: F.when(c == " ", F.struct(F.concat(a["s"], c).alias("s"), a["k"].alias("k"))).otherwise(
            F.struct(F.concat(a["s"], F.substring(surrogate, a["k"], F.lit(1))).alias("s"), (a["k"] + 1).alias("k"))
        ),
        lambda a: a["s"],
    )
    cased = F.zip_with(
        F.split(surrogate, ""),
        F.split(spelling, ""),
        lambda s, c: F.when(c.rlike("[A-Z]"), F.upper(s)).otherwise(F.coalesce(s, F.lit(""))),
    )
    cased = F.array_join(cased, "")
    upper = (spelling == F.upper(spelling)) & (spelling != F.lower(spelling))
    name = F.when(upper, F.upper(surrogate)).otherwise(F.initcap(surrogate))
    return (
        F.when(kind.isin("phone", "card", "ssn"), filled)
        .when(kind == "iban", spread)
        .when(kind.isin("email", "ip6"), cased)
        .when(kind.startswith("name:"), name)
        .otherwise(surrogate)
    )


def cut(docs: DataFrame, text: str = "text") -> DataFrame:
    """(row, text, parts, hash) per row: texts with findings as their parts, all others as they are.

    ``parts`` alternate between what stays and what was found; ``hash`` is that of the whole text.
    The only step that runs the pattern over the texts.
    """
    safe = F.col("text")
    for one, two in ESCAPES.items():
        safe = F.replace(safe, F.lit(one), F.lit(two))

    def back(part: Column) -> Column:
        for one, two in reversed(ESCAPES.items()):
            part = F.replace(part, F.lit(two), F.lit(one))
        return part

    odd = F.col("text").contains(ESCAPE) | F.col("text").contains(MARK)
    marked = F.regexp_replace(F.when(odd, safe).otherwise(F.col("text")), f"({ANY})", f"{MARK}$1{MARK}")
    found = F.transform(F.array(F.split(marked, MARK, -1)), lambda x: F.when(F.size(x) > 1, F.transform(x, back)))
    others = [F.col(f"`{c}`") for c in docs.columns if c != text] or [F.lit(None).cast("int").alias("none")]
    rows = docs.select(F.struct(*others).alias("row"), F.col(text).alias("text"))
    rows = rows.withColumn("parts", F.when(F.col("text").rlike(HINT), F.get(found, F.lit(0))))
    whole, hash_ = F.when(F.col("parts").isNull(), F.col("text")), F.when(F.col("parts").isNotNull(), F.xxhash64("text"))
    return rows.select("row", whole.alias("text"), "parts", hash_.alias("hash"))


def raws(parts: Column) -> Column:
    """What was found, in order."""
    return F.filter(parts, lambda x, i: i % 2 == 1)


def replacements(found: DataFrame, secret: str) -> DataFrame:
    """(raw, replacement, kind, words) of each different finding ``raw``."""
    parts = materialize(found.select("raw").distinct()).withColumn("kind", kind_of(F.col("raw")))
    parts = parts.select("raw", F.col("kind").alias("whole"), F.posexplode(identities(F.col("raw"), F.col("kind"))).alias("place", "e"))
    parts = materialize(parts.select("raw", "whole", "place", "e.kind", "e.identity", "e.spelling"))
    free = F.col("kind").isin("initial", "particle")
    known = surrogates(parts.where(~free), secret)
    drawn = parts.where(free).withColumn("surrogate", candidate(secret, F.col("kind"), F.col("identity"), F.lit(0)))
    new = parts.join(known, ["kind", "identity"]).unionByName(drawn)
    new = new.withColumn("new", rendered(F.col("kind"), F.col("spelling"), F.col("surrogate")))
    # A person's parts in their order; the name words among them with their surrogates.
    whole = new.groupBy("raw", "whole").agg(F.array_sort(F.collect_list(F.struct("place", "new", "spelling", "kind"))).alias("parts"))
    words = F.filter("parts", lambda x: x["kind"].startswith("name:"))
    words = F.transform(words, lambda x: F.struct((x["place"] < F.size("parts") - 1).alias("given"), F.lower(x["spelling"]).alias("word"), x["new"].alias("new")))
    joined = F.array_join(F.transform("parts", lambda x: x["new"]), " ")
    lead = F.when(F.col("whole") == "secret", F.regexp_extract("raw", SECRET_LEAD, 0)).when(F.col("whole") == "person", F.regexp_extract("raw", r"^\p{L}+\.? ", 0)).otherwise("")
    return whole.select("raw", F.concat(lead, joined).alias("replacement"), F.col("whole").alias("kind"), words.alias("words"))


def untitled(gap: Column, names: Column) -> Column:
    """A text between findings, with repeats of the document's family names and full names replaced."""
    word = rf"(?<![\p{{L}}\p{{M}}\d]){NAME}"
    between, found = F.split(gap, word, -1), F.regexp_extract_all(gap, F.lit(word), F.lit(0))
    known = F.transform(found, lambda w: F.get(F.filter(names, lambda x: x["word"] == F.lower(w)), F.lit(0)))

    def one(w: Column, i: Column) -> Column:
        own, after = F.get(known, i), F.get(known, i + 1)
        # A given name only before another name of the document: alone, it may be any word.
        whole = after.isNotNull() & (F.get(between, i + 1) == " ")
        cased = F.when((w == F.upper(w)) & (F.length(w) > 1), F.upper(own["new"])).otherwise(F.initcap(own["new"]))
        return F.when(own.isNotNull() & (~own["given"] | whole), cased).otherwise(w)

    return F.array_join(F.zip_with(between, F.transform(found, one), lambda b, w: F.concat(b, F.coalesce(w, F.lit("")))), "")


def pseudonymized(docs: DataFrame, secret: str, text: str = "text", spans: bool = False) -> DataFrame:
    """All rows and columns, with the findings in ``text`` replaced.

    With ``spans``, also ``pii``: an array of (kind, replacement) in order of place; untitled repeats
    of a name are replaced in the text, but are not listed.
    """
    rows = materialize(cut(docs, text))
    hit = rows.where("parts is not null")
    # A text's findings with their replacements, under the text's hash: copies need them once, and
    # two texts of one hash share a larger table of the same global replacements.
    own = materialize(hit.select("hash", F.explode(F.array_distinct(raws(F.col("parts")))).alias("raw")).distinct())
    new = materialize(replacements(own, secret))
    entry = F.struct("raw", F.struct("kind", "replacement"))
    names = F.array_sort(F.array_distinct(F.flatten(F.collect_list("words"))))
    tables = own.join(new, "raw").groupBy("hash").agg(F.map_from_entries(F.collect_list(entry)).alias("new"), names.alias("names"))
    hit = hit.join(materialize(tables), "hash")
    mine = F.transform(raws(F.col("parts")), lambda r: F.element_at("new", r))
    stays = F.filter("parts", lambda x, i: i % 2 == 0)
    stays = F.when(F.size("names") > 0, F.transform(stays, lambda g: untitled(g, F.col("names")))).otherwise(stays)
    mixed = F.zip_with(stays, mine, lambda g, r: F.concat(g, F.coalesce(r["replacement"], F.lit(""))))
    none = F.expr("cast(array() as array<struct<kind:string,replacement:string>>)")
    hit = hit.select("row", F.array_join(mixed, "").alias("text"), mine.alias("pii"))
    out = hit.unionByName(rows.where("parts is null").select("row", "text", none.alias("pii")))
    columns = [(F.col("text") if c == text else F.col("row")[c]).alias(c) for c in docs.columns if not (spans and c == "pii")]
    return out.select(*columns, *([F.col("pii")] if spans else []))
