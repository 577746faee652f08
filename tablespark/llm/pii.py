"""Personal data: surrogates in place of entities. DataFrame functions only.

Every entity found is replaced by a keyed surrogate of the same kind and format: digits stay digits, letters keep
case and script, cards keep their check digit's validity, phones their country code and leading zeros, names the gender of
their title and the number of their words and hyphened parts. The surrogate's canonical form depends on the key, the
kind and the entity's canonical form alone, so one entity is replaced alike wherever it stands and however it is
written, and a check of one spelling stands for all. Distinct entities must get distinct surrogates that are no
entity of the corpus themselves: a check over the distinct entities finds those that would not, and gives them a
further attempt until none is left.

A name's canonical form holds its title's gender: `Mr Kim Lee` and `Mrs Kim Lee` are two people. A name behind a
title of no gender is the person of that name whose gender the corpus tells, if it tells just one, else a person of
its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import deleted, row_key, written

#: Titles by gender, names by gender and script.
MALE = ["Mr", "Herr", "Monsieur", "Señor", "г-н"]
FEMALE = ["Mrs", "Ms", "Frau", "Madame", "Señora", "г-жа"]
NEUTRAL = ["Dr", "Prof"]
FIRST_NAMES = {
    ("m", "latin"): ["Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karl", "Leon", "Marco", "Nils", "Oscar", "Paul"],
    ("f", "latin"): ["Anna", "Berta", "Clara", "Diana", "Emma", "Flora", "Greta", "Helen", "Irene", "Julia", "Karin", "Laura", "Maria", "Nora", "Olga", "Paula"],
    ("m", "cyrillic"): ["Иван", "Пётр", "Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Игорь", "Кирилл", "Максим", "Никита", "Олег", "Павел", "Роман", "Сергей"],
    ("f", "cyrillic"): ["Анна", "Вера", "Галина", "Дарья", "Елена", "Жанна", "Зоя", "Ирина", "Ксения", "Лариса", "Мария", "Нина", "Ольга", "Полина", "Раиса", "София"],
}
SYLLABLES = {
    "latin": ["ba", "ce", "di", "fo", "gu", "ha", "je", "ki", "lo", "mu", "na", "pe", "ri", "so", "tu", "ve"],
    "cyrillic": ["ба", "ве", "ги", "до", "жу", "за", "ке", "ли", "мо", "ну", "па", "ре", "си", "то", "фу", "ша"],
}
LETTERS = {"latin": "abcdefghijklmnop", "cyrillic": "абвгдежзиклмнопр", "greek": "αβγδεζηθικλμνξοπ"}
HEX = "0123456789abcdef"
#: Fixed value: country codes, none of which begins another; all that is left has three digits.
COUNTRY = r"1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3}"

_LOCAL = r"[\p{L}0-9._%+\-]"
_GROUP = "[0-9A-Fa-f]{1,4}"
_NAME = r"\p{Lu}\p{Ll}++(?:-\p{L}++)*+(?!\p{L})"
#: Kinds in order of precedence. Each pattern begins where no longer run of its own letters does.
KINDS: list[tuple[str, str]] = [
    ("email", rf"(?<!{_LOCAL}){_LOCAL}++@[A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]++)*(?<=\.[A-Za-z]{{2,20}})"),
    ("secret", r"(?<![\p{L}0-9_])(?i:token|secret|password|passwd|api[_\-]?key)\s{0,3}[=:]\s{0,3}[\"']?[A-Za-z0-9_\-+/.]{8,}+"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    # Eight groups, or fewer around a double colon, with a digit somewhere.
    ("ipv6", rf"(?<![\p{{L}}0-9:.])(?=[A-Fa-f:]*+[0-9])(?!(?:[0-9A-Fa-f]*+:){{8}})(?:(?:{_GROUP}:){{7}}{_GROUP}|{_GROUP}(?::{_GROUP}){{0,5}}::{_GROUP}(?::{_GROUP}){{0,5}}|{_GROUP}(?::{_GROUP}){{1,5}}::)(?![\p{{L}}0-9:]|\.\d)"),
    ("ip", r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|\d?\d)(?!\.?\d)"),
    ("ssn", r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])"),
    # With a country code any grouping, North American groups, or groups after a leading zero that are no date.
    ("phone", r"(?<![\p{L}\d])(?:\+[1-9](?:[ .\-/]?(?:\(\d{1,5}\)|\d)){6,14}|(?:\+\d{1,3}[ .\-]?)?(?:\(\d{3}\) ?|\d{3}[ .\-])\d{3}[ .\-]\d{4}"
     r"|(?!\d{2}[.\-/]\d{2}[.\-/]\d{4}(?!\d))(?=\(?(?:\d[ .\-/)]{0,2}){9,13}(?!\d))(?:\(0\d{1,4}\)|0\d{1,4})(?:[ .\-/]\d{2,8}){1,4})(?!\d)"),
    ("card", r"(?<![\p{L}\d])\d(?:[ \-]?\d){12,18}(?!\d)"),
    ("key", r"(?<![A-Za-z0-9])(?=[a-fA-F]*+[0-9])[0-9a-fA-F]{32,}+(?![A-Za-z0-9])"),
    ("name", rf"(?<![\p{{L}}])(?:(?:{'|'.join(MALE + FEMALE + NEUTRAL)})\.? ){_NAME}(?: {_NAME})*+"),
]
ENTITY = "|".join(f"(?:{p})" for _, p in KINDS)
#: What every entity holds somewhere; texts without it are passed by.
SIGN = rf"[0-9@]|(?i:token|secret|passw|api[_\-]?key)|(?:{'|'.join(MALE + FEMALE + NEUTRAL)})\.? \p{{Lu}}"
_SECRET_HEAD = r"^(.*?[=:]\s{0,3}[\"']?)(.*)$"
_TITLE = rf"^((?:{'|'.join(MALE + FEMALE + NEUTRAL)})\.? )(.*)$"
_NATIONAL = r"^0*(\d{4,})$"
#: Attempts after which a format counts as nearly used up by the corpus itself.
WIDER = 16
#: Noncharacters that stand around the entities of a text while it is cut up.
OPEN, CLOSE = "\ufdd0", "\ufdd1"


def entities(text: Column) -> Column:
    """All entities of a text, in order."""
    return F.when(text.rlike(SIGN), F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))).otherwise(F.array().cast("array<string>"))


def stretches(text: Column) -> Column:
    """The text cut up: what stands before the first entity, the entity, what stands before the next, and so on."""
    cut = F.split(F.regexp_replace(text, ENTITY, f"{OPEN}$0{CLOSE}"), f"[{OPEN}{CLOSE}]", -1)
    # Texts that hold the marks themselves are searched twice.
    twice = F.flatten(F.zip_with(F.split(text, ENTITY, -1), entities(text), lambda gap, e: F.when(e.isNull(), F.array(gap)).otherwise(F.array(gap, e))))
    return F.when(~text.rlike(SIGN), F.array(text)).when(text.rlike(f"[{OPEN}{CLOSE}]"), twice).otherwise(cut)


def kind_of(value: Column) -> Column:
    kind = F.lit("name")
    for name, pattern in reversed(KINDS):
        kind = F.when(value.rlike(rf"^(?:{pattern})$"), name).otherwise(kind)
    return kind


def _national(value: Column) -> Column:
    """A phone number without country code and leading zeros, but of four digits at least."""
    digits = F.regexp_replace(value, r"\D", "")
    return F.when(F.startswith(value, F.lit("+")), F.regexp_extract(digits, rf"^(?:{COUNTRY})0*(\d{{4,}})$", 1)).otherwise(F.regexp_extract(digits, _NATIONAL, 1))


def _halves(value: Column) -> tuple[Column, Column]:
    """The groups of an IPv6 address before and behind its double colon."""
    groups = lambda half: F.filter(F.split(half, ":"), lambda g: g != "")
    return groups(F.substring_index(value, "::", 1)), groups(F.when(F.contains(value, F.lit("::")), F.substring_index(value, "::", -1)).otherwise(""))


def _whole_address(value: Column) -> Column:
    left, right = _halves(F.lower(value))
    return F.array_join(F.transform(F.concat(left, F.array_repeat(F.lit("0"), F.lit(8) - F.size(left) - F.size(right)), right), lambda g: F.lpad(g, 4, "0")), ":")


def _gender(title: Column) -> Column:
    bare = F.regexp_replace(title, r"[. ]", "")
    return F.when(bare.isin(MALE), "m").when(bare.isin(FEMALE), "f").otherwise("n")


def canonical(kind: Column, value: Column) -> Column:
    """What is the same for all ways to write one entity."""
    digits = F.regexp_replace(value, r"\D", "")
    return (
        F.when(kind == "email", F.lower(value))
        .when(kind == "secret", F.regexp_extract(value, _SECRET_HEAD, 2))
        .when(kind == "iban", F.replace(value, F.lit(" "), F.lit("")))
        .when(kind.isin("card", "ssn"), digits)
        .when(kind == "phone", _national(value))
        .when(kind == "ipv6", _whole_address(value))
        .when(kind == "key", F.lower(value))
        .when(kind == "name", F.concat_ws(" ", _gender(F.regexp_extract(value, _TITLE, 1)), F.lower(F.regexp_extract(value, _TITLE, 2))))
        .otherwise(value)
    )


def _ungendered(kind: Column, canon: Column) -> Column:
    """The form in which surrogates are compared: names without their gender."""
    return F.when(kind == "name", F.substr(canon, F.lit(3))).otherwise(canon)


def _stream(key: str, kind: Column, canon: Column, attempt: Column, value: Column) -> Column:
    """Hexadecimal digits, more than value is long."""
    seed = F.concat_ws("\u0001", F.lit(key), kind, canon, attempt.cast("string"))
    return F.repeat(F.concat(F.sha2(seed, 256), F.sha2(F.concat(seed, F.lit("\u0002")), 256)), F.greatest(F.lit(5), F.ceil(F.length(value) / 128) + 1).cast("int"))


def _digits(stream: Column) -> Column:
    return F.translate(stream, "abcdef", "012345")


def _at(text: Column, i: Column) -> Column:
    return text.substr(i, F.lit(1))


def _shaped(value: Column, e: Column) -> Column:
    """Another text of the same shape: digit for digit, letter for letter of its case and script."""

    def one(c: Column, i: Column) -> Column:
        letter = _at(F.when(c.rlike(r"\p{IsCyrillic}"), e["cyrillic"]).when(c.rlike(r"\p{IsGreek}"), e["greek"]).otherwise(e["latin"]), i + 1)
        return F.when(c.rlike(r"^\d$"), _at(e["digits"], i + 1)).when(c.rlike(r"^\p{Lu}$"), F.upper(letter)).when(c.rlike(r"^\p{L}$"), letter).otherwise(c)

    return F.array_join(F.transform(F.split(value, ""), one), "")


def _hidden(value: Column, e: Column) -> Column:
    """As _shaped; hexadecimal text stays hexadecimal."""
    some = e["s"].substr(F.lit(1), F.length(value))
    mixed = F.array_join(F.zip_with(F.split(value, ""), F.split(some, ""), lambda c, x: F.when(c.rlike("^[A-F]$"), F.upper(x)).otherwise(x)), "")
    return F.when(value.rlike("^[0-9a-f]*$"), some).when(value.rlike("^[0-9A-F]*$"), F.upper(some)).when((e["kind"] == "key") & value.rlike("^[0-9a-fA-F]*$"), mixed).otherwise(_shaped(value, e))


def _refilled(value: Column, digits: Column) -> Column:
    """value with its digits, one by one, taken from digits."""
    nth = lambda i: F.length(F.regexp_replace(value.substr(F.lit(1), i + 1), r"\D", ""))
    return F.array_join(F.transform(F.split(value, ""), lambda c, i: F.when(c.rlike(r"^\d$"), _at(digits, nth(i))).otherwise(c)), "")


def _regrouped(value: Column, compact: Column) -> Column:
    """compact with the spaces of value."""
    nth = lambda i: F.length(F.replace(value.substr(F.lit(1), i + 1), F.lit(" "), F.lit("")))
    return F.array_join(F.transform(F.split(value, ""), lambda c, i: F.when(c == " ", c).otherwise(_at(compact, nth(i)))), "")


def _address(e: Column) -> Column:
    """Another IPv6 address, written like value: groups of zeros stay, others keep their number of digits.

    Addresses are unique local ones at the first attempt; from the fourth on, all groups but zeros have four digits;
    from attempt WIDER on, all groups have.
    """
    value, s = e["value"], e["s"]
    full = F.array_join(F.transform(F.split(e["canon"], ":"), lambda g, i: s.substr(i * 4 + 1, F.lit(4))), ":")

    def group(g: Column, i: Column) -> Column:
        n = F.length(F.regexp_replace(g, "^0+", ""))
        some = F.concat(F.translate(s.substr(i * 4 + 1, F.lit(1)), "0", "a"), s.substr(i * 4 + 2, F.when(e["attempt"] < 3, n - 1).otherwise(3)))
        return F.when(n == 0, "").when((i == 0) & (n == 4) & (e["attempt"] == 0), F.concat(F.lit("fd"), s.substr(3, 2))).otherwise(some)

    new = F.transform(F.split(e["canon"], ":"), group)
    left, right = _halves(value)

    def written_as(g: Column, i: Column) -> Column:
        other = F.coalesce(F.get(new, i), g)
        return F.lpad(other, F.greatest(F.length(g), F.length(other)), F.lit("0"))

    before = F.array_join(F.transform(left, written_as), ":")
    behind = F.array_join(F.transform(right, lambda g, j: written_as(g, F.lit(8) - F.size(right) + j)), ":")
    other = F.when(e["attempt"] >= WIDER, full).when(F.contains(value, F.lit("::")), F.concat(before, F.lit("::"), behind)).otherwise(before)
    return F.when(value.rlike("[A-F]"), F.upper(other)).otherwise(other)


def _person(e: Column) -> Column:
    """A title with another name: as many words, each of as many hyphened parts, the last word a family name.

    The last part grows by a syllable with every attempt.
    """
    s, rest, attempt = e["s"], e["rest"], e["attempt"]
    female = F.startswith(e["canon"], F.lit("f")) | (F.startswith(e["canon"], F.lit("n")) & (s.substr(1, 1) > "7"))
    words, own_parts = F.split(rest, " "), F.split(F.substr(e["canon"], F.lit(3)), "[ -]")

    def picked(names: list[str], some: Column) -> Column:
        """One of the names, none that the person has."""
        free = F.filter(F.array(*map(F.lit, names)), lambda n: ~F.array_contains(own_parts, F.lower(n)))
        return F.coalesce(F.get(free, F.conv(some.substr(1, 4), 16, 10).cast("int") % F.greatest(F.size(free), F.lit(1))), F.lit(names[0]))

    def word(w: Column, i: Column, script: str) -> Column:
        parts, family = F.split(w, "-"), i == F.size(words) - 1
        syllables = F.array(*map(F.lit, SYLLABLES[script]))
        syllable = lambda x, at: F.element_at(syllables, F.instr(F.lit(HEX), _at(x, at)).cast("int"))

        def part(p: Column, j: Column) -> Column:
            own = F.sha2(F.concat_ws("\u0001", s, i.cast("string"), j.cast("string")), 256)
            given = F.when(female, picked(FIRST_NAMES["f", script], own)).otherwise(picked(FIRST_NAMES["m", script], own))
            last = F.array_join(F.transform(F.sequence(F.lit(3), attempt + 5), lambda at: syllable(s, at)), "")
            inner = F.concat(syllable(own, F.lit(1)), syllable(own, F.lit(2)), syllable(own, F.lit(3)))
            new = F.when(~family, given).when(j == F.size(parts) - 1, last).otherwise(inner)
            return F.when(p.rlike(r"^\p{Lu}"), F.initcap(new)).otherwise(F.lower(new))

        return F.array_join(F.transform(parts, part), "-")

    by_script = {script: F.array_join(F.transform(words, lambda w, i: word(w, i, script)), " ") for script in SYLLABLES}  # noqa: B023
    return F.concat(e["title"], F.when(rest.rlike(r"\p{IsCyrillic}"), by_script["cyrillic"]).otherwise(by_script["latin"]))


def _check_sum(body: Column) -> Column:
    """Weighted digit sum of a card number without its check digit."""
    doubled = lambda c, i: F.when(i % 2 == 0, F.lit(2) * c - F.when(c > 4, 9).otherwise(0)).otherwise(c)
    return F.aggregate(F.transform(F.transform(F.split(F.reverse(body), ""), lambda c: F.coalesce(c.try_cast("int"), F.lit(0))), doubled), F.lit(0), lambda a, x: a + x)


def _check_digit(body: Column) -> Column:
    return ((F.lit(10) - _check_sum(body) % 10) % 10).cast("string")


def described(values: Column) -> Column:
    """array<struct<value, kind, canon>> for an array of entities. Each step binds what the next uses many times."""
    kinds = F.transform(values, lambda v: F.struct(v.alias("value"), kind_of(v).alias("kind")))
    return F.transform(kinds, lambda e: F.struct(e["value"].alias("value"), e["kind"].alias("kind"), canonical(e["kind"], e["value"]).alias("canon")))


def surrogates(found: Column, key: str) -> Column:
    """The replacements of an array<struct<value, kind, canon, attempt>>.

    Names grow by a syllable with every attempt, emails are longer from the third further one on; addresses leave
    10/8 for 240/4, then for all of IPv4. From attempt WIDER on, when a format is nearly used up, it is left: numbers
    and secrets grow by a character with every WIDER attempts, addresses become IPv6 ones with all groups in use.
    """
    bound = F.transform(found, lambda e: F.struct(
        *[e[c].alias(c) for c in ("value", "kind", "canon", "attempt")], _stream(key, e["kind"], e["canon"], e["attempt"], e["value"]).alias("s"),
        F.when(e["kind"] == "email", _stream(key, F.lit("domain"), F.lower(F.substring_index(e["value"], "@", -1)), F.lit(0), F.lit("")).substr(1, 7)).alias("domain"),
    ))
    bound = F.transform(bound, lambda e: F.struct(
        *[e[c].alias(c) for c in ("value", "kind", "canon", "attempt", "s", "domain")], _digits(e["s"]).alias("digits"), F.regexp_replace(e["value"], r"\D", "").alias("old"),
        *[F.translate(e["s"], HEX, a).alias(script) for script, a in LETTERS.items()],
        F.regexp_extract(e["value"], _TITLE, 1).alias("title"), F.regexp_extract(e["value"], _TITLE, 2).alias("rest"),
    ))
    return F.transform(bound, _replacement)


def _replacement(e: Column) -> Column:
    kind, value, s, digits, old, attempt = (e[c] for c in ("kind", "value", "s", "digits", "old", "attempt"))
    more = F.when(attempt >= 3, e["latin"].substr(200, 8)).otherwise("")
    wider = F.floor(attempt / WIDER).cast("int")
    grown = lambda number: F.concat(number, digits.substr(F.lit(129), wider))
    domain = F.concat(F.translate(e["domain"], HEX, LETTERS["latin"]), F.lit(".example."), F.substring_index(value, ".", -1))
    email = F.concat(_shaped(F.substring_index(value, "@", 1), e), more, F.lit("@"), domain)
    secret = F.concat(F.regexp_extract(value, _SECRET_HEAD, 1), _hidden(F.regexp_extract(value, _SECRET_HEAD, 2), e), e["latin"].substr(F.lit(129), wider))
    octet = lambda i: (F.conv(s.substr(i, 2), 16, 10).cast("int") % 254 + 1).cast("string")
    net = F.when(attempt == 0, F.lit("10")).when(attempt < 3, (F.lit(240) + octet(7).cast("int") % 15).cast("string")).otherwise(octet(7))
    ip = F.concat_ws(".", net, octet(1), octet(3), octet(5))
    ip = F.when(attempt < WIDER, ip).otherwise(F.concat(F.lit("fd"), s.substr(129, 2), F.lit(":"), s.substr(131, 4), F.lit("::"), ip))
    body = F.concat(old.substr(1, 1), digits.substr(F.lit(2), F.length(old) - 2))
    valid = _check_digit(old.substr(F.lit(1), F.length(old) - 1)) == F.right(old, F.lit(1))
    card = _refilled(value, F.concat(body, F.when(valid, _check_digit(body)).otherwise(digits.substr(60, 1))))
    n = F.length(e["canon"])
    phone = _refilled(value, F.concat(old.substr(F.lit(1), F.length(old) - n), F.translate(digits.substr(1, 1), "0", "7"), digits.substr(F.lit(2), n - 1)))
    iban = _regrouped(value, F.concat(e["canon"].substr(1, 2), _shaped(F.substr(e["canon"], F.lit(3)), e)))
    return (
        F.when(kind == "email", email).when(kind == "secret", secret).when(kind == "iban", iban).when(kind == "ipv6", _address(e))
        .when(kind == "ip", ip).when(kind == "ssn", grown(_refilled(value, digits.substr(1, 9)))).when(kind == "phone", grown(phone)).when(kind == "card", card).when(kind == "key", _hidden(value, e)).otherwise(_person(e))
    )


def further_attempts(found: DataFrame, key: str) -> DataFrame:
    """(kind, canon, attempt) of the entities whose first surrogates are taken.

    found holds kind, canon and one value of each distinct entity; names are compared without their titles' gender.
    A surrogate is taken if it is another entity, or if an entity settled before, or a smaller one of the same attempt, has it. Every kind's
    room grows with the attempts, so some attempt settles the last one.
    """
    real = found.select("kind", _ungendered(F.col("kind"), F.col("canon")).alias("sur")).distinct()
    open_, settled, attempt = found.withColumn("attempt", F.lit(0)), None, 0
    fixes = []
    while True:
        new = surrogates(F.array(F.struct("value", "kind", "canon", "attempt")), key)
        tried = open_.withColumn("sur", F.transform(new, lambda v: _ungendered(F.col("kind"), canonical(F.col("kind"), v)))[0])
        least = tried.groupBy("kind", "sur").agg(F.min("canon").alias("least"))
        taken = real if settled is None else real.unionByName(settled)
        least = least.join(taken.distinct(), ["kind", "sur"], "left_anti")
        judged = tried.join(least, ["kind", "sur"], "left").withColumn("ok", F.coalesce(F.col("canon") == F.col("least"), F.lit(False)))
        judged = written(judged.select("kind", "canon", "value", "attempt", "sur", "ok"), "surrogates")
        good = judged.where("ok").select("kind", "sur")
        settled = good if settled is None else settled.unionByName(good)
        if attempt:
            fixes.append(judged.where("ok").select("kind", "canon", "attempt"))
        open_ = judged.where("not ok").select("kind", "canon", "value", (F.col("attempt") + 1).alias("attempt"))
        attempt += 1
        if open_.isEmpty():
            break
    out = found.sparkSession.createDataFrame([], "kind string, canon string, attempt int")
    for f in fixes:
        out = out.unionByName(f)
    return out


def same_people(found: DataFrame) -> DataFrame:
    """(canon, like): names behind titles of no gender, each with the one gendered name of the corpus that it can be."""
    of_gender = lambda g: F.max(F.when(F.startswith("canon", F.lit(g)), F.col("canon"))).alias(g)
    people = found.where("kind = 'name'").groupBy(F.substr("canon", F.lit(3)).alias("bare")).agg(*map(of_gender, "mfn"))
    return people.where("n IS NOT NULL AND (m IS NULL) <> (f IS NULL)").select(F.col("n").alias("canon"), F.coalesce("m", "f").alias("like"))


def replace_entities(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, kept columns, text with surrogates, n_entities and kinds (distinct, sorted) for each row of docs.

    Whole texts; null texts stay null with no entities; texts without entities stay as they are; repeated rows
    are treated alike; empty tables give no rows; other columns, whatever their names, are left out.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), *keep, F.col(text_col).alias("text"))
    held = rows.select(row_key("doc_id", "text").alias("row"), entities(F.col("text")).alias("found")).where(F.size("found") > 0)
    held = held.select("row", described(F.array_distinct("found")).alias("found"))
    held = written(held.distinct(), "entities")
    each = held.select("row", F.explode("found").alias("e")).select("row", "e.kind", "e.value", "e.canon")
    distinct = written(each.groupBy("kind", "canon").agg(F.min("value").alias("value")), "distinct-entities")
    people = written(same_people(distinct).withColumn("kind", F.lit("name")), "people")
    attempts = written(further_attempts(distinct.join(people, ["kind", "canon"], "left_anti"), key), "attempts")
    alike = people.join(attempts.withColumnRenamed("canon", "like"), ["kind", "like"], "left").select("kind", "canon", "like", F.coalesce("attempt", F.lit(0)).alias("attempt"))
    fixes = attempts.select("kind", "canon", F.col("canon").alias("like"), "attempt").unionByName(alike)
    of_row = each.select("row", "kind", "canon").join(fixes, ["kind", "canon"]).groupBy("row")
    fix = F.struct(F.concat_ws("\u0001", "kind", "canon"), F.struct("like", "attempt"))
    of_row = written(of_row.agg(F.map_from_entries(F.collect_set(fix)).alias("fix")), "row-attempts")
    deleted(held, distinct, people, attempts)
    out = rows.withColumn("row", row_key("doc_id", "text")).join(of_row, "row", "left").withColumn("stretches", stretches(F.col("text")))

    found = described(F.filter("stretches", lambda x, i: i % 2 == 1))
    known = F.transform(found, lambda e: F.struct(e["value"].alias("value"), e["kind"].alias("kind"), e["canon"].alias("canon"), F.try_element_at("fix", F.concat_ws("\u0001", e["kind"], e["canon"])).alias("fix")))
    tried = F.transform(known, lambda e: F.struct(e["value"].alias("value"), e["kind"].alias("kind"), F.coalesce(e["fix"]["like"], e["canon"]).alias("canon"), F.coalesce(e["fix"]["attempt"], F.lit(0)).alias("attempt")))
    out = out.withColumn("tried", F.coalesce(tried, F.array().cast("array<struct<value:string,kind:string,canon:string,attempt:int>>")))
    gaps = F.filter("stretches", lambda x, i: i % 2 == 0)
    filled = F.zip_with(surrogates(F.col("tried"), key), F.slice(gaps, F.lit(2), F.size("tried")), lambda v, gap: F.concat(v, gap))
    text = F.when(F.size("tried") > 0, F.concat(gaps[0], F.array_join(filled, ""))).otherwise(F.col("text"))
    return out.select("doc_id", *keep, text.alias("text"), F.size("tried").alias("n_entities"), F.array_sort(F.array_distinct(F.transform("tried", lambda e: e["kind"]))).alias("kinds"))
