"""Surrogates for personal data, in DataFrame functions only.

Entities are found by one pattern: e-mail addresses, cards, phones, IPv4 addresses, social-security
numbers, IBANs, secrets, and names after a form of address. Each gets a surrogate of its kind that
is made from a keyed digest of its canonical form, so that all mentions of an entity, in whatever
format, change alike in all documents (coreference). Separators, letter case, digits and letters stay where they
are; cards that pass the Luhn test still do; names keep the form of address, and get given names of
its gender in their own script.

Collision check: surrogates of the distinct entities of the whole table are compared with each other
and with all entities. An entity whose surrogate another entity has (or is) draws again, under the
next attempt number, until all differ (distinctness). Attempts beyond 0 are joined back.

A null text stays null, an empty one empty. Repeated rows change alike. All columns are kept, whatever
their names, with ``text`` replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segspark.llm.shared import delete, free_name, written

KEY = "surrogates-1"
#: Attempts from this on lengthen the surrogate, so that small ranges don't run out.
LONGER = 6

# Forms of address by the gender of the given names that follow them.
TITLES = {
    "m": ["Mr", "Mister", "Sir", "Herr", "Señor", "Monsieur", "Господин", "Κύριος"],
    "f": ["Mrs", "Ms", "Miss", "Madam", "Frau", "Señora", "Señorita", "Madame", "Mademoiselle", "Госпожа", "Κυρία"],
    "n": ["Dr", "Prof", "Professor", "Доктор"],
}
# Given names by script and gender, and syllables of family names by script.
GIVEN = {
    ("latin", "m"): "Adam Bruno Carl David Emil Felix Georg Hugo Ivan Jonas Karl Leon Marco Nils Oscar Paul Robin Simon Tom Victor".split(),
    ("latin", "f"): "Anna Bella Clara Diana Emma Flora Greta Helen Irene Julia Karin Laura Maria Nina Olga Paula Rosa Sofia Tina Vera".split(),
    ("cyrillic", "m"): "Антон Борис Виктор Глеб Иван Кирилл Максим Олег Павел Роман".split(),
    ("cyrillic", "f"): "Анна Вера Галина Дарья Елена Ирина Мария Нина Ольга Софья".split(),
    ("greek", "m"): "Άρης Γιώργος Δημήτρης Κώστας Νίκος Πέτρος Σπύρος Φώτης".split(),
    ("greek", "f"): "Άννα Ελένη Ζωή Κατερίνα Μαρία Νίκη Σοφία Χριστίνα".split(),
}
SYLLABLES = {"latin": "ba da fe go ha ke li mo na pe ri so ta ve wi zu".split(), "cyrillic": "ба да ве го жи ка ле мо на пе ри со та фе ху ци".split(), "greek": "βα γα δε ζο θι κα λε μο να πε ρι σο τα φε χυ ψι".split()}

_TITLE = "|".join(t for g in TITLES.values() for t in sorted(g, key=len, reverse=True))
_TITLE_LETTERS = "".join(sorted({t[0] for g in TITLES.values() for t in g}))
# Particles of family names, which stay. Those of the second list are articles elsewhere: they count right after a form of address or another particle only.
_PARTICLES = "van von de del della di da dos das du la le las los bin ibn af av ter ten".split()
_ARTICLES = "der den dem".split()
_PARTICLE = rf"(?:(?:{'|'.join(_PARTICLES)}) (?:(?:{'|'.join(_ARTICLES)}) )?)"
#: One part of a name: initials, a word, or both without a space.
_PART = r"(?:[dDlL]['’]|al-|el-)?(?:\p{Lu}\.-?)*(?:\p{Lu}[\p{L}'’-]+|\p{Lu}\.|\p{Lu}(?= \p{Lu}))"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: Kinds and their patterns, in order of preference. The combined pattern tries them in this order at each place.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*\.\p{L}{2,}",
    "secret": r"(?<=[=:] ?[\"']?)(?<=(?i:token|secret|password|passwd|api_key|apikey)(?: ?[=:] ?)[\"']?)[A-Za-z0-9_+/.=-]{8,}+|(?<![A-Za-z0-9])(?i:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Z0-9]{20,}+|sk-[A-Z0-9]{20,}+|[0-9a-f]{32,}+)(?![A-Za-z0-9])",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "card": r"(?<![\d+])\d(?:[ -]?\d){12,18}(?!\d)",
    "phone": r"(?<![\p{L}\p{N}+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)|(?<![\p{L}\p{N}(])(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[.-]\d{4}(?!\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "ip": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)",
    "name": rf"(?<![\p{{L}}])(?=[{_TITLE_LETTERS}])(?:(?:{_TITLE})\.? )+(?:(?:{'|'.join(_ARTICLES)}) )?{_PARTICLE}*{_PART}(?: {_PARTICLE}*{_PART})*",
}
#: No pattern starts within a word of ASCII letters, but for digits: that is looked at first, since it fails at most places.
ANY = r"(?:(?=[0-9])|(?<![A-Za-z]))(?:" + "|".join(f"(?:{p})" for p in PATTERNS.values()) + ")"
#: What a text with an entity holds at least: texts without it are not searched.
HINT = rf"[@0-9]|{_TITLE}|(?i:token|secret|passw|api_?key|sk-|gh[pousr]_|AKIA|[a-f]{{32}})"

_INITIALS = r"^\p{L}(?:\.-?\p{L})*\.?$"
_HEXADECIMAL = "^(?:[0-9a-f]+|[0-9A-F]+)$"


def kind_of(mention: Column) -> Column:
    """The kind of a mention: the first whose pattern fits it. Secrets after a keyword have no pattern of their own."""
    tests = [(k, F.regexp_like(mention, F.lit(f"^(?:{p})$"))) for k, p in PATTERNS.items()]
    return reduce(lambda c, t: c.when(t[1], t[0]), tests[1:], F.when(tests[0][1], tests[0][0])).otherwise("secret")


def canonical_of(kind: Column, mention: Column) -> Column:
    """What all mentions of an entity have in common: letters and digits for numbers, lower case for the rest.

    In secrets capitals tell, but not in hexadecimal ones that are all in capitals or all without.
    """
    numbers = F.when(F.startswith(mention, F.lit("+")), "+").otherwise("")
    return F.when(kind.isin("card", "phone", "ssn", "iban"), F.concat(numbers, F.regexp_replace(mention, "[^A-Za-z0-9]", ""))).when(kind.isin("email", "name") | (kind == "secret") & F.regexp_like(mention, F.lit(_HEXADECIMAL)), F.lower(mention)).otherwise(mention)


def _digest(*parts: Column) -> Column:
    """128 hexadecimal digits that depend on the key."""
    return F.sha2(F.concat_ws("\u0000", F.lit(KEY), *parts).cast("binary"), 512)


def _let(value: Column, of) -> Column:
    """An expression of a value that is evaluated once."""
    return F.element_at(F.transform(F.array(value), of), 1)


def _draw(digest: Column, i: Column, most: int) -> Column:
    """A number below most, from the i-th (from 0) of 31 places of a digest."""
    return F.pmod(F.conv(F.substring(digest, (i % 31) * 4 + 1, F.lit(4)), 16, 10).cast("int"), F.lit(most))


def _pick(digest: Column, i: Column, text: str) -> Column:
    return F.substring(F.lit(text), _draw(digest, i, len(text)) + 1, F.lit(1))


_LETTERS = "abcdefghijklmnopqrstuvwxyz"


def _like(text: Column, digest: Column, kept: Column, hexadecimal: Column) -> Column:
    """A text with the same kinds of characters; the first ``kept`` stay."""

    def one(i: Column) -> Column:
        c = F.substring(text, i + 1, F.lit(1))
        low = F.when(hexadecimal & c.rlike("[a-fA-F]"), _pick(digest, i, "abcdef")).otherwise(_pick(digest, i, _LETTERS))
        return F.when(i < kept, c).when(c.rlike("[0-9]"), F.when((i == kept) & (c != "0"), _pick(digest, i, "123456789")).otherwise(_pick(digest, i, "0123456789"))).when(c.rlike(r"\p{Lu}"), F.upper(low)).when(c.rlike(r"\p{L}|\p{N}"), low).otherwise(c)

    return F.array_join(F.transform(F.sequence(F.lit(0), F.length(text) - 1), one), "")


def _luhn(digits: Column) -> Column:
    """The sum of the Luhn test over all but the last digit, as if it stood there."""
    n = F.length(digits)

    def value(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
        return F.when((n - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(1), n - 1), value), F.lit(0), lambda a, x: a + x)


def _check_digit(digits: Column) -> Column:
    return F.pmod(F.lit(10) - _luhn(digits) % 10, F.lit(10)).cast("string")


def _script(c: Column) -> Column:
    return F.when(c.rlike(r"\p{IsCyrillic}"), "cyrillic").when(c.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def _gender(canonical: Column) -> Column:
    """By the form of address; where it tells nothing, n."""
    title = F.regexp_extract(canonical, r"^[^ .]+", 0)
    return F.when(title.isin([t.lower() for t in TITLES["m"]]), "m").when(title.isin([t.lower() for t in TITLES["f"]]), "f").otherwise("n")


def _name(canonical: Column, attempt: Column) -> Column:
    """The forms of address and particles, a given name or initials for each of the other words, and a family name for the last.

    Each part has its own digest, so parts corefer too.
    """
    title = F.regexp_extract(canonical, rf"^(?:(?:{_TITLE.lower()})\.? )+", 0)
    rest = F.split(F.substring(canonical, F.length(title) + 1, F.length(canonical)), " ")
    script, gender = _script(F.element_at(rest, -1)), _gender(canonical)

    def given(digest: Column, part: Column) -> Column:
        lists = []
        for (s, g), names in GIVEN.items():
            # the next one if the draw is the name itself
            own = F.coalesce(F.array_position(F.array(*(F.lit(n.lower()) for n in names)), part), F.lit(0))
            drawn = _draw(digest, F.lit(0), len(names))
            pick = F.element_at(F.array(*map(F.lit, names)), (F.when(drawn + 1 == own, drawn + 1).otherwise(drawn) % len(names) + 1).cast("int"))
            either = (gender == "n") & (_draw(digest, F.lit(1), 2) == (0 if g == "m" else 1))
            lists.append(((script == s) & ((gender == g) | either), pick))
        return reduce(lambda c, t: c.when(*t), lists[1:], F.when(*lists[0]))

    def family(digest: Column) -> Column:
        made = [(s, F.concat(*(F.element_at(F.array(*map(F.lit, x)), _draw(digest, F.lit(i), len(x)) + 1) for i in range(4)))) for s, x in SYLLABLES.items()]
        return reduce(lambda c, t: c.when(script == t[0], t[1]), made[1:], F.when(script == made[0][0], made[0][1]))

    def initials(part: Column, digest: Column) -> Column:
        alphabets = F.when(script == "cyrillic", _pick(digest, F.lit(0), "абвгдежзиклмнопрст")).when(script == "greek", _pick(digest, F.lit(0), "αβγδεζηθικλμνξοπρ")).otherwise(_pick(digest, F.lit(0), _LETTERS))
        return F.regexp_replace(part, F.lit(r"\p{L}"), alphabets)

    def before(part: Column) -> Column:
        made = lambda d: F.when(F.regexp_like(part, F.lit(_INITIALS)), initials(part, d)).otherwise(given(d, part))
        return F.when(part.isin(_PARTICLES + _ARTICLES), part).otherwise(_let(_digest(F.lit("given"), gender, part, attempt), made))

    firsts = F.transform(F.slice(rest, F.lit(1), F.size(rest) - 1), before)
    return F.lower(F.concat(title, F.array_join(F.concat(firsts, F.array(_let(_digest(F.lit("family"), F.element_at(rest, -1), attempt), family))), " ")))


def surrogate_of(kind: Column, canonical: Column, attempt: Column) -> Column:
    """The canonical form of the surrogate."""
    no, zero = F.lit(False), F.lit(0)

    def email(digest: Column) -> Column:
        domain = F.regexp_extract(canonical, "@(.*)$", 1)
        top = F.regexp_extract(domain, r"\.[^.]*$", 0)
        labels = F.substring(domain, F.lit(1), F.length(domain) - F.length(top))
        return F.concat(_like(F.regexp_extract(canonical, "^[^@]*", 0), digest, zero, no), F.lit("@"), _let(_digest(F.lit("domain"), domain), lambda d: _like(labels, d, zero, no)), top)

    def card(like: Column) -> Column:
        # the test digit is that of all digits before it
        valid = F.substring(canonical, F.length(canonical), F.lit(1)) == _check_digit(canonical)
        return F.when(valid, F.concat(F.substring(like, F.lit(1), F.length(like) - 1), _check_digit(like))).otherwise(like)

    def made(digest: Column) -> Column:
        plus = F.startswith(canonical, F.lit("+"))
        hexadecimal = (kind == "secret") & F.regexp_like(canonical, F.lit("^[0-9a-fA-F]+$"))
        kept = F.when(kind == "card", 1).when(plus | (kind == "iban"), 2).otherwise(0)
        longer = F.when(attempt >= LONGER, F.substring(digest, F.lit(1), attempt - LONGER + 1)).otherwise("")
        tail = F.when(kind.isin("name", "secret"), longer).otherwise(F.translate(longer, "abcdef", "012345"))
        return (
            F.when(kind == "email", F.concat(longer, email(digest)))
            .when(kind == "ip", F.concat_ws(".", *((_draw(digest, F.lit(i), 254) + 1).cast("string") for i in range(4))))
            .when(kind == "name", F.concat(_name(canonical, attempt.cast("string")), tail))
            .when(kind == "card", F.concat(_let(_like(canonical, digest, kept, no), card), tail))
            .otherwise(F.concat(_like(canonical, digest, kept, hexadecimal), tail))
        )

    return _let(_digest(kind, canonical, attempt.cast("string")), made)


def _shaped(kind: Column, mention: Column, made: Column) -> Column:
    """A surrogate in the format of a mention: its separators and its capitals."""

    def numbers() -> Column:
        before = lambda i: F.length(F.regexp_replace(F.substring(mention, F.lit(1), i), "[^A-Za-z0-9]", ""))

        def laid(plain: Column) -> Column:
            one = lambda i: F.when(F.substring(mention, i, F.lit(1)).rlike("[A-Za-z0-9]"), F.substring(plain, before(i), F.lit(1))).otherwise(F.substring(mention, i, F.lit(1)))
            rest = F.substring(plain, before(F.length(mention)) + 1, F.length(plain))
            return F.concat(F.array_join(F.transform(F.sequence(F.lit(1), F.length(mention)), one), ""), rest)

        return _let(F.regexp_replace(made, "[^A-Za-z0-9]", ""), laid)

    # a name has as many words as its surrogate: particles stay as they are
    def word(old: Column, new: Column) -> Column:
        return F.when(old.isin(_PARTICLES + _ARTICLES), old).when(F.regexp_like(old, F.lit(_INITIALS)) & F.regexp_like(new, F.lit(_INITIALS)), F.upper(new)).otherwise(F.initcap(new))

    upper = F.when(F.regexp_like(mention, F.lit(r"^[^\p{Ll}]+$")), F.upper(made)).otherwise(made)
    return F.when(kind.isin("card", "phone", "ssn", "iban"), numbers()).when((kind == "email") | (kind == "secret") & F.regexp_like(mention, F.lit(_HEXADECIMAL)), upper).when(kind == "name", F.when(F.regexp_like(mention, F.lit(r"^[^\p{Ll}]+$")), F.upper(made)).otherwise(F.array_join(F.zip_with(F.split(mention, " "), F.split(made, " "), word), " "))).otherwise(made)


def mentions(text: Column) -> Column:
    """(kind, mention, canonical) of each entity of a text, in order."""
    found = F.when(F.regexp_like(text, F.lit(HINT)), F.regexp_extract_all(text, F.lit(ANY), F.lit(0)))
    kinds = F.transform(F.coalesce(found, F.array().cast("array<string>")), lambda m: F.struct(kind_of(m).alias("kind"), m.alias("mention")))
    return F.transform(kinds, lambda m: F.struct(m["kind"].alias("kind"), m["mention"].alias("mention"), canonical_of(m["kind"], m["mention"]).alias("canonical")))


def entities(docs: DataFrame) -> DataFrame:
    """(kind, canonical): the distinct entities of all documents."""
    return docs.select(F.explode(mentions(F.col("text"))).alias("m")).select("m.kind", "m.canonical").distinct()


def attempts(found: DataFrame) -> DataFrame:
    """(kind, canonical, attempt) of the entities whose first draw collides, under attempts that don't."""
    made = surrogate_of(F.col("kind"), F.col("canonical"), F.col("attempt")).alias("made")
    now = written(found.select("kind", "canonical", F.lit(0).alias("attempt")).select("*", made))
    while True:
        # of those that draw the same one keeps it: the one with the fewest attempts, then the smallest
        kept = now.groupBy("kind", "made").agg(F.min(F.struct("attempt", "canonical")).alias("first"), F.count("*").alias("n"))
        twice = now.join(kept.where("n > 1"), ["kind", "made"]).where(F.struct("attempt", "canonical") != F.col("first")).select("kind", "canonical")
        real = now.join(now.select("kind", F.col("canonical").alias("made")), ["kind", "made"], "left_semi").select("kind", "canonical")
        again = written(twice.union(real).distinct())
        if again.isEmpty():
            delete(again)
            return now.where("attempt > 0").drop("made")
        new = now.join(again, ["kind", "canonical"]).select("kind", "canonical", (F.col("attempt") + 1).alias("attempt")).select("*", made)
        next_ = written(now.join(again, ["kind", "canonical"], "left_anti").select(*now.columns).union(new))
        delete(now, again)
        now = next_


def replace(docs: DataFrame) -> DataFrame:
    """The documents with ``text`` replaced, and ``n_entities``, the number of its mentions; ``n_entities_`` if they have a column of that name."""
    columns = [c for c in docs.columns if c != "text"]
    quoted = [F.col(f"`{c}`") for c in columns]
    found = attempts(entities(docs))
    rows = docs.select(F.struct(*quoted).alias("kept"), "text", mentions(F.col("text")).alias("found"))
    if found.isEmpty():
        rows = rows.withColumn("drawn", F.lit(None).cast("map<string,int>"))
    else:
        # documents that hold such entities get their attempts; a document's distinct mentions only
        row = F.struct("kept", "text")
        keyed = rows.withColumn("row", F.sha2(F.to_json(row), 256))
        wanted = keyed.where(F.size("found") > 0).select("row", F.explode(F.array_distinct(F.transform("found", lambda m: F.struct(m["kind"].alias("kind"), m["canonical"].alias("canonical"))))).alias("m")).select("row", "m.kind", "m.canonical").distinct()
        drawn = wanted.join(found, ["kind", "canonical"]).groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("\u0000", "kind", "canonical"), "attempt"))).alias("drawn"))
        rows = keyed.join(drawn, "row", "left")
    attempt = lambda m: F.coalesce(F.element_at(F.col("drawn"), F.concat_ws("\u0000", m["kind"], m["canonical"])), F.lit(0))
    made = F.transform("found", lambda m: _let(surrogate_of(m["kind"], m["canonical"], attempt(m)), lambda made: _shaped(m["kind"], m["mention"], made)))
    between = F.split("text", ANY, -1)
    text = F.when(F.size("found") > 0, F.array_join(F.flatten(F.zip_with(between, made, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")).otherwise(F.col("text"))
    return rows.select(*(F.col(f"kept.`{c}`").alias(c) for c in columns), text.alias("text"), F.size("found").cast("long").alias(free_name("n_entities", docs.columns)))
