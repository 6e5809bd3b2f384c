"""Keyed surrogates for personal data, in DataFrame functions only.

Entities (e-mail addresses, IPv4 and IPv6 addresses, card and account numbers, national numbers,
phone numbers, secrets after their labels, access keys and private keys, and names after a title, after a
word that announces one, or beginning with a known first name) are found by one pattern. An entity is a
head that stays (a title, a country code, the mark of a key) and a core. The core is replaced
by a surrogate of its own kind and format:

* Letters and digits go through a keyed Feistel network whose rounds shift a character within
  its class (digits; vowels and consonants by case and script; other letters with case by script and
  neighbourhood), so that length, marks, case, script and class pattern stay. On strings of one pattern this is
  one-to-one.
* IPv4 addresses go through a Feistel network on two 16-bit halves; the last digit of a card
  number keeps its distance from the Luhn check digit; hexadecimal digits stay hexadecimal.
* A known first name becomes another of the same script and gender, by a keyed permutation of the list. Names
  are replaced part by part, so that "Mrs Anna Berg" and "Anna Berg" still speak of one person.

The surrogate depends on key and core alone: the same core has the same surrogate
everywhere (coreference), without a join. A check over the distinct cores of the corpus finds surrogates that two
share or that are themselves cores of the corpus; those get the first later
draw that is free, or a longer surrogate where their format has none left, from a table of exceptions
which is joined to the documents that hold them. A later draw of a full name changes all but its last part.

All kinds go through one network: the expression has some hundred nodes, whatever the
number of classes (``tests/llm`` holds it under 1,500).

Defined cases: a null text stays null with no entity; an empty text stays empty; texts without an
entity pass unchanged; repeated rows give repeated results, null ids are no special case; further columns are
kept, but one with the name of the count is replaced by it. The only
driver traffic is the number of exceptions left in each round.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harmattan.session import materialize

# Titles by gender, and first names by script and gender.
TITLES = {
    "m": ["Mr", "Mister", "Sir", "Herr", "Señor", "Sr", "Monsieur", "Господин", "Г-н"],
    "f": ["Mrs", "Ms", "Miss", "Madam", "Frau", "Señora", "Sra", "Señorita", "Madame", "Mme", "Mlle", "Госпожа", "Г-жа"],
    "": ["Dr", "Prof", "Доктор"],
}
FIRST_NAMES = {
    ("latin", "m"): ["Adam", "Albert", "Alexander", "Andrew", "Anthony", "Antonio", "Arthur", "Benjamin", "Bernard", "Carlos", "Charles", "Christian", "Daniel", "David", "Diego", "Edward", "Felix", "Fernando", "Francis", "Frederick", "George", "Henry", "Hugo", "Jacob", "James", "Javier", "Jean", "John", "Jonas", "Joseph", "Karl", "Klaus", "Leon", "Louis", "Lucas", "Manuel", "Martin", "Matthew", "Michael", "Miguel", "Nicolas", "Oliver", "Oscar", "Pablo", "Patrick", "Paul", "Peter", "Philip", "Pierre", "Ralph", "Raul", "Richard", "Robert", "Samuel", "Simon", "Stefan", "Thomas", "Victor", "Walter", "William"],
    ("latin", "f"): ["Alice", "Amelia", "Ana", "Andrea", "Angela", "Anna", "Barbara", "Beatrice", "Bianca", "Carmen", "Caroline", "Catherine", "Charlotte", "Christina", "Claire", "Clara", "Diana", "Dorothy", "Elena", "Elizabeth", "Emily", "Emma", "Eva", "Florence", "Frieda", "Gabriela", "Grace", "Hanna", "Helen", "Ingrid", "Irene", "Isabel", "Jane", "Jennifer", "Julia", "Katrin", "Laura", "Linda", "Lisa", "Lucia", "Margaret", "Maria", "Marie", "Martha", "Mary", "Monica", "Nadia", "Nicole", "Olivia", "Patricia", "Paula", "Rachel", "Rosa", "Sarah", "Silvia", "Sophie", "Susan", "Teresa", "Ursula", "Valerie"],
    ("cyrillic", "m"): ["Александр", "Алексей", "Андрей", "Борис", "Виктор", "Владимир", "Дмитрий", "Иван", "Михаил", "Николай", "Олег", "Павел", "Пётр", "Сергей", "Юрий"],
    ("cyrillic", "f"): ["Александра", "Анна", "Вера", "Галина", "Дарья", "Екатерина", "Елена", "Ирина", "Людмила", "Мария", "Наталья", "Ольга", "Светлана", "Софья", "Татьяна"],
}
# Characters that may stand for each other.
CLASSES = [
    "0123456789",
    "bcdfghjklmnpqrstvwxyz",
    "aeiou",
    "BCDFGHJKLMNPQRSTVWXYZ",
    "AEIOU",
    "áéíóúàèìòùâêîôûäëïöü",
    "ÁÉÍÓÚÀÈÌÒÙÂÊÎÔÛÄËÏÖÜ",
    "бвгджзклмнпрстфхцчшщ",
    "аеиоуыэюя",
    "БВГДЖЗКЛМНПРСТФХЦЧШЩ",
    "АЕИОУЫЭЮЯ",
]
HEX = "0123456789abcdef"
#: Stand-ins for hexadecimal digits on their way through the network: a class of their own.
HEX_MARKS = "".join(chr(0xE000 + i) for i in range(16))


def _other_cased() -> list[str]:
    """Further classes: the other letters with case, by script, case and neighbourhood."""
    groups = {"russian l": "ёйъь", "russian u": "ЁЙЪЬ"}
    known = set("".join(CLASSES) + "".join(groups.values()))
    for n in range(128, 0x10000):
        c = chr(n)
        if c not in known and unicodedata.category(c) in ("Lu", "Ll"):
            at = f"{unicodedata.name(c).split()[0]} {unicodedata.category(c)} {n >> 7}"
            groups[at] = groups.get(at, "") + c
    alone = "".join(g for g in groups.values() if len(g) == 1)
    return [g for g in groups.values() if len(g) > 1] + [alone] * (len(alone) > 1)


#: All classes in one text, a class a line.
LINES = "\n".join([*CLASSES, HEX_MARKS, *_other_cased()])

_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_NAME = r"\p{Lu}[\p{L}'’-]+"
_FIRST = "|".join(n for names in FIRST_NAMES.values() for n in names)
_TITLE = "|".join(t for titles in TITLES.values() for t in titles)
# Labels of secrets in any case, alone or after a prefix: access_token, DB-PASSWORD, clientSecret.
_LABEL = r"(?:(?<![\p{L}\p{N}])|(?<=[a-z0-9])(?=[A-Z]))(?i:token|secret|password|passwd|api[_-]?key)"
# Words before a name that no title or list gives away.
_CUE = "[Cc]all|[Cc]ontact|[Aa]sk for|[Ss]igned by|[Mm]y name is|[Aa]ppelez|[Cc]ontactez|[Ss]igné par|[Jj]e m’appelle|[Jj]e m'appelle"
# Each alternative begins with a test that fails at once nearly everywhere.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@(?:[\p{L}\p{N}-]+\.)+\p{L}{2,}",
    "secret": r"(?<=[=:\s\"'])(?=[A-Za-z0-9+/_-]{8})(?=[+/_-]*[A-Za-z0-9])(?<=[=:]\s{0,2}\\?[\"']?)"
    rf"(?<={_LABEL}\\?[\"']?\s{{0,2}}[=:]\s{{0,2}}\\?[\"']?)[A-Za-z0-9+/_-]{{8,}}",
    "key": r"(?=A[KS]IA)\bA[KS]IA[0-9A-Z]{16}\b|(?<=PRIVATE KEY-----\s{1,2})[A-Za-z0-9+/=\s]{32,}(?=\s?-----END)",
    "ipv4": rf"(?=\d)(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)",
    "ipv6": r"(?=[0-9A-Fa-f]{1,4}:)(?<![\p{L}\p{N}:])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){2,6}(?::[0-9A-Fa-f]{1,4}){1,5})(?![\p{L}\p{N}:])",
    "national": r"(?=\d)(?<![\d-])(?:\d{3}-\d{2}-\d{4}|\d \d{2} \d{2} \d[\dAB] \d{3} \d{3}(?: \d{2})?)(?![\d-])",
    "card": r"(?=\d)(?<!\d)(?:\d{13,19}|\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{1,7})(?!\d)",
    "account": r"(?=[A-Z]{2}\d{2})\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "phone": r"(?=[\d(+])(?:(?<![\d+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]\d{3,4}(?!\d)"
    r"|(?<!\d)\+\d{1,3}(?:[ .-]\d{2,4}){3,4}(?!\d)|(?<![\d+.-])0\d(?:[ .-]\d{2}){4}(?![\d-])|(?<![\d+.-])7\d[ .-]\d{3}[ .-]\d{2}[ .-]\d{2}(?![\d-])|(?<!\d)\+\d{8,15}(?!\d))",
    "person": rf"(?=\p{{Lu}}[\p{{L}}-]+\.? \p{{Lu}})\b(?:(?:{_TITLE})\.? (?:{_NAME})(?: {_NAME}){{0,2}}|(?:{_FIRST}) {_NAME}|(?<=\b(?:{_CUE}) ){_NAME}(?: {_NAME}){{1,2}})",
}
#: No entity begins between two letters, which spares most places all alternatives.
ENTITY = r"(?:(?<![a-z])|(?=[\d(+]))(?:" + "|".join(PATTERNS.values()) + ")"
#: What every text with an entity holds; a quick test that spares most texts the whole pattern.
HINT = r"[0-9@=:]|\p{Lu}[\p{L}-]+\.? \p{Lu}"


#: What stays of an entity: a title, a country code, the mark of an access key.
HEAD = rf"^(?:(?:{_TITLE})\.? (?=\p{{Lu}})|\+\d{{1,3}}[ .-]|A[KS]IA(?=[0-9A-Z]{{16}}$))"


def core_of(x: Column) -> Column:
    return F.regexp_replace(x, HEAD, "")


def kind_of(x: Column) -> Column:
    """Kind of a core that the pattern found, by its own shape."""
    return (
        F.when(x.contains("@"), "email")
        .when(x.rlike(rf"^(?:{_OCTET}\.){{3}}{_OCTET}$"), "ipv4")
        .when(x.rlike(r"^\d{13,19}$|^\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{1,7}$"), "card")
        .when(x.rlike(rf"^{_NAME}(?: {_NAME})*$"), "person")
        .when(x.rlike(r"^(?:[0-9a-f]{16,}|[0-9a-f:]*:[0-9a-f:]*)$"), "hex")
        .when(x.rlike(r"^[0-9A-F:]*:[0-9A-F:]*$"), "HEX")
        .otherwise("other")
    )


def _draw(key: str, *parts: Column) -> Column:
    """A non-negative number that depends on the key and the parts."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), *[p.cast("string") for p in parts]), 256), 1, 15), 16, 10).cast("long")


def _chars(x: Column):
    """Positions 0 to the length; position 0 is no character, so that the list is never empty."""
    return F.sequence(F.lit(0), F.length(x))


def _once(x: Column, use) -> Column:
    """``use(x)``, with ``x`` in the plan once however often it is used."""
    return F.transform(F.array(x), use)[0]


def _move(c: Column, by: Column) -> Column:
    """A character moved within its class; letters and numerals of no class become Latin consonants."""
    found = F.when(c == "\n", 0).otherwise(F.instr(F.lit(LINES), c))

    def within(s: Column) -> Column:
        own = F.concat(s["before"], s["after"])
        n = F.length(s["before"])
        return own.substr(F.pmod(n + s["by"], F.length(own)).cast("int") + 1, F.lit(1))

    def place(at: Column) -> Column:
        before = F.substring_index(F.lit(LINES).substr(F.lit(1), at - 1), "\n", -1)
        after = F.substring_index(F.lit(LINES).substr(at, F.lit(1 << 20)), "\n", 1)
        moved = _once(F.struct(before.alias("before"), after.alias("after"), by.alias("by")), within)
        other = F.lit(CLASSES[1]).substr(F.pmod(by, F.lit(len(CLASSES[1]))).cast("int") + 1, F.lit(1))
        return F.when(at > 0, moved).when(c.rlike(r"[\p{L}\p{N}]"), other).otherwise(c)

    return _once(found, place)


def feistel(x: Column, key: str, draw: Column) -> Column:
    """A keyed one-to-one change of strings that keeps the class of every character.

    Letters without case (which only mail addresses hold) and numerals other than ASCII digits become Latin
    consonants, which is not one-to-one; the check of ``exceptions`` keeps those surrogates distinct.
    """
    cut = F.floor(F.length(x) / 2).cast("int")
    begin = F.struct(F.substr(x, F.lit(1), cut).alias("a"), F.substr(x, cut + 1, F.length(x)).alias("b"))

    def turn(s: Column, r: Column) -> Column:
        # The halves change places each turn, so one expression serves both.
        def move(i: Column) -> Column:
            return F.when(i == 0, F.lit("")).otherwise(_once(s["a"].substr(i, F.lit(1)), lambda c: _move(c, _draw(key, draw, r, s["b"], i))))

        return F.struct(s["b"].alias("a"), F.array_join(F.transform(_chars(s["a"]), move), "").alias("b"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(4)), begin, turn, lambda s: F.concat(s["a"], s["b"]))


def _ipv4(x: Column, key: str, draw: Column) -> Column:
    octet = [F.split_part(x, F.lit("."), F.lit(i)).cast("long") for i in (1, 2, 3, 4)]
    begin = F.struct((octet[0] * 256 + octet[1]).alias("a"), (octet[2] * 256 + octet[3]).alias("b"))

    def turn(s: Column, r: Column) -> Column:
        return F.struct(s["b"].alias("a"), F.pmod(s["a"] + _draw(key, draw, r, s["b"]), F.lit(65536)).alias("b"))

    def text(s: Column) -> Column:
        return F.concat_ws(".", *[n.cast("int").cast("string") for h in ("a", "b") for n in (F.floor(s[h] / 256), s[h] % 256)])

    return F.aggregate(F.sequence(F.lit(1), F.lit(4)), begin, turn, text)


def _luhn(body: Column) -> Column:
    """Check digit that Luhn's rule gives a body of digits."""
    back = F.reverse(F.regexp_replace(body, r"\D", ""))

    def add(total: Column, i: Column) -> Column:
        twice = back.substr(i, F.lit(1)).cast("int") * (1 + i % 2)
        return total + F.when(i == 0, 0).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.pmod(-F.aggregate(_chars(back), F.lit(0), add), F.lit(10))


def _piece(text: Column, how: Column, draw: Column) -> Column:
    return F.struct(text.alias("text"), how.alias("how"), draw.cast("int").alias("draw"))


def _pieces(x: Column, kind: Column, draw: Column) -> Column:
    """A core as a list of pieces, each with how it changes: stay, name, hex, HEX or move."""
    stay, move, never = F.lit("stay"), F.lit("move"), F.lit(0)
    local, domain = F.split_part(x, F.lit("@"), F.lit(1)), F.split_part(x, F.lit("@"), F.lit(-1))
    top = F.split_part(domain, F.lit("."), F.lit(-1))
    rest = F.substr(domain, F.lit(1), F.length(domain) - F.length(top) - 1)
    email = F.array(_piece(local, move, draw), _piece(F.lit("@"), stay, never), _piece(rest, move, never), _piece(F.concat(F.lit("."), top), stay, never))
    words = F.split(x, " ")
    last = F.size(words) - 1

    def part(p: Column, i: Column) -> Column:
        known = F.when(_listed(p).isNotNull(), "name").otherwise("move")
        own = F.when((i < last) | (last == 0), draw).otherwise(0)
        return F.array(_piece(F.when(i > 0, " ").otherwise(""), stay, never), _piece(p, known, own))

    body = F.substr(x, F.lit(1), F.length(x) - 1)
    return (
        F.when(kind == "email", email)
        .when(kind == "person", F.flatten(F.transform(words, part)))
        .when(kind == "card", F.array(_piece(body, move, draw)))
        .otherwise(F.array(_piece(x, F.when(kind.isin("hex", "HEX"), kind).otherwise("move"), draw)))
    )


def _listed(name: Column) -> Column:
    """The list of first names, joined by commas, that holds a name; else null."""
    out = None
    for names in FIRST_NAMES.values():
        held = F.instr(F.lit("," + ",".join(names) + ","), F.concat(F.lit(","), name, F.lit(","))) > 0
        out = F.when(held, ",".join(names)) if out is None else out.when(held, ",".join(names))
    return out


def _other_name(name: Column, key: str, draw: Column) -> Column:
    """The next name in the keyed order of its list: one cycle through all names, so none stays and no two meet."""
    order = F.array_sort(F.transform(F.split(_listed(name), ","), lambda n: F.struct(F.sha2(F.concat_ws("|", F.lit(key), draw.cast("string"), n), 256).alias("by"), n.alias("name"))))
    return _once(F.transform(order, lambda n: n["name"]), lambda names: F.element_at(names, (F.pmod(F.array_position(names, name), F.size(names)) + 1).cast("int")))


def _changed(p: Column, key: str) -> Column:
    text, how = p["text"], p["how"]
    marked = F.when(how == "hex", F.translate(text, HEX, HEX_MARKS)).when(how == "HEX", F.translate(text, HEX.upper(), HEX_MARKS)).otherwise(text)

    def back(made: Column) -> Column:
        return F.when(how == "hex", F.translate(made, HEX_MARKS, HEX)).when(how == "HEX", F.translate(made, HEX_MARKS, HEX.upper())).otherwise(made)

    moved = _once(marked, lambda m: _once(feistel(m, key, p["draw"]), back))
    return F.when(how == "stay", text).when(how == "name", _other_name(text, key, p["draw"])).otherwise(moved)


def surrogate(x: Column, key: str, draw: Column | None = None) -> Column:
    """The surrogate of a core; ``draw`` numbers further draws after a collision."""
    draw = F.lit(0) if draw is None else draw

    def whole(e: Column) -> Column:
        x, kind = e["x"], e["kind"]
        body = F.substr(x, F.lit(1), F.length(x) - 1)

        def finish(made: Column) -> Column:
            digit = F.pmod(_luhn(made) + F.substr(x, F.length(x), F.lit(1)).cast("int") - _luhn(body), F.lit(10))
            return F.when(kind == "card", F.concat(made, digit.cast("int").cast("string"))).otherwise(made)

        made = F.array_join(F.transform(_pieces(x, kind, e["draw"]), lambda p: _changed(p, key)), "")
        return F.when(kind == "ipv4", _ipv4(x, key, e["draw"])).otherwise(_once(made, finish))

    return _once(F.struct(x.alias("x"), kind_of(x).alias("kind"), draw.cast("int").alias("draw")), whole)


def longer(x: Column, made: Column, key: str, draw: Column, extra: Column) -> Column:
    """The surrogate ``made`` for ``x`` with ``extra`` more characters: before a mail address, at the end of all else."""
    kind = kind_of(x)
    pool = (
        F.when(kind.isin("ipv4", "card") | ~x.rlike(r"\p{L}"), CLASSES[0])
        .when(kind == "hex", HEX)
        .when(kind == "HEX", HEX.upper())
        .when(x.rlike(r"\p{IsCyrillic}$"), CLASSES[7])
        .otherwise(CLASSES[1])
    )
    more = F.array_join(F.transform(F.sequence(F.lit(1), extra), lambda i: pool.substr(F.pmod(_draw(key, draw, x, i), F.length(pool)).cast("int") + 1, F.lit(1))), "")
    return F.when(kind == "email", F.concat(more, made)).otherwise(F.concat(made, more))


def entities(text: Column) -> Column:
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(f"({ENTITY})"), F.lit(1)))


def exceptions(docs: DataFrame, key: str, text_col: str = "text", max_draws: int = 64) -> DataFrame:
    """entity, surrogate of those cores whose first surrogate is another's too or itself occurs.

    Among cores that share a surrogate the first by spelling keeps it. Each of the others takes the first of its
    later draws that is free; a round tries twice as many draws as the one before. Where a format has no free value left in
    ``max_draws`` draws, surrogates get longer by a character a round, so that free ones are always found.
    """
    found = docs.select(F.explode(F.transform(entities(F.col(text_col)), core_of)).alias("entity")).distinct()
    # Few bytes but much work: not to be merged into one task.
    found = found.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "entity")
    known = materialize(found.withColumn("surrogate", surrogate(F.col("entity"), key)))
    real = known.select(F.col("entity").alias("surrogate"))

    def shared(new: DataFrame) -> DataFrame:
        """Entities of ``new`` whose surrogate goes to one before them."""
        keepers = new.groupBy("surrogate").agg(F.min("entity").alias("keeper"), F.count("*").alias("n")).filter("n > 1")
        return new.join(keepers, "surrogate").filter(F.col("entity") != F.col("keeper")).select("entity")

    open_ = materialize(shared(known).union(known.join(real, "surrogate", "left_semi").select("entity")).distinct())
    kept = known.join(open_, "entity", "left_anti").select("surrogate")
    settled = None
    first, extra = 1, 0
    later = surrogate(F.col("entity"), key, F.col("draw"))
    while not open_.isEmpty():
        last = min(2 * first - 1, max_draws) if first <= max_draws else first
        extra += first > max_draws
        drawn = open_.withColumn("draw", F.explode(F.sequence(F.lit(first), F.lit(last)))).withColumn("surrogate", later)
        if extra:
            drawn = drawn.withColumn("surrogate", longer(F.col("entity"), F.col("surrogate"), key, F.col("draw"), F.lit(extra)))
        first = last + 1
        drawn = materialize(drawn)
        taken = kept if settled is None else kept.union(settled.select("surrogate"))
        free = drawn.join(real, "surrogate", "left_anti").join(taken, "surrogate", "left_anti")
        free = materialize(free.groupBy("entity").agg(F.min_by("surrogate", "draw").alias("surrogate")))
        good = free.join(shared(free), "entity", "left_anti")
        settled = materialize(good if settled is None else settled.union(good))
        open_ = materialize(open_.join(settled, "entity", "left_anti"))
    return settled if settled is not None else known.limit(0)


def replace(docs: DataFrame, key: str, text_col: str = "text", count_col: str | None = "n_entities") -> DataFrame:
    """``docs`` with surrogates in the text column, and the number of entities if a name for it is given."""
    other = exceptions(docs, key, text_col)
    kept = [c for c in docs.columns if count_col is None or c.lower() != count_col.lower()]
    rest = F.struct(*[docs[c] for c in kept if c != text_col], F.lit(0).alias("_"))
    # Exceptions go by text: a hash that two texts share would only join their lists.
    rows = docs.select(rest.alias("row"), F.xxhash64(text_col).alias("at"), docs[text_col].alias("text"))
    held = (
        rows.select("at", F.explode(F.array_distinct(F.transform(entities(F.col("text")), core_of))).alias("entity"))
        .join(other, "entity")
        .groupBy("at")
        .agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct("entity", "surrogate")))).alias("other"))
    )
    held = materialize(held)
    text = F.col("text")
    mark = F.concat(F.lit("\u0001"), F.hex(F.xxhash64(text)), F.lit("\u0001"))
    # One pass of the pattern: parts at odd places are entities.
    parts = F.when(text.rlike(HINT), F.split(F.regexp_replace(text, F.lit(f"({ENTITY})"), F.concat(mark, F.lit("$1"), mark)), mark, -1))
    joined = rows.withColumn("parts", parts).join(held, "at", "left")

    def changed(p: Column) -> Column:
        new = _once(core_of(p), lambda core: F.concat(F.substr(p, F.lit(1), F.length(p) - F.length(core)), F.coalesce(F.element_at(F.col("other"), core), surrogate(core, key))))
        return new

    new = F.transform("parts", lambda p, i: F.when(i % 2 == 1, changed(p)).otherwise(p))
    new = F.when(F.size("parts") > 1, F.array_join(new, "")).otherwise(text)
    columns = [(new if c == text_col else F.col("row").getField(c)).alias(c) for c in kept]
    if count_col:
        columns.append(F.coalesce(F.floor(F.size("parts") / 2), F.lit(0)).cast("long").alias(count_col))
    return joined.select(columns)
