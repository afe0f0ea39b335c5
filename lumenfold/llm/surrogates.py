"""Personal data and secrets, replaced by keyed surrogates of the same kind.

Only DataFrame functions run here. Entities are found by patterns, reduced to a
canonical form (so that spellings of one entity stay one), and each distinct
form gets a surrogate from a keyed hash: digits for digits, letters for letters
of the same case and script, card and account numbers with right check digits,
names of the same gender and script, in capitals where the name was. Surrogates that meet each other or a real entity are drawn
again until all are distinct. The texts then get them in place.

Names stand behind a title or begin with a given name, of the list below or of
those that a caller adds; others stay. They may hold inner capitals, apostrophes,
initials and particles, and be in capitals throughout. A given name alone is
replaced in documents that have it with a surname (of several such persons the
first by spelling). Surnames
have surrogates of their own, so that a family keeps its name in all forms; a
full name is one person for each gender that titles give it. Without a title
the gender is the one that the name has elsewhere, else that of its given name,
else either. Each draw makes longer names, so their number has no bound.

A secret's value runs from its name to the next white space, quote, angle
bracket, comma or semicolon, however long; it has 8 characters at least and a
digit. A phone number has a + and 8 to 15 digits, in any groups or none; or the
North American groups of three and four; or a leading 0 and 9 to 12 digits in groups.
Digits without +, separators or brackets can't be told from other numbers and
stay, as do values of fewer than 8 characters or without a digit. Tokens are
known by the beginnings below; of a private key the lines between its marks go.
Addresses of version 6 have eight groups or a double colon between groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, identified, settle

# Titles by gender, given names by gender and script, syllables of surnames by script, further given names by which names without a title are known.
MALE_TITLES = ["Mr", "Herr", "Señor", "Monsieur", "Господин"]
FEMALE_TITLES = ["Mrs", "Ms", "Miss", "Frau", "Señora", "Madame", "Госпожа"]
NEUTRAL_TITLES = ["Dr", "Prof", "Доктор"]
GIVEN = {
    ("male", "latin"): ["Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karim", "Luis"],
    ("female", "latin"): ["Anna", "Berta", "Clara", "Diana", "Elena", "Frida", "Greta", "Helena", "Irma", "Julia", "Karla", "Lena"],
    ("male", "cyrillic"): ["Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Кирилл", "Лев", "Максим", "Олег", "Павел"],
    ("female", "cyrillic"): ["Анна", "Вера", "Галина", "Дарья", "Елена", "Зоя", "Ирина", "Лидия", "Мария", "Нина", "Ольга", "Софья"],
    ("male", "greek"): ["Νίκος", "Πέτρος", "Κώστας", "Λουκάς"],
    ("female", "greek"): ["Άννα", "Ελένη", "Σοφία", "Δάφνη"],
    ("male", "arabic"): ["سامي", "كريم", "نبيل", "رامي"],
    ("female", "arabic"): ["ليلى", "سلمى", "نور", "هدى"],
    ("male", "han"): ["伟明", "建国", "志强", "文杰"],
    ("female", "han"): ["丽华", "秀英", "美玲", "雪梅"],
}
SYLLABLES = {
    "latin": ["ba", "be", "bo", "da", "de", "do", "fa", "ga", "go", "ha", "ka", "ko", "la", "le", "lo", "ma", "me", "mo", "na", "ne", "no", "ra", "ro", "sa", "se", "so", "ta", "te", "to", "va"],
    "cyrillic": ["ба", "бе", "бо", "да", "де", "до", "фа", "га", "го", "ха", "ка", "ко", "ла", "ле", "ло", "ма", "ме", "мо", "на", "не", "но", "ра", "ро", "са", "се", "со", "та", "те", "то", "ва"],
    "greek": ["βα", "γα", "δε", "ζο", "κα", "λε", "μα", "νο", "πα", "ρο", "σα", "τα", "φο", "χα"],
    "arabic": ["با", "تا", "دا", "را", "سا", "فا", "كا", "لا", "ما", "نا"],
    "han": ["王", "李", "张", "陈", "林", "黄", "周", "吴", "徐", "孙", "马", "朱", "胡", "郭"],
}

KNOWN = {
    "male": ["John", "James", "Robert", "Michael", "William", "Thomas", "Peter", "Paul", "George", "Henry", "Hans", "Klaus", "Jürgen", "Wolfgang", "Stefan", "Pierre", "Jean", "Jacques", "Michel", "François", "Juan", "Carlos", "Pedro", "Miguel", "Александр", "Сергей", "Дмитрий", "Алексей", "Николай",
             "Kevin", "Brian", "Steven", "Edward", "Charles", "Daniel", "Matthew", "Andrew", "Christopher", "Joshua", "Eric", "Mohammed", "Ahmed", "Ali", "Omar", "Hassan", "Yusuf", "Wei", "Rahul", "Amit", "Sanjay", "Hiroshi", "Kenji", "José", "Luca", "Marco", "Giovanni", "Lars", "Erik", "Sven"],
    "female": ["Jane", "Mary", "Elizabeth", "Susan", "Sarah", "Margaret", "Emily", "Laura", "Alice", "Emma", "Ursula", "Sabine", "Monika", "Petra", "Heike", "Marie", "Sophie", "Camille", "Isabelle", "Claire", "Maria", "Carmen", "Lucía", "Pilar", "Екатерина", "Наталья", "Татьяна", "Светлана", "Анастасия",
               "Jennifer", "Linda", "Patricia", "Barbara", "Jessica", "Karen", "Nancy", "Lisa", "Sandra", "Amanda", "Melissa", "Deborah", "Stephanie", "Rebecca", "Michelle", "Fatima", "Aisha", "Priya", "Anita", "Mei", "Yuki", "Ingrid", "Giulia", "Francesca", "Chiara", "Ana"],
}
BY_GENDER = {g: KNOWN[g] + [n for (gender, _), names in GIVEN.items() if gender == g for n in names] for g in KNOWN}
#: Small words between a given name and a surname; countries of account numbers; beginnings of tokens.
PARTICLES = ["van", "von", "de", "der", "den", "di", "da", "del", "bin", "ibn", "al", "el"]
ACCOUNT_COUNTRIES = ["AT", "BE", "BG", "CH", "CY", "CZ", "DE", "DK", "EE", "ES", "FI", "FR", "GB", "GR", "HR", "HU", "IE", "IS", "IT", "LI", "LT", "LU", "LV", "MC", "MT", "NL", "NO", "PL", "PT", "RO", "SE", "SI", "SK", "TR", "UA", "SA", "AE", "IL", "BR"]
TOKEN_HEADS = r"(?:gh[pousr]_|github_pat_|xox[abprs]-|sk-|AIza|eyJ|Bearer )"

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_ASSIGNED = r"(?i:password|passwd|pwd|secret|token|api[_-]?key)[\"']?\s{0,3}[=:]\s{0,3}[\"']?"
#: Phone numbers: grouped three and four behind brackets or three digits; + and digits in any groups or none, the whole of up to 15 first; with a leading 0.
_PHONES = [
    r"(?<![\d+])(?:\+\d{1,3}[ .-]?\(\d{2,4}\)[ .-]?|\(\d{3}\)[ .-]?|\d{3}[.-])\d{3}[ .-]\d{4}(?![\d-])",
    r"(?<![\d+])\+[1-9]\d{10,14}(?!\d|-\d)",
    r"(?<![\d+])\+[1-9](?:\)?[ ./-]?\(?\d){7,14}(?![ .-]?\d)",
    r"(?<![\d+])\+\d{1,3}(?:[ .-]\d{2,4}){3,5}(?!\d)",
    r"(?<![\d+])\+[1-9](?:\)?[ ./-]?\(?\d){7,14}(?!\d)",
    r"(?<![\d+])\+\d{1,3}[ .-]\d{3}[ .-]\d{4}(?![\d-])",
    # a leading 0; dates and the national id's groups are too short or spelled otherwise
    r"(?<![\d.,+/-]|\d )(?:\((?=0\d{1,4}\)(?:[ /-]?\d){5,10}(?!\d))0\d{1,4}\)[ /-]?|(?=0[1-9](?:[ /-]?\d){7,10}(?!\d))0[1-9]\d{0,4}[ /])\d{2,8}(?:[ -]\d{2,8}){0,3}(?![ /.-]?\d)",
    r"(?<![\d.,+/-])(?=0[1-9](?:-?\d){7,10}(?!\d))(?!\d{3}-\d{2}-\d{4}(?!\d))0[1-9]\d{0,4}(?:-\d{3,8}){1,3}(?![ /.-]?\d)",
    r"(?<![\d.,+/-])0[1-9](?:\.\d{2}){4}(?![.]?\d)",
]
_KEY_HEAD = r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"
_ALL_TITLES = MALE_TITLES + FEMALE_TITLES + NEUTRAL_TITLES
_ANY_TITLE = "|".join(_ALL_TITLES + [t.upper() for t in _ALL_TITLES])
_TITLED = rf"(?:{_ANY_TITLE})\.? (?:(?:{'|'.join(NEUTRAL_TITLES)})\.? )?"
#: A capitalised word of two letters or more, with inner capitals and apostrophes.
_WORD = r"\p{Lu}(?:['’]\p{Lu})?[\p{L}\p{M}]++(?:['’]\p{Lu}[\p{L}\p{M}]++)*+"
_BETWEEN = rf"(?: (?:{'|'.join(PARTICLES)})){{0,2}}"
_INITIALS = r"(?:\p{Lu}\. ?){0,3}"


def _name_pattern(given: list[str]) -> str:
    spelled = {x for n in given for x in (n, n.upper())}
    # by first letters, so that a word is compared with few of them
    listed = "|".join(f"{c}(?:{'|'.join(sorted(n[1:] for n in spelled if n[0] == c))})" for c in sorted({n[0] for n in spelled}))
    titled = rf"{_TITLED}(?:{_INITIALS}{_WORD}(?:{_BETWEEN}[ -]{_WORD}){{0,2}}|\p{{Lo}}{{2,20}}+(?: \p{{Lo}}{{2,20}}+){{0,2}})"
    plain = rf"(?:{listed}){_BETWEEN} {_INITIALS}{_WORD}(?:-{_WORD})?"
    return rf"(?=\p{{Lu}}|\p{{Lo}})(?<![\p{{L}}\p{{M}}])(?:{titled}|{plain})(?![\p{{L}}\p{{M}}])"


#: Kinds in the order in which they are tried at a place.
PATTERNS = {
    "secret": _ASSIGNED + r"(?=[^\s\"'<>\d]*+\d)[^\s\"'<>,;]{8,}+",
    "private_key": _KEY_HEAD + r"[A-Za-z0-9+/=\s\\]{16,}+",
    "token": rf"(?<![\p{{L}}\p{{N}}_-]){TOKEN_HEADS}(?=[^\s\"'<>\d]*+\d)[\p{{L}}\p{{N}}_.~+/=-]{{16,}}+",
    "email": r"(?<![\p{L}\p{M}\p{N}._%+-])[\p{L}\p{M}\p{N}._%+-]{1,64}+@(?:[\p{L}\p{M}\p{N}-]{1,63}+\.){1,8}+\p{L}{2,24}|(?<![\p{L}\p{M}\p{N}._%+-])[\p{L}\p{M}\p{N}._%+-]{1,64}+@[\p{L}\p{M}\p{N}-]{1,63}(?:\.[\p{L}\p{M}\p{N}-]{1,63}){1,8}",
    "access_key": r"(?<![0-9A-Za-z])(?:AKIA|ASIA)[0-9A-Z]{16}(?![0-9A-Za-z])",
    "phone": rf"(?=[+(\d])(?:{'|'.join(_PHONES)})",
    "account": r"(?<![\p{L}\p{N}])(?:" + "|".join(ACCOUNT_COUNTRIES) + r")\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "card": r"(?<![\d.-])(?:\d{16}|\d{4} \d{4} \d{4} \d{4}|\d{4}-\d{4}-\d{4}-\d{4}|3[47]\d{13}|3[47]\d{2} \d{6} \d{5}|3[47]\d{2}-\d{6}-\d{5})(?![\d-])",
    "national_id": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "address": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)",
    "address6": r"(?<![\p{L}\p{N}:.])(?=[0-9A-Fa-f:]*\d)(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=(?:[0-9A-Fa-f]*:){2,7}[0-9A-Fa-f]+(?![\p{L}\p{N}:]))(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\p{L}\p{N}:])",
}


def patterns(given: list[str] = ()) -> dict[str, str]:
    """The pattern of each kind, in the order in which they are tried at a place; given adds given names."""
    return PATTERNS | {"name": _name_pattern(BY_GENDER["male"] + BY_GENDER["female"] + list(given))}


def whole_pattern(given: list[str] = ()) -> str:
    return "|".join(f"(?:{p})" for p in patterns(given).values())


MOST_DRAWS = 40


def _luhn(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


def _mod97(text: Column) -> Column:
    """The remainder by 97 of digits and capitals, these as 10 to 35."""
    step = lambda r, c: F.when(c.rlike("[A-Z]"), r * 100 + F.ascii(c) - 55).otherwise(r * 10 + F.ascii(c) - 48) % 97
    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0), step)


def _kind(entity: Column, given: list[str]) -> Column:
    out = None
    for kind, pattern in patterns(given).items():
        found = entity.rlike(f"^(?:{pattern})$")
        if kind == "card":
            found &= _luhn(F.regexp_replace(entity, "[ -]", ""))
        if kind == "account":
            plain = F.regexp_replace(entity, " ", "")
            found &= _mod97(F.concat(plain.substr(F.lit(5), F.length(plain)), plain.substr(1, 4))) == 1
        out = F.when(found, kind) if out is None else out.when(found, kind)
    return out


def _head(kind: Column, entity: Column) -> Column:
    """What stays in front of an entity: the secret's name, the key's mark, the person's title."""
    heads = {"secret": _ASSIGNED, "private_key": _KEY_HEAD, "token": TOKEN_HEADS, "name": _TITLED}
    out = F.lit("")
    for k, pattern in heads.items():
        out = F.when(kind == k, F.regexp_extract(entity, f"^{pattern}", 0)).otherwise(out)
    return out


def _canonical(kind: Column, body: Column) -> Column:
    return (
        F.when(kind.isin("email", "address6"), F.lower(body)).when(kind.isin("phone", "card"), F.regexp_replace(body, r"\D", ""))
        .when(kind == "account", F.regexp_replace(body, " ", "")).when(kind == "name", F.regexp_replace(F.lower(body), "’", "'")).otherwise(body)
    )


def _draw(seed: Column, i: Column, n: Column | int) -> Column:
    return F.pmod(F.xxhash64(seed, i), F.lit(n) if isinstance(n, int) else n).cast("int")


#: Ranges that letters are drawn from, by the pattern of those they stand for: first code point and number.
_RANGES = {"[a-z]": (0x61, 26), "[A-Z]": (0x41, 26), r"[\p{IsCyrillic}&&\p{Ll}]": (0x430, 32), r"[\p{IsCyrillic}&&\p{Lu}]": (0x410, 32), r"[\p{IsGreek}&&\p{Ll}]": (0x3B1, 17), r"[\p{IsGreek}&&\p{Lu}]": (0x391, 17), r"\p{IsHan}": (0x4E00, 20000), r"\p{IsArabic}": (0x641, 8), r"\p{Lu}": (0xC0, 23), r"\p{L}": (0xE0, 23)}


def _letters(seed: Column, text: Column, hexadecimal: Column) -> Column:
    """Each digit and letter of text by another one of its class and script (a-f stay a-f in hexadecimal); the rest as it is."""

    def drawn(i: Column, first: int, n: int) -> Column:
        code = F.lit(first) + _draw(seed, i, n)
        return F.chr(code) if first < 128 else F.decode(F.unhex(F.lpad(F.hex(code), 4, "0")), "UTF-16BE")

    def one(c: Column, i: Column) -> Column:
        letters = F.when(c.rlike("[0-9]"), drawn(i, 0x30, 10))
        letters = letters.when(hexadecimal & c.rlike("[a-f]"), drawn(i, 0x61, 6)).when(hexadecimal & c.rlike("[A-F]"), drawn(i, 0x41, 6))
        ascii_, others = list(_RANGES.items())[:2], list(_RANGES.items())[2:]
        for pattern, (first, n) in ascii_:
            letters = letters.when(c.rlike(pattern), drawn(i, first, n))
        beyond = c
        for pattern, (first, n) in reversed(others):
            beyond = F.when(c.rlike(pattern), drawn(i, first, n)).otherwise(beyond)
        return letters.when(c < "\x80", c).otherwise(beyond)

    return F.array_join(F.transform(F.split(text, ""), one), "")


def _script(text: Column) -> Column:
    out = F.lit("latin")
    for script in ("cyrillic", "greek", "arabic", "han"):
        out = F.when(text.rlike(rf"^\p{{Is{script.capitalize()}}}"), script).otherwise(out)
    return out


def _of(tables: dict[str, list[str]], key: Column) -> Column:
    """The list of tables under key."""
    return F.element_at(F.create_map(*(x for k, v in tables.items() for x in (F.lit(k), F.array(*map(F.lit, v))))), key)


def _pick(seed: Column, i: Column, values: Column) -> Column:
    return F.element_at(values, _draw(seed, i, F.size(values)) + 1)


def _syllables(seed: Column, script: Column, n: Column) -> Column:
    """A word of n syllables, half as many in han."""
    count = F.when(script == "han", F.ceil(n / 2)).otherwise(n).cast("int")
    return F.array_join(F.transform(F.sequence(F.lit(1), count), lambda i: _pick(seed, i, _of(SYLLABLES, script))), "")


def _family(seed: Column, canonical: Column, draw: Column) -> Column:
    """A surname: four syllables, one more after each two draws; each part of a double name has its own."""
    return F.array_join(F.transform(F.split(canonical, "-"), lambda x: _syllables(F.concat(seed, x), _script(canonical), F.lit(4) + (draw / 2).cast("int"))), "-")


def _given(seed: Column, canonical: Column, gender: Column, draw: Column) -> Column:
    """A given name of a gender: one of its names, then two of them, then one with a made one."""
    tables = {f"{g} {s}": [n.lower() for n in names] for (g, s), names in GIVEN.items()}
    tables |= {f"either {s}": tables[f"male {s}"] + tables[f"female {s}"] for s in SYLLABLES}
    script = _script(canonical)
    names = _of(tables, F.concat_ws(" ", F.when(gender.isin("male", "female"), gender).otherwise("either"), script))
    second = F.when(draw < 3, _pick(seed, F.lit(10), names)).otherwise(_syllables(seed, script, F.lit(2) + (draw / 2).cast("int")))
    return F.concat_ws("-", _pick(seed, F.lit(9), names), F.when(draw > 0, second))


def _seed(key: str, c: dict[str, Column]) -> Column:
    """The key is hashed in, so a surrogate can't be guessed from texts."""
    return F.sha2(F.concat_ws("|", F.lit(key), c["kind"], c["canonical"], c["draw"].cast("string")), 256)


def _shuffled(key: str, c: dict[str, Column]) -> Column:
    """The part of a canonical entity whose letters and digits are drawn anew, so drawn."""
    kind, canonical = c["kind"], c["canonical"]
    front = {"email": F.length(canonical) - F.length(F.substring_index(canonical, ".", -1)), "card": F.length(canonical) - 1}
    part = F.when(kind == "email", canonical.substr(F.lit(1), front["email"])).when(kind == "card", canonical.substr(F.lit(1), front["card"]))
    part = part.when(kind.isin("account", "access_key"), canonical.substr(F.lit(5), F.length(canonical))).when(~kind.isin("name", "family"), canonical)
    return _letters(_seed(key, c), part, (kind == "address6") | (kind == "secret") & canonical.rlike("^[0-9a-f]+$"))


def _surrogate(key: str, c: dict[str, Column]) -> Column:
    """The surrogate of a canonical entity at the draw-th try.

    c: kind, canonical, gender and family (the surname's surrogate) of full names, draw, shuffled.
    """
    kind, canonical, shuffled, seed = c["kind"], c["canonical"], c["shuffled"], _seed(key, c)
    given = F.sha2(F.concat_ws("|", F.lit(key), kind, c["gender"], F.substring_index(canonical, " ", 1), c["draw"].cast("string")), 256)
    checked = F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: F.concat(shuffled, d.cast("string"))), lambda x: _luhn(x))[0]
    country = canonical.substr(1, 2)
    account = F.concat(country, F.lpad((98 - _mod97(F.concat(shuffled, country, F.lit("00")))).cast("string"), 2, "0"), shuffled)
    octets = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (_draw(seed, i, 254) + 1).cast("string")), ".")
    return (
        F.when(kind == "email", F.concat(shuffled, F.substring_index(canonical, ".", -1))).when(kind == "card", checked).when(kind == "address", octets).when(kind == "account", account)
        .when(kind == "access_key", F.concat(canonical.substr(1, 4), shuffled))
        .when(kind == "family", _family(seed, canonical, c["draw"])).when(kind == "name", F.concat(_given(given, canonical, c["gender"], c["draw"]), F.lit(" "), c["family"]))
        .otherwise(shuffled)
    )


def _rendered(kind: Column, body: Column, surrogate: Column) -> Column:
    """A canonical surrogate as its entity was written: the same separators and upper case."""
    place = lambda i: F.length(F.regexp_replace(body.substr(F.lit(1), i), r"\D", ""))
    digits = F.array_join(F.transform(F.split(body, ""), lambda c, i: F.when(c.rlike(r"\d"), surrogate.substr(place(i + 1), F.lit(1))).otherwise(c)), "")
    cased = F.transform(F.split(body, ""), lambda c, i: F.when(c.rlike(r"\p{Lu}"), F.upper(surrogate.substr(i + 1, F.lit(1)))).otherwise(surrogate.substr(i + 1, F.lit(1))))
    spaced = F.transform(F.split(body, ""), lambda c, i: F.when(c != " ", surrogate.substr(F.length(F.regexp_replace(body.substr(F.lit(1), i + 1), " ", "")), F.lit(1))).otherwise(c))
    return (
        F.when(kind.isin("phone", "card"), digits).when(kind.isin("email", "address6"), F.array_join(cased, "")).when(kind == "account", F.array_join(spaced, ""))
        .when(kind == "name", _like(body, surrogate)).otherwise(surrogate)
    )


def _like(body: Column, name: Column) -> Column:
    """A name in lower case as body is written: in capitals, or each of its words with one."""
    titled = F.array_join(F.transform(F.split(name, "-"), lambda x: F.initcap(x)), "-")
    return F.when(body.rlike(r"\p{Lu}") & (F.upper(body) == body), F.upper(name)).otherwise(titled)


def distinct_surrogates(canonical: DataFrame, key: str) -> DataFrame:
    """kind, canonical, gender, surrogate from kind, canonical, gender, family: no two of a kind alike, none a real entity.

    Of those that draw one surrogate the first keeps it; the others, and those
    that draw a real entity, draw again. Each turn is written to the shared
    folder. A format almost all of whose values are real entities has no room
    for others and raises RuntimeError.
    """
    columns = ["kind", "canonical", "gender", "family"]

    def drawn(rows: DataFrame) -> DataFrame:
        parts = {c: F.col(c) for c in [*columns, "draw", "shuffled"]}
        return rows.withColumn("shuffled", _shuffled(key, parts)).withColumn("surrogate", _surrogate(key, parts)).drop("shuffled")

    rows = settle(drawn(canonical.select(*columns).withColumn("draw", F.lit(0))), "surrogates-0")
    real = settle(rows.select("kind", F.col("canonical").alias("surrogate"), F.lit(True).alias("real")).distinct(), "real")
    mark = F.struct("canonical", "gender")
    for turn in range(1, MOST_DRAWS + 1):
        taken = rows.groupBy("kind", "surrogate").agg(F.min(mark).alias("keeper"), F.count("*").alias("n")).where("n > 1").drop("n")
        checked = rows.join(taken, ["kind", "surrogate"], "left").join(real, ["kind", "surrogate"], "left")
        again = F.coalesce(F.col("keeper") != mark, F.lit(False)) | F.col("real").isNotNull()
        marked = settle(checked.select(*columns, "surrogate", (F.col("draw") + again.cast("int")).alias("draw"), again.alias("again")), f"surrogates-{turn}")
        if marked.where("again").isEmpty():
            discard(marked)
            return rows.select("kind", "canonical", "gender", "surrogate")
        discard(rows)
        rows = settle(marked.where("not again").drop("again").unionByName(drawn(marked.where("again").drop("again", "surrogate"))), f"drawn-{turn}")
        discard(marked)
    raise RuntimeError(f"surrogates are not distinct after {MOST_DRAWS} draws: a kind has almost no free values")


def _people(forms: DataFrame) -> DataFrame:
    """entity, canonical, family, gender of forms (entity, title, canonical) of the kind name; gender is "" for lone surnames."""
    title = F.lower(F.regexp_extract("title", r"^\p{L}+", 0))
    told = F.when(title.isin([t.lower() for t in MALE_TITLES]), "male").when(title.isin([t.lower() for t in FEMALE_TITLES]), "female")
    full = F.col("canonical").contains(" ")
    rows = forms.select("entity", "canonical", F.element_at(F.split("canonical", " "), -1).alias("family"), full.alias("full"), told.alias("told"))
    elsewhere = rows.where("full").groupBy("canonical").agg(F.min("told").alias("low"), F.max("told").alias("high"))
    elsewhere = elsewhere.select("canonical", F.when(F.col("low") == F.col("high"), F.col("low")).alias("elsewhere"), F.col("low").isNotNull().alias("known"))
    given = F.substring_index("canonical", " ", 1)
    by_name = F.when(given.isin([n.lower() for n in BY_GENDER["male"]]), "male").when(given.isin([n.lower() for n in BY_GENDER["female"]]), "female")
    gender = F.coalesce("told", "elsewhere", F.when(~F.col("known"), by_name), F.lit("either"))
    return rows.join(elsewhere, "canonical", "left").select("entity", "canonical", "family", F.when(F.col("full"), gender).otherwise("").alias("gender"))


def entity_surrogates(forms: DataFrame, key: str) -> DataFrame:
    """entity, surrogate of forms (entity, kind, title, canonical): surnames first, then the names that hold them."""
    none = F.lit("").alias("gender"), F.lit("").alias("family")
    people = settle(_people(forms.where("kind = 'name'")), "people")
    plain = forms.where("kind != 'name'").select("kind", "canonical", *none)
    families = people.select(F.lit("family").alias("kind"), F.col("family").alias("canonical"), *none)
    first = settle(distinct_surrogates(plain.unionByName(families).distinct(), key), "surrogates")
    surnames = first.where("kind = 'family'").select(F.col("canonical").alias("family"), F.col("surrogate").alias("new_family"))
    people = people.join(surnames, "family")
    full = people.where("gender != ''").select(F.lit("name").alias("kind"), "canonical", "gender", F.col("new_family").alias("family")).distinct()
    names = settle(distinct_surrogates(full, key).select("canonical", "gender", "surrogate"), "names")
    named = people.join(names, ["canonical", "gender"], "left").select("entity", F.coalesce("surrogate", "new_family").alias("surrogate"))
    others = forms.where("kind != 'name'").join(first.where("kind != 'family'"), ["kind", "canonical"]).select("entity", "surrogate")
    return named.unionByName(others)


def entities(docs: DataFrame, given: list[str] = ()) -> DataFrame:
    """doc_id, entity, kind: the distinct entities of each document of docs (doc_id, text)."""
    all_of = F.regexp_extract_all(F.col("text"), F.lit(whole_pattern(given)), F.lit(0))
    seen = docs.select("doc_id", F.explode(F.array_distinct(all_of)).alias("entity"))
    return seen.withColumn("kind", _kind(F.col("entity"), list(given))).where("kind is not null").distinct()


def replacements(seen: DataFrame, key: str) -> DataFrame:
    """entity, kind, new of entities(); for a person with a given name also given (in lower case) and new_given."""
    forms = seen.select("entity", "kind").distinct().withColumn("title", _head(F.col("kind"), F.col("entity")))
    forms = forms.withColumn("body", F.expr("substring(entity, length(title) + 1)")).withColumn("canonical", _canonical(F.col("kind"), F.col("body")))
    forms = settle(forms, "forms")
    rows = forms.join(entity_surrogates(forms, key), "entity")
    new = F.concat("title", _rendered(F.col("kind"), F.col("body"), F.col("surrogate")))
    person = (F.col("kind") == "name") & F.col("canonical").contains(" ")
    first = lambda c: F.when(person, F.substring_index(c, " ", 1))
    return rows.select("entity", "kind", new.alias("new"), first("canonical").alias("given"), first("surrogate").alias("new_given"))


def surrogates(docs: DataFrame, key: str, given: list[str] = ()) -> DataFrame:
    """doc_id, text (with surrogates), n_entities, kinds of each row of docs (doc_id, text, ...).

    The key is a secret: whoever has it can find the surrogate of an entity.
    given adds given names, by which names without a title are known.
    n_entities counts the replaced places, kinds names their kinds in order. Equal
    entities get equal surrogates in all documents, different ones different
    surrogates. Texts without entities are returned as they are, null as null
    with no entities; rows without doc_id are left out; rows that repeat a doc_id
    with its text each get their result, and of different texts with one doc_id
    each has the other's entities replaced too. Numbers like cards or accounts
    with wrong check digits are left alone. Texts may be of any length. Other
    columns are not read; an empty table gives an empty result. An empty key is
    an error.
    """
    if not key:
        raise ValueError("surrogates need a secret key")
    docs, pattern = identified(docs), whole_pattern(given)
    seen = settle(entities(docs, given), "entities")
    rendered = settle(replacements(seen, key), "rendered")
    known = seen.select("doc_id", "entity").join(rendered, "entity")
    per_doc = known.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("entity", F.struct("kind", "new")))).alias("map"))
    # of several persons of a document with one given name, the first by spelling has it alone
    alone = known.where("given is not null").groupBy("doc_id", "given").agg(F.min(F.struct("entity", "new_given"))["new_given"].alias("new_given"))
    alone = alone.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("given", "new_given"))).alias("alone"))
    joined = docs.join(per_doc, "doc_id", "left").join(alone, "doc_id", "left")
    found = F.when(F.col("map").isNotNull(), F.regexp_extract_all(F.col("text"), F.lit(pattern), F.lit(0)))
    staged = joined.select("doc_id", "text", "map", "alone", found.alias("found"), F.when(F.col("map").isNotNull(), F.split("text", pattern, -1)).alias("rest"))
    staged = staged.withColumn("new", F.transform("found", lambda e: F.try_element_at("map", e)))
    # given names alone, in what lies between entities
    lone = rf"(?<![\p{{L}}\p{{M}}]){_WORD}(?![\p{{L}}\p{{M}}])"
    told = lambda w: F.try_element_at("alone", F.regexp_replace(F.lower(w), "’", "'"))
    words = lambda r: F.regexp_extract_all(r, F.lit(lone), F.lit(0))
    swapped = lambda r: F.array_join(F.zip_with(F.split(r, lone, -1), F.transform(words(r), lambda w: F.coalesce(_like(w, told(w)), w)), lambda x, w: F.concat(x, F.coalesce(w, F.lit("")))), "")
    lone_count = F.aggregate("rest", F.lit(0), lambda n, r: n + F.size(F.filter(words(r), lambda w: told(w).isNotNull())))
    staged = staged.withColumn("n_alone", F.when(F.col("alone").isNotNull(), lone_count).otherwise(0)).withColumn("rest", F.when(F.col("n_alone") > 0, F.transform("rest", swapped)).otherwise(F.col("rest")))
    piece = lambda r, i: F.concat(r, F.coalesce(F.get("new", i).getField("new"), F.get("found", i), F.lit("")))
    text = F.when(F.col("map").isNull(), F.col("text")).otherwise(F.array_join(F.transform("rest", piece), ""))
    kinds = F.array_sort(F.array_distinct(F.transform(F.map_values("map"), lambda v: v.getField("kind"))))
    count = F.size(F.filter("new", lambda x: x.isNotNull())) + F.col("n_alone")
    return staged.select("doc_id", text.alias("text"), F.when(F.col("map").isNull(), 0).otherwise(count).cast("long").alias("n_entities"), F.coalesce(F.array_join(kinds, ","), F.lit("")).alias("kinds"))
