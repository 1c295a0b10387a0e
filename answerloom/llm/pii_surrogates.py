"""Personal data replaced by surrogates of the same type, script and format, in SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from answerloom.functions.columns import let
from answerloom.functions.pii import GIVEN_NAMES
from answerloom.session import cut_lineage

#: Titles by gender and given names by gender and script.
MALE_TITLES = ("Mr", "Sir", "Herr", "Monsieur", "Señor", "Господин")
FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Señora", "Госпожа")
OTHER_TITLES = ("Dr", "Prof")
GIVEN = {
    ("latin", "m"): (
        "Adam Albert Andrew Anthony Arthur Benjamin Brian Carlos Charles Christopher Daniel David Donald Edward Eric "
        "Frank George Hans Henry Jacob James John Jonathan Joseph Joshua Juan Kevin Louis Mark Martin Matthew Michael "
        "Oliver Patrick Paul Peter Pierre Richard Robert Ryan Samuel Scott Stephen Steven Thomas Timothy Victor Walter "
        "William"
    ).split(),
    ("latin", "f"): (
        "Alice Amanda Angela Anna Barbara Carol Charlotte Clara Deborah Elena Elizabeth Emily Emma Helen Ingrid Jane "
        "Jennifer Jessica Julia Karen Laura Linda Lisa Louise Margaret Maria Marie Mary Michelle Nancy Nicole Nina "
        "Pamela Patricia Rachel Rebecca Rosa Sandra Sarah Sophie Susan Victoria"
    ).split(),
    ("cyrillic", "m"): "Александр Алексей Андрей Борис Виктор Дмитрий Иван Михаил Николай Сергей".split(),
    ("cyrillic", "f"): "Анна Вера Галина Елена Ирина Мария Наталья Ольга Светлана Татьяна".split(),
}
#: Letters that coined names and addresses are made of.
CONSONANTS = {"latin": "bcdfghklmnprstvz", "cyrillic": "бвгдзклмнпрст"}
VOWELS = {"latin": "aeiou", "cyrillic": "аеиоу"}
#: From this attempt on a coined word gets a letter longer with every attempt, so there is room for all.
WIDEN = 3
#: Words in lower case that stand inside a name, and alphabets of initials.
PARTICLES = ("de la", "de", "del", "della", "da", "di", "du", "van der", "van den", "van", "von der", "von", "der", "den", "ter", "bin", "ibn", "al")
INITIALS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ")
#: Signs of the two kinds of crypto addresses after their first characters.
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
BECH32 = "23456789acdefghjkmnpqrstuvwxyz"


def _one_of(words) -> str:
    """An alternation of words, those with a common beginning together, so that few are tried at a place."""
    heads: dict[str, list[str]] = {}
    for word in sorted(set(words)):
        heads.setdefault(word[:1], []).append(word[1:])
    parts = [head + (_one_of(tails) if len(tails) > 1 else tails[0]) for head, tails in heads.items() if head]
    found = parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"
    return f"(?:{found})?" if "" in heads else found


def _also_upper(words) -> list[str]:
    return [form for word in words for form in (word, word.upper())]


TITLES = _also_upper((*MALE_TITLES, *FEMALE_TITLES, *OTHER_TITLES))
#: An apostrophe or hyphen belongs to a name only before a capital, so "Smith's" names Smith.
_NAME = r"\p{Lu}(?:\p{L}{1,40}+|(?=['’]\p{Lu}))(?:['’-]\p{Lu}\p{L}{1,40}+){0,2}"
_WORD = rf"(?=\p{{Lu}})(?<![\p{{L}}\p{{N}}]){_NAME}(?![\p{{L}}\p{{N}}])"
_TITLE = _one_of(TITLES)
_KNOWN = _one_of(_also_upper([*(name for names in GIVEN.values() for name in names), *GIVEN_NAMES]))
_INNER = rf"(?: \p{{Lu}}\.| {_NAME}(?![\p{{L}}\p{{N}}]))"
_END = rf"(?: (?:{_one_of(PARTICLES)}))? {_NAME}(?![\p{{L}}\p{{N}}])"
_HEX = "[0-9A-Fa-f]{1,4}"
#: No group repeats without a bound, so no text makes a match slow or deep.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}+\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "crypto": r"(?<![A-Za-z0-9])(?:bc1|[13])[A-HJ-NP-Za-km-z1-9]{25,39}+(?![A-Za-z0-9])",
    "ipv6": rf"(?<![0-9A-Za-z:.])(?=[0-9A-Fa-f:]{{0,40}}[0-9])(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}:){{1,6}}(?::{_HEX}){{1,6}})(?![0-9A-Za-z:])",
    "card": r"(?<![0-9])[0-9]{4}(?:[ -]?[0-9]{4}){3}(?![0-9])",
    "phone": (
        r"(?<![0-9+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"
        r"|(?<![0-9+])\+[1-9][0-9]{0,2}(?:[ ./-]?\(?[0-9]{2,5}\)?){2,4}(?![0-9])"
        r"|(?<![0-9+.,-])0[1-9][0-9]{1,4}[ /-][0-9]{5,9}(?![0-9])"
    ),
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "ip": r"(?<![0-9.])(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:\.(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})){3}(?!\.?[0-9])",
    "document": (
        r"(?<![A-Za-z0-9])[A-Z][0-9]{8}(?![A-Za-z0-9])"
        r"|(?<![A-Za-z0-9])(?=[A-Z][0-9]{7})(?<=(?i:licen[cs]e|\bdl)[^0-9\n]{1,16})[A-Z][0-9]{7}(?![A-Za-z0-9])"
    ),
    "account": (
        r"(?<![A-Za-z0-9])(?=[0-9]{8})(?<=\b(?i:account|acct|routing|bank|aba)\b[^0-9\n]{1,24})[0-9]{8,17}(?![A-Za-z0-9])"
        r"|(?<![A-Za-z0-9])(?=[0-9]{7})(?<=(?i:licen[cs]e|\bdl)[^0-9\n]{1,16})[0-9]{7,8}(?![A-Za-z0-9])"
    ),
    "person": (
        rf"(?=\p{{Lu}})(?<![\p{{L}}\p{{N}}])(?:{_TITLE}\.?(?: {_TITLE}\.?)?|{_KNOWN})(?![\p{{L}}\p{{N}}]){_INNER}{{0,6}}{_END}"
    ),
}
ANY = "|".join(f"(?:{pattern})" for pattern in PATTERNS.values())
#: What a text must have at least; cheaper to look for than ``ANY``.
HINT = r"[0-9]{3}|@|\.[0-9]{1,3}\.|:[0-9A-Fa-f]{0,4}:|(?:bc1|[13])[A-Za-z1-9]{25}|\p{Lu}[\p{L}'’-]{1,40}+\.? (?:\p{Lu}|\p{Ll}{2,5} )"
#: Stands before and after every match while a text is cut.
CUT = "\x01"


def _kind(hit: Column) -> Column:
    """The type of a match of ``ANY``, told from its shape."""
    return (
        F.when(F.contains(hit, F.lit("@")), "email")
        .when(hit.rlike(r"^(?:bc1|[13])[A-Za-z0-9]{25,}\z"), "crypto")
        .when(F.contains(hit, F.lit(":")), "ipv6")
        .when(hit.rlike(r"^[A-Z][0-9]+\z"), "document")
        .when(hit.rlike(r"^\p{L}"), "person")
        .when(hit.rlike(r"^[0-9.]+\z") & (F.length(F.regexp_replace(hit, r"[^.]", "")) == 3), "ip")
        .when(hit.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}\z"), "ssn")
        .when(F.length(F.regexp_replace(hit, "[^0-9]", "")) == 16, "card")
        .when(hit.rlike(r"^[0-9]+\z"), "account")
        .otherwise("phone")
    )


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _titled(token: Column, titles: tuple[str, ...]) -> Column:
    return token.rlike(rf"^{_one_of(_also_upper(titles))}\.?\z")


def _is_title(token: Column) -> Column:
    return token.rlike(rf"^{_TITLE}\.?\z")


def _listed(token: Column, gender: str) -> Column:
    return token.rlike(rf"^{_one_of(_also_upper(n for (_, g), names in GIVEN.items() if g == gender for n in names))}\z")


def _gender(token: Column, title: Column) -> Column:
    """Of a given name from the lists, else of the title; 'x' if neither tells."""
    return (
        F.when(_listed(token, "m"), "m")
        .when(_listed(token, "f"), "f")
        .when(_titled(title, MALE_TITLES), "m")
        .when(_titled(title, FEMALE_TITLES), "f")
        .otherwise("x")
    )


def _is_initial(token: Column) -> Column:
    return token.rlike(r"^\p{Lu}\.\z")


def _units(hit: Column) -> Column:
    """The parts of a match whose surrogates are drawn: ``kind``, ``norm``, ``at`` (token, from 0).

    A mail address is one part. Of a person the last word is the surname, the others but titles,
    initials and particles are given names; they are parts of their own, so 'Mr. John Smith',
    'John Smith' and 'Mr. Smith' keep belonging together. Numbers are permuted and have no parts.
    """

    def unit(kind: Column, norm: Column, at: Column) -> Column:
        return F.struct(kind.alias("kind"), norm.alias("norm"), at.cast("int").alias("at"))

    def person(tokens: Column) -> Column:
        title = F.when(_is_title(F.get(tokens, F.lit(0))), F.get(tokens, F.lit(0))).otherwise("")
        last = F.size(tokens) - 1
        # A second name that tells no gender has that of the first.
        first = F.get(F.filter(tokens, lambda t: ~_is_title(t) & ~_is_initial(t)), F.lit(0))
        gender = lambda t: F.when(_listed(t, "m"), "m").when(_listed(t, "f"), "f").otherwise(_gender(first, title))
        made = F.transform(
            tokens,
            lambda t, i: F.when(i == last, unit(F.lit("surname"), F.lower(t), i)).otherwise(
                unit(F.concat(F.lit("given_"), gender(t)), F.lower(t), i)
            ),
        )
        token = lambda u: F.get(tokens, u["at"])
        return F.filter(
            made,
            lambda u: (u["at"] == last) | ~(_is_title(token(u)) | _is_initial(token(u)) | token(u).rlike(r"^\p{Ll}")),
        )

    kind, none = _kind(hit), F.array().cast("array<struct<kind: string, norm: string, at: int>>")
    return (
        F.when(kind == "person", person(F.split(hit, " ")))
        .when(kind == "email", F.array(unit(kind, F.lower(hit), F.lit(0))))
        .otherwise(none)
    )


def _drawn(seed: Column, at: Column, among: Column | int) -> Column:
    return F.pmod(F.xxhash64(seed, at), among if isinstance(among, Column) else F.lit(among)).cast("int")


def _pick(letters: str, seed: Column, at: Column) -> Column:
    return F.substring(F.lit(letters), _drawn(seed, at, len(letters)) + 1, F.lit(1))


def _coined(seed: Column, norm: Column, attempt: Column) -> Column:
    """A word of the script and length of ``norm``: consonants and vowels in turn, other signs kept."""
    longer = F.concat(norm, F.repeat(F.lit("a"), F.greatest(attempt - WIDEN, F.lit(0))))

    def letter(c: Column, i: Column) -> Column:
        made = {
            script: F.when(i % 2 == 0, _pick(CONSONANTS[script], seed, i)).otherwise(_pick(VOWELS[script], seed, i))
            for script in ("latin", "cyrillic")
        }
        return (
            F.when(c.rlike(r"\p{IsCyrillic}"), made["cyrillic"])
            .when(c.rlike(r"\p{L}"), made["latin"])
            .when(c.rlike("[0-9]"), _drawn(seed, i, 10).cast("string"))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.filter(F.split(longer, ""), lambda c: c != ""), letter), "")


def _given(seed: Column, norm: Column, gender: str, attempt: Column) -> Column:
    """A listed name of the gender and script; from some attempt on a coined one with the gender's ending."""
    def listed(script: str) -> Column:
        names = [n.lower() for g in (("m", "f") if gender == "x" else (gender,)) for n in GIVEN[script, g]]
        return F.element_at(F.array(*map(F.lit, names)), _drawn(seed, F.lit(0), len(names)) + 1)

    cyrillic = norm.rlike(r"\p{IsCyrillic}")
    ending = {"m": ("on", "ин"), "f": ("ia", "ия"), "x": ("is", "ис")}[gender]
    coined = F.concat(_coined(seed, norm, attempt), F.when(cyrillic, ending[1]).otherwise(ending[0]))
    return F.when(attempt >= WIDEN, coined).otherwise(F.when(cyrillic, listed("cyrillic")).otherwise(listed("latin")))


def _luhn(digits: Column) -> Column:
    """The check sum of sixteen digits, modulo ten."""
    places = F.sequence(F.lit(1), F.lit(16))
    total = F.aggregate(
        places,
        F.lit(0),
        lambda s, i: s
        + let(F.substring(digits, i, F.lit(1)).cast("int"), lambda d: F.when(i % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))),
    )
    return total % 10


def _prf(key: str, label: Column, turn: Column | str, value: Column, size: Column) -> Column:
    """A number below ``size`` made of a value by a keyed SHA-256."""
    told = F.concat_ws("|", F.lit(key), label, turn if isinstance(turn, Column) else F.lit(turn), value.cast("string"))
    return F.pmod(F.conv(F.substring(F.sha2(told.cast("binary"), 256), 1, 15), 16, 10).cast("bigint"), size)


def _permuted(key: str, label: Column, left: Column, right: Column, a: Column, b: Column) -> Column:
    """``l``, ``r``: another pair of numbers below ``a`` and ``b``, a different one for every pair.

    Feistel rounds, a shift by a keyed number other than zero, and the rounds undone: a keyed
    permutation of the ``a * b`` pairs that leaves none in its place, whatever the sizes.
    """

    def run(s: Column) -> Column:
        def pair(left: Column, right: Column) -> Column:
            return F.struct(left.alias("l"), right.alias("r"))

        def turn(sign: int):
            def step(p: Column, i: Column) -> Column:
                one = pair(F.pmod(p["l"] + sign * _prf(key, s["label"], i.cast("string"), p["r"], s["a"]), s["a"]), p["r"])
                two = pair(p["l"], F.pmod(p["r"] + sign * _prf(key, s["label"], i.cast("string"), p["l"], s["b"]), s["b"]))
                return F.when(i % 2 == 0, one).otherwise(two)

            return step

        def shifted(p: Column) -> Column:
            every = s["a"] * s["b"]
            moved = F.pmod(p["l"] * s["b"] + p["r"] + 1 + _prf(key, s["label"], "shift", F.lit(""), every - 1), every)
            return let(moved, lambda m: pair(F.call_function("div", m, s["b"]), F.pmod(m, s["b"])))

        mixed = F.aggregate(F.array(*map(F.lit, range(4))), pair(s["l"], s["r"]), turn(1))
        return F.aggregate(F.array(*map(F.lit, reversed(range(4)))), let(mixed, shifted), turn(-1))

    whole = lambda c, name: c.cast("bigint").alias(name)
    return let(F.struct(label.alias("label"), whole(left, "l"), whole(right, "r"), whole(a, "a"), whole(b, "b")), run)


def _ten(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, F.lit("0")).cast("bigint")


def _padded(number: Column, n: Column) -> Column:
    return F.lpad(number.cast("string"), n, F.lit("0"))


def _some_digits(key: str, label: Column, digits: Column) -> Column:
    """Other digits, as many; different ones for different digits."""

    def halves(d: Column) -> Column:
        n = F.length(d)
        right = F.call_function("div", n, F.lit(2)).cast("int")
        left = (n - right).cast("int")
        made = _permuted(
            key, F.concat_ws(":", label, n.cast("string")), F.substring(d, F.lit(1), left).cast("bigint"),
            F.substring(d, left + 1, right).cast("bigint"), _ten(left), _ten(right),
        )
        return let(made, lambda p: F.concat(_padded(p["l"], left), _padded(p["r"], right)))

    return let(digits, halves)


def _from(key: str, label: str, digits: Column, left: int, right: int, low_left: Column, n_left: Column, low_right: Column, n_right: Column) -> Column:
    """Other digits whose two parts stay within their ranges (a lowest number and how many there are)."""
    first, second = F.substring(digits, F.lit(1), F.lit(left)).cast("bigint"), F.substring(digits, F.lit(left + 1), F.lit(right)).cast("bigint")
    of = F.concat_ws(":", F.lit(label), low_left.cast("string"), low_right.cast("string"))
    made = _permuted(key, of, first - low_left, second - low_right, n_left, n_right)
    return let(made, lambda p: F.concat(_padded(p["l"] + low_left, F.lit(left)), _padded(p["r"] + low_right, F.lit(right))))


def _phone(key: str, digits: Column) -> Column:
    """Ten digits: area and exchange that start at 2 keep doing so. Of other lengths all but the first three change."""
    high = lambda at: F.substring(digits, F.lit(at), F.lit(1)) >= "2"
    ten = _from(
        key, "phone", digits, 3, 7,
        F.when(high(1), 200).otherwise(0), F.when(high(1), 800).otherwise(200),
        F.when(high(4), 2_000_000).otherwise(0), F.when(high(4), 8_000_000).otherwise(2_000_000),
    )
    start = F.substring(digits, F.lit(1), F.lit(3))
    other = F.concat(start, _some_digits(key, F.concat(F.lit("phone:"), start), F.substring(digits, F.lit(4), F.length(digits))))
    return F.when(F.length(digits) == 10, ten).otherwise(other)


def _ssn(key: str, digits: Column) -> Column:
    """Nine digits; those of taxpayers without a social security number begin with 9 and keep doing so."""
    nine = digits.startswith("9")
    return _from(key, "ssn", digits, 3, 6, F.when(nine, 900).otherwise(0), F.when(nine, 100).otherwise(900), F.lit(0), F.lit(1_000_000))


def _card(key: str, digits: Column) -> Column:
    """Sixteen digits; the first, which tells the network, is kept, and so is the check sum, right or wrong."""
    start = F.substring(digits, F.lit(1), F.lit(1))
    label = F.concat_ws(":", F.lit("card"), start, _luhn(digits).cast("string"))
    body = _some_digits(key, label, F.substring(digits, F.lit(2), F.lit(14)))
    made = F.concat(start, body)
    last = lambda m: F.pmod(_luhn(digits) - _luhn(F.concat(m, F.lit("0"))), F.lit(10)).cast("string")
    return let(made, lambda m: F.concat(m, last(m)))


def _address(key: str, hit: Column) -> Column:
    """Another address of the same network: 10, 127, 192.168, 172.16 to 31, what is no unicast address, or the public ones."""

    def run(o: Column) -> Column:
        octet = lambda ix: F.get(o, F.lit(ix))
        one, two, tail = octet(0), octet(1), octet(2) * 256 + octet(3)
        within = (one == 172) & two.between(16, 31)
        alone = (one == 10) | (one == 127) | (one == 0) | (one > 223)
        public = one - 1 - sum((one > x).cast("bigint") for x in (10, 127, 172, 192))

        def shown(p: Column) -> Column:
            def back(n: Column) -> Column:
                found = n + 1
                for x in (10, 127, 172, 192):
                    found = let(found, lambda f, x=x: F.when(f >= x, f + 1).otherwise(f))
                return found

            div = lambda x, y: F.call_function("div", x, F.lit(y).cast("bigint"))
            low = lambda x: x % 256
            left, right = p["l"], p["r"]
            others = left + F.when((one == 192) & (left >= 168), 1).when((one == 172) & (left >= 16), 16).otherwise(0)
            return (
                F.when((one == 192) & (two == 168), F.concat_ws(".", one, two, left, right))
                .when(within, F.concat_ws(".", one, left + 16, div(right, 256), low(right)))
                .when(alone, F.concat_ws(".", one, left, div(right, 256), low(right)))
                .when(one.isin(172, 192), F.concat_ws(".", one, others, div(right, 256), low(right)))
                .otherwise(F.concat_ws(".", back(div(left, 256)), low(left), div(right, 256), low(right)))
            )

        private = (one == 192) & (two == 168)
        rest = two - F.when((one == 192) & (two > 168), 1).when((one == 172) & (two > 31), 16).otherwise(0)
        named = private | within | alone | one.isin(172, 192)
        left = F.when(private, octet(2)).when(within, two - 16).when(alone, two).when(one.isin(172, 192), rest).otherwise(public * 256 + two)
        right = F.when(private, octet(3)).otherwise(tail)
        a = F.when(private | alone, 256).when(within, 16).when(one == 192, 255).when(one == 172, 240).otherwise(219 * 256)
        b = F.when(private, 256).otherwise(65_536)
        label = F.concat_ws(":", F.lit("ip"), F.when(named, one).otherwise(-1), private.cast("string"), within.cast("string"))
        return let(_permuted(key, label, left, right, a, b), shown)

    return let(F.transform(F.split(hit, r"\."), lambda x: x.cast("bigint")), run)


def _address6(key: str, hit: Column) -> Column:
    """Every group becomes another one; a first group of link-local or private networks stays."""

    def group(x: Column, i: Column) -> Column:
        number = F.conv(x, 16, 10).cast("bigint")
        div = lambda n, m: F.call_function("div", n, F.lit(m).cast("bigint"))
        made = _permuted(key, F.concat(F.lit("ipv6:"), i.cast("string")), div(number, 256), number % 256, F.lit(256), F.lit(256))
        said = let(made, lambda p: F.lower(F.conv((p["l"] * 256 + p["r"]).cast("string"), 10, 16)))
        kept = (x == "") | ((i == 0) & F.lower(x).rlike("^f[cde]"))
        return F.when(kept, x).otherwise(F.when(F.upper(hit) == hit, F.upper(said)).otherwise(said))

    return F.array_join(F.transform(F.split(hit, ":"), group), ":")


def _crypto(key: str, hit: Column) -> Column:
    """Each sign after the first ones moves on in its alphabet, by a step made of the signs before it."""
    start = F.when(hit.startswith("bc1"), F.lit(3)).otherwise(F.lit(1))
    signs = F.filter(F.split(F.substring(hit, start + 1, F.length(hit)), ""), lambda c: c != "")

    def moved(alphabet: str):
        def step(done: Column, c: Column) -> Column:
            place, size = F.instr(F.lit(alphabet), c), F.lit(len(alphabet)).cast("bigint")
            by = 1 + _prf(key, F.lit("crypto"), F.length(done).cast("string"), done, size - 1)
            other = F.substring(F.lit(alphabet), (F.pmod(place - 1 + by, size) + 1).cast("int"), F.lit(1))
            return F.concat(done, F.when(place == 0, c).otherwise(other))

        return F.aggregate(signs, F.substring(hit, F.lit(1), start), step)

    return F.when(hit.startswith("bc1"), moved(BECH32)).otherwise(moved(BASE58))


def _initial(key: str, token: Column) -> Column:
    """Another letter of the same alphabet, different ones for different letters; X of other alphabets."""
    letter, made = F.substring(token, F.lit(1), F.lit(1)), F.lit("X")
    for alphabet in INITIALS:
        place = F.instr(F.lit(alphabet), letter)
        by = 1 + _prf(key, F.lit("initial"), "", F.lit(alphabet[0]), F.lit(len(alphabet) - 1).cast("bigint"))
        other = F.substring(F.lit(alphabet), (F.pmod(place - 1 + by, F.lit(len(alphabet))) + 1).cast("int"), F.lit(1))
        made = F.when(place > 0, other).otherwise(made)
    return F.concat(made, F.substring(token, F.lit(2), F.length(token)))


def _mail(seed: Column, key: str, norm: Column, attempt: Column) -> Column:
    """Local part and domain in the shape of the real ones; one domain always becomes the same one."""
    local, domain = F.substring_index(norm, "@", 1), F.substring_index(norm, "@", -1)
    ending = F.substring_index(domain, ".", -1)
    host = F.substring(domain, F.lit(1), F.length(domain) - F.length(ending) - 1)
    of_host = F.sha2(F.concat_ws("|", F.lit(key), F.lit("domain"), host), 256)
    return F.concat(_coined(seed, local, attempt), F.lit("@"), _coined(of_host, host, F.lit(0)), F.lit("."), ending)


def _surrogate(key: str) -> Column:
    """The surrogate of ``kind`` and ``norm`` at ``attempt``, drawn from a keyed SHA-256."""
    norm, attempt = F.col("norm"), F.col("attempt")
    seed = F.sha2(F.concat_ws("|", F.lit(key), "kind", "norm", F.col("attempt").cast("string")), 256)
    made = F.when(F.col("kind") == "email", let(seed, lambda s: _mail(s, key, norm, attempt)))
    for gender in ("m", "f", "x"):
        made = made.when(F.col("kind") == f"given_{gender}", let(seed, lambda s, gender=gender: _given(s, norm, gender, attempt)))
    return made.otherwise(let(seed, lambda s: _coined(s, norm, attempt)))


def assign(units: DataFrame, key: str) -> DataFrame:
    """``kind``, ``norm``, ``surrogate`` of names and mail addresses: distinct parts get distinct surrogates that occur nowhere as real ones.

    Kinds of names share one space. All parts draw; of those with the same surrogate the first
    keeps it, and the others, and those that drew a real value or one that is taken, draw again.
    Coined words get longer after some attempts, so the rounds end.
    """
    space = F.when(F.col("kind").startswith("given_"), "given").otherwise(F.col("kind"))
    real = cut_lineage(units.select("kind", "norm").distinct().withColumn("space", space))
    names = real.select("space", F.col("norm").alias("surrogate")).distinct()
    pending, done, attempt = real, None, 0
    while True:
        drawn = cut_lineage(pending.withColumn("attempt", F.lit(attempt)).withColumn("surrogate", _surrogate(key)))
        place = F.row_number().over(Window.partitionBy("space", "surrogate").orderBy("norm", "kind"))
        free = drawn.join(names, ["space", "surrogate"], "left_anti")
        if done is not None:
            free = free.join(done.select("space", "surrogate"), ["space", "surrogate"], "left_anti")
        won = free.withColumn("place", place).where("place = 1").select("space", "kind", "norm", "surrogate")
        done = cut_lineage(won if done is None else done.union(won))
        pending = cut_lineage(drawn.join(done, ["kind", "norm"], "left_anti").select("kind", "norm", "space"))
        attempt += 1
        if pending.isEmpty():
            return done.select("kind", "norm", "surrogate")


def _cased(word: Column, like: Column) -> Column:
    """A lower-cased surrogate in the case of the word it stands for."""
    title = F.concat(F.upper(F.substring(word, 1, 1)), F.substring(word, F.lit(2), F.length(word)))
    upper = (F.upper(like) == like) & (F.length(like) > 1)
    return F.when(F.lower(like) == like, word).when(upper, F.upper(word)).otherwise(title)


def _rendered(hit: Column, known: Column, key: str) -> Column:
    """A match with its surrogates, those of names and mail addresses from the map ``known``; separators and case as written."""

    def lookup(u: Column) -> Column:
        return F.element_at(known, F.concat_ws(":", u["kind"], u["norm"]))

    def person(units: Column) -> Column:
        def token(t: Column, i: Column) -> Column:
            own = F.filter(units, lambda u: u["at"] == i)
            other = F.when(_is_initial(t), _initial(key, t)).otherwise(t)
            return F.when(F.size(own) > 0, _cased(lookup(F.get(own, F.lit(0))), t)).otherwise(other)

        return F.array_join(F.transform(F.split(hit, " "), token), " ")

    def mail(units: Column) -> Column:
        return let(lookup(F.get(units, F.lit(0))), lambda said: F.when(F.upper(hit) == hit, F.upper(said)).otherwise(said))

    def number(said: Column) -> Column:
        """The digits put where digits were, the last ones if there are fewer."""

        def sign(c: Column, i: Column) -> Column:
            place = F.length(_digits(F.substring(hit, F.lit(1), i + 1))) - F.length(_digits(hit)) + F.length(said)
            return F.when(c.rlike("[0-9]") & (place > 0), F.substring(said, place, F.lit(1))).otherwise(c)

        return F.array_join(F.transform(F.filter(F.split(hit, ""), lambda c: c != ""), sign), "")

    kind, digits = _kind(hit), _digits(hit)
    american = hit.rlike(r"[0-9]{3}\)?[ .-]?[0-9]{3}[ .-][0-9]{4}\z")
    national = F.when(american, F.right(digits, F.lit(10))).otherwise(digits)
    return let(
        kind,
        lambda k: F.when(k.isin("person", "email"), let(_units(hit), lambda units: F.when(k == "person", person(units)).otherwise(mail(units))))
        .when(k == "ip", _address(key, hit))
        .when(k == "ipv6", _address6(key, hit))
        .when(k == "crypto", _crypto(key, hit))
        .when(k == "ssn", let(let(digits, lambda d: _ssn(key, d)), number))
        .when(k == "card", let(let(digits, lambda d: _card(key, d)), number))
        .when(k == "phone", let(let(national, lambda d: _phone(key, d)), number))
        .otherwise(let(_some_digits(key, k, digits), number)),
    )


def _alone(gap: Column, known: Column) -> Column:
    """What lies between matches, with names of the text's persons replaced, alone or as parts of a name.

    A word that is both a surname and a given name of the text is taken as the surname.
    The capitalised words are looked up one by one, so it takes one pass whatever the number of names.
    """

    def lookup(word: Column) -> Column:
        kinds = ("surname", "given_m", "given_f", "given_x")
        return F.coalesce(*(F.element_at(known, F.concat(F.lit(f"{kind}:"), F.lower(word))) for kind in kinds))

    def part(word: Column) -> Column:
        return let(lookup(word), lambda said: F.when(said.isNull(), word).otherwise(_cased(said, word)))

    def name(word: Column) -> Column:
        parts = F.array_join(F.transform(F.split(word, r"(?<=['’-])|(?=['’-])"), part), "")
        return let(lookup(word), lambda said: F.when(said.isNull(), parts).otherwise(_cased(said, word)))

    words = F.regexp_extract_all(gap, F.lit(_WORD), F.lit(0))
    pieces = F.zip_with(
        F.split(gap, _WORD, -1), words, lambda rest, word: F.concat(rest, F.when(word.isNull(), F.lit("")).otherwise(name(word)))
    )
    return F.array_join(pieces, "")


def _rewritten(pieces: Column, known: Column, key: str) -> Column:
    """A text cut by ``CUT`` (every second piece is a match) with every match rendered, and names of its persons replaced where they stand alone."""
    named = F.exists(F.map_keys(known), lambda entry: entry.startswith("surname:") | entry.startswith("given_"))
    return let(
        named,
        lambda n: F.array_join(
            F.transform(
                pieces,
                lambda piece, i: F.when(i % 2 == 1, _rendered(piece, known, key)).otherwise(F.when(n, _alone(piece, known)).otherwise(piece)),
            ),
            "",
        ),
    )


def _cut(text: Column) -> Column:
    """The text in pieces, every second one a match; one piece where nothing matches, NULL of NULL."""
    once = F.split(F.regexp_replace(text, F.lit(ANY), F.lit(f"{CUT}$0{CUT}")), CUT, -1)
    hits = F.regexp_extract_all(text, F.lit(ANY), F.lit(0))
    # Where the sign of the cuts is in the text itself, matches and what lies between are found apart.
    apart = F.zip_with(F.split(text, ANY, -1), hits, lambda gap, hit: F.when(hit.isNull(), F.array(gap)).otherwise(F.array(gap, hit)))
    cut = F.when(text.contains(CUT), F.flatten(apart)).otherwise(once)
    return F.when(text.rlike(HINT), cut).otherwise(F.array(text))


def replace_entities(docs: DataFrame, key: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``n_entities``, ``entities``, ``text`` (with surrogates) for each row of ``docs``.

    ``entities`` counts matches by type. The same value gets the same surrogate everywhere, different
    values of a type different ones, and none its own. Names and mail addresses become words that
    occur nowhere as real ones; numbers are permuted within their kind, so a surrogate may be some
    other real number where a space is full. Which surrogate it is depends on ``key``, which must be
    kept secret. A null text stays null and has no entities; copies and repeated rows are rewritten
    alike; an empty table gives an empty result; other columns are not read. Texts are searched
    once and written in pieces; only those with a name or mail address are shuffled, to meet their
    surrogates.
    """
    if not key:
        raise ValueError("a key is needed")
    found = docs.select(F.col(doc_id).alias("id"), _cut(F.col(text)).alias("pieces"))
    cut = cut_lineage(found)
    several = F.size("pieces") > 1
    hits = F.filter("pieces", lambda piece, i: i % 2 == 1)
    with_hits = cut.where(several).withColumn("kinds", F.transform(hits, _kind))
    drawn = F.exists("kinds", lambda kind: kind.isin("person", "email"))
    digest = F.md5(F.array_join("pieces", CUT).cast("binary"))
    with_names = with_hits.where(drawn).withColumn("digest", digest)
    parts = cut_lineage(
        with_names.select("digest", F.explode(F.flatten(F.transform(hits, _units))).alias("unit"))
        .select("digest", "unit.kind", "unit.norm")
        .distinct()
    )
    surrogates = assign(parts, key)
    entry = F.struct(F.concat_ws(":", "kind", "norm").alias("key"), F.col("surrogate").alias("value"))
    known = cut_lineage(
        parts.join(surrogates, ["kind", "norm"])
        .groupBy("digest")
        .agg(F.map_from_entries(F.collect_list(entry)).alias("known"))
    )
    counts = F.filter(
        F.transform(
            F.array(*map(F.lit, PATTERNS)),
            lambda k: F.struct(k.alias("kind"), F.size(F.filter("kinds", lambda x: x == k)).alias("n")),
        ),
        lambda c: c["n"] > 0,
    )
    listed = F.array_join(F.transform(counts, lambda c: F.concat_ws(":", c["kind"], c["n"])), ",")

    nobody = F.create_map().cast("map<string, string>").alias("known")
    told = with_names.join(known, "digest").select("id", "pieces", "kinds", "known").union(
        with_hits.where(~drawn).select("id", "pieces", "kinds", nobody)
    )
    rewritten = told.select(
        "id",
        F.size("kinds").cast("bigint").alias("n_entities"),
        listed.alias("entities"),
        _rewritten(F.col("pieces"), F.col("known"), key).alias("text"),
    )
    plain = cut.where(~F.coalesce(several, F.lit(False))).select(
        "id", F.lit(0).cast("bigint").alias("n_entities"), F.lit("").alias("entities"), F.get("pieces", F.lit(0)).alias("text")
    )
    return rewritten.union(plain).withColumnRenamed("id", doc_id)
