"""Surrogates for personal data, in DataFrame functions alone.

Detected entities (e-mail and IP addresses, phone, card, social-security and account numbers, secrets, names of
persons) are replaced by keyed surrogates of the same type and format: digits stay digits in the same grouping, a card
number that passes its check digit still does, an account number gets right check digits, private IP ranges stay
private, given names are exchanged within their gender and script in keyed order (so a surrogate may be another's
original name), surnames keep case, hyphens, apostrophes, gendered endings and script (Latin, Cyrillic, Greek, Armenian;
others become Latin), so that "Петров" and "Петрова" stay a pair. An entity has the same surrogate everywhere, also where it
is written differently (grouping, case), and a name that a document has as a person's is replaced wherever it stands alone in
that document. Domains are reserved ones (example.com and its like, or under .example), public IPv4 addresses come from a
block that is assigned to no one (240.0.0.0 to 254.255.255.255) or are IPv6 addresses for documentation.
Surrogates come from SHA-2 of key, type, canonical form and attempt; the distinct entities of the whole corpus are
checked, and those whose surrogate another entity has, or which equals any original, get the next attempt. Private IP
addresses are permuted within their range, so that a range in full use has surrogates too. From attempt ``ATTEMPTS`` on the small formats
are widened (more digits, letters or syllables; an IP address becomes one of IPv6), so that a free surrogate is found.

Edge cases: a null text stays null, an empty one empty, with 0 entities. Rows that repeat are replaced alike. Texts
without candidates pass unchanged, and columns other than the text are kept whatever their names (a column named as
``count_col`` raises ValueError). An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom import runtime

KEY_CONF = "spark.quadloom.surrogateKey"
#: The query's and the pipeline's key, where the session has none. Who knows a key can test guesses: real data need another.
QUERY_KEY = "surrogates-1"
#: Overrides up to this number go into the plan as a literal map; more are joined by row.
LITERAL_OVERRIDES = 500
ATTEMPTS = 12

#: Given names by script and gender. Within a list the surrogate is the next name in keyed order.
GIVEN: dict[str, list[str]] = {
    "latin-f": "Anna Maria Emma Laura Julia Sophie Clara Martha Helen Alice Sarah Jessica Emily Olivia Katherine Elizabeth Margaret Linda Susan Carmen Lucia Isabel Camille Chloe Ingrid Petra".split(),
    "latin-m": "John James Robert Michael William David Thomas Daniel Peter Paul George Henry Oliver Jack Hans Karl Stefan Jürgen Pierre Jean Louis Carlos Miguel Javier Diego Antonio".split(),
    "cyrillic-f": "Анна Мария Ольга Елена Наталья Татьяна Ирина Светлана Екатерина Юлия".split(),
    "cyrillic-m": "Иван Алексей Сергей Дмитрий Андрей Михаил Николай Павел Владимир Юрий".split(),
    "greek-f": "Ελένη Μαρία Σοφία Κατερίνα Άννα".split(),
    "greek-m": "Γιώργος Νίκος Δημήτρης Κώστας Παναγιώτης".split(),
    "asia-f": "Priya Ananya Lakshmi Mei Ling Yuki Sakura Fatima Aisha Leila Nadia Amina".split(),
    "asia-m": "Arjun Rahul Sanjay Wei Jun Hiroshi Kenji Mohammed Ahmed Omar Hassan Yusuf".split(),
}
TITLES = "Mr Mrs Ms Miss Dr Prof Herr Frau Monsieur Madame Mme Señor Señora".split()
#: Endings of surnames that tell gender or descent; a surrogate keeps them.
ENDINGS = "ская цкая ский цкий ова ева ёва ина ына ов ев ёв ин ын енко ová ova eva ska ski sky sson dóttir dottir όπουλος οπούλου ίδης ίδου άκης άκη".split()
#: Syllables of surnames, 16 to a script; a surname takes five, and three before a kept ending.
SYLLABLES = {
    "latin": "ba den fal gor hin ker lam mor nes pol ris sta tur vel win zar".split(),
    "cyrillic": "ба ден фал гор хин кер лам мор нес пол рис ста тур вел вин зар".split(),
    "greek": "βα δεν φαλ γορ χιν κερ λαμ μορ νες πολ ρισ στα τουρ βελ βιν ζαρ".split(),
    "armenian": "բա դեն ֆալ գոր հին կեր լամ մոր նես պոլ րիս ստա տուր վել վին զար".split(),
}
_JOINTS = "['’-]"
#: Feminine endings and the masculine ones that a pair's stem is found by.
PAIRS = [("(ов|ев|ёв|ин|ын|ov|ev)[аa]$", "$1"), ("(ск|цк)ая$", "$1ий"), ("ska$", "ski"), ("οπούλου$", "όπουλος"), ("ίδου$", "ίδης")]
#: A name as it stands alone: a possessive s is not of it.
ALONE = r"(?<![\p{L}\p{N}])\p{Lu}\p{L}*+(?:['’-]\p{Lu}\p{L}*+)*+(?![\p{L}\p{N}])"
PRIVATE = r"^(10\.|192\.168\.|172\.(?:1[6-9]|2\d|3[01])\.|127\.)"

_NAME = r"\p{Lu}[\p{L}'’-]+"
#: Repeated groups are possessive: the others recurse, once for each part of a long text.
EMAIL = r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++(?=\.[A-Za-z0-9-]))*+\.[A-Za-z]{2,}"
SECRET_LEAD = r"""(?i:token|secret|password|passwd|api[_-]?key)["']?\s{0,3}[:=]\s{0,3}["']?"""
SECRET = SECRET_LEAD + r"""[^\s"',;]{6,}|(?<![A-Za-z0-9])(?:[0-9a-f]{32,}|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9_-]{16,})(?![A-Za-z0-9])"""
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
IP = r"(?<![\d.])(?<!(?i:version|release|build|section|chapter)[ .:]{1,2})(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)"
CARD = r"(?<![\d.])\d(?:[ -]?\d){12,18}(?![\d])"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
PHONE = r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{4}|\d{3}[ .-]\d{3}[ .-]\d{4})(?!\d)|(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\d)"
PERSON = (rf"(?=\p{{Lu}})(?:(?:{'|'.join(TITLES)})\.?\s(?:(?:{'|'.join(sorted(sum(GIVEN.values(), []), key=len, reverse=True))})\s)?{_NAME}"
          rf"|(?:{'|'.join(sorted(sum(GIVEN.values(), []), key=len, reverse=True))})\s{_NAME})(?![\p{{L}}])")
#: Everything starts where no letter or digit stands before; possessive and guarded, as the pattern meets every word.
DETECT = r"(?<![\p{L}\p{N}])(?:" + "|".join([rf"(?:(?<![A-Za-z0-9._%+-])|(?<=[^\x00-\x7F][._%+-]))(?=[A-Za-z0-9._%+-]++@){EMAIL}", PERSON, rf"(?=[TtSsPpAaGgKk0-9a-f])(?:{SECRET})", rf"(?=[A-Z]{{2}}\d){IBAN}", rf"(?=[+(\d])(?:{IP}|{CARD}|{SSN}|{PHONE})"]) + ")"
#: Cheap: whatever DETECT finds, this finds too.
CANDIDATE = r"[@0-9:=]|\p{Lu}[\p{L}'’-]*\.?\s\p{Lu}"


def _keyed_order(names: list[str], key: str) -> list[str]:
    return sorted(names, key=lambda n: hmac.new(key.encode(), n.encode(), hashlib.sha256).digest())


def _given_map(key: str) -> dict[str, str]:
    out = {}
    for names in GIVEN.values():
        order = _keyed_order(names, key)
        out |= dict(zip(order, order[1:] + order[:1], strict=True))
    return out


def _kind(e: Column) -> Column:
    whole = lambda p: e.rlike(f"^(?:{p})$")
    return (F.when(whole(EMAIL), "email").when(whole(SECRET), "secret").when(whole(IBAN), "iban").when(whole(IP), "ip").when(whole(CARD), "card")
            .when(whole(SSN), "ssn").when(e.rlike(r"\p{L}"), "person").otherwise("phone"))


def _digits(e: Column) -> Column:
    return F.regexp_replace(e, "[^0-9]", "")


def _secret_value(e: Column) -> Column:
    return F.regexp_replace(e, "^" + SECRET_LEAD, "")


def _stem(w: Column) -> Column:
    """A surname in lower case, a feminine one as the masculine of its pair."""
    out = F.lower(w)
    for feminine, masculine in PAIRS:
        out = F.regexp_replace(out, feminine, masculine)
    return out


def _words(e: Column) -> Column:
    """A person's names that the list of given names does not have, without a title; Smith-Jones are two names, O'Brien
    is O and Brien."""
    known = sum(GIVEN.values(), [])
    words = F.filter(F.split(e, r"\s"), lambda w: ~w.isin(known) & ~F.regexp_replace(w, r"\.$", "").isin(TITLES))
    return F.filter(F.flatten(F.transform(words, lambda w: F.split(w, _JOINTS))), lambda w: F.length(w) > 1)


def _form(kind: Column, e: Column, d: Column) -> Column:
    return (F.when(kind == "email", F.lower(e)).when(kind == "secret", _secret_value(e)).when(kind == "iban", F.regexp_replace(e, " ", ""))
            .when(kind == "ip", e).when(kind == "phone", F.right(d, F.lit(10))).otherwise(d))


def _parts(e: Column) -> Column:
    """An entity's canonical parts as 'type:form'."""
    def of(kind: Column) -> Column:
        return F.when(kind == "person", F.transform(_words(e), lambda w: F.concat(F.lit("name:"), _stem(w)))).otherwise(F.array(F.concat(kind, F.lit(":"), _form(kind, e, _digits(e)))))

    return _let(_kind(e), of)


def _hash(key: str, part: Column, attempt: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), part, attempt.cast("string")).cast("binary"), 512)


def _num(h: Column, at: int, n: int = 12) -> Column:
    return F.conv(F.substring(h, at, n), 16, 10).cast("bigint")


def _pool(h: Column) -> Column:
    """48 digits."""
    return F.concat(*[F.right(F.lpad(F.conv(F.substring(h, 1 + 12 * i, 12), 16, 10), 15, "0"), F.lit(12)) for i in range(4)])


def _reformat(form: Column, h: Column) -> Column:
    """Each digit and letter for another of its class, other letters for a small one or a digit, and so everything where
    less than 6 characters are of a class (masks); hexadecimal strings stay hexadecimal."""
    plain = F.length(F.regexp_replace(form, "[^0-9a-zA-Z]", "")) < 6
    hexa = form.rlike("^[0-9a-f]*[a-f][0-9a-f]*$")

    def one(c: Column, i: Column) -> Column:
        v = F.conv(F.substring(h, F.pmod(i * 2, F.lit(126)) + 1, F.lit(2)), 16, 10).cast("int")
        return (F.when(hexa, F.lower(F.hex(F.pmod(v, F.lit(16))))).when(c.rlike("[0-9]"), F.pmod(v, F.lit(10)).cast("string"))
                .when(c.rlike("[a-z]"), F.char(F.pmod(v, F.lit(26)) + 97)).when(c.rlike("[A-Z]"), F.char(F.pmod(v, F.lit(26)) + 65))
                .when(plain | c.rlike(r"[\p{L}\p{N}]"), F.substring(F.lit("abcdefghijklmnopqrstuvwxyz234567"), F.pmod(v, F.lit(32)) + 1, F.lit(1))).otherwise(c))

    return F.array_join(F.transform(F.split(form, ""), one), "")


def _luhn(body: Column) -> Column:
    """The check digit that follows ``body``."""
    d = F.transform(F.split(F.reverse(body), ""), lambda c, i: F.when(F.pmod(i, F.lit(2)) == 0, F.pmod(c.cast("int") * 2, F.lit(10)) + (c.cast("int") >= 5).cast("int")).otherwise(c.cast("int")))
    return F.pmod(10 - F.pmod(F.aggregate(d, F.lit(0), lambda a, x: a + x), F.lit(10)), F.lit(10))


def _card(form: Column, pool: Column) -> Column:
    n = F.length(form)
    body = F.concat(F.substring(form, 1, 1), F.substring(pool, F.lit(1), n - 2))
    shift = F.right(form, F.lit(1)).cast("int") - _luhn(F.substring(form, F.lit(1), n - 1))  # 0 for a valid number
    return F.concat(body, F.pmod(_luhn(body) + shift, F.lit(10)).cast("string"))


def _iban(form: Column, h: Column) -> Column:
    country, bban = F.substring(form, 1, 2), _reformat(F.substring(form, F.lit(5), F.length(form) - 4), h)
    values = F.transform(F.split(F.concat(bban, country, F.lit("00")), ""), lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55))
    rest = F.aggregate(values, F.lit(0), lambda a, v: F.pmod(F.when(v > 9, a * 100 + v).otherwise(a * 10 + v), F.lit(97)))
    return F.concat(country, F.lpad((98 - rest).cast("string"), 2, "0"), bban)


def _shuffled(prefix: Column, numbers: list[Column], bits: int, key: str, attempt: Column) -> tuple[Column, Column]:
    """A keyed permutation of pairs of ``bits``-bit numbers (four Feistel rounds)."""
    a, b = numbers
    for r in range(4):
        word = F.sha2(F.concat_ws("|", F.lit(key), F.lit(f"ip{r}"), prefix, attempt.cast("string"), b.cast("string")).cast("binary"), 256)
        a, b = b, a.bitwiseXOR(F.pmod(F.conv(F.substring(word, 1, 4), 16, 10).cast("int"), F.lit(1 << bits)))
    return a, b


def _ip(form: Column, h: Column, wide: Column, key: str, attempt: Column) -> Column:
    """Public addresses become ones of a reserved block (for documentation, of IPv6, from the third attempt on); private ones
    are permuted within their own range, which may be in use as a whole."""
    private = F.regexp_extract(form, PRIVATE, 1)
    public = F.concat_ws(".", 240 + F.pmod(_num(h, 37), F.lit(15)), *[F.pmod(_num(h, 1 + 12 * i), F.lit(256)) for i in range(3)])
    octet = [F.coalesce(F.try_element_at(F.split(form, r"\."), F.lit(i)).cast("int"), F.lit(0)) for i in (2, 3, 4)]

    def two(prefix: Column) -> Column:
        return _let(F.struct(*[c.alias(n) for c, n in zip(_shuffled(prefix, octet[1:], 8, key, attempt), "ab", strict=True)]), lambda v: F.concat_ws(".", v["a"], v["b"]))

    def three(prefix: Column) -> Column:
        halves = [octet[0] * 16 + F.floor(octet[1] / 16).cast("int"), F.pmod(octet[1], F.lit(16)) * 256 + octet[2]]
        pair = F.struct(*[c.alias(n) for c, n in zip(_shuffled(prefix, halves, 12, key, attempt), "ab", strict=True)])
        return _let(pair, lambda v: F.concat_ws(".", F.floor(v["a"] / 16), F.pmod(v["a"], F.lit(16)) * 16 + F.floor(v["b"] / 256), F.pmod(v["b"], F.lit(256))))

    six = F.concat_ws(":", F.when(private == "", F.lit("2001:db8")).otherwise(F.lit("fd00:0")), *[F.substring(h, 60 + 4 * i, 4) for i in range(6)])
    return F.when(wide | (private == "") & (attempt > 2), six).when(private == "", public).when(private.isin("10.", "127."), F.concat(private, three(private))).otherwise(F.concat(private, two(private)))


def _letters(x: Column) -> Column:
    return F.translate(x, "0123456789", "ghijkmnpqr")


def _email(form: Column, h: Column, key: str) -> Column:
    local, domain = F.substring_index(form, "@", 1), F.substring_index(form, "@", -1)
    new = F.concat(_letters(F.substring(h, 1, 10)), F.when(local.rlike(r"[._+-]"), F.regexp_extract(local, r"([._+-])", 1)).otherwise(F.lit("")), F.when(local.rlike(r"\d"), F.substring(_pool(h), 13, 4)).otherwise(_letters(F.substring(h, 20, 4))))
    site = F.sha2(F.concat_ws("|", F.lit(key), F.lit("site"), domain).cast("binary"), 256)
    tail = F.regexp_extract(domain, r"((?:\.(?:co|ac|gov|org|com|net|edu))?\.[^.]+)$", 1)
    reserved = F.when(tail.isin(".com", ".net", ".org"), F.concat(F.lit(".example"), tail)).otherwise(F.concat(tail, F.lit(".example")))
    return F.concat(new, F.lit("@"), _letters(F.substring(site, 1, 10)), reserved)


def _surname(form: Column, h: Column, wide: Column) -> Column:
    """In lower case, in the form's script (Latin for scripts without syllables here) and with its ending."""
    low = F.lower(form)
    ending = F.regexp_extract(low, f"({'|'.join(ENDINGS)})$", 1)

    def build(script: str) -> Column:
        table = F.array(*map(F.lit, SYLLABLES[script]))
        part = [F.element_at(table, (F.pmod(F.conv(F.substring(h, 1 + 2 * i, 2), 16, 10).cast("int"), F.lit(16)) + 1).cast("int")) for i in range(15)]
        return F.concat(*part[:3], F.when(wide, F.concat(*part[5:])).otherwise(F.lit("")), F.when(ending == "", F.concat(*part[3:5])).otherwise(ending))

    return F.when(low.rlike(r"\p{IsCyrillic}"), build("cyrillic")).when(low.rlike(r"\p{IsGreek}"), build("greek")).when(low.rlike(r"\p{IsArmenian}"), build("armenian")).otherwise(build("latin"))


def _recased(new: Column, old: Column) -> Column:
    """Capitals where the old name has them; all of an old name in capitals."""
    mixed = F.array_join(F.transform(F.split(new, ""), lambda c, i: F.when(F.substring(old, i + 1, F.lit(1)).rlike(r"\p{Lu}"), F.upper(c)).otherwise(c)), "")
    return F.when((old == F.upper(old)) & (F.length(old) > 1), F.upper(new)).otherwise(mixed)


def _let(value: Column, then) -> Column:
    """Binds a value to a lambda's variable, so that the expression does not repeat it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def canonical_surrogate(part: Column, attempt: Column, key: str) -> Column:
    """The surrogate's canonical form of 'type:form'."""
    wide = attempt >= ATTEMPTS

    def of(v: Column) -> Column:
        kind, form, h, pool = v["kind"], v["form"], v["h"], v["pool"]
        more = lambda x: F.when(wide, x).otherwise(F.lit(""))
        return (F.when(kind == "email", _email(form, h, key)).when(kind == "secret", F.concat(_reformat(form, h), more(F.substring(h, 101, 16)))).when(kind == "iban", _iban(form, h)).when(kind == "ip", _ip(form, h, wide, key, attempt))
                .when(kind == "card", _card(form, pool)).when(kind == "ssn", F.concat(F.lit("9"), F.substring(pool, 1, 8), more(F.substring(pool, 37, 12)))).when(kind == "name", _surname(form, h, wide))
                .otherwise(F.concat((F.substring(pool, 1, 1).cast("int") % 8 + 2).cast("string"), F.substring(pool, F.lit(2), F.length(form) - 1), more(F.substring(pool, 37, 12)))))

    split = F.struct(F.substring_index(part, ":", 1).alias("kind"), F.regexp_replace(part, "^[a-z]+:", "").alias("form"), _hash(key, part, attempt).alias("h"))
    return _let(split, lambda v: _let(F.struct(v["kind"].alias("kind"), v["form"].alias("form"), v["h"].alias("h"), _pool(v["h"]).alias("pool")), of))


def _place(surface: Column, digits: Column) -> Column:
    """``digits`` in the digit positions of ``surface``; those left over follow."""
    start = F.struct(F.lit("").alias("s"), F.lit(1).alias("k"))
    step = lambda a, c: F.when(c.rlike("[0-9]"), F.struct(F.concat(a["s"], F.substring(digits, a["k"], F.lit(1))).alias("s"), (a["k"] + 1).alias("k"))).otherwise(F.struct(F.concat(a["s"], c).alias("s"), a["k"].alias("k")))
    return F.aggregate(F.split(surface, ""), start, step, lambda a: F.concat(a["s"], F.substring(digits, a["k"], F.length(digits))))


def _place_all(surface: Column, chars: Column) -> Column:
    """``chars`` in the positions of ``surface`` that are not blanks."""
    start = F.struct(F.lit("").alias("s"), F.lit(1).alias("k"))
    step = lambda a, c: F.when(c != " ", F.struct(F.concat(a["s"], F.substring(chars, a["k"], F.lit(1))).alias("s"), (a["k"] + 1).alias("k"))).otherwise(F.struct(F.concat(a["s"], c).alias("s"), a["k"].alias("k")))
    return F.aggregate(F.split(surface, ""), start, step, lambda a: a["s"])


def _tries(attempts: Column | None):
    return lambda part: F.lit(0) if attempts is None else F.coalesce(F.try_element_at(attempts, part), F.lit(0))


def name_words(key: str, attempts: Column | None):
    """word -> its surrogate, for the words of a person's name."""
    given, tries = _given_map(key), _tries(attempts)
    names = F.create_map(*[F.lit(x) for kv in given.items() for x in kv])

    def one(w: Column) -> Column:
        new = _let(F.concat(F.lit("name:"), _stem(w)), lambda part: _surname(w, _hash(key, part, tries(part)), tries(part) >= ATTEMPTS))
        return F.when(F.length(w) > 1, _recased(new, w)).otherwise(w)

    def name(w: Column) -> Column:
        joints = F.concat(F.regexp_extract_all(w, F.lit(_JOINTS), F.lit(0)), F.array(F.lit("")))
        return F.array_join(F.zip_with(F.transform(F.split(w, _JOINTS), one), joints, lambda n, j: F.concat(n, j)), "")

    return lambda w: F.when(F.regexp_replace(w, r"\.$", "").isin(TITLES), w).when(w.isin(list(given)), F.try_element_at(names, w)).when(
        (w == F.upper(w)) & F.initcap(w).isin(list(given)), F.upper(F.try_element_at(names, F.initcap(w)))).otherwise(name(w))


def persons_names(entities: Column) -> Column:
    """The names, in lower case, of the persons among an array of entities: whole ones and the parts of joined ones."""
    words = F.flatten(F.transform(entities, lambda e: F.when(_kind(e) == "person", F.regexp_extract_all(e, F.lit(ALONE), F.lit(0))).otherwise(F.array().cast("array<string>"))))
    parts = F.flatten(F.transform(words, lambda w: F.concat(F.array(w), F.filter(F.split(w, _JOINTS), lambda x: F.length(x) > 2))))
    return F.array_distinct(F.transform(F.filter(parts, lambda w: ~w.isin(TITLES) & (F.length(w) > 1)), lambda w: F.lower(w)))


def names_alone(pieces: Column, names: Column, word) -> Column:
    """Texts between entities, in which each of ``names`` that stands alone is replaced."""
    def piece(p: Column) -> Column:
        found = F.transform(F.regexp_extract_all(p, F.lit(ALONE), F.lit(0)), lambda t: F.when(F.array_contains(names, F.lower(t)), word(t)).otherwise(t))
        return F.array_join(F.zip_with(F.split(p, ALONE, -1), F.concat(found, F.array(F.lit(""))), lambda a, t: F.concat(a, t)), "")

    return F.when(F.size(names) > 0, F.transform(pieces, piece)).otherwise(pieces)


def surrogates(entities: Column, key: str, attempts: Column | None) -> Column:
    """The surface forms that take the place of an array of entities."""
    tries, word = _tries(attempts), name_words(key, attempts)

    def surface(x: Column) -> Column:
        e, kind, d, new = x["e"], x["kind"], x["d"], x["new"]
        cc = F.substring(d, F.lit(1), F.greatest(F.length(d) - 10, F.lit(0)))
        return (F.when(kind == "person", F.array_join(F.transform(F.split(e, r"\s"), word), " ")).when(kind.isin("email", "ip"), new)
                .when(kind == "secret", F.concat(F.regexp_extract(e, "^(" + SECRET_LEAD + ")", 1), new)).when(kind == "iban", _place_all(e, new))
                .otherwise(_place(e, F.when(kind == "phone", F.concat(cc, new)).otherwise(new))))

    typed = F.transform(entities, lambda e: F.struct(e.alias("e"), _kind(e).alias("kind"), _digits(e).alias("d")))
    formed = F.transform(typed, lambda x: F.struct(x["e"].alias("e"), x["kind"].alias("kind"), x["d"].alias("d"), F.when(x["kind"] != "person", F.concat(x["kind"], F.lit(":"), _form(x["kind"], x["e"], x["d"]))).alias("part")))
    done = F.transform(formed, lambda x: F.struct(x["e"].alias("e"), x["kind"].alias("kind"), x["d"].alias("d"), F.when(x["kind"] != "person", canonical_surrogate(x["part"], tries(x["part"]), key)).alias("new")))
    return F.transform(done, surface)


def resolve(parts: DataFrame, key: str) -> DataFrame:
    """Distinct ``part``s -> part and attempt, such that no two of a type share a surrogate, none is its own original and,
    but for private addresses, none is any original."""
    kind = F.substring_index("part", ":", 1)
    form = F.regexp_replace("part", "^[a-z]+:", "")
    free = ~((F.col("kind") == "ip") & F.col("form").rlike(PRIVATE))  # the others are permuted
    now = runtime.materialize(parts.select("part", kind.alias("kind"), form.alias("form"), F.lit(0).alias("attempt"), canonical_surrogate(F.col("part"), F.lit(0), key).alias("new")), "entities")
    while True:
        originals = now.select("kind", F.col("form").alias("new"))
        first = now.groupBy("kind", "new").agg(F.min("part").alias("keeper"), F.count("*").alias("n")).where("n > 1").drop("n")
        bad = (now.where(free).join(originals, ["kind", "new"], "left_semi").select("part").union(now.where("new = form").select("part"))
               .union(now.join(first, ["kind", "new"]).where("part <> keeper").select("part"))).distinct().withColumn("again", F.lit(True))
        bad = runtime.materialize(bad, "clashes")
        if bad.isEmpty():
            return now.select("part", "attempt")
        now = now.join(bad, "part", "left").withColumn("attempt", F.col("attempt") + F.col("again").isNotNull().cast("int"))
        now = runtime.materialize(now.withColumn("new", F.when(F.col("again"), canonical_surrogate(F.col("part"), F.col("attempt"), key)).otherwise(F.col("new"))).drop("again"), "entities")


def replace(docs: DataFrame, *, text_col: str = "text", key: str | None = None, count_col: str = "pii_entities") -> DataFrame:
    """All columns, with the text's entities replaced and their number added (names that stand alone are not counted again).
    ``key``: of the surrogates; else what the session has in KEY_CONF. Without either ValueError is raised."""
    key = key or docs.sparkSession.conf.get(KEY_CONF, None)
    if not key:
        raise ValueError(f"surrogates need a key: give one or set {KEY_CONF}")
    if count_col in docs.columns:
        raise ValueError(f"a column is named {count_col}")
    text = F.col(text_col)
    found = F.when(text.rlike(CANDIDATE), F.regexp_extract_all(text, F.lit(DETECT), F.lit(0))).otherwise(F.array().cast("array<string>"))
    hits = docs.select(F.explode(found).alias("e"))
    distinct = hits.distinct().select(F.explode(_parts(F.col("e"))).alias("part")).distinct()
    overrides = runtime.materialize(resolve(distinct, key).where("attempt > 0"), "overrides")
    few = overrides.limit(LITERAL_OVERRIDES + 1).collect()

    taken = set(docs.columns)
    own = lambda n: next(x for x in (n, *(f"{n}_{i}" for i in range(len(taken) + 1))) if x not in taken)
    ents, tries, rid, names = own("found"), own("tries"), own("rid"), own("names")
    rows = docs.withColumn(ents, found)
    if not few:
        attempts = None
    elif len(few) <= LITERAL_OVERRIDES:
        attempts = F.create_map(*[F.lit(x) for r in few for x in (r.part, r.attempt)])
    else:
        rows = runtime.materialize(rows.withColumn(rid, F.monotonically_increasing_id()), "pii-rows")  # ids must outlive a lost task
        mine = rows.where(F.size(ents) > 0).select(rid, F.explode(ents).alias("e")).select(rid, F.explode(_parts(F.col("e"))).alias("part")).distinct()
        mine = mine.join(overrides, "part").groupBy(rid).agg(F.map_from_entries(F.collect_list(F.struct("part", "attempt"))).alias(tries))
        rows = rows.join(mine, rid, "left")
        attempts = F.coalesce(F.col(tries), F.create_map().cast("map<string,int>"))
    rows = rows.withColumn(names, persons_names(F.col(ents)))
    pieces = names_alone(F.split(text, DETECT, -1), F.col(names), name_words(key, attempts))
    news = surrogates(F.col(ents), key, attempts)
    woven = F.concat(F.array_join(F.zip_with(F.slice(pieces, F.lit(1), F.size(ents)), news, lambda p, s: F.concat(p, s)), ""), F.element_at(pieces, -1))
    out = {c: F.col(c) for c in docs.columns}
    out[text_col] = F.when(F.size(ents) > 0, woven).otherwise(text)
    return rows.select(*[out[c].alias(c) for c in docs.columns], F.size(ents).alias(count_col))


def session_key(spark: SparkSession) -> str:
    """The session's key; where it has none, that of the query and the pipeline over the test tables."""
    return spark.conf.get(KEY_CONF, None) or QUERY_KEY


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace(runtime.table(spark, sf_dir, "documents"), key=session_key(spark))
