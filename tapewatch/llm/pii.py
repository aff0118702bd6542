"""Replaces personal data by keyed surrogates of the same type and form. Column expressions only.

Every entity has a canonical form, and its surrogate follows from a key, its type and that form alone, so the same
person or number gets the same surrogate in every document, whatever its spelling. Over all distinct entities
surrogates are checked: where two collide, or one is a real entity of the corpus, the later one is derived
anew with the next attempt number, so distinct entities stay distinct. Every few attempts make surrogates longer, so
there is room for any number of entities. Only such attempts need to travel back to texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewatch.session import cut

# How keys, passwords and names begin.
PEM, JWT, PREFIXES = "PRIVATE KEY", "eyJ", {r"(?:AKIA|ASIA)": "[A-Z0-9]{16}", r"gh[pousr]_": "[A-Za-z0-9]{36,}", r"sk-": "[A-Za-z0-9]{20,}"}
ASSIGNED = r"[\"']?\s{0,3}[=:]\s{0,3}[\"']?"
PASSWORD = rf"(?i:(?<![a-z])(?:password|passwd|pwd)){ASSIGNED}"
TITLE = r"(?:Mrs?|Ms|Miss|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|Señora?|Sra?|Г-н|Г-жа)\.? "
#: What stands for a password in forms and code: a word for its kind, a call, a member, a variable.
NO_PASSWORD = (r"(?!(?i:required|optional|string|password|passwd|incorrect|invalid|forgotten|missing|undefined|default|changed|protected|please)\b)"
               r"(?![<${(\[%])(?!\w{1,80}+[(\[{])(?![A-Za-z_]\w{0,80}+\.\w)")
# What an entity looks like. The order decides where two start at the same place.
PATTERNS: dict[str, str] = {
    "key": rf"-----BEGIN [A-Z ]*{PEM}-----[A-Za-z0-9+/=\s]++-----END [A-Z ]*{PEM}-----"
           rf"|(?<![A-Za-z0-9])(?:{'|'.join(start + rest for start, rest in PREFIXES.items())})(?![A-Za-z0-9])"
           rf"|(?<![A-Za-z0-9]){JWT}[A-Za-z0-9_\-]{{8,}}+\.[A-Za-z0-9_\-]{{8,}}+\.[A-Za-z0-9_\-]{{8,}}+",
    "secret": rf"(?i:(?<![a-z])(?:password|passwd|pwd|secret|api[_\-]?key|access[_\-]?key|token)){ASSIGNED}"
              r"(?=[^\s\"']{0,200}\d)[^\s\"']{6,}"
              rf"|{PASSWORD}{NO_PASSWORD}(?=[^\s\"']{{0,200}}[A-Za-z]{{2}})[^\s\"']{{6,}}",
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@(?:[A-Za-z0-9\-]+\.)+[A-Za-z]{2,}",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\w|\.\d)"
          r"|(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\w:])"
          # with a gap: at most seven groups and a digit, so that names joined by colons stay
          r"|(?<![\w:.])(?=[0-9A-Fa-f:]{0,39}\d)(?!(?:[0-9A-Fa-f]{0,4}:){8}[0-9A-Fa-f])[0-9A-Fa-f]{2,4}(?::[0-9A-Fa-f]{1,4}){0,6}::"
          r"(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?(?![\w:])",
    "card": r"(?<![\w.+\-])(?:\d{4}[ \-]\d{4}[ \-]\d{4}[ \-]\d{1,7}|\d{4}[ \-]\d{6}[ \-]\d{4,5}|\d{13,19})(?!\w)",
    "ssn": r"(?<![\w\-])\d{3}-\d{2}-\d{4}(?![\w\-])",
    "phone": r"(?<![\w+])\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .\-]?\d{2,4}){2,4}(?!\w)"
             r"|(?<!\w)\(\d{3}\) ?\d{3}[ .\-]\d{4}(?!\w)|(?<![\w.\-])\d{3}[.\-]\d{3}[.\-]\d{4}(?![\w\-])"
             # North American with spaces or the trunk 1; area and exchange begin with 2 to 9
             r"|(?<![\w.+\-])(?<!\d )[2-9]\d{2} [2-9]\d{2}[ \-]\d{4}(?![\w\-]| \d)"
             r"|(?<![\w.+\-])(?<!\d )1[ .\-]?(?:\([2-9]\d{2}\) ?|[2-9]\d{2}[ .\-])[2-9]\d{2}[ .\-]\d{4}(?![\w\-])"
             # national with the trunk 0: an area and 9 to 13 digits in all, or five pairs
             r"|(?<![\w.+/\-])(?<!\d )(?=\d(?:[ /\-]?\d){8,12}(?![\w\-]))0[1-9]\d{1,4}[ /\-]\d{3,9}(?:[ \-]\d{2,5}){0,3}(?![\w\-]| \d)"
             r"|(?<![\w.+/\-])(?<!\d )0[1-9](?:[ .\-]\d{2}){4}(?![\w\-]|[ .]\d)",
    "name": rf"(?<![\p{{L}}\p{{N}}]){TITLE[:-1]}"
            r"(?: \p{Lu}(?:\p{Ll}+|\p{Lu}+|\.)(?:-\p{Lu}\p{Ll}+)?){1,3}(?![\p{L}\p{N}])",
}
TYPES = tuple(PATTERNS)
FEMALE = r"^(?:Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|Г-жа)\b"
MALE = r"^(?:Mr|Herr|Monsieur|Señor|Sr|Г-н)\b"
LATIN = "ba be bi bo da de di do fa fe ka ke ki ko la le li lo ma me mi mo na ne ni no ra re ri ro sa se si so ta te ti to va ve vi vo".split()
CYRILLIC = "ба бе бо да де до ка ко ла ле ло ма ме ми на не но ра ре ро са се та те то ва ве во".split()
ENDS = {"female": ("na", "lia"), "male": ("nus", "ron"), "first": ("ley", "vin"), "last": ("berg", "son")}
CYRILLIC_ENDS = {"female": ("на", "лия"), "male": ("нов", "рон"),
                 "first": ("лей", "вин"), "last": ("берг", "сон")}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: A text without any of these has no entity; most texts are done with that.
TRIGGER = rf"[@\d]|{PEM}|{JWT}|{'|'.join(PREFIXES)}|{PASSWORD}|{TITLE}\p{{Lu}}"
#: After so many attempts surrogates get a further letter, syllable or digit.
GROWTH = 2


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _let(x: Column, use) -> Column:
    """Binds a value, so that an expression which needs it several times holds it once."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def _draw(digest: Column, i: Column) -> Column:
    """A number of at least 0 for the i-th place."""
    pair = F.conv(F.substr(digest, F.pmod(i * 2, F.lit(62)) + 1, F.lit(2)), 16, 10).cast("int")
    return pair + F.floor(i / 31).cast("int") * 7 + i


def _pick(values: Column, k: Column) -> Column:
    return F.get(values, F.pmod(k, F.size(values)).cast("int"))


def _words(values) -> Column:
    return F.split(F.lit(" ".join(values)), " ")


def _shuffle(x: Column, digest: Column) -> Column:
    """Digits become digits and letters letters of the same case; hexadecimal values stay hexadecimal."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    hexa = F.when(x.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), 6).otherwise(26)

    def one(c: Column, i: Column, letters: Column) -> Column:
        pool = (F.when(c.rlike("[0-9]"), F.lit("0123456789")).when(c.rlike("[a-z]"), F.substr(F.lit(upper.lower()), F.lit(1), letters))
                .when(c.rlike("[A-Z]"), F.substr(F.lit(upper), F.lit(1), letters)))
        return _let(pool, lambda s: F.coalesce(F.substr(s, F.pmod(_draw(digest, i), F.length(s)) + 1, F.lit(1)), c))

    return _let(hexa, lambda n: F.array_join(F.transform(F.split(x, ""), lambda c, i: one(c, i, n)), ""))


def _tail(digest: Column, n: Column, values: Column) -> Column:
    """``n`` further letters, syllables or digits, drawn apart from the places of the form itself."""
    more = _let(F.sha2(digest, 256), lambda d: F.transform(F.sequence(F.lit(1), n), lambda k: _pick(values, _draw(d, k))))
    return F.when(n > 0, F.array_join(more, "")).otherwise("")


def _luhn(digits: Column) -> Column:
    """The check sum of digits whose last one is the check digit."""
    step = lambda d, i: F.when(i % 2 == 1, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d)
    numbers = F.transform(F.reverse(F.split(digits, "")), lambda c: c.cast("int"))
    return F.aggregate(F.transform(numbers, step), F.lit(0), lambda a, d: a + d) % 10


def _card(x: Column, shuffled: Column) -> Column:
    body = F.concat(F.substr(x, F.lit(1), F.lit(1)), F.substr(shuffled, F.lit(2), F.length(x) - 2))
    return _let(body, lambda b: F.concat(b, F.pmod(10 - _luhn(F.concat(b, F.lit("0"))), F.lit(10)).cast("string")))


def _iban(x: Column, shuffled: Column) -> Column:
    def checked(body: Column) -> Column:
        country = F.substr(x, F.lit(1), F.lit(2))
        numbers = F.transform(F.split(F.concat(body, country, F.lit("00")), ""), lambda c: F.coalesce(c.try_cast("int"), F.ascii(c) - 55))
        rest = F.aggregate(numbers, F.lit(0), lambda a, n: (a * F.when(n > 9, 100).otherwise(10) + n) % 97)
        return F.concat(country, F.lpad((98 - rest).cast("string"), 2, "0"), body)

    return _let(F.substr(shuffled, F.lit(5)), checked)


def _email(x: Column, shuffled: Column, tail: Column) -> Column:
    def joined(domain: Column) -> Column:
        inner = F.transform(F.slice(domain, F.lit(1), F.greatest(F.size(domain) - 2, F.lit(0))), lambda d: F.concat(d, F.lit(".")))
        return F.concat(F.substring_index(shuffled, "@", 1), tail, F.lit("@"), F.array_join(inner, ""))

    top = F.regexp_extract(x, r"\.(com|net|org)$", 1)
    return F.concat(_let(F.split(F.substring_index(shuffled, "@", -1), r"\."), joined), F.lit("example."), F.coalesce(F.nullif(top, F.lit("")), F.lit("com")))


def _groups(x: Column) -> Column:
    """An IPv6 address as its eight groups, whatever its spelling."""
    halves = F.split(F.lower(x), "::")
    left, right = (F.filter(F.split(F.coalesce(F.get(halves, F.lit(k)), F.lit("")), ":"), lambda g: g != "") for k in (0, 1))
    groups = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(8 - F.size(left) - F.size(right), F.lit(0))), right)
    return F.array_join(F.transform(groups, lambda g: F.regexp_replace(g, "^0+(?=.)", "")), ":")


def _ip(x: Column, shuffled: Column, digest: Column) -> Column:
    octets = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.when(k == 0, F.pmod(_draw(digest, k), F.lit(15)) + 240).otherwise(F.pmod(_draw(digest, k), F.lit(256))))
    long = F.concat(F.lit("2001:db8:"), F.regexp_replace(F.substr(digest, F.lit(1), F.lit(24)), "(.{4})(?!$)", "$1:"))
    return F.when(x.contains(":"), long).otherwise(F.array_join(octets.cast("array<string>"), "."))


def _name(kind: Column, x: Column, digest: Column, growth: Column) -> Column:
    """A name of the same gender and script; an initial stays an initial."""
    def ends(table: dict[str, tuple[str, ...]]) -> Column:
        chosen = F.lit(None).cast("string")
        for name, choice in table.items():
            chosen = F.when(kind == f"name_{name}", " ".join(choice)).otherwise(chosen)
        return chosen

    cyrillic = x.rlike(r"\p{IsCyrillic}")
    syllables = F.when(cyrillic, _words(CYRILLIC)).otherwise(_words(LATIN))
    stem = _let(syllables, lambda v: F.concat(
        F.array_join(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: _pick(v, _draw(digest, k))), ""), _tail(digest, growth, v)))
    end = _let(F.split(F.when(cyrillic, ends(CYRILLIC_ENDS)).otherwise(ends(ENDS)), " "), lambda v: _pick(v, _draw(digest, F.lit(5))))
    initial = F.concat(_pick(_words("ABCDEFGHIJKLMNOPRSTUVWZ"), _draw(digest, F.lit(7))), F.lit("."))
    return F.when(x.endswith("."), initial).otherwise(F.initcap(F.concat(stem, end)))


def _surrogate(kind: Column, x: Column, digest: Column, attempt: Column) -> Column:
    """The surrogate of a canonical form. Digits that grow beyond the form follow it behind a hyphen."""
    growth = F.floor(attempt / GROWTH).cast("int")
    letters = _tail(digest, growth, _words("abcdefghijklmnopqrstuvwxyz"))
    digits = _tail(digest, growth, _words("0123456789"))
    extension = F.when(growth > 0, F.concat(F.lit("-"), digits)).otherwise("")

    def by_kind(s: Column) -> Column:
        return (F.when(kind == "email", _email(x, s, letters)).when(kind == "ip", F.concat(_ip(x, s, digest), extension))
                .when(kind == "card", F.concat(_card(x, s), extension)).when(kind == "ssn", F.concat(F.lit("9"), F.substr(s, F.lit(2)), extension))
                .when(kind == "iban", _iban(x, F.concat(s, digits))).when(kind == "phone", F.concat(s, extension))
                .when(kind.startswith("name"), _name(kind, x, digest, growth))
                .when(kind == "key", F.concat(F.substr(x, F.lit(1), F.lit(4)), F.substr(s, F.lit(5)), letters)).otherwise(F.concat(s, letters)))

    return _let(_shuffle(x, digest), by_kind)


def _digest(key: str, kind: Column, x: Column, attempt: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), kind, attempt.cast("string"), x), 256)


def _entities(text: Column) -> Column:
    """value, kind, head (stays as it is) and parts: struct(kind, canonical, shown) of what is replaced, in order."""
    found = F.when(text.rlike(TRIGGER), F.regexp_extract_all(text, F.lit(ANY), F.lit(0)))
    whole = lambda p: f"^(?:{p})$"

    def typed(m: Column) -> Column:
        kind = F.lit("name")
        for name, pattern in reversed(list(PATTERNS.items())[:-1]):
            kind = F.when(m.rlike(whole(pattern)), name).otherwise(kind)
        return F.struct(m.alias("value"), kind.alias("kind"))

    def headed(e: Column) -> Column:
        head = (F.when(e.kind == "secret", F.regexp_extract(e.value, r"^[A-Za-z_\-]+[\"']?\s{0,3}[=:]\s{0,3}[\"']?", 0))
                .when(e.kind == "name", F.regexp_extract(e.value, r"^\S+ ", 0)).otherwise(""))
        return F.struct(e.value.alias("value"), e.kind.alias("kind"), head.alias("head"))

    def tailed(e: Column) -> Column:
        rest = F.substr(e.value, F.length(e.head) + 1)
        tail = F.when(e.kind == "secret", F.regexp_extract(rest, r"[.,;:!?)\]]+$", 0)).otherwise("")
        return F.struct(e.kind.alias("kind"), e.head.alias("head"), rest.alias("rest"), tail.alias("tail"))

    def shown(e: Column) -> Column:
        rest = F.substr(e.rest, F.lit(1), F.length(e.rest) - F.length(e.tail))
        return F.struct(e.kind.alias("kind"), e.head.alias("head"), e.tail.alias("tail"), rest.alias("rest"), _digits(rest).alias("digits"))

    def checked(e: Column) -> Column:
        kind = F.when((e.kind == "card") & (_luhn(e.digits) != 0), "number").otherwise(e.kind)
        canonical = (F.when(e.kind == "email", F.lower(e.rest)).when(e.kind.isin("card", "ssn"), e.digits)
                     .when(e.kind == "phone", F.substr(e.digits, F.greatest(F.length(e.digits) - 9, F.lit(1))))
                     .when((e.kind == "ip") & e.rest.contains(":"), _groups(e.rest))
                     .when(e.kind == "iban", F.regexp_replace(e.rest, " ", "")).otherwise(e.rest))
        return F.struct(kind.alias("kind"), e.head.alias("head"), e.tail.alias("tail"), e.rest.alias("rest"), canonical.alias("canonical"))

    def parted(e: Column) -> Column:
        first = F.when(e.head.rlike(FEMALE), "name_female").when(e.head.rlike(MALE), "name_male").otherwise("name_first")
        people = _let(F.split(e.rest, " "), lambda names: F.transform(names, lambda n, i: F.struct(
            F.when(i + 1 < F.size(names), first).otherwise(F.lit("name_last")).alias("kind"), F.initcap(n).alias("canonical"), n.alias("shown"))))
        single = F.array(F.struct(e.kind.alias("kind"), e.canonical.alias("canonical"), e.rest.alias("shown")))
        return F.struct(e.kind.alias("kind"), e.head.alias("head"), e.tail.alias("tail"), F.when(e.kind == "name", people).otherwise(single).alias("parts"))

    for step in (typed, headed, tailed, shown, checked, parted):
        found = F.transform(found, step)
    return F.coalesce(found, F.array().cast(
        "array<struct<kind:string,head:string,tail:string,parts:array<struct<kind:string,canonical:string,shown:string>>>>"))


def _render(part: Column) -> Column:
    """The surrogate (made) in the form in which the entity is shown."""
    made, extension = F.substring_index(part.made, "-", 1), F.regexp_extract(part.made, "-.*", 0)
    n = F.length(made)

    def filled(c: Column, i: Column) -> Column:  # digits from the right, so that a country code stays
        behind = F.length(_digits(F.substr(part.shown, i + 1)))
        return F.when(c.rlike("[0-9]") & (behind <= n), F.substr(made, n - behind + 1, F.lit(1))).otherwise(c)

    digits = F.concat(F.array_join(F.transform(F.split(part.shown, ""), filled), ""), extension)
    upper = (part.shown == F.upper(part.shown)) & (part.shown != F.lower(part.shown)) & (F.length(part.shown) > 1)
    return (F.when(part.kind == "number", part.shown).when(part.kind.isin("phone", "card", "ssn"), digits)
            .when((part.kind == "iban") & part.shown.contains(" "), F.regexp_replace(part.made, "(.{4})(?!$)", "$1 "))
            .when(part.kind.isin("email", "name_first", "name_female", "name_male", "name_last") & upper, F.upper(part.made)).otherwise(part.made))


def surrogates(found: DataFrame, key: str) -> DataFrame:
    """(kind, canonical, attempt, made) for the distinct entities of ``found``, a table with kind and canonical.

    Within a kind no two entities share a surrogate, and no surrogate is an entity. Rounds touch colliding rows only;
    they end, since the space of surrogates grows by a factor every few attempts.
    """
    def made(rows: DataFrame) -> DataFrame:
        digest = _digest(key, F.col("kind"), F.col("canonical"), F.col("attempt"))
        return rows.select("kind", "canonical", "attempt", _surrogate(F.col("kind"), F.col("canonical"), digest, F.col("attempt")).alias("made"))

    state = cut(made(found.select("kind", "canonical").distinct().withColumn("attempt", F.lit(0))), "surrogates")
    real = state.select("kind", F.col("canonical").alias("made"), F.lit(True).alias("real"))
    initials = F.col("made").rlike(r"^.\.$")  # one letter can't tell many people apart; initials may coincide
    while True:
        rank = F.row_number().over(Window.partitionBy("kind", "made").orderBy("attempt", "canonical"))
        judged = state.withColumn("rank", rank).join(real, ["kind", "made"], "left")
        judged = cut(judged.withColumn("bad", ~initials & ((F.col("rank") > 1) | F.col("real").isNotNull())), "judged")
        if judged.filter("bad").isEmpty():
            return state
        again = made(judged.filter("bad").withColumn("attempt", F.col("attempt") + 1))
        state = cut(judged.filter("not bad").select("kind", "canonical", "attempt", "made").unionAll(again), "surrogates")


def replace_entities(docs: DataFrame, key: str = "corpus", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows and columns of ``docs`` with every detected entity in the text replaced, and ``replaced``: their kinds.

    A text without entities stays as it is, null stays null and has no kinds. Ids play no part, so null and repeated
    ids are rows like others, and equal texts get equal results. Other columns stay, whatever their names, unless
    one is called ``replaced``: that one is dropped. An empty table gives no rows. 13 to 19 digits without a valid
    check digit are no card and stay. Names are those behind a title; later mentions of their parts change too.
    """
    names = [c for c in docs.columns if c != "replaced"]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("whole_row"), F.col(f"`{text_col}`").cast("string").alias("t"))
    seen = rows.select(F.explode(_entities(F.col("t"))).alias("e")).select(F.explode("e.parts").alias("p")).select("p.kind", "p.canonical")
    state = surrogates(seen.filter("kind <> 'number'"), key)
    later = cut(state.filter("attempt > 0").select("kind", "canonical", "attempt"), "later")
    rows = rows.withColumn("found", _entities(F.col("t")))
    none = F.array().cast("array<struct<kind:string,canonical:string,attempt:int>>")
    if later.isEmpty():
        rows = rows.withColumn("later", none)
    else:  # texts that hold such an entity get their attempts by the print of the text
        part = F.explode(F.flatten(F.transform("found", lambda e: e.parts))).alias("p")
        held = rows.filter(F.size("found") > 0).select(F.sha2("t", 256).alias("print"), part).select("print", "p.kind", "p.canonical")
        held = held.distinct().join(later, ["kind", "canonical"]).groupBy("print")
        held = cut(held.agg(F.collect_list(F.struct("kind", "canonical", "attempt")).alias("their")), "held")
        rows = rows.withColumn("print", F.when(F.size("found") > 0, F.sha2("t", 256))).join(held, "print", "left")
        rows = rows.withColumn("later", F.coalesce("their", none))

    def keyed(e: Column) -> Column:
        def one(p: Column) -> Column:
            tries = F.filter(F.col("later"), lambda o: (o.kind == p.kind) & (o.canonical == p.canonical))
            attempt = F.coalesce(F.get(tries, F.lit(0)).attempt, F.lit(0))
            return F.struct(p.kind.alias("kind"), p.canonical.alias("canonical"), p.shown.alias("shown"),
                            attempt.alias("attempt"), _digest(key, p.kind, p.canonical, attempt).alias("digest"))
        return F.struct(e.kind.alias("kind"), e.head.alias("head"), e.tail.alias("tail"), F.transform(e.parts, one).alias("parts"))

    def made(e: Column) -> Column:
        parts = F.transform(e.parts, lambda p: F.struct(
            p.kind.alias("kind"), p.shown.alias("shown"), _surrogate(p.kind, p.canonical, p.digest, p.attempt).alias("made")))
        parts = F.transform(parts, lambda p: F.struct(p.kind.alias("kind"), p.shown.alias("shown"), _render(p).alias("made")))
        return F.struct(e.kind.alias("kind"), e.head.alias("head"), e.tail.alias("tail"), parts.alias("parts"))

    done = rows.withColumn("done", F.transform(F.transform("found", keyed), made))
    texts = F.transform("done", lambda e: F.concat(e.head, F.array_join(F.transform(e.parts, lambda p: p.made), " "), e.tail))
    text = F.array_join(F.zip_with(F.split("t", ANY), texts, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    people = F.array_distinct(F.flatten(F.transform(F.filter("done", lambda e: e.kind == "name"), lambda e: F.filter(
        e.parts, lambda p: F.length(p.shown) > 2))))
    mention = lambda p: F.concat(F.lit(r"(?<![\p{L}\p{N}])"), p.shown, F.lit(r"(?![\p{L}\p{N}])"))
    text = F.aggregate(people, text, lambda t, p: F.regexp_replace(t, mention(p), p.made))
    kinds = F.filter(F.transform("done", lambda e: e.kind), lambda k: k != "number")
    out = done.select("whole_row", F.when(F.size("done") > 0, text).otherwise(F.col("t")).alias("t"), kinds.alias("kinds"))
    return out.select(*[F.col("t").alias(c) if c == text_col else F.col(f"whole_row.`{c}`").alias(c) for c in names], F.col("kinds").alias("replaced"))
