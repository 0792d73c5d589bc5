"""Personal data: every detected entity gets a keyed surrogate of its own type and format.

All steps are DataFrame functions. Entities: e-mail addresses, IPv4 and IPv6 addresses, IBANs, card-like numbers, phone
and social-security numbers, secrets (long hexadecimal strings, access keys) and person names. One pattern finds
them in one pass over each text.

* Format: digits go into the places of digits, separators stay, upper case stays upper case. A number of 13 to 19 digits is a card
  only if its first digit is an issuer's (2 to 6) and its last one is right; its surrogate keeps both; an IBAN keeps its
  country and gets right check digits; an address keeps its top-level domain or its groups; a phone number keeps its country code.
* Names stand after a title, after a known given name, or after words that announce a name. A given name becomes another one
  of its gender and script, by a keyed order of the list; a family name becomes syllables of its script and keeps hyphens, `O'` and a
  gendered ending; titles and particles stay. A name runs over all capitalised words that follow; those between given
  names and the last one change like family names. All parts change by themselves, so `Frau Lang` and `Anna Lang` still share a name.
* Coreference: a surrogate depends on the key, the type and the entity's canonical form (lower case,
  digits only), so an entity has one surrogate in all documents and formats.
* Distinctness: numbers and addresses pass keyed permutations; all surrogates are compared with each
  other and with all real entities of their type, and those that collide are drawn again until none does.

Null texts stay null, empty ones empty, with 0 entities; texts of any length are read whole. Repeated rows get equal results. An
empty table gives an empty one. Other columns stay as they are whatever their names, but for older ones named n_entities or
entity_types, which replace() renews.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteledger.llm.shared import cut

# fixed values: given names by script and gender, and titles
GIVEN = {
    ("latin", "f"): "Anna Maria Emma Julia Laura Clara Elena Lucia Sophie Charlotte Hannah Camille Carmen Isabel Greta Ingrid Amelia Olivia Margaret Elizabeth Katharina Francesca Mathilde Valentina".split(),
    ("latin", "m"): "Peter Thomas Michael Daniel Martin Robert William James Henry Oliver Lukas Felix Jürgen Wolfgang Pierre Antoine Mathieu Carlos Miguel Alejandro Fernando Giovanni Lorenzo Christopher".split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана Екатерина Юлия Дарья Вера".split(),
    ("cyrillic", "m"): "Иван Пётр Сергей Алексей Дмитрий Николай Андрей Михаил Владимир Павел Егор Борис".split(),
}
TITLES = "Mr Mrs Ms Miss Dr Prof Herr Frau Monsieur Madame Mme Señor Señora Sr Sra Господин Госпожа".split()
# fixed values: small words inside names, and words that announce one
PARTICLES = "van von der den de da di del la le du bin al".split()
CUES = ["name is ", "Name ist ", "heiße ", "m'appelle ", "me llamo ", "nombre es ", "меня зовут ", "Меня зовут ", "name: ", "Name: "]
# fixed values: letters of a surrogate family name
ONSETS = {"latin": "b d f g k l m n p r s t v br gr st".split(), "cyrillic": "б д ф г к л м н п р с т в бр гр ст".split()}
VOWELS = {"latin": "a e i o".split(), "cyrillic": "а е и о".split()}
#: Gendered endings of family names, the longest first; they stay.
ENDINGS = "ская|ский|ова|ева|ина|ов|ев|ин"

_EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@(?:[\p{L}\p{N}-]{1,63}\.){1,6}[A-Za-z]{2,24}(?![A-Za-z])"
_SECRET = r"(?<![\p{L}\p{N}])(?:[0-9a-fA-F]{32,}+|AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36,}+|sk-[0-9A-Za-z_-]{20,}+)(?![\p{L}\p{N}])"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_IP = rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?\d)"
_IP6 = r"(?<![\p{L}\p{N}:.])(?=[0-9A-Fa-f:]*\d)(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\p{L}\p{N}:])"
_IBAN = r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![\p{L}\p{N}])"
_CARD = r"(?<![\d+])\d{13,19}(?!\d)|(?<!\d)\d{4}([ -])\d{4}\g1\d{4}\g1\d{4}(?!\d)"
_PHONE = r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\d(])(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)"
_SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
_CAP = r"(?:[OD]['’]|Mc)?\p{Lu}\p{Ll}+(?:-\p{Lu}\p{Ll}+)*"
_SHOUT = r"(?:[OD]['’])?\p{Lu}{2,}(?:-\p{Lu}{2,})*"
_PART = f"(?:(?:{'|'.join(PARTICLES)}) ){{0,2}}"
_TITLE = rf"(?:{'|'.join(TITLES)})\.? "
_NAME = rf"(?<!\p{{L}})(?:(?:{_TITLE})?(?:{'|'.join(n for names in GIVEN.values() for n in names)})(?: {_PART}{_CAP})+|{_TITLE}{_PART}(?:{_CAP}|{_SHOUT}(?!\p{{L}}))(?: {_PART}(?:{_CAP}|{_SHOUT}(?!\p{{L}})))*|(?<={'|'.join(CUES)}){_CAP}(?: {_PART}{_CAP})+)(?!\p{{L}})"
#: One pattern for all entities, so that a place in a text belongs to one entity; earlier kinds win.
PATTERN = "|".join([_EMAIL, _SECRET, _IP, _IP6, _SSN, _IBAN, _CARD.replace(r"\g1", r"\1"), _PHONE, _NAME])
SPECIAL = [r"^(?:AKIA|gh[pousr]_|sk-)"]
#: Put around entities by the one pass; texts that hold it themselves take a pass for the entities and one for the gaps.
FENCE = "￿"


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


#: What the pattern finds but isn't an entity.
NONE = "none"


def is_card(digits: Column) -> Column:
    """Whether the number begins as cards do and ends with its Luhn digit."""
    return digits.rlike("^[2-6]") & (luhn(F.substring(digits, F.lit(1), F.length(digits) - 1)) == F.substring(digits, F.length(digits), F.lit(1)).cast("int"))


def kind(m: Column) -> Column:
    """The type of what the pattern found; NONE for numbers that are no cards."""
    digits = F.regexp_replace(m, r"\D", "")
    return (
        F.when(m.contains("@"), "email").when(m.rlike(_IP) & ~m.rlike("[^0-9.]"), "ip").when(m.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn").when(m.startswith("+"), "phone")
        .when(m.contains(":"), "ip6").when(m.rlike(r"^[0-9a-fA-F]{32,}$"), "secret").when(m.rlike(SPECIAL[0]), "key").when(m.rlike(r"^[A-Z]{2}\d{2}[0-9A-Z ]+$"), "iban").when(m.rlike(r"^[\d -]+$") & (F.length(digits) >= 13), F.when(is_card(digits), "card").otherwise(NONE)).when(m.rlike(r"^[\d() .-]+$"), "phone").otherwise("name")
    )


def number(hash_: Column, digits: int) -> Column:
    return F.conv(F.substring(hash_, 1, digits), 16, 10).cast("long")


def permuted(digits: Column, seed: Column) -> Column:
    """A keyed permutation of the strings of as many digits: a Feistel network over the two halves."""

    def power(n: Column) -> Column:
        return F.pow(F.lit(10.0), n).cast("long")

    def round_(state: Column, i: Column) -> Column:
        f = number(F.sha2(F.concat_ws("|", seed, i.cast("string"), F.length(digits).cast("string"), state["b"]), 256), 14)
        total = F.pmod(state["a"].cast("long") + F.pmod(f, power(F.length(state["a"]))), power(F.length(state["a"])))
        return F.struct(state["b"].alias("a"), F.lpad(total.cast("string"), F.length(state["a"]), F.lit("0")).alias("b"))

    half = F.floor(F.length(digits) / 2).cast("int")
    start = F.struct(F.substring(digits, F.lit(1), half).alias("a"), F.substring(digits, half + 1, F.length(digits)).alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(6)), start, round_, lambda s: F.concat(s["a"], s["b"]))


def luhn(body: Column) -> Column:
    """The digit that makes body valid with it at the end."""
    each = F.transform(F.reverse(F.split(body, "")), lambda c, i: c.cast("int") * F.when(i % 2 == 0, 2).otherwise(1))
    total = F.aggregate(each, F.lit(0), lambda acc, d: acc + F.when(d > 9, d - 9).otherwise(d))
    return F.pmod(10 - F.pmod(total, F.lit(10)), F.lit(10))


def alike(text: Column, seed: Column) -> Column:
    """text with each letter and digit replaced by a keyed one of its class and script."""
    # fixed values: the alphabets
    latin, cyrillic = "abcdefghijklmnopqrstuvwxyz", "абвгдежзиклмнопрстуфхцчшщыэюя"

    def one(h: Column):
        def of(c: Column, i: Column) -> Column:
            v = F.conv(F.substring(h, F.pmod(i, F.lit(64)) * 2 + 1, F.lit(2)), 16, 10).cast("int")
            low = F.when(c.rlike(r"\p{IsCyrillic}"), F.substring(F.lit(cyrillic), F.pmod(v, F.lit(len(cyrillic))) + 1, F.lit(1))).otherwise(F.substring(F.lit(latin), F.pmod(v, F.lit(26)) + 1, F.lit(1)))
            return F.when(c.rlike(r"\p{N}"), F.pmod(v, F.lit(10)).cast("string")).when(c.rlike(r"\p{Lu}"), F.upper(low)).when(c.rlike(r"\p{L}"), low).otherwise(c)

        return F.array_join(F.transform(F.split(text, ""), of), "")

    return let(F.sha2(seed, 512), one)


def family(name: Column, salt: Column) -> Column:
    """Each part between hyphens becomes four syllables of its script, with its gendered ending; `o'` stays."""

    def built(part: Column, h: Column) -> Column:
        def syllables(script: str) -> Column:
            pick = lambda items, k: F.element_at(F.array(*map(F.lit, items)), F.pmod(F.conv(F.substring(h, 2 * k + 1, 2), 16, 10).cast("int"), F.lit(len(items))) + 1)
            return F.concat(*[pick(kind_[script], 2 * k + j) for k in range(4) for j, kind_ in enumerate((ONSETS, VOWELS))])

        body = F.when(part.rlike(r"\p{IsCyrillic}"), syllables("cyrillic")).otherwise(syllables("latin"))
        return F.concat(body, F.regexp_extract(part, f"({ENDINGS})-?$", 1), F.regexp_extract(part, "-$", 0))

    def one(part: Column) -> Column:
        new = let(F.sha2(F.concat_ws("|", salt, F.regexp_replace(part, "-$", "")), 256), lambda h: built(part, h))
        return F.when(part.rlike("^[od]['’]$"), part).otherwise(new)

    return F.array_join(F.transform(F.split(name, "(?<=['’-])"), one), "")


def shaped(new: Column, old: Column) -> Column:
    """new in the capitals of old."""
    parts = F.transform(F.split(new, "(?<=['’-])"), F.initcap)
    return F.when((F.length(old) > 1) & (old == F.upper(old)), F.upper(new)).otherwise(F.array_join(parts, ""))


def iban(canon: Column, seed: Column) -> Column:
    """Another account of the same country, with right check digits."""
    # fixed values: a letter counts as two digits from 10 on, the remainder is taken of 97
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    rest = lambda text: F.aggregate(F.split(text, ""), F.lit(0), lambda r, c: F.pmod(r * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c), F.lit(97)))
    country = F.substring(canon, F.lit(1), F.lit(2))
    body = alike(F.substring(canon, F.lit(5), F.length(canon)), seed)
    return let(body, lambda b: F.concat(country, F.lpad((98 - rest(F.concat(b, country, F.lit("00")))).cast("string"), 2, "0"), b))


def surrogate(type_: Column, canon: Column, key: str, nonce: int) -> Column:
    """The canonical form of an entity's surrogate."""
    salt = f"{key}|{nonce}"

    def seed(what: Column) -> Column:
        return F.concat_ws("|", F.lit(salt), type_, what)

    def phone() -> Column:
        keep = F.when(F.length(canon) > 10, F.length(canon) - 10).otherwise(0)
        return F.concat(F.substring(canon, F.lit(1), keep), permuted(F.substring(canon, keep + 1, F.length(canon)), F.concat_ws("|", F.lit(salt), type_)))

    def card() -> Column:
        first, inner = F.substring(canon, F.lit(1), F.lit(1)), F.substring(canon, F.lit(2), F.length(canon) - 2)
        return let(F.concat(first, permuted(inner, F.concat_ws("|", F.lit(salt), type_))), lambda new: F.concat(new, luhn(new).cast("string")))

    def ip() -> Column:
        part = F.transform(F.split(canon, r"\."), lambda x: x.cast("long"))

        def round_(s: Column, i: Column) -> Column:
            f = number(F.sha2(F.concat_ws("|", F.lit(salt), type_, i.cast("string"), s["b"].cast("string")), 256), 8)
            return F.struct(s["b"].alias("a"), F.pmod(s["a"] + f, F.lit(65536)).alias("b"))

        done = lambda s: F.concat_ws(".", *[x.cast("string") for x in (F.floor(s["a"] / 256), F.pmod(s["a"], F.lit(256)), F.floor(s["b"] / 256), F.pmod(s["b"], F.lit(256)))])
        return let(part, lambda p: F.aggregate(F.sequence(F.lit(1), F.lit(6)), F.struct((p[0] * 256 + p[1]).alias("a"), (p[2] * 256 + p[3]).alias("b")), round_, done))

    def email() -> Column:
        local, host = F.substring_index(canon, "@", 1), F.regexp_extract(canon, r"@(.*)\.[^.]*$", 1)
        return F.concat(alike(local, seed(canon)), F.lit("@"), alike(host, seed(host)), F.lit("."), F.substring_index(canon, ".", -1))

    def ip6() -> Column:
        groups = lambda h: F.array_join(F.transform(F.split(canon, ""), lambda c, i: F.when(c == ":", c).otherwise(F.substring(h, i + 1, F.lit(1)))), "")
        return let(F.sha2(seed(canon), 512), groups)

    # blocks of 128 digits, each after the first from the first and its number
    blocks = lambda h: F.concat(h, F.array_join(F.transform(F.when(F.length(canon) > 128, F.sequence(F.lit(1), F.floor((F.length(canon) - 1) / 128).cast("int"))).otherwise(F.array().cast("array<int>")), lambda i: F.sha2(F.concat_ws("|", h, i.cast("string")), 512)), ""))
    hex_ = F.substring(let(F.sha2(seed(canon), 512), blocks), F.lit(1), F.length(canon))
    prefix = F.regexp_extract(canon, SPECIAL[0], 0)
    key_ = F.concat(prefix, alike(F.substring(canon, F.length(prefix) + 1, F.length(canon)), seed(canon)))
    return F.when(type_ == "email", email()).when(type_ == "ip", ip()).when(type_ == "card", card()).when(type_.isin("phone", "ssn"), phone()).when(type_ == "secret", hex_).when(type_ == "key", key_).when(type_ == "iban", iban(canon, seed(canon))).when(type_ == "ip6", ip6()).otherwise(family(canon, F.concat_ws("|", F.lit(salt), type_)))


def canonical(m: Column, type_: Column) -> Column:
    """Of a name, only the family name: given names need no check."""
    return F.when(type_.isin("card", "phone", "ssn"), F.regexp_replace(m, r"\D", "")).when(type_ == "iban", F.replace(m, F.lit(" "), F.lit(""))).when(type_.isin("ip", "key"), m).when(type_ == "name", F.lower(F.substring_index(m, " ", -1))).otherwise(F.lower(m))


def poured(m: Column, digits: Column, places: str = "[0-9]") -> Column:
    """m with its digits (or other places) replaced in turn."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("k"))

    def step(s: Column, c: Column) -> Column:
        digit = c.rlike(places)
        return F.struct(F.concat(s["out"], F.when(digit, F.substring(digits, s["k"], F.lit(1))).otherwise(c)).alias("out"), (s["k"] + F.when(digit, 1).otherwise(0)).alias("k"))

    return F.aggregate(F.split(m, ""), start, step, lambda s: s["out"])


def other_given(name: Column, key: str) -> Column:
    """The given name that follows in the keyed order of its list; titles and unknown words stay."""
    out = name
    for names in GIVEN.values():
        ring = sorted(names, key=lambda n: hashlib.sha256(f"{key}|given|{n}".encode()).digest())
        table = F.create_map(*[F.lit(x) for k, n in enumerate(ring) for x in (n, ring[(k + 1) % len(ring)])])
        out = F.when(F.array_contains(F.array(*map(F.lit, names)), name), table[name]).otherwise(out)
    return out


def rendered(m: Column, type_: Column, new: Column, key: str) -> Column:
    """A canonical surrogate in the form of the text's own spelling."""
    words = F.split(m, " ")
    known = F.array(*[F.lit(x) for x in [*TITLES, *[f"{t}." for t in TITLES], *PARTICLES, *[n for names in GIVEN.values() for n in names]]])
    # any other word before the last may be a part of the family name
    middle = lambda w: shaped(family(F.lower(w), F.lit(f"{key}|0|name")), w)
    front = F.transform(F.slice(words, F.lit(1), F.size(words) - 1), lambda w: F.when(F.array_contains(known, w), other_given(w, key)).otherwise(middle(w)))
    # a secret of both cases keeps the places of its capitals
    mixed = F.array_join(F.transform(F.split(m, ""), lambda c, i: F.when(c.rlike("[A-Z]"), F.upper(F.substring(new, i + 1, F.lit(1)))).otherwise(F.substring(new, i + 1, F.lit(1)))), "")
    shout = (m == F.upper(m)) & (m != F.lower(m))
    return (
        F.when(type_ == "name", F.array_join(F.concat(front, F.array(shaped(new, F.substring_index(m, " ", -1)))), " ")).when(type_.isin("card", "phone", "ssn"), poured(m, new)).when(type_ == "iban", poured(m, new, "[0-9A-Z]"))
        .when(type_.isin("email", "secret", "ip6") & shout, F.upper(new)).when(type_.isin("secret", "ip6") & m.rlike("[A-F]"), mixed).otherwise(new)
    )


def fenced(text: Column) -> Column:
    """The text's parts: gaps and entities in turn, a gap first and last."""
    slow = F.flatten(F.zip_with(F.split(text, PATTERN, -1), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)), lambda g, m: F.when(m.isNull(), F.array(g)).otherwise(F.array(g, m))))
    fast = F.split(F.regexp_replace(text, PATTERN, f"{FENCE}$0{FENCE}"), FENCE, -1)
    return F.when(text.contains(FENCE), slow).otherwise(fast)


def entities(matches: DataFrame) -> DataFrame:
    """Each distinct entity of the column m: type, canon."""
    typed = matches.select("m", kind(F.col("m")).alias("type"))
    return typed.where(F.col("type") != NONE).select("type", canonical(F.col("m"), F.col("type")).alias("canon")).distinct()


def redrawn(found: DataFrame, key: str, rounds: int = 50) -> DataFrame | None:
    """type, canon, new of the entities whose first surrogate is another entity or another's surrogate; None if there are none."""
    settled = None
    open_ = found.select("type", "canon")
    for nonce in range(rounds):
        drawn = open_.withColumn("new", surrogate(F.col("type"), F.col("canon"), key, nonce))
        drawn = cut(drawn, "surrogates")
        taken = found.select("type", F.col("canon").alias("new"), F.lit(True).alias("real")).unionByName(settled.select("type", "new", F.lit(True).alias("real"))) if settled is not None else found.select("type", F.col("canon").alias("new"), F.lit(True).alias("real"))
        first = drawn.groupBy("type", "new").agg(F.min("canon").alias("first"))
        state = drawn.join(first, ["type", "new"]).join(taken.distinct(), ["type", "new"], "left")
        state = cut(state.select("type", "canon", "new", ((F.col("canon") == F.col("first")) & F.col("real").isNull()).alias("good")), "surrogate-check")
        good = state.where("good").select("type", "canon", "new")
        settled = good.withColumn("nonce", F.lit(nonce)) if settled is None else settled.unionByName(good.withColumn("nonce", F.lit(nonce)))
        open_ = state.where("not good").select("type", "canon")
        if open_.isEmpty():
            return None if nonce == 0 else cut(settled.where("nonce > 0").select("type", "canon", "new"), "redrawn")
    raise ValueError(f"no distinct surrogates after {rounds} draws")


def replace(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """docs with the text rewritten, and two more columns: n_entities, entity_types (sorted, distinct)."""
    out = rewritten(docs, key, text_col)
    kept = [F.col("text").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns if c not in ("n_entities", "entity_types")]
    return out.select(*kept, "n_entities", "entity_types")


def rewritten(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """row (a struct of the other columns), text (rewritten), n_entities, entity_types."""
    # written once, so that the pattern runs over each text once
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col] or [F.lit(True).alias("none")]
    rows = cut(docs.select(F.struct(*others).alias("row"), fenced(F.col(f"`{text_col}`")).alias("parts")), "parts")
    rows = rows.withColumn("matches", F.filter("parts", lambda x, i: (i % 2 == 1) & (kind(x) != NONE)))
    found = cut(entities(rows.select(F.explode("matches").alias("m"))), "entities")
    again = redrawn(found, key)
    if again is not None:
        # few rows: only texts that hold an entity drawn again; Spark broadcasts them if they are small
        hit = rows.select("matches").distinct().select("matches", F.explode("matches").alias("m")).select("matches", kind(F.col("m")).alias("type"), F.col("m"))
        hit = hit.select("matches", "type", canonical(F.col("m"), F.col("type")).alias("canon")).distinct().join(again, ["type", "canon"])
        known = hit.groupBy("matches").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "type", "canon"), "new"))).alias("known"))
        rows = rows.join(cut(known, "known"), "matches", "left")

    def one(m: Column) -> Column:
        def typed(t: Column) -> Column:
            def drawn(canon: Column) -> Column:
                first = surrogate(t, canon, key, 0)
                return F.coalesce(F.col("known")[F.concat_ws("|", t, canon)], first) if again is not None else first

            # bound one by one: written out in every place, they fill the driver's memory with expressions
            return let(let(canonical(m, t), drawn), lambda new: rendered(m, t, new, key))

        return let(kind(m), lambda t: F.when(t == NONE, m).otherwise(typed(t)))

    text = F.array_join(F.transform("parts", lambda x, i: F.when(i % 2 == 1, one(x)).otherwise(x)), "")
    types = F.array_sort(F.array_distinct(F.transform(F.coalesce("matches", F.array().cast("array<string>")), kind)))
    return rows.select("row", text.alias("text"), F.coalesce(F.greatest(F.size("matches"), F.lit(0)), F.lit(0)).cast("long").alias("n_entities"), types.alias("entity_types"))
