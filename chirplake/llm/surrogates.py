"""PII: detected entities are replaced by keyed surrogates of the same kind, on DataFrame expressions only.

A text is split by one pattern of all kinds into its gaps and its entities. Each distinct entity
gets one surrogate for the whole corpus, derived from a secret key, so that mentions of one
entity stay mentions of one (coreference): addresses are compared without their letters' case, numbers
without blanks and signs. Candidates that two entities share, or that occur as a
real entity, are drawn again until none is left (distinctness), in the end in a longer form. Surrogates keep kind and format:
letters become letters of the same case and script, digits digits, in the places where the mention has them; an e-mail address keeps its
top-level domain and one domain always becomes the same other one; a card number keeps its first digit and its
check sum; an IP address stays one; a telephone number keeps its country code; a name after a title keeps the title,
the gender that the title shows, the script, and vowels and consonants in their places. Other
mentions of such a name in the same text, whole or its first or last word, get the same surrogate or that word of it. What
shows the kind of a secret (`ghp_`, `sk-`, `Bearer`, a keyword) stays in front of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chirplake.llm.store import discard, frozen, joined

#: Titles before names: those that show a man, a woman, and neither.
MEN = r"Mr|Sir|Lord|Herrn?|Monsieur|Señor|Sr|Г-н|Господин"
LADIES = r"Mrs|Ms|Miss|Lady|Dame|Frau|Fräulein|Mme|Mlle|Madame|Mademoiselle|Señora|Señorita|Sra|Srta|Dra|Г-жа|Госпожа"
ANY_TITLE = rf"{MEN}|{LADIES}|Mx|Dr|Doctor|Doktor|Prof|Professor|Rev|Доктор|Профессор"
FIRST = "".join(sorted({t[0] for t in ANY_TITLE.split("|")}))
#: One word of a name (O'Brien, Jean-Luc, McDonald, an initial) and a whole name, with particles inside.
_WORD = r"(?:\p{Lu}['’])?\p{Lu}\p{Ll}+(?:['’\-]?\p{Lu}\p{Ll}+)*"
_WESTERN = rf"(?:\p{{Lu}}\. ?){{0,4}}{_WORD}(?:(?: (?:von|van|zu|der|den|de|la|le|du|di|da|del|dos)){{0,3}}(?: \p{{Lu}}\.){{0,3}} {_WORD}){{0,4}}"
#: A name in a script without case, which need not end at a blank.
_EASTERN = r"\p{IsHan}{2,4}(?!\p{IsHan})|\p{IsHan}{2,3}|[\p{IsHiragana}\p{IsKatakana}]{2,8}|\p{IsHangul}{2,4}"
NAME = rf"(?:{_WESTERN}|{_EASTERN})"

#: A name in small letters, looked for behind an abbreviated form of address, and small words that stand there too.
LOWER = r"\p{Ll}{3,}(?!\p{L})"
SMALL = "and|or|the|und|oder|der|die|das|et|ou|les|del|los|las|was|has|had|who|said"

#: What stands before a secret, and is matched with it, as titles are with names.
KEYWORD = r"""(?=[PpSsTtAa])(?i:password|passwd|passphrase|pwd|secret|token|api[_\-]?key)["']?(?: = |=|: ?| : )["']?"""
#: A secret behind a keyword: all between quotes, else up to a blank or a sign that separates, without a sentence's stop.
_VALUE = r"""(?:(?<=["'])[^"'\s]{8,}(?=["'])|[A-Za-z0-9+/_\-@$#!%*^][^\s"'<>,;&]{6,}[^\s"'<>,;&.:!?)\]}])"""
#: How tokens of public formats begin; each has a digit somewhere.
_HEAD = r"gh[a-z]_|github_pat_|sk-|xox[a-z]-|eyJ"
_TOKEN = r"(?:gh[a-z]_|github_pat_|sk-|xox[a-z]-)(?=[A-Za-z_\-]*[0-9])[A-Za-z0-9_\-]{16,}|eyJ[A-Za-z0-9_\-]{6,}\.[A-Za-z0-9_\-]{6,}\.[A-Za-z0-9_\-]{6,}|Bearer (?=[A-Za-z._~+/\-]*[0-9])[A-Za-z0-9._~+/\-]{15,}[A-Za-z0-9_~+/\-]"
#: User and password in an address with a scheme, or before a host without a dot (with one it is an e-mail address's form).
_LOGIN = r"""(?<=://)[^\s:/@"']{1,64}:[^\s/@"']{3,}(?=@)|(?<![\w.%+\-:/])[A-Za-z][\w.\-]*+:[^\s:/@"']{6,}+(?=@[A-Za-z0-9\-]++(?!\.[A-Za-z0-9]))"""
PREFIX = rf"""^(?:(?:(?:{ANY_TITLE})\.? )+|(?:{KEYWORD}(?=[^\s"']{{8,}}$))?(?:Bearer )?(?:{_HEAD})?)"""

#: Characters of addresses, of the scripts that surrogates have letters of.
_LETTERS = r"\p{IsLatin}\p{IsCyrillic}\p{IsGreek}"

#: Kinds in the order in which they are tried, as Java patterns.
PATTERNS = {
    "email": rf"(?<![{_LETTERS}0-9._%+\-])[{_LETTERS}0-9._%+\-]++@(?:[{_LETTERS}0-9\-]+\.)+(?:[A-Za-z]{{2,}}|[{_LETTERS}]{{2,}})",
    "secret": rf"""\bAKIA[0-9A-Z]{{16}}\b|(?<![A-Za-z0-9]){KEYWORD}{_VALUE}|\b(?:{_TOKEN})|{_LOGIN}|\b(?=[A-Fa-f]*[0-9])(?:[0-9a-f]{{32,128}}|[0-9A-F]{{32,128}})\b""",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "card": r"(?<![\w.])[0-9]{4}(?<gap>[ \-]?)[0-9]{4}\k<gap>[0-9]{4}\k<gap>[0-9]{1,7}(?!\w)|(?<![\w.])3[47][0-9]{2}[ \-]?[0-9]{6}[ \-]?[0-9]{5}(?!\w)",
    "phone": r"\+[0-9]{1,3}[ .\-]?\(?[0-9]{1,4}\)?(?:[ .\-]?[0-9]{2,4}){2,4}(?!\w)|(?<!\w)\([0-9]{3}\) ?[0-9]{3}[ .\-][0-9]{4}(?!\w)|(?<![\w.\-])[0-9]{3}[ .\-][0-9]{3}[ .\-][0-9]{4}(?![\w\-])|(?<!\w)\(0[0-9]{1,4}\) ?[0-9]{3,4}[ .\-]?[0-9]{3,4}(?!\w)|(?<![\w.\-])0[0-9]{2,4}(?:[ /\-][0-9]{5,8}|[ \-][0-9]{3,4}[ \-][0-9]{3,4})(?![\w\-])",
    "national": r"(?<![\w.\-])[0-9]{3}(?<dash>[ \-])[0-9]{2}\k<dash>[0-9]{4}(?![\w\-])",
    "mac": r"(?<![\w:\-])[0-9A-Fa-f]{2}(?<colon>[:\-])(?:[0-9A-Fa-f]{2}\k<colon>){4}[0-9A-Fa-f]{2}(?![\w:\-])",
    "ip": r"(?<![\w.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?!\w|\.[0-9])",
    "ipv6": r"(?<![\w:.])(?=[0-9A-Fa-f:]*[0-9])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\w:])",
    "name": rf"(?=[{FIRST}])(?<![\p{{L}}\-])(?:(?:(?:{ANY_TITLE})\.? )+{NAME}|(?:Mr|Mrs|Ms|Mx)\. (?!(?:{SMALL})\b){LOWER})",
}
PATTERN = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Kinds that have a digit or an at sign, and titles as they stand before names; most texts have neither, nor a keyword.
NUMBERED = "|".join(f"(?:{PATTERNS[k]})" for k in PATTERNS if k != "name")
TITLE_HINT = rf"(?=[{FIRST}])(?:{ANY_TITLE})\.? "
KEYWORD_HINT = "(?=[PpSsTtAa])(?i:passw|passp|pwd|secret|token|api)|eyJ"
#: Alphabets of which a character is replaced within its own; other letters become Latin ones, anything else stays.
ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ", "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ")
#: In names vowels become vowels and consonants consonants: letters of one kind, and those that they may become.
SOUNDS = (
    ("aeiouàáâãäåèéêëìíîïòóôõöùúûüœ", "aeiou"),
    ("bcdfghjklmnpqrstvwxyzçñýÿß", "bdfghklmnprstvz"),
    ("аеёиоуыэюя", "аеиоуя"),
    ("бвгджзйклмнпрстфхцчшщъь", "бвгдзклмнпрст"),
    ("αεηιουωάέήίόύώ", "αεηιουω"),
    ("βγδζθκλμνξπρσςτφχψ", "βγδθκλμνπρστφ"),
)
#: Characters for names in scripts without case, each by its script's class.
EASTERN = (
    (r"\p{IsHan}", "王李張陳林黃吳周徐孫馬朱胡郭何高"),
    (r"\p{IsHiragana}", "あいうえおかきくこさしたなはまや"),
    (r"\p{IsKatakana}", "アイウエオカキクコサシタナハマヤ"),
    (r"\p{IsHangul}", "김이박최정강조윤장임한오서신권황"),
)
MOST_ROUNDS = 100
#: After so many attempts in one form a longer one is tried.
WIDER_AFTER = 8


def has_entity(text: Column) -> Column:
    """Whether the pattern occurs; cheap looks for what each kind needs come first."""
    numbered = text.rlike("[0-9@]") & text.rlike(NUMBERED)
    return numbered | (text.rlike(TITLE_HINT) & text.rlike(PATTERNS["name"])) | (text.rlike(KEYWORD_HINT) & text.rlike(PATTERNS["secret"]))


def entities(text: Column, pattern: Column | None = None) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PATTERN) if pattern is None else pattern, F.lit(0))


def gaps(text: Column, pattern: Column | None = None) -> Column:
    return F.split(F.coalesce(text, F.lit("")), PATTERN if pattern is None else pattern, -1)


def kind_of(hit: Column) -> Column:
    """The first kind whose pattern fits the whole match; the last title tells of names whether it is f, m or neither."""
    titled = lambda titles: hit.rlike(rf"^(?:(?:{ANY_TITLE})\.? )*(?:{titles})\.? (?:{NAME}|{LOWER})$")
    out = F.when(titled(LADIES), "name f").when(titled(MEN), "name m").when(titled(ANY_TITLE), "name n")
    for kind in ("email", "card", "phone", "national", "mac", "ip", "ipv6", "iban"):
        out = out.when(hit.rlike(f"^(?:{PATTERNS[kind]})$"), kind)
    return out.otherwise("secret")


def _last(name: Column) -> Column:
    return F.substring_index(name, " ", -1)


def _first(name: Column) -> Column:
    return F.substring_index(name, " ", 1)


def _told(hit: Column) -> Column:
    """(prefix, value, kind) of a match: titles and keywords stay as they are."""
    prefix = F.regexp_extract(hit, PREFIX, 0)
    return F.struct(prefix.alias("prefix"), F.substring(hit, F.length(prefix) + 1, F.length(hit)).alias("value"), kind_of(hit).alias("kind"))


def _titled(hits: Column) -> Column:
    """From a text's matches its names after titles, as (size, value, kind), the longest first."""
    names = F.filter(F.transform(hits, _told), lambda x: x["kind"].startswith("name"))
    by_size = F.transform(names, lambda x: F.struct(F.length(x["value"]).alias("size"), x["value"].alias("value"), x["kind"].alias("kind")))
    return F.sort_array(F.array_distinct(by_size), asc=False)


def _own_pattern(names: Column) -> Column:
    """The pattern of the text's own names, whole or their first or last word (no initials), null without names."""
    forms = F.flatten(F.transform(names, lambda x: F.array(x["value"], _first(x["value"]), _last(x["value"]))))
    forms = F.sort_array(F.array_distinct(F.filter(forms, lambda x: ~x.rlike(r"^.\.?$"))), asc=False)
    listed = F.array_join(F.transform(forms, lambda x: F.regexp_replace(x, r"\.", r"\\\\.")), "|")
    return F.when(F.size(names) > 0, F.concat(F.lit(r"(?<![\p{L}\p{N}])(?:"), listed, F.lit(r")(?![\p{L}\p{N}])")))


def pieces(text: Column, own: Column) -> Column:
    """A text as (gap, hit, own), in order; the last has no hit. Between the matches of all kinds the text's own names are hits too."""
    plain = F.arrays_zip(gaps(text).alias("gap"), entities(text).alias("hit"))
    plain = F.transform(plain, lambda x: F.struct(x["gap"].alias("gap"), x["hit"].alias("hit"), F.lit(False).alias("own")))

    def cut(x: Column) -> Column:
        inner = F.arrays_zip(gaps(x["gap"], own).alias("gap"), entities(x["gap"], own).alias("hit"))
        return F.transform(inner, lambda y: F.struct(y["gap"].alias("gap"), F.coalesce(y["hit"], x["hit"]).alias("hit"), y["hit"].isNotNull().alias("own")))

    return F.when(own.isNull(), plain).otherwise(F.flatten(F.transform(plain, cut)))


def _resolved(hit: Column, own: Column, names: Column) -> Column:
    """(prefix, value, kind, word): a mention of one of the text's names is that name, or its `first` or `last` word."""
    told = F.when(own, F.struct(F.lit("").alias("prefix"), hit.alias("value"), F.lit("").alias("kind"))).otherwise(_told(hit))
    return _let(told, lambda t: _owned(t, own, names))


def _let(value: Column, body) -> Column:
    """body of the value, which is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _owned(told: Column, own: Column, names: Column) -> Column:
    value, kind = told["value"], told["kind"]
    whole = F.filter(names, lambda x: x["value"] == value)
    ends = lambda word: F.filter(names, lambda x: (x["value"] != value) & (word(x["value"]) == value))
    longer, begun = ends(_last), ends(_first)
    same = F.filter(longer, lambda x: x["kind"] == kind)
    found = F.when(~own, same).when(F.size(longer) > 0, longer).when(F.size(whole) > 0, whole).otherwise(begun)
    owner = F.get(found, F.lit(0))
    mention = (own | kind.startswith("name")) & owner.isNotNull()
    return F.struct(
        told["prefix"].alias("prefix"),
        F.when(mention, owner["value"]).otherwise(value).alias("value"),
        F.when(mention, owner["kind"]).otherwise(kind).alias("kind"),
        F.when(mention & (owner["value"] != value), F.when(_last(owner["value"]) == value, "last").otherwise("first")).alias("word"),
    )


def _scrambled(value: Column, key: Column) -> Column:
    """Every letter and digit replaced by one of its alphabet, from a hash of the key and its place; hex stays hex."""

    def one(char: Column, place: Column) -> Column:
        draw = F.xxhash64(key, place)
        pick = lambda letters: F.substring(F.lit(letters), (F.pmod(draw, F.lit(len(letters))) + 1).cast("int"), F.lit(1))
        out = F.when(char == "", char).when(hexed & F.contains(F.lit("abcdef"), char), pick("abcdef")).when(upper_hexed & F.contains(F.lit("ABCDEF"), char), pick("ABCDEF"))
        for letters in ALPHABETS:
            out = out.when(F.contains(F.lit(letters), char), pick(letters))
        return out.when(char.rlike(r"\p{Lu}"), pick(ALPHABETS[2])).when(char.rlike(r"\p{L}"), pick(ALPHABETS[1])).otherwise(char)

    hexed, upper_hexed = value.rlike("^[0-9a-f:]+$"), value.rlike("^[0-9A-F]{32,}$")
    return F.array_join(F.transform(F.split(value, ""), one), "")


def _sounding(value: Column, key: Column) -> Column:
    """A name's letters replaced by others of their script, case and sound."""

    def one(char: Column, place: Column) -> Column:
        draw = F.xxhash64(key, place)
        pick = lambda letters: F.substring(F.lit(letters), (F.pmod(draw, F.lit(len(letters))) + 1).cast("int"), F.lit(1))
        out = F.when(char == "", char)
        for letters, to in SOUNDS:
            out = out.when(F.contains(F.lit(letters), char), pick(to)).when(F.contains(F.lit(letters.upper()), char), pick(to.upper()))
        for script, letters in EASTERN:
            out = out.when(char.rlike(script), pick(letters))
        return out.when(char.rlike(r"\p{Lu}"), pick(SOUNDS[1][1].upper())).when(char.rlike(r"\p{Ll}"), pick(SOUNDS[1][1])).otherwise(char)

    return F.array_join(F.transform(F.split(value, ""), one), "")


def identity(kind: Column, value: Column) -> Column:
    """What mentions of one entity have in common: addresses in small letters, numbers without blanks and signs (but a plus in front)."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    number = F.when(kind == "phone", F.concat(F.when(value.startswith("+"), "+").otherwise(""), digits)).otherwise(digits)
    return F.when(kind.isin("email", "ipv6"), F.lower(value)).when(kind == "mac", F.translate(F.lower(value), "-", ":")).when(kind.isin("card", "phone", "national"), number).when(kind == "iban", F.replace(value, F.lit(" "), F.lit(""))).otherwise(value)


def rendered(kind: Column, surrogate: Column, value: Column) -> Column:
    """The surrogate in the form of the mention: its digits where the mention has digits, its letters in the mention's case."""
    chars, new = F.split(value, ""), F.split(F.when(kind.isin("phone", "mac"), F.translate(surrogate, "+:", "")).otherwise(surrogate), "")
    fits = F.when(kind.isin("iban", "mac"), "[A-Za-z0-9]").otherwise("[0-9]")
    nth = lambda k: F.size(F.filter(F.slice(chars, F.lit(1), k + 1), lambda c: F.rlike(c, fits)))
    placed = F.array_join(F.transform(chars, lambda c, k: F.when(F.rlike(c, fits), F.get(new, nth(k) - 1)).otherwise(c)), "")
    used = F.size(F.filter(chars, lambda c: F.rlike(c, fits)))
    beyond = F.array_join(F.slice(new, used + 1, F.greatest(F.size(new) - used, F.lit(0))), "")
    cased = F.array_join(F.transform(new, lambda c, k: F.when(F.get(chars, k).rlike(r"^\p{Lu}$"), F.upper(c)).otherwise(c)), "")
    placed = F.when((kind == "mac") & value.rlike("[A-F]"), F.upper(placed)).otherwise(placed)
    return F.when(kind.isin("card", "phone", "national", "iban", "mac"), F.concat(placed, beyond)).when(kind.isin("email", "ipv6") & (F.length(value) == F.length(surrogate)), cased).otherwise(surrogate)


def _card_check(digits: Column) -> Column:
    """Luhn's sum modulo 10 over a string of digits."""
    doubled = F.transform(F.reverse(F.split(digits, "")), lambda d, k: F.when(k % 2 == 1, d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)).otherwise(d.cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10


def _wider_by(value: Column) -> Column:
    """What makes a name longer, in its script."""
    out = F.when(value.rlike(r"\p{IsCyrillic}"), "ба").when(value.rlike(r"\p{IsGreek}"), "βα")
    for script, letters in EASTERN:
        out = out.when(value.rlike(script), letters[0])
    return out.otherwise("ba")


def candidate(kind: Column, value: Column, attempt: Column, key: str) -> Column:
    """The surrogate that this attempt gives an identity: a function of key, kind, identity and attempt alone."""
    hashed = lambda *parts: F.sha2(F.concat_ws("|", F.lit(key), *parts).cast("binary"), 256)
    seed = hashed(kind, value, attempt.cast("string"))
    wider = F.floor(attempt / WIDER_AFTER).cast("int")
    digits, letters = (_scrambled(F.repeat(F.lit(x), wider), hashed(F.lit(x), seed)) for x in ("0", "a"))
    plain = _scrambled(value, seed)
    domain = F.regexp_extract(value, r"@(.+)\.[^.]+$", 1)
    email = F.concat(_scrambled(F.substring_index(value, "@", 1), seed), letters, F.lit("@"), _scrambled(domain, hashed(F.lit("domain"), domain)), F.regexp_extract(value, r"(\.[^.]+)$", 1))
    # The first digit stays; the last makes the check sum valid if the real number's is.
    body = F.concat(F.substring(value, 1, 1), _scrambled(F.regexp_replace(value, "^.|.$", ""), seed), digits)
    to_valid = F.pmod(10 - _card_check(F.concat(body, F.lit("0"))), F.lit(10))
    card = F.concat(body, F.when(_card_check(value) == 0, to_valid.cast("string")).otherwise(F.right(plain, F.lit(1))))
    octet = lambda k: (F.pmod(F.xxhash64(seed, F.lit(k)), F.lit(254)) + 1).cast("string")
    code = r"^\+(?:[17]|[0-9]{2})|^0|^"
    phone = F.concat(F.regexp_extract(value, code, 0), _scrambled(F.regexp_replace(value, rf"{code}", ""), seed), digits)
    akia = F.concat(F.lit("AKIA"), _scrambled(F.regexp_replace(value, "^AKIA", ""), seed), digits)
    iban = F.concat(F.substring(value, 1, 2), _scrambled(F.regexp_replace(value, "^..", ""), seed), digits)
    name = F.concat(_sounding(value, seed), _sounding(F.repeat(_wider_by(value), wider), hashed(F.lit("wider"), seed)))
    ending = lambda to: F.regexp_replace(name, r"(\p{Ll})(?= |$)", f"$1{to}")
    of_script = lambda latin, cyrillic, greek: F.when(value.rlike(r"\p{IsCyrillic}"), ending(cyrillic)).when(value.rlike(r"\p{IsGreek}"), ending(greek)).otherwise(ending(latin))
    out = F.when(kind == "email", email).when(kind == "card", card).when(kind == "ip", F.concat_ws(".", octet(1), octet(2), octet(3), octet(4))).when(kind == "ipv6", plain)
    out = out.when(kind == "phone", phone).when(kind == "national", F.concat(plain, digits)).when(kind == "iban", iban).when(value.startswith("AKIA"), akia)
    return out.when(kind == "name f", of_script("a", "а", "α")).when(kind == "name m", of_script("o", "н", "ος")).when(kind == "name n", name).otherwise(F.concat(plain, digits))


def surrogate_table(found: DataFrame, key: str) -> DataFrame:
    """found: distinct (kind, ident). Gives (kind, ident, surrogate), surrogates distinct and none of them an identity.

    Each round draws again for those whose candidate is also another's or a real entity; the first
    by attempt and identity keeps a shared one. Groups of a shared candidate are small, as spaces are large.
    """
    drawn = lambda df: df.withColumn("surrogate", candidate(F.col("kind"), F.col("ident"), F.col("attempt"), key))
    columns = ["kind", "ident", "attempt", "surrogate"]
    real = frozen(found.select(F.col("ident").alias("surrogate"), F.lit(True).alias("real")).distinct(), "entities")
    now = drawn(found.select("kind", "ident", F.lit(0).alias("attempt")))
    before = None
    for _ in range(MOST_ROUNDS):
        nth = F.row_number().over(Window.partitionBy("surrogate").orderBy("attempt", "ident", "kind"))
        seen = now.select(*columns).withColumn("nth", nth).join(real, "surrogate", "left")
        checked = frozen(seen.select(*columns, ((F.col("nth") > 1) | F.col("real").isNotNull()).alias("bad")), "surrogates")
        if before:
            discard(before)
        if not checked.where("bad").limit(1).count():
            discard(real)
            return checked.select("kind", "ident", "surrogate")
        now, before = checked.where("not bad").select(*columns).unionByName(drawn(checked.where("bad").select("kind", "ident", (F.col("attempt") + 1).alias("attempt")))), checked
    raise ValueError("the entities leave too little space for distinct surrogates of their formats")


def replace_pii(df: DataFrame, *, text: str = "text", key: str, carry: list[str], count: str = "n_entities") -> DataFrame:
    """The carry columns, the text with surrogates for its entities, and how many were replaced.

    Null texts stay null with 0 entities; empty texts and texts without an entity are unchanged, and are not shuffled.
    Equal texts get equal results, whatever else their rows hold. Columns of df with the count's name
    are replaced. An empty table gives an empty one. Rows are frozen with an id, by which they meet
    the lists of their entities; entities of very many mentions meet their surrogates by broadcast.
    """
    kept = [c for c in carry if c.lower() not in (text.lower(), count.lower())]
    work = frozen(df.select(F.struct(*kept).alias("row"), F.col(text).alias("text"), F.coalesce(has_entity(F.col(text)), F.lit(False)).alias("has"), F.monotonically_increasing_id().alias("id")), "texts")
    named = work.where("has").select("id", "text", _titled(F.when(F.col("text").rlike(TITLE_HINT), entities(F.col("text"))).otherwise(F.array().cast("array<string>"))).alias("names")).withColumn("own", _own_pattern(F.col("names")))
    parts = named.select("id", "names", F.col("own").alias("pattern"), F.posexplode(pieces(F.col("text"), F.col("own"))).alias("nth", "part")).where("part.hit is not null")
    parts = parts.select("id", F.when(F.col("nth") == 0, F.col("pattern")).alias("pattern"), "nth", "part.hit", _resolved(F.col("part.hit"), F.col("part.own"), F.col("names")).alias("r"))
    mention = F.substring(F.col("hit"), F.length("r.prefix") + 1, F.length("hit"))
    as_value = F.when(F.col("r.word").isNotNull() | F.col("r.kind").startswith("name"), F.col("r.value")).otherwise(mention)
    parts = frozen(parts.select("id", "pattern", "nth", mention.alias("mention"), "r.prefix", "r.kind", "r.word", identity(F.col("r.kind"), as_value).alias("ident")), "mentions")
    counts = frozen(parts.groupBy("kind", "ident").agg(F.count("*").alias("n")), "counts")
    chosen = surrogate_table(counts.select("kind", "ident"), key).join(counts, ["kind", "ident"])
    told = F.concat("prefix", F.when(F.col("word") == "last", _last(F.col("surrogate"))).when(F.col("word") == "first", _first(F.col("surrogate"))).otherwise(rendered(F.col("kind"), F.col("surrogate"), F.col("mention"))))
    lists = (
        joined(parts, chosen, ["kind", "ident"], "n", parts.count())
        .groupBy("id")
        .agg(F.sort_array(F.collect_list(F.struct("nth", told.alias("told")))).alias("s"), F.max("pattern").alias("pattern"))  # the entities of one text
        .select("id", "pattern", F.transform("s", lambda x: x["told"]).alias("s"))
    )
    split = F.transform(pieces(F.col("text"), F.col("pattern")), lambda x: x["gap"])
    rebuilt = F.array_join(F.flatten(F.zip_with(split, F.col("s"), lambda g, s: F.array(g, F.coalesce(s, F.lit(""))))), "")
    carried = [F.col("row")[c].alias(c) for c in kept]
    changed = work.where("has").join(lists, "id").select(*carried, rebuilt.alias(text), F.size("s").alias(count))
    return work.where("not has").select(*carried, F.col("text").alias(text), F.lit(0).alias(count)).unionByName(changed)
