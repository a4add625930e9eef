"""Personal data by patterns, checksums and context, in SQL functions only (operator 7).

Each kind's pattern proposes spans; a validator confirms them (Luhn for cards,
mod-97 for bank accounts, value ranges for addresses); nearby context words
move the score of the kinds that need context. Matches are found by wrapping
them in marks and splitting there, so that positions are sums of lengths and
whole texts are read in one pass a kind. Possessive repeats, and the rule that
a match starts at a run's first character or where the last match ended, keep
the work linear in the text.

Every span has a score: its kind's, more where a context word stands near. Base
kinds (email, ip, card, phone) score enough to count without one. The added
kinds are iban (its country's length, mod-97), ssn (three-two-four digits with
a context word) and secret (private key blocks and keys of known issuers; other
runs of 20 or more key characters, in which letters and digits take turns at
least three times, with a context word).

Odd input: null and empty texts give no spans; a text may hold the mark
characters themselves (they are read as another control character of the same
width); spans of different kinds may overlap; redaction joins overlapping spans
under the first kind. Extra columns pass through redaction; null and repeated
``doc_id`` values keep their rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

MARK = "\u0001"
#: The characters of a bank account number by country, of the IBAN registry and of the countries that use it unregistered.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "AO CV GW LY MZ PT ST", 26: "DZ IR IS TR", 27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD",
    28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
IBAN = "|".join(rf"(?:{'|'.join(names.split())})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, names in IBAN_LENGTHS.items())
#: The base kinds' patterns, with possessive repeats where nothing can be given back.
LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": rf"\b(?=[A-Z]{{2}}[0-9]{{2}})(?:{IBAN})\b",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "secret": r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----\s*+(?:Proc-Type: [^\n]*+\n)?(?:DEK-Info: [^\n]*+\n)?[^-]*+-----END [A-Z ]{0,40}PRIVATE KEY-----"
    r"|(?<![A-Za-z0-9_/+-])[A-Za-z0-9_/+-]{20,}+",
}
BASE = ("email", "ip", "card", "phone")
KINDS = tuple(PATTERNS)
#: A character without which a kind cannot match; tested before the pattern.
NEEDED = {"email": "@", "ip": ".", "phone": "+", "ssn": "-"}
#: Words that raise a span's score when they stand within WINDOW characters of it.
CONTEXT = {
    "iban": r"(?i)\b(?:iban|bank|account|konto|compte|cuenta)\b",
    "ssn": r"(?i)\b(?:ssn|social|security|sozial|sécurité|seguridad)\b",
    "email": r"(?i)\b(?:e-?mail|mail|contact|kontakt|correo|courriel)\b",
    "ip": r"(?i)\b(?:ip|host|server|address|adresse|login)\b",
    "card": r"(?i)\b(?:card|visa|credit|debit|karte|carte|tarjeta)\b",
    "phone": r"(?i)\b(?:phone|tel|call|mobile|fax|telefon|téléphone|teléfono)\b",
    "secret": r"(?i)(?<![a-z])(?:api|key|token|secret|password|passwd|pwd|credentials?|bearer|passwort|schlüssel|jeton|clave|contraseña)(?![a-z])",
}
WINDOW = 40
#: The score of a confirmed span, and what context adds.
SCORE = {"email": (0.8, 0.2), "ip": (0.6, 0.2), "card": (0.7, 0.2), "phone": (0.6, 0.2), "iban": (0.7, 0.2), "ssn": (0.3, 0.5), "secret": (0.3, 0.5)}
#: How private key blocks and the keys of some issuers begin; such a span needs no context.
ISSUED = r"^(?:-----BEGIN |AKIA[0-9A-Z]{16}$|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-|sk_live_)"
LEAST = 0.6  # score of a span that counts


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """Sum of the digits from the right, every second one doubled, divisible by ten."""
    places = F.sequence(F.lit(0), F.length(d) - 1)

    def value(i: Column) -> Column:
        x = F.substring(d, F.length(d) - i, F.lit(1)).cast("int")
        x = F.when(i % 2 == 1, x * 2).otherwise(x)
        return F.when(x > 9, x - 9).otherwise(x)

    return F.aggregate(places, F.lit(0), lambda acc, i: acc + value(i)) % 10 == 0


def mod97(c: Column) -> Column:
    """ISO 7064 check of a bank account number: the first four characters last, letters as 10 to 35."""
    bare = F.replace(c, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(bare, 5, 64), F.substring(bare, 1, 4))
    codes = F.transform(F.split(turned, "(?!^)(?!$)"), F.ascii)

    def step(acc: Column, x: Column) -> Column:
        return F.when(x >= 65, acc * 100 + x - 55).otherwise(acc * 10 + x - 48) % 97

    return F.aggregate(codes, F.lit(0), step) == 1


def confirmed(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: p.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        d = digits(m)
        return F.when(F.length(d).between(12, 19), luhn(d)).otherwise(False)
    if kind == "phone":
        return F.length(digits(m)).between(9, 15)
    if kind == "iban":
        return mod97(m)
    if kind == "secret":
        turns = F.regexp_count(m, F.lit("(?<=[0-9])[A-Za-z]|(?<=[A-Za-z])[0-9]"))
        return m.rlike(ISSUED) | (turns >= 3)
    return F.lit(True)


def running(values: Column, join) -> Column:
    """``join`` of an int array's values up to each place, by doubling strides: n log n steps, where growing an array takes n squared."""

    def add(sums: Column, level: Column) -> Column:
        back = F.call_function("shiftleft", F.lit(1), level)
        return F.transform(sums, lambda x, i: F.when(i >= back, join(x, F.get(sums, i - back))).otherwise(x))

    return F.aggregate(F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(values), F.lit(1)))).cast("int")), values, add)


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def scored(kind: str, ps: Column, i: Column) -> Column:
    """Score of the match at place ``i`` of the pieces; context may lie beyond one neighbouring match of the kind."""

    def side(places: tuple) -> Column:
        return F.concat(*[F.coalesce(F.get(ps, i + k), F.lit("")) for k in places])

    hit = F.get(ps, i)
    near = F.concat(F.right(side((-3, -2, -1)), F.lit(WINDOW)), hit, F.left(side((1, 2, 3)), F.lit(WINDOW) + (F.length(hit) if kind == "iban" else 0)))
    sure, more = SCORE[kind]
    base = F.when(hit.rlike(ISSUED), 0.9).otherwise(sure) if kind == "secret" else F.lit(sure)
    return F.round(F.least(base + F.when(near.rlike(CONTEXT[kind]), more).otherwise(0.0), F.lit(1.0)), 2)


def spans_of(kind: str, text: Column) -> Column:
    """Array of (start, end, kind, score) of one kind's counted spans, in code points from 0, end exclusive."""
    copied = kind == "iban"  # matches are copied before their place, so that one which fails mod-97 hides none that begins inside it
    pattern = rf"(?=({PATTERNS[kind]}))" if copied else f"({PATTERNS[kind]})"
    pieces = F.split(F.regexp_replace(text, pattern, f"{MARK}$1{MARK}"), MARK)  # odd places are matches

    def placed(ps: Column) -> Column:
        ends = running(F.transform(ps, lambda p, i: F.when(i % 2 == 0, F.length(p)).otherwise(0) if copied else F.length(p)), lambda x, y: x + y)
        start = (lambda p, end: end) if copied else (lambda p, end: end - F.length(p))
        spans = F.zip_with(ps, ends, lambda p, end: F.struct(start(p, end).alias("start"), (start(p, end) + F.length(p)).alias("end"), p.alias("hit")))

        def judged(s: Column, i: Column) -> Column:
            score = F.when((i % 2 == 1) & confirmed(kind, s["hit"]), scored(kind, ps, i))
            return F.struct(s["start"], s["end"], F.lit(kind).alias("kind"), score.alias("score"))

        return F.filter(F.transform(spans, judged), lambda s: s["score"] >= LEAST)

    found = bound(pieces, placed)  # so that the pattern runs once
    empty = F.array().cast("array<struct<start:int,end:int,kind:string,score:double>>")
    hint = text.contains(NEEDED[kind]) if kind in NEEDED else F.lit(True)
    needed = hint & (text.rlike(PATTERNS[kind]) if kind in ("card", "iban", "secret") else F.lit(True))
    return F.when(needed, found).otherwise(empty)


def find_pii(docs: DataFrame, text_col: str = "text", name: str = "_pii") -> DataFrame:
    """``docs`` with a column ``name``: a struct of one span array a kind."""
    text = F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), MARK, "\u0002")
    return docs.withColumn(name, F.struct(*[spans_of(k, text).alias(k) for k in KINDS]))


def listing(*arrays: Column, show=lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])) -> Column:
    """``kind:start:end``, or what ``show`` makes, of all spans by start, then kind as listed, comma-joined."""
    ranked = F.transform(
        F.concat(*arrays),
        lambda s: F.struct(s["start"], F.array_position(F.lit(list(KINDS)), s["kind"]).alias("rank"), s["end"], s["kind"], s["score"]),
    )
    return F.array_join(F.transform(F.array_sort(ranked), show), ",")


def pii_report(docs: DataFrame) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, n_iban, n_ssn, n_secret, base_sha256, spans, scores``; scores in the order of spans."""
    found = find_pii(docs.select("doc_id", "text"))
    of = {k: F.col(f"_pii.{k}") for k in KINDS}
    return found.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        *[F.size(of[k]).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(listing(*[of[k] for k in BASE]), 256).alias("base_sha256"),
        listing(*of.values()).alias("spans"),
        listing(*of.values(), show=lambda s: s["score"].cast("string")).alias("scores"),
    )


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with each span's text replaced by its kind in brackets; same columns."""
    own = fresh("_pii", docs.columns)
    spans = F.array_sort(F.concat(*[F.col(f"{own}.{k}") for k in KINDS]))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))

    def joined(both: Column) -> Column:
        chars, found, done = both["chars"], both["found"], both["done"]  # done: where the spans up to each one end

        def part(s: Column, i: Column) -> Column:
            at = F.when(i > 0, F.get(done, i - 1)).otherwise(0)
            before = F.array_join(F.slice(chars, at + 1, F.greatest(s["start"] - at, F.lit(0))), "")
            return F.when(s["start"] >= at, F.concat(before, F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise("")

        last = F.get(done, F.size(done) - 1)
        return F.concat(F.array_join(F.transform(found, part), ""), F.array_join(F.slice(chars, last + 1, F.size(chars) - last), ""))

    ends = bound(spans, lambda f: F.struct(f.alias("found"), running(F.transform(f, lambda s: s["end"]), F.greatest).alias("done")))
    clean = bound(F.struct(F.split(text, "(?s)(?<=.)(?=.)").alias("chars"), ends["found"].alias("found"), ends["done"].alias("done")), joined)
    has = F.greatest(*[F.size(f"{own}.{k}") for k in KINDS]) > 0
    names = docs.columns
    found = find_pii(docs, text_col, own)
    return found.select(*[F.when(has, clean).otherwise(F.col(c)).alias(c) if c == text_col else F.col(c) for c in names])
