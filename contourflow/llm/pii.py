"""Personal data: regular expressions propose spans, checksums confirm them, nearby words adjust their score.

Everything is a column expression; no Python runs on the executors.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Code points before a span in which context words count.
REACH = 40
#: A span stays if its score is at least this.
LEAST = 0.5
NEAR = 0.3


@dataclass(frozen=True)
class Kind:
    """How one kind of span is found.

    pattern: what proposes spans, leftmost and non-overlapping. It may be written otherwise than the kind is defined, so
    that no text takes more than linear time: possessive where giving back could never help, and only from where a run
    of its first characters begins. hint: a cheap test that each text with a span passes. base: the score without
    context; words: a pattern whose presence before the span adds NEAR.
    """

    name: str
    pattern: str
    hint: str
    base: float
    words: str


#: The kinds, in the order in which spans are listed.
KINDS = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.7, r"(?i)mail|contact|kontakt|correo|courriel"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", 0.6, r"(?i)\bip\b|address|host|server"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", "", 0.7, r"(?i)card|visa|karte|tarjeta|carte"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", 0.6, r"(?i)phone|call|tel|mobile|fax"),
    Kind("tel", r"(?<![0-9+])\([0-9]{3}\)\x20?[0-9]{3}-[0-9]{4}(?![0-9])", "(", 0.5, r"(?i)phone|call|tel|mobile|fax"),
    Kind("iban", r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3})?+(?![A-Z0-9])", "", 0.7, r"(?i)iban|account|konto|cuenta|compte"),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-", 0.3, r"(?i)\bssn\b|social"),
)
BASE = ("email", "ip", "card", "phone")


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(x: Column) -> Column:
    """Whether the digits of x pass the Luhn checksum."""
    figures = F.split(F.reverse(_digits(x)), "")
    weighed = F.transform(figures, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2).cast("int") - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(F.filter(weighed, lambda d: d.isNotNull()), F.lit(0), lambda a, d: (a + d).cast("int")) % 10 == 0


def mod97(x: Column) -> Column:
    """Whether x passes the ISO 7064 mod 97-10 checksum of an IBAN."""
    plain = F.upper(F.regexp_replace(x, " ", ""))
    turned = F.concat(F.substring(plain, 5, 1_000), F.substring(plain, 1, 4))
    value = F.transform(F.filter(F.split(turned, ""), lambda c: c != ""), lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55).cast("int"))
    return F.aggregate(value, F.lit(0), lambda a, v: ((a * F.when(v > 9, 100).otherwise(10) + v) % 97).cast("int")) == 1


def confirmed(kind: str, x: Column) -> Column:
    """The checks beyond the pattern."""
    if kind == "ip":
        return F.forall(F.split(x, r"\."), _at_most_255)
    if kind == "card":
        return F.length(_digits(x)).between(13, 19) & luhn(x)
    if kind == "phone":
        return F.length(_digits(x)).between(9, 15)
    if kind == "iban":
        return F.length(F.regexp_replace(x, " ", "")).between(15, 34) & mod97(x)
    return F.lit(True)


def _at_most_255(part: Column) -> Column:
    plain = F.regexp_replace(part, "^0+", "")
    return F.when(F.length(plain) > 3, False).otherwise(F.concat(F.lit("0"), F.substring(plain, 1, 3)).cast("int") <= 255)


def _spans(kind: Kind, text: Column) -> Column:
    """All confirmed spans of a kind: array of (kind, start, end, text, score), in code points, end exclusive."""
    shape = "array<struct<kind:string,start:bigint,end:bigint,text:string,score:double>>"
    pieces = F.array(F.struct(F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)).alias("found"), F.split(text, kind.pattern, -1).alias("between")))

    def all_spans(p: Column) -> Column:
        sizes = F.zip_with(p["found"], F.slice(p["between"], 1, F.size(p["found"])), lambda f, b: F.length(f) + F.length(b))
        # Sums of the first i sizes, by adding what lies 1, 2, 4 ... places before: a logarithm of passes over the array.
        rounds = F.when(F.size(p["found"]) > 1, F.sequence(F.lit(0), F.ceil(F.log2(F.size(p["found"]))).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
        ends = F.aggregate(rounds, sizes, lambda s, k: F.transform(s, lambda x, i: x + F.coalesce(F.get(s, i - F.call_function("shiftleft", F.lit(1), k)), F.lit(0))))
        return F.filter(F.zip_with(F.arrays_zip(p["found"].alias("found"), p["between"].alias("between")), ends, span), lambda s: confirmed(kind.name, s["text"]) & (s["score"] >= LEAST))

    def span(x: Column, end: Column) -> Column:
        near = F.when(F.right(x["between"], F.lit(REACH)).rlike(kind.words), NEAR).otherwise(0.0)
        return F.struct(F.lit(kind.name).alias("kind"), (end - F.length(x["found"])).cast("bigint").alias("start"), end.cast("bigint").alias("end"), x["found"].alias("text"), (F.lit(kind.base) + near).alias("score"))

    # There is one more stretch between matches than matches: the pair that it makes has no text and goes.
    found = F.filter(F.get(F.transform(pieces, all_spans), F.lit(0)), lambda s: s["text"].isNotNull()).cast(shape)
    return F.when(text.contains(kind.hint) & text.rlike(kind.pattern), found).otherwise(F.array().cast(shape))


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds spans: array of (kind, start, end, text, score), by kind as in KINDS, then by start.

    Spans of the first four kinds are the base: leftmost, non-overlapping matches of their patterns that pass their
    checks (ip: four parts of at most 255; card: 13 to 19 digits and Luhn; phone: 9 to 15 digits). The others are added:
    national telephone numbers, IBANs that pass mod 97, social security numbers that a context word announces. A context
    word within 40 code points before a span, as far as the end of the last match of that kind, raises its score. A null
    text is empty and has none. Whole texts are read, in time that grows with n log n of the matches; matches of one
    kind don't overlap, those of two kinds may, and all stay. Repeated rows each get theirs. A column spans of docs is
    replaced, others stay. A map over the rows; nothing is shuffled.
    """
    x = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumn("spans", F.concat(*[_spans(k, x) for k in KINDS]))


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """Texts with each email, card, phone and IBAN match that find() confirms replaced by its kind in brackets."""
    out = find(docs, text)
    hide = F.aggregate(
        F.reverse(F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))),
        F.coalesce(F.col(text), F.lit("")),
        lambda t, s: F.when(s["end"] <= F.length(t), F.concat(F.substr(t, F.lit(1), s["start"].cast("int")), F.lit("["), s["kind"], F.lit("]"), F.substr(t, (s["end"] + 1).cast("int")))).otherwise(t),
    )
    return out.withColumn(text, hide)


def digest(found: DataFrame) -> DataFrame:
    """One row for each document: counts by kind, all spans as kind:start:end, and the hash of the base ones so listed."""
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, BASE), F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))
