"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust scores.

DataFrame functions only. Every quantifier over groups is possessive and every pattern starts at the
first character of its run, so a long run of digits or letters costs linear time and no stack.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

_LOCAL = r"[A-Za-z0-9._%+-]"
#: A part of an address from 0 to 255, with any leading zeros.
_PART = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2}|)"


@dataclass(frozen=True)
class Kind:
    """One kind of personal data: a quick test for whole texts, the pattern, the check, and scoring."""

    name: str
    hint: str
    pattern: str
    prior: float
    words: str
    base: bool = True


#: In the order in which spans are listed; the last two are what the method adds to the base kinds.
KINDS = (
    Kind("email", r"@[A-Za-z0-9-]++\.", rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0.8, "mail|contact|write"),
    Kind("ip", r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", 0.6, r"\bip\b|address|host|server"),
    Kind("card", r"[0-9](?:[ -]?[0-9]){12}", r"[0-9](?:[ -]?[0-9])++", 0.6, "card|visa|credit|payment|amex"),
    Kind("phone", r"\+[0-9][ ().0-9-]", r"\+[0-9][ ().0-9-]+[0-9]", 0.6, "phone|tel|call|mobile|fax"),
    Kind("iban", r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}+(?: ?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])", 0.8, "iban|account|bank|konto", False),
    Kind("localphone", r"(?i)(?:phone|tel|call|mobile|fax)[^\n]{0,24}[0-9]{3}", r"(?<![+0-9A-Za-z.-])[(]?[0-9]{3,5}[)]?[ ./-][0-9]{3,4}[ .-]?[0-9]{2,5}(?![0-9A-Za-z.-])", 0.2, "phone|tel|call|mobile|fax", False),
)
#: A proposed span that is not of a base kind stays when its score reaches this.
THRESHOLD = 0.5
#: Code points before a span that are searched for its context words, and what one adds to its score.
CONTEXT, BONUS = 24, 0.35
_BLOCK = 64


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    back = F.reverse(digits)
    d = lambda i: F.substring(back, i, 1).cast("int")
    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda s, i: s + F.when(i % 2 == 1, d(i)).otherwise(d(i) * 2 % 10 + F.when(d(i) >= 5, 1).otherwise(0)))
    return total % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN without blanks passes ISO 7064 mod 97-10."""
    turned = F.concat(F.substring(iban, 5, 64), F.substring(iban, 1, 4))
    step = lambda r, i: let(F.ascii(F.substring(turned, i, 1)), lambda a: F.when(a < 58, r * 10 + a - 48).otherwise(r * 100 + a - 55) % 97)
    return F.aggregate(F.sequence(F.lit(1), F.length(iban)), F.lit(0), step) == 1


def _confirmed(kind: Kind, m: Column) -> Column:
    if kind.name == "ip":
        return m.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind.name == "card":
        n = F.length(_digits(m))
        return F.when(F.length(m) > 40, False).when(~n.between(13, 19), False).otherwise(luhn(_digits(m)))
    if kind.name == "phone":
        return F.length(_digits(m)).between(9, 15)
    if kind.name == "iban":
        return let(F.replace(m, F.lit(" "), F.lit("")), lambda x: F.when(F.length(x).between(15, 34), mod97(x)).otherwise(False))
    if kind.name == "localphone":
        return F.length(_digits(m)).between(8, 12)
    return F.lit(True)


def _running(lens: Column) -> Column:
    """The sums of what comes before each element, in blocks: no array is copied once per element."""
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    n = F.size(lens)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / _BLOCK).cast("int")), lambda b: F.slice(lens, b * _BLOCK + 1, _BLOCK))
    within = lambda block, before: F.transform(block, lambda _, j: before + total(F.slice(block, 1, j)))
    return let(blocks, lambda bs: let(F.transform(bs, total), lambda sums: F.flatten(F.transform(bs, lambda block, i: let(total(F.slice(sums, 1, i)), lambda before: within(block, before))))))


_SPAN = "array<struct<start:int,end:int,score:double>>"


def spans_of(kind: Kind, text: Column) -> Column:
    """The confirmed spans of one kind: start and end (code points, end exclusive) and score, in order."""
    matches = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))

    def located(m: Column, parts: Column) -> Column:
        lens = F.transform(F.sequence(F.lit(0), F.size(m) - 1), lambda i: F.length(F.get(parts, i)) + F.length(F.get(m, i)))
        span = lambda x, i, before: F.struct((before + F.length(F.get(parts, i))).alias("start"), (before + F.length(F.get(parts, i)) + F.length(x)).alias("end"), F.when(_confirmed(kind, x), F.round(F.least(F.lit(1.0), F.lit(kind.prior) + F.when(F.right(F.get(parts, i), F.lit(CONTEXT)).rlike(f"(?i)(?:{kind.words})"), BONUS).otherwise(0.0)), 2)).alias("score"))
        found = let(_running(lens), lambda before: F.transform(m, lambda x, i: span(x, i, F.get(before, i))))
        return F.filter(found, lambda s: s["score"].isNotNull() if kind.base else s["score"] >= THRESHOLD)

    empty = F.array().cast(_SPAN)
    found = let(matches, lambda m: F.when(F.size(m) == 0, empty).otherwise(let(F.split(text, kind.pattern, -1), lambda parts: located(m, parts).cast(_SPAN))))
    return F.when(text.rlike(kind.hint), found).otherwise(empty)


def find_pii(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, then an array of spans (start, end, score) for each of ``KINDS``.

    A null text counts as empty and has no spans; a null doc_id stays null; repeated rows each give a
    row; an empty table gives none; other columns are ignored. Spans count code points of the whole
    text. No shuffle takes place.
    """
    text = F.coalesce(docs["text"], F.lit(""))
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), *(spans_of(k, text).alias(k.name) for k in KINDS))


def _listed(kinds) -> Column:
    def spans(name: str) -> Column:
        return F.transform(name, lambda s: F.concat_ws(":", F.lit(name), s["start"], s["end"]))

    return F.array_join(F.concat(*(spans(k.name) for k in kinds)), ",")


def pii_report(docs: DataFrame) -> DataFrame:
    """The spans of ``find_pii`` counted and listed as ``kind:start:end``, with the SHA-256 of the base kinds' list.

    ``n_likely`` counts the spans whose score, with its context words, is at least 0.9.
    """
    base = [k for k in KINDS if k.base]
    found = find_pii(docs)
    likely = sum((F.size(F.filter(k.name, lambda s: s["score"] >= 0.9)) for k in KINDS[1:]), F.size(F.filter(KINDS[0].name, lambda s: s["score"] >= 0.9)))
    return found.select(
        "doc_id", *(F.size(k.name).cast("long").alias(f"n_{k.name}") for k in base),
        F.sha2(_listed(base), 256).alias("base_sha256"), _listed(KINDS).alias("spans"), likely.cast("long").alias("n_likely"),
    )


def _masked(kind: Kind, text: Column) -> Column:
    matches = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))

    def kept(m: Column, part: Column) -> Column:
        near = F.right(part, F.lit(CONTEXT)).rlike(f"(?i)(?:{kind.words})")
        return _confirmed(kind, m) if kind.base or kind.prior >= THRESHOLD else _confirmed(kind, m) & near

    def joined(m: Column, parts: Column) -> Column:
        after = lambda p, x: F.when(x.isNull(), "").when(kept(x, p), f"<{kind.name.upper()}>").otherwise(x)
        return F.array_join(F.transform(parts, lambda p, i: F.concat(p, after(p, F.get(m, i)))), "")

    found = let(matches, lambda m: F.when(F.size(m) == 0, text).otherwise(let(F.split(text, kind.pattern, -1), lambda parts: joined(m, parts))))
    return F.when(text.rlike(kind.hint), found).otherwise(text)


def _masker(kind: Kind):
    return lambda t: _masked(kind, t)


def redact(text: Column) -> Column:
    """``text`` with every confirmed span replaced by its kind in angle brackets, one kind after the other. Null stays null."""
    for kind in KINDS:
        text = let(text, _masker(kind))
    return text
