"""Personal data: patterns propose spans, checksums confirm them, context scores them.

All work is done in one projection per document: no shuffle, no Python.  A pattern's
matches come from ``regexp_extract_all`` and the text between them from ``split``; the
running sum of both lengths gives each match's place in code points.

The patterns below are the contract's, with possessive quantifiers and look-behinds
where a failing match would otherwise be retried from every character of a long run.
They find the same spans: such a retry could only end where the first try ended.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from morrow.llm.support import body

_BLOCK = 512
_CONTEXT = 48


@dataclass(frozen=True)
class Kind:
    """A kind of personal data.

    ``needs`` must occur in a text that holds a match (a cheap test before the pattern).
    ``prior`` is the score without context; each side's context words move it.
    """

    name: str
    pattern: str
    needs: str
    prior: float
    context: str
    base: bool = True


# The kinds in the order of the contract, then those that the method adds.
KINDS = (
    Kind(
        "email",
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        "@", 0.9, r"e-?mail|correo|courriel|contact|kontakt|write|mailto",
    ),
    Kind(
        "ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", ".", 0.6,
        r"\bip\b|address|adresse|server|host|login|connect",
    ),
    Kind(
        "card", r"[0-9](?:[\x20-]?[0-9]){11,}+", "", 0.8,
        r"card|karte|carte|tarjeta|visa|credit|payment|zahlung",
    ),
    Kind(
        "phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", 0.7,
        r"\btel|phone|call|mobile|fax|anruf|appel|llam",
    ),
    Kind(
        "iban",
        r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b",
        "", 0.6, r"iban|konto|account|compte|cuenta|bank", False,
    ),
)


def _running(lengths: Column) -> Column:
    """For each entry, the sum of the entries before it; in blocks, so that long lists stay cheap."""
    step = F.lit(_BLOCK)
    part = lambda b: F.slice(lengths, b * step + 1, step)
    push = lambda acc, x: F.struct(
        (acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")
    )
    scan = lambda xs, start: F.aggregate(
        xs,
        F.struct(start.alias("at"), F.array().cast("array<int>").alias("out")),
        push,
        lambda acc: acc["out"],
    )
    count = F.ceil(F.size(lengths) / step).cast("int")
    sums = F.transform(
        F.sequence(F.lit(0), count - 1), lambda b: F.aggregate(part(b), F.lit(0), lambda a, x: a + x)
    )
    inner = F.transform(scan(sums, F.lit(0)), lambda start, b: scan(part(b), start))
    return F.when(F.size(lengths) > 0, F.flatten(inner)).otherwise(F.array().cast("array<int>"))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = F.split(F.reverse(_digits(value)), "")
    doubled = F.transform(
        digits,
        lambda d, i: F.when(i % 2 == 1, d.try_cast("int") * 2 - F.when(d > "4", 9).otherwise(0))
        .otherwise(d.try_cast("int")),
    )
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def _mod97(value: Column) -> Column:
    """The bank account check: country and check digits last, letters as 10 to 35."""
    plain = F.replace(value, F.lit(" "), F.lit(""))
    turned = F.split(F.concat(F.substr(plain, F.lit(5)), F.left(plain, F.lit(4))), "")
    return F.aggregate(
        turned,
        F.lit(0),
        lambda a, c: F.when(
            (c >= "A") & (c <= "Z"), (a * 100 + F.ascii(c) - 55) % 97
        ).otherwise((a * 10 + F.coalesce(c.try_cast("int"), F.lit(0))) % 97),
    ) == 1


def _small_parts(value: Column) -> Column:
    def fits(part: Column) -> Column:
        bare = F.ltrim(part, F.lit("0"))
        return (F.length(bare) <= 3) & (F.coalesce(bare.try_cast("int"), F.lit(0)) <= 255)

    return F.forall(F.split(value, r"\."), fits)


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return _small_parts(value)
    if kind == "card":
        return (F.length(_digits(value)) <= 19) & _luhn(value)
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    if kind == "iban":
        return _mod97(value)
    return F.lit(True)


def _spans(rank: int, kind: Kind) -> Column:
    """The found matches with their place and score."""
    found, between, places = (F.col(f"{kind.name}_{part}") for part in ("found", "between", "places"))

    def near(text: Column) -> Column:
        return F.lower(text).rlike(kind.context).cast("int")

    def span(value: Column, i: Column) -> Column:
        before, after = F.get(between, i), F.get(between, i + 1)
        start = F.get(places, i) + F.length(before)
        score = (
            F.lit(kind.prior)
            + 0.2 * near(F.right(before, F.lit(_CONTEXT)))
            + 0.1 * near(F.left(after, F.lit(_CONTEXT)))
        )
        return F.struct(
            start.alias("start"),
            F.lit(rank).alias("rank"),
            F.lit(kind.name).alias("kind"),
            (start + F.length(value)).alias("end"),
            F.least(score, F.lit(1.0)).alias("score"),
            value.alias("value"),
        )

    return F.transform(found, span)


def _keeps(kind: Kind, min_score: float):
    return lambda s: _valid(kind.name, s["value"]) & (F.lit(kind.base) | (s["score"] >= min_score))


def find_spans(docs: DataFrame, min_score: float = 0.5) -> DataFrame:
    """Spans of personal data in each text.

    Returns one row per input row: ``doc_id`` and ``spans``, an array of (start, rank,
    kind, end, score, value) ordered by start, then by the order of ``KINDS``; start and
    end count code points, the end is exclusive.

    A validator drops a match that it does not confirm, without another try.  Base kinds
    are kept whatever their score; kinds that the method adds need ``min_score``.  A
    context word within 48 code points before the span raises the score by 0.2, one within
    48 after it by 0.1.

    A null or empty text has an empty array.  Rows are independent: a null or repeated
    doc_id and repeated texts need no care.  Other columns are ignored; an empty table
    gives an empty result.
    """
    rows = docs.select("doc_id", body().alias("body"))
    for kind in KINDS:
        pattern, found = F.lit(kind.pattern), F.col(f"{kind.name}_found")
        matches = F.regexp_extract_all(F.col("body"), pattern, F.lit(0))
        if kind.needs:
            matches = F.when(F.contains("body", F.lit(kind.needs)), matches)
        rows = rows.withColumn(f"{kind.name}_found", F.coalesce(matches, F.array().cast("array<string>")))
        rows = rows.withColumn(
            f"{kind.name}_between", F.when(F.size(found) > 0, F.split("body", pattern, -1))
        )
    rows = rows.drop("body")
    located = []
    for rank, kind in enumerate(KINDS, 1):
        found, between = F.col(f"{kind.name}_found"), F.col(f"{kind.name}_between")
        name = f"{kind.name}_places"
        steps = F.zip_with(
            F.slice(between, 1, F.size(found)), found, lambda gap, m: F.length(gap) + F.length(m)
        )
        rows = rows.withColumn(name, F.when(F.size(found) > 0, _running(steps)))
        located.append(F.when(F.size(found) > 0, F.filter(_spans(rank, kind), _keeps(kind, min_score))))
    kinds = "array<struct<start:int,rank:int,kind:string,end:int,score:double,value:string>>"
    none = F.array().cast(kinds)
    return rows.select(
        "doc_id",
        F.array_sort(F.concat(*[F.coalesce(x.cast(kinds), none) for x in located])).alias("spans"),
    )


def _joined(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )


def span_digest(docs: DataFrame) -> DataFrame:
    """Counts and digests of ``find_spans`` per document, the form of query op7."""
    base = [kind.name for kind in KINDS if kind.base]
    of = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return find_spans(docs).select(
        "doc_id",
        *[of(k).alias(f"n_{k}") for k in base],
        F.sha2(_joined(F.filter("spans", lambda s: s["rank"] <= len(base))), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
    )
