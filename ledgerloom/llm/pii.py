"""Personal data by regular expressions, checksums and context words, native DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, text_of, without

#: The kinds in the order in which spans that start together are listed.
BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("iban", "ssn", "account", "secret")

#: The contract's expressions, then those of the added kinds. Possessive repeats match the same, as
#: what follows never begins with what they took, but need no recursion and no going back on long
#: runs. Runs of an expression's first characters match from their start or, after a match, from its
#: end, or not at all: all starts within a run meet the same end, so only those two are tried.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?",
    "ssn": r"[0-9]++-[0-9]++-[0-9]++",
    "account": r"[0-9]{8,}+",
    "secret": r"[A-Za-z0-9_-]{20,}+",
}
#: What a text with a match must contain, to skip the expression where it can't match.
NEEDS = {"email": "@", "phone": "+", "ssn": "-"}

#: Score in hundredths of a span whose validator agrees, what context words before it add, and what words of made-up examples take.
VALID_SCORE = {"email": 90, "ip": 60, "card": 80, "phone": 60, "iban": 60, "ssn": 40, "account": 30, "secret": 40}
CONTEXT_SCORE, EXAMPLE_SCORE = 30, 30
CONTEXT_POINTS = 40
CONTEXT_WORDS = {
    "email": "email|e-mail|mail|contact|write to",
    "ip": "ip|address|host|server|client",
    "card": "card|visa|mastercard|credit|debit|payment",
    "phone": "phone|call|tel|mobile|fax",
    "iban": "iban|account|bank|transfer",
    "ssn": "ssn|social security|social insurance|tax id",
    "account": "account|acct|account no|account number|konto|routing|sort code",
    "secret": "token|secret|password|passwd|api key|api_key|apikey|access key|access_key|private key|bearer|credentials",
}
EXAMPLE_WORDS = "example|sample|dummy|fake|fictitious|placeholder"
BLOCK = 256


def running_sums(values: Column) -> Column:
    """Inclusive prefix sums of an array, by blocks, so that an array of n values takes about n * BLOCK steps."""
    zero = F.lit(0).cast("bigint")
    add = lambda acc, x: acc + x
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int")),
        lambda b: F.aggregate(F.slice(values, b * BLOCK + 1, BLOCK), zero, add),
    )
    starts = F.aggregate(blocks, F.array(zero), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
    one = lambda i: F.element_at(starts, (F.floor(i / BLOCK) + 1).cast("int")) + F.aggregate(
        F.slice(values, (F.floor(i / BLOCK) * BLOCK + 1).cast("int"), i % BLOCK + 1), zero, add
    )
    return F.transform(F.sequence(F.lit(0), F.size(values) - 1), one)


def mod97(iban: Column) -> Column:
    """Whether a spelled-out bank account number leaves 1 by 97, letters as 10 to 35, the first four characters last."""
    plain = F.regexp_replace(iban, " ", "")
    turned = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))
    value = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    step = lambda acc, c: (acc * F.when(c.between("0", "9"), 10).otherwise(100) + value(c)) % 97
    return F.aggregate(F.split(turned, "(?!^|$)"), F.lit(0), step) == 1


def valid(kind: str, found: Column) -> Column:
    """What the checksum or range check of a kind says about a proposed string."""
    digits = F.regexp_replace(found, "[^0-9]", "")
    if kind == "ip":
        return ~found.rlike(r"(?:^|\.)0*(?:[1-9][0-9]{3,}|[3-9][0-9]{2}|2[6-9][0-9]|25[6-9])(?:\.|$)")
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), F.call_function("luhn_check", digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "iban":
        return mod97(found)
    if kind == "ssn":
        return found.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$") & ~found.rlike(r"^(?:000|666|9)|-00-|-0000$")
    if kind == "account":
        return F.length(found) <= 12
    if kind == "secret":
        return found.rlike("[0-9]") & found.rlike("[A-Za-z]")
    return F.lit(True)


def names_one(words: str) -> str:
    """An expression for lower-cased text that has one of the words on its own."""
    return f"(?:^|[^a-z0-9])(?:{words})(?:$|[^a-z0-9])"


def context_score(kind: str, before: Column) -> Column:
    """What the words before a span add to its kind's score, in hundredths."""
    near = F.translate(before, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    score = F.lit(VALID_SCORE[kind]) + F.when(near.rlike(names_one(CONTEXT_WORDS[kind])), CONTEXT_SCORE).otherwise(0)
    return F.least(F.lit(100), score - F.when(near.rlike(names_one(EXAMPLE_WORDS)), EXAMPLE_SCORE).otherwise(0))


def find_pii(docs: DataFrame, text_col: str = "text", threshold: float = 0.6) -> DataFrame:
    """Spans of personal data in whole texts.

    Returns the rows of docs with ``pii``: an array of (start, rank, kind, end, score) by start, then
    kind in the order of BASE_KINDS and ADDED_KINDS; an input column of that name gives way. Offsets
    are code points, the end exclusive. Expressions propose, leftmost and not overlapping per kind;
    validators (octets up to 255, Luhn, mod 97, digit counts, ranges of numbers that are given out)
    confirm; the score is the kind's, more where a context word stands in the CONTEXT_POINTS before
    the span (back to what its kind's expression found before it), less where a word of made-up
    examples does. Base kinds stay whatever their score, added kinds from ``threshold`` on, which a
    bank account number with its check digits has unless it is an example, but the others (social
    security and account numbers, secrets) only have with a context word. A null text is empty, an empty text has no spans,
    repeated rows are answered alike, and a text of any length is read whole.

    All in one pass without a shuffle: matches come from regexp_extract_all, their places from the
    lengths of what split leaves between them, which is only done where there are matches.
    """
    docs = without(docs, "pii")
    kinds = [*BASE_KINDS, *ADDED_KINDS]
    names = fresh(docs, "text", *[f"found_{k}" for k in kinds], *[f"gaps_{k}" for k in kinds], *[f"ends_{k}" for k in kinds])
    text = F.col(names["text"])
    df = docs.withColumn(names["text"], text_of(text_col))
    none = F.array().cast("array<string>")
    df = df.withColumns(
        {
            names[f"found_{k}"]: F.when(
                F.contains(text, F.lit(NEEDS[k])) if k in NEEDS else F.lit(True), F.regexp_extract_all(text, F.lit(PATTERNS[k]), F.lit(0))
            ).otherwise(none)
            for k in kinds
        }
    )
    df = df.withColumns({names[f"gaps_{k}"]: F.when(F.size(names[f"found_{k}"]) > 0, F.split(text, PATTERNS[k], -1)) for k in kinds})
    step = lambda gap, m: (F.length(gap) + F.coalesce(F.length(m), F.lit(0))).cast("bigint")
    df = df.withColumns({names[f"ends_{k}"]: F.when(F.size(names[f"found_{k}"]) > 0, running_sums(F.zip_with(names[f"gaps_{k}"], names[f"found_{k}"], step))) for k in kinds})

    def kept(rank: int, k: str) -> Column:
        found, gaps, at = (F.col(names[f"{x}_{k}"]) for x in ("found", "gaps", "ends"))

        def span(m: Column, i: Column) -> Column:
            end = F.get(at, i)
            score = context_score(k, F.right(F.get(gaps, i), F.lit(CONTEXT_POINTS))) / F.lit(100.0)
            return F.struct(
                (end - F.length(m)).cast("bigint").alias("start"), F.lit(rank).alias("rank"), F.lit(k).alias("kind"), end.alias("end"), score.alias("score"), valid(k, m).alias("valid")
            )

        stays = (lambda s: s["valid"]) if k in BASE_KINDS else (lambda s: s["valid"] & (s["score"] >= threshold))
        empty = F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint,score:double,valid:boolean>>")
        return F.when(F.size(found) > 0, F.filter(F.transform(found, span), stays)).otherwise(empty)

    spans = [kept(rank, k) for rank, k in enumerate(kinds)]
    plain = F.transform(F.array_sort(F.concat(*spans)), lambda s: s.dropFields("valid"))
    return df.select(*[F.col(f"`{c}`") for c in docs.columns], plain.alias("pii"))


def span_list(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs and ``pii``, the texts with every span replaced by its kind in brackets.

    Of spans that overlap the first counts. A null text becomes an empty one; repeated rows are
    answered alike, an empty table gives no rows, and an input column ``pii`` gives way.
    """
    found = find_pii(docs, text_col)
    text = text_of(text_col)
    empty = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        head = F.substring(text, acc["at"].cast("int") + 1, (s["start"] - acc["at"]).cast("int"))
        done = F.struct(s["end"].alias("at"), F.concat(acc["out"], head, F.lit("["), s["kind"], F.lit("]")).alias("out"))
        return F.when(s["start"] < acc["at"], acc).otherwise(done)

    rest = lambda acc: F.concat(acc["out"], F.substring(text, acc["at"].cast("int") + 1, 2**31 - 1))
    return found.withColumn(text_col, F.aggregate("pii", empty, step, rest))
