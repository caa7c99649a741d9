"""Personal data by patterns, checksums and context words, in DataFrame functions only.

A pattern proposes spans, a validator (octets of an address, Luhn, mod-97, digit counts)
confirms or drops each, and words near a span raise the score of kinds that need them.
`email`, `ip`, `card` and `phone` stand on pattern and validator alone; `iban` and `ssn` are
reported where their score reaches THRESHOLD.

The patterns are the plain ones written so that no text costs more than linear time or deep
recursion: a run is entered at its first character only, and loops are possessive where
nothing that follows could give a character back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: kind -> (a text that must occur for the pattern to be tried, pattern)
PATTERNS = {
    "email": ("@", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": (".", r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": (None, r"[0-9](?<![0-9][0-9])(?<![0-9][\x20-][0-9])(?:[\x20-]?[0-9]){11,18}(?![\x20-]?[0-9])"),
    "phone": ("+", r"\+[0-9][\x20().0-9-]+[0-9]"),
    "iban": (None, r"[A-Z](?<![A-Za-z0-9][A-Z])[A-Z][0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])"),
    "ssn": ("-", r"[0-9](?<![0-9-][0-9])[0-9]{2}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
}
#: Words that speak for a kind when they stand within CONTEXT code points before the span.
CONTEXT_WORDS = {
    "iban": r"(?i)\b(?:iban|bank|konto|account|compte|cuenta)\b",
    "ssn": r"(?i)\b(?:ssn|social security|tax id|taxpayer)\b",
}
KINDS = tuple(PATTERNS)
CONTEXT = 40
THRESHOLD = 0.5


def _digits(span: Column) -> Column:
    return F.regexp_replace(span, "[^0-9]", "")


def _luhn(span: Column) -> Column:
    digits = F.reverse(_digits(span))

    def weighed(k: Column) -> Column:
        d = F.substring(digits, k, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(k % 2 == 1, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda acc, k: acc + weighed(k)) % 10 == 0


def _mod97(span: Column) -> Column:
    plain = F.replace(span, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))

    def step(acc: Column, k: Column) -> Column:
        code = F.ascii(F.substring(turned, k, F.lit(1)))
        return F.when(code < 65, acc * 10 + code - 48).otherwise(acc * 100 + code - 55) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1


def _valid(kind: str, span: Column) -> Column:
    """Whether a span passes its kind's validator."""
    if kind == "ip":
        return F.forall(F.split(span, r"\."), lambda p: F.coalesce(p.try_cast("int"), F.lit(256)) <= 255)
    if kind == "card":
        return _luhn(span)
    if kind == "phone":
        return F.length(_digits(span)).between(9, 15)
    if kind == "iban":
        return _mod97(span)
    if kind == "ssn":
        return ~F.substring(span, 1, 3).isin("000", "666") & (F.substring(span, 1, 1) != "9") & (F.substring(span, 5, 2) != "00") & (F.substring(span, 8, 4) != "0000")
    return F.lit(True)


def _score(kind: str, valid: Column, near: Column) -> Column:
    """0 to 1: what pattern, validator and context say together."""
    if kind not in CONTEXT_WORDS:
        return F.when(valid, 1.0).otherwise(0.0)
    alone, by_context = {"iban": (0.8, 0.2), "ssn": (0.3, 0.5)}[kind]
    return F.when(valid, F.lit(alone) + F.when(near.rlike(CONTEXT_WORDS[kind]), by_context).otherwise(0.0)).otherwise(0.0)


def _found(kind: str, text: Column) -> Column:
    """All confirmed spans of a kind: array of (start, rank, kind, end, score), in code points."""
    hint, pattern = PATTERNS[kind]
    spans = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    # Walks gaps and matches together; `at` is the end of the last match.
    empty = F.expr("cast(array() as array<struct<start:int,rank:int,kind:string,end:int,score:double>>)")

    def step(acc: Column, k: Column) -> Column:
        span, start = k["span"], acc["at"] + k["gap"]
        end = start + F.length(span)
        near = F.substring(text, F.greatest(start - CONTEXT, F.lit(0)) + 1, F.least(start, F.lit(CONTEXT)))
        score = _score(kind, _valid(kind, span), near)
        one = F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), F.lit(kind).alias("kind"), end.alias("end"), score.alias("score"))
        return F.struct(end.alias("at"), F.when(score >= THRESHOLD, F.concat(acc["out"], F.array(one))).otherwise(acc["out"]).alias("out"))

    pairs = F.zip_with(spans, F.slice(gaps, F.lit(1), F.size(spans)), lambda s, g: F.struct(s.alias("span"), g.alias("gap")))
    found = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), empty.alias("out")), step)["out"]
    tried = F.contains(text, F.lit(hint)) if hint else F.lit(True)
    return F.when(tried & text.rlike(pattern), found).otherwise(empty)


def find_spans(docs: DataFrame) -> DataFrame:
    """Adds `found`: sorted spans (start, rank, kind, end, score) of each text; null texts have none."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumn("found", F.array_sort(F.concat(*[_found(k, text) for k in KINDS])))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, counts and digests of the spans, one row for each input row.

    Null texts count as empty: no spans, and the digest of the empty string.  Null or repeated
    ids and further columns (a column `found` too) are no matter.
    """
    spans = find_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))

    def n(kind: str) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("found", lambda s: s["rank"] < 4)
    scores = F.array_join(F.transform("found", lambda s: F.format_number(s["score"], 2)), ",")
    return spans.select("doc_id", n("email"), n("ip"), n("card"), n("phone"), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"), scores.alias("scores"))


def redact(docs: DataFrame) -> DataFrame:
    """The same rows and columns; each span of personal data becomes its kind in brackets.

    Overlapping spans become one, named after the first.  n_chars, where there, is counted anew
    for changed texts.  Null texts stay null.
    """
    if "found" in docs.columns:  # a column of that name is the caller's
        return redact(docs.withColumnRenamed("found", "found_before")).withColumnRenamed("found_before", "found")
    spans = find_spans(docs)
    text = F.col("text")

    def step(acc: Column, s: Column) -> Column:
        whole = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], whole).otherwise(acc["out"]).alias("out"))

    walked = F.aggregate("found", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step)
    done = F.concat(walked["out"], F.substring(text, walked["at"] + 1, F.length(text)))
    spans = spans.withColumn("text", F.when(F.size("found") > 0, done).otherwise(text))
    if "n_chars" in docs.columns:
        spans = spans.withColumn("n_chars", F.when(F.size("found") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return spans.select(*docs.columns)
