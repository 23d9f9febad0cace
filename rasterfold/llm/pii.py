"""Personal data: regular expressions propose spans, checksums confirm them, nearby words weigh them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterfold.llm.common import text_of

#: Kinds in the order in which spans of one start are listed; the first four are the base.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
#: Fixed patterns. Possessive quantifiers and the looks behind change no match; they keep long runs
#: of one class linear and free of recursion.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: A character or word without which a text has no match, to skip the patterns.
NEEDS = {"email": "@", "ip": ".", "phone": "+", "ssn": "-"}
#: What a kind scores by itself, and words before a span that raise the score.
BASE_SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.3}
CONTEXT = {
    "email": ("mail", "contact"), "ip": ("ip", "address", "server", "host"), "card": ("card", "visa", "credit", "payment"),
    "phone": ("phone", "tel", "call", "mobile", "fax"), "iban": ("iban", "account", "bank"), "ssn": ("ssn", "social", "security"),
}
CONTEXT_CHARS, CONTEXT_BONUS, LEAST_SCORE = 40, 0.3, 0.5


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _mod_97(hit: Column) -> Column:
    """The remainder of ISO 13616: four characters to the back, letters as 10 to 35."""
    plain = F.replace(hit, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(plain, F.lit(5)), F.substring(plain, 1, 4))
    value = lambda c: F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1
    step = lambda acc, c: F.pmod(acc * F.when(value(c) > 9, 100).otherwise(10) + value(c), F.lit(97))
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda acc, c: F.when(c == "", acc).otherwise(step(acc, c)))


def _confirmed(kind: str, hit: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(hit, r"\."), lambda part: part.cast("double") <= 255)
    if kind == "card":
        return F.length(_digits(hit)).between(12, 19) & F.call_function("luhn_check", _digits(hit))
    if kind == "phone":
        return F.length(_digits(hit)).between(9, 15)
    if kind == "iban":
        return F.length(F.replace(hit, F.lit(" "), F.lit(""))).between(15, 34) & (_mod_97(hit) == 1)
    if kind == "ssn":
        return ~F.substring(hit, 1, 3).isin("000", "666") & (F.substring(hit, 1, 1) != "9") & (F.substring(hit, 5, 2) != "00") & (F.substring(hit, 8, 4) != "0000")
    return F.lit(True)


def _spans(kind: str, text: Column) -> Column:
    """Confirmed matches of one kind: start, order, end, score.

    The text is split at the matches, so that running sums of lengths give their places.
    """
    pattern = PATTERNS[kind]
    hits, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    pairs = F.zip_with(hits, F.slice(gaps, 1, F.size(hits)), lambda hit, gap: F.struct(hit.alias("hit"), gap.alias("gap")))
    empty = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,score:double>>")
    words = "(^|[^a-z])(" + "|".join(CONTEXT[kind]) + ")"

    def step(acc, pair):
        start = acc["at"] + F.length(pair["gap"])
        end = start + F.length(pair["hit"])
        near = F.lower(F.right(pair["gap"], F.lit(CONTEXT_CHARS))).rlike(words)
        score = F.round(F.least(F.lit(1.0), F.lit(BASE_SCORE[kind]) + F.when(near, CONTEXT_BONUS).otherwise(0.0)), 2)
        span = F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), end.alias("end"), score.alias("score"))
        keep = _confirmed(kind, pair["hit"]) & ((score >= LEAST_SCORE) if kind in KINDS[4:] else F.lit(True))
        return F.struct(end.alias("at"), F.when(keep, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    found = F.aggregate(pairs, F.struct(F.lit(0).cast("bigint").alias("at"), empty.alias("spans")), step, lambda acc: acc["spans"])
    needed = F.contains(text, F.lit(NEEDS[kind])) if kind in NEEDS else text.rlike(pattern)
    return F.when(needed, found).otherwise(empty)


def find_pii(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, and spans, an array of start, kind, end, score.

    Offsets count code points, ends are exclusive, spans are ordered by start and then kind. Base
    kinds are e-mail addresses, IP addresses, card numbers (Luhn) and phone numbers: every confirmed
    match is kept, and words before it only raise its score. IBANs (mod-97) and social security
    numbers come on top; the latter score enough only next to words that name them. A null or
    empty text has no spans; rows that repeat are answered alike; other columns are ignored.
    All of it is one projection: no shuffle.
    """
    return _marked(docs.select("doc_id", "text")).select("doc_id", F.col("_spans").alias("spans"))


def _marked(docs: DataFrame) -> DataFrame:
    """docs with its spans in a column _spans."""
    found = docs.withColumn("_text", text_of())
    for kind in KINDS:
        found = found.withColumn(f"_{kind}", _spans(kind, F.col("_text")))
    return found.withColumn("_spans", F.array_sort(F.concat(*(f"_{k}" for k in KINDS))))


def _listed(spans: Column) -> Column:
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def pii_report(docs: DataFrame) -> DataFrame:
    """Counts per base kind, a digest of the base spans, all spans as text, and the highest score (null: none)."""
    found = find_pii(docs)
    base = F.filter("spans", lambda s: s["kind"] < 4)

    def count(k: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")

    counts = [count(k) for k in range(4)]
    highest = F.array_max(F.transform("spans", lambda s: s["score"]))
    return found.select("doc_id", *counts, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"), highest.alias("max_score"))


def redact(docs: DataFrame) -> DataFrame:
    """docs with each found span replaced by its kind in brackets; overlapping spans go as the first of them."""
    name = F.array(*map(F.lit, KINDS))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))
    text = F.col("_text")

    def step(acc, s):
        piece = F.concat(acc["out"], F.substr(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit("["), F.element_at(name, s["kind"] + 1), F.lit("]"))
        return F.when(s["start"] < acc["at"], acc).otherwise(F.struct(s["end"].alias("at"), piece.alias("out")))

    clean = F.aggregate("_spans", start, step, lambda acc: F.concat(acc["out"], F.substr(text, (acc["at"] + 1).cast("int"))))
    return _marked(docs).withColumn("text", clean).select(*docs.columns)


def _sql_kind(k: int, kind: str, pattern: str, keep: str) -> str:
    words = "|".join(CONTEXT[kind])
    return f"""
  SELECT r, start, {k} AS kind, start + length(hit) AS fin, least(1.0, {BASE_SCORE[kind]} + CASE WHEN near THEN {CONTEXT_BONUS} ELSE 0 END)::DOUBLE AS score, hit
  FROM (
    SELECT r, hit, (sum(length(gap) + length(hit)) OVER (PARTITION BY r ORDER BY i) - length(hit))::BIGINT AS start,
           regexp_matches(lower(right(gap, {CONTEXT_CHARS})), '(^|[^a-z])({words})') AS near
    FROM (SELECT r, generate_subscripts(hits, 1) AS i, unnest(hits) AS hit, unnest(gaps[1:len(hits)]) AS gap
          FROM (SELECT r, regexp_extract_all(text, '{pattern}') AS hits, string_split_regex(text, '{pattern}') AS gaps FROM d WHERE regexp_matches(text, '{pattern}'))))
  WHERE {keep}"""


_DIGITS = "regexp_replace(hit, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(string_split({_DIGITS}, ''), lambda c, j: CASE WHEN (length({_DIGITS}) - j) % 2 = 0 THEN c::INT ELSE c::INT * 2 // 10 + c::INT * 2 % 10 END)) % 10 = 0"
_PLAIN = "replace(hit, ' ', '')"
_TURNED = f"string_split(substr({_PLAIN}, 5) || substr({_PLAIN}, 1, 4), '')"
_VALUES = f"list_transform({_TURNED}, lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN c::INT ELSE ascii(c) - 55 END)"
_MOD_97 = f"list_reduce(list_prepend(0, {_VALUES}), lambda a, b: (a * CASE WHEN b > 9 THEN 100 ELSE 10 END + b) % 97) = 1"
#: The plain patterns of the contract; RE2 needs no possessive quantifiers, and knows no looks
#: around, which the boundary \b replaces for the added kinds.
_SQL = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "list_bool_and(list_transform(string_split(hit, '.'), lambda p: p::DOUBLE <= 255))"),
    ("card", r"[0-9]([\x20-]?[0-9])+", f"length({_DIGITS}) BETWEEN 12 AND 19 AND {_LUHN}"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 9 AND 15"),
    ("iban", r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b", f"length({_PLAIN}) BETWEEN 15 AND 34 AND {_MOD_97}"),
    ("ssn", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", "near AND hit[1:3] NOT IN ('000', '666') AND hit[1] <> '9' AND hit[5:6] <> '00' AND hit[8:] <> '0000'"),
)
_CASE = "CASE kind " + " ".join(f"WHEN {k} THEN '{name}'" for k, name in enumerate(KINDS)) + " END || ':' || start || ':' || fin"
PII_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
f AS ({" UNION ALL ".join(_sql_kind(k, *x) for k, x in enumerate(_SQL))}),
g AS (
  SELECT r, {", ".join(f"count(*) FILTER (kind = {k}) AS n_{KINDS[k]}" for k in range(4))},
         string_agg({_CASE}, ',' ORDER BY start, kind) FILTER (kind < 4) AS base,
         string_agg({_CASE}, ',' ORDER BY start, kind) AS spans, max(score) AS max_score
  FROM f GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in KINDS[:4])},
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, max_score
FROM d LEFT JOIN g USING (r)
"""
