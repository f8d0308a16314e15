"""Personal data: patterns propose spans, checksums confirm them, nearby words set the score.

Everything is a DataFrame expression.  The patterns are written so that no text makes them
slow or deep: possessive repeats never give characters back, and a run of characters is only
tried from its start or from the end of the match before (``\\G``).  Context is read off the
gaps and matches beside a span, so the cost grows with a text's length only.

Base kinds (email, ip, card, phone) are reported whatever their score.  The method adds two
kinds, ``iban`` (as long as its country has it, mod-97) and ``ssn`` (needs a context word), if they reach ``MIN_SCORE``.
``n_email`` to ``n_phone`` and ``base_sha256`` count base spans only.

Defined results: a null text counts as empty and gives a row without spans; spans of different
kinds may overlap; spans of one start are in the order of the kinds; texts of any length are searched
whole; repeated rows give repeated results; columns besides id and text, whatever their names, are
not read; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.arrays import let, match_spans
from .common import table

KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
MIN_SCORE = 0.6
#: Code points before and after a span in which context words count.
CONTEXT = 48
#: No match of a kind's pattern is shorter.
LEAST = {"email": 5, "ip": 7, "card": 2, "phone": 3, "iban": 15, "ssn": 11}

# Patterns of each kind.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Length of an account number by country (the public IBAN registry).
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH CR HR LI LV",
    22: "BG BH DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ DZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_IBAN = "|".join(rf"(?:{'|'.join(codes.split())})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, codes in IBAN_LENGTHS.items())
IBAN = rf"(?<![A-Za-z0-9])(?:{_IBAN})(?![A-Za-z0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"

# Base score of a confirmed span, what a context word adds, and the words.
SCORES = {
    "email": (0.9, 0.1, "mail|contact|write|address"),
    "ip": (0.6, 0.3, "ip|host|server|address|login"),
    "card": (0.7, 0.3, "card|visa|mastercard|credit|debit|payment|tarjeta|carte|karte"),
    "phone": (0.7, 0.3, "phone|call|tel|mobile|fax|whatsapp"),
    "iban": (0.7, 0.3, "iban|account|bank|konto|compte|cuenta"),
    "ssn": (0.3, 0.5, "ssn|social|security|insurance"),
}


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def total(d: Column) -> Column:
        def add(acc: Column, i: Column) -> Column:
            x = F.substring(d, F.length(d) - i, F.lit(1)).cast("int") * (F.lit(1) + i % 2)
            return acc + F.when(x > 9, x - 9).otherwise(x)

        return F.aggregate(F.sequence(F.lit(0), F.length(d) - 1), F.lit(0), add) % 10 == 0

    return let(digits, total)


def mod97(iban: Column) -> Column:
    """Whether an account number (no blanks) leaves 1 when divided by 97."""
    moved = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4))

    def add(acc: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code < 58, acc * 10 + code - 48).otherwise(acc * 100 + code - 55) % 97

    return F.aggregate(F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0), add) == 1


def _is_ip(s: Column) -> Column:
    part = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
    return F.forall(F.split(s, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.substring(part(p), 1, 3).cast("int") <= 255))


def _has_luhn(s: Column) -> Column:
    return let(_digits(s), lambda d: F.when(F.length(d).between(12, 19), luhn(d)).otherwise(F.lit(False)))


def _found(text: Column, kind: str, pattern: str, hint: Column, keep) -> Column:
    """Scored spans of one kind; texts without the hint are not searched."""
    order, (base, more, words) = KINDS.index(kind), SCORES[kind]

    def scored(s: Column) -> Column:
        near = F.concat(s["before"], F.lit(" "), s["after"])
        score = F.when(near.rlike(rf"(?i)(?<![a-z0-9])(?:{words})"), F.lit(base + more)).otherwise(F.lit(base))
        return F.struct(s["start"].alias("start"), F.lit(order).alias("ord"), s["end"].alias("end"), F.lit(kind).alias("kind"), score.alias("score"))

    none = F.array().cast("array<struct<start:bigint,ord:int,end:bigint,kind:string,score:double>>")
    spans = match_spans(text, pattern, CONTEXT, LEAST[kind], keep)
    return F.when(hint, F.transform(spans, scored)).otherwise(none)


def pii_spans(text: Column) -> Column:
    """All base spans and the added spans of ``MIN_SCORE`` or more, by start, then kind."""
    digit = text.rlike("[0-9]{2}")
    # a card's digits may all stand apart
    digits = text.rlike(r"[0-9][\x20-]?[0-9]")
    size = lambda s: F.length(_digits(s))
    yes = lambda s: F.lit(True)
    base = [
        _found(text, "email", EMAIL, F.contains(text, F.lit("@")), yes),
        _found(text, "ip", IP, text.rlike(r"[0-9]\.[0-9]"), _is_ip),
        _found(text, "card", CARD, digits, _has_luhn),
        _found(text, "phone", PHONE, F.contains(text, F.lit("+")), lambda s: size(s).between(9, 15)),
    ]
    added = [
        _found(text, "iban", IBAN, digit, lambda s: mod97(F.replace(s, F.lit(" "), F.lit("")))),
        _found(text, "ssn", SSN, digit, yes),
    ]
    return F.array_sort(F.concat(*base, F.filter(F.concat(*added), lambda s: s["score"] >= MIN_SCORE)))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def find_pii(docs: DataFrame) -> DataFrame:
    """One row per document: base counts and digest, and all spans with their scores."""
    spans = docs.select("doc_id", pii_spans(F.coalesce("text", F.lit(""))).alias("found"))
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("found", lambda s: s["ord"] < 4)
    return spans.select("doc_id", *[count(k) for k in KINDS[:4]], F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"), F.transform("found", lambda s: s["score"]).alias("scores"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    """The same spans by DuckDB's expressions: its engine needs no possessive forms but has no look-around."""
    patterns = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "", ""),
        "ip": (r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "", ""),
        "card": (r"[0-9](?:[\x20-]?[0-9])+", "", ""),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "", ""),
        "iban": (f"(?:{_IBAN})", "^|[^A-Za-z0-9]", "[^A-Za-z0-9]|$"),
        "ssn": (r"[0-9]{3}-[0-9]{2}-[0-9]{4}", "^|[^0-9-]", "[^0-9-]|$"),
    }
    digits = "regexp_replace(hit, '[^0-9]', '', 'g')"
    doubled = f"({digits}[len({digits}) - i])::INT * (1 + i % 2)"
    luhn = f"list_sum(list_transform(range(0, len({digits})), lambda i: CASE WHEN {doubled} > 9 THEN {doubled} - 9 ELSE {doubled} END)) % 10 = 0"
    bare = "replace(hit, ' ', '')"
    mod97 = f"list_reduce(list_transform(string_split({bare}[5:] || {bare}[1:4], ''), lambda c: CASE WHEN ord(c) < 58 THEN ord(c) - 48 ELSE ord(c) - 55 END::BIGINT), lambda a, c: (CASE WHEN c < 10 THEN a * 10 ELSE a * 100 END + c) % 97, 0::BIGINT) = 1"
    keep = {
        "email": "true",
        "ip": "len(list_filter(string_split(hit, '.'), lambda p: len(ltrim(p, '0')) > 3 OR coalesce(try_cast(nullif(ltrim(p, '0'), '') AS INT), 0) > 255)) = 0",
        "card": f"CASE WHEN len({digits}) BETWEEN 12 AND 19 THEN {luhn} ELSE false END",
        "phone": f"len({digits}) BETWEEN 9 AND 15",
        "iban": mod97,
        "ssn": "true",
    }
    parts = []
    for order, kind in enumerate(KINDS):
        (body, before, after), (base, more, words) = patterns[kind], SCORES[kind]
        whole = f"({before})({body})({after})" if before else body
        hits = f"regexp_extract_all(text, '{whole}', 2)" if before else f"regexp_extract_all(text, '{whole}')"
        lead = f"list_transform(regexp_extract_all(text, '{whole}', 1), lambda x: len(x))" if before else "NULL::BIGINT[]"
        near = f"text[greatest(s + 1 - {CONTEXT}, 1):s] || ' ' || text[s + len(hit) + 1:s + len(hit) + {CONTEXT}]"
        parts.append(f"""SELECT doc_id, {order} AS ord, '{kind}' AS kind, s, s + len(hit) AS e, CASE WHEN regexp_matches({near}, '(?i)(?:^|[^a-z0-9])(?:{words})') THEN {base}::DOUBLE + {more}::DOUBLE ELSE {base}::DOUBLE END AS score
  FROM (SELECT doc_id, text, hits[i] AS hit, (list_sum(list_transform(gaps[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(alls[1:i - 1], lambda x: len(x))), 0) + coalesce(leads[i], 0))::BIGINT AS s
    FROM (SELECT doc_id, text, {hits} AS hits, regexp_extract_all(text, '{whole}') AS alls, string_split_regex(text, '{whole}') AS gaps, {lead} AS leads, unnest(range(1, len({hits}) + 1)) AS i FROM d))
  WHERE {keep[kind]}""")
    spans = " UNION ALL ".join(parts)
    count = ", ".join(f"coalesce(count_if(kind = '{k}'), 0)::BIGINT AS n_{k}" for k in KINDS[:4])
    joined = lambda where: f"coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ord, e) FILTER (WHERE {where}), '')"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), found AS (SELECT * FROM ({spans}) WHERE ord < 4 OR score >= {MIN_SCORE})
SELECT d.doc_id, {count}, sha256({joined("ord < 4")}) AS base_sha256, {joined("ord >= 0")} AS spans, coalesce(list(score ORDER BY s, ord, e) FILTER (WHERE ord >= 0), []) AS scores FROM d LEFT JOIN found USING (doc_id) GROUP BY d.doc_id"""


ORACLE_SQL = _oracle()
