"""Importance resampling towards a target distribution, over hashed n-grams from a position table.

The words of each document are exploded with their positions; for longer features ``lead`` over
a document's positions puts the following words beside each.  Features are hashed into
``buckets``, and a bucket's gain is a thousand times the logarithm of how much likelier it is in
the target than in the documents, smoothed by one for each bucket.  A document's weight is the
mean gain of its features, and the sample is drawn without replacement: noise of a Gumbel
distribution, fixed by seed and id, is added to each weight and the largest sums win.

Counts are summed in each task before they are shuffled, and so are the gains of a document's
features.  Gains are broadcast: one row for each bucket at most, whatever the input.

Ranks need no global sort.  Scores are whole numbers in a narrow range (a gain's size is below
``1000 * ln(2**64 * buckets)``, the noise lies between -3,200 and 23,000: at most 140,000 values
for 10,000 buckets), so a histogram of them tells how many documents stand above each score and
where the draw ends; it is broadcast for its proven size.  Documents of one score are ordered among
themselves.  The noise spreads even equal texts over thousands of scores.

Defined results: a null text has no words, features or gains: weight 0; a null id reads as '' for the noise
and comes last among equal scores; repeated rows are documents of their own (rows with one id and
text have one score and neighbouring ranks); texts of any length are read whole; columns besides id and
text, whatever their names, are not read; an empty table gives an empty result; an empty target
gives every feature its smoothed gain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import materialize, table
from .urls import LOWER, UPPER

ORDERS, BUCKETS, SEED, LEAST_WORDS, PERCENT = (1, 1), 10_000, 2024, 20, 10
#: A word, before its capitals A-Z are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]++"
#: Scores that a coarse bin of the histogram holds.
BIN = 512


def position_table(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep``, ``n_words``, and a row for each word: ``pos`` (from 0) and ``word``; one row with nulls if there is none."""
    words = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(WORD), F.lit(0))
    each = docs.select(*keep, words.alias("words")).select(*keep, F.size("words").alias("n_words"), F.posexplode_outer("words").alias("pos", "raw"))
    # only words beyond ASCII need the slow way; it leaves all but A-Z alone
    plain = F.octet_length("raw") == F.length("raw")
    return each.select(*keep, "n_words", "pos", F.when(plain, F.lower("raw")).otherwise(F.translate("raw", UPPER, LOWER)).alias("word"))


def features(words: DataFrame, keep: list[str], key: str, orders: tuple[int, int]) -> DataFrame:
    """``keep`` and ``feature``: each run of ``orders[0]`` to ``orders[1]`` following words; a null where a document has none."""
    first, last = orders
    if last == 1:
        return words.select(*keep, F.col("word").alias("feature"))
    w = Window.partitionBy(key).orderBy("pos")
    beside = words.select(*keep, "word", *[F.lead("word", k).over(w).alias(f"next{k}") for k in range(1, last)])
    gram = lambda n: F.concat(*[c for k in range(n) for c in ([F.lit(" "), F.col(f"next{k}")] if k else [F.col("word")])])
    # beyond the end a run is null
    whole = F.filter(F.array(*[gram(n) for n in range(first, last + 1)]), lambda g: g.isNotNull())
    return beside.select(*keep, F.explode_outer(whole).alias("feature"))


def bucket(feature: Column, buckets: int) -> Column:
    return (F.crc32(feature.cast("binary")) % buckets).cast("int")


def _featured(docs: DataFrame, keep: list[str], orders: tuple[int, int], buckets: int) -> DataFrame:
    found = features(position_table(docs, keep), [*keep, "n_words"], keep[0], orders)
    return found.select(*keep, "n_words", bucket(F.col("feature"), buckets).alias("bucket"))


def bucket_gains(docs: DataFrame, target: DataFrame, orders: tuple[int, int], buckets: int) -> DataFrame:
    """``bucket, gain`` of every bucket that the documents use."""

    def counts(rows: DataFrame, name: str) -> DataFrame:
        held = _featured(rows.select(F.monotonically_increasing_id().alias("row"), "text"), ["row"], orders, buckets)
        return held.where("bucket is not null").groupBy("bucket").agg(F.count("*").alias(name))

    s, t = materialize(counts(docs, "s"), "gain-docs"), materialize(counts(target, "t"), "gain-target")
    total = lambda d, name: F.broadcast(d.agg(F.coalesce(F.sum(name), F.lit(0)).alias(f"{name}_all")))
    both = s.join(t, "bucket", "left").crossJoin(total(s, "s")).crossJoin(total(t, "t"))
    one = lambda name: F.col(name).cast("double")
    t1 = F.coalesce(one("t"), F.lit(0.0)) + 1
    ratio = t1 * (one("s_all") + buckets) / ((one("s") + 1) * (one("t_all") + buckets))
    return materialize(both.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain")), "gains")


def scored_documents(docs: DataFrame, gains: DataFrame, orders: tuple[int, int], buckets: int, seed: int) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score`` of each row."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    each = _featured(rows, ["row", "doc_id"], orders, buckets).join(F.broadcast(gains), "bucket", "left")
    summed = each.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.count("bucket").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).alias("total"))
    # whole numbers, rounded down
    weight = F.when(F.col("n_features") > 0, F.expr("(total - pmod(total, n_features)) div n_features")).otherwise(F.lit(0).cast("long"))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    return summed.select("doc_id", "n_words", "n_features", weight.alias("weight")).withColumn("score", F.col("weight") + noise)


def draw(scored: DataFrame, least_words: int, percent: int) -> DataFrame:
    """``rank`` (from 1) of the drawn rows, null for the others."""
    fit = F.col("n_words") >= least_words
    held = materialize(scored.where(fit).groupBy("score").agg(F.count("*").alias("n")), "score-histogram")
    coarse = F.floor(F.col("score") / BIN)
    bins = held.groupBy(coarse.alias("bin")).agg(F.sum("n").alias("n"))
    above = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bins = bins.select("bin", above(Window.orderBy(F.col("bin").desc())).alias("above_bin"))
    inside = held.select("score", coarse.alias("bin"), above(Window.partitionBy(coarse).orderBy(F.col("score").desc())).alias("above_in"))
    most = held.agg(F.floor(F.coalesce(F.sum("n"), F.lit(0)) * percent / 100).alias("most"))
    places = inside.join(F.broadcast(bins), "bin").crossJoin(F.broadcast(most)).select("score", (F.col("above_bin") + F.col("above_in")).alias("above"), "most")
    near = scored.where(fit).join(F.broadcast(places.where("above < most")), "score")
    place = F.col("above") + F.row_number().over(Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last()))
    ranked = near.withColumn("rank", place).withColumn("rank", F.when(F.col("rank") <= F.col("most"), F.col("rank")))
    columns = ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    rest = scored.where(~fit).unionByName(scored.where(fit).join(F.broadcast(places.where("above >= most").select("score")), "score", "left_semi"))
    return ranked.select(*columns).unionByName(rest.withColumn("rank", F.lit(None).cast("long")).select(*columns))


def resample(docs: DataFrame, target: DataFrame, orders: tuple[int, int] = ORDERS, buckets: int = BUCKETS, seed: int = SEED, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, rank`` of every document."""
    if not 1 <= orders[0] <= orders[1]:
        raise ValueError("orders go from 1 up")
    gains = bucket_gains(docs, target, orders, buckets)
    return draw(materialize(scored_documents(docs, gains, orders, buckets, seed), "scored"), least_words, percent)


def op13_position_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def _oracle() -> str:
    """The same from DuckDB, which has no crc32: it is folded over the bytes of each distinct word."""
    words = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    bit = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END"
    # eight steps for each entry of the usual table
    steps = "i::BIGINT"
    for _ in range(8):
        steps = f"list_transform([{steps}], lambda c: {bit})[1]"
    octets = "list_transform(range(1, octet_length(encode(w)) + 1), lambda k: ('0x' || hex(encode(w))[2 * k - 1:2 * k])::BIGINT)"
    crc = f"xor(list_reduce({octets}, lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT)"
    return rf"""WITH crc AS (SELECT i, {steps} AS v FROM range(256) r(i)),
d AS (SELECT row_number() OVER () AS k, doc_id, {words} AS ws FROM documents), b AS (SELECT {words} AS ws FROM benchmark),
dw AS (SELECT k, unnest(ws) AS w FROM d), bw AS (SELECT unnest(ws) AS w FROM b),
named AS (SELECT w, ({crc} % {BUCKETS})::INT AS bucket FROM (SELECT w FROM dw UNION SELECT w FROM bw), (SELECT list(v ORDER BY i) AS tab FROM crc)),
s AS (SELECT bucket, count(*) AS s FROM dw JOIN named USING (w) GROUP BY 1), t AS (SELECT bucket, count(*) AS t FROM bw JOIN named USING (w) GROUP BY 1),
g AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT sum(s) FROM s) + {BUCKETS})::DOUBLE / ((s + 1)::DOUBLE * (coalesce((SELECT sum(t) FROM t), 0) + {BUCKETS})::DOUBLE)))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket)),
f AS (SELECT k, sum(gain)::BIGINT AS total FROM dw JOIN named USING (w) JOIN g USING (bucket) GROUP BY k),
x AS (SELECT doc_id, len(ws) AS n, coalesce(total, 0) AS total, ('0x' || sha256('{SEED}:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT AS h FROM d LEFT JOIN f USING (k)),
y AS (SELECT doc_id, n::BIGINT AS n_features, CASE WHEN n = 0 THEN 0 ELSE (total - ((total % n) + n) % n) // n END::BIGINT AS weight, h FROM x),
z AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM y),
r AS (SELECT *, row_number() OVER (PARTITION BY n_features >= {LEAST_WORDS} ORDER BY score DESC, doc_id NULLS LAST) AS place, count_if(n_features >= {LEAST_WORDS}) OVER () * {PERCENT} // 100 AS most FROM z)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= {LEAST_WORDS} AND place <= most THEN place END AS rank FROM r"""


ORACLE_SQL = _oracle()
