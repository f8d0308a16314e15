"""Secret scan: a pattern proposes, a random forest removes false positives.

Candidates are runs of 16 or more characters of the kind that keys are made of, if they hold a
digit, change from small to capital letters, or stand where a secret is assigned.  A forest
judges each by its length, the changes between kinds of characters, its coverage by a
dictionary, where it was found and the words beside it.  Patterns, features and scoring are
DataFrame expressions and the forest of Spark's own library: no Python runs on executors.

The dictionary is a table: the ``DICTIONARY`` words that most documents of the corpus hold,
counted over all of them, beside a fixed list of usual words in names.  Coverage is measured
by the longest match at each place.

The forest is trained on labelled findings (``candidate, before, after, path, label``).  Those
of ``labelled_findings`` are made by rule of neutral words and paths, ``LABELLED`` rows: keys
of several kinds in assignments, against digests, identifiers, placeholders, numbers and words
in their usual surroundings.  A caller may pass reviewed findings of its own instead; at most
``LABELLED`` rows of them are read, those of the smallest hashes.

Defined results: a null or empty text has no findings; each finding is one row with its span
in code points, end exclusive; a null path counts as empty; repeated rows give repeated
findings; of words in equally many documents the dictionary takes those that sort first; a
candidate of any length is one finding; other columns, whatever their names, are not read;
empty tables give empty results.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.arrays import match_spans
from .common import materialize, table

#: Characters before and after a candidate that are looked at.
BESIDE = 32
LEAST = 16
LABELLED, TREES, DEPTH, THRESHOLD = 6000, 24, 6, 0.5
#: Words of the corpus in the dictionary, and the least letters of one.
DICTIONARY, WORD_LETTERS = 4000, 4

# What a candidate looks like, usual words in names, and telling words.
RUN = rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{LEAST},}}+={{0,2}}"
USUAL = (
    "able access account action active address admin agent alert alpha answer apple array asset async author back base battery before beta block blue board body book branch bridge build button cache call card "
    "chain change check child city class clear click client clock close cloud code color column common config configuration connect contact content context control copy core correct count create current custom "
    "data date default delete description detail device dialog direct display document domain down edit email empty engine error event example export factory field file filter final find first folder force form "
    "format frame from full function gate general group handler hash head health height horse hidden host icon image import index info input instance item java join label last layer layout left level library "
    "line link list listing local location lock login main manager master match menu message method middle mode model module month mouse name native network node note number object offset option order output "
    "owner page panel parent parse path player point policy post power print process product profile program project property provider public query queue random range read record region remote render report "
    "request reset resource response result return right role root route rule sample save scale scan schema screen script search section select send sequence serial server service session setting setup shape "
    "share shell signal simple size sort source space staple stack start state status step stop storage store stream string style submit system table target task team template test text theme thread time "
    "title toggle token tool total track tree trigger type unique unit update upload user util value vector version video view visible wait watch water white width window word work world write year zone"
).split()
ASSIGNS = r"(?i)(?:token|secret|passw|pwd|api.?key|access.?key|private|auth|bearer|credential|client.?id|sig)[a-z_\"' -]{0,12}[:=]\s*[\"']?$"
SECRETIVE = r"(?i)token|secret|passw|pwd|key|auth|bearer|credential"
HARMLESS = r"(?i)sha|md5|digest|checksum|commit|hash|uuid|guid|revision|etag|integrity|build|isbn|order|invoice|card|phone"
EXAMPLE = r"(?i)example|sample|dummy|fake|test|mock|placeholder|changeme|xxxx|your"
EXAMPLE_PATH = r"(?i)test|example|mock|fixture|sample|doc|vendor|lock"

FEATURES = ("length", "changes", "digit_share", "upper_share", "mark_share", "hex_only", "distinct_share", "covered", "assigned", "secretive", "harmless", "example", "example_path", "uuid_form", "quoted")


def common_words(docs: DataFrame, size: int = DICTIONARY) -> DataFrame:
    """``word, docs``: the words of most documents, counted over all of them."""
    # possessive, so that a run of letters is read once
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(rf"(?<![a-z])[a-z]{{{WORD_LETTERS},32}}+(?![a-z])"), F.lit(0)))
    each = docs.where("text is not null").select(F.explode(words).alias("word"))
    return each.groupBy("word").agg(F.count("*").alias("docs")).orderBy(F.desc("docs"), "word").limit(size)


def longest_match(words: list[str]) -> str:
    """A pattern that matches the longest of ``words`` at a place: their tree of letters."""
    tree: dict = {}
    for w in words:
        node = tree
        for c in w:
            node = node.setdefault(c, {})
        node[""] = {}

    def written(node: dict) -> str:
        longer = [c + written(n) for c, n in sorted(node.items()) if c]
        if not longer:
            return ""
        body = longer[0] if len(longer) == 1 and "" not in node else f"(?:{'|'.join(longer)})"
        return body + ("?" if "" in node else "")

    return written(tree)


def dictionary(docs: DataFrame) -> str:
    """The pattern of the corpus's dictionary and the usual words."""
    held = materialize(common_words(docs), "secret-words").select("word").collect()  # DICTIONARY words at most
    return longest_match(sorted({*USUAL, *(r.word for r in held)}))


def features(c: Column, before: Column, after: Column, path: Column, words: str) -> dict[str, Column]:
    """The forest's inputs for a candidate, its surroundings and its path."""
    n = F.length(c).cast("double")
    share = lambda kind: F.length(F.regexp_replace(c, f"[^{kind}]", "")) / n
    flag = lambda x: x.cast("double")
    change = r"(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])|(?<=[^A-Za-z0-9])(?=[A-Za-z0-9])"
    return {
        "length": F.least(n, F.lit(256.0)),
        "changes": (F.length(F.regexp_replace(c, change, " ")) - n) / n,
        "digit_share": share("0-9"),
        "upper_share": share("A-Z"),
        "mark_share": share("+/_=-"),
        "hex_only": flag(c.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")),
        "distinct_share": F.size(F.array_distinct(F.split(c, ""))) / F.least(n, F.lit(64.0)),
        "covered": 1 - F.length(F.regexp_replace(F.lower(c), words, "")) / n,
        "assigned": flag(before.rlike(ASSIGNS)),
        "secretive": flag(before.rlike(SECRETIVE)),
        "harmless": flag(F.concat(before, F.lit(" "), after).rlike(HARMLESS)),
        "example": flag(F.concat(before, c, after).rlike(EXAMPLE)),
        "example_path": flag(path.rlike(EXAMPLE_PATH)),
        "uuid_form": flag(c.rlike("^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")),
        "quoted": flag(before.rlike("[\"'`]$") & after.rlike("^[\"'`]")),
    }


def candidates(docs: DataFrame, path: Column) -> DataFrame:
    """``doc_id, start, end, candidate, before, after, path`` of every proposal."""
    found = docs.select("doc_id", "text", F.coalesce(path.cast("string"), F.lit("")).alias("path")).where(F.col("text").rlike(f"[A-Za-z0-9+/_-]{{{LEAST}}}"))
    each = found.select("doc_id", "path", F.explode(match_spans(F.col("text"), RUN, BESIDE, LEAST)).alias("s"))
    named = each.select("doc_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("s.text").alias("candidate"), F.col("s.before").alias("before"), F.col("s.after").alias("after"), "path")
    return named.where(F.col("candidate").rlike("[0-9]|[a-z][A-Z]") | F.col("before").rlike(ASSIGNS))


def labelled_findings(spark: SparkSession, rows: int = LABELLED, first: int = 0) -> DataFrame:
    """Labelled findings made by rule, numbers ``first`` and after; the same on every run."""
    i = F.col("id")
    h = lambda salt, bits=256: F.sha2(F.concat(F.lit(salt), i.cast("string")), bits)
    pick = lambda salt, *of: F.element_at(F.array(*[x if isinstance(x, Column) else F.lit(x) for x in of]), (F.pmod(F.xxhash64(F.lit(salt), i), F.lit(len(of))) + 1).cast("int"))
    mixed = lambda n, salt="m": F.substring(F.regexp_replace(F.base64(F.unhex(h(salt, 512))), r"[^A-Za-z0-9]", ""), 1, n)
    letters = lambda salt: F.translate(h(salt), "0123456789", "ghijklmnop")
    some_words = [pick(f"w{k}", *USUAL) for k in range(4)]
    words = F.concat_ws("_", *some_words[:3])
    uuid = F.concat_ws("-", F.substring(h("u"), 1, 8), F.substring(h("u"), 9, 4), F.substring(h("u"), 13, 4), F.substring(h("u"), 17, 4), F.substring(h("u"), 21, 12))
    name = pick("n", "token", "api_key", "secret", "password", "client_secret", "access_key", "auth_token", "private_key")
    secret = pick(
        "s", F.substring(h("a"), 1, 40), F.substring(h("b"), 1, 32), F.substring(h("c"), 1, 64), mixed(20), mixed(32), mixed(40), F.concat(F.lit("AKIA"), F.upper(mixed(16))), F.concat(F.lit("ghp_"), mixed(36)),
        F.substring(letters("l"), 1, 24), F.upper(F.substring(letters("o"), 1, 32)), F.concat(some_words[0], some_words[1], some_words[2], some_words[3]),
    )
    told = pick("t", F.concat(name, F.lit(' = "')), F.concat(name, F.lit(": ")), F.concat(F.lit("with the "), name, F.lit('="')), F.lit("Authorization: Bearer "), F.concat(F.lit("here is "), name, F.lit(" = '")))
    plain = pick("p", "and then the ", "it says ", "see ", "https://example.org/", "in the file ")
    harmless = pick("h", "commit ", "sha256: ", "md5 checksum = ", "uuid ", "etag: ", "build ", "card ", "order number ")
    no = pick(
        "k",
        F.struct(pick("k1", F.substring(h("d"), 1, 40), h("e")).alias("c"), harmless.alias("b")),
        F.struct(uuid.alias("c"), pick("k2", harmless, plain).alias("b")),
        F.struct(F.concat(words, F.lit("_"), (i % 97).cast("string")).alias("c"), pick("k3", plain, told).alias("b")),
        F.struct(F.concat(F.lit("your-token-here-xxxx-"), (i % 10).cast("string")).alias("c"), told.alias("b")),
        F.struct(F.rpad(F.translate(h("f"), "abcdef", "123456"), 16, "0").alias("c"), pick("k4", harmless, plain).alias("b")),
        F.struct(F.concat(F.lit("path/to/"), words, F.lit("/v"), (i % 7).cast("string")).alias("c"), plain.alias("b")),
        F.struct(F.concat(F.repeat(F.lit("x"), 18), (i % 10).cast("string")).alias("c"), told.alias("b")),
        F.struct(F.concat(*[F.initcap(w) for w in some_words]).alias("c"), pick("k5", plain, harmless).alias("b")),
    )
    label = (i % 2).cast("double")
    good, bad = pick("pa", "app/main", "conf/prod", "lib/core", "src/start", ""), pick("pb", "tests/data", "docs/guide", "vendor/x", "src/start", "")
    both = spark.range(first, first + rows, numPartitions=2).select(label.alias("label"), F.when(label == 1, F.struct(secret.alias("c"), told.alias("b"))).otherwise(no).alias("x"), good.alias("good"), bad.alias("bad"), pick("z", " then ", "\n", ", and ", "").alias("z"))
    quote = F.when(F.col("x.b").rlike("[\"']$"), F.substring(F.col("x.b"), -1, 1)).otherwise(F.lit(""))
    before = F.when(F.length("x.b") > BESIDE, F.substring(F.col("x.b"), -BESIDE, BESIDE)).otherwise(F.col("x.b"))
    return both.select(F.col("x.c").alias("candidate"), before.alias("before"), F.concat(quote, "z").alias("after"), F.when(F.col("label") == 1, F.col("good")).otherwise(F.col("bad")).alias("path"), "label")


def train(labelled: DataFrame, words: str, seed: int = 11) -> PipelineModel:
    """A forest of bounded size from at most ``LABELLED`` rows."""
    some = labelled.where("candidate is not null and label is not null").orderBy(F.xxhash64("candidate", "before", "label"), "candidate", "before", "label").limit(LABELLED)
    known = [F.coalesce(F.col(c), F.lit("")) for c in ("before", "after", "path")]
    rows = some.select("label", *[x.alias(f) for f, x in features(F.col("candidate"), *known, words).items()])
    rows = materialize(rows.coalesce(1), "secret-labels")
    forest = RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=TREES, maxDepth=DEPTH, seed=seed, subsamplingRate=0.7)
    return Pipeline(stages=[VectorAssembler(inputCols=list(FEATURES), outputCol="features"), forest]).fit(rows)


def judged(found: DataFrame, model: PipelineModel, words: str) -> DataFrame:
    """``found`` with the forest's score and whether it is taken for a secret."""
    inputs = features(F.col("candidate"), F.col("before"), F.col("after"), F.col("path"), words)
    scored = model.transform(found.select("*", *[x.alias(f) for f, x in inputs.items()]))
    score = F.round(vector_to_array("probability")[1], 6)
    return scored.select(*found.columns, score.alias("score"), (score >= THRESHOLD).alias("is_secret"))


def scan(docs: DataFrame, model: PipelineModel, words: str, path: str = "source") -> DataFrame:
    """All findings of whole texts with their score."""
    return judged(candidates(docs, F.col(path) if path in docs.columns else F.lit("")), model, words)


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings that the forest keeps and those it removes; the candidate itself is not shown."""
    docs = table(spark, sf_dir, "documents")
    words = dictionary(docs.select("text"))
    found = scan(docs, train(labelled_findings(spark), words), words)
    return found.select("doc_id", "start", "end", F.sha2("candidate", 256).alias("sha256"), "score", "is_secret")
