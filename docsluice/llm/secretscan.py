"""Secret scans: candidates by shape, and a random forest, compiled to SQL, that removes false positives."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docsluice.llm._common import words

#: Characters of a candidate, at least.
SHORTEST = 16
TREES, DEPTH, SEED = 16, 6, 11
#: Labelled findings that the forest is trained on at most, the least by hash.
FINDINGS = 20_000
#: A value: characters of keys and encodings, after what assigns it.
VALUE = r"([A-Za-z0-9+/_\-.~]{16,}(?:={1,2}(?![A-Za-z0-9+/_\-.~=]))?)"
#: What known kinds of keys begin with.
PREFIXES = r"^(AKIA|ASIA|ghp_|gho_|sk-|xox[abp]-|eyJ|AIza|glpat-)"
#: Words that name a secret, words that name something else of this shape, words of names and paths.
NAMES = ("password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "access", "credential", "auth", "private")
OTHERS = ("commit", "sha", "md5", "hash", "checksum", "digest", "uuid", "guid", "revision", "etag", "build", "example", "sample", "integrity")
DICTIONARY = (
    "the", "and", "ing", "tion", "ment", "com", "org", "net", "www", "http", "https", "html", "index", "page", "file", "path", "data", "user", "home",
    "test", "example", "sample", "name", "value", "class", "function", "module", "config", "server", "client", "service", "image", "static", "assets",
    "download", "version", "release", "local", "public", "default", "system", "object", "string", "number", "search", "article", "product", "category",
    "content", "document", "message", "request", "response", "session", "account", "order", "customer", "report", "project", "language", "translation",
)

FEATURES = ("length", "digits", "uppers", "hexes", "vowels", "distinct", "changes", "covered", "slashes", "dots", "dashes", "known_prefix", "assigned", "secret_near", "other_near", "uuid")


def _count(text: Column, pattern: str) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("double")


def features(value: Column, before: Column) -> dict[str, Column]:
    """Numbers of a candidate and of the words before it: shape, changes of character class, dictionary, path, neighbours."""
    n = F.greatest(F.length(value), F.lit(1)).cast("double")
    low, near = F.lower(value), F.lower(before)
    classes = F.translate(F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[0-9]", "0"), "[A-Z]", "A"), "[a-z]", "a"), "+/_-.~=", "-------")
    runs = F.length(F.regexp_replace(classes, r"(.)\1+", "$1")).cast("double")
    return {
        "length": n, "digits": _count(value, "[0-9]") / n, "uppers": _count(value, "[A-Z]") / n, "hexes": _count(value, "[0-9a-f]") / n, "vowels": _count(low, "[aeiou]") / n,
        "distinct": F.size(F.array_distinct(F.split(value, ""))).cast("double") / n, "changes": runs / n, "covered": _count(low, "|".join(DICTIONARY)) / n,
        "slashes": _count(value, "/") / n, "dots": _count(value, r"\.") / n, "dashes": _count(value, "-") / n,
        "known_prefix": value.rlike(PREFIXES).cast("double"), "assigned": near.rlike(r"[=:]\s*[\"']?$").cast("double"),
        "secret_near": near.rlike("|".join(NAMES)).cast("double"), "other_near": near.rlike("|".join(OTHERS)).cast("double"), "uuid": low.rlike(r"^[0-9a-f]{8}-([0-9a-f]{4}-){3}[0-9a-f]{12}$").cast("double"),
    }


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, at, before, value): each long enough value anywhere in a word of a text, and what is before it.

    A value is a longest run of VALUE's characters; a word can hold several. It has a digit, or begins like a known key,
    or has a word that names a secret before it. at is the word's number from 0; before has what the word itself has
    ahead of the value, two values back at most, and up to two words where that reaches the word's start.
    """
    split = docs.select("doc_id", words(F.col("text")).alias("w"))
    spots = split.select("doc_id", "w", F.posexplode("w").alias("at", "word")).where(F.length("word") >= SHORTEST)
    # all of this compiles into the stage of the scan: neither the array of words nor that of parts is copied for a place
    parts = spots.select("doc_id", "w", "at", F.regexp_extract_all("word", F.lit(r"(?s)\G.*?" + VALUE), F.lit(0)).alias("parts"))
    each = parts.select("doc_id", "w", "at", "parts", F.posexplode("parts").alias("nth", "part"))
    value = F.regexp_extract("part", VALUE, 1)
    back = lambda k: F.coalesce(F.get("parts", F.col("nth") - k), F.lit(""))
    lead = F.concat(back(2), back(1), F.substr("part", F.lit(1), F.length("part") - F.length(value)))
    word = lambda k: F.when(F.col("nth") <= 2, F.get("w", F.col("at") - k))
    found = each.select("doc_id", "at", F.concat_ws(" ", word(2), word(1), lead).alias("before"), value.alias("value"))
    return found.where(F.col("value").rlike("[0-9]") | F.col("value").rlike(PREFIXES) | F.lower("before").rlike("|".join(NAMES)))


def labelled_findings(spark: SparkSession, each: int = 400) -> DataFrame:
    """(value, before, secret): findings made by rule from digests, labelled by what they are. Used where there are no others."""
    d = lambda k: F.sha2(F.concat(F.lit(f"{k}/"), F.col("id").cast("string")), 512)
    base64 = lambda k: F.regexp_replace(F.base64(F.unhex(d(k))), r"[\r\n=]", "")
    upper = lambda k: F.upper(F.regexp_replace(base64(k), "[+/]", ""))
    size = F.pmod(F.xxhash64("id"), F.lit(25)).cast("int")
    pick = lambda names, k=0: F.element_at(F.array(*map(F.lit, names)), (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(names))) + 1).cast("int"))
    cut = lambda text, n: F.substr(text, F.lit(1), n if isinstance(n, Column) else F.lit(n))
    word = lambda k: pick(DICTIONARY, k)
    name, sign = pick(NAMES, 1), pick(["=", ": ", " = \"", "='"], 2)
    rows = [
        (F.concat(F.lit("AKIA"), cut(upper(1), 16)), pick(["the key", "", "of it", "aws_access_key_id=", "and"], 3), 1),
        (cut(d(2), size + 16), F.concat(F.lit("a "), name, sign), 1),
        (cut(base64(3), size + 20), F.concat(word(4), F.lit(" "), name, sign), 1),
        (F.concat(F.lit("ghp_"), cut(F.regexp_replace(base64(4), "[+/]", ""), 36)), pick(["use", "token", "", "set"], 5), 1),
        (cut(d(5), 40), F.concat(pick(OTHERS, 6), pick([" ", ": ", " = "], 7)), 0),
        (cut(d(6), 32), F.concat(word(8), F.lit(" "), word(9)), 0),
        (F.concat_ws("-", cut(d(7), 8), cut(d(8), 4), cut(d(9), 4), cut(d(10), 4), cut(d(11), 12)), pick(["id=", "uuid: ", "for", "session"], 10), 0),
        (F.concat(F.lit("/"), word(11), F.lit("/"), word(12), F.lit("/"), word(13), F.lit("-"), F.col("id").cast("string"), F.lit(".html")), pick(["see", "url=", "at", "password reset:"], 14), 0),
        (F.concat(word(15), F.lit("_"), word(16), F.lit("_"), word(17), F.col("id").cast("string")), pick(["token =", "call", "class", "key:"], 18), 0),
        (F.concat(F.repeat(F.lit("x"), 20), F.lit("1")), F.concat(name, sign), 0),
    ]
    made = [spark.range(each).select(v.alias("value"), b.alias("before"), F.lit(y).cast("double").alias("secret")) for v, b, y in rows]
    return reduce(DataFrame.unionByName, made)


def train(findings: DataFrame, most: int = FINDINGS) -> RandomForestClassificationModel:
    """A forest from labelled findings (value, before, secret), of which `most` are used, the least by hash."""
    few = findings.orderBy(F.xxhash64("value", "before", "secret"), "value", "before").limit(most).coalesce(1)
    rows = few.select(F.col("secret").alias("label"), *[c.alias(k) for k, c in features(F.col("value"), F.col("before")).items()])
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="sqrt").fit(vectors)


def compiled(model: RandomForestClassificationModel) -> Column:
    """The forest's probability of a secret, as one SQL expression over columns named like the features."""

    def walk(node) -> Column:
        if node.numDescendants() == 0:
            stats = node.impurityStats().stats()
            return F.lit(float(stats[1]) / max(1e-12, float(stats[0]) + float(stats[1])))
        split = node.split()
        return F.when(F.col(FEATURES[split.featureIndex()]) <= F.lit(float(split.threshold())), walk(node.leftChild())).otherwise(walk(node.rightChild()))

    trees = [walk(t._java_obj.rootNode()) for t in model.trees]
    return reduce(lambda a, b: a + b, trees) / F.lit(float(len(trees)))


def scan(docs: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """(doc_id, at, value, before, score, secret) of every candidate in docs (doc_id, text); secret: score of 0.5 or more.

    `findings` are labelled ones (value, before, secret) to learn from, or else those of labelled_findings. Null and
    empty texts have no candidates; a text repeated in other rows has its own in each. Rows with a null doc_id are
    scanned too. Other columns are not read. Candidates are judged one by one, so that no group ever meets in a task.
    """
    model = train(labelled_findings(docs.sparkSession) if findings is None else findings)
    found = candidates(docs)
    scored = found.select("*", *[c.alias(k) for k, c in features(F.col("value"), F.coalesce("before", F.lit(""))).items()])
    return scored.withColumn("score", compiled(model)).select("doc_id", "at", "value", "before", "score", (F.col("score") >= 0.5).alias("secret"))


def redacted(docs: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """docs with each secret in text replaced by <secret>; everything else stays.

    Null and empty texts stay as they are, repeated rows each get the same text. Rows without a doc_id share their
    secrets, as rows that share a doc_id do. An empty table stays empty. A column named ss_id or ss_values is left out.
    """
    gone = scan(docs.select("doc_id", "text").distinct(), findings).where("secret").groupBy("doc_id").agg(F.collect_set("value").alias("ss_values")).withColumnRenamed("doc_id", "ss_id")
    out = docs.join(gone, F.col("doc_id").eqNullSafe(F.col("ss_id")), "left")
    longest_first = F.array_sort(F.col("ss_values"), lambda a, b: F.length(b) - F.length(a))
    text = F.when(F.col("ss_values").isNull(), F.col("text")).otherwise(F.aggregate(longest_first, F.col("text"), lambda t, v: F.replace(t, v, F.lit("<secret>"))))
    return out.withColumn("text", text).drop("ss_id", "ss_values")
