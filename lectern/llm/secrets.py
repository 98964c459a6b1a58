"""Secret scan: candidate tokens, and a random forest that removes false positives.

Candidates are long runs of key characters and a few fixed key formats, found in every whole text with
built-in expressions. Features are the candidate's length, transitions between character classes, variety,
coverage by a dictionary of common words, what its path says, and the words beside it. The forest is Spark
ML's, trained on labelled findings: a table of tokens with the text around, a path and a label. At most
``most_rows`` findings are used for fitting, chosen by hash. Where no table is given, ``sample_findings``
builds one of fixed size from rules for true keys and for the usual false alarms.

Edge cases: null or empty text has no candidates; a null path has no features; rows are scanned each, with
null or repeated doc_ids; candidates of any length are kept whole; findings with a null label or token are
ignored; without findings of both labels fitting is an error; empty tables give empty results; extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import spool
from .pii import _located

# '=' belongs to a candidate only as padding at its end: after a name it assigns what follows, a candidate of its own.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+(?:={1,2}+(?![A-Za-z0-9+/_=-]))?+"
# Published prefixes of key formats.
FORMATS = (("aws", r"^(?:AKIA|ASIA)[A-Z0-9]{16}$"), ("github", r"^gh[pousr]_[A-Za-z0-9]{36,}$"), ("slack", r"^xox[abprs]-[A-Za-z0-9-]{10,}$"), ("jwt", r"^eyJ[A-Za-z0-9_-]+$"))
# Common words and word parts, for the share of a candidate that they cover.
DICTIONARY = tuple("the and ing ion tion ment ent for with that this from are was her his not you all one out our had has have will your what when then them than they there where which about after again between because before being could should would people time year work first world life hand part place case week company system program question government number night point home water room mother area money story fact month right study book word business issue side kind head house service friend father power hour game line end member law car city name president team minute idea body information back parent face others level office door health person art war history party result change morning reason research girl guy moment air teacher force education er th he in re on at en es st nt ou ea ti te or le ne de se ch sch ung lich keit ver que eau ción mente ado ado os as la el aux ier ez".split())
SECRET_WORDS = r"(?i)(?:key|token|secret|passw|pwd|auth|credential|bearer|api|private|access)"
HARMLESS_WORDS = r"(?i)(?:commit|sha|md5|hash|digest|checksum|uuid|guid|id|revision|etag|example|sample|dummy|placeholder|href|url|path|http)"
FEATURES = ("length", "transitions", "variety", "digits", "upper", "marks", "longest_letters", "covered", "path_test", "path_docs", "near_secret", "near_harmless", "assigned", "quoted", "format")


def candidates(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Columns ``keep`` and a row a candidate: start, end, token, before and after (up to 64 characters each)."""
    t = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_t"))
    hits = F.regexp_extract_all("_t", F.lit(CANDIDATE), F.lit(0))
    t = t.withColumn("_h", hits).where("size(_h) > 0")
    # the text around may hold other candidates, as the name in name=value does
    x = t.select(*keep, F.explode(_located(F.col("_t"), CANDIDATE, F.col("_h"), wide=True)).alias("x"))
    return x.select(*keep, F.col("x.s").alias("start"), F.col("x.e").alias("end"), F.col("x.t").alias("token"), F.col("x.p").alias("before"), F.col("x.q").alias("after"))


def features(found: DataFrame, path: str) -> DataFrame:
    """The rows with one numeric column a feature."""
    t, n = F.col("token"), F.length("token")
    share = lambda keep: F.length(F.regexp_replace(t, f"[^{keep}]+", "")) / n
    runs = F.size(F.regexp_extract_all(t, F.lit("[a-z]+|[A-Z]+|[0-9]+|[^A-Za-z0-9]+"), F.lit(0)))
    words = "|".join(sorted(set(DICTIONARY), key=lambda w: (-len(w), w)))
    rest = F.length(F.regexp_replace(F.lower(t), f"(?:{words})", ""))
    near = F.concat(F.coalesce(F.regexp_extract("before", r"(?:[^\s]+\s*){0,3}$", 0), F.lit("")))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    out = {
        "length": n.cast("double"),
        "transitions": runs / n,
        "variety": F.size(F.array_distinct(F.split(t, ""))) / F.least(n, F.lit(40)),
        "digits": share("0-9"),
        "upper": share("A-Z"),
        "marks": share("+/_=-"),
        "longest_letters": F.coalesce(F.array_max(F.transform(F.regexp_extract_all(t, F.lit("[A-Za-z]+"), F.lit(0)), F.length)), F.lit(0)) / n,
        "covered": 1 - rest / n,
        "path_test": flag(F.col(path).rlike("(?i)test|spec|fixture|mock|example")),
        "path_docs": flag(F.col(path).rlike(r"(?i)doc|readme|\.md$|lock$|\.sum$")),
        "near_secret": flag(near.rlike(SECRET_WORDS)),
        "near_harmless": flag(near.rlike(HARMLESS_WORDS) | F.col("after").rlike(r"(?i)^\S*\s*(?:example|sample|dummy)")),
        "assigned": flag(F.col("before").rlike(r"[=:]\s*[\"'`]?$")),
        "quoted": flag(F.col("before").rlike(r"[\"'`]$") & F.col("after").rlike(r"^[\"'`]")),
        "format": flag(kind_of(t) != "generic"),
    }
    return found.withColumns({k: out[k].cast("double") for k in FEATURES})


def kind_of(token: Column) -> Column:
    out = F.lit("generic")
    for name, pattern in reversed(FORMATS):
        out = F.when(token.rlike(pattern), name).otherwise(out)
    return out


def sample_findings(spark: SparkSession, rows: int = 4000, seed: str = "a") -> DataFrame:
    """Labelled findings from fixed rules: token, before, after, path, label (1: a true secret)."""
    i = F.col("id")
    h = lambda k: F.md5(F.concat(F.lit(f"{seed}{k}:"), i.cast("string")))
    pick = lambda k, *xs: F.get(F.array(*[x if isinstance(x, Column) else F.lit(x) for x in xs]), F.pmod(F.xxhash64(F.lit(f"{seed}{k}"), i), F.lit(len(xs))).cast("int"))
    hexes, wide = h("x"), F.sha2(F.concat(h("y"), i.cast("string")), 256)
    mixed = F.regexp_replace(F.base64(F.unhex(wide)), "[^A-Za-z0-9]", "")
    cut = F.pmod(F.xxhash64(F.lit(seed), i), F.lit(20)).cast("int")
    key = pick("kind", F.sha1(hexes), hexes, F.substring(mixed, F.lit(1), 20 + cut), F.substring(wide, F.lit(1), 32 + cut), F.concat(F.lit("AKIA"), F.upper(F.substring(hexes, 1, 16))), F.concat(F.lit("ghp_"), F.substring(mixed, 1, 36)))
    named = pick("name", "token", "api_key", "secret", "password", "auth_token", "access-key", "credentials", "bearer")
    put = pick("put", ' = "', "='", ': "', "=", ": ")
    true_before = F.concat(pick("lead", "some words and ", "set ", "\n", "export "), named, put)
    parts = F.array(*map(F.lit, DICTIONARY))
    word = lambda k: F.get(parts, F.pmod(F.xxhash64(F.lit(f"{seed}{k}"), i), F.lit(len(set(DICTIONARY)))).cast("int"))
    prose = F.rpad(F.concat(*[word(f"w{k}") for k in range(10)]), 16 + F.length(word("z")), "the")
    false_token = pick("false", prose, prose, F.concat_ws("-", *[F.substring(hexes, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.sha1(hexes), wide, F.translate(F.substring(hexes, 1, 20), "abcdef", "012345"), F.repeat(F.lit("x"), 24), F.lit("your-api-key-goes-here"), F.concat(F.lit("/usr/share/"), prose))
    harmless = F.when(false_token.rlike("^[0-9a-f]+$"), F.concat(pick("hn", "commit ", "sha256:", "md5 = ", "checksum: ", "revision "))).when(false_token.rlike("^[0-9a-f-]+$"), pick("un", "uuid: ", "id = ", "request id "))
    loose = F.when(false_token.rlike("^x|^your"), F.concat(named, put)).otherwise(pick("fp", "in the ", "for a ", "of ", "and that ", "mit der ", "les "))
    true = F.pmod(F.xxhash64(F.lit(f"{seed}label"), i), F.lit(2)) == 0
    path = pick("path", "src/app.py", "config/prod.env", "docs/readme.md", "tests/test_app.py", "deploy.yaml", "src12")
    return spark.range(rows).select(F.when(true, key).otherwise(false_token).alias("token"), F.when(true, true_before).otherwise(F.coalesce(harmless, loose)).alias("before"), pick("after", '" and more', "' then", "\nnext line", " of the").alias("after"), path.alias("path"), true.cast("int").alias("label"))


def fit(findings: DataFrame, *, trees: int = 24, depth: int = 6, most_rows: int = 20_000, seed: int = 7) -> RandomForestClassificationModel:
    """Forest over labelled findings (token, before, after, path, label)."""
    rows = findings.where("token is not null and label is not null")
    rows = rows.orderBy(F.xxhash64("token", "before", "path"), "token").limit(most_rows)
    rows = spool(features(rows, "path").select(*FEATURES, F.col("label").cast("double").alias("label")).coalesce(1), "op1-findings")
    if rows.select("label").distinct().count() < 2:
        raise ValueError("findings of both labels are needed")
    x = VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(rows)
    return RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed, cacheNodeIds=False).fit(x)


def scored(found: DataFrame, model: RandomForestClassificationModel, path: str) -> DataFrame:
    """Candidates with kind, probability and secret (probability above one half)."""
    x = VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(features(found, path))
    p = vector_to_array(F.col("probability"))[1]
    out = model.transform(x).withColumn("p", p).withColumn("kind", kind_of(F.col("token")))
    return out.select(*found.columns, "kind", F.col("p").alias("probability"), (F.col("p") > 0.5).alias("secret"))


def scan(docs: DataFrame, findings: DataFrame | None = None, *, path: str = "source", **options) -> DataFrame:
    """doc_id, start, end, kind, probability and secret of every candidate in every whole text."""
    model = fit(findings if findings is not None else sample_findings(docs.sparkSession), **options)
    return scored(candidates(docs, ["doc_id", path]), model, path).drop("token", "before", "after")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: candidates in all documents with the forest's verdict."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return scan(docs).select("doc_id", "start", "end", "kind", F.round(F.col("probability"), 6).alias("probability"), "secret")
