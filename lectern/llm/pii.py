"""Personal data: fixed patterns, and contextual patterns bootstrapped from what those find.

The base kinds are regular expressions whose matches are kept or dropped whole. Their spans seed a graph
of instances (identifier-like tokens, which hold a digit) and lexical patterns (the word before, the two words
before, the word after). Each round
scores a pattern by the share of all its occurrences in the corpus that stand beside scored instances, and
an instance by its patterns; patterns that stay sure and well supported discover identifiers that the base
kinds do not cover. Everything is built-in column expressions, joins and aggregates.

Edge cases: null or empty text has no spans; rows with a null or repeated doc_id are treated row by row;
spans are in code points, end exclusive; overlapping spans of different kinds all stay; texts of any
length are read whole; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import spool

KINDS = ("email", "ip", "card", "phone", "id")
# Possessive forms of the base patterns: the same matches without backtracking. A look-behind skips starts
# inside a run, where no match can begin; \G admits the rest of a run that an earlier match ended in.
PATTERNS = (
    r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"(?<![0-9])[0-9](?:[\x20-]?+[0-9]){13,}+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
#: Identifier-like tokens: runs of letters, digits and inner joiners that hold a digit.
TOKEN = r"(?<![A-Za-z0-9])(?=[A-Za-z._:/#@-]*[0-9])[A-Za-z0-9]++(?:[._:/#@-][A-Za-z0-9]++)*+"
#: Words that patterns are made of.
WORD = r"\p{L}{2,}+"
BROADCAST_ROWS = 20_000


def _digits(t: Column) -> Column:
    return F.regexp_replace(t, "[^0-9]+", "")


def _luhn(t: Column) -> Column:
    d = F.reverse(_digits(t))
    each = F.transform(F.sequence(F.lit(1), F.length(d)), lambda i: F.substring(d, i, F.lit(1)).cast("int") * (1 + F.pmod(i + 1, F.lit(2))))
    return F.pmod(F.aggregate(each, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x)), F.lit(10)) == 0


def _valid(kind: str, t: Column) -> Column:
    if kind == "ip":
        return t.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.|$)){4}$")
    if kind == "card":
        return F.length(_digits(t)).between(14, 19) & _luhn(t)
    if kind == "phone":
        return F.length(_digits(t)).between(10, 15)
    return F.lit(True)


#: Items that one step of a running sum takes; sums over an array go in runs of so many.
RUN = 256
SPAN = "array<struct<s:int,e:int,t:string,p:string,q:string>>"


def bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once a row, however often the body or its lambdas name it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _runs(items: Column) -> Column:
    """An array cut into arrays of RUN items."""
    n = F.size(items)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.floor((n - 1) / RUN).cast("int")), lambda k: F.slice(items, k * RUN + 1, F.lit(RUN))))


def _located(text: Column, pattern: str, hits: Column, wide: bool = False) -> Column:
    """Matches with their places: what stands between them has the rest of the lengths.

    p and q: up to 64 characters before and after, as far as the next match, or over matches too if ``wide``
    (of at least 16 characters each). Work is linear in the text and all but linear in the number of matches.
    """

    def around(pieces, found, i):
        back, ahead = [], []
        for k in range(4 if wide else 0, -1, -1):
            back += [F.get(found, i - k - 1)] * (k < 4 and wide) + [F.get(pieces, i - k)]
        for k in range(5 if wide else 1):
            ahead += [F.get(pieces, i + k + 1)] + [F.get(found, i + k + 1)] * (k < 4 and wide)
        last = lambda x: F.substring(F.coalesce(x, F.lit("")), -64, 64)
        first = lambda x: F.substring(F.coalesce(x, F.lit("")), 1, 64)
        return last(F.concat(*map(last, back))), first(F.concat(*map(first, ahead)))

    def item(pieces, found, t, i):
        p, q = around(pieces, found, i)
        return F.struct(F.length(F.get(pieces, i)).alias("gap"), F.length(t).alias("n"), t.alias("t"), p.alias("p"), q.alias("q"))

    def step(acc, x):
        s = acc["pos"] + x["gap"]
        row = F.struct(s.alias("s"), (s + x["n"]).alias("e"), x["t"].alias("t"), x["p"].alias("p"), x["q"].alias("q"))
        return F.struct((s + x["n"]).alias("pos"), F.concat(acc["out"], F.array(row)).alias("out"))

    none = F.array().cast(SPAN)
    start = F.struct(F.lit(0).alias("pos"), none.alias("out"))

    def joined(acc, r):
        moved = F.transform(r["out"], lambda x: F.struct((x["s"] + acc["pos"]).alias("s"), (x["e"] + acc["pos"]).alias("e"), x["t"].alias("t"), x["p"].alias("p"), x["q"].alias("q")))
        return F.struct((acc["pos"] + r["pos"]).alias("pos"), F.concat(acc["out"], F.array(moved)).alias("out"))

    def placed(both):
        items = F.transform(both["found"], lambda t, i: item(both["pieces"], both["found"], t, i))
        runs = bound(items, lambda xs: F.transform(_runs(xs), lambda r: F.aggregate(r, start, step)))
        begin = F.struct(F.lit(0).alias("pos"), F.array().cast(f"array<{SPAN}>").alias("out"))
        return F.flatten(F.aggregate(runs, begin, joined, lambda a: a["out"]))

    return F.when(F.size(hits) > 0, bound(F.struct(F.split(text, pattern, -1).alias("pieces"), hits.alias("found")), placed)).otherwise(none)


def base_spans(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Columns ``keep``, a row number, valid spans of each base kind and identifier-like tokens with the text around."""
    d = docs.select(*keep, F.coalesce(F.col("text"), F.lit("")).alias("_t"))
    every = lambda p: F.regexp_extract_all("_t", F.lit(p), F.lit(0))
    gate = {"email": "@", "phone": "+"}
    none = F.array().cast("array<string>")
    hits = [F.when(F.contains("_t", F.lit(gate[k])), every(p)).otherwise(none).alias(f"_{k}") if k in gate else every(p).alias(f"_{k}") for k, p in zip(KINDS, PATTERNS, strict=False)]
    d = d.select(*keep, "_t", *hits, every(TOKEN).alias("_tokens"))
    out = []
    for k, p in zip(KINDS, PATTERNS, strict=False):
        out.append(_only(k, _located(F.col("_t"), p, F.col(f"_{k}"))).alias(k))
    out.append(_located(F.col("_t"), TOKEN, F.col("_tokens")).alias("token"))
    return d.select(*keep, F.monotonically_increasing_id().alias("row"), *out)


def _only(kind: str, spans: Column) -> Column:
    return spans if kind == "email" else F.filter(spans, lambda x: _valid(kind, x["t"]))


def _around(s: Column) -> Column:
    """Lexical patterns of one span: the word before, the two words before, the word after."""
    gap = r"[^\p{L}\p{N}]*+"
    left, right = F.lower(F.regexp_extract(s["p"], rf"({WORD}){gap}$", 1)), F.lower(F.regexp_extract(s["q"], rf"^{gap}({WORD})", 1))
    two = F.lower(F.regexp_replace(F.regexp_extract(s["p"], rf"({WORD}[^\p{{L}}\p{{N}}]++{WORD}){gap}$", 1), r"[^\p{L}\p{N}]+", " "))
    return F.array(F.concat(F.lit("L:"), left), F.concat(F.lit("M:"), two), F.concat(F.lit("R:"), right))


def _occurrences(docs: DataFrame, asked: DataFrame, pairs: bool) -> DataFrame:
    """word (or two words), total: places in all texts where the asked ones stand, met by their hashes."""
    w = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(WORD), F.lit(0))
    rest = lambda h, start: F.slice(h, F.lit(start), F.greatest(F.size(h) - 1, F.lit(0)))
    two = lambda h: rest(F.zip_with(h, rest(h, 2), lambda a, b: F.xxhash64(a, b)), 1)
    hashes = F.transform(w, lambda x: F.xxhash64(x))
    words = docs.select((bound(hashes, lambda h: F.concat(h, two(h))) if pairs else hashes).alias("h"))
    words = words.select(F.explode("h").alias("h"))
    first, second = F.xxhash64(F.substring_index("word", " ", 1)), F.xxhash64(F.substring_index("word", " ", -1))
    asked = asked.withColumn("h", F.when(F.contains("word", F.lit(" ")), F.xxhash64(first, second)).otherwise(first))
    if asked.count() <= BROADCAST_ROWS:
        total = words.join(F.broadcast(asked), "h").groupBy("word").agg(F.count("*").alias("total"))
    else:  # beyond the bound words are counted first, each task its own, so that a common word is a row a task
        total = words.groupBy("h").agg(F.count("*").alias("total")).join(asked, "h")
    return total.select("word", "total")


def discover(
    found: DataFrame, docs: DataFrame, *, rounds: int = 3, min_seeds: int = 3, min_pattern: float = 0.5, min_instance: float = 0.8
) -> DataFrame | None:
    """(row, s, e) of identifiers beside sure patterns; None where no pattern has enough seeds.

    A pattern needs ``min_seeds`` distinct sure instances and a share of ``min_pattern`` of all places where
    its words occur in the corpus; an instance needs ``min_instance``, which one pattern gives that always, or
    several that mostly, stand beside sure instances. All documents count.
    """
    base = F.array_sort(F.flatten(F.array(*[F.col(k) for k in KINDS[:4]])))
    row = lambda x, seed: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["t"].alias("t"), _around(x).alias("c"), F.lit(seed).alias("seed"))
    meets = lambda x, b: (b["s"] < x["e"]) & (x["s"] < b["e"])
    # base spans in runs with their extent, so that a token looks into few of them
    runs = F.transform(_runs(base), lambda r: F.struct(F.get(r, F.lit(0))["s"].alias("s"), F.array_max(F.transform(r, lambda x: x["e"])).alias("e"), r.alias("r")))
    taken = lambda x, rs: F.coalesce(F.exists(rs, lambda r: meets(x, r) & F.exists(r["r"], lambda b: meets(x, b))), F.lit(False))
    free = bound(runs, lambda rs: F.filter("token", lambda x: ~taken(x, rs)))
    spans = found.select("row", F.explode(F.concat(F.transform(base, lambda x: row(x, 1.0)), F.transform(free, lambda x: row(x, 0.0)))).alias("x"))
    spans = spool(spans.select("row", "x.*").withColumn("t", F.lower("t")), "op6-spans")
    edges = spool(spans.select("t", "seed", F.explode("c").alias("pattern")).where("length(pattern) > 2").groupBy("t", "pattern").agg(F.count("*").alias("n"), F.max("seed").alias("seed")), "op6-edges")
    induced = edges.where("seed > 0").groupBy("pattern").agg(F.count("*").alias("seeds")).where(F.col("seeds") >= min_seeds)
    induced = spool(induced.withColumn("word", F.expr("substr(pattern, 3)")), "op6-induced")
    if not induced.limit(1).count():
        return None
    total = _occurrences(docs, induced.select("word").distinct(), induced.where("pattern like 'M:%'").limit(1).count() > 0)
    patterns = spool(induced.join(total, "word").select("pattern", "total"), "op6-patterns")
    edges = spool(edges.join(patterns, "pattern"), "op6-graph")
    score = edges.groupBy("t").agg(F.max("seed").alias("score"))
    for _ in range(rounds):
        worth = edges.join(score, "t").groupBy("pattern").agg((F.sum(F.col("n") * F.col("score")) / F.max("total")).alias("w"), F.sum((F.col("score") >= min_instance).cast("int")).alias("k"))
        worth = spool(worth.select("pattern", F.least(F.lit(1.0), "w").alias("w"), "k"), "op6-worth")
        sure = worth.where((F.col("w") >= min_pattern) & (F.col("k") >= min_seeds))
        against = F.sum(F.log1p(-F.least(F.lit(0.999999), F.coalesce("w", F.lit(0.0)))))  # least() would pass over a null
        score = edges.join(sure.select("pattern", "w"), "pattern", "left").groupBy("t").agg(F.greatest(F.max("seed"), 1 - F.exp(F.coalesce(against, F.lit(0.0)))).alias("score"))
        score = spool(score, "op6-score")
    new = score.where(F.col("score") >= min_instance).select("t")
    placed = spans.where("seed = 0").select("row", "s", "e", "t", F.explode("c").alias("pattern"))
    return placed.join(sure.select("pattern"), "pattern", "left_semi").join(new, "t", "left_semi").select("row", "s", "e").distinct()


def find_spans(docs: DataFrame, keep: list[str], **options) -> DataFrame:
    """Columns ``keep``, counts of the base kinds, and arrays base and spans of (s, k, e), in order."""
    found = spool(base_spans(docs, keep), "op6-found")
    more = discover(found, docs, **options)
    kind = lambda k: F.transform(KINDS[k], lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e")))
    out = found.select("row", *keep, *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:4]], F.array_sort(F.flatten(F.array(*[kind(k) for k in range(4)]))).alias("base"))
    if more is None:
        return out.withColumn("spans", F.col("base")).drop("row")
    more = spool(more.groupBy("row").agg(F.collect_list(F.struct("s", F.lit(4).alias("k"), "e")).alias("more")), "op6-more")
    n = more.count()
    if not n:
        return out.withColumn("spans", F.col("base")).drop("row")
    # rows with further spans are few; only beyond the bound are the texts shuffled to meet them
    more = F.broadcast(more) if n <= BROADCAST_ROWS else more
    out = out.join(more, "row", "left").drop("row")
    return out.withColumn("spans", F.array_sort(F.concat("base", F.coalesce("more", F.slice("base", 1, 0))))).drop("more")


def spelled(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def redact(text: Column, spans: Column) -> Column:
    """Text with every span replaced by its kind in brackets; of overlapping spans the first leads.

    The text is cut once a run of spans and each run's part once a span, so work grows linearly in both.
    """
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    cut = lambda t, a, b: F.substring(t, a + 1, b - a)

    def lead(acc, x):
        fresh = x["s"] >= acc["pos"]
        kept = F.when(fresh, F.concat(acc["out"], F.array(F.struct(acc["pos"].alias("from"), x["s"].alias("s"), x["k"].alias("k"))))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["pos"], x["e"]).alias("pos"), kept.alias("out"))

    start = F.struct(F.lit(0).alias("pos"), F.array().cast("array<struct<from:int,s:int,k:int>>").alias("out"))

    def spelled_out(a):
        def run(r):
            low, high = F.get(r, F.lit(0))["from"], F.element_at(r, -1)["s"]
            part = lambda t: F.array_join(F.transform(r, lambda x: F.concat(cut(t, x["from"] - low, x["s"] - low), F.get(names, x["k"]))), "")
            return bound(cut(text, low, high), part)

        return F.concat(F.array_join(F.transform(_runs(a["out"]), run), ""), F.substring(text, a["pos"] + 1, F.length(text)))

    return F.when(F.size(spans) > 0, bound(F.aggregate(spans, start, lead), spelled_out)).otherwise(text)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: spans of personal data in all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = find_spans(docs.select("doc_id", "text"), ["doc_id"])
    counts = [f"n_{k}" for k in KINDS[:4]]
    return out.select("doc_id", *counts, F.sha2(spelled(F.col("base")), 256).alias("base_sha256"), spelled(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))
