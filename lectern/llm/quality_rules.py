"""Quality rules: decision lists learned by sequential covering, emitted as ordered Spark conditions.

Statistics of every whole text are built-in column expressions. Learning reads labelled rows only
through grouped counts: every growing or pruning step is one DataFrame aggregation to a histogram of
(feature, bin), so all labelled rows count and the driver holds at most features x bins numbers.

Edge cases: null or empty text has no words and fails the base rule; null labels and labels of absent
documents are ignored; a document labelled twice counts as good only if all its labels say so;
repeated documents are judged each; without labels the list is empty and only the base rule rejects;
extra columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, spool, words_of

WINDOW = 8
#: Features, as integer expressions over the statistics: per mille of words, characters or lines.
FEATURES = {
    "n_words": "n_words",
    "word_length": "1000 * word_chars div greatest(n_words, 1)",
    "symbols": "1000 * n_symbols div greatest(n_words, 1)",
    "dup_lines": "1000 * n_dup_lines div greatest(n_lines, 1)",
    "repeats": "1000 * n_repeat_words div greatest(n_words, 1)",
    "distinct": "1000 * n_distinct div greatest(n_words, 1)",
    "upper": "1000 * n_upper div greatest(word_chars, 1)",
    "marks": "1000 * n_marks div greatest(n_words, 1)",
    "line_words": "1000 * n_words div greatest(n_lines, 1)",
}


def statistics(docs: DataFrame, keep: list[str] = ["doc_id"]) -> DataFrame:  # noqa: B006
    """Counts of every whole text beside the columns ``keep``; see the module for nulls."""
    text = F.coalesce(F.col("text"), F.lit(""))
    only = lambda body: F.length(F.regexp_replace(text, f"[^{body}]+", "")).cast("long")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    d = docs.select(
        *keep, words_of(F.col("text")).alias("_w"), lines.alias("_l"),
        only(r"#*$%&|<>").alias("n_symbols"), only("A-Z").alias("n_upper"), only(r"!?;:=_~^{}\[\]\\").alias("n_marks"),
    )
    n = F.size("_w")
    starts = F.when(n >= WINDOW, F.sequence(F.lit(1), n - (WINDOW - 1))).otherwise(F.array().cast("array<int>"))
    d = d.withColumn("_h", F.transform(starts, lambda i: F.xxhash64(F.slice("_w", i, WINDOW))))
    # A text whose windows all differ stops at the distinct count; the others sort (hash, place) once.
    pairs = F.array_sort(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    d = d.withColumn("_p", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), pairs))
    same = lambda x, j, k: F.coalesce(F.get("_p", j + k)["h"] == x["h"], F.lit(False))
    twice = F.filter("_p", lambda x, j: same(x, j, -1) | same(x, j, 1))
    d = d.withColumn("_at", F.array_sort(F.transform(twice, lambda x: x["i"])))
    run = F.transform("_at", lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get("_at", j + 1) - p, F.lit(WINDOW))))
    return d.select(
        *keep,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.aggregate(run, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long")).alias("n_repeat_words"),
        F.size("_l").cast("long").alias("n_lines"),
        F.size(F.array_distinct("_w")).cast("long").alias("n_distinct"),
        "n_upper",
        "n_marks",
    )


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


@dataclass(frozen=True)
class Rule:
    """Conjunction of (feature, sign, threshold) that rejects; held is its precision on the pruning part."""

    terms: tuple[tuple[str, str, int], ...]
    held: float

    def condition(self) -> Column:
        tests = [F.expr(FEATURES[f]) > t if s == ">" else F.expr(FEATURES[f]) <= t for f, s, t in self.terms]
        out = tests[0]
        for x in tests[1:]:
            out = out & x
        return out


def verdict(rules: list[Rule]) -> Column:
    """Ordered conditions: number of the first rule that rejects, null where none does."""
    out = F.lit(None).cast("int")
    for k in range(len(rules) - 1, -1, -1):
        out = F.when(rules[k].condition(), F.lit(k + 1)).otherwise(out)
    return out


def learn(
    stats: DataFrame, labels: DataFrame, *, bins: int = 24, max_rules: int = 10, max_terms: int = 3,
    min_precision: float = 0.9, min_cover: int = 3,
) -> list[Rule]:
    """Sequential covering of the rows labelled quality 0, over all labelled rows.

    Two thirds of the rows (by hash of doc_id) grow rules by FOIL gain, the rest prune their last terms
    and decide whether a rule stays: its precision must reach ``min_precision`` on both parts, and it must
    cover ``min_cover`` rows of quality 0 in the growing part.
    """
    lab = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("q"))
    rows = stats.where(~base_failed()).join(lab, "doc_id").select("doc_id", (F.col("q") < 1).cast("int").alias("bad"), *[F.expr(e).cast("long").alias(f) for f, e in FEATURES.items()])
    rows = spool(rows, "op3-labelled")
    names = list(FEATURES)
    grid = [k / bins for k in range(1, bins)]
    cuts = rows.agg(*[F.percentile_approx(f, grid, 10000).alias(f) for f in names]).first()
    if cuts is None or cuts[names[0]] is None:
        return []
    cuts = {f: sorted(set(cuts[f])) for f in names}
    cuts = {f: sorted({*c, *((a + b) // 2 for a, b in zip(c, c[1:], strict=False))}) for f, c in cuts.items()}
    # bin of a value: how many thresholds lie below it; "feature > cuts[b]" means bin > b
    binned = [F.expr(f"size(filter(array({', '.join(f'{int(t)}L' for t in cuts[f])}), t -> t < `{f}`))") for f in names]
    live = spool(rows.select("bad", (F.pmod(F.xxhash64("doc_id"), F.lit(3)) < 2).alias("grow"), F.array(*binned).alias("b")).groupBy("b", "grow").agg(F.sum("bad").alias("bad"), F.sum(1 - F.col("bad")).alias("good")), "op3-cube")

    def test(t):
        k, s, b = t
        return F.col("b")[k] > b if s == ">" else F.col("b")[k] <= b

    def count(df):
        r = df.groupBy("grow").agg(F.sum("bad").alias("p"), F.sum("good").alias("n")).collect()
        got = {x["grow"]: (x["p"], x["n"]) for x in r}
        return got.get(True, (0, 0)), got.get(False, (0, 0))

    precision = lambda p, n: p / (p + n) if p + n else 0.0
    rules: list[Rule] = []
    while len(rules) < max_rules:
        terms, here, marks = [], live, []
        (p0, n0), (hp, hn) = count(here)
        if p0 < min_cover:
            break
        while len(terms) < max_terms and n0:
            hist = here.where("grow").select("bad", "good", F.posexplode("b").alias("f", "bin")).groupBy("f", "bin").agg(F.sum("bad").alias("p"), F.sum("good").alias("n")).collect()
            at = {(r["f"], r["bin"]): (r["p"], r["n"]) for r in hist}
            best = None
            for k, f in enumerate(names):
                p = n = 0
                for b in range(len(cuts[f])):
                    dp, dn = at.get((k, b), (0, 0))
                    p, n = p + dp, n + dn
                    for s, cp, cn in (("<=", p, n), (">", p0 - p, n0 - n)):
                        if cp >= min_cover and cn < n0:
                            gain = cp * (math.log2(precision(cp, cn)) - math.log2(precision(p0, n0)))
                            rank = (gain, b if s == ">" else -b, -k, s)  # of equal gains the one that rejects less
                            if best is None or rank > best[0]:
                                best = (rank, (k, s, b), cp, cn)
            if best is None or best[0][0] <= 0:
                break
            terms.append(best[1])
            here, p0, n0 = here.where(test(best[1])), best[2], best[3]
            _, held = count(here)
            marks.append((terms[:], (p0, n0), held))
        # prune: drop last terms while that does not lower (p - n) / (p + n) on the held part
        worth = lambda h: (h[0] - h[1]) / (h[0] + h[1]) if sum(h) else -1.0
        if not marks:
            break
        kept = max(marks, key=lambda m: (worth(m[2]), -len(m[0])))
        if precision(*kept[2]) < min_precision or precision(*kept[1]) < min_precision:
            break
        rules.append(Rule(tuple((names[k], s, int(cuts[names[k]][b])) for k, s, b in kept[0]), precision(*kept[2])))
        cond = test(kept[0][0])
        for t in kept[0][1:]:
            cond = cond & test(t)
        live = live.where(~cond)
    return rules


def judge(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id with its counts, base_failed, kept and the number of the rejecting rule."""
    stats = spool(statistics(docs), "op3-stats")
    rules = learn(stats, labels, **options)
    failed = base_failed()
    return stats.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & verdict(rules).isNull()).alias("kept"), verdict(rules).alias("rule"),
    )


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: every document judged by the base rule and the learned list."""
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
