"""Each pipeline stage, and the whole, against plain Python over the same rows."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from lectern.llm import bpe, mixing, quality_rules  # noqa: E402

from .test_operators import WORD, classes  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = ("row", "key", "spans", "_kept", "_probability", "n_words", "component_id", "mark")


def documents():
    rng = random.Random(11)
    vocab = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 8))) for _ in range(400)]
    rows = []

    def put(k, text):
        rows.append((k, text, rng.choice(["en", "de", None]), rng.choice(["a", "a", "b", None]), len(text or "")))

    for k in range(70):
        words = rng.choices(vocab, k=rng.choice([5, 30, 60, 120]))
        if k % 5 == 0:
            words = [w + "##" for w in words]
        if k % 7 == 1:
            words += [f"write to x{k}@mail{k}.org or 10.0.{k}.7"]
        put(k, " ".join(words))
        if k % 4 == 0:
            put(200 + k, " ".join(words) + " tail")
    put(2, "An other text under an id that is taken " + " ".join(rng.choices(vocab, k=40)))
    put(3, rows[-1][1])  # the copy of it is dropped or kept by its own text
    rows.append(rows[6])
    for k, text in ((400, None), (401, ""), (402, " \n\t"), (None, "no id " + " ".join(rng.choices(vocab, k=50))), (403, "long " + "x" * 5000 + " " + " ".join(rng.choices(vocab, k=3000)))):
        put(k, text)
    return rows


def statistics(text):
    w, lines = WORD.findall(text or ""), [x for x in (text or "").split("\n") if WORD.search(x)]
    seen = defaultdict(list)
    for k in range(len(w) - 7):
        seen[tuple(w[k : k + 8])].append(k)
    cover = {k + j for v in seen.values() if len(v) > 1 for k in v for j in range(8)}
    t = text or ""
    return {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", t)), "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(cover), "n_lines": len(lines), "n_distinct": len(set(w)), "n_upper": len(re.findall("[A-Z]", t)), "n_marks": len(re.findall(r"[!?;:=_~^{}\[\]\\]", t)),
    }


def rejected(text, rules):
    s = statistics(text)
    if s["n_words"] < 20 or 100 * s["n_repeat_words"] > 30 * s["n_words"]:
        return True
    value = lambda f: eval(quality_rules.FEATURES[f].replace("div", "//").replace("greatest", "max"), {"max": max}, dict(s))
    return any(all(value(f) > t if sign == ">" else value(f) <= t for f, sign, t in r.terms) for r in rules)


def near_copies_dropped(rows):
    """Rows are numbered so that repeated ids are told apart; a row goes if its class holds a smaller id."""
    named = [(k, r) for k, r in enumerate(rows) if r[0] is not None]
    at = classes([(k, r[1]) for k, r in named], 5, 80)
    low = {}
    for k, r in named:
        low[at[k][1]] = min(low.get(at[k][1], r[0]), r[0])
    return [r for r in rows if r[0] is None] + [r for k, r in named if low[at[k][1]] == r[0]]


def hidden(text):
    """Base kinds only: too few seeds here for contextual patterns."""
    if text is None:
        return None
    text = re.sub(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "[EMAIL]", text)
    return re.sub(r"[0-9]+(\.[0-9]+){3}", "[IP]", text)


def mixed(rows):
    def cell(r):
        t = r[1] or ""
        n = len(WORD.findall(t))
        marks, upper = len(re.findall(r"[#*$%&|<>]", t)), len(re.findall("[A-Z]", t))
        topic = "symbols" if 20 * marks > n else "shout" if 10 * upper > 3 * len(t) else "long" if n >= 2000 else "brief" if n < 100 else "prose"
        return (r[3] or "", r[2] or "", topic), n

    tokens = Counter()
    for r in rows:
        c, n = cell(r)
        tokens[c] += n
    tokens = {c: n for c, n in tokens.items() if n}
    goals = []
    for m in range(3):
        sums = Counter()
        for c, n in tokens.items():
            sums[c[m]] += n
        raw = {v: n**0.9 for v, n in sums.items()}
        goals.append({v: x / sum(raw.values()) for v, x in raw.items()})
    weight = dict.fromkeys(tokens, 1.0)
    for _ in range(12):
        for m in range(3):
            now = Counter()
            for c, n in tokens.items():
                now[c[m]] += weight[c] * n
            weight = {c: w * goals[m][c[m]] / now[c[m]] for c, w in weight.items()}
    top = max(weight.values())
    draw = lambda i: int(hashlib.md5(f"mix:{'' if i is None else i}".encode()).hexdigest()[: mixing.HEX], 16) / 16**mixing.HEX
    return [r for r in rows if draw(r[0]) < weight.get(cell(r)[0], 0.0) / top]


def plain(rows):
    return Counter(tuple(r) for r in rows)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    d = spark.createDataFrame(documents(), SCHEMA)
    d.withColumns({c: F.lit(1) for c in EXTRA}).coalesce(2).write.parquet(f"{path}/documents.parquet")
    labels = [(k, None if k % 9 == 8 else int(k % 5 > 0), 0) for k in range(70)]
    spark.createDataFrame([*labels, (None, 0, 0), (999, 0, 0), (1, 1, None)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_against_plain_python(spark, folder):
    from tokenizers import Tokenizer

    docs, rows = spark.read.parquet(f"{folder}/documents.parquet"), documents()
    stats = quality_rules.statistics(docs)
    rules = quality_rules.learn(stats, spark.read.parquet(f"{folder}/labels.parquet"))
    assert rules
    steps = {
        "quality_rules": lambda rs: [r for r in rs if not rejected(r[1], rules)],
        "ngram_join": near_copies_dropped,
        "pii": lambda rs: [(r[0], hidden(r[1]), r[2], r[3], None if r[1] is None else len(hidden(r[1]))) for r in rs],
        "mixing": mixed,
    }
    # the stages after the first also get what the first would have rejected
    whole = docs
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        assert plain(stage(spark, whole, folder).collect()) == plain(steps[name](documents())), name
    for name, stage in corpus_pipeline.STAGES[:1]:
        assert plain(stage(spark, docs, folder).collect()) == plain(steps[name](rows)), name
    for step in steps.values():
        rows = step(rows)
    library = Tokenizer.from_file(bpe.vocabulary_path())
    want = Counter()
    for i, text, lang, source, _ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want[i, lang, source, tuple(ids), len(ids)] += 1
    got = corpus_pipeline.run(spark, folder)
    assert got.columns == ["doc_id", "lang", "source", "ids", "n_tokens"]
    assert Counter((r[0], r[1], r[2], tuple(r[3]), r[4]) for r in got.collect()) == want and len(want) > 10


def test_stages_of_nothing(spark, folder):
    none = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, folder).count() == 0, name
