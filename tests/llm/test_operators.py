import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import bpe, chat, embeddings, mixing, ngram_join, pii, quality_rules, secrets, sharding, warc
from lectern.llm.common import connected_components, shared_dir

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts(seed, n=60):
    rng = random.Random(seed)
    vocab = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 6))) for _ in range(300)]
    out = []
    for _ in range(n):
        base = rng.choices(vocab, k=rng.choice([0, 1, 3, 8, 40, 150]))
        out.append(" ".join(base))
        for _ in range(rng.randint(0, 3)):
            copy = base[:]
            for _ in range(rng.randint(0, 3)):
                if copy:
                    copy[rng.randrange(len(copy))] = rng.choice(vocab)
            out.append("  ".join(copy).upper() if rng.random() < 0.2 else " ".join(copy))
    return [*out, None, "", " \n", "x"]


def classes(rows, n, percent):
    sets = {i: frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if (w := WORD.findall((t or "").lower())) else frozenset() for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80), (2, 60)])
def test_ngram_join_against_all_pairs(spark, n, percent):
    rows = list(enumerate(texts(percent), 5))
    df = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, n int, key string")
    got = {r[0]: (r[1], r[2]) for r in ngram_join.jaccard_components(df, words=n, percent=percent).collect()}
    assert got == classes(rows, n, percent)


def test_signatures_meet_with_hot_shingles():
    rng = np.random.default_rng(3)
    bands, lost = ngram_join.Bands(85), 0
    hot = np.sort(rng.integers(0, 1 << 63, 400, dtype=np.uint64))
    for _ in range(300):
        size = int(rng.integers(5, 80))
        a = np.unique(np.r_[rng.choice(hot, size), rng.integers(0, 1 << 63, int(rng.integers(0, 4)), dtype=np.uint64)])
        b = np.unique(np.r_[a[rng.random(len(a)) > 0.08], rng.choice(hot, 2)])
        same = len(np.intersect1d(a, b))
        if 100 * same >= 85 * (len(a) + len(b) - same):
            keys = [ngram_join.signatures(x, bands, hot, np.full(len(hot), 500)) for x in (a, b)]
            lost += not len(np.intersect1d(*keys))
    assert lost == 0


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert ngram_join.jaccard_components(docs).count() == 0
    assert quality_rules.judge(docs, labels).count() == 0
    assert pii.find_spans(docs, ["doc_id"]).count() == 0
    assert mixing.calibrated(docs).count() == 0
    assert bpe.round_trip_digests(docs, bpe.vocabulary_path()).count() == 0
    assert secrets.scan(docs).count() == 0
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    stream, leaves = chat.format_forest(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert chat.read_back(stream, leaves).count() == 0


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 90), (90, 95), (7, 7), (100, 90)]
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 90: 90, 95: 90, 100: 90}


def test_statistics_and_rules(spark):
    line = "a b c d e f g h i j"
    rows = [(1, f"{line}\n{line}\n\nz # $"), (2, None), (3, ""), (4, "x " * 30), (5, f"{line} 1 {line} 2 {line[2:]}")]
    got = {r["doc_id"]: r for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, None, 0)], "doc_id long, quality int, toxic int")).collect()}
    for i, t in rows:
        w, lines = WORD.findall(t or ""), [x for x in (t or "").split("\n") if WORD.search(x)]
        seen = defaultdict(list)
        for k in range(len(w) - 7):
            seen[tuple(w[k : k + 8])].append(k)
        cover = {k + j for v in seen.values() if len(v) > 1 for k in v for j in range(8)}
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(cover))
        assert tuple(got[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want


def test_rules_hold_on_other_rows(spark):
    def make(k, bad):
        rng = random.Random(k)
        return " ".join(rng.choice("abcdefghijk") * rng.randint(1, 8) + ("##" if bad and rng.random() < 0.5 else "") for _ in range(60))

    docs = spark.createDataFrame([(k, make(k, k % 3 == 0)) for k in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 > 0), 0) for k in range(200)], "doc_id long, quality int, toxic int")
    got = quality_rules.judge(docs, labels).where("doc_id >= 200 and not base_failed").collect()
    assert sum(r["kept"] == (r["doc_id"] % 3 > 0) for r in got) >= 0.95 * len(got)


def test_bpe_equals_the_library():
    from tokenizers import Tokenizer

    path = bpe.vocabulary_path()
    mine, theirs = bpe.Codec(path, most_kept=50), Tokenizer.from_file(path)
    rng = random.Random(2)
    parts = [*"ab's STéΣσςİßÅ1½ \n\t\x0b\x1c\x85\xa0 !<|>", "<|endoftext|>", "中", "🙂", "é"]
    for t in ["", "x" * 3000, *["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(1500)]]:
        ids = theirs.encode(t, add_special_tokens=False).ids
        assert mine.encode(t) == ids and mine.decode(ids) == theirs.decode(ids, skip_special_tokens=False)


def test_personal_data(spark):
    rows = [(1, "mail a@b.co, 1.2.3.4 and 256.1.1.1"), (2, "4111 1111-1111 1111 +1 (743) 555-3824)"), (3, None), (4, "𝒜 x@y.z_w@q.r"), *[(10 + k, f"the badgex {k}@mm{k}.org") for k in range(6)], (30, "the badgex QX-88110 ok")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.find_spans(d, ["doc_id", "text"]).select("doc_id", pii.spelled(F.col("spans")).alias("s"), pii.redact(F.coalesce("text", F.lit("")), F.col("spans")).alias("r")).collect()}
    assert got[1]["s"] == "email:5:11,ip:13:20" and got[1]["r"] == "mail [EMAIL], [IP] and 256.1.1.1"
    assert got[2]["s"] == "card:0:19,phone:20:37" and got[3]["s"] == "" and got[4]["s"] == "email:2:7,email:7:13"
    assert got[30]["s"] == "id:11:19"


def test_mixing_meets_targets(spark):
    rng = random.Random(1)
    rows = [(k, "w " * rng.randint(100, 400), rng.choice(["en", "de", None]), rng.choice(["a", "a", "a", "b"]), 0) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = mixing.calibrated(docs, targets={"source": {"a": 1, "b": 1}, "lang": {"en": 2, "de": 1, "": 1}}).collect()
    mass = defaultdict(float)
    for r in got:
        mass[r["_source"]] += r["_tokens"] * r["_probability"]
        mass["lang " + r["_lang"]] += r["_tokens"] * r["_probability"]
    assert mass["a"] == pytest.approx(mass["b"], rel=1e-6) and mass["lang en"] == pytest.approx(2 * mass["lang de"], rel=1e-6)
    assert max(r["_probability"] for r in got) == pytest.approx(1)


def test_lookup_table_is_even_and_steady(spark):
    names = [f"s{k}" for k in range(9)]
    table = sharding.lookup_table(names, 1009)
    sizes = [table.count(k) for k in range(9)]
    assert max(sizes) - min(sizes) <= 1
    fewer = sharding.lookup_table(names[:-1], 1009)
    assert sum(a != b and a != 8 for a, b in zip(table, fewer, strict=True)) < 0.2 * 1009
    rows = spark.createDataFrame([(1, "slot"), (None, "x"), (1, "y")], "id long, other string")
    got = sharding.place(rows, "id", names, 1009).collect()
    assert all(r["shard"] == names[table[r["slot"]]] for r in got) and len(got) == 3
    with pytest.raises(ValueError):
        sharding.lookup_table(names, 1000)


def test_warc_round_trip(spark, tmp_path):
    big = "y" * 150
    rows = [(1, "u", big), (2, "v", big), (0, "w", big), (3, None, None), (4, "a\nb", "x" * 99), (5, "c", "x" * 99), (6, "d", "WARC/1.1\r\nContent-Length: 3\r\n\r\n" * 9), (7, "e", "é\x00\r\n\r\n" * 40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write_archives(pages, str(tmp_path / "w"))
    records = warc.read_archives(spark, str(tmp_path / "w"))
    nested = warc.transactions(records)
    got = {r["page_id"]: r for r in warc.captures(nested).collect()}
    for i, u, h in rows:
        raw = (h or "").encode()
        again = h == big and i > 0
        r = got[i]
        assert (r["payload_bytes"], r["payload_digest"], r["url"]) == (len(raw), hashlib.sha256(raw).hexdigest(), u)
        assert (r["record_type"], r["refers_to"]) == (("revisit", 0) if again else ("response", None))
    assert nested.where("request is null or metadata is null").count() == 0


def test_chat_forest(spark):
    rng = random.Random(8)
    parts = ["<s>", "</s>", "[INST]", "\\", "<", "a", "\n", "<|im_end|>", "%0A"]
    for _ in range(2000):
        t = "".join(rng.choices(parts, k=rng.randint(0, 8)))
        e = chat.escape(t)
        assert chat.unescape(e) == t and not any(c in e for c in chat.CONTROL)
    convs = {c: [(rng.choice(["user", "assistant", "tool\n"]), "".join(rng.choices(parts, k=2))) for _ in range(rng.randint(1, 6))] for c in range(30)}
    convs |= {100 + c: convs[c] + [("assistant", "more")] for c in range(10)} | {200: convs[0], 201: convs[1][:1]}
    rows = [(c, k, r, t) for c, turns in convs.items() for k, (r, t) in enumerate(turns)]
    stream, leaves = chat.format_forest(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    for r in chat.read_back(stream, leaves).collect():
        turns = convs[r["conv_id"]]
        assert chat.read_turns(r["formatted"]) == turns
        assert [chat.unescape(r["formatted"][s["x"] : s["y"]]) for s in r["loss"]] == [t for role, t in turns if role == "assistant" and t]
    nodes = {tuple(turns[: k + 1]) for turns in convs.values() for k in range(len(turns))}
    whole = sum(len(chat.turn_block(*n[-1])[0]) for n in nodes)
    assert stream.agg(F.sum(F.length("text"))).first()[0] == whole  # every shared turn once


def test_embeddings_against_all_pairs(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(40, 16)).astype(np.float32)
    rows = [(k, [float(x) for x in base[k % 40] + rng.normal(size=16).astype(np.float32) * rng.choice([0.02, 0.45])]) for k in range(150)]
    rows += [(500, rows[3][1]), (501, None), (502, [0.0] * 16), (503, [float("nan")] * 16), (504, [1.0]), (505, [2.0]), (506, [])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    ok = {i: np.array(v, np.float32).astype(float) for i, v in rows if v and np.isfinite(v).all() and any(v)}
    near = {i: {j for j, w in ok.items() if j != i and len(w) == len(v) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.9} for i, v in ok.items()}
    for i, _ in rows:
        reach, todo = {i}, [i]
        while todo:
            new = near.get(todo.pop(), set()) - reach
            reach |= new
            todo += new
        assert got[i] == (len(near.get(i, ())), min(reach), i == min(reach))


def test_forest_removes_false_alarms(spark):
    model = secrets.fit(secrets.sample_findings(spark))
    held = secrets.scored(secrets.sample_findings(spark, 1500, "held"), model, "path").collect()
    assert sum(r["secret"] == bool(r["label"]) for r in held) >= 0.97 * len(held)
    docs = spark.createDataFrame([(1, 'x token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" y', "s"), (2, "commit 24be64439e3e49cf46b2d7c90f3602a3d0b907ff in the", "s"), (3, None, None)], "doc_id long, text string, source string")
    got = {r["doc_id"]: (r["start"], r["end"], r["secret"]) for r in secrets.scan(docs).collect()}
    assert got == {1: (11, 51, True), 2: (7, 47, False)}


def test_shared_folder_is_the_sessions(spark):
    assert shared_dir(spark) == (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()).rstrip("/")


def test_secrets_straight_after_an_equals_sign(spark):
    key = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    wide, padded = "wJalrXUtnFEMIK7MDENGbPxRfiCYEXAMPLEKEY", "Zm9vYmFyYmF6cXV4MTIzNDU2Nzg5MA=="
    rows = [(f"api_key={key}", key), (f"export GITHUB_TOKEN=ghp_{key[:36]}", f"ghp_{key[:36]}"), (f"curl https://h.example/v1?access_token={key}&x=1", key), (f"AWS_SECRET_ACCESS_KEY={wide}", wide), (f"SECRET={padded}\nnext", padded), (f"DATABASE_PASSWORD={key}\nnext", key), (f"commit={key}", None), ("the_quick_brown_function_name=another_plain_function_name", None)]
    docs = spark.createDataFrame([(k, t, "config/prod.env") for k, (t, _) in enumerate(rows)], "doc_id long, text string, source string")
    got = {r["doc_id"]: rows[r["doc_id"]][0][r["start"] : r["end"]] for r in secrets.scan(docs).where("secret").collect()}
    assert got == {k: want for k, (_, want) in enumerate(rows) if want}
