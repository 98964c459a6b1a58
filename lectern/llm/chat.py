"""Chat formatting as a prefix forest.

Every turn becomes `<s>role\\ntext</s>`, control strings inside broken up reversibly. Conversations that
share initial turns share the nodes of a prefix tree: a node is the digest of all turns up to it, made
distinct by one partial aggregate, so a first turn common to a third of all conversations is one row before
the shuffle. Nodes in the order of their paths are the forest depth first; their offsets in the emitted
stream come from a two-level prefix sum (within range partitions, then over the partitions' totals).
Tokens are code points. Runs of first children are segments, which carry their stream interval, the position
of their first token within its conversation, the stream intervals of their ancestors and those under the
loss mask. A conversation is a place in the stream, its last segment and stop, and is read back from there.

Edge cases: null text or role is empty; turns are ordered by turn, equal ones by role and text; repeated
rows are repeated turns; a null conv_id is a conversation of its own; a conversation that is the beginning
of another ends at an inner node; equal conversations share a leaf; roles other than assistant carry no
loss; an empty table gives empty results; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import join_hot, spool

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Strings that a chat model's tokenizer may treat as control tokens.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
BROKEN = re.compile("|".join(rf"{re.escape(c[0])}\\*{re.escape(c[1:])}" for c in CONTROL))
OPEN, CLOSE, SPEAKS = "<s>", "</s>", "assistant"


def escape(text: str) -> str:
    """Control strings with a backslash after their first character; one more where some stand there already."""
    return BROKEN.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return BROKEN.sub(lambda m: m[0][0] + m[0][2:] if m[0][1] == "\\" else m[0], text)


def _name(role: str) -> str:
    """Roles keep to one line."""
    return escape(role.replace("%", "%25").replace("\n", "%0A"))


def turn_block(role: str, text: str) -> tuple[str, int, int]:
    """Formatted turn and the interval of its loss, empty unless the assistant speaks."""
    head, body = f"{OPEN}{_name(role)}\n", escape(text)
    end = len(head) + len(body) if role == SPEAKS else len(head)
    return head + body + CLOSE, len(head), end


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation; escaped texts hold no control string, so the marks are plain."""
    out = []
    for part in formatted.split(CLOSE)[:-1]:
        role, _, text = part.removeprefix(OPEN).partition("\n")
        out.append((unescape(role).replace("%0A", "\n").replace("%25", "%"), unescape(text)))
    return out


CONVERSATION = "conv_id long, nodes array<struct<node:string,parent:string,depth:int,text:string,position:long,loss_start:long,loss_end:long>>, path string"
#: Hex digits a turn in the sort key; equal keys of siblings only cut segments shorter.
KEY = 8


def _paths(batches):
    """Nodes along each conversation; a node's name is the digest chain of the turns up to it."""
    node = pa.struct([("node", pa.string()), ("parent", pa.string()), ("depth", pa.int32()), ("text", pa.string()), ("position", pa.int64()), ("loss_start", pa.int64()), ("loss_end", pa.int64())])
    for b in batches:
        rows = []
        for turns in b.column(1).to_pylist():
            path, above, at = [], "", 0
            for t in turns:
                text, x, y = turn_block(t["role"], t["text"])
                name = hashlib.sha256(f"{above}\n{text}".encode("utf-8", "surrogatepass")).hexdigest()[:32]
                path.append({"node": name, "parent": above, "depth": len(path), "text": text, "position": at, "loss_start": x, "loss_end": y})
                above, at = name, at + len(text)
            rows.append(path)
        keys = ["".join(n["node"][:KEY] for n in p) for p in rows]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(node)), pa.array(keys, pa.string())], names=["conv_id", "nodes", "path"])


def format_forest(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(stream, leaves) of rows conv_id, turn, role, text.

    stream: one row a segment, which is a run of nodes each the first child of the one before: start, stop,
    text, position, loss (array of start, stop in the stream) and ancestors (array of start, stop, outermost
    first; each starts a segment). A token may attend to its segment's ancestors and to all before it in the
    segment. leaves: conv_id, the start of its last segment and the place where the conversation stops.
    """
    t = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = t.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    convs = spool(grouped.mapInArrow(_paths, CONVERSATION).withColumn("cid", F.monotonically_increasing_id()), "op9-paths")
    each = convs.select("cid", "path", F.explode("nodes").alias("n")).select("cid", "n.*", F.substring(F.col("path"), F.lit(1), (F.col("n.depth") + 1) * KEY).alias("path"))
    # one row a node: all its rows are equal but for the conversation, of which any will do
    same = ("parent", "depth", "text", "position", "loss_start", "loss_end", "path")
    nodes = each.groupBy("node").agg(F.min("cid").alias("cid"), *[F.first(c).alias(c) for c in same])
    spark = turns.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = nodes.repartitionByRange(parts, "path", "node").withColumn("part", F.spark_partition_id()).withColumn("size", F.length("text").cast("long"))
    ranged = spool(ranged, "op9-nodes")
    totals = sorted((r["part"], r["s"]) for r in ranged.groupBy("part").agg(F.sum("size").alias("s")).collect())  # one number a partition
    base, at = {}, 0
    for p, s in totals:
        base[p], at = at, at + s
    bases = spark.createDataFrame(list(base.items()) or [(0, 0)], "part int, base long")
    order = Window.partitionBy("part").orderBy("path", "node")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = ranged.join(F.broadcast(bases), "part").withColumn("start", F.col("base") + F.sum("size").over(upto) - F.col("size"))
    head = F.coalesce(F.lag("node").over(order) != F.col("parent"), F.lit(True))
    placed = placed.withColumn("head", head).withColumn("segment", F.max(F.when(F.col("head"), F.col("start"))).over(upto))
    keep = ("node", "cid", "depth", "text", "position", "loss_start", "loss_end", "start", "head", "segment")
    placed = spool(placed.select(*keep, (F.col("start") + F.col("size")).alias("stop")), "op9-placed")
    # what a segment's first node hangs from: for each segment above, how far down the path it goes
    heads = placed.where("head and depth > 0").select(F.col("start").alias("at"), "cid", "depth")
    above = heads.join(convs.select("cid", F.transform("nodes", lambda n: n["node"]).alias("p")), "cid").select("at", F.explode(F.expr("slice(p, 1, depth)")).alias("node"))
    above = spool(above, "op9-above")
    above = join_hot(above, placed.select("node", "segment", "stop"), "node").groupBy("at", "segment").agg(F.max("stop").alias("stop"))
    above = above.groupBy("at").agg(F.array_sort(F.collect_list(F.struct(F.col("segment").alias("start"), "stop"))).alias("ancestors"))
    loss = F.struct((F.col("start") + F.col("loss_start")).alias("start"), (F.col("start") + F.col("loss_end")).alias("stop"))
    whole = placed.groupBy("segment").agg(
        F.max("stop").alias("stop"), F.min("position").alias("position"),
        F.array_sort(F.collect_list(F.struct("start", "text"))).alias("texts"),
        F.array_sort(F.collect_list(F.when(F.col("loss_start") < F.col("loss_end"), loss))).alias("loss"),
    )
    stream = whole.join(above.withColumnRenamed("at", "segment"), "segment", "left").select(
        F.col("segment").alias("start"), "stop", F.array_join(F.transform("texts", lambda x: x["text"]), "").alias("text"), "position", "loss",
        F.coalesce("ancestors", F.array().cast("array<struct<start:bigint,stop:bigint>>")).alias("ancestors"),
    )
    stream = spool(stream, "op9-stream")
    last = convs.select("conv_id", F.element_at("nodes", -1)["node"].alias("node"))
    leaves = join_hot(last, placed.select("node", "segment", "stop"), "node").select("conv_id", F.col("segment").alias("start"), "stop")
    return stream, leaves


def read_back(stream: DataFrame, leaves: DataFrame) -> DataFrame:
    """conv_id, formatted text and loss intervals within it, from the stream alone."""
    leaves = leaves.withColumnRenamed("stop", "until").withColumn("_c", F.monotonically_increasing_id())
    rows = join_hot(spool(leaves, "op9-leaves"), stream.select("start", "ancestors"), "start")
    spans = F.concat("ancestors", F.array(F.struct("start", F.col("until").alias("stop"))))
    rows = spool(rows.select("_c", "conv_id", F.explode(spans).alias("s")).select("_c", "conv_id", F.col("s.start").alias("start"), F.col("s.stop").alias("until")), "op9-spans")
    # a segment that many conversations share repeats once a salt, not once a conversation, before it meets them
    parts = join_hot(rows, stream.select("start", "text", "position", "loss"), "start")
    shift = F.col("position") - F.col("start")
    heard = F.filter("loss", lambda x: x["stop"] <= F.col("until"))
    heard = F.transform(heard, lambda x: F.struct((x["start"] + shift).alias("x"), (x["stop"] + shift).alias("y")))
    cut = F.substring(F.col("text"), F.lit(1), (F.col("until") - F.col("start")).cast("int"))
    whole = parts.groupBy("_c", "conv_id").agg(F.array_sort(F.collect_list(F.struct("position", cut.alias("text"), heard.alias("loss")))).alias("p"))
    loss = F.flatten(F.transform("p", lambda s: s["loss"]))
    return whole.select("conv_id", F.array_join(F.transform("p", lambda s: s["text"]), "").alias("formatted"), loss.alias("loss"))


def _digests(batches):
    sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
    names = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    for b in batches:
        rows = []
        for text, loss in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            turns = read_turns(text)
            said = "".join(unescape(text[s["x"] : s["y"]]) for s in loss)
            rows.append((len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(said), sha(said), len(text)))
        cols = zip(*rows, strict=True) if rows else [[]] * 5
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=["conv_id", *names])


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: format all conversations and one of control strings, read them back, digest what was read."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    stream, leaves = format_forest(rows.union(more))
    return read_back(stream, leaves).mapInArrow(_digests, DIGESTS)


ORACLE = """
WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT -1, t, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r)),
e AS (SELECT *, length(regexp_replace(text, '(<)(\\\\*)(s>|/s>|<SYS>>|</SYS>>|\\|im_start\\|>|\\|im_end\\|>|\\|endoftext\\|>)|(\\[)(\\\\*)(INST\\]|/INST\\])', '\\1\\2\\3\\4\\5\\6~', 'g')) AS n FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
 CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
 CAST(sum(n + length(role) + 8) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
