"""N-gram Jaccard join by partitioning the universe of shingles, with exact verification.

Every document is the set of its distinct word n-grams, as 64-bit hashes. Sizes fall into bands so that
two sets that can link lie in one band or in neighbouring ones. A band's scheme cuts the universe of
hashes into H + 1 + slack segments, H being the largest symmetric difference a linked pair of the band
may have: at most H segments differ, so the others agree and are signatures (pigeonhole).

Allocation by cost: a segment whose tokens are all frequent, or that is empty, is worth nothing and gets
no signature. Equal segments are good or bad in both sets, so a pair is found if either set has H + 1 good
segments. A set with fewer spends two units on segments with two or more infrequent tokens by adding their
one-deletion neighbourhood. A set that still falls short adds the prefix tokens of the classical prefix
filter. All three rules depend on the set and on one list of frequent shingles only, so no pair is lost
and the list changes cost alone.

A node is a distinct set of shingles; it has a number of its own from the table of distinct sets to the
answer, so that rows which repeat a doc_id with other texts stay apart. Nodes that share a signature are not
paired with each other: first each is paired with one centre of the bucket, verified exactly and joined into
components; then only pairs of different components in a bucket are looked at, by pairs of blocks of the
bucket, each a task's work, and those that a parity bitmap cannot rule out are verified exactly.

Edge cases: null or empty text, or text without words, has an empty set, n_shingles 0 and is linked with
nothing; fewer than n words make one shingle; exact copies are one node; rows with a null doc_id keep a
null component; repeated doc_ids are classed row by row, by their own text, and two such rows may have
different components; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, drop_spooled, join_hot, small_batches, spool

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BITMAP_WORDS = 16
#: Frequent shingles and large groups of copies that are broadcast at most; beyond them only cost grows.
MOST_HOT = 65_536
HOT_FROM = 256
COPIES_FROM = 16
BLOOM_BITS = 1 << 26
CHUNK = 1_000_000
#: Shingles whose counts a task carries from chunk to chunk, the most frequent ones.
CARRIED = 1 << 18
OFTEN = 8
#: Nodes of a bucket that one task compares with as many others.
BLOCK = 4096
MERGES = 2


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted distinct shingle hashes of UTF-8 texts, without a Python object per word.

    A word's hash is the difference of two prefix sums of byte values times powers of an odd base, scaled
    back to the start of the text, then mixed; upper-case A-Z have the values of a-z.
    """

    PIECE = 1 << 18

    def __init__(self, n: int):
        self.n = n
        rng = np.random.default_rng(20240229)
        odd = lambda k: rng.integers(1, 1 << 63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.mul, self.value = odd(n), odd(256)
        self.value[65:91] = self.value[97:123]
        self.space = np.zeros(256, bool)
        self.space[[9, 10, 11, 12, 13, 32]] = True
        base = int(odd(1)[0])
        self.base, self.back = base, pow(base, -1, 1 << 64)
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def powers(self, size: int) -> None:
        while len(self.up) < size:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(self.base, k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(self.back, k, 1 << 64))])

    def words(self, raw: np.ndarray) -> np.ndarray:
        """Hash of every word of a piece of text in turn."""
        gap = self.space[raw]
        edge = np.flatnonzero(np.diff(gap, prepend=True, append=True))
        first, last = edge[::2], edge[1::2]
        self.powers(len(raw) + 1)
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(self.value[raw] * self.up[: len(raw)], out=sums[1:])
        return mix((sums[last] - sums[first]) * self.down[first] + (last - first).astype(np.uint64))

    def __call__(self, raw: np.ndarray) -> np.ndarray:
        parts, at = [], 0
        while at < len(raw):
            to = min(at + self.PIECE, len(raw))
            while to < len(raw) and not self.space[raw[to]]:
                to += 1
            parts.append(self.words(raw[at:to]))
            at = to
        h = parts[0] if len(parts) == 1 else np.concatenate([np.empty(0, np.uint64), *parts])
        if not len(h):
            return h
        k = min(self.n, len(h))
        out = np.full(len(h) - k + 1, k, np.uint64)  # shorter texts: the whole sequence, told from longer ones by k
        for i in range(k):
            out += h[i : len(h) - k + 1 + i] * self.mul[i]
        out = mix(out)
        out.sort()
        return out[np.r_[True, out[1:] != out[:-1]]]


def bitmap(h: np.ndarray) -> np.ndarray:
    """Parity of the tokens in each of 1,024 places: differing bits bound the symmetric difference from below."""
    odd = np.bincount((h & np.uint64(64 * BITMAP_WORDS - 1)).astype(np.int64), minlength=64 * BITMAP_WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


class Bands:
    """Size bands with their largest symmetric difference, for linking at ``percent`` of the union."""

    def __init__(self, percent: int):
        self.percent, self.low = percent, [1, 2]

    def of(self, size: int) -> int:
        low, p = self.low, self.percent
        while low[-1] <= size:
            low.append(max(low[-1] + 1, (low[-1] - 1) * 100 // p + 1))
        import bisect

        return bisect.bisect_right(low, size) - 1

    def errors(self, band: int) -> int:
        self.of(self.low[-1] if band + 1 >= len(self.low) else 1)
        s = self.low[band + 1] - 1
        return differing(s, s * 100 // self.percent, self.percent)


def differing(a, b, percent: int):
    """Largest symmetric difference of linked sets of these sizes."""
    return (a + b) * (100 - percent) // (100 + percent)


def signatures(h: np.ndarray, bands: Bands, hot: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Bucket keys of one set, under its own band's scheme and the next smaller band's."""
    n, out, short = len(h), [], False
    where = np.minimum(np.searchsorted(hot, h), max(len(hot) - 1, 0))
    often = hot[where] == h if len(hot) else np.zeros(n, bool)
    token, own = mix(h ^ np.uint64(0x5851F42D4C957F2D)), bands.of(n)
    for band in range(max(own - 1, 0), own + 1):
        errors = bands.errors(band)
        m = errors + 2 + errors // 16
        seg = ((h >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
        first = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
        place = mix(seg[first] + np.uint64((band + 1) << 32))
        sums = np.add.reduceat(token, first)
        rare = np.add.reduceat((~often).astype(np.int64), first)
        good = rare > 0
        out.append(mix(sums[good] ^ place[good]))
        if (units := int(good.sum())) <= errors:
            two = rare > 1
            of = np.repeat(np.arange(len(first)), np.diff(np.r_[first, n]))
            pick = two[of]
            out.append(mix((sums[of] - token)[pick] ^ place[of][pick]))
            short |= units + int(two.sum()) <= errors
    if short:
        freq = np.where(often, counts[where], 0) if len(hot) else np.zeros(n, np.int64)
        most = n - (-(-bands.percent * n // 100)) + 1
        out.append(mix(token[np.lexsort((h, freq))[:most]] ^ np.uint64(0xA0761D6478BD642F)))
    return np.unique(np.concatenate(out))


def _texts(batches: Iterator[pa.RecordBatch], marked: bool = False):
    """(id, bytes) of each row, or ((id, third column), bytes); null text is empty."""
    for b in batches:
        text = b.column(1).cast(pa.large_binary())
        at = np.frombuffer(text.buffers()[1], np.int64, len(text) + 1, text.offset * 8)
        data = text.buffers()[2]
        data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
        ids = b.column(0).to_pylist()
        for i, x, y in zip(zip(ids, b.column(2).to_pylist(), strict=True) if marked else ids, at[:-1].tolist(), at[1:].tolist(), strict=True):
            yield i, data[x:y]


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


PLACES = [f"b{k}" for k in range(BITMAP_WORDS)]
NAMES = ("kind", "id", "n", "f1", "f2", "mark", *PLACES)
PROFILE = "kind int, " + ", ".join(f"{c} long" for c in NAMES[1:])
PRINTS = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)


def fingerprints(h: np.ndarray) -> list[int]:
    """Two sums that tell sets of shingles apart."""
    return [int(_signed(np.array([mix(h ^ np.uint64(s)).sum(dtype=np.uint64)]))[0]) for s in PRINTS]


def _profiles(n: int):
    """Per document (kind 0) size, two fingerprints, mark and bitmap; per task (kind 1) shingles met often, as id and n."""

    def run(batches):
        shingle, rows, fresh, size = Shingler(n), [], [], 0
        held, counts = np.empty(0, np.uint64), np.empty(0, np.int64)

        def count():
            nonlocal held, counts
            every = np.concatenate([np.empty(0, np.uint64), *fresh])
            fresh.clear()
            every.sort()
            first = np.flatnonzero(np.r_[True, every[1:] != every[:-1]][: len(every)])
            v, c = every[first], np.diff(first, append=len(every))
            del every, first
            at = np.minimum(np.searchsorted(held, v), max(len(held) - 1, 0))
            known = held[at] == v if len(held) else np.zeros(len(v), bool)
            counts[at[known]] += c[known]
            both, total = np.r_[held, v[~known]], np.r_[counts, c[~known]]
            top = np.argpartition(total, len(total) - CARRIED)[-CARRIED:] if len(total) > CARRIED else np.arange(len(total))
            top = top[np.argsort(both[top])]
            held, counts = both[top], total[top]

        def flush():
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in range(5)]
            bits = np.array(columns[5:] and columns[5], np.int64).reshape(len(rows), BITMAP_WORDS)
            first = [pa.array(columns[k], pa.int64()) for k in range(5)]
            return pa.RecordBatch.from_arrays([pa.array(np.zeros(len(rows), np.int32)), *first, *[pa.array(bits[:, k]) for k in range(BITMAP_WORDS)]], names=list(NAMES))

        for (i, mark), text in _texts(batches, marked=True):
            h = shingle(text)
            rows.append((i, len(h), *fingerprints(h), mark, _signed(bitmap(h))))
            fresh.append(h)
            size += len(h)
            if len(rows) >= 4096:
                yield flush()
                rows.clear()
            if size >= CHUNK:
                count()
                size = 0
        yield flush()
        count()
        pick = counts >= OFTEN
        k = int(pick.sum())
        nothing = [pa.nulls(k, pa.int64()) for _ in NAMES[3:]]
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(k, np.int32)), pa.array(_signed(held[pick])), pa.array(counts[pick]), *nothing], names=list(NAMES))

    return run


def _signature_rows(n: int, percent: int, lists):
    def run(batches):
        hot, counts, copies, owner = lists.value
        shingle, bands, keys, nodes, size = Shingler(n), Bands(percent), [], [], 0
        for i, text in _texts(batches):
            h = shingle(text)
            if i is None or not len(h):
                continue
            node = fingerprints(h)[0]
            at = int(np.searchsorted(copies, node))
            if at < len(copies) and copies[at] == node and owner[at] != i:
                continue  # one copy of a large group speaks for it
            k = signatures(h, bands, hot, counts)
            keys.append(k)
            nodes.append(np.full(len(k), node, np.int64))
            size += len(k)
            if size >= 200_000:
                yield pa.RecordBatch.from_arrays([pa.array(_signed(np.concatenate(keys))), pa.array(np.concatenate(nodes))], names=["key", "node"])
                keys, nodes, size = [], [], 0
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(_signed(np.concatenate(keys))), pa.array(np.concatenate(nodes))], names=["key", "node"])

    return run


def _chunks(batches, rows: int = 200_000):
    """Two columns of many small batches, as arrays of some length."""
    held, size = [], 0
    for b in batches:
        held.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
        size += b.num_rows
        if size >= rows:
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
            held, size = [], 0
    if size:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def _shared(batches):
    """Of rows sorted by key and node: those of keys with two or more nodes, with the bucket's first node as centre.

    Runs of any length pass through: of a chunk only its last row is held back, with the centre of its run.
    """
    key, node, centre, met = None, None, None, False  # the row held back; met: its run has rows already given
    for keys, nodes in _chunks(batches):
        if key is not None:
            keys, nodes = np.r_[key, keys], np.r_[node, nodes]
        new = np.r_[True, (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1])]
        keys, nodes = keys[new], nodes[new]
        start = np.r_[True, keys[1:] != keys[:-1]]
        first = np.flatnonzero(start)
        centres = np.repeat(nodes[first], np.diff(np.r_[first, len(keys)]))
        many = ~start | np.r_[keys[1:] == keys[:-1], False]
        if key is not None:
            centres[: first[1] if len(first) > 1 else len(keys)] = centre
            many[0] |= met
        key, node, centre, met = keys[-1], nodes[-1], centres[-1], bool(many[-1])
        yield pa.RecordBatch.from_arrays([pa.array(x[:-1][many[:-1]]) for x in (keys, nodes, centres)], names=["key", "node", "centre"])
    last = [x if met else [] for x in ([key], [node], [centre])]
    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in last], names=["key", "node", "centre"])


def _across(percent: int, nearest: bool):
    """Pairs of nodes of different components that the bitmaps cannot rule out, within a bucket's pair of blocks.

    Rows come sorted by key, x and y, the numbers of two blocks; equal ones compare a block with itself.
    nearest: of each component but a largest only the pair with most room below its bound, so that a bucket
    gives no more pairs than it has components.
    """

    def bucket(block, node, comp, n, bits):
        names, where, sizes = np.unique(comp, return_inverse=True, return_counts=True)
        if len(names) < 2:
            return
        order = np.lexsort((where, sizes[where]))  # members of a largest component come last and never lead
        block, node, where, n, bits = block[order], node[order], where[order], n[order], bits[order]
        split = block.min() != block.max()
        lead, best = int((where != where[-1]).sum()), {}
        for a in range(lead):
            room = differing(n[a + 1 :] + n[a], 0, percent) - np.bitwise_count(bits[a + 1 :] ^ bits[a]).sum(1).astype(np.int64)
            hit = (where[a + 1 :] != where[a]) & (room >= 0)
            hit = np.flatnonzero(hit & (block[a + 1 :] != block[a]) if split else hit)
            if not len(hit):
                continue
            if nearest:
                b = hit[np.argmax(room[hit])]
                if room[b] > best.get(where[a], (-1,))[0]:
                    best[where[a]] = room[b], a, b + a + 1
                continue
            for b in hit + a + 1:
                yield min(node[a], node[b]), max(node[a], node[b])
        for _, a, b in best.values():
            yield min(node[a], node[b]), max(node[a], node[b])

    def run(batches):
        held, last, seen = [], None, set()

        def flush():
            seen.update(bucket(*(np.concatenate([h[k] for h in held]) for k in range(5))))

        def out():
            a = np.array(sorted(seen), np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], names=["a", "b"])

        for b in batches:
            key, x, y, block, node, comp, n = (b.column(k).to_numpy() for k in range(7))
            bits = np.stack([b.column(7 + k).to_numpy() for k in range(BITMAP_WORDS)], 1).view(np.uint64)
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])) + 1), len(key)]
            for p, q in zip(cuts, cuts[1:], strict=False):
                if p == q:
                    continue
                if last is not None and (key[p], x[p], y[p]) != last:
                    flush()
                    held.clear()
                    if len(seen) > 100_000:
                        yield out()
                        seen.clear()
                held.append((block[p:q], node[p:q], comp[p:q], n[p:q], bits[p:q]))
                last = key[p], x[p], y[p]
        if held:
            flush()
        yield out()

    return run


def _bloom(ids: DataFrame, column: str) -> np.ndarray:
    """Bit table of the ids, of bounded size, built by a distributed bit_or."""
    n = ids.count()
    bits = 1 << max(16, min(BLOOM_BITS.bit_length() - 1, (16 * n).bit_length()))
    at = [F.pmod(F.xxhash64(F.lit(s), F.col(column)), F.lit(bits)) for s in (1, 2, 3)]
    rows = ids.select(F.explode(F.array(*at)).alias("p")).select(F.shiftright("p", 5).alias("w"), F.expr("shiftleft(1L, cast(p % 32 as int))").alias("m")).groupBy("w").agg(F.bit_or("m").alias("m"))
    table = np.zeros(bits >> 5, np.int64)
    got = rows.toArrow()
    table[got["w"].to_numpy()] = got["m"].to_numpy()
    return table


def _sets(n: int):
    def run(batches):
        shingle, rows, size = Shingler(n), [], 0
        schema = pa.schema([("id", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("n", pa.int64()), ("s", pa.list_(pa.int64()))])

        def out():
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)

        for i, text in _texts(batches):
            h = shingle(text)
            rows.append((i, *fingerprints(h), len(h), _signed(h)))
            size += len(h)
            if size > CHUNK // 4 or len(rows) >= 512:
                yield out()
                rows, size = [], 0
        yield out()

    return run


def jaccard_components(docs: DataFrame, *, words: int = 4, percent: int = 85, mark: str | None = None) -> DataFrame:
    """doc_id, n_shingles and component_id of every row; two rows link at 100 * shared >= percent * union.

    component_id is the smallest doc_id that has a text of the class.
    ``mark``: a long column that comes back last, to tell rows apart that repeat a doc_id.
    """
    with small_batches(docs.sparkSession):
        out = _components(docs, words, percent, mark)
    return out if mark else out.drop("mark")


def _components(docs: DataFrame, words: int, percent: int, mark: str | None) -> DataFrame:
    spark = docs.sparkSession
    marks = (F.col(mark) if mark else F.lit(None)).cast("long").alias("mark")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", marks)
    prof = spool(docs.mapInArrow(_profiles(words), PROFILE), "op2-profiles")
    hot = prof.where("kind = 1").groupBy("id").agg(F.sum("n").alias("c")).where(F.col("c") >= HOT_FROM).orderBy(F.desc("c"), "id").limit(MOST_HOT).toArrow()
    hv, hc = hot["id"].to_numpy().view(np.uint64), hot["c"].to_numpy()
    order = np.argsort(hv)
    rows = prof.where("kind = 0")
    one = ["f1", "f2", "n"]
    # the table of nodes: distinct sets, each with a number, the smallest id that has it, and its bitmap
    reps = rows.where("n > 0 and id is not null").groupBy(*one).agg(F.min("id").alias("rep"), F.count("*").alias("copies"), *[F.min(p).alias(p) for p in PLACES])
    reps = spool(reps.withColumn("nid", F.monotonically_increasing_id()), "op2-nodes")
    large = reps.where(F.col("copies") >= COPIES_FROM).orderBy(F.desc("copies"), "nid").limit(MOST_HOT)
    big = large.select("f1", "rep").toArrow()
    bo = np.argsort(big["f1"].to_numpy(), kind="stable")
    lists = spark.sparkContext.broadcast((hv[order], hc[order], big["f1"].to_numpy()[bo], big["rep"].to_numpy()[bo]))
    sigs = docs.select("doc_id", "text").mapInArrow(_signature_rows(words, percent, lists), "key long, node long")
    shared = spool(sigs.repartition("key").sortWithinPartitions("key", "node").mapInArrow(_shared, "key long, node long, centre long"), "op2-buckets")

    def verified(pairs: DataFrame) -> DataFrame:
        """Links among distinct pairs (a, b) of fingerprints, as numbers of nodes: bitmaps first, then the sets themselves."""
        side = lambda x: reps.select(F.col("f1").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in ("f2", "n", "nid", "rep", *PLACES)])
        most = F.expr(f"(a_n + b_n) * {100 - percent} div {100 + percent}")
        gap = sum((F.bit_count(F.col(f"a_{p}").bitwiseXOR(F.col(f"b_{p}"))) for p in PLACES), F.lit(0))
        near = pairs.join(side("a"), "a").join(side("b"), "b").where((F.abs(F.col("a_n") - F.col("b_n")) <= most) & (F.col("a_nid") != F.col("b_nid")))
        near = spool(near.where(gap <= most).select("a_nid", "b_nid", *[F.struct(F.col(x).alias("f1"), *[F.col(f"{x}_{c}").alias(c) for c in ("f2", "n", "nid", "rep")]).alias(x) for x in "ab"]), "op2-near")
        asked = spool(near.select(F.explode(F.array("a", "b")).alias("x")).select(F.col("x.rep").alias("id"), "x.f1", "x.f2", "x.n", "x.nid").distinct(), "op2-asked")
        table = spark.sparkContext.broadcast(_bloom(asked, "id"))
        places = [F.pmod(F.xxhash64(F.lit(s), F.col("doc_id")), F.lit(len(table.value) << 5)).alias(f"p{s}") for s in (1, 2, 3)]

        def maybe(batches):
            t = table.value

            def asked_rows():
                for b in batches:
                    hit = np.ones(b.num_rows, bool)
                    for k in (2, 3, 4):
                        p = b.column(k).to_numpy()
                        hit &= (t[p >> 5] >> (p & 31)) & 1 == 1
                    yield b.select([0, 1]).filter(pa.array(hit))

            yield from run_sets(asked_rows())

        run_sets = _sets(words)
        sets = docs.where("doc_id is not null").select("doc_id", "text", *places).mapInArrow(maybe, "id long, f1 long, f2 long, n long, s array<long>")
        # a row that repeats an asked id with another text has other fingerprints and goes; copies meet in the join's own partitions
        sets = spool(sets.join(asked, ["id", *one]).dropDuplicates(["id", *one]).select("nid", "s"), "op2-sets")
        pair = near.select("a_nid", "b_nid")
        both = join_hot(pair, sets.select(F.col("nid").alias("a_nid"), F.col("s").alias("a_s")), "a_nid").join(sets.select(F.col("nid").alias("b_nid"), F.col("s").alias("b_s")), "b_nid")
        same = F.size(F.array_intersect("a_s", "b_s"))
        links = both.where(100 * same >= percent * (F.size("a_s") + F.size("b_s") - same)).select(F.col("a_nid").alias("u"), F.col("b_nid").alias("v"))
        links = spool(links, "op2-links")
        drop_spooled(spark, near, asked, sets)
        return links

    def settled(edges: DataFrame) -> DataFrame:
        """Components of edges, whose own tables go."""
        cc = connected_components(edges)
        comps = spool(cc, "op2-comps")
        drop_spooled(spark, cc, edges)
        return comps

    star = shared.where("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
    comps = settled(verified(star))

    # Second look: buckets that still hold several components
    def of_node(comps):
        c = reps.select(F.col("f1").alias("node"), F.col("nid").alias("id")).join(comps, "id", "left")
        return c.groupBy("node").agg(F.min(F.coalesce("component", "id")).alias("comp"))

    placed = shared.select("key", "node").join(of_node(comps), "node")
    split = placed.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("many")).where("x <> y").select("key", "many")
    bits = reps.groupBy(F.col("f1").alias("node")).agg(*[F.min(c).alias(c) for c in ("n", *PLACES)])
    still = shared.select("key", "node").join(split, "key").join(bits, "node")
    # a bucket beyond BLOCK nodes is cut into blocks by a hash of the node; each pair of its blocks is a group of its own
    blocks = F.ceil(F.col("many") / BLOCK).cast("int")
    still = still.withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    still = spool(still.select("key", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "node", "n", *PLACES), "op2-open")
    drop_spooled(spark, shared)

    def across(comps, nearest):
        looked = still.join(of_node(comps), "node").select("key", "x", "y", "block", "node", "comp", "n", *PLACES)
        looked = looked.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")
        return spool(looked.mapInArrow(_across(percent, nearest), "a long, b long").distinct(), "op2-across")

    # rounds that join each component to its nearest keep the pairs few; the last look takes all that are left
    for k in range(MERGES + 1):
        pairs = across(comps, k < MERGES)
        found = verified(pairs) if pairs.limit(1).count() else None
        drop_spooled(spark, pairs)
        if found is not None and found.limit(1).count():
            comps = settled(comps.select(F.col("id").alias("u"), F.col("component").alias("v")).union(found))
    drop_spooled(spark, still)
    return _answer(rows, reps, comps, one)


def _answer(rows: DataFrame, reps: DataFrame, comps: DataFrame, one: list[str]) -> DataFrame:
    """Every row with the smallest doc_id of its node's component; large groups of copies meet a broadcast table."""
    own = reps.select(*one, "rep", "copies", F.col("nid").alias("id")).join(comps, "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = own.groupBy("component").agg(F.min("rep").alias("component_id"))
    own = spool(join_hot(own, least, "component").select(*one, "copies", "component_id"), "op2-own")
    drop_spooled(rows.sparkSession, reps, comps)
    filled, empty = rows.where("n > 0 and id is not null"), rows.where("n = 0 or id is null")
    filled = filled.select("id", *one, "mark")
    large = own.where(F.col("copies") >= COPIES_FROM).orderBy(F.desc("copies"), *one).limit(MOST_HOT).select(*one, F.col("component_id").alias("_near"))
    met = filled.join(F.broadcast(large), one, "left")
    out = met.where("_near is null").drop("_near").join(own.select(*one, "component_id"), one).select("id", "n", "component_id", "mark")
    out = out.union(met.where("_near is not null").select("id", "n", "_near", "mark")).union(empty.select("id", "n", "id", "mark"))
    return out.toDF("doc_id", "n_shingles", "component_id", "mark")


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: classes of all documents at four words and 85 per cent."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


# all pairs of distinct sets that share a shingle, counted shingle by shingle; reach sets for the classes
ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM w),
n AS MATERIALIZED (SELECT min(doc_id) AS rep, list_sort(s) AS s, len(s) AS n FROM g WHERE len(s) > 0 GROUP BY ALL),
u AS MATERIALIZED (SELECT rep, n, unnest(s) AS x FROM n),
k AS MATERIALIZED (SELECT a.rep AS x, b.rep AS y FROM u a JOIN u b ON a.x = b.x AND a.rep <> b.rep GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
r AS (SELECT rep AS x, rep AS y FROM n UNION SELECT r.x, k.y FROM r JOIN k ON k.x = r.y),
c AS (SELECT x, min(y) AS component_id FROM r GROUP BY x)
SELECT g.doc_id, CAST(len(g.s) AS BIGINT) AS n_shingles, coalesce(c.component_id, g.doc_id) AS component_id
FROM g LEFT JOIN n ON n.s = list_sort(g.s) LEFT JOIN c ON c.x = n.rep
"""
