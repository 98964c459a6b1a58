"""BPE encoding and decoding with a priority queue of merge ranks over a doubly linked symbol list.

Reads a tokenizer file (model BPE with end-of-word suffix, NFC and lower-case normalisation, byte-level
alphabet). The path is a parameter; each Python worker loads the file once. Words repeat, so a bounded
table keeps the ids of short pieces; a piece outside it is merged again, with the same result.

Edge cases: null text is empty and gives no ids; strings of special tokens in a text are their ids, as
the library does by default; very long pieces take n log n steps; repeated rows are encoded each; an
empty table gives an empty one; extra columns are dropped unless named in ``keep``.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import sys
import types
import unicodedata

import pyarrow as pa
import regex
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed value: the pre-tokenising pattern of the vocabulary's file, with white space written out as Unicode's White_Space.
SPACES = r"\t-\r \x85\xa0  -     　"
PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{SPACES}\p{{L}}\p{{N}}]+"


def byte_alphabet() -> list[str]:
    """Printable stand-in of each byte: printable Latin-1 stands for itself, the rest follow U+0100 in order."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Codec:
    """Encoder and decoder of one tokenizer file."""

    def __init__(self, path: str, most_kept: int = 300_000, longest_kept: int = 48):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, self.suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        self.strings = {i: s for s, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings |= {i: s for s, i in self.special.items()}
        alphabet = byte_alphabet()
        self.inner = [vocab[c] for c in alphabet]
        self.last = [vocab[c + self.suffix] for c in alphabet]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[vocab[a], vocab[b]] = rank, vocab[a + b]
        self.pieces = regex.compile(PIECES)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.kept: dict[str, tuple[list[int], str]] = {}
        self.bare: dict[str, tuple[int, ...]] = {}
        self.most_kept, self.longest_kept = most_kept, longest_kept

    def merge(self, piece: str) -> list[int]:
        """Ids of one pre-token: lowest rank first, leftmost of equal ranks, over a linked list of symbols."""
        raw = piece.encode("utf-8", "surrogatepass")
        sym = [self.inner[b] for b in raw]
        sym[-1] = self.last[raw[-1]]
        n, merges = len(sym), self.merges
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        queue = [(m[0], i) for i in range(n - 1) if (m := merges.get((sym[i], sym[i + 1])))]
        heapq.heapify(queue)
        while queue:
            rank, i = heapq.heappop(queue)
            if not alive[i] or (j := after[i]) >= n:
                continue
            m = merges.get((sym[i], sym[j]))
            if m is None or m[0] != rank:
                continue  # stale: a neighbour has changed since
            sym[i], alive[j], after[i] = m[1], False, after[j]
            if after[i] < n:
                before[after[i]] = i
                if m := merges.get((sym[i], sym[after[i]])):
                    heapq.heappush(queue, (m[0], i))
            if (h := before[i]) >= 0 and (m := merges.get((sym[h], sym[i]))):
                heapq.heappush(queue, (m[0], h))
        return [s for s, a in zip(sym, alive, strict=True) if a]

    def piece(self, w: str) -> tuple[list[int], str]:
        """Ids of a pre-token, and as decimals."""
        got = self.kept.get(w)
        if got is None:
            ids = self.merge(w)
            got = ids, " ".join(map(str, ids))
            if len(w) <= self.longest_kept:
                if len(self.kept) >= self.most_kept:
                    self.kept.clear()
                self.kept[w] = got
        return got

    def words(self, part: str) -> list[str]:
        """Pre-tokens of a text without special tokens."""
        return self.pieces.findall(unicodedata.normalize("NFC", part).replace("Σ", "σ").lower())

    def parts(self, text: str):
        """(ids, decimals) of each pre-token or special token in turn."""
        for k, part in enumerate(self.specials.split(text) if "<|" in text else [text]):
            if k % 2:
                yield [self.special[part]], str(self.special[part])
            elif part:
                yield from map(self.piece, self.words(part))

    def ids(self, w: str) -> tuple[int, ...]:
        """Ids of a pre-token alone: half the memory of what ``piece`` keeps."""
        got = self.bare.get(w)
        if got is None:
            got = tuple(self.merge(w))
            if len(w) <= self.longest_kept:
                if len(self.bare) >= self.most_kept:
                    self.bare.clear()
                self.bare[w] = got
        return got

    def encode(self, text: str) -> list[int]:
        out = []
        for k, part in enumerate(self.specials.split(text) if "<|" in text else [text]):
            if k % 2:
                out.append(self.special[part])
            elif part:
                for w in self.words(part):
                    out += self.ids(w)
        return out

    def decode(self, ids: list[int]) -> str:
        """Vocabulary strings one after another; the file names no decoder, so a space stands between them."""
        return " ".join(map(self.strings.__getitem__, ids))


def codec(path: str) -> Codec:
    """The file's codec, loaded once a worker process; functions arrive by value, so a module holds it."""
    held = sys.modules.setdefault("_lectern_codecs", types.ModuleType("_lectern_codecs")).__dict__
    if path not in held:
        held[path] = Codec(path)
    return held[path]


def _by_size(batch: pa.RecordBatch, made, most: int = 1 << 20):
    """Slices of a batch with what was made of their rows, cut once that adds up to ``most`` items; Spark bounds a batch's own bytes."""
    held, size, at = [], 0, 0
    for x in made:
        held.append(x)
        size += len(x)
        if size >= most:
            yield batch.slice(at, len(held)), held
            at, held, size = at + len(held), [], 0
    yield batch.slice(at, len(held)), held


def encode(docs: DataFrame, path: str, *, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` and ids of every whole text."""
    schema = docs.select(*keep).schema.add("ids", T.ArrayType(T.IntegerType()))

    def run(batches):
        c = codec(path)
        for b in batches:
            for part, ids in _by_size(b, (c.encode(t.as_py() or "") for t in b.column(len(keep)))):
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(ids, pa.list_(pa.int32()))], names=[*keep, "ids"])

    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, *, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` and the text that the column ids stands for."""
    schema = encoded.select(*keep).schema.add("text", T.StringType())

    def run(batches):
        c = codec(path)
        for b in batches:
            for part, text in _by_size(b, (c.decode(i.as_py() or []) for i in b.column(len(keep)))):
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(text, pa.string())], names=[*keep, "text"])

    return encoded.select(*keep, F.col("ids").alias("_ids")).mapInArrow(run, schema)


def round_trip_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, number of ids, digest of the ids and of what they decode to; ids stay in the worker."""

    def run(batches):
        c = codec(path)
        sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        for b in batches:
            rows = []
            for t in b.column(1):
                parts = list(c.parts(t.as_py() or ""))
                ids = [i for p in parts for i in p[0]]
                rows.append((len(ids), sha(" ".join([p[1] for p in parts])), sha(c.decode(ids))))
            cols = zip(*rows, strict=True) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(x, k) for x, k in zip(cols, (pa.int64(), pa.string(), pa.string()), strict=True)]], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def vocabulary_path() -> str:
    """Default file of the query; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: round trip of all documents."""
    return round_trip_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary_path())
