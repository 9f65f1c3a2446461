"""Byte-level BPE encoding and decoding with a given rank file.

A text is split by the tokenizer's pattern; the bytes of each distinct word
are folded by ranked merges (lowest rank first, leftmost among equals) until
no pair of neighbours is in the rank map. Decoding looks up the bytes of every
id and concatenates the pieces.

``encode`` and ``decode`` run in Arrow batches, one pass over the documents
and no shuffle: a task folds each distinct word once and keeps the result in a
table of at most ``CACHE`` words. ``fold_words`` is the same fold as Spark
higher-order functions over a literal rank map; the README gives its figures
and why the corpus pass doesn't use it.

Edge cases: null is the empty text (no ids), a word of any length is folded in
O(n log n), repeated rows are encoded alike, an empty table gives an empty
result, extra columns stay untouched (new columns replace namesakes).
"""

from __future__ import annotations

import base64
import heapq
import zlib
from array import array

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .common import read_table, small_batches

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Words that a task remembers, and the longest one worth remembering.
CACHE, CACHED_BYTES = 400_000, 64
#: Matches that are turned into ids at a time.
MATCHES = 200_000
_HEAP_FROM = 48


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word."""
    if word in ranks:
        return [ranks[word]]
    return _merge_heap(word, ranks) if len(word) >= _HEAP_FROM else _merge_short(word, ranks)


def _merge_short(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    parts = [word[i: i + 1] for i in range(len(word))]
    get, none = ranks.get, len(ranks)
    pairs = [get(parts[i] + parts[i + 1], none) for i in range(len(parts) - 1)]
    while pairs:
        best = min(pairs)
        if best == none:
            break
        i = pairs.index(best)
        parts[i: i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i < len(pairs):
            pairs[i] = get(parts[i] + parts[i + 1], none)
        if i:
            pairs[i - 1] = get(parts[i - 1] + parts[i], none)
    return [ranks[p] for p in parts]


def _merge_heap(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Parts as a linked list of start positions, candidate pairs in a heap; an
    entry counts only while both its parts still end where they did."""
    n = len(word)
    after, before, get = list(range(1, n + 1)) + [n], list(range(-1, n)), ranks.get
    heap = []

    def offer(i: int) -> None:
        j = after[i]
        if j < n and (r := get(word[i: after[j]])) is not None:
            heapq.heappush(heap, (r, i, j, after[j]))

    for i in range(n - 1):
        offer(i)
    alive = [True] * n
    while heap:
        _, i, j, end = heapq.heappop(heap)
        if not alive[i] or after[i] != j or j >= n or not alive[j] or after[j] != end:
            continue
        alive[j], after[i] = False, end
        if end < n:
            before[end] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i: after[i]]])
        i = after[i]
    return out


class Words(dict):
    """word -> its ids as little-endian unsigned 32-bit integers; forgets all when full."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, word: str) -> bytes:
        raw = word.encode()
        a = array("I", merge(raw, self.ranks))
        out = a.tobytes()
        if len(raw) <= CACHED_BYTES:
            if len(self) >= CACHE:
                self.clear()
            self[word] = out
        return out


def _split(pattern, text: str):
    """Matches of the pattern, ``MATCHES`` at a time."""
    part = []
    for m in pattern.finditer(text):
        part.append(m[0])
        if len(part) == MATCHES:
            yield part
            part = []
    yield part


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, column: str = "text", to: str = "ids") -> DataFrame:
    """``docs`` with ``to``: ids as packed little-endian unsigned 32-bit integers."""
    def run():
        import regex

        compiled, words = regex.compile(pattern), Words(shared.value)

        def one(text):
            if not text:
                return b""
            if len(text) < MATCHES:
                return b"".join(map(words.__getitem__, compiled.findall(text)))
            return b"".join(b"".join(map(words.__getitem__, part)) for part in _split(compiled, text))
        return one

    shared = docs.sparkSession.sparkContext.broadcast(ranks)          # the rank file, a fixed size
    return _mapped(docs, run, column, to)


def decode(docs: DataFrame, ranks: dict[bytes, int], column: str = "ids", to: str = "decoded") -> DataFrame:
    """``docs`` with ``to``: the bytes that packed ids stand for (null ids: no bytes)."""
    def run():
        import numpy as np

        pieces = {i: p for p, i in shared.value.items()}

        def one(ids):
            return b"".join(map(pieces.__getitem__, np.frombuffer(ids, "<u4").tolist())) if ids else b""
        return one

    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    return _mapped(docs, run, column, to)


def _mapped(docs: DataFrame, start, column: str, to: str) -> DataFrame:
    small_batches(docs.sparkSession, 500)
    kept = [c for c in docs.columns if c != to]
    schema = StructType([*(f for f in docs.schema.fields if f.name != to), StructField(to, BinaryType())])

    def each(batches):
        import pyarrow as pa

        one = start()
        for b in batches:
            made = pa.array([one(x) for x in b.column(column).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), made], names=[*kept, to])

    return docs.mapInArrow(each, schema)


def id_array(packed: Column) -> Column:
    """Packed ids as array<int>."""
    h = F.hex(packed)
    places = F.sequence(F.lit(0), (F.octet_length(packed) / 4).cast("int") - 1)
    byte = lambda i, k: F.substring(h, i * 8 + 2 * k + 1, F.lit(2))
    number = lambda i: F.conv(F.concat(*[byte(i, k) for k in (3, 2, 1, 0)]), 16, 10).cast("int")
    return F.when(F.octet_length(packed) > 0, F.transform(places, number)).otherwise(F.array().cast("array<int>"))


def rank_map(ranks: dict[bytes, int], buckets: int = 1 << 17):
    """``hex(bytes) -> rank`` as a column function over a literal: an array of
    buckets by CRC-32, each bucket listing its few entries."""
    held = [""] * buckets
    for token, rank in ranks.items():
        key = token.hex().upper()
        at = zlib.crc32(key.encode()) % buckets
        held[at] = f"{held[at] or '|'}{key}:{rank}|"
    literal = F.split(F.lit(",".join(held)), ",")

    def rank(key: Column) -> Column:
        def found(bucket: Column) -> Column:
            mark = F.concat(F.lit("|"), key, F.lit(":"))
            at = F.instr(bucket, mark)
            return F.when(at > 0, F.substring_index(F.substring(bucket, at + F.length(mark), F.lit(9)), "|", 1).cast("int"))
        return _let(F.get(literal, (F.crc32(key) % buckets).cast("int")), found)

    return rank


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fold_words(word: Column, ranks: dict[bytes, int]) -> Column:
    """array<int> ids of a non-empty word (a string) by Spark's higher-order functions."""
    rank = rank_map(ranks)
    h = F.hex(word.cast("binary"))
    size = F.octet_length(word)
    start = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.substring(h, i * 2 + 1, F.lit(2)))

    def merged(parts: Column, at: Column) -> Column:
        pair = F.concat(F.get(parts, at - 1), F.get(parts, at))
        return F.concat(F.slice(parts, F.lit(1), at - 1), F.array(pair), F.slice(parts, at + 2, F.size(parts)))

    def step(a: Column, _: Column) -> Column:
        found = F.transform(a["parts"], lambda x, i: rank(F.concat(x, F.get(a["parts"], i + 1))))
        def choose(r: Column) -> Column:
            at = F.array_position(r, F.array_min(r)).cast("int")
            go = F.struct(merged(a["parts"], at).alias("parts"), F.lit(False).alias("done"))
            return F.when(F.array_min(r).isNull(), F.struct(a["parts"].alias("parts"), F.lit(True).alias("done"))).otherwise(go)
        return F.when(a["done"], a).otherwise(_let(found, choose))

    folded = F.aggregate(F.sequence(F.lit(1), size), F.struct(start.alias("parts"), F.lit(False).alias("done")), step, lambda a: a["parts"])
    return F.transform(folded, rank)


def default_tokenizer() -> tuple[dict[bytes, int], str]:
    """(ranks, pattern) of the public vocabulary the query is defined by."""
    import public_tokenizers

    return read_ranks(public_tokenizers.path(VOCABULARY)), public_tokenizers.PATTERN


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = default_tokenizer()
    coded = encode(read_table(spark, sf_dir, "documents").select("doc_id", "text"), ranks, pattern)
    out = decode(coded.select("doc_id", "ids"), ranks)
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {"op2_bpe": op2_bpe}
ORACLE: dict[str, str] = {}
