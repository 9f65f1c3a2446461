"""Near-duplicate classes by Order MinHash.

A document is its sequence of lower-cased words; its k-mers are the shingles
of ``SHINGLE`` words, a repeated shingle being labelled by its occurrence. For
each of ``SKETCHES`` hash functions the ``KEPT`` smallest k-mers are taken and
hashed in the order they have in the text, so two documents agree on a sketch
only if they share these k-mers in the same order. Documents with an equal
sketch are candidates; a candidate pair is verified by aligning the two
shingle sequences (longest common subsequence, bit-parallel, within the band
outside which the threshold can't be met): matched / (all - matched) must be
``SIMILARITY`` or more. Links join documents into classes.

Equal word sequences are one node. Sketches are buckets for ``linking.classes``:
leaders first, then an exact prefix filter over labelled shingles, never all pairs
of a bucket. Words are stored for the nodes that share a bucket only.

Edge cases: null texts and texts without a word are classes of their own
(repeated doc_ids of such rows share it); fewer than five words are one
shingle; rows that repeat a doc_id or a text are one node per distinct word
sequence; class_id is the smallest doc_id of the class, rows with a null doc_id
take part and get it too (null if all are null); of each class one row is kept, the first
by doc_id (null last) and text digest; empty tables give empty results; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, stored
from .linking import BROADCAST_ROWS, Method, classes, components  # noqa: F401

SHINGLE = 5
SIMILARITY = 0.8
SKETCHES = 24
KEPT = 5
#: Below SHORT shingles sketches keep SHORT_KEPT k-mers; from BOTH to SHORT a document has sketches of either kind.
SHORT, BOTH, SHORT_KEPT = 32, 25, 2
_WORD = re.compile(r"[^\W_]+")
_SEEDS = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, (2, SKETCHES), dtype=np.uint64)
_CELLS = 1 << 21


class _Crc(dict):
    """word -> CRC-32, remembered for the task (forgets all when full)."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 500_000:
            self.clear()
        out = self[word] = zlib.crc32(word.encode("utf-8", "replace"))
        return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(codes: np.ndarray) -> np.ndarray:
    """64-bit hash of every run of SHINGLE words; fewer words are one shingle."""
    if not len(codes):
        return np.zeros(0, np.uint64)
    wide = codes.astype(np.uint64)
    n = max(1, len(wide) - SHINGLE + 1)
    out = np.full(n, len(wide) if len(wide) < SHINGLE else SHINGLE, np.uint64)
    for k in range(min(SHINGLE, len(wide))):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + wide[k: k + n])
    return out


def labelled(s: np.ndarray) -> np.ndarray:
    """Shingles with their occurrence number mixed in."""
    order = np.argsort(s, kind="stable")
    ranked = s[order]
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    if new.all():
        return s
    at = np.arange(len(s))
    occurrence = at - np.maximum.accumulate(np.where(new, at, 0))
    out = s.copy()
    out[order] = np.where(occurrence > 0, _mix(ranked + occurrence.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), ranked)
    return out


def sketches(s: np.ndarray) -> np.ndarray:
    """Order MinHash sketches of a shingle sequence, as hashes."""
    n, made = len(s), []
    if not n:
        return np.zeros(0, np.int64)
    s = labelled(s)
    kinds = [KEPT] * (n >= BOTH) + [SHORT_KEPT] * (n < SHORT)
    step = max(1, _CELLS // n)
    for a in range(0, SKETCHES, step):
        value = (s[None, :] ^ _SEEDS[0, a: a + step, None]) * (_SEEDS[1, a: a + step, None] | np.uint64(1))
        value ^= value >> np.uint64(32)
        for kept in kinds:
            at = np.argpartition(value, kept - 1, axis=1)[:, :kept] if n > kept else np.tile(np.arange(n), (len(value), 1))
            at.sort(axis=1)                                             # text order
            key = np.arange(a, a + len(at), dtype=np.uint64) + np.uint64(1000 * kept)
            for k in range(at.shape[1]):
                key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + s[at[:, k]])
            made.append(key)
    return np.concatenate(made).view(np.int64)


def similar(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> bool:
    """Whether the aligned similarity of two shingle sequences is ``least`` or more.

    LCS of m gives m / (|a| + |b| - m) >= least, i.e. at most ``room`` shingles
    on both sides together are unmatched: common ends are cut off and the rest is
    aligned row by row, the row being one integer whose bits are the columns of
    the band (matches further than ``room`` off the diagonal can't belong to an
    alignment that passes)."""
    total = len(a) + len(b)
    need = -int(-(least * total / (1 + least) - 1e-9) // 1)                 # least m that passes
    if min(len(a), len(b)) < need:
        return False
    room = total - 2 * need
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    head = int(differ[0]) if len(differ) else n
    a, b = a[head:], b[head:]
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[::-1][:n] != b[::-1][:n])
    tail = int(differ[0]) if len(differ) else n
    a, b = a[: len(a) - tail].tolist(), b[: len(b) - tail].tolist()
    need -= head + tail
    if need <= 0:
        return True
    if min(len(a), len(b)) < need:
        return False
    places: dict[int, int] = {}
    for j, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    row, band = full, (1 << (2 * room + 1)) - 1
    for i, x in enumerate(a):
        hit = places.get(x, 0)
        if hit:
            hit &= band << (i - room) if i >= room else band >> (room - i)
            met = row & hit
            row = ((row + met) | (row - met)) & full
    return len(b) - row.bit_count() >= need


def method(least: float = SIMILARITY) -> Method:
    crc = _Crc()

    def encode(text):
        words = _WORD.findall(text.decode("utf-8", "replace").lower()) if text else []
        codes = np.fromiter(map(crc.__getitem__, words), np.uint32, len(words))
        # the digest is of the words themselves, not of their codes
        mark = hashlib.md5(" ".join(words).encode("utf-8", "replace")).digest() if words else None
        return mark, max(0, len(codes) - SHINGLE + 1) or int(len(codes) > 0), codes.tobytes()

    read = lambda form: shingles(np.frombuffer(form, np.uint32))
    # matched / (all - matched) of an alignment is at most the Jaccard similarity of the labelled shingles
    return Method(encode, lambda form: sketches(read(form)), lambda a, b: similar(read(a), read(b), least), lambda form: labelled(read(form)), least)


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class, the first by doc_id (null last) and text
    digest. Texts aren't shuffled as long as the dropped ids can be broadcast."""
    found = stored(classes(docs, method()).select("doc_id", "text_md5", "kept"), "omh-kept")
    key = [F.col("doc_id").alias("__omh_id"), F.col("text_md5").alias("__omh_md5")]
    same = docs["doc_id"].cast("long").eqNullSafe(F.col("__omh_id")) & F.md5(docs["text"].cast("binary")).eqNullSafe(F.col("__omh_md5"))
    out = docs.join(_checked(found.where(~F.col("kept")).select(*key).distinct()), same, "left_anti")
    # rows of one doc_id and text that stay: one of them
    twice = found.where("kept").groupBy("doc_id", "text_md5").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*key)
    if not twice.limit(1).count():
        return out
    twice = _checked(stored(twice, "omh-twice"))
    once = out.join(twice, same, "left_semi").withColumn("__omh_md5", F.md5(F.col("text").cast("binary"))).dropDuplicates(["doc_id", "__omh_md5"]).drop("__omh_md5")
    return out.join(twice, same, "left_anti").unionByName(once)


def _checked(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def op7_omh_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(read_table(spark, sf_dir, "documents"), method()).select("doc_id", "class_id", "kept")


QUERIES = {"op7_omh_dedup": op7_omh_dedup}
ORACLE: dict[str, str] = {}
