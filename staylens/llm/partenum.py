"""Self-join of shingle sets by Jaccard similarity with PartEnum signatures.

A document is the set of its runs of ``RUN`` words (64-bit hashes); documents
with equal sets are one node. Set sizes are cut into bands. Two sets of a band
whose similarity is ``NUM / DEN`` or more differ in at most k features, k following
from the band's largest size; the feature domain is partitioned into groups of
``PARTS`` parts, and for each group every subset of ``PARTS - ERRORS`` parts gives a
signature of the features in it. There are so many groups that, however k differences
are spread, similar sets agree in at least one signature, and in up to ``AGREE`` in the
bands of larger sets (``Bands.agree``): there a document that shares fewer with all others
together is left out. A set also has the signatures of the next band if a partner can
lie there. With two parts and one error a difference costs one signature, the least
possible (three parts take half as many again, to be chosen where common passages are
long).

Signatures are buckets for ``linking.classes``: leaders first, then an exact prefix
filter; candidates are verified on their whole sets. Only nodes that share a bucket
have their sets rebuilt from the text, each set moving with its leader's cell.

Edge cases: null texts and texts without a word are empty sets, linked with
nothing, not even with each other (repeated doc_ids share their own component);
fewer than ``RUN`` words are one shingle; rows with a null doc_id take part
and get the smallest doc_id they reach, null if there is none; rows that repeat a
doc_id are nodes by their own sets; empty tables give empty results; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from itertools import combinations, count
from math import comb

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table
from .linking import Method, classes

RUN = 3
NUM, DEN = 90, 100
PARTS, ERRORS = 2, 1
#: Signatures that similar sets share at least: one more for every STEP differences, up to AGREE.
AGREE, STEP = 4, 8
_BANDS = 256
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_set(text: bytes | None, run: int = RUN) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``run`` words (A-Z lower-cased)."""
    import xxhash

    words = (text or b"").lower().split()                       # bytes: ASCII case and blanks only
    codes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    if not len(codes):
        return codes
    width = min(run, len(codes))
    out = np.full(len(codes) - width + 1, width, np.uint64)
    for k in range(width):
        out = _mix(out * _ODD + codes[k: k + len(out)])
    return np.unique(out)


def agreeing(groups: int, differences: int, parts: int = PARTS, errors: int = ERRORS) -> int:
    """Signatures that two sets share, however so many differences are spread over the parts."""
    left = [comb(parts - d, parts - errors) for d in range(errors + 2)]
    out = groups * left[0]
    for lost in (a - b for a, b in zip(left, left[1:])):                # the first difference of a group costs most
        hit = min(groups, differences)
        out, differences = out - hit * lost, differences - hit
    return out


class Bands:
    """Ranges of set sizes, each as wide as two steps of the size filter."""

    def __init__(self, num: int = NUM, den: int = DEN, parts: int = PARTS, errors: int = ERRORS):
        self.num, self.den, self.parts, self.errors = num, den, parts, errors
        self.tops, self.held = [], {}

    def of(self, n: int) -> int:
        while not self.tops or self.tops[-1] < n:
            low = self.tops[-1] + 1 if self.tops else 1
            self.tops.append(low * self.den ** 2 // self.num ** 2)
        return bisect_left(self.tops, n)

    def instances(self, n: int) -> list[int]:
        """The bands in which a set of ``n`` features looks for partners."""
        band, most = self.of(n), n * self.den // self.num
        return [band, self.of(most)] if most > self.tops[band] else [band]

    def differences(self, band: int) -> int:
        return (self.den - self.num) * 2 * self.tops[band] // (self.den + self.num)

    def agree(self, band: int) -> int:
        return min(AGREE, 1 + self.differences(band) // STEP)

    def groups(self, band: int) -> int:
        if band not in self.held:
            k = self.differences(band)
            self.held[band] = next(g for g in count(k // (self.errors + 1) + 1) if agreeing(g, k, self.parts, self.errors) >= self.agree(band))
        return self.held[band]

    def least(self, key: Column) -> tuple[Column, Column]:
        """(band, signatures shared at least) of a signature column."""
        band, shared = F.pmod(key, _BANDS), F.lit(AGREE)
        self.of(AGREE * STEP * (self.den + self.num) // (self.den - self.num))
        for want in range(1, AGREE):
            own = [b for b in range(len(self.tops)) if self.agree(b) == want]
            shared = F.when(band.isin(own), F.lit(want)).otherwise(shared)
        return band, shared


def signatures(features: np.ndarray, bands: Bands) -> np.ndarray:
    """PartEnum signatures of a set, as 64-bit hashes that end in the band's number."""
    found = []
    for band in bands.instances(len(features)) if len(features) else ():
        if not bands.differences(band):                                 # only equal sets are similar
            continue
        groups, parts = bands.groups(band), bands.parts
        held = np.zeros(groups * parts, np.uint64)
        np.add.at(held, ((features >> np.uint64(7)) % np.uint64(len(held))).astype(np.int64), _mix(features * _ODD + np.uint64(band)))
        held = _mix(held + np.arange(1, len(held) + 1, dtype=np.uint64) * _ODD).reshape(groups, parts)
        for subset in combinations(range(parts), parts - bands.errors):
            key = _mix(held[:, subset].sum(axis=1, dtype=np.uint64) * _ODD + np.uint64(band + 1))
            found.append(key - key % np.uint64(_BANDS) + np.uint64(band % _BANDS))
    return np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64)


def encode(text: bytes | None) -> tuple[bytes | None, int, bytes]:
    """(digest of the set, None if it is empty; its size; its sorted hashes)."""
    s = shingle_set(text)
    form = s.tobytes()
    return hashlib.md5(form).digest() if len(s) else None, len(s), form


def similar(a: np.ndarray, b: np.ndarray, num: int = NUM, den: int = DEN) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return den * both >= num * (len(a) + len(b) - both)


def method(num: int = NUM, den: int = DEN, parts: int = PARTS, errors: int = ERRORS) -> Method:
    """Linked if ``den`` * intersection >= ``num`` * union."""
    read, bands = lambda form: np.frombuffer(form, np.uint64), Bands(num, den, parts, errors)
    return Method(encode, lambda form: signatures(read(form), bands), lambda a, b: similar(read(a), read(b), num, den), read, num / den, bands.least)


def op13_partenum(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = classes(read_table(spark, sf_dir, "documents"), method())
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.col("class_id").alias("component_id"))


QUERIES = {"op13_partenum": op13_partenum}
#: All pairs of shingle sets are too slow in SQL; tests/llm compares with brute force.
ORACLE: dict[str, str] = {}
