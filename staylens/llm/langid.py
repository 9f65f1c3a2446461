"""Language identification by a string kernel.

Kernel: blended-spectrum presence kernel. A text's features are the distinct
character n-grams (n = 1..``ORDERS``) of its lower-cased words, hashed to
``WIDTH`` places; k(x, z) is the cosine of the two presence vectors. Training:
Nystroem features from ``landmarks`` texts per language and one-versus-rest
kernel ridge regression. Scoring: a batch's presence matrix times one
(WIDTH x languages) matrix, in which landmarks, whitening and ridge weights
are folded together (the products are associative).

The ridge regression and the limits learn from every labelled row: tasks add up the
moments of their rows' kernel values (a matrix of landmarks x landmarks), the driver
solves the summed system. The landmarks, the method's basis, are the first
``LANDMARKS`` texts of each language in hash order of doc_id, at most ``BASIS`` in
all, as presence bits (``WIDTH`` / 8 bytes each). Scoring reads whole texts, in
pieces of ``PIECE`` characters.

Edge cases: null texts and texts without a letter are ``und`` with score 0, as
is everything if no labelled row exists; rows that repeat a doc_id are scored
one by one and count once in the fit; a null doc_id counts as the empty text
for the split; extra columns are ignored.

``drop_unidentified`` also asks how well the winner fits. Held-out labelled rows
and the same rows with their characters shuffled are scored, by classes of the
number of distinct n-grams (powers of two). Where the rows named rightly lie
above the shuffled ones, texts of the class that fit no better than the best
shuffled one go: the whole gap is left to unusual clean texts. On either side the
one in ``TAIL`` rows nearest the other side is passed over (fewer rows: none), else
one odd row among millions would lift a class's limit. A class with fewer than ``LEAST_CLASS`` clean rows is compared with those of the next smaller
class (values grow with size); one that has fewer shuffled rows, or overlaps,
takes the next smaller class's limit. Below the smallest limit a text is too
short to be told from noise and stays.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from ..operators.selection import exact_quantiles
from .common import read_table, small_batches, stored

ORDERS = 4
WIDTH = 1 << 15
PIECE = 1 << 20
LANDMARKS, BASIS = 100, 4000
BLOCK = 128
#: Texts scored together: a worker holds TEXTS x WIDTH x 6 bytes for them.
TEXTS = 64
#: Least held-out rows in a class; one row in so many may lie beyond its limit.
LEAST_CLASS, TAIL = 20, 1000
#: Repeated keys up to which they are broadcast, checked by a count.
BROADCAST_ROWS = 1_000_000
RIDGE = 0.01
UND = "und"
_GAPS = re.compile(r"[\W\d_]+")
_MIX = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)]


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def presence(text: str) -> np.ndarray:
    """The n-grams of a whole text as a boolean vector of ``WIDTH`` places."""
    out = np.zeros(WIDTH, dtype=bool)
    for at in range(0, len(text), PIECE):
        piece = text[max(0, at - ORDERS + 1): at + PIECE]           # n-grams across the border too
        chars = np.frombuffer(f" {_GAPS.sub(' ', piece.lower()).strip()} ".encode("utf-32-le", "replace"), dtype=np.uint32)
        code = np.zeros(len(chars), dtype=np.uint32)
        for n in range(1, ORDERS + 1):
            if len(chars) < n:
                break
            code = (code[: len(chars) - n + 1] + chars[n - 1:]) * _MIX[n - 1]
            out[(code ^ (code >> np.uint32(15))) & np.uint32(WIDTH - 1)] = True
    return out


def has_letter(text) -> bool:
    return text is not None and any(map(str.isalpha, text))


class Model:
    """languages, and the folded (WIDTH x languages) matrix with its intercepts."""

    def __init__(self, languages: list[str], weights: np.ndarray, intercept: np.ndarray):
        self.languages, self.weights, self.intercept = languages, weights, intercept

    def decide(self, batch: np.ndarray) -> np.ndarray:
        """Regression values of a (texts x WIDTH) presence matrix."""
        norm = np.sqrt(np.maximum(batch.sum(1, dtype=np.float32), 1))
        return (batch.astype(np.float32) @ self.weights) / norm[:, None] + self.intercept

    def fits(self, texts) -> list[tuple[str, int, float]]:
        """(language, class of its distinct n-grams, the winner's regression value) of texts with a letter."""
        out = []
        for a in range(0, len(texts), TEXTS):
            batch = np.stack([presence(t) for t in texts[a: a + TEXTS]])
            size = np.log2(np.maximum(batch.sum(1), 1)).astype(int)
            out += [(self.languages[int(row.argmax())], int(k), float(row.max())) for row, k in zip(self.decide(batch), size)]
        return out

    def predict(self, texts) -> tuple[list[str], np.ndarray]:
        """Language and score (the winner's regression value from -1..1 moved to 0..1)."""
        names, scores = [UND] * len(texts), np.zeros(len(texts))
        known = [i for i, t in enumerate(texts) if self.languages and has_letter(t)]
        for a in range(0, len(known), TEXTS):
            part = known[a: a + TEXTS]
            f = self.decide(np.stack([presence(texts[i]) for i in part]))
            for i, row in zip(part, f):
                names[i] = self.languages[int(row.argmax())]
                scores[i] = min(1.0, max(0.0, (float(row.max()) + 1) / 2))
        return names, scores


def _bits(packed: np.ndarray) -> np.ndarray:
    return np.unpackbits(packed, axis=1).view(bool)


class Basis:
    """Landmarks (packed presence bits) of the Nystroem features."""

    def __init__(self, languages: list[str], marks: np.ndarray):
        self.languages, self.marks = languages, marks
        self.norm = np.sqrt(np.maximum(np.bitwise_count(marks).sum(1, dtype=np.float64), 1))

    def kernel(self, batch: np.ndarray) -> np.ndarray:
        """Kernel values of a (texts x WIDTH) presence matrix and the landmarks, which are unpacked a few columns at a time."""
        both = np.zeros((len(batch), len(self.marks)), np.float32)           # n-grams in common: whole numbers
        for a in range(0, WIDTH, 4096):
            both += batch[:, a: a + 4096].astype(np.float32) @ _bits(self.marks[:, a // 8: (a + 4096) // 8]).astype(np.float32).T
        return both / (np.sqrt(np.maximum(batch.sum(1, dtype=np.float64), 1))[:, None] * self.norm)

    def moments(self, batch: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """(languages + landmarks) x landmarks: weighted sums of the rows' kernel values by
        language, and of the products of their kernel values. ``weight`` is by language."""
        k = self.kernel(batch)
        return np.concatenate([y[:, None] == np.arange(len(self.languages)), k], axis=1).T @ (k * weight[y][:, None])

    def solve(self, sums: np.ndarray, rows: int, ridge: float = RIDGE) -> Model:
        """The ridge regression of +1 (own language) and -1 on the Nystroem features of
        ``rows`` rows with these moments."""
        n = len(self.languages)
        values, vectors = np.linalg.eigh(self.kernel(_bits(self.marks)))
        keep = values > 1e-6 * values.max()
        white = vectors[:, keep] / np.sqrt(values[keep])                # K_mm^(-1/2)
        own, total = sums[:n], sums[:n].sum(0)
        centre, middle = total @ white / rows, np.full(n, 2 / n - 1)    # languages count alike
        gram = white.T @ sums[n:] @ white - rows * np.outer(centre, centre)
        beta = np.linalg.solve(gram + ridge * rows * np.eye(len(gram)), white.T @ (2 * own - total).T - rows * np.outer(centre, middle))
        fold = white @ beta / self.norm[:, None]
        weights = np.concatenate([_bits(self.marks[:, a // 8: (a + 4096) // 8]).T.astype(np.float64) @ fold for a in range(0, WIDTH, 4096)])
        return Model(self.languages, weights.astype(np.float32), (middle - centre @ beta).astype(np.float32))


def balance(sizes: np.ndarray) -> np.ndarray:
    """Weight of a row by language: languages count alike, weights add up to the rows."""
    return sizes.sum() / (len(sizes) * sizes)


def train(packed: np.ndarray, labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Fit on packed presence bits (rows x WIDTH / 8) held here; landmarks are the first
    rows of each language."""
    languages = sorted(set(labels))
    if not languages:
        return Model([], np.zeros((WIDTH, 0), np.float32), np.zeros(0, np.float32))
    y = np.array([languages.index(x) for x in labels])
    basis, weight = Basis(languages, packed[np.concatenate([np.flatnonzero(y == k)[:landmarks] for k in range(len(languages))])]), balance(np.bincount(y))
    return basis.solve(sum(basis.moments(_bits(packed[a: a + BLOCK]), y[a: a + BLOCK], weight) for a in range(0, len(y), BLOCK)), len(y), ridge)


def labelled(docs: DataFrame, pick: Column) -> DataFrame:
    """doc_id, lang and text of the rows with a label, a doc_id and a letter."""
    return (docs.where(pick & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").rlike(r"\p{L}"))
            .select(F.col("doc_id").cast("string").alias("doc_id"), "lang", "text"))


def landmarks(rows: DataFrame, n_languages: int) -> tuple[np.ndarray, list[str]]:
    """Packed presence bits and labels of the first texts of each language in hash order."""
    each = max(1, min(LANDMARKS, BASIS // n_languages))
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    picked = (rows.select("doc_id", "lang").distinct().withColumn("rank", F.row_number().over(first))
              .where(F.col("rank") <= each).limit(BASIS))                # at most BASIS rows
    found = (presences(rows.join(F.broadcast(picked), ["doc_id", "lang"])).groupBy("lang", "doc_id").agg(F.min("bits").alias("bits"))
             .join(F.broadcast(picked), ["doc_id", "lang"]).orderBy("lang", "rank").collect())
    return np.frombuffer(b"".join(bytes(r["bits"]) for r in found), np.uint8).reshape(len(found), WIDTH // 8), [r["lang"] for r in found]


def presences(rows: DataFrame) -> DataFrame:
    """lang, doc_id and packed presence bits of ``labelled`` rows."""
    def run(batches):
        import pyarrow as pa

        for b in batches:
            bits = [np.packbits(presence(t)).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("doc_id"), pa.array(bits, pa.binary())], names=["lang", "doc_id", "bits"])

    return rows.select("lang", "doc_id", "text").mapInArrow(run, "lang string, doc_id string, bits binary")


def summed(rows: DataFrame, basis: Basis, weight: np.ndarray) -> np.ndarray:
    """``Basis.moments`` of all ``rows`` (lang, and text or bits), added up by landmark."""
    shared = rows.sparkSession.sparkContext.broadcast((basis.languages, basis.marks, weight))
    schema = "part int, sums binary"

    def run(batches):
        import pyarrow as pa

        languages, marks, weight = shared.value
        own, total = Basis(languages, marks), 0
        place = {name: i for i, name in enumerate(languages)}
        for b in batches:
            texts = "text" in b.schema.names
            for a in range(0, b.num_rows, BLOCK):
                part = b.slice(a, BLOCK)
                got = part.column("text" if texts else "bits").to_pylist()
                batch = np.stack([presence(t) for t in got]) if texts else _bits(np.stack([np.frombuffer(x, np.uint8) for x in got]))
                total = total + own.moments(batch, np.array([place[x] for x in part.column("lang").to_pylist()]), weight)
        if isinstance(total, np.ndarray):
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array([x.tobytes() for x in total], pa.binary())], names=["part", "sums"])

    def add(batches):
        import pyarrow as pa

        total = {}
        for b in batches:
            for k, x in zip(b.column("part").to_pylist(), b.column("sums")):
                total[k] = total.get(k, 0) + np.frombuffer(x.as_buffer())
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["part", "sums"])

    out = np.zeros((len(basis.languages) + len(basis.marks), len(basis.marks)))
    for r in rows.mapInArrow(run, schema).repartition(8, "part").mapInArrow(add, schema).collect():      # one row per landmark
        out[r["part"]] += np.frombuffer(r["sums"])
    return out


def fit(docs: DataFrame, learn: Column) -> Model:
    """Fit on all labelled rows of ``learn``; rows that share doc_id and label count once, by their least bits."""
    small_batches(docs.sparkSession)
    rows = labelled(docs, learn)
    keys = rows.groupBy("doc_id", "lang").agg(F.count(F.lit(1)).alias("n"))
    found = {r["lang"]: r for r in keys.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("n") > 1).alias("again")).collect()}
    if not found:
        return train(np.zeros((0, WIDTH // 8), np.uint8), [])
    marks, names = landmarks(rows, len(found))
    languages = sorted(set(names))
    sizes, again = np.array([found[x]["n"] for x in languages]), sum(r["again"] for r in found.values())
    basis, weight = Basis(languages, marks), balance(sizes)
    if len(languages) < len(found):                                      # more languages than BASIS
        rows = rows.where(F.col("lang").isin(languages))
    if not again:
        return basis.solve(summed(rows.select("lang", "text"), basis, weight), int(sizes.sum()))
    repeated = stored(keys.where(F.col("n") > 1).select("doc_id", "lang"), "repeated-keys")
    repeated = F.broadcast(repeated) if again <= BROADCAST_ROWS else repeated
    alone = rows.join(repeated, ["doc_id", "lang"], "left_anti").select("lang", "text")
    merged = presences(rows.join(repeated, ["doc_id", "lang"], "left_semi")).groupBy("lang", "doc_id").agg(F.min("bits").alias("bits")).select("lang", "bits")
    return basis.solve(summed(alone, basis, weight) + summed(merged, basis, weight), int(sizes.sum()))


def identify(docs: DataFrame, model: Model, names: tuple[str, str] = ("lang_pred", "lang_score")) -> DataFrame:
    """``docs`` with the predicted language and its score; all rows and other columns stay."""
    spark = docs.sparkSession
    docs = docs.drop(*names)
    small_batches(spark)
    shared = spark.sparkContext.broadcast((model.languages, model.weights, model.intercept))   # WIDTH x languages floats
    schema = StructType([*docs.schema.fields, StructField(names[0], StringType()), StructField(names[1], DoubleType())])

    def score(batches):
        import pyarrow as pa

        own = Model(*shared.value)
        for b in batches:
            found, scores = own.predict(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.string()), pa.array(scores, pa.float64())], names=[*b.schema.names, *names])

    return docs.mapInArrow(score, schema)


def shuffled(text: str) -> str:
    """Letter noise of a text: its characters in a fixed random order."""
    chars = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)
    return np.random.Generator(np.random.PCG64(len(text))).permutation(chars).tobytes().decode("utf-32-le")


def class_limits(clean: dict[int, tuple[int, float]], noise: dict[int, tuple[int, float]]) -> list[float]:
    """Regression value of each size class that a text must exceed; given are the
    number of clean texts and the least value that counts, and the same of noise with the largest."""
    out, last, least = [], -np.inf, -np.inf
    for k in range(WIDTH.bit_length()):
        n, low = clean.get(k, (0, np.inf))
        least = low if n >= LEAST_CLASS else min(least, low)
        n, high = noise.get(k, (0, np.inf))
        if n >= LEAST_CLASS and high < least:
            last = high
        out.append(last)
    return out


def limits(docs: DataFrame, model: Model, held: Column) -> list[float]:
    """``class_limits`` measured on all labelled rows of ``held``."""
    if not model.languages:
        return class_limits({}, {})
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.weights, model.intercept))

    def values(batches):
        import pyarrow as pa

        own = Model(*shared.value)
        schema = pa.schema([("noise", pa.bool_()), ("size", pa.int32()), ("value", pa.float64())])
        for b in batches:
            for a in range(0, b.num_rows, TEXTS):
                langs, texts = (b.column(c).slice(a, TEXTS).to_pylist() for c in ("lang", "text"))
                rows = [(False, k, v) for lang, (name, k, v) in zip(langs, own.fits(texts)) if name == lang]
                rows += [(True, k, v) for _, k, v in own.fits(list(map(shuffled, texts)))]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), schema.types)], schema=schema)

    rows = stored(labelled(docs, held).mapInArrow(values, "noise boolean, size int, value double"), "fits")
    found = rows.groupBy("noise", "size").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high")).collect()
    ends = {(r["noise"], r["size"]): (r["n"], r["high"] if r["noise"] else r["low"]) for r in found}
    large = [key for key, (n, _) in ends.items() if n >= TAIL]
    wanted = [(F.when((F.col("noise") == noise) & (F.col("size") == size), F.col("value")), [_tail(ends[noise, size][0], noise)]) for noise, size in large]
    for key, (value,) in zip(large, exact_quantiles(rows, wanted) if large else []):
        ends[key] = (ends[key][0], value)
    return class_limits(*({k: end for (own, k), end in ends.items() if own == noise} for noise in (False, True)))


def _tail(n: int, noise: bool) -> float:
    """The probability whose quantile passes over one in ``TAIL`` of ``n`` rows, from above for noise."""
    share = (n // TAIL) / (n - 1)
    return 1 - share if noise else share


def drop_unidentified(docs: DataFrame) -> DataFrame:
    """``docs`` without the texts that the model, fitted on their own labels, finds in no
    language: null, without a letter, or below the limit of their size class (see the
    head of this module). Without a labelled row left for the fit (lang null
    everywhere, or all labelled rows held out) the model knows no language and rejects
    nothing: every text with a letter stays."""
    spark = docs.sparkSession
    held = held_out(F.col("doc_id"))
    model = fit(docs, ~held)
    least = limits(docs, model, held)
    shared = spark.sparkContext.broadcast((model.languages, model.weights, model.intercept))

    def keep(batches):
        import pyarrow as pa

        own = Model(*shared.value)
        for b in batches:
            texts = b.column("text").to_pylist()
            known = [i for i, t in enumerate(texts) if has_letter(t)]
            if own.languages:
                fits = own.fits([texts[i] for i in known])
                known = [i for i, (_, k, v) in zip(known, fits) if v > least[k]]
            yield b.take(pa.array(known, pa.int64()))

    small_batches(spark)
    return docs.mapInArrow(keep, docs.schema)


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = fit(docs, ~held_out(F.col("doc_id")))
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


QUERIES = {"op10_langid": op10_langid}
ORACLE: dict[str, str] = {}
