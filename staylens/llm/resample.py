"""Importance resampling towards a target distribution.

A document's features are its runs of 1 to ``WIDTH`` consecutive words, hashed
into ``BUCKETS`` buckets. Each bucket gains
``floor(1000 * ln((t + 1) * (S + B) / ((s + 1) * (T + B))))`` from its counts in
the source (s of S) and the target (t of T); the gains of all buckets are one
array, and a document's weight is the floored mean of the gains at its features'
places in it. A Gumbel draw seeded by doc_id is added, so taking the highest
scores samples without replacement in proportion to the weights.

The cutoff isn't found by sorting all scores. Tasks merge a quantile sketch of
the scores, which gives a bracket around the wanted rank; exact counts of the rows
above and inside the bracket show whether it holds that rank, or widen it
(``bracket``); only the rows inside are sorted (``cutoff``). The drawn rows alone
are then put in order for their ranks.

What moves: one count per task and bucket, the sketches, the rows of the bracket
and the drawn rows (numbers only). Texts are read twice and never shuffled. The
driver holds ``BUCKETS`` counts.

Edge cases: null, empty and wordless texts have no features, weight 0 and are
never drawn as long as ``least_words`` is above 0; whole texts are read, however
long; repeated rows count and are drawn each for itself; equal scores go to the
smaller doc_id, null doc_ids last, rows that repeat a doc_id by their text's MD5; a
null doc_id draws with the seed and an empty name; empty tables give empty results, an empty
target counts nothing (T = 0); extra columns are ignored by ``scored`` and
``draw`` and kept by ``resample``.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from staylens.operators.ranking import global_position

from .common import batches, read_table, stored

BUCKETS, WIDTH, SEED = 10_000, 2, 7
LEAST_WORDS, PERCENT = 20, 25
#: Of the sketch: a rank is off by at most rows / ACCURACY.
ACCURACY = 10_000
#: Texts in an Arrow batch.
BATCH_ROWS = 500
_LOWER_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def features(text: bytes | None, width: int = WIDTH, buckets: int = BUCKETS) -> tuple[int, np.ndarray]:
    """(number of words, bucket of every feature)."""
    words = (text or b"").translate(_LOWER_WORDS).split()
    runs = list(map(zlib.crc32, words))
    found = [np.fromiter(runs, np.uint32, len(runs))]
    for k in range(1, min(width, len(words))):
        # a CRC goes on from that of the run before it
        runs = list(map(zlib.crc32, words[k:], map(zlib.crc32, repeat(b" "), runs)))
        found.append(np.fromiter(runs, np.uint32, len(runs)))
    return len(words), np.concatenate(found) % np.uint32(buckets)


def bucket_counts(texts: DataFrame, width: int = WIDTH, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all rows of ``texts`` (one column) per bucket; tasks send one
    row per bucket, ``buckets`` rows come to the driver."""
    def run(parts):
        import pyarrow as pa

        held = np.zeros(buckets, np.int64)
        for b in parts:
            for text in b.column(0).to_pylist():
                held += np.bincount(features(text, width, buckets)[1], minlength=buckets)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(held[at], pa.int64())], names=["bucket", "n"])

    held = texts.select(F.col(texts.columns[0]).cast("binary")).mapInArrow(run, "bucket int, n long")
    out = np.zeros(buckets, np.int64)
    with batches(texts.sparkSession, BATCH_ROWS):
        for r in held.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
            out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Gain of every bucket, in thousandths of a nat."""
    b, s_all, t_all = float(len(source)), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + b) / ((s + 1.0) * (t_all + b))))
                     for s, t in zip(source.tolist(), target.tolist())], np.int64)


def scored(docs: DataFrame, gain: np.ndarray, width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """doc_id, text_md5, n_words, n_features, weight and score of every row; stored."""
    buckets = len(gain)
    text = F.col("text").cast("binary")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(text).alias("text_md5"), text.alias("text"))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            out = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                n, at = features(text, width, buckets)
                weight = int(gain[at].sum()) // len(at) if len(at) else 0
                h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
                out.append((n, len(at), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
            columns = zip(*out) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, pa.int64()) for c in columns)],
                                             names=["doc_id", "text_md5", "n_words", "n_features", "weight", "score"])

    return stored(rows.mapInArrow(run, "doc_id long, text_md5 string, n_words long, n_features long, weight long, score long"), "resample-scored", BATCH_ROWS)


def bracket(scores: DataFrame, k: int, n: int, accuracy: int = ACCURACY) -> tuple[int, int, int]:
    """(lo, hi, rows above hi) of ``scores`` such that the ``k``-th highest of its ``n``
    scores lies in [lo, hi]: guessed from a sketch, proved or widened by counts."""
    margin = 2.0 / accuracy
    while True:
        p = 1 - k / n
        if margin < 1:
            lo, hi = scores.agg(F.percentile_approx("score", [max(0.0, p - margin), min(1.0, p + margin)], accuracy).alias("q")).first()["q"]
        else:                                                           # all rows
            lo, hi = scores.agg(F.min("score"), F.max("score")).first()
        above, inside = scores.agg(F.count_if(F.col("score") > hi), F.count_if(F.col("score").between(lo, hi))).first()
        if above < k <= above + inside:
            return lo, hi, above
        margin *= 8


#: Highest score first, ties by doc_id (null last), rows that repeat a doc_id by their text's digest (null last).
_ORDER = ["_high", "_none", "_id", "_void", "_md5"]


def _ordered(df: DataFrame) -> DataFrame:
    return df.withColumns({"_high": -F.col("score"), "_none": F.col("doc_id").isNull(), "_id": F.coalesce("doc_id", F.lit(0)),
                           "_void": F.col("text_md5").isNull(), "_md5": F.coalesce("text_md5", F.lit(""))})


def cutoff(scores: DataFrame, k: int, n: int) -> tuple:
    """The values of ``_ORDER`` of the last of the ``k`` highest rows, sorting nothing but the bracket."""
    lo, hi, above = bracket(scores, k, n)
    inside = _ordered(scores.where(F.col("score").between(lo, hi)))
    return tuple(global_position(inside, _ORDER, "at").where(F.col("at") == k - above - 1).select(*_ORDER).first())


def draw(scores: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """``scores`` with rank: 1 for the highest score and so on for ``percent`` of
    the rows with at least ``least_words`` words, null for the others."""
    able = scores.where(F.col("n_words") >= least_words)
    n = able.count()
    k = percent * n // 100
    undrawn = F.lit(None).cast("long").alias("rank")
    if not k:
        return scores.select("*", undrawn)
    last = F.struct(*[F.lit(x).alias(c) for c, x in zip(_ORDER, cutoff(able, k, n))])
    marked = _ordered(scores).withColumn("_in", (F.col("n_words") >= least_words) & (F.struct(*_ORDER) <= last))
    # of rows equal to the last one in every respect, as many as there is room for
    drawn = global_position(marked.where("_in"), _ORDER, "_at").withColumn("rank", F.when(F.col("_at") < k, F.col("_at") + 1))
    return drawn.select(*scores.columns, "rank").unionByName(marked.where(~F.col("_in")).select(*scores.columns, undrawn))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS,
             width: int = WIDTH, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """The drawn rows of ``docs`` (all their columns), weighted towards the texts of
    ``target``; rows with the doc_id and text of a drawn one stay with it."""
    gain = gains(bucket_counts(docs.select("text"), width, buckets), bucket_counts(target.select("text"), width, buckets))
    kept = draw(scored(docs, gain, width, seed), percent, least_words).where("rank IS NOT NULL")
    kept = kept.select(F.col("doc_id").alias("__drawn_id"), F.col("text_md5").alias("__drawn_md5")).distinct()
    same = docs["doc_id"].cast("long").eqNullSafe(F.col("__drawn_id")) & F.md5(docs["text"].cast("binary")).eqNullSafe(F.col("__drawn_md5"))
    return docs.join(kept, same, "left_semi")


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")
    gain = gains(bucket_counts(docs.select("text")), bucket_counts(target.select("text")))
    return draw(scored(docs, gain)).select("doc_id", "n_features", "weight", "score", "rank")


QUERIES = {"op11_resample": op11_resample}
_SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_SQL_RUNS = "SELECT k, w, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM"
_SQL_CRC_TABLE = "(SELECT list(c ORDER BY b) FROM (SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM (SELECT unnest(range(256)) AS b)))"
ORACLE = {"op11_resample": f"""
WITH crc_table AS MATERIALIZED (SELECT {_SQL_CRC_TABLE} AS tab),
doc AS MATERIALIZED (SELECT row_number() OVER () AS k, doc_id, md5(text) AS m, {_SQL_WORDS} AS w FROM documents),
doc_runs AS MATERIALIZED (SELECT k, f, count(*) AS n FROM ({_SQL_RUNS} doc) GROUP BY k, f),
item_runs AS MATERIALIZED (SELECT f, count(*) AS n FROM ({_SQL_RUNS} (SELECT 0 AS k, {_SQL_WORDS} AS w FROM benchmark)) GROUP BY f),
coded AS MATERIALIZED (
  SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(f)), '..'), lambda h: ('0x' || h)::BIGINT)),
    lambda c, b: xor(c // 256, tab[(xor(c, b) & 255) + 1])), 4294967295) % {BUCKETS} AS b
  FROM (SELECT DISTINCT f FROM doc_runs UNION SELECT f FROM item_runs), crc_table),
s AS (SELECT b, sum(n) AS s FROM doc_runs JOIN coded USING (f) GROUP BY b),
t AS (SELECT b, sum(n) AS t FROM item_runs JOIN coded USING (f) GROUP BY b),
totals AS MATERIALIZED (SELECT coalesce((SELECT sum(n) FROM doc_runs), 0)::DOUBLE AS s_all, coalesce((SELECT sum(n) FROM item_runs), 0)::DOUBLE AS t_all),
gain AS MATERIALIZED (
  SELECT b, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (s_all + {BUCKETS}) / ((coalesce(s, 0) + 1)::DOUBLE * (t_all + {BUCKETS}))))::BIGINT AS g
  FROM s FULL JOIN t USING (b), totals),
weighed AS (SELECT k, sum(n)::BIGINT AS n_features, floor(sum(n * g) / sum(n))::BIGINT AS weight FROM doc_runs JOIN coded USING (f) JOIN gain USING (b) GROUP BY k),
scored AS MATERIALIZED (
  SELECT doc_id, m, len(w) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score
  FROM doc LEFT JOIN weighed USING (k)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_words >= {LEAST_WORDS} ORDER BY score DESC, doc_id NULLS LAST, m NULLS LAST) AS r FROM scored)
SELECT doc_id, n_features, weight, score,
  CASE WHEN n_words >= {LEAST_WORDS} AND r <= {PERCENT} * (SELECT count(*) FROM scored WHERE n_words >= {LEAST_WORDS}) // 100 THEN r END::BIGINT AS rank
FROM ranked"""}
