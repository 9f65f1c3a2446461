"""Benchmark decontamination with a positional inverted index.

``build_index`` stores the corpus postings (term, row, position) of a given
vocabulary in the shared folder, each file sorted by term so that a term's
postings lie together. ``phrase_matches`` ranks the terms of every phrase by
their corpus frequency, reads the postings of the rarest one, intersects them
with the offset-adjusted postings of the next, and checks the remaining terms
only where these two agree. ``proximity_matches`` finds rows that hold all
terms of a query within a span of positions.

The corpus is tokenised once and its texts never cross the network.

Edge cases: null and empty texts have no words; rows that repeat a doc_id are
separate rows; an item without words has no window, an item of fewer than
``WINDOW`` words is one window; a null item_id counts for the hits but is not
listed; empty tables give no hits. Extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, read_table, scratch, stored

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
#: Rows up to which a side is broadcast, checked by a count; beyond it Spark shuffles both sides.
BROADCAST_ROWS = 1_000_000
MARKER = -1
#: Tasks that share a split's rows when postings are made: bounds what one of them sorts.
SLICES = 4


def words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORDS), F.lit(0))


def _checked(df: DataFrame) -> DataFrame:
    """A stored table as the broadcast side of a join if its size allows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def vocabulary(phrases: DataFrame) -> DataFrame:
    """Distinct terms of ``phrases.words`` with a term_id."""
    terms = phrases.select(F.explode("words").alias("term")).distinct()
    return stored(terms.select("term", F.monotonically_increasing_id().alias("term_id")), "terms")


def build_index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Postings (term_id, key, pos) of ``terms`` in all rows of ``docs``, positions
    from 1. Every row has one marker posting too (term_id ``MARKER``) that carries
    doc_id, the number of words and the MD5 of the text (``row``, null in all others).
    Each task sorts its postings by term; it takes one in ``SLICES`` rows of its split, all
    tasks together every row."""
    spark = docs.sparkSession
    known = terms.select("term", "term_id").unionByName(spark.range(1).select(F.lit("").alias("term"), F.lit(MARKER).cast("long").alias("term_id")))
    known = F.broadcast(known) if terms.count() < BROADCAST_ROWS else known

    def part(k: int) -> DataFrame:
        # slices by content, so that a row is in one of them even where the order of rows isn't fixed
        rows = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(SLICES)) == k).select(
            (F.monotonically_increasing_id() * SLICES + k).alias("key"), "doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"),
            words(F.col("text")).alias("words"))
        # what a row has once is made before its words are rows: after that it would be made again for every word
        rows = rows.select("key", "doc_id", F.size("words").cast("long").alias("n"), "text_md5", "words")
        # a word is never empty, so the empty term can stand for the marker
        found = rows.select("key", "doc_id", "n", "text_md5", F.posexplode(F.concat(F.array(F.lit("")), F.col("words"))).alias("pos", "term"))
        found = found.select("key", "pos", "term", F.when(F.col("pos") == 0, F.struct("doc_id", "n", "text_md5")).alias("row"))
        return found.join(known, "term").select("term_id", "key", "pos", "row")

    # the slices meet only after the join, so that words outside the vocabulary are never copied
    index = reduce(DataFrame.unionAll, [part(k) for k in range(SLICES)])
    return stored(index.sortWithinPartitions("term_id"), "postings")


def postings(index: DataFrame) -> DataFrame:
    return index.where(F.col("term_id") >= 0).select("term_id", "key", "pos")


def index_rows(index: DataFrame) -> DataFrame:
    """key, doc_id, n (words) and text_md5 of every indexed row."""
    return index.where(F.col("term_id") == MARKER).select("key", "row.doc_id", "row.n", "row.text_md5")


def _ranked_terms(index: DataFrame, phrases: DataFrame, terms: DataFrame) -> DataFrame:
    """(phrase_id, length, term_id, off, rank): rank 1 is the term with the fewest
    postings. Phrases with a term that the corpus lacks are left out."""
    frequency = postings(index).groupBy("term_id").agg(F.count(F.lit(1)).alias("df"))
    flat = phrases.select("phrase_id", F.size("words").alias("length"), F.posexplode("words").alias("off", "term"))
    flat = flat.join(terms, "term").join(frequency, "term_id")
    w = Window.partitionBy("phrase_id")
    ranked = (flat.withColumn("present", F.count(F.lit(1)).over(w)).where(F.col("present") == F.col("length"))
              .withColumn("rank", F.row_number().over(w.orderBy("df", "off"))))
    return stored(ranked.select("phrase_id", "length", "term_id", "off", "rank"), "ranked-terms")


def phrase_matches(index: DataFrame, phrases: DataFrame, terms: DataFrame) -> DataFrame:
    """Exact occurrences (phrase_id, length, key, start) of ``phrases`` (phrase_id, words)."""
    ranked = _ranked_terms(index, phrases, terms)
    lists = postings(index)
    place = ["phrase_id", "key", "start"]

    def occurrences(rank: int) -> DataFrame:
        side = _checked(ranked.where(F.col("rank") == rank))
        return lists.join(side, "term_id").select("phrase_id", "length", "key", (F.col("pos") - F.col("off")).alias("start")).where(F.col("start") >= 1)

    rarest = occurrences(1)
    both = rarest.where(F.col("length") > 1).join(occurrences(2).drop("length"), place)
    found = stored(rarest.where(F.col("length") == 1).select(*place, "length").unionByName(both.select(*place, "length")), "candidates")
    done, open_ = found.where(F.col("length") <= 2), found.where(F.col("length") > 2)
    rest = ranked.where(F.col("rank") > 2).drop("length")
    asked = open_.join(_checked(rest), "phrase_id").select(*place, "length", "term_id", (F.col("start") + F.col("off")).alias("pos"))
    keys = stored(open_.select("key").distinct(), "candidate-keys")
    near = lists.join(_checked(keys), "key", "left_semi")
    full = (asked.join(near, ["key", "pos", "term_id"]).groupBy(*place, "length").agg(F.count(F.lit(1)).alias("m"))
            .where(F.col("m") == F.col("length") - 2).drop("m"))
    return done.select(*place, "length").unionByName(full.select(*place, "length"))


def proximity_matches(index: DataFrame, phrases: DataFrame, terms: DataFrame, slop: int) -> DataFrame:
    """(phrase_id, key, pos): postings of a phrase's rarest term around which every
    other term of the phrase occurs at most ``slop`` positions away, in any order."""
    ranked = _ranked_terms(index, phrases.select("phrase_id", F.array_distinct("words").alias("words")), terms)
    lists = postings(index)
    base = lists.join(_checked(ranked.where(F.col("rank") == 1)), "term_id").select("phrase_id", "length", "key", "pos")
    other = lists.join(_checked(ranked.where(F.col("rank") > 1)), "term_id").select(
        "phrase_id", "key", F.col("term_id").alias("other"), F.col("pos").alias("at"))
    cell = lambda c: F.floor(F.col(c) / (slop + 1))
    probe = base.withColumn("cell", F.explode(F.array(*[cell("pos") + d for d in (-1, 0, 1)])))
    met = (probe.join(other.withColumn("cell", cell("at")), ["phrase_id", "key", "cell"])
           .where(F.abs(F.col("at") - F.col("pos")) <= slop)
           .groupBy("phrase_id", "key", "pos", "length").agg(F.count_distinct("other").alias("m")))
    alone = base.where(F.col("length") == 1).select("phrase_id", "key", "pos")
    return met.where(F.col("m") == F.col("length") - 1).select("phrase_id", "key", "pos").unionByName(alone)


def windows(benchmark: DataFrame, width: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(phrases, items): distinct windows (phrase_id, words), and which items have them."""
    item = benchmark.select("item_id", words(F.col("text")).alias("all")).where(F.size("all") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("all") - (width - 1), F.lit(1)))
    cut = item.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("all", i, width))).alias("words"))
    phrases = stored(cut.select("words").distinct().select("words", F.monotonically_increasing_id().alias("phrase_id")), "windows")
    items = stored(cut.distinct().join(phrases, "words").select("phrase_id", "item_id"), "window-items")
    return phrases, items


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, text_md5, n_words, n_hit (words inside an
    occurrence of a window), items (sorted), contaminated."""
    phrases, items = windows(benchmark, width)
    terms = vocabulary(phrases)
    index = build_index(docs, terms)
    matches = stored(phrase_matches(index, phrases, terms), "matches")
    covered = (matches.select("key", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1)).alias("pos"))
               .distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n_hit")))
    named = (matches.select("key", "phrase_id").distinct().join(items, "phrase_id")
             .select("key", F.col("item_id").cast("string").alias("item")).distinct()
             .groupBy("key").agg(F.sort_array(F.collect_list("item")).alias("items")))
    none = F.array().cast("array<string>")
    return (index_rows(index).join(covered, "key", "left").join(named, "key", "left")
            .select("doc_id", "text_md5", F.col("n").alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                    F.coalesce("items", none).alias("items"), F.col("n_hit").isNotNull().alias("contaminated")))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that hold a window of a benchmark item."""
    bad = contamination(docs, benchmark).where("contaminated").select(F.col("text_md5").alias("__index_md5")).distinct()
    return docs.join(bad, F.md5(docs["text"].cast("binary")) == F.col("__index_md5"), "left_anti")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


QUERIES = {"op4_decontaminate": op4_decontaminate}
_SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = {"op4_decontaminate": f"""
WITH item AS (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark),
win AS (SELECT item_id, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS ws, least(len(w), {WINDOW}) AS l
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) AS i FROM item WHERE len(w) > 0)),
doc AS MATERIALIZED (SELECT row_number() OVER () AS k, doc_id, {_SQL_WORDS} AS w FROM documents),
cut AS (SELECT k, i, l, array_to_string(w[i:i + l - 1], ' ') AS ws
  FROM (SELECT k, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM doc, (SELECT DISTINCT l FROM win))),
met AS MATERIALIZED (SELECT DISTINCT k, i, l, ws FROM cut SEMI JOIN win USING (ws, l)),
hit AS (SELECT k, count(*) AS n_hit FROM (SELECT DISTINCT k, unnest(range(i, i + l)) AS p FROM met) GROUP BY k),
named AS (SELECT k, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT k, item_id::VARCHAR AS item FROM met JOIN win USING (ws, l) WHERE item_id IS NOT NULL) GROUP BY k)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM doc LEFT JOIN hit USING (k) LEFT JOIN named USING (k)"""}
