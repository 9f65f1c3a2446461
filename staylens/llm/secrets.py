"""Secret scan: fixed patterns plus a battery of randomness tests.

Patterns (``PATTERNS``) give the spans of three kinds. Beside them every run of
``CANDIDATE`` characters is tested for randomness: its encoding is inferred
from its characters, and three tests ask whether its symbols look drawn evenly
and independently from that alphabet: chi-squared uniformity, number of runs
above and below the alphabet's middle, serial correlation of neighbours
(Fisher's method joins the p-values).

All candidates of the corpus form the family of a Benjamini-Hochberg
procedure, one per class of lengths, at rate ``FDR``: a rejected candidate is
structured text, so at most that share of the dismissed ones is truly random.
A candidate that is not rejected is a span of kind ``random`` if it is long
enough for its alphabet that ordinary text would have been rejected
(``least_length``). A shorter run that mixes letters of one case with digits is
one too if its digits are spread as in random draws rather than as in words
joined with numbers (``spread``): plain words never have digits, so the
collisions of letters in text are no measure for such runs. P-values are counted in bins and rounded up to the bin's
edge, so the procedure needs one small aggregate and no global sort.

Everything is built-in column functions; spans are kept by the MD5 of the text,
so copies share them and no text is shuffled by the scan. Edge cases: null and
empty texts have no spans, positions count code points with an exclusive end,
repeated rows are scanned alike, an empty table gives an empty result. Extra
columns stay untouched.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table, stored

KINDS = ("assign", "access", "hex", "random")
#: kind: (pattern, group that is measured, least length of that group)
PATTERNS = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
}
#: What a text must match to be searched for a kind (a cheaper pattern where there is one).
GUARD = PATTERNS["assign"][0], r"AKIA[A-Z0-9]{16}", r"[0-9a-f]{24}"
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
CANDIDATE_GUARD = r"[A-Za-z0-9+/_-]{20}"
FDR = 0.05
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Encodings in the order of inference: name, alphabet in the order of its values.
ENCODINGS = [("decimal", DIGITS), ("hex", DIGITS + "abcdef"), ("HEX", DIGITS + "ABCDEF"), ("lower", LOWER), ("upper", UPPER),
             ("base32", UPPER + "234567"), ("base36", DIGITS + LOWER), ("BASE36", DIGITS + UPPER), ("letters", UPPER + LOWER),
             ("base62", UPPER + LOWER + DIGITS), ("base64", UPPER + LOWER + DIGITS + "+/"), ("base64url", UPPER + LOWER + DIGITS + "-_"),
             ("base64mixed", UPPER + LOWER + DIGITS + "+/-_")]
#: Probability that two letters of ordinary text are equal.
TEXT_COLLISION = 0.067
#: Runs of words and numbers change between letters and digits at one of ten places at
#: most; a mixed run must be this many times likelier as random draws than as such a run.
TEXT_CHANGES, MIX_ODDS = 0.1, 3.0
SPAN = "array<struct<start:bigint,end:bigint,kind:string,s:string>>"
_BINS, _PER_BIN = 160, 4
#: Texts and spans together (some 100 bytes each) up to which they are broadcast, checked by a sum; beyond it both sides are shuffled.
BROADCAST_SPANS = 300_000
#: Code points of a text that are cut out at once when spans are replaced.
CHUNK = 4096


def least_length(size: int) -> int:
    """Symbols of an alphabet from which the uniformity test (level 1 %) rejects
    ordinary text 19 times out of 20. Alphabets of 16 or fewer need 24 symbols,
    decimal numbers 40: their uneven use says nothing about text."""
    if size <= 16:
        return 40 if size == 10 else 24
    shift = 4 * math.sqrt(2 * (size - 1)) + 8
    return max(20, math.ceil(shift / (size * TEXT_COLLISION - 1)))


def digit_share(alphabet: str) -> float:
    """Share of digits in an alphabet of one-case letters and digits beyond the hexadecimal ones, else 0."""
    digits = sum(c in DIGITS for c in alphabet)
    one_case = alphabet.lower() == alphabet or alphabet.upper() == alphabet
    return digits / len(alphabet) if digits and len(alphabet) > 16 and one_case and alphabet.isalnum() else 0.0


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def matches(text: Column, pattern: str, group: int, least: int, kind: str) -> Column:
    """Leftmost non-overlapping matches of ``pattern`` as spans, without those whose
    group is shorter than ``least``; candidates (kind ``random``) carry their text.
    Each match is taken with the text before it, from the end of the last one on,
    so lengths add up to positions. They are added up in blocks of the square root
    of their number: an array that grows match by match is copied at every step."""
    whole = rf"\G([\s\S]*?)({pattern})"
    take = lambda i: F.regexp_extract_all(text, F.lit(whole), F.lit(i))
    size = lambda c: F.length(c).cast("long")
    zipped = F.arrays_zip(take(1).alias("pre"), take(2).alias("hit"), take(2 + group).alias("part"))
    s = (lambda x: x["hit"]) if kind == "random" else (lambda x: F.lit(None).cast("string"))
    sized = F.transform(zipped, lambda x: F.struct(size(x["pre"]).alias("pre"), size(x["hit"]).alias("hit"), (size(x["part"]) >= least).alias("ok"), s(x).alias("s")))
    found = "array<struct<start:bigint,end:bigint,kind:string,s:string,ok:boolean>>"

    def add(a: Column, x: Column) -> Column:
        start = a["at"] + x["pre"]
        end = start + x["hit"]
        span = F.struct(start.alias("start"), end.alias("end"), F.lit(kind).alias("kind"), x["s"].alias("s"), x["ok"].alias("ok"))
        return F.struct(end.alias("at"), F.concat(a["out"], F.array(span)).alias("out"))

    def in_blocks(z: Column) -> Column:
        step = F.greatest(F.ceil(F.sqrt(F.size(z))).cast("int"), F.lit(1))
        zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(found).alias("out"))
        blocks = F.transform(F.sequence(F.lit(1), F.greatest(F.size(z), F.lit(1)), step), lambda i: F.aggregate(F.slice(z, i, step), zero, add))
        return let(blocks, shifted)

    def shifted(blocks: Column) -> Column:
        # every block counts from its own start; the starts are the sums of the blocks before
        ends = F.aggregate(blocks, F.array(F.lit(0).cast("long")), lambda a, b: F.concat(a, F.array(F.element_at(a, -1) + b["at"])))
        move = lambda at, x: F.struct((at + x["start"]).alias("start"), (at + x["end"]).alias("end"), x["kind"].alias("kind"), x["s"].alias("s"), x["ok"].alias("ok"))
        return F.flatten(F.zip_with(blocks, F.slice(ends, F.lit(1), F.size(blocks)), lambda b, at: F.transform(b["out"], lambda x: move(at, x))))

    kept = F.filter(let(sized, in_blocks), lambda x: x["ok"])
    return F.transform(kept, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"), x["s"].alias("s")))


def found_spans(docs: DataFrame) -> DataFrame:
    """(text_md5, kind, start, end, s) of all pattern spans and candidates (kind
    ``random``, with their text s) of ``docs``, copies included; one pass over the
    texts, which aren't repeated for their spans. Stored."""
    text = F.col("text")
    held = docs.select(text).where(text.rlike("|".join([*GUARD, CANDIDATE_GUARD])))
    none = F.array().cast(SPAN)
    kinds = [(k, g, PATTERNS[k]) for k, g in zip(PATTERNS, GUARD, strict=True)] + [("random", CANDIDATE_GUARD, (CANDIDATE, 0, 0))]
    spans = [F.when(text.rlike(g), matches(text, *p, k)).otherwise(none) for k, g, p in kinds]
    one = held.select(F.md5(text.cast("binary")).alias("text_md5"), F.concat(*spans).alias("spans")).select("text_md5", F.explode("spans").alias("span"))
    return stored(one.select("text_md5", "span.kind", "span.start", "span.end", "span.s"), "secret-spans")


def _normal_tail(z: Column) -> Column:
    """P(Z > z), logistic approximation (error below 2e-4, monotone)."""
    return 1 / (1 + F.exp(F.lit(1.5976) * z + F.lit(0.07056) * z * z * z))


def _count(s: Column, part: str) -> Column:
    return (F.length(s) - F.length(F.replace(s, F.lit(part), F.lit("")))) / len(part)


def with_encoding(rows: DataFrame) -> DataFrame:
    """Adds v (s without padding), n, alphabet (of the first encoding that holds all of v), k, least and digits (share of a mixed alphabet)."""
    rows = rows.withColumn("v", F.regexp_replace("s", "=+$", ""))
    number = None
    for i, (_, alphabet) in enumerate(ENCODINGS):
        held = F.translate("v", alphabet, "") == ""
        number = F.when(held, i + 1) if number is None else number.when(held, i + 1)
    rows = rows.withColumn("encoding", number)
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("encoding"))
    alphabets = [x for _, x in ENCODINGS]
    return rows.withColumns({"n": F.length("v").cast("double"), "alphabet": pick(alphabets), "k": pick([float(len(x)) for x in alphabets]),
                             "least": pick([least_length(len(x)) for x in alphabets]), "digits": pick([digit_share(x) for x in alphabets]),
                             "halves": pick(["0" * (len(x) // 2) + "1" * (len(x) - len(x) // 2) for x in alphabets])})


def chi_squared_p() -> Column:
    """Upper tail of the uniformity statistic (Wilson-Hilferty)."""
    v, n, df = F.col("v"), F.col("n"), F.col("k") - 1
    square = lambda c: F.pow(n - F.length(F.replace(v, c, F.lit(""))), F.lit(2.0))
    squares = F.aggregate(F.filter(F.array_distinct(F.split(v, "")), lambda c: c != ""), F.lit(0.0), lambda a, c: a + square(c))
    x = squares * F.col("k") / n - n
    return _normal_tail((F.cbrt(x / df) - (1 - F.lit(2.0) / (9 * df))) / F.sqrt(F.lit(2.0) / (9 * df)))


def runs_p() -> Column:
    """Two-sided runs test on symbols of the lower and the upper half of the alphabet (column ``bits``)."""
    n, ones = F.col("n"), _count(F.col("bits"), "1")
    product = 2 * ones * (n - ones)
    mean = product / n + 1
    variance = product * (product - n) / (n * n * (n - 1))
    runs = 1 + _count(F.col("bits"), "01") + _count(F.col("bits"), "10")
    return F.least(2 * _normal_tail(F.abs(runs - mean) / F.sqrt(F.greatest(variance, F.lit(1e-9)))), F.lit(1.0))


def serial_p() -> Column:
    """Two-sided test of the correlation between neighbouring symbols' values (column ``values``)."""
    v, n = F.col("values"), F.col("n")
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    mean = total(v) / n
    squares = total(F.transform(v, lambda x: x * x)) - n * mean * mean
    size = F.size(v) - 1
    products = total(F.zip_with(F.slice(v, F.lit(1), size), F.slice(v, F.lit(2), size), lambda a, b: a * b))
    ends = F.element_at(v, 1) + F.element_at(v, -1)
    pairs = products - mean * (2 * total(v) - ends) + (n - 1) * mean * mean
    return F.least(2 * _normal_tail(F.abs(pairs / F.greatest(squares, F.lit(1e-9))) * F.sqrt(n)), F.lit(1.0))


def spread() -> Column:
    """Whether digits lie among the letters of a mixed run as in random draws: the ratio of
    likelihoods of its letter-digit pattern, independent draws from the alphabet
    against a chain that changes with ``TEXT_CHANGES``, is at least ``MIX_ODDS``."""
    marks = F.translate("v", DIGITS + LOWER + UPPER, "0" * 10 + "1" * 52)
    n, digits, changes = F.col("n"), _count(marks, "0"), _count(marks, "01") + _count(marks, "10")
    drawn = digits * F.log("digits") + (n - digits) * F.log(1 - F.col("digits"))
    joined = math.log(0.5) + changes * math.log(TEXT_CHANGES) + (n - 1 - changes) * math.log(1 - TEXT_CHANGES)
    return F.coalesce((F.col("digits") > 0) & (drawn - joined >= math.log(MIX_ODDS)), F.lit(False))


def tested(candidates: DataFrame) -> DataFrame:
    """Adds size (length class), bin (of the joint p-value) and able (long or mixed enough)
    to candidates with a column ``s``; stored."""
    rows = with_encoding(candidates)
    rows = rows.withColumns({"bits": F.call_function("translate", F.col("v"), F.col("alphabet"), F.col("halves")),
                             "values": F.transform(F.filter(F.split("v", ""), lambda c: c != ""), lambda c: F.call_function("instr", F.col("alphabet"), c).cast("double"))})
    logs = [F.log(F.greatest(p, F.lit(1e-15))) for p in (chi_squared_p(), runs_p(), serial_p())]
    rows = rows.withColumn("x", -(logs[0] + logs[1] + logs[2]))
    p = F.exp(-F.col("x")) * (1 + F.col("x") + F.col("x") * F.col("x") / 2)             # chi-squared tail of 2x at 6 degrees
    rows = rows.withColumn("bin", F.least(F.floor(-F.log(F.greatest(p, F.lit(1e-30))) * _PER_BIN), F.lit(_BINS)).cast("int"))
    return stored(rows.select(*candidates.columns, F.floor(F.log2("n")).cast("int").alias("size"), "bin", ((F.col("n") >= F.col("least")) | spread()).alias("able")), "secret-tests")


def rejections(tests: DataFrame, rate: float = FDR) -> DataFrame:
    """Benjamini-Hochberg over all candidates: the least rejected bin of each length
    class (size, from_bin); classes without a rejection are left out. The input of
    the windows is one row per class and bin, whatever the corpus."""
    counts = tests.groupBy("size", "bin").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("size")
    ranked = counts.withColumn("m", F.sum("n").over(w)).withColumn("rank", F.sum("n").over(w.orderBy(F.desc("bin"))))
    passed = ranked.where(F.exp(-F.col("bin") / _PER_BIN) <= rate * F.col("rank") / F.col("m"))
    return passed.groupBy("size").agg(F.min("bin").alias("from_bin"))


def text_spans(docs: DataFrame, rate: float = FDR) -> DataFrame:
    """(text_md5, spans) of every distinct text that has a span: an array of
    (start, rank of the kind, end, kind, done: where the spans before it end), sorted.
    Kinds may overlap, but a random span never lies within a span of another kind. Stored."""
    found = found_spans(docs)
    place = ["text_md5", "kind", "start", "end"]
    base = found.where(F.col("kind") != "random").select(*place).distinct()
    tests = tested(found.where(F.col("kind") == "random"))
    limits = F.broadcast(rejections(tests, rate))                                       # one row per class of lengths
    kept = tests.join(limits, "size", "left").where(F.col("able") & (F.col("from_bin").isNull() | (F.col("bin") < F.col("from_bin"))))
    both = base.unionByName(kept.select(*place).distinct())
    is_base = F.col("kind") != "random"
    before = Window.partitionBy("text_md5").orderBy("start").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    both = both.withColumn("covered", F.max(F.when(is_base, F.col("end"))).over(before))
    both = both.where(is_base | F.col("covered").isNull() | (F.col("covered") < F.col("end")))
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    earlier = Window.partitionBy("text_md5").orderBy("start", "rank", "end").rowsBetween(Window.unboundedPreceding, -1)
    both = both.withColumn("rank", rank).withColumn("done", F.coalesce(F.max("end").over(earlier), F.lit(0).cast("long")))
    one = F.struct("start", "rank", "end", "kind", "done")
    return stored(both.groupBy("text_md5").agg(F.sort_array(F.collect_list(one)).alias("spans")), "secrets")


def _checked(df: DataFrame, spans: str = "spans") -> DataFrame:
    total = df.agg(F.sum(F.size(spans).cast("long") + 1)).first()[0] or 0
    return F.broadcast(df) if total <= BROADCAST_SPANS else df


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, rate: float = FDR) -> DataFrame:
    """doc_id, text_md5 and spans (as ``text_spans``, empty without any) of every row."""
    spans = text_spans(docs, rate)
    rows = docs.select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"))
    return rows.join(_checked(spans), "text_md5", "left").select("doc_id", "text_md5", F.coalesce("spans", F.array().cast(spans.schema["spans"].dataType)).alias("spans"))


def redact(docs: DataFrame, mark: str = "[SECRET]", rate: float = FDR) -> DataFrame:
    """``docs`` with every span (overlapping ones as one) replaced by ``mark``; all rows stay."""
    found = _checked(text_spans(docs, rate).select(F.col("text_md5").alias("__secret_md5"), F.col("spans").alias("__secret_spans")), "__secret_spans")
    out = docs.join(found, F.md5(docs["text"].cast("binary")) == F.col("__secret_md5"), "left")
    text, spans = docs["text"], F.col("__secret_spans")

    def piece(chunks: Column, a: Column, b: Column) -> Column:
        # only the chunks that a piece lies in are read, never the text from its start
        at = F.floor(a / CHUNK).cast("int")
        held = F.array_join(F.slice(chunks, at + 1, F.floor(b / CHUNK).cast("int") - at + 1), "")
        return F.call_function("substring", held, (a % CHUNK + 1).cast("int"), (b - a).cast("int"))

    def cut(chunks: Column) -> Column:
        # a span that begins inside an earlier one only extends it
        opening = F.filter(spans, lambda s: s["start"] >= s["done"])
        before = F.transform(opening, lambda s: F.concat(piece(chunks, s["done"], s["start"]), F.lit(mark)))
        return F.concat(F.array_join(before, ""), piece(chunks, F.array_max(F.transform(spans, lambda s: s["end"])), F.length(text).cast("long")))

    done = let(F.regexp_extract_all(text, F.lit(rf"[\s\S]{{1,{CHUNK}}}"), F.lit(0)), cut)
    clean = F.when(spans.isNull(), text).otherwise(done)
    return out.select(*[clean.alias("text") if c == "text" else docs[c] for c in docs.columns])


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(read_table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s["kind"] != "random")
    return out.select("doc_id", *[count(k) for k in PATTERNS], F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
                      joined(F.col("spans")).alias("spans"), count("random"))


QUERIES = {"op6_secrets": op6_secrets}
ORACLE: dict[str, str] = {}
