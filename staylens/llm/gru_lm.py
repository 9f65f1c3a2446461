"""Language-model scores from a gated recurrent network.

A text is its words (A-Z lower-cased, split at ASCII white space) and one end.
Counts of all training words are a stored table. The network's vocabulary is
the ``WORDS`` most frequent ones in ``CLASSES`` frequency classes, the end, and
one symbol for all other words; p(word) = p(class | state) p(word | class,
state), and another word's share of its symbol is (c + 1) / (their total + 1
for unseen ones), so probabilities sum to one. A GRU over one-hot input carries
its state through the whole text.

Training: plain numpy inside tasks, truncated backpropagation over windows of
``STEPS`` words, ``STREAMS`` texts side by side. The training texts are dealt by
hash into ``ROUNDS`` parts; in each round every task starts from the common
weights, takes every window of its texts of that part, and the weights are
averaged by words. Each training text is used exactly once. The driver holds
one set of weights (a fixed size) and the ``HEAD`` most frequent words.

Scoring: one pass; counts of the words beyond ``HEAD`` come by a join on the
word, not by a broadcast.

Edge cases: null is the empty text (one end); repeated rows are scored alike;
without training texts the base score is 0 per token; a null doc_id counts as
the empty text for the split; empty tables give empty results; extra columns
are ignored.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, small_batches, stored

CLASSES, PER_CLASS = 32, 64
WORDS = CLASSES * PER_CLASS
HEAD = 1 << 16
HIDDEN = 16
STEPS, STREAMS = 32, 256
ROUNDS = 3
RATE = 0.1
#: Words that a task holds before it learns from them and before it hands on their counts, and bytes of text before it scores them.
BUFFER, COUNTED, SCORED = 1_000_000, 4_000_000, 1 << 24
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
END = b""
_END, _OTHER = WORDS, WORDS + 1                 # symbols beside 0..WORDS-1
_SYMBOLS = WORDS + 2


def words(text) -> list[bytes]:
    """The words of a text; ``bytes.split`` splits at 0x20 and 0x09-0x0D. ``split`` is its form for batches."""
    return text.encode("utf-8", "replace").translate(_LOWER).split() if text else []


def split(texts) -> tuple:
    """``words`` of a batch's texts (an Arrow array of strings): all of them as one binary
    array, and how many each text has."""
    import pyarrow as pa
    import pyarrow.compute as pc

    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    n = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().cast(pa.binary())
    real = pc.greater(pc.binary_length(flat), 0)               # white space at an end leaves an empty piece
    below = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
    last = np.cumsum(n)
    return flat.filter(real), below[last] - below[last - n]


def ranks(flat, head) -> np.ndarray:
    """Places of words in ``head``, -1 beyond it (both Arrow arrays)."""
    import pyarrow.compute as pc

    return pc.index_in(flat, value_set=head).fill_null(-1).to_numpy(zero_copy_only=False)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def word_counts(texts: DataFrame) -> DataFrame:
    """(word binary, c) over all texts, the end being the empty word; every task
    adds up its own words first. Stored."""
    small_batches(texts.sparkSession, 500)

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        def out():
            made = pc.value_counts(pa.chunked_array(held, pa.binary()))
            return pa.RecordBatch.from_arrays([made.field("values"), made.field("counts")], names=["word", "c"])

        held, size, ends = [], 0, 0
        for b in batches:
            held.append(split(b.column("text"))[0])
            size, ends = size + len(held[-1]), ends + b.num_rows
            if size >= COUNTED:
                yield out()
                held, size = [], 0
        yield out()
        if ends:
            yield pa.RecordBatch.from_arrays([pa.array([END], pa.binary()), pa.array([ends], pa.int64())], names=["word", "c"])

    return stored(texts.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")), "word-counts")


class Weights:
    """Weights of the network as one flat float32 vector with named views."""

    SHAPES = {"g": (_SYMBOLS, 3 * HIDDEN), "u": (HIDDEN, 3 * HIDDEN), "wc": (HIDDEN, CLASSES + 2), "bc": (CLASSES + 2,),
              "ww": (CLASSES, HIDDEN, PER_CLASS), "bw": (CLASSES, PER_CLASS)}
    SIZE = sum(math.prod(s) for s in SHAPES.values())

    def __init__(self, flat: np.ndarray):
        self.flat, at = flat, 0
        for name, shape in self.SHAPES.items():
            setattr(self, name, flat[at: at + math.prod(shape)].reshape(shape))
            at += math.prod(shape)

    @classmethod
    def first(cls, counts: np.ndarray, ends: int, others: int) -> "Weights":
        """Small random weights; the output biases give the unigram distribution."""
        r = np.random.Generator(np.random.PCG64(3))
        w = cls((r.standard_normal(cls.SIZE) * 0.05).astype(np.float32))
        c = np.zeros(WORDS)
        c[: len(counts)] = counts
        c = c.reshape(CLASSES, PER_CLASS) + 0.1
        mass = np.concatenate([c.sum(1), [ends + 0.1, others + 0.1]])
        w.bc[:] = np.log(mass / mass.sum())
        w.bw[:] = np.log(c / c.sum(1, keepdims=True))
        return w


def _sigmoid(x: np.ndarray) -> None:
    """In place."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    np.reciprocal(x, out=x)


def _small(matrix: np.ndarray, bias: np.ndarray) -> bool:
    """No state (all within -1 and 1) has an output beyond 60 with these weights."""
    return float((np.abs(matrix).sum(-2) + np.abs(bias)).max()) < 59


def _softmax(x: np.ndarray, small: bool = False) -> np.ndarray:
    if not small and len(x) and (x.max() > 60 or x.min() < -60):       # else neither the powers nor their sums leave float32
        x -= x.max(1, keepdims=True)
    np.exp(x, out=x)
    x /= (x @ np.ones(x.shape[1], np.float32))[:, None]
    return x


class Streams:
    """Texts (symbol arrays with their end) laid side by side: each stream is a
    sequence of texts, the state starts at zero with every text."""

    def __init__(self, texts: list[np.ndarray]):
        loads: list[list[int]] = [[] for _ in range(min(STREAMS, len(texts)))]
        import heapq

        heap = [(0, s) for s in range(len(loads))]
        for i in sorted(range(len(texts)), key=lambda i: -len(texts[i])):
            n, s = heap[0]
            loads[s].append(i)
            heapq.heapreplace(heap, (n + len(texts[i]), s))
        loads.sort(key=lambda one: -sum(len(texts[i]) for i in one))
        sizes = [sum(len(texts[i]) for i in one) for one in loads]
        self.length = sizes[0]
        self.target = np.full((self.length, len(loads)), -1, np.int32)
        self.owner = np.zeros((self.length, len(loads)), np.int32)
        self.begin = np.zeros((self.length, len(loads)), bool)
        for s, one in enumerate(loads):
            at = 0
            for i in one:
                n = len(texts[i])
                self.target[at: at + n, s], self.owner[at: at + n, s], self.begin[at, s] = texts[i], i, True
                at += n
        self.active = np.searchsorted(-np.array(sizes), -np.arange(self.length), side="left")     # streams longer than t

    def windows(self):
        """(first step, last step + 1, streams that are active in it)."""
        for a in range(0, self.length, STEPS):
            yield a, min(self.length, a + STEPS), int(self.active[a])


class Window:
    """A window of ``s`` run from the states ``h``: what its steps made, all rows of
    all steps after one another (rows ``at[i]`` to ``at[i + 1]`` are step i's)."""

    def __init__(self, w: Weights, s: Streams, a: int, b: int, n: int, h: np.ndarray):
        active = s.active[a:b]
        here = np.arange(n) < active[:, None]
        begin = s.begin[a:b, :n]
        before = s.target[a - 1: b - 1, :n] if a else np.concatenate([np.full((1, n), _END, np.int32), s.target[: b - 1, :n]])
        self.at = [0, *np.cumsum(active).tolist()]
        self.x, self.target, self.owner = np.where(begin, _END, before)[here], s.target[a:b, :n][here], s.owner[a:b, :n][here]
        self.stay = (~begin[here]).astype(np.float32)[:, None]          # 0 where a text begins
        g, rows = w.g[self.x], len(self.x)
        self.old, self.cand, self.hc, self.states = (np.empty((rows, HIDDEN), np.float32) for _ in range(4))
        self.zr = np.empty((rows, 2 * HIDDEN), np.float32)
        for lo, hi in zip(self.at, self.at[1:]):
            old = np.multiply(h[: hi - lo], self.stay[lo:hi], out=self.old[lo:hi])
            hu = old @ w.u
            zr, c, h = self.zr[lo:hi], self.cand[lo:hi], self.states[lo:hi]
            np.add(g[lo:hi, : 2 * HIDDEN], hu[:, : 2 * HIDDEN], out=zr)
            _sigmoid(zr)
            self.hc[lo:hi] = hu[:, 2 * HIDDEN:]
            np.multiply(zr[:, HIDDEN:], hu[:, 2 * HIDDEN:], out=c)
            c += g[lo:hi, 2 * HIDDEN:]
            np.tanh(c, out=c)
            np.subtract(old, c, out=h)                                  # the new state, c + z * (old - c)
            h *= zr[:, :HIDDEN]
            h += c
        self.last = h

    def back(self, w: Weights, dout: np.ndarray, grad: Weights) -> np.ndarray:
        """Adds the gradient of ``u``; returns those of the input rows."""
        z, r = self.zr[:, :HIDDEN], self.zr[:, HIDDEN:]
        by_c, by_r = (1 - z) * (1 - self.cand * self.cand), self.hc * r * (1 - r)
        by_z = (self.old - self.cand) * z * (1 - z)
        dhu, dc, ut = np.empty((len(z), 3 * HIDDEN), np.float32), np.empty((len(z), HIDDEN), np.float32), np.ascontiguousarray(w.u.T)
        later = np.zeros((0, HIDDEN), np.float32)
        for lo, hi in zip(self.at[-2::-1], self.at[:0:-1]):
            d, one, c = dout[lo:hi], dhu[lo:hi], dc[lo:hi]
            d[: len(later)] += later
            np.multiply(d, by_c[lo:hi], out=c)
            np.multiply(d, by_z[lo:hi], out=one[:, :HIDDEN])
            np.multiply(c, by_r[lo:hi], out=one[:, HIDDEN: 2 * HIDDEN])
            np.multiply(c, r[lo:hi], out=one[:, 2 * HIDDEN:])
            d *= z[lo:hi]
            later = one @ ut
            later += d
            later *= self.stay[lo:hi]
        grad.u += self.old.T @ dhu
        dhu[:, 2 * HIDDEN:] = dc
        return dhu


def _outputs(w: Weights, h: np.ndarray, target: np.ndarray, grad: Weights | None):
    """Natural log-probabilities of the targets; with ``grad`` also adds the output
    layer's gradients (of the summed loss) and returns that of the states."""
    cls = np.where(target < WORDS, target // PER_CLASS, target - WORDS + CLASSES)
    p = _softmax(h @ w.wc + w.bc, _small(w.wc, w.bc))
    every = np.arange(len(h))
    logp = np.log(p[every, cls])
    dh = None
    if grad is not None:
        p[every, cls] -= 1
        grad.wc += h.T @ p
        grad.bc += p.sum(0)
        dh = p @ w.wc.T
    order = np.argsort(cls.astype(np.uint16), kind="stable")             # 16 bits: a radix sort
    bounds = np.searchsorted(cls[order], np.arange(CLASSES + 1)).tolist()
    inside = order[: bounds[-1]]
    hs, word = h[inside], target[inside] % PER_CLASS
    own = np.empty(len(inside), np.float32)
    ds = np.empty_like(hs)
    small = _small(w.ww, w.bw)
    for c in range(CLASSES):
        lo, hi = bounds[c], bounds[c + 1]
        if lo < hi:
            hc = hs[lo:hi]
            q = _softmax(hc @ w.ww[c] + w.bw[c], small)
            one = np.arange(hi - lo)
            own[lo:hi] = q[one, word[lo:hi]]
            if grad is not None:
                q[one, word[lo:hi]] -= 1
                grad.ww[c] += hc.T @ q
                grad.bw[c] += q.sum(0)
                np.matmul(q, w.ww[c].T, out=ds[lo:hi])
    logp[inside] += np.log(own)
    if grad is not None:
        dh[inside] += ds
    return logp, dh


def _adagrad(w: np.ndarray, seen: np.ndarray, g: np.ndarray) -> None:
    """One step in place; ``seen`` holds the sums of squares."""
    np.clip(g, -5, 5, out=g)
    seen += g * g
    g *= RATE
    g /= np.sqrt(seen)
    w -= g


def train_buffer(w: Weights, seen: np.ndarray, texts: list[np.ndarray]) -> None:
    """One pass over texts: a step (Adagrad, ``seen`` holds the squares) per window.
    Input rows of words that a window lacks have no gradient and are left alone."""
    if not texts:
        return
    s = Streams(texts)
    h = np.zeros((s.target.shape[1], HIDDEN), np.float32)
    past, dense = Weights(seen), slice(w.g.size, None)
    for a, b, n in s.windows():
        v = Window(w, s, a, b, n, h)
        h = v.last
        grad = Weights(np.zeros(Weights.SIZE, np.float32))
        _, dout = _outputs(w, v.states, v.target, grad)
        dx = v.back(w, dout, grad)
        order = np.argsort(v.x.astype(np.uint16), kind="stable")
        x = v.x[order]
        first = np.flatnonzero(np.concatenate([[True], np.diff(x) > 0]))
        rows, g = x[first], np.add.reduceat(dx[order], first, axis=0)
        scale = len(v.target) / 64                   # a step's size doesn't depend on the streams in use
        g /= scale
        squares, moved = past.g[rows], w.g[rows]
        _adagrad(moved, squares, g)
        past.g[rows], w.g[rows] = squares, moved
        rest = grad.flat[dense]
        rest /= scale
        _adagrad(w.flat[dense], seen[dense], rest)


def score_buffer(w: Weights, texts: list[np.ndarray]) -> np.ndarray:
    """Natural log-likelihood of each text's symbols, the state carried through all its windows."""
    out = np.zeros(len(texts))
    if not texts:
        return out
    s = Streams(texts)
    h = np.zeros((s.target.shape[1], HIDDEN), np.float32)
    for a, b, n in s.windows():
        v = Window(w, s, a, b, n, h)
        h = v.last
        logp, _ = _outputs(w, v.states, v.target, None)
        out += np.bincount(v.owner, logp, len(texts))
    return out


def symbols(rank: np.ndarray) -> np.ndarray:
    """Network symbols of word ranks (-1: beyond the head), with the end."""
    out = np.where((rank < 0) | (rank >= WORDS), _OTHER, rank)
    return np.append(out, _END).astype(np.int32)


class Model:
    """head: most frequent words; counts: theirs; weights; and the totals."""

    def __init__(self, head, counts, weights, tokens, types, ends):
        self.head, self.counts, self.weights = head, counts, weights
        self.tokens, self.types, self.ends = tokens, types, ends
        inside = min(WORDS, len(head))
        #: log10 of the total mass that the words outside the network's vocabulary share
        self.other = math.log10(tokens - ends - int(counts[:inside].sum()) + (types - (ends > 0) - inside) + 1)


def _texts(batch, head) -> list[np.ndarray]:
    """Symbol arrays of a batch's texts."""
    flat, n = split(batch.column("text"))
    rank, last = ranks(flat, head), np.cumsum(n)
    return [symbols(rank[a:b]) for a, b in zip(last - n, last)]


def _buffers(batches, head):
    """Texts as symbol arrays, about ``BUFFER`` words at a time."""
    texts, size = [], 0
    for b in batches:
        for text in _texts(b, head):
            texts.append(text)
            size += len(text)
            if size >= BUFFER:
                yield texts
                texts, size = [], 0
    if texts:
        yield texts


def fit(docs: DataFrame, counts: DataFrame) -> Model:
    """Train on the rows of ``docs`` (doc_id, text); ``counts`` are their word counts."""
    spark = docs.sparkSession
    small_batches(spark, 500)
    total = counts.agg(F.sum("c"), F.count(F.lit(1)), F.sum(F.when(F.col("word") == F.lit(END), F.col("c")))).first()
    tokens, types, ends = (int(x or 0) for x in total)
    top = counts.where(F.col("word") != F.lit(END)).orderBy(F.desc("c"), "word").limit(HEAD).collect()
    head, held = [bytes(r["word"]) for r in top], np.array([r["c"] for r in top], np.int64)
    inside = held[:WORDS]
    flat = Weights.first(inside, ends, tokens - ends - int(inside.sum())).flat
    known = spark.sparkContext.broadcast(head[:WORDS])
    for turn in range(ROUNDS if tokens else 0):
        shared = spark.sparkContext.broadcast(flat)

        def run(batches):
            import pyarrow as pa

            w, seen, n = Weights(shared.value.copy()), np.full(Weights.SIZE, 1e-2, np.float32), 0
            for texts in _buffers(batches, pa.array(known.value, pa.binary())):
                train_buffer(w, seen, texts)
                n += sum(map(len, texts))
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([float(n)]), pa.array([w.flat.tobytes()], pa.binary())], names=["n", "w"])

        def add(batches):
            import pyarrow as pa

            n, total = 0.0, np.zeros(Weights.SIZE)
            for b in batches:
                for k, w in zip(b.column("n").to_pylist(), b.column("w")):
                    n, total = n + k, total + k * np.frombuffer(w.as_buffer(), np.float32)
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.tobytes()], pa.binary())], names=["n", "w"])

        part = docs.where(F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(ROUNDS)) == turn).select("text")
        made = stored(part.mapInArrow(run, "n double, w binary"), "weights")        # one row per task
        sums = made.repartition(8).mapInArrow(add, "n double, w binary").collect()   # eight rows, however many tasks
        n = sum(r["n"] for r in sums)
        if n:
            flat = (sum(np.frombuffer(r["w"]) for r in sums) / n).astype(np.float32)
    return Model(head, held, flat, tokens, types, ends)


def score(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score (log10) of every row."""
    spark = docs.sparkSession
    small_batches(spark, 500)
    m = spark.sparkContext.broadcast((model.head, model.counts, model.weights, model.ends, model.other))
    schema = "doc_id long, n_tokens long, known long, logs double, model double, others long, other_logs double, rest array<binary>"

    def run(batches):
        import pyarrow as pa

        head, held, flat, ends, other = m.value
        w, logs, known = Weights(flat), np.append(np.log10(held + 1.0), 0.0), pa.array(head, pa.binary())

        def scored(parts):
            b = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
            found, n = split(b.column("text"))
            rank, last = ranks(found, known), np.cumsum(n)
            far, outside, log = rank < 0, (rank < 0) | (rank >= WORDS), logs[rank]
            texts, rows = [], []
            for a, z in zip(last - n, last):
                away = outside[a:z]
                texts.append(symbols(rank[a:z]))
                rows.append((float(log[a:z].sum()) + math.log10(ends + 1), int(away.sum()), float(log[a:z][away].sum())))
            base, others, other_logs = zip(*rows)
            beyond = np.concatenate([[0], np.cumsum(far)])[np.concatenate([[0], last])]
            rest = pa.ListArray.from_arrays(pa.array(beyond, pa.int32()), found.filter(pa.array(far)))
            made = pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n + 1), pa.array(n - np.diff(beyond) + (ends > 0)), pa.array(base, pa.float64()),
                 pa.array(score_buffer(w, texts) / math.log(10)), pa.array(others, pa.int64()), pa.array(other_logs, pa.float64()), rest],
                names=["doc_id", "n_tokens", "known", "logs", "model", "others", "other_logs", "rest"])
            for at in range(0, made.num_rows, 2000):
                yield made.slice(at, 2000)

        parts, size = [], 0
        for b in batches:
            parts += [b] if b.num_rows else []
            size += b.column("text").nbytes
            if size >= SCORED:
                yield from scored(parts)
                parts, size = [], 0
        if parts:
            yield from scored(parts)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
    rows = stored(rows.withColumn("key", F.monotonically_increasing_id()), "lm-scored")
    far = rows.select("key", F.explode("rest").alias("word")).join(counts, "word")
    found = far.groupBy("key").agg(F.sum(F.log10(F.col("c") + F.lit(1.0))).alias("far_logs"), F.count(F.lit(1)).alias("far_known"))
    more = F.coalesce(F.col("far_logs"), F.lit(0.0))
    base = F.lit(math.log10(model.tokens + model.types + 1))
    return rows.join(found, "key", "left").select(
        "doc_id", "n_tokens", (F.col("known") + F.coalesce("far_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"), (F.col("logs") + more - F.col("n_tokens") * base).alias("base_score"),
        (F.col("model") + F.col("other_logs") + more - F.col("others") * F.lit(model.other)).alias("score"))


def op3_gru_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    learn = docs.where(~held_out(F.col("doc_id")))
    counts = word_counts(learn)
    out = score(docs, fit(learn, counts), counts)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op3_gru_lm": op3_gru_lm}
ORACLE: dict[str, str] = {}
