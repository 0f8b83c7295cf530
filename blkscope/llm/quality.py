"""Quality classifier: an interpolated modified Kneser-Ney n-gram model of trusted text.

The units are the characters of a text in any script, white space squeezed, so
that the model knows how words are spelt, written and joined. Each block of
documents hands its distinct n-grams on, with how often trusted documents have
them; counts, continuation counts, contexts and discounts come from joins and
sums sharded by n-gram, and the probability of each n-gram goes back to the
blocks that asked. A document's perplexity is held against the quantile of the
trusted documents of its language. One in HOLD_OUT trusted documents, by a hash
of the key, is kept out of the model; the quantiles come from these.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .blocks import block_of, bundled, count_blocks, opened
from .common import text_of, tidy_pair, written

#: Characters of an n-gram; what stands before and behind a text.
ORDER = 4
START, END = "\x02", "\x03"

#: Texts of a block; n-grams that are compared at once.
BLOCK_BYTES = 8 << 20
PIECE = 1 << 18

#: Spreads numbers over slots.
ODD = np.uint64(0x9E3779B97F4A7C15)

_WHITE = re.compile(r"[\s\x00-\x1f\x7f-\x9f]+")


def units(text: str) -> str:
    """The text's units: runs of white space and control characters as one space, starts before, an end behind. No others: none."""
    plain = _WHITE.sub(" ", text)
    return START * (ORDER - 1) + plain + END if plain else ""


def grams(text: str) -> list[str]:
    """The n-grams of a text, one for each character and one for its end."""
    u = units(text)
    return [u[k : k + ORDER] for k in range(len(u) - ORDER + 1)]


class Numbered:
    """The n-grams of some texts as whole numbers; equal numbers for equal n-grams."""

    def __init__(self, texts: list[str]) -> None:
        """texts as units() makes them."""
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        self.stops = np.cumsum(lengths)
        # text by text: joined, a block with one far character would be four times its size once more
        self.codes = np.empty(int(lengths.sum()), dtype="<u4")
        for text, n, stop in zip(texts, lengths.tolist(), self.stops.tolist()):
            self.codes[stop - n : stop] = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
        have = np.zeros(0x110000, dtype=bool)
        have[self.codes] = True
        self.alphabet = np.flatnonzero(have).astype("<u4")
        self._local = np.zeros(0x110000, dtype=np.uint32)
        self._local[self.alphabet] = np.arange(len(self.alphabet), dtype=np.uint32)
        self._size = max(2, len(self.alphabet))
        # the first characters of an n-gram are numbered apart if all of them together don't fit 63 bits
        self._wide = self._size**ORDER >= 1 << 63
        self._front = np.unique(np.concatenate([self._sum(x, 0, ORDER - 2) for x in self._windows()])) if self._wide and len(self.codes) else None

    def _windows(self) -> Iterator[np.ndarray]:
        """The local numbers of the characters, in parts that overlap by ORDER - 1."""
        for a in range(0, max(0, len(self.codes) - ORDER + 1), PIECE):
            yield self._local[self.codes[a : a + PIECE + ORDER - 1]]

    def _sum(self, x: np.ndarray, a: int, b: int) -> np.ndarray:
        out = np.zeros(len(x) - ORDER + 1, dtype=np.uint64)
        for k in range(a, b):
            out = out * np.uint64(self._size) + x[k : len(x) - ORDER + 1 + k]
        return out

    def numbers(self) -> Iterator[np.ndarray]:
        """For each place of the joined texts the number of the n-gram that begins there, also where it spans two texts."""
        for x in self._windows():
            if self._front is None:
                yield self._sum(x, 0, ORDER)
            else:
                yield np.searchsorted(self._front, self._sum(x, 0, ORDER - 2)).astype(np.uint64) * np.uint64(self._size**2) + self._sum(x, ORDER - 2, ORDER)

    def spans(self) -> np.ndarray:
        """Which places are no n-gram of a text, as their last character is a start of the next one."""
        return self.codes[ORDER - 1 :] == ord(START)

    def strings(self, numbers: np.ndarray) -> list[str]:
        digits = []
        last = ORDER - 2 if self._front is not None else ORDER
        left = numbers.copy()
        if self._front is not None:
            for _ in range(2):
                digits.append(left % np.uint64(self._size))
                left = left // np.uint64(self._size)
            left = self._front[left.astype(np.int64)]
        for _ in range(last):
            digits.append(left % np.uint64(self._size))
            left = left // np.uint64(self._size)
        codes = self.alphabet[np.stack(digits[::-1], axis=1).astype(np.int64)] if len(numbers) else np.empty((0, ORDER), dtype="<u4")
        joined = codes.astype("<u4").tobytes().decode("utf-32-le")
        return [joined[k : k + ORDER] for k in range(0, len(joined), ORDER)]

    def distinct(self) -> np.ndarray:
        """The different numbers of n-grams, in order. Most are found by their slot in a table; those whose slot is another's are sorted."""
        spans, none = self.spans(), np.uint64((1 << 64) - 1)
        bits = max(10, min(21, (2 * len(self.codes)).bit_length()))
        slots = np.full(1 << bits, none, dtype=np.uint64)
        rest = [np.empty(0, dtype=np.uint64)]
        for k, x in enumerate(self.numbers()):
            x = x[~spans[k * PIECE : k * PIECE + len(x)]]
            at = (x * ODD) >> np.uint64(64 - bits)
            free = slots[at] == none
            slots[at[free]] = x[free]
            rest.append(np.unique(x[slots[at] != x]))
        return np.union1d(slots[slots != none], np.concatenate(rest))

    def places(self, distinct: np.ndarray) -> Iterator[np.ndarray]:
        """For each place the index of its n-gram among distinct, which are in order, PIECE at a time; any index where it spans two texts."""
        bits = max(10, (8 * len(distinct)).bit_length())
        shift = np.uint64(64 - bits)
        table = np.zeros(1 << bits, dtype=np.int32)
        table[(distinct * ODD) >> shift] = np.arange(len(distinct), dtype=np.int32)
        for x in self.numbers():
            at = table[(x * ODD) >> shift]
            other = np.flatnonzero(distinct[at] != x)
            at[other] = np.minimum(np.searchsorted(distinct, x[other]), len(distinct) - 1)
            yield at

    def counts(self, distinct: np.ndarray, some: np.ndarray) -> np.ndarray:
        """How often some of the texts, told by flags, have each of the n-grams."""
        wanted = np.repeat(some, np.diff(self.stops, prepend=0))[: max(0, len(self.codes) - ORDER + 1)] & ~self.spans()
        out = np.zeros(len(distinct), dtype=np.int64)
        for k, x in enumerate(self.places(distinct)):
            out += np.bincount(x[wanted[k * PIECE : k * PIECE + len(x)]], minlength=len(distinct))
        return out

    def sums(self, distinct: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each text its number of n-grams and the sum of their values."""
        count, total = np.zeros(len(self.stops), dtype=np.int64), np.zeros(len(self.stops))
        lengths = np.diff(self.stops, prepend=0)
        full = np.flatnonzero(lengths)
        begins, spans, at = (self.stops - lengths)[full], self.spans(), 0
        for x in self.places(distinct):
            true = ~spans[at : at + len(x)]
            first, last = np.searchsorted(begins, at, side="right") - 1, np.searchsorted(begins, at + len(x))
            edges = np.maximum(begins[first:last] - at, 0)
            total[full[first:last]] += np.add.reduceat(np.where(true, values[x], 0.0), edges)
            count[full[first:last]] += np.add.reduceat(true.astype(np.int64), edges)
            at += len(x)
        return count, total


def _roles(known: pa.Table) -> dict:
    return {k: r for k, r in zip(known.column("key").to_pylist(), known.column("role").to_pylist()) if r is not None}


def asked_grams(mine: DataFrame, roles: DataFrame) -> DataFrame:
    """(block, no, gram, n): each block's distinct n-grams with their numbers there, and how often its documents with the role train have them."""

    def run(own: pa.Table, known: pa.Table) -> pa.Table:
        role, docs = _roles(known), opened(own.column("bundle"))
        grams = Numbered(docs.column("text").to_pylist() if docs else [])
        distinct = grams.distinct()
        mine = np.array([role.get(k) == "train" for k in docs.column("key").to_pylist()] if docs else [], dtype=bool)
        counts = grams.counts(distinct, mine) if mine.any() else np.zeros(len(distinct), dtype=np.int64)
        block = own.column("block")[0].as_py() if own.num_rows else known.column("block")[0].as_py()
        n = len(distinct)
        return pa.table({"block": pa.array(np.full(n, block, dtype=np.int32)), "no": pa.array(distinct.view(np.int64)), "gram": pa.array(grams.strings(distinct), pa.string()), "n": pa.array(counts, pa.int64())})

    return mine.groupBy("block").cogroup(roles.groupBy("block")).applyInArrow(tidy_pair(run), "block int, no long, gram string, n long")


def all_counts(grams: DataFrame) -> DataFrame:
    """(gram, n) for n-grams of all orders: counts of the highest order from (gram, n) with n > 0, for lower ones the number of different characters before."""
    top = grams.filter("n > 0").groupBy("gram").agg(F.sum("n").alias("n"))
    parts = F.transform(F.sequence(F.lit(1), F.length("gram") - 1), lambda k: F.substring(F.col("gram"), k, F.length("gram")))
    longer = top.select(F.explode(parts).alias("longer")).distinct()
    lower = longer.groupBy(F.expr("substring(longer, 2)").alias("gram")).agg(F.count("*").alias("n"))
    return top.unionByName(lower)


def discounts_of(counts: DataFrame, order: int = ORDER) -> dict[int, tuple[float, float, float]]:
    """For each order the three discounts of modified Kneser-Ney, from its numbers of counts 1 to 4: at most 4 rows an order."""
    rows = counts.filter("n <= 4").groupBy(F.length("gram").alias("order"), "n").agg(F.count("*").alias("k")).collect()
    out = {}
    for m in range(1, order + 1):
        n1, n2, n3, n4 = (next((r["k"] for r in rows if r["order"] == m and r["n"] == k), 0) for k in (1, 2, 3, 4))
        if not n1 or not n2:
            out[m] = (0.5, 1.0, 1.5)
            continue
        y = n1 / (n1 + 2 * n2)
        raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5)
        out[m] = tuple(min(max(d, 0.05), k + 0.95) for k, d in enumerate(raw))
    return out


def log_probabilities(counts: DataFrame, asked: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, logp) for every different gram of asked, from counts as all_counts makes them.

    The highest order uses counts, the lower ones the number of different
    characters before. An unseen context hands its whole weight down; the lowest
    order is interpolated with the even distribution over the characters of the
    counts and one that stands for all others. Without counts it is even.
    """
    ds = discounts_of(counts, order)
    size = counts.filter("length(gram) = 1").count() + 1

    def discount(gram: str) -> Column:
        out = F.lit(0.0)
        for m, (d1, d2, d3) in ds.items():
            out = F.when(F.length(gram) == m, F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)).otherwise(out)
        return out

    context = F.expr("substring(gram, 1, length(gram) - 1)")
    contexts = counts.groupBy(context.alias("context"), F.length("gram").alias("order")).agg(F.sum("n").alias("total"), (F.sum(discount("gram")) / F.sum("n")).alias("rest"))
    own = counts.select("gram", F.greatest(F.col("n") - discount("gram"), F.lit(0.0)).alias("count"))
    parts = F.transform(F.sequence(F.lit(1), F.lit(order)), lambda k: F.substring(F.col("whole"), k, F.lit(order)))
    every = asked.select(F.col("gram").alias("whole")).distinct().select("whole", F.explode(parts).alias("gram"))
    nodes = every.select("gram").distinct().join(own.hint("merge"), "gram", "left").withColumn("context", context).join(contexts.drop("order").hint("merge"), "context", "left")
    terms = nodes.select("gram", F.when(F.col("total").isNull(), 0.0).otherwise(F.coalesce(F.col("count"), F.lit(0.0)) / F.col("total")).alias("own"), F.coalesce("rest", F.lit(1.0)).alias("rest"))
    found = every.join(terms.hint("merge"), "gram").groupBy("whole").agg(F.array_sort(F.collect_list(F.struct(F.length("gram").alias("order"), "own", "rest"))).alias("terms"))
    p = F.aggregate("terms", F.lit(1.0 / size), lambda p, t: t["own"] + t["rest"] * p)
    return found.select(F.col("whole").alias("gram"), F.log(p).alias("logp"))


#: One in so many trusted documents sets the thresholds instead of training the model.
HOLD_OUT = 3


def trusted_keys(labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, role): keys labelled of good quality and never of bad quality or toxic; role is train or hold."""
    ids = labels.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.min("quality").alias("q"), F.max("toxic").alias("t")).filter("q >= 1 AND coalesce(t, 0) < 1")
    held = F.pmod(F.xxhash64(F.col("key").cast("string")), F.lit(HOLD_OUT)) == 0
    return ids.select("key", F.when(held, "hold").otherwise("train").alias("role"))


def perplexities(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of docs: key, lang, sha (of its text), role, n_units, nll (sum of -log p); empty texts and those of white space only have 0 units.

    role is train or hold for trusted documents, else null. Texts move once, to
    their block; then n-grams, numbers and keys do.
    """
    spark = docs.sparkSession
    kind = dict(docs.dtypes)[key]

    def pack(x: str) -> str:
        u = units(x)
        return u if len(u) > ORDER + (u[ORDER - 1 : ORDER] == " ") else ""

    rows = docs.select(F.col(key).alias("key"), F.col(lang).cast("string").alias("lang"), F.unhex(F.sha2(text_of(text), 256)).alias("sha"), F.col(text).alias("text"))
    blocks = count_blocks(docs, text, block_bytes)
    mine = bundled(rows, blocks, pack)
    keys = rows.filter("key IS NOT NULL").select(block_of("key", "text", blocks).alias("block"), "key").distinct()
    trusted = trusted_keys(labels, key)
    roles = written(keys.join(trusted.withColumn("key", F.col("key").cast(kind)).hint("merge"), "key").select("block", "key", "role"), "roles")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    asked = written(asked_grams(mine, roles), "asked")
    counts = written(all_counts(asked.select("gram", "n")), "counts")
    model = log_probabilities(counts, asked.select("gram"))
    found = asked.select("block", "no", "gram").join(model.hint("merge"), "gram").select("block", "no", "logp")
    none = {"key": kind, "role": "string", "no": "long", "logp": "double"}

    def shaped(df: DataFrame) -> DataFrame:
        return df.select("block", *[F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in none.items()])

    told = shaped(found).unionByName(shaped(roles)).repartition(partitions, "block")

    nothing = pa.table({"key": pa.array([], to_arrow_type(rows.schema["key"].dataType)), **{n: pa.array([], t) for n, t in (("lang", pa.string()), ("sha", pa.string()), ("role", pa.string()), ("n_units", pa.int64()), ("nll", pa.float64()))}})

    def score(own: pa.Table, known: pa.Table) -> pa.Table:
        role, docs = _roles(known), opened(own.column("bundle"))
        if docs is None:
            return nothing
        grams = Numbered(docs.column("text").to_pylist())
        no, logp = (known.column(c).drop_null().to_numpy() for c in ("no", "logp"))
        order = np.argsort(no)
        distinct, logp = no[order].view(np.uint64), logp[order]
        n, total = grams.sums(distinct, logp)
        keys = docs.column("key")
        sha = pa.array([x.hex() for x in docs.column("sha").to_pylist()], pa.string())
        return pa.table({"key": keys, "lang": docs.column("lang"), "sha": sha, "role": pa.array([role.get(k) for k in keys.to_pylist()], pa.string()), "n_units": pa.array(n, pa.int64()), "nll": pa.array(-total, pa.float64())})

    return mine.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(tidy_pair(score), f"key {kind}, lang string, sha string, role string, n_units long, nll double").withColumnRenamed("key", key)


#: Quantile of the trusted documents of a language beyond which a document is rejected; what is added to it
#: over the root of their number, for few of them say little of it; and the units of average text that
#: a document's own are weighed with, so that a few words can't reject it.
QUANTILE, ROOM, PRIOR = 0.998, 1.0, 60.0


def quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", quantile: float = QUANTILE, prior: float = PRIOR, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of docs: key, lang, n_units, perplexity, threshold, keep.

    The perplexity of a short document is drawn towards that of its language's
    trusted text by prior units. A language without held out documents (and a
    null one) has the threshold of all languages together; without any trusted
    document the model is even and all is kept. Null texts, empty ones and those
    of white space only have no units and no perplexity and are rejected.
    Repeated rows are judged alike, each in its own row. No rows: no rows. Other
    columns are ignored, whatever their names.
    """
    return _judged(written(perplexities(docs, labels, key, text, lang, block_bytes), "perplexities"), key, quantile, prior).drop("sha")


def rejected(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(key, sha) of rows that quality does not keep; none of those of which a repetition is kept."""
    judged = _judged(written(perplexities(docs, labels, key, text, lang, block_bytes), "perplexities"), key, QUANTILE, PRIOR)
    return judged.groupBy(F.col(key).alias("key"), "sha").agg(F.max("keep").alias("keep")).filter("NOT keep").select("key", "sha")


def _limit(x: str, quantile: float) -> Column:
    return F.percentile_approx(x, quantile, 10000) * (1 + ROOM / F.sqrt(F.greatest(F.lit(1), F.count(x))))


def _judged(scored: DataFrame, key: str, quantile: float, prior: float) -> DataFrame:
    """The answers of quality with sha, for the rows of perplexities."""
    rate = scored.filter("role IS NOT NULL AND n_units > 0")
    if not (held := rate.filter("role = 'hold'")).isEmpty():
        rate = held
    overall = rate.agg((F.sum("nll") / F.sum("n_units")).alias("m")).first()["m"]
    means = rate.groupBy("lang").agg((F.sum("nll") / F.sum("n_units")).alias("mean"))

    def drawn(mean: Column) -> Column:
        return F.exp((F.col("nll") + prior * mean) / (F.col("n_units") + prior))

    rate = rate.join(means.withColumnRenamed("lang", "l"), F.col("lang").eqNullSafe(F.col("l")))
    limits = rate.select("lang", "mean", drawn(F.col("mean")).alias("x")).groupBy("lang", "mean").agg(_limit("x", quantile).alias("limit"))
    all_limit = rate.select(drawn(F.lit(overall).cast("double")).alias("x")).agg(_limit("x", quantile).alias("x")).first()["x"]
    limits = written(limits, "limits").select(F.col("lang").alias("l"), F.col("mean").alias("own"), "limit")
    rows = scored.join(limits, F.col("lang") == F.col("l"), "left")
    mean = F.coalesce("own", F.lit(overall).cast("double"), F.lit(0.0))
    limit = F.coalesce("limit", F.lit(all_limit).cast("double"), F.lit(float("inf")))
    perplexity = F.when(F.col("n_units") > 0, drawn(mean))
    return rows.select(key, "lang", "n_units", perplexity.alias("perplexity"), limit.alias("threshold"), F.coalesce(perplexity <= limit, F.lit(False)).alias("keep"), "sha")
