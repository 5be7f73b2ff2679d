"""Operator 4: toxicity by class-conditional Kneser-Ney models.

Two models, of toxic and of ordinary text, predict the characters of each word from
the ``ORDER - 1`` before them by interpolated Kneser-Ney smoothing: absolute
discounting of counts, and counts of distinct continuations below the highest order.
Orders up to ``SHARED`` use continuation counts of both classes together, so an
expression that one class, or neither, has seen is smoothed alike in both.

An expression's evidence is its toxic minus its ordinary log-likelihood, divided by
its length. A document is scored by the evidence of all its words above each of ``MARGINS`` and
by the mean over the document, through a logistic curve that is fitted on labelled
rows which the models have not counted. Its constant is then moved from the ratio of
the classes among those rows to that among all usable labels, which are counted in
Spark, so a bound that thins one class more than the other does not move the decision.

Labels come only from rows whose ``crc32(doc_id) mod 5`` is not 0, at most
``SAMPLE`` of each class, those with the smallest hashes of doc_id; the models keep
all grams of these rows. So the model's size is bounded by theirs however many rows the
tables hold, and it is broadcast. Labels other than 0 and 1, null ones, and rows with
conflicting labels teach nothing. Null, empty and wordless texts get the score of no
evidence; with no labels of a class every score is that class's absence (0, or 0.5
with no labels at all). Rows without doc_id are scored too and not held out; repeated
rows are scored alike.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ledgerleaf.llm import _bytes, _shared

ORDER, SHARED = 6, 3
DISCOUNT = 0.75
MARGINS = (0.5, 1.0)
#: Most labelled rows of a class (ordinary, toxic).
SAMPLE = (16_000, 8_000)
_WORD = regex.compile(r"\p{L}+")
#: Words whose evidence a worker remembers.
_CACHED = 100_000


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def grams(word: str) -> list[str]:
    padded = "^" * (ORDER - 1) + word + "$"
    return [padded[i : i + ORDER] for i in range(len(word) + 1)]


def _letters(names: list[str]) -> np.ndarray:
    """(grams, ORDER): code points of grams."""
    return np.frombuffer("".join(names).encode("utf-32-le"), np.uint32).reshape(-1, ORDER)


def _keys(letters: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For n from 1 to ORDER the hashes of each gram's last n characters, and of these without the last one."""
    mixed = _bytes.mix(letters.astype(np.uint64) + np.uint64(1))
    context, out = np.zeros(len(letters), np.uint64), ([], [])
    power = 1
    for n in range(1, ORDER + 1):
        out[0].append(_bytes.mix(mixed[:, -1] + context * _BASE + np.uint64(n)))
        out[1].append(_bytes.mix(context + np.uint64(n << 8)))
        if n < ORDER:
            context = context + mixed[:, -1 - n] * np.uint64(power)
            power = power * int(_BASE) % (1 << 64)
    return out


_BASE = np.uint64(0x9E3779B97F4A7C15)


def _sums(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(different keys in order, sums of each of the values)."""
    found, which = np.unique(keys, return_inverse=True)
    return found, np.array([np.bincount(which, v, len(found)) for v in values])


class Models:
    """Both models as sorted arrays of hashed grams, from the grams' counts in ordinary and in toxic text.

    ``counts[n - 1]``: (grams of n characters, their counts of each class); below
    ORDER counts of distinct characters before the gram, of both classes together
    up to SHARED. ``contexts[n - 1]``: (what precedes the last character, sums and
    numbers of distinct followers of each class).
    """

    def __init__(self, names: list[str], counts: np.ndarray):
        grams, contexts = _keys(_letters(names))
        self.counts, self.contexts = [None] * ORDER, [None] * ORDER
        one, own = np.arange(len(names)), counts.T.astype(np.float64)
        for n in range(ORDER, 0, -1):  # ``one``: a row of ``names`` for each gram of n characters
            order = np.argsort(grams[n - 1][one])
            self.counts[n - 1] = grams[n - 1][one][order], own[:, order].astype(np.float32)
            key, sums = _sums(contexts[n - 1][one], own[0], own[1], own[0] > 0, own[1] > 0)
            self.contexts[n - 1] = key, sums.astype(np.float32)
            if n > 1:
                seen = own > 0
                if n - 1 <= SHARED:
                    seen = np.array([seen.any(axis=0)] * 2)
                key, first, which = np.unique(grams[n - 2][one], return_index=True, return_inverse=True)
                own, one = np.array([np.bincount(which, s, len(key)) for s in seen]), one[first]
        self.floor = 1 / (len(self.counts[0][0]) + 1)

    def log_ratios(self, grams: list[np.ndarray], contexts: list[np.ndarray]) -> np.ndarray:
        """Log of the toxic over the ordinary probability of the last character after the others, of grams by their hashes."""
        p = np.full((2, len(grams[0])), self.floor)
        for n, (gram, context) in enumerate(zip(grams, contexts)):
            count, (sums, kinds) = _at(*self.counts[n], gram), np.split(_at(*self.contexts[n], context), 2)
            p = np.where(sums > 0, (np.maximum(count - DISCOUNT, 0) + DISCOUNT * kinds * p) / np.maximum(sums, 1), p)
        return np.log(p[1] / p[0])

    def evidence(self, found: list[str]) -> np.ndarray:
        """Toxic minus ordinary log-likelihood of words, by character."""
        sizes = np.array([len(w) + 1 for w in found])
        keys = _keys(_letters([g for w in found for g in grams(w)]))
        _, first, which = np.unique(keys[0][-1], return_index=True, return_inverse=True)
        ratios = self.log_ratios(*([k[first] for k in own] for own in keys))
        return np.add.reduceat(ratios[which], np.r_[0, np.cumsum(sizes)[:-1]]) / sizes


def _at(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Of each row of values the one at each wanted key, 0 where there is none."""
    if not len(keys):
        return np.zeros((len(values), len(wanted)))
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[:, at], 0).astype(np.float64)


class Evidence(dict):
    """Word -> evidence; what a worker has met so far, up to a bound."""

    def __init__(self, models: Models):
        super().__init__()
        self.models = models

    def features(self, texts: list[str | None]) -> np.ndarray:
        """Of each text, for each margin, the log of 1 + the evidence above it, and then the mean evidence."""
        found = [words(t) for t in texts]
        if len(self) > _CACHED:
            self.clear()
        new = list({w for own in found for w in own if w not in self})
        for k in range(0, len(new), 5_000):
            self.update(zip(new[k : k + 5_000], self.models.evidence(new[k : k + 5_000]).tolist()))
        out = np.zeros((len(texts), len(MARGINS) + 1))
        for row, own in zip(out, found):
            e = np.fromiter(map(self.__getitem__, own), np.float64, len(own))
            row[:] = *(np.log1p(np.maximum(e - m, 0).sum()) for m in MARGINS), e.sum() / max(len(e), 1)
        return out


def fitted(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Weights (constant first) of a logistic curve, by Newton steps with a small ridge."""
    x = np.c_[np.ones(len(x)), x]
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-6] + [1e-2] * (x.shape[1] - 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge, x.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def _usable(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic, drawn): all rows that may be learnt from."""
    usable = labels.where("doc_id is not null and crc32(cast(doc_id as string)) % 5 <> 0").groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("other"))
    return usable.where("toxic = other and toxic in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"), F.xxhash64(F.col("doc_id").cast("long")).alias("drawn"))


def _sample(usable: DataFrame, sample: tuple[int, int]) -> DataFrame:
    """The bounded part of ``usable`` that is learnt from."""
    return usable.where("toxic = 0").orderBy("drawn").limit(sample[0]).unionByName(usable.where("toxic = 1").orderBy("drawn").limit(sample[1]))


def _words_of(batches):
    """In: text, toxic; out: the task's words with their counts in ordinary and in toxic text."""
    for batch in batches:
        counts = (Counter(), Counter())
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            counts[toxic].update(words(text))
        yield _counted(counts, "word")


def _grams_of(batches):
    for batch in batches:
        counts = (Counter(), Counter())
        for word, n0, n1 in zip(*(batch.column(i).to_pylist() for i in range(3))):
            for g in grams(word):
                if n0:
                    counts[0][g] += n0
                if n1:
                    counts[1][g] += n1
        yield _counted(counts, "gram")


def _counted(counts: tuple[Counter, Counter], name: str) -> pa.RecordBatch:
    keys = list(counts[0] | counts[1])
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array([c[k] for k in keys], pa.int64()) for c in counts)], [name, "n0", "n1"])


def _featured(model, within: str | None = None):
    """In: any columns and at last the text; out: these columns and the features in its place.

    ``within``: the text is this field of a struct, the only column, which stays.
    """

    def run(batches):
        evidence = Evidence(model.value)  # goes with the task
        for batch in batches:
            if within:
                row = batch.column(0)
                batch = pa.RecordBatch.from_arrays([row, row.field(row.type.get_field_index(within))], ["row", "text"])
            last = batch.num_columns - 1
            x = np.concatenate([np.zeros((0, len(MARGINS) + 1)), *(evidence.features(some.column(last).to_pylist()) for some in _bytes.slices(batch, last, 1 << 19))])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists], [*batch.schema.names[:-1], "x"])

    return _shared.lean("toxicity", run)


def _scorer(docs: DataFrame, labels: DataFrame, sample: tuple[int, int]):
    """A function from a DataFrame, whose last column is a text, to the score in its place; or from one struct, with the score beside it."""
    spark = docs.sparkSession
    _shared.small_batches(spark)
    usable = _usable(labels)
    every = {r["toxic"]: r["count"] for r in usable.groupBy("toxic").count().collect()}
    drawn = _sample(usable, sample).toArrow().sort_by("drawn")  # bounded by ``sample``
    drawn = spark.createDataFrame(drawn.drop(["drawn"]).append_column("fit", pa.array(np.arange(len(drawn)) % 5 == 0)))  # Arrow: rows of Python would start further workers in the executors
    taught = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(drawn), "doc_id")
    counted = taught.where("not fit").select("text", "toxic").mapInArrow(_words_of, "word string, n0 long, n1 long").groupBy("word").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    counted = counted.mapInArrow(_grams_of, "gram string, n0 long, n1 long").groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    table = counted.toArrow()  # bounded by ``sample``
    model = Models(table["gram"].to_pylist(), np.array([table["n0"].to_numpy(), table["n1"].to_numpy()]).T.reshape(-1, 2))
    model = spark.sparkContext.broadcast(model)
    featured = _featured(model)
    del table
    known = taught.where("fit").select("toxic", "doc_id", "text").mapInArrow(featured, "toxic int, doc_id long, x array<double>").orderBy("toxic", "doc_id", "x").toPandas()
    classes = set(known["toxic"])
    if classes == {0, 1}:
        toxic = known["toxic"].to_numpy(np.float64)
        w = fitted(np.array(known["x"].to_list()), toxic)
        w[0] += math.log(every[1] / every[0]) - math.log(toxic.sum() / (1 - toxic).sum())
    else:
        w = np.array([{frozenset(): 0.0}.get(frozenset(classes), 40.0 if classes == {1} else -40.0)] + [0.0] * (len(MARGINS) + 1))

    def scored(rows: DataFrame, within: str | None = None) -> DataFrame:
        kept = rows.schema.fields if within else rows.schema.fields[:-1]
        out = rows.mapInArrow(_featured(model, within), StructType([*kept, StructField("x", ArrayType(DoubleType()))]))
        terms = (F.lit(float(k)) * F.get("x", i) for i, k in enumerate(w[1:]))
        return out.withColumn("score", 1 / (1 + F.exp(-sum(terms, F.lit(float(w[0])))))).drop("x")

    return scored


def score(docs: DataFrame, labels: DataFrame, sample: tuple[int, int] = SAMPLE) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score (0 to 1), predicted."""
    out = _scorer(docs, labels, sample)(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)).alias("held_out")
    return out.select("doc_id", held_out, "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def keep_ordinary(docs: DataFrame, labels: DataFrame, sample: tuple[int, int] = SAMPLE) -> DataFrame:
    """``docs`` without the rows that are predicted toxic; every row is judged by its own text, without doc_id too."""
    rows = docs.select(F.struct(*(F.col(c) for c in docs.columns)).alias("row"))
    return _scorer(docs, labels, sample)(rows, "text").where("score < 0.5").select("row.*")
