"""Quality and toxicity by co-training of a text view and a metadata view.

Two sparse logistic models, one on words and layout of the text and one on page metadata, are fitted
on a bounded sample of labelled documents. In each round Spark scores all unlabelled documents by
both; the ones that a view is surest of, by rank and in the proportion of the labelled documents, go to
the other view, which keeps them. What is passed on is the view's probability, calibrated on labelled
documents kept back, and it weighs as much as it tells beyond the label's rate, so a view that is never
very sure teaches little and misleads no one. In the end both views are calibrated again, and their log-odds add up to the score. All documents are scored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.llm import words
from parley.session import cut, ship

#: Labelled documents that a fit uses at most, and documents that a view labels for the other in a round.
LABELLED, TAKEN = 6000, 1000
#: Bytes of text of which features are made at once; at most about 27 times as much is held for it.
SLICE = 1 << 18
#: Buckets of the hashed features (a power of two), and rounds.
BUCKETS, ROUNDS = 1 << 18, 3
#: What all passed-on documents may weigh, as a share of the labelled ones: the surest are not a fair sample.
TRUST = 0.1
#: A feature is used if it is in so many sampled documents and its rate differs by so many deviations.
LEAST, DEVIATIONS = 4, 4.0
TARGETS = ("quality", "toxic")

_SHAPE = {"upper": (65, 90), "digit": (48, 57), "blank": (32, 32), "line": (10, 10)}


def _bucket(kind: str, value: object) -> int:
    import zlib

    return zlib.crc32(f"{kind}={value}".encode()) % BUCKETS


def text_features(values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) pairs, each once: words, and layout shares in steps."""
    table = words.Table(values)
    raw = np.frombuffer(table.joined + b"\0", np.uint8)
    sizes = np.maximum(1, np.diff(table.bounds) - 1)
    pairs = [table.doc * BUCKETS + (table.hash >> np.uint64(64 - 18)).astype(np.int64)]
    shares = {name: (raw >= a) & (raw <= b) for name, (a, b) in _SHAPE.items()}
    shares["mark"] = ~words.WORD[raw] & (raw > 32)
    for name, where in shares.items():
        step = np.minimum(31, (np.add.reduceat(where, table.bounds[:-1], dtype=np.int64) * 64) // sizes)
        codes = np.array([_bucket(name, k) for k in range(32)])
        pairs.append(np.arange(len(values)) * BUCKETS + codes[step])
    kinds = np.unique(table.doc * (1 << 40) + (table.hash >> np.uint64(24)).astype(np.int64)) >> 40
    variety = np.minimum(15, np.bincount(kinds, minlength=len(values)) * 16 // np.maximum(1, table.count))
    pairs.append(np.arange(len(values)) * BUCKETS + np.array([_bucket("variety", k) for k in range(17)])[variety])
    both = np.unique(np.concatenate(pairs))
    return both // BUCKETS, both % BUCKETS


def meta_features(lang: list, source: list, n_chars: list) -> tuple[np.ndarray, np.ndarray]:
    rows = [(_bucket("lang", a), _bucket("source", b), _bucket("size", int(c or 0).bit_length())) for a, b, c in zip(lang, source, n_chars, strict=True)]
    return np.repeat(np.arange(len(rows)), 3), np.array(rows, np.int64).reshape(-1)


@dataclass
class View:
    """A sparse logistic model: a weight for each bucket and a bias."""

    weights: np.ndarray
    bias: float

    def logits(self, doc: np.ndarray, bucket: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(doc, self.weights[bucket], minlength=size) + self.bias


@dataclass
class Model:
    """For each target: the two views and the calibration (weights of the views, bias); ``passed`` counts,
    by target and view (0 text, 1 metadata), what that view passed on in each round."""

    views: dict[str, tuple[View, View]] = field(default_factory=dict)
    mix: dict[str, tuple[float, float, float]] = field(default_factory=dict)
    passed: dict[tuple[str, int], list[int]] = field(default_factory=dict)

    def probability(self, target: str, text: tuple, meta: tuple, size: int) -> np.ndarray:
        if target not in self.views:
            return np.full(size, np.nan)
        a, b = (view.logits(*x, size) for view, x in zip(self.views[target], (text, meta), strict=True))
        u, v, w = self.mix[target]
        return 1 / (1 + np.exp(-np.clip(u * a + v * b + w, -30, 30)))


def _fit(doc: np.ndarray, bucket: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, steps: int = 250) -> View:
    """Weighted logistic regression by Adam over the buckets whose rates differ between the classes; ``y``
    may be probabilities."""
    n, ones, size = weight.sum(), (y * weight).sum(), len(y)
    seen, with_one = np.bincount(bucket, weight[doc], minlength=BUCKETS), np.bincount(bucket, (y * weight)[doc], minlength=BUCKETS)
    rate = min(max(ones / n, 1e-3), 1 - 1e-3)
    score = np.abs(with_one - seen * rate) / np.sqrt(np.maximum(seen, 1) * rate * (1 - rate) + 1e-9)
    use = np.flatnonzero((seen >= LEAST) & (score >= DEVIATIONS))
    place = np.full(BUCKETS, -1)
    place[use] = np.arange(len(use))
    at = place[bucket] >= 0
    doc, col = doc[at], place[bucket[at]]
    w, m, v = np.zeros(len(use) + 1), np.zeros(len(use) + 1), np.zeros(len(use) + 1)
    w[-1] = np.log(rate / (1 - rate))
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(doc, w[col], minlength=size) + w[-1], -30, 30)))
        off = (p - y) * weight
        g = np.concatenate((np.bincount(col, off[doc], minlength=len(use)) + ridge * w[:-1], [off.sum()])) / n
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    weights = np.zeros(BUCKETS, np.float64)
    weights[use] = w[:-1]
    return View(weights, float(w[-1]))


def _calibrate(a: np.ndarray, b: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Weights of both views' log-odds by logistic regression with one prior for both (Newton steps)."""
    x = np.stack((a, b, np.ones(len(y))), 1)
    prior = np.array([0.5, 0.5, 0.0])
    w = prior.copy()
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag([0.5, 0.5, 1e-3])
        w -= np.linalg.solve(h, x.T @ (p - y) + np.array([0.5, 0.5, 1e-3]) * (w - prior))
    return float(max(w[0], 0.0)), float(max(w[1], 0.0)), float(w[2])


def _joined(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) pairs of the feature lists of documents."""
    return np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.concatenate([np.empty(0, np.int64), *lists]).astype(np.int64)


META = (("lang", "string"), ("source", "string"), ("n_chars", "long"))


def _meta(docs: DataFrame) -> list[Column]:
    """Metadata under own names; a missing column counts as null."""
    have = set(docs.columns)
    return [(F.col(c) if c in have else F.lit(None)).cast(t).alias(f"_{c}") for c, t in META]


def _features(batch: pa.RecordBatch, text: int, meta: int) -> Iterator[tuple[pa.RecordBatch, tuple, tuple, int]]:
    """Text and metadata pairs of slices of a batch; ``text`` and ``meta`` are places of columns."""
    for rows, values in words.sliced(batch, text, SLICE):
        yield rows, text_features(values), meta_features(*(rows.column(meta + i).to_pylist() for i in range(len(META)))), len(values)


def _gathered(slim: DataFrame, keys: DataFrame) -> pd.DataFrame:
    """Feature lists of the documents with the ids in ``keys`` (``_key`` and what else is known), one
    row of each id; ``keys`` are few."""
    extra = [c for c in keys.columns if c != "_key"]
    rows = slim.join(F.broadcast(keys), F.col("_id") == F.col("_key"))
    one = rows.groupBy("_id").agg(F.min(F.struct("_text", *[f"_{c}" for c, _ in META])).alias("_row"), *[F.first(c).alias(c) for c in extra])
    one = one.select(F.col("_id").cast("string").alias("_id"), "_row.*", *[F.col(c).cast("double").alias(c) for c in extra])
    names = ["_id", *extra, "words", "meta"]

    def gather(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, text, meta, n in _features(batch, 1, 2):
                lists = [pa.array([x.astype(np.int32) for x in np.split(pairs[1], np.searchsorted(pairs[0], np.arange(1, n)))], pa.list_(pa.int32())) for pairs in (text, meta)]
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(c)) for c in names[:-2]] + lists, names)

    schema = ", ".join(["_id string", *(f"{c} double" for c in extra), "words array<int>", "meta array<int>"])
    return one.mapInArrow(gather, schema).toPandas().sort_values("_id", kind="stable", ignore_index=True)


def _sure(own: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scale and shift that make a view's log-odds probabilities, by kept-back labels."""
    u, _, w = _calibrate(own, np.zeros(len(own)), y)
    return u, w


def _known(p: np.ndarray, rate: float) -> np.ndarray:
    """How much of a label a probability tells beyond its rate: 0 nothing, 1 all of it (a share of divergence)."""
    p = np.clip(p, 1e-9, 1 - 1e-9)
    more = p * np.log(p / rate) + (1 - p) * np.log((1 - p) / (1 - rate))
    return more / np.where(p > rate, -np.log(rate), -np.log(1 - rate))


def _weights(p: np.ndarray, rate: float, labelled: int) -> np.ndarray:
    """Weights of passed-on documents: all of them together at most ``TRUST`` of the labelled ones."""
    own = _known(p, rate)
    return own * min(1.0, TRUST * labelled / max(own.sum(), 1e-9))


def _exchange(free: DataFrame, views: dict[str, tuple[View, View]], scales: list[tuple[float, float]], wanted: list[int], turn: int) -> pd.DataFrame:
    """The documents that views pass on, with their feature lists and a column ``p0, p1, ...`` for each slot.

    A slot is a view (target by target, text before metadata) and the label 0 or 1; it takes the
    ``wanted`` documents with the highest calibrated probability of its label, ties by a hash of the
    id. Its column is the probability of 1, null for other documents. A task keeps the best of its own
    documents for each slot, and only those meet in one ranking.
    """
    held = free.sparkSession.sparkContext.broadcast((views, scales))
    marked = free.withColumn("_tie", F.xxhash64("_id", F.lit(turn)))
    schema = T.StructType([free.schema["_id"], *(T.StructField(n, t) for n, t in (("slot", T.IntegerType()), ("p", T.DoubleType()), ("tie", T.LongType())))])

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, scale = held.value
        best: dict[int, tuple[np.ndarray, np.ndarray, pa.Array]] = {}
        for batch in batches:
            for rows, text, meta, n in _features(batch, 1, 2):
                ties = rows.column(rows.num_columns - 1).to_numpy()
                for k, (view, pairs) in enumerate((v, x) for both in own.values() for v, x in zip(both, (text, meta), strict=True)):
                    p = 1 / (1 + np.exp(-np.clip(scale[k][0] * view.logits(*pairs, n) + scale[k][1], -30, 30)))
                    for slot, order in ((2 * k, p), (2 * k + 1, -p)):
                        at = np.lexsort((ties, order))[: wanted[slot]]
                        found = p[at], ties[at], rows.column(0).take(pa.array(at))
                        if slot in best:
                            joined = tuple(np.concatenate((x, y)) for x, y in zip(best[slot][:2], found[:2], strict=True))
                            top = np.lexsort((joined[1], joined[0] if slot % 2 == 0 else -joined[0]))[: wanted[slot]]
                            found = joined[0][top], joined[1][top], pa.concat_arrays([best[slot][2], found[2]]).take(pa.array(top))
                        best[slot] = found
        for slot, (p, ties, ids) in best.items():
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.full(len(p), slot, np.int32)), pa.array(p), pa.array(ties)], schema.names)

    found = cut(marked.mapInArrow(judge, schema))
    sure = F.when(F.col("slot") % 2 == 0, F.col("p")).otherwise(-F.col("p"))
    rank = F.row_number().over(W.partitionBy("slot").orderBy(sure, "tie", "_id"))
    most = F.element_at(F.array(*[F.lit(n) for n in wanted]), F.col("slot") + 1)
    top = found.withColumn("rank", rank).where(F.col("rank") <= most)
    keys = top.groupBy(F.col("_id").alias("_key")).agg(*[F.max(F.when(F.col("slot") == k, F.col("p"))).alias(f"p{k}") for k in range(len(wanted))])
    got = _gathered(free, cut(keys))
    held.destroy()
    return got


def _told(told: pd.DataFrame, k: int, column: str) -> tuple[list[np.ndarray], np.ndarray]:
    """What the ``k``-th view passes on: features for the other view, and probabilities."""
    p = np.concatenate([told[f"p{2 * k + y}"].to_numpy(float) for y in (0, 1)])
    at = np.flatnonzero(~np.isnan(p))
    return [np.asarray(told[column].iloc[i % len(told)]) for i in at], p[at]


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", labelled: int = LABELLED, taken: int = TAKEN, labels_id: str = "doc_id", seed: int = 5, rounds: int = ROUNDS) -> Model:
    """Fit on at most ``labelled`` labelled documents, and on what the views tell each other of all others:
    in each exchange at most ``taken`` documents for a view, and no more than there are for all of them.

    Labelled documents are chosen by a hash of the id, which may be of any type. Rows of ``labels``
    with a null id or null labels are left out; of several for one id the worst counts, and of
    several documents with one id the smallest text. A target with fewer than 20 labels of either kind is not fitted: its
    probability is null and rejects nothing.
    """
    ship(docs.sparkSession)
    marks = labels.select(F.col(f"`{labels_id}`").alias("_key"), "quality", "toxic").where("_key is not null").groupBy("_key").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic")).dropna()
    chosen = cut(marks.orderBy(F.xxhash64("_key"), "_key").limit(labelled))
    slim = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"), *_meta(docs)).where("_id is not null")
    free = slim.join(F.broadcast(chosen.select("_key")), F.col("_id") == F.col("_key"), "left_anti")
    got = _gathered(slim, chosen)
    lists = [[np.asarray(x) for x in got[c]] for c in ("words", "meta")]
    parts: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    for target in TARGETS:
        y = got[target].to_numpy(float)
        if min((y == 1).sum(), (y == 0).sum()) >= 20:
            own = np.random.default_rng(seed).permutation(len(y))
            parts[target] = y, own[len(own) // 4 :], own[: len(own) // 4]
    model, given, gone = Model(), {}, None
    most = min(taken, free.count() // (2 * len(parts) * (rounds - 1))) if parts and rounds > 1 else 0
    for turn in range(rounds if parts else 0):
        scales, wanted = [], []
        for target, (y, train_, held) in parts.items():
            more, rate = [given.setdefault((target, v), ([], np.empty(0))) for v in (0, 1)], float(y[train_].mean())
            model.views[target] = tuple(_fit(*_joined([lists[v][i] for i in train_] + more[v][0]), np.concatenate((y[train_], more[v][1])), np.concatenate((np.ones(len(train_)), _weights(more[v][1], rate, len(train_))))) for v in (0, 1))
            for v in (0, 1):
                scales.append(_sure(model.views[target][v].logits(*_joined([lists[v][i] for i in held]), len(held)), y[held]))
                wanted += [math.ceil(most * share) for share in (1 - rate, rate)]
        if turn + 1 < rounds:
            rest = free if gone is None else free.join(F.broadcast(gone), F.col("_id") == F.col("_gone"), "left_anti")
            told = _exchange(rest, model.views, scales, wanted, turn)
            for k, (target, view) in enumerate((t, v) for t in model.views for v in (0, 1)):
                found, p = _told(told, k, ("words", "meta")[1 - view])
                model.passed.setdefault((target, view), []).append(len(found))
                given[target, 1 - view] = given[target, 1 - view][0] + found, np.concatenate((given[target, 1 - view][1], p))
            fresh = docs.sparkSession.createDataFrame([(x,) for x in told["_id"]], "_gone string").select(F.col("_gone").cast(free.schema["_id"].dataType))
            gone = fresh if gone is None else gone.unionByName(fresh)
    for target, (y, _, held) in parts.items():
        a, b = (model.views[target][v].logits(*_joined([lists[v][i] for i in held]), len(held)) for v in (0, 1))
        model.mix[target] = _calibrate(a, b, y[held])
    return model


def _scored(batch: pa.RecordBatch, model: Model, text_at: int, meta_at: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    for rows, text, meta, n in _features(batch, text_at, meta_at):
        good, bad = (model.probability(t, text, meta, n) for t in TARGETS)
        yield rows, good, bad, ~(good < 0.5) & ~(bad >= 0.5)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: _id, p_quality, p_toxic, accepted.

    Null text counts as empty, null and missing metadata as a value of its own. Every row is scored,
    repeated rows and null ids too; ids may be of any type. An empty table gives an empty result.
    """
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    slim = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"), *_meta(docs))
    schema = T.StructType([slim.schema["_id"], T.StructField("p_quality", T.DoubleType()), T.StructField("p_toxic", T.DoubleType()), T.StructField("accepted", T.BooleanType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, good, bad, fine in _scored(batch, held.value, 1, 2):
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(good, from_pandas=True), pa.array(bad, from_pandas=True), pa.array(fine)], schema.names)

    return slim.mapInArrow(run, schema)


def accept(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The documents that are not rejected, with all their columns, whatever their names.

    A document goes if it is more likely bad than good, or toxic. Edges as in ``score``.
    """
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    names, at = docs.columns, docs.columns.index(text_col)
    wide = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], *_meta(docs))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, _, _, fine in _scored(batch, held.value, at, len(names)):
                yield pa.RecordBatch.from_arrays(rows.columns[: len(names)], names).filter(pa.array(fine))

    return wide.mapInArrow(run, docs.schema)
