"""Quality classifier by co-training of two views.

One view is the text (hashed words, coarse shape features, and how many words it holds that stand
mostly in documents labelled toxic), the other the page's metadata (source, language, length). Each view has its own logistic model. Training starts from a bounded
sample of labelled documents: the ``MAX_LABELLED`` with the least hash of doc_id, a quarter
of them (by another part of that hash) held out for calibration. In each round both models score all documents; for
each view and class the ``EXCHANGE`` most confident unlabelled documents, one of each
equal text, become pseudo-labelled examples of the other view. At the end each view is
calibrated on the held-out rows, the views are combined by a logistic model of their
calibrated scores, and all documents are scored.

Only fixed numbers of rows reach the driver: the sample and the exchanged documents, as
sparse features of at most ``BUCKETS`` numbers a row whatever the text's length, and the ``TELLING`` most telling words.

Cases: a null or empty text has no words and is judged by what is left; null metadata is
a value like any other; texts of any length are read whole, in time linear in it; columns
but doc_id, text, source, lang, n_chars (and doc_id, quality, toxic of the labels) are not read; rows that
repeat a doc_id are scored each, and the one with the least text hash (then the least
text and metadata) can be an example; ties between documents equally sure go by a hash of doc_id; labels with a null are not used; without labels of both classes all
scores are the share of good labels, or 0.5; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.session_tools import ready, stage
from tidepool.llm.textops import ALNUM, LOWER, SPACED, mix, rows_of, signed, slices, spans, text_bytes, word_hashes

#: Bound of the labelled sample, exchanged rows for each view, class and round, and rounds.
MAX_LABELLED = 6000
EXCHANGE = 200
ROUNDS = 2
BUCKETS = 1 << 12
SHAPE = 11
#: Words that tell a toxic document: at most so many, in at least so many different labelled texts, mostly toxic ones.
TELLING = 4096
TELLING_TEXTS = 4
TELLING_SHARE = 0.6
META = 1 << 8
THRESHOLD = 0.5


def telling_words(docs: DataFrame) -> np.ndarray:
    """Sorted hashes of the words of labelled documents (text, toxic) that stand mostly in toxic ones; equal texts count once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            h, row = plain_words(batch.column(0))
            at = _firsts(h, row)
            who = pa.array(row[at])
            yield pa.RecordBatch.from_arrays([pa.array(signed(h[at])), batch.column(1).take(who), batch.column(2).take(who)], names=["word", "text_hash", "toxic"])

    words = docs.select("text", F.xxhash64("text").alias("text_hash"), F.col("toxic").cast("int").alias("toxic")).mapInArrow(run, "word long, text_hash long, toxic int")
    texts = words.groupBy("word", "text_hash").agg(F.max("toxic").alias("toxic"))
    counts = texts.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("bad"))
    top = counts.where((F.col("n") >= TELLING_TEXTS) & (F.col("bad") >= TELLING_SHARE * F.col("n"))).orderBy(F.desc("bad"), "word").limit(TELLING)
    return np.sort(np.array([r.word for r in top.collect()], dtype=np.int64).view(np.uint64))


def plain_words(column) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-case words without punctuation, and their rows."""
    data, offsets = text_bytes(column)
    data = LOWER[data]
    starts, ends, first = spans(data, offsets, ALNUM)
    return word_hashes(data, starts, ends), rows_of(first, len(starts))


def told(column, telling: np.ndarray) -> np.ndarray:
    """How many different telling words each row has."""
    h, row = plain_words(column)
    if not len(telling) or not len(h):
        return np.zeros(len(column))
    hit = telling[np.minimum(np.searchsorted(telling, h), len(telling) - 1)] == h
    h, row = h[hit], row[hit]
    return np.bincount(row[_firsts(h, row)], minlength=len(column)).astype(float)


def text_view(column, telling: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows (row, feature, value) of the text view, and each row's word count."""
    data, offsets = text_bytes(column)
    rows = len(offsets) - 1
    starts, ends, first = spans(data, offsets, SPACED)
    row, n = rows_of(first, len(starts)), np.diff(first)
    h = word_hashes(LOWER[data], starts, ends)
    key = row * BUCKETS + (h >> np.uint64(52)).astype(np.int64)
    cell, count = np.unique(key, return_counts=True)
    value = np.log1p(count)
    norm = np.sqrt(np.bincount(cell // BUCKETS, value ** 2, minlength=rows))
    value = value / np.maximum(norm[cell // BUCKETS], 1e-9)
    # Shape: shares of sorts of bytes, of repeated words and of short words.
    size = np.maximum(np.diff(offsets), 1)
    owner = np.repeat(np.arange(rows), np.diff(offsets))
    sorts = [(data >= 97) & (data < 123), (data >= 65) & (data < 91), (data >= 48) & (data < 58), data >= 128, data == 10,
             np.isin(data, np.frombuffer(b"#*$%&|<>", np.uint8)), np.isin(data, np.frombuffer(b".,;:!?", np.uint8))]
    shape = [np.bincount(owner[s], minlength=rows) / size for s in sorts]
    distinct = np.bincount(row[_firsts(h, row)], minlength=rows)
    shape += [distinct / np.maximum(n, 1), np.minimum(np.bincount(row, ends - starts, minlength=rows) / np.maximum(n, 1) / 12, 2.0),
              np.minimum(np.log1p(n) / 10, 1.0), np.minimum(told(column, telling), 4.0) / 2]
    shape = np.column_stack(shape)
    r = np.concatenate([cell // BUCKETS, np.repeat(np.arange(rows), SHAPE)])
    f = np.concatenate([cell % BUCKETS, np.tile(BUCKETS + np.arange(SHAPE), rows)])
    return r, f, np.concatenate([value, shape.ravel()]), n


def _firsts(h: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The first place of each distinct word of each row."""
    return np.unique(h + mix(row.astype(np.uint64) + np.uint64(1)), return_index=True)[1]


def meta_view(source, lang, n_chars) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows of the metadata view: hashed source and language, and steps of the length."""
    rows = len(source)
    parts = []
    for tag, column in (("s=", source), ("l=", lang)):
        data, offsets = text_bytes(pa.array([f"{tag}{x}" for x in column.to_pylist()], pa.string()))
        parts.append((word_hashes(data, offsets[:-1], offsets[1:]) % np.uint64(META)).astype(np.int64))
    size = np.array([x or 0 for x in n_chars.to_pylist()], dtype=np.float64)
    parts.append(META + np.minimum(np.log2(1 + np.maximum(size, 0)), 31).astype(np.int64))
    return np.tile(np.arange(rows), 3), np.concatenate(parts), np.ones(3 * rows)


SIZES = (BUCKETS + SHAPE, META + 32)


class Model:
    """Logistic regression by full-batch gradient steps with momentum; the same data give the same weights."""

    def __init__(self, size: int):
        self.w, self.b = np.zeros(size), 0.0

    def margin(self, r, f, v, rows: int) -> np.ndarray:
        return np.bincount(r, v * self.w[f], minlength=rows) + self.b

    def fit(self, r, f, v, y, steps: int = 200, rate: float = 4.0, decay: float = 1e-4) -> Model:
        rows = len(y)
        weight = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))  # classes count alike
        m, mb = np.zeros_like(self.w), 0.0
        for _ in range(steps):
            g = (sigmoid(self.margin(r, f, v, rows)) - y) * weight
            m = 0.9 * m + np.bincount(f, v * g[r], minlength=len(self.w)) + decay * self.w
            mb = 0.9 * mb + g.sum()
            self.w -= rate * m
            self.b -= rate * mb
        return self


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def calibration(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve through held-out margins, with smoothed targets."""
    good, bad = y.sum(), (1 - y).sum()
    target = np.where(y > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    a, b = 1.0, 0.0
    for _ in range(300):
        d = sigmoid(a * margin + b) - target
        scale = 1 / max(len(y), 1)
        a, b = max(a - 0.1 * float((d * margin).sum()) * scale, 0.01), b - 0.5 * float(d.sum()) * scale
    return a, b


FEATURES = "doc_id long, y double, tr array<int>, tv array<double>, mr array<int>, mv array<double>"


def featured(docs: DataFrame, telling: np.ndarray) -> DataFrame:
    """Sparse features of both views of documents with a label y."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows, lists = batch.num_rows, []
            r, f, v, _ = text_view(batch.column(1), telling)
            for rr, ff, vv in ((r, f, v), meta_view(*batch.columns[2:5])):
                order = np.argsort(rr, kind="stable")
                at = pa.array(np.concatenate([[0], np.cumsum(np.bincount(rr, minlength=rows))]), pa.int32())
                lists += [pa.ListArray.from_arrays(at, pa.array(ff[order], pa.int32())), pa.ListArray.from_arrays(at, pa.array(vv[order]))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(5), *lists], names=["doc_id", "y", "tr", "tv", "mr", "mv"])

    return docs.select("doc_id", "text", "source", "lang", "n_chars", F.col("y").cast("double").alias("y")).mapInArrow(run, FEATURES)


class Examples:
    """Collected training rows of both views."""

    def __init__(self, rows: list):
        self.ids, self.y = [r.doc_id for r in rows], np.array([r.y for r in rows], dtype=np.float64)
        self.views = []
        for a, b in (("tr", "tv"), ("mr", "mv")):
            n = [len(r[a]) for r in rows]
            self.views.append((np.repeat(np.arange(len(rows)), n), np.array([x for r in rows for x in r[a]], dtype=np.int64),
                               np.array([x for r in rows for x in r[b]], dtype=np.float64)))

    def chosen(self, view: int, mask: np.ndarray):
        r, f, v = self.views[view]
        use = mask[r]
        return (np.cumsum(mask) - 1)[r[use]], f[use], v[use]


def scored(docs: DataFrame, models: list[Model], curves, blend, telling: np.ndarray, hashed: bool = False) -> DataFrame:
    """doc_id, text_score, meta_score, score of every document, and the hash of its text if asked for."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            r, f, v, _ = text_view(batch.column(1), telling)
            margins = [models[0].margin(r, f, v, batch.num_rows), models[1].margin(*meta_view(*batch.columns[2:5]), batch.num_rows)]
            z = [a * m + b for m, (a, b) in zip(margins, curves, strict=True)]
            score = sigmoid(blend[0] * z[0] + blend[1] * z[1] + blend[2])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(np.round(x, 9)) for x in (sigmoid(z[0]), sigmoid(z[1]), score)), *batch.columns[5:]],
                names=["doc_id", "text_score", "meta_score", "score", *batch.schema.names[5:]])

    extra = [F.xxhash64("text").alias("text_hash")] if hashed else []
    return docs.select("doc_id", "text", "source", "lang", "n_chars", *extra).mapInArrow(
        run, "doc_id long, text_score double, meta_score double, score double" + ", text_hash long" * hashed)


def confident(scores: DataFrame, column: str, y: float, n: int) -> DataFrame:
    """doc_id, text_hash of the n rows surest of class y by one view, one row of each equal text and of each doc_id."""
    sure = -F.col(column) if y else F.col(column)
    order = F.struct(sure.alias("sure"), F.xxhash64("doc_id").alias("h"), "doc_id", "text_hash")
    # The surest row of an id, and of a text the surest of those; both aggregates are combined before the shuffle.
    rows = scores.groupBy("doc_id").agg(F.min(order).alias("o")).select("o.*")
    rows = rows.groupBy("text_hash").agg(F.min(F.struct("sure", "h", "doc_id", "text_hash")).alias("o")).select("o.*")
    return rows.orderBy("sure", "h", "doc_id").limit(n).select("doc_id", "text_hash")


def one_row(docs: DataFrame, *key: str) -> DataFrame:
    """One row for each value of the key: the one with the least text hash, then the least of all columns."""
    rest = [c for c in docs.columns if c not in key]
    least = F.min(F.struct(F.xxhash64("text").alias("_hash"), *rest)).alias("least")
    return docs.groupBy(*key).agg(least).select(*key, *[F.col(f"least.{c}").alias(c) for c in rest])


def classify(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, exchange: int = EXCHANGE, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, text_score, meta_score, score, label (1 good), kept, of every document.

    A document is good if its label says quality and not toxic.
    """
    ready(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("source").cast("string"),
                       F.col("lang").cast("string"), F.col("n_chars").cast("long"))
    good = ((F.col("quality") > 0) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)).cast("int")
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.min(good).alias("y"), F.max((F.coalesce(F.col("toxic"), F.lit(0)) > 0).cast("int")).alias("toxic"))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    sample = stage(one_row(docs.join(F.broadcast(picked), "doc_id"), "doc_id"), "cotraining-sample")  # at most max_labelled
    telling = telling_words(sample.where(F.pmod(F.xxhash64("doc_id"), F.lit(4)) != 3))  # not of documents held out
    rows = featured(sample, telling).collect()
    rows.sort(key=lambda r: r.doc_id)
    data = Examples(rows)
    n = len(rows)
    if not n or data.y.min() == data.y.max():
        share = F.lit(float(data.y.mean()) if n else 0.5)
        return docs.select("doc_id", *(share.alias(c) for c in ("text_score", "meta_score", "score")),
                           (share >= THRESHOLD).cast("int").alias("label"), (share >= THRESHOLD).alias("kept"))
    held_ids = {r.doc_id for r in sample.where(F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 3).select("doc_id").collect()}
    held = np.array([i in held_ids for i in data.ids])
    if not held.any() or held.all():
        held = np.array([i % 4 == 3 for i in range(n)])
    gone: set[tuple[int, int]] = set()  # ids and text hashes of exchanged documents
    taught: list[list[Examples]] = [[], []]  # by the view that learns from them

    def fitted(view: int) -> Model:
        parts = [(*data.chosen(view, ~held), data.y[~held])] + [(*e.views[view], e.y) for e in taught[view]]
        r, at = [], 0
        for p in parts:
            r.append(p[0] + at)
            at += len(p[3])
        return Model(SIZES[view]).fit(np.concatenate(r), np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts]),
                                      np.concatenate([p[3] for p in parts]))

    models = [fitted(0), fitted(1)]
    for _ in range(rounds):
        margins = [m.margin(*data.views[i], n)[held] for i, m in enumerate(models)]
        curves = [calibration(m, data.y[held]) for m in margins]
        scores = scored(docs, models, curves, (1.0, 1.0, 0.0), telling, hashed=True).where("doc_id is not null").join(known.select(F.col("doc_id").alias("k")), F.col("doc_id") == F.col("k"), "left_anti")
        scores = stage(scores, "cotraining-scores")  # ranked four times, scored once
        for view, column in enumerate(("text_score", "meta_score")):
            # What was exchanged before, and other copies of it, takes no place again.
            left = scores
            if gone:
                for key, values in (("doc_id", {d for d, _ in gone}), ("text_hash", {h for _, h in gone})):
                    table = docs.sparkSession.createDataFrame([(x,) for x in sorted(values)], f"{key} long")
                    left = left.join(F.broadcast(table), key, "left_anti")
            new: dict[tuple[int, int], float] = {}
            for y in (1.0, 0.0):
                top = confident(left, column, y, exchange).collect()  # at most exchange
                both = {x for k in new for x in (("id", k[0]), ("text", k[1]))}  # in small tables a row can stand in both rankings
                new.update({(r.doc_id, r.text_hash): y for r in top if not {("id", r.doc_id), ("text", r.text_hash)} & both})
            if not new:
                continue
            table = docs.sparkSession.createDataFrame([(*k, y) for k, y in sorted(new.items())], "doc_id long, h long, y double")
            picked_docs = docs.withColumn("h", F.xxhash64("text")).join(F.broadcast(table), ["doc_id", "h"])
            rows = featured(one_row(picked_docs, "h"), telling).collect()
            rows.sort(key=lambda r: r.doc_id)
            taught[1 - view].append(Examples(rows))
            gone.update(new)
        models = [fitted(0), fitted(1)]
    margins = [m.margin(*data.views[i], n)[held] for i, m in enumerate(models)]
    y = data.y[held]
    curves = [calibration(m, y) for m in margins]
    z = np.column_stack([a * m + b for m, (a, b) in zip(margins, curves, strict=True)])
    both = Model(2).fit(np.repeat(np.arange(len(y)), 2), np.tile([0, 1], len(y)), z.ravel(), y, steps=300, rate=0.2, decay=1e-3)
    blend = (float(both.w[0]), float(both.w[1]), float(both.b))
    out = scored(docs, models, curves, blend, telling)
    keep = F.col("score") >= THRESHOLD
    return out.select("*", keep.cast("int").alias("label"), keep.alias("kept"))
