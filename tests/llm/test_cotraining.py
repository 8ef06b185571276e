"""Co-training: held-out accuracy and awkward tables."""

from __future__ import annotations

import pytest

from tests.llm import cases
from tidepool.llm import cotraining

pytestmark = pytest.mark.skipif(not cases.HAVE, reason="driver tables not present")


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    teach, test = labels.where("doc_id % 3 != 0"), labels.where("doc_id % 3 = 0")
    got = cotraining.classify(docs, teach, max_labelled=2000).join(test, "doc_id").where("toxic = 0")
    share = {r.quality: r.s for r in got.groupBy("quality").agg({"label": "avg"}).withColumnRenamed("avg(label)", "s").collect()}
    assert share[1] > 0.85 and share[0] < 0.15, share


def test_awkward_tables(spark):
    docs = cases.documents(spark, [*cases.ODD, *cases.ODD[:4], (None, "x y")])
    labels = spark.createDataFrame([(d, d % 2, 0) for d, _ in cases.ODD] + [(None, 1, 0), (3, None, None), (99, 1, None)],
                                   "doc_id long, quality int, toxic int").selectExpr("*", "1 as text", "2 as lang", "3 as score")
    out = cotraining.classify(docs, labels, exchange=3)
    assert out.count() == len(cases.ODD) + 5 and out.where("score is null or score < 0 or score > 1").count() == 0
    assert cases.rows(out, "doc_id", "score") == cases.rows(cotraining.classify(docs, labels, exchange=3), "doc_id", "score")
    one = labels.where("quality = 1")
    assert cotraining.classify(docs, one).where("score != 1").count() == 0
    assert cotraining.classify(docs, labels.limit(0)).where("score != 0.5").count() == 0
    assert cotraining.classify(docs.limit(0), labels).count() == 0


def test_copies_take_one_place(spark, monkeypatch):
    docs, labels = (spark.read.parquet(f"{cases.SF}/{t}.parquet") for t in ("documents", "labels"))
    teach = labels.where("doc_id % 3 = 0")
    text = docs.join(teach.where("quality = 1 and toxic = 0"), "doc_id").first().text
    copies = spark.createDataFrame([(50_000_000 + i, text, "web", "en", len(text)) for i in range(60)],
                                   "doc_id long, text string, source string, lang string, n_chars long")
    docs = docs.select(copies.columns).unionByName(copies).cache()
    seen = []

    class Counted(cotraining.Examples):
        def __init__(self, rows):
            super().__init__(rows)
            seen.append(self.ids)

    monkeypatch.setattr(cotraining, "Examples", Counted)
    cotraining.classify(docs, teach, exchange=20)
    taught = seen[1:]  # the first are the labelled rows
    assert len(taught) == 4 and all(len(ids) == 40 for ids in taught), [len(x) for x in taught]
    every = [d for ids in taught for d in ids]
    assert len(every) == len(set(every)) and sum(d >= 50_000_000 for d in every) <= 1
    docs.unpersist()


def test_held_out_toxic(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    teach, test = labels.where("doc_id % 3 != 0"), labels.where("doc_id % 3 = 0 and toxic = 1")
    got = cotraining.classify(docs, teach, max_labelled=2000).join(test, "doc_id").selectExpr("count(1) n", "avg(label) s").first()
    print("held-out toxic documents:", got.n, "labelled good:", got.s)
    assert got.n > 100 and got.s < 0.15


def test_telling_words(spark):
    """The words that stand mostly in toxic texts, against plain Python."""
    import numpy as np
    import pyarrow as pa

    rows = [*((f"You {w}! x{i} common", 1) for i, w in enumerate(["oaf", "OAF", "Oaf,", "oaf"])), ("oaf common", 0), *((f"nice common y{i}", 0) for i in range(3))]
    rows += [("twice told", 1)] * 9  # equal texts count once
    got = cotraining.telling_words(spark.createDataFrame(rows, "text string, toxic int"))
    word = lambda w: int(cotraining.plain_words(pa.array([w]))[0][0])
    assert got.tolist() == sorted([word("oaf"), word("you")])
    assert cotraining.told(pa.array(["an oaf, an OAF", None, "you oaf", ""]), got).tolist() == [1, 0, 2, 0]
    assert cotraining.told(pa.array(["x"]), np.empty(0, np.uint64)).tolist() == [0]


def test_repeated_ids_do_not_depend_on_the_partitioning(spark):
    docs = cases.documents(spark, [(i % 30, f"text number {i} " * (i % 7 + 1)) for i in range(90)], extra=False)
    labels = spark.createDataFrame([(i, i % 2, int(i % 5 == 0)) for i in range(30)], "doc_id long, quality int, toxic int")
    first = cases.rows(cotraining.classify(docs.repartition(1), labels, exchange=3), "doc_id", "score")
    assert cases.rows(cotraining.classify(docs.repartition(7, "n_chars"), labels, exchange=3), "doc_id", "score") == first
