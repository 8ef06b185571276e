"""BPE, quality rules and decontamination against plain Python."""

from __future__ import annotations

import pytest

from tests.llm import brute, cases
from tidepool.llm import bpe, decontaminate, quality_rules

pytestmark = pytest.mark.skipif(not cases.HAVE, reason="driver tables not present")


@pytest.fixture(scope="module")
def docs(spark):
    return cases.sample(spark)


@pytest.fixture(scope="module")
def pairs(docs):
    return [tuple(r) for r in docs.select("doc_id", "text").collect()]


def test_bpe_equals_library(docs, pairs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_vocabulary())
    want = []
    for d, text in pairs:
        ids = t.encode(text or "", add_special_tokens=False).ids
        want.append((d, len(ids), brute.sha(",".join(map(str, ids))), brute.sha(t.decode(ids, skip_special_tokens=False))))
    assert cases.rows(bpe.digests(docs), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == cases.ordered(want)


def test_bpe_round_trip(docs):
    assert not bpe.encode(docs).join(docs.select("doc_id", "text"), "doc_id").where("decoded != coalesce(text, '')").head(1)


def test_bpe_of_any_characters():
    from hypothesis import given, settings
    from hypothesis import strategies as st
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(bpe.default_vocabulary()), bpe.load(bpe.default_vocabulary())

    @settings(max_examples=300, deadline=None)
    @given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=30))
    def same(text):
        text = text + "'s" + text
        assert own.encode(text) == library.encode(text, add_special_tokens=False).ids

    same()


def test_quality_base(docs, pairs):
    got = cases.rows(quality_rules.judge(docs), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                     "n_repeat_words", "base_failed")
    assert got == cases.ordered([(d, *brute.quality_base(t)) for d, t in pairs])


def test_quality_keeps_good_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    judged = quality_rules.judge(docs).where("not base_failed").join(labels, "doc_id")
    share = {r.quality: r.share for r in judged.groupBy("quality").agg({"kept": "count"}).withColumnRenamed("count(kept)", "n")
             .join(judged.where("kept").groupBy("quality").count(), "quality").selectExpr("quality", "count / n as share").collect()}
    assert share[1] > 0.99 and share.get(0, 0) < 0.35


def test_decontaminate(spark, docs, pairs):
    items = [tuple(r) for r in spark.read.parquet(f"{cases.SF}/benchmark.parquet").select("item_id", "text").collect()]
    items += [(900, "One, two three!"), (901, "same"), (902, None), (903, ""), (None, cases.PASSAGE[40:160]),
              (900, "one two three"), (904, cases.PASSAGE.upper())]
    benchmark = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'x' as doc_id", "1 as n_words")
    want = cases.ordered(brute.decontaminate(pairs, items))
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert cases.rows(decontaminate.judge(docs, benchmark), *columns) == want
    assert cases.rows(decontaminate.judge(docs, benchmark, block_words=40), *columns) == want  # many blocks


def test_longest_match(spark):
    docs = spark.createDataFrame([(1, "zero " + cases.PASSAGE + " end")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "other " + " ".join(cases.PASSAGE.split()[3:40]) + " other")], "item_id long, text string")
    assert [tuple(m) for m in decontaminate.matches(docs, items).first().matches] == [("7", 1, 4, 37)]


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert bpe.digests(docs).count() == quality_rules.judge(docs).count() == decontaminate.judge(docs, items).count() == 0
    some = cases.documents(spark)
    assert decontaminate.judge(some, items).where("contaminated").count() == 0


def test_clashing_columns_and_repeats(spark):
    rows = [*cases.ODD, *cases.ODD[:5], (None, cases.PASSAGE)]
    docs = cases.documents(spark, rows)
    assert bpe.digests(docs).count() == quality_rules.judge(docs).count() == len(rows)
    assert decontaminate.judge(docs, docs.selectExpr("doc_id as item_id", "text")).count() == len(rows)


def test_quality_of_other_languages(spark):
    latin = [" ".join(f"pal{chr(97 + j // 26)}vra{chr(97 + j % 26)}{chr(97 + i % 26)}" for j in range(150)) for i in range(30)]
    cyrillic = [" ".join(f"сло{chr(0x430 + j // 32)}во{chr(0x430 + j % 32)}{chr(0x430 + i)}" for j in range(150)) for i in range(30)]
    symbols = " ".join(f"#{j}$%&" for j in range(150))
    rows = [(i, t, "pt") for i, t in enumerate(latin)] + [(100 + i, t, "ru") for i, t in enumerate(cyrillic)]
    rows += [(200 + i, t, None) for i, t in enumerate([*latin, *cyrillic])] + [(300, latin[0], "xx"), (301, cyrillic[0], "xx")]
    rows += [(400, symbols, "pt")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in quality_rules.judge(docs).collect()}
    assert [d for d, r in got.items() if not r.kept] == [400]
    assert all((r.class_distance is None) == (d in range(200, 400)) for d, r in got.items())


def test_decontaminate_holds_one_block(spark, docs, pairs, monkeypatch):
    items = [tuple(r) for r in spark.read.parquet(f"{cases.SF}/benchmark.parquet").select("item_id", "text").collect()] + [(None, cases.PASSAGE)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    alive, most, made = set(), [], []
    send = type(spark.sparkContext).broadcast

    def broadcast(context, value):
        sent = send(context, value)
        end = sent.destroy
        sent.destroy = lambda *a: (alive.discard(id(sent)), end(*a))
        alive.add(id(sent))
        made.append(sent)
        most.append(len(alive))
        return sent

    monkeypatch.setattr(type(spark.sparkContext), "broadcast", broadcast)
    got = decontaminate.judge(docs, benchmark, block_words=200)
    left = decontaminate.clean(docs, benchmark, block_words=200)
    want = brute.decontaminate(pairs, items)
    assert len(made) > 4 and max(most) == 1
    assert cases.rows(got, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == cases.ordered(want)
    assert cases.rows(left, "doc_id") == cases.ordered([(r[0],) for r in want if not r[-1]])
