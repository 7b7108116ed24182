"""Results that do not depend on how a table is split, and rows told apart in every read."""

import itertools
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lakeops.llm import common, exact_dedup, mixing, near_dedup, queries, token_files
from lakeops.session import new_work_dir
from tests.llm.conftest import save
from tests.llm.test_operators import SPACES, order, plain_near

DOCUMENTS = "/root/testdata/sf0.01/documents.parquet"


@pytest.fixture
def shifting(spark, monkeypatch):
    """Every stored table changes the split of the reads that follow."""
    splits = itertools.cycle([6, 2, 1, 5, 3])
    real = common.stored

    def stored(df, label):
        done = real(df, label)
        spark.conf.set("spark.sql.files.minPartitionNum", next(splits))
        return done

    for module in (common, exact_dedup, near_dedup, mixing):
        monkeypatch.setattr(module, "stored", stored)
    yield
    spark.conf.unset("spark.sql.files.minPartitionNum")


@pytest.fixture(scope="module")
def docs(spark):
    path = new_work_dir(spark, "split-docs")
    spark.read.parquet(DOCUMENTS).repartition(3, "doc_id").write.option("parquet.block.size", 65536).parquet(path)
    return spark.read.parquet(path)


def test_stages_under_changing_splits(spark, docs, shifting):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    best = {}
    for doc_id, text in rows:
        key = re.sub(f"[{SPACES}]", "", text or "")
        best[key] = min(best.get(key, (0, 1 << 60)), (-len(text or ""), doc_id))
    kept = exact_dedup.keep_first_copies(docs).select("doc_id").collect()
    assert sorted(r.doc_id for r in kept) == sorted(d for _, d in best.values())

    plain = plain_near(rows, 5, 80)
    found = near_dedup.near_duplicates(docs, 5, 80).collect()
    assert order((r.doc_id, r.n_shingles, r.component_id) for r in found) == plain
    kept = near_dedup.keep_one_of_each(docs, 5, 80).select("doc_id").collect()
    assert sorted(r.doc_id for r in kept) == sorted(d for d, _, c in plain if d == c)

    copies = mixing.mixed_copies(docs).filter("copies > 0")
    counted = mixing.mixed(docs).groupBy("doc_id").agg(F.count("*").alias("copies"))
    assert order(map(tuple, copies.select("doc_id", "copies").collect())) == order(map(tuple, counted.collect()))


def test_mixing_does_not_depend_on_files(spark, docs, edges):
    for frame in (docs, edges.select("doc_id", "text", "source")):
        found = []
        for files in (1, 4, 7):
            path = new_work_dir(spark, "mix-files")
            frame.repartition(files).write.parquet(path)
            copies = mixing.mixed_copies(spark.read.parquet(path)).drop("key")
            found.append(order(map(tuple, copies.collect())))
        assert found[0] == found[1] == found[2]


def test_keyed_rows(spark, edges, edge_rows):
    tables = {
        "files": edges.select("doc_id", "text"),
        "union": edges.select("doc_id").unionByName(edges.select("doc_id")),
        "repeated": edges.select("doc_id", F.explode(F.array(F.lit(1), F.lit(2)))),
        "made": spark.range(5).withColumn("_metadata", F.lit(1)).withColumn("row_file", F.lit(2)),
    }
    for name, frame in tables.items():
        rows, keys = common.keyed(frame)
        assert rows.columns == [*frame.columns, *keys], name
        assert rows.select(*keys).distinct().count() == frame.count() == rows.count()
        assert order(map(repr, rows.drop(*keys).collect())) == order(map(repr, frame.collect()))


CLASHING = (
    "doc_id long, text string, source string, lang string, n_chars long, __key long, __row long, "
    "__text string, row_file long, row_place string, times int, text_filled string, file long, place int"
)


def clashing(spark, rows):
    return save(spark, [(*r, "x", 1, 10 + i, 20 + i, f"t{i}", 30 + i, f"p{i}", i, "f", 40, i) for i, r in enumerate(rows)], CLASHING)


def test_stages_keep_clashing_columns(spark, tmp_path):
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(1, text, "a"), (2, text + " ", "a"), (3, text.replace("word7 ", "w "), None), (4, None, "b"), (4, None, "b"), (None, "", None)]
    docs = clashing(spark, rows)
    whole = {r.__getitem__("place"): tuple(r) for r in docs.collect()}
    labels = spark.createDataFrame([(1, 0, 1), (2, 0, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:4]:
        kept = stage(spark, docs, str(tmp_path))
        assert kept.columns == docs.columns, name
        for r in kept.collect():
            assert tuple(r) == whole[r["place"]], name
    nothing = clashing(spark, [])
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, str(tmp_path)).count() == 0, name


def test_repeated_doc_ids_are_counted_once_each(spark, tmp_path):
    rows = [(50, "same text here", "a", "en", 1)] * 2 + [(51, "same text here", "a", "en", 1), (100, "other words", "a", "en", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long").write.parquet(
        f"{tmp_path}/documents.parquet"
    )
    found = queries.op6_simhash(spark, str(tmp_path)).collect()
    assert order((r.doc_id, r.n_near) for r in found) == order([(50, 2), (50, 2), (51, None), (100, 0)])


def test_words_outlive_a_generation(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(token_files, "REMEMBERED", 40)
    encoder = token_files.Encoder(token_files.default_tokenizer())
    texts = [f"the word{i % 13} a.b, Ende{i % 29}. naïve{i} {'x' * (i % 5)},y ...a 日本 of the" for i in range(120)]
    for at in range(0, 120, 10):
        ids, sizes = encoder.texts(pa.array(texts[at : at + 10]))
        plain = [encoder._ids(t) + [token_files.END_ID] for t in texts[at : at + 10]]
        assert ids.tolist() == [i for p in plain for i in p] and sizes.tolist() == [len(p) for p in plain]
    assert encoder.young.begin.n <= 2 * 40
