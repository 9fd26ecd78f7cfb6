"""Extra columns with names that the operators use inside change nothing."""

from conftest import clash, rows
from pyspark.sql import functions as F
from test_documents import DOCS, documents
from test_neighbours import frame, vectors
from test_scores import KEY, SCORES, data
from test_splits import IDMAP, idmap

from tessitura.llm import cutoffs, mixing, neighbours, packing, splits, topn, toxicity


def test_scores(spark):
    s, k = data(3)
    s, k = spark.createDataFrame(s, SCORES), spark.createDataFrame(k, KEY)
    t = spark.createDataFrame([("a", 0.4)], "source string, keep_fraction double")
    assert rows(cutoffs.cutoff_report(clash(s), clash(k), clash(t))) == rows(cutoffs.cutoff_report(s, k, t))
    assert rows(topn.top_segments(clash(s))) == rows(topn.top_segments(s))


def test_splits(spark):
    df = spark.createDataFrame(idmap(4), IDMAP)
    t = spark.createDataFrame([("train", 0.7), ("test", 0.3)], "split_name string, target_share double")
    assert rows(splits.tied_groups(clash(df))) == rows(splits.tied_groups(df))
    assert rows(splits.GroupedSplits(clash(df), clash(t)).assignment()) == rows(splits.GroupedSplits(df, t).assignment())


def test_vectors(spark):
    df = frame(spark, vectors(300))
    a, b = (neighbours.Neighbours(x, "vec_id", "stat1", 64) for x in (clash(df), df))
    assert rows(a.similar_pairs(0.9).select("vec_a", "vec_b")) == rows(b.similar_pairs(0.9).select("vec_a", "vec_b"))
    assert rows(a.search(F.col("id") == 5).select("neighbour")) == rows(b.search(F.col("id") == 5).select("neighbour"))


def test_documents(spark):
    df = spark.createDataFrame(documents(120), DOCS)
    cont = spark.createDataFrame([("a", 500)], "container string, capacity_tokens int")
    assert rows(packing.pack_documents(clash(df), clash(cont))) == rows(packing.pack_documents(df, cont))
    assert rows(packing.pack_report(packing.pack_documents(df, cont), clash(cont))) == rows(packing.pack_report(packing.pack_documents(df, cont), cont))
    t = spark.createDataFrame([("big", 1.0, 1)], "source string, target_share double, max_repeats int")
    assert rows(mixing.Mixture(clash(df), clash(t)).rows) == rows(mixing.Mixture(df, t).rows)
    lab = spark.createDataFrame([(1, "r", "abusive")], "doc_id long, reviewer string, label string")
    assert rows(toxicity.toxic_documents(clash(df), clash(lab))) == rows(toxicity.toxic_documents(df, lab))
