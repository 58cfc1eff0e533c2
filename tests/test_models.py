import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from alertloom.models import anomaly, classifier, detector as D, vectorise
from alertloom.models.training import train_detector
from alertloom.functions.features import engineer_features
from alertloom.operators import sampling
from alertloom.operators.reports import classification_report
from alertloom.runtime import require_rows
from checks import inputs


def test_planted_outliers(spark, sf):
    vectors = inputs.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    planted = vectors.where("vec_id < 5").select((-F.col("vec_id") - 1).alias("vec_id"), F.transform("e", lambda x: x * 10).alias("e"))
    rows = vectors.unionByName(planted).select("vec_id", array_to_vector("e").alias("features"))
    nodes = anomaly.train_anomaly(rows.where("vec_id >= 0"), ("vec_id",))
    scored = anomaly.score_anomaly(rows, nodes).toPandas()
    far = scored[scored.vec_id < 0]
    assert (far.iforest == -1).all()
    assert far.anomaly_score.min() > scored[scored.vec_id >= 0].anomaly_score.max()


def test_forest_is_repeatable_and_bounded(spark, sf):
    rows = inputs.table(spark, sf, "embeddings").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    grow = lambda df: anomaly.train_anomaly(df, ("vec_id",), trees=10, sample=32).orderBy("tree", "node").toPandas()
    a, b = grow(rows), grow(rows.repartition(5))
    assert a.equals(b) and a.tree.nunique() == 10
    assert (a[a.node == 0]["size"] <= 32).all() and a.depth.max() <= 5
    inner = a[a.feature >= 0]
    assert (inner.left > 0).all() and (inner.right > 0).all()


def test_samples_of_a_larger_table(spark):
    rows = spark.range(0, 200_000).select("id", array_to_vector(F.array(F.col("id") * 1.0)).alias("features"))
    sizes = anomaly.tree_samples(rows, ("id",), 20, 64, 1).groupBy("tree").count().collect()
    assert len(sizes) == 20 and all(r["count"] == 64 for r in sizes)


def test_average_path():
    # 2 H(n-1) - 2 (n-1)/n with the harmonic number written as ln + gamma.
    assert list(anomaly.average_path(np.array([1, 2]))) == [0.0, 1.0]
    assert anomaly.average_path(np.array([256]))[0] == pytest.approx(10.2448, abs=1e-3)


def test_sparse_and_dense_vectors_score_alike(spark):
    from pyspark.ml.linalg import Vectors

    rnd = np.random.default_rng(3)
    data = [(k, Vectors.dense(v)) for k, v in enumerate(rnd.normal(size=(60, 4)) * (rnd.random((60, 4)) > 0.5))]
    dense = spark.createDataFrame(data, ["id", "features"])
    sparse = spark.createDataFrame([(k, Vectors.sparse(4, [(i, x) for i, x in enumerate(v) if x])) for k, v in data], ["id", "features"])
    nodes = anomaly.train_anomaly(dense, ("id",), trees=10)
    same = lambda df: {r["id"]: r["anomaly_score"] for r in anomaly.score_anomaly(df, nodes).collect()}
    assert same(dense) == same(sparse)


def test_both_models_see_what_they_should(spark):
    words = F.repeat(F.lit("hello world "), (F.col("id") % 7 + 1).cast("int"))
    benign = F.concat(words, F.repeat(F.lit("()"), (F.col("id") % 3).cast("int")))
    rows = spark.range(0, 400).select(
        F.col("id").alias("row_id"), (F.col("id") % 2).cast("int").alias("label"),
        F.when(F.col("id") % 2 == 1, F.concat(F.lit("union select "), F.col("id"))).otherwise(benign).alias("message"),
        (F.col("id") % 50).alias("dest_port"),
    )
    detector, report = train_detector(engineer_features(rows, keep=("row_id", "label")), ("row_id",), trees=10, max_depth=5)
    lines = {r["name"]: r for r in report.collect()}
    assert lines["accuracy"]["f1"] == 1.0 and lines["accuracy"]["support"] == 80
    # Far outside of what benign rows look like: the second model raises the alert.
    odd = spark.createDataFrame([(1, 60000, "${jndi:ldap://" + "x{}()'/" * 90 + "}")], "row_id long, dest_port int, message string")
    row = D.score(detector, engineer_features(odd, keep=("row_id",))).first()
    assert row["iforest"] == -1 and row["is_alert"]
    usual = spark.createDataFrame([(1, 24, "hello world hello world ()")], "row_id long, dest_port int, message string")
    assert D.score(detector, engineer_features(usual, keep=("row_id",))).first()["rf"] == 0


def test_no_benign_rows_leave_out_the_second_model(spark):
    rows = spark.range(0, 40).select(
        F.col("id").alias("row_id"), F.lit(1).alias("label"), F.concat(F.lit("word"), F.col("id")).alias("message"), F.lit(1).alias("dest_port")
    )
    detector, _ = train_detector(engineer_features(rows, keep=("row_id", "label")), ("row_id",), trees=2, max_depth=2)
    assert detector.nodes is None
    with pytest.raises(ValueError):
        require_rows(rows.limit(0), "rows")


def test_constant_feature(spark):
    rows = spark.createDataFrame([("ab cd", 80), ("ef gh", 80)], "message string, dest_port int")
    scaled = vectorise.standardise(engineer_features(rows, keep=()))
    assert [r["z_dest_port"] for r in scaled.collect()] == [0.0, 0.0]
    model = vectorise.fit_vectoriser(engineer_features(rows, keep=()))
    sizes = vectorise.vectorised(model, engineer_features(rows, keep=())).select(F.size(vector_to_array("features"))).collect()
    assert {r[0] for r in sizes} == {8}


def test_vocabulary_ties_follow_the_term(spark):
    rows = spark.createDataFrame([("bb aa cc cc x",)], "message string")
    assert [r["term"] for r in vectorise.top_terms(rows, 2).collect()] == ["cc", "aa"]


def test_report_lists_present_classes_only(spark):
    df = spark.createDataFrame([(1, 1), (1, 1)], "label int, prediction int")
    rows = {r["name"]: r for r in classification_report(df).collect()}
    assert set(rows) == {"Malicious", "accuracy", "macro avg", "weighted avg"}
    missed = spark.createDataFrame([(0, 1), (1, 1)], "label int, prediction int")
    assert {r["name"]: r for r in classification_report(missed).collect()}["Benign"]["precision"] == 0.0


def test_split_sizes_of_the_recorded_run(spark):
    counts = spark.createDataFrame([(0, 2_608_069), (1, 3_928_465)], "class int, n long")
    assert {r["class"]: r.quota for r in sampling.split_quotas(counts, 0.2).collect()} == {0: 521_614, 1: 785_693}


def test_rows_without_a_label_are_a_class(spark):
    df = spark.range(0, 100).select(F.col("id").alias("k"), F.when(F.col("id") < 40, F.lit(None)).when(F.col("id") < 90, 1).otherwise(0).cast("int").alias("label"))
    train, test = sampling.stratified_split(df)
    sizes = lambda d: {r.label: r["count"] for r in d.groupBy("label").count().collect()}
    assert sizes(train) == {None: 32, 1: 40, 0: 8} and sizes(test) == {None: 8, 1: 10, 0: 2}
    assert [d.count() for d in sampling.stratified_split(df.limit(0))] == [0, 0]
    assert sampling.stratified_split(df.where("label IS NULL"))[1].count() == 8


def test_ordinals_of_heavy_rows(spark, monkeypatch):
    """Rows that stand very often get their ordinals from a count, in several tasks; nulls and texts with commas are told apart."""
    monkeypatch.setattr(sampling, "COPIES", 100)
    rows = [("a", None)] * 1050 + [("a,b", "x")] * 3 + [("a", "b,x"), (None, "a"), ("n", "1:a"), ("", None), (None, None)]
    keyed = sampling.with_content_keys(spark.createDataFrame(rows, "m string, label string")).collect()
    assert len(keyed) == len(rows) == len({(r._content, r._copy) for r in keyed})
    assert {r._copy for r in keyed if r.m == "a" and r.label is None} == set(range(1, 1051))
    assert len({r._content for r in keyed}) == len(set(rows))


def test_choices_do_not_follow_the_scan(spark, tmp_path):
    """The same rows, read in other pieces, give the same sample, split and forest."""
    rows = spark.range(0, 6000).select(
        F.when(F.col("id") % 3 == 0, "often").otherwise(F.concat(F.lit("m"), F.col("id") % 700)).alias("message"),
        (F.col("id") % 50).alias("dest_port"), F.when(F.col("id") % 11 > 0, F.col("id") % 2).cast("int").alias("label"), F.lit("f").alias("file"),
    )
    rows.repartition(7).write.parquet(str(tmp_path / "t"))

    def choices():
        df = spark.read.parquet(str(tmp_path / "t")).withColumns({"block": F.lit(0), "seq": F.monotonically_increasing_id()})
        sample = sampling.sample_large_files(df, 0.1, threshold=1000)
        train, test = sampling.stratified_split(df)
        keyed = sampling.with_content_keys(df.select("message", "dest_port", "label"))
        vectors = keyed.select(*sampling.CONTENT, array_to_vector(F.array(F.col("dest_port") * 1.0, F.length("message") * 1.0)).alias("features"))
        nodes = anomaly.train_anomaly(vectors, sampling.CONTENT, trees=5, sample=64)
        return [sorted(map(str, d.collect())) for d in (sample, train, test, nodes)]

    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    one = choices()
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        other = choices()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert one == other and len(one[0]) == 600 and len(one[1]) == 4800


def test_split_is_exact_and_disjoint(spark):
    df = spark.range(0, 1003).select(F.col("id").alias("row_id"), (F.col("id") % 10 == 0).cast("int").alias("label"))
    train, test = sampling.stratified_split(df)
    ids = lambda d: {r["row_id"] for r in d.collect()}
    assert ids(train) | ids(test) == set(range(1003)) and not ids(train) & ids(test)
    assert test.count() == 201
    lone = df.withColumn("label", (F.col("row_id") == 5).cast("int"))
    assert sampling.stratified_split(lone)[1].count() == 201


def test_large_file_sample(spark):
    df = spark.range(0, 3000).select(F.col("id").alias("seq"), F.when(F.col("id") < 2010, "big").otherwise("small").alias("file"), F.lit(0).alias("block"))
    kept = {r["file"]: r["count"] for r in sampling.sample_large_files(df, 0.05, threshold=1000).groupBy("file").count().collect()}
    assert kept == {"big": 100, "small": 990}  # 100.5 rounds to the even number


def test_cap(spark):
    df = spark.range(0, 500).withColumnRenamed("id", "k")
    assert sampling.cap_rows(df, 1000, ("k",)).count() == 500
    assert sampling.cap_rows(df, 123, ("k",)).count() == 123
    assert sampling.cap_rows(df, 0, ("k",)).count() == 0
    part = sampling.sample_fraction(df, 0.2, ("k",)).count()
    assert 60 < part < 140


def test_sketched_terms(spark, monkeypatch):
    """A small sketch over a large vocabulary: proven where a few terms stand out, counted in full where none does."""
    monkeypatch.setattr(vectorise, "TRACKED", 400)
    rows = spark.range(0, 20_000).select(F.concat(F.lit("often"), F.col("id") % 7, F.lit(" often9 rare"), F.col("id"), F.lit(" seldom"), F.col("id") % 5000).alias("message"))
    terms = lambda df, n, **o: [(r.term, r.uses, r["rows"]) for r in vectorise.top_terms(df, n, **o).collect()]
    assert vectorise._proven_top_terms(rows, 8, "message") is not None
    assert terms(rows, 8, sketch=True) == terms(rows, 8) and terms(rows, 8)[0] == ("often9", 20_000, 20_000)
    # The ninth term is one of thousands alike, so nothing can be proven.
    assert vectorise._proven_top_terms(rows, 30, "message") is None
    assert terms(rows, 30, sketch=True) == terms(rows, 30)
    few = spark.createDataFrame([("aa bb",), ("aa",), (None,)], "message string")
    assert terms(few, 5, sketch=True) == [("aa", 2, 2), ("bb", 1, 1)] and terms(few.limit(0), 5, sketch=True) == []


def test_the_forest_holds_a_bounded_part_of_the_rows_in_a_task(spark, monkeypatch):
    """What a task keeps for the forest follows the setting and not the size of the files, and each row is dealt once."""
    from pyspark.ml.linalg import Vectors

    from alertloom.models import classifier
    from alertloom.runtime import settle

    table = settle(spark.createDataFrame([(Vectors.dense([float(k % 7), 1.0]), float(k % 2), k) for k in range(5000)], ["features", "label", "_at"]).coalesce(1))
    assert classifier._dealt(table, 10).rdd.getNumPartitions() == table.rdd.getNumPartitions()
    monkeypatch.setattr(classifier, "TASK_BYTES", 112 * 250)
    dealt = classifier._dealt(table, 10)
    sizes = dealt.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert len(sizes) == 20 and sum(sizes) == 5000 and max(sizes) < 500
    assert dealt.rdd.glom().collect() == classifier._dealt(table, 10).rdd.glom().collect()
