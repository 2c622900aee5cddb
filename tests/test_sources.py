import threading

import pytest
from pyspark.sql import functions as F

from vectrail.functions import sql
from vectrail.runtime import cancellable, drop_scratch, materialize, shared_root
from vectrail.sources.textfiles import read_texts


def slow(x):
    import time

    time.sleep(60)
    return x


def test_text_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("﻿one\r\ntwo\n".encode())
    (tmp_path / "b.txt").write_bytes("café".encode("latin-1"))
    assert read_texts(spark, f"file://{tmp_path}/a.txt").first()["text"] == "one\r\ntwo\n"
    assert read_texts(spark, f"file://{tmp_path}/b.txt", "ISO-8859-1").first()["text"] == "café"


def test_sql_functions(spark):
    sql.register(spark)
    row = spark.sql("SELECT vec_cosine(array(3F, 4F), array(4F, 3F)) a, vec_norm(array(3F, 4F)) b, vec_cosine(array(0F), array(1F)) c, count_words(' a b ') d").first()
    assert tuple(row) == (0.96, 5.0, 0.0, 2)


def test_cancellation(spark):
    with cancellable(spark, "slow") as stop:
        timer = threading.Timer(4, stop)
        timer.start()
        with pytest.raises(Exception, match="(?i)cancel"):
            spark.range(4, numPartitions=4).select(F.udf(slow, "long")("id")).collect()
        timer.join()


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        @staticmethod
        def get(*_):
            return None

    class Context:
        master = "spark://host:7077"

        @staticmethod
        def getCheckpointDir():
            return None

    class Session:
        conf, sparkContext = Conf, Context

    with pytest.raises(ValueError, match="checkpoint.dir"):
        shared_root(Session)


def test_scratch(spark):
    assert "://" in shared_root(spark)
    table = materialize(spark.range(5).toDF("x"), "t")
    assert table.count() == 5
    drop_scratch(spark)
    with pytest.raises(Exception):
        spark.read.parquet(table.inputFiles()[0]).count()
