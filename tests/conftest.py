import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    conf = {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "6g", "spark.ui.showConsoleProgress": "false"}
    s = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def modern(spark):
    """Six vertices and six edges, in this order."""
    from quiverflow.graph import PropertyGraph

    v = [("1", "PERSON", "marko", 29, None), ("2", "PERSON", "vadas", 27, None), ("4", "PERSON", "josh", 32, None), ("6", "PERSON", "peter", 35, None), ("3", "SOFTWARE", "lop", None, "java"), ("5", "SOFTWARE", "ripple", None, "java")]
    e = [("7", "1", "2", "KNOWS", 0.5), ("8", "1", "4", "KNOWS", 1.0), ("9", "1", "3", "CREATED", 0.4), ("10", "4", "5", "CREATED", 1.0), ("11", "4", "3", "CREATED", 0.4), ("12", "6", "3", "CREATED", 0.2)]
    vs = spark.createDataFrame([(i, k, [lab], n, a, lang) for k, (i, lab, n, a, lang) in enumerate(v)], "id string, seq long, labels array<string>, name string, age long, lang string")
    es = spark.createDataFrame([(i, k, s, d, [lab], w) for k, (i, s, d, lab, w) in enumerate(e)], "id string, seq long, src string, dst string, labels array<string>, weight double")
    return PropertyGraph.of(vs.coalesce(1).cache(), es.coalesce(1).cache())
