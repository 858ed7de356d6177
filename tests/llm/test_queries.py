"""The registered queries of the subpackage on the smallest tables, against their SQL where they have it."""

import os

import pytest

import __spark_entry__ as entry
from auditmill.llm import queries
from tools import check_queries

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="tables are not there")


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, name):
    assert name in entry.queries()
    assert check_queries.compare(spark, check_queries.connect(FOLDER), FOLDER, name) is None


def test_held_out_accuracy(spark):
    found = queries.QUERIES["op9_language_mixture"](spark, FOLDER).filter("held_out")
    truth = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang")
    both = found.join(truth, "doc_id")
    assert both.filter("lang = lang_pred").count() >= 0.9 * both.count() > 0
