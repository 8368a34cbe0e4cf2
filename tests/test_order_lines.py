"""Order lines whose labels are equal."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
from larder.operators.labels import parse_labels
from larder.plans import adapters as A
from larder.plans import queries as Q
from tests.conftest import DATA


def test_order_lines_that_share_a_text_are_parsed_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(Q, "parse_labels", lambda labels, *a: seen.append(labels) or parse_labels(labels, *a))
    entry.queries()["classify_order_lines"](spark, DATA)
    texts = seen[0].groupBy("ingredients_text").count()
    assert texts.where("count > 1").isEmpty()
    lines = A.labels_from_lineitem(spark, DATA)
    assert seen[0].agg(F.sum("n_labels"), F.sum("id_sum")).first() == lines.agg(F.count("*"), F.sum("product_id")).first()
    assert texts.count() < lines.count()
