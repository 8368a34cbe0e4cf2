"""Label patterns that read each run once against the plain ones, and labels of a megabyte."""

import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from larder.functions.exprs import norm
from larder.operators import labels
from larder.plans import queries

TEXT = st.text("aA1_ \t\n@@..--,(é)%", max_size=24) | st.lists(st.sampled_from(["a", ".com", ".co", ".", "@", "-", " ", "x.org", "é", "_", ".us"]), max_size=10).map("".join)
PLAIN_DOMAIN = r"(?ai)\b[A-Za-z0-9_.-]+\.(?:com|net|org|co|us)\b"


@settings(max_examples=3000, deadline=None)
@given(TEXT)
def test_patterns_equal_plain_ones(text):
    sub = lambda pattern, by: re.sub(pattern, by, text, flags=re.ASCII)
    assert sub(labels.ADDRESS, " ") == sub(r"\S+@\S+\.\S+", " ")
    assert re.sub(labels.DOMAIN, r"\1 ", text, flags=re.ASCII) == re.sub(PLAIN_DOMAIN, " ", text)
    assert re.sub(r"\([^)]*+\)|(\([^)]*+)", r"\1", text) == re.sub(r"\([^)]*\)", "", text)
    assert sub(r"(?<!\d)\d++(?:\.\d++)?+\s*+%", " ") == sub(r"\d+(\.\d+)?\s*%", " ")


def test_norm_of_odd_texts(spark):
    texts = ["a (b) c", "(open", "a (b (c) d", "1.2.3 %", "12 3%", "((x)) y)", "5", "%", "", None, "SALT(1%"]
    want = [re.sub(" +", " ", re.sub(r"[^a-z0-9&'\- ]", " ", re.sub(r"\d+(\.\d+)?\s*%", " ", re.sub(r"\([^)]*\)", " ", (t or "").lower())))).strip() for t in texts]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r[1] for r in rows.select("i", norm(F.col("t"))).orderBy("i").collect()] == want


@pytest.mark.parametrize("dirt", ["a@", "@" + "a" * 9, "a.", "(", "1", "1.", "-", "x.com.", "and "])
def test_time_follows_length(spark, dirt):
    label = "Milk, " + dirt * (1_000_000 // len(dirt)) + " %x.comx (, Salt"
    rows = spark.createDataFrame([(label,)], "t string")
    began = time.time()
    kept = rows.select(labels.ingredient_array(F.col("t")).alias("a")).first()[0]
    assert time.time() - began < 20 and kept[0]["norm"] == "milk"


def test_documents_lose_no_ingredient(spark, tmp_path):
    items = [f"item{i}" for i in range(50_000)]
    spark.createDataFrame([(1, ", ".join(items)), (2, "salt; salt, milk")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = queries.parse_document_labels(spark, str(tmp_path)).orderBy("label_id", "pos").collect()
    assert [tuple(r) for r in rows] == [(1, i, t, t) for i, t in enumerate(items)] + [(2, 0, "salt", "salt"), (2, 1, "milk", "milk")]
    short = spark.createDataFrame([(1, ", ".join(items[:99]))], "product_id long, ingredients_text string")
    assert [labels.parse_labels(short, most=n).count() for n in (5, 99, None)] == [5, 99, 99]
