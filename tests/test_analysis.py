"""What is computed and written of analysed products."""

import pytest

from larder.operators import score as S
from larder.plans import adapters as A
from larder.plans import queries as Q
from tests.conftest import DATA


def _written(spark, monkeypatch, query):
    seen = {}
    plain = Q.durable
    monkeypatch.setattr(Q, "durable", lambda df, name, *a: seen.setdefault(name, df.columns) and plain(df, name, *a))
    query(spark, DATA)
    return seen


def test_texts_are_told_numbers_in_one_place(spark):
    products = A.products_from_part(spark, DATA)
    for rows, places in ((S.with_nutrition(products), 1), (S.with_amounts(products), 2)):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        # A pattern is checked once a place; the second place reads the quantity of a serving.
        assert plan.count("RLIKE(") == places


def test_nutrition_rows_are_told_numbers_in_one_place(spark):
    plan = Q.eval_nutrition(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    # A filter on the number of rows was inferred, and told each number anew at each mention.
    assert plan.count("RLIKE(") == 1 and "Filter" not in plan


@pytest.mark.parametrize("query", [Q.weekly_trend, Q.today_intake])
def test_amounts_read_no_label(spark, monkeypatch, query):
    def fail(*_):
        raise AssertionError("a label was parsed")

    monkeypatch.setattr(Q, "parse_labels", fail)
    assert set(_written(spark, monkeypatch, query)["amounts"]) == {"product_id", "kcal", "macros"}


@pytest.mark.parametrize("query", [Q.compare_products, Q.compare_nutrition, Q.additives_counted, Q.find_alternatives_for_users, Q.scan_insights, Q.scan_insights_eaten])
def test_analysis_is_written_without_columns_that_nobody_reads(spark, monkeypatch, query):
    written = _written(spark, monkeypatch, query)["analysis"]
    assert not {"ingredients_text", "nutriments", "score_reasons", "macros"} & set(written)


def test_saved_history_of_candidates_is_made_once(spark, monkeypatch):
    written = _written(spark, monkeypatch, Q.compare_candidates)
    assert written["saved"] == ["user_id", "product_id", "rank"]
    assert not {"negatives", "ingredients_text", "nutriments"} & set(written["analysis"])
