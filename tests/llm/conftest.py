import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long, id string, _t string"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents with clashing extra columns from (doc_id, text[, lang])."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", len(r[1] or ""), "x", "y") for r in rows]
        return spark.createDataFrame(full, DOC)

    return make


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls, empty and long texts, ties and repeated rows."""
    long = " ".join(f"word{i % 977}x{i}" for i in range(40_000))
    return [(1, None), (2, ""), (3, "   \n\n"), (4, "short"), (5, long), (6, long), (6, long), (None, "no id here"), (None, None), (9, "é ü 梦 \U0001f600\n"), (10, "123 456 !!")]
