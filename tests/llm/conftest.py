import pytest

#: Awkward rows for every operator: nulls, blanks, repeats, ties, very long words and texts, other scripts.
TEXTS = [
    "The quick brown fox jumps over the lazy dog and runs away from the very slow bear in the deep dark wood today.",
    "The quick brown fox jumps over the lazy dog and runs away from the very slow bear in the deep dark wood today.",
    "the Quick brown fox jumps over the lazy dog and runs away from the very slow bear in the deep dark wood, today!",
    "",
    None,
    "   \n\t ",
    "one",
    "two words",
    "éàü ß ñ 漢字 テスト 🙂 привет мир",
    "x" * 5000,
    "aa " * 3000,
    "line one here\nline one here\n\nline two # * $ % & | < >\r\nline one here",
    "mail a.b@c-d.example and +1 (555) 010-2345 or 10.0.0.1 then 4111 1111 1111 1111 end",
]


@pytest.fixture(scope="session")
def odd(spark):
    """Rows with a null id, repeated rows, null lang, and an extra column whose name operators use inside."""
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}", None if t is None else len(t), "clash") for i, t in enumerate(TEXTS)]
    rows += [rows[0], (None, TEXTS[0], "de", None, 3, "clash"), (50, TEXTS[0] + " And more.", "de", None, 3, "clash")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, block string").repartition(3)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
