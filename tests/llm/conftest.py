import pytest

BASE = (
    "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen "
    "eighteen nineteen twenty alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
)

TEXTS = [
    BASE,
    BASE,
    BASE.upper(),
    BASE + " mu",
    "Totally different words in this short text",
    None,
    "",
    " \t\n ",
    "one",
    "one two",
    "Größe über alles, naïve café 10.5   tail",
    "same line\nsame line\n\nsame line \nother line",
    "##!! $$$ ||| spam & eggs <b>",
    ("word " * 9 + "\n") * 30,
    " ".join(f"w{i % 977}" for i in range(70_000)),
]


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls in every column, empty and long texts, repeated rows, and columns named like results."""
    rows = [(i, t, "en", f"src{i % 3}", len(t or ""), 1.5, "x", i) for i, t in enumerate(TEXTS)]
    rows += [rows[0], rows[4], (None, BASE, None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    names = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, kept string, n_words int"
    return spark.createDataFrame(rows, names).repartition(3)


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.filter("false")


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
