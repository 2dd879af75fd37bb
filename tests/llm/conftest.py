import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls in every column, empty and long texts, repeated rows, ties and extra columns whose names
    operators use inside."""
    long_text = " ".join(WORDS[i * 7 % 20] + str(i) for i in range(30000))
    line = "the same long line stands here in many documents"
    rows = [
        (1, "one two three four five six seven", "en", "a", 10, 1),
        (2, "", "en", "a", 0, 2),
        (3, None, None, None, None, None),
        (4, long_text, "de", "b", len(long_text), 4),
        (5, long_text + " more", None, "b", 0, 5),
        (6, f"first\n{line}\nlast", "fr", None, 1, 6),
        (7, f"{line.upper()}  \nover", "fr", "c", 1, 7),
        (8, f"  {line}\n{line}", "fr", "c", 1, 8),
        (9, "ünï çödé 中文 ¿qué?", "es", "c", 1, 9),
        (9, "ünï çödé 中文 ¿qué?", "es", "c", 1, 9),
        (None, "no id at all", "en", "a", 1, 10),
        (11, " \t\n ", "en", "a", 1, 11),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score long"
    df = spark.createDataFrame(rows, schema)
    for name in ("token", "size", "slot", "part", "features", "host", "component", "version"):
        df = df.withColumn(name, df["score"])
    return df


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
