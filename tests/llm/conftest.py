import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text) or (doc_id, text, source); parts spreads them over partitions."""

    def make(rows, parts=3, extra=()):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "a", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, DOCS).repartition(parts)
        from pyspark.sql import functions as F

        return df.withColumns({name: F.lit(7) for name in extra}) if extra else df

    return make


#: Nulls, empty and blank texts, ties, repeated rows, special strings, odd white space, a very long text.
ODD = [
    (None, "no id here, but five words"),
    (None, None),
    (1, None),
    (2, ""),
    (3, " \n "),
    (4, "two  spaces\n\n new line\tand tab nbsp sep \x1c fs"),
    (5, "special <|endoftext|> and <|startoftext|> strings<|endoftext|>x"),
    (6, "It's the dog's, isn't it? 'SS ' s 're  've 12345 ½ ①"),
    (7, "é and é; a ́ b ﬁ İ ẞ Σς 日本語のテキスト"),
    (8, "same text here for ties"),
    (8, "same text here for ties"),
    (9, "same text here for ties"),
    (10, "wörd mit ümlaut und mehr davon " * 4000),
    (11, "x" * 50_000),
    (12, "\U0001f600 smile \U0001f600\U0001f600 a\rb\x0bc"),
    (-3, "negative id"),
]


@pytest.fixture(scope="session")
def odd_docs(docs_of):
    return docs_of(ODD, extra=("n_tokens", "score", "fp", "ids", "start", "chunk", "block", "part", "component_id", "mix_epoch", "tokens"))


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
