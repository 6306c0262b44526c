import pytest
from pyspark.sql import types as T

DOCUMENT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                         T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                         T.StructField("n_chars", T.LongType()), T.StructField("class", T.StringType()),
                         T.StructField("shingle", T.StringType()), T.StructField("line", T.StringType())])


@pytest.fixture(scope="session")
def documents(spark):
    """Makes documents of (doc_id, text[, lang[, source]]), with more columns whose names operators use inside."""
    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, r[3] if len(r) > 3 else None, None, "x", "y", "z") for r in rows]
        return spark.createDataFrame(full, DOCUMENT)
    return make


WORDS = ("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega "
         "one two three four five six seven eight nine ten").split()


def words(seed: int, n: int) -> list[str]:
    import random
    rng = random.Random(seed)
    return [rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(n)]


@pytest.fixture(scope="session")
def odd_rows():
    """Null and empty texts, white space, one very long text, ties, repeated rows, a null id."""
    long_text = " ".join(words(1, 30_000))
    same = " ".join(words(2, 120))
    return [(1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, long_text), (6, same), (7, same), (7, same), (None, same), (8, same.upper())]
