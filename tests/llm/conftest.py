import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed: int, n: int) -> str:
    import random
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(50)) for _ in range(n))


@pytest.fixture(scope="session")
def tricky(spark):
    """Documents with nulls, empty and very long texts, ties, repeated rows and clashing column names."""
    shared = prose(1, 60)
    rows = [
        (1, prose(2, 80)), (2, prose(2, 80)), (3, prose(2, 78) + " changed end"), (4, shared + " " + prose(3, 40)),
        (5, prose(4, 40) + " " + shared.upper() + " " + shared), (6, None), (7, ""), (8, " \n\t "), (9, "one"),
        (10, "One two"), (11, "one TWO"), (12, "same " * 120), (12, "same " * 120), (13, "a b \x0b c d é"),
        (14, "word " * 300_000), (15, "x" * 1_200_000), (None, prose(2, 80)), (None, None), (-5, prose(6, 34)),
        (-6, prose(6, 34)), (17, prose(7, 35)), (18, prose(7, 35))]
    return spark.createDataFrame(
        [(i, t, "en", "s", len(t or ""), "x", 1, 2.0, "k") for i, t in rows],
        "doc_id long, text string, lang string, source string, n_chars long, key string, n int, score double, "
        "node string")


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def texts(tricky):
    return [(r.doc_id, r.text) for r in tricky.select("doc_id", "text").collect()]
