import pytest


@pytest.fixture(scope="session")
def odd(spark):
    """Null and repeated ids, null, empty and blank texts, long ones, exact and near copies, and columns with clashing names."""
    base = "the quick brown fox jumps over the lazy dog and runs away from the big bad wolf in the dark green forest today".split()
    near = base[:-1] + ["tomorrow"]
    long_ = " ".join(f"w{i % 977}x{i % 31}" for i in range(20_000))
    rows = [
        (0, " ".join(base)), (1, " ".join(base)), (2, " ".join(near)), (3, None), (4, ""), (5, " \n\t "), (6, "one"), (6, "one"), (6, "two words"), (None, " ".join(base)),
        (None, None), (7, long_), (8, long_ + " tail"), (9, "Ünïcode ÉÀ straße 中文 text"), (10, "12345 !!! ???"), (11, "one"), (12, "two  words\n"),
    ]
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], "doc_id long, text string, id string, row int, hashes string")


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, id string, row int, hashes string")
