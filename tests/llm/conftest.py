import pytest
from brute import prose

#: Columns whose names the operators use themselves.
CLASHING = {"size": "long", "n_words": "long", "score": "double", "blob": "string", "row": "long", "fp": "long", "id": "long", "kept": "boolean", "words": "string", "tie": "long", "copies": "long", "key": "string"}


@pytest.fixture(scope="session")
def messy(spark):
    """Documents with nulls, empty and long texts, ties, repeated rows and clashing columns."""
    shared, line = prose(1, 60), prose(2, 9)
    rows = [
        (1, prose(3, 40) + "\n" + shared + "\n" + prose(4, 30), "en", "b", 5),
        (2, prose(5, 10) + " " + shared, None, "a", None),
        (3, shared, "en", None, 1),
        (4, "", "en", "a", 0),
        (5, None, None, None, None),
        (6, " \t\n ", "en", "b", 4),
        (None, prose(6, 50) + " " + shared, "en", "c", 9),
        (None, None, None, None, None),
        (7, prose(7, 60_000), "en", "a", 1),
        (8, "short text", "en", "b", 10),
        (8, "another text with the id of its neighbour " + shared, "en", "b", 10),
        (9, "tie " * 30, "en", "c", 1),
        (9, "tie " * 30, "en", "c", 1),
        (10, line + "\n" + line + "\n" + prose(8, 30), "de", "", 3),
        (11, "Été deux trois " + prose(9, 20), "fr", "b", 3),
    ]
    rows += [(100 + k, prose(100 + k, 20) + " " + line + "\n" + prose(200 + k, 20), "en", "hot", 1) for k in range(40)]
    rows += [(200 + k, shared + " " + prose(300 + k, 3), "en", "hot", 1) for k in range(20)]
    columns = ", ".join(f"{c} {t}" for c, t in CLASHING.items())
    none = (None,) * len(CLASHING)
    return spark.createDataFrame([r + none for r in rows], f"doc_id long, text string, lang string, source string, n_chars long, {columns}")


@pytest.fixture(scope="session")
def empty(messy):
    return messy.limit(0)
