import re
from pathlib import Path

import pytest

TABLES = Path("/root/testdata/sf0.001")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text, lower=True):
    found = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return [w.translate(str.maketrans(UPPER, LOWER)) for w in found] if lower else found


@pytest.fixture(scope="session")
def tables():
    if not TABLES.exists():
        pytest.skip("the tables are not there")
    return str(TABLES)


@pytest.fixture
def documents(spark):
    """A documents table of (doc_id, text) pairs, with nulls in the other columns and columns whose names clash."""

    def made(rows):
        schema = (
            "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, features string, "
            "_text string, removed_lines string, component_id long, n string, words string"
        )
        return spark.createDataFrame([(i, t, None, None, None, 9.0, None, "x", None, None, -1, None, "w") for i, t in rows], schema)

    return made
