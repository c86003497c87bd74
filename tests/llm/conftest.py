import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Documents from texts (or (text, source) pairs), ids from 0."""
    def make(texts, first=0):
        rows = [(t if isinstance(t, tuple) else (t, "s")) for t in texts]
        return spark.createDataFrame([(first + i, t, "en", s, None if t is None else len(t)) for i, (t, s) in enumerate(rows)], SCHEMA)

    return make
