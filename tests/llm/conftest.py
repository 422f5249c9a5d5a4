import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def vocab():
    from tandem.llm.queries import vocabulary

    return vocabulary


@pytest.fixture(scope="session")
def rows():
    from cases import make_texts

    return make_texts()


@pytest.fixture(scope="session")
def docs(spark, rows):
    from cases import docs_frame

    return docs_frame(spark, rows).cache()
