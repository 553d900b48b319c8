import os
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))

from odd_texts import ODD_TEXTS  # noqa: E402

# Names that the operators use inside; as columns of the input they must not matter.
CLASHING = (
    "key pos line lines row row_id at lead around marks found text_id node signature root label "
    "doc chunk word n kind start end token score held_out __held_out its_id its_text dropped "
    "labelled_id leaks component_id kept plant h1 form output cut runs collapsed"
).split()


@pytest.fixture
def documents(spark):
    """A table of documents from (doc_id, text) pairs, with columns of clashing names."""

    def make(pairs):
        docs = spark.createDataFrame(list(pairs), "doc_id long, text string").repartition(3)
        return docs.withColumns({name: F.lit(7) for name in CLASHING})

    return make


@pytest.fixture
def odd_documents(documents):
    return documents(ODD_TEXTS)
