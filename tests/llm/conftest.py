import os

import pytest
from pyspark.sql import SparkSession

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]").appName("tidemark-llm-tests")
        .config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def sample():
    return "/root/testdata/sf0.001"


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def make_docs(spark):
    def make(rows, extra=False):
        df = spark.createDataFrame([(i, t, None, "s", len(t or "")) for i, t in rows], DOCUMENTS)
        if extra:  # names that operators use inside
            df = df.selectExpr("*", "doc_id as node", "text as after", "1 as part", "'x' as found", "7L as n_tokens", "'k' as text_hash")
        return df

    return make
