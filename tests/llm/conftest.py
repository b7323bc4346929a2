import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path[:0] = [ROOT, os.path.dirname(os.path.abspath(__file__))]

from llm_edge import EDGE  # noqa: E402


SF = "/root/testdata/sf0.001"

@pytest.fixture(scope="session")
def spark():
    os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")
    from tillpoint.session import get_spark

    return get_spark(cpus="*", shuffle_partitions=4, app="tillpoint-llm-tests")


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def rows(docs):
    return docs.select("doc_id", "text").collect()


@pytest.fixture(scope="session")
def edge(spark):
    """Edge rows with columns whose names the operators use themselves."""
    data = [(*r, 1.5, "mine", [3], 7) for r in EDGE]
    return spark.createDataFrame(data, "doc_id bigint, text string, lang string, source string, score double, words string, bands array<int>, key int")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
