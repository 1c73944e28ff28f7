import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def odd(spark):
    from fixtures import odd_documents

    return odd_documents(spark)


@pytest.fixture(scope="session")
def odd_dir(spark, odd, tmp_path_factory):
    """A data folder whose documents are the odd rows and those of the small tables."""
    top = tmp_path_factory.mktemp("odd")
    for name in os.listdir(SMALL):
        if name != "documents.parquet":
            (top / name).symlink_to(f"{SMALL}/{name}")
    told = spark.read.parquet(f"{SMALL}/documents.parquet")
    odd.unionByName(told, allowMissingColumns=True).coalesce(1).write.parquet(str(top / "made"))
    next((top / "made").glob("*.parquet")).rename(top / "documents.parquet")
    return str(top)
