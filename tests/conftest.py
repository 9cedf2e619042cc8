import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4")
               .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
               .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "4g")
               .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("scratch"))).getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def genome():
    """Two random contigs, the second with a run of A and a tandem repeat."""
    import random
    rng = random.Random(7)
    text = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    return {"one": text(6000), "two": text(800) + "A" * 300 + text(500) + "ACGTTGCATGCA" * 40 + text(900)}
