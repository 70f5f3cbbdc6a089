import pytest
from pyspark.sql import SparkSession

#: For many small queries: no code is compiled for each of them, and stages aren't planned anew.
QUICK = {
    "spark.sql.shuffle.partitions": "2",
    "spark.default.parallelism": "4",
    "spark.sql.codegen.wholeStage": "false",
    "spark.sql.codegen.factoryMode": "NO_CODEGEN",
    "spark.sql.adaptive.enabled": "false",
    "spark.ui.enabled": "false",
    "spark.driver.memory": "4g",
    "spark.driver.extraJavaOptions": "-XX:TieredStopAtLevel=1 -XX:+UseSerialGC",
}


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config(map=QUICK)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
