import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tacit-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


# Shoppers and fruit: a light user, items with one row, ties by name, an empty core at k=3.
BASKETS = {
    "ann": "kiwi lime plum fig",
    "bob": "kiwi lime pear",
    "cy": "plum lime",
    "dee": "date",
    "eve": "plum kiwi quince",
    "gus": "lime kiwi",
}
MOCK = [(user, item) for user, items in BASKETS.items() for item in items.split()]


@pytest.fixture(scope="session")
def mock(spark):
    return spark.createDataFrame(MOCK, "user_id string, business_id string")
