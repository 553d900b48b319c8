import pytest

from switchboard.session import build_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    yield session
    session.stop()


@pytest.fixture
def small_tasks(spark):
    """Every key with more than ten rows counts as heavy, so that salting is exercised."""
    spark.conf.set("spark.switchboard.rowsPerTask", "10")
    yield spark
    spark.conf.unset("spark.switchboard.rowsPerTask")
