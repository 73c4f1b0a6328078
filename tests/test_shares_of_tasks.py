"""What a task takes of a shuffle or of files is bounded where the session does not say it."""

from rillhouse import session
from rillhouse.plans import fixtures as fx


def test_shares_are_small_unless_given(spark, sf):
    advisory, files = "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.files.maxPartitionBytes"
    new = spark.newSession()
    new.conf.set(files, "5m")
    fx.table(new, sf, "orders")
    assert int(new.conf.get(advisory).removesuffix("b")) == session.TASK_BYTES <= 16 * 2**20
    assert new.conf.get(files) == "5m"
    other = spark.newSession()
    fx.table(other, sf, "orders")
    assert int(other.conf.get(files).removesuffix("b")) == session.TASK_BYTES
