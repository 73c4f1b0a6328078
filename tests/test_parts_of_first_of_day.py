"""The state of few rows lies in few parts and one store a part, whatever the number of partitions of the session."""

from rillhouse.session import conf_set
from rillhouse.streaming import runners

from .test_oracle import duck, test_oracle as agree  # noqa: F401


def test_state_of_few_rows_lies_in_few_stores(spark, sf, duck, monkeypatch):  # noqa: F811
    made, append = [], runners.append
    monkeypatch.setattr(runners, "append", lambda *a: made.append(append(*a)) or made[-1])
    with conf_set(spark, "spark.sql.shuffle.partitions", 40):
        agree(spark, sf, duck, "stream_first_of_day")
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4"
    operators = made[0].lastProgress["stateOperators"]
    assert [o["numShufflePartitions"] for o in operators] == [spark.sparkContext.defaultParallelism] * 2
    assert all(o["numStateStoreInstances"] == o["numShufflePartitions"] for o in operators)
