"""A topic in order of time, taken in several batches: the same facts, and files that are compressed."""

import glob

import pytest

from rillhouse.plans import fixtures as fx

from .test_oracle import duck, test_oracle as agree  # noqa: F401


@pytest.mark.parametrize("name", ["stream_cancel_detail", "stream_ods_payment_window"])
def test_facts_of_several_batches(spark, sf, duck, name, monkeypatch):  # noqa: F811
    monkeypatch.setattr(fx, "BATCH_LINES", 2000)
    made, whole = [], fx.topic_of_files
    monkeypatch.setattr(fx, "topic_of_files", lambda *a: made.append(whole(*a)) or made[-1])
    agree(spark, sf, duck, name)
    files = glob.glob(made[0].removeprefix("file://") + "/part-*")
    assert len(files) > 2 * fx.BATCH_FILES and all(f.endswith(".gz") for f in files)
