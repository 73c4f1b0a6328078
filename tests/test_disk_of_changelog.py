"""A stored changelog is small, and nothing that was shuffled to make it stays on disk."""

import glob
import time

from rillhouse.plans import fixtures as fx
from rillhouse.sources import topics


def shuffled(spark):
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f.getName() for i in range(found.size()) for f in [found.apply(i)] if f.getName().startswith("shuffle_") and f.getName().endswith(".data")}


def test_shuffles_go_with_the_write(spark, sf, tmp_path):
    raw, before, at = fx.changelog(spark, sf, *fx.KINDS), shuffled(spark), time.time()
    own = lambda: {f for f in shuffled(spark) - before}
    topics.store_changelog(raw, str(tmp_path / "stored"))
    # orders are counted when the changelog is described, not stored: what is left is from writing it
    while own() and time.time() - at < 60:
        time.sleep(1)
    assert not own()
    files = glob.glob(f"{tmp_path}/stored/table=*/*.parquet")
    assert files and all(f.endswith(".zstd.parquet") for f in files)
