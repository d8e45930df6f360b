from pathlib import Path
from types import SimpleNamespace

import pytest

from logforge.llm import storage


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "local-cluster[2,1,1024]"])
def test_clusters_need_a_shared_folder(master):
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: None, applicationId="none")
    with pytest.raises(ValueError, match="checkpoint"):
        storage.folder(SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=context))
    named = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: "hdfs:///shared/"), sparkContext=context)
    assert storage.folder(named).startswith("hdfs:///shared/logforge-")


def test_clear_deletes_what_was_saved(spark):
    where = storage.folder(spark)
    kept = storage.save(spark.range(3), where, "ids")
    assert kept.count() == 3 and Path(where.removeprefix("file://")).is_dir()
    storage.clear(spark)
    assert not Path(where.removeprefix("file://")).exists()
