from pathlib import Path
from types import SimpleNamespace

import pytest

from tessera.lineage import checkpointed, released


def fake(master, folder=None, own=None):
    """A table whose session knows only what checkpointed() asks for."""
    state = SimpleNamespace(folder=own)
    context = SimpleNamespace(
        master=master, applicationId="app-1", getCheckpointDir=lambda: state.folder, setCheckpointDir=lambda x: setattr(state, "folder", x),
        getConf=lambda: SimpleNamespace(get=lambda k, default=None: {"spark.checkpoint.dir": folder}.get(k) or default),
    )
    return SimpleNamespace(sparkSession=SimpleNamespace(sparkContext=context), checkpoint=lambda: state.folder)


def test_the_shared_folder_is_the_setting_s():
    assert checkpointed(fake("spark://x", "/shared/here")) == "/shared/here"
    assert checkpointed(fake("spark://x", "/shared/here", "/set/before")) == "/set/before"
    assert checkpointed(fake("local[4]")) == "/tmp/checkpoints-app-1"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpointed(fake("spark://x"))


def test_a_checkpoint_ends_lineage(spark):
    df = checkpointed(spark.range(10).selectExpr("id * 2 AS x"))
    assert sorted(r.x for r in df.collect()) == list(range(0, 20, 2)) and "Range" not in df._jdf.queryExecution().toString()


def test_released_files_are_gone(spark):
    kept, gone = (checkpointed(spark.range(n)) for n in (10, 20))
    files = [df._jdf.queryExecution().logical().rdd().getCheckpointFile().get().removeprefix("file:") for df in (kept, gone)]
    released(gone)
    released(gone)
    assert [Path(f).exists() for f in files] == [True, False] and kept.count() == 10
