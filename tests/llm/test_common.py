from types import SimpleNamespace

import pytest

from granary.llm.common import shared_dir


def session(master, folder=None):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: folder or default), sparkContext=SimpleNamespace(master=master, setCheckpointDir=lambda d: None))


def test_shared_folder():
    assert shared_dir(session("yarn", "hdfs://x/y/")).startswith("hdfs://x/y/granary-")
    assert shared_dir(session("local[4]")).startswith("file:///")
    for master in ("yarn", "spark://a:7077", "local-cluster[3,2,1000]"):
        with pytest.raises(ValueError, match="share"):
            shared_dir(session(master))
