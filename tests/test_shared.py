"""Shared folders: what the session or the context names, an own one for a local session only."""

import types

import pytest

from folioscan.sources import shared


def session(master, conf=None, held=None):
    """As much of a session as the rule looks at."""
    option = types.SimpleNamespace(isDefined=lambda: held is not None, get=lambda: held)
    context = types.SimpleNamespace(master=master, applicationId=f"app-{master}", _jsc=types.SimpleNamespace(sc=lambda: types.SimpleNamespace(getCheckpointDir=lambda: option)))
    return types.SimpleNamespace(conf=types.SimpleNamespace(get=lambda key, default: conf or default), sparkContext=context)


def test_where_the_shared_folder_is():
    assert shared.checkpoint_root(session("yarn", "hdfs://x/folder/")) == "hdfs://x/folder"
    assert shared.checkpoint_root(session("yarn", None, "hdfs://x/other/1f-2e")) == "hdfs://x/other"
    assert shared.checkpoint_root(session("local[8]", "file:///a", "file:///b/1")) == "file:///a"
    own = shared.checkpoint_root(session("local[8]"))
    assert own.startswith("file://") and own == shared.checkpoint_root(session("local[8]"))
    with pytest.raises(RuntimeError, match="checkpoint"):
        shared.checkpoint_root(session("spark://host:7077"))


def test_folders_are_fresh(spark):
    assert shared.shared_dir(spark, "x") != shared.shared_dir(spark, "x")
