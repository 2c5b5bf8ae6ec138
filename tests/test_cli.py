"""The command line over tables of a folder."""

import pytest

from skeinflow.cli import run


def test_commands(spark, tmp_path):
    say = lambda *a: run(spark, str(tmp_path), *a)
    assert say("get", "t", "r") == [] and say("count", "t") == ["0"]
    assert say("put", "t", "r", "c", "1") == ["OK"] and say("put", "t", "r", "c", "2") == ["OK"] and say("put", "t", "s", "d", "3") == ["OK"]
    assert say("get", "t", "r") == ["r\tc\t2"] and say("get", "t", "r", "d") == []
    assert say("scan", "t") == ["r\tc\t2", "s\td\t3"] and say("scan", "t", "s") == ["s\td\t3"] and say("scan", "t", "a", "s") == ["r\tc\t2"]
    assert say("count", "t") == ["2"] and say("tables") == ["t"]
    assert say("persist", "t") == ["OK"] and say("persist", "none") == ["no such table"] and say("tables") == ["t*"]
    assert say("scan", "t") == ["r\tc\t2", "s\td\t3"] and spark.read.parquet(str(tmp_path / "t")).count() == 2
    assert say("put", "t", "r", "c", "4") == ["OK"] and say("get", "t", "r") == ["r\tc\t4"] and say("put", "t", "r", "c", "2") == ["OK"]
    assert say("rename", "t", "u") == ["OK"] and say("rename", "t", "v") == ["no such table"] and say("tables") == ["u*"]
    assert say("delete", "u") == ["OK"] and say("delete", "u") == ["no such table"]
    for bad in (("scan", "../x"), ("nothing", "t")):
        with pytest.raises(ValueError):
            say(*bad)
