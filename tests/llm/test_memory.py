import re
import sys
from pathlib import Path

import pytest

from markfield.llm import shared


@pytest.mark.skipif(sys.platform != "linux", reason="memory is read from /proc")
def test_driver_gives_back_freed_native_memory(spark):
    """Blocks freed between others stay with the C library until it is told to return them."""
    jvm = spark.sparkContext._jvm
    pid = jvm.java.lang.ProcessHandle.current().pid()
    held = lambda: int(re.search(r"\nPss_Anon:\s+(\d+)", Path(f"/proc/{pid}/smaps_rollup").read_text())[1]) / 1024
    blocks = [jvm.java.util.zip.Deflater() for _ in range(1200)]
    for x in blocks[:-20]:
        x.end()
    freed = held()
    shared.give_back_driver(spark)
    given = held()
    for x in blocks[-20:]:
        x.end()
    assert given < freed - 20


def test_cuts_give_back_every_few_seconds(spark, monkeypatch):
    given = []
    monkeypatch.setattr(shared, "give_back_driver", given.append)
    monkeypatch.setattr(shared, "_trimmed", [float("-inf")])
    monkeypatch.setattr(shared, "TRIM_S", 60)
    for _ in range(2):
        assert shared.cut(spark.range(3)).count() == 3
    assert given == [spark]
    shared._trimmed[0] -= 60
    shared.cut(spark.range(3))
    assert given == [spark] * 2
