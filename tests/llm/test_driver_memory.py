import os
import re

import pytest

from inkmeter.session import FREE_HEAP, cut, hand_back


def _native_mb(pid):
    """MB of a process's own pages above the Java heap, where malloc's arenas lie."""
    total, counted = 0, False
    with open(f"/proc/{pid}/smaps") as f:
        for line in f:
            if m := re.match(r"([0-9a-f]+)-[0-9a-f]+ \S+ \S+ \S+ (\d+)", line):
                counted = int(m[1], 16) >= 0x7F << 40 and m[2] == "0"
            elif counted and line.startswith("Private_Dirty:"):
                total += int(line.split()[1])
    return total / 1024


@pytest.mark.skipif(not os.path.exists("/proc/self/smaps"), reason="reads /proc")
def test_a_checkpoint_returns_native_memory(spark):
    """Small blocks that are freed below one still in use stay with malloc until somebody asks for them."""
    jvm = spark.sparkContext._jvm
    pid = int(jvm.java.lang.ProcessHandle.current().pid())
    cut(spark.range(10))
    begin = _native_mb(pid)
    made = [jvm.java.util.zip.Deflater() for _ in range(2000)]
    grown = _native_mb(pid)
    assert grown > begin + 100
    for x in made[:-1]:
        x.end()
    assert cut(spark.range(10)).count() == 10
    left = _native_mb(pid)
    made[-1].end()
    assert left < begin + 0.5 * (grown - begin)


def test_the_heap_may_shrink(spark):
    jvm = spark.sparkContext._jvm
    hand_back(spark)
    bean = jvm.java.lang.management.ManagementFactory.getPlatformMXBean(jvm.java.lang.Class.forName("com.sun.management.HotSpotDiagnosticMXBean"))
    assert int(bean.getVMOption("MaxHeapFreeRatio").getValue()) <= FREE_HEAP


def test_a_jvm_without_these_means_goes_on(spark, monkeypatch):
    from py4j.protocol import Py4JError

    from inkmeter import session

    def refuse(*_):
        raise Py4JError("not here")

    monkeypatch.setattr(session, "_trim", refuse)
    monkeypatch.setattr(session, "_bound_free_heap", refuse)
    monkeypatch.setattr(spark.sparkContext, "_inkmeter_heap", False)
    assert cut(spark.range(3)).count() == 3
