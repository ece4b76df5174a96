"""What the driver takes of memory once it has settled."""

import time

from tidewheel.session import settle


def test_settle_gives_free_heap_back(spark):
    java = spark._jvm.java
    held, gone = ([java.util.ArrayList(java.util.Collections.nCopies(10_000_000, "")) for _ in range(n)] for n in (6, 30))  # 40 MB each at least
    assert len(gone) == 30
    del gone
    settle(spark)
    time.sleep(1)  # the JVM's side of what Python let go is freed meanwhile
    settle(spark)
    heap = java.lang.management.ManagementFactory.getMemoryMXBean().getHeapMemoryUsage()
    assert len(held) == 6 and heap.getUsed() > 200e6
    assert heap.getCommitted() < 2.2 * heap.getUsed()


def test_commands_of_settle_are_there(spark):
    """``settle`` does without them, so they are called here by themselves."""
    from tidewheel.session import FREE_HEAP, _hold_heap, _trim

    _hold_heap(spark)
    kind = spark._jvm.java.lang.Class.forName("com.sun.management.HotSpotDiagnosticMXBean")
    options = spark._jvm.java.lang.management.ManagementFactory.getPlatformMXBean(kind)
    assert int(options.getVMOption("MaxHeapFreeRatio").getValue()) <= FREE_HEAP
    _trim(spark)
