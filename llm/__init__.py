"""Training-data operators.  Nothing outside this folder imports them except the guard in ``__spark_entry__``."""

import ctypes

import pyarrow as _pa
from pyspark import TaskContext as _TaskContext


def _give_memory_back() -> None:
    """In a Python worker, have freed arrays above 1 MB go back to the system at once: workers live on between tasks, and what
    their allocators kept would count against an executor's memory.  The driver is left as it is."""
    _pa.set_memory_pool(_pa.system_memory_pool())
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, 1 << 20)  # M_TRIM_THRESHOLD
    except (OSError, AttributeError):  # another C library has other rules
        pass


if _TaskContext.get() is not None:
    _give_memory_back()
