"""What Python workers keep from one task to the next."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Hashable
from typing import Any


def worker_local(key: Hashable, make: Callable[[], Any]) -> Any:
    """`make()` once per Python worker process and key. Spark reuses workers, so tables and memos outlive a task.

    Task functions travel by value and so have no module of their own on the executors; this one is made there.
    """
    kept = sys.modules.setdefault("glossaframe_worker_local", types.ModuleType("glossaframe_worker_local"))
    if key not in kept.__dict__:
        kept.__dict__[key] = make()
    return kept.__dict__[key]
