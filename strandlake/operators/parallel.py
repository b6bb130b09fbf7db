"""Work by items with markers in a shared folder: what is finished is not done again, what another process holds is left to it.

Within one Spark application samples are a column, and tasks are scheduled by Spark; this is for separate runs over one list, and
for going on after a run that broke off.
"""

from __future__ import annotations

import hashlib
import os
import time
from collections.abc import Callable, Sequence

STALE_SECONDS = 3600


class NothingLeft(RuntimeError):
    """All items are finished or held by others."""


def lock_folder(items: Sequence[str], folder: str = "locks", tag: str = "") -> str:
    """A folder for a list of items: another list, or another tag, has another folder."""
    name = hashlib.md5("\n".join(items).encode()).hexdigest()[:8]
    path = os.path.join(folder, f"{tag}-{name}" if tag else name)
    os.makedirs(path, exist_ok=True)
    return path


def _marker(folder: str, item: str, kind: str) -> str:
    return os.path.join(folder, item.replace("/", "_") + "." + kind)


def _claim(path: str) -> bool:
    try:
        os.close(os.open(path, os.O_CREAT | os.O_EXCL | os.O_WRONLY))
        return True
    except FileExistsError:
        return False


def lock1(items: Sequence[str], folder: str = "locks", tag: str = "", stale: float = STALE_SECONDS) -> str:
    """An item to work on: a free one, else one whose lock is stale, else one that failed. Raises NothingLeft if there is none."""
    where = lock_folder(items, folder, tag)
    left = [x for x in items if not os.path.exists(_marker(where, x, "finished"))]
    for item in left:
        if not os.path.exists(_marker(where, item, "failed")) and _claim(_marker(where, item, "lock")):
            return item
    for item in left:
        lock = _marker(where, item, "lock")
        try:
            old = time.time() - os.path.getmtime(lock) > stale
        except FileNotFoundError:
            continue
        if old:
            os.unlink(lock)
            if _claim(lock):
                return item
    for item in left:
        failed = _marker(where, item, "failed")
        if os.path.exists(failed) and _claim(_marker(where, item, "lock")):
            os.unlink(failed)
            return item
    raise NothingLeft("all items are finished or held by other processes")


def finish(items: Sequence[str], item: str, folder: str = "locks", tag: str = "", failed: bool = False) -> None:
    """Mark an item as finished or failed, and give its lock back."""
    where = lock_folder(items, folder, tag)
    with open(_marker(where, item, "failed" if failed else "finished"), "w", encoding="utf-8"):
        pass
    lock = _marker(where, item, "lock")
    if os.path.exists(lock):
        os.unlink(lock)


def all_finished(items: Sequence[str], folder: str = "locks", tag: str = "") -> bool:
    where = lock_folder(items, folder, tag)
    return all(os.path.exists(_marker(where, x, "finished")) for x in items)


def run_for_all(items: Sequence[str], work: Callable[[str], object], folder: str = "locks", tag: str = "") -> list[str]:
    """Work on items until none is left for this process; returns those done here. An error marks its item as failed and is raised."""
    done: list[str] = []
    while True:
        try:
            item = lock1(items, folder, tag)
        except NothingLeft:
            return done
        try:
            work(item)
        except BaseException:
            finish(items, item, folder, tag, failed=True)
            raise
        finish(items, item, folder, tag)
        done.append(item)
