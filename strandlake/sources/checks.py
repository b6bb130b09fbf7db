"""Checks before any work starts: inputs that can be read, outputs that can be written, names and options that exist."""

from __future__ import annotations

import os
from collections.abc import Sequence

from .text import expand, is_local, local_path


def check_output(path: str) -> str:
    """The folder of an output must exist and be writable."""
    if path in ("/dev/stdout", "-") or not is_local(path):
        return path
    folder = os.path.dirname(os.path.abspath(local_path(path)))
    if not os.path.isdir(folder):
        raise FileNotFoundError(f"cannot write {path}: there is no folder {folder}")
    if not os.access(folder, os.W_OK):
        raise PermissionError(f"cannot write {path}: the folder {folder} is not writable")
    return path


def check_input(path: str, search_path: Sequence[str] = ()) -> str:
    """An input, its search path filled in, must exist and be readable."""
    found = expand(path, list(search_path))
    if is_local(found):
        plain = local_path(found)
        if not os.path.exists(plain):
            raise FileNotFoundError(f"there is no file {found}" + (f" (for {path})" if found != path else ""))
        if not os.access(plain, os.R_OK):
            raise PermissionError(f"{found} is not readable")
    return found


def check_inputs(paths: Sequence[str], search_path: Sequence[str] = ()) -> list[str]:
    return [check_input(p, search_path) for p in paths if p]
