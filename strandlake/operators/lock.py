"""One writer at a time, and numbers for transactions."""

from __future__ import annotations

import itertools
from contextlib import contextmanager

from pyarrow import fs as pafs

from ..plans.layout import LayoutError, filesystem
from .swap import recover

LOCK = ".strandlake_write.lock"
_numbers = itertools.count(1)


def next_transaction() -> int:
    return next(_numbers)


@contextmanager
def write_lock(root: str, table: str):
    """Holds the table's lock file, after what a lost writer left behind is put right; a table that doesn't exist yet has none. On stores without exclusive creation it is advisory."""
    store, base = filesystem(root)
    folder = f"{base.rstrip('/')}/{table}"
    if store.get_file_info(folder).type != pafs.FileType.Directory:
        yield
        return
    path = f"{folder}/{LOCK}"
    if isinstance(store, pafs.LocalFileSystem):
        try:
            open(path, "x").close()
        except FileExistsError:
            raise LayoutError(f"table '{table}': another write is in progress ({LOCK} exists)") from None
    else:
        if store.get_file_info(path).type != pafs.FileType.NotFound:
            raise LayoutError(f"table '{table}': another write is in progress ({LOCK} exists)")
        store.open_output_stream(path).close()
    try:
        recover(store, folder)
        yield
    finally:
        if store.get_file_info(path).type == pafs.FileType.File:
            store.delete_file(path)
