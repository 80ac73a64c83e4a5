"""Directories put in the places of others, so that a failure at any point loses no rows.

A staged directory takes its place after the old one has moved into the transaction's folder, and an old one is deleted only after
all are in place. If a move fails, everything moves back. What a lost driver or a failed way back leaves in the
transaction's folder is moved back by the next writer of the table.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from typing import NamedTuple

from pyarrow import fs as pafs

STAGE, OLD = "_tmp", "_old"


class Move(NamedTuple):
    fresh: str
    #: Below the table's folder: group and partition.
    place: str


def there(store: pafs.FileSystem, path: str) -> bool:
    return store.get_file_info(path).type == pafs.FileType.Directory


def swap(store: pafs.FileSystem, folder: str, stage: str, moves: list[Move]) -> None:
    """stage: the transaction's folder, in which the old directories stay until clear()."""

    def one(move: Move) -> None:
        place, old = f"{folder}/{move.place}", f"{stage}/{OLD}/{move.place}"
        store.create_dir(place.rpartition("/")[0], recursive=True)
        if there(store, place):
            store.create_dir(old.rpartition("/")[0], recursive=True)
            store.move(place, old)
        store.move(move.fresh, place)

    with ThreadPoolExecutor(16) as pool:
        done = [pool.submit(one, m) for m in moves]
    failed = [e for d in done if (e := d.exception())]
    if failed:
        # First what is in place goes back to where it was staged, then the old directories return.
        for move, d in zip(moves, done, strict=True):
            if d.exception() is None:
                store.move(f"{folder}/{move.place}", move.fresh)
        put_back(store, folder, stage)
        raise failed[0]


def put_back(store: pafs.FileSystem, folder: str, stage: str) -> None:
    """Old directories whose places are empty return there."""
    if not there(store, f"{stage}/{OLD}"):
        return
    found = store.get_file_info(pafs.FileSelector(f"{stage}/{OLD}", recursive=True))
    for i in found:
        if i.type == pafs.FileType.Directory and "=" in i.base_name:
            place = f"{folder}/{i.path[i.path.index(f'/{OLD}/') + len(OLD) + 2 :]}"
            if not there(store, place):
                store.create_dir(place.rpartition("/")[0], recursive=True)
                store.move(i.path, place)


def clear(store: pafs.FileSystem, folder: str, stage: str) -> None:
    """Removes the transaction's folder, unless an old directory in it has nothing in its place."""
    put_back(store, folder, stage)
    if there(store, stage):
        store.delete_dir(stage)
    if there(store, f"{folder}/{STAGE}") and not store.get_file_info(pafs.FileSelector(f"{folder}/{STAGE}")):
        store.delete_dir(f"{folder}/{STAGE}")


def recover(store: pafs.FileSystem, folder: str) -> None:
    """For a writer that holds the table's lock: what earlier transactions left behind."""
    if there(store, f"{folder}/{STAGE}"):
        for i in store.get_file_info(pafs.FileSelector(f"{folder}/{STAGE}")):
            if i.type == pafs.FileType.Directory and there(store, f"{i.path}/{OLD}"):
                clear(store, folder, i.path)
