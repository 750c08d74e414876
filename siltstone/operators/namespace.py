"""The namespace: an operation log replayed case by case into files, directories and links.

Operations of a case depend on each other, so a case is replayed in order in
one task, and cases are independent. The rules are those of a POSIX tree:
names are unique in a directory, rename replaces compatible targets and never
moves a directory into itself, a file's bytes live while a name points at it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: The largest file, and the limits of attributes.
MOST_BYTES, NAME_BYTES, VALUE_BYTES = 8 << 30, 255, 64 << 10
STATE = "case_id long, path string, kind string, size long, nlink int, content_hash string, target string"
OUTCOME = "case_id long, seq int, outcome string"


class Refused(Exception):
    """An operation that the rules don't allow; its text is the error's name."""


class Content:
    """A file's bytes: its size, and the pages that were written. All else is zeros and takes no memory."""

    PAGE = 4096

    def __init__(self) -> None:
        self.size, self.pages = 0, {}

    def write(self, offset: int, data: bytes) -> None:
        at, stop = offset, offset + len(data)
        while at < stop:
            page, inside = divmod(at, self.PAGE)
            part = data[at - offset : at - offset + self.PAGE - inside]
            self.pages.setdefault(page, bytearray(self.PAGE))[inside : inside + len(part)] = part
            at += len(part)
        self.grow(stop)

    def grow(self, size: int) -> None:
        self.size = max(self.size, size)

    def zero(self, start: int, stop: int) -> None:
        for page in [p for p in self.pages if start < (p + 1) * self.PAGE and p * self.PAGE < stop]:
            begin, end = max(start - page * self.PAGE, 0), min(stop - page * self.PAGE, self.PAGE)
            if end - begin == self.PAGE:
                del self.pages[page]
            else:
                self.pages[page][begin:end] = b"\0" * (end - begin)

    def resize(self, size: int) -> None:
        # so that a file that grows again has zeros there
        self.zero(size, self.size)
        self.size = size

    def parts(self, most: int = 1 << 20) -> Iterator[bytes]:
        """The bytes in order, at most so many at a time."""
        empty, at = b"\0" * most, 0
        for page in [*sorted(p for p in self.pages if p * self.PAGE < self.size), None]:
            start = self.size if page is None else page * self.PAGE
            while at < start:
                yield empty[: start - at]
                at += min(most, start - at)
            if page is not None:
                yield bytes(self.pages[page][: self.size - start])
                at = min(start + self.PAGE, self.size)

    def sha256(self) -> str:
        digest = hashlib.sha256()
        for part in self.parts():
            digest.update(part)
        return digest.hexdigest()


class Tree:
    """One case's state: inodes with content, directories with entries."""

    def __init__(self) -> None:
        self.inodes: dict[int, dict] = {1: {"kind": "dir", "entries": {}}}
        self.next = 2

    def _new(self, **inode) -> int:
        number, self.next = self.next, self.next + 1  # a number is never used again
        self.inodes[number] = inode
        return number

    def along(self, path: str) -> list[int]:
        """The inodes that a path leads through, from the root on."""
        at, out = 1, [1]
        for name in filter(None, path.split("/")):
            inode = self.inodes[at]
            if inode["kind"] != "dir":
                raise Refused("not a directory")
            if name not in inode["entries"]:
                raise Refused("not found")
            at = inode["entries"][name]
            out.append(at)
        return out

    def walk(self, path: str) -> int:
        return self.along(path)[-1]

    def split(self, path: str) -> tuple[dict, str]:
        parent, _, name = path.rpartition("/")
        if not name or len(name.encode()) > NAME_BYTES:
            raise Refused("bad name")
        inode = self.inodes[self.walk(parent)]
        if inode["kind"] != "dir":
            raise Refused("not a directory")
        return inode["entries"], name

    def file(self, path: str, create: bool = False) -> dict:
        try:
            inode = self.inodes[self.walk(path)]
        except Refused:
            if not create:
                raise
            entries, name = self.split(path)
            entries[name] = self._new(kind="file", data=Content(), nlink=1)
            inode = self.inodes[entries[name]]
        if inode["kind"] != "file":
            raise Refused("not a file")
        return inode

    def write(self, path: str, offset: int, data: bytes) -> None:
        if offset + len(data) > MOST_BYTES:
            raise Refused("too large")
        self.file(path, create=True)["data"].write(offset, data)

    def truncate(self, path: str, size: int) -> None:
        content = self.file(path)["data"]
        if size > MOST_BYTES:
            raise Refused("too large")
        content.resize(size)

    def fallocate(self, path: str, offset: int, length: int, mode: str, keep_size: bool) -> None:
        if length <= 0:
            raise Refused("no length")
        if offset + length > MOST_BYTES:
            raise Refused("too large")
        content = self.file(path)["data"]
        if mode in ("punch", "zero"):
            content.zero(offset, offset + length)
        if mode in ("allocate", "zero") and not keep_size:
            content.grow(offset + length)

    def _make(self, path: str, **inode) -> None:
        entries, name = self.split(path)
        if name in entries:
            raise Refused("exists")
        entries[name] = self._new(**inode)

    def mkdir(self, path: str) -> None:
        self._make(path, kind="dir", entries={})

    def symlink(self, path: str, target: str) -> None:
        self._make(path, kind="symlink", target=target, nlink=1)

    def link(self, source: str, path: str) -> None:
        number = self.walk(source)
        if self.inodes[number]["kind"] == "dir":
            raise Refused("is a directory")
        entries, name = self.split(path)
        if name in entries:
            raise Refused("exists")
        entries[name] = number
        self.inodes[number]["nlink"] += 1

    def _release(self, number: int) -> None:
        inode = self.inodes[number]
        if inode["kind"] == "dir":
            del self.inodes[number]
            return
        inode["nlink"] -= 1
        if not inode["nlink"]:
            del self.inodes[number]

    def unlink(self, path: str) -> None:
        entries, name = self.split(path)
        if name not in entries:
            raise Refused("not found")
        if self.inodes[entries[name]]["kind"] == "dir":
            raise Refused("is a directory")
        self._release(entries.pop(name))

    def rmdir(self, path: str) -> None:
        entries, name = self.split(path)
        if name not in entries:
            raise Refused("not found")
        inode = self.inodes[entries[name]]
        if inode["kind"] != "dir":
            raise Refused("not a directory")
        if inode["entries"]:
            raise Refused("not empty")
        self._release(entries.pop(name))

    def rename(self, source: str, path: str, replace: bool = True) -> None:
        old, old_name = self.split(source)
        if old_name not in old:
            raise Refused("not found")
        new, new_name = self.split(path)
        number = old[old_name]
        moving = self.inodes[number]
        if moving["kind"] == "dir" and number in self.along(path.rpartition("/")[0]):
            raise Refused("into itself")
        there = new.get(new_name)
        if there == number:
            return
        if there is not None:
            if not replace:
                raise Refused("exists")
            standing = self.inodes[there]
            if (standing["kind"] == "dir") != (moving["kind"] == "dir"):
                raise Refused("is a directory" if standing["kind"] == "dir" else "not a directory")
            if standing["kind"] == "dir" and standing["entries"]:
                raise Refused("not empty")
            self._release(there)
        new[new_name] = old.pop(old_name)

    def apply(self, op: dict) -> None:
        kind, path = op["op"], op["path"]
        if kind == "write":
            self.write(path, int(op["offset"]), bytes(op["data"] or b""))
        elif kind == "truncate":
            self.truncate(path, int(op["len"]))
        elif kind == "fallocate":
            self.fallocate(path, int(op["offset"]), int(op["len"]), op["mode"], bool(op["keep_size"]))
        elif kind in ("mkdir", "rmdir", "unlink"):
            getattr(self, kind)(path)
        elif kind in ("rename", "link"):
            getattr(self, kind)(path, op["target"])
        elif kind == "symlink":
            self.symlink(path, op["target"])
        elif kind not in ("fsync", "crash_and_remount"):  # neither changes what a replay from the log shows
            raise Refused("unknown operation")

    def rows(self, case_id: int) -> list[tuple]:
        out, waiting = [], [("", 1)]
        while waiting:
            path, number = waiting.pop()
            for name, child in self.inodes[number]["entries"].items():
                inode, here = self.inodes[child], f"{path}/{name}"
                is_file = inode["kind"] == "file"
                size = inode["data"].size if is_file else len(inode.get("target", "").encode())
                digest = inode["data"].sha256() if is_file else None
                out.append((case_id, here, inode["kind"], size, inode.get("nlink", 2), digest, inode.get("target")))
                if inode["kind"] == "dir":
                    waiting.append((here, child))
        return out


def _replay(pdf: pd.DataFrame) -> tuple[Tree, list[tuple]]:
    tree, outcomes = Tree(), []
    for op in pdf.sort_values("seq").to_dict("records"):
        try:
            tree.apply(op)
            outcomes.append((op["case_id"], op["seq"], "ok"))
        except Refused as refused:
            outcomes.append((op["case_id"], op["seq"], str(refused)))
    return tree, outcomes


def replayed(log: DataFrame) -> DataFrame:
    """The final tree of each case: one row a path."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names = [c.split()[0] for c in STATE.split(", ")]
        return pd.DataFrame(_replay(pdf)[0].rows(int(pdf["case_id"].iloc[0])), columns=names)

    return log.groupBy("case_id").applyInPandas(run, STATE)


def outcomes(log: DataFrame) -> DataFrame:
    """What became of each operation: ``ok`` or the reason for refusing it."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_replay(pdf)[1], columns=["case_id", "seq", "outcome"])

    return log.groupBy("case_id").applyInPandas(run, OUTCOME)
