"""Libraries by name: one small file for each under a shared folder, so that two writers of different names never meet."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

from lectern import errors as E
from lectern.engine import Engine
from lectern.store import SCHEMAS

_DEFAULT = ".default"


def checked_name(name: str | None) -> str:
    """A name that can be a part of a path and a word of a command: not empty, without slashes and blanks, no dots alone."""
    name = (name or "").strip()
    if not name or name in (".", "..", _DEFAULT) or re.search(r"[/\\\s]", name):
        raise E.BadName(f"{name!r} can be no name of a library")
    return name


class Registry:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, path: str):  # noqa: ANN202
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _read(self, name: str) -> str | None:
        files, at = self._at(f"{self.path}/{name}")
        if not files.exists(at):
            return None
        stream = files.open(at)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _write(self, name: str, said: str) -> None:
        files, at = self._at(f"{self.path}/{name}")
        out = files.create(at, True)
        out.write(said.encode())
        out.close()

    def names(self) -> list[str]:
        files, at = self._at(self.path)
        found = [s.getPath().getName() for s in files.listStatus(at)] if files.exists(at) else []
        return sorted(n for n in found if not n.startswith("."))

    def default(self) -> str | None:
        name = self._read(_DEFAULT)
        return name if name and self._read(name) is not None else None

    def add(self, name: str, path: str, default: bool | None = None) -> None:
        """Name a folder that exists. The first library is the default one, unless ``default`` says otherwise."""
        name = checked_name(name)
        files, at = self._at(path)
        if not files.exists(at):
            raise E.UnknownLibrary(f"{path} is not there")
        if (was := self._read(name)) not in (None, path):
            raise E.BadName(f"{name} is the name of {was}")
        first = not self.names()
        self._write(name, path.rstrip("/"))
        if default or (default is None and first):
            self.use(name)

    def use(self, name: str) -> None:
        self.resolve(name)
        self._write(_DEFAULT, name)

    def resolve(self, name: str | None = None) -> str:
        """The path of a library; without a name, of the default one."""
        name = name or self.default()
        path = self._read(checked_name(name)) if name else None
        if path is None:
            raise E.UnknownLibrary(f"no library {name!r}; there are: {', '.join(self.names()) or 'none'}")
        return path

    def open(self, name: str | None = None, **options: object) -> Engine:
        return Engine(self.spark, self.resolve(name), **options)

    def forget(self, name: str) -> None:
        """Take a name away; the library stays."""
        self.resolve(name)
        files, at = self._at(f"{self.path}/{name}")
        files.delete(at, False)

    def delete(self, name: str) -> None:
        """A library's own tables and commits, then its name. Other files in its folder stay, and the folder with them."""
        path = self.resolve(name)
        for own in ("_commits", "_work", *SCHEMAS):  # commits first: without them no table is read
            files, at = self._at(f"{path}/{own}")
            files.delete(at, True)
        files, at = self._at(path)
        if files.exists(at) and not files.listStatus(at):
            files.delete(at, False)
        self.forget(name)
