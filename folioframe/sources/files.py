"""Where data sources written in Python find and leave files: any store that Arrow reaches by the path's scheme, local paths else."""

from __future__ import annotations

import re

from pyarrow import fs


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path inside it."""
    if not re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", path):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


def listed(path: str, suffixes: tuple[str, ...]) -> list[fs.FileInfo]:
    """The files at or below path that end so, hidden ones left out, by path."""
    store, inside = store_of(path)
    info = store.get_file_info(inside)
    found = [info] if info.is_file else store.get_file_info(fs.FileSelector(inside, recursive=True)) if info.type == fs.FileType.Directory else []
    hidden = lambda p: any(x.startswith(("_", ".")) for x in p[len(inside) :].split("/"))
    return sorted((f for f in found if f.is_file and f.path.lower().endswith(suffixes) and not hidden(f.path)), key=lambda f: f.path)


def name_of(path: str) -> str:
    """File name without folder and extension, as functions.text.document_name gives it."""
    return re.search(r"([^/]+?)(?:\.[^./]*)?$", path)[1]
