"""Versions of a folder: files go to a fresh folder, one small file makes them current.

``<root>/_versions/<id>/`` holds the files of one write under their final names,
``<root>/_commits/<number>.json`` names the folders that are current from then on. A write
that dies before its commit file leaves everything as it was. The folders of the commit
before stay, for readers that have begun; older ones go.

A folder without commits is read as it is, so files that others have laid there work.
One writer at a time is assumed.
"""

from __future__ import annotations

import json
import re
import uuid

from pyarrow import fs as pafs

COMMITS, VERSIONS = "_commits", "_versions"
_NUMBERED = re.compile(r"^(\d+)\.json$")


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """``path`` is a full URI: tasks must not guess which file system a bare path means."""
    if not re.match(r"^[a-zA-Z][\w+.-]*:", path):
        raise ValueError(f"not a full URI: {path}; read_shards, write_shards and session.qualified make one")
    uri = re.sub(r"^file:/+", "file:///", path)
    return pafs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", uri))


def _commits(system: pafs.FileSystem, root: str) -> list[tuple[int, str]]:
    found = system.get_file_info(pafs.FileSelector(f"{root}/{COMMITS}", allow_not_found=True))
    return sorted((int(m[1]), i.path) for i in found if (m := _NUMBERED.match(i.base_name)))


def _folders(system: pafs.FileSystem, path: str) -> list[str]:
    with system.open_input_file(path) as f:
        return json.loads(f.read())["folders"]


def current(system: pafs.FileSystem, root: str) -> list[str]:
    """Folders whose files are current."""
    commits = _commits(system, root)
    if not commits:
        return [root]
    return [f"{root}/{VERSIONS}/{v}" if v else root for v in _folders(system, commits[-1][1])]


def new_version(root: str) -> str:
    return f"{root}/{VERSIONS}/{uuid.uuid4().hex}"


def put_file(system: pafs.FileSystem, path: str, data: bytes) -> None:
    """A whole file at ``path`` or none: written beside it, then renamed."""
    folder, name = path.rsplit("/", 1)
    system.create_dir(folder, recursive=True)
    draft = f"{folder}/.{name}-{uuid.uuid4().hex}"
    with system.open_output_stream(draft) as f:
        f.write(data)
    try:
        system.move(draft, path)
    except OSError:
        # Some file systems do not rename over a file.
        if system.get_file_info(path).type != pafs.FileType.File:
            raise
        system.delete_file(path)
        system.move(draft, path)


def put_whole(system: pafs.FileSystem, source: str, path: str) -> None:
    """Give a finished file its name. If another attempt has done so, its file stays."""
    try:
        system.move(source, path)
    except OSError:
        size = system.get_file_info(path).size
        if size is None or size != system.get_file_info(source).size:
            raise
        system.delete_file(source)


def publish(system: pafs.FileSystem, root: str, version: str, keep: bool) -> None:
    """Make ``version`` current, in place of what was or (``keep``) together with it."""
    commits = _commits(system, root)
    before = _folders(system, commits[-1][1]) if commits else [""]
    folders = [*(before if keep else []), version.rsplit("/", 1)[-1]]
    number = commits[-1][0] + 1 if commits else 1
    put_file(system, f"{root}/{COMMITS}/{number:08d}.json", json.dumps({"folders": folders}).encode())
    # From here on the write is done; what follows is tidying.
    alive = {*folders, *before}
    for info in system.get_file_info(pafs.FileSelector(f"{root}/{VERSIONS}")):
        if info.base_name not in alive and any(info.base_name in _folders(system, path) for _, path in commits):
            system.delete_dir(info.path)
    for _, path in commits[:-1]:
        system.delete_file(path)
