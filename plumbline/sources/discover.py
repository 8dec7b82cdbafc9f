"""Workspace discovery for scaffolding: globs of the manifests, expanded to folders that have a manifest."""

from __future__ import annotations

import json
import os
import unicodedata
from dataclasses import dataclass
from typing import Any, Protocol


@dataclass(frozen=True)
class Package:
    name: str
    src_dir: str


class Files(Protocol):
    def exists(self, path: str) -> bool: ...
    def read(self, path: str) -> str: ...
    def is_dir(self, path: str) -> bool: ...
    def list(self, path: str) -> list[str]: ...


class LocalFiles:
    def exists(self, path: str) -> bool:
        return os.path.exists(path)

    def read(self, path: str) -> str:
        with open(path, encoding="utf-8") as f:
            return f.read()

    def is_dir(self, path: str) -> bool:
        return os.path.isdir(path)

    def list(self, path: str) -> list[str]:
        try:
            return os.listdir(path)
        except OSError:
            return []


def join_posix(*parts: str) -> str:
    names = [s for p in parts for s in p.split("/") if s not in ("", ".")]
    return ("/" if parts and parts[0].startswith("/") else "") + "/".join(names)


def globs_from_package_json(pkg: Any) -> list[str]:
    """``workspaces`` as a list, or its ``packages``; what isn't a string is left out."""
    spaces = pkg.get("workspaces") if isinstance(pkg, dict) else None
    if isinstance(spaces, dict):
        spaces = spaces.get("packages")
    return [g for g in spaces if isinstance(g, str)] if isinstance(spaces, list) else []


def _without_comment(line: str) -> str:
    """A line up to a '#' that starts it or follows a blank, outside quotes."""
    quote = ""
    for i, c in enumerate(line):
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c == "#" and (i == 0 or line[i - 1].isspace()):
            return line[:i]
    return line


def globs_from_workspace_yaml(text: str) -> list[str]:
    """The block list of the key ``packages``; it ends with the next key. Items may be quoted."""
    items: list[str] = []
    inside = False
    for line in map(_without_comment, text.splitlines()):
        content = line.strip()
        if not content:
            continue
        if content[0] != "-":
            if inside:
                break
            inside = content.endswith(":") and content[:-1].rstrip() == "packages"
        elif inside:
            value = content[1:].strip()
            if len(value) > 1 and value[0] == value[-1] and value[0] in "'\"":
                value = value[1:-1].strip()
            items += [value] if value else []
    return items


def expand_glob(files: Files, root: str, glob: str) -> list[str]:
    """Folders below ``root``, relative to it, that match and hold a package.json. '*' is any one name, '**' any number; all else is literal."""
    at = {""}
    for part in [s for s in glob.split("/") if s not in ("", ".")]:
        if part == "**":
            new, found = set(at), set(at)
            while new:
                new = {c for a in new for c in _folders(files, root, a)} - found
                found |= new
            at = found
        elif part == "*":
            at = {c for a in at for c in _folders(files, root, a)}
        else:
            at = {c for a in at if files.is_dir(join_posix(root, c := join_posix(a, part)))}
    return sorted(a for a in at if files.exists(join_posix(root, a, "package.json")))


def _folders(files: Files, root: str, at: str) -> list[str]:
    return [c for n in files.list(join_posix(root, at)) if files.is_dir(join_posix(root, c := join_posix(at, n)))]


def package_name(files: Files, root: str, at: str) -> str:
    try:
        name = json.loads(files.read(join_posix(root, at, "package.json"))).get("name")
    except (OSError, ValueError, AttributeError, KeyError):
        name = None
    return name if isinstance(name, str) and name.strip() else at.split("/")[-1]


#: Marks in the order of the root collation, before digits and letters.
MARKS = "_-,;:!?.'\"()[]{}@*/\\&#%`^+<=>|~$"


def collation_key(text: str) -> tuple:
    """An order as people sort: marks, digits, letters; then accents; then small letters before their capitals."""
    parts = unicodedata.normalize("NFD", text)
    base = [c for c in parts if not unicodedata.combining(c)]
    rank = lambda c: (0, MARKS.find(c) if c in MARKS else len(MARKS) + ord(c)) if not c.isalnum() else (1 if c.isdigit() else 2, c.lower())
    return [rank(c) for c in base], [c for c in parts if unicodedata.combining(c)], "".join(base).swapcase()


def discover_workspaces(files: Files, root: str) -> list[Package]:
    """Packages of both manifests' globs, each folder once, by folder."""
    globs: list[str] = []
    if files.exists(p := join_posix(root, "package.json")):
        try:
            globs += globs_from_package_json(json.loads(files.read(p)))
        except (OSError, ValueError):
            pass
    if files.exists(p := join_posix(root, "pnpm-workspace.yaml")):
        globs += globs_from_workspace_yaml(files.read(p))
    found = dict.fromkeys(d for g in globs for d in expand_glob(files, root, g))
    return sorted((Package(package_name(files, root, d), f"./{d}") for d in found), key=lambda p: collation_key(p.src_dir))
