"""Ignore files: patterns compiled to regular expressions, matched against every ancestor's rules."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field


def _class_end(p: str, i: int) -> int:
    j = i + 1
    if j < len(p) and p[j] in "!^":
        j += 1
    if j < len(p) and p[j] == "]":
        j += 1
    while j < len(p) and p[j] != "]":
        j += 1
    return j


def to_regex(pattern: str) -> re.Pattern | None:
    """One line of an ignore file as a regex over ``/``-separated relative paths (a folder also with a slash at its end); None for blank lines and comments."""
    p = pattern.rstrip("\n\r")
    if p.endswith(" ") and not p.endswith("\\ "):
        p = p.rstrip(" ")
    if not p or p.startswith("#"):
        return None
    if p.startswith(("\\#", "\\!")):
        p = p[1:]
    only_dirs = p.endswith("/")
    p = p.rstrip("/") if only_dirs else p
    anchored = "/" in p
    p = p.lstrip("/")
    if not p:
        return None
    out, i = "", 0
    while i < len(p):
        c = p[i]
        if p.startswith("**/", i) and (i == 0 or p[i - 1] == "/"):
            out += "(?:.*/)?"
            i += 3
        elif p.startswith("**", i) and i + 2 == len(p) and i and p[i - 1] == "/":
            out += ".+"
            i += 2
        elif c == "*":
            while p.startswith("*", i):
                i += 1
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
            i += 1
        elif c == "[" and _class_end(p, i) < len(p):
            j = _class_end(p, i)
            body = p[i + 1 : j]
            body = "^" + body[1:] if body[:1] in "!^" else body
            out += "[" + body.replace("\\", "\\\\") + "]"
            i = j + 1
        elif c == "\\" and i + 1 < len(p):
            out += re.escape(p[i + 1])
            i += 2
        else:
            out += re.escape(c)
            i += 1
    head = "" if anchored else "(?:.*/)?"
    tail = "/.*" if only_dirs else "(?:/.*)?"
    try:
        return re.compile(f"{head}{out}{tail}", re.S)
    except re.error:
        return None


@dataclass
class Rules:
    """Patterns of one ignore file in order; the last that matches decides within the file."""

    rules: list[tuple[bool, re.Pattern]] = field(default_factory=list)

    @classmethod
    def parse(cls, text: str) -> "Rules":
        out = cls()
        for line in text.splitlines():
            negated = line.startswith("!")
            if (rx := to_regex(line[1:] if negated else line)) is not None:
                out.rules.append((negated, rx))
        return out

    @classmethod
    def load(cls, folder: str) -> "Rules | None":
        try:
            with open(os.path.join(folder, ".gitignore"), encoding="utf-8") as f:
                return cls.parse(f.read())
        except (OSError, UnicodeDecodeError):
            return None

    def ignores(self, path: str) -> bool:
        state = False
        for negated, rx in self.rules:
            if rx.fullmatch(path):
                state = not negated
        return state


class Ignored:
    """Rules of a folder and all its ancestors up to the root; a path is skipped if any of them ignores it."""

    def __init__(self, root: str):
        self.root, self._loaded = root, {}

    def _rules(self, rel: str) -> Rules | None:
        if rel not in self._loaded:
            self._loaded[rel] = Rules.load(os.path.join(self.root, rel))
        return self._loaded[rel]

    def skip(self, rel: str, is_dir: bool = False) -> bool:
        parts = rel.split("/")
        for k in range(len(parts)):
            rules = self._rules("/".join(parts[:k]))
            if rules is not None:
                below = "/".join(parts[k:])
                if rules.ignores(below) or (is_dir and rules.ignores(below + "/")):
                    return True
        return False
