"""Matching of paths against the rules of ignore files."""

from __future__ import annotations

import re
from dataclasses import dataclass


@dataclass(frozen=True)
class Rule:
    pattern: re.Pattern
    negated: bool
    folders_only: bool


def translate(glob: str) -> str:
    """Regular expression of one glob: * and ? stay within a folder, ** crosses folders, [..] is a class."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i) and (i == 0 or glob[i - 1] == "/"):
            out += "(?:[^/]+/)*"
            i += 3
        elif glob.startswith("/**", i) and i + 3 == len(glob):
            out += "/.+"
            i += 3
        elif glob[i] == "*":
            while i < len(glob) and glob[i] == "*":
                i += 1
            out += "[^/]*"
        elif glob[i] == "?":
            out += "[^/]"
            i += 1
        elif glob[i] == "[" and "]" in glob[i + 2 :]:
            end = glob.index("]", i + 2)
            body = glob[i + 1 : end]
            out += "[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]"
            i = end + 1
        elif glob[i] == "\\" and i + 1 < len(glob):
            out += re.escape(glob[i + 1])
            i += 2
        else:
            out += re.escape(glob[i])
            i += 1
    return out


def parse(text: str) -> list[Rule]:
    """Rules of one ignore file; comments, blank and malformed lines are left out."""
    rules = []
    for line in text.splitlines():
        line = re.sub(r"(?<!\\)[ \t]+$", "", line)
        if not line or line.startswith("#"):
            continue
        negated = line.startswith("!")
        line = line[negated:]
        folders_only = line.endswith("/")
        line = line.rstrip("/")
        if not line:
            continue
        anchored = "/" in line
        line = line.removeprefix("/")
        try:
            rules.append(Rule(re.compile(("" if anchored else "(?:.*/)?") + translate(line) + r"\Z", re.DOTALL), negated, folders_only))
        except re.error:
            continue
    return rules


def ignored(path: str, is_folder: bool, levels: list[tuple[str, list[Rule]]]) -> bool:
    """Whether the last rule that matches, from the innermost ignore file outwards, ignores `path`.

    levels: (folder of the ignore file relative to the root, its rules), outermost first.
    """
    for folder, rules in reversed(levels):
        inside = path[len(folder) + 1 :] if folder else path
        for rule in reversed(rules):
            if (is_folder or not rule.folders_only) and rule.pattern.match(inside):
                return not rule.negated
    return False
