"""Patterns written in Python's `re` syntax, for use with Spark's Java regexes."""

from __future__ import annotations

import re
import warnings

# Python escapes that Java reads differently.
_ESCAPES = {"Z": r"\z", "v": r"\x0B"}


def escape(text: str) -> str:
    """Quote literal text for a Java regex."""
    return re.sub(r"([^\w\s]|_)", r"\\\1", text, flags=re.ASCII).replace("\\_", "_")


def to_java(pattern: str) -> str:
    """Check a Python pattern and return the Java pattern with the same meaning.

    `(?U)` gives Java Python's Unicode classes, `(?d)` makes only a line feed end a line.
    Raises ValueError for a bad pattern or one Java has no counterpart for.
    """
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore", FutureWarning)
            flags = re.compile(pattern).flags
    except re.error as error:
        raise ValueError(f"bad regular expression {pattern!r}: {error}") from error
    if re.search(r"(?<!\\)\(\?\(", pattern):
        raise ValueError(f"conditional groups are not supported: {pattern!r}")

    groups: dict[str, str] = {}

    def group(name: str) -> str:
        return groups.setdefault(name, f"g{len(groups)}")

    out, at, in_class = [], 0, False
    while at < len(pattern):
        rest = pattern[at:]
        named = re.match(r"\(\?P<(\w+)>", rest)
        back = re.match(r"\(\?P=(\w+)\)", rest)
        ascii_flag = re.match(r"\(\?([a-zA-Z]*a[a-zA-Z]*)\)", rest)
        octal = re.match(r"\\(0[0-7]{0,2}|[1-3][0-7]{2})", rest)
        if octal:
            out.append(rf"\x{{{int(octal[1], 8):x}}}")
            at += len(octal[0])
        elif rest[0] == "\\":
            out.append(_ESCAPES.get(rest[1], rest[:2]))
            at += 2
        elif in_class:
            if rest[0] == "]":
                in_class = False
            # `[` and `&&` are class operators in Java only
            out.append("\\" + rest[0] if rest[0] in "[&" else rest[0])
            at += 1
        elif rest[0] == "[":
            opening = re.match(r"\[\^?\]?", rest)[0]
            out.append(opening[:-1] + r"\]" if opening.endswith("]") else opening)
            in_class = True
            at += len(opening)
        elif named:
            out.append(f"(?<{group(named[1])}>")
            at += len(named[0])
        elif back:
            out.append(rf"\k<{group(back[1])}>")
            at += len(back[0])
        elif ascii_flag:
            other = ascii_flag[1].replace("a", "")
            out.append(f"(?{other})" if other else "")
            at += len(ascii_flag[0])
        elif re.match(r"\{,\d+\}", rest):
            out.append("{0,")
            at += 2
        else:
            out.append(rest[0])
            at += 1
    return ("(?d)" if flags & re.ASCII else "(?Ud)") + "".join(out)
