"""What the tests of this folder share."""

from __future__ import annotations

WORD = r"[^\x20\x09-\x0D]+"


def plain(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
