"""Token counts of the parts of documents, from one encoding of the whole text.

A whole document is encoded once; its tokens' character spans are joined with the spans of its sections, both in order. A token
that reaches over a border is allocated by a rule: to the section of its `first` character, to the one that has `most` of its
characters (the earlier of equals), or `split` by characters. What no section has any character of counts as outside.

A token may hold part of a character's bytes: its span then is from the first to the last character that it touches.

Defined cases: a NULL text has no sections and no tokens; an empty text has one empty line; sections that are NULL, empty or reach beyond the
text count for the part that lies inside; of overlapping sections a character belongs to the one that starts first; every
document has an outside row, so none is missing; repeated rows have rows of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from logloom.llm.common import columns_of
from logloom.llm.tokens import default_tokenizer, tokenizer

RULES = ("first", "most", "split")
OUTSIDE = -1


def token_spans(ids: np.ndarray, lengths: np.ndarray, text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First character of each token and the one after its last."""
    ends = np.cumsum(lengths[ids])
    character = np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80) - 1
    if not len(ids):
        return ends, ends
    return character[ends - lengths[ids]], character[ends - 1] + 1


def line_spans(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The characters of each line, without the line feeds."""
    sizes = np.array([len(line) for line in text.split("\n")])
    ends = np.cumsum(sizes + 1) - 1
    return ends - sizes, ends


def allocate(a: np.ndarray, b: np.ndarray, starts: np.ndarray, ends: np.ndarray, rule: str) -> np.ndarray:
    """Tokens for each section (ordered, not overlapping), and last those outside, from token spans `a` to `b`."""
    counts = np.zeros(len(starts) + 1)
    filled = np.append(np.flatnonzero(ends > starts), len(starts))
    starts, ends = starts[filled[:-1]], ends[filled[:-1]]
    if not len(a):
        return counts
    low = np.searchsorted(ends, a, "right")
    high = np.searchsorted(starts, b, "left")
    inside = high > low
    counts[-1] = np.count_nonzero(~inside)
    a, b, low, high = a[inside], b[inside], low[inside], high[inside]
    if not len(a):
        return counts
    many = high - low
    of = np.repeat(np.arange(len(a)), many)
    section = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
    shared = np.minimum(b[of], ends[section]) - np.maximum(a[of], starts[section])
    begin = np.cumsum(many) - many
    if rule == "split":
        total = np.add.reduceat(shared, begin)
        np.add.at(counts, filled[section], shared / total[of])
        return counts
    if rule == "most":
        # the largest share, and the earliest of those: shares are integers, so that a place in order breaks ties
        order = np.lexsort((section, -shared, of))
        chosen = section[order[begin]]
    else:
        chosen = section[begin]
    np.add.at(counts, filled[chosen], 1)
    return counts


def _tidy(sections: list[dict] | None, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sections in order of their start, cut to the text and to what earlier ones leave, with their numbers."""
    spans = sorted(
        (max(0, s["start"] or 0), min(size, size if s["end"] is None else s["end"]), i) for i, s in enumerate(sections or []) if s is not None
    )
    made, reach = [], 0
    for start, end, i in spans:
        start = min(max(start, reach), size)
        made.append((start, max(start, end), i))
        reach = max(reach, end)
    return tuple(np.array(column, np.int64) for column in zip(*made)) if made else (np.zeros(0, np.int64),) * 3


def section_tokens(docs: DataFrame, sections: str | None = None, rule: str = "most", path: str | None = None) -> DataFrame:
    """`doc_id`, `section` (its number, -1 outside), `start`, `end` (characters, none outside) and `n_tokens`.

    `sections` names an array column of structs with `start` and `end`; without it, a document's sections are its lines.
    """
    if rule not in RULES:
        raise ValueError(f"rule {rule!r} is none of {', '.join(RULES)}")
    path = path or default_tokenizer()
    kind, integral = "double" if rule == "split" else "long", rule != "split"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = tokenizer(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, made, rows = batch.slice(at, 256), [], []
                given = part.column(sections).to_pylist() if sections else [None] * part.num_rows
                for text, spans in zip(part.column("text").to_pylist(), given):
                    if text is None:
                        starts, ends, numbers, a, b = (np.zeros(0, np.int64),) * 5
                    else:
                        a, b = token_spans(known.ids(text), known.lengths, text.encode())
                        if sections:
                            starts, ends, numbers = _tidy(spans, len(text))
                        else:
                            starts, ends = line_spans(text)
                            numbers = np.arange(len(starts))
                    made.append((np.append(numbers, OUTSIDE), np.append(starts, -1), np.append(ends, -1), allocate(a, b, starts, ends, rule)))
                    rows.append(len(starts) + 1)
                numbers, starts, ends, counts = (np.concatenate(c) for c in zip(*made))
                outside = numbers == OUTSIDE
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(np.repeat(np.arange(part.num_rows), rows))), pa.array(numbers.astype(np.int32)),
                     pa.array(starts, pa.int64(), mask=outside), pa.array(ends, pa.int64(), mask=outside),
                     pa.array(np.rint(counts).astype(np.int64) if integral else counts)],
                    ["doc_id", "section", "start", "end", "n_tokens"],
                )

    slim = columns_of(docs, "doc_id", "text", *[sections] * bool(sections))
    return slim.mapInArrow(scan, f"doc_id long, section int, start long, end long, n_tokens {kind}")
