"""Counts of what is left out on the way from log files to events, taken by the pass that reads them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation

# What is counted, in the order that an event meets it.
COUNTED = ("lost_lines", "untimed", "malformed", "incomplete", "filtered", "events")


class Watch:
    """Named counts, filled while a staged log is read.

    `lost_lines`: lines before the first event of a file. `untimed`: events of the wanted type whose time, with the hour in the file's name, is none.
    `malformed`: events without anything after their name. `incomplete`: events without a required property. `filtered`:
    events that the filters turned away. `events`: what is left.

    The counts are observations on the steps of tasks that write their results, not of tasks that feed a shuffle:
    a task that is run again is counted once.
    """

    def __init__(self) -> None:
        self._observed: list[Observation] = []
        self._added: dict[str, int] = {}

    def over(self, df: DataFrame, **counts: Column) -> DataFrame:
        """`df`, counted as it passes; each count is an aggregate over it."""
        observation = Observation()
        self._observed.append(observation)
        return df.observe(observation, *[c.alias(name) for name, c in counts.items()])

    def add(self, name: str, n: int) -> None:
        self._added[name] = self._added.get(name, 0) + n

    def counts(self) -> dict[str, int]:
        """All counts; to be asked when the log has been read."""
        total = dict.fromkeys(COUNTED, 0)
        for found in [*(o.get for o in self._observed), self._added]:
            for name, n in found.items():
                total[name] += n or 0
        return total
