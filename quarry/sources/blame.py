"""Blame of files from the hunks of their commits, without a version control process for each line.

Hunks are (path, seq, commit, old_start, old_count, new_start, new_count), as diffs without context name them: a hunk that only adds
lines names the line after which they stand, one that only removes lines has a new count of 0. The commits of a file
are folded in the order of seq into segments of lines with one last commit; a file's state is its segments, whatever its
length. Files are dealt to tasks; a file's commits are one task's, as each changes what the one before left.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.sources.package import send_package

SEGMENTS = "path string, start long, end long, commit string"


def applied(segments: list[tuple[str, int]], commit: str, hunks: list[tuple[int, int, int]]) -> list[tuple[str, int]]:
    """Segments (commit, lines) after a commit of hunks (old_start, old_count, new_count), which come in order."""
    out: list[tuple[str, int]] = []
    rest = list(reversed(segments))
    at = 1  # the first old line that isn't dealt with

    def take(lines: int, keep: bool) -> None:
        nonlocal at
        at += lines
        while lines > 0 and rest:
            name, n = rest.pop()
            part = min(n, lines)
            if part < n:
                rest.append((name, n - part))
            if keep:
                add(name, part)
            lines -= part

    def add(name: str, n: int) -> None:
        if out and out[-1][0] == name:
            out[-1] = (name, out[-1][1] + n)
        elif n:
            out.append((name, n))

    for start, old, new in hunks:
        take((start if old else start + 1) - at, True)
        take(old, False)
        add(commit, new)
    for name, n in reversed(rest):
        add(name, n)
    return out


def blamed(hunks: DataFrame) -> DataFrame:
    """SEGMENTS of every file after its last commit; a file without lines has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        begun, path, seq, commit, segments, held, out = False, None, None, None, [], [], []

        def done() -> list[tuple]:
            rows, line = [], 1
            for name, n in applied(segments, commit, held):
                rows.append((path, line, line + n - 1, name))
                line += n
            return rows

        for batch in batches:
            for row in zip(*(batch[c].array for c in ("path", "seq", "commit", "old_start", "old_count", "new_count")), strict=True):
                if not begun or row[0] != path:
                    out += done() if begun else []
                    begun, path, seq, commit, segments, held = True, row[0], row[1], row[2], [], []
                elif row[1] != seq:
                    segments, held, seq, commit = applied(segments, commit, held), [], row[1], row[2]
                held.append(row[3:])
            if len(out) > 10_000:
                yield pd.DataFrame(out, columns=["path", "start", "end", "commit"])
                out = []
        out += done() if begun else []
        yield pd.DataFrame(out, columns=["path", "start", "end", "commit"])

    send_package(hunks.sparkSession)
    rows = hunks.select("path", "seq", "commit", "old_start", "old_count", "new_start", "new_count")
    return rows.repartition("path").sortWithinPartitions("path", "seq", "new_start", "old_start").mapInPandas(run, SEGMENTS)


def lines(segments: DataFrame) -> DataFrame:
    """(path, line, commit) of every line."""
    return segments.select("path", F.explode(F.sequence("start", "end")).alias("line"), "commit")
