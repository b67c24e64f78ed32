"""Imports of relative modules of TypeScript, text by text inside Arrow batches, as they may span lines."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa

#: White space as Unicode has it: what (?U)\s means in the other patterns.
_S = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_NAME = r"""['"]([./][^'"]+)['"]"""
_START = re.compile(f"(?:import|export){_S}")
_END = re.compile(f"from{_S}+{_NAME}")
_SIDE = re.compile(f"import{_S}+{_NAME}")
#: Rows of a batch.
ROWS = 50_000


def _names(code: str) -> Iterator[re.Match]:
    """First the names behind `from`, from an import or export to the next of them, then those behind an import itself.

    What comes before `from` and the name are sought one after the other, so that no search runs to the end of the text more than once."""
    at = 0
    while (start := _START.search(code, at)) and (end := _END.search(code, start.end())):
        yield end
        at = end.end()
    yield from _SIDE.finditer(code)


def places(code: str) -> dict[tuple[str, int], int]:
    """Characters by (name, line): a name that is found twice on a line is one import."""
    found: dict[tuple[str, int], int] = {}
    at, line, begin = 0, 1, 0
    for m in _names(code):
        start = m.start(1)
        if start < at:
            # the other rule begins anew
            at, line, begin = 0, 1, 0
        if down := code.count("\n", at, start):
            line, begin = line + down, code.rindex("\n", at, start) + 1
        at = start
        found.setdefault((m[1], line), start - begin)
    return found


def relative_imports(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(repo, path, lang, text, line, character) of rows (repo, path, lang, code as UTF-8)."""
    for b in batches:
        rows: list[int] = []
        texts: list[str] = []
        lines: list[int] = []
        characters: list[int] = []

        def flush() -> pa.RecordBatch:
            of = [b.column(i).take(pa.array(rows, pa.int64())) for i in range(3)]
            out = pa.RecordBatch.from_arrays([*of, pa.array(texts, pa.string()), pa.array(lines, pa.int32()), pa.array(characters, pa.int32())], ["repo", "path", "lang", "text", "line", "character"])
            for part in (rows, texts, lines, characters):
                part.clear()
            return out

        for i, code in enumerate(b.column(3)):
            for (name, line), character in places(code.as_py().decode("utf-8", "replace")).items():
                rows.append(i)
                texts.append(name)
                lines.append(line)
                characters.append(character)
                if len(rows) == ROWS:
                    yield flush()
        if rows:
            yield flush()
