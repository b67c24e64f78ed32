"""Path functions as column expressions; paths are relative with `/`."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Languages by file extension.
LANGUAGES = {"rs": "rust", "go": "go", "py": "python", "ts": "typescript", "tsx": "typescript", "js": "typescript", "jsx": "typescript", "cs": "csharp"}


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent(path: Column) -> Column:
    """The folder; empty at the top."""
    return F.regexp_replace(path, r"(^|/)[^/]*$", "")


def join(folder: Column, name: Column) -> Column:
    return F.when(folder == "", name).otherwise(F.concat(folder, F.lit("/"), name))


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"\.([^./]+)$", 1)


def language(path: Column) -> Column:
    """The language by extension or null."""
    return F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))[extension(path)]


def with_extension(path: Column, ext: str) -> Column:
    """The last extension replaced, or one added; a leading dot starts no extension."""
    name = basename(path)
    bare = F.when(name.rlike(r"^.+\.[^.]*$"), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)
    return F.concat(join(parent(path), bare), F.lit(f".{ext}"))


def normalised(path: Column) -> Column:
    """Without `.` and with `..` resolved; `..` at the top is dropped."""
    empty = F.array().cast("array<string>")
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    kept = F.aggregate(parts, empty, lambda out, p: F.when(p != "..", F.array_append(out, p)).when(F.size(out) > 0, F.slice(out, F.lit(1), F.size(out) - 1)).otherwise(out))
    return F.array_join(kept, "/")


def package(path: Column) -> Column:
    """The package: below `src` its first folder, else the first folder, `root` without one. Parts with a dot are no folders."""
    dirs = F.filter(F.split(path, "/"), lambda p: (p != "") & ~F.contains(p, F.lit(".")))
    return F.when(F.size(dirs) == 0, "root").when((F.size(dirs) > 1) & (F.get(dirs, F.lit(0)) == "src"), F.get(dirs, F.lit(1))).otherwise(F.get(dirs, F.lit(0)))


def fits(path: Column, hint: str) -> Column:
    """Equal, or ends with the hint."""
    return (path == hint) | path.endswith(hint)


def fits_either_way(path: Column, other: Column) -> Column:
    return (path == other) | path.endswith(other) | other.endswith(path)
