"""Extraction and resolution over the code corpora; the SQL lists the expected rows."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import extract, graph, packages, resolve
from quarry.plans.fixtures import files, values

LANGS = {"harbour": "rust", "market": "go", "kitchen": "python", "theatre": "typescript", "mill": "csharp"}


def symbols(repo: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.symbols(files(spark, repo)).select("path", "line", "name", "kind")


def imports(repo: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.imports(files(spark, repo)).select("path", "line", "text", "character")


def resolved(repo: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, repo)
    return resolve.resolve_imports(extract.imports(f), f).select("src", "dst")


def call_sites(spark, sf_dir):
    f = files(spark, "harbour")
    return extract.calls(f, extract.symbols(f)).select("caller_file", "caller_sym", "callee_name", "line")


def call_resolution(spark, sf_dir):
    f = files(spark, "harbour")
    s = extract.symbols(f)
    return resolve.resolve_calls(extract.calls(f, s), s).select("caller_sym", "callee_name", "callee_file", "resolved")


def harbour_hotspots(spark, sf_dir):
    f = files(spark, "harbour")
    return graph.hotspots(resolve.resolve_imports(extract.imports(f), f))


def harbour_shortest_path(spark, sf_dir):
    f = files(spark, "harbour")
    return graph.shortest_path(resolve.resolve_imports(extract.imports(f), f), "src/lib.rs", "src/tide.rs")


def harbour_reverse_map(spark, sf_dir):
    f = files(spark, "harbour")
    return resolve.reverse_map(resolve.resolve_imports(extract.imports(f), f)).select("path", "depends_on", "depended_by")


def harbour_conventions(spark, sf_dir):
    return packages.conventions(files(spark, "harbour")).select("package", "tags", "async_fn", "has_tests")


def harbour_purposes(spark, sf_dir):
    f = files(spark, "harbour")
    return packages.purposes(extract.symbols(f), packages.conventions(f)).select("package", "purpose")


def harbour_packages(spark, sf_dir):
    return packages.grouped(files(spark)).select("repo", "package", "files")


def harbour_api_surface(spark, sf_dir):
    f = files(spark, "harbour")
    return packages.api_surface(extract.symbols(f)).select("package", F.transform("exports", lambda x: x["name"]).alias("exports"), "internal_count")


def harbour_hot_symbols(spark, sf_dir):
    return packages.hot_symbols(extract.symbols(files(spark, "harbour")))


def harbour_symbol_ids(spark, sf_dir):
    s = extract.symbols(files(spark, "harbour"))
    return packages.symbol_ids(s, packages.path_ids(s)).select("id", "p", "n", "l")


QUERIES = {f"symbols_{LANGS[r]}": partial(symbols, r) for r in LANGS} | {f"imports_{LANGS[r]}": partial(imports, r) for r in LANGS} | {f"resolve_{LANGS[r]}": partial(resolved, r) for r in LANGS}
QUERIES |= {f.__name__: f for f in (call_sites, call_resolution, harbour_hotspots, harbour_shortest_path, harbour_reverse_map, harbour_conventions, harbour_purposes, harbour_packages, harbour_api_surface, harbour_hot_symbols, harbour_symbol_ids)}

ORACLES = {
    "symbols_rust": values('path, line, name, kind', [
        ('src/berth.rs', 4, 'Berth', 'Struct'),
        ('src/berth.rs', 9, 'fits', 'Function'),
        ('src/crane/hook.rs', 2, 'Hook', 'Struct'),
        ('src/crane/hook.rs', 3, 'grab', 'Function'),
        ('src/crane/hook.rs', 4, 'Tons', 'Other'),
        ('src/crane/mod.rs', 1, 'hook', 'Module'),
        ('src/crane/mod.rs', 5, 'Lifts', 'Trait'),
        ('src/crane/mod.rs', 6, 'lift', 'Function'),
        ('src/crane/mod.rs', 9, 'unload', 'Function'),
        ('src/lib.rs', 2, 'crane', 'Module'),
        ('src/lib.rs', 3, 'berth', 'Module'),
        ('src/lib.rs', 4, 'tide', 'Module'),
        ('src/lib.rs', 6, 'PIERS', 'Variable'),
        ('src/tide.rs', 1, 'Level', 'Enum'),
        ('src/tide.rs', 3, 'tide_at', 'Function'),
        ('src/tide.rs', 7, 'metres', 'Function'),
        ('src/tide.rs', 8, 'knots', 'Other'),
    ]),
    "symbols_go": values('path, line, name, kind', [
        ('stall/fruit.go', 6, 'Fruit', 'Struct'),
        ('stall/fruit.go', 7, 'ByKind', 'Other'),
        ('stall/fruit.go', 8, 'Seller', 'Trait'),
        ('stall/fruit.go', 10, 'Sell', 'Function'),
        ('stall/fruit.go', 11, 'Arrange', 'Function'),
        ('till/ring.go', 9, 'Ring', 'Function'),
        ('till/tape/print.go', 3, 'Print', 'Function'),
    ]),
    "symbols_python": values('path, line, name, kind', [
        ('oven.py', 4, 'heat', 'Function'),
        ('pantry/label.py', 1, 'write', 'Function'),
        ('pantry/shelf.py', 5, 'Jar', 'Struct'),
        ('pantry/shelf.py', 9, 'stock', 'Function'),
        ('src/stove.py', 2, 'light', 'Function'),
    ]),
    "symbols_typescript": values('path, line, name, kind', [
        ('props/index.ts', 2, 'Sword', 'Struct'),
        ('stage/cast/index.tsx', 1, 'bow', 'Function'),
        ('stage/curtain.js', 1, 'open', 'Variable'),
        ('stage/lights.ts', 1, 'dim', 'Variable'),
        ('stage/lights.ts', 2, 'Lamp', 'Trait'),
        ('stage/main.tsx', 8, 'Act', 'Struct'),
        ('stage/main.tsx', 10, 'seats', 'Variable'),
        ('stage/main.tsx', 11, 'Row', 'Other'),
    ]),
    "symbols_csharp": values('path, line, name, kind', [
        ('Mill/Grinder.cs', 8, 'Grinder', 'Struct'),
        ('Mill/Grinder.cs', 9, 'Grind', 'Function'),
        ('Mill/Grinder.cs', 13, 'Flour', 'Struct'),
        ('Mill/Sacks.cs', 1, 'ISack', 'Trait'),
        ('Mill/Sacks.cs', 2, 'Size', 'Enum'),
        ('Mill/Stones/Upper.cs', 1, 'Upper', 'Struct'),
    ]),
    "imports_rust": values('path, line, text, "character"', [
        ('src/berth.rs', 1, 'crate::tide::Level', 4),
        ('src/crane/mod.rs', 1, 'hook', 4),
        ('src/crane/mod.rs', 2, 'super::berth::Berth', 8),
        ('src/crane/mod.rs', 3, 'crate::crane::hook::Hook', 4),
        ('src/lib.rs', 2, 'crane', 8),
        ('src/lib.rs', 3, 'berth', 4),
        ('src/lib.rs', 4, 'tide', 15),
    ]),
    "imports_go": values('path, line, text, "character"', [
        ('stall/fruit.go', 3, 'sort', 8),
        ('stall/fruit.go', 4, 'example.org/market/till', 8),
        ('till/ring.go', 4, 'os', 2),
        ('till/ring.go', 6, 'example.org/market/till/tape', 2),
    ]),
    "imports_python": values('path, line, text, "character"', [
        ('oven.py', 1, 'stove', 7),
        ('oven.py', 2, 'typing', 5),
        ('pantry/__init__.py', 1, '.shelf', 5),
        ('pantry/__init__.py', 2, '.', 5),
        ('pantry/shelf.py', 1, 'json', 7),
        ('pantry/shelf.py', 2, 'pantry.label', 7),
        ('pantry/shelf.py', 3, '..oven', 5),
    ]),
    "imports_typescript": values('path, line, text, "character"', [
        ('props/index.ts', 1, '../stage/lights', 21),
        ('stage/main.tsx', 1, './lights', 21),
        ('stage/main.tsx', 3, '../props', 8),
        ('stage/main.tsx', 4, './curtain', 8),
        ('stage/main.tsx', 6, './cast', 15),
    ]),
    "imports_csharp": values('path, line, text, "character"', [
        ('Mill/Grinder.cs', 2, 'Mill.Stones.Upper', 13),
        ('Mill/Grinder.cs', 3, 'Mill.Sacks', 6),
    ]),
    "resolve_rust": values('src, dst', [
        ('src/berth.rs', 'src/tide.rs'),
        ('src/crane/mod.rs', 'src/berth.rs'),
        ('src/crane/mod.rs', 'src/crane/hook.rs'),
        ('src/lib.rs', 'src/berth.rs'),
        ('src/lib.rs', 'src/crane/mod.rs'),
        ('src/lib.rs', 'src/tide.rs'),
    ]),
    "resolve_go": values('src, dst', [
        ('stall/fruit.go', 'till/open.go'),
        ('stall/fruit.go', 'till/ring.go'),
        ('till/ring.go', 'till/tape/print.go'),
    ]),
    "resolve_python": values('src, dst', [
        ('oven.py', 'src/stove.py'),
        ('pantry/__init__.py', 'pantry/__init__.py'),
        ('pantry/__init__.py', 'pantry/shelf.py'),
        ('pantry/shelf.py', 'oven.py'),
        ('pantry/shelf.py', 'pantry/label.py'),
    ]),
    "resolve_typescript": values('src, dst', [
        ('props/index.ts', 'stage/lights.ts'),
        ('stage/main.tsx', 'props/index.ts'),
        ('stage/main.tsx', 'stage/cast/index.tsx'),
        ('stage/main.tsx', 'stage/curtain.js'),
        ('stage/main.tsx', 'stage/lights.ts'),
    ]),
    "resolve_csharp": values('src, dst', [
        ('Mill/Grinder.cs', 'Mill/Sacks.cs'),
        ('Mill/Grinder.cs', 'Mill/Stones/Upper.cs'),
    ]),
    "call_sites": values('caller_file, caller_sym, callee_name, line', [
        ('src/berth.rs', 'fits', 'metres', 12),
        ('src/berth.rs', 'fits', 'tide_at', 11),
        ('src/crane/mod.rs', 'unload', 'grab', 10),
        ('src/crane/mod.rs', 'unload', 'unload_rest', 11),
        ('src/crane/mod.rs', 'unload', 'weigh', 11),
    ]),
    "call_resolution": values('caller_sym, callee_name, callee_file, resolved', [
        ('fits', 'metres', 'src/tide.rs', True),
        ('fits', 'tide_at', 'src/tide.rs', True),
        ('unload', 'grab', 'src/crane/hook.rs', True),
        ('unload', 'unload_rest', None, False),
        ('unload', 'weigh', None, False),
    ]),
    "harbour_hotspots": values('node, dependents', [
        ('src/berth.rs', 2),
        ('src/crane/hook.rs', 1),
        ('src/crane/mod.rs', 1),
        ('src/lib.rs', 0),
        ('src/tide.rs', 2),
    ]),
    "harbour_shortest_path": values('place, node', [
        (0, 'src/lib.rs'),
        (1, 'src/tide.rs'),
    ]),
    "harbour_reverse_map": values('path, depends_on, depended_by', [
        ('src/berth.rs', ['src/tide.rs'], ['src/crane/mod.rs', 'src/lib.rs']),
        ('src/crane/hook.rs', [], ['src/crane/mod.rs']),
        ('src/crane/mod.rs', ['src/berth.rs', 'src/crane/hook.rs'], ['src/lib.rs']),
        ('src/lib.rs', ['src/berth.rs', 'src/crane/mod.rs', 'src/tide.rs'], []),
        ('src/tide.rs', [], ['src/berth.rs', 'src/lib.rs']),
    ]),
    "harbour_conventions": values('package, tags, async_fn, has_tests', [
        ('crane', ['pub'], False, False),
        ('src', ['pub'], False, False),
    ]),
    "harbour_purposes": values('package, purpose', [
        ('crane', 'crane: Hook, Lifts, Tons (pub)'),
        ('src', 'src: Berth, Level, PIERS (pub)'),
    ]),
    "harbour_packages": values('repo, package, files', [
        ('harbour', 'crane', ['src/crane/hook.rs', 'src/crane/mod.rs']),
        ('harbour', 'src', ['src/berth.rs', 'src/lib.rs', 'src/tide.rs']),
        ('kitchen', 'pantry', ['pantry/__init__.py', 'pantry/label.py', 'pantry/shelf.py']),
        ('kitchen', 'root', ['oven.py']),
        ('kitchen', 'src', ['src/stove.py']),
        ('market', 'root', ['go.mod']),
        ('market', 'stall', ['stall/fruit.go']),
        ('market', 'till', ['till/open.go', 'till/ring.go', 'till/tape/print.go']),
        ('mill', 'Mill', ['Mill/Grinder.cs', 'Mill/Sacks.cs', 'Mill/Stones/Upper.cs']),
        ('theatre', 'props', ['props/index.ts']),
        ('theatre', 'stage', ['stage/cast/index.tsx', 'stage/curtain.js', 'stage/lights.ts', 'stage/main.tsx']),
    ]),
    "harbour_api_surface": values('package, exports, internal_count', [
        ('crane', ['Hook', 'Lifts', 'grab', 'lift', 'unload'], 2),
        ('src', ['Berth', 'Level', 'PIERS', 'crane', 'fits', 'metres', 'tide_at'], 3),
    ]),
    "harbour_hot_symbols": values('name, n', [
        ('Berth', 0),
        ('Hook', 0),
        ('Level', 0),
        ('Lifts', 0),
        ('PIERS', 0),
        ('Tons', 0),
        ('berth', 0),
        ('crane', 0),
        ('fits', 0),
        ('grab', 0),
    ]),
    "harbour_symbol_ids": values('id, p, n, l', [
        ('s1', 'p1', 'Berth', 4),
        ('s10', 'p4', 'crane', 2),
        ('s11', 'p4', 'berth', 3),
        ('s12', 'p4', 'tide', 4),
        ('s13', 'p4', 'PIERS', 6),
        ('s14', 'p5', 'Level', 1),
        ('s15', 'p5', 'tide_at', 3),
        ('s16', 'p5', 'metres', 7),
        ('s17', 'p5', 'knots', 8),
        ('s2', 'p1', 'fits', 9),
        ('s3', 'p2', 'Hook', 2),
        ('s4', 'p2', 'grab', 3),
        ('s5', 'p2', 'Tons', 4),
        ('s6', 'p3', 'hook', 1),
        ('s7', 'p3', 'Lifts', 5),
        ('s8', 'p3', 'lift', 6),
        ('s9', 'p3', 'unload', 9),
    ]),
}
