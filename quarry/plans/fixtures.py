"""Small code corpora for queries whose tables the driver doesn't have."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: (repo, path, content)
FILES: tuple[tuple[str, str, str], ...] = (
    ("harbour", "src/lib.rs", """//! Berths, cranes and the tide.
pub mod crane;
mod berth;
pub(crate) mod tide;

pub const PIERS: usize = 4;
"""),
    ("harbour", "src/berth.rs", """use crate::tide::Level;
use std::fmt;

pub(crate) struct Berth {
    depth: u32,
}

impl Berth {
    pub fn fits(&self, draught: u32, hour: u32) -> bool {
        // the tide adds to the depth
        let level = tide_at(hour);
        metres(level) + self.depth > draught
    }
}
"""),
    ("harbour", "src/crane/mod.rs", """mod hook;
pub use super::berth::Berth;
use crate::crane::hook::Hook;

pub trait Lifts {
    fn lift(&mut self, tons: u32);
}

pub async unsafe fn unload(ship: &str) -> u32 {
    let hook = grab(ship);
    weigh(hook) + unload_rest(ship)
}
"""),
    ("harbour", "src/crane/hook.rs", """#[derive(Debug)]
pub struct Hook(u32);
pub fn grab(ship: &str) -> Hook { Hook(count(ship)) }
type Tons = u32;
"""),
    ("harbour", "src/tide.rs", """pub enum Level { High, Low }

pub fn tide_at(hour: u32) -> Level {
    if hour % 12 < 6 { Level::High } else { Level::Low }
}

pub fn metres(level: Level) -> u32 { match level { Level::High => 3, Level::Low => 0 } }
macro_rules! knots { ($x:expr) => { $x * 2 } }
"""),
    ("market", "go.mod", "\nmodule example.org/market\n"),
    ("market", "stall/fruit.go", """package stall

import "sort"
import "example.org/market/till"

type Fruit struct { Kind string }
type ByKind []Fruit
type Seller interface { Sell() }

func (f *Fruit) Sell() { till.Ring(f.Kind) }
func Arrange(all []Fruit) { sort.Sort(ByKind(all)) }
"""),
    ("market", "till/ring.go", """package till

import (
	"os"

	"example.org/market/till/tape"
)

func Ring(kind string) { tape.Print(os.Stdout, kind) }
"""),
    ("market", "till/open.go", "package till\n\nvar drawer bool\n"),
    ("market", "till/tape/print.go", "package tape\n\nfunc Print(to any, kind string) {}\n"),
    ("kitchen", "pantry/__init__.py", "from .shelf import Jar\nfrom . import label\n"),
    ("kitchen", "pantry/shelf.py", """import json
import pantry.label
from ..oven import heat

class Jar:
    def open(self):
        return heat(self)

async def stock(n):
    return [Jar() for _ in range(n)]
"""),
    ("kitchen", "pantry/label.py", "def write(text):\n    print(text)\n    return shout(text)\n"),
    ("kitchen", "src/stove.py", "# from fake import nothing\ndef light(): pass\n"),
    ("kitchen", "oven.py", "import stove\nfrom typing import Any\n\ndef heat(x: Any):\n    light()\n    return x\n"),
    ("theatre", "stage/main.tsx", """import { dim } from "./lights";
import * as props
  from '../props';
import "./curtain";
import fs from 'fs';
export * from './cast';

export abstract class Act {}
export default function* play() { dim(0.5); }
let seats = 200;
export type Row = number[];
"""),
    ("theatre", "stage/lights.ts", "export const dim = (level: number) => level;\nexport default interface Lamp { watts: number }\n"),
    ("theatre", "stage/curtain.js", "var open = false;\n"),
    ("theatre", "stage/cast/index.tsx", "export async function bow() {}\n"),
    ("theatre", "props/index.ts", "import { dim } from '../stage/lights';\nexport class Sword {}\n"),
    ("mill", "Mill/Grinder.cs", """using System.Linq;
using static Mill.Stones.Upper;
using Mill.Sacks;
using Ext = Other.Name;

namespace Mill;

[Serializable] public sealed class Grinder {
    internal static async Task<int> Grind(int kilos) {
        return Pour(kilos);
    }
}
public readonly struct Flour { }
"""),
    ("mill", "Mill/Sacks.cs", "public interface ISack { }\npublic enum Size { Small, Large }\n"),
    ("mill", "Mill/Stones/Upper.cs", "internal record Upper(int Weight);\n"),
)

#: (path, content) of documentation
DOCS: tuple[tuple[str, str], ...] = (
    ("manual/harbour.md", """# Harbour

How grab and tide_at work.

## Moving ships

See src/berth.rs, then src/pilot.rs.

## Lifting
<!-- quarry: src/crane/hook.rs -->
### Weights
about weigh and metres
"""),
    ("manual/notes.md", "Only a note on unload, without a heading.\n"),
)

DIFF = """diff --git a/src/tide.rs b/src/tide.rs
index 1111111..2222222 100644
--- a/src/tide.rs
+++ b/src/tide.rs
@@ -2,0 +3,3 @@ pub enum Level
+pub fn tide_at(hour: u32) -> Level {
+    if hour < 6 { Level::High } else { Level::Low }
+}
@@ -5,2 +6 @@
-old
-older
+
diff --git a/src/crane/hook.rs b/src/crane/hook.rs
--- a/src/crane/hook.rs
+++ b/src/crane/hook.rs
@@ -5,3 +4,0 @@ type Tons
-a
-b
-c
diff --git a/src/old.rs b/src/old.rs
deleted file mode 100644
--- a/src/old.rs
+++ /dev/null
@@ -1 +0,0 @@
-x
"""

#: (path, content) of fragments for the security checks: one check each, then several in one file, then none
FRAGMENTS: tuple[tuple[str, str], ...] = (
    ("product.c", "  rows = malloc(height * sizeof(long));"),
    ("array.c", "cells = calloc(width, height);"),
    ("grow.c", "buf = realloc(buf, used * 2);"),
    ("shifted.c", "page = malloc(order << 12);"),
    ("less.c", "tail = malloc(size - 16);"),
    ("share.c", "part = malloc(total / workers);"),
    ("copies.c", "memset(out, 0, blocks * sizeof(double));"),
    ("unit.c", "flag = malloc(n * 1);"),
    ("opaque.c", "list = malloc(n * sizeof(struct node));"),
    ("loose.c", "mix = malloc(rows() * 8);"),
    ("room.rs", "let v: Vec<u64> = Vec::with_capacity(items * 8);"),
    ("print.c", 'printf(title);\nprintf("%s", title);\nfprintf(log, line);'),
    ("shell.py", "subprocess.run(command)\nos.system(command)"),
    ("state.py", "import yaml\nstate = yaml.load(text)\n"),
    ("file.py", 'target = folder + "../shared"\nhandle = open(target)\n'),
    ("login.py", "password = 'correct-horse'\n"),
    ("both.c", "a = malloc(x * 4);\nb = malloc(y - 1);\n"),
    ("fixed.c", "p = malloc(16 * sizeof(int));"),
    ("sum.c", "return left + right;"),
)


def files(spark: SparkSession, *repos: str) -> DataFrame:
    rows = [f for f in FILES if not repos or f[0] in repos]
    return spark.createDataFrame(rows, "repo string, path string, content string")


def docs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("harbour", p, c) for p, c in DOCS], "repo string, path string, content string")


def fragments(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(FRAGMENTS), "path string, content string")


def values(columns: str, rows: list[tuple]) -> str:
    """A query of literal rows, for the oracles."""

    def literal(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).upper()
        if isinstance(v, list):
            return "[" + ", ".join(map(literal, v)) + "]" + ("::VARCHAR[]" if not v else "")
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) v({columns})"
