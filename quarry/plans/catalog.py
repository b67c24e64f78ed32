"""The index: all derived tables of a set of files, built, written and read again."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import paths
from quarry.operators import docs, extract, intel, packages, resolve, search
from quarry.sources import sinks
from quarry.sources.checkpoints import cut

TABLES = ("files", "symbols", "edges", "calls", "conventions", "purposes", "sections", "links")


@dataclass
class Catalog:
    """files (repo, path, content) and what follows from them; each table is made when it is first used, and kept."""

    files: DataFrame
    doc_files: DataFrame | None = None
    extra_edges: DataFrame | None = None

    @cached_property
    def symbols(self) -> DataFrame:
        return cut(extract.symbols(self.files))

    @cached_property
    def edges(self) -> DataFrame:
        found = resolve.resolve_imports(extract.imports(self.files), self.files)
        return cut(found if self.extra_edges is None else found.unionByName(self.extra_edges).distinct())

    @cached_property
    def calls(self) -> DataFrame:
        return cut(resolve.resolve_calls(extract.calls(self.files, self.symbols), self.symbols))

    @cached_property
    def conventions(self) -> DataFrame:
        return cut(packages.conventions(self.files))

    @cached_property
    def purposes(self) -> DataFrame:
        return packages.purposes(self.symbols, self.conventions)

    @cached_property
    def sections(self) -> DataFrame:
        return docs.sections(self.files.limit(0) if self.doc_files is None else self.doc_files)

    @cached_property
    def links(self) -> DataFrame:
        return docs.links(self.sections, self.files, self.symbols)

    def file_entries(self) -> DataFrame:
        """(repo, path, symbols, depends_on, depended_by)"""
        own = self.symbols.groupBy("repo", "path").agg(F.array_sort(F.collect_list(F.struct("line", "name", "kind", "signature"))).alias("symbols"))
        return self.files.select("repo", "path").join(own, ["repo", "path"], "left").join(resolve.reverse_map(self.edges), ["repo", "path"], "left")

    def search_docs(self) -> DataFrame:
        """(doc_id, kind, name, detail, hint, path, text): packages, files, symbols and hot symbols."""
        p = self.purposes.select(F.concat(F.lit("P:"), "package").alias("doc_id"), F.lit("package").alias("kind"), F.col("package").alias("name"), F.col("purpose").alias("detail"), F.lit("open the package").alias("hint"), F.lit(None).cast("string").alias("path"), F.concat_ws(" ", "package", "purpose").alias("text"))
        f = self.files.select(F.concat(F.lit("F:"), "path").alias("doc_id"), F.lit("file").alias("kind"), F.col("path").alias("name"), paths.package(F.col("path")).alias("detail"), F.lit("open the file").alias("hint"), "path", F.col("path").alias("text"))
        s = self.symbols.select(F.format_string("S:%s:%d:%s", "path", "line", "name").alias("doc_id"), F.lit("symbol").alias("kind"), "name", F.col("signature").alias("detail"), F.format_string("%s:%d", "path", "line").alias("hint"), "path", F.concat_ws(" ", "name", "signature", "path").alias("text"))
        h = packages.hot_symbols(self.symbols).select(F.concat(F.lit("H:"), "name").alias("doc_id"), F.lit("hot_symbol").alias("kind"), "name", F.lit("").alias("detail"), F.lit("look the symbol up").alias("hint"), F.lit(None).cast("string").alias("path"), F.col("name").alias("text"))
        return p.unionByName(f).unionByName(s).unionByName(h)

    def index(self) -> search.Index:
        return search.build(cut(self.search_docs()))

    def query(self, question: str, active: list[str] | None = None, limit: int = 10) -> DataFrame:
        from quarry.operators import graph

        return search.with_proximity(self.index(), question, graph.hop_scores(self.edges, active or []), limit)

    def drill(self, package: str, repo: str | None = None) -> DataFrame:
        """A package's files with their symbols; `repo/package` names one of a repo."""
        if repo is None and "/" in package:
            repo, package = package.split("/", 1)
        rows = self.file_entries().where(paths.package(F.col("path")) == package)
        return rows.where(F.col("repo") == repo) if repo else rows

    def focus(self, path: str, radius: int = 2) -> DataFrame:
        return intel.focus(self.edges, self.symbols, path, radius)

    def status(self, indexed: DataFrame) -> DataFrame:
        """(path, reason) of files that the index lags behind; files must have mtime."""
        from quarry.sources.repos import stale_files

        return stale_files(self.files, indexed)

    def report(self, name: str) -> str:
        return sinks.report(name, self.files, self.symbols, self.edges, packages.summaries(self.files), self.purposes, packages.hot_symbols(self.symbols))

    def write(self, folder: str) -> None:
        """Writes all tables to a folder that isn't read. What hasn't been made yet comes from the files as written, so that whatever they come from runs once."""
        sinks.write_table(self.files, folder, "files")
        made = replace(self, files=self.files.sparkSession.read.schema(self.files.schema).parquet(f"{folder}/files"))
        made.__dict__.update({t: self.__dict__[t] for t in TABLES if t in self.__dict__ and t != "files"})
        for t in TABLES[1:]:
            sinks.write_table(getattr(made, t), folder, t)

    @classmethod
    def read(cls, spark: SparkSession, folder: str) -> Catalog:
        """The index as written; a table that is missing or can't be read is empty, with its usual columns."""
        made = cls(spark.read.parquet(f"{folder}/files"))
        none = cls(made.files.limit(0))
        for t in TABLES[1:]:
            # a read table takes the place of the plan
            try:
                made.__dict__[t] = spark.read.parquet(f"{folder}/{t}")
            except AnalysisException:
                made.__dict__[t] = getattr(none, t)
        return made
