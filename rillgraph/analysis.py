"""An analysis run by its options: the operators with the limits, rules and files that AnalysisConfig names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rillgraph.config import AnalysisConfig
from rillgraph.operators import callgraph, checkers, contexts, pointsto, reach, valueflow
from rillgraph.sources import readers


class Analysis:
    """Operators bound to options."""

    def __init__(self, spark: SparkSession, config: AnalysisConfig) -> None:
        self.spark, self.config = spark, config

    def blacklist(self, functions: DataFrame) -> DataFrame | None:
        """Functions (func) that slices leave out: those whose name holds a part of the file cg_ignore; None without one."""
        return callgraph.named_like(functions, readers.names(self.spark, self.config.cg_ignore)) if self.config.cg_ignore else None

    def context(self, edges: DataFrame, roots: DataFrame, depth: int = 1000) -> DataFrame:
        """(root, func): each interface function's slice, at the largest depth that keeps fewer functions than func_limit."""
        named = edges.select(edges["callee"].alias("func")).distinct()
        return contexts.reduced(edges, roots, self.config.func_limit, depth, self.blacklist(named))

    def groups(self, members: DataFrame) -> DataFrame:
        """(level, context, grp): initcalls grouped within func_limit members."""
        return contexts.grouped(members, self.config.func_limit)

    def points_to(self, addr: DataFrame, copy: DataFrame, **facts) -> tuple[DataFrame, DataFrame]:
        """pointsto.andersen() with at most indCallLimit indirect call edges a round, none if that is 0."""
        return pointsto.andersen(addr, copy, call_limit=self.config.indCallLimit or None, **facts)

    def aliases(self, verdicts: DataFrame) -> DataFrame:
        """The verdicts (a, b, alias) of several analyses as one, by alias_rule."""
        return pointsto.combined(verdicts, self.config.alias_rule)

    def flows(self, edges: DataFrame, sources: DataFrame, sinks: DataFrame | None = None) -> DataFrame:
        """(source, node, ctx): reach.forward() with call strings of cxtlimit sites."""
        return reach.forward(edges, sources, sinks, limit=self.config.cxtlimit)

    def graph(self, edges: DataFrame, nodes: DataFrame) -> DataFrame:
        """Value-flow edges, without those to dereferenced addresses if rm_deref asks for that."""
        return valueflow.without_dereferences(edges, nodes) if self.config.rm_deref else edges

    def unknown(self, sources: DataFrame) -> DataFrame:
        """Sources (file_name, func_name, line) that the file import_bugs does not know."""
        return readers.without_known(sources, readers.known_bugs(self.spark, self.config.import_bugs)) if self.config.import_bugs else sources

    def check(self, sources: DataFrame, paths: DataFrame, relation: DataFrame, guards: DataFrame | None = None, api: DataFrame | None = None) -> DataFrame:
        """checkers.FOUND of the checkers asked for; with path_sens, paths whose guards (source, node, some_path) can't hold are left out first."""
        if self.config.path_sens and guards is not None:
            paths = checkers.possible(paths, guards)
        return checkers.run(self.config, sources, paths, relation, api)

    def use_after_return(self, edges: DataFrame, locals_: DataFrame, funcs: DataFrame, pointers: DataFrame) -> dict[str, DataFrame]:
        """(local, pointer) by name of the use-after-return checkers asked for: call strings of 10 sites in full, of cxtlimit in the light one."""
        limits = {"use_after_return": 10, "use_after_return_lite": self.config.cxtlimit}
        return {c: valueflow.use_after_return(edges, locals_, funcs, pointers, limit=n) for c, n in limits.items() if c in self.config.checkers}
