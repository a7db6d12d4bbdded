"""AnalysisSession: from files(path, content) to functions, bindings, edges, trees and scenarios.

Every table is a lazily built DataFrame; the front end's rows and the pattern scan are written once to the shared
folder, as several tables derive from them.
"""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runpath import fixed
from runpath.functions import text as T
from runpath.functions import values as V
from runpath.operators import design as D
from runpath.operators import graph as G
from runpath.operators import patterns as P
from runpath.operators import points_to as PT
from runpath.operators import relational as R
from runpath.operators import views
from runpath.operators.storage import checkpoint
from runpath.operators.types_db import TypeDatabase
from runpath.sources import c_front
from runpath.sources.files import Scenario, knowledge

BY = ("path",)


class AnalysisSession:
    """strict_ref reproduces the end line of a function as its first line and operation tables without nested braces."""

    def __init__(self, spark: SparkSession, files: DataFrame, strict_ref: bool = False):
        self.spark, self.given, self.strict_ref = spark, files.select("path", "content"), strict_ref

    @cached_property
    def files(self) -> DataFrame:
        """The files, which are read several times; where they come in fewer partitions than there are cores, they are dealt out once."""
        cores = self.spark.sparkContext.defaultParallelism
        return self.given if self.given.rdd.getNumPartitions() >= cores else checkpoint(self.given.repartition(cores))

    @cached_property
    def symbols(self) -> DataFrame:
        return checkpoint(c_front.symbols(self.files))

    @cached_property
    def defined(self) -> DataFrame:
        """Functions as read: (path, name, line, end_line, return_type, params, attributes, calls)."""
        f = self.symbols.where("kind = 'function'").select("path", "name", "line", "end_line", "return_type", "params", "attributes", "calls")
        return f.withColumn("end_line", F.col("line")) if self.strict_ref else f

    @cached_property
    def structs(self) -> DataFrame:
        return self.symbols.where("kind = 'struct'").select("path", "name", "line", "end_line", "fields", F.col("refs").alias("referenced_structs"))

    @cached_property
    def errors(self) -> DataFrame:
        return self.symbols.where("kind = 'error'").select("path", "error")

    @cached_property
    def facts(self) -> DataFrame:
        """Callback facts and functions, for which each file is read once."""
        return checkpoint(c_front.facts_and_functions(self.files))

    @cached_property
    def lines(self) -> DataFrame:
        return P.lines_of(self.files)

    @cached_property
    def matches(self) -> DataFrame:
        """Matches of all asynchronous patterns, from one pass over the lines."""
        return checkpoint(P.async_scan(self.lines))

    @cached_property
    def bound(self) -> DataFrame:
        return P.bindings_in(self.matches, self.defined)

    @cached_property
    def triggers(self) -> DataFrame:
        return P.triggers_in(self.matches)

    @cached_property
    def matched(self) -> DataFrame:
        """Bindings with each of their trigger lines."""
        return checkpoint(P.match_triggers(self.bound, self.triggers))

    @cached_property
    def bindings(self) -> DataFrame:
        """(path, pattern_id, nth, mechanism, flag, context, variable, handler, line, trigger_lines)."""
        key = ["path", "pattern_id", "nth", "variable", "handler", "line"]
        hits = self.matched.groupBy(*key).agg(F.sort_array(F.collect_set("trigger_line")).alias("trigger_lines"))
        return self.bound.join(hits, key, "left").withColumn("trigger_lines", F.coalesce("trigger_lines", F.array().cast("array<int>")))

    def async_listing(self) -> DataFrame:
        """(path, handler, icon, mechanism, context, variable, line): bindings with what their handlers may do (M3)."""
        return self.bound.select("path", "handler", T.mechanism_icon("mechanism", "flag").alias("icon"), T.mechanism_text("mechanism", "flag").alias("mechanism"), T.context_text("context").alias("context"), "variable", "line")

    @cached_property
    def ops(self) -> DataFrame:
        return P.ops_mappings(self.spark, P.ops_initializers(self.files, nested=not self.strict_ref), self.defined)

    @cached_property
    def pointer_bindings(self) -> DataFrame:
        """Operation tables and assignments to members."""
        return P.pointer_bindings(self.ops, P.assignments(self.files, self.defined))

    @cached_property
    def functions(self) -> DataFrame:
        """Defined functions with is_callback and callback_context: the last mechanism counts, and a table's field wins over it."""
        mech = F.concat(F.lit("async_"), T.mechanism_text("mechanism", "flag"))
        by_mech = self.bound.groupBy("path", F.col("handler").alias("name")).agg(F.max_by(mech, F.struct("pattern_id", "nth", "line")).alias("async_ctx"))
        last = F.max_by(F.struct(F.concat_ws(".", "var_name", "field").alias("ctx"), F.concat_ws(".", "ops_type", "field").alias("framework")), "ord").alias("o")
        by_ops = self.ops.groupBy("path", F.col("function").alias("name")).agg(last)
        out = self.defined.join(by_mech, ["path", "name"], "left").join(by_ops, ["path", "name"], "left")
        ctx = F.coalesce("o.ctx", "async_ctx")
        return out.withColumns({"callback_context": ctx, "framework": F.col("o.framework"), "is_callback": ctx.isNotNull(), "is_static": F.array_contains("attributes", "static")}).drop("o", "async_ctx")

    @cached_property
    def edges(self) -> DataFrame:
        """(path, src, dst, call_type, line, mechanism) (G1)."""
        direct = G.call_edges(self.defined, BY).select("path", "src", "dst", F.lit("Direct").alias("call_type"), F.lit(None).cast("int").alias("line"), F.lit(None).cast("string").alias("mechanism"))
        found = P.async_edges(self.matched, self.defined)
        return direct.union(found.select("path", "src", "dst", F.lit("Async").alias("call_type"), "line", "mechanism"))

    def unified_edges(self) -> DataFrame:
        """Edges in the kinds that all languages share."""
        kind = F.when(F.col("call_type") == "Direct", "Direct").when(F.col("mechanism") == "WorkQueue", "KernelWorkQueue").otherwise("Generic")
        return G.unify_edges(self.edges.withColumn("call_type", kind))

    @cached_property
    def entry_points(self) -> DataFrame:
        """(path, ord, name) of each file."""
        return G.entry_points(self.functions, P.module_entries(self.files), BY)

    @cached_property
    def user_trees(self) -> DataFrame:
        """Trees from the entry points of all files."""
        known = self.defined.select("path", "name")
        roots = self.entry_points.join(known, ["path", "name"], "left_semi")
        return G.flow_tree(self.spark, self.edges.select("path", "src", "dst"), roots, known, by=BY)

    @cached_property
    def shared_trees(self) -> DataFrame:
        """The trees of all files with equal subtrees once, for sizes and paths of trees of any number of places."""
        known = self.defined.select("path", "name")
        return G.shared_tree(self.spark, self.edges.select("path", "src", "dst"), self.entry_points.join(known, ["path", "name"], "left_semi"), known, by=BY)

    def chain_entries(self) -> DataFrame:
        """(path, root, chain_id): by the operation table's type and field, else by the mechanism of the handler."""
        chains = knowledge(self.spark)["chains"].select("chain_id").distinct()
        names = F.create_map(*(F.lit(x) for kv in fixed.MECHANISM_CHAIN.items() for x in kv))
        by_ops = self.functions.select("path", F.col("name").alias("root"), F.col("framework").alias("chain_id")).join(F.broadcast(chains), "chain_id", "left_semi")
        first = self.bound.withColumn("chain_id", F.try_element_at(names, F.col("mechanism"))).where("chain_id is not null").groupBy("path", F.col("handler").alias("root"))
        by_mech = first.agg(F.min_by("chain_id", F.struct("pattern_id", "nth", "line")).alias("chain_id"))
        rest = by_mech.join(by_ops.select("path", "root"), ["path", "root"], "left_anti").select("path", "root", "chain_id")
        return by_ops.select("path", "root", "chain_id").unionByName(rest)

    @cached_property
    def trees(self) -> DataFrame:
        """Trees of all files with the kernel chains above roots that have one."""
        return G.inject_chain(self.user_trees, knowledge(self.spark)["chains"], self.chain_entries(), BY)

    def flow_trees(self, path: str) -> DataFrame:
        """Trees of one file; entry_function is the function that a tree belongs to, whatever stands at its top."""
        return self.trees.where(F.col("path") == path).drop("path").withColumn("entry_function", F.col("root"))

    def constraints(self) -> DataFrame:
        return c_front.constraints(self.files)

    @cached_property
    def flow(self) -> DataFrame:
        """Functions, constraints and arguments, for which each file is read once."""
        return checkpoint(c_front.flow(self.files))

    def _flow_constraints(self) -> DataFrame:
        return self.flow.where("kind not in ('function', 'argument')").select("path", "kind", "dest", "src", "field")

    def _flow_functions(self) -> DataFrame:
        return self.flow.where("kind = 'function'").select("path", "name").distinct()

    def points_to(self) -> DataFrame:
        """(path, loc, targets): functions that may be called through each location, file by file."""
        return PT.function_targets(PT.solve(self._flow_constraints(), self._flow_functions(), by=BY), BY)

    def flow_of_arguments(self) -> DataFrame:
        """Constraints with those that calls add, from arguments to parameters."""
        defined = self.flow.where("kind = 'function'").select("path", F.col("name").alias("function"), F.posexplode("params").alias("position", "p"))
        names = defined.select("path", "function", "position", F.col("p.name").alias("name"))
        return self._flow_constraints().unionByName(D.parameter_flow(self.flow.where("kind = 'argument'").select("path", "callee", "position", "argument"), names, BY))

    def targets_with_confidence(self) -> DataFrame:
        """(path, loc, target, confidence): what may be called through each location, arguments counted, with the best confidence of a way to it."""
        pts = PT.solve_with_confidence(self.flow_of_arguments(), self._flow_functions(), by=BY)
        return pts.where(T.is_function_target("target"))

    def resolved_callbacks(self) -> DataFrame:
        """(path, expr, handlers): handlers of the indirect calls of each file."""
        facts = checkpoint(c_front.callback_facts(self.files))
        bound, calls = facts.where("fact = 'binding'"), facts.where("fact = 'invocation'")
        return R.resolve_invocations(bound.select("path", "target", F.col("name").alias("handler")), calls.select("path", F.col("target").alias("expr")), BY)

    def types(self) -> TypeDatabase:
        """Function-pointer types and signatures of all files."""
        return self._types_of(checkpoint(c_front.pointer_types(self.files)))

    def _types_of(self, t: DataFrame) -> TypeDatabase:
        return TypeDatabase.empty(self.spark).add_types(t.where("kind <> 'Function'")).add_functions(t.where("kind = 'Function'"))

    def compatible(self) -> DataFrame:
        return self.types().compatible()

    def details(self) -> DataFrame:
        return views.function_details(self.functions, self.edges)

    def summary(self) -> DataFrame:
        """(path, functions, structs, async_bindings, entries) of each file (A4, K7)."""
        n = lambda df, c: df.groupBy("path").agg(F.count("*").alias(c))
        entries = self.entry_points.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "name"))), lambda e: e["name"]).alias("entries"))
        out = self.files.select("path").join(n(self.defined, "functions"), "path", "left").join(n(self.structs, "structs"), "path", "left").join(n(self.bound, "async_bindings"), "path", "left").join(entries, "path", "left")
        zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
        return out.select("path", zero("functions"), zero("structs"), zero("async_bindings"), F.coalesce("entries", F.array().cast("array<string>")).alias("entries"))

    def summary_text(self) -> DataFrame:
        """(path, text): the summary as JSON (K7)."""
        return self.summary().select("path", F.to_json(F.struct("path", "functions", "structs", "async_bindings", "entries")).alias("text"))

    def swim_lanes(self) -> DataFrame:
        """(path, root, ord, function, lane) of all entries with a kernel chain."""
        return D.lanes_of(self.chain_entries(), knowledge(self.spark)["chains"])

    def timeline(self) -> DataFrame:
        """(path, handler, phase, name, first_function, context) of all bindings whose mechanism has phases."""
        kb = knowledge(self.spark)
        names = F.create_map(*(F.lit(x) for kv in fixed.MECHANISM_CHAIN.items() for x in kv))
        return D.async_timeline(self.bound, kb["timeline"], kb["chains"], F.try_element_at(names, F.col("mechanism")))

    def phases(self) -> DataFrame:
        """(phase, n): rows of each phase of the project's analysis."""
        return reduce(DataFrame.union, (rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("phase"), "n") for name, rows in self.project().items()))

    def project(self) -> dict[str, DataFrame]:
        """The phases of a project's analysis by name: symbols, types, calls, async, bridges."""
        if "symbols" in self.__dict__:
            t = self.types()
        else:  # neither is there: each file is read once for both
            self.symbols, found = c_front.symbols_and_types(self.files)
            t = self._types_of(found)
        natives = self.defined.where(F.col("name").startswith("Java_")).select(F.col("name"))
        return {"symbols": self.symbols, "types": t.types, "signatures": t.functions, "calls": self.unified_edges(), "async": self.bindings, "natives": natives}


def run_scenario(tree: DataFrame, scenario: Scenario) -> DataFrame:
    """States of a run over the tree of its entry function.

    (step, function, depth, reachable, description, variables): one row for each node down to max_depth, in depth-first
    order.  A node whose name stands for a condition that is always false is unreachable, with all below it.
    """
    rows = tree.where((F.col("root") == scenario.entry_function) & (F.col("depth") <= scenario.max_depth))
    if not scenario.show_kernel_api:
        rows = rows.where("node_type <> 'KernelApi'")
    # The bindings are constants, so they are parsed once for all rows.
    parsed = tree.sparkSession.range(1).select(F.array(*(V.parse_symbolic(F.lit(t), F.lit(h)) for t, h in scenario.bindings.values())).alias("v")).first().v if scenario.bindings else []
    values = {k: V.literal(v) for k, v in zip(scenario.bindings, parsed, strict=True)}

    def condition(name):
        hinted = name.contains("if_") | name.contains("_check")
        null, valid = name.contains("_null"), name.contains("_valid")
        drop = lambda parts: reduce(lambda t, p: F.replace(t, F.lit(p), F.lit("")), parts, name)
        path = F.when(null, drop(["if_", "_null", "_check"])).otherwise(drop(["if_", "_valid", "_not_null", "_check"]))
        return F.struct((hinted & (null | valid)).alias("tests"), path.alias("path"), null.alias("null"))

    off = F.exists(F.transform("trail", condition), lambda c: c["tests"] & (V.null_check(c["path"], ~c["null"], values) == "AlwaysFalse"))
    shown = F.array(*(F.concat(F.lit(f"{k}="), V.display(v)) for k, v in sorted(values.items()))) if values else F.array().cast("array<string>")
    parts = F.concat(F.when(F.col("off"), F.array(F.lit("[unreachable]"))).otherwise(F.array().cast("array<string>")), shown)
    table = F.create_map(*(x for k, v in values.items() for x in (F.lit(k), V.display(v)))) if values else F.create_map().cast("map<string,string>")
    order = R.Window.partitionBy("root").orderBy("ord")
    marked = rows.withColumn("off", off)
    return marked.select(F.row_number().over(order).alias("step"), F.col("node").alias("function"), "depth", (~F.col("off")).alias("reachable"), F.array_join(parts, " | ").alias("description"), table.alias("variables"))


def snapshot(states: DataFrame, step: int, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, name, value): the variables after one step of states(*by, step, variables), to go on from there (ST8)."""
    return states.where(F.col("step") == step).select(*by, F.explode("variables").alias("name", "value"))


def restore(states: DataFrame, saved: DataFrame, step: int, by: tuple[str, ...] = ()) -> DataFrame:
    """states up to a step, whose variables are those of a snapshot(*by, name, value) again (ST8); a run without one has none then."""
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value"))))  # one run's variables
    kept = states.where(F.col("step") <= step)
    old = saved.groupBy(*by).agg(entries.alias("__saved"))
    joined = kept.join(old, list(by), "left") if by else kept.join(F.broadcast(old))
    none = F.create_map().cast("map<string,string>")
    return joined.withColumn("variables", F.when(F.col("step") == step, F.coalesce("__saved", none)).otherwise(F.col("variables"))).drop("__saved")
