"""Source files to code-graph nodes, as a Spark job over a corpus ``(path, source)``.

Files are parsed in Python workers, which only list what each file says: definitions, base classes,
calls, imports and assignments. Finding the definition a call refers to is done with joins over the
whole corpus: first a definition visible in the same file, then an imported one, whether directly
or passed on by other files, each with what classes have from their ancestors; then a method of the
class that the called object is an instance of; last the only definition with that name in the
corpus. The result has the input layout of ``operators.export``.

A module body and a class body count as methods, so calls outside of functions have a caller and
creating an object is a call to its class. A definition is named ``path:<module>.Class.method``.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from switchboard.operators.receivers import typed_targets
from switchboard.operators.resolve import GUESSED, find, known_names, node_id, overriders
from switchboard.operators.skew import (
    STORED_CODEC,
    find_heavy_keys,
    skew_join,
    stored,
    write_shuffled,
)
from switchboard.schema import UNKNOWN_NAME
from switchboard.session import steps_folder
from switchboard.sources import python_facts
from switchboard.sources.python_facts import FACTS_SCHEMA, read_facts

# The parsing helper travels with the job, so workers need no copy of this package.
cloudpickle.register_pickle_by_value(python_facts)

# Open files of a task that writes facts: as many as there are kinds.
OPEN_FILES_CONF = "spark.sql.maxConcurrentOutputFileWriters"
OPEN_FILES = 8
# Every open file holds a row group in memory.
FACTS_ROW_GROUP = 16 << 20

# The kinds of facts by which names are known; the others are calls and what variables hold.
NAMING = ["def", "base", "import", "public", "error"]

# Rank of methods that may run in place of the one that was found, nearest classes first.
BY_OVERRIDE = GUESSED + 1


@dataclass(frozen=True)
class CodeNodes:
    method_nodes: DataFrame
    call_sites: DataFrame
    call_targets: DataFrame
    errors: DataFrame


def read_corpus_facts(corpus: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """The facts of every file, parsed where the file is read; of the given kinds, or all."""
    def run(batches):
        return read_facts(batches, kinds)

    return corpus.select("path", "source").mapInArrow(run, FACTS_SCHEMA)


def write_facts(corpus: DataFrame, path: str, kinds: list[str] | None = None) -> DataFrame:
    """Parse every file once, keep the facts as a table by kind, and read it back."""
    spark = corpus.sparkSession
    # A file per kind is open in a task, so that its facts need not be sorted by kind.
    if int(spark.conf.get(OPEN_FILES_CONF, "0")) < OPEN_FILES:
        spark.conf.set(OPEN_FILES_CONF, str(OPEN_FILES))
    facts = read_corpus_facts(corpus, kinds)
    options = {"compression": STORED_CODEC, "parquet.block.size": FACTS_ROW_GROUP}
    writer = facts.write.mode("overwrite").options(**options).partitionBy("kind")
    write_shuffled(writer, spark, path)
    return spark.read.schema(FACTS_SCHEMA).parquet(path)


def extract(corpus: DataFrame, work_path: str) -> CodeNodes:
    """Nodes of a corpus. ``work_path`` gets the two tables that are used more than once: the
    parsed facts and the resolved call targets. The tables of the steps between are deleted."""
    spark = corpus.sparkSession
    facts = write_facts(corpus, f"{work_path}/facts")
    targets_path = f"{work_path}/call_targets"
    with steps_folder(spark, f"{work_path}/steps"):
        nodes = nodes_from_facts(facts)
        writer = nodes.call_targets.write.mode("overwrite").option("compression", STORED_CODEC)
        write_shuffled(writer, spark, targets_path)
    return replace(nodes, call_targets=spark.read.parquet(targets_path))


def _definitions(facts: DataFrame) -> DataFrame:
    return facts.where(F.col("kind") == "def").select(
        node_id("path", "ord").alias("method_id"),
        F.concat_ws(":", "path", "qualname").alias("full_name"),
        "name",
        F.col("written").alias("signature"),
        "path",
        "ord",
        "is_class",
    )


def method_nodes(facts: DataFrame) -> DataFrame:
    path = F.col("path")
    return _definitions(facts).select(
        "method_id", "full_name", "signature", path.alias("file_name"), path.alias("filename")
    )


def errors(facts: DataFrame) -> DataFrame:
    return facts.where(F.col("kind") == "error").select("path", F.col("written").alias("error"))


def nodes_from_facts(facts: DataFrame) -> CodeNodes:
    """Nodes from written facts, which are read several times."""
    definitions = _definitions(facts)
    calls = facts.where(F.col("kind") == "call").select(
        F.concat(F.lit("c"), node_id("path", "ord")).alias("call_id"),
        node_id("path", "owner").alias("caller_id"),
        "path",
        "line",
        "name",
        "written",
        "lookups",
        "may_guess",
        "receiver",
        "holder",
        "own",
        "held",
    )
    call_sites = calls.select(
        "call_id",
        "caller_id",
        F.coalesce("written", F.lit(UNKNOWN_NAME)).alias("method_full_name"),
        F.col("line").alias("line_number"),
    )
    # The keys calls are joined on end in the called name, so only names called very often can
    # make a key heavy.
    heavy = find_heavy_keys(facts.where(F.col("kind") == "call"), "name")
    names = known_names(facts, definitions, heavy)
    refs = calls.select(F.col("call_id").alias("ref"), "path", "name", "written", "lookups", "own")
    known = stored(find(refs, names), "named-targets")
    targets = known.select(
        F.col("ref").alias("call_id"), "target_ord", F.col("target_id").alias("callee_id")
    )
    targets = targets.unionByName(typed_targets(facts, calls, known, names))
    targets = targets.unionByName(_only_definition(definitions, calls, heavy))
    return CodeNodes(method_nodes(facts), call_sites, targets, errors(facts))


def ancestors(facts: DataFrame) -> DataFrame:
    """(class, ancestor, place) of all classes with bases, from written facts."""
    names = known_names(facts, _definitions(facts), None, for_classes=True)
    if names.ancestors is not None:
        return names.ancestors
    schema = "class string, ancestor string, place array<int>"
    return facts.sparkSession.createDataFrame([], schema)


def method_overriders(facts: DataFrame) -> DataFrame:
    """(callee_id, place, overrider_id) of all members that derived classes define again."""
    found = overriders(known_names(facts, _definitions(facts), None, for_classes=True))
    if found is None:
        schema = "callee_id string, place array<int>, overrider_id string"
        return facts.sparkSession.createDataFrame([], schema)
    return found.withColumnRenamed("target_id", "callee_id")


def dispatch_targets(call_targets: DataFrame, overridden: DataFrame) -> DataFrame:
    """(call_id, target_ord, callee_id) with all methods a call may run, the first one unchanged.

    Behind the target that ``first_targets`` of the export keeps come the members of derived
    classes that define it again, ``overridden`` as ``method_overriders`` gives them: nearer classes
    first, those at one distance by id. A method that everything overrides gives each of its
    calls that many rows, so this is for chosen calls; the table of overriders itself stays small.
    """
    first = call_targets.groupBy("call_id").agg(
        F.min(F.struct("target_ord", "callee_id")).alias("first")
    ).select("call_id", "first.*")
    others = overridden.select(
        F.col("callee_id").alias("of"), F.size("place").alias("distance"), "overrider_id"
    )
    nearest = others.groupBy("of", "overrider_id").agg(F.min("distance").alias("distance"))
    behind = skew_join(
        first.select("call_id", "callee_id"),
        nearest,
        on=("callee_id", "of"),
        spread=["call_id"],
        heavy=find_heavy_keys(first, "callee_id"),
    )
    further = behind.select(
        "call_id",
        (F.lit(BY_OVERRIDE) + F.col("distance")).alias("target_ord"),
        F.col("overrider_id").alias("callee_id"),
    )
    return first.unionByName(further)


def _only_definition(
    definitions: DataFrame, calls: DataFrame, heavy: DataFrame | None
) -> DataFrame:
    """The target of a call whose name is defined exactly once in the corpus."""
    once = (
        definitions.groupBy(F.col("name").alias("only_name"))
        .agg(F.count("*").alias("n"), F.first("method_id").alias("callee_id"))
        .where(F.col("n") == 1)
        .drop("n")
    )
    guessed = skew_join(
        calls.where("may_guess").select("call_id", "name"),
        once,
        on=("name", "only_name"),
        spread=["call_id"],
        heavy=heavy,
    )
    return guessed.select("call_id", F.lit(GUESSED).alias("target_ord"), "callee_id")


def corpus_meta(spark: SparkSession, root: str) -> DataFrame:
    return spark.range(1).select(F.lit(root).alias("root"))
