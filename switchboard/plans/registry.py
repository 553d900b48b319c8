"""The registered queries: every operator over the whole test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from switchboard.functions import names, paths
from switchboard.operators import adjacency, export, extract, graph, lookup, summary
from switchboard.plans import envelope, fixtures
from switchboard.schema import CALL_COLUMNS, METHOD_COLUMNS
from switchboard.session import scratch_path
from switchboard.sources import increments, json_docs, snapshot, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(query: Query) -> Query:
    QUERIES[query.__name__] = query
    return query


# Scalar functions


@register
def short_name(spark, sf_dir):
    pages = fixtures.table(spark, sf_dir, "pages")
    texts = fixtures.method_rows(spark, sf_dir).select("full_name")
    for column in ("url", "html"):
        texts = texts.unionByName(pages.select(F.col(column).alias("full_name")))
    return texts.select("full_name", names.short_name(F.col("full_name")).alias("fn"))


@register
def abs_path(spark, sf_dir):
    url, kind = F.col("url"), F.col("page_id") % 6
    rel = (
        F.when(kind == 0, url)
        .when(kind == 1, F.concat(F.lit("./"), url, F.lit("/")))
        .when(kind == 2, F.concat(F.lit("../../../"), url))
        .when(kind == 3, F.concat(url, F.lit("/../x/./../../y")))
        .when(kind == 4, F.concat(F.lit("a//b/.././"), url))
        .otherwise(F.concat(url, F.lit("/..")))
    )
    place = F.col("page_id") % 4
    root = (
        F.when(place == 0, "/srv/pages")
        .when(place == 1, "")
        .when(place == 2, "crawl")
        .otherwise("/")
    )
    pages = fixtures.table(spark, sf_dir, "pages")
    return pages.select("page_id", paths.abs_path(root, rel).alias("path"))


# Sources and sinks


def _written(spark: SparkSession, label: str, **written: DataFrame) -> str:
    """A folder with the given tables; a table that is not given is a header alone."""
    out_dir = scratch_path(spark, label)
    none = {
        "methods": spark.createDataFrame([], ", ".join(f"{c} string" for c in METHOD_COLUMNS)),
        "calls": spark.createDataFrame([], ", ".join(f"{c} string" for c in CALL_COLUMNS)),
    }
    found = {**none, **written}
    tables.write_methods(found["methods"], out_dir)
    tables.write_calls(found["calls"], out_dir)
    return out_dir


@register
def scan_methods(spark, sf_dir):
    out_dir = _written(spark, "scan-methods", methods=fixtures.method_rows(spark, sf_dir))
    # The keyed tables depend on file order, so a lost order would show.
    return graph.method_map(tables.read_methods(spark, out_dir))


@register
def scan_calls(spark, sf_dir):
    out_dir = _written(spark, "scan-calls", calls=fixtures.calls(spark, sf_dir))
    return tables.read_calls(spark, out_dir)


@register
def export_methods(spark, sf_dir):
    """Methods and, with their whole multi-line text as signature, documents."""
    nodes = fixtures.node_tables(spark, sf_dir)
    module = F.concat(F.lit("corpus/"), F.col("source"), F.lit(".py"))
    texts = fixtures.table(spark, sf_dir, "documents").select(
        (F.lit(1_000_000_000) + F.col("doc_id")).alias("method_id"),
        F.concat(module, F.lit(":<module>.doc"), F.col("doc_id").cast("string")).alias("full_name"),
        F.col("text").alias("signature"),
        module.alias("file_name"),
        module.alias("filename"),
    )
    methods = export.project_methods(nodes["method_nodes"].unionByName(texts), nodes["meta"])
    out_dir = _written(spark, "export-methods", methods=methods)
    return tables.read_methods(spark, out_dir).drop("seq")


@register
def export_calls(spark, sf_dir):
    _, calls = export.export_tables(**fixtures.node_tables(spark, sf_dir))
    return tables.read_calls(spark, _written(spark, "export-calls", calls=calls))


@register
def json_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "json-documents")
    json_docs.save_json(fixtures.table(spark, sf_dir, "documents"), path)
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    return json_docs.load_json(spark, path, schema)


@register
def json_nested_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "json-events")
    events = fixtures.table(spark, sf_dir, "events").select(
        "event_id",
        F.struct(
            "event_type", "value", F.from_json("props", "k bigint").alias("props")
        ).alias("body"),
    )
    json_docs.save_json(events, path)
    loaded = json_docs.load_json(spark, path)
    return loaded.select("event_id", "body.event_type", "body.value", "body.props.k")


@register
def json_indented(spark, sf_dir):
    """Customers in indented documents of up to a thousand, each a file."""
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    record = F.to_json(F.struct("c_custkey", "c_name", "c_acctbal"), {"pretty": "true"})
    group = F.floor(F.col("c_custkey") / 1000).alias("group")
    documents = customers.select(group, record.alias("record")).groupBy("group").agg(
        F.concat(F.lit("[\n"), F.array_join(F.collect_list("record"), ",\n"), F.lit("\n]")).alias("text")
    )
    path = scratch_path(spark, "json-indented")
    documents.write.partitionBy("group").text(path)
    schema = "c_custkey bigint, c_name string, c_acctbal double"
    return json_docs.load_json(spark, path, schema, indented=True).select(
        "c_custkey", "c_name", "c_acctbal"
    )


# Export transforms


@register
def project_methods(spark, sf_dir):
    nodes = fixtures.node_tables(spark, sf_dir)
    return export.project_methods(nodes["method_nodes"], nodes["meta"])


@register
def resolve_calls(spark, sf_dir):
    return export.resolve_calls(**fixtures.node_tables(spark, sf_dir))


# Keyed tables


@register
def method_map(spark, sf_dir):
    return fixtures.graph(spark, sf_dir).methods


@register
def name_index(spark, sf_dir):
    return fixtures.graph(spark, sf_dir).names


@register
def snapshot_callers_of(spark, sf_dir):
    path = scratch_path(spark, "snapshot")
    snapshot.save(fixtures.graph(spark, sf_dir), path)
    return adjacency.callers_of(snapshot.open_snapshot(spark, path), "blue_bolt")


@register
def snapshot_callees_of(spark, sf_dir):
    path = scratch_path(spark, "snapshot")
    snapshot.save(fixtures.graph(spark, sf_dir), path)
    return adjacency.callees_of(snapshot.open_snapshot(spark, path), "n15")


@register
def snapshot_search(spark, sf_dir):
    path = scratch_path(spark, "snapshot")
    snapshot.save(fixtures.graph(spark, sf_dir), path)
    return lookup.search_functions(snapshot.open_snapshot(spark, path), "BOLT")


def _updated(spark, sf_dir):
    """A graph stored in an earlier state and then brought to the present one."""
    path = scratch_path(spark, "increments")
    increments.create(fixtures.earlier_graph(spark, sf_dir), path)
    increments.update(fixtures.graph(spark, sf_dir), path)
    return increments.open_graph(spark, path)


@register
def updated_callers(spark, sf_dir):
    return adjacency.callers_all(_updated(spark, sf_dir))


@register
def updated_callees(spark, sf_dir):
    return adjacency.callees_all(_updated(spark, sf_dir))


# Queries


@register
def callers_of(spark, sf_dir):
    return adjacency.callers_of(fixtures.graph(spark, sf_dir), "blue_bolt")


@register
def callees_of(spark, sf_dir):
    return adjacency.callees_of(fixtures.graph(spark, sf_dir), "n15")


@register
def function_details(spark, sf_dir):
    return lookup.function_details(fixtures.graph(spark, sf_dir), "blue_bolt")


@register
def search_functions(spark, sf_dir):
    return lookup.search_functions(fixtures.graph(spark, sf_dir), "BOLT")


@register
def search_for(spark, sf_dir):
    return lookup.search_for(
        fixtures.graph(spark, sf_dir), fixtures.search_requests(spark, sf_dir)
    )


@register
def graph_stats(spark, sf_dir):
    return lookup.graph_totals(fixtures.graph(spark, sf_dir))


@register
def calls_with_caller(spark, sf_dir):
    return adjacency.calls_with_caller(fixtures.graph(spark, sf_dir)).select(*MERGED_COLUMNS)


@register
def calls_with_callee(spark, sf_dir):
    return adjacency.calls_with_callee(fixtures.graph(spark, sf_dir)).select(*MERGED_COLUMNS)


MERGED_COLUMNS = [
    *("method_id", "full_name", "signature", "file"),
    *("caller_id", "caller_full_name", "caller_file", "callee_id", "callee_full_name"),
    *("callee_file", "callsite_file", "callsite_line"),
]


@register
def callers_all(spark, sf_dir):
    return adjacency.callers_all(fixtures.graph(spark, sf_dir))


@register
def callees_all(spark, sf_dir):
    return adjacency.callees_all(fixtures.graph(spark, sf_dir))


@register
def details_all(spark, sf_dir):
    return lookup.details_all(fixtures.graph(spark, sf_dir))


@register
def callers_for(spark, sf_dir):
    return adjacency.callers_for(fixtures.graph(spark, sf_dir), fixtures.requests(spark, sf_dir))


@register
def callees_for(spark, sf_dir):
    return adjacency.callees_for(fixtures.graph(spark, sf_dir), fixtures.requests(spark, sf_dir))


@register
def details_for(spark, sf_dir):
    return lookup.details_for(fixtures.graph(spark, sf_dir), fixtures.requests(spark, sf_dir))


# Result envelopes


@register
def callers_json(spark, sf_dir):
    return envelope.callers_json(fixtures.graph(spark, sf_dir), fixtures.requests(spark, sf_dir))


@register
def callees_json(spark, sf_dir):
    return envelope.callees_json(fixtures.graph(spark, sf_dir), fixtures.requests(spark, sf_dir))


@register
def details_json(spark, sf_dir):
    return envelope.details_json(fixtures.graph(spark, sf_dir), fixtures.requests(spark, sf_dir))


@register
def search_json(spark, sf_dir):
    return envelope.search_json(fixtures.graph(spark, sf_dir), "BOLT")


@register
def stats_json(spark, sf_dir):
    method_rows, calls = fixtures.method_rows(spark, sf_dir), fixtures.calls(spark, sf_dir)
    out_dir = _written(spark, "stats", methods=method_rows, calls=calls)
    stats = envelope.stats_json(graph.CallGraph.from_csv(spark, out_dir))
    # The folder is new for every run; a fixed name in its place keeps the result comparable.
    return stats.select(F.replace("json", F.lit(out_dir), F.lit("out")).alias("json"))


@register
def answer_callers(spark, sf_dir):
    """The lines of one answer of the five-question surface."""
    return envelope.answer(lambda: fixtures.graph(spark, sf_dir), "get_callers", "blue_bolt")


@register
def answer_callees(spark, sf_dir):
    return envelope.answer(lambda: fixtures.graph(spark, sf_dir), "get_callees", "n15")


@register
def answer_search(spark, sf_dir):
    return envelope.answer(lambda: fixtures.graph(spark, sf_dir), "search_functions", "BOLT")


# Numeric summaries


def _rounded(rows: DataFrame, *columns: str) -> DataFrame:
    # Adding zero turns a negative zero into zero.
    return rows.withColumns({c: F.round(c, 6) + F.lit(0.0) for c in columns})


@register
def stat_basic(spark, sf_dir):
    items = fixtures.table(spark, sf_dir, "lineitem")
    stats = summary.statistics(items, "l_quantity", "l_returnflag")
    return _rounded(stats, "total", "average", "std_dev")


@register
def stat_overall(spark, sf_dir):
    items = fixtures.table(spark, sf_dir, "lineitem")
    return _rounded(summary.statistics(items, "l_quantity"), "total", "average", "std_dev")


@register
def stat_requested(spark, sf_dir):
    """Quantities of every order; an order without line items gets zeros."""
    items = fixtures.table(spark, sf_dir, "lineitem")
    wanted = fixtures.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    stats = summary.statistics_for(items, "l_quantity", "l_orderkey", wanted)
    return _rounded(stats, "total", "average", "std_dev")


@register
def zscore(spark, sf_dir):
    items = fixtures.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice"
    )
    return _rounded(summary.zscore(items, "l_extendedprice", "l_suppkey"), "normalized")


@register
def zscore_overall(spark, sf_dir):
    """All prices as one data set."""
    items = fixtures.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_extendedprice"
    )
    return _rounded(summary.zscore(items, "l_extendedprice"), "normalized")


@register
def zscore_null_group(spark, sf_dir):
    """Items that were neither returned nor accepted have no group."""
    items = fixtures.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", F.nullif("l_returnflag", F.lit("N")).alias("flag")
    )
    return _rounded(summary.zscore(items, "l_quantity", "flag"), "normalized")


@register
def stat_integers(spark, sf_dir):
    """Integer totals beyond what a double holds exactly."""
    items = fixtures.table(spark, sf_dir, "lineitem")
    large = (F.col("l_orderkey") * 1_000_003 + F.lit(10_000_000_000_007)).alias("large")
    stats = summary.statistics(items.select("l_returnflag", large), "large", "l_returnflag")
    return summary.with_integer_totals(stats.select("l_returnflag", "total"))


@register
def analyze(spark, sf_dir):
    items = fixtures.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_returnflag", "l_quantity"
    )
    analyzed = summary.analyze(items, "l_quantity", "l_returnflag")
    return _rounded(analyzed, "normalized", "total", "mean", "average", "std_dev")


@register
def compare(spark, sf_dir):
    """Each supplier's quantities against those of the next supplier."""
    items = fixtures.table(spark, sf_dir, "lineitem").select("l_suppkey", "l_quantity")
    pairs = fixtures.table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("dataset1"), (F.col("s_suppkey") + 1).alias("dataset2")
    )
    compared = summary.compare_pairs(items, "l_quantity", "l_suppkey", pairs)
    return _rounded(
        compared, "average1", "std_dev1", "average2", "std_dev2", "mean_difference"
    )


@register
def compare_two(spark, sf_dir):
    items = fixtures.table(spark, sf_dir, "lineitem")
    returned, accepted = items.where("l_returnflag = 'R'"), items.where("l_returnflag <> 'R'")
    compared = summary.compare(returned, accepted, "l_quantity")
    return _rounded(
        compared, "average1", "std_dev1", "average2", "std_dev2", "mean_difference"
    )


# Extraction from source files


@register
def extract_methods(spark, sf_dir):
    facts = extract.read_corpus_facts(fixtures.source_files(spark, sf_dir), ["def"])
    meta = extract.corpus_meta(spark, "/corpus")
    return export.project_methods(extract.method_nodes(facts), meta).drop("method_id")


@register
def extract_calls(spark, sf_dir):
    corpus = fixtures.source_files(spark, sf_dir)
    nodes = extract.extract(corpus, scratch_path(spark, "source-nodes"))
    calls = export.resolve_calls(
        nodes.call_sites,
        nodes.call_targets,
        nodes.method_nodes,
        extract.corpus_meta(spark, "/corpus"),
    )
    resolved = F.col("callee_id") != "-1"
    return calls.withColumn("resolved", resolved).drop("call_id", "caller_id", "callee_id")


@register
def extract_errors(spark, sf_dir):
    facts = extract.read_corpus_facts(fixtures.source_files(spark, sf_dir), ["error"])
    return extract.errors(facts).select("path")


@register
def extract_class_calls(spark, sf_dir):
    """Calls of inherited members, of names that packages pass on, and on objects in variables."""
    corpus = fixtures.class_files(spark, sf_dir)
    nodes = extract.extract(corpus, scratch_path(spark, "class-nodes"))
    calls = export.resolve_calls(
        nodes.call_sites,
        nodes.call_targets,
        nodes.method_nodes,
        extract.corpus_meta(spark, "/corpus"),
    )
    resolved = F.col("callee_id") != "-1"
    return calls.select(
        "caller_full_name", "callee_full_name", "callsite_line", resolved.alias("resolved")
    )


@register
def class_ancestors(spark, sf_dir):
    """The classes of a corpus with their ancestors in the order in which members are looked up."""
    path = f"{scratch_path(spark, 'class-facts')}/facts"
    facts = extract.write_facts(fixtures.class_files(spark, sf_dir), path, extract.NAMING)
    ancestors = extract.ancestors(facts)
    order = Window.partitionBy("class").orderBy("place")
    return ancestors.select(
        "class", "ancestor", (F.row_number().over(order) - 1).alias("position")
    )


@register
def class_overriders(spark, sf_dir):
    """Members with the members of derived classes that may run in their stead."""
    path = f"{scratch_path(spark, 'class-facts')}/facts"
    facts = extract.write_facts(fixtures.class_files(spark, sf_dir), path, extract.NAMING)
    found = extract.method_overriders(facts)
    methods = extract.method_nodes(facts).select("method_id", "full_name")
    of, by = (
        methods.select(F.col("method_id").alias(f"{side}_id"), F.col("full_name").alias(side))
        for side in ("overridden", "overrider")
    )
    named = found.withColumnRenamed("callee_id", "overridden_id")
    named = named.join(of, "overridden_id").join(by, "overrider_id")
    return named.select("overridden", "overrider", F.size("place").alias("distance"))
