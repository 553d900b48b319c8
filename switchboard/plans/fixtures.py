"""Call-graph tables, code-graph nodes and source files derived from the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from switchboard.operators.graph import CallGraph


# Stated rather than read from the files, which would cost one job per table and query.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": (
        "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
        "p_retailprice double"
    ),
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
        "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
        "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
    ),
    "events": (
        "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, "
        "props string"
    ),
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "pages": "page_id bigint, url string, html string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _text(column: str) -> Column:
    return F.col(column).cast("string")


def method_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as methods; suppliers define ids once more: even ids later in file order, odd ids
    earlier."""
    last_digit = F.col("p_partkey") % 10
    module = F.concat(F.lit("src/m"), _text("p_size"), F.lit(".py"))
    plain_name = F.replace(F.col("p_name"), F.lit(" "), F.lit("_"))
    in_module = F.concat(module, F.lit(":<module>"))
    full_name = (
        F.when(last_digit == 9, F.concat(F.lit("<operator>."), F.lower("p_type")))
        .when(last_digit == 8, F.concat(F.lit("lib."), plain_name))
        .when(last_digit == 7, in_module)
        .when(last_digit == 6, F.concat(module, F.lit(":"), plain_name))
        .otherwise(F.concat(in_module, F.lit("."), F.col("p_type"), F.lit("."), plain_name))
    )
    signature = F.when(F.col("p_partkey") % 3 == 0, "").otherwise(
        F.concat(F.lit("def("), F.col("p_brand"), F.lit(")"))
    )
    file = F.when(last_digit >= 8, "<unknown>").otherwise(F.concat(F.lit("/repo/"), module))
    parts = table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("bigint").alias("seq"),
        _text("p_partkey").alias("method_id"),
        full_name.alias("full_name"),
        signature.alias("signature"),
        file.alias("file"),
    )
    is_later = F.when(F.col("s_suppkey") % 2 == 0, F.lit(1)).otherwise(F.lit(-1))
    redefined = table(spark, sf_dir, "supplier").select(
        (is_later * 1_000_000_000 + F.col("s_suppkey").cast("bigint")).alias("seq"),
        _text("s_suppkey").alias("method_id"),
        F.concat(F.lit("src/dup.py:<module>.Dup.n"), _text("s_nationkey")).alias("full_name"),
        F.lit("def()").alias("signature"),
        F.lit("/repo/src/dup.py").alias("file"),
    )
    return parts.unionByName(redefined)


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as call sites: resolved, unresolved and dangling, with repeats."""
    flag, line = F.col("l_returnflag"), F.col("l_linenumber")
    caller = F.when(line == 7, F.col("l_partkey") + 900_000_000).otherwise(F.col("l_partkey"))
    callee = (
        F.when(flag == "N", "-1")
        .when(flag == "R", _text("l_suppkey"))
        .otherwise(_text("l_orderkey"))
    )
    callee_name = (
        F.when(flag == "R", "stale.py:<module>.ignored")
        .when(flag == "A", F.concat(F.lit("dyn/d"), line.cast("string"), F.lit(".py:<module>.go")))
        .when(F.col("l_linestatus") == "O", "<unknownFullName>")
        .when(line == 1, "")
        .otherwise(F.concat(F.lit("ext.e"), line.cast("string")))
    )
    return table(spark, sf_dir, "lineitem").select(
        caller.cast("string").alias("caller_id"),
        F.concat(F.lit("src/c.py:<module>.f"), _text("l_partkey")).alias("caller_full_name"),
        F.lit("/repo/src/c.py").alias("caller_file"),
        callee.alias("callee_id"),
        callee_name.alias("callee_full_name"),
        F.when(flag == "N", "<unknown>").otherwise("/repo/src/e.py").alias("callee_file"),
        F.lit("/repo/src/c.py").alias("callsite_file"),
        line.cast("string").alias("callsite_line"),
    )


def graph(spark: SparkSession, sf_dir: str) -> CallGraph:
    return CallGraph(method_rows(spark, sf_dir), calls(spark, sf_dir))


def earlier_graph(spark: SparkSession, sf_dir: str) -> CallGraph:
    """The graph before a change: some modules had other names, one did not exist, another has
    gone since, and one call in seven was not there or had another callee."""
    rows, call_rows = method_rows(spark, sf_dir), calls(spark, sf_dir)
    module = F.regexp_extract("full_name", r"^src/m([0-9]+)\.py", 1)
    renamed = F.when(module.startswith("1"), F.concat("full_name", F.lit("_v1")))
    rows = rows.where(module != "20")
    gone = rows.where(module == "30").withColumn("file", F.lit("/repo/src/gone.py"))
    rows = rows.withColumn("full_name", F.coalesce(renamed, "full_name")).unionByName(gone)
    other = F.when(F.col("callsite_line") == "3", F.col("caller_id")).otherwise(F.col("callee_id"))
    return CallGraph(rows, call_rows.where("callsite_line <> '2'").withColumn("callee_id", other))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Asked function names: every part name, most of which exist, and names that do not."""
    known = table(spark, sf_dir, "part").select(
        F.replace(F.col("p_name"), F.lit(" "), F.lit("_")).alias("function")
    )
    unknown = table(spark, sf_dir, "nation").select(F.lower("n_name").alias("function"))
    dup = table(spark, sf_dir, "nation").select(
        F.concat(F.lit("n"), _text("n_nationkey")).alias("function")
    )
    return known.unionByName(unknown).unionByName(dup)


def search_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searched texts: words of part names in capitals, their beginnings, and names of nations."""
    parts = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("word"))
    nations = table(spark, sf_dir, "nation").select(F.col("n_name").alias("query"))
    asked = [F.upper("word"), F.substring("word", 1, 1), F.substring("word", 2, 2)]
    texts = parts.select(F.explode(F.array(*asked)).alias("query"))
    return texts.unionByName(nations)


def node_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Orders as call sites, line items as candidate targets, parts as methods."""
    module = F.concat(F.lit("src/m"), _text("p_size"), F.lit(".py"))
    plain_name = F.replace(F.col("p_name"), F.lit(" "), F.lit("_"))
    methods = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("method_id"),
        F.concat(module, F.lit(":<module>."), plain_name).alias("full_name"),
        F.col("p_brand").alias("signature"),
        F.when(F.col("p_partkey") % 10 != 9, F.concat(F.lit("./lib/../"), module)).alias(
            "file_name"
        ),
        module.alias("filename"),
    )
    no_line = F.col("o_orderpriority") == "5-LOW"
    sites = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("call_id"),
        F.col("o_custkey").alias("caller_id"),
        F.concat(F.lit("ext.s"), F.col("o_orderstatus")).alias("method_full_name"),
        F.when(~no_line, (F.col("o_orderkey") % 500).cast("int")).alias("line_number"),
    )
    targets = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("call_id"),
        F.col("l_linenumber").alias("target_ord"),
        F.col("l_partkey").alias("callee_id"),
    )
    # The first region stands for the corpus: its name is the root folder.
    root = table(spark, sf_dir, "region").agg(F.min_by("r_name", "r_regionkey").alias("r_name"))
    meta = root.select(F.concat(F.lit("/"), F.lower("r_name")).alias("root"))
    return {
        "call_sites": sites,
        "call_targets": targets,
        "method_nodes": methods,
        "meta": meta,
    }


PART_MODULE = """class {type}:
    def make_{key}(self, amount):
        return self.check_{key}(amount)

    def check_{key}(self, amount):
        return abs(amount)

def build_{key}(amount):
    return {type}().make_{key}(amount)
"""

ORDER_MODULE = """import json
from parts.p{part} import build_{part} as build

def handle_{key}(amount):
    total = build(amount)
    print(total)
    return json.dumps([total for _ in range(3)])

handle_{key}({price})
"""


TEXT_MODULE = """def note_{key}():
    return len(\"\"\"{text}\"\"\")
"""


def _fill(template: str, **columns: Column) -> Column:
    text = F.lit(template)
    for name, column in columns.items():
        text = F.replace(text, F.lit("{" + name + "}"), column.cast("string"))
    return text


def _spread(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """The rows of small tables in as many parts as parsing wants tasks, as (of, its columns).

    They come in one or two splits. The rows are dealt before files are made of them, since a row
    is much smaller than its file.
    """
    tagged = [rows.withColumn("of", F.lit(name)) for name, rows in tables.items()]
    rows = tagged[0]
    for more in tagged[1:]:
        rows = rows.unionByName(more, allowMissingColumns=True)
    return rows.repartition(2 * spark.sparkContext.defaultParallelism, "of", "key")


def _made(rows: DataFrame, files: list[tuple[str, list[Column | str], Column]]) -> DataFrame:
    """(path, source) of the files ``(table, parts of the path, source)`` that rows stand for."""
    made = F.lit(None)
    for name in dict.fromkeys(name for name, _, _ in files):
        own = [
            F.struct(
                F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in path)).alias("path"),
                source.alias("source"),
            )
            for of, path, source in files
            if of == name
        ]
        made = F.when(F.col("of") == name, F.array(*own)).otherwise(made)
    return rows.select(F.explode(made).alias("file")).select("file.*")


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, source): a module per part, one per order that calls into it, and plain prose."""
    key = F.col("key")
    rows = _spread(
        spark,
        {
            "parts": table(spark, sf_dir, "part").select(
                F.col("p_partkey").alias("key"), F.initcap("p_type").alias("type")
            ),
            "orders": table(spark, sf_dir, "orders").select(
                F.col("o_orderkey").alias("key"),
                F.col("o_custkey").alias("part"),
                F.floor("o_totalprice").alias("price"),
            ),
            "docs": table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "text"),
        },
    )
    # Every text as a string in a valid module, and as comments before a bracket that closes
    # nothing: both are read to the end.
    quoted = F.replace(F.replace("text", F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    comments = F.regexp_replace(F.col("text"), r"\R", "\n# ")
    broken = F.concat(F.lit("# "), comments, F.lit("\n)\n"))
    part = _fill(PART_MODULE, key=key, type=F.col("type"))
    order = _fill(ORDER_MODULE, key=key, part=F.col("part"), price=F.col("price"))
    return _made(
        rows,
        [
            ("parts", ["parts/p", key, ".py"], part),
            ("orders", ["orders/o", key, ".py"], order),
            ("docs", ["docs/d", key, ".py"], _fill(TEXT_MODULE, key=key, text=quoted)),
            ("docs", ["docs/e", key, ".py"], broken),
        ],
    )


REGION_MODULE = """class Region{key}:
    def locate(self):
        return self.label()

    def label(self):
        return "{key}"

    def scale(self):
        return 1
"""

NATION_PACKAGE = """from ..r{region} import Region{region} as Base
from .impl import Nation{key}
"""

NATION_MODULE = """from world.n{key} import Base

class Nation{key}(Base):
    pass
"""

CUSTOMER_MODULE = """from world.n{nation} import Nation{nation}

class Customer{key}(Nation{nation}):
    def label(self):
        return self.locate()

    def again(self):
        return super().label()

def open_{key}():
    return Customer{key}()
"""

DESK_MODULE = """from people.c{customer} import open_{customer} as open_one, Customer{customer}

class Desk{key}:
    def __init__(self):
        self.customer = open_one()

    def serve(self):
        guest = self.customer
        guest.scale()
        return open_one().again()

Customer{customer}.locate(None)
from people.c{customer} import *
open_{customer}()
"""


def class_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, source): customers as classes below nations below regions, each known only by names
    that packages pass on, and orders that call methods of objects in variables."""
    key, nation, region, customer = (F.col(c) for c in ("key", "nation", "region", "customer"))
    rows = _spread(
        spark,
        {
            "regions": table(spark, sf_dir, "region").select(
                F.col("r_regionkey").cast("bigint").alias("key")
            ),
            "nations": table(spark, sf_dir, "nation").select(
                F.col("n_nationkey").cast("bigint").alias("key"), F.col("n_regionkey").alias("region")
            ),
            "customers": table(spark, sf_dir, "customer").select(
                F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("nation")
            ),
            "orders": table(spark, sf_dir, "orders").select(
                F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("customer")
            ),
        },
    )
    desk = _fill(DESK_MODULE, key=key, customer=customer)
    return _made(
        rows,
        [
            ("regions", ["world/r", key, ".py"], _fill(REGION_MODULE, key=key)),
            ("nations", ["world/n", key, "/__init__.py"], _fill(NATION_PACKAGE, key=key, region=region)),
            ("nations", ["world/n", key, "/impl.py"], _fill(NATION_MODULE, key=key)),
            ("customers", ["people/c", key, ".py"], _fill(CUSTOMER_MODULE, key=key, nation=nation)),
            ("orders", ["sales/o", key, ".py"], desk),
        ],
    )
