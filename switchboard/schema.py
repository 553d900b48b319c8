"""Column names, sentinels and file names shared by every module."""

METHOD_COLUMNS = ["method_id", "full_name", "signature", "file"]
CALL_COLUMNS = [
    "caller_id",
    "caller_full_name",
    "caller_file",
    "callee_id",
    "callee_full_name",
    "callee_file",
    "callsite_file",
    "callsite_line",
]

# Fixed values of the two-table exchange format.
UNRESOLVED_ID = "-1"
NO_LINE = -1
UNKNOWN_FILE = "<unknown>"
UNKNOWN_NAME = "<unknownFullName>"
METHODS_FILE = "methods.csv"
CALLS_FILE = "calls.csv"
OUT_DIR_VARIABLE = "CALLGRAPH_OUT_DIR"
