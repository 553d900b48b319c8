"""Call-structure analytics over method and call-site tables, as Spark DataFrame jobs."""

from switchboard.operators.graph import CallGraph

__all__ = ["CallGraph"]
