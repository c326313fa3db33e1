"""Errors of the graph engine."""


class QueryError(Exception):
    """A traversal that cannot be built."""


class GraphTraversalError(Exception):
    """A traversal that fails while it runs."""


class GraphError(Exception):
    """A graph that cannot be built or changed that way."""
