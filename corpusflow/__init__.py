"""corpusflow: corpus retrieval and table profiling as Spark DataFrame operators."""

from corpusflow.options import DEFAULTS, Options

__all__ = ["DEFAULTS", "Options"]
