"""All registered queries."""

from corpusflow.plans import (  # noqa: F401
    catalog_corpus,
    catalog_dialog,
    catalog_retrieval,
    catalog_streams,
    catalog_tables,
)
from corpusflow.plans.registry import ORACLES
from corpusflow.plans.registry import QUERIES as REGISTERED

#: A light query comes first: whoever runs all of them pays the start of a session there.
QUERIES = {name: REGISTERED[name] for name in sorted(REGISTERED, key=lambda name: name != "corpus_stats")}

__all__ = ["ORACLES", "QUERIES"]
