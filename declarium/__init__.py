"""Declarium: index and fuzzy search of C/C++ function signatures as Spark jobs."""

from declarium.operators.extract import extract_functions
from declarium.operators.grams import GramTable
from declarium.operators.search import (
    fetch_candidates,
    rank_candidates,
    search,
    search_interactive,
)
from declarium.operators.batch import search_batch, search_exact_batch
from declarium.plans.refresh import refresh, refresh_and_search
from declarium.sources.code import FolderSource, TableSource
from declarium.sources.index import SignatureIndex

__all__ = [
    "FolderSource",
    "GramTable",
    "SignatureIndex",
    "TableSource",
    "extract_functions",
    "fetch_candidates",
    "rank_candidates",
    "refresh",
    "refresh_and_search",
    "search",
    "search_batch",
    "search_exact_batch",
    "search_interactive",
]
