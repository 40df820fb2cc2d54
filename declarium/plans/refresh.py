"""Bring an index up to date with a source."""

from __future__ import annotations

import logging
import math
import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from declarium.operators.changes import SKIPPED, detect_changes
from declarium.operators.extract import extract_functions
from declarium.operators.search import search
from declarium.plans.shared import spread, written
from declarium.sources.index import SignatureIndex

LOG = logging.getLogger(__name__)


def refresh(
    index: SignatureIndex,
    source,
    extractor: Callable[[DataFrame], DataFrame] = extract_functions,
    max_files_per_batch: int | None = None,
    progress: Callable[[dict], None] | None = None,
    should_stop: Callable[[], bool] | None = None,
    prune: bool = False,
) -> dict:
    """Parse new and changed files and commit them; returns the counts of this run.

    Files go in batches of about ``max_files_per_batch``, each committed by itself: a run that is
    stopped or dies keeps what it committed, and the next one goes on with the rest. A table is read
    once for all batches, its queued contents dealt into a folder for each. Files that
    vanished stay in the index unless ``prune`` is set.
    """
    started, observers = time.time(), [progress] if progress else []
    summary = dict.fromkeys(
        ["files_total", "files_queued", "files_done", "files_skipped", "files_indexed", "files_failed",
         "functions_total"], 0
    )
    summary |= {"canceled": False, "start_time": started}
    index.create()
    known = index.states() if index.generations() else None
    changes = written(detect_changes(source.listing(), known))
    found = {row["status"]: row["count"] for row in changes.groupBy("status").count().collect()}
    summary["files_total"] = sum(found.values())
    summary["files_skipped"] = summary["files_done"] = found.get(SKIPPED, 0)
    summary["files_queued"] = summary["files_total"] - summary["files_skipped"]
    _publish(observers, summary)

    queue = changes.where(F.col("status") != SKIPPED)
    everything = summary["files_skipped"] == 0 and max_files_per_batch is None and known is None
    size = max_files_per_batch or source.batch_files or summary["files_queued"]
    batches = 1 if everything else math.ceil(summary["files_queued"] / max(1, size))
    number_of = F.pmod(F.xxhash64("path"), F.lit(batches)).cast("int")
    dealt = None
    for number in range(batches if summary["files_queued"] else 0):
        if should_stop is not None and should_stop():
            summary["canceled"] = True
            break
        if batches > 1 and getattr(source, "one_pass", False):
            if dealt is None:
                # The source is read once for all batches, each batch reads its own folder.
                contents = source.contents(queue, everything).withColumn("batch", number_of)
                dealt = written(contents.hint("rebalance", "batch"), "batch")
            contents = dealt.where(F.col("batch") == number).drop("batch")
            empty = contents.select("path").isEmpty()
            # The folder may be one file, which one task would parse.
            contents = spread(contents)
        else:
            part = queue.where(number_of == number)
            empty = batches > 1 and part.isEmpty()
            contents = source.contents(part, everything)
        if empty:
            continue
        counts = index.add(extractor(contents))
        for name, count in counts.items():
            summary[name] += count
        summary["files_done"] += counts["files_indexed"] + counts["files_failed"]
        _publish(observers, summary)
    if prune and not summary["canceled"]:
        gone = index.states().join(changes, "path", "left_anti").select("path")
        if not gone.isEmpty():
            index.remove(gone)
    index.merge()
    summary["end_time"] = time.time()
    summary["duration_seconds"] = summary["end_time"] - started
    return summary


def _publish(observers: list[Callable[[dict], None]], counts: dict) -> None:
    """Hand the counts to whoever observes the run; what an observer raises is logged, the run goes on."""
    for observer in observers:
        try:
            observer({**counts, "at": time.time()})
        except Exception:  # noqa: BLE001
            LOG.warning("an observer of the refresh failed", exc_info=True)


def refresh_and_search(index: SignatureIndex, source, text: str, top: int = 20) -> DataFrame:
    """Hits of one query on an index brought up to date first."""
    refresh(index, source)
    return search(index.functions(), text, top)
