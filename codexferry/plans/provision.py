"""Manifest to requests, and logged answers to the run's result."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexferry.operators import provision as P
from codexferry.plans.manifest import Manifest
from codexferry.storage import materialize


@dataclass(frozen=True)
class Run:
    log: DataFrame
    resumed: DataFrame
    summary: DataFrame
    ledger: DataFrame


def _open_work(manifest: Manifest, ledger: DataFrame | None) -> Manifest:
    """The parts of notebooks that are not done, cut before anything is planned."""
    if ledger is None:
        return manifest

    def rest(df: DataFrame, title: str) -> DataFrame:
        return P.skip_completed(P.with_checkpoint_key(df, title), ledger)

    return Manifest(
        rest(manifest.notebooks, "title"),
        rest(manifest.sources, "notebook_title"),
        rest(manifest.notes, "notebook_title"),
        manifest.artifacts,
    )


def plan_requests(
    manifest: Manifest,
    ledger: DataFrame | None,
    project: str,
    location: str = "global",
    staged: DataFrame | None = None,
    **options,
) -> DataFrame:
    """Requests of all notebooks that the ledger does not hold as completed.

    ``staged`` is a listing of the staging area (``rel_path``): the upload of a source
    whose document it lacks is planned as missing, and becomes ``skipped``.
    """
    work = _open_work(manifest, ledger)
    if staged is not None:
        there = staged.select(
            F.col("rel_path").alias("relative_sharepoint_path"), F.lit(True).alias("_there")
        ).distinct()
        sources = work.sources.join(there, "relative_sharepoint_path", "left")
        exists = F.coalesce("_there", F.lit(False))
        work = replace(work, sources=sources.withColumn("file_exists", exists).drop("_there"))
    return P.request_plan(work.notebooks, work.sources, work.notes, project, location, **options)


def close_run(
    manifest: Manifest,
    plan: DataFrame,
    attempts: DataFrame,
    ledger: DataFrame,
    version: int,
    resume: bool = True,
) -> Run:
    """Log, summary and next ledger from the attempts that were made.

    ``attempts`` has ``checkpoint_key, step, seq, attempt, status``.
    """
    # Answers are read three times (request, link, create), the log as often.
    outcomes = materialize(P.retry_outcome(attempts, P.PLAN_KEYS, ["attempt"]))
    log = materialize(P.provision_log(P.apply_outcomes(plan, outcomes)))
    books = P.with_checkpoint_key(manifest.notebooks, "title")
    resumed = P.resumed_results(books, ledger)
    if not resume:
        resumed = resumed.limit(0)
    return Run(
        log,
        resumed,
        P.run_summary(log, resumed, resume),
        P.upsert_ledger(ledger, P.ledger_entries(log, version)),
    )
