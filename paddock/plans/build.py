"""Dataset and coverage of all sources, seasons and rounds."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paddock.operators import dataset as ds
from paddock.schemas import EVENT
from paddock.session import cut_lineage
from paddock.sources.sinks import in_order, write_csv, write_parquet


@dataclass
class Build:
    dataset: DataFrame
    coverage: DataFrame
    notes: DataFrame
    paths: dict[str, str | None]
    failures: list[str] = field(default_factory=list)


def build_dataset(
    calendar: DataFrame,
    practice: DataFrame,
    qualifying: DataFrame,
    race: DataFrame,
    standings: DataFrame,
    out_dir: str,
    max_rounds: int | None = None,
) -> Build:
    """Write the wide dataset and its coverage as CSV and as Parquet by source and year.

    The merged rows feed both outputs in both formats, so they are written once.
    """
    rounds = ds.first_rounds(calendar, max_rounds)
    merged = cut_lineage(ds.merge_kinds(ds.stack_kinds(practice, qualifying, race, standings)))
    dataset, covered = ds.dataset_rows(rounds, merged), ds.coverage(rounds, merged)
    notes = ds.notes_of_coverage(covered)
    paths: dict[str, str | None] = {}
    failures: list[str] = []
    for name, frame in (("dataset", in_order(dataset)), ("coverage", covered)):
        paths[f"{name}_csv"] = write_csv(frame, f"{out_dir}/{name}_csv")
        try:
            paths[f"{name}_parquet"] = write_parquet(frame, f"{out_dir}/{name}_parquet", ["source", "year"])
        except Exception as exc:  # the CSV stands on its own
            paths[f"{name}_parquet"] = None
            failures.append(f"{name}: no Parquet written ({type(exc).__name__}); the CSV is complete")
    return Build(dataset, covered, notes, paths, failures)


def summary_document(build: Build, config: dict[str, object], generated_at: str) -> DataFrame:
    """One JSON document: configuration, row and event totals, paths, and notes in calendar order.

    Notes are one per round and missing kind, so the list is as long as the calendar.
    """
    ordered = F.transform(
        F.array_sort(F.collect_list(F.struct(*EVENT, "stage", "message"))), lambda n: n["message"]
    )
    notes = F.concat(build.notes.agg(ordered).scalar(), F.array(*map(F.lit, build.failures)).cast("array<string>"))
    fields = [
        F.from_json(F.lit(json.dumps(config)), "map<string,string>").alias("config"),
        "rows",
        "events",
        *[F.lit(path).cast("string").alias(f"{name}_path") for name, path in build.paths.items()],
        notes.alias("notes"),
        F.lit(generated_at).alias("generated_at"),
    ]
    totals = ds.summary(build.dataset, build.coverage)
    return totals.select(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("document"))
