"""Command line: ``python -m vecloom run --config FILE [KEY=VALUE ...]``, ``list-datasets``, ``list-methods``, ``dataset-stats``, ``queries``."""

from __future__ import annotations

import argparse
import json
import resource
import sys
import time
from pathlib import Path


def _session():  # noqa: ANN202
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("vecloom").config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def run(config: str, items: list[str], data: str, dry: bool) -> dict:
    """The report of one experiment over ``data/embeddings.parquet`` (its label column is the truth)."""
    from pyspark.sql import functions as F

    from vecloom import config as c
    from vecloom import pipelines
    from vecloom.operators import metrics
    from vecloom.progress import Progress
    from vecloom.sources import files, tables

    e = c.experiment(Path(config).read_text(), items, Path(config).stem)
    plan = {"experiment": e.name, "trial": c.trial(e), "steps": c.steps(e)}
    if dry:
        return plan
    began, spark = time.time(), _session()
    rows = tables.vectors(spark, data)
    n = e.image_dataset.max_samples
    rows = rows if n is None else rows.orderBy("id").limit(n)
    k = int(e.params.get("clusters") or rows.select("label").distinct().count())
    out = f"{e.output_dir}/trials/{plan['trial']}"
    params = c.seeded(e.params, e.seed)
    if c.keeps_checkpoints(e.image_dataset.name) and params.get("save_checkpoint"):
        params = {"checkpoints": f"{Path(out).resolve()}/checkpoints"} | params
    with Progress(spark) as progress:
        found = pipelines.predictions(e.method, rows, k, tables.nouns(spark, data), **params | {"log": progress.epoch}).persist()
        files.write_predictions(found, f"{out}/predictions")

    def measured(head: str) -> dict:
        met = rows.join(found.where(F.col("head") == head).select("id", F.col("cluster").alias("pred")), "id")
        if e.internal_metrics_only:
            table = metrics.evaluate_internal(met, sample=e.silhouette_sample_size, metric=e.silhouette_metric)
        else:
            table = metrics.evaluate(met.select("label", "pred"), e.metrics)
        return {r.metric: r.value for r in table.collect()}

    by_head = {r["head"]: measured(r["head"]) for r in found.select("head").distinct().collect()}  # a row a head
    # Of this process, the driver: executors report their own to the cluster.
    peak = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024
    report = plan | {"metrics": by_head.pop("main")} | ({"extra_heads": by_head} if by_head else {})
    if c.keeps_checkpoints(e.image_dataset.name):
        report |= {"seconds": round(time.time() - began, 3), "driver_peak_mb": round(peak, 1)}
    Path(out).mkdir(parents=True, exist_ok=True)
    # Renamed into place, so that no reader sees half a report.
    Path(out, "report.json.part").write_text(json.dumps(report, indent=2, sort_keys=True))
    Path(out, "report.json.part").replace(Path(out, "report.json"))
    return report


def dataset_stats(spark, name: str, root: str, split: str | None) -> list[dict]:  # noqa: ANN001
    """Samples and classes of the split, or of each split, of a dataset in image folders; what goes wrong in one split is told there."""
    from pyspark.errors import PySparkException
    from pyspark.sql import functions as F

    from vecloom.plans import catalog
    from vecloom.sources import files

    spec, out = catalog.dataset(name), []
    for s in [files.checked_split(split, spec.splits)] if split else spec.splits:
        try:
            # Labels and counts need the paths alone; the bytes are not read.
            row = files.image_folder(spark, f"{root}/{spec.name}", s).agg(F.count(F.lit(1)).alias("n_samples"), F.count_distinct("label").alias("n_classes")).first()
            out.append({"split": s} | row.asDict())
        except PySparkException as e:
            out.append({"split": s, "error": e.getCondition() or type(e).__name__})
    return out


def main(args: list[str]) -> int:
    parser = argparse.ArgumentParser(prog="vecloom")
    sub = parser.add_subparsers(dest="command", required=True)
    r = sub.add_parser("run")
    r.add_argument("--config", required=True)
    r.add_argument("--data", default="data")
    r.add_argument("--dry-run", action="store_true")
    r.add_argument("overrides", nargs="*")
    stats = sub.add_parser("dataset-stats")
    stats.add_argument("dataset")
    stats.add_argument("--split")
    stats.add_argument("--data", default="data")
    for name in ("list-datasets", "list-methods", "list-extractors", "queries"):
        sub.add_parser(name)
    a = parser.parse_args(["run", *args] if "--config" in args and args[:1] != ["run"] else args)
    if a.command == "run":
        print(json.dumps(run(a.config, a.overrides, a.data, a.dry_run), indent=2, sort_keys=True))
    elif a.command == "list-datasets":
        from vecloom.plans.catalog import DATASETS

        print("\n".join(f"{d.name}\t{d.mode}\t{','.join(d.splits)}" for d in sorted(DATASETS, key=lambda d: d.name)))
    elif a.command == "list-methods":
        from vecloom.pipelines import METHODS

        print("\n".join(f"{m.name}\t{m.category}\t{' > '.join(m.steps)}" for _, m in sorted(METHODS.items())))
    elif a.command == "list-extractors":
        print("pixels\nprojection\ntf_idf")
    elif a.command == "queries":
        from vecloom.plans import QUERIES

        print("\n".join(sorted(QUERIES)))
    else:
        for line in dataset_stats(_session(), a.dataset, a.data, a.split):
            print(json.dumps(line, sort_keys=True))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
