"""Command line: run a configured experiment, average seeds, make seed settings."""

from __future__ import annotations

import argparse
import logging
import time
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import functions as F

from tessera.operators import ensemble, folds, metrics, models, select
from tessera.operators.tables import stack
from tessera.session import session
from tessera.sources import config, readers, store

log = logging.getLogger("tessera")


@contextmanager
def timed(name: str):
    start = time.time()
    yield
    log.info("[%s] done in %.2f s", name, time.time() - start)


def run(settings: dict, train_path: str, test_path: str | None, out: str, features_only: bool = False, force: bool = False, notify=None) -> dict:
    """Features, selection, folds, training; writes predictions, importance and scores."""
    spark = session()
    with timed("load"):
        train = spark.read.parquet(train_path)
        test = spark.read.parquet(test_path) if test_path else train.limit(0)
    names = settings["features"]
    row_id, target = settings["id"][0], settings["target"]
    if names:
        with timed("features"):
            rows = stack([train, test], ["train", "test"]).withColumn("row_id", F.col(row_id))
            store.make(rows, f"{out}/features", names, force)
            if features_only:
                return {}
            x = store.load(spark, f"{out}/features", names, "train").withColumnRenamed("row_id", row_id)
            t = store.load(spark, f"{out}/features", names, "test").withColumnRenamed("row_id", row_id)
            train, test = x.join(train.select(row_id, target), row_id), t
    numeric, _ = select.classify_columns(train.drop(row_id, target))
    gone = set(select.constant_columns(train.select(*numeric)))
    numeric = [c for c in numeric if c not in gone]
    gone = set(select.correlated_columns(train, numeric, settings["selection"]["correlation"]))
    numeric = [c for c in numeric if c not in gone]
    if settings["selection"]["drift_p"] and test_path:
        drift = set(select.drifted_columns(train, test, numeric, settings["selection"]["drift_p"]))
        numeric = [c for c in numeric if c not in drift]
    v = settings["validation"]
    folded = folds.kfold(train, [row_id], v["folds"], v["seed"])
    with timed("train"):
        r = models.cross_validate(folded, numeric, target, metrics.rmse, row_id=row_id, test=test if test_path else None, name=settings["model"]["name"], **settings["model"]["parameters"])
    readers.write_predictions(r.oof, f"{out}/oof", row_id)
    if r.test is not None:
        readers.write_predictions(r.test, f"{out}/test", row_id)
    result = {"scores": r.scores, "mean_score": sum(r.scores) / max(1, len(r.scores)), "feature_importance": r.importance, "config": settings}
    readers.write_json(f"{out}/output.json", result)
    if notify:
        notify(result)
    return result


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="tessera")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("run", help="run an experiment")
    a.add_argument("--config", required=True)
    a.add_argument("--train", required=True)
    a.add_argument("--test")
    a.add_argument("--output", default="output")
    a.add_argument("--log_dir", default="log")
    a.add_argument("--debug", action="store_true")
    a.add_argument("--force", action="store_true", help="make features again")
    a.add_argument("--dryrun", action="store_true", help="stop after features")
    b = sub.add_parser("seeds", help="write one settings file a seed")
    b.add_argument("--base_config", required=True)
    b.add_argument("--num_seeds", type=int, default=5)
    c = sub.add_parser("average", help="average the predictions of runs")
    c.add_argument("--runs", required=True)
    c.add_argument("--row_id", default="row_id")
    c.add_argument("--output", required=True)
    o = p.parse_args(argv)
    logging.basicConfig(level=logging.DEBUG if getattr(o, "debug", False) else logging.INFO)
    if o.command == "run":
        run(config.load(o.config), o.train, o.test, o.output, o.dryrun, o.force)
    elif o.command == "seeds":
        import yaml

        for s in config.seed_settings(config.load(o.base_config), o.num_seeds):
            Path(f"{Path(o.base_config).with_suffix('')}_seed{s['seed']}.yml").write_text(yaml.safe_dump(s))
    else:
        ensemble.average_runs(readers.read_runs(session(), o.runs), o.row_id).write.mode("overwrite").parquet(o.output)


if __name__ == "__main__":
    main()
