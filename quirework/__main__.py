"""python -m quirework: a run over landed tables, its summary line and artefacts on standard output.

The folder holds inventory, canvases, labels, boxes and registrations as Parquet and the canvases' pictures in targets/.
Parameters come from the command line, or else from the environment (MODE, REGISTRATION_ONLY, BATCH_SIZE, MAX_DISCOVERY).
"""

from __future__ import annotations

import argparse
import os
from dataclasses import replace

from pyspark.sql import functions as F

from quirework.config import MOST_DISCOVERED
from quirework.operators.imaging import small_pictures
from quirework.plans import pipeline
from quirework.session import session
from quirework.sources import readers


def parameters(words: list[str] | None = None) -> argparse.Namespace:
    given = argparse.ArgumentParser(prog="quirework", description="A run over landed tables.")
    given.add_argument("folder")
    given.add_argument("--mode", choices=["smoke", "full"], default=os.environ.get("MODE", "full"))
    given.add_argument("--registration-only", action="store_true", default=os.environ.get("REGISTRATION_ONLY") == "1")
    given.add_argument("--batch-size", type=int, default=int(os.environ.get("BATCH_SIZE", "64")))
    given.add_argument("--max-discovery", type=int, default=int(os.environ.get("MAX_DISCOVERY", str(MOST_DISCOVERED))))
    given.add_argument("--cpus", default=None)
    return given.parse_args(words)


def inputs(spark, p: argparse.Namespace) -> pipeline.Inputs:
    tables = {name: spark.read.parquet(f"{p.folder}/{name}") for name in ("inventory", "canvases", "labels", "boxes", "registrations")}
    done = tables.pop("registrations")

    def attempt(pairs):
        return done.join(pairs.select("folio", F.col("index").alias("candidate_index")), ["folio", "candidate_index"], "left_semi")

    model = replace(small_pictures(), batch=p.batch_size)
    return pipeline.Inputs(**tables, images=readers.images(spark, f"{p.folder}/targets"), attempt=attempt, model=model, mode=p.mode, most_discovered=p.max_discovery)


def main(words: list[str] | None = None) -> None:
    p = parameters(words)
    spark = session(p.cpus)
    given = inputs(spark, p)
    if p.registration_only:
        print(pipeline.registration_report(given).first()["value"])
        return
    run = pipeline.Run(given)
    print(pipeline.verdict(run).first()["value"])
    for r in run.artefacts().orderBy("name", "chunk").toLocalIterator():
        print(f"{r['name']}_{r['chunk']:04d}={r['part']}")


if __name__ == "__main__":
    main()
