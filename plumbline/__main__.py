"""Command line: ``python -m plumbline DATA OUT`` runs the whole job."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from plumbline import config
from plumbline.functions.embed import HashEmbedder
from plumbline.plans import evaluate, pipeline
from plumbline.sources import records


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="plumbline", description=__doc__)
    p.add_argument("data", help="folder with source_info.jsonl and response.jsonl")
    p.add_argument("out", help="folder for the results")
    p.add_argument("--config", help="YAML file with settings")
    p.add_argument("--cache", help="folder of the extraction cache")
    p.add_argument("--limit", type=int, help="only so many answers, the first in the order of the file")
    p.add_argument("--stage", choices=[*pipeline.STAGES, "all"], default="all", help="one stage, after those before it; default: all")
    p.add_argument("--embed", action="store_true", help="use the offline embedder")
    p.add_argument("--no-audit", action="store_true")
    p.add_argument("--audit-files", action="store_true", help="a file for each answer, and not a data set of all")
    p.add_argument("--bad-lines", choices=["fail", "aside"], default="fail", help="what a line that is no JSON object does: end the job, or stand with the failures")
    a = p.parse_args(args)
    settings = config.load(a.config) if a.config else config.Settings()
    spark = SparkSession.builder.appName("plumbline").getOrCreate()
    instances = records.load_instances(spark, a.data, exclude_implicit_true=settings.exclude_implicit_true, limit=a.limit, on_bad=a.bad_lines)
    bad = records.bad_records(spark, a.data) if a.bad_lines == "aside" else None
    result = pipeline.run(instances, a.out, settings, embedder=HashEmbedder() if a.embed else None, cache_path=a.cache, audit=False if a.no_audit else "files" if a.audit_files else True, stage=a.stage, bad=bad)
    if result is not None:
        print(json.dumps(evaluate.short(result.summary).first().asDict(), indent=2))


if __name__ == "__main__":
    main()
