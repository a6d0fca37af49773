"""python -m gristmill INPUT --rules RULES.json --out FOLDER [--schema HEADER.csv] [--limit N] [--propose]: enriches a
catalogue file and writes the provenance lines, the review queue, the vocabulary and a report; with a file whose first line
is the delivery's header, also the delivery as CSV and as workbooks."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import propose, score
from .plans import enrich
from .sources import catalogue, scratch, sinks


def main(args: list[str] | None = None) -> dict:
    parser = argparse.ArgumentParser(prog="gristmill", description=__doc__)
    parser.add_argument("input")
    parser.add_argument("--rules")
    parser.add_argument("--out", required=True)
    parser.add_argument("--schema", help="a CSV file whose first line is the header of the delivery")
    parser.add_argument("--limit", type=int)
    parser.add_argument("--propose", action="store_true", help="ask the model that the PROPOSER_* variables name")
    told = parser.parse_args(args)
    spark = SparkSession.builder.appName("gristmill").getOrCreate()
    began, earlier = time.time(), scratch.named()
    rows, rules = enrich.build(spark, told.input, told.rules, told.limit)
    config = propose.Config.from_env()
    out, cells, verdict, vocabulary = enrich.run(rows, rules, propose.build(config) if told.propose else None, f"{told.out}/replies" if told.propose else None, config.max_calls)
    # Written once and read again: the queue and the report need every row.
    cells.write.mode("overwrite").parquet(f"{told.out}/cells")
    verdict.write.mode("overwrite").parquet(f"{told.out}/verdicts")
    cells, verdict = spark.read.parquet(f"{told.out}/cells"), spark.read.parquet(f"{told.out}/verdicts")
    sinks.write_provenance(cells, verdict, f"{told.out}/provenance")
    sinks.write_review_queue(score.queue_rows(cells, verdict), f"{told.out}/review")
    vocabulary.write(f"{told.out}/vocabulary")
    if told.schema:
        headers = catalogue.headers(spark, told.schema)
        sinks.write_delivery_csv(cells, headers, f"{told.out}/delivery")
        sinks.write_delivery_xlsx(cells, verdict, headers, f"{told.out}/workbooks")
    payload = score.evaluate(cells, verdict) | {"seconds": round(time.time() - began, 3)}
    as_json, as_text = sinks.report(payload)
    report = spark.createDataFrame([("report.json", as_json), ("report.md", as_text)], "name string, value string")
    for name in ("report.json", "report.md"):
        report.where(F.col("name") == name).select("value").coalesce(1).write.mode("overwrite").text(f"{told.out}/{name}")
    # All that the run gives is written by now; what it stored on the way goes.
    scratch.drop(spark, *(set(scratch.named()) - set(earlier)))
    return payload


if __name__ == "__main__":
    main()
