"""``python -m quillon.service``: an engine behind HTTP, filled from a folder or with made-up documents if asked to."""

from __future__ import annotations

import logging
import sys

from pyspark.sql import SparkSession

from quillon.operators.engine import DEFAULT_TABLE, Engine
from quillon.functions.scoring import BM25
from quillon.service.config import Config, load
from quillon.service.rest import serve
from quillon.sources.corpus import read_folder, synthetic

_TEXT = {"title": "text", "body": "text"}


def start(spark: SparkSession, config: Config) -> Engine:
    """The engine of a configuration; each import is done once, whatever the number of starts."""
    schemas = {DEFAULT_TABLE: config.mapping} if config.mapping else {}
    engine = Engine(spark, config.root, config.make_analyzer(), BM25(config.k1, config.b), schemas | config.tables, indexed=True)
    table = engine.table()
    if config.corpus:
        table.import_once(f"corpus:{config.corpus}", read_folder(spark, config.corpus), _TEXT)
    if config.generate:
        table.import_once(f"generate:{config.generate}", synthetic(spark, config.generate), _TEXT)
    return engine


def main(arguments: list[str]) -> None:
    logging.basicConfig(level=logging.INFO)
    config = load(arguments)
    spark = SparkSession.builder.appName("quillon").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    server = serve(start(spark, config), config.address, config.max_clauses)
    logging.info("listening on %s", config.address)
    server.serve_forever()


if __name__ == "__main__":
    main(sys.argv[1:])
