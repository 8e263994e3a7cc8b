"""spark-submit entry: `python -m foliomill parse|migrate IN OUT`, both on Parquet folders.

parse: page rows (IN/pages) to OUT/books, chapters, paragraphs, fragments. migrate: IN/pages and IN/old_paragraphs to
OUT/paragraphs with carried translations.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from foliomill.operators import pipelines, store


def main() -> None:
    parser = argparse.ArgumentParser(prog="foliomill", description=__doc__)
    parser.add_argument("job", choices=("parse", "migrate"))
    parser.add_argument("source")
    parser.add_argument("target")
    given = parser.parse_args()
    spark = SparkSession.builder.appName(f"foliomill-{given.job}").getOrCreate()
    pages = spark.read.parquet(f"{given.source}/pages")
    if given.job == "parse":
        for name, df in pipelines.parse_books(pages).items():
            store.write_books(df, f"{given.target}/{name}")
    else:
        store.write_books(pipelines.migrate_books(pages, spark.read.parquet(f"{given.source}/old_paragraphs")), f"{given.target}/paragraphs")
    spark.stop()


if __name__ == "__main__":
    main()
