"""``python -m paperloom [--config FILE] [--catalogue PARQUET] | --init FILE | --list-venues``"""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from .sources.settings import CHECKERS, VENUES, Settings, find_settings, load_settings

TEMPLATE = """files:
  input_dir: .        # or one file each: bib, tex
  output_dir: paperloom_output
template: ""          # a venue id
bibliography:
  check_metadata: true        # looks entries up in the table given by --catalogue
  check_usage: true
  check_duplicates: true
  check_preprint_ratio: true
  preprint_warning_threshold: 0.5
submission:
{checkers}
workflow: []          # steps in order; empty: all
"""


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="paperloom")
    parser.add_argument("--config")
    parser.add_argument("--catalogue", help="Parquet table of source, rank, title, authors, year, doi, arxiv_id, abstract")
    parser.add_argument("--init", metavar="FILE")
    parser.add_argument("--list-venues", action="store_true")
    given = parser.parse_args(args)
    if given.list_venues:
        print("\n".join(f"{v[0]:8} {v[1]:14} {v[2]}" for v in VENUES))
        return 0
    if given.init:
        Path(given.init).write_text(TEMPLATE.format(checkers="\n".join(f"  {c}: true" for c in CHECKERS)), encoding="utf-8")
        return 0
    path = given.config or find_settings()
    if path is None:
        print("no settings file found; --init writes one", file=sys.stderr)
        return 1
    settings: Settings = load_settings(path)
    from pyspark.sql import SparkSession

    from .plans.run import audit, write

    spark = SparkSession.builder.appName("paperloom").getOrCreate()
    catalogue = spark.read.parquet(given.catalogue) if given.catalogue else None
    for name, place in write(audit(spark, settings, catalogue), settings).items():
        print(f"{name}: {place}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
