"""python -m reelgrid ROOT --build --movies M.csv --ratings R.csv | --query Q --user U | --show-profile --user U | --check-health"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from reelgrid.plans import library


def main() -> None:
    p = argparse.ArgumentParser(prog="reelgrid")
    p.add_argument("root", help="folder of the tables")
    p.add_argument("--build", action="store_true")
    p.add_argument("--movies")
    p.add_argument("--ratings")
    p.add_argument("--tags")
    p.add_argument("--cards", action="append", default=[], metavar="TIER=FILE")
    p.add_argument("--support", type=int, default=200)
    p.add_argument("--query")
    p.add_argument("--user", default="default")
    p.add_argument("--top-k", type=int, default=10)
    p.add_argument("--lambda", dest="slider", type=float, default=0.7)
    p.add_argument("--dealbreaker", action="append", default=[])
    p.add_argument("--show-profile", action="store_true")
    p.add_argument("--check-health", action="store_true")
    p.add_argument("--json", action="store_true")
    a = p.parse_args()
    spark = SparkSession.builder.appName("reelgrid").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.build:
        library.build(spark, a.root, a.movies, a.ratings, a.tags, dict(x.split("=", 1) for x in a.cards) or None, a.support)
    shown = []
    own = library.Library(spark, a.root)
    if a.query is not None:
        shown.append(own.search(a.query, a.user, a.top_k, a.slider, a.dealbreaker))
    if a.show_profile:
        shown.append(own.summary(a.user))
    if a.check_health:
        shown.append(own.health())
    for df in shown:
        if a.json:
            print(*df.toJSON().collect(), sep="\n")  # a list of the length asked for
        else:
            df.show(max(20, a.top_k), truncate=60)


if __name__ == "__main__":
    main()
