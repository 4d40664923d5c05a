"""python -m starloom import|layout|tiles|slice|card|search|health ..."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from . import jobs
from .config import Config
from .sources import archives
from .store import Canon


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="starloom")
    sub = top.add_subparsers(dest="job", required=True)
    source = sub.add_parser("import")
    source.add_argument("source", choices=["backbone", "similarity", "genres", "facts", "prose"])
    source.add_argument("--dump", required=True)
    source.add_argument("--dump-version", help="version of the dump; by default what an archive says, else latest")
    source.add_argument("--index", help="index of a multi-stream archive of pages: only wanted streams are read")
    source.add_argument("--progress", action="store_true", help="tell on stderr how far the reading of facts is")
    source.add_argument("--min-score", type=float, default=0.0)
    source.add_argument("--labels")
    source.add_argument("--artists")
    source.add_argument("--limit", type=int, help="entities or pages at most")
    lay = sub.add_parser("layout")
    lay.add_argument("--metric")
    lay.add_argument("--iterations", type=int, default=jobs.layout.ITERATIONS)
    lay.add_argument("--seed", type=int, default=jobs.layout.SEED)
    lay.add_argument("--min-score", type=float, default=0.0)
    lay.add_argument("--reach", type=int, default=jobs.layout.REACH, help="cells that count as near: the greater, the finer")
    lay.add_argument("--tiles", help="folder for tiles of the new layout")
    cut = sub.add_parser("tiles")
    cut.add_argument("--max-level", type=int, default=jobs.tiles.MAX_LEVEL)
    cut.add_argument("--level0-stars", type=int, default=jobs.tiles.LEVEL0_STARS)
    less = sub.add_parser("slice")
    less.add_argument("--keep", type=int, default=jobs.slicing.KEEP)
    less.add_argument("--dry-run", action="store_true")
    sub.add_parser("card").add_argument("id", type=int)
    sub.add_parser("search").add_argument("term")
    sub.add_parser("vacuum", help="delete what no kept manifest names").add_argument("--keep", type=int, default=10)
    sub.add_parser("health")
    return top


def main(argv: list[str] | None = None) -> None:
    args, config = parser().parse_args(argv), Config.from_env()
    spark = SparkSession.builder.appName("starloom").getOrCreate()
    canon = Canon(spark, config.canon_root)
    if args.job == "import":
        version = args.dump_version or (archives.timestamp(spark, args.dump) if archives.is_tar(args.dump) else None) or "latest"
        tell = (lambda done, total: print(f"{done} of {total} tasks", file=sys.stderr)) if args.progress else None
        run = {
            "backbone": lambda: jobs.import_backbone(canon, args.dump, version),
            "similarity": lambda: jobs.import_similarity(canon, args.dump, version, args.min_score),
            "genres": lambda: jobs.import_genres(canon, args.dump, version, args.labels, args.artists),
            "facts": lambda: jobs.import_facts(canon, args.dump, version, args.limit, tell),
            "prose": lambda: jobs.import_prose(canon, args.dump, version, args.limit, args.index),
        }
        print(json.dumps({"rows": run[args.source](), **canon.counters}))
    elif args.job == "layout":
        print(json.dumps({"layout": jobs.make_layout(canon, args.metric, args.iterations, args.seed, args.min_score, args.reach, args.tiles)}))
    elif args.job == "tiles":
        print(json.dumps({"tiles": jobs.write_tiles(canon, config.tiles_dir, args.level0_stars, args.max_level)}))
    elif args.job == "slice":
        print(json.dumps({"removed": jobs.slice_canon(canon, args.keep, args.dry_run)}))
    elif args.job == "vacuum":
        print(json.dumps({"deleted": canon.vacuum(args.keep)}))
    elif args.job == "health":
        print(json.dumps(jobs.health(spark, canon)))
    else:
        rows = jobs.card(canon, args.id) if args.job == "card" else jobs.search(canon, args.term)
        for line in rows.toJSON().toLocalIterator():
            print(line)


if __name__ == "__main__":
    main()
