"""Command line: ``python -m rolevec <job> ...`` (see ``rolevec.plans.jobs``)."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from rolevec import defaults
from rolevec.plans import jobs


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="rolevec")
    sub = p.add_subparsers(dest="job", required=True)
    a = sub.add_parser("seq2vec", help="level JSON -> unaligned top-k vectors")
    a.add_argument("levels")
    a.add_argument("positives")
    a.add_argument("out")
    a.add_argument("--lo", type=int, default=defaults.LEVEL_SPAN[0])
    a.add_argument("--hi", type=int, default=defaults.LEVEL_SPAN[1])
    a.add_argument("--top", type=int, default=defaults.TOP_K)
    a.add_argument("--expand", action="store_true")
    a.add_argument("--dictionary")
    a.add_argument("--keep-below", action="store_true", help="keep levels below the span, padded for all roles")
    a.add_argument("--rejected", help="folder for broken level records (default: they fail the job)")
    b = sub.add_parser("dimred", help="unaligned vectors -> kept columns + reduced vectors")
    b.add_argument("unaligned")
    b.add_argument("k", type=int)
    b.add_argument("kept", type=int)
    b.add_argument("--out")
    b.add_argument("--order", default="name", choices=["name", "cost_asc", "cost_desc"])
    b.add_argument("--top", type=int, help="top-k of the vectors (default: as stored beside them)")
    c = sub.add_parser("pack", help="dimred with defaults + two-round clustering")
    c.add_argument("unaligned")
    c.add_argument("model", choices=list(defaults.MODELS))
    c.add_argument("k", type=int)
    c.add_argument("--out")
    c.add_argument("--top", type=int, help="top-k of the vectors (default: as stored beside them)")
    d = sub.add_parser("secondary", help="sweep of the two-round clustering")
    d.add_argument("reduced")
    d.add_argument("k_range", help="lo,hi")
    d.add_argument("model", choices=list(defaults.MODELS))
    d.add_argument("rounds", type=int)
    d.add_argument("out")
    d.add_argument("--assignments", action="store_true", help="also write every fit's rows")
    for s in (b, c, d):
        s.add_argument("--registry", help="folder of the registry that the run is entered in")
    for s in (a, b, c, d):
        s.add_argument("--single-file", action="store_true")
    args = p.parse_args(argv)
    spark = SparkSession.builder.appName(f"rolevec-{args.job}").getOrCreate()
    if args.job == "seq2vec":
        jobs.seq2vec(spark, args.levels, args.positives, args.out, args.lo, args.hi, args.top, args.expand,
                     args.dictionary, args.single_file, args.keep_below, args.rejected)
    elif args.job == "dimred":
        jobs.dimred(spark, args.unaligned, args.out or args.unaligned, args.k, args.kept, args.top, args.order,
                    single_file=args.single_file, registry=args.registry)
    elif args.job == "pack":
        jobs.pack(spark, args.unaligned, args.out or args.unaligned, args.model, args.k, args.top,
                  single_file=args.single_file, registry=args.registry)
    else:
        lo, hi = (int(x) for x in args.k_range.split(","))
        jobs.secondary(spark, args.reduced, lo, hi, args.model, args.rounds, args.out,
                       with_assignments=args.assignments, registry=args.registry)


if __name__ == "__main__":
    main()
