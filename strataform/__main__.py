"""Command line: python -m strataform queries | run NAME SF_DIR OUT | chunks RECIPE OUT | matrix CHUNKS PANEL OUT | battery RECIPE OUT."""

from __future__ import annotations

import argparse

from strataform.session import local_session


def main() -> None:
    ap = argparse.ArgumentParser(prog="strataform")
    sub = ap.add_subparsers(dest="what", required=True)
    sub.add_parser("queries")
    run = sub.add_parser("run")
    run.add_argument("name")
    run.add_argument("sf_dir")
    run.add_argument("out")
    chunks = sub.add_parser("chunks")
    chunks.add_argument("recipe")
    chunks.add_argument("out")
    chunks.add_argument("--base", default=".")
    chunks.add_argument("--labels", type=lambda s: [x.strip() for x in s.split(",") if x.strip()])
    chunks.add_argument("--sampling", choices=("prefix", "reservoir"), help="overrules the recipe's sampling_mode")
    chunks.add_argument("--allow-short", action="store_true")
    chunks.add_argument("--overwrite", action="store_true")
    matrix = sub.add_parser("matrix")
    matrix.add_argument("chunks")
    matrix.add_argument("panel", help="Parquet of label, ord, role")
    matrix.add_argument("out")
    battery = sub.add_parser("battery", help="all analyses of a recipe; steps whose folder is there are left out")
    battery.add_argument("recipe")
    battery.add_argument("out")
    battery.add_argument("--base", default=".")
    battery.add_argument("--replicates", type=int, default=200)
    battery.add_argument("--repeats", type=int, default=50)
    battery.add_argument("--allow-short", action="store_true")
    args = ap.parse_args()

    from strataform.plans import analyses, measures, oracles, queries  # noqa: F401
    from strataform.catalog import QUERIES

    if args.what == "queries":
        print("\n".join(QUERIES))
        return
    spark = local_session()
    if args.what == "run":
        QUERIES[args.name](spark, args.sf_dir).write.parquet(args.out)
    elif args.what == "chunks":
        analyses.build_chunks(spark, args.recipe, args.out, args.base, args.labels, None if args.sampling is None else args.sampling == "reservoir", args.overwrite, args.allow_short)
    elif args.what == "battery":
        print("\n".join(analyses.battery(spark, args.recipe, args.out, args.base, replicates=args.replicates, repeats=args.repeats, allow_short=args.allow_short)))
    else:
        from strataform.operators.semantic import embed

        rows = spark.read.parquet(args.chunks)
        vectors = embed(rows).selectExpr("label", "chunk_index AS vec_id", "embedding")
        analyses.corpus_matrix(spark.read.parquet(args.panel), rows, vectors, args.out)


if __name__ == "__main__":
    main()
