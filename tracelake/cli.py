"""python -m tracelake.cli analysis|compare|comm|ranks|nodes|group: the analyses from the command line."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import SparkSession

from . import sinks
from .functions.patterns import parsed
from .operators.aggregate import checked_fields
from .operators.islands import islands, named_groups
from .operators.nodes import filter_nodes
from .plans import analysis
from .session import local_session
from .sources import traces


def options(text: str | None, known: Sequence[str]) -> list[str]:
    """A comma-separated list of known words (- and _ alike), or ValueError."""
    out = [x.replace("-", "_") for x in parsed(text)]
    for x in out:
        if x not in known:
            raise ValueError(f"unknown option {x}; known: {', '.join(known)}")
    return out


def filters(args: argparse.Namespace) -> analysis.Filters:
    for kind in ("op", "kernel"):
        if getattr(args, f"include_{kind}") and getattr(args, f"exclude_{kind}"):
            raise ValueError(f"--include-{kind} and --exclude-{kind} exclude each other")
    return analysis.Filters(*(parsed(getattr(args, f)) for f in ("include_op", "exclude_op", "include_kernel", "exclude_kernel")))


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="tracelake", description=__doc__)
    commands = out.add_subparsers(dest="command", required=True)
    one = commands.add_parser("analysis", help="cost of groups of operations")
    one.add_argument("file")
    one.add_argument("--label", default="single_file")
    one.add_argument("--max-files", type=int)
    many = commands.add_parser("compare", help="compare labelled sets of traces")
    many.add_argument("files", nargs="+", help="paths:label, paths being a file, a folder, a glob or a comma-separated list")
    many.add_argument("--compare", default="")
    many.add_argument("--max-files-per-label", type=int)
    for p in (one, many):
        p.add_argument("--aggregation", default="name")
        p.add_argument("--show", default="")
        p.add_argument("--coarse-call-stack", action="store_true")
        p.add_argument("--large-files", action="store_true", help="scan all files by ranges (large ones are in any case)")
        p.add_argument("--random-seed", type=int, default=42)
        for f in ("include-op", "exclude-op", "include-kernel", "exclude-kernel"):
            p.add_argument(f"--{f}")
    ranks = commands.add_parser("comm", help="fastest and slowest rank of collectives")
    ranks.add_argument("pod_dir")
    ranks.add_argument("--step", type=int)
    ranks.add_argument("--kernel-prefix", default="TCDP_")
    pair = commands.add_parser("ranks", help="collectives of two ranks side by side")
    pair.add_argument("fast")
    pair.add_argument("slow")
    pair.add_argument("--kernel-prefix", default="TCDP_")
    picked = commands.add_parser("nodes", help="filter a saved list of nodes")
    picked.add_argument("file")
    picked.add_argument("--state")
    picked.add_argument("--node-id", type=int)
    picked.add_argument("--attempt", type=int)
    for f in ("launched-from", "launched-to", "released-from", "released-to"):
        picked.add_argument(f"--{f}", help="milliseconds or an ISO-8601 time")
    runs = commands.add_parser("group", help="group run folders whose time ranges overlap")
    runs.add_argument("root")
    for p in (one, many, ranks, pair, picked, runs):
        p.add_argument("--output-dir", default=".")
        p.add_argument("--output-format", default="csv,json")
    return out


def told(paths: list[str], counts: analysis.Counts) -> list[str]:
    """Prints the counts of an analysis whose report is written."""
    if paths:
        print(", ".join(f"{n} {step}" for step, n in counts.rows().items()))
    return paths


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> list[str]:
    """Runs a command and returns the paths that it wrote."""
    args = parser().parse_args(argv)
    formats = options(args.output_format, sinks.FORMATS)
    if args.command in ("analysis", "compare"):
        fields = checked_fields([x.strip() for x in args.aggregation.split(",")])
        show = [x for x in options(args.show, analysis.SHOWN) if x not in fields]
        keep = filters(args)
    spark = spark or local_session()
    if args.command == "analysis":
        _, files = traces.labelled_files(spark, f"{args.file}:{args.label}", args.max_files, args.random_seed)
        counts = analysis.Counts()
        out = analysis.analyse(spark, files, fields, show, keep, args.coarse_call_stack, args.label, args.large_files, counts)
        return told(sinks.write(out, args.output_dir, sinks.base_name(fields, show, label=args.label), formats), counts)
    if args.command == "compare":
        sets = dict(traces.labelled_files(spark, spec, args.max_files_per_label, args.random_seed) for spec in args.files)
        counts = analysis.Counts()
        out = analysis.compare_sets(spark, sets, fields, show, options(args.compare, analysis.COMPARED), keep, args.coarse_call_stack, args.large_files, counts)
        return told(sinks.write(out, args.output_dir, sinks.base_name(fields, show, list(sets), vars(keep)), formats), counts)
    if args.command == "comm":
        raw, statistics = analysis.collectives(spark, args.pod_dir, args.kernel_prefix, args.step)
        paths = sinks.write(raw, args.output_dir, "communication_raw_data", formats, partition="step")
        return paths + sinks.write(statistics, args.output_dir, "communication_statistics", formats)
    if args.command == "ranks":
        report, verdict = analysis.compared_ranks(spark, args.fast, args.slow, args.kernel_prefix)
        return sinks.write(report, args.output_dir, "communication_pairs", formats) + sinks.write(verdict, args.output_dir, "communication_verdict", formats)
    if args.command == "nodes":
        kept = filter_nodes(traces.read_nodes(spark, args.file), args.state, args.node_id, args.attempt, (args.launched_from, args.launched_to), (args.released_from, args.released_to))
        return sinks.write(kept, args.output_dir, "nodes", formats)
    grouped = islands(traces.run_folder_ranges(spark, args.root))
    return sinks.write(grouped, args.output_dir, "run_groups", formats) + sinks.write(named_groups(grouped), args.output_dir, "run_group_names", formats)


if __name__ == "__main__":
    main()
