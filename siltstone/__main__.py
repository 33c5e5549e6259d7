"""python -m siltstone STEP: the offline steps from the command line.

chunk, graph, rebuild, import, embed, skill and stats. Extraction and answers need a model,
which is a Python callable: plans.build.extract() and plans.skills take it.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession

from .operators import graph, vector
from .plans import build, skills
from .sources import readers

#: What `skill all` asks.
SAMPLE = {"nl2sql": {"question": "钢铁 SO2"}, "tracing": {"pollutant": "PM2.5"}, "compliance": {"industry": "钢铁"}, "fraud": {"pattern": "监测值异常"}}


def _plain(value):
    return [r.asDict(recursive=True) for r in value.limit(20).collect()] if isinstance(value, DataFrame) else value


def run_skill(g: graph.Graph, name: str, given: dict) -> dict:
    """A skill's answer as plain values, 20 rows of each table."""
    return {k: _plain(v) for k, v in skills.call(name, g, **given).items()}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="siltstone")
    steps = out.add_subparsers(dest="step", required=True)

    def step(title: str, about: str, /, **options: dict) -> None:
        one = steps.add_parser(title, help=about)
        for option, how in options.items():
            one.add_argument(f"--{option}", **how)

    need, phase = {"required": True}, {"choices": ("metadata", "extraction", "all"), "default": "all"}
    step("chunk", "markdown tree to stored chunks", root={}, out=need)
    step("graph", "metadata and extractions to a stored graph", root={}, extractions={}, phase=phase, out=need)
    step("rebuild", "all of a graph from files, and its counts", root={}, extractions={}, out=need)
    step("import", "statements for an external store, written as text", root={}, extractions={}, phase=phase, out=need)
    step("embed", "an index of chunks, by the stand-in encoder", chunks=need, out=need, cache={})
    step("skill", "answers of one skill, or of all", graph=need, name={"default": "all"}, params={"default": "{}", "help": "JSON object"})
    step("stats", "counts of a stored graph", graph=need)
    return out


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("siltstone").getOrCreate()
    if args.step in ("graph", "import"):
        meta = readers.metadata_files(spark, readers.data_root(args.root)) if args.phase != "extraction" else None
        ext = readers.extractions_jsonl(spark, args.extractions) if args.extractions else None
    if args.step == "chunk":
        build.chunk(spark, readers.data_root(args.root), args.out).show()
    elif args.step == "graph":
        build.build_graph(meta, ext, args.out, args.phase).show(100)
    elif args.step == "rebuild":
        build.rebuild(spark, readers.data_root(args.root), args.out, args.extractions).show(100)
    elif args.step == "import":
        build.statements(meta, ext, args.out, args.phase).show()
    elif args.step == "embed":
        build.index_chunks(spark, args.chunks, args.out, vector.hash_encoder(), args.cache).show()
    elif args.step == "skill":
        g = graph.Graph(*readers.graph_tables(spark, args.graph))
        asked = SAMPLE if args.name == "all" else {args.name: json.loads(args.params)}
        for name, given in asked.items():
            print(json.dumps(run_skill(g, name, given), ensure_ascii=False, indent=2, default=str))
    else:
        graph.stats(*readers.graph_tables(spark, args.graph)).show(100)


if __name__ == "__main__":
    main()
