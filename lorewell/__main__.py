"""Command line over a store: ``python -m lorewell --store FOLDER COMMAND ...``; results are JSON lines."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lorewell.functions import text as T
from lorewell.operators import hybrid
from lorewell.sources import files
from lorewell.store import Store


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lorewell", description=__doc__)
    p.add_argument("--store", required=True)
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, help_: str, *arguments: tuple) -> argparse.ArgumentParser:
        c = sub.add_parser(name, help=help_)
        for names, options in arguments:
            c.add_argument(*names.split(), **options)
        return c

    collection = ("--collection", {"default": ""})
    id_, ids = ("id", {}), ("ids", {"nargs": "+"})
    command("init", "make a collection", ("name", {"nargs": "?", "default": "default"}), ("--analyzer", {"default": "en"}))
    command("add", "store a text, or files", collection, ("--text", {}), ("--file", {"action": "append", "default": []}), ("--source", {"default": ""}), ("--type", {"default": "semantic"}), ("--importance", {"type": float, "default": 0.5}), ("--tags", {"default": ""}), ("--skip-known", {"action": "store_true"}))
    command("search", "find memories", ("query", {}), collection, ("--mode", {"default": "hybrid"}), ("--top-k", {"type": int, "default": 10}), ("--type", {}), ("--after", {}), ("--before", {}), ("--scoring", {"default": ""}))
    command("get", "show a memory", id_)
    command("update", "change a memory", id_, ("--content", {}), ("--type", {}), ("--importance", {"type": float}), ("--metadata", {}), ("--source", {}), ("--tags", {}))
    command("rm", "forget memories", ids, ("--hard", {"action": "store_true"}))
    command("ls", "list memories", collection)
    command("link", "store a triple", ("s", {}), ("p", {}), ("o", {}), ("--weight", {"type": float, "default": 1.0}), ("--remove", {"action": "store_true"}))
    command("expand", "show triples within reach", ("entity", {}), ("--hops", {"type": int, "default": 1}))
    command("organize", "suggest what to tag, pool and merge", collection, ("--threshold", {"type": float, "default": 0.85}))
    command("merge", "put one memory in place of several", ids, ("--summary", {"required": True}), ("--yes", {"action": "store_true"}))
    command("stats", "count memories and tombstones")
    command("info", "describe the store")
    command("metrics", "count searches", ("--reset", {"action": "store_true"}))
    command("compact", "fold the logs")
    command("export", "write the store as .tar.gz or Parquet", ("target", {}))
    command("import", "unpack an archive as a new store", ("archive", {}))
    return p


def run(argv: list[str], spark: SparkSession, write: Callable[[str], object] = print) -> None:
    """One command; raises what the store raises."""
    a = _parser().parse_args(argv)
    show = lambda x: write(json.dumps(x, default=str, ensure_ascii=False))

    def rows(df: DataFrame) -> None:
        for line in df.toJSON().collect():
            write(line)

    if a.command == "import":
        Store.load(spark, a.archive, a.store).close()
        return
    s = Store(spark, a.store)
    if a.command == "init":
        s.create_collection(a.name, a.analyzer)
    elif a.command == "add":
        metadata = json.dumps({"tags": a.tags.split(",")}) if a.tags else "{}"
        if a.text is not None:
            show(s.remember(a.text, a.collection, source=a.source, type=a.type, importance=a.importance, metadata=metadata))
        if a.file:
            s.remember_all(files.read_texts(spark, *a.file), a.collection, skip_known=a.skip_known)
    elif a.command == "search":
        found = s.search(a.query, a.collection, a.mode, a.top_k, where=hybrid.matches(a.type, None, a.after, a.before), scoring=a.scoring)
        rows(found.withColumn("content", T.preview(found["content"])))
    elif a.command == "get":
        show(s.get(a.id).asDict())
    elif a.command == "update":
        s.update(a.id, **{k: getattr(a, k) for k in ("content", "type", "importance", "metadata", "source") if getattr(a, k) is not None})
        if a.tags is not None:
            s.set_tags(a.id, [t for t in a.tags.split(",") if t])
    elif a.command == "rm":
        s.forget(*a.ids, hard=a.hard)
    elif a.command == "ls":
        found = s.list(a.collection)
        rows(found.select("id", "collection", "type", T.preview(found["content"], 80).alias("content")))
    elif a.command == "link":
        s.unlink(a.s, a.p, a.o) if a.remove else s.link(a.s, a.p, a.o, a.weight)
    elif a.command == "expand":
        rows(s.expand(a.entity, a.hops))
    elif a.command == "organize":
        for name, df in s.suggest(a.collection, a.threshold).items():
            for r in df.collect():
                show({"suggestion": name, **r.asDict()})
    elif a.command == "merge":
        show(s.merge(a.ids, a.summary, a.yes))
    elif a.command == "metrics":
        s.reset_metrics() if a.reset else rows(s.metrics())
    elif a.command in ("stats", "info"):
        found = getattr(s, a.command)()
        rows(found) if isinstance(found, DataFrame) else show(found)
    elif a.command == "compact":
        s.compact()
    elif a.command == "export":
        s.export(a.target)
    s.close()


def main() -> int:
    spark = SparkSession.builder.appName("lorewell").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    try:
        run(sys.argv[1:], spark)
    except (KeyError, ValueError, FileExistsError) as e:
        print(e, file=sys.stderr)
        return 1
    finally:
        spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
