"""Command line: compile a project or a collection of projects, list an archive, extract it.

    python -m lexforge garden.hhp -o garden.chm
    python -m lexforge --collection master.hhp
    python -m lexforge --list garden.chm
    python -m lexforge --extract garden.chm folder

It ends with 0, with 1 where a project or an entry fails, and with 2 for wrong arguments.
"""

from __future__ import annotations

import argparse
import sys
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.plans import compile as plans
from lexforge.sources import container
from lexforge.sources.files import folder_files

VERSION = "0.2"


def arguments() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="lexforge", description="Compile, list and extract help archives.")
    out.add_argument("project", nargs="?", help="a .hhp file")
    out.add_argument("-o", "--output", help="the archive to write; else what the project names, else its own name with .chm")
    out.add_argument("-c", "--collection", action="store_true", help="compile the projects that this one merges as well")
    out.add_argument("-l", "--list", metavar="FILE", help="list an archive's entries")
    out.add_argument("-x", "--extract", nargs=2, metavar=("FILE", "FOLDER"), help="write an archive's files into a folder")
    out.add_argument("-v", "--version", action="version", version=VERSION)
    return out


def archives(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def list_archive(spark: SparkSession, path: str) -> int:
    rows = container.entries(archives(spark, path)).orderBy("name").toLocalIterator()
    failed = 0
    for r in rows:
        if r.error is not None:
            print(f"{path}: {r.error}", file=sys.stderr)
            failed = 1
        else:
            print(f"{r.section} {r.length:>10} {r.name}")
    return failed


def extract_archive(spark: SparkSession, path: str, folder: str) -> int:
    broken = [r.error for r in container.entries(archives(spark, path)).where("error is not null").select("error").toLocalIterator()]
    done = container.extract(archives(spark, path), str(Path(folder).resolve())).drop("path").persist()
    failed = broken + [f"{r.name}: {r.error}" for r in done.where("error is not null").toLocalIterator()]
    print(f"{done.where('error is null').count()} files written, {len(failed)} failed")
    for line in failed:
        print(line, file=sys.stderr)
    return 1 if failed else 0


def compile_one(files: DataFrame, name: str, output: Path | None, folder: Path) -> str:
    """Write one project's archive; a line about it. A listed file that is missing is an error, one that pages name is not."""
    found = plans.compile_project(files, name)
    missing = found["missing"].select("node", "depth").orderBy("depth", "node").collect()  # names of one project's files
    if listed := [r.node for r in missing if r.depth == 0]:
        raise FileNotFoundError(f"{name} lists files that are not there: {', '.join(listed)}")
    for r in missing:
        print(f"{name}: warning: {r.node} is named but not there", file=sys.stderr)
    if output is None:
        named = found["options"].select(F.col("options")["compiled file"]).first()
        output = folder / (named[0].replace("\\", "/") if named and named[0] else Path(name).with_suffix(".chm").name)
    sizes = files.join(found["files"].select("rel"), "rel").agg(F.count("*"), F.coalesce(F.sum(F.length("data")), F.lit(0))).first()
    made = plans.compile_archive(files, name, found).first()
    output.parent.mkdir(parents=True, exist_ok=True)
    output.write_bytes(made.data)
    return f"{output}: {sizes[0]} files, {sizes[1]} bytes, archive of {len(made.data)} bytes ({100 * len(made.data) / max(1, sizes[1]):.1f} %)"


def compile_all(spark: SparkSession, master: Path) -> int:
    folder = master.resolve().parent
    files = folder_files(spark, f"file://{folder}", master.stem)
    failed, count = 0, 0
    for r in plans.collection_members(files, master.name).orderBy("seq").collect():  # a line each of one file
        count += 1
        try:
            if r.kind == "missing":
                raise FileNotFoundError(f"there is neither a project nor an archive of {r.member}")
            if r.kind == "archive":
                print(f"[{r.kind}] {r.path}: taken as it is")
                continue
            base = r.path[: r.path.rfind("/") + 1]
            inside = files.where(F.col("rel").startswith(base)).withColumn("rel", F.col("rel").substr(F.lit(len(base) + 1), F.length("rel")))
            print(f"[{r.kind}] {compile_one(inside, r.path[len(base) :], None, folder / base)}")
        except (OSError, ValueError) as e:
            print(f"[{r.kind}] {r.member}: {e}", file=sys.stderr)
            failed += 1
    print(f"{count} members, {failed} failed")
    return 1 if failed else 0


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = arguments()
    given = parser.parse_args(args)
    if not (given.project or given.list or given.extract):
        parser.print_usage()
        return 2
    spark = spark or SparkSession.builder.appName("lexforge").getOrCreate()
    began = time.monotonic()
    if given.list:
        return list_archive(spark, given.list)
    if given.extract:
        return extract_archive(spark, *given.extract)
    path = Path(given.project)
    if not path.is_file():
        print(f"there is no file {path}", file=sys.stderr)
        return 1
    if given.collection:
        return compile_all(spark, path)
    folder = path.resolve().parent
    try:
        line = compile_one(folder_files(spark, f"file://{folder}", path.stem), path.name, Path(given.output) if given.output else None, folder)
    except (OSError, ValueError) as e:
        print(e, file=sys.stderr)
        return 1
    print(f"{line}, {time.monotonic() - began:.1f} s")
    return 0


if __name__ == "__main__":
    sys.exit(main())
