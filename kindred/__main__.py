"""python -m kindred LEFT RIGHT OUTPUT [--config FILE] [--mode auto|owned|heuristic|legacy] [--ownership-config FILE] [--cache-dir FOLDER] [--overwrite]
python -m kindred prepare FILE          writes the lock of an ownership file and registers its pair

auto compares by ownership where the pair is registered and its lock holds, else by heuristics.
Exit codes: 0 done, 2 bad input or settings, 4 done but code could not be read, 5 anything else.  (3 would be an external tool's
failure; none is used.)  OUTPUT is a folder that all machines share."""

from __future__ import annotations

import argparse
import sys


def arguments(argv: list[str] | None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="kindred", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("paths", nargs="+", metavar="LEFT RIGHT OUTPUT | prepare FILE")
    parser.add_argument("--config")
    parser.add_argument("--mode", choices=("auto", "owned", "heuristic", "legacy"), default="auto")
    parser.add_argument("--ownership-config")
    parser.add_argument("--registry")
    parser.add_argument("--cache-dir", help="folder that keeps profiles for the next run")
    parser.add_argument("--overwrite", action="store_true")
    given = parser.parse_args(argv)
    wanted = 2 if given.paths[0] == "prepare" else 3
    if len(given.paths) != wanted:
        parser.error(f"{wanted} paths are needed")
    return given


def choose(a: argparse.Namespace) -> tuple[str, object, dict]:
    """The mode to run, the ownership settings it uses, and how they were found."""
    from kindred.plans import ownership

    left, right, _ = a.paths
    if a.ownership_config and a.mode in ("heuristic", "legacy"):
        raise ValueError(f"{a.mode} takes no ownership settings")
    if a.mode == "owned" and not a.ownership_config:
        raise ValueError("owned needs --ownership-config")
    if a.mode in ("heuristic", "legacy"):
        return a.mode, None, {}
    found = {"status": "explicit", "message": "settings were given"}
    path = a.ownership_config
    if not path:
        try:
            status, path, message = ownership.Registry(a.registry).lookup(left, right)
        except ValueError as error:
            status, message = "invalid", str(error)
        found = {"status": status, "message": message}
        if status != "matched":
            return "heuristic", None, found
    try:
        given = ownership.load(path)
        from pathlib import Path

        if [Path(p).resolve() for p in (left, right)] != [s.artifact.resolve() for s in given.sides.values()]:
            raise ValueError("the settings are of other artifacts")
        if given.lock is None:
            raise ValueError("the settings name no provenance_lock")
    except (ValueError, OSError) as error:
        if a.ownership_config:
            raise
        return "heuristic", None, {"status": "stale", "message": str(error)}
    return "owned", given, found


def run(a: argparse.Namespace) -> int:
    from pyspark.sql import SparkSession

    from kindred import config
    from kindred.plans import compare, ownership, report

    spark = SparkSession.builder.getOrCreate()
    settings = config.load(a.config)
    if a.paths[0] == "prepare":
        given = ownership.load(a.paths[1])
        lock = ownership.write_lock(spark, given, settings)
        print(lock, ownership.Registry(a.registry).register(given), sep="\n")
        return 0
    left, right, output = a.paths
    report.require_folder(output, overwrite=a.overwrite)
    mode, given, found = choose(a)
    try:
        result = compare.compare_archives(spark, left, right, settings, mode=mode, cache=a.cache_dir) if given is None else ownership.compare_owned(spark, given, settings)
    except ValueError as error:
        if given is None or a.ownership_config:
            raise
        found = {"status": "stale", "message": str(error)}  # the registered evidence no longer holds
        result = compare.compare_archives(spark, left, right, settings, mode="heuristic", cache=a.cache_dir)
    result["selection"] = {"requested": a.mode} | found
    print(report.write(result, output, overwrite=a.overwrite))
    if compare.incomplete(result):
        print("some code could not be read: the report has no certain result", file=sys.stderr)
        return 4
    return 0


def main(argv: list[str] | None = None) -> int:
    a = arguments(argv)
    try:
        return run(a)
    except (ValueError, OSError) as error:
        print(error, file=sys.stderr)
        return 2
    except Exception as error:  # noqa: BLE001  (a command says what went wrong)
        print(f"failed: {error}", file=sys.stderr)
        return 5


if __name__ == "__main__":
    sys.exit(main())
