"""Command line: coast, depth, sea, place, nearest, regions, enrich and completions."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans import engine as E
from tidemark.plans.settings import Overrides, region_names, resolve
from tidemark.plans.staging import MADE, drop_staged, staged
from tidemark.sources.tables import FORMATS, default_output, read_table, write_table

SHELLS = ("bash", "zsh", "fish", "elvish", "powershell")


def _common(p: argparse.ArgumentParser) -> None:
    p.add_argument("input")
    p.add_argument("-o", "--output")
    p.add_argument("-c", "--config")
    p.add_argument("--in-format", choices=FORMATS)
    p.add_argument("--out-format", choices=FORMATS)
    p.add_argument("--overwrite", action="store_true", help="replace columns that exist")
    p.add_argument("--lon-col", default="longitude")
    p.add_argument("--lat-col", default="latitude")
    p.add_argument("--decimals", type=int, default=3)
    p.add_argument("-t", "--threads", type=int, help="local cores, where no cluster is set")
    p.add_argument("--single-file", action="store_true", help="one output file in place of a folder")


def _region(p: argparse.ArgumentParser) -> None:
    p.add_argument("--region", help="auto, a preset or a sea area")
    p.add_argument("--partition", action="store_true", help="one projection per part of the data")
    for name in ("min-lon", "max-lon", "min-lat", "max-lat", "proj-lon0", "proj-lat0"):
        p.add_argument(f"--{name}", type=float)


def _coast(p: argparse.ArgumentParser) -> None:
    p.add_argument("--unit", choices=("km", "m"), default="km")
    p.add_argument("--column", default="dist_to_coast")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tidemark", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)
    p = sub.add_parser("coast", help="distance to the nearest shoreline")
    _common(p), _region(p), _coast(p)
    p.add_argument("--data", required=True)
    p = sub.add_parser("depth", help="elevation of the nearest grid cell")
    _common(p)
    p.add_argument("--data", required=True)
    p.add_argument("--positive", action="store_true")
    p.add_argument("--on-land", action="store_true")
    p.add_argument("--column", default="bathymetry")
    p = sub.add_parser("sea", help="name of the sea area")
    _common(p), _region(p)
    p.add_argument("--data", required=True)
    p.add_argument("--name-field", default="NAME")
    p.add_argument("--column", default="sea_name")
    p = sub.add_parser("place", help="country and municipality")
    _common(p), _region(p)
    p.add_argument("--countries", required=True)
    p.add_argument("--municipalities")
    p.add_argument("--max-municipality-dist", type=float)
    p.add_argument("--unit", choices=("km", "m"), default="km")
    p = sub.add_parser("nearest", help="nearest row of a second table")
    _common(p)
    p.add_argument("--to", required=True)
    p.add_argument("--to-format", choices=FORMATS)
    p.add_argument("--to-lon-col", default="longitude")
    p.add_argument("--to-lat-col", default="latitude")
    p.add_argument("--name-field", default="name")
    p.add_argument("--unit", choices=("km", "m"), default="km")
    p.add_argument("--name-column", default="nearest_name")
    p.add_argument("--dist-column", default="nearest_dist")
    p = sub.add_parser("enrich", help="several commands in one run, in the order coast, depth, sea, place, nearest")
    _common(p), _region(p)
    for name in ("coast", "depth", "seas", "countries", "municipalities", "to"):
        p.add_argument(f"--{name}")
    p.add_argument("--dry-run", action="store_true")
    p.add_argument("-k", "--keep", metavar="FOLDER", help="also write the table as it is after each command, as Parquet")
    p = sub.add_parser("regions", help="boxes of named areas")
    p.add_argument("--data")
    p.add_argument("--name-field", default="NAME")
    p.add_argument("--name")
    p.add_argument("-o", "--output")
    p.add_argument("--out-format", choices=FORMATS)
    p.add_argument("-q", "--quiet", action="store_true")
    p = sub.add_parser("completions", help="a completion script")
    p.add_argument("shell", choices=SHELLS)
    return top


def completion_script(shell: str) -> str:
    """Commands, their options and region names, in the shell's own words."""
    actions = next(a for a in parser()._actions if isinstance(a, argparse._SubParsersAction)).choices
    words = {name: [o for a in p._actions for o in a.option_strings] for name, p in actions.items()}
    commands, every = " ".join(words), " ".join(sorted({o for w in words.values() for o in w}))
    regions = [n.replace("'", "'\\''") for n in region_names()]
    if shell == "bash":
        cases = "\n".join(f"    {c}) COMPREPLY=($(compgen -W '{' '.join(o)}' -- \"$cur\"));;" for c, o in words.items())
        names = "\\n".join(regions)
        return f"""_tidemark() {{
  local cur="${{COMP_WORDS[COMP_CWORD]}}" prev="${{COMP_WORDS[COMP_CWORD-1]}}"
  if [ "$prev" = --region ]; then local IFS=$'\\n'; COMPREPLY=($(compgen -W $'{names}' -- "$cur")); return; fi
  if [ "$COMP_CWORD" -eq 1 ]; then COMPREPLY=($(compgen -W '{commands}' -- "$cur")); return; fi
  case "${{COMP_WORDS[1]}}" in
{cases}
  esac
}}
complete -o default -F _tidemark tidemark
"""
    if shell == "zsh":
        return f"#compdef tidemark\n_arguments '1:command:({commands})' '--region[region]:region:({' '.join(n.replace(' ', chr(92) + ' ') for n in regions)})' '*:option:({every})'\n"
    if shell == "fish":
        lines = [f"complete -c tidemark -n __fish_use_subcommand -a {c}" for c in words]
        lines += [f"complete -c tidemark -n '__fish_seen_subcommand_from {c}' -l {o[2:]}" for c, w in words.items() for o in w if o.startswith("--")]
        lines += [f"complete -c tidemark -l region -x -a '{n}'" for n in regions]
        return "\n".join(lines) + "\n"
    quoted = " ".join(f"'{w}'" for w in [*words, *every.split()])
    if shell == "elvish":
        return f"set edit:completion:arg-completer[tidemark] = {{|@words| put {quoted} }}\n"
    names = ", ".join(f"'{w}'" for w in [*words, *every.split()])
    return f"Register-ArgumentCompleter -Native -CommandName tidemark -ScriptBlock {{ param($word) @({names}) | Where-Object {{ $_ -like \"$word*\" }} }}\n"


def area_table(areas: DataFrame) -> str:
    """Aligned text, two decimals. The list of areas is short by nature."""
    rows = [("name", "min_lon", "max_lon", "min_lat", "max_lat", "source")]
    rows += [(a["name"], *(f"{a[c]:.2f}" for c in rows[0][1:5]), a["source"]) for a in areas.toLocalIterator()]
    widths = [max(len(r[i]) for r in rows) for i in range(6)]
    return "\n".join("  ".join(v.ljust(w) if i in (0, 5) else v.rjust(w) for i, (v, w) in enumerate(zip(r, widths, strict=True))).rstrip() for r in rows)


def _lookups(spark: SparkSession, a: argparse.Namespace) -> list[E.Lookup]:
    from tidemark.sources import features as S
    from tidemark.sources.netcdf import read_grid

    if a.command == "coast":
        return [E.coast_lookup(S.read_shoreline(spark, a.data), a.unit, a.column)]
    if a.command == "depth":
        return [E.depth_lookup(*read_grid(spark, a.data), positive=a.positive, on_land=a.on_land, column=a.column)]
    if a.command == "sea":
        return [E.sea_lookup(S.read_features(spark, a.data, a.name_field), a.column)]
    if a.command == "place":
        towns = S.read_municipalities(spark, a.municipalities) if a.municipalities else None
        return [E.place_lookup(S.read_countries(spark, a.countries), towns, a.max_municipality_dist, a.unit)]
    if a.command == "nearest":
        return [E.nearest_lookup(read_table(spark, a.to, a.to_format), a.to_lon_col, a.to_lat_col, a.name_field, a.unit, a.name_column, a.dist_column)]
    found = []
    if a.coast:
        found.append(E.coast_lookup(S.read_shoreline(spark, a.coast)))
    if a.depth:
        found.append(E.depth_lookup(*read_grid(spark, a.depth)))
    if a.seas:
        found.append(E.sea_lookup(S.read_features(spark, a.seas)))
    if a.countries:
        found.append(E.place_lookup(S.read_countries(spark, a.countries), S.read_municipalities(spark, a.municipalities) if a.municipalities else None))
    if a.to:
        found.append(E.nearest_lookup(read_table(spark, a.to)))
    if not found:
        raise ValueError("nothing to enrich with")
    return found


def _commands(a: argparse.Namespace) -> list[str]:
    """The commands of a run of several, in order."""
    given = (("coast", a.coast), ("depth", a.depth), ("sea", a.seas), ("place", a.countries), ("nearest", a.to))
    return [name for name, value in given if value]


def _session(threads: int | None) -> SparkSession:
    builder = SparkSession.builder.appName("tidemark")
    if threads and "PYSPARK_GATEWAY_PORT" not in os.environ:  # else spark-submit has set the master
        builder = builder.master(f"local[{threads}]")
    return builder.getOrCreate()


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    if a.command == "completions":
        print(completion_script(a.shell), end="")
        return 0
    try:
        spark = spark or _session(getattr(a, "threads", None))
        if a.command == "regions":
            from tidemark.sources.features import read_features

            areas = E.Engine(spark).regions(read_features(spark, a.data, a.name_field) if a.data else None, a.name)
            if a.output:
                write_table(areas, a.output, a.out_format)
            if not a.quiet:
                print(area_table(areas))
                print(f"{areas.where(F.col('crosses_antimeridian')).count()} cross the antimeridian")
            return 0
        has_region = hasattr(a, "region")
        given = Overrides(*[getattr(a, n) for n in ("min_lon", "max_lon", "min_lat", "max_lat", "proj_lon0", "proj_lat0")]) if has_region else None
        s = resolve(a.region if has_region else None, given, a.config, has_region and a.partition, lon_col=a.lon_col, lat_col=a.lat_col, decimals=a.decimals, overwrite=a.overwrite)
        out = a.output or default_output(a.input, "enriched" if a.command == "enrich" else a.command, a.in_format)
        before = len(MADE)
        lookups = _lookups(spark, a)
        if getattr(a, "dry_run", False):
            print(", ".join(f.name for x in lookups for f in x.outputs), "->", out)
            return 0
        engine = E.Engine(spark, s)
        try:
            table = read_table(spark, a.input, a.in_format)
            result = engine.run(table, *lookups)
            if getattr(a, "keep", None):
                result = staged(result)  # computed once, written several times
                for step, name in enumerate(_commands(a)[:-1]):
                    made = {f.name for x in lookups[step + 1 :] for f in x.outputs} - set(table.columns)
                    write_table(result.drop(*made), f"{a.keep}/step{step}.{name}.parquet", "parquet")
            write_table(result, out, a.out_format, a.single_file)
        finally:  # the tables of this run only: the session may hold others' results
            drop_staged(spark, before)
        r = engine.told()
        for note in r.notes:
            print(f"tidemark: {note}", file=sys.stderr)
        print(f"{r.rows} rows, {r.unique} locations, {r.unresolved} unresolved -> {out}", file=sys.stderr)
        return 0
    except ValueError as e:
        print(f"tidemark: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
