"""Commands: ``python -m kinfold.cli COMMAND --in TABLE --out FOLDER``; exit codes 0 clean, 1 findings, 2 blocked or bad usage, 3 out of memory."""

from __future__ import annotations

import argparse
import sys
from dataclasses import fields
from pathlib import Path

from kinfold.operators import disclosure, effective_size, mates, relatives
from kinfold.plans import reports
from kinfold.plans.validation import Options
from kinfold.session import local_session, ship, stored
from kinfold.sources import sinks
from kinfold.sources.delimited import SourceError, read_table

#: What each command may write, and removes of an earlier run.
OUTPUTS = {
    "summarize": ("summarize.yaml", "summarize.extra.yaml", "annotated.tsv", "summary.tsv", "burden.tsv", "summarize.log", "summarize.ids.local.log"),
    "validate": ("validate.yaml", "validate.extra.yaml", "validate.log", "validate.tsv", "validate.dropped.tsv", "validate.cleared.tsv"),
    "effective-size": ("effective-size.yaml", "effective-size.extra.yaml", "effective-size.log", "effective-size.ids.local.log"),
    "assortative-mating": ("assortative-mating.yaml", "assortative-mating.extra.yaml", "assortative-mating.log", "assortative-mating.ids.local.log"),
    "relatives-input": ("relatives-input.log", "relatives-input.yaml", "relatives-input.extra.yaml", "skeleton.tsv", "skeleton.parquet", "pairs.tsv", "pairs.parquet"),
}
COLUMNS = {"--id-col": "id", "--sex-col": "sex", "--mother-col": "mother", "--father-col": "father", "--birth-year-col": "birth_year", "--birth-date-col": "birth_date", "--multiple-birth-col": "multiple_birth", "--zygosity-col": "zygosity"}
NUMBERS = {"--birth-year-min": "birth_year_min", "--birth-year-max": "birth_year_max", "--min-parent-age": "min_parent_age", "--max-parent-age": "max_parent_age", "--max-children-mother": "max_children_mother", "--max-children-father": "max_children_father"}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="kinfold")
    sub = p.add_subparsers(dest="command", required=True)
    common = argparse.ArgumentParser(add_help=False)
    common.add_argument("--in", dest="source", required=True)
    common.add_argument("--out", required=True)
    common.add_argument("--sep")
    for flag, name in COLUMNS.items():
        common.add_argument(flag, dest=name)
    for flag, name in NUMBERS.items():
        common.add_argument(flag, dest=name, type=int)
    common.add_argument("--missing-parent-token", action="append", default=[])
    common.add_argument("--allow-missing-sex", action="store_true")
    common.add_argument("--no-override-asserted-sex", action="store_true")
    common.add_argument("--single-file", action="store_true", help="tables with a row per individual as one part, written by one task")
    common.add_argument("--threads", default="*")
    common.add_argument("--max-memory", default="8g")
    safe = argparse.ArgumentParser(add_help=False)
    safe.add_argument("--safe-attempt", action="store_true")
    safe.add_argument("--min-cell", type=int, default=disclosure.MIN_CELL)
    safe.add_argument("--id-log", action="store_true")

    s = sub.add_parser("summarize", parents=[common, safe])
    s.add_argument("--inbreeding", action=argparse.BooleanOptionalAction, default=True)
    s.add_argument("--max-degree", type=int, choices=range(1, 6))
    s.add_argument("--per-individual-burden", "--per-individual-pairs", action="store_true")
    s.add_argument("--sex-concordance", action="store_true")
    s.add_argument("--sex-concordance-permutations", type=int, default=0)
    s.add_argument("--sex-concordance-seed", type=int, default=1)
    s.add_argument("--tsv", action="store_true")

    s = sub.add_parser("validate", parents=[common])
    s.add_argument("--twin-max-days", type=int)
    s.add_argument("--no-sex-check", action="store_true")
    s.add_argument("--drop-offending", action="store_true")
    s.add_argument("--break-cycles", action="store_true")
    s.add_argument("--break-role-conflicts", action="store_true")
    s.add_argument("--fill-half-founders", action="store_true")

    s = sub.add_parser("effective-size", parents=[common, safe])
    s.add_argument("--estimators", default="all")
    s.add_argument("--reference-col")

    s = sub.add_parser("assortative-mating", parents=[common, safe])
    s.add_argument("--trait", nargs="+", required=True)
    s.add_argument("--trait-type", nargs="*", default=[])
    s.add_argument("--trait-missing", nargs="*", default=[])
    s.add_argument("--stratify-by", choices=("depth", "birth_year"))
    s.add_argument("--birth-year-bin", type=int, default=10)
    s.add_argument("--min-stratum-networks", type=int, default=mates.MIN_STRATUM_NETWORKS)
    s.add_argument("--permutations", type=int, default=999)
    s.add_argument("--bootstrap", type=int, default=0)
    s.add_argument("--seed", type=int, default=1)

    s = sub.add_parser("relatives-input", parents=[common])
    s.add_argument("--rels", nargs="+", default=list(relatives.DEFAULT), choices=list(relatives.KINDS))
    s.add_argument("--base-year", type=int, default=1900)
    s.add_argument("--drop-founders", action="store_true")
    s.add_argument("--pairs", action="store_true")
    s.add_argument("--exact-kinship", action="store_true")
    s.add_argument("--disorder", default="trait1")
    s.add_argument("--parquet", action="store_true")
    return p


def options_of(a: argparse.Namespace) -> Options:
    known = {f.name for f in fields(Options)}
    got = {k: v for k, v in vars(a).items() if k in known and v is not None}
    got |= {"missing_parent": tuple(a.missing_parent_token), "override_asserted_sex": not a.no_override_asserted_sex, "sex_check": not getattr(a, "no_sex_check", False)}
    return Options(**got)


def check_usage(p: argparse.ArgumentParser, a: argparse.Namespace) -> None:
    """Options that contradict or need each other end with exit code 2, before anything is read."""
    o = options_of(a)
    safe = getattr(a, "safe_attempt", False)
    twins = getattr(a, "twin_max_days", None)
    traits = getattr(a, "trait", [])
    stated = [t.split("=", 1)[0] for t in getattr(a, "trait_type", [])]
    rules = [
        (0 < o.max_parent_age < o.min_parent_age, f"--min-parent-age {o.min_parent_age} is above --max-parent-age {o.max_parent_age}"),
        (getattr(a, "break_cycles", False) and not (o.birth_year or o.birth_date), "--break-cycles needs --birth-year-col or --birth-date-col"),
        (twins is not None and not o.birth_date, "--twin-max-days needs --birth-date-col"),
        (twins is not None and o.multiple_birth, "--twin-max-days and --multiple-birth-col both define the sets: pass one"),
        (twins is not None and twins > Options().twin_max_days, f"--twin-max-days must be {Options().twin_max_days} or less"),
        (o.zygosity and not o.multiple_birth, "--zygosity-col needs --multiple-birth-col"),
        (getattr(a, "id_log", False) and not safe, "--id-log needs --safe-attempt"),
        (safe and a.min_cell < disclosure.FLOOR, f"--min-cell must be {disclosure.FLOOR} or more"),
        (safe and (getattr(a, "per_individual_burden", False) or getattr(a, "tsv", False)), "--safe-attempt writes no table of individuals"),
        (getattr(a, "per_individual_burden", False) and a.max_degree not in (None, 5), "--per-individual-burden always counts degrees 1 to 5: drop --max-degree"),
        (len(traits) > 2, f"--trait takes one or two columns, not {len(traits)}"),
        (len(set(traits)) != len(traits), "--trait names a column twice"),
        (any("=" not in t for t in getattr(a, "trait_type", [])), "--trait-type takes COLUMN=KIND"),
        (any(t not in traits for t in stated), "--trait-type names a column that isn't a --trait"),
        (len(set(stated)) != len(stated), "--trait-type names a column twice"),
        (getattr(a, "stratify_by", None) == "birth_year" and not o.birth_year, "--stratify-by birth_year needs --birth-year-col"),
        (getattr(a, "min_stratum_networks", None) is not None and a.min_stratum_networks < 1, "--min-stratum-networks must be 1 or more"),
        (a.command == "effective-size" and a.estimators != "all" and bool({e.removeprefix("ne_") for e in a.estimators.split(",")} - set(effective_size.ESTIMATORS)), "--estimators names one that there isn't"),
    ]
    for broken, message in rules:
        if broken:
            p.error(message)


def run(argv: list[str] | None = None) -> int:
    p = parser()
    a = p.parse_args(argv)
    check_usage(p, a)
    safe = getattr(a, "safe_attempt", False)
    own = OUTPUTS[a.command]
    out = sinks.prepare_out_dir(a.out, own, safe)
    if any((out / n).exists() and (out / n).resolve() == Path(a.source).resolve() for n in own):
        p.error(f"{a.source} is an output of this command")
    sinks.remove_stale(out, own)
    spark = ship(local_session(a.threads, memory=a.max_memory))
    try:
        raw, o = stored(read_table(spark, a.source, a.sep), "input"), options_of(a)
        sinks.log_ids(out, a.command, raw, o.id, safe, getattr(a, "id_log", False))
        degree = 5 if getattr(a, "per_individual_burden", False) else getattr(a, "max_degree", None) or 2
        if a.command == "summarize":
            if a.safe_attempt:
                got = reports.safe_summary(raw, o, a.min_cell, degree, a.inbreeding)
            else:
                got = reports.summarize(raw, o, a.inbreeding, degree, a.per_individual_burden, a.sex_concordance, a.sex_concordance_permutations, a.sex_concordance_seed)
                sinks.write_delimited(sinks.annotated(got.tables["individual"], raw, o.id), str(out / "annotated.tsv"), single=a.single_file, gzip=True)
                if a.tsv:
                    sinks.write_delimited(sinks.long_table(spark, got.payload), str(out / "summary.tsv"), single=True)
                if "burden" in got.tables:
                    sinks.write_delimited(got.tables["burden"], str(out / "burden.tsv"))
        elif a.command == "validate":
            got = reports.validate(raw, o, a.drop_offending, a.fill_half_founders, a.twin_max_days)
            sinks.write_delimited(got.tables["findings"], str(out / "validate.log"), single=True)
            for name in ("dropped", "cleared"):
                if name in got.tables:
                    sinks.write_delimited(got.tables[name], str(out / f"validate.{name}.tsv"), single=True)
            if "fixed" in got.tables:
                sinks.fixed_pedigree(got.tables["fixed"], str(out / "validate.tsv"), single=a.single_file, gzip=True)
            print(got.payload["summary"], file=sys.stderr)
        elif a.command == "effective-size":
            named = {e.removeprefix("ne_") for e in a.estimators.split(",")}
            chosen = tuple(e for e in effective_size.ESTIMATORS if a.estimators == "all" or e in named)
            got = reports.effective_sizes(raw, o, chosen, a.reference_col, a.min_cell if safe else None)
        elif a.command == "assortative-mating":
            got = reports.assortative_mating(raw, o, a.trait, dict(t.split("=", 1) for t in a.trait_type), tuple(a.trait_missing), a.stratify_by, a.birth_year_bin, a.permutations, a.bootstrap, a.seed, a.min_cell if safe else None, a.min_stratum_networks)
        else:
            got = reports.relatives_input(raw, o, tuple(a.rels), a.base_year, a.drop_founders, a.exact_kinship, a.disorder)
            for name in ("skeleton", *(["pairs"] if a.pairs else [])):
                sinks.write_delimited(got.tables[name], str(out / f"{name}.tsv"), gzip=True)
                if a.parquet:
                    sinks.write_parquet(got.tables[name], str(out / f"{name}.parquet"), "kind")
        sinks.write_report(out, a.command, got.payload)
        return got.code
    except (SourceError, reports.Blocked, reports.Unsupported, ValueError) as e:
        print(f"{a.command}: {type(e).__name__ if safe else e}", file=sys.stderr)
        return 2 if isinstance(e, SourceError | reports.Blocked | reports.Unsupported) else 1
    except Exception as e:  # the JVM says so when memory runs out
        if "OutOfMemoryError" not in str(e):
            raise
        print(f"{a.command}: out of memory; raise --max-memory", file=sys.stderr)
        return 3


if __name__ == "__main__":
    sys.exit(run())
