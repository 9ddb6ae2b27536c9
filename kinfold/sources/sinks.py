"""Writers: delimited tables, long reports, YAML, manifests."""

from __future__ import annotations

import math
import os
import shutil
from collections.abc import Iterator
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.functions.tokens import plink_sex
from kinfold.operators.disclosure import Public, safe_message

#: What a summary keeps in the slim report; the rest goes to the extra one.
SLIM = ("structure", "demography", "relatedness")


def write_delimited(df: DataFrame, path: str, sep: str = "\t", single: bool = False, gzip: bool = False) -> None:
    """A folder of part files with headers; ``single`` makes one part, for tables that one machine can hold."""
    out = df.coalesce(1) if single else df
    out.write.mode("overwrite").option("header", True).option("sep", sep).option("nullValue", "").option("emptyValue", "").option("compression", "gzip" if gzip else "none").csv(path)


def write_parquet(df: DataFrame, path: str, by: str | None = None) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(by) if by else w).parquet(path)


def fixed_pedigree(fixed: DataFrame, path: str, **options) -> None:
    """id, PLINK sex and parents first, -1 for an unknown parent; founders first."""
    shown = [F.col("id"), plink_sex("sex").alias("sex"), *(F.coalesce(F.col(p).cast("string"), F.lit("-1")).alias(p) for p in ("mother", "father"))]
    rest = [c for c in fixed.columns if c not in ("id", "sex", "mother", "father", "ped_depth", "row")]
    write_delimited(fixed.orderBy("ped_depth", F.col("row").asc_nulls_first()).select(*shown, *rest), path, **options)


def annotated(individual: DataFrame, raw: DataFrame, id_column: str) -> DataFrame:
    """The individual table with the input's other columns; one that clashes gets the suffix _input, a stale sex_source goes."""
    extra = [c for c in raw.columns if c not in (id_column, "row", "sex_source")]
    names = {c: f"{c}_input" if c in individual.columns else c for c in extra}
    own = raw.select(F.col(id_column).alias("_key"), *(F.col(c).alias(n) for c, n in names.items()))
    return individual.join(own, F.col("id").cast("string") == F.col("_key"), "left").drop("_key")


def rounded(x: Any, places: int = 4, significant: bool = False) -> Any:
    """Floats to so many decimals; with ``significant``, values under 0.1 to so many significant figures."""
    if isinstance(x, dict):
        return {k: rounded(v, places, significant) for k, v in x.items()}
    if isinstance(x, list | tuple):
        return [rounded(v, places, significant) for v in x]
    if isinstance(x, float):
        if not math.isfinite(x):
            return None
        if significant and x and abs(x) < 0.1:
            return float(f"{x:.{places}g}")
        return round(x, places)
    return x


def flatten(payload: dict, section: str = "") -> Iterator[tuple[str, str, str, str]]:
    """(section, key, subkey, value) of a nested report."""
    for name, part in payload.items():
        where = f"{section}.{name}" if section else name
        if not isinstance(part, dict):
            yield section, name, "", "" if part is None else str(rounded(part))
        elif any(isinstance(v, dict) for v in part.values()) and not section:
            yield from flatten(part, where)
        else:
            for k, v in part.items():
                if isinstance(v, dict):
                    for s, x in v.items():
                        yield where, str(k), str(s), "" if x is None else str(rounded(x))
                else:
                    yield where, str(k), "", "" if v is None else str(rounded(v))


def long_table(spark: SparkSession, payload: dict) -> DataFrame:
    return spark.createDataFrame(list(flatten(payload)), "section string, key string, subkey string, value string")


def yaml(x: Any, indent: int = 0) -> str:
    """A report as YAML (scalars, lists and dicts)."""
    pad = "  " * indent

    def scalar(v: Any) -> str:
        if v is None:
            return "null"
        if isinstance(v, bool):
            return "true" if v else "false"
        if isinstance(v, int | float):
            return repr(v)
        s = str(v)
        plain = s and s[0].isalpha() and all(c.isalnum() or c in "_-./ +" for c in s) and s.strip() == s and s.lower() not in ("null", "true", "false", "yes", "no", "on", "off", "y", "n")
        return s if plain else "'" + s.replace("'", "''") + "'"

    if isinstance(x, dict):
        lines = []
        for k, v in x.items():
            if isinstance(v, dict | list) and v:
                lines.append(f"{pad}{scalar(k)}:\n{yaml(v, indent + 1)}")
            else:
                lines.append(f"{pad}{scalar(k)}: {'{}' if v == {} else '[]' if v == [] else scalar(v)}\n")
        return "".join(lines)
    if isinstance(x, list):
        return "".join(f"{pad}- {scalar(v)}\n" if not isinstance(v, dict | list) else f"{pad}-\n{yaml(v, indent + 1)}" for v in x)
    return f"{pad}{scalar(x)}\n"


def publish(path: str | Path, text: str) -> None:
    """Write beside the target and rename, so that a reader never sees half a file (driver-side reports)."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    part = path.with_name(f".{path.name}.partial-{os.getpid()}")
    part.write_text(text)
    os.replace(part, path)


def write_report(folder: str | Path, name: str, payload: dict, significant: bool = False) -> None:
    """``name.yaml`` with the slim sections and ``name.extra.yaml`` with the others."""
    shown = rounded(payload, 4, significant)
    slim = {k: v for k, v in shown.items() if k in SLIM}
    publish(Path(folder) / f"{name}.yaml", yaml(slim or shown))
    if slim and len(slim) < len(shown):  # a report without slim sections is one file
        publish(Path(folder) / f"{name}.extra.yaml", yaml({k: v for k, v in shown.items() if k not in SLIM}))


def remove_stale(folder: Path, names: tuple[str, ...]) -> None:
    """Outputs of an earlier run, which would else pass for this input's."""
    for name in names:
        path = folder / name
        if path.is_dir():
            shutil.rmtree(path)
        elif path.exists():
            path.unlink()


def id_sample(raw: DataFrame, id_column: str, k: int = 5) -> list[str]:
    """A few ids, the same in every run: those of least hash."""
    return [r[0] for r in raw.select(F.trim(id_column).alias("i")).where("i is not null").distinct().orderBy(F.xxhash64("i"), "i").limit(k).collect()]


def log_ids(folder: Path, command: str, raw: DataFrame, id_column: str, safe: bool, id_log: bool) -> None:
    """A line with the number of rows and a sample of ids; in safe mode ids go to a file of their own, and only if asked for."""
    if id_column not in raw.columns:
        return
    sample = ", ".join(id_sample(raw, id_column)) if id_log or not safe else ""
    if safe:
        publish(folder / f"{command}.log", safe_message("read %s from column %s\n", raw.count(), Public(id_column)))
        if id_log:
            publish(folder / f"{command}.ids.local.log", f"ids read, for example: {sample}\n")
    elif command != "validate":
        publish(folder / f"{command}.log", f"read {raw.count()} rows; ids, for example: {sample}\n")


def prepare_out_dir(folder: str | Path, known: tuple[str, ...] = (), safe: bool = False) -> Path:
    """The output folder; a file in its place is refused, and in safe mode files of others."""
    folder = Path(folder)
    if folder.exists() and not folder.is_dir():
        raise NotADirectoryError(f"{folder} is a file")
    folder.mkdir(parents=True, exist_ok=True)
    if safe and (foreign := sorted(p.name for p in folder.iterdir() if p.name not in known)):
        raise FileExistsError(f"{folder} holds other files: {', '.join(foreign[:5])}")
    return folder
