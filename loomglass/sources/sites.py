"""Site rules from YAML files, as a dimension table."""

from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession

LISTS = ("item", "item_url", "item_title", "item_date", "item_image", "item_desc", "strip", "body", "strip_id_or_class")
SCHEMA = "host string, kind string, ord int, " + ", ".join(f"{c} array<string>" for c in LISTS) + ", force_host string, allow_cross_host boolean, respect_robots boolean, prune boolean"


def load_sites(folder: str) -> list[dict]:
    """Records of all *.yml and *.yaml files of a folder, in order of their names; a file holds one record or a list.

    The host comes from the record, else from the file's name; a record without either raises ValueError.
    """
    out = []
    for p in sorted([*Path(folder).glob("*.yml"), *Path(folder).glob("*.yaml")]):
        data = yaml.safe_load(p.read_text(encoding="utf-8")) or []
        for record in data if isinstance(data, list) else [data]:
            host = str(record.get("host") or (p.stem if not isinstance(data, list) else "")).strip().lower()
            if not host:
                raise ValueError(f"{p.name}: a record has no host")
            out.append(site_record(host, record, len(out)))
    return out


def site_record(host: str, record: dict, order: int = 0) -> dict:
    def texts(v) -> list[str]:
        return [str(x) for x in (v if isinstance(v, list) else [v]) if x not in (None, "")]

    kind = "global" if host in ("*", "global") else "wildcard" if host.startswith("*.") else "exact"
    out = {"host": host.removeprefix("*."), "kind": kind, "ord": order, "force_host": str(record.get("force_host") or ""), "allow_cross_host": bool(record.get("allow_cross_host", False)), "respect_robots": record.get("respect_robots"), "prune": record.get("prune", True)}
    return out | {c: texts(record.get(c)) for c in LISTS}


def sites_table(spark: SparkSession, records: list[dict]) -> DataFrame:
    names = [c.strip().split()[0] for c in SCHEMA.split(",")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in records], SCHEMA)
