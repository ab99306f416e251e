"""Text documents: YAML manifests and JSON objects."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from steward.functions.jsontext import is_json_object
from steward.session import ship_package
from steward.schemas import (
    ERROR, MANIFEST_FORBIDDEN_FIELDS, PENDING_ALLOWED_KEYS, PENDING_REQUIRED_KEYS, PENDING_STATUS,
)

ENTRY_FIELDS = (
    "source_id", "fal_version", "ontology_version", "profile_version", "source_file",
    "source_hash", "resource_uri",
)
_ENTRY = "struct<" + ",".join(f"{f}:string" for f in ENTRY_FIELDS) + (
    ",has_forbidden_field:boolean,is_object:boolean,odd_fields:array<string>>"
)
_SCAN = (
    f"manifest_id string, codes array<struct<code:string,path:string>>, version bigint, "
    f"pending_shape boolean, sources array<{_ENTRY}>"
)


def _strict_loader():
    """A safe YAML loader that refuses repeated keys at any level."""
    import yaml

    class RepeatedKey(yaml.YAMLError):
        pass

    class Strict(yaml.SafeLoader):
        pass

    def mapping(loader, node):
        loader.flatten_mapping(node)
        keys = [loader.construct_object(key, deep=True) for key, _ in node.value]
        hashable = [k for k in keys if not isinstance(k, (dict, list, set))]
        if len(set(hashable)) < len(hashable):
            raise RepeatedKey("repeated key")
        return loader.construct_mapping(node, deep=True)

    Strict.add_constructor(yaml.resolver.BaseResolver.DEFAULT_MAPPING_TAG, mapping)
    return Strict, RepeatedKey


def _is_pending(root: dict) -> bool:
    keys = set(root)
    statuses = [
        part.get("status") if isinstance(part := root.get(name), dict) else None
        for name in ("standard", "ingestion")
    ]
    return (
        set(PENDING_REQUIRED_KEYS) <= keys <= set(PENDING_ALLOWED_KEYS)
        and root["files"] == []
        and statuses == [PENDING_STATUS, PENDING_STATUS]
    )


def _entry(item: object) -> dict:
    if not isinstance(item, dict):
        return {"is_object": False, "has_forbidden_field": False, "odd_fields": []}
    odd = [str(k) for k in item if k not in ENTRY_FIELDS and k not in MANIFEST_FORBIDDEN_FIELDS]
    odd += [k for k in ENTRY_FIELDS if item.get(k) is not None and not isinstance(item[k], str)]
    return {
        **{k: item[k] if isinstance(item.get(k), str) else None for k in ENTRY_FIELDS},
        "is_object": True,
        "has_forbidden_field": any(k in item for k in MANIFEST_FORBIDDEN_FIELDS),
        "odd_fields": odd,
    }


def _parse(manifest_id: str, content: bytes, loader, repeated) -> dict:
    import yaml

    row = {"manifest_id": manifest_id, "codes": [], "version": None, "pending_shape": False,
           "sources": []}

    def failed(*codes: tuple[str, str]) -> dict:
        return {**row, "codes": [{"code": c, "path": p} for c, p in codes]}

    try:
        root = yaml.load(bytes(content).decode("utf-8"), Loader=loader)
    except repeated:
        return failed(("MANIFEST_DUPLICATE_KEY", "$"))
    except (UnicodeDecodeError, yaml.YAMLError):
        return failed(("MANIFEST_YAML_INVALID", "$.manifestPath"))
    if not isinstance(root, dict):
        return failed(("MANIFEST_ROOT_NOT_OBJECT", "$"))
    row["pending_shape"] = _is_pending(root)
    version, sources = root.get("version"), root.get("sources")
    bad = []
    if isinstance(version, bool) or not isinstance(version, int):
        bad.append(("MANIFEST_CONTRACT_INVALID", "$.version"))
    if not isinstance(sources, list):
        bad.append(("MANIFEST_CONTRACT_INVALID", "$.sources"))
    if bad:
        return failed(*bad)
    return {**row, "version": version, "sources": [_entry(item) for item in sources]}


def _parse_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    loader, repeated = _strict_loader()
    for batch in batches:
        rows = zip(batch["manifest_id"], batch["content"], strict=True)
        yield pd.DataFrame([_parse(m, c, loader, repeated) for m, c in rows],
                           columns=["manifest_id", "codes", "version", "pending_shape", "sources"])


def scan_manifests(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """`(manifests, entries, findings)` from `manifest_id, content` rows holding YAML bytes.

    Each file is parsed where it lies; entries are numbered in file order. Entries that are no
    objects, and fields of a wrong type or unknown name, are findings here because the typed
    entries table cannot show them.
    """
    ship_package(files.sparkSession)
    parsed = files.select("manifest_id", "content").mapInPandas(_parse_batches, _SCAN)
    manifests = parsed.filter(F.size("codes") == 0).select("manifest_id", "version", "pending_shape")
    pending = parsed.filter(F.size("codes") > 0).select(
        "manifest_id", F.lit(None).cast("bigint").alias("version"), "pending_shape"
    )
    items = parsed.select("manifest_id", F.posexplode("sources").alias("entry_index", "e"))
    entries = items.filter("e.is_object").select(
        "manifest_id", F.col("entry_index").cast("bigint").alias("entry_index"),
        *[f"e.{name}" for name in ENTRY_FIELDS], "e.has_forbidden_field",
    )
    own = parsed.select("manifest_id", F.explode("codes").alias("f")).select("manifest_id", "f.*")
    not_objects = items.filter("NOT e.is_object").selectExpr(
        "manifest_id", "'MANIFEST_CONTRACT_INVALID' AS code", "'$.sources.' || entry_index AS path"
    )
    odd = items.filter("e.is_object AND NOT e.has_forbidden_field").select(
        "manifest_id", "entry_index", F.explode("e.odd_fields").alias("name")
    ).selectExpr(
        "manifest_id", "'MANIFEST_ENTRY_INVALID' AS code",
        "'$.sources.' || entry_index || '.' || name AS path",
    )
    findings = own.unionByName(not_objects).unionByName(odd).select(
        F.col("manifest_id").alias("subject_id"), F.lit(ERROR).alias("severity"), "code", "path"
    )
    return manifests.unionByName(pending), entries, findings


JSON_CODES = {
    "authorization": "AUTHORIZATION_JSON_INVALID",
    "binding": "OUTPUT_ROOT_BINDING_JSON_INVALID",
    "report": "INSPECTION_REPORT_INVALID",
}


def scan_json_objects(docs: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """`(documents that are one JSON object, findings)` from `doc_id, doc` text rows."""
    good = is_json_object(F.col("doc"))
    bad = docs.filter(~F.coalesce(good, F.lit(False))).select(
        F.col("doc_id").alias("subject_id"), F.lit(ERROR).alias("severity"),
        F.lit(JSON_CODES[kind]).alias("code"),
    )
    return docs.filter(good), bad
