"""Row schemas that the operators share."""

from __future__ import annotations

NODES = "doc_id string, seq int, pointer string, parent string, key string, idx int, depth int, kind string, sval string, nval double, n_children int, rule_path string"

FINDINGS = "doc_id string, spec_id string, severity string, severity_rank int, code string, message string, line int, column int, pointer string, help string, spec_version string, section string, seq long"

REGISTRY = (
    "id string, name string, version string, homepage string, repository string, steward string, licence string, pinned_ref string, vendored_path string, sha256 string, fetched_at string, notes string, "
    "poll struct<endpoint:string,method:string,field:string,cadence:string>, idx int"
)
