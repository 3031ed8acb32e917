"""Facts of published schemas that the rule tables need, as JSON Schema. Fixed values."""

from __future__ import annotations


def _strings(*names: str) -> dict:
    return {n: {"type": "string"} for n in names}


def _closed(required: list[str], **properties) -> dict:
    return {"type": "object", "additionalProperties": False, "required": required, "properties": properties}


def _array(name: str) -> dict:
    return {"type": "array", "items": {"$ref": f"#/$defs/{name}"}}


_URI, _DATE = {"type": "string", "format": "uri"}, {"type": "string", "format": "date"}
_TAGS = {"tags": {"type": "array", "items": {"type": "string"}}}
_MORE = {"customProperties": _array("CustomProperty"), "authoritativeDefinitions": _array("AuthoritativeDefinition")}

#: Data products, version 1.0.0.
ODPS = _closed(
    ["apiVersion", "kind", "id", "status"],
    apiVersion={"type": "string", "enum": ["v0.9.0", "v1.0.0"]},
    kind={"type": "string", "enum": ["DataProduct"]},
    **_strings("id", "name", "version", "status", "domain", "tenant"),
    **_TAGS,
    **_MORE,
    description={"$ref": "#/$defs/Description"},
    inputPorts=_array("InputPort"),
    outputPorts=_array("OutputPort"),
    managementPorts=_array("ManagementPort"),
    support=_array("Support"),
    team={"$ref": "#/$defs/Team"},
    productCreatedTs={"type": "string", "format": "date-time"},
) | {
    "$defs": {
        "Description": _closed([], **_strings("purpose", "limitations", "usage"), **_MORE),
        "CustomProperty": _closed(["property", "value"], **_strings("property", "description"), value={}),
        "AuthoritativeDefinition": _closed(["type", "url"], **_strings("type", "description"), url=_URI),
        "InputPort": _closed(["name", "version", "contractId"], **_strings("name", "version", "contractId"), **_TAGS, **_MORE),
        "OutputPort": _closed(["name", "version"], **_strings("name", "description", "type", "version", "contractId"), sbom=_array("SBOM"), inputContracts=_array("InputContract"), **_TAGS, **_MORE),
        "SBOM": _closed(["url"], **_strings("type"), url=_URI),
        "InputContract": _closed(["id", "version"], **_strings("id", "version")),
        "ManagementPort": _closed(["name", "content"], **_strings("name", "content", "type", "channel", "description"), url=_URI, **_TAGS, **_MORE),
        "Support": _closed(["channel", "url"], **_strings("channel", "description", "tool", "scope"), url=_URI, invitationUrl=_URI, **_TAGS, **_MORE),
        "TeamMember": _closed(["username"], **_strings("username", "name", "description", "role", "replacedByUsername"), dateIn=_DATE, dateOut=_DATE, **_TAGS, **_MORE),
        "Team": _closed([], **_strings("name", "description"), members=_array("TeamMember"), **_TAGS, **_MORE),
    }
}


def _open(required: list[str], **properties) -> dict:
    return {"type": "object", "required": required, "properties": properties} if required else {"type": "object", "properties": properties}


def _listed(required: list[str], **properties) -> dict:
    return {"type": "array", "items": _open(required, **properties)}


def _one_of(*values: str) -> dict:
    return {"type": "string", "enum": list(values)}


_UUID, _TIME, _TEXTS = {"type": "string", "format": "uuid"}, {"type": "string", "format": "date-time"}, {"type": "array", "items": {"type": "string"}}

#: Compute assets, version 1.0.
CADS = _open(
    ["apiVersion", "kind", "id", "name", "version", "status"],
    apiVersion={"type": "string", "pattern": r"^v[0-9]+(\.[0-9]+)?$"},
    kind=_one_of("AIModel", "MLPipeline", "Application", "DataPipeline", "ETLProcess", "ETLPipeline", "SourceSystem", "DestinationSystem"),
    **_strings("id", "version", "domain"),
    name={"type": "string", "minLength": 3},
    status=_one_of("draft", "validated", "production", "deprecated"),
    domainId=_UUID,
    tags=_TEXTS,
    description=_open([], **_strings("purpose", "usage", "limitations"), externalLinks=_listed(["url"], url=_URI, **_strings("description"))),
    runtime=_open([], **_strings("environment"), endpoints={"type": "array", "items": _URI}, container=_open([], **_strings("image")), resources=_open([], **_strings("cpu", "memory", "gpu"))),
    sla=_open([], properties=_listed(["element", "value", "unit"], **_strings("element", "unit", "driver"), value={"type": ["number", "string"]})),
    pricing=_open([], model=_one_of("per_request", "per_hour", "per_batch", "subscription", "internal"), unitCost={"type": "number"}, **_strings("currency", "billingUnit", "notes")),
    team=_listed(["role", "name"], **_strings("role", "name", "contact")),
    risk=_open(
        [],
        classification=_one_of("minimal", "low", "medium", "high"),
        impactAreas={"type": "array", "items": _one_of("fairness", "privacy", "safety", "security", "financial", "operational", "reputational")},
        **_strings("intendedUse", "outOfScopeUse"),
        assessment=_open([], **_strings("methodology", "assessor"), date=_DATE),
        mitigations=_listed(["description", "status"], **_strings("description"), status=_one_of("planned", "implemented", "verified")),
    ),
    compliance=_open([], frameworks=_listed(["name", "status"], **_strings("name", "category"), status=_one_of("not_applicable", "assessed", "compliant", "non_compliant")), controls=_listed(["id", "description"], **_strings("id", "description", "evidence"))),
    validationProfiles=_listed(["name", "requiredChecks"], **_strings("name"), appliesTo=_open([], **_strings("kind", "riskClassification")), requiredChecks=_TEXTS),
    bpmnModels=_listed(["name", "reference", "format"], **_strings("name", "reference", "description"), format=_one_of("bpmn20-xml", "json")),
    dmnModels=_listed(["name", "reference", "format"], **_strings("name", "reference", "description"), format=_one_of("dmn13-xml", "json")),
    openApiSpecs=_listed(["name", "reference", "format"], **_strings("name", "reference", "description"), format=_one_of("openapi-3.0", "openapi-3.1", "swagger-2.0")),
    customProperties={"type": "object", "additionalProperties": True},
    createdAt=_TIME,
    updatedAt=_TIME,
)
