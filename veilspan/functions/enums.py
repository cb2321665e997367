"""Closed vocabularies of the data model.  Order is rank where a rank is meant."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
SEMANTIC_CLASSES = (
    "PERSON", "CREDENTIAL_OR_SECRET", "USER_ACCOUNT", "NETWORK_IDENTIFIER", "HOST_OR_SERVICE", "CLOUD_RESOURCE",
    "FILE_OR_RESOURCE_PATH", "CUSTOMER_OR_PARTNER", "PROJECT_OR_CONTRACT", "APPLICATION_OR_ENVIRONMENT",
    "ENGINEERING_IDENTIFIER", "BUSINESS_CONFIDENTIAL",
)
SUBTYPES = {
    "PERSON": ("NAME", "EMAIL", "PHONE"),
    "CREDENTIAL_OR_SECRET": ("PASSWORD", "API_KEY", "PRIVATE_KEY", "ACCESS_TOKEN", "REFRESH_TOKEN", "COOKIE", "CONNECTION_SECRET", "CERTIFICATE_SECRET"),
    "NETWORK_IDENTIFIER": ("IP", "PORT", "DOMAIN", "URL", "MAC", "SUBNET"),
    "CLOUD_RESOURCE": ("TENANT_ID", "SUBSCRIPTION_ID", "ACCOUNT_ID", "ARN", "PROJECT_ID", "RESOURCE_GROUP", "BUCKET", "VAULT", "SERVICE_ACCOUNT"),
    "ENGINEERING_IDENTIFIER": ("ASSET_TAG", "DRAWING_NUMBER", "PART_NUMBER", "ITEM_ID", "DOCUMENT_ID", "FUNCTIONAL_LOCATION", "PLC_TAG", "SCADA_TAG"),
}
SENSITIVITIES = ("PUBLIC", "INTERNAL", "CONFIDENTIAL", "RESTRICTED", "SECRET")
TRUST = ("CONTROL", "TRUSTED", "VERIFIED_EXTERNAL", "UNTRUSTED", "HOSTILE")
SCOPES = ("request", "session", "project", "tenant")
TREATMENTS = ("KEEP", "MASK", "TOKENIZE", "SYNTHETIC", "GENERALIZE", "REMOVE", "BLOCK", "REQUIRE_REVIEW")
OPERATIONS = ("SEND", "USE", "DISPLAY", "EXPORT")
INTERACTIONS = (
    "model.input", "model.output", "tool.call", "tool.result", "mcp.list", "mcp.resource", "mcp.prompt", "mcp.call", "mcp.result", "file.list", "file.read", "file.search", "file.write", "file.diff",
    "shell.command", "shell.stdout", "shell.stderr", "skill.load", "skill.resource", "skill.execute", "memory.read", "memory.write", "web.request", "web.response", "agent.handoff", "agent.result",
)
#: Treatments from most to least restrictive; the release level of a selected one is 20 and its place.
RESTRICTION = ("REMOVE", "MASK", "TOKENIZE", "SYNTHETIC", "GENERALIZE", "KEEP")
REPRESENTATIONS = ("EXACT", "IDENTITY_SYNTHETIC", "OPAQUE_TOKEN", "SEMANTIC_PLACEHOLDER", "GENERALIZED", "REMOVED", "WITHHELD")
SECRET_REPRESENTATIONS = ("SEMANTIC_PLACEHOLDER", "REMOVED", "WITHHELD")
SATISFIES = {
    "EXACT_VALUE": ("EXACT",),
    "EXISTENCE": ("EXACT", "IDENTITY_SYNTHETIC", "OPAQUE_TOKEN", "SEMANTIC_PLACEHOLDER", "GENERALIZED"),
    "KIND": ("EXACT", "IDENTITY_SYNTHETIC", "OPAQUE_TOKEN", "SEMANTIC_PLACEHOLDER", "GENERALIZED"),
    "VALUE_SHAPE": ("EXACT", "IDENTITY_SYNTHETIC"),
    "SYNTAX": ("EXACT", "IDENTITY_SYNTHETIC", "OPAQUE_TOKEN", "SEMANTIC_PLACEHOLDER", "GENERALIZED", "REMOVED"),
    "RELATIONSHIP": ("EXACT", "IDENTITY_SYNTHETIC", "OPAQUE_TOKEN"),
    "CONSISTENCY": ("EXACT", "IDENTITY_SYNTHETIC", "OPAQUE_TOKEN"),
    "GENERALIZED": ("EXACT", "GENERALIZED"),
    "NOT_REQUIRED": REPRESENTATIONS,
}
#: (state, action) -> next state of a mapping.
TRANSITIONS = {
    ("CREATED", "ACTIVATE"): "ACTIVE", ("CREATED", "EXPIRE"): "EXPIRED", ("CREATED", "REVOKE"): "REVOKED", ("CREATED", "DELETE"): "DELETED",
    ("ACTIVE", "EXPIRE"): "EXPIRED", ("ACTIVE", "REVOKE"): "REVOKED", ("ACTIVE", "DELETE"): "DELETED",
    ("EXPIRED", "EXPIRE"): "EXPIRED", ("EXPIRED", "DELETE"): "DELETED",
    ("REVOKED", "REVOKE"): "REVOKED", ("REVOKED", "DELETE"): "DELETED",
    ("DELETED", "DELETE"): "DELETED",
}
WELL_KNOWN_PORTS = {
    20: "ftp-data", 21: "ftp", 22: "ssh", 23: "telnet", 25: "smtp", 53: "dns", 80: "http", 110: "pop3", 123: "ntp",
    143: "imap", 389: "ldap", 443: "https", 445: "smb", 465: "smtps", 502: "modbus", 587: "submission", 636: "ldaps",
    993: "imaps", 995: "pop3s", 1433: "mssql", 1521: "oracle", 1883: "mqtt", 2049: "nfs", 2375: "docker", 2376: "docker-tls",
    3306: "mysql", 3389: "rdp", 4840: "opc-ua", 5432: "postgresql", 5672: "amqp", 5985: "winrm", 5986: "winrm-https",
    6379: "redis", 6443: "kubernetes-api", 8080: "http-alt", 8443: "https-alt", 8883: "mqtt-tls", 9092: "kafka",
    9200: "elasticsearch", 20000: "dnp3", 27017: "mongodb", 44818: "ethernet-ip", 47808: "bacnet",
}


def rank(value: str | Column, order: tuple[str, ...]) -> Column:
    """Place of a value in ``order``, from 0; null where it is not there."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col(value) if isinstance(value, str) else value)
    return F.when(place > 0, place - 1).cast("int")


def named(place: Column, order: tuple[str, ...], other: str = "UNKNOWN") -> Column:
    """The value at a place of ``order``; ``other`` for null."""
    return F.coalesce(F.get(F.array(*map(F.lit, order)), place), F.lit(other))


def reasons(*cases: tuple[Column, str]) -> Column:
    """Sorted array of the names whose condition holds."""
    return F.array_sort(F.array_compact(F.array(*(F.when(c, F.lit(n)) for c, n in cases))))


def first_failing(*cases: tuple[Column, str], otherwise: str) -> Column:
    """Name of the first condition that holds: an ordered chain of refusals."""
    return F.coalesce(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for c, n in cases), F.lit(otherwise))
