"""All queries."""

from checks import dependencies, documents, findings, patching, remediation, retrieval, storage  # noqa: F401
from checks.registry import ORACLES, QUERIES  # noqa: F401
