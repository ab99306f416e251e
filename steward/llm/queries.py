"""The registered queries of this subpackage."""

from steward.llm import (  # noqa: F401  (register queries)
    audit_queries, dedup_queries, manifest_queries, mixing_queries, page_queries, quality_queries, secret_queries, token_queries,
)
from steward.llm.common import ORACLES, QUERIES  # noqa: F401
