"""Closed vocabularies of the traceability graph."""

from __future__ import annotations

# The vocabularies of the marker protocol.
NODE_TYPES = ("goal", "prd", "requirement", "nfr", "decision", "work", "plan", "implementation", "config", "operation", "data", "prompt", "test", "document", "runbook", "evidence", "commit", "pull_request", "ci_run", "external")
SEMANTIC = ("work", "derived_from", "addresses", "satisfies", "implements", "verifies", "exercises", "documents", "deploys", "depends_on", "supersedes", "produces", "consumes", "blocks")
STRUCTURAL = ("contains", "calls", "imports", "inherits", "references_symbol", "reads", "writes", "changed_by", "owned_by")
OBSERVED = ("executed", "passed", "failed", "built_in", "deployed_in", "attested_by")
STALE, REVIEWED, CURRENT = "stale_review_required", "reviewed_needs_verification", "current"
HISTORICAL = "historical_not_current"
