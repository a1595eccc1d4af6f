"""Corpus auditing on Spark DataFrames."""

from scanloom.functions.grades import advisory_severity, parse_confidence, parse_severity, severity_ord
from scanloom.functions.text import call_site, display_snippet, is_binary, quoted_strings, shannon_entropy
from scanloom.functions.versions import purl, version_key
from scanloom.operators.advisories import (
    advisory_findings, match_advisories, merge_cache, split_by_freshness,
)
from scanloom.operators.classify import drop_minified, route_family, with_kind
from scanloom.operators.directives import apply_directives, directives_for, parse_directives
from scanloom.operators.documents import (
    cyclonedx_records, place_packages, sarif_records, spdx_records, to_cyclonedx, to_sarif, to_spdx, write_document, write_documents,
)
from scanloom.operators.fixes import apply_fixes, fix_counts, plan_fixes
from scanloom.operators.packages import extract_packages, inventory, with_format
from scanloom.operators.pipeline import (
    apply_enabled, at_least, drop_default_noise, fingerprints, gate, gate_threshold, ignore_findings, new_since,
    override_severity, suppress,
)
from scanloom.operators.projects import (
    assign_projects, exempt_projects, exempt_roots, fingerprint, fingerprint_summary, gate_by_framework,
)
from scanloom.operators.reports import (
    category_counts, code_counts, coverage, project_label, project_label_rows, rule_rollup, severity_counts, to_annotations, top_findings,
    with_shares,
)
from scanloom.operators.scan import applicable, scan, scan_compound, scan_secrets, with_location
from scanloom.operators.scopes import scan_scoped
from scanloom.plans.audit import AuditConfig, AuditResult, Detector, audit, materialise, run_all
from scanloom.plans.inventory import packages_of, sbom
from scanloom.rules import Rule, RuleError, load_rules
from scanloom.rules.catalogue import builtin_rules, secret_rules
from scanloom.sources.blobs import blob_stats, scan_blobs
from scanloom.sources.corpus import Crawl, changed_only, crawl, ignore_paths, read_corpus, to_corpus, walk_filter
from scanloom.sources.ignores import honour_ignore_files, ignored_paths
from scanloom.sources.history import history_stats, scan_history
from scanloom.sources.sinks import (
    compact_baseline, merge_baseline, read_baseline, report_lines, write_baseline, write_corpus, write_findings,
)
from scanloom.streaming.live import FindingLog, scan_stream

__version__ = "0.1.0"
