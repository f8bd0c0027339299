"""Schemas of the canonical tables. Enumerated columns are checked where tables are written, see operators.maintenance."""

from __future__ import annotations

from pyspark.sql import types as T

_KINDS = {"L": T.LongType(), "S": T.StringType(), "D": T.DoubleType(), "T": T.TimestampType(), "A": T.ArrayType(T.StringType())}


def _schema(spec: str) -> T.StructType:
    """Names with kinds: L long, S string, D double, T timestamp, A array of strings; ? marks columns that may be null."""
    fields = []
    for item in spec.split():
        name, kind = item.split(":")
        fields.append(T.StructField(name, _KINDS[kind.rstrip("?")], kind.endswith("?")))
    return T.StructType(fields)


PROJECTS = _schema("id:L root_path:S lifecycle_phase:S test_report_path:S? no_define_count:L branch:S? created_at_commit:S? created_at:T notification_level:S")
DETERMINATIONS = _schema("id:L project_id:L seq:L file_path:S define_name:S? node_fingerprint:S? fine_fingerprint:S? content_hash:S return_type:S? git_commit:S? edit_type:S file_mtime:D? start_line:L? end_line:L? created_at:T?")
CALL_EDGES = _schema("project_id:L caller:S callee:S edge_kind:S source_file:S?")
REEXPORT_EDGES = _schema("project_id:L barrel_module:S exported_name:S target_module:S target_name:S")
GD_EDGES = _schema("project_id:L from_det:L to_det:L edge_class:S")
EQUIVALENCE = _schema("project_id:L class_key:S member_node:S")
TEST_RUNS = _schema("id:L project_id:L seq:L? source_path:S source_mtime:S passed:L failed:L skipped:L source:S")
TEST_CASES = _schema("test_run_id:L classname:S name:S file_path:S? status:S")
COVERAGE_MAP = _schema("project_id:L test_case:S define_name:S")
TASK_SCOPES = _schema("project_id:L task_id:S allowed_glob:A forbidden_glob:A severity:S state:S created_at:T")
INCIDENTS = _schema("id:L project_id:L signal:S target_node:S? state:S agent_notified_at:T? post_notify_count:L escalated_at:T? resolved_by:S? details:S created_at:T updated_at:T")
DELIVERIES = _schema("id:L project_id:L incident_id:L? channel:S kind:S message:S created_at:T taken_at:T?")
SAFETY_NET = _schema("project_id:L net_type:S triggered_at:T dismissed_at:T?")
ASSIST_STATE = _schema("project_id:L last_commit_seq:L last_commit_suggest_defines:S last_run_tests_suggest_defines:S xml_missing_warned:L")
DANGLING = _schema("project_id:L file_path:S caller_define:S callee_text:S det_id:L created_at:T")
SESSIONS = _schema("session_id:S project_id:L start_seq:L end_seq:L? started_at:T ended_at:T?")
CRASH_STACKS = _schema("id:L project_id:L seq:L? stack_fqns:A command:S? error_signature:S? created_at:T")
COST_SAMPLES = _schema("project_id:L? session_id:S model:S cost_usd:D input_tokens:L output_tokens:L cache_read_tokens:L cache_creation_tokens:L sample_at:T")
SNAPSHOTS = _schema("id:L project_id:L commit_hash:S branch:S? snapshot_at_seq:L parent_commit:S? reason:S taken_at:T")
DIR_MTIMES = _schema("project_id:L dir_path:S mtime:D")
PENDING_RECOMPUTE = _schema("project_id:L file_path:S enqueued_at:T status:S")

#: Values that enumerated columns may hold.
ENUMS = {
    "edit_type": ("create", "modify", "delete"),
    "edge_kind": ("call", "import"),
    "status": ("passed", "failed", "skipped", "error"),
    "state": ("open", "notified_agent", "escalated_user", "resolved"),
    "channel": ("agent", "user"),
    "kind": ("alert", "suggestion"),
    "reason": ("commit", "rollback", "branch_switch", "session_start", "initial"),
    "notification_level": ("high", "medium", "low", "silent"),
}
