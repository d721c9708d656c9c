"""The tables of a gallery: columns, keys and allowed values. Nothing is inferred from data."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


@dataclass(frozen=True)
class Table:
    columns: str
    keys: tuple[tuple[str, ...], ...]
    allowed: dict[str, tuple[str, ...]] = field(default_factory=dict)
    #: Keys that hold among the rows of a condition only.
    partial: tuple[tuple[str, tuple[str, ...]], ...] = ()

    @property
    def schema(self) -> StructType:
        return StructType.fromDDL(self.columns)


TABLES: dict[str, Table] = {
    "sources": Table("id long, path string, label string, active boolean, created_at timestamp", (("id",), ("path",))),
    "assets": Table(
        "id long, source_id long, absolute_path string, file_name string, file_extension string, file_fingerprint string, capture_month string, live_photo_mov_path string, processing_status string, failure_reason string, created_at timestamp, updated_at timestamp",
        (("id",), ("absolute_path",)),
        {"processing_status": ("pending", "succeeded", "failed")},
    ),
    "scan_sessions": Table("id long, plan_fingerprint string, batch_size int, status string, total_batches int, completed_batches int, failed_assets long, face_count long, started_at timestamp, completed_at timestamp", (("id",), ("plan_fingerprint",)), {"status": ("pending", "running", "completed", "failed")}),
    "scan_batches": Table("id long, session_id long, batch_index int, status string, item_count int, started_at timestamp, completed_at timestamp", (("id",), ("session_id", "batch_index")), {"status": ("pending", "running", "completed", "failed")}),
    "scan_batch_items": Table("id long, batch_id long, item_index int, source_id long, absolute_path string, status string, face_count int, failure_reason string", (("id",), ("batch_id", "item_index"), ("batch_id", "absolute_path")), {"status": ("pending", "succeeded", "failed")}),
    "faces": Table("id long, asset_id long, face_index int, x1 double, y1 double, x2 double, y2 double, image_width int, image_height int, score double, crop_path string, context_path string", (("id",), ("asset_id", "face_index"))),
    "embeddings": Table("face_id long, variant string, dimension int, l2_norm double, vector array<float>", (("face_id", "variant"),), {"variant": ("main",)}),
    "persons": Table("id string, display_name string, is_named boolean, status string, write_revision long, created_at timestamp", (("id",),), {"status": ("active", "inactive")}, (("status = 'active' AND is_named", ("display_name",)),)),
    "person_name_events": Table("id long, person_id string, event_type string, old_name string, new_name string, created_at timestamp", (("id",),), {"event_type": ("person_named", "person_renamed")}),
    "assignment_runs": Table("id long, session_id long, status string, params string, candidates long, assigned long, new_persons long, deferred long, skipped long, orphan_embeddings long, failure_reason string, started_at timestamp, completed_at timestamp", (("id",),), {"status": ("running", "completed", "failed")}),
    "assignments": Table("id long, face_id long, person_id string, run_id long, source string, active boolean, evidence string, created_at timestamp", (("id",),), {}, (("active", ("face_id",)),)),
    "exclusions": Table("id long, face_id long, person_id string, created_at timestamp", (("id",), ("face_id", "person_id"))),
    "merge_operations": Table("id long, winner_id string, loser_id string, winner_revision long, loser_revision long, winner_name string, loser_name string, winner_named boolean, loser_named boolean, merged_at timestamp, undone_at timestamp", (("id",),)),
    "merge_members": Table("operation_id long, assignment_id long, role string", (("operation_id", "assignment_id"),), {"role": ("winner", "loser")}),
    "templates": Table("id string, name string, output_root string, status string, dedup_key string, created_at timestamp", (("id",), ("dedup_key",)), {"status": ("active", "invalid")}),
    "template_persons": Table("template_id string, person_id string", (("template_id", "person_id"),)),
    "export_runs": Table("id long, template_id string, status string, copied long, skipped long, started_at timestamp, completed_at timestamp", (("id",),), {"status": ("running", "completed", "failed")}, (("status = 'running'", ("status",)),)),
    "export_plan": Table("id long, template_id string, asset_id long, bucket string, month string, file_name string, mov_file_name string, source_label string, created_at timestamp", (("id",), ("template_id", "asset_id")), {"bucket": ("only", "group")}),
    "export_deliveries": Table("id long, run_id long, plan_id long, target_path string, result string, mov_result string, delivered_at timestamp", (("id",),), {"result": ("copied", "skipped_exists", "failed"), "mov_result": ("copied", "not_applicable", "failed")}),
    "schema_meta": Table("key string, value string", (("key",),)),
}


def violations(df: DataFrame, table: Table) -> DataFrame:
    """(rule, detail, rows): broken value rules and keys of a table; empty where all hold."""
    found = [df.filter(F.col(c).isNotNull() & ~F.col(c).isin(*values)).groupBy(F.lit(f"allowed {c}").alias("rule"), F.col(c).cast("string").alias("detail")).agg(F.count("*").alias("rows")) for c, values in table.allowed.items()]
    for rule, key in [("", k) for k in table.keys] + list(table.partial):
        rows = df.filter(rule) if rule else df
        text = F.concat_ws(",", *(F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in key))
        found.append(rows.groupBy(F.lit(f"key {','.join(key)}").alias("rule"), text.alias("detail")).agg(F.count("*").alias("rows")).filter("rows > 1"))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def missing_columns(df: DataFrame, table: Table) -> list[str]:
    return [c for c in table.schema.fieldNames() if c not in df.columns]
