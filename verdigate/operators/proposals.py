"""Validation of agent proposal payloads against the contexts that were asked."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigate.functions.columns import is_true
from verdigate.operators.datasets import PROMPT_FIELDS
from verdigate.operators.structure import TASK_ACTIONS, first_reason

RECORD_SCHEMA = (
    "context_id STRING, task_id STRING, action STRING, confidence STRING, uncertainty STRING, "
    "expected_edge_bps STRING, review_recommended BOOLEAN, rationale STRING, "
    "evidence_fields STRING, risk_flags STRING"
)
PAYLOAD_SCHEMA = f"proposals ARRAY<STRUCT<{RECORD_SCHEMA.replace(' STRING', ': STRING').replace(' BOOLEAN', ': BOOLEAN')}>>"

# Actions and their direction.
ACTION_MAP = {"long": 1, "short": -1, "increase_limit": 1, "abstain": 0}


def _readable(payload: str) -> Column:
    return F.get_json_object(F.col(payload), "$").isNotNull()


def proposal_records(
    payloads: DataFrame, batch: str, payload: str, sequence: str | None = None
) -> DataFrame:
    """Records of each payload in their given order; malformed JSON has none.

    A batch may arrive in several payloads; `sequence` then orders them.
    """
    part = F.lit(0) if sequence is None else F.col(sequence)
    parsed = F.from_json(F.col(payload), PAYLOAD_SCHEMA)
    records = payloads.select(
        batch, part.alias("_part"), _readable(payload).alias("readable"),
        F.posexplode_outer(parsed["proposals"]).alias("_pos", "r"),
    )
    place = F.when(F.col("_pos").isNotNull(), F.struct("_part", "_pos"))
    return records.select(batch, "readable", place.alias("pos"), "r.*")


def validate_proposals(
    payloads: DataFrame, contexts: DataFrame, batch: str = "batch_id", payload: str = "payload",
    max_rationale: int = 500, fields: Sequence[str] = PROMPT_FIELDS, sequence: str | None = None,
) -> DataFrame:
    """One row per expected context: the first matching record if it is valid,
    otherwise an abstaining placeholder with the reason.

    The first record per context is a `min_by` on its position, which combines
    map-side when one context is answered very often.
    """
    records = proposal_records(payloads, batch, payload, sequence)
    numbered = records.filter(F.col("context_id").isNotNull())
    whole = F.struct(*[c for c in numbered.columns if c not in (batch, "context_id")])
    first = numbered.groupBy(batch, "context_id").agg(
        F.min_by(whole, "pos").alias("r"), (F.count("*") - 1).alias("duplicates")
    )
    # From the payloads: over the records each payload would be parsed twice.
    readable = payloads.groupBy(batch).agg(F.bool_or(_readable(payload)).alias("readable"))
    asked = contexts.select(batch, "context_id", F.col("task_id").alias("expected_task"))
    j = asked.join(first, [batch, "context_id"], "left").join(readable, batch, "left")
    r = F.col("r")
    confidence, uncertainty, edge = (
        r[c].try_cast("double") for c in ("confidence", "uncertainty", "expected_edge_bps")
    )
    evidence = F.from_json(F.coalesce(r["evidence_fields"], F.lit("[]")), "array<string>")
    flags = F.from_json(F.coalesce(r["risk_flags"], F.lit("[]")), "array<string>")
    allowed = F.array(*[F.lit(f) for f in fields])
    good_action = F.lit(False)
    for task, actions in TASK_ACTIONS.items():
        good_action = good_action | ((F.col("expected_task") == task) & r["action"].isin(*actions))
    bounded = (
        confidence.between(0.0, 1.0) & uncertainty.between(0.0, 1.0) & edge.between(-250.0, 250.0)
    )
    tidy = (
        (F.length(F.coalesce(r["rationale"], F.lit(""))) <= max_rationale)
        & evidence.isNotNull() & flags.isNotNull() & r["review_recommended"].isNotNull()
        & (F.size(F.array_except(evidence, allowed)) == 0)
        & (F.size(F.array_distinct(evidence)) == F.size(evidence))
    )
    reason = first_reason(
        [
            ("unparseable_provider_response", ~is_true(F.col("readable"))),
            ("missing_context_placeholder", r.isNull()),
            ("task_mismatch_placeholder", ~is_true(r["task_id"] == F.col("expected_task"))),
            ("action_mismatch_placeholder", ~is_true(good_action)),
            ("invalid_record_placeholder", ~is_true(bounded & tidy)),
        ]
    )
    repeated = is_true(F.col("duplicates") > 0) & reason.isNotNull()
    direction = F.create_map(*[F.lit(x) for kv in ACTION_MAP.items() for x in kv])
    ok = F.col("_reason").isNull()
    marked = j.withColumns({"_reason": reason, "_repeated": repeated})

    def kept(value: Column, placeholder: Column) -> Column:
        return F.when(ok, value).otherwise(placeholder)

    return marked.select(
        batch, "context_id", F.col("expected_task").alias("task_id"),
        kept(r["action"], F.lit("abstain")).alias("action"),
        kept(F.element_at(direction, r["action"]), F.lit(0)).alias("candidate_action"),
        kept(confidence, F.lit(0.0)).alias("confidence"),
        kept(uncertainty, F.lit(1.0)).alias("uncertainty"),
        kept(edge, F.lit(0.0)).alias("expected_edge_bps"),
        kept(r["review_recommended"], F.lit(True)).alias("review_recommended"),
        kept(F.coalesce(r["rationale"], F.lit("")), F.lit("")).alias("rationale"),
        kept(F.to_json(evidence), F.lit("[]")).alias("evidence_fields"),
        kept(F.to_json(flags), F.lit('["malformed_missing_or_invalid_context"]')).alias("risk_flags"),
        ok.alias("raw_schema_valid"), (~ok).alias("malformed_placeholder"),
        F.coalesce(
            F.when(F.col("_repeated"),
                   F.concat(F.lit("duplicate_context_placeholder:"), F.col("_reason"))),
            F.col("_reason"), F.lit(""),
        ).alias("malformed_reason"),
        F.when(F.col("_repeated"), "duplicate_context_placeholder")
        .otherwise(F.coalesce("_reason", F.lit("provider_structured_valid"))).alias("parse_status"),
        F.coalesce("duplicates", F.lit(0)).alias("ignored_duplicates"),
    )


def batch_audit(validated: DataFrame, records: DataFrame, batch: str = "batch_id") -> DataFrame:
    """Counts per batch and whether it is complete and clean."""
    done = validated.groupBy(batch).agg(
        F.count("*").alias("expected_contexts"),
        F.count_if("raw_schema_valid").alias("valid_expected_records"),
        F.sum("ignored_duplicates").alias("ignored_duplicate_records"),
    )
    expected = validated.select(batch, "context_id", F.lit(True).alias("_e"))
    seen = records.filter(F.col("pos").isNotNull()).join(expected, [batch, "context_id"], "left")
    counts = seen.groupBy(batch).agg(
        F.count("*").alias("observed_records"),
        F.count_if(F.col("_e").isNull()).alias("ignored_extra_records"),
    )
    out = done.join(counts, batch, "left").fillna(0, ["observed_records", "ignored_extra_records"])
    complete = F.col("valid_expected_records") == F.col("expected_contexts")
    return out.withColumns(
        {
            "malformed_placeholders": F.col("expected_contexts") - F.col("valid_expected_records"),
            "expected_batch_complete": complete,
            "batch_clean": complete & (F.col("ignored_extra_records") == 0)
            & (F.col("ignored_duplicate_records") == 0),
        }
    )
