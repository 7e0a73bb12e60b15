"""Stage policies: which stages a pass of candidates goes through, which branches are open, and how conflicts end."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.operators.routing import accept
from spanloom.operators.spans import collapse_exact, fuse

PURPOSES, CONFLICTS = ("release", "evaluation_ablation"), ("deterministic", "exact_duplicates_only")
FIELDS = ("start", "end", "label", "score", "source", "sources", "agreement", "decision")


@dataclass(frozen=True)
class StagePolicy:
    """Switches of one pass. ``rule_labels`` and ``model_labels``, where given, open a branch for just these labels, whatever the routes say.

    A policy for release may not switch off validators or thresholds, leave conflicts unresolved or override a branch.
    """

    name: str = "release-default"
    purpose: str = "release"
    context: bool = True
    context_required: bool = False
    validators: bool = True
    thresholds: bool = True
    conflicts: str = "deterministic"
    rule_labels: tuple[str, ...] | None = None
    model_labels: tuple[str, ...] | None = None

    def __post_init__(self) -> None:
        if not self.name.strip():
            raise ValueError("a policy needs a name")
        if self.purpose not in PURPOSES or self.conflicts not in CONFLICTS:
            raise ValueError("unknown purpose or conflict policy")
        if self.context_required and not self.context:
            raise ValueError("context_required needs context")
        for own in (self.rule_labels, self.model_labels):
            if own is not None and len(set(own)) < len(own):
                raise ValueError("a branch names a label twice")
        weak = not self.validators or not self.thresholds or self.conflicts != "deterministic" or self.rule_labels is not None or self.model_labels is not None
        if self.purpose == "release" and weak:
            raise ValueError("a release policy may not weaken stages or routes")


def opened(table: DataFrame, policy: StagePolicy) -> DataFrame:
    """The routes with the branches that the policy opens and shuts; an override of a label without a route fails."""
    known = {r["label"] for r in table.select("label").collect()}  # one row per label
    out = table
    for own, column in ((policy.rule_labels, "rule_on"), (policy.model_labels, "model_on")):
        if own is not None:
            if not set(own) <= known:
                raise ValueError(f"no route for {sorted(set(own) - known)}")
            out = out.withColumn(column, F.col("label").isin(*own) if own else F.lit(False))
    return out


def run_policy(
    candidates: DataFrame, table: DataFrame, policy: StagePolicy, labels: Sequence[str] | None = None, sources: tuple[str, str] = ("rule:cn_common", "qwen"), key: str = "doc_id"
) -> DataFrame:
    """(key, start, end, label, score, source, sources, agreement, decision) of what a pass under the policy emits.

    candidates: those of ``accept``, with the context phrases in their text. Spans that a validator passed count as
    validated in conflicts; under ``exact_duplicates_only`` overlapping labels all stay, and equal spans of both branches
    are one with both sources.
    """
    kept = accept(candidates, opened(table, policy), labels, policy.context, policy.validators, policy.thresholds)
    valid = F.when(F.col("validator").isNotNull(), True) if policy.validators else F.lit(None).cast("boolean")
    source = F.when(F.col("branch") == "rule", F.lit(sources[0])).otherwise(F.lit(sources[1]))
    spans = kept.select(key, "start", "end", "label", "score", source.alias("source"), valid.alias("valid"))
    if policy.conflicts == "deterministic":
        return fuse(spans, key).select(key, *FIELDS)
    return collapse_exact(spans, key).select(key, *FIELDS)
