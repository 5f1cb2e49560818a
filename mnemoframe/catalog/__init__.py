"""Every registered query; importing a module registers its queries."""

from . import changes, evaluation, intake, retrieval, selection, sources, streaming, windows  # noqa: F401
from .registry import CHECKS, QUERIES, wide_checks

# integer columns whose check would come as 32 or 128 bit
_STAGES = ("formed", "selected", "rendered", "behavior_changed", "score_improved")
wide_checks({
    "j12_snippet_alignment": ("matches",),
    "a02_owner_counters": ("pending_jobs", "pending_ops"),
    "a05_mode_summary": ("correct", "invalid_answers", "errors"),
    "a09_conditioned_difference": ("n",),
    "a10_funnel_summary": ("answer_correct", "n_source_available", "n_indexed", "n_selected", "n_delivered",
                           "n_learned_basis_selected", "n_learned_basis_delivered"),
    "a11_ablation_summary": ("formed", "no_change", "malformed", "stable_state", "stable_text"),
    "a12_pairwise_tally": ("left_wins", "right_wins", "tie", "inconsistent"),
    "a17_harness_matrix": ("answered", "errors", "exact"),
    "c12_effect_report": ("n",),
    "c13_seed_report": ("rendered", "score_changed"),
    "c14_anchor_accuracy": ("positive_flips", "negative_flips"),
    "c14_anchor_dimensions": _STAGES,
    "c15_generalization_report": ("false_positives", "with_recollection"),
    "c15_companion_report": ("manipulable", "learned", "rag"),
    "j14_formation_basis": ("change_no",),
    "j14_adaptation_basis": ("change_no",),
    "c07_parse_outputs": ("change_no",),
    "c07_offered_audit": ("change_no",),
    "c08_validate_changes": ("change_no",),
    "c08_validate_feedback": ("change_no",),
    "u01_index_documents": ("kind_order",),
    "t15_keyset_page": ("kind_order",),
    "j03_visible_owners": ("owner_order",),
})
