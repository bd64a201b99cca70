from tacit.operators.evaluation import (
    case_ranks,
    evaluate,
    negative_candidates,
    negative_lists,
    prediction_error,
    rank_candidates,
    rank_drawn,
    rank_gains,
    rank_lists,
    ranking_metrics,
    score_pairs,
)
from tacit.operators.factors import (
    complete_confidence,
    complete_factors,
    gram,
    init_factors,
    weighted_items,
)
from tacit.operators.filters import kcore, peel, threshold_filter, top_ids, top_n_filter
from tacit.operators.history import entity_history
from tacit.operators.indexing import apply_index, dense_index
from tacit.operators.splits import leave_one_out, random_split, sample_users
from tacit.operators.weights import item_confidence, item_popularity

__all__ = [
    "apply_index",
    "case_ranks",
    "complete_confidence",
    "complete_factors",
    "dense_index",
    "entity_history",
    "evaluate",
    "gram",
    "init_factors",
    "item_confidence",
    "item_popularity",
    "kcore",
    "leave_one_out",
    "negative_candidates",
    "negative_lists",
    "peel",
    "prediction_error",
    "random_split",
    "rank_candidates",
    "rank_drawn",
    "rank_gains",
    "rank_lists",
    "ranking_metrics",
    "sample_users",
    "score_pairs",
    "threshold_filter",
    "top_ids",
    "top_n_filter",
    "weighted_items",
]
