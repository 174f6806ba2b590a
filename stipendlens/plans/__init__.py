"""Physical-plan helpers: size-checked broadcast, skew-safe ranking,
lineage cuts and session settings. No planner of our own: these only pick
between plans that Catalyst and AQE already know how to run."""

from stipendlens.plans.joins import bounded_broadcast, distinct_keys, present_keys
from stipendlens.plans.lineage import cut_lineage, ensure_checkpoint_dir
from stipendlens.plans.ranking import dense_ids, rank_within

__all__ = ["bounded_broadcast", "distinct_keys", "present_keys", "cut_lineage", "ensure_checkpoint_dir",
           "dense_ids", "rank_within"]
