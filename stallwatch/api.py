"""The names most programs need, in one place."""

from stallwatch.functions.hashing import Salts, hash_columns, hash_listings, hash_merged, hmac_hex
from stallwatch.operators.clusters import ClusterFeatures
from stallwatch.operators.detectors import detect_changes
from stallwatch.operators.drift import drift_report, jensen_shannon, ks, psi, rolling_drift
from stallwatch.operators.explain import explanation_report, linear_contributions, tree_contributions
from stallwatch.operators.graph import build_graph, components, listing_graph, neighbour_means, rings, sharing_edges
from stallwatch.operators.joins import asof_join, propagate_flag, propagate_label, resolve_overlap
from stallwatch.operators.labels import LabelMode, Split, SplitColumns, assign_folds, expanding_folds, sliding_folds, temporal_split
from stallwatch.operators.metrics import best_threshold, confusion, ranking_metrics, threshold_table
from stallwatch.operators.models import Search, ablation, fit_variant, score_rows, train_variants
from stallwatch.operators.rules import class_rules, frequent_itemsets, rule_features
from stallwatch.operators.windows import identity_history
from stallwatch.plans.etl import merge_feeds, run
from stallwatch.registry import Registry, Role, Variant, project_variant
from stallwatch.session import local_session, tune
from stallwatch.sources.feeds import Feeds, LifecycleFeed, SignalFeed, read_feeds
from stallwatch.streaming.ingest import start_ingest
from stallwatch.streaming.links import LiveLinks
from stallwatch.streaming.routing import Router

__all__ = [name for name in dir() if not name.startswith("_")]
