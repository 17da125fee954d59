"""A deductive query engine on Spark: facts, rules with recursion, constrained variables, and their analysis."""

from .engine import Engine, apply_rules, apply_targeted_rules, connect, current, query, retract_facts, store_facts
from .facts import Fact, FactConjunction
from .plans.analyze import analyze_query_patterns
from .plans.rewrite import fact_filters, optimize_query, prefix_q
from .plans.timing import get_optimizer_timing_stats, record_fact_timing, reset_optimizer_cache, time_fact_execution
from .plans.to_sql import ConversionResult, QueryPattern, convert_to_sql
from .rules import Rule, get_rules, rule, rule_context
from .sources.entities import Bridge, Entity
from .terms import Q, Var, extract_variable_references, has_variable_references, substitute_variables_in_q

__all__ = [
    "Bridge", "ConversionResult", "Engine", "Entity", "Fact", "FactConjunction", "Q", "QueryPattern", "Rule", "Var",
    "analyze_query_patterns", "apply_rules", "apply_targeted_rules", "connect", "convert_to_sql", "current",
    "extract_variable_references", "fact_filters", "get_optimizer_timing_stats", "get_rules", "has_variable_references",
    "optimize_query", "prefix_q", "query", "record_fact_timing", "reset_optimizer_cache", "retract_facts", "rule",
    "rule_context", "store_facts", "substitute_variables_in_q", "time_fact_execution",
]
