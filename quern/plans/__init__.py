from quern.plans.algebra import Call, Collect, Exclude, Field, Filter, Literal, Passthrough, PlanError, Project, Scan, Scope, Unwind
from quern.plans.query import Query, parse

__all__ = ["Call", "Collect", "Exclude", "Field", "Filter", "Literal", "Passthrough", "PlanError", "Project", "Query", "Scan", "Scope", "Unwind", "parse"]
