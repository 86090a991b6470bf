"""All queries over the reference tables, in the order in which they are registered."""

from . import bindings, business_qa, catalogue, commercial, discovery, evidence, extract, facts, images, named, nested, reports, rules, site, stages, texts, visits  # noqa: F401  they register their queries
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
