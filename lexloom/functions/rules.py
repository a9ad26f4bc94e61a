"""First-match-wins keyword classification as narrow column expressions."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import fixed_values as fv
from .text import normalize_filename


def first_label(lowered: Column, rules, default: str) -> Column:
    """Label of the first rule, in order, with a keyword inside `lowered`.

    A lazily evaluated CASE: no shuffle, no join, and it stops at the first hit.
    """
    case = None
    for label, keywords in rules:
        hit = None
        for word in keywords:
            test = F.contains(lowered, F.lit(word))
            hit = test if hit is None else hit | test
        case = F.when(hit, label) if case is None else case.when(hit, label)
    return F.lit(default) if case is None else case.otherwise(F.lit(default))


def department(lowered: Column) -> Column:
    return first_label(lowered, fv.DEPARTMENT_RULES, fv.DEFAULT_DEPARTMENT)


def content_category(lowered: Column) -> Column:
    return first_label(lowered, fv.CONTENT_CATEGORY_RULES, fv.DEFAULT_CATEGORY)


def filename_category(filename: Column) -> Column:
    return first_label(normalize_filename(filename), fv.FILENAME_CATEGORY_RULES,
                       fv.DEFAULT_CATEGORY)


def rule_rows(ruleset: str, rules):
    """Rows (ruleset, priority, label, keyword) in matching order."""
    pairs = [(label, word) for label, words in rules for word in words]
    return [(ruleset, i, label, word) for i, (label, word) in enumerate(pairs, 1)]


RULE_SCHEMA = "ruleset string, priority int, label string, keyword string"
