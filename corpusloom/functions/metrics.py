"""Answer metrics: exact match, multiset F1, ROUGE-L."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from corpusloom.functions.text import char_units, eval_form, token_units


def exact_match(pred: Column, ref: Column) -> Column:
    """1 where both evaluation forms are equal and not empty."""
    a, b = eval_form(pred), eval_form(ref)
    return F.when((a != "") & (a == b), 1.0).otherwise(0.0)


@F.pandas_udf(DoubleType())
def _f1(left: pd.Series, right: pd.Series) -> pd.Series:
    out = []
    for a, b in zip(left, right, strict=True):
        common = sum((Counter(a) & Counter(b)).values()) if a is not None and b is not None else 0
        out.append(2 * common / (len(a) + len(b)) if common else 0.0)
    return pd.Series(out, dtype="float64")


def multiset_f1(a: Column, b: Column) -> Column:
    """F1 of two lists as multisets; 0 where either is empty or nothing is common.

    Counting in Arrow batches: as nested lambdas the second list would be counted again for each unit of the first.
    """
    return _f1(a, b)


def token_f1(pred: Column, ref: Column) -> Column:
    return multiset_f1(token_units(pred), token_units(ref))


def char_f1(pred: Column, ref: Column) -> Column:
    return multiset_f1(char_units(pred), char_units(ref))


def lcs_length(a: np.ndarray, b: np.ndarray) -> int:
    """Longest common subsequence, a row at a time: the best before a match, then a running maximum."""
    best = np.zeros(len(b) + 1, dtype=np.int64)
    for x in a:
        best[1:] = np.maximum(best[1:], np.where(b == x, best[:-1] + 1, 0))
        best = np.maximum.accumulate(best)
    return int(best[-1])


@F.pandas_udf(DoubleType())
def _rouge(preds: pd.Series, refs: pd.Series) -> pd.Series:
    out = []
    for p, r in zip(preds, refs, strict=True):
        value = 0.0
        if p is not None and r is not None and len(p) and len(r):
            codes = {w: i for i, w in enumerate({*p, *r})}
            n = lcs_length(np.array([codes[w] for w in p]), np.array([codes[w] for w in r]))
            value = 2 * n / (len(p) + len(r)) if n else 0.0
        out.append(value)
    return pd.Series(out, dtype="float64")


def rouge_l(pred: Column, ref: Column) -> Column:
    """F of the longest common subsequence of words."""
    return _rouge(token_units(pred), token_units(ref))


def case_metrics(pred: Column, ref: Column) -> list[Column]:
    return [exact_match(pred, ref).alias("exact_match"), F.round(token_f1(pred, ref), 4).alias("token_f1"), F.round(char_f1(pred, ref), 4).alias("char_f1"), F.round(rouge_l(pred, ref), 4).alias("rouge_l")]
