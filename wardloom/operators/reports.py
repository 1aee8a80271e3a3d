"""Scores of generated reports: overlaps of each pair with its reference, corpus scores, and their spread by patient.

A pair is one row; a generator has filled in its text already. Only the two numbers that expressions cannot give, the
longest common subsequence and the clipped runs of words, are computed in Python, over Arrow batches. What a corpus score
needs are sums of whole numbers and of pair scores, so draws are made over one row of sums for each patient.
"""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import text as X
from . import evaluation as E
from .guards import require_known

#: The longest runs of words that are compared.
ORDERS = 4
MATCHES = [f"match_{n}" for n in range(1, ORDERS + 1)]
PANEL = ["rouge_l", *(f"bleu_{n}" for n in range(1, ORDERS + 1))]


def tokens(c: Column) -> Column:
    """The runs of letters and digits of a text in lower case; a null has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def longest_common(a: list[str], b: list[str]) -> int:
    """The length of the longest common subsequence. The row of the table of prefixes is held as one whole number, a bit
    for each word of ``a``, which is 0 where the row grows; a word of ``b`` makes the next row by one addition."""
    places: dict[str, int] = {}
    for i, word in enumerate(a):
        places[word] = places.get(word, 0) | 1 << i
    whole = row = (1 << len(a)) - 1
    for word in b:
        if word in places:
            met = row & places[word]
            row = (row + met | row - met) & whole
    return len(a) - row.bit_count()


def common_runs(a: list[str], b: list[str], n: int) -> int:
    """How many runs of n words the texts share, each as often as in the text that has it less often."""
    runs = [Counter(zip(*(words[i:] for i in range(n)), strict=False)) for words in (a, b)]
    return (runs[0] & runs[1]).total()


def pair_scores(pairs: DataFrame, reference: str, hypothesis: str) -> DataFrame:
    """Adds to each pair ``n_reference`` and ``n_hypothesis`` (words), ``common`` (the longest common subsequence),
    ``match_1`` to ``match_4`` (clipped runs of words) and ``rouge_l``, which is 2 common / (both sizes), 0 without words.

    A null or empty text has no words. Rows are returned one for one, repeated ones too; no shuffle. Time grows with the
    product of the two lengths over the bits of a machine word; memory with their sum.
    """

    @F.pandas_udf("common long, " + ", ".join(f"{m} long" for m in MATCHES))
    def overlaps(references: pd.Series, hypotheses: pd.Series) -> pd.DataFrame:
        out = [(longest_common(a, b), *(common_runs(a, b, n) for n in range(1, ORDERS + 1))) for a, b in ((list(a), list(b)) for a, b in zip(references, hypotheses, strict=True))]
        return pd.DataFrame(out, columns=["common", *MATCHES])

    kept = [F.col(f"`{c}`") for c in pairs.columns]
    words = pairs.select(*kept, tokens(F.col(f"`{reference}`")).alias("__r"), tokens(F.col(f"`{hypothesis}`")).alias("__h"))
    found = words.select(*kept, F.size("__r").cast("long").alias("n_reference"), F.size("__h").cast("long").alias("n_hypothesis"), overlaps("__r", "__h").alias("__o"))
    counts = found.select(*kept, "n_reference", "n_hypothesis", "__o.*")
    both = F.col("n_reference") + F.col("n_hypothesis")
    return counts.withColumn("rouge_l", F.coalesce(2.0 * F.col("common") / F.nullif(both, F.lit(0)), F.lit(0.0)))


def sums(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Of each group of scored pairs, what corpus scores are made of; sums of such sums are those of the union."""
    runs = [F.sum(F.greatest(F.col("n_hypothesis") - (n - 1), F.lit(0))).alias(f"runs_{n}") for n in range(1, ORDERS + 1)]
    return scored.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("rouge_l").alias("rouge_l"), F.sum("n_reference").alias("n_reference"), F.sum("n_hypothesis").alias("n_hypothesis"), *(F.sum(m).alias(m) for m in MATCHES), *runs)


def panel(added: DataFrame, keys: list[str]) -> DataFrame:
    """Of rows of sums: n, the mean of rouge_l, and bleu_1 to bleu_4. bleu_k is the geometric mean of the shares of runs
    of 1 to k words that match, times exp(1 - reference / hypothesis) where hypotheses are the shorter; 0 if one share is."""
    share = [F.coalesce(F.col(f"match_{n}") / F.nullif(F.col(f"runs_{n}"), F.lit(0)), F.lit(0.0)) for n in range(1, ORDERS + 1)]
    brevity = F.exp(F.least(F.lit(0.0), 1 - F.col("n_reference") / F.nullif(F.col("n_hypothesis"), F.lit(0))))

    def bleu(k: int) -> Column:
        logs = sum((F.ln(s) for s in share[:k]), F.lit(0.0))
        return F.coalesce(F.when(F.least(*share[:k], F.lit(1.0)) > 0, brevity * F.exp(logs / k)), F.lit(0.0)).alias(f"bleu_{k}")

    return added.select(*keys, "n", (F.col("rouge_l") / F.col("n")).alias("rouge_l"), *(bleu(k) for k in range(1, ORDERS + 1)))


def report_scores(pairs: DataFrame, reference: str, hypothesis: str, group: str, draws: int = 0, seed: int = 0, section: str = "findings", clean: bool = True) -> DataFrame:
    """A row for all pairs (bootstrap -1) and one for each draw of groups with replacement: label, fold, seed, bootstrap,
    n, rouge_l, bleu_1 to bleu_4, as ``evaluation.summary`` takes them.

    ``section`` of the reference is what is scored (``report_section``); ``clean`` takes grounding marks out of the
    hypothesis. Pairs with nothing on either side take no part, and neither do groups of such pairs only; without any
    pair there is no row. A null group stops the query; to draw pairs, give their key. The places of groups are counted
    before the query; texts are scored once, for the point row and all draws.
    """
    if own := {"__group", "__reference", "__hypothesis"} & set(pairs.columns):
        raise ValueError(f"{', '.join(sorted(own))}: a name of this operator")
    said = F.col(f"`{hypothesis}`")
    # An alias that is also a column's name would be taken for it inside the expressions of the section.
    texts = require_known(pairs, group).select(F.col(f"`{group}`").alias("__group"), S.report_section(F.col(f"`{reference}`"), section).alias("__reference"), (X.clean_generated(said) if clean else said).alias("__hypothesis"))
    usable = texts.where(X.usable_pair(F.col("__reference"), F.col("__hypothesis")))
    by_group = sums(pair_scores(usable, "__reference", "__hypothesis"), ["__group"])
    drawn = E.bootstrap(by_group, "__group", draws, seed, point=True)
    added = drawn.groupBy("bootstrap").agg(*(F.sum(c).alias(c) for c in by_group.columns if c != "__group"))
    return panel(added, ["bootstrap"]).select(F.lit("report").alias("label"), F.lit(-1).alias("fold"), F.lit(-1).alias("seed"), "bootstrap", "n", *PANEL)
