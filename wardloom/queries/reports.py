"""Answers of assistants as generated reports, scored against what was asked."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation as E
from ..operators import reports as R
from .base import query, r6, table

#: Draws of conversations.
DRAWS = 20


def pairs(spark, d):
    """What a user said with the answer that follows."""
    c = table(spark, d, "conversations")
    answers = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("asked")).join(answers, ["conv_id", "turn"])


def _runs(words: str, n: int) -> str:
    return f"list_transform(range(1, len({words}) - {n - 2}), lambda i: array_to_string({words}[i : i + {n - 1}], ' '))"


def _clipped(n: int) -> str:
    return f"(SELECT coalesce(sum(least(x.c, y.c)), 0) FROM (SELECT w, count(*) AS c FROM (SELECT unnest({_runs('p.r', n)}) AS w) GROUP BY w) x JOIN (SELECT w, count(*) AS c FROM (SELECT unnest({_runs('p.h', n)}) AS w) GROUP BY w) y USING (w))::BIGINT AS match_{n}"


#: The table of prefixes, a row of it for each word of the answer.
_SCORED = f"""WITH RECURSIVE p AS (SELECT u.conv_id, u.turn, regexp_extract_all(lower(u.text), '[\\p{{L}}\\p{{N}}]+') AS r, regexp_extract_all(lower(a.text), '[\\p{{L}}\\p{{N}}]+') AS h, trim(u.text) <> '' AND trim(a.text) <> '' AS usable
  FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'),
t AS (SELECT conv_id, turn, 0 AS i, list_transform(range(len(r) + 1), lambda x: 0::BIGINT) AS prefix FROM p UNION ALL
  SELECT conv_id, turn, i + 1, [0::BIGINT] || list_transform(range(1, len(best) + 1), lambda k: list_max(best[1:k])) FROM (
    SELECT t.conv_id, t.turn, i, list_transform(range(1, len(p.r) + 1), lambda k: CASE WHEN p.r[k] = p.h[i + 1] THEN prefix[k] + 1 ELSE prefix[k + 1] END) AS best FROM t JOIN p USING (conv_id, turn) WHERE i < len(p.h))),
l AS (SELECT conv_id, turn, prefix[-1] AS common FROM t JOIN p USING (conv_id, turn) WHERE i = len(p.h)),
s AS (SELECT conv_id, turn, usable, len(r)::BIGINT AS n_reference, len(h)::BIGINT AS n_hypothesis, common, {", ".join(_clipped(n) for n in range(1, 5))}, coalesce(2.0 * common / nullif(len(r) + len(h), 0), 0)::DOUBLE AS rouge_l FROM p JOIN l USING (conv_id, turn))"""


@query(f"{_SCORED} SELECT conv_id, turn, n_reference, n_hypothesis, common, match_1, match_2, match_3, match_4, round(rouge_l, 6) AS rouge_l FROM s")
def ev12_pair_scores(spark, d):
    return R.pair_scores(pairs(spark, d), "asked", "answer").drop("asked", "answer").withColumn("rouge_l", r6("rouge_l"))


_SUMS = ", ".join(f"sum({c})::DOUBLE AS {c}" for c in ("rouge_l", "n_reference", "n_hypothesis", "match_1", "match_2", "match_3", "match_4")) + "".join(f", sum(greatest(n_hypothesis - {n - 1}, 0))::DOUBLE AS runs_{n}" for n in range(1, 5))


def _bleu(k: int) -> str:
    logs = " + ".join(f"ln(match_{n} / runs_{n})" for n in range(1, k + 1))
    return f"CASE WHEN {' AND '.join(f'match_{n} > 0' for n in range(1, k + 1))} THEN exp(least(0, 1 - n_reference / n_hypothesis)) * exp(({logs}) / {k}) ELSE 0 END AS bleu_{k}"


_RESULTS = f"""{_SCORED}, u AS (SELECT * FROM s WHERE usable),
g AS (SELECT conv_id, row_number() OVER (ORDER BY md5(conv_id || ':0'), conv_id) AS place, count(*) OVER () AS n_groups FROM (SELECT DISTINCT conv_id FROM u)),
d AS (SELECT b::INT AS bootstrap, ('0x' || substr(md5(b || ':' || i || ':0'), 1, 13))::BIGINT % n_groups + 1 AS place FROM (SELECT unnest(range({DRAWS})) AS b), (SELECT max(n_groups) AS n_groups FROM g), LATERAL (SELECT unnest(range(n_groups)) AS i) UNION ALL SELECT -1, place FROM g),
a AS (SELECT bootstrap, count(*)::BIGINT AS n, {_SUMS} FROM d JOIN g USING (place) JOIN u USING (conv_id) GROUP BY bootstrap),
f AS (SELECT 'report' AS label, -1 AS fold, -1 AS seed, bootstrap, n, rouge_l / n AS rouge_l, {", ".join(_bleu(k) for k in range(1, 5))} FROM a)"""


def results(spark, d):
    return R.report_scores(pairs(spark, d), "asked", "answer", "conv_id", DRAWS, section="full", clean=False)


@query(f"{_RESULTS} SELECT label, fold, seed, bootstrap, n, {', '.join(f'round({c}, 6)::DOUBLE AS {c}' for c in R.PANEL)} FROM f")
def ev12_report_scores(spark, d):
    return results(spark, d).select("label", "fold", "seed", "bootstrap", "n", *(r6(c).alias(c) for c in R.PANEL))


def _summary(m: str) -> str:
    drawn = f"CASE WHEN bootstrap >= 0 THEN {m} END"
    return f"round(max(CASE WHEN bootstrap < 0 THEN {m} END), 6)::DOUBLE AS {m}_mean, round(stddev_pop({drawn}), 6)::DOUBLE AS {m}_std, round(quantile_cont({drawn}, 0.025), 6)::DOUBLE AS {m}_ci_lo, round(quantile_cont({drawn}, 0.975), 6)::DOUBLE AS {m}_ci_hi"


@query(f"{_RESULTS} SELECT label, {', '.join(_summary(m) for m in R.PANEL)} FROM f GROUP BY label")
def ev12_report_summary(spark, d):
    found = E.summary(results(spark, d).drop("n"))
    return found.select("label", *(r6(f"{m}_{x}").alias(f"{m}_{x}") for m in R.PANEL for x in ("mean", "std", "ci_lo", "ci_hi")))
