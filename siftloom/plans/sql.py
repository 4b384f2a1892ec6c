"""Fragments of the SQL twins."""

from __future__ import annotations

from siftloom.functions import constants as k

WS = k.WS_RE2


def quoted(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def text(c: str) -> str:
    return f"coalesce({c}, '')"


def compact(c: str) -> str:
    return f"regexp_replace({text(c)}, '{WS}+', '', 'g')"


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"


def rate(n: int) -> str:
    """Repetition of n-grams of the character list ch with cn characters."""
    gram = " || ".join(f"ch[i + {j}]" for j in range(n))
    return f"CASE WHEN cn < {n} THEN 0.0::DOUBLE ELSE 1 - len(list_distinct(list_transform(range(1, cn - {n} + 2), lambda i: {gram})))::DOUBLE / (cn - {n} + 1) END"


def sentence_count(c: str) -> str:
    d = k.SENTENCE_MARKS
    return f"(len(regexp_extract_all({text(c)}, '[{d}]')) + (regexp_replace(regexp_extract({text(c)}, '[^{d}]*$'), '{WS}+', '', 'g') <> '')::INT)::BIGINT"


def present(c: str, words: list[str]) -> str:
    return f"list_filter({quoted(words)}, lambda p: contains({c}, p))"


def profile(table: str, column: str, keep: str) -> str:
    """A query with the columns keep and the whole profile of a text column."""
    t = text(column)
    return f"""
WITH base AS (SELECT {keep}, {t} AS t, {compact(column)} AS c FROM {table}),
chars AS (SELECT *, string_split(c, '') AS ch, length(c) AS cn,
  list_transform(list_filter(list_transform(regexp_split_to_array(t, '\\n+'), lambda p: {strip('p')}), lambda p: p <> ''), lambda p: length(regexp_replace(p, '{WS}+', '', 'g'))::DOUBLE) AS pl FROM base),
rates AS (SELECT *, round({rate(3)} + 1e-12, 4) AS char_3, round({rate(4)} + 1e-12, 4) AS char_4, round({rate(5)} + 1e-12, 4) AS char_5,
  len(pl) AS paragraph_count, {sentence_count('t')} AS sentence_count,
  CASE WHEN len(pl) = 0 THEN 0.0 ELSE list_sum(pl) / len(pl) END AS pm FROM chars),
prof AS (SELECT *, char_3 AS word_3, char_4 AS word_4, char_5 AS word_5, CASE WHEN length(t) > 1 THEN char_4 ELSE 0.0 END AS half_split_repeat, cn AS total_chars,
  round(pm, 1) AS avg_paragraph_length,
  round(CASE WHEN len(pl) = 0 THEN 0.0 ELSE sqrt(list_sum(list_transform(pl, lambda x: (x - pm) * (x - pm))) / len(pl)) END, 1) AS paragraph_length_std,
  len(regexp_extract_all(t, '(?m)^#{{1,6}}{WS}')) AS heading_count,
  len(regexp_extract_all(t, '(?m)^{WS}*[-*]{WS}')) + len(regexp_extract_all(t, '(?m)^{WS}*\\p{{Nd}}+[.、]{WS}')) AS list_item_count,
  round(cn::DOUBLE / greatest(sentence_count, 1), 1) AS chars_per_sentence,
  {present("right(t, 200)", k.EVALUATOR_ENDINGS)} AS te, {present("t", k.ASSISTANT_PHRASES)} AS ap FROM rates),
full_profile AS (SELECT *, len(te) AS template_ending_count, len(ap) AS assistant_phrase_count, greatest(char_3, char_4, char_5) AS worst FROM prof)"""


#: Usable comparisons, decoded, each delivered once.
WINNER = f"""CASE WHEN lower(regexp_replace(winner, '^({WS}|\\.)+|({WS}|\\.)+$', '', 'g')) IN ('a', 'model_a') THEN 'A'
  WHEN lower(regexp_replace(winner, '^({WS}|\\.)+|({WS}|\\.)+$', '', 'g')) IN ('b', 'model_b') THEN 'B'
  WHEN lower(regexp_replace(winner, '^({WS}|\\.)+|({WS}|\\.)+$', '', 'g')) IN ('tie', 'draw', '平局', 'c') THEN 'tie' END"""
JUDGED = f"""
WITH usable AS (SELECT *, {WINNER} AS w, coalesce(position_swapped, false) AS sw FROM pairwise_results),
once AS (SELECT * FROM usable WHERE w IS NOT NULL QUALIFY row_number() OVER (PARTITION BY prompt_id, model_a, model_b, judge_id, judged_at ORDER BY row_id) = 1),
judged AS (SELECT row_id, prompt_id, model_a, model_b, judge_id, judged_at, sw, reasoning,
  CASE WHEN sw AND w = 'A' THEN 'B' WHEN sw AND w = 'B' THEN 'A' ELSE w END AS winner,
  CASE WHEN sw THEN scores_b ELSE scores_a END AS sa, CASE WHEN sw THEN scores_a ELSE scores_b END AS sb FROM once)"""
KEYS = "prompt_id, model_a, model_b"


def side(s: str, d: str) -> str:
    return f"coalesce(s{s}.{d}, 0.0)"


def mean_side(s: str) -> str:
    return "(" + " + ".join(side(s, d) for d in k.DIMENSIONS) + ") / 6"


PLURALITY = f"""votes AS (SELECT {KEYS}, winner, count(*) AS n, min(row_id) AS first FROM judged GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY {KEYS} ORDER BY n DESC, first) AS rn, lead(n) OVER (PARTITION BY {KEYS} ORDER BY n DESC, first) AS second, sum(n) OVER (PARTITION BY {KEYS}) AS total FROM votes),
plural AS (SELECT {KEYS}, CASE WHEN second IS NULL OR n > second THEN winner ELSE 'tie' END AS winner, round(n::DOUBLE / total + 1e-9, 3) AS agreement, total::BIGINT AS num_rounds FROM ranked WHERE rn = 1)"""
MEDIANS = f"""medians AS (SELECT {KEYS}, {", ".join(f"round(median({side(s, d)}) + 1e-9, 1) AS {s}_{d}" for s in "ab" for d in k.DIMENSIONS)}, count_if(sw) AS position_swaps FROM judged GROUP BY ALL)"""

#: Both sides of every comparison as single judgements of a version.
SINGLES = f"""singles AS (SELECT prompt_id, model_a AS model_version, sa AS s FROM judged UNION ALL SELECT prompt_id, model_b, sb FROM judged),
rounds AS (SELECT prompt_id, model_version, count(*) AS num_rounds, {", ".join(f"round(median(coalesce(s.{d}, 0.0)) + 1e-9, 1) AS {d}" for d in k.DIMENSIONS)},
  greatest({", ".join(f"stddev_pop(coalesce(s.{d}, 0.0))" for d in k.DIMENSIONS)}) AS std FROM singles GROUP BY ALL),
single_rounds AS (SELECT * EXCLUDE (std), round(std + 1e-9, 3) AS max_std, round(std, 9) > 1.5 AS uncertain FROM rounds)"""
