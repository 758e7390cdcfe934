"""The queries of the training-data problems, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import dedup, defects, groups, leakage, overlap, pieces, subjects, tokens, truncation
from tessera.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def _tables(*names: str) -> Callable[[Callable[..., DataFrame]], Query]:
    """A query over named tables."""
    return lambda run: lambda spark, folder: run(*(table(spark, folder, n) for n in names))


ANSWERS = ("predictions", "provider_config", "messages", "suite_cases")

QUERIES: dict[str, Query] = {
    "p1_found": _tables("split_membership")(groups.torn_ids),
    "p1_splits": _tables("split_membership")(lambda members: groups.deal(groups.related_ids(members))),
    "p1_forest": _tables("split_membership")(groups.forest_of),
    "p2_found": _tables("predictions", "messages", "suite_cases")(defects.broken_pairs),
    "p3_found": _tables("prompt_specs")(dedup.copies),
    "p3_distinct": _tables("prompt_specs")(dedup.distinct_texts),
    "p3_collisions": _tables("prompt_specs")(dedup.collisions),
    "p4_found": _tables(*ANSWERS)(lambda *t: truncation.cut_answers(*t).select("prediction_key")),
    "p4_by_source": _tables(*ANSWERS)(truncation.by_source),
    "p4_limits": _tables("predictions")(truncation.hidden_limits),
    "p6_found": _tables("messages", "train_settings")(lambda m, s: pieces.split_items(m, s).where("piece = 0 AND pieces > 1").select("message_key")),
    "p6_pieces": _tables("messages", "train_settings")(pieces.split_items),
    "p7_found": _tables("prompt_specs", "split_membership")(lambda p, m: overlap.cross_split(p, m).select("id_a", "id_b").distinct()),
    "p7_by_source": _tables("prompt_specs", "split_membership")(overlap.report),
    "p10_found": _tables("documents", "doc_labels", "subjects")(subjects.subjects_of),
    "p10_composition": _tables("documents", "doc_labels", "subjects")(subjects.composition),
    "p9_found": _tables("documents", "eval_items")(lambda d, e: leakage.passages(d, e).select("doc_id", "item_id")),
    "p9_by_item": _tables("documents", "eval_items")(leakage.leaked_report),
    "p8_ids": _tables("documents")(tokens.encode_table),
}


_TOKENS = "CAST(ceil(length(content) / 4.0) AS BIGINT)"
SQL: dict[str, str] = {
    # Rows that share an id or a digest, and so on: the smallest node that can be reached.
    "p1_found": """WITH RECURSIVE rows AS (SELECT 'i' || id AS i, 'd' || coalesce(nullif(regexp_extract(lower(trim(prompt_group, E' \\n\\t\\r')), '[0-9a-f]{64}'), ''), nullif(lower(trim(prompt_group, E' \\n\\t\\r')), '')) AS d,
 CASE lower(trim(split)) WHEN 'validation' THEN 'val' ELSE lower(trim(split)) END AS s FROM split_membership WHERE id IS NOT NULL),
links AS (SELECT DISTINCT a.i, b.i AS j FROM rows a JOIN rows b ON a.d = b.d),
reach AS (SELECT i, i AS j FROM rows UNION SELECT r.i, l.j FROM reach r JOIN links l ON r.j = l.i),
sets AS (SELECT i, min(j) AS root FROM reach GROUP BY 1),
torn AS (SELECT root FROM sets JOIN rows USING (i) GROUP BY 1 HAVING count(DISTINCT s) FILTER (s IN ('train', 'val', 'test')) > 1)
SELECT substr(i, 2) AS id FROM sets WHERE root IN (SELECT root FROM torn)""",
    "p6_found": f"SELECT DISTINCT message_key FROM messages m JOIN train_settings t ON coalesce(m.profile, (SELECT min(profile) FROM train_settings WHERE is_default)) = t.profile WHERE {_TOKENS} > max_seq_length",
    "p4_limits": """WITH texts AS (SELECT source, rtrim(raw_response, '�') AS t FROM predictions WHERE raw_response IS NOT NULL AND source IS NOT NULL),
more AS (SELECT source, t, length(t) AS n, len(string_split(t, E'\\n')) - 1 AS lf, len(string_split(t, E'\\r\\n')) - 1 AS crlf, len(string_split(t, '"')) - 1 AS q, len(string_split(t, '&')) - 1 AS amp, len(string_split(t, '<')) - 1 AS lt, len(string_split(t, '>')) - 1 AS gt, len(string_split(t, chr(92))) - 1 AS bs, len(string_split(t, E'\\t')) - 1 AS tab, len(string_split(t, E'\\r')) - 1 AS cr FROM texts),
each AS (SELECT source, unnest(['characters','utf8_bytes','utf16_units','html_escaped','json_escaped','crlf']) AS measure, unnest([n, octet_length(encode(t)), n + n - length(regexp_replace(t, '[\\x{10000}-\\x{10FFFF}]', '', 'g')), n + amp * 4 + lt * 3 + gt * 3 + q * 5, n + lf + q + bs + tab + cr, n + lf - crlf]) AS length FROM more),
counted AS (SELECT source, measure, length, count(*) AS k FROM each GROUP BY 1, 2, 3),
top AS (SELECT source, measure, max(length) AS "limit", arg_max(k, length) AS at_limit, CAST(sum(k) AS BIGINT) AS answers FROM counted GROUP BY 1, 2)
SELECT source, measure, CAST("limit" AS BIGINT) AS "limit", at_limit, answers FROM top WHERE at_limit >= 3 AND at_limit >= 0.03 * answers""",
}


def queries() -> dict[str, Query]:
    """All queries of this subpackage."""
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    """The SQL of those that SQL can express."""
    return dict(SQL)
