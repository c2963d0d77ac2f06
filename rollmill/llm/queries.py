"""Queries pN_ of the training-data operators; each runs over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rollmill.llm import bpe, leakage, mixing, neardup, pairs, percentiles, spam
from rollmill.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.grouped_pairs(neardup.near_groups(table(spark, sf_dir, "chats"), threshold=0.7))


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_groups(table(spark, sf_dir, "chats"), threshold=0.7)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.defective_pairs(table(spark, sf_dir, "chats"), table(spark, sf_dir, "generations"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.cut_texts(table(spark, sf_dir, "generations"), table(spark, sf_dir, "demos"))


def p3_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.cut_rates(*(table(spark, sf_dir, name) for name in ("generations", "demos", "forward_export")))


def p4_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return percentiles.percentiles(table(spark, sf_dir, "forward_export"), "data_source", ["final_loss", "token_entropy"], "logged_at")


def p4_partials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return percentiles.partial_counts(table(spark, sf_dir, "forward_export"), "data_source", ["final_loss", "token_entropy"], "logged_at")


def p4_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return percentiles.bounds_from_partials(p4_partials(spark, sf_dir))


def p4_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return percentiles.daily_bounds(p4_partials(spark, sf_dir))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaks(table(spark, sf_dir, "chats"), table(spark, sf_dir, "eval_items"))


def p5_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaked_passages(table(spark, sf_dir, "chats"), table(spark, sf_dir, "eval_items")).distinct()


def p5_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaks_by_source(table(spark, sf_dir, "chats"), table(spark, sf_dir, "eval_items"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_corpus(table(spark, sf_dir, "documents"))


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spam.spam_pages(table(spark, sf_dir, "documents"))


def p8_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spam.host_rates(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_groups, p2_found, p3_found, p3_rates, p4_percentiles, p4_partials, p4_bounds, p4_daily, p5_found, p5_passages, p5_sources, p6_ids, p7_mix, p7_shares, p8_found, p8_hosts)}


#: Words, links and groups of chats by joining every pair that shares a word; for small tables.
_GROUPS = r"""
    WITH RECURSIVE m AS (SELECT chat_id, unnest(messages) AS m FROM chats),
    w AS (SELECT DISTINCT chat_id, unnest(regexp_extract_all(lower(m.content), '[\p{L}\p{N}]+')) AS w FROM m WHERE coalesce(m.role, '') <> 'system' AND m.content IS NOT NULL),
    n AS (SELECT chat_id, count(*) AS n FROM w GROUP BY chat_id),
    c AS (SELECT a.chat_id AS a, b.chat_id AS b, count(*) AS c FROM w a JOIN w b ON a.w = b.w AND a.chat_id < b.chat_id GROUP BY a.chat_id, b.chat_id),
    l AS (SELECT c.a, c.b FROM c JOIN n p ON p.chat_id = c.a JOIN n r ON r.chat_id = c.b WHERE 10 * c >= 7 * (p.n + r.n - c)),
    e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
    r AS (SELECT a AS node, a AS other FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.other)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _GROUPS + " SELECT DISTINCT node AS chat_id_a, other AS chat_id_b FROM r WHERE node < other",
        "p1_groups": _GROUPS + " SELECT n.chat_id, coalesce(min(r.other), n.chat_id) AS root FROM n LEFT JOIN r ON r.node = n.chat_id GROUP BY n.chat_id",
        "p4_percentiles": """
            WITH v AS (
              SELECT data_source, 'final_loss' AS metric, final_loss AS x FROM forward_export
              UNION ALL
              SELECT data_source, 'token_entropy', unnest(token_entropy) FROM forward_export
            ), r AS (
              SELECT data_source, metric, x, row_number() OVER (PARTITION BY data_source, metric ORDER BY x) AS k,
                     count(*) OVER (PARTITION BY data_source, metric) AS n
              FROM v WHERE x IS NOT NULL AND NOT isnan(x)
            )
            SELECT data_source, metric, CAST(percent AS INTEGER) AS percent, n AS n_values, x AS value, CAST(0 AS DOUBLE) AS error_bound
            FROM r JOIN (SELECT unnest([1, 5, 25, 50, 75, 95, 99]) AS percent) p ON k = (percent * n + 99) // 100
        """,
    }
