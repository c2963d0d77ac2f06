"""Queries of aggregation, windows, sorting, sets and joins."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from rollmill.functions import arrays as A
from rollmill.functions import stats
from rollmill.operators import joins as J
from rollmill.operators import metrics as M
from rollmill.plans.registry import Registry

LINE = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate"
#: Distinct exports: a row per key, the earliest delivered.
EXPORT = "(SELECT uid, response_id, global_step, min(data_source) AS data_source, max(demo_len) AS demo_len, max(len(loss_mask)) AS n FROM forward_export GROUP BY uid, response_id, global_step)"
FINITE = "final_loss IS NOT NULL AND NOT isnan(final_loss) AND abs(final_loss) < 1e6 AND final_loss >= 0"
STEPS = [0, 50, 100, 150]


def _finite(t):
    return t.forward_export.where(FINITE)


def _events(t):
    return t.events.withColumn("pred", (F.get_json_object("props", "$.k").cast("int") % 5).cast("string"))


EVENTS = "(SELECT *, CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) % 5 AS VARCHAR) AS pred FROM events)"


def register(q: Registry) -> None:
    # --- aggregation
    @q("group_mean", f"SELECT uid, round(avg(final_loss), 9) AS loss FROM forward_export WHERE {FINITE} GROUP BY uid")
    def _(t):
        return _finite(t).groupBy("uid").agg(F.round(F.avg("final_loss"), 9).alias("loss"))

    @q("group_mean_var", f"SELECT uid, round(avg(final_loss), 9) AS mean, round(coalesce(var_samp(final_loss), 0), 8) AS var FROM forward_export WHERE {FINITE} GROUP BY uid")
    def _(t):
        return _finite(t).groupBy("uid").agg(F.round(F.avg("final_loss"), 9).alias("mean"), F.round(F.coalesce(F.var_samp("final_loss"), F.lit(0.0)), 8).alias("var"))

    @q("group_collect_list", f"SELECT user_id, count(*) AS n, array_to_string(list(event_id ORDER BY event_id), ',') AS ids, round(avg(value), 5) AS mean FROM events GROUP BY user_id")
    def _(t):
        ids = F.array_sort(F.collect_list("event_id"))
        return t.events.groupBy("user_id").agg(F.count("*").alias("n"), F.array_join(F.transform(ids, lambda x: x.cast("string")), ",").alias("ids"), F.round(F.avg("value"), 5).alias("mean"))

    @q("flatten_group_mean", "SELECT uid, round(avg(x), 5) AS mean FROM (SELECT uid, unnest(correctness) AS x FROM demos) GROUP BY uid")
    def _(t):
        return t.demos.select("uid", F.explode("correctness").alias("x")).groupBy("uid").agg(F.round(F.avg("x"), 5).alias("mean"))

    @q("two_level_mean", "SELECT data_source, round(avg(list_avg(correctness)), 6) AS score FROM demos WHERE len(correctness) > 0 GROUP BY data_source")
    def _(t):
        return t.demos.where("size(correctness) > 0").groupBy("data_source").agg(F.round(F.avg(A.mean("correctness")), 6).alias("score"))

    for name, column, sql in (("array_mean", lambda: A.mean("correctness"), "list_avg(correctness)"), ("array_max", lambda: F.array_max("correctness"), "list_max(correctness)"), ("array_sum", lambda: A.total("correctness"), "coalesce(list_sum(correctness), 0)")):
        q(name, f"SELECT uid, num_demo, round({sql}, 5) AS value FROM demos")(lambda t, column=column: t.demos.select("uid", "num_demo", F.round(column(), 5).alias("value")))

    kept = "list_filter(demos_len, lambda x: x < 60)"

    @q("filtered_array_mean", f"SELECT uid, value FROM (SELECT uid, round(CASE WHEN len(demos_len) = 0 THEN 0 WHEN len({kept}) = 0 THEN -1 ELSE list_avg({kept}) END, 5) AS value FROM demos WHERE demos_len IS NOT NULL) WHERE value > 0")
    def _(t):
        own = F.filter("demos_len", lambda x: x < 60)
        value = F.when(F.size("demos_len") == 0, 0.0).when(F.size(own) == 0, -1.0).otherwise(A.mean(own))
        return t.demos.where("demos_len IS NOT NULL").select("uid", F.round(value, 5).alias("value")).where("value > 0")

    @q("perplexity", "SELECT uid, response_id, global_step, round(exp(-list_sum(token_log_p) / len(token_log_p)), 4) AS ppl FROM forward_export WHERE len(token_log_p) > 0")
    def _(t):
        return t.forward_export.where("size(token_log_p) > 0").select("uid", "response_id", "global_step", F.round(F.exp(-A.total("token_log_p") / F.size("token_log_p")), 4).alias("ppl"))

    @q("sft_loss_agg", "SELECT round(sum(l * m) / (sum(m) + 1e-8) * 2, 6) AS loss FROM (SELECT unnest(loss) AS l, unnest(loss_mask) AS m FROM forward_export)")
    def _(t):
        rows = t.forward_export.select(stats.masked_sum("loss", "loss_mask").alias("s"), A.total("loss_mask").alias("n"))
        return rows.agg(F.round(F.sum("s") / (F.sum("n") + 1e-8) * 2, 6).alias("loss"))

    @q("avg_pass_maj", "SELECT data_source, round(avg(avg_correctness), 6) AS avg, round(avg(CASE WHEN avg_correctness > 0 THEN 1 ELSE 0 END), 6) AS pass, round(avg(CASE WHEN avg_correctness > 0.5 THEN 1 WHEN avg_correctness = 0.5 THEN 0.5 ELSE 0 END), 6) AS maj FROM demos WHERE num_demo > 0 GROUP BY data_source")
    def _(t):
        return M.passes(t.demos.where("NOT isnan(avg_correctness)"), ["data_source"], "avg_correctness").select("data_source", *(F.round(c, 6).alias(c) for c in ("avg", "pass", "maj")))

    @q("mean_std_loss", f"SELECT global_step, round(avg(final_loss), 9) AS mean, round(stddev_pop(final_loss), 5) AS std FROM forward_export WHERE {FINITE} GROUP BY global_step")
    def _(t):
        return _finite(t).groupBy("global_step").agg(F.round(F.avg("final_loss"), 9).alias("mean"), F.round(F.stddev_pop("final_loss"), 5).alias("std"))

    names = "CASE l_linenumber % 4 WHEN 0 THEN 'perf/max_memory' WHEN 1 THEN 'minibatch_loss' WHEN 2 THEN 'actor/max_min' ELSE 'loss' END"

    @q("reduce_metrics", f"SELECT name, round(CASE WHEN name LIKE '%max%' THEN max(l_tax) WHEN name LIKE '%min%' THEN min(l_tax) ELSE avg(l_tax) END, 6) AS value FROM (SELECT {names} AS name, l_tax FROM lineitem) GROUP BY name")
    def _(t):
        rows = t.lineitem.select(F.expr(names).alias("name"), F.col("l_tax").alias("value"))
        return M.reduce_metrics(rows).select("name", F.round("value", 6).alias("value"))

    @q("append_to_dict", f"SELECT {names} AS name, count(*) AS n FROM lineitem GROUP BY 1")
    def _(t):
        return t.lineitem.select(F.expr(names).alias("name")).groupBy("name").agg(F.count("*").alias("n"))

    info = "(SELECT *, coalesce(list_sum(loss_mask[greatest(len(loss_mask) - 9, 1):]), 0)::BIGINT AS r, coalesce(list_sum(loss_mask), 0)::BIGINT AS a FROM forward_export)"

    @q("response_info", f"SELECT uid, response_id, global_step, r::INTEGER AS response_length, (a - r)::INTEGER AS prompt_length FROM {info}")
    def _(t):
        return M.response_info(t.forward_export, "loss_mask", F.lit(10)).select("uid", "response_id", "global_step", "response_length", "prompt_length")

    @q("data_metrics", f"""SELECT round(avg(s), 5) AS score_mean, round(max(s), 5) AS score_max, round(min(s), 5) AS score_min, round(avg(len(loss)), 5) AS response_length_mean, max(len(loss))::BIGINT AS response_length_max, round(avg(CASE WHEN len(loss) = 100 THEN 1 ELSE 0 END), 6) AS clip_ratio,
        round(1 - var_samp(s - v) / (var_samp(s) + 1e-5), 5) AS explained FROM (SELECT *, list_sum(loss) AS s, list_sum(token_log_p) AS v FROM forward_export WHERE len(loss) > 0)""")
    def _(t):
        rows = t.forward_export.where("size(loss) > 0").select(A.total("loss").alias("s"), A.total("token_log_p").alias("v"), F.size("loss").alias("n"))
        return rows.agg(
            F.round(F.avg("s"), 5).alias("score_mean"), F.round(F.max("s"), 5).alias("score_max"), F.round(F.min("s"), 5).alias("score_min"), F.round(F.avg("n"), 5).alias("response_length_mean"), F.max("n").cast("long").alias("response_length_max"),
            F.round(F.avg((F.col("n") == 100).cast("double")), 6).alias("clip_ratio"), F.round(stats.explained_variance(F.col("s"), F.col("v")), 5).alias("explained"),
        )

    @q("data_metrics_tokens", "SELECT round(avg(l), 6) AS mean, max(l) AS max, min(l) AS min FROM (SELECT unnest(loss) AS l, unnest(loss_mask) AS m FROM forward_export) WHERE m > 0")
    def _(t):
        x = M.token_summary(t.forward_export, "loss", "loss_mask", "l")
        return x.select(F.round("l/mean", 6).alias("mean"), F.col("l/max").alias("max"), F.col("l/min").alias("min"))

    @q("timing_metrics", f"WITH s AS (SELECT sum(r) AS r, sum(a) AS a FROM {info}) SELECT 'timing_s/gen' AS name, 5.0::DOUBLE AS value FROM s UNION ALL SELECT 'timing_s/ref', 3.0 FROM s UNION ALL SELECT 'timing_s/step', 9.0 FROM s UNION ALL SELECT 'timing_per_token_ms/gen', round(5000.0 / r, 6) FROM s UNION ALL SELECT 'timing_per_token_ms/ref', round(3000.0 / a, 6) FROM s")
    def _(t):
        return M.timing(M.response_info(t.forward_export, "loss_mask", F.lit(10)), {"gen": 5.0, "ref": 3.0, "step": 9.0}).select("name", F.round("value", 6).alias("value"))

    @q("throughput_metrics", f"SELECT sum(a)::BIGINT AS total_num_tokens, 9.0::DOUBLE AS time_per_step, round(sum(a) / 18.0, 4) AS throughput FROM {info}")
    def _(t):
        return M.throughput(M.response_info(t.forward_export, "loss_mask", F.lit(10)), 9.0, 2).withColumn("throughput", F.round("throughput", 4))

    @q("prefix_metrics", f"SELECT round(avg(n) FILTER (WHERE l_returnflag <> 'N'), 6) AS prefix_quantity, round(count(*) FILTER (WHERE l_returnflag <> 'N')::DOUBLE / count(*), 6) AS off_ratio FROM (SELECT *, l_quantity AS n FROM lineitem)")
    def _(t):
        has = F.col("l_returnflag") != "N"
        return t.lineitem.agg(F.round(F.avg(F.when(has, F.col("l_quantity"))), 6).alias("prefix_quantity"), F.round(F.count_if(has) / F.count("*"), 6).alias("off_ratio"))

    @q("seqlen_unbalance", "SELECT min(s)::BIGINT AS least, max(s)::BIGINT AS largest, round(avg(s), 4) AS mean FROM (SELECT doc_id % 8 AS c, sum(coalesce(n_chars, 0)) AS s FROM documents GROUP BY 1)")
    def _(t):
        rows = t.documents.select((F.col("doc_id") % 8).alias("c"), F.coalesce("n_chars", F.lit(0)).alias("n"))
        return M.unbalance(rows, "c", "n").withColumn("mean", F.round("mean", 4))

    @q("bootstrap_metric")
    def _(t):
        return M.bootstrap(t.events, ["event_type"], "value", "event_id", 4, {"max": np.max, "min": np.min})

    @q("majority_vote", f"""WITH v AS (SELECT event_type, user_id, pred, count(*) AS n, min(event_id) AS f, arg_min(value, event_id) AS val FROM {EVENTS} GROUP BY ALL)
        SELECT event_type, user_id, val AS majority FROM v QUALIFY row_number() OVER (PARTITION BY event_type, user_id ORDER BY n DESC, f) = 1""".replace("GROUP BY ALL", "GROUP BY event_type, user_id, pred"))
    def _(t):
        return M.majority(_events(t), ["event_type", "user_id"], "pred", "value", "event_id")

    @q("validation_metrics", """WITH g AS (SELECT event_type, user_id, count(*)::INTEGER AS n, avg(value) AS mean, stddev_pop(value) AS std, list(value ORDER BY value) AS v FROM events GROUP BY event_type, user_id),
        k AS (SELECT *, unnest(list_filter([2, 4, 8, 16, 32, 64, 128, 256, 512, 1024], lambda p: p < n) || CASE WHEN n > 1 THEN [n] ELSE [] END) AS k FROM g),
        m AS (SELECT event_type, 'mean@' || n AS name, mean AS value FROM g UNION ALL SELECT event_type, 'std@' || n, std FROM g WHERE n > 1
          UNION ALL SELECT event_type, 'best@' || k || '/mean', list_sum(list_transform(v, lambda x, i: x * (pow(i / n::DOUBLE, k) - pow((i - 1) / n::DOUBLE, k)))) FROM k
          UNION ALL SELECT event_type, 'worst@' || k || '/mean', list_sum(list_transform(v, lambda x, i: x * (pow((n - i + 1) / n::DOUBLE, k) - pow((n - i) / n::DOUBLE, k)))) FROM k)
        SELECT event_type, name, round(avg(value), 9) AS value FROM m GROUP BY event_type, name""")
    def _(t):
        # its SQL has no std of best and worst and no maj
        return M.validation(t.events, "event_type", "user_id", "value", "event_id").where("name NOT LIKE '%/std'").select("event_type", "name", F.round("value", 9).alias("value"))

    @q("best_of_k", "SELECT l_orderkey, round(list_sum(list_transform(v, lambda x, i: x * (pow(i / len(v)::DOUBLE, 3) - pow((i - 1) / len(v)::DOUBLE, 3)))), 5) AS best3 FROM (SELECT l_orderkey, list(l_quantity ORDER BY l_quantity) AS v FROM lineitem GROUP BY 1)")
    def _(t):
        return t.lineitem.groupBy("l_orderkey").agg(F.collect_list("l_quantity").alias("v")).select("l_orderkey", F.round(stats.best_of_k(F.col("v"), 3), 5).alias("best3"))

    @q("val_core_aux", "WITH m AS (SELECT 's' || l_suppkey % 5 AS source, CASE WHEN l_suppkey % 5 < 3 AND l_linenumber % 2 = 0 THEN 'acc' WHEN l_linenumber % 3 = 0 THEN 'reward' ELSE 'len' END AS variable, CASE l_partkey % 4 WHEN 0 THEN 'mean' WHEN 1 THEN 'best' WHEN 2 THEN 'worst' ELSE 'std' END || '@' || (1 + l_orderkey % 8) AS name FROM lineitem), d AS (SELECT DISTINCT * FROM m), s AS (SELECT *, max(CAST(regexp_extract(name, '@([0-9]+)', 1) AS INTEGER)) OVER (PARTITION BY source, variable) AS most, max(CASE WHEN variable = 'acc' THEN 1 ELSE 0 END) OVER (PARTITION BY source) AS acc FROM d) SELECT source, variable, name, CASE WHEN variable = CASE WHEN acc = 1 THEN 'acc' ELSE 'reward' END AND regexp_matches(name, '^(mean|maj|best)') AND CAST(regexp_extract(name, '@([0-9]+)', 1) AS INTEGER) = most THEN 'val-core' ELSE 'val-aux' END AS section FROM s")
    def _(t):
        rows = t.lineitem.select(
            F.concat(F.lit("s"), (F.col("l_suppkey") % 5).cast("string")).alias("source"),
            F.expr("CASE WHEN l_suppkey % 5 < 3 AND l_linenumber % 2 = 0 THEN 'acc' WHEN l_linenumber % 3 = 0 THEN 'reward' ELSE 'len' END").alias("variable"),
            F.expr("concat(CASE l_partkey % 4 WHEN 0 THEN 'mean' WHEN 1 THEN 'best' WHEN 2 THEN 'worst' ELSE 'std' END, '@', 1 + l_orderkey % 8)").alias("name"),
        ).distinct()
        return M.core_or_aux(rows)

    @q("dist_mean_max_min_std", "SELECT round(avg(l_quantity), 6) AS mean, max(l_quantity) AS max, min(l_quantity) AS min, round(stddev_samp(l_quantity), 6) AS std FROM lineitem")
    def _(t):
        return t.lineitem.agg(F.round(F.avg("l_quantity"), 6).alias("mean"), F.max("l_quantity").alias("max"), F.min("l_quantity").alias("min"), F.round(F.stddev_samp("l_quantity"), 6).alias("std"))

    @q("dist_masked_mean", "SELECT round(sum(l * m) / sum(m), 6) AS mean FROM (SELECT unnest(loss) AS l, unnest(loss_mask) AS m FROM forward_export)")
    def _(t):
        rows = t.forward_export.select(stats.masked_sum("loss", "loss_mask").alias("s"), A.total("loss_mask").alias("n"))
        return rows.agg(F.round(F.sum("s") / F.sum("n"), 6).alias("mean"))

    @q("count_prefix_levels", "SELECT difficulty, count(*) AS n FROM demos GROUP BY difficulty")
    def _(t):
        return t.demos.groupBy("difficulty").agg(F.count("*").alias("n"))

    @q("histogram", "SELECT least(floor((l_extendedprice - lo) / (hi - lo) * 20), 19)::INTEGER AS bin, count(*) AS n FROM lineitem, (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem) GROUP BY 1")
    def _(t):
        return stats.width_histogram(t.lineitem, "l_extendedprice", 20)

    @q("flops_estimate", "SELECT round((6.0 * 7615283200.0 * sum(n_chars::DOUBLE) + 12.0 * 128 * 28 * 28 * sum(n_chars::DOUBLE * n_chars)) / 2.0 / 1e12, 4) AS tflops FROM documents")
    def _(t):
        return M.dense_flops(t.documents, "n_chars", 2.0, hidden=3584, vocabulary=152064, layers=28, kv_heads=4, heads=28, intermediate=18944).select(F.round("tflops", 4).alias("tflops"))

    # --- windows
    @q("topk_tokens", "SELECT uid, response_id, global_step, round(avg(l), 9) AS loss FROM (SELECT *, row_number() OVER (PARTITION BY uid, response_id, global_step, logged_at, ingested_at ORDER BY e DESC, i) AS r FROM (SELECT uid, response_id, global_step, logged_at, ingested_at, unnest(token_log_p) AS e, unnest(loss) AS l, generate_subscripts(loss, 1) AS i, len(loss) AS n FROM forward_export)) WHERE r <= greatest(1, floor(n * 0.1)) GROUP BY uid, response_id, global_step, logged_at, ingested_at")
    def _(t):
        tokens = F.transform(F.arrays_zip("token_log_p", "loss"), lambda x, i: F.struct((-x["token_log_p"]).alias("e"), i.alias("i"), x["loss"].alias("l")))
        top = F.slice(F.array_sort(tokens), F.lit(1), F.greatest(F.lit(1), F.floor(F.size("loss") * 0.1).cast("int")))
        return t.forward_export.where("size(loss) > 0").select("uid", "response_id", "global_step", F.round(A.mean(F.transform(top, lambda x: x["l"])), 9).alias("loss"))

    @q("per_source_first_n", "SELECT data_source, chat_id FROM (SELECT DISTINCT data_source, chat_id FROM chats) QUALIFY row_number() OVER (PARTITION BY data_source ORDER BY chat_id) <= 3")
    def _(t):
        # the three least of each task's rows are enough: no source is gathered whole
        least = F.slice(F.array_sort(F.collect_set("chat_id")), 1, 3)
        parts = t.chats.groupBy("data_source", F.pmod(F.xxhash64("chat_id"), F.lit(64)).alias("part")).agg(least.alias("ids"))
        return parts.groupBy("data_source").agg(F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, 3).alias("ids")).select("data_source", F.explode("ids").alias("chat_id"))

    @q("convergence_diff", "SELECT uid, response_id, global_step, demo_len - lag(demo_len) OVER (PARTITION BY uid, response_id ORDER BY global_step) AS diff FROM " + EXPORT)
    def _(t):
        own = t.forward_export.groupBy("uid", "response_id", "global_step").agg(F.max("demo_len").alias("demo_len"))
        w = Window.partitionBy("uid", "response_id").orderBy("global_step")
        return own.select("uid", "response_id", "global_step", (F.col("demo_len") - F.lag("demo_len").over(w)).alias("diff"))

    @q("group_quantile_transform", "WITH s AS (SELECT l_returnflag, quantile_cont(l_quantity, 0.25) AS a, quantile_cont(l_quantity, 0.75) AS b FROM lineitem GROUP BY 1) SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 4) AS total FROM lineitem JOIN s USING (l_returnflag) WHERE l_quantity BETWEEN a - 0.1 * (b - a) AND b + 0.1 * (b - a) GROUP BY 1")
    def _(t):
        return stats.iqr_fence(t.lineitem, "l_quantity", "l_returnflag", factor=0.1).groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 4).alias("total"))

    # --- sort, limit, sets
    @q("sort_multi", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey LIMIT 50")
    def _(t):
        return t.orders.select("o_orderkey", "o_custkey", "o_totalprice").orderBy("o_custkey", F.desc("o_totalprice"), "o_orderkey").limit(50)

    @q("sort_natural_step", "SELECT DISTINCT 'global_step_' || global_step AS dir, global_step AS step FROM forward_export ORDER BY step")
    def _(t):
        dirs = t.forward_export.select(F.concat(F.lit("global_step_"), F.col("global_step").cast("string")).alias("dir")).distinct()
        return dirs.withColumn("step", F.regexp_extract("dir", r"(\d+)$", 1).cast("long")).orderBy("step")

    @q("nsmallest_hardest", "SELECT uid, round(avg(avg_correctness), 6) AS acc FROM demos WHERE num_demo > 0 GROUP BY uid ORDER BY acc, uid LIMIT 40")
    def _(t):
        return t.demos.where("NOT isnan(avg_correctness)").groupBy("uid").agg(F.round(F.avg("avg_correctness"), 6).alias("acc")).orderBy("acc", "uid").limit(40)

    @q("concat_datasets", "SELECT uid, data_source FROM generations UNION ALL SELECT uid, data_source FROM demos")
    def _(t):
        return t.generations.select("uid", "data_source").unionByName(t.demos.select("uid", "data_source"))

    @q("dedup_lines", "SELECT DISTINCT text FROM documents")
    def _(t):
        return t.documents.select("text").distinct()

    @q("dedup_answers", "SELECT DISTINCT uid, unnest(responses) AS answer FROM generations")
    def _(t):
        return t.generations.select("uid", F.explode("responses").alias("answer")).distinct()

    @q("key_intersect", "SELECT uid FROM forward_export INTERSECT SELECT uid FROM demos")
    def _(t):
        return t.forward_export.select("uid").intersect(t.demos.select("uid"))

    @q("set_union_methods", "SELECT data_source FROM generations UNION SELECT data_source FROM chats")
    def _(t):
        return t.generations.select("data_source").union(t.chats.select("data_source")).distinct()

    @q("set_diff", "SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem")
    def _(t):
        return t.orders.select("o_orderkey").subtract(t.lineitem.select("l_orderkey"))

    edges = "(SELECT list_sort(list_distinct(quantile_cont(l_quantity, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS e FROM lineitem)"

    @q("quantile_bins", f"SELECT greatest(len(list_filter(e, lambda x: x < l_quantity)) - 1, 0)::INTEGER AS bin, count(*) AS n FROM lineitem, {edges} GROUP BY 1")
    def _(t):
        return stats.quantile_bins(t.lineitem, "l_quantity", 10).groupBy("bin").agg(F.count("*").alias("n"))

    @q("iqr_filter", "WITH s AS (SELECT quantile_cont(c_acctbal, 0.25) AS a, quantile_cont(c_acctbal, 0.75) AS b FROM customer) SELECT c_custkey, c_acctbal FROM customer, s WHERE c_acctbal BETWEEN a - 0.2 * (b - a) AND b + 0.2 * (b - a)")
    def _(t):
        return stats.iqr_fence(t.customer, "c_acctbal", factor=0.2).select("c_custkey", "c_acctbal")

    @q("threshold_bucket", "SELECT CASE WHEN avg_correctness > 0.5 THEN 'easy' ELSE 'hard' END AS bucket, count(*) AS n FROM demos WHERE num_demo > 0 GROUP BY 1")
    def _(t):
        return t.demos.where("NOT isnan(avg_correctness)").groupBy(F.when(F.col("avg_correctness") > 0.5, "easy").otherwise("hard").alias("bucket")).agg(F.count("*").alias("n"))

    @q("lowess_trend", """WITH p AS (SELECT l_returnflag AS f, l_quantity::DOUBLE AS x, avg(l_extendedprice) AS y FROM lineitem GROUP BY 1, 2),
        k AS (SELECT f, greatest(2, floor(count(*) * 2 / 3.0 + 1e-10))::INTEGER AS k FROM p GROUP BY f),
        d AS (SELECT a.f, a.x AS x0, b.x, b.y, abs(a.x - b.x) AS d, row_number() OVER (PARTITION BY a.f, a.x ORDER BY abs(a.x - b.x)) AS r FROM p a JOIN p b ON a.f = b.f),
        h AS (SELECT d.f, x0, max(d) AS h FROM d JOIN k USING (f) WHERE r <= k GROUP BY d.f, x0),
        w AS (SELECT d.f, d.x0, x, y, pow(greatest(1 - pow(d / h, 3), 0), 3) AS w FROM d JOIN h ON d.f = h.f AND d.x0 = h.x0),
        m AS (SELECT f, x0, sum(w) AS w, sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my, sum(w * x * x) / sum(w) AS mxx, sum(w * x * y) / sum(w) AS mxy FROM w GROUP BY f, x0)
        SELECT f AS l_returnflag, x0 AS l_quantity, round(my + (x0 - mx) * (mxy - mx * my) / (mxx - mx * mx), 3) AS trend FROM m""")
    def _(t):
        from rollmill.operators.analysis import lowess

        # the weighting by residuals is left out, as the SQL has none
        series = t.lineitem.groupBy("l_returnflag", F.col("l_quantity").cast("double").alias("l_quantity")).agg(F.avg("l_extendedprice").alias("price"))
        return lowess(series, "l_quantity", "price", "l_returnflag", rounds=0).select("l_returnflag", "l_quantity", F.round("trend", 3).alias("trend"))

    # --- joins
    loss = f"(SELECT uid, avg(final_loss) AS loss FROM forward_export WHERE {FINITE} GROUP BY uid)"
    acc = "(SELECT uid, max(avg_correctness) AS acc, max(num_demo) AS num_demo FROM demos WHERE num_demo > 0 GROUP BY uid)"

    def losses(t):
        return _finite(t).groupBy("uid").agg(F.avg("final_loss").alias("loss"))

    def accs(t):
        return t.demos.where("NOT isnan(avg_correctness)").groupBy("uid").agg(F.max("avg_correctness").alias("acc"), F.max("num_demo").alias("num_demo"))

    @q("equi_join_inner", f"SELECT uid, round(loss, 9) AS loss, acc FROM {loss} JOIN {acc} USING (uid)")
    def _(t):
        return losses(t).join(accs(t), "uid").select("uid", F.round("loss", 9).alias("loss"), "acc")

    @q("equi_join_multiway", "SELECT l_orderkey, l_linenumber, o_custkey, c_mktsegment, n_name, r_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
    def _(t):
        x = t.lineitem.select("l_orderkey", "l_linenumber").join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
        x = x.join(t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "c_nationkey"), "o_custkey")
        x = x.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
        return x.select("l_orderkey", "l_linenumber", "o_custkey", "c_mktsegment", "n_name", "r_name")

    @q("multiway_by_key", f"SELECT uid, round(loss, 9) AS loss, acc FROM {loss} JOIN {acc} USING (uid) JOIN (SELECT DISTINCT uid FROM forward_export) USING (uid)")
    def _(t):
        return J.multiway([losses(t), accs(t), t.forward_export.select("uid").distinct()], "uid").select("uid", F.round("loss", 9).alias("loss"), "acc")

    @q("join_dup_col_reconcile", "SELECT 'o_custkey' AS \"column\", 0::BIGINT AS n_conflicts UNION ALL SELECT 'o_totalprice', count(*) FILTER (WHERE o_orderkey % 10 = 0) FROM orders")
    def _(t):
        a = t.orders.select("o_orderkey", "o_custkey", "o_totalprice")
        b = a.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 10 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
        return J.reconciled(a, b, "o_orderkey")[1]

    @q("lookup_map_join", f"SELECT e.uid, response_id, global_step, acc FROM forward_export e JOIN {acc} USING (uid)")
    def _(t):
        return t.forward_export.select("uid", "response_id", "global_step").join(accs(t).select("uid", "acc"), "uid")

    one = "(SELECT uid, any_value(demos_len) AS demos_len, any_value(correctness) AS correctness FROM demos WHERE demos_len IS NOT NULL GROUP BY uid)"

    @q("lookup_by_length", f"SELECT e.uid, response_id, global_step, CASE WHEN list_position(demos_len, demo_len - 1) > 0 THEN correctness[list_position(demos_len, demo_len - 1)] END AS correct, d.uid IS NOT NULL AS istrain FROM forward_export e LEFT JOIN {one} d USING (uid)")
    def _(t):
        dim = t.demos.where("demos_len IS NOT NULL").groupBy("uid").agg(F.first("demos_len").alias("demos_len"), F.first("correctness").alias("correctness"), F.lit(True).alias("known"))
        x = t.forward_export.select("uid", "response_id", "global_step", "demo_len").join(dim, "uid", "left")
        return x.select("uid", "response_id", "global_step", J.first_by_length(F.col("demos_len"), F.col("correctness"), F.col("demo_len") - 1).alias("correct"), F.coalesce("known", F.lit(False)).alias("istrain"))

    @q("semi_join_list", f"SELECT uid, response_id, global_step FROM forward_export WHERE uid IN (SELECT uid FROM {acc} WHERE acc = 0)")
    def _(t):
        return t.forward_export.select("uid", "response_id", "global_step").join(accs(t).where("acc = 0").select("uid"), "uid", "left_semi")

    @q("key_intersection_join", f"SELECT uid FROM {loss} INTERSECT SELECT uid FROM {acc} ORDER BY uid")
    def _(t):
        return losses(t).select("uid").join(accs(t).select("uid"), "uid").orderBy("uid")

    @q("positional_zip_join", f"SELECT uid, acc, round(loss, 9) AS loss FROM {acc} JOIN {loss} USING (uid)")
    def _(t):
        return accs(t).select("uid", "acc").join(losses(t), "uid").select("uid", "acc", F.round("loss", 9).alias("loss"))

    @q("merge_by_key_extend", "SELECT event_type, first(user_id ORDER BY event_id) AS user_id, array_to_string(list(event_id ORDER BY event_id), ',') AS ids FROM events WHERE event_type <> '' GROUP BY event_type")
    def _(t):
        rows = t.events.select("event_type", "user_id", "event_id", F.array("event_id").alias("ids"))
        return J.extended(rows, "event_type", "ids", "event_id", "user_id").withColumn("ids", F.array_join(F.transform("ids", lambda x: x.cast("string")), ","))

    @q("merge_dedup_answers", "SELECT user_id, event_type AS answer, min(event_id) AS first_id FROM events GROUP BY 1, 2")
    def _(t):
        return J.distinct_answers(t.events.select("user_id", F.col("event_type").alias("answer"), F.col("event_id").alias("first_id")), "user_id", "answer", "first_id")

    @q("sft_vs_demo_delta", f"SELECT uid, round(avg(CASE WHEN global_step >= 1000 THEN final_loss END) - avg(CASE WHEN global_step < 1000 THEN final_loss END), 4) AS delta, max(acc) AS acc FROM forward_export JOIN {acc} USING (uid) WHERE {FINITE} GROUP BY uid")
    def _(t):
        late = F.col("global_step") >= 1000
        d = _finite(t).groupBy("uid").agg(F.round(F.avg(F.when(late, F.col("final_loss"))) - F.avg(F.when(~late, F.col("final_loss"))), 4).alias("delta"))
        return d.join(accs(t).select("uid", "acc"), "uid")

    @q("pivot_step", "SELECT uid, " + ", ".join(f"max(demo_len) FILTER (WHERE global_step = {s}) AS \"{s}\"" for s in STEPS) + " FROM forward_export GROUP BY uid")
    def _(t):
        return J.matrix(t.forward_export, "uid", "global_step", "demo_len", STEPS)

    @q("unpivot_method", f"SELECT uid, 'accuracy' AS method, acc AS value FROM {acc} UNION ALL SELECT uid, 'demos', num_demo::DOUBLE FROM {acc}")
    def _(t):
        return J.long_of(accs(t).withColumn("num_demo", F.col("num_demo").cast("double")), "uid", {"accuracy": "acc", "demos": "num_demo"})

    @q("all_gather", "SELECT n_nationkey, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
    def _(t):
        return t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_nationkey").agg(F.count("*").alias("n"))
