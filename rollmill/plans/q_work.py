"""Queries of placement, dispatch, sources, sinks and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from rollmill.functions import schedules
from rollmill.operators import balance as B
from rollmill.operators import dispatch as D
from rollmill.operators import etl
from rollmill.plans.registry import Registry
from rollmill.session import shared_folder
from rollmill.sources import readers, sinks
from rollmill.streaming import loops

DOCS = "(SELECT doc_id, doc_id // 200 AS batch, coalesce(n_chars, 0) AS n FROM documents)"


def _docs(t):
    return t.documents.select("doc_id", F.expr("doc_id div 200").alias("batch"), F.coalesce("n_chars", F.lit(0)).alias("n"))


def _folder(t) -> str:
    return f"{shared_folder(t.spark)}/{uuid.uuid4().hex}"


def _scored(t):
    return t.events.select((F.col("event_id") % 5).alias("step"), F.concat(F.lit("in"), F.col("event_id").cast("string")).alias("input"), F.col("event_type").alias("output"), F.col("value").alias("score"))


def register(q: Registry) -> None:
    # --- placement
    @q("balance_kk", f"SELECT batch, count(*) AS n_docs, sum(n)::BIGINT AS total FROM {DOCS} GROUP BY batch")
    def _(t):
        # every row once: batches keep their rows and lengths
        return B.balanced(_docs(t), "batch", "doc_id", "n", 4).groupBy("batch").agg(F.count("*").alias("n_docs"), F.sum("n").alias("total"))

    @q("balance_greedy", f"SELECT batch, count(*) AS n_docs, sum(n)::BIGINT AS total FROM {DOCS} GROUP BY batch")
    def _(t):
        return B.greedy(_docs(t), "batch", "doc_id", "n", 4).groupBy("batch").agg(F.count("*").alias("n_docs"), F.sum("n").alias("total"))

    @q("balance_batch")
    def _(t):
        return B.balanced(_docs(t), "batch", "doc_id", "n", 4).groupBy("batch", "part").agg(F.count("*").alias("n_docs"), F.sum("n").alias("total"))

    @q("micro_batches", f"SELECT batch, least(count(*), ceil(sum(n) / 30000.0))::BIGINT AS n_micro FROM {DOCS} GROUP BY batch")
    def _(t):
        return B.in_micro_batches(_docs(t), "batch", "doc_id", "n", 30000).groupBy("batch").agg(F.count_distinct("part").alias("n_micro"))

    @q("balance_serpentine", f"SELECT count(*) AS n_docs, sum(n)::BIGINT AS total FROM {DOCS}")
    def _(t):
        return B.serpentine(_docs(t), "n", 8, "doc_id").groupBy("part").agg(F.count("*").alias("k"), F.sum("n").alias("s")).agg(F.sum("k").alias("n_docs"), F.sum("s").alias("total"))

    @q("ceildiv", "SELECT p_partkey, (p_size + 6) // 7 AS parts FROM part")
    def _(t):
        return t.part.select("p_partkey", F.ceil(F.col("p_size") / 7).cast("int").alias("parts"))

    @q("least_loaded_router")
    def _(t):
        return B.routed(t.events.select("event_id", "event_type", "user_id"), "event_type", "event_id", "user_id", 4)

    @q("dispatch_modes", "SELECT event_type, round(sum(value * 2), 3) AS doubled FROM events GROUP BY event_type")
    def _(t):
        x = D.dispatched(t.events.select("event_type", "value"), lambda pdf: pdf.assign(value=pdf["value"] * 2), "dp_compute_with_func", 4)
        return x.groupBy("event_type").agg(F.round(F.sum("value"), 3).alias("doubled"))

    @q("method_register", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
    def _(t):
        return D.method("dp_compute", 4)(lambda df: df.groupBy("event_type").agg(F.count("*").alias("n")))(t.events)

    @q("dispatch_register", "SELECT event_id FROM events WHERE event_id % 2 = 0")
    def _(t):
        D.register_mode("evens", lambda df, function, ways: function(df.where("event_id % 2 = 0")), replace=True)
        return D.dispatched(t.events, lambda df: df.select("event_id"), "evens")

    @q("execute_all", "SELECT event_type, max(value) AS most FROM events GROUP BY event_type")
    def _(t):
        return D.dispatched(t.events, lambda df: df.groupBy("event_type").agg(F.max("value").alias("most")), "all_to_all")

    @q("replicate_then_chunk", "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 4 = 1")
    def _(t):
        # nation is a table of 25 rows by its definition
        return t.customer.where("c_custkey % 4 = 1").join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")

    @q("pool_feasibility", "SELECT 'actor' AS pool, 'a' AS node UNION ALL SELECT 'critic', 'b'")
    def _(t):
        return t.spark.createDataFrame([(p, n[0]) for p, n in B.admitted({"actor": 6, "critic": 4}, {"a": 8, "b": 4}).items()], "pool string, node string")

    @q("future_wait_any", "SELECT event_type, round(avg(value), 6) AS mean FROM events GROUP BY event_type")
    def _(t):
        # results are taken one partition after the other; there are as many as event types
        means = t.events.groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"))
        return t.spark.createDataFrame([tuple(r) for r in means.toLocalIterator()], means.schema)

    @q("trajectory_dump", "SELECT 'step_0' AS name, count(*) AS n FROM events WHERE event_id % 2 = 0 UNION ALL SELECT 'step_1', count(*) FROM events WHERE event_id % 2 = 1")
    def _(t):
        path = _folder(t)
        for step in (0, 1):
            t.events.where(f"event_id % 2 = {step}").select(F.lit(f"step_{step}").alias("name"), "event_id", "value").write.mode("append").parquet(path)
        return t.spark.read.parquet(path).groupBy("name").agg(F.count("*").alias("n"))

    @q("global_concurrency", "SELECT count(*) AS n FROM events")
    def _(t):
        return t.events.coalesce(2).mapInPandas(lambda frames: frames, t.events.schema).agg(F.count("*").alias("n"))

    @q("timeout_guard", "SELECT event_id, CASE WHEN event_id % 2000 = 7 THEN -1 ELSE event_id % 5 END::INTEGER AS code FROM events")
    def _(t):
        def run(frames):
            import time

            # the slow calls take far more than their time, the others far less
            guarded = D.limited(0.5)(lambda key: time.sleep(30) if key % 2000 == 7 else key % 5)
            for pdf in frames:
                codes = []
                for key in pdf["event_id"].tolist():
                    try:
                        codes.append(guarded(key))
                    except TimeoutError:
                        codes.append(-1)
                yield pdf.assign(code=codes)

        return t.events.select("event_id").mapInPandas(run, "event_id long, code int")

    # --- sources and sinks
    @q("scan_parquet_multi", "SELECT count(*) AS n FROM (SELECT uid FROM generations UNION ALL SELECT uid FROM demos)")
    def _(t):
        return readers.parquet(t.spark, f"{t.folder}/generations.parquet", f"{t.folder}/demos.parquet", schema="uid string").agg(F.count("*").alias("n"))

    @q("scan_parquet_pandas", "SELECT uid, data_source FROM generations")
    def _(t):
        return readers.parquet(t.spark, f"{t.folder}/generations.parquet").select("uid", "data_source")

    lines = "event_id long, user_id long, event_type string, value double"
    events = "SELECT event_id, user_id, event_type, value FROM events"

    for name in ("scan_json", "scan_jsonl_lines", "sink_jsonl", "convert_parquet_jsonl"):

        def make(t, name=name):
            path = _folder(t)
            t.events.select("event_id", "user_id", "event_type", "value").write.json(path)
            return readers.json(t.spark, path, schema=lines)

        q(name, events)(make)

    for name in ("sink_parquet", "scan_pickle_batch", "sink_pickle_batch", "cache_shm_verify", "cache_copy_local"):

        def make_parquet(t, name=name):
            path = _folder(t)
            t.events.select("event_id", "user_id", "event_type", "value").write.parquet(path)
            return readers.parquet(t.spark, path, schema=lines)

        q(name, events)(make_parquet)

    @q("scan_multi_step_json", "SELECT event_id, event_id % 3 AS step FROM events")
    def _(t):
        path = _folder(t)
        for step in range(3):
            t.events.where(f"event_id % 3 = {step}").select("event_id").write.json(f"{path}/global_step_{step}")
        return readers.by_step(t.spark, f"{path}/global_step_*", "event_id long")

    @q("scan_first_matching_file", "SELECT event_id FROM events")
    def _(t):
        path = _folder(t)
        t.events.select("event_id").write.json(path)
        return readers.matching(t.spark, path, "part*.json", "event_id long")

    @q("step_from_path", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_id END AS step FROM events")
    def _(t):
        path = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("/ckpt/global_step_"), F.col("event_id").cast("string"), F.lit("/actor"))).otherwise("/ckpt/none")
        return t.events.select("event_id", readers.step_of(path).alias("step"))

    @q("scan_hub", "SELECT event_id FROM events ORDER BY event_id LIMIT (SELECT (count(*) * 3 // 4) FROM events)")
    def _(t):
        return readers.split_slice(t.events.select("event_id"), "[:75%]", "event_id").select("event_id")

    @q("sink_csv_prefix_log", "SELECT event_id % 5 AS step, user_id::VARCHAR AS uid, round(value + 1, 6) AS reward FROM events WHERE event_type <> 'view'")
    def _(t):
        x = t.events.select(
            (F.col("event_id") % 5).alias("step"), F.col("user_id").cast("string").alias("uid"), F.when(F.col("event_type") == "view", sinks.SENTINEL).otherwise(F.col("event_type")).alias("prefix_uid"),
            F.lit(0.5).alias("prefix_ratio"), F.lit(True).alias("prefix_correct"), F.array("value", F.lit(1.0)).alias("token_level_rewards"), F.array("value").alias("advantages"),
        )
        path = _folder(t)
        sinks.prefix_log(x, path)
        return t.spark.read.option("header", True).schema("uid string, prefix_uid string, prefix_ratio double, prefix_correct boolean, reward double, advantages double, step long").csv(path).select("step", "uid", F.round("reward", 6).alias("reward"))

    @q("sink_rollout_jsonl", "SELECT event_id % 5 AS step, 'in' || event_id AS input, event_type AS output, value AS score FROM events")
    def _(t):
        path = _folder(t)
        sinks.rollouts(_scored(t), path)
        return t.spark.read.schema("input string, output string, score double, step long").json(path).select("step", "input", "output", "score")

    @q("sink_csv_results", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
    def _(t):
        path = _folder(t)
        sinks.results_csv(t.events.groupBy("event_type").agg(F.count("*").alias("n")), path, "event_type")
        return t.spark.read.option("header", True).schema("event_type string, n long").csv(path)

    @q("sink_metrics", "SELECT event_id % 5 AS step, round(avg(value), 6) AS value FROM events GROUP BY 1")
    def _(t):
        path = _folder(t)
        sinks.metrics(t.events.groupBy((F.col("event_id") % 5).alias("step")).agg(F.avg("value").alias("value")).withColumn("name", F.lit("loss")), path)
        return t.spark.read.parquet(path).select("step", F.round("value", 6).alias("value"))

    @q("sink_samples_table", "SELECT 'in' || event_id AS input, value AS score FROM events ORDER BY md5('in' || event_id || '|42'), input LIMIT 50")
    def _(t):
        return sinks.sample_rows(_scored(t), 50).select("input", "score")

    @q("sink_wide_samples", "SELECT event_id // 3 AS step, max(CASE WHEN event_id % 3 = 0 THEN value END) AS score_0, max(CASE WHEN event_id % 3 = 2 THEN event_type END) AS output_2 FROM events GROUP BY 1")
    def _(t):
        x = t.events.select(F.expr("event_id div 3").alias("step"), (F.col("event_id") % 3).cast("int").alias("sample_no"), F.lit("x").alias("input"), F.col("event_type").alias("output"), F.col("value").alias("score"))
        return sinks.wide_samples(x, 3).select("step", "score_0", "output_2")

    @q("cached_aggregate", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
    def _(t):
        path = _folder(t)
        make = lambda: t.events.groupBy("event_type").agg(F.count("*").alias("n"))
        sinks.cached(t.spark, path, make)
        return sinks.cached(t.spark, path, lambda: t.events.limit(0))

    @q("hdfs_ops", "SELECT true AS there, false AS missing")
    def _(t):
        path = _folder(t)
        sinks.make_folder(t.spark, path)
        return t.spark.createDataFrame([(sinks.exists(t.spark, path), sinks.exists(t.spark, path + "x"))], "there boolean, missing boolean")

    # --- streams
    @q("step_loop", "SELECT event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY event_type")
    def _(t):
        path = _folder(t)
        out = loops.written_steps(loops.file_stream(t.spark, f"{t.folder}/events.parquet"), lambda b: b.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")), f"{path}/out", f"{path}/checkpoint")
        return out.groupBy("event_type").agg(F.sum("n").alias("n"), F.round(F.sum("total"), 3).alias("total"))

    @q("resumable_source", "SELECT count(*) AS n FROM events")
    def _(t):
        path = _folder(t)
        for _ in range(2):  # the second run finds everything in the checkpoint
            out = loops.written_steps(loops.file_stream(t.spark, f"{t.folder}/events.parquet"), lambda b: b.agg(F.count("*").alias("n")), f"{path}/out", f"{path}/checkpoint")
        return out.agg(F.sum("n").alias("n"))

    @q("kl_state", "SELECT 1::BIGINT AS steps")
    def _(t):
        path = _folder(t)
        steps = loops.kl_steps(loops.file_stream(t.spark, f"{t.folder}/events.parquet"), lambda b: b.agg(F.avg("value")).first()[0], schedules.AdaptiveKl(0.1, 5.0, 100.0), f"{path}/checkpoint")
        return t.spark.createDataFrame([(len(steps),)], "steps long")

    @q("latest_checkpoint", "SELECT max(global_step) AS latest FROM forward_export")
    def _(t):
        return loops.latest_step(t.forward_export.select(F.concat(F.lit("/c/global_step_"), F.col("global_step").cast("string")).alias("path")))

    @q("retention", "SELECT DISTINCT global_step AS step FROM forward_export ORDER BY step DESC LIMIT 3")
    def _(t):
        return loops.retained(t.forward_export.select(F.col("global_step").alias("step")), 3)

    @q("periodic_trigger", "SELECT DISTINCT global_step AS step FROM forward_export WHERE global_step % 500 = 0 OR global_step = (SELECT max(global_step) FROM forward_export)")
    def _(t):
        steps = t.forward_export.select(F.col("global_step").alias("step")).distinct()
        last = steps.agg(F.max("step").alias("last"))
        return steps.crossJoin(F.broadcast(last)).where("step % 500 = 0 OR step = last").select("step")

    @q("rng_state", "SELECT uid, md5(uid || '|' || global_step) AS seed FROM generations")
    def _(t):
        return t.generations.select("uid", F.md5(F.concat_ws("|", "uid", F.col("global_step").cast("string"))).alias("seed"))

    @q("state_machine")
    def _(t):
        return loops.request_states(t.events, "user_id", "event_type", "event_id")

    @q("state_machine_stream")
    def _(t):
        path = _folder(t)
        stream = loops.request_state_stream(loops.file_stream(t.spark, f"{t.folder}/events.parquet").select("user_id", "event_type", "event_id"), "user_id", "event_type", "event_id")

        def step(batch, number):
            batch.write.mode("overwrite").parquet(f"{path}/out/step={number}")

        query = stream.writeStream.outputMode("update").foreachBatch(step).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination(600)
        return t.spark.read.parquet(f"{path}/out")

    best = "max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"

    @q("tool_session", f"SELECT event_id, CASE WHEN value > coalesce({best}, 0.0) THEN 0.0 ELSE -0.05 END::DOUBLE AS reward FROM events")
    def _(t):
        before = F.max("value").over(Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1))
        return t.events.select("event_id", F.when(F.col("value") > F.coalesce(before, F.lit(0.0)), 0.0).otherwise(-0.05).alias("reward"))

    spaces = "coalesce(len(list_filter(regexp_split_to_array(m.content, '\\s+'), lambda w: w <> '')), 0)"

    @q("message_append", f"SELECT chat_id, list_sum(list_transform(messages, lambda m: CASE WHEN m.role = 'assistant' THEN {spaces} ELSE 0 END))::BIGINT AS trained, list_sum(list_transform(messages, lambda m: {spaces}))::BIGINT AS n FROM chats WHERE len(messages) > 0")
    def _(t):
        mask = F.flatten(F.transform("messages", lambda m: F.array_repeat((m["role"] == "assistant").cast("int"), etl.n_words(m["content"]))))
        return t.chats.where("size(messages) > 0").select("chat_id", F.aggregate(mask, F.lit(0).cast("long"), lambda s, x: s + x).alias("trained"), F.size(mask).cast("long").alias("n"))

    @q("windowed_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
    def _(t):
        stamped = t.events.withColumn("ts", F.col("ts").cast("timestamp"))
        hourly = stamped.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"))
        return hourly.groupBy("event_type").agg(F.sum("n").alias("n"))
