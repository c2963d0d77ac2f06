"""Queries of table building, filters, reshaping and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollmill.operators import etl as E
from rollmill.plans.registry import Registry

WORDS = "coalesce(len(list_filter(regexp_split_to_array({}, '\\s+'), lambda w: w <> '')), 0)"
CHAT = "array_to_string(list_transform({m}, lambda m: '<|im_start|>' || m.role || chr(10) || coalesce(m.content, '') || '<|im_end|>' || chr(10)), '')"
TRUTH = "regexp_extract(extra_info.answer, '#### (-?[0-9.,]+)', 1)"


def register(q: Registry) -> None:
    prompt = CHAT.format(m="prompt") + " || '<|im_start|>assistant' || chr(10)"

    @q("filter_overlong", f"SELECT uid, data_source FROM demos WHERE {WORDS.format(prompt)} <= 90")
    def _(t):
        return E.filter_overlong(t.demos, "prompt", 90).select("uid", "data_source")

    @q("filter_has_demo", "SELECT uid FROM demos WHERE len(demos) > 0")
    def _(t):
        return E.filter_has_items(t.demos, "demos").select("uid")

    @q("filter_demo_len", "SELECT uid FROM demos WHERE demos_len IS NULL OR coalesce(list_max(demos_len), 0) <= 90")
    def _(t):
        return t.demos.select("uid", F.coalesce("demos_len", F.array().cast("array<int>")).alias("demos_len")).transform(lambda d: E.filter_no_long_item(d, "demos_len", 90)).select("uid")

    kept = "list_filter(list_zip(demos_len, correctness), lambda x: x[1] < 60)"

    @q("filter_array_elements", f"SELECT uid, len(k)::INTEGER AS num_demo, round(CASE WHEN len(k) = 0 THEN -1 ELSE list_avg(list_transform(k, lambda x: x[2])) END, 6) AS avg_correctness FROM (SELECT uid, {kept} AS k FROM demos WHERE demos_len IS NOT NULL)")
    def _(t):
        return E.keep_short_items(t.demos.where("demos_len IS NOT NULL"), "demos", "demos_len", "correctness", 60).select("uid", "num_demo", F.round("avg_correctness", 6).alias("avg_correctness"))

    @q("keep_correct_elements", "SELECT uid, len(list_filter(list_zip(demos, correctness), lambda x: x[2] > 0)) AS n FROM demos")
    def _(t):
        return t.demos.select("uid", F.size(E.keep_correct("demos", "correctness")).cast("long").alias("n"))

    @q("first_correct_element", "SELECT uid, demos[list_position(list_transform(correctness, lambda x: x > 0), true)] AS demo, len(demos) AS n_old FROM demos WHERE list_position(list_transform(correctness, lambda x: x > 0), true) > 0")
    def _(t):
        return E.first_correct(t.demos, "demos", "correctness").select("uid", F.col("demos")[0].alias("demo"), F.size("old_demos").cast("long").alias("n_old"))

    @q("filter_nonempty_label", "SELECT doc_id FROM documents WHERE length(lang) > 0")
    def _(t):
        return t.documents.where(F.length("lang") > 0).select("doc_id")

    @q("filter_parseable_gold", f"SELECT uid FROM generations WHERE {TRUTH} <> ''")
    def _(t):
        return t.generations.where(F.regexp_extract("extra_info.answer", r"#### (-?[0-9.,]+)", 1) != "").select("uid")

    draw = "CAST('0x' || substr(md5(uid || '|3'), 1, 8) AS BIGINT) / 4294967296.0"

    @q("random_mask_column", f"SELECT uid, CASE WHEN {draw} < 0.7 THEN len(demos) ELSE 0 END AS n_demos FROM demos")
    def _(t):
        masked = E.split_by_share(t.demos, 0.7, 3, "uid").withColumn("demos", F.when(F.col("part") == "train", F.col("demos")).otherwise(F.array().cast("array<string>")))
        return masked.select("uid", F.size("demos").cast("long").alias("n_demos"))

    @q("add_uid", "SELECT doc_id, md5(concat_ws('|', doc_id, source)) AS uid FROM documents")
    def _(t):
        return t.documents.select("doc_id", F.md5(F.concat_ws("|", F.col("doc_id").cast("string"), "source")).alias("uid"))

    @q("build_rl_record", f"SELECT 'grade_math' AS data_source, 'math' AS ability, extra_info.question || ' Think.' AS content, {TRUTH} AS ground_truth, extra_info.index AS index FROM generations")
    def _(t):
        x = t.generations.select(*E.rl_record("grade_math", F.col("extra_info.question"), F.col("extra_info.answer"), F.regexp_extract("extra_info.answer", r"#### (-?[0-9.,]+)", 1), "math", F.lit("train"), F.col("extra_info.index"), " Think."))
        return x.select("data_source", "ability", F.col("prompt")[0]["content"].alias("content"), F.col("reward_model.ground_truth").alias("ground_truth"), F.col("extra_info.index").alias("index"))

    @q("build_tool_record", f"SELECT 'system' AS first_role, 2::INTEGER AS n_messages, {TRUTH} AS tool_truth FROM generations")
    def _(t):
        x = t.generations.select(*E.tool_record("grade_math", F.col("extra_info.question"), F.col("extra_info.answer"), F.regexp_extract("extra_info.answer", r"#### (-?[0-9.,]+)", 1), "calc", "You may use a tool."))
        return x.select(F.col("prompt")[0]["role"].alias("first_role"), F.size("prompt").alias("n_messages"), F.col("extra_info.tools_kwargs")["calc"]["create_kwargs"]["ground_truth"].alias("tool_truth"))

    text = "replace(regexp_replace(replace(trim(p_name || ' [title] x [step] y', ' '), ' [title]', '. '), '\\[.*?\\]', '', 'g'), '  ', ' ')"

    @q("build_choice_record", f"SELECT p_partkey, {text} AS query, p_size::INTEGER AS label FROM part")
    def _(t):
        return t.part.select("p_partkey", E.clean_choice_text(F.concat("p_name", F.lit(" [title] x [step] y"))).alias("query"), F.col("p_size").cast("int").alias("label"))

    @q("text_clean", f"SELECT p_partkey, {text} AS text FROM part")
    def _(t):
        return t.part.select("p_partkey", E.clean_choice_text(F.concat("p_name", F.lit(" [title] x [step] y"))).alias("text"))

    correct = f"list_filter(responses, lambda r: regexp_extract(r, '#### (-?[0-9.,]+)', 1) <> '')"

    @q("build_demo_record", f"SELECT uid, len({correct}) AS n_demos FROM generations WHERE len({correct}) > 0")
    def _(t):
        good = F.filter("responses", lambda r: F.regexp_extract(r, r"#### (-?[0-9.,]+)", 1) != "")
        return t.generations.withColumn("demos", good).transform(lambda d: E.filter_has_items(d, "demos")).select("uid", F.size("demos").cast("long").alias("n_demos"))

    @q("build_demo_record_oat", f"SELECT uid, len(list_filter({correct}, lambda r: {WORDS.format('r')} <= 60)) AS n_demos FROM generations WHERE responses IS NOT NULL")
    def _(t):
        good = F.filter("responses", lambda r: (F.regexp_extract(r, r"#### (-?[0-9.,]+)", 1) != "") & (E.n_words(r) <= 60))
        return t.generations.where("responses IS NOT NULL").select("uid", F.size(good).cast("long").alias("n_demos"))

    @q("target_to_demos", "SELECT uid, prompt[-1].content AS demo, 1::INTEGER AS n FROM demos")
    def _(t):
        target = F.slice("prompt", -1, 1)
        checked = F.when(F.size(target) == 1, F.transform(target, lambda m: m["content"])).otherwise(F.raise_error(F.lit("one target message is needed")).cast("array<string>"))
        return t.demos.where("size(prompt) > 0").select("uid", checked.alias("demos")).select("uid", F.col("demos")[0].alias("demo"), F.size("demos").alias("n"))

    @q("think_prefix", "SELECT uid, '<think>' || chr(10) || problem AS completion FROM demos")
    def _(t):
        return t.demos.select("uid", F.array(F.concat(F.lit("<think>\n"), "problem"))[0].alias("completion"))

    @q("chat_template", f"SELECT chat_id, md5({CHAT.format(m='messages')}) AS text FROM chats WHERE messages IS NOT NULL")
    def _(t):
        return t.chats.where("messages IS NOT NULL").select("chat_id", F.md5(E.chat_text("messages")).alias("text"))

    @q("multimodal_segments", "SELECT p_partkey, 'text,image,text' AS types FROM part")
    def _(t):
        return t.part.select("p_partkey", F.array_join(F.transform(E.segments(F.concat("p_name", F.lit(" <image> "), "p_type")), lambda s: s["type"]), ",").alias("types"))

    @q("demo_choice", "SELECT uid, CASE WHEN len(demos) > 0 THEN demos[CAST(CAST('0x' || substr(md5(uid || '|0'), 1, 8) AS BIGINT) % len(demos) AS INTEGER) + 1] END AS demo FROM demos")
    def _(t):
        return t.demos.select("uid", E.chosen_item("demos", F.col("uid"), F.lit("0")).alias("demo"))

    @q("transpose_samples", "SELECT l_orderkey, array_to_string(list(l_quantity::INTEGER ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate), ',') AS responses FROM lineitem GROUP BY l_orderkey")
    def _(t):
        rows = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", F.col("l_quantity").cast("int").alias("x"))))
        return t.lineitem.groupBy("l_orderkey").agg(rows.alias("r")).select("l_orderkey", F.array_join(F.transform("r", lambda x: x["x"].cast("string")), ",").alias("responses"))

    @q("finite_len_filter", "SELECT uid, response_id, global_step, len(token_entropy) AS n FROM forward_export WHERE len(token_entropy) < 60")
    def _(t):
        return t.forward_export.where("token_entropy IS NOT NULL AND size(token_entropy) < 60").select("uid", "response_id", "global_step", F.size("token_entropy").cast("long").alias("n"))

    @q("build_benchmark_union", "SELECT 'eval' AS data_source, item_id::VARCHAR AS key, extra_info.question AS question FROM eval_items UNION ALL SELECT 'demos', uid, problem FROM demos UNION ALL SELECT 'rollouts', uid, extra_info.question FROM generations")
    def _(t):
        parts = (("eval", t.eval_items, F.col("item_id").cast("string"), F.col("extra_info.question")), ("demos", t.demos, F.col("uid"), F.col("problem")), ("rollouts", t.generations, F.col("uid"), F.col("extra_info.question")))
        out = None
        for name, df, key, question in parts:
            own = df.select(F.lit(name).alias("data_source"), key.alias("key"), question.alias("question"))
            out = own if out is None else out.unionByName(own)
        return out

    @q("prompt_rewrite", "SELECT uid, 'Be brief.' AS system, prompt[-1].content || ' Box it.' AS content FROM demos")
    def _(t):
        x = t.demos.select("uid", E.rewritten_prompt("Be brief.", F.element_at("prompt", -1)["content"], " Box it.").alias("p"))
        return x.select("uid", F.col("p")[0]["content"].alias("system"), F.col("p")[1]["content"].alias("content"))

    @q("prompt_template", "SELECT uid, replace('Q: {{prompt}} A:', '{{prompt}}', problem) AS text FROM demos")
    def _(t):
        return t.demos.select("uid", F.replace(F.lit("Q: {{prompt}} A:"), F.lit("{{prompt}}"), F.col("problem")).alias("text"))

    @q("select_columns", "SELECT uid, ability FROM generations")
    def _(t):
        return t.generations.select("uid", "ability")

    @q("remove_columns", "SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM orders")
    def _(t):
        return t.orders.drop("o_orderdate", "o_orderpriority")

    @q("nested_field_extract", "SELECT uid, extra_info.answer AS answer, reward_model.ground_truth AS truth FROM generations")
    def _(t):
        return t.generations.select("uid", F.col("extra_info.answer").alias("answer"), F.col("reward_model.ground_truth").alias("truth"))

    @q("sft_pairs_two_per_row", "SELECT uid, unnest([responses[1], responses[2]]) AS response FROM generations WHERE len(responses) >= 2")
    def _(t):
        return t.generations.where("size(responses) >= 2").select("uid", F.explode(F.array(F.col("responses")[0], F.col("responses")[1])).alias("response"))

    @q("rm_pairs", "SELECT uid, prompt[-1].content AS prompt, responses[1] AS chosen, responses[2] AS rejected FROM generations WHERE len(responses) >= 2")
    def _(t):
        return t.generations.where("size(responses) >= 2").select("uid", F.element_at("prompt", -1)["content"].alias("prompt"), F.col("responses")[0].alias("chosen"), F.col("responses")[1].alias("rejected"))

    @q("explode_demos", "SELECT uid, (generate_subscripts(demos, 1) - 1)::VARCHAR AS response_id, unnest(demos) AS demo FROM demos")
    def _(t):
        return t.demos.select("uid", F.posexplode("demos").alias("pos", "demo")).select("uid", F.col("pos").cast("string").alias("response_id"), "demo")

    @q("explode_dropna", "SELECT uid, e AS entropy FROM (SELECT uid, unnest(token_entropy) AS e FROM forward_export) WHERE e IS NOT NULL")
    def _(t):
        return t.forward_export.select("uid", F.explode("token_entropy").alias("entropy")).dropna()

    @q("suffix_unpivot", "SELECT o_orderkey, 0 AS prefix_no, o_custkey AS id, o_totalprice AS value FROM orders UNION ALL SELECT o_orderkey, 1, o_orderkey, o_totalprice / 2 FROM orders")
    def _(t):
        wide = t.orders.select("o_orderkey", F.col("o_custkey").alias("id_0"), F.col("o_totalprice").alias("value_0"), F.col("o_orderkey").alias("id_1"), (F.col("o_totalprice") / 2).alias("value_1"))
        return E.suffixed_rows(wide, ["o_orderkey"], [{"id_0": "id", "value_0": "value"}, {"id_1": "id", "value_1": "value"}])

    @q("head_limit", "SELECT doc_id FROM documents ORDER BY md5(doc_id::VARCHAR || '|5'), doc_id LIMIT 100")
    def _(t):
        return E.head(t.documents.select(F.col("doc_id").cast("string").alias("doc_id")), 100, 5, "doc_id").select(F.col("doc_id").cast("long").alias("doc_id"))

    @q("random_split", f"SELECT uid, CASE WHEN {draw.replace('|3', '|9')} < 0.8 THEN 'train' ELSE 'test' END AS part FROM generations")
    def _(t):
        return E.split_by_share(t.generations.select("uid"), 0.8, 9, "uid")

    @q("stratified_equal_sample", "SELECT ability, uid FROM (SELECT DISTINCT ability, uid FROM generations WHERE ability IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY ability ORDER BY md5(uid || '|4'), uid) <= 20")
    def _(t):
        return E.stratified(t.generations.where("ability IS NOT NULL").select("ability", "uid").distinct(), "ability", 20, 4, "uid")

    @q("cross_enumeration", "SELECT a.range AS first, b.range AS step, c.range AS n FROM range(1, 8) a, range(1, 6) b, range(1, 5) c")
    def _(t):
        return t.spark.range(1, 8).select(F.col("id").alias("first"), F.explode(F.sequence(F.lit(1), F.lit(5))).alias("step")).select("first", F.col("step").cast("long").alias("step"), F.explode(F.sequence(F.lit(1), F.lit(4))).alias("n")).withColumn("n", F.col("n").cast("long"))

    @q("collate", "SELECT user_id % 4 AS batch, count(*) AS n, array_to_string(list(event_id ORDER BY event_id), ',') AS ids FROM events GROUP BY 1")
    def _(t):
        rows = F.array_sort(F.collect_list("event_id"))
        return t.events.groupBy((F.col("user_id") % 4).alias("batch")).agg(F.count("*").alias("n"), F.array_join(F.transform(rows, lambda x: x.cast("string")), ",").alias("ids"))

    @q("list_dict_transpose", "SELECT uid, num_demo, list_sum(correctness) AS total FROM demos WHERE num_demo > 0")
    def _(t):
        pairs = F.transform(F.arrays_zip("demos", "correctness"), lambda x: x["correctness"])
        return t.demos.where("num_demo > 0").select("uid", "num_demo", F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x).alias("total"))

    @q("from_dict", "SELECT * FROM (VALUES (0::BIGINT, 1::INTEGER, 'a'), (1, 2, 'b'), (2, 3, 'c')) v(pos, obs, labels)")
    def _(t):
        return t.spark.createDataFrame([(0, 1, "a"), (1, 2, "b"), (2, 3, "c")], "pos long, obs int, labels string")
