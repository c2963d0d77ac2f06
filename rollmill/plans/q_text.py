"""Queries of answer extraction, text scores, rewards, JSON and maps, over responses and demos."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rollmill.functions import text as T
from rollmill.functions import text_udf as U
from rollmill.operators import rewards as R
from rollmill.plans.registry import Registry

RESP = "(SELECT uid, i, r, truth FROM (SELECT uid, ingested_at, generate_subscripts(responses, 1) - 1 AS i, unnest(responses) AS r, reward_model.ground_truth AS truth FROM generations) WHERE r IS NOT NULL)"
STRICT = "replace(nullif(regexp_extract(r, '#### (-?[0-9.,]+)', 1), ''), ',', '')"
FOUND = "regexp_extract_all(r, '(-?[0-9.,]+)', 1)"
GOOD = f"list_filter({FOUND}, lambda x: x <> '.')"
FLEX = f"CASE WHEN len({GOOD}) > 0 THEN {GOOD}[-1] ELSE {FOUND}[1] END"
BOX = r"regexp_extract_all(r, '\\(?:boxed|fbox)\{([^{}]*)\}', 1)[-1]"
WORDS = "list_filter(regexp_split_to_array(lower(r), '\\s+'), lambda w: w <> '')"


def same(answer: str) -> str:
    """SQL of equality with the truth: as text, or as numbers within 1e-4, also times or over 100."""
    a, b = (f"TRY_CAST(replace({x}, ',', '') AS DOUBLE)" for x in (f"({answer})", "truth"))
    near = lambda x: f"abs({a} - {x}) <= 1e-4 * greatest(abs({a}), abs({x}))"
    return f"coalesce(({answer}) = truth OR {near(b)} OR {near(b + ' / 100')} OR {near(b + ' * 100')}, false)"


def _resp(t):
    x = t.generations.select("uid", F.posexplode("responses").alias("i", "r"), F.col("reward_model.ground_truth").alias("truth"))
    return x.where("r IS NOT NULL")


def register(q: Registry) -> None:
    def score(name, column, sql, alias="score"):
        q(name, f"SELECT uid, i::INTEGER AS i, {sql} AS {alias} FROM {RESP}")(lambda t: _resp(t).select("uid", "i", column().alias(alias)))

    class Fields:
        """Columns are made when a query runs, as they need a session."""

        def __getattr__(self, name):
            return F.col(name)

    c = Fields()
    score("gsm8k_extract_strict", lambda: T.number_strict(c.r), STRICT, "answer")
    score("gsm8k_extract_flexible", lambda: T.number_flexible(c.r), FLEX, "answer")
    score("gsm8k_score", lambda: T.graded(T.number_strict(c.r), c.truth, 1.0, 0.1), f"CASE WHEN {STRICT} IS NULL THEN 0.0 WHEN {STRICT} = truth THEN 1.0 ELSE 0.1 END::DOUBLE")
    score("gsm8k_score_flexible", lambda: T.graded(T.number_flexible(c.r), c.truth), f"CASE WHEN ({FLEX}) IS NULL THEN 0.0 WHEN ({FLEX}) = truth THEN 1.0 ELSE 0.0 END::DOUBLE")
    score("last_boxed", lambda: U.last_boxed(c.r), r"regexp_extract_all(r, '(\\(?:boxed|fbox)\{[^{}]*\})', 1)[-1]", "box")
    score("remove_boxed", lambda: U.boxed_answer(c.r), BOX, "answer")
    score("simple_boxed", lambda: T.simple_boxed(c.r), BOX, "answer")
    score("strict_box_correct", lambda: F.when(U.boxed_answer(F.right(c.r, F.lit(100))) == c.truth, 1).otherwise(-1), r"CASE WHEN regexp_extract_all(right(r, 100), '\\boxed\{([^{}]*)\}', 1)[-1] = truth THEN 1 ELSE -1 END::INTEGER")
    minerva = "coalesce(regexp_extract_all({}, '(?i)Answer\\s*:\\s*([^\\n]+)', 1)[-1], '[INVALID]')"
    score("minerva_correct", lambda: T.minerva_answer(c.r), minerva.format("r"), "answer")
    # the answers of this data are plain numbers, of which only thousands separators go
    plain = "CASE WHEN regexp_matches(replace({0}, ',', ''), '^[0-9]+$') THEN replace({0}, ',', '') ELSE {0} END"
    score("normalize_minerva", lambda: T.normal_answer(T.number_flexible(c.r)), plain.format(f"({FLEX})"), "answer")
    tail = plain.format(minerva.format("right(r, 300)"))
    score("dapo_score", lambda: T.dapo_score(c.r, c.truth)["score"], f"CASE WHEN {tail} = truth THEN 1.0 ELSE -1.0 END::DOUBLE")
    score("is_equiv", lambda: F.coalesce(U.latex_form(T.simple_boxed(c.r)).eqNullSafe(c.truth), F.lit(False)), f"{BOX} IS NOT DISTINCT FROM truth", "same")
    score("strip_string", lambda: U.latex_form(F.concat(F.lit("\\dfrac12 + "), T.number_strict(c.r))), f"'\\frac{{1}}{{2}}+' || {STRICT}", "form")
    score("prime_math_grade", lambda: F.coalesce(T.same_number(T.number_strict(c.r), c.truth), F.lit(False)), f"coalesce(least(abs(a - b) - 1e-4 * greatest(abs(a), abs(b)), abs(a - b / 100) - 1e-4 * greatest(abs(a), abs(b / 100)), abs(a - b * 100) - 1e-4 * greatest(abs(a), abs(b * 100))) <= 0, false)".replace("abs(a", "abs(TRY_CAST(" + STRICT + " AS DOUBLE)").replace("- b", "- TRY_CAST(replace(truth, ',', '') AS DOUBLE)").replace("abs(b", "abs(TRY_CAST(replace(truth, ',', '') AS DOUBLE)"), "same")
    score("answers_equal", lambda: U.answers_equal(T.simple_boxed(c.r), c.truth), f"CASE WHEN {BOX} IS NULL OR truth IS NULL THEN {BOX} IS NULL AND truth IS NULL ELSE {same(BOX)} END", "same")
    score("code_extract", lambda: T.code_block(c.r), "coalesce(regexp_extract_all(r, '(?s)```python\\n(.*?)```', 1)[-1], '')", "code")
    score("code_format_reward", lambda: T.code_format(c.r), "0.0::DOUBLE")
    score("tag_count", lambda: T.tag_count(F.concat(F.lit("<think>\n"), c.r, F.lit("\n</think>\n"))), "(CASE WHEN len(x) - len(replace(x, '<think>' || chr(10), '')) = 8 THEN 0.25 ELSE 0 END + CASE WHEN len(x) - len(replace(x, chr(10) || '</think>' || chr(10), '')) = 10 THEN 0.25 ELSE 0 END)::DOUBLE".replace("x,", "('<think>' || chr(10) || r || chr(10) || '</think>' || chr(10)),").replace("len(x)", "len('<think>' || chr(10) || r || chr(10) || '</think>' || chr(10))"))
    score("format_reward", lambda: T.think_format(F.concat(F.lit("<think>\nx\n</think>\n<answer>\n"), c.r, F.lit("\n</answer>"))), "1.0::DOUBLE")
    score("reasoning_steps", lambda: T.reasoning_steps(c.r), "least(1.0, len(regexp_extract_all(r, '(Step \\d+:|^\\d+\\.|\\n-|\\n\\*|First,|Second,|Next,|Finally,)')) / 3.0)::DOUBLE")
    score("reflection_count", lambda: T.reflection_count(F.lower(c.r)), "(len(regexp_extract_all(lower(r), 'wait,')) + len(regexp_extract_all(lower(r), 'recheck[,\\s]')) + len(regexp_extract_all(lower(r), 'retry')) + len(regexp_extract_all(lower(r), 'alternatively,')) + len(regexp_extract_all(lower(r), 'however,')))::INTEGER", "n")
    grams = f"list_transform(range(1, greatest(len({WORDS}), 2)), lambda i: array_to_string({WORDS}[i:i + 1], ' '))"
    score("ngram_repeat_penalty", lambda: F.round(T.ngram_penalty(c.r, 2, -1.0), 6) + 0.0, f"round(CASE WHEN len({WORDS}) < 2 THEN 0 ELSE (1 - len(list_distinct({grams})) / len({grams})::DOUBLE) * -1 END, 6) + 0.0::DOUBLE")
    score("after_think", lambda: T.after_think(F.concat(F.lit("<think>a</think>"), c.r)), "trim(r, ' ' || chr(9) || chr(10) || chr(13))", "answer")
    score("after_think_reward", lambda: F.when(T.number_strict(T.after_think(F.concat(F.lit("<think>a</think> "), c.r))) == c.truth, 1.0).otherwise(0.0), f"CASE WHEN {STRICT} = truth THEN 1.0 ELSE 0.0 END::DOUBLE")
    score("assistant_span", lambda: T.assistant_span(F.concat(F.lit("<|a|>x<|e|><|a|>"), c.r, F.lit("<|e|>")), "<|a|>", "<|e|>"), "r", "answer")
    score("geo3k_score", lambda: F.round(0.9 * F.when(T.simple_boxed(c.r) == c.truth, 1.0).otherwise(0.0) + 0.1 * T.think_boxed_format(F.concat(F.lit("<think></think>"), c.r)), 6), rf"round(0.9 * CASE WHEN {BOX} = truth THEN 1 ELSE 0 END + 0.1 * CASE WHEN regexp_matches(r, '(?s)\\boxed\{{.*\}}') THEN 1 ELSE 0 END, 6)::DOUBLE")
    score("step_switch_extract", lambda: F.when(F.length(c.r) >= 300, T.after_think(c.r)).otherwise(c.r), "CASE WHEN length(r) >= 300 THEN trim(regexp_extract(r, '(?s)<think>.*?</think>(.*)', 1), ' ' || chr(9) || chr(10) || chr(13)) ELSE r END", "answer")
    score("format_3level", lambda: T.three_level(c.r.contains("####"), F.coalesce(T.number_strict(c.r) == c.truth, F.lit(False))), f"CASE WHEN NOT contains(r, '####') THEN -1.0 WHEN coalesce({STRICT} = truth, false) THEN 1.0 ELSE 0.0 END::DOUBLE")
    score("eval_datapoint_3level", lambda: T.three_level(T.simple_boxed(c.r).isNotNull(), F.coalesce(T.simple_boxed(c.r) == c.truth, F.lit(False)), -1.0, -0.5, 1.0), f"CASE WHEN {BOX} IS NULL THEN -1.0 WHEN {BOX} = truth THEN 1.0 ELSE -0.5 END::DOUBLE")
    score("format_and_correct", lambda: F.concat_ws("|", c.r.contains("\\boxed").cast("string"), F.coalesce(T.simple_boxed(c.r) == c.truth, F.lit(False)).cast("string"), F.coalesce(T.simple_boxed(c.r), F.lit("-"))), rf"contains(r, '\boxed')::VARCHAR || '|' || coalesce({BOX} = truth, false)::VARCHAR || '|' || coalesce({BOX}, '-')", "parts")
    score("accuracy_reward_verify", lambda: F.when(c.truth.isNull() | (c.truth == ""), 1.0).when(F.coalesce(T.number_flexible(c.r), F.lit("")) == c.truth, 1.0).otherwise(0.0), f"CASE WHEN truth IS NULL OR truth = '' THEN 1.0 WHEN coalesce({FLEX}, '') = truth THEN 1.0 ELSE 0.0 END::DOUBLE")
    score("boxed_oat_grade", lambda: F.when(U.answers_equal(U.boxed_answer(c.r), c.truth), 1.0).otherwise(0.0), f"CASE WHEN {BOX} = truth OR least(abs(TRY_CAST(replace({BOX}, ',', '') AS DOUBLE) - TRY_CAST(replace(truth, ',', '') AS DOUBLE)) - 1e-4 * greatest(abs(TRY_CAST(replace({BOX}, ',', '') AS DOUBLE)), abs(TRY_CAST(replace(truth, ',', '') AS DOUBLE))), abs(TRY_CAST(replace({BOX}, ',', '') AS DOUBLE) * 100 - TRY_CAST(replace(truth, ',', '') AS DOUBLE)) - 1e-4 * greatest(abs(TRY_CAST(replace({BOX}, ',', '') AS DOUBLE)) * 100, abs(TRY_CAST(replace(truth, ',', '') AS DOUBLE))), abs(TRY_CAST(replace({BOX}, ',', '') AS DOUBLE) / 100 - TRY_CAST(replace(truth, ',', '') AS DOUBLE)) - 1e-4 * greatest(abs(TRY_CAST(replace({BOX}, ',', '') AS DOUBLE)) / 100, abs(TRY_CAST(replace(truth, ',', '') AS DOUBLE)))) <= 0 THEN 1.0 ELSE 0.0 END::DOUBLE")
    boxed_or_marked = f"CASE WHEN coalesce({BOX}, {STRICT}) = truth THEN 1.0 ELSE 0.0 END::DOUBLE"
    for name, reward in (("luffy_reward", "luffy"), ("math_verify_score", "math_verify")):
        score(name, lambda reward=reward: R.scorer(reward)(c.r, c.truth), boxed_or_marked)
    # boxed rewards take no "####" number
    score("openr1_rewards", lambda: R.scorer("openr1")(c.r, c.truth), f"CASE WHEN {same(BOX)} THEN 1.0 ELSE 0.0 END::DOUBLE")
    tag = "replace(string_split(r, '<answer>')[-1], '</answer>', '')"
    tag_box = BOX.replace("(r,", f"({tag},")
    tagged = f"CASE WHEN contains({tag}, '\\boxed') THEN {tag_box} ELSE trim({tag}, ' ' || chr(9) || chr(10) || chr(13)) END"
    score("dr_grpo_rewards", lambda: R.scorer("dr_grpo_answer_tag_orz")(c.r, c.truth), f"CASE WHEN contains(r, '<answer>') AND contains(r, '</answer>') AND {same(tagged)} THEN 1.0 ELSE 0.0 END::DOUBLE")
    batch = lambda responses, truths: [float(t is not None and U.boxed_reward(r, t)) for r, t in zip(responses, truths)]
    score("batch_score", lambda: R.by_batch(batch, c.r, c.truth), f"CASE WHEN {same(BOX)} THEN 1.0 ELSE 0.0 END::DOUBLE")
    score("match_answer", lambda: F.coalesce(F.nullif(F.regexp_extract(F.lower(c.r), r"answer:\s*(\S*\d\S*)", 1), F.lit("")), T.simple_boxed(c.r)), f"coalesce(nullif(regexp_extract(lower(r), 'answer:\\s*(\\S*\\d\\S*)', 1), ''), {BOX})", "answer")

    @q("repeatness")
    def _(t):
        return _resp(t).select("uid", "i", F.round(U.repeatness("r"), 6).alias("share"))

    @q("gold_from_answer", "SELECT uid, replace(regexp_extract(extra_info.answer, '#### (-?[0-9.,]+)', 1), ',', '') AS gold FROM generations WHERE regexp_extract(extra_info.answer, '#### (-?[0-9.,]+)', 1) <> ''")
    def _(t):
        return t.generations.select("uid", T.number_strict(F.col("extra_info.answer")).alias("gold")).where("gold IS NOT NULL")

    @q("score_dispatch", f"SELECT uid, i::INTEGER AS i, CASE WHEN src = 'mathword_8k' THEN CASE WHEN {STRICT} IS NULL THEN 0.0 WHEN {STRICT} = truth THEN 1.0 ELSE 0.0 END WHEN {BOX} = truth THEN 1.0 ELSE 0.0 END::DOUBLE AS score FROM (SELECT uid, data_source AS src, generate_subscripts(responses, 1) - 1 AS i, unnest(responses) AS r, reward_model.ground_truth AS truth FROM generations) WHERE r IS NOT NULL")
    def _(t):
        x = t.generations.select("uid", "data_source", F.posexplode("responses").alias("i", "r"), F.col("reward_model.ground_truth").alias("truth")).where("r IS NOT NULL")
        return x.select("uid", "i", F.when(F.col("data_source") == "mathword_8k", T.graded(T.number_strict(F.col("r")), F.col("truth"))).otherwise(F.when(T.simple_boxed(F.col("r")) == F.col("truth"), 1.0).otherwise(0.0)).alias("score"))

    @q("len_reward", f"WITH x AS (SELECT uid, i, length(r) AS n, coalesce({STRICT} = truth, false) AS ok, min(length(r)) OVER (PARTITION BY uid) AS lo, max(length(r)) OVER (PARTITION BY uid) AS hi FROM {RESP}) SELECT uid, i::INTEGER AS i, round(CASE WHEN hi = lo THEN 0 WHEN ok THEN 0.5 - (n - lo) / (hi - lo)::DOUBLE ELSE least(0, 0.5 - (n - lo) / (hi - lo)::DOUBLE) END, 6) AS score FROM x")
    def _(t):
        w = Window.partitionBy("uid")
        n = F.length("r")
        return _resp(t).select("uid", "i", F.round(T.length_reward(n, F.coalesce(T.number_strict(F.col("r")) == F.col("truth"), F.lit(False)), F.min(n).over(w), F.max(n).over(w)), 6).alias("score"))

    score("cosine_reward", lambda: F.round(T.cosine_reward(F.length(c.r), F.coalesce(T.number_strict(c.r) == c.truth, F.lit(False)), 2000), 6), f"round(CASE WHEN coalesce({STRICT} = truth, false) THEN 0.5 + 0.25 * (1 + cos(length(r) / 2000.0 * pi())) ELSE -0.5 - 0.25 * (1 + cos(length(r) / 2000.0 * pi())) END, 6)")
    score("rm_dapo", lambda: F.round(T.overlong_penalty(F.length(c.r), 500, 200, 1.0), 6), "round(least(-(length(r) - 300) / 200.0, 0), 6)::DOUBLE")
    score("rm_naive", lambda: T.graded(T.number_strict(c.r), c.truth), f"CASE WHEN {STRICT} = truth THEN 1.0 ELSE 0.0 END::DOUBLE")
    score("rm_prefix", lambda: F.when(F.length(c.r) >= 400, T.graded(T.number_strict(T.after_think(c.r)), c.truth)).otherwise(T.graded(T.number_strict(c.r), c.truth)), f"CASE WHEN length(r) >= 400 THEN CASE WHEN replace(regexp_extract(regexp_extract(r, '(?s)<think>.*?</think>(.*)', 1), '#### (-?[0-9.,]+)', 1), ',', '') = truth THEN 1.0 ELSE 0.0 END WHEN {STRICT} = truth THEN 1.0 ELSE 0.0 END::DOUBLE")
    score("rm_batch", lambda: F.when(U.answers_equal(T.number_flexible(c.r), c.truth), 1.0).otherwise(0.0), f"CASE WHEN {same(FLEX)} THEN 1.0 ELSE 0.0 END::DOUBLE")

    def rows(t):
        return t.generations.select("uid", F.posexplode("responses").alias("i", "r"), F.col("reward_model.ground_truth").alias("truth")).where("r IS NOT NULL")

    @q("rm_loader", f"SELECT uid, i::INTEGER AS i, CASE WHEN {STRICT} = truth THEN 1.0 ELSE 0.0 END::DOUBLE AS score FROM {RESP}")
    def _(t):
        return R.with_rewards(rows(t), "gsm8k", "r", "truth").select("uid", "i", "score")

    @q("rm_prime", f"SELECT uid, i::INTEGER AS i, CASE WHEN length(r) % 5 = 0 THEN 0.0 ELSE length(r) END::DOUBLE AS score FROM {RESP}")
    def _(t):
        def score_of(response, truth):
            if len(response) % 5 == 0:
                raise ValueError("can't be graded")
            return len(response)

        return rows(t).select("uid", "i", R.by_row(score_of, F.col("r"), F.col("truth"), seconds=20.0).alias("score"))

    @q("rm_async", f"SELECT uid, i::INTEGER AS i, length(r)::INTEGER AS n, CASE WHEN {BOX} = truth THEN 1.0 ELSE 0.0 END::DOUBLE AS score FROM {RESP}")
    def _(t):
        # a score of its own plan, joined when it is needed; repeated rows have one
        keyed = rows(t).dropDuplicates(["uid", "i"])
        scores = R.with_rewards(keyed, "boxed", "r", "truth").select("uid", "i", "score")
        return rows(t).join(scores, ["uid", "i"]).select("uid", "i", F.length("r").alias("n"), "score")

    @q("custom_reward", f"SELECT uid, i::INTEGER AS i, (length(r) * 2)::DOUBLE AS score FROM {RESP}")
    def _(t):
        return rows(t).select("uid", "i", R.by_batch(lambda responses, truths: [2 * len(x) for x in responses], F.col("r"), F.col("truth")).alias("score"))

    @q("rm_passthrough", "SELECT uid, avg_correctness AS rm_scores FROM demos WHERE num_demo > 0")
    def _(t):
        x = t.demos.where("num_demo > 0").withColumn("rm_scores", F.col("avg_correctness"))
        return x.select("uid", "rm_scores") if "rm_scores" in x.columns else x.select("uid", F.lit(0.0).alias("rm_scores"))

    @q("rm_error_fallback", "SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) / nullif(user_id % 5, 0), 0.0) AS score FROM events")
    def _(t):
        return t.events.select("event_id", F.coalesce(F.try_divide(F.get_json_object("props", "$.k").try_cast("double"), F.col("user_id") % 5), F.lit(0.0)).alias("score"))

    @q("code_tests_score", "SELECT l_orderkey, round(len(list_filter(x[1:10], lambda v: v = 1)) / len(x[1:10])::DOUBLE, 6) AS rate FROM (SELECT l_orderkey, list(CASE WHEN l_quantity > 25 THEN 1 WHEN l_quantity > 5 THEN 0 ELSE -2 END ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) AS x FROM lineitem GROUP BY 1)")
    def _(t):
        rows = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", F.expr("CASE WHEN l_quantity > 25 THEN 1 WHEN l_quantity > 5 THEN 0 ELSE -2 END").alias("v"))))
        return t.lineitem.groupBy("l_orderkey").agg(rows.alias("x")).select("l_orderkey", F.round(T.pass_rate(F.transform("x", lambda v: v["v"]), 10), 6).alias("rate"))

    @q("sandbox_status", "SELECT event_id, CASE WHEN event_type = 'error' THEN -1 WHEN user_id % 7 = 0 THEN -4 WHEN user_id % 7 = 1 THEN -3 WHEN user_id % 7 = 2 THEN -2 WHEN value > 10 THEN 1 ELSE 0 END::INTEGER AS code FROM events")
    def _(t):
        k = F.col("user_id") % 7
        code = T.sandbox_code(F.col("event_type") != "error", F.when(k == 0, "Error").otherwise("Finished"), F.when(k == 1, "TimeLimitExceeded").otherwise("Finished"), F.when(k == 2, 1).otherwise(0), F.when(F.col("value") > 10, " a\n b ").otherwise("c"), F.lit("a\nb"))
        return t.events.select("event_id", code.alias("code"))

    @q("output_compare", "SELECT doc_id, doc_id % 3 <> 0 AS same FROM documents WHERE text IS NOT NULL")
    def _(t):
        # blanks at the end are no difference, a letter is one
        other = F.concat(F.col("text"), F.when(F.col("doc_id") % 3 == 0, F.lit("x")).otherwise(F.lit("  ")))
        return t.documents.where("text IS NOT NULL").select("doc_id", T.lines_equal(other, F.col("text")).alias("same"))

    @q("log_line_parse", "SELECT event_id, value AS reward FROM events")
    def _(t):
        line = F.concat(F.lit("step:1 - reward:"), F.col("value").cast("string"), F.lit(" - x:2"))
        return t.events.select("event_id", T.log_values(line)["reward"].alias("reward"))

    @q("running_best_parse", "SELECT max(value) AS best FROM events")
    def _(t):
        lines = t.events.select(F.concat(F.lit("step:1 - test_score/reward:"), F.col("value").cast("string")).alias("line"))
        return lines.agg(F.max(F.regexp_extract("line", r"test_score/reward:(-?[\d.]+)", 1).cast("double")).alias("best"))

    @q("digits_sequence", "SELECT p_partkey, (p_size + p_partkey % 7) % 10 AS second, (p_size + 2 * (p_partkey % 7)) % 10 AS third FROM part")
    def _(t):
        seq = F.transform(F.sequence(F.lit(1), F.lit(2)), lambda i: (F.col("p_size") + i * (F.col("p_partkey") % 7)) % 10)
        return t.part.select("p_partkey", seq[0].alias("second"), seq[1].alias("third"))


    @q("tfidf_cosine_corpus", """WITH tok AS (SELECT uid AS id, side, unnest(regexp_extract_all(lower(t), '[a-z0-9]{2,}')) AS w FROM (SELECT uid, 0 AS side, any_value(problem) AS t FROM demos GROUP BY uid UNION ALL SELECT uid, 1, any_value(demos[1]) FROM demos WHERE len(demos) > 0 GROUP BY uid)),
        tf AS (SELECT id, side, w, count(*) AS tf FROM tok GROUP BY ALL), n AS (SELECT count(*) AS n FROM (SELECT DISTINCT id, side FROM tok)), df AS (SELECT w, count(*) AS df FROM tf GROUP BY w),
        x AS (SELECT id, side, w, tf * (ln((1 + n) / (1.0 + df)) + 1) AS v FROM tf JOIN df USING (w), n), norm AS (SELECT id, side, sqrt(sum(v * v)) AS z FROM x GROUP BY id, side)
        SELECT a.id AS uid, round(sum(a.v * b.v) / max(p.z) / max(r.z), 6) AS cosine FROM x a JOIN x b ON a.id = b.id AND a.w = b.w AND a.side = 0 AND b.side = 1 JOIN norm p ON p.id = a.id AND p.side = 0 JOIN norm r ON r.id = a.id AND r.side = 1 GROUP BY a.id""".replace("GROUP BY ALL", "GROUP BY id, side, w"))
    def _(t):
        from rollmill.operators.analysis import tfidf_cosine

        left = t.demos.groupBy("uid").agg(F.max("problem").alias("text"))
        right = t.demos.where("size(demos) > 0").groupBy("uid").agg(F.max(F.col("demos")[0]).alias("text"))
        return tfidf_cosine(left, right, "uid").select("uid", F.round("cosine", 6).alias("cosine"))

    @q("tfidf_cosine_pair")
    def _(t):
        from rollmill.operators.analysis import tfidf_pair

        return t.demos.where("size(demos) >= 2").select("uid", F.round(tfidf_pair(F.col("demos")[0], F.col("demos")[1]), 6).alias("cosine"))

    # --- JSON, maps
    @q("json_parse_tests", "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
    def _(t):
        return t.events.select("event_id", F.from_json("props", "k int", {"mode": "PERMISSIVE"})["k"].alias("k"))

    @q("json_toolcall", "SELECT event_id, event_id % 3 = 0 AS failed FROM events")
    def _(t):
        arguments = F.when(F.col("event_id") % 3 == 0, "[1, 2]").otherwise(F.col("props"))
        return t.events.select("event_id", F.from_json(arguments, "map<string,string>").isNull().alias("failed"))

    @q("map_merge_strict", "SELECT event_id, 2::INTEGER AS n FROM events")
    def _(t):
        merged = F.map_concat(F.create_map(F.lit("user"), F.col("user_id").cast("string")), F.create_map(F.lit("type"), F.col("event_type")))
        return t.events.select("event_id", F.size(merged).alias("n"))

    @q("flatten_config", "SELECT 'actor.lr' AS key, '0.1' AS value UNION ALL SELECT 'actor.ppo.clip', '0.2' UNION ALL SELECT 'seed', '1'")
    def _(t):
        from rollmill.sources.readers import flattened

        return t.spark.createDataFrame([(k, str(v)) for k, v in flattened({"actor": {"lr": 0.1, "ppo": {"clip": 0.2}}, "seed": 1}).items()], "key string, value string")

    @q("md5_key", "SELECT c_custkey, md5(c_name) AS key FROM customer")
    def _(t):
        return t.customer.select("c_custkey", F.md5("c_name").alias("key"))
