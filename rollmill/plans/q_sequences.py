"""Queries of the token-array columns, over the exported demos and sequences made of them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rollmill.functions import arrays as A
from rollmill.plans.registry import Registry

KEY = ["uid", "response_id", "global_step"]
K = ", ".join(KEY)
#: Ids of a sequence: order quantities by line, in a fixed order.
SEQ = """(SELECT l_orderkey, list(l_partkey % 50 ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) AS ids, list(l_quantity / 10 ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) AS logits FROM lineitem GROUP BY l_orderkey)"""


def _seq(t):
    by = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]
    rows = F.array_sort(F.collect_list(F.struct(*by, "l_quantity")))
    return t.lineitem.groupBy("l_orderkey").agg(rows.alias("r")).select("l_orderkey", F.transform("r", lambda x: x["l_partkey"] % 50).alias("ids"), F.transform("r", lambda x: x["l_quantity"] / 10).alias("logits"))


def _text(array):
    return F.array_join(F.transform(array, lambda x: x.cast("string")), ",")


def register(q: Registry) -> None:
    def seq(name, column, sql, out="ids"):
        """A query of one array column, compared as text."""
        q(name, f"SELECT l_orderkey, array_to_string({sql}, ',') AS {out} FROM {SEQ}")(lambda t: _seq(t).select("l_orderkey", _text(column(F.col("ids"))).alias(out)))

    zeros = lambda n: f"list_resize([]::BIGINT[], greatest({n} - len(ids), 0), 0)"
    seq("pad_sequence", lambda a: A.pad(a, 8), f"ids || {zeros(8)}")
    seq("pad_sequence_left", lambda a: A.pad(a, 8, left=True), f"{zeros(8)} || ids")
    seq("truncate_modes_right", lambda a: A.truncate(a, 3, "right"), "ids[1:3]")
    seq("truncate_modes_left", lambda a: A.truncate(a, 3, "left"), "CASE WHEN len(ids) > 3 THEN ids[len(ids) - 2:] ELSE ids END")
    seq("truncate_modes_middle", lambda a: A.truncate(a, 3, "middle"), "CASE WHEN len(ids) > 3 THEN ids[1:1] || ids[len(ids) - 1:] ELSE ids END")
    seq("attention_mask", lambda a: A.attention_mask(a, 8), f"list_transform(ids, lambda x: 1::BIGINT) || {zeros(8)}")
    seq("response_mask", lambda a: A.response_mask(a, [7, 11, 30]), "list_transform(ids, lambda x, i: CASE WHEN i <= coalesce(list_min(list_filter([list_position(ids, 7), list_position(ids, 11), list_position(ids, 30)], lambda p: p > 0)), 1000) THEN 1 ELSE 0 END)")
    seq("split_response_mask", lambda a: A.last_columns(a, 2), "ids[greatest(len(ids) - 1, 1):]")
    seq("strip_left_pad_ids", lambda a: A.strip_left(F.concat(F.array(F.lit(0).cast("long"), F.lit(0).cast("long")), a), 0), "CASE WHEN len(list_filter(ids, lambda x: x <> 0)) = 0 THEN [] ELSE ids[list_position(list_transform(ids, lambda x: x <> 0), true):] END")
    seq("remove_pad", lambda a: A.remove_left_pad(A.pad(a, 8, left=True), A.attention_mask(a, 8, left=True)), "ids")
    seq("remove_left_padding", lambda a: A.pad(A.remove_left_pad(A.pad(a, 9, left=True), A.attention_mask(a, 9, left=True)), 9), f"ids || {zeros(9)}")
    seq("recover_left_padding", lambda a: A.pad(A.remove_left_pad(A.pad(a, 9, left=True), A.attention_mask(a, 9, left=True)), 9, left=True), f"{zeros(9)} || ids")
    seq("pad_to_multiple_slice", lambda a: F.slice(A.pad(a, F.size(a) + F.pmod(-F.size(a), F.lit(4))), F.expr("1 + (size(ids) + pmod(-size(ids), 4)) div 4"), F.expr("(size(ids) + pmod(-size(ids), 4)) div 4")), f"(ids || list_resize([]::BIGINT[], (4 - len(ids) % 4) % 4, 0))[((len(ids) + 3) // 4) + 1:2 * ((len(ids) + 3) // 4)]")
    seq("position_ids", lambda a: A.position_ids(F.transform(a, lambda x: (x % 3 != 0).cast("int"))), "list_transform(ids, lambda x, i: greatest(list_sum(list_transform(ids[1:i], lambda y: CASE WHEN y % 3 <> 0 THEN 1 ELSE 0 END))::BIGINT - 1, 0))", "positions")
    seq("eos_running_count", lambda a: F.transform(F.transform(a, lambda x: (x == 7).cast("int")), lambda x, i: F.aggregate(F.slice(F.transform(a, lambda y: (y == 7).cast("int")), 1, i), F.lit(0), lambda s, y: s + y)), "list_transform(ids, lambda x, i: coalesce(len(list_filter(ids[1:i - 1], lambda y: y = 7)), 0))", "before")

    @q("pad_2d_ragged", f"SELECT l_orderkey, array_to_string(ids || list_resize([]::BIGINT[], (SELECT greatest(max(len(ids)), 10) FROM {SEQ}) - len(ids), 0), ',') AS ids FROM {SEQ}")
    def _(t):
        rows = _seq(t)
        width = rows.agg(F.greatest(F.max(F.size("ids")), F.lit(10)).alias("width"))
        return rows.crossJoin(F.broadcast(width)).select("l_orderkey", _text(A.pad("ids", F.col("width"))).alias("ids"))

    @q("unpad_data", f"SELECT l_orderkey, len(ids)::BIGINT AS seqlen, sum(len(ids)) OVER (ORDER BY l_orderkey)::BIGINT AS cu_seqlen, max(len(ids)) OVER ()::BIGINT AS max_seqlen FROM {SEQ}")
    def _(t):
        rows = _seq(t).select("l_orderkey", F.size("ids").cast("long").alias("seqlen"))
        return _running(rows)

    @q("pack_sequences", f"SELECT l_orderkey, ((len(ids) + 3) // 4 * 4)::BIGINT AS padded, (sum((len(ids) + 3) // 4 * 4) OVER (ORDER BY l_orderkey) - (len(ids) + 3) // 4 * 4)::BIGINT AS start FROM {SEQ}")
    def _(t):
        rows = _seq(t).select("l_orderkey", (F.ceil(F.size("ids") / 4) * 4).alias("seqlen"))
        return _running(rows).select("l_orderkey", F.col("seqlen").alias("padded"), (F.col("cu_seqlen") - F.col("seqlen")).alias("start"))

    @q("unpack_sequences", "SELECT l_orderkey, count(*) AS n, sum(l_partkey % 50)::BIGINT AS ids FROM lineitem GROUP BY l_orderkey")
    def _(t):
        packed = _seq(t).select("l_orderkey", A.pad("ids", F.expr("cast(ceil(size(ids) / 4) * 4 as int)")).alias("packed"), F.size("ids").alias("n"))
        return packed.select("l_orderkey", F.col("n").cast("long").alias("n"), F.aggregate(F.slice("packed", 1, F.col("n")), F.lit(0).cast("long"), lambda s, x: s + x).alias("ids"))

    z = "(list_max(logits) + ln(list_sum(list_transform(logits, lambda x: exp(x - list_max(logits))))))"
    for name, column, sql in (
        ("gather_label", lambda: F.element_at("logits", F.expr("cast(1 + pmod(l_orderkey, size(logits)) as int)")), "logits[1 + l_orderkey % len(logits)]"),
        ("logprob_from_logits", lambda: A.logprob_of("logits", F.expr("pmod(l_orderkey, size(logits))")), f"logits[1 + l_orderkey % len(logits)] - {z}"),
        ("entropy_logits", lambda: A.entropy_of("logits"), f"{z} - list_sum(list_transform(logits, lambda x: exp(x - {z}) * x))"),
        ("temperature_scale", lambda: A.total(F.transform("logits", lambda x: x / 0.7)), "list_sum(list_transform(logits, lambda x: x / 0.7))"),
        ("response_logprob", lambda: A.total(F.transform(A.last_columns("logits", 2), lambda x: x - A.log_sum_exp("logits"))), f"list_sum(list_transform(logits[greatest(len(logits) - 1, 1):], lambda x: x - {z}))"),
        ("topk_filter_softmax", lambda: F.array_max(A.top_k_softmax("logits", 2)), "exp(0) / list_sum(list_transform(logits, lambda x: CASE WHEN x >= list_reverse_sort(logits)[least(2, len(logits))] THEN exp(x - list_max(logits)) ELSE 0 END))"),
        ("clip_by_value", lambda: A.total(F.transform("logits", lambda x: F.greatest(F.least(x, F.lit(4.0)), F.lit(1.0)))), "list_sum(list_transform(logits, lambda x: greatest(least(x, 4.0), 1.0)))"),
    ):
        q(name, f"SELECT l_orderkey, round({sql}, 5) AS value FROM {SEQ}")(lambda t, column=column: _seq(t).select("l_orderkey", F.round(column(), 5).alias("value")))

    chat = "(SELECT chat_id, ingested_at, unnest(messages).role AS role, unnest(messages).content AS content, generate_subscripts(messages, 1) AS i FROM chats)"
    spaces = "coalesce(len(list_filter(regexp_split_to_array(content, '\\s+'), lambda w: w <> '')), 0)"

    @q("multiturn_loss_mask", f"SELECT chat_id, sum(CASE WHEN role = 'assistant' THEN n ELSE 0 END)::BIGINT AS ones, sum(n)::BIGINT AS n_tokens FROM (SELECT *, {spaces} AS n FROM {chat}) GROUP BY chat_id, ingested_at")
    def _(t):
        n = lambda m: F.coalesce(F.size(F.filter(F.split(m["content"], r"\s+"), lambda w: w != "")), F.lit(0))
        mask = F.flatten(F.transform("messages", lambda m: F.array_repeat((m["role"] == "assistant").cast("int"), n(m))))
        return t.chats.where("size(messages) > 0").select("chat_id", F.aggregate(mask, F.lit(0).cast("long"), lambda s, x: s + x).alias("ones"), F.size(mask).cast("long").alias("n_tokens"))

    @q("sft_loss_mask", f"SELECT {K}, count(*) FILTER (WHERE i >= 4 AND i <> n AND m = 1) AS ones FROM (SELECT {K}, logged_at, ingested_at, unnest(loss_mask) AS m, generate_subscripts(loss_mask, 1) AS i, len(loss_mask) AS n FROM forward_export) GROUP BY {K}, ingested_at")
    def _(t):
        # prompt of 4 tokens: its first 3 and the last valid token don't count
        mask = F.transform("loss_mask", lambda x, i: F.when((i >= 3) & (i != F.size("loss_mask") - 1), x).otherwise(0))
        return t.forward_export.select(*KEY, A.total(mask).cast("long").alias("ones"))

    @q("rm_pair_pad", f"SELECT l_orderkey, array_to_string(ids[1:4] || list_resize([]::BIGINT[], greatest(4 - len(ids), 0), 0), ',') AS chosen, array_to_string(list_reverse(ids)[1:4] || list_resize([]::BIGINT[], greatest(4 - len(ids), 0), 0), ',') AS rejected FROM {SEQ}")
    def _(t):
        fit = lambda a: A.pad(A.truncate(a, 4), 4)
        return _seq(t).select("l_orderkey", _text(fit(F.col("ids"))).alias("chosen"), _text(fit(F.reverse("ids"))).alias("rejected"))

    ratio = "((global_step % 11) / 10.0)"
    prefix = f"CASE WHEN {ratio} = 0 OR len(token_log_p) = 0 THEN 0 ELSE least(greatest(floor({ratio} * len(token_log_p))::INTEGER, 2), len(token_log_p) - 1) END"

    @q("prefix_of_demo", f"SELECT {K}, ({prefix})::INTEGER AS prefix_len FROM forward_export")
    def _(t):
        return t.forward_export.select(*KEY, A.prefix_length(F.size("token_log_p"), F.col("global_step") % 11 / 10.0, 2).alias("prefix_len"))

    @q("prefix_relpos", f"SELECT {K}, round(p * (p + 1) / 2.0 / greatest(demo_len, 1) - greatest(len(token_log_p) - p, 0), 4) AS s FROM (SELECT *, {prefix} AS p FROM forward_export)")
    def _(t):
        p = A.prefix_length(F.size("token_log_p"), F.col("global_step") % 11 / 10.0, 2)
        places = F.transform("token_log_p", lambda x, i: F.when(i < p, (i + 1) / F.greatest("demo_len", F.lit(1))).otherwise(-1.0))
        return t.forward_export.select(*KEY, F.round(A.total(places), 4).alias("s"))

    @q("regroup_prefix_response", f"SELECT l_orderkey, array_to_string(ids[1:len(ids) - k], ',') AS prompt, array_to_string(ids[len(ids) - k + 1:], ',') AS response FROM (SELECT *, least(len(ids), 2) AS k FROM {SEQ})")
    def _(t):
        k = F.least(F.size("ids"), F.lit(2))
        return _seq(t).select("l_orderkey", _text(F.slice("ids", F.lit(1), F.size("ids") - k)).alias("prompt"), _text(A.last_columns("ids", k)).alias("response"))

    @q("expand_to_token_level", f"SELECT {K}, len(loss)::BIGINT AS n, final_loss AS last FROM forward_export WHERE final_loss IS NOT NULL AND NOT isnan(final_loss) AND isfinite(final_loss) AND len(loss) > 0")
    def _(t):
        own = t.forward_export.where("final_loss IS NOT NULL AND NOT isnan(final_loss) AND abs(final_loss) < double('infinity') AND size(loss) > 0")
        spread = A.scatter_last(F.size("loss"), F.size("loss") - 1, F.col("final_loss"))
        return own.select(*KEY, F.size(spread).cast("long").alias("n"), F.element_at(spread, -1).alias("last"))

    @q("reward_scatter", f"SELECT {K}, CASE WHEN sum > 0 THEN 1 ELSE 0 END::BIGINT AS placed FROM (SELECT *, coalesce(list_sum(loss_mask), 0) AS sum FROM forward_export)")
    def _(t):
        n = A.total("loss_mask").cast("int")
        spread = A.scatter_last(F.size("loss_mask"), n - 1, F.lit(1.0))
        return t.forward_export.select(*KEY, A.total(spread).cast("long").alias("placed"))

    @q("assemble_multiturn", f"SELECT l_orderkey, array_to_string(list_resize([]::BIGINT[], greatest(4 - len(p), 0), 0) || p || r || list_resize([]::BIGINT[], greatest(12 - len(r), 0), 0), ',') AS ids FROM (SELECT l_orderkey, ids[1:2] AS p, ids[3:] AS r FROM {SEQ})")
    def _(t):
        return _seq(t).select("l_orderkey", _text(F.concat(A.pad(F.slice("ids", 1, 2), 4, left=True), A.pad(F.slice("ids", 3, 100), 12))).alias("ids"))

    @q("random_mask")
    def _(t):
        valid = F.pmod(F.xxhash64("l_orderkey"), F.size("ids")) + 1
        return _seq(t).select("l_orderkey", F.transform("ids", lambda x, i: (i < valid).cast("int")).alias("mask"))

    by = "PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate"
    line = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate"

    @q("lead_with_default", f"SELECT {line}, lead(l_quantity, 1, 0) OVER ({by}) AS next FROM lineitem")
    def _(t):
        w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
        return t.lineitem.select(*line.split(", "), F.lead("l_quantity", 1, 0.0).over(w).alias("next"))


def _running(rows):
    """Running sums over all sequences in the order of their keys: sums by blocks of keys are accumulated, then added within."""
    blocks = rows.withColumn("block", F.expr("l_orderkey div 1000"))
    sums = blocks.groupBy("block").agg(F.sum("seqlen").alias("s"), F.max("seqlen").alias("m"))
    before = sums.select("block", (F.sum("s").over(Window.orderBy("block")) - F.col("s")).alias("before"), F.max("m").over(Window.partitionBy()).alias("max_seqlen"))
    inside = F.sum("seqlen").over(Window.partitionBy("block").orderBy("l_orderkey"))
    return blocks.join(before, "block").select("l_orderkey", "seqlen", (F.col("before") + inside).alias("cu_seqlen"), "max_seqlen")
