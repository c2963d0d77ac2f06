"""Queries of the positional batch algebra, over orders in the order of their keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollmill.operators import batch as B
from rollmill.plans.registry import Registry

ORDERS = "(SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, o_orderkey, o_custkey, o_totalprice FROM orders)"


def _orders(t):
    return B.positioned(t.orders.select("o_orderkey", "o_custkey", "o_totalprice"), "o_orderkey")


def register(q: Registry) -> None:
    @q("add_row_index", f"SELECT pos, o_orderkey FROM {ORDERS}")
    def _(t):
        return _orders(t).select("pos", "o_orderkey")

    @q("proto_select", f"SELECT pos, o_custkey FROM {ORDERS}")
    def _(t):
        return B.select(_orders(t), "o_custkey")

    @q("proto_pop", f"SELECT pos, o_orderkey, o_totalprice FROM {ORDERS}")
    def _(t):
        return B.pop(_orders(t), "o_custkey")[1]

    @q("proto_rename", f"SELECT pos, o_orderkey AS uid, o_custkey AS prompt_uid, o_totalprice FROM {ORDERS}")
    def _(t):
        return B.rename(_orders(t), ["o_orderkey", "o_custkey"], ["uid", "prompt_uid"])

    @q(
        "proto_select_idxs",
        f"""WITH o AS {ORDERS}, want AS (SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate) - 1 AS out_pos, (l_partkey % 700) - 100 AS idx FROM lineitem)
        SELECT out_pos AS pos, o_orderkey, o_custkey, o_totalprice FROM want JOIN o ON o.pos = CASE WHEN idx < 0 THEN idx + (SELECT count(*) FROM orders) ELSE idx END""",
    )
    def _(t):
        wanted = B.positioned(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", name="out_pos")
        return B.take(_orders(t), wanted.select((F.col("l_partkey") % 700 - 100).alias("idx"), "out_pos"))

    @q("proto_mask", f"SELECT row_number() OVER (ORDER BY pos) - 1 AS pos, o_orderkey, o_custkey, o_totalprice FROM {ORDERS} WHERE o_custkey % 3 = 0")
    def _(t):
        return B.take_where(_orders(t), F.col("o_custkey") % 3 == 0)

    @q("proto_slice", f"SELECT (pos - 10) // 7 AS pos, o_orderkey, o_custkey, o_totalprice FROM {ORDERS} WHERE pos >= 10 AND pos < (SELECT count(*) FROM orders) - 5 AND (pos - 10) % 7 = 0")
    def _(t):
        return B.slice_rows(_orders(t), 10, -5, 7)

    @q("proto_slice_backwards", f"SELECT ((SELECT count(*) FROM orders) - 1 - pos) // 3 AS pos, o_orderkey, o_custkey, o_totalprice FROM {ORDERS} WHERE ((SELECT count(*) FROM orders) - 1 - pos) % 3 = 0")
    def _(t):
        return B.slice_rows(_orders(t), None, None, -3)

    @q("proto_getitem", f"SELECT 0 AS pos, o_orderkey, o_custkey, o_totalprice FROM {ORDERS} WHERE pos = 42")
    def _(t):
        return B.slice_rows(_orders(t), 42, 43).withColumn("pos", F.col("pos").cast("int"))

    @q("proto_reorder", f"SELECT (SELECT count(*) FROM orders) - 1 - pos AS pos, o_orderkey, o_custkey, o_totalprice FROM {ORDERS}")
    def _(t):
        orders = _orders(t)
        return B.reorder(orders, orders.select((F.lit(orders.count() - 1) - F.col("pos")).alias("new_pos"), "pos"))

    @q("random_permute_inverse", f"SELECT pos, o_orderkey FROM {ORDERS}")
    def _(t):
        orders = B.select(_orders(t), "o_orderkey")
        there = B.shuffled(orders, 7)
        return B.reorder(B.reorder(orders, there), B.inverse(there)).select("pos", "o_orderkey")

    @q("random_permute")
    def _(t):
        return B.shuffled(_orders(t), 7, "o_orderkey")

    @q("reverse_index", f"WITH p AS (SELECT pos AS new_pos, (SELECT count(*) FROM orders) - 1 - pos AS pos FROM {ORDERS}) SELECT pos AS new_pos, new_pos AS pos FROM p")
    def _(t):
        orders = _orders(t)
        return B.inverse(orders.select(F.col("pos").alias("new_pos"), (F.lit(orders.count() - 1) - F.col("pos")).alias("pos")))

    @q("proto_repeat", f"SELECT pos * 3 + k AS pos, o_orderkey, o_custkey, o_totalprice FROM {ORDERS}, (SELECT unnest([0, 1, 2]) AS k)")
    def _(t):
        return B.repeat(_orders(t), 3)

    @q("proto_repeat_tile", f"SELECT k * (SELECT count(*) FROM orders) + pos AS pos, o_orderkey, o_custkey, o_totalprice FROM {ORDERS}, (SELECT unnest([0, 1, 2]) AS k)")
    def _(t):
        return B.repeat(_orders(t), 3, interleave=False)

    @q("proto_fold", f"SELECT pos // (SELECT count(*) // 10 FROM orders) AS pos, count(*) AS n_items, sum(o_custkey)::BIGINT AS custkeys, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key FROM {ORDERS} GROUP BY 1")
    def _(t):
        folded = B.fold(_orders(t), 10)
        return folded.select("pos", F.size("items").cast("long").alias("n_items"), F.aggregate("items", F.lit(0).cast("long"), lambda s, x: s + x["o_custkey"]).alias("custkeys"), F.col("items")[0]["o_orderkey"].alias("first_key"), F.element_at("items", -1)["o_orderkey"].alias("last_key"))

    @q("proto_unfold", f"SELECT pos, o_orderkey, o_custkey, o_totalprice FROM {ORDERS}")
    def _(t):
        return B.unfold(B.fold(_orders(t), 30))

    @q("proto_chunk", f"SELECT pos, o_orderkey, pos // (SELECT count(*) // 5 FROM orders) AS chunk FROM {ORDERS}")
    def _(t):
        return B.chunk(_orders(t), 5).select("pos", "o_orderkey", "chunk")

    @q("split_batches", f"SELECT pos, o_orderkey, pos // 50 AS chunk FROM {ORDERS}")
    def _(t):
        return B.split(_orders(t), 50).select("pos", "o_orderkey", "chunk")

    @q("make_iterator", f"SELECT pos, o_orderkey, epoch::INTEGER AS epoch, pos // 64 AS batch_id FROM {ORDERS}, (SELECT unnest([0, 1]) AS epoch)")
    def _(t):
        return B.epochs(_orders(t), 64, 2).select("pos", "o_orderkey", "epoch", "batch_id")

    @q("epoch_reshuffle", "SELECT epoch::INTEGER AS epoch, batch_id, CASE WHEN batch_id < n // 64 THEN 64 ELSE n % 64 END AS n_rows FROM (SELECT count(*) AS n FROM orders), (SELECT unnest([0, 1]) AS epoch), (SELECT unnest(range((SELECT (count(*) + 63) // 64 FROM orders))) AS batch_id)")
    def _(t):
        return B.epochs(_orders(t), 64, 2, seed=3).groupBy("epoch", "batch_id").agg(F.count("*").alias("n_rows"))

    @q("drop_last", f"SELECT pos, o_orderkey FROM {ORDERS} WHERE pos < (SELECT count(*) // 64 * 64 FROM orders)")
    def _(t):
        return B.drop_last(_orders(t), 64).select("pos", "o_orderkey")

    pad = f"""WITH o AS (SELECT * FROM {ORDERS}), n AS (SELECT count(*) AS n FROM o) SELECT pos, o_orderkey FROM o UNION ALL SELECT pos + n, o_orderkey FROM o, n WHERE pos < (32 - n % 32) % 32"""

    @q("proto_pad_divisor", pad)
    def _(t):
        return B.pad_to_divisor(_orders(t), 32)[0].select("pos", "o_orderkey")

    @q("proto_unpad", f"SELECT pos, o_orderkey FROM {ORDERS}")
    def _(t):
        return B.unpad(*B.pad_to_divisor(_orders(t), 32)).select("pos", "o_orderkey")

    @q("auto_padding_dispatch", f"SELECT pos, o_orderkey * 2 AS doubled FROM {ORDERS}")
    def _(t):
        padded, added = B.pad_to_divisor(_orders(t), 7)
        return B.unpad(B.chunk(padded, 7).select("pos", (F.col("o_orderkey") * 2).alias("doubled")), added)

    @q("proto_padding", f"WITH o AS (SELECT * FROM {ORDERS}) SELECT pos, o_orderkey FROM o UNION ALL SELECT (SELECT count(*) FROM o) + k, o_orderkey FROM o, (SELECT unnest([0, 1, 2, 3]) AS k) WHERE pos = (SELECT count(*) - 1 FROM o)")
    def _(t):
        return B.pad_with(_orders(t), 4).select("pos", "o_orderkey")

    @q("proto_union", f"SELECT pos, o_orderkey, o_custkey, o_totalprice, o_totalprice > 100000 AS large FROM {ORDERS}")
    def _(t):
        orders = _orders(t)
        return B.merge_columns(orders, orders.select("pos", "o_custkey", (F.col("o_totalprice") > 100000).alias("large")))

    @q("concat_rows", f"WITH o AS (SELECT * FROM {ORDERS}) SELECT pos, o_orderkey FROM o UNION ALL SELECT pos + (SELECT count(*) FROM o), o_orderkey FROM o WHERE pos < 100")
    def _(t):
        orders = _orders(t)
        return B.concat(orders, B.slice_rows(orders, 0, 100)).select("pos", "o_orderkey")

    @q("split_range", f"SELECT pos, o_orderkey FROM {ORDERS} WHERE pos >= ceil((SELECT count(*) FROM orders) * 0.25) AND pos < ceil((SELECT count(*) FROM orders) * 0.6)")
    def _(t):
        return B.rows_of_range(_orders(t), 0.25, 0.6).select("pos", "o_orderkey")

    @q("split_file_n", f"SELECT pos // (SELECT (count(*) + 6) // 7 FROM orders) AS file_no, count(*) AS n_rows FROM {ORDERS} GROUP BY 1")
    def _(t):
        return B.split_files(_orders(t), 7).groupBy("file_no").agg(F.count("*").alias("n_rows"))

    @q("uid_to_index", f"SELECT o_orderkey, pos FROM {ORDERS}")
    def _(t):
        return _orders(t).select("o_orderkey", "pos")

    @q("batch_size_report", "SELECT count(*) AS n_rows, (count(*) * 24)::BIGINT AS n_bytes FROM orders")
    def _(t):
        # two longs and a double a row
        return _orders(t).agg(F.count("*").alias("n_rows"), F.sum(F.lit(24)).cast("long").alias("n_bytes"))
