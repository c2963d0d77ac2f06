"""Queries of advantages, divergences, objectives and schedules."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rollmill.functions import arrays as A
from rollmill.functions import groupwise as G
from rollmill.functions import objectives as O
from rollmill.functions import schedules as S
from rollmill.functions import stats
from rollmill.operators import advantages as V
from rollmill.plans.registry import Registry

LINE = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate"
LINES = LINE.split(", ")
#: Token tables: the exported demos; old log-probabilities and advantages are made from their columns.
TOKENS = """(SELECT uid, response_id, global_step, logged_at, unnest(token_log_p) AS lp, unnest(loss) AS l, unnest(loss_mask) AS m, generate_subscripts(token_log_p, 1) AS i FROM forward_export)"""


def _lines(t):
    return t.lineitem.select(*LINES, F.col("l_quantity").alias("score"), F.when(F.col("l_returnflag") == "N", V.SENTINEL).otherwise(F.col("l_returnflag")).alias("prefix_uid"))


def _out(df, *columns):
    return df.select(*LINES, *((F.round(c, 5) + 0.0).alias(c) for c in columns))


def _tokens(t):
    """uid, response_id, global_step, logged_at and the arrays lp, l, m of each export."""
    return t.forward_export.select("uid", "response_id", "global_step", "logged_at", "ingested_at", F.col("token_log_p").alias("lp"), F.col("loss").alias("l"), F.col("loss_mask").alias("m"))


def _zip(t):
    return _tokens(t).select("uid", "response_id", "global_step", "logged_at", F.explode(F.arrays_zip("lp", "l", "m")).alias("x")).select("uid", "response_id", "global_step", "x.*")


#: Old log-probability and advantage of a token, from what there is.
OLD, ADV = "(lp * 0.9 - 0.01)", "(0.5 - l)"


def _moments(df, *columns):
    return df.agg(*(F.round(F.sum(F.col(c) * F.col("m")) / (F.sum("m") + 1e-8), 6).alias(c) for c in columns))


def register(q: Registry) -> None:
    center = "l_quantity - CASE WHEN count(*) OVER w = 1 THEN 0 ELSE avg(l_quantity) OVER w END"
    for name, sql, make in (
        ("adv_grpo", f"({center}) / (CASE WHEN count(*) OVER w = 1 THEN 1 ELSE stddev_samp(l_quantity) OVER w END + 1e-6)", lambda d: V.estimate(d, "grpo", score="score", uid="l_orderkey")),
        ("adv_grpo_no_std", center, lambda d: V.grpo(d, "score", "l_orderkey", by_std=False)),
        ("adv_dr_grpo", center, lambda d: V.dr_grpo(d, "score", "l_orderkey")),
        ("adv_rloo", "CASE WHEN count(*) OVER w = 1 THEN l_quantity ELSE (l_quantity - avg(l_quantity) OVER w) * count(*) OVER w / (count(*) OVER w - 1) END", lambda d: V.rloo(d, "score", "l_orderkey")),
        ("group_zscore", f"({center}) / (CASE WHEN count(*) OVER w = 1 THEN 1 ELSE stddev_samp(l_quantity) OVER w END + 1e-6)", lambda d: d.withColumn("advantage", G.group_zscore(F.col("score"), "l_orderkey"))),
        ("group_center", center, lambda d: d.withColumn("advantage", G.group_center(F.col("score"), "l_orderkey"))),
        ("group_loo", "CASE WHEN count(*) OVER w = 1 THEN l_quantity ELSE (l_quantity - avg(l_quantity) OVER w) * count(*) OVER w / (count(*) OVER w - 1) END", lambda d: d.withColumn("advantage", G.group_leave_one_out(F.col("score"), "l_orderkey"))),
    ):
        q(name, f"SELECT {LINE}, round({sql}, 5) AS advantage FROM lineitem WINDOW w AS (PARTITION BY l_orderkey)")(lambda t, make=make: _out(make(_lines(t)), "advantage"))

    flag = f"CASE WHEN l_returnflag = 'N' THEN '{V.SENTINEL}' ELSE l_returnflag END"
    single = "count(*) OVER p = 1"
    kinds = {
        "grpo": (f"(l_quantity - CASE WHEN {single} THEN 0 ELSE avg(l_quantity) OVER p END) / (CASE WHEN {single} THEN 1 ELSE stddev_samp(l_quantity) OVER p END + 1e-6)", "CASE WHEN count(*) FILTER (WHERE l_returnflag = 'N') OVER u = 1 THEN 0 ELSE avg(l_quantity) FILTER (WHERE l_returnflag = 'N') OVER u END"),
        "dr_grpo": (f"l_quantity - CASE WHEN {single} THEN 0 ELSE avg(l_quantity) OVER p END", "CASE WHEN count(*) FILTER (WHERE l_returnflag = 'N') OVER u = 1 THEN 0 ELSE avg(l_quantity) FILTER (WHERE l_returnflag = 'N') OVER u END"),
        "dr_grpo_v2": ("l_quantity - avg(l_quantity) OVER p", "avg(l_quantity) FILTER (WHERE l_returnflag = 'N') OVER u"),
    }
    for kind, (own, base) in kinds.items():
        name = {"grpo": "adv_grpo_prefix", "dr_grpo": "adv_dr_grpo_prefix", "dr_grpo_v2": "adv_dr_grpo_prefix_v2"}[kind]
        sql = f"""SELECT {LINE}, round(a, 5) + 0.0::DOUBLE AS advantage, round(CASE WHEN f = '{V.SENTINEL}' THEN 0 ELSE (a - b) / 4 END, 5) + 0.0::DOUBLE AS prefix_advantage
        FROM (SELECT *, {flag} AS f, {own} AS a, {base} AS b FROM lineitem WINDOW p AS (PARTITION BY l_orderkey, {flag}), u AS (PARTITION BY l_orderkey))"""
        q(name, sql)(lambda t, kind=kind: _out(V.prefixed(_lines(t), "score", "l_orderkey", "prefix_uid", 4, kind), "advantage", "prefix_advantage"))
    q("group2_prefix", f"""SELECT {LINE}, round(l_quantity - avg(l_quantity) OVER p, 5) AS advantage FROM lineitem WINDOW p AS (PARTITION BY l_orderkey, {flag})""")(
        lambda t: _out(_lines(t).withColumn("advantage", F.col("score") - F.avg("score").over(Window.partitionBy("l_orderkey", "prefix_uid"))), "advantage")
    )

    softmean = "(SELECT (ln(avg(exp(0.1 * l_quantity - 5))) + 5) / 0.1 FROM lineitem)"
    q("adv_sppo", f"SELECT {LINE}, round(l_quantity - {softmean}, 4) AS advantage FROM lineitem")(lambda t: V.sppo(_lines(t), "score", 0.1).select(*LINES, F.round("advantage", 4).alias("advantage")))
    q("softmean", f"SELECT round({softmean}, 4) AS softmean FROM (SELECT 1)")(lambda t: stats.softmean(_lines(t), "score", 0.1).select(F.round("softmean", 4).alias("softmean")))

    # token estimators: reward = loss, value = 0.1 * log-probability
    whiten = """, stat AS (SELECT sum(raw * m) / (sum(m) + 1e-8) AS mu, sum(m) AS n FROM raw), spread AS (SELECT sum((raw - mu) * (raw - mu) * m) / (max(n) + 1e-8) * max(n) / (max(n) - 1) AS var FROM raw, stat)"""
    key = "uid, response_id, global_step"
    ordered = f"PARTITION BY {key}, logged_at, k ORDER BY i"
    base = "(SELECT *, row_number() OVER (ORDER BY uid, response_id, global_step, logged_at, ingested_at) AS k FROM forward_export)"
    tok = f"(SELECT {key}, logged_at, k, unnest(token_log_p) AS lp, unnest(loss) AS l, unnest(loss_mask) AS m, generate_subscripts(token_log_p, 1) AS i FROM {base})"

    def summary(df, *columns):
        """Sums over each export's tokens, so that arrays compare as numbers."""
        return df.select("uid", "response_id", "global_step", *(F.round(A.total(c), 3).alias(c) for c in columns))

    gae_sql = f"""WITH d AS (SELECT *, l + coalesce(lead(0.1 * lp) OVER w, 0) - 0.1 * lp AS delta FROM {tok} WINDOW w AS ({ordered})),
        raw AS (SELECT {key}, k, i, any_value(m) AS m, any_value(v) AS v, sum(g) AS raw FROM (SELECT a.{key.replace(', ', ', a.')}, a.k, a.i, a.m, 0.1 * a.lp AS v, b.delta * pow(0.95, b.i - a.i) AS g FROM d a JOIN d b ON a.k = b.k AND b.i >= a.i) GROUP BY ALL){whiten}
        SELECT {key}, round(sum((raw - mu) / sqrt(var + 1e-8)), 3) AS advantages, round(sum(raw + v), 3) AS returns FROM raw, stat, spread GROUP BY {key}, k"""
    gae_sql = gae_sql.replace("any_value(m) AS m, any_value(v) AS v, sum(g) AS raw FROM", "max(m) AS m, max(v) AS v, sum(g) AS raw FROM").replace("GROUP BY ALL)", f"GROUP BY {key}, k, i)")

    @q("adv_gae", gae_sql)
    def _(t):
        v = _tokens(t).withColumn("v", F.transform("lp", lambda x: x * 0.1))
        return summary(V.gae(v, "l", "v", "m"), "advantages", "returns")

    suffix = f"sum(l * m) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"

    @q("adv_remax", f"SELECT {key}, round(sum(r), 3) AS returns, round(sum(r - 0.25 * m), 3) AS advantages FROM (SELECT *, {suffix} AS r FROM {tok}) GROUP BY {key}, k")
    def _(t):
        return summary(V.remax(_tokens(t), "l", "m", F.lit(0.25)), "returns", "advantages")

    @q("reverse_cumsum", f"SELECT {key}, round(sum(r), 3) AS s FROM (SELECT *, sum(l) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS r FROM {tok}) GROUP BY {key}, k")
    def _(t):
        return summary(_tokens(t).withColumn("s", A.suffix_sum("l")), "s")

    # masks are ones up to the end, so a reset happens only at the last token: the discounted sum is one of powers
    @q("reverse_discounted_scan")
    def _(t):
        return summary(_tokens(t).withColumn("s", A.discounted_suffix_sum("l", "m", 0.9)), "s")

    @q("adv_reinforce_pp")
    def _(t):
        return summary(V.reinforce_plus_plus(_tokens(t), "l", "m", 1.0), "advantages", "returns")

    @q("adv_reinforce_pp_baseline", f"""WITH e AS (SELECT *, l_quantity - CASE WHEN count(*) OVER (PARTITION BY l_orderkey) = 1 THEN 0 ELSE avg(l_quantity) OVER (PARTITION BY l_orderkey) END AS raw, l_linenumber AS m FROM lineitem),
        stat AS (SELECT sum(raw * m) / (sum(m) + 1e-8) AS mu, sum(m) AS n FROM e), spread AS (SELECT sum((raw - mu) * (raw - mu) * m) / (max(n) + 1e-8) * max(n) / (max(n) - 1) AS var FROM e, stat)
        SELECT {LINE}, round(m * (raw - mu) / sqrt(var + 1e-8), 4) AS advantages FROM e, stat, spread""")
    def _(t):
        ones = _lines(t).withColumn("mask", F.transform(F.sequence(F.lit(1), F.col("l_linenumber")), lambda _: F.lit(1)))
        return V.reinforce_plus_plus_baseline(ones, "score", "l_orderkey", "mask").select(*LINES, F.round(A.total("advantages"), 4).alias("advantages"))

    @q("adv_dispatch", f"SELECT count(*) AS n FROM lineitem")
    def _(t):
        return V.estimate(_lines(t), "rloo", score="score", uid="l_orderkey").agg(F.count("advantage").alias("n"))

    @q("masked_sum", f"SELECT {key}, round(sum(l * m), 4) AS s FROM {tok} GROUP BY {key}, k")
    def _(t):
        return _tokens(t).select("uid", "response_id", "global_step", F.round(stats.masked_sum("l", "m"), 4).alias("s"))

    moments = f"WITH raw AS (SELECT l AS raw, m FROM {TOKENS}){whiten} "
    for name in ("masked_mean", "masked_var"):
        q(name, f"{moments} SELECT round(mu, 6) AS mean, round(var, 6) AS variance FROM stat, spread")(lambda t: stats.masked_moments(_tokens(t), "l", "m").select(F.round("mean", 6).alias("mean"), F.round("variance", 6).alias("variance")))

    @q("masked_whiten", f"WITH raw AS (SELECT {key}, k, l AS raw, m FROM {tok}){whiten} SELECT {key}, round(sum((raw - mu) / sqrt(var + 1e-8)), 3) AS l FROM raw, stat, spread GROUP BY {key}, k")
    def _(t):
        return summary(stats.masked_whiten(_tokens(t), "l", "m"), "l")

    for mode, sql in {
        "token-mean": "sum(s) / (sum(n) + 1e-8)",
        "seq-mean-token-sum": "avg(s)",
        "seq-mean-token-mean": "avg(s / n)",
        "seq-mean-token-sum-norm": "sum(s) / 150",
        "dr_grpo": "sum(s) / 2048",
    }.items():
        width = {"seq-mean-token-sum-norm": 150, "dr_grpo": 2048}.get(mode)
        q(f"agg_loss_{mode.replace('-', '_')}", f"SELECT round({sql}, 6) AS loss FROM (SELECT sum(l * m) AS s, sum(m) AS n FROM {tok} GROUP BY k)")(
            lambda t, mode=mode, width=width: stats.agg_loss(_tokens(t), "l", "m", mode, width).select(F.round("loss", 6).alias("loss"))
        )

    for kind, sql in {"kl": "d", "abs": "abs(d)", "mse": "0.5 * d * d", "low_var_kl": "greatest(least(exp(-d) + d - 1, 10), -10)"}.items():
        q(f"kl_penalty_{kind}", f"SELECT round(sum(({sql}) * m) / (sum(m) + 1e-8), 6) AS kl FROM (SELECT lp - {OLD} AS d, m FROM {TOKENS})")(
            lambda t, kind=kind: _moments(_zip(t).withColumn("kl", O.kl_penalty(F.col("lp"), F.expr(OLD), kind)), "kl")
        )

    @q("apply_kl", f"""SELECT round(avg(kl), 6) AS current_kl, round(sum(reward), 3) AS rewards FROM (SELECT sum((lp - {OLD}) * m) / (sum(m) + 1e-8) AS kl, sum(l - 0.1 * (lp - {OLD}) * m) AS reward FROM {tok} GROUP BY k)""")
    def _(t):
        d = F.transform("lp", lambda x: x - (x * 0.9 - 0.01))
        rows = _tokens(t).withColumn("kl", d).withColumn("rewards", F.zip_with("l", F.zip_with("kl", "m", lambda k, m: k * m), lambda s, k: s - 0.1 * k))
        per = rows.select((stats.masked_sum("kl", "m") / (A.total("m") + 1e-8)).alias("kl"), A.total("rewards").alias("reward"))
        return per.agg(F.round(F.avg("kl"), 6).alias("current_kl"), F.round(F.sum("reward"), 3).alias("rewards"))

    @q("compute_rewards", f"SELECT {key}, round(sum(l - (lp - {OLD}) * 0.05), 2) AS reward FROM {tok} GROUP BY {key}, k")
    def _(t):
        return _tokens(t).select("uid", "response_id", "global_step", F.round(A.total(F.zip_with("l", "lp", lambda s, x: s - (x - (x * 0.9 - 0.01)) * 0.05)), 2).alias("reward"))

    policy = f"""SELECT lp, m, p, exp(lp - {OLD}) AS r, {ADV} AS a, lp - {OLD} AS d FROM (SELECT *, CASE WHEN i <= 5 THEN 1 ELSE 0 END AS p FROM {TOKENS})"""
    terms = f"""SELECT *, greatest(-a * r, -a * least(greatest(r, 0.8), 1.2)) AS big, -a * r AS plain, -a * least(greatest(r, 0.8), 1.2) AS clipped, -a * least(greatest(r, 0.9), 1.1) AS clipped_off, greatest(-a * r, -a * least(greatest(r, 0.9), 1.1)) AS big_off FROM ({policy})"""
    mean = lambda x: f"round(sum(({x}) * m) / (sum(m) + 1e-8), 6)"
    low = "CASE WHEN big > -a * 3 AND a < 0 THEN 1 ELSE 0 END"

    @q("policy_loss", f"SELECT {mean('CASE WHEN a < 0 THEN least(-a * 3, big) ELSE big END')} AS loss, {mean('CASE WHEN clipped > plain THEN 1 ELSE 0 END')} AS clipped, {mean(low)} AS clipped_low, {mean('-d')} AS kl FROM ({terms})")
    def _(t):
        x = _zip(t).withColumn("t", O.policy_terms(F.col("lp"), F.expr(OLD), F.expr(ADV))).select("m", "t.*")
        return _moments(x, "loss", "clipped", "clipped_low", "kl")

    def prefix_terms(t, clip_prefix):
        x = t.forward_export.select(F.posexplode(F.arrays_zip(F.col("token_log_p").alias("lp"), F.col("loss").alias("l"), F.col("loss_mask").alias("m")))).select("pos", "col.*")
        x = x.withColumn("p", (F.col("pos") < 5).cast("int"))
        return x.withColumn("t", O.policy_terms_prefix(F.col("lp"), F.expr(OLD), F.expr(ADV), F.col("p"), 0.2, 0.2, 0.1, 0.1, 3.0, clip_prefix)).select("m", "p", "t.*")

    pmean = "round(sum((CASE WHEN clipped_off > plain THEN 1 ELSE 0 END) * p) / (sum(p) + 1e-8), 6)"

    @q("policy_loss_prefix", f"SELECT {mean('CASE WHEN a < 0 THEN least(-a * 3, big) ELSE big END')} AS loss, {pmean} AS clipped_prefix, {mean('CASE WHEN big_off > -a * 3 AND a < 0 THEN 1 ELSE 0 END')} AS clipped_low_prefix FROM ({terms})")
    def _(t):
        x = prefix_terms(t, True)
        inside = x.agg(F.round(F.sum(F.col("clipped_prefix") * F.col("p")) / (F.sum("p") + 1e-8), 6).alias("clipped_prefix"))
        return _moments(x, "loss", "clipped_low_prefix").crossJoin(F.broadcast(inside))

    @q("policy_loss_prefix_unclipped", f"SELECT {mean('CASE WHEN p > 0 THEN plain WHEN a < 0 THEN least(-a * 3, big) ELSE big END')} AS loss FROM ({terms})")
    def _(t):
        return _moments(prefix_terms(t, False), "loss")

    @q("replace_old_log_prob", f"SELECT {mean('CASE WHEN p > 0 THEN lp ELSE lp * 0.9 - 0.01 END')} AS old FROM ({terms})")
    def _(t):
        x = t.forward_export.select(F.posexplode(F.arrays_zip(F.col("token_log_p").alias("lp"), F.col("loss_mask").alias("m")))).select("pos", "col.*")
        return _moments(x.withColumn("old", F.when(F.col("pos") < 5, F.col("lp")).otherwise(F.expr(OLD))), "old")

    @q("value_loss", f"""SELECT {mean('0.5 * greatest(x, y)')} AS loss, {mean('CASE WHEN y > x THEN 1 ELSE 0 END')} AS clipped FROM (SELECT m, pow(lp - l, 2) AS x, pow(greatest(least(lp, v + 0.2), v - 0.2) - l, 2) AS y FROM (SELECT *, lp * 0.5 AS v FROM {TOKENS}))""")
    def _(t):
        x = _zip(t).withColumn("t", O.value_terms(F.col("lp"), F.col("l"), F.col("lp") * 0.5, 0.2)).select("m", "t.*")
        return _moments(x, "loss", "clipped")

    @q("entropy_loss", f"SELECT round(sum(e * m) / (sum(m) + 1e-8), 6) AS entropy FROM (SELECT coalesce(unnest(token_entropy), 0) AS e, unnest(loss_mask) AS m FROM forward_export WHERE token_entropy IS NOT NULL)")
    def _(t):
        x = t.forward_export.where("token_entropy IS NOT NULL").select(F.explode(F.arrays_zip(F.col("token_entropy").alias("entropy"), F.col("loss_mask").alias("m"))).alias("x")).select("x.*").fillna(0.0, ["entropy"])
        return _moments(x, "entropy")

    @q("entropy_bonus", f"SELECT round(sum(l * m) / (sum(m) + 1e-8) - 0.01 * sum(-lp * m) / (sum(m) + 1e-8) + 0.1 * sum((lp - {OLD}) * m) / (sum(m) + 1e-8), 6) AS loss FROM {TOKENS}")
    def _(t):
        part = lambda x: F.sum(F.expr(x) * F.col("m")) / (F.sum("m") + 1e-8)
        return _zip(t).agg(F.round(part("l") - 0.01 * part("-lp") + 0.1 * part(f"lp - {OLD}"), 6).alias("loss"))

    @q("sppo_loss", f"SELECT round(avg(pow(s - 0.5 * r, 2)), 5) AS loss FROM (SELECT sum((lp - {OLD}) * m) AS s, max(CASE WHEN i = 1 THEN l END) AS r, sum(m) AS n FROM {tok} GROUP BY k) WHERE n > 0")
    def _(t):
        x = _tokens(t).withColumn("d", F.transform("lp", lambda v: v - (v * 0.9 - 0.01))).where(A.total("m") > 0)
        return x.agg(F.round(F.avg(O.sppo_term(stats.masked_sum("d", "m"), F.col("l")[0], 0.5)), 5).alias("loss"))

    for kind, (a, lp) in {"identity": ("a", "lp"), "importance_sampling": ("a", "lp + lp * 0.9 - 0.01"), "luffy": ("a", "lp + lp * 0.9 - 0.01 - ln(exp(lp) + 0.1)"), "relu": ("greatest(a, 0)", "lp"), "silu": ("a / (1 + exp(-a))", "lp")}.items():

        def make(t, kind=kind):
            x = t.forward_export.select(F.posexplode(F.arrays_zip(F.col("token_log_p").alias("lp"), F.col("loss").alias("l"), F.col("loss_mask").alias("m")))).select("pos", "col.*")
            x = x.withColumn("t", O.reshape(F.expr(ADV), F.col("lp"), F.expr(OLD), (F.col("pos") < 5).cast("int"), kind)).select("m", F.col("t.advantage").alias("advantage"), F.col("t.log_prob").alias("log_prob"))
            return _moments(x, "advantage", "log_prob")

        q(f"adv_reshape_{kind}", f"SELECT {mean(f'CASE WHEN p > 0 THEN {a} ELSE a END')} AS advantage, {mean(f'CASE WHEN p > 0 THEN {lp} ELSE lp END')} AS log_prob FROM ({terms})")(make)

    weight = "1 / greatest(CASE WHEN x <= 0.1 THEN 2 / 1.0 WHEN x <= 0.9 THEN 2 * (0.9 - x) / 0.8 ELSE 0 END, 1e-3)"

    @q("position_weight", f"SELECT {LINE}, round(w / (SELECT avg(w) FROM (SELECT {weight} AS w FROM (SELECT l_quantity / 50 AS x FROM lineitem))), 4) AS weight FROM (SELECT *, {weight} AS w FROM (SELECT *, l_quantity / 50 AS x FROM lineitem))")
    def _(t):
        w = _lines(t).withColumn("w", O.position_weight(F.col("score") / 50, F.lit(0.1), F.lit(0.9)))
        return w.crossJoin(F.broadcast(w.agg(F.avg("w").alias("mean")))).select(*LINES, F.round(F.col("w") / F.col("mean"), 4).alias("weight"))

    @q("length_on", f"SELECT round(sum(CASE WHEN n = 60 AND i > 5 AND m = 1 THEN 0 ELSE a END), 4) AS advantage FROM (SELECT *, {ADV} AS a, sum(m) OVER (PARTITION BY k) AS n FROM {tok})")
    def _(t):
        x = _tokens(t).withColumn("n", A.total("m")).select("n", F.posexplode(F.arrays_zip("l", "m"))).select("n", "pos", "col.*")
        return x.agg(F.round(F.sum(O.without_cut_tail(F.expr(ADV), (F.col("pos") < 5).cast("int"), F.col("m"), F.col("n"), 60)), 4).alias("advantage"))

    @q("bottom_pct_mask", f"SELECT count(*) FILTER (WHERE place > floor(total * 0.2)) AS kept, floor(total * 0.2)::BIGINT AS zeroed FROM (SELECT row_number() OVER (ORDER BY l_extendedprice, {LINE}) AS place, count(*) OVER () AS total FROM lineitem WHERE l_returnflag = 'N') GROUP BY total")
    def _(t):
        own = t.lineitem.where("l_returnflag = 'N'")
        n = own.count()
        bottom = own.orderBy("l_extendedprice", *LINES).limit(int(n * 0.2))
        return bottom.agg((F.lit(n) - F.count("*")).alias("kept"), F.count("*").alias("zeroed"))

    steps = "(SELECT unnest(range(0, 120)) AS step)"
    for name, column, sql in (
        ("ctrl_const", lambda at: S.constant(at, 0.7), "0.7 + step * 0.0"),
        ("ctrl_linear", lambda at: S.linear(at, 1.0, 0.2, 80), "CASE WHEN step < 8 THEN step / 8.0 ELSE 0.2 + greatest(0, 1 - (step - 8) / 80.0) * 0.8 END"),
        ("ctrl_cosine", lambda at: S.cosine(at, 0.1, 1.0, 100), "1 + (0.1 - 1) * 0.5 * (1 + cos(pi() * least(1, step / 100.0)))"),
        ("ctrl_delay", lambda at: S.delayed(at, 20, 1.0, lambda s: S.linear(s, 1.0, 0.0, 50, 0.0)), "CASE WHEN step < 20 THEN 1.0 ELSE greatest(0, 1 - (step - 20) / 50.0) END"),
        ("ctrl_step", lambda at: S.stepped(at / 120, 0.5, 0.0, 1.0), "CASE WHEN step / 120.0 <= 0.5 THEN 0.0 ELSE 1.0 END"),
        ("ctrl_sigmoid", lambda at: S.sigmoid(at / 120, 0.5, 2.0, 4.0, -0.5), "2 / (1 + exp(-4 * (step / 120.0 - 0.5))) - 0.5"),
        ("lr_constant", lambda at: S.lr_constant(at, 2), "least(1.0, step / 2.0)"),
        ("lr_cosine", lambda at: S.lr_cosine(at, 10, 100, 0.1), "CASE WHEN step < 10 THEN 0.1 + 0.9 * step / 10.0 ELSE greatest(0.1, cos(pi() * (step - 10) / 90.0) * 0.45 + 0.55) END"),
        ("lr_wsd", lambda at: S.lr_wsd(at, 10, 110, 0.1), "CASE WHEN step < 10 THEN step / 10.0 WHEN step < 100 THEN 1.0 WHEN step < 110 THEN 0.9 * 0.5 * (1 + cos(pi() * (step - 100) / 10.0)) + 0.1 ELSE 0.1 END"),
        ("beta_sampler", lambda at: S.beta_uniform(F.pmod(at * 37, F.lit(101)) / 101, 0.2, 0.8), "0.2 + 0.6 * ((step * 37) % 101) / 101.0"),
        ("meta_adv", lambda at: F.greatest(at - 60, F.lit(0)).cast("double"), "greatest(step - 60, 0)"),
    ):
        q(name, f"SELECT step, round(CAST({sql} AS DOUBLE), 6) AS value FROM {steps}")(lambda t, column=column: t.spark.range(120).withColumnRenamed("id", "step").withColumn("value", F.round(column(F.col("step")), 6)))

    @q("kl_controller_fixed", "SELECT step, 0.2::DOUBLE AS value FROM (SELECT unnest(range(0, 10)) AS step)")
    def _(t):
        control = S.FixedKl(0.2)
        return t.spark.createDataFrame([(i, control.update(0.3, 10)) for i in range(10)], "step long, value double")

    @q("kl_controller_adaptive")
    def _(t):
        control = S.AdaptiveKl(0.1, 0.1, 100)
        return t.spark.createDataFrame([(i, control.update(0.05 * i, 10)) for i in range(10)], "step long, value double")
