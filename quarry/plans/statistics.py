"""Queries over the statistics operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import scalar
from quarry.operators import stats
from quarry.plans.registry import read, register


def _r(frame, digits: int = 6, /, **own):
    """Doubles rounded, so that the order of summation does not show."""
    return frame.select(*(F.round(c, own.get(c, digits)).alias(c) if t == "double" else F.col(c) for c, t in frame.dtypes))


@register("stats_describe", """SELECT p_brand, count(*) AS n, round(avg(p_retailprice), 6) AS mean, round(stddev_samp(p_retailprice), 6) AS std,
 round(var_samp(p_retailprice), 6) AS var, min(p_retailprice) AS min, max(p_retailprice) AS max, round(max(p_retailprice) - min(p_retailprice), 6) AS range,
 round(stddev_samp(p_retailprice) / sqrt(count(*)), 6) AS sem FROM part GROUP BY p_brand""")
def stats_describe(spark, d):
    return _r(stats.describe(read(spark, d, "part"), "p_retailprice", "p_brand"))


@register("stats_moments", """SELECT c_mktsegment, count(*) AS n, round(skewness(c_acctbal), 6) AS skew_unbiased, round(kurtosis(c_acctbal), 6) AS kurt_unbiased,
 round(kurtosis_pop(c_acctbal), 6) AS kurt, round(skewness(c_acctbal) * (count(*) - 2) / sqrt(count(*) * (count(*) - 1.0::DOUBLE)), 6) AS skew FROM customer GROUP BY c_mktsegment""")
def stats_moments(spark, d):
    return _r(stats.moments(read(spark, d, "customer"), "c_acctbal", "c_mktsegment"))


@register("stats_central_moment", """WITH m AS (SELECT l_returnflag, avg(l_quantity) AS m FROM lineitem GROUP BY 1)
 SELECT l_returnflag, round(avg(pow(l_quantity - m, 4)), 4) AS moment4 FROM lineitem JOIN m USING (l_returnflag) GROUP BY l_returnflag""")
def stats_central_moment(spark, d):
    return _r(stats.central_moment(read(spark, d, "lineitem"), "l_quantity", 4, "l_returnflag"), 4)


@register("stats_quantile_linear", "SELECT o_orderstatus, round(quantile_cont(o_totalprice, 0.3), 6) AS quantile FROM orders GROUP BY o_orderstatus")
def stats_quantile_linear(spark, d):
    return _r(stats.quantile(read(spark, d, "orders"), "o_totalprice", 0.3, "o_orderstatus"))


for _m, _e in (("lower", "list_sort(v)[1 + CAST(floor(0.3 * (len(v) - 1)) AS BIGINT)]"), ("higher", "list_sort(v)[1 + CAST(ceil(0.3 * (len(v) - 1)) AS BIGINT)]"), ("midpoint", "(list_sort(v)[1 + CAST(floor(0.3 * (len(v) - 1)) AS BIGINT)] + list_sort(v)[1 + CAST(ceil(0.3 * (len(v) - 1)) AS BIGINT)]) / 2"), ("nearest", "list_sort(v)[1 + CAST(CASE WHEN 0.3 * (len(v) - 1) - floor(0.3 * (len(v) - 1)) < 0.5 THEN floor(0.3 * (len(v) - 1)) ELSE ceil(0.3 * (len(v) - 1)) END AS BIGINT)]")):
    register(f"stats_quantile_{_m}", f"WITH g AS (SELECT c_mktsegment, list(c_acctbal) AS v FROM customer GROUP BY 1) SELECT c_mktsegment, round({_e}, 6) AS quantile FROM g")(
        lambda spark, d, m=_m: _r(stats.quantile(read(spark, d, "customer"), "c_acctbal", 0.3, "c_mktsegment", m))
    )


@register("stats_dispersion", """SELECT l_linestatus, round(quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25), 5) AS iqr,
 round(stddev_samp(l_extendedprice) / abs(avg(l_extendedprice)), 6) AS cv, round(max(l_extendedprice) - min(l_extendedprice), 5) AS range FROM lineitem GROUP BY l_linestatus""")
def stats_dispersion(spark, d):
    return _r(stats.dispersion(read(spark, d, "lineitem"), "l_extendedprice", "l_linestatus"), iqr=5, range=5)


@register("stats_mad", "SELECT event_type, round(mad(value), 6) AS mad FROM events GROUP BY event_type")
def stats_mad(spark, d):
    return _r(stats.mad(read(spark, d, "events"), "value", "event_type"))


@register("stats_gini", """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i FROM events)
 SELECT event_type, round(2 * sum(i * value) / (count(*) * sum(value)) - (count(*) + 1.0::DOUBLE) / count(*), 6) AS gini FROM r GROUP BY event_type""")
def stats_gini(spark, d):
    return _r(stats.gini(read(spark, d, "events"), "value", "event_type"))


_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register("stats_correlation_matrix", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS corr, round(covar_samp({a}, {b}), 4) AS cov FROM lineitem" for i, a in enumerate(_COLS) for b in _COLS[i:]))
def stats_correlation_matrix(spark, d):
    return _r(stats.correlation_matrix(read(spark, d, "lineitem"), _COLS), cov=4)


@register("stats_zscore_outliers", """WITH s AS (SELECT event_type, avg(value) AS m, stddev_samp(value) AS s FROM events GROUP BY 1)
 SELECT event_id, event_type, round((value - m) / s, 6) AS z FROM events JOIN s USING (event_type) WHERE abs((value - m) / s) > 2""")
def stats_zscore_outliers(spark, d):
    return _r(stats.zscore_outliers(read(spark, d, "events"), "value", 2.0, "event_type").select("event_id", "event_type", "z"))


@register("stats_iqr_outliers", """WITH s AS (SELECT event_type, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events GROUP BY 1)
 SELECT event_id, value FROM events JOIN s USING (event_type) WHERE value < a - 0.5 * (b - a) OR value > b + 0.5 * (b - a)""")
def stats_iqr_outliers(spark, d):
    return stats.iqr_outliers(read(spark, d, "events"), "value", 0.5, "event_type").select("event_id", "value")


@register("stats_histogram", """WITH r AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders)
 SELECT CAST(least(floor((o_totalprice - lo) / ((hi - lo) / 20)), 19) AS INTEGER) AS bin, count(*) AS n FROM orders, r GROUP BY 1""")
def stats_histogram(spark, d):
    return stats.histogram(read(spark, d, "orders"), "o_totalprice", 20)


_RANK = "rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0::DOUBLE"


@register("stats_spearman", f"WITH r AS (SELECT {_RANK.format('l_quantity')} AS a, {_RANK.format('l_extendedprice')} AS b FROM lineitem) SELECT round(corr(a, b), 6) AS spearman FROM r")
def stats_spearman(spark, d):
    return _r(stats.spearman(read(spark, d, "lineitem"), "l_quantity", "l_extendedprice"))


@register("stats_kendall", """WITH c AS (SELECT quality AS x, toxic AS y, count(*)::DOUBLE AS n FROM labels GROUP BY 1, 2),
 p AS (SELECT sum(a.n * b.n * sign(a.y - b.y)) AS s, sum(a.n * b.n) AS px FROM c a JOIN c b ON a.x > b.x),
 q AS (SELECT sum(a.n * b.n) AS py FROM c a JOIN c b ON a.y > b.y) SELECT round(s / sqrt(px * py), 6) AS tau_b FROM p, q""")
def stats_kendall(spark, d):
    return _r(stats.kendall_tau_b(read(spark, d, "labels"), "quality", "toxic"))


@register("stats_partial_correlation", """WITH c AS (SELECT corr(l_extendedprice, l_tax) AS xy, corr(l_extendedprice, l_quantity) AS xz, corr(l_tax, l_quantity) AS yz FROM lineitem)
 SELECT round((xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)), 6) AS partial_corr FROM c""")
def stats_partial_correlation(spark, d):
    return _r(stats.partial_correlation(read(spark, d, "lineitem"), "l_extendedprice", "l_tax", "l_quantity"))


_ANOVA = """t AS (SELECT {g} AS g, {x} AS x FROM {t}), m AS (SELECT g, avg(x) AS m, count(*) AS n FROM t GROUP BY g), a AS (SELECT avg(x) AS a, count(*) AS total FROM t),
 b AS (SELECT sum(n * (m - a) * (m - a)) AS ssb, count(*) AS k FROM m, a), w AS (SELECT sum((x - m) * (x - m)) AS ssw FROM t JOIN m USING (g))"""


@register("stats_anova", "WITH " + _ANOVA.format(g="c_mktsegment", x="c_acctbal", t="customer") + """ SELECT round(ssb, 1) AS ss_between, round(ssw, 1) AS ss_within, k - 1 AS df_between, total - k AS df_within,
 round((ssb / (k - 1)) / (ssw / (total - k)), 5) AS f FROM a, b, w""")
def stats_anova(spark, d):
    return _r(stats.anova(read(spark, d, "customer"), "c_acctbal", "c_mktsegment"), 1, f=5)


@register("stats_tukey", "WITH " + _ANOVA.format(g="c_mktsegment", x="c_acctbal", t="customer") + """ SELECT x.g AS a, y.g AS b, round(x.m - y.m, 5) AS diff,
 round(abs(x.m - y.m) / sqrt((ssw / (total - k)) / 2 * (1.0::DOUBLE / x.n + 1.0::DOUBLE / y.n)), 5) AS q FROM m x JOIN m y ON x.g < y.g, a, b, w""")
def stats_tukey(spark, d):
    return _r(stats.tukey_pairs(read(spark, d, "customer"), "c_acctbal", "c_mktsegment"), 5)


for _c, _f in (("mean", "avg"), ("median", "median")):
    register(f"stats_levene_{_c}", f"WITH c AS (SELECT c_mktsegment, {_f}(c_acctbal) AS c FROM customer GROUP BY 1), z AS (SELECT c_mktsegment, abs(c_acctbal - c) AS z FROM customer JOIN c USING (c_mktsegment)), " + _ANOVA.format(g="c_mktsegment", x="z", t="z") + " SELECT round((ssb / (k - 1)) / (ssw / (total - k)), 5) AS w, k - 1 AS df_between, total - k AS df_within FROM a, b, w")(
        lambda spark, d, c=_c: _r(stats.levene(read(spark, d, "customer"), "c_acctbal", "c_mktsegment", c), 5)
    )


@register("stats_bartlett", """WITH g AS (SELECT count(*) - 1 AS d, var_samp(c_acctbal) AS v FROM customer GROUP BY c_mktsegment),
 t AS (SELECT count(*) AS k, sum(d)::DOUBLE AS D, sum(d * v) AS S, sum(d * ln(v)) AS L, sum(1.0::DOUBLE / d) AS R FROM g)
 SELECT round((D * ln(S / D) - L) / (1 + (R - 1 / D) / (3 * (k - 1))), 5) AS t, k - 1 AS df FROM t""")
def stats_bartlett(spark, d):
    return _r(stats.bartlett(read(spark, d, "customer"), "c_acctbal", "c_mktsegment"), 5)


@register("stats_chi2_independence", """WITH n AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*)::DOUBLE AS n FROM orders GROUP BY 1, 2), a AS (SELECT a, sum(n) AS ra FROM n GROUP BY 1),
 b AS (SELECT b, sum(n) AS rb FROM n GROUP BY 1), t AS (SELECT sum(n) AS t FROM n), e AS (SELECT ra * rb / t AS e, coalesce(n, 0) AS n FROM a CROSS JOIN b CROSS JOIN t LEFT JOIN n USING (a, b))
 SELECT round(sum((n - e) * (n - e) / e), 5) AS chi2, CAST(((SELECT count(*) FROM a) - 1) * ((SELECT count(*) FROM b) - 1) AS BIGINT) AS df FROM e""")
def stats_chi2_independence(spark, d):
    return _r(stats.chi2_independence(read(spark, d, "orders"), "o_orderstatus", "o_orderpriority"), 5)


@register("stats_chi2_yates", """WITH n AS (SELECT quality AS a, toxic AS b, count(*)::DOUBLE AS n FROM labels GROUP BY 1, 2), a AS (SELECT a, sum(n) AS ra FROM n GROUP BY 1),
 b AS (SELECT b, sum(n) AS rb FROM n GROUP BY 1), t AS (SELECT sum(n) AS t FROM n), e AS (SELECT ra * rb / t AS e, coalesce(n, 0) AS n FROM a CROSS JOIN b CROSS JOIN t LEFT JOIN n USING (a, b))
 SELECT round(sum(pow(greatest(abs(n - e) - 0.5, 0), 2) / e), 5) AS chi2, CAST(1 AS BIGINT) AS df FROM e""")
def stats_chi2_yates(spark, d):
    return _r(stats.chi2_independence(read(spark, d, "labels"), "quality", "toxic", True), 5)


@register("stats_chi2_gof", "WITH c AS (SELECT event_type, count(*)::DOUBLE AS o FROM events GROUP BY 1), e AS (SELECT o, avg(o) OVER () AS e FROM c) SELECT round(sum((o - e) * (o - e) / e), 5) AS chi2, count(*) - 1 AS df FROM e")
def stats_chi2_gof(spark, d):
    c = read(spark, d, "events").groupBy("event_type").agg(F.count("*").cast("double").alias("o"))
    return _r(stats.chi2_gof(c.crossJoin(F.broadcast(c.agg(F.avg("o").alias("e")))), "o", "e"), 5)


_T = "WITH s AS (SELECT " + ", ".join(f"{f}(CASE WHEN l_returnflag = '{v}' THEN l_extendedprice END) AS {k}{i}" for i, v in ((1, "A"), (2, "R")) for k, f in (("n", "count"), ("m", "avg"), ("v", "var_samp"))) + " FROM lineitem) "


@register("stats_t_welch", _T + "SELECT round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 5) AS t, round(pow(v1 / n1 + v2 / n2, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v2 / n2, 2) / (n2 - 1)), 3) AS df FROM s")
def stats_t_welch(spark, d):
    return _r(stats.t_test(read(spark, d, "lineitem"), "l_extendedprice", "l_returnflag", "A", "R"), 5, df=3)


@register("stats_t_pooled", _T + "SELECT round((m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1.0::DOUBLE / n1 + 1.0::DOUBLE / n2)), 5) AS t, (n1 + n2 - 2)::DOUBLE AS df FROM s")
def stats_t_pooled(spark, d):
    return _r(stats.t_test(read(spark, d, "lineitem"), "l_extendedprice", "l_returnflag", "A", "R", True), 5)


@register("stats_mann_whitney", f"WITH t AS (SELECT * FROM events WHERE event_type IN ('click', 'view')), r AS (SELECT event_type, {_RANK.format('value')} AS r FROM t) SELECT sum(r) - count(*) * (count(*) + 1) / 2.0::DOUBLE AS u FROM r WHERE event_type = 'click'")
def stats_mann_whitney(spark, d):
    return stats.mann_whitney(read(spark, d, "events"), "value", "event_type", "click", "view")


@register("stats_kruskal", f"""WITH r AS (SELECT event_type, value, {_RANK.format('value')} AS r FROM events), g AS (SELECT sum(r) AS r, count(*) AS n FROM r GROUP BY event_type),
 s AS (SELECT sum(r * r / n) AS s, sum(n)::DOUBLE AS N, count(*) - 1 AS df FROM g), t AS (SELECT sum(t * t * t - t) AS T FROM (SELECT count(*)::DOUBLE AS t FROM events GROUP BY value))
 SELECT round((12 / (N * (N + 1)) * s - 3 * (N + 1)) / (1 - T / (N * N * N - N)), 4) AS h, df FROM s, t""")
def stats_kruskal(spark, d):
    return _r(stats.kruskal(read(spark, d, "events"), "value", "event_type"), 4)


@register("stats_wilcoxon", f"""WITH t AS (SELECT l_quantity - l_linenumber * 7 AS d, abs(l_quantity - l_linenumber * 7) AS a FROM lineitem WHERE l_quantity - l_linenumber * 7 <> 0), r AS (SELECT d, {_RANK.format('a')} AS r FROM t)
 SELECT sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS w_plus, sum(CASE WHEN d < 0 THEN r ELSE 0 END) AS w_minus, least(sum(CASE WHEN d > 0 THEN r ELSE 0 END), sum(CASE WHEN d < 0 THEN r ELSE 0 END)) AS w FROM r""")
def stats_wilcoxon(spark, d):
    return stats.wilcoxon(read(spark, d, "lineitem").select("l_quantity", (F.col("l_linenumber") * 7).alias("y")), "l_quantity", "y")


def _daily_by_type(spark, d):
    return read(spark, d, "events").groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").cast("double").alias("n"))


_DAILY = "t AS (SELECT CAST(ts AS DATE) AS day, event_type, count(*)::DOUBLE AS n FROM events GROUP BY 1, 2)"


@register("stats_friedman", f"""WITH {_DAILY}, r AS (SELECT day, event_type, rank() OVER (PARTITION BY day ORDER BY n) + (count(*) OVER (PARTITION BY day, n) - 1) / 2.0::DOUBLE AS r, count(*) OVER (PARTITION BY day, n) AS c FROM t),
 s AS (SELECT sum(s * s) AS S, count(*)::DOUBLE AS k FROM (SELECT sum(r) AS s FROM r GROUP BY event_type)), q AS (SELECT count(DISTINCT day)::DOUBLE AS n, sum(c * c - 1) AS T FROM r)
 SELECT round((12 / (n * k * (k + 1)) * S - 3 * n * (k + 1)) / (1 - T / (n * k * (k * k - 1))), 5) AS chi2, CAST(k - 1 AS BIGINT) AS df FROM s, q""")
def stats_friedman(spark, d):
    return _r(stats.friedman(_daily_by_type(spark, d), "day", "event_type", "n"), 5)


@register("stats_icc", f"""WITH {_DAILY}, o AS (SELECT count(DISTINCT day)::DOUBLE AS n, count(DISTINCT event_type)::DOUBLE AS k, sum(n) AS s, sum(n * n) AS q FROM t),
 a AS (SELECT sum(a * a) AS A FROM (SELECT sum(n) AS a FROM t GROUP BY day)), b AS (SELECT sum(b * b) AS B FROM (SELECT sum(n) AS b FROM t GROUP BY event_type)),
 m AS (SELECT n, k, (A / k - s * s / (n * k)) / (n - 1) AS msb, (B / n - s * s / (n * k)) / (k - 1) AS msr, (q - A / k - B / n + s * s / (n * k)) / ((n - 1) * (k - 1)) AS mse, (q - A / k) / (n * (k - 1)) AS msw FROM o, a, b)
 SELECT round(CASE WHEN msb <= msw THEN 0 ELSE (msb - msw) / (msb + (k - 1) * msw) END, 6) AS icc1, round(CASE WHEN msb <= mse THEN 0 ELSE (msb - mse) / (msb + (k - 1) * mse + k * (msr - mse) / n) END, 6) AS icc2,
 round(CASE WHEN msb <= mse THEN 0 ELSE (msb - mse) / (msb + (k - 1) * mse) END, 6) AS icc3 FROM m""")
def stats_icc(spark, d):
    return _r(stats.icc(_daily_by_type(spark, d), "day", "event_type", "n"))


@register("stats_ks", """WITH t AS (SELECT value, event_type FROM events WHERE event_type IN ('click', 'view')), v AS (SELECT value, count(*) FILTER (event_type = 'click') AS a, count(*) FILTER (event_type = 'view') AS b FROM t GROUP BY value),
 f AS (SELECT sum(a) OVER (ORDER BY value) / (SELECT sum(a) FROM v)::DOUBLE - sum(b) OVER (ORDER BY value) / (SELECT sum(b) FROM v)::DOUBLE AS g FROM v) SELECT round(max(abs(g)), 6) AS ks FROM f""")
def stats_ks(spark, d):
    return _r(stats.ks_two_sample(read(spark, d, "events"), "value", "event_type", "click", "view"))


@register("stats_linear_regression", "SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 5) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem GROUP BY 1")
def stats_linear_regression(spark, d):
    return _r(stats.linear_regression(read(spark, d, "lineitem"), "l_quantity", "l_extendedprice", "l_returnflag"), slope=5, intercept=4)


@register("stats_mutual_information", """WITH r AS (SELECT min(l_quantity) AS a, max(l_quantity) AS b, min(l_extendedprice) AS c, max(l_extendedprice) AS e FROM lineitem),
 n AS (SELECT least(floor((l_quantity - a) / ((b - a) / 10)), 9) AS i, least(floor((l_extendedprice - c) / ((e - c) / 10)), 9) AS j, count(*)::DOUBLE AS n FROM lineitem, r GROUP BY 1, 2),
 p AS (SELECT n, sum(n) OVER (PARTITION BY i) AS ni, sum(n) OVER (PARTITION BY j) AS nj, sum(n) OVER () AS t FROM n) SELECT round(sum(n / t * ln(n * t / (ni * nj))), 6) AS mi FROM p""")
def stats_mutual_information(spark, d):
    return _r(stats.mutual_information(read(spark, d, "lineitem"), "l_quantity", "l_extendedprice", 10))


@register("stats_f_score", "SELECT round(regr_r2(l_extendedprice, l_quantity) * (count(*) - 2) / (1 - regr_r2(l_extendedprice, l_quantity)), 2) AS f FROM lineitem")
def stats_f_score(spark, d):
    return _r(stats.f_score(read(spark, d, "lineitem"), "l_quantity", "l_extendedprice"), 2)


@register("stats_entropy", "WITH c AS (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2) SELECT o_orderstatus, round(ln(sum(n)) - sum(n * ln(n)) / sum(n), 6) AS entropy FROM c GROUP BY 1")
def stats_entropy(spark, d):
    return _r(stats.entropy(read(spark, d, "orders"), "o_orderpriority", "o_orderstatus"))


@register("stats_contingency", "SELECT quality, toxic, count(*) AS n FROM labels GROUP BY 1, 2")
def stats_contingency(spark, d):
    return stats.contingency(read(spark, d, "labels"), "quality", "toxic")


@register("stats_cube", "SELECT l_returnflag, l_linestatus, grouping(l_returnflag)::INTEGER AS g, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def stats_cube(spark, d):
    return read(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.grouping("l_returnflag").cast("int").alias("g"), F.count("*").alias("n"), F.countDistinct("l_suppkey").alias("suppliers"))


@register("scalar_information", """SELECT l_tax, l_discount, count(*) AS n, round(avg(CASE WHEN l_tax > 0 THEN -l_tax * ln(l_tax) ELSE 0 END), 8) AS entr,
 round(avg(CASE WHEN abs(l_quantity - 25) <= 10 THEN 0.5 * pow(l_quantity - 25, 2) ELSE 10 * (abs(l_quantity - 25) - 5) END), 6) AS huber,
 round(avg((pow(l_quantity, 0.5) - 1) / 0.5), 6) AS boxcox FROM lineitem GROUP BY 1, 2""")
def scalar_information(spark, d):
    f = read(spark, d, "lineitem").groupBy("l_tax", "l_discount").agg(F.count("*").alias("n"), F.avg(scalar.entr("l_tax")).alias("entr"), F.avg(scalar.huber(10.0, F.col("l_quantity") - 25)).alias("huber"), F.avg(scalar.boxcox("l_quantity", 0.5)).alias("boxcox"))
    return f.withColumns({"entr": F.round("entr", 8), "huber": F.round("huber", 6), "boxcox": F.round("boxcox", 6)})


def _phi(x: str) -> str:
    poly = "0.254829592 + {t} * (-0.284496736 + {t} * (1.421413741 + {t} * (-1.453152027 + {t} * 1.061405429)))".format(t=f"(1 / (1 + 0.3275911 * abs({x}) / sqrt(2)))")
    e = f"(1 - (1 / (1 + 0.3275911 * abs({x}) / sqrt(2))) * ({poly}) * exp(-({x}) * ({x}) / 2))"
    return f"(CASE WHEN ({x}) >= 0 THEN 0.5 * (1 + {e}) ELSE 0.5 * (1 - {e}) END)"


@register("finance_black_scholes", f"""WITH s AS (SELECT p_partkey, p_retailprice::DOUBLE AS s, 1200.0::DOUBLE AS k, 0.03::DOUBLE AS r, 0.1::DOUBLE + p_size / 100.0::DOUBLE AS v, 0.5::DOUBLE AS t FROM part),
 x AS (SELECT *, (ln(s / k) + (r + v * v / 2) * t) / (v * sqrt(t)) AS d1, (ln(s / k) + (r + v * v / 2) * t) / (v * sqrt(t)) - v * sqrt(t) AS d2 FROM s)
 SELECT p_partkey, round(s * {_phi('d1')} - k * exp(-r * t) * {_phi('d2')}, 5) AS call, round(s * {_phi('d1')} - k * exp(-r * t) * {_phi('d2')} - s + k * exp(-r * t), 5) AS put FROM x""")
def finance_black_scholes(spark, d):
    p = read(spark, d, "part")
    args = (F.col("p_retailprice"), F.lit(1200.0), F.lit(0.03), F.lit(0.1) + F.col("p_size") / F.lit(100.0), F.lit(0.5))
    return p.select("p_partkey", F.round(scalar.black_scholes(*args), 5).alias("call"), F.round(scalar.black_scholes(*args, call=False), 5).alias("put"))
