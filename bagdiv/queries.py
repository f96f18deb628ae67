"""Queries over the test tables, one per operator, and the same in DuckDB's SQL where it can express them."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema
from .functions import specs as S
from .operators import approx, divergence, estimators, kernel, knn, machines, transforms
from .sources import growing
from .tables import checkpoint_folder, checkpointed

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as bags by label, of 64 dimensions."""
    return schema.points(_table(spark, sf_dir, "embeddings"), "label", "vec_id", F.col("embedding"))


def balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' balances as bags by nation, of one dimension."""
    return schema.points(_table(spark, sf_dir, "customer"), "c_nationkey", "c_custkey", F.array(F.col("c_acctbal") / 1000))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and prices of parts as bags by brand."""
    return schema.points(_table(spark, sf_dir, "part"), "p_brand", "p_partkey", F.array(F.col("p_size").cast("double"), F.col("p_retailprice")))


def order_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices and days of orders as bags by priority."""
    day = F.datediff("o_orderdate", F.lit("1992-01-01")).cast("double")
    return schema.points(_table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderkey", F.array(F.col("o_totalprice") / 1000, day))


#: SQL of the same sources, with (bag, id, v), and their dimensions.
SQL = {
    vectors: ("select label as bag, vec_id as id, embedding::DOUBLE[64] as v from embeddings", 64),
    balances: ("select c_nationkey as bag, c_custkey as id, [c_acctbal / 1000]::DOUBLE[1] as v from customer", 1),
    parts: ("select p_brand as bag, p_partkey as id, [p_size::double, p_retailprice]::DOUBLE[2] as v from part", 2),
}
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def add(name: str, query: Query, sql: str | None = None) -> None:
    _queries[name] = query
    if sql:
        _sql[name] = sql


def _near_sql(source, ks: list[int]) -> str:
    rows, dim = SQL[source]
    return f"""with e as ({rows}), n as (select bag, count(*) as n from e group by bag),
d as (select a.bag as p, a.id as i, b.bag as q, b.id as j, array_distance(a.v, b.v) as d from e a, e b where a.id <> b.id),
r as (select *, row_number() over (partition by p, i, q order by d, j) as k from d),
k as (select p, i, q, k, greatest({S.min_dist(dim)!r}, d) as nu from r where k in ({", ".join(map(str, ks))})),
j as (select k.p, k.q, k.k, k.nu, z.nu as rho, a.n, b.n as m from k join k z on k.p = z.p and k.i = z.i and z.q = z.p and k.k = z.k join n a on a.bag = k.p join n b on b.bag = k.q)"""


def _stat_sql(spec: S.Spec, dim: int, ks: list[int]) -> str:
    by_k = lambda of: "case k " + " ".join(f"when {k} then {of(k)!r}" for k in ks) + " end"
    own = lambda x, value: f"case when p = q then {value} else {x} end"
    alpha = lambda a: own(f"greatest(0, avg(power(rho / nu, {dim * (1 - a)!r})) * {by_k(lambda k: S.alpha_constant(k, a))} * power((any_value(n) - 1)::double / any_value(m), {1 - a!r}))", 1.0)
    kl = own(f"{dim} * avg(ln(nu) - ln(rho)) + ln(any_value(m)::double / (any_value(n) - 1))", 0.0)
    match spec.name:
        case "linear":
            return f"{by_k(lambda k: S.density_constant(k, dim))} / any_value(case when p = q then n else m end) * avg(power(nu, {-dim}))"
        case "kl":
            return f"greatest(0, {kl})"
        case "kl_raw":
            return kl
        case "alpha":
            return alpha(spec.alpha)
        case "bc":
            return f"least(1, {alpha(0.5)})"
        case "hellinger":
            return f"sqrt(greatest(0, 1 - {alpha(0.5)}))"
        case "renyi":
            return f"greatest(0, ln(greatest({alpha(spec.alpha)}, {S.FLOOR!r})) / {spec.alpha - 1!r})"
        case _:
            return f"({alpha(spec.alpha)} - 1) / {spec.alpha - 1!r}"


def _divs(source, specs: list[str], ks: list[int]) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = divergence.estimate_divs(source(spark, sf_dir), specs, ks)
        return out.select("p", "q", "spec", "k", F.round("value", 6).alias("value"))

    return query


def _divs_sql(source, specs: list[str], ks: list[int]) -> str:
    dim = SQL[source][1]
    each = [f"select p, q, '{s}' as spec, k::int as k, round({_stat_sql(s, dim, ks)}, 6) as value from j group by p, q, k" for s in S.parse(specs)]
    return _near_sql(source, ks) + "\n" + "\nunion all ".join(each)


for _name, _source, _specs, _ks in (
    ("kl_k3", vectors, ["kl"], [3]), ("kl_raw_k3", vectors, ["kl_raw"], [3]), ("kl_multi_k", vectors, ["kl", "kl_raw"], [1, 3, 5]), ("alpha_multi", vectors, ["alpha:0.5", "alpha:0.8", "alpha:0.9"], [3]),
    ("bc", balances, ["bc"], [3]), ("hellinger", balances, ["hellinger"], [3]), ("renyi", balances, ["renyi:0.5", "renyi:0.8", "renyi:0.9"], [3, 5]), ("tsallis", balances, ["tsallis:0.8"], [3]), ("linear", balances, ["linear"], [3]),
):
    add(_name, _divs(_source, _specs, _ks), _divs_sql(_source, _specs, _ks))

_LIN = _near_sql(balances, [3]) + f", lin as (select p, q, {_stat_sql(S.Spec('linear'), 1, [3])} as v, any_value(n) as n from j group by p, q, k), own as (select p as b, v * n / (n - 1) as v from lin where p = q)\n"
add("l2", _divs(balances, ["l2"], [3]), _LIN + "select x.p, x.q, 'l2' as spec, 3::int as k, round(case when x.p = x.q then 0 else sqrt(greatest(0, a.v + b.v - x.v - y.v)) end, 6) as value from lin x join lin y on x.p = y.q and x.q = y.p join own a on a.b = x.p join own b on b.b = x.q")


def _js_sql(what: str, k: int = 3) -> str:
    value = {"js": "v", "js_clamp": "least(ln(2), greatest(0, v))", "js-core": "core"}[what]
    of = "(select p, q, core from g union all select bag, bag, null from n)" if what == "js-core" else "js"
    rows, dim = SQL[balances]
    return f"""with e as ({rows}), n as (select bag, count(*) as n from e group by bag),
d as (select a.bag as p, a.id as i, b.bag as q, greatest({S.min_dist(dim)!r}, array_distance(a.v, b.v)) as d from e a, e b where a.id <> b.id),
r as (select *, row_number() over (partition by p, i, q order by d) as k from d), k as (select * from r where k <= {2 * k + 1}),
pr as (select a.bag as p, b.bag as q, a.n as n, b.n as m from n a, n b where a.bag <> b.bag),
c as (select pr.p, pr.q, n, m, k.i, k.d, (k.q <> pr.p)::int as f, case when k.q = pr.p then m else n end as w from pr join k on k.p = pr.p and k.q in (pr.p, pr.q)),
s as (select *, sum(w) over win as cw, row_number() over win as rn from c window win as (partition by p, q, i order by d, f rows unbounded preceding)),
t as (select p, q, n, m, i, max(rn) filter (cw * (n + m - 1) <= {k} * m * (2 * n - 1)) as nn from s group by all),
g as (select t.p, t.q, t.n, t.m, avg({dim} * ln(s.d) - (-0.5772156649015329 + coalesce(list_sum(list_transform(range(1, nn), lambda z: 1.0::double / z)), 0))) as core from t join s on s.p = t.p and s.q = t.q and s.i = t.i and s.rn = t.nn group by all),
bit as (select p, {dim} * avg(ln(d)) + ln(any_value(n.n) - 1) as b from k join n on n.bag = k.p where k.k = {k} and p = q group by p),
js as (select g.p, g.q, 0.5 * (g.core + h.core - a.b - c.b) + ln(g.n + g.m - 1) + ({S.psi(k)!r}) as v from g join g h on h.p = g.q and h.q = g.p join bit a on a.p = g.p join bit c on c.p = g.q union all select bag, bag, 0 from n)
select p, q, '{what}' as spec, {k}::int as k, round({value}, 6) as value from {of}"""


add("js", _divs(balances, ["js"], [3]), _js_sql("js"))
add("js_clamp", _divs(balances, ["js_clamp"], [3]), _js_sql("js_clamp"))


def renyi_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.bag_entropy(balances(spark, sf_dir), 0.8, 3).select("p", F.round("value", 6).alias("value"))


_A = 0.8
add("renyi_entropy", renyi_entropy, _near_sql(balances, [3]) + f"select p, round(ln({math.exp((1 - _A) * (0.5 * math.log(math.pi) - math.lgamma(1.5)) + math.lgamma(3) - math.lgamma(4 - _A))!r} * power(any_value(n) - 1, {1 - _A!r}) * avg(power(rho, {1 - _A!r}))) / {1 - _A!r}, 6) as value from j where p = q group by p")


def masked_divs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pts = vectors(spark, sf_dir)
    pairs = _bag_pairs(pts).where("q = p + 1")
    return divergence.estimate_divs(pts, ["kl_raw"], [3], pairs).select("p", "q", F.round("value", 6).alias("value"))


add("masked_divs", masked_divs, _near_sql(vectors, [3]) + f"select p, q, round({_stat_sql(S.Spec('kl_raw'), 64, [3])}, 6) as value from j where q = p + 1 group by p, q, k")


def split_divs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pts = balances(spark, sf_dir).withColumn("split", F.col("bag_id") < 5)
    return divergence.estimate_divs(pts, ["kl_raw"], [3]).select("p", "q", F.round("value", 6).alias("value"))


add("split_divs", split_divs, _near_sql(balances, [3]) + f"select p, q, round({_stat_sql(S.Spec('kl_raw'), 1, [3])}, 6) as value from j where p = q or (p < 5) <> (q < 5) group by p, q, k")


def _bag_pairs(pts: DataFrame) -> DataFrame:
    b = pts.select("bag_id").distinct()
    return b.select(F.col("bag_id").alias("p")).crossJoin(b.select(F.col("bag_id").alias("q")))


def _near_query(own: bool) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        pts = vectors(spark, sf_dir)
        same = pts.select(F.col("bag_id").alias("p"), F.col("bag_id").alias("q")).distinct()
        found = knn.nearest(pts, 3, same if own else None).where(F.col("rank") == 3)
        return found.where("p = q" if own else "p <> q").select("p", "i", "q", F.round("dist", 6).alias("dist"))

    return query


add("rho_k", _near_query(True), _near_sql(vectors, [3]) + "select p, i, q, round(d, 6) as dist from r where k = 3 and p = q")
add("nu_k", _near_query(False), _near_sql(vectors, [3]) + "select p, i, q, round(d, 6) as dist from r where k = 3 and p <> q")


def knn_join_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.nearest(balances(spark, sf_dir), 3).select("p", "i", "q", "j", "rank")


add("knn_join_ids", knn_join_ids, _near_sql(balances, [3]) + "select p, i, q, j, k::int as rank from r where k <= 3")


def pruned_knn_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The join with bounds, whatever the size of the table."""
    return knn.nearest(order_values(spark, sf_dir), 3, how="pruned").select("p", "i", "q", "j", "rank")


add("pruned_knn_join", pruned_knn_join, """with e as (select o_orderpriority as bag, o_orderkey as id, [o_totalprice / 1000, (o_orderdate::date - date '1992-01-01')::double]::DOUBLE[2] as v from orders),
f as (select a.bag as p, a.id as i, b.bag as q, min({'d': array_distance(a.v, b.v), 'j': b.id}, 3) as three from e a join e b on a.id <> b.id group by all)
select p, i, q, unnest(three).j as j, unnest(range(1, 4))::int as rank from f""")


def approx_knn_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the parts whose ids are divisible by 100, among all parts."""
    pts = parts(spark, sf_dir)
    return approx.approximate_nearest(pts, 3, pts.where("point_id % 100 = 0")).select("p", "i", "q", "j", "rank", F.round("dist", 6).alias("dist"))


add("approx_knn_join", approx_knn_join)


def _kl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.estimate_divs(balances(spark, sf_dir), ["renyi:0.8"], [3])


_RENYI = _near_sql(balances, [3]) + f", v as (select p, q, {_stat_sql(S.Spec('renyi', 0.8), 1, [3])} as value from j group by p, q, k), s as (select a.p, a.q, (a.value + b.value) / 2 as value from v a join v b on a.p = b.q and a.q = b.p), m as (select median(value) as m from s where value > 0)\n"
add("symmetrize", lambda s, d: kernel.symmetrize(_kl(s, d)).select("p", "q", F.round("value", 6).alias("value")), _RENYI + "select p, q, round(value, 6) as value from s")


def _median(divs: DataFrame) -> float | None:
    """Of the positive divergences; None without any, which is null in SQL."""
    return kernel.median(divs.where("value > 0"), "value")


def median_sigma(spark: SparkSession, sf_dir: str) -> DataFrame:
    divs = checkpointed(kernel.symmetrize(_kl(spark, sf_dir)))
    return spark.range(1).select(F.round(F.lit(_median(divs)).cast("double"), 6).alias("sigma"))


add("median_sigma", median_sigma, _RENYI + "select round(m, 6) as sigma from m")


def rbf_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    divs = kernel.symmetrize(_kl(spark, sf_dir)).persist()
    return kernel.rbf(divs, _median(divs)).select("p", "q", F.round("value", 6).alias("value"))


add("rbf_kernel", rbf_kernel, _RENYI + "select p, q, round(exp(-value * value / (2 * m * m)), 6) as value from s, m")


def _rounded(source, change, dims: int) -> Query:
    return lambda s, d: change(source(s, d)).select("bag_id", "point_id", *(F.round(F.element_at("features", i + 1), 6).alias(f"f{i}") for i in range(dims)))


_P, _E = SQL[parts][0], SQL[vectors][0]
add("bag_stats", lambda s, d: parts(s, d).groupBy("bag_id").agg(F.count("*").alias("n_pts"), F.min("point_id").alias("first"), F.max("point_id").alias("last")), f"select bag as bag_id, count(*) as n_pts, min(id) as first, max(id) as last from ({_P}) group by bag")
add("standardize", _rounded(parts, transforms.standardize, 2), f"select bag as bag_id, id as point_id, round((v[1] - avg(v[1]) over ()) / stddev_pop(v[1]) over (), 6) as f0, round((v[2] - avg(v[2]) over ()) / stddev_pop(v[2]) over (), 6) as f1 from ({_P})")
add("normalize_l2", _rounded(parts, transforms.normalize, 2), f"select bag as bag_id, id as point_id, round(v[1] / sqrt(v[1] * v[1] + v[2] * v[2]), 6) as f0, round(v[2] / sqrt(v[1] * v[1] + v[2] * v[2]), 6) as f1 from ({_P})")
add("normalize_l1", _rounded(parts, lambda p: transforms.normalize(p, "l1"), 2), f"select bag as bag_id, id as point_id, round(v[1] / (abs(v[1]) + abs(v[2])), 6) as f0, round(v[2] / (abs(v[1]) + abs(v[2])), 6) as f1 from ({_P})")
add("blank_drop", _rounded(parts, lambda p: transforms.blanks(p, "drop", 975.0), 2), f"select bag as bag_id, id as point_id, round(v[1], 6) as f0, round(v[2], 6) as f1 from ({_P}) where v[1] + v[2] >= 975")
add("blank_zero", _rounded(parts, lambda p: transforms.blanks(p, "zero", 975.0), 2), f"select bag as bag_id, id as point_id, round(case when v[1] + v[2] < 975 then 0 else v[1] end, 6) as f0, round(case when v[1] + v[2] < 975 then 0 else v[2] end, 6) as f1 from ({_P})")


def append_xy(spark: SparkSession, sf_dir: str) -> DataFrame:
    pts = balances(spark, sf_dir).withColumn("x", F.col("point_id") % 97).withColumn("y", F.col("point_id") % 89)
    return _rounded(lambda *_: pts, transforms.append_xy, 3)(spark, sf_dir)


add("append_xy", append_xy, f"select bag as bag_id, id as point_id, round(v[1], 6) as f0, round(id % 97 / max(id % 97) over (), 6) as f1, round(id % 89 / max(id % 89) over (), 6) as f2 from ({SQL[balances][0]})")
add("sample_first", lambda s, d: transforms.sample_bags(_table(s, d, "part").select("p_brand", "p_partkey"), "p_brand", "p_partkey", 7), "select p_brand, p_partkey from part qualify row_number() over (partition by p_brand order by p_partkey) <= 7")
add("sample_uniform", lambda s, d: transforms.sample_bags(_table(s, d, "part").select("p_brand", "p_partkey"), "p_brand", "p_partkey", 7, "uniform"), "with r as (select p_brand, p_partkey, row_number() over (partition by p_brand order by p_partkey) - 1 as i, count(*) over (partition by p_brand) as n from part) select p_brand, p_partkey from r where n <= 7 or i in (select round_even(x * (r.n - 1) / 6.0, 0) from range(7) t(x))")
add("union_bags", lambda s, d: schema.union(_table(s, d, "customer").select(F.col("c_custkey").alias("id"), "c_name", F.col("c_acctbal").alias("bal")), _table(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("bal"))), "select c_custkey as id, c_acctbal as bal from customer union all select s_suppkey, s_acctbal from supplier")


def bow_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    pts = vectors(spark, sf_dir)
    centers = pts.groupBy("bag_id").agg(F.min_by("features", "point_id").alias("c")).orderBy("bag_id").collect()
    return transforms.bag_of_words(pts, np.array([r.c for r in centers])).select("bag_id", F.col("code").cast("int").alias("code"), "n")


add("bow_histogram", bow_histogram, f"with e as ({_E}), c as (select bag, arg_min(v, id) as c, row_number() over (order by bag) - 1 as code from e group by bag), d as (select e.bag, e.id, code, row_number() over (partition by e.id order by array_distance(v, c), code) as r from e, c) select bag as bag_id, code::int as code, count(*) as n from d where r = 1 group by all")
add("label_join", lambda s, d: schema.with_extra(_table(s, d, "documents").select(F.col("doc_id").alias("bag_id"), "source"), _table(s, d, "labels").select(F.col("doc_id").alias("bag_id"), "quality")).groupBy("source", "quality").agg(F.count("*").alias("n")), "select source, quality, count(*) as n from documents left join labels using (doc_id) group by all")
add("scores", lambda s, d: _table(s, d, "labels").agg(F.round(estimators.accuracy(F.col("quality"), F.col("toxic")), 6).alias("accuracy"), F.round(estimators.rmse(F.col("quality"), F.col("toxic")), 6).alias("rmse")), "select round(avg((quality = toxic)::int), 6) as accuracy, round(sqrt(avg(power(quality - toxic, 2))), 6) as rmse from labels")
add("pca_scores", lambda s, d: transforms.pca(vectors(s, d), k=3).select("bag_id", "point_id", F.round(F.element_at("features", 1), 6).alias("f0")))
# Of two dimensions the axes are known in closed form; the second feature varies more, so its part of the first axis is positive.
add("pca_plane", _rounded(parts, lambda p: transforms.pca(p, k=2), 2), f"""with a as ({_P}), s as (select avg(v[1]) as mx, avg(v[2]) as my, var_pop(v[1]) as x, var_pop(v[2]) as y, covar_pop(v[1], v[2]) as c from a),
t as (select *, c as u, (y - x) / 2 + sqrt(power((x - y) / 2, 2) + c * c) as w from s)
select bag as bag_id, id as point_id, round(((v[1] - mx) * u + (v[2] - my) * w) / sqrt(u * u + w * w), 6) as f0, round(((v[1] - mx) * w - (v[2] - my) * u) / sqrt(u * u + w * w), 6) as f1 from a, t""")
add("pca_randomized", _rounded(parts, lambda p: transforms.pca(p, k=2, randomize=True), 2), _sql["pca_plane"])
add("condense_kmeans", lambda s, d: _rounded(parts, lambda p: transforms.condense_kmeans(p, 5), 2)(s, d))


add("condense_oversampled", lambda s, d: _rounded(parts, lambda p: transforms.condense_kmeans(p, 5, runs=2), 2)(s, d))


def _one_round_sql(k: int) -> str:
    """Centers of k-means after one round from the k points of the smallest ids; bags of no more than k points as they are."""
    return f"""with a as ({_P}), s as (select bag from a group by bag having count(*) <= {k}), e as (select * from a where bag not in (select bag from s)),
c as (select bag, v as c, row_number() over (partition by bag order by id) - 1 as code from e qualify code < {k}),
d as (select e.bag, e.id, e.v, code, row_number() over (partition by e.bag, e.id order by array_distance(e.v, c), code) as r from e join c on e.bag = c.bag),
m as (select bag, code, avg(v[1]) as a, avg(v[2]) as b from d where r = 1 group by bag, code)
select c.bag as bag_id, c.code::bigint as point_id, round(coalesce(a, c[1]), 6) as f0, round(coalesce(b, c[2]), 6) as f1 from c left join m on c.bag = m.bag and c.code = m.code
union all select bag, id, round(v[1], 6), round(v[2], 6) from a where bag in (select bag from s)"""


add("condense_one_round", lambda s, d: _rounded(parts, lambda p: transforms.condense_kmeans(p, 5, rounds=1), 2)(s, d), _one_round_sql(5))


def jensen_renyi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Between all customers of two nations; null for nations of different sizes, for whose mixture there is no estimator."""
    return divergence.jensen_renyi(balances(spark, sf_dir), [0.8], [3], clamp=False).select("p", "q", "alpha", "k", F.round("value", 6).alias("value"))


def _entropy_sql(n: str, total: str, a: float = 0.8, k: int = 3) -> str:
    return f"ln({divergence.entropy_constant(k, a, 1)!r} * power({n} - 1, {1 - a!r}) * ({total}) / ({n})) / {1 - a!r}"


add("jensen_renyi", jensen_renyi, f"""with e as ({SQL[balances][0]}),
d as (select a.bag as p, a.id as i, b.bag as q, greatest({S.min_dist(1)!r}, array_distance(a.v, b.v)) as d from e a, e b where a.id <> b.id),
n as (select bag, count(*) as n from e group by bag),
own as (select p, i, d, row_number() over (partition by p, i order by d) as r from d where p = q),
h as (select p, {_entropy_sql("any_value(n)", f"sum(power(d, {1 - _A!r}))")} as h from own join n on n.bag = p where r = 3 group by p),
mix as (select x.p, y.bag as q, d.i, d.d, row_number() over (partition by x.p, y.bag, d.i order by d.d) as r from (select bag as p from n) x, n y, d where x.p <> y.bag and d.p = x.p and d.q in (x.p, y.bag)),
t as (select p, q, sum(power(d, {1 - _A!r})) as t from mix where r = 3 group by p, q),
v as (select a.p, a.q, {_entropy_sql("(2 * n.n)", "a.t + b.t")} - (x.h + y.h) / 2 as value from t a join t b on a.p = b.q and a.q = b.p join n on n.bag = a.p join n m on m.bag = a.q join h x on x.p = a.p join h y on y.p = a.q where n.n = m.n)
select p.bag as p, q.bag as q, 0.8::double as alpha, 3::int as k, round(case when p.bag = q.bag then 0 else value end, 6) as value from n p, n q left join v on v.p = p.bag and v.q = q.bag""")


def growing_divs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nations in three batches: each costs the pairs with its own bags."""
    pts = balances(spark, sf_dir)
    grown = growing.GrowingDivergences(spark, f"{checkpoint_folder(spark)}/growing-{uuid.uuid4().hex}", ["renyi:0.8", "kl_raw"], [3])
    for at in range(3):
        grown.add(pts.where(F.col("bag_id") % 3 == at))
    return grown.divs().select("p", "q", "spec", "k", F.round("value", 6).alias("value"))


add("growing_divs", growing_divs, _divs_sql(balances, ["renyi:0.8", "kl_raw"], [3]))
add("js_core", _divs(balances, ["js-core"], [3]), _js_sql("js-core"))


def bow_codewords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bag of words with a codebook learned from all points."""
    pts = vectors(spark, sf_dir)
    return transforms.bag_of_words(pts, transforms.codewords(pts, 8)).select("bag_id", F.col("code").cast("int").alias("code"), "n")


add("bow_codewords", bow_codewords)
add("blank_fill", _rounded(parts, lambda p: transforms.blanks(p, "fill", 975.0), 2))


def _gram(spark: SparkSession, sf_dir: str) -> tuple[list, np.ndarray]:
    divs = kernel.symmetrize(_kl(spark, sf_dir)).persist()
    ids = [r.p for r in divs.select("p").distinct().orderBy("p").collect()]
    return ids, kernel.matrix(divs, ids)


def psd_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of nations that are all alike, as large bags of few values are, every value is 1."""
    ids, d = _gram(spark, sf_dir)
    k = machines.gram(d, machines.sigma_scale(d))
    return spark.createDataFrame([(int(a), int(b), float(k[i, j])) for i, a in enumerate(ids) for j, b in enumerate(ids)], "p int, q int, value double")


def svc_cv_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids, d = _gram(spark, sf_dir)
    y = np.array([int(i) % 2 for i in ids])
    _, preds = machines.crossvalidate(spark, d, y, "SVC")
    return spark.createDataFrame([(int(i), int(a), int(b)) for i, a, b in zip(ids, y, preds)], "bag_id int, label int, pred int")


def svc_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bags of the nations 0 to 14 train a machine that predicts the others'."""
    pts = balances(spark, sf_dir)
    known = pts.where("bag_id < 15")
    m = estimators.BagMachine("SVC", "renyi:0.8")
    return m.fit(known, known.select("bag_id", (F.col("bag_id") % 2).alias("label")).distinct()).predict(pts.where("bag_id >= 15"))


add("svc_predictions", svc_predictions)
add("psd_clip", psd_clip)
add("svc_cv_predictions", svc_cv_predictions)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _queries["kl_k3"](spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
