"""Queries for the commands of the engine, each with SQL that gives the same rows.

Tables without geometry get points and boxes by arithmetic on their keys, so that SQL can repeat it. Numbers that
expressions make are doubles; sums are rounded in both, as their last digits depend on the order of addition.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geolathe.functions import geometry as G
from geolathe.functions.expressions import Translator, format_dms
from geolathe.layer import FID, GEOM, Layer, layer_of, points_of
from geolathe.operators import classify as CL
from geolathe.operators import joins as J
from geolathe.operators import overlay as O
from geolathe.operators import paths as PA
from geolathe.operators import points as P
from geolathe.operators import table as T
from geolathe.operators import topology as TO
from geolathe.plans.pipeline import Pipeline
from geolathe.session import shared_folder, table
from geolathe.sources import io as IO
from geolathe.streaming import stateless as ST

Query = Callable[[SparkSession, str], DataFrame]

KEYS = {"orders": "o_orderkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "nation": "n_nationkey", "region": "r_regionkey", "events": "event_id", "documents": "doc_id", "embeddings": "vec_id", "sites": "site_id", "precincts": "precinct_id", "counties": "county_id"}
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def layer(spark: SparkSession, root: str, name: str) -> Layer:
    df = table(spark, root, name)
    if name == "lineitem":
        df = df.withColumn("_k", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
        return layer_of(df, name, key="_k").with_df(df.select(F.col("_k").alias(FID), *[c for c in df.columns if c != "_k"]))
    return layer_of(df, name, key=KEYS[name])


def out(x: Layer) -> DataFrame:
    return x.df.drop(FID, GEOM)


def commands(spark: SparkSession, root: str, names: list[str], text: str) -> DataFrame:
    """The target that commands over the tables leave."""
    p = Pipeline(spark, {f"{n}.parquet": layer(spark, root, n) for n in names})
    return out(p.run(text).layer())


# --- fields and rows -----------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_totalprice, round(o_totalprice * 1.1, 4) AS gross, CASE WHEN o_totalprice > 150000 THEN 'high' ELSE 'low' END AS band, lower(o_orderpriority) || '/' || o_orderstatus AS label FROM orders")
def each_derive(spark: SparkSession, root: str) -> DataFrame:
    df = commands(spark, root, ["orders"], "-i orders.parquet -each \"gross = o_totalprice * 1.1, band = o_totalprice > 150000 ? 'high' : 'low', label = o_orderpriority.toLowerCase() + '/' + o_orderstatus\"")
    return df.select("o_orderkey", "o_totalprice", F.round("gross", 4).alias("gross"), "band", "label")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN round(l_extendedprice * (1 - l_discount), 4) END AS lost FROM lineitem")
def each_where(spark: SparkSession, root: str) -> DataFrame:
    x = T.each(layer(spark, root, "lineitem"), "lost = l_extendedprice * (1 - l_discount)", where="l_returnflag == 'R'")
    return x.df.select("l_orderkey", "l_linenumber", F.round("lost", 4).alias("lost"))


@query("SELECT * FROM orders WHERE o_totalprice > 200000 AND o_orderstatus <> 'F'")
def filter_expr(spark: SparkSession, root: str) -> DataFrame:
    return commands(spark, root, ["orders"], "-i orders.parquet -filter \"o_totalprice > 200000 && o_orderstatus != 'F'\"")


@query("SELECT * FROM customer WHERE NOT (c_acctbal >= 0)")
def filter_invert(spark: SparkSession, root: str) -> DataFrame:
    return commands(spark, root, ["customer"], "-i customer.parquet -filter 'c_acctbal >= 0' invert")


@query("SELECT * FROM nation WHERE n_nationkey IN (3, 7, 11)")
def filter_ids(spark: SparkSession, root: str) -> DataFrame:
    return commands(spark, root, ["nation"], "-i nation.parquet -filter ids=3,7,11")


CUSTOMER_XY = "CAST((c_custkey * 37) % 360 - 180 AS DOUBLE) AS x, CAST((c_custkey * 53) % 180 - 90 AS DOUBLE) AS y"


def customer_points(spark: SparkSession, root: str) -> Layer:
    x = layer(spark, root, "customer")
    k = F.col("c_custkey")
    df = x.df.withColumns({"x": (k * 37 % 360 - 180).cast("double"), "y": (k * 53 % 180 - 90).cast("double")})
    return points_of(x.with_df(df), "x", "y")


@query(f"SELECT c_custkey, x, y FROM (SELECT c_custkey, {CUSTOMER_XY} FROM customer) WHERE x BETWEEN -60 AND 60 AND y BETWEEN -30 AND 45")
def filter_bbox_points(spark: SparkSession, root: str) -> DataFrame:
    return T.filter_rows(customer_points(spark, root), bbox=[-60, -30, 60, 45]).df.select("c_custkey", "x", "y")


@query("SELECT p_name, p_brand AS brand, p_partkey FROM part")
def filter_fields(spark: SparkSession, root: str) -> DataFrame:
    return commands(spark, root, ["part"], "-i part.parquet -filter-fields p_name,brand=p_brand,p_partkey")


@query("SELECT p_partkey AS id, p_name AS name, p_brand, p_type, p_size, p_retailprice FROM part")
def rename_fields(spark: SparkSession, root: str) -> DataFrame:
    return commands(spark, root, ["part"], "-i part.parquet -rename-fields id=p_partkey,name=p_name")


@query("SELECT p_partkey, p_name, p_type, p_retailprice FROM part")
def drop_fields(spark: SparkSession, root: str) -> DataFrame:
    return commands(spark, root, ["part"], "-i part.parquet -drop fields=p_brand,p_size")


# --- joins ---------------------------------------------------------------------------------------------------------


@query("SELECT c.c_custkey, c.c_name, f.o_orderkey, f.o_totalprice FROM customer c LEFT JOIN (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1) f ON f.o_custkey = c.c_custkey")
def join_keys_first(spark: SparkSession, root: str) -> DataFrame:
    return commands(spark, root, ["customer", "orders"], "-i orders.parquet -i customer.parquet -join orders keys=c_custkey,o_custkey fields=o_orderkey,o_totalprice -filter-fields c_custkey,c_name,o_orderkey,o_totalprice")


@query("SELECT c_custkey, CAST(count(o_orderkey) AS DOUBLE) AS n, round(coalesce(sum(o_totalprice), 0), 2) AS total, round(avg(o_totalprice), 4) AS mean, max(o_totalprice) AS top FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def join_keys_calc(spark: SparkSession, root: str) -> DataFrame:
    df = commands(spark, root, ["customer", "orders"], "-i orders.parquet -i customer.parquet -join orders keys=c_custkey,o_custkey calc='n = count(), total = sum(o_totalprice), mean = average(o_totalprice), top = max(o_totalprice)'")
    return df.select("c_custkey", "n", F.round("total", 2).alias("total"), F.round("mean", 4).alias("mean"), "top")


@query("SELECT n_nationkey, n_name, s_suppkey FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey")
def join_duplication(spark: SparkSession, root: str) -> DataFrame:
    return commands(spark, root, ["nation", "supplier"], "-i supplier.parquet -i nation.parquet -join supplier keys=n_nationkey,s_nationkey fields=s_suppkey duplication -filter-fields n_nationkey,n_name,s_suppkey")


@query("SELECT c_custkey, f.o_orderkey, f.o_totalprice FROM customer LEFT JOIN (SELECT * FROM (SELECT *, max(o_totalprice) OVER (PARTITION BY o_custkey) AS m FROM orders) WHERE o_totalprice = m QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1) f ON f.o_custkey = c_custkey")
def join_where_ismax(spark: SparkSession, root: str) -> DataFrame:
    return commands(spark, root, ["customer", "orders"], "-i orders.parquet -i customer.parquet -join orders keys=c_custkey,o_custkey fields=o_orderkey,o_totalprice where='isMax(o_totalprice)' -filter-fields c_custkey,o_orderkey,o_totalprice")


@query("WITH k AS (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2), m AS (SELECT o_custkey, max(n) AS n FROM k GROUP BY 1), c AS (SELECT o.o_custkey, count(*) AS n FROM orders o JOIN k USING (o_custkey, o_orderpriority) JOIN m ON m.o_custkey = o.o_custkey AND m.n = k.n GROUP BY 1) SELECT c_custkey, CAST(coalesce(c.n, 0) AS DOUBLE) AS n FROM customer LEFT JOIN c ON c.o_custkey = c_custkey")
def join_where_ismode(spark: SparkSession, root: str) -> DataFrame:
    return commands(spark, root, ["customer", "orders"], "-i orders.parquet -i customer.parquet -join orders keys=c_custkey,o_custkey calc='n = count()' where='isMode(o_orderpriority)' -filter-fields c_custkey,n")


@query("SELECT c_custkey, CAST(count(o_orderkey) AS DOUBLE) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > c_acctbal * 20 GROUP BY 1")
def join_where_target(spark: SparkSession, root: str) -> DataFrame:
    return commands(spark, root, ["customer", "orders"], "-i orders.parquet -i customer.parquet -join orders keys=c_custkey,o_custkey calc='n = count()' where='o_totalprice > target.c_acctbal * 20' -filter-fields c_custkey,n")


@query("WITH k AS (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2), s AS (SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2), c AS (SELECT o.o_custkey, count(*) AS n FROM orders o WHERE (SELECT n FROM k WHERE k.o_custkey = o.o_custkey AND k.o_orderpriority = o.o_orderpriority) = (SELECT max(n) FROM k WHERE k.o_custkey = o.o_custkey) AND (SELECT n FROM s WHERE s.o_custkey = o.o_custkey AND s.o_orderstatus = o.o_orderstatus) = (SELECT max(n) FROM s WHERE s.o_custkey = o.o_custkey) GROUP BY 1) SELECT c_custkey, CAST(coalesce(c.n, 0) AS DOUBLE) AS n FROM customer LEFT JOIN c ON c.o_custkey = c_custkey")
def join_where_two_modes(spark: SparkSession, root: str) -> DataFrame:
    return commands(spark, root, ["customer", "orders"], "-i orders.parquet -i customer.parquet -join orders keys=c_custkey,o_custkey calc='n = count()' where='isMode(o_orderpriority) && isMode(o_orderstatus)' -filter-fields c_custkey,n")


HOT_LEFT, HOT_RIGHT = "CASE WHEN l_orderkey % 10 = 0 THEN NULL WHEN l_orderkey % 10 < 4 THEN 1 ELSE l_suppkey END", "CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 5 = 1 THEN 1 ELSE o_custkey % 1000 END"


@query(f"WITH l AS (SELECT l_orderkey, l_linenumber, {HOT_LEFT} AS k FROM lineitem), o AS (SELECT *, {HOT_RIGHT} AS k FROM orders), g AS (SELECT k, count(*) AS n, round(sum(o_totalprice), 2) AS total, min(o_orderkey) AS f FROM o WHERE o_totalprice > 1000 GROUP BY k) SELECT l_orderkey, l_linenumber, CAST(coalesce(n, 0) AS DOUBLE) AS n, coalesce(total, 0) AS total, f AS o_orderkey FROM l LEFT JOIN g ON l.k IS NOT DISTINCT FROM g.k")
def join_null_and_hot_keys(spark: SparkSession, root: str) -> DataFrame:
    """A tenth of one side and a fifth of the other have no key, and one key holds 30 and 20 % of them."""
    left, right = layer(spark, root, "lineitem"), layer(spark, root, "orders")
    left, right = left.with_df(left.df.withColumn("k", F.expr(HOT_LEFT))), right.with_df(right.df.withColumn("k", F.expr(HOT_RIGHT)))
    o = J.JoinOptions(fields=["o_orderkey"], calc="n = count(), total = sum(o_totalprice)", where="o_totalprice > 1000")
    return J.join_keys(left, right, ("k", "k"), o).layer.df.select("l_orderkey", "l_linenumber", "n", F.round("total", 2).alias("total"), "o_orderkey")


@query("SELECT n_nationkey, round(coalesce(sum(c_acctbal), 0), 2) AS c_acctbal FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
def join_sum_fields(spark: SparkSession, root: str) -> DataFrame:
    df = commands(spark, root, ["nation", "customer"], "-i customer.parquet -i nation.parquet -join customer keys=n_nationkey,c_nationkey fields= sum-fields=c_acctbal")
    return df.select("n_nationkey", F.round("c_acctbal", 2).alias("c_acctbal"))


@query("SELECT n_nationkey, n_name, n_regionkey, r_name AS reg_r_name FROM nation LEFT JOIN region ON r_regionkey = n_regionkey")
def join_prefix(spark: SparkSession, root: str) -> DataFrame:
    return commands(spark, root, ["nation", "region"], "-i region.parquet -i nation.parquet -join region keys=n_regionkey,r_regionkey prefix=reg_")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)")
def join_unmatched(spark: SparkSession, root: str) -> DataFrame:
    o = J.JoinOptions(fields=[], where="o_totalprice > 250000")
    return J.join_keys(layer(spark, root, "customer"), layer(spark, root, "orders"), ("c_custkey", "o_custkey"), o).unmatched.select("c_custkey")


@query("SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity >= 49)")
def join_unjoined(spark: SparkSession, root: str) -> DataFrame:
    big = T.filter_rows(layer(spark, root, "lineitem"), "l_quantity >= 49")
    return J.join_keys(big, layer(spark, root, "part"), ("l_partkey", "p_partkey"), J.JoinOptions(fields=[])).unjoined.select("p_partkey")


# --- aggregation ---------------------------------------------------------------------------------------------------


@query("SELECT c_mktsegment, CAST(count(*) AS DOUBLE) AS n, round(sum(o_totalprice), 2) AS total, round(quantile_cont(o_totalprice, 0.5), 4) AS med FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 100000 GROUP BY 1")
def join_filter_dissolve_sort(spark: SparkSession, root: str) -> DataFrame:
    df = commands(spark, root, ["orders", "customer"], "-i customer.parquet -i orders.parquet -join customer keys=o_custkey,c_custkey fields=c_mktsegment -filter 'o_totalprice > 100000' -dissolve c_mktsegment calc='n = count(), total = sum(o_totalprice), med = median(o_totalprice)' -sort total descending")
    return df.select("c_mktsegment", "n", F.round("total", 2).alias("total"), F.round("med", 4).alias("med"))


@query("SELECT l_returnflag, l_linestatus, CAST(count(*) AS DOUBLE) AS n, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice) / count(*), 4) AS mean_price, round(max(l_tax) - min(l_tax), 6) AS spread FROM lineitem GROUP BY 1, 2")
def dissolve_calc(spark: SparkSession, root: str) -> DataFrame:
    df = commands(spark, root, ["lineitem"], "-i lineitem.parquet -dissolve l_returnflag,l_linestatus calc='n = count(), qty = sum(l_quantity), mean_price = sum(l_extendedprice) / count(), spread = max(l_tax) - min(l_tax)'")
    return df.select("l_returnflag", "l_linestatus", "n", F.round("qty", 2).alias("qty"), F.round("mean_price", 4).alias("mean_price"), F.round("spread", 6).alias("spread"))


@query("SELECT o_orderstatus, arg_min(o_orderkey, o_orderkey) AS o_orderkey, round(sum(o_totalprice), 2) AS o_totalprice FROM orders GROUP BY 1")
def dissolve_copy_sum(spark: SparkSession, root: str) -> DataFrame:
    df = commands(spark, root, ["orders"], "-i orders.parquet -dissolve o_orderstatus copy-fields=o_orderkey sum-fields=o_totalprice")
    return df.select("o_orderstatus", "o_orderkey", F.round("o_totalprice", 2).alias("o_totalprice"))


@query("SELECT c_custkey, c_mktsegment, NULL::DOUBLE AS n FROM customer WHERE NOT c_acctbal < 0 UNION ALL SELECT NULL, c_mktsegment, CAST(count(*) AS DOUBLE) FROM customer WHERE c_acctbal < 0 GROUP BY c_mktsegment")
def dissolve_where(spark: SparkSession, root: str) -> DataFrame:
    x = T.dissolve(layer(spark, root, "customer"), ["c_mktsegment"], "n = count()", where="c_acctbal < 0")
    return x.df.select("c_custkey", "c_mktsegment", "n")


@query("SELECT CAST(count(*) AS DOUBLE) AS n, round(avg(o_totalprice), 4) AS mean FROM orders")
def dissolve_all(spark: SparkSession, root: str) -> DataFrame:
    return T.dissolve(layer(spark, root, "orders"), calc="n = count(), mean = mean(o_totalprice)").df.select("n", F.round("mean", 4).alias("mean"))


@query("SELECT event_type, round(avg(coalesce(CASE WHEN user_id % 3 = 0 THEN NULL ELSE value END, 0)), 6) AS m FROM events GROUP BY 1")
def calc_mean_nulls(spark: SparkSession, root: str) -> DataFrame:
    x = T.each(layer(spark, root, "events"), "v = user_id % 3 == 0 ? null : value")
    return T.dissolve(x, ["event_type"], "m = mean(v)").df.select("event_type", F.round("m", 6).alias("m"))


@query("SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.5), 4) AS med, round(quantile_cont(l_extendedprice, 0.25), 4) AS q1, round(quantile_cont(l_extendedprice, 0.9), 4) AS q90, round(quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25), 4) AS spread FROM lineitem GROUP BY 1")
def calc_quantiles(spark: SparkSession, root: str) -> DataFrame:
    x = T.dissolve(layer(spark, root, "lineitem"), ["l_returnflag"], "med = median(l_extendedprice), q1 = quartile1(l_extendedprice), q90 = quantile(l_extendedprice, 0.9), spread = iqr(l_extendedprice)")
    return x.df.select("l_returnflag", *[F.round(c, 4).alias(c) for c in ("med", "q1", "q90", "spread")])


@query("SELECT o_custkey, o_orderpriority AS p FROM (SELECT o_custkey, o_orderpriority, count(*) AS n, min(o_orderkey) AS f FROM orders GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, f) = 1")
def calc_mode_first(spark: SparkSession, root: str) -> DataFrame:
    return T.dissolve(layer(spark, root, "orders"), ["o_custkey"], "p = mode(o_orderpriority)").df.select("o_custkey", "p")


@query("SELECT o_custkey, string_agg(o_orderstatus, ',' ORDER BY o_orderkey) AS statuses, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS ids FROM orders GROUP BY 1")
def calc_collect(spark: SparkSession, root: str) -> DataFrame:
    x = T.dissolve(layer(spark, root, "orders"), ["o_custkey"], "s = collect(o_orderstatus), i = collectIds()")
    return x.df.select("o_custkey", F.array_join("s", ",").alias("statuses"), F.array_join(F.col("i").cast("array<string>"), ",").alias("ids"))


@query("SELECT o_custkey, bool_and(o_totalprice > 20000) AS all_big, bool_or(o_orderstatus = 'P') AS any_p FROM orders GROUP BY 1")
def calc_every_some(spark: SparkSession, root: str) -> DataFrame:
    return T.dissolve(layer(spark, root, "orders"), ["o_custkey"], "all_big = every(o_totalprice > 20000), any_p = some(o_orderstatus == 'P')").df.drop(FID)


@query("SELECT user_id, arg_min(event_type, event_id) AS f, arg_max(event_type, event_id) AS l FROM events GROUP BY 1")
def calc_first_last(spark: SparkSession, root: str) -> DataFrame:
    return T.dissolve(layer(spark, root, "events"), ["user_id"], "f = first(event_type), l = last(event_type)").df.drop(FID)


@query("SELECT label, i - 1 AS i, round(sum(v), 4) AS total FROM (SELECT label, unnest(embedding) AS v, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY 1, 2")
def calc_sums(spark: SparkSession, root: str) -> DataFrame:
    x = T.dissolve(layer(spark, root, "embeddings"), ["label"], "s = sums(embedding)")
    return x.df.select("label", F.posexplode("s").alias("i", "total")).select("label", F.col("i").cast("long").alias("i"), F.round("total", 4).alias("total"))


# --- duplicates, order, sets ---------------------------------------------------------------------------------------


@query("SELECT event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1")
def uniq_first(spark: SparkSession, root: str) -> DataFrame:
    return T.uniq(layer(spark, root, "events"), "user_id").df.select("event_id", "user_id")


@query("SELECT event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) <= 3")
def uniq_max_count(spark: SparkSession, root: str) -> DataFrame:
    return commands(spark, root, ["events"], "-i events.parquet -uniq user_id max-count=3 -filter-fields event_id,user_id")


@query('SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS "index" FROM events')
def uniq_index(spark: SparkSession, root: str) -> DataFrame:
    return T.uniq(layer(spark, root, "events"), "user_id", index=True).df.select("event_id", "index")


@query("SELECT event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) > 1")
def uniq_invert(spark: SparkSession, root: str) -> DataFrame:
    return T.uniq(layer(spark, root, "events"), "user_id", invert=True).df.select("event_id")


@query("SELECT l_orderkey, l_linenumber, l_suppkey, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey * 10 + l_linenumber) <= 2")
def sort_topk(spark: SparkSession, root: str) -> DataFrame:
    return commands(spark, root, ["lineitem"], "-i lineitem.parquet -sort l_extendedprice descending -uniq l_suppkey max-count=2 -filter-fields l_orderkey,l_linenumber,l_suppkey,l_extendedprice")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) - 1 AS rank FROM orders")
def sort_rank(spark: SparkSession, root: str) -> DataFrame:
    return T.sort(layer(spark, root, "orders"), "o_totalprice", descending=True).df.select("o_orderkey", F.col(FID).alias("rank"))


@query("SELECT c_custkey AS id, c_name AS name, c_acctbal AS bal FROM customer UNION ALL SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def merge_layers(spark: SparkSession, root: str) -> DataFrame:
    return commands(spark, root, ["customer", "supplier"], "-i customer.parquet -filter-fields id=c_custkey,name=c_name,bal=c_acctbal -i supplier.parquet -filter-fields id=s_suppkey,name=s_name,bal=s_acctbal -merge-layers target=customer,supplier name=all")


@query("SELECT c_custkey AS id, c_mktsegment AS seg, NULL AS bal FROM customer UNION ALL SELECT s_suppkey, NULL, s_acctbal FROM supplier")
def merge_layers_force(spark: SparkSession, root: str) -> DataFrame:
    return commands(spark, root, ["customer", "supplier"], "-i customer.parquet -filter-fields id=c_custkey,seg=c_mktsegment -i supplier.parquet -filter-fields id=s_suppkey,bal=s_acctbal -merge-layers force target=customer,supplier name=all")


@query(f"WITH p AS (SELECT c_custkey, {CUSTOMER_XY} FROM customer), b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM p) SELECT c_custkey, 'r' || CAST(least(3, greatest(1, floor((y - y0) / (y1 - y0) * 3) + 1)) AS INTEGER) || 'c' || CAST(least(4, greatest(1, floor((x - x0) / (x1 - x0) * 4) + 1)) AS INTEGER) AS cell FROM p, b")
def split_on_grid(spark: SparkSession, root: str) -> DataFrame:
    return T.split_on_grid(customer_points(spark, root), 4, 3).select("c_custkey", "cell")


# --- classification ------------------------------------------------------------------------------------------------


def _ranked(n: str, name: str, k: int) -> str:
    return ", ".join(f"(SELECT {n} FROM s WHERE i = (SELECT count(*) * {j} // {k} FROM s)) AS b{j}" for j in range(1, k))


@query(f"WITH s AS (SELECT o_totalprice, row_number() OVER (ORDER BY o_totalprice) - 1 AS i FROM orders WHERE o_totalprice IS NOT NULL), b AS (SELECT {_ranked('o_totalprice', 'orders', 4)}) SELECT o_orderkey, CAST((o_totalprice >= b1) AS INTEGER) + CAST((o_totalprice >= b2) AS INTEGER) + CAST((o_totalprice >= b3) AS INTEGER) AS class FROM orders, b")
def classify_quantile(spark: SparkSession, root: str) -> DataFrame:
    return CL.classify(layer(spark, root, "orders"), "o_totalprice", quantile=True, classes=4).df.select("o_orderkey", "class")


@query("WITH b AS (SELECT min(o_totalprice) AS a, max(o_totalprice) AS z FROM orders) SELECT o_orderkey, " + " + ".join(f"CAST(o_totalprice >= a + (z - a) * {j} / 5 AS INTEGER)" for j in range(1, 5)) + " AS class FROM orders, b")
def classify_equal_interval(spark: SparkSession, root: str) -> DataFrame:
    return CL.classify(layer(spark, root, "orders"), "o_totalprice", equal_interval=True, classes=5).df.select("o_orderkey", "class")


@query(f"WITH s AS (SELECT o_totalprice, row_number() OVER (ORDER BY o_totalprice) - 1 AS i FROM orders), b AS (SELECT {_ranked('o_totalprice', 'orders', 5)}), n AS (SELECT min(o_totalprice) AS a, max(o_totalprice) AS z FROM orders, b WHERE o_totalprice >= b1 AND o_totalprice < b4) SELECT o_orderkey, CAST(o_totalprice >= b1 AS INTEGER) + CAST(o_totalprice >= a + (z - a) * 1 / 3 AS INTEGER) + CAST(o_totalprice >= a + (z - a) * 2 / 3 AS INTEGER) + CAST(o_totalprice >= b4 AS INTEGER) AS class FROM orders, b, n")
def classify_hybrid(spark: SparkSession, root: str) -> DataFrame:
    return CL.classify(layer(spark, root, "orders"), "o_totalprice", hybrid=True, classes=5).df.select("o_orderkey", "class")


@query("SELECT p_partkey, CASE WHEN p_size < 10 THEN 'red' WHEN p_size < 30 THEN 'green' ELSE 'blue' END AS fill FROM part")
def classify_breaks(spark: SparkSession, root: str) -> DataFrame:
    return commands(spark, root, ["part"], "-i part.parquet -classify p_size breaks=10,30 colors=red,green,blue save-as=fill -filter-fields p_partkey,fill")


@query("SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 1.0 WHEN 'MACHINERY' THEN 2.0 ELSE 9.0 END::DOUBLE AS v FROM customer")
def classify_categorical(spark: SparkSession, root: str) -> DataFrame:
    return CL.classify(layer(spark, root, "customer"), "c_mktsegment", save_as="v", categories=["BUILDING", "MACHINERY"], values=[1.0, 2.0], other=9.0).df.select("c_custkey", "v")


@query("SELECT n_nationkey, ['a', 'b', 'c', 'd', 'e'][n_regionkey + 1] AS v FROM nation")
def classify_indexed(spark: SparkSession, root: str) -> DataFrame:
    return CL.classify(layer(spark, root, "nation"), "n_regionkey", save_as="v", method="indexed", values=["a", "b", "c", "d", "e"]).df.select("n_nationkey", "v")


@query("WITH b AS (SELECT CAST(min(p_retailprice) AS DOUBLE) AS a, CAST(max(p_retailprice) AS DOUBLE) AS z FROM part) SELECT p_partkey, round((p_retailprice - a) / (z - a) * 100, 4) AS v FROM part, b")
def classify_continuous(spark: SparkSession, root: str) -> DataFrame:
    x = CL.classify(layer(spark, root, "part"), "p_retailprice", save_as="v", equal_interval=True, continuous=True, values=[0.0, 100.0])
    return x.df.select("p_partkey", F.round("v", 4).alias("v"))


@query("""
WITH RECURSIVE m AS (SELECT o_orderkey AS i, o_custkey AS k FROM orders UNION ALL SELECT o_orderkey, o_orderkey // 8 + 10000000 FROM orders),
r(i, c) USING KEY (i) AS (SELECT o_orderkey, o_orderkey FROM orders
UNION SELECT q.i, q.c FROM (SELECT b.i, min(r.c) AS c FROM r JOIN m a ON a.i = r.i JOIN m b ON b.k = a.k GROUP BY b.i) q JOIN recurring.r p ON p.i = q.i WHERE q.c < p.c)
SELECT i AS o_orderkey, c AS component FROM r
""")
def blacki_components(spark: SparkSession, root: str) -> DataFrame:
    """Every order with both of its memberships: its customer, and a range of eight keys."""
    o = table(spark, root, "orders")
    return CL.components(o.select("o_orderkey", F.array("o_custkey", F.floor(F.col("o_orderkey") / 8) + 10000000).alias("m")), "o_orderkey", "m")


# --- points and grids ----------------------------------------------------------------------------------------------


@query(f"SELECT c_custkey, x, y FROM (SELECT c_custkey, {CUSTOMER_XY} FROM customer)")
def points_xy(spark: SparkSession, root: str) -> DataFrame:
    x = P.points_from_fields(customer_points(spark, root).with_df(customer_points(spark, root).df.drop(GEOM), geometry_type=None))
    g = F.col(GEOM)[0]
    return x.df.select("c_custkey", g[0].alias("x"), g[1].alias("y"))


@query("SELECT CAST(-180 + 18 + (i % 10) * 36.0 AS DOUBLE) AS x, CAST(-90 + 18 + (i // 10) * 36.0 AS DOUBLE) AS y FROM range(50) t(i)")
def point_grid(spark: SparkSession, root: str) -> DataFrame:
    g = F.col(GEOM)[0]
    return P.point_grid(spark, cols=10, rows=5).df.select(g[0].alias("x"), g[1].alias("y"))


@query("SELECT CAST(c AS DOUBLE) * 10 AS x0, CAST(r AS DOUBLE) * 10 AS y0 FROM range(6) a(c), range(4) b(r)")
def grid_square(spark: SparkSession, root: str) -> DataFrame:
    b = G.bounds(F.col(GEOM), False)
    return P.polygon_grid(spark, [0.0, 0.0, 60.0, 40.0], "square", interval=10).df.select(b["xmin"].alias("x0"), b["ymin"].alias("y0"))


def supplier_points(spark: SparkSession, root: str) -> Layer:
    x = layer(spark, root, "supplier")
    k = F.col("s_suppkey")
    return points_of(x.with_df(x.df.withColumns({"x": (k * 29 % 360 - 180).cast("double"), "y": (k * 31 % 180 - 90).cast("double")})), "x", "y")


SUPPLIER_XY = "CAST((s_suppkey * 29) % 360 - 180 AS DOUBLE) AS x, CAST((s_suppkey * 31) % 180 - 90 AS DOUBLE) AS y"


@query(f"WITH s AS (SELECT s_suppkey, s_acctbal, {SUPPLIER_XY} FROM supplier), c AS (SELECT c_custkey, {CUSTOMER_XY} FROM customer) SELECT s_suppkey, CAST(count(c_custkey) AS DOUBLE) AS n FROM s LEFT JOIN c ON (s.x - c.x) * (s.x - c.x) + (s.y - c.y) * (s.y - c.y) <= 36 GROUP BY 1")
def join_points_points(spark: SparkSession, root: str) -> DataFrame:
    s, c = supplier_points(spark, root), customer_points(spark, root)
    r = J.join(s, c, J.spatial_matches(s, c, max_distance=6.0), J.JoinOptions(calc="n = count()"))
    return r.layer.df.select("s_suppkey", "n")


BOXES = "SELECT n_nationkey, CAST((n_nationkey % 5) * 70 - 175 AS DOUBLE) AS x0, CAST((n_nationkey // 5) * 35 - 85 AS DOUBLE) AS y0, CAST((n_nationkey % 5) * 70 - 175 + 60.5 AS DOUBLE) AS x1, CAST((n_nationkey // 5) * 35 - 85 + 30.5 AS DOUBLE) AS y1 FROM nation"


def boxes(spark: SparkSession, root: str) -> Layer:
    x = layer(spark, root, "nation")
    k = F.col("n_nationkey")
    x0, y0 = (k % 5 * 70 - 175).cast("double"), (F.floor(k / 5) * 35 - 85).cast("double")
    x1, y1 = x0 + 60.5, y0 + 30.5
    ring = F.array(*[F.array(a, b) for a, b in ((x0, y0), (x0, y1), (x1, y1), (x1, y0), (x0, y0))])
    return x.with_df(x.df.withColumn(GEOM, F.array(ring)), geometry_type="polygon")


@query(f"WITH c AS (SELECT c_custkey, {CUSTOMER_XY} FROM customer), b AS ({BOXES}) SELECT c_custkey, n_nationkey AS nat FROM c LEFT JOIN b ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1")
def join_points_polygons(spark: SparkSession, root: str) -> DataFrame:
    c, b = customer_points(spark, root), boxes(spark, root)
    b = T.each(b, "nat = n_nationkey")
    r = J.join(c, b, J.spatial_matches(c, b), J.JoinOptions(fields=["nat"]))
    return r.layer.df.select("c_custkey", F.col("nat").cast("int").alias("nat"))


@query(f"WITH c AS (SELECT c_custkey, c_acctbal, {CUSTOMER_XY} FROM customer), b AS ({BOXES}) SELECT n_nationkey, CAST(count(c_custkey) AS DOUBLE) AS n, round(coalesce(sum(c_acctbal), 0), 2) AS bal FROM b LEFT JOIN c ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 GROUP BY 1")
def join_polygons_points(spark: SparkSession, root: str) -> DataFrame:
    c, b = customer_points(spark, root), boxes(spark, root)
    r = J.join(b, c, J.spatial_matches(b, c), J.JoinOptions(calc="n = count(), bal = sum(c_acctbal)"))
    return r.layer.df.select("n_nationkey", "n", F.round("bal", 2).alias("bal"))


@query(f"WITH a AS ({BOXES}), b AS (SELECT n_nationkey AS k, x0 + 20 AS u0, y0 + 10 AS v0, x1 + 20 AS u1, y1 + 10 AS v1 FROM a) SELECT n_nationkey, k AS other, round((least(x1, u1) - greatest(x0, u0)) * (least(y1, v1) - greatest(y0, v0)), 6) AS area FROM a JOIN b ON x0 < u1 AND u0 < x1 AND y0 < v1 AND v0 < y1")
def overlap_areas(spark: SparkSession, root: str) -> DataFrame:
    a = boxes(spark, root)
    b = P.affine(a, shift=(20.0, 10.0))
    return O.overlap_areas(a, b).select(F.col("_t").cast("int").alias("n_nationkey"), F.col("_s").cast("int").alias("other"), F.round("area", 6).alias("area"))


@query(f"WITH a AS ({BOXES}) SELECT n_nationkey, round((least(x1, 50) - greatest(x0, -50)) * (least(y1, 40) - greatest(y0, -40)), 6) AS area FROM a WHERE x0 < 50 AND x1 > -50 AND y0 < 40 AND y1 > -40")
def clip_bbox_polygons(spark: SparkSession, root: str) -> DataFrame:
    x = PA.clip_bbox(boxes(spark, root), [-50, -40, 50, 40])
    return x.with_df(x.settled).df.select("n_nationkey", F.round(G.area(F.col(GEOM)), 6).alias("area"))


@query(f"WITH a AS ({BOXES}), b AS (SELECT n_nationkey AS k, x0 + 20 AS u0, y0 + 10 AS v0, x1 + 20 AS u1, y1 + 10 AS v1 FROM a), o AS (SELECT n_nationkey, sum((least(x1, u1) - greatest(x0, u0)) * (least(y1, v1) - greatest(y0, v0))) AS s FROM a JOIN b ON x0 < u1 AND u0 < x1 AND y0 < v1 AND v0 < y1 GROUP BY 1) SELECT a.n_nationkey, round((x1 - x0) * (y1 - y0) - coalesce(s, 0), 6) AS area FROM a LEFT JOIN o USING (n_nationkey)")
def erase_polygons(spark: SparkSession, root: str) -> DataFrame:
    a = boxes(spark, root)
    x = O.clip(a, P.affine(a, shift=(20.0, 10.0)), erase=True)
    return x.settled.select("n_nationkey", F.round(G.area(F.col(GEOM)), 6).alias("area"))


@query(f"SELECT n_nationkey, round((x1 - x0) * (y1 - y0), 6) AS area, round(2 * ((x1 - x0) + (y1 - y0)), 6) AS perimeter, round((x0 + x1) / 2, 6) AS cx, round((y0 + y1) / 2, 6) AS cy, x0 AS xmin, y1 AS ymax, round(4 * pi() * (x1 - x0) * (y1 - y0) / pow(2 * ((x1 - x0) + (y1 - y0)), 2), 6) AS compact FROM ({BOXES})")
def polygon_scalars(spark: SparkSession, root: str) -> DataFrame:
    x = T.each(boxes(spark, root), "area = this.area, perimeter = this.perimeter, cx = this.centroidX, cy = this.centroidY, xmin = this.bbox[0], ymax = this.bbox[3], compact = this.compactness")
    return x.df.select("n_nationkey", *[F.round(c, 6).alias(c) for c in ("area", "perimeter", "cx", "cy")], "xmin", "ymax", F.round("compact", 6).alias("compact"))


@query(f"SELECT c_mktsegment, round(avg(x), 6) AS x, round(avg(y), 6) AS y, CAST(count(*) AS DOUBLE) AS n FROM (SELECT c_mktsegment, {CUSTOMER_XY} FROM customer) GROUP BY 1")
def dissolve_points_centroid(spark: SparkSession, root: str) -> DataFrame:
    x = P.dissolve_points(customer_points(spark, root), ["c_mktsegment"], calc="n = count()")
    g = F.col(GEOM)[0]
    return x.df.select("c_mktsegment", F.round(g[0], 6).alias("x"), F.round(g[1], 6).alias("y"), "n")


@query(f"SELECT c_mktsegment, round(sum(x * c_acctbal) / sum(c_acctbal), 4) AS x, round(sum(y * c_acctbal) / sum(c_acctbal), 4) AS y FROM (SELECT c_mktsegment, c_acctbal, {CUSTOMER_XY} FROM customer) WHERE c_acctbal > 0 GROUP BY 1")
def dissolve_points_weighted(spark: SparkSession, root: str) -> DataFrame:
    x = P.dissolve_points(customer_points(spark, root), ["c_mktsegment"], weight="c_acctbal")
    g = F.col(GEOM)[0]
    return x.df.select("c_mktsegment", F.round(g[0], 4).alias("x"), F.round(g[1], 4).alias("y"))


@query(f"SELECT c_custkey, round(-2 * (y - 2) + 1 + 5, 6) AS x, round(2 * (x - 1) + 2 - 3, 6) AS y FROM (SELECT c_custkey, {CUSTOMER_XY} FROM customer)")
def affine_points(spark: SparkSession, root: str) -> DataFrame:
    x = P.affine(customer_points(spark, root), shift=(5.0, -3.0), scale=2.0, rotate=90.0, anchor=(1.0, 2.0))
    g = F.col(GEOM)[0]
    return x.df.select("c_custkey", F.round(g[0], 6).alias("x"), F.round(g[1], 6).alias("y"))


@query(f"SELECT c_custkey FROM (SELECT c_custkey, {CUSTOMER_XY} FROM customer) WHERE x BETWEEN 0 AND 90 AND y BETWEEN 0 AND 45")
def clip_bbox_points(spark: SparkSession, root: str) -> DataFrame:
    return P.clip_points(customer_points(spark, root), [0, 0, 90, 45]).df.select("c_custkey")


@query(f"SELECT c_custkey FROM (SELECT c_custkey, {CUSTOMER_XY} FROM customer) WHERE NOT (x BETWEEN 0 AND 90 AND y BETWEEN 0 AND 45)")
def erase_bbox_points(spark: SparkSession, root: str) -> DataFrame:
    return P.clip_points(customer_points(spark, root), [0, 0, 90, 45], erase=True).df.select("c_custkey")


# --- expressions ---------------------------------------------------------------------------------------------------


@query("SELECT c_custkey, CASE WHEN v < 0 THEN '-' ELSE '' END || CAST(floor(round(abs(v) * 3600) / 3600) AS BIGINT) || '°' || lpad(CAST(CAST(floor(round(abs(v) * 3600) / 60) AS BIGINT) % 60 AS VARCHAR), 2, '0') || '′' || lpad(CAST(CAST(round(abs(v) * 3600) AS BIGINT) % 60 AS VARCHAR), 2, '0') || '″' AS dms FROM (SELECT c_custkey, (c_custkey * 7919 % 360000 - 180000) / 1000.0 AS v FROM customer)")
def dms_format(spark: SparkSession, root: str) -> DataFrame:
    v = (F.col("c_custkey") * 7919 % 360000 - 180000) / 1000.0
    return table(spark, root, "customer").select("c_custkey", format_dms(v.cast("double"), "[-]D°MM′SS″").alias("dms"))


@query("SELECT c_custkey, round((c_custkey % 90) + 1 + (c_custkey % 60) / 60.0 + (c_custkey % 50) / 3600.0, 8) * CASE WHEN c_custkey % 2 = 0 THEN -1 ELSE 1 END AS v FROM customer")
def dms_parse(spark: SparkSession, root: str) -> DataFrame:
    k = F.col("c_custkey")
    s = F.concat((k % 90 + 1).cast("string"), F.lit("°"), (k % 60).cast("string"), F.lit("′"), (k % 50).cast("string"), F.lit("″"), F.when(k % 2 == 0, "S").otherwise("N"))
    df = table(spark, root, "customer").select("c_custkey", s.alias("s"))
    return df.select("c_custkey", F.round(Translator.of(df.schema).column("parse_dms(s)").col, 8).alias("v"))


@query("SELECT o_orderkey, printf('%08.1f', floor(o_totalprice * 10 + 0.5) / 10) AS a, printf('%d items', CAST(o_orderkey AS BIGINT)) AS b FROM orders")
def sprintf_fmt(spark: SparkSession, root: str) -> DataFrame:
    x = T.each(layer(spark, root, "orders"), "a = sprintf('%08.1f', o_totalprice), b = sprintf('%d items', o_orderkey)")
    return x.df.select("o_orderkey", "a", "b")


@query("SELECT c_custkey, floor(c_acctbal * 10 + 0.5) / 10 AS r FROM customer")
def round_half_up(spark: SparkSession, root: str) -> DataFrame:
    return T.each(layer(spark, root, "customer"), "r = round(c_acctbal, 1)").df.select("c_custkey", "r")


@query("SELECT p_partkey, substr(p_name, 1, 5) AS a, strpos(p_type, 'BRASS') - 1.0::DOUBLE AS b, replace(p_brand, '#', '-') AS c, CAST(length(p_name) AS DOUBLE) AS d, p_type LIKE 'PROMO%' AS e FROM part")
def string_functions(spark: SparkSession, root: str) -> DataFrame:
    x = T.each(layer(spark, root, "part"), "a = p_name.substr(0, 5), b = p_type.indexOf('BRASS'), c = p_brand.replace('#', '-'), d = p_name.length, e = p_type.startsWith('PROMO')")
    return x.df.select("p_partkey", "a", "b", "c", "d", "e")


@query("SELECT CAST((SELECT count(*) FROM orders) AS BIGINT) AS feature_count, (SELECT CAST(o_orderkey AS VARCHAR) FROM orders ORDER BY o_orderkey LIMIT 1) AS first_value, 'o_orderkey' AS field UNION ALL SELECT (SELECT count(*) FROM orders), (SELECT o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 1), 'o_orderstatus'")
def info_layer(spark: SparkSession, root: str) -> DataFrame:
    i = T.info(layer(spark, root, "orders"))
    rows = [(int(i["feature_count"]), a["first_value"], a["field"]) for a in i["attribute_data"] if a["field"] in ("o_orderkey", "o_orderstatus")]  # type: ignore[attr-defined,call-overload]
    return spark.createDataFrame(rows, "feature_count bigint, first_value string, field string")


@query("SELECT 'n = count()' AS expression, CAST(count(*) AS VARCHAR) AS value, 'orders' AS layer_name FROM orders UNION ALL SELECT 'max(o_orderkey)', CAST(max(o_orderkey) AS VARCHAR), 'orders' FROM orders")
def calc_table(spark: SparkSession, root: str) -> DataFrame:
    return T.calc_table(layer(spark, root, "orders"), "n = count(), max(o_orderkey)")


# --- lines, borders, tiles -----------------------------------------------------------------------------------------


def precinct_layer(spark: SparkSession, root: str) -> Layer:
    """The precincts as polygons: rings closed and turned as layers want them."""
    from geolathe.sources.formats import polygon_parts

    df = table(spark, root, "precincts")
    shape = PA.kernel(lambda polygons: polygon_parts(polygons), PA.PATH)
    made = df.select(F.col("precinct_id").alias(FID), "precinct_code", "county", "district", shape(F.col("coordinates")).alias(GEOM))
    return Layer(made, "precincts", "polygon")


# rings of the precincts, closed or not, as edges without repeated points; areas count holes against their polygon
EDGES = """
r AS (SELECT precinct_id AS id, county, p, k, coordinates[p][k] AS ring FROM (SELECT precinct_id, county, coordinates, p, unnest(range(1, len(coordinates[p]) + 1)) AS k FROM (SELECT precinct_id, county, coordinates, unnest(range(1, len(coordinates) + 1)) AS p FROM precincts))),
e AS (SELECT id, county, p, k, ring[i][1] AS ax, ring[i][2] AS ay, ring[i % len(ring) + 1][1] AS cx, ring[i % len(ring) + 1][2] AS cy FROM (SELECT *, unnest(range(1, len(ring) + 1)) AS i FROM r)),
s AS (SELECT DISTINCT id, CASE WHEN ax < cx OR (ax = cx AND ay < cy) THEN [ax, ay] ELSE [cx, cy] END AS p, CASE WHEN ax < cx OR (ax = cx AND ay < cy) THEN [cx, cy] ELSE [ax, ay] END AS q FROM e WHERE ax <> cx OR ay <> cy),
l AS (SELECT a.id AS a, b.id AS b, sum(sqrt((a.p[1] - a.q[1]) ** 2 + (a.p[2] - a.q[2]) ** 2)) AS len FROM s a JOIN s b ON a.p = b.p AND a.q = b.q AND a.id < b.id GROUP BY 1, 2),
f AS (SELECT id, county, sum(CASE WHEN k = 1 THEN area ELSE -area END) AS area FROM (SELECT id, county, p, k, abs(sum(ax * cy - cx * ay)) / 2 AS area FROM e GROUP BY ALL) GROUP BY ALL)
"""


@query(f"WITH {EDGES} SELECT county, CAST(count(*) AS DOUBLE) AS n, round(sum(area), 6) AS area FROM f GROUP BY 1")
def dissolve_polygons(spark: SparkSession, root: str) -> DataFrame:
    x = TO.dissolve_polygons(precinct_layer(spark, root), ["county"], "n = count()")
    return x.settled.select("county", "n", F.round(G.area(F.col(GEOM)), 6).alias("area"))


@query(None)
def data_fill(spark: SparkSession, root: str) -> DataFrame:
    return TO.data_fill(precinct_layer(spark, root), "county").df.select("precinct_code", "county")


@query(None)
def simplify_percentage(spark: SparkSession, root: str) -> DataFrame:
    x = PA.simplify(precinct_layer(spark, root), percentage=0.3)
    return x.settled.select("precinct_code", G.over_parts(F.col(GEOM), lambda r: F.size(r).cast("double")).alias("vertices"))


@query(f"WITH {EDGES} SELECT row_number() OVER (ORDER BY a, b) - 1 AS id, round(len, 6) AS length FROM l")
def innerlines(spark: SparkSession, root: str) -> DataFrame:
    x = TO.innerlines(precinct_layer(spark, root))
    return x.settled.select(FID, F.round(G.length(F.col(GEOM)), 6).alias("length")).withColumnRenamed(FID, "id")


SHIFTED = f"WITH a AS ({BOXES}), b AS (SELECT n_nationkey AS k, x0 + 20 AS u0, y0 + 10 AS v0, x1 + 20 AS u1, y1 + 10 AS v1 FROM a), o AS (SELECT n_nationkey AS i, k AS j, (least(x1, u1) - greatest(x0, u0)) * (least(y1, v1) - greatest(y0, v0)) AS s FROM a JOIN b ON x0 < u1 AND u0 < x1 AND y0 < v1 AND v0 < y1)"


@query(f"{SHIFTED} SELECT i AS n_nationkey, j AS n_nationkey_2, round(s, 6) AS area FROM o UNION ALL SELECT n_nationkey, NULL, round((x1 - x0) * (y1 - y0) - coalesce((SELECT sum(s) FROM o WHERE i = n_nationkey), 0), 6) FROM a UNION ALL SELECT NULL, k, round((u1 - u0) * (v1 - v0) - coalesce((SELECT sum(s) FROM o WHERE j = k), 0), 6) FROM b")
def union_tiles(spark: SparkSession, root: str) -> DataFrame:
    a = boxes(spark, root)
    x = O.union([a, P.affine(a, shift=(20.0, 10.0))])
    tiles = x.settled.select("n_nationkey", "n_nationkey_2", G.area(F.col(GEOM)).alias("a"))
    return tiles.groupBy("n_nationkey", "n_nationkey_2").agg(F.round(F.sum("a"), 6).alias("area"))


@query(f"{SHIFTED} SELECT CAST(2 AS DOUBLE) AS n, round(sum(s), 5) AS area FROM o UNION ALL SELECT 1.0, round((SELECT sum((x1 - x0) * (y1 - y0)) FROM a) * 2 - 2 * sum(s), 5) FROM o")
def mosaic_calc(spark: SparkSession, root: str) -> DataFrame:
    from geolathe.operators.table import merge_layers as merged

    a = boxes(spark, root)
    x = O.mosaic(merged([a, P.affine(a, shift=(20.0, 10.0))]), "n = count()")
    return x.settled.select("n", G.area(F.col(GEOM)).alias("a")).groupBy("n").agg(F.round(F.sum("a"), 5).alias("area"))


@query(f"{SHIFTED} SELECT n_nationkey, round((x1 - x0) * (y1 - y0), 6) AS area FROM a UNION ALL SELECT k + 100, round((u1 - u0) * (v1 - v0) - coalesce((SELECT sum(s) FROM o WHERE j = k), 0), 6) FROM b")
def clean_overlaps(spark: SparkSession, root: str) -> DataFrame:
    from geolathe.operators.table import merge_layers as merged

    a = boxes(spark, root)
    b = P.affine(a, shift=(20.0, 10.0))
    x = O.clean(merged([a, b.with_df(b.df.withColumn("n_nationkey", F.col("n_nationkey") + 100))]))
    return x.settled.select("n_nationkey", F.round(G.area(F.col(GEOM)), 6).alias("area"))


@query(f"{SHIFTED} SELECT n_nationkey, round(sum(s / ((u1 - u0) * (v1 - v0)) * (k + 1)), 6) AS v FROM a LEFT JOIN (SELECT i, j, s, u0, u1, v0, v1, k FROM o JOIN b ON j = k) ON i = n_nationkey GROUP BY 1")
def join_interpolate(spark: SparkSession, root: str) -> DataFrame:
    a = boxes(spark, root)
    b = T.each(P.affine(a, shift=(20.0, 10.0)), "v = n_nationkey + 1")
    return J.interpolated(a, b, ["v"]).df.select("n_nationkey", F.round("v", 6).alias("v"))


@query(f"{SHIFTED} SELECT n_nationkey, j AS other FROM a LEFT JOIN (SELECT i, j FROM o QUALIFY row_number() OVER (PARTITION BY i ORDER BY round(s, 6) DESC, j DESC) = 1) ON i = n_nationkey")
def join_largest_overlap(spark: SparkSession, root: str) -> DataFrame:
    a = boxes(spark, root)
    b = P.affine(a, shift=(20.0, 10.0))
    pairs = O.overlap_areas(a, b).withColumn("area", F.round("area", 6))
    best = pairs.groupBy("_t").agg(F.max(F.struct("area", "_s")).alias("b")).select("_t", F.col("b")["_s"].alias("_s"))
    return J.join(a, T.each(b, "other = n_nationkey"), best, J.JoinOptions(fields=["other"])).layer.df.select("n_nationkey", F.col("other").cast("int").alias("other"))


@query(f"WITH c AS (SELECT c_custkey, c_mktsegment, {CUSTOMER_XY} FROM customer), b AS ({BOXES}) SELECT n_nationkey, v AS c_mktsegment FROM b LEFT JOIN (SELECT n_nationkey AS i, c_mktsegment AS v, count(*) AS n, min(c_custkey) AS f FROM c JOIN b ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY n_nationkey ORDER BY count(*) DESC, min(c_custkey)) = 1) ON i = n_nationkey")
def fuzzy_join(spark: SparkSession, root: str) -> DataFrame:
    return J.fuzzy_join(boxes(spark, root), customer_points(spark, root), "c_mktsegment").df.select("n_nationkey", "c_mktsegment")


@query(f"SELECT n_nationkey, CAST(2 * ceil((x1 - x0) / 7) + 2 * ceil((y1 - y0) / 7) + 1 AS BIGINT) AS vertices FROM ({BOXES})")
def densify_boxes(spark: SparkSession, root: str) -> DataFrame:
    x = PA.densify(boxes(spark, root), 7.0)
    return x.settled.select("n_nationkey", F.size(F.col(GEOM)[0]).cast("bigint").alias("vertices"))


@query(f"SELECT n_nationkey, CAST(i AS BIGINT) AS side, CAST(ceil((CASE WHEN i % 2 = 0 THEN y1 - y0 ELSE x1 - x0 END - 1.5) / 5) AS BIGINT) AS dashes FROM ({BOXES}), range(4) t(i)")
def dashlines_segments(spark: SparkSession, root: str) -> DataFrame:
    x = PA.dashlines(PA.segments(boxes(spark, root)), 2.0, 3.0)
    side = F.row_number().over(T.Window.partitionBy("n_nationkey").orderBy(FID)) - 1
    return x.settled.select("n_nationkey", side.cast("bigint").alias("side"), F.size(GEOM).cast("bigint").alias("dashes"))


@query("SELECT c_custkey, round(72 / 2 * 2.5 * 2.5 * sin(2 * pi() / 72), 6) AS area FROM customer")
def buffer_points(spark: SparkSession, root: str) -> DataFrame:
    x = P.point_buffer(customer_points(spark, root), 2.5)
    return x.settled.select("c_custkey", F.round(G.area(F.col(GEOM)), 6).alias("area"))


@query(f"SELECT c_custkey, round(6378137.0 * radians(x), 3) AS x, round(6378137.0 * ln(tan(pi() / 4 + radians(greatest(-89.99, least(89.99, y))) / 2)), 3) + 0.0 AS y FROM (SELECT c_custkey, {CUSTOMER_XY} FROM customer)")
def proj_webmercator(spark: SparkSession, root: str) -> DataFrame:
    p = Pipeline(spark, {"c.parquet": customer_points(spark, root)}).run("-i c.parquet -proj webmercator")
    g = F.col(GEOM)[0]
    return p.layer().settled.select("c_custkey", F.round(g[0], 3).alias("x"), F.round(g[1], 3).alias("y"))


@query(f"SELECT n_nationkey, x0, y0, x1, y1 FROM ({BOXES})")
def rectangles_of(spark: SparkSession, root: str) -> DataFrame:
    b = G.bounds(F.col(GEOM), False)
    return P.rectangles(boxes(spark, root)).settled.select("n_nationkey", b["xmin"].alias("x0"), b["ymin"].alias("y0"), b["xmax"].alias("x1"), b["ymax"].alias("y1"))


@query("SELECT n_nationkey, 4::BIGINT AS n FROM nation")
def points_vertices(spark: SparkSession, root: str) -> DataFrame:
    return P.vertices(boxes(spark, root)).df.select("n_nationkey", F.size(GEOM).cast("bigint").alias("n"))


@query(f"SELECT n_nationkey, round(x0 + (x1 - x0) / 2, 6) AS x, round((y0 + y1) / 2, 6) AS y FROM ({BOXES})")
def points_inner(spark: SparkSession, root: str) -> DataFrame:
    g = F.col(GEOM)[0]
    return PA.inner_point_layer(boxes(spark, root)).settled.select("n_nationkey", F.round(g[0], 6).alias("x"), F.round(g[1], 6).alias("y"))


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'red' WHEN c_acctbal < 5000 THEN 'white' ELSE 'blue' END AS colour FROM customer")
def colorizer_breaks(spark: SparkSession, root: str) -> DataFrame:
    return commands(spark, root, ["customer"], "-i customer.parquet -colorizer name=shade colors=red,white,blue breaks=0,5000 -each 'colour = shade(c_acctbal)' -filter-fields c_custkey,colour")


@query("SELECT 'meridian' AS type, CAST(i * 10 - 180 AS DOUBLE) AS value FROM range(37) t(i) UNION ALL SELECT 'parallel', CAST(i * 10 - 80 AS DOUBLE) FROM range(17) t(i)")
def graticule_lines(spark: SparkSession, root: str) -> DataFrame:
    return P.graticule(spark).df.select("type", "value")


@query("SELECT n_nationkey FROM nation WHERE n_nationkey % 2 = 0")
def filter_slivers(spark: SparkSession, root: str) -> DataFrame:
    x = boxes(spark, root)
    thin = F.transform(GEOM, lambda r: F.transform(r, lambda p: F.array(p[0] * 1e-6, p[1])))
    mixed = x.with_df(x.df.withColumn(GEOM, F.when(F.col("n_nationkey") % 2 == 0, F.col(GEOM)).otherwise(thin)))
    return PA.filter_slivers(mixed, min_area=1.0, remove_empty=True).df.select("n_nationkey")


@query("SELECT n_nationkey, i AS part FROM nation, range(2) t(i)")
def explode_parts(spark: SparkSession, root: str) -> DataFrame:
    x = boxes(spark, root)
    moved = F.transform(F.col(GEOM)[0], lambda p: F.array(p[0] + 1000, p[1]))
    two = x.with_df(x.df.withColumn(GEOM, F.array(F.col(GEOM)[0], moved)))
    part = F.row_number().over(T.Window.partitionBy("n_nationkey").orderBy(FID)) - 1
    return PA.explode(two).df.select("n_nationkey", part.cast("bigint").alias("part"))


@query(None)
def cluster_precincts(spark: SparkSession, root: str) -> DataFrame:
    return TO.cluster(precinct_layer(spark, root), pct=0.2, group_by="county").df.select("precinct_code", "cluster")


@query(None)
def non_adjacent(spark: SparkSession, root: str) -> DataFrame:
    return TO.coloured(precinct_layer(spark, root)).withColumnRenamed(FID, "id")


@query(None)
def alpha_shapes(spark: SparkSession, root: str) -> DataFrame:
    return TO.alpha_shapes(supplier_points(spark, root), 60.0).settled.select(F.round(G.area(F.col(GEOM)), 4).alias("area"))


@query(None)
def smooth_precincts(spark: SparkSession, root: str) -> DataFrame:
    x = PA.smooth(precinct_layer(spark, root), 0.02)
    return x.settled.select("precinct_code", F.round(G.area(F.col(GEOM)), 8).alias("area"))


@query(f"""
WITH RECURSIVE r AS (SELECT c_custkey AS i, x, y, '' AS cell FROM (SELECT c_custkey, {CUSTOMER_XY} FROM customer)
UNION ALL SELECT i, x, y, cell || CASE WHEN row_number() OVER (PARTITION BY cell ORDER BY CASE WHEN w >= h THEN x ELSE y END, i) <= ceil(n / 2) THEN 'a' ELSE 'b' END
 FROM (SELECT *, count(*) OVER c AS n, max(x) OVER c - min(x) OVER c AS w, max(y) OVER c - min(y) OVER c AS h FROM r WINDOW c AS (PARTITION BY cell)) WHERE n > 100)
SELECT cell, count(*) AS n FROM (SELECT i, arg_max(cell, length(cell)) AS cell FROM r GROUP BY i) GROUP BY 1
""")
def subdivide_customers(spark: SparkSession, root: str) -> DataFrame:
    return T.subdivide(customer_points(spark, root), "count() > 100").groupBy("cell").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT n_nationkey, CAST(i AS INTEGER) AS side, round(CASE WHEN i % 2 = 0 THEN y1 - y0 ELSE x1 - x0 END, 6) AS length FROM ({BOXES}), range(4) t(i)")
def lines_segments(spark: SparkSession, root: str) -> DataFrame:
    x = PA.segments(boxes(spark, root))
    side = F.row_number().over(T.Window.partitionBy("n_nationkey").orderBy(FID)) - 1
    return x.df.select("n_nationkey", side.alias("side"), F.round(G.length(F.col(GEOM)), 6).alias("length"))


# --- files and streams ---------------------------------------------------------------------------------------------


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT CAST(p_partkey AS DOUBLE) AS p_partkey, p_name, CAST(p_size AS DOUBLE) AS p_size, CAST(p_retailprice AS DOUBLE) AS p_retailprice FROM part")
def csv_roundtrip(spark: SparkSession, root: str) -> DataFrame:
    x = T.filter_fields(layer(spark, root, "part"), ["p_partkey", "p_name", "p_size", "p_retailprice"])
    path = _folder(spark, "csv")
    IO.write_csv(x, path)
    return out(IO.read_csv(spark, path))


@query("SELECT CAST(o_orderkey AS DOUBLE) AS o_orderkey, o_orderstatus, o_totalprice FROM orders")
def output_roundtrip(spark: SparkSession, root: str) -> DataFrame:
    """What -o writes to paths, read again with -i: delimited text, then records."""
    path = _folder(spark, "out")
    text = f"-i orders.parquet -filter-fields o_orderkey,o_orderstatus,o_totalprice -o {path}/o.csv -drop -i {path}/o.csv -o {path}/o.json -drop -i {path}/o.json"
    x = Pipeline(spark, {"orders.parquet": layer(spark, root, "orders")}).run(text).layer()
    return x.df.select(F.col("o_orderkey").cast("double").alias("o_orderkey"), "o_orderstatus", F.col("o_totalprice").cast("double").alias("o_totalprice"))


@query("SELECT CAST(s_suppkey AS DOUBLE) AS s_suppkey, s_name FROM supplier UNION ALL SELECT c_custkey, c_name FROM customer")
def csv_skip_lines(spark: SparkSession, root: str) -> DataFrame:
    """Files that begin with two lines of notes and a header each."""
    path = _folder(spark, "skip")
    for name, key, label in (("supplier", "s_suppkey", "s_name"), ("customer", "c_custkey", "c_name")):
        rows = table(spark, root, name).select(F.concat_ws(",", F.col(key).cast("string"), label).alias("value")).coalesce(1)
        head = spark.createDataFrame([("made by hand",), ("# one line more",), ("s_suppkey,s_name",)], "value string").coalesce(1)
        head.unionByName(rows).coalesce(1).write.text(f"{path}/{name}")
    return out(IO.read_csv(spark, [f"{path}/supplier", f"{path}/customer"], skip_lines=2))


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def ndjson_roundtrip(spark: SparkSession, root: str) -> DataFrame:
    x = T.filter_fields(layer(spark, root, "supplier"), ["s_suppkey", "s_name", "s_acctbal"])
    path = _folder(spark, "ndjson")
    IO.write_ndjson(x, path)
    return out(next(iter(IO.read_json(spark, path, ndjson=True).values()))).select("s_suppkey", "s_name", "s_acctbal")


@query(f"SELECT n_nationkey, round((x1 - x0) * (y1 - y0), 6) AS area FROM ({BOXES})")
def geojson_roundtrip(spark: SparkSession, root: str) -> DataFrame:
    path = _folder(spark, "geojson")
    IO.write_ndjson(T.filter_fields(boxes(spark, root), ["n_nationkey"]), path)
    x = next(iter(IO.read_json(spark, path, ndjson=True).values()))
    return x.settled.select(F.col("n_nationkey").cast("int").alias("n_nationkey"), F.round(G.area(F.col(GEOM)), 6).alias("area"))


@query(f"SELECT c_custkey, x, y FROM (SELECT c_custkey, {CUSTOMER_XY} FROM customer)")
def geoparquet_roundtrip(spark: SparkSession, root: str) -> DataFrame:
    path = _folder(spark, "geoparquet")
    x = customer_points(spark, root)
    IO.write_parquet(T.filter_fields(x, ["c_custkey"]), path, "zstd", 3)
    g = F.col(GEOM)[0]
    return IO.read_parquet(spark, path, geometry="geometry").df.select("c_custkey", g[0].alias("x"), g[1].alias("y"))


@query("SELECT event_id, user_id, round(value * 2, 4) AS doubled FROM events WHERE event_type = 'purchase' AND value > 10")
def stream_filter_each(spark: SparkSession, root: str) -> DataFrame:
    def work(x: Layer) -> Layer:
        return T.each(T.filter_rows(x, "event_type == 'purchase' && value > 10"), "doubled = value * 2")

    return ST.available(spark, f"{root}/events.parquet", work, "event_id").select("event_id", "user_id", F.round("doubled", 4).alias("doubled"))


@query("SELECT event_type, time_bucket(INTERVAL '1 hour', ts) AS start, CAST(count(*) AS DOUBLE) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def stream_windows(spark: SparkSession, root: str) -> DataFrame:
    df = ST.windowed(spark, f"{root}/events.parquet", "ts", "event_type", "value", "1 hour", "30 days")
    return df.select("event_type", F.col("start").alias("start"), F.col("n").cast("double").alias("n"), F.round("total", 2).alias("total"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
