"""Relational reports: sources, filters, joins, aggregates and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orbweave.functions import scalars as S
from orbweave.operators import reports
from orbweave.plans.registry import query
from orbweave.sources import files
from orbweave.sources.tables import TABLES, load


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n_rows FROM {t}" for t in TABLES))
def load_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each table."""
    parts = [load(spark, sf_dir, t).agg(F.count("*").alias("n_rows")).select(F.lit(t).alias("name"), "n_rows") for t in TABLES]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("SELECT l_returnflag, round(avg(l_extendedprice), 4) AS price_mean, round(stddev_samp(l_extendedprice), 4) AS price_sd, round(avg(l_discount), 6) AS discount_mean, round(stddev_samp(l_discount), 6) AS discount_sd FROM lineitem GROUP BY 1")
def mean_sd_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"))
    t = reports.mean_sd_table(rows, "l_returnflag", ["price", "discount"])
    return t.select("l_returnflag", *[F.round(c, 4 if c.startswith("price") else 6).alias(c) for c in t.columns[1:]])


@query("""WITH g AS (SELECT year(l_shipdate)::VARCHAR AS year, avg(l_quantity) AS m, stddev_pop(l_quantity) AS s FROM lineitem GROUP BY 1)
    SELECT year, round(m, 6) AS quantity_mean, round(s, 6) AS quantity_sd FROM g UNION ALL SELECT 'OVERALL', round(avg(m), 6), round(stddev_pop(m), 6) FROM g""")
def macro_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and the mean of the groups' means."""
    rows = load(spark, sf_dir, "lineitem").select(F.year("l_shipdate").cast("string").alias("year"), F.col("l_quantity").alias("quantity"))
    t = reports.mean_sd_table(rows, "year", ["quantity"], population=True, overall="OVERALL")
    return t.select("year", F.round("quantity_mean", 6).alias("quantity_mean"), F.round("quantity_sd", 6).alias("quantity_sd"))


@query("SELECT coalesce(l_returnflag, 'ALL') AS l_returnflag, coalesce(l_linestatus, 'ALL') AS l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))
    return rows.select(*[F.coalesce(c, F.lit("ALL")).alias(c) for c in ("l_returnflag", "l_linestatus")], "n")


@query("SELECT o_custkey, count(DISTINCT o_orderpriority) AS n_items FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderpriority) >= 5")
def having_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.complete(load(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority", 5)


@query("""WITH m AS (SELECT p_brand, round(avg(p_retailprice), 6) AS m FROM part GROUP BY 1)
    SELECT (SELECT p_brand FROM m ORDER BY m.m DESC, p_brand LIMIT 1) AS best, (SELECT max(m) FROM m) AS best_mean, (SELECT p_brand FROM m ORDER BY m.m, p_brand LIMIT 1) AS worst, (SELECT min(m) FROM m) AS worst_mean""")
def best_worst(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.best_and_worst(load(spark, sf_dir, "part"), "p_brand", "p_retailprice")


@query("SELECT n_name, r_name, count(*) AS n_customers, round(avg(c_acctbal), 4) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2")
def merge_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inner joins with the fixed tables nation (25 rows) and region (5 rows)."""
    c, n, r = (load(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    by_nation = c.groupBy("c_nationkey").agg(F.count("*").alias("n_customers"), F.avg("c_acctbal").alias("b"))
    joined = by_nation.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select("n_name", "r_name", "n_customers", F.round("b", 4).alias("balance"))


@query("SELECT a.k AS nationkey, round(a.m, 4) AS customer_mean, round(b.m, 4) AS supplier_mean FROM (SELECT c_nationkey AS k, avg(c_acctbal) AS m FROM customer GROUP BY 1) a JOIN (SELECT s_nationkey AS k, avg(s_acctbal) AS m FROM supplier GROUP BY 1) b ON a.k = b.k")
def intersect_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two grouped tables, joined where both have the key."""
    c = load(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("nationkey")).agg(F.round(F.avg("c_acctbal"), 4).alias("customer_mean"))
    s = load(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("nationkey")).agg(F.round(F.avg("s_acctbal"), 4).alias("supplier_mean"))
    return c.join(s, "nationkey")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P' AND o_totalprice > 200000)")
def resume_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys without a result yet."""
    done = load(spark, sf_dir, "orders").where("o_orderstatus = 'P' AND o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return files.unfinished(load(spark, sf_dir, "customer"), done, ["c_custkey"]).select("c_custkey", "c_mktsegment")


@query("SELECT p_partkey, p_brand FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)")
def semi_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = load(spark, sf_dir, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey"))
    return load(spark, sf_dir, "part").join(wanted, "p_partkey", "left_semi").select("p_partkey", "p_brand")


@query("SELECT o_orderstatus, " + ", ".join(f"round(avg(o_totalprice) FILTER (o_orderpriority = '{p}'), 4) AS p{p[0]}" for p in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")) + " FROM orders GROUP BY 1")
def pivot_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One column per setting, from named values so that no pass looks for them."""
    names = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    t = load(spark, sf_dir, "orders").groupBy("o_orderstatus").pivot("o_orderpriority", names).agg(F.round(F.avg("o_totalprice"), 4))
    return t.select("o_orderstatus", *[F.col(f"`{n}`").alias(f"p{n[0]}") for n in names])


@query("""WITH m AS (SELECT p_brand, p_size, avg(p_retailprice) AS v FROM part GROUP BY 1, 2), r AS (SELECT p_brand, max(v) AS reference FROM m WHERE p_size = 1 GROUP BY 1)
    SELECT p_brand, p_size, round(v, 4) AS v, round(reference, 4) AS reference, round(v - reference, 4) AS delta, round((reference - v) / reference * 100, 4) AS drop_percent FROM m JOIN r USING (p_brand)""")
def ref_row_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences to the row of setting 1 of the same category."""
    m = load(spark, sf_dir, "part").groupBy("p_brand", "p_size").agg(F.avg("p_retailprice").alias("v"))
    out = reports.against_reference(m, ["p_brand"], F.col("p_size") == 1, "v")
    return out.select("p_brand", "p_size", *[F.round(c, 4).alias(c) for c in ("v", "reference", "delta", "drop_percent")])


@query("SELECT c_mktsegment, rank, c_custkey, c_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey)::INTEGER AS rank FROM customer) WHERE rank <= 3")
def top3_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("c_mktsegment").orderBy(F.desc("c_acctbal"), "c_custkey")
    ranked = load(spark, sf_dir, "customer").withColumn("rank", F.row_number().over(order)).where("rank <= 3")
    return ranked.select("c_mktsegment", "rank", "c_custkey", "c_acctbal")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 4")
def top_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(4).select("o_orderkey", "o_totalprice")


@query("SELECT max(url) AS url FROM pages GROUP BY lower(url)")
def dedupe_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.dedupe_paths(load(spark, sf_dir, "pages"), "url")


@query("""SELECT event_id, try_cast(nullif(trim(props), '') AS DOUBLE) AS as_number, trunc(try_cast(trim(value::VARCHAR) AS DOUBLE))::INTEGER AS as_int FROM events""")
def safe_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as numbers; what is none becomes null."""
    e = load(spark, sf_dir, "events")
    return e.select("event_id", S.safe_double(F.col("props")).alias("as_number"), S.safe_int(F.col("value").cast("string")).alias("as_int"))


@query(r"SELECT page_id, regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)[-1] AS last_link FROM pages")
def regex_extract_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(spark, sf_dir, "pages")
    return p.select("page_id", files.last_match(F.col("html"), 'href="([^"]*)"').alias("last_link"))


@query(r"SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, string_split(url, '/')[-1] AS leaf, regexp_replace(string_split(url, '/')[-1], '\.[^.]*$', '') AS stem FROM pages")
def path_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return load(spark, sf_dir, "pages").select("page_id", F.regexp_extract(url, "^[a-z]+://([^/]+)", 1).alias("host"), F.element_at(F.split(url, "/"), -1).alias("leaf"), files.stem(url).alias("stem"))


@query(r"SELECT page_id, length(regexp_replace(html, '<script.*?</script>', '', 'gs'))::BIGINT AS n_rest FROM pages")
def regex_replace_multiline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "pages").select("page_id", F.length(F.regexp_replace("html", "(?s)<script.*?</script>", "")).cast("long").alias("n_rest"))


@query("SELECT event_id, coalesce(json_extract_string(props, '$.absent'), json_extract_string(props, '$.k'), json_extract_string(props, '$.page')) AS found FROM events")
def json_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of several candidate keys."""
    return load(spark, sf_dir, "events").select("event_id", S.first_key(F.col("props"), ["$.absent", "$.k", "$.page"]).alias("found"))


@query("SELECT l_returnflag, printf('%.4f ± %.4f', avg(l_quantity), stddev_samp(l_quantity)) AS quantity FROM lineitem GROUP BY 1")
def format_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "lineitem").withColumnRenamed("l_quantity", "quantity")
    return reports.formatted(reports.mean_sd_table(rows, "l_returnflag", ["quantity"]), "l_returnflag", ["quantity"])


@query(r"SELECT p_partkey, CASE WHEN p_size >= 25 THEN '\textbf{' || replace(p_brand, '#', '\_') || '}' ELSE replace(p_brand, '#', '\_') END AS cell, printf('%+.2f', p_retailprice - 1000) AS delta FROM part")
def latex_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = S.escape_latex(F.replace("p_brand", F.lit("#"), F.lit("_")))
    return load(spark, sf_dir, "part").select("p_partkey", S.bold_if(F.col("p_size") >= 25, text).alias("cell"), F.format_string("%+.2f", F.col("p_retailprice") - 1000).alias("delta"))


@query("SELECT p_partkey, coalesce(nullif(regexp_extract(p_name, '(\\d+)$', 1), ''), p_brand) AS alias, CASE WHEN p_retailprice > 1 THEN p_retailprice / 100 ELSE p_retailprice END AS share, CASE WHEN p_size - 10 > 0 THEN round(p_retailprice / (p_size - 10), 6) END AS ratio FROM part")
def tidy_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").select(
        "p_partkey",
        S.first_filled(F.regexp_extract("p_name", r"(\d+)$", 1), F.col("p_brand")).alias("alias"),
        S.as_share(F.col("p_retailprice")).alias("share"),
        F.round(S.guarded_ratio(F.col("p_retailprice"), F.col("p_size") - 10), 6).alias("ratio"),
    )


@query("SELECT s_suppkey, (['scratch', 'dent', 'stain'])[(s_suppkey % 3 + 1)::INTEGER] AS kind FROM supplier")
def round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*map(F.lit, ("scratch", "dent", "stain")))
    return load(spark, sf_dir, "supplier").select("s_suppkey", S.element_in_turn(kinds, F.col("s_suppkey")).alias("kind"))


@query("SELECT p_brand, (max(p_partkey) + 1)::BIGINT AS next_suffix FROM part GROUP BY 1")
def next_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number after the highest that a name of the group ends with."""
    return load(spark, sf_dir, "part").groupBy("p_brand").agg((F.max(F.regexp_extract(F.concat_ws("_", "p_brand", "p_partkey"), r"_(\d+)$", 1).cast("long")) + 1).alias("next_suffix"))


@query("""WITH m AS (SELECT n_regionkey, c_nationkey, avg((c_acctbal > 0)::INTEGER) AS r FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)
    SELECT n_regionkey, count(*) FILTER (abs(r - 0.9) <= 0.05) AS n_within, count(*) AS n, CASE WHEN count(*) FILTER (abs(r - 0.9) <= 0.05) >= 0.8 * count(*) THEN 'CONSISTENT' ELSE 'INCONSISTENT' END AS verdict FROM m GROUP BY 1""")
def within_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.avg((F.col("c_acctbal") > 0).cast("double")).alias("r"))
    m = c.join(load(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    n_within = F.count_if(F.abs(F.col("r") - 0.9) <= 0.05)
    verdict = F.when(n_within >= 0.8 * F.count("*"), "CONSISTENT").otherwise("INCONSISTENT")
    return m.groupBy("n_regionkey").agg(n_within.alias("n_within"), F.count("*").alias("n"), verdict.alias("verdict"))


@query("SELECT DISTINCT k FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier)")
def union_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"))
    return c.union(load(spark, sf_dir, "supplier").select("s_nationkey")).distinct()


@query("SELECT n_nationkey FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal < 0")
def except_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    poor = load(spark, sf_dir, "supplier").where("s_acctbal < 0").select(F.col("s_nationkey"))
    return load(spark, sf_dir, "nation").select("n_nationkey").subtract(poor)


@query("""WITH a AS (SELECT row_number() OVER (ORDER BY conv_id, turn) AS i, conv_id, turn, role FROM conversations)
    SELECT conv_id, bool_and(role IS NOT DISTINCT FROM CASE WHEN turn % 2 = 0 THEN 'user' ELSE 'assistant' END) AS equal FROM a GROUP BY 1""")
def positional_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sequences compared by place: equal if all places are."""
    c = load(spark, sf_dir, "conversations")
    made = c.select("conv_id", "turn", F.when(F.col("turn") % 2 == 0, "user").otherwise("assistant").alias("other"))
    both = c.join(made, ["conv_id", "turn"], "full")
    return both.groupBy("conv_id").agg(F.every(F.col("role").eqNullSafe(F.col("other"))).alias("equal"))


@query("""WITH m AS (SELECT l_orderkey AS k, 1 AS prio, l_extendedprice AS mask FROM lineitem WHERE l_linenumber = 2 UNION ALL SELECT l_orderkey, 2, l_extendedprice FROM lineitem WHERE l_linenumber = 1)
    SELECT o_orderkey, b.mask FROM orders LEFT JOIN (SELECT k, arg_min(mask, prio * 1e9 + mask) AS mask FROM m GROUP BY 1) b ON o_orderkey = k""")
def mask_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A left join that takes the best-placed of several candidates."""
    li = load(spark, sf_dir, "lineitem").where(F.col("l_linenumber").isin(1, 2))
    masks = li.select(F.col("l_orderkey").alias("o_orderkey"), (3 - F.col("l_linenumber")).alias("prio"), F.col("l_extendedprice").alias("mask"))
    return files.with_masks(load(spark, sf_dir, "orders").select("o_orderkey"), masks, "o_orderkey", "prio", "mask")


@query("""SELECT o_custkey, seed, coalesce(a.v, b.v) AS v FROM (SELECT o_custkey, 1 AS seed, round(sum(o_totalprice), 2) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) a
    FULL JOIN (SELECT o_custkey, 1 AS seed, round(sum(o_totalprice), 2) AS v FROM orders GROUP BY 1) b USING (o_custkey, seed)""")
def primary_or_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the first source, and of the second where the first has none."""
    o = load(spark, sf_dir, "orders")
    total = lambda df: df.groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("v")).withColumn("seed", F.lit(1))
    return files.with_fallback(total(o.where("o_orderstatus = 'F'")), total(o), ["o_custkey", "seed"])


@query("""SELECT b AS bits, s AS seed, n_name AS category, (b = 8)::INTEGER AS is_default FROM nation, (VALUES (4), (8), (12)) x(b), (VALUES (111), (333), (999), (2026), (3407)) y(s)
    WHERE NOT (b = 12 AND EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey))""")
def experiment_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All settings of each category that have no result yet: arrays of literals are exploded."""
    n = load(spark, sf_dir, "nation")
    grid = n.select("n_nationkey", F.col("n_name").alias("category"), F.explode(F.array(*map(F.lit, (4, 8, 12)))).alias("bits")).select(
        "*", F.explode(F.array(*map(F.lit, (111, 333, 999, 2026, 3407)))).alias("seed")
    )
    done = load(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("n_nationkey"), F.lit(12).alias("bits"))
    return files.unfinished(grid, done, ["n_nationkey", "bits"]).select("bits", "seed", "category", (F.col("bits") == 8).cast("int").alias("is_default"))


@query("SELECT source, count(*) AS n, list_sort(list(DISTINCT lang)) AS langs_list, array_to_string(list_sort(list(DISTINCT lang)), ',') AS langs, round(sum(n_chars) / 1e6, 6) AS mb FROM documents GROUP BY 1".replace("list_sort(list(DISTINCT lang)) AS langs_list, ", ""))
def distinct_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").groupBy("source").agg(
        F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("lang")), ",").alias("langs"), F.round(F.sum("n_chars") / 1e6, 6).alias("mb")
    )


@query("SELECT conv_id, coalesce(max(turn) FILTER (role = 'assistant'), -1) AS last_reply, arg_max(role, turn) AS last_role FROM conversations GROUP BY 1")
def latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "conversations")
    return c.groupBy("conv_id").agg(F.coalesce(F.max(F.when(F.col("role") == "assistant", F.col("turn"))), F.lit(-1)).alias("last_reply"), F.max_by("role", "turn").alias("last_role"))


@query("SELECT url AS src, 'out/' || CASE WHEN page_id % 2 = 0 THEN 'good' ELSE 'bad' END || '/' || page_id || '.html' AS dest FROM pages")
def route_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each file would be copied to."""
    p = load(spark, sf_dir, "pages")
    kind = F.when(F.col("page_id") % 2 == 0, "good").otherwise("bad")
    return p.select(F.col("url").alias("src"), F.concat(F.lit("out/"), kind, F.lit("/"), F.col("page_id").cast("string"), F.lit(".html")).alias("dest"))


@query("SELECT to_json({'event_type': event_type, 'n': count(*), 'top': max(event_id)}) AS line FROM events GROUP BY event_type")
def json_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = load(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.max("event_id").alias("top"))
    return by.select(F.to_json(F.struct("event_type", "n", "top")).alias("line"))


@query(r"""WITH m AS (SELECT p_brand AS g, avg(p_size / 53.0::DOUBLE) AS o, avg(p_retailprice / 2000) AS w FROM part GROUP BY 1), a AS (SELECT *, 0 AS l FROM m UNION ALL SELECT 'Mean', avg(o), avg(w), 1 FROM m),
    n AS (SELECT *, row_number() OVER (ORDER BY l, g) AS k FROM a),
    t AS (SELECT 2 * k + 10 + l AS place, replace(g, '_', '\_') || ' & ' || CASE WHEN w >= o THEN printf('%.2f', 100 * o) ELSE '\textbf{' || printf('%.2f', 100 * o) || '}' END || ' & ' || CASE WHEN w >= o THEN '\textbf{' || printf('%.2f', 100 * w) || '}' ELSE printf('%.2f', 100 * w) END || ' & ' || printf('%+.2f', 100 * (w - o)) || ' \\' AS line FROM n
    UNION ALL SELECT 2 * k + 10, '\midrule' FROM n WHERE l = 1 UNION ALL VALUES (1, '\begin{tabular}{lccc}'), (2, '\toprule'), (3, 'Brand & Size & Price & $\Delta$ \\'), (4, '\midrule'), (2000000001, '\bottomrule'), (2000000002, '\end{tabular}'))
    SELECT row_number() OVER (ORDER BY place) AS at, line FROM t""")
def latex_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole LaTeX table: two means a brand, the larger in bold, their difference, and the means of all."""
    rows = load(spark, sf_dir, "part").select("p_brand", (F.col("p_size") / 53.0).alias("size"), (F.col("p_retailprice") / 2000).alias("price"))
    lines = reports.latex_lines(reports.compared(rows, "p_brand", "size", "price"), "p_brand", ("Brand", "Size", "Price"))
    return lines.select(F.row_number().over(Window.orderBy("place")).alias("at"), "line")
