"""Round trips: what a sink writes, a strict scan reads back."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from ..operators.parse import RAW_COLUMNS
from ..sources import files
from ..sources.scratch import fresh
from ..sources.tables import EXPERIMENT_SQL, RAW_SQL, experiment, raw_events, table
from .registry import query

_RAW = ", ".join(RAW_COLUMNS)


def _csv(df, path: str, header: bool = True, sep: str = ",") -> str:
    writer = df.write.option("header", header).option("sep", sep).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    writer.option("escape", '"').option("quoteAll", header).option("emptyValue", "").csv(path)
    return path


@query(f"WITH {RAW_SQL} SELECT {', '.join(f"coalesce({c}, '') AS {c}" for c in RAW_COLUMNS)} FROM raw")
def scan_strict_csv(spark, sf_dir):
    """Raw records with line breaks, blanks and empty fields, written as CSV and scanned again."""
    return files.scan_strict_csv(spark, _csv(raw_events(spark, sf_dir).select(*RAW_COLUMNS), fresh(spark, "raw")))


_RCT = [*(f"f{k}" for k in range(12)), "treatment", "conversion", "visit", "exposure"]


@query(f"WITH {EXPERIMENT_SQL} SELECT CAST(f0 AS DECIMAL(18,2)) AS f0, CAST(f1 AS DECIMAL(18,2)) AS f1, treatment, conversion, visit, exposure, count(*) AS n FROM x GROUP BY ALL")
def scan_rct_csv(spark, sf_dir):
    rows = experiment(spark, sf_dir)
    money = lambda c: F.col(c).cast("decimal(18,2)").cast("string").alias(c)
    wide = rows.select(money("f0"), money("f1"), *[F.lit("0").alias(f"f{k}") for k in range(2, 12)], *[F.col(c).cast("string").alias(c) for c in _RCT[12:]])
    read = files.scan_rct_csv(spark, _csv(wide, fresh(spark, "rct")))
    typed = read.select(*[F.col(c).cast("decimal(18,2)").alias(c) for c in ("f0", "f1")], *[F.col(c).cast("int").alias(c) for c in _RCT[12:]])
    return typed.groupBy(*typed.columns).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, o_custkey, o_orderstatus, CAST(o_totalprice AS DECIMAL(18,2)) AS o_totalprice FROM orders")
def scan_jsonl(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.col("o_totalprice").cast("decimal(18,2)").alias("o_totalprice"))
    path = fresh(spark, "orders")
    rows.write.json(path)
    return files.scan_jsonl(spark, path, ", ".join(f"{c} {t}" for c, t in rows.dtypes))


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem")
def scan_parquet_list(spark, sf_dir):
    """Two tables that together hold all rows, named one by one."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    paths = []
    for k in (0, 1):
        paths.append(fresh(spark, f"lines{k}"))
        rows.where(F.col("l_linenumber") % 2 == k).write.parquet(paths[-1])
    return files.scan_parquet_list(spark, paths, rows.schema)


@query(f"WITH {EXPERIMENT_SQL} SELECT row_number() OVER (ORDER BY row_id) AS ordinal, row_id, treatment, CASE WHEN row_id < '8' THEN 'train' ELSE 'test' END AS split FROM x")
def scan_delimited_members(spark, sf_dir):
    """A membership table of all rows, as text with tabs."""
    from pyspark.sql import Window

    rows = experiment(spark, sf_dir)
    part = F.substring("row_id", 1, 3)  # ordinals by part: 4096 counts, then places within a part
    before = rows.groupBy(part.alias("part")).agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = rows.withColumn("part", part).join(F.broadcast(before.select("part", "before")), "part")
    ordinal = (F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy("row_id"))).cast("long")
    members = placed.select(ordinal.alias("ordinal"), "row_id", "treatment", F.when(F.col("row_id") < "8", "train").otherwise("test").alias("split"))
    return files.scan_delimited_members(spark, _csv(members, fresh(spark, "members"), header=False, sep="\t"))


@query("SELECT n_name, label, CAST(weight AS DOUBLE) AS weight FROM nation JOIN (VALUES (0, 'low', 1.5), (2, 'mid', 2.0), (4, 'high', 3.25)) v(r, label, weight) ON n_regionkey = r")
def literal_relation(spark, sf_dir):
    told = files.literal_relation(spark, [(0, "low", 1.5), (2, "mid", 2.0), (4, "high", 3.25)], "n_regionkey int, label string, weight double")
    return table(spark, sf_dir, "nation").join(told, "n_regionkey").select("n_name", "label", "weight")


def _refused(write) -> bool:
    try:
        write()
    except PySparkException:
        return True
    return False


@query("SELECT l_returnflag, count(*) AS n, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS amount, TRUE AS second_write_refused FROM lineitem GROUP BY 1")
def sink_parquet_exclusive(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").cast("decimal(18,2)").alias("price"), "l_returnflag")
    path = fresh(spark, "exclusive")
    stored = files.sink_parquet_exclusive(rows, path, ["l_returnflag"])
    refused = _refused(lambda: files.sink_parquet_exclusive(rows, path, ["l_returnflag"]))
    return stored.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum("price").cast("decimal(38,2)").alias("amount")).withColumn("second_write_refused", F.lit(refused))


@query("""SELECT sha256('cohort-v1|' || c_custkey) AS cohort_key, 'customers' AS scope_id, CAST(c_custkey AS VARCHAR) AS user_id, CAST(c_acctbal AS DECIMAL(18,2)) AS balance, 'cohort_key,balance' AS value_columns FROM customer""")
def sink_identity_value_split(spark, sf_dir):
    """Identity and values in two tables, brought together again by the key alone."""
    rows = table(spark, sf_dir, "customer").select(F.sha2(F.concat(F.lit("cohort-v1|"), F.col("c_custkey").cast("string")), 256).alias("cohort_key"), F.lit("customers").alias("scope_id"), F.col("c_custkey").cast("string").alias("user_id"), F.col("c_acctbal").cast("decimal(18,2)").alias("balance"))
    identity, values = (spark.read.parquet(p) for p in files.sink_identity_value_split(rows, fresh(spark, "split")))
    return identity.join(values, "cohort_key").select("cohort_key", "scope_id", "user_id", "balance", F.lit(",".join(values.columns)).alias("value_columns"))


@query("SELECT CAST(n_regionkey AS VARCHAR) AS region, CAST(count(*) AS VARCHAR) AS n, '[' || string_agg('\"' || n_name || '\"', ',' ORDER BY n_name) || ']' AS names FROM nation GROUP BY 1")
def sink_report_csv(spark, sf_dir):
    report = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").cast("string").alias("region")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list("n_name")).alias("names"))
    path = fresh(spark, "report")
    files.sink_report_csv(report, path)
    return spark.read.option("header", True).option("escape", "\\").csv(path)


@query("SELECT s_nationkey, count(*) AS n, TRUE AS smaller_bound_refused FROM supplier GROUP BY 1")
def bounded_fetch(spark, sf_dir):
    """A bounded aggregate is fetched whole or not at all."""
    counts = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("n"))
    rows = files.bounded_fetch(counts, 25)
    try:
        files.bounded_fetch(counts, len(rows) - 1)
        refused = False
    except ValueError:
        refused = True
    return spark.createDataFrame([(r.s_nationkey, r.n, refused) for r in rows], "s_nationkey int, n long, smaller_bound_refused boolean")


@query("SELECT p_brand, count(*) AS n FROM part GROUP BY 1")
def stream_fetch(spark, sf_dir):
    """An aggregate of a few rows, read one partition at a time."""
    counts = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("n"))
    return spark.createDataFrame([tuple(r) for r in files.stream_fetch(counts)], "p_brand string, n long")


_LINE = "o_orderkey || ',' || o_custkey || ',' || o_orderstatus || ',' || CAST(o_totalprice AS DECIMAL(18,2)){}"
_FOLD = "list_reduce(list_prepend(CAST(0 AS HUGEINT), list_transform(h, lambda x: CAST('0x' || x[{}:{}] AS HUGEINT))), lambda a, x: (a * {} + x) % {})"
_FOLDS = [_FOLD.format(15 * k + 1, 15 * k + 15, base, files.PRIME) for k, base in enumerate(files.BASES)]


@query(f"""
WITH l AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderkey AS k, {_LINE.format("")} AS line, {_LINE.format(" || CASE WHEN o_orderkey % 1000 = 1 THEN '!' ELSE '' END")} AS odd FROM orders),
f AS (SELECT 'a' AS folder, month, k, line FROM l UNION ALL SELECT 'b', month, k, line FROM l UNION ALL SELECT 'c', month, k, odd FROM l),
s AS (SELECT folder, month, list(sha256(line) ORDER BY k, line) AS h, CAST(sum(strlen(line) + 1) AS BIGINT) AS length FROM f GROUP BY ALL),
d AS (SELECT folder, month, length, sha256({_FOLDS[0]} || ':' || {_FOLDS[1]} || ':' || length) AS digest FROM s),
n AS (SELECT month, count(DISTINCT digest) > 1 AS name_conflict FROM d GROUP BY 1)
SELECT digest, length, CAST(count(*) AS INTEGER) AS copies, count(*) > 1 AS copied, bool_or(name_conflict) AS name_conflict FROM d JOIN n USING (month) GROUP BY ALL""")
def content_manifest(spark, sf_dir):
    """All orders in a file a month, in three folders: two are copies, and the third has some lines that differ."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders")
    line = F.concat_ws(",", k, "o_custkey", "o_orderstatus", F.col("o_totalprice").cast("decimal(18,2)"))
    told = rows.select(F.date_format("o_orderdate", "yyyy-MM").alias("month"), k, line.alias("value"))
    odd = told.withColumn("value", F.concat("value", F.when(k % 1000 == 1, "!").otherwise("")))
    top = fresh(spark, "manifest")
    for folder, lines in (("a", told), ("b", told), ("c", odd)):
        lines.repartition("month").sortWithinPartitions("month", "o_orderkey", "value").select("month", "value").write.partitionBy("month").text(f"{top}/{folder}")
    held = files.content_manifest(spark, top, r"month=([^/]+)/part-")
    return held.select("digest", "length", F.size("paths").alias("copies"), "copied", "name_conflict")
