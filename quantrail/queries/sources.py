"""Queries of sources and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import delimited, workbooks, xlsx
from ..sources.folders import own_folder
from ..streaming import running
from .common import query, r, round_all, rounded, table

#: Customers of a workbook; a sheet of the format holds 1,048,576 rows.
BOOK_ROWS = 500
#: The same of orders.
BOOK_ORDERS = 5000


@query(f"SELECT p_partkey, {r('p_retailprice * CASE p_partkey % 4 WHEN 1 THEN -1 WHEN 2 THEN 0.01::DOUBLE ELSE 1 END', 5)} AS number FROM part")
def locale_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices written in several notations of a locale with decimal commas, and read again."""
    plain = F.translate(F.format_number("p_retailprice", 2), ",.", ".,")
    k = F.col("p_partkey") % 4
    text = F.when(k == 1, F.concat(F.lit("("), plain, F.lit(")"))).when(k == 2, F.concat(plain, F.lit(" %"))).when(k == 3, F.concat(F.lit("€ "), plain)).otherwise(plain)
    return table(spark, sf_dir, "part").select("p_partkey", rounded(delimited.locale_number(text, ","), 5).alias("number"))


@query("SELECT c_custkey, c_acctbal AS balance, c_nationkey = 3 AS home FROM customer")
def delimited_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers written with semicolons and decimal commas, and read with found separators and types."""
    path = f"{own_folder(spark)}/delimited-{uuid.uuid4().hex}"
    text = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.translate(F.format_number("c_acctbal", 2), ",.", ".,").alias("balance"), F.when(F.col("c_nationkey") == 3, "TRUE").otherwise("FALSE").alias("home"))
    text.write.option("sep", ";").option("header", True).csv(path)
    df = delimited.read_delimited(spark, path)
    return df.select(F.col("key").cast("long").alias("c_custkey"), "balance", "home")


@query("SELECT c_nationkey::VARCHAR AS sheet, c_custkey, c_acctbal, c_name FROM customer")
def workbook_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as workbooks of a sheet for each nation, written and read again; a book holds a bounded range of customers."""
    path = f"{own_folder(spark)}/workbooks-{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "customer")
    block, nation = F.floor(F.col("c_custkey") / BOOK_ROWS), F.col("c_nationkey").cast("string")
    base = [F.concat_ws("-", F.lit("book"), F.col("c_nationkey") % 4, block).alias("path"), nation.alias("sheet"), (F.col("c_custkey") % BOOK_ROWS + 1).cast("int").alias("row"), block.alias("block")]
    none = lambda t: F.lit(None).cast(t)
    numbers = rows.select(*base, F.lit(1).alias("col"), F.col("c_acctbal").alias("number"), none("string").alias("text"), none("boolean").alias("truth"), none("string").alias("error"), none("string").alias("formula"))
    texts = rows.select(*base, F.lit(2).alias("col"), none("double").alias("number"), F.col("c_name").alias("text"), none("boolean").alias("truth"), none("string").alias("error"), none("string").alias("formula"))
    books = workbooks.to_workbooks(numbers.union(texts).drop("block"))
    books.write.parquet(path)
    read = spark.read.parquet(path).mapInPandas(workbooks.cells_in, workbooks.CELLS)
    cells = read.groupBy("path", "sheet", "row").agg(F.max("number").alias("c_acctbal"), F.max("text").alias("c_name"))
    key = F.element_at(F.split("path", "-"), -1).cast("long") * BOOK_ROWS + F.col("row") - 1
    return cells.select("sheet", key.cast("long").alias("c_custkey"), "c_acctbal", "c_name")


@query(f"SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(value) AS n, {r('avg(value)', 4)} AS mean, {r('stddev_samp(value)', 4)} AS sd, min(value) AS least, max(value) AS most FROM events GROUP BY ALL")
def stream_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily statistics of the events, as a stream."""
    out = running.windowed_statistics(running.read_table_stream(spark, sf_dir, "events"), "ts", "value", "event_type")
    return round_all(running.drained(out, own_folder(spark)), 4, ("least", "most")).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(f"WITH s AS (SELECT event_type, count(value) AS n, avg(value) AS mean, 1.959964 * stddev_samp(value) / sqrt(count(value)) AS half FROM events GROUP BY 1) SELECT event_type, n, {r('mean', 4)} AS mean, {r('half', 4)} AS half, n >= 500 AND half <= 0.05 * abs(mean) AS enough FROM s")
def stream_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = running.precision(running.read_table_stream(spark, sf_dir, "events"), "value", "event_type")
    return round_all(running.drained(out, own_folder(spark)), 4)


@query(f"""
WITH k AS (SELECT *, floor(o_orderkey / {BOOK_ORDERS}) AS book FROM orders), n AS (SELECT *, row_number() OVER (PARTITION BY book, o_orderpriority ORDER BY o_orderkey) AS row FROM k)
SELECT o_orderkey, row::INTEGER AS row, o_totalprice AS price, o_orderdate AS date, 'B' || row || '*0.1+D$1' AS formula, o_orderpriority AS sheet FROM n""")
def workbook_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written by the format xlsx, a sheet for each priority, with dates and a formula that its column shares, and read again sheet by sheet."""
    xlsx.register(spark)
    path = f"{own_folder(spark)}/books-{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "orders").withColumn("path", F.concat(F.lit("book-"), F.floor(F.col("o_orderkey") / BOOK_ORDERS).cast("string"))).withColumnRenamed("o_orderpriority", "sheet")
    rows = rows.repartition("path").withColumn("row", F.row_number().over(Window.partitionBy("path", "sheet").orderBy("o_orderkey")))  # BOOK_ORDERS at most
    cell = lambda col, **v: F.struct(F.lit(col).alias("col"), *[v.get(k, F.lit(None)).cast(t).alias(k) for k, t in (("number", "double"), ("text", "string"), ("truth", "boolean"), ("error", "string"), ("formula", "string"), ("date", "timestamp_ntz"))])
    each = F.array(cell(1, number=F.col("o_orderkey")), cell(2, number=F.col("o_totalprice")), cell(3, date=F.col("o_orderdate")), cell(4, formula=F.concat(F.lit("B"), F.col("row"), F.lit("*0.1+D$1"))))
    cells = rows.sortWithinPartitions("path", "sheet", "row").select("path", "sheet", "row", F.explode(each).alias("c")).select("path", "sheet", "row", "c.*")
    cells.write.format("xlsx").mode("append").save(path)
    read = spark.read.format("xlsx").load(path)
    at = lambda col, name: F.max(F.when(F.col("col") == col, F.col(name)))
    return read.groupBy("path", "sheet", "row").agg(at(1, "number").cast("long").alias("o_orderkey"), at(2, "number").alias("price"), at(3, "date").alias("date"), at(4, "formula").alias("formula")).drop("path")
