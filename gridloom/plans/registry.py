"""Queries by name with their SQL, and the inputs that both sides read."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

TABLES = "region nation customer supplier part orders lineitem events embeddings".split()

#: Inputs, as SQL that Spark and DuckDB read alike. Values are whole numbers, so that sums are exact in any order.
INPUTS = {
    "X": "SELECT p_partkey AS i, CAST(p_size AS DOUBLE) AS v FROM part",
    "SX": "SELECT p_partkey AS i, CAST(p_size * (1 - 2 * (p_partkey % 2)) AS DOUBLE) AS v FROM part",
    "Y": "SELECT p_partkey AS i, CAST(floor(p_retailprice) AS DOUBLE) AS v FROM part",
    "W": "SELECT p_partkey AS i, CAST(1 + p_partkey % 8 AS DOUBLE) AS v FROM part",
    "W2": "SELECT p_partkey AS i, CAST(CASE p_partkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 4 END AS DOUBLE) AS v FROM part",
    "S": "SELECT s_suppkey AS i, CAST(floor(s_acctbal) AS DOUBLE) AS v FROM supplier",
    "N": "SELECT CAST(n_nationkey AS BIGINT) AS i, CAST(1 + n_nationkey * n_regionkey AS DOUBLE) AS v FROM nation",
    "PM": "SELECT l_suppkey AS i, CAST(l_linenumber AS BIGINT) AS j, CAST(sum(l_quantity) AS DOUBLE) AS v FROM lineitem GROUP BY l_suppkey, l_linenumber",
    "PN": "SELECT l_suppkey AS i, CAST(l_linenumber AS BIGINT) AS j, CAST(count(*) AS DOUBLE) AS v FROM lineitem GROUP BY l_suppkey, l_linenumber",
    "A": "SELECT l_suppkey AS i, l_partkey AS j, CAST(sum(l_quantity) AS DOUBLE) AS v FROM lineitem GROUP BY l_suppkey, l_partkey",
    "B": "SELECT l_suppkey AS i, l_partkey AS j, CAST(sum(l_quantity) AS DOUBLE) AS v FROM lineitem WHERE l_returnflag = 'A' GROUP BY l_suppkey, l_partkey",
    "COO": "SELECT l_suppkey AS i, l_partkey AS j, CAST(l_quantity AS DOUBLE) AS v FROM lineitem",
    # nations x segments, small and square matrices
    "D": "SELECT CAST(c_nationkey AS BIGINT) AS i, CAST(c_custkey % 25 AS BIGINT) AS j, CAST(count(*) AS DOUBLE) AS v FROM customer GROUP BY c_nationkey, c_custkey % 25",
    "EDGES": "SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey <> b.l_partkey",
    # a sparser graph: suppliers of one nation, and those whose keys follow each other
    "G": "SELECT s.s_suppkey AS src, t.s_suppkey AS dst FROM supplier s JOIN supplier t ON s.s_nationkey = t.s_nationkey AND s.s_suppkey <> t.s_suppkey UNION SELECT s.s_suppkey, t.s_suppkey FROM supplier s JOIN supplier t ON t.s_suppkey = s.s_suppkey + 1 UNION SELECT t.s_suppkey, s.s_suppkey FROM supplier s JOIN supplier t ON t.s_suppkey = s.s_suppkey + 1",
}


def expanded(text: str) -> str:
    """{NAME} becomes the input's SQL in brackets."""
    return re.sub(r"\{(\w+)\}", lambda m: f"({expanded(INPUTS[m[1]])})" if m[1] in INPUTS else m[0], text)


def from_sql(spark: SparkSession, sf_dir: str, text: str, parts: int | None = None) -> DataFrame:
    """An input for Spark: tables' names stand for the files in sf_dir, dealt to so many tasks."""
    text = expanded(text)
    used = [t for t in TABLES if re.search(rf"\b{t}\b", text)]
    text = re.sub(rf"\b({'|'.join(used)})\b(?!\.)", lambda m: "{" + m[1] + "}", text)
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used}
    return spark.sql(text, **{t: df.repartition(parts) if parts else df for t, df in tables.items()})


class Inputs:
    """in_.A: the input of that name; in_("SELECT ..."): any other."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return from_sql(self.spark, self.sf_dir, INPUTS[name])

    def __call__(self, text: str) -> DataFrame:
        return from_sql(self.spark, self.sf_dir, text)

    def dealt(self, text: str) -> DataFrame:
        """The same for joins that make many rows of few: a small table is one file and, where the other side is broadcast, would be one task."""
        return from_sql(self.spark, self.sf_dir, text, int(self.spark.conf.get("spark.sql.shuffle.partitions")))


def query(name: str, oracle: str | None = None):
    """Registers a function of Inputs under the name, with its SQL if there is one."""

    def add(f: Callable[[Inputs], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is there already")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Inputs(spark, sf_dir))

        run.__name__, run.__doc__ = name, f.__doc__
        QUERIES[name] = run
        if oracle:
            ORACLE_SQL[name] = expanded(oracle).strip()
        return f

    return add
