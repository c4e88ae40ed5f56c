"""The register of queries: each binds an operator to the given tables, with the SQL that must agree."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from quaystone.plans.storage import materialise

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


class Source:
    """The given tables, and the frames that the bindings below derive from them by SQL."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self.made = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self.made:
            made = self.sql(BINDINGS[name]) if name in BINDINGS else self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            self.made[name] = materialise(made, name) if name in PARSED else made
        return self.made[name]

    def sql(self, text: str) -> DataFrame:
        """SQL in which {name} stands for a table or a binding."""
        used = [n for n in (*TABLES, *BINDINGS) if "{" + n + "}" in text]
        return self.spark.sql(text, **{n: getattr(self, n) for n in used})


def plain(df: DataFrame) -> DataFrame:
    """Whole numbers as BIGINT and decimals as DOUBLE, so that both engines return the same types."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        out.append(c.alias(f.name))
    return df.select(*out)


def query(name: str, sql: str | None = None):
    """Register a function of a :class:`Source`; {name} in the SQL stands for a table or a binding."""

    def put(f: Callable[[Source], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: plain(f(Source(spark, sf_dir)))
        if sql is not None:
            ORACLES[name] = bound(sql)
        return f

    return put


def bound(sql: str) -> str:
    """The SQL with each binding that it names as a common table expression."""
    needed: list[str] = []

    def need(text: str) -> None:
        for n, body in BINDINGS.items():
            if "{" + n + "}" in text and n not in needed:
                need(body)
                needed.append(n)

    need(sql)
    for n in (*TABLES, *BINDINGS):
        sql = sql.replace("{" + n + "}", n)
    parts = []
    for n in needed:
        body = BINDINGS[n]
        for m in (*TABLES, *BINDINGS):
            body = body.replace("{" + m + "}", m)
        parts.append(f"{n} AS ({body})")
    sql = sql.strip()
    if not parts:
        return sql
    if sql[:15].upper() == "WITH RECURSIVE ":
        return "WITH RECURSIVE " + ", ".join(parts) + ", " + sql[15:]
    if sql[:5].upper() == "WITH ":
        return "WITH " + ", ".join(parts) + ", " + sql[5:]
    return "WITH " + ", ".join(parts) + " " + sql


#: Bindings that parse whole pages: they become tables, or the pages would be parsed again for each use of a column, and within lambdas for each element.
PARSED = {"articles"}

#: How the given tables stand for search evidence. The text runs unchanged in both engines.
BINDINGS = {
    # Search tasks: a supplier is a task, its nation a group, its region a site.
    "tasks": """
        SELECT s_suppkey AS task_id, CAST(n_regionkey AS BIGINT) AS site_id, CAST(s_nationkey AS BIGINT) AS group_id, s_name AS keyword,
               CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE s_acctbal END AS volume
        FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey""",
    # Organic results: brands by revenue, the best ten of each task.
    "organic": """
        SELECT task_id, rank, url, domain, title FROM (
            SELECT task_id, CAST(row_number() OVER (PARTITION BY task_id ORDER BY revenue DESC, brand) AS BIGINT) AS rank,
                   concat('https://www.shop', CAST(CAST(substring(brand, 7) AS INT) % 7 AS STRING), '.example/b/', substring(brand, 7), '/?utm_source=x') AS url,
                   concat('shop', CAST(CAST(substring(brand, 7) AS INT) % 7 AS STRING), '.example') AS domain, concat(brand, ' · Shop ', CAST(CAST(substring(brand, 7) AS INT) % 3 AS STRING)) AS title
            FROM (SELECT l_suppkey AS task_id, p_brand AS brand, round(sum(l_extendedprice), 2) AS revenue
                  FROM {lineitem} JOIN {part} ON l_partkey = p_partkey GROUP BY l_suppkey, p_brand) r
        ) o WHERE rank <= 10""",
    "edges": """
        SELECT o.task_id, t.site_id, t.group_id, t.keyword, o.rank, regexp_replace(o.url, '/[?].*$', '') AS url, o.domain, o.title
        FROM {organic} o JOIN {tasks} t ON o.task_id = t.task_id""",
    # Demand occurrences: an order is an occurrence of its priority as a value and its status as a type.
    "demands": """
        SELECT o_orderkey AS occurrence_id, o_custkey AS task_id, o_custkey % 25 AS group_id, o_orderstatus AS demand_type, o_orderpriority AS value,
               o_orderkey % 10 + 1 AS occurrence_order, o_orderkey % 4 AS depth, CAST(o_orderdate AS DATE) AS observed_on FROM {orders}""",
    # Snapshots: all users of an event type on a day, by their largest value.
    "snapshots": """
        SELECT day, keyword, url, domain, rank, title FROM (
            SELECT day, keyword, concat('https://u', CAST(user_id % 40 AS STRING), '.example/', CAST(user_id AS STRING)) AS url, concat('u', CAST(user_id % 40 AS STRING), '.example') AS domain,
                   CAST(row_number() OVER (PARTITION BY day, keyword ORDER BY v DESC, user_id) AS BIGINT) AS rank, concat('t', CAST(floor(v) AS BIGINT)) AS title
            FROM (SELECT CAST(ts AS DATE) AS day, event_type AS keyword, user_id, max(value) AS v FROM {events} GROUP BY CAST(ts AS DATE), event_type, user_id) x
        ) y""",
    # Query rows of articles: a user is an article.
    "article_queries": """
        SELECT CAST(1 AS BIGINT) AS site_id, user_id AS article_id, event_type AS query, count(*) AS impressions, count(CASE WHEN value > 20 THEN 1 END) AS clicks, round(avg(value), 6) AS position,
               CAST(CASE WHEN user_id % 3 = 0 THEN 7 ELSE 28 END AS BIGINT) AS window_days
        FROM {events} GROUP BY user_id, event_type""",
    # Keyword inventory: parts.
    "keywords": """
        SELECT p_partkey AS source_keyword_id, p_name AS raw_keyword, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE CAST(floor(p_retailprice) AS BIGINT) END AS volume, p_type AS sheet,
               CASE WHEN p_size > 40 THEN 'acquired' ELSE 'unacquired' END AS state, CAST(p_size AS BIGINT) AS size FROM {part}""",
}
