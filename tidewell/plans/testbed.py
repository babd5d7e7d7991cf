"""The event table of the queries, built from the given tables alike in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession

EVENTS_SQL = """
SELECT e.event_id AS id,
       concat('ds_', CAST(e.user_id % 3 AS STRING)) AS dataset_id,
       CASE WHEN e.event_type = 'signup' THEN NULL ELSE concat('user_', CAST(e.user_id % 10 AS STRING)) END AS actor,
       e.ts AS ts,
       CASE WHEN e.event_type = 'signup' THEN 'system' ELSE 'message' END AS event_type,
       concat(coalesce(d.text, ''), CASE
         WHEN e.event_type = 'click' AND e.event_id % 2 = 0 THEN ' 😂 🎉'
         WHEN e.event_type = 'click' THEN ' ❤️ @user_3 thanks'
         WHEN e.event_type = 'purchase' THEN concat(' https://www.shop', CAST(e.user_id % 5 AS STRING), '.example.com/item/', CAST(e.event_id % 50 AS STRING), ' invoice payment')
         WHEN e.event_type = 'error' THEN ' urgent: server error, please help asap'
         ELSE ' see you at the meeting tomorrow' END) AS content
FROM (SELECT ev.*, (ev.event_id % nullif(c.n, 0) + c.n) % nullif(c.n, 0) AS dk FROM {events} ev CROSS JOIN (SELECT count(*) AS n FROM {documents}) c) e
LEFT JOIN {numbered} d ON d.k = e.dk
"""

#: The same as the first table of a DuckDB query, with each event's lengths.
WITH_EV = (
    "WITH ev AS ("
    + EVENTS_SQL.format(events="events", documents="documents", numbered="(SELECT row_number() OVER (ORDER BY doc_id NULLS LAST, text NULLS LAST) - 1 AS k, text FROM documents)")
    + r"""), m AS (
SELECT *, coalesce(trim(nullif(actor, '')), 'Unknown') AS who,
  CAST(length(content) + length(regexp_replace(content, '[^\x{10000}-\x{10FFFF}]', '', 'g')) AS BIGINT) AS chars,
  CAST(greatest(1, len(list_filter(string_split_regex(regexp_replace(content, '[^\p{L}\p{N}\s]', ' ', 'g'), '\s+'), lambda x: x <> ''))) AS BIGINT) AS words
FROM ev), """
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Ranges of doc_id that are numbered apart.
RANGES = 256


def numbered(documents: DataFrame) -> DataFrame:
    """Each document's number k from 0, by doc_id and then text, and its text; a range of doc_ids is numbered in a task."""
    rows = documents.selectExpr("cast(doc_id as bigint) as doc_id", "text", "cast(doc_id as double) as _at")
    cuts = sorted(set(rows.where("_at is not null").approxQuantile("_at", [i / RANGES for i in range(1, RANGES)], 0.001)))
    splits = [float("-inf"), *(cuts or [0.0]), float("inf")]
    ranged = Bucketizer(splits=splits, inputCol="_at", outputCol="_range", handleInvalid="keep").transform(rows).selectExpr("*", f"coalesce(_range, {len(splits)}) as _part")
    sizes = ranged.groupBy("_part").count().selectExpr("_part", "sum(count) over (order by _part) - count as _before")
    own = ranged.selectExpr("_part", "text", "row_number() over (partition by _part order by doc_id nulls last, text nulls last) - 1 as _k")
    return own.join(sizes, "_part").selectExpr("_before + _k as k", "text")


#: The same without content, for reports that read no text: no document is numbered or joined.
SLIM_SQL = EVENTS_SQL[: EVENTS_SQL.index(",\n       concat(coalesce(d.text")] + " FROM {events} e"


def testbed(spark: SparkSession, sf_dir: str, content: bool = True) -> DataFrame:
    if not content:
        return spark.sql(SLIM_SQL, events=table(spark, sf_dir, "events"))
    documents = table(spark, sf_dir, "documents")
    return spark.sql(EVENTS_SQL, events=table(spark, sf_dir, "events"), documents=documents, numbered=numbered(documents))
