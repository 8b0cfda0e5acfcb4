"""Relations derived from the tables, as DataFrames and as the SQL that they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.operators import view
from emberline.session import table

POSTS = """select doc_id*4 as post_id, text as text from documents
union all select doc_id*4+1, concat('RT @user', cast(doc_id%7 as varchar(10)), ': ', text) from documents where doc_id%5=0
union all select doc_id*4+2, concat('RT @u: ', left(text,100), '…') from documents where doc_id%7=0
union all select doc_id*4+3, concat('wow RT @u ', text) from documents where doc_id%11=0"""
_REL = "coalesce(l.quality, cast(d.doc_id % 2 as int))"
RECORDS = f"""select d.doc_id as id, d.doc_id - d.doc_id % 3 as g, 1 + d.doc_id % 5 as n, d.doc_id % 3 = 0 as canon,
  d.text as text, {_REL} as rel, ((d.doc_id * 37) % 1000) / 1000e0 as p, ((d.doc_id * 53) % 101) / 100e0 as conf,
  case when {_REL} = 0 then '' else case (d.doc_id * 7) % 10 when 0 then 'INFRA' when 1 then 'EVAC' when 2 then 'HUMAN' when 3 then 'PROPERTY'
    when 4 then 'NEEDS' when 5 then 'AID' when 6 then 'ADVISORY' when 7 then 'SUPPORT' when 8 then 'OTHER' else '' end end as cat,
  case when {_REL} = 0 then 0 else cast((d.doc_id * 11) % 4 as int) end as urg,
  case when {_REL} = 0 then '' else case (d.doc_id * 3) % 11 when 0 then 'FLOOD' when 1 then 'STORM' when 2 then 'QUAKE' when 3 then 'FIRE' when 4 then 'BLAST'
    when 5 then 'CRASH' when 6 then 'ATTACK' when 7 then 'OTHER' when 8 then '' else 'FLOOD' end end as hz,
  case when d.doc_id % 17 = 5 then null else concat('N', cast(d.doc_id % 25 as varchar(10))) end as cc,
  case when d.doc_id % 7 < 3 then 'llm' else 'local' end as decided_by,
  case when d.doc_id % 19 = 3 then null else e.ts end as ts
from documents d left join labels l on l.doc_id = d.doc_id left join events e on e.event_id = d.doc_id"""
PLACES = """select d.doc_id as id, v.k as pos, n.n_name as name, cast((n.n_nationkey * 7) % 170 - 85 as double) as lat,
  cast((n.n_nationkey * 29) % 350 - 175 as double) as lon,
  case n.n_nationkey % 4 when 0 then 'region' when 1 then 'locality' when 2 then 'point' else 'line' end as prec,
  concat('N', cast(n.n_nationkey as varchar(10))) as cc
from documents d cross join (values (0), (1), (2)) v(k) join nation n on n.n_nationkey = (d.doc_id * 13 + v.k * 17) % 25
where v.k < d.doc_id % 13 % 4"""


def _sql(spark: SparkSession, d: str, sql: str, *names: str) -> DataFrame:
    import re

    for n in names:
        sql = re.sub(rf"(?<=from ){n}\b|(?<=join ){n}\b", f"{{{n}}}", sql)
    return spark.sql(sql, **{n: table(spark, d, n) for n in names})


def posts(spark: SparkSession, d: str) -> DataFrame:
    return _sql(spark, d, POSTS, "documents")


def plain_records(spark: SparkSession, d: str) -> DataFrame:
    return _sql(spark, d, RECORDS, "documents", "labels", "events")


def places(spark: SparkSession, d: str) -> DataFrame:
    """Three places at most per document, exploded from an array: no cross join."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.explode(F.filter(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda k: k < F.col("doc_id") % 13 % 4)).alias("pos"))
    n = table(spark, d, "nation")
    kind = F.when(F.col("n_nationkey") % 4 == 0, "region").when(F.col("n_nationkey") % 4 == 1, "locality").when(F.col("n_nationkey") % 4 == 2, "point").otherwise("line")
    n = n.select(F.col("n_nationkey").alias("_k"), F.col("n_name").alias("name"), ((F.col("n_nationkey") * 7) % 170 - 85).cast("double").alias("lat"), ((F.col("n_nationkey") * 29) % 350 - 175).cast("double").alias("lon"), kind.alias("prec"), F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("cc"))
    return docs.join(n, (F.col("id") * 13 + F.col("pos") * 17) % 25 == F.col("_k")).drop("_k")


def records(spark: SparkSession, d: str) -> DataFrame:
    return view.with_places(plain_records(spark, d), places(spark, d))
