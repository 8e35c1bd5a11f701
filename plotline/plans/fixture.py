"""Transactions derived from the given ``orders`` table, as SQL that any engine runs.

The parts of each address are known by construction, so the parsed result of the composed
address can be checked against them.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plotline.session import scratch_folder

VIEWS: dict[str, str] = {}
# Stands where DuckDB has to be told that a replacement applies to all matches.
EVERYWHERE = "{{,g}}"

VIEWS["tx"] = """
SELECT
  o.o_orderkey AS id,
  d.district AS district,
  d.county_city AS county_city,
  CASE WHEN o.o_custkey % 11 = 0 THEN r.road ELSE concat(r.road, s.sec) END AS street,
  CASE WHEN o.o_custkey % 3 = 0 THEN cast(o.o_custkey % 40 + 1 AS STRING) ELSE '' END AS lane,
  CASE WHEN o.o_custkey % 9 = 0 THEN cast(o.o_custkey % 7 + 1 AS STRING) ELSE '' END AS alley,
  cast(o.o_custkey % 60 + 1 AS STRING) AS number,
  cast(o.o_orderkey % 19 + 1 AS STRING) AS floor,
  CASE WHEN o.o_orderkey % 6 = 0 THEN cast(o.o_orderkey % 4 + 1 AS STRING) ELSE '' END AS sub_number,
  CASE WHEN o.o_orderkey % 41 = 0
       THEN concat(cast(year(o.o_orderdate) - 1911 AS STRING), lpad(cast(month(o.o_orderdate) AS STRING), 2, '0'), lpad(cast(day(o.o_orderdate) AS STRING), 2, '0'))
       ELSE concat(cast(year(o.o_orderdate) - 1891 AS STRING), lpad(cast(month(o.o_orderdate) AS STRING), 2, '0'), lpad(cast(day(o.o_orderdate) AS STRING), 2, '0')) END AS transaction_date,
  CASE WHEN o.o_orderkey % 53 = 0 THEN NULL ELSE cast(floor(o.o_totalprice) * 100 AS BIGINT) END AS total_price,
  CASE WHEN o.o_orderkey % 37 = 0 THEN 0.0E0 ELSE cast(o.o_orderkey % 160 + 20 AS DOUBLE) END AS building_area,
  CASE WHEN o.o_orderkey % 29 = 0 THEN NULL ELSE cast(o.o_orderkey % 160 + 20 AS DOUBLE) * 0.5E0 END AS main_area,
  CASE WHEN o.o_orderkey % 5 = 0 THEN NULL ELSE cast(o.o_orderkey % 8 AS DOUBLE) END AS attached_area,
  CASE WHEN o.o_orderkey % 7 = 0 THEN NULL ELSE cast(o.o_orderkey % 12 AS DOUBLE) END AS balcony_area,
  CASE WHEN o.o_orderkey % 53 = 0 OR o.o_orderkey % 37 = 0 THEN 0.0E0
       ELSE cast(floor(floor(o.o_totalprice) * 100 / (o.o_orderkey % 160 + 20)) AS DOUBLE) END AS unit_price,
  cast(o.o_orderkey % 6 AS INT) AS rooms,
  b.building_type AS building_type,
  cast(o.o_custkey % 30 + 1 AS STRING) AS total_floors,
  concat(cast(70 + o.o_custkey % 30 AS STRING), '0', cast(o.o_custkey % 9 + 1 AS STRING), '15') AS build_date,
  CASE WHEN o.o_orderkey % 25 = 0 THEN '親友間交易' WHEN o.o_orderkey % 25 = 1 THEN '法拍屋' WHEN o.o_orderkey % 25 = 2 THEN '含車位' ELSE '' END AS note,
  CASE WHEN o.o_custkey % 4 = 0 THEN NULL WHEN o.o_custkey % 4 = 1 THEN '' ELSE concat(n.cname, cast(cast(floor(o.o_custkey / 24) AS BIGINT) % 5 AS STRING), '區') END AS community_name,
  CASE WHEN o.o_custkey % 10 = 0 THEN NULL WHEN o.o_custkey % 10 = 1 THEN 0.0E0 ELSE 22.0E0 + (o.o_custkey % 300) / 128.0E0 END AS lat,
  CASE WHEN o.o_custkey % 10 = 0 THEN NULL WHEN o.o_custkey % 10 = 1 THEN 0.0E0 ELSE 120.0E0 + (o.o_orderkey % 200) / 128.0E0 END AS lng
FROM orders o
JOIN (VALUES (0,'大安區','台北市'),(1,'松山區','台北市'),(2,'中山區','台北市'),(3,'板橋區','新北市'),(4,'竹北市','新竹縣'),(5,'永康區','台南市'),(6,'西屯區','台中市'),(7,'中正區','基隆市')) AS d(i, district, county_city) ON o.o_custkey % 8 = d.i
JOIN (VALUES (0,'三民路'),(1,'忠孝東路'),(2,'日興一街'),(3,'和平東路'),(4,'市民大道')) AS r(i, road) ON o.o_custkey % 5 = r.i
JOIN (VALUES (0,''),(1,'一段'),(2,'二段'),(3,'三段')) AS s(i, sec) ON o.o_custkey % 4 = s.i
JOIN (VALUES (0,'住宅大樓(11層含以上有電梯)'),(1,'華廈(10層含以下有電梯)'),(2,'公寓(5樓含以下無電梯)'),(3,'透天厝')) AS b(i, building_type) ON o.o_orderkey % 4 = b.i
JOIN (VALUES (0,'健安新城'),(1,'遠雄幸福'),(2,'都廳大院'),(3,'信義星池'),(4,'仁愛帝寶'),(5,'Ａ加ｂ館')) AS n(i, cname) ON cast(floor(o.o_custkey / 4) AS BIGINT) % 6 = n.i
"""

VIEWS["tx_addr"] = """
SELECT tx.*, concat(county_city, district, street,
  CASE WHEN lane <> '' THEN concat(lane, '巷') ELSE '' END,
  CASE WHEN alley <> '' THEN concat(alley, '弄') ELSE '' END,
  number, '號', floor, '樓', CASE WHEN sub_number <> '' THEN concat('之', sub_number) ELSE '' END) AS address_half,
  concat(replace(county_city, '台', '臺'), translate(concat(district, street,
  CASE WHEN lane <> '' THEN concat(lane, '巷') ELSE '' END,
  CASE WHEN alley <> '' THEN concat(alley, '弄') ELSE '' END,
  number, '號', floor, '樓', CASE WHEN sub_number <> '' THEN concat('之', sub_number) ELSE '' END), '0123456789', '０１２３４５６７８９')) AS address
FROM tx
"""

VIEWS["points"] = """
SELECT min(id) AS point_id, county_city AS city, district,
  concat(street, CASE WHEN lane <> '' THEN concat(lane, '巷') ELSE '' END, CASE WHEN alley <> '' THEN concat(alley, '弄') ELSE '' END) AS street,
  number AS housenumber,
  23.0E0 + (min(id) % 100) / 64.0E0 AS lat, 120.0E0 + (min(id) % 90) / 64.0E0 AS lng
FROM tx_addr WHERE cast(number AS INT) % 3 <> 0
GROUP BY county_city, district, street, lane, alley, number
"""

VIEWS["api"] = """
SELECT id, CASE district WHEN '中正區' THEN 'C' WHEN '中山區' THEN 'A' ELSE 'F' END AS city,
  concat('raw#', address_half) AS address, building_type AS build_type, coalesce(community_name, '') AS community,
  concat(substr(transaction_date, 1, length(transaction_date) - 4), '/', substr(transaction_date, length(transaction_date) - 3, 2), '/', substr(transaction_date, length(transaction_date) - 1, 2)) AS date_str,
  concat('sq', cast(id AS STRING)) AS sq, lat, lng AS lon,
  concat('{"tp":"', coalesce(cast(total_price AS STRING), ''), '","f":"', floor, '層/', total_floors, '層","j":"', cast(rooms AS STRING), '","s":"', cast(cast(building_area AS BIGINT) AS STRING), '","note":"', note, '"}') AS raw_json
FROM tx_addr WHERE id % 2 = 0
"""

VIEWS["query_table"] = """
SELECT min(id) AS query_id, concat(district, street, CASE WHEN lane <> '' THEN concat(lane, '巷') ELSE '' END, number, '號') AS query_text,
  district, street, lane, number
FROM tx_addr WHERE id % 50 = 0 GROUP BY district, street, lane, number
"""


# Cached positions: one per address point, of mixed level and source.
VIEWS["cache"] = """
SELECT concat(replace(city, '台', '臺'), district, street, housenumber, '號') AS address_key, lat, lng,
  CASE WHEN point_id % 3 = 0 THEN 'road' ELSE 'exact' END AS level,
  CASE WHEN point_id % 2 = 0 THEN 'osm_index' ELSE 'api' END AS source
FROM points WHERE point_id % 4 <> 1
"""

# Three sources of the same trades, each with its own gaps.
VIEWS["arrivals"] = """
SELECT 1 AS source_rank, lpad(cast(id AS STRING), 12, '0') AS ingest_seq, address, transaction_date, total_price,
  CASE WHEN id % 3 = 0 THEN '' ELSE building_type END AS building_type, CAST(NULL AS STRING) AS community_name,
  CASE WHEN id % 5 = 0 THEN NULL ELSE rooms END AS rooms, note, CAST(NULL AS DOUBLE) AS lat, CAST(NULL AS DOUBLE) AS lng,
  building_area, concat('csv_', cast(id AS STRING)) AS serial_no,
  concat(substr(transaction_date, 1, 7), '|', substr(address_half, 4), '|', cast(coalesce(total_price, 0) AS STRING)) AS expected_key
FROM tx_addr
UNION ALL
SELECT 2, lpad(cast(id AS STRING), 12, '0'), address_half, transaction_date, total_price, building_type, community_name, rooms,
  CASE WHEN id % 4 = 0 THEN '補登' ELSE '' END, lat, lng, building_area, concat('api_', cast(id AS STRING)),
  concat(substr(transaction_date, 1, 7), '|', substr(address_half, 4), '|', cast(coalesce(total_price, 0) AS STRING))
FROM tx_addr WHERE id % 2 = 0
UNION ALL
SELECT 3, lpad(cast(id AS STRING), 12, '0'), address, concat(substr(transaction_date, 1, length(transaction_date) - 4), '/', substr(transaction_date, length(transaction_date) - 3, 2), '/', substr(transaction_date, length(transaction_date) - 1, 2)),
  total_price, '', '第三來源', 9, '', 24.5E0, 121.5E0, 0.0E0, concat('old_', cast(id AS STRING)),
  concat(substr(transaction_date, 1, 7), '|', substr(address_half, 4), '|', cast(coalesce(total_price, 0) AS STRING))
FROM tx_addr WHERE id % 6 = 0
UNION ALL
SELECT 3, concat('bad', cast(id AS STRING)), CASE WHEN id % 2 = 0 THEN '' ELSE replace(address, '號', '') END, transaction_date, total_price, building_type, community_name,
  rooms, note, lat, lng, building_area, concat('bad_', cast(id AS STRING)), CAST(NULL AS STRING)
FROM tx_addr WHERE id % 17 = 0
"""

# Names that grow with the data: the first three words of the documents, in plain letters.
VIEWS["titles"] = """
SELECT min(doc_id) AS item_id, name, count(*) AS tx_count FROM (
  SELECT doc_id, regexp_replace(lower(regexp_extract(text, '^([^ \n]{1,20} [^ \n]{1,20} [^ \n]{1,20})', 1)), '[^a-z ]', 'x'{{,g}}) AS name FROM documents) x
WHERE name <> '' GROUP BY name
"""


def prefix(body: str, extra: dict[str, str] | None = None) -> str:
    """``WITH`` clause of the views a statement needs, in dependency order."""
    known = VIEWS | (extra or {})
    order: list[str] = []

    def visit(sql: str) -> None:
        for name in known:
            if name not in order and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", sql, re.I):
                visit(known[name])
                if name not in order:
                    order.append(name)

    visit(body)
    parts = [f"{n} AS ({known[n].strip()})" for n in order]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body.strip()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the derived views over ``<sf_dir>/orders.parquet``.

    Rows are dealt evenly over the tasks, whatever files they come from (adaptive execution sets their number).
    """
    table(spark, sf_dir, "orders").hint("rebalance").createOrReplaceTempView("orders")
    table(spark, sf_dir, "documents").createOrReplaceTempView("documents")
    return spark.sql(prefix(f"SELECT * FROM {name}").replace(EVERYWHERE, ""))


_STORED: dict[tuple[str, str, str], str] = {}


def stored(spark: SparkSession, sf_dir: str, name: str, write: Callable[[str], None]) -> str:
    """Folder of a table that queries read as it was stored; written once per application and input."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STORED:
        path = scratch_folder(spark, name)
        write(path)
        _STORED[key] = path
    return _STORED[key]
