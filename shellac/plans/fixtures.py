"""A catalogue and its companions derived from the driver tables.

One SELECT, in the dialect Spark and DuckDB share, gives the source columns on
both sides; the derived columns come from the library on Spark and from
``CAT`` in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import derived_columns
from ..operators import facets
from ..operators.blocks import Blocks
from ..operators.postings import publish_postings
from ..operators.search import with_search_text
from ..schema import SOURCE_FIELDS
from ..storage import sized, stored, workspace

_STORED: dict[tuple, DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str, make) -> DataFrame:
    """A derived table, stored once in a session as the generation that the jobs read."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STORED:
        _STORED[key] = stored(make(), name)
    return _STORED[key]


#: o = order key, u = o mod 2, p = pair, k = release, j = o mod 4, m = the other row of the pair.
_NUMBERS = """
  SELECT o, u, p, k, j, m, pr,
    (3 * p + u) % 150 AS ca, (3 * p + 1 - u) % 150 AS cm
  FROM (SELECT o_orderkey AS o, o_orderkey % 2 AS u, cast(floor(o_orderkey / 2) AS bigint) AS p, cast(floor(o_orderkey / 4) AS bigint) AS k,
               o_orderkey % 4 AS j, o_orderkey + 1 - 2 * (o_orderkey % 2) AS m, o_orderpriority AS pr FROM {orders}) AS base
"""
_MARK = "CASE WHEN k % 5 IN (0, 3) THEN CASE {j} WHEN 0 THEN '-A' WHEN 1 THEN '-A2' WHEN 2 THEN '-B' ELSE '-B2' END ELSE '' END"
_MX = "CASE WHEN {o} % 5 = 4 THEN NULL ELSE 'MX ' || lpad(cast({o} AS string), 6, '0') || ' A' END"
BASE_SELECT = f"""
SELECT o + 1 AS id,
  CASE WHEN o % 37 <> 0 THEN ca1.c_name END AS artist,
  CASE o % 4 WHEN 0 THEN upper(CASE WHEN o % 37 <> 0 THEN ca1.c_name END) WHEN 1 THEN CASE WHEN o % 37 <> 0 THEN ca1.c_name END || ' with The Band' END AS artist_credit,
  po.p_name || ' ' || cast(o % 1000 AS string) AS title,
  CASE WHEN o % 7 = 0 THEN 'The ' || po.p_name END AS title_credit,
  {_MX.format(o="o")} AS matrix_number,
  'GR ' || cast(k % 1500 AS string) || {_MARK.format(j="j")} AS label_number,
  CASE WHEN k % 11 = 10 THEN NULL WHEN k % 13 = 0 THEN upper(pk.p_brand) ELSE pk.p_brand END AS label,
  CASE k % 7 WHEN 3 THEN 'UK' WHEN 4 THEN 'US' WHEN 5 THEN CASE WHEN k % 91 = 5 THEN 'Scandanavia' ELSE 'Canada' END WHEN 6 THEN NULL
    ELSE CASE WHEN k % 49 = 0 THEN 'ja' ELSE 'JA' END END AS country,
  CASE k % 5 WHEN 0 THEN '12' WHEN 1 THEN '7' WHEN 2 THEN '7' WHEN 3 THEN CASE WHEN k % 40 = 3 THEN 'ep' ELSE 'EP' END ELSE '10' END AS format,
  CASE WHEN o % 16 = 0 THEN 'reissue' END AS pressing,
  CASE WHEN k % 9 <> 0 THEN s.s_name END AS producer,
  CASE k % 17 WHEN 16 THEN NULL WHEN 15 THEN 'c.' || cast(1953 + k % 47 AS string) WHEN 14 THEN '196?' ELSE cast(1953 + k % 47 AS string) END AS year,
  CASE WHEN o % 3 <> 0 THEN po.p_type END AS riddim,
  CASE WHEN u = 1 THEN 'yes' END AS version,
  CASE WHEN m % 37 <> 0 THEN cm1.c_name END AS b_side_artist,
  cast(NULL AS string) AS b_side_artist_credit,
  CASE p % 8 WHEN 7 THEN 'Version' WHEN 6 THEN NULL ELSE pm.p_name || ' ' || cast(m % 1000 AS string) END AS b_side_title,
  cast(NULL AS string) AS b_side_title_credit,
  CASE WHEN p % 3 = 2 THEN NULL WHEN p % 3 = 1 OR m % 5 = 4 THEN 'MX ' || lpad(cast(m AS string), 6, '0') ELSE {_MX.format(o="m")} END AS b_side_matrix_number,
  'GR ' || cast(k % 1500 AS string) || {_MARK.format(j="(m % 4)")} AS b_side_label_number,
  CASE WHEN o % 9 = 0 THEN upper(po.p_name) END AS song_origin,
  pr AS notes,
  CASE o % 6 WHEN 0 THEN 'Ska' WHEN 1 THEN 'Rocksteady' WHEN 2 THEN 'Reggae' WHEN 3 THEN CASE WHEN o % 33 = 3 THEN 'dancehall' ELSE 'Dancehall' END WHEN 4 THEN 'dubious entry' END AS genre,
  cast(NULL AS string) AS additions
FROM ({_NUMBERS}) AS nums
LEFT JOIN {{part}} AS po ON po.p_partkey = o % 200
LEFT JOIN {{part}} AS pm ON pm.p_partkey = m % 200
LEFT JOIN {{part}} AS pk ON pk.p_partkey = k % 200
LEFT JOIN {{supplier}} AS s ON s.s_suppkey = k % 10
LEFT JOIN {{customer}} AS ca1 ON ca1.c_custkey = ca
LEFT JOIN {{customer}} AS cm1 ON cm1.c_custkey = cm
"""

def nk(x: str) -> str:
    """Norm key in SQL (the fixture has ASCII white space only)."""
    return rf"trim(regexp_replace(lower(coalesce({x}, '')), '\s+', ' ', 'g'))"


def key_sql(p: str = "") -> str:
    return (f"CASE WHEN {nk(p + 'matrix_number')} <> '' THEN 'mx:' || {nk(p + 'matrix_number')} "
            f"ELSE 'lk:' || {nk(p + 'label_number')} || '|' || {nk(p + 'artist')} || '|' || {nk(p + 'title')} END")


def derived_sql(p: str = "") -> str:
    """The derived columns in SQL, from source columns prefixed with ``p``."""
    n = f"try_cast(nullif(regexp_extract({p}year, '([0-9]{{4}})', 1), '') AS integer)"
    return (f"CASE WHEN {n} BETWEEN 1850 AND 2100 THEN {n} END AS year_sort, lower({p}artist) AS artist_norm, lower({p}label) AS label_norm, lower({p}producer) AS producer_norm, "
            f"lower({p}riddim) AS riddim_norm, lower({p}country) AS country_norm, lower({p}song_origin) AS origin_norm, lower({p}genre) AS genre_norm, lower({p}format) AS format_norm, {key_sql(p)} AS record_key")


NAMES = {"orders": "orders", "part": "part", "supplier": "supplier", "customer": "customer"}
FIELDS = ", ".join(SOURCE_FIELDS)
#: The catalogue as common table expressions: base has the source columns, cat all.
CAT = f"base AS ({BASE_SELECT.format(**NAMES)}), cat AS (SELECT base.*, {derived_sql()} FROM base)"


def _tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    # only keys below 200 are looked up, so these sides have 200 rows at most
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return {
        "orders": read("orders").select("o_orderkey", "o_orderpriority"),
        "part": F.broadcast(read("part").select("p_partkey", "p_name", "p_brand", "p_type").filter("p_partkey < 200")),
        "supplier": F.broadcast(read("supplier").select("s_suppkey", "s_name").filter("s_suppkey < 10")),
        "customer": F.broadcast(read("customer").select("c_custkey", "c_name").filter("c_custkey < 150")),
    }


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived catalogue: id, source columns, derived columns."""
    return table(spark, sf_dir, "catalogue", lambda: spark.sql(BASE_SELECT, **_tables(spark, sf_dir)).withColumns(derived_columns()))


def searchable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue with the columns that searches read."""
    return table(spark, sf_dir, "searchable", lambda: with_search_text(catalogue(spark, sf_dir)))


def postings_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of the stored postings of the catalogue."""
    return table(spark, sf_dir, "postings", lambda: publish_postings(searchable(spark, sf_dir), workspace(spark, "postings"), POSTING_IDS))


def blocks(spark: SparkSession, sf_dir: str) -> Blocks:
    """The catalogue stored in blocks of ids."""
    cat, root = catalogue(spark, sf_dir), workspace(spark, "blocks")
    manifest = table(spark, sf_dir, "blocks", lambda: Blocks.publish(cat, root, POSTING_IDS).manifest)
    return Blocks(manifest, cat.schema, root, POSTING_IDS)


#: Ids of a block of the postings and of the stored catalogue here, so that the small tables have several.
POSTING_IDS = 1 << 12


def facet_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nine stored facet indexes of the catalogue, ordered by value."""
    def build() -> DataFrame:
        return facets.by_range(facets.facet_table(catalogue(spark, sf_dir)))

    return table(spark, sf_dir, "facets", build)


#: The upload: without o mod 50 = 7; a dub title, doubled rows, extra rows; ``n`` is the file order.
UPLOAD_SELECT = f"""
SELECT id * 4 + c AS n, {", ".join("CASE WHEN c = 0 AND (id - 1) % 40 = 3 THEN title || ' (Dub)' ELSE title END AS title" if f == "title" else "CASE WHEN c = 2 THEN 'NX ' || cast(id - 1 AS string) ELSE matrix_number END AS matrix_number" if f == "matrix_number" else f for f in SOURCE_FIELDS)}
FROM {{base}} CROSS JOIN (SELECT 0 AS c UNION ALL SELECT 1 UNION ALL SELECT 2) AS copies
WHERE (id - 1) % 50 <> 7 AND (c = 0 OR c = 1 AND (id - 1) % 60 = 11 OR c = 2 AND (id - 1) % 100 = 1)
"""
UPLOAD = f"upload AS ({UPLOAD_SELECT.format(base='base')})"


def upload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "upload", lambda: spark.sql(UPLOAD_SELECT, base=catalogue(spark, sf_dir).select("id", *SOURCE_FIELDS)))


_AT = "cast('2024-01-01 00:00:00' AS timestamp)"
#: Corrections: a producer with and without a known base, and one genre without a value.
OVERRIDES_SELECT = f"""
SELECT DISTINCT record_key, field, value, base_value, has_base, record_label, record_id, editor_id, editor_name, updated_at FROM (
  SELECT record_key, 'producer' AS field, 'Fixed' AS value,
    CASE WHEN (id - 1) % 4 IN (0, 1) THEN producer WHEN (id - 1) % 4 = 2 THEN 'Other' END AS base_value, (id - 1) % 4 <> 3 AS has_base,
    artist || ' – ' || title AS record_label, id AS record_id, cast(1 AS bigint) AS editor_id, 'ann' AS editor_name, {_AT} AS updated_at,
    row_number() OVER (PARTITION BY record_key ORDER BY id) AS rn
  FROM {{cat}} WHERE (id - 1) % 30 = 5
  UNION ALL
  SELECT record_key, 'genre', NULL, genre, true, artist || ' – ' || title, id, cast(2 AS bigint), 'bob', {_AT}, row_number() OVER (PARTITION BY record_key ORDER BY id)
  FROM {{cat}} WHERE (id - 1) % 210 = 5) AS edits WHERE rn = 1
"""
TOMBSTONES_SELECT = f"""
SELECT DISTINCT record_key, cast(NULL AS string) AS record_label, cast(1 AS bigint) AS editor_id, 'ann' AS editor_name, {_AT} AS deleted_at FROM {{cat}} WHERE (id - 1) % 70 = 9
"""
#: Added rows: o mod 500 = 2; every other one with a key that is in the upload, one with a tombstoned key.
ADDED_SELECT = f"""
SELECT id, CASE WHEN (id - 1) = 502 THEN dead ELSE CASE WHEN (id - 1) % 1000 = 2 THEN record_key ELSE 'lk:added ' || cast(id AS string) || '||' END END AS record_key,
  '{{{{"artist": "Added ' || cast(id AS string) || '", "title": "New ' || cast(id AS string) || '", "year": "1970", "label": " "}}}}' AS data,
  cast(1 AS bigint) AS editor_id, 'ann' AS editor_name, {_AT} AS created_at, {_AT} AS updated_at
FROM {{cat}} CROSS JOIN (SELECT min(record_key) AS dead FROM {{cat}} WHERE (id - 1) % 70 = 9) AS t WHERE (id - 1) % 500 = 2
"""
OVERLAY = f"overrides AS ({OVERRIDES_SELECT.format(cat='cat')}), tombstones AS ({TOMBSTONES_SELECT.format(cat='cat')}), added AS ({ADDED_SELECT.format(cat='cat')})"


def overlay(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    cat = catalogue(spark, sf_dir)
    selects = {"overrides": OVERRIDES_SELECT, "tombstones": TOMBSTONES_SELECT, "added": ADDED_SELECT}
    return {name: table(spark, sf_dir, name, lambda sql=sql: spark.sql(sql, cat=cat)) for name, sql in selects.items()}


#: The edit log, from the events.
LOG_SELECT = """
SELECT e.event_id AS id, c.record_key, e.user_id + 1 AS record_id,
  CASE e.event_type WHEN 'click' THEN 'modified' WHEN 'view' THEN 'new' WHEN 'error' THEN 'deleted' WHEN 'signup' THEN 'restored' ELSE 'reverted' END AS action,
  CASE WHEN e.event_type = 'click' THEN 'producer' END AS field, CASE WHEN e.event_type = 'click' THEN 'old ' || cast(e.event_id % 7 AS string) END AS old_value,
  CASE WHEN e.event_type = 'click' THEN 'Fixed' END AS new_value, e.user_id % 4 AS editor_id, 'editor ' || cast(e.user_id % 4 AS string) AS editor_name,
  e.ts AS created_at, CASE WHEN e.event_id % 3 = 0 THEN e.ts END AS reviewed_at, CASE WHEN e.event_id % 3 = 0 THEN 'boss' END AS reviewed_by,
  CASE WHEN e.event_id % 5 = 0 THEN 'see ' || cast(e.event_id AS string) END AS note, CASE WHEN e.event_id % 5 = 0 THEN e.ts END AS note_at,
  CASE WHEN e.event_id % 5 = 0 THEN 'editor ' || cast(e.event_id % 2 AS string) END AS note_by
FROM {events} AS e LEFT JOIN {cat} AS c ON c.id = e.user_id + 1
"""
LOG_CTE = f"log AS ({LOG_SELECT.format(events='events', cat='cat')})"


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "log", lambda: spark.sql(LOG_SELECT, events=spark.read.parquet(f"{sf_dir}/events.parquet"), cat=sized(catalogue(spark, sf_dir).select("id", "record_key"))))


REQUESTS_SELECT = """
SELECT event_id, cast(user_id AS string) AS ip, CASE WHEN user_id % 17 = 0 THEN 'Googlebot/2.1' ELSE 'Mozilla/5.0' END AS user_agent, ts,
  CASE WHEN event_type IN ('click', 'view') THEN 10 ELSE 1 END AS weight
FROM {events}
"""
ATTEMPTS_SELECT = """
SELECT event_id AS attempt_id, cast(user_id AS string) AS ip, 'u' || cast(user_id % 40 AS string) || '@x.org' AS email, event_type = 'signup' AS success, ts
FROM {events} WHERE event_type IN ('error', 'signup')
"""


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(REQUESTS_SELECT, events=spark.read.parquet(f"{sf_dir}/events.parquet"))


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(ATTEMPTS_SELECT, events=spark.read.parquet(f"{sf_dir}/events.parquet"))
