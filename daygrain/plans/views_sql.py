"""The views V1..V7 as DuckDB SQL, written independently of the Spark code.

They are used only by the SQL oracles (``oracle_sql()``); each oracle is a
``WITH`` chain over the driver's pre-registered table views.
"""

V1 = """sensor_scalar AS (
  SELECT user_id AS subject_id, ts AS "timestamp", event_id AS row_id,
         CASE WHEN isnan(value) OR isinf(value) THEN NULL ELSE value END AS value,
         TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
         event_type AS category
  FROM events)"""


def _items_view(name: str, struct_fields: str, extra_join: str = "") -> str:
    return f"""{name} AS (
  SELECT c.c_nationkey AS subject_id, CAST(date_trunc('month', o.o_orderdate) AS DATE) AS bucket,
         o.o_orderkey AS row_id, coalesce(i.items, []) AS items
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  LEFT JOIN (SELECT l_orderkey,
                    list(struct_pack({struct_fields}) ORDER BY l_linenumber, l_partkey, l_suppkey) AS items
             FROM lineitem {extra_join} GROUP BY l_orderkey) i
    ON o.o_orderkey = i.l_orderkey)"""


V2 = _items_view("sensor_nested",
                 "l_linenumber := l_linenumber, l_partkey := l_partkey, l_suppkey := l_suppkey, "
                 "l_quantity := l_quantity, l_extendedprice := l_extendedprice, l_discount := l_discount")

V3 = V2 + """,
sensor_array AS (
  SELECT subject_id, bucket, row_id, list_transform(items, lambda x: x.l_extendedprice) AS readings
  FROM sensor_nested)"""

V4 = _items_view("sensor_usage", "app_name := p.p_brand, total_time := l_quantity",
                 "LEFT JOIN part p ON lineitem.l_partkey = p.p_partkey")

V5 = _items_view("sensor_labels", "label := l_returnflag, prob := l_discount")

V6 = V1 + """,
spine AS (
  WITH days AS (SELECT DISTINCT subject_id, CAST("timestamp" AS DATE) AS lifelog_date FROM sensor_scalar),
       rng AS (SELECT min(lifelog_date) AS d0, max(lifelog_date) AS d1 FROM days)
  SELECT subject_id, CAST(lifelog_date + INTERVAL 1 DAY AS DATE) AS sleep_date, lifelog_date,
         CASE WHEN datediff('day', d0, lifelog_date)
                   < CAST(floor((datediff('day', d0, d1) + 1) * 0.8::DOUBLE) AS INTEGER)
              THEN 'train' ELSE 'predict' END AS split
  FROM days, rng)"""

_P = """0.05::DOUBLE + 0.9::DOUBLE * CAST(((d.doc_id * 7919) % 1000 + 1000) % 1000 AS DOUBLE) / 999.0::DOUBLE AS p_a,
         1.0::DOUBLE / (1.0::DOUBLE + exp(-(ln(CAST(d.n_chars AS DOUBLE) + 1.0::DOUBLE) - 7.3::DOUBLE))) AS p_b,
         CASE WHEN {t} = 'quality' THEN 0.8::DOUBLE ELSE 0.1::DOUBLE END
           + 0.05::DOUBLE * CAST((d.doc_id % 3 + 3) % 3 AS DOUBLE) AS p_c"""

V7 = f"""labelled AS (
  SELECT d.doc_id AS key, d.source AS subject_id, d.doc_id AS ord, t.target, CAST(t.y AS INTEGER) AS y,
         {_P.format(t='t.target')}, 'train' AS split
  FROM documents d
  JOIN (UNPIVOT (SELECT doc_id, quality, toxic FROM labels) ON quality, toxic INTO NAME target VALUE y) t
    ON d.doc_id = t.doc_id
  UNION ALL
  SELECT d.doc_id AS key, d.source AS subject_id, d.doc_id AS ord, tg.target, CAST(NULL AS INTEGER) AS y,
         {_P.format(t='tg.target')}, 'predict' AS split
  FROM documents d CROSS JOIN (VALUES ('quality'), ('toxic')) tg(target)
  WHERE d.doc_id NOT IN (SELECT doc_id FROM labels))"""

PREDS = V7 + """,
preds AS (
  SELECT key, subject_id, ord, target, y, split, 'a' AS model, p_a AS pred FROM labelled
  UNION ALL SELECT key, subject_id, ord, target, y, split, 'b', p_b FROM labelled
  UNION ALL SELECT key, subject_id, ord, target, y, split, 'c', p_c FROM labelled)"""


def with_views(views: str, body: str) -> str:
    return f"WITH {views}\n{body}"


def rounded(body: str, keep: list[str], digits: int = 6) -> str:
    """Round every column except ``keep`` (the non-double ones) like ``round_doubles``."""
    r = f"round(COLUMNS(* EXCLUDE ({', '.join(keep)})) * 1.000000000001::DOUBLE, {digits})" if keep else \
        f"round(COLUMNS(*) * 1.000000000001::DOUBLE, {digits})"
    head = f"{', '.join(keep)}, " if keep else ""
    return f"SELECT {head}CASE WHEN {r} = 0 THEN 0.0::DOUBLE ELSE {r} END\nFROM (\n{body}\n) q"
