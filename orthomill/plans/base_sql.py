"""SQL views of the domain adapters, shared by the SQL twins."""

PX = """
px AS (
  SELECT vec_id AS source_id, label, i AS pos, i // 8 AS r, i % 8 AS c,
         CAST(floor((CAST(embedding[i + 1] AS DOUBLE) + 1) * 128) AS BIGINT) AS b0,
         CAST(floor((CAST(embedding[(i + 1) % 64 + 1] AS DOUBLE) + 1) * 128) AS BIGINT) AS b1,
         CAST(floor((CAST(embedding[(i + 2) % 64 + 1] AS DOUBLE) + 1) * 128) AS BIGINT) AS b2
  FROM embeddings, range(64) t(i))
"""

MPX = PX.strip() + """,
mpx AS (
  SELECT source_id // 1000 AS source_id, ((source_id % 1000) // 20) * 8 + r AS r,
         ((source_id % 1000) % 20) * 8 + c AS c, b0, b1, b2
  FROM px),
mras AS (
  SELECT vec_id // 1000 AS source_id, (max(vec_id % 1000) // 20 + 1) * 8 AS h, 160 AS w
  FROM embeddings GROUP BY 1)
"""

RAS = """
ras AS (
  SELECT 'v' || c_custkey AS source_id, 200 + (c_custkey * 13) % 900 AS h, 200 + (c_custkey * 29) % 1100 AS w,
         500000e0 + (c_custkey % 100) * 1000 AS tx, 2000000e0 + (c_custkey % 77) * 1000 AS ty
  FROM customer)
"""

MASKS = PX.strip() + """,
msk AS (
  SELECT source_id, label, r, c, b0, b1, b2, b0 % 6 AS pred,
         CASE WHEN pos % 3 = 0 THEN label % 6 ELSE b0 % 6 END AS target
  FROM px)
"""

GRID = """
grid AS (
  SELECT printf('grid_t%05d', p_partkey) AS tile_id, p_partkey AS tile_no, p_partkey % 40 AS gx, p_partkey // 40 AS gy,
         p_size % 6 AS class_id, (p_partkey % 100) / 100e0 AS confidence
  FROM part)
"""

DETS = """
det AS (
  SELECT l_orderkey AS tile_id, CAST(l_partkey % 480 AS DOUBLE) AS x1, CAST((l_suppkey * 37) % 480 AS DOUBLE) AS y1,
         CAST(l_partkey % 480 + CAST(l_quantity AS BIGINT) AS DOUBLE) AS x2,
         CAST((l_suppkey * 37) % 480 + 5 + 7 * l_linenumber AS DOUBLE) AS y2,
         round(l_discount * 100) / 10e0 AS confidence,
         CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS class_id
  FROM lineitem)
"""

PTS = """
pts AS (
  SELECT l_orderkey AS tile_id, CAST(l_partkey % 512 AS DOUBLE) AS x, CAST(l_suppkey % 512 AS DOUBLE) AS y,
         l_quantity / 4e0 AS z
  FROM lineitem)
"""

DEC = """
dec AS (
  SELECT o_orderkey AS tile_id, (o_custkey % 100) / 100e0 AS accept_val, o_orderkey % 2 = 0 AS refine_flag,
         o_orderkey % 6 AS class_id, (o_orderkey % 97) / 96e0 AS confidence_val
  FROM orders)
"""

LAYER = """
lay AS (
  SELECT c_custkey // 1000 AS source_id, c_custkey AS feature_id,
         ['Built_Up_Area_type', 'Road', 'Road_Centre_Line', 'Water_Body', 'Water_Body_Line', 'Waterbody_Point',
          'Utility_Poly', 'Utility', 'Bridge', 'Railway', 'Contour', 'Survey_Grid'][c_nationkey % 12 + 1] AS layer,
         (c_custkey * 13) % 500 AS x1, (c_custkey * 29) % 500 AS y1,
         (c_custkey * 13) % 500 + 5 + c_custkey % 20 AS x2, (c_custkey * 29) % 500 + 5 + c_custkey % 20 AS y2
  FROM customer),
lcls AS (
  SELECT * FROM (VALUES ('Built_Up_Area_type', 1), ('Road', 2), ('Road_Centre_Line', 2), ('Water_Body', 4),
    ('Water_Body_Line', 4), ('Waterbody_Point', 4), ('Utility_Poly', 5), ('Utility', 5), ('Bridge', 5),
    ('Railway', 5)) v(layer, class_id)),
cls AS (SELECT lay.*, lcls.class_id FROM lay JOIN lcls USING (layer))
"""

DIAG = """
diag AS (
  SELECT strftime(ts, '%Y-%m-%d') AS run_id, 'tile_' || user_id AS tile_id, ts, event_id % 3 AS attempt,
         CASE WHEN event_type IN ('view', 'click') THEN 'complete' WHEN event_type = 'purchase' THEN 'skipped'
              WHEN event_type = 'error' THEN 'failed' ELSE 'error' END AS status,
         value AS elapsed_s, event_id
  FROM events)
"""

FEEDBACK = """
fb AS (SELECT doc_id AS tile_id, quality AS original_class, toxic AS corrected_class FROM labels)
"""

NAMES = """
cname AS (
  SELECT * FROM (VALUES (0, 'background'), (1, 'building'), (2, 'road'), (3, 'vegetation'), (4, 'water'),
    (5, 'other')) v(class_id, class_name))
"""

IDEC = """
idec AS (
  SELECT vec_id AS tile_id, (vec_id * 7 % 100) / 100e0 AS accept_val, vec_id % 2 = 0 AS refine_flag,
         label % 6 AS class_id, (vec_id % 97) / 96e0 AS confidence_val
  FROM embeddings)
"""

LOGITS = PX.strip() + """,
lg AS (
  SELECT source_id AS tile_id, r, c, b0, b1, b2,
         [((b0 * 3) % 23) / 10e0, ((b0 * 10 + b1) % 23) / 10e0, ((b0 * 17 + b1 * 2) % 23) / 10e0,
          ((b0 * 24 + b1 * 3) % 23) / 10e0, ((b0 * 31 + b1 * 4) % 23) / 10e0, ((b0 * 38 + b1 * 5) % 23) / 10e0] AS z
  FROM px),
sm0 AS (SELECT *, list_max(z) AS zm FROM lg),
sm1 AS (SELECT *, [exp(z[1] - zm), exp(z[2] - zm), exp(z[3] - zm), exp(z[4] - zm), exp(z[5] - zm), exp(z[6] - zm)] AS ez FROM sm0),
sm AS (SELECT *, list_position(z, zm) - 1 AS class_id, list_sum(ez) AS es FROM sm1)
"""

HEIGHT_STATS = """
hts AS (SELECT tile_id, avg(z) AS zm FROM pts GROUP BY 1)
"""
