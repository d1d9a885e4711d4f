"""The fact tables in plain DuckDB SQL, for the oracles."""

OBS = """
WITH ev AS (
  SELECT event_id AS e, user_id AS u, ts, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k,
    CASE WHEN user_id % 10 < 6 THEN 'L' WHEN user_id % 10 < 9 THEN 'M' ELSE 'H' END AS product_type FROM events),
s1 AS (
  SELECT e + 1 AS udi, ts, product_type, product_type || '-' || lpad(CAST((u // 10) % 5 + 1 AS VARCHAR), 2, '0') AS machine_id,
    CASE WHEN hour(ts) < 8 THEN 'A' WHEN hour(ts) < 16 THEN 'B' ELSE 'C' END AS shift,
    CAST(abs(e % 4000 - 2000) AS DOUBLE) / 500e0 - 2e0 AS drift,
    floor((40e0 + (CAST((e * 7919) % 10007 AS DOUBLE) / 10007e0 + (k + 0.5e0) / 100e0 + CAST((e * 104729 + u * 31) % 9973 AS DOUBLE) / 9973e0 - 1.5e0) * 20e0) * 10e0) / 10e0 AS torque_nm,
    (CAST((e * 32452843 + 29) % 9949 AS DOUBLE) / 9949e0 + CAST((e * 49979687 + 43) % 9941 AS DOUBLE) / 9941e0 + CAST((e * 67867967 + 71) % 9931 AS DOUBLE) / 9931e0 - 1.5e0) * 2e0 AS noise,
    CAST((e * 15485863 + 17) % 9967 AS DOUBLE) / 9967e0 AS u4 FROM ev),
s2 AS (
  SELECT udi, ts, product_type, machine_id, shift,
    floor((300e0 + drift) * 10e0) / 10e0 AS air_temperature_k, floor((310e0 + drift + noise) * 10e0) / 10e0 AS process_temperature_k,
    floor(1540e0 - 16e0 * (torque_nm - 40e0) + 0.25e0 * (torque_nm - 40e0) * (torque_nm - 40e0) + 60e0 * (u4 - 0.5e0)) AS rotational_speed_rpm, torque_nm,
    CAST((udi // 10 * CASE product_type WHEN 'L' THEN 2 WHEN 'M' THEN 3 ELSE 5 END) % 250 AS DOUBLE) AS tool_wear_min FROM s1),
s3 AS (
  SELECT *, process_temperature_k - air_temperature_k AS temp_delta_k, torque_nm * rotational_speed_rpm * CAST(0.10471975511965977 AS DOUBLE) AS power_w,
    tool_wear_min * torque_nm AS overstrain_min_nm, CASE product_type WHEN 'L' THEN 11000e0 WHEN 'M' THEN 12000e0 ELSE 13000e0 END AS lim FROM s2),
s4 AS (
  SELECT *, temp_delta_k - 8.6e0 AS hdf_margin_0, rotational_speed_rpm - 1380e0 AS hdf_margin_1, power_w - 3500e0 AS pwf_margin_0, 9000e0 - power_w AS pwf_margin_1,
    lim - overstrain_min_nm AS osf_margin, greatest(200e0 - tool_wear_min, tool_wear_min - 240e0) AS twf_margin,
    temp_delta_k < 8.6e0 AND rotational_speed_rpm < 1380e0 AS hdf_rule, power_w < 3500e0 OR power_w > 9000e0 AS pwf_rule, overstrain_min_nm > lim AS osf_rule,
    tool_wear_min BETWEEN 200e0 AND 240e0 AS twf_rule FROM s3),
s5 AS (
  SELECT *, greatest(hdf_margin_0 / 8.6e0, hdf_margin_1 / 1380e0) AS hdf_distance, least(pwf_margin_0 / 3500e0, pwf_margin_1 / 9000e0) AS pwf_distance, osf_margin / lim AS osf_distance,
    CAST(hdf_rule AS INT) AS hdf, CAST(pwf_rule AS INT) AS pwf, CAST(osf_rule AS INT) AS osf, CAST(twf_rule AND (udi * 37) % 101 < 5 AS INT) AS twf, CAST(udi % 499 = 0 AS INT) AS rnf FROM s4),
obs AS (
  SELECT *, least(hdf_distance, pwf_distance, osf_distance) AS worst_margin, CAST(hdf + pwf + osf + twf > 0 OR udi % 997 = 7 AS INT) AS machine_failure FROM s5)
"""

SALES = """
WITH sales AS (
  SELECT l_orderkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, c_mktsegment, n_name, r_name,
    l_extendedprice * (1e0 - l_discount) AS revenue, CAST(l_returnflag = 'R' AS INT) AS returned
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
"""
