"""Relational queries by operator id: one text for both dialects, or (Spark, DuckDB)."""

from __future__ import annotations

_BETTER = "rank DESC, witness DESC, flow_len DESC, conf DESC, line, proc, type, tool, repo"
_COLUMNS = "location, proc, line, type, cwe, severity, conf, flow_len, witness"
_PRF = """RATIO(tp, nullif(tp + fp, 0)) AS prec, RATIO(tp, nullif(tp + fn, 0)) AS recall, RATIO(2 * tp, nullif(2 * tp + fp + fn, 0)) AS f1,
  CASE WHEN tp + fp > 0 THEN RATIO(tp, tp + fp) WHEN fn = 0 THEN 1e0 ELSE 0e0 END AS prec_of_nothing_is_right, CASE WHEN tp + fp > 0 THEN RATIO(tp, tp + fp) ELSE 0e0 END AS prec_of_nothing_is_zero,
  CASE WHEN tp + fn > 0 THEN RATIO(tp, tp + fn) ELSE 1e0 END AS recall_of_nothing_is_right, CASE WHEN tp + fn > 0 THEN RATIO(tp, tp + fn) ELSE 0e0 END AS recall_of_nothing_is_zero,
  RATIO(5 * tp, nullif(5 * tp + 4 * fn + fp, 0)) AS f2"""
#: Buckets around a line's own: what lies within the width of a bucket is in one of three, so a band join is an equi-join.
_AROUND = "(SELECT -1 AS step UNION ALL SELECT 0 UNION ALL SELECT 1) around"


def _bucketed(rows: str, width: int) -> str:
    """Rows with the bucket of their line."""
    return f"(SELECT *, FDIV(line, {width}) AS bucket FROM {rows})"


def _spread(rows: str, width: int) -> str:
    """Rows once for each bucket that a line within the width can lie in."""
    return f"(SELECT *, FDIV(line, {width}) + step AS bucket FROM {rows} CROSS JOIN {_AROUND})"


_MATCHED = f"""SELECT t.repo, t.location, t.cwe, t.line, count(f.line) AS hits FROM {_spread("(SELECT repo, location, cwe, line FROM v_truth WHERE status = 'true_positive') x", 5)} t
  LEFT JOIN {_bucketed("(SELECT DISTINCT repo, location, cwe, line FROM v_finding) y", 5)} f
  ON t.repo = f.repo AND t.location = f.location AND t.cwe = f.cwe AND t.bucket = f.bucket AND abs(t.line - f.line) <= 5 GROUP BY t.repo, t.location, t.cwe, t.line"""

SQL: dict[str, str | tuple[str, str]] = {
    # sources and path rules
    "A4_language_routing": """SELECT doc_id, CASE regexp_extract(path, '[.]([a-z]+)$', 1) WHEN 'py' THEN 'python' WHEN 'js' THEN 'javascript' WHEN 'jsx' THEN 'javascript' WHEN 'ts' THEN 'typescript' WHEN 'tsx' THEN 'typescript'
      WHEN 'java' THEN 'java' WHEN 'c' THEN 'c' WHEN 'h' THEN 'c' WHEN 'cpp' THEN 'cpp' WHEN 'cc' THEN 'cpp' WHEN 'cxx' THEN 'cpp' WHEN 'hpp' THEN 'cpp' WHEN 'cs' THEN 'csharp' ELSE 'python' END AS language FROM v_path""",
    "A5_extension_class": """SELECT cls, count(*) AS n FROM (SELECT CASE WHEN NOT RX(path, '[.][a-z]+$') THEN 'unknown' WHEN RX(path, '[.](py|java|ts|js|c|cpp|cs)$') THEN 'supported' WHEN RX(path, '[.](go|rb|php|rs)$') THEN 'unsupported' ELSE 'other' END AS cls FROM v_path) t GROUP BY cls""",
    "A6_generated_text": "SELECT doc_id, max(length(line)) > 2000 AS generated FROM v_line GROUP BY doc_id",
    "A7_path_filters": "SELECT doc_id, RX(path, '(^|/)(node_modules|vendor|third_party)/') AS vendored, RX(path, '(^|/)(tests?|spec|__tests__)/') AS test_path, RX(path, '(generated|[.]min[.])') AS generated FROM v_path",
    "A12_expected_rows": "SELECT trim(split_part(row_text, ',', 1)) AS test_name, trim(split_part(row_text, ',', 2)) AS category, lower(trim(split_part(row_text, ',', 3))) = 'true' AS vulnerable, CAST(trim(split_part(row_text, ',', 4)) AS INT) AS cwe FROM (SELECT CASE p_partkey % 9 WHEN 0 THEN '# ' WHEN 1 THEN '  #' ELSE ' ' END || 'T' || CAST(p_partkey AS STRING) || ', ' || CASE p_size % 3 WHEN 0 THEN 'sqli' WHEN 1 THEN 'xss' ELSE 'c#' END || ',' || CASE WHEN p_size % 2 = 0 THEN 'True' ELSE ' false' END || CASE WHEN p_partkey % 11 = 0 THEN '' ELSE ',' || CAST(70 + p_size % 20 AS STRING) END AS row_text FROM part) t WHERE NOT RX(row_text, '^[ ]*#') AND RX(row_text, '^[^,]*,[^,]*,[^,]*,')",
    "A16_test_name_fields": "SELECT location, CAST(regexp_extract(location, 'pkg([0-9]+)/', 1) AS INT) AS pkg, CAST(regexp_extract(location, 'mod_([0-9]+)', 1) AS INT) AS mod, regexp_extract(location, '[.]([a-z]+)$', 1) AS ext FROM (SELECT DISTINCT location FROM v_finding) t",
    "A17_finding_json": (
        "SELECT location, line, type, to_json(named_struct('cwe_id', cwe, 'line', line, 'location', location, 'severity', severity, 'type', type)) AS body FROM (SELECT DISTINCT location, line, type, cwe, severity FROM v_finding WHERE cwe IS NOT NULL) t",
        "SELECT location, line, type, CAST(json_object('cwe_id', cwe, 'line', line, 'location', location, 'severity', severity, 'type', type) AS STRING) AS body FROM (SELECT DISTINCT location, line, type, cwe, severity FROM v_finding WHERE cwe IS NOT NULL) t",
    ),
    "A18_sarif_rules": "SELECT coalesce(cwe, type) AS rule_id, min(type) AS name, CASE max(rank) WHEN 5 THEN 'error' WHEN 4 THEN 'error' WHEN 3 THEN 'warning' ELSE 'note' END AS level, count(*) AS results FROM v_ranked GROUP BY coalesce(cwe, type)",
    "A19_text_lines": "SELECT DISTINCT '[' || upper(severity) || '] ' || type || ' at ' || location || ':' || CAST(line AS STRING) || CASE WHEN cwe IS NULL THEN '' ELSE ' (' || cwe || ')' END AS text_line FROM v_finding",
    # projections and filters
    "B1_confidence": "SELECT location, line, type, proc, tool, CASE WHEN max_w THEN 1.0e0 WHEN flows > 0 THEN 0.8e0 ELSE 0.7e0 END AS confidence FROM (SELECT location, line, type, proc, tool, bool_or(witness) AS max_w, max(flow_len) AS flows FROM v_finding GROUP BY location, line, type, proc, tool) t",
    "B2_null_check_discount": """SELECT f.location, f.line, f.conf, count(g.line) AS guards, CASE WHEN f.conf * CASE WHEN count(g.line) > 0 THEN 6 ELSE 10 END >= 700 THEN true ELSE false END AS kept
      FROM """
    + _spread("(SELECT DISTINCT location, line, conf FROM v_finding WHERE type = 'null_dereference') x", 4)
    + " f LEFT JOIN "
    + _bucketed("(SELECT DISTINCT location, line FROM v_finding WHERE type = 'custom_rule' AND witness) y", 4)
    + """ g
      ON f.location = g.location AND f.bucket = g.bucket AND g.line BETWEEN f.line - 4 AND f.line + 2 GROUP BY f.location, f.line, f.conf""",
    "B3_min_severity": f"SELECT {_COLUMNS}, tool, repo FROM v_ranked WHERE rank >= 4",
    "B4_fail_on": "SELECT repo, bool_or(rank >= 5) AS fails_critical, bool_or(rank >= 3) AS fails_medium, CAST(CASE WHEN bool_or(rank >= 4) THEN 1 ELSE 0 END AS INT) AS exit_code FROM v_ranked GROUP BY repo",
    "B5_severity_and_cwe": "SELECT f.type, coalesce(upper(v.severity), 'MEDIUM') AS severity, v.cwe, count(*) AS n FROM v_finding f LEFT JOIN vuln v ON f.type = v.type GROUP BY f.type, v.severity, v.cwe",
    "B6_sink_to_type": "SELECT k.kind, coalesce(v.type, 'taint_flow') AS type FROM (SELECT DISTINCT lower(event_type) AS kind FROM events UNION SELECT type AS kind FROM v_finding) k LEFT JOIN vuln v ON k.kind = v.type",
    "B7_sink_alias": "SELECT raw.kind AS raw_kind, coalesce(a.kind, raw.kind) AS kind, count(*) AS calls FROM (SELECT CASE l_suppkey % 6 WHEN 0 THEN 'code' WHEN 1 THEN 'xxe' WHEN 2 THEN 'path' WHEN 3 THEN 'sql' WHEN 4 THEN 'redos' ELSE 'ssl' END AS kind FROM lineitem) raw LEFT JOIN sink_alias a ON raw.kind = a.raw GROUP BY raw.kind, coalesce(a.kind, raw.kind)",
    "B8_candidate_files": "SELECT p.doc_id FROM v_path p WHERE RX(p.text, '(password|token|secret|exec|eval)') OR EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = p.doc_id AND l.toxic = 1)",
    "B9_placeholder_values": "SELECT doc_id, line_no, regexp_extract(line, '(password|token|secret)[ ]*=[ ]*\"?([A-Za-z0-9]+)', 2) AS secret FROM v_line WHERE RX(line, '(password|token|secret)[ ]*=[ ]*\"?[A-Za-z0-9]{4,}') AND NOT RX(lower(line), '(changeme|placeholder|example|xxxx|[$][{])')",
    "B10_xss_return_suppression": "SELECT location, proc, line, type, tool FROM (SELECT DISTINCT location, proc, line, type, tool, max(CASE WHEN type <> 'xss' THEN 1 ELSE 0 END) OVER (PARTITION BY location, proc) AS other FROM v_finding) t WHERE NOT (type = 'xss' AND other = 1)",
    "B14_bounded_allocation": "SELECT a.proc, a.seq, a.var FROM v_instr a LEFT ANTI JOIN (SELECT DISTINCT proc, var FROM v_instr WHERE op = 'use' AND val < 100) g ON a.proc = g.proc AND a.var = g.var WHERE a.op = 'alloc' AND a.val > 150",
    "B17_format_strings": "SELECT doc_id, line_no, RX(line, '%[0-9.]*[sdn]') AS directive, RX(line, '%%%') AS escaped FROM v_line WHERE RX(line, '%')",
    "B17_unbounded_directives": "SELECT call, directive, (POSITION('%s' IN directive) > 0 OR POSITION('%[' IN directive) > 0) AS unbounded, count(*) AS calls FROM (SELECT CASE l_linenumber % 3 WHEN 0 THEN 'scanf' WHEN 1 THEN 'sscanf' ELSE 'fscanf' END AS call, CASE l_suppkey % 6 WHEN 0 THEN '%s' WHEN 1 THEN '%' || CAST(l_partkey % 9 + 1 AS STRING) || 's' WHEN 2 THEN '%[a-z]' WHEN 3 THEN '%7[^,]' WHEN 4 THEN '%d %s' ELSE '%d' END AS directive FROM lineitem) c GROUP BY call, directive, (POSITION('%s' IN directive) > 0 OR POSITION('%[' IN directive) > 0)",
    "B18_grounding": f"SELECT DISTINCT f.location, f.line, f.type FROM {_spread('(SELECT DISTINCT location, line, type FROM v_finding WHERE tool = ' + chr(39) + 'alpha' + chr(39) + ') x', 3)} f LEFT SEMI JOIN {_bucketed('(SELECT DISTINCT location, line, type FROM v_finding WHERE tool = ' + chr(39) + 'beta' + chr(39) + ') y', 3)} g ON f.location = g.location AND f.type = g.type AND f.bucket = g.bucket AND abs(f.line - g.line) <= 3",
    "B19_triage": """SELECT f.location, f.line, f.cwe, CASE WHEN v.status = 'false_positive' AND v.conf >= 75 THEN 'drop' WHEN v.conf IS NULL OR v.conf >= 35 AND v.conf < 75 THEN 'escalate' ELSE 'keep' END AS decision
      FROM (SELECT DISTINCT location, line, cwe FROM v_finding WHERE cwe IS NOT NULL) f LEFT JOIN (SELECT location, line, cwe, min(status) AS status, CAST(min((line * 7 + length(location)) % 100) AS INT) AS conf FROM v_truth GROUP BY location, line, cwe) v ON f.location = v.location AND f.line = v.line AND f.cwe = v.cwe""",
    # joins
    "C3_taint_sink_check": """SELECT DISTINCT s.l_suppkey, k.kind FROM lineitem s JOIN (SELECT s_suppkey, CASE s_nationkey % 3 WHEN 0 THEN 'sql' WHEN 1 THEN 'html' ELSE 'shell' END AS kind FROM supplier) k ON s.l_suppkey = k.s_suppkey
      JOIN (SELECT o_orderkey FROM orders LEFT SEMI JOIN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY') c ON o_custkey = c_custkey) o ON s.l_orderkey = o.o_orderkey
      LEFT ANTI JOIN (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'sql' ELSE 'html' END AS kind FROM part WHERE p_size % 5 = 0) z ON s.l_partkey = z.p_partkey AND k.kind = z.kind
      LEFT ANTI JOIN (SELECT p_partkey FROM part WHERE p_size = 7) a ON s.l_partkey = a.p_partkey""",
    "C4_usage_sink": "SELECT DISTINCT i.proc, i.var FROM v_instr i LEFT SEMI JOIN (SELECT DISTINCT proc FROM v_instr WHERE op = 'alloc') a ON i.proc = a.proc WHERE i.op = 'sink' AND i.val > 100",
    "C5_truths_near_findings": f"SELECT repo, count(*) AS truths, ISUM(CASE WHEN hits > 0 THEN 1 ELSE 0 END) AS found FROM ({_MATCHED}) m GROUP BY repo",
    "C5_mutual_best": """SELECT repo, cwe, count(*) AS pairs FROM (SELECT repo, cwe, location, t_line, f_line, row_number() OVER (PARTITION BY repo, cwe, location, t_line ORDER BY gap, f_line) AS a, row_number() OVER (PARTITION BY repo, cwe, location, f_line ORDER BY gap, t_line) AS b
      FROM (SELECT t.repo, t.cwe, t.location, t.line AS t_line, f.line AS f_line, abs(t.line - f.line) AS gap FROM """
    + _spread("(SELECT DISTINCT repo, cwe, location, line FROM v_truth) x", 5)
    + " t JOIN "
    + _bucketed("(SELECT DISTINCT repo, cwe, location, line FROM v_finding) y", 5)
    + """ f ON t.repo = f.repo AND t.cwe = f.cwe AND t.location = f.location AND t.bucket = f.bucket AND abs(t.line - f.line) <= 5) p) q WHERE a = 1 AND b = 1 GROUP BY repo, cwe""",
    "C6_expected_detected": "SELECT location, line, cwe, count(found) AS detections, min(CASE WHEN found IS NOT NULL THEN gap * 2 + CASE WHEN same THEN 0 ELSE 1 END END) AS best FROM (SELECT e.location, e.line, e.cwe, f.line AS found, abs(e.line - f.line) AS gap, e.cwe = f.cwe AS same FROM "
    + _spread("(SELECT DISTINCT location, line, cwe FROM v_truth) x", 2)
    + " e LEFT JOIN "
    + _bucketed("(SELECT DISTINCT location, line, cwe, type FROM v_finding WHERE cwe IS NOT NULL OR type = 'custom_rule') y", 2)
    + " f ON e.location = f.location AND e.bucket = f.bucket AND abs(e.line - f.line) <= 2 AND (e.cwe = f.cwe OR f.type = 'custom_rule')) t GROUP BY location, line, cwe",
    "C7_case_span": "SELECT c.location, c.start_line, c.stop_line, count(f.line) AS hits FROM (SELECT location, min(line) AS start_line, min(line) + 4 AS stop_line FROM v_truth GROUP BY location) c LEFT JOIN (SELECT DISTINCT location, line, cwe FROM v_finding) f ON c.location = f.location AND f.line BETWEEN c.start_line - 10 AND c.stop_line + 10 AND f.cwe IN ('CWE-89', 'CWE-22') GROUP BY c.location, c.start_line, c.stop_line",
    "C8_tool_agreement": """SELECT cwe, count_if(a AND b) AS both_tools, count_if(a AND NOT b) AS only_left, count_if(b AND NOT a) AS only_right FROM (SELECT coalesce(x.cwe, y.cwe) AS cwe, x.location IS NOT NULL AS a, y.location IS NOT NULL AS b FROM
      (SELECT DISTINCT location, cwe FROM v_finding WHERE tool = 'alpha' AND cwe IS NOT NULL AND conf >= 80) x FULL OUTER JOIN (SELECT DISTINCT location, cwe FROM v_finding WHERE tool = 'beta' AND cwe IS NOT NULL AND conf >= 80) y ON x.location = y.location AND x.cwe = y.cwe) t GROUP BY cwe""",
    "C9_paired_twins": "SELECT proc, bool_or(repo = 'repo0') AS on_vulnerable, bool_or(repo = 'repo1') AS on_fixed, bool_or(repo = 'repo0') AND NOT bool_or(repo = 'repo1') AS right_verdict FROM v_finding WHERE type = 'xss' GROUP BY proc",
    "C12_entry_points": "SELECT proc, name, called FROM (SELECT p.proc, CASE WHEN p.proc % 97 = 5 THEN 'main' ELSE 'f' || CAST(p.proc AS STRING) END AS name, c.callee IS NOT NULL AS called FROM (SELECT DISTINCT proc FROM v_stmt) p LEFT JOIN (SELECT DISTINCT callee FROM v_stmt WHERE op = 'call') c ON c.callee = p.proc) q WHERE NOT called OR name IN ('main', '__main__')",
    "C13_additive_merge": "SELECT location, cwe, 'own' AS origin FROM (SELECT DISTINCT location, cwe FROM v_finding WHERE tool = 'alpha' AND cwe IS NOT NULL) a UNION ALL SELECT g.location, g.cwe, 'added' FROM (SELECT DISTINCT location, cwe FROM v_finding WHERE tool = 'gamma' AND cwe IS NOT NULL) g LEFT ANTI JOIN (SELECT DISTINCT location, cwe FROM v_finding WHERE tool = 'alpha') a ON g.location = a.location AND g.cwe = a.cwe",
    "C14_heap_edges": "SELECT a.src, b.dst FROM v_heap a JOIN v_heap b ON a.dst = b.src",
    "C16_as_of": "SELECT event_id, user_id, CAST(LASTOF(CASE WHEN event_type = 'signup' THEN event_id END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS last_signup FROM events",
    # aggregations
    "D1_severity_counts": "SELECT location, count(*) AS total, count_if(severity = 'critical') AS critical, count_if(severity = 'high') AS high FROM v_finding GROUP BY location",
    "D2_grouping_sets": "SELECT repo, coalesce(cwe, 'unmapped') AS cwe, severity, count(*) AS n FROM v_finding GROUP BY GROUPING SETS ((repo), (cwe), (severity), ())",
    "D3_micro_counts": f"SELECT coalesce(repo, 'all') AS repo, coalesce(cwe, 'all') AS cwe, count_if(said AND so) AS tp, count_if(said AND NOT so) AS fp, count_if(so AND NOT said) AS fn FROM (SELECT coalesce(t.repo, f.repo) AS repo, coalesce(t.cwe, f.cwe) AS cwe, f.location IS NOT NULL AS said, t.location IS NOT NULL AS so FROM (SELECT DISTINCT repo, location, cwe FROM v_truth WHERE status = 'true_positive' AND line % 4 = 1) t FULL OUTER JOIN (SELECT DISTINCT repo, location, cwe FROM v_finding WHERE conf >= 85 AND cwe IS NOT NULL) f ON t.repo = f.repo AND t.location = f.location AND t.cwe = f.cwe) m GROUP BY GROUPING SETS ((repo), (cwe), ())",
    "D4_precision_recall": f"SELECT cwe, tp, fp, fn, {_PRF} FROM (SELECT coalesce(f.cwe, t.cwe) AS cwe, count_if(f.location IS NOT NULL AND t.location IS NOT NULL) AS tp, count_if(t.location IS NULL) AS fp, count_if(f.location IS NULL) AS fn FROM (SELECT DISTINCT location, cwe, line FROM v_finding WHERE cwe IS NOT NULL) f FULL OUTER JOIN (SELECT DISTINCT location, cwe, line FROM v_truth) t ON f.location = t.location AND f.cwe = t.cwe AND f.line = t.line GROUP BY coalesce(f.cwe, t.cwe)) x",
    "D5_youden": "SELECT lang, tp, fp, fn, tn, RATIO(tp, nullif(tp + fn, 0)) AS tpr, RATIO(fp, nullif(fp + tn, 0)) AS fpr, round(coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0e0) - coalesce(CAST(fp AS DOUBLE) / nullif(fp + tn, 0), 0e0), 4) AS youden FROM (SELECT lang, count_if(said AND toxic = 1) AS tp, count_if(said AND toxic = 0) AS fp, count_if(NOT said AND toxic = 1) AS fn, count_if(NOT said AND toxic = 0) AS tn FROM (SELECT d.lang, RX(lower(d.text), '(idiot|moron|stupid|scum|trash)') AS said, l.toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id) x GROUP BY lang) y",
    "D6_majority_vote": "SELECT proc, count(*) AS runs, count_if(hit) AS detected, 2 * count_if(hit) > count(*) AS majority, RATIO(5 * count_if(hit), 5 * count_if(hit) + 4 * count_if(NOT hit)) AS f2 FROM (SELECT proc, repo, bool_or(type = 'sql_injection' AND witness) AS hit FROM v_finding GROUP BY proc, repo) t GROUP BY proc",
    "D7_division_accuracy": "SELECT o_orderpriority AS division, count(*) AS cases, count_if(o_orderstatus = 'F') AS correct, RATIO(count_if(o_orderstatus = 'F'), count(*)) AS accuracy, round(avg(o_totalprice), 2) AS mean_ms, count_if(o_orderstatus = 'P') AS errors, SETOF(CASE WHEN o_orderstatus = 'P' AND o_totalprice > 480000 THEN CAST(o_orderkey AS STRING) END) AS failures FROM orders GROUP BY o_orderpriority",
    "D8_result_correctness": "SELECT expected, actual, count(*) AS n, bool_and(expected = actual OR expected = 'unknown' AND actual IN ('sat', 'unsat')) AS correct FROM (SELECT CASE o_custkey % 3 WHEN 0 THEN 'sat' WHEN 1 THEN 'unsat' ELSE 'unknown' END AS expected, CASE o_orderkey % 4 WHEN 0 THEN 'sat' WHEN 1 THEN 'unsat' WHEN 2 THEN 'unknown' ELSE 'error' END AS actual FROM orders) t GROUP BY expected, actual",
    "D9_macro_mean": f"SELECT round(avg(recall), 4) AS macro_recall, round(avg(prec), 4) AS macro_precision, RATIO(count_if(said = 0), count(*)) AS abstain_rate, count(*) AS tasks FROM (SELECT repo, location, cwe, RATIO(count_if(hits > 0), count(*)) AS recall, RATIO(ISUM(least(hits, 1)), nullif(ISUM(hits), 0)) AS prec, ISUM(hits) AS said FROM ({_MATCHED}) m GROUP BY repo, location, cwe) t",
    "D9_true_negatives": """SELECT t.tool, count(*) AS tasks, ISUM(CASE WHEN h.location IS NULL THEN 1 ELSE 0 END) AS silent, RATIO(ISUM(CASE WHEN h.location IS NULL THEN 1 ELSE 0 END), count(*)) AS true_negative_rate
      FROM (SELECT c.location, c.cwe, g.tool FROM (SELECT location, cwe FROM v_truth GROUP BY location, cwe HAVING count_if(status = 'true_positive') = 0) c CROSS JOIN (SELECT DISTINCT tool FROM v_finding) g) t
      LEFT JOIN (SELECT DISTINCT location, cwe, tool FROM v_finding) h ON h.location = t.location AND h.cwe = t.cwe AND h.tool = t.tool GROUP BY t.tool""",
    "D10_procedure_summary": "SELECT proc, var, bool_or(op = 'free') AS frees, bool_or(op = 'use') AS derefs, SETOF(op) AS ops FROM v_instr GROUP BY proc, var",
    "D11_constant_return": "SELECT proc, var, count(DISTINCT val) = 1 AND bool_and(op = 'assign') AS always_constant FROM v_instr GROUP BY proc, var",
    "D12_single_assignment": "SELECT proc, var, max(val) AS constant FROM v_instr WHERE op = 'assign' GROUP BY proc, var HAVING count(*) = 1",
    "D13_literals": "SELECT proc, var, count(DISTINCT val) AS literals, min(val) AS low, max(val) AS high, SETOF(CAST(val AS STRING)) AS all_literals FROM v_instr WHERE op = 'assign' GROUP BY proc, var",
    "D14_join_facts": "SELECT var, count(DISTINCT proc) = (SELECT count(DISTINCT proc) FROM v_instr) AS must_hold, count(*) > 0 AS may_hold, CASE WHEN min(val) = max(val) THEN CAST(min(val) AS STRING) ELSE 'phi_' || CAST(var AS STRING) END AS merged FROM v_instr WHERE op = 'assign' GROUP BY var",
    "D16_tools_per_cluster": "SELECT location, cwe, SETOF(tool) AS tools, count(DISTINCT tool) AS n_tools FROM v_finding WHERE cwe IS NOT NULL GROUP BY location, cwe",
    "D17_cube": "SELECT tool, severity, count(*) AS n, count(DISTINCT location) AS files FROM v_finding GROUP BY CUBE (tool, severity)",
    # windows
    "E1_dedup_line": f"SELECT {_COLUMNS} FROM (SELECT *, row_number() OVER (PARTITION BY location, line, proc, coalesce(cwe, type) ORDER BY {_BETTER}) AS r2 FROM (SELECT *, row_number() OVER (PARTITION BY location, line, proc, type ORDER BY {_BETTER}) AS r1 FROM (SELECT /*+ REPARTITION(location, line, proc) */ * FROM v_ranked) z) a WHERE r1 = 1) b WHERE r2 = 1",
    "E2_dedup_bucket": f"SELECT {_COLUMNS} FROM (SELECT *, row_number() OVER (PARTITION BY location, FDIV(line, 5), cwe ORDER BY {_BETTER}) AS r FROM v_ranked WHERE cwe IS NOT NULL) a WHERE r = 1 UNION ALL SELECT {_COLUMNS} FROM v_ranked WHERE cwe IS NULL",
    "E3_dedup_file": f"SELECT {_COLUMNS} FROM (SELECT *, row_number() OVER (PARTITION BY location, cwe ORDER BY {_BETTER}) AS r FROM v_ranked WHERE cwe IS NOT NULL) a WHERE r = 1",
    "E4_dedup_idor": f"SELECT {_COLUMNS} FROM (SELECT *, row_number() OVER (PARTITION BY location, proc, flow_len, cwe ORDER BY {_BETTER}) AS r FROM v_ranked WHERE type = 'path_traversal') a WHERE r = 1",
    "E5_better_order": f"SELECT location, {_COLUMNS.split(', ', 1)[1]} FROM (SELECT *, row_number() OVER (PARTITION BY location ORDER BY {_BETTER}) AS r FROM v_ranked) a WHERE r = 1",
    "E6_chained_clusters": "SELECT location, cwe, cluster, min(line) AS first_line, max(line) AS last_line, count(*) AS n FROM (SELECT location, cwe, line, CAST(sum(fresh) OVER (PARTITION BY location, cwe ORDER BY line ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cluster FROM (SELECT location, cwe, line, CASE WHEN line - lag(line) OVER (PARTITION BY location, cwe ORDER BY line) <= 3 THEN 0 ELSE 1 END AS fresh FROM (SELECT DISTINCT location, cwe, line FROM v_finding WHERE cwe IS NOT NULL) d) e) g GROUP BY location, cwe, cluster",
    "E7_typestate": "SELECT proc, seq, var, CASE WHEN op = 'free' THEN 'CWE-415' ELSE 'CWE-416' END AS cwe FROM (SELECT proc, seq, var, op, LASTOF(CASE WHEN op IN ('alloc', 'free') THEN op END) OVER (PARTITION BY proc, var ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM v_instr) t WHERE before = 'free' AND op IN ('free', 'use')",
    "E8_guard_invalidation": "SELECT proc, seq, var FROM (SELECT proc, seq, var, op, max(CASE WHEN op = 'assign' THEN seq END) OVER w AS written, max(CASE WHEN op = 'use' THEN seq END) OVER w AS guarded FROM v_instr WINDOW w AS (PARTITION BY proc, var ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) t WHERE op = 'sink' AND guarded IS NOT NULL AND (written IS NULL OR written < guarded)",
    "E9_context_snippet": "SELECT doc_id, line_no, AROUNDROWS(CAST(line_no AS STRING) || ': ' || substr(line, 1, 80), PARTITION BY doc_id ORDER BY line_no) AS snippet, '> ' || line AS marked FROM v_line WHERE line <> ''",
    "E10_line_budget": "SELECT doc_id, line_no FROM (SELECT doc_id, line_no, CAST(sum(length(line) + 8) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM v_line) t WHERE used <= 1200",
    "E11_stability_histogram": "SELECT detected, count(*) AS procs FROM (SELECT proc, count(DISTINCT repo) AS detected FROM v_finding WHERE severity = 'critical' AND witness GROUP BY proc) t GROUP BY detected",
    "E12_ranks": "SELECT p_partkey, CAST(ntile(4) OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS INT) AS quartile, cume_dist() OVER (PARTITION BY p_brand ORDER BY p_size) AS share, CAST(dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS INT) AS size_rank, lead(p_partkey) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS next_part FROM part",
    # recursion
    "F7_cwe_ancestors": "WITH RECURSIVE up AS (SELECT child, parent, 1 AS depth FROM cwe_edge UNION ALL SELECT u.child, e.parent, u.depth + 1 FROM up u JOIN cwe_edge e ON u.parent = e.child) SELECT u.child, u.parent AS ancestor, min(u.depth) AS depth, coalesce(max(f.n), 0) AS findings FROM up u LEFT JOIN (SELECT cwe, count(*) AS n FROM v_finding GROUP BY cwe) f ON f.cwe = u.child GROUP BY u.child, u.parent",
    "F7_matches_any": "WITH RECURSIVE up AS (SELECT child, parent, 1 AS depth FROM cwe_edge UNION ALL SELECT u.child, e.parent, u.depth + 1 FROM up u JOIN cwe_edge e ON u.parent = e.child) SELECT cwe, count(*) AS n FROM v_finding WHERE cwe IN (SELECT child FROM up WHERE parent IN ('CWE-74', 'CWE-118')) GROUP BY cwe",
    "F8_uninitialised_reads": "SELECT proc, seq, var FROM (SELECT proc, seq, var, op, count_if(op IN ('assign', 'alloc')) OVER (PARTITION BY proc, var ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS defs FROM v_instr) t WHERE op = 'use' AND defs = 0",
    "F9_leak_at_exit": "SELECT proc, var, seq FROM (SELECT proc, var, seq, op, row_number() OVER (PARTITION BY proc, var ORDER BY seq DESC) AS r FROM v_instr WHERE op IN ('alloc', 'free')) t WHERE r = 1 AND op = 'alloc'",
    # detectors
    "G3_constant_index": "SELECT i.proc, i.seq, i.var, CASE WHEN i.val - 60 < 0 THEN CASE WHEN i.op = 'assign' THEN 'CWE-124' ELSE 'CWE-127' END ELSE CASE WHEN i.op = 'assign' THEN 'CWE-787' ELSE 'CWE-125' END END AS cwe FROM v_instr i JOIN (SELECT proc, var, max(val) AS bound FROM v_instr WHERE op = 'alloc' GROUP BY proc, var) b ON i.proc = b.proc AND i.var = b.var WHERE i.op IN ('assign', 'use') AND (i.val - 60 < 0 OR i.val - 60 >= b.bound)",
    "G5_tainted_index": "SELECT DISTINCT u.proc, u.var FROM v_instr u JOIN (SELECT DISTINCT proc, var FROM v_instr WHERE op = 'sink') t ON u.proc = t.proc AND u.var = t.var LEFT ANTI JOIN (SELECT DISTINCT proc, var FROM v_instr WHERE op = 'assign' AND val < 40) g ON u.proc = g.proc AND u.var = g.var WHERE u.op = 'use'",
    "G6_unchecked_return": "SELECT proc, seq, var FROM (SELECT proc, seq, var, op, lead(op) OVER (PARTITION BY proc, var ORDER BY seq) AS next_op FROM v_instr) t WHERE op = 'alloc' AND coalesce(next_op, 'none') <> 'use'",
    "G7_stack_size": "SELECT proc, seq, val * 16384 AS bytes FROM v_instr WHERE op = 'alloc' AND val * 16384 >= 1048576",
    "G8_world_writable": "SELECT o_orderkey, CAST(o_custkey % 512 AS INT) AS mode FROM orders WHERE BITAND(CAST(o_custkey % 512 AS INT), 2) <> 0",
    "G11_heap_misuse": "SELECT proc, seq, var, CASE WHEN before IS NULL THEN 'CWE-590' WHEN before = 'free' THEN 'CWE-415' ELSE 'CWE-762' END AS cwe FROM (SELECT proc, seq, var, op, val, LASTOF(CASE WHEN op IN ('alloc', 'free') THEN op END) OVER w AS before, LASTOF(CASE WHEN op = 'alloc' THEN val END) OVER w AS made FROM v_instr WINDOW w AS (PARTITION BY proc, var ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) t WHERE op = 'free' AND (before IS NULL OR before = 'free' OR made % 2 <> val % 2)",
    "G21_buffer_sizes": "SELECT proc, seq, var, size_before, val FROM (SELECT proc, seq, var, op, val, LASTOF(CASE WHEN op = 'alloc' THEN val END) OVER (PARTITION BY proc, var ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS size_before FROM v_instr) t WHERE op = 'assign' AND val > size_before",
    # sorts and limits
    "H1_top_finding": (
        "SELECT repo, top.location AS location, top.line AS line, top.type AS type, top.severity AS severity, top.conf AS conf, n FROM (SELECT repo, max_by(struct(location, line, type, severity, conf), struct(rank, conf, location, line, type, proc, tool, flow_len, witness)) AS top, count(*) AS n FROM v_ranked GROUP BY repo) t",
        "SELECT repo, location, line, type, severity, conf, n FROM (SELECT *, count(*) OVER (PARTITION BY repo) AS n, row_number() OVER (PARTITION BY repo ORDER BY rank DESC, conf DESC, location DESC, line DESC, type DESC, proc DESC, tool DESC, flow_len DESC, witness DESC) AS r FROM v_ranked) t WHERE r = 1",
    ),
    "H2_top_six": f"SELECT cwe, type, location, line FROM (SELECT *, row_number() OVER (ORDER BY {_BETTER}, location) AS place FROM (SELECT *, row_number() OVER (PARTITION BY cwe, type, location ORDER BY {_BETTER}) AS r FROM v_ranked) a WHERE r = 1) b WHERE place <= 6",
    "H3_most_common": "SELECT cwe, n, CAST(row_number() OVER (ORDER BY n DESC, cwe) AS INT) AS place FROM (SELECT coalesce(cwe, 'unmapped') AS cwe, count(*) AS n FROM v_finding GROUP BY coalesce(cwe, 'unmapped')) t",
    "H6_sample_of_size": "SELECT division, p_partkey FROM (SELECT p_brand AS division, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY md5(CAST(p_partkey AS STRING)), p_partkey) AS r, count(*) OVER (PARTITION BY p_brand) AS n FROM part) t CROSS JOIN (SELECT count(*) AS every FROM part) e WHERE r <= greatest(1, CAST(floor(n * 60e0 / every) AS BIGINT)) ORDER BY md5(CAST(p_partkey AS STRING)), p_partkey LIMIT 60",
    "H6_stratified_sample": "SELECT division, p_partkey FROM (SELECT p_brand AS division, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY md5(CAST(p_partkey AS STRING)), p_partkey) AS r, count(*) OVER (PARTITION BY p_brand) AS n FROM part) t WHERE r <= greatest(1, CAST(floor(n * 0.1e0) AS BIGINT))",
    # sets
    "J1_union_producers": "SELECT location, line, 'alpha' AS tool FROM v_finding WHERE tool = 'alpha' UNION ALL SELECT location, line, 'beta' FROM v_finding WHERE tool = 'beta' UNION ALL SELECT location, line, 'gamma' FROM v_finding WHERE tool = 'gamma' UNION ALL SELECT location, line, 'truth' FROM v_truth UNION ALL SELECT CAST(doc_id AS STRING), line_no, 'lines' FROM v_line WHERE RX(line, '(password|token|secret)')",
    "J2_first_wins": "SELECT location, line, type, tool FROM (SELECT location, line, type, tool, row_number() OVER (PARTITION BY location, line, type ORDER BY CASE tool WHEN 'gamma' THEN 0 WHEN 'alpha' THEN 1 ELSE 2 END) AS r FROM (SELECT DISTINCT location, line, type, tool FROM v_finding) d) t WHERE r = 1",
    "J3_intersect": "SELECT location, cwe FROM v_finding WHERE tool = 'alpha' INTERSECT SELECT location, cwe FROM v_finding WHERE tool = 'beta'",
    "J3_except": "SELECT location, cwe, line FROM v_finding WHERE tool = 'alpha' EXCEPT SELECT location, cwe, line FROM v_finding WHERE tool = 'beta'",
    "J4_distinct": "SELECT DISTINCT repo, tool, severity FROM v_finding_all",
    "J5_overlay": "SELECT name, kind FROM (SELECT name, kind, row_number() OVER (PARTITION BY name ORDER BY precedence DESC, kind) AS r FROM (SELECT raw AS name, kind, 1 AS precedence FROM sink_alias UNION ALL SELECT DISTINCT CASE WHEN p_size % 2 = 0 THEN 'path' ELSE 'own_' || CAST(p_size AS STRING) END, 'overlaid', 2 FROM part) u) t WHERE r = 1",
    "J6_multiset_difference": (
        "SELECT p_brand || '|->' || CAST(p_size AS STRING) AS atom, count(*) AS left_over FROM (SELECT p_brand, p_size FROM part WHERE p_partkey % 2 = 0 EXCEPT ALL SELECT p_brand, p_size FROM part WHERE p_partkey % 2 = 1) t GROUP BY p_brand, p_size",
        "SELECT p_brand || '|->' || CAST(p_size AS STRING) AS atom, a - b AS left_over FROM (SELECT p_brand, p_size, count_if(p_partkey % 2 = 0) AS a, count_if(p_partkey % 2 = 1) AS b FROM part GROUP BY p_brand, p_size) t WHERE a > b",
    ),
    # scalar functions
    "L1_cwe_normalise": "SELECT raw, CASE WHEN RX(raw, '[0-9]') THEN 'CWE-' || CAST(CAST(regexp_extract(raw, '([0-9]+)', 1) AS INT) AS STRING) END AS cwe FROM (SELECT CASE p_size % 4 WHEN 0 THEN 'cwe_' || CAST(p_size AS STRING) WHEN 1 THEN CAST(p_size AS STRING) WHEN 2 THEN 'CWE-0' || CAST(p_size AS STRING) ELSE 'none' END AS raw FROM part) t",
    "L2_cwe_family": "SELECT cwe, CASE WHEN cwe IN ('CWE-89', 'CWE-79', 'CWE-78') THEN 'injection' WHEN cwe IN ('CWE-120', 'CWE-416', 'CWE-476') THEN 'memory' ELSE 'other' END AS family, count(*) AS n FROM v_finding GROUP BY cwe",
    "L3_cwe_category": "SELECT v.cwe, v.category, count(*) AS findings FROM (SELECT cwe, min(type) AS category FROM vuln WHERE cwe IS NOT NULL GROUP BY cwe) v JOIN v_finding f ON f.cwe = v.cwe GROUP BY v.cwe, v.category",
    "L4_paths": "SELECT DISTINCT location, regexp_extract(location, '([^/]+)$', 1) AS base, substr(location, instr(location, '/') + 1) AS relative FROM v_finding",
    "L5_sarif_levels": "SELECT severity, CASE severity WHEN 'critical' THEN 'error' WHEN 'high' THEN 'error' WHEN 'medium' THEN 'warning' ELSE 'note' END AS level, count(*) AS n FROM v_finding GROUP BY severity",
    "L6_cache_key": "SELECT doc_id, line_no, source || ':' || CAST(line_no AS STRING) || ':' || substr(sha1(line), 1, 12) AS cache_key FROM v_line",
    "L8_strings": "SELECT doc_id, length(text) AS n, substr(text, 3, 5) AS part, instr(text, 'the') > 0 AS has_the, RX(text, '^[A-Z][a-z]+ ') AS matches, UPCASE(substr(text, 1, 1)) || DOWNCASE(substr(text, 2, 3)) AS head FROM documents",
    "L9_bitvectors": "SELECT p_partkey, BITAND(p_partkey, 255) AS band, XOR(p_partkey, CAST(90 AS BIGINT)) AS bxor, BITAND(SHL(BITAND(p_partkey, 255), 3), 255) AS shl, SHR(BITAND(p_partkey, 255), 2) AS lshr, BITAND(p_partkey * 7 + 5, 255) AS wrapped, BITAND(p_partkey, 255) < 128 AS ult, BITAND(p_partkey * 7 - p_size, 255) AS subtracted, CAST(floor(BITAND(p_partkey, 255) / CAST(1 + BITAND(p_size, 15) AS DOUBLE)) AS BIGINT) AS udiv, BITAND(p_partkey, 255) % (1 + BITAND(p_size, 15)) AS urem, SIGNED(BITAND(p_partkey, 255)) % (1 + BITAND(p_size, 15)) AS srem, CAST(CHOP(SIGNED(BITAND(p_partkey, 255)) / CAST(1 + BITAND(p_size, 15) AS DOUBLE)) AS BIGINT) AS sdiv, BITAND(SHR(SIGNED(BITAND(p_partkey, 255)), 2), 255) AS ashr, 255 - BITAND(p_partkey, 255) AS bnot, BITAND(p_partkey, 255) < BITAND(p_size * 5, 255) AS less_u, SIGNED(BITAND(p_partkey, 255)) < SIGNED(BITAND(CAST(p_size AS BIGINT) * 5, 255)) AS less_s, SIGNED(BITAND(p_partkey, 255)) >= SIGNED(BITAND(CAST(p_size AS BIGINT) * 5, 255)) AS at_least_s, CASE WHEN BITAND(p_partkey, 255) >= 128 THEN BITAND(p_partkey, 255) - 256 ELSE BITAND(p_partkey, 255) END AS signed_value FROM part",
    "L10_arrays": (
        "SELECT p_partkey, CAST(coalesce(element_at(map_concat(map_filter(map(0, 10), (k, v) -> k <> p_size % 3), map(CAST(p_size % 3 AS INT), 7)), 0), -1) AS INT) AS selected FROM part",
        "SELECT p_partkey, CAST(CASE WHEN p_size % 3 = 0 THEN 7 ELSE 10 END AS INT) AS selected FROM part",
    ),
    "L15_previews": "SELECT doc_id, substr(text, 1, 200) || CASE WHEN length(text) > 200 THEN '...' ELSE '' END AS preview FROM documents",
    "L18_dates": "SELECT DAYTEXT(o_orderdate) AS day, count(*) AS n, ISUM(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS final FROM orders GROUP BY DAYTEXT(o_orderdate)",
    "L19_json": ("SELECT event_id, CAST(get_json_object(props, '$.k') AS INT) AS k FROM events", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events"),
    # streams, in their batch form
    "N2_tumbling_counts": (
        "SELECT event_type, FDIV(SECONDS(w.start), 3600) AS hour, n FROM (SELECT event_type, window(ts, '1 hour') AS w, count(*) AS n FROM events GROUP BY event_type, window(ts, '1 hour')) t",
        "SELECT event_type, FDIV(SECONDS(ts), 3600) AS hour, count(*) AS n FROM events GROUP BY event_type, FDIV(SECONDS(ts), 3600)",
    ),
    "N3_sessions": "SELECT user_id, session, count(*) AS n, min(event_id) AS first_event FROM (SELECT user_id, event_id, CAST(sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM (SELECT user_id, event_id, ts, CASE WHEN SECONDS(ts) - lag(SECONDS(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 1800 THEN 0 ELSE 1 END AS fresh FROM events) a) b GROUP BY user_id, session",
    # external verdicts
    "R1_merge_external": "SELECT location, line, type, CAST(CASE WHEN grounded THEN greatest(conf, 90) ELSE least(conf, 85) END AS INT) AS conf FROM (SELECT f.location, f.line, f.type, max(f.conf) AS conf, bool_or(g.location IS NOT NULL) AS grounded FROM "
    + _spread("(SELECT location, line, type, max(conf) AS conf FROM v_finding WHERE tool = 'gamma' GROUP BY location, line, type) x", 3)
    + " f LEFT JOIN "
    + _bucketed("(SELECT DISTINCT location, line, type FROM v_finding WHERE tool = 'alpha') y", 3)
    + " g ON f.location = g.location AND f.type = g.type AND f.bucket = g.bucket AND abs(f.line - g.line) <= 3 GROUP BY f.location, f.line, f.type) t",
    "R4_verify_fix": "SELECT b.repo, b.location, b.cwe, a.location IS NULL AS fixed FROM (SELECT DISTINCT repo, location, cwe FROM v_finding WHERE cwe IS NOT NULL) b LEFT JOIN (SELECT DISTINCT repo, location, cwe FROM v_finding WHERE conf > 95 AND cwe IS NOT NULL) a ON a.repo = b.repo AND a.location = b.location AND a.cwe = b.cwe",
}

#: DuckDB spells semi and anti joins without LEFT.
for _name, _sql in list(SQL.items()):
    if isinstance(_sql, str) and ("LEFT ANTI JOIN" in _sql or "LEFT SEMI JOIN" in _sql):
        SQL[_name] = (_sql, _sql.replace("LEFT ANTI JOIN", "ANTI JOIN").replace("LEFT SEMI JOIN", "SEMI JOIN"))
