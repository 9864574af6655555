"""Dimension rows as SQL text, the same for Spark and DuckDB."""

from __future__ import annotations

# Weakness types, their severity and CWE number as scanners report them; None is unknown.
VULNERABILITIES = (
    ("path_traversal", "high", 22),
    ("open_redirect", "medium", 601),
    ("ssrf", "high", 918),
    ("authorization_bypass", "critical", 863),
    ("cors_misconfiguration", "medium", 942),
    ("idor", "high", 639),
    ("header_injection", "medium", 113),
    ("secret_exposure", "critical", 200),
    ("debug_enabled", "medium", 215),
    ("security_misconfiguration", "medium", 16),
    ("weak_crypto", "high", 327),
    ("hardcoded_secret", "critical", 798),
    ("insecure_random", "medium", 330),
    ("insecure_cookie", "medium", 614),
    ("insecure_cookie_httponly", "medium", 1004),
    ("csrf", "medium", 352),
    ("weak_hash", "high", 328),
    ("missing_encryption", "high", 311),
    ("sensitive_data_exposure", "high", 200),
    ("improper_cert_validation", None, 295),
    ("insufficient_key_size", None, 326),
    ("weak_rsa_padding", None, 780),
    ("insufficient_credential_protection", None, 522),
    ("sql_injection", "critical", 89),
    ("xss", "high", 79),
    ("command_injection", "critical", 78),
    ("ldap_injection", "high", 90),
    ("xpath_injection", "medium", 643),
    ("xml_injection", None, 91),
    ("code_injection", "critical", 94),
    ("template_injection", "high", 1336),
    ("nosql_injection", "high", 943),
    ("xxe", "high", 611),
    ("regex_dos", "medium", 1333),
    ("orm_injection", "high", 89),
    ("el_injection", "high", 917),
    ("mass_assignment", "medium", 915),
    ("prototype_pollution", "high", 1321),
    ("business_logic_flaw", "medium", 840),
    ("race_condition", "high", 362),
    ("insecure_temp_file", "medium", 377),
    ("broken_authentication", "critical", 287),
    ("credential_stuffing", "high", 307),
    ("session_fixation", "high", 384),
    ("weak_password", "medium", 521),
    ("trust_boundary_violation", None, 501),
    ("deserialization", "critical", 502),
    ("code_integrity", "high", 494),
    ("ci_cd_vulnerability", "high", 1395),
    ("log_injection", "low", 117),
    ("sensitive_data_logged", "medium", 532),
    ("insufficient_logging", "low", 778),
    ("error_disclosure", "low", 209),
    ("unhandled_exception", "medium", 755),
    ("improper_error_handling", "medium", 388),
    ("null_dereference", "medium", 476),
    ("use_after_free", "critical", 416),
    ("buffer_overflow", "critical", 120),
    ("double_free", "high", 415),
    ("invalid_free", "high", 590),
    ("memory_leak", "low", 401),
    ("mismatched_free", "high", 762),
    ("return_stack_address", "high", 562),
    ("format_string", "high", 134),
    ("integer_overflow", "high", 190),
    ("uninitialized_var", "medium", 457),
    ("dangerous_function", "medium", 676),
    ("divide_by_zero", "medium", 369),
    ("type_confusion", "high", 843),
    ("assertion_failure", "medium", 617),
    ("unbounded_allocation", "medium", 770),
    ("uncontrolled_recursion", "medium", 674),
    ("infinite_loop", "medium", 835),
    ("oob_write", "critical", 787),
    ("oob_read", "high", 125),
    ("oob_underwrite", "critical", 124),
    ("oob_underread", "high", 127),
    ("excessive_allocation", "medium", 789),
    ("incorrect_permissions", "high", 732),
    ("unchecked_return", "high", 252),
    ("buffer_underflow", None, None),
    ("resource_leak", None, None),
    ("integer_underflow", None, None),
    ("sign_extension", None, None),
    ("unicode_handling", None, None),
    ("config_injection", None, None),
    ("resource_exhaustion", None, None),
    ("incomplete_cleanup", None, None),
    ("dead_store", None, None),
    ("improper_lock", None, None),
    ("unchecked_loop", None, None),
    ("improper_init", None, None),
    ("untrusted_path", None, None),
    ("data_sentinel", None, None),
    ("taint_flow", "medium", None),
)

# Child and parent numbers of the public CWE hierarchy.
CWE_PARENTS = (
    (74, 707),
    (20, 707),
    (79, 74),
    (94, 74),
    (77, 74),
    (78, 77),
    (91, 74),
    (93, 74),
    (113, 93),
    (917, 74),
    (943, 74),
    (89, 943),
    (90, 943),
    (643, 943),
    (1336, 94),
    (116, 707),
    (117, 116),
    (838, 116),
    (284, 664),
    (285, 284),
    (862, 285),
    (863, 285),
    (639, 863),
    (287, 284),
    (306, 287),
    (307, 287),
    (384, 287),
    (521, 287),
    (522, 287),
    (269, 284),
    (352, 863),
    (400, 664),
    (770, 400),
    (789, 770),
    (1333, 400),
    (404, 664),
    (772, 404),
    (401, 772),
    (834, 691),
    (674, 834),
    (835, 834),
    (362, 691),
    (667, 664),
    (118, 664),
    (119, 118),
    (120, 119),
    (125, 119),
    (787, 119),
    (788, 119),
    (786, 119),
    (122, 787),
    (122, 788),
    (124, 787),
    (124, 786),
    (127, 125),
    (127, 786),
    (672, 664),
    (416, 672),
    (415, 672),
    (476, 710),
    (457, 908),
    (908, 664),
    (843, 664),
    (668, 664),
    (706, 664),
    (22, 668),
    (22, 706),
    (610, 664),
    (611, 610),
    (918, 610),
    (601, 610),
    (377, 668),
    (732, 668),
    (200, 664),
    (209, 200),
    (532, 200),
    (215, 200),
    (501, 664),
    (327, 693),
    (328, 327),
    (326, 327),
    (780, 327),
    (330, 693),
    (311, 693),
    (295, 693),
    (345, 693),
    (347, 345),
    (494, 345),
    (798, 344),
    (344, 664),
    (502, 913),
    (913, 664),
    (915, 913),
    (1321, 915),
    (470, 913),
    (614, 311),
    (1004, 311),
    (190, 682),
    (369, 682),
    (134, 74),
    (755, 703),
    (388, 703),
    (617, 703),
    (754, 703),
    (252, 754),
    (676, 710),
    (778, 693),
    (942, 284),
)

# Sink kinds that stand for others.
SINK_ALIASES = (
    ("code", "eval"),
    ("xxe", "xml"),
    ("info_disclosure", "debug"),
    ("exception", "error_disclosure"),
    ("hardcoded_cred", "credential"),
    ("auth", "authz"),
    ("header_injection", "header"),
    ("ssl", "weak_crypto"),
    ("config", "secret"),
    ("weak_password_hash", "weak_hash"),
    ("path", "filesystem"),
    ("shell_command", "shell"),
    ("html_output", "html"),
)

# Severities by rank.
SEVERITIES = {"critical": 5, "high": 4, "medium": 3, "low": 2, "info": 1}


def _values(name: str, columns: str, rows: list[str]) -> str:
    return f"{name} AS (SELECT * FROM (VALUES {', '.join(rows)}) AS t({columns}))"


def _text(x, prefix: str = "") -> str:
    return "CAST(NULL AS STRING)" if x is None else f"'{prefix}{x}'"


VULN = _values("vuln", "type, severity, cwe", [f"({_text(t)}, {_text(s)}, {_text(c, 'CWE-')})" for t, s, c in VULNERABILITIES])
CWE_EDGE = _values("cwe_edge", "child, parent", [f"('CWE-{a}', 'CWE-{b}')" for a, b in CWE_PARENTS])
SINK_ALIAS = _values("sink_alias", "raw, kind", [f"('{a}', '{b}')" for a, b in SINK_ALIASES])
SEVERITY = _values("severity_rank", "severity, rank", [f"('{k}', {v})" for k, v in SEVERITIES.items()])
