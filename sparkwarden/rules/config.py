"""Insecure-configuration rules."""

from . import Rule

# Fixed values: (id, pattern, flags, severity, message, suggestion, anchors).
_ROWS = [
    ("insecure_config_debug_true", r"\bDEBUG\s*=\s*True\b", "", "high",
     "Django/Flask debug mode is enabled.",
     "Disable debug mode in production and gate it behind an environment variable.", ("DEBUG",)),
    ("insecure_config_app_debug_true", r"\bapp\.debug\s*=\s*(?:True|true)\b", "", "high",
     "Application debug mode is enabled.",
     "Disable debug mode outside local development.", ("app.debug",)),
    ("insecure_config_allowed_hosts_wildcard", r"""\bALLOWED_HOSTS\s*=\s*\[\s*["']\*["']\s*\]""", "", "high",
     "Django ALLOWED_HOSTS allows every host.",
     "Set ALLOWED_HOSTS to the exact production hostnames.", ("ALLOWED_HOSTS",)),
    ("insecure_config_cors_allow_all", r"\b(?:CORS_ALLOW_ALL|CORS_ALLOW_ALL_ORIGINS)\s*=\s*True\b", "", "high",
     "CORS is configured to allow every origin.",
     "Restrict CORS to trusted origins.", ("CORS_ALLOW_ALL",)),
    ("insecure_config_acao_wildcard", r"""Access-Control-Allow-Origin["']?\s*[:,]\s*["']\*["']""", "i", "medium",
     "Access-Control-Allow-Origin is set to '*'.",
     "Return a specific allowlisted origin instead of '*'.", ("access-control-allow-origin",)),
    ("insecure_config_disable_host_check", r"\bDANGEROUSLY_DISABLE_HOST_CHECK\s*=\s*(?:true|1)\b", "i", "high",
     "Host header checks are disabled.",
     "Remove DANGEROUSLY_DISABLE_HOST_CHECK and configure trusted hosts explicitly.",
     ("dangerously_disable_host_check",)),
    ("insecure_config_csrf_exempt", r"@csrf_exempt\b|\bcsrf_exempt\s*\(", "", "high",
     "CSRF protection is disabled for this endpoint.",
     "Keep CSRF protection enabled or add a narrower compensating control.", ("csrf_exempt",)),
    ("insecure_config_spring_permit_all", r"\.permitAll\s*\(", "", "medium",
     "Spring Security permitAll() may expose an endpoint.",
     "Confirm this endpoint is intentionally public and add authorization where needed.", (".permitAll",)),
    ("insecure_config_spring_security_disable", r"\bsecurity\.disable\s*=\s*true\b", "i", "high",
     "Spring security appears to be disabled.",
     "Enable Spring Security and use environment-specific test overrides if needed.", ("security.disable",)),
    ("insecure_config_cross_origin_wildcard", r"""@CrossOrigin\s*\([^)]*(?:origins\s*=\s*)?["']\*["'][^)]*\)""", "",
     "high",
     "Spring @CrossOrigin allows every origin.",
     "Restrict @CrossOrigin to trusted domains.", ("@CrossOrigin",)),
    ("insecure_config_eval", r"\beval\s*\(", "", "high",
     "eval() executes arbitrary code.",
     "Replace eval() with a structured parser or explicit dispatch table.", ("eval",)),
    ("insecure_config_python_exec", r"\bexec\s*\(", "", "high",
     "exec() executes arbitrary Python code.",
     "Avoid exec(); use explicit functions or safe parsers instead.", ("exec",)),
    ("insecure_config_pickle_loads", r"\bpickle\.loads?\s*\(", "", "high",
     "pickle deserialization can execute arbitrary code.",
     "Use JSON or a safe serialization format for untrusted data.", ("pickle.load",)),
    ("insecure_config_yaml_load_without_loader", r"\byaml\.load\s*\(\s*[^,\n)]+?\s*\)", "", "high",
     "yaml.load() is used without an explicit safe loader.",
     "Use yaml.safe_load() or pass SafeLoader explicitly.", ("yaml.load",)),
]

# Symbols a match must contain, where this is not an opening parenthesis.
_NEEDS = {
    "insecure_config_debug_true": ("=",),
    "insecure_config_app_debug_true": ("=",),
    "insecure_config_allowed_hosts_wildcard": ("=",),
    "insecure_config_cors_allow_all": ("=",),
    "insecure_config_acao_wildcard": ("*",),
    "insecure_config_disable_host_check": ("=",),
    "insecure_config_csrf_exempt": ("_",),
    "insecure_config_spring_security_disable": ("=",),
}

CONFIG_RULES = [
    Rule(id, pattern, flags, severity, "insecure_config", message, suggestion, "L1", anchors, _NEEDS.get(id, ("(",)))
    for id, pattern, flags, severity, message, suggestion, anchors in _ROWS
]
