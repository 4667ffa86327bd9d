"""Injection, cross-site-scripting, request-forgery and leakage rules over source text."""

from . import Rule

# Fixed values: (id, type, pattern, flags, severity, message, suggestion, anchors).
_ROWS = [
    ("sast_sql_template_interpolation", "sql_injection",
     r"""\b(?:query|sql|statement)\b\s*=\s*`[^`]*(?:SELECT|INSERT|UPDATE|DELETE)\b[^`]*\$\{[^}]+}[^`]*`""", "i", "high",
     "SQL query uses template interpolation.",
     "Use parameterized queries or a query builder that binds variables separately.", ("${",)),
    ("sast_sql_string_concat", "sql_injection",
     r"""\b(?:query|sql|statement)\b\s*=\s*["'][^"']*(?:SELECT|INSERT|UPDATE|DELETE)\b[^"']*["']\s*\+""", "i", "high",
     "SQL query is built with string concatenation.",
     "Use parameterized queries instead of concatenating user-controlled values.", ("query", "sql", "statement")),
    ("sast_sql_python_f_string_execute", "sql_injection",
     r"""\bexecute\s*\(\s*f["'][^"']*(?:SELECT|INSERT|UPDATE|DELETE)\b[^"']*\{[^}]+}[^"']*["']""", "i", "high",
     "Database execute() receives an interpolated SQL f-string.",
     "Use placeholders and pass parameters as a separate tuple or object.", ("execute",)),
    ("sast_sql_user_input_execute", "sql_injection",
     r"""\b(?:(?:db|database|pool|connection|conn|client|cursor|session)\.(?:query|execute|executemany)|(?:statement|preparedStatement|callableStatement)\.(?:execute|executeQuery|executeUpdate))\s*\([^\)\n]*(?:req\.(?:query|body|params)|request\.(?:args|form|json)|request\s*\.\s*(?:getParameter|getHeader|getQueryString)\s*\()""",
     "i", "high",
     "Database execution receives a user-controlled SQL value without bound parameters.",
     "Use placeholders and pass request values as a separate parameter array, tuple, or object.",
     (".query", ".execute")),
    ("sast_xss_inner_html", "xss",
     r"""\.(?:innerHTML|outerHTML)\s*=\s*(?!DOMPurify|sanitizeHtml|sanitize)[^;\n]+""", "", "high",
     "HTML is assigned directly to the DOM.",
     "Use textContent for plain text or sanitize trusted HTML before assignment.", (".innerHTML", ".outerHTML")),
    ("sast_xss_document_write", "xss",
     r"""\bdocument\.write\s*\(""", "", "high",
     "document.write() can introduce XSS.",
     "Avoid document.write(); create DOM nodes safely or sanitize first.", ("document.write",)),
    ("sast_xss_dangerously_set_inner_html", "xss",
     r"""dangerouslySetInnerHTML\s*=\s*\{\s*\{\s*__html\s*:\s*(?!DOMPurify|sanitizeHtml|sanitize)[^}]*\breq\.(?:query|body|params)\b[^}]*}\s*}""",
     "i", "high",
     "dangerouslySetInnerHTML receives user-controlled HTML.",
     "Use text rendering where possible, or sanitize untrusted HTML with a well-reviewed sanitizer before rendering it.",
     ("dangerouslysetinnerhtml",)),
    ("sast_ssrf_fetch_user_url", "ssrf",
     r"""\b(?:fetch|axios\.(?:get|post|put|patch|delete|head)|got(?:\.(?:get|post|put|patch|delete|head))?|undici\.request|(?:http|https)\.(?:get|request)|requests\.(?:get|post|put|patch|delete|head)|httpx\.(?:get|post|put|patch|delete|head)|urllib\.request\.urlopen)\s*\(\s*(?:req\.(?:query|body|params)|request\.(?:args|form|json))|\b(?:requests|httpx)\.request\s*\(\s*[^,\n]+,\s*(?:request\.(?:args|form|json))|\b(?:axios(?:\.request)?|(?:http|https)\.request)\s*\(\s*\{[^}\n]*\b(?:url|uri|baseURL|host|hostname)\s*:\s*(?:req\.(?:query|body|params))""",
     "i", "medium",
     "HTTP request appears to use a user-controlled URL.",
     "Allowlist outbound hosts and validate URL schemes before making server-side requests.", ("req.", "request.")),
    ("sast_ssrf_java_request_url", "ssrf",
     r"""\b(?:restTemplate\.(?:getForObject|getForEntity|postForObject|postForEntity|put|delete|exchange)|webClient\.(?:get|post|put|patch|delete)\s*\(\s*\)\s*\.uri|HttpRequest\.newBuilder|new\s+Request\.Builder\s*\(\s*\)\s*\.url)\s*\([^\n]*request\s*\.\s*(?:getParameter|getHeader|getQueryString)\s*\(""",
     "i", "medium",
     "Java HTTP client appears to use a request-controlled URL.",
     "Allowlist outbound hosts and validate URL schemes before making server-side requests.",
     ("getparameter", "getheader", "getquerystring")),
    ("sast_path_traversal_fs_user_input", "path_traversal",
     r"""\b(?:fs(?:\.promises)?\.(?:readFile|readFileSync|createReadStream|writeFile|writeFileSync|appendFile|appendFileSync|createWriteStream|unlink|unlinkSync|rm|rmSync)|open|Path\(|send_file)\s*\([^)\n]*(?:req\.(?:query|body|params)|request\.(?:args|form|json)|params?\[)""",
     "i", "high",
     "File path appears to include user-controlled input.",
     "Resolve paths against a fixed base directory and reject traversal outside that directory.",
     ("req.", "request.", "param")),
    ("sast_path_traversal_java_request_input", "path_traversal",
     r"""\b(?:Files\.(?:readAllBytes|readString|write|writeString|delete|deleteIfExists|newInputStream|newOutputStream)|Paths\.get|new\s+File)\s*\([^\n]*(?:request\s*\.\s*(?:getParameter|getHeader|getQueryString))\s*\(""",
     "i", "high",
     "Java file operation appears to use a request-controlled path.",
     "Resolve paths against a fixed base directory, validate the normalized path, and reject traversal outside it.",
     ("getparameter", "getheader", "getquerystring")),
    ("sast_insecure_deserialization_pickle", "insecure_deserialization",
     r"""\bpickle\.loads?\s*\([^)\n]*(?:request|req\.|input|body|data)""", "i", "high",
     "pickle is deserializing data that may be user-controlled.",
     "Use JSON or another safe format for untrusted data.", ("pickle.load",)),
    ("sast_insecure_deserialization_yaml", "insecure_deserialization",
     r"""\byaml\.load\s*\([^)\n]*(?:request|req\.|input|body|data)(?![^)]*SafeLoader)""", "i", "high",
     "yaml.load() may deserialize user-controlled data without SafeLoader.",
     "Use yaml.safe_load() for untrusted YAML.", ("yaml.load",)),
    ("sast_insecure_deserialization_java_object_input_stream", "insecure_deserialization",
     r"""\bnew\s+ObjectInputStream\s*\(\s*request\s*\.\s*(?:getInputStream|getReader)\s*\(""", "i", "high",
     "ObjectInputStream deserializes data directly from an HTTP request.",
     "Use a safe data format such as JSON and validate the request body before processing it.",
     ("objectinputstream",)),
    ("sast_command_injection_os_system", "command_injection",
     r"""\b(?:os\.system|subprocess\.(?:call|run|Popen|check_call|check_output)|child_process\.exec(?:Sync)?)\s*\([^)\n]*(?:request|req\.|input|body|params|\$\{)|\b(?:child_process\.)?(?:spawn(?:Sync)?|execFile(?:Sync)?)\s*\((?=[^)\n]*\bshell\s*:\s*true)[^)\n]*(?:request|req\.|input|body|params|\$\{)|\b(?:Runtime\s*\.\s*getRuntime\s*\(\s*\)\s*\.\s*exec|new\s+ProcessBuilder)\s*\([^)\n]*request\s*\.\s*(?:getParameter|getHeader|getQueryString)\s*\(""",
     "i", "high",
     "Command execution appears to include user-controlled input.",
     "Use argument arrays, strict allowlists, and avoid shell=True or string commands.",
     ("os.system", "subprocess.", "exec", "spawn", "processbuilder")),
    ("sast_open_redirect_user_input", "open_redirect",
     r"""\b(?:res|response)\.redirect\s*\(\s*(?:req\.(?:query|body|params)|request\.(?:query|body|params))|\bredirect\s*\(\s*(?:request\.(?:args|GET|POST)|req\.(?:query|body|params))""",
     "i", "medium",
     "Redirect target appears to come from user-controlled input.",
     "Redirect only to relative paths or allowlisted hosts after validating the destination.", ("redirect",)),
    ("sast_open_redirect_java_request_input", "open_redirect",
     r"""\b(?:response|resp|httpServletResponse)\s*\.\s*sendRedirect\s*\(\s*request\s*\.\s*(?:getParameter|getHeader|getQueryString)\s*\(|\bnew\s+RedirectView\s*\(\s*request\s*\.\s*(?:getParameter|getHeader|getQueryString)\s*\(|\breturn\s*["']redirect:[^"']*["']\s*\+\s*request\s*\.\s*(?:getParameter|getHeader|getQueryString)\s*\(""",
     "i", "medium",
     "Java redirect target appears to come directly from HTTP request input.",
     "Redirect only to relative paths or allowlisted hosts after validating the destination.", ("redirect",)),
    ("sast_information_leakage_error_details", "information_leakage",
     r"""\b(?:res|response)\.(?:send|json)\s*\([^;\n]*(?:err(?:or)?|exception)\.(?:stack|message)|\b(?:res|response)\.status\s*\(\s*500\s*\)\s*\.(?:send|json)\s*\([^;\n]*(?:err(?:or)?|exception)\.(?:stack|message)|\breturn\s+(?:traceback\.format_exc\s*\(\s*\)|str\s*\(\s*(?:err(?:or)?|exception|e)\s*\))|\b(?:res|response)(?:\.status\s*\(\s*5\d\d\s*\))?\.(?:send|json)\s*\([^;\n]*(?:\b(?:sql|query|stack|traceback|connection(?:string)?|database(?:url)?|api[_-]?key|secret|password|credential)\s*:|\(\s*(?:sql|query|stack|traceback|connection(?:string)?|database(?:url)?|api[_-]?key|secret|password|credential)\b)|\breturn\s*\{[^}\n]*(?:\b(?:error|detail|message)\s*:[^}\n]+,\s*)?\b(?:sql|query|stack|traceback|connection(?:string)?|database(?:url)?|api[_-]?key|secret|password|credential)\s*:""",
     "i", "low",
     "Detailed error or sensitive diagnostic information is returned to the client.",
     "Return a generic error response and log stack traces, SQL, and sensitive diagnostics server-side only.",
     ("res.", "response.", "return")),
    ("sast_information_leakage_java_error_details", "information_leakage",
     r"""\b(?:response|resp|httpServletResponse)\s*\.\s*sendError\s*\(\s*(?:5\d\d|HttpStatus\s*\.\s*INTERNAL_SERVER_ERROR)\s*,\s*(?:[A-Za-z_$][A-Za-z0-9_$]*(?:error|exception)|e)\s*\.\s*(?:getMessage|toString)\s*\(\s*\)|\bResponseEntity\s*\.\s*(?:status\s*\(\s*(?:5\d\d|HttpStatus\s*\.\s*INTERNAL_SERVER_ERROR)\s*\)|internalServerError\s*\(\s*\))\s*\.\s*body\s*\(\s*(?:[A-Za-z_$][A-Za-z0-9_$]*(?:error|exception)|e)\s*\.\s*(?:getMessage|toString)\s*\(\s*\)""",
     "i", "low",
     "Java error response exposes an exception message to the client.",
     "Return a generic error response and log exception details server-side only.",
     ("senderror", "responseentity")),
]

# Symbols a match must contain (any one of them), where this is not an opening parenthesis.
_NEEDS = {
    "sast_sql_template_interpolation": ("`",),
    "sast_sql_string_concat": ("+",),
    "sast_xss_inner_html": ("=",),
    "sast_xss_dangerously_set_inner_html": ("{",),
    "sast_open_redirect_java_request_input": ("(", "+"),
    "sast_information_leakage_error_details": ("(", "{"),
}

SAST_RULES = [
    Rule(id, pattern, flags, severity, type, message, suggestion, "L2", anchors, _NEEDS.get(id, ("(",)))
    for id, type, pattern, flags, severity, message, suggestion, anchors in _ROWS
]
