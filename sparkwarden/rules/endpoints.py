"""Route handlers, their prefixes and middleware, and the signs of security controls in a handler."""

from . import Rule

# Grammars of handlers and what surrounds them.
JS_ROUTE = (
    r"""\b(?:app|router)\s*\.\s*(get|post|put|patch|delete)\s*\(\s*["'`]([^"'`]+)["'`][\s\S]{0,900}?\{[\s\S]{0,1800}?\n\s*\}\s*\)?\s*;?"""
)
PY_ROUTE = (
    r"""@(?:app|router|blueprint)\.(?:route|get|post|put|patch|delete)\s*\(\s*["']([^"']+)["'][^\n]*\)\s*\n(?:@[^\n]+\n)*\s*(?:async\s+)?def\s+[A-Za-z_][A-Za-z0-9_]*\s*\([^)]*\)\s*:\s*\n(?:[ \t]+[^\n]*\n?){1,80}"""
)
DJANGO_GATE = r"\b(?:django|JsonResponse|HttpResponse|StreamingHttpResponse|api_view|login_required|permission_required)\b"
DJANGO_VIEW = (
    r"(?:^[\t ]*@[^\r\n]+\r?\n)*^[\t ]*(?:async\s+)?def\s+([A-Za-z_][A-Za-z0-9_]*)\s*\(\s*request(?:\s*:[^,)=]+)?(?:\s*=[^,)]+)?"
    r"(?:\s*,[^\r\n)]*)?\)\s*(?:->[^:\r\n]+)?\s*:\s*(?:\r?\n|\z)(?:^[\t ]+[^\r\n]*(?:\r?\n|\z)|^\s*(?:\r?\n|\z)){0,80}"
)
DJANGO_ROUTE = r"""\b(?:path|re_path)\s*\(\s*r?["']([^"']+)["']\s*,\s*([A-Za-z_][A-Za-z0-9_]*)\b"""
SPRING_ROUTE = (
    r"@(?:(Get|Post|Put|Patch|Delete)Mapping|RequestMapping)\s*(?:\(([^)]*)\))?\s*(?:@[A-Za-z_$][A-Za-z0-9_$.]*(?:\s*\([^)]*\))?\s*)*"
    r"(?:public|protected|private)\s+(?:static\s+)?[A-Za-z_$][A-Za-z0-9_$<>, ?\[\].]*\s+[A-Za-z_$][A-Za-z0-9_$]*\s*\([^)]*\)\s*"
    r"(?:throws[^\{]+)?\{([\s\S]{0,2200}?)\}"
)
SPRING_PREFIX = (
    r"@RequestMapping\s*\(([^)]*)\)\s*(?:@[A-Za-z_$][A-Za-z0-9_$.]*(?:\s*\([^)]*\))?\s*)*(?:public\s+)?(?:class|interface)\s+"
    r"[A-Za-z_$][A-Za-z0-9_$]*"
)
MIDDLEWARE = r"""\b(?:app|router)\s*\.\s*use\s*\(\s*(?:(["'`])([^"'`]+)\1\s*,\s*)?([^\r\n;]+)"""
DJANGO_RESPONSE = r"\b(?:JsonResponse|HttpResponse|StreamingHttpResponse|Response|render|redirect)\s*\(|@api_view\b"


def _rule(id: str, pattern: str, flags: str, anchors: tuple[str, ...], symbols: tuple[str, ...] = ("(",)) -> Rule:
    return Rule(id, pattern, flags, "info", "other", "", None, "L3", anchors, symbols)


ENDPOINT_RULES = [
    _rule("js_route", JS_ROUTE, "i", ("app", "router")),
    _rule("py_route", PY_ROUTE, "", ("@app.", "@router.", "@blueprint.")),
    _rule("django_gate", DJANGO_GATE, "i", ("django", "jsonresponse", "httpresponse", "api_view", "_required"), ("",)),
    _rule("django_view", DJANGO_VIEW, "m", ("request",)),
    _rule("django_route", DJANGO_ROUTE, "", ("path",)),
    _rule("spring_route", SPRING_ROUTE, "", ("Mapping",), ("{",)),
    _rule("spring_prefix", SPRING_PREFIX, "", ("@RequestMapping",)),
    _rule("middleware", MIDDLEWARE, "", ("app", "router")),
]

# Frameworks in the order in which they are recognised.
FRAMEWORKS = [
    ("Spring", r"\borg\.springframework\b|\bSpringApplication\b|@(?:Rest)?Controller\b|@(?:Get|Post|Put|Patch|Delete|Request)Mapping\b", ""),
    ("FastAPI", r"\b(?:from\s+fastapi\s+import|FastAPI\s*\()", "i"),
    ("Flask", r"\b(?:from\s+flask\s+import|Flask\s*\(|Blueprint\s*\()", "i"),
    ("Django", r"\b(?:django|urlpatterns|path\s*\()", "i"),
    ("NestJS", r"\b(?:@nestjs|NestFactory)\b", "i"),
    ("Express", r"""\b(?:from\s+['"]express['"]|require\s*\(\s*['"]express['"]\s*\)|express\s*\()""", "i"),
    ("Koa", r"""\b(?:from\s+['"]koa['"]|require\s*\(\s*['"]koa['"]\s*\)|new\s+Koa\s*\()""", "i"),
]
REACT_ELEMENT = r"<\s*[A-Z][A-Za-z0-9]*"
FUNCTION_NAMES = [
    r"\b(?:async\s+)?function\s+([A-Za-z_$][A-Za-z0-9_$]*)\s*\(",
    r"\b(?:const|let|var)\s+([A-Za-z_$][A-Za-z0-9_$]*)\s*=\s*(?:async\s*)?\([^)]*\)\s*=>",
    r"\b(?:async\s+)?def\s+([A-Za-z_][A-Za-z0-9_]*)\s*\(",
    r"\b(?:public|protected|private)\s+(?:static\s+)?[A-Za-z_$][A-Za-z0-9_$<>, ?\[\].]*\s+([A-Za-z_$][A-Za-z0-9_$]*)\s*\(",
]

# Signs in a path, a handler or a middleware.
AUTH_MIDDLEWARE = (
    r"(?:\b(?:authenticate|authorize)[A-Za-z_$]*\b|\brequire(?:auth|authentication|authorization|login)\b|\bverify(?:token|jwt)\b|"
    r"\bprotect(?:ed)?\b|\bauth(?:entication|orization)?middleware\b|passport\s*\.\s*authenticate|expressjwt|\bjwtmiddleware\b)"
)
RATE_MIDDLEWARE = r"(?:rate\s*limit|rateLimit(?:er)?|throttle|limiter)"
SENSITIVE_PATH = r"admin|account|billing|payment|profile|settings|user|token|secret|private"
ABUSED_PATH = r"login|register|signup|password|reset|token|upload|invite"
USER_INPUT = (
    r"\b(req\.(?:body|query|params)|request\.(?:json|form|args|GET|POST|body|FILES|headers|META)|body|query|params)\b|"
    r"@(?:RequestBody|RequestParam|PathVariable|RequestHeader|ModelAttribute)\b|\bHttpServletRequest\b"
)
DATABASE = (
    r"\b(?:db|database|pool|client|connection|conn|session|cursor|repository)\s*\.\s*(?:query|execute|raw|find|create|update|delete|insert|save|persist)\b|"
    r"\b[a-z_][a-z0-9_]*\.objects\s*\.\s*(?:get|filter|exclude|create|update|delete|bulk_create|bulk_update)\b|\b(?:select|insert|update|delete)\b"
)
DYNAMIC_SQL = r"\b(?:select|insert|update|delete)\b[\s\S]{0,300}(?:\$\{|\+|\{[a-z_$]|%\s*(?:\(|[a-z_$]))"
BOUND_QUERY = [
    (r"\b(?:query|execute)\s*\(\s*[^,\n]+,\s*(?:\[[^\]]*\]|\([^)]*\)|\{[^}]*\}|params?\b|values?\b)", ""),
    (r"""@query\s*\(\s*["'][^"']*(?:\?|:[a-z_$][a-z0-9_$]*)""", "i"),
    (r"\b(?:jdbcTemplate|namedParameterJdbcTemplate)\s*\.\s*(?:query|update|execute)\s*\(\s*[^,\n]+,\s*[^)]", ""),
]
IO_CALL = (
    r"\b(?:fetch|axios\.(?:get|post|put|patch|delete)|requests\.(?:get|post|put|patch|delete)|http\.get|"
    r"fs\.(?:readFile|readFileSync|writeFile|writeFileSync|createReadStream)|open|send_file|(?:child_process\.)?exec|"
    r"subprocess\.(?:call|run|popen)|restTemplate\.(?:get|post|put|exchange)|webClient\.|files\.(?:read|write))\s*\("
)
HTML_RESULT = r"""\b(?:res\.send|return)\s*\(?\s*[`"'][\s\S]{0,120}<[a-z][\s\S]*>"""
HAS_AUTH = (
    r"\b(authenticate|authorize|requireauth|isauthenticated|verifytoken|jwt|session|current_user|depends\s*\(\s*get_current_user|"
    r"login_required|permission_required|bearer|preauthorize|secured|rolesallowed|authentication|securitycontext|principal)\b"
)
HAS_RATE_LIMIT = r"\b(ratelimit|rate_limit|limiter|throttle|slowapi|express-rate-limit|bucket4j|@limit)\b"
HAS_VALIDATION = (
    r"\b(validate|validated|validator|schema|zod|joi|yup|pydantic|sanitize|escape|safeparse|parse_obj|basemodel|is_valid|full_clean|"
    r"cleaned_data)\b|\bforms?\.(?:form|modelform)\b|@(?:valid|validated|notnull|notblank|notempty|size|pattern)\b"
)
HAS_ERROR_HANDLING = r"\btry\s*(?:\{|:)|\bcatch\s*\(|\.catch\s*\(|\bexcept\b|\bonerror\b|\b(?:handle|error)_?handler\b"
HAS_ENCODING = r"\b(escape|sanitize|dompurify|html\.escape|markupsafe|bleach|encode)\b"

# Fixed values: (rule, severity, message after the endpoint, suggestion).
CONTROL_CHECKS = [
    ("l3_missing_authentication", "high", "appears to access sensitive functionality without obvious authentication.",
     "Add authentication/authorization middleware or decorators before exposing this endpoint."),
    ("l3_missing_rate_limiting", "medium", "looks abuse-prone and has no obvious rate limiting.",
     "Add a rate limiter for login, registration, password reset, upload, or write-heavy endpoints."),
    ("l3_missing_input_validation", "medium", "uses request input without obvious validation.",
     "Validate and sanitize request body, query, and route parameters with an explicit schema or validator."),
    ("l3_missing_parameterized_queries", "high", "appears to build a database query from request input without bound parameters.",
     "Use a prepared statement or query parameters instead of interpolating request values into SQL."),
    ("l3_missing_error_handling", "low", "performs IO without obvious error handling.",
     "Handle failures with try/catch, promise rejection handling, or framework-specific error middleware and return a safe error response."),
    ("l3_missing_output_encoding", "medium", "returns HTML without obvious output encoding.",
     "Escape or sanitize dynamic values before returning HTML."),
]
