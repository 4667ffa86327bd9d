"""Anti-patterns typical of generated code. Their language hints are recorded but not used for matching."""

from . import Rule

_JS = ("javascript", "typescript")
_PY = ("python",)
_JS_PY = ("javascript", "typescript", "python")

# Fixed values: (id, languages, pattern, flags, severity, message, suggestion, anchors).
_ROWS = [
    ("ai_pattern_default_password", (),
     r"""\b(?:password|passwd|pwd)\s*[:=]\s*["'](?:admin|password|123456|12345678|changeme)["']""", "i", "critical",
     "Default password is hardcoded.",
     "Generate a unique secret per environment and force users to set their own password.",
     ("password", "passwd", "pwd")),
    ("ai_pattern_admin_admin_credentials", (),
     r"""\b(?:username|user|login)\s*[:=]\s*["']admin["'][\s\S]{0,120}\b(?:password|passwd|pwd)\s*[:=]\s*["']admin["']""",
     "i", "critical",
     "Default admin/admin credentials are present.",
     "Remove default credentials and provision an initial admin through a secure setup flow.",
     ("admin",)),
    ("ai_pattern_hardcoded_jwt_secret", (),
     r"""\bJWT_SECRET\b\s*[:=]\s*["'`](?!process\.env|import\.meta\.env|os\.getenv)[^"'`]{8,}["'`]""", "", "critical",
     "JWT secret is hardcoded.",
     "Load JWT_SECRET from a secret manager or environment variable and rotate the committed value.",
     ("JWT_SECRET",)),
    ("ai_pattern_sql_f_string", _PY,
     r"""\bf["'`][^"'`]*(?:SELECT|INSERT|UPDATE|DELETE)\b[^"'`]*\{[^}]+\}[^"'`]*["'`]""", "i", "high",
     "SQL query appears to interpolate a variable directly.",
     "Use parameterized queries instead of string interpolation.",
     ("f\"", "f'", "f`")),
    ("ai_pattern_dangerously_set_inner_html", _JS,
     r"""dangerouslySetInnerHTML\s*=\s*\{\s*\{\s*__html\s*:\s*(?!DOMPurify|sanitizeHtml|sanitize)[^}]+}\s*}""", "",
     "high",
     "dangerouslySetInnerHTML is used without an obvious sanitizer.",
     "Sanitize HTML with a trusted sanitizer before passing it to dangerouslySetInnerHTML.",
     ("dangerouslySetInnerHTML",)),
    ("ai_pattern_frontend_secret_name", _JS,
     r"""\b(?:VITE|NEXT_PUBLIC|REACT_APP)_[A-Z0-9_]*(?:SECRET|PRIVATE|TOKEN|API_KEY)[A-Z0-9_]*\s*[:=]\s*["'`][^"'`]{8,}["'`]""",
     "", "critical",
     "Secret-like value is exposed through a frontend environment variable.",
     "Move secrets to server-side configuration; frontend-prefixed variables are public.",
     ("VITE_", "NEXT_PUBLIC_", "REACT_APP_")),
    ("ai_pattern_jwt_none_algorithm", _JS,
     r"""\bjwt\.(?:sign|verify)\s*\([\s\S]{0,240}\balgorithms?\s*:\s*(?:\[\s*)?["']none["']""", "i", "critical",
     "JWT accepts the none algorithm.",
     "Remove none from allowed JWT algorithms and require a signed token algorithm such as RS256 or HS256.",
     ("jwt.sign", "jwt.verify")),
    ("ai_pattern_jwt_ignore_expiration", _JS,
     r"""\bjwt\.verify\s*\([\s\S]{0,240}\bignoreExpiration\s*:\s*true\b""", "i", "high",
     "JWT expiration validation is disabled.",
     "Require token expiration checks and refresh tokens through a controlled flow.",
     ("ignoreexpiration",)),
    ("ai_pattern_jwt_decode_without_verify", _JS,
     r"""\bjwt\.decode\s*\(\s*(?:req\.|request\.|token|authorization|authHeader)""", "i", "high",
     "JWT is decoded without signature verification.",
     "Use jwt.verify() with an expected algorithm and issuer/audience checks before trusting token claims.",
     ("jwt.decode",)),
    ("ai_pattern_cors_credentials_wildcard", _JS,
     r"""\bcors\s*\(\s*\{(?:[\s\S]{0,240}\borigin\s*:\s*["']\*["'][\s\S]{0,240}\bcredentials\s*:\s*true|[\s\S]{0,240}\bcredentials\s*:\s*true[\s\S]{0,240}\borigin\s*:\s*["']\*["'])""",
     "i", "high",
     "CORS allows wildcard origins with credentials.",
     "Use an explicit origin allowlist when credentials or cookies are allowed.",
     ("credentials",)),
    ("ai_pattern_tls_verification_disabled", _JS,
     r"""\bNODE_TLS_REJECT_UNAUTHORIZED\b\s*=\s*["']?0["']?|\brejectUnauthorized\s*:\s*false\b""", "i", "high",
     "TLS certificate verification is disabled.",
     "Keep certificate verification enabled and fix trust store or certificate configuration instead.",
     ("node_tls_reject_unauthorized", "rejectunauthorized")),
    ("ai_pattern_requests_verify_false", _PY,
     r"""\brequests\.(?:get|post|put|patch|delete|request)\s*\([^\)\n]*\bverify\s*=\s*False\b""", "", "high",
     "Python HTTP request disables TLS verification.",
     "Remove verify=False and configure trusted certificate authorities explicitly.",
     ("requests.",)),
    ("ai_pattern_bcrypt_low_rounds", _JS,
     r"""\bbcrypt(?:js)?\.(?:hash|genSalt)\s*\([^\)\n]*,\s*[0-4]\s*\)""", "i", "high",
     "bcrypt uses an extremely low work factor.",
     "Use a modern bcrypt cost factor, commonly 10 or higher, and tune it for your environment.",
     ("bcrypt",)),
    ("ai_pattern_plaintext_password_compare", _JS,
     r"""\b(?:password|passwd|pwd)\s*={2,3}\s*(?:user|dbUser|account)\.(?:password|passwd|pwd)\b|\b(?:user|dbUser|account)\.(?:password|passwd|pwd)\s*={2,3}\s*(?:password|passwd|pwd)\b""",
     "i", "high",
     "Password appears to be compared in plaintext.",
     "Store password hashes and compare with a constant-time password hashing verifier such as bcrypt.compare().",
     ("==",)),
    ("ai_pattern_weak_password_hash", _JS_PY,
     r"""\b(?:crypto\.)?createHash\s*\(\s*["'](?:md5|sha1)["']\s*\)[\s\S]{0,160}\b(?:password|passwd|pwd)\b|\bhashlib\.(?:md5|sha1)\s*\([^\)\n]*(?:password|passwd|pwd)""",
     "i", "high",
     "Weak hash function appears to protect a password.",
     "Use a password hashing function such as bcrypt, scrypt, Argon2, or PBKDF2 with a per-user salt.",
     ("createhash", "hashlib.")),
    ("ai_pattern_session_secret_placeholder", _JS,
     r"""\b(?:session|cookieSession)\s*\(\s*\{[\s\S]{0,180}\bsecret\s*:\s*["'](?:secret|keyboard cat|changeme|password|123456)["']""",
     "i", "critical",
     "Session middleware uses a placeholder secret.",
     "Load a high-entropy session secret from a secret manager or environment variable.",
     ("secret",)),
    ("ai_pattern_math_random_token", _JS,
     r"""\b(?:token|secret|apiKey|resetToken|sessionId)\b\s*[:=]\s*Math\.random\s*\(""", "", "high",
     "Security token is generated with Math.random().",
     "Use crypto.randomBytes() or Web Crypto for security-sensitive random values.",
     ("Math.random",)),
    ("ai_pattern_flask_secret_key_placeholder", _PY,
     r"""\b(?:app\.config\s*\[\s*["']SECRET_KEY["']\s*\]\s*=|SECRET_KEY\s*=)\s*["'](?:secret|dev|development|changeme|password|123456)["']""",
     "i", "critical",
     "Flask/Django secret key uses a placeholder value.",
     "Generate a high-entropy SECRET_KEY and load it from environment-specific secret storage.",
     ("secret_key",)),
    ("ai_pattern_fastapi_cors_credentials_wildcard", _PY,
     r"""\bCORSMiddleware\b[\s\S]{0,300}\ballow_origins\s*=\s*\[\s*["']\*["']\s*\][\s\S]{0,300}\ballow_credentials\s*=\s*True\b""",
     "", "high",
     "CORS allows wildcard origins with credentials.",
     "Set allow_origins to explicit trusted origins when credentials are enabled.",
     ("CORSMiddleware",)),
    ("ai_pattern_s3_public_read_acl", _JS_PY,
     r"""\b(?:ACL|acl)\s*[:=]\s*["']public-read["']|\.putObjectAcl\s*\([\s\S]{0,160}public-read""", "i", "high",
     "Object storage ACL grants public read access.",
     "Keep uploaded objects private by default and serve public assets through explicit, reviewed policies.",
     ("public-read",)),
    ("ai_pattern_cookie_secure_false", _JS,
     r"""\b(?:res|response)\.cookie\s*\(\s*[^,\n]+,\s*[^,\n]+,\s*\{[\s\S]{0,240}\bsecure\s*:\s*false\b""", "i", "high",
     "Session cookie is explicitly allowed over insecure HTTP.",
     "Set secure: true for cookies used outside a local development environment.",
     (".cookie",)),
    ("ai_pattern_cookie_httponly_false", _JS,
     r"""\b(?:res|response)\.cookie\s*\(\s*[^,\n]+,\s*[^,\n]+,\s*\{[\s\S]{0,240}\bhttpOnly\s*:\s*false\b""", "i",
     "high",
     "Session cookie is readable by client-side scripts.",
     "Set httpOnly: true unless client-side JavaScript must read a non-sensitive cookie.",
     (".cookie",)),
    ("ai_pattern_spring_csrf_disabled", ("java",),
     r"""\.csrf\s*\(\s*\)\s*\.disable\s*\(\s*\)|\.csrf\s*\(\s*(?:csrf\s*->\s*)?csrf\.disable\s*\(\s*\)\s*\)|\.csrf\s*\(\s*AbstractHttpConfigurer::disable\s*\)""",
     "", "high",
     "Spring Security CSRF protection is disabled.",
     "Keep CSRF protection enabled for browser-authenticated flows or add a narrowly reviewed compensating control.",
     (".csrf",)),
    ("ai_pattern_jinja_autoescape_disabled", _PY,
     r"""\bEnvironment\s*\([^\)\n]*\bautoescape\s*=\s*False\b""", "", "high",
     "Jinja template autoescaping is disabled.",
     "Keep autoescape enabled for HTML templates and sanitize only the narrowly trusted values that require raw HTML.",
     ("autoescape",)),
    ("ai_pattern_paramiko_auto_add_host_key", _PY,
     r"""\bset_missing_host_key_policy\s*\(\s*paramiko\.AutoAddPolicy\s*\(\s*\)\s*\)""", "", "high",
     "SSH host key verification accepts unknown hosts automatically.",
     "Verify and pin expected SSH host keys instead of accepting them automatically.",
     ("set_missing_host_key_policy",)),
    ("ai_pattern_object_storage_public_write_acl", _JS_PY,
     r"""\b(?:ACL|acl)\s*[:=]\s*["']public-read-write["']|\.putObjectAcl\s*\([\s\S]{0,160}public-read-write""", "i",
     "critical",
     "Object storage ACL grants public write access.",
     "Remove public-write access immediately and use private ACLs with reviewed bucket policies.",
     ("public-read-write",)),
    ("ai_pattern_child_process_shell_true", _JS,
     r"""\b(?:child_process\.)?(?:spawn|spawnSync|execFile|execFileSync)\s*\([\s\S]{0,240}\bshell\s*:\s*true\b""", "i",
     "high",
     "Child process execution enables a shell interpreter.",
     "Use argument arrays with shell: false and strictly allowlist executable paths and arguments.",
     ("shell",)),
    ("ai_pattern_python_weak_random_token", _PY,
     r"""\b(?:token|secret|api_key|apikey|reset_token|session_id)\b\s*=\s*random\.(?:random|randint|choice|choices)\s*\(""",
     "i", "high",
     "Security token is generated with Python's non-cryptographic random module.",
     "Use secrets.token_urlsafe(), secrets.token_hex(), or secrets.choice() for security-sensitive values.",
     ("random.",)),
    ("ai_pattern_django_session_cookie_secure_false", _PY,
     r"""\bSESSION_COOKIE_SECURE\s*=\s*False\b""", "", "high",
     "Django session cookies are allowed over insecure HTTP.",
     "Set SESSION_COOKIE_SECURE = True outside local development and terminate TLS before the application.",
     ("SESSION_COOKIE_SECURE",)),
    ("ai_pattern_helmet_csp_disabled", _JS,
     r"""\bhelmet\s*\(\s*\{[\s\S]{0,240}\bcontentSecurityPolicy\s*:\s*false\b""", "i", "medium",
     "Helmet disables the Content Security Policy middleware.",
     "Keep Content Security Policy enabled and configure explicit sources for the application.",
     ("contentsecuritypolicy",)),
    ("ai_pattern_sqlalchemy_text_f_string", _PY,
     r"""\b(?:session|db|connection|conn)\.execute\s*\(\s*(?:sqlalchemy\.)?text\s*\(\s*f["'][^"']*(?:SELECT|INSERT|UPDATE|DELETE)\b[^"']*\{[^}]+}[^"']*["']""",
     "i", "high",
     "SQLAlchemy text() receives an interpolated SQL f-string.",
     "Bind values with SQLAlchemy parameters instead of interpolating them into SQL text.",
     (".execute",)),
]

# Symbols a match must contain (any one of them), where this is not an opening parenthesis.
_NEEDS = {
    "ai_pattern_default_password": ("=", ":"),
    "ai_pattern_admin_admin_credentials": ("=", ":"),
    "ai_pattern_hardcoded_jwt_secret": ("_",),
    "ai_pattern_sql_f_string": ("{",),
    "ai_pattern_dangerously_set_inner_html": ("{",),
    "ai_pattern_frontend_secret_name": ("_",),
    "ai_pattern_tls_verification_disabled": ("_", ":"),
    "ai_pattern_plaintext_password_compare": ("=",),
    "ai_pattern_flask_secret_key_placeholder": ("_",),
    "ai_pattern_fastapi_cors_credentials_wildcard": ("_",),
    "ai_pattern_s3_public_read_acl": ("-",),
    "ai_pattern_object_storage_public_write_acl": ("-",),
    "ai_pattern_django_session_cookie_secure_false": ("_",),
}

AI_PATTERN_RULES = [
    Rule(id, pattern, flags, severity, "ai_pattern_error", message, suggestion, "L1", anchors, _NEEDS.get(id, ("(",)),
         languages)
    for id, languages, pattern, flags, severity, message, suggestion, anchors in _ROWS
]
