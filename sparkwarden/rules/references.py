"""Patterns of dependency references per kind of file."""

# Text that is not code. Unrolled and possessive, so that long strings cost no stack.
_DOUBLE = r'"[^"\\]*+(?:\\[\s\S][^"\\]*+)*+(?:"|\z)'
_SINGLE = r"'[^'\\]*+(?:\\[\s\S][^'\\]*+)*+(?:'|\z)"
_TEMPLATE = r"`[^`\\]*+(?:\\[\s\S][^`\\]*+)*+(?:`|\z)"
_JS_COMMENT = r"//[^\r\n]*|/\*[\s\S]*?(?:\*/|\z)"
_PY_NOISE = r"#[^\r\n]*|'''[\s\S]*?(?:'''|\z)|" + r'"""[\s\S]*?(?:"""|\z)'

# Statements that name packages. Groups 1 to 4 carry what is named.
JS_IMPORT = r"""(?:import|export)\s+(?:type\s+)?(?:[^"'`]+?\s+from\s*)?["']([^"']+)["']"""
JS_REQUIRE = r"""\brequire\s*\(\s*["']([^"']+)["']\s*\)"""
JS_DYNAMIC = r"""\bimport\s*\(\s*["']([^"']+)["']\s*\)"""
PY_IMPORT = r"^[ \t]*import[ \t]+([A-Za-z_][A-Za-z0-9_., \t]*)"
PY_FROM = r"^[ \t]*from[ \t]+([A-Za-z_][A-Za-z0-9_.]*)[ \t]+import\b"
_PIP = r"(?:python(?:3(?:\.\d+)?)?\s+-m\s+)?pip(?:3)?\s+install\s+"
PIP_STRING = rf"""\b(?:subprocess\.(?:run|call|check_call)|os\.system)\s*\(\s*["'](?i:{_PIP})([^"'\r\n]+)["']?"""
PIP_ARRAY = r"""\bsubprocess\.(?:run|call|check_call)\s*\(\s*\[\s*["'](?i:pip)(?:3)?["']\s*,\s*["'](?i:install)["']\s*,\s*([^\]\r\n]+)\]"""
PIP_LINE = rf"^\s*(?:!\s*|(?:-\s+)?(?:(?i:run):\s*)?(?:(?i:RUN)\s+)?(?:(?i:sudo)\s+)?)(?i:{_PIP})([^\r\n#]+)"
PIP_VALUE_FLAGS = [
    "-r", "--requirement", "-c", "--constraint", "-f", "--find-links", "--index-url", "--extra-index-url", "--trusted-host",
]
PIP_REQUIREMENT = r"^([A-Za-z0-9_.-]+)(?:\[[^\]]+])?(?:[<>=!~].*)?\z"
RUST_USE = r"^\s*(?:pub\s+)?use\s+([A-Za-z_][A-Za-z0-9_]*)::"
RUST_EXTERN = r"^\s*extern\s+crate\s+([A-Za-z_][A-Za-z0-9_-]*)"
GO_IMPORT = r"""^\s*import\s+(?:[._A-Za-z0-9]+\s+)?["']([^"']+)["']"""
GO_IMPORT_BLOCK = r"^\s*import\s*\(\s*([\s\S]*?)^\s*\)"
GO_BLOCK_ENTRY = r"""(?:[._A-Za-z0-9]+\s+)?["']([^"']+)["']"""
GO_REQUIRE = r"^\s*require\s+([^\s()]+)\s+v[^\s]+"
GO_REQUIRE_BLOCK = r"^\s*require\s*\(\s*([\s\S]*?)^\s*\)"
GO_REQUIRE_ENTRY = r"(?m)^\s*([^\s()]+)\s+v[^\s/]+.*$"
POM_DEPENDENCY = r"<dependency\b[\s\S]*?</dependency>"
JVM_IMPORT = (
    r"^[ \t]*import[ \t]+(?!static\b)([A-Za-z_$][A-Za-z0-9_$.]*(?:\.[A-Za-z_$][A-Za-z0-9_$]*)+)"
    r"(?:[ \t]+as[ \t]+[A-Za-z_$][A-Za-z0-9_$]*)?[ \t]*;?[ \t]*$"
)
GRADLE_DEPENDENCY = (
    r"\b(?:api|annotationProcessor|classpath|compileOnly|implementation|runtimeOnly|testImplementation|testRuntimeOnly)"
    r"""\s*(?:\(\s*)?["']([^:"'\s]+):([^:"'\s]+)(?::[^"']+)?["']"""
)
REQUIREMENT_LINE = r"^([A-Za-z0-9_.-]+)(?:\[[^\]]+])?\s*(?:[<>=!~]=?.*)?\z"
JVM_PLATFORM_PREFIXES = [
    "android.", "androidx.", "java.", "jdk.", "kotlin.", "sun.", "javax.accessibility.",
    "javax.annotation.processing.", "javax.crypto.", "javax.imageio.", "javax.lang.model.", "javax.management.",
    "javax.naming.", "javax.net.", "javax.print.", "javax.rmi.", "javax.script.", "javax.security.",
    "javax.smartcardio.", "javax.sound.", "javax.sql.", "javax.swing.", "javax.tools.", "javax.transaction.xa.",
    "javax.xml.catalog.", "javax.xml.crypto.", "javax.xml.datatype.", "javax.xml.namespace.", "javax.xml.parsers.",
    "javax.xml.stream.", "javax.xml.transform.", "javax.xml.validation.", "javax.xml.xpath.", "org.ietf.jgss.",
    "org.w3c.dom.", "org.xml.sax.",
]
NPM_SECTIONS = ["dependencies", "devDependencies", "peerDependencies", "optionalDependencies"]
LOCAL_NPM_PREFIXES = ["workspace:", "file:", "link:", "portal:"]

# One pattern per kind; comments and strings are alternatives of their own, so nothing inside them is taken for code.
PATTERNS = {
    "javascript": f"{JS_IMPORT}|{JS_REQUIRE}|{JS_DYNAMIC}|{_JS_COMMENT}|{_DOUBLE}|{_SINGLE}|{_TEMPLATE}",
    "python": f"{PY_IMPORT}|{PY_FROM}|{PIP_STRING}|{PIP_ARRAY}|{PIP_LINE}|{_PY_NOISE}|{_DOUBLE}|{_SINGLE}",
    "pip": f"{PIP_STRING}|{PIP_ARRAY}|{PIP_LINE}|#[^\\r\\n]*",
    "rust": f"{RUST_USE}|{RUST_EXTERN}",
    "go": f"{GO_IMPORT}|{GO_IMPORT_BLOCK}",
    "gomod": f"{GO_REQUIRE}|{GO_REQUIRE_BLOCK}",
    "pom": POM_DEPENDENCY,
    "jvm": JVM_IMPORT,
    "gradle": GRADLE_DEPENDENCY,
    "requirements": r"[^\r\n]+",
}
GROUPS = 5
