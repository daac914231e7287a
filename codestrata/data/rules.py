"""Rule tables. Rules are data: users extend the library by adding rows.

A rule fires on a file when any pattern of ``must`` is found (more than
``min_count`` times), every pattern of ``also`` is found and none of
``must_not`` is. Patterns are fixed values; ``duckdb`` restates the ones
that need look-ahead, for the test oracle only.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Rule:
    rule_id: str
    languages: tuple[str, ...]
    family: str
    severity: str
    must: tuple[str, ...]
    also: tuple[str, ...] = ()
    must_not: tuple[str, ...] = ()
    min_count: int = 0
    flags: str = "i"
    duckdb: str | None = field(default=None, compare=False)


CS = ("csharp",)
PY = ("python",)
SHARED = ("javascript", "typescript", "java", "go")

# --- fixed values: security rules -----------------------------------------
SECURITY = [
    Rule("cs-sql-concat", CS, "security", "Critical", (r"SELECT\s+.*\+\s*",)),
    Rule("cs-secret", CS, "security", "High", (r'(Password|PWD|Secret|Token)\s*=\s*"[^\""]*"',)),
    Rule("cs-swallow", CS, "security", "High", (r"catch\s*\{\s*\}",)),
    Rule("cs-redirect-input", CS, "security", "High",
         (r"Response\.Redirect\s*\(\s*.*user(Input|Name|Param|Request)",)),
    Rule("cs-xss", CS, "security", "Critical", (r"\.innerHTML\s*=\s*.*user(Input|Name|Param|Request)",)),
    Rule("cs-path", CS, "security", "High",
         (r"File\.(Open|ReadAllText|WriteAllText)\s*\(\s*.*\+\s*user(Input|Name|Param|Request)",)),
    Rule("cs-weak-crypto", CS, "security", "Critical",
         (r"(MD5CryptoServiceProvider|SHA1CryptoServiceProvider|DESCryptoServiceProvider|new\s+MD5|new\s+SHA1|new\s+DES)",)),
    Rule("cs-deserialise", CS, "security", "Critical", (r"new\s+BinaryFormatter\s*\(",)),
    Rule("cs-csrf", CS, "security", "High", (r"\[HttpPost\][^\[]*public\s+.*ActionResult",),
         must_not=(r"ValidateAntiForgeryToken",)),
    Rule("cs-open-redirect", CS, "security", "High", (r"Redirect\s*\(\s*user(Input|Name|Param|Request)",),
         also=(r"IsAuthenticated",)),
    Rule("cs-log-secret", CS, "security", "High",
         (r"Log(Information|Debug|Error|Warning)\s*\(\s*.*(Password|Token|Secret)",)),
    Rule("cs-raw-input", CS, "security", "Medium", (r'Request\[\s*"[a-zA-Z0-9_]+"\s*\]',),
         must_not=(r"(int\.TryParse|Validate|Sanitize|IsValid)",)),
    Rule("py-sql-format", PY, "security", "Critical",
         (r"""(SELECT|INSERT|UPDATE|DELETE)\s+.*f["'].*\{.*\}.*["']|%s|%d.*SELECT""",)),
    Rule("py-secret", PY, "security", "High",
         (r"""(password|pwd|secret|token|api_key|apikey)\s*=\s*["'][^"']+["']""",)),
    Rule("py-plain-password", PY, "security", "Critical",
         (r"password\s*[:=]\s*[^,}\n]+(?!.*hash|.*bcrypt|.*pbkdf2|.*scrypt|.*argon2)",),
         duckdb="hash|bcrypt|pbkdf2|scrypt|argon2"),
    Rule("py-weak-length", PY, "security", "Medium", (r"len\(password\)\s*[<>=]\s*[0-4]",)),
    Rule("py-eval", PY, "security", "Critical", (r"\beval\s*\(|\bexec\s*\(",)),
    Rule("py-pickle", PY, "security", "High", (r"pickle\.(load|loads)\s*\(",)),
    Rule("py-shell", PY, "security", "Critical",
         (r"os\.system\s*\(|subprocess\.(call|Popen)\s*\([^)]*shell\s*=\s*True",)),
    Rule("py-weak-random", PY, "security", "Medium",
         (r"random\.(randint|choice|random)\s*\(|random\.seed\s*\(",), must_not=(r"secrets\.",)),
    Rule("py-raw-input", PY, "security", "Medium", (r"def\s+\w+\s*\([^)]*\)\s*:.*\n[^\n]*\w+\s*=\s*\w+\[",),
         must_not=(r"(isinstance|validate|check|verify)",)),
    Rule("py-auth-literal", PY, "security", "Critical", (r"""if\s+.*==\s*["'](admin|password|1234|admin123)""",)),
    Rule("x-sql-concat", SHARED, "security", "Critical",
         (r"(SELECT|INSERT|UPDATE|DELETE)\s+.*[\+\`].*\{|SELECT.*\$\{",)),
    Rule("x-secret", SHARED, "security", "High",
         (r"""(password|pwd|secret|token|api[_-]?key|apikey)\s*[:=]\s*["'][^"']+["']""",)),
    Rule("x-plain-password", SHARED, "security", "Critical",
         (r"password\s*[:=]\s*[^,}\n]+(?!.*hash|.*bcrypt|.*pbkdf2|.*scrypt|.*argon2|.*encrypt)",),
         duckdb="hash|bcrypt|pbkdf2|scrypt|argon2|encrypt"),
    Rule("x-eval", SHARED, "security", "Critical", (r"""\beval\s*\(|\bFunction\s*\(["']""",)),
    Rule("x-xss", SHARED, "security", "Critical", (r"\.innerHTML\s*=\s*.*\+|\.innerHTML\s*=\s*.*\$\{",)),
    Rule("x-weak-length", SHARED, "security", "Medium", (r"(password|pwd)\.(length|len)\s*[<>=]\s*[0-4]",)),
    Rule("x-auth-literal", SHARED, "security", "Critical",
         (r"""if\s*\([^)]*==\s*["'](admin|password|1234|admin123)""",)),
    Rule("x-raw-input", SHARED, "security", "Medium",
         (r"function\s+\w+\s*\([^)]*\)|public\s+\w+\s+[a-zA-Z]+\s*\([^)]*\)",),
         must_not=(r"(validate|check|verify|isValid|sanitize)",)),
]

# --- fixed values: performance rules --------------------------------------
PERFORMANCE = [
    Rule("cs-delay", CS, "performance", "High", (r"Task\.Delay\(|Thread\.Sleep\(",)),
    Rule("cs-sync-wait", CS, "performance", "High", (r"\.Result|\.Wait\(\)",)),
    Rule("cs-n-plus-one", CS, "performance", "Critical",
         (r"foreach\s*\(.*\)\s*\{[^\}]*\.(ExecuteReader|ToList|Find|Get|Query|Select|Load|Fetch)\s*\(",)),
    Rule("cs-loop-alloc", CS, "performance", "High",
         (r"for(each)?\s*\(.*\)\s*\{[^\}]*new\s+[A-Z][A-Za-z0-9_]*\s*\(",)),
    Rule("cs-loop-concat", CS, "performance", "High", (r"for(each)?\s*\(.*\)\s*\{[^\}]*\+\s*=\s*.*string",)),
    Rule("cs-multi-enumerate", CS, "performance", "Medium",
         (r"\.Where\(.*\)\.Select\(.*\)[^;]*\.Where\(.*\)",
          r"foreach\s*\(var\s+item\s+in\s+[a-zA-Z0-9_]+\.Where\(.*\)\)")),
    Rule("cs-boxing", CS, "performance", "Medium",
         (r"object\s*=\s*\(int|double|float|bool|string\)\s*[a-zA-Z0-9_]+",)),
    Rule("cs-viewstate", CS, "performance", "High", (r"ViewState\[.*\]\s*=\s*new\s+[A-Z][A-Za-z0-9_]*\s*\(",)),
    Rule("cs-sync-io", CS, "performance", "High", (r"File\.(ReadAllText|WriteAllText|Open)\s*\(",),
         must_not=(r"await\s+File\.(ReadAllTextAsync|WriteAllTextAsync|OpenAsync)",)),
    Rule("cs-many-catch", CS, "performance", "Medium", (r"catch\s*\{",), min_count=3),
    Rule("cs-reflection", CS, "performance", "High",
         (r"Type\.Get(Type|Method|Property|Field)\s*\(", r"Assembly\.Load|Activator\.CreateInstance")),
    Rule("cs-no-pool", CS, "performance", "Critical", (r"new\s+SqlConnection\s*\(",),
         also=(r"ConnectionPooling\s*=\s*false",)),
    Rule("py-no-paging", PY, "performance", "High",
         (r"\.(all|fetchall|find_all)\s*\(\)|for\s+\w+\s+in\s+range\s*\(\s*[0-9]{4,}",)),
    Rule("py-nested-loops", PY, "performance", "Critical",
         (r"for\s+\w+\s+in\s+.*:\s*\n[^\n]*for\s+\w+\s+in\s+.*:\s*\n[^\n]*for\s+\w+\s+in\s+range",)),
    Rule("py-loop-concat", PY, "performance", "High", (r"for\s+.*:\s*\n[^\n]*\w+\s*\+=\s*",)),
    Rule("py-n-plus-one", PY, "performance", "Critical",
         (r"for\s+.*:\s*\n[^\n]*\.(query|execute|fetchone|get)\s*\(",)),
    Rule("py-sync-io", PY, "performance", "High",
         (r"for\s+.*:\s*\n[^\n]*(requests\.(get|post)|urllib|open\s*\()",), must_not=(r"async|await|asyncio",)),
    Rule("py-large-list", PY, "performance", "Medium", (r"\[.*for\s+.*in\s+range\s*\(\s*[0-9]{4,}",),
         must_not=(r"\(.*for\s+.*in\s+.*\)",)),
    Rule("py-no-cache", PY, "performance", "Medium",
         (r"def\s+\w+\s*\([^)]*\)\s*:.*\n[^\n]*(\.(query|execute|fetch)|requests\.|urllib)",),
         must_not=(r"@(lru_cache|cache|memoize)",)),
    Rule("x-nested-loops", SHARED, "performance", "Critical",
         (r"for\s*\([^)]*\)\s*\{[^}]*for\s*\([^)]*\)\s*\{[^}]*for\s*\(",
          r"for\s+\w+\s+in\s+.*:\s*\n[^\n]*for\s+\w+\s+in\s+.*:\s*\n[^\n]*for")),
    Rule("x-loop-concat", SHARED, "performance", "High",
         (r"for\s*\([^)]*\)\s*\{[^}]*\w+\s*\+=\s*|for\s+.*:\s*\n[^\n]*\w+\s*\+=\s*",)),
    Rule("x-no-paging", SHARED, "performance", "High",
         (r"\.(all|findAll|fetchAll|getAll)\s*\(\)|SELECT\s+\*\s+FROM\s+\w+\s*;",)),
    Rule("x-n-plus-one", SHARED, "performance", "Critical",
         (r"for\s*\([^)]*\)\s*\{[^}]*\.(query|execute|find|get)\s*\(|for\s+.*:\s*\n[^\n]*\.(query|execute)",)),
    Rule("x-callbacks", SHARED, "performance", "Medium",
         (r"\.then\s*\([^)]*=>\s*\{[^}]*\.then\s*\([^)]*=>\s*\{[^}]*\.then",)),
    Rule("x-no-cache", SHARED, "performance", "Medium",
         (r"function\s+\w+\s*\([^)]*\)|public\s+\w+\s+[a-zA-Z]+\s*\([^)]*\)",),
         also=(r"\.(query|fetch|get|request)",), must_not=(r"(cache|Cache|CACHE)",)),
]

# --- fixed values: architecture rules -------------------------------------
ARCHITECTURE = [
    Rule("cs-sql-coupling", CS, "architecture", "High", (r"new\s+SqlConnection\s*\(",)),
    Rule("py-globals", PY, "architecture", "Medium", (r"^[a-zA-Z_][a-zA-Z0-9_]*\s*=\s*[^=]",), flags="m"),
    Rule("py-service-coupling", PY, "architecture", "Medium",
         (r"class\s+\w+.*:\s*\n[^\n]*\w+Service\s*\([^)]*\)",)),
    Rule("py-no-errors", PY, "architecture", "High",
         (r"def\s+\w+\s*\([^)]*\)\s*:.*\n[^\n]*(\.(query|execute|open|read)|requests\.)",),
         must_not=(r"try:|except|raise",)),
    Rule("py-no-hints", PY, "architecture", "Low", (r"def\s+\w+\s*\([^)]*\)\s*:",),
         must_not=(r"def\s+\w+\s*\([^)]*:\s*(int|str|float|bool|List|Dict|Optional)",)),
    Rule("x-globals", SHARED, "architecture", "Medium",
         (r"^(var|let|const)\s+\w+\s*=\s*[^=]|^[a-zA-Z_][a-zA-Z0-9_]*\s*:=\s*",), flags="m"),
    Rule("x-no-errors", SHARED, "architecture", "High", (r"(function|public|private|func)\s+\w+\s*\([^)]*\)",),
         also=(r"\.(query|execute|fetch|open|read)",), must_not=(r"(try|catch|except|defer|finally)",)),
    Rule("x-service-coupling", SHARED, "architecture", "Medium",
         (r"new\s+\w+Service\s*\(|new\s+\w+Manager\s*\(",)),
]

ALL_RULES = SECURITY + PERFORMANCE + ARCHITECTURE

# --- fixed values: match patterns of the legacy scan ----------------------
OBSOLETE_API = [
    r"System\.Web\.UI\.", r"System\.Data\.OleDb\.", r"System\.Data\.OracleClient\.",
    r"System\.EnterpriseServices\.", r"System\.Runtime\.Remoting\.", r"System\.Web\.Services\.",
    r"System\.Web\.HttpContext\.Current", r"DataSet\s+", r"DataTable\s+", r"SqlDataAdapter\s+",
    r"WebRequest\s+", r"WebClient\s+", r"HttpWebRequest\s+", r"HttpWebResponse\s+", r"ServiceController\s+",
    r"Process\.Start\s*\(", r"Thread\.Abort\s*\(", r"Thread\.Suspend\s*\(", r"Thread\.Resume\s*\(",
    r"AppDomain\.Unload\s*\(", r"Assembly\.LoadFrom\s*\(", r"CodeAccessPermission\.", r"PrincipalPermission\.",
    r"SecurityPermission\.", r"Registry\.(GetValue|SetValue|CreateKey|DeleteKey)", r"FileIOPermission\.",
    r"IsolatedStorageFile\.", r"SoapFormatter\s+", r"BinaryFormatter\s+", r"RemotingConfiguration\.",
    r"RemotingServices\.", r"ContextBoundObject\s+", r"MarshalByRefObject\s+", r"\[Obsolete\(",
    r"\[System\.Obsolete",
]
GLOBAL_STATE = [
    r"public\s+static\s+(class|readonly|const)\s+", r"public\s+static\s+\w+\s+\w+\s*\{",
    r"HttpContext\.Current\.", r"Application\[", r"Session\[", r"Cache\[",
    r"static\s+readonly\s+\w+\s+\w+\s*=", r"public\s+static\s+\w+\s+\w+\s*=", r"Global\.",
    r"AppDomain\.CurrentDomain\.", r"ThreadStatic\s+", r"\[ThreadStatic\]",
]
MAGIC_NUMBER = r"\b(24|60|100|1024|3600|86400|7|30|31|365)\b(?!\s*[=:]\s*['\"]|\s*[=:]\s*\w+|\s*[=:]\s*\[)"
MAGIC_VALUES = "24|60|100|1024|3600|86400|7|30|31|365"
EMPTY_CATCH = r"catch\s*(?:\([^)]*\))?\s*\{\s*\}"
ANCIENT_FRAMEWORK = [
    r"using\s+System\.Web\.UI", r"using\s+System\.EnterpriseServices", r"using\s+System\.Runtime\.Remoting",
    r"using\s+System\.Web\.Services", r"using\s+Microsoft\.VisualBasic", r"using\s+System\.Data\.OleDb",
    r"using\s+System\.Data\.OracleClient", r"\.NET\s+Framework\s+[12]\.", r"\.NET\s+Framework\s+3\.[0-4]",
    r"\.NET\s+Framework\s+4\.[0-5]",
]

# --- fixed values: per-line language patterns -----------------------------
# (language, pattern type, must, must_not literals, any-of literals, count patterns, min count, deprecated)
LINE_PATTERNS = [
    ("python", "Python2Print", r"\bprint\s+[^(]", True),
    ("python", "OldStyleClass", r"^\s*class\s+\w+\s*[^(:]", True),
    ("python", "OldStringFormatting", r'"[^"]*%[^"]*"\s*%', False),
    ("javascript", "VarUsage", r"\bvar\s+\w+", False),
    ("java", "RawType", r"\b(ArrayList|HashMap|Vector|Hashtable)\s+\w+\s*=", False),
]
CALLBACK_MARKS = (r"\bfunction\s*\(", r"=>")
CALLBACK_MIN = 3
GO_CALL_END = r"\w+\([^)]*\)\s*$"
GO_HANDLED = ("if err", "err :=")
GO_ERROR_WORDS = ("err", "error")

# --- fixed values: decision keywords --------------------------------------
DECISIONS = r"\b(if|for|foreach|while|case|catch|&&|\|\|)\b"
DECISIONS_CSHARP = r"\b(if|for|foreach|while|case|catch|\?\:|&&|\|\|)\b"
