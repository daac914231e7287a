"""Keyword tables for reading prose answers. Fixed values, in test order."""

from __future__ import annotations

CATEGORY_WORDS = [
    ("SQL injection", "SQL Injection"), ("authentication", "Authentication"), ("authorization", "Authorization"),
    ("performance", "Performance"), ("architecture", "Architecture"), ("pattern", "Pattern"), ("scalability", "Scalability"),
    ("memory", "Memory"), ("design", "Design"),
]
SEVERITY_WORDS = [
    (r"critical|severe|urgent|dangerous", "CRITICAL"), (r"high|important|significant", "HIGH"),
    (r"medium|moderate", "MEDIUM"), (r"low|minor|trivial", "LOW"),
]
LOCATION_FILE = r"(\w+\.(cs|js|ts|py|java|cpp|h|cshtml))\s*(line|:)?\s*(\d+)?"
PROSE_FORMS = [
    (r"Finding:\s*(.+?)(?=(?:\nFinding:|\nRecommendation:|\nIssue:|\nProblem:|$))", "is"),
    (r"Issue:\s*(.+?)(?=(?:\nIssue:|\nFinding:|\nRecommendation:|\nProblem:|$))", "is"),
    (r"Problem:\s*(.+?)(?=(?:\nProblem:|\nIssue:|\nFinding:|\nRecommendation:|$))", "is"),
    (r"^\d+\.\s*(.+?)(?=(?:\n\d+\.|\nRecommendation:|$))", "ms"),
    (r"^[-*]\s+(.+?)(?=(?:\n[-*]\s+|$))", "ms"),
]
RISK_SENTENCE = r"vulnerability|issue|problem|risk|flaw|defect"

# specialty, category, keyword, description tail
FINDING_WORDS = {
    "security": [("SQL Injection", "injection"), ("Authentication Flaw", "authentication"), ("Authorization Issue", "authorization"),
                 ("Data Exposure", "exposure"), ("Input Validation", "validation")],
    "performance": [("Database Performance", "database"), ("Memory Usage", "memory"), ("Algorithm Efficiency", "algorithm"),
                    ("I/O Operations", "i/o"), ("Concurrency Issues", "concurrent")],
    "architecture": [("SOLID Principles", "SOLID"), ("Design Patterns", "pattern"), ("Separation of Concerns", "separation"),
                     ("Dependency Management", "dependency"), ("Code Organization", "organization")],
}
FINDING_TEXT = {"security": " vulnerability identified in code analysis", "performance": " optimization opportunity identified",
                "architecture": " analysis completed - improvements identified"}
SENTENCE_SEVERITY = [(["critical", "severe", "dangerous"], "CRITICAL"), (["high", "important"], "HIGH"), (["medium", "moderate"], "MEDIUM")]

CONFIDENCE_BASE = ["recommendation", "analysis", "finding"]
CONFIDENCE_WORDS = {
    "security": ["vulnerability", "security", "risk"],
    "performance": ["bottleneck", "optimization", "scalability", "memory", "database"],
    "architecture": ["pattern", "architecture", "design", "SOLID", "separation", "coupling"],
}
CONFIDENCE_LENGTH = {"security": 500, "performance": 600, "architecture": 800}
CONFIDENCE_STEP = {"security": 20, "performance": 16, "architecture": 14}
EFFORT_WORDS = {
    "security": ["refactor", "architecture", "framework", "migration", "comprehensive"],
    "performance": ["refactor", "architecture", "database", "caching", "async"],
    "architecture": ["refactor", "restructure", "pattern", "architecture", "design", "framework"],
}
EFFORT_HOURS = {
    "security": {0: 8, 1: 16, 2: 40, 3: 80},
    "performance": {0: 4, 1: 12, 2: 24, 3: 40, 4: 80},
    "architecture": {1: 16, 2: 40, 3: 80, 4: 160, 5: 320},
}
PRIORITY_WORDS = [(["critical", "severe", "urgent"], "CRITICAL"), (["high", "important", "significant"], "HIGH"), (["medium", "moderate"], "MEDIUM")]
RISK_WORDS = {
    "security": ["injection", "authentication", "encryption"],
    "performance": ["bottleneck", "scalability", "memory"],
    "architecture": ["debt", "coupling", "pattern"],
}
RISK_LEVELS = ["LOW", "MEDIUM", "HIGH", "CRITICAL"]
METRIC_WORDS = {
    "security": [("VulnerabilityCount", ["vulnerability", "flaw", "weakness", "risk", "exposure"]),
                 ("ComplianceGaps", ["compliance", "regulation", "standard", "requirement", "policy"]),
                 ("CriticalFindings", ["critical", "severe", "dangerous", "urgent", "immediate"])],
    "performance": [("BottleneckCount", ["bottleneck", "slow", "inefficient"]),
                    ("OptimizationOpportunities", ["optimization", "improve", "enhance"]),
                    ("ScalabilityIssues", ["scalability", "concurrent", "load"])],
    "architecture": [("DesignPatternViolations", ["violation", "poor", "bad", "anti-pattern", "smell"]),
                     ("ArchitecturalDebt", ["debt", "refactor", "restructure", "legacy", "outdated"]),
                     ("ModernizationComplexity", ["complex", "difficult", "challenging", "significant", "major"])],
}
IMPACT_WORDS = {
    "security": ["business", "cost", "risk", "compliance", "revenue", "reputation"],
    "performance": ["response time", "throughput", "scalability", "user experience", "cost", "efficiency"],
    "architecture": ["maintainability", "scalability", "flexibility", "technical debt", "development velocity", "time to market"],
}
IMPACT_DEFAULT = {
    "security": "Security improvements will reduce compliance risks and protect business reputation",
    "performance": "Performance optimization will improve user experience and system efficiency",
    "architecture": "Architectural improvements will enhance system maintainability and development velocity",
}
# specialty, any of these words, title, hours, priority
ADVICE = [
    ("security", ["parameterized", "injection"], "Implement Parameterized Queries", 16, "CRITICAL"),
    ("security", ["authentication"], "Strengthen Authentication Mechanisms", 40, "HIGH"),
    ("performance", ["database"], "Optimize Database Queries", 24, "HIGH"),
    ("performance", ["async"], "Implement Asynchronous Operations", 16, "HIGH"),
    ("architecture", ["SOLID"], "Implement SOLID Design Principles", 60, "HIGH"),
    ("architecture", ["pattern"], "Introduce Appropriate Design Patterns", 40, "MEDIUM"),
]

EXPECTED_SEVERITIES = [
    ("Security", ["CRITICAL", "HIGH", "MEDIUM"]), ("SQL Injection", ["CRITICAL", "HIGH"]), ("Authentication", ["CRITICAL", "HIGH", "MEDIUM"]),
    ("Authorization", ["CRITICAL", "HIGH", "MEDIUM"]), ("Performance", ["HIGH", "MEDIUM", "LOW"]), ("Architecture", ["HIGH", "MEDIUM", "LOW"]),
    ("Design", ["MEDIUM", "LOW"]), ("Code Quality", ["MEDIUM", "LOW"]), ("Pattern", ["MEDIUM", "LOW"]),
]
INFLATION_EXEMPT = ["Security", "SQL", "Authentication", "Authorization"]

# error type, message words (any), retryable, delay seconds, remedy group; first match wins
ERROR_RULES = [
    ("TimeoutException", None, True, 5, "timeout"),
    ("HttpRequestException", None, True, 10, "connection"),
    ("TaskCanceledException", ["rate limit", "429"], True, 5, "rate limit"),
    ("TaskCanceledException", ["timeout"], True, 5, "timeout"),
    ("TaskCanceledException", None, True, 5, "general"),
    ("InvalidOperationException", ["rate limit"], True, 60, "configuration"),
    ("InvalidOperationException", ["429"], True, 5, "configuration"),
    ("InvalidOperationException", None, False, 5, "configuration"),
    ("ArgumentException", None, False, 5, "input"),
    ("UnauthorizedAccessException", None, False, 5, "credentials"),
    (None, ["rate limit", "429"], False, 5, "rate limit"),
    (None, ["timeout"], False, 5, "timeout"),
    (None, None, False, 5, "general"),
]
