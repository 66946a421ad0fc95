"""Security rules, positive findings and authentication rules."""

from __future__ import annotations

from corpus_audit.functions.paths import is_auth, is_code, is_middleware
from corpus_audit.functions.patterns import Has
from corpus_audit.operators.rules import Family, Rule, text

# --- fixed values: security patterns, severities and messages --------------------------------------
SECURITY_FEATURES = {
    "sql_template": Has(r"""query\s*\(\s*["`'][^"`']*\$\{[^}]+\}[^"`']*["`']\s*\)"""),
    "sql_joined_template": Has(r"""\$\{[^}]+\}\s*\+\s*["`'].*["`']"""),
    "sql_concatenation": Has(
        r"""["`'][^"`']*\+\s*.*\+\s*["`']""",
        linear=r"""\A[^"`']*+["`'][\s\S]*?\+\s*+[^+\n\r\x{2028}\x{2029}]*+\+\s*+["`']""",
        needs=("+",),
    ),
    "system_call": Has(r"exec\(|spawn\(|system\("),
    "interpolation": Has(r"\$\{|\+"),
    "file_api": Has(r"readFile|writeFile|createReadStream"),
    "parent_path": Has(r"\.\.|/\.\.|\\\.\."),
    "password_literal": Has(r"""(?i)password\s*[:=]\s*["`'][^"`']{8,}["`']"""),
    "api_key_literal": Has(r"""(?i)api[_-]?key\s*[:=]\s*["`'][^"`']{10,}["`']"""),
    "secret_literal": Has(r"""(?i)secret\s*[:=]\s*["`'][^"`']{16,}["`']"""),
    "token_literal": Has(r"""(?i)token\s*[:=]\s*["`'][^"`']{20,}["`']"""),
    "env_use": Has(r"process\.env\.[A-Z_]+"),
    "env_guard": Has(
        r"if\s*\(.*process\.env|throw.*Error.*process\.env",
        linear=r"(?<!.)(?>.*?if[^\S\n\r\x{2028}\x{2029}]*+\().*?process\.env"
        r"|if(?=[^\S\n\r\x{2028}\x{2029}]*+[\n\r\x{2028}\x{2029}])\s*\(.*?process\.env"
        r"|(?<!.)(?>.*?throw)(?>.*?Error).*?process\.env",
    ),
    "math_random": Has(r"Math\.random\(\)"),
    "secret_word": Has(r"password|token|key|session"),
    "request_data": Has(r"req\.(body|params|query)"),
    "validation_word": Has(r"validate|sanitize|escape"),
    "eval_call": Has(r"\beval\s*\("),
    "cookie_set": Has(r"res\.cookie\("),
    "cookie_flags": Has(r"secure.*httpOnly|httpOnly.*secure"),
    "console_log": Has(r"console\.log"),
    "error_handling": Has(r"try\s*\{[\s\S]*catch[\s\S]*finally|\.catch\("),
}

SECURITY_RULES = (
    Rule(
        "sql-injection",
        "SQL Injection",
        "sql_template OR sql_joined_template OR sql_concatenation",
        text("Potential SQL injection vulnerability in query construction"),
        severity="'Critical'",
        remediation=text("Use parameterized queries or prepared statements"),
    ),
    Rule(
        "command-injection",
        "Command Injection",
        "system_call AND interpolation",
        text("Potential command injection in system calls"),
        severity="'Critical'",
        remediation=text("Sanitize input and use safe execution methods"),
    ),
    Rule(
        "path-traversal",
        "Path Traversal",
        "file_api AND parent_path",
        text("Potential path traversal vulnerability"),
        severity="'High'",
        remediation=text("Validate and sanitize file paths, use path.resolve()"),
    ),
    Rule(
        "hardcoded-password",
        "Information Disclosure",
        "password_literal",
        text("Hardcoded Password found in source code"),
        severity="'High'",
    ),
    Rule(
        "hardcoded-api-key",
        "Information Disclosure",
        "api_key_literal",
        text("Hardcoded API Key found in source code"),
        severity="'High'",
    ),
    Rule(
        "hardcoded-secret",
        "Information Disclosure",
        "secret_literal",
        text("Hardcoded Secret found in source code"),
        severity="'High'",
    ),
    Rule(
        "hardcoded-token",
        "Information Disclosure",
        "token_literal",
        text("Hardcoded Token found in source code"),
        severity="'High'",
    ),
    Rule(
        "unchecked-environment",
        "Configuration",
        "env_use AND NOT env_wrapper AND NOT env_guard",
        text("Environment variable used without validation - potential security issue"),
        severity="'Medium'",
    ),
    Rule(
        "weak-random",
        "Weak Cryptography",
        "math_random AND secret_word",
        text("Math.random() used for security-sensitive operations"),
        severity="'Medium'",
        remediation=text("Use crypto.randomBytes() for cryptographic operations"),
    ),
    Rule(
        "unvalidated-input",
        "Input Validation",
        "request_data AND NOT validation_word",
        text("User input used without apparent validation"),
        severity="'Medium'",
        remediation=text("Implement input validation and sanitization"),
    ),
    Rule(
        "eval-use",
        "Code Injection",
        "eval_call",
        text("Use of eval() function detected"),
        severity="'Critical'",
        remediation=text("Avoid eval() - use safer alternatives like JSON.parse()"),
    ),
    Rule(
        "insecure-cookie",
        "Session Management",
        "cookie_set AND NOT cookie_flags",
        text("Cookies set without secure flags"),
        severity="'Medium'",
        remediation=text("Set secure and httpOnly flags on cookies"),
    ),
    Rule(
        "secure-environment",
        "Environment Variable Security",
        "env_manager",
        text("✅ Uses a wrapper for secure environment variable handling"),
        remediation=text("Environment variables are validated, sanitized, and masked appropriately"),
        polarity="positive",
    ),
    Rule(
        "validates-input",
        "Input Validation",
        "validation_word AND NOT console_log",
        text("✅ Implements input validation and sanitization"),
        remediation=text("Input data is being validated before use"),
        polarity="positive",
    ),
    Rule(
        "handles-errors",
        "Error Handling",
        "error_handling",
        text("✅ Implements proper error handling"),
        remediation=text("Errors are caught and handled appropriately"),
        polarity="positive",
    ),
)

AUTH_FEATURES = {
    "jwt_sign": Has(r"jwt\.sign"),
    "jwt_verify": Has(r"jwt\.verify"),
    "weak_jwt_secret": Has(r"""jwt\.sign.*["`']secret["`']|jwt\.sign.*["`']123"""),
    "password_word": Has(r"password"),
    "password_hash": Has(r"bcrypt|scrypt|argon2"),
    "session_library": Has(r"express-session"),
    "resave_false": Has(r"resave.*false"),
    "save_uninitialized_false": Has(r"saveUninitialized.*false"),
    "express_word": Has(r"express"),
    "state_change": Has(r"post|put|delete"),
    "csrf_word": Has(r"csrf"),
}

AUTH_RULES = (
    Rule(
        "jwt-not-verified",
        "JWT Verification",
        "jwt_sign AND NOT jwt_verify",
        text("JWT signing found but no verification logic detected"),
        severity="'Medium'",
        remediation=text("Ensure JWT tokens are properly verified on protected routes"),
    ),
    Rule(
        "weak-jwt-secret",
        "JWT Secret",
        "weak_jwt_secret",
        text("Weak JWT secret detected"),
        severity="'High'",
        remediation=text("Use strong, randomly generated secrets from environment variables"),
    ),
    Rule(
        "password-not-hashed",
        "Password Hashing",
        "password_word AND NOT password_hash",
        text("Password handling without apparent hashing"),
        severity="'Critical'",
        remediation=text("Use bcrypt, scrypt, or argon2 for password hashing"),
    ),
    Rule(
        "session-resave",
        "Session Configuration",
        "session_library AND NOT resave_false",
        text("Session resave not set to false"),
        severity="'Low'",
        remediation=text("Set resave: false in session configuration"),
    ),
    Rule(
        "session-uninitialized",
        "Session Configuration",
        "session_library AND NOT save_uninitialized_false",
        text("saveUninitialized not set to false"),
        severity="'Low'",
        remediation=text("Set saveUninitialized: false in session configuration"),
    ),
    Rule(
        "no-csrf",
        "CSRF Protection",
        "express_word AND state_change AND NOT csrf_word",
        text("State-changing operations without CSRF protection"),
        severity="'Medium'",
        remediation=text("Implement CSRF tokens for forms and state-changing operations"),
    ),
)

# Remediation and severity that depend on the kind of repository.
SECRET_ADVICE_CLI = "Use environment variables (.env file) or configuration files outside the repository"
SECRET_ADVICE_SERVICE = (
    "Use a secrets management service (AWS Secrets Manager, Azure Key Vault, or HashiCorp Vault)"
)
SECRET_ADVICE = "Move secrets to environment variables or configuration files"
ENV_TEXT_CLI = "Environment variable used without validation - may cause runtime errors"
ENV_ADVICE_CLI = 'Add validation: if (!process.env.API_KEY) throw new Error("API_KEY required") or use a validating wrapper'
ENV_ADVICE = "Implement proper environment variable validation using a wrapper that validates and sanitizes"
MANAGER_METHODS, HANDLING_METHODS, READER_METHODS = "validateEnv|sanitizeValue|get", "validateEnv|sanitizeValue|maskSensitive", "get"
# --- end of fixed values ---------------------------------------------------------------------------



def security_family(managers: tuple[str, ...] = ("EnvManager",), readers: tuple[str, ...] = ("EnvReader",)) -> Family:
    """The security rules of a code base whose wrappers around environment variables have these names.

    ``managers`` validate, sanitize and mask values, ``readers`` get validated ones."""
    wrappers = [rf"{n}\.({MANAGER_METHODS})" for n in managers] + [rf"{n}\.{READER_METHODS}" for n in readers]
    features = {
        **SECURITY_FEATURES,
        "env_wrapper": Has("|".join(wrappers)),
        "env_manager": Has("|".join(rf"{n}\.({HANDLING_METHODS})" for n in managers)),
    }
    return Family("security", features, SECURITY_RULES, is_code)


SECURITY = security_family()
AUTH = Family("auth", AUTH_FEATURES, AUTH_RULES, lambda p: is_auth(p) | is_middleware(p))
