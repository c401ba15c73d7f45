"""Secret patterns, of our own design: id | severity | least entropy of the value | pattern with the value in group 1."""

from __future__ import annotations

SECRETS = (
    ("SEC_AWS_KEY_ID", "CRITICAL", 0.0, r"\b((?:AKIA|ASIA)[0-9A-Z]{16})\b"),
    ("SEC_AWS_SECRET", "CRITICAL", 3.5, r"aws_?secret\w*[\"']?[ \t]*[:=][ \t]*[\"']([A-Za-z0-9/+=]{40})[\"']"),
    ("SEC_GITHUB_TOKEN", "CRITICAL", 0.0, r"\b(gh[pousr]_[A-Za-z0-9]{36,})"),
    ("SEC_GITLAB_TOKEN", "CRITICAL", 0.0, r"\b(glpat-[A-Za-z0-9_-]{20,})"),
    ("SEC_SLACK_TOKEN", "HIGH", 0.0, r"\b(xox[abprs]-[A-Za-z0-9-]{10,})"),
    ("SEC_STRIPE_KEY", "CRITICAL", 0.0, r"\b([rs]k_live_[A-Za-z0-9]{16,})"),
    ("SEC_GOOGLE_KEY", "HIGH", 0.0, r"\b(AIza[A-Za-z0-9_-]{35})"),
    ("SEC_NPM_TOKEN", "HIGH", 0.0, r"\b(npm_[A-Za-z0-9]{36})"),
    ("SEC_SENDGRID_KEY", "HIGH", 0.0, r"\b(SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,})"),
    ("SEC_TWILIO_KEY", "HIGH", 0.0, r"\b(SK[0-9a-f]{32})\b"),
    ("SEC_PRIVATE_KEY", "CRITICAL", 0.0, r"(-----BEGIN (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----)"),
    ("SEC_JWT", "MEDIUM", 0.0, r"\b(eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})"),
    ("SEC_BASIC_AUTH_URL", "HIGH", 0.0, r"\b\w+://[^\s:/@]+:([^\s:/@]{3,})@"),
    ("SEC_CONNECTION_STRING", "HIGH", 0.0, r"\b(?:AccountKey|SharedAccessKey)=([A-Za-z0-9+/=]{20,})"),
    ("SEC_ASSIGNED_CREDENTIAL", "HIGH", 2.5, r"\b(?:password|passwd|secret|token|api_?key|access_?key)[\"']?[ \t]*[:=][ \t]*[\"']([^\"'\s]{8,})[\"']"),
    ("SEC_HIGH_ENTROPY_HEX", "MEDIUM", 3.2, r"[\"']([0-9a-f]{32,})[\"']"),
    ("SEC_HIGH_ENTROPY_BASE64", "MEDIUM", 4.3, r"[\"']([A-Za-z0-9+/]{40,}={0,2})[\"']"),
)
CWE, CONFIDENCE = "CWE-798", 0.9
