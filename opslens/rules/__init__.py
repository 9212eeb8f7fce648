"""The rule pack for failures outside the programs themselves, and its loader."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

#: Order of severities and the extra score of categories (fixed values).
SEVERITY_RANK = {"I": 1, "W": 2, "E": 3, "F": 4}
CATEGORY_BONUS = {"CONFIG": 5, "DATABASE": 4, "EXTERNAL_API": 3, "NETWORK": 3, "AUTH": 2, "RESOURCE": 2}
OTHER_BONUS = 1


@dataclass(frozen=True)
class Rule:
    """A rule fires on a line by its first pattern that matches; named groups become captures."""

    id: str
    severity: str
    category: str
    patterns: tuple[str, ...]
    hints: tuple[str, ...] = ()
    template: str | None = None
    confidence: float | None = None
    captures: tuple[tuple[str, ...], ...] = field(default=())

    def groups(self) -> tuple[tuple[str, tuple[str, ...]], ...]:
        """Each pattern with plain groups instead of named ones, and the names in order."""
        out = []
        for p in self.patterns:
            names = tuple(re.findall(r"\(\?P<(\w+)>", p))
            out.append((re.sub(r"\(\?P<\w+>", "(", p), names))
        return tuple(out)

    @property
    def rank(self) -> int:
        return SEVERITY_RANK.get(self.severity, 1)


# Ids, severities, categories and patterns of the pack. Hints and templates are worded here.
RULES: tuple[Rule, ...] = (
    Rule("INFOTRAC_MISSING_MESSAGE_ID", "F", "CONFIG", (r"No data found from message_id:\s*(?P<message_id>\d+)\s*in infotrac db", r"message_id\s*(?P<message_id>\d+)\s*not found in infotrac"),
         ("The message id has no mapping for the requested service.", "Compare the mapping table with the id in the log."), "Message id {message_id} has no mapping for service={service}", 0.95),
    Rule("API_SUCCESS_FALSE_JSON", "E", "EXTERNAL_API", (r"\"success\"\s*:\s*false", r"'success'\s*:\s*False"), ("The called service answered without success.", "Read its whole answer in the log."), "A called service answered success=false", 0.85),
    Rule("API_ERROR_MESSAGE_JSON", "E", "EXTERNAL_API", (r"\"message\"\s*:\s*\"(?P<api_message>[^\"]{5,300})\"", r"\"error\"\s*:\s*\"(?P<api_message>[^\"]{5,300})\"", r"\"errorMessage\"\s*:\s*\"(?P<api_message>[^\"]{5,300})\""),
         ("The called service names its error.",), "A called service reported: {api_message}", 0.85),
    Rule("HTTP_ERROR_STATUS", "E", "EXTERNAL_API", (r"HTTP[/\s]\d\.\d\s+(?P<status_code>4\d{2}|5\d{2})", r"status[_\s]*code[\"':\s]*(?P<status_code>4\d{2}|5\d{2})", r"response\s+code[:\s]*(?P<status_code>4\d{2}|5\d{2})"),
         ("An HTTP status of an error came back.", "Check the address and the access rights."), "HTTP status {status_code} came back", 0.85),
    Rule("CONNECTION_REFUSED", "F", "NETWORK", (r"Connection refused", r"connect\s+ECONNREFUSED", r"Failed to connect to (?P<host>[\w\.-]+)"), ("The other side refused the connection.", "See whether it runs and may be reached."), "Connection refused by {host}", 0.90),
    Rule("CONNECTION_TIMEOUT", "E", "NETWORK", (r"connection timed? ?out", r"connect\s+ETIMEDOUT", r"read timed? ?out"), ("The network answer came too late.",), "A connection or read timed out", 0.85),
    Rule("DB_CONNECTION_ERROR", "F", "DATABASE", (r"database connection (?:failed|error|refused)", r"unable to connect to (?:database|db)", r"SQLSTATE\[(?P<sqlstate>[A-Z0-9]+)\]"), ("The database could not be reached.",), "The database connection failed", 0.90),
    Rule("AUTH_FAILURE", "E", "AUTH", (r"authentication failed", r"invalid credentials", r"unauthorized", r"401\s+Unauthorized", r"access denied"), ("A login or right was refused.",), "A login or right was refused", 0.85),
    Rule("RESOURCE_NOT_FOUND_API", "E", "EXTERNAL_API", (r"404\s+Not Found", r"resource not found", r"endpoint not found"), ("The requested resource does not exist.", "Check address and version."), None, None),
    Rule("SERVICE_UNAVAILABLE", "F", "EXTERNAL_API", (r"503\s+Service Unavailable", r"service\s+(?:is\s+)?unavailable", r"backend\s+(?:is\s+)?(?:down|unavailable)"), ("The service is down for now.",), "A service is down for now", 0.85),
    Rule("SSL_CERTIFICATE_ERROR", "E", "NETWORK", (r"SSL certificate (?:error|problem|verify failed)", r"certificate has expired", r"unable to verify.*certificate"), ("The certificate was not accepted.", "Check its date and chain."), None, None),
)


def load_rules(path: str) -> tuple[Rule, ...]:
    """Rules of a YAML file (a list ``rules``); patterns that do not compile and rules left without one are skipped."""
    import yaml  # optional dependency

    with open(path, encoding="utf-8") as f:
        data = yaml.safe_load(f) or {}
    out = []
    for r in data.get("rules", []):
        good = []
        for p in r.get("patterns", []):
            try:
                re.compile(p)
                good.append(p)
            except (re.error, TypeError):
                pass
        if good:
            out.append(Rule(r.get("id", "UNKNOWN"), r.get("severity", "I"), r.get("category", "UNKNOWN"), tuple(good), tuple(r.get("hints", ())), r.get("hypothesis_template"), r.get("confidence")))
    return tuple(out)
