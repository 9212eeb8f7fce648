"""Credentials in source code and configuration: where they start, and the text without them.

A scan looks for credentials in the clear (assignments, connection strings, logins, known
token shapes, private keys), then decodes every base64, hex, percent-encoded or escaped
literal and scans the decoded text again, level by level, until nothing can be decoded (each
level is shorter than the one before; runs of percent codes of percent signs are one level).
A literal that goes on over several lines is joined first. Decoded bytes are also parsed as
key containers by their binary grammar: DER private keys, encrypted ones, PKCS#12, Java key
stores and OpenSSH keys. What is found inside an encoded literal is redacted by replacing
that enclosing literal, line by line where it has several.

Defined results
  null or empty text   no finding, returned as it is
  variable references, file names, vault calls, placeholders, masked or empty values,
  hashes, ids, public keys, certificates     no finding
  key over several lines                     one finding, at its first line
  very long lines                            scanned whole
  repeated rows                              each row is reported under its own id
"""

from __future__ import annotations

import base64
import binascii
import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MASK = "REDACTED"


class Finding(NamedTuple):
    start: int
    end: int
    kind: str


# A name whose last part says that its value is secret.
_NAME = r"(?:pass(?:word|wd|phrase|wort)?|pwd|pw|secret(?:[_.-]?(?:key|access[_.-]?key))?|api[_.-]?key|apikey|(?:access|auth|api|bearer|refresh|bot|feed)[_.-]?token|token|tok|(?:access|sign|signing|private|auth|account|encryption|master|session|license)[_.-]?key|credentials?)"
_QUOTED = r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'"
_PIECES = rf"(?:{_QUOTED})(?:\s*[.+]?\s*(?:{_QUOTED}))*"
_BARE = r"[^\s\"'`;,<>&|(){}\[\]][^\s\"'`;<>&|(){}]*"
_USER = r"[A-Za-z][\w.-]{1,31}"

# name = value, name: value, name => value, {name} = value, "name": value, f("NAME", value)
_ASSIGN = re.compile(
    rf"(?P<name>{_NAME})(?P<sep>[\"'\]}}]*\s*(?:=>|:=|==?(?!=)|:|,(?=\s*[\"']))\s*)(?P<value>{_PIECES}|{_BARE})",
    re.I,
)
_PHRASES = [
    re.compile(p, re.I)
    for p in (
        rf"\b(?:password|passphrase|passwd|pwd|pw)\s+(?P<value>{_QUOTED}|{_BARE})",  # login x password y
        rf"\(pw:\s*(?P<value>[^\s)]+)\)",
        rf"\b(?:old\s+)?login:\s*{_USER}\s*/\s*(?P<value>\S+)",
        rf"\bwas\s+{_USER}:(?P<value>\S+)",
        rf"\b(?:pickup|access|api|licen[cs]e)\s+key\s+(?P<value>[A-Za-z0-9+/=_-]{{16,}})",
        rf"\bsqlplus\b[^\n]*?\s{_USER}/(?P<value>[^\s@$]+(?:@(?=[^\s@]*@)[^\s@]*)*)@",
        rf"\bjdbc:[\w:]*?:(?:thin|oci):{_USER}/(?P<value>[^\s@]+(?:@(?!//))?[^\s@]*)@",
        rf"(?<=[a-z0-9+.-])://{_USER}:(?P<value>[^\s/@\"'<>]+)@",
        rf"->login\(\s*(?:{_QUOTED})\s*,\s*(?P<value>{_PIECES})",
        rf"->connect\(\s*(?:{_QUOTED})\s*,\s*(?:{_QUOTED})\s*,\s*(?P<value>{_PIECES})",
        rf"\bauth\s*=\s*\(\s*(?:{_QUOTED})\s*,\s*(?P<value>{_PIECES})",
        rf"\bcurl\b[^\n]*?\s(?:-u|--user)\s*[\"']?{_USER}:(?P<value>[^\s\"']+)",
        rf"\bopen\s+{_USER},(?P<value>\S+)",
        rf"\becho\s+(?:-n\s+)?(?P<value>{_QUOTED}|{_BARE})\s*\|[^\n]*passphrase-fd",
        rf"\bsshpass\s+-p\s*(?P<value>{_QUOTED}|{_BARE})",
        rf"\bAuthorization[\"']?\s*[:=,]\s*[\"']?(?:Bearer|Token)\s+(?P<value>[A-Za-z0-9._~+/=-]+)",
        rf"<(?:[\w:]*?{_NAME})>(?P<value>[^<\n]+)</",
    )
]
_BASIC = re.compile(r"\bBasic\s+(?P<value>[A-Za-z0-9+/]{8,}={0,2})")
_SHAPES = re.compile(r"(?<![A-Za-z0-9_])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}|xox[abprs]-[A-Za-z0-9-]{10,}|eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]{8,})(?![A-Za-z0-9_])")
# A word, an underscore and a long run of letters and digits; a token if the run looks drawn at random.
_TAGGED = re.compile(r"(?<![A-Za-z0-9_])[a-z]{2,10}(?:_[a-z]+)*_(?P<run>[A-Za-z0-9]{20,})(?![A-Za-z0-9_])")
#: Bits a character from which a run counts as random.
RANDOM_BITS = 3.5
_PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----(?P<body>(?:(?!-----).)*)(?:-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----)?", re.S)
_PUBLIC = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*(?:PUBLIC KEY|CERTIFICATE|CERTIFICATE REQUEST|X509 CRL)-----.*?-----END [A-Z0-9 ]+-----", re.S)

# Lines without any of these (in lower case) hold nothing that the rules above could match,
# lines without any of those behind it nothing that could be decoded.
_WORDS = r"pass|pw|secret|tok|key|login|://|jdbc|sqlplus|connect|auth|basic|akia|[a-z]_[a-z0-9]{20}|xox|eyj|credential|was |open "
_HINT = re.compile(_WORDS)
_ENCODED = re.compile(r"[A-Za-z0-9+/_-]{16,}|%[0-9A-Fa-f]{2}[^\s%]*%[0-9A-Fa-f]{2}|\\x[0-9A-Fa-f]{2}|\\u[0-9A-Fa-f]{4}|\\[0-7]{3}")

_REFERENCE = re.compile(
    r"""^(?:
      [$@%&][\w{(].* | \$\{.* | \{\{.* | \{\w*\} | <.*> | %\w+% | \#\{.* |                     # variables, templates
      [*x•.\-_#?]+ | \[?(?:redacted|masked|removed|hidden)\]? |                              # masked
      (?:none|null|nil|undef|true|false|yes|no|unset|tbd|todo|changeme|n/a)[,;)]*            # no value
    )$""",
    re.X | re.I,
)
# Calls and look-ups, in values that are not quoted.
_LOOKUP = re.compile(r"^(?:[\w.:>-]+\s*\(.*|[\w.]+\[.*|(?:os|self|cfg|env|config|args|opts?|vault|file)[.:].*)$", re.I)
_PATH = re.compile(r"^(?:~|\.{0,2})/(?:[\w.-]+/)+\.?[\w.-]+$")
# Whole words of prose after a name that may also stand in a sentence.
_PROSE = re.compile(r"^[a-z]+[.,;:]?$", re.I)
_CODE_VALUE = re.compile(r"^\d{1,6}$|^[a-z_]+\.[a-z_]+\b", re.I)


def _literal(value: str) -> str:
    """The text of a bare value or of joined quoted pieces."""
    if value[:1] in "\"'":
        return "".join(p[1:-1] for p in re.findall(_QUOTED, value))
    return value


def random_run(text: str) -> bool:
    """Whether letters and digits look drawn at random: all three kinds, and enough bits a character."""
    if not (re.search("[a-z]", text) and re.search("[A-Z]", text) and re.search(r"\d", text)):
        return False
    return -sum(n / len(text) * math.log2(n / len(text)) for n in Counter(text).values()) >= RANDOM_BITS


# Words that sentences hold and passphrases do not.
_SENTENCE = re.compile(r"(?i)\b(?:a|an|the|is|are|was|be|must|may|not|no|for|from|of|to|in|on|at|by|with|and|or|your|you|this|that|please|enter|invalid|wrong|missing|required|expired)\b|[.!?:]$|[<>{}%$]")


def _passphrase(name: str, text: str) -> bool:
    """Three words or more that make no sentence, under a name that asks for a password."""
    return "pass" in name and len(text.split()) >= 3 and not _SENTENCE.search(text)


def _named(name: str, value: str, plain: bool = False) -> bool:
    """Whether a value given to a secret name is a credential in full; ``plain``: set as in a shell or an env file."""
    quoted, text = value[:1] in "\"'", _literal(value).strip()
    if len(text) < 4 or _REFERENCE.match(text) or not quoted and _LOOKUP.match(text):
        return False
    if _PATH.match(text) and not re.search(r"[A-Z].*[A-Z].*\d|\d.*[A-Z].*[A-Z]", text):
        return False
    low = name.lower().rstrip("\"'}] ")
    if low.endswith(("token", "tok", "key")):
        # such names also hold counts, columns and field names
        return len(text) >= 12 and bool(re.search(r"\d|[A-Z].*[a-z]|[a-z].*[A-Z]", text)) and not re.search(r"\s", text)
    if not quoted:
        text = text.rstrip(",")
        return len(text) >= 4 and not _CODE_VALUE.match(text) and (plain or bool(re.search(r"[0-9\W_]|[a-z][A-Z]", text)) or len(text) >= 8)
    return not re.search(r"\s", text) or bool(re.search(r"\d", text)) or _passphrase(low, text)


def _said(value: str) -> bool:
    """Whether a value in a login phrase or connection string is a credential in full."""
    text = _literal(value).strip()
    if len(text) < 4 or _REFERENCE.match(text) or _LOOKUP.match(text) or _PATH.match(text):
        return False
    return bool(re.search(r"\d|[^\w.,;:!?'-]|[a-z][A-Z]", text)) or (value[:1] in "\"'" or text.count("-") >= 2 or len(text) >= 12) and not _PROSE.match(text) or len(text) >= 12 and value == text


# Content types that a PKCS#12 file holds (data, signed data), and the encryptions of PKCS#8 (PKCS#5, PKCS#12).
_PFX_CONTENT = (b"\x2a\x86\x48\x86\xf7\x0d\x01\x07\x01", b"\x2a\x86\x48\x86\xf7\x0d\x01\x07\x02")
_PBE = (b"\x2a\x86\x48\x86\xf7\x0d\x01\x05", b"\x2a\x86\x48\x86\xf7\x0d\x01\x0c\x01")


def _der_private(data: bytes) -> bool:
    """DER grammar: PKCS#1, SEC1 or DSA (SEQUENCE of version and integers or octets), PKCS#8, encrypted PKCS#8 or PKCS#12."""

    def head(i: int) -> tuple[int, int, int]:
        tag, n = data[i], data[i + 1]
        i += 2
        if n == 0x80 and tag & 0x20:  # open length, as BER writers of PKCS#12 use it
            n = len(data) - i
        elif n & 0x80:
            k = n & 0x7F
            if not 1 <= k <= 4:
                raise ValueError
            n, i = int.from_bytes(data[i : i + k], "big"), i + k
        return tag, i, n

    try:
        tag, i, n = head(0)
        if tag != 0x30 or not 16 <= n or abs(len(data) - i - n) > 2:
            return False
        tag, i, n = head(i)
        if tag == 0x30:  # encrypted PKCS#8: the encryption, then the key as octets
            oid, j, k = head(i)
            return oid == 0x06 and data[j : j + k].startswith(_PBE) and head(i + n)[0] == 0x04 and head(i + n)[2] >= 16
        if tag != 0x02 or n != 1 or data[i] not in (0, 1, 3):
            return False
        version = data[i]
        tag, j, n = head(i + 1)
        if version == 3:  # PKCS#12: a content type and what it holds
            oid, j, k = head(j)
            return tag == 0x30 and oid == 0x06 and data[j : j + k] in _PFX_CONTENT
        if tag == 0x30:  # PKCS#8: algorithm, then the key as octets
            return data[j] == 0x06 and head(j + n)[0] == 0x04
        return tag in (0x02, 0x04) and n >= 16
    except (IndexError, ValueError):
        return False


def _openssh_private(data: bytes) -> bool:
    """OpenSSH grammar: cipher, key derivation and its options, number of keys, public keys, private part."""
    if not data.startswith(b"openssh-key-v1\x00"):
        return False
    i = 15

    def field(i: int) -> int:
        n = int.from_bytes(data[i : i + 4], "big")
        if i + 4 > len(data):
            raise ValueError
        return i + 4 + n

    try:
        for _ in range(3):
            i = field(i)
        keys = int.from_bytes(data[i : i + 4], "big")
        i += 4
        for _ in range(min(keys, len(data))):
            i = field(i)
        return keys >= 1 and i < len(data)  # a cut private part is private still
    except ValueError:
        return False


def _java_store(data: bytes) -> bool:
    """JKS and JCEKS grammar: version, then entries of a tag, an alias, a date and what they hold; certificates alone are no case."""
    if data[:4] not in (b"\xfe\xed\xfe\xed", b"\xce\xce\xce\xce") or int.from_bytes(data[4:8], "big") not in (1, 2):
        return False
    i, version = 12, data[7]
    for _ in range(min(int.from_bytes(data[8:12], "big"), len(data))):
        tag, n = int.from_bytes(data[i : i + 4], "big"), int.from_bytes(data[i + 4 : i + 6], "big")
        if tag in (1, 3):
            return i + 6 + n + 8 < len(data)
        i += 6 + n + 8
        if tag != 2 or i >= len(data):
            return False
        if version == 2:  # the certificate's type
            i += 2 + int.from_bytes(data[i : i + 2], "big")
        i += 4 + int.from_bytes(data[i : i + 4], "big")
    return False


def key_container(data: bytes) -> bool:
    """Whether bytes are a private-key container."""
    return _der_private(data) or _openssh_private(data) or _java_store(data)


_B64 = re.compile(r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/]{16,}|[A-Za-z0-9_-]{16,})={0,2}(?![A-Za-z0-9+/=_-])")
_HEX = re.compile(r"(?<![0-9A-Za-z])(?:0x)?(?:[0-9a-fA-F]{2}){8,}(?![0-9A-Za-z])")
# A match begins where a stretch does and gives nothing back, so long stretches are walked once.
_PCT = re.compile(r"(?<![\w.~:/@=&?+-])[\w.~:/@=&?+-]*+(?:%[0-9A-Fa-f]{2}[\w.~:/@=&?+-]*+){3,}")
_PCT_OF_PCT = re.compile(r"%(?:25)++(?=[0-9A-Fa-f]{2})")
_ESC = re.compile(r"(?<![^\s\"'\\])(?:[^\s\"'\\]*+(?:\\x[0-9A-Fa-f]{2}|\\u[0-9A-Fa-f]{4}|\\[0-7]{3})){3,}[^\s\"'\\]*+")
_RUN = r"[A-Za-z0-9+/_-]"
_GLUE = r"[\"']?[ \t]*[\\+.&]?[ \t]*\r?\n[ \t]*(?:(?:\#|//|\*|--)[ \t]*)?[+.&]?[ \t]*[\"']?"
#: A literal over several lines: a run that ends a line, runs that fill lines, and a last one.
_WRAPPED = re.compile(rf"(?<!{_RUN}){_RUN}{{16,}}(?:{_GLUE}{_RUN}{{16,}})*+(?:{_GLUE}{_RUN}+)?={{0,2}}(?=[\"')\],;]*[ \t]*(?:\r?\n|$))")


def _text(data: bytes) -> str | None:
    try:
        s = data.decode("utf-8")
    except UnicodeDecodeError:
        return None
    return s if s and sum(c.isprintable() or c in "\r\n\t" for c in s) >= 0.97 * len(s) else None


def _decoded(run: str) -> Iterator[bytes]:
    """What a run of letters, digits and signs stands for as base64 and as hex."""
    raw = run.rstrip("=")
    if len(raw) % 4 != 1 and not raw.isdigit():
        try:
            yield base64.urlsafe_b64decode(raw.replace("+", "-").replace("/", "_") + "=" * (-len(raw) % 4))
        except (ValueError, binascii.Error):
            pass
    if len(raw) % 2 == 0:
        try:
            yield bytes.fromhex(raw)
        except ValueError:
            pass


def _layers(text: str, clear: str) -> Iterator[tuple[int, int, bytes]]:
    """Encoded literals of a text with the bytes they stand for.

    ``clear`` is the text with what is found already blanked. Percent codes and escapes stand for
    themselves wherever a literal begins, so what is left of one is decoded alone.
    """
    for m in _B64.finditer(text):
        raw = m.group().rstrip("=")
        if len(raw) % 4 == 1 or raw.isdigit():
            continue
        try:
            yield m.start(), m.end(), base64.urlsafe_b64decode(raw.replace("+", "-").replace("/", "_") + "=" * (-len(raw) % 4))
        except (ValueError, binascii.Error):
            pass
    for m in _HEX.finditer(text):
        yield m.start(), m.end(), bytes.fromhex(m.group().removeprefix("0x"))
    for m in _PCT.finditer(clear) if "%" in clear else ():
        yield m.start(), m.end(), unquote(_PCT_OF_PCT.sub("%", m.group())).encode()
    for m in _ESC.finditer(clear) if "\\" in clear else ():
        try:
            yield m.start(), m.end(), m.group().encode("latin-1", "backslashreplace").decode("unicode_escape").encode("utf-8", "replace")
        except UnicodeDecodeError:
            pass


def _wrapped(text: str) -> Iterator[tuple[int, int, bytes]]:
    """Literals that go on over several lines, with the bytes they stand for; the last line may not belong to them."""
    for m in _WRAPPED.finditer(text):
        if "\n" not in m.group():
            continue
        parts = _parts(m.group())
        for n in (len(parts), len(parts) - 1):
            if n > 1:
                end = m.start() + parts[n - 1][1]
                for data in _decoded("".join(m.group()[s:e] for s, e in parts[:n])):
                    yield m.start(), end, data


def _parts(block: str) -> list[tuple[int, int]]:
    """The runs of a block over several lines, one a line."""
    out, at = [], 0
    for line in block.split("\n"):
        if m := re.search(rf"{_RUN}+={{0,2}}(?=[\"']?[ \t]*[\\+.&]?[ \t]*\r?$)", line):
            s = m.start()
            while line.startswith("//", s) and out:  # a comment mark before the run
                s += 2
            out.append((at + s, at + m.end()))
        at += len(line) + 1
    return out


def _inner(m: re.Match) -> tuple[int, int]:
    """The span of a value without the quotes around it."""
    s, e = m.span("value")
    v = m.group("value")
    if v[:1] in "\"'" and v[-1:] == v[:1] and len(re.findall(_QUOTED, v)) == 1:
        return s + 1, e - 1
    return s, e


def _candidate_lines(text: str) -> dict[int, bool]:
    """Start of each line worth a look, and whether the rules (not only decoding) may apply."""
    low = text.lower()
    if len(low) != len(text):  # letters whose lower case is longer; positions must stay
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    lines: dict[int, bool] = {}
    end = -1
    for m in _ENCODED.finditer(text):
        if m.start() > end:
            start, end = text.rfind("\n", 0, m.start()) + 1, text.find("\n", m.end())
            lines[start] = False
            if end < 0:
                break
    end = -1
    for m in _HINT.finditer(low):
        if m.start() > end:
            start, end = text.rfind("\n", 0, m.start()) + 1, text.find("\n", m.end())
            lines[start] = True
            if end < 0:
                break
    return lines


def _keys(text: str) -> tuple[list[Finding], str]:
    """Private keys in text form, and the text with key blocks blanked."""
    spans: list[Finding] = []
    if "-----BEGIN " in text:
        hide = []
        for m in _PEM.finditer(text):
            body = re.sub(rf"\\[nr]|{MASK}|[\s\"'+.#*/]+", "", m.group("body"))
            if len(re.sub(r"[^A-Za-z0-9+/=]", "", body)) >= 40 and not re.search(r"<.*>|\.\.\.", m.group("body")):
                spans.append(Finding(*m.span("body"), "private_key"))
            hide.append(m.span())
        hide += [m.span() for m in _PUBLIC.finditer(text)]
        for s, e in hide:  # what stands inside key blocks is not looked at again
            text = text[:s] + re.sub(r"[^\n]", " ", text[s:e]) + text[e:]
    return spans, text


def _lines(text: str) -> Iterator[tuple[int, str, bool]]:
    """Start and text of each line worth a look, and whether the rules may apply."""
    for at, ruled in _candidate_lines(text).items():
        end = text.find("\n", at)
        yield at, text[at : end if end >= 0 else len(text)], ruled


def scan(text: str | None) -> list[Finding]:
    """Findings of one text, in order; spans cover what must be masked."""
    if not text:
        return []
    spans, text = _keys(text)
    wrapped = _long_literals(text)
    for at, line, ruled in _lines(text):
        spans += [Finding(at + s, at + e, k) for s, e, k in _scan_line(line, ruled) if not any(at + s < w.end and w.start < at + e for w in wrapped)]
    spans = sorted(spans + wrapped)
    out: list[Finding] = []
    for f in spans:
        if not out or f.start >= out[-1].end:
            out.append(f)
    return out


def _long_literals(text: str) -> list[Finding]:
    """Encoded literals over several lines that hold a credential."""
    out: list[Finding] = []
    for s, e, data in _wrapped(text):
        if (not out or s >= out[-1].end) and (key_container(data) or (inner := _text(data)) and _holds(inner)):
            out.append(Finding(s, e, "wrapped"))
    return out


def _holds(text: str) -> bool:
    """Whether a decoded text holds a credential, in the clear or below any number of encodings."""
    todo, seen = [text], {text}
    while todo:
        keys, text = _keys(todo.pop())
        if keys:
            return True
        for _, _, data in _wrapped(text):
            if key_container(data):
                return True
            if (inner := _text(data)) and inner not in seen:
                seen.add(inner)
                todo.append(inner)
        for _, line, ruled in _lines(text):
            if ruled and _clear(line):
                return True
            for s, e, data in _layers(line, line):
                if key_container(data):
                    return True
                if (inner := _text(data)) and inner != line[s:e] and inner not in seen:
                    seen.add(inner)
                    todo.append(inner)
    return False


# NAME=value as a shell or an env file sets it: nothing before the name but export or set.
_ENV_LINE = re.compile(r"\s*(?:(?:export|set|setenv|declare|typeset|readonly|ENV)\s+)?[A-Z][A-Z0-9_]*=[^\s]+$")


def _clear(line: str) -> list[Finding]:
    """What the rules find in a line."""
    found = [Finding(*m.span(), "token") for m in _SHAPES.finditer(line)]
    found += [Finding(*m.span(), "token") for m in _TAGGED.finditer(line) if random_run(m.group("run"))]
    pos = 0
    while m := _ASSIGN.search(line, pos):
        plain = m.group("sep") == "=" and bool(_ENV_LINE.match(line, 0, m.end()))
        if line[m.end() : m.end() + 1] not in ("(", "[") and _named(m.group("name"), m.group("value"), plain):
            found.append(Finding(*_inner(m), "assignment"))
            pos = m.end()
        else:
            pos = m.end("name")
    for rule in _PHRASES:
        for m in rule.finditer(line):
            if _said(m.group("value")):
                found.append(Finding(*_inner(m), "login"))
    for m in _BASIC.finditer(line):
        try:
            user, colon, word = base64.b64decode(m.group("value"), validate=True).decode("utf-8").partition(":")
        except (ValueError, binascii.Error):
            continue
        if user and colon and word and not _REFERENCE.match(word):
            found.append(Finding(*m.span("value"), "encoded"))
    return found


def _scan_line(line: str, ruled: bool) -> list[Finding]:
    found = _clear(line) if ruled else []
    clear = line
    for s, e, _ in found:
        clear = clear[:s] + " " * (e - s) + clear[e:]
    for s, e, data in _layers(line, clear):
        if any(f.start <= s and e <= f.end for f in found):
            continue  # masked as it is
        if key_container(data):
            kind = "private_key"
        elif (inner := _text(data)) and inner != line[s:e] and _holds(inner):
            kind = "encoded"
        else:
            continue
        # What a literal shares letters with is masked together with it.
        shared = [f for f in found if f.start < e and s < f.end]
        found = [f for f in found if f not in shared]
        found.append(Finding(min([s, *[f.start for f in shared]]), max([e, *[f.end for f in shared]]), kind))
    return found


def mask(text: str | None, findings: list[Finding]) -> str | None:
    """The text with each found span replaced; line count, quotes and surroundings stay."""
    if not text or not findings:
        return text
    out, at = [], 0
    for f in findings:
        span = text[f.start : f.end]
        out.append(text[at : f.start])
        lead = span[: len(span) - len(span.lstrip("\r\n"))]
        if f.kind == "wrapped":
            pos = 0
            for s, e in _parts(span):
                out.append(span[pos:s] + MASK)
                pos = e
            out.append(span[pos:])
        elif f.kind == "private_key" and "\n" in span:
            out.append("\n".join(MASK if x.strip() else x for x in span.split("\n")))
        elif span[:1] in "\"'":  # several pieces become one literal
            out.append(span[0] + MASK + span[0])
        elif f.kind == "private_key" and span.startswith("\\n"):
            out.append("\\n" + MASK + "\\n")
        else:
            out.append(lead + MASK)
        at = f.end
    return "".join(out) + text[at:]


def _find(with_text: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, lines, kinds, texts = [], [], [], []
            for i, text in zip(pdf["id"], pdf["text_content"], strict=True):
                found = scan(text)
                if with_text:
                    ids.append(i)
                    kinds.append(len(found))
                    texts.append(mask(text, found))
                    continue
                last = 0
                for f in found:
                    no = text.count("\n", 0, f.start) + 1
                    if no != last:
                        ids.append(i)
                        lines.append(no)
                        kinds.append(f.kind)
                        last = no
            if ids:
                yield pd.DataFrame({"id": ids, "n_found": kinds, "text_content": texts} if with_text else {"id": ids, "line_no": lines, "kind": kinds})

    return run


def find_credentials(artifacts: DataFrame) -> DataFrame:
    """id, line_no, kind: one row per row id and line on which a credential starts."""
    texts = artifacts.select(F.col("id").cast("long"), "text_content").filter("text_content is not null and text_content != ''")
    return texts.mapInPandas(_find(False), "id long, line_no int, kind string")


def redact_credentials(artifacts: DataFrame) -> DataFrame:
    """id, n_found, text_content: every row, with its credentials masked."""
    texts = artifacts.select(F.col("id").cast("long"), "text_content")
    return texts.mapInPandas(_find(True), "id long, n_found int, text_content string")
