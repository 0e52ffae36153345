"""Credentials embedded in source code: finding them with their place, and blanking only the secret.

Quoted strings, long tokens and the values after a credential's name are the candidates. A candidate is flagged if its Shannon
entropy, in the alphabet it is written in, lies above a threshold that depends on its length, and if neither its form (UUID,
path, identifier, placeholder, data URI, password hash) nor its context (digests, commits, request ids, lock files) explains the
entropy. Every kind of credential passes that test; a name, an issuer's prefix or a place such as a URL's user part only lowers the
threshold and the least length. After a name such as `password`, where people choose memorable values, mixed character classes
are asked for besides.
"""

from __future__ import annotations

import math
import re
from collections.abc import Container, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import newest_first

_SPAN = T.StructType([T.StructField(n, T.IntegerType()) for n in ("line_no", "start", "end")] + [T.StructField("kind", T.StringType())])
SPANS = T.ArrayType(_SPAN)

#: Names after which a value gives access; strong ones let a memorable password count.
PASSWORD_NAME = r"pass(?:word|wd|phrase|code)?|pwd|(?<![A-Za-z.])pw"
TOKEN_NAME = r"secret|token|api[_-]?key|access[_-]?key|private[_-]?key|service[_-]?key|secret[_-]?key|signing[_-]?key|encryption[_-]?key|auth[_-]?key|client[_-]?key|bearer|credentials?|x-auth|auth|apikey"
#: Names whose values look random but open nothing.
HARMLESS_NAME = re.compile(r"(?i)(?:etag|checksum|digest|hash|\bsha-?\d*\b|md5|crc|commit|revision|\brev\b|request.?id|trace.?id|span.?id|build.?id|uuid|guid|integrity|icon|image|mappings|fingerprint|nonce|cursor|built from|reviewed at|\bpublic|\bcert|font|logo|sprite|thumbnail|\bblob|schema.?id|correlation|event.?id|message.?id|\bsalt)")
#: What stands where a secret would.
PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|\.+|-+|_+|0+|<.*>|\[.*\]|\{.*\}|\$.*|%.*%|%s|#\{.*|@.*@|!vault.*|.*\b(?:example|sample|dummy|placeholder|redacted|changeme|change[_-]?me|replace[_-]?me|insert|your|todo|fixme|none|null|undefined|true|false|test|secret|password|passwort|passwd|masked|hidden|unset|empty|default|fake|mock|foobar|tbd)\b.*|your[-_].*|my[-_].*)$")
REFERENCE = re.compile(r"(?i)(?:process\.env|os\.environ|getenv|vault|secretsmanager|load_secret|getpass|\$\{|\$\(|\{\{|System\.getenv|keyring|ssm:|env\.|config\.get|#\{|%\()")
PREFIXED = re.compile(r"(?<![A-Za-z0-9_])(?:AKIA[0-9A-Z]{16}(?![0-9A-Za-z])|AKIA[0-9A-Z]{4,15}(?=['\"`]\s*[+\\])|ASIA[0-9A-Z]{16}(?![0-9A-Za-z])|gh[pousr]_[A-Za-z0-9]{6,}|github_pat_\w{20,}|xox[abeoprs]-[A-Za-z0-9-]{8,}|[sr]k_(?:live|prod)_[A-Za-z0-9]{6,}|AIza[A-Za-z0-9_\-]{6,}|glpat-[A-Za-z0-9_\-]{5,}|npm_[A-Za-z0-9]{30,}|SG\.[\w\-]{16,}\.[\w\-]{16,}|eyJ[A-Za-z0-9_\-]{8,}(?:\.(?:eyJ)?[A-Za-z0-9_\-]{3,}){0,2})")
PRIVATE_KEY = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
KEY_BODY = re.compile(r"(?:\s|\\n|\\r|['\"`+,\\]|//|#|\*)*[A-Za-z0-9+/=]{16,}")
WRAPPING = re.compile(r"\\[nr]|[^A-Za-z0-9+/=]")
KEY_END = re.compile(r"-----END [A-Z0-9 ]*(?:-----)?")
USERINFO = re.compile(r"[A-Za-z][A-Za-z0-9+.\-]{1,20}://[^\s:/@'\"`<>{}$]{0,64}:([^\s@/'\"`<>]{3,128})@")
QUERY_PART = re.compile(r"(?i)[?&;](?:[a-z_\-]*(?:key|token|secret|password|pwd|sig|auth))=([^&\s'\"`#<>]{6,})")
FLAG = re.compile(r"(?i)(?:--?(?:password|passwd|pass|token|secret|api-key|auth-token)[= ]|\s-p)(?=\S)['\"]?([^\s'\"`,)]{6,})")
BASIC_USER = re.compile(r"(?:\s-u|--user)[ =]['\"]?[\w.\-]+:([^\s'\"`]{5,})")
IDENTIFIED = re.compile(r"(?i)identified (?:with \w+ )?by\s+['\"]([^'\"]{5,})['\"]|password\s+'([^']{5,})'")
HEADER = re.compile(r"(?i)(?:authorization|proxy-auth\w*|x-[\w\-]*(?:auth|key|token)[\w\-]*)['\"`]?\]?\s*[:=,]\s*['\"`]?(?:(?:bearer|basic|token|apikey|digest)\s+)?([A-Za-z0-9+/_\-.=~]{12,})")
BEARER = re.compile(r"\b(?:Bearer|Basic)\s+([A-Za-z0-9+/_\-.=~]{16,})")
PROSE = re.compile(r"(?i)(?:(?:credentials?|log ?in|sign ?in|account|user(?:name)?)\b[^\n=]{0,32}?[: ]\s*(?:as\s+)?[\w.\-]+(?:/|:|\s+/\s+|\s+with\s+)|\b(?:password|passwd|pw|pass|passphrase)\b(?:\s+is)?[: ]\s*)[`'\"*]{0,3}([^\s/'\"`,;()]{6,})")
TABLE = re.compile(rf"(?i)\|\s*[\w\- ]*(?:{PASSWORD_NAME}|{TOKEN_NAME})\s*\|\s*`?([^\s|`]{{6,}})`?\s*\|")
QUOTED = re.compile(r"(['\"`])([^'\"`\s]{6,})\1")
#: A name as short as pw is also one a minifier gives; it must stand in the statement of the value.
NEAR_PASSWORD = re.compile(r"(?i)(?:pass(?:word|wd|phrase|code)?|pwd)\b|(?<![A-Za-z.])pw\b[^;}]*$")
NEAR_TOKEN = re.compile(rf"(?i)(?:{TOKEN_NAME})(?![a-z])")
CONNECTS = re.compile(r"(?i)\b(?:connect|login|log_in|auth|authenticate|sign_?in|open_session|credentials?)\w*\s*(?:=\s*)?\(")
USER_PASS = re.compile(r"(?<![\w/.:@#])[A-Za-z][\w.\-]{2,30}:([^\s:/'\"`,;()<>{}]{8,64})(?=\s)")
ASSIGNED = re.compile(r"(?i)([A-Za-z_][\w.\-]{0,60}?)['\"`]?\]?\)?\s*(?::\s*[A-Za-z<>|\[\] ]{2,24}=|:=|=>|=|:|,)\s*(?:(?:@|[bfruBFRU]{1,2}(?=['\"]))?(['\"`])([^'\"`\n]{4,})\2|((?![$!=+])[^\s'\"`,;(){}\[\]<>|&]{6,}))")
SECRET_TAIL = re.compile(rf"(?i)(?:^|[_.\-]|(?<=[a-z0-9])(?=[A-Z]))?(?:({PASSWORD_NAME})|({TOKEN_NAME}))(?:[_\-]?(?:\d+|value|string|prod|live|old|new|raw))?$")
CALLED = re.compile(rf"(?i)(?:set|with|add|put|use)?_?(?:{PASSWORD_NAME}|{TOKEN_NAME})\(\s*(?:['\"][\w\-]*['\"]\s*,\s*)?['\"]([^'\"\n]{{5,}})['\"]")
ANNOTATED = re.compile(rf"(?i)\(\s*['\"]([^'\"\n]{{8,}})['\"]\s*\)[^=;\n]*?\b\w*(?:{PASSWORD_NAME}|{TOKEN_NAME})\s*;")
TOKEN = re.compile(r"[A-Za-z0-9+/_\-.!@#%^&*?~]{15,}={0,2}")
OPENER = re.compile(rf"(?i)(?:{PASSWORD_NAME}|{TOKEN_NAME}|\bkey)[\w]*['\"]?\]?\s*(?::=|=|:)\s*(?:[>|][+\-]?|\(|\\)?\s*$")
OPENING = tuple(">|=:(\\-+")
BARE = re.compile(r"^\s*[brf]?(['\"`]?)([^\s'\"`]{6,})\1\s*(?:\+|\\|\)|;|,)*\s*\\?$")
#: A line longer than WIDE is many lines of a minified script or a table in one, so names explain the values up to
#: AROUND characters away, not all of it, and a comment there has spaces around its mark, which URLs and statements have not.
WIDE, AROUND = 1000, 60
WIDE_COMMENT = re.compile(r"(?:^|(?<=\s))(?:/\*.*?(?:\*/|$)|<!--.*?(?:-->|$)|(?://|#|\*|--|;)\s.*$)")
UUID = re.compile(r"(?i)^[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}$")
IDENTIFIER, WORDS = re.compile(r"(?:[A-Z]?[a-z]++|[A-Z]{2,}+|\d{1,4}+|[_\-.$/])++"), re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
HEX = re.compile(r"^(?:[0-9a-f]+|[0-9A-F]+)$")
PASSWORD_HASH = re.compile(r"^(?:\$2[abxy]?\$|\$argon2|\$[156]\$|\$pbkdf2|\{SSHA)|:\$2[abxy]\$")
ENCODED = re.compile(r"(?i)data:[\w/+.\-]*;base64|base64,|sha\d{1,3}[-:=]|ssh-(?:rsa|ed25519)|-----BEGIN (?:[A-Z]+ )*(?:PUBLIC KEY|CERTIFICATE)")
COMMENT = re.compile(r"(?://|#|/\*|^\s*\*|<!--|--\s|;)\s?(.*)$")
#: Fixed values, in lower case: what a line must hold for any of these patterns to match on it. A needle for each spelling that a
#: pattern accepts; where the needles are common words, the line is looked at only if the pattern itself matches.
_KEYS = tuple(f"{a}{b}key" for a in ("api", "access", "private", "service", "signing", "encryption", "client") for b in ("", "_", "-"))
SURE = ("pass", "pwd", "secret", "token", "bearer", "credential", "auth", *_KEYS, "sig=", "key=", "identified", "private key", "://")
UNSURE = (
    (("user", "account", "login", "log in", "signin", "sign in"), PROSE), (("connect", "login", "log_in", "signin", "sign_in", "open_session"), CONNECTS),
    (("akia", "asia", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "xox", "_live_", "_prod_", "aiza", "glpat-", "npm_", "sg.", "eyj"), PREFIXED),
    (("pw",), re.compile(r"(?i)(?<![a-z])pw")), (("basic",), BEARER), (("x-",), HEADER), (("-p",), FLAG), (("-u",), BASIC_USER),
    (("key",), re.compile(r"(?i)\bkey\w*['\"]?\]?\s*(?::=|=|:)\s*(?:[>|][+\-]?|\(|\\)?\s*$")),
)
LONG = re.compile(r"[A-Za-z0-9+/_\-.!@#%^&*?~]{20,}={0,2}")
NAMED = re.compile(r":([^\s:/'\"`,;()<>{}]{8,64}+)(?=\s)")


def entropy(value: str) -> float:
    """Shannon entropy in bits a character."""
    n = len(value)
    counts = {c: value.count(c) for c in set(value)}
    return -sum(k / n * math.log2(k / n) for k in counts.values()) if n else 0.0


#: Shares of the highest entropy possible: that of a value nothing speaks for, of one with an issuer's prefix, of one that people
#: choose, who repeat syllables, and of the body of a key block, whose lines can be alike.
UNNAMED, PREFIX, CHOSEN, BLOCK = 0.8, 0.65, 0.5, 0.5


def threshold(length: int, alphabet: int, share: float = UNNAMED) -> float:
    """The entropy that random text of that length and alphabet reaches almost always: a share of the highest possible, which
    falls short for short texts as letters repeat by chance."""
    if alphabet <= 16:
        return (2.9 + 0.4 * min(1.0, length / 64)) * share / UNNAMED
    return share * math.log2(min(length, alphabet))


def alphabet(value: str) -> int:
    """How many characters the narrowest of these alphabets has: digits, hex, letters of one case with digits, all others."""
    if HEX.match(value):
        return 10 if value.isdigit() else 16
    return 36 if value.isalnum() and (value.islower() or value.isupper()) else 64


def dense(value: str, share: float) -> bool:
    """Whether the entropy of a value that something introduces lies above its threshold; the alphabet of a short one is not known."""
    size = alphabet(value) if len(value) >= 30 else 64
    return len(value) > 1 and entropy(value) > threshold(len(value), size, share)


def random_looking(value: str, least: int = 16) -> bool:
    """Whether `value` is long enough for its alphabet and its entropy lies above the threshold; hex is told from base 64."""
    body = value.rstrip("=")
    n = len(body)
    if HEX.match(body):
        return n >= max(least, 32) - 2 and not body.isdigit() and entropy(body) > threshold(n, 16)
    if n < least or not any(map(str.isdigit, body)):
        return False
    if IDENTIFIER.fullmatch(body) and sum(map(str.isalpha, body)) >= 3.5 * len(WORDS.findall(body)):
        return False
    switches = sum(kind(a) != kind(b) for a, b in zip(body, body[1:]))
    return switches >= n / 4 and any(map(str.isalpha, body)) and entropy(body) > threshold(n, 64)


def kind(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


def memorable(value: str) -> bool:
    """A value people choose as a password: eight or more characters of at least two classes, one of them a digit or a sign, with
    the entropy of no repetition."""
    kinds = {kind(c) for c in value}
    return len(value) >= 8 and len(kinds) >= 2 and bool(kinds & {2, 3}) and any(map(str.isalnum, value)) and (2 in kinds or len(kinds) >= 3) and dense(value, CHOSEN)


def harmless(value: str) -> bool:
    """Placeholders, references, paths, URLs, identifiers, hashes and encoded data."""
    if PLACEHOLDER.match(value) or REFERENCE.search(value) or UUID.match(value) or PASSWORD_HASH.search(value) or ENCODED.search(value):
        return True
    if re.fullmatch(r"[A-Za-z]?[a-z0-9_.\-]*(?:/[A-Za-z]?[a-z0-9_.\-]*)+:?\d*", value) or re.match(r"[\w.]+\(", value):
        return True
    if len(set(value)) <= 3 or " " in value or "://" in value or re.search(r"\w\[\w+=|\.\w+\(|\)$", value):
        return True
    return bool(re.fullmatch(r"(?:\.{0,2}/)?[\w@.\-]+(?:/[\w@.\-]+)+\.\w{1,5}(?::\d+)?(?:#\w+)?", value)) or bool(re.fullmatch(r"[A-Za-z_$]+(?:\.[A-Za-z_$]+)+(?:\(\S*)?", value))


def _value_after(name: str, value: str) -> str | None:
    """The kind of credential that `value` after `name` is, or None."""
    tail = SECRET_TAIL.search(name)
    if harmless(value):
        return None
    if tail and not HARMLESS_NAME.search(name):
        if tail.group(1):
            return "password" if memorable(value) else None
        lead = value[:3]
        if random_looking(value, 12) or (memorable(value) and len(value) >= 10 and lead.isprintable() and not re.fullmatch(r"[\w\-]*", value)):
            return "token"
        return None
    return None


def _on_line(line: str, before: str) -> Iterator[tuple[int, int, str]]:
    """Start, end and kind of the candidates of one line that are credentials, most certain first."""
    for m in PREFIXED.finditer(line):
        if m.group().startswith("eyJ") and m.group().count(".") < 1 and not re.search(r"['\"`]\s*[+\\]|['\"`]\s*$", line[m.end():m.end() + 4]):
            continue
        if not re.search(r"(?i)example|xxxx|your|\*\*\*", m.group()) and dense(m.group(), PREFIX):
            yield m.start(), m.end(), "key"
    for m in USERINFO.finditer(line):
        value = m.group(1)
        if not PLACEHOLDER.match(value) and not REFERENCE.search(value) and "{" not in value and value.isprintable() and len(value) > 5 and dense(value, CHOSEN):
            yield *m.span(1), "url password"
    for pattern, least in ((QUERY_PART, 12), (HEADER, 12), (BEARER, 16)):
        for m in pattern.finditer(line):
            if not harmless(m.group(1)) and random_looking(m.group(1), least):
                yield *m.span(1), "token"
    for pattern in (FLAG, BASIC_USER, IDENTIFIED):
        for m in pattern.finditer(line):
            k = next(i for i, g in enumerate(m.groups(), 1) if g)
            if not harmless(m.group(k)) and memorable(m.group(k)):
                yield *m.span(k), "password"
    for pattern in (CALLED, ANNOTATED):
        for m in pattern.finditer(line):
            if not harmless(m.group(1)) and (memorable(m.group(1)) or random_looking(m.group(1))):
                yield *m.span(1), "password"
    comment = COMMENT.search(line)
    for m in [*PROSE.finditer(line), *TABLE.finditer(line), *(USER_PASS.finditer(comment.group(1)) if comment else ())]:
        shift = comment.start(1) if comment and m.re is USER_PASS else 0
        value = m.group(1).rstrip(".,")
        if line[m.start(1) + shift - 2 : m.start(1) + shift] == "**":
            value = value.removesuffix("**")
        if memorable(value) and not harmless(value) and not re.search(r"\.(?:go|ts|js|py|java|md|sql|sh)\b|[(<>]|^\d+$", value):
            yield m.start(1) + shift, m.start(1) + shift + len(value), "password"
    at = 0
    while m := ASSIGNED.search(line, at):
        at = max(m.end(1) + 1, m.start() + 1)
        k = 3 if m.group(3) is not None else 4
        value = m.group(k) if k == 3 else m.group(k).rstrip(";,")
        if k == 4 and "," in line[m.end(1) : m.start(k)]:
            continue  # the next argument of a call
        found = _value_after(m.group(1), value)
        if found:
            at = m.end(k)
            yield m.start(k), m.start(k) + len(value), found
    connects = CONNECTS.search(line)
    for m in QUOTED.finditer(line):
        value, lead = m.group(2), line[max(0, m.start() - 60) : m.start()]
        if harmless(value) or HARMLESS_NAME.search(lead[-24:]):
            continue
        if NEAR_TOKEN.search(lead) and random_looking(value, 12):
            yield *m.span(2), "token"
        elif memorable(value) and (NEAR_PASSWORD.search(lead) or connects and connects.end() <= m.start() and lead.rstrip()[-1:] == "," and line[m.end() :].lstrip()[:1] in (")", "}")):
            yield *m.span(2), "password"
    opened = OPENER.search(before) if before else None
    bare = BARE.match(line)
    if bare and not opened:
        return
    if bare and opened and not harmless(bare.group(2)) and (random_looking(bare.group(2), 10) or memorable(bare.group(2)) and len({kind(c) for c in bare.group(2)}) >= 3):
        yield *bare.span(2), "token"
    if re.match(r"\s*(?://|#|\*|--)\s*(?:file|module|signature|exports|kind|lines):", line):
        return
    wide = len(line) > WIDE
    if not wide and _explained(line):
        return
    comments = [c.span() for c in WIDE_COMMENT.finditer(line)] if wide else [(comment.start(1), len(line))] if comment else []
    end, explained = -1, False
    for m in TOKEN.finditer(line):
        value = m.group()
        if wide:  # what explains an item of a list explains those after it
            same = explained and not line[end : m.start()].strip("'\"`, \t")
            explained = same or _explained(f"{line[max(0, m.start() - AROUND) : m.start()]} {line[m.end() : m.end() + AROUND]}")
            end = m.end()
        quoted = line[m.start() - 1 : m.start()] in tuple("'\"`") and line[m.end() : m.end() + 1] in tuple("'\"`")
        if explained or value.count("/") > 2 and value[:1] in "/." or not (quoted or any(a <= m.start() < b for a, b in comments)):
            continue
        if not harmless(value) and random_looking(value, 20):
            yield m.start(), m.end(), "random"


def _explained(context: str) -> bool:
    """Whether what stands around a value tells why it looks random."""
    return bool(HARMLESS_NAME.search(context) or ENCODED.search(context) or REFERENCE.search(context))


def find(text: str | None, marks: Container[int] | None = None) -> list[tuple[int, int, int, str]]:
    """(line from 1, start, end, kind) of each credential in `text`, offsets within the text; a null or empty text has none.

    One credential a place: of overlapping candidates the first, most certain one holds. Lines end at a line feed. `marks` are the
    numbers from 0 of the lines to look at, by default all that can hold a credential.
    """
    if not text:
        return []
    lines = text.split("\n")
    marks = _marks(text, lines) if marks is None else marks
    if not marks:
        return []
    spans, at, before = [], 0, ""
    for no, line in enumerate(lines):
        if no in marks and len(line) > 7 or before.rstrip()[-1:] in OPENING and BARE.match(line.rstrip("\r")) and OPENER.search(before):
            taken: list[tuple[int, int]] = []
            pem = PRIVATE_KEY.search(line)
            if pem and KEY_BODY.match(text, at + pem.end()):
                found = KEY_END.search(text, at + pem.end())
                end = found.start() if found else len(text)
                if dense(WRAPPING.sub("", text[at + pem.end() : end]), BLOCK):
                    spans.append((no + 1, at + pem.end(), end, "private key"))
            else:
                for a, b, name in _on_line(line.rstrip("\r"), before):
                    if all(b <= x or a >= y for x, y in taken):
                        taken.append((a, b))
                        spans.append((no + 1, at + a, at + b, name))
        before, at = line, at + len(line) + 1
    inside, held = -1, []
    for s in sorted(spans, key=lambda s: s[1]):
        if s[1] >= inside:
            held.append(s)
            inside = s[2]
    return held


def _marks(text: str, lines: list[str]) -> set[int]:
    """The numbers from 0 of all lines on which some detector can find something, and of some others."""
    marks = set(_numbers(text, (m.start() for m in LONG.finditer(text) if _worth(m.group()))))
    marks.update(_numbers(text, (m.start() for m in NAMED.finditer(text) if memorable(m.group(1).rstrip(".,")))))
    low = text.casefold()
    if not text.isascii():  # what patterns take for i besides I
        low = low.replace("i\u0307", "i").replace("\u0131", "i")
    for needle in SURE:
        marks.update(_lines_with(needle, low))
    for needles, pattern in UNSURE:
        for needle in needles:
            marks.update(no for no in _lines_with(needle, low) if no not in marks and pattern.search(lines[no].rstrip("\r")))
    return marks


def _numbers(text: str, places: Iterable[int]) -> Iterator[int]:
    """The line from 0 of each of the ascending places."""
    no = counted = 0
    for at in places:
        no += text.count("\n", counted, at)
        counted = at
        yield no


def _lines_with(needle: str, text: str) -> Iterator[int]:
    def places() -> Iterator[int]:
        at = text.find(needle)
        while at >= 0:
            yield at
            end = text.find("\n", at)
            at = text.find(needle, end) if end >= 0 else -1

    return _numbers(text, places())


def _worth(token: str) -> bool:
    """Whether a long token is one that the entropy test takes: quick tests that every such token passes, then the test itself."""
    return not token.isdigit() and not token.isalpha() and len(set(token)) > 8 and random_looking(token, 20) and not harmless(token)


def redact(text: str | None, blank: str = "*", held: list[tuple[int, int, int, str]] | None = None) -> str | None:
    """`text` with each credential's characters replaced one for one, line ends kept: quotes, names and line numbers stay. `held` is
    what `find` gave, where that is known."""
    if not text:
        return text
    parts, at = [], 0
    for _, a, b, _ in find(text) if held is None else held:
        parts += [text[at:a], re.sub(r"[^\s\\'\"`+,;]", blank, text[a:b]) if "\n" in text[a:b] else blank * (b - a)]
        at = b
    return "".join([*parts, text[at:]])


@F.pandas_udf(SPANS)
def credential_spans(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [dict(zip(("line_no", "start", "end", "kind"), s)) for s in find(t)])


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("secrets", T.IntegerType())]))
def redacted(texts: pd.Series) -> pd.DataFrame:
    """Each text without its credentials, and how many those were; one search a text."""
    spans = [find(t) for t in texts]
    return pd.DataFrame({"text": [redact(t, held=s) for t, s in zip(texts, spans)], "secrets": [len(s) for s in spans]})


def scan(chunks: DataFrame, key: str = "id", text: str = "text", at: str = "seenAt") -> DataFrame:
    """key and spans of the current row of every key.

    Texts are searched where they are read; only key, time and the few spans are shuffled, so no text moves and a module with a
    third of all rows is no hot key. Null and empty texts have no spans, rows with a null key are left out, copies count once,
    very long texts are searched whole, an empty table gives an empty one, other columns are not read.
    """
    narrow = chunks.where(F.col(key).isNotNull()).select(key, newest_first(at).alias("__at"), credential_spans(F.col(text)).alias("spans"))
    return narrow.groupBy(key).agg(F.max_by("spans", "__at").alias("spans"))


def redact_rows(chunks: DataFrame, text: str = "text") -> DataFrame:
    """Every row with its text redacted and `secrets`, the number of credentials; all other columns as they are."""
    held = [c for c in chunks.columns if c not in (text, "secrets")]
    return chunks.select(*held, redacted(F.col(text)).alias("__r")).select(*held, F.col("__r.text").alias(text), F.col("__r.secrets").alias("secrets"))
