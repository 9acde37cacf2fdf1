"""Credentials embedded in source, configuration and prose: finding and redacting them.

1. *Index.*  Each file is read once for literals in a telling place (an assignment to a telling name, a
   URL, a header, a command line, a key block, a comment about a key) or of a telling form, and for
   the hashes of all its runs of letters and digits.
2. *Suppress and confirm.*  A value that a large share of the owners holds is a placeholder; the bar is
   higher for values of a structure that only issuers give.  What stays is rare for its kind and either
   structured or stands in a telling place: a confirmed secret.
3. *Re-scan.*  Files that can hold a confirmed value, as the index has a run of it, are scanned again by
   an automaton over these values, which also finds them outside any telling place.
"""

from __future__ import annotations

import base64
import binascii
import math
import re
from collections import Counter

import ahocorasick
import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import filled, spread
from graphloom.runtime import Staging

#: Share of all owners from which a value counts as a shared placeholder, and for structured values; never fewer than LEAST_OWNERS.
SHARED, SHARED_STRUCTURED, LEAST_OWNERS = 0.125, 0.5, 4
MASK = "REDACTED"

# Forms of issued tokens.
FORMS = re.compile(
    r"""(?<![A-Za-z0-9_+/-])(?:
      gh[pousr]_[A-Za-z0-9]{20,} | github_pat_\w{22,} | glpat-[\w-]{16,} | gl(?:dt|rt|cbt|ptt)-[\w-]{16,}
    | (?:AKIA|ASIA|AROA|AIDA)[A-Z0-9]{12,20} | AIza[\w-]{30,40} | ya29\.[\w-]{20,} | xox[abeprs]-[\w-]{10,} | xapp-[\w-]{10,}
    | [srp]k_(?:live|test)_[A-Za-z0-9]{16,} | whsec_[A-Za-z0-9]{16,} | SG\.[\w-]{16,}\.[\w-]{16,} | npm_[A-Za-z0-9]{30,} | pypi-[\w-]{32,} | dop_v1_[a-f0-9]{40,}
    | hf_[A-Za-z0-9]{24,} | sk-[A-Za-z0-9_-]{20,} | shpat_[a-f0-9]{24,} | EAACEdEose0cBA\w+ | eyJ[\w-]{8,}\.eyJ[\w-]{8,}\.[\w-]{8,}
    | [a-z]{2,6}_[A-Za-z0-9]{28,40}
    )(?![A-Za-z0-9+/])""",
    re.X,
)
PEM = re.compile(
    r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----(?P<body>(?:(?!-----).){16,}?)(?:-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----|(?=-----)|\Z)", re.S
)

# Last words of names that hold a secret.
PASS_WORDS = frozenset("password passwd pwd pass passphrase passcode passwort pw pswd passw contraseña clave kennwort secret secrets credential credentials userpass pin".split())
TOKEN_WORDS = frozenset("token tokens apikey bearer auth authtoken authkey accesskey secretkey privatekey sessionkey authorization sig signature cookie jwt pat".split())
KEY_WORDS = frozenset("key keys salt seed".split())
# Words before "key" that name something else.
NO_SECRET_KEYS = frozenset("public verify verification primary foreign cache sort partition index row object map dict hash group err error column lookup natural composite unique routing message event i18n translation property storage bucket pub host".split())

STAND_IN = re.compile(
    r"""^(?:<.*>?|\$.*|\{\{?.*|%.*%|\*+|\.{2,}.*|-+|_+|[xX]{3,}.*|\?+|\#+|@.*@|\[.*\]?|ENC\[.*|sealed:.*|(?:vault|ssm|secret|secrets|sops|kms|keyring|keychain|op|env|file|aws|gcp|azure|arn|ref\+\w+|doppler|bw)(?::|://|/).*
    |(?:process\.env|os\.environ|os\.getenv|getenv|System\.getenv|env|std::env|config|settings|secrets?|vars?|self|this|args|options|params|ctx)\b[.\[(].*
    |(?:https?|s3|gs|file|jdbc|data)://?[^@]*|/[\w./-]+|\./.*|~/.*|(?:sha\d+|md5|sha)[:-].*|\$2[aby]\$.*|\{(?:SSHA|SHA|MD5|bcrypt).*|\d+|v?\d+(?:\.\d+)+
    |[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12})$""",
    re.X,
)
STAND_IN_WORDS = re.compile(
    r"(?:change[\W_]*(?:me|this|it)|your[\W_]|[\W_]here$|example|placeholder|dummy|^sample[\W_]?(?:password|secret|token|key|value)|insert[\W_](?:your|a|the|here)|replace[\W_]?(?:me|with|this)|"
    r"^(?:redacted|removed|masked|hidden|none|null|nil|undefined|true|false|yes|no|test|testing|to[\W_]?do|fixme|secret|password|passwd|token|key|default|empty|string|value|required|optional|disabled|enabled|unset|admin|root|guest|user|"
    r"foo|bar|baz|foobar|hunter2|letmein|qwerty|abc123|secret123|password\d*|passw0rd|test\d+|pass\d*|1234\w*|admin\d*|0+|f+)$|not[\W_]?(?:set|a[\W_]real|real)|abcdef|012345|123456|deadbeef|xxxx|\*\*\*\*|lorem|^(?:fake|mock|stub|bogus|noop)[\W_])",
    re.I,
)

_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|[_\W]+")
#: A run of letters and digits: what the index holds of each file.  No value begins or ends within one.
RUN = re.compile(r"[^\W_]+")
_PARTS = re.compile(r"[^\W_]+|[\W_]+")
_SPACE = re.compile(r"\s")
#: What may lie between the characters of a key block, also where it is wrapped or escaped.
_WRAP = re.compile(r"\\[nr]|[\s\"'+,#*/;:-]")

_NAME = r"[A-Za-z_$][\w$.\-]*"
_QUOTED = r"""(?:"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\\n]|\\.)*`)"""
# several literals next to each other, or joined by an operator, are one value
_PIECES = rf"{_QUOTED}(?:\s*(?:\+|\.|\.\.|\\|&|\|\|)?\s*{_QUOTED})*"
ASSIGN_QUOTED = re.compile(
    rf"""(?P<q>["']?)(?P<name>{_NAME})(?P=q)\s*(?:\[\s*\]\s*)?(?::\s*(?:&(?:'\w+\s+)?)?[\w<>\[\]|?. ]{{1,40}}?\s*=|:=|=>|[:=]|\]\s*=|,)\s*(?:[\w.]+\()?\(?\s*(?P<value>{_PIECES})""", re.S
)
ASSIGN_BARE = re.compile(
    rf"""^[ \t]*(?:(?:\#|//|;|--|\*|-)+[ \t]*)?(?:export[ \t]+|set[ \t]+|ENV[ \t]+|ARG[ \t]+|-[ \t]+)?["']?(?P<name>(?://)?[\w$][\w$./:\-]*?)["']?[ \t]*(?:=|:[ \t])[ \t]*(?P<value>[^\s"'`#,;][^\s"'`,;]*)[ \t]*(?:[,;#].*)?\r?$""", re.M
)
XML_VALUE = re.compile(r"<(?P<name>[\w.:-]+)(?:\s[^<>]*)?>\s*(?P<value>[^<>\s]+)\s*</(?P=name)\s*>")
XML_ATTR = re.compile(r"""(?:name|key|id)\s*=\s*["'](?P<name>[\w.\-]+)["']\s+value\s*=\s*["'](?P<value>[^"']+)["']""")
URL_USER = re.compile(r"[a-z][a-z0-9+.-]*://(?P<user>[^\s/:@\"'`<>]*):(?P<value>[^\s/@\"'`<>]+)@", re.I)
URL_PARAM = re.compile(r"[?&;](?P<name>[\w.-]+)=(?P<value>[^\s&#\"'`<>;,)]+)")
HEADER = re.compile(r"(?P<name>(?:proxy-)?authorization|x-[\w-]*(?:key|token|secret|auth)[\w-]*|api-key|private-token|cookie)[\"'\]]*\s*[:=,]\s*[\"']?(?:(?P<scheme>bearer|basic|token|apikey)\s+)?(?P<value>[^\s\"'`<>]{6,})", re.I)
FLAG = re.compile(r"(?<!\w)--?(?P<name>[\w-]*(?:password|passwd|pass|pwd|token|secret|key|passphrase))(?:[= ]|\s+)[\"']?(?P<value>[^\s\"'`<>|;&]{5,})", re.I)
USER_FLAG = re.compile(r"(?<!\w)(?:-u|--user|--basic-auth|--credentials?|-U)[= ]\s*[\"']?(?P<user>[^\s:\"'`<>]+):(?P<value>[^\s\"'`<>]+)")
LOGIN_CALL = re.compile(rf"\b(?:login|log_in|connect|authenticate|auth|sign_in|signin|logon|set_credentials|setCredentials|basicAuth|basic_auth|with_credentials|withCredentials)\w*\s*!?\(\s*(?P<user>{_QUOTED})\s*,\s*(?P<value>{_PIECES})", re.I)
TELLING = re.compile(
    r"\b(?P<name>passwords?|passwd|passphrase|pwd?|pw|tokens?|secrets?|api[\s_-]?keys?|keys?|credentials?|creds?)\b(?P<between>[^\n\"'`:=]{0,48}?)(?:\b(?:is|was|be|ist|es|est)\b\s*:?|:|=|->)\s*[\"'`]?(?P<value>[^\s\"'`<>]{6,})", re.I
)
SPOKEN = re.compile(r"\b(?:pwd?|pw|password|passwd|passphrase)\s+[\"']?(?P<value>[^\s\"'`<>/]{6,})", re.I)
_K8S = re.compile(r"^kind:\s*Secret\b", re.M)
_K8S_DATA = re.compile(r"^data:\s*\n(?P<body>(?:[ \t]+[^\n]*\n?|[ \t]*\n)+)", re.M)
_K8S_ROW = re.compile(r"^[ \t]+(?P<name>[\w.-]+):[ \t]*[\"']?(?P<value>[A-Za-z0-9+/=_-]{8,})[\"']?[ \t]*\r?$", re.M)
_CODE = frozenset("ts tsx js jsx mjs cjs py java go rs c h cc cpp cs rb php kt swift scala".split())
_COMMENT = re.compile(r"^\s*(?://|#|\*|/\*|--|;|<!--)|(?<=\s)(?://|#|/\*)\s")
_STRINGS = re.compile(_QUOTED)


_ISSUED = ("AKIA", "ASIA", "AIza", "ghp_", "glpat-", "xox", "sk_live_")
_RUN = re.compile(r"[A-Za-z0-9_.-]{16,}")
_JOINT = re.compile(r"[\"'`]\s*(?:\+|\.|\.\.|\\)?\s*\n?\s*[\"'`](?=[\w.+/=-]{4})(?<![,:({\[=]\s[\"'`])")
_JOINED = re.compile(rf"{_QUOTED}(?:\s*(?:\+|\.|\.\.|\\)?\s*{_QUOTED})+")
# Parts of names, and openings of headers, that a telling place begins with.
_TRIGGER = re.compile(
    r"pass|pwd|pswd|\bpw\b|[_-]pw\b|Pw\b|secret|token|credential|creds?\b|clave|contraseña|kennwort|auth|bearer|cookie|jwt|api[\s_-]?key|key\b|keys\b|key[\s\"':=_]|\bsig\b|signature|salt\b|seed\b|\bpin\b|\bpat\b", re.I
)


_GOES_ON = re.compile(r"\s*(?:\+|\.|\\|&)?\s*[\"'`)]")


def _windows(content: str) -> list[tuple[int, int, int]]:
    """``(start, end, stop)`` of each line with a telling name; a value may go on until ``stop``."""
    out = []
    done = -1
    for m in _TRIGGER.finditer(content):
        if m.start() < done:
            continue
        start = content.rfind("\n", 0, m.start()) + 1
        end = content.find("\n", m.end())
        end = len(content) if end < 0 else end
        done = end
        stop = end
        # the pieces of a value may fill any number of lines
        while stop < len(content):
            nxt = content.find("\n", stop + 1)
            nxt = len(content) if nxt < 0 else nxt
            if not _GOES_ON.match(content, stop + 1, nxt):
                break
            stop = nxt
        out.append((start, end, stop))
    return out


def entropy(s: str) -> float:
    n = len(s)
    return -sum(k / n * math.log2(k / n) for k in Counter(s).values()) if n else 0.0


def mixed(v: str) -> bool:
    """Letters together with digits or symbols, or a long run of both cases."""
    letters = any(c.isalpha() for c in v)
    digits = any(c.isdigit() for c in v)
    other = any(not c.isalnum() and c not in "-_." for c in v)
    if letters and (digits or other):
        return True
    # letters alone: only where the case changes more often than in joined words
    turns = sum(a.isupper() != b.isupper() for a, b in zip(v, v[1:]))
    return len(v) >= 10 and turns >= len(v) / 4 and entropy(v) > 3.0


def stand_in(v: str) -> bool:
    return bool(STAND_IN.match(v) or STAND_IN_WORDS.search(v)) or len(set(v)) < 4


def name_class(name: str) -> int:
    """3 for a password's name, 2 for a token's, 1 for a key's, 0 for others."""
    parts = [p.lower() for p in _CAMEL.split(name) if p]
    while len(parts) > 1 and parts[-1] in ("value", "val", "str", "string", "text", "raw", "plain", "env", "var", "default", "old", "new", "prod", "dev", "test", "staging", "b64", "base64") or (parts and parts[-1].isdigit() and len(parts) > 1):
        parts.pop()
    if not parts:
        return 0
    last, before = parts[-1], parts[-2] if len(parts) > 1 else ""
    if last in PASS_WORDS:
        return 3
    if last in TOKEN_WORDS:
        return 2
    if last in KEY_WORDS:
        if before in NO_SECRET_KEYS:
            return 0
        return 2 if before in ("api", "access", "secret", "private", "auth", "signing", "encryption", "session", "client", "master", "shared", "hmac") else 1
    return 0


def plausible(v: str, cls: int) -> bool:
    """Whether a value in a place of that class can be a secret."""
    if cls <= 0 or len(v) < (6 if cls == 3 else 8) or any(c.isspace() or c in "{}" for c in v) or stand_in(v):
        return False
    if re.fullmatch(r"[\w.$]+\(.*\)?;?", v) or re.search(r"\(\)|=>|::\w|->", v):
        return False
    if cls == 3:
        return mixed(v)
    if cls == 1 and (re.fullmatch(r"[a-z]+(?:[:./][\w{}-]+)+", v) or len(v) < 9):
        return False
    return mixed(v) and any(c.isdigit() for c in v) or (len(v) >= 20 and mixed(v))


def _unquote(pieces: str) -> str:
    return "".join(re.sub(r"\\(.)", r"\1", p[1:-1]) for p in _STRINGS.findall(pieces))


def _decoded(v: str) -> str | None:
    try:
        raw = base64.b64decode(v + "=" * (-len(v) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None
    try:
        s = raw.decode("utf-8")
    except UnicodeDecodeError:
        return None
    return s if s.isprintable() else None


def find(path: str | None, content: str) -> list[tuple[int, int, str, bool]]:
    """``(start, end, value, structured)`` for each literal in a telling place or of a telling form."""
    out: dict[int, tuple[int, int, str, bool]] = {}
    if len(content) < 8:
        return []
    ext = (path or "").rsplit("/", 1)[-1].rsplit(".", 1)[-1].lower()
    code = ext in _CODE

    def add(start: int, end: int, value: str, structured: bool = False) -> None:
        have = out.get(start)
        if have is None or have[1] < end:
            out[start] = (start, end, value, structured or bool(have and have[3]))

    blocks: list[tuple[int, int]] = []
    for m in PEM.finditer(content):
        body = _WRAP.sub("", m["body"])
        if len(set(body)) > 12 and len(body) >= 40 and not re.search(r"\.\.\.|…|<|\$\{|\{\{", m["body"]):
            add(m.start(), m.end(), body, True)
        blocks.append((m.start(), m.end()))
    inside = lambda at: any(a <= at < b for a, b in blocks)

    for run in _RUN.finditer(content):
        for m in FORMS.finditer(content, max(0, run.start() - 1), run.end() + 1):
            v = m[0]
            tail = v.split("_")[-1] if "_" in v else v
            if stand_in(v) or stand_in(tail) or entropy(tail) <= 2.6 or not (any(c.isdigit() for c in v) or v.startswith(_ISSUED)):
                continue
            if re.match(r"[a-z]{2,6}_", v) and not re.match(r"gh[pousr]_|[srp]k_|npm_|hf_", v) and (tail.islower() or tail.isupper() or re.fullmatch(r"[0-9a-f]+", tail)):
                continue
            add(m.start(), m.end(), v, True)

    # a value in pieces, whatever its name, that joins to an issued form
    if _JOINT.search(content):
        for m in _JOINED.finditer(content):
            v = _unquote(m[0])
            if FORMS.fullmatch(v) and not stand_in(v) and (any(c.isdigit() for c in v) or v.startswith(_ISSUED)):
                add(m.start() + 1, m.end() - 1, v, True)

    for m in URL_USER.finditer(content) if "://" in content else ():
        if plausible(m["value"], 3):
            add(m.start("value"), m.end("value"), m["value"])
    for m in USER_FLAG.finditer(content):
        if plausible(m["value"], 3):
            add(m.start("value"), m.end("value"), m["value"])
    for m in LOGIN_CALL.finditer(content):
        v = _unquote(m["value"])
        if plausible(v, 3):
            add(m.start("value") + 1, m.end("value") - 1, v)

    k8s = _K8S.search(content) is not None
    if k8s:
        for block in _K8S_DATA.finditer(content):
            for m in _K8S_ROW.finditer(block["body"]):
                d = _decoded(m["value"])
                if name_class(m["name"]) and (d is None or (plausible(d, 3) and not stand_in(d))) and not stand_in(m["value"]):
                    at = block.start("body") + m.start("value")
                    add(at, at + len(m["value"]), m["value"], True)

    # the places that a telling name opens: only the lines that hold one, with what follows them
    for start, end, stop in _windows(content):
        for m in ASSIGN_QUOTED.finditer(content, start, stop):
            if m.start() >= end:
                break
            cls = name_class(m["name"])
            if not cls or inside(m.start("value")):
                continue
            v = _unquote(m["value"])
            if "://" in v or "-----BEGIN" in v:
                continue
            scheme = re.match(r"(?i)(bearer|basic|token)\s+(.*)$", v)
            v = scheme[2] if scheme else v
            sep = content[m.end("name"):m.start("value")]
            if "," in sep and "=" not in sep and ":" not in sep and cls < 2:
                continue
            if plausible(v, cls):
                add(m.start("value") + 1, m.end("value") - 1, v, len(_STRINGS.findall(m["value"])) > 1)
        line = content[start:end]
        for rx, least in ((XML_VALUE, 0), (XML_ATTR, 0), (URL_PARAM, 0), (FLAG, 2)):
            for m in rx.finditer(line):
                cls = max(least, name_class(m["name"]))
                if cls and plausible(m["value"], cls):
                    add(start + m.start("value"), start + m.end("value"), m["value"])
        for m in HEADER.finditer(line):
            v = m["value"].rstrip("),;")
            at = start + m.start("value")
            if (m["scheme"] or "").lower() == "basic":
                d = _decoded(v)
                if d and ":" in d and plausible(d.split(":", 1)[1], 3):
                    add(at, at + len(v), v, True)
            elif plausible(v, 2):
                add(at, at + len(v), v)
        if not code:
            for m in ASSIGN_BARE.finditer(line):
                v = m["value"].rstrip("\r")
                cls = name_class(m["name"])
                if cls and "://" not in v and plausible(v, cls) and not inside(start + m.start("value")):
                    if not (k8s and re.fullmatch(r"[A-Za-z0-9+/=]{8,}", v)):
                        add(start + m.start("value"), start + m.start("value") + len(v), v)
        # prose and comments that tell a secret
        comment = _COMMENT.search(line)
        for m in TELLING.finditer(line):
            if inside(start + m.start("value")) or (code and not (comment and comment.start() <= m.start())):
                continue
            v = m["value"].rstrip(".,;)\r")
            if len(m["between"].split()) > 6 or "://" in v or "=" in v.rstrip("=") or v.count("(") or re.match(r"[\w.]+\[", v):
                continue
            cls = 3 if m["name"].lower().startswith(("pass", "pw", "cred", "secret")) else 2
            if plausible(v, cls) and any(c.isdigit() for c in v):
                add(start + m.start("value"), start + m.start("value") + len(v), v)
        for m in SPOKEN.finditer(line):
            v = m["value"].rstrip(".,;)\r")
            if (not code or (comment and comment.start() <= m.start())) and any(c.isdigit() for c in v) and plausible(v, 3):
                add(start + m.start("value"), start + m.start("value") + len(v), v)
    return list(out.values())


def runs(text: str) -> set[str]:
    """All runs of a text, and all pairs of neighbours with what joins them, if that holds no white space."""
    parts = _PARTS.findall(text)
    if parts and not parts[0][0].isalnum():
        del parts[0]
    own, seps = parts[::2], parts[1::2]
    joined = {x for x in set(seps) if not _SPACE.search(x)}
    return {"", *own, *(a + x + b for a, x, b in zip(own, seps, own[1:]) if x in joined)}


def anchors(value: str) -> list[str]:
    """What the index is asked for: the longest pair or run of a value, which any file with the value has too."""
    return [max(sorted(runs(value)), key=len)]


def block_anchors(block: str) -> list[str]:
    """Runs of a key block; as lines may be wrapped elsewhere, one of them in a file is enough."""
    own = set(RUN.findall(re.sub(r"-----[^-]*-----|\\[nr]", " ", block)))
    return sorted(x for x in own if len(x) >= 6) or sorted(own)


def recurrences(content: str, values: list[str], blocks: list[str]) -> list[tuple[int, int, str]]:
    """``(start, end, value)`` of each place of a value, and of the body of a key block outside such blocks."""
    out = []
    if values:
        a = ahocorasick.Automaton()
        for v in values:
            a.add_word(v, v)
        a.make_automaton()
        for end, v in a.iter(content):
            s = end - len(v) + 1
            left, right = content[s - 1:s], content[end + 1:end + 2]
            if (left.isalnum() and v[0].isalnum()) or (right.isalnum() and v[-1].isalnum()):
                continue
            out.append((s, end + 1, v))
    if blocks:
        known = [m.span() for m in PEM.finditer(content)]
        at, last = [], 0
        for m in _WRAP.finditer(content):
            at.extend(range(last, m.start()))
            last = m.end()
        at.extend(range(last, len(content)))
        bare = "".join(content[i] for i in at)
        for v in blocks:
            k = bare.find(v)
            while k >= 0:
                s, e = at[k], at[k + len(v) - 1] + 1
                if not any(x <= s < y for x, y in known):
                    out.append((s, e, v))
                k = bare.find(v, k + len(v))
    return out


def _hash(v: str) -> int:
    return xxhash.xxh32_intdigest(v) - (1 << 31)


def _index(files: DataFrame) -> DataFrame:
    kind = "struct<hits:array<struct<s:int,e:int,line:int,value:string,sure:boolean,block:boolean,keys:array<int>>>,runs:array<int>>"

    @F.pandas_udf(kind)
    def scan(paths: pd.Series, contents: pd.Series) -> pd.DataFrame:
        hits, keys_of = [], []
        for p, c in zip(paths, contents):
            if not isinstance(c, str):
                hits.append([])
                keys_of.append([])
                continue
            rows = []
            for s, e, v, sure in find(p if isinstance(p, str) else None, c):
                block = PEM.match(c, s) is not None
                keys = block_anchors(c[s:e]) if block else anchors(v)
                rows.append({"s": s, "e": e, "line": c.count("\n", 0, s) + 1, "value": v, "sure": sure, "block": block, "keys": [_hash(x) for x in keys]})
            hits.append(rows)
            keys_of.append([_hash(x) for x in runs(c)])
        return pd.DataFrame({"hits": hits, "runs": keys_of})

    return files.withColumn("x", scan("file_path", "content"))


def _files(nodes: DataFrame) -> DataFrame:
    every = [c for c in nodes.columns if c != "id"]
    ours = nodes.where((F.col("kind") == "File") & F.col("id").isNotNull())
    rank = F.struct(filled(every).alias("n"), F.xxhash64(*[F.col(f"`{c}`") for c in every if c != "content"]).alias("h"))
    owner = F.coalesce("repo_uri", F.element_at(F.split("file_path", "/"), 1), F.lit(""))
    return spread(ours.select("id", "file_path", "content", owner.alias("owner"), rank.alias("rank")))


#: Bits of the maps that tell which runs, and which files, can matter: of one size whatever the corpus.
MAP_BITS = 1 << 26


def _map_of(hashes: DataFrame, column: str) -> np.ndarray:
    """One bit per hash, folded to ``MAP_BITS``: the driver gets at most ``MAP_BITS / 64`` numbers, never the hashes."""
    at = F.pmod(F.col(column).cast("long"), F.lit(MAP_BITS))
    words = hashes.select(F.shiftright(at, 6).cast("int").alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int")).alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).collect()
    out = np.zeros(MAP_BITS // 64, dtype=np.int64)
    for r in words:
        out[r["w"]] = r["b"]
    return out


def _in_map(hashes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    at = np.mod(hashes.astype(np.int64), MAP_BITS)
    return (bits[at >> 6] >> (at & 63)) & 1 == 1


def secret_places(nodes: DataFrame) -> DataFrame:
    """``node_id, start, end, line_no, value``: each place of a secret value, as offsets into the content.

    Lines count from 1 and end at LF.  A key block is placed at its opening line, a value in several
    pieces at the first.  Nodes without an id, of other kinds, or without content have no secrets; of
    repeated ids the row with more non-null fields counts.

    The index is written once and its runs enter no exchange but for those that a bit map of the confirmed
    values lets through, so a word that all files share never is a key of a join.
    """
    files = _files(nodes)
    spark = nodes.sparkSession
    st = Staging(spark, "secrets")
    seen = st.cut(_index(files).select("id", "rank", "owner", F.col("x.hits").alias("hits"), F.col("x.runs").alias("runs")), "index")
    best = seen.groupBy("id").agg(F.max("rank").alias("rank"))

    told = seen.select("id", "rank", "owner", F.explode("hits").alias("h")).join(best, ["id", "rank"]).select("id", "owner", "h.*")
    # values leave each task once per owner, so a placeholder that fills the corpus is no hot key
    owners = told.groupBy("value", "owner").agg(F.max(F.struct("block", "keys")).alias("k"), F.bool_or("sure").alias("sure")).groupBy("value").agg(
        F.count(F.lit(1)).alias("n_owners"), F.max("k").alias("k"), F.bool_or("sure").alias("sure")
    )
    n_all = seen.select("owner").distinct().count()
    bar = F.greatest(F.lit(LEAST_OWNERS), F.when(F.col("sure"), F.lit(SHARED_STRUCTURED)).otherwise(F.lit(SHARED)) * F.lit(n_all))
    confirmed = st.cut(owners.where(F.col("n_owners") < bar).select("value", "k.block", "k.keys"), "confirmed")
    first = told.join(confirmed.select("value"), "value").select("id", F.col("s").alias("start"), F.col("e").alias("end"), F.col("line").alias("line_no"), "value")

    # where the index has a run of a confirmed value in a file, the file is scanned for the value
    wanted = confirmed.select(F.struct("value", "block").alias("v"), F.explode("keys").alias("hv"))
    run_map = spark.sparkContext.broadcast(_map_of(wanted, "hv"))

    @F.pandas_udf("array<int>")
    def asked(runs_: pd.Series) -> pd.Series:
        return runs_.map(lambda r: r[_in_map(r, run_map.value)] if r is not None and len(r) else [])

    shown = seen.select("id", "rank", F.explode(asked("runs")).alias("hv"))
    held = st.cut(shown.join(wanted, "hv").join(best, ["id", "rank"]).groupBy("id").agg(F.collect_set("v").alias("values")), "held")
    key = F.xxhash64("id")
    id_map = spark.sparkContext.broadcast(_map_of(held.select(key.alias("k")), "k"))

    @F.pandas_udf("boolean")
    def holds(keys: pd.Series) -> pd.Series:
        return pd.Series(_in_map(keys.to_numpy(), id_map.value))

    # of the texts only those leave the scan that hold a value, and the few whose bit another file set
    again = files.where(F.col("content").isNotNull()).where(holds(key)).join(held, "id")

    @F.pandas_udf("array<struct<s:int,e:int,line:int,value:string>>")
    def rescan(contents: pd.Series, values: pd.Series) -> pd.Series:
        out = []
        for c, vs in zip(contents, values):
            found = recurrences(c, [x["value"] for x in vs if not x["block"]], [x["value"] for x in vs if x["block"]])
            out.append([{"s": s, "e": e, "line": c.count("\n", 0, s) + 1, "value": v} for s, e, v in found])
        return pd.Series(out)

    second = again.select("id", "rank", rescan("content", "values").alias("h")).join(best, ["id", "rank"])
    second = second.select("id", F.explode("h").alias("h")).select("id", F.col("h.s").alias("start"), F.col("h.e").alias("end"), F.col("h.line").alias("line_no"), "h.value")
    both = first.unionByName(second).groupBy("id", "start", "line_no").agg(F.max(F.struct("end", "value")).alias("m"))
    return both.select(F.col("id").alias("node_id"), "start", "m.end", "line_no", "m.value")


def secret_lines(nodes: DataFrame) -> DataFrame:
    """``node_id, line_no`` of each line on which a secret value begins."""
    return secret_places(nodes).select("node_id", "line_no").distinct()


def redacted(nodes: DataFrame) -> DataFrame:
    """``node_id, n_secrets, content``: the content of each file that holds secrets, with only their values masked.

    Line breaks, quotes and joining operators inside a value stay, so the code around it still parses.
    """
    places = secret_places(nodes).groupBy(F.col("node_id").alias("id")).agg(F.collect_list(F.struct("start", "end")).alias("places"))
    files = _files(nodes).where(F.col("content").isNotNull())

    @F.pandas_udf("string")
    def mask(contents: pd.Series, places_: pd.Series) -> pd.Series:
        return pd.Series([redact(c, [(p["start"], p["end"]) for p in ps]) for c, ps in zip(contents, places_)])

    done = files.join(places, "id").select("id", "rank", F.size("places").alias("n"), mask("content", "places").alias("content"))
    return done.groupBy("id").agg(F.max_by(F.struct("n", "content"), "rank").alias("b")).select(
        F.col("id").alias("node_id"), F.col("b.n").alias("n_secrets"), "b.content"
    )


_KEEP = re.compile(r"-----[A-Z ]+-----|\\[nr]|[\"'`]\s*(?:\+|\.|\.\.|\\|&|\|\|)?\s*[\"'`]|\n[ \t]*(?:[#*/;-]+[ \t]+)?")


def redact(content: str, places: list[tuple[int, int]]) -> str:
    """Masks the given stretches; markers of key blocks, line breaks and joints of pieces stay."""
    out, at = [], 0
    for s, e in sorted(places):
        if s < at:
            s = at
        if e <= s:
            continue
        out.append(content[at:s])
        body, i, first = content[s:e], 0, True
        for m in _KEEP.finditer(body):
            if m.start() > i:
                out.append(MASK if first else "")
                first = False
            out.append(m[0])
            i = m.end()
        if i < len(body):
            out.append(MASK if first else "")
        at = e
    out.append(content[at:])
    return "".join(out)
