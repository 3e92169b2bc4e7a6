"""Texts of known shapes to objects."""

from __future__ import annotations

import re
import urllib.parse

from docsluice.functions import values
from docsluice.lang.values import Raised, described


def need(v, name):
    if not isinstance(v, str):
        raise Raised(f"{name} needs a string, not {described(v)}")
    return v


@values("parse_url")
def _(v):
    m = re.fullmatch(r"([A-Za-z][A-Za-z0-9+.-]*):(?://(?:([^/?#@]*)@)?(\[[^\]]*\]|[^/?#:]*)(?::(\d*))?)?([^?#]*)(?:\?([^#]*))?(?:#(.*))?", need(v, "parse_url"))
    if not m:
        raise Raised(f"{described(v)} is not a URL")
    user, _, password = (m[2] or "").partition(":")
    return {"scheme": m[1].lower(), "username": user or None, "password": password or None, "host": m[3], "port": int(m[4]) if m[4] else None, "path": m[5], "query": m[6], "fragment": m[7]}


@values("parse_query_string")
def _(v):
    out: dict = {}
    for k, x in urllib.parse.parse_qsl(need(v, "parse_query_string").removeprefix("?"), keep_blank_values=True):
        out[k] = x if k not in out else [*(out[k] if isinstance(out[k], list) else [out[k]]), x]
    return out


@values("parse_logfmt")
def _(v):
    out = {}
    for m in re.finditer(r'([^\s="]+)(?:=(?:"((?:[^"\\]|\\.)*)"|(\S*)))?', need(v, "parse_logfmt")):
        out[m[1]] = re.sub(r"\\(.)", lambda e: {"n": "\n", "t": "\t"}.get(e[1], e[1]), m[2]) if m[2] is not None else m[3] if m[3] is not None else True
    return out


# fixed values: names of RFC 5424
FACILITIES = ("kern", "user", "mail", "daemon", "auth", "syslog", "lpr", "news", "uucp", "cron", "authpriv", "ftp", "ntp", "audit", "alert", "clock", "local0", "local1", "local2", "local3", "local4", "local5", "local6", "local7")
SEVERITIES = ("emerg", "alert", "crit", "err", "warning", "notice", "info", "debug")


@values("parse_syslog")
def _(v):
    m = re.match(r"<(\d{1,3})>(\d )?", need(v, "parse_syslog"))
    if not m or int(m[1]) > 191:
        raise Raised(f"{described(v)} is not a syslog message")
    priority, rest = int(m[1]), v[m.end() :]
    out = {"priority": priority, "facility": FACILITIES[priority >> 3], "severity": SEVERITIES[priority & 7]}
    nil = lambda x: None if x == "-" else x
    if m[2]:
        f = re.match(r"(\S+) (\S+) (\S+) (\S+) (\S+) (-|(?:\[(?:[^\]\\]|\\.)*\])+)(?: (.*))?$", rest, re.S)
        if not f:
            raise Raised(f"{described(v)} is not a syslog message")
        return out | {"version": int(m[2]), "timestamp": nil(f[1]), "hostname": nil(f[2]), "app_name": nil(f[3]), "proc_id": nil(f[4]), "msg_id": nil(f[5]), "structured_data": nil(f[6]), "message": f[7]}
    f = re.match(r"([A-Z][a-z]{2} [ \d]\d \d\d:\d\d:\d\d) (\S+) ([^:\[\s]+)(?:\[(\d+)\])?: ?(.*)$", rest, re.S)
    if not f:
        return out | {"message": rest}
    return out | {"timestamp": f[1], "hostname": f[2], "app_name": f[3], "proc_id": f[4], "message": f[5]}


@values("parse_user_agent")
def _(v):
    need(v, "parse_user_agent")
    browser, version = next(((n, m[1]) for n, p in (("Edge", r"Edg(?:e|A|iOS)?/([\d.]+)"), ("Opera", r"OPR/([\d.]+)"), ("Firefox", r"Firefox/([\d.]+)"), ("Chrome", r"(?:Chrome|CriOS)/([\d.]+)"), ("Safari", r"Version/([\d.]+).*Safari"), ("curl", r"^curl/([\d.]+)")) if (m := re.search(p, v))), (None, None))
    os = next((n for n, p in (("Windows", "Windows"), ("Android", "Android"), ("iOS", "iPhone|iPad"), ("macOS", "Mac OS X"), ("Linux", "Linux")) if re.search(p, v)), None)
    device = "bot" if re.search(r"bot|crawl|spider", v, re.I) else "mobile" if re.search(r"Mobile|Android|iPhone", v) else "tablet" if "iPad" in v else "desktop"
    return {"browser": browser, "version": version, "os": os, "device": device}


# fixed values: common grok patterns
GROK = {
    "WORD": r"\b\w+\b", "NOTSPACE": r"\S+", "SPACE": r"\s*", "DATA": r".*?", "GREEDYDATA": r".*", "INT": r"[+-]?\d+", "NUMBER": r"[+-]?\d+(?:\.\d+)?", "POSINT": r"[1-9]\d*",
    "IPV4": r"(?:\d{1,3}\.){3}\d{1,3}", "IP": r"(?:(?:\d{1,3}\.){3}\d{1,3}|[0-9A-Fa-f:]+:[0-9A-Fa-f:]*)", "HOSTNAME": r"[A-Za-z0-9][A-Za-z0-9.-]*", "USERNAME": r"[A-Za-z0-9._-]+", "USER": r"[A-Za-z0-9._-]+",
    "UUID": r"[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}", "LOGLEVEL": r"(?:TRACE|DEBUG|INFO|NOTICE|WARN(?:ING)?|ERR(?:OR)?|CRIT(?:ICAL)?|FATAL|ALERT|EMERG)", "QS": r'"(?:[^"\\]|\\.)*"', "QUOTEDSTRING": r'"(?:[^"\\]|\\.)*"',
    "TIMESTAMP_ISO8601": r"\d{4}-\d\d-\d\d[T ]\d\d:\d\d(?::\d\d(?:\.\d+)?)?(?:Z|[+-]\d\d:?\d\d)?", "HTTPDATE": r"\d\d/\w{3}/\d{4}:\d\d:\d\d:\d\d [+-]\d{4}", "PATH": r"/\S*", "URIPATH": r"/[^\s?#]*", "EMAILADDRESS": r"[\w.+-]+@[\w-]+\.[\w.]+",
}


@values("parse_grok", arity=1)
def _(v, pattern):
    kinds = {}

    def expand(m):
        base, name, as_ = m[1], m[2], m[3]
        if base not in GROK:
            raise Raised(f"no grok pattern {base}")
        if name is None:
            return f"(?:{GROK[base]})"
        kinds[f"g{len(kinds)}"] = (name, as_)
        return f"(?P<g{len(kinds) - 1}>{GROK[base]})"

    m = re.search(re.sub(r"%\{(\w+)(?::([\w.\[\]@-]+))?(?::(\w+))?\}", expand, pattern), need(v, "parse_grok"))
    if not m:
        return None
    cast = {"int": int, "float": float, None: str}
    return {name: None if m[g] is None else cast.get(as_, str)(m[g]) for g, (name, as_) in kinds.items()}
