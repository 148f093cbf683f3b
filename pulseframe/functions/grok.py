"""Grok patterns, compiled once to a Java regular expression and run by Spark."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseframe.functions.text import all_lines, is_regex

# Publicly documented grok pattern names and their usual meaning.
PATTERNS = {
    "USERNAME": r"[a-zA-Z0-9._-]+",
    "USER": r"%{USERNAME}",
    "EMAILLOCALPART": r"[a-zA-Z][a-zA-Z0-9_.+\-=:]*",
    "EMAILADDRESS": r"%{EMAILLOCALPART}@%{HOSTNAME}",
    "INT": r"[+-]?[0-9]+",
    "BASE10NUM": r"[+-]?(?:[0-9]+(?:\.[0-9]+)?|\.[0-9]+)",
    "NUMBER": r"%{BASE10NUM}",
    "BASE16NUM": r"[+-]?(?:0x)?[0-9A-Fa-f]+",
    "POSINT": r"\b[1-9][0-9]*\b",
    "NONNEGINT": r"\b[0-9]+\b",
    "WORD": r"\b\w+\b",
    "NOTSPACE": r"\S+",
    "SPACE": r"\s*",
    "DATA": r".*?",
    "GREEDYDATA": r".*",
    "QUOTEDSTRING": r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'",
    "QS": r"%{QUOTEDSTRING}",
    "UUID": r"[A-Fa-f0-9]{8}-(?:[A-Fa-f0-9]{4}-){3}[A-Fa-f0-9]{12}",
    "MAC": r"(?:[A-Fa-f0-9]{2}[:-]){5}[A-Fa-f0-9]{2}|(?:[A-Fa-f0-9]{4}\.){2}[A-Fa-f0-9]{4}",
    "IPV4": r"(?<![0-9])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?![0-9])",
    "IPV6": r"(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,7}:(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?|::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?",
    "IP": r"%{IPV6}|%{IPV4}",
    "HOSTNAME": r"\b[0-9A-Za-z][0-9A-Za-z-]{0,62}(?:\.[0-9A-Za-z][0-9A-Za-z-]{0,62})*\.?(?:\b|$)",
    "HOST": r"%{HOSTNAME}",
    "IPORHOST": r"%{IP}|%{HOSTNAME}",
    "HOSTPORT": r"%{IPORHOST}:%{POSINT}",
    "UNIXPATH": r"(?:/[\w%!$@:.,~+-]*)+",
    "WINPATH": r"(?:[A-Za-z]+:|\\)(?:\\[^\\?*]*)+",
    "PATH": r"%{UNIXPATH}|%{WINPATH}",
    "URIPROTO": r"[A-Za-z]+(?:\+[A-Za-z+]+)?",
    "URIHOST": r"%{IPORHOST}(?::%{POSINT:port})?",
    "URIPATH": r"(?:/[A-Za-z0-9$.+!*'(){},~:;=@#%&_\-]*)+",
    "URIPARAM": r"\?[A-Za-z0-9$.+!*'|(){},~@#%&/=:;_?\-\[\]<>]*",
    "URIPATHPARAM": r"%{URIPATH}(?:%{URIPARAM})?",
    "URI": r"%{URIPROTO}://(?:%{USER}(?::[^@]*)?@)?(?:%{URIHOST})?(?:%{URIPATHPARAM})?",
    "MONTH": r"\b(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|June?|July?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)\b",
    "MONTHNUM": r"0?[1-9]|1[0-2]",
    "MONTHDAY": r"(?:0[1-9])|(?:[12][0-9])|(?:3[01])|[1-9]",
    "DAY": r"(?:Mon(?:day)?|Tue(?:sday)?|Wed(?:nesday)?|Thu(?:rsday)?|Fri(?:day)?|Sat(?:urday)?|Sun(?:day)?)",
    "YEAR": r"(?:\d\d){1,2}",
    "HOUR": r"2[0123]|[01]?[0-9]",
    "MINUTE": r"[0-5][0-9]",
    "SECOND": r"(?:[0-5]?[0-9]|60)(?:[:.,][0-9]+)?",
    "TIME": r"%{HOUR}:%{MINUTE}(?::%{SECOND})?",
    "DATE_US": r"%{MONTHNUM}[/-]%{MONTHDAY}[/-]%{YEAR}",
    "DATE_EU": r"%{MONTHDAY}[./-]%{MONTHNUM}[./-]%{YEAR}",
    "DATE": r"%{DATE_US}|%{DATE_EU}",
    "ISO8601_TIMEZONE": r"Z|[+-]%{HOUR}(?::?%{MINUTE})?",
    "TIMESTAMP_ISO8601": r"%{YEAR}-%{MONTHNUM}-%{MONTHDAY}[T ]%{HOUR}:?%{MINUTE}(?::?%{SECOND})?(?:%{ISO8601_TIMEZONE})?",
    "TZ": r"[A-Z]{3}",
    "SYSLOGTIMESTAMP": r"%{MONTH} +%{MONTHDAY} %{TIME}",
    "PROG": r"[\w._/%-]+",
    "SYSLOGPROG": r"%{PROG:program}(?:\[%{POSINT:pid}\])?",
    "SYSLOGHOST": r"%{IPORHOST}",
    "SYSLOGFACILITY": r"<%{NONNEGINT:facility}\.%{NONNEGINT:priority}>",
    "SYSLOGBASE": r"%{SYSLOGTIMESTAMP:timestamp} (?:%{SYSLOGFACILITY} )?%{SYSLOGHOST:logsource} %{SYSLOGPROG}:",
    "HTTPDATE": r"%{MONTHDAY}/%{MONTH}/%{YEAR}:%{TIME} %{INT}",
    "LOGLEVEL": r"(?i:alert|trace|debug|notice|info(?:rmation)?|warn(?:ing)?|err(?:or)?|crit(?:ical)?|fatal|severe|emerg(?:ency)?)",
    "COMMONAPACHELOG": r"%{IPORHOST:clientip} %{USER:ident} %{USER:auth} \[%{HTTPDATE:timestamp}\] \"(?:%{WORD:verb} %{NOTSPACE:request}(?: HTTP/%{NUMBER:httpversion})?|%{DATA:rawrequest})\" %{NUMBER:response} (?:%{NUMBER:bytes}|-)",
    "COMBINEDAPACHELOG": r"%{COMMONAPACHELOG} %{QS:referrer} %{QS:agent}",
}

_REFERENCE = re.compile(r"%\{(\w+)(?::([^}:]+))?(?::[^}]*)?\}")
_GROUP_OR_SKIPPED = re.compile(r"\\.|\[(?:\\.|[^\]\\])*\]|\((?!\?)")


class Grok:
    """A pattern compiled with the default patterns and the user's own."""

    def __init__(self, pattern: str, extra: dict[str, str] | None = None):
        self._known = PATTERNS | (extra or {})
        self.fields: dict[str, int] = {}
        self._groups = 0
        self.regex = self._expand(pattern, ())

    def _literal(self, text: str) -> str:
        self._groups += sum(1 for m in _GROUP_OR_SKIPPED.finditer(text) if m.group() == "(")
        return text

    def _expand(self, pattern: str, inside: tuple[str, ...]) -> str:
        out, at = [], 0
        for ref in _REFERENCE.finditer(pattern):
            out.append(self._literal(pattern[at:ref.start()]))
            name, alias = ref.group(1), ref.group(2)
            if name not in self._known or name in inside:
                raise ValueError(f"unknown or circular grok pattern {name!r}")
            self._groups += 1
            self.fields[alias or name] = self._groups
            out.append(f"({self._expand(self._known[name], (*inside, name))})")
            at = ref.end()
        out.append(self._literal(pattern[at:]))
        return "".join(out)

    def field(self, text: Column, name: str) -> Column:
        """One capture; NULL where the text does not match or the capture is empty."""
        return F.nullif(F.regexp_extract(text, self.regex, self.fields[name]), F.lit(""))

    def matches(self, text: Column) -> Column:
        return F.coalesce(text.rlike(self.regex), F.lit(False))

    def captures(self, text: Column, names: list[str] | None = None) -> Column:
        """Map of the captures that are not empty."""
        entries = [
            F.struct(F.lit(n).alias("k"), F.regexp_extract(text, self.regex, self.fields[n]).alias("v")) for n in names or self.fields
        ]
        return F.map_from_entries(F.filter(F.array(*entries), lambda e: e["v"] != ""))

    def is_match(self, text: Column) -> Column:
        """True where the text matches and no capture is empty."""
        full = self.matches(text)
        for name in self.fields:
            full = full & self.field(text, name).isNotNull()
        return full


def compile_or_none(pattern: str, extra: dict[str, str] | None = None) -> Grok | None:
    try:
        grok = Grok(pattern, extra)
    except ValueError:
        return None
    return grok if is_regex(grok.regex) else None


def named_fields(pattern: str) -> list[str]:
    """Fields that a pattern itself names, whether or not it can be compiled."""
    return list(dict.fromkeys(ref.group(2) or ref.group(1) for ref in _REFERENCE.finditer(pattern)))


def grok_extract(df: DataFrame, text: str, pattern: str, names: list[str] | None = None, extra: dict[str, str] | None = None) -> DataFrame:
    """Rows that match, with one column per capture; a pattern that cannot be compiled matches nothing.

    The columns are ``names``, or the fields of the pattern: the same ones for a pattern that cannot be compiled.
    """
    grok = compile_or_none(pattern, extra)
    if grok is None:
        return df.limit(0).withColumns({n: F.lit(None).cast("string") for n in names or named_fields(pattern)})
    return df.where(grok.matches(F.col(text))).withColumns({n: grok.field(F.col(text), n) for n in names or grok.fields})


def grok_coverage(df: DataFrame, text: str, patterns: dict[str, str], extra: dict[str, str] | None = None) -> DataFrame:
    """How many texts each pattern matches, all patterns in one pass."""
    compiled = {label: compile_or_none(p, extra) for label, p in patterns.items()}
    counts = [
        F.struct(
            F.lit(label).alias("pattern"),
            (F.lit(0).cast("bigint") if g is None else F.count_if(g.matches(F.col(text)))).alias("matched"),
            F.count("*").alias("total"),
        )
        for label, g in compiled.items()
    ]
    return df.agg(F.array(*counts).alias("c")).select(F.inline("c"))


def grok_lines(df: DataFrame, text: str, pattern: str, keep: list[str], names: list[str] | None = None, extra: dict[str, str] | None = None) -> DataFrame:
    """The captures of every line of a text, empty lines included; no lines for a pattern that cannot be compiled."""
    grok = compile_or_none(pattern, extra)
    exploded = df.select(*keep, F.posexplode(all_lines(F.col(text))).alias("line_no", "line"))
    if grok is None:
        return exploded.limit(0).withColumn("captures", F.lit(None).cast("map<string,string>"))
    return exploded.withColumn("captures", grok.captures(F.col("line"), names))
