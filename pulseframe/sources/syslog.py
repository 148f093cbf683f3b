"""Syslog lines (RFC 5424, RFC 3164 and the bracketed ASL form) as typed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseframe.model import LOG_CONTENT, GatewayConfig, stable_id, telemetry
from pulseframe.sources.prometheus import last_wins

# Facility numbers of the names the ASL form uses.
FACILITIES = {
    "kern": 0, "user": 1, "mail": 2, "daemon": 3, "auth": 4, "security": 4, "syslog": 5, "lpr": 6, "news": 7,
    "uucp": 8, "cron": 9, "authpriv": 10, "ftp": 11, "netinfo": 12, "remoteauth": 13, "install": 14,
    "local0": 16, "local1": 17, "local2": 18, "local3": 19, "local4": 20, "local5": 21, "local6": 22, "local7": 23,
    "launchd": 24,
}

_RFC5424 = r"^<\d{1,3}>1(?: +\S+){5} +(?:-|\[[^\]]*\])"
_REST = r"(?s)^(?:- ?|\[[^\]]*\])(.*)$"
_RFC3164 = r"(?s)^<(\d{1,3})>((Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) [ \d]\d \d\d:\d\d:\d\d) +(\S+) *(.*)$"
_ASL = r"(?s)^ *\d+ +\[\S+ [^\]]*\]"
_ASL_PAIR = r"\[(\S+) ([^\]]*)\]"


def _micros(text: Column, pattern: str | None = None) -> Column:
    parsed = F.try_to_timestamp(text, F.lit(pattern)) if pattern else F.try_to_timestamp(text)
    return F.unix_micros(parsed.cast("timestamp"))


def parse_syslog(df: DataFrame, year: int, line: str = "line") -> DataFrame:
    """Adds the parsed fields, NULL where a line has none, and ``format``.

    ``format`` is ``rejected`` for lines of no known form. RFC 3164 lines carry no
    year and no zone: the year is an argument and the session zone applies.
    """
    raw = F.col(line)
    form = (
        F.when(raw.rlike(_RFC5424), "rfc5424").when(raw.rlike(_RFC3164), "rfc3164")
        .when(~raw.contains("<") & raw.rlike(_ASL), "asl").otherwise("rejected")
    )
    named = df.withColumn("format", form).withColumn(
        "__pri", F.when(F.col("format").isin("rfc5424", "rfc3164"), F.regexp_extract(raw, r"^<(\d{1,3})>", 1).cast("int"))
    )
    pairs = last_wins(F.regexp_extract_all(raw, F.lit(_ASL_PAIR), F.lit(1)), F.regexp_extract_all(raw, F.lit(_ASL_PAIR), F.lit(2)))
    named = named.withColumns({
        "__asl": F.when(F.col("format") == "asl", pairs),
        # The header of an RFC 5424 line is seven parts; one split is cheaper than a match per field.
        "__new": F.when(F.col("format") == "rfc5424", F.split(raw, " +", 7)),
    })
    asl = lambda k: F.try_element_at("__asl", F.lit(k))
    is_new, is_bsd = F.col("format") == "rfc5424", F.col("format") == "rfc3164"
    new = lambda i: F.nullif(F.get("__new", F.lit(i)), F.lit("-"))
    bsd = lambda i: F.regexp_extract(raw, _RFC3164, i)
    facility_names = F.create_map(*[F.lit(x) for pair in FACILITIES.items() for x in pair])
    asl_ns = F.coalesce(asl("Time").try_cast("bigint"), F.lit(0)) * F.lit(1_000_000_000) + F.coalesce(
        asl("TimeNanoSec").try_cast("bigint"), F.lit(0)
    )
    bsd_time = F.concat(F.lit(f"{year} "), F.regexp_replace(bsd(2), " +", " "))
    parsed = named.select(
        *df.columns, "format",
        F.coalesce(F.floor(F.col("__pri") / 8), F.try_element_at(facility_names, asl("Facility")), F.when(F.col("format") == "asl", F.lit(1))).cast("int").alias("facility"),
        F.coalesce(F.pmod("__pri", F.lit(8)), asl("Level").try_cast("int"), F.when(F.col("format") == "asl", F.lit(7))).cast("int").alias("severity"),
        F.when(is_new, 1).when(F.col("format") != "rejected", 0).cast("int").alias("version"),
        F.when(is_new, _micros(new(1)) * 1000).when(is_bsd, _micros(bsd_time, "yyyy MMM d HH:mm:ss") * 1000)
        .when(F.col("format") == "asl", asl_ns).alias("event_ns"),
        F.when(is_new, new(2)).when(is_bsd, bsd(4)).otherwise(asl("Host")).alias("hostname"),
        F.when(is_new, new(3)).otherwise(asl("Sender")).alias("appname"),
        F.when(is_new, new(4)).otherwise(asl("PID")).alias("procid"),
        F.when(is_new, new(5)).alias("msgid"),
        F.when(is_new, F.regexp_extract(F.get("__new", F.lit(6)), _REST, 1)).when(is_bsd, bsd(5)).otherwise(asl("Message")).alias("msg"),
        (is_new & new(1).isNotNull()).alias("__dated"),
    )
    unreadable = (F.col("__dated") | (F.col("format") == "rfc3164")) & F.col("event_ns").isNull()
    return parsed.withColumn("format", F.when(unreadable, "rejected").otherwise(F.col("format"))).drop("__dated")


def accepted(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("format") != "rejected")


def rejected(parsed: DataFrame, line: str = "line") -> DataFrame:
    return parsed.where(F.col("format") == "rejected").select(line)


def severity_counts(parsed: DataFrame) -> DataFrame:
    return accepted(parsed).groupBy("hostname", "severity").agg(F.count("*").alias("n"))


def syslog_to_telemetry(parsed: DataFrame, cfg: GatewayConfig) -> DataFrame:
    """Log records of accepted lines, with defaults for what a line leaves out."""
    message = F.coalesce(F.col("msg"), F.lit("N/A"))
    host = F.coalesce(F.col("hostname"), F.lit(cfg.source))
    props = F.to_variant_object(F.struct(
        F.col("event_ns").alias("timestamp"), F.lit(f"log[{cfg.syslog_file}]").alias("zabbix_item"),
        F.col("facility").alias("syslog_facility"), F.col("severity").alias("syslog_severity"),
        F.col("version").alias("syslog_version"), F.coalesce(F.col("appname"), F.lit("unknown")).alias("syslog_appname"),
        F.coalesce(F.col("procid"), F.lit("unknown")).alias("syslog_procid"),
    ))
    return telemetry(
        accepted(parsed), cfg,
        id=F.coalesce(F.col("msgid"), stable_id(host, F.col("event_ns"), message)),
        origin=host, destination=F.lit(cfg.syslog_destination), content_type=F.lit(LOG_CONTENT),
        data=message, properties=props, event_ns=F.col("event_ns"),
    )
