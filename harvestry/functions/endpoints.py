"""Grammar of endpoint lines: host:port, host:port:user:secret, user:secret@host:port, URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from harvestry.functions.text import blank_to_null, let

_URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:([^/?#]*)@)?([^/?#@]*)"
_HOST_PORT = r"^\[?([^\]:]*(?::[^\]]*)?)\]?:(\d+)$"


def _text(value: str | None) -> Column:
    return F.lit(value).cast("string")


def _bad(reason: str) -> Column:
    nothing = _text(None)
    return F.struct(
        nothing.alias("ip"), F.lit(None).cast("int").alias("port"), nothing.alias("protocol"),
        nothing.alias("username"), nothing.alias("secret"), _text(reason).alias("error"),
    )


def _good(ip: Column, port: Column, protocol: Column, user: Column, secret: Column) -> Column:
    return F.struct(
        ip.alias("ip"), port.alias("port"), protocol.alias("protocol"), blank_to_null(user).alias("username"),
        blank_to_null(secret).alias("secret"), _text(None).alias("error"),
    )


def _decoded(part: Column) -> Column:
    """Percent-decoded text; a plus stays a plus and broken escapes stay as they are."""
    kept_plus = F.replace(part, F.lit("+"), F.lit("%2B"))
    decoded = F.coalesce(F.try_url_decode(kept_plus), part)
    return F.when(F.contains(part, F.lit("%")), decoded).otherwise(part)


def _before(text: Column, mark: str) -> Column:
    return F.substring_index(text, mark, 1)


def _after(text: Column, mark: str) -> Column:
    """Text behind the first ``mark``, NULL without one."""
    return F.when(F.contains(text, F.lit(mark)), F.substring(text, F.instr(text, mark) + 1, F.length(text)))


def _from_url(raw: Column) -> Column:
    def check(u: Column) -> Column:
        port = u["port"].try_cast("int")
        ok = (u["host"] != "") & F.coalesce(port.between(1, 65535), F.lit(False))
        return F.when(ok, _good(
            F.lower(u["host"]), port, F.lower(u["scheme"]),
            _decoded(_before(u["auth"], ":")), _decoded(_after(u["auth"], ":")),
        )).otherwise(_bad("url needs host:port"))

    def split(p: Column) -> Column:
        where = p["where"]
        return let(F.struct(
            p["scheme"].alias("scheme"), p["auth"].alias("auth"),
            F.regexp_extract(where, _HOST_PORT, 1).alias("host"), F.regexp_extract(where, _HOST_PORT, 2).alias("port"),
        ), check)

    return let(F.struct(
        F.regexp_extract(raw, _URL, 1).alias("scheme"), F.regexp_extract(raw, _URL, 2).alias("auth"),
        F.regexp_extract(raw, _URL, 3).alias("where"),
    ), split)


def _from_plain(raw: Column, protocol: str) -> Column:
    def check(p: Column) -> Column:
        parts, n, auth = p["parts"], F.size(p["parts"]), p["auth"]
        host, port = F.get(parts, F.lit(0)), F.trim(F.get(parts, F.lit(1))).try_cast("int")
        user = F.when(n >= 4, F.get(parts, F.lit(2))).otherwise(F.coalesce(_before(auth, ":"), p["user"]))
        secret = F.when(n >= 4, F.array_join(F.slice(parts, 4, F.greatest(n - 3, F.lit(1))), ":")).otherwise(
            F.coalesce(_after(auth, ":"), p["secret"]))
        return (
            F.when(~((n == 2) | (n >= 4)), _bad("expected host:port or host:port:user:secret"))
            .when(port.isNull(), _bad("port is not a number"))
            .when((host == "") | ~port.between(1, 65535), _bad("invalid host or port"))
            .otherwise(_good(host, port, _text(protocol), user, secret))
        )

    def split(tokens: Column) -> Column:
        head = F.coalesce(F.get(tokens, F.lit(0)), F.lit(""))
        more = F.size(tokens) >= 3
        return let(F.struct(
            F.split(F.substring_index(head, "@", -1), ":").alias("parts"),
            F.when(F.contains(head, F.lit("@")), F.regexp_extract(head, r"^(.*)@", 1)).alias("auth"),
            F.when(more, F.get(tokens, F.lit(1))).alias("user"), F.when(more, F.get(tokens, F.lit(2))).alias("secret"),
        ), check)

    return let(F.filter(F.split(raw, r"[\s,|]+"), lambda t: t != ""), split)


def endpoint_parts(line: Column | str, protocol: str = "http") -> Column:
    """Struct (ip, port, protocol, username, secret, error); ``error`` is NULL for a good line."""
    line = F.col(line) if isinstance(line, str) else line

    def parse(raw: Column) -> Column:
        return (
            F.when(raw == "", _bad("blank line"))
            .when(F.startswith(raw, F.lit("#")), _bad("comment"))
            .when(F.contains(raw, F.lit("://")), _from_url(raw))
            .otherwise(_from_plain(raw, protocol))
        )

    return let(F.regexp_replace(F.coalesce(line, F.lit("")), r"^\s+|\s+$", ""), parse)


def endpoint_line(fmt: str, include_auth: bool = True) -> Column:
    """Text line of an endpoint row; ``fmt`` is hostport_auth, hostport or url."""
    where = F.concat_ws(":", F.col("ip"), F.col("port").cast("string"))
    login = F.concat_ws(":", F.col("username"), F.col("secret"))
    has_auth = (
        F.lit(include_auth)
        & (F.coalesce(F.col("username"), F.lit("")) != "")
        & (F.coalesce(F.col("secret"), F.lit("")) != "")
    )
    if fmt == "url":
        lead = F.concat(F.col("protocol"), F.lit("://"))
        return F.when(has_auth, F.concat(lead, login, F.lit("@"), where)).otherwise(F.concat(lead, where))
    if fmt == "hostport":
        return where
    return F.when(has_auth, F.concat_ws(":", where, login)).otherwise(where)
