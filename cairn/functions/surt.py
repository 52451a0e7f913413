"""Sort-friendly keys of URLs: host labels reversed, then path and query. JVM-side expressions.

Hosts that need more than ASCII (punycode), user names, dot segments and IP addresses give null rather than a wrong key.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KEY = r"^[A-Za-z0-9_:-]{1,255}(,[A-Za-z0-9_:-]{1,255})*\)"
_HOST = r"^(https?)://([a-z0-9_-]+(?:\.[a-z0-9_-]+)*\.?)(?::([0-9]*))?(?=[/?#]|\z)"
#: The path escapes that are decoded, as hexadecimal codes.
DECODED = {"22": '"', "27": "'", "2a": "*", "3c": "<", "3e": ">", "5c": "\\", "7b": "{", "7d": "}"}


def _path(path: Column) -> Column:
    out = F.regexp_replace(path, "/{2,}", "/")
    for code, char in DECODED.items():
        out = F.replace(out, F.lit("%" + code), F.lit(char))
    return out


def _value(value: Column) -> Column:
    """A query value, form-decoded (as it is where an escape is broken) and encoded again the archive's way."""
    plain = F.coalesce(F.try_url_decode(value), F.replace(value, F.lit("+"), F.lit(" ")))
    out = F.replace(plain, F.lit("+"), F.lit("\0"))
    for a, b in ((" ", "+"), ("\0", "%20"), ("\n", "%0a"), ("&", "%26"), ("#", "%23"), ("%5e", "^")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def from_url(url: Column) -> Column:
    """The key of an http or https URL without user, non-default port or number for a host; else null."""
    low = F.lower(url)
    scheme, host, port = (F.regexp_extract(low, _HOST, i) for i in (1, 2, 3))
    labels = F.filter(F.split(host, r"\."), lambda x: (x != "www") & (x != ""))
    rest = F.regexp_replace(F.regexp_replace(low, _HOST, ""), "(?s)#.*", "")
    path, query = F.substring_index(rest, "?", 1), F.when(F.instr(rest, "?") > 0, F.regexp_replace(rest, r"(?s)^[^?]*\?", ""))
    pairs = F.filter(F.split(query, "&"), lambda p: p != "")
    decoded = F.transform(pairs, lambda p, i: F.struct(_plain(F.substring_index(p, "=", 1)).alias("k"), i.alias("i"), F.when(F.instr(p, "=") > 0, _value(F.regexp_replace(p, "^[^=]*=", ""))).otherwise("").alias("v")))
    joined = F.array_join(F.transform(F.array_sort(decoded), lambda s: F.concat(s["k"], F.lit("="), s["v"])), "&")
    good = (scheme != "") & (F.size(labels) > 0) & ((port == "") | (port == F.when(scheme == "http", "80").otherwise("443"))) & ~host.rlike(r"(^|\.)[0-9]+\.?$") & ~path.rlike(r"(^|/)\.{1,2}(/|$)") & ~host.rlike(r"[^.]{256}")
    key = F.concat(F.array_join(F.reverse(labels), ","), F.lit(")"), F.regexp_replace(_path(path), "/$", ""), F.when(F.size(pairs) > 0, F.concat(F.lit("?"), joined)).otherwise(""))
    return F.when(good, key)


def _plain(name: Column) -> Column:
    return F.coalesce(F.try_url_decode(name), name)


def is_key(key: Column) -> Column:
    return F.coalesce(key.rlike(KEY), F.lit(False))


def labels(key: Column) -> Column:
    """The host's labels in the key's order; null for no key."""
    return F.when(is_key(key), F.split(F.substring_index(key, ")", 1), ","))


def path(key: Column) -> Column:
    return F.when(is_key(key), F.regexp_replace(key, r"(?s)^[^)]*\)", ""))


def canonical_url(key: Column) -> Column:
    """https:// and the host in usual order, a port of its last label behind it, and the path."""
    last = F.element_at(labels(key), -1)
    port = F.when(F.instr(last, ":") > 0, F.concat(F.lit(":"), F.regexp_replace(last, "^[^:]*:", ""))).otherwise("")
    host = F.array_join(F.transform(F.reverse(labels(key)), lambda x: F.substring_index(x, ":", 1)), ".")
    return F.when(is_key(key), F.concat(F.lit("https://"), host, port, path(key)))
