"""Redirect pages, replay URLs, index query URLs and retry rules. JVM-side expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cairn.functions import digest, times

# The redirect page around its target; the replay service's prefix.
PAGE_START, PAGE_END = '<html><body>You are being <a href="', '">redirected</a>.</body></html>'
REPLAY = r"^https?://web\.archive\.org/web/([0-9]{14})(?:[a-z]{2}_)?/([^\n]+)\z"


def redirect_page(url: Column) -> Column:
    return F.concat(F.lit(PAGE_START), url, F.lit(PAGE_END))


def redirect_target(page: Column) -> Column:
    """The target of a page of exactly that shape; null for any other, or where the target is empty or has a quote."""
    target = F.regexp_extract(page, r"(?s)\A\Q" + PAGE_START + r"\E([^\"]+)\Q" + PAGE_END + r"\E\z", 1)
    return F.nullif(target, F.lit(""))


def redirect_fits(url: Column, expected: Column) -> Column:
    return digest.sha1_base32(redirect_page(url)) == expected


def replay_time(url: Column) -> Column:
    return times.parse(F.nullif(F.regexp_extract(url, REPLAY, 1), F.lit("")))


def replay_target(url: Column) -> Column:
    """The captured URL of a replay URL with a real time; else null."""
    return F.when(replay_time(url).isNotNull(), F.nullif(F.regexp_extract(url, REPLAY, 2), F.lit("")))


def replay_url(stamp: Column, url: Column, https: bool = True, original: bool = True) -> Column:
    return F.concat(F.lit(f"http{'s' if https else ''}://web.archive.org/web/"), stamp, F.lit("id_/" if original else "/"), url)


def request_url(base: Column, stamp: Column, url: Column, original: bool = True) -> Column:
    return F.concat(F.regexp_replace(base, "/$", ""), F.lit("/web/"), stamp, F.lit("id_/" if original else "if_/"), url)


def query_url(base: str, url: Column, match: str, fast_latest: bool, limit: int | None = None, show_resume: bool = False, resume: Column | None = None) -> Column:
    """An index query; parameters in fixed order, values form-encoded. A null url or resume key gives null."""
    rest = f"&matchType={match}&fastLatest={str(fast_latest).lower()}"
    rest += f"&limit={limit}" if limit is not None else ""
    rest += "&showResumeKey=true&gzip=false" if show_resume else ""
    parts = [F.lit(f"{base}?url="), F.url_encode(url), F.lit(rest)]
    return F.concat(*parts, *([F.lit("&resumeKey="), F.url_encode(resume)] if resume is not None else []))


def resume_key(response: Column) -> Column:
    """The last line of a text response if an empty line stands before it, form-decoded; else null."""
    lines = F.split(F.regexp_replace(response, r"\n\z", ""), "\n")
    last, before = F.element_at(lines, -1), F.when(F.size(lines) > 1, F.element_at(lines, -2))
    return F.when((before == "") & (last != ""), F.coalesce(F.try_url_decode(last), last))


def retry_bounds(base_ms: int, cap_ms: int, retries: int) -> Column:
    """The array of upper bounds of the waits before each retry: doubling, capped."""
    return F.transform(F.sequence(F.lit(0), F.lit(retries - 1)), lambda k: F.least(F.lit(base_ms) * F.pow(F.lit(2), k), F.lit(cap_ms)).cast("bigint"))


def retryable(status: Column, location: Column, failure: Column) -> Column:
    """Whether a request may be made again: too many requests, server errors, a redirect to the service's apology page, or a transport failure."""
    return F.coalesce(status == 429, F.lit(False)) | F.coalesce(status.between(500, 599), F.lit(False)) | F.coalesce(location.endswith("/sry"), F.lit(False)) | F.coalesce(failure.isin("timeout", "body", "connect", "request"), F.lit(False))


def store_path(name: Column, prefixes: tuple[int, ...] = (2, 2), extension: str = "") -> Column:
    """The path of a digest in a store with prefix folders of the given lengths."""
    parts, at = [], 1
    for n in prefixes:
        parts.append(F.substring(name, at, n))
        at += n
    return F.concat_ws("/", *parts, F.concat(name, F.lit(extension)))
