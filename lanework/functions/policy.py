"""Per-provider selection rules as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Whether a source of unknown expiry may be selected, and whether it is preferred on equal quality.
ALLOWS_UNKNOWN_EXPIRY = ("SONYLIV", "FANCODE", "JIO", "KHEL")
PREFERS_UNKNOWN_EXPIRY = ("FANCODE",)
MIN_REMAINING_S = 900
MOTION_CAP_FPS = 50.0
#: Other names of a provider.
SONY_NAMES = ("SONY", "SONY_TV", "SONYLIV")
EVENT_GROUPS = ("HOTSTAR_EVENTS", "SONYLIV_EVENTS", "FANCODE")
ROUTE_403_GROUPS = ("FANCODE", "JIO_STAR_SPORTS")
ROUTE_403_PROVIDERS = ("FANCODE", "JIO")


def provider_name(provider: Column) -> Column:
    name = F.upper(F.trim(F.coalesce(provider, F.lit(""))))
    return F.when(name.isin(*SONY_NAMES), "SONYLIV").when(name == "", "UNKNOWN").otherwise(name)


def allows_unknown(provider: Column) -> Column:
    return provider_name(provider).isin(*ALLOWS_UNKNOWN_EXPIRY)


def prefers_unknown(provider: Column) -> Column:
    return provider_name(provider).isin(*PREFERS_UNKNOWN_EXPIRY)


def candidate_state(provider: Column, launchable: Column, expiry: Column, probe_status: Column, access_blocked: Column, unsupported_drm: Column) -> Column:
    """State of a row: what can be launched comes first, then the reasons against, in order."""
    status = F.coalesce(probe_status, F.lit(""))
    return (
        F.when(launchable & expiry.isNull() & ~allows_unknown(provider), "AUTH_UNKNOWN")
        .when(launchable, "WORKING")
        .when(status == "expired", "EXPIRED")
        .when(access_blocked | (status == "access_blocked"), "ACCESS_BLOCKED")
        .when(F.coalesce(unsupported_drm, F.lit("")) != "", "UNSUPPORTED_DRM")
        .when(status == "probe_failed", "PROBE_FAILED")
        .when(status == "", "UNUSABLE")
        .otherwise(F.upper(status))
    )


def lifecycle_scan_type(source_group: Column, scan_type: Column) -> Column:
    """Entries of event groups count as progressive."""
    return F.when(source_group.isin(*EVENT_GROUPS), "progressive").otherwise(scan_type)


def classify_access(provider: Column, source_group: Column, http_status: Column, error_type: Column, country: Column) -> Column:
    """struct(blocked, kind, http_status, geo_country) of a failed request; http_status is null if it failed without an answer.

    A 403 that says it is geo-blocked is confirmed; other 403 of some groups and providers, and 450 and 451, suggest a route problem.
    """
    text = lambda c: F.trim(F.coalesce(c, F.lit("")))
    geo = (http_status == 403) & (F.lower(text(error_type)) == "geo-blocked")
    route = (http_status == 403) & (F.upper(text(source_group)).isin(*ROUTE_403_GROUPS) | F.upper(text(provider)).isin(*ROUTE_403_PROVIDERS)) | http_status.isin(450, 451)
    kind = F.when(geo, "confirmed_geo").when(route, "vpn_route_suspected").otherwise("")
    return F.struct((kind != "").alias("blocked"), kind.alias("kind"), F.when(http_status != 0, http_status).alias("http_status"), F.when(geo, F.nullif(text(country), F.lit(""))).alias("geo_country"))


def classify_variant_failure(non_hls: Column, http_status: Column, http_reason: Column, timed_out: Column, detail: Column) -> Column:
    """struct(status, classification, reason, http_status) of a variant that could not be read, the first that holds: no
    manifest, an HTTP error (http_status not null), a timeout, another failure with its detail."""
    text = lambda c: F.trim(F.coalesce(c, F.lit("")))
    yes = lambda c: F.coalesce(c, F.lit(False))
    http = http_status.isNotNull() & ~yes(non_hls)
    status = F.when(yes(non_hls), "hls_variant_invalid").when(http & http_status.isin(404, 410), "hls_variant_unavailable").when(http & http_status.isin(401, 403), "hls_variant_access_failed").otherwise("hls_variant_check_failed")
    said = F.when(http_status == 0, "HTTP request failed").otherwise(F.trim(F.concat_ws(" ", F.lit("HTTP"), http_status.cast("string"), text(http_reason))))
    tail = F.when(status == "hls_variant_unavailable", "selected HLS variant/path unavailable").when(status == "hls_variant_access_failed", "selected HLS variant access failed").otherwise("selected HLS variant check failed")
    reason = (
        F.when(yes(non_hls), "selected HLS variant returned a non-HLS response")
        .when(http, F.concat(said, F.lit(" — "), tail))
        .when(yes(timed_out), "connection timed out while checking selected HLS variant")
        .when(text(detail) != "", F.concat(text(detail), F.lit(" — "), tail))
        .otherwise(tail)
    )
    return F.struct(status.alias("status"), F.upper(F.replace(status, F.lit("_"), F.lit(" "))).alias("classification"), reason.alias("reason"), F.when(http & (http_status != 0), http_status).alias("http_status"))


def probe_status(expired: Column, unsupported: Column, key_missing: Column, check_failed: Column, variant_failure: Column, is_playlist: Column) -> Column:
    """What a probe found, the first that holds: expired, unsupported, a missing key, a failed check, a failed variant (its
    name, null or '' if none), working, else unsupported. Null flags count as false."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    failed = F.coalesce(variant_failure, F.lit(""))
    return F.when(yes(expired), "expired").when(yes(unsupported), "unsupported").when(yes(key_missing), "drm_key_missing").when(yes(check_failed), "drm_check_failed").when(failed != "", failed).when(yes(is_playlist), "working").otherwise("unsupported")
