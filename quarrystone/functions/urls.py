"""URL identities as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query names whose values are secret, and those of signatures that expire.
SECRET_KEYS = (
    "signature", "token", "access_token", "authorization", "auth", "api_key", "expires", "ossaccesskeyid", "awsaccesskeyid", "googleaccessid", "key-pair-id", "policy",
    "x-amz-algorithm", "x-amz-credential", "x-amz-date", "x-amz-expires", "x-amz-security-token", "x-amz-signature", "x-amz-signedheaders", "x-goog-algorithm", "x-goog-credential",
    "x-goog-date", "x-goog-expires", "x-goog-signature", "x-goog-signedheaders", "x-goog-security-token", "x-oss-access-key-id", "x-oss-credential", "x-oss-date", "x-oss-expires",
    "x-oss-security-token", "x-oss-signature", "x-oss-signature-version", "security-token",
)
VOLATILE_KEYS = (
    "expires", "ossaccesskeyid", "signature", "awsaccesskeyid", "googleaccessid", "key-pair-id", "policy", "x-amz-algorithm", "x-amz-credential", "x-amz-date", "x-amz-expires",
    "x-amz-security-token", "x-amz-signature", "x-amz-signedheaders", "x-goog-algorithm", "x-goog-credential", "x-goog-date", "x-goog-expires", "x-goog-signature",
    "x-goog-signedheaders", "x-oss-access-key-id", "x-oss-credential", "x-oss-date", "x-oss-expires", "x-oss-security-token", "x-oss-signature", "x-oss-signature-version",
)
#: Query names that still tell objects of a stable host apart.
REPRESENTATION_KEYS = ("x-oss-process", "versionId", "versionid")


def without_fragment(url: Column) -> Column:
    return F.regexp_replace(url, "#.*$", "")


def base_of(url: Column) -> Column:
    """Scheme, host and path."""
    return F.regexp_replace(url, r"[?#].*$", "")


def query_pairs(url: Column) -> Column:
    """The key=value strings of the query, in order."""
    query = F.regexp_extract(without_fragment(url), r"\?(.*)$", 1)
    return F.filter(F.split(query, "&"), lambda p: p != "")


def key_of(pair: Column) -> Column:
    return F.substring_index(pair, "=", 1)


def value_of(pair: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(pair, r"=(.*)$", 1), "^=", "")


def joined(base: Column, pairs: Column) -> Column:
    return F.when(F.size(pairs) > 0, F.concat(base, F.lit("?"), F.array_join(pairs, "&"))).otherwise(base)


def redacted(url: Column, keys: tuple[str, ...] = SECRET_KEYS) -> Column:
    """Values of secret names become the first 16 hex digits of their hash."""
    hide = lambda p: F.when(F.lower(key_of(p)).isin(*keys), F.concat(key_of(p), F.lit("=<redacted:sha256:"), F.substring(F.sha2(value_of(p), 256), 1, 16), F.lit(">"))).otherwise(p)
    fragment = F.regexp_extract(url, "(#.*)$", 1)
    return F.concat(joined(base_of(url), F.transform(query_pairs(url), hide)), fragment)


def canonical(url: Column) -> Column:
    """Without fragment, query sorted by name; null for a null url."""
    pairs = F.array_sort(F.transform(query_pairs(url), lambda p: F.struct(key_of(p).alias("k"), p.alias("p"))))
    return joined(base_of(url), F.transform(pairs, lambda s: s["p"]))


def signed_variant(url: Column) -> Column:
    """Canonical url without signature names; null where it has none, so a plain url is never a variant."""
    pairs = query_pairs(url)
    volatile = lambda p: F.lower(key_of(p)).isin(*VOLATILE_KEYS)
    kept = F.filter(pairs, lambda p: ~volatile(p))
    return F.when(F.exists(pairs, volatile), canonical(joined(base_of(url), kept)))


def alias_key(url: Column) -> Column:
    """Path alone, repeated dots before an image or document ending made one."""
    path = F.regexp_extract(base_of(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/]*(.*)$", 1)
    return F.regexp_replace(path, r"(?i)\.{2,}(png|jpe?g|gif|webp|svg|pdf)$", ".$1")


def identity(url: Column, stable_hosts: tuple[str, ...] = ()) -> Column:
    """SHA-256 of what names the object: base and representation names on stable hosts, else the redacted url."""
    plain = F.regexp_replace(url, "(?i)&amp;", "&")
    host = F.lower(F.regexp_extract(plain, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#:]*)", 1))
    kept = F.filter(query_pairs(plain), lambda p: key_of(p).isin(*REPRESENTATION_KEYS))
    stable = host.isin(*stable_hosts) if stable_hosts else F.lit(False)
    return F.sha2(F.when(stable, joined(base_of(plain), kept)).otherwise(redacted(url)), 256)


def page_url(url: Column, name: str, page: Column, obsolete: tuple[str, ...] = ()) -> Column:
    """The url of another page: the page name set, obsolete names dropped."""
    kept = F.filter(query_pairs(url), lambda p: ~key_of(p).isin(name, *obsolete))
    return joined(base_of(url), F.concat(kept, F.array(F.concat(F.lit(name + "="), page.cast("string")))))


def urls_in(text: Column) -> Column:
    """All http urls of a text."""
    return F.regexp_extract_all(text, F.lit(r"((?:http|HTTP)[sS]?://[^\s<>\"'`}\]]+)"), F.lit(1))


#: Hosts and paths of telemetry, and paths that read only although they are posted to.
TELEMETRY_HOSTS = ("hm.baidu.com", "google-analytics.com", "googletagmanager.com")
TELEMETRY_WORDS = ("sensorsdata", "arms-retcode")
TELEMETRY_PATHS = r"^/sa\.gif$|/logstores/|/trace/track"
READ_ONLY_PATH = r"^/api/[^/]*Read/[^/]+$"


def host_of(url: Column) -> Column:
    """Lower-case host without port; empty for what is no absolute url."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(base_of(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/]*(.*)$", 1)


def on_hosts(url: Column, hosts: tuple[str, ...]) -> Column:
    """Whether the host is one of hosts or stands below one."""
    host = host_of(url)
    return reduce(Column.__or__, [(host == h) | host.endswith("." + h) for h in hosts], F.lit(False))


def is_telemetry(url: Column) -> Column:
    host = host_of(url)
    words = reduce(Column.__or__, [host.contains(w) for w in TELEMETRY_WORDS])
    return on_hosts(url, TELEMETRY_HOSTS) | words | host.endswith("log.aliyuncs.com") | F.rlike(F.lower(path_of(url)), F.lit(TELEMETRY_PATHS))


def under_paths(url: Column, paths: tuple[str, ...]) -> Column:
    """Whether the path, in lower case and without closing slashes, is one of paths or below one."""
    path = F.regexp_replace(F.lower(path_of(url)), "/+$", "")
    return reduce(Column.__or__, [(path == p) | path.startswith(p + "/") for p in paths], F.lit(False))


def is_read_only_api(url: Column, more: tuple[str, ...] = ()) -> Column:
    return path_of(url).isin(*more) | F.rlike(path_of(url), F.lit(READ_ONLY_PATH)) if more else F.rlike(path_of(url), F.lit(READ_ONLY_PATH))


def url_class(url: Column, excluded: tuple[str, ...], blocked: tuple[str, ...], allowed: tuple[str, ...]) -> Column:
    """What a request is, by the first rule that holds."""
    cases = (
        (F.coalesce(host_of(url), F.lit("")) == "", "invalid"), (on_hosts(url, blocked), "blocked"), (is_telemetry(url), "telemetry"),
        (under_paths(url, excluded), "excluded"), (is_read_only_api(url), "read_only_api"), (on_hosts(url, allowed), "allowed")
    )
    return reduce(lambda rest, c: F.when(c[0], c[1]).otherwise(rest), reversed(cases), F.lit("other"))


def read_only_post_key(method: Column, url: Column, body_sha256: Column, excluded: tuple[str, ...]) -> Column:
    """What two exact read-only posts share: method, canonical url and the hash of the body; null for any other request."""
    holds = (F.upper(method) == "POST") & (F.coalesce(body_sha256, F.lit("")) != "") & ~under_paths(url, excluded) & is_read_only_api(url)
    return F.when(holds, F.concat_ws("\n", F.lit("POST"), canonical(url), body_sha256))
