"""URL functions as column expressions (RFC 3986 splitting, resolution, normalization); nothing here runs Python on executors.

Identity is textual: the authority keeps case, port and user info, as ``parse_url`` would fail or drop these.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPLIT = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
#: Schemes whose references are resolved against a base (fixed values).
RELATIVE = ("", "ftp", "http", "gopher", "nntp", "imap", "wais", "file", "https", "shttp", "mms", "prospero", "rtsp", "rtsps", "rtspu", "sftp", "svn", "svn+ssh", "ws", "wss")
#: Prefixes of addresses that are no links (fixed values).
SKIPPED = r"^(#|javascript:|mailto:|tel:)"


def _part(url: Column, k: int) -> Column:
    return F.regexp_extract(url, _SPLIT, k)


def scheme(url: Column) -> Column:
    return F.lower(_part(url, 1))


def domain(url: Column) -> Column:
    """Network location as written; '' if there is none."""
    return _part(url, 2)


def raw_path(url: Column) -> Column:
    return _part(url, 3)


def path(url: Column) -> Column:
    """Path without ;parameters of its last segment."""
    return F.regexp_replace(_part(url, 3), r";[^/]*$", "")


def query(url: Column) -> Column:
    return _part(url, 4)


def is_valid(url: Column) -> Column:
    return (scheme(url) != "") & (domain(url) != "")


def same_domain(a: Column, b: Column, strict: bool = False) -> Column:
    """Equal network locations; unless strict, an empty one matches any."""
    x, y = domain(a), domain(b)
    return (x == y) if strict else (x == y) | (x == "") | (y == "")


def path_components(url: Column) -> Column:
    inner = F.regexp_replace(path(url), r"^/+|/+$", "")
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, "/"))


def _with_query(p: Column, url: Column) -> Column:
    q = query(url)
    return F.concat(p, F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))


def relative_path(url: Column) -> Column:
    """Path and query, "/" kept."""
    return _with_query(path(url), url)


def tree_path(url: Column) -> Column:
    """Path and query; a bare "/" is the root, ''."""
    p = relative_path(url)
    return F.when(p == "/", "").otherwise(p)


def without_fragment(url: Column) -> Column:
    return F.regexp_replace(url, r"(?s)#.*$", "")


def _merged_path(base_path: Column, ref_path: Column) -> Column:
    """Dot segments removed; a relative reference replaces what follows the base's last slash."""
    rooted = ref_path.startswith("/")
    # drop the base's last segment; inner empty segments vanish in a merge, not in a rooted path
    base_dir = F.regexp_replace(base_path, r"[^/]*$", "")
    whole = F.when(rooted, ref_path).otherwise(F.concat(F.when(base_dir == "", "/").otherwise(base_dir), ref_path))
    segments = F.split(whole, "/")
    n = F.size(segments)
    kept = F.filter(segments, lambda s, i: rooted | (i == 0) | (i == n - 1) | (s != ""))
    folded = F.aggregate(
        kept,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(s == ".", acc).otherwise(F.concat(acc, F.array(s))),
    )
    ends_in_dots = F.element_at(kept, -1).isin(".", "..")
    joined = F.array_join(F.when(ends_in_dots, F.concat(folded, F.array(F.lit("")))).otherwise(folded), "/")
    return F.when(joined.startswith("/"), joined).otherwise(F.concat(F.lit("/"), joined))


def resolve(base: Column, ref: Column) -> Column:
    """The absolute form of a reference on a page."""
    s, b = scheme(ref), scheme(base)
    own = F.when(s == "", b).otherwise(s)
    fragment = F.regexp_extract(ref, r"(?s)(#.*)$", 1)
    fragment = F.when(fragment == "#", "").otherwise(fragment)
    q = F.regexp_extract(ref, r"(?s)^[^#?]*(\?[^#]*)", 1)
    q = F.when(q == "?", "").otherwise(q)
    base_q = F.regexp_extract(base, r"(?s)^[^#?]*(\?[^#]*)", 1)
    head = F.concat(b, F.lit("://"), domain(base))
    ref_path = _part(ref, 3)
    return (
        F.when(ref == "", base)
        .when((own != b) | ~own.isin(*RELATIVE), ref)
        .when(F.regexp_extract(ref, r"(?s)^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(//[^/?#]+)", 1) != "", F.concat(own, F.lit("://"), domain(ref), ref_path, q, fragment))
        .when(ref_path == "", F.concat(head, _part(base, 3), F.when(q == "", base_q).otherwise(q), fragment))
        .otherwise(F.concat(head, _merged_path(_part(base, 3), ref_path), q, fragment))
    )


def normalize(base: Column, ref: Column) -> Column:
    """Absolute form without fragment and path parameters."""
    url = resolve(base, ref)
    return F.concat(scheme(url), F.lit("://"), domain(url), relative_path(url))


def link_scheme_ok(href: Column) -> Column:
    """Non-empty and none of the skipped kinds (case matters)."""
    return (href != "") & ~href.rlike(SKIPPED)


def file_token(host: Column) -> Column:
    return F.replace(host, F.lit("."), F.lit("_"))


def sanitize_filename(name: Column) -> Column:
    return F.translate(name, '<>:"/\\|?*', "_________")


def trim_slashes(url: Column) -> Column:
    return F.regexp_replace(url, r"/+$", "")
