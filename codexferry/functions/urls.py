"""Link columns: split, filter, score and canonicalize web addresses.

Each function accepts plain columns or lambda variables, so the same rules serve
an exploded link table and the in-row choice of the best link.
"""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from codexferry import constants as C
from codexferry.functions.text import SPACE_CLASS, let, strip_space


# Characters that turn into a delimiter of addresses when they are normalized.
_DELIMITERS_IN_DISGUISE = "".join(
    chr(c)
    for c in (*range(0x80, 0xD800), *range(0xE000, 0x10000))
    if set(unicodedata.normalize("NFKC", chr(c))) & set("/?#@:")
)


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def link_is_absolute(href: Column) -> Column:
    return href.startswith("http://") | href.startswith("https://")


def absolute_links(hrefs: Column) -> Column:
    """Trimmed absolute links, in document order."""
    return F.filter(F.transform(hrefs, strip_space), link_is_absolute)


def url_parts(url: Column) -> Column:
    """scheme, netloc, path (without parameters), query, fragment."""
    clean = F.translate(url, "\t\r\n", "")

    def split(u: Column) -> Column:
        path = F.regexp_extract(u, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1)
        return F.struct(
            F.regexp_extract(u, r"^([^:/?#]+):", 1).alias("scheme"),
            F.regexp_extract(u, r"^[^:/?#]+://([^/?#]*)", 1).alias("netloc"),
            # Only the last segment can carry parameters.
            F.regexp_replace(path, r"(?s);[^/]*\z", "").alias("path"),
            F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1).alias("query"),
            F.regexp_extract(u, r"(?s)^[^#]*#(.*)\z", 1).alias("fragment"),
        )

    return let(clean, split)


def url_is_valid(parts: Column) -> Column:
    """False for hosts with unbalanced brackets or delimiters in disguise."""
    host = parts["netloc"]
    honest = ~host.rlike(f"[{_DELIMITERS_IN_DISGUISE}]")
    plain = ~F.contains(host, F.lit("[")) & ~F.contains(host, F.lit("]"))
    bracketed = host.rlike(r"^([^\[\]]*@)?\[([0-9a-fA-F:.%]+|v[0-9a-fA-F]+\..+)\](:[^\[\]]*)?$")
    return honest & (plain | bracketed)


def canonical_from_parts(parts: Column) -> Column:
    query = parts["query"]
    tracked = _any([F.contains(query, F.lit(t)) for t in C.TRACKING_QUERIES])
    return F.concat(
        F.lower(parts["scheme"]),
        F.lit("://"),
        parts["netloc"],
        F.rtrim(parts["path"], F.lit("/")),
        F.when((query == "") | tracked, "").otherwise(F.concat(F.lit("?"), query)),
    )


def canonicalize_url(url: Column) -> Column:
    """Address without trailing slashes, parameters, fragment or tracking query."""
    return let(url_parts(url), canonical_from_parts)


def _host_blocked(host: Column, match: str) -> Column:
    if match == "exact":
        suffixes = [h for h in C.BLOCKED_HOSTS if h != "accounts.google"]
        return _any(
            [(host == h) | host.endswith("." + h) for h in suffixes]
            + [host.startswith("accounts.google.")]
        )
    return _any([F.contains(host, F.lit(h)) for h in C.BLOCKED_HOSTS])


def _path_blocked(path: Column, match: str) -> Column:
    if match == "exact":
        # A namespace ends in a colon and has no boundary of its own.
        words = [p for p in C.BLOCKED_PATHS if not p.endswith(":")]
        names = [p for p in C.BLOCKED_PATHS if p.endswith(":")]
        return path.rlike("(" + "|".join(words) + r")(/|\z)") | _any(
            [F.contains(path, F.lit(n)) for n in names]
        )
    return _any([F.contains(path, F.lit(p)) for p in C.BLOCKED_PATHS])


def link_not_blocked(parts: Column, match: str = "substring") -> Column:
    """False for social, account and edit links.

    ``match='substring'`` compares anywhere in host and path; ``'exact'`` compares
    whole host suffixes and path segments.
    """
    if match not in ("substring", "exact"):
        raise ValueError(f"match must be 'substring' or 'exact', not {match!r}")
    query = parts["query"]
    return ~(
        _host_blocked(F.lower(parts["netloc"]), match)
        | _path_blocked(F.lower(parts["path"]), match)
        | _any([F.contains(query, F.lit(q)) for q in C.BLOCKED_QUERIES])
    )


def title_hints(title: Column) -> Column:
    """What a title says about its page: tokens, site tokens, wiki slug."""
    stop = F.array(*[F.lit(w) for w in C.TITLE_STOP_WORDS])
    pieces = F.split(title, f"[{SPACE_CLASS}]+[-|][{SPACE_CLASS}]+", -1)
    site = F.when(F.size(pieces) > 1, F.lower(F.element_at(pieces, -1))).otherwise("")
    slug = F.substring_index(title, C.WIKI_TITLE_SUFFIX, 1)
    return F.struct(
        F.filter(
            F.regexp_extract_all(F.lower(title), F.lit("[a-z0-9]{3,}"), 0),
            lambda w: ~F.array_contains(stop, w),
        ).alias("tokens"),
        F.regexp_extract_all(site, F.lit("[a-z0-9]+"), 0).alias("site_tokens"),
        F.lower(F.replace(strip_space(slug), F.lit(" "), F.lit("_"))).alias("wiki_slug"),
    )


def link_score(parts: Column, position: Column, hints: Column) -> Column:
    """How well a link fits a title; terms are added in a fixed order."""
    host, path = F.lower(parts["netloc"]), F.lower(parts["path"])
    fragment = F.lower(parts["fragment"])
    words = F.regexp_replace(path, "[^a-z0-9]", " ")
    n_tokens = F.size(hints["tokens"])
    matched = F.size(F.filter(hints["tokens"], lambda t: F.contains(words, t)))
    matched = matched.cast("double")
    wiki = F.contains(F.concat(host, path), F.lit(C.WIKI_HOST_PATH)) & (
        path == F.concat(F.lit("/wiki/"), hints["wiki_slug"])
    )
    site = F.exists(hints["site_tokens"], lambda t: F.contains(host, t))
    fragment_points = (
        F.when(fragment.isin(C.CONTENT_FRAGMENTS), F.when(position == 0, 80.0).otherwise(50.0))
        .when(fragment != "", 10.0)
        .otherwise(0.0)
    )
    share = F.when(n_tokens > 0, matched / n_tokens * 40.0).otherwise(0.0)
    return (
        fragment_points
        + share
        + matched * 8.0
        + F.when(wiki, 100.0).otherwise(0.0)
        + F.when(site, 15.0).otherwise(0.0)
        - F.when(path.isin(C.HOME_PATHS), 20.0).otherwise(0.0)
    )


def best_link(title: Column, hrefs: Column, match: str = "substring") -> Column:
    """struct(score, position, url) of the best link of one page, NULL if none.

    All links of a page are in its own row, so no link table is shuffled.
    """

    def choose(bound: Column) -> Column:
        hints = bound["hints"]
        links = F.transform(
            bound["links"],
            lambda u, i: F.struct(i.alias("position"), url_parts(u).alias("parts")),
        )
        usable = F.filter(
            links,
            lambda x: url_is_valid(x["parts"]) & link_not_blocked(x["parts"], match),
        )
        scored = F.transform(
            usable,
            lambda x: F.struct(
                link_score(x["parts"], x["position"], hints).alias("score"),
                (-x["position"]).alias("order"),
                canonical_from_parts(x["parts"]).alias("url"),
            ),
        )
        # First link wins a tie: the order is the negative position.
        best = F.array_max(F.filter(scored, lambda s: s["score"] > -1.0))
        return let(
            best,
            lambda b: F.when(
                b.isNotNull(),
                F.struct(
                    b["score"].alias("score"),
                    (-b["order"]).alias("position"),
                    b["url"].alias("url"),
                ),
            ),
        )

    return let(
        F.struct(title_hints(title).alias("hints"), absolute_links(hrefs).alias("links")),
        choose,
    )
