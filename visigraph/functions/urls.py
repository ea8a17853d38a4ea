"""Resolution of URL references (RFC 3986, section 5.2) as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass
class Reference:
    """The parts of a reference, without query and fragment. Empty strings stand for what is not there; `rooted` says whether it names an authority."""

    scheme: Column
    authority: Column
    path: Column
    rooted: Column

    @staticmethod
    def of(c: Column) -> Reference:
        """White space around a reference is not part of it, and line breaks and tabs inside are dropped, as browsers do."""
        text = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), "[\\t\\r\\n]", ""))
        part = lambda pattern: F.regexp_extract(text, pattern, 1)
        before = "^(?:[A-Za-z][A-Za-z0-9+.-]*:)?"
        return Reference(F.lower(part("^([A-Za-z][A-Za-z0-9+.-]*):")), part(f"{before}//([^/?#]*)"), part(f"{before}(?://[^/?#]*)?([^?#]*)"), text.rlike(f"{before}//"))


def without_dots(path: Column) -> Column:
    """path without its . and .. segments; what would lead above the root stays there."""
    parts = F.split(path, "/")
    none = F.array().cast("array<string>")
    up = lambda done: F.when(F.size(done) > 1, F.slice(done, 1, F.size(done) - 1)).otherwise(done)
    kept = F.aggregate(parts, none, lambda done, x: F.when(x == "..", up(done)).when(x == ".", done).otherwise(F.array_append(done, x)))
    # most paths have no such segment
    return F.when(path.rlike(r"(?:^|/)\.\.?(?:/|$)"), F.array_join(kept, "/")).otherwise(path)


def resolved(base: Reference, link: Reference) -> Reference:
    """Where a link on the page `base` leads. A link of the page's own scheme without an authority is relative."""
    relative = (link.scheme == "") | ((link.scheme == base.scheme) & ~link.rooted)
    own = ~relative | link.rooted
    folder = F.regexp_extract(base.path, "^.*/", 0)
    # empty segments inside a merged path go
    merged = F.regexp_replace(F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), link.path), "/{2,}", "/")
    path = F.when(own | link.path.startswith("/"), link.path).when(link.path == "", base.path).otherwise(merged)
    scheme = F.when(relative, base.scheme).otherwise(link.scheme)
    return Reference(scheme, F.when(own, link.authority).otherwise(base.authority), without_dots(path), F.lit(True))
