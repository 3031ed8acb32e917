"""Text functions: neutralising hostile characters, links and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Control, direction, zero-width and separator characters, byte order mark, soft hyphen.
HOSTILE = r"[\x{0}-\x{1F}\x{7F}-\x{9F}\x{AD}\x{200B}-\x{200F}\x{2028}-\x{202E}\x{2060}\x{2066}-\x{2069}\x{FEFF}]"


def _marked(text: Column, hostile: str, open_: str, close: str) -> Column:
    characters = F.split(text, "")
    shown = F.transform(characters, lambda c: F.when(c.rlike(hostile), F.concat(F.lit(open_), F.lpad(F.hex(F.ascii(c)), 4, "0"), F.lit(close))).otherwise(c))
    # Nearly all texts are clean and skip the loop over characters.
    return F.when(text.rlike(hostile), F.array_join(shown, "")).otherwise(text)


def neutralise_for_terminal(text: Column) -> Column:
    """Hostile characters, line breaks and tabs included, as ``<U+XXXX>``."""
    return _marked(text, HOSTILE, "<U+", ">")


def neutralise_for_html(text: Column) -> Column:
    """The five entities escaped and hostile characters but tab and line breaks as ``&lt;U+XXXX&gt;``."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return _marked(text, f"(?![\\t\\n\\r]){HOSTILE}", "&lt;U+", "&gt;")


def bundle_relative(path: Column) -> Column:
    """A path inside the bundle, without leading slashes; null for URLs, mail addresses and paths that leave it."""
    stripped = F.regexp_replace(path, "^/+", "")
    segments = F.split(stripped, r"[/\\]", -1)
    outside = path.contains("://") | path.startswith("mailto:") | (stripped == "") | stripped.contains(":") | F.exists(segments, lambda s: s.isin("", ".", ".."))
    return F.when(~outside, stripped)


def normalise_path(path: Column) -> Column:
    """``.`` and ``..`` segments resolved; a ``..`` beyond the root is dropped."""
    step = lambda a, s: F.when(s.isin("", "."), a).when(s == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(s)))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def link_targets(body: Column, path: Column) -> Column:
    """Targets of markdown links as bundle paths: array of structs raw, target, anchor.

    Links with a scheme have no target.  Targets with a leading slash start at the root,
    others at the folder of ``path``.
    """
    raws = F.regexp_extract_all(body, F.lit(r"\[[^\]\n]*\]\(([^)\s]+)[^)\n]*\)"), 1)
    folder = F.regexp_replace(path, "[^/]*$", "")

    def link(raw: Column) -> Column:
        bare = F.regexp_replace(raw, "#.*$", "")
        inside = ~(raw.contains("://") | raw.startswith("mailto:")) & (bare != "")
        target = F.when(inside, normalise_path(F.when(bare.startswith("/"), bare).otherwise(F.concat(folder, bare))))
        return F.struct(raw.alias("raw"), target.alias("target"), F.nullif(F.regexp_extract(raw, "#(.*)$", 1), F.lit("")).alias("anchor"))

    return F.transform(raws, link)


def concept_id(path: Column) -> Column:
    """A concept's id: its path without ``.md``."""
    return F.regexp_replace(path, r"\.md$", "")
