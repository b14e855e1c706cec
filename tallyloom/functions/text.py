"""Text, URL and HTML shaping."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parts of key names whose values are never shown (fixed values).
SENSITIVE = ("authorization", "cookie", "token", "password", "secret", "api_key", "apikey")
#: HTML entities that are decoded, ampersand last (fixed values).
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))
MASK = "***"


def is_sensitive(key: Column) -> Column:
    """Whether a key's name holds a sensitive part, in either case."""
    return F.lower(key).rlike("|".join(SENSITIVE))


def redact_map(values: Column) -> Column:
    """A map of strings with the values of sensitive keys masked."""
    return F.transform_values(values, lambda k, v: F.when(is_sensitive(k), F.lit(MASK)).otherwise(v))


def redact_url(url: Column) -> Column:
    """A URL with the values of sensitive query and fragment parameters masked."""
    return F.regexp_replace(url, f"(?i)([?&#][^=&#]*({'|'.join(SENSITIVE)})[^=&#]*=)[^&#]*", f"$1{MASK}")


def redact_json_text(text: Column) -> Column:
    """JSON text with the scalar values of sensitive keys masked at any depth; other text is unchanged.

    The pattern steps over strings without going back, so a value's length costs no stack.
    """
    string = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
    return F.regexp_replace(text, rf'(?i)("[^"]*({"|".join(SENSITIVE)})[^"]*+"\s*+:\s*+)({string}|[-+0-9.eE]+|true|false|null)', f'$1"{MASK}"')


def html_to_text(html: Column) -> Column:
    """Tags become nothing, entities their characters, runs of white space one space."""
    text = F.regexp_replace(html, "<[^>]*>", "")
    for name, char in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(text, r"[ \t\n\r\f\x0B]+", " "))


def hrefs(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit('href="([^"]*)"'), F.lit(1))


def to_number(text: Column) -> Column:
    """An integer written with thousands separators, else null."""
    return F.replace(text, F.lit(","), F.lit("")).try_cast("bigint")


def truncate_message(text: Column, most: int = 8192, marker: str = "…[truncated]") -> Column:
    """Text of at most ``most`` bytes, cut between characters, with a marker where it was cut.

    A character has at most four bytes, so the longest fitting prefix is looked for among the
    few lengths near the byte limit only.
    """
    cut = F.aggregate(F.sequence(F.lit(0), F.lit(3)), F.lit(None).cast("string"), lambda found, k: F.coalesce(found, _whole(F.substring(F.encode(text, "UTF-8"), F.lit(1), F.lit(most) - k))))
    return F.when(F.octet_length(text) > most, F.concat(cut, F.lit(marker))).otherwise(text)


def _whole(raw: Column) -> Column:
    """The text of bytes that end between characters, else null."""
    text = F.try_validate_utf8(raw.cast("string"))
    return F.when(F.is_valid_utf8(text), text)


def byte_tail(text: Column, most: int = 512, marker: str = "…") -> Column:
    """The last ``most`` bytes, from the next character's begin on, with a marker in front where text is missing."""
    raw = F.encode(text, "UTF-8")
    cut = F.aggregate(F.sequence(F.lit(0), F.lit(3)), F.lit(None).cast("string"), lambda found, k: F.coalesce(found, _whole(F.substring(raw, F.octet_length(raw) - most + 1 + k, F.lit(most) - k))))
    return F.when(F.octet_length(text) > most, F.concat(F.lit(marker), cut)).otherwise(text)


def subtree_matches(path: Column, exact: Column | None = None, directory: Column | None = None) -> Column:
    """A path against an exact grant, or one of a directory and all below; the empty path, the root, needs a directory."""
    if exact is not None:
        return (path != "") & (path == exact)
    return (path == "") | (path == directory) | F.startswith(path, F.concat(directory, F.lit("/")))


def _port(url: Column) -> Column:
    port = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?[^/?#:]*:(\d+)", 1)
    scheme = F.lower(F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    return F.when(port != "", port).when(scheme == "https", "443").when(scheme == "http", "80").otherwise("")


def url_prefix_matches(prefix: Column, url: Column) -> Column:
    """Scheme, host and port alike, and the path below the prefix's by whole segments; queries don't count."""
    scheme = lambda x: F.lower(F.regexp_extract(x, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    host = lambda x: F.lower(F.regexp_extract(x, "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    path = lambda x: F.rtrim(F.regexp_extract(x, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)", 1), F.lit("/"))
    same = (scheme(prefix) != "") & (host(prefix) != "") & (scheme(prefix) == scheme(url)) & (host(prefix) == host(url)) & (_port(prefix) == _port(url))
    below = (path(prefix) == "") | (path(url) == path(prefix)) | F.startswith(path(url), F.concat(path(prefix), F.lit("/")))
    return F.coalesce(same & below, F.lit(False))


def grep_lines(text: Column, pattern: str, ignore_case: bool = False, most: int | None = None) -> Column:
    """(line, match) of the lines a pattern is found in, lines counted from 1; the first ``most``, if given."""
    wanted = ("(?i)" if ignore_case else "") + pattern
    lines = F.transform(F.split(text, "\n", -1), lambda x, i: F.struct((i + 1).alias("line"), x.alias("match")))
    found = F.filter(lines, lambda x: x["match"].rlike(wanted))
    return found if most is None else F.slice(found, 1, most)


def line_range(text: Column, offset: int = 1, limit: int = 2000) -> Column:
    """Lines ``offset`` (from 1) to ``offset + limit - 1`` of a text."""
    return F.array_join(F.slice(F.split(text, "\n", -1), offset, limit), "\n")
