"""Text columns: normalization, words, n-grams, claims, references, digests. Built-in expressions throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Separators of identity parts, and lengths of short digests.
UNIT = "\x1f"
SHORT = 16


def line_endings(text: Column) -> Column:
    """CRLF and CR as LF; nothing else changes."""
    return F.regexp_replace(text, "\r\n?", "\n")


def normal_document(text: Column) -> Column:
    """LF line ends, no blanks at line ends, one blank line at most between paragraphs, no outer newlines.

    Composition to NFC is a separate step (:func:`inkspark.functions.udfs.nfc`), since Spark has no expression for it.
    """
    t = F.regexp_replace(line_endings(text), "(?md)[ \t]+$", "")
    return F.regexp_replace(F.regexp_replace(t, "\n{3,}", "\n\n"), r"\A\n+|\n+\z", "")


def normal_query(text: Column) -> Column:
    """White space runs as one blank, trimmed, without a closing run of ``?!.;:,``."""
    return F.trim(F.regexp_replace(F.trim(F.regexp_replace(text, "[ \t\n\r]+", " ")), r"[?!.;:,]+$", ""))


def folded(text: Column) -> Column:
    """Lower case with sharp s written out: case folding for the texts at hand."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def words(text: Column) -> Column:
    """Runs of letters, digits and underscores, case-folded."""
    return F.regexp_extract_all(folded(text), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))


def words_lower(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))


def words_apostrophe(text: Column) -> Column:
    """Lower-case words in which straight and curly apostrophes are kept."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_'’]+)"), F.lit(1))


def blank_tokens(text: Column) -> Column:
    """Parts between white space, case kept."""
    return F.regexp_extract_all(text, F.lit("([^ \t\n\r]+)"), F.lit(1))


def planner_tokens(text: Column) -> Column:
    """Distinct case-folded tokens between white space, letters and digits only."""
    bare = F.transform(blank_tokens(folded(text)), lambda t: F.regexp_replace(t, r"[^\p{L}\p{N}]", ""))
    return F.array_distinct(F.filter(bare, lambda t: t != ""))


def let(value: Column, f) -> Column:
    """f(value) with ``value`` computed once: a lambda would compute what it captures anew for every element."""
    return F.element_at(F.transform(F.array(value), f), 1)


def grams(tokens: Column, n: int, by: str = " ") -> Column:
    """All runs of n tokens in order, joined; empty below n tokens."""

    def runs(t: Column) -> Column:
        at = F.when(F.size(t) >= n, F.sequence(F.lit(1), F.size(t) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.array_join(F.slice(t, i, n), by))

    return let(tokens, runs)


def windows(tokens: Column, n: int) -> Column:
    """All runs of n tokens in order, as arrays; empty below n tokens."""

    def runs(t: Column) -> Column:
        at = F.when(F.size(t) >= n, F.sequence(F.lit(1), F.size(t) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.slice(t, i, n))

    return let(tokens, runs)


def shingles(text: Column, n: int = 5) -> Column:
    """The set of runs of n tokens between white space."""
    return F.array_distinct(grams(blank_tokens(text), n))


def chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def char_repetition(text: Column, n: int, least: int = 4) -> Column:
    """1 - distinct / all character n-grams; null below ``least`` grams."""
    k = F.char_length(text) - n + 1

    def ratio(c: Column) -> Column:
        g = F.transform(F.sequence(F.lit(1), F.size(c) - n + 1), lambda i: F.array_join(F.slice(c, i, n), ""))
        return 1 - F.size(F.array_distinct(g)) / F.size(g)

    return F.when(k >= least, let(chars(text), ratio))


def distinct_ratio(tokens: Column, n: int, least: int = 8) -> Column:
    """Distinct / all word n-grams; null below max(least, n) words."""
    return let(tokens, lambda t: F.when(F.size(t) >= max(least, n), F.size(F.array_distinct(grams(t, n))) / (F.size(t) - n + 1)))


def sentences(text: Column) -> Column:
    """Sentences as claims: parted after ``.``, ``!`` or ``?`` with white space behind, trimmed, none empty."""
    parts = F.split(text, r"(?<=[.!?])[ \t\n\r]+")
    return F.filter(F.transform(parts, lambda s: F.regexp_replace(s, r"^[ \t\n\r]+|[ \t\n\r]+$", "")), lambda s: s != "")


def references(text: Column) -> Column:
    """Identifiers of sources and chunks that a text cites, in order, each once."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit("((?:src|chk)_[0-9a-fA-F]{4,})"), F.lit(1)))


def sha(text: Column) -> Column:
    return F.sha2(text, 256)


def short_sha(*parts: Column) -> Column:
    """The first digits of the digest of parts joined by the unit separator."""
    return F.substring(F.sha2(F.concat_ws(UNIT, *parts), 256), 1, SHORT)


def source_id(reference: Column, content: Column) -> Column:
    return F.concat(F.lit("src_"), short_sha(reference, sha(content)))


def chunk_id(source: Column, position: Column, text: Column) -> Column:
    return F.concat(F.lit("chk_"), short_sha(source, position.cast("string"), text))


def claim_id(answer: Column, position: Column, text: Column) -> Column:
    return F.concat(F.lit("clm_"), short_sha(answer, position.cast("string"), text))


def valid_id(c: Column, prefix: str) -> Column:
    return c.rlike(f"^{prefix}_[0-9a-f]{{{SHORT}}}$")


def reassessment(message: Column) -> Column:
    """no_target, explicit or ambiguous, by the number of different answers that a message names."""
    n = F.size(F.array_distinct(F.regexp_extract_all(message, F.lit(r"\b(ans_[0-9a-f]{16})\b"), F.lit(1))))
    return F.when(n == 0, "no_target").when(n == 1, "explicit").otherwise("ambiguous")


# Query parameters that only track (beside all that begin with utm_).
TRACKING = ["fbclid", "gclid", "dclid", "msclkid", "igshid", "mc_cid", "mc_eid", "ref", "ref_src", "referrer", "source", "spm", "yclid", "_ga", "_gl"]


def _encoded_path(path: Column) -> Column:
    """A path with all but plain and reserved characters and escapes percent-encoded."""
    fine = r"[A-Za-z0-9/%:@!$&'()*+,;=~._-]"
    each = F.transform(chars(path), lambda c: F.when(c.rlike(fine), c).otherwise(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))))
    return F.when(path.rlike(f"^{fine}*$"), path).otherwise(F.array_join(each, ""))


def canonical_url(url: Column) -> Column:
    """A web address in one form; null if it isn't http(s), has no host or carries credentials.

    Scheme and host in lower case, no default port, root dot, fragment or tracking parameter; parameters decoded and sorted by name
    and value, one without a value kept as ``name=``; no slash at the end of a path but the root, which an empty path becomes.
    """
    u = F.regexp_replace(url, r"^\s+|\s+$", "")
    scheme = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    authority = F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    host = F.regexp_replace(F.lower(F.regexp_extract(authority, r"^(\[[^\]]*\]|[^:]*)", 1)), r"\.$", "")
    port = F.regexp_extract(authority, r":([0-9]+)$", 1)
    path = F.nullif(F.regexp_replace(F.regexp_extract(u, r"^[^:]+://[^/?#]*([^?#]*)", 1), "/+$", ""), F.lit(""))
    query = F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1)
    plain = lambda p: F.coalesce(F.try_url_decode(p), p)
    pairs = F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), lambda p: F.struct(plain(F.substring_index(p, "=", 1)).alias("name"), plain(F.when(p.contains("="), F.substring(p, F.length(F.substring_index(p, "=", 1)) + 2, F.length(p))).otherwise("")).alias("value")))
    kept = F.filter(pairs, lambda p: ~F.lower(p["name"]).startswith("utm_") & ~F.lower(p["name"]).isin(TRACKING))
    shown = F.array_join(F.transform(F.array_sort(kept), lambda p: F.concat(p["name"], F.lit("="), p["value"])), "&")
    default = ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443")) | (port == "")
    out = F.concat(scheme, F.lit("://"), host, F.when(default, "").otherwise(F.concat(F.lit(":"), port)), _encoded_path(F.coalesce(path, F.lit("/"))), F.when(shown == "", "").otherwise(F.concat(F.lit("?"), shown)))
    return F.when(scheme.isin("http", "https") & ~authority.contains("@") & (host != ""), out)


def url_host(url: Column) -> Column:
    return F.nullif(F.regexp_extract(canonical_url(url), r"^https?://(\[[^\]]*\]|[^/:?]+)", 1), F.lit(""))


def scheme_allowed(url: Column, schemes: tuple[str, ...] = ("https",)) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)).isin(*schemes)


def blocked_host(host: Column) -> Column:
    """Names of this machine or of a metadata service, and literal addresses that aren't global."""
    h = F.lower(F.regexp_replace(host, r"^\[|\]$|\.+$", ""))
    n = [F.regexp_extract(h, r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$", i).try_cast("int") for i in (1, 2, 3, 4)]
    a, b, c, _ = n
    private = a.isin(0, 10, 127) | (a >= 224) | ((a == 100) & b.between(64, 127)) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 192) & (b == 0) & c.isin(0, 2)) | ((a == 198) & b.isin(18, 19)) | ((a == 198) & (b == 51) & (c == 100)) | ((a == 203) & (b == 0) & (c == 113))
    named = h.isin("localhost", "metadata", "metadata.google.internal", "localhost.localdomain") | h.endswith(".localhost") | h.endswith(".local") | h.endswith(".internal")
    # global unicast is 2000::/3 without 2001::/23 (but for the parts of it that are global), 2001:db8::/32 and 2002::/16
    local = h.rlike("^(2001:(:|0{0,2}[0-9a-f]{1,2}:|0?1[0-9a-f]{2}:|0?db8:)|2002:)") & ~h.rlike("^2001:(0{0,3}1::[12]$|0{0,3}3:|0{0,3}4:0?112:|0{0,2}[23][0-9a-f]:)")
    six = h.contains(":") & (~h.rlike("^[23][0-9a-f]{3}:") | local)
    return F.coalesce(named | six | F.coalesce(private, F.lit(False)), F.lit(True))


def safe_terminal(text: Column) -> Column:
    """Control characters but tab and newline, and the controls of writing direction, shown as ``?``."""
    return F.regexp_replace(text, "[\\x00-\\x08\\x0b-\\x1f\\x7f-\\x9f\\u200e\\u200f\\u202a-\\u202e\\u2066-\\u2069\\u061c]", "?")


def header_field(text: Column, name: str) -> Column:
    """The value of a ``Name:`` line; empty if there is none."""
    return F.trim(F.regexp_extract(text, f"(?m)^{name}:(.*)$", 1))


def strip_wrappers(text: Column) -> Column:
    """The body between the START and END marker lines, without outer newlines, one newline at its end; null without both, in order."""
    body = F.regexp_extract(line_endings(text), r"(?s)(?:^|\n)\*\*\* ?START OF[^\n]*\n(.*?)\n\*\*\* ?END OF", 1)
    return F.when(body != "", F.concat(F.regexp_replace(body, r"\A\n+|\n+\z", ""), F.lit("\n")))


def paragraph_documents(text: Column, most: int = 16_384) -> Column:
    """Documents of whole paragraphs, filled greedily up to ``most`` characters; a longer paragraph is one of its own, never cut."""
    paragraphs = F.filter(F.transform(F.split(line_endings(text), "\n[ \t]*\n"), lambda p: F.regexp_replace(p, r"^[ \t\n]+|[ \t\n]+$", "")), lambda p: p != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(acc, p):
        fits = (acc["open"] != "") & (F.char_length(acc["open"]) + 2 + F.char_length(p) <= most)
        return F.when(acc["open"] == "", F.struct(acc["done"].alias("done"), p.alias("open"))).when(fits, F.struct(acc["done"].alias("done"), F.concat(acc["open"], F.lit("\n\n"), p).alias("open"))).otherwise(F.struct(F.array_append(acc["done"], acc["open"]).alias("done"), p.alias("open")))

    return F.aggregate(paragraphs, start, step, lambda acc: F.when(acc["open"] == "", acc["done"]).otherwise(F.array_append(acc["done"], acc["open"])))
