"""Text functions for which Spark has no expression, as Arrow-batched functions over the standard library."""

from __future__ import annotations

import hashlib
import json
import math
import re
import unicodedata
from html.parser import HTMLParser

import numpy as np
import pandas as pd

from inkspark.functions.arrow import batched


@batched("string")
def nfc(text: pd.Series) -> pd.Series:
    """Canonical composition; ASCII and null pass as they are."""
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode(), np.uint8) if text.isascii() else np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def tail_period(text: str, least: int = 1, repeats: int = 3) -> int:
    """The shortest period whose block ends the text ``repeats`` times or more; 0 if there is none. Only periods at which the last
    characters of the blocks agree are compared."""
    n = len(text)
    ps = np.arange(least, n // repeats + 1)
    if not len(ps):
        return 0
    a = _codes(text)
    for back in (1, 2, 3):  # so many last characters, where the block has them
        for k in range(1, repeats):
            at = n - back - k * ps
            ps = ps[(ps < back) | (a[np.maximum(at, 0)] == a[n - back])]
    for p in ps.tolist():
        if all(text[n - (k + 1) * p : n - k * p] == text[n - p :] for k in range(1, repeats)):
            return p
    return 0


_SHORT, _GRAM = 64, 16  # periods below are compared over the whole text; codes of _GRAM characters find those above


def _same(text: str, a: int, b: int, back: bool = False) -> int:
    """How many characters from ``a`` and ``b`` on (or before them) agree, ``a`` before ``b``: slices that grow, then halve."""
    n, size = 0, 32
    most = a if back else len(text) - b
    while n < most:
        k = min(size, most - n)
        if (text[a - n - k : a - n] == text[b - n - k : b - n]) if back else (text[a + n : a + n + k] == text[b + n : b + n + k]):
            n, size = n + k, size * 2
        elif k == 1:
            break
        else:
            most, size = n + k - 1, max(1, k // 2)
    return n


def periodic_run(text: str) -> tuple[int, int, int]:
    """(repeats, period, start) of the block of any length that is repeated most in a row, (1, 0, 0) without any; ties to the longer
    block, then to the first place.

    A block of length p that comes k times in a row is a stretch of (k - 1) p characters that agree with those p later. Short
    periods are compared over the whole text. A stretch of a longer one holds a multiple of p with agreement over p after it
    (k > 2), or over half of p after or before it (k = 2): only multiples at which codes of characters agree are looked at,
    n log n in all, and each by exact comparison. Periods that can't reach the best so far are left out.
    """
    n, best, period, start = len(text), 1, 0, 0
    a = _codes(text)
    p = 1
    while p < _SHORT and p <= n // max(best, 2):
        if b"\1" * ((max(best, 2) - 1) * p) in (a[p:] == a[:-p]).tobytes():
            differ = np.flatnonzero(a[p:] != a[:-p])
            runs = (np.diff(differ, prepend=-1, append=n - p) - 1) // p + 1
            first = int(runs.argmax())
            best, period, start = int(runs[first]), p, int(differ[first - 1]) + 1 if first else 0
        p += 1
    if n // max(best, 2) < _SHORT:
        return best, period, start
    code, size = a.astype(np.uint64), 1
    while size < _GRAM:
        code = code[:-size] * np.uint64(pow(0x9E3779B97F4A7C15, size, 1 << 64)) + (code[size:] ^ (code[size:] >> np.uint64(29)))
        size *= 2
    found: list[tuple[np.ndarray, np.ndarray]] = []
    j = 0
    while (top := min(n // max(best, 2), (n - _GRAM) // (j + 1))) >= _SHORT:
        ps = np.arange(_SHORT, top + 1)
        at = j * ps
        hit = code[at] == code[at + ps]
        if best <= 2 and j:
            hit |= code[at - _GRAM] == code[at + ps - _GRAM]
        if hit.any():
            found.append((ps[hit], at[hit]))
        j += 1
    if best <= 2:  # the last multiple may have no room for a code after it
        ps = np.arange(_SHORT, n // 2 + 1)
        at = (n // ps - 1) * ps
        hit = code[at - _GRAM] == code[at + ps - _GRAM]
        hit &= at >= _GRAM
        found.append((ps[hit], at[hit]))
    if not found:
        return best, period, start
    ps, at = (np.concatenate(x) for x in zip(*found, strict=True))
    done = (0, 0)  # the period looked at and where its last stretch ends
    for i in np.lexsort((at, ps)):
        p, q = int(ps[i]), int(at[i])
        if p > n // max(best, 2):
            break
        if done[0] == p and q < done[1]:
            continue
        after = _same(text, q, q + p)
        before = _same(text, q, q + p, back=True)
        k = (after + before) // p + 1
        done = p, q + after
        if k >= 2 and (k, p) > (best, period):
            best, period, start = k, p, q - before
    return best, period, start


def repeated_block(text: str) -> tuple[int, int]:
    """(length, times) of the longest substring that occurs twice or more, overlaps included; (0, 0) where none does.

    Places get ranks by the 1, 2, 4, ... characters from them on, until no two are alike. Two places share the first L characters,
    for L between two of these lengths, if they share the ranks at both ends: so L is found by halving, all by sorting numbers.
    """
    a = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    ranks, size = [np.unique(a, return_inverse=True)[1].astype(np.int64)], 1

    def keys(length: int) -> np.ndarray:
        k = length.bit_length() - 1
        r = ranks[k]
        return r[: len(a) - length + 1] * (len(a) + 1) + r[length - (1 << k) : len(a) - (1 << k) + 1]

    def repeats(k: np.ndarray) -> bool:
        s = np.sort(k)
        return bool((s[1:] == s[:-1]).any())

    if not repeats(ranks[0]):
        return 0, 0
    while 2 * size < len(a) and repeats(k := keys_of(ranks[-1], size)):
        ranks.append(np.unique(k, return_inverse=True)[1].astype(np.int64))
        size *= 2
    low, high = size, min(2 * size, len(a))
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if repeats(keys(mid)) else (low, mid)
    return low, int(np.unique(keys(low), return_counts=True)[1].max())


def keys_of(ranks: np.ndarray, size: int) -> np.ndarray:
    """One number for the ranks of each two stretches of ``size`` that follow each other."""
    n = len(ranks)
    return ranks[: n - size] * (n + size + 1) + ranks[size:]


@batched("tail_period int, periodic_repeats int, periodic_block string, replacement_chars int")
def loops(text: pd.Series) -> pd.DataFrame:
    """Loop statistics of texts with white space squeezed."""
    rows = []
    for t in text:
        t = " ".join((t or "").split())
        repeats, period, start = periodic_run(t)
        rows.append((tail_period(t), repeats, t[start : start + period], t.count("�")))
    return pd.DataFrame(rows, columns=["tail_period", "periodic_repeats", "periodic_block", "replacement_chars"])


_HEADING = re.compile(r"^(#{1,6})\s+(.*?)\s*#*\s*$")


def split_sections(text: str) -> list[tuple[str, str]]:
    """(heading path, body) of the sections under ATX headings, in order; a heading without a body gives none. A heading's path
    is that of the headings above it in level."""
    out, path, body = [], [], []

    def close():
        b = "\n".join(body).strip("\n")
        if b.strip():
            out.append((" > ".join(path), b))
        body.clear()

    for line in text.splitlines():
        if m := _HEADING.match(line):
            close()
            del path[len(m[1]) - 1 :]
            path.append(m[2])
        else:
            body.append(line)
    close()
    return out


def split_oversized(paragraph: str, most: int) -> list[str]:
    """A paragraph in pieces of at most ``most`` characters: whole sentences as far as they fit, a longer sentence cut."""
    out, open_ = [], ""
    for s in re.split(r"(?<=[.!?])\s+", paragraph):
        while len(s) > most:
            if open_:
                out.append(open_)
                open_ = ""
            out.append(s[:most])
            s = s[most:]
        if open_ and len(open_) + 1 + len(s) > most:
            out.append(open_)
            open_ = s
        else:
            open_ = f"{open_} {s}" if open_ else s
    return [*out, open_] if open_ else out


def chunk(text: str, target: int = 800, most: int = 2000) -> list[tuple[str, str]]:
    """(heading path, chunk): whole paragraphs packed up to ``target``, a longer one alone, one above ``most`` cut; never across sections."""
    out = []
    for heading, body in split_sections(text):
        open_ = ""
        for p in (x.strip() for x in re.split(r"\n[ \t]*\n", body)):
            if not p:
                continue
            for q in split_oversized(p, most) if len(p) > most else [p]:
                if open_ and len(open_) + 2 + len(q) > target:
                    out.append((heading, open_))
                    open_ = q
                else:
                    open_ = f"{open_}\n\n{q}" if open_ else q
        if open_:
            out.append((heading, open_))
    return out


@batched("array<struct<heading:string,body:string>>")
def sections(text: pd.Series) -> pd.Series:
    return text.map(lambda t: [{"heading": h, "body": b} for h, b in split_sections(t or "")])


@batched("array<struct<heading:string,body:string>>")
def chunks(text: pd.Series) -> pd.Series:
    return text.map(lambda t: [{"heading": h, "body": b} for h, b in chunk(t or "")])


# Elements whose text is no content, and those that part blocks.
_SKIPPED = {"script", "style", "noscript", "template", "svg"}
_BLOCKS = {"address", "article", "aside", "blockquote", "br", "div", "dl", "dd", "dt", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "li", "main", "nav", "ol", "p", "pre", "section", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}


class _Visible(HTMLParser):
    """The words of a page; inside a skipped element nothing counts, not even the title."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.title: list[str] = []
        self.into = self.out
        self.skip = 0

    def _mark(self, tag: str, opens: bool) -> None:
        if tag == "title":
            self.into = self.title if opens else self.out
        elif tag in _BLOCKS:
            heading = opens and len(tag) == 2 and tag[1].isdigit()
            self.out.append("\n\n" + ("#" * int(tag[1]) + " " if heading else ""))

    def handle_starttag(self, tag, attrs):
        if tag in _SKIPPED:
            self.skip += 1
        elif not self.skip:
            self._mark(tag, True)

    def handle_endtag(self, tag):
        if tag in _SKIPPED:
            self.skip -= self.skip > 0
        elif not self.skip:
            self._mark(tag, False)

    def handle_data(self, data):
        if not self.skip:
            self.into.append(data)


def visible(markup: str) -> tuple[str, str]:
    """(title, text) of a page: headings as ATX, blocks parted by blank lines, scripts and styles out; broken markup never fails. The
    text is raw: normalizing it squeezes the blank lines."""
    p = _Visible()
    p.feed(markup)
    p.close()
    return "".join(p.title).strip(), "".join(p.out)


@batched("title string, text string")
def html_text(markup: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([visible(m or "") for m in markup], columns=["title", "text"])


def embed(tokens: list[str], dimension: int = 64, seed: str = "0") -> list[float]:
    """Counts of tokens in hashed buckets, of length 1; all zero without tokens."""
    v = [0.0] * dimension
    for t in tokens:
        h = hashlib.blake2b(f"{seed}\x00{t}".encode(), digest_size=8).digest()
        v[int.from_bytes(h, "big") % dimension] += 1.0
    norm = math.sqrt(sum(x * x for x in v))
    return [x / norm for x in v] if norm else v


@batched("array<double>")
def hash_embedding(text: pd.Series) -> pd.Series:
    return text.map(lambda t: embed(re.findall(r"\w+", (t or "").casefold())))


@batched("length int, times int")
def block(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([repeated_block(t or "") for t in text], columns=["length", "times"])


@batched("array<int>")
def piece_lengths(text: pd.Series) -> pd.Series:
    return text.map(lambda t: [len(p) for p in split_oversized(t or "", 2000)])


def compact(value, most: int = 8):
    """A report without its bulk: a list of more than ``most`` values is told by its length and the digest of its JSON; numbers, texts and
    what is short stay, at any depth."""
    if isinstance(value, dict):
        return {k: compact(v, most) for k, v in value.items()}
    if isinstance(value, list):
        if len(value) > most:
            body = json.dumps(value, ensure_ascii=False, separators=(",", ":"), sort_keys=True)
            return {"left_out": len(value), "sha256": hashlib.sha256(body.encode()).hexdigest()}
        return [compact(v, most) for v in value]
    return value


@batched("string")
def extract(report: pd.Series) -> pd.Series:
    """Reports in JSON, each without its bulk, keys in order."""
    return report.map(lambda r: None if r is None else json.dumps(compact(json.loads(r)), ensure_ascii=False, separators=(",", ":"), sort_keys=True))
