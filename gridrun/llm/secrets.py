"""Secret scan with a recursive decoding worklist.

A text is scanned, then what is encoded in it is unwrapped into layers: percent escapes and Unicode escapes in place,
into a layer of the whole text each, and every stretch of base64, over line ends too, and of gzip, zlib or bz2 data
under base64 into a layer of its own, which is scanned and searched for encoded stretches in turn. A layer
equal to one already seen on the way to it ends that branch, so the worklist reaches a fixpoint. Every layer carries
for each of its characters the stretch of the original text it came from; findings are reported there.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import re
import zlib
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gridrun.llm.common import SMALL_SLICE, slices

ASSIGN = re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # a run of 32 or more: runs are maximal
KINDS = ("assign", "access", "hex")
HINTS = ("password", "passwd", "secret", "token", "api")
#: Escapes that follow one another.
PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPES = re.compile(r"(?:\\(?:u[0-9A-Fa-f]{4}|x[0-9A-Fa-f]{2}))+")
ESCAPE = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|x([0-9A-Fa-f]{2}))")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: Base64 over several lines, and one line of it.
PIECE = re.compile(r"[A-Za-z0-9+/_-]+")
CHAIN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:[ \t]*+\r?\n[ \t]*+[A-Za-z0-9+/_-]++)+")
LEAST_BASE64 = 16
ODD = re.compile(r"[\x00-\x08\x0E-\x1F\x7F]")
MAX_LAYER = 64 * 1024 * 1024

Layer = tuple[str, np.ndarray, np.ndarray]
SCHEMA = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, end, kind number)`` of the base patterns; leftmost, not overlapping within a kind."""
    out = []
    low = text.lower() if ":" in text or "=" in text else ""
    if any(h in low for h in HINTS):
        out += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return out


def _text(data: bytes) -> str | None:
    """UTF-8 text without control characters, else None."""
    try:
        out = data.decode("utf-8")
    except UnicodeDecodeError:
        return None
    return None if ODD.search(out) or not out else out


def _chars(text: str) -> tuple[np.ndarray, np.ndarray]:
    """First byte of each character in UTF-8, and the byte after it."""
    data = np.frombuffer(text.encode("utf-8"), dtype=np.uint8)
    starts = np.flatnonzero((data & 0xC0) != 0x80)
    return starts, np.append(starts[1:], len(data))


def _in_place(text: str, runs: re.Pattern, decoded: Callable[[str], list[tuple[str, int, int]]]) -> Layer | None:
    """The whole text with its runs of escapes decoded to ``(character, start, end)``; None if there are none."""
    out, start, end, i = [], [], [], 0
    for m in runs.finditer(text):
        out.append(text[i : m.start()])
        start.append(np.arange(i, m.start()))
        end.append(start[-1] + 1)
        chars, a, b = zip(*decoded(m.group()), strict=True)
        out += chars
        start.append(np.array(a) + m.start())
        end.append(np.array(b) + m.start())
        i = m.end()
    if not out:
        return None
    start.append(np.arange(i, len(text)))
    end.append(start[-1] + 1)
    return "".join([*out, text[i:]]), np.concatenate(start), np.concatenate(end)


def _percent(run: str) -> list[tuple[str, int, int]]:
    """Bytes as UTF-8; a byte that is none becomes U+FFFD."""
    out, at = [], 0
    for c in bytes.fromhex(run.replace("%", "")).decode("utf-8", "surrogateescape"):
        n = len(c.encode("utf-8", "surrogateescape"))
        out.append(("\ufffd" if "\ud800" <= c <= "\udfff" else c, at, at + 3 * n))
        at += 3 * n
    return out


def _escapes(run: str) -> list[tuple[str, int, int]]:
    """A surrogate pair is one character, half of one becomes U+FFFD."""
    found = [(chr(int(m.group(1) or m.group(2), 16)), *m.span()) for m in ESCAPE.finditer(run)]
    out, k = [], 0
    while k < len(found):
        c, a, b = found[k]
        if "\ud800" <= c <= "\udbff" and k + 1 < len(found) and "\udc00" <= found[k + 1][0] <= "\udfff":
            c, b, k = (c + found[k + 1][0]).encode("utf-16", "surrogatepass").decode("utf-16"), found[k + 1][2], k + 1
        out.append(("\ufffd" if "\ud800" <= c <= "\udfff" else c, a, b))
        k += 1
    return out


def _compressed(data: bytes) -> bool:
    """Whether the first bytes are those of gzip, zlib or bz2 data."""
    return data[:2] == b"\x1f\x8b" or data[:3] == b"BZh" or (data[:1] == b"\x78" and len(data) > 2 and int.from_bytes(data[:2], "big") % 31 == 0)


def _inflated(data: bytes) -> tuple[bytes, int] | None:
    """Decompressed gzip, zlib or bz2 data, as far as MAX_LAYER bytes, and how many bytes it took; None if it is neither."""
    if not _compressed(data):
        return None
    try:
        one = bz2.BZ2Decompressor() if data[:3] == b"BZh" else zlib.decompressobj(31 if data[:1] == b"\x1f" else zlib.MAX_WBITS)
        out = one.decompress(data, MAX_LAYER)
        return out, len(data) - len(one.unused_data)
    except (zlib.error, OSError, EOFError, ValueError):
        return None


def _unwrapped(data: bytes) -> tuple[str, int] | None:
    """Text under compression, nested too, and how many bytes of ``data`` it took; None if there is none."""
    found, depth = _inflated(data), 0
    if found is None:
        return None
    wrapped, used = found
    while depth < 64 and (inner := _inflated(wrapped)) is not None:
        wrapped, depth = inner[0], depth + 1
    out = _text(wrapped)
    return None if out is None else (out, used)


def _base64(token: str) -> Layer | None:
    body = token.rstrip("=")
    if len(body) % 4 == 1:
        return None
    try:
        data = base64.b64decode(body.replace("-", "+").replace("_", "/") + "=" * (-len(body) % 4), validate=True)
    except ValueError:
        return None
    out = _text(data)
    if out is not None:
        first, after = _chars(out)
        return out, first // 3 * 4 + first % 3, np.minimum((after - 1) // 3 * 4 + (after - 1) % 3 + 2, len(token))
    found = _unwrapped(data)
    return None if found is None else (found[0], np.zeros(len(found[0]), dtype=np.int64), np.full(len(found[0]), len(token), dtype=np.int64))


def _bytes(body: str) -> bytes:
    body = body[: len(body) - (len(body) % 4 == 1)]
    return base64.b64decode(body.replace("-", "+").replace("_", "/") + "=" * (-len(body) % 4))


def _text_bytes(data: bytes) -> int:
    """How many bytes from the first are UTF-8 text without control characters."""
    try:
        out = data.decode("utf-8")
    except UnicodeDecodeError as e:
        out = data[: e.start].decode("utf-8")
    odd = ODD.search(out)
    return len((out[: odd.start()] if odd else out).encode("utf-8"))


def _lines(chain: str) -> Iterator[tuple[int, Layer]]:
    """Layers of base64 wrapped over lines of ``chain``: from a line on, as many lines as decode to text or compressed data."""
    spans = [m.span() for m in PIECE.finditer(chain)]
    body = "".join(chain[a:b] for a, b in spans)
    place = np.concatenate([np.arange(a, b) for a, b in spans])
    ends = np.cumsum([b - a for a, b in spans])
    i = 0
    while i < len(spans) - 1:
        first, last = int(ends[i]) - (spans[i][1] - spans[i][0]), i
        layer = None
        if _compressed(_bytes(body[first : first + 8])) and (found := _unwrapped(_bytes(body[first:]))) is not None:
            out, used = found
            last = min(int(np.searchsorted(ends, first + -(-used * 4 // 3))), len(spans) - 1)
            layer = out, np.full(len(out), place[first]), np.full(len(out), place[ends[last] - 1] + 1)
        else:
            size, valid = 64, 0
            while True:  # as far as it is text, in steps that double
                data = _bytes(body[first : first + size])
                valid = _text_bytes(data)
                if first + size >= len(body) or valid < len(data) - 3:
                    break
                size *= 2
            n = (ends[i:] - first) * 3 // 4
            whole = ((ends[i:] - first) % 4 != 1) & (n <= valid)
            after = np.append(np.frombuffer(data[:valid], dtype=np.uint8), 0)
            whole[whole] = (after[n[whole]] & 0xC0) != 0x80  # not within a character
            last = i + int(np.flatnonzero(whole)[-1]) if whole.any() else i
            if last > i and (out := data[: n[last - i]].decode("utf-8")):
                begin, stop = _chars(out)
                size = int(ends[last]) - first
                layer = out, place[first + begin // 3 * 4 + begin % 3], place[first + np.minimum((stop - 1) // 3 * 4 + (stop - 1) % 3 + 2, size) - 1] + 1
        if layer is not None and last > i and ends[last] - first >= LEAST_BASE64:
            yield 0, layer
        i = last + 1


def encoded(text: str) -> Iterator[tuple[str, int, Layer]]:
    """Encoded stretches: name of the coding, start in ``text``, and the layer with places relative to that start.

    Escapes are decoded in place, so that layer is the whole text.
    """
    if "%" in text and (layer := _in_place(text, PERCENT, _percent)) is not None:
        yield "url", 0, layer
    if "\\" in text and (layer := _in_place(text, ESCAPES, _escapes)) is not None:
        yield "unicode", 0, layer
    for m in BASE64.finditer(text):
        if (layer := _base64(m.group())) is not None:
            yield "base64", m.start(), layer
    if "\n" in text:
        for m in CHAIN.finditer(text):
            if m.end() - m.start() > LEAST_BASE64:
                for at, layer in _lines(m.group()):
                    yield "base64", m.start() + at, layer


def all_spans(text: str, base: list[tuple[int, int, int]]) -> set[tuple[int, int, int, str]]:
    """``(start, end, kind number, kind)`` in the original text over all layers; the base spans are among them."""
    found = {(s, e, k, KINDS[k]) for s, e, k in base}
    work: deque[tuple[Layer | None, str, tuple[str, ...], frozenset[str]]] = deque([(None, text, (), frozenset([text]))])
    known = {(s, e, k) for s, e, k in base}
    queued: set[tuple[str, int, int]] = set()
    while work:
        layer, here, path, seen = work.popleft()  # layers of few codings first
        if layer is not None:
            for s, e, k in base_spans(here):
                place = int(layer[1][s]), int(layer[2][e - 1]), k
                if path[-1] == "base64" or place not in known:  # decoding in place leaves the rest as it was
                    found.add((*place, ".".join((*path, KINDS[k]))))
                known.add(place)
        for coding, at, (inner, start, end) in encoded(here):
            if inner in seen or inner == here:
                continue  # a cycle: nothing new below
            if layer is None:
                places = (inner, start + at, end + at)
            else:
                places = (inner, layer[1][start + at], layer[2][np.maximum(end + at - 1, 0)])
            if (key := (inner, int(places[1][0]), int(places[2][-1]))) in queued:
                continue  # the same stretch of the original, by another way
            queued.add(key)
            work.append((places, inner, (*path, coding), seen | {inner}))
    return found


def scan_text(text: str | None) -> tuple[int, int, int, str, str, list[tuple[int, int]]]:
    """Counts by kind, digest of the base spans, all spans written out, and the places of all spans."""
    text = text or ""
    base = sorted(base_spans(text), key=lambda x: (x[0], x[2]))
    spans = sorted(all_spans(text, base), key=lambda x: (x[0], x[2], x[3], x[1]))
    written = ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in base)
    counts = [sum(k == i for _, _, k in base) for i in range(3)]
    return (*counts, hashlib.sha256(written.encode()).hexdigest(), ",".join(f"{kind}:{s}:{e}" for s, e, _, kind in spans), [(s, e) for s, e, _, _ in spans])


def scan_secrets(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: counts of base finds, their digest, and all spans (``layer.kind:start:end``).

    Places are code points of the original text, end exclusive. A find in a decoded layer is named by the codings on
    the way to it; under base64 its place is exact to the character, under compression it is the whole stretch. A
    find that decoding in place leaves as it was is not named again. An escaped byte that is no UTF-8 counts as U+FFFD;
    base64 that is no UTF-8 text, or holds control characters, is not unwrapped further. Decompression stops at
    MAX_LAYER bytes (a safeguard against decompression bombs). Null is an empty text; very long texts are
    scanned whole. No rows in, no rows out; further columns are ignored.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, chars=SMALL_SLICE):
            rows = list(zip(*(scan_text(t)[:5] for t in texts), strict=True))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), *[pa.array(x, type=k) for x, k in zip(rows, kinds, strict=True)]], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select("doc_id", "text").mapInArrow(scan, SCHEMA)


def redacted(text: str | None, mark: str = "[SECRET]") -> str | None:
    """The text with every span, overlapping ones united, replaced by ``mark``."""
    spans = scan_text(text)[5]
    if not spans:
        return text
    out, at = [], 0
    spans.sort()
    start, end = spans[0]
    for s, e in [*spans[1:], (len(text) + 1, len(text) + 1)]:
        if s <= end:
            end = max(end, e)
            continue
        out += [text[at:start], mark]
        at, start, end = end, s, e
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with the spans of its texts replaced and, where there is such a column, ``n_chars`` brought up to date."""
    names = docs.columns

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, chars=SMALL_SLICE):
            new = [redacted(t, mark) for t in texts]
            columns = {n: part.column(n) for n in names}
            columns["text"] = pa.array(new, type=part.schema.field("text").type)
            if "n_chars" in columns:
                was = columns["n_chars"].to_pylist()
                columns["n_chars"] = pa.array([w if t == o or t is None else len(t) for w, t, o in zip(was, new, texts, strict=True)], type=part.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=names)

    return docs.mapInArrow(scan, docs.schema)
