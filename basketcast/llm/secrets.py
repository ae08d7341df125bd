"""Secret scan with a recursive decoding worklist.

Every text is scanned as it stands (the base layer), then unwrapped: percent escapes,
Unicode and character-reference escapes, base64 runs, and compressed data inside any of
them.  Each layer that an unwrapping gives is put on a worklist, scanned with the same
patterns and unwrapped in turn, until no layer is new (a layer already seen for the
same place in the text is not entered again, which ends cycles).  A finding in a layer
is mapped back to the place in the original text that it came from: character by
character through escapes, to the whole run through base64 and compression.

Kinds: ``assign`` (a named credential and its value), ``access`` (an access key id),
``hex`` (a long hexadecimal run).  Offsets are code points, ends exclusive.  A null or
empty text has no findings; every row is scanned on its own, so repeated rows and ids
give one result each; an empty frame gives an empty result.

The worklist is a stack of generators, so layers may nest to any depth.  An escape of escaped marks (%252541) is
unwrapped in one pass, however often it was escaped.  Base64 in lines of any one length is one run.

A decompressed layer of up to ``max_layer`` bytes is held whole.  A larger one (a decompression
bomb) goes over the worklist as windows of that size, each overlapping half of the one before and
done with before the next is inflated, so memory stays bounded.  A compressed string inside that passes the
end of its window is read on from the stream, to its own end; a base64 run longer than half a window is
unwrapped in pieces.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from basketcast.llm.text import id_text, map_rows

# The patterns and least lengths of the three kinds.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # greedy from a run's first AKIA: as AKIA[A-Z0-9]+ of 20+ characters
HEX = re.compile(r"[0-9a-f]{24,}")         # whole runs: as [0-9a-f]+ of 24+ characters
ASSIGN_LEAST = 6

# An escape may hide behind its own escaped mark any number of times (%2541, \u005cu0041, &#38;#65;): one match.
_URL_AGAIN = r"%(?:25)*"
_UNICODE_AGAIN = r"\\(?:u005[cC]|x5[cC]|u\{5[cC]\}|U0000005[cC])*"
_REFERENCE_AGAIN = r"&(?:amp;|#0*38;|#[xX]0*26;)*"
_ESCAPED_URL = re.compile(rf"{_URL_AGAIN}[0-7][0-9A-Fa-f]|(?:{_URL_AGAIN}[89A-Fa-f][0-9A-Fa-f])+")
_ESCAPED_UNICODE = re.compile(
    rf"{_UNICODE_AGAIN}u([dD][89abAB][0-9A-Fa-f]{{2}}){_UNICODE_AGAIN}u([dD][c-fC-F][0-9A-Fa-f]{{2}})"
    rf"|{_UNICODE_AGAIN}(u[0-9A-Fa-f]{{4}}|u\{{[0-9A-Fa-f]{{1,6}}\}}|U[0-9A-Fa-f]{{8}}|x[0-9A-Fa-f]{{2}})"
    rf"|{_REFERENCE_AGAIN}#([0-9]{{1,7}}|[xX][0-9A-Fa-f]{{1,6}});")
_URL_BYTE = re.compile(rf"{_URL_AGAIN}([0-9A-Fa-f]{{2}})")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_BASE64_LINE = re.compile(r"(?<![A-Za-z0-9+/])([A-Za-z0-9+/]{4,}+)\r?\n")
_BASE64_LAST = re.compile(r"([A-Za-z0-9+/]+)={0,2}")
_LATIN = re.compile(r"[\x00-\xff]+")
_CONTROL = re.compile(r"[\x00-\x08\x0e-\x1f\x7f]")
_MAGIC = re.compile(rb"\x1f\x8b\x08|x[\x01\x5e\x9c\xda]|BZh[1-9]|\xfd7zXZ|\x28\xb5\x2f\xfd")
_MAGIC_TEXT = re.compile(_MAGIC.pattern.decode("latin-1"))
_PRINTABLE = re.compile(rb"[\t\n\r\x20-\x7e]*")
_WIDE_LE, _WIDE_BE = re.compile(rb"(?:[\t-\x7e]\x00){6}"), re.compile(rb"(?:\x00[\t-\x7e]){6}")
_UNWRAPS = re.compile(r"[A-Za-z0-9+/_-]{16}|%[0-9A-Fa-f]{2}|\\[uUx][0-9A-Fa-f{]{2}|&#[0-9xX]")
# Escapes that stand for single bytes, plain characters between them for themselves: for compressed data.
_SHORT = {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f", "v": "\v", "a": "\a", "0": "\0"}
_NAMED = {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"'}
_BYTE_VIEWS = (
    ("%", re.compile(r"%[0-9A-Fa-f]{2}"), lambda m: chr(int(m.group()[1:], 16))),
    ("%", re.compile(r"%[0-9A-Fa-f]{2}|\+"), lambda m: " " if m.group() == "+" else chr(int(m.group()[1:], 16))),
    ("\\", re.compile(r"\\x[0-9A-Fa-f]{2}|\\u00[0-9A-Fa-f]{2}|\\u\{[0-9A-Fa-f]{1,2}\}|\\[^xuU]"),
     lambda m: chr(int(m.group()[2:].strip("{}"), 16)) if m.group()[1] in "xu" else _SHORT.get(m.group()[1], m.group()[1])),
    ("&", re.compile(r"&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};|&(?:amp|lt|gt|quot);"),
     lambda m: _reference(m)))

Span = tuple[int, int]
MAX_LAYER = 32 << 20
_WINDOW = 1 << 20


def scan(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind number, end)`` of the findings in one layer."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    return found + [(m.start(), 2, m.end()) for m in HEX.finditer(text)]


def _url(m: re.Match) -> str:
    return bytes.fromhex("".join(_URL_BYTE.findall(m.group()))).decode("utf-8", "replace")


def _character(code: int) -> str:
    return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else "�"


def _unicode(m: re.Match) -> str:
    high, low, one, reference = m.groups()
    if high:
        return bytes.fromhex(high + low).decode("utf-16-be")
    if one:
        return _character(int(one[1:].strip("{}"), 16))
    return _character(int(reference[1:], 16) if reference[0] in "xX" else int(reference))


def _reference(m: re.Match) -> str:
    s = m.group()
    return _NAMED.get(s) or _character(int(s[3:-1], 16) if s[2] in "xX" else int(s[2:-1]))


class Origin:
    """Where the characters of a layer stand in the original text: all at one ``place``, or one by one but for
    ``runs`` (start, end, old start, old end) that stand for other characters."""

    def __init__(self, place: Span | None = None, runs: tuple[list[int], ...] = ([], [], [], [])):
        self.place, self.runs = place, runs

    def _side(self, x: int, end: int) -> int:
        start, stop, old, old_stop = self.runs
        k = bisect_right(start, x) - 1
        if k < 0:
            return x + end
        if x < stop[k]:
            return old_stop[k] if end else old[k]
        return x - stop[k] + old_stop[k] + end

    def span(self, start: int, end: int) -> Span:
        return self.place or (self._side(start, 0), self._side(end - 1, 1))

    def after(self, step: tuple[list[int], ...]) -> Origin:
        """Of the layer that replaces runs of this one: ``step`` has their new start and end, and start and end here."""
        if self.place:
            return self
        out: tuple[list[int], ...] = ([], [], [], [])
        start, stop, old, old_stop = self.runs
        k, shift = 0, 0

        def add(*values: int) -> None:
            for part, v in zip(out, values, strict=True):
                part.append(v)

        def carry(upto: int | None) -> None:
            """Runs of this layer before ``upto`` go along, moved."""
            nonlocal k
            while k < len(start) and (upto is None or start[k] < upto):
                low, high = max(start[k], done), stop[k] if upto is None else min(stop[k], upto)
                if low < high:
                    add(low + shift, high + shift, old[k], old_stop[k])
                if upto is not None and stop[k] > upto:
                    return
                k += 1

        done = 0
        for new_start, new_stop, a, b in zip(*step, strict=True):
            carry(a)
            add(new_start, new_stop, *self.span(a, b))
            done, shift = b, new_stop - b
        carry(None)
        return Origin(None, out)


def unescape(text: str, pattern: re.Pattern, value: Callable[[re.Match], str]) -> tuple[str, tuple[list[int], ...]] | None:
    """The text with its escapes replaced, and the replaced runs: start and end in the new text, and in ``text``."""
    parts, at, size = [], 0, 0
    step: tuple[list[int], ...] = ([], [], [], [])
    for m in pattern.finditer(text):
        plain, new = text[at:m.start()], value(m)
        parts += (plain, new)
        at = m.end()
        for part, v in zip(step, (size + len(plain), size + len(plain) + len(new), m.start(), at), strict=True):
            part.append(v)
        size += len(plain) + len(new)
    if not at:
        return None
    parts.append(text[at:])
    return "".join(parts), step


_PIECE = 64


def _stream(data: bytes):
    if data.startswith(b"\x28\xb5\x2f\xfd"):
        return zstandard.ZstdDecompressor().decompressobj()
    if data.startswith(b"BZh"):
        return bz2.BZ2Decompressor()
    return lzma.LZMADecompressor() if data.startswith(b"\xfd7zXZ") else zlib.decompressobj(47)


class Feed:
    """Bytes read by position; ``more`` gives further pieces, so what lies behind need not be held."""

    def __init__(self, data: bytes | None, more: Iterator[bytes] | None = None):
        self.data, self.more, self.ended = bytearray() if data is None else data, more, more is None

    def grow(self) -> bool:
        if not self.ended:
            piece = next(self.more, None)
            if piece is not None:
                self.data += piece
                return True
            self.ended = True
        return False

    def drop(self, size: int) -> None:
        del self.data[:size]


class Inflater:
    """Pieces of the data inside the compressed string at ``start`` of a feed, all its members or frames; ends at the
    first damage. ``used``: bytes read, to the end of the last whole member or, with damage, to within a few
    bytes of it. What it has read of a feed with more to come is dropped (``dropped`` bytes)."""

    def __init__(self, feed: Feed | bytes, start: int = 0):
        self.feed = Feed(feed) if isinstance(feed, bytes) else feed
        self.start, self.used, self.dropped, self.whole = start, 0, 0, False

    def _upto(self, at: int) -> bool:
        """Whether the feed has a byte at ``at``."""
        while at >= len(self.feed.data):
            if not self.feed.grow():
                return False
        return True

    def __iter__(self) -> Iterator[bytes]:
        at, feed = self.start, self.feed
        while self._upto(at) and _MAGIC.match(feed.data, at):
            stream = _stream(feed.data[at:at + 8])
            limited = not feed.data.startswith(b"\x28\xb5\x2f\xfd", at)  # a piece of a zstd frame is at most 16 blocks
            try:
                while not stream.eof and self._upto(at):
                    piece = feed.data[at:at + _PIECE]
                    at += len(piece)
                    self.used = self.dropped + at - self.start
                    while True:
                        out = stream.decompress(piece, _WINDOW) if limited else stream.decompress(piece)
                        if out:
                            yield out
                        piece = getattr(stream, "unconsumed_tail", b"")
                        if stream.eof or not (piece or limited and len(out) == _WINDOW):
                            break
                    if not feed.ended and at > _WINDOW:
                        feed.drop(at - _PIECE)
                        self.dropped += at - _PIECE
                        at = _PIECE
            except (zlib.error, OSError, EOFError, lzma.LZMAError, zstandard.ZstdError):
                return
            if not stream.eof:
                return
            at -= len(stream.unused_data)
            self.used, self.whole = self.dropped + at - self.start, True
            while self._upto(at) and feed.data[at] == 0:  # padding between members
                at += 1


def inflated_whole(data: bytes, limit: int) -> bytes | None:
    """The inner data of up to ``limit`` bytes if ``data`` is one intact compressed string and nothing else."""
    if not _MAGIC.match(data) or data.startswith(b"\x28\xb5\x2f\xfd"):  # zstd gives no bounded reading in one go
        return None
    stream = _stream(data[:8])
    try:
        inner = stream.decompress(data, limit)
    except (zlib.error, OSError, EOFError, lzma.LZMAError):
        return None
    return inner if stream.eof and not stream.unused_data else None


def as_text(data: bytes) -> str | None:
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        return None
    return None if _CONTROL.search(text) else text


def damaged_texts(data: bytes) -> Iterator[str]:
    """Readings of bytes that are no clean text: UTF-8 with the damage replaced, UTF-16 from its first run; only
    those with a finding or something to unwrap."""
    readings = [data.decode("utf-8", "replace")]
    if b"\0" in data:
        le, be = _WIDE_LE.search(data), _WIDE_BE.search(data)
        first = min((m for m in (le, be) if m), key=lambda m: m.start(), default=None)
        if first:
            readings.append(data[first.start():].decode("utf-16-le" if first is le else "utf-16-be", "replace"))
    for text in readings:
        if _UNWRAPS.search(text) or scan(text):
            yield text


def next_compressed(data: bytes, at: int) -> int | None:
    """Where the next string that may be compressed begins."""
    while m := _MAGIC.search(data, at):
        head = data[m.start():m.start() + 64]
        if not _PRINTABLE.fullmatch(head) or head.startswith(b"BZh"):
            return m.start()
        at = m.start() + 1  # plain text
    return None


def base64_runs(text: str) -> Iterator[Span]:
    """Runs of base64 characters, and lines of one length that are one run together with the shorter line after them."""
    lines = []
    for m in _BASE64_LINE.finditer(text):
        if lines and (m.start() != lines[-1].end() or len(m[1]) != len(lines[-1][1])):
            yield from _joined(text, lines)
            lines = []
        lines.append(m)
    yield from _joined(text, lines)
    for m in _BASE64.finditer(text):
        yield m.span()


def _joined(text: str, lines: list[re.Match]) -> Iterator[Span]:
    if lines:
        last = _BASE64_LAST.match(text, lines[-1].end())
        end = last.end() if last and len(last[1]) <= len(lines[0][1]) else lines[-1].end(1)
        if len(lines) > 1 or end > lines[-1].end(1):
            yield lines[0].start(), end


def _readings(run: str) -> Iterator[bytes]:
    """Bytes a base64 run may stand for: from its start, else from one of the next three places."""
    body = re.sub(r"[\r\n=]", "", run).replace("-", "+").replace("_", "/")
    for skip in range(4):
        part = body[skip:]
        part = part[:len(part) - (len(part) % 4 == 1)]
        try:
            yield base64.b64decode(part + "=" * (-len(part) % 4))
        except (binascii.Error, ValueError):
            continue


Found = tuple[int, int, int]
Layer = tuple[str | bytes, Origin]


class Scanner:
    """All findings of one text, with spans in that text.

    Layers to come are a stack of generators, however deep they nest; each gives its next layer only when all
    that lies inside the one before is done. A generator marks its last layer, so that it is gone, with all it
    holds, before that layer is entered.
    """

    def __init__(self, max_layer: int = MAX_LAYER):
        self.max_layer = max_layer

    def text_layers(self, layer: str, origin: Origin) -> Iterator[tuple[Layer, bool]]:
        """What a text layer unwraps to: decoded and compressed runs first, its escapes last."""
        for start, end in base64_runs(layer):
            place = Origin(origin.span(start, end))
            for data in _readings(layer[start:end]):
                yield (data, place), False
        views = [(layer, None)]
        views += [v for mark, pattern, value in _BYTE_VIEWS if mark in layer and (v := unescape(layer, pattern, value))]
        for view, step in views:
            for run in _LATIN.finditer(view) if _MAGIC_TEXT.search(view) else ():
                data, at = run.group().encode("latin-1"), 0
                while (at := next_compressed(data, at)) is not None:
                    part = Inflater(data, at)
                    for _ in part:  # once to its end, which gives the place
                        pass
                    low = run.start() + at
                    span = low, low + max(part.used, 1)
                    if step is not None:
                        span = Origin(None, step).span(*span)
                    for inner in self.windows(Inflater(data, at)):
                        yield (inner, Origin(origin.span(*span))), False
                    at += part.used if part.whole and part.used else 1
        escaped = []
        for mark, pattern, value in (("%", _ESCAPED_URL, _url), ("\\", _ESCAPED_UNICODE, _unicode), ("&", _ESCAPED_UNICODE, _unicode)):
            if mark in layer and (pattern is not _ESCAPED_UNICODE or not escaped or escaped[-1][0] is not pattern) \
                    and (plain := unescape(layer, pattern, value)):
                escaped.append((pattern, plain[0], origin.after(plain[1])))
        del layer, views
        while escaped:
            _, new, back = escaped.pop(0)
            yield (new, back), not escaped

    def bytes_layers(self, data: bytes, origin: Origin) -> Iterator[tuple[Layer, bool]]:
        """Text layers in decoded bytes: as they stand, or inside compression."""
        if (text := as_text(data)) is not None:
            yield (text, origin), True
            return
        inner = inflated_whole(data, self.max_layer)
        if inner is not None:
            data = None
            yield (inner, origin), True
            return
        for text in damaged_texts(data):
            yield (text, origin), False
        at = 0
        while (at := next_compressed(data, at)) is not None:
            part = Inflater(data, at)
            for inner in self.windows(part):
                yield (inner, origin), False
            at += part.used if part.whole and part.used else 1

    def windows(self, stream: Inflater) -> Iterator[bytes | Feed]:
        """The data inside a compressed string: whole, or in windows where it is too large to hold. A compressed
        string inside that passes the end of its window is given as a feed that reads on."""
        pieces = iter(stream)
        feed = Feed(None, pieces)
        while True:
            grown = False
            while len(feed.data) <= self.max_layer and feed.grow():
                grown = True
            if feed.ended:
                if grown or feed.data:
                    yield bytes(feed.data)
                return
            data = bytes(feed.data)
            yield data
            at, half = 0, len(data) - self.max_layer // 2
            while (at := next_compressed(data, at)) is not None:
                part = Inflater(data, at)
                for _ in part:
                    pass
                if at + part.used < len(data) - _PIECE:  # it ends inside the window, which has read it
                    at += part.used if part.whole and part.used else 1
                    continue
                feed.drop(at)
                yield feed  # read by the layer made of it; what it leaves is read on from here
                half = 0
                break
            data = None
            feed.drop(max(half, 0))
            if half:
                size = len(feed.data)
                while len(feed.data) == size and feed.grow():
                    pass
                if feed.ended and len(feed.data) == size:
                    return

    def feed_layers(self, feed: Feed, origin: Origin) -> Iterator[tuple[Layer, bool]]:
        part = Inflater(feed)
        for inner in self.windows(part):
            yield (inner, origin), False
        feed.drop(max(part.used - part.dropped, 1))

    def findings(self, text: str) -> tuple[list[Found], set[Found], int]:
        """``(base findings, all findings, layers scanned)``, as ``(start, kind, end)``."""
        base = scan(text)
        found, seen, layers = set(base), set(), 1
        stack = [self.text_layers(text, Origin())]
        while stack:
            entry = next(stack[-1], None)
            if entry is None:
                stack.pop()
                continue
            (layer, origin), last = entry
            if last:
                stack.pop()
            entry = None
            if isinstance(layer, Feed):
                stack.append(self.feed_layers(layer, origin))
                continue
            if not layer:
                continue
            raw = layer if isinstance(layer, bytes) else layer.encode("utf-8", "surrogatepass")
            key = (type(layer), origin.span(0, len(layer)), hashlib.blake2b(raw, digest_size=16).digest())
            if key in seen:  # ends cycles, data that unpacks to itself included
                continue
            seen.add(key)
            if isinstance(layer, bytes):
                stack.append(self.bytes_layers(layer, origin))
                continue
            layers += 1
            for start, kind, end in scan(layer):
                a, b = origin.span(start, end)
                found.add((a, kind, b))
            stack.append(self.text_layers(layer, origin))
        return base, found, layers


def written(found) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in sorted(found))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_layer: int = MAX_LAYER) -> DataFrame:
    """One row per document: counts of base findings by kind, ``base_spans``, ``spans``, ``n_layers``."""
    scanner = Scanner(max_layer)

    def one(doc_id, text):
        base, found, layers = scanner.findings(text)
        return (doc_id, *(sum(k == kind for _, k, _ in base) for kind in range(3)), written(base), written(found), layers)

    types = [("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()),
             ("base_spans", pa.string()), ("spans", pa.string()), ("n_layers", pa.int64())]
    return map_rows(id_text(docs, id_col, text_col), one,
                    "doc_id long, n_assign long, n_access long, n_hex long, base_spans string, spans string, n_layers long",
                    types)


def redact(text: str, scanner: Scanner, mark: str = "[secret]") -> str:
    """The text with every finding (all layers) replaced by ``mark``."""
    _, found, _ = scanner.findings(text)
    out, at = [], 0
    for start, end in merged((s, e) for s, _, e in found):
        out += (text[at:start], mark)
        at = end
    return "".join(out) + text[at:]


def merged(spans) -> list[Span]:
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [tuple(s) for s in out]


def redact_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The same frame with every finding in ``text_col`` replaced; null texts stay null."""
    scanner = Scanner()
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = names.index(text_col)
            clean = pa.array([None if t is None else redact(t, scanner) for t in batch.column(k).to_pylist()],
                             batch.schema.field(k).type)
            yield pa.RecordBatch.from_arrays([*batch.columns[:k], clean, *batch.columns[k + 1:]], schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
