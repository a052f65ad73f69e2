"""Secret scans with a recursive decoding worklist.

A text is scanned for three kinds of secrets. Then its encoded parts are unwrapped, every result is a further layer that is scanned and
unwrapped in turn, until no new layer appears:

* URL: the layer with every run of %XX decoded (UTF-8);
* Unicode: the layer with every \\uXXXX, \\UXXXXXXXX and \\xXX replaced;
* base64: each run of MIN_BASE64 or more characters of the standard or URL-safe alphabet, in one line or over lines whose ends are removed, decoded
  at its four offsets: the stretches of text in the bytes;
* gzip, zlib or zstandard data anywhere in such bytes or in those of runs of %XX, \\xXX and \\u00XX with plain characters between: the stretches of text
  in what all its members and frames expand to.

A layer that was seen before, by digest, is not entered again, which ends cycles (an archive that contains itself). Each layer knows for
each of its characters which part of the original text it came from, so that spans always refer to the original text, in code points.

Kinds: ``assign`` is a key word, a separator and a value of 6 or more characters; ``access`` is AKIA and capitals or digits, 20 or more
characters; ``hex`` is 24 or more lower-case hexadecimal digits. Matches are leftmost and do not overlap within a kind and layer.

Defined cases: null counts as the empty text; a text without a secret has an empty list. Spans found in several layers at the same place
are one span, marked as base if the text itself shows it. A compressed layer is expanded to its end, in blocks that end with a line, so that an
archive bomb takes time but can't fill a worker. Where LAYER_BYTES of it have no such end, blocks overlap by OVERLAP: only a run that is itself
longer than that can be cut. zstandard frames that need a window over 128 MB, the library's bound, are not expanded. Repeated rows get equal answers.
"""
from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import unquote_to_bytes

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_batches

KINDS = ("assign", "access", "hex")
MIN_BASE64 = 16
LAYER_BYTES = 64 << 20  # of an expanded layer that has no end of a line to cut at, at most
BLOCK = 1 << 20  # bytes of an expanded layer that are scanned together
OVERLAP = 1 << 20
STEP = 1024  # compressed bytes fed at a time: at most 32 MB come out
SHORTEST = 12  # characters of the shortest secret
MASK = "[SECRET]"

_ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_SEPARATOR = re.compile(r"[:=]")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # the runs of 24 or more are the leftmost maximal runs that don't fail
_URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_UNICODE = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2})+")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{%d,}={0,2}" % MIN_BASE64)
_LINE_END = r"[ \t]*+(?:\r?\n|(?:\\r)?\\n)[ \t]*+"
_BREAK = re.compile(_LINE_END)
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{4,}+(?:%s[A-Za-z0-9+/_-]++)++={0,2}" % _LINE_END)
_URL_BYTES = re.compile(r"""[x(]?(?:%[0-9A-Fa-f]{2}[^\s%"<>\\]*+)++""")
_ESCAPED_BYTES = re.compile("|".join(rf"""{quote}[x(]?(?:\\(?:(?:x|u00)[0-9A-Fa-f]{{2}}|[abfnrtv0\\'"]){plain}*+)++""" for quote, plain in (
    ("(?<=')", r"[ -&(-\[\]-~]"), ('(?<=")', r"[ !#-\[\]-~]"), ("", r"[ -\[\]-~]"))))  # up to the closing quote, where one opened just before
_ESCAPE = re.compile(rb"""\\(?:(?:x|u00)([0-9A-Fa-f]{2})|([abfnrtv0\\'"]))""")
_SHORT = dict(zip((bytes([b]) for b in b"abfnrtv0\\'\""), (bytes([b]) for b in b"\a\b\f\n\r\t\v\0\\'\"")))
_ARCHIVE = re.compile(rb"\x1f\x8b\x08[\x00-\x1f]|\x28\xb5\x2f\xfd|\x78[\x01\x5e\x9c\xda]")
_INNER_ARCHIVE = re.compile(rb"\x1f\x8b\x08[\x00-\x1f]|\x28\xb5\x2f\xfd|\A\x78[\x01\x5e\x9c\xda]")
_PRINTED = re.compile(rb"(?:[\t-\r\x20-\x7e]++|[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3})++")
_TAIL = re.compile(rb"[A-Za-z0-9+/_-]{4}[ \t]*\r?\Z")
_HEAD = re.compile(rb"[ \t]*(?:[A-Za-z0-9+/_-]|\Z)")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of what one layer shows as it is."""
    out = []
    if _SEPARATOR.search(text):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return out


def _machine(head: bytes):
    """A decompressor of the member or frame that begins so, else None."""
    if _ARCHIVE.match(head):
        return zlib.decompressobj(47) if head[0] in b"\x1f\x78" else zstandard.ZstdDecompressor().decompressobj()
    return zstandard.ZstdDecompressor().decompressobj() if head[1:4] == b"\x2a\x4d\x18" and head[0] >> 4 == 5 else None  # a skippable frame


def _expanded(chunks: Iterator[bytes], used: list[int]) -> Iterator[bytes]:
    """Contents of all gzip, zlib or zstandard members and frames that follow each other, zeros between them left out; up to the damage where
    data is damaged. Little is fed at a time, so that what comes out at once is bounded. ``used``: bytes read up to the end of a member."""
    pieces = (c[i:i + STEP] for c in chunks for i in range(0, len(c), STEP))
    held, read = next(pieces, b""), 0
    while True:
        while len(held) < 4 and (more := next(pieces, b"")):
            held += more
        machine = _machine(held)
        if machine is None:
            zeros = len(held) - len(held.lstrip(b"\0"))
            if not zeros or not read:
                return
            held, read = held[zeros:], read + zeros
            continue
        try:
            while held and not machine.eof:
                out = machine.decompress(held)
                read += len(held) - len(machine.unused_data if machine.eof else b"")
                held = machine.unused_data if machine.eof else next(pieces, b"")
                if out:
                    yield out
        except (zlib.error, zstandard.ZstdError, MemoryError):
            return
        if not machine.eof:
            return
        used[0] = max(used[0], used[1] + read)


def _skipped(chunks: Iterator[bytes], n: int) -> Iterator[bytes]:
    for c in chunks:
        if n < len(c):
            yield c[n:]
        n = max(0, n - len(c))


def _line_end(held: bytearray) -> int:
    """The end of the last line that neither a secret nor an encoded run goes on after, 0 if there is none."""
    at = len(held) - 1
    while (at := held.rfind(b"\n", 0, at)) > 0:
        if not (_TAIL.search(held[max(0, at - 80):at]) and _HEAD.match(held[at + 1:at + 81])):
            return at + 1
    return 0


def _blocks(chunks: Iterator[bytes]) -> Iterator[tuple[int, bytes]]:
    """(place, bytes): all bytes in blocks that end with a line; what has no such end in LAYER_BYTES is cut anywhere, and OVERLAP is read twice."""
    held, at, limit = bytearray(), 0, BLOCK
    for c in chunks:
        held += c
        if len(held) >= limit:
            cut = _line_end(held)
            if cut or len(held) >= LAYER_BYTES:
                yield at, bytes(held[:cut or len(held)])
                cut = cut or len(held) - OVERLAP
                del held[:cut]
                at += cut
            limit = max(BLOCK, 2 * len(held))
    if held:
        yield at, bytes(held)


def _unwrapped(source, place, magic: re.Pattern, seen: set, streamed: bool = False):
    """(text, start, end) of the printed stretches of bytes and, whatever their size, of what archives in them expand to. ``source()`` reads
    the bytes anew; ``place(start, end)`` is the origin of a part of them."""
    used = 0
    for at, block in _blocks(source()):
        for m in _PRINTED.finditer(block):
            text = m.group().decode("utf-8", "replace")
            if len(text) >= SHORTEST:
                yield text, *place(at + m.start(), at + m.end())
        for m in magic.finditer(block):
            p = at + m.start()
            if p < used:
                continue
            ends = [p, p]
            inner = lambda p=p, ends=ends: _expanded(_skipped(source(), p), ends)
            first, whole = bytearray(), True
            for c in inner():
                first += c
                if len(first) > BLOCK:
                    whole = False
                    break
            mark = None
            if whole:
                inner, mark = (lambda data=bytes(first): iter((data,))), hashlib.blake2b(first)
            elif streamed:
                mark = hashlib.blake2b()
                for c in inner():
                    mark.update(c)
            if first and (mark is None or (mark := mark.digest()) not in seen):
                seen.add(mark)
                origin = place(p, None)
                yield from _unwrapped(inner, lambda *_, o=origin: o, _INNER_ARCHIVE, seen, not whole)
            used = max(used, ends[0])


def _as_text(data: bytes) -> str | None:
    """The first text in bytes, after any number of compressions."""
    return next((text for text, *_ in _unwrapped(lambda: iter((data,)), lambda a, b: (a, b), _ARCHIVE, set())), None)


def _bytes(run: str) -> bytes:
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    body = body[:len(body) - (len(body) % 4 == 1)]
    return base64.b64decode(body + "=" * (-len(body) % 4))


def _escapes(run: str) -> str:
    """A run of escapes as text; surrogate pairs become one character."""
    points = [int(m[1:] if m[0] in "uUx" else m, 16) for m in run.split("\\")[1:]]
    return "".join(chr(p) if p < 0x110000 else "�" for p in points).encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def _escaped_bytes(run: str) -> bytes:
    return _ESCAPE.sub(lambda m: bytes([int(m[1], 16)]) if m[1] else _SHORT[m[2]], run.encode("utf-8", "replace"))


def _unquoted(run: str) -> str:
    return bytes.fromhex(run.replace("%", "")).decode("utf-8", "replace")


def _rewritten(text: str, pattern: re.Pattern, decode, starts: np.ndarray, ends: np.ndarray):
    """The layer with all matches decoded and the origin of each character: a decoded character comes from its whole run, unless the run
    is single-byte escapes of equal width, where it comes from its own escape."""
    parts, a, b, at = [], [], [], 0
    for m in pattern.finditer(text):
        new = decode(m.group())
        parts += [text[at:m.start()], new]
        a += [starts[at:m.start()]]
        b += [ends[at:m.start()]]
        width, rest = divmod(m.end() - m.start(), max(1, len(new)))
        if new and not rest and width in (3, 4, 6, 10):
            a.append(starts[m.start():m.end():width])
            b.append(ends[m.start() + width - 1:m.end():width])
        else:
            a.append(np.full(len(new), starts[m.start()]))
            b.append(np.full(len(new), ends[m.end() - 1]))
        at = m.end()
    parts.append(text[at:])
    if not starts.strides[0]:  # one origin for all
        new = "".join(parts)
        return new, np.broadcast_to(starts[0], len(new)), np.broadcast_to(ends[0], len(new))
    return "".join(parts), np.concatenate([*a, starts[at:]]), np.concatenate([*b, ends[at:]])


def _from_base64(run: str):
    """(bytes, where in the run a part of them comes from) at each of the four offsets, as what precedes base64 may look like it."""
    size = len(run.rstrip("="))
    for k in range(4):
        yield _bytes(run[k:]), lambda a, b, k=k: (k + a * 4 // 3, len(run) if b is None or (e := k - (-b * 4 // 3)) >= size else e)


def _runs(text: str):
    """(place of each character, bytes, where in it a part of them comes from) of each run that encodes bytes."""
    for m in _BASE64.finditer(text):
        for found in _from_base64(m.group()):
            yield range(m.start(), m.end()), *found
    if "\n" in text or "\\n" in text:
        for m in _WRAPPED.finditer(text):
            if m.end() - m.start() > MIN_BASE64:
                breaks = [b.span() for b in _BREAK.finditer(text, m.start(), m.end())]
                parts = [*zip([m.start(), *(b for _, b in breaks)], [*(a for a, _ in breaks), m.end()])]
                places = np.concatenate([np.arange(a, b) for a, b in parts])
                if len(places) >= MIN_BASE64:
                    for found in _from_base64("".join(text[a:b] for a, b in parts)):
                        yield places, *found
    for sign, pattern, decode in (("%", _URL_BYTES, unquote_to_bytes), ("\\", _ESCAPED_BYTES, _escaped_bytes)):
        for m in pattern.finditer(text) if sign in text else ():
            if _ARCHIVE.search(data := decode(m.group())):
                yield range(m.start(), m.end()), data, lambda a, b, n=m.end() - m.start(): (0, n)


def _layers(text: str, starts: np.ndarray, ends: np.ndarray):
    """What one layer unwraps to: (text, first origin of each character, end of its origin)"""
    if "%" in text and _URL.search(text):
        yield _rewritten(text, _URL, _unquoted, starts, ends)
    if "\\" in text and _UNICODE.search(text):
        yield _rewritten(text, _UNICODE, _escapes, starts, ends)
    for places, data, place in _runs(text):
        origin = lambda a, b: (starts[places[(p := place(a, b))[0]]], ends[places[p[1] - 1]])  # noqa: E731, B023
        for inner, a, b in _unwrapped(lambda: iter((data,)), origin, _ARCHIVE, set()):  # noqa: B023
            yield inner, np.broadcast_to(a, len(inner)), np.broadcast_to(b, len(inner))


def find(text: str | None) -> list[tuple[int, int, int, bool]]:
    """(start, kind, end, base) of all secrets of a text and its layers, by start, kind and end."""
    text = text or ""
    found = {span: True for span in base_spans(text)}
    if "%" in text or "\\" in text or _BASE64.search(text) or _WRAPPED.search(text):
        places = np.arange(len(text) + 1)
        work, seen = [_layers(text, places[:-1], places[1:])], {hashlib.blake2b(text.encode("utf-8", "replace")).digest()}
        while work:  # the deepest first, so that one block of each layer above is held
            layer, starts, ends = next(work[-1], (None, None, None))
            if layer is None:
                work.pop()
                continue
            mark = hashlib.blake2b(layer.encode("utf-8", "replace") + f"\0{starts[0]}:{ends[-1]}".encode() if layer else b"").digest()
            if layer and mark not in seen:
                seen.add(mark)
                work.append(_layers(layer, starts, ends))
                for start, kind, end in base_spans(layer):
                    found.setdefault((int(starts[start]), kind, int(ends[end - 1])), False)
    return [(a, k, b, base) for (a, k, b), base in sorted(found.items())]


def redacted(text: str, spans: list[tuple[int, int, int, bool]]) -> str:
    """The text with each maximal covered stretch replaced by MASK."""
    out, at = [], 0
    for start, _, end, _ in spans:
        if start >= at:
            out += [text[at:start], MASK]
        at = max(at, end)
    return "".join(out) + text[at:]


SPANS = "array<struct<kind:string,start:int,end:int,base:boolean>>"


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """All rows of ``docs`` as struct ``row``, with ``spans`` and ``redacted`` (null where nothing was found)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())])
        for batch in batches:
            given = batch.column("_row").field(text).to_pylist()
            spans = [find(t) for t in given]
            cells = [[{"kind": KINDS[k], "start": a, "end": b, "base": base} for a, k, b, base in s] for s in spans]
            clean = [redacted(t, s) if s else None for t, s in zip(given, spans)]
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(cells, pa.list_(kind)), pa.array(clean, pa.string())], ["row", "spans", "redacted"])

    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    return in_batches(packed, run, f"row {packed.schema['_row'].dataType.simpleString()}, spans {SPANS}, redacted string")


def joined(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def without_secrets(docs: DataFrame) -> DataFrame:
    """All rows and columns of ``docs``, secrets masked in the text and n_chars counted anew where there were any."""
    found = scan(docs)
    new = {"text": F.coalesce("redacted", "row.text"), "n_chars": F.coalesce(F.length("redacted").cast("long"), F.col("row.n_chars")) if "n_chars" in docs.columns else None}
    return found.select(*[(new[c] if c in new else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
