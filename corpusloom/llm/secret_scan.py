"""Secret scan with a recursive decoding worklist.

A document starts a worklist of layers. Each layer is scanned for secrets; then its URL escapes, Unicode
escapes, base64 runs and compressed base64 runs are unwrapped into further layers, until no layer is new.
A layer is known by its text and by where its characters stand in the document, so the same run in two places
is two layers, and a cycle (a compressed quine, say), which stays in its place, ends. Each layer keeps, for
every one of its characters, the span of the document that it came from, so every finding has a span of the
document. What a decoded run holds is worked out once for each text and put at each place that shows it.
"""

from __future__ import annotations

import base64
import bz2
import codecs
import hashlib
import lzma
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: Runs are maximal, so asking for the least length at once finds the same spans as dropping short runs after.
HEX = re.compile(r"[0-9a-f]{24,}")
URL_RUN = re.compile(r"(?:%[0-9A-Fa-f]{2})++")
UNICODE_ITEM = re.compile(r"\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})|\\U([0-9A-Fa-f]{8})|\\u\{([0-9A-Fa-f]{1,6})\}|&#[xX]([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});")
UNICODE_RUN = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}|\\U[0-9A-Fa-f]{8}|\\u\{[0-9A-Fa-f]{1,6}\}|&#[xX][0-9A-Fa-f]{1,6};|&#[0-9]{1,7};)++")
BASE64_RUN = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: Base64 over several lines, indented or not; the lines need not be of one width.
BASE64_LINES = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:[\x20\t]*+\r?\n[\x20\t]*+[A-Za-z0-9+/_-]++)++={0,2}")
#: What may stand between a name and a payload within one run.
GLUE = re.compile(r"[_/+-]")
BASE64_PIECE = re.compile(r"[A-Za-z0-9+/_-]+")
#: Compressed runs are scanned in pieces; a secret of up to OVERLAP bytes stands whole in one of them. A piece grows,
#: up to GROWN bytes, until no run longer than OVERLAP is open at its end.
PIECE, OVERLAP, GROWN = 1 << 24, 1 << 20, 1 << 27
#: A line that may be a part of a run over several lines, and the end of one.
RUN_LINE, RUN_TAIL = re.compile(rb"[A-Za-z0-9+/_=%\\&#;{}-]*"), re.compile(rb"[A-Za-z0-9+/_=%\\&#;{}-]+\Z")
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_layers long, n_decoded long"


@dataclass
class Layer:
    """Text with the document's span of each character; route names the decodings that led here."""

    text: str
    starts: np.ndarray | None
    ends: np.ndarray | None
    route: str

    def span(self, a: int, b: int) -> tuple[int, int]:
        if self.starts is None:
            return a, b
        return int(self.starts[a:b].min()), int(self.ends[a:b].max())

    def one_place(self) -> tuple[int, int] | None:
        """The span that all characters share, if they do."""
        if self.starts is None or not len(self.starts) or self.starts.strides != (0,) or self.ends.strides != (0,):
            return None
        return int(self.starts[0]), int(self.ends[0])

    def maps(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        if self.starts is None:
            return np.arange(a, b), np.arange(a + 1, b + 1)
        return self.starts[a:b], self.ends[a:b]


def matches(text: str) -> list[tuple[str, int, int]]:
    """The base secrets of one text: leftmost, non-overlapping for each kind; what fails its length is dropped."""
    out = []
    low = text.lower()
    if any(h in low for h in ASSIGN_HINTS):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return out


#: How compressed streams begin; zlib's two bytes, which text may begin with as well, are told by _engine.
MAGIC = re.compile(rb"\x1f\x8b\x08|BZh[1-9]|\xfd7zXZ\x00|\x28\xb5\x2f\xfd")


def _engine(data: bytes):
    head = data[:8]
    if head[:2] == b"\x1f\x8b":
        return zlib.decompressobj(31)
    if len(head) > 2 and head[0] & 0x0F == 8 and (head[0] * 256 + head[1]) % 31 == 0:
        return zlib.decompressobj(15)
    if head[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if head[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor()
    if head[:4] == b"\x28\xb5\x2f\xfd":
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj()
    return None


#: What an engine is fed at once. A zstd engine gives all that it can, up to 128 KB for each block of four bytes.
FED, FED_ZSTD = 1 << 12, 1 << 5


def _inflated(data: bytes, headless: bool = False) -> Iterator[tuple[bytes, int]]:
    """What a compressed run holds, in parts of about a megabyte at most, up to its end or to where it breaks; with
    each part the bytes of data read so far. Streams laid end to end (the members of a gzip file, say) are read one
    after another. Nothing if it is none. headless: a deflate stream without any head."""
    most, base = 1 << 20, 0
    while (engine := zlib.decompressobj(-15) if headless and base == 0 else _engine(data[base : base + 8])) is not None:
        fed, bounded = base, not type(engine).__name__.startswith("Zstd")
        try:
            while fed < len(data) and not engine.eof:
                left = data[fed : fed + (FED if bounded else FED_ZSTD)]
                fed += len(left)
                while not engine.eof:
                    out = engine.decompress(left, most) if bounded else engine.decompress(left)
                    left = getattr(engine, "unconsumed_tail", b"") if bounded else b""
                    if out:
                        yield out, fed - len(engine.unused_data)
                    if not left and (not bounded or len(out) < most or getattr(engine, "needs_input", False)):
                        break
        except Exception:  # each engine has errors of its own; what came before the break is kept
            return
        if not engine.eof:
            return
        base = fed - len(engine.unused_data)
        base += len(data[base : base + 512]) - len(data[base : base + 512].lstrip(b"\0"))  # padding between members


def _open_run(held: bytearray) -> int:
    """Where the run begins that is still open at the end of what is held; its end if none is."""
    end = start = len(held)
    while end > 0:
        low = held.rfind(b"\n", 0, end) + 1
        line = bytes(held[low:end]).strip(b" \t\r")
        if not RUN_LINE.fullmatch(line):
            tail = RUN_TAIL.search(line)
            return low + held[low:end].rfind(tail[0]) if tail else start
        start, end = (low if line else start), low - 1
    return start


def _inflate(data: bytes, headless: bool = False) -> Iterator[tuple[bytes, int]]:
    """The same in pieces of PIECE bytes, each of which begins with the last OVERLAP bytes of the one before. A piece in
    whose end a longer run is open goes on until that has ended, or GROWN bytes are held."""
    held, read, asked = bytearray(), 0, PIECE
    fresh = False
    for out, read in _inflated(data, headless):
        held += out
        fresh = True
        if len(held) >= asked:
            if len(held) < GROWN and len(held) - _open_run(held) > OVERLAP:
                asked = len(held) + PIECE
                continue
            yield bytes(held), read
            del held[:-OVERLAP]
            fresh, asked = False, PIECE
    if fresh:
        yield bytes(held), read


#: No secret, and no run that unwraps to one, is shorter than twelve characters.
HOLDS = re.compile(rb"[\t\n\r\x20-\x7e]{12,}")


def _readable(data: bytes) -> str | None:
    """Bytes as text if a secret can stand in them, whatever stands around it."""
    return data.decode("utf-8", "replace") if HOLDS.search(data) else None


def _wide(data: bytes) -> str | None:
    """The same of bytes of which every other one is zero, as in UTF-16; the text without zeros."""
    return _readable(data.replace(b"\0", b"")) if 3 * data.count(0) >= len(data) > 0 else None


def _rewrite(layer: Layer, pattern: re.Pattern, decode, name: str) -> Layer | None:
    """The whole layer with its runs put in plain form; None if there is none. What can't be decoded in a run is U+FFFD."""
    texts, widths, at = [], [], 0
    for m in pattern.finditer(layer.text):
        plain, wide = decode(m[0])
        texts += [layer.text[at : m.start()], plain]
        widths.append((m.start() - at, wide))
        at = m.end()
    if not at:
        return None
    texts.append(layer.text[at:])
    n = sum(map(len, texts))
    begins = np.ones(n + 1, dtype=np.int32)  # widths, moved by one, and summed up in place
    begins[0], place = 0, 1
    for gap, wide in widths:
        place += gap
        begins[place : place + len(wide)] = wide
        place += len(wide)
    np.cumsum(begins, out=begins)
    starts, ends = begins[:-1], begins[1:]
    if layer.starts is not None:
        starts, ends = np.minimum.reduceat(layer.starts, starts), np.maximum.reduceat(layer.ends, starts)
    return Layer("".join(texts), starts, ends, f"{layer.route}{name}/")


def _url(run: str) -> tuple[str, np.ndarray]:
    """The text of a run of escapes, and from how many characters each of its own came."""
    text = bytes.fromhex(run.replace("%", "")).decode("utf-8", "surrogateescape")
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    lost = (points >= 0xDC80) & (points < 0xDD00)
    n = 1 + (points >= 0x80).astype(np.int32) + (points >= 0x800) + (points >= 0x10000)
    return (text.encode("utf-8", "surrogateescape").decode("utf-8", "one by one") if lost.any() else text), np.where(lost, 1, n) * 3


codecs.register_error("one by one", lambda e: ("\ufffd", e.start + 1))


def _unicode(run: str) -> tuple[str, np.ndarray]:
    chars, widths, high = [], [], 0
    for m in UNICODE_ITEM.finditer(run):
        code = int(m[6]) if m[6] else int(next(g for g in m.groups() if g), 16)
        width = m.end() - m.start()
        if high and 0xDC00 <= code < 0xE000:
            chars[-1] = chr(0x10000 + ((high - 0xD800) << 10) + code - 0xDC00)
            widths[-1] += width
            high = 0
            continue
        high = code if 0xD800 <= code < 0xDC00 else 0
        chars.append("\ufffd" if code > 0x10FFFF or 0xD800 <= code < 0xE000 else chr(code))
        widths.append(width)
    return "".join(chars), np.array(widths, dtype=np.int32)


def _plain(run: str, skip: int = 0) -> bytes:
    """The bytes of a base64 run from one of its four alignments on; of either alphabet, padded or not."""
    body = run.rstrip("=")[skip:].replace("-", "+").replace("_", "/")
    body = body[:-1] if len(body) % 4 == 1 else body
    return base64.b64decode(body + "=" * (-len(body) % 4))


def _constant(text: str, span: tuple[int, int], route: str) -> Layer:
    """A layer all of whose characters came from one span."""
    return Layer(text, np.broadcast_to(np.int64(span[0]), len(text)), np.broadcast_to(np.int64(span[1]), len(text)), route)


def _unpacked(layer: Layer, data: bytes, bounds, raw: bool = True, headless: bool = False) -> Iterator[Layer]:
    """Layers of what a compressed run holds, made as they are asked for; bounds gives the span of the bytes read."""
    none = True
    for plain, read in _inflate(data, headless):
        none = False
        if text := _readable(plain) or _wide(plain):
            yield _constant(text, bounds(read), f"{layer.route}base64/inflate/")
    try:
        none = none or bool(data.decode("utf-8"))
    except UnicodeDecodeError:
        pass
    if raw and none and (text := _readable(data)):  # only the head was that of a compressed stream
        yield _constant(text, bounds(len(data)), f"{layer.route}base64/")


def _stream_starts(data: bytes, run: str, skip: int) -> set[int]:
    """Where in the bytes of a run, read from character `skip` on, a compressed stream may begin: at the head of
    one, or after a character that glues a name to a payload."""
    glued = {(m.end() - skip) // 4 * 3 for m in GLUE.finditer(run) if m.end() >= skip and (m.end() - skip) % 4 == 0}
    return {m.start() for m in MAGIC.finditer(data)} | {at for at in glued if _engine(data[at : at + 8]) is not None}


def _joined(layer: Layer, m: re.Match) -> list[Layer | Iterator[Layer]]:
    """What a run wrapped over lines holds. A payload may start with any line, or within the first where a name is
    glued to it: so all four alignments are decoded, and inflated from each place that has the head of a compressed
    stream. A character's span is that of the readable lines in a row which it is in."""
    pieces = [(m.start() + p.start(), m.start() + p.end()) for p in BASE64_PIECE.finditer(m[0])]
    body = "".join(layer.text[a:b] for a, b in pieces)
    if len(body) < 16:
        return []
    begins = np.concatenate([[0], np.cumsum([b - a for a, b in pieces])[:-1]])
    end = m.end() + len(layer.text[m.end() : m.end() + 2]) - len(layer.text[m.end() : m.end() + 2].lstrip("="))
    padded = end > m.end() or layer.text[m.end() - 1] == "="
    loose = not padded and layer.text[m.end() : m.end() + 1].isspace() and layer.text[m.end()] not in "\r\n"
    line_of = lambda char: np.searchsorted(begins, char, side="right") - 1
    out = []
    for skip in range(4):
        data = _plain(body, skip)
        lines = {(s - skip) // 4 * 3 for s in begins.tolist() if s >= skip and (s - skip) % 4 == 0}
        heads = {at for at in lines if _engine(data[at : at + 8]) is not None}
        for at in sorted(heads | _stream_starts(data, body[: len(body) if len(pieces) == 1 else int(begins[1])], skip)):
            first = skip + at * 8 // 6

            def bounds(read: int, first=first) -> tuple[int, int]:
                last = int(line_of(first - (-read * 4 // 3) - 1))
                return layer.span(pieces[int(line_of(first))][0], end if last >= len(pieces) - 1 else pieces[last][1])

            out.append(_unpacked(layer, data[at:], bounds, False))
        if not HOLDS.search(data):
            continue
        # Byte i is in the characters from i * 8 // 6 to (i * 8 + 7) // 6.
        of = np.arange(len(data))
        head, tail = line_of(skip + of * 8 // 6), line_of(skip + (of * 8 + 7) // 6)
        raw = np.frombuffer(data, dtype=np.uint8)
        good = ((raw >= 0x20) & (raw < 0x7F)) | (raw == 9) | (raw == 10) | (raw == 13)
        n = np.bincount(head, minlength=len(pieces))
        fine = np.bincount(head, weights=good, minlength=len(pieces)) > 0.8 * n
        if loose:
            fine[-1] = False
        group = np.cumsum(np.concatenate([[True], ~(fine[1:] & fine[:-1])])) - 1
        lo = np.array([pieces[i][0] for i in np.flatnonzero(np.diff(group, prepend=-1))])
        hi = np.array([pieces[i][1] for i in np.flatnonzero(np.diff(group, append=group[-1] + 1))])
        hi[-1] = max(hi[-1], end)
        x, y = lo[group[head]], hi[group[tail]]
        if layer.starts is not None:
            spans = {(a, b): layer.span(a, b) for a, b in set(zip(x.tolist(), y.tolist(), strict=True))}
            both = np.array([spans[p] for p in zip(x.tolist(), y.tolist(), strict=True)])
            x, y = both[:, 0], both[:, 1]
        out.append(Layer(data.decode("latin-1"), x, y, f"{layer.route}base64/"))
    return out


def unwrap(layer: Layer) -> list[Layer | Iterator[Layer]]:
    """The layers one decoding away; those of a compressed run as an iterator."""
    out = []
    if "%" in layer.text and (child := _rewrite(layer, URL_RUN, _url, "url")):
        out.append(child)
    if ("\\" in layer.text or "&#" in layer.text) and (child := _rewrite(layer, UNICODE_RUN, _unicode, "unicode")):
        out.append(child)
    taken, wrapped = [], [m for m in BASE64_LINES.finditer(layer.text) if m.end() - m.start() > 16] if "\n" in layer.text else []
    for m in wrapped:
        taken.append(m.span())
        out += _joined(layer, m)
    at = 0
    for m in BASE64_RUN.finditer(layer.text):
        while at < len(taken) and taken[at][1] <= m.start():
            at += 1
        if at < len(taken) and taken[at][0] <= m.start():
            continue
        out += _run_layers(layer, m[0], layer.span(*m.span()))
    return out


def _run_layers(layer: Layer, run: str, span: tuple[int, int]) -> Iterator[Layer | Iterator[Layer]]:
    """What a run on one line holds. A name may be glued to a payload (blob_UGFz...), so all four alignments are
    read: some one of them has the payload's bytes right, with odd ones before it."""
    for skip in range(4):
        data = _plain(run, skip)
        if len(data) < 9:
            continue
        if whole := skip == 0 and _engine(data) is not None:
            yield _unpacked(layer, data, lambda _: span)
            if next(_inflated(data), None):  # a stream from end to end; what other alignments show of it is chance
                return
        elif text := _readable(data):
            yield _constant(text, span, f"{layer.route}base64/")
        elif text := _wide(data):
            yield _constant(text, span, f"{layer.route}base64/utf16/")
        elif skip == 0:
            yield _unpacked(layer, data, lambda _: span, False, headless=True)
        for at in sorted(_stream_starts(data, run, skip) - ({0} if whole else set())):
            yield _unpacked(layer, data[at:], lambda _: span, False)


def _known(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _layers(work: list[Layer | Iterator[Layer]]) -> Iterator[Layer]:
    """The layers on a stack, those of a compressed run one by one; what is pushed meanwhile goes first."""
    while work:
        top = work.pop()
        if isinstance(top, Layer):
            yield top
        elif (first := next(top, None)) is not None:
            work.append(top)
            yield first


def _within(text: str, memo: dict[bytes, tuple[frozenset[str], int]]) -> tuple[frozenset[str], int]:
    """(kinds with their routes, layers) of a text that stands in one place as a whole, with all that it unwraps to."""
    if (name := _known(text)) in memo:
        return memo[name]
    kinds, seen, work = set(), set(), [_constant(text, (0, 1), "")]
    for layer in _layers(work):
        if (own := _known(layer.text)) not in seen:
            seen.add(own)
            kinds |= {layer.route + k for k, _, _ in matches(layer.text)}
            work += unwrap(layer)
    memo[name] = frozenset(kinds), len(seen)
    return memo[name]


def scan(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]], int]:
    """Base spans, spans that only decoding shows (kind with its route), and the number of layers."""
    base = sorted(matches(text), key=lambda x: (x[1], KINDS.index(x[0])))
    found, seen, memo = set(base), set(), {}
    added, work, layers = set(), unwrap(Layer(text, None, None, "")), 1

    def note(route: str, kind: str, lo: int, hi: int) -> None:
        if (kind, lo, hi) not in found:
            found.add((kind, lo, hi))
            added.add((route + kind, lo, hi))

    for layer in _layers(work):
        place = layer.one_place()
        if (name := (_known(layer.text), place or tuple(hashlib.sha256(np.ascontiguousarray(x)).digest() for x in (layer.starts, layer.ends)))) in seen:
            continue
        seen.add(name)
        if place:
            kinds, n = _within(layer.text, memo)
            layers += n
            for kind in sorted(kinds, key=lambda k: (k.count("/"), k)):
                route, _, own = kind.rpartition("/")
                note(layer.route + route + "/" * bool(route), own, *place)
            continue
        layers += 1
        for kind, a, b in matches(layer.text):
            note(layer.route, kind, *layer.span(a, b))
        work += unwrap(layer)
    return base, sorted(added, key=lambda x: (x[1], x[0], x[2])), layers


def _listed(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _run():
    def run(batches):
        for batch in batches:
            rows, texts = [], batch.column(1)
            for i, doc_id in enumerate(batch.column(0).to_pylist()):
                base, added, layers = scan(texts[i].as_py() or "")
                n = [sum(k == kind for k, _, _ in base) for kind in KINDS]
                rank = {k: j for j, k in enumerate(KINDS)}
                every = sorted([*base, *added], key=lambda x: (x[1], rank.get(x[0], len(rank)), x[0], x[2]))
                rows.append((doc_id, *n, hashlib.sha256(_listed(base).encode()).hexdigest(), _listed(every), layers, len(added)))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()] * 2
            names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_layers", "n_decoded"]
            cols = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    return run


def scan_secrets(docs: DataFrame) -> DataFrame:
    """One row for each row of docs, repeated rows and null ids included; a null text counts as empty.

    base_sha256 is over the base spans, spans lists these and the decoded ones (kind with its route, such as
    base64/assign). A text without findings has the digest of the empty string and empty spans. Compressed runs
    are unwrapped piece by piece, whatever they hold, and whole texts are read whatever their length. Other columns are not read. An empty table gives no rows.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_run(), SCHEMA)


def _redact(column: int):
    def redacted(text: str | None) -> str | None:
        if not text:
            return text
        base, added, _ = scan(text)
        out, at = [], 0
        for a, b in sorted((a, b) for _, a, b in [*base, *added]):
            if b > at:
                out += [text[at : max(a, at)], "" if a < at else "[SECRET]"]
                at = b
        return "".join([*out, text[at:]])

    def run(batches):
        for batch in batches:
            texts = batch.column(column)
            new = pa.array([redacted(texts[i].as_py()) for i in range(batch.num_rows)], pa.string())
            yield pa.RecordBatch.from_arrays([new if i == column else c for i, c in enumerate(batch.columns)], batch.schema.names)

    return run


def redact_secrets(docs: DataFrame) -> DataFrame:
    """docs with every span found, plain or wrapped, replaced by [SECRET] in text; all else stays: nulls, empty texts,
    repeated rows, other columns whatever their names. An empty table gives an empty one."""
    docs = docs.withColumn("text", F.col("text").cast("string"))
    return docs.mapInArrow(_redact(docs.columns.index("text")), docs.schema)
