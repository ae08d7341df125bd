import base64
import bz2
import gzip
import re
import time
import zlib
from urllib.parse import quote

import zstandard

from basketcast.llm.secrets import Origin, Scanner, merged, redact, scan, scan_secrets, unescape, written
from helpers import ROWS, awkward, empty

SECRET = "api_key = 'Zx9-Qw8_Er7tY6'"


def brute(text):
    out = []
    for m in re.finditer(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text, re.I | re.A):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24])


def test_base_layer_as_the_plain_patterns():
    texts = ["", SECRET, "secret:token:abcdefgh", "token=abc token=abcdef", "AKIA" + "A1" * 9 + "x", "xAKIAAKIA" + "0" * 14,
             "feed" * 6, "g" + "0a" * 12 + "é PASSWORD\"  :  \"hunter22", "paſſword=abcdefgh"]
    for t in texts:
        assert sorted(scan(t)) == brute(t)


def layers(secret):
    b64 = lambda b: base64.b64encode(b).decode()
    yield quote(secret, safe="")
    yield "".join(f"%{b:02X}" for b in secret.encode())
    yield "".join(f"\\u{ord(c):04x}" for c in secret)
    yield "".join(f"\\x{ord(c):02x}" for c in secret)
    yield "".join(f"&#{ord(c)};" for c in secret)
    yield b64(secret.encode())
    yield base64.urlsafe_b64encode(secret.encode()).decode()
    yield b64(b64(secret.encode()).encode())
    for pack in (gzip.compress, zlib.compress, bz2.compress, zstandard.ZstdCompressor().compress):
        yield b64(pack(secret.encode()))
        yield b64(pack(b64(pack(quote(secret).encode())).encode()))
    yield quote(quote(b64(gzip.compress(secret.encode())), safe=""), safe="")
    yield "".join(f"%{b:02X}" for b in gzip.compress(secret.encode()))


def test_nested_layers_map_back_to_the_text():
    for hidden in layers(SECRET):
        before = "Größe 😀: "
        text = f"{before}{hidden} and the rest"
        base, found, n = Scanner().findings(text)
        inside = [(s, e) for s, k, e in found if k == 0]
        assert inside, hidden
        assert any(s >= len(before) and e <= len(before) + len(hidden) for s, e in inside), (hidden, inside)
        assert set(base) <= found and n > 1
        assert "[secret]" in redact(text, Scanner())


def test_escape_spans_are_exact_and_cycles_end():
    text = "x pass%77ord=abcdef%67 y"
    assert written(Scanner().findings(text)[1]) == "assign:2:22"
    assert text[2:22] == "pass%77ord=abcdef%67"
    Scanner().findings("%25" * 2000 + "&#38;#38;" * 100)
    assert merged([(3, 5), (1, 4), (9, 9)]) == [(1, 5), (9, 9)]


def test_bomb_is_scanned_in_windows():
    data = b"z" * (3 << 20) + b" token=abcdefgh " + b"z" * (3 << 20)
    text = base64.b64encode(gzip.compress(data)).decode()
    assert (0, 0, len(text)) in Scanner(max_layer=1 << 20).findings(text)[1]


def test_frame(spark):
    rows = scan_secrets(awkward(spark)).collect()
    assert len(rows) == len(ROWS)
    assert {r.doc_id: r.spans for r in rows if r.spans} == {8: "hex:0:3000"}  # "aaa..." is a hexadecimal run
    assert scan_secrets(empty(spark)).count() == 0


def test_compressed_bytes_behind_the_standard_escapes():
    import json
    from urllib.parse import quote_plus
    for k in range(20):
        secret = f"note {k} {SECRET} {'x' * k}".encode()
        for pack in (zlib.compress, gzip.compress, bz2.compress, zstandard.ZstdCompressor().compress):
            data = pack(secret)
            latin = data.decode("latin-1")
            for hidden in (quote(data), quote_plus(data), quote(latin), json.dumps(latin), repr(data),
                           "".join(f"&#{b};" for b in data)):
                text = f"before {hidden} after"
                found = [(s, e) for s, kind, e in Scanner().findings(text)[1] if kind == 0]
                assert any(s >= 7 and e <= len(text) for s, e in found), (pack, hidden)


def test_all_members_and_damaged_layers():
    b64 = lambda b: base64.b64encode(b).decode()
    secret = SECRET.encode()
    for pack in (gzip.compress, zlib.compress, bz2.compress, zstandard.ZstdCompressor().compress):
        assert any(k == 0 for _, k, _ in Scanner().findings(b64(pack(b"first part ") + pack(secret)))[1]), pack
    for data in (b"\x00 " + secret, b"\xff\xfe\xfa" + secret, SECRET.encode("utf-16"), SECRET.encode("utf-16-be")):
        for prefix in ("", "path/to/", "key_", "a-"):
            assert any(k == 0 for _, k, _ in Scanner().findings(prefix + b64(data))[1]), (data, prefix)
    for prefix in ("path/to/", "key_", "a-"):
        assert any(k == 0 for _, k, _ in Scanner().findings(prefix + b64(gzip.compress(secret)))[1]), prefix


def test_layers_inside_a_large_layer_are_unwrapped():
    inner = base64.b64encode(SECRET.encode())
    for hidden in (inner, quote(SECRET, safe="").encode(), base64.b64encode(gzip.compress(SECRET.encode())), b"\xff" + inner):
        data = b"z " * (1 << 17) + hidden + b" y" * (1 << 17)
        text = base64.b64encode(gzip.compress(data)).decode()
        for size in (1 << 16, 1 << 20):  # windows; held whole
            assert (0, 0, len(text)) in Scanner(max_layer=size).findings(text)[1], (hidden, size)


def test_ten_thousand_levels_end_in_time():
    n, started = 10_000, time.time()
    packed = SECRET.encode()
    for _ in range(n):
        packed = zlib.compress(packed, 0)[:2] + zlib.compress(packed, 0)[2:] if len(packed) < 2000 else zlib.compress(packed, 1)
    hidden = {
        "url": "token%" + "25" * n + "3Dabcdefgh", "unicode": "token\\" + "u005c" * n + "u003dabcdefgh",
        "hex": "token\\" + "x5c" * n + "x3dabcdefgh", "reference": "token&" + "#38;" * n + "#61;abcdefgh",
        "named": "token&" + "amp;" * n + "#61;abcdefgh", "packed": base64.b64encode(packed).decode()}
    for kind, text in hidden.items():
        found = Scanner().findings(text)[1]
        assert (0, 0, len(text)) in found, kind
    # escapes of one kind inside the other: no single pass, a layer for each
    mixed = "token=abcdefg%41"
    for k in range(300):
        mixed = mixed.replace("%", "\\u0025") if k % 2 == 0 else mixed.replace("\\", "%5C")
    assert (0, 0, len(mixed)) in Scanner().findings(mixed)[1]
    assert time.time() - started < 120


def test_base64_of_any_line_length():
    data = base64.b64encode((SECRET + " " + "filler " * 30).encode()).decode()
    for width in (8, 20, 40, 60, 64, 76, 80, 100):
        for end in ("\n", "\r\n"):
            text = "see\n" + end.join(data[k:k + width] for k in range(0, len(data), width)) + "\nend of it"
            spans = [text[s:e] for s, kind, e in Scanner().findings(text)[1] if kind == 0]
            assert any(x.replace(end, "") == data for x in spans), (width, end)
    Scanner().findings("A" * 2_000_000 + "\n" + "word\n" * 100_000)  # no quadratic search


def test_spans_compose_through_escapes():
    text = "a%5Cu0062c%26%2364%3Bz%C3%A9\\u0041"
    origin, layer, seen = Origin(), text, [text]
    from basketcast.llm import secrets as S
    for pattern, value in ((S._ESCAPED_URL, S._url), (S._ESCAPED_UNICODE, S._unicode)):
        layer, step = unescape(layer, pattern, value)
        origin = origin.after(step)
        seen.append(layer)
    assert seen == [text, "a\\u0062c&#64;zé\\u0041", "abc@zéA"]
    pieces = [text[slice(*origin.span(k, k + 1))] for k in range(len(layer))]
    assert pieces == ["a", "%5Cu0062", "c", "%26%2364%3B", "z", "%C3%A9", "\\u0041"]
    assert text[slice(*origin.span(0, len(layer)))] == text and text[slice(*origin.span(1, 4))] == "%5Cu0062c%26%2364%3B"


def test_compressed_string_longer_than_the_window():
    import random
    noise = random.Random(4).randbytes(600_000)
    inner = gzip.compress(noise + SECRET.encode() + noise)
    data = b"z" * 100_000 + inner + b" token=behindit " + b"z" * 300_000
    text = base64.b64encode(zlib.compress(data)).decode()
    for size in (1 << 18, 1 << 24):
        found = Scanner(max_layer=size).findings(text)[1]
        assert (0, 0, len(text)) in found
    small = Scanner(max_layer=1 << 18)
    layers = [x for x, _ in drained(small, data)]
    assert any(SECRET in x for x in layers) and any("token=behindit" in x for x in layers)


def drained(scanner, data):
    """Texts of all layers in bytes."""
    stack = [scanner.feed_layers(__import__("basketcast.llm.secrets", fromlist=["Feed"]).Feed(bytearray(zlib.compress(data))), Origin())]
    while stack:
        entry = next(stack[-1], None)
        if entry is None:
            stack.pop()
            continue
        layer, origin = entry[0]
        if isinstance(layer, str):
            yield layer, origin
        elif isinstance(layer, bytes):
            stack.append(scanner.bytes_layers(layer, origin))
        else:
            stack.append(scanner.feed_layers(layer, origin))
