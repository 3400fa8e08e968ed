"""Keys and tokens in less common encodings."""

import base64
import json
import textwrap

import pyarrow as pa
import pytest

from buylens.llm import secrets

from .test_text_rules import OPENSSH, RSA, web

B64 = lambda x: base64.b64encode(x).decode()
PEM = "-----BEGIN RSA PRIVATE KEY-----\n" + base64.encodebytes(RSA).decode() + "-----END RSA PRIVATE KEY-----\n"
LOCKED = "-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: DES-EDE3-CBC,0123456789ABCDEF\n\n%s-----END RSA PRIVATE KEY-----"


@pytest.mark.parametrize("text", [
    OPENSSH.hex(), OPENSSH.hex().upper(), B64(PEM.encode()), B64(b"x" + PEM.encode()), B64(b"xy" + PEM.encode()), PEM.encode().hex(), "a" + RSA.hex(),
    *("path" + c + B64(RSA) for c in "/_-"), "\n".join(textwrap.wrap(B64(RSA), 64)), "\r\n  ".join(textwrap.wrap(B64(RSA), 76)), "\\n".join(textwrap.wrap(B64(OPENSSH), 64)),
    "\n".join(textwrap.wrap(RSA.hex(), 64)), "\n".join(textwrap.wrap(B64(RSA), 30)), LOCKED % base64.encodebytes(bytes(range(160))).decode()])
def test_found(text):
    spans = [s for s in secrets.spans_of(pa.array([f"see: {text} end"]))[0] if s[0] == "key"]
    assert len(spans) == 1 and spans[0][1] >= 5 and spans[0][2] <= 5 + len(text) and spans[0][2] - spans[0][1] >= len(text.strip()) - 8


def test_exact_span_and_refused():
    key = B64(RSA)
    assert secrets.key_spans(f"ab/{key}\n\nMore".encode()) == [(3, 3 + len(key))]
    assert secrets.key_spans(B64(RSA[:-3]).encode()) == [] and secrets.key_spans(B64(OPENSSH[:-1]).encode()) == []
    assert secrets.found((LOCKED % base64.encodebytes(bytes(range(161))).decode()).encode()) == []


def test_short_unsigned_token():
    token = web(json.dumps({"alg": "none"}, separators=(",", ":")).encode()) + "." + web(b"{}") + "."
    assert len(token) < 40
    assert [s[0] for s in secrets.spans_of(pa.array([f"a {token} b", None, ""]))[0]] == ["token"]
