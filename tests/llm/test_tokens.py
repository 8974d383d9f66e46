import base64
import random
import re
import time

import public_tokenizers
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from brickfold.llm import bpe, secrets, token_counts

RANKS = open(bpe.RANKS, "rb").read()
OWN = bpe.Codec(RANKS, leaf=4)
THEIRS = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=OWN.ranks, special_tokens={})
SPEC = open(token_counts.TOKENIZER, encoding="utf-8").read()
COUNTER = token_counts.Counter(SPEC, token_counts.Counter(SPEC).whole_strings())
LIBRARY = Tokenizer.from_file(token_counts.TOKENIZER)
LETTERS = st.text(st.sampled_from("aabthe ß漢1'\n\t.<|>") | st.characters(codec="utf-8", categories=["Ll", "Nd", "Zs", "Po"], max_codepoint=0x2FFF), max_size=120)


@settings(max_examples=300, deadline=None)
@given(LETTERS)
def test_tree_encoding_equals_library(text):
    ids = OWN.encode(text)
    assert ids == THEIRS.encode_ordinary(text)
    assert OWN.decode(ids) == text.encode()


@pytest.mark.parametrize("text", ["a" * 5000, "ab" * 3000, "the" * 2000, "漢字" * 700])
def test_long_runs(text):
    assert OWN.encode(text) == THEIRS.encode_ordinary(text)
    assert COUNTER.count(text) == len(LIBRARY.encode(text, add_special_tokens=False).ids)


@settings(max_examples=300, deadline=None)
@given(LETTERS)
def test_counts_equal_library(text):
    for t in (text, f"{text}<|endoftext|>{text}"):
        assert COUNTER.count(t) == len(LIBRARY.encode(t, add_special_tokens=False).ids)


def characters():
    """Every tenth character of all planes, and all of those that a newer pattern module may know and the libraries do not."""
    import unicodedata

    chars = [chr(i) for i in range(1, 0x110000) if not 0xD800 <= i < 0xE000]
    late = [c for c in chars if unicodedata.category(c) == "Cn" and regex.match(r"[\p{L}\p{N}]", c)]
    return sorted({*chars[:0x600], *chars[0x600::37], *late})


def test_characters_of_all_planes():
    """Letters and digits are those of each library, whatever the pattern module knows."""
    chars = characters()
    for t in ("".join(f"a{c}'re {c}1" for c in chars[i : i + 50]) for i in range(0, len(chars), 50)):
        assert OWN.encode(t) == THEIRS.encode_ordinary(t)
        assert COUNTER.count(t) == len(LIBRARY.encode(t, add_special_tokens=False).ids)


def test_remembered_keeps_two_halves():
    from brickfold.llm.merging import Remembered

    calls = []
    table = Remembered(lambda k: calls.append(k) or len(k), {"fixed": 7}, most=2)
    assert [table[k] for k in ("a", "bb", "fixed", "a", "ccc", "a", "a")] == [1, 2, 7, 1, 3, 1, 1]
    assert calls == ["a", "bb", "ccc"] and len(table) + len(table.old) <= 4
    table["x" * 100]
    assert "x" * 100 not in table


def test_unknown_id_raises():
    with pytest.raises((KeyError, IndexError)):
        OWN.decode([10**6])


def test_token_reports_awkward(awkward, empty):
    assert bpe.round_trip(awkward).count() == awkward.count() == token_counts.token_counts(awkward).count()
    texts = {r.doc_id: r.text or "" for r in awkward.collect()}
    for r in token_counts.token_counts(awkward).collect():
        assert r.n_bytes == len(texts[r.doc_id].encode()) and r.over_limit == (r.n_tokens > 1024)
    assert bpe.round_trip(empty).count() == 0 == token_counts.token_counts(empty).count()


def der(tag, body):
    n = len(body)
    size = bytes([n]) if n < 128 else bytes([0x80 + (n.bit_length() + 7) // 8]) + n.to_bytes((n.bit_length() + 7) // 8, "big")
    return bytes([tag]) + size + body


def test_confirmed_structures():
    number = der(2, b"\x11" * 64)
    pkcs1 = der(0x30, der(2, b"\0") + number * 8)
    run = base64.b64encode(pkcs1).decode()
    field = lambda b: len(b).to_bytes(4, "big") + b
    ssh = b"openssh-key-v1\0" + field(b"none") + field(b"none") + field(b"") + (1).to_bytes(4, "big") + field(b"p" * 40) + field(b"s" * 80)
    part = lambda x: base64.urlsafe_b64encode(x).decode().rstrip("=")
    jwt = f'{part(b"""{"alg":"HS256"}""")}.{part(b"""{"sub":"1"}""")}.abc'
    kinds = lambda t: [k for k, _, _ in secrets.spans(t)]
    assert kinds(f"é {run} .") == ["key"] and kinds(f"x {base64.b64encode(ssh).decode()}") == ["key"]
    assert kinds(f"-----BEGIN RSA PRIVATE KEY-----\n{run}\n-----END RSA PRIVATE KEY-----").count("pem") == 1
    assert kinds(jwt) == ["jwt"] and kinds("eyJhbGci.eyJzdWIi.abc") == []
    assert kinds(base64.b64encode(pkcs1[:-1]).decode()) == [] and kinds("A" * 80) == []


def test_confirmed_structures_in_other_forms():
    kinds = lambda t: [k for k, _, _ in secrets.spans(t)]
    part = lambda x: base64.urlsafe_b64encode(x).decode().rstrip("=")
    for head in (b'{"alg":"HS256"}', b'{ "alg": "HS256"}', b'{\n"alg": "HS256"}', b'{\t"typ":"JWT","alg":"none"}'):
        token = f"{part(head)}.{part(b'{}')}."
        for before, after in (("", ""), ("a.b.", " c"), ("é=", "xyz"), ("..", ".d.e"), ("Bearer ", ")")):
            text = before + token + after
            assert [text[a:b] for k, a, b in secrets.spans(text) if k == "jwt"] == [token + ("xyz" if after == "xyz" else "")]
    touching = f"x_{part(b'{"alg":"HS256"}')}.{part(b'{}')}.s"
    assert secrets.spans(touching) == [("jwt", 2, len(touching))]
    assert kinds("they.went.away eye.ewe.eyJ") == [] and kinds(f"{part(b'[1]')}.{part(b'{}')}.s") == []
    number = der(2, b"\x11" * 64)
    run = base64.b64encode(der(0x30, der(2, b"\0") + number * 8)).decode()
    lines = [run[i : i + 64] for i in range(0, len(run), 64)]
    for end in ("\n", "\r\n", "\\n", "\\r\\n"):
        assert "pem" in kinds(f"-----BEGIN RSA PRIVATE KEY-----{end}{end.join(lines)}{end}-----END RSA PRIVATE KEY-----")
    cipher = der(0x30, der(6, b"\x2a\x86\x48\x86\xf7\x0d\x01\x05\x0d") + der(0x30, der(4, b"s" * 8) + der(2, b"\x08\0")))
    sealed = base64.b64encode(der(0x30, cipher + der(4, b"\x5a" * 160))).decode()
    assert "pem" in kinds(f"-----BEGIN ENCRYPTED PRIVATE KEY-----\n{sealed}\n-----END ENCRYPTED PRIVATE KEY-----")
    open_ = base64.b64encode(der(0x30, der(0x30, der(6, b"\x2a\x03") + der(5, b"")) + der(3, b"\0" * 160))).decode()
    assert kinds(f"-----BEGIN ENCRYPTED PRIVATE KEY-----\n{open_}\n-----END ENCRYPTED PRIVATE KEY-----") == []


def test_secrets_take_linear_time():
    def seconds(text):
        began = time.process_time()
        secrets.spans(text)
        return time.process_time() - began

    for piece in ("eyJ", "eyJ.", "-----BEGIN PRIVATE KEY-----", "-----BEGIN PRIVATE KEY-----ab\\n", "token", "AKIA", "0a"):
        assert seconds(piece * 200_000) < 5


def brute_base(text):
    """The contract's patterns with their lower bounds checked afterwards."""
    kinds = [("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8), ("access", "AKIA[A-Z0-9]+", 0, 16), ("hex", "[0-9a-f]+", 0, 32)]
    return [(k, *m.span()) for k, p, g, n in kinds for m in re.finditer(p, text, re.I | re.A if k == "assign" else 0) if len(m[g]) >= n]


def test_base_spans_against_brute_force():
    deal = random.Random(3)
    pieces = ["password", "PassWd", "api_key", "APIKEY", "token", "secret", '"', "'", " ", "  ", ":", "=", "AKIA", "AKIAABCDEFGH", "IJKLMN", "0a1b2c3d4e5f6789" * 2, "deadbeef", "abc.d/e+", "x", "é", "\n", "\u212a", "ſecret"]
    for _ in range(20_000):
        text = "".join(deal.choices(pieces, k=deal.randrange(14)))
        assert sorted(s for s in secrets.spans(text) if s[0] in secrets.BASE) == sorted(brute_base(text))


def test_base_spans():
    text = 'é PassWord: "abc12345" token=short secret = a.b/c+d=_9 AKIAABCDEFGHIJKL AKIAX ' + "0a" * 16 + " " + "ab" * 15
    found = [("assign", 'PassWord: "abc12345'), ("assign", "secret = a.b/c+d=_9"), ("access", "AKIAABCDEFGHIJKL"), ("hex", "0a" * 16)]
    assert secrets.spans(text) == [(kind, text.index(s), text.index(s) + len(s)) for kind, s in found]


def test_secret_report_awkward(awkward, empty):
    assert secrets.secret_report(awkward).count() == awkward.count()
    assert secrets.secret_report(empty).count() == 0
