"""Operators that handle rows by themselves: bytes, tokens, media, chat."""

import gzip
import hashlib
import io
import random
import struct
import zipfile
import zlib

import pytest
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

from foldline.llm import bpe, chat, media, token_counts

ODD = [None, "", " ", "a", "Été 漢字 😀́", "a b　c  d\n\n\te ", "x" * 5000, "don't I'll  THE\r\n 123 %%% || ", "a", "word " * 20000, "<s>[INST]␛[/INST]</s>"]


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i, t, "c", 1) for i, t in enumerate(ODD)] + [(3, "a", "c", 1), (None, "no id", None, None)]
    return spark.createDataFrame(data, "doc_id long, text string, ids string, n_tokens int")


@pytest.fixture(scope="module")
def reference():
    with open(bpe.RANKS, "rb") as f:
        ranks = bpe.read_ranks(f.read())
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_round_trip(rows, reference):
    made = bpe.decode(bpe.encode(rows, offsets=True), ["doc_id", "n_tokens", "starts", "ends"]).collect()
    assert len(made) == len(ODD) + 2
    for r in made:
        text = "no id" if r.doc_id is None else ODD[r.doc_id] or ""
        want = reference.encode_ordinary(text)
        assert list(struct.unpack(f"<{r.n_tokens}I", r.ids)) == want
        assert bytes(r.decoded) == text.encode()
        assert len(r.starts) == r.n_tokens and all(a < b for a, b in zip(r.starts, r.ends))
        raw, at = text.encode(), 0
        for token, a, b in zip(want, r.starts, r.ends):
            piece = reference.decode_single_token_bytes(token)
            assert piece in text[a:b].encode() and raw[at : at + len(piece)] == piece
            at += len(piece)


def test_bpe_every_character(reference):
    with open(bpe.RANKS, "rb") as f:
        made = bpe.ByteBPE(f.read())
    rng = random.Random(3)
    for _ in range(60):
        text = "".join(rng.choice(["a", " ", "\n", "'s", "9", chr(rng.randrange(32, 0xD7FF)), chr(rng.randrange(0xE000, 0x1FFFF))]) for _ in range(200))
        (p,) = made.encode([text])
        assert list(struct.unpack(f"<{len(p) // 4}I", p)) == reference.encode_ordinary(text)


def test_bpe_empty_table(rows):
    assert bpe.encode(rows.limit(0)).count() == 0
    assert token_counts.count_edits(rows.limit(0).withColumn("edits", token_counts.sample_edits())).count() == 0


def test_edits_match_full_counts(spark, reference):
    rng = random.Random(5)
    texts = [t for t in ODD if t is not None] + ["".join(rng.choice("ab c\n,.'1 ") for _ in range(rng.randrange(400))) for _ in range(40)]
    data, want = [], {}
    for i, t in enumerate(texts):
        edits, now = [], t
        for _ in range(rng.randrange(6)):
            a = rng.randrange(len(now) + 3)
            b = a + rng.randrange(9)
            new = "".join(rng.choice("xy z\n'") for _ in range(rng.randrange(7)))
            edits.append((a, b, new))
            now = now[:a] + new + now[b:]
        data.append((i, t, edits))
        want[i] = (len(reference.encode_ordinary(t)), len(reference.encode_ordinary(now)), now)
    data.append((-1, None, None))
    data.append((-2, "tail", [None, (50, 2, None)]))
    want[-1], want[-2] = (0, 0, ""), (len(reference.encode_ordinary("tail")),) * 2 + ("tail",)
    df = spark.createDataFrame(data, "doc_id long, text string, edits array<struct<start:long,end:long,replacement:string>>")
    for r in token_counts.count_edits(df).collect():
        assert (r.tokens_before, r.tokens_after, r.edited) == want[r.doc_id], r.doc_id


def test_edits_encode_little(spark):
    df = spark.createDataFrame([(1, "some words here " * 5000, [(40_000, 40_003, "new text")])], "doc_id long, text string, edits array<struct<start:long,end:long,replacement:string>>")
    r = token_counts.count_edits(df).first()
    assert r.chunks_encoded < 10 < r.chunks_before


def _png():
    def chunk(name, data):
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


def _zip():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.txt", "hello")
    return out.getvalue()


GIF = b"GIF89a\1\0\1\0\x80\0\0\0\0\0\xff\xff\xff,\0\0\0\0\1\0\1\0\0\2\2D\1\0;"
MEDIA = {
    "image/png": _png(),
    "application/zip": _zip(),
    "application/gzip": gzip.compress(b"hello"),
    "image/gif": GIF,
    "audio/wav": media.wav(b"\1\2\3\4"),
    "application/pdf": b"%PDF-1.4\nstartxref\n9\n%%EOF",
    "image/jpeg": b"\xff\xd8\xff\xe0\0\4ab\xff\xda\0\3a" + b"data\xff\xd9",
    "image/bmp": b"BM" + struct.pack("<IIIIiiHH", 58, 0, 54, 40, 1, 1, 1, 24) + bytes(28),
}


def test_sniffing_corrects_and_carves(spark):
    whole = [(k, v, "text/plain") for k, v in MEDIA.items()]
    inside = [("in " + k, b"some text BM PK\3\4 " + v + b" RIFF more", "text/plain") for k, v in MEDIA.items()]
    broken = [("cut " + k, v[: len(v) - 4], "text/plain") for k, v in MEDIA.items() if k != "image/gif"]
    df = spark.createDataFrame(whole + inside + broken + [("null", None, "x/y"), ("none", b"", None)], "id string, media binary, declared_type string")
    sniffed = media.sniff(df, "id", "media", "declared_type")
    got = {r.id: r for r in sniffed.collect()}
    for kind in MEDIA:
        assert got[kind].media_type == kind and not got[kind].embedded
        assert got["in " + kind].media_type == "text/plain"
        assert [e.type for e in got["in " + kind].embedded] == [kind]
    for kind in ("image/png", "application/zip", "application/gzip", "audio/wav", "application/pdf", "image/bmp"):
        assert got["cut " + kind].media_type == "text/plain", kind
    assert got["null"].media_type == "x/y" and got["none"].media_type is None
    pieces = {r.id: bytes(r.media) for r in media.carve(sniffed, "id").collect()}
    assert pieces == {"in " + k: v for k, v in MEDIA.items()}


def test_media_behind_and_within_media(spark):
    mp4 = struct.pack(">I4s4s", 12, b"ftyp", b"mp42") + struct.pack(">I4s", 8, b"mdat")
    photo = MEDIA["image/jpeg"] + mp4
    png, zipped = MEDIA["image/png"], MEDIA["application/zip"]
    chunk = b"LIST" + struct.pack("<I", len(png)) + png + b"\0" * (len(png) % 2)
    sound = MEDIA["audio/wav"] + chunk
    sound = sound[:4] + struct.pack("<I", len(sound) - 8) + sound[8:]
    two_scans = b"\xff\xd8\xff\xe0\0\4ab\xff\xda\0\3adata\xff\0\xff\xd0more\xff\xc4\0\3b\xff\xda\0\3cend\xff\xd9"
    bomb = b"BM%PDF-" * 20_000 + b"\xff\xd8\xff\xe0\0\4ab\xff\xda\0\3a" * 20_000 + b"PK\3\4" * 20_000
    df = spark.createDataFrame([("photo", photo, "a/b"), ("tail", png + zipped, "a/b"), ("sound", sound, "a/b"), ("scans", two_scans, "a/b"), ("bomb", bomb, "a/b"), ("big", gzip.compress(bytes(1 << 20)) + png, "a/b")], "id string, media binary, declared_type string")
    sniffed = media.sniff(df, "id", "media", "declared_type")
    got = {r.id: (r.media_type, [(e.offset, e.length, e.type, e.container) for e in r.embedded]) for r in sniffed.collect()}
    at = sound.index(png)
    assert got["photo"] == ("image/jpeg", [(len(photo) - 20, 20, "video/mp4", None)])
    assert got["tail"] == ("image/png", [(len(png), len(zipped), "application/zip", None)])
    assert got["sound"] == ("audio/wav", [(at, len(png), "image/png", 0)])
    assert got["scans"] == ("image/jpeg", []) and got["bomb"] == ("a/b", [])
    assert got["big"][0] == "application/gzip" and got["big"][1][0][2:] == ("image/png", None)
    carved = {r.id: bytes(r.media) for r in media.carve(sniffed, "id").collect()}
    assert carved == {"photo": mp4, "tail": zipped, "sound": png, "big": png}


def test_text_media(rows, spark):
    for r in media.text_media(rows).collect():
        text = ("no id" if r.doc_id is None else ODD[r.doc_id] or "").encode()
        payload = media.wav_samples(bytes(r.media))
        assert r.n_bytes == len(text) and len(payload) % 576 == 0 and len(payload) > 0
        assert payload == text + b"\xff" * (len(payload) - len(text)) and len(payload) - len(text) <= 576


def test_op1_op3_op9_brute(spark, sf, reference):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in media.op1(spark, sf).collect():
        raw = docs[r.doc_id].encode()
        payload = raw + b"\xff" * (-len(raw) % 576 or 576 * (not raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert r.media_sha256 == hashlib.sha256(media.wav(payload)).hexdigest()
    for r in bpe.op3(spark, sf).collect():
        ids = reference.encode_ordinary(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()
    turns = {}
    for r in spark.read.parquet(f"{sf}/conversations.parquet").orderBy("conv_id", "turn").collect():
        turns.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    turns[-1] = [("user", chat.PLANTED), ("assistant", chat.PLANTED)]
    got = chat.op9(spark, sf).collect()
    assert {r.conv_id for r in got} == set(turns)
    for r in got:
        t = turns[r.conv_id]
        loss = "".join(x for role, x in t if role == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(t), hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in t).encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_chat_odd_rows(spark):
    texts = ["</s>[INST] ok [/INST]", "␛␛", "<␛/s>", "[ROLE] x [TEXT]", "<<SYS>>", "", " [/INST]", "<s", "<", "␛</s>"]
    data = [(1, k, "user" if k % 2 == 0 else "assistant", t, "z") for k, t in enumerate(texts)]
    data += [(2, 0, None, None, "z"), (2, 1, "tool [TEXT] </s>", "x", "z"), (3, 0, "user", "b", "z"), (3, 0, "user", "a", "z"), (3, 0, "user", "a", "z"), (None, 0, "user", "q", "z"), (4, 0, "system", "s", "z"), (4, 1, "user", "u", "z"), (4, 2, "assistant", "v", "z")]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string, loss string")
    segments = chat.format_turns(df)
    got = {r.conv_id: r for r in chat.read_back(segments).collect()}
    want = lambda rows: hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in rows).encode()).hexdigest()
    assert got[1].turns_sha256 == want([("user" if k % 2 == 0 else "assistant", t) for k, t in enumerate(texts)]) and got[1].valid
    assert got[2].turns_sha256 == want([("", ""), ("tool [TEXT] </s>", "x")]) and not got[2].valid
    assert got[3].turns_sha256 == want([("user", "a"), ("user", "a"), ("user", "b")]) and not got[3].valid
    assert got[4].valid and not got[None].valid
    whole = "".join(r.text for r in segments.filter("conv_id = 4").orderBy("turn_no", "seg_no").collect())
    assert whole == "<s><<SYS>> s <</SYS>>[INST] u [/INST] v </s>"
    assert chat.read_back(chat.format_turns(df.limit(0))).count() == 0
