import hashlib
import random
import struct
import zlib

import numpy as np
import tiktoken

from evenkeel.llm import byte_bpe, telephony

from .frames import documents, rows


def test_tables_by_the_g711_rules():
    ulaw, alaw = telephony.mulaw_table(), telephony.alaw_table()
    assert ulaw[[0x00, 0x7F, 0x80, 0xFF, 0x0F]].tolist() == [-32124, 0, 32124, 0, -16764]
    assert alaw[[0x55, 0xD5, 0x2A, 0xAA]].tolist() == [-8, 8, -32256, 32256]
    assert len(set(alaw.tolist())) == 256 and len(set(ulaw.tolist())) == 255


def slow_adpcm(block):
    predictor, index = struct.unpack("<hB", block[:3])
    index, out = min(index, 88), [predictor]
    for byte in block[4:]:
        for nibble in (byte & 15, byte >> 4):
            step = telephony.STEPS[index]
            d = step >> 3
            for bit, part in ((4, step), (2, step >> 1), (1, step >> 2)):
                d += part if nibble & bit else 0
            predictor = max(-32768, min(32767, predictor - d if nibble & 8 else predictor + d))
            index = max(0, min(88, index + telephony.INDEX_CHANGES[nibble & 7]))
            out.append(predictor)
    return out


def test_adpcm_blocks():
    rnd = np.random.default_rng(2)
    blocks = rnd.integers(0, 256, (50, 64)).astype(np.uint8)
    assert telephony.decode_adpcm(blocks).tolist() == [slow_adpcm(bytes(b)) for b in blocks]


def test_media(spark):
    table = rows()
    got = telephony.telephony_digest(documents(spark)).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.payload_sha256, r.tail_crc32) for r in got) == sorted(
        (str(r[0]), len((r[1] or "").encode()), hashlib.sha256(p := telephony.payload((r[1] or "").encode())).hexdigest(), zlib.crc32(p[-64:])) for r in table
    )
    pcm = telephony.media_features(telephony.store_media(documents(spark)), keep_pcm=True).where("id = 9").first()
    samples = np.frombuffer(telephony.samples_of(pcm.pcm), np.int16)
    assert len(samples) == 128 and samples[::2].tolist() == telephony.MULAW[np.frombuffer(telephony.payload(b"one"), np.uint8)].tolist()
    assert telephony.telephony_digest(documents(spark, [])).count() == 0


def slow_media(text):
    """media_bytes, media_sha256, feature, pcm_bytes and pcm_sha256 of a text, sample by sample."""
    data = text + b"\0" * (-len(text) % 64 if text else 64)
    fmt = struct.pack("<HHIIHH", 7, 1, 8000, 8000, 1, 8)
    body = b"WAVEfmt " + struct.pack("<I", 16) + fmt + b"fact" + struct.pack("<II", 4, len(data)) + b"data" + struct.pack("<I", len(data)) + data
    media = b"RIFF" + struct.pack("<I", len(body)) + body
    ulaw, alaw = telephony.mulaw_table().tolist(), telephony.alaw_table().tolist()
    pcm, other = [ulaw[b] for b in data], [alaw[b] for b in data]
    wide = []
    for x, y in zip(pcm, [*pcm[1:], pcm[-1]]):
        wide += [x, (x + y) // 2]
    samples = struct.pack(f"<{len(wide)}h", *wide)
    adpcm = [x for i in range(0, len(data), 64) for x in slow_adpcm(data[i : i + 64])]
    rms = lambda v: (sum(x * x for x in v) / len(v)) ** 0.5
    turns = sum((x < 0) != (y < 0) for x, y in zip(pcm, pcm[1:]))
    feature = f"ulaw8k rms={rms(pcm):.3f} peak={max(map(abs, pcm))} zc={turns} alaw_rms={rms(other):.3f} adpcm={zlib.crc32(struct.pack(f'<{len(adpcm)}h', *adpcm)):08x} pcm16k={zlib.crc32(samples):08x}"
    head = b"WAVEfmt " + struct.pack("<I", 16) + struct.pack("<HHIIHH", 1, 1, 16000, 32000, 2, 16) + b"data" + struct.pack("<I", len(samples))
    stored = b"RIFF" + struct.pack("<I", len(head) + len(samples)) + head + samples
    return len(media), hashlib.sha256(media).hexdigest(), feature, len(stored), hashlib.sha256(stored).hexdigest()


def test_stored_forms_and_features(spark):
    got = telephony.telephony_digest(documents(spark)).collect()
    found = sorted((str(r.doc_id), r.media_bytes, r.media_sha256, r.feature, r.pcm_bytes, r.pcm_sha256) for r in got)
    assert found == sorted((str(r[0]), *slow_media((r[1] or "").encode())) for r in rows())


def own_and_public(**sizes):
    own = byte_bpe.Codec(byte_bpe.default_ranks(), byte_bpe.default_pattern(), **sizes)
    return own, tiktoken.Encoding("own", pat_str=byte_bpe.default_pattern(), mergeable_ranks=own.ranks, special_tokens={})


def test_tree_equals_whole():
    own, public = own_and_public(leaf_chars=8, leaf_bytes=6)
    rnd = random.Random(4)
    parts = ["a", "e", " ", "  ", "\n", "'", "s", "re", "ll", "t", "1", "23", "!!", "é", "日本", "the", " and", "xxxxx", "\t", "'ll", "👍", "%", "\x1c", "\x85", " "]
    for _ in range(4000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randrange(60)))
        ids = own.encode(text)
        assert ids == public.encode_ordinary(text) and own.decode(ids) == text.encode()
    for _ in range(2000):
        text = "".join(rnd.choice("abcdehiorstn") for _ in range(rnd.randrange(80)))
        assert own.encode(text) == public.encode_ordinary(text)


def test_long_matches():
    own, public = own_and_public()
    text = "".join(random.Random(1).choice("abcdehiorstn") for _ in range(20000))
    assert own.encode(text) == public.encode_ordinary(text)
    assert own.decode(own.encode("a" * 100_000)) == b"a" * 100_000


def test_bpe_digest(spark):
    _, public = own_and_public()
    want = []
    for r in rows():
        ids = public.encode_ordinary(r[1] or "")
        want.append((str(r[0]), len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()))
    got = byte_bpe.bpe_digest(documents(spark)).collect()
    assert sorted((str(r[0]), *r[1:]) for r in map(tuple, got)) == sorted(want)
    back = byte_bpe.decode(byte_bpe.encode(documents(spark))).collect()
    assert sorted((str(r.id), bytes(r.data)) for r in back) == sorted((str(r[0]), (r[1] or "").encode()) for r in rows())
    assert byte_bpe.bpe_digest(documents(spark, [])).count() == 0
