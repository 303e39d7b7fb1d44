import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow.parquet as pq
import pytest
import tiktoken

from pagegauge.llm import bpe, chat, media

from .cases import SCHEMA, awkward, frame

RANKS = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def both():
    ranks = bpe.read_ranks(open(RANKS, "rb").read())
    return bpe.Tokenizer(ranks, P.PATTERN), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_every_code_point_as_the_library(both):
    own, library = both
    for start in range(0, 0x110000, 997):
        points = [c for c in range(start, min(start + 997, 0x110000)) if not 0xD800 <= c <= 0xDFFF]
        for shape in ("{}", "a{} ", " {}1"):
            text = "".join(shape.format(chr(c)) for c in points)
            assert own.encode(text) == library.encode_ordinary(text), hex(start)


def test_texts_as_the_library(both):
    own, library = both
    rng = random.Random(5)
    texts = [r["text"] for r in pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()]
    texts += ["a" * 5000, "ab" * 3001, "é" * 999, "   \n\n  x", "\r\n\t ", "\x1c\x1d a\x1e\x85 b", "<|endoftext|>", "I'll we've 'S"]
    texts += ["".join(rng.choice("ab \n'éß1　漢\U0001f600") for _ in range(rng.randint(0, 300))) for _ in range(400)]
    for t in texts:
        ids = own.encode(t)
        assert ids == library.encode_ordinary(t)
        assert own.decode(ids).decode() == t


def test_long_match_takes_few_steps(both):
    own, _ = both
    word = "xyzzy" * 40_000
    assert own.decode(own.encode(word)).decode() == word


def test_tokens_of_awkward_rows(spark, both):
    _, library = both
    want = Counter()
    for r in awkward():
        ids = library.encode_ordinary(r[1] or "")
        want[(r[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest())] += 1
    got = bpe.digests(frame(spark), RANKS, P.PATTERN).collect()
    assert Counter(map(tuple, got)) == want
    encoded = bpe.encode(frame(spark), RANKS, P.PATTERN)
    assert Counter((r["doc_id"], bytes(r["bytes"])) for r in bpe.decode(encoded, RANKS, P.PATTERN).collect()) == Counter((r[0], (r[1] or "").encode()) for r in awkward())
    assert bpe.digests(spark.createDataFrame([], SCHEMA), RANKS, P.PATTERN).count() == 0


TURNS = "conv_id long, turn long, role string, text string, loss string"


def plain_report(rows):
    by = {}
    for conv, turn, role, text, *_ in sorted(rows, key=lambda r: tuple((x is not None, x if x is not None else 0) if k < 2 else (x is not None, (x or "").encode()) for k, x in enumerate(r[:4]))):
        by.setdefault(conv, []).append((role or "", text or ""))
    out = set()
    for conv, turns in by.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        out.add((conv, len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    return out


def test_conversations_read_back(spark):
    rng = random.Random(2)
    bits = ["</s>", "[INST]", " [/INST]", "\\", "<<SYS>>\n", "\n<</SYS>>", "<<ROLE:", "\n<</ROLE>>\n", "<s>", " ", "a", "é", "[", "/INST]", "\n", "<", "</"]
    rows = [(-1, 0, "user", "</s>[INST] ok [/INST]", ""), (-1, 1, "assistant", "</s>[INST] ok [/INST]", "")]
    for conv in range(60):
        for turn in range(rng.randint(1, 8)):
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", "tool>>\n", None, ""]), None if rng.random() < 0.1 else "".join(rng.choice(bits) for _ in range(rng.randint(0, 12))), "x"))
    rows += [(7, 0, "user", "twice", ""), (7, 0, "user", "twice", ""), (None, 1, "user", "q", ""), (None, None, "assistant", "r", "")]
    rows += [(99, k, ("user", "assistant")[k % 2], "long " * 2000, "") for k in range(300)]
    got = chat.read_back(chat.segments(spark.createDataFrame(rows, TURNS))).collect()
    assert {(r["conv_id"], r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in got} == plain_report(rows)
    assert {r["conv_id"]: r["in_order"] for r in got}[-1] is True
    parts = chat.segments(spark.createDataFrame(rows, TURNS)).collect()
    by = Counter()
    for r in parts:
        by[r["conv_id"]] += len(r["text"])
    assert {r["conv_id"]: r["formatted_chars"] for r in got} == by


def test_order_of_turns(spark):
    rows = [(1, 0, "system", "s", ""), (1, 1, "user", "u", ""), (1, 2, "assistant", "a", ""), (2, 0, "assistant", "a", ""), (3, 0, "user", "u", ""), (4, 0, "user", "u", ""), (4, 1, "user", "u", ""), (4, 2, "assistant", "a", "")]
    got = chat.read_back(chat.segments(spark.createDataFrame(rows, TURNS))).collect()
    assert {r["conv_id"]: r["in_order"] for r in got} == {1: True, 2: False, 3: False, 4: False}
    assert chat.read_back(chat.segments(spark.createDataFrame([], TURNS))).count() == 0


@pytest.mark.parametrize("kind", range(5))
@pytest.mark.parametrize("shape", [(1, 1), (7, 13), (40, 576)])
def test_png_round_trip(kind, shape):
    image = np.random.default_rng(kind).integers(0, 256, shape, dtype=np.uint8)
    assert (media.read_png(media.write_png(image, kind, chunk=50)) == image).all()


@pytest.mark.parametrize("shape", [(1, 1), (9, 13), (5000, 40)])
def test_png_with_a_filter_for_each_row(shape):
    """Rows alike take filter 2, even ones filter 1, and bytes near zero none; all come back."""
    image = np.random.default_rng(1).integers(0, 4, shape, dtype=np.uint8)
    image[::5] = 200
    image[1::5] = image[: len(image[1::5]) * 5 : 5]
    chosen = media._chosen(image)
    assert (media._unfiltered(chosen, 1) == image).all()
    assert (media.read_png(media.write_png(image)) == image).all()
    if shape == (5000, 40):
        assert set(chosen[:, 0]) == {0, 1, 2}
        assert (chosen[1::5, 0] == 2).all()


def test_filters_are_undone_on_the_way(spark, monkeypatch):
    """Without undoing, payloads are not those that went in."""
    text = "words of a text that goes on " * 60
    stored = media.write_png(np.frombuffer(media.payload(text), np.uint8).reshape(-1, media.WIDTH))
    assert media.read_png(stored).tobytes() == media.payload(text)
    monkeypatch.setattr(media, "_unfiltered", lambda rows, step: rows[:, 1:])
    assert media.read_png(stored).tobytes() != media.payload(text)


def test_damaged_png_is_refused():
    good = media.write_png(np.arange(600, dtype=np.uint8).reshape(20, 30))
    for k in range(len(good)):
        bad = bytearray(good)
        bad[k] ^= 1
        with pytest.raises(media.MediaError):
            media.read_png(bytes(bad))
    for cut in (0, 7, 20, len(good) - 1):
        with pytest.raises(media.MediaError):
            media.read_png(good[:cut])


def test_media_columns(spark):
    got = media.features(media.to_media(frame(spark))).collect()
    want = Counter()
    for r in awkward():
        data = (r[1] or "").encode()
        pay = data + b"\xff" * ((-len(data)) % 576) if data else b"\xff" * 576
        want[(r[0], len(data), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-32:]))] += 1
    assert Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got) == want
    by = {}
    for r in got:
        assert r["error"] is None and len(r["feature"]) == 16
        assert by.setdefault(r["payload_sha256"], (r["feature"], r["media_sha256"], r["media_bytes"])) == (r["feature"], r["media_sha256"], r["media_bytes"])
    assert media.features(media.to_media(spark.createDataFrame([], SCHEMA))).count() == 0
    broken = spark.createDataFrame([(1, 2, bytearray(b"junk")), (2, 0, None)], "doc_id long, n_bytes long, media binary")
    assert all(r["error"] for r in media.features(broken).collect())


def test_feature_follows_content():
    base = np.add.outer(np.arange(200), np.arange(576)).astype(np.uint8) // 2
    near = base.copy()
    near[::7, ::9] ^= 3
    far = np.random.default_rng(0).integers(0, 256, base.shape, dtype=np.uint8)
    apart = lambda a, b: (int(media.cosine_hash(a), 16) ^ int(media.cosine_hash(b), 16)).bit_count()
    assert apart(base, near) <= 6 < apart(base, far)
